"""Byte-level BPE by a global distinct-word shuffle.

Encoding: each block of documents splits its texts into pre-tokens and numbers
the distinct ones. The distinct words of all blocks are shuffled by a hash of
the word, so that each word of the corpus meets its copies in one place and is
encoded once; its ids go back to every block that asked, where the documents'
pre-token positions turn them into ids again. Only distinct words per block and
one small number for each position are shuffled, never a row for each position.
Texts are read twice, for words and for positions: writing positions down and shuffling
them would take twice the disk. A block is known by a digest of what is in it, so a
second reading that cuts blocks otherwise can't take another block's ids; it fails.

Decoding joins the token-byte table, whose size is that of the vocabulary, so that it
is held by each worker.

Nulls: a null text is empty; a null document id stays null. An empty text has no
ids. Repeated rows stay repeated. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BLOCK_BYTES = 20 << 20
#: Text bytes for each part of the words.
PART_BYTES = 14 << 20
DOCS_PER_ROW = 512
_SPLIT = "block long, part int, kind int, blob binary"
_IDS = "doc_id long, ids array<int>"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank, from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def piece_encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})._encode_single_piece


@lru_cache(maxsize=2)
def token_byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens end to end, and each id's start and length."""
    table = ranks(path)
    size = max(table.values(), default=-1) + 1
    by_id = [b""] * size
    for b, i in table.items():
        by_id[i] = b
    length = np.fromiter(map(len, by_id), np.int64, size)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(length) - length, length


@lru_cache(maxsize=2)
def _names(path: str) -> list[str]:
    return [str(i) for i in range(max(ranks(path).values(), default=-1) + 1)]


def joined_bytes(ids: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end, joined with the token-byte table: their bytes, and the offsets of the lists that start at `at`."""
    data, start, length = token_byte_table(path)
    size = length[ids]
    return data[K.spread(start[ids], size)], np.concatenate([[0], np.cumsum(size)])[at]


def _digest_of(rows: list[tuple[pa.Array, pa.Array]]) -> int:
    h = hashlib.blake2b(digest_size=8)
    for doc_ids, texts in rows:
        data, off = K.text_bytes(texts)
        for part in (doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), off, data):
            h.update(np.ascontiguousarray(part).data)
    return int.from_bytes(h.digest(), "little", signed=True)


def _split_block(rows: list[tuple[pa.Array, pa.Array]], parts: int, splitter) -> list[tuple]:
    block = _digest_of(rows)
    number: dict[str, int] = {}
    ids, counts, seqs = [], [], []
    for doc_ids, texts in rows:
        ids.append(doc_ids)
        for text in texts.to_pylist():
            found = splitter.findall(text) if text else []
            seqs.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
            counts.append(len(found))
    seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
    # frequent words get small numbers: their high bytes are zero and compress away
    order = np.argsort(-np.bincount(seq, minlength=len(number)), kind="stable")
    rank = np.empty(len(number), np.uint32)
    rank[order] = np.arange(len(number), dtype=np.uint32)
    seq, counts = rank[seq], np.array(counts, np.uint32)
    doc_ids = pa.chunked_array(ids).combine_chunks()
    null = np.asarray(doc_ids.is_null())
    doc_id = np.asarray(doc_ids.fill_null(0)).astype(np.int64)
    out, at = [], np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    for lo in range(0, len(counts), DOCS_PER_ROW):
        hi = min(lo + DOCS_PER_ROW, len(counts))
        head = K.squeeze(doc_id[lo:hi], null[lo:hi].astype(np.uint8), counts[lo:hi])
        out.append((block, -1, 1, len(head).to_bytes(4, "little") + head + K.squeeze(seq[at[lo] : at[hi]])))
    words = list(number)
    raw = [w.encode() for w in words]
    home = np.fromiter((zlib.crc32(b) % parts for b in raw), np.int32, len(raw))
    by = np.argsort(home, kind="stable")
    lo, hi = K.runs(np.diff(home[by], prepend=-1) != 0) if len(by) else (np.zeros(0, int),) * 2
    for a, b in zip(lo, hi, strict=True):
        own = by[a:b]
        length = np.fromiter((len(raw[i]) for i in own), np.uint32, len(own))
        head = K.squeeze(rank[own], length)
        out.append((block, int(home[own[0]]), 0, len(head).to_bytes(4, "little") + head + K.squeeze_bytes(b"".join(raw[i] for i in own))))
    return out


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_SPLIT_KINDS = (["block", "part", "kind", "blob"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])


def _splits(pattern: str, parts: int):
    def run(batches):
        splitter, held, size = regex.compile(pattern), [], 0
        for b in K.slices(batches, BLOCK_BYTES // 4):
            text = b.column(1)
            held.append((b.column(0), text))
            size += len(K.text_bytes(text)[0])
            if size >= BLOCK_BYTES:
                yield _batch(_split_block(held, parts, splitter), *_SPLIT_KINDS)
                held, size = [], 0
        if held:
            yield _batch(_split_block(held, parts, splitter), *_SPLIT_KINDS)

    return run


def _cut_blob(blob: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(blob[:4], "little")
    return blob[4 : 4 + n], blob[4 + n :]


def _encodes(path: str, pattern: str):
    """Encode each distinct word of a partition once, and answer every block that holds it."""

    def run(batches):
        encode, known = piece_encoder(path, pattern), {}
        for b in batches:
            rows = []
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob").to_pylist(), strict=True):
                head, raw = _cut_blob(blob)
                number, length = K.unsqueeze(head, np.uint32, np.uint32)
                raw, at = K.unsqueeze_bytes(raw), np.concatenate([[0], np.cumsum(length, dtype=np.int64)]).tolist()
                found = []
                for i in range(len(length)):
                    w = raw[at[i] : at[i + 1]]
                    if (x := known.get(w)) is None:
                        x = known[w] = np.array(encode(w), np.uint32)
                    found.append(x)
                head = K.squeeze(number, np.fromiter(map(len, found), np.uint32, len(found)))
                rows.append((block, -1, 0, len(head).to_bytes(4, "little") + head + K.squeeze(np.concatenate(found))))
            if rows:
                yield _batch(rows, *_SPLIT_KINDS)

    return run


def _joins(finish):
    """Put a block's ids back at its documents' positions."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table["kind"])
        blobs = table["blob"]
        number, length, ids = [], [], []
        for i in np.flatnonzero(kind == 0):
            head, body = _cut_blob(blobs[int(i)].as_py())
            a, b = K.unsqueeze(head, np.uint32, np.uint32)
            number.append(a)
            length.append(b)
            ids.append(K.unsqueeze(body, np.uint32)[0])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        n = sum(map(len, number))
        size, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n:
            number, length = np.concatenate(number), np.concatenate(length).astype(np.int64)
            size[number], start[number] = length, np.cumsum(length) - length
        out = []
        for i in np.flatnonzero(kind == 1):
            head, body = _cut_blob(blobs[int(i)].as_py())
            doc_id, null, count = K.unsqueeze(head, np.int64, np.uint8, np.uint32)
            seq = K.unsqueeze(body, np.uint32)[0]
            if len(seq) and (seq.max() >= n or not size[seq].all()):
                raise ValueError("the documents weren't the same when read again; write them down first")
            own = flat[K.spread(start[seq], size[seq])]
            ends = np.concatenate([[0], np.cumsum(size[seq])])[np.cumsum(count, dtype=np.int64)]
            out.append(finish(pa.array(doc_id, mask=null.astype(bool)), own, np.concatenate([[0], ends])))
        return pa.Table.from_batches(out) if out else finish(pa.array([], pa.int64()), flat[:0], np.zeros(1, np.int64), True)

    return run


def _as_ids(doc_id, ids, at, empty=False):
    batch = pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])
    return pa.Table.from_batches([batch]) if empty else batch


def encode(documents: DataFrame, path: str, pattern: str, finish=_as_ids, schema: str = _IDS) -> DataFrame:
    """Ids of every whole text: (doc_id, ids array<int>).

    `finish` may turn a block's (document ids, ids end to end, offsets) into other
    columns, named by `schema`, where they are made.
    """
    docs = K.with_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = K.shard_count(docs, PART_BYTES)
    rows = docs.mapInArrow(_splits(pattern, parts), _SPLIT)
    answers = rows.where("kind = 0").repartition(parts, "part").mapInArrow(_encodes(path, pattern), _SPLIT)
    return rows.where("kind = 1").unionByName(answers).groupBy("block").applyInArrow(_joins(finish), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, content binary), by a map-side join with the token-byte table."""

    def run(batches):
        for b in batches:
            lists = b.column(1).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists], dtype=np.int64)])
            data, cut = joined_bytes(np.array([i for x in lists for i in x or ()], np.int64), at, path)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and give each document's count and digests of ids and decoded bytes."""

    def finish(doc_id, ids, at, empty=False):
        get, plain, ends = _names(path).__getitem__, ids.tolist(), at.tolist()
        decoded, cut = joined_bytes(ids, at, path)
        cut, n = cut.tolist(), len(doc_id)
        a = [hashlib.sha256(" ".join(map(get, plain[ends[i] : ends[i + 1]])).encode()).hexdigest() for i in range(n)]
        b = [hashlib.sha256(decoded[cut[i] : cut[i + 1]]).hexdigest() for i in range(n)]
        batch = pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at).astype(np.int64)), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.Table.from_batches([batch]) if empty else batch

    return encode(documents, path, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
