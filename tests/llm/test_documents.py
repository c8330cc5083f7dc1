"""Operators on documents against brute force, on rows of every odd kind."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spanloom.llm import bpe, fm_index, minhash, packing, quality, suffix_dedup

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "extra string, doc_id long, text string, shard int, label string"


def texts(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage = say(150), say(90)
    out = [base, base, base + " one more", base.upper(), say(40) + "\n" + passage + "\t" + say(30), passage + " " + say(20), say(10) + " " + passage, None, "", " \n ", "single", "three small words", "é ü 漢字 🙂 " * 60, say(4000), "re " * 700, "re " * 300 + say(50)]
    return out + [say(rng.randint(1, 200)) for _ in range(12)]


@pytest.fixture(scope="module")
def rows():
    out = [("x", i, t, 3, "l") for i, t in enumerate(texts())]
    return [*out, out[0], out[7], ("x", None, out[0][2], None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_bpe(docs, rows, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    want = Counter()
    for _, i, t, _, _ in rows:
        ids = whole.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(docs, path, public_tokenizers.PATTERN).collect())) == want
    assert bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_round_trip(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert Counter((r.doc_id, bytes(r.content).decode()) for r in back) == Counter((i, t or "") for _, i, t, _, _ in rows)


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for _, i, t, _, _ in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (a, n) in enumerate(packing.cuts(len(ids))):
            want[i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += 1
    assert pieces == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 500])
def test_sum_of_squares(n):
    sizes = np.random.default_rng(n).integers(1, 1025, n)
    bins, offsets = packing.sum_of_squares(sizes)
    assert n == 0 or (np.bincount(bins, sizes).max() <= 1024 and bins.max() + 1 <= 1.05 * sizes.sum() / 1024 + 2)
    assert len(set(zip(bins.tolist(), offsets.tolist()))) == n


def sets(t):
    w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, rows, empty):
    s = {i: sets(t) for _, i, t, _, _ in rows if i is not None}
    label = {i: i for i in s}
    for _ in s:
        for a in s:
            for b in s:
                if s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = minhash.link(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
        else:
            assert r.component_id is None and r.kept
    assert minhash.link(empty).count() == 0


def test_a_dissimilar_pair_is_pruned_and_a_similar_one_is_not():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 32, (400, minhash.HASHES), dtype=np.uint32)
    near, far = a.copy(), a.copy()
    near[rng.random(a.shape) > 0.9] += 1
    far[rng.random(a.shape) > 0.5] += 1
    assert len(minhash.survivors(a, near)) == 400 and len(minhash.survivors(a, far)) == 0


def test_word_windows(docs, rows, empty):
    ranked = [(np.inf if i is None else i, i, words(t)) for _, i, t, _, _ in rows]
    first = {}
    for order, _, w in ranked:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(order, first.get(tuple(w[k : k + 13]), np.inf))
    want = Counter()
    for order, i, w in ranked:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order:
                gone[k : k + 13] = [True] * 13
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    assert Counter(map(tuple, fm_index.dedup(docs).collect())) == want
    assert fm_index.dedup(empty).count() == 0


def test_backward_search():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 6, 400)
    index = fm_index.PassageIndex(text, np.array([150, 250]), np.array([9, 4]))
    code = text + 2
    for size in (1, 3, 13):
        for start in (0, 60, 200, 380):
            lo, hi = index.search(code, np.array([start]), size)
            places = [k for k in range(400 - size + 1) if (k >= 150 or k + size <= 150) and (text[k : k + size] == text[start : start + size]).all()]
            assert hi[0] - lo[0] == len(places)
            assert index.least_owner(lo, hi)[0] == min((9 if k < 150 else 4 for k in places), default=fm_index.NO_ID)


def removed(contents, span):
    seen = Counter(t[k : k + span] for t in contents for k in range(len(t) - span + 1))
    out = []
    for t in contents:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if seen[t[k : k + span]] > 1:
                gone[k : k + span] = True
        out.append(gone)
    return out


def test_byte_strings(docs, rows, empty):
    contents = [(t or "").encode() for _, _, t, _, _ in rows]
    want = Counter()
    for (_, i, _, _, _), t, gone in zip(rows, contents, removed(contents, 400), strict=True):
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in suffix_dedup.digests(docs).collect()) == want
    assert suffix_dedup.digests(empty).count() == 0
    short, want = suffix_dedup.remove(docs, 240), Counter()
    assert short.columns == docs.columns
    for (_, i, t, *_), gone in zip(rows, removed(contents, 240), strict=True):
        lead = [k for k, x in enumerate((t or "").encode()) if x & 0xC0 != 0x80] + [len(gone)]
        want[i, "".join(c for c, a, z in zip(t or "", lead, lead[1:], strict=False) if not gone[a:z].any())] += 1
    assert Counter((r.doc_id, r.text) for r in short.collect()) == want


def doubling(n, a="a", b="b"):
    """A Thue-Morse word."""
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


def test_doubling_words_do_not_fall_together(spark):
    say = lambda k, n: " ".join(f"v{k}x{j}" for j in range(n))
    own = []
    for n in (1024, 4096):
        for a, b in (("a", "b"), ("abcdefgh", "ABCDEFGH")):
            own += [f"{say(n, 12)} {doubling(n, a, b)}", f"{say(n, 12)} {doubling(n, b, a)}", f"{doubling(n, a, b)}", f"{doubling(n, b, a)}"]
    # a whole document of two words in that order
    own += [doubling(2048, "yes ", "no "), doubling(2048, "no ", "yes ")]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    assert all(r.n_removed == 0 for r in fm_index.dedup(docs.where("doc_id < 16")).collect())
    s = {i: sets(t) for i, t in enumerate(own)}
    for r in minhash.link(docs).collect():
        like = min(b for b in s if s[b] and 100 * len(s[r.doc_id] & s[b]) >= 85 * len(s[r.doc_id] | s[b]))
        assert (r.n_shingles, r.component_id) == (len(s[r.doc_id]), like)
    want = {i: (len(t), int(g.sum())) for i, (t, g) in enumerate(zip(own, removed([t.encode() for t in own], 400), strict=True))}
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.digests(docs).collect()} == want


def test_a_collision_is_found_and_mended(monkeypatch):
    """Hashes that tell nothing apart under the first seed."""
    whole = suffix_dedup.K.RangeHash.ranges
    init = suffix_dedup.K.RangeHash.__init__

    def seeded(self, data, seed=0):
        init(self, data, seed)
        self.seed = seed

    monkeypatch.setattr(suffix_dedup.K.RangeHash, "__init__", seeded)
    monkeypatch.setattr(suffix_dedup.Suffixes, "right", lambda self, a, b, room: np.minimum(np.minimum(*room), self.most) if self.hashes.seed < 2 else self._extent(a, b, np.minimum(np.minimum(*room), self.most), True))
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 100, 900).astype(np.uint8))
    own = [base[:600] + b"!" * 20, base[100:], b"?" + base[:500]]
    part = np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in own])])
    ((first, last),) = suffix_dedup.repeated_starts([part], [])
    assert (suffix_dedup.K.covered(len(part[0]), first, last + 400) == np.concatenate(removed(own, 400))).all()
    assert whole is suffix_dedup.K.RangeHash.ranges


@pytest.mark.parametrize("seed", range(12))
def test_suffix_order(seed):
    """Many passages that end at the same places, periodic texts, and few letters."""
    rng = np.random.default_rng(seed)
    rand = lambda n: bytes(rng.integers(97, 100, n).astype(np.uint8))
    base = [rand(1500), rand(700), b"ab" * 500, b"x" * 800]
    own = []
    for _ in range(16):
        t = b""
        for _ in range(3):
            s = base[int(rng.integers(4))]
            a = int(rng.integers(0, len(s)))
            t += s[a : a + int(rng.integers(0, 1200))] + rand(int(rng.integers(0, 40)))
        own.append(t)
    pack = lambda ts: (np.frombuffer(b"".join(ts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in ts])]).astype(np.int64))
    parts = [pack(own[:6]), pack(own[6:11])]
    found = suffix_dedup.repeated_starts(parts, [pack(own[11:])])
    want, k = removed(own, 400), 0
    for (data, off), (first, last) in zip(parts, found, strict=True):
        n = len(off) - 1
        assert (suffix_dedup.K.covered(len(data), first, last + 400) == np.concatenate(want[k : k + n])).all()
        k += n


def test_mergesort_is_suffix_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    s = suffix_dedup.Suffixes(data, np.array([0, 600]))
    at = np.arange(0, 600, 7)
    order = s.mergesort(at, 600 - at, np.zeros(len(at), np.int64))
    assert at[order].tolist() == sorted(at.tolist(), key=lambda k: data[k : k + 400].tobytes())


def test_quality(spark, docs, rows, empty):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(30, 90))) + ".") for i in range(100, 160)]
    bad = [(i, rng.choice(["BUY NOW!! ", "spam "]) * rng.randint(20, 80)) for i in range(200, 240)]
    every = spark.createDataFrame([*good, *bad, *((r[1], r[2]) for r in rows)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, 1) for i, _ in good), *((i, 0) for i, _ in bad), (5, None), (None, 1), (6, 7)], "doc_id long, quality int")
    got = quality.classify(every, labels).collect()
    assert len(got) == len(good) + len(bad) + len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    known = {r.doc_id: r.predicted for r in got if r.held_out}
    right = [known[i] == q for q, own in ((1, good), (0, bad)) for i, _ in own if i in known]
    assert sum(right) >= 0.9 * len(right)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
