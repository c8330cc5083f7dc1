"""Token ids of whole texts, as the tokenizers library gives them for a byte-level BPE file."""

from __future__ import annotations

import json
import re
from functools import lru_cache


def _unicode_to_byte() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: itself, or 256 and on for the others."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merges_are_ranks(model: dict) -> bool:
    """Whether a merge comes before another just if its result has the smaller id."""
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ()))
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    return all(a < b for a, b in zip([-1, *made], made, strict=False))


@lru_cache(maxsize=2)
def batch_encoder(path: str):
    """A function from texts to id lists, without special tokens.

    A byte-level vocabulary whose ids are the merge ranks goes through tiktoken's
    merge loop, which gives the ids of the tokenizers library several times
    faster; any other file, and texts with a special token's string, go through
    the library itself.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True  # their strings are ordinary text

    def slow(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE" or spec.get("normalizer"):
        return slow
    if any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")) or not _merges_are_ranks(model):
        return slow
    import tiktoken

    back, special = _unicode_to_byte(), [x["content"] for x in spec.get("added_tokens", [])]
    ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    # the library's fixed pattern for byte-level pre-tokens
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("|".join(map(re.escape, special))) if special else None

    def run(texts: list[str]) -> list[list[int]]:
        return [slow([t])[0] if odd and odd.search(t) else fast.encode_ordinary(t) for t in texts]

    return run
