"""Classes, patterns, word lists and thresholds that results depend on.

Patterns are written for Java's engine. Texts are Unicode, so white space, digits,
letters and word characters are spelled out; `re2()` gives the same for RE2.
"""

from __future__ import annotations

import re

# fixed values
STRATEGIES = ("fixed", "paragraph", "section")
SIZE, OVERLAP, MAX_CHARS, TOP_K, MAX_TOKENS = 500, 100, 1200, 5, 256
SHORT_CHARS, SMALL_AVERAGE, SMALL_LEAST = 100, 200, 30
SAME_PASSAGE, FRAGMENT_INSIDE, ANSWER_COVERED = 0.25, 0.5, 0.5
BUCKETS = 512
EXTENSIONS = (".txt", ".md", ".markdown", ".rst", ".text")
STORE_DOCUMENTS, CACHED_TEXTS, CACHED_PAGES, MAX_ITEMS = 5, 50_000, 8, 500

_WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{_WS}]"
NOT_WS = f"[^{_WS}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLANK_LINES = r"\n[ \t]*\n+"
SENTENCES = rf"[\s\S]*?[.!?]{WS}+|[\s\S]+"
CONTROL = r"[\x00-\x08\x0E-\x1F\x7F-\x9F\uFFFD]"

# headings
MARKDOWN = rf"(?s)\A(#{{1,6}}){WS}+(.+?){WS}*#*{WS}*\z"
UNDERLINE = r"\A(=+|-+)\z"
DASHED = rf"\A[-=]{{3,}}{WS}*([A-Z][^-=]*?[A-Za-z)]){WS}*[-=]{{3,}}\z"
NUMBERED = rf"(?s)\A((?:\p{{Nd}}+\.)*\p{{Nd}}+)\.?{WS}+([A-Z].{{0,80}})\z"
NUMERIC = r"\A[\p{Nd}.,:%/()+*†±<>=-]*\p{Nd}[\p{Nd}.,:%/()+*†±<>=-]*\z"
EXACT_NUMBER = r"\p{Nd}[.,%]|%"
SENTENCE_OR_COLON_END = r"[.!?:][)\]\"'”’]*\z"
TABLE_CELL = rf"\A\(?{WS}*[nN]{WS}*=|\A[%†‡*§]+\z|\A[\p{{Nd}}.,%()+\-−–{_WS}]+\z"
FINISHED = rf"[.!?][)\]\"'”’]*(?:{WS}|\z)"
LOWER_WORD = r"\A[a-z][a-z'’-]*[.,;:!?)]*\z"
CODE = r"[A-Za-z]\p{Nd}|\p{Nd}[A-Za-z]"
_IN_WORD = r"[\p{L}\p{N}_]"
OFFICE = (
    rf"(?iu)(?<!{_IN_WORD})\p{{Nd}}{{5}}(?:-\p{{Nd}}{{4}})?(?!{_IN_WORD})"
    rf"|License Number|Revised:|Reference ID|\ASee \p{{Nd}}+ for(?!{_IN_WORD})"
    rf"|(?<!{_IN_WORD})\p{{Nd}}{{3}}\)?[-. ]\p{{Nd}}{{3}}[-. ]\p{{Nd}}{{4}}(?!{_IN_WORD})"
    rf"|(?<!{_IN_WORD})(?:Drive|Street|Avenue|Road|Boulevard|Suite)\z"
    rf"|{WS}(?:and|or|for|the|of|to|with)\z"
)
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to", "with")
PARAGRAPH_LINES = 6

# flags
BULLET = rf"\A(?:[•▪◦*-]|o{WS}|\p{{Nd}}+[.)]{WS}|[a-z][.)]{WS}|#)"
SENTENCE_END = rf"[.!?][)\]\"”’':;]*{WS}*\z"
SAYS = rf"[^{_WS})\]\"”’':;]"  # neither white space nor what may close a sentence
NUMBERS = r"(\p{L}?)([-−+]?\p{Nd}+(?:[.,]\p{Nd}+)*%?)"
LABELS = r"[A-Za-z][A-Za-z'’-]+"
UNIT_TOKENS = r"[\p{L}\p{N}_°%µ.]+"
NUMBER_TOKEN = r"\A[-−+]?\p{Nd}+(?:[.,]\p{Nd}+)*%?\z"
PLAIN_WORD = r"\A[a-z][a-z'’-]+[.,;:]?\z"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
DATES = (
    r"\b\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4}\b|\b\p{Nd}{1,2}/\p{Nd}{4}\b|\b\p{Nd}{4}-\p{Nd}{2}(?:-\p{Nd}{2})?\b"
    rf"|\b(?:{MONTHS})[a-z]*\.?{WS}+(?:\p{{Nd}}{{1,2}},?{WS}+)?\p{{Nd}}{{4}}\b"
)
UNITS = ("mg", "ml", "kg", "g", "cm", "mm", "km", "lb", "lbs", "oz", "in", "ft", "mcg", "µg", "l", "hr", "hrs", "h", "min", "sec", "ms", "days", "weeks", "months", "years", "%", "°f", "°c")
NOT_LABELS = ("mg", "ml", "kg", "g", "cm", "mm", "km", "lb", "lbs", "oz", "in", "ft", "mcg", "µg", "hr", "hrs", "min", "sec", "ms", "n", "vs", "to", "or", "and", "of", "per", "the", "a", "an", "at", "by", "x", "ci", "p", "na", "nr")

# page clean-up
HYPHEN_SPLIT = r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)"
ENDINGS = (".", "!", "?", ":", '."', ".”")


def re2(pattern: str) -> str:
    """The same pattern for RE2."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern)
