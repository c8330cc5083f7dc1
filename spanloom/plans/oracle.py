"""SQL for DuckDB that gives each query's rows by another way: recursion, windows and joins instead of folds."""

from __future__ import annotations

import re

from ..functions import patterns as P
from . import corpora as C

NL = "chr(10)"


def q(pattern: str) -> str:
    """A pattern as an SQL string for RE2."""
    return "'" + P.re2(pattern).replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {q(chr(92) + 'A' + P.WS + '+')}, ''), {q(P.WS + '+' + chr(92) + 'z')}, '')"


def rstrip(c: str) -> str:
    return f"regexp_replace({c}, {q(P.WS + '+' + chr(92) + 'z')}, '')"


def lstrip(c: str) -> str:
    return f"regexp_replace({c}, {q(chr(92) + 'A' + P.WS + '+')}, '')"


def listed(names) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def find(c: str, pattern: str) -> str:
    return f"regexp_extract_all({c}, {q(pattern)})"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


PLAIN = f"plain AS (SELECT doc_id, coalesce(text, '') || {NL} AS text FROM documents)"
SPACED = f"spaced AS (SELECT doc_id, replace(coalesce(text, ''), {NL}, {NL} || {NL}) || {NL} AS text FROM documents)"
_K = "((i - 1) // 4)"
HEADED = f"""headed AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), {NL}), lambda x, i:
  CASE WHEN (i - 1) % 4 = 0 THEN CASE {_K} % 5 WHEN 0 THEN '# Part ' || {_K} WHEN 1 THEN '## Topic ' || {_K} WHEN 2 THEN '### Detail ' || {_K}
    WHEN 3 THEN '---Field notes---' ELSE '2.' || {_K} || ' Topic' END || {NL} || x ELSE x END), {NL}) || {NL} AS text FROM documents)"""


def fixed(src: str, size: int = P.SIZE, overlap: int = P.OVERLAP, name: str = "fixed") -> str:
    step = size - overlap
    return f"""{name} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start,
  CAST(least(s + {size}, length(text)) AS INTEGER) AS "end", substr(text, CAST(s + 1 AS BIGINT), {size}) AS text
  FROM {src}, unnest(range(0, greatest(length(text), 1), {step})) t(s)
  WHERE (s = 0 OR s - {step} + {size} < length(text)) AND {has(f'substr(text, CAST(s + 1 AS BIGINT), {size})', P.NOT_WS)})"""


def paragraphs(src: str) -> str:
    """paras(doc_id, i, start, stop, piece)"""
    return f"""blocks AS (SELECT doc_id, i, parts[i] AS p, coalesce(length(gaps[i]), 0) AS gap FROM
  (SELECT doc_id, string_split_regex(text, {q(P.BLANK_LINES)}) AS parts, {find('text', P.BLANK_LINES)} AS gaps FROM {src}), unnest(range(1, len(parts) + 1)) t(i)),
placed AS (SELECT doc_id, i, p, sum(length(p) + gap) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - gap AS pos_ FROM blocks),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, pos_ + length(p) - length({lstrip('p')}) AS start,
  pos_ + length(p) - length({lstrip('p')}) + length({strip('p')}) AS stop, {strip('p')} AS piece FROM placed WHERE {strip('p')} <> '')"""


def long_spans(src: str) -> str:
    """pieces(doc_id, k, start, stop) of src(doc_id, k, start, piece, most): greedy packing by recursion over sentence ends."""
    return f"""ends AS (SELECT doc_id, k, i, CAST(sum(length(s[i])) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS b FROM
  (SELECT doc_id, k, {find('piece', P.SENTENCES)} AS s FROM {src} WHERE length(piece) > most), unnest(range(1, len(s) + 1)) t(i)),
walk AS (SELECT doc_id, k, most, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS fit, CAST(-1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS z, CAST(0 AS BIGINT) AS whole FROM {src} WHERE length(piece) > most
  UNION ALL
  SELECT doc_id, k, most, i + 1, CASE WHEN fits THEN cur ELSE begin_ + n * most END, b, CASE WHEN NOT fits AND fit > cur THEN cur ELSE -1 END, fit, CASE WHEN fits THEN 0 ELSE n END
  FROM (SELECT w.*, e.b, e.b - w.cur <= w.most AS fits, greatest(w.cur, w.fit) AS begin_, greatest(0, (e.b - greatest(w.cur, w.fit) - 1) // w.most) AS n FROM walk w JOIN ends e ON e.doc_id = w.doc_id AND e.k = w.k AND e.i = w.i + 1)),
cuts AS (SELECT doc_id, k, {{'a': a, 'b': z}} AS c FROM walk WHERE a >= 0
  UNION ALL SELECT doc_id, k, {{'a': cur - (j + 1) * most, 'b': cur - j * most}} FROM walk, unnest(range(whole)) t(j)
  UNION ALL SELECT doc_id, k, {{'a': max(cur), 'b': max(fit)}} FROM walk GROUP BY doc_id, k HAVING max(cur) < max(fit)),
rough AS (SELECT c.doc_id, c.k, s.start + c.c.a AS pos_, substr(s.piece, c.c.a + 1, c.c.b - c.c.a) AS p FROM cuts c JOIN {src} s ON s.doc_id = c.doc_id AND s.k = c.k),
pieces AS (SELECT doc_id, k, pos_ + length(p) - length({lstrip('p')}) AS start, pos_ + length(p) - length({lstrip('p')}) + length({strip('p')}) AS stop FROM rough WHERE {strip('p')} <> ''
  UNION ALL SELECT doc_id, k, start, start + length(piece) FROM {src} WHERE length(piece) <= most)"""


def paragraph_chunks(src: str, most: int, name: str = "paragraph") -> str:
    # a trimmed block may start later than its untrimmed one, but is never longer
    return f"""{paragraphs(src)},
wanted AS (SELECT doc_id, i AS k, start, piece, {most} AS most FROM paras),
{long_spans('wanted')},
{name} AS (SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.start) - 1 AS INTEGER) AS chunk_index, CAST(p.start AS INTEGER) AS start, CAST(p.stop AS INTEGER) AS "end",
  substr(d.text, CAST(p.start + 1 AS BIGINT), CAST(p.stop - p.start AS BIGINT)) AS text FROM pieces p JOIN {src} d USING (doc_id))"""


SECTIONS = f"""lines AS (SELECT doc_id, i - 1 AS line, s[i] AS t, sum(length(s[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s[i]) - 1 AS pos_
  FROM (SELECT doc_id, string_split(substr(text, 1, length(text) - 1), {NL}) AS s FROM headed), unnest(range(1, len(s) + 1)) x(i)),
kinds AS (SELECT doc_id, line, t, pos_, {has('t', P.MARKDOWN)} AS md, {has('t', P.DASHED)} AS dashed, {has('t', P.NUMBERED)} AND contains(regexp_extract(t, {q(P.NUMBERED)}, 1), '.') AND NOT regexp_matches(t, '[.,;:]$') AS num
  FROM lines WHERE length({strip('t')}) BETWEEN 1 AND 100),
heads AS (SELECT doc_id, line, pos_, length(t) AS n, CASE WHEN md THEN length(regexp_extract(t, {q(P.MARKDOWN)}, 1)) WHEN dashed THEN 2 ELSE len(regexp_extract_all(regexp_extract(t, {q(P.NUMBERED)}, 1), '\\.')) + 1 END AS level,
  CASE WHEN md THEN regexp_extract(t, {q(P.MARKDOWN)}, 2) WHEN dashed THEN regexp_extract(t, {q(P.DASHED)}, 1) ELSE {strip('t')} END AS title, num AND NOT md AND NOT dashed AS num,
  row_number() OVER (PARTITION BY doc_id ORDER BY line) AS h FROM kinds WHERE md OR dashed OR num),
above AS (SELECT a.doc_id, a.h, list(b.title ORDER BY b.h) AS titles FROM heads a JOIN heads b ON a.doc_id = b.doc_id AND b.h < a.h AND b.level < a.level AND NOT a.num
  WHERE NOT EXISTS (SELECT 1 FROM heads c WHERE c.doc_id = a.doc_id AND c.h > b.h AND c.h < a.h AND (c.num OR c.level <= b.level)) GROUP BY ALL),
tree AS (SELECT doc_id, CAST(h - 1 AS INTEGER) AS section_no, line, level, title, list_append(coalesce(titles, []), title) AS path, pos_, pos_ + n AS header_end, pos_ + n + 1 AS body_at,
  coalesce(lead(pos_) OVER (PARTITION BY doc_id ORDER BY h), length(d.text)) AS body_end FROM heads LEFT JOIN above USING (doc_id, h) JOIN headed d USING (doc_id)),
bodies AS (SELECT t.*, body_at + length(b) - length({lstrip('b')}) AS start, {strip('b')} AS piece, array_to_string(path, ' > ') || {NL} || {NL} AS prefix
  FROM (SELECT t.*, substr(d.text, CAST(body_at + 1 AS BIGINT), CAST(body_end - body_at AS BIGINT)) AS b FROM tree t JOIN headed d USING (doc_id)) t)"""

SECTION_CHUNKS = f"""{SECTIONS},
wanted AS (SELECT doc_id, section_no AS k, start, piece, greatest(200, 1200 - length(prefix)) AS most FROM bodies WHERE piece <> ''),
{long_spans('wanted')},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY start) AS r FROM pieces),
packed AS (SELECT n.doc_id, n.k, n.r, n.start AS g, n.stop AS z, w.most FROM numbered n JOIN wanted w USING (doc_id, k) WHERE r = 1
  UNION ALL SELECT n.doc_id, n.k, n.r, CASE WHEN n.stop - p.g <= p.most THEN p.g ELSE n.start END, n.stop, p.most FROM packed p JOIN numbered n ON n.doc_id = p.doc_id AND n.k = p.k AND n.r = p.r + 1),
grouped AS (SELECT doc_id, k, g, max(z) AS z FROM packed GROUP BY ALL),
section AS (SELECT g.doc_id, CAST(row_number() OVER (PARTITION BY g.doc_id ORDER BY g.g) - 1 AS INTEGER) AS chunk_index, CAST(CASE WHEN g.g = b.start THEN b.pos_ ELSE g.g END AS INTEGER) AS start, CAST(g.z AS INTEGER) AS "end",
  b.prefix || substr(d.text, CAST(g.g + 1 AS BIGINT), CAST(g.z - g.g AS BIGINT)) AS text, array_to_string(b.path, ' > ') AS path FROM grouped g JOIN bodies b ON b.doc_id = g.doc_id AND b.section_no = g.k JOIN headed d ON d.doc_id = g.doc_id)"""

# names that two parts of one statement share are told apart
_PARAGRAPH_HEADED = paragraph_chunks("headed", P.MAX_CHARS)
for _n in ("ends", "walk", "cuts", "rough", "pieces", "wanted"):
    _PARAGRAPH_HEADED = re.sub(rf"\b{_n}\b", f"p_{_n}", _PARAGRAPH_HEADED)

_CHUNKS = f"""{fixed('headed')}, {_PARAGRAPH_HEADED}, {SECTION_CHUNKS},
chunks AS (SELECT doc_id, 'fixed' AS strategy, chunk_index, start, "end", text FROM fixed UNION ALL SELECT doc_id, 'paragraph', chunk_index, start, "end", text FROM paragraph
  UNION ALL SELECT doc_id, 'section', chunk_index, start, "end", text FROM section)"""
CHUNKS = f"{HEADED}, {_CHUNKS}"


def questions(src: str) -> str:
    return f"""questions AS (SELECT b.item_id AS question_id, d.doc_id, b.text AS question, CAST(instr(d.text, b.text) - 1 AS INTEGER) AS ans_start,
  CAST(instr(d.text, b.text) - 1 + least(length(b.text), 250) AS INTEGER) AS ans_end FROM {src} d JOIN benchmark b ON contains(d.text, b.text))"""


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(w, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda a, z: xor(a >> 1, (a & 1) * CAST(3988292384 AS UBIGINT)))), CAST(4294967295 AS UBIGINT)) % 512"""


def ranked(chunks: str, k: int = P.TOP_K) -> str:
    """hits of questions over chunks(doc_id, strategy, chunk_index, start, end, text)"""
    return f"""own AS (SELECT * FROM {chunks} WHERE doc_id IN (SELECT doc_id FROM questions)),
said AS (SELECT doc_id, strategy, chunk_index, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM own),
q_said AS (SELECT question_id, doc_id, unnest(regexp_extract_all(lower(question), '[a-z]+')) AS w FROM questions),
codes AS (SELECT w, {_CRC} AS bucket FROM (SELECT w FROM said UNION SELECT w FROM q_said)),
tf AS (SELECT doc_id, strategy, chunk_index, bucket, count(*) AS n FROM said JOIN codes USING (w) GROUP BY ALL),
q_tf AS (SELECT question_id, doc_id, bucket, count(*) AS n FROM q_said JOIN codes USING (w) GROUP BY ALL),
norms AS (SELECT doc_id, strategy, chunk_index, CAST(sum(n * n) AS BIGINT) AS s FROM tf GROUP BY ALL),
q_norms AS (SELECT question_id, doc_id, CAST(sum(n * n) AS BIGINT) AS s FROM q_tf GROUP BY ALL),
dots AS (SELECT question_id, doc_id, strategy, chunk_index, CAST(sum(a.n * b.n) AS BIGINT) AS s FROM q_tf a JOIN tf b USING (doc_id, bucket) GROUP BY ALL),
scored AS (SELECT q.question_id, o.doc_id, o.strategy, o.chunk_index, o.start, o."end", coalesce(d.s / sqrt(CAST(n.s * m.s AS DOUBLE)), 0.0) AS score FROM questions q JOIN own o USING (doc_id)
  LEFT JOIN dots d USING (question_id, doc_id, strategy, chunk_index) LEFT JOIN norms n USING (doc_id, strategy, chunk_index) LEFT JOIN q_norms m USING (question_id, doc_id)),
hits AS (SELECT question_id, doc_id, strategy, CAST(rank AS INTEGER) AS rank, chunk_index, round_even(score, 4) AS score, start, "end" FROM
  (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, strategy ORDER BY score DESC, chunk_index) AS rank FROM scored) WHERE rank <= {k})"""


_KEPT = "headed|headed_all|questions|wanted|p_wanted|ends|p_ends|pieces|p_pieces|paras|lines|kinds|heads|tree|bodies|chunks|own|codes|hits|fixed|tiny|spans|edges|filled|page_lines|pages_|agree|mixed"


def sql(*parts: str) -> str:
    """One statement; what is used more than once is worked out once."""
    return "WITH RECURSIVE " + re.sub(rf"(?<![\w.])({_KEPT}) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", ",\n".join(parts[:-1])) + "\n" + parts[-1]


# only documents that are asked about are chunked
_ASKED = (HEADED.replace("headed AS", "headed_all AS", 1), questions("headed_all"), "headed AS (SELECT * FROM headed_all WHERE doc_id IN (SELECT doc_id FROM questions))", _CHUNKS)
HITS = (*_ASKED, ranked("chunks"))
_SMALL = (
    *_ASKED,
    fixed("headed", 60, 10, "tiny"),
    "mixed AS (SELECT doc_id, 'fixed' AS strategy, chunk_index, start, \"end\", text FROM tiny UNION ALL SELECT * FROM chunks WHERE strategy <> 'fixed')",
    ranked("mixed"),
)
SHARED = 'greatest(0, least(a."end", b."end") - greatest(a.start, b.start))'
RATIO = f'{SHARED} / greatest(1, a."end" - a.start, b."end" - b.start)'
SAME = f'least(a."end" - a.start, b."end" - b.start) >= 100 AND {RATIO} >= 0.25'
MATCHES = f"""matches AS (SELECT a.question_id, a.doc_id, a.strategy, a.rank, b.strategy AS other_strategy, b.rank AS other_rank FROM hits a JOIN hits b USING (question_id, doc_id) WHERE a.strategy <> b.strategy AND {SAME})"""
PAIRS = "pairs AS (SELECT DISTINCT question_id, doc_id, p.a, p.b FROM hits, (VALUES ('fixed', 'paragraph'), ('fixed', 'section'), ('paragraph', 'section')) p(a, b))"
AGREE = f"""agree AS (SELECT p.question_id, p.doc_id, p.a, p.b, coalesce({SAME.replace('a."end"', 'x."end"').replace('b."end"', 'y."end"').replace('a.start', 'x.start').replace('b.start', 'y.start')}, false) AS top1_agree FROM pairs p
  LEFT JOIN hits x ON x.question_id = p.question_id AND x.doc_id = p.doc_id AND x.strategy = p.a AND x.rank = 1 LEFT JOIN hits y ON y.question_id = p.question_id AND y.doc_id = p.doc_id AND y.strategy = p.b AND y.rank = 1)"""
HELD = "greatest(0, least(h.\"end\", q.ans_end) - greatest(h.start, q.ans_start))"
HAS = f"({HELD} > 0 AND {HELD} / greatest(1, q.ans_end - q.ans_start) >= 0.5)"
RANKS = f"""ranks AS (SELECT q.question_id, q.doc_id, s.strategy, min(h.rank) FILTER (WHERE {HAS}) AS answer_rank FROM questions q CROSS JOIN (VALUES ('fixed'), ('paragraph'), ('section')) s(strategy)
  LEFT JOIN hits h ON h.question_id = q.question_id AND h.doc_id = q.doc_id AND h.strategy = s.strategy GROUP BY ALL)"""
ORDER = "CASE {0} WHEN 'fixed' THEN 1 WHEN 'paragraph' THEN 2 ELSE 3 END"
FRAGMENTS = f"""tops AS (SELECT * FROM hits WHERE rank = 1),
fragments AS (SELECT a.question_id, a.doc_id, a.strategy, a.start, a."end", list(b.strategy ORDER BY {ORDER.format('b.strategy')}) FILTER (WHERE b.strategy <> a.strategy AND b."end" - b.start >= 100 AND {SHARED} > 0 AND {SHARED} / greatest(1, a."end" - a.start) >= 0.5) AS inside
  FROM tops a LEFT JOIN tops b USING (question_id, doc_id) WHERE a."end" - a.start < 100 GROUP BY ALL)"""
TINY_FIXED = (SPACED, f"""spans AS (SELECT doc_id, d.text AS text, f.start, f."end" FROM tiny f JOIN spaced d USING (doc_id))""")

PAGES = f"""rows_ AS (SELECT concat_ws('/', source, CAST(doc_id // 64 AS VARCHAR)) AS doc_id, doc_id AS pos_, coalesce(text, '') AS text FROM documents),
pages_ AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos_) AS INTEGER) AS page_no, text || {NL} || 'Reference ID: 777' || {NL} || 'Page ' || row_number() OVER (PARTITION BY doc_id ORDER BY pos_) || ' of ' || count(*) OVER (PARTITION BY doc_id) AS text FROM rows_),
page_lines AS (SELECT doc_id, page_no, i - 1 AS line_no, s[i] AS line FROM (SELECT doc_id, page_no, string_split(text, {NL}) AS s FROM pages_), unnest(range(1, len(s) + 1)) x(i)),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no DESC) AS down,
  CASE WHEN length({strip('line')}) <= 40 THEN regexp_replace(lower({strip('line')}), '\\p{{Nd}}+', '#', 'g') ELSE lower({strip('line')}) END AS key FROM page_lines WHERE {has('line', P.NOT_WS)}),
edges AS (SELECT * FROM filled WHERE up <= 3 OR down <= 3),
running AS (SELECT e.doc_id, e.key, count(DISTINCT e.page_no) AS pages FROM edges e JOIN (SELECT doc_id, count(*) AS total FROM pages_ GROUP BY 1) t USING (doc_id) WHERE total >= 3 GROUP BY e.doc_id, e.key, total HAVING count(DISTINCT e.page_no) >= greatest(3, total // 4))"""

STRIPPED = (
    "gone AS (SELECT e.doc_id, e.page_no, e.line_no FROM edges e JOIN running r USING (doc_id, key) WHERE key <> '')",
    f"stripped AS (SELECT p.doc_id, p.page_no, coalesce(string_agg(l.line, {NL} ORDER BY l.line_no), '') AS text FROM pages_ p LEFT JOIN (SELECT * FROM page_lines ANTI JOIN gone USING (doc_id, page_no, line_no)) l USING (doc_id, page_no) GROUP BY ALL)",
)


def rejoined(src: str) -> tuple[str, str]:
    """Parts, and the statement, that rejoin words split at line ends in src(doc_id, text)."""
    return (
        f"""p AS (SELECT doc_id, string_split_regex(text, {q(P.HYPHEN_SPLIT)}) AS b, regexp_extract_all(text, {q(P.HYPHEN_SPLIT)}, 1) AS l, regexp_extract_all(text, {q(P.HYPHEN_SPLIT)}, 2) AS r,
  list_distinct(regexp_extract_all(lower(regexp_replace(text, {q(P.HYPHEN_SPLIT)}, ' ', 'g')), '[a-z]+')) AS known, lower(replace(text, '-' || {NL}, '-')) AS flat FROM {src}),
m AS (SELECT doc_id, i, l[i] AS a, r[i] AS z, known, flat, lower(l[i] || '-' || r[i]) AS form FROM p, unnest(range(1, len(l) + 1)) x(i)),
joined_ AS (SELECT doc_id, i, CASE WHEN NOT (regexp_matches(a || z, '\\A\\p{{L}}+\\z') AND a = lower(a) AND z = lower(z)) OR (length(flat) - length(replace(flat, form, ''))) / length(form) > 1
  OR (NOT list_contains(known, lower(a || z)) AND list_contains(known, lower(a)) AND list_contains(known, lower(z))) THEN a || '-' || z ELSE a || z END AS word FROM m)""",
        f"""SELECT p.doc_id, string_agg(p.b[x.i] || coalesce(f.word, ''), '' ORDER BY x.i) AS text FROM p, unnest(range(1, len(p.b) + 1)) x(i) LEFT JOIN joined_ f ON f.doc_id = p.doc_id AND f.i = x.i GROUP BY p.doc_id""",
    )


def inferred(src: str) -> tuple[str, str]:
    """Parts, and the statement, that break paragraphs in src(doc_id, text)."""
    return (
        f"""l AS (SELECT doc_id, i, s[i] AS t, {rstrip('s[i]')} AS s, coalesce({strip('s[i + 1]')}, '') AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), {NL}) AS s FROM {src}), unnest(range(1, len(s) + 1)) x(i)),
o AS (SELECT doc_id, length(t) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(t)) AS r, count(*) OVER (PARTITION BY doc_id) AS c FROM l WHERE {has('t', P.NOT_WS)}),
j AS (SELECT doc_id, c, n, r, least(greatest(8 * (c + 1) // 10, 1), c - 1) AS j FROM o),
f AS (SELECT doc_id, any_value(c) AS c, (max(n) FILTER (WHERE r = j) * (10 - (8 * (any_value(c) + 1) - 10 * any_value(j))) + max(n) FILTER (WHERE r = j + 1) * (8 * (any_value(c) + 1) - 10 * any_value(j))) / 10 AS full_ FROM j GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS k FROM l GROUP BY 1)""",
        f"""SELECT l.doc_id, string_agg(CASE WHEN f.c >= 10 AND (g.k - f.c) / g.k <= 0.05 AND s <> '' AND n <> '' AND ((length(s) < 0.75 * full_ AND (regexp_matches(s, '([.!?:]|\\."|\\.”)\\z') OR (length(s) BETWEEN 1 AND 59 AND NOT regexp_matches(s, '[.,;]\\z') AND regexp_matches(n, '\\A\\p{{Lu}}'))))
  OR (regexp_matches(s, '([.!?:]|\\."|\\.”)\\z') AND length(n) BETWEEN 1 AND 59 AND regexp_matches(n, '\\A\\p{{Lu}}') AND NOT regexp_matches(n, '[.,;:!?]\\z'))) THEN t || {NL} ELSE t END, {NL} ORDER BY i) AS text
FROM l JOIN g USING (doc_id) LEFT JOIN f USING (doc_id) GROUP BY l.doc_id""",
    )


ORACLE: dict[str, str] = {
    "chunk_fixed": sql(PLAIN, fixed("plain"), 'SELECT doc_id, chunk_index, start, "end", text FROM fixed'),
    "chunk_fixed_small": sql(PLAIN, fixed("plain", 100, 20), 'SELECT doc_id, chunk_index, start, "end", text FROM fixed'),
    "paragraph_spans": sql(SPACED, paragraphs("spaced"), 'SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM paras'),
    "sentence_boundaries": sql(
        PLAIN,
        f"""s AS (SELECT doc_id, {find('text', P.SENTENCES)} AS s FROM plain)""",
        "SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, CAST(sum(length(s[i])) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS stop FROM s, unnest(range(1, len(s) + 1)) t(i)",
    ),
    "chunk_paragraph": sql(SPACED, paragraph_chunks("spaced", 1200), 'SELECT doc_id, chunk_index, start, "end", text FROM paragraph'),
    "chunk_paragraph_long": sql(PLAIN, paragraph_chunks("plain", 200), 'SELECT doc_id, chunk_index, start, "end", text FROM paragraph'),
    "heading_candidates": sql(HEADED, SECTIONS, "SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(level AS INTEGER) AS level, title FROM tree"),
    "section_tree": sql(
        HEADED,
        SECTIONS,
        """SELECT doc_id, section_no, array_to_string(path, ' > ') AS path, CAST(pos_ AS INTEGER) AS header_start, CAST(header_end AS INTEGER) AS header_end,
  CAST(CASE WHEN piece <> '' THEN start END AS INTEGER) AS body_start, CAST(CASE WHEN piece <> '' THEN start + length(piece) END AS INTEGER) AS body_end FROM bodies""",
    ),
    "chunk_section": sql(HEADED, SECTION_CHUNKS, 'SELECT doc_id, chunk_index, start, "end", text, path FROM section'),
    "chunk_all_union": sql(CHUNKS, 'SELECT doc_id, strategy, chunk_index, start, "end", CAST(length(text) AS INTEGER) AS n_chars FROM chunks'),
    "section_at_asof": sql(
        HEADED,
        fixed("headed"),
        SECTIONS,
        'places AS (SELECT doc_id, start AS pos FROM fixed UNION SELECT doc_id, "end" - 1 FROM fixed)',
        "SELECT p.doc_id, p.pos, coalesce(array_to_string(t.path, ' > '), '') AS section FROM places p ASOF LEFT JOIN tree t ON t.doc_id = p.doc_id AND p.pos >= t.pos_",
    ),
    "fingerprints": sql(PLAIN, "SELECT doc_id, left(sha256(text), 16) AS fingerprint FROM plain"),
    "normalize_text": f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(chr(9) || replace(coalesce(text, ''), {NL}, ' ' || chr(160) || ' ' || chr(13) || {NL} || chr(13) || {NL} || chr(13) || {NL} || {NL}) || chr(13) || ' ' || {NL}, '\\r\\n?', {NL}, 'g'), chr(9), '    '),
  '[ \\x{{a0}}]+\\n', {NL}, 'g'), '\\n{{3,}}', {NL} || {NL}, 'g'), {q(chr(92) + 'A' + P.WS + '+')}, ''), {q(P.WS + '+' + chr(92) + 'z')}, '') || {NL} AS text FROM documents""",
    "looks_like_text": sql(PLAIN, "SELECT doc_id, 2 * (doc_id % 97) / (length(text) + 2 * (doc_id % 97)) <= 0.05 AS is_text FROM plain"),
    "load_documents": sql(
        PLAIN,
        f"""SELECT 'doc' || doc_id || ['.txt', '.MD', '', '.jpg', '.rst'][doc_id % 5 + 1] AS name, CASE WHEN doc_id % 5 <> 3 AND {strip('text')} <> '' THEN {strip('text')} || {NL} END AS text,
  CASE WHEN doc_id % 5 = 3 THEN 'not a .txt, .md or .pdf file' WHEN {strip('text')} = '' THEN 'no text in this file' END AS error FROM plain""",
    ),
    "running_line_keys": sql(PAGES, "SELECT doc_id, key, pages FROM running WHERE key <> ''"),
    "strip_running_lines": sql(PAGES, *STRIPPED, "SELECT * FROM stripped"),
    "rejoin_hyphens": "WITH " + ",\n".join((f"t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([a-z])([tne]) ([a-z])', '\\1\\2-' || {NL} || '\\3', 'g') AS text FROM documents)", rejoined("t")[0])) + "\n" + rejoined("t")[1],
    "infer_paragraphs": "WITH " + "\n".join(inferred("documents")),
    "pages_to_documents": sql(
        PAGES,
        *STRIPPED,
        f"""books AS (SELECT doc_id, coalesce(string_agg({strip('text')}, {NL} || {NL} ORDER BY page_no) FILTER (WHERE {strip('text')} <> ''), '') AS text FROM stripped GROUP BY doc_id)""",
        rejoined("books")[0],
        f"whole AS ({rejoined('books')[1]})",
        *inferred("whole"),
    ),
    "hash_embed_tf": sql(
        PLAIN,
        fixed("plain"),
        "said AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM fixed)",
        f"codes AS (SELECT w, {_CRC} AS bucket FROM (SELECT DISTINCT w FROM said))",
        "SELECT doc_id, chunk_index, CAST(bucket AS INTEGER) AS bucket, count(*) AS tf FROM said JOIN codes USING (w) GROUP BY ALL",
    ),
    "token_counts_truncated": sql(SPACED, paragraph_chunks("spaced", 1200), f"SELECT doc_id, chunk_index, CAST(len({find('text', P.NOT_WS + '+')}) AS INTEGER) AS tokens, len({find('text', P.NOT_WS + '+')}) > 256 AS truncated FROM paragraph"),
    "embed_cache_misses": sql(PLAIN, "SELECT DISTINCT 'hashed' AS model, sha256(text) AS digest FROM plain WHERE text NOT IN (SELECT text FROM plain WHERE doc_id % 2 = 0)"),
    "embed_cache_lru": sql(PLAIN, "SELECT digest, seq FROM (SELECT sha256(text) AS digest, max(doc_id) AS seq FROM plain GROUP BY 1) ORDER BY seq DESC, digest LIMIT 100"),
    "question_spans": sql(HEADED, questions("headed"), "SELECT question_id, doc_id, ans_start, ans_end FROM questions"),
    "topk_fixed": sql(PLAIN, fixed("plain"), questions("plain"), "named AS (SELECT doc_id, 'fixed' AS strategy, chunk_index, start, \"end\", text FROM fixed)", ranked("named"), "SELECT * EXCLUDE (strategy) FROM hits"),
    "topk_all": sql(*HITS, "SELECT * FROM hits"),
    "topk_dense": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.label, v.vec_id, round_even(list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_transform(list_zip(v.v, q.v), lambda p: p[1] * p[2])), lambda z, x: z + x), 4) AS score FROM v, v q WHERE q.vec_id % 50 = 0)
SELECT query_id, label, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "overlap_pairs": sql(*HITS, f'SELECT a.question_id, a.doc_id, a.strategy, a.rank, b.strategy AS other_strategy, b.start AS other_start, b."end" AS other_end, round_even({RATIO}, 4) AS ratio FROM hits a JOIN hits b USING (question_id, doc_id) WHERE a.strategy < b.strategy AND {SHARED} > 0'),
    "same_passage_matches": sql(*HITS, MATCHES, "SELECT * FROM matches"),
    "also_found_by": sql(*HITS, MATCHES, "SELECT question_id, doc_id, strategy, rank, other_strategy, min(other_rank) AS best_rank FROM matches GROUP BY ALL"),
    "unique_hits": sql(*HITS, MATCHES, "SELECT question_id, doc_id, strategy, rank, chunk_index FROM hits ANTI JOIN matches USING (question_id, doc_id, strategy, rank)"),
    "unique_counts": sql(*HITS, MATCHES, "alone AS (SELECT * FROM hits ANTI JOIN matches USING (question_id, doc_id, strategy, rank))", "SELECT h.question_id, h.doc_id, (SELECT count(*) FROM alone a WHERE a.question_id = h.question_id AND a.doc_id = h.doc_id) AS found_by_one, count(*) AS total FROM hits h GROUP BY ALL"),
    "topk_jaccard": sql(
        *HITS,
        PAIRS,
        'chars AS (SELECT DISTINCT question_id, doc_id, strategy, unnest(range(start, "end")) AS c FROM hits)',
        """counted AS (SELECT p.question_id, p.doc_id, p.a, p.b, c.c, count(DISTINCT c.strategy) AS n FROM pairs p JOIN chars c ON c.question_id = p.question_id AND c.doc_id = p.doc_id AND c.strategy IN (p.a, p.b) GROUP BY ALL)""",
        "SELECT question_id, doc_id, a, b, round_even(count(*) FILTER (WHERE n = 2) / count(*), 3) AS overlap FROM counted GROUP BY ALL",
    ),
    "top1_agreement": sql(*HITS, PAIRS, AGREE, "SELECT * FROM agree"),
    "top1_all_agree": sql(*HITS, PAIRS, AGREE, "SELECT question_id, doc_id, bool_and(top1_agree) AS top1_all_agree FROM agree GROUP BY ALL"),
    "top1_fragments": sql(*_SMALL, FRAGMENTS, f"SELECT f.question_id, f.doc_id, f.strategy, f.start, f.\"end\", {strip('substr(d.text, f.start + 1, f.\"end\" - f.start)')} AS text, coalesce(array_to_string(inside, '|'), '') AS inside FROM fragments f JOIN headed d USING (doc_id)"),
    "verdicts": sql(
        *_SMALL,
        FRAGMENTS,
        PAIRS,
        AGREE,
        f"small AS (SELECT question_id, doc_id, string_agg(strategy, '|' ORDER BY {ORDER.format('strategy')}) AS fragments FROM fragments GROUP BY ALL)",
        "SELECT a.question_id, a.doc_id, bool_and(top1_agree) AS all_agree, coalesce(string_agg(a || '+' || b, '|' ORDER BY a || '+' || b) FILTER (WHERE top1_agree), '') AS agreeing, coalesce(any_value(s.fragments), '') AS fragments FROM agree a LEFT JOIN small s USING (question_id, doc_id) GROUP BY ALL",
    ),
    "highlight_segments": sql(
        *HITS,
        'points AS (SELECT question_id, doc_id, start AS p FROM hits UNION SELECT question_id, doc_id, "end" FROM hits)',
        "stretches AS (SELECT question_id, doc_id, p AS start, lead(p) OVER (PARTITION BY question_id, doc_id ORDER BY p) AS stop FROM points)",
        f"""SELECT s.question_id, s.doc_id, s.start, s.stop AS "end", array_to_string(list_sort(list(DISTINCT h.strategy)), '|') AS strategies FROM stretches s JOIN hits h ON h.question_id = s.question_id AND h.doc_id = s.doc_id AND h.start <= s.start AND h."end" >= s.stop
  WHERE s.stop IS NOT NULL GROUP BY ALL""",
    ),
    "contains_answer": sql(*HITS, f"SELECT h.question_id, h.doc_id, h.strategy, h.rank, {HAS} AS has_answer FROM hits h JOIN questions q USING (question_id, doc_id)"),
    "answer_rank": sql(*HITS, RANKS, "SELECT *, coalesce('Answer found at rank ' || answer_rank, 'Not in top 5') AS verdict FROM ranks"),
    "evaluate_summary": sql(*HITS, RANKS, "SELECT strategy, count(answer_rank) AS found, count(*) AS total, round_even(avg(answer_rank), 2) AS avg_rank, round_even(sum(coalesce(1 / answer_rank, 0)) / count(*), 3) AS mrr FROM ranks GROUP BY ALL"),
    "strategy_stats": sql(
        CHUNKS,
        f"""s AS (SELECT doc_id, strategy, count(*) AS c, avg("end" - start) AS m, min("end" - start) AS lo, max("end" - start) AS hi, count(*) FILTER (WHERE len({find('text', P.NOT_WS + '+')}) > 256) AS t FROM chunks GROUP BY ALL)""",
        """SELECT d.doc_id, x.strategy, coalesce(c, 0) AS count, coalesce(CAST(round_even(m, 0) AS BIGINT), 0) AS avg_chars, coalesce(lo, 0) AS min_chars, coalesce(hi, 0) AS max_chars, coalesce(t, 0) AS truncated,
  CASE WHEN m < 200 THEN 'avg' WHEN lo < 30 THEN 'min' END AS too_small FROM documents d CROSS JOIN (VALUES ('fixed'), ('paragraph'), ('section')) x(strategy) LEFT JOIN s ON s.doc_id = d.doc_id AND s.strategy = x.strategy""",
    ),
    "too_small_verdict": sql(PLAIN, fixed("plain", 300, 50), "SELECT doc_id, CASE WHEN avg(\"end\" - start) < 200 THEN 'avg' WHEN min(\"end\" - start) < 30 THEN 'min' END AS too_small FROM fixed GROUP BY 1"),
    "answer_set_filter": sql(
        HEADED,
        questions("headed"),
        "known AS (SELECT DISTINCT sha256(text) AS f FROM headed)",
        "SELECT ans_end - ans_start > 150 AS skipped, count(*) AS items FROM questions q JOIN headed d USING (doc_id) JOIN known k ON k.f = sha256(d.text) GROUP BY 1",
    ),
    "doc_store_fifo": sql(PLAIN, "SELECT doc_id, doc_id AS seq FROM plain ORDER BY seq DESC LIMIT 5"),
    "prompt_assembly": sql(*HITS, f"SELECT h.question_id, h.doc_id, h.strategy, string_agg('[' || h.rank || ']' || {NL} || {strip('c.text')}, {NL} || {NL} ORDER BY h.rank) AS passages FROM hits h JOIN chunks c USING (doc_id, strategy, chunk_index) GROUP BY ALL"),
    "quote_filter": sql(PLAIN, "SELECT doc_id, CASE WHEN length(text) >= 3 THEN substr(text, 3, 20) ELSE '' END AS quotes FROM plain"),
}


def _starts(t: str, s: str) -> str:
    before = f"substr({t}, greatest({s} - 300, 0) + 1, least({s}, 300))"
    first = lstrip(f"substr({t}, {s} + 1, 3)")
    gap = f"substr({before}, length({rstrip(before)}) + 1)"
    alnum = r"\A[\p{L}\p{N}]\z"
    return f"""CASE WHEN {s} <= 0 THEN false WHEN {has(f'substr({t}, {s}, 1)', alnum)} AND {has(f'substr({t}, {s} + 1, 1)', alnum)} THEN true WHEN {rstrip(before)} = '' THEN false
  WHEN contains({gap}, {NL} || {NL}) OR {has(rstrip(before), P.SENTENCE_END)} THEN false WHEN {has(f'substr({t}, {s} + 1, 4)', P.BULLET)} OR left({first}, 1) IN ('', '•', '▪', '◦') THEN false
  WHEN contains({gap}, {NL}) AND regexp_matches({first}, '\\A\\p{{Lu}}') THEN false ELSE true END"""


def _stops(t: str, e: str) -> str:
    body, after = rstrip(f"substr({t}, 1, {e})"), f"substr({t}, {e} + 1, 300)"
    rest = lstrip(after)
    gap = f"(left({after}, length({after}) - length({rest})) || substr({t}, length({body}) + 1, {e} - length({body})))"
    alnum = r"\A[\p{L}\p{N}]\z"
    return f"""CASE WHEN {e} >= length({t}) THEN false WHEN {has(f'substr({t}, {e}, 1)', alnum)} AND {has(f'substr({t}, {e} + 1, 1)', alnum)} THEN true WHEN {body} = '' OR {has(body, P.SENTENCE_END)} THEN false
  WHEN {rest} = '' THEN false WHEN contains({gap}, {NL} || {NL}) THEN false WHEN contains({gap}, {NL}) AND (regexp_matches({rest}, '\\A\\p{{Lu}}') OR {has(f'left({rest}, 4)', P.BULLET)}) THEN false ELSE true END"""


_NUMS = f"len(list_filter({find('{0}', P.NUMBERS)}, lambda w: NOT regexp_matches(w, '\\A\\p{{L}}')))"
_LABELS = f"len(list_filter({find('{0}', P.LABELS)}, lambda w: lower(w) NOT IN {listed(P.NOT_LABELS)}))"
_UNITS = f"""(list_bool_or(list_transform(list_zip({find('lower({0})', P.UNIT_TOKENS)}, list_append({find('lower({0})', P.UNIT_TOKENS)}[2:], '')), lambda p: {has('p[1]', P.NUMBER_TOKEN)} AND (regexp_replace(coalesce(p[2], ''), '\\.+\\z', '') IN {listed(P.UNITS)} OR ends_with(p[1], '%'))))
  AND len(list_filter({find('{0}', P.NOT_WS + '+')}, lambda w: {has('w', P.PLAIN_WORD)})) >= 3 AND {has('{0}', P.SENTENCE_END)})"""


def _per_line(template: str, c: str) -> str:
    return template.replace("{0}", c)


_MASK = f"regexp_replace({strip('t')}, {q('(?i)' + P.DATES)}, 'date', 'g')"
_SPAN_ROWS = (SPACED, fixed("spaced", 300, 50, "tiny"), 'spans AS (SELECT doc_id, d.text AS text, f.start, f."end" FROM tiny f JOIN spaced d USING (doc_id))')
_JUDGED = f"""judged AS (SELECT *, {_per_line(_NUMS, 'm')} AS n, {_per_line(_LABELS, 'm')} AS w, coalesce({_per_line(_UNITS, 'm')}, false) AS u FROM masked)"""
_BARE = "NOT u AND ((n >= 2 AND w < n) OR (n = 1 AND w = 0))"

ORACLE |= {
    "flag_starts_mid": sql(*_SPAN_ROWS, f"SELECT doc_id, start, {_starts('text', 'start')} AS flag FROM spans"),
    "flag_ends_mid": sql(*_SPAN_ROWS, f'SELECT doc_id, "end", {_stops("text", chr(34) + "end" + chr(34))} AS flag FROM spans'),
    "flag_short": sql(*_SPAN_ROWS, 'SELECT doc_id, start, "end" - start < 100 AS flag FROM spans'),
    "flag_unlabeled_numbers": sql(
        PLAIN,
        f"rows_ AS (SELECT doc_id, i - 1 AS i, s[i] AS t FROM (SELECT doc_id, string_split(substr(text, 1, length(text) - 1), {NL}) AS s FROM plain), unnest(range(1, len(s) + 1)) x(i))",
        f"masked AS (SELECT *, {_MASK} AS m FROM rows_)",
        _JUDGED,
        f"SELECT doc_id, CAST(i AS INTEGER) AS i, CAST({_per_line(_NUMS, 't')} AS INTEGER) AS numbers, CAST({_per_line(_LABELS, 't')} AS INTEGER) AS labels, coalesce({_per_line(_UNITS, 't')}, false) AS units, ({_BARE}) AND m <> '' AS flag FROM judged",
    ),
    "chunk_flags": sql(
        *_SPAN_ROWS,
        f"""cut_ AS (SELECT doc_id, start, s[i] AS t, i FROM (SELECT doc_id, start, string_split(substr(text, start + 1, "end" - start), {NL}) AS s FROM spans), unnest(range(1, len(s) + 1)) x(i) WHERE {has('s[i]', P.NOT_WS)})""",
        f"masked AS (SELECT *, {_MASK} AS m FROM cut_)",
        _JUDGED,
        f"""headed_ AS (SELECT *, coalesce(bool_or(w >= 2 AND n = 0 AND NOT ends_with(m, '.')) OVER (PARTITION BY doc_id, start ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS labelled FROM judged)""",
        f"numbers_ AS (SELECT doc_id, start, bool_or({_BARE} AND NOT labelled) AS bare FROM headed_ GROUP BY ALL)",
        f"""SELECT s.doc_id, s.start, concat_ws('|', CASE WHEN {_starts('s.text', 's.start')} THEN 'starts_mid_sentence' END, CASE WHEN {_stops('s.text', 's."end"')} THEN 'ends_mid_sentence' END,
  CASE WHEN s."end" - s.start < 100 THEN 'short' END, CASE WHEN n.bare THEN 'unlabeled_numbers' END) AS flags FROM spans s LEFT JOIN numbers_ n USING (doc_id, start)""",
    ),
}

_PROMPTS = f"""prompts AS (SELECT h.question_id, h.doc_id, h.strategy, string_agg('[' || h.rank || ']' || {NL} || {strip('c.text')}, {NL} || {NL} ORDER BY h.rank) AS passages FROM hits h JOIN chunks c USING (doc_id, strategy, chunk_index) GROUP BY ALL),
said_ AS (SELECT *, {strip("substr(passages, instr(passages, ']' || chr(10)) + 2)")} AS body FROM prompts),
answers AS (SELECT question_id, doc_id, strategy, CASE WHEN body <> '' THEN left(split_part(body, '. ', 1), 200) END AS text, body = '' AS refused, false AS truncated FROM said_)"""
_LAST = "substr(d.text, h.start + 1, h.\"end\" - h.start)"
ORACLE |= {
    "generated_answers": sql(*HITS, _PROMPTS, "SELECT * FROM answers"),
    "comparable_answers": sql(
        *HITS,
        _PROMPTS,
        """SELECT question_id, doc_id, max(text) FILTER (WHERE strategy = 'fixed') AS fixed, max(text) FILTER (WHERE strategy = 'paragraph') AS paragraph, max(text) FILTER (WHERE strategy = 'section') AS section
  FROM answers GROUP BY ALL HAVING count(*) FILTER (WHERE coalesce(text, '') <> '') = 3""",
    ),
    "result_cards": sql(
        *HITS,
        f"""cut_ AS (SELECT question_id, doc_id, strategy, rank, s[i] AS t, i FROM (SELECT h.question_id, h.doc_id, h.strategy, h.rank, string_split({_LAST}, {NL}) AS s FROM hits h JOIN headed d USING (doc_id)), unnest(range(1, len(s) + 1)) x(i) WHERE {has('s[i]', P.NOT_WS)})""",
        f"masked AS (SELECT *, {_MASK} AS m FROM cut_)",
        _JUDGED,
        "headed_ AS (SELECT *, coalesce(bool_or(w >= 2 AND n = 0 AND NOT ends_with(m, '.')) OVER (PARTITION BY question_id, doc_id, strategy, rank ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS labelled FROM judged)",
        f"numbers_ AS (SELECT question_id, doc_id, strategy, rank, bool_or({_BARE} AND NOT labelled) AS bare FROM headed_ GROUP BY ALL)",
        'firsts_ AS (SELECT h.*, array_to_string(t.path, \' > \') AS section FROM hits h ASOF LEFT JOIN tree t ON t.doc_id = h.doc_id AND h.start >= t.pos_)',
        'lasts_ AS (SELECT h.*, array_to_string(t.path, \' > \') AS section_end FROM (SELECT *, "end" - 1 AS last FROM firsts_) h ASOF LEFT JOIN tree t ON t.doc_id = h.doc_id AND h.last >= t.pos_)',
        f"""SELECT h.question_id, h.doc_id, h.strategy, h.rank, CAST(len({find('c.text', P.NOT_WS + '+')}) AS INTEGER) AS tokens, len({find('c.text', P.NOT_WS + '+')}) > 256 AS truncated, coalesce(section, '') AS section, coalesce(section_end, '') AS section_end,
  concat_ws('|', CASE WHEN {_starts('d.text', 'h.start')} THEN 'starts_mid_sentence' END, CASE WHEN {_stops('d.text', 'h."end"')} THEN 'ends_mid_sentence' END, CASE WHEN h."end" - h.start < 100 THEN 'short' END, CASE WHEN n.bare THEN 'unlabeled_numbers' END) AS flags
  FROM lasts_ h JOIN chunks c USING (doc_id, strategy, chunk_index) JOIN headed d ON d.doc_id = h.doc_id LEFT JOIN numbers_ n ON n.question_id = h.question_id AND n.doc_id = h.doc_id AND n.strategy = h.strategy AND n.rank = h.rank""",
    ),
}

_LONE = f"(regexp_matches(s, '\\A\\p{{Lu}}') AND length(s) <= 70)"


def _data(ws: str) -> str:
    """Whether words are a table row's: two or more numbers, or one that is exact."""
    numbers = f"list_filter({ws}, lambda w: regexp_matches(w, {q(P.NUMERIC)}))"
    return f"(len({numbers}) >= 2 OR len(list_filter({numbers}, lambda w: regexp_matches(w, {q(P.EXACT_NUMBER)}))) > 0)"


#: A line that would be a heading by itself, between blank lines.
_LIKE_A_HEADING = f"""(length(s) BETWEEN 1 AND 100 AND ({has('s', P.MARKDOWN)} OR {has('s', P.DASHED)}
  OR ({has('s', P.NUMBERED)} AND NOT regexp_matches(s, '[.,;:]\\z') AND len(ws) <= 12 AND NOT {_data('ws[2:]')})
  OR (upper(s) = s AND len(ws) <= 8 AND len(regexp_extract_all(s, '\\p{{L}}')) >= 3 AND NOT regexp_matches(s, '[.,;]\\z') AND NOT {_data('ws')})
  OR ({_LONE} AND s LIKE '%?') OR ({_LONE} AND len(ws) <= 9 AND NOT regexp_matches(s, '[.,;:!?]\\z') AND NOT regexp_matches(s, '\\A[-*•\\p{{Nd}}]') AND NOT {_data('ws')})))"""
ORACLE |= {
    "fragment_headings": sql(
        *_SMALL,
        FRAGMENTS,
        f"""said_ AS (SELECT f.question_id, f.doc_id, f.strategy, f.start, {strip('substr(d.text, f.start + 1, f."end" - f.start)')} AS s FROM fragments f JOIN headed d USING (doc_id))""",
        "at_ AS (SELECT s.*, t.path FROM said_ s ASOF LEFT JOIN (SELECT doc_id, pos_, path FROM tree) t ON s.doc_id = t.doc_id AND s.start >= t.pos_)",
        f"titled AS (SELECT *, {strip(f'regexp_replace(s, {q(chr(92) + "A#{1,6}" + P.WS + "+")}, ' + chr(39) * 2 + ')')} AS title, {find('s', P.NOT_WS + '+')} AS ws FROM at_)",
        f"SELECT question_id, doc_id, strategy, start, CASE WHEN NOT contains(s, {NL}) AND (starts_with(s, '#') OR coalesce(list_contains(path, title), false) OR {_LIKE_A_HEADING}) THEN title END AS heading FROM titled",
    ),
}

#: Headings of corpora.OPENINGS, and their paths, worked out by hand from the rules. A part without a heading comes first where a text doesn't begin with one.
GUESSED = (
    ("Field Manual", "SAFETY RULES", "SAFETY RULES > Setting Up", "SAFETY RULES > Setting Up > First Steps"),
    ("", "Real Subheading"),
    ("", "How should I store it?", "What else is there?"),
    ("Plain Title", "2.1 Doses", "2.1 Doses > Data", "2.1 Doses > Data > Animal Data"),
    ("3 Harm", "3 Harm > 3.1 Trials", "3 Harm > 3.1 Trials > Patient Information"),
    ("", "Closing Words"),
)
_GUESSED_ROWS = ", ".join(
    f"({k}, {no}, {'NULL' if not path else C.OPENINGS[k].index(chr(10) + path.split(' > ')[-1] + chr(10)) + 1 if no else 0}, '{path}')" for k, paths in enumerate(GUESSED) for no, path in enumerate(paths)
)
ORACLE["guessed_headings"] = f"""SELECT d.doc_id, CAST(g.section_no AS INTEGER) AS section_no, CAST(g.header_start AS INTEGER) AS header_start, g.path
FROM documents d JOIN (VALUES {_GUESSED_ROWS}) g(k, section_no, header_start, path) ON d.doc_id % {len(C.OPENINGS)} = g.k"""

ORACLE["compared_answers"] = sql(
    *HITS,
    _PROMPTS,
    "three AS (SELECT question_id, doc_id, max(text) FILTER (WHERE strategy = 'fixed') AS f, max(text) FILTER (WHERE strategy = 'paragraph') AS p, max(text) FILTER (WHERE strategy = 'section') AS s FROM answers GROUP BY ALL HAVING count(*) FILTER (WHERE coalesce(text, '') <> '') = 3)",
    "SELECT question_id, doc_id, f = p AND p = s AS agree, CASE WHEN f = p AND p = s THEN 'equal' ELSE 'different' END AS summary, left(f, 20) AS quoted_fixed, left(p, 20) AS quoted_paragraph, left(s, 20) AS quoted_section, 200 AS status FROM three",
)
