"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import url_filter
from tidemark.llm.quality_rules import PERCENTS, PRIOR, RULES

_SPACE = r"[^\x20\x09-\x0D]+"


def _quality_rules() -> str:
    """Words by regular expression, windows by unnesting; fences from the same integer buckets, level by level."""
    values = ", ".join(f"({i}, CASE WHEN {r.bottom} > 0 THEN (1000 * {r.top}) // {r.bottom} ELSE 0 END)" for i, r in enumerate(RULES))
    high = "CASE v.rule " + " ".join(f"WHEN {i} THEN {r.high}" for i, r in enumerate(RULES)) + " END"
    low = "CASE v.rule " + " ".join(f"WHEN {i} THEN {r.low}" for i, r in enumerate(RULES) if r.low is not None) + " END"
    mean = lambda i, p, parent: f"coalesce((l{i}.total * l{i}.q{p} + {PRIOR} * {parent}) // (l{i}.total + {PRIOR}), {parent})"
    shrunk = lambda p: mean(0, p, mean(1, p, f"l2.q{p}"))
    names = "CASE rule " + " ".join(f"WHEN {i} THEN '{r.name}'" for i, r in enumerate(RULES)) + " END"

    def level(i: int, keys: str) -> str:
        by = keys + ", " if keys else ""
        quantiles = ", ".join(f"min(CASE WHEN upto * 100 >= total * {p} THEN {'low' if p < 50 else 'high'} END) AS q{p}" for p in PERCENTS)
        return f"""l{i} AS (
  SELECT {by}rule, max(total) AS total, {quantiles}
  FROM (SELECT {by}rule, low, high, sum(n) OVER (PARTITION BY {by}rule ORDER BY low) AS upto, sum(n) OVER (PARTITION BY {by}rule) AS total
        FROM (SELECT {by}rule, low, high, count(*) AS n FROM buckets GROUP BY {by}rule, low, high))
  GROUP BY {by}rule)"""

    return f"""WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM base),
grams AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, word, w2, w3) AS n
  FROM (SELECT r, pos, word, lead(word) OVER x AS w2, lead(word, 2) OVER x AS w3 FROM words WINDOW x AS (PARTITION BY r ORDER BY pos))
  WHERE w3 IS NOT NULL),
repeated AS (SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(lines) AS line FROM base) WHERE regexp_matches(line, '{_SPACE}') GROUP BY r),
stats AS (
  SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM base LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)),
vals AS (SELECT r, lang, source, base_failed, x[1] AS rule, x[2] AS v FROM (SELECT *, unnest([{values}]) AS x FROM stats)),
buckets AS (
  SELECT lang, source, rule, (v >> shift) << shift AS low, (((v >> shift) + 1) << shift) - 1 AS high
  FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS shift FROM vals WHERE NOT base_failed)),
{level(0, "lang, source")},
{level(1, "lang")},
{level(2, "")},
judged AS (
  SELECT r, v.rule AS rule, v, {shrunk(90)} + ({high} * ({shrunk(99)} - {shrunk(90)})) // 8 AS hi, {shrunk(10)} - ({low} * ({shrunk(10)} - {shrunk(1)})) // 8 AS lo
  FROM vals v
  LEFT JOIN l0 ON l0.rule = v.rule AND l0.lang IS NOT DISTINCT FROM v.lang AND l0.source IS NOT DISTINCT FROM v.source
  LEFT JOIN l1 ON l1.rule = v.rule AND l1.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN l2 ON l2.rule = v.rule),
broken AS (SELECT r, string_agg({names}, ',' ORDER BY rule) AS broken FROM judged WHERE v > hi OR v < lo GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND broken IS NULL AS kept, coalesce(broken, '') AS broken
FROM stats LEFT JOIN broken USING (r)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(links: str) -> str:
    """``reach``: for each id of the ``links`` (a, b), in both directions, every id that it reaches."""
    return f"""reach AS (SELECT a, b FROM {links} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON l.a = r.b)"""


def _jaccard_join(k: int = 4, percent: int = 85) -> str:
    """Sets by unnesting, overlaps by a join on shingles."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id != y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= {percent} * (p.n + q.n - o)),
{_components("links")}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = d.doc_id"""


def _warc() -> str:
    group = "CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS INTEGER)"
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({group} >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != head THEN head END AS refers_to
FROM p"""


def _embeddings(threshold: float = 0.95) -> str:
    return f"""WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id != y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= {threshold}),
{_components("links")}
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) l ON l.a = vec_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = vec_id"""


def _suffix_dedup(length: int = 100) -> str:
    """All strings of ``length`` bytes by place; of equal ones all but the first, and what they cover."""
    gap = "substr(x, 2 * CASE WHEN i = 0 THEN 0 ELSE ee[i] END + 1, 2 * (CASE WHEN i = len(ss) THEN n ELSE ss[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE ee[i] END))"
    return f"""WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, md5(t[s + 1 : s + {length}]) AS k FROM (SELECT doc_id, unnest(range(n - {length - 1})) AS s, t FROM b WHERE n >= {length})),
late AS MATERIALIZED (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
turns AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {length}, true) AS new FROM late),
runs AS (SELECT doc_id, min(s) AS s, max(s) + {length} AS e FROM (SELECT doc_id, s, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM turns) GROUP BY doc_id, run),
cut AS (SELECT doc_id, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS ee, sum(e - s) AS gone FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(ss), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN ss IS NULL THEN x ELSE array_to_string(list_transform(range(len(ss) + 1), lambda i: {gap}), '') END)) AS kept_sha256
FROM (SELECT doc_id, hex(t) AS x, n FROM b) LEFT JOIN cut USING (doc_id)"""


def _url_filter() -> str:
    """Counts of characters after two, one and no others, per class; probabilities from the shorter context to the longer."""
    n, scale, step = url_filter.SYMBOLS, url_filter.SCALE, url_filter.STEP
    longest = sorted(url_filter.RULES, key=lambda r: -len(r.name))
    rule = "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in longest) + " END"
    allowed = "rule IN (" + ", ".join(f"'{r.name}'" for r in longest if r.verdict == "allow") + ")"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def model(k: str) -> str:
        p0 = f"(coalesce({k}0.n, 0) + 1.0::DOUBLE) / ((SELECT coalesce(sum({k}), 0) FROM counts) + {n})"
        p1 = f"CASE WHEN {k}1.n > 0 THEN (coalesce({k}1c.n, 0) + {k}1.t * {p0}) / ({k}1.n + {k}1.t) ELSE {p0} END"
        return f"CASE WHEN {k}2.n > 0 THEN (coalesce(counts.{k}, 0) + {k}2.t * {p1}) / ({k}2.n + {k}2.t) ELSE {p1} END"

    def tables(k: str) -> str:
        return f"""{k}2 AS (SELECT a, b, sum({k}) AS n, count(*) AS t FROM counts WHERE {k} > 0 GROUP BY a, b),
{k}1c AS (SELECT b, c, sum({k}) AS n FROM counts WHERE {k} > 0 GROUP BY b, c),
{k}1 AS (SELECT b, sum(n) AS n, count(*) AS t FROM {k}1c GROUP BY b),
{k}0 AS (SELECT c, sum({k}) AS n FROM counts GROUP BY c)"""

    joins = " ".join(f"LEFT JOIN {k}2 USING (a, b) LEFT JOIN {k}1c USING (b, c) LEFT JOIN {k}1 USING (b) LEFT JOIN {k}0 USING (c)" for k in ("yes", "no"))
    return f"""WITH parts AS (
  SELECT row_number() OVER () AS r, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT *, {rule} AS rule FROM (
    SELECT r, page_id, url, coalesce({lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts)),
j AS (SELECT *, CASE WHEN rule IS NOT NULL THEN {allowed} END AS accepted, substr(md5(url), 1, 1) IN ({", ".join(f"'{x}'" for x in url_filter.ASIDE)}) AS aside FROM u),
chars AS (
  SELECT r, i, CASE instr('{url_filter.ALPHABET}', ch) WHEN 0 THEN {n - 1} ELSE instr('{url_filter.ALPHABET}', ch) END AS c
  FROM (SELECT r, i, substr({lower.format("url")}, i, 1) AS ch FROM (SELECT r, url, unnest(range(1, length(url) + 1)) AS i FROM u))),
tri AS (SELECT r, coalesce(lag(c, 2) OVER o, 0) AS a, coalesce(lag(c) OVER o, 0) AS b, c FROM chars WINDOW o AS (PARTITION BY r ORDER BY i)),
counts AS (SELECT a, b, c, count(*) FILTER (accepted) AS yes, count(*) FILTER (NOT accepted) AS no FROM tri JOIN j USING (r) WHERE accepted IS NOT NULL AND NOT aside GROUP BY a, b, c),
{tables("yes")},
{tables("no")},
ratios AS (
  SELECT a, b, c, CASE WHEN (SELECT coalesce(sum(yes), 0) > 0 AND coalesce(sum(no), 0) > 0 FROM counts) THEN CAST(round(ln(({model("yes")}) / ({model("no")})) * {scale}) AS BIGINT) ELSE 0 END AS ratio
  FROM (SELECT DISTINCT a, b, c FROM tri) LEFT JOIN counts USING (a, b, c) {joins}),
scored AS (
  SELECT j.*, CAST(coalesce(floor(total / length(url)), 0) AS BIGINT) AS score
  FROM j LEFT JOIN (SELECT r, sum(ratio) AS total FROM tri JOIN ratios USING (a, b, c) GROUP BY r) USING (r)),
steps AS (SELECT CAST(floor(score / {step}) AS BIGINT) AS low, count(*) FILTER (accepted) AS yes, count(*) FILTER (NOT accepted) AS no FROM scored WHERE accepted IS NOT NULL AND aside GROUP BY 1),
cut AS (
  SELECT low, (SELECT sum(yes) FROM steps) AS y, (SELECT sum(no) FROM steps) AS n,
         coalesce(sum(no) OVER (ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no_below, coalesce(sum(yes) OVER (ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS yes_below FROM steps),
best AS (SELECT low FROM cut WHERE y > 0 AND n > 0 ORDER BY no_below * y - yes_below * n DESC, low LIMIT 1)
SELECT page_id, host, path, rule, CASE WHEN coalesce(accepted, score >= coalesce((SELECT low FROM best), 0) * {step}) THEN 'allow' ELSE 'block' END AS verdict, score FROM scored"""


SQL: dict[str, str] = {
    "op1_quality_rules": _quality_rules(),
    "op3_ngram_jaccard_join": _jaccard_join(),
    "op4_warc": _warc(),
    "op5_embedding_dedup": _embeddings(),
    "op7_suffix_dedup": _suffix_dedup(),
    "op9_url_filter": _url_filter(),
}
