"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import shared_dir, table
from .langid import identify
from .lm_scoring import score
from .media import decode, encode
from .mixing import mix
from .ngram_join import jaccard_join
from .packing import pack
from .quality import RULES, estimate, judged
from .ranking import TERM, build, search
from .secrets import BASE, scan
from .substring_dedup import dedup
from .warc import read_archives, write_archives
from .whitening import whiten


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return rows.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decode(encode(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).drop("text"))
    size = F.octet_length("payload")
    return rows.select(
        "doc_id",
        "n_bytes",
        size.cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint"), F.sha2(F.array_join(F.transform("fingerprint", lambda x: F.hex(x)), ","), 256)).alias("feature"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = judged(docs, [r for r, _, _ in estimate(docs)], always=counts)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc.doc_id", *counts, base.alias("base_failed"), F.col("failed").isNull().alias("kept"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


WORDS_SQL = r"[^\x20\x09-\x0D]+"
OP4_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS_SQL}')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::HUGEINT AS s, sum(size::HUGEINT * ((1024 * size) // (size + 64)))::DOUBLE AS mass FROM sized GROUP BY source
), named AS (
  SELECT *, 3 * s AS cap, ([5, 2, 1])[1 + (n - 1) % 3]::HUGEINT AS w
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM per)
), steps AS (
  SELECT *, sum(s) OVER () AS t, sum(w) OVER () AS sw, coalesce(sum(cap) OVER b, 0) AS cb, coalesce(sum(w) OVER b, 0) AS wb
  FROM named WINDOW b AS (ORDER BY cap::DOUBLE / w::DOUBLE, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fulls AS (
  SELECT *, cap::DOUBLE * (sw - wb)::DOUBLE <= (t - cb)::DOUBLE * w::DOUBLE AS f FROM steps
), targets AS (
  SELECT *, CASE WHEN f THEN cap::DOUBLE ELSE (t - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ())::DOUBLE * w::DOUBLE
    / (sw - sum(CASE WHEN f THEN w ELSE 0 END) OVER ())::DOUBLE END AS target FROM fulls
), plan AS (
  SELECT *, target - whole * s::DOUBLE AS rest
  FROM (SELECT *, CASE WHEN s > 0 THEN floor(target / s::DOUBLE)::BIGINT ELSE 0 END AS whole FROM targets)
), drawn AS (
  SELECT d.doc_id, d.size, d.source, p.s, p.target, p.whole, p.rest,
    (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    least(1.0::DOUBLE, ((1024 * d.size) // (d.size + 64))::DOUBLE * p.rest / p.mass) AS p
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), odds AS (
  SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM drawn
), ordered AS (
  SELECT *, coalesce(sum(CASE WHEN rest > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM odds
)
SELECT doc_id, size, s::BIGINT AS source_size, target,
  (size * (whole + CASE WHEN size > 0 AND rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""


OP1_SQL = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}') AS ws FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), owner AS (SELECT g, min(doc_id) AS o FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.i FROM win w JOIN owner USING (g) WHERE o < w.doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS spots FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(spots), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN spots IS NULL THEN ws ELSE [ws[j] FOR j IN range(1, len(ws) + 1) IF NOT list_contains(spots, j)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
OP8_SQL = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}') AS ws FROM documents),
t AS MATERIALIZED (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
c1 AS (SELECT w, count(*) AS n1 FROM t GROUP BY w),
cv AS (SELECT v, count(*) AS nv FROM t WHERE v IS NOT NULL GROUP BY v),
c2 AS (SELECT v, w, count(*) AS n2 FROM t WHERE v IS NOT NULL GROUP BY v, w),
s AS (
  SELECT t.doc_id, (t.v IS NOT NULL AND n2 < 2)::INT AS back,
    CASE WHEN t.v IS NULL THEN ln(n1 / (SELECT count(*) FROM t)) WHEN n2 >= 2 THEN ln(n2 / nv) ELSE ln(0.4::DOUBLE) + ln(n1 / (SELECT count(*) FROM t)) END AS p
  FROM t JOIN c1 ON c1.w = t.w LEFT JOIN cv ON cv.v = t.v LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(b, 0)::BIGINT AS n_backoff, round(p / len(ws), 6) AS score
FROM w LEFT JOIN (SELECT doc_id, sum(back) AS b, sum(p) AS p FROM s GROUP BY doc_id) USING (doc_id)
"""
OP5_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_SQL}') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), c AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
k AS (SELECT k, min(doc_id) AS class_id FROM c GROUP BY k),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN c ca ON ca.doc_id = p.a JOIN c cb ON cb.doc_id = p.b WHERE 100 * m >= 75 * (ca.n + cb.n - m)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
  coalesce(k.class_id, w.doc_id) AS class_id, coalesce(f.n, 0)::BIGINT AS n_links
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.k = c.k LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = w.doc_id
  LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) f ON f.a = w.doc_id
"""
#: Spans from the matches' lengths and those of the texts between them; a mark that no text has stands for a match.
_OP3_KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""len(regexp_replace(m, '^[^:=]*[:=]\x20*["'']?', '')) >= 8"""),
    ("access", "AKIA[A-Z0-9]+", "len(m) >= 16"),
    ("hex", "[0-9a-f]+", "len(m) >= 32"),
    ("github", "gh[pousr]_[A-Za-z0-9]+", "len(m) >= 40"),
    ("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----(((Proc-Type|DEK-Info):[A-Za-z0-9,\x20-]+|[A-Za-z0-9+/=\\\x09\x0A\x0D\x20])*-----END\x20([A-Z]+\x20)*PRIVATE\x20KEY-----)?", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "len(m) >= 36"),
]


def _op3_spans(nth: int, kind: str, pattern: str, kept: str) -> str:
    found = f"regexp_extract_all(t, '{pattern}')"
    gaps = f"list_transform(string_split(regexp_replace(t, '{pattern}', chr(57344), 'g'), chr(57344)), lambda x: len(x))"
    return f"""(SELECT list({{'a': a, 'k': {nth}, 'e': a + len(m), 'kind': '{kind}'}}) FROM (
      SELECT m, coalesce(list_sum(g[:i]), 0)::BIGINT + coalesce(list_sum(list_transform(f[:i - 1], lambda x: len(x))), 0)::BIGINT AS a
      FROM (SELECT unnest(f) AS m, unnest(range(1, len(f) + 1)) AS i, f, g FROM (SELECT {found} AS f, {gaps} AS g))) WHERE {kept})"""


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_sort(list_concat({", ".join(f"coalesce({_op3_spans(n, *k)}, [])" for n, k in enumerate(_OP3_KINDS))})) AS s FROM d)
SELECT doc_id, {", ".join(f"len(list_filter(s, lambda x: x.kind = '{k}'))::BIGINT AS n_{k}" for k in BASE)},
  sha256(array_to_string(list_transform(list_filter(s, lambda x: x.k < {len(BASE)}), lambda x: concat(x.kind, ':', x.a, ':', x.e)), ',')) AS base_sha256,
  coalesce(array_to_string(list_transform(s, lambda x: concat(x.kind, ':', x.a, ':', x.e)), ','), '') AS spans
FROM s
"""
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH t AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '{TERM}')) AS term FROM documents),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM d, c),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
WHERE rank <= 10
"""
OP12_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, t, regexp_extract_all(t, '{WORDS_SQL}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS_SQL}')) AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (
  SELECT doc_id, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
    (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[ 	]*[-*•●▪]'))) AS n_bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ 	-
]*$'))) AS n_ellipses
  FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT ({" OR ".join(f"({rule.rejects})" for rule in RULES)}) AS kept
FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_warc_archive, op3_secret_scan, op4_mix_sources, op5_ngram_jaccard, op6_nearest_neighbours, op7_language_id, op8_lm_scoring, op9_best_fit_packing, op10_media_columns, op11_ranked_search, op12_quality_rules, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_warc_archive": OP2_SQL, "op3_secret_scan": OP3_SQL, "op4_mix_sources": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op8_lm_scoring": OP8_SQL, "op11_ranked_search": OP11_SQL, "op12_quality_rules": OP12_SQL}
