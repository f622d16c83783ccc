"""The queries opN_<name>, each over its whole table, and DuckDB SQL where SQL expresses them.

Learned models (4, 7 and the verdict of 10) have no SQL; the tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import jaccard, language, lm, mixing, packing, quality, secrets, substrings, vectors, warc
from factloom.llm.shared import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_grouped_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"))


def op2_chunked_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.learn(docs.where(~held))
    return language.predict(docs, model).withColumn("held_out", held)


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.class_lm(_table(spark, sf_dir, "documents"), language.held_out(F.col("doc_id"), 7, 2))


def op8_ownership_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents")).drop("span_list", "_key")


def op9_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(_table(spark, sf_dir, "embeddings"))


def op10_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules alone, without the field's verdict: what SQL can express of op10."""
    return quality.quality_rules(_table(spark, sf_dir, "documents")).drop("kept", "content_share")


QUERIES = {f.__name__: f for f in (op1_grouped_prefixes, op2_chunked_archives, op3_super_kmers, op4_language_filters, op5_length_buckets, op6_weighted_fair_mix, op7_class_bigrams, op8_ownership_scan, op9_branch_and_bound, op10_line_field, quality_counts)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _either_case(word: str) -> str:
    """A pattern of a word's ASCII letters in either case, and of no others."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _spans(kind: int, pattern: str, group: int, name: str) -> str:
    """Places of a pattern's matches: what was split off and matched before each adds up to its start."""
    return f"""SELECT r, source, {kind} AS kind, unnest(generate_series(1, len(m))) AS i, unnest(v) AS v,
  unnest([list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) FOR i IN generate_series(1, len(m))])::BIGINT AS a, unnest([length(x) FOR x IN m]) AS n
  FROM (SELECT r, source, regexp_extract_all(t, {name}) AS m, regexp_extract_all(t, {name}, {group}) AS v, regexp_split_to_array(t, {name}) AS p FROM (SELECT *, '{pattern}' AS {name} FROM docs)) WHERE len(m) > 0"""


_QUOTE = """["'']?"""
_ASSIGN = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key") + ")" + _QUOTE + r"\x20*[:=]\x20*" + _QUOTE + "([A-Za-z0-9+/_.=-]+)"


def _length_buckets(buckets: int, budget: int) -> str:
    """The dynamic programme, a common table for each further bucket, and the walk back along its cuts."""
    layers = ["c0 AS MATERIALIZED (SELECT j, c * len - s AS cost, -1::BIGINT AS cut FROM ends)"]
    for k in range(1, buckets):
        layers.append(f"""b{k} AS MATERIALIZED (
  SELECT e.j, min({{'v': coalesce(p.cost, 0) + (e.c - coalesce(i.c, 0)) * e.len - (e.s - coalesce(i.s, 0)), 'i': g.i}}) AS m
  FROM ends e, LATERAL (SELECT unnest(generate_series(0, e.j - 1)) AS i) g LEFT JOIN ends i ON i.j = g.i LEFT JOIN c{k - 1} p ON p.j = g.i GROUP BY e.j
), c{k} AS MATERIALIZED (SELECT j, least(cost, m.v) AS cost, CASE WHEN m.v < cost THEN m.i ELSE -1 END AS cut FROM c{k - 1} JOIN b{k} USING (j))""")
    cuts = " UNION ALL ".join(f"SELECT {k} AS k, j, cut FROM c{k}" for k in range(1, buckets))
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, len({WORDS})::BIGINT AS n_tokens, row_number() OVER () AS r FROM documents
), hist AS (SELECT n_tokens AS len, count(*) AS n FROM sized WHERE n_tokens > 0 GROUP BY ALL),
ends AS MATERIALIZED (SELECT len, row_number() OVER w AS j, (sum(n) OVER w)::BIGINT AS c, (sum(n * len) OVER w)::BIGINT AS s FROM hist WINDOW w AS (ORDER BY len)),
{", ".join(layers)},
cuts AS MATERIALIZED ({cuts}),
walk(k, j) AS (
  SELECT {buckets - 1}, (SELECT max(j) FROM ends) UNION ALL SELECT walk.k - 1, CASE WHEN cut >= 0 THEN cut ELSE walk.j END FROM walk JOIN cuts ON walk.k = cuts.k AND walk.j = cuts.j
), chosen AS (SELECT DISTINCT len FROM walk JOIN ends USING (j)),
placed AS (
  SELECT doc_id, n_tokens, (SELECT min(len) FROM chosen WHERE len >= n_tokens) AS bucket_len, r FROM sized
), queue AS (
  SELECT *, row_number() OVER (PARTITION BY bucket_len, n_tokens > 0 ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), doc_id NULLS LAST, n_tokens) - 1 AS x, greatest(1, {budget} // bucket_len) AS fits FROM placed
)
SELECT doc_id, n_tokens, CASE WHEN n_tokens > 0 THEN bucket_len END AS bucket_len, CASE WHEN n_tokens > 0 THEN x // fits END AS batch_id, CASE WHEN n_tokens > 0 THEN x % fits END AS place,
  CASE WHEN n_tokens > 0 THEN bucket_len - n_tokens END AS padding
FROM queue
"""


ORACLE_SQL = {
    "op1_grouped_prefixes": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]) END AS s FROM w
), e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets WHERE doc_id IS NOT NULL),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS x, a AS y FROM edges UNION SELECT x, b FROM reach JOIN edges ON y = a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id) AS component_id FROM sets
""",
    "op3_super_kmers": f"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w, row_number() OVER () AS r FROM documents),
g AS MATERIALIZED (SELECT r, unnest(generate_series(1, len(w) - 34)) AS i, unnest([md5(array_to_string(w[i:i + 34], ' ')) FOR i IN generate_series(1, len(w) - 34)]) AS h FROM w WHERE len(w) >= 35),
twice AS (SELECT r, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS i FROM twice, (SELECT unnest(generate_series(0, 34)) AS k)),
words AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM w),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
""",
    "op5_length_buckets": _length_buckets(packing.BUCKETS, packing.BUDGET),
    "op8_ownership_scan": f"""
WITH docs AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
base AS MATERIALIZED (
  SELECT * FROM ({_spans(0, _ASSIGN, 2, "p0")}) WHERE length(v) >= 6
  UNION ALL {_spans(1, "AKIA[A-Z0-9]{16,}", 0, "p1")} UNION ALL {_spans(2, "[0-9a-f]{24,}", 0, "p2")}
), more AS (
  SELECT * FROM ({_spans(3, "[A-Za-z0-9+/_=-]{20,}", 0, "p3")}) m
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND list_aggregate(string_split(v, ''), 'entropy') >= 3.5
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.a < m.a + m.n AND m.a < b.a + b.n)
), found AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM more),
held AS (SELECT v, count(DISTINCT [source]) AS owners FROM found GROUP BY v),
judged AS (SELECT found.*, owners < 4 AS live, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || a || ':' || (a + n) AS said FROM found JOIN held USING (v) WHERE kind < 3 OR owners < 4),
by_row AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(said, ',' ORDER BY a, kind, n) FILTER (kind < 3) AS base,
    string_agg(said, ',' ORDER BY a, kind, n) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN by_row USING (r)
""",
    "quality_counts": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS MATERIALIZED (SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN generate_series(1, len(w) - 2)]) AS g FROM d WHERE len(w) >= 3),
again AS (SELECT r, i FROM g JOIN (SELECT r, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (r, g)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
""",
    "op2_chunked_archives": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, row_number() OVER w AS nth, first(page_id) OVER w AS f FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND nth > 1 THEN f END AS refers_to
FROM f
""",
    "op9_branch_and_bound": """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op6_weighted_fair_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS o
  FROM documents
), rows_ AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY o, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS through FROM sized
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 AS place FROM sized GROUP BY source
), s1 AS (
  SELECT source, source_size, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM s0
), s2 AS (
  SELECT *, coalesce(sum(cap) OVER w, 0.0) AS cap0, coalesce(sum(weight) OVER w, 0.0) AS w0, (sum(source_size::DOUBLE) OVER ()) AS total, (sum(weight) OVER ()) AS weights
  FROM s1 WINDOW w AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (SELECT *, (total - cap0) / (weights - w0) AS own FROM s2),
s4 AS (SELECT arg_min(own, cap / weight) AS level FROM s3 WHERE own * weight <= cap),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM s3, s4),
copies AS (
  SELECT r.*, t.source_size, t.target, pass, (pass * t.source_size + r.through)::DOUBLE / t.target AS finish
  FROM rows_ r JOIN t ON r.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1, 2]) AS pass)
  WHERE r.size > 0 AND (pass * t.source_size + r.through - r.size)::DOUBLE < t.target
), queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, o, through, pass, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS spent FROM copies
), taken AS (
  SELECT doc_id, source, through, sum(size)::BIGINT AS taken FROM queue WHERE spent <= (SELECT sum(size) FROM sized) GROUP BY ALL
)
SELECT r.doc_id, r.size, r.source, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM rows_ r JOIN t ON r.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON r.doc_id IS NOT DISTINCT FROM k.doc_id AND r.source IS NOT DISTINCT FROM k.source AND r.through = k.through AND r.size > 0
""",
}
