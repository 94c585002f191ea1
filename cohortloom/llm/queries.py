"""The corpus operators bound to the given tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from . import (
    centroids, decontaminate, language_id, license_scan, mixing, near_dedup, ngram_lm, quality_rules, secret_scan, suffix_dedup,
    token_counts, vector_codes, warc,
)
from .common import bucket_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return register


#: Lower-casing of A-Z only, in SQL.
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_decontamination", rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT r, s, n, item_id FROM dwin JOIN win USING (n, k)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids
  FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN its USING (r)""")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a tokenizer is not SQL. Checked against encoding every text whole (tests/llm).

    A first run counts the contents of one half by digest, the second all documents against its cache.
    """
    docs, tokenizer, cache = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache")
    half = F.sha2(F.coalesce("text", F.lit("")), 256) < "8"
    token_counts.fill_cache(docs.where(half), tokenizer, cache)
    return token_counts.count_tokens(docs, tokenizer, cache).drop("content_digest")


@query("op9_warc", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (d)""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = warc.archive_pages(pages, scratch(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    records = warc.read_archives(spark, manifest, range_bytes=4 << 20, payload=False)
    return warc.verified(records, manifest, scratch(spark, "warc-records")).select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


@query("op10_near_duplicates", rf"""
WITH RECURSIVE dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT r, array_to_string(w[s : s + 1], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS s FROM dw WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
inter AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM sh a JOIN sh b ON a.k = b.k AND a.r <> b.r GROUP BY 1, 2),
link AS (
  SELECT x, y FROM inter JOIN size sx ON sx.r = x JOIN size sy ON sy.r = y WHERE 100 * i >= 80 * (sx.n + sy.n - i)),
reach AS (SELECT r, r AS t FROM dw UNION SELECT reach.r, link.y FROM reach JOIN link ON link.x = reach.t),
comp AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN dw d ON d.r = reach.t GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM dw JOIN comp USING (r) LEFT JOIN size USING (r)""")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Plan(words=2))
    return found.drop("text_key")


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the rules are learned. Checked against a brute-force version (tests/llm)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"s_{c}").alias(c) for c in names], "base_failed", "rule", "kept")


@query("op5_mixing", """
WITH d AS (
  SELECT *, coalesce(octet_length(encode(text)), 0) AS size, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key FROM documents),
sizes AS (SELECT source, sum(size) AS n FROM d GROUP BY source),
rates AS (
  SELECT source, mean, CAST(greatest(1, ceil(mean / 16)) AS INT) AS parts FROM (
    SELECT source, CASE WHEN n > 0 THEN sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) * (SELECT sum(n) FROM sizes) / n END AS mean FROM sizes)),
cdfs AS (
  SELECT source, parts, list_transform(range(0, 221), lambda k: CASE WHEN k = 220 THEN 1.0 ELSE
    list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(mean / parts) - mean / parts - lgamma(j + 1)))) END) AS cdf FROM rates),
draws AS (
  SELECT d.*, CASE WHEN cdf IS NULL THEN 1 ELSE list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda c:
    c < (CAST('0x' || substr(md5('mix:' || key || ':' || j), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)))) END AS copies
  FROM d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, CAST('0x' || substr(md5('mix:order:' || key || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy FROM draws)""")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the model is trained. Checked by held-out accuracy (tests/llm)."""
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of(F.col("doc_id"), 5) == 0
    model = language_id.fit(docs, ~held_out)
    out = language_id.identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


#: Discounts of a level from the numbers of n-grams seen once to four times, with the fallback.
KN_DISCOUNTS = """SELECT CASE WHEN ok THEN d1 ELSE 0.5 END AS d1, CASE WHEN ok THEN d2 ELSE 1.0 END AS d2, CASE WHEN ok THEN d3 ELSE 1.5 END AS d3
  FROM (SELECT *, coalesce(d1 > 0 AND d1 <= 1 AND d2 > 0 AND d2 <= 2 AND d3 > 0 AND d3 <= 3, FALSE) AS ok FROM (
    SELECT 1 - 2 * y * n2 / n1 AS d1, 2 - 3 * y * n3 / n2 AS d2, 3 - 4 * y * n4 / n3 AS d3 FROM (
      SELECT *, n1 / (n1 + 2 * n2) AS y FROM (SELECT nullif(count(*) FILTER (WHERE c = 1), 0) AS n1, nullif(count(*) FILTER (WHERE c = 2), 0) AS n2,
        nullif(count(*) FILTER (WHERE c = 3), 0) AS n3, nullif(count(*) FILTER (WHERE c = 4), 0) AS n4 FROM {0}))))"""


#: Statistics of a context, and the probability of a word after it from that of the next lower order.
KN_CONTEXT = """sum(c) AS total, count(*) FILTER (WHERE c = 1) AS n1, count(*) FILTER (WHERE c = 2) AS n2, count(*) FILTER (WHERE c >= 3) AS n3"""
KN_STEP = """CASE WHEN {c}.total IS NULL THEN {below} ELSE
    (coalesce({g}.c, 0) - CASE least(coalesce({g}.c, 0), 3) WHEN 0 THEN 0 WHEN 1 THEN {e}.d1 WHEN 2 THEN {e}.d2 ELSE {e}.d3 END) / {c}.total
      + ({e}.d1 * {c}.n1 + {e}.d2 * {c}.n2 + {e}.d3 * {c}.n3) / {c}.total * {below} END"""


@query("op1_language_model", rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, list_append(list_prepend(' start',
    regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')), ' end') AS w FROM documents),
crc AS (
  WITH RECURSIVE b AS (
    SELECT doc_id, CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents)
    UNION ALL
    SELECT doc_id, s, i + 1, xor(c8 >> 8, CAST(0 AS BIGINT)) FROM (
      SELECT doc_id, s, i, list_reduce(list_prepend(xor(c, CAST(ascii(s[i + 1]) AS BIGINT)), CAST(range(8) AS BIGINT[])),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END) << 8 AS c8 FROM b WHERE i < length(s)))
  SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) % 7 = 2 AS held FROM b WHERE i = length(s)),
docs AS (SELECT t.*, crc.held FROM t JOIN crc ON crc.doc_id IS NOT DISTINCT FROM t.doc_id),
tri AS (SELECT r, doc_id, held, coalesce(w[i - 1], ' start') AS z, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM docs)),
g3 AS MATERIALIZED (SELECT z, a, b, count(*) AS c FROM tri WHERE NOT held GROUP BY 1, 2, 3),
g2 AS MATERIALIZED (SELECT a, b, count(*) AS c FROM g3 GROUP BY 1, 2),
g1 AS (SELECT b, count(*) AS c FROM g2 GROUP BY 1),
uni AS (SELECT b AS w, count(*) AS c FROM tri WHERE NOT held GROUP BY 1),
c3 AS (SELECT z, a, {KN_CONTEXT} FROM g3 GROUP BY 1, 2),
c2 AS (SELECT a, {KN_CONTEXT} FROM g2 GROUP BY 1),
c1 AS (SELECT {KN_CONTEXT} FROM g1),
sz AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM uni),
e1 AS ({KN_DISCOUNTS.format("g1")}), e2 AS ({KN_DISCOUNTS.format("g2")}), e3 AS ({KN_DISCOUNTS.format("g3")}),
seen AS (SELECT DISTINCT z, a, b FROM tri),
p1 AS (SELECT x.b, {KN_STEP.format(g="g1", c="c1", e="e1", below="(1 / (v + 1))")} AS p
  FROM (SELECT DISTINCT b FROM seen) x LEFT JOIN g1 ON g1.b = x.b, c1, e1, sz),
p2 AS (SELECT x.a, x.b, {KN_STEP.format(g="g2", c="c2", e="e2", below="p1.p")} AS p
  FROM (SELECT DISTINCT a, b FROM seen) x JOIN p1 ON p1.b = x.b LEFT JOIN g2 ON g2.a = x.a AND g2.b = x.b LEFT JOIN c2 ON c2.a = x.a, e2),
p3 AS (SELECT x.z, x.a, x.b, {KN_STEP.format(g="g3", c="c3", e="e3", below="p2.p")} AS p
  FROM seen x JOIN p2 ON p2.a = x.a AND p2.b = x.b LEFT JOIN g3 ON g3.z = x.z AND g3.a = x.a AND g3.b = x.b LEFT JOIN c3 ON c3.z = x.z AND c3.a = x.a, e3),
prob AS (
  SELECT z, a, p3.b, coalesce(uni.c, 0) > 0 AS known, log10((coalesce(uni.c, 0) + 1) / (n + v + 1)) AS base, log10(p) AS lp, n
  FROM p3 LEFT JOIN uni ON uni.w = p3.b, sz)
SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, CAST(sum(known::INT) AS BIGINT) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       round(sum(base), 4) AS base_score, round(sum(lp), 4) AS score
FROM tri JOIN prob USING (z, a, b) GROUP BY r, doc_id""")
def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of(F.col("doc_id"), 7) == 2
    model = ngram_lm.fit(docs.where(~held_out), scratch(spark, "lm"), order=3)
    out = ngram_lm.score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    # Four places: engines that add thousands of logarithms in another order still agree.
    return out.drop("perplexity").withColumns({c: F.round(c, 4) for c in ("base_score", "score")})


@query("op4_repeated_bytes", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT r, doc_id, h, length(h) // 2 AS n FROM d),
win AS (
  SELECT r, p, hash(substr(h, 2 * p + 1, 400)) AS k
  FROM (SELECT r, h, unnest(range(0, n - 199)) AS p FROM n WHERE n >= 200)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p FROM win SEMI JOIN twice USING (k)),
island AS (
  SELECT r, p, sum(CASE WHEN p <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS g
  FROM (SELECT r, p, coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -1000) AS before FROM hit)),
gone AS (SELECT r, g, min(p) AS a, max(p) + 200 AS b FROM island GROUP BY r, g),
keep AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM gone
  UNION ALL SELECT gone.r, max(b), any_value(n.n) FROM gone JOIN n USING (r) GROUP BY gone.r),
rest AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM keep JOIN n USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest.h, n.h))) AS kept_sha256
FROM n LEFT JOIN rest USING (r) LEFT JOIN sums USING (r)""")
def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], digest=True)


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL. Checked against a brute-force version (tests/llm).

    Documents have no paths: they are laid out as source/lang/thousand/hundred/id.txt, and a text whose
    first line speaks of a licence is the licence file of source/lang/thousand.
    """
    docs = table(spark, sf_dir, "documents")
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).rlike("(?i)licen[cs]e")
    number = F.coalesce("doc_id", F.lit(-1))
    top = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(number / 1000).cast("string"))
    name = number.cast("string")
    path = F.when(first, F.concat(top, F.lit("/LICENSE-"), name)).otherwise(
        F.concat(top, F.lit("/"), F.floor(number / 100).cast("string"), F.lit("/"), name, F.lit(".txt")))
    found = license_scan.scan(docs.select(path.alias("path"), "text"))
    return found.withColumn("doc_id", F.regexp_extract("path", r"(-?[0-9]+)(\.txt)?$", 1).cast("bigint"))


#: Kept vectors of whole numbers, in SQL.
WHOLE_VECTORS = """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({0} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = 64)"""
#: Sum over a group divided by its rows, downwards.
FLOOR_MEAN = "CAST((sum({0}) - ((sum({0}) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def lloyd_sql(rounds: int, width: int, parts: int) -> str:
    """CTEs b0 to bN (p, k, c: entries by part) and a0 to aN (r, p, k, d: assignments); b0 and part (r, p, x) are given."""
    d = f"CAST(list_sum(list_transform(range(1, {width + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT)"
    out = []
    for t in range(rounds + 1):
        if t:
            out.append(f"""b{t} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(n.c, b.c) AS c FROM b{t - 1} b LEFT JOIN (
    SELECT p, k, list(m ORDER BY i) AS c FROM (
      SELECT p, k, i, {FLOOR_MEAN.format("x[i]")} AS m FROM a{t - 1} JOIN part USING (r, p), (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY p, k, i)
    GROUP BY p, k) n ON n.p = b.p AND n.k = b.k)""")
        out.append(f"""a{t} AS MATERIALIZED (
  SELECT r, p, m % 256 AS k, m // 256 AS d FROM (SELECT r, p, min({d} * 256 + k) AS m FROM part JOIN b{t} USING (p) GROUP BY r, p))""")
    return ",\n".join(out)


@query("op11_vector_codes", f"""
WITH {WHOLE_VECTORS.format(4096)},
part AS MATERIALIZED (SELECT r, p, v[8 * p + 1 : 8 * p + 8] AS x FROM kept, (SELECT unnest(range(8)) AS p)),
b0 AS MATERIALIZED (
  SELECT p, k, v[8 * p + 1 : 8 * p + 8] AS c FROM (SELECT v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS k FROM kept), (SELECT unnest(range(8)) AS p)
  WHERE k < 16),
{lloyd_sql(6, 8, 8)},
coded AS (
  SELECT r, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r),
books AS (SELECT sha256(string_agg(CAST(s AS VARCHAR), ',' ORDER BY p, k, i)) AS h FROM (SELECT p, k, unnest(range(1, 9)) AS i, unnest(c) AS s FROM b6))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), books""")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


@query("op12_centroids", f"""
WITH {WHOLE_VECTORS.format(64)},
part AS MATERIALIZED (SELECT r, 0 AS p, v AS x FROM kept),
b0 AS MATERIALIZED (
  SELECT 0 AS p, k, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS k FROM kept) WHERE k < 16),
{lloyd_sql(3, 64, 1)},
sums AS (SELECT k, CAST(sum(d) AS BIGINT) AS s, CAST(sum(sum(d)) OVER () AS BIGINT) AS total FROM a3 GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, s AS cluster_inertia, total AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a3 USING (r) JOIN sums USING (k) JOIN b3 USING (k)""")
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres, inertia = centroids.cluster(table(spark, sf_dir, "embeddings"))
    names = centroids.centre_digests(centres)
    return rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        F.get(F.array(*[F.lit(inertia.get(k, 0)).cast("bigint") for k in range(len(names))] or [F.lit(0).cast("bigint")]), "cluster").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        F.get(F.array(*[F.lit(n) for n in names] or [F.lit("")]), "cluster").alias("centroid_sha256"))


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: decoding and parsing keys is not SQL. Checked against a brute-force version and built keys (tests/llm)."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select(
        "doc_id", *[of(k) for k in secret_scan.BASE], F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secrets")).alias("spans"))
