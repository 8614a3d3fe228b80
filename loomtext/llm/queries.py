"""One query for each operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, minhash, mixing, quality_fm, quality_rules, recompress, secrets, sharding, tokencount, warc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "complete")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompress.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# The parts of operators' results that SQL can express, each from its operator over the whole table.


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums of op1."""
    return op1_sharding(spark, sf_dir).select("doc_id", "size", "text_crc32")


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law of op1: rows, bytes, shards without a gap, bytes as near to equal as the longest text allows."""
    placed = op1_sharding(spark, sf_dir).select("size", "shard", "slot")
    per = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.max("size").alias("most"))
    return per.agg(F.sum("n").alias("rows"), F.sum("b").alias("bytes"), F.count_if((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("gapless"), (F.max("b") - F.min("b") <= 2 * F.max("most")).alias("even"))


def shard_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of op1 by size and checksum: how many rows each has, in how many shards."""
    return op1_sharding(spark, sf_dir).groupBy("size", "text_crc32").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("shards"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of op2."""
    return op2_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and rounded targets of op6."""
    return op6_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target").cast("long").alias("target"))


def mix_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's taken words of op6 come within a hundredth, or 64 words, of its target, and no text beyond twice its size."""
    rows = op6_source_mixing(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    near = F.abs(F.sum("taken") - F.max("target")) <= F.greatest(F.max("target") / 100, F.lit(64.0))
    return rows.groupBy("source").agg(near.alias("near"), F.max(F.col("taken") > 2 * F.col("size")).alias("beyond"))


def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of op8's operator where tokens are bytes."""
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), None)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules of op10."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_secret_scans, op3_benchmark_decontamination, op4_minhash_near_dedup, op5_quality_classifier, op6_source_mixing, op7_substring_dedup, op8_token_counts, op9_warc, op10_quality_rules, shard_rows, shard_laws, shard_texts, secret_base, mix_targets, mix_taken, byte_tokens, quality_base)
}

#: CRC-32 by its table, which its rule makes, over the bytes of each text.
_CHECKSUMS = r"""
 WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents)
 SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM b, t"""

#: The others are tested against brute force: their rows depend on a sample, a hash, a model or an iteration that SQL
#: cannot express.
ORACLE_SQL = {
    "op4_minhash_near_dedup": r"""
 WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT g.b, c.root FROM c JOIN g ON g.a = c.doc_id AND c.root < g.b),
 m AS (SELECT doc_id, min(root) AS root FROM c GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, m.root = d.doc_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "shard_rows": _CHECKSUMS,
    "shard_texts": f"SELECT size, text_crc32, count(*) AS n, CAST(1 AS BIGINT) AS shards FROM ({_CHECKSUMS}) GROUP BY 1, 2",
    "shard_laws": "SELECT count(*) AS rows, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes, CAST(8 AS BIGINT) AS gapless, TRUE AS even FROM documents",
    "secret_base": r"""
 WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 k AS (SELECT * FROM (VALUES ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12), ('access', 1, '(AKIA[A-Z0-9]+)', 18), ('hex', 2, '([0-9a-f]+)', 16)) v(kind, nth, pattern, least)),
 f AS (SELECT r, kind, nth, least, regexp_extract_all(t, pattern) AS m, regexp_extract_all(t, pattern, 1) AS g, string_split_regex(t, pattern) AS s FROM d, k),
 x AS (SELECT r, kind, nth, i, len(m[i]) AS n, len(g[i]) AS gn, least, len(s[i]) AS before FROM f, unnest(range(1, len(m) + 1)) u(i)),
 y AS (SELECT r, kind, nth, gn, least, n, sum(before + n) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM x),
 z AS (SELECT r, kind, nth, CAST(stop - n AS BIGINT) AS a, CAST(stop AS BIGINT) AS b FROM y WHERE gn >= least),
 j AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth) AS spans FROM z GROUP BY 1)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN j USING (r)""",
    "mix_targets": r"""
 WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY 1),
 o AS (SELECT *, row_number() OVER (ORDER BY w / source_size DESC, source NULLS LAST) AS i, (SELECT sum(source_size) FROM s) * 1.5 AS total FROM s WHERE source_size > 0),
 u AS (SELECT *, (total - 2 * coalesce(sum(source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM o),
 q AS (SELECT min(i) AS i FROM u WHERE unit * w <= 2 * source_size),
 g AS (SELECT source, CASE WHEN q.i IS NULL OR u.i < q.i THEN 2.0 * source_size ELSE w * (SELECT unit FROM u x WHERE x.i = q.i) END AS target FROM u, q)
 SELECT doc_id, size, source_size, CAST(round(coalesce(target, 0)) AS BIGINT) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source""",
    "mix_taken": "SELECT source, TRUE AS near, FALSE AS beyond FROM documents GROUP BY 1",
    "byte_tokens": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_tokens FROM documents",
    "quality_base": r"""
 WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
 dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS k FROM win) WHERE k > 1),
 rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY 1),
 lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
   len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM dup)),
        each AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT each.r, count(*) AS n, string_agg(x, ' ' ORDER BY each.p) AS t FROM each LEFT JOIN gone ON each.r = gone.r AND each.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.r = kept.r""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN p.n >= 100 AND p.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.n >= 100 AND p.page_id <> f.first THEN f.first END AS refers_to, TRUE AS valid
        FROM p LEFT JOIN f ON p.d = f.d""",
}
