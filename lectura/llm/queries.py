"""Registered queries of the operators in this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, exact_dedup, factors, fill_middle, mixing, neighbours, packing, pages, quality, secrets, sharding, simhash, token_files,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str = ""):
    def add(make):
        QUERIES[make.__name__] = make
        if oracle:
            ORACLES[make.__name__] = oracle
        return make
    return add


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
    FROM documents
), g AS (
    SELECT *, count(*) OVER (PARTITION BY sha) AS group_size,
           first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS keep_id
    FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256, n AS n_points FROM g
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query(r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM d GROUP BY source
), fill(source, source_size, w, clamped, round) AS (
    SELECT source, source_size, w, false, 0 FROM s
    UNION ALL
    SELECT source, source_size, w, clamped OR share > 3 * source_size, round + 1
    FROM (
        SELECT *, w * ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (clamped) OVER (), 0))
                       / CAST(sum(w) FILTER (NOT clamped) OVER () AS DOUBLE)) AS share,
               count(*) OVER () AS n
        FROM fill
    ) WHERE round < n
), shares AS (
    SELECT source, source_size,
           CASE WHEN clamped THEN CAST(3 * source_size AS DOUBLE)
                ELSE w * ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (clamped) OVER (), 0))
                          / CAST(sum(w) FILTER (NOT clamped) OVER () AS DOUBLE)) END AS target
    FROM fill WHERE round = (SELECT max(round) FROM fill)
), t AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM shares
), p AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, t.whole,
           CAST(floor(t.target + 0.5) AS BIGINT) - t.whole * t.source_size AS rest,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), m AS (
    SELECT *, CAST(greatest(0, least(size, rest - before)) AS BIGINT) AS more FROM p
)
SELECT doc_id, size, source_size, target, CAST(size * whole + more AS BIGINT) AS taken,
       CAST(whole + CASE WHEN more > 0 AND more * 2 >= size THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM m
""")
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query()
def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query()
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query()
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.select_documents(docs, labels).select("doc_id", "expected_grade", "tail_1", "tail_2", F.lit(True).alias("kept"))


@query()
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), every=50)


@query()
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def _centroid_rounds(rounds: int) -> str:
    """CTEs c1, c2, ... of the centroids after each round, from c0."""
    return ",\n".join(f"""a{k} AS MATERIALIZED (
    SELECT vec_id, v, c, d FROM (
        SELECT vec_id, v, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM (
            SELECT k.vec_id, k.v, c.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS d
            FROM kept k, c{k} c)) WHERE r = 1
), c{k + 1} AS MATERIALIZED (
    SELECT c0.c, coalesce(m.v, c0.v) AS v FROM c{k} c0 LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
            SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
            FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY c, i) GROUP BY c) m ON m.c = c0.c
)""" for k in range(rounds))


@query(f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS c, v
    FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 40)
), {_centroid_rounds(5)}, last AS (
    SELECT vec_id, c, d, sha256(list_aggregate(v5, 'string_agg', ',')) AS sha FROM (
        SELECT vec_id, c, d, v5, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM (
            SELECT k.vec_id, c.c, c.v AS v5, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS d
            FROM kept k, c5 c)) WHERE r = 1
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM last
""")
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query(r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20
), k AS (
    SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS words FROM s
), r AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY words ORDER BY doc_id, p) AS nr FROM k
), gone AS (
    SELECT doc_id, list(DISTINCT p) AS gone
    FROM (SELECT doc_id, unnest(range(p, p + 20)) AS p FROM r WHERE nr > 1) GROUP BY doc_id
), j AS (
    SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p))), ' ')) AS kept_sha256
FROM j
""")
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = factors.remove_repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), x AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS p, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS q,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), c AS (
    SELECT doc_id, text, n, form, array_to_string(list_slice(u, 1, least(p, q)), '') AS prefix,
           array_to_string(list_slice(u, least(p, q) + 1, greatest(p, q)), '') AS middle,
           array_to_string(list_slice(u, greatest(p, q) + 1, n), '') AS suffix
    FROM x
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
""")
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.rearrange(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))
