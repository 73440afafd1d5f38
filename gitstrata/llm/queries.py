"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitstrata.llm import (
    dart_minhash,
    divergence_audit,
    hidden_markov,
    license_scan,
    period_runs,
    pfair_mix,
    prefix_tokens,
    quality_rules,
    repeated_windows,
    support_vectors,
    template_windows,
    token_shards,
    uniform_shards,
)
from gitstrata.llm.store import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents that speak of a licence."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op3_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return uniform_shards.shuffle(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return dart_minhash.report(table(spark, sf_dir, "documents"))


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' places in a mixture of the sources by the square root of their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix.mix(docs)


def op6_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 50-word windows of earlier documents."""
    return repeated_windows.removals(table(spark, sf_dir, "documents")).drop("spans")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written to shards and read back through their index."""
    import public_tokenizers

    folder = token_shards.new_folder(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    manifest = token_shards.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_shards.read(manifest, folder).withColumnRenamed("key", "doc_id")


def op8_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return support_vectors.score(table(spark, sf_dir, "documents"), labels)


def op9_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found, word for word or with other values."""
    return template_windows.findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether the rules keep it."""
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, and the words without the repeats."""
    return period_runs.report(table(spark, sf_dir, "documents"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms each is fond of."""
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


def op13_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of the SentencePiece model, and decoded again."""
    import public_tokenizers

    return prefix_tokens.report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_hidden_markov, op3_uniform_shards, op4_dart_minhash, op5_pfair_mix,
        op6_repeated_windows, op7_token_shards, op8_support_vectors, op9_template_windows, op10_quality_rules,
        op11_period_runs, op12_divergence_audit, op13_prefix_tokens,
    )
}

ORACLE: dict[str, str] = {
    "op6_repeated_windows": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
        ), earliest AS (SELECT h, min(doc_id) AS e FROM windows GROUP BY h),
        gone AS (
            SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g
            FROM windows JOIN earliest USING (h) WHERE doc_id > e GROUP BY doc_id
        ), kept AS (
            SELECT d.doc_id, len(w) AS n, w, coalesce(g, []) AS g FROM d LEFT JOIN gone USING (doc_id)
        ), marked AS (
            SELECT doc_id, n, len(g) AS m, w, list_sort(list_filter(range(1, n + 1), lambda i: NOT list_contains(g, i))) AS left_over FROM kept
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed,
               sha256(array_to_string(list_transform(left_over, lambda i: w[i]), ' ')) AS kept_sha256
        FROM marked
    """,
    "op12_divergence_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
          regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT i, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
        cell AS (SELECT g.lang, g.source, kept.term, kept.total, coalesce(c.c, 0) AS c FROM g JOIN kept ON g.lang = kept.lang
          LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        sized AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, count(*) OVER (PARTITION BY lang, source) AS v,
          sum(total) OVER (PARTITION BY lang, source) AS ln FROM cell),
        p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v)::HUGEINT AS p,
          1 + (1000000000::HUGEINT * (total + 1)) // (ln + v)::HUGEINT AS q FROM sized),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        liked AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM liked))
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
    """,
}
