"""Queries over the given tables, one for each operator of this subpackage, and SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import checks
from .audit import audit
from .decontamination import find_leaks
from .jaccard import jaccard_components
from .lines import recurring_lines, without_lines
from .minhash import near_duplicates
from .mixing import mix
from .pages import with_main_text
from .quality import fit, held_out, with_score
from .resampling import resample
from .rules import BASE, PROSE, cascade
from .secrets import find_secrets, labelled_samples, span_list, train
from .suffixes import without_repeats
from .warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over a folder of tables, with its checking SQL if there is one."""

    def register(build):
        QUERIES[name] = build
        if sql:
            CHECKS[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_decontamination")
def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = find_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query("op2_subword_quality")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels"))
    scored = with_score(docs, model, without=("text",))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op3_line_templates")
def _lines(spark: SparkSession, folder: str) -> DataFrame:
    found = recurring_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return without_lines(found, "text", "dropped").select(
        "doc_id",
        "text",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.expr("coalesce(array_join(dropped, ','), '')").alias("dropped_lines"),
    )


@query("op4_source_mix")
def _mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op5_main_text")
def _main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = with_main_text(table(spark, folder, "pages").select("page_id", "url", "html"), without=("html",))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op6_suffix_array")
def _suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents"))


@query(
    "op7_rule_cascade",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
        FROM documents
    ), runs AS (
        SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest([array_to_string(w[k:k + 7], ' ') FOR k IN range(1, len(w) - 6)]) AS s
        FROM d
    ), again AS (
        SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS times FROM runs) x, range(8) o(k)
        WHERE times > 1 GROUP BY r
    ), m AS (
        SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
            len(l) AS n_lines, len(regexp_extract_all(t, '\p{L}')) AS letters, len(regexp_extract_all(t, '\p{Lu}')) AS capitals
        FROM d LEFT JOIN again USING (r)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_symbols > 3 * n_words OR n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines
            OR letters >= 20 AND 10 * capitals > 6 * letters OR 10 * letters < 6 * word_chars) AS kept
    FROM m
    """,
)
def _rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = cascade(docs, BASE + PROSE, reported=measures, without=("text",))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select("doc_id", *measures, base.alias("base_failed"), "kept")


@query("op8_markov_secrets")
def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_secrets(docs, train(labelled_samples(docs)))
    base = ["assign", "access", "hex"]
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list([*base, "random"]).alias("spans"),
    )


@query("op9_order_minhash")
def _near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "kept")


@query(
    "op10_zstd_warc",
    """
    WITH r AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), f AS (
        SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM r
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
    FROM f
    """,
)
def _archives(spark: SparkSession, folder: str) -> DataFrame:
    read = archived(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_importance_resampling", checks.RESAMPLED)
def _resampled(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's weight and score towards the benchmark texts, and its place in the draw."""
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_filter_audit", checks.AUDITED)
def _audited(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes at each place of each of their orders, by source."""
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_jaccard_join")
def _jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's component under links of 90 per cent of their three-word shingles."""
    return jaccard_components(table(spark, folder, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
