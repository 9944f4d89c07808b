"""Registered queries of the text operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import (
    archives,
    byte_bpe,
    curve_packing,
    graded_quality,
    hard_negatives,
    language_model,
    periodic,
    pseudonyms,
    quality_votes,
    repeats,
    set_join,
    url_models,
    vector_join,
)
from tideline.llm.common import table
from tideline.session import materialize, scratch_path

#: A cluster passes its own secret to hide_private; the queries need a reproducible one.
QUERY_KEY = "tideline-query-key"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_url_models(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_models.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


@register
def op2_graded_quality(spark, sf_dir):
    """Grades from the labels: 0 poor, 1 good but toxic, 2 good and clean. Of several labels the worse counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rated = docs.join(labels, "doc_id").withColumn(
        "grade", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    )
    return graded_quality.classify(docs, rated).select("doc_id", "expected_grade", "tail", "kept")


@register
def op3_quality_votes(spark, sf_dir):
    """Counts and verdict per document; the measures are written once, as fitting and scoring both read them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = materialize(quality_votes.measure(docs).drop("text"), "votes")
    scored = quality_votes.score(measured, quality_votes.fit(measured))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@register
def op4_set_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return set_join.near_duplicates(docs, shingle=3, threshold=0.85)


@register
def op5_language_model(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@register
def op6_curve_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return curve_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@register
def op7_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.hide_private(docs, QUERY_KEY)


@register
def op8_vector_join(spark, sf_dir):
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


@register
def op9_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, rewrite=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


@register
def op10_byte_bpe(spark, sf_dir):
    """Ids are encoded from the texts and decoded again; the digests are Spark's."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(docs, *vocabulary).drop("text")
    return byte_bpe.decode(encoded, *vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _with_cycles(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, chosen by their id, repeat one stretch of words to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def cycled(all_words):
        n = F.size(all_words).cast("long")
        at = g % n
        period = 1 + F.floor((n - at) / (3 + g % 8))
        return F.transform(
            all_words, lambda w, i: F.when(i < at, w).otherwise(F.get(all_words, (at + (i - at) % period).cast("int")))
        )

    # bound by a lambda, the words are split once and not for each of them
    joined = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.array_join(cycled(ws), " "))), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, joined).otherwise(F.col("text")))


@register
def op11_periodic_runs(spark, sf_dir):
    """Runs of each text and the text without repeats; the digests are Spark's."""
    docs = _with_cycles(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs, keep_text=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, start, period = best["length"], -best["start"], -best["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@register
def op12_hard_negatives(spark, sf_dir):
    """Anchors are the rows with an id divisible by 100; where 7 divides it, the row has the next label."""
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    )
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@register
def op13_warc(spark, sf_dir):
    """Pages as WARC records of archives in the shared folder, read back."""
    path = scratch_path(spark, "archives")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives.write_archives(pages, path, "page_id", "url", "html", prefix="page")
    found = archives.read_archives(spark, path, with_payload=False)
    return found.select(
        archives.key_of("record_id", "page").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", archives.key_of("refers_to", "page").cast("long").alias("refers_to"),
    )
