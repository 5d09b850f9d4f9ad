"""The operators applied to whole tables, with production parameters."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.llm import (
    html,
    jaccard,
    leaks,
    merkle,
    mixing,
    quality,
    repeats,
    secret_scan,
    shards,
    suffix_tree,
    toxicity,
    urls,
    whitening,
)


#: Folder that holds the library; Python workers look for it there unless it is installed.
LIBRARY_HOME = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if LIBRARY_HOME not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, LIBRARY_HOME) if x)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = suffix_tree.score_texts(docs, suffix_tree.held_out(F.col("doc_id")))
    return scored.withColumnRenamed("doc", "doc_id")


def op2_visible_text(spark: SparkSession, folder: str) -> DataFrame:
    extracted = html.extract_text(table(spark, folder, "pages").select("page_id", "html"))
    return extracted.select("row.page_id", "text")


#: Rules of the query: entry and verdict.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def op3_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "entry string, verdict string")
    judged = urls.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op4_window_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = repeats.remove_repeats(table(spark, folder, "documents"))
    return cleaned.select(
        F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op6_quality_ratio(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    trusted = quality.trusted_ids(table(spark, folder, "labels"))
    model = quality.count_bins(docs, trusted)
    return quality.judge_against(docs, trusted, model, group_col="lang", columns=["doc_id"]).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "log_ratio",
    )


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    weights = mixing.label_weights(table(spark, folder, "labels"))
    mixed = mixing.mix_sources(table(spark, folder, "documents"), weights)
    return mixed.select(
        "row.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def op8_jaccard_groups(spark: SparkSession, folder: str) -> DataFrame:
    linked = jaccard.link_documents(table(spark, folder, "documents"))
    return linked.select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id")
    )


def op9_shuffle_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.shuffle_shards(table(spark, folder, "documents"))
    return placed.select(
        "row.doc_id",
        (F.coalesce(F.octet_length("row.text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learnt = labels.filter(~toxicity.held_out(F.col("doc_id")))
    characters = toxicity.count_characters(docs)
    evidence = toxicity.learn_evidence(docs, learnt, characters)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), characters, evidence)
    return scored.select(
        "row.doc_id",
        toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


#: Columns of a leaf, in the order they are hashed.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_proofs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in LEAF_COLUMNS]
    is_tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(is_tampered, merkle.leaf_digest(lowered))
    proved = merkle.build_manifest(docs, LEAF_COLUMNS, extra={"tampered": tampered}).proofs()
    folded = proved.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256).alias("proof_sha256"),
        merkle.fold(F.coalesce("extra.tampered", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), "vec_id", "embedding").rows.withColumnRenamed("id", "vec_id")


def _is_kind(kind: str):
    return lambda finding: finding["kind"] == kind


def op13_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    ledger = secret_scan.Ledger.create(spark)
    scanned = secret_scan.scan_versions(table(spark, folder, "documents"), ledger).rows
    kinds = [rule.kind for rule in secret_scan.BASE_RULES]
    counts = [
        F.size(F.filter("findings", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in kinds
    ]
    return scanned.select(
        "row.doc_id",
        *counts,
        F.sha2(secret_scan.spelt(F.col("findings"), kinds), 256).alias("base_sha256"),
        secret_scan.spelt(F.col("findings")).alias("spans"),
    )


QUERIES = {
    "op1_suffix_tree_scores": op1_suffix_tree_scores,
    "op2_visible_text": op2_visible_text,
    "op3_url_verdicts": op3_url_verdicts,
    "op4_window_repeats": op4_window_repeats,
    "op5_benchmark_leaks": op5_benchmark_leaks,
    "op6_quality_ratio": op6_quality_ratio,
    "op7_mix_sources": op7_mix_sources,
    "op8_jaccard_groups": op8_jaccard_groups,
    "op9_shuffle_shards": op9_shuffle_shards,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_proofs": op11_merkle_proofs,
    "op12_whitening": op12_whitening,
    "op13_secret_spans": op13_secret_spans,
}
