"""One query per corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook.llm import dialogue, exact, fill_middle, fingerprints, html_text, licenses, lines, merkle, mixing, pieces, quality, secrets, simhash
from signalbook.llm.common import ascii_lower
from signalbook.llm.sql import SQL
from signalbook.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed by weights 5, 2, 1 to 150 % of all words, at most two epochs."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of a sampled segmentation of every document, and whether decoding gives the text back."""
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than a tenth of their source's documents hold."""
    kept = lines.drop_boilerplate(_table(spark, sf_dir, "documents"), counts=("full_lines", "dropped_lines"))
    return kept.select("doc_id", "source", "full_lines", "dropped_lines", "text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by the passage attention network."""
    return quality.score_and_decide(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each participant, segment by segment."""
    return dialogue.rotate(_table(spark, sf_dir, "conversations"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every document and of its edited text."""
    found = fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.printed(F.col("signature")).alias("fingerprint"),
        fingerprints.printed(F.col("edited_signature")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the near-duplicate component of every document."""
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents equal up to the case of A-Z; the largest doc_id stays."""
    groups = exact.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned blob by blob into a new ledger."""
    versions = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(versions, scratch_path(spark, "secret-ledger"))
    base = [rule.kind for rule in secrets.BASE_RULES]
    base_spans = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.span_list(base_spans), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, folded with its digest or that of a tampered text."""
    docs = _table(spark, sf_dir, "documents")
    spoilt = [ascii_lower(F.col("text")) if name == "text" else F.col(name) for name in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_digest(spoilt))
    manifest = merkle.build(docs, carry={"tampered": tampered})
    proven = merkle.prove(manifest, manifest.leaves.select("tree", "rank", "id", "tampered"))
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return proven.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for infilling, and rebuilt from the result."""
    made = fill_middle.rearrange(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_mix_sources,
        op2_sentencepiece,
        op3_line_dedup,
        op4_quality,
        op5_chat_perspectives,
        op6_fingerprints,
        op7_html_text,
        op8_simhash,
        op9_exact_dedup,
        op10_secrets,
        op11_merkle_manifest,
        op12_license_scan,
        op13_fill_middle,
    )
}

ORACLE: dict[str, str] = dict(SQL)
