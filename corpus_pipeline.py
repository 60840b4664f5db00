"""A training corpus from the documents table: STAGES in order, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``,
with any further columns untouched; the last returns the packed pieces. The
order in which a stage's rows are written counts: stage 4 sets it, and stage 5 numbers its
sequences by it. What
null, empty and very long texts, ties, repeated rows, null ids, empty tables and columns with
clashing names give is said by the docstrings of the operators: ``score_quality``, ``dedup_lines``,
``near_duplicates``, ``mix_positions`` and ``pack_in_order``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.llm._shared import ROW, documents, keyed, saved
from tallyrock.llm.line_dedup import dedup_lines
from tallyrock.llm.mixing import mix
from tallyrock.llm.near_dedup import near_duplicates
from tallyrock.llm.packing import pack_stored
from tallyrock.llm.quality import RULES, fit_quality, score_quality

#: Similarity in hundredths from which documents are near duplicates; 85 is the threshold of the op3 query alone.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word rules or the classifier go."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clash = {n for n, _ in RULES} & set(docs.columns)  # columns of the input that the results would replace
    marked = score_quality(docs.withColumnsRenamed({n: f"_own_{n}" for n in clash}), model).where("kept")
    return marked.select(*(F.col(f"_own_{c}" if c in clash else c).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them; n_chars follows the text."""
    done = dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document with the smallest doc_id stays.

    Of rows that repeat its doc_id, the one stored first; rows without an id all stay."""
    found = near_duplicates(docs.select("doc_id", "text"), NEAR).where("kept")
    kept = saved(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")), "near-kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    more = kept.where("_n > 1 AND _id IS NOT NULL")
    if more.isEmpty():
        return docs.join(kept, same, "left_semi")
    rows = keyed(docs)
    first = rows.join(more, same).groupBy("_id").agg(F.min(F.struct(*ROW)).alias("first")).select("first.*")
    return docs.join(kept.where("_n = 1 OR _id IS NULL"), same, "left_semi").unionByName(rows.join(first, ROW, "left_semi").select(*docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that holds the sources' target weights at every point."""
    return mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, packed into sequences that follow the mixed order."""
    import public_tokenizers

    return pack_stored(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage's classifier has no form in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
