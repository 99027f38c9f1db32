"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept. All but the last return the columns
of ``documents``; the last returns one row per written document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise, own_tables
from twinsight.llm import decontaminate, mixing, near_dedup, toxicity
from twinsight.llm.queries import fitted_toxicity, table, token_file_sums

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not among ``rejected`` (doc_id, text_hash); null ids match null ids."""
    hashed = docs.withColumn("text_hash_", F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(rejected["doc_id"]) & (hashed["text_hash_"] == rejected["text_hash"])
    return hashed.join(rejected, same, "left_anti").select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents predicted toxic go. The score is a column beside the text, so nothing is joined back."""
    model = fitted_toxicity(docs, sf_dir)
    weighed = toxicity.evidence(docs.select(*COLUMNS), model, *COLUMNS)
    return weighed.filter(toxicity.probability(model) < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group stays (the smallest id); rows that repeat an id count as one."""
    judged = near_dedup.near_duplicates(docs)
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that contain a benchmark item go."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, materialise(leaks.select("doc_id", "text_hash").distinct()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as many times as the mix takes it, so rows repeat or go."""
    plan = mixing.mix(docs, keep=["text", "lang", "n_chars"])
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return plan.filter("copies > 0").select(*COLUMNS, times.alias("time_")).select(*COLUMNS)


def written(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token files in ascending id order, read back as ``doc_id, start, n_tokens, ids_crc32``."""
    return token_file_sums(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", written),
]

#: The first stage is a trained classifier, which SQL cannot express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        with own_tables(spark) as outer:  # a stage's own tables go as soon as its result is written
            docs = outer.keep(stage(spark, docs, sf_dir))
    return docs
