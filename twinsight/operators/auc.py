"""Area under the ROC curve as a distributed aggregate, ties counted half."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import sums_before


def roc_auc(scores: DataFrame, score: str, positives: str, negatives: str, out: str = "auc") -> DataFrame:
    """One row: P(score of a positive > score of a negative), a tie counting one half.

    ``scores`` carries counts of positives and negatives per row. Equal scores are merged
    first (map-side), so a score shared by a third of all rows is one row. The negatives below a score are a running sum
    over range partitions, as many as the session and the data call for.
    """
    counts = scores.groupBy(F.col(score).alias("_s")).agg(
        F.sum(positives).cast("double").alias("_p"), F.sum(negatives).cast("double").alias("_n")
    )
    below = sums_before(counts, [F.col("_s")], F.col("_n"), "_below")
    won = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    pairs = F.sum("_p") * F.sum("_n")
    return below.agg(F.when(pairs > 0, won / pairs).alias(out))
