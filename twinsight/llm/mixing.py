"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise, rows_in_order
from twinsight.llm.text import WORD, col

#: Hex digits of the draw by which a source is cut finer at each step; 256 sums per source and step.
_STEP = 2
_STEPS = 2
#: Sources in one file of a table that has a row per source.
_FILE_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls, in code point order with the null source last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def mix(
    docs: DataFrame,
    weights: dict[int, float] | None = None,
    cycle: tuple[int, ...] = (5, 2, 1),
    budget_share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and the ``keep`` columns for every document.

    A document's size is its words. Sources in code point order, null last, weigh ``weights[i]`` or
    else ``cycle`` repeated. They share ``budget_share`` of all words by weight; a source stops at
    ``max_epochs`` times its size and the excess is shared anew. A source's documents are
    taken ``floor(target / size)`` times, and once more in the order of a seeded hash while they fit into the
    words left; the room that a long document at the cut leaves is filled from the documents behind
    it that fit, in as many rounds as there is one that does.

    Null text: size 0. A null source is one of its own. Rows that repeat an id, or have none, draw one by one, apart by their text;
    of rows alike in both it does not matter which is taken. Empty sources have the
    target 0. An empty table gives an empty one. Of other columns only ``keep`` is
    carried along; a name there may not be one of the result's own.
    """
    carried = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(
        col(doc_id).alias("doc_id"), col(source).alias("source"), col(text).alias("_text"), *[col(c).alias(k) for c, k in zip(keep, carried, strict=True)]
    )
    apart = F.hex(F.xxhash64("_text"))
    named = F.coalesce(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")), F.concat(F.lit(f"null:{seed}:"), apart))
    draw = F.concat_ws("/", F.md5(named), apart, F.hex(F.monotonically_increasing_id()))
    counted = rows.select(
        "doc_id", "source", source_key(F.col("source")).alias("key"), word_count(F.col("_text")).alias("size"), draw.alias("draw"), *carried
    )
    sizes = materialise(counted)
    per_source = _small(_weighed(sizes.groupBy("key").agg(F.sum("size").alias("source_size")), weights or {}, cycle))
    targets = water_fill(per_source, budget_share, max_epochs)
    plan, rounds = _fill(sizes, targets)
    mixed = sizes.join(plan, "key")
    copies = F.col("whole") + F.when(_taken_again(rounds), 1).otherwise(0)
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
        *[F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)],
    )


def _weighed(per_source: DataFrame, weights: dict[int, float], cycle: tuple[int, ...]) -> DataFrame:
    """Weights by rank in key order."""
    per_source, rank = rows_in_order(per_source, [F.col("key")]), F.col("rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    for at, w in weights.items():
        weight = F.when(F.col("rank") == at, F.lit(float(w))).otherwise(weight)
    return per_source.withColumn("weight", weight)


def water_fill(per_source: DataFrame, budget_share: float, max_epochs: int) -> DataFrame:
    """``per_source`` with ``target``: clamp, share the rest by weight, until no source is above its cap.

    Each round is one aggregate over the sources; the driver holds the level alone. A clamped
    source stays clamped because the level only rises.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    totals = per_source.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = budget_share * (totals[0] or 0)
    level, clamped = budget / (totals[1] or 1.0), 0
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        found = per_source.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if found[0] == clamped or not found[2]:
            break
        clamped, level = found[0], (budget - found[1]) / found[2]
    return per_source.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _fill(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """Per source the whole repetitions, and for each round the room and the last draw that fits it; the number of rounds."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.select("key", "source_size", "target", whole.cast("long").alias("whole")).withColumn(
        "room0", F.col("target") - F.col("whole") * F.col("source_size")
    )
    plan, rounds = _small(plan), 0
    while True:
        fits = ~_taken_again(rounds) & (F.col("size") > 0) & (F.col("size") <= F.col(f"room{rounds}"))
        free = materialise(sizes.join(plan, "key").filter(fits).select("key", "draw", "size", F.col(f"room{rounds}").alias("room")))
        if free.isEmpty():
            return plan, rounds
        plan = plan.join(_cut(free), "key", "left").withColumn(f"cut{rounds}", F.coalesce("cut", F.lit("")))
        plan = _small(plan.withColumn(f"room{rounds + 1}", F.coalesce("room", f"room{rounds}")).drop("cut", "room"))
        rounds += 1


def _small(per_source: DataFrame) -> DataFrame:
    """A table with a row per source, written as one file (up to some sources) so that its size shows how small it is."""
    written = materialise(per_source)
    files = written.count() // _FILE_SOURCES + 1
    return written if len(written.inputFiles()) <= files else materialise(written.coalesce(files))


def _taken_again(rounds: int) -> Column:
    taken = F.lit(False)
    for r in range(rounds):
        taken = taken | ((F.col("size") > 0) & (F.col("size") <= F.col(f"room{r}")) & (F.col("draw") <= F.col(f"cut{r}")))
    return taken


def _cut(free: DataFrame) -> DataFrame:
    """``key, cut, room``: the last draw up to which the documents fit, and the words then left.

    Ranking a whole source would put a third of the rows in one window. Sums per
    (source, leading digits of the draw) find the digits at which the room is used up; only that
    slice is cut finer, and the last one, one in 65,536 of a source, is ranked itself.
    """
    rows, state = free.withColumn("prefix", F.lit("")), None
    before = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    for step in range(1, _STEPS + 1):
        slices = rows.groupBy("key", F.substring("draw", 1, _STEP * step).alias("slice")).agg(
            F.sum("size").alias("n"), F.first("room").alias("room")
        )
        placed = slices.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        over = F.col("before") + F.col("n") > F.col("room")
        found = placed.groupBy("key").agg(
            F.min(F.when(over, F.col("slice"))).alias("prefix"),
            F.coalesce(F.max(F.when(over, F.col("room") - F.col("before"))), F.min("room") - F.sum("n")).alias("room"),
        )
        if state is not None:  # a source without an open slice keeps what it had
            found = state.withColumnsRenamed({"prefix": "p0", "room": "r0"}).join(found, "key", "left")
            found = found.select("key", F.when(F.col("p0").isNotNull(), F.col("prefix")).alias("prefix"), F.coalesce("room", "r0").alias("room"))
        state = _small(found)
        rows = free.drop("room").join(state.filter("prefix IS NOT NULL"), "key").filter(F.col("draw").startswith(F.col("prefix")))
    upto = W.partitionBy("key").orderBy("draw").rangeBetween(W.unboundedPreceding, W.currentRow)
    fits = rows.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= F.col("room"))
    last = fits.groupBy("key").agg(F.max("draw").alias("last"), F.max("upto").alias("used"))
    ends = state.join(last, "key", "left")
    return ends.select("key", F.coalesce("last", "prefix", F.lit("g")).alias("cut"), (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
