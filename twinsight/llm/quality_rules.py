"""Quality by weak supervision: rules vote or abstain, EM learns how far to trust each of them.

Only DataFrame expressions: one scan derives the votes of every whole text, the distinct vote
patterns (3 to the number of rules at most) are counted, and EM runs as aggregates over that table.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise
from twinsight.llm.text import GAP, WORD, only

GOOD, ABSTAIN, BAD = 1, 0, -1
_WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """Bad above ``bad_from`` (or below ``low``), good up to ``good_to``, else no vote."""

    name: str
    ratio: Column
    good_to: float
    bad_from: float
    low: float = -1.0

    def vote(self) -> Column:
        bad = (self.ratio >= self.bad_from) | (self.ratio < self.low)
        return F.when(self.ratio.isNull(), ABSTAIN).when(bad, BAD).when(self.ratio <= self.good_to, GOOD).otherwise(ABSTAIN)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def default_rules() -> list[Rule]:
    """Shares that tell prose from lists, junk, shouting and repetition."""
    return [
        Rule("symbols", _share("n_symbols", "n_words"), good_to=0.01, bad_from=0.1),
        Rule("repeated_words", _share("n_repeat_words", "n_words"), good_to=0.05, bad_from=0.4),
        Rule("repeated_lines", _share("n_dup_lines", "n_lines"), good_to=0.05, bad_from=0.4),
        Rule("word_length", _share("word_chars", "n_words"), good_to=7.0, bad_from=10.0, low=3.0),
        Rule("capitals", _share("n_capitals", "word_chars"), good_to=0.1, bad_from=0.3),
        Rule("exclamations", _share("n_exclamations", "n_words"), good_to=0.02, bad_from=0.2),
    ]


def text_counts(df: DataFrame) -> DataFrame:
    """``doc_id`` and counts of every whole text in column ``text``; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select("doc_id", text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", GAP), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    last = F.size("words") - _WINDOW
    windows = F.when(
        last >= 1,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.struct(
                    F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(_WINDOW)]).alias("w"), i.alias("i")
                ),
            )
        ),
    )
    rows = rows.select("doc_id", "text", "words", lines.alias("lines"), windows.alias("sorted"))
    twice = F.filter(
        F.transform(
            "sorted",
            lambda x, k: F.when(
                (F.get(F.col("sorted"), k - 1)["w"] == x["w"]) | (F.get(F.col("sorted"), k + 1)["w"] == x["w"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    rows = rows.select("doc_id", "text", "words", "lines", twice.alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + _WINDOW - 1)))))
    chars = F.aggregate("words", F.lit(0), lambda total, w: total + F.length(w))
    counts = {
        "n_words": F.size("words"),
        "word_chars": chars,
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0)),
        "n_lines": F.size("lines"),
        "n_capitals": F.regexp_count("text", F.lit(r"\p{Lu}")),
        "n_exclamations": F.regexp_count("text", F.lit("!")),
    }
    return rows.select("doc_id", *[c.cast("long").alias(n) for n, c in counts.items()])


#: What is assumed before any data: on good rows a rule votes bad this rarely, which weighs as much as
#: the data do (else a rule that fires alone could pass for a habit of good rows) ...
GOOD_ROW_ERROR, GOOD_WEIGHT = 0.005, 1.0
#: ... and on the bad rows a rule was made for it mostly votes bad (two rows' worth; others: even odds).
OWN_KIND_HIT, KIND_WEIGHT = 0.9, 2.0


@dataclass
class VoteModel:
    """Latent classes: good rows, and one kind of bad rows for each rule.

    ``bad[c][j]`` is the chance that rule ``j`` votes bad on a row of class ``c`` if it votes at all: its error
    on good rows (class 0) and its hits on the others. Abstaining says nothing.
    """

    bad: list[list[float]]
    share: list[float]

    def table(self) -> Column:
        """Per class the logarithm of its share, then of each rule's bad vote, abstention and good vote."""
        rows = [[math.log(p), *[x for b in bad for x in (math.log(b), 0.0, math.log(1.0 - b))]] for p, bad in zip(self.share, self.bad, strict=True)]
        return F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")


def with_cells(votes: DataFrame, rules: list[str]) -> DataFrame:
    """Adds ``cells``: where the votes of a row stand in a class's row of the model table."""
    return votes.withColumn("cells", _cells_of(rules))


def with_shares(votes: DataFrame, model: VoteModel) -> DataFrame:
    """Replaces ``cells`` by ``shares``, the posterior of each class; class 0 is the good rows."""
    logs = F.transform(model.table(), lambda row: F.aggregate("cells", F.lit(0.0), lambda a, at: a + F.get(row, at)))
    votes = votes.withColumn("shares", logs).drop("cells")
    votes = votes.withColumn("top", F.array_max("shares")).withColumn("shares", F.transform("shares", lambda x: F.exp(x - F.col("top"))))
    votes = votes.withColumn("top", F.aggregate("shares", F.lit(0.0), lambda a, x: a + x))
    return votes.withColumn("shares", F.transform("shares", lambda x: x / F.col("top"))).drop("top")


def fit_votes(votes: DataFrame, rules: list[str], rounds: int = 30, tolerance: float = 1e-3) -> VoteModel:
    """EM over the counted vote patterns, starting from "a bad vote makes a row suspect of that kind".

    Each round is one aggregate over at most 3 to the number of rules patterns, in one task; the driver
    holds the model alone, a number per class and rule.
    """
    patterns = materialise(with_cells(votes.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")), rules)).coalesce(1)
    classes, width = len(rules) + 1, len(rules)
    n_bad = sum(((F.col(r) == BAD).cast("double") for r in rules), F.lit(0.0))
    suspect = [F.when(n_bad > 0, F.lit(0.99) * (F.col(r) == BAD).cast("double") / n_bad).otherwise(0.01 / width) for r in rules]
    shared = patterns.withColumn("shares", F.array(F.when(n_bad > 0, 0.01).otherwise(0.99), *suspect))
    model = None
    for _ in range(rounds):
        cells = shared.select("n", F.explode(_cells_of(rules)).alias("cell"), "shares")
        cells = cells.select("n", "cell", F.posexplode("shares").alias("class", "share"))
        sums = cells.groupBy("class", "cell").agg(F.sum(F.col("n") * F.col("share")).alias("n")).collect()
        n = {(r["class"], r["cell"]): float(r["n"]) for r in sums}
        rows = [n.get((c, 0), 0.0) for c in range(classes)]
        bad = []
        for c in range(classes):
            assumed = [(GOOD_ROW_ERROR, GOOD_WEIGHT * sum(rows) + 1.0) if c == 0 else (OWN_KIND_HIT if c == j + 1 else 0.5, KIND_WEIGHT) for j in range(width)]
            cast = [(n.get((c, 3 * j + 1), 0.0), n.get((c, 3 * j + 3), 0.0)) for j in range(width)]
            bad.append([(no + rate * w) / (no + yes + w) for (no, yes), (rate, w) in zip(cast, assumed, strict=True)])
        before, model = model, VoteModel(bad, [(r + 1.0) / (sum(rows) + classes) for r in rows])
        shared = with_shares(patterns, model)
        if before and max(abs(x - y) for a, b in zip(before.bad, bad, strict=True) for x, y in zip(a, b, strict=True)) < tolerance:
            break
    return model


def _cells_of(rules: list[str]) -> Column:
    return F.array(F.lit(0), *[(F.lit(3 * j + 2) + F.col(r)).cast("int") for j, r in enumerate(rules)])


def judge_quality(df: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, votes, ``quality`` (posterior), ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words in repeated 3-word windows. Others are kept if
    their posterior reaches ``threshold``. Null or empty text: no words, all rules abstain, base
    failed. Repeated rows each get a row of their own with equal values. An empty table gives an
    empty one. Other columns of ``df`` are not looked at.
    """
    rules = default_rules() if rules is None else rules
    names = [f"vote_{r.name}" for r in rules]
    counts = text_counts(only(df, doc_id=doc_id, text=text))
    rows = materialise(counts.withColumns({n: r.vote().cast("int") for n, r in zip(names, rules, strict=True)}))
    model = fit_votes(rows, names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = with_shares(with_cells(rows, names), model)
    judged = judged.withColumn("quality", F.get("shares", F.lit(0))).drop("shares").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
