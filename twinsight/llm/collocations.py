"""Collocations by marginalising the counts of the longest windows.

Only windows of the top order are counted: every word with the words that follow it in its piece (its lead columns),
padded where the piece ends. A task counts the windows of a few megabytes of text and sends each distinct one once,
packed by bucket. Whatever starts a phrase is a prefix of such windows, so Spark's ROLLUP over the word columns gives
the counts of all shorter phrases, and no n-gram is ever exploded on its own.

Before the ROLLUP, a window counted fewer than ``least`` times gives up its last word and joins the count of its
prefix: it cannot be a candidate, nor a part of one, and all that it adds to is its prefix. This is exact,
because every window of a prefix of two words is in one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise
from twinsight.llm.text import only, sliced, texts

#: Ends of a piece become full stops, tabs become blanks; a word holds none of them (fixed values).
BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b".......... ")
#: Bytes of text whose windows a task holds at a time.
HELD_BYTES = 8 << 20
#: Buckets in which windows are sent, and those that the windows of one first word are spread over, by second word. They
#: bound the number of tasks that can share the counting, not what is counted.
BUCKETS, SPREAD = 16_384, 16
#: Parts in which a language is ranked before its best rows meet.
RANK_PARTS = 16


def windows(df: DataFrame, order: int) -> DataFrame:
    """``lang, bucket, windows``: packed lines ``words <tab> count`` of distinct windows of up to ``order`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(order)
        for batch in (part for whole in batches for part in sliced(whole)):
            for lang, data in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
                held.add(lang, data or b"")
                if held.size >= HELD_BYTES:
                    yield from held.flush()
        yield from held.flush()

    return df.mapInArrow(count, "lang string, bucket int, windows string")


class _Held:
    """The words of some texts as numbers, by language."""

    def __init__(self, order: int):
        self.order = order
        self.clear()

    def clear(self) -> None:
        self.size, self.of = 0, {}
        self.number = {b".": 0}  # the end of a piece

    def add(self, lang: str, data: bytes) -> None:
        words = data.lower().translate(BREAKS).replace(b".", b" . ").split()
        number = self.number
        for word in words:
            if word not in number:
                number[word] = len(number)
        self.of.setdefault(lang, []).append(np.fromiter(map(number.__getitem__, words), "int64", len(words)))
        self.size += len(data)

    def flush(self) -> Iterator[pa.RecordBatch]:
        vocabulary = list(self.number)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), "uint64", len(vocabulary))
        vocabulary[0] = None
        names = pa.array(vocabulary, pa.binary()).cast(pa.string())
        for lang, parts in self.of.items():
            gap = np.zeros(self.order, "int64")
            flat = np.concatenate([x for part in parts for x in (part, gap)])
            yield from self._packed(lang, flat, names, hashes)
        self.clear()

    def _packed(self, lang: str, flat: np.ndarray, names: pa.Array, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(flat) - self.order + 1
        starts = np.flatnonzero(flat[:n])
        if not len(starts):
            return
        leads = [flat[starts]]
        for k in range(1, self.order):  # beyond the end of the piece a lead column is padding
            leads.append(np.where(leads[-1] == 0, 0, flat[starts + k]))
        label = leads[0]
        for lead in leads[1:]:
            pairs, label = np.unique(label << np.int64(32) | lead, return_inverse=True)
        counts = np.bincount(label)
        first = np.empty(len(counts), "int64")
        first[label] = np.arange(len(label))
        leads = [lead[first] for lead in leads]
        second = hashes[leads[1]] % np.uint64(SPREAD) if self.order > 1 else np.uint64(0)
        bucket = (hashes[leads[0]] % np.uint64(BUCKETS // SPREAD) * np.uint64(SPREAD) + second).astype("int32")
        dealt = np.argsort(bucket, kind="stable")
        phrase = pc.binary_join_element_wise(*[names.take(pa.array(lead[dealt])) for lead in leads], " ", null_handling="skip")
        lines = pc.binary_join_element_wise(phrase, pa.array(counts[dealt]).cast(pa.string()), "\t")
        bucket = bucket[dealt]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        packed = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, "int32"), lines), "\n")
        langs = pa.array([lang] * len(packed), pa.string())
        yield pa.RecordBatch.from_arrays([langs, pa.array(bucket[cuts[:-1]]), packed], names=["lang", "bucket", "windows"])


def prefix_words(phrase: Column | str, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def phrase_counts(df: DataFrame, order: int, least: int) -> DataFrame:
    """``lang, words, phrase, f`` of every phrase of up to ``order`` words that occurs ``least`` times or more.

    A row of 0 words has the number of all words of the language. ``df`` has ``lang`` and ``text``.
    """
    packed = windows(df, order).repartition("lang", "bucket")
    lines = packed.select("lang", "bucket", F.explode(F.split("windows", "\n")).alias("line"))
    key = ["lang", "bucket", "phrase"]
    counted = lines.select(
        "lang", "bucket", F.substring_index("line", "\t", 1).alias("phrase"), F.substring_index("line", "\t", -1).cast("long").alias("c")
    )
    counted = counted.groupBy(*key).agg(F.sum("c").alias("c"))
    for k in range(order, 1, -1):
        total = F.col("c") if k == order else F.sum("c").over(W.partitionBy("lang", "bucket", prefix_words("phrase", k)))
        counted = counted.withColumn("total", total)
        rare = F.when(F.col("total") < least, prefix_words("phrase", k - 1)).otherwise(F.col("phrase"))
        counted = counted.select("lang", "bucket", rare.alias("phrase"), "c").groupBy(*key).agg(F.sum("c").alias("c"))
    names = [f"w{i}" for i in range(order)]
    word = F.split("phrase", " ")
    columns = counted.select("lang", *[F.get(word, F.lit(i)).alias(name) for i, name in enumerate(names)], "c")
    size = sum(((F.grouping(name) == 0).cast("int") for name in names), F.lit(0))
    rolled = columns.rollup("lang", *names).agg(F.sum("c").alias("f"), size.alias("words"), F.grouping("lang").alias("all"))
    given = sum((F.col(name).isNotNull().cast("int") for name in names), F.lit(0))  # padding is no phrase
    real = (F.col("all") == 0) & (F.col("words") == given) & ((F.col("words") == 0) | (F.col("f") >= least))
    return rolled.filter(real).select("lang", "words", F.concat_ws(" ", *names).alias("phrase"), "f")


def collocations(
    df: DataFrame, order: int = 3, least: int = 10, top: int = 2000, absorbed: int = 50, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of 2 to ``order`` words of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs. A
    phrase is a candidate if it occurs ``least`` times or more within pieces. Each cut has a score of
    ``1000000 * a * a / (l * r)``, rounded down and computed exactly; the lowest one counts, ties to the first. A candidate
    inside a longer one that occurs in ``absorbed`` percent of its places or more is dropped. ``top`` rows stay per language, by
    score, count and phrase. A null language is ``und``; null and empty texts have no words; repeated rows
    count each time; an empty table gives an empty one. Other columns are not looked at.
    """
    docs = only(df, lang=lang, text=text).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts = materialise(phrase_counts(docs, order, least))
    candidates = counts.filter("words >= 2").withColumnRenamed("f", "a")
    cut = candidates.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    known = counts.filter("words >= 1")
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    a, left, right = (F.col(c).cast("decimal(15,0)") for c in "alr")
    cut = cut.withColumn("score", _whole(F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    scored = cut.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.*")
    kept = scored.join(_absorbing(candidates), ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True))
    )
    order_by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order_by)))
    kept = kept.filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order_by)))
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return kept.filter(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _whole(a: Column, b: Column) -> Column:
    """The whole part of a quotient of decimals."""
    return F.call_function("div", a, b)


def _absorbing(candidates: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the largest count of a candidate that holds the phrase and is longer."""
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    inside = candidates.filter("words >= 3").select("lang", "a", F.explode(inner).alias("phrase"))
    return inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
