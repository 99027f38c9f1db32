"""Benchmark items inside documents: MinHash containment search by size class, then exact containment.

An item of a few dozen shingles is a speck in a long document, so a sketch of the whole document
says nothing about it. Items are partitioned into size classes (powers of two), and for each class that
occurs, documents are cut into blocks as long as the class, which makes a contained
item a large part of at most two blocks. A block keeps its ``k`` smallest shingle hashes (its MinHash sketch).

An item is looked up with its rarest hashes: up to half of those that a containing document must have may be left
out, those that most items share first. So the wording that items have in common makes no candidates. What is left
must still be hit: in blocks that a sketch holds whole, as often as the containment implies; in longer ones at least
``HITS`` times. The chance to miss an item with containment ``c`` is at most that of fewer than ``HITS`` hits in ``2 k``
draws of probability ``c/8`` (2e-5 at 0.8), reached where its passage straddles two blocks, and less elsewhere.
Everything is DataFrame functions.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise
from twinsight.llm.text import GAP, only

SHINGLE = 5
SKETCH = 64
HITS = 2
SMALLEST_CLASS = 8
#: Rows of 32 bytes of the item index up to which it is sent to every executor; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


def shingle_words(text: Column) -> Column:
    """Lower-cased words; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _shingles(words: str, make) -> Column:
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: make(F.slice(F.col(words), i + 1, SHINGLE))))


def _hashes(words: str) -> Column:
    return _shingles(words, F.xxhash64)


def _strings(words: str) -> Column:
    return F.array_distinct(_shingles(words, lambda w: F.concat_ws(" ", w)))


def size_class(size: Column) -> Column:
    """The power of two at or above ``size``."""
    return F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))), F.lit(SMALLEST_CLASS)).cast("int")


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, text_hash, item_id, n_shared, n_shingles, containment`` of every pair at or above ``threshold``.

    Containment is the share of the item's distinct 5-word shingles that the document has.
    Rows that repeat an id and a text are one document here; equal items give a row each. Null or
    empty texts and items of under five words have no shingles and match nothing. Null ids
    are kept as they are. Empty tables on either side give an empty result. Other columns are not
    looked at.
    """
    rows = only(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))
    asked = only(items, item_id=item_id, text=item_text).select("item_id", shingle_words(F.col("text")).alias("words"))
    asked = materialise(asked.select(F.monotonically_increasing_id().alias("row"), "item_id", _hashes("words").alias("hashes"), _strings("words").alias("shingles")).filter("hashes IS NOT NULL"))
    share = Fraction(str(threshold))
    sized = asked.withColumn("size", F.size("shingles").cast("long")).withColumn("class", size_class(F.col("size")))
    sized = sized.withColumn("enough", F.expr(f"(size * {share.numerator} + {share.denominator - 1}) div {share.denominator}"))
    candidates = materialise(candidate_pairs(rows, sized))
    return _verified(rows, sized, candidates)


def candidate_pairs(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """``doc_id, text_hash, row``: documents whose sketches hold enough of what an item is looked up with."""
    posted = materialise(_rare_part(sized))
    classes = [r[0] for r in posted.select("class").distinct().collect()]  # powers of two: a few dozen at most
    index = F.broadcast(posted) if posted.count() <= BROADCAST_ROWS else posted
    met = _sketch_rows(rows, classes).join(index, ["class", "hash"])
    hits = met.groupBy("doc_id", "text_hash", "row").agg(F.count(F.lit(1)).alias("hits"), F.max("need").alias("need"))
    return hits.filter("hits >= need").select("doc_id", "text_hash", "row")


def _rare_part(sized: DataFrame) -> DataFrame:
    """``row, class, hash, need``: the hashes each item is looked up with and how many a document must hit.

    Of ``enough`` shared shingles at most half can be among those left out, so ``enough - left out`` hits remain.
    """
    hashes = sized.select("row", "class", "enough", F.explode(F.array_distinct("hashes")).alias("hash"))
    ranked = hashes.join(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("held")), "hash")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("held"), "hash"))
    ranked = ranked.withColumn("left_out", (F.col("held") > 1) & (place <= F.expr("enough div 2")))
    ranked = ranked.withColumn("sure", F.col("enough") - F.count_if("left_out").over(Window.partitionBy("row")))
    need = F.when(F.col("class") <= SKETCH, F.col("sure")).otherwise(F.least(F.lit(HITS), "sure"))
    return ranked.filter("NOT left_out").select("row", "class", "hash", need.cast("long").alias("need"))


def _sketch_rows(rows: DataFrame, classes: list[int]) -> DataFrame:
    """``doc_id, text_hash, class, hash``: what the blocks of every document keep, for each size class."""
    hashed = rows.select("doc_id", "text_hash", shingle_words(F.col("text")).alias("words"))
    hashed = hashed.select("doc_id", "text_hash", _hashes("words").alias("hashes")).filter("hashes IS NOT NULL")

    def blocks(length: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("hashes"), F.lit(length))
        kept = F.transform(
            starts, lambda at: F.slice(F.sort_array(F.array_distinct(F.slice(F.col("hashes"), at, length))), 1, SKETCH)
        )
        return F.struct(F.lit(length).alias("class"), F.array_distinct(F.flatten(kept)).alias("kept"))

    if not classes:
        return hashed.select("doc_id", "text_hash", F.lit(0).alias("class"), F.explode("hashes").alias("hash")).limit(0)
    sketch = hashed.select("doc_id", "text_hash", F.explode(F.array(*[blocks(c) for c in sorted(classes)])).alias("b"))
    return sketch.select("doc_id", "text_hash", F.col("b.class").alias("class"), F.explode("b.kept").alias("hash"))


def _verified(rows: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Exact shared shingles of the candidate pairs, compared as text.

    Only documents with a candidate are read for it, and only shingles of their own candidates are met. The join is
    on document and shingle, so a document with many items, or an item in many documents, is no group of its own.
    """
    same = rows["doc_id"].eqNullSafe(candidates["doc_id"]) & rows["text_hash"].eqNullSafe(candidates["text_hash"])
    found = rows.join(candidates.select("doc_id", "text_hash").distinct(), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    found = found.select("doc_id", "text_hash", shingle_words(F.col("text")).alias("words"))
    have = found.select("doc_id", "text_hash", F.explode(_strings("words")).alias("shingle"))
    need = candidates.join(items.select("row", "shingles"), "row").select(
        F.col("doc_id").alias("in_doc"), F.col("text_hash").alias("in_text"), "row", F.explode("shingles").alias("needed")
    )
    meet = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("text_hash") == F.col("in_text")) & (F.col("shingle") == F.col("needed"))
    shared = have.join(need, meet).groupBy("doc_id", "text_hash", "row").agg(F.count(F.lit(1)).alias("n_shared"))
    sizes = items.select("row", "item_id", F.col("size").alias("n_shingles"), "enough")
    return shared.join(sizes, "row").filter("n_shared >= enough").select(
        "doc_id", "text_hash", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )
