"""Repeated passages by level-wise doubling.

A window of ``window`` words can only repeat if its parts of half, a quarter, ... the length do. At
each shorter level a window is stood for by one of its parts, the one with the least hash: equal windows
choose equal parts, neighbours mostly share one, so about a sixth of all positions is counted instead of all.
Windows whose part occurs once in the corpus are out; those left are extended to twice the
length, up to the full windows, whose first occurrence in corpus order stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise
from twinsight.llm.shingles import sliding_min, window_hashes, word_hashes
from twinsight.llm.text import only, sliced, texts, words_of

KEY = ["doc_id", "text_hash"]


def remove_repeats(df: DataFrame, window: int = 20, levels: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_words, n_removed, kept_sha256, kept_text`` for every row of ``df``.

    A word is removed if some window of ``window`` words over it also starts earlier: in a smaller id, or
    earlier in the same document. Windows are judged on the input. Words are
    compared as they are; ``kept_text`` (null where nothing was removed) has the others joined by one space.
    ``levels`` is the number of lengths, each twice the one before, the last being ``window``.

    Null, empty and short texts have no window and stay. A null id counts as smallest. Rows with equal id and
    text are one document; of rows with one id and unlike texts the smaller text hash comes first. An empty table gives an
    empty one. Other columns are not looked at. Windows are compared by 64-bit hashes: a chance of (windows that reach the
    last level) / 2**64 for each to be taken for another.
    """
    if levels < 1 or window % (1 << (levels - 1)):
        raise ValueError("the window must be divisible by two for every further level")
    docs = only(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("text_hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
    whole = materialise(docs.mapInArrow(_whole, "doc_id long, text_hash long, n_words long, sha256 string"))
    rows = docs.mapInArrow(_packed, "doc_id long, text_hash long, data binary").withColumn("parts", F.array().cast("array<array<long>>"))
    for level in range(levels - 1):
        lengths = [window >> (levels - 1 - at) for at in range(level + 1)]
        rows = _surviving(rows, lengths, window)
    firsts = _firsts(rows, window, levels)
    judged = _matched(rows, firsts, "left").mapInArrow(
        _judge(window, levels), "doc_id long, text_hash long, n_removed long, kept_sha256 string, kept_text string"
    )
    judged = materialise(judged.dropDuplicates(KEY))
    out = _matched(whole, judged, "left")
    return out.select(
        *KEY,
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        "kept_text",
    )


def _matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the row key, null ids included; keeps the left side's key columns."""
    other = right.withColumnsRenamed({c: f"{c}_r" for c in KEY})
    same: Column = left["doc_id"].eqNullSafe(other["doc_id_r"]) & (left["text_hash"] == other["text_hash_r"])
    return left.join(other, same, how).drop("doc_id_r", "text_hash_r")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in sliced(whole)):
        words = [words_of(data) for data in texts(batch.column("text"))]
        columns = [pa.array([len(w) for w in words], "int64"), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], "string")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in KEY] + columns, names=[*KEY, "n_words", "sha256"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed word sequences, which is what the shuffles move."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in (part for whole in batches for part in sliced(whole)):
        data = pa.array([pack(b" ".join(words_of(t))) for t in texts(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], data], names=[*KEY, "data"])


def _alive(hashes: np.ndarray, parts: list[np.ndarray], lengths: list[int], window: int) -> np.ndarray:
    """Which windows have only parts that are known to repeat, one per length."""
    alive = np.ones(max(len(hashes) - window + 1, 0), bool)
    for length, known in zip(lengths, parts, strict=True):
        alive &= np.isin(sliding_min(window_hashes(hashes, length), window - length + 1), known)
    return alive


def _surviving(rows: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """Rows that have windows whose part of ``lengths[-1]`` words repeats, with those parts added."""

    def stand_ins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in (part for whole in batches for part in sliced(whole)):
            keys = []
            for data, parts in zip(batch.column("data").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                words = unpack(data).split()
                if len(words) < window:
                    keys.append(np.empty(0, "int64"))
                    continue
                hashes = word_hashes(words)
                alive = _alive(hashes, [np.array(p, "int64").view("uint64") for p in parts], lengths[:-1], window)
                every = window_hashes(hashes, lengths[-1])
                chosen = np.unique(sliding_min(every, window - lengths[-1] + 1)[alive])
                found, n = np.unique(every, return_counts=True)
                # A part that occurs twice in one document counts twice, wherever it was chosen.
                keys.append(np.concatenate([chosen, np.intersect1d(chosen, found[n > 1])]).view("int64"))
            yield _listed(batch, keys, "part")

    asked = rows.mapInArrow(stand_ins, "doc_id long, text_hash long, part array<long>").select(*KEY, F.explode("part").alias("part"))
    asked = materialise(asked)
    twice = asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part")
    found = asked.join(twice, "part", "left_semi").groupBy(*KEY).agg(F.collect_set("part").alias("found"))
    met = _matched(rows, found, "inner")
    return materialise(met.select(*KEY, "data", F.concat("parts", F.array("found")).alias("parts")))


def _listed(batch: pa.RecordBatch, lists: list[np.ndarray], name: str) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("int32")
    flat = pa.array(np.concatenate(lists) if lists else np.empty(0, "int64"))
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[*KEY, name])


def _lengths(window: int, levels: int) -> list[int]:
    return [window >> (levels - 1 - at) for at in range(levels - 1)]


def _firsts(rows: DataFrame, window: int, levels: int) -> DataFrame:
    """``KEY, starts``: where each surviving full window starts first.

    The least place per window is taken map-side before the shuffle: a passage that is in a third of all
    documents leaves each task as one row.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in (part for whole in batches for part in sliced(whole, 100)):
            hashed, starts, owners = [np.empty(0, "uint64")], [np.empty(0, "int64")], [np.empty(0, "int64")]
            for at, (data, parts) in enumerate(zip(batch.column("data").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                words = word_hashes(unpack(data).split())
                alive = np.flatnonzero(_alive(words, [np.array(p, "int64").view("uint64") for p in parts], _lengths(window, levels), window))
                hashed.append(window_hashes(words, window)[alive])
                starts.append(alive)
                owners.append(np.full(len(alive), at))
            owner = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashed).view("int64")), *[batch.column(c).take(owner) for c in KEY], pa.array(np.concatenate(starts), "int32", safe=False)],
                names=["window", *KEY, "start"],
            )

    places = rows.mapInArrow(windows, "window long, doc_id long, text_hash long, start int")
    first = places.groupBy("window").agg(F.min(F.struct(*KEY, "start")).alias("at"))
    return first.select("at.*").groupBy(*KEY).agg(F.collect_list("start").alias("starts"))


def _judge(window: int, levels: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in (part for whole in batches for part in sliced(whole)):
            removed, sums, kept_texts = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("data", "parts", "starts")]
            for data, parts, starts in zip(*columns, strict=True):
                words = unpack(data).split()
                again = _alive(word_hashes(words), [np.array(p, "int64").view("uint64") for p in parts], _lengths(window, levels), window)
                again[np.array(starts or [], "int64")] = False
                depth = np.zeros(len(words) + 1, "int64")
                at = np.flatnonzero(again)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + window, -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                sums.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if gone.any() else None)
            columns = [pa.array(removed, "int64"), pa.array(sums, "string"), pa.array(kept_texts, "string")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], *columns], names=[*KEY, "n_removed", "kept_sha256", "kept_text"])

    return judge
