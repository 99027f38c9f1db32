"""Ranked lexical search over tries of restricted term vectors.

A document is reduced to the terms that some item asks for, ordered by document frequency. Each task sorts a few thousand such
vectors into a trie, in which documents with the same frequent terms share a path. A subtree knows the largest
``tf`` of every term and the least ``m`` of its documents, which bound every score below it; an item walks the trie depth first,
best child first, and cuts off subtrees whose bound is under its 20th score so far. A sample of the documents gives every item a
first such score, so most tries are left near the root; it never decides a result.

Items are asked in blocks of bounded size; the vocabulary of a block is what is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise
from twinsight.llm.text import only, sliced, texts

#: ASCII letters and digits and all bytes of other characters make terms; capitals are lowered, the rest are blanks.
TERM_BYTES = bytes(b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256)).lower()
#: Item text in one pass over the documents, and item text whose terms share one trie.
PASS_BYTES, TRIE_BYTES = 32 << 20, 256 << 10
#: Documents of a trie, cells of its tables, and documents up to which a subtree is not split further.
TRIE_DOCS, TRIE_CELLS, LEAF_DOCS = 4096, 4 << 20, 16
#: One document in so many gives the first bound.
SAMPLE = 64
#: Stands for a null id, and sorts after all others.
NO_ID = (1 << 63) - 1


def terms_of(data: bytes | None) -> list[bytes]:
    return data.translate(TERM_BYTES).split() if data else []


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item by score, all with a score above 0.

    Terms are runs of ASCII letters and digits and of other than ASCII characters, only A-Z lower-cased. A document scores
    ``w * ((1000000000 * tf) div (1000 * tf + 12 * m))`` for every term of the item, repeats included, with
    ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 75 + (25 * n * N) div L``. Equal scores go by ascending id.
    Null and empty texts have no terms: such documents do not count, such items find nothing. Rows that repeat an id are documents
    of their own; one without an id comes last among ties. Items that repeat an id are one, with the least of
    their texts. Empty tables give an empty result. Other columns are not looked at.
    """
    asked = only(items, item_id=item_id, text=item_text).groupBy("item_id").agg(F.min("text").alias("text"))
    asked = materialise(asked.filter("text IS NOT NULL").select("item_id", "text", F.monotonically_increasing_id().alias("item")))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(-(-size // PASS_BYTES), 1)
    rows = only(docs, doc_id=doc_id, text=text).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    found = []
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        held = [(r["item"], Counter(terms_of(r["text"].encode()))) for r in part.orderBy("item").collect()]  # about PASS_BYTES
        found.append(materialise(_best(rows, held, top)) if blocks > 1 else _best(rows, held, top))
    best = W.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    ids = asked.select("item", "item_id")
    return ranked.join(ids, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def _best(rows: DataFrame, held: list[tuple[int, Counter]], top: int) -> DataFrame:
    """``item, doc_id, score`` of what each task found, at most ``top`` an item."""
    context = rows.sparkSession.sparkContext
    vocabulary = sorted({term for _, terms in held for term in terms})
    number = {term: i for i, term in enumerate(vocabulary)}
    vectors = materialise(rows.mapInArrow(_restricted(context.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>"))
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), "int64")
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # bound by the vocabulary
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], "int64")
    frequent = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), "int32")
    rank[frequent] = np.arange(len(df))
    asked = []
    for item, terms in held:
        at = np.array(sorted(rank[number[t]] for t in terms), "int32")
        times = np.array([terms[vocabulary[frequent[i]]] for i in at], "int64")
        asked.append((item, at, times * weight[frequent[at]]))
    groups = _groups(asked)
    long = "decimal(20,0)"
    share = F.call_function("div", F.lit(25).cast("decimal(3,0)") * F.col("n").cast("decimal(15,0)") * F.lit(n_docs).cast(long), F.lit(max(n_terms, 1)).cast(long))
    placed = vectors.filter(F.size("terms") > 0).select("doc_id", (F.lit(75) + share).alias("m"), "terms", "tfs")
    schema = "item long, doc_id long, score long"
    sample = placed.filter(F.pmod(F.xxhash64("doc_id", "m"), F.lit(SAMPLE)) == 0)
    first = sample.mapInArrow(_search(context.broadcast((rank, groups, {})), top), schema)
    scores = first.groupBy("item").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, top).alias("best"))
    bars = {r["item"]: r["best"][-1] for r in scores.collect() if len(r["best"]) == top}  # one number an item of the block
    return placed.mapInArrow(_search(context.broadcast((rank, groups, bars)), top), schema)


def _groups(asked: list) -> list[list]:
    """Items whose terms share a trie."""
    groups, size = [[]], 0
    for entry in asked:
        if groups[-1] and size + 8 * len(entry[1]) > TRIE_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(entry)
        size += 8 * len(entry[1])
    return groups


def _restricted(shared):
    """Documents with a term as ``doc_id, n, terms, tfs`` over the shared vocabulary."""

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(shared.value)}
        for batch in (part for whole in batches for part in sliced(whole)):
            sizes, terms, tfs = [], [], []
            for data in texts(batch.column("text")):
                words = terms_of(data)
                known = np.array([i for i in map(number.get, words) if i is not None], "int32")
                which, times = np.unique(known, return_counts=True)
                sizes.append(len(words))
                terms.append(which)
                tfs.append(times.astype("int32"))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in terms])]), "int32")
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.empty(0, "int32"))) for x in (terms, tfs)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, "int64"), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(sizes) > 0))

    return restrict


def _search(shared, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, groups, bars = shared.value
        best = {item: _Best(top, bars.get(item, 1)) for group in groups for item, _, _ in group}
        for batch in batches:
            for at in range(0, batch.num_rows, TRIE_DOCS):
                part = batch.slice(at, TRIE_DOCS)
                for group in groups:
                    _ask(part, rank, group, best)
        found = [(item, d, s) for item, b in best.items() for d, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, "int64") for c in columns], names=["item", "doc_id", "score"])

    return search


def _ask(batch: pa.RecordBatch, rank: np.ndarray, group: list, best: dict) -> None:
    """Build the tries of a batch over the group's terms, and search them for its items."""
    wanted = np.unique(np.concatenate([terms for _, terms, _ in group]))
    local = np.full(len(rank), -1, "int32")  # vocabulary number to column, by falling document frequency
    local[np.flatnonzero(np.isin(rank, wanted))] = np.searchsorted(wanted, rank[np.isin(rank, wanted)])
    terms, tfs = batch.column("terms"), batch.column("tfs")
    offsets = terms.offsets.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    column, tf = local[terms.values.to_numpy()[offsets[0] : offsets[-1]]], tfs.values.to_numpy()[tfs.offsets[0].as_py() : tfs.offsets[-1].as_py()]
    row, column, tf = row[column >= 0], column[column >= 0], tf[column >= 0]
    ids, m = batch.column("doc_id").to_numpy(), batch.column("m").to_numpy()
    step = max(TRIE_CELLS // max(len(wanted), 1), LEAF_DOCS)
    for at in range(0, batch.num_rows, step):
        end = min(at + step, batch.num_rows)
        chosen = (row >= at) & (row < end)
        trie = _Trie(row[chosen] - at, column[chosen], tf[chosen], ids[at:end], m[at:end], len(wanted))
        for item, asked, weights in group:
            trie.search(np.searchsorted(wanted, asked), weights, best[item])


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of the score; it grows with ``tf`` and falls with ``m``."""
    tf = tf.astype("int64")
    return (1_000_000_000 * tf // (1000 * tf + 12 * m)).astype("int32")


class _Best:
    """The best documents of an item so far, and the score a further one must reach."""

    def __init__(self, top: int, bar: int):
        self.top, self.bar = top, max(bar, 1)
        self.ids, self.scores = np.empty(0, "int64"), np.empty(0, "int64")

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.bar
        if good.any():
            ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
            order = np.lexsort((ids, -scores))[: self.top]
            self.ids, self.scores = ids[order], scores[order]
            if len(order) == self.top:
                self.bar = max(self.bar, int(self.scores[-1]))


class _Trie:
    """Documents in path order; a node is a range of them, with its children and the bounds of its subtree."""

    def __init__(self, row, column, tf, ids, m, width):
        n = len(ids)
        order = np.lexsort((column, row))
        row, column, tf = row[order], column[order], tf[order]
        sizes = np.bincount(row, minlength=n)
        path = np.full((n, int(sizes.max(initial=0)) + 1), -1, "int32")
        path[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column
        keys = (path + 1).astype(">u4")
        placed = sorted(range(n), key=[k.tobytes() for k in keys].__getitem__)
        place = np.empty(n, "int64")
        place[placed] = np.arange(n)
        self.ids, m = ids[placed], m[placed]
        tfs = np.zeros((n, width), "int32")
        tfs[place[row], column] = tf
        self.parts = np.zeros((n, width), "int32")
        self.parts[place[row], column] = _part(tf, m[place[row]])
        self.low, self.high, self.children = [0], [n], [[]]
        self._grow(path[placed])
        largest, least = np.zeros((len(self.low), width), "int32"), np.zeros(len(self.low), "int64")
        for node in range(len(self.low) - 1, -1, -1):  # children come after their parents
            kids = self.children[node]
            span = slice(self.low[node], self.high[node])
            largest[node] = largest[kids].max(axis=0) if kids else tfs[span].max(axis=0)
            least[node] = least[kids].min() if kids else m[span].min()
        self.bounds = np.zeros_like(largest)
        at, term = np.nonzero(largest)
        self.bounds[at, term] = _part(largest[at, term], least[at])

    def _grow(self, path: np.ndarray) -> None:
        open_nodes = [(0, 0)]
        while open_nodes:
            node, depth = open_nodes.pop()
            low, high = self.low[node], self.high[node]
            apart = np.flatnonzero(path[low, depth:] != path[high - 1, depth:])
            if high - low <= LEAF_DOCS or not len(apart):
                continue
            depth += int(apart[0])  # up to here the documents share one path
            cuts = np.flatnonzero(np.diff(path[low:high, depth])) + low + 1
            for start, end in _runs([low, *cuts.tolist(), high]):
                self.low.append(start)
                self.high.append(end)
                self.children.append([])
                self.children[node].append(len(self.low) - 1)
                open_nodes.append((len(self.low) - 1, depth))

    def search(self, columns: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        """Depth first, the most promising child first; subtrees that cannot reach the bar are cut off."""
        stack = [(0, int(self.bounds[0, columns] @ weights))]
        while stack:
            node, bound = stack.pop()
            if bound < best.bar:
                continue
            kids = self.children[node]
            if not kids:
                span = slice(self.low[node], self.high[node])
                best.add(self.ids[span], self.parts[span, columns] @ weights)
                continue
            bounds = self.bounds[np.array(kids)[:, None], columns] @ weights
            for i in np.argsort(bounds, kind="stable").tolist():
                if bounds[i] >= best.bar:
                    stack.append((kids[i], int(bounds[i])))


def _runs(cuts: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring ranges between the cuts, put together while they hold few documents."""
    start = cuts[0]
    for end, after in zip(cuts[1:], [*cuts[2:], None], strict=True):
        if after is None or after - start > LEAF_DOCS:
            yield start, end
            start = end
