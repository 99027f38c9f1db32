"""Near duplicates through an inverted join on MinHash coordinates.

A document's signature is ``COORDINATES`` minima of its shingle set. Two signatures that agree in at least ``t``
coordinates must share one of the ``COORDINATES - t + 1`` rarest coordinate-value pairs of each (prefix
filter), so only those are posted: values that come from passages many documents share are
frequent and stay out. Equal sets are one node from the start. Nodes first meet the most typical node of their
postings, and the links found are contracted. What is left in a posting are nodes of *different* components. They
meet inside tasks, in chunk pairs of bounded size: collisions are counted on the signatures there, each pair in one
posting only; the texts of nodes with a pair to check follow, and pairs are confirmed on full sets
until their components have met. A chunk pair gives links, fewer than it has nodes, and never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise, own_tables
from twinsight.llm.components import connected
from twinsight.llm.shingles import mixed, shingle_set
from twinsight.llm.text import only, sliced, texts

#: Coordinates of a signature, and the probability to miss a pair whose similarity is just the wanted one.
COORDINATES, MISS = 40, 2e-6
#: Members that a copy of their hub's text serves; nodes and shingles of one side of a chunk pair.
STAR_NODES, CHUNK_NODES, CHUNK_SHINGLES = 512, 1024, 1 << 20
#: Bits of the filter that keeps texts nobody asks for out of the join; a full one only filters less.
FILTER_BITS = 1 << 25

_NUMBERS = np.arange(1, 2 * COORDINATES + 1, dtype="uint64")
_FLIPS, _FACTORS = mixed(_NUMBERS[:COORDINATES]), mixed(_NUMBERS[COORDINATES:]) | np.uint64(1)


def lowered_set(data: bytes | None) -> np.ndarray:
    return shingle_set((data or b"").lower().split())


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum per coordinate, with the coordinate in its lowest six bits."""
    lows = np.full(COORDINATES, np.iinfo("uint64").max, "uint64")
    for at in range(0, len(shingles), 4096):  # bounds memory on very long texts
        part = shingles[at : at + 4096]
        lows = np.minimum(lows, ((part[None, :] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1))
    return (mixed(lows + _FLIPS) & ~np.uint64(63) | np.arange(COORDINATES, dtype="uint64")).view("int64")


def matches_needed(percent: int) -> int:
    """Coordinates that a pair at this similarity agrees in, except with probability ``MISS``; at least one."""
    from math import comb

    p, below = percent / 100, 0.0
    for t in range(COORDINATES):
        below += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if below > MISS:
            return max(t, 1)
    return COORDINATES


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, signature`` of every row; ``h1, h2`` identify the set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            n, h1, h2, values = [], [], [], []
            for data in texts(batch.column("text")):
                shingles = lowered_set(data)
                n.append(len(shingles))
                h1.append(np.bitwise_xor.reduce(mixed(shingles ^ _FLIPS[0])) if len(shingles) else np.uint64(0))
                h2.append(np.add.reduce(mixed(shingles ^ _FLIPS[1])) if len(shingles) else np.uint64(0))
                values.append(signature(shingles))
            flat = np.concatenate(values) if values else np.empty(0, "int64")
            offsets = pa.array(np.arange(len(n) + 1, dtype="int32") * COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, "int64"),
                    pa.array(np.array(h1, "uint64").view("int64")),
                    pa.array(np.array(h2, "uint64").view("int64")),
                    pa.ListArray.from_arrays(offsets, pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "signature"],
            )

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, h1 long, h2 long, signature array<long>")


def near_duplicates(df: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``df``.

    Sets are of distinct 5-word shingles of the lower-cased (A-Z) words; a text of fewer words is one shingle.
    Documents with a Jaccard similarity of ``percent`` or more are linked; a component is named by its smallest
    id, and that document is kept. Null, empty and blank texts have no shingles, link with
    nothing and are kept. Rows with the same id are one document. Rows with a null id link only with
    equal texts; without any id there the component is null and the row is kept. An empty table
    gives an empty one. Other columns are not looked at.
    """
    docs = only(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = materialise(sketches(docs))
    key = ["n_shingles", "h1", "h2"]
    sets = rows.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    sets = materialise(sets)
    nodes = sets.filter("node IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "signature")
    roots = _roots(docs, nodes, percent)
    named = sets.select(*key, "node").join(roots, "node", "left").select(*key, F.coalesce("root", "node").alias("component"))
    out = rows.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _roots(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``node, root`` of the nodes that are linked with another one."""
    with own_tables(docs.sparkSession) as outer:
        posted = materialise(_postings(nodes, matches_needed(percent)))
        links = materialise(_star_links(docs, posted, percent))
        rest = _links_across(docs, posted, connected(links), percent)
        return outer.keep(connected(links.unionByName(materialise(rest))))


def _postings(nodes: DataFrame, needed: int) -> DataFrame:
    """``node, n, met, prefix, hub`` of the nodes that share enough values with others.

    ``met`` has the shared values, rare ones first; ``prefix`` are those that are posted. ``hub`` is where a node first
    looks for a link: the most typical node of each posting (the one whose values are the most frequent, as the original
    of a group of edited copies) is the posting's centre; a node's hub is the centre of most of its postings, if that
    covers enough coordinates. Only values that occur twice are joined back: the rest cannot meet anyone.
    """
    values = nodes.select("node", F.explode("signature").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = values.join(shared, "value").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("met"), F.sum(F.log("df")).alias("typical")
    )
    met = met.filter(F.size("met") >= needed)
    met = materialise(met.join(nodes.select("node", "n"), "node").select("node", "n", "typical", F.col("met.value").alias("met")))
    posted = met.select("node", "typical", F.explode("met").alias("value"))
    centres = posted.groupBy("value").agg(F.max_by("node", F.struct("typical", -F.col("node"))).alias("centre"))
    votes = posted.join(centres, "value").filter("centre <> node").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("votes"))
    hubs = votes.filter(F.col("votes") >= needed).groupBy("node").agg(F.max_by("centre", F.struct("votes", -F.col("centre"))).alias("hub"))
    prefix = F.slice("met", F.lit(1), F.size("met") - (needed - 1))  # values of their own come before all others
    return met.select("node", "n", "met", prefix.alias("prefix")).join(hubs, "node", "left")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the documents named by ``nodes``; a filter of bounded size spares the others the shuffle."""
    place = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    words = nodes.select((place / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("bit"))
    bits = np.zeros(FILTER_BITS // 32, "int64")
    for word, held in words.groupBy("word").agg(F.bit_or("bit")).toLocalIterator():  # FILTER_BITS / 32 at most
        bits[word] = held
    shared = docs.sparkSession.sparkContext.broadcast(bits.astype("uint32"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            yield batch.select(["node", "text"]).filter(pa.array(shared.value[at >> 5] >> (at & 31).astype("uint32") & 1 == 1))

    named = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "text")
    few = named.withColumn("place", place.cast("long")).mapInArrow(asked, "node long, text string")
    return few.join(nodes.distinct(), "node", "left_semi")


def _star_links(docs: DataFrame, posted: DataFrame, percent: int) -> DataFrame:
    """``a, b``: confirmed links of nodes to their hub. A hub with many members meets them in parts."""
    members = posted.filter("hub IS NOT NULL").select("hub", "node")
    parts = members.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR_NODES).alias("parts"))
    members = members.join(parts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node")
    hubs = members.select("hub", "part").distinct().withColumn("node", F.col("hub"))
    rows = materialise(members.unionByName(hubs))
    rows = rows.join(_texts_of(docs, rows.select("node")), "node").withColumn("member", F.col("node") != F.col("hub"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sets = None, []
        for batch in (part for whole in batches for part in sliced(whole)):
            found = []
            keys = zip(*[batch.column(c).to_pylist() for c in ("hub", "part", "node", "member")], strict=True)
            for (hub, part, node, member), text in zip(keys, texts(batch.column("text")), strict=True):
                if centre != (hub, part):
                    centre, sets = (hub, part), []
                if not member:
                    sets.append(lowered_set(text))
                elif any(_similar(lowered_set(text), other, percent) for other in sets):
                    found.append((node, hub))
            yield _links_batch(found)

    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
    return dealt.select("hub", "part", "node", "member", "text").mapInArrow(confirm, "a long, b long")


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(one) + len(other) - shared)


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], "int64") for i in (0, 1)], names=["a", "b"])


CHUNK = "value long, x int, y int, node long, root long, n long, met array<long>, room int, side int"


def _links_across(docs: DataFrame, posted: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect the components which ``roots`` still keeps apart.

    The members of a posting outside its largest component meet all its members. Both are cut into chunks; every
    pair of chunks is a group of its own.
    """
    needed = matches_needed(percent)
    labelled = posted.join(roots, "node", "left").select(
        "node", "n", "met", F.size("prefix").alias("room"), F.coalesce("root", "node").alias("root"), F.explode("prefix").alias("value")
    )
    parts = labelled.groupBy("value", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    open_values = parts.groupBy("value").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("n").alias("all_n"))
    chunks = F.ceil(F.greatest(F.col("rows") / CHUNK_NODES, F.col("all_n") / CHUNK_SHINGLES)).cast("int")
    open_values = open_values.filter("parts > 1").select("value", "main", chunks.alias("chunks"))
    rows = materialise(labelled.join(open_values, "value"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(chunk.alias("x"), other.alias("y"), F.lit(0).alias("side")))
    met_by = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(other.alias("x"), chunk.alias("y"), F.lit(1).alias("side")))
    at = F.explode(F.when(F.col("root") != F.col("main"), F.concat(every, met_by)).otherwise(met_by))
    rows = rows.withColumn("at", at).select("value", "at.x", "at.y", "node", "root", "n", "met", "room", "at.side")
    key = ["value", "x", "y"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            chunks = _Chunks(group, needed, percent)
            wanted = np.zeros(group.num_rows, bool)
            for one, others in chunks.pairs():
                wanted[one] = wanted[others] = True
            if wanted.any():
                yield from group.filter(pa.array(wanted)).to_batches()

    wanted = rows.repartition(*key).sortWithinPartitions(*key, "side", "node").mapInArrow(asked, CHUNK)
    wanted = materialise(wanted)
    with_texts = wanted.join(_texts_of(docs, wanted.select("node")), "node").select(*key, "node", "root", "n", "met", "room", "side", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            yield _links_batch(_Chunks(group, needed, percent).links())

    return with_texts.repartition(*key).sortWithinPartitions(*key, "side", "node").mapInArrow(confirm, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one chunk pair at a time, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype("int64") for c in ("value", "x", "y")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(start, end - start)
            if held and any(held[-1].column(c)[-1] != part.column(c)[0] for c in ("value", "x", "y")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


class _Chunks:
    """Two chunks of a posting: side 0 meets side 1."""

    def __init__(self, group: pa.Table, needed: int, percent: int):
        self.group, self.needed, self.percent = group, needed, percent
        self.node, self.root, self.n, self.side, room = (group.column(c).to_numpy() for c in ("node", "root", "n", "side", "room"))
        met = group.column("met").combine_chunks()
        sizes = np.diff(met.offsets.to_numpy())
        values = met.values.to_numpy()[met.offsets[0].as_py() : met.offsets[-1].as_py()]
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # A byte a coordinate: agreement of values implies agreement here. Coordinates without a shared value agree with none.
        self.low = np.zeros((len(sizes), COORDINATES), "uint8")
        self.has = np.zeros((len(sizes), COORDINATES), bool)
        self.low[row, values & 63], self.has[row, values & 63] = values >> 6 & 255, True
        posted = place < np.repeat(room, sizes)
        known, code = np.unique(values[posted], return_inverse=True)
        self.prefix = np.full((len(sizes), int(room.max())), len(known))  # padded with a code that no row has
        self.prefix[row[posted], place[posted]] = code
        self.code, self.codes = int(np.searchsorted(known, group.column("value")[0].as_py())), len(known)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """A row and those of other components it may be a pair with, each pair in the last posting that both share.

        Met values are in one order, so the last common one of two prefixes is the same from either side.
        """
        first, second = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        last = np.full(self.codes + 1, -1)
        prefix = self.prefix[second]
        for i in first.tolist():
            own = self.prefix[i][self.prefix[i] < self.codes]
            last[own] = np.arange(len(own))
            here = last[prefix].max(axis=1) == last[self.code]
            last[own] = -1
            n, most = self.n[second], self.n[i]
            fit = second[here & (self.root[second] != self.root[i]) & (100 * np.minimum(n, most) >= self.percent * np.maximum(n, most))]
            agree = ((self.low[fit] == self.low[i]) & self.has[fit] & self.has[i]).sum(axis=1)
            if (agree >= self.needed).any():
                yield i, fit[agree >= self.needed]

    def links(self) -> list[tuple[int, int]]:
        """Confirmed pairs, except those whose components have met already."""
        sets = [lowered_set(text) for text in texts(self.group.column("text").combine_chunks())]
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(known), bool)
        root, found = self.root.copy(), []
        for i, others in self.pairs():
            others = others[root[others] != root[i]]
            if not len(others):
                continue
            own = flat[ends[i] - sizes[i] : ends[i]]
            mine[own] = True
            for j in others.tolist():
                shared = int(np.count_nonzero(mine[flat[ends[j] - sizes[j] : ends[j]]])) if root[j] != root[i] else 0
                if shared and 100 * shared >= self.percent * (sizes[i] + sizes[j] - shared):
                    found.append((int(self.node[i]), int(self.node[j])))
                    root[root == root[j]] = root[i]
            mine[own] = False
        return found
