"""A class-based bigram language model: exchange clustering, class transitions, word emissions.

``P(word | before) = P(class | class before) * P(word | class)``. The corpus is encoded once in blocks of
documents, each with its own word list, so later passes move integers and word lists instead of texts.
Counts of all words come from an ordinary aggregate and go back to the blocks through a join.

Classes are first of *units*: the most frequent words are a unit each, all others share the unit of
their ending. Unit bigrams are counted over the whole training corpus; their number is bound by
the number of units squared, and the exchange runs on that table alone.

Then every other training word gets a class of its own by a distributed exchange round: its neighbours' classes are counted over the
corpus, and it moves to the class where its occurrences are likeliest. Words that make up a millionth of the training tokens (and
occur ``FREQUENT`` times) are counted by number, as there can be no more than a million of them and their classes may be broadcast; the
neighbours of all rarer ones are shuffled by word, and their classes joined back to the blocks by word. Both ways give the same classes. Only
words unseen in training keep the class of their ending. Class bigrams are then counted anew.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise, small_batches
from twinsight.llm.text import only, sliced, texts, words_of

#: Units: the end mark, words of their own, endings (3 letters, hashed). Classes of units.
OWN_WORDS, ENDINGS, CLASSES = 600, 400, 48
UNITS = 1 + OWN_WORDS + ENDINGS
#: A block is full at so many documents or bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 4000, 16 << 20
#: Blocks in a file, and bytes that a worker is handed at a time, mostly one block: else a task would hold all blocks of its file, however many.
FILE_BLOCKS, BATCH_BYTES = 2, 8 << 20
SWEEPS = 8
#: Tasks look at a block in pieces of whole documents with about so many tokens.
PIECE = 1 << 18
#: Counts are summed by buckets of so many keys: 16 lines of unit bigrams, 256 words by neighbouring classes.
PAIR_BUCKET, WORD_BUCKET = 16 * UNITS, 256 * 2 * CLASSES
#: Weight of the class frequencies in the transitions, in counts.
STRENGTH = 5.0
#: Words of so many training occurrences and one token in so many are broadcast, rarer ones joined. Affects speed and memory only.
FREQUENT, ONE_IN = 5, 1_000_000
#: Gains are whole numbers of this part, so that their sums do not depend on the order.
GAIN_UNIT = 1000

_BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, ends array<int>, codes array<int>, words array<string>, n_train array<long>"


def encode_blocks(docs: DataFrame) -> DataFrame:
    """One row per block: ids, held-out marks, where each document ends in ``codes``, word list, training counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        block = _Block()
        for batch in (piece for whole in batches for piece in sliced(whole, 100)):
            columns = [batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts(batch.column("text"))]
            for doc_id, held, data in zip(*columns, strict=True):
                block.add(doc_id, held, data)
            if block.full():
                yield block.row((part << 32) + made)
                block, made = _Block(), made + 1
        if block.doc_ids:
            yield block.row((part << 32) + made)

    return docs.select("doc_id", "held_out", "text").mapInArrow(encode, _BLOCKS)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class _Block:
    def __init__(self):
        self.table, self.doc_ids, self.held, self.codes, self.bytes = _Codes(), [], [], [], 0

    def add(self, doc_id: int | None, held: bool, data: bytes | None) -> None:
        words = words_of(data.lower() if data else None)
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.codes.append(np.fromiter(map(self.table.__getitem__, words), "int32", len(words)))
        self.bytes += len(data or b"")

    def full(self) -> bool:
        return len(self.doc_ids) >= BLOCK_DOCS or self.bytes >= BLOCK_BYTES

    def row(self, block: int) -> pa.RecordBatch:
        n_train = np.zeros(len(self.table), "int64")
        for codes, held in zip(self.codes, self.held, strict=True):
            if not held:
                n_train += np.bincount(codes, minlength=len(n_train))
        ends = np.cumsum([len(c) for c in self.codes])
        values = [[block], [self.doc_ids], [self.held], [ends], [np.concatenate(self.codes)], [[w.decode() for w in self.table]], [n_train]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
        names = ["block", "doc_ids", "held_out", "ends", "codes", "words", "n_train"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def unit_of(word: str, own: dict[str, int]) -> int:
    found = own.get(word)
    return found if found is not None else 1 + OWN_WORDS + zlib.crc32(word[-3:].encode()) % ENDINGS


def _units(words: list[str], own: dict[str, int]) -> np.ndarray:
    endings = _Endings()
    return np.array([endings[w[-3:]] if (unit := own.get(w)) is None else unit for w in words], "int32")


class _Endings(dict):
    """Units of endings, each found once for the words of a block."""

    def __missing__(self, ending: str) -> int:
        unit = self[ending] = unit_of(ending, {})
        return unit


def unit_bigrams(blocks: DataFrame, own: dict[str, int]) -> np.ndarray:
    """How often unit ``v`` follows ``u`` in the training documents, each between two end marks (unit 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, "int64")
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, b=batch, r=row: b.column(name)[r].values
                units = np.append(_units(get("words").to_pylist(), own), 0)
                train = ~np.array(get("held_out").to_pylist(), bool)
                for docs, sizes, codes in _pieces(get("codes").to_numpy(), get("ends").to_numpy(), len(units) - 1):
                    total += _bigrams(units[codes], np.repeat(train[docs], sizes), UNITS)
        at = np.flatnonzero(total)
        yield _packed(at, total[at], PAIR_BUCKET)

    def listed(bucket: int, sums: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(at + bucket * PAIR_BUCKET), pa.array(sums[at])], names=["pair", "n"])

    pairs = blocks.select("held_out", "ends", "codes", "words").mapInArrow(count, _PACKED)
    found = _summed(pairs, PAIR_BUCKET, listed, "pair long, n long").toArrow()  # at most UNITS ** 2 rows
    counts = np.zeros(UNITS * UNITS)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    return counts.reshape(UNITS, UNITS)


def _pieces(codes: np.ndarray, ends: np.ndarray, end_code: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A block piece by piece: which documents, their token counts with the end mark, and their codes with ``end_code`` after each."""
    first = start = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, start + PIECE, "right")))
        places = ends[first:last] - start
        yield slice(first, last), np.diff(places, prepend=0) + 1, np.insert(codes[start : ends[last - 1]], places, end_code)
        first, start = last, ends[last - 1]


def _bigrams(line: np.ndarray, marked: np.ndarray, size: int) -> np.ndarray:
    """How often each value follows another at the marked places of a piece; before the first comes 0, the end mark."""
    before = np.concatenate([line[:0], [0], line[:-1]]).astype("int64")
    return np.bincount((before * size + line)[marked], minlength=size * size)


_PACKED = "bucket int, steps array<short>, n array<long>"  # steps are below a bucket's width


def _packed(keys: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
    """Counts of ascending keys, one row per ``width`` keys that has any: differences of the keys, then the counts."""
    buckets, starts = np.unique(keys // width, return_index=True)
    steps = np.diff(keys, prepend=keys[:1])
    steps[starts] = keys[starts] % width
    ends = pa.array(np.append(starts, len(keys)), pa.int32())
    columns = [pa.array(buckets, pa.int32()), *(pa.ListArray.from_arrays(ends, pa.array(x, k)) for x, k in ((steps, pa.int16()), (n, pa.int64())))]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "steps", "n"])


def _summed(packed: DataFrame, width: int, finish: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Packed counts dealt by bucket and added up; ``finish`` makes rows of the ``width`` sums of a bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = defaultdict(lambda: np.zeros(width, "int64"))
        for batch in batches:
            for row, bucket in enumerate(batch.column("bucket").to_pylist()):
                steps, n = (batch.column(c)[row].values.to_numpy() for c in ("steps", "n"))
                sums[bucket][np.cumsum(steps)] += n
        yield from (finish(bucket, line) for bucket, line in sums.items())

    return packed.repartition("bucket").mapInArrow(add, schema)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: units move, most frequent first, to where the bigram likelihood gains most.

    The end mark keeps class 0 for itself. Deterministic; ends when a sweep moves nothing.
    """
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = [u for u in np.argsort(-weight, kind="stable") if u and weight[u]]
    of = np.zeros(len(bigrams), "int64")
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    idle = [u for u in range(1, len(bigrams)) if not weight[u]]
    of[idle] = classes - 1
    member = np.zeros((len(bigrams), classes))
    member[np.arange(len(bigrams)), of] = 1.0
    after, before = bigrams @ member, bigrams.T @ member  # by unit: words that follow, that come before
    table = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for u in order:
            home, out, into, own = of[u], after[u].copy(), before[u].copy(), bigrams[u, u]
            # Take the unit out; its own repetitions are placed with it.
            out[home] -= own
            into[home] -= own
            table[home, :] -= out
            table[:, home] -= into
            table[home, home] -= own
            rows, columns = table.sum(1), table.sum(0)
            gain = (_xlogx(table + out[None, :]) - _xlogx(table)).sum(1) + (_xlogx(table + into[:, None]) - _xlogx(table)).sum(0)
            at = np.arange(classes)
            inner = table[at, at]
            gain += _xlogx(inner + out + into + own) + _xlogx(inner) - _xlogx(inner + out) - _xlogx(inner + into)
            gain -= _xlogx(rows + out.sum() + own) - _xlogx(rows) + _xlogx(columns + into.sum() + own) - _xlogx(columns)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[home] + 1e-9:
                best = int(home)
            table[best, :] += out
            table[:, best] += into
            table[best, best] += own
            if best != home:
                moved += 1
                of[u] = best
                for sums, line in ((after, bigrams[:, u]), (before, bigrams[u, :])):
                    sums[:, home] -= line
                    sums[:, best] += line
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """All tables of the model; their size depends on the numbers of units and classes alone."""

    own: dict[str, int]
    of: np.ndarray
    step: np.ndarray  # log10 P(class | class before)
    tokens: np.ndarray  # by class
    discount: np.ndarray
    unseen: np.ndarray  # log10 of the mass for words not seen in training
    train_tokens: int
    types: int
    end_count: int
    stats: np.ndarray  # by class: tokens, types, types seen once and twice
    placed: dict[str, int]  # classes of frequent words beside ``own``

    def word_scores(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        seen = np.log10(np.maximum(counts - self.discount[classes], 1e-9)) - np.log10(np.maximum(self.tokens[classes], 1.0))
        return np.where(counts > 0, seen, self.unseen[classes])


def _ending() -> Column:
    """Unit of a word's ending."""
    return F.lit(1 + OWN_WORDS) + F.crc32(F.right("word", F.lit(3)).cast("binary")) % ENDINGS


def _stats() -> list[Column]:
    """Tokens, types, types seen once and twice."""
    return [F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")]


def fit_class_model(blocks: DataFrame, vocabulary: DataFrame, train_docs: int) -> ClassModel:
    """``vocabulary`` has ``word, n`` of all training words. The driver gets sums by unit and unit pairs only."""
    top = vocabulary.orderBy(F.desc("n"), "word").limit(OWN_WORDS).collect()
    own = {r["word"]: 1 + i for i, r in enumerate(top)}
    rare = vocabulary.filter(~F.col("word").isin(list(own))) if own else vocabulary
    stats = rare.groupBy(_ending().alias("unit")).agg(*_stats())
    by_unit = np.zeros((UNITS, 4))
    for r in stats.collect():
        by_unit[r["unit"]] = r["n"], r["types"], r["n1"], r["n2"]
    for i, r in enumerate(top):
        by_unit[1 + i] = r["n"], 1, r["n"] == 1, r["n"] == 2
    if train_docs:
        by_unit[0] = train_docs, 1, 0, 0
    bigrams = unit_bigrams(blocks, own)
    of = exchange(bigrams)
    member = np.zeros((UNITS, CLASSES))
    member[np.arange(UNITS), of] = 1.0
    return _model(own, of, member.T @ by_unit, member.T @ bigrams @ member, train_docs, {})


def _model(own: dict[str, int], of: np.ndarray, by_class: np.ndarray, table: np.ndarray, train_docs: int, placed: dict[str, int]) -> ClassModel:
    """The model of class counts (tokens, types, types seen once and twice) and of the bigrams of classes."""
    n, types, n1, n2 = by_class.T
    discount = np.clip(np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1.0), 0.1), 0.1, 0.95)
    discount[0] = 0.0
    with np.errstate(divide="ignore"):
        unseen = np.where(n > 0, np.log10(np.maximum(discount * types, 1e-9)) - np.log10(np.maximum(n, 1.0)), 0.0)
    share = (table.sum(0) + 1.0) / (table.sum() + CLASSES)
    step = np.log10((table + STRENGTH * share[None, :]) / (table.sum(1, keepdims=True) + STRENGTH))
    return ClassModel(own, of, step, n, discount, unseen, int(n.sum()), int(types.sum()), train_docs, by_class, placed)


def place_words(blocks: DataFrame, vocabulary: DataFrame, model: ClassModel) -> tuple[dict[str, int], dict[str, int]]:
    """Classes and training counts of the frequent words beside the units, after a distributed exchange round."""
    least = max(FREQUENT, -(-model.train_tokens // ONE_IN))
    listed = vocabulary.filter(F.col("n") >= least).select("word", "n").toArrow()  # at most ONE_IN words
    counts = {w: n for w, n in sorted(zip(listed["word"].to_pylist(), listed["n"].to_pylist(), strict=True)) if w not in model.own}
    words = list(counts)
    shared = blocks.sparkSession.sparkContext.broadcast((model.own, model.of, {w: i for i, w in enumerate(words)}))
    gains = _gains(model)

    def placed(bucket: int, sums: np.ndarray) -> pa.RecordBatch:
        lines = sums.reshape(-1, 2 * CLASSES)
        met = np.flatnonzero(lines.any(axis=1))
        best = np.argmax(lines[met] @ gains, axis=1)  # ties: the smallest class
        return pa.RecordBatch.from_arrays([pa.array(met + bucket * len(lines), pa.int32()), pa.array(best, pa.int32())], names=["word", "class"])

    beside = blocks.select("held_out", "ends", "codes", "words").mapInArrow(_neighbours(shared), _PACKED)
    best = _summed(beside, WORD_BUCKET, placed, "word int, class int").toArrow()
    return {words[w]: c for w, c in zip(best["word"].to_pylist(), best["class"].to_pylist(), strict=True)}, counts


def place_rare_words(blocks: DataFrame, model: ClassModel, frequent: dict[str, int]) -> DataFrame:
    """``word, n, class`` of all training words beside the units and ``frequent``, by the rule of ``place_words``.

    Each block sends a word once with the classes around it; a task sums them word by word in a sorted stream.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((model.own, model.of, frozenset(frequent)))
    gains = _gains(model).astype(float)  # sums of whole numbers below 2 ** 53 are exact

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(2 * CLASSES)

        def row(words: list[str], sums: np.ndarray) -> pa.RecordBatch:
            found = np.argmax(sums @ gains, axis=1).astype("int8")  # ties: the smallest class
            n = (sums.sum(axis=1) / 2).astype("int64")  # each occurrence has two neighbours
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n), pa.array(found)], names=["word", "n", "class"])

        for batch in (part for whole in batches for part in sliced(whole, 2000) if part.num_rows):
            grouped, met = batch.column("word").dictionary_encode(), batch.column("met").cast(pa.binary())
            ends = np.frombuffer(met.buffers()[1], "int32")[met.offset : met.offset + len(met) + 1]
            words = grouped.dictionary.to_pylist()  # sorted rows: the rows of a word are together
            group = np.repeat(grouped.indices.to_numpy(), np.diff(ends))
            keys = group * np.int64(2 * CLASSES) + np.frombuffer(met.buffers()[2], "uint8")[ends[0] : ends[-1]]
            sums = np.bincount(keys, minlength=len(words) * 2 * CLASSES).reshape(-1, 2 * CLASSES).astype(float)
            if words[0] == last:
                sums[0] += held
            elif last is not None:
                yield row([last], held[None, :])
            yield row(words[:-1], sums[:-1])
            last, held = words[-1], sums[-1]
        if last is not None:
            yield row([last], held[None, :])

    beside = blocks.select("held_out", "ends", "codes", "words").mapInArrow(_rare_neighbours(shared), "word string, met binary")
    return beside.repartition("word").sortWithinPartitions("word").mapInArrow(best, "word string, n long, class byte")


def _rare_neighbours(shared):
    """Each rare word of a block with a byte for every neighbour: class before, or 48 + class after."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, frequent = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, b=batch, r=row: b.column(name)[r].values
                words = get("words").to_pylist()
                classes = of[np.append(_units(words, own), 0)].astype("uint8")
                rare = np.array([*(w not in own and w not in frequent for w in words), False], bool)
                train = ~np.array(get("held_out").to_pylist(), bool)
                met, around_met = [np.zeros(0, "int32")], [np.zeros((0, 2), "uint8")]
                for docs, sizes, codes in _pieces(get("codes").to_numpy(), get("ends").to_numpy(), len(words)):
                    here = np.flatnonzero(np.repeat(train[docs], sizes) & rare[codes])  # no end mark, so a token comes after
                    around = classes[codes]
                    before = np.where(here > 0, around[here - 1], np.uint8(0))
                    met.append(codes[here])
                    around_met.append(np.stack([before, np.uint8(CLASSES) + around[here + 1]], axis=1))
                found = np.concatenate(met)
                order = np.argsort(found, kind="stable")
                data = np.concatenate(around_met)[order].tobytes()
                at, starts = np.unique(found[order], return_index=True)
                offsets = 2 * np.append(starts, len(found)).astype("int32")
                listed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([get("words").take(pa.array(at)).cast(pa.string()), listed], names=["word", "met"])

    return count


def _square(counts: DataFrame) -> np.ndarray:
    """Rows of ``slot, n`` as the table of class bigrams."""
    table = np.zeros(CLASSES * CLASSES)
    for r in counts.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most CLASSES ** 2 rows
        table[r["slot"]] = r["n"]
    return table.reshape(CLASSES, CLASSES)


def _gains(model: ClassModel) -> np.ndarray:
    """What one neighbour adds for each class: a class before (first ``CLASSES`` lines) or after (the others).

    Before: log of the step into the class and of a word's share of it; after: log of the step out of it. Shares are held
    against a tenth of a mean class more, so that small classes do not draw every word. No word joins the end mark.
    """
    step = model.step * np.log(10.0)
    size = model.tokens + model.tokens.sum() / CLASSES / 10 + 1.0
    gains = np.concatenate([step - np.log(size)[None, :], step.T])
    gains = np.round(gains * GAIN_UNIT).astype("int64")
    gains[:, 0] = -1000 * GAIN_UNIT
    return gains


def _neighbours(shared):
    """Packed counts of each frequent word's neighbours: key word * 96 + class before, or + 48 + class after."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, frequent = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, b=batch, r=row: b.column(name)[r].values
                words = get("words").to_pylist()
                classes = of[np.append(_units(words, own), 0)].astype("int32")
                number = np.array([*(frequent.get(w, -1) for w in words), -1], "int32")
                train = ~np.array(get("held_out").to_pylist(), bool)
                met = []
                for docs, sizes, codes in _pieces(get("codes").to_numpy(), get("ends").to_numpy(), len(words)):
                    here = np.flatnonzero(np.repeat(train[docs], sizes) & (number[codes] >= 0))  # no end mark, so a token comes after
                    around = classes[codes]
                    at = number[codes[here]] * np.int32(2 * CLASSES)  # below ONE_IN * 96
                    before = np.where(here > 0, around[here - 1], np.int32(0))
                    met += [at + before, at + np.int32(CLASSES) + around[here + 1]]
                keys, n = np.unique(np.concatenate(met), return_counts=True)
                del met
                yield _packed(keys, n, WORD_BUCKET)

    return count


def _word_classes(words: list[str], own: dict[str, int], of: np.ndarray, placed: dict[str, int]) -> np.ndarray:
    """Class of each word, rare and unseen ones by their ending; the end mark comes last."""
    found = np.array([*(placed.get(w, -1) for w in words), 0], "int64")
    return np.where(found >= 0, found, of[np.append(_units(words, own), 0)])


def refitted(lines: DataFrame, fitted: ClassModel) -> ClassModel:
    """The model with class bigrams counted anew, over ``lines`` with the final classes of all tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES * CLASSES, "int64")
        for batch in batches:
            for row in range(batch.num_rows):
                train = ~np.array(batch.column("held_out")[row].values.to_pylist(), bool)
                for docs, sizes, line, _ in _lines(batch, row):
                    table += _bigrams(line, np.repeat(train[docs], sizes), CLASSES)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at])], names=["slot", "n"])

    table = _square(lines.select("held_out", "sizes", "line").mapInArrow(count, "slot int, n long"))
    return _model(fitted.own, fitted.of, fitted.stats, table, fitted.end_count, fitted.placed)


def _lines(batch: pa.RecordBatch, row: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Like ``_pieces``: which documents, their sizes, the classes of their tokens, and where each begins in them."""
    line = np.frombuffer(batch.column("line")[row].as_buffer(), "uint8")
    sizes = batch.column("sizes")[row].values.to_numpy()
    ends = np.cumsum(sizes, dtype="int64")
    first = start = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, start + PIECE, "right")))
        yield slice(first, last), sizes[first:last], line[start : ends[last - 1]].astype("int64"), ends[first:last] - sizes[first:last] - start
        first, start = last, int(ends[last - 1])


def moved(model: ClassModel, known: DataFrame, placed: dict[str, int], counts: dict[str, int]) -> ClassModel:
    """The model with word counts moved to the words' own classes; ``known`` has the rarer words: ``word, n, class``."""
    stats = model.stats.copy()
    for word, to in placed.items():
        sums = counts[word], 1, counts[word] == 1, counts[word] == 2
        stats[model.of[unit_of(word, model.own)]] -= sums
        stats[to] += sums
    moves = known.groupBy(_ending().alias("unit"), "class").agg(*_stats()).collect()  # at most ENDINGS * CLASSES rows
    for r in moves:
        sums = np.array([r["n"], r["types"], r["n1"], r["n2"]])
        stats[model.of[r["unit"]]] -= sums
        stats[r["class"]] += sums
    return _model(model.own, model.of, stats, np.zeros((CLASSES, CLASSES)), model.end_count, placed)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: str = "held_out") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Learns from the rows whose ``held_out`` is false or null and scores all. Tokens are words lower-cased in A-Z and an end mark.
    ``base_score`` is add-one unigrams; ``score`` is the class model. In both, unseen words count as one type
    (of each class in the model): log10 probabilities. Null and empty texts have
    the end mark only. Repeated rows count each and score alike. Without training rows everything is
    unseen. An empty table gives an empty one. Other columns are not looked at.
    """
    with small_batches(docs.sparkSession, BATCH_BYTES):
        lines, model = _learnt(only(docs, doc_id=doc_id, text=text, held_out=held_out))
    return lines.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(astuple(model))), _SCORES)


def _learnt(rows: DataFrame) -> tuple[DataFrame, ClassModel]:
    """All blocks as lines of classes, and the model."""
    rows = rows.withColumns({"doc_id": F.col("doc_id").cast("long"), "held_out": F.coalesce("held_out", F.lit(False))})
    blocks = materialise(encode_blocks(rows), FILE_BLOCKS)
    listed = blocks.select(F.explode(F.arrays_zip("words", "n_train")).alias("w"))
    vocabulary = materialise(listed.filter("w.n_train > 0").groupBy(F.col("w.words").alias("word")).agg(F.sum("w.n_train").alias("n")))
    train_docs = blocks.select(F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()[0] or 0
    first = fit_class_model(blocks, vocabulary, int(train_docs))
    placed, frequent = place_words(blocks, vocabulary, first)
    known = materialise(place_rare_words(blocks, first, frequent))
    context = rows.sparkSession.sparkContext
    fitted = moved(first, known, placed, frequent)
    top = vocabulary.filter(F.col("word").isin(list(first.own))).collect() if first.own else []
    numbers = {**frequent, **{r["word"]: r["n"] for r in top}}
    shared = context.broadcast((first.own, first.of, placed, numbers))
    # Words become classes and counts before the blocks are shuffled; only rarer ones, which are not broadcast, are joined by word.
    listed = blocks.select("block", "words").mapInArrow(_others(shared), "block long, code int, word string").join(known, "word")
    lists = [F.collect_list(c).alias(to) for c, to in (("code", "known"), ("n", "counts"), ("class", "placed"))]
    rarer = listed.groupBy("block").agg(*lists)
    classed = blocks.drop("n_train").mapInArrow(_classed(shared), _CLASSED).join(rarer, "block", "left")
    lines = materialise(classed.mapInArrow(_emitter(context.broadcast(astuple(fitted))), _LINES))
    return lines, refitted(lines, fitted)


_CLASSED = "block long, doc_ids array<long>, held_out array<boolean>, ends array<int>, codes binary, classes array<byte>, n array<long>"
_LINES = "doc_ids array<long>, held_out array<boolean>, sizes array<int>, n_known array<long>, base array<double>, emitted array<double>, line binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _others(shared):
    """Words of each block that are not broadcast."""

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value[3]
        for batch in batches:
            for row, block in enumerate(batch.column("block").to_pylist()):
                words = batch.column("words")[row].values
                found = np.flatnonzero([w not in numbers for w in words.to_pylist()])
                columns = [pa.array(np.full(len(found), block), pa.int64()), pa.array(found, pa.int32()), words.take(pa.array(found)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "code", "word"])

    return others


def _classed(shared):
    """Blocks with classes and counts of words; those of rarer words are by their ending, and 0, until ``_known`` sets them."""

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, placed, numbers = shared.value
        for row in (part for whole in batches for part in sliced(whole, 1)):
            words = row.column("words")[0].values.to_pylist()
            classes = _word_classes(words, own, of, placed).astype("int8")
            n = np.array([*(numbers.get(w, 0) for w in words), 0], "int64")
            codes = row.column("codes")[0].values.to_numpy().astype(_width(classes)).tobytes()
            names = ["block", "doc_ids", "held_out", "ends"]
            added = [pa.array([codes], pa.binary()), pa.array([classes], pa.list_(pa.int8())), pa.array([n], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in names), *added], names=[*names, "codes", "classes", "n"])

    return classed


def _width(classes: np.ndarray) -> str:
    """Type of a block's codes in bytes: two of them for most blocks."""
    return "<u2" if len(classes) <= 1 << 16 else "<i4"


def _codes(batch: pa.RecordBatch, row: int) -> np.ndarray:
    return np.frombuffer(batch.column("codes")[row].as_py(), _width(batch.column("classes")[row].values)).astype("int32")


def _known(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Final classes and training counts of a block's words; the end mark comes last, its count is left 0."""
    classes = batch.column("classes")[row].values.to_numpy().astype("int64")
    counts = batch.column("n")[row].values.to_numpy().copy()
    if batch.column("known")[row].is_valid:
        at, n, placed = (batch.column(c)[row].values.to_numpy() for c in ("known", "counts", "placed"))
        counts[at] = n
        classes[at] = placed
    return classes, counts


def _emitter(shared):
    """Per document all that does not depend on class bigrams, and the classes of its tokens for what does."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ClassModel(*shared.value)  # a broadcast of an own class would need this package on executors
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, b=batch, r=row: b.column(name)[r].values
                classes, counts = _known(batch, row)
                counts[-1] = model.end_count
                base = np.log10((counts + 1.0) / (model.train_tokens + model.types + 1.0))
                emitted = model.word_scores(counts, classes)
                seen, small, totals, line = (counts > 0).astype("int64"), classes.astype("uint8"), [], []
                for _, sizes, codes in _pieces(_codes(batch, row), get("ends").to_numpy(), len(counts) - 1):
                    starts = np.cumsum(sizes) - sizes
                    totals.append([sizes, *(np.add.reduceat(x[codes], starts) for x in (seen, base, emitted))])
                    line.append(small[codes].tobytes())
                columns = [pa.array([np.concatenate(x)], pa.list_(k)) for x, k in zip(zip(*totals, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                names = ["doc_ids", "held_out", "sizes", "n_known", "base", "emitted", "line"]
                kept = [batch.column(c).slice(row, 1) for c in names[:2]]
                yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array([b"".join(line)], pa.binary())], names=names)

    return emit


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ClassModel(*shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, b=batch, r=row: b.column(name)[r].values
                steps = [np.add.reduceat(model.step[np.concatenate([now[:0], [0], now[:-1]]), now], starts) for _, _, now, starts in _lines(batch, row)]
                sizes, score = get("sizes").to_numpy(), get("emitted").to_numpy() + np.concatenate(steps)
                columns = [get("doc_ids"), get("held_out"), pa.array(sizes, pa.int64()), get("n_known"), pa.array(np.full(len(sizes), model.train_tokens))]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([*columns, get("base"), pa.array(score)], names=names)

    return score
