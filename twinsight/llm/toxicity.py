"""Toxicity of texts that hide their words: noisy-channel restoration, then a learned lexicon.

A character model of the whole corpus (trigrams) is the language model, a table of common disguises the
channel. A word that could be disguised (digits or symbols in it, long repetitions) is a lattice of readings, and
Viterbi finds the likeliest one. Words whose border the model would rather not see (spaced letters, split words) are
a lattice too, in which each blank is dropped or kept. Distinct restored
words are scored with the log-odds of words and word beginnings and endings that are significantly
more frequent in documents labelled toxic, and a logistic curve turns the sum into a probability.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise
from twinsight.llm.text import only, sliced, texts, worker_state
from twinsight.llm.vocabulary import Remembered

#: Labelled ids that the lexicon is learned from at most (those with the least hash).
LABELLED_ROWS = 40_000
#: Distinct words that a task counts before it turns them into features.
HELD_WORDS = 500_000
#: Entries of the lexicon at most (the most significant ones).
LEXICON = 20_000
THRESHOLD = 0.3

# What a symbol may stand for.
DISGUISES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
# Costs of the channel in nats: reading a symbol as a letter, dropping it (digits stay instead), shortening a repetition.
READ, DROP, SHORTEN = 1.0, 2.5, 0.7
# A digit of a number that is meant as one (ln 10). A mark at the edge of a word: read as a letter besides READ; dropped where
# it usually stands; dropped elsewhere. A blank: dropped; dropped between single characters; kept between them.
NUMBER, EDGE_READ, EDGE_DROP, STRANGE = 2.3, 0.5, 1.0, 6.0
BLANK, JOIN, KEEP = 4.0, 0.2, 1.0
#: Marks around a word that cannot be letters. Marks that can are usual before a word, after one, as money beside a digit.
_EDGES = ".,;:?\"')[]{}>*#%&~`_-=/\\"
_BEFORE, _AFTER, _MONEY = "(<|+", "!|+", "$€£"

#: Symbols of the character model: 0 edge of a word, 1 anything else, then a to z and the Latin-1 small letters.
SYMBOLS = 64
_LONG_RUN = re.compile(r"(.)\1\1", re.DOTALL)


def symbol_ids() -> np.ndarray:
    """Model symbol of each code point below 256."""
    ids = np.ones(256, "int64")
    ids[ord("a") : ord("z") + 1] = np.arange(2, 28)
    small = [c for c in range(0xDF, 0x100) if c != 0xF7]
    ids[small] = np.arange(28, 28 + len(small))
    ids[[9, 10, 11, 12, 13, 32]] = 0
    return ids


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each trigram of symbols occurs in the whole corpus; at most 64 ** 3 sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = symbol_ids(), np.zeros(SYMBOLS**3, "int64")
        for batch in (part for whole in batches for part in sliced(whole, 200)):
            text = b"\n".join([t for t in texts(batch.column("text")) if t]).decode().lower()
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            s = np.concatenate([[0, 0], ids[np.minimum(points, 255)] * (points < 256) + (points >= 256), [0]])
            # An edge starts a new word: nothing before it counts.
            before = np.where(s[1:-1] == 0, 0, s[:-2])
            total += np.bincount(before * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["trigram", "n"])

    found = docs.select("text").mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for trigram, n in found:
        counts[trigram] = n
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class CharacterModel:
    """Interpolated trigram costs in nats."""

    def __init__(self, counts: np.ndarray, strength: float = 5.0):
        ones = counts.sum(axis=(0, 1)) + 1.0
        ones = ones / ones.sum()
        twos = counts.sum(axis=0)
        twos = (twos + strength * ones) / (twos.sum(axis=1, keepdims=True) + strength)
        threes = (counts + strength * twos[None]) / (counts.sum(axis=2, keepdims=True) + strength)
        self.counts, self.cost = counts, -np.log(threes)
        self.costs = self.cost.ravel().tolist()
        self.ids = symbol_ids().tolist()
        # What each character may be taken for where words meet: its first reading, its last reading.
        self.letters = [symbol_ids(), symbol_ids()]
        for at, letters in zip((0, -1), self.letters, strict=True):
            for symbol, stands_for in DISGUISES.items():
                if ord(symbol) < 255:
                    letters[ord(symbol)] = letters[ord(stands_for[at])]
        # Marks in their usual place say nothing of a split word.
        self.worded = [np.array([chr(p) not in usual for p in range(256)]) for usual in (_AFTER, _BEFORE)]

    def restore(self, word: str) -> str:
        """The likeliest reading of a lower-case word."""
        core = word.strip(_EDGES)
        if core.isalpha() and not _LONG_RUN.search(core):
            return core
        runs = [(c, len(list(same))) for c, same in groupby(core)]
        readings = [self._likeliest(self._lattice(core))]
        if not any(c.isalpha() for c in core) and any(c.isdigit() for c in core):  # or a plain number
            number = word.strip(_EDGES + "".join(DISGUISES.keys() - set("0123456789")))
            first, last = self._ends(runs)
            price = sum(self._edge_price(runs, i) for i in range(len(runs)) if not first <= i <= last)
            readings.append(self._likeliest([*[[(c, NUMBER if c.isdigit() else 0.0)] for c in number], [("", price)]]))
        return min(readings)[1]

    def rejoin(self, run: str) -> list[str]:
        """The likeliest words behind the words of ``run``, whose blanks may be dropped."""
        pieces = run.split(" ")
        lattice = self._lattice(pieces[0].strip(_EDGES))
        for left, right in zip(pieces, pieces[1:], strict=False):
            single = len(left) == len(right) == 1
            lattice.append([("", JOIN), (" ", KEEP)] if single else [("", BLANK), (" ", 0.0)])
            lattice += self._lattice(right.strip(_EDGES))
        return self._likeliest(lattice)[1].split()

    def open_borders(self, points: np.ndarray, blanks: np.ndarray) -> np.ndarray:
        """Which of the blanks of a text (words parted by one blank, a blank before and two after it) a lattice may drop:
        those that cost more than a join, going by the letters around them, and those between single characters."""
        around = np.minimum(points[blanks[:, None] + np.array([-2, -1, 1, 2])], 255)
        found = np.zeros(len(blanks), bool)
        for letters in self.letters if (around == ord("1")).any() or (around == ord("|")).any() else self.letters[:1]:
            x, y, c, d = letters[around].T
            x = np.where(around[:, 0] == 32, 0, x)
            apart = self.cost[x, y, 0] + self.cost[0, 0, c] + self.cost[0, c, d]
            single = (x == 0) & (d == 0)
            worded = self.worded[0][around[:, 1]] & self.worded[1][around[:, 2]]
            split = worded & (apart > BLANK + self.cost[x, y, c] + self.cost[y, c, d])
            found |= (y > 1) & (c > 1) & (single | split)
        return found

    def _likeliest(self, lattice: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """Cost and text of the best way through a lattice."""
        costs, ids = self.costs, self.ids
        states = {(0, 0): (0.0, "")}
        for options in lattice:
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in states.items():
                for reading, price in options:
                    x, y, total = a, b, cost + price
                    for c in reading:
                        point = ord(c)
                        z = ids[point] if point < 256 else 1
                        total += costs[x << 12 | y << 6 | z]
                        x, y = (y, z) if z else (0, 0)
                    at = (x, y)
                    if at not in after or total < after[at][0]:
                        after[at] = (total, text + reading)
            states = after
        return min((cost + costs[a << 12 | b << 6], text) for (a, b), (cost, text) in states.items())

    def _lattice(self, core: str) -> list[list[tuple[str, float]]]:
        """The readings of each run of a character in a word."""
        if core.isalpha():
            return [self._readings(c, len(list(same))) for c, same in groupby(core)]
        runs = [(c, len(list(same))) for c, same in groupby(core)]
        first, last = self._ends(runs)
        lettered, lattice = any(c.isalpha() for c in core), []
        for i, (letter, n) in enumerate(runs):
            options = self._readings(letter, n)
            if not first <= i <= last:
                options = [*[(text, cost + EDGE_READ) for text, cost in options if text], ("", self._edge_price(runs, i))]
            elif letter.isdigit() and not lettered and letter in DISGUISES:
                options = options[:-1]  # a number as such is a reading of its own
            lattice.append(options)
        return lattice

    @staticmethod
    def _ends(runs: list[tuple[str, int]]) -> tuple[int, int]:
        """The first and the last run that are not marks at an edge."""
        inside = [i for i, (c, _) in enumerate(runs) if c.isalnum()]
        return (inside[0], inside[-1]) if inside else (len(runs), -1)

    @staticmethod
    def _edge_price(runs: list[tuple[str, int]], i: int) -> float:
        """What it costs to drop a mark before or after a word."""
        (letter, _), first = runs[i], CharacterModel._ends(runs)[0]
        beside = i + 1 if i < first else i - 1
        money = letter in _MONEY and 0 <= beside < len(runs) and runs[beside][0].isdigit() and (i < first or letter != "$")
        return EDGE_DROP if money or letter in (_BEFORE if i < first else _AFTER) or letter not in DISGUISES else STRANGE

    @staticmethod
    def _readings(letter: str, n: int) -> list[tuple[str, float]]:
        if letter.isalpha():
            if n == 1:
                return [(letter, 0.0)]
            return [(letter * 2, 0.0 if n == 2 else SHORTEN), (letter, SHORTEN)]
        stands_for = DISGUISES.get(letter, "")
        read = [(x, READ + (SHORTEN if n > 1 else 0.0)) for x in stands_for]
        read += [(x * 2, READ + (SHORTEN if n > 2 else 0.0)) for x in stands_for if n > 1]
        if letter.isdigit():
            return [*read, (letter * n, READ + DROP)]
        return [*read, ("", DROP / n)]


class Reader:
    """The distinct words of a text, and those that it hides by blanks."""

    def __init__(self, characters: CharacterModel):
        self.characters = characters
        self.rejoined = Remembered(self._new_words)

    def __call__(self, data: bytes | None) -> set[bytes]:
        words = (data.lower() if data.isascii() else data.decode().lower().encode()).split() if data else []
        if len(words) < 2:
            return set(words)
        joined = b" ".join([b"", *words, b"", b""])
        if joined.isascii():
            points = np.frombuffer(joined, "u1")
        else:
            points = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
        blanks = np.flatnonzero(points == 32)
        single = np.diff(blanks[:-1]) == 2
        spaced = (single[2:] & single[1:-1] & single[:-2]).any()
        found = set(_rejoined(words) if spaced else words)
        blanks = blanks[1:-2]
        last = -2
        runs: list[list[bytes]] = []
        for at in np.flatnonzero(self.characters.open_borders(points, blanks)).tolist():
            if at != last + 1:
                runs.append([words[at]])
            runs[-1].append(words[at + 1])
            last = at
        for run in map(b" ".join, runs):
            found.update(self.rejoined[run] if len(run) <= 64 else self._new_words(run))
        return found

    def _new_words(self, run: bytes) -> tuple[bytes, ...]:
        words = [w.encode() for w in self.characters.rejoin(run.decode())]
        return tuple(set(words) - set(run.split()))


def _rejoined(words: list[bytes]) -> Iterator[bytes]:
    """The words; single letters spaced out are joined to one."""
    for single, run in groupby(words, lambda w: len(w) == 1 or len(w) == 2 and w[0] >= 0xC2):
        run = list(run)
        yield from [b"".join(run)] if single and len(run) > 2 else run


def word_features(word: str) -> list[int]:
    """Hashes of a restored word, its beginnings and its ending."""
    if len(word) < 3:
        return []
    marks = ["=" + word, ">" + word[-4:], *["<" + word[:n] for n in range(4, min(len(word), 8) + 1)]]
    return [xxhash.xxh3_64_intdigest(m) - (1 << 63) for m in marks]


class ToxicityModel:
    """Character model, weight per feature hash, and the logistic curve over the sum and the top of a text's weights."""

    def __init__(self, characters: CharacterModel, weights: dict[int, float], curve: tuple[float, float, float]):
        self.characters, self.weights, self.curve = characters, weights, curve

    def plain(self) -> tuple:
        """What a broadcast carries: tables without classes of this package, which executors need not have."""
        return self.characters.counts, self.weights, self.curve

    @staticmethod
    def of(plain: tuple) -> ToxicityModel:
        counts, weights, curve = plain
        return ToxicityModel(CharacterModel(counts), weights, curve)

    def word_weight(self, word: bytes) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for f in word_features(self.characters.restore(word.decode()))), key=abs, default=0.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic; 0 or 1, other values are ignored).

    The character model counts all texts. The lexicon is learned from the rows of at most ``LABELLED_ROWS`` labelled ids, however often an id
    repeats; what reaches the driver is bound by ``LEXICON`` and by the alphabet. Without labels of both kinds the probability is the share of label 1.
    """
    characters = CharacterModel(trigram_counts(docs))
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    rows = docs.join(F.broadcast(known), "doc_id").select("text", "toxic")
    shared, version = docs.sparkSession.sparkContext.broadcast(characters.counts), uuid.uuid4().hex

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_state("characters", lambda: CharacterModel(shared.value), version)
        read, met = Reader(model), (Counter(), Counter())
        totals = np.zeros((2, 2), "int64")  # feature 0 counts distinct words, feature 1 rows

        def counted() -> pa.RecordBatch:
            seen = tuple(Counter({f: int(n) for f, n in enumerate(row) if n}) for row in totals)
            for words, found in zip(met, seen, strict=True):
                for word, n in words.items():
                    for feature in word_features(model.restore(word.decode())):
                        found[feature] += n
                words.clear()
            totals[:] = 0
            every = sorted(seen[0].keys() | seen[1].keys())
            columns = [pa.array(every, "int64"), *[pa.array([c[f] for f in every], "int64") for c in seen]]
            return pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])

        for batch in (part for whole in batches for part in sliced(whole)):
            for data, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                words = read(data)
                met[toxic].update(words)
                totals[toxic] += len(words), 1
            if len(met[0]) + len(met[1]) > HELD_WORDS:
                yield counted()
        yield counted()

    counted = rows.mapInArrow(features, "feature long, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    counted = counted.filter("feature IN (0, 1) OR toxic > 2").persist()
    totals = {r["feature"]: (float(r["clean"]), float(r["toxic"])) for r in counted.filter("feature IN (0, 1)").collect()}
    clean, toxic = totals.get(0, (0.0, 0.0))
    clean_rows, toxic_rows = totals.get(1, (0.0, 0.0))
    weights: dict[int, float] = {}
    if clean and toxic:
        bar = 2.0 * math.log(max(counted.count(), 2))
        share = toxic / (clean + toxic)
        n, k = F.col("clean") + F.col("toxic"), F.col("toxic")
        gain = 2 * (_log_times(k, k / (n * share)) + _log_times(n - k, (n - k) / (n * (1 - share))))
        weight = F.log((k + 0.5) / (toxic + 1)) - F.log((n - k + 0.5) / (clean + 1))
        best = counted.filter("feature NOT IN (0, 1)").select("feature", weight.alias("w"), gain.alias("g"))
        best = best.filter((F.col("g") > bar) & (F.col("w") > 0))
        weights = {r["feature"]: r["w"] for r in best.orderBy(F.desc("g"), "feature").limit(LEXICON).collect()}
    counted.unpersist()
    model = ToxicityModel(characters, weights, (0.0, 0.0, math.log((toxic_rows + 0.5) / (clean_rows + 0.5))))
    if weights:
        groups = evidence(rows, model, "toxic").groupBy("total", "top", "toxic").agg(F.count(F.lit(1)).alias("n"))
        model.curve = _logistic(materialise(groups))
    return model


def _log_times(n, ratio):
    return F.when(n > 0, n * F.log(ratio)).otherwise(0.0)


def _logistic(groups: DataFrame, ridge: float = 0.01, rounds: int = 50) -> tuple[float, float, float]:
    """Slopes of ``total`` and ``top`` and the offset for ``toxic``, by Newton's method with a small ridge on the slopes.

    ``groups`` has ``n`` rows of each kind. A round is one aggregate of nine sums.
    """
    penalty = np.array([ridge, ridge, 1e-6])
    at = np.zeros(3)
    x = [F.col("total"), F.col("top"), F.lit(1.0)]
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    for _ in range(rounds):
        odds = sum((v * F.lit(float(w)) for v, w in zip(x, at, strict=True)), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
        rows = groups.select("*", p.alias("p"))
        slopes = [F.sum(F.col("n") * (F.col("p") - F.col("toxic")) * v) for v in x]
        bends = [F.sum(F.col("n") * F.col("p") * (1 - F.col("p")) * x[i] * x[j]) for i, j in upper]
        sums = np.array(rows.agg(*slopes, *bends).first(), "float64")
        gradient, curve = sums[:3] + penalty * at, np.diag(penalty)
        for (i, j), value in zip(upper, sums[3:], strict=True):
            curve[i, j] += value
            if i != j:
                curve[j, i] += value
        step = np.clip(np.linalg.solve(curve, gradient), -2.0, 2.0)
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in at)


def evidence(rows: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """``keep`` columns, ``total`` and ``top``: sum and maximum of the weights of a text's distinct restored words."""
    shared = rows.sparkSession.sparkContext.broadcast(model.plain())  # alphabet and lexicon are bounded
    version = uuid.uuid4().hex

    def build() -> tuple[Remembered, Reader]:
        known = ToxicityModel.of(shared.value)
        return Remembered(known.word_weight), Reader(known.characters)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, read = worker_state("toxicity", build, version)
        for batch in (part for whole in batches for part in sliced(whole)):
            weights = [list(map(table.__getitem__, read(data))) for data in texts(batch.column("text"))]
            columns = [pa.array([math.fsum(w) for w in weights], "float64"), pa.array([max(w, default=0.0) for w in weights], "float64")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, "total", "top"])

    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep], "total double, top double"])
    return rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(weigh, schema)


def probability(model: ToxicityModel) -> Column:
    """The logistic curve over the columns of ``evidence``."""
    on_total, on_top, offset = model.curve
    odds = F.col("total") * F.lit(on_total) + F.col("top") * F.lit(on_top) + F.lit(offset)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds))))


def score_toxicity(df: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``df``.

    Null and empty texts have no evidence and get the score of that. Repeated rows score alike; an empty table
    gives an empty one. Only the text enters the score; other columns are not looked at.
    """
    found = evidence(only(df, doc_id=doc_id, text=text), model, "doc_id")
    return found.select("doc_id", probability(model).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
