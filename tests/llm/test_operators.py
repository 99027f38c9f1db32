"""Every operator against brute force, and on nulls, blanks, copies, ties, long texts, empty tables and clashing columns."""

from __future__ import annotations

import time
import weakref
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import leaks, near_components, quality_counts, without_repeats, words
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinsight.llm import (
    class_lm,
    components,
    decontaminate,
    html_text,
    mixing,
    near_dedup,
    quality_rules,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
    vocabulary,
)
from twinsight.llm.text import worker_state

FILE = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    source = open(FILE).read()
    return vocabulary.ChunkEncoder(source, vocabulary.whole_tokens(source))


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# Tokens


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAzZ0 '\n.,̱́<|> \u0085\x1c"))))
def test_chunks_give_the_library_s_ids(library, encoder, text):
    got = b"".join(map(encoder.ids, encoder.lowered(text.encode()).split()))
    assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_whole_tokens_are_single(library, encoder):
    sample = sorted(encoder.whole)[::97]
    assert [e.ids for e in library.encode_batch(sample, add_special_tokens=False)] == [list(np.frombuffer(encoder.whole[s], "<u4")) for s in sample]


def test_counts_match_the_library(library, texts, awkward, empty):
    got = by_id(token_counts.with_token_counts(awkward, FILE).filter("doc_id IS NOT NULL"), "n_bytes", "n_tokens", "over_limit", "a.b" if False else "node")
    for i, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i][:3] == (len((t or "").encode()), n, n > 2048)
    assert set(awkward.columns) <= set(token_counts.with_token_counts(awkward, FILE).columns)
    assert token_counts.with_token_counts(empty, FILE).count() == 0


def test_files_hold_the_library_s_ids(spark, tmp_path, library, texts, edge):
    token_files.write_token_files(edge, f"{tmp_path}/t", FILE, 1)
    files = token_files.read_token_files(spark, f"{tmp_path}/t")
    stored = {r["doc_id"]: list(r["tokens"]) for r in files.collect()}
    assert stored == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = sorted(token_files.with_starts(token_files.with_crc32(files), files).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r in rows:
        ids = stored[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files_have_the_layout(spark, tmp_path, edge):
    token_files.write_token_files(edge.filter("doc_id < 14"), f"{tmp_path}/t", FILE, 1)
    for file in tmp_path.glob("t/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for group in range(meta.num_row_groups):
            columns = {meta.row_group(group).column(i).path_in_schema: meta.row_group(group).column(i) for i in range(5)}
            tokens = next(c for n, c in columns.items() if n.startswith("tokens"))
            assert "RLE_DICTIONARY" in tokens.encodings and tokens.has_offset_index and tokens.has_column_index
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings


def test_checksums_let_the_encoder_go():
    """Its caches refer to it, as the encoder's do; a worker must not keep them while it reads the files back."""

    class Encoder:
        def __init__(self):
            self.cache = [self]

    kept = weakref.ref(worker_state("token_files", Encoder, FILE))
    batch = pa.RecordBatch.from_pydict({"doc_id": [4], "part": [0], "part_start": [0], "n_tokens": [2], "tokens": pa.array([[7, 1]], pa.list_(pa.int32()))})
    files = SimpleNamespace(mapInArrow=lambda run, schema: [row for out in run(iter([batch])) for row in out.to_pylist()])
    assert [r["ids_crc32"] for r in token_files.with_crc32(files)] == [zlib.crc32(np.array([7, 1], "<u4").tobytes())]
    assert kept() is None


def test_files_of_awkward_and_empty_tables(spark, tmp_path, awkward, empty):
    for name, df in (("a", awkward), ("e", empty)):
        token_files.write_token_files(df, f"{tmp_path}/{name}", FILE, None)
        files = token_files.read_token_files(spark, f"{tmp_path}/{name}")
        files = token_files.with_starts(files, files)
        assert files.count() == df.count()
        assert files.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == files.agg(F.sum("n_tokens")).first()[0]


# Quality


def test_quality_counts(texts, awkward, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = quality_rules.judge_quality(awkward)
    got = by_id(judged.filter("doc_id IS NOT NULL"), *names)
    assert got == {i: quality_counts(t) for i, t in texts.items()}
    assert judged.count() == awkward.count() and judged.filter("kept AND base_failed").count() == 0
    kept = {i for i, (k,) in by_id(judged, "kept").items() if k}
    assert 17 not in kept and {1, 8, 9} <= kept
    assert quality_rules.judge_quality(empty).count() == 0


def test_em_learns_which_rule_to_trust(spark):
    good = [(1, 1, 1)] * 800 + [(1, 1, -1)] * 8
    bad = [(-1, 1, 1)] * 60 + [(1, -1, -1)] * 70
    votes = spark.createDataFrame(good + bad + [(0, 0, 0)] * 5, "r0 int, r1 int, r2 int")
    model = quality_rules.fit_votes(votes, ["r0", "r1", "r2"])
    out = quality_rules.with_shares(quality_rules.with_cells(votes.distinct(), ["r0", "r1", "r2"]), model)
    share = {(r["r0"], r["r1"], r["r2"]): r["shares"][0] for r in out.collect()}
    assert share[1, 1, 1] > 0.9 and share[-1, 1, 1] < 0.2 and share[1, -1, -1] < 0.1 and share[0, 0, 0] > 0.5
    assert model.bad[0][0] < 0.05


# Toxicity


@pytest.fixture(scope="module")
def characters(spark, data):
    return toxicity.CharacterModel(toxicity.trigram_counts(spark.read.parquet(f"{data}/documents.parquet")))


def test_trigram_counts(spark):
    counts = toxicity.trigram_counts(spark.createDataFrame([("ab ab",), (None,), ("",)], "text string"))
    a, b = toxicity.symbol_ids()[[97, 98]]
    assert counts[0, a, b] == 2 and counts[a, b, 0] == 2 and counts[0, 0, a] == 2


@pytest.mark.parametrize("hidden, plain", [("the", "the"), ("th3r3", "there"), ("theee", "thee"), ("t.h.e.r.e", "there"), ("th@t", "that"), ("w1th,", "with"), ("42", "42"), ("thing###", "thing"), ("", "")])
def test_restoration(characters, hidden, plain):
    assert characters.restore(hidden).replace("thee", "the") in (plain.replace("thee", "the"), plain)


@pytest.fixture(scope="module")
def rude():
    words = "you are a stupid idiot and an ass they said to the pig that the cat sat on all day with us".split()
    text = " ".join(words * 50)
    s = np.array([0, 0, *[toxicity.symbol_ids()[ord(c)] for c in text], 0])
    counts = np.zeros((64, 64, 64))
    np.add.at(counts, (np.where(s[1:-1] == 0, 0, s[:-2]), s[1:-1], s[2:]), 1)
    return toxicity.CharacterModel(counts)


@pytest.mark.parametrize("hidden, plain", [("$tupid", "stupid"), ("!diot", "idiot"), ("a$$", "ass"), ("455", "ass"), ("4$$", "ass"), ("@$$", "ass"), ("stupid!", "stupid"), ("(cat", "cat"), ("ass!!", "ass"), ("$tup1d!", "stupid")])
def test_disguises_at_edges_and_throughout(rude, hidden, plain):
    assert rude.restore(hidden) == plain


@pytest.mark.parametrize("word, plain", [("word!", "word"), ("(the", "the"), ("2019", "2019"), ("$1999", "1999"), ("12:30", "12:30"), ("|", ""), ("42", "42")])
def test_marks_and_numbers_stay_what_they_are(characters, word, plain):
    assert characters.restore(word) == plain or len(plain) < 3 > len(characters.restore(word))


@pytest.mark.parametrize(
    "text, words",
    [("y o u s t u p i d p i g", "you stupid pig"), ("the stu pid cat", "stupid"), ("the i d io t sat", "idiot"), ("s t u p 1 d", "stupid"), ("the $tu pid", "stupid"), ("STUP ID", "stupid")],
)
def test_blanks_are_dropped_or_kept_by_the_model(rude, text, words):
    assert set(words.encode().split()) <= toxicity.Reader(rude)(text.encode())


def test_reader_keeps_all_plain_words(rude):
    for text in (None, b"", b" ", b"one", b"a b cd", b"the cat sat on the pig", "\u6771 \u4eac caf\u00e9".encode(), b"x " * 500):
        assert set(toxicity._rejoined((text or b"").lower().split())) <= toxicity.Reader(rude)(text)
    assert toxicity.Reader(rude)(b"the cat sat on the pig") == {b"the", b"cat", b"sat", b"on", b"pig"}


def test_toxicity_curve_on_counted_groups(spark):
    rows = [(1.0, 0.5, 1, 900), (0.0, 0.0, 0, 5000), (0.5, 0.5, 0, 40), (2.0, 1.5, 1, 70), (0.0, 0.0, 1, 30)]
    on_total, on_top, offset = toxicity._logistic(spark.createDataFrame(rows, "total double, top double, toxic int, n long"))
    x = np.array([[a, b, 1.0] for a, b, _, n in rows for _ in range(n)])
    y = np.array([t for _, _, t, n in rows for _ in range(n)])
    at = np.array([on_total, on_top, offset])
    slope = x.T @ (1 / (1 + np.exp(-x @ at)) - y) + np.array([0.01, 0.01, 1e-6]) * at
    assert np.abs(slope).max() < 1e-4 and on_top + on_total > 0 > offset


def test_spaced_letters_are_joined():
    assert list(toxicity._rejoined(b"you s t u p i d one".split())) == [b"you", b"stupid", b"one"]
    assert list(toxicity._rejoined(b"a b cd".split())) == [b"a", b"b", b"cd"]


def test_learned_words_are_found_in_disguise(spark, characters, edge, empty):
    clean = [(i, " ".join(w) + " there and then", 0) for i, w in enumerate(np.array_split(np.array("the cat sat on that mat with this thing there when other things were here".split() * 20), 60))]
    toxic = [(100 + i, f"the cat with that {w} thing here", 1) for i, w in enumerate(["rotter", "nastier"] * 15)]
    docs = spark.createDataFrame([r[:2] for r in clean + toxic], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in clean + toxic] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    asked = spark.createDataFrame([(1, "that r0tter here"), (2, "that r o t t e r here"), (3, "that rotterrrr here"), (4, "this cat"), (5, None), (6, "")], "doc_id long, text string")
    got = by_id(toxicity.score_toxicity(asked, model), "predicted", "score")
    assert [got[i][0] for i in range(1, 7)] == [1, 1, 1, 0, 0, 0]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert toxicity.score_toxicity(edge, model).count() == edge.count()
    assert toxicity.score_toxicity(empty, model).count() == 0
    nothing = toxicity.fit_toxicity(empty.select("doc_id", "text"), labels.limit(0))
    assert toxicity.score_toxicity(asked, nothing).filter("score IS NULL OR predicted IS NULL").count() == 0


# Language model


def test_exchange_separates_two_languages():
    pick = np.random.default_rng(3)
    bigrams = np.zeros((41, 41))
    for _ in range(4000):
        half = pick.integers(2)
        u, v = 1 + 2 * pick.integers(0, 20, 2) + half
        bigrams[u, v] += 1
    of = class_lm.exchange(bigrams, classes=3, sweeps=20)
    assert len(set(of[1::2])) == 1 and len(set(of[2::2])) == 1 and of[1] != of[2]


def test_scores_are_probabilities(spark, awkward, empty):
    docs = awkward.withColumn("held_out", F.col("doc_id") == 9)
    rows = class_lm.score_texts(docs).collect()
    assert len(rows) == awkward.count()
    assert all(r["score"] <= 0 and r["base_score"] < 0 and r["n_known"] <= r["n_tokens"] for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 1
    assert class_lm.score_texts(empty.withColumn("held_out", F.lit(False))).count() == 0
    assert class_lm.score_texts(docs.withColumn("held_out", F.lit(True))).filter("n_known > 0").count() == 0


def test_model_sums_to_one(spark):
    rows = [(i, f"red{i % 3} blue{i % 5} end{i % 7}", False) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    blocks = class_lm.encode_blocks(docs)
    listed = docs.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    model = class_lm.fit_class_model(blocks, listed, 60)
    counts = {r["word"]: r["n"] for r in listed.collect()}
    classes = model.of[class_lm._units(list(counts), model.own)]
    emitted = 10 ** model.word_scores(np.array(list(counts.values())), classes)
    for c in set(classes):
        assert emitted[classes == c].sum() + 10 ** model.unseen[c] == pytest.approx(1.0)
    assert (10**model.step).sum(axis=1) == pytest.approx(np.ones(class_lm.CLASSES))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=12), st.booleans()), min_size=1, max_size=8), st.sampled_from([1, 4, 1 << 18]))
def test_pieces_of_a_block_count_every_neighbour(rows, piece):
    block = class_lm._Block()
    for i, (text, held) in enumerate(rows):
        block.add(i, held, text.encode())
    of, own, frequent = np.arange(class_lm.UNITS) % class_lm.CLASSES, {"a": 1, "b": 2}, {"ab": 0, "c": 1, "cc": 2}
    kind = lambda w: of[class_lm.unit_of(w, own)] if w else 0
    want, bigrams = Counter(), Counter()
    for text, held in rows:
        line = ["", *text.split(), ""]
        for before, word, after in zip(line, line[1:], [*line[2:], ""]) if not held else ():
            bigrams[kind(before), kind(word)] += 1
            if word in frequent:
                want[frequent[word], kind(before)] += 1
                want[frequent[word], class_lm.CLASSES + kind(after)] += 1
    batch = block.row(0)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(class_lm, "PIECE", piece)
        found = next(class_lm._neighbours(SimpleNamespace(value=(own, of, frequent)))([batch])).to_pylist()
        ends, codes = batch["ends"][0].values.to_numpy(), batch["codes"][0].values.to_numpy()
        classes = np.array([*(kind(w) for w in batch["words"][0].as_py()), 0])
        train = ~np.array([held for _, held in rows])
        table = sum(
            class_lm._bigrams(classes[c], np.repeat(train[d], n), class_lm.CLASSES) for d, n, c in class_lm._pieces(codes, ends, len(classes) - 1)
        )
    keys = [(row["bucket"] * class_lm.WORD_BUCKET + int(k), n) for row in found for k, n in zip(np.cumsum(row["steps"]), row["n"])]
    assert {divmod(k, 2 * class_lm.CLASSES): n for k, n in keys} == dict(want)
    assert {divmod(int(k), class_lm.CLASSES): int(table[k]) for k in np.flatnonzero(table)} == dict(bigrams)


def test_packed_counts_add_up(spark):
    pick = np.random.default_rng(3)
    rows = [np.unique(pick.integers(0, 5000, size), return_counts=True) for size in (3000, 1, 0, 40, 800)]
    packed = [row for keys, n in rows for row in class_lm._packed(keys, n, 100).to_pylist()]
    total = sum(np.bincount(keys, n, minlength=5000) for keys, n in rows).astype(int)

    def listed(bucket, sums):
        return pa.RecordBatch.from_pydict({"key": bucket * 100 + np.arange(100), "n": sums})

    got = class_lm._summed(spark.createDataFrame(packed, class_lm._PACKED), 100, listed, "key long, n long").filter("n > 0").collect()
    assert {r["key"]: r["n"] for r in got} == {int(k): int(total[k]) for k in np.flatnonzero(total)}


def test_words_beyond_the_units_get_classes_of_their_own(spark, monkeypatch):
    """Names follow one word, things another; half of both share an ending, and are told apart all the same, whatever the partitioning."""
    monkeypatch.setattr(class_lm, "OWN_WORDS", 4)
    monkeypatch.setattr(class_lm, "UNITS", 1 + 4 + class_lm.ENDINGS)
    pick = np.random.default_rng(5)
    pairs = [[(first, kind + f"{k}" + (own if k < 15 else "end")) for k in range(30)] for first, kind, own in (("mister", "n", "ame"), ("the", "t", "ing"))]
    text = lambda: " ".join(x for _ in range(40) for x in pairs[pick.integers(2)][pick.integers(30)])
    docs = spark.createDataFrame([(i, text(), i % 10 == 9) for i in range(100)], "doc_id long, text string, held_out boolean")
    train = docs.filter("NOT held_out")
    counts = train.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    first = class_lm.fit_class_model(class_lm.encode_blocks(docs), counts, 90)
    placed = {}
    for parts in (1, 3):
        got, _ = class_lm.place_words(class_lm.encode_blocks(docs.repartition(parts, "doc_id")), counts, first)
        assert len(got) == counts.count() - len(first.own) and placed in ({}, got)
        placed = got
    others = [w for w in placed if w not in first.own and w.endswith("end")]
    assert len({first.of[class_lm.unit_of(w, first.own)] for w in others}) == 1
    names, things = ({placed[w] for w in others if w[0] == kind} for kind in "nt")
    assert len(others) >= 26 and not names & things and 0 not in names | things
    rows = class_lm.score_texts(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
    words = {r["word"]: r["n"] for r in counts.collect()}
    got = by_id(class_lm.score_texts(docs), "n_tokens", "n_known", "train_tokens", "base_score")
    total = sum(words.values()) + 90
    for r in docs.collect():
        seen = [words.get(w, 0) for w in r["text"].split()] + [90]
        base = sum(np.log10((c + 1) / (total + len(words) + 1 + 1)) for c in seen)
        assert got[r["doc_id"]] == (len(seen), sum(c > 0 for c in seen), total, pytest.approx(base))


@pytest.mark.parametrize("parts", [1, 3])
def test_rare_words_get_the_classes_that_frequent_ones_get(spark, monkeypatch, parts):
    """Joined or broadcast, a word's class and every score are the same, also of words that occur once."""
    monkeypatch.setattr(class_lm, "OWN_WORDS", 4)
    monkeypatch.setattr(class_lm, "UNITS", 1 + 4 + class_lm.ENDINGS)
    pick = np.random.default_rng(7)
    word = lambda: f"w{int(pick.exponential(40))}" + ("end" if pick.integers(2) else "ing")
    rows = [(i, " ".join(word() for _ in range(pick.integers(0, 60))), i % 7 == 6) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(parts, "doc_id")
    counts = Counter(w for _, text, held in rows if not held for w in text.split())
    listed = spark.createDataFrame(list(counts.items()), "word string, n long")
    blocks = class_lm.encode_blocks(docs)
    first = class_lm.fit_class_model(blocks, listed, sum(not r[2] for r in rows))
    scores = []
    for frequent in (1, 5, 10**9):
        monkeypatch.setattr(class_lm, "FREQUENT", frequent)
        placed, broadcast = class_lm.place_words(blocks, listed, first)
        rare = {r["word"]: r["class"] for r in class_lm.place_rare_words(blocks, first, broadcast).collect()}
        assert not rare.keys() & placed.keys() and set(rare) | set(placed) == set(counts) - set(first.own)
        scores.append(({**placed, **rare}, by_id(class_lm.score_texts(docs), "n_known", "base_score", "score")))
    assert min(counts.values()) == 1 and scores[0] == scores[1] == scores[2]


def test_tasks_hold_few_blocks_at_a_time(spark, monkeypatch):
    """However many blocks a task has, neither their file nor a worker's batch has more than a few."""
    monkeypatch.setattr(class_lm, "BLOCK_DOCS", 100)
    most = 16 << 20

    def guarded(make):
        def of(shared):
            run = make(shared)

            def checked(batches):
                for batch in batches:
                    if batch.nbytes > most:
                        raise ValueError(f"a batch of {batch.num_rows} blocks and {batch.nbytes} bytes")
                    yield batch

            return lambda batches: run(checked(batches))

        return of

    for name in ("_neighbours", "_rare_neighbours", "_others", "_classed", "_emitter"):
        monkeypatch.setattr(class_lm, name, guarded(getattr(class_lm, name)))
    files, write = [], class_lm.materialise

    def written(df, *options):
        table = write(df, *options)
        if "codes" in df.columns:
            files.extend(r["n"] for r in table.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
        return table

    monkeypatch.setattr(class_lm, "materialise", written)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 1600, 1, 1).selectExpr("id AS doc_id", "id % 10 = 9 AS held_out", "repeat(concat('word', id % 50, ' of '), 2000) AS text")
    assert class_lm.score_texts(docs).count() == 1600
    assert sum(files) == 16 and max(files) <= 2
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


# Near duplicates and repeats


def test_near_duplicates(texts, edge, awkward, empty):
    got = by_id(near_dedup.near_duplicates(edge), "n_shingles", "component_id", "kept")
    want = near_components(list(texts.items()))
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert want[5][1] == want[6][1] == want[15][1] == 1 and want[11][1] == 10 and want[7][1] == 7
    again = near_dedup.near_duplicates(awkward)
    assert again.count() == awkward.count()
    assert by_id(again.filter("doc_id IS NOT NULL"), "component_id") == {i: (c,) for i, (_, c) in want.items()}
    assert again.filter("doc_id IS NULL AND component_id IS NULL AND kept").count() == 2
    assert near_dedup.near_duplicates(empty).count() == 0


def test_a_large_group_of_edited_copies(spark):
    """Copies at all distances from one text: components as brute force has them."""
    pick = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        text = list(base)
        for at in pick.integers(0, 120, pick.integers(0, 9)):
            text[at] = f"e{pick.integers(10**6)}"
        rows.append((i, " ".join(text)))
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == near_components(rows)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(999, i) for i in range(10)] + [(5, 5), (7, 999), (7, 999)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 0 for i in range(1, 10)}, 999: 0}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_repeats(texts, edge, levels):
    got = by_id(substring_dedup.remove_repeats(edge, 20, levels), "n_words", "n_removed", "kept_sha256")
    assert got == without_repeats(list(texts.items()))


def test_repeats_of_awkward_tables(texts, awkward, empty):
    out = substring_dedup.remove_repeats(awkward)
    assert out.count() == awkward.count()
    assert by_id(out.filter("doc_id IS NOT NULL"), "n_removed")[5] == (300,)
    assert substring_dedup.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(empty, 30, 3)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 40))
def test_sliding_min(values, width):
    from twinsight.llm.shingles import sliding_min

    width = min(width, len(values))
    want = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert sliding_min(np.array(values, "uint64"), width).tolist() == want


# Pages


TREE = html_text.grow_tree(*html_text.labelled_rows())


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<!-- only -->", ""),
        ("<nav><a href=x>menu</a></nav><article><h1>Title &amp; more</h1><p>one<br>two&nbsp; three <b>bo</b>ld</article><footer>foot</footer>", "Title & more one two three bold"),
        ("<main><p>kept text of some length here</p><aside>not this side text</aside></main><div id='comments'><p>" + "bad " * 60 + "</p></div>", "kept text of some length here"),
        ("<article>a<script>if (x < 1) { y = '</p>'; }</script> b<style>p{}</style> c</article>", "a b c"),
        ("<article title=\"x>y\">in</article><form>form text</form><div class='cookie notice'>" + "we use " * 20 + "</div>", "in"),
        ("<article><p>&#65;&#x42;&lt;p&gt; &unknown; 1 < 2</article>", "AB<p> &unknown; 1 < 2"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page, TREE) == text


@pytest.mark.parametrize("code", ["<script>for(i=0;i<n;i++){f(i)}</script>", "<style>a<b{}</style>", "<textarea>i<n</textarea>", "<title>i<n</title>"])
def test_tags_inside_raw_text_do_not_swallow_its_end(code):
    assert html_text.main_text(f"<body>{code}<article>kept text</article></body>", TREE) == "kept text"
    assert html_text.main_text("<body>" + code * 3 + f"<article>kept{code} text</article>{code}", TREE) == "kept text"


@pytest.mark.parametrize("kind", "button select svg math iframe object canvas audio video template noscript textarea title".split())
def test_unclosed_dropped_elements_do_not_cut_the_page(kind):
    assert html_text.main_text(f"<body><{kind} x=1><article>kept text</article></body>", TREE) == "kept text"
    if kind not in ("textarea", "title"):  # in these, what comes before an end tag is characters
        assert html_text.main_text(f"<body><{kind} x=1><article>kept text</article><{kind}>gone</{kind}></body>", TREE) == "kept text"
        assert html_text.main_text(f"<body><div><{kind}>gone</div><article>kept text</article></{kind}></body>", TREE) == "kept text"


def test_head_ends_without_end_tag():
    for rest in ("<body><article>kept text</article>", "<article>kept text</article>", "<noscript><img src=x></noscript><meta x><article>kept text</article>"):
        assert html_text.main_text(f"<html><head><title>x</title><script>a<b</script>{rest}", TREE) == "kept text"
    assert [b.text for b in html_text.text_blocks("<head><title>x</title>bare words")] == ["bare words"]
    assert html_text.main_text("<svg>" * 20000 + "<title>" * 20000 + "<article>kept text</article>", TREE) == "kept text"


def test_tree_fits_its_table():
    rows, labels = html_text.labelled_rows()
    assert np.mean([html_text.is_main(TREE, r) == bool(y) for r, y in zip(rows, labels, strict=True)]) > 0.95


def test_unclosed_quotes_stay_linear():
    assert html_text.main_text("<p a='" * 20000, TREE) is not None
    began = time.perf_counter()
    html_text.main_text("<div>" * 30000 + "</section>" * 30000 + "<svg>" + "<div>" * 30000 + "</section>" * 30000 + "</svg>", TREE)
    assert time.perf_counter() - began < 5


def test_pages_table(spark, data):
    rows = [(1, "<article>some words</article>", 5), (1, None, 6), (2, "", 7)]
    df = spark.createDataFrame(rows, "page_id long, html string, text int")
    assert sorted(r["text"] for r in html_text.with_main_text(df).collect()) == ["", "", "some words"]
    assert html_text.with_main_text(df.limit(0)).count() == 0


# Mixing


def test_water_filling(spark):
    table = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), ("c", 300, 1.0), ("d", 0, 4.0)], "key string, source_size long, weight double")
    got = {r["key"]: r["target"] for r in mixing.water_fill(table, 1.5, 2).collect()}
    assert got == {"a": 20, "b": pytest.approx(1345), "c": 600, "d": 0}
    assert sum(got.values()) == pytest.approx(1.5 * 1310)


def test_mixture(texts, edge, awkward, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for source in {r["source"] for r in rows}:
        of = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in of) <= of[0]["target"] + 1e-6
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(edge.repartition(7)).collect()} == {r["doc_id"]: r["taken"] for r in rows}
    assert mixing.mix(awkward).count() == awkward.count()
    assert mixing.mix(empty).count() == 0


# Benchmark items


def test_leaks(spark, texts, edge, awkward, empty):
    w = words(texts[14])
    items = [(1, " ".join(w[29000:29050])), (2, " ".join(w[100:120]).upper()), (3, "four words are few"), (4, None), (5, ""), (6, " ".join(w[5:40] + ["odd"] * 40)),
             (7, " ".join(words(texts[1])[:40] + ["x"] + words(texts[1])[41:90])), (8, " ".join(w[29000:29050])), (9, " ".join(w[:3000]))]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(edge, asked).collect()}
    assert got == leaks(list(texts.items()), items) and {(14, 1), (14, 2), (14, 8), (14, 9), (1, 7), (5, 7)} <= got
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(awkward, asked).collect()} == got
    assert decontaminate.find_leaks(empty, asked).count() == 0
    assert decontaminate.find_leaks(edge, asked.limit(0)).count() == 0


def test_wording_that_items_share_makes_no_candidates(spark):
    """200 items and 300 documents begin with the same 20 words; three documents hold a whole item, one of them most of it."""
    common = " ".join(f"please{i}" for i in range(20))
    items = [(i, common + " " + " ".join(f"q{i}x{j}" for j in range([30, 60, 200][i % 3]))) for i in range(200)]
    docs = [(i, common + " " + " ".join(f"d{i}x{j}" for j in range(80))) for i in range(300)]
    docs += [(1000, docs[0][1] + " " + items[0][1]), (1001, docs[1][1] + " " + items[5][1] + " more"), (1002, items[4][1].replace("q4x30", "zz"))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(rows, asked).collect()}
    assert got == leaks(docs, items) == {(1000, 0), (1001, 5), (1002, 4)}
    for percent in (50, 62.5, 100):
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(rows, asked, percent / 100).collect()}
        assert found == ({(1000, 0), (1001, 5)} if percent == 100 else got)
    hashed = asked.select(F.col("item_id").alias("row"), decontaminate.shingle_words(F.col("text")).alias("words"))
    hashed = hashed.select("row", decontaminate._hashes("words").alias("hashes")).withColumn("size", F.size("hashes").cast("long"))
    sized = hashed.withColumn("class", decontaminate.size_class(F.col("size"))).withColumn("enough", F.ceil(F.col("size") * 0.8))
    pairs = decontaminate.candidate_pairs(rows.withColumn("text_hash", F.xxhash64("text")), sized)
    assert pairs.count() == 3


def test_long_keys_are_not_kept():
    made = []
    table = vocabulary.Remembered(lambda key: made.append(key) or key[:3])
    assert [table["x" * 5_000_000], table["x" * 5_000_000], table["abcd"], table["abcd"]] == ["xxx", "xxx", "abc", "abc"]
    assert len(made) == 3 and list(table) == ["abcd"]


STORY = "<h1>A headline of the story</h1>" + "<p>" + "one plain sentence of the story follows another here. " * 6 + "</p>"


@pytest.mark.parametrize("page", [
    "<body class='page header-fixed'><article>{}</article></body>", "<body class='nav open'><main>{}</main></body>",
    "<html class='no-sidebar'><body id=top><article class='related story'>{}</article></body>", "<body><main id='search content'>{}</main></body>",
])
def test_names_on_whole_pages_and_articles_do_not_empty_them(page):
    plain = "A headline of the story " + " ".join(["one plain sentence of the story follows another here."] * 6)
    assert html_text.main_text(page.format(STORY), TREE) == plain
    both = page.format(STORY + "<section class=comments><article>first! what a story this is, I must say</article></section>")
    assert html_text.main_text(both, TREE).startswith(plain)
    reader = page.format(STORY + "<article class='comment'><p>what a story</p></article>")
    assert html_text.main_text(reader, TREE) == plain


def test_mix_splits_ties_and_fills_the_room(spark):
    words = lambda n: " ".join(["w"] * n)
    schema = "doc_id long, source string, text string, draw string, `a.b` int, _text int"
    alike = spark.createDataFrame([(None, "s", words(10), "d", 1, 2)] * 40, schema)
    got = mixing.mix(alike, keep=["a.b", "draw"])
    assert got.agg(F.sum("taken")).first()[0] == 600 and got.columns[-2:] == ["a.b", "draw"]
    same = spark.createDataFrame([(7, "s", words(10), "d", 1, 2)] * 40, schema)
    assert mixing.mix(same).agg(F.sum("taken")).first()[0] == 600
    sizes = [500, 130, 90, 70, 56, *[2] * 77]
    rows = spark.createDataFrame([(i, "s", words(n), "d", 1, 2) for i, n in enumerate(sizes)], schema)
    for seed in ("mix", "a", "b", "c"):
        assert mixing.mix(rows, seed=seed).agg(F.sum("taken")).first()[0] in (1499, 1500)
    many = spark.createDataFrame([(i, f"host{i % 60}", words(1 + i % 9), "d", 1, 2) for i in range(900)], schema)
    assert mixing.mix(many).groupBy("source").agg(F.max(F.abs(F.col("target") - F.col("source_size"))), F.sum("taken")).count() == 60
