"""Collocations, nearest vectors and ranked search against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from brute import lower
from pyspark.sql import functions as F

from twinsight.llm.collocations import collocations
from twinsight.llm.nearest import meetings, nearest
from twinsight.llm.queries import QUERIES
from twinsight.llm.ranked_search import ranked_search


def brute_collocations(rows, order, least, top, absorbed=50):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n = Counter()
    for p, x in f.items():
        n[p[0]] += x if len(p) == 2 else 0
    candidates = {p: x for p, x in f.items() if len(p) > 2 and x >= least}
    longer = Counter()
    for p, x in candidates.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                q = (p[0], *p[i : i + m])
                longer[q] = max(longer[q], x)
    by_lang = {}
    for p, a in candidates.items():
        if 100 * longer[p] >= absorbed * a:
            continue
        cuts = [(1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        by_lang.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return {
        (lang, i, text.decode(), -a, left, right, n[lang], -score)
        for lang, found in by_lang.items()
        for i, (score, a, text, left, right) in enumerate(sorted(found)[:top], 1)
    }


@pytest.mark.parametrize("order, least, top", [(3, 2, 2000), (2, 3, 7), (4, 2, 50)])
def test_collocations_match_brute_force(awkward, order, least, top):
    table = awkward.withColumnRenamed("source", "lang")
    got = collocations(table, order, least, top)
    rows = [(r["lang"], r["text"]) for r in table.collect()]
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows, order, least, top)


def test_collocations_of_marks_ties_and_long_words(spark):
    texts = ["a b. A  B, c\td; c d! É è É è a\x0bb\x0cc d e f e f", "", None, ".,;", "x" * 300_000 + " y " + "x" * 300_000 + " y"] * 3
    table = spark.createDataFrame([(t, "en" if i % 2 else None, 1) for i, t in enumerate(texts)], "text string, lang string, phrase int")
    got = {tuple(r) for r in collocations(table, least=2).collect()}
    assert got == brute_collocations([(r["lang"], r["text"]) for r in table.collect()], 3, 2, 2000)
    assert collocations(table.limit(0)).count() == 0


def brute_nearest(rows, asked, k):
    unit = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit.setdefault(len(v), []).append((i, np.array(v) / np.linalg.norm(np.array(v) / max(map(abs, v))) / max(map(abs, v))))
    out = {}
    for some in unit.values():
        for q, u in some:
            if q is not None and q in asked:
                scored = [(round(-float(u @ x), 9), math.inf if i is None else i) for i, x in some if i != q]
                out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_nearest_handles_odd_vectors_and_ties(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.standard_normal(6).round(1).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 420)]  # copies: ties by id
    rows += [(500, None), (550, []), (600, [0.0] * 6), (650, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (700, [math.inf] * 6), (750, [math.nan] * 6)]
    rows += [(None, rows[0][1]), (800, [1.0, 2.0]), (801, [2.0, 4.0]), (802, [-1.0, 0.5]), (850, [1e300, 1e-300, 0.0, 0.0, 0.0, 1e300]), (900, [7.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    got = {}
    for r in nearest(table, F.col("vec_id") % 50 == 0, k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, set(range(0, 1000, 50)), 4)
    assert set(got) == {q for q, found in want.items() if found}
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(want[q]) + 1))
        assert [math.inf if x[1] is None else x[1] for x in found] == [i for i, _ in want[q]]
        assert [x[2] for x in found] == pytest.approx([s for _, s in want[q]], abs=1e-8)
    assert nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_recall_on_the_given_vectors(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in rows], set(range(0, 10**6, 50)), 5)
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["op12_nearest"](spark, data).collect()}
    hits = [(q, i) in got for q, found in want.items() for i, _ in found]
    assert len(got) == len(hits) and np.mean(hits) >= 0.97


def test_meetings_follow_the_binomial():
    draw = np.random.default_rng(0).binomial(64, 0.6826895, 200_000)
    assert np.mean(draw < meetings()) < 0.0015 and np.mean(draw < meetings() + 1) > 0.0008


def brute_search(docs, items, top):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))

    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(math.inf if i is None else i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = set()
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            found += [(-score, i)] if score > 0 else []
        out |= {(item, rank, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(found)[:top], 1)}
    return out


@pytest.mark.parametrize("top", [1, 20])
def test_ranked_search_matches_brute_force(spark, awkward, texts, top):
    copies = awkward.unionByName(awkward.filter("doc_id = 8").withColumn("doc_id", F.explode(F.sequence(F.lit(100).cast("long"), F.lit(160).cast("long")))))
    asked = [(1, texts[1][:200]), (2, None), (3, ""), (4, "... --"), (None, "alpha1 Alpha1 BETA2"), (6, "CAFÉ café 東京 don't"), (7, texts[9]), (7, texts[9]), (8, "nothingofthis")]
    items = spark.createDataFrame([(i, t, 5, "x") for i, t in asked], "item_id long, text string, score int, doc_id string")
    got = [tuple(r) for r in ranked_search(copies.repartition(3), items, top).collect()]
    want = brute_search([(r["doc_id"], r["text"]) for r in copies.collect()], sorted(set(asked), key=str), top)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ranked_search(copies.limit(0), items).count() == 0 and ranked_search(copies, items.limit(0)).count() == 0
