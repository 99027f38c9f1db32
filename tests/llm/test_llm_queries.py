"""Registered queries against DuckDB where SQL can express them, else against libraries, brute force or held-out labels."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from brute import leaks, near_components
from compare import differences, sql_connection
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

import corpus_pipeline
from twinsight.llm.queries import ORACLES, QUERIES, WORD_BPE


@pytest.fixture(scope="module")
def documents(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, name):
    assert differences(QUERIES[name](spark, data), sql_connection(data), ORACLES[name], tolerance=1e-9) == []


def test_each_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_token_queries(spark, data, documents):
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in documents.items()}
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op1_token_counts"](spark, data).collect()}
    assert got == {i: len(x) for i, x in ids.items()}
    sums = {r["doc_id"]: r["ids_crc32"] for r in QUERIES["op2_token_files"](spark, data).collect()}
    assert sums == {i: zlib.crc32(np.array([*x, 1], "<u4").tobytes()) for i, x in ids.items()}


def test_toxicity_on_held_out_labels(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    scored = QUERIES["op4_toxicity"](spark, folder).filter("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("toxic IS NOT NULL").collect()
    pos, neg = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.85
    assert sum(p >= 0.3 for p in pos) >= 0.75 * len(pos) and sum(n >= 0.3 for n in neg) <= 0.05 * len(neg)


def test_language_model_beats_its_base(spark, data):
    rows = [r for r in QUERIES["op5_class_lm"](spark, data).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_quality_follows_the_labels(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    rows = QUERIES["op3_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    good = [r for r in rows if r["label"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["label"] == 0]
    assert np.mean([r["kept"] for r in good]) > 0.98 and np.mean([r["kept"] for r in bad]) < 0.1


def test_pages_keep_the_article(spark, data):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in QUERIES["op7_main_text"](spark, data).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", " ", article.replace("<b>", "").replace("</b>", "")))
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])


def test_pipeline_stages(spark, data):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.materialise(stage(spark, docs, data))
        after = docs.collect()
        texts = {r["doc_id"]: r["text"] for r in before}
        if name != "token_files":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            assert 0.7 * len(before) < len(after) <= len(before)
        elif name == "near_dedup":
            assert {r["doc_id"] for r in after} == {i for i, (_, c) in near_components(list(texts.items())).items() if i == c}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert {r["doc_id"] for r in after} == set(texts) - {d for d, _ in leaks(list(texts.items()), items)}
        elif name == "mixing":
            assert {r["doc_id"] for r in after} <= set(texts) and max(map(list(r["doc_id"] for r in after).count, texts)) <= 2
        else:
            assert len(after) == len(before)
            assert max(r["start"] + r["n_tokens"] for r in after) == sum(r["n_tokens"] for r in after)


def test_entry_has_the_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
