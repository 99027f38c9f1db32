"""Near duplicates in large groups and at other thresholds, and the operators on workers without this package."""

from __future__ import annotations

import random
import subprocess
import sys
from math import comb
from pathlib import Path

import pytest
from brute import near_components
from pyspark.sql import functions as F

from twinsight.llm import near_dedup


def edited(words, pick, changes):
    words = list(words)
    for at in pick.sample(range(len(words)), changes):
        words[at] = f"edit{pick.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def group():
    """Copies of one text that are near to a few others but seldom to the original, chains, and shared passages."""
    pick = random.Random(3)
    base = [f"w{pick.randrange(5000)}" for _ in range(260)]
    texts = [base]
    for _ in range(12):
        branch = edited(base, pick, 6)
        texts.append(branch)
        for _ in range(9):
            branch = edited(branch, pick, pick.choice([2, 3, 4]))
            texts.append(branch)
    passage = [f"p{pick.randrange(5000)}" for _ in range(120)]
    texts += [passage + [f"own{pick.randrange(10**6)}" for _ in range(20 + 3 * i)] for i in range(30)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_groups_match_brute_force(spark, group, percent):
    rows = spark.createDataFrame(group, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(rows, percent).collect()}
    assert got == near_components(group, percent)


@pytest.mark.parametrize("nodes, shingles, star", [(8, 1 << 20, 3), (1024, 700, 512)])
def test_chunks_lose_no_link(spark, group, monkeypatch, nodes, shingles, star):
    monkeypatch.setattr(near_dedup, "CHUNK_NODES", nodes)
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", shingles)
    monkeypatch.setattr(near_dedup, "STAR_NODES", star)
    rows = spark.createDataFrame(group, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(rows).collect()}
    assert got == near_components(group)


def test_links_stay_below_the_members(spark, group):
    """What leaves a posting is links, not pairs: fewer than its members."""
    docs = spark.createDataFrame(group, "doc_id long, text string")
    rows = near_dedup.sketches(docs)
    nodes = rows.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "signature")
    posted = near_dedup._postings(nodes, near_dedup.matches_needed(85)).cache()
    alone = spark.createDataFrame([], "node long, root long")
    links = near_dedup._links_across(docs, posted, alone, 85)
    members = posted.select(F.explode("prefix").alias("value")).groupBy("value").count().filter("count > 1")
    assert links.count() < members.agg(F.sum("count")).first()[0]


def test_needed_matches_follow_the_binomial():
    for percent in (50, 60, 80, 85, 99):
        t, p = near_dedup.matches_needed(percent), percent / 100
        assert sum(comb(40, k) * p**k * (1 - p) ** (40 - k) for k in range(t)) <= near_dedup.MISS
    assert near_dedup.matches_needed(85) == 22 and near_dedup.matches_needed(1) == 1


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.executor.memory", "1500m").config("spark.ui.enabled", "false")
spark = spark.config("spark.checkpoint.dir", {shared!r}).config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry
names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
for name in names:
    assert entry.queries()[name](spark, {data!r}).count() > 0, name
assert len(names) == 14
print("all ran")
"""


def test_workers_need_no_package(tmp_path, data):
    """All operators and the pipeline, started elsewhere, on an executor that cannot import this package."""
    script = tmp_path / "elsewhere.py"
    script.write_text(SCRIPT.format(root=str(Path(__file__).resolve().parents[2]), shared=f"file://{tmp_path}/shared", data=data))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=1200)
    assert "all ran" in done.stdout, done.stderr[-3000:]
