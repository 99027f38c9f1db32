from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, source string, n_tokens string, node int, value string, `hash` int, `a.b` int"


def invented(seed, n):
    pick = random.Random(seed)
    return [pick.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(pick.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Id to text: copies, near copies, shared passages, blanks, nothing, a very long text."""
    base, other, passage = invented(1, 300), invented(2, 120), invented(3, 60)
    near = base[:150] + ["changed"] + base[151:]
    far = [w if i % 6 else "edit" + str(i) for i, w in enumerate(base)]
    chain = near[:20] + ["again", "and", "again"] + near[23:]
    found = {
        1: " ".join(base), 2: None, 3: "", 4: " \t\n ", 5: " ".join(base), 6: " ".join(near), 7: " ".join(far),
        8: " ".join(other + passage), 9: " ".join(passage + invented(4, 500)), 10: "Few words", 11: "few  WORDS",
        12: " ".join(["same"] * 200), 13: "\n".join(["one line of words here"] * 30), 14: " ".join(invented(5, 30000)),
        15: " ".join(chain), 16: "café İstanbul á 東京 <|endoftext|> don't I'LL \U0001f600!!",
        17: " ".join(w + "###" for w in invented(6, 80)), 18: " ".join(passage[10:] + invented(7, 90)),
    }
    return found


@pytest.fixture(scope="session")
def edge(spark, texts):
    """The texts with clashing extra columns, a row that repeats, and a row without id."""
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "x", i, "v", 1, 2) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark, edge):
    """Rows that repeat an id and text, and rows without an id."""
    more = [(1, None, "s", "x", 0, "v", 1, 2), (None, "no id but some words to show for it all", "s", "x", 0, "v", 1, 2)]
    return edge.unionByName(edge.filter("doc_id IN (1, 12)")).unionByName(spark.createDataFrame(more * 2, SCHEMA).filter("doc_id IS NULL"))
