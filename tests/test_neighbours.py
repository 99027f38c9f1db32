import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from twinsight.functions import frames
from twinsight.operators import neighbours as nb
from twinsight.operators.features import distinct_rows, joint_encode, joint_space


def table(seed, n, shape):
    rng = np.random.default_rng(seed)
    if shape == "mixed":
        return pd.DataFrame({"x": rng.normal(size=n) * 50, "y": rng.integers(0, 30, n), "c": rng.choice(list("abcd"), n)})
    if shape == "hot pivot":  # a third of the rows share the widest number and differ elsewhere
        x = np.where(rng.random(n) < 0.34, 1000.0, rng.random(n) * 5000)
        return pd.DataFrame({"x": x, "y": rng.random(n) * 100, "c": rng.choice(list("ab"), n)})
    if shape == "hot tuple":  # a third of the rows are copies of one row
        pdf = table(seed, n, "mixed")
        pdf.iloc[: n // 3] = pdf.iloc[0].to_numpy()
        return pdf.astype({"x": float, "y": int, "c": str})
    if shape == "categories":
        return pd.DataFrame({k: rng.choice(list("abcdefgh"), n) for k in ("c", "d", "e")})
    if shape == "clusters":
        centre = rng.choice([0.0, 1e4, -3e4], n)
        return pd.DataFrame({"x": centre + rng.normal(size=n), "y": centre / 7 + rng.normal(size=n), "z": rng.random(n)})
    raise ValueError(shape)


def brute_force(queries, index):
    total = 0.0
    for c in queries.columns:
        a, b = queries[c].to_numpy()[:, None], index[c].to_numpy()[None, :]
        if a.dtype == object or a.dtype.kind in "UT":
            total = total + 2.0 * (a != b)
        else:
            total = total + (a.astype(float) - b.astype(float)) ** 2
    return np.sqrt(total.min(axis=1))


def nearest(spark, queries, index, **options):
    q, ix = spark.createDataFrame(queries), spark.createDataFrame(index)
    space = joint_space(ix, q)
    rows = distinct_rows(joint_encode(q, space), space, n=F.lit(1))
    return nb.nearest_distance(rows, distinct_rows(joint_encode(ix, space), space), space, ("n",), **options)


@pytest.mark.parametrize("cell_rows", [7, 5_000])
@pytest.mark.parametrize("shape", ["mixed", "hot pivot", "hot tuple", "categories", "clusters"])
def test_equal_to_brute_force(spark, shape, cell_rows):
    queries, index = table(1, 400, shape), table(2, 500, shape)
    got = nearest(spark, queries, index, cell_rows=cell_rows).toPandas()
    assert got["n"].sum() == len(queries) and len(got) == len(queries.drop_duplicates())
    want = queries.assign(want=brute_force(queries, index)).drop_duplicates()
    keys = list(queries.columns)
    for c in keys:
        if c in ("x", "y", "z"):
            want[c] = want[c].astype(float)
    both = got.merge(want, on=keys)
    assert len(both) == len(got)
    np.testing.assert_allclose(both["distance"], both["want"], rtol=1e-9, atol=1e-9)


def test_far_queries_and_few_boxes(spark):
    """Queries outside every box, and a box limit below the wish."""
    index = table(3, 300, "clusters")
    queries = index.head(50) * 3 + 1e5
    got = nearest(spark, queries, index, cell_rows=5, max_cells=4).toPandas()
    np.testing.assert_allclose(np.sort(got["distance"]), np.sort(brute_force(queries, index)), rtol=1e-9)


def test_large_cells_and_chunks_are_cut(spark, monkeypatch):
    """Nearly all queries fall into one cell, and cells hold more than a part: several groups, the same result."""
    monkeypatch.setattr(nb, "PART_ROWS", 20)
    monkeypatch.setattr(nb, "CHUNK_ROWS", 30)
    index = table(4, 300, "clusters")
    queries = pd.concat([index.head(1)] * 300).reset_index(drop=True)
    queries["z"] += np.arange(300) / 1e4
    got = nearest(spark, queries, index, cell_rows=100).toPandas()
    np.testing.assert_allclose(np.sort(got["distance"]), np.sort(brute_force(queries, index)), rtol=1e-9, atol=1e-12)


def wide(seed, n, columns=10):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({f"x{i}": rng.random(n) for i in range(columns)})


def test_ten_like_columns_need_many_rounds(spark):
    """Where no box is far from any query, rounds go on until each cell has been met, and nothing is lost."""
    queries, index = wide(5, 300), wide(6, 2_000)
    got = nearest(spark, queries, index, cell_rows=40).toPandas()
    np.testing.assert_allclose(np.sort(got["distance"]), np.sort(brute_force(queries, index)), rtol=1e-9)


@pytest.mark.parametrize("columns", [2, 10])
def test_rows_shuffled_for_a_query(spark, monkeypatch, columns):
    """A chunk's queries are sent once per group it visits: not once per box, however many boxes there are."""
    sent = []
    meet = nb._meet

    def counted(state, visits, index, space, keys):
        sent.append(state.join(visits.select("cell", "piece", "group").distinct(), ["cell", "piece"]).count())
        return meet(state, visits, index, space, keys)

    monkeypatch.setattr(nb, "_meet", counted)
    queries, index = wide(7, 300, columns), wide(8, 3_000, columns)
    nearest(spark, queries, index, cell_rows=25)
    assert sum(sent) <= 300 * (-(-120 // nb.GROUP_PARTS) + 8)
    if columns == 2:
        assert sum(sent) <= 300 * 4


def test_no_step_pairs_everything(spark):
    df = nearest(spark, table(1, 400, "mixed"), table(2, 500, "mixed"), cell_rows=7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "NestedLoop", "SinglePartition"):
        assert bad not in plan


@settings(max_examples=60, deadline=None)
@given(hs.integers(0, 2**32 - 1), hs.integers(1, 400), hs.integers(0, 3))
def test_boxes_inside_a_task(seed, n, k):
    rng = np.random.default_rng(seed)
    y, x = np.round(rng.normal(size=(n, 3)) * 3), rng.normal(size=(50, 3)) * 4
    x[:, k:] = np.round(x[:, k:])
    exact = ((x[:, None, :k] - y[None, :, :k]) ** 2).sum(axis=2) + 2.0 * (x[:, None, k:] != y[None, :, k:]).sum(axis=2)
    bound = np.where(rng.random(50) < 0.5, np.inf, rng.random(50))
    np.testing.assert_allclose(nb.least_squares(x, y, bound, k), np.minimum(exact.min(axis=1), bound))


@settings(max_examples=60, deadline=None)
@given(hs.integers(0, 2**32 - 1), hs.integers(1, 60), hs.integers(1, 12), hs.integers(0, 3))
def test_tree_never_loses_a_closer_box(seed, n, leaves, k):
    """Every index row lands in its box, and boxes closer than a bound are all found."""
    rng = np.random.default_rng(seed)
    rows = np.round(rng.normal(size=(n, 3)) * 3)
    tree = nb.grow_tree(rows[: max(1, n // 2)], k, leaves)
    at = tree.find(rows)
    lo, hi = np.full((tree.n_leaves, 3), np.inf), np.full((tree.n_leaves, 3), -np.inf)
    for leaf in np.unique(at):
        lo[leaf], hi[leaf] = rows[at == leaf].min(axis=0), rows[at == leaf].max(axis=0)
    tree.set_boxes(lo, hi)
    queries = rng.normal(size=(20, 3)) * 4
    gap = (queries[:, None, :k] - rows[None, :, :k]) ** 2
    exact = gap.sum(axis=2) + 2.0 * (queries[:, None, k:] != rows[None, :, k:]).sum(axis=2)
    bound = np.median(exact, axis=1)
    found = set(zip(*tree.closer_leaves(queries, bound)))
    for i, j in zip(*np.nonzero(exact < bound[:, None] * (1 - 1e-6))):
        assert (i, at[j]) in found


def test_queries_of_many_pieces_meet_their_own_group(spark, monkeypatch):
    """Pieces in partitions of their own: after its own group a query has a bound, and few need another group."""
    asked = []
    meet = nb._meet

    def counted(state, visits, index, space, keys):
        asked.append(state.count())
        return meet(state, visits, index, space, keys)

    monkeypatch.setattr(nb, "_meet", counted)
    monkeypatch.setattr(nb, "CHUNK_ROWS", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index, queries = wide(9, 3_000, 1), wide(10, 1_000, 1)
        got = nearest(spark, queries, index, cell_rows=25).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    np.testing.assert_allclose(np.sort(got["distance"]), np.sort(brute_force(queries, index)), rtol=1e-9)
    assert asked[0] == 1_000 and sum(asked[1:]) < 200


def test_routing_holds_few_pairs_at_a_time():
    """A bound that reaches every box: gaps are worked out a slice at a time, whatever the number of boxes."""
    rows = wide(11, 8_192, 5).to_numpy()
    tree = nb.grow_tree(rows, 5, 4_096)
    at = tree.find(rows)
    lo, hi = (np.array([f(rows[at == leaf], axis=0) for leaf in range(tree.n_leaves)]) for f in (np.min, np.max))
    tree.set_boxes(lo, hi)
    import tracemalloc

    tracemalloc.start()
    found = tree.closer_leaves(rows[:256], np.full(256, 1e9))
    gap = tree.gap_of_leaves(rows[:256], *found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(gap) == 256 * tree.n_leaves and peak < 100 * len(gap)


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e12])
def test_matrix_product_only_sifts(shift):
    """Distances are those of the differences to the last bit, on large numbers too."""
    y, x = wide(12, 3_000, 6).to_numpy() + shift, wide(13, 200, 6).to_numpy() + shift
    exact = np.zeros((200, 3_000))
    for c in range(6):
        exact += (x[:, None, c] - y[None, :, c]) ** 2
    np.testing.assert_array_equal(nb.least_squares(x, y, np.full(200, np.inf), 6), exact.min(axis=1))


def test_disk_of_a_round_is_bounded(spark, monkeypatch):
    """Few rows are on the way at a time, however many rounds there are, and tables and shuffle files of former ones are gone."""
    asked, tables, meet = [], [], nb._meet

    def counted(state, visits, index, space, keys):
        asked.append((state.count(), visits.count(), state.select("cell").distinct().count()))
        tables.append(len(frames._SCOPES[-1]))
        return meet(state, visits, index, space, keys)

    monkeypatch.setattr(nb, "_meet", counted)
    monkeypatch.setattr(nb, "SLICE_ROWS", 1_000, raising=False)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(b.isShuffle() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllBlocks()))
    before, largest = shuffled(), []
    clear = nb.materialise
    monkeypatch.setattr(nb, "materialise", lambda df: (clear(df), largest.append(shuffled()))[0])
    queries, index = wide(14, 300), wide(15, 2_000)
    got = nearest(spark, queries, index, cell_rows=25).toPandas()
    np.testing.assert_allclose(np.sort(got["distance"]), np.sort(brute_force(queries, index)), rtol=1e-9)
    assert max(n + 200 * visits for n, visits, _ in asked if _ > 1) <= 2_000 and sum(n for n, *_ in asked) >= 900
    assert len(asked) > max(tables) and max(largest) <= before + 40


def test_pieces_take_their_groups_rows_along_few_times(spark, monkeypatch):
    """Where there are many pieces they are larger, so that the index is not sent again for each few queries."""
    monkeypatch.setattr(nb, "CHUNK_ROWS", 10)
    pieces, meet = [], nb._meet

    def counted(state, visits, index, space, keys):
        pieces.append(visits.count())
        return meet(state, visits, index, space, keys)

    monkeypatch.setattr(nb, "_meet", counted)
    queries, index = wide(16, 2_000, 1), wide(17, 1_000, 1)
    got = nearest(spark, queries, index, cell_rows=100).toPandas()
    np.testing.assert_allclose(np.sort(got["distance"]), np.sort(brute_force(queries, index)), rtol=1e-9)
    assert 20 <= pieces[0] <= 80
