"""Steps whose cost must not grow faster than their input, told by plans, rows and results at small sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph import runtime
from reelgraph.functions import scalars as S
from reelgraph.operators import balls, density, graph, patterns, rank, stats, vectors
from reelgraph.plans import landed
from reelgraph.plans import queries as plans
from reelgraph.plans import rollup as composed

DATA = "/root/testdata/sf0.001"



def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unit_takes_its_norm_once(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0])], "id long, v array<double>")
    got = df.select("id", vectors.unit(F.col("v")).alias("u"))
    assert plan(got).count("aggregate(") == 1  # it stood within the lambda over dimensions before
    assert {r["id"]: r["u"] for r in got.collect()} == {1: [0.6, 0.8], 2: None, 3: None, 4: None}


def test_only_vectors_of_peaks_are_scaled(spark):
    """Of the vectors of 400 posts those of the peaks are written, and the filter on them reads what was written."""
    posts = spark.createDataFrame([(i, i % 2, 1000 if i < 8 else 5) for i in range(400)], "post_id long, account_id long, views long")
    embedded = spark.createDataFrame([(i, [0.0, 0.0] if i == 3 else [1.0, float(i % 4)]) for i in range(400)], "post_id long, vector array<double>")
    found = patterns.clustered_peaks(posts, embedded)
    assert "aggregate(" not in plan(found)
    rows = {r["post_id"]: (r["cluster"], r["cluster_size"]) for r in found.collect() if r["post_id"] < 8}
    assert rows == {0: (0, 10), 4: (0, 10), 2: (2, 10), 6: (2, 10), 1: (1, 19), 5: (1, 19), 7: (1, 19), 3: (None, None)}


def test_words_are_split_once(spark):
    df = spark.createDataFrame([("The Red-Hot Boxes!",), ("a",), (None,), ("  ",), ("ponies",)], "x string")
    got = df.select("x", S.normalize(F.col("x")).alias("n"))
    assert plan(got).count("split(") == 1  # some sixty times before
    assert {r["x"]: r["n"] for r in got.collect()} == {"The Red-Hot Boxes!": "red hot box", "a": "", None: None, "  ": "", "ponies": "pony"}


@pytest.mark.parametrize("name", ["drilldown", "term_posts"])
def test_a_task_keeps_a_hundred_posts_of_a_term(spark, name):
    found = plans.QUERIES[name](spark, DATA)
    assert "WindowGroupLimit" in plan(found)  # else a term's posts all meet in one task


@pytest.mark.parametrize("name, most", [("canonicalize", 1), ("override_expand", 1), ("override_merge", 1), ("rollup", 1), ("merge_candidates", 1), ("ranked_decisions", 1), ("stored_rebuild", 1), ("term_children", 1)])
def test_edges_are_made_once(spark, monkeypatch, name, most):
    """What the query writes or returns reads the lines of orders `most` times in all steps that are stored, and never in what it returns but for override_merge."""
    seen = []

    def counted(df, label):
        seen.append(plan(df).count("l_orderkey#") > 0)
        return runtime.materialize(df, label)

    for module in (plans, vectors, rank, stats, landed, composed):
        monkeypatch.setattr(module, "materialize", counted)
    out = plans.QUERIES[name](spark, DATA)
    assert sum(seen) == most and ("l_orderkey#" in plan(out)) == (name == "override_merge")


def test_pairs_of_a_post(spark):
    rows = [("w", "f", 1, t) for t in "abca"] + [("w", "f", 2, "a"), ("w", "f", 2, "b"), ("w", "g", 2, "c"), (None, "f", 1, "a"), (None, "f", 1, "b"), ("w", "f", 3, None)]
    got = rank.cooccurrence(spark.createDataFrame(rows, "world string, facet string, post_id long, canon_term string"))
    found = {(r["term"], r["other"]): (r["shared_posts"], r["rn"], r["share"]) for r in got.collect()}
    assert found == {("a", "b"): (2, 1, 1.0), ("a", "c"): (1, 2, 0.5), ("b", "a"): (2, 1, 1.0), ("b", "c"): (1, 2, 0.5), ("c", "a"): (1, 1, 1.0), ("c", "b"): (1, 2, 1.0)}
    assert plan(got).count("Join") == 1  # that of the sizes


def test_blocks_visited_are_a_list_of_a_vector(spark, monkeypatch):
    """A vector comes out of the task once, with the list of blocks it visits; distances of a task are taken slice by slice."""
    monkeypatch.setattr(balls, "HELD", 50)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 3))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(m)], "g int, id long, v array<double>")
    near = balls.near_blocks(rows, ["g"], 0.5, 5)
    assert "explode(others" in plan(near)
    assert [len(range(*s.indices(60))) for s in balls._slices(60, 20)] == [2] * 30
    met = {}
    for r in near.collect():
        met.setdefault((r["lo"], r["hi"]), []).append((r["id"], r["own"]))
    pairs = {tuple(sorted((x, y))) for (lo, hi), v in met.items() for x, ox in v for y, oy in v if x != y and {ox, oy} == {lo, hi}}
    far = np.linalg.norm(m[:, None] - m[None, :], axis=2)
    assert all((j, i) in pairs for i in range(60) for j in range(i) if far[i, j] <= 0.5)


def test_links_are_thinned_to_a_forest(spark):
    rng = np.random.default_rng(4)
    links = [("a", i, j, float(rng.integers(1, 9))) for i in range(40) for j in range(i)] + [("b", 1, 2, 3.0), ("b", 2, 3, 3.0), ("b", 1, 3, 5.0), ("b", 7, 8, 1.0)]
    df = spark.createDataFrame(links, "g string, a long, b long, d double")
    for part in (10**6, 100):
        got = [tuple(r) for r in density._thinned(runtime.materialize(df, "links"), ["g"], part).collect()]
        assert sorted(r for r in got if r[0] == "b") == [("b", 1, 2, 3.0), ("b", 2, 3, 3.0), ("b", 7, 8, 1.0)]
        for at in range(1, 9):  # the same points hang together at each distance
            mine = [tuple((graph.forest(40, [(np.array(x), np.array(y))]).tolist())) for x, y in (zip(*[(r[1], r[2]) for r in rows if r[0] == "a" and r[3] <= at]) for rows in (links, got))]
            assert mine[0] == mine[1]
    assert len([r for r in got if r[0] == "a"]) < 200 and len(density.least_forest(2, np.array([0, 1]), np.array([1, 0]), np.array([2.0, 1.0]))) == 1


@pytest.mark.parametrize("block, most", [(2000, 1), (4, 10), (4, 1)])
def test_tiles_of_large_blocks(spark, monkeypatch, block, most):
    """Every pair of vectors meets once, whether a block is one tile or several."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SPREAD", 2)
    rows = spark.createDataFrame([("g", i) for i in range(41)], "g string, id long")
    met, most_copies = [], 0
    parts = {}
    for r in vectors._dealt(rows, ["g"], [], most).collect():
        parts.setdefault((r["lo"], r["hi"]), []).append(r)
        most_copies += 1
    for (lo, hi), rs in parts.items():
        ids, own = [r["id"] for r in rs], np.array([r["own"] for r in rs])
        for a, b in vectors.tiles(own, lo, hi):
            assert len(a) <= block and len(b) <= block
            met += [tuple(sorted((ids[x], ids[y]))) for x in a for y in b if a[0] != b[0] or x < y]
    assert sorted(met) == [(i, j) for i in range(41) for j in range(i + 1, 41)]
    assert most_copies == 41 * (1 if block == 2000 else 2 if most == 10 else 11)


def test_one_pass_serves_all_open_bins(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.quantile((u @ u.T)[np.triu_indices(90, 1)], [0, 0.25, 0.5, 0.75, 1])
    jobs = []
    grouped = type(df.groupBy("id")).applyInPandas
    monkeypatch.setattr(type(df.groupBy("id")), "applyInPandas", lambda self, *a: jobs.append(1) or grouped(self, *a))
    for few in (10**6, 5):
        jobs.clear()
        assert np.allclose(vectors.similarity_distribution(df, "id", "v", bins=16, few=few), want, atol=1e-9)
        assert len(jobs) == (1 if few > 5 else len(jobs)) and len(jobs) <= 6  # a pass for each open bin before


def test_pairs_copy_floats_as_floats(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, [6.0, 8.0])], "id long, v array<float>")
    got = vectors.similar_pairs(df, "id", "v", 0.5, blocks=2)
    assert "double" not in plan(got).split("FlatMapGroupsInPandas", 1)[1].split("\n", 1)[1]
    assert {(r["a"], r["b"]): round(r["sim"], 9) for r in got.collect()} == {(1, 2): 0.6, (1, 4): 0.6, (2, 4): 1.0}
