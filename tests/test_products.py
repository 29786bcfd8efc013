"""Products of pairs of blocks: few copies of a vector, no pair worked out in vain, results as by brute force; and steps that are stored, not made anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.operators import density, sentences, terms, vectors
from reelgraph.plans import queries as plans
from reelgraph.plans import rollup as composed
from reelgraph.runtime import materialize

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def clouds(centres, each, spread, seed=0, dims=6):
    rng = np.random.default_rng(seed)
    m = np.repeat(rng.normal(size=(centres, dims)), each, axis=0) + rng.normal(size=(centres * each, dims)) * spread
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frame(spark, groups):
    return spark.createDataFrame([(g, i, [float(x) for x in v]) for g, m in groups.items() for i, v in enumerate(m)], "g string, id long, v array<double>")


def labels(links, n):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("least", [0.5, 0.9])
def test_components_copy_a_vector_to_few_blocks(spark, monkeypatch, least):
    """90 vectors in blocks of 4: each is copied to 6 blocks, not to all that it may reach; components are those of brute force."""
    monkeypatch.setattr(vectors, "BLOCK", 4)
    groups = {"a": clouds(9, 10, 0.3), "b": np.concatenate([clouds(2, 4, 0.2, 1)] * 2)}
    copies = []
    dealt = vectors._dealt
    monkeypatch.setattr(vectors, "_dealt", lambda *a, **k: copies.append(dealt(*a, **k)) or copies[-1])
    got = {(r["g"], r["id"]): r["component"] for r in vectors.threshold_components(frame(spark, groups), ["g"], least).collect()}
    for g, m in groups.items():
        want = labels(np.argwhere(np.triu(m @ m.T >= least, 1)).tolist(), len(m))
        assert [got[g, i] for i in range(len(m))] == want
    assert copies[0].where("g = 'a'").count() == 90 * vectors.SPREAD


def test_blocks_of_large_groups(spark):
    """At the sizes of the largest corpus a vector goes to some ten blocks, and a task holds two of them."""
    rows = spark.createDataFrame([(2000,), (12_500,), (102_000,), (276_000,), (615_000,), (830_000,)], "n long")
    assert [r["b"] for r in rows.select(vectors._blocks(F.col("n"), vectors.TILES).alias("b")).collect()] == [1, 6, 6, 6, 10, 13]


def test_vectors_are_no_keys(spark):
    """Equal vectors meet by hash: the join that names components carries no vector."""
    rows = materialize(frame(spark, {"a": clouds(2, 3, 0.1)}), "rows")
    joins = [x for x in plan(vectors.threshold_components(rows, ["g"], 0.9)).split("\n") if "Join" in x]
    assert joins and not any(f" {c}#" in x or f"({c}#" in x for x in joins for c in "v")


@pytest.mark.parametrize("block, cached", [(2000, 512), (16, 5)])
def test_nearest_and_trees_of_a_pair_of_blocks(monkeypatch, block, cached):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CACHED", cached)
    m = clouds(5, 16, 0.4, 2) * np.linspace(0.5, 3, 80)[:, None]
    own, n, k = np.arange(80) % 2, np.arange(80) % 3 + 1, 5
    full = np.round(np.linalg.norm(m[:, None] - m[None], axis=2), density.DIGITS)
    np.fill_diagonal(full, np.inf)
    for lo, hi in ((0, 0), (0, 1)):
        within = (own[:, None] == lo) & (own[None] == hi)
        far = np.where(within | within.T, full, np.inf)
        best, mass = density.nearest_rows(m, n, own, lo, hi, k)
        assert np.allclose(best, np.sort(far, axis=1)[:, :k], atol=1e-9)
        i, j = np.nonzero(np.isfinite(best))
        assert all(mass[x, y] in n[np.abs(far[x] - best[x, y]) < 1e-9] for x, y in zip(i, j))
        core = np.stack([np.linspace(0.1, 1.5, 80), np.where(np.arange(80) < 8, np.nan, 0.4)], axis=1)
        for c, tree in enumerate(density.block_trees(m, core, own, lo, hi)):
            own_core = core[:, c]
            links = [(max(far[x, y], own_core[x], own_core[y]), x, y) for x in range(80) for y in range(x) if far[x, y] < np.inf and not np.isnan(own_core[x] + own_core[y])]
            for cut in np.quantile([x for x, _, _ in links], [0.02, 0.1, 0.3, 1.0]):
                mine = [(a, b) for a, b, d in zip(*(x.tolist() for x in tree), strict=True) for d in [max(d, own_core[a], own_core[b])] if d <= cut]
                assert labels(mine, 80) == labels([(x, y) for d, x, y in links if d <= cut], 80)


def brute_linkage(m, cut):
    groups = [[i] for i in range(len(m))]
    while len(groups) > 1:
        sims = [(m[a].sum(axis=0) @ m[b].sum(axis=0) / (len(a) * len(b)), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        best, x, y = max(sims)
        if best < cut:
            break
        groups[x] = sorted(groups[x] + groups.pop(y))
    return {i: g[0] for g in groups for i in g}


def test_linkage_is_merged_once(spark):
    """What average_linkage returns is stored: its readers merge nothing again. Clusters are those of plain average linkage."""
    groups = {"a": clouds(4, 6, 0.5, 3), "b": clouds(2, 5, 0.8, 4)}
    out = vectors.average_linkage(frame(spark, groups), ["g"], "id", "v", 0.4)
    assert "FlatMapGroups" not in plan(out)
    assert {(r["g"], r["id"]): r["cluster"] for r in out.collect()} == {(g, i): c for g, m in groups.items() for i, c in brute_linkage(m, 0.4).items()}


def test_linkage_looks_anew_only_where_something_merged(monkeypatch):
    """The chain of nearest neighbours took one product of all rows for each step, some three a row; rounds take few."""
    m = clouds(40, 10, 0.4, 5)
    calls = []
    find = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(len(a[1])) or find(*a, **k))
    label = vectors.upgma(m, 0.5)
    assert len(calls) < 60 and sum(calls) < 4 * len(m) and len(set(label.tolist())) > 10


def test_members_are_stored_once(spark, monkeypatch):
    """Members near their medoid, and the clusters found, are read by several steps and stored for them."""
    seen = []
    monkeypatch.setattr(sentences, "materialize", lambda df, label: seen.append(label) or materialize(df, label))
    stats, tags = sentences.sentence_clusters(plans.fx_turns(spark, DATA), ["world"], threshold=0.45)
    assert seen.count("near") == seen.count("found") == 1
    assert "FlatMapGroups" not in plan(tags) and "FlatMapGroups" not in plan(stats)


def test_distribution_with_equal_values_and_many_passes(spark, monkeypatch):
    """Each pass tells bins by the same rule, also where most similarities are equal; a first pass writes bins, not values."""
    m = np.concatenate([np.eye(5)[np.arange(40) % 5], clouds(3, 10, 0.2, 6, 5)])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.quantile((u @ u.T)[np.triu_indices(70, 1)], [0, 0.25, 0.5, 0.75, 1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    monkeypatch.setattr(np, "histogram", None)  # a search for the bin of each value before
    for block, bins, few in ((2000, 4096, 100_000), (16, 8, 3)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        assert np.allclose(vectors.similarity_distribution(df, "id", "v", bins=bins, few=few), want, atol=1e-9)


def test_rebuild_normalises_a_term_once(spark, monkeypatch):
    rows = [("topic", "Red-Hot Boxes"), ("topic", "Red-Hot Boxes"), ("brand", "The Acmes"), ("cta", "Link in Bios"), ("cta", "Red-Hot Boxes"), ("music_author", "")]
    df = materialize(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, facet string, raw_term string"), "terms")
    once = terms.with_norm_once(df)
    assert "split(" not in plan(once)
    key = lambda d: sorted(tuple(r) for r in d.select("id", "facet", "raw_term", "norm_term", "canon_term").collect())
    assert key(once) == key(terms.with_norm(df)) and once.columns == terms.with_norm(df).columns
    made = []
    extract = terms.extract_terms
    monkeypatch.setattr(composed.terms, "extract_terms", lambda *a, **k: made.append(extract(*a, **k)) or made[-1])
    seen = []

    def stored(df, label):
        text = plan(df)
        seen.append((label, "posexplode(_all#" in text, "l_orderkey#" in text))
        return materialize(df, label)

    for module in (composed, vectors, sentences, composed.stats, composed.passes, terms):
        monkeypatch.setattr(module, "materialize", stored)
    composed.rebuild(plans.fx_described(spark, DATA))
    assert [x for x, opened, _ in seen if opened] == ["terms"] and [x for x, _, lines in seen if lines] == ["posts"]
    assert len(made) == 1
