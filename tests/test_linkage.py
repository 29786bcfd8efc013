"""Average linkage in rounds against the chain in memory, and how much of it is looked at anew."""

import numpy as np
import pytest

from reelgraph.operators import vectors


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def clouds(centres, each, spread, seed=0, dims=6):
    rng = np.random.default_rng(seed)
    return unit(np.repeat(rng.normal(size=(centres, dims)), each, axis=0) + rng.normal(size=(centres * each, dims)) * spread)


def frame(spark, groups):
    rows = [(g, i, [float(x) for x in v]) for g, m in groups.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "g string, id long, v array<double>")


def want(groups, cut):
    return {(g, i): int(c) for g, m in groups.items() for i, c in enumerate(vectors.upgma(m, cut))}


@pytest.mark.parametrize("local", [1, 12])
def test_rounds_equal_the_chain(spark, monkeypatch, local):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    groups = {"a": clouds(4, 12, 0.35), "b": clouds(2, 9, 0.6, seed=3)}
    looked = []
    nearest = vectors._nearest

    def counted(now, by, least, asking=None):
        looked.append((now.count(), None if asking is None else asking.count()))
        return nearest(now, by, least, asking)

    monkeypatch.setattr(vectors, "_nearest", counted)
    got = vectors.linkage_rounds(frame(spark, groups), ["g"], 0.7, local)
    assert {(r["g"], r["id"]): r["cluster"] for r in got.collect()} == want(groups, 0.7)
    later = [(n, k) for n, k in looked[1:] if k is not None]
    assert later and sum(k for _, k in later) < sum(n for n, _ in later) or local > 1


def test_ties_and_copies_end(spark):
    square = unit(np.array([[1.0, 0.0, 0.2], [0.0, 1.0, 0.2], [-1.0, 0.0, 0.2], [0.0, -1.0, 0.2]]))
    copies = np.repeat(unit(np.array([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]])), 5, axis=0)
    rows = {"copies": copies}
    got = {(r["g"], r["id"]): r["cluster"] for r in vectors.linkage_rounds(frame(spark, rows), ["g"], 0.95).collect()}
    assert got == want(rows, 0.95) and len(set(got.values())) == 3
    tied = vectors.linkage_rounds(frame(spark, {"s": square}), ["g"], 0.9)
    assert len({r["cluster"] for r in tied.collect()}) == 4


def test_components_above_local_go_through_rounds(spark):
    groups = {"a": clouds(3, 8, 0.3, seed=5)}
    got = vectors.average_linkage(frame(spark, groups), ["g"], "id", "v", 0.75, local=5)
    assert {(r["g"], r["id"]): r["cluster"] for r in got.collect()} == want(groups, 0.75)
