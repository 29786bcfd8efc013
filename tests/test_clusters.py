"""Density clusters against brute force, repeats, sentence clusters and the map."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.operators import axes, density, layout, passes, sentences, vectors


def brute(points, size):
    """Cluster (smallest index) of each clustered index, by recursion over all distances at which points meet."""
    n = len(points)
    d = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)), density.DIGITS)
    core = np.sort(d, axis=1)[:, size - 1] if n >= size else np.full(n, np.inf)
    meet = np.maximum(np.maximum(core[:, None], core[None]), d)
    cuts = sorted({x for x in meet[np.triu_indices(n, 1)].tolist() if x < np.inf}, reverse=True)
    rate = [1 / max(x, 10.0**-density.DIGITS) for x in cuts]

    def parts(of, cut):
        left, out = set(of), []
        while left:
            todo, got = [min(left)], set()
            while todo:
                i = todo.pop()
                if i not in got:
                    got.add(i)
                    todo += [j for j in left if j not in got and meet[i, j] <= cuts[cut]]
            left -= got
            if len(got) >= size:
                out.append(sorted(got))
        return out

    def best(of, cut):
        """(mass of the best choice, its clusters) for a cluster that stands at a cut."""
        mass, whole, kids = 0.0, of, []
        while cut < len(cuts):
            mass += len(of) * (rate[cut] - rate[cut - 1])
            cut += 1
            kids = parts(of, cut) if cut < len(cuts) else []
            if len(kids) != 1:
                break
            of = kids[0]
        below = [best(k, cut) for k in kids]
        if mass >= sum(b[0] for b in below):
            return mass, [whole]
        return sum(b[0] for b in below), [c for b in below for c in b[1]]

    of, cut = list(range(n)), 0
    while cut < len(cuts) and len(kids := parts(of, cut)) == 1:
        of, cut = kids[0], cut + 1
    if not cuts or cut == len(cuts):
        return {}
    return {i: c[0] for k in kids for c in best(k, cut)[1] for i in c}


@pytest.mark.parametrize("block, local, size", [(2000, 10**6, 5), (7, 10**6, 3), (16, 20, 5)])
def test_density_clusters(spark, monkeypatch, block, local, size):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, (centres, spread) in {"a": (4, 0.18), "b": (6, 0.3), "c": (1, 0.2)}.items():
        mid = rng.normal(size=(centres, 4))
        pts = np.concatenate([m / np.linalg.norm(m) + rng.normal(size=(14, 4)) * spread * (0.4 + i % 3 * 0.4) for i, m in enumerate(mid)] + [rng.normal(size=(8, 4))])
        pts /= np.linalg.norm(pts, axis=1, keepdims=True)
        if g == "b":  # copies, of more and of fewer than a cluster's least size
            pts = np.concatenate([pts, pts[:1].repeat(7, axis=0), pts[20:23].repeat(2, axis=0)])
        want |= {(g, i): c for i, c in brute(pts, size).items()}
        rows += [(g, i, p.tolist()) for i, p in enumerate(pts)]
    grid = np.stack(np.meshgrid(np.arange(4.0), np.arange(4.0)), axis=-1).reshape(-1, 2)  # many equal distances
    pts = np.concatenate([grid, grid + 20.0, [[9.0, 9.0]]])
    want |= {("e", i): c for i, c in brute(pts, size).items()}
    rows += [("e", i, p.tolist()) for i, p in enumerate(pts)]
    df = spark.createDataFrame([*rows, ("a", 999, None), ("d", 1, [1.0, 0.0, 0.0, 0.0])], "g string, id long, v array<double>")
    got = {(r["g"], r["id"]): r["cluster"] for r in density.density_clusters(df, ["g"], "id", "v", size, local).collect()}
    assert len(set(want.values())) > 2 and got == want
    assert density.density_clusters(df.where("g = 'd'"), ["g"], "id", "v", size, local).count() == 0


def test_ties_beyond_what_a_task_takes(spark, monkeypatch):
    """Groups whose links all tie, or tie in a few classes of far more than `local` links; no task sees more than `local` of them."""
    eye = np.eye(40)
    groups = {
        "all": eye[:12],  # every distance is the same
        "two": np.concatenate([eye[:10] * 3, eye[20:30] * 3 + 50]),  # two such sets, far apart
        "nested": np.concatenate([eye[:7], eye[9:16] + 3, eye[18:25] * 2 + 20, eye[36:] * 9 + 90]),
        "few": np.concatenate([eye[:8], eye[:8] + 0.001]),  # pairs first, then all
    }
    rows = [(g, i, p.tolist()) for g, pts in groups.items() for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>")
    want = {(g, i): c for g, pts in groups.items() for i, c in brute(pts, 3).items()}
    got = density.density_clusters(df, ["g"], "id", "v", 3, local=4)
    assert {(r["g"], r["id"]): r["cluster"] for r in got.collect()} == want and want
    links = spark.createDataFrame([(g, i, i + 1, float(i // 50)) for g in "ab" for i in range(200 if g == "a" else 3)], "g string, a long, b long, d double")
    cuts = {r["g"]: (r["to"], r["how"]) for r in density._cuts(links, ["g"], 49).collect()}
    assert cuts == {"a": (0.0, "tie"), "b": (float("inf"), "all")} and density._cuts(links, ["g"], 200) is None
    assert {r["how"] for r in density._cuts(links, ["g"], 50).collect()} <= {"to", "below", "all"}


def test_axes_of_each_group(spark, monkeypatch):
    """Two groups in orthogonal subspaces keep the clusters that each alone has; axes are those of the covariance; groups that nothing is cut from stay."""
    rng = np.random.default_rng(1)
    rows, pts = [], {}
    for g, (at, far) in {"a": (0, 1.0), "b": (4, 0.3)}.items():
        x = np.zeros((80, 8))
        x[:, at : at + 4] = rng.normal(size=(80, 4)) * 0.01 + 1
        x[:40, at] += far
        x[40:, at] -= far
        pts[g] = x
        rows += [(g, i, p.tolist()) for i, p in enumerate(x)]
    rows += [("c", i, p.tolist()) for i, p in enumerate(rng.normal(size=(3, 8)))] + [("c", 9, None), ("c", 10, [1.0])]
    df = spark.createDataFrame(rows, "g string, i long, v array<double>").repartition(5)
    monkeypatch.setattr(axes, "PART", 7)
    got = axes.reduce_dimensions(df, ["g"], "v", 2)
    assert got.columns == df.columns
    out = {(r["g"], r["i"]): np.array(r["v"]) for r in got.collect()}
    assert len(out) == 163 and all(len(out["c", i]) == 8 for i in range(3))
    for g, x in pts.items():
        y = np.array([out[g, i] for i in range(80)])
        _, _, vt = np.linalg.svd(x - x.mean(axis=0))
        want = x @ vt[:2].T
        assert np.allclose(np.abs(y), np.abs(want))
    both = density.density_clusters(axes.reduce_dimensions(df, ["g"], "v", 1), ["g"], "i", "v", 8)
    both = {(r["g"], r["i"]): r["cluster"] for r in both.collect()}
    for g in "ab":
        alone = df.where(F.col("g") == g)
        alone = density.density_clusters(axes.reduce_dimensions(alone, ["g"], "v", 1), ["g"], "i", "v", 8)
        assert {(r["g"], r["i"]): r["cluster"] for r in alone.collect()} == {k: c for k, c in both.items() if k[0] == g}
        assert {c for k, c in both.items() if k[0] == g} == {0, 40}
    widths = df.withColumn("dims", F.explode(F.array(F.lit(1), F.lit(3))))
    sizes = {(r["g"], r["dims"], len(r["v"])) for r in axes.reduce_dimensions(widths, ["g", "dims"], "v", "dims").collect()}
    assert sizes == {("a", 1, 1), ("a", 3, 3), ("b", 1, 1), ("b", 3, 3), ("c", 1, 1), ("c", 3, 8)}
    turned = axes.reduce_dimensions(df.where("g = 'c'"), ["g"], "v", 3, rotate=True).collect()
    assert {len(r["v"]) for r in turned} == {3}


def test_near_dedupe_and_sentences(spark):
    base = "a couple argues about the dishes every single evening after work until midnight number"
    rows = [(i, i % 7, "w", f"{base} {i}", None) for i in range(12)]
    rows += [(100, 3, "w", rows[4][3], None), (200, 1, "w", "one", "the same long transcript of a clip"), (201, 2, "w", "two", "the same long transcript of a clip"), (202, 2, "x", "two", "the same long transcript of a clip"), (300, 1, "w", None, None), (301, 1, "w", "", None)]
    rows += [(400 + i, i, "w", t, None) for i, t in enumerate(["zebra quartz", "mild fjord", "oxen jumped", "blue kiwi"])]
    rows += [(500 + i, i % 6, "w", f"{chr(0x3b1 + i % 24)}γδεζηθικλμνξοπρστυφχψω πρώτη δεύτερη τρίτη τέταρτη {i}", None) for i in range(10)]
    posts = spark.createDataFrame(rows, "post_id long, account_id long, world string, text string, transcript string").withColumns({"metric": F.lit(2.0), "world_median": F.lit(1.5)})
    got = {(r["world"], r["post_id"]): r["representative"] for r in sentences.near_dedupe(posts, ["world"], "post_id", "text", "transcript").collect()}
    assert len(got) == len(rows) and got["w", 100] == 4 and got["w", 201] == 200 and got["x", 202] == 202 and got["w", 300] == 300
    for options in ({"threshold": 0.7}, {}, {"dims": 10}):
        stats, tags = sentences.sentence_clusters(posts, ["world"], **options)
        found = {r["canon_term"][:1]: r for r in stats.collect()}
        assert {k: (r["n_posts"], r["n_accounts"]) for k, r in found.items() if k == "a"} == {"a": (12, 7)} and len(found) == 2, options
        assert sorted((r["n_posts"], r["n_accounts"]) for r in found.values()) == [(10, 6), (12, 7)], options
        assert all(r["canon_term"] not in r["variants"] and len(r["variants"]) == 5 and r["lift"] == 0.5 for r in found.values())
        assert sorted(r["post_id"] for r in tags.where("canon_term LIKE 'a couple%'").collect()) == [*range(12), 100]


def test_layout(spark):
    worlds = spark.createDataFrame([("p", [1.0, 0.0, 0.0]), ("q", [0.0, 1.0, 0.0])], "slug string, centroid array<double>")
    posts = spark.createDataFrame([(1, "p", 0.9, [1.0, 0.1, 0.0]), (2, "q", 0.5, [0.2, 1.0, 0.3]), (3, "z", None, [0.0, 0.1, 1.0]), (4, "p", 0.7, None)], "post_id long, world string, cosine double, v array<double>")
    raw = layout.positions(posts, worlds, "post_id", "v")
    got = {(r["kind"], r["id"]): np.array([r["x"], r["y"], r["z"]]) for r in layout.layout(raw).collect()}
    flat = {(r["kind"], r["id"]): np.array([r["x"], r["y"], r["z"]]) for r in raw.collect()}
    lo, hi = np.min(list(flat.values()), axis=0), np.max(list(flat.values()), axis=0)
    at = {k: (v - (lo + hi) / 2) / ((hi - lo) / 2).max() for k, v in flat.items()}
    assert len(got) == 5 and np.allclose(got["post", "3"], at["post", "3"])
    assert np.allclose(got["post", "1"], at["post", "1"] + (at["world", "p"] - at["post", "1"]) * 0.87)
    assert np.allclose(got["post", "2"], at["post", "2"] + (at["world", "q"] - at["post", "2"]) * 0.32)
    assert layout.positions(posts.limit(1), worlds, "post_id", "v").count() == 0


def test_caption_and_buckets(spark):
    rows = [(1, "Dog eats cake!", "A dog, a cake.", 7), (2, "free shoes", "a cat sleeps", 8), (3, None, "x", 30), (4, "...", "x", None)]
    df = passes.caption_mismatch(spark.createDataFrame(rows, "id int, a string, b string, n int"), "a", "b").withColumn("bucket", S.duration_bucket(F.col("n")))
    got = {r["id"]: (r["overlap"], r["mismatch"], r["bucket"]) for r in df.collect()}
    assert got == {1: (2 / 3, False, "<8"), 2: (0.0, True, "8-15"), 3: (None, None, "30+"), 4: (None, None, None)}


def test_sweep_equals_single_runs(spark):
    base = "the same few words about a kitchen table and two chairs number"
    rng = np.random.default_rng(5)
    words = "".join(chr(0x61 + i) for i in range(26))
    texts = [(w, f"{base if i < 12 else base[::-1]} {i}") for w in "wx" for i in range(24 if w == "w" else 16)]
    texts += [("x", "".join(rng.choice(list(words), 30))) for _ in range(10)]
    posts = spark.createDataFrame([(i, i, w, x, None) for i, (w, x) in enumerate(texts)], "post_id long, account_id long, world string, text string, transcript string")
    posts = posts.withColumns({"metric": F.lit(2.0), "world_median": F.lit(1.5)})
    options = {"min_posts": 3, "min_accounts": 3}
    got = {(r["world"], r["dims"], r["min_size"]): (r["n_clusters"], r["clustered"], r["n_noise"], r["largest"], r["in_band"]) for r in sentences.sweep(posts, ["world"], [3, 10], [4, 8, 20], **options).collect()}
    want, n = {}, {"w": 24, "x": 26}
    for dims in (3, 10):
        for size in (4, 8, 20):
            stats, _ = sentences.sentence_clusters(posts, ["world"], dims=dims, min_size=size, **options)
            for w in "wx":
                found = sorted((r["n_posts"] for r in stats.collect() if r["world"] == w), reverse=True)
                if found:
                    want[w, dims, size] = (len(found), sum(found), n[w] - sum(found), found[:5], 0.006 * n[w] <= len(found) <= 0.015 * n[w])
    assert got == want and len({k[1] for k in got}) == 2 and {k[0] for k in got} == {"w", "x"}


@pytest.mark.parametrize("least, most", [(0.70, 0.9), (0.78, 0.87), (0.97, 0.5)])
def test_blocks_out_of_reach_are_not_paired(spark, least, most):
    """Components of groups of many blocks equal brute force, and the share of copies that are made stays below `most` of all."""
    from reelgraph.operators import balls

    rng = np.random.default_rng(7)
    mid = rng.normal(size=(30, 12))
    pts = np.concatenate([m / np.linalg.norm(m) + rng.normal(size=(20, 12)) * 0.04 * (1 + i % 4) for i, m in enumerate(mid)])
    pts /= np.linalg.norm(pts, axis=1, keepdims=True)
    line = np.stack([np.cos(np.arange(60) * 0.1), np.sin(np.arange(60) * 0.1), *np.zeros((10, 60))], axis=1)  # a chain through many blocks
    groups = {"cloud": pts, "chain": line, "few": pts[:5]}
    rows = [(g, i, p.tolist()) for g, x in groups.items() for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>").repartition(3)
    size = 25
    dealt = balls.near_blocks(df, ["g"], float(np.sqrt(2 - 2 * least)), size)
    made = {r["g"]: (r["n"], r["blocks"]) for r in dealt.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("own").alias("blocks")).collect()}
    assert made["few"] == (5, 1) and made["cloud"][1] > 10
    share = made["cloud"][0] / (len(pts) * made["cloud"][1])
    print("share of copies", least, round(share, 3))
    assert share <= most
    pairs = {(r["g"], *sorted((r["a"], r["b"]))) for r in dealt.alias("x").join(dealt.alias("y"), ["g", "lo", "hi"]).where("x.id < y.id AND ((lo = hi) OR x.own <> y.own)").select("g", F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()}
    for g, x in groups.items():
        i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
        assert {(g, a, b) for a, b in zip(i.tolist(), j.tolist())} <= pairs, g
