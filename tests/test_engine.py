"""Operators on tiny tables, and every registered query against its SQL form."""

import os
import random
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reelgraph.functions import scalars as S
from reelgraph.operators import graph, overrides, passes, rank, stats, terms, vectors
from reelgraph.plans import queries as plans
from reelgraph.sources import feeds, sinks
from reelgraph.sources.schema import VLM

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    return round(x, 5) if isinstance(x, float) else x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    got = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([cell(r[names.index(c)]) for c in sorted(names)]) for r in got.fetchall())
    assert sorted(repr([cell(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == want


def test_normalize(spark):
    cases = {"Deep Ceramic Plate": "deep ceramic plate", "deep-ceramic plates": "deep ceramic plate", "The Night Market": "night market", "  ": "", "ponies": "pony", "glass": "glass", "boxes": "box", "Café, été!": "café été", "the": "", "ies": "ie"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string").withColumn("got", S.normalize(F.col("x")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_terms_of_a_document(spark):
    docs = [
        (1, '{"products":[{"name":"Bowl","brand":"Acme","prominence":"hero"},{"name":"Bowl","prominence":"incidental"},{"name":""}],"entities":{"brands":["Acme","Zed"]},"punchline":null,"confidence":"low","cta":"none","relationship":{"conflict":"x","register":"unclear","resolution":"y"},"advice":{"specificity":"z"}}', True, None),
        (2, '{"punchline":"ha","relationship":{"conflict":"x","register":"funny","resolution":"y"},"advice":{"specificity":"z"}}', False, "DJ"),
        (3, None, False, None),
    ]
    df = spark.createDataFrame(docs, "post_id long, vlm_raw string, music_original boolean, music_author string").withColumn("vlm", F.from_json("vlm_raw", VLM))
    got = {(r["post_id"], r["facet"], r["raw_term"]): (r["prominence"], r["low_conf"]) for r in terms.extract_terms(df).collect()}
    assert got[(1, "product", "Bowl")] == ("hero", True)
    assert got[(1, "punchline_presence", "no_punchline")] == (None, True) and got[(2, "punchline_presence", "has_punchline")] == (None, False)
    assert (1, "cta", "none") in got and (1, "brand", "Zed") in got and got[(1, "audio_source", "original_audio")] == (None, False)
    assert {k[2] for k in got if "_x_" in k[1]} == {"x x funny", "funny x y", "funny x z"}
    assert {k[1:] for k in got if k[0] == 3} == {("audio_source", "licensed_audio")}


def test_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"code":0,"data":{"videos":[{"video_id":"v1","create_time":"1700000000","play_count":5,"author":{"id":"u","unique_id":"h"},"music_info":{"original":false,"author":"m"}},{"video_id":"v2","create_time":"x","author":{"id":"w"}}]}}')
    (tmp_path / "b.json").write_text('{"code":1,"msg":"no"}')
    good, bad = feeds.payloads(spark, str(tmp_path))
    assert bad.count() == 1 and feeds.accounts(good).first()["handle"] == "h"
    rows = {r["external_id"]: r for r in feeds.posts(good).collect()}
    assert rows["v1"]["views"] == 5 and rows["v2"]["likes"] == 0 and rows["v2"]["posted_at"] is None and rows["v2"]["account_external_id"] == "u"


def test_components_and_linkage(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    table = spark.createDataFrame(edges, "src long, dst long")
    want = {x: find(x) for x in list(parent)}
    for few in (0, 50, 1000):  # all in rounds, the last few edges in one task, all in one task
        assert {r["node"]: r["component"] for r in graph.connected_components(table, few=few).collect()} == want
    nodes = table.select(*(F.struct(F.lit("g").alias("g"), F.format_string("%03d", c).alias("id")).alias(c) for c in ("src", "dst"))).where("src.id <> 'null' AND dst.id <> 'null'")
    got = {int(r["node"]["id"]): int(r["component"]["id"]) for r in graph.connected_components(nodes, few=1000).collect()}
    assert got == want
    assert graph.connected_components(table.limit(0), few=1000).count() == 0
    fan = np.array([[np.cos(a), np.sin(a)] for a in (0, 0.4, 0.8, 1.2)])  # neighbours are near, ends are not
    assert len(set(vectors.upgma(fan, np.cos(0.45)))) == 2
    points = [("g", i, [float(x) for x in np.random.default_rng(i).normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame(points, "g string, id long, v array<double>")
    m = np.array([p[2] for p in points])
    whole = vectors.upgma(m / np.linalg.norm(m, axis=1, keepdims=True), 0.8)
    split = {r["id"]: r["cluster"] for r in vectors.average_linkage(df, ["g"], "id", "v", 0.8).collect()}
    assert split == {i: int(c) for i, c in enumerate(whole)}


def test_overrides(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "term string, action string, target string")
    got = {r["term"]: (r["action"], r["target"]) for r in overrides.resolve(rows(("a", "merge", "b"), ("b", "merge", "c"), ("d", "drop", None), ("e", "child_of", "c"), ("k", "keep", None))).collect()}
    assert got == {"a": ("merge", "c"), "b": ("merge", "c"), "d": ("drop", None), "e": ("child_of", "c")}
    for bad in ([("a", "merge", "b"), ("b", "merge", "a")], [("a", "merge", "b"), ("b", "drop", None)], [("a", "child_of", "b"), ("b", "drop", None)]):
        with pytest.raises(ValueError):
            overrides.resolve(rows(*bad))
    known = spark.createDataFrame([("a",), ("b",)], "canon_term string")
    lines = [(2, "w", "f", "a", "merge", "b"), (3, "w", "f", "a", "drop", None), (4, "x", "f", "a", "drop", None), (5, "w", "f", "b", "merge", None), (6, "w", "f", "z", "keep", None), (7, "w", "f", "b", "merge", "b"), (8, "w", "f", "b", "nope", None), (9, "w", "f", "b", "drop", "a")]
    bad = {r["line"]: r["problems"] for r in overrides.problems(spark.createDataFrame(lines, "line int, world string, facet string, term string, action string, target string"), known, "w", "f").collect()}
    assert sorted(bad) == [3, 4, 5, 6, 7, 8, 9]


def test_floors_and_split(spark):
    rows = [("w", "f", "t", a, p, p, "n", 1.0, False, "r") for a, p in [(1, i) for i in range(9)] + [(2, 10), (3, 11), (4, 12)]]
    edges = spark.createDataFrame(rows, "world string, facet string, canon_term string, account_id long, post_id long, views long, prominence string, metric double, low_conf boolean, raw_term string")
    posts = edges.select("world", "account_id", "post_id", "views", F.lit(True).alias("described"))
    assert stats.term_stats(edges, posts).count() == 1 and stats.term_stats(edges, posts, min_effective=4).count() == 0
    want = lambda w, a, b: w if w != "p" else None if b == "low" else {"ai_generated_person": "c", "real_person": "p"}.get(a)
    cases = [(w, a, b, want(w, a, b)) for w in "pq" for a in ("real_person", "ai_generated_person", "puppet", None) for b in ("low", "medium", None)]
    df = spark.createDataFrame(cases, "w string, a string, b string, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", vectors.routing_split(F.col("w"), F.col("a"), F.col("b"), "p", "c")).collect())
    table = spark.createDataFrame([("k", "old", True)], "key string, note string, favorite boolean")
    patch = spark.createDataFrame([("k", 1, "new", None), ("j", 2, None, True)], "key string, at int, note string, favorite boolean")
    got = {r["key"]: (r["note"], r["favorite"]) for r in sinks.merge_patches(table, patch, "key", "at", {"note": "", "favorite": False}).collect()}
    assert got == {"k": ("new", True), "j": ("", True)}
    assert rank.peaks(spark.createDataFrame([(1, 1, 0), (2, 1, None)], "post_id long, account_id long, views long"))[0].count() == 0
    assert passes.DISCOUNTS and entry.entry(spark).count() > 0


def test_responses_and_expansion(spark):
    rows = [(1, "a", None, '{"summary":"x\\u0000y"}'), (2, "z", None, '{"summary":"x"}'), (3, "c", "boom", '{"summary":"x"}'), (4, "d", None, "no json"), (5, "e", None, None)]
    registered = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "post_id long, file_name string")
    good, rest = feeds.described(spark.createDataFrame(rows, "post_id long, file_name string, error string, raw string"), registered)
    assert [(r["post_id"], r["vlm"]["summary"]) for r in good.collect()] == [(1, "xy")] and sorted(r["post_id"] for r in rest.collect()) == [2, 3, 4, 5]
    edges = spark.createDataFrame([("w", "f", "a", "a1"), ("w", "f", "a", "a2"), ("w", "f", "b", "b1"), ("w", "f", "c", "c1")], "world string, facet string, canon_term string, norm_term string")
    found = overrides.expand(spark.createDataFrame([("a", "merge", "b"), ("c", "drop", None)], "term string, action string, target string"), edges)
    assert sorted(tuple(r)[2:] for r in found.collect()) == [("a1", "merge", "b"), ("a2", "merge", "b"), ("b1", "merge", "b"), ("c1", "drop", None)]
    twice = edges.unionByName(edges.limit(1))
    assert [r["side"] for r in overrides.snapshot_diff(edges, twice).collect()] == ["after"]


@pytest.mark.parametrize("hot", [0, 50, 10**6])
def test_medians_of_hot_keys(spark, hot):
    """One key with most of the rows, null keys, nulls and ties among the values, values that crowd in one bin; hot or not, the medians are the same."""
    rng = random.Random(6)
    rows = [("hot", i % 3, rng.choice([rng.random() * 20, 7.0005 + rng.random() * 1e-4, 7.0, -3.5])) for i in range(900)]
    rows += [("even", 1, float(x)) for x in (1, 2, 3, 10)] + [(None, 2, 4.0), (None, 2, 6.0), ("none", 0, None), ("crowd", 0, None)]
    rows += [("crowd", 0, 5 + i * 1e-9) for i in range(101)] + [("apart", 1, 0.0), ("apart", 1, 19.25)]
    df = spark.createDataFrame(rows, "k string, g int, x double").repartition(4)
    got = stats.with_medians(df, ["k", "g"], {"m": F.col("x"), "twice": F.col("x") * 2}, [F.count("x").alias("n")], hot=hot)
    want = {}
    for k, g, x in rows:
        want.setdefault((k, g), []).extend([] if x is None else [x])
    mid = lambda v: statistics.median(v) if v else None
    found = {(r["k"], r["g"]): (r["m"], r["twice"], r["n"]) for r in got.collect()}
    assert found == {k: (mid(v), mid([2 * x for x in v]), len(v)) for k, v in want.items()}
    assert stats.with_medians(df.limit(0), ["k", "g"], {"m": F.col("x")}, [], hot=hot).count() == 0
