"""Sources, sinks, streams and composed flows on small tables."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.functions import scalars as S
from reelgraph.operators import axes, density, overrides, pages, passes, patterns, rank, routing, sentences, stats, terms, upkeep, vectors
from reelgraph.plans import rollup
from reelgraph.runtime import discard, materialize, scratch, shared_dir
from reelgraph.sources import feeds, sinks, versions
from reelgraph.sources.schema import FEED, VLM
from reelgraph.streaming import incremental

FEED_LINE = '{"code":0,"data":{"cursor":"20","hasMore":true,"total":1,"videos":[{"video_id":"v1","create_time":"1700000000","play_count":5,"author":{"id":"u","unique_id":"ann"}},{"video_id":"v2","author":{"id":"w","unique_id":"bob"}}],"comments":[{"id":"c","text":"hi","create_time":"x","user":{"unique_id":"eve"}}]}}'


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_feeds(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text(FEED_LINE)
    feed, bad = feeds.payloads(spark, str(tmp_path / "f"))
    assert bad.isEmpty()
    c = feeds.comments(feed).first()["comments"]
    assert (c["total"], c["comments"][0]["likes"], c["comments"][0]["posted_at"], c["comments"][0]["author"]) == (1, 0, None, "eve")
    results = feeds.search_results(feed.withColumns({"query": F.lit("q"), "page": F.lit(1)}))
    assert results.first().asDict() == {"query": "q", "page": 1, "handles": ["ann", "bob"], "cursor": "20", "has_more": True}
    walk = spark.createDataFrame([("q", 1, ["a", None, "b"], True), ("q", 2, ["b", "c"], False), ("q", 3, ["z"], True), ("r", 1, [], True), ("r", 2, ["y"], True)], "query string, page int, handles array<string>, has_more boolean")
    walked = feeds.search_pages(walk)
    assert got(walked, "query", "page") == [("q", 1), ("q", 2), ("r", 1)]
    handles = feeds.search_handles(walked)
    assert got(handles, "query", "handle") == [("q", "a"), ("q", "b"), ("q", "c")]
    assert got(rank.first_handles(handles, 2), "handle") == [("a",), ("b",)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "pets.txt").write_text("# note\n  dogs and\n\ncats  \n #x\n")
    assert got(feeds.world_descriptions(spark, str(tmp_path / "w")), "slug", "description") == [("pets", "dogs and\n\ncats")]
    lines = feeds.text_lines(spark, str(tmp_path / "w"))
    assert got(lines, "line") == [("cats",), ("dogs and",)]
    ledger = spark.createDataFrame([("pets", 1)], "world_slug string, round_no int")
    assert feeds.seed_queries(lines, ledger, "pets").count() == 2
    assert feeds.seed_queries(lines, ledger.withColumn("round_no", F.lit(0)), "pets").count() == 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p7.json").write_text('{"summary": "s",\n "topics": ["a"]}')
    assert got(feeds.descriptions(spark, str(tmp_path / "d")), "post_id", "summary") == [("p7", "s")]
    (tmp_path / "o.csv").write_text("world,facet,term,action,target\nw,f,a,merge,b\nw,f,c,drop,\n")
    assert got(feeds.overrides(spark, str(tmp_path / "o.csv")), "term", "target") == [("a", "b"), ("c", None)]
    (tmp_path / "c.json").write_text('[{"world":"w","facet":"f","canon_term":"a"},\n{"world":"w","facet":"f","canon_term":"b"}]')
    found = feeds.candidates(spark, str(tmp_path / "c.json"))
    assert feeds.candidate_scope(found) == ("w", "f") and feeds.candidate_scope(found.limit(0)) is None
    (tmp_path / "l").mkdir()
    for name in ("0b0e7d4e-1111-2222-3333-444455556666.mp4", "no-uuid.mp4"):
        (tmp_path / "l" / name).write_bytes(b"x")
    assert got(feeds.listed_ids(spark, str(tmp_path / "l")), "post_id") == [("0b0e7d4e-1111-2222-3333-444455556666",)]
    assert got(feeds.distinct_of(walk.select(F.explode("handles").alias("h")), "h"), "h") == [(x,) for x in "abcyz"]


def test_sinks(spark, tmp_path):
    accounts = spark.createDataFrame([("id1", "tiktok", "u", "ann")], "account_id string, platform string, external_id string, handle string")
    posts = spark.createDataFrame([("id1", "v1", "w", "q")], "account_id string, external_id string, discovered_by_world string, discovered_by_query string")
    new = spark.createDataFrame([("tiktok", "u", "ann"), ("tiktok", "x", "xan"), ("tiktok", "x", "xan")], "platform string, external_id string, handle string")
    rows = spark.createDataFrame([("u", "v1"), ("u", "v2"), ("x", "v1"), ("x", "v1")], "account_external_id string, external_id string")
    a, p = sinks.store_feed(accounts, posts, new, rows, "pets", "q9")
    made = a.first()
    assert a.count() == 1 and made["external_id"] == "x"
    assert got(p, "account_id", "external_id", "discovered_by_world", "discovered_by_query") == sorted([("id1", "v2", "pets", "q9"), (made["account_id"], "v1", "pets", "q9")])
    table = spark.createDataFrame([(1, "w"), (2, "w")], "post_id int, world string")
    after = routing.store(table, spark.createDataFrame([(1, None), (3, "y")], "post_id int, world string"))
    assert got(after, "post_id", "world") == [(2, "w"), (3, "y")]
    assert got(sinks.replace_for(table, spark.createDataFrame([(2, "z"), (2, "y")], "post_id int, world string"), table.where("post_id = 2"), ["post_id"]), "post_id", "world") == [(1, "w"), (2, "y"), (2, "z")]
    at = str(tmp_path / "parts")
    sinks.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "n int, world string"), at, ["world"])
    sinks.write_partitions(spark.createDataFrame([(3, "b")], "n int, world string"), at, ["world"])
    assert got(spark.read.parquet(at), "n", "world") == [(1, "a"), (3, "b")]
    path = sinks.write_csv(table, str(tmp_path), "peaks_ann", datetime(2024, 5, 6, 7, 8, 9))
    assert path.endswith("peaks_ann_20240506_070809") and spark.read.option("header", True).csv(path).count() == 2
    sinks.write_candidates(spark.createDataFrame([("a", 1), ("b", 9)], "canon_term string, n_posts int").coalesce(1), str(tmp_path / "cand"))
    assert [r["canon_term"] for r in spark.read.json(str(tmp_path / "cand")).collect()] == ["b", "a"]
    rows = spark.createDataFrame([(1, "d", 2), (2, "e", 1)], "id int, vlm string, attempts int")
    clean = sinks.backup_and_reset(rows, F.col("id") == 1, str(tmp_path / "bak"), ["vlm"], ["attempts"])
    assert got(clean, "id", "vlm", "attempts") == [(1, None, 0), (2, "e", 1)] and spark.read.json(str(tmp_path / "bak")).first()["vlm"] == "d"
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    done = sinks.ledger_yield(q, spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "query_id int, handle string"), spark.createDataFrame([("a",)], "handle string"), datetime(2024, 1, 1))
    assert got(done, "query_id", "handles_found", "new_handles", "status", "executed_at") == [(1, 2, 1, "done", datetime(2024, 1, 1)), (2, 0, 0, "done", datetime(2024, 1, 1))]


def test_scalars(spark):
    row = spark.createDataFrame([(1,)], "i int").select(
        S.token_budget(F.lit("  a b\tc d "), 3).alias("budget"), S.premise_text(F.lit(" p "), F.lit("s"), F.array(F.lit("t")), F.lit("x")).alias("p1"),
        S.premise_text(F.lit(""), F.lit("s"), F.array(F.lit("t")), F.lit(None).cast("string")).alias("p2"), S.premise_text(F.lit(None).cast("string"), F.lit("s"), F.array(F.lit("t")), F.lit("not_applicable")).alias("p3"),
        S.about(F.lit("vlog"), F.lit("cat"), F.array(*map(F.lit, ["cat", "a", "b", "c"])), F.lit(" sums ")).alias("about"), S.about(*[F.lit(None).cast("string")] * 2, F.array().cast("array<string>"), F.lit(None).cast("string")).alias("none"),
        S.joined_notes(F.array(F.lit(" a "), F.lit(""), F.lit("b"))).alias("notes"), S.size_band(F.lit(12)).alias("band"), S.in_band(F.lit(5), "3-5").alias("in"), S.in_band(F.lit(5), "6+").alias("out"),
        S.video_url(F.lit("ann"), F.lit("7")).alias("url"), S.iso(F.timestamp_seconds(F.lit(1_700_000_000))).alias("iso"), S.cut(F.lit("abcdef"), 3).alias("cut"),
        S.product_names(F.array(F.struct(F.lit("n").alias("name"), F.lit("b").alias("brand")), F.struct(F.lit("").alias("name"), F.lit("x").alias("brand")), F.struct(F.lit("m").alias("name"), F.lit(None).cast("string").alias("brand")))).alias("names"),
        S.clean_topics(F.array(F.lit(" t "), F.lit(" "), F.lit(None).cast("string"))).alias("topics"), S.advice_text(F.lit(True), F.lit(" go ")).alias("adv"), S.advice_text(F.lit(False), F.lit("go")).alias("noadv"),
        S.terminal(F.lit(None).cast("string"), F.lit(3)).alias("t1"), S.terminal(F.lit(None).cast("string"), F.lit(2)).alias("t2"), S.terminal(F.lit("x"), F.lit(None).cast("int")).alias("t3"),
    ).first()
    assert row["budget"] == "a b c" and (row["p1"], row["p2"], row["p3"]) == ("p", "s t", None)
    assert row["about"] == "vlog · cat — a, b — sums" and row["none"] == "" and row["notes"] == "a · b" and (row["band"], row["in"], row["out"]) == ("10-24", True, False)
    assert row["url"].endswith("@ann/video/7") and row["iso"] == "2023-11-14T22:13:20+00:00" and row["cut"] == "abc" and row["names"] == ["b n", "m"] and row["topics"] == ["t"]
    assert (row["adv"], row["noadv"], row["t1"], row["t2"], row["t3"]) == ("go", None, True, False, True)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "i int").agg(S.fingerprint(F.col("i")).alias("f")).first()["f"]
    assert ids([1, 2, 3]) == ids([3, 2, 1, 1]) != ids([1, 2]) and len(ids([1])) == 16
    df = spark.createDataFrame([(("x",), 10), (("y",), 20), (None, 30)], "vlm struct<a:string>, n int")
    assert df.where(S.stratum("vlm.a", "x")).count() == 1 and df.where(S.stratum("n", 20, "ge")).count() == 2
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        one = spark.range(1).select(S.days_before("2024-01-31", 15).alias("t"), S.iso(F.timestamp_seconds(F.lit(0))).alias("iso")).first()
        assert one["t"].timestamp() == datetime.fromisoformat("2024-01-16T00:00:00+00:00").timestamp() and one["iso"] == "1970-01-01T00:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_streams(spark, tmp_path):
    land, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.1, 1.0])], "post_id long, vector array<double>")
    rows.coalesce(1).write.parquet(land)
    worlds = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "slug string, centroid array<double>")
    state = {"table": spark.createDataFrame([], "post_id long, world string, cosine double, margin double")}

    def upsert(batch, epoch):
        state["table"] = materialize(routing.store(state["table"], batch), "routes")

    for more in ([], [(2, [1.0, 0.2]), (3, [0.0, 1.0])]):
        if more:
            spark.createDataFrame(more, rows.schema).coalesce(1).write.mode("append").parquet(land)
        incremental.route_stream(spark.readStream.schema(rows.schema).parquet(land), worlds, "post_id", "vector", upsert, str(tmp_path / "cp")).awaitTermination()
    assert got(state["table"], "post_id", "world") == [(1, "x"), (2, "x"), (3, "y")]
    feed = str(tmp_path / "feed")
    at = lambda d: datetime(2024, 1, d)
    schema = "account_id long, external_id string, at timestamp"
    spark.createDataFrame([(1, "a", at(1)), (1, "a", at(1)), (1, "b", at(2))], schema).coalesce(1).write.parquet(feed)
    spark.createDataFrame([(1, "b", at(1))], schema).write.parquet(table)
    sink = incremental.append_new(table, ["account_id", "external_id"], ["at"])
    for _ in range(2):
        stream = incremental.ingest_stream(spark.readStream.schema(schema).parquet(feed), "at")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert got(spark.read.parquet(table), "account_id", "external_id") == [(1, "a"), (1, "b")]
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(1, '{"format":"vlog","topics":["a","a","b"],"confidence":"low"}')], "post_id long, raw string").write.parquet(docs)
    posts = spark.readStream.schema("post_id long, raw string").parquet(docs).select("post_id", F.from_json("raw", VLM).alias("vlm"), F.lit(None).cast("boolean").alias("music_original"), F.lit(None).cast("string").alias("music_author"))
    out = str(tmp_path / "terms")
    incremental.term_stream(posts, raw=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination()
    assert got(terms.first_terms(spark.read.parquet(out), ["post_id"]), "facet", "raw_term", "low_conf") == [("format", "vlog", True), ("topic", "a", True), ("topic", "b", True)]


def test_all_facets_of_a_document(spark):
    doc = '{"setting":"kitchen","format_traits":["fast"],"topics":["x"],"music":1,"audio":{"kind":"music"},"relationship":{"stage":"dating","conflict":"money","register":"tender","resolution":"open","perspective":"first"},"advice":{"specificity":"unclear"},"characters":{"pairing":"couple","dynamic":"two rivals"},"synthetic":{"presenter":"none","voice":"unclear"},"pacing":{"energy_arc":"rising","humor_sincerity":"mixed","speaker_dominance":"not_applicable","density":"high"}}'
    df = spark.createDataFrame([(1, doc, False, "DJ")], "post_id long, vlm_raw string, music_original boolean, music_author string").withColumn("vlm", F.from_json("vlm_raw", VLM))
    found = {r["facet"]: r["raw_term"] for r in terms.with_norm(terms.extract_terms(df)).collect()}
    assert found == {
        "setting": "kitchen", "format_trait": "fast", "topic": "x", "audio_kind": "music", "relationship_stage": "dating", "relationship_conflict": "money", "relationship_register": "tender",
        "relationship_resolution": "open", "relationship_perspective": "first", "conflict_x_register": "money x tender", "register_x_resolution": "tender x open", "characters_pairing": "couple",
        "characters_dynamic": "two rivals", "synthetic_presenter": "none", "pacing_energy_arc": "rising", "pacing_humor_sincerity": "mixed", "pacing_density": "high", "audio_source": "licensed_audio", "music_author": "DJ",
    }


def test_patterns(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 8))
    posts = [(i, 1, 100, "vlog", "park", f"sum {i}", str(i), None) for i in range(40)] + [(100 + i, 1, 10_000 * (i + 1), "vlog" if i % 2 else "skit", "park", f"sum {100 + i}", str(i), None) for i in range(4)] + [(200 + i, 2, 50, "v", "p", "s", "e", None) for i in range(3)]
    df = spark.createDataFrame(posts, "post_id long, account_id long, views long, format string, setting string, summary string, external_id string, posted_at timestamp")
    vecs = spark.createDataFrame([(100, base[0].tolist()), (101, (base[0] + 0.05).tolist()), (102, base[1].tolist())], "post_id long, vector array<double>")
    products = spark.createDataFrame([(100, "cup", "Z", "tea"), (101, "cup", None, "park"), (101, "pan", "", "tea")], "post_id long, name string, brand string, topic string")
    notes = spark.createDataFrame([("100", "seen", True)], "key string, note string, favorite boolean")
    found = patterns.patterns(df, products, vecs, notes).collect()
    assert len(found) == 1
    r = found[0]
    assert (r["account_id"], r["key"], r["size"], r["members"], r["names"], r["note"], r["favorite"], r["hidden"], r["n_peaks"]) == (1, "100", 2, [101, 100], ["Z cup", "cup", "pan"], "seen", True, False, 5)
    assert r["about"] == "skit · park — tea — sum 101"
    nested = patterns.account_list(patterns.patterns(df, products, vecs, notes)).collect()
    assert [(x["account_id"], x["largest"], [p["key"] for p in x["patterns"]]) for x in nested] == [(1, 2, ["100"])]
    accounts = spark.createDataFrame([(1, "ann", "tiktok"), (2, "bob", "tiktok"), (3, "bob", "tiktok")], "account_id long, handle string, platform string")
    report = [(x["post_id"], x["cluster_id"], x["cluster_size"]) for x in patterns.peak_report(df, products, vecs, accounts).collect() if x["account_id"] == 1]
    assert report == [(101, "100", 2), (100, "100", 2), (102, "102", 1), (103, "unclustered", 1), (0, "unclustered", 1)]
    assert patterns.resolve_account(accounts, "ann") == 1
    for handle in ("bob", "nobody"):
        with pytest.raises(ValueError):
            patterns.resolve_account(accounts, handle)


def test_pages(spark):
    ranked = spark.createDataFrame([("w", "f", "odd: term/with chars", 9, 4, 1.0, 0.5, ["a", "b"], None), ("w", "f", "b", 9, 4, 2.0, 0.4, ["b"], None), ("w", "f", "c", 5, 5, 3.0, 0.3, ["c"], "b"), ("w", "f", "d", 2, 2, 9.0, 0.2, ["d"], "b"), ("w", "f", "e", 30, 9, 0.5, 0.1, ["e"], None)], "world string, facet string, canon_term string, n_posts int, n_accounts int, lift double, account_lift double, variants array<string>, parent_term string")
    notes = spark.createDataFrame([("w:f:odd: term/with chars", "n", True, 0), ("w:f:e", "", False, -1)], "key string, note string, favorite boolean, sort_order int")
    page = lambda **o: [r["canon_term"] for r in pages.overview(ranked, notes, **o).orderBy("n").collect()]
    assert page() == ["odd: term/with chars", "e", "b"] and page(sort="volume", max_posts=9) == ["odd: term/with chars", "b"]
    assert page(favorites_only=True) == ["odd: term/with chars"] and page(with_children=True) == ["b"] and page(limit=1, offset=1) == ["e"] and page(sort="variants", min_posts=10) == ["e"]
    rows = {r["canon_term"]: (r["children"], r["total"], r["volume_ratio"]) for r in pages.overview(ranked, notes).collect()}
    assert rows["b"] == (["c"], 3, 1.0) and rows["e"][0] == []
    after = {r["key"]: (r["sort_order"], r["favorite"]) for r in pages.reorder(notes, ["w:f:e", "new"]).collect()}
    assert after == {"w:f:odd: term/with chars": (0, True), "w:f:e": (0, False), "new": (1, False)}
    cat = stats.catalogue(spark.createDataFrame([("b",), ("a",)], "world string"), spark.createDataFrame([("a", 1, 1, True)], "world string, post_id int, account_id int, described boolean"), spark.createDataFrame([("a", datetime(2024, 1, 2)), ("a", datetime(2024, 1, 1))], "world string, computed_at timestamp"))
    assert [(r["world"], r["n_posts"], r["computed_at"]) for r in cat.collect()] == [("a", 1, datetime(2024, 1, 2)), ("b", 0, None)]
    per, active = stats.world_counts(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "world string"))
    assert [tuple(r) for r in per.collect()] == [("a", 2), ("b", 1)] and active.first()["n_active"] == 2
    two = spark.createDataFrame([("w", "f", "t", 5, 1.0, 1), ("w", "f", "t", 5, 9.0, 2), ("w", "f", "t", 4, 3.0, 0)], "world string, facet string, canon_term string, n_posts int, lift double, order int")
    assert [r["lift"] for r in stats.dedupe_stats(two).collect()] == [1.0]
    with pytest.raises(ValueError):
        stats.assert_centred(spark.createDataFrame([(1.5,), (2.0,)], "lift double"))
    edges = spark.createDataFrame([("w", "f", "n1", "a"), ("w", "f", "n2", "b")], "world string, facet string, norm_term string, canon_term string")
    decided = spark.createDataFrame([("w", "f", "n1", "merge", "b"), ("w", "f", "n2", "merge", "b")], "world string, facet string, norm_term string, action string, target_term string")
    assert overrides.changed_rows(edges, decided).first()["n"] == 1
    docs = spark.createDataFrame([([("cup", None)],), ([("", "x")],), (None,)], "products array<struct<name:string,brand:string>>")
    assert abs(passes.no_product_rate(docs).first()[0] - 2 / 3) < 1e-12


def test_routing_flow(spark):
    posts = spark.createDataFrame([(1, "red dogs run in parks", "a"), (2, " ", "a"), (3, None, "a"), (4, "red dogs run in parks", "b"), (5, "a cake with cream", "a")], "post_id long, visual_description string, kind string")
    worlds = routing.world_vectors(spark.createDataFrame([("cakes", "cakes", "cream cake"), ("dogs", "dogs", "dogs run"), ("dogs-b", "dogs", "dogs run")], "slug string, description string, snippets string"))
    rules = [("dogs", F.col("kind") == "b", "dogs-b"), ("dogs", F.col("kind") == "a", "dogs")]
    out = routing.route_posts(posts, worlds, rules=rules)
    assert got(out, "post_id", "world") == [(1, "dogs"), (4, "dogs-b"), (5, "cakes")]
    held = routing.route_posts(posts, worlds, rules=[("dogs", F.col("kind") == "b", "dogs-b")])
    table = routing.store(spark.createDataFrame([(1, "old"), (9, "cakes")], "post_id long, world string"), held.select("post_id", "world"))
    assert got(table, "post_id", "world") == [(4, "dogs-b"), (5, "cakes"), (9, "cakes")]
    assert got(routing.route_posts(posts, worlds, table=table, only_new=True), "post_id") == [(1,)]
    def embedder(texts):
        assert len(texts) <= 2 and texts.str.len().max() <= 10
        return vectors.hashed_embedder(texts)

    words = spark.createDataFrame([(f"word number {i}",) for i in range(5)], "norm_term string").coalesce(1)
    known, new = vectors.cached_embed(words, vectors.embed(words.limit(2), None), embedder=embedder, batch=2, most_chars=10)
    assert known.count() == 5 and new.count() == 3


def test_facets_and_rebuild(spark):
    place = ["a narrow kitchen with two chairs", "a beach in the rain"]
    docs = [(i, i // 2 % 6, "w", 100 + i, {"setting": place[i % 2] + f" {i}", "advice": {"present": True, "content": f"always talk to each other before bed {i}"}, "products": [{"name": "cup", "value_signal": {"acquisition_cost": "free"}}]}) for i in range(24)]
    posts = spark.createDataFrame([(a, b, c, d, __import__("json").dumps(e)) for a, b, c, d, e in docs], "post_id long, account_id long, world string, views long, raw string")
    posts = posts.select("post_id", "account_id", "world", "views", F.from_json("raw", VLM).alias("vlm"), F.lit(None).cast("boolean").alias("music_original"), F.lit(None).cast("string").alias("music_author"))
    ranked, edges = rollup.rebuild(posts)
    found = {}
    for r in ranked.collect():
        found.setdefault(r["facet"], []).append(r["n_posts"])
    assert found["product"] == [24] and found["discount_product"] == [24] and sorted(found["setting_cluster"]) == [12, 12] and found["advice_cluster"] == [24]
    assert {"product", "discount_product", "setting_cluster", "advice_cluster"} <= {r["facet"] for r in edges.select("facet").distinct().collect()}


def test_round(spark):
    ledger = spark.createDataFrame([(1, "pets", 1, "Dog tricks", "done"), (2, "pets", 2, "cat naps", "pending"), (3, "pets", 2, "fish", "pending"), (4, "food", 7, "pie", "pending")], "id int, world_slug string, round_no int, query_text string, status string")
    walk = spark.createDataFrame([("cat naps", 1, ["a", "b"], True), ("cat naps", 2, ["c"], False), ("pie", 1, ["z"], False)], "query string, page int, handles array<string>, has_more boolean")
    known = spark.createDataFrame([("a",)], "handle string")
    proposals = spark.createDataFrame([("dog-tricks!",), ("Dog tricks",), ("new thing",), ("??",), ("New Thing",)], "query string")
    out = rollup.run_round(ledger, walk, known, proposals, "pets", datetime(2024, 1, 1), most_handles=2)
    assert got(out["ledger"], "query_id", "handles_found", "new_handles") == [(2, 3, 2), (3, 0, 0)]
    assert got(out["handles"], "query", "handle") == [("cat naps", "a"), ("cat naps", "b")]
    assert got(out["next"], "world_slug", "round_no", "query_text", "status") == [("pets", 3, "New Thing", "pending"), ("pets", 3, "dog-tricks!", "pending")]


def test_tables_are_deleted(spark):
    import os

    with scratch():
        inner = materialize(spark.range(3), "t")
        path = inner._table
        assert inner.count() == 3 and os.path.isdir(path)
    assert not os.path.isdir(path)
    discard(spark.range(1))
    assert os.path.isdir(shared_dir(spark))
    assert axes.reduce_dimensions(spark.createDataFrame([(1, [1.0, 2.0])], T.StructType.fromDDL("i int, v array<double>")), [], "v", 5).count() == 1
    assert sentences.FACETS["advice_cluster"] == 0.45 and FEED and upkeep.id_sets(spark.range(1).toDF("post_id"), spark.range(1).toDF("post_id")).first()["side"] == "both"


def test_strata_over_paths_that_no_schema_declares(spark):
    """Nested names, names with spaces, places in lists, numbers as texts, booleans, missing paths, no JSON."""
    texts = ['{"a":{"b c":"x","n":3},"l":[{"v":1},{"v":9}],"f":true}', '{"a":{"b c":"y","n":"12"},"l":[]}', '{"a":5}', "no json", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("doc", S.document(F.col("t")))
    held = lambda *args: [r["i"] for r in df.where(S.stratum_in(F.col("doc"), *args)).orderBy("i").collect()]
    assert held("a.b c", "x") == [0] and held("a", 5) == [2] and held("a.n", 3) == [0] and held("f", True) == [0]
    assert held("a.n", 10, "ge") == [1] and held("a.n", 10, "lt") == [0] and held("l.1.v", 9) == [0] and held("l.1.v", 1, "ge") == [0]
    assert held("z.z", "x") == [] and df.where(S.stratum_in(F.col("doc"), "z", 1, "lt").isNull()).count() == 5
    with pytest.raises(ValueError):
        S.stratum_in(F.col("doc"), 'a"b', 1)


def test_rebuild_is_stored_at_once_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    edges = lambda *rows: spark.createDataFrame(list(rows), "post_id long, canon_term string")
    ranked = lambda *rows: spark.createDataFrame(list(rows), "world string, canon_term string, n_posts long")
    posts = lambda *rows: spark.createDataFrame(list(rows), "post_id long, world string")
    held = lambda name: sorted(tuple(r) for r in versions.read(spark, root, name).collect())
    assert versions.read(spark, root, "edges") is None
    rollup.write_rebuild(ranked(("w", "a", 2), ("x", "b", 1)), edges((1, "a"), (2, "a"), (3, "b")), posts((1, "w"), (2, "w"), (3, "x")), root)
    first = held("edges"), held("stats")
    assert first == ([(1, "a"), (2, "a"), (3, "b")], [("w", "a", 2), ("x", "b", 1)])
    reader = versions.read(spark, root, "edges")
    # edges are written, the stats fail: readers still see both old tables
    with pytest.raises(Exception, match="half-way"):
        rollup.write_rebuild(ranked(("w", "z", 9)).withColumn("n_posts", F.expr("CAST(raise_error('half-way') AS BIGINT)")), edges((1, "z")), posts((1, "w")), root)
    assert (held("edges"), held("stats")) == first
    # the next one works, and is made from the tables that it replaces; a world without ranked terms loses its stats
    rollup.write_rebuild(ranked(("w", "c", 5)), edges((1, "c")), posts((1, "w"), (2, "w")), root)
    assert (held("edges"), held("stats")) == ([(1, "c"), (3, "b")], [("w", "c", 5), ("x", "b", 1)])
    assert sorted(tuple(r) for r in reader.collect()) == first[0]  # who began before the switch reads on
    assert len([x for x in (tmp_path / "store").iterdir() if x.is_dir()]) == 2
    rollup.write_rebuild(ranked().limit(0), edges().limit(0), posts((3, "x")), root)
    assert (held("edges"), held("stats")) == ([(1, "c")], [("w", "c", 5)])
