"""Registered queries over the given tables, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.operators import density, layout, overrides, pages, passes, patterns, rank, routing, sentences, stats, terms, upkeep, vectors
from reelgraph.plans import rollup as composed
from reelgraph.runtime import materialize
from reelgraph.sources import sinks

THETA = 0.35
POSTS_SQL = """fx_posts AS (SELECT o_orderkey AS post_id, o_custkey AS account_id, c_mktsegment AS world, CAST(floor(o_totalprice) AS BIGINT) AS views, o_orderdate AS posted_at, o_orderstatus = 'P' AS low_conf, o_orderpriority AS format, ln(1 + floor(o_totalprice)) AS metric FROM orders JOIN customer ON o_custkey = c_custkey)"""
PRODUCTS_SQL = """fx_products AS (SELECT l_orderkey AS post_id, p_name AS name, p_brand AS brand, p_type AS topic, CASE WHEN l_quantity >= 25 THEN 'hero' ELSE 'incidental' END AS prominence,
 CASE WHEN d <= 1 THEN 'full_price' WHEN d <= 4 THEN 'not_stated' WHEN d <= 6 THEN 'discount' WHEN d <= 8 THEN 'deep_discount' ELSE 'free' END AS acquisition_cost,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord
 FROM (SELECT *, CAST(round(l_discount * 100) AS INT) AS d FROM lineitem) JOIN part ON l_partkey = p_partkey)"""
NORM_SQL = "lower(replace(name, '-', ' '))"
EDGES_SQL = f"""{POSTS_SQL}, {PRODUCTS_SQL},
edges AS (SELECT post_id, account_id, world, 'product' AS facet, name AS raw_term, prominence, metric, low_conf, CASE WHEN {NORM_SQL} LIKE '%s' AND {NORM_SQL} NOT LIKE '%ss' THEN left({NORM_SQL}, length(name) - 1) ELSE {NORM_SQL} END AS canon_term
 FROM (SELECT *, row_number() OVER (PARTITION BY post_id, name ORDER BY ord) AS k FROM fx_products) JOIN fx_posts USING (post_id) WHERE k = 1)"""


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def fx_posts(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("account_id"), F.col("c_mktsegment").alias("world"), F.floor("o_totalprice").cast("long").alias("views"),
        F.col("o_orderdate").alias("posted_at"), (F.col("o_orderstatus") == "P").alias("low_conf"), F.col("o_orderpriority").alias("format"), F.lit(True).alias("described"),
    )


def fx_products(spark, d):
    """One row per order line; ord is a struct that sorts as the line's place does."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = F.round(F.col("l_discount") * 100).cast("int")
    cost = F.when(p <= 1, "full_price").when(p <= 4, "not_stated").when(p <= 6, "discount").when(p <= 8, "deep_discount").otherwise("free")
    return rows.select(
        F.col("l_orderkey").alias("post_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("topic"),
        F.when(F.col("l_quantity") >= 25, "hero").otherwise("incidental").alias("prominence"), cost.alias("acquisition_cost"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("ord"),
    )


def fx_edges(spark, d):
    """Product edges of posts, first wins, normalised, with the metric."""
    first = terms.first_terms(fx_products(spark, d).select("post_id", F.lit("product").alias("facet"), F.col("name").alias("raw_term"), "prominence", "ord"), ["post_id"])
    posts = fx_posts(spark, d).withColumn("metric", S.metric(F.col("views"))).select("post_id", "account_id", "world", "metric", "low_conf")
    return terms.with_norm(first.join(posts, "post_id"))


def fx_events(spark, d):
    k = F.get_json_object(F.col("props").cast("string"), "$.k").cast("int") if dict(t(spark, d, "events").dtypes)["props"] == "string" else F.col("props.k").cast("int")
    return t(spark, d, "events").select(
        F.col("event_id").alias("post_id"), F.col("user_id").alias("account_id"), F.col("event_type").alias("world"), F.col("ts").cast("timestamp").alias("posted_at"),
        F.floor("value").cast("long").alias("views"), k.alias("k"), F.concat(F.lit("t"), (k % 10).cast("string")).alias("term"),
    )


EVENTS_SQL = "fx_events AS (SELECT event_id AS post_id, user_id AS account_id, event_type AS world, CAST(ts AS TIMESTAMP) AS posted_at, CAST(floor(value) AS BIGINT) AS views, CAST(json_extract_string(props, '$.k') AS INT) AS k, 't' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) AS term FROM events)"

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


STATS_SQL = """acc AS (SELECT world, account_id, median(metric) AS am FROM fx_posts GROUP BY ALL), wm AS (SELECT world, median(metric) AS m FROM fx_posts GROUP BY ALL)"""
RANKED_SQL = f"""{EDGES_SQL}, {STATS_SQL},
g AS (SELECT e.world, facet, canon_term, count(DISTINCT post_id) AS n_posts, count(DISTINCT e.account_id) AS n_accounts, count(*) FILTER (WHERE prominence = 'hero') AS n_hero, median(metric) AS median_m, median(metric - am) AS account_lift, any_value(m) AS m, count(DISTINCT raw_term) AS n_variants
 FROM edges e JOIN acc USING (world, account_id) JOIN wm ON wm.world = e.world WHERE NOT low_conf AND prominence <> 'incidental' GROUP BY ALL HAVING n_posts >= 3 AND n_accounts >= 3)"""


def _ranked(spark, d, edges=None, **floors):
    """Ranked terms, stored: several steps of a query read them."""
    return materialize(stats.term_stats(stats.rankable(fx_edges(spark, d) if edges is None else edges), fx_posts(spark, d), **floors), "terms")


@query(f"WITH {RANKED_SQL.replace('GROUP BY ALL HAVING', 'GROUP BY e.world, facet, canon_term HAVING')} SELECT world, facet, canon_term, n_posts, n_accounts, n_hero, round(median_m, 6) AS median_m, round(median_m - m, 6) AS lift, round(exp(median_m - m), 6) AS view_ratio, round(account_lift, 6) AS account_lift, round(exp(account_lift), 6) AS account_view_ratio, n_variants FROM g")
def term_rollup(spark, d):
    return _ranked(spark, d).select("world", "facet", "canon_term", "n_posts", "n_accounts", "n_hero", *r6("median_m", "lift", "view_ratio", "account_lift", "account_view_ratio"), F.size("variants").cast("long").alias("n_variants"))


@query("SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%s' AND lower(p_name) NOT LIKE '%ss' THEN left(lower(p_name), length(p_name) - 1) ELSE lower(p_name) END AS norm FROM part")
def normalize_terms(spark, d):
    return t(spark, d, "part").select("p_partkey", S.normalize(F.col("p_name")).alias("norm"))


@query(f"WITH {POSTS_SQL}, {PRODUCTS_SQL}, x AS (SELECT post_id, 'product' AS facet, name AS raw_term, prominence, ord FROM fx_products UNION ALL SELECT post_id, 'brand', brand, NULL, ord FROM fx_products UNION ALL SELECT post_id, 'topic', topic, NULL, ord FROM fx_products UNION ALL SELECT post_id, 'format', format, NULL, 0 FROM fx_posts), k AS (SELECT *, row_number() OVER (PARTITION BY post_id, facet, raw_term ORDER BY ord) AS n FROM x) SELECT post_id, facet, raw_term, prominence, low_conf FROM k JOIN fx_posts USING (post_id) WHERE n = 1")
def term_extract_long(spark, d):
    """Through nested documents, as landed descriptions are."""
    p = F.struct("ord", "name", "brand", "prominence", "topic")
    docs = fx_products(spark, d).groupBy("post_id").agg(F.array_sort(F.collect_list(p)).alias("ps"))
    posts = fx_posts(spark, d).join(docs, "post_id", "left")
    none = F.lit(None).cast("string")
    empty = lambda *names: F.struct(*(none.alias(n) for n in names))
    vlm = F.struct(
        F.transform("ps", lambda x: F.struct(x["name"].alias("name"), x["brand"].alias("brand"), x["prominence"].alias("prominence"))).alias("products"),
        F.transform("ps", lambda x: x["topic"]).alias("topics"), F.col("format").alias("format"), none.alias("setting"), none.alias("cta"), F.when(F.col("low_conf"), "low").alias("confidence"), none.alias("punchline"),
        F.lit(None).cast("array<string>").alias("format_traits"), F.struct(F.lit(None).cast("array<string>").alias("brands")).alias("entities"), empty("kind").alias("audio"),
        empty("stage", "conflict", "register", "resolution", "perspective").alias("relationship"), empty("specificity").alias("advice"), empty("pairing", "dynamic").alias("characters"),
        empty("presenter", "voice").alias("synthetic"), empty("energy_arc", "humor_sincerity", "speaker_dominance", "density").alias("pacing"),
    )
    posts = posts.select("post_id", vlm.alias("vlm"), F.lit(None).cast("boolean").alias("music_original"), none.alias("music_author"))
    return terms.extract_terms(posts, raw=None)


@query(f"WITH {POSTS_SQL}, {STATS_SQL} SELECT world, account_id, round(am, 6) AS account_median, round(am - m, 6) AS account_lift FROM acc JOIN wm USING (world)")
def account_lift(spark, d):
    posts = fx_posts(spark, d)
    out = stats.baseline(posts, ["world", "account_id"], "account_median").join(stats.baseline(posts, ["world"], "m"), "world")
    return out.select("world", "account_id", *r6("account_median"), F.round(F.col("account_median") - F.col("m"), 6).alias("account_lift"))


@query(f"WITH {EVENTS_SQL}, n AS (SELECT world, term, account_id, count(DISTINCT post_id) AS n FROM fx_events GROUP BY ALL) SELECT world, term, CAST(sum(n) AS BIGINT) AS n_posts, count(*) AS n_accounts, round(sum(n) * sum(n) / sum(n * n), 6) AS effective_accounts FROM n GROUP BY world, term")
def effective_accounts(spark, d):
    return stats.support(fx_events(spark, d), ["world", "term"]).select("world", "term", "n_posts", "n_accounts", *r6("effective_accounts"))


@query(f"""WITH {EDGES_SQL}, {STATS_SQL}, names AS (SELECT DISTINCT post_id, name AS raw_term FROM fx_products WHERE acquisition_cost IN ('free', 'deep_discount', 'discount')),
rows_ AS (SELECT e.* FROM edges e SEMI JOIN names USING (post_id, raw_term) WHERE NOT low_conf),
s AS (SELECT world, canon_term, sum(n) * sum(n) / sum(n * n) AS eff FROM (SELECT world, canon_term, account_id, count(DISTINCT post_id) AS n FROM rows_ GROUP BY ALL) GROUP BY world, canon_term)
SELECT r.world, 'discount_product' AS facet, r.canon_term, count(DISTINCT post_id) AS n_posts, count(DISTINCT r.account_id) AS n_accounts, round(median(metric) - any_value(m), 6) AS lift, round(median(metric - am), 6) AS account_lift, round(any_value(eff), 6) AS effective_accounts
FROM rows_ r JOIN s USING (world, canon_term) JOIN acc ON acc.world = r.world AND acc.account_id = r.account_id JOIN wm ON wm.world = r.world GROUP BY r.world, r.canon_term HAVING count(DISTINCT post_id) >= 3 AND count(DISTINCT r.account_id) >= 3 AND any_value(eff) >= 4""")
def discount_slice(spark, d):
    out = passes.discount_slice(fx_edges(spark, d), fx_products(spark, d), fx_posts(spark, d))
    return out.select("world", "facet", "canon_term", "n_posts", "n_accounts", *r6("lift", "account_lift", "effective_accounts"))


@query(f"WITH {POSTS_SQL}, {PRODUCTS_SQL} SELECT world, count(*) AS n_total, count(*) FILTER (WHERE acquisition_cost IN ('free', 'deep_discount', 'discount')) AS n_qualifying, round(avg(CASE WHEN acquisition_cost IN ('free', 'deep_discount', 'discount') THEN 1.0 ELSE 0.0 END), 6) AS share FROM fx_products JOIN fx_posts USING (post_id) GROUP BY world")
def discount_counts(spark, d):
    rows = fx_products(spark, d).join(fx_posts(spark, d).select("post_id", "world"), "post_id")
    return passes.discount_counts(rows).select("world", "n_total", "n_qualifying", *r6("share"))


REGISTERS = ["funny", "venting", "tender", "advice", "dramatic", "sarcastic", "educational", "not_applicable"]
CONFLICTS = ["c%d" % i for i in range(11)] + ["not_applicable"]


@query(f"WITH {POSTS_SQL}, x AS (SELECT world, metric, {REGISTERS}[post_id % 8 + 1] AS a, {CONFLICTS}[post_id % 12 + 1] AS b FROM fx_posts) SELECT world, b || ' x ' || a AS raw_term, count(*) AS n, round(median(metric), 6) AS median_m FROM x WHERE a <> 'not_applicable' AND b <> 'not_applicable' GROUP BY ALL")
def crosstab_cells(spark, d):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("post_id") % n).cast("int"))
    rows = fx_posts(spark, d).withColumns({"register": pick(REGISTERS, 8), "conflict": pick(CONFLICTS, 12)})
    return passes.crosstab(rows, "conflict", "register", "conflict_x_register").groupBy("world", "raw_term").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(S.metric(F.col("views"))), 6).alias("median_m"))


@query(f"WITH {POSTS_SQL} SELECT world, count(*) AS n_posts, count(DISTINCT account_id) AS n_accounts, 1.0::DOUBLE AS vlm_coverage FROM fx_posts GROUP BY world")
def world_catalog(spark, d):
    posts = fx_posts(spark, d)
    return stats.catalogue(t(spark, d, "customer").select(F.col("c_mktsegment").alias("world")).distinct(), posts)


@query(f"WITH {POSTS_SQL}, {PRODUCTS_SQL}, n AS (SELECT post_id, count(*) AS k FROM fx_products GROUP BY post_id) SELECT world, count(*) AS n_posts, count(*) AS n_with_vlm, count(*) FILTER (WHERE low_conf) AS n_low_conf, round(avg(CASE WHEN k IS NULL THEN 1.0 ELSE 0.0 END), 6) AS no_product_rate, count(DISTINCT account_id) AS n_accounts, round(exp(median(metric)) - 1, 3) AS median_views FROM fx_posts LEFT JOIN n USING (post_id) GROUP BY world")
def coverage(spark, d):
    n = fx_products(spark, d).groupBy("post_id").agg(F.count(F.lit(1)).alias("n_products"))
    out = stats.coverage(fx_posts(spark, d).join(n, "post_id", "left").fillna(0, ["n_products"]))
    return out.select("world", "n_posts", "n_with_vlm", "n_low_conf", *r6("no_product_rate"), "n_accounts", F.round("median_views", 3).alias("median_views"))


@query(f"WITH {RANKED_SQL.replace('GROUP BY ALL HAVING', 'GROUP BY e.world, facet, canon_term HAVING')}, v AS (SELECT *, n_posts / median(n_posts) OVER (PARTITION BY world, facet) AS volume_ratio FROM g), a AS (SELECT *, canon_term LIKE 'b%' AS favorite FROM v WHERE n_posts >= 6 AND n_accounts >= 4) SELECT world, canon_term, n_posts, favorite, round(volume_ratio, 6) AS volume_ratio, n FROM (SELECT *, row_number() OVER (PARTITION BY world ORDER BY favorite DESC, round(median_m - m, 9) DESC, canon_term) AS n FROM a) WHERE n > 5 AND n <= 15")
def overview_page(spark, d):
    """Rows 6 to 15 of each world's overview; terms with an annotation (here: that begin with b) come first."""
    ranked = _ranked(spark, d)
    notes = ranked.where("canon_term LIKE 'b%'").select(S.term_key(F.col("world"), F.col("facet"), F.col("canon_term")).alias("key"), F.lit(True).alias("favorite"))
    rows = pages.overview(ranked, notes, min_posts=6, min_accounts=4, limit=10, offset=5)
    return rows.select("world", "canon_term", "n_posts", "favorite", *r6("volume_ratio"), "n")


@query(f"WITH {EDGES_SQL}, x AS (SELECT world, canon_term, post_id, min(raw_term) AS raw_term, any_value(metric) AS metric FROM edges GROUP BY world, canon_term, post_id), k AS (SELECT *, row_number() OVER (PARTITION BY world, canon_term ORDER BY round(metric, 9) DESC, post_id) AS n FROM x) SELECT world, canon_term, post_id, raw_term, n FROM k WHERE n <= 100")
def drilldown(spark, d):
    from pyspark.sql import Window

    rows = fx_edges(spark, d).groupBy("world", "canon_term", "post_id").agg(F.min("raw_term").alias("raw_term"), F.max("metric").alias("metric"))
    n = F.row_number().over(Window.partitionBy("world", "canon_term").orderBy(F.round("metric", 9).desc(), "post_id"))
    rows = rows.withColumn("n", n).where("n <= 100")  # not cast before: so tasks keep a hundred of a term before rows move
    return rows.select("world", "canon_term", "post_id", "raw_term", F.col("n").cast("long").alias("n"))


@query(f"WITH {EDGES_SQL}, p AS (SELECT DISTINCT world, post_id, canon_term FROM edges), s AS (SELECT a.world, a.canon_term AS term, b.canon_term AS other, count(*) AS shared_posts FROM p a JOIN p b ON a.world = b.world AND a.post_id = b.post_id AND a.canon_term <> b.canon_term GROUP BY ALL), n AS (SELECT world, canon_term AS term, count(*) AS n FROM p GROUP BY ALL) SELECT world, term, other, shared_posts, rn, round(shared_posts / n, 3) AS share FROM (SELECT *, row_number() OVER (PARTITION BY world, term ORDER BY shared_posts DESC, other) AS rn FROM s) JOIN n USING (world, term) WHERE rn <= 5")
def cooccurrence_topn(spark, d):
    return rank.cooccurrence(fx_edges(spark, d)).select("world", "term", "other", "shared_posts", F.col("rn").cast("long").alias("rn"), "share")


@query(f"WITH {EDGES_SQL}, n AS (SELECT world, left(canon_term, 2) AS cluster, canon_term AS norm_term, count(*) AS n FROM edges GROUP BY ALL) SELECT world, cluster, norm_term AS canon_term FROM (SELECT *, row_number() OVER (PARTITION BY world, cluster ORDER BY n DESC, norm_term) AS k FROM n) WHERE k = 1")
def canon_label(spark, d):
    counts = fx_edges(spark, d).groupBy("world", F.substring("canon_term", 1, 2).alias("cluster"), "norm_term").agg(F.count(F.lit(1)).alias("n"))
    return stats.canonical_labels(counts, ["world", "cluster"])


@query("WITH RECURSIVE t AS (SELECT p_partkey AS term, p_partkey // 3 AS target FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 2), w AS (SELECT term, target FROM t UNION ALL SELECT w.term, t.target FROM w JOIN t ON w.target = t.term) SELECT CAST(term AS VARCHAR) AS term, CAST(min(target) AS VARCHAR) AS target FROM w GROUP BY term")
def override_chain(spark, d):
    """Merges of part n into n / 3, followed to their ends."""
    rows = t(spark, d, "part").where("p_partkey % 3 = 0 AND p_partkey > 2").select(F.col("p_partkey").cast("string").alias("term"), F.lit("merge").alias("action"), F.expr("p_partkey div 3").cast("string").alias("target"))
    return overrides.resolve(rows).select("term", "target")


@query(f"WITH {EDGES_SQL}, o AS (SELECT DISTINCT world, canon_term, min(canon_term) OVER (PARTITION BY world, left(canon_term, 1)) AS target FROM edges), x AS (SELECT e.world, coalesce(CASE WHEN e.canon_term <> o.target THEN o.target END, e.canon_term) AS canon_term, post_id FROM edges e JOIN o USING (world, canon_term)) SELECT world, canon_term, count(DISTINCT post_id) AS n_posts FROM x GROUP BY ALL")
def override_merge(spark, d):
    """Terms merged into the first of their world that begins alike."""
    edges = fx_edges(spark, d)
    names = materialize(edges.select("world", "facet", "norm_term", "canon_term").distinct(), "names")
    first = names.groupBy("world", "facet", F.substring("canon_term", 1, 1).alias("c")).agg(F.min("canon_term").alias("target_term"))
    rows = names.select("world", "facet", "norm_term", F.substring("norm_term", 1, 1).alias("c")).distinct().join(first, ["world", "facet", "c"]).where("norm_term <> target_term").withColumn("action", F.lit("merge"))
    return overrides.apply_merges(edges, rows).groupBy("world", "canon_term").agg(F.count_distinct("post_id").alias("n_posts"))


@query(f"WITH {RANKED_SQL.replace('GROUP BY ALL HAVING', 'GROUP BY e.world, facet, canon_term HAVING')}, p AS (SELECT world, canon_term, n_posts, min(canon_term) OVER (PARTITION BY world, left(canon_term, 1)) AS target FROM g WHERE canon_term NOT LIKE 'c%') SELECT world, canon_term, n_posts, CASE WHEN target <> canon_term THEN target END AS parent_term FROM p")
def term_children(spark, d):
    """Terms nest under the first ranked one that begins alike; terms with c are dropped."""
    ranked = _ranked(spark, d).select("world", "facet", "canon_term", "n_posts")
    first = ranked.groupBy("world", "facet", F.substring("canon_term", 1, 1).alias("c")).agg(F.min("canon_term").alias("target"))
    rows = ranked.withColumn("c", F.substring("canon_term", 1, 1)).join(first, ["world", "facet", "c"])
    rows = rows.withColumn("action", F.when(F.col("c") == "c", "drop").when(F.col("target") != F.col("canon_term"), "child_of")).where("action IS NOT NULL")
    return overrides.apply_child_and_drop(ranked, rows.select("world", "facet", "canon_term", "action", "target")).select("world", "canon_term", "n_posts", "parent_term")


PEAKS_SQL = """m AS (SELECT account_id, median(metric) AS med, count(*) AS n_total FROM fx GROUP BY account_id), a AS (SELECT account_id, median(abs(metric - med)) AS mad FROM fx JOIN m USING (account_id) GROUP BY account_id),
x AS (SELECT fx.*, med, n_total, mad, n_total >= 10 AND mad <> 0 AS z, CASE WHEN n_total >= 10 AND mad <> 0 THEN 0.6745 * (metric - med) / mad END AS modified_z, row_number() OVER (PARTITION BY account_id ORDER BY metric DESC, post_id) AS k FROM fx JOIN m USING (account_id) JOIN a USING (account_id)),
p AS (SELECT * FROM x WHERE (z AND modified_z >= 3.5) OR (NOT z AND k <= greatest(1, ceil(0.10::DOUBLE * n_total))))"""


@query(f"WITH {POSTS_SQL}, fx AS (SELECT * FROM fx_posts), {PEAKS_SQL} SELECT account_id, post_id, round(metric, 6) AS metric, round(modified_z, 6) AS modified_z FROM p")
def peaks_mad(spark, d):
    return rank.peaks(fx_posts(spark, d))[0].select("account_id", "post_id", *r6("metric", "modified_z"))


@query(f"WITH {POSTS_SQL}, fx AS (SELECT * FROM fx_posts), {PEAKS_SQL}, c AS (SELECT account_id, count(*) AS n_peaks, min(metric) AS low FROM p GROUP BY account_id) SELECT account_id, CASE WHEN n_total >= 10 AND mad <> 0 THEN 'modified_z_score' ELSE 'top_10_percent' END AS method, CAST(floor(round(CASE WHEN n_total >= 10 AND mad <> 0 THEN exp(3.5 * mad / 0.6745 + med) ELSE exp(low) END - 1, 6)) AS BIGINT) AS cutoff_views, n_total, coalesce(n_peaks, 0) AS n_peaks FROM m JOIN a USING (account_id) LEFT JOIN c USING (account_id)")
def peaks_cutoff(spark, d):
    return rank.peaks(fx_posts(spark, d))[1].select("account_id", "method", "cutoff_views", "n_total", "n_peaks")


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT *, ln(1 + views) AS m, coalesce(posted_at >= TIMESTAMP '2024-01-31' - INTERVAL 15 DAY, false) AS r FROM fx_events WHERE views IS NOT NULL), b AS (SELECT world, median(m) AS b FROM e GROUP BY world),
g AS (SELECT world, term, count(*) FILTER (WHERE r) AS recent_n, count(*) FILTER (WHERE NOT r) AS older_n, coalesce(median(m) FILTER (WHERE r) - any_value(b), 0) AS rl, coalesce(median(m) FILTER (WHERE NOT r) - any_value(b), 0) AS ol FROM e JOIN b USING (world) GROUP BY world, term)
SELECT world, term, recent_n, older_n, round(rl, 6) AS recent_lift, round(ol, 6) AS older_lift, CASE WHEN rl > 0 AND recent_n >= 15 THEN 'proven' WHEN rl > 0 THEN 'emerging' WHEN recent_n >= 15 THEN 'saturated' ELSE 'dead' END AS quadrant FROM g""")
def recency_quadrant(spark, d):
    return passes.recency(fx_events(spark, d), "2024-01-31", 15).select("world", "term", "recent_n", "older_n", *r6("recent_lift", "older_lift"), "quadrant")


@query(f"WITH {EVENTS_SQL}, e AS (SELECT *, ln(1 + views) AS m FROM fx_events WHERE k < 15 AND views <> 0), b AS (SELECT world, median(m) AS b FROM e GROUP BY world) SELECT world, term, count(*) AS n, count(DISTINCT account_id) AS n_accounts, round(median(m) - any_value(b), 6) AS lift FROM e JOIN b USING (world) GROUP BY world, term HAVING count(*) >= 3 AND count(DISTINCT account_id) >= 3")
def stratified_lift(spark, d):
    return passes.stratified(fx_events(spark, d), S.stratum("k", 15, "lt")).select("world", "term", "n", "n_accounts", *r6("lift"))


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT fx_events.*, CAST(json_extract_string(props, '$.k') AS INT) AS place, ln(1 + views) AS m FROM fx_events JOIN events ON post_id = event_id WHERE views <> 0),
e AS (SELECT 'low' AS stratum, * FROM x WHERE place < 15 UNION ALL SELECT 'seven', * FROM x WHERE place = 7), b AS (SELECT stratum, world, median(m) AS b FROM e GROUP BY ALL)
SELECT e.stratum, e.world, term, count(*) AS n, count(DISTINCT account_id) AS n_accounts, round(median(m) - any_value(b), 6) AS lift FROM e JOIN b ON e.stratum = b.stratum AND e.world = b.world GROUP BY e.stratum, e.world, term HAVING count(*) >= 3 AND count(DISTINCT account_id) >= 3""")
def strata_paths(spark, d):
    """Strata by a path of the events' JSON, which is landed as text."""
    doc = t(spark, d, "events").select(F.col("event_id").alias("post_id"), S.document(F.col("props")).alias("doc"))
    rows = fx_events(spark, d).join(doc, "post_id")
    strata = {"low": S.stratum_in(F.col("doc"), "k", 15, "lt"), "seven": S.stratum_in(F.col("doc"), "k", 7)}
    low, seven = (passes.stratified(rows, held).withColumn("stratum", F.lit(name)) for name, held in strata.items())
    return low.unionByName(seven).select("stratum", "world", "term", "n", "n_accounts", *r6("lift"))


@query(f"WITH {EVENTS_SQL}, e AS (SELECT world, term, {REGISTERS}[post_id % 8 + 1] AS register, CASE WHEN views <> 0 THEN ln(1 + views) END AS m FROM fx_events), b AS (SELECT world, term, count(*) AS n_posts, median(m) AS b FROM e GROUP BY ALL), x AS (SELECT world, term, register, count(*) AS n, CASE WHEN count(m) >= 3 THEN round(exp(median(m) - any_value(b)), 9) END AS ratio FROM e JOIN b USING (world, term) GROUP BY world, term, register), y AS (SELECT world, term, first(register ORDER BY n DESC, register) AS modal_register, first(register ORDER BY ratio DESC, register) FILTER (WHERE ratio IS NOT NULL) AS highest_lift_register FROM x GROUP BY world, term) SELECT world, term, n_posts, modal_register, highest_lift_register, coalesce(modal_register <> highest_lift_register, false) AS register_mismatch FROM b JOIN y USING (world, term)")
def cluster_profile(spark, d):
    rows = fx_events(spark, d).withColumn("register", F.get(F.array(*map(F.lit, REGISTERS)), (F.col("post_id") % 8).cast("int")))
    return passes.register_profile(rows, ["world", "term"])


@query(f"WITH {EVENTS_SQL} SELECT world, 'term' AS field, term AS value, count(*) AS n FROM fx_events GROUP BY ALL UNION ALL SELECT world, 'k', CAST(k AS VARCHAR), count(*) FROM fx_events GROUP BY ALL")
def enum_distribution(spark, d):
    return passes.enum_distribution(fx_events(spark, d), ["world"], ["term", "k"])


@query("SELECT role, median(n) AS median_turns FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY role")
def dialogue_turns(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n")).groupBy("role").agg(F.median("n").alias("median_turns"))


@query("SELECT doc_id, source, rn, CAST(cum AS BIGINT) AS cum FROM (SELECT doc_id, source, row_number() OVER w AS rn, sum(n_chars) OVER w AS cum FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE rn = 1 OR (cum <= 50000 AND rn <= 10000)")
def budget_prefix(spark, d):
    return rank.budget_prefix(t(spark, d, "documents"), ["source"], "doc_id", "n_chars", 50_000).select("doc_id", "source", F.col("rn").cast("long").alias("rn"), "cum")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def set_diff(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL ORDER BY doc_id LIMIT 100")
def claim_pending(spark, d):
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("attempts", F.lit(0))
    return rank.pending(rows, "quality", "attempts", "doc_id", 100).select("doc_id")


@query(f"WITH {EVENTS_SQL}, f AS (SELECT DISTINCT world, k, account_id FROM fx_events WHERE k < 40), kn AS (SELECT DISTINCT account_id FROM fx_events WHERE views > 50) SELECT world || ':' || k AS query_id, (SELECT count(*) FROM f WHERE f.world = q.world AND f.k = q.k) AS handles_found, (SELECT count(*) FROM f WHERE f.world = q.world AND f.k = q.k AND account_id NOT IN (SELECT account_id FROM kn)) AS new_handles, 'done' AS status FROM (SELECT DISTINCT world, k FROM fx_events) q")
def ledger_yield(spark, d):
    e = fx_events(spark, d).withColumn("query_id", F.concat_ws(":", "world", F.col("k").cast("string"))).withColumn("handle", F.col("account_id"))
    return sinks.ledger_yield(e.select("query_id").distinct(), e.where("k < 40").select("query_id", "handle"), e.where("views > 50").select("handle"))


@query(f"WITH {POSTS_SQL}, {PRODUCTS_SQL}, c AS (SELECT world, 'product' AS kind, name AS value, count(*) AS n FROM fx_products JOIN fx_posts USING (post_id) GROUP BY ALL UNION ALL SELECT world, 'topic', topic, count(*) FROM fx_products JOIN fx_posts USING (post_id) GROUP BY ALL UNION ALL SELECT world, 'format', format, count(*) FROM fx_posts GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY world, kind ORDER BY n DESC, value) AS rn FROM c) WHERE rn <= 8")
def evidence_topk(spark, d):
    posts = fx_posts(spark, d)
    rows = fx_products(spark, d).join(posts.select("post_id", "world"), "post_id")
    long = rows.select("world", F.lit("product").alias("kind"), F.col("name").alias("value")).unionByName(rows.select("world", F.lit("topic").alias("kind"), F.col("topic").alias("value")))
    long = long.unionByName(posts.select("world", F.lit("format").alias("kind"), F.col("format").alias("value")))
    return rank.top_values(long, ["world", "kind"], "value", 8).withColumn("rn", F.col("rn").cast("long"))


@query(f"WITH {EVENTS_SQL}, o AS (SELECT account_id, min(post_id) AS post_id FROM fx_events GROUP BY ALL), n AS (SELECT account_id, max(post_id) AS post_id FROM fx_events WHERE k >= 50 GROUP BY ALL) SELECT account_id, coalesce(n.post_id, o.post_id) AS post_id FROM o LEFT JOIN n USING (account_id)")
def upsert_latest(spark, d):
    e = fx_events(spark, d)
    table = e.groupBy("account_id").agg(F.min("post_id").alias("post_id"))
    return sinks.upsert(table, e.where("k >= 50").select("account_id", "post_id"), ["account_id"], "post_id")


@query(f"WITH {EVENTS_SQL}, p AS (SELECT account_id, max_by(views, post_id) FILTER (WHERE k % 2 = 0) AS note, max_by(k, post_id) FILTER (WHERE k % 3 = 0) AS rank FROM fx_events GROUP BY ALL) SELECT account_id, coalesce(note, -1) AS note, coalesce(rank, -1) AS rank FROM p")
def merge_patch(spark, d):
    e = fx_events(spark, d)
    patches = e.select("account_id", "post_id", F.when(F.col("k") % 2 == 0, F.col("views")).alias("note"), F.when(F.col("k") % 3 == 0, F.col("k")).alias("rank"))
    table = spark.createDataFrame([], "account_id long, note long, rank int")
    return sinks.merge_patches(table, patches, "account_id", "post_id", {"note": -1, "rank": -1})


CENTROIDS_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), l AS (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), c0 AS (SELECT label, i, avg(x) AS x FROM l GROUP BY ALL), c1 AS (SELECT label, list(x ORDER BY i) AS c FROM c0 GROUP BY label), c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c1), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"


def _worlds(spark, d):
    return vectors.centroids(t(spark, d, "embeddings"), "label", "embedding").select(F.col("label").cast("string").alias("slug"), "centroid")


@query(f"WITH {CENTROIDS_SQL}, s AS (SELECT vec_id, CAST(c.label AS VARCHAR) AS world, list_dot_product(u.v, c.c) AS cosine FROM u, c), k AS (SELECT *, row_number() OVER w AS n, lead(cosine) OVER w AS second FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY cosine DESC, world)) SELECT vec_id, world, round(cosine, 6) AS cosine, round(cosine - second, 6) AS margin FROM k WHERE n = 1")
def route_argmax(spark, d):
    return vectors.route(t(spark, d, "embeddings"), _worlds(spark, d), "vec_id", "embedding").select("vec_id", "world", *r6("cosine", "margin"))


@query(f"WITH {CENTROIDS_SQL}, s AS (SELECT vec_id, CAST(c.label AS VARCHAR) AS world, list_dot_product(u.v, c.c) AS cosine FROM u, c), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, world) AS n FROM s) SELECT vec_id, CASE WHEN world <> '1' THEN world WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN '1-ai' WHEN vec_id % 3 = 1 THEN '1' END AS world FROM k WHERE n = 1")
def routing_split(spark, d):
    routed = vectors.route(t(spark, d, "embeddings"), _worlds(spark, d), "vec_id", "embedding")
    who = F.get(F.array(F.lit("ai_generated_person"), F.lit("real_person"), F.lit("unclear")), (F.col("vec_id") % 3).cast("int"))
    sure = F.when(F.col("vec_id") % 5 == 0, "low")
    return routed.select("vec_id", vectors.routing_split(F.col("world"), who, sure, "1", "1-ai").alias("world"))


@query(f"WITH {CENTROIDS_SQL} SELECT CAST(a.label AS VARCHAR) AS a, CAST(b.label AS VARCHAR) AS b, round(list_dot_product(a.c, b.c), 6) AS sim, list_dot_product(a.c, b.c) > 0.8 AS flagged FROM c a JOIN c b ON CAST(a.label AS VARCHAR) < CAST(b.label AS VARCHAR)")
def world_similarity(spark, d):
    return vectors.similar_pairs(_worlds(spark, d), "slug", "centroid", -1.0).select("a", "b", F.round("sim", 6).alias("sim"), (F.col("sim") > 0.8).alias("flagged"))


PAIRS_SQL = f"{CENTROIDS_SQL}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= {THETA})"


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(sim, 6) AS sim FROM p")
def sim_pairs(spark, d):
    return vectors.similar_pairs(t(spark, d, "embeddings"), "vec_id", "embedding", THETA).select("a", "b", *r6("sim"))


@query(f"WITH RECURSIVE {PAIRS_SQL}, g AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT vec_id, vec_id FROM embeddings), r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a) SELECT a AS vec_id, min(b) AS component FROM r GROUP BY a")
def components(spark, d):
    return vectors.components(t(spark, d, "embeddings"), "vec_id", "embedding", THETA)


@query(f"WITH {PAIRS_SQL} SELECT vec_id, label FROM (SELECT u.vec_id, u.label, list_dot_product(u.v, m.v) AS s FROM u JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(v, c), 12) DESC, vec_id) AS k FROM u JOIN c USING (label)) m ON m.label = u.label AND m.k = 1) WHERE s >= 0.1")
def medoid_prune(spark, d):
    return vectors.prune(t(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.1).select("vec_id", "label")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY trim(text, ' ')) END AS representative FROM documents")
def exact_dedupe(spark, d):
    return vectors.exact_dedupe(t(spark, d, "documents"), "text", "doc_id")


@query()
def average_linkage(spark, d):
    return vectors.average_linkage(t(spark, d, "embeddings"), ["label"], "vec_id", "embedding", THETA)


@query()
def canonicalize(spark, d):
    return vectors.canonicalize(fx_edges(spark, d))


@query("SELECT post_id, world FROM (SELECT event_id AS post_id, event_type AS world, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i % CAST(ceil(n / 400.0) AS INT) = 0")
def systematic_sample(spark, d):
    return rank.systematic_sample(fx_events(spark, d), "world", "post_id", 400).select("post_id", "world")


@query(f"WITH {POSTS_SQL}, {PRODUCTS_SQL}, x AS (SELECT post_id, string_agg(brand || ' ' || name, ', ' ORDER BY ord) AS p, string_agg(topic, ', ' ORDER BY ord) AS tp FROM fx_products GROUP BY post_id) SELECT post_id, world || chr(10) || 'Setting: ' || format || '.' || coalesce(chr(10) || 'Topics: ' || tp || '.', '') || coalesce(chr(10) || 'Products: ' || p || '.', '') AS blob FROM fx_posts LEFT JOIN x USING (post_id)")
def prose_blob(spark, d):
    ps = fx_products(spark, d).groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "brand", "topic"))).alias("ps"))
    rows = fx_posts(spark, d).join(ps, "post_id", "left")
    return rows.select("post_id", S.prose(F.col("world"), F.col("format"), F.transform("ps", lambda p: p["topic"]), F.col("ps")).alias("blob"))




@query(f"WITH {POSTS_SQL}, n AS (SELECT l_orderkey AS post_id, count(*) AS comments FROM lineitem GROUP BY ALL), x AS (SELECT world, format, ln(1 + comments) - ln(1 + views) AS r FROM fx_posts JOIN n USING (post_id) WHERE views <> 0), b AS (SELECT world, median(r) AS b FROM x GROUP BY world) SELECT world, format, count(*) AS n_posts, round(median(r), 6) AS resonance, round(median(r) - any_value(b), 6) AS resonance_lift FROM x JOIN b USING (world) GROUP BY world, format")
def resonance(spark, d):
    """Order lines stand for comments."""
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("post_id")).agg(F.count(F.lit(1)).alias("comments"))
    return passes.resonance(fx_posts(spark, d).join(n, "post_id"), ["format"]).select("world", "format", "n_posts", *r6("resonance", "resonance_lift"))


@query("SELECT event_type AS world, CASE WHEN value < 8 THEN '<8' WHEN value < 15 THEN '8-15' WHEN value < 30 THEN '15-30' ELSE '30+' END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def duration_buckets(spark, d):
    rows = t(spark, d, "events").where("value IS NOT NULL")
    return rows.groupBy(F.col("event_type").alias("world"), S.duration_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT conv_id, role, count(*) AS t, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))) AS w FROM conversations GROUP BY ALL) SELECT conv_id, CAST(sum(t) AS BIGINT) AS n_turns, CAST(sum(w) AS BIGINT) AS n_words, round(sum(w) / sum(t), 6) AS words_per_turn, CASE WHEN sum(w) > 0 THEN round(max(w) / sum(w), 6) END AS speaker_word_ratio FROM e GROUP BY conv_id")
def dialogue_features(spark, d):
    return passes.dialogue_features(t(spark, d, "conversations"), "conv_id", "role", "text").select("conv_id", "n_turns", "n_words", *r6("words_per_turn", "speaker_word_ratio"))


@query(f"WITH {POSTS_SQL}, x AS (SELECT world, metric, {REGISTERS}[post_id % 8 + 1] AS a, {CONFLICTS}[post_id % 12 + 1] AS b FROM fx_posts) SELECT world, b || ' x ' || a || ' x ' || CASE WHEN length(b) % 2 = 0 THEN 'open' ELSE 'closed' END AS raw_term, count(*) AS n, round(median(metric), 6) AS median_m FROM x WHERE a <> 'not_applicable' AND b <> 'not_applicable' GROUP BY ALL")
def crosstab3_cells(spark, d):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("post_id") % n).cast("int"))
    rows = fx_posts(spark, d).withColumns({"register": pick(REGISTERS, 8), "conflict": pick(CONFLICTS, 12)})
    rows = rows.withColumn("resolution", F.when(F.length("conflict") % 2 == 0, "open").otherwise("closed"))
    out = passes.crosstab3(rows, "conflict", "register", "resolution", "conflict_x_register_x_resolution")
    return out.groupBy("world", "raw_term").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(S.metric(F.col("views"))), 6).alias("median_m"))


@query(f"""WITH {POSTS_SQL}, {PRODUCTS_SQL}, h AS (SELECT post_id, bool_or(acquisition_cost = 'free') AS hit FROM fx_products GROUP BY post_id), x AS (SELECT world, metric, hit, median(metric) OVER (PARTITION BY world) AS mid FROM fx_posts JOIN h USING (post_id) WHERE views <> 0),
g AS (SELECT world, count(*) FILTER (WHERE hit AND metric > mid) AS in_above, count(*) FILTER (WHERE hit AND metric <= mid) AS in_below, count(*) FILTER (WHERE NOT hit AND metric > mid) AS out_above, count(*) FILTER (WHERE NOT hit AND metric <= mid) AS out_below, median(metric) FILTER (WHERE hit) - median(metric) FILTER (WHERE NOT hit) AS gap FROM x GROUP BY world),
m AS (SELECT *, (in_above + in_below)::DOUBLE * (out_above + out_below) * (in_above + out_above) * (in_below + out_below) AS p FROM g)
SELECT world, in_above, in_below, out_above, out_below, round(gap, 6) AS median_gap, CASE WHEN p > 0 THEN round((in_above + in_below + out_above + out_below) * (in_above::DOUBLE * out_below - in_below::DOUBLE * out_above) ** 2 / p, 6) END AS chi_square FROM m""")
def free_median_test(spark, d):
    """Posts with a free product against the others."""
    hit = fx_products(spark, d).groupBy("post_id").agg(F.bool_or(F.col("acquisition_cost") == "free").alias("hit"))
    rows = fx_posts(spark, d).withColumn("metric", S.metric(F.col("views"))).join(hit, "post_id")
    return passes.median_test(rows, "world", "hit").select("world", "in_above", "in_below", "out_above", "out_below", *r6("median_gap", "chi_square"))


@query(f"WITH {POSTS_SQL}, e AS (SELECT account_id, format AS c, count(*) AS n FROM fx_posts GROUP BY ALL) SELECT account_id, CAST(sum(n) AS BIGINT) AS n_posts, first(c ORDER BY n DESC, c) AS signature, round(sum(n) * sum(n) / sum(n * n), 6) AS effective, round(max(n) / sum(n), 6) AS share FROM e GROUP BY account_id HAVING sum(n) >= 3")
def format_signature(spark, d):
    return passes.format_signature(fx_posts(spark, d), "format").select("account_id", "n_posts", "signature", *r6("effective", "share"))


@query(f"""WITH {POSTS_SQL}, {PRODUCTS_SQL}, w AS (SELECT world, trim(regexp_replace(lower(q), '[^a-z0-9 ]', '', 'g'), ' ') AS query FROM (SELECT world, topic AS q FROM fx_products JOIN fx_posts USING (post_id) UNION ALL SELECT world, name FROM fx_products JOIN fx_posts USING (post_id)))
SELECT DISTINCT world, query FROM w WHERE query <> '' AND (world, query) NOT IN (SELECT world, trim(regexp_replace(lower(topic), '[^a-z0-9 ]', '', 'g'), ' ') FROM fx_products JOIN fx_posts USING (post_id) WHERE acquisition_cost = 'free')""")
def crawl_round(spark, d):
    """The next queries, where topics of free products were asked before."""
    rows = fx_products(spark, d).join(fx_posts(spark, d).select("post_id", "world", "account_id"), "post_id")
    queries = rows.where("acquisition_cost = 'free'").select(F.concat_ws(":", "world", "topic").alias("query_id"), "world", F.col("topic").alias("query")).distinct()
    found = rows.select(F.concat_ws(":", "world", "topic").alias("query_id"), F.col("account_id").alias("handle"))
    evidence = rows.select("world", F.lit("topic").alias("kind"), F.col("topic").alias("value"))
    proposals = rows.select("world", F.explode(F.array("topic", "name")).alias("query"))
    return composed.crawl_round(queries, found, rows.where("prominence = 'hero'").select(F.col("account_id").alias("handle")), evidence, proposals)[2]


@query()
def rollup(spark, d):
    """All of the rebuild over products: terms that begin with b are nested under the first of their world, those with c dropped."""
    edges = materialize(fx_edges(spark, d), "edges")
    rows = edges.select("world", "facet", "norm_term").distinct().where("norm_term LIKE 'b%' OR norm_term LIKE 'c%'")
    first = rows.where("norm_term LIKE 'b%'").groupBy("world", "facet").agg(F.min("norm_term").alias("target_term"))
    rows = rows.join(first, ["world", "facet"]).withColumn("action", F.when(F.col("norm_term").startswith("c"), "drop").when(F.col("norm_term") != F.col("target_term"), "child_of"))
    return composed.rollup(edges, fx_posts(spark, d), materialize(rows.where("action IS NOT NULL"), "decisions"))[0]


def fx_turns(spark, d):
    """Conversation turns as posts: roles are worlds, conversations accounts, and the text's length the views."""
    rows = t(spark, d, "conversations").select(
        F.col("conv_id").alias("account_id"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("post_id"), F.col("role").alias("world"), "text", F.col("text").alias("transcript"),
        S.metric(F.length("text")).alias("metric"),
    )
    return rows.join(rows.groupBy("world").agg(F.median("metric").alias("world_median")), "world")


@query()
def near_dedupe(spark, d):
    return sentences.near_dedupe(fx_turns(spark, d), ["world"], "post_id", "text", "transcript")


@query()
def sentence_clusters(spark, d):
    return sentences.sentence_clusters(fx_turns(spark, d), ["world"], dims=100)[0]


@query()
def sentence_tags(spark, d):
    """As advice is clustered: by average linkage."""
    return sentences.sentence_clusters(fx_turns(spark, d), ["world"], threshold=0.45)[1]


@query()
def sentence_sweep(spark, d):
    """Widths 16, 32 and 100 against least sizes 4, 8 and 12."""
    return sentences.sweep(fx_turns(spark, d), ["world"], [16, 32, 100], [4, 8, 12])


@query()
def density_clusters(spark, d):
    rows = t(spark, d, "embeddings").withColumn("v", vectors.unit(F.col("embedding"))).withColumn("g", F.lit(0))
    return density.density_clusters(rows, ["g"], "vec_id", "v").drop("g")


@query()
def map_layout(spark, d):
    rows = t(spark, d, "embeddings")
    routed = vectors.route(rows, _worlds(spark, d), "vec_id", "embedding").join(rows.select("vec_id", "embedding"), "vec_id")
    return layout.layout(layout.positions(routed, _worlds(spark, d), "vec_id", "embedding"))


@query(f"WITH {EVENTS_SQL}, e AS (SELECT world, term, {REGISTERS}[post_id % 8 + 1] AS register, ln(1 + views) AS m FROM fx_events WHERE views <> 0), b AS (SELECT world, term, median(m) AS b FROM e GROUP BY ALL) SELECT world, term, register, count(*) AS n, round(exp(median(m) - any_value(b)), 6) AS view_ratio FROM e JOIN b USING (world, term) GROUP BY world, term, register HAVING count(*) >= 3")
def cluster_view_ratio(spark, d):
    rows = fx_events(spark, d).withColumn("register", F.get(F.array(*map(F.lit, REGISTERS)), (F.col("post_id") % 8).cast("int")))
    return passes.register_ratios(rows, ["world", "term"]).select("world", "term", "register", "n", *r6("view_ratio"))


@query(f"""WITH {POSTS_SQL}, {PRODUCTS_SQL}, fx AS (SELECT * FROM fx_posts), {PEAKS_SQL}, i AS (SELECT account_id, brand || ' ' || name AS name, topic FROM p JOIN fx_products USING (post_id)), n AS (SELECT account_id, string_agg(name, ', ' ORDER BY name) AS names FROM i GROUP BY account_id),
c AS (SELECT account_id, topic, count(*) AS k FROM i GROUP BY ALL), t AS (SELECT account_id, string_agg(topic || ':' || k, ', ' ORDER BY k DESC, topic) AS topics FROM c GROUP BY account_id), f AS (SELECT account_id, first(format ORDER BY k DESC, format) AS modal_format FROM (SELECT account_id, format, count(*) AS k FROM p GROUP BY ALL) GROUP BY account_id)
SELECT account_id, names, topics, modal_format FROM f LEFT JOIN n USING (account_id) LEFT JOIN t USING (account_id)""")
def peak_labels(spark, d):
    out = passes.pattern_labels(rank.peaks(fx_posts(spark, d))[0], fx_products(spark, d).select("post_id", "name", "brand", "topic"), ["account_id"])
    topics = F.array_join(F.transform("topics", lambda x: F.concat_ws(":", x["topic"], x["n"].cast("string"))), ", ")
    return out.select("account_id", F.array_join("names", ", ").alias("names"), topics.alias("topics"), "modal_format")


@query(f"""WITH {RANKED_SQL.replace('GROUP BY ALL HAVING', 'GROUP BY e.world, facet, canon_term HAVING')}, p AS (SELECT DISTINCT world, post_id, canon_term FROM edges), s AS (SELECT a.world, a.canon_term, b.canon_term AS other, count(*) AS n FROM p a JOIN p b ON a.world = b.world AND a.post_id = b.post_id AND a.canon_term <> b.canon_term GROUP BY ALL),
near AS (SELECT world, canon_term, string_agg(other || ':' || n, ', ' ORDER BY n DESC, other) AS near FROM (SELECT *, row_number() OVER (PARTITION BY world, canon_term ORDER BY n DESC, other) AS rn FROM s) WHERE rn <= 5 GROUP BY ALL), v AS (SELECT world, canon_term, string_agg(DISTINCT raw_term, ', ' ORDER BY raw_term) AS variants FROM edges WHERE NOT low_conf AND prominence <> 'incidental' GROUP BY ALL)
SELECT world, canon_term, n_posts, n_accounts, canon_term AS norm_terms, variants, near FROM g JOIN v USING (world, canon_term) LEFT JOIN near USING (world, canon_term) WHERE n_posts >= 6 AND n_accounts >= 4""")
def merge_candidates(spark, d):
    edges = materialize(fx_edges(spark, d), "edges")
    out = rank.merge_candidates(edges, _ranked(spark, d, edges))
    near = F.array_join(F.transform("co_occurring", lambda x: F.concat_ws(":", x["term"], x["shared_posts"].cast("string"))), ", ")
    return out.select("world", "canon_term", "n_posts", "n_accounts", F.array_join("norm_terms", ", ").alias("norm_terms"), F.array_join("variants", ", ").alias("variants"), near.alias("near"))


@query(f"WITH {RANKED_SQL.replace('GROUP BY ALL HAVING', 'GROUP BY e.world, facet, canon_term HAVING')}, a AS (SELECT world, canon_term, n_posts, n_accounts FROM g), b AS (SELECT * FROM a WHERE n_posts >= 6 AND n_accounts >= 4 UNION ALL SELECT world, canon_term || '!', n_posts, n_accounts FROM a WHERE n_posts > 20) SELECT *, 'before' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'after' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def snapshot_diff(spark, d):
    """Ranked terms against those above higher floors, with large ones renamed besides."""
    before = _ranked(spark, d).select("world", "canon_term", "n_posts", "n_accounts")
    high = before.where("n_posts >= 6 AND n_accounts >= 4")
    return overrides.snapshot_diff(before, high.unionByName(before.where("n_posts > 20").withColumn("canon_term", F.concat("canon_term", F.lit("!")))))


@query(f"WITH {EDGES_SQL}, x AS (SELECT DISTINCT world, facet, canon_term FROM edges), r AS (SELECT DISTINCT canon_term AS term, min(canon_term) OVER (PARTITION BY left(canon_term, 1)) AS target FROM x), k AS (SELECT term AS canon_term, target AS target_term FROM r WHERE term <> target UNION SELECT target, target FROM r WHERE term <> target) SELECT world, facet, canon_term AS norm_term, 'merge' AS action, target_term FROM x JOIN k USING (canon_term)")
def override_expand(spark, d):
    """Terms merged into the first, of any world, that begins alike; per norm_term."""
    edges = materialize(fx_edges(spark, d).select("world", "facet", "canon_term", "norm_term").distinct(), "names")
    every = edges.select(F.col("canon_term").alias("term")).distinct().withColumn("c", F.substring("term", 1, 1))
    rows = every.join(every.groupBy("c").agg(F.min("term").alias("target")), "c").where("term <> target").withColumn("action", F.lit("merge"))
    return overrides.expand(overrides.resolve(rows), edges)


RANKED_WITH = f"WITH {RANKED_SQL.replace('GROUP BY ALL HAVING', 'GROUP BY e.world, facet, canon_term HAVING')}"


@query(f"""{RANKED_WITH},
p AS (SELECT *, min(canon_term) OVER (PARTITION BY world, left(canon_term, 1)) AS target FROM g WHERE canon_term NOT LIKE 'c%'),
v AS (SELECT *, CASE WHEN target <> canon_term THEN target END AS parent_term, n_posts / median(n_posts) OVER (PARTITION BY world, facet) AS volume_ratio FROM p),
f AS (SELECT * FROM v WHERE n_posts >= 6 AND n_accounts >= 4),
k AS (SELECT world, parent_term AS canon_term, string_agg(canon_term, ', ' ORDER BY n_posts DESC, canon_term) AS children FROM f WHERE parent_term IS NOT NULL GROUP BY ALL),
a AS (SELECT f.*, coalesce(children, '') AS children, n_posts % 2 = 0 AS favorite, CASE WHEN n_posts % 2 = 0 THEN n_posts % 3 ELSE 0 END AS sort_order FROM f LEFT JOIN k USING (world, canon_term) WHERE parent_term IS NULL)
SELECT world, canon_term, n_posts, favorite, round(volume_ratio, 6) AS volume_ratio, children, n, total FROM (
SELECT *, row_number() OVER (PARTITION BY world ORDER BY favorite DESC, sort_order, n_posts DESC, canon_term) AS n, count(*) OVER (PARTITION BY world) AS total FROM a) WHERE n <= 25""")
def overview(spark, d):
    """First page by volume: terms nested under the first of their world that begins alike, those with c dropped, every second a favourite."""
    ranked = _ranked(spark, d)
    first = ranked.groupBy("world", "facet", F.substring("canon_term", 1, 1).alias("c")).agg(F.min("canon_term").alias("target"))
    rows = ranked.withColumn("c", F.substring("canon_term", 1, 1)).join(first, ["world", "facet", "c"])
    rows = rows.withColumn("action", F.when(F.col("c") == "c", "drop").when(F.col("target") != F.col("canon_term"), "child_of")).where("action IS NOT NULL")
    nested = overrides.apply_child_and_drop(ranked, rows.select("world", "facet", "canon_term", "action", "target"))
    key = S.term_key(F.col("world"), F.col("facet"), F.col("canon_term")).alias("key")
    notes = ranked.where("n_posts % 2 = 0").select(key, F.lit(True).alias("favorite"), (F.col("n_posts") % 3).cast("int").alias("sort_order"))
    out = pages.overview(nested, notes, sort="volume", min_posts=6, min_accounts=4)
    return out.select("world", "canon_term", "n_posts", "favorite", *r6("volume_ratio"), F.array_join("children", ", ").alias("children"), "n", "total")


@query(f"""{RANKED_WITH}, a AS (SELECT world, canon_term, n_posts, row_number() OVER (PARTITION BY world ORDER BY round(account_lift, 9) DESC, canon_term) AS n, count(*) OVER (PARTITION BY world) AS total
FROM g WHERE canon_term LIKE 'b%' AND n_posts BETWEEN 3 AND 200) SELECT * FROM a WHERE n <= 25""")
def overview_favorites(spark, d):
    """Favourites of at most 200 posts by account lift; hidden terms (those with c) are left out."""
    ranked = _ranked(spark, d)
    key = S.term_key(F.col("world"), F.col("facet"), F.col("canon_term")).alias("key")
    notes = ranked.select(key, F.col("canon_term").startswith("b").alias("favorite"), F.col("canon_term").startswith("c").alias("hidden"))
    return pages.overview(ranked, notes, sort="account", max_posts=200, favorites_only=True, show_hidden=False).select("world", "canon_term", "n_posts", "n", "total")


@query(f"""WITH {EDGES_SQL}, x AS (SELECT world, canon_term, post_id, min(raw_term) AS matched_term FROM edges GROUP BY ALL),
k AS (SELECT x.*, c_name AS handle, views, row_number() OVER (PARTITION BY x.world, canon_term ORDER BY coalesce(views, 0) DESC, post_id) AS n FROM x JOIN fx_posts USING (post_id) JOIN customer ON account_id = c_custkey)
SELECT world, canon_term, post_id, matched_term, handle, 'https://www.tiktok.com/@' || handle || '/video/' || post_id AS video_url, views, n FROM k WHERE n <= 100""")
def term_posts(spark, d):
    accounts = t(spark, d, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("handle"))
    out = pages.term_posts(fx_edges(spark, d).select("world", "facet", "canon_term", "post_id", "raw_term"), fx_posts(spark, d).select("post_id", "account_id", "views"), accounts)
    return out.select("world", "canon_term", "post_id", "matched_term", "handle", "video_url", "views", "n")


@query(f"{RANKED_WITH}, a AS (SELECT world, canon_term, n_posts, row_number() OVER (PARTITION BY world ORDER BY round(median_m - m, 9) DESC, canon_term) AS rn FROM g) SELECT * FROM a WHERE rn <= 25")
def top_terms(spark, d):
    return rank.top_terms(_ranked(spark, d), 25, {"discount_product": 15}).select("world", "canon_term", "n_posts", F.col("rn").cast("long").alias("rn"))


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT world, row_number() OVER (PARTITION BY world ORDER BY account_id) - 1 AS i, account_id FROM (SELECT DISTINCT world, account_id FROM fx_events)),
o AS (SELECT world || ':' || account_id AS key, i FROM k WHERE world = 'click' OR i < 5), n AS (SELECT DISTINCT world || ':' || account_id AS key FROM fx_events WHERE k < 50)
SELECT coalesce(o.key, n.key) AS key, coalesce(o.i, -1) AS sort_order, n.key IS NOT NULL AS favorite FROM (SELECT key, i FROM o WHERE key LIKE 'click:%') o FULL JOIN n ON o.key = n.key""")
def reorder(spark, d):
    """Accounts of one world put in the order of their ids by hand; those with k below 50 are favourites."""
    e = fx_events(spark, d)
    key = F.concat_ws(":", "world", F.col("account_id").cast("string"))
    notes = e.where("k < 50").select(key.alias("key")).distinct().withColumns({"favorite": F.lit(True), "sort_order": F.lit(-1)})
    keys = [r["key"] for r in e.where("world = 'click'").select(key.alias("key"), "account_id").distinct().orderBy("account_id").collect()]
    return pages.reorder(notes, keys).select("key", F.col("sort_order").cast("long").alias("sort_order"), "favorite")


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT world, 'product' AS facet, count(*) AS n FROM fx_events GROUP BY world UNION ALL SELECT world, 'hook_cluster', count(*) FROM fx_events GROUP BY world UNION ALL SELECT world, 'other', count(*) FROM fx_events GROUP BY world)
SELECT world, facet, n, CASE WHEN facet = 'product' THEN 'core' ELSE 'hooks' END AS category, 0 AS place FROM x WHERE facet = 'product' OR (facet = 'hook_cluster' AND world = 'click')""")
def panels(spark, d):
    """Facets under their panels; one world has the dialogue layer."""
    n = fx_events(spark, d).groupBy("world").agg(F.count(F.lit(1)).alias("n"))
    rows = n.select("world", F.explode(F.array(*map(F.lit, ["product", "hook_cluster", "other"]))).alias("facet"), "n")
    return pages.with_panels(rows, ["click"]).select("world", "facet", "n", "category", "place")


VIRAL_SQL = f"""{POSTS_SQL}, fx AS (SELECT post_id, c_nationkey AS account_id, format, CASE WHEN format = '1-URGENT' THEN views ELSE 100 END AS views, ln(1 + CASE WHEN format = '1-URGENT' THEN views ELSE 100 END) AS metric FROM fx_posts JOIN customer ON account_id = c_custkey), {PEAKS_SQL},
ve AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), vu AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM ve),
pv AS (SELECT account_id, post_id, v FROM p JOIN vu ON vec_id = post_id % (SELECT count(*) FROM embeddings) WHERE post_id % 7 <> 0),
ed AS (SELECT a.post_id AS a, b.post_id AS b FROM pv a JOIN pv b ON a.account_id = b.account_id WHERE a.post_id = b.post_id OR list_dot_product(a.v, b.v) >= 0.70),
rc AS (SELECT a, b FROM ed UNION SELECT rc.a, ed.b FROM rc JOIN ed ON rc.b = ed.a), cl AS (SELECT a AS post_id, min(b) AS cluster FROM rc GROUP BY a),
pc AS (SELECT p.*, cluster, count(*) OVER (PARTITION BY account_id, cluster) AS size FROM p LEFT JOIN cl USING (post_id))"""


def fx_viral(spark, d):
    """(posts, products, vectors): nations are accounts, whose posts get a hundred views but for urgent orders; every seventh post has no vector."""
    posts = fx_posts(spark, d).join(t(spark, d, "customer").select(F.col("c_custkey").alias("account_id"), "c_nationkey"), "account_id")
    posts = posts.select(
        "post_id", F.col("c_nationkey").alias("account_id"), "format", F.lit(None).cast("string").alias("setting"), F.concat(F.lit("post "), F.col("post_id").cast("string")).alias("summary"),
        F.col("post_id").cast("string").alias("external_id"), F.col("posted_at").cast("timestamp").alias("posted_at"), F.when(F.col("format") == "1-URGENT", F.col("views")).otherwise(F.lit(100).cast("long")).alias("views"),
    )
    vecs = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vecs.count()
    embedded = posts.where("post_id % 7 <> 0").select("post_id", (F.col("post_id") % n).alias("vec_id")).join(vecs, "vec_id").select("post_id", "vector")
    return posts, fx_products(spark, d).select("post_id", "name", "brand", "topic"), embedded


@query(f"""WITH RECURSIVE {VIRAL_SQL}, {PRODUCTS_SQL}, pt AS (SELECT account_id, cluster, max(size) AS size, string_agg(post_id::VARCHAR, ',' ORDER BY views DESC, post_id) AS members FROM pc WHERE cluster IS NOT NULL AND size >= 2 GROUP BY ALL),
nm AS (SELECT account_id, cluster, string_agg(CASE WHEN brand <> '' THEN brand || ' ' || name ELSE name END, ', ' ORDER BY brand || ' ' || name) AS names FROM pc JOIN fx_products USING (post_id) WHERE size >= 2 AND cluster IS NOT NULL GROUP BY ALL),
tc AS (SELECT account_id, cluster, topic, count(*) AS k FROM pc JOIN fx_products USING (post_id) WHERE size >= 2 AND cluster IS NOT NULL GROUP BY ALL),
tp AS (SELECT account_id, cluster, string_agg(topic, ', ' ORDER BY k DESC, topic) AS top FROM (SELECT *, row_number() OVER (PARTITION BY account_id, cluster ORDER BY k DESC, topic) AS i FROM tc) WHERE i <= 3 GROUP BY ALL),
np AS (SELECT account_id, count(*) AS n_peaks FROM p GROUP BY account_id)
SELECT account_id, cluster::VARCHAR AS key, size, coalesce(names, '') AS names, members, '1-URGENT' || coalesce(' — ' || top, '') || ' — post ' || split_part(members, ',', 1) AS about, cluster % 2 = 0 AS favorite, n_peaks
FROM pt LEFT JOIN nm USING (account_id, cluster) LEFT JOIN tp USING (account_id, cluster) JOIN np USING (account_id)""")
def account_patterns(spark, d):
    """Patterns of all accounts; those with an even key are favourites."""
    posts, products, embedded = fx_viral(spark, d)
    notes = posts.where("post_id % 2 = 0").select(F.col("post_id").cast("string").alias("key"), F.lit(True).alias("favorite"))
    out = patterns.patterns(posts, products, embedded, notes)
    ids = F.array_join(F.transform("members", lambda x: x.cast("string")), ",")
    return out.select("account_id", "key", "size", F.array_join("names", ", ").alias("names"), ids.alias("members"), "about", "favorite", "n_peaks")


@query(f"""WITH RECURSIVE {VIRAL_SQL} SELECT pc.account_id, post_id, coalesce(cluster::VARCHAR, 'unclustered') AS cluster_id, CASE WHEN cluster IS NULL THEN 1 ELSE size END AS cluster_size,
'https://www.tiktok.com/@' || n_name || '/video/' || post_id AS video_url, views, round(metric, 4) AS metric_log1p_views FROM pc JOIN nation ON account_id = n_nationkey""")
def peak_report(spark, d):
    posts, products, embedded = fx_viral(spark, d)
    accounts = t(spark, d, "nation").select(F.col("n_nationkey").alias("account_id"), F.col("n_name").alias("handle"))
    return patterns.peak_report(posts, products, embedded, accounts).select("account_id", "post_id", "cluster_id", "cluster_size", "video_url", "views", "metric_log1p_views")


@query(f"WITH {EVENTS_SQL} SELECT post_id, account_id, world FROM fx_events WHERE account_id IN (SELECT account_id FROM fx_events WHERE world = 'click' AND k < 10)")
def account_scope(spark, d):
    """All events of users who clicked with k below 10."""
    e = fx_events(spark, d)
    return patterns.in_scope(e, e.where("k < 10"), "click").select("post_id", "account_id", "world")


@query("SELECT doc_id AS post_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unrouted(spark, d):
    posts = t(spark, d, "documents").select(F.col("doc_id").alias("post_id"), "source")
    return upkeep.unrouted(posts, t(spark, d, "labels").select(F.col("doc_id").alias("post_id")))


@query("SELECT coalesce(a.i, b.i) AS post_id, CASE WHEN b.i IS NULL THEN 'missing' WHEN a.i IS NULL THEN 'extra' ELSE 'both' END AS side FROM (SELECT doc_id AS i FROM documents WHERE doc_id % 3 > 0) a FULL JOIN (SELECT doc_id AS i FROM labels) b ON a.i = b.i")
def id_sets(spark, d):
    """Documents wanted (two of three) against those labelled."""
    wanted = t(spark, d, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("post_id"))
    return upkeep.id_sets(wanted, t(spark, d, "labels").select(F.col("doc_id").alias("post_id")))


@query("""WITH x AS (SELECT d.lang AS world, d.source, d.doc_id, l.doc_id IS NOT NULL AS has FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.n_chars % 2 = 0)
SELECT world, count(*) AS n_need, count(*) FILTER (WHERE has) AS n_have, count(*) FILTER (WHERE NOT has) AS n_fetch, count(DISTINCT source) FILTER (WHERE NOT has) AS n_accounts FROM x GROUP BY world""")
def redescribe_scope(spark, d):
    """Documents of even length stand for posts without a description, labels for landed files."""
    posts = t(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.col("lang").alias("world"), F.col("source").alias("handle"), (F.col("n_chars") % 2 != 0).alias("described"))
    return upkeep.redescribe_scope(posts, t(spark, d, "labels").select(F.col("doc_id").alias("post_id")))


@query("SELECT o_orderkey AS post_id, l.l_orderkey IS NOT NULL AS listed FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.08) l ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def relisted(spark, d):
    """Pending orders that discounted lines list again."""
    missing = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("account_external_id"), F.col("o_orderkey").alias("external_id"), F.col("o_orderkey").alias("post_id"))
    feed = t(spark, d, "lineitem").where("l_discount > 0.08").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    fresh, gone = upkeep.relisted(missing, feed.select(F.col("o_custkey").alias("account_external_id"), F.col("o_orderkey").alias("external_id")))
    return fresh.select("post_id", F.lit(True).alias("listed")).unionByName(gone.select("post_id", F.lit(False).alias("listed")))


@query("SELECT lang AS world_slug, max(n_chars) + 1 AS round_no FROM documents GROUP BY lang")
def next_round(spark, d):
    return upkeep.next_round(t(spark, d, "documents").select(F.col("lang").alias("world_slug"), F.col("n_chars").alias("round_no")))


@query("SELECT p_brand AS world, p_type AS facet, CASE WHEN p_partkey % 3 = 0 THEN 'merge' ELSE 'drop' END AS action, count(*) AS n FROM part GROUP BY ALL")
def override_report(spark, d):
    action = F.when(F.col("p_partkey") % 3 == 0, "merge").otherwise("drop")
    return overrides.scope_report(t(spark, d, "part").select(F.col("p_brand").alias("world"), F.col("p_type").alias("facet"), action.alias("action")))


@query(f"""WITH {POSTS_SQL}, {PRODUCTS_SQL}, c AS (SELECT world, topic, count(*) AS n FROM fx_products JOIN fx_posts USING (post_id) GROUP BY ALL)
SELECT world, topic, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY world ORDER BY n DESC, topic) AS rn FROM c) WHERE rn <= 40""")
def crawl_topics(spark, d):
    """The forty commonest raw topics of each world."""
    topics = fx_products(spark, d).groupBy("post_id").agg(F.collect_list("topic").alias("topics"))
    posts = fx_posts(spark, d).join(topics, "post_id", "left")
    return upkeep.crawl_health(posts)[1].select("world", "topic", "n", F.col("rn").cast("long").alias("rn"))


@query(f"WITH {POSTS_SQL} SELECT world, count(*) AS n_posts, count(DISTINCT account_id) AS n_accounts, count(*) FILTER (WHERE NOT low_conf) AS n_described FROM fx_posts GROUP BY world")
def crawl_health(spark, d):
    """Sure posts stand for described ones."""
    posts = fx_posts(spark, d).withColumns({"described": ~F.col("low_conf"), "topics": F.array().cast("array<string>")})
    return upkeep.crawl_health(posts)[0]


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
s AS (SELECT list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.vec_id < b.vec_id)
SELECT round(min(s), 6) AS least, round(quantile_cont(s, 0.25), 6) AS p25, round(median(s), 6) AS mid, round(quantile_cont(s, 0.75), 6) AS p75, round(max(s), 6) AS most FROM s""")
def sim_distribution(spark, d):
    """Quantiles of the similarities of all pairs of vectors."""
    got = vectors.similarity_distribution(t(spark, d, "embeddings"), "vec_id", "embedding")
    return spark.createDataFrame([tuple(None if x is None else round(float(x), 6) for x in got)], "least double, p25 double, mid double, p75 double, most double")


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT world, term, views, k, {REGISTERS}[post_id % 8 + 1] AS register, {CONFLICTS}[post_id % 12 + 1] AS conflict, CASE WHEN views <> 0 THEN ln(1 + views) END AS m FROM fx_events),
en AS (SELECT world, term, 'relationship_conflict' AS f, conflict AS v, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT world, term, 'relationship_register', register, count(*) FROM e GROUP BY ALL),
em AS (SELECT world, term, string_agg(f || '.' || v || '=' || n, ',' ORDER BY f, v) AS enums FROM en GROUP BY ALL), b AS (SELECT world, term, median(m) AS b, count(*) AS n_posts, median(k) AS median_duration_sec, median(CASE WHEN k % 5 > 0 THEN k % 5 END) AS median_dialogue_turns FROM e GROUP BY ALL),
ra AS (SELECT world, term, register, round(exp(median(m) - any_value(b)), 6) AS q FROM e JOIN b USING (world, term) WHERE m IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
rm AS (SELECT world, term, string_agg(register, ',' ORDER BY register) AS rated, round(sum(q), 4) AS ratio_sum FROM ra GROUP BY ALL)
SELECT world, term, n_posts, median_duration_sec::DOUBLE AS median_duration_sec, median_dialogue_turns::DOUBLE AS median_dialogue_turns, enums, coalesce(rated, '') AS rated, coalesce(ratio_sum, 0) AS ratio_sum FROM b JOIN em USING (world, term) LEFT JOIN rm USING (world, term)""")
def cluster_profiles(spark, d):
    """Whole profiles of event terms, maps written out; k is the duration, and its rest by five the number of turns."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("post_id") % n).cast("int"))
    none = F.lit(None).cast("string")
    turn = F.struct(F.lit("a").alias("speaker"), F.lit("b").alias("line"))
    empty = F.array().cast("array<struct<speaker:string,line:string>>")
    turns = F.when(F.col("k") % 5 > 0, F.transform(F.sequence(F.lit(1), F.col("k") % 5), lambda _: turn)).otherwise(empty)
    vlm = F.struct(
        F.struct(none.alias("stage"), pick(CONFLICTS, 12).alias("conflict"), pick(REGISTERS, 8).alias("register"), none.alias("resolution"), none.alias("perspective")).alias("relationship"),
        F.struct(none.alias("pairing")).alias("characters"), F.struct(none.alias("presenter")).alias("synthetic"),
        F.struct(*(none.alias(c) for c in ("energy_arc", "humor_sincerity", "speaker_dominance", "density"))).alias("pacing"),
        turns.alias("dialogue"), F.col("k").cast("double").alias("estimated_duration_sec"),
    )
    out = passes.cluster_profiles(fx_events(spark, d).withColumn("vlm", vlm), ["world", "term"])
    lines = F.flatten(F.transform(F.array_sort(F.map_keys("enum_distribution")), lambda f: F.transform(F.array_sort(F.map_keys(F.element_at("enum_distribution", f))), lambda v: F.concat(f, F.lit("."), v, F.lit("="), F.element_at(F.element_at("enum_distribution", f), v).cast("string")))))
    ratios = F.coalesce(F.element_at("enum_view_ratio", "relationship_register"), F.create_map().cast("map<string,double>"))
    total = F.aggregate(F.map_values(ratios), F.lit(0.0), lambda s, x: s + F.round(x, 6))
    return out.select(
        "world", "term", "n_posts", "median_duration_sec", "median_dialogue_turns", F.array_join(lines, ",").alias("enums"), F.array_join(F.array_sort(F.map_keys(ratios)), ",").alias("rated"), F.round(total, 4).alias("ratio_sum"),
    )


@query()
def route_posts(spark, d):
    """The routing flow over documents: a world per language, described by its first text; texts of even ids that won the smallest world are held out."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("visual_description"), "lang")
    first = docs.where("lang IS NOT NULL AND visual_description IS NOT NULL").groupBy(F.col("lang").alias("slug")).agg(F.min_by("visual_description", "post_id").alias("description"))
    worlds = routing.world_vectors(first.withColumn("snippets", F.col("slug")))
    return routing.route_posts(docs, worlds, rules=[("de", F.col("post_id") % 2 == 0, None), ("de", F.lit(True), "de")]).select("post_id", "world", *r6("cosine", "margin"))


def fx_described(spark, d):
    """Posts of the order corpus with their nested description."""
    ps = fx_products(spark, d).groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "brand", "prominence", "topic", "acquisition_cost"))).alias("ps"))
    rows = fx_posts(spark, d).join(ps, "post_id", "left")
    none = F.lit(None).cast("string")
    empty = lambda *names: F.struct(*(none.alias(n) for n in names))
    product = lambda x: F.struct(x["name"].alias("name"), x["brand"].alias("brand"), x["prominence"].alias("prominence"), F.struct(x["acquisition_cost"].alias("acquisition_cost")).alias("value_signal"))
    vlm = F.struct(
        F.transform("ps", product).alias("products"), F.transform("ps", lambda x: x["topic"]).alias("topics"), F.col("format").alias("format"), F.col("format").alias("setting"),
        F.concat_ws(" ", F.col("ps")[0]["name"], F.lit("by"), F.col("ps")[0]["brand"]).alias("summary"), F.col("ps")[0]["name"].alias("hook"), none.alias("premise"), none.alias("punchline"), none.alias("transcript"), none.alias("cta"),
        F.when(F.col("low_conf"), "low").alias("confidence"), F.array(F.col("format")).alias("format_traits"), F.struct(F.lit(None).cast("array<string>").alias("brands")).alias("entities"), empty("kind").alias("audio"),
        empty("stage", "conflict", "register", "resolution", "perspective").alias("relationship"), F.struct(F.lit(None).cast("boolean").alias("present"), none.alias("content"), none.alias("specificity")).alias("advice"),
        empty("pairing", "dynamic").alias("characters"), empty("presenter", "voice").alias("synthetic"), empty("energy_arc", "humor_sincerity", "speaker_dominance", "density").alias("pacing"),
    )
    return rows.select("post_id", "account_id", "world", "views", vlm.alias("vlm"), (F.col("post_id") % 2 == 0).alias("music_original"), F.col("format").alias("music_author"))


@query()
def rebuild(spark, d):
    """The whole rebuild: terms, sentence clusters and the discount slice of the order corpus."""
    ranked, _ = composed.rebuild(fx_described(spark, d))
    return ranked.select("world", "facet", "canon_term", "n_posts", "n_accounts", *r6("lift", "account_lift"), "parent_term")
