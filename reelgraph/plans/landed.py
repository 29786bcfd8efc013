"""Registered queries over what is landed: feed payloads, search pages, whole descriptions, decisions; and their DuckDB forms."""

from __future__ import annotations

import uuid
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.operators import layout, passes, patterns, routing, sentences, stats, terms
from reelgraph.plans import rollup as composed
from reelgraph.plans.queries import EDGES_SQL, PEAKS_SQL, POSTS_SQL, PRODUCTS_SQL, RANKED_SQL, STATS_SQL, fx_edges, fx_posts, fx_products, fx_turns, query, r6, t
from reelgraph.runtime import materialize, shared_dir
from reelgraph.sources import feeds, sinks, versions


def _landed(spark, payloads):
    """Payloads (one JSON text a row) written as files and read as a feed."""
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    payloads.write.text(path)
    return feeds.payloads(spark, path)


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders WHERE o_custkey % 10 <> 0),
i AS (SELECT *, CASE WHEN c % 3 = 0 THEN 'known' || c ELSE left(sha256('tiktok:' || c), 32) END AS account_id FROM o)
SELECT 'post' AS kind, account_id, k::VARCHAR AS external_id, CASE WHEN k % 7 = 0 THEN 0 ELSE v END AS views, CASE WHEN k % 5 = 0 THEN 0 ELSE k % 100 END AS likes, CASE WHEN k % 13 <> 0 THEN k * 1000 END AS posted, k % 2 = 0 AS music_original FROM i WHERE NOT (c % 3 = 0 AND k % 2 = 0)
UNION ALL SELECT DISTINCT 'account', account_id, c::VARCHAR, NULL, NULL, NULL, NULL FROM i WHERE c % 3 <> 0""")
def feed_store(spark, d):
    """Feeds of customers, landed as pages of JSON and stored: new accounts and posts. A third of the accounts, and every second post of theirs, is there already; a tenth of the pages is rejected."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    video = F.struct(
        o.cast("string").alias("video_id"), F.col("o_orderpriority").alias("title"), F.when(o % 13 == 0, "soon").otherwise((o * 1000).cast("string")).alias("create_time"),
        F.when(o % 5 != 0, o % 100).alias("digg_count"), F.when(o % 7 != 0, F.floor("o_totalprice")).alias("play_count"), F.struct(c.cast("string").alias("id"), F.concat(F.lit("h"), c).alias("unique_id")).alias("author"),
        F.struct((o % 2 == 0).alias("original")).alias("music_info"),
    )
    orders = t(spark, d, "orders")
    pages = orders.groupBy("o_custkey", F.floor(o / 1000).alias("page")).agg(F.collect_list(video).alias("videos"))
    payload = F.struct(F.when(c % 10 == 0, 1).otherwise(0).alias("code"), F.struct("videos").alias("data"))
    good, _ = _landed(spark, pages.select(F.to_json(payload).alias("value")))
    known = F.concat(F.lit("known"), c)
    accounts = t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey").where(c % 3 == 0).select(known.alias("account_id"), F.lit("tiktok").alias("platform"), c.cast("string").alias("external_id"))
    posts = orders.where((c % 3 == 0) & (o % 2 == 0)).select(known.alias("account_id"), o.cast("string").alias("external_id"))
    new_accounts, new_posts = sinks.store_feed(accounts, posts, feeds.accounts(good), feeds.posts(good), "w", "q")
    out = new_posts.select(F.lit("post").alias("kind"), "account_id", "external_id", "views", "likes", F.unix_seconds("posted_at").alias("posted"), "music_original")
    return out.unionByName(new_accounts.select(F.lit("account").alias("kind"), "account_id", "external_id"), allowMissingColumns=True)


@query("""SELECT CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE count(*) OVER (PARTITION BY l_orderkey) END AS total, l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_quantity < 10 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS likes, 0 AS reply_count,
CASE WHEN l_linenumber <> 3 THEN l_linenumber * 86400 END AS posted, 'u' || l_suppkey AS author FROM lineitem WHERE l_orderkey % 9 <> 0""")
def feed_comments(spark, d):
    """Lines of an order as the comments of a landed payload."""
    o, line = F.col("l_orderkey"), F.col("l_linenumber")
    comment = F.struct(
        F.concat_ws("-", o, line).alias("id"), F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("long")).alias("digg_count"),
        F.when(line == 3, "").otherwise((line * 86400).cast("string")).alias("create_time"), F.struct(F.concat(F.lit("u"), F.col("l_suppkey")).alias("unique_id")).alias("user"),
    )
    pages = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(comment).alias("comments"), F.count(F.lit(1)).alias("n"))
    data = F.struct(F.when(o % 4 != 0, F.col("n")).alias("total"), "comments")
    good, _ = _landed(spark, pages.select(F.to_json(F.struct(F.when(o % 9 == 0, -1).otherwise(0).alias("code"), data.alias("data"))).alias("value")))
    rows = feeds.comments(good).select("comments.total", F.explode("comments.comments").alias("c"))
    return rows.select("total", "c.id", "c.likes", "c.reply_count", F.unix_seconds("c.posted_at").alias("posted"), "c.author")


_ROUND_SQL = """WITH asked AS (SELECT p_partkey AS id, p_name AS q FROM part WHERE p_brand = 'Brand#2' AND p_partkey % 2 = 0 ORDER BY p_size % 3, p_partkey LIMIT 50),
pg AS (SELECT p_name AS q, l_linenumber AS page, list_sort(list(DISTINCT 's' || ((l_suppkey + 7 * l_linenumber) % 40))) AS hs FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 4 = l_linenumber % 4 GROUP BY ALL),
w AS (SELECT * FROM pg x WHERE page <= 3 AND q IN (SELECT q FROM asked) AND NOT (page > 2 AND q LIKE 'b%' AND EXISTS (SELECT 1 FROM pg y WHERE y.q = x.q AND y.page = 2))),
h AS (SELECT q, page, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM w), f AS (SELECT q, h, min(page * 1000 + i) AS pos FROM h GROUP BY ALL),
pr AS (SELECT trim(query, ' ') AS query, trim(regexp_replace(lower(query), '[^a-z0-9 ]', '', 'g'), ' ') AS n FROM (SELECT p_name || '!' AS query FROM part UNION ALL SELECT ' ' || upper(p_name) || ' ' || p_brand FROM part))
SELECT 'ledger' AS kind, id::VARCHAR AS a, NULL AS b, count(h) AS n1, count(h) FILTER (WHERE h NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)) AS n2 FROM asked LEFT JOIN f USING (q) GROUP BY id
UNION ALL SELECT 'handles', q, h, NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos) AS k FROM f) WHERE k <= 20
UNION ALL SELECT 'next', min(query), NULL, (SELECT max(p_size % 3) + 1 FROM part WHERE p_brand = 'Brand#2'), NULL FROM pr WHERE n <> '' AND n NOT IN (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), ' ') FROM part WHERE p_brand = 'Brand#2') GROUP BY n"""


@query(_ROUND_SQL)
def search_round(spark, d):
    """A whole crawl round of one world: up to 50 pending queries asked, their pages walked, every query closed with its yield, handles to ingest, and the next round's queries."""
    part, line = t(spark, d, "part"), F.col("l_linenumber")
    ledger = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("world_slug"), (F.col("p_size") % 3).alias("round_no"), F.col("p_name").alias("query_text"), F.when(F.col("p_partkey") % 2 == 0, "pending").otherwise("done").alias("status"))
    rows = t(spark, d, "lineitem").where(F.col("l_suppkey") % 4 == line % 4).join(part, F.col("l_partkey") == F.col("p_partkey"))
    handle = F.concat(F.lit("s"), (F.col("l_suppkey") + 7 * line) % 40)
    pages = rows.groupBy(F.col("p_name").alias("query"), line.alias("page")).agg(F.array_sort(F.collect_set(handle)).alias("handles"))
    pages = pages.withColumn("has_more", ~((F.col("page") == 2) & F.col("query").startswith("b")))
    known = t(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("handle"))
    asked = F.explode(F.array(F.concat("p_name", F.lit("!")), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "), "p_brand")))
    done = composed.run_round(ledger, pages, known, part.select(asked.alias("query")), "Brand#2", datetime(2024, 1, 1), most_queries=50)
    none = F.lit(None).cast("string").alias("b")
    out = done["ledger"].select(F.lit("ledger").alias("kind"), F.col("query_id").cast("string").alias("a"), none, F.col("handles_found").cast("long").alias("n1"), F.col("new_handles").cast("long").alias("n2"))
    out = out.unionByName(done["handles"].select(F.lit("handles").alias("kind"), F.col("query").alias("a"), F.col("handle").alias("b")), allowMissingColumns=True)
    return out.unionByName(done["next"].select(F.lit("next").alias("kind"), F.col("query_text").alias("a"), none, F.col("round_no").cast("long").alias("n1")), allowMissingColumns=True)


#: Values of the fields of a whole description, by the rest of the post's id; None: the field is missing.
_FIELDS = {
    "setting": ["kitchen", "", None, "gym"], "cta": ["follow", None, "buy"], "audio.kind": ["music", None], "relationship.stage": ["dating", "unclear", "married", "not_applicable"],
    "relationship.conflict": ["money", "unclear", "trust"], "relationship.register": ["tender", "not_applicable", "angry", None, "flat"], "relationship.resolution": ["open", "closed"],
    "relationship.perspective": ["first", "", "third"], "advice.specificity": ["concrete", "concrete", "unclear", None, "vague", "vague", "vague"], "characters.pairing": ["couple", "not_applicable"],
    "characters.dynamic": ["two rivals", "unclear", None], "synthetic.presenter": ["none", "real_person", "unclear"], "synthetic.voice": ["unclear", "human"], "pacing.energy_arc": ["rising", "flat"],
    "pacing.humor_sincerity": ["mixed", "not_applicable"], "pacing.speaker_dominance": ["not_applicable", "one"], "pacing.density": ["high", "unclear", "low"], "punchline": ["and so", None, None, ""],
}
_RAW = {"setting": "setting", "cta": "cta", "audio_kind": "audio.kind", "characters_dynamic": "characters.dynamic"}
_ENUMS = ["relationship.stage", "relationship.conflict", "relationship.register", "relationship.resolution", "relationship.perspective", "characters.pairing", "synthetic.presenter", "synthetic.voice", "pacing.energy_arc", "pacing.humor_sincerity", "pacing.speaker_dominance", "pacing.density"]
_CELLS = {"conflict_x_register": ("relationship.conflict", "relationship.register"), "register_x_resolution": ("relationship.register", "relationship.resolution"), "register_x_advice_specificity": ("relationship.register", "advice.specificity")}


def _sql_value(path):
    values = ", ".join("NULL" if v is None else f"'{v}'" for v in _FIELDS[path])
    return f"([{values}])[p % {len(_FIELDS[path])} + 1]"


def _sql_real(path):
    return f"CASE WHEN {_sql_value(path)} NOT IN ('', 'not_applicable', 'unclear') THEN {_sql_value(path)} END"


def _facets_sql():
    one = lambda facet, value: f"SELECT p, low, '{facet}' AS facet, {value} AS raw_term, NULL AS prominence FROM described"
    spoken = [one(f, _sql_value(x)) for f, x in _RAW.items()] + [one(x.replace(".", "_"), _sql_real(x)) for x in _ENUMS]
    spoken += [one(f, f"({_sql_real(a)}) || ' x ' || ({_sql_real(b)})") for f, (a, b) in _CELLS.items()]
    spoken += [one("format", "format"), one("format_trait", "'trait' || p % 3"), one("topic", "'topic' || p % 5"), one("brand", "'b' || p % 4"), one("brand", "'b' || p % 3"), one("brand", "format")]
    spoken += ["SELECT p, low, 'product', 'item' || p % 7, CASE WHEN p % 2 = 0 THEN 'hero' ELSE 'incidental' END FROM described"]
    spoken += [one("punchline_presence", f"CASE WHEN p % 3 <> 0 THEN NULL WHEN {_sql_value('punchline')} <> '' THEN 'has_punchline' ELSE 'no_punchline' END")]
    scraped = ["SELECT p, false, 'audio_source', CASE WHEN p % 4 < 2 THEN 'original_audio' WHEN p % 4 = 2 THEN 'licensed_audio' END, NULL FROM x", "SELECT p, false, 'music_author', CASE WHEN p % 4 = 2 THEN 'dj' || p % 5 END, NULL FROM x"]
    return f"""WITH x AS (SELECT o_orderkey AS p, o_orderstatus = 'P' AS low, o_orderpriority AS format FROM orders), described AS (SELECT * FROM x WHERE p % 11 <> 0), e AS ({" UNION ALL ".join(spoken + scraped)}),
u AS (SELECT DISTINCT * FROM e WHERE raw_term <> '') SELECT facet, raw_term, prominence, low AS low_conf, count(*) AS n, CAST(sum(p) AS BIGINT) AS ids FROM u GROUP BY ALL"""


@query(_facets_sql())
def facet_terms(spark, d):
    """Terms of every facet of whole descriptions, where one in eleven posts has none: repeats and empty values, filler, cells of two enums, presence of a key, what the scrape knows. Posts by facet and term, and the sum of their ids."""
    p, text = F.col("p"), lambda s, n: F.concat(F.lit(s), F.col("p") % n)
    value = lambda path: F.element_at(F.array(*(F.lit(v).cast("string") for v in _FIELDS[path])), (p % len(_FIELDS[path]) + 1).cast("int"))
    nested = {}
    for path in _FIELDS:
        head, _, leaf = path.partition(".")
        nested.setdefault(head, []).append(value(path).alias(leaf or head))
    parts = [c[0] if head in _FIELDS else F.struct(*c).alias(head) for head, c in nested.items()]
    none = F.lit(None).cast("string")
    product = F.struct(text("item", 7).alias("name"), text("b", 4).alias("brand"), F.when(p % 2 == 0, "hero").otherwise("incidental").alias("prominence"))
    parts += [F.array(product, product).alias("products"), F.struct(F.array(text("b", 3), F.col("format"), none).alias("brands")).alias("entities"), F.col("format")]
    parts += [F.array(text("trait", 3), F.lit(""), text("trait", 3)).alias("format_traits"), F.array(text("topic", 5), none).alias("topics"), F.when(F.col("low"), "low").alias("confidence")]
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("p"), (F.col("o_orderstatus") == "P").alias("low"), F.col("o_orderpriority").alias("format"))
    posts = rows.select(
        p.alias("post_id"), F.when(p % 11 != 0, F.struct(*parts)).alias("vlm"), F.when(p % 3 == 0, '{"punchline":null}').otherwise("{}").alias("vlm_raw"),
        F.when(p % 4 < 2, True).when(p % 4 == 2, False).alias("music_original"), text("dj", 5).alias("music_author"),
    )
    return terms.extract_terms(posts).groupBy("facet", "raw_term", "prominence", "low_conf").agg(F.count(F.lit(1)).alias("n"), F.sum("post_id").alias("ids"))


_LABELLED_SQL = RANKED_SQL.replace("GROUP BY ALL HAVING", "GROUP BY e.world, facet, canon_term HAVING").replace("FROM edges e", "FROM named e").replace(STATS_SQL, f"named AS (SELECT * EXCLUDE (canon_term), canon_term AS norm_term, left(canon_term, 6) AS canon_term FROM edges), {STATS_SQL}")


@query(f"""WITH {_LABELLED_SQL}, v AS (SELECT world, canon_term, CASE WHEN norm_term LIKE 'red%' OR (norm_term LIKE 'small%' AND length(norm_term) % 2 = 0) THEN 'drop' ELSE 'child_of' END AS action,
 CASE WHEN norm_term LIKE 'red%' OR (norm_term LIKE 'small%' AND length(norm_term) % 2 = 0) THEN NULL WHEN norm_term LIKE 'new%' THEN 'nowhere' WHEN length(norm_term) % 2 = 0 THEN 'cold a' ELSE 'blue a' END AS target, count(*) AS n
 FROM named WHERE norm_term SIMILAR TO '(red|small|new|large).*' GROUP BY ALL),
b AS (SELECT world, canon_term, count(DISTINCT action) AS k, arg_max(action, [n::VARCHAR.lpad(12, '0'), action, coalesce(target, '')]) AS action, arg_max(struct_pack(t := target), [n::VARCHAR.lpad(12, '0'), action, coalesce(target, '')]).t AS target FROM v GROUP BY ALL)
SELECT g.world, g.canon_term, n_posts, n_accounts, CASE WHEN n_posts >= 9 AND n_accounts >= 4 THEN -1 ELSE n_hero END AS n_hero, round(median_m - m, 6) AS lift,
 CASE WHEN b.action = 'child_of' AND (g.world, b.target) IN (SELECT (world, canon_term) FROM g) THEN b.target END AS parent_term
FROM g LEFT JOIN b ON g.world = b.world AND g.canon_term = b.canon_term AND k = 1 WHERE b.action IS DISTINCT FROM 'drop'""")
def ranked_decisions(spark, d):
    """Stats of two producers, one row a term, the first winning ties (its n_hero is -1), under decisions by norm_term: some disagree within a term and are left out, others go by plurality, one names a parent that is not ranked. Terms are cut to six characters, as a clustering would fold them."""
    edges = materialize(fx_edges(spark, d).withColumn("canon_term", F.substring("norm_term", 1, 6)), "edges")
    posts, counted = fx_posts(spark, d), stats.rankable(edges)
    columns = ["world", "facet", "canon_term", "n_posts", "n_accounts", "n_hero", "lift"]
    large = stats.term_stats(counted, posts, min_posts=9, min_accounts=4).select(*columns).withColumn("n_hero", F.lit(-1).cast("long"))
    odd = F.length("norm_term") % 2 == 1
    drop = F.col("norm_term").startswith("red") | (F.col("norm_term").startswith("small") & ~odd)
    target = F.when(F.col("norm_term").startswith("new"), "nowhere").when(odd, "blue a").otherwise("cold a")
    decisions = edges.where(F.col("norm_term").rlike("^(red|small|new|large)")).select("world", "facet", "norm_term").distinct()
    decisions = materialize(decisions.select("*", F.when(drop, "drop").otherwise("child_of").alias("action"), F.when(~drop, target).alias("target_term")), "decisions")
    found = composed.ranked_terms([large, stats.term_stats(counted, posts).select(*columns)], edges, decisions)
    return found.select("world", "canon_term", "n_posts", "n_accounts", "n_hero", *r6("lift"), "parent_term")


@query(f"""WITH {POSTS_SQL}, {PRODUCTS_SQL}, fx AS (SELECT * FROM fx_posts), {PEAKS_SQL}, s AS (SELECT DISTINCT post_id FROM fx_products WHERE acquisition_cost = 'free'),
c AS (SELECT account_id, count(*) AS n_peaks, count(*) FILTER (WHERE post_id NOT IN (SELECT post_id FROM s)) AS n_none, count(*) FILTER (WHERE post_id % 7 <> 0) AS n_vec FROM p GROUP BY ALL)
SELECT account_id, CASE WHEN n_total >= 10 AND mad <> 0 THEN 'modified_z_score' ELSE 'top_10_percent' END AS method, n_total, coalesce(n_peaks, 0) AS n_peaks, coalesce(n_none, 0) AS n_no_product, coalesce(n_vec, 0) AS n_embedded, round(n_none / n_peaks, 6) AS no_product_rate FROM m JOIN a USING (account_id) LEFT JOIN c USING (account_id)""")
def peak_summary(spark, d):
    """The head of every account's peak report; only free products count as seen, and every seventh post has no vector."""
    posts = fx_posts(spark, d)
    seen = fx_products(spark, d).where("acquisition_cost = 'free'")
    vectors = posts.where("post_id % 7 <> 0").select("post_id")
    return patterns.peak_summary(posts, seen, vectors).select("account_id", "method", "n_total", "n_peaks", "n_no_product", "n_embedded", *r6("no_product_rate"))


def length_embedder(texts):
    """A stand-in for a remote model that SQL can follow: a direction told by the number of characters, in one of eight planes."""
    out = []
    for n in texts.str.len():
        v = np.zeros(16)
        at, angle = 2 * (n % 8), n * n % 25 * 0.2
        v[at : at + 2] = np.cos(angle), np.sin(angle)
        out.append(v)
    return out


@query("""WITH k AS (SELECT conv_id * 100000 + turn AS post_id, role AS world, text, length(text) AS l FROM conversations),
r AS (SELECT *, CASE WHEN text IS NULL THEN post_id ELSE min(post_id) OVER (PARTITION BY world, text) END AS r, l % 8 AS b, l * l % 25 AS j FROM k),
isl AS (SELECT *, j - row_number() OVER (PARTITION BY world, b ORDER BY j) AS g FROM (SELECT DISTINCT world, b, j FROM r WHERE text <> '')),
c AS (SELECT world, b, g, min(r) AS c FROM r JOIN isl USING (world, b, j) WHERE text <> '' GROUP BY ALL)
SELECT r.world, r.post_id, coalesce(c, r) AS representative FROM r LEFT JOIN isl ON r.world = isl.world AND r.b = isl.b AND r.j = isl.j AND text <> '' LEFT JOIN c ON c.world = isl.world AND c.b = isl.b AND c.g = isl.g""")
def near_dedupe_chains(spark, d):
    """Turns whose directions lie within a step of each other hang together, over any number of steps."""
    return sentences.near_dedupe(fx_turns(spark, d), ["world"], "post_id", "text", "transcript", embedder=length_embedder)


#: Worlds as directions in the first of the planes, by angle; every other text is at a right angle to all.
_ANGLES = {"w0": 0.03, "w1": 1.234, "w2": 2.711, "w3": 4.05, "w9": 1.9}


@query(f"""WITH b AS (SELECT doc_id AS post_id, array_to_string(list_slice(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0B\f\r]+'), 1, 150), ' ') AS t FROM documents WHERE trim(coalesce(text, ''), ' ') <> ''),
v AS (SELECT post_id, least(length(t), 8000) AS l FROM b), w AS (SELECT unnest({[w for w in _ANGLES if w != "w9"]}) AS w, unnest({[a for w, a in _ANGLES.items() if w != "w9"]})::DOUBLE AS a),
s AS (SELECT post_id, w, CASE WHEN l % 8 = 0 THEN cos(l * l % 25 * 0.2::DOUBLE - a) ELSE 0 END AS c FROM v, w), k AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY c DESC, w) AS n FROM s),
o AS (SELECT a.post_id, a.w, a.c AS cosine, a.c - b.c AS margin FROM k a JOIN k b ON a.post_id = b.post_id AND a.n = 1 AND b.n = 2)
SELECT post_id, CASE WHEN w = 'w1' AND post_id % 3 = 0 THEN NULL WHEN w = 'w1' AND post_id % 2 = 0 THEN 'w9' ELSE w END AS world, round(cosine, 6) AS cosine, round(margin, 6) AS margin FROM o""")
def route_angles(spark, d):
    """The routing flow over whole documents: texts cut to the budget, embedded once and routed; of those that win w1 some are held out and some go to w9, which does not compete."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("visual_description"))
    rows = [(w, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 14) for w, a in _ANGLES.items()]
    worlds = spark.createDataFrame(rows, "slug string, centroid array<double>")
    rules = [("w1", F.col("post_id") % 3 == 0, None), ("w1", F.col("post_id") % 2 == 0, "w9"), ("w1", F.lit(True), "w1")]
    return routing.route_posts(docs, worlds, rules=rules, embedder=length_embedder).select("post_id", "world", *r6("cosine", "margin"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT 'post' AS kind, vec_id::VARCHAR AS id, label::VARCHAR AS world, CASE WHEN vec_id % 5 <> 0 THEN v[4] END AS similarity, v[1] AS x, v[2] AS y, v[3] AS z FROM e
 UNION ALL SELECT 'world', label::VARCHAR, label::VARCHAR, NULL, min(v[5]), max(v[6]), min(v[7]) FROM e WHERE label % 2 = 0 GROUP BY label),
s AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 AS half,
 min(coalesce(similarity, 0.8)) FILTER (WHERE kind = 'post') AS lo, max(coalesce(similarity, 0.8)) FILTER (WHERE kind = 'post') AS hi FROM p),
q AS (SELECT kind, id, world, similarity, (x - cx) / half AS x, (y - cy) / half AS y, (z - cz) / half AS z, 0.32 + 0.55 * (coalesce(similarity, 0.8) - lo) / (hi - lo) AS k FROM p, s),
a AS (SELECT world, x AS ax, y AS ay, z AS az FROM q WHERE kind = 'world')
SELECT kind, id, world, round(CASE WHEN kind = 'post' AND ax IS NOT NULL THEN x + (ax - x) * k ELSE x END, 6) AS x, round(CASE WHEN kind = 'post' AND ay IS NOT NULL THEN y + (ay - y) * k ELSE y END, 6) AS y,
 round(CASE WHEN kind = 'post' AND az IS NOT NULL THEN z + (az - z) * k ELSE z END, 6) AS z FROM q LEFT JOIN a USING (world)""")
def map_pull(spark, d):
    """The map over given places: every fifth post has no similarity, and worlds of odd labels have no point."""
    v = lambda i: F.get("v", F.lit(i))
    rows = t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    posts = rows.select(F.lit("post").alias("kind"), F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("world"), F.when(F.col("vec_id") % 5 != 0, v(3)).alias("similarity"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"))
    worlds = rows.where("label % 2 = 0").groupBy(F.col("label").cast("string").alias("id")).agg(F.min(v(4)).alias("x"), F.max(v(5)).alias("y"), F.min(v(6)).alias("z"))
    points = posts.unionByName(worlds.select(F.lit("world").alias("kind"), "id", F.col("id").alias("world"), F.lit(None).cast("double").alias("similarity"), "x", "y", "z"))
    return layout.layout(points).select("kind", "id", "world", *r6("x", "y", "z"))


@query(f"""WITH {EDGES_SQL}, one AS (SELECT post_id, world, canon_term FROM edges WHERE world <> 'MACHINERY' UNION ALL SELECT post_id, 'MACHINERY', upper(canon_term) FROM edges WHERE world = 'MACHINERY' AND post_id % 3 <> 0)
SELECT world, canon_term, count(*) AS n_posts, CAST(count(*) AS BIGINT) AS n_edges FROM one GROUP BY world, canon_term""")
def stored_rebuild(spark, d):
    """A rebuild of all worlds is stored, then one of a single world, a third of whose posts have lost their terms: stats and edges of the version that holds."""
    root = f"{shared_dir(spark)}/rebuild-{uuid.uuid4().hex}"
    edges = materialize(fx_edges(spark, d).select("post_id", "world", "facet", "canon_term"), "edges")
    posts = fx_posts(spark, d).select("post_id", "world")
    count = lambda rows: rows.groupBy("world", "facet", "canon_term").agg(F.count_distinct("post_id").alias("n_posts"))
    composed.write_rebuild(count(edges), edges, posts, root)
    again = edges.where("world = 'MACHINERY' AND post_id % 3 <> 0").withColumn("canon_term", F.upper("canon_term"))
    composed.write_rebuild(count(again), again, posts.where("world = 'MACHINERY'"), root)
    held = versions.read(spark, root, "edges").groupBy("world", "facet", "canon_term").agg(F.count(F.lit(1)).alias("n_edges"))
    return versions.read(spark, root, "stats").join(held, ["world", "facet", "canon_term"], "full_outer").select("world", "canon_term", "n_posts", "n_edges")


@query(f"""WITH {POSTS_SQL}, x AS (SELECT *, CASE WHEN post_id % 3 = 0 THEN '  once ' || format || ' ' WHEN post_id % 3 = 1 THEN ' ' END AS premise, CASE WHEN post_id % 2 = 0 THEN ' about ' || world ELSE '' END AS summary, CASE WHEN post_id % 5 < 2 THEN ['t' || post_id % 5, 'u'] ELSE [] END AS topics,
 CASE post_id % 4 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'dating' END AS stage FROM fx_posts),
f AS (SELECT *, concat_ws(' ', CASE WHEN trim(summary, ' ') <> '' THEN trim(summary, ' ') END, CASE WHEN len(topics) > 0 THEN array_to_string(topics, ' ') END) AS fb FROM x)
SELECT post_id, CASE WHEN trim(coalesce(premise, ''), ' ') <> '' THEN trim(premise, ' ') WHEN stage = 'not_applicable' THEN NULL ELSE nullif(fb, '') END AS premise, CASE WHEN post_id % 2 = 1 AND post_id % 3 = 0 THEN 'do ' || format END AS advice,
 strftime(posted_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS posted, CASE WHEN post_id % 7 = 0 THEN true ELSE post_id % 5 >= 3 END AS over, post_id % 30 >= 6 AND post_id % 30 <= 9 AS in_band,
 CASE WHEN post_id % 30 >= 25 THEN '25+' WHEN post_id % 30 >= 10 THEN '10-24' WHEN post_id % 30 >= 6 THEN '6-9' WHEN post_id % 30 >= 3 THEN '3-5' END AS band, '{{"a":"' || format || '"}}' AS raw, array_to_string(list_filter([trim(premise, ' '), trim(summary, ' ')], lambda n: n <> ''), ' · ') AS notes FROM f""")
def post_texts(spark, d):
    """The texts and marks of a post, as the flows derive them: premise with its fallbacks, advice, time, end of work, size band, a document without NULs, joined notes."""
    p = F.col("post_id")
    rows = fx_posts(spark, d).withColumns({
        "premise_": F.when(p % 3 == 0, F.concat(F.lit("  once "), "format", F.lit(" "))).when(p % 3 == 1, " "), "summary": F.when(p % 2 == 0, F.concat(F.lit(" about "), "world")).otherwise(""),
        "topics": F.when(p % 5 < 2, F.array(F.concat(F.lit("t"), p % 5), F.lit("u"))).otherwise(F.array().cast("array<string>")), "stage": F.when(p % 4 == 0, "not_applicable").when(p % 4 == 1, "dating"),
    })
    nul = F.concat(F.lit('{"a":"'), "format", F.lit('\\u0000\x00"}'))
    return rows.select(
        "post_id", S.premise_text(F.col("premise_"), F.col("summary"), F.col("topics"), F.col("stage")).alias("premise"),
        S.advice_text(p % 2 == 1, F.when(p % 3 == 0, F.concat(F.lit(" do "), "format", F.lit(" ")))).alias("advice"), S.iso(F.col("posted_at").cast("timestamp")).alias("posted"),
        S.terminal(F.when(p % 7 == 0, "x"), (p % 5).cast("int")).alias("over"), S.in_band(p % 30, "6-9").alias("in_band"), S.size_band(p % 30).alias("band"), S.strip_nul(nul).alias("raw"),
        S.joined_notes(F.array("premise_", "summary")).alias("notes"),
    )


_WORDS_SQL = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'), ' '), ' '), lambda w: w <> ''))"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, upper(p_name) || '!' AS caption, CASE l_linenumber % 5 WHEN 0 THEN p_type WHEN 1 THEN 'the ' || p_name || ', ' || p_name || '.' WHEN 2 THEN split_part(p_name, ' ', 2) || '  ' || p_type WHEN 3 THEN '...' END AS summary FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, {_WORDS_SQL.format("caption")} AS a, {_WORDS_SQL.format("coalesce(summary, '')")} AS b FROM x), o AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(a) END AS overlap FROM w)
SELECT l_orderkey AS post_id, l_linenumber, round(overlap, 6) AS overlap, overlap < 0.1 AS mismatch FROM o""")
def caption_check(spark, d):
    """Product names as captions against summaries that tell all of it, some, another thing, nothing or are missing."""
    name, line = F.col("p_name"), F.col("l_linenumber") % 5
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    told = F.when(line == 0, F.col("p_type")).when(line == 1, F.concat(F.lit("the "), name, F.lit(", "), name, F.lit(".")))
    told = told.when(line == 2, F.concat(F.split_part(name, F.lit(" "), F.lit(2)), F.lit("  "), F.col("p_type"))).when(line == 3, "...")
    rows = rows.select(F.col("l_orderkey").alias("post_id"), "l_linenumber", F.concat(F.upper(name), F.lit("!")).alias("caption"), told.alias("summary"))
    return passes.caption_mismatch(rows, "caption", "summary").select("post_id", "l_linenumber", *r6("overlap"), "mismatch")
