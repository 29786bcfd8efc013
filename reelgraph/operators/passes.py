"""Second passes: discount slices, recency quadrants, strata, cluster profiles, account patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.operators import stats, terms
from reelgraph.runtime import materialize

#: Fixed values.
DISCOUNTS = ["free", "deep_discount", "discount"]


def discount_counts(products: DataFrame, by: str = "world") -> DataFrame:
    """Product instances, those acquired at a discount, and their share."""
    hit = F.col("acquisition_cost").isin(*DISCOUNTS)
    return products.groupBy(by).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(hit).alias("n_qualifying")).withColumn("share", F.col("n_qualifying") / F.col("n_total"))


def discount_slice(edges: DataFrame, products: DataFrame, posts: DataFrame, min_effective: float = 4.0) -> DataFrame:
    """Products, formats and traits ranked anew over discounted products and the posts that have any; prominence does not count."""
    return stats.term_stats(discount_edges(edges, products), posts, min_effective=min_effective, count_hero=False)


def discount_edges(edges: DataFrame, products: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """The edges of the discount facets; with kept (world, facet, canon_term) only those of kept terms."""
    names = products.where(F.col("acquisition_cost").isin(*DISCOUNTS) & S.truthy(F.col("name"))).select("post_id", F.col("name").alias("raw_term")).distinct()
    sure = edges.where(~F.col("low_conf") & F.col("metric").isNotNull())
    product = sure.where("facet = 'product'").join(names, ["post_id", "raw_term"], "left_semi")
    other = sure.where("facet IN ('format', 'format_trait')").join(names.select("post_id").distinct(), "post_id", "left_semi")
    rows = product.unionByName(other.select(*product.columns)).withColumn("facet", F.concat(F.lit("discount_"), F.col("facet")))
    keys = ["world", "facet", "canon_term"]
    return rows if kept is None else rows.join(kept.select(*keys), keys, "left_semi")


def _bases(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(world, _base: the median of _m), and the number of rows of each world and term."""
    counts = materialize(rows.groupBy("world", "term").agg(F.count(F.lit(1)).alias("_rows")), "counts")
    worlds = counts.groupBy("world").agg(F.sum("_rows").alias("_rows"))
    return stats.with_medians(rows, ["world"], {"_base": F.col("_m")}, [], counts=worlds), counts


def recency(rows: DataFrame, as_of: str, days: int = 30, least: int = 15) -> DataFrame:
    """Per world and term: counts and lifts before and after the cutoff over one baseline, and a quadrant.

    Views of zero are kept here; a post without a date is older.
    """
    m = F.log1p(F.col("views").cast("double"))
    rows = rows.where("views IS NOT NULL").withColumn("_m", m)
    base, counts = _bases(rows)
    recent = F.coalesce(F.col("posted_at") >= S.days_before(as_of, days), F.lit(False))
    medians = {"_rm": F.when(F.col("_r"), F.col("_m")), "_om": F.when(~F.col("_r"), F.col("_m"))}
    out = stats.with_medians(rows.withColumn("_r", recent), ["world", "term"], medians, [F.count_if("_r").alias("recent_n"), F.count_if(~F.col("_r")).alias("older_n")], counts=counts)
    out = out.join(base, "world").withColumns({"recent_lift": F.coalesce(F.col("_rm") - F.col("_base"), F.lit(0.0)), "older_lift": F.coalesce(F.col("_om") - F.col("_base"), F.lit(0.0))})
    up, many = F.col("recent_lift") > 0, F.col("recent_n") >= least
    quadrant = F.when(up & many, "proven").when(up, "emerging").when(many, "saturated").otherwise("dead")
    return out.withColumn("quadrant", quadrant).drop("_rm", "_om", "_base")


def stratified(rows: DataFrame, in_stratum: Column, min_rows: int = 3, min_accounts: int = 3) -> DataFrame:
    """Terms of a stratum by lift over the stratum's own median; floors count rows."""
    rows = rows.where(in_stratum).withColumn("_m", S.metric(F.col("views"))).where("_m IS NOT NULL")
    base, counts = _bases(rows)
    out = stats.with_medians(rows, ["world", "term"], {"_med": F.col("_m")}, [F.count(F.lit(1)).alias("n"), F.count_distinct("account_id").alias("n_accounts")], counts=counts)
    return out.where((F.col("n") >= min_rows) & (F.col("n_accounts") >= min_accounts)).join(base, "world").withColumn("lift", F.col("_med") - F.col("_base")).drop("_med", "_base")


def enum_distribution(rows: DataFrame, keys: list[str], enums: list[str]) -> DataFrame:
    """Long (keys.., field, value, n) of enum values, filler kept."""
    pairs = F.explode(F.array(*(F.struct(F.lit(e).alias("field"), F.col(e).cast("string").alias("value")) for e in enums)))
    return rows.select(*keys, pairs.alias("e")).select(*keys, "e.*").where(S.truthy(F.col("value"))).groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def register_profile(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Per cluster: modal register, register of highest lift, and whether they differ; ties go to the smaller name."""
    viewed = rows.withColumn("_m", S.metric(F.col("views")))
    base = stats.with_medians(viewed, keys, {"_base": F.col("_m")}, [F.count(F.lit(1)).alias("n_posts")])
    each = stats.with_medians(viewed.where(S.truthy(F.col("register"))), [*keys, "register"], {"_med": F.col("_m")}, [F.count(F.lit(1)).alias("_n"), F.count("_m").alias("_k")])
    each = each.join(base, keys).withColumn("_ratio", F.when(F.col("_k") >= least, F.round(F.exp(F.col("_med") - F.col("_base")), 9)))
    best = each.groupBy(*keys).agg(
        F.min_by("register", F.struct(-F.col("_n"), "register")).alias("_modal"),
        F.min_by("register", F.when(F.col("_ratio").isNotNull(), F.struct(-F.col("_ratio"), F.col("register")))).alias("_high"),
    )
    seen = F.col("_base").isNotNull()
    out = base.join(best, keys, "left").withColumns({"modal_register": F.when(seen, F.col("_modal")), "highest_lift_register": F.when(seen, F.col("_high"))})
    return out.withColumn("register_mismatch", F.coalesce(F.col("modal_register") != F.col("highest_lift_register"), F.lit(False))).drop("_base", "_modal", "_high")


def register_ratios(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Long (keys.., register, n, view_ratio): a register's median views against its cluster's, where `least` of its posts have views."""
    viewed = rows.withColumn("_m", S.metric(F.col("views"))).where("_m IS NOT NULL")
    base = stats.with_medians(viewed, keys, {"_base": F.col("_m")}, [])
    each = stats.with_medians(viewed.where(S.truthy(F.col("register"))), [*keys, "register"], {"_med": F.col("_m")}, [F.count(F.lit(1)).alias("n")]).where(F.col("n") >= least)
    return each.join(base, keys).select(*keys, "register", "n", F.exp(F.col("_med") - F.col("_base")).alias("view_ratio"))


#: The enums that a cluster profile counts, by path.
PROFILE_ENUMS = {
    "relationship_stage": "relationship.stage", "relationship_conflict": "relationship.conflict", "relationship_register": "relationship.register",
    "relationship_resolution": "relationship.resolution", "relationship_perspective": "relationship.perspective", "characters_pairing": "characters.pairing",
    "synthetic_presenter": "synthetic.presenter", "pacing_energy_arc": "pacing.energy_arc", "pacing_humor_sincerity": "pacing.humor_sincerity",
    "pacing_speaker_dominance": "pacing.speaker_dominance", "pacing_density": "pacing.density",
}


def cluster_profiles(members: DataFrame, keys: list[str], vlm: str = "vlm", least: int = 3) -> DataFrame:
    """One row per cluster of posts (keys.., post_id, views, vlm): n_posts, median duration and dialogue turns, counts of enum values and view ratios as maps of maps, and the registers of register_profile().

    A post counts once in a cluster. Turns count where there are any; filler values are counted.
    """
    rows = members.dropDuplicates([*keys, "post_id"])
    v = lambda path: F.col(f"{vlm}.{path}")
    turns = F.when(F.size(v("dialogue")) > 0, F.size(v("dialogue")))
    sizes = rows.groupBy(*keys).agg(F.median(v("estimated_duration_sec")).alias("median_duration_sec"), F.median(turns).alias("median_dialogue_turns"))
    enums = rows.select(*keys, *(v(path).alias(name) for name, path in PROFILE_ENUMS.items()))
    counts = _map_of_maps(enum_distribution(enums, keys, list(PROFILE_ENUMS)), keys, "field", "value", "n", "enum_distribution")
    viewed = rows.select(*keys, "post_id", "views", v("relationship.register").alias("register"))
    ratios = register_ratios(viewed, keys, least).withColumn("field", F.lit("relationship_register"))
    ratios = _map_of_maps(ratios, keys, "field", "register", "view_ratio", "enum_view_ratio")
    out = register_profile(viewed, keys, least).join(sizes, keys, "left").join(counts, keys, "left").join(ratios, keys, "left")
    none = lambda c, kind: F.coalesce(c, F.create_map().cast(kind)).alias(c)
    return out.select(
        *keys, "n_posts", "median_duration_sec", "median_dialogue_turns", none("enum_distribution", "map<string,map<string,bigint>>"), none("enum_view_ratio", "map<string,map<string,double>>"),
        "modal_register", "highest_lift_register", "register_mismatch",
    )


def _map_of_maps(rows: DataFrame, keys: list[str], outer: str, inner: str, value: str, name: str) -> DataFrame:
    each = rows.groupBy(*keys, outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, value)))).alias("_m"))
    each = each.groupBy(*keys).agg(F.collect_list(F.struct(outer, "_m")).alias("_e"))
    return each.select(*keys, F.map_from_entries("_e").alias(name))


def no_product_rate(rows: DataFrame, products: str = "products") -> DataFrame:
    """Share of rows without a named product (null: no rows)."""
    return rows.agg(F.avg((F.coalesce(F.size(S.product_names(F.col(products))), F.lit(0)) <= 0).cast("double")).alias("no_product_rate"))


def pattern_labels(members: DataFrame, products: DataFrame, keys: list[str], field: str = "format") -> DataFrame:
    """Per group of posts: names (each `brand name`, repeats kept, sorted), topics with counts, most frequent first, and the modal value of a field.

    members (keys.., post_id, field), products (post_id, name, brand, topic). Filler and empty values are no modal
    value; ties go to the smaller string.
    """
    rows = members.select(*keys, "post_id").join(products, "post_id")
    shown = F.when(S.truthy(F.col("brand")), F.concat("brand", F.lit(" "), "name")).otherwise(F.col("name"))
    names = rows.where(S.truthy(F.col("name"))).groupBy(*keys).agg(F.sort_array(F.collect_list(shown)).alias("names"))
    counts = rows.where(S.truthy(F.col("topic"))).groupBy(*keys, "topic").agg(F.count(F.lit(1)).alias("_n"))
    topics = counts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), "topic"))), lambda t: F.struct(t["topic"].alias("topic"), (-t["o"]).alias("n"))).alias("topics"))
    return members.select(*keys).distinct().join(names, keys, "left").join(topics, keys, "left").join(modal_value(members, keys, field), keys, "left")


def modal_value(rows: DataFrame, keys: list[str], field: str) -> DataFrame:
    """(keys.., modal_<field>): the commonest value that says something (ties: the smaller)."""
    values = rows.withColumn("_v", F.trim(F.col(field))).where(terms.real(F.col("_v")).isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return values.groupBy(*keys).agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias(f"modal_{field}"))


def crosstab(rows: DataFrame, a: str, b: str, facet: str) -> DataFrame:
    """Edges of cross-tab cells whose sides both say something."""
    return rows.withColumn("facet", F.lit(facet)).withColumn("raw_term", terms.cell(F.col(a), F.col(b))).where("raw_term IS NOT NULL")


def resonance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: posts with views and comments known, and the lift of their median log1p(comments) - log1p(views) over the world's."""
    rows = rows.where(F.col("comments").isNotNull() & (F.col("views") != 0)).withColumn("_r", F.log1p(F.col("comments").cast("double")) - F.log1p(F.col("views").cast("double")))
    base = rows.groupBy("world").agg(F.median("_r").alias("_base"))
    out = rows.groupBy("world", *keys).agg(F.count(F.lit(1)).alias("n_posts"), F.median("_r").alias("resonance"))
    return out.join(base, "world").withColumn("resonance_lift", F.col("resonance") - F.col("_base")).drop("_base")


def dialogue_features(turns: DataFrame, by: str, speaker: str, text: str) -> DataFrame:
    """Per dialogue: n_turns, words, words_per_turn and speaker_word_ratio, the wordiest speaker's share; a null text has no words, no words no ratio."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    each = turns.groupBy(by, speaker).agg(F.count(F.lit(1)).alias("_t"), F.sum(words).alias("_w"))
    out = each.groupBy(by).agg(F.sum("_t").alias("n_turns"), F.sum("_w").alias("n_words"), F.max("_w").alias("_most"))
    return out.select(by, "n_turns", "n_words", (F.col("n_words") / F.col("n_turns")).alias("words_per_turn"), F.when(F.col("n_words") > 0, F.col("_most") / F.col("n_words")).alias("speaker_word_ratio"))


def crosstab3(rows: DataFrame, a: str, b: str, c: str, facet: str) -> DataFrame:
    """Edges of three-way cells all of whose sides say something."""
    both = terms.cell(F.col(a), F.col(b))
    return rows.withColumn("facet", F.lit(facet)).withColumn("raw_term", F.when(both.isNotNull(), terms.cell(both, F.col(c)))).where("raw_term IS NOT NULL")


def median_test(rows: DataFrame, group: str, in_group: str) -> DataFrame:
    """Mood's median test of the metric, rows in a group against the others: counts above the pooled median, difference of medians, chi-square without correction.

    A 2 by 2 table with an empty margin has no chi-square.
    """
    rows = rows.where(F.col("metric").isNotNull() & F.col(in_group).isNotNull())
    rows = rows.join(rows.groupBy(group).agg(F.median("metric").alias("_mid")), group)
    up, hit = F.col("metric") > F.col("_mid"), F.col(in_group)
    out = rows.groupBy(group).agg(
        F.count_if(hit & up).alias("in_above"), F.count_if(hit & ~up).alias("in_below"), F.count_if(~hit & up).alias("out_above"), F.count_if(~hit & ~up).alias("out_below"),
        (F.median(F.when(hit, F.col("metric"))) - F.median(F.when(~hit, F.col("metric")))).alias("median_gap"),
    )
    a, b, c, d = (F.col(x).cast("double") for x in ("in_above", "in_below", "out_above", "out_below"))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return out.withColumn("chi_square", F.when(margins > 0, (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / margins))


def format_signature(rows: DataFrame, combination: str = "combination", least: int = 3) -> DataFrame:
    """Per account with `least` posts: its commonest combination (ties: smaller), that one's share, and the effective number of combinations."""
    each = rows.where(S.truthy(F.col(combination))).groupBy("account_id", combination).agg(F.count(F.lit(1)).alias("_n"))
    out = each.groupBy("account_id").agg(
        F.sum("_n").alias("n_posts"), F.min_by(combination, F.struct(-F.col("_n"), F.col(combination))).alias("signature"), F.max("_n").alias("_most"),
        (F.pow(F.sum("_n"), 2) / F.sum(F.col("_n") * F.col("_n"))).alias("effective"),
    )
    return out.where(F.col("n_posts") >= least).withColumn("share", F.col("_most") / F.col("n_posts")).drop("_most")


def caption_mismatch(rows: DataFrame, caption: str, summary: str, least: float = 0.1) -> DataFrame:
    """rows with overlap, the share of the caption's distinct words that the summary has, and mismatch where it is below `least`; a side without words has neither."""
    words = lambda c: F.array_distinct(F.filter(F.split(S.query_text(F.coalesce(c, F.lit(""))), " +"), lambda w: w != ""))
    mine, theirs = words(F.col(caption)), words(F.col(summary))
    overlap = F.when((F.size(mine) > 0) & (F.size(theirs) > 0), F.size(F.array_intersect(mine, theirs)) / F.size(mine))
    return rows.withColumn("overlap", overlap).withColumn("mismatch", F.col("overlap") < least)
