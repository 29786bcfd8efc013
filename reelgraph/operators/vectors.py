"""Vectors: cosines, routing, similarity graphs, medoids and average linkage."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.operators.graph import FEW, connected_components, join_pairs
from reelgraph.runtime import discard, materialize

#: Vectors in a block of the pairwise product.
BLOCK = 2000
#: Blocks of a group that each of its vectors is copied to, about; blocks of larger groups hold up to TILES tiles of BLOCK vectors, which a task takes two at a time.
SPREAD, TILES = 6, 32
#: Vectors of a tile whose products stay in a processor's cache; what products of 32 bits may be off, as a share of the greatest squared length; the share of a tile's pairs up to which pairs are taken one by one.
CACHED, OFF, SPARSE = 512, 1e-5, 1 / 16
#: Links that a task joins together.
JOINED = 20_000
#: Clusters of a component that one task merges; a larger component is merged in rounds of joins.
LOCAL = 20_000
#: Worlds that posts are routed to, at most; their matrix is broadcast.
MAX_WORLDS = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector has none. The norm is bound as the one element of a list: within the inner lambda it would be taken anew for each dimension."""
    scaled = F.transform(F.array(F.sqrt(dot(v, v))), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)))
    return F.get(scaled, F.lit(0))


def _matrix(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a list column at length one, mask of those that have one: neither null nor zero nor of another size)."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4))
    size = size or int(lengths.max(initial=0))
    good = (lengths == size) & column.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
    out = np.zeros((len(column), size))
    if good.any():
        out[good] = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    norm = np.linalg.norm(out, axis=1)
    good &= norm > 0
    return out / np.where(good, norm, 1)[:, None], good


def centroids(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, centroid): the mean of each group's vectors at length one; summed in the tasks first, then per dimension, so a group is never gathered."""
    schema = T.StructType([T.StructField(by, vectors.schema[by].dataType), T.StructField("_s", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType())])

    def run(batches):
        for batch in batches:
            seen: dict = {}
            names = batch.column(0).to_pylist()
            code = np.array([seen.setdefault(tuple(k.values()) if isinstance(k, dict) else k, len(seen)) for k in names], np.int64)
            m = batch.column(1).cast(pa.list_(pa.float64()))
            good = m.is_valid().to_numpy(zero_copy_only=False)
            size = len(m.flatten()) // max(1, int(good.sum()))
            rows = m.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if size else np.zeros((0, 0))
            groups = np.unique(code[good])
            sums = [rows[code[good] == g].sum(axis=0) for g in groups]
            counts = [int((code[good] == g).sum()) for g in groups]
            first = [int(np.flatnonzero(code == g)[0]) for g in groups]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first, pa.int64())), pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.int64())], names=[by, "_s", "_n"])

    parts = vectors.select(by, vector).mapInArrow(run, schema)
    mean = parts.select(by, "_n", F.posexplode("_s").alias("i", "x")).groupBy(by, "i").agg((F.sum("x") / F.sum("_n")).alias("x"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_c")).select(by, unit(F.col("_c")).alias("centroid"))


def route(posts: DataFrame, worlds: DataFrame, post_id: str, vector: str) -> DataFrame:
    """(post_id, world, cosine, margin): the nearest of a few worlds (slug, centroid) and its lead over the next (over 0 if there is none); ties to the smaller slug.

    The worlds are a catalogue of at most MAX_WORLDS, broadcast as one matrix, so posts neither
    multiply nor shuffle: a batch is one product. A post without a vector, or with a zero one, has no world.
    """
    listed = worlds.where("centroid IS NOT NULL").orderBy("slug").limit(MAX_WORLDS + 1).collect()
    if len(listed) > MAX_WORLDS:
        raise ValueError(f"over {MAX_WORLDS} worlds: route against clusters of worlds first")
    slugs = np.array([w["slug"] for w in listed], object)
    m = np.array([w["centroid"] for w in listed], float)
    shared = posts.sparkSession.sparkContext.broadcast((slugs, m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m))
    schema = T.StructType([posts.schema[post_id], T.StructField("world", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("margin", T.DoubleType())])

    def run(batches):
        slugs, worlds = shared.value
        for batch in batches:
            n = batch.num_rows
            v, good = _matrix(batch.column(1), worlds.shape[1] if len(slugs) else None)
            good = good & bool(len(slugs))
            world, best, margin = np.full(n, None, object), np.full(n, np.nan), np.full(n, np.nan)
            if good.any():
                sims = v[good] @ worlds.T
                at = sims.argmax(axis=1)
                top = sims[np.arange(len(at)), at]
                sims[np.arange(len(at)), at] = -np.inf
                second = sims.max(axis=1) if len(slugs) > 1 else np.zeros(len(at))
                world[good], best[good], margin[good] = slugs[at], top, top - second
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(world, pa.string()), pa.array(best, mask=~good), pa.array(margin, mask=~good)], names=[post_id, "world", "cosine", "margin"])

    return posts.select(post_id, vector).mapInArrow(run, schema)


def split_by_rules(world: Column, rules: list[tuple[str, Column, str | None]]) -> Column:
    """The world after rules (parent, predicate, target): among rows that won `parent` the first rule that holds names the world (None: held out, null).

    Rows of a parent for which no rule holds are held out; worlds that are no parent stay.
    """
    out, parents = None, list(dict.fromkeys(p for p, *_ in rules))
    for parent, predicate, target in rules:
        hit = (world == parent) & F.coalesce(predicate, F.lit(False))
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return world if out is None else out.when(~world.isin(*parents), world)


def routing_split(world: Column, presenter: Column, certainty: Column, parent: str, child: str) -> Column:
    """Rows that won `parent` go to the child if generated, stay if real, and are held out (null) otherwise or when unsure."""
    return split_by_rules(world, [(parent, certainty == "low", None), (parent, presenter == "ai_generated_person", child), (parent, presenter == "real_person", parent)])


def similar_pairs(vectors: DataFrame, id_col: str, vector: str, least: float, blocks: int | None = None) -> DataFrame:
    """(a, b, sim) with a < b and cosine of `least` or more: products of block pairs, each a bounded numpy task."""
    blocks = blocks or max(1, -(-vectors.count() // (2 * BLOCK)))
    own = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), own.alias("own"))  # floats are copied as floats
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    kind = vectors.schema[id_col].dataType.simpleString()

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, own = pdf["id"].to_numpy(), pdf["own"].to_numpy()
        m = np.stack(pdf["v"].to_numpy()).astype(float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m /= np.where(norm > 0, norm, 1)
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        sims = m[a] @ m[b].T
        i, j = np.nonzero(sims >= least)
        found, i, j = sims[i, j], a[i], b[j]
        keep = ids[i] != ids[j] if lo != hi else ids[i] < ids[j]
        i, j = i[keep], j[keep]
        a, b = np.where(ids[i] < ids[j], ids[i], ids[j]), np.where(ids[i] < ids[j], ids[j], ids[i])
        return pd.DataFrame({"a": a, "b": b, "sim": found[keep]})

    return rows.groupBy("lo", "hi").applyInPandas(multiply, f"a {kind}, b {kind}, sim double")


def components(vectors: DataFrame, id_col: str, vector: str, least: float) -> DataFrame:
    """(id, component) of the threshold graph; a vector without a neighbour keeps its own id."""
    rows = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("v")).withColumn("_g", F.lit(0))
    found = threshold_components(rows, ["_g"], least).drop("_g")
    return found.withColumnRenamed("id", id_col)


def threshold_components(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """(by.., id, component) of rows (by.., id, v): the components of each group's graph of similarity `least` or more; component is the smallest id.

    Equal vectors are folded first, and a pair of blocks reports a spanning forest of its links, so
    copies cost neither products nor edges. They meet by 128 bits of hash, so a vector moves once to be
    folded and is not a key. A row without a vector is alone.
    """
    hashes = {"_h": F.xxhash64("v"), "_k": F.xxhash64(F.lit("again"), "v")}
    hashed = rows.where("v IS NOT NULL").withColumns(hashes)
    folded = materialize(hashed.groupBy(*by, *hashes).agg(F.min("id").alias("id"), F.first("v").alias("v")), "folded")
    links = _block_products(folded, by, least, pairs=False)
    cc = connected_components(links, "a", "b", FEW).select(*(F.col(f"node.{c}").alias(c) for c in by), F.col("node.id").alias("_rep"), F.col("component.id").alias("_c"))
    named = folded.select(*by, *hashes, F.col("id").alias("_rep")).join(cc, [*by, "_rep"], "left")
    keyed = rows.select(*by, "id", *(F.when(F.col("v").isNotNull(), h).alias(c) for c, h in hashes.items()))
    return keyed.join(named, [*by, *hashes], "left").select(*by, "id", F.coalesce("_c", "_rep", "id").alias("component"))


def medoids(vectors: DataFrame, by: str, id_col: str, vector: str) -> DataFrame:
    """(by, medoid, medoid_vector): the member nearest to its group's vector sum (ties: smaller id); no pair matrix."""
    sums = centroids(vectors.withColumn("_u", unit(F.col(vector))).where("_u IS NOT NULL"), by, "_u")
    rows = vectors.withColumn("_u", unit(F.col(vector))).join(sums, by)
    best = F.max_by(F.struct(F.col(id_col), F.col("_u")), F.struct(F.round(dot(F.col("_u"), F.col("centroid")), 12), -F.col(id_col)))
    return rows.groupBy(by).agg(best.alias("_m")).select(by, F.col(f"_m.{id_col}").alias("medoid"), F.col("_m._u").alias("medoid_vector"))


def prune(vectors: DataFrame, by: str, id_col: str, vector: str, floor: float = 0.35) -> DataFrame:
    """Members of each group within `floor` of its medoid, which is chosen first and kept."""
    rows = vectors.join(medoids(vectors, by, id_col, vector), by)
    return rows.withColumn("sim", dot(unit(F.col(vector)), F.col("medoid_vector"))).where(F.col("sim") >= floor).drop("medoid_vector")


def average_linkage(vectors: DataFrame, by: list[str], id_col: str, vector: str, threshold: float, local: int | None = None) -> DataFrame:
    """(by.., id, cluster) of an average-linkage cut at cosine `threshold`; cluster is its smallest member.

    Merges above the cut stay within a component of the threshold graph, so components are clustered
    one by one and the result equals that over each whole group. A component of at most `local` rows
    is merged by one task, in memory that grows with its rows (no matrix of pairs); a larger one in
    rounds over tables (see linkage_rounds), to the same cut. Rows without a vector are alone.
    """
    local = LOCAL if local is None else local
    rows = materialize(vectors.select(*by, F.col(id_col).alias("id"), unit(F.col(vector)).alias("v")), "linkage")
    parts = threshold_components(rows, by, threshold).join(rows, [*by, "id"])
    sizes = parts.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("_size"))
    parts = materialize(parts.join(sizes, [*by, "component"]), "linkage")
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = ", ".join([*(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in by), f"{id_col} {kind}, cluster {kind}"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        label = upgma(np.stack(pdf["v"].to_numpy()), threshold)
        out = pdf[by].copy()
        out[id_col], out["cluster"] = pdf["id"], pdf["id"].to_numpy()[label]
        return out

    alone = parts.where("_size = 1").select(*by, F.col("id").alias(id_col), F.col("id").alias("cluster"))
    small = parts.where((F.col("_size") > 1) & (F.col("_size") <= local)).select(*by, "component", "id", "v").groupBy(*by, "component").applyInPandas(merge, schema)
    out = alone.unionByName(small)
    large = parts.where(F.col("_size") > local).where("_size > 1").select(*by, "component", "id", "v")
    if not large.isEmpty():
        out = out.unionByName(linkage_rounds(large, [*by, "component"], threshold, local).select(*by, F.col("id").alias(id_col), "cluster"))
    return materialize(out, "cut")  # several steps read it, and would each merge anew


def linkage_rounds(rows: DataFrame, by: list[str], threshold: float, local: int = 1) -> DataFrame:
    """(by.., id, cluster) of rows (by.., id, v) by merging, in each round, all clusters that are each other's nearest.

    Average linkage is reducible, so the order of such merges does not change the cut, and a merge brings no
    cluster nearer to a third than its parts were. So the nearest of a cluster is kept until it merges, and a
    round looks anew only for clusters just made and those whose nearest was merged. A cluster is a row (its
    vector sum and size). One whose nearest lies below the threshold is done; a group with at most `local`
    clusters left is finished by one task. Ties go to the smaller id; where kept ties leave no mutual pair, all
    look again before the end.
    """
    out = materialize(rows.select(*by, "id", F.col("id").alias("cluster")), "cut")
    now = materialize(rows.select(*by, "id", F.transform("v", lambda x: x.cast("double")).alias("s"), F.lit(1).cast("long").alias("n")), "clusters")
    near, all_look = materialize(_nearest(now, by, threshold), "nearest"), True
    while True:
        mutual = near.alias("x").join(near.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by] + [F.col("x.id") == F.col("y.to"), F.col("x.to") == F.col("y.id")])
        mutual = materialize(mutual.where(F.col("x.id") > F.col("x.to")).select(*(F.col(f"x.{c}").alias(c) for c in by), F.col("x.id").alias("id"), F.col("x.to").alias("to")), "merges")
        if mutual.isEmpty():
            if all_look or near.isEmpty():
                return out
            discard(near, mutual)
            near, all_look = materialize(_nearest(now, by, threshold), "nearest"), True
            continue
        pair = F.collect_list("s")  # one or two
        live = now.join(near.select(*by, "id"), [*by, "id"], "left_semi").join(mutual, [*by, "id"], "left")
        after = live.groupBy(*by, F.coalesce("to", "id").alias("id")).agg(pair.alias("p"), F.sum("n").alias("n"))
        after = materialize(after.select(*by, "id", F.when(F.size("p") == 1, F.col("p")[0]).otherwise(F.zip_with(F.col("p")[0], F.get("p", F.lit(1)), lambda x, y: x + y)).alias("s"), "n"), "clusters")
        few = after.groupBy(*by).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") <= local).select(*by)
        moved = mutual.select(*by, F.col("id").alias("cluster"), F.col("to").alias("_to"))
        ended = _finish(after.join(few, by, "left_semi"), by, threshold)
        rest = materialize(after.join(few, by, "left_anti"), "clusters")
        cut = out.join(moved, [*by, "cluster"], "left").select(*by, "id", F.coalesce("_to", "cluster").alias("cluster"))
        cut = materialize(cut.join(ended, [*by, "cluster"], "left").select(*by, "id", F.coalesce("_to", "cluster").alias("cluster")), "cut")
        gone = mutual.select(*by, "id", F.lit(True).alias("_gone")).unionByName(mutual.select(*by, F.col("to").alias("id"), F.lit(True).alias("_gone")))
        kept = near.join(gone.drop("_gone"), [*by, "id"], "left_anti")
        kept = materialize(kept.join(gone.withColumnRenamed("id", "to"), [*by, "to"], "left_anti").join(rest.select(*by, "id"), [*by, "id"], "left_semi").select(*by, "id", "to"), "kept")
        anew = rest.join(kept.select(*by, "id"), [*by, "id"], "left_anti")
        found = materialize(kept.unionByName(_nearest(rest, by, threshold, anew)), "nearest")
        discard(out, now, near, mutual, kept, after)
        out, now, near, all_look = cut, rest, found, False


def _finish(clusters: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by.., cluster, _to): where the clusters (by.., id, s, n) of small groups end."""
    kind = clusters.schema["id"].dataType.simpleString()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        label = upgma(np.stack(pdf["s"].to_numpy()), threshold, pdf["n"].to_numpy())
        out = pdf[by].copy()
        out["cluster"], out["_to"] = pdf["id"], pdf["id"].to_numpy()[label]
        return out

    return clusters.groupBy(*by).applyInPandas(merge, ", ".join([*(f"{c} {clusters.schema[c].dataType.simpleString()}" for c in by), f"cluster {kind}, _to {kind}"]))


def _nearest(clusters: DataFrame, by: list[str], least: float, asking: DataFrame | None = None) -> DataFrame:
    """(by.., id, to): the nearest cluster of each of clusters (by.., id, s, n), or only of those asking, where its mean cosine is `least` or more.

    For all, a pair of blocks serves both; those asking meet all clusters, block by block.
    """
    if asking is None:
        rows = _dealt(clusters, by, ["s", "n"], TILES).withColumn("asks", F.lit(True))
    else:
        rows = _asked(clusters, asking, by)
    kind = clusters.schema["id"].dataType.simpleString()
    both = asking is None

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, own, m = pdf["id"].to_numpy(), pdf["own"].to_numpy(), np.stack(pdf["s"].to_numpy()) / pdf["n"].to_numpy()[:, None]
        lo, hi, asks = pdf["lo"].iloc[0], pdf["hi"].iloc[0], pdf["asks"].to_numpy()
        place, top, to = np.unique(ids, return_inverse=True)[1], np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)

        def offer(x, y, sims):
            at = sims.argmax(axis=1)
            far = sims[np.arange(len(x)), at]
            better = (far > top[x]) | ((far == top[x]) & (place[y[at]] < place[to[x]]))
            top[x[better]], to[x[better]] = far[better], y[at][better]

        for a, b in tiles(own, lo, hi, CACHED) if both else tiles(np.where(asks, 0, 1), 0, 1, CACHED):
            sims = m[a] @ m[b].T
            if not both or a[0] == b[0]:
                sims[place[a][:, None] == place[b][None, :]] = -np.inf
            offer(a, b, sims)
            if both and a[0] != b[0]:
                offer(b, a, sims.T)
        x = np.flatnonzero(top >= least)
        out = pdf[by].iloc[x].reset_index(drop=True)
        out["id"], out["to"], out["sim"] = ids[x], ids[to[x]], top[x]
        return out

    found = rows.groupBy(*by, "lo", "hi").applyInPandas(best, ", ".join([*(f"{c} {clusters.schema[c].dataType.simpleString()}" for c in by), f"id {kind}, to {kind}, sim double"]))
    return found.groupBy(*by, "id").agg(F.min_by("to", F.struct(-F.col("sim"), "to")).alias("to"))


def _asked(clusters: DataFrame, asking: DataFrame, by: list[str]) -> DataFrame:
    """Rows of (lo, hi), a block of those asking and one of all clusters: the asking once for each block of clusters, these once for each block of the asking."""
    count = lambda rows, name: rows.groupBy(*by).agg(_blocks(F.count(F.lit(1)), TILES).alias(name))
    sizes = count(asking, "_a").join(count(clusters, "_c"), by)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    take = lambda rows, mine, other, asks: rows.select(*by, "id", "s", "n").join(sizes, by).withColumns({"_own": own(mine), "_other": each(other), "asks": F.lit(asks)})
    shape = lambda rows, lo, hi: rows.select(*by, "id", "s", "n", F.lit(0).alias("own"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), "asks")
    return shape(take(asking, "_a", "_c", True), "_own", "_other").unionByName(shape(take(clusters, "_c", "_a", False), "_other", "_own"))


def _blocks(n: Column, tiles: int) -> Column:
    """The number of blocks of n vectors: as many as hold BLOCK each, but above SPREAD only as many as hold `tiles` times that."""
    small, large = F.ceil(n / F.lit(BLOCK)), F.ceil(n / F.lit(BLOCK * tiles))
    return F.least(small, F.greatest(large, F.lit(SPREAD))).cast("int")


def tiles(own: np.ndarray, lo: int, hi: int, most: int | None = None):
    """(rows, other rows) of the tiles of a pair of blocks, BLOCK by BLOCK rows at most (or `most`, if that is less); those of one block with itself come once."""
    a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    most = min(BLOCK, most or BLOCK)
    step, other = (max(1, -(-len(x) // max(1, -(-len(x) // most)))) for x in (a, b))  # tiles of a like size, no slivers
    for i in range(0, len(a), step):
        for j in range(i if lo == hi else 0, len(b), other):
            yield a[i : i + step], b[j : j + other]


def in_short(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(x, y, e): x[i] @ y[j] is -d*d/2 of the distance d of rows i and j of m, in 32 bits, and off by less than e.

    It only tells which pairs cannot matter; what is kept is worked out from m itself.
    """
    half = (m * m).sum(axis=1, keepdims=True) / 2
    one = np.ones_like(half)
    x, y = (np.concatenate(part, axis=1).astype(np.float32) for part in ((m, -half, one), (m, one, -half)))
    return x, y, OFF * max(1.0, 2 * float(half.max(initial=0)))


def true_places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero() of a matrix that is nearly all false, eight places at a time."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:
        at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
        at = at[flat[at]]
    return np.divmod(at, mask.shape[1])


def _dealt(rows: DataFrame, by: list[str], values: list[str], tiles: int = 1) -> DataFrame:
    """rows (by.., id, values..) once for each pair (lo, hi) of blocks that theirs (own) is in; with tiles above 1 blocks may hold that many times BLOCK rows (see _blocks)."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    sizes = rows.groupBy(*by).agg(_blocks(F.count(F.lit(1)), tiles).alias("blocks"))
    rows = rows.join(sizes, by).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*by, "id", *values, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _close(m: np.ndarray, own: np.ndarray, lo: int, hi: int, least: float, parent: np.ndarray | None = None):
    """(rows, other rows, similarities) of the pairs of a pair of blocks with 1 - d*d/2 of `least` or more, tile by tile; only of pairs that do not yet hang together, if their parents are given."""
    x, y, off = in_short(m)
    half = (m * m).sum(axis=1) / 2
    for a, b in tiles(own, lo, hi, CACHED):
        if parent is not None:
            roots = np.concatenate([parent[a], parent[b]])
            if (roots == roots[0]).all():
                continue
        i, j = true_places(x[a] @ y[b].T >= least - 1 - off)
        if len(i) > SPARSE * len(a) * len(b):
            sims = m[a] @ m[b].T
            sims += 1 - half[a][:, None] - half[b][None, :]
            i, j = np.nonzero(sims >= least)
            found, i, j = sims[i, j], a[i], b[j]
        else:
            i, j = a[i], b[j]
            found = np.einsum("ij,ij->i", m[i], m[j]) + (1 - half[i] - half[j])
        keep = found >= least
        if a[0] == b[0]:
            keep &= i < j
        if parent is not None:
            keep &= parent[i] != parent[j]
        if keep.any():
            yield i[keep], j[keep], found[keep]


def _block_products(rows: DataFrame, by: list[str], least: float, pairs: bool) -> DataFrame:
    """Pairs (a, b, sim) of keys within a group with similarity `least` or more, each once; or of a spanning forest of them (a, b), by group and pair of blocks.

    sim is 1 - d*d/2 of the Euclidean distance d, which for vectors of length one is their cosine.
    A vector is copied to few blocks (see _blocks), however many its group has, and a task takes them tile by tile.
    """
    rows = _dealt(rows.where("v IS NOT NULL"), by, ["v"], TILES)
    kind = rows.schema["id"].dataType.simpleString()

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, own, m = pdf["id"].to_numpy(), pdf["own"].to_numpy(), np.stack(pdf["v"].to_numpy())
        lo, hi, none = pdf["lo"].iloc[0], pdf["hi"].iloc[0], np.zeros(0, np.int64)
        if pairs:
            found = [*_close(m, own, lo, hi, least)] or [(none, none, np.zeros(0))]
            i, j, sims = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            parent, held, n = np.arange(len(ids)), [], 0
            for i, j, _ in _close(m, own, lo, hi, least, parent):
                held.append((i, j))
                n += len(i)
                if n > JOINED:
                    join_pairs(parent, *map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
            if held:
                join_pairs(parent, *map(np.concatenate, zip(*held, strict=True)))
            i = np.flatnonzero(parent != np.arange(len(ids)))
            j = parent[i]
        out = pdf[by].iloc[np.zeros(len(i), int)].reset_index(drop=True)
        out["x"], out["y"] = ids[i], ids[j]
        if pairs:
            out["sim"] = sims
        return out

    found = rows.groupBy(*by, "lo", "hi").applyInPandas(multiply, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), f"x {kind}, y {kind}{', sim double' if pairs else ''}"]))
    ends = (F.struct(*by, F.col("x").alias("id")).alias("a"), F.struct(*by, F.col("y").alias("id")).alias("b"))
    return found.select(*ends, "sim") if pairs else found.select(*ends)


def _grouped_pairs(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """(a, b, sim): all pairs of keys within a group; for what needs each similarity, as core similarities do."""
    return _block_products(rows, by, least, pairs=True)


def upgma(unit_vectors: np.ndarray, threshold: float, members: np.ndarray | None = None) -> np.ndarray:
    """Label (index of the smallest member) of each row: in each round all clusters that are each other's nearest merge.

    With members, rows are vector sums of so many. The mean cosine of two clusters comes from their
    sums, so memory grows with the rows alone. Average linkage is reducible: the order of such merges does not change the cut,
    a merge brings no cluster nearer to a third, and a cluster whose nearest is below the threshold is
    done. So a round looks anew only for clusters just made and those whose nearest was merged.
    """
    sums, size = unit_vectors.astype(float).copy(), np.ones(len(unit_vectors)) if members is None else members.astype(float)
    up, left = np.arange(len(sums)), np.arange(len(sums))  # where a row went; the clusters that are not done
    mean = sums / size[:, None]
    to, top, look = np.zeros(len(sums), np.int64), np.full(len(sums), -np.inf), left
    while len(look):
        others = mean[left]
        for some in (look[i : i + CACHED] for i in range(0, len(look), CACHED)):
            sims = mean[some] @ others.T
            sims[np.arange(len(some)), np.searchsorted(left, some)] = -np.inf
            at = sims.argmax(axis=1)
            to[some], top[some] = left[at], sims[np.arange(len(some)), at]
        changed = np.zeros(len(sums), bool)
        changed[left[top[left] < threshold]] = True
        left = left[top[left] >= threshold]
        if not len(left):
            break
        b = left[(to[to[left]] == left) & (to[left] < left) & (top[to[left]] >= threshold)]
        if not len(b):  # ties in a circle
            i = left[top[left].argmax()]
            b = np.array([max(i, to[i])])
            to[b[0]] = min(i, to[i])
        a = to[b]
        sums[a] += sums[b]
        size[a] += size[b]
        mean[a] = sums[a] / size[a][:, None]
        up[b] = a
        changed[a] = changed[b] = True
        left = left[up[left] == left]
        look = left[changed[left] | changed[to[left]]]
    while (up[up] != up).any():
        up = up[up]
    return up


def hashed_embedder(texts: pd.Series, size: int = 64) -> list[np.ndarray]:
    """A deterministic stand-in for a remote model: hashed character trigrams at length one."""
    import zlib
    from collections import Counter

    out, known = [], {}
    for t in texts:
        v = np.zeros(size)
        padded = f"  {t or ''} "
        for trigram, n in Counter(zip(padded, padded[1:], padded[2:])).items():  # each distinct one is hashed once for all texts
            if trigram not in known:
                h = zlib.crc32("".join(trigram).encode())
                known[trigram] = h % size, 1 if h >> 16 & 1 else -1
            at, sign = known[trigram]
            v[at] += sign * n
        n = np.linalg.norm(v)
        out.append(v / n if n else v)
    return out


def embed(terms: DataFrame, cache: DataFrame | None, text: str = "norm_term", embedder=hashed_embedder, batch: int = 256, most_chars: int = 8000) -> DataFrame:
    """(text, vector) of the distinct texts that the cache lacks; the embedder gets `batch` texts at a time at most, each cut to most_chars."""
    todo = terms.select(text).where(F.col(text) != "").distinct()
    todo = todo if cache is None else todo.join(cache.select(text), text, "left_anti")

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf[text].iloc[at : at + batch].reset_index(drop=True)
                yield pd.DataFrame({text: part, "vector": embedder(part.str.slice(0, most_chars))})

    return todo.mapInPandas(run, f"{text} string, vector array<double>")


def cached_embed(terms: DataFrame, cache: DataFrame, text: str = "norm_term", **options) -> tuple[DataFrame, DataFrame]:
    """(vectors of all texts, rows to append to the cache (text, vector)): texts are embedded once, whatever world or facet has them."""
    new = materialize(embed(terms, cache, text, **options), "embedded")
    known = cache.select(text, "vector").unionByName(new)
    return known.join(terms.select(text).distinct(), text, "left_semi"), new


def canonicalize(edges: DataFrame, threshold: float = 0.78, embedder=hashed_embedder, cache: DataFrame | None = None) -> DataFrame:
    """(world, facet, norm_term, canon_term) for all worlds and facets at once; the label is a cluster's most frequent term."""
    from reelgraph.operators.stats import canonical_labels

    counts = edges.groupBy("world", "facet", "norm_term").agg(F.count(F.lit(1)).alias("n")).where("norm_term <> ''")
    counts = materialize(counts, "counts")
    known = embed(counts, cache, embedder=embedder)
    known = known if cache is None else known.unionByName(cache)
    clusters = average_linkage(counts.join(known, "norm_term"), ["world", "facet"], "norm_term", "vector", threshold)
    sized = clusters.join(counts, ["world", "facet", "norm_term"])
    return clusters.join(canonical_labels(sized, ["world", "facet", "cluster"]), ["world", "facet", "cluster"]).select("world", "facet", "norm_term", "canon_term")


def exact_dedupe(posts: DataFrame, text: str, post_id: str) -> DataFrame:
    """(post_id, representative): the smallest post id of those with the same trimmed text; a null text stands for itself.

    Texts meet by their digest, so the shuffle carries 32 bytes a row.
    """
    key = F.unhex(F.sha2(F.trim(F.col(text)), 256))
    least = posts.where(F.col(text).isNotNull()).groupBy(key.alias("_t")).agg(F.min(post_id).alias("representative"))
    return posts.select(post_id, key.alias("_t")).join(least, "_t", "left").select(post_id, F.coalesce("representative", post_id).alias("representative"))


def similarity_distribution(rows: DataFrame, id_col: str, vector: str, shares=(0.0, 0.25, 0.5, 0.75, 1.0), bins: int = 4096, few: int = 100_000) -> list[float]:
    """Quantiles (interpolated) of the similarities of all pairs of different rows, exact, without a list of pairs.

    Pairs of blocks count similarities into bins; only the bins that hold a wanted rank are looked at
    again, finer, until they hold a few values, which are fetched; one pass serves all open bins.
    Rows without a vector are left out.
    """
    rows = materialize(rows.select(F.lit(0).alias("_g"), F.col(id_col).alias("id"), unit(F.col(vector)).alias("v")).where("v IS NOT NULL"), "vectors")
    n = rows.count()
    total = n * (n - 1) // 2
    if not total:
        return [None for _ in shares]
    dealt = _dealt(rows, ["_g"], ["v"], TILES)
    first = (-1.001, bins / 2.002)  # a bin is told by one rule in all passes: (x - least) * bins a unit, cut to a whole number

    def scan(parts: list[tuple[tuple, bool]]) -> list[dict]:
        """For each (bins within bins, bins or values) the counts of similarities within, by bin of the last or by value, of one pass over all pairs."""
        wanted = np.zeros(bins + 1, bool)
        wanted[[path[0][2] for path, _ in parts if path]] = True
        whole = not parts[0][0]  # all similarities, in one part

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", ignore_index=True)  # so that each pass has the same products
            m, lo, hi = np.stack(pdf["v"].to_numpy()), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
            counts, held, kept = np.zeros(bins + 1, np.int64), [[] for _ in parts], 0

            def flush():
                for i, (_, binned) in enumerate(parts):
                    x, n = np.unique(np.concatenate([v for v, _ in held[i]]), return_inverse=True) if held[i] else (np.zeros(0), np.zeros(0, int))
                    held[i] = [(x, np.bincount(n, np.concatenate([k for _, k in held[i]]), len(x)).astype(np.int64))] if len(x) else []

            for a, b in tiles(pdf["own"].to_numpy(), lo, hi, CACHED):
                sims = m[a] @ m[b].T
                sims = sims[np.triu_indices(len(a), 1)] if a[0] == b[0] else sims.reshape(-1)
                at = ((sims - first[0]) * first[1]).astype(np.int32)
                if whole and parts[0][1]:
                    counts += np.bincount(at, minlength=bins + 1)
                    continue
                near = slice(None) if whole else np.flatnonzero(wanted[at])
                x, at = sims[near], at[near]
                for i, (path, binned) in enumerate(parts):
                    y = x if whole else x[at == path[0][2]]
                    for low, scale, k in path[1:]:
                        y = y[((y - low) * scale).astype(np.int64) == k]
                    if binned and len(y):
                        low, scale = finer(path)
                        y = ((y - low) * scale).astype(np.int64).astype(float)
                    if len(y):
                        held[i].append((y, np.ones(len(y), np.int64)))
                        kept += len(y)
                if kept > 1_000_000:
                    flush()
                    kept = 0
            if whole and parts[0][1]:
                at = np.flatnonzero(counts)
                return pd.DataFrame({"part": np.zeros(len(at), np.int32), "x": at.astype(float), "n": counts[at]})
            flush()
            rows = [(np.full(len(x), i, np.int32), x, n) for i, h in enumerate(held) for x, n in h]
            part, x, n = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64))
            return pd.DataFrame({"part": part, "x": x, "n": n})

        found = dealt.groupBy("_g", "lo", "hi").applyInPandas(run, "part int, x double, n long").groupBy("part", "x").agg(F.sum("n").alias("n"))
        got = [{} for _ in parts]
        for r in found.collect():  # bins and few values, not rows
            got[r["part"]][r["x"]] = r["n"]
        return got

    def finer(path: tuple) -> tuple[float, float]:
        """(least, bins a unit) of the bins within the last bin of a path."""
        low, scale, k = path[-1]
        return low + k / scale, scale * bins

    wanted = sorted({r for s in shares for r in (int(np.floor(s * (total - 1))), int(np.ceil(s * (total - 1))))})
    open_, values = [((), 0, total, wanted)], {}  # (bins within bins, values before, values in it, ranks)
    while open_:
        binned = [x[2] > few and (not x[0] or x[0][-1][1] < 1e14) for x in open_]
        scanned = scan([(x[0], b) for x, b in zip(open_, binned, strict=True)])
        nxt = []
        for (path, before, _, ranks), more, got in zip(open_, binned, scanned, strict=True):
            got = sorted(got.items())
            ends = before + np.cumsum([k for _, k in got])
            at = np.searchsorted(ends, ranks, "right").tolist()
            if not more:
                values |= {r: got[k][0] for r, k in zip(ranks, at, strict=True)}
                continue
            low, scale = finer(path) if path else first
            nxt += [((*path, (low, scale, int(got[b][0]))), int(ends[b] - got[b][1]), int(got[b][1]), [r for r, k in zip(ranks, at, strict=True) if k == b]) for b in sorted(set(at))]
        open_ = nxt
    out = []
    for s in shares:
        at = s * (total - 1)
        low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
        out.append(low + (high - low) * (at - np.floor(at)))
    return out
