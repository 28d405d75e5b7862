"""Property-graph work as joins: traversal, lineage, entity resolution, event links, communities, walks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velarium.functions import vector as V
from velarium.operators.components import components
from velarium.shared import bucketed, cut, ship, stored


def either_way(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _levels(steps: DataFrame, seeds: DataFrame, depth: int | None) -> Iterator[DataFrame]:
    """(node, hops) level by level, breadth first, until nothing is new or `depth` is reached; one checkpoint a level."""
    level = seen = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    yield level
    hops = 0
    while depth is None or hops < depth:
        hops += 1
        fresh = steps.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        level = cut(fresh.withColumn("hops", F.lit(hops)))
        if level.isEmpty():
            return
        seen = seen.unionByName(level) if hops % 20 else cut(seen.unionByName(level))
        yield level


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = 2, directed: bool = False) -> DataFrame:
    """(node, hops) of everything within `depth` steps of the seeds (node); breadth first, each node once at its least distance.

    One join, one anti-join and one checkpoint in the shared folder a step, so the plan of a step does not hold the earlier ones.
    """
    steps = edges.select("src", "dst") if directed else either_way(edges)
    return reduce(DataFrame.unionByName, _levels(steps, seeds, depth))


def lineage(edges: DataFrame, roots: DataFrame, distinct: bool = False, levels: int | None = None) -> DataFrame:
    """Edges (parent, child) whose parent is reachable from the roots (node), each once, with the parent's depth; a child of n parents appears n times.

    It goes on until nothing is new; where `levels` is given and more than that many levels are there, it is an error. `distinct` gives each child once at its least depth.
    """
    spots = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    seen = []
    for level in _levels(spots, roots, None):
        seen.append(level)
        if levels is not None and len(seen) > levels + 1:
            raise ValueError(f"the lineage has more than {levels} levels")
    found = edges.join(reduce(DataFrame.unionByName, seen).withColumnRenamed("node", "parent"), "parent").select("parent", "child", (F.col("hops") + 1).alias("depth"))
    return found.groupBy("child").agg(F.min("depth").alias("depth")) if distinct else found


def traversal(edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """(node, path_length, edge_type, weight) of the nodes 1 to `depth` steps from `start` either way, each once: breadth first, by the least edge type, weight and origin.

    `edges` has src, dst, edge_type and weight; a path's length counts its nodes.
    """
    cols = ["edge_type", "weight"]
    steps = edges.select("src", "dst", *cols).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))
    spark = edges.sparkSession
    levels = [spark.range(1).select(F.lit(start).alias("node"), F.lit(1).alias("path_length"), F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast("double").alias("weight"))]
    for n in range(2, depth + 2):
        seen = reduce(DataFrame.unionByName, levels).select("node")
        via = steps.join(levels[-1].select(F.col("node").alias("src")), "src").join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti")
        best = via.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(F.coalesce("edge_type", F.lit("link")).alias("edge_type"), F.col("weight").cast("double").alias("weight"), "src")).alias("e"))
        levels.append(cut(best.select("node", F.lit(n).alias("path_length"), "e.edge_type", "e.weight")))
    return reduce(DataFrame.unionByName, levels[1:])


def seed_expansion(edges: DataFrame, seeds: DataFrame, points: DataFrame, query: list[float], hops: int = 2, k: int = 50) -> DataFrame:
    """Nodes 1 to `hops` steps from the seeds by cosine with the query; distinct first, then the limit. Null vectors rank last."""
    near = reachable(edges, seeds, hops).filter("hops > 0")
    scored = near.join(points, "node").withColumn("score", V.cosine(F.col("embedding"), V.literal(query)))
    return scored.orderBy(F.col("score").desc_nulls_last(), "node").limit(k).select("node", "hops", "score")


def simplified(edges: DataFrame) -> DataFrame:
    """Undirected edges a < b with summed weights; loops go."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def merged_weights(relations: DataFrame, typed: DataFrame, members: DataFrame, member_weight: float = 1.0) -> DataFrame:
    """One weighted graph: relation weights add up, typed edges count their greatest, memberships a constant that wins."""
    summed = relations.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).withColumn("p", F.lit(0))
    highest = typed.groupBy("src", "dst").agg(F.max("weight").alias("weight")).withColumn("p", F.lit(1))
    fixed = members.select("src", "dst", F.lit(float(member_weight)).alias("weight"), F.lit(2).alias("p"))
    every = summed.unionByName(highest).unionByName(fixed)
    return every.groupBy("src", "dst").agg(F.max_by("weight", "p").alias("weight"))


def with_ends(edges: DataFrame, nodes: DataFrame, key: str = "node") -> DataFrame:
    """Edges both of whose ends exist."""
    return edges.join(nodes.select(F.col(key).alias("src")), "src", "left_semi").join(nodes.select(F.col(key).alias("dst")), "dst", "left_semi")


def collapsed(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """Relations (subject, relation, object, segment) after the map (orig, global) of their ends: weight and sorted segments.

    Ends without a map stay; loops that the map makes go.
    """
    of = lambda name: canonical.select(F.col("orig").alias(name), F.col("global").alias(f"_{name}"))
    mapped = relations.join(of("subject"), "subject", "left").join(of("object"), "object", "left")
    ends = mapped.select(F.coalesce("_subject", "subject").alias("subject"), "relation", F.coalesce("_object", "object").alias("object"), "segment")
    return ends.filter("subject <> object").groupBy("subject", "relation", "object").agg(F.count(F.lit(1)).alias("weight"), F.sort_array(F.collect_list("segment")).alias("segments"))


def canonical_entities(entities: DataFrame, group: str, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row a group: its first row's columns, all merged keys, first and last segment."""
    first = F.min_by(F.struct(*columns), F.struct(order, key)).alias("first")
    out = entities.groupBy(group).agg(first, F.sort_array(F.collect_list(key)).alias("merged_from"), F.min("segment").alias("first_seen"), F.max("segment").alias("last_seen"))
    return out.select(group, "first.*", "merged_from", "first_seen", "last_seen")


# links between events


def event_pairs(events: DataFrame, by: str, index: str, key: str, vector: str, members: str, window: int | None = None) -> DataFrame:
    """Pairs of one group in index order with cosine, shared members and Jaccard; a window bounds the distance of dense positions.

    Pairs come from an equi-join on the group. With a window, each event collects those at the next positions from a sliding frame, so a row is shuffled once and a long group is linear where
    positions have few events; where they have many, `tied_links` finds the links.
    """
    dense = events.withColumn("_p", F.dense_rank().over(Window.partitionBy(by).orderBy(index)))
    left = [F.col(by), F.col(key).alias("a"), F.col("_p").alias("pa"), F.col(vector).alias("va"), F.col(members).alias("ma")]
    right = [F.col(key).alias("b"), F.col("_p").alias("pb"), F.col(vector).alias("vb"), F.col(members).alias("mb")]
    if window is None:
        pairs = dense.select(*left).join(dense.select(F.col(by), *right), by).filter(F.col("pa") < F.col("pb"))
    else:
        ahead = Window.partitionBy(by).orderBy("_p").rangeBetween(1, window)
        pairs = dense.select(*left, F.collect_list(F.struct(*right)).over(ahead).alias("x")).select(by, "a", "pa", "va", "ma", F.inline("x"))
    return _compared(pairs, by)


def overlapping_pairs(sets: DataFrame, by: str, key: str, members: str, least: float) -> DataFrame:
    """(by, a, b) of the pairs a < b of a group whose Jaccard similarity may be `least` or more: they share one of their rarest members.

    Members are ordered by how few rows of the group hold them. Two sets of such a similarity share at least ceil(least * n) members of the one with n, so one of its first n - ceil(least * n) + 1 is
    also among the first of the other; only those are joined, sizes that are too far apart are not paired, and pairs still have to be verified. Empty and null sets pair with nothing.
    """
    held = sets.select(by, key, F.explode(F.array_distinct(members)).alias("member"))
    rare = held.groupBy(by, "member").agg(F.count(F.lit(1)).alias("n"))
    ranked = held.join(rare, [by, "member"]).groupBy(by, key).agg(F.array_sort(F.collect_list(F.struct("n", "member"))).alias("m"))  # a set's own members
    n = F.size("m")
    # a hair below, so that a product that should be whole isn't taken for more
    first = ranked.select(by, key, n.alias("size"), F.posexplode(F.slice("m", 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int"))).alias("at", "x")).select(by, key, "size", F.col("x.member").alias("member"))
    other = first.select(by, F.col(key).alias("b"), F.col("size").alias("size_b"), "member")
    fit = (F.col("a") < F.col("b")) & (F.least("size", "size_b") >= F.greatest("size", "size_b") * least - 1e-9)
    return first.withColumnRenamed(key, "a").join(other, [by, "member"]).filter(fit).select(by, "a", "b").distinct()


def event_links(events: DataFrame, by: str, index: str, key: str, vector: str, members: str, strong: float = 0.75, overlap: float = 0.30, following: bool = True) -> DataFrame:
    """`linked(event_pairs(...))` over all pairs of a group, without a join of all pairs: a group's events are shuffled once, to its blocks, and only links leave a task.

    A group of up to 500 events is one block; a longer one has blocks of up to WIDE, and every pair of them is a task's matrix product, as in `similar_pairs`.
    """
    ship(events.sparkSession)
    kind = events.schema
    name, n = kind[key].dataType.simpleString(), F.count(F.lit(1)).over(Window.partitionBy(by))
    counted = F.greatest(F.least(F.ceil(n / 500), F.lit(8)), F.ceil(n / WIDE)).cast("int")
    # events without a group are in no pair; filtered here, as the join of blocks would, so that all three readings of the blocks share one shuffle
    placed = events.filter(F.col(by).isNotNull()).select(by, key, vector, members, F.dense_rank().over(Window.partitionBy(by).orderBy(index)).alias("_p"), counted.alias("_blocks"))
    dealt = placed.withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    # dealt by group already
    blocks = dealt.groupBy(by, "_block", "_blocks").agg(F.collect_list(F.struct(key, vector, members, "_p")).alias("rows"))

    def product(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every_row in frames:
            short = pc.and_(pc.is_null(every_row.column("others")), pc.less_equal(pc.list_value_length(every_row.column("rows")), SHORT))
            few, many = every_row.filter(short), every_row.filter(pc.invert(short))
            for frame, found in [(few, _short(few)), *((many, _crossed(many, k)) for k in range(many.num_rows))]:
                for group, one, two, i, j, s, shared, every in found:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        jaccard = shared / np.where(every > 0, every, np.nan)
                    pi, pj = (side[3].to_numpy()[at] for side, at in ((one, i), (two, j)))
                    # a hair below, as both are compared after they are rounded to four places
                    keep = (pi != pj) & ((s >= strong - 6e-5) | (jaccard >= overlap - 6e-5) | (following & (np.abs(pi - pj) == 1)))
                    i, j, pi, pj, turned = i[keep], j[keep], pi[keep], pj[keep], pa.array((pi > pj)[keep])
                    x, y = one[0].take(pa.array(i)), two[0].take(pa.array(j))
                    own = lambda values, t: pa.array(values[keep], t, from_pandas=True)  # noqa: B023, E731
                    columns = [frame.column(by).take(pa.array(group[keep])), pc.if_else(turned, y, x), pc.if_else(turned, x, y), pa.array(np.minimum(pi, pj), pa.int32()), pa.array(np.maximum(pi, pj), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, own(s, pa.float64()), own(shared, pa.float64()), own(jaccard, pa.float64())], names=[by, "a", "b", "pa", "pb", "similarity", "shared", "jaccard"])

    schema = f"{by} {kind[by].dataType.simpleString()}, a {name}, b {name}, pa int, pb int, similarity double, shared double, jaccard double"
    found = _block_pairs(blocks, by).mapInArrow(product, schema)
    return linked(found.withColumns({"similarity": F.round("similarity", 4), "shared": F.col("shared").cast("int"), "jaccard": F.round("jaccard", 4)}), strong, overlap, following)


#: A group of so many events is compared pair by pair, with many others at once, and so many pairs at a time.
SHORT, PAIRS = 64, 50_000


def _crossed(frame: pa.RecordBatch, k: int) -> Iterator[tuple]:
    """(row of the frame, sides, places in them, cosine, sizes of intersection and union) of all pairs of one pair of blocks (key, vector, members, place)."""
    one, two = _sides(frame, k)
    s = _directions(one[1]) @ _directions((two or one)[1]).T
    shared, every = _overlaps(one[2], (two or one)[2])
    i, j = np.nonzero(np.triu(np.ones_like(s, bool), 1) if two is None else np.ones_like(s, bool))
    yield np.full(len(i), k), one, two or one, i, j, s[i, j], shared[i, j], every[i, j]


def _short(frame: pa.RecordBatch) -> Iterator[tuple]:
    """The same of short groups, a block each: their pairs one by one."""
    lists = frame.column("rows")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    done = np.cumsum(sizes * (sizes - 1) // 2)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + PAIRS, side="right")))
        one, n = lists.slice(first, last - first).flatten().flatten(), sizes[first:last]
        group = np.repeat(np.arange(first, last), n)
        later = np.repeat(np.cumsum(n), n) - 1 - np.arange(len(group))  # rows of the same group after each
        i = np.repeat(np.arange(len(group)), later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        x = _directions(one[1])
        codes = one[2].flatten().dictionary_encode(null_encoding="encode")
        wide = max(1, len(codes.dictionary))
        held = np.unique(pc.list_parent_indices(one[2]).to_numpy(zero_copy_only=False).astype(np.int64) * wide + codes.indices.to_numpy(zero_copy_only=False))
        m = np.bincount(held // wide, minlength=len(group))
        ask = np.repeat(np.arange(len(i)), m[i])
        mine = held[(np.cumsum(m) - m)[i][ask] + np.arange(len(ask)) - np.repeat(np.cumsum(m[i]) - m[i], m[i])] % wide + j[ask] * wide
        hit = held[np.minimum(np.searchsorted(held, mine), max(0, len(held) - 1))] == mine
        shared = np.bincount(ask, hit, minlength=len(i))
        absent = np.asarray(one[2].is_null())
        shared = np.where(absent[i] | absent[j], np.nan, shared)
        yield group[i], one, one, i, j, (x[i] * x[j]).sum(1), shared, m[i] + m[j] - shared
        first = last


def _overlaps(one: pa.Array, two: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersections and unions of two sides' arrays as sets; a null array's are nan."""
    sides, inside = [], np.zeros((len(one), len(two)))
    values = pa.concat_arrays([one.flatten(), two.flatten()]).dictionary_encode(null_encoding="encode")
    codes, at = values.indices.to_numpy(zero_copy_only=False), 0
    for side in (one, two):
        rows = pc.list_parent_indices(side).to_numpy()
        sides.append(np.unique(np.stack([rows, codes[at : at + len(rows)]]), axis=1))
        at += len(rows)
    for k in range(0, len(values.dictionary), 1000):  # some terms at a time
        m = []
        for (rows, terms), side in zip(sides, (one, two), strict=True):
            x, here = np.zeros((len(side), 1000), np.float32), (terms >= k) & (terms < k + 1000)
            x[rows[here], terms[here] - k] = 1
            m.append(x)
        inside += m[0] @ m[1].T
    n = [np.where(np.asarray(side.is_null()), np.nan, np.bincount(rows, minlength=len(side))) for (rows, _), side in zip(sides, (one, two), strict=True)]
    every = n[0][:, None] + n[1][None, :] - inside
    return np.where(np.isnan(every), np.nan, inside), every


def _directions(vectors: pa.Array) -> np.ndarray:
    """Unit rows; nan for null and zero vectors."""
    size = max([len(v) for v in vectors.drop_null()[:1]], default=1)
    x = np.full((len(vectors), size), np.nan)
    x[~np.asarray(vectors.is_null())] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def tied_links(events: DataFrame, by: str, index: str, key: str, vector: str, members: str, window: int, strong: float = 0.75, overlap: float = 0.30, following: bool = True) -> DataFrame:
    """`linked(event_pairs(...))` with a window, where many events share a position: products of blocks of events, so that a vector is sent to one stretch of positions or two, and as what they are compared with, and only links leave a task."""
    ship(events.sparkSession)
    kind = events.schema
    name = kind[key].dataType.simpleString()
    # events without a group are in no pair; filtered here, as the join would, so that both sides share the shuffle by group
    dense = events.filter(F.col(by).isNotNull()).select(by, key, vector, members, F.dense_rank().over(Window.partitionBy(by).orderBy(index)).alias("_p"))
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(by, "_p")) / WIDE)
    dealt = dense.withColumn("_block", F.pmod(F.xxhash64(key), blocks))
    whole = dealt.groupBy(by, "_p", "_block").agg(F.collect_list(F.struct(key, vector, members)).alias("rows"))
    # blocks meet in stretches of positions, so one is sent to the stretches that the window ahead of it touches, and not to each position
    stretch = lambda p: F.floor(p / (4 * window)).cast("int")
    left = whole.withColumn("at", F.explode(F.sequence(stretch(F.col("_p") + 1), stretch(F.col("_p") + window)))).select(by, F.col("_p").alias("pa"), "at", "rows")
    right = whole.select(by, F.col("_p").alias("pb"), stretch(F.col("_p")).alias("at"), F.col("rows").alias("others"))
    pairs = left.join(right, [by, "at"]).filter((F.col("pb") > F.col("pa")) & (F.col("pb") <= F.col("pa") + window))

    def product(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for k in range(frame.num_rows):
                one, two = _sides(frame, k)
                pa_, pb_ = frame.column("pa")[k].as_py(), frame.column("pb")[k].as_py()
                s = _directions(one[1]) @ _directions(two[1]).T
                shared, every = _overlaps(one[2], two[2])
                with np.errstate(divide="ignore", invalid="ignore"):
                    j = shared / np.where(every > 0, every, np.nan)
                # a hair below, as both are compared after they are rounded to four places
                found = np.ones_like(s, bool) if following and pb_ - pa_ == 1 else (s >= strong - 6e-5) | (j >= overlap - 6e-5)
                x, y = np.nonzero(found)
                own = lambda values, t: pa.array(values[x, y], t, from_pandas=True)  # noqa: B023, E731
                columns = [frame.column(by).take(pa.array(np.full(len(x), k))), one[0].take(pa.array(x)), two[0].take(pa.array(y)), pa.array(np.full(len(x), pa_), pa.int32()), pa.array(np.full(len(x), pb_), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, own(s, pa.float64()), own(shared, pa.float64()), own(j, pa.float64())], names=[by, "a", "b", "pa", "pb", "similarity", "shared", "jaccard"])

    schema = f"{by} {kind[by].dataType.simpleString()}, a {name}, b {name}, pa int, pb int, similarity double, shared double, jaccard double"
    found = pairs.select(by, "pa", "pb", "rows", "others").mapInArrow(product, schema)
    rounded = found.withColumns({"similarity": F.round("similarity", 4), "shared": F.col("shared").cast("int"), "jaccard": F.round("jaccard", 4)})
    return linked(rounded, strong, overlap, following)


def _compared(pairs: DataFrame, by: str) -> DataFrame:
    """Similarity, shared members and Jaccard of pairs with their vectors (va, vb) and members (ma, mb)."""
    shared, union = F.size(F.array_intersect("ma", "mb")), F.size(F.array_union("ma", "mb"))
    return pairs.select(by, "a", "b", "pa", "pb", F.round(V.cosine(F.col("va"), F.col("vb")), 4).alias("similarity"), shared.alias("shared"), F.round(F.try_divide(shared.cast("double"), union.cast("double")), 4).alias("jaccard"))


def linked(pairs: DataFrame, strong: float = 0.75, overlap: float = 0.30, following: bool = True) -> DataFrame:
    """The type of each linked pair by precedence: adjacent, similar, overlapping. Other pairs go."""
    kind = F.when(F.col("similarity") >= strong, F.lit("SEMANTIC")).when(F.col("jaccard") >= overlap, F.lit("ENTITY_OVERLAP"))
    if following:
        kind = F.when(F.col("pb") - F.col("pa") == 1, F.lit("NEXT_EVENT")).otherwise(kind)
    return pairs.withColumn("edge_type", kind).filter(F.col("edge_type").isNotNull())


def community_votes(events: DataFrame, members: DataFrame, by: str, key: str, start: Column) -> DataFrame:
    """(event, community, shared, method): the community that shares most members, ties to the first, and how many; else that of the nearest event in time that has one, else the first of all.

    `events` explode to (by, key, member); fallbacks look at the nearest voted event on either side, by two windows, never at all pairs.
    """
    voted = events.join(members, "member").groupBy(by, key, "community").agg(F.countDistinct("member").alias("votes"))
    best = voted.groupBy(by, key).agg(F.max_by("community", F.struct("votes", (-F.col("community")).alias("c"))).alias("community"), F.max("votes").alias("shared"))
    every = events.groupBy(by, key).agg(F.min(start).alias("t")).join(best, [by, key], "left")
    # both windows grow row by row: one that shrinks is counted anew at every row
    w, back = Window.partitionBy(by).orderBy("t", key), Window.partitionBy(by).orderBy(F.col("t").desc(), F.col(key).desc())
    anchor = F.when(F.col("community").isNotNull(), F.struct("t", "community"))
    last = lambda over: F.last(anchor, True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    near = every.withColumn("before", last(w)).withColumn("after", last(back))
    nearer = F.when(F.col("after.t").isNull() | (F.col("t") - F.col("before.t") <= F.col("after.t") - F.col("t")), F.col("before.community")).otherwise(F.col("after.community"))
    method = F.when(F.col("community").isNotNull(), "vote").when(nearer.isNotNull(), "nearest").otherwise("default")
    first = members.agg(F.min("community").alias("_first"))  # one row
    return near.join(F.broadcast(first)).select(by, key, F.coalesce("community", nearer, "_first").alias("community"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), method.alias("method"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """n_nodes, n_edges, n_communities and the modularity of a partition (node, community) of undirected weighted edges (a, b, weight)."""
    end = lambda c: membership.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    known = edges.join(end("a"), "a").join(end("b"), "b")
    inside = known.groupBy(F.col("ca").alias("community")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("w_in"))
    ends = known.select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("degree"))
    total = known.agg(F.sum("weight").alias("m"), F.count(F.lit(1)).alias("n_edges"))
    per = ends.join(inside, "community", "left").join(F.broadcast(total))
    q = per.agg(F.round(F.sum(F.coalesce("w_in", F.lit(0.0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)), 6).alias("modularity"), F.max("n_edges").alias("n_edges"))
    nodes = membership.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("community").alias("n_communities"))
    return nodes.join(F.broadcast(q))


# entity resolution


def average_linkage(distance: np.ndarray, most: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers of average linkage cut at a distance; merges go from the nearest pair on, ties to the first. `sizes` are the points that each row stands for, one by default."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n) if sizes is None else np.asarray(sizes, float).copy(), np.arange(n)
    nearest = d.min(1) if n else d
    while n > 1:
        i = int(np.argmin(nearest))
        if not nearest[i] <= most:
            break
        j = int(np.argmin(d[i]))
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
        nearest = d.min(1)
    return np.unique(label, return_inverse=True)[1]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit rows of an array of vectors; a zero vector stays as it is."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _sparse_matrices(*sides: pa.Array, unit: bool = True) -> list[np.ndarray]:
    """Arrays of (term, weight) as rows, unit ones by default, over the terms that any of them has; of a term that a row repeats the last weight counts."""
    rows = [[[tuple(p.values()) for p in r or ()] for r in side.to_pylist()] for side in sides]
    terms = {t: k for k, t in enumerate(sorted({t for side in rows for r in side for t, _ in r}))}
    out = []
    for side in rows:
        x = np.zeros((len(side), max(1, len(terms))))
        for k, r in enumerate(side):
            for t, w in r:
                x[k, terms[t]] = w
        out.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if unit else x)
    return out


#: Rows of a block in a group of many blocks: a row is sent once for each block of its group.
WIDE = 1000


def _blocks(points: DataFrame, by: str, key: str, cols: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """(by, _block, _blocks, rows) and the pairs of them (rows, others): each with itself (others is null), then with every later one of its group."""
    n = F.count(F.lit(1))
    sizes = points.groupBy(by).agg(F.greatest(F.least(F.ceil(n / block), F.lit(8)), F.ceil(n / max(block, WIDE))).cast("int").alias("_blocks"))
    dealt = points.join(sizes, by).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    blocks = dealt.groupBy(by, "_block", "_blocks").agg(F.array_sort(F.collect_list(F.struct(key, *cols))).alias("rows"))
    return blocks, _block_pairs(blocks, by)


def _block_pairs(blocks: DataFrame, by: str) -> DataFrame:
    left = blocks.filter("_block < _blocks - 1").withColumn("_other", F.explode(F.sequence(F.col("_block") + 1, F.col("_blocks") - 1)))
    right = blocks.filter("_block > 0").select(F.col(by).alias("_by"), F.col("_block").alias("_other_block"), F.col("rows").alias("others"))
    pairs = left.join(right, (F.col(by) == F.col("_by")) & (F.col("_other") == F.col("_other_block"))).select(by, "rows", "others")
    own = blocks.select(by, "rows").withColumn("others", F.lit(None).cast(blocks.schema["rows"].dataType))
    return own.unionByName(pairs)


def _sides(frame: pa.RecordBatch, k: int) -> tuple[list[pa.Array], list[pa.Array] | None]:
    """The columns of the rows of one pair of blocks; None for a block with itself."""
    part = frame.slice(k, 1)
    one, two = part.column("rows"), part.column("others")
    return one.flatten().flatten(), None if two.null_count else two.flatten().flatten()


def _products(one: list[pa.Array], two: list[pa.Array] | None, sparse: bool, weights: tuple[float, float]) -> np.ndarray:
    x = _matrix(one[1])
    s = x @ (x if two is None else _matrix(two[1])).T
    if sparse:
        y = _sparse_matrices(one[2]) * 2 if two is None else _sparse_matrices(one[2], two[2])
        s = weights[0] * s + weights[1] * (y[0] @ y[1].T)
    return s


def similar_pairs(points: DataFrame, by: str, key: str, vector: str, least: float, sparse: str | None = None, weights: tuple[float, float] = (0.9, 0.1), block: int = 500) -> DataFrame:
    """(by, a, b, similarity) of all pairs a < b of a group whose similarity is `least` or more: cosine, or 0.9 of the dense and 0.1 of the sparse cosine.

    Rows of a group are dealt to blocks of about `block` rows, of WIDE where a group has many; every pair of blocks is one matrix product in a task, so a task holds two blocks however long the
    group is. A group of one block is joined with nothing. `sparse` is an array of (term, weight) structs.
    """
    ship(points.sparkSession)
    kind = points.schema
    cols = [vector] + ([sparse] if sparse else [])
    schema = f"{by} {kind[by].dataType.simpleString()}, a {kind[key].dataType.simpleString()}, b {kind[key].dataType.simpleString()}, similarity double"

    def product(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for k in range(frame.num_rows):
                one, two = _sides(frame, k)
                s = _products(one, two, sparse is not None, weights)
                i, j = np.nonzero((np.triu(s >= least, 1)) if two is None else s >= least)
                x, y = one[0].take(pa.array(i)), (one if two is None else two)[0].take(pa.array(j))
                turned, same = pc.greater(x, y), pc.equal(x, y)
                columns = [frame.column(by).take(pa.array(np.full(len(i), k))), pc.if_else(turned, y, x), pc.if_else(turned, x, y), pa.array(s[i, j], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[by, "a", "b", "similarity"]).filter(pc.invert(same))

    return _blocks(points, by, key, cols, block)[1].mapInArrow(product, schema)


def _nearest_merges(state: DataFrame, cut_at: float, sparse: bool, weights: tuple[float, float], block: int) -> DataFrame:
    """(part, a, b) of clusters a < b of a part that are each other's nearest (ties to the least) at an average similarity of `cut_at` or more, and (part, a, null) of those that no other is as near to."""
    kind = state.schema["key"].dataType.simpleString()

    def nearest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for k in range(frame.num_rows):
                one, two = _sides(frame, k)
                s = _means(one, two, sparse, weights)
                if two is None:
                    np.fill_diagonal(s, -np.inf)
                for keys, others, t in ((one[0], (two or one)[0], s), *([(two[0], one[0], s.T)] if two else [])):
                    at = t.argmax(1)
                    columns = [frame.column("part").take(pa.array(np.full(len(at), k))), keys, others.take(pa.array(at)), pa.array(t[np.arange(len(at)), at], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "other", "s"])

    seen = _blocks(state, "part", "key", ["n", "mean"] + (["sparse"] if sparse else []), block)[1].mapInArrow(nearest, f"part long, key {kind}, other {kind}, s double")
    # of the greatest similarity the least other; alone in its part a cluster has none
    ranked = seen.filter("s > double('-inf')").groupBy("part", "key", "s").agg(F.min("other").alias("other")).groupBy("part", "key").agg(F.max_by("other", "s").alias("other"), F.max("s").alias("s"))
    best = cut(ranked.filter(F.col("s") >= cut_at))
    back = best.select("part", F.col("key").alias("other"), F.col("other").alias("key"))
    both = best.filter(F.col("key") < F.col("other")).join(back, ["part", "key", "other"]).select("part", F.col("key").alias("a"), F.col("other").alias("b"))
    done = state.select("part", F.col("key").alias("a")).join(best.select("part", F.col("key").alias("a")), ["part", "a"], "left_anti")
    return cut(both.unionByName(done.withColumn("b", F.lit(None).cast(kind))))


def _means(one: list[pa.Array], two: list[pa.Array] | None, sparse: bool, weights: tuple[float, float]) -> np.ndarray:
    """Average similarities between clusters (key, n, mean, sparse): products of their mean unit vectors."""
    dense = lambda side: side[2].flatten().to_numpy(zero_copy_only=False).reshape(len(side[2]), -1)
    x = dense(one)
    s = x @ (x if two is None else dense(two)).T
    if sparse:
        y = _sparse_matrices(one[3], unit=False) * 2 if two is None else _sparse_matrices(one[3], two[3], unit=False)
        s = weights[0] * s + weights[1] * (y[0] @ y[1].T)
    return s


def resolved_entities(points: DataFrame, by: str, key: str, vector: str, similarity: float = 0.75, sparse: str | None = None, weights: tuple[float, float] = (0.9, 0.1), most: int = 2_000, block: int = 500) -> DataFrame:
    """(by, key, cluster): average-linkage clusters of a group's points, cut at a similarity; clusters are numbered within a group by their least key.

    Equal points are one from the start, as nothing is nearer to them. Clusters merge at an average similarity of at least the cut, so some pair between them has it: clusters lie within the
    components of the pairs at or above it. Those pairs come from `similar_pairs`, components from joins. A component of up to `most` points is clustered by its matrix in a task. A larger one goes
    through rounds that merge all clusters that are each other's nearest, which gives the same clusters, as a merge brings nothing nearer; an average similarity is the product of the clusters' mean
    unit vectors, so a round is products of blocks. Clusters without any other at the cut are finished, and what is left of a component is clustered in a task once it is small enough.
    """
    ship(points.sparkSession)
    kind = points.schema
    name = kind[key].dataType.simpleString()
    rows = points.select(by, key, F.col(vector).alias("_v"))
    if sparse:
        term, weight = kind[sparse].dataType.elementType.names
        pairs = F.coalesce(F.col(sparse), F.array().cast(kind[sparse].dataType))
        # of a term that a point repeats the last weight counts
        last = lambda t: F.element_at(F.filter(pairs, lambda x: x[term] == t), -1)[weight].cast("double")
        once = F.transform(F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x[term]))), lambda t: F.struct(t.alias("term"), last(t).alias("weight")))
        rows = points.select(by, key, F.col(vector).alias("_v"), once.alias("_s"))
    some = lambda c: F.when(F.exists(c, lambda x: x != 0), 1.0).otherwise(0.0)
    own = weights[0] * some(F.col("_v")) + weights[1] * some(F.col("_s.weight")) if sparse else some(F.col("_v"))
    # a point less near to itself than the cut is not one with its copies
    rows = stored(rows.withColumn("_own", F.when(own < similarity, F.col(key))), "entities")
    same = [by, "_v", *(["_s"] if sparse else [])]
    firsts = stored(rows.groupBy(*same, "_own").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("n")), "entities")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*same, "_own"]]
    member = rows.alias("x").join(firsts.alias("y"), reduce(lambda a, b: a & b, on)).select(f"x.{by}", f"x.{key}", "_first")

    # a hair below the cut, as a mean may reach it by rounding
    links = similar_pairs(firsts.withColumnRenamed("_first", key), by, key, "_v", similarity - 1e-9, "_s" if sparse else None, weights, block)
    node = lambda c: F.xxhash64(F.col(by), F.col(c))
    parts = components(cut(links.select(node("a").alias("a"), node("b").alias("b")))).withColumnRenamed("node", "_node")
    tagged = firsts.withColumn("_node", node("_first")).join(parts, "_node", "left")
    scaled = [V.normalised(F.col("_v")).alias("mean")]
    if sparse:
        norm = F.sqrt(F.aggregate("_s", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
        scaled.append(F.transform("_s", lambda x: F.struct(x["term"].alias("term"), (x["weight"] / F.greatest(norm, F.lit(1e-12))).alias("weight"))).alias("sparse"))
    state = stored(tagged.select(F.coalesce("root", "_node").alias("part"), F.col("_first").alias("key"), "n", *scaled), "entities")
    columns, moved, small = state.columns, [], []
    labels = state.select("part", F.col("key").alias("first"), "key")
    while True:
        sizes = state.groupBy("part").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > most).select("part")
        small.append(state.join(sizes, "part", "left_anti"))
        state = state.join(sizes, "part", "left_semi")
        if state.isEmpty():
            break
        moves = _nearest_merges(state, similarity - 1e-12, sparse is not None, weights, block)
        to = moves.filter("b IS NOT NULL").select("part", F.col("b").alias("key"), F.col("a").alias("to"))
        labels = cut(labels.join(to, ["part", "key"], "left").select("part", "first", F.coalesce("to", "key").alias("key")))
        finished = moves.filter("b IS NULL").select("part", F.col("a").alias("key"))
        left = state.join(finished, ["part", "key"], "left_anti").join(to, ["part", "key"], "left").withColumn("key", F.coalesce("to", "key"))
        add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
        sums = [F.transform("mean", lambda v: v * F.col("n")).alias("mean")]
        if sparse:
            sums.append(F.map_from_entries(F.transform("sparse", lambda x: F.struct(x["term"], x["weight"] * F.col("n")))).alias("sparse"))
        # one cluster or two
        both = left.select("part", "key", "n", *sums).groupBy("part", "key").agg(F.sum("n").alias("n"), *[F.collect_list(c).alias(c) for c in columns[3:]])
        out = [F.transform(F.when(F.size("mean") == 2, add(F.col("mean")[0], F.element_at("mean", -1))).otherwise(F.col("mean")[0]), lambda v: v / F.col("n")).alias("mean")]
        if sparse:
            joint = F.map_zip_with(F.col("sparse")[0], F.element_at("sparse", -1), lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
            whole = F.map_entries(F.when(F.size("sparse") == 2, joint).otherwise(F.col("sparse")[0]))
            out.append(F.transform(whole, lambda x: F.struct(x["key"].alias("term"), (x["value"] / F.col("n")).alias("weight"))).alias("sparse"))
        state = stored(both.select("part", "key", "n", *out), "entities")

    def cluster(group: pa.Table) -> pa.Table:
        group = group.sort_by("key").combine_chunks()
        one = [group.column(c).combine_chunks() for c in columns[1:]]
        found = average_linkage(np.clip(1 - _means(one, None, sparse is not None, weights), 0, 2), 1 - similarity, one[1].to_numpy())
        # keys are in order: a cluster's first row has its least
        first = np.unique(found, return_index=True)[1][found]
        return pa.table({"part": group.column("part"), "key": one[0], "least": one[0].take(pa.array(first))})

    last = reduce(DataFrame.unionByName, small).groupBy("part").applyInArrow(cluster, f"part long, key {name}, least {name}")
    ended = labels.join(last, ["part", "key"], "left").select(F.col("first").alias("_first"), F.coalesce("least", "key").alias("least"), "part")
    named = firsts.select(by, "_first", node("_first").alias("_node")).join(parts, "_node", "left").select(by, "_first", F.coalesce("root", "_node").alias("part"))
    found = member.join(named.join(ended, ["part", "_first"]), [by, "_first"]).select(by, key, "least")
    return found.select(by, key, (F.dense_rank().over(Window.partitionBy(by).orderBy("least")) - 1).cast("long").alias("cluster"))


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community, settled) by weighted label propagation over undirected edges (a, b, weight), synchronous with halves taking turns.

    Each round is one join and two aggregations in Spark over the edges of its half, without a driver-side graph; edges stay in buckets and a node's neighbourhood passes through a task as a stream. A node of the round's half takes the label
    of greatest weight among its neighbours, ties to its own label and then the least. `settled` says whether two rounds in a row changed nothing within `rounds`.
    """
    both = bucketed(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "neighbours", ["b"])
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    still = 0
    for r in range(rounds):
        turn = lambda c, r=r: F.pmod(F.xxhash64(c), F.lit(2)) == r % 2
        # labels come to the edges, and what the round's half hears is dealt once, by node
        heard = both.filter(turn("a")).join(labels.withColumnRenamed("node", "b").hint("shuffle_hash"), "b").select("a", "community", "weight").repartition("a")
        near = heard.groupBy("a", "community").agg(F.sum("weight").alias("w"))
        own = near.join(labels.select(F.col("node").alias("a"), F.col("community").alias("mine")).hint("shuffle_hash"), "a")
        best = own.groupBy("a").agg(F.max_by("community", F.struct("w", (F.col("community") == F.col("mine")).alias("own"), (-F.col("community")).alias("c"))).alias("best"))
        fresh = cut(labels.join(best.withColumnRenamed("a", "node"), "node", "left").select("node", F.when(turn("node"), F.col("best")).otherwise(F.col("community")).alias("community"), (turn("node") & (F.col("best") != F.col("community"))).alias("moved")))
        moved = fresh.filter("moved").count()
        labels = fresh.select("node", "community")
        still = still + 1 if not moved else 0
        if still == 2:
            break
    return labels.withColumn("settled", F.lit(still == 2))


#: Steps after which walks are stored: the files of so many shuffles lie on the disk at once.
PIECE = 5


def walks(edges: DataFrame, per_node: int = 10, length: int = 80, weighted: bool = False, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """(walk, node ids in order) of random walks from every node, a step at a time as joins.

    A node's neighbours share [0, 1) by weight, evenly without weights; [0, 1) is cut in as many equal cells as the node has neighbours, and a draw is joined with the neighbours that
    reach into its cell, two rows on average however many neighbours there are. With p or q a step is second-order: the bias (1/p back to the node before, 1 to its neighbours,
    1/q elsewhere) decides which of a number of proposals is the first to be taken, and walks without one propose again, which gives exactly the biased distribution.
    Draws depend on (seed, walk, step, try) alone. A walk at a node without neighbours ends.
    """
    both = either_way(edges) if "weight" not in edges.columns else edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    order, whole = Window.partitionBy("src").orderBy("dst"), Window.partitionBy("src")
    merged = both.groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("w")) if weighted else both.select("src", "dst").distinct().withColumn("w", F.lit(1.0))
    shares = merged.select("src", "dst", F.count(F.lit(1)).over(whole).alias("degree"), (F.sum("w").over(order) / F.sum("w").over(whole)).alias("hi"), F.row_number().over(order).alias("_n"))
    shares = shares.withColumn("hi", F.when(F.col("_n") == F.col("degree"), 1.0).otherwise(F.col("hi")))
    shares = shares.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    degrees = cut(shares.groupBy("src").agg(F.first("degree").alias("degree")))
    second = p != 1.0 or q != 1.0
    last = F.least(F.floor(F.col("hi") * F.col("degree")), F.col("degree") - 1)
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * F.col("degree")), F.greatest(last, F.floor(F.col("lo") * F.col("degree")))))).drop("degree", "_n")
    # every neighbour is a node with neighbours of its own, as edges go either way
    cells = cells.join(degrees.withColumnRenamed("src", "dst"), "dst").withColumnRenamed("degree", "next_degree")
    if second:  # where the way back lies among the neighbour's own neighbours
        cells = cells.join(shares.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("lo").alias("back_lo"), F.col("hi").alias("back_hi")), ["src", "dst"])
    # both tables stay where they are, and only walks are shuffled to them
    cells = bucketed(cells.withColumnRenamed("src", "at"), "cells", ["at", "cell"])
    known = bucketed(merged.select(F.col("src").alias("before"), "dst", F.lit(True).alias("near")), "known", ["before", "dst"]) if second else None
    top, least, middle = max(1 / p, 1.0, 1 / q), min(1.0, 1 / q), max(1.0, 1 / q)
    proposals = 32
    node = edges.schema["src"].dataType
    now = degrees.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    now = now.select(F.concat_ws(":", "src", "k").alias("walk"), F.array("src").alias("path"), F.col("src").alias("at"), "degree")
    if second:
        now = now.withColumns({"before": F.lit(None).cast(node), "back_lo": F.lit(None).cast("double"), "back_hi": F.lit(None).cast("double")})
    state = now.columns
    draw = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), "walk", *salt), F.lit(1 << 30)) / float(1 << 30)

    def proposed(asked: DataFrame, *salt: Column) -> DataFrame:
        """Each walk's draw as a neighbour: dst, its degree, and for second-order walks where the way back is."""
        of = draw(*salt)
        hit = (of >= F.col("lo")) & (of < F.col("hi"))
        return asked.withColumn("cell", F.floor(of * F.col("degree"))).hint("shuffle_hash").join(cells.withColumnsRenamed({"back_lo": "next_lo", "back_hi": "next_hi"}), ["at", "cell"]).filter(hit)

    def stepped(chosen: DataFrame) -> DataFrame:
        out = [F.col("walk"), F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"), F.col("next_degree").alias("degree")]
        return chosen.select(*out, *([F.col("at").alias("before"), F.col("next_lo").alias("back_lo"), F.col("next_hi").alias("back_hi")] if second else []))

    def tries(step: int, done: int) -> Column:
        """The tries of a step that may be taken, up to the first that is taken whatever its neighbour is: a step back is seen by its draw, and the others differ by their bias alone."""
        every = F.transform(F.sequence(F.lit(done), F.lit(done + proposals - 1)), lambda n: F.struct(n.alias("try"), draw(F.lit(step), n).alias("of"), (draw(F.lit("take"), F.lit(step), n) * top).alias("take")))
        back = lambda x: F.coalesce((x["of"] >= F.col("back_lo")) & (x["of"] < F.col("back_hi")), F.lit(False))
        sure = lambda x: F.col("before").isNull() | F.when(back(x), x["take"] < 1 / p).otherwise(x["take"] < least)
        may = F.filter(every, lambda x: F.col("before").isNull() | F.when(back(x), x["take"] < 1 / p).otherwise(x["take"] < middle))
        end = F.coalesce(F.array_min(F.transform(F.filter(may, sure), lambda x: x["try"])), F.lit(done + proposals))
        return F.transform(F.filter(may, lambda x: x["try"] <= end), lambda x: F.struct(x["try"].alias("try"), x["take"].alias("take")))

    pieces = []
    for step in range(1, length):
        if not second:
            now = stepped(proposed(now, F.lit(step)))
        else:
            waiting, done, tried = now, [], 0
            while True:
                each = waiting.withColumn("_try", F.explode(tries(step, tried))).select("walk", "at", "degree", "before", "_try.*")
                judged = proposed(each, F.lit(step), F.col("try")).hint("shuffle_hash").join(known, ["before", "dst"], "left")
                bias = F.when(F.col("before").isNull(), top).when(F.col("dst") == F.col("before"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
                first = judged.filter(F.col("take") < bias).groupBy("walk").agg(F.min_by(F.struct("dst", "next_degree", "next_lo", "next_hi"), "try").alias("x"))
                found = stored(waiting.join(first, "walk", "left").select(*state, "x.*"), "walks")
                done.append(stepped(found.filter("dst IS NOT NULL")))
                waiting = found.filter("dst IS NULL").select(*state)
                tried += proposals
                if waiting.isEmpty():
                    break
            now = reduce(DataFrame.unionByName, done)
        if step % PIECE == 0 and step < length - 1:  # what is walked stays there, in buckets of walks, and a walk goes on with an empty path
            piece = bucketed(now, "walks", ["walk"], compression="zstd")
            pieces.append(piece.select("walk", F.col("path").alias(f"_{len(pieces)}")))
            now = piece.withColumn("path", F.array().cast(piece.schema["path"].dataType))
    if not pieces:
        return now.select("walk", "path")
    # a walk's pieces lie in buckets of the same number, so they meet without a shuffle, and the last comes to them
    paths = [c for piece in pieces for c in piece.columns[1:]]
    every = reduce(lambda a, b: a.join(b.hint("merge"), "walk"), pieces).join(now.select("walk", "path").hint("merge"), "walk", "left")
    return every.select("walk", F.concat(*paths, F.coalesce("path", F.array().cast(now.schema["path"].dataType))).alias("path"))


def node_embeddings(paths: DataFrame, size: int = 128, window: int = 10, seed: int = 42, least: int = 1, **options) -> DataFrame:
    """(node, vector) of a skip-gram model with negative sampling over walks, see `skipgram.skip_gram`; without walks there are no vectors."""
    from velarium.operators.skipgram import skip_gram

    return skip_gram(paths, size, window, seed=seed, least=least, **options)
