"""Operators of the scene pipeline as DataFrame plans. Keys name the scene, the node and the point;
every ranking has a total order, so results don't depend on partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key by a total order: z-buffer, best mask, top-1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def set_sizes(sets: DataFrame, node: str, name: str) -> DataFrame:
    return sets.groupBy(node).agg(F.count(F.lit(1)).alias(name))


def shared_points(left: DataFrame, right: DataFrame, point: str, a: str, b: str) -> DataFrame:
    """(a, b, inter) for sets that share a point: an equi-join on it, counted before the shuffle."""
    return left.join(right, point).groupBy(a, b).agg(F.count(F.lit(1)).alias("inter"))


def sized_pairs(left: DataFrame, right: DataFrame, point: str, a: str, b: str, best: bool = False, same: int = 0, ordered: bool = False, least: int = 1, share: float = 0.0) -> DataFrame:
    """(a, b, inter, n_a, n_b) for distinct rows (a, point) and (b, point) that share a point; ids are whole numbers. The b of a
    point travel to each of its a as one row of two arrays, and the rows of an a come to one task, which counts them, so a pair
    is exchanged once, as numbers. With ``best`` only the pair of greatest intersection over union of each a, the smallest b on
    ties; with ``same`` only pairs that are equal modulo it; with ``ordered`` only a < b. ``least`` points are in common at
    least, and a ``share`` of the smaller set."""
    sized = lambda df, c, n: df.join(df.groupBy(c).agg(F.count(F.lit(1)).cast("int").alias(n)), c)
    group = lambda c: F.col(c) % same if same else F.lit(0)
    held = sized(right, b, "_n").groupBy(point, group(b).alias("_g")).agg(F.collect_list(F.struct(F.col(b).cast("long").alias("b"), "_n")).alias("s"))
    met = sized(left, a, "n_a").withColumn("_g", group(a)).join(held, [point, "_g"] if same else [point])
    if ordered:
        met = met.withColumn("s", F.filter("s", lambda x: x["b"] > F.col(a))).filter(F.size("s") > 0)
    dealt = met.select(F.col(a).cast("long").alias("a"), "n_a", F.col("s.b").alias("b"), F.col("s._n").alias("n")).repartition("a").sortWithinPartitions("a")

    def count(keep):
        nodes, own, others, sizes = (np.concatenate(x) for x in zip(*keep, strict=True))
        order = np.lexsort((others, nodes))
        nodes, own, others, sizes = nodes[order], own[order], others[order], sizes[order]
        at = np.flatnonzero(np.append(True, (nodes[1:] != nodes[:-1]) | (others[1:] != others[:-1])))
        inter = np.diff(np.append(at, len(nodes)))
        nodes, own, others, sizes = nodes[at], own[at].astype(np.int64), others[at], sizes[at].astype(np.int64)
        ok = np.flatnonzero((inter >= least) & (inter / np.minimum(own, sizes) >= share))
        nodes, own, others, sizes, inter = nodes[ok], own[ok], others[ok], sizes[ok], inter[ok]
        if best and len(nodes):
            order = np.lexsort((others, -(inter / (own + sizes - inter)), nodes))
            some = order[np.append(True, nodes[order][1:] != nodes[order][:-1])]
            nodes, own, others, sizes, inter = nodes[some], own[some], others[some], sizes[some], inter[some]
        for lo in range(0, len(nodes), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + BLOCK]) for x in (nodes, others, inter.astype(np.int64), own, sizes)], names=["a", "b", "inter", "n_a", "n_b"])

    def run(batches):
        keep, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            often = np.diff(lists.offsets.to_numpy())
            keep.append((np.repeat(batch.column(0).to_numpy(), often), np.repeat(batch.column(1).to_numpy(), often), lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()))
            held += len(keep[-1][0])
            if held >= TILE:  # all but the last node, which may go on
                every = [np.concatenate(x) for x in zip(*keep, strict=True)]
                cut = int(np.searchsorted(every[0], every[0][-1]))
                if cut:
                    yield from count([[x[:cut] for x in every]])
                keep, held = [[x[cut:] for x in every]], held - cut
        if held:
            yield from count(keep)

    return dealt.mapInArrow(run, "a long, b long, inter long, n_a long, n_b long").withColumnsRenamed({"a": a, "b": b, "n_a": f"n_{a}", "n_b": f"n_{b}"})


DENSE = 3000  # nodes whose pairs a task counts in one matrix: 36 MB
BLOCK = 400_000  # (node, point) rows that are counted together
TILE = 1 << 22  # pairs or cells that are made at a time


def pair_counts(sets: DataFrame, node: str, point: str) -> DataFrame:
    """(a, b, inter) of nodes a < b that share points, from distinct (node, point) rows; nodes are whole numbers. Points are
    dealt to tasks, and each task adds up its points' pairs before they are exchanged: as products of 0/1
    matrices while it has up to DENSE nodes, else pair by pair, some TILE at a time."""

    def out(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "inter"])

    def sparse(nodes, group):
        order = np.lexsort((nodes, group))
        nodes, group = nodes[order], group[order]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        after = np.repeat(np.append(heads[1:], len(group)), np.diff(np.append(heads, len(group)))) - np.arange(len(group)) - 1
        i = 0
        while i < len(nodes):  # each row meets those after it in its point
            j = i + max(1, int(np.searchsorted(np.cumsum(after[i:]), TILE)))
            n = after[i:j]
            left = np.repeat(np.arange(i, i + len(n)), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            pairs, count = np.unique(np.stack([nodes[left], nodes[right]]), axis=1, return_counts=True)
            yield out(pairs[0], pairs[1], count.astype(np.int64))
            i = j

    def run(batches):
        known, total = np.zeros(0, np.int64), np.zeros((0, 0), np.int32)
        keep_n, keep_p, held = [], [], 0

        def count(nodes, points):
            nonlocal known, total
            group = points.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            every = np.union1d(known, nodes)
            if len(every) > DENSE:
                yield from sparse(nodes, group)
                return
            if len(every) > len(known):
                wide = np.zeros((len(every), len(every)), np.int32)
                at = np.searchsorted(every, known)
                wide[np.ix_(at, at)] = total
                known, total = every, wide
            col = np.searchsorted(known, nodes)
            step = max(1, TILE // max(1, len(known)))
            for lo in range(0, int(group.max()) + 1, step):
                some = (group >= lo) & (group < lo + step)
                x = np.zeros((min(step, int(group.max()) + 1 - lo), len(known)), np.float32)
                x[group[some] - lo, col[some]] = 1
                total += (x.T @ x).astype(np.int32)

        for b in batches:
            if not b.num_rows:
                continue
            nodes, points = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            keep_n.append(nodes)
            keep_p.append(points)
            held += len(nodes)
            if held >= BLOCK:  # all but the last point, which may go on
                nodes, points = np.concatenate(keep_n), pa.chunked_array(keep_p).combine_chunks()
                cut = int(np.flatnonzero(pc.equal(points, points[len(points) - 1]).to_numpy(zero_copy_only=False))[0])
                if cut:
                    yield from count(nodes[:cut], points[:cut])
                keep_n, keep_p, held = [nodes[cut:]], [points[cut:]], len(nodes) - cut
        if held:
            yield from count(np.concatenate(keep_n), pa.chunked_array(keep_p).combine_chunks())
        if len(known):
            for lo in range(0, len(known), 256):
                i, j = np.nonzero(np.triu(total[lo : lo + 256], lo + 1))
                yield out(known[i + lo], known[j], total[i + lo, j].astype(np.int64))

    kind = sets.schema[point].dataType.simpleString()
    key = F.to_json(F.struct(point)) if kind.startswith("struct") else F.col(point)
    dealt = sets.select(F.col(node).cast("long").alias("n"), key.alias("p")).repartition("p").sortWithinPartitions("p")
    return dealt.mapInArrow(run, "a long, b long, inter long").groupBy("a", "b").agg(F.sum("inter").alias("inter"))


SIDE = 1024  # nodes of a block; a task counts the pairs of two blocks at a time
FEW = 1 << 16  # points of which each may be a bit


def few_points(sets: DataFrame, node: str, point: str) -> bool:
    """Whether points are so few that each node holds one in 64 or more of them: their pairs are then nearly all pairs."""
    r = sets.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(node).alias("nodes"), F.approx_count_distinct(point).alias("points")).first()
    return bool(r["rows"]) and r["points"] <= FEW // 2 and r["rows"] * 64 >= r["nodes"] * r["points"]


def bit_pairs(sets: DataFrame, node: str, point: str, min_common: int = 1, min_ratio: float = 0.0, min_iou: float = 0.0, within=None, near: tuple[DataFrame, float] | None = None, forest: bool = False) -> DataFrame:
    """(a, b, inter, size_a, size_b) of nodes a < b by sets of few points, from distinct rows. A node is one row of bits. Blocks of
    SIDE nodes meet pairwise, each two in one task as a matrix product, so pairs are never exchanged. ``within``, a function
    of the node's column, is equal in a pair; ``near`` is (node, at) and a bound that ats differ by less than. ``forest`` leaves, of
    the pairs of two blocks, those that connect the same nodes."""
    spark = sets.sparkSession
    codes = sorted((r[0] for r in sets.select(point).distinct().collect()), key=repr)  # FEW at most
    kind = sets.select(point).schema[0].dataType.simpleString()
    table = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], f"{point} {kind}, _i int")
    width = -(-max(1, len(codes)) // 8)

    def pack(batches):
        for b in batches:
            offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)
            bits = np.zeros((b.num_rows, width * 8), np.uint8)
            bits[np.repeat(np.arange(b.num_rows), np.diff(offsets)), flat] = 1
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(bits.sum(axis=1, dtype=np.int64))], names=["n", "bits", "size"])

    rows = sets.filter(F.col(node).isNotNull()).join(F.broadcast(table), point).groupBy(F.col(node).cast("long").alias("n")).agg(F.collect_list("_i").alias("c"))
    rows = rows.mapInArrow(pack, "n long, bits binary, size long").filter(F.col("size") >= min_common)
    rows = rows.withColumn("w", F.lit(0) if within is None else F.xxhash64(within(F.col("n")).cast("string")))
    rows = rows.join(near[0].select(F.col(node).cast("long").alias("n"), F.col("at").cast("double").alias("at")), "n") if near else rows.withColumn("at", F.lit(0.0))
    bound = near[1] if near else None
    most = sets.filter(F.col(node).isNotNull()).select(node).distinct()
    most = most.withColumn("w", F.lit(0) if within is None else within(F.col(node))).groupBy("w").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-most // SIDE)
    k = F.pmod(F.xxhash64("n"), F.lit(blocks))
    met = rows.withColumn("k", k).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"lo": F.least("k", "j"), "hi": F.greatest("k", "j")})
    met = met.select("w", "lo", "hi", (F.col("k") == F.col("hi")).alias("second"), (F.col("k") == F.col("lo")).alias("first"), "n", "size", "at", "bits")

    def dense(col):
        flat = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), width)
        return np.unpackbits(flat, axis=1).astype(np.float32)

    def pairs(t):
        n, size, at = (t.column(c).to_numpy() for c in ("n", "size", "at"))
        first, second = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "second"))
        x = dense(t.column("bits"))
        same, root = len(first) == len(n) == len(second), np.arange(len(n))
        y = np.ascontiguousarray(x[second].T)

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for lo in range(0, len(first), 128):
            left = first[lo : lo + 128]
            inter = x[left] @ y
            sl, sr = size[left][:, None], size[second][None, :]
            ok = inter >= max(1, min_common)
            if min_ratio > 0:
                ok &= inter.astype(np.float64) / np.minimum(sl, sr) >= min_ratio
            if min_iou > 0:
                ok &= inter.astype(np.float64) / (sl + sr - inter) >= min_iou
            if bound is not None:
                ok &= np.abs(at[left][:, None] - at[second][None, :]) < bound
            if same:
                ok &= n[left][:, None] < n[second][None, :]
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            count, i, j = inter[i, j].astype(np.int64), left[i], second[j]
            if forest:
                kept = []
                labels = np.array([find(q) for q in range(len(n))])
                for e in np.flatnonzero(labels[i] != labels[j]):
                    p, q = find(i[e]), find(j[e])
                    if p != q:
                        root[p] = q
                        kept.append(e)
                count, i, j = count[kept], i[kept], j[kept]
            swap = n[i] > n[j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (n[a], n[b], count, size[a], size[b])], names=["a", "b", "inter", "size_a", "size_b"])

    def run(batches):
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            heads = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
            for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                now = tuple(ids[:, lo].tolist())
                if now != key and held:
                    yield from pairs(pa.Table.from_batches(held).combine_chunks())
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * (blocks + 1) // 2, 4096))
    dealt = met.repartition(tasks, "w", "lo", "hi").sortWithinPartitions("w", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long, inter long, size_a long, size_b long")


def overlap_pairs(sets: DataFrame, node: str, point: str, min_common: int, min_ratio: float) -> DataFrame:
    """Pairs a < b of distinct (node, point) rows with enough points in common. Nodes of fewer points than min_common are left
    out first. Few points that are in nearly all pairs are counted as bits."""
    if few_points(sets, node, point):
        return bit_pairs(sets, node, point, min_common, min_ratio).withColumn("ratio", F.col("inter") / F.least("size_a", "size_b"))
    if min_common > 1:
        sets = sets.join(set_sizes(sets, node, "size").filter(F.col("size") >= min_common).select(node), node, "left_semi")
    left, right = (sets.select(F.col(node).alias(k), point) for k in "ab")
    if sets.schema[point].dataType.simpleString().startswith("struct"):
        left, right = (s.withColumn(point, F.to_json(point)) for s in (left, right))
    both = sized_pairs(left, right, point, "a", "b", ordered=True, least=max(1, min_common), share=min_ratio).withColumnsRenamed({"n_a": "size_a", "n_b": "size_b"})
    return both.withColumn("ratio", F.col("inter") / F.least("size_a", "size_b"))


def nearest_on_axis(left: DataFrame, right: DataFrame, key: str, axis: str, item: str, row: str) -> DataFrame:
    """left with the item of right that is nearest on an axis within a key, the smaller on ties, and ``dist``; nulls where the
    key has none. One sort of both sides: a row's candidates are the last before it and the first after it."""
    best = right.groupBy(key, axis).agg(F.min(item).alias(item))
    both = left.select(key, axis, row, F.lit(None).cast(right.schema[item].dataType).alias(item)).unionByName(best.select(key, axis, F.lit(None).cast(left.schema[row].dataType).alias(row), item))
    told = F.when(F.col(item).isNotNull(), F.struct(axis, item))
    up = Window.partitionBy(key).orderBy(axis).rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.col(axis).desc()).rangeBetween(Window.unboundedPreceding, 0)  # a frame that starts at the row is evaluated anew for each
    seen = both.withColumns({"_lo": F.last(told, True).over(up), "_hi": F.last(told, True).over(down)}).filter(F.col(row).isNotNull())
    near = F.least(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(axis) - F.col(c)[axis]).alias("dist"), F.col(c)[item].alias(item))) for c in ("_lo", "_hi")])
    return seen.withColumn("_m", near).select(row, key, axis, F.col(f"_m.{item}").alias(item), F.col("_m.dist").alias("dist"))


def box_pairs(boxes: DataFrame, key: str, name: str, low: list[str], high: list[str]) -> DataFrame:
    """Pairs (a_..., b_...) of boxes of one name whose first axes touch, a's key below b's. Boxes meet in cells as wide as the widest
    box, of which each lies in two at most; a pair is taken in the first cell that both share."""
    side = boxes.agg(F.max(F.col(high[0]) - F.col(low[0])).alias("m")).first()["m"] or 0.0
    width = max(float(side), 1e-9)
    cells = F.explode(F.sequence(F.floor(F.col(low[0]) / width).cast("long"), F.floor(F.col(high[0]) / width).cast("long")))
    spread = boxes.withColumn("_c", cells).withColumn("_f", F.floor(F.col(low[0]) / width).cast("long"))
    a, b = (spread.select(F.col(name).alias("_n"), "_c", *[F.col(c).alias(f"{s}_{c}") for c in [*boxes.columns, "_f"]]) for s in "ab")
    both = a.join(b, ["_n", "_c"]).filter((F.col(f"a_{key}") < F.col(f"b_{key}")) & (F.col("_c") == F.greatest("a__f", "b__f")))
    return both.filter((F.col(f"a_{low[0]}") <= F.col(f"b_{high[0]}")) & (F.col(f"b_{low[0]}") <= F.col(f"a_{high[0]}"))).drop("_n", "_c", "a__f", "b__f")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in a total order over all, from 1: ranges are numbered on their own, after the counts of
    those before."""
    from .iterative import cut

    parts = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before, base = [], 0
    for r in sorted(parts.groupBy("_p").count().collect(), key=lambda r: r["_p"]):  # a number for each range
        before.append((r["_p"], base))
        base += r["count"]
    bases = df.sparkSession.createDataFrame(before or [(-1, 0)], "_p int, _b long")
    w = Window.partitionBy("_p").orderBy(*order)
    return parts.join(F.broadcast(bases), "_p").withColumn(name, F.row_number().over(w) + F.col("_b")).drop("_p", "_b")


def votes(df: DataFrame, keys: list[str], fg: Column) -> DataFrame:
    """Visible and foreground counts for each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("vis"), F.sum(fg.cast("long")).alias("fg"))


def robust_keep(df: DataFrame, keys: list[str], delta: str, k: float, least: float) -> DataFrame:
    """Rows within max(least, k * 1.4826 * MAD) of their group's median: two medians, joined back."""
    med = df.groupBy(*keys).agg(F.median(delta).alias("med"))
    dev = df.join(med, keys).withColumn("dev", F.abs(F.col(delta) - F.col("med")))
    mad = dev.groupBy(*keys).agg(F.median("dev").alias("mad"))
    out = dev.join(mad, keys).withColumn("tau", F.greatest(F.lit(least), F.lit(k * 1.4826) * F.col("mad")))
    return out.withColumn("keep", F.col("dev") < F.col("tau"))


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other side lacks: ownership, pixel subtraction."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def with_ordinal(df: DataFrame, scene: str, order: list[Column]) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(scene).orderBy(*order)) - 1)


def precision_curve(df: DataFrame, keys: list[str], order: list[Column], hit: Column, total: str) -> DataFrame:
    """Cumulative hits along a ranking, precision, recall and the precision envelope."""
    up = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a frame that starts at the row is evaluated anew for each
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("tp", F.sum(hit.cast("long")).over(up))
    shaped = ranked.withColumn("precision", F.col("tp") / F.col("rank")).withColumn("recall", F.col("tp") / F.greatest(F.col(total), F.lit(1)))
    return shaped.withColumn("envelope", F.max("precision").over(down))


def grid_pairs(points: DataFrame, key: str, axes: list[str], eps: float, within: tuple = ()) -> DataFrame:
    """Pairs a < b closer than eps, of equal `within`: points meet those of the 27 cells around theirs."""
    cell = points.select(key, *axes, *within, *[F.floor(F.col(x) / eps).cast("long").alias(f"c{i}") for i, x in enumerate(axes)])
    step = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    spread = cell
    for i in range(len(axes)):
        spread = spread.withColumn(f"d{i}", F.explode(step)).withColumn(f"c{i}", F.col(f"c{i}") + F.col(f"d{i}")).drop(f"d{i}")
    right = cell.select(F.col(key).alias("b"), *within, *[F.col(x).alias(f"{x}_b") for x in axes], *[f"c{i}" for i in range(len(axes))])
    d2 = sum(((F.col(x) - F.col(f"{x}_b")) ** 2 for x in axes), F.lit(0.0))
    return spread.withColumnRenamed(key, "a").join(right, [*[f"c{i}" for i in range(len(axes))], *within]).filter("a < b").withColumn("d2", d2).filter(F.col("d2") < eps * eps).select("a", "b", "d2")
