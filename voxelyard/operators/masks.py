"""Masks as pixel rows: overlaps within a frame, the choice among overlapping masks, areas, quality, crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelyard.functions.text import DOOR_HANDLE, TURNED_HANDLE

from .relational import nearest


def areas(mask_px: DataFrame, keys: list[str]) -> DataFrame:
    return mask_px.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"))


MASKS = 2048  # masks of a frame that are counted at a time
CELLS = 1 << 22  # cells of a 0/1 matrix of masks and pixels


def overlaps(mask_px: DataFrame, frame: list[str], item: str, pixel: str = "pixel", least: float = 0.0, carry: str | None = None) -> DataFrame:
    """(frame, a, b, inter, area_a, area_b, iou, on_smaller) of masks a < b of one frame that share a pixel, and ``least`` of the
    smaller one. Rows are distinct. A frame's pixels come to one task, which counts pairs as products of 0/1 matrices,
    MASKS by MASKS; only the pairs that are asked for leave it. ``carry``, an int of a mask, is kept as carry_a and carry_b."""
    kinds = {f.name: f.dataType.simpleString() for f in mask_px.schema}

    def pairs(t):
        names, m = np.unique(t.column("i").to_numpy(), return_inverse=True)
        px = pc.dictionary_encode(t.column("p")).combine_chunks().indices.to_numpy(zero_copy_only=False)
        area, told = np.bincount(m, minlength=len(names)), np.zeros(len(names), np.int32)
        told[m] = t.column("c").to_numpy()
        order = np.argsort(px, kind="stable")
        m, px = m[order], px[order]
        for at in range(0, len(names), MASKS):
            n_left = min(MASKS, len(names) - at)
            for to in range(at, len(names), MASKS):
                n_right = min(MASKS, len(names) - to)
                inter = np.zeros((n_left, n_right), np.int32)
                step = min(int(px[-1]) + 1, max(1, CELLS // max(n_left, n_right)))
                for lo in range(0, int(px[-1]) + 1, step):
                    i, j = np.searchsorted(px, [lo, lo + step])
                    x, y = np.zeros((n_left, step), np.float32), np.zeros((n_right, step), np.float32)
                    for z, low, n in ((x, at, n_left), (y, to, n_right)):
                        mine = (m[i:j] >= low) & (m[i:j] < low + n)
                        z[m[i:j][mine] - low, px[i:j][mine] - lo] = 1
                    inter += (x @ y.T).astype(np.int32)
                for lo in range(0, n_left, 256):
                    some = inter[lo : lo + 256]
                    ok = (some > 0) & (some / np.minimum(area[at + lo : at + lo + len(some), None], area[None, to : to + n_right]) >= least)
                    i, j = np.nonzero(ok)
                    up = i + lo + at < j + to
                    i, j = i[up], j[up]
                    a, b = i + lo + at, j + to
                    first = t.slice(0, 1)
                    same = [pa.DictionaryArray.from_arrays(np.zeros(len(a), np.int32), first.column(c).combine_chunks()).cast(first.schema.field(c).type) for c in frame]
                    cols = [*same, *map(pa.array, (names[a], names[b], some[i, j].astype(np.int64), area[a].astype(np.int64), area[b].astype(np.int64), told[a], told[b]))]
                    if len(a):
                        yield pa.RecordBatch.from_arrays(cols, names=out)

    def run(batches):
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            differs = np.zeros(b.num_rows - 1, bool)
            for c in range(len(frame)):
                differs |= pc.not_equal(b.column(c)[1:], b.column(c)[:-1]).to_numpy(zero_copy_only=False)
            heads = [0, *(np.flatnonzero(differs) + 1).tolist(), b.num_rows]
            for lo, hi in zip(heads[:-1], heads[1:], strict=True):
                now = tuple(b.column(c)[lo].as_py() for c in range(len(frame)))
                if held and now != key:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    out = [*frame, "a", "b", "inter", "area_a", "area_b", "carry_a", "carry_b"]
    known = mask_px
    for c in frame:
        known = known.filter(F.col(c).isNotNull())
    known = known.filter(F.col(item).isNotNull() & F.col(pixel).isNotNull())
    dealt = known.select(*frame, F.col(item).alias("i"), F.col(pixel).alias("p"), (F.lit(0) if carry is None else F.col(carry).cast("int")).alias("c")).repartition(*frame).sortWithinPartitions(*frame)
    schema = ", ".join(f"{c} {kinds[c]}" for c in frame) + f", a {kinds[item]}, b {kinds[item]}, inter long, area_a long, area_b long, carry_a int, carry_b int"
    both = dealt.mapInArrow(run, schema)
    both = both.drop("carry_a", "carry_b") if carry is None else both.withColumnsRenamed({"carry_a": f"{carry}_a", "carry_b": f"{carry}_b"})
    return both.withColumns({"iou": F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter")), "on_smaller": F.col("inter") / F.least("area_a", "area_b")})


def first_stays(prompt_a: Column, prompt_b: Column) -> Column:
    """Of two overlapping masks a before b, whether a stays: the smaller one, the first of equal ones; between the
    two prompts of a door handle the plain one stays unless the turned one is smaller."""
    a, b = F.lower(F.coalesce(prompt_a, F.lit(""))), F.lower(F.coalesce(prompt_b, F.lit("")))
    turned_first = (a == TURNED_HANDLE) & (b == DOOR_HANDLE)
    return F.when(turned_first, F.col("area_a") < F.col("area_b")).otherwise(F.col("area_a") <= F.col("area_b"))


def dropped(pairs: DataFrame, frame: list[str], stays: Column) -> DataFrame:
    """(frame, item) that go: pairs (frame, a, b) of too much overlap are taken in the order of a, then b; where both
    are still there, one goes: b if ``stays`` holds, or else a. Only such pairs reach the fold of a frame."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        gone: dict = {}
        for a, b, first in rows.sort_values(["a", "b"])[["a", "b", "first"]].itertuples(index=False):
            if a not in gone and b not in gone:
                gone[b if first else a] = True
        out = pd.DataFrame({"item": list(gone)})
        for c in frame:
            out[c] = rows[c].iloc[0]
        return out[[*frame, "item"]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in frame) + f", item {kinds['a']}"
    return pairs.select(*frame, "a", "b", stays.alias("first")).groupBy(*frame).applyInPandas(fold, schema)


def frame_numbers(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """items with ``number`` from 0 within a frame's tag and class."""
    return items.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def confident(items: DataFrame, least: float) -> DataFrame:
    """Masks scored above ``least``, with a pixel at least."""
    return items.filter((F.col("score") > least) & (F.col("area") > 0))


def best_and_smallest(items: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, best, smallest): the mask of greatest score and that of least area, the first of equal ones."""
    return items.groupBy(*keys).agg(F.max_by(item, F.struct("score", -F.col(item))).alias("best"), F.min_by(item, F.struct("area", item)).alias("smallest"))


def with_anchor(items: DataFrame, frame: list[str], least_anchor: int, least_context: int) -> DataFrame:
    """Anchors of an area, and contexts of an area in frames with such an anchor; nothing else."""
    anchors = items.filter((F.col("role") == "anchor") & (F.col("area") >= max(1, least_anchor)))
    context = items.filter((F.col("role") == "context") & (F.col("area") >= max(1, least_context)))
    return anchors.unionByName(context.join(anchors.select(*frame).distinct(), frame, "left_semi"))


def strict_scores(outputs: DataFrame) -> DataFrame:
    """(key, item, score) of outputs (key, n_masks, scores): a score for each mask; missing or too few scores are an
    error, further ones are left out."""
    bad = (F.col("n_masks") > 0) & (F.col("scores").isNull() | (F.size("scores") < F.col("n_masks")))
    told = F.when(bad, F.raise_error(F.lit("a model's output lacks scores")).cast("array<double>")).otherwise(F.slice("scores", F.lit(1), F.greatest(F.col("n_masks"), F.lit(0)).cast("int")))
    return outputs.select("key", F.posexplode(told).alias("item", "score"))


def quality(px: DataFrame, keys: list[str], pixels: int) -> DataFrame:
    """(keys, n, coverage, cx, cy, sx, sy, compactness, colours) of pixel rows (u, v, colour): shares of the image,
    centre, spread (population), pixels by spread and distinct colours."""
    spread = lambda c: F.coalesce(F.stddev_pop(c), F.lit(0.0))
    out = px.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("cx"), F.avg("v").alias("cy"), spread("u").alias("sx"), spread("v").alias("sy"), F.count_distinct("colour").alias("colours"))
    return out.withColumns({"coverage": F.col("n") / pixels, "compactness": F.col("n") / F.greatest(F.lit(1.0), F.col("sx") + F.col("sy"))})


def density(px: DataFrame, keys: list[str], most: int = 1000, least: int = 100) -> DataFrame:
    """(keys, density): 1 over the mean distance of the pixels of a sample, at least 1; 0 for ``least`` pixels or fewer.
    The sample is the ``most`` first pixels by hash, so it is the same in every run."""
    n = areas(px, keys)
    w = Window.partitionBy(*keys).orderBy(F.xxhash64("u", "v"), "u", "v")
    some = px.select(*keys, "u", "v").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    other = some.select(*keys, F.col("u").alias("u2"), F.col("v").alias("v2"), F.col("_r").alias("r2"))
    far = some.join(other, keys).filter("_r < r2").groupBy(*keys).agg(F.avg(F.sqrt((F.col("u") - F.col("u2")) ** 2 + (F.col("v") - F.col("v2")) ** 2)).alias("far"))
    return n.join(far, keys, "left").select(*keys, F.when((F.col("area") > least) & F.col("far").isNotNull(), 1 / F.greatest("far", F.lit(1.0))).otherwise(0.0).alias("density"))


def diagnosis(stats: DataFrame) -> Column:
    """What is wrong with a frame, as an array of words, from mask_coverage, shown_coverage, iou, precision, recall and
    true_iou; nulls say nothing."""
    c = F.col
    told = {
        "mask empty": c("mask_coverage") < 0.001, "mask too large": c("mask_coverage") > 0.5, "projection sparse": c("shown_coverage") < 0.01, "projection dense": c("shown_coverage") > 0.3,
        "overlap low": c("iou") < 0.1, "projection displaced": (c("iou") < 0.1) & (c("precision") < 0.3), "projection incomplete": (c("iou") < 0.1) & (c("recall") < 0.3),
        "truth fits better": c("true_iou") > c("iou") * 1.5, "prediction fits better": (c("true_iou") <= c("iou") * 1.5) & (c("iou") > c("true_iou") * 1.5),
    }
    return F.array_compact(F.array(*[F.when(when, F.lit(what)) for what, when in told.items()]))


def crops(image_px: DataFrame, mask_px: DataFrame, keys: list[str], item: str, boxed: bool = False) -> DataFrame:
    """(keys, item, u, v, colour) of the image under each mask, all else being black and left out; ``boxed``
    moves a mask's least u and v to 0."""
    px = mask_px.join(image_px, [*keys, "u", "v"])
    if boxed:
        px = px.join(mask_px.groupBy(*keys, item).agg(F.min("u").alias("_u"), F.min("v").alias("_v")), [*keys, item])
        px = px.withColumns({"u": F.col("u") - F.col("_u"), "v": F.col("v") - F.col("_v")}).drop("_u", "_v")
    return px.select(*keys, item, "u", "v", "colour")


def self_coverage(observed: DataFrame, expected: DataFrame, keys: list[str], w: int, h: int, grown: bool = True) -> DataFrame:
    """(keys, n_observed, n_expected, n_both, coverage): the share of observed pixels that are expected, too; expected
    pixels grow by one in each direction first, within the image."""
    if grown:
        step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        near = expected.withColumn("_s", F.explode(step)).withColumn("u", F.col("u") + F.col("_s")).withColumn("_t", F.explode(step))
        expected = near.withColumn("v", F.col("v") + F.col("_t")).filter((F.col("u") >= 0) & (F.col("u") < w) & (F.col("v") >= 0) & (F.col("v") < h))
    o, e = observed.select(*keys, "u", "v").distinct().withColumn("o", F.lit(1)), expected.select(*keys, "u", "v").distinct().withColumn("e", F.lit(1))
    out = o.join(e, [*keys, "u", "v"], "full").groupBy(*keys).agg(F.count("o").alias("n_observed"), F.count("e").alias("n_expected"), F.sum(F.when(F.col("o").isNotNull() & F.col("e").isNotNull(), 1).otherwise(0)).alias("n_both"))
    return out.withColumn("coverage", F.col("n_both") / F.greatest("n_observed", F.lit(1)))


def best_of_runs(found: DataFrame, key: str) -> DataFrame:
    """The best mask of each annotation over prompts, masks and frames; the first run, frame and mask of equal scores."""
    return nearest(found, [key], [F.col("score").desc(), F.col("run").asc(), F.col("frame").asc(), F.col("item").asc()])
