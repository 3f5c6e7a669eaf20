"""Images as pixel rows (image, u, v, ...): gradients, boundaries, superpixels and their connected regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterative import cut

LAB = ["l", "a", "b"]


def _row(image: str):
    return Window.partitionBy(image, "v").orderBy("u"), Window.partitionBy(image, "u").orderBy("v")


def gradient(px: DataFrame, image: str, channels: list[str]) -> DataFrame:
    """px with ``gradient``: squared central differences of both directions; 0 along a border."""
    across, down = _row(image)
    total = F.lit(0.0)
    for w in (across, down):
        diff = sum(((F.lead(c).over(w) - F.lag(c).over(w)) ** 2 for c in channels), F.lit(0.0))
        total = total + F.coalesce(diff, F.lit(0.0))
    return px.withColumn("gradient", total)


def boundaries(px: DataFrame, image: str, label: str) -> DataFrame:
    """px with ``edge``: whether a neighbour on either side has another label."""
    across, down = _row(image)
    other = [F.coalesce(side(label).over(w) != F.col(label), F.lit(False)) for w in (across, down) for side in (F.lag, F.lead)]
    return px.withColumn("edge", other[0] | other[1] | other[2] | other[3])


def centroids(px: DataFrame, image: str, label: str) -> DataFrame:
    return px.groupBy(image, label).agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))


def dense_labels(px: DataFrame, image: str, label: str) -> DataFrame:
    """px with its labels as 0, 1, 2 and so on in their order within an image. Labels are ranked, not pixels."""
    ranked = px.select(image, label).distinct().withColumn("_d", F.row_number().over(Window.partitionBy(image).orderBy(label)) - 1)
    return px.join(ranked, [image, label]).drop(label).withColumnRenamed("_d", label)


def superpixels(px: DataFrame, image: str, wanted: int, compactness: float, rounds: int) -> DataFrame:
    """px (image, u, v, l, a, b) with ``label``: centres start on a grid, moved to the least gradient around; in each round a
    pixel takes the nearest centre (colour and place, the first on ties) of those within twice the step, and centres
    become means. Centres meet pixels by cells of twice the step, so a pixel is compared with a few."""
    base = cut(gradient(px, image, LAB))
    size = base.groupBy(image).agg((F.max("u") + 1).alias("w"), (F.max("v") + 1).alias("h"))
    size = cut(size.withColumn("step", F.sqrt(F.col("w") * F.col("h") / F.lit(max(1, wanted)))))
    whole, half = F.floor("step").cast("int"), F.floor(F.col("step") / 2).cast("int")
    grid = size.withColumn("y", F.explode(F.when(half < F.col("h"), F.sequence(half, (F.col("h") - 1).cast("int"), whole)))).withColumn("x", F.explode(F.when(half < F.col("w"), F.sequence(half, (F.col("w") - 1).cast("int"), whole))))
    grid = grid.withColumn("label", F.row_number().over(Window.partitionBy(image).orderBy("y", "x")) - 1)
    step3 = F.explode(F.array(*[F.struct(F.lit(i).alias("dv"), F.lit(j).alias("du")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = grid.withColumn("d", step3).select(image, "label", (F.col("x") + F.col("d.du")).alias("u"), (F.col("y") + F.col("d.dv")).alias("v"), ((F.col("d.du") == 0) & (F.col("d.dv") == 0)).alias("own"))
    best = F.struct("gradient", (~F.col("own")).alias("moved"), "v", "u", *LAB)
    centres = around.join(base, [image, "u", "v"]).groupBy(image, "label").agg(F.min(best).alias("m"))
    centres = cut(centres.select(image, "label", *[F.col(f"m.{c}").cast("double").alias(f"c{c}") for c in ("u", "v", *LAB)]))
    reach = F.col("step") * 2
    pixels = cut(px.join(size, image).withColumns({"cu": F.floor(F.col("u") / reach), "cv": F.floor(F.col("v") / reach)}))
    labels = None
    for _ in range(rounds):
        placed = centres.join(size, image).withColumns({"x0": F.greatest((F.col("cu") - reach).cast("int"), F.lit(0)), "x1": F.least((F.col("cu") + reach + 1).cast("int"), "w"), "y0": F.greatest((F.col("cv") - reach).cast("int"), F.lit(0)), "y1": F.least((F.col("cv") + reach + 1).cast("int"), "h")})
        cells = placed.withColumn("gu", F.explode(F.sequence(F.floor(F.col("x0") / reach), F.floor((F.col("x1") - 1) / reach)))).withColumn("gv", F.explode(F.sequence(F.floor(F.col("y0") / reach), F.floor((F.col("y1") - 1) / reach))))
        cells = cells.select(image, "label", F.col("gu").alias("g1"), F.col("gv").alias("g2"), "x0", "x1", "y0", "y1", *[F.col(f"c{c}").alias(f"k{c}") for c in ("u", "v", *LAB)])
        near = pixels.join(cells, (pixels[image] == cells[image]) & (F.col("cu") == F.col("g1")) & (F.col("cv") == F.col("g2"))).drop(cells[image]).filter("u >= x0 and u < x1 and v >= y0 and v < y1")
        colour = sum(((F.col(c) - F.col(f"k{c}")) ** 2 for c in LAB), F.lit(0.0))
        place = (F.col("u") - F.col("ku")) ** 2 + (F.col("v") - F.col("kv")) ** 2
        far = F.sqrt(colour + place * F.pow(F.lit(compactness) / F.col("step"), F.lit(2)))
        new = near.groupBy(image, "u", "v").agg(F.min(F.struct(far.alias("far"), "label")).alias("m")).select(image, "u", "v", F.col("m.label").alias("label"))
        if labels is not None:  # a pixel that no centre reaches keeps its label
            new = labels.withColumnRenamed("label", "was").join(new, [image, "u", "v"], "left").select(image, "u", "v", F.coalesce("label", "was").alias("label"))
        else:
            new = px.select(image, "u", "v").join(new, [image, "u", "v"], "left").select(image, "u", "v", F.coalesce("label", F.lit(-1)).alias("label"))
        labels = cut(new)
        means = labels.join(px, [image, "u", "v"]).groupBy(image, "label").agg(*[F.avg(c).alias(f"n{c}") for c in ("u", "v", *LAB)])
        centres = cut(centres.join(means, [image, "label"], "left").select(image, "label", *[F.coalesce(f"n{c}", f"c{c}").alias(f"c{c}") for c in ("u", "v", *LAB)]))
    return labels


def connected(px: DataFrame, image: str, label: str, least: int) -> DataFrame:
    """(image, u, v, region): regions of equal labels that touch, numbered in the order of their first pixel; one of fewer than
    ``least`` pixels joins the region that touches it most often among those numbered before, if any. An image is
    one task's: the order of its regions decides."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        w, h = int(rows["u"].max()) + 1, int(rows["v"].max()) + 1
        grid = np.full((h, w), np.iinfo(np.int64).min)
        grid[rows["v"], rows["u"]] = rows[label]
        out, seen, n = np.full((h, w), -1), np.zeros((h, w), bool), 0
        for y0, x0 in zip(*np.nonzero(np.ones((h, w), bool)), strict=True):
            if seen[y0, x0]:
                continue
            seen[y0, x0] = True
            part, todo, beside = [], [(int(y0), int(x0))], {}
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for i, j in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= i < h and 0 <= j < w:
                        if out[i, j] >= 0:
                            beside[out[i, j]] = beside.get(out[i, j], 0) + 1
                        if not seen[i, j] and grid[i, j] == grid[y0, x0]:
                            seen[i, j] = True
                            todo.append((i, j))
            if len(part) < least and beside:
                mine = min(beside, key=lambda r: (-beside[r], r))
            else:
                mine, n = n, n + 1
            at = np.array(part)
            out[at[:, 0], at[:, 1]] = mine
        return pd.DataFrame({image: rows[image], "u": rows["u"], "v": rows["v"], "region": out[rows["v"], rows["u"]]})

    kinds = {f.name: f.dataType.simpleString() for f in px.schema}
    return px.select(image, "u", "v", label).groupBy(image).applyInPandas(fold, f"{image} {kinds[image]}, u {kinds['u']}, v {kinds['v']}, region int")
