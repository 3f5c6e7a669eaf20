"""From points and frames to the points a mask keeps: projection, the nearest point of a pixel, depth, masks,
votes. Frames (scene, frame, w, h, fx, fy, cx, cy, t0 to t11: world to camera, row by row) are few next to
points; their number is checked before they are sent to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelyard.functions import geometry as G

from .relational import nearest

FRAMES_SENT = 100_000  # frames of 20 numbers: some 16 MB; more are joined by scene
MATRIX = [f"t{i}" for i in range(12)]
CAMERA = ["w", "h", "fx", "fy", "cx", "cy"]


def posed(frames: DataFrame, *names: str) -> DataFrame:
    """frames without those whose transform is not close to a rigid one."""
    from voxelyard.functions.boxes import is_rotation

    r = [F.col(MATRIX[4 * i + j]) for i in range(3) for j in range(3)]
    return frames.filter(is_rotation(r, *names))


def projected(points: DataFrame, frames: DataFrame) -> DataFrame:
    """(scene, frame, pixel, point_idx, x, y, z, depth): points that lie in a frame's image, each with its pixel
    v * w + u and its depth in single precision. Points that are not finite or lie behind are left out."""
    few = frames.select("scene", "frame", *CAMERA, *MATRIX)
    if few.count() <= FRAMES_SENT:
        few = F.broadcast(few)
    both = points.join(few, "scene")
    t = [F.col(c) for c in MATRIX]
    cam = [t[4 * i] * F.col("x") + t[4 * i + 1] * F.col("y") + t[4 * i + 2] * F.col("z") + t[4 * i + 3] for i in range(3)]
    both = both.withColumns({"_x": cam[0], "_y": cam[1], "_z": cam[2]})
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    both = both.filter(finite(F.col("_x")) & finite(F.col("_y")) & finite(F.col("_z")) & (F.col("_z") > 0))
    u, v = G.project(F.col("_x"), F.col("_y"), F.col("_z"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    both = both.withColumns({"_u": u, "_v": v}).filter(G.inside(F.col("_u"), F.col("_v"), F.col("_z"), F.col("w"), F.col("h")))
    depth = F.greatest(F.col("_z").cast("float"), F.lit(1e-6).cast("float"))
    return both.select("scene", "frame", (F.col("_v") * F.col("w") + F.col("_u")).cast("long").alias("pixel"), "point_idx", "x", "y", "z", depth.alias("depth"))


def visible(points: DataFrame, frames: DataFrame, cap: float = 0.0) -> DataFrame:
    """projected(), the nearest point of each pixel only, the first of equal ones. With ``cap`` a frame keeps one
    point of each voxel of that side, the first by pixel."""
    seen = nearest(projected(points, frames), ["scene", "frame", "pixel"], [F.col("depth").asc(), F.col("point_idx").asc()])
    if cap > 0:
        i, j, k = G.voxel(*[(F.col(c), cap) for c in "xyz"])
        seen = nearest(seen.withColumns({"_i": i, "_j": j, "_k": k}), ["scene", "frame", "_i", "_j", "_k"], [F.col("pixel").asc()]).drop("_i", "_j", "_k")
    return seen


def with_depth(seen: DataFrame, depth_px: DataFrame, scale: float = 1000.0) -> DataFrame:
    """seen with the image's depth at its pixel, in the points' unit; null where there is none."""
    raw = depth_px.select("scene", "frame", "pixel", (F.col("raw").cast("float") / F.lit(scale).cast("float")).cast("float").alias("seen_depth"))
    out = seen.join(raw, ["scene", "frame", "pixel"], "left")
    return out.withColumn("seen_depth", F.when((F.col("seen_depth") > 0) & (F.col("seen_depth") < float("inf")), F.col("seen_depth")))


def depth_kept(seen: DataFrame, k: float = 3.0, least: float = 0.05, front: float = 0.10) -> DataFrame:
    """with_depth() rows with ``keep``: the difference of depths lies within max(least, k * 1.4826 * MAD) of the
    frame's median, and no further in front than ``front``, unless that is 0. Rows without a depth are not kept."""
    keys = ["scene", "frame"]
    d = seen.withColumn("delta", (F.col("depth") - F.col("seen_depth")).cast("double"))
    med = d.groupBy(*keys).agg(F.median("delta").alias("med"))
    d = d.join(med, keys).withColumn("dev", F.abs(F.col("delta") - F.col("med")))
    mad = d.groupBy(*keys).agg(F.greatest(F.lit(least), F.coalesce(F.median("dev"), F.lit(0.0)) * (k * 1.4826)).alias("tau"))
    d = d.join(mad, keys)
    ok = F.col("dev") < F.col("tau")
    if front > 0:
        ok = ok & (F.col("depth") < F.col("seen_depth") + F.lit(front).cast("float"))
    return d.withColumn("keep", F.coalesce(ok, F.lit(False)))


def mask_votes(kept: DataFrame, mask_px: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, point_idx, vis, fg): of each group's masks (scene, frame, obs, pixel, groups) those that show a
    point with a depth, and those where its depth agrees."""
    hit = kept.join(mask_px, ["scene", "frame", "pixel"]).filter("seen_depth is not null")
    return hit.groupBy(*groups, "point_idx").agg(F.count(F.lit(1)).alias("vis"), F.count_if("keep").alias("fg"))


def vote_filter(votes: DataFrame, observations: DataFrame, groups: list[str], rules: dict[str, dict], kind: str = "type") -> DataFrame:
    """Votes that meet the rule of their type: vis of min_vis and of min_vis_frac of the group's masks at least, fg of
    min_fg, and Wilson's bound of wilson_p0 (where use_wilson is set), or fg / vis of min_fg_ratio. Rules are
    {type: {...}}; what a type leaves out, or sets below 0, is as in the rule of ``""``."""
    base = {"min_vis": 1, "min_vis_frac": 0.0, "min_fg": 0, "min_fg_ratio": 0.0, "use_wilson": False, "wilson_p0": 0.0, "wilson_z": 1.96} | rules.get("", {})

    def pick(name: str) -> Column:
        out = F.lit(base[name])
        for t, rule in rules.items():
            value = rule.get(name, -1)
            if t and (value is True or value is False or value >= 0):
                out = F.when(F.col(kind) == t, F.lit(value)).otherwise(out)
        return out

    v = votes.join(observations.select(*groups, F.greatest(F.col("n_obs"), F.lit(1)).alias("n_obs")), groups)
    enough = (F.col("vis") >= F.greatest(pick("min_vis").cast("double"), F.ceil(pick("min_vis_frac") * F.col("n_obs")).cast("double"))) & (F.col("fg") >= pick("min_fg"))
    zs = {r.get("wilson_z", base["wilson_z"]) for r in rules.values()} | {base["wilson_z"]}
    bound = F.lit(None).cast("double")
    for z in zs:
        bound = F.when(pick("wilson_z") == z, G.wilson_lower(F.col("fg"), F.col("vis"), z)).otherwise(bound)
    sure = F.when(pick("use_wilson"), bound >= pick("wilson_p0")).otherwise(F.col("fg") / F.col("vis") >= pick("min_fg_ratio"))
    return v.filter(enough & sure)


def lifted(mask_px: DataFrame, depth_px: DataFrame, frames: DataFrame, keys: list[str], scale: float = 1000.0, k: float = 3.0, least: float = 0.03, robust: bool = True, stride: int = 1) -> DataFrame:
    """(scene, frame, keys, pixel, x, y, z) in camera axes of masks' pixels with a depth; those within
    max(least, k * 1.4826 * MAD) of their mask's median depth, if ``robust``. Every stride-th row and
    column only."""
    z = (F.col("raw").cast("float") / F.lit(scale).cast("float")).cast("float")
    px = mask_px.join(depth_px.select("scene", "frame", "pixel", z.alias("z")), ["scene", "frame", "pixel"]).filter((F.col("z") > 0) & (F.col("z") < float("inf")))
    px = px.join(F.broadcast(frames.select("scene", "frame", *CAMERA)) if frames.count() <= FRAMES_SENT else frames.select("scene", "frame", *CAMERA), ["scene", "frame"])
    px = px.withColumns({"_u": F.col("pixel") % F.col("w"), "_v": F.floor(F.col("pixel") / F.col("w"))})
    if stride > 1:
        px = px.filter((F.col("_u") % stride == 0) & (F.col("_v") % stride == 0))
    if robust:
        group = ["scene", "frame", *keys]
        px = px.withColumn("_d", F.col("z").cast("double"))
        px = px.join(px.groupBy(*group).agg(F.median("_d").alias("_m")), group).withColumn("_e", F.abs(F.col("_d") - F.col("_m")))
        px = px.join(px.groupBy(*group).agg(F.greatest(F.lit(least), F.median("_e") * (k * 1.4826)).alias("_t")), group).filter(F.col("_e") <= F.col("_t"))
    x, y, d = G.back_project(F.col("_u"), F.col("_v"), F.col("z").cast("double"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    return px.select("scene", "frame", *keys, "pixel", x.alias("x"), y.alias("y"), d.alias("z"))


def associate(pool: DataFrame, frames: DataFrame, depth_px: DataFrame, mask_px: DataFrame, near: float, hidden: float, far: float) -> DataFrame:
    """(scene, frame, point_idx, said): what a frame says about each point of a pool. ``support`` if the point falls
    in the mask at the seen depth (closer than ``near``), ``reject`` if it is visible otherwise; ``skip`` if it lies
    behind, out of the image or beyond ``far``, has no depth there, or something more than ``hidden`` stands before it."""
    both = pool.join(F.broadcast(frames.select("scene", "frame")) if frames.count() <= FRAMES_SENT else frames.select("scene", "frame"), "scene").select("scene", "frame", "point_idx")
    seen = projected(pool, frames).filter(F.col("depth") < far).select("scene", "frame", "pixel", "point_idx", "depth")
    raw = depth_px.select("scene", "frame", "pixel", (F.col("raw").cast("float") / F.lit(1000.0).cast("float")).cast("float").alias("d"))
    seen = seen.join(raw, ["scene", "frame", "pixel"], "left").join(mask_px.select("scene", "frame", "pixel").distinct().withColumn("hit", F.lit(True)), ["scene", "frame", "pixel"], "left")
    d, z = F.col("d").cast("double"), F.col("depth").cast("double")
    said = F.when(F.col("d").isNull() | (d <= 0) | (d >= far) | (d < z - hidden), "skip").when(F.coalesce("hit", F.lit(False)) & (F.abs(d - z) < near), "support").otherwise("reject")
    told = seen.select("scene", "frame", "point_idx", said.alias("said"))
    return both.join(told, ["scene", "frame", "point_idx"], "left").withColumn("said", F.coalesce("said", F.lit("skip")))


def projection_score(points: DataFrame, frames: DataFrame) -> DataFrame:
    """(scene, frame, in_front, in_image, score): shares of a scene's points before the camera and in the image, and
    0.7 of the one and 0.3 of the other: which of some poses is right."""
    few = frames.select("scene", "frame", *CAMERA, *MATRIX)
    both = points.join(F.broadcast(few) if few.count() <= FRAMES_SENT else few, "scene")
    t = [F.col(c) for c in MATRIX]
    cam = [t[4 * i] * F.col("x") + t[4 * i + 1] * F.col("y") + t[4 * i + 2] * F.col("z") + t[4 * i + 3] for i in range(3)]
    both = both.select("scene", "frame", *CAMERA, *[c.alias(n) for c, n in zip(cam, ("_x", "_y", "_z"), strict=True)])
    front = F.col("_z") > 1e-6
    z = F.when(front, F.col("_z"))
    u, v = F.col("_x") * F.col("fx") / z + F.col("cx"), F.col("_y") * F.col("fy") / z + F.col("cy")
    shown = F.coalesce(front & (u >= 0) & (u < F.col("w")) & (v >= 0) & (v < F.col("h")), F.lit(False))
    out = both.groupBy("scene", "frame").agg(F.avg(front.cast("double")).alias("in_front"), F.avg(shown.cast("double")).alias("in_image"))
    return out.withColumn("score", F.col("in_front") * 0.7 + F.col("in_image") * 0.3)
