"""Projection, depth and masks over the driver's tables: embeddings are points, nations frames, lineitem the
pixels of masks and depth images."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelyard.operators import frames as P

from .scene_queries import query, read, six

W, H, FOCAL = 64, 48, 60.0
FAR, NEAR, HIDDEN = 2.4, 0.25, 0.3

_POINTS = "p AS (SELECT 1 AS scene, vec_id AS point_idx, embedding[1]::DOUBLE * 2 AS x, embedding[2]::DOUBLE * 2 AS y, embedding[3]::DOUBLE + 1.2 AS z FROM embeddings)"
_FRAMES = "f AS (SELECT 1 AS scene, n_nationkey AS frame, (n_nationkey % 5 - 2) * 0.25 AS dx, (n_nationkey // 5) * 0.1 AS dz FROM nation)"
_DEPTH = f"d AS (SELECT 1 AS scene, l_suppkey % 25 AS frame, (l_partkey * 13 + l_linenumber) % {W * H} AS pixel, max(CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity * 50 END) AS raw FROM lineitem GROUP BY 2, 3)"
_MASKS = f"m AS (SELECT DISTINCT 1 AS scene, l_suppkey % 25 AS frame, l_suppkey AS obs, (l_partkey * 7) % {W * H} AS pixel, CASE WHEN l_suppkey % 3 = 0 THEN 'affordance' ELSE 'object' END AS type, 'n' || (l_suppkey % 4)::VARCHAR AS name FROM lineitem)"
_CAM = f"""c AS (SELECT p.scene, frame, point_idx, x, y, z, (x + dx)::DOUBLE AS cx, y AS cy, (z + dz)::DOUBLE AS cz FROM p JOIN f ON p.scene = f.scene),
q AS (SELECT *, greatest(cz::FLOAT::DOUBLE, 1e-6) AS dz1 FROM c WHERE cz > 0),
u AS (SELECT *, round_even(cx * {FOCAL} / dz1 + {W // 2}, 0) AS u, round_even(cy * {FOCAL} / dz1 + {H // 2}, 0) AS v FROM q),
pr AS (SELECT scene, frame, (v * {W} + u)::BIGINT AS pixel, point_idx, cz::FLOAT AS depth FROM u WHERE u >= 0 AND u < {W} AND v >= 0 AND v < {H})"""
_SEEN = """s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene, frame, pixel ORDER BY depth, point_idx) AS r FROM pr) WHERE r = 1),
sd AS (SELECT s.scene, s.frame, s.pixel, point_idx, depth, CASE WHEN raw > 0 THEN (raw::FLOAT / 1000::FLOAT)::FLOAT END AS seen_depth FROM s LEFT JOIN d ON s.scene = d.scene AND s.frame = d.frame AND s.pixel = d.pixel)"""
_KEPT = """de AS (SELECT *, (depth - seen_depth)::DOUBLE AS delta FROM sd), me AS (SELECT scene, frame, median(delta) AS med FROM de GROUP BY 1, 2),
dv AS (SELECT de.*, med, abs(delta - med) AS dev FROM de JOIN me USING (scene, frame)), ta AS (SELECT scene, frame, greatest(0.05, coalesce(median(dev), 0) * (3.0 * 1.4826)) AS tau FROM dv GROUP BY 1, 2),
k AS (SELECT dv.*, tau, coalesce(dev < tau AND depth < seen_depth + 0.1::FLOAT, FALSE) AS keep FROM dv JOIN ta USING (scene, frame))"""


def _points(spark, d):
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    return read(spark, d, "embeddings").select(F.lit(1).alias("scene"), F.col("vec_id").alias("point_idx"), (e[0] * 2).alias("x"), (e[1] * 2).alias("y"), (e[2] + 1.2).alias("z"))


def _frames(spark, d):
    n = F.col("n_nationkey")
    shift = {3: (n % 5 - 2) * 0.25, 11: F.floor(n / 5) * 0.1}
    camera = {"w": F.lit(W), "h": F.lit(H), "fx": F.lit(FOCAL), "fy": F.lit(FOCAL), "cx": F.lit(float(W // 2)), "cy": F.lit(float(H // 2))}
    matrix = {c: shift.get(i, F.lit(1.0 if i in (0, 5, 10) else 0.0)) for i, c in enumerate(P.MATRIX)}
    return read(spark, d, "nation").select(F.lit(1).alias("scene"), n.alias("frame"), *[c.alias(name) for name, c in (camera | matrix).items()])


def _depth(spark, d):
    li = read(spark, d, "lineitem").select(F.lit(1).alias("scene"), (F.col("l_suppkey") % 25).alias("frame"), ((F.col("l_partkey") * 13 + F.col("l_linenumber")) % (W * H)).alias("pixel"), F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_quantity") * 50).alias("raw"))
    return li.groupBy("scene", "frame", "pixel").agg(F.max("raw").alias("raw"))


def _masks(spark, d):
    obs = F.col("l_suppkey")
    kind = F.when(obs % 3 == 0, "affordance").otherwise("object")
    return read(spark, d, "lineitem").select(F.lit(1).alias("scene"), (obs % 25).alias("frame"), obs.alias("obs"), ((F.col("l_partkey") * 7) % (W * H)).alias("pixel"), kind.alias("type"), F.concat(F.lit("n"), (obs % 4).cast("string")).alias("name")).distinct()


def _kept(spark, d):
    return P.depth_kept(P.with_depth(P.visible(_points(spark, d), _frames(spark, d)), _depth(spark, d)))


@query(f"WITH {_POINTS}, {_FRAMES}, {_DEPTH}, {_CAM}, {_SEEN} SELECT frame::BIGINT AS frame, pixel, point_idx, round(depth::DOUBLE, 6) AS depth, round(seen_depth::DOUBLE, 6) AS seen_depth FROM sd")
def visible_points(spark, d):
    seen = P.with_depth(P.visible(_points(spark, d), P.posed(_frames(spark, d))), _depth(spark, d))
    return seen.select(F.col("frame").cast("long").alias("frame"), "pixel", "point_idx", six(F.col("depth").cast("double"), "depth"), six(F.col("seen_depth").cast("double"), "seen_depth"))


@query(f"WITH {_POINTS}, {_FRAMES}, {_DEPTH}, {_CAM}, {_SEEN}, {_KEPT} SELECT frame::BIGINT AS frame, count(*) AS n, count(seen_depth) AS n_depth, count(*) FILTER (WHERE keep) AS kept, round(any_value(med), 5) AS med, round(any_value(tau), 5) AS tau FROM k GROUP BY 1")
def depth_consistency(spark, d):
    return _kept(spark, d).groupBy(F.col("frame").cast("long").alias("frame")).agg(F.count(F.lit(1)).alias("n"), F.count("seen_depth").alias("n_depth"), F.count_if("keep").alias("kept"), F.round(F.first("med", True), 5).alias("med"), F.round(F.first("tau"), 5).alias("tau"))


RULES = {"": {"min_vis": 1, "min_vis_frac": 0.08, "min_fg_ratio": 0.2}, "affordance": {"min_fg": 1, "use_wilson": True, "wilson_p0": 0.05, "min_vis_frac": 0.05, "min_fg_ratio": -1}}
_WILSON = "((fg / vis) + 3.8416 / (2 * vis) - 1.96 * sqrt((fg / vis) * (1 - fg / vis) / vis + 3.8416 / (4 * vis * vis))) / (1 + 3.8416 / vis)"


@query(f"""WITH {_POINTS}, {_FRAMES}, {_DEPTH}, {_MASKS}, {_CAM}, {_SEEN}, {_KEPT},
vo AS (SELECT type, name, point_idx, count(*) AS vis, count(*) FILTER (WHERE keep) AS fg FROM k JOIN m USING (scene, frame, pixel) WHERE seen_depth IS NOT NULL GROUP BY 1, 2, 3),
ob AS (SELECT type, name, greatest(count(DISTINCT obs), 1) AS n_obs FROM m GROUP BY 1, 2)
SELECT type, name, point_idx, vis, fg FROM vo JOIN ob USING (type, name) WHERE CASE WHEN type = 'affordance' THEN vis >= greatest(1, ceil(0.05 * n_obs)) AND fg >= 1 AND greatest({_WILSON}, 0) >= 0.05
  ELSE vis >= greatest(1, ceil(0.08 * n_obs)) AND fg / vis >= 0.2 END""")
def kept_points(spark, d):
    masks = _masks(spark, d)
    votes = P.mask_votes(_kept(spark, d), masks, ["type", "name"])
    observations = masks.groupBy("type", "name").agg(F.count_distinct("obs").alias("n_obs"))
    return P.vote_filter(votes, observations, ["type", "name"], RULES).select("type", "name", "point_idx", "vis", "fg")


@query(f"""WITH {_DEPTH}, {_MASKS}, px AS (SELECT obs, frame, pixel, (raw::FLOAT / 1000::FLOAT)::FLOAT::DOUBLE AS z FROM m JOIN d USING (scene, frame, pixel) WHERE raw > 0),
me AS (SELECT obs, median(z) AS med FROM px GROUP BY 1), dv AS (SELECT px.*, abs(z - med) AS dev FROM px JOIN me USING (obs)), ta AS (SELECT obs, greatest(0.03, median(dev) * (0.5 * 1.4826)) AS tau FROM dv GROUP BY 1),
k AS (SELECT obs, (pixel % {W} - {W // 2}) * z / {FOCAL} AS x, (pixel // {W} - {H // 2}) * z / {FOCAL} AS y, z FROM dv JOIN ta USING (obs) WHERE dev <= tau)
SELECT obs, count(*) AS n, count(DISTINCT (floor(x / 0.25), floor(y / 0.25), floor(z / 0.25))) AS voxels, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(z), 5) AS z FROM k GROUP BY 1""")
def lifted_masks(spark, d):
    from voxelyard.functions import geometry as G

    px = P.lifted(_masks(spark, d), _depth(spark, d), _frames(spark, d), ["obs"], k=0.5)
    cell = F.struct(*[c.alias(n) for n, c in zip("ijk", G.voxel(*[(F.col(c), 0.25) for c in "xyz"]), strict=True)])
    return px.groupBy("obs").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(cell).alias("voxels"), *[F.round(F.avg(c), 5).alias(c) for c in "xyz"])


@query(f"""WITH {_POINTS}, {_FRAMES}, {_DEPTH}, {_MASKS}, {_CAM}, ma AS (SELECT DISTINCT scene, frame, pixel, TRUE AS hit FROM m WHERE type = 'affordance'),
s AS (SELECT pr.*, (raw::FLOAT / 1000::FLOAT)::FLOAT::DOUBLE AS dd, depth::DOUBLE AS dz, coalesce(hit, FALSE) AS hit FROM pr LEFT JOIN d USING (scene, frame, pixel) LEFT JOIN ma USING (scene, frame, pixel) WHERE depth < {FAR}),
t AS (SELECT scene, frame, point_idx, CASE WHEN dd IS NULL OR dd <= 0 OR dd >= {FAR} OR dd < dz - {HIDDEN} THEN 'skip' WHEN hit AND abs(dd - dz) < {NEAR} THEN 'support' ELSE 'reject' END AS said FROM s)
SELECT p.point_idx, count(*) FILTER (WHERE said = 'support') AS support, count(*) FILTER (WHERE said = 'reject') AS reject, count(*) FILTER (WHERE coalesce(said, 'skip') = 'skip') AS skip FROM p JOIN f ON p.scene = f.scene LEFT JOIN t ON t.frame = f.frame AND t.point_idx = p.point_idx GROUP BY 1""")
def pool_association(spark, d):
    said = P.associate(_points(spark, d), _frames(spark, d), _depth(spark, d), _masks(spark, d).filter("type = 'affordance'"), NEAR, HIDDEN, FAR)
    return said.groupBy("point_idx").agg(*[F.count_if(F.col("said") == x).alias(x) for x in ("support", "reject", "skip")])


@query(f"""WITH {_POINTS}, {_FRAMES}, c AS (SELECT frame, x + dx AS x, y, z + dz AS z FROM p JOIN f ON p.scene = f.scene),
s AS (SELECT frame, z > 1e-6 AS front, CASE WHEN z > 1e-6 THEN x * {FOCAL} / z + {W // 2} BETWEEN 0 AND {W} - 1e-12 AND y * {FOCAL} / z + {H // 2} BETWEEN 0 AND {H} - 1e-12 ELSE FALSE END AS shown FROM c)
SELECT frame::BIGINT AS frame, round(avg(front::INT), 6) AS in_front, round(avg(shown::INT), 6) AS in_image, round(avg(front::INT) * 0.7 + avg(shown::INT) * 0.3, 6) AS score, row_number() OVER (ORDER BY round(avg(front::INT) * 0.7 + avg(shown::INT) * 0.3, 9) DESC, frame) = 1 AS best FROM s GROUP BY frame""")
def pose_scores(spark, d):
    s = P.projection_score(_points(spark, d), _frames(spark, d))
    best = s.agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("frame")).alias("f"))).alias("b"))  # one row
    return s.crossJoin(F.broadcast(best)).select(F.col("frame").cast("long").alias("frame"), *[six(F.col(c), c) for c in ("in_front", "in_image", "score")], (F.col("frame") == -F.col("b.f")).alias("best"))
