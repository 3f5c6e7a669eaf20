"""Iterative and sequential operators over the driver's tables. Where SQL can't express one, its test
holds it against a plain version."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelyard.operators import iterative as I
from voxelyard.operators import relational as R
from voxelyard.streaming import pool

from .scene_queries import _EDGES, _edges, query, read

XYZ = ["x", "y", "z"]
EPS, LEAST = 0.1, 4


def _points(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(XYZ)])


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT DISTINCT l_suppkey AS node FROM lineitem), u AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def overlap_components(spark, d):
    nodes = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("node")).distinct()
    return I.with_components(nodes, "node", _edges(spark, d).select("a", "b")).select("node", "component")


@query(f"""WITH RECURSIVE p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
e AS (SELECT s.vec_id AS a, t.vec_id AS b FROM p s JOIN p t ON s.label = t.label AND (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 < {EPS} * {EPS}),
k AS (SELECT a FROM e GROUP BY 1 HAVING count(*) >= {LEAST}), c AS (SELECT a, b FROM e WHERE a IN (FROM k) AND b IN (FROM k)),
r AS (SELECT a, a AS seen FROM k UNION SELECT r.a, c.b FROM r JOIN c ON c.a = r.seen), n AS (SELECT a, min(seen) AS cluster FROM r GROUP BY 1)
SELECT a AS vec_id, TRUE AS core, cluster FROM n UNION ALL SELECT e.a, FALSE, min(cluster) FROM e JOIN n ON n.a = e.b WHERE e.a NOT IN (FROM k) GROUP BY 1
UNION ALL SELECT vec_id, FALSE, min(vec_id) OVER (PARTITION BY label) FROM p WHERE label NOT IN (SELECT label FROM p JOIN k ON k.a = vec_id)""")
def dbscan_clusters(spark, d):
    return I.instances(_points(spark, d), "vec_id", XYZ, EPS, LEAST, ("label",))


@query()
def set_cover(spark, d):
    seen = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("frame"), F.col("c_nationkey").alias("node"))
    return I.set_cover(seen, "frame", "node")


@query()
def nms_greedy(spark, d):
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_orderkey") % 100).cast("double")
    box = read(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_orderkey").agg(F.max("l_extendedprice").alias("score"), F.max("l_quantity").alias("q"))
    box = box.select("l_suppkey", (F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey")).alias("box_id"), x.alias("x0"), y.alias("y0"), (x + 5 + F.col("q") / 5).alias("x1"), (y + 5 + F.col("q") / 5).alias("y1"), "score")
    return I.suppress(box, "l_suppkey", "box_id", 0.5)


def _match_pairs(spark, d):
    li = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    node = li.filter(F.col("l_quantity") > (F.col("l_suppkey") % 7) * 6).select(F.col("l_suppkey").alias("node"), "l_partkey").distinct()
    gt = li.filter(F.col("l_quantity") <= 5 + (F.col("l_suppkey") % 10) * 5).select(F.col("l_suppkey").alias("gt"), "l_partkey").distinct()
    pair = R.sized_pairs(gt, node, "l_partkey", "gt", "node", same=5)
    score = li.groupBy(F.col("l_suppkey").alias("node")).agg(F.max("l_extendedprice").alias("score"))
    return pair.join(score, "node").select((F.col("gt") % 5).alias("scene"), "node", "gt", "score", (F.col("inter") / (F.col("n_gt") + F.col("n_node") - F.col("inter"))).alias("iou"))


RULE = {"mode": "hybrid", "thr_xy": 0.15, "thr_z": 0.1}


def _named(spark, d):
    n = F.col("vec_id") % 5
    return _points(spark, d).withColumns({"name": F.concat(F.lit("n"), n.cast("string")), "names": F.array(F.concat(F.lit("n"), n.cast("string")), F.concat(F.lit("n"), (n * 2 % 7).cast("string")))})


@query()
def rollback_merge(spark, d):
    nodes = _named(spark, d)
    merged = I.merge_to_centroids(nodes, "label", "vec_id", "name", "names", XYZ, RULE)
    out = I.merged_nodes(nodes, merged, "label", "vec_id", "names", XYZ)
    return out.select("label", "node", "n_merged", "name", F.array_join("names", ",").alias("names"), *[F.round(x, 6).alias(x) for x in XYZ])


@query()
def incremental_assign(spark, d):
    cells = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_partkey") % 200).alias("cell")).distinct()
    return I.assign_instances(cells, "l_suppkey", "l_orderkey", "cell", 0.5)


@query()
def handle_instances(spark, d):
    cells = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_partkey") % 200).alias("cell"), (F.col("l_orderkey") * 7 % 50).alias("area")).distinct()
    return I.instance_ids(I.assign_instances(cells, "l_suppkey", "l_orderkey", "cell", 0.4, True))


@query()
def instance_guard(spark, d):
    clouds = _points(spark, d).select("label", (F.col("vec_id") % 40).alias("obs"), F.col("vec_id").alias("point"), *XYZ)
    g = I.guarded_instances(clouds, ["label"], "obs", XYZ, 0.05, 0.25)
    return g.select("label", "obs", I.branch_id(F.lit("000"), F.col("branch")).alias("inst_id"), F.round("distance", 6).alias("distance"))


def _seen(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") % 60).alias("frame"), (F.col("l_suppkey") % 40).alias("node"), F.col("l_partkey"), "l_quantity", "l_discount")
    box = li.groupBy("frame", "node").agg(F.min(F.col("l_partkey") % 100).cast("double").alias("x0"), F.min(F.col("l_partkey") % 70).cast("double").alias("y0"), F.max("l_quantity").alias("w"), F.max("l_discount").alias("v"), F.sum("l_quantity").alias("score"))
    return box.select("frame", "node", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("w")).alias("y1"), (F.col("v") * 10).alias("vis"), "score")


@query()
def selected_frames(spark, d):
    chosen, nodes = I.select_frames(_seen(spark, d), "frame", "node", 0.3, 0.8, 0.9)
    return chosen.select(F.col("frame").alias("id"), F.concat(F.lit("frame "), F.col("phase").cast("string")).alias("what")).unionByName(nodes.select(F.col("node").alias("id"), F.when(F.col("covered"), "covered").otherwise("uncovered").alias("what")))


_SAMPLE = 3


@query()
def sampled_points(spark, d):
    return I.sampled(_points(spark, d), ["label"], "vec_id", _SAMPLE).select("label", "vec_id")


@query("""WITH e AS (SELECT user_id, event_id, (event_type = 'view')::INT AS s, (event_type = 'error')::INT AS r FROM events),
c AS (SELECT *, sum(r - s) OVER (PARTITION BY user_id ORDER BY event_id) AS lead FROM e),
m AS (SELECT user_id, min(event_id) FILTER (WHERE lead >= 3) AS stop FROM c GROUP BY 1)
SELECT e.user_id, sum(s)::BIGINT AS support, sum(r)::BIGINT AS reject, max(event_id) AS last_seen, bool_and(stop IS NULL) AS alive
FROM e JOIN m ON e.user_id IS NOT DISTINCT FROM m.user_id WHERE stop IS NULL OR event_id <= stop GROUP BY 1""")
def pool_support_reject(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "view").cast("int").alias("support"), (F.col("event_type") == "error").cast("int").alias("reject"))
    return pool.settle(e)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS frame, (event_type = 'purchase')::BIGINT AS added, (event_type = 'view')::BIGINT AS s, (event_type IN ('error', 'click'))::BIGINT AS r,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, false AS there, 0::BIGINT AS support, 0::BIGINT AS reject, -1::BIGINT AS last_seen, 0::BIGINT AS pruned FROM events
  UNION ALL SELECT user_id, k, there AND NOT goes, support, reject, last_seen, pruned + goes::BIGINT FROM (
    SELECT *, there AND reject >= 4 AND frame - last_seen >= 20 AND NOT (support >= 3 OR support / greatest(support + reject, 1) >= 0.6) AS goes FROM (
      SELECT f.user_id, e.k, e.frame, f.pruned, f.there OR e.added > 0 AS there,
        CASE WHEN NOT f.there AND e.added > 0 THEN 1 + e.s WHEN f.there THEN f.support + e.s ELSE f.support END AS support,
        CASE WHEN NOT f.there AND e.added > 0 THEN e.r WHEN f.there THEN f.reject + e.r ELSE f.reject END AS reject,
        CASE WHEN (NOT f.there AND e.added > 0) OR (f.there AND e.s > 0) THEN e.frame ELSE f.last_seen END AS last_seen
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)))
SELECT user_id, arg_max(there, k) AS there, arg_max(support, k) AS support, arg_max(reject, k) AS reject, arg_max(last_seen, k) AS last_seen, arg_max(pruned, k) AS pruned FROM f GROUP BY 1""")
def pool_hysteresis(spark, d):
    said = {"added": ["purchase"], "support": ["view"], "reject": ["error", "click"]}
    e = read(spark, d, "events").select("user_id", F.col("event_id").alias("frame"), *[F.col("event_type").isin(kinds).cast("int").alias(c) for c, kinds in said.items()])
    return pool.hysteresis(e, ["user_id"])
