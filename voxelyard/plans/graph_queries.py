"""Colours, pixels, boxes, groups and graph nodes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelyard.functions import boxes as B
from voxelyard.functions import colour as C
from voxelyard.functions import geometry as G
from voxelyard.operators import images as M
from voxelyard.operators import iterative as I
from voxelyard.operators import merging as N
from voxelyard.sources import files

from .iterative_queries import EPS, LEAST, XYZ, _points
from .merge_queries import _COMPONENTS
from .registry import ORACLE
from .scene_queries import _EDGES, _edges, query, read, six


@query(f"""WITH h AS ({ORACLE['fnv_color']}), v AS (SELECT p_partkey, (hash & 65535) / 65536.0 AS h FROM h), s AS (SELECT p_partkey, (floor(h * 6)::BIGINT % 6)::INT AS i, h * 6 - floor(h * 6) AS f FROM v),
c AS (SELECT p_partkey, i, 0.95 * 0.25 AS p, 0.95 * (1 - f * 0.75) AS q, 0.95 * (1 - (1 - f) * 0.75) AS t, 0.95 AS v FROM s)
SELECT p_partkey, round([v, q, p, p, t, v][i + 1], 6)::DOUBLE AS r, round([t, v, v, q, p, p][i + 1], 6)::DOUBLE AS g, round([p, p, t, v, v, q][i + 1], 6)::DOUBLE AS b FROM c""")
def node_colours(spark, d):
    part = read(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in zip("rgb", C.node_colour(F.col("p_brand"), F.col("p_type"), F.lit(None).cast("string")), strict=True)])
    return part.select("p_partkey", *[six(F.col(c), c) for c in "rgb"])


_LIN = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_XYZ = ", ".join(f"({' + '.join(f'{m} * {c}' for m, c in zip(row, ('lr', 'lg', 'lb'), strict=True))}) / {w} AS {n}" for row, w, n in zip(C.TO_XYZ, C.WHITE, "xyz", strict=True))
_F = "CASE WHEN {0} > pow(6 / 29, 3) THEN cbrt({0}) ELSE {0} / (3 * pow(6 / 29, 2)) + 4 / 29 END"


@query(f"""WITH p AS (SELECT event_id, event_id % 256 AS r, (event_id * 7) % 256 AS g, user_id % 256 AS b FROM events), l AS (SELECT event_id, {', '.join(f'{_LIN.format(c)} AS l{c}' for c in 'rgb')} FROM p),
x AS (SELECT event_id, {_XYZ} FROM l), f AS (SELECT event_id, {', '.join(f'{_F.format(c)} AS f{c}' for c in 'xyz')} FROM x)
SELECT event_id, round(116 * fy - 16, 5) AS l, round(500 * (fx - fy), 5) AS a, round(200 * (fy - fz), 5) AS b FROM f""")
def lab_colours(spark, d):
    e = F.col("event_id")
    lab = C.rgb_to_lab((e % 256).cast("double"), (e * 7 % 256).cast("double"), (F.col("user_id") % 256).cast("double"))
    return read(spark, d, "events").select("event_id", *[F.round(c, 5).alias(n) for n, c in zip("lab", lab, strict=True)])


_WIDE = 50
_GRID = f"g AS (SELECT event_id % {_WIDE} AS u, event_id // {_WIDE} AS v, value, event_type AS label FROM events)"


def _grid(spark, d):
    at = F.col("event_id")
    return read(spark, d, "events").select(F.lit(0).alias("image"), (at % _WIDE).cast("int").alias("u"), F.floor(at / _WIDE).cast("int").alias("v"), "value", F.col("event_type").alias("label"))


@query(f"WITH {_GRID} SELECT g.u::INT AS u, g.v::INT AS v, round(coalesce((r.value - l.value) ** 2, 0) + coalesce((d.value - t.value) ** 2, 0), 5) AS gradient FROM g LEFT JOIN g l ON l.v = g.v AND l.u = g.u - 1 LEFT JOIN g r ON r.v = g.v AND r.u = g.u + 1 LEFT JOIN g t ON t.u = g.u AND t.v = g.v - 1 LEFT JOIN g d ON d.u = g.u AND d.v = g.v + 1")
def image_gradient(spark, d):
    return M.gradient(_grid(spark, d), "image", ["value"]).select("u", "v", F.round("gradient", 5).alias("gradient"))


@query(f"WITH {_GRID} SELECT g.u::INT AS u, g.v::INT AS v, bool_or(n.label <> g.label) AS edge FROM g JOIN g n ON abs(n.u - g.u) + abs(n.v - g.v) = 1 AND n.u BETWEEN g.u - 1 AND g.u + 1 AND n.v BETWEEN g.v - 1 AND g.v + 1 GROUP BY 1, 2")
def region_edges(spark, d):
    return M.boundaries(_grid(spark, d), "image", "label").select("u", "v", "edge")


@query(f"WITH {_GRID}, k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS region FROM (SELECT DISTINCT label FROM g)) SELECT region::INT AS region, round(avg(u), 6) AS u, round(avg(v), 6) AS v, count(*) AS n FROM g JOIN k USING (label) GROUP BY 1")
def region_centroids(spark, d):
    c = M.centroids(M.dense_labels(_grid(spark, d), "image", "label"), "image", "label")
    return c.select(F.col("label").alias("region"), six(F.col("u"), "u"), six(F.col("v"), "v"), "n")


@query()
def superpixel_regions(spark, d):
    image = F.floor(F.col("v") / _WIDE).cast("int")
    px = _grid(spark, d).select(image.alias("image"), "u", (F.col("v") % _WIDE).alias("v"), F.col("value").alias("l"), (F.col("value") / 2).alias("a"), F.lit(0.0).alias("b"))
    labels = M.superpixels(px, "image", 20, 10.0, 2)
    return M.connected(labels, "image", "label", 4).select("image", "u", "v", "region")


_BOX = "b AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 AS x0, l_suppkey % 600 AS y0, l_partkey % 900 + l_quantity AS x1, l_suppkey % 600 + l_quantity AS y1 FROM lineitem)"


@query(f"""WITH {_BOX}, p AS (SELECT *, x0 BETWEEN 0 AND 640 AND x1 BETWEEN 0 AND 640 AND y0 BETWEEN 0 AND 480 AND y1 BETWEEN 0 AND 480 AS inside FROM b)
SELECT l_orderkey % 500 AS k, round(sum((x0 + x1) / 2 / 640), 9) AS cx, round(sum((y1 - y0) / 480), 9) AS sy, count(*) FILTER (WHERE inside) AS inside, round(sum(CASE WHEN inside THEN x1 ELSE x1 / 1000 * 640 END), 4) AS px, sum(greatest(x0 - 8, 0) + least(y0 + 8, 479))::DOUBLE AS near FROM p GROUP BY 1""")
def box_forms(spark, d):
    q = F.col("l_quantity")
    x0, y0 = (F.col("l_partkey") % 900).cast("double"), (F.col("l_suppkey") % 600).cast("double")
    box = [x0, y0, x0 + q, y0 + q]
    cx, _, _, sy = B.centre_size(box, 640, 480)
    px, near = B.in_pixels(box, 640, 480), B.around_point(x0, y0, 640, 480)
    inside = (x0 + q <= 640) & (y0 + q <= 480) & (x0 <= 640) & (y0 <= 480)
    return read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("k")).agg(F.round(F.sum(cx), 9).alias("cx"), F.round(F.sum(sy), 9).alias("sy"), F.count_if(inside).alias("inside"), F.round(F.sum(px[2]), 4).alias("px"), F.sum(near[0] + near[3]).alias("near"))


_E = [f"embedding[{i}]::DOUBLE" for i in (1, 2, 3)]
_SIX = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


@query(f"""WITH m AS (SELECT label, count(*) AS n, {', '.join(f'avg({_E[i]}) AS m{i}' for i in range(3))}, {', '.join(f"coalesce(covar_samp({_E[i]}, {_E[j]}), 0) + {'1e-6' if i == j else '0'} AS c{i}{j}" for i, j in _SIX)} FROM embeddings GROUP BY 1),
k AS (SELECT *, c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c02 * c12) + c02 * (c01 * c12 - c02 * c11) AS det FROM m),
v AS (SELECT label, n, m0, m1, m2, (c11 * c22 - c12 * c12) / det AS i00, (c02 * c12 - c01 * c22) / det AS i01, (c01 * c12 - c02 * c11) / det AS i02, (c00 * c22 - c02 * c02) / det AS i11, (c01 * c02 - c00 * c12) / det AS i12, (c00 * c11 - c01 * c01) / det AS i22 FROM k),
p AS (SELECT label, {', '.join(f'{_E[i]} - m{i} AS d{i}' for i in range(3))}, i00, i01, i02, i11, i12, i22 FROM embeddings JOIN v USING (label)),
f AS (SELECT label, sqrt(d0 * d0 * i00 + d1 * d1 * i11 + d2 * d2 * i22 + 2 * (d0 * d1 * i01 + d0 * d2 * i02 + d1 * d2 * i12)) AS far FROM p)
SELECT label, n, round(avg(far), 5) AS mean_distance, round(max(far), 5) AS most, count(*) FILTER (WHERE far < 1.5) AS near, round(any_value(i01), 3) AS i01 FROM f JOIN v USING (label) GROUP BY 1, 2""")
def covariance_mahalanobis(spark, d):
    p = _points(spark, d)
    cov = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(XYZ)], *[(F.coalesce(F.covar_samp(XYZ[i], XYZ[j]), F.lit(0.0)) + (1e-6 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _SIX])
    unit = [1.0 if i == j else 0.0 for i, j in _SIX]
    inverse = [F.when(F.col("n") < 2, F.lit(u)).otherwise(c) for u, c in zip(unit, B.inverse_symmetric([F.col(f"c{i}{j}") for i, j in _SIX]), strict=True)]
    each = p.join(cov.select("label", "n", "m0", "m1", "m2", *[c.alias(f"i{k}") for k, c in enumerate(inverse)]), "label")
    far = B.mahalanobis([F.col(c) for c in XYZ], [F.col(f"m{i}") for i in range(3)], [F.col(f"i{k}") for k in range(6)])
    return each.withColumn("far", far).groupBy("label", "n").agg(F.round(F.avg("far"), 5).alias("mean_distance"), F.round(F.max("far"), 5).alias("most"), F.count_if(F.col("far") < 1.5).alias("near"), F.round(F.first("i1"), 3).alias("i01"))


# ------------------------------------------------------------------ groups, clusters, nodes
@query("WITH s AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS names FROM events GROUP BY 1), f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, array_to_string(any_value(names), ',') AS names, string_agg(event_id::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 10) AS samples, count(*) AS observations FROM f JOIN s USING (user_id) GROUP BY 1")
def group_names(spark, d):
    e = read(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("k", "event_id")))), lambda x: x["event_id"].cast("string"))  # ten of a group at most
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"), F.array_join(first, ",").alias("samples"), F.count(F.lit(1)).alias("observations"))


@query("SELECT i, j, k, arg_min(vec_id, vec_id) AS vec_id, arg_min(label, vec_id)::INT AS label, count(*) AS n FROM (SELECT vec_id, label, floor(embedding[1]::DOUBLE / 0.3)::BIGINT AS i, floor(embedding[2]::DOUBLE / 0.3)::BIGINT AS j, floor(embedding[3]::DOUBLE / 0.3)::BIGINT AS k FROM embeddings) GROUP BY 1, 2, 3")
def voxel_first_point(spark, d):
    i, j, k = G.voxel(*[(F.col(c), 0.3) for c in XYZ])
    p = _points(spark, d).select("vec_id", F.col("label").cast("int").alias("label"), i.alias("i"), j.alias("j"), k.alias("k"))
    return p.groupBy("i", "j", "k").agg(F.min(F.struct("vec_id", "label")).alias("m"), F.count(F.lit(1)).alias("n")).select("i", "j", "k", "m.vec_id", "m.label", "n")


_ALL_CLUSTERS = f"cl AS ({ORACLE['dbscan_clusters']})"


@query(f"{ORACLE['dbscan_clusters'].split('SELECT a AS vec_id, TRUE', 1)[0].rstrip()}, cl AS (SELECT a AS vec_id, TRUE{ORACLE['dbscan_clusters'].split('SELECT a AS vec_id, TRUE', 1)[1]}), z AS (SELECT label, cluster, count(*) AS n FROM cl JOIN embeddings USING (vec_id) GROUP BY 1, 2) SELECT label::BIGINT AS label, cluster, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, cluster) AS rank FROM z")
def cluster_ranks(spark, d):
    p = _points(spark, d)
    z = I.instances(p, "vec_id", XYZ, EPS, LEAST, ("label",)).join(p.select("vec_id", "label"), "vec_id").groupBy(F.col("label").cast("long").alias("label"), "cluster").agg(F.count(F.lit(1)).alias("n"))
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.col("n").desc(), "cluster")).cast("long"))


@query(f"{ORACLE['dbscan_clusters'].split('SELECT a AS vec_id, TRUE', 1)[0].rstrip()}, cl AS (SELECT a AS vec_id, cluster FROM n UNION ALL SELECT e.a, min(cluster) FROM e JOIN n ON n.a = e.b WHERE e.a NOT IN (FROM k) GROUP BY 1), z AS (SELECT label, cluster, count(*) AS c, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p JOIN cl USING (vec_id) GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, cluster) AS r, count(*) OVER (PARTITION BY label) AS clusters FROM z) WHERE r = 1), w AS (SELECT label, count(*) AS num, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1) SELECT w.label::BIGINT AS label, num AS num_points, coalesce(clusters, 0) AS num_clusters, coalesce(c, 0) AS largest, round(coalesce(b.x, w.x), 4) AS x, round(coalesce(b.y, w.y), 4) AS y, round(coalesce(b.z, w.z), 4) AS z FROM w LEFT JOIN b USING (label)")
def largest_centroids(spark, d):
    c = I.largest_cluster_centroids(_points(spark, d), "vec_id", XYZ, EPS, LEAST, ("label",))
    return c.select(F.col("label").cast("long").alias("label"), "num_points", "num_clusters", F.col("largest_cluster_points").alias("largest"), *[F.round(F.col(x).cast("double"), 4).alias(x) for x in XYZ])


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT DISTINCT l_suppkey AS node FROM lineitem), {_COMPONENTS}, o AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_returnflag || l_linestatus AS name FROM lineitem)
SELECT component AS node, count(DISTINCT l_suppkey) AS members, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(*) AS observations FROM o JOIN c ON l_suppkey = node GROUP BY 1""")
def merged_names(spark, d):
    seen = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.concat("l_returnflag", "l_linestatus").alias("name")).groupBy("node").agg(F.collect_set("name").alias("names"), F.count(F.lit(1)).alias("n"))
    out = N.merge(seen, "node", _edges(spark, d).select("a", "b"), N.all_names("names").alias("names"), F.sum("n").alias("observations"))
    return out.withColumn("names", F.array_join("names", ","))


@query("SELECT count(DISTINCT user_id) AS frames, count(*) AS masks, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(count(*) / count(DISTINCT user_id), 6) AS per_frame, '{\"eps\": 0.1, \"min\": 4}' AS params FROM events")
def run_counters(spark, d):
    e = read(spark, d, "events")
    kinds = [F.count_if(F.col("event_type") == k).alias(f"{k}s") for k in ("view", "click")]
    counted = e.agg(F.count_distinct("user_id").alias("frames"), F.count(F.lit(1)).alias("masks"), *kinds, F.round(F.count(F.lit(1)) / F.count_distinct("user_id"), 6).alias("per_frame"))
    return files.run_metadata(spark, {"min": 4, "eps": 0.1}, counted)


@query("SELECT l_suppkey % 130 AS node, any_value(coalesce(s_name, '')) AS name, count(DISTINCT l_partkey) AS points FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey % 130 WHERE l_quantity > 10 GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 200")
def node_lookup(spark, d):
    li = read(spark, d, "lineitem").filter("l_quantity > 10").select((F.col("l_suppkey") % 130).alias("node"), "l_partkey").groupBy("node").agg(F.count_distinct("l_partkey").alias("points"))
    names = read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))
    return li.filter("points >= 200").join(names, "node", "left").select("node", F.coalesce("name", F.lit("")).alias("name"), "points")


@query("WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) SELECT user_id, count(*) AS frames, array_to_string(list(event_id ORDER BY event_id)[1:50], ',') AS head FROM k WHERE k % 3 = 0 AND event_id < 9000 GROUP BY 1")
def strided_frames(spark, d):
    s = files.strided(read(spark, d, "events").select("user_id", F.col("event_id").cast("int").alias("event_id")), "user_id", "event_id", 3, 9000, False)
    first = s.withColumn("_k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return first.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= 50, F.col("event_id")))), lambda x: x.cast("string")), ",").alias("head"))
