"""Merges, dense ids, image boxes and distances over the driver's tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelyard.functions import boxes as B
from voxelyard.operators import merging as M
from voxelyard.operators import relational as R

from .registry import ORACLE
from .scene_queries import _BOX, _EDGES, _boxes, _cells, _edges, aabb_iou_pairs, query, read, six

#: Components of (a, b) in edges over the nodes in n.
_COMPONENTS = "u AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)"


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT DISTINCT l_suppkey AS node FROM lineitem), {_COMPONENTS}
SELECT component AS l_suppkey, count(DISTINCT l_suppkey) AS members, count(DISTINCT l_partkey) AS n_points, count(*) AS observations FROM lineitem JOIN c ON l_suppkey = node GROUP BY 1""")
def merge_nodes_by_points(spark, d):
    return M.union_points(read(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", _edges(spark, d).select("a", "b"))


_SIDES = [f"{s}{i}" for i in (1, 2, 3) for s in "lh"]


@query(f"""WITH RECURSIVE x AS ({_BOX}), edges AS ({ORACLE['aabb_iou_pairs']}), n AS (SELECT label AS node FROM x), {_COMPONENTS}
SELECT component AS label, count(*) AS members, {', '.join(f"{'min' if s[0] == 'l' else 'max'}({s}) AS {s}" for s in _SIDES)}, sum(n)::BIGINT AS n FROM x JOIN c ON label = node GROUP BY 1""")
def merge_nodes_by_boxes(spark, d):
    ends = [(F.min if s[0] == "l" else F.max)(s).alias(s) for s in _SIDES]
    return M.merge(_boxes(spark, d), "label", aabb_iou_pairs(spark, d).select("a", "b"), *ends, F.sum("n").alias("n"))


VOXEL_IOU, CENTRE = 0.45, 0.5


@query(f"""WITH RECURSIVE x AS (SELECT l_suppkey AS node, count(*) AS n_obs, avg(l_quantity) AS centre FROM lineitem GROUP BY 1),
edges AS (SELECT p.a, p.b FROM ({ORACLE['voxel_iou_pairs']}) p JOIN x s ON s.node = p.a JOIN x t ON t.node = p.b WHERE p.iou >= {VOXEL_IOU} AND p.a % 5 = p.b % 5 AND abs(s.centre - t.centre) < {CENTRE}),
n AS (SELECT node FROM x), {_COMPONENTS}
SELECT component, node, n_obs FROM (SELECT component, x.node, n_obs, row_number() OVER (PARTITION BY component ORDER BY n_obs DESC, x.node) AS k FROM x JOIN c ON c.node = x.node) WHERE k = 1""")
def merge_same_name_groups(spark, d):
    x = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count(F.lit(1)).alias("n_obs"), F.avg("l_quantity").alias("centre"))
    cells, centres = _cells(spark, d), x.select(F.col("node").alias("l_suppkey"), F.col("centre").alias("at"))
    # 0.45 after rounding to six places; of two blocks' pairs a forest is enough
    pairs = R.bit_pairs(cells, "l_suppkey", "cell", min_iou=VOXEL_IOU - 5e-7, within=lambda n: n % 5, near=(centres, CENTRE), forest=True)
    return M.strongest(x, "node", pairs.select("a", "b"), [F.col("n_obs").desc(), F.col("node").asc()]).select("component", "node", "n_obs")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_name, p_size, p_partkey) AS id FROM part")
def dense_node_ids(spark, d):
    return M.dense_ids(read(spark, d, "part"), "p_brand", [F.col(c).asc() for c in ("p_type", "p_name", "p_size", "p_partkey")]).select("p_partkey", "p_brand", "id")


@query("""WITH b AS (SELECT l_orderkey, l_partkey, l_quantity * 20 - 200.5 AS x0, l_partkey % 500 - 40.25 AS y0, l_quantity * 20 - 200.5 + l_discount * 2000 AS x1, l_partkey % 500 - 40.25 + l_tax * 1500 AS y1 FROM lineitem),
k AS (SELECT *, least(greatest(floor(x0), 0), 639) AS u0, least(greatest(floor(y0), 0), 479) AS v0, least(greatest(ceil(x1), 0), 639) AS u1, least(greatest(ceil(y1), 0), 479) AS v1 FROM b),
q AS (SELECT *, CASE WHEN u1 > u0 AND v1 > v0 THEN least((u1 - u0) * (v1 - v0) / greatest((x1 - x0) * (y1 - y0), 1e-12), 1) ELSE 0 END AS ratio, u1 > u0 AND v1 > v0 AS shown FROM k)
SELECT l_orderkey % 100 AS frame, count(*) AS boxes, count(*) FILTER (WHERE shown) AS seen, count(*) FILTER (WHERE ratio >= 0.5) AS half, sum(CASE WHEN shown THEN u1 - u0 END)::BIGINT AS width FROM q GROUP BY 1""")
def box_visible_ratio(spark, d):
    x0, y0 = F.col("l_quantity") * 20 - 200.5, F.col("l_partkey") % 500 - 40.25
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("frame"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_discount") * 2000).alias("x1"), (y0 + F.col("l_tax") * 1500).alias("y1"))
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    u0, _, u1, _ = B.clamped(box, 640, 480)
    li = li.withColumns({"ratio": B.visible_ratio(box, 640, 480), "wide": u1 - u0})
    return li.groupBy("frame").agg(F.count(F.lit(1)).alias("boxes"), F.count("wide").alias("seen"), F.count_if(F.col("ratio") >= 0.5).alias("half"), F.sum("wide").alias("width"))


_D = [f"(s.embedding[{i}]::DOUBLE - t.embedding[{i}]::DOUBLE)" for i in (1, 2, 3)]


@query(f"""SELECT s.vec_id, round(sqrt({' + '.join(f'{x} ** 2' for x in _D)}), 6) AS l2, round(sqrt({_D[0]} ** 2 + {_D[1]} ** 2), 6) AS l2_xy, round(sqrt({_D[0]} ** 2 + {_D[1]} ** 2 + {_D[2]} ** 2 * 4), 6) AS weighted,
abs({_D[0]}) < 0.1 AND abs({_D[1]}) < 0.1 AND abs({_D[2]}) < 0.2 AS near FROM embeddings s JOIN embeddings t ON t.vec_id = s.vec_id + 1""")
def node_distances(spark, d):
    x = [F.col("embedding")[i].cast("double") for i in range(3)]
    e = read(spark, d, "embeddings")
    both = e.select("vec_id", *[v.alias(f"a{i}") for i, v in enumerate(x)]).join(e.select((F.col("vec_id") - 1).alias("vec_id"), *[v.alias(f"b{i}") for i, v in enumerate(x)]), "vec_id")
    a, b = ([F.col(f"{s}{i}") for i in range(3)] for s in "ab")
    return both.select("vec_id", six(B.distance(a, b), "l2"), six(B.distance(a, b, (1.0, 1.0, 0.0)), "l2_xy"), six(B.distance(a, b, (1.0, 1.0, 4.0)), "weighted"), B.within_axes(a, b, (0.1, 0.1, 0.2)).alias("near"))
