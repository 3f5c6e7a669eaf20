"""The scene operators over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelyard.functions import geometry as G
from voxelyard.functions import text as T
from voxelyard.operators import relational as R

from .registry import ORACLE, QUERIES


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def six(c, name):
    return F.round(c, 6).alias(name)


# ------------------------------------------------------------------ evaluation
def _gt_and_nodes(spark, d):
    li = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    node = li.filter(F.col("l_quantity") > (F.col("l_suppkey") % 7) * 6).select(F.col("l_suppkey").alias("node"), "l_partkey").distinct()
    gt = li.filter(F.col("l_quantity") <= 5 + (F.col("l_suppkey") % 10) * 5).select(F.col("l_suppkey").alias("gt"), "l_partkey").distinct()
    return gt, node


def _best(spark, d):
    gt, node = _gt_and_nodes(spark, d)
    best = R.sized_pairs(gt, node, "l_partkey", "gt", "node", best=True)
    return best.withColumn("iou", F.col("inter") / (F.col("n_gt") + F.col("n_node") - F.col("inter"))), R.set_sizes(gt, "gt", "n_gt")


_BEST = """gt AS (SELECT DISTINCT l_suppkey AS gt, l_partkey FROM lineitem WHERE l_quantity <= 5 + (l_suppkey % 10) * 5),
node AS (SELECT DISTINCT l_suppkey AS node, l_partkey FROM lineitem WHERE l_quantity > (l_suppkey % 7) * 6),
ng AS (SELECT gt, count(*) n_gt FROM gt GROUP BY 1), nn AS (SELECT node, count(*) n_node FROM node GROUP BY 1),
p AS (SELECT gt, node, count(*) inter FROM gt JOIN node USING (l_partkey) GROUP BY 1, 2),
q AS (SELECT p.*, n_gt, n_node, inter / (n_gt + n_node - inter) AS iou FROM p JOIN ng USING (gt) JOIN nn USING (node)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY iou DESC, node) r FROM q) WHERE r = 1)"""


@query(f"WITH {_BEST} SELECT gt, node, inter, round(iou, 6) AS iou, round(inter / n_node, 6) AS precision, round(inter / n_gt, 6) AS recall FROM best")
def oracle_best_node(spark, d):
    best, _ = _best(spark, d)
    return best.select("gt", "node", "inter", six(F.col("iou"), "iou"), six(F.col("inter") / F.col("n_node"), "precision"), six(F.col("inter") / F.col("n_gt"), "recall"))


_AP = " + ".join(f"(coalesce(inter / n_node, 0)::FLOAT >= {t / 100}::FLOAT)::INT" for t in range(50, 100, 5))


@query(f"""WITH {_BEST}, m AS (SELECT gt, gt % 5 AS scene, ({_AP}) / 10.0 AS ap, (coalesce(inter / n_node, 0)::FLOAT >= 0.5::FLOAT)::INT AS ap50, (coalesce(inter / ng.n_gt, 0)::FLOAT >= 0.5::FLOAT)::INT AS ar50, coalesce(iou, 0) AS iou FROM ng LEFT JOIN best USING (gt)),
s AS (SELECT scene, avg(ap) ap, avg(ap50) ap50, avg(ar50) ar50, avg(iou) iou FROM m GROUP BY 1)
SELECT 'micro' AS kind, round(avg(ap), 6) AS map, round(avg(ap50), 6) AS ap50, round(avg(ar50), 6) AS ar50, round(avg(iou), 6) AS miou FROM m
UNION ALL SELECT 'macro', round(avg(ap), 6), round(avg(ap50), 6), round(avg(ar50), 6), round(avg(iou), 6) FROM s""")
def oracle_micro_macro(spark, d):
    best, sizes = _best(spark, d)
    full = sizes.join(best.drop("n_gt"), "gt", "left")
    p, r = F.coalesce(F.col("inter") / F.col("n_node"), F.lit(0.0)).cast("float"), F.coalesce(F.col("inter") / F.col("n_gt"), F.lit(0.0)).cast("float")
    hits = sum(((p >= F.lit(t / 100).cast("float")).cast("int") for t in range(50, 100, 5)), F.lit(0))
    half = F.lit(0.5).cast("float")
    m = full.select((F.col("gt") % 5).alias("scene"), (hits / 10.0).alias("ap"), (p >= half).cast("int").alias("ap50"), (r >= half).cast("int").alias("ar50"), F.coalesce("iou", F.lit(0.0)).alias("iou"))
    names = ["ap", "ap50", "ar50", "iou"]
    s = m.groupBy("scene").agg(*[F.avg(x).alias(x) for x in names])
    out = lambda df, kind: df.agg(*[F.round(F.avg(x), 6).alias(y) for x, y in zip(names, ["map", "ap50", "ar50", "miou"], strict=True)]).select(F.lit(kind).alias("kind"), "map", "ap50", "ar50", "miou")
    return out(m, "micro").unionByName(out(s, "macro"))


_EDGES = """s AS (SELECT DISTINCT l_suppkey AS n, l_partkey AS p FROM lineitem), z AS (SELECT n, count(*) c FROM s GROUP BY 1),
e AS (SELECT x.n AS a, y.n AS b, count(*) AS inter FROM s x JOIN s y ON x.p = y.p AND x.n < y.n GROUP BY 1, 2 HAVING count(*) >= 160),
edges AS (SELECT a, b, inter, inter / least(u.c, v.c) AS ratio FROM e JOIN z u ON u.n = a JOIN z v ON v.n = b WHERE inter / least(u.c, v.c) >= 0.30)"""


def _edges(spark, d):
    return R.overlap_pairs(read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey", 160, 0.30)


@query(f"WITH {_EDGES} SELECT a, b, inter, round(ratio, 6) AS ratio FROM edges")
def pair_overlap_edges(spark, d):
    return _edges(spark, d).select("a", "b", "inter", six(F.col("ratio"), "ratio"))


# ------------------------------------------------------------------ votes
_VOTES = "SELECT event_type, user_id, count(*) AS vis, count(*) FILTER (WHERE value > 20) AS fg FROM events GROUP BY 1, 2"


def _votes(spark, d):
    return R.votes(read(spark, d, "events"), ["event_type", "user_id"], F.col("value") > 20)


@query(f"SELECT * FROM ({_VOTES}) WHERE fg / vis >= 0.7")
def vote_filter_ratio(spark, d):
    return _votes(spark, d).filter(F.col("fg") / F.col("vis") >= 0.7)


_W = "greatest(((fg / vis) + 3.8416 / (2 * vis) - 1.96 * sqrt((fg / vis) * (1 - fg / vis) / vis + 3.8416 / (4 * vis * vis))) / (1 + 3.8416 / vis), 0)"


@query(f"SELECT event_type, user_id, vis, fg, round({_W}, 6) AS low FROM ({_VOTES}) WHERE round({_W}, 6) >= 0.4")
def vote_filter_wilson(spark, d):
    return _votes(spark, d).withColumn("low", F.round(G.wilson_lower(F.col("fg"), F.col("vis")), 6)).filter("low >= 0.4")


@query(f"SELECT t AS threshold, event_type, count(*) FILTER (WHERE fg / vis >= t) AS kept FROM ({_VOTES}), (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE)) AS v(t) GROUP BY 1, 2")
def param_sweep(spark, d):
    t = F.explode(F.array(*[F.lit(x) for x in (0.5, 0.6, 0.7, 0.8)]))
    return _votes(spark, d).withColumn("threshold", t).groupBy("threshold", "event_type").agg(F.count_if(F.col("fg") / F.col("vis") >= F.col("threshold")).alias("kept"))


# ------------------------------------------------------------------ projection, depth
_ALL = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_partkey"]


@query(f"SELECT l_suppkey, pixel, l_partkey, l_orderkey, l_extendedprice FROM (SELECT *, l_partkey % 50 AS pixel, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY {', '.join(_ALL)}) r FROM lineitem) WHERE r = 1")
def zbuffer_nearest(spark, d):
    li = read(spark, d, "lineitem").withColumn("pixel", F.col("l_partkey") % 50)
    return R.nearest(li, ["l_suppkey", "pixel"], [F.col(c).asc() for c in _ALL]).select("l_suppkey", "pixel", "l_partkey", "l_orderkey", "l_extendedprice")


@query("""WITH c AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.5::DOUBLE), (2, -0.5::DOUBLE), (3, 2.0::DOUBLE)) AS v(cam, shift)),
p AS (SELECT vec_id, cam, embedding[1]::DOUBLE + shift AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE + 1 AS z FROM embeddings, c),
q AS (SELECT *, round_even(x * 600 / greatest(z::FLOAT::DOUBLE, 1e-6) + 320, 0) AS u, round_even(y * 600 / greatest(z::FLOAT::DOUBLE, 1e-6) + 240, 0) AS v FROM p WHERE z > 0)
SELECT vec_id, cam, u::BIGINT AS u, v::BIGINT AS v FROM q WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480""")
def project_inimage(spark, d):
    cams = F.explode(F.array(*[F.struct(F.lit(i).alias("cam"), F.lit(s).alias("shift")) for i, s in enumerate((0.0, 0.5, -0.5, 2.0))]))
    e = read(spark, d, "embeddings").withColumn("c", cams)
    p = e.select("vec_id", "c.cam", (F.col("embedding")[0].cast("double") + F.col("c.shift")).alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("embedding")[2].cast("double") + 1).alias("z"))
    u, v = G.project(F.col("x"), F.col("y"), F.col("z"), 600, 600, 320, 240)
    return p.withColumns({"u": u, "v": v}).filter(G.inside(F.col("u"), F.col("v"), F.col("z"), 640, 480)).select("vec_id", "cam", "u", "v")


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem GROUP BY 1),
v AS (SELECT l_suppkey, abs(l_extendedprice - med) AS dev FROM lineitem JOIN m USING (l_suppkey)), a AS (SELECT l_suppkey, median(dev) AS mad FROM v GROUP BY 1)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE dev < greatest(0.03, 1.4826 * mad)) AS kept, round(any_value(mad), 4) AS mad FROM v JOIN a USING (l_suppkey) GROUP BY 1""")
def mad_depth_filter(spark, d):
    li = read(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")
    return R.robust_keep(li, ["l_suppkey"], "l_extendedprice", 1.0, 0.03).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"), F.round(F.first("mad"), 4).alias("mad"))


@query("""WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS z FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(z, 2) AS z FROM orders JOIN s ON l_orderkey = o_orderkey WHERE o_totalprice > 1e-6 AND abs(o_totalprice - z) <= 0.25 * o_totalprice""")
def relative_depth_filter(spark, d):
    z = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("z"))
    return read(spark, d, "orders").join(z, "o_orderkey").filter((F.col("o_totalprice") > 1e-6) & (F.abs(F.col("o_totalprice") - F.col("z")) <= 0.25 * F.col("o_totalprice"))).select("o_orderkey", "z")


# ------------------------------------------------------------------ voxels and boxes
_VOX = "floor(l_quantity / 5)::BIGINT AS i, floor(l_extendedprice / 10000)::BIGINT AS j, floor(l_discount / 0.02)::BIGINT AS k"


def _voxels(li):
    i, j, k = G.voxel((F.col("l_quantity"), 5.0), (F.col("l_extendedprice"), 10000.0), (F.col("l_discount"), 0.02))
    return li.withColumns({"i": i, "j": j, "k": k})


def _cells(spark, d):
    return _voxels(read(spark, d, "lineitem")).select("l_suppkey", F.struct("i", "j", "k").alias("cell")).distinct()


@query(f"SELECT {_VOX}, count(*) AS n, min(l_orderkey) AS first_point FROM lineitem GROUP BY 1, 2, 3")
def voxel_dedup(spark, d):
    return _voxels(read(spark, d, "lineitem")).groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_point"))


@query(f"""WITH v AS (SELECT DISTINCT l_suppkey AS n, {_VOX} FROM lineitem), z AS (SELECT n, count(*) c FROM v GROUP BY 1),
p AS (SELECT x.n AS a, y.n AS b, count(*) AS inter FROM v x JOIN v y USING (i, j, k) WHERE x.n < y.n GROUP BY 1, 2)
SELECT a, b, inter, round(inter / (u.c + w.c - inter), 6) AS iou, round(inter / least(u.c, w.c), 6) AS contain FROM p JOIN z u ON u.n = a JOIN z w ON w.n = b""")
def voxel_iou_pairs(spark, d):
    p = R.overlap_pairs(_cells(spark, d), "l_suppkey", "cell", 1, 0.0)
    return p.select("a", "b", "inter", six(F.col("inter") / (F.col("size_a") + F.col("size_b") - F.col("inter")), "iou"), six(F.col("ratio"), "contain"))


_BOX = "SELECT label, " + ", ".join(f"min(embedding[{i}]::DOUBLE) AS l{i}, max(embedding[{i}]::DOUBLE) AS h{i}" for i in (1, 2, 3)) + ", count(*) AS n FROM embeddings GROUP BY 1"


def _boxes(spark, d):
    x = [F.col("embedding")[i].cast("double") for i in range(3)]
    return read(spark, d, "embeddings").groupBy("label").agg(*[f(x[i]).alias(f"{s}{i + 1}") for i in range(3) for f, s in ((F.min, "l"), (F.max, "h"))], F.count(F.lit(1)).alias("n"))


@query(_BOX)
def aabb_per_group(spark, d):
    return _boxes(spark, d)


_I = " * ".join(f"greatest(least(a.h{i}, b.h{i}) - greatest(a.l{i}, b.l{i}), 0)" for i in (1, 2, 3))
_V = {s: " * ".join(f"greatest({s}.h{i} - {s}.l{i}, 0)" for i in (1, 2, 3)) for s in "ab"}


@query(f"WITH x AS ({_BOX}), p AS (SELECT a.label AS a, b.label AS b, {_I} AS w, {_V['a']} AS va, {_V['b']} AS vb FROM x a JOIN x b ON a.label < b.label AND a.label % 2 = b.label % 2) SELECT a, b, round(w / greatest(va + vb - w, 1e-12), 6) AS iou, round(w / greatest(least(va, vb), 1e-12), 6) AS contain FROM p WHERE w / greatest(va + vb - w, 1e-12) >= 0.25 OR w / greatest(least(va, vb), 1e-12) >= 0.8")
def aabb_iou_pairs(spark, d):
    low, high = ([f"{s}{i}" for i in (1, 2, 3)] for s in "lh")
    near = R.box_pairs(_boxes(spark, d).withColumn("name", F.col("label") % 2), "label", "name", low, high)
    iou, contain = G.box_overlap(*[([F.col(f"{s}_{c}") for c in low], [F.col(f"{s}_{c}") for c in high]) for s in "ab"])
    return near.withColumns({"iou": iou, "contain": contain}).filter("iou >= 0.25 or contain >= 0.8").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"), six(F.col("iou"), "iou"), six(F.col("contain"), "contain"))


@query("SELECT a, b, round(d2, 6) AS d2 FROM (SELECT x.vec_id AS a, y.vec_id AS b, " + " + ".join(f"(x.embedding[{i}]::DOUBLE - y.embedding[{i}]::DOUBLE) ** 2" for i in (1, 2, 3)) + " AS d2 FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE d2 < 0.0025")
def grid_neighbors(spark, d):
    p = read(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)])
    return R.grid_pairs(p, "vec_id", ["x0", "x1", "x2"], 0.05).select("a", "b", six(F.col("d2"), "d2"))


# ------------------------------------------------------------------ joins of nodes and frames
@query("SELECT c_custkey, s_suppkey, round(dist, 2) AS dist FROM (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) r FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey) WHERE r = 1")
def nearest_parent(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("at"), "c_custkey")
    o = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("at"), "s_suppkey")
    return R.nearest_on_axis(c, o, "nation", "at", "s_suppkey", "c_custkey").select("c_custkey", "s_suppkey", F.round("dist", 2).alias("dist"))


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_partkey = a.l_partkey AND b.l_suppkey % 10 = a.l_suppkey % 10)")
def ownership_antijoin(spark, d):
    li = read(spark, d, "lineitem").withColumn("scene", F.col("l_suppkey") % 10)
    return R.without(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), ["scene", "l_partkey"]).select("l_suppkey", "l_partkey").distinct()


@query("SELECT day, pixel, count(*) AS n FROM (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS day, l_partkey % 100 AS pixel FROM lineitem WHERE l_linestatus = 'O') a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linestatus = 'F' AND b.l_discount > 0.09 AND date_trunc('month', b.l_shipdate) = a.day AND b.l_partkey % 100 = a.pixel) GROUP BY 1, 2")
def affordance_pixel_subtract(spark, d):
    li = read(spark, d, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("day"), (F.col("l_partkey") % 100).alias("pixel"), "l_linestatus", "l_discount")
    return R.without(li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F' and l_discount > 0.09"), ["day", "pixel"]).groupBy("day", "pixel").agg(F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT o_orderkey, o_custkey % 20 AS scene, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS ordinal FROM orders), e AS (SELECT event_id, user_id % 20 AS scene, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS ordinal FROM events) SELECT scene::BIGINT AS scene, ordinal::BIGINT AS ordinal, o_orderkey, event_id FROM o JOIN e USING (scene, ordinal)")
def positional_alignment(spark, d):
    o = R.with_ordinal(read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("scene")), "scene", [F.col("o_orderkey").asc()])
    e = R.with_ordinal(read(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("scene")), "scene", [F.col("event_id").asc()])
    return o.join(e, ["scene", "ordinal"]).select("scene", F.col("ordinal").cast("long").alias("ordinal"), "o_orderkey", "event_id")


@query("WITH f AS (SELECT min(doc_id) AS first_id, trim(lower(text)) AS t FROM documents GROUP BY 2) SELECT doc_id, first_id FROM documents JOIN f ON trim(lower(text)) = t")
def first_match_text_join(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.xxhash64(F.trim(F.lower("text"))).alias("h1"), F.md5(F.trim(F.lower("text"))).alias("h2"))
    return x.join(x.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id")), ["h1", "h2"]).select("doc_id", "first_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) r FROM events) WHERE r = 1")
def best_per_key(spark, d):
    return R.nearest(read(spark, d, "events"), ["user_id"], [F.col("value").desc(), F.col("ts").asc(), F.col("event_id").asc()]).select("user_id", "event_id", "value")


@query("SELECT p_name, n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM (SELECT p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1)")
def prompt_frequency(spark, d):
    n = read(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    return R.ranked(n, [F.col("n").desc(), F.col("first").asc()], "rank").select("p_name", "n", "rank")


@query("SELECT user_id, string_agg(event_type, '; ' ORDER BY first) AS prompts FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def prompt_concat(spark, d):
    f = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return f.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "event_type"))), lambda s: s["event_type"]), "; ").alias("prompts"))


# ------------------------------------------------------------------ ranking curves, stacks, counts
@query("""WITH j AS (SELECT d.lang, d.doc_id, n_chars, quality FROM documents d JOIN labels l USING (doc_id)), t AS (SELECT lang, sum(quality) AS total FROM j GROUP BY 1),
r AS (SELECT j.*, total, row_number() OVER w AS rank, sum(quality) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp FROM j JOIN t USING (lang) WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id)),
e AS (SELECT *, max(tp / rank) OVER (PARTITION BY lang ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r)
SELECT lang, count(*) AS n, round(sum(env * quality / greatest(total, 1)), 6) AS ap FROM e GROUP BY 1""")
def coco_ap_curve(spark, d):
    j = read(spark, d, "documents").select("doc_id", "lang", "n_chars").join(read(spark, d, "labels"), "doc_id")
    j = j.join(j.groupBy("lang").agg(F.sum("quality").alias("total")), "lang")
    c = R.precision_curve(j, ["lang"], [F.col("n_chars").desc(), F.col("doc_id").asc()], F.col("quality") == 1, "total")
    return c.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("envelope") * F.col("quality") / F.greatest("total", F.lit(1))), 6).alias("ap"))


@query("SELECT l_suppkey, l_partkey % 50 AS pixel, count(*) AS stacked, max(l_quantity) AS most, least(count(*) * 255, 65535) AS sum16 FROM lineitem GROUP BY 1, 2")
def mask_stack_modes(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 50).alias("pixel")).agg(F.count(F.lit(1)).alias("stacked"), F.max("l_quantity").alias("most"), F.least(F.count(F.lit(1)) * 255, F.lit(65535)).alias("sum16"))


@query("SELECT c_custkey, count(o_orderkey) AS n_masks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def per_frame_counts(spark, d):
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return read(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_masks"))


@query("SELECT l_suppkey, count(*) FILTER (WHERE p AND g) AS tp, round(count(*) FILTER (WHERE p AND g) / greatest(count(*) FILTER (WHERE p OR g), 1), 6) AS iou, round(count(*) FILTER (WHERE p AND g) / greatest(count(*) FILTER (WHERE p), 1), 6) AS precision FROM (SELECT l_suppkey, l_quantity > 20 AS p, l_discount > 0.04 AS g FROM lineitem) GROUP BY 1")
def overlap_stats_2d(spark, d):
    x = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") > 20).alias("p"), (F.col("l_discount") > 0.04).alias("g"))
    tp = F.count_if(F.col("p") & F.col("g"))
    return x.groupBy("l_suppkey").agg(tp.alias("tp"), F.round(tp / F.greatest(F.count_if(F.col("p") | F.col("g")), F.lit(1)), 6).alias("iou"), F.round(tp / F.greatest(F.count_if("p"), F.lit(1)), 6).alias("precision"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type")
def label_boundaries(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, d, "events").withColumn("before", F.lag("event_type").over(w)).filter("before is not null and before <> event_type").select("user_id", "event_id", "event_type")


# ------------------------------------------------------------------ names and cells
@query("SELECT p_partkey, CASE n WHEN 'drawers' THEN 'drawer' WHEN 'handles' THEN 'handle' WHEN 'doors' THEN 'door' WHEN 'cabinets' THEN 'cabinet' ELSE n END AS name, replace(n, '_', ' ') AS plain FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[ \\t\\r\\n]+', ' ', 'g')) AS n FROM part)")
def name_normalize(spark, d):
    return read(spark, d, "part").select("p_partkey", T.normalize_name(F.col("p_name")).alias("name"), T.normalize_name(F.col("p_name"), False).alias("plain"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_brand || '|' || p_type, ''), lambda c: ord(c)::BIGINT)), lambda h, x: ((xor(h, x)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS hash FROM part")
def fnv_color(spark, d):
    return read(spark, d, "part").select("p_partkey", T.fnv1a(F.concat_ws("|", "p_brand", "p_type")).alias("hash"))
