"""Evaluation over the driver's tables: suppliers are nodes and truths, parts the points they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelyard.operators import evaluation as E
from voxelyard.operators import iterative as I
from voxelyard.operators import relational as R

from .iterative_queries import _match_pairs
from .scene_queries import _BEST, _best, query, read, six

_THR = sorted({*E.THRESHOLDS, 0.25, 0.1})
_PAIRS = """gt AS (SELECT DISTINCT l_suppkey AS gt, l_partkey FROM lineitem WHERE l_quantity <= 5 + (l_suppkey % 10) * 5),
node AS (SELECT DISTINCT l_suppkey AS node, l_partkey FROM lineitem WHERE l_quantity > (l_suppkey % 7) * 6),
ng AS (SELECT gt, count(*) AS n_gt FROM gt GROUP BY 1), nn AS (SELECT node, count(*) AS n_node FROM node GROUP BY 1),
sc AS (SELECT l_suppkey AS node, max(l_extendedprice) AS score FROM lineitem GROUP BY 1),
pa AS (SELECT gt % 5 AS scene, node, gt, count(*) / (any_value(n_gt) + any_value(n_node) - count(*)) AS iou FROM gt JOIN node USING (l_partkey) JOIN ng USING (gt) JOIN nn USING (node) WHERE gt % 5 = node % 5 GROUP BY 2, 3),
pr AS (SELECT node % 5 AS scene, node, score, row_number() OVER (PARTITION BY node % 5 ORDER BY score DESC, node) AS k FROM nn JOIN sc USING (node))"""


def _greedy(thresholds) -> str:
    """SQL of the greedy matching: a scene's predictions one after the other, with the truths taken so far."""
    return f"""{_PAIRS}, th AS (SELECT unnest([{', '.join(map(str, thresholds))}])::DOUBLE AS thr),
ca AS (SELECT pr.scene, thr, k, pr.node, list(gt ORDER BY iou DESC, gt) FILTER (WHERE iou >= thr) AS gts FROM pr CROSS JOIN th LEFT JOIN pa ON pa.node = pr.node GROUP BY 1, 2, 3, 4),
r AS (SELECT DISTINCT scene, thr, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS node, NULL::BIGINT AS gt FROM ca
 UNION ALL SELECT r.scene, r.thr, r.k + 1, CASE WHEN len(list_filter(coalesce(gts, []), lambda x: NOT list_contains(taken, x))) > 0 THEN list_append(taken, list_filter(gts, lambda x: NOT list_contains(taken, x))[1]) ELSE taken END, ca.node, list_filter(coalesce(gts, []), lambda x: NOT list_contains(taken, x))[1]
 FROM r JOIN ca ON ca.scene = r.scene AND ca.thr = r.thr AND ca.k = r.k + 1)"""


@query(f"WITH RECURSIVE {_greedy([0.1])} SELECT r.scene, r.node, r.gt, round(pa.iou, 6) AS iou FROM r JOIN pa ON pa.node = r.node AND pa.gt = r.gt")
def coco_greedy_match(spark, d):
    return I.greedy_match(_match_pairs(spark, d), "scene", "node", "gt", 0.1).withColumn("iou", F.round("iou", 6))


_SINGLE = {0.1: "ap10", 0.25: "ap25"}


@query(f"""WITH RECURSIVE {_greedy(_THR)}, nt AS (SELECT gt % 5 AS scene, count(*) AS n FROM ng GROUP BY 1),
c AS (SELECT scene, thr, k, (gt IS NOT NULL)::INT AS hit, sum((gt IS NOT NULL)::INT) OVER (PARTITION BY scene, thr ORDER BY k) AS tp FROM r WHERE k > 0),
e AS (SELECT *, max(tp / k) OVER (PARTITION BY scene, thr ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c),
a AS (SELECT scene, thr, sum(hit * env) / any_value(n) AS ap FROM e JOIN nt USING (scene) GROUP BY 1, 2)
SELECT scene, round(avg(ap) FILTER (WHERE thr >= 0.5), 6) AS map, {', '.join(f"round(max(ap) FILTER (WHERE thr = {t}), 6) AS {n}" for t, n in _SINGLE.items())} FROM a GROUP BY 1""")
def coco_map(spark, d):
    gt = read(spark, d, "lineitem").filter(F.col("l_quantity") <= 5 + (F.col("l_suppkey") % 10) * 5).select(F.col("l_suppkey").alias("gt")).distinct()
    li = read(spark, d, "lineitem")
    some = li.filter(F.col("l_quantity") > (F.col("l_suppkey") % 7) * 6).select(F.col("l_suppkey").alias("pred")).distinct()
    preds = some.join(li.groupBy(F.col("l_suppkey").alias("pred")).agg(F.max("l_extendedprice").alias("score")), "pred").withColumn("scene", F.col("pred") % 5)
    truths = gt.groupBy((F.col("gt") % 5).alias("scene")).agg(F.count(F.lit(1)).alias("n_gt"))
    pairs = _match_pairs(spark, d).withColumnRenamed("node", "pred")
    got = E.map_over_thresholds(pairs, preds, truths, "scene", single=tuple(_SINGLE))
    return got.select("scene", *[six(F.col(c), c) for c in ("map", *_SINGLE.values())])


@query(f"WITH {_BEST}, a AS (SELECT ng.gt, coalesce(iou, 0) AS iou FROM ng LEFT JOIN best USING (gt)) SELECT count(*) AS n, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou FROM a")
def oracle_iou_summary(spark, d):
    best, sizes = _best(spark, d)
    a = sizes.join(best.select("gt", "iou"), "gt", "left").select(F.coalesce("iou", F.lit(0.0)).alias("iou"))
    return a.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.median("iou"), 6).alias("median_iou"))


_POINTS = 1500  # points beyond are out of range


@query(f"""WITH gt AS (SELECT DISTINCT l_suppkey AS gt, l_partkey FROM lineitem WHERE l_quantity <= 5 + (l_suppkey % 10) * 5), al AS (SELECT l_suppkey AS node, l_partkey, CASE WHEN l_suppkey % 4 = 0 THEN 'other' ELSE 'affordance' END AS type FROM lineitem WHERE l_quantity > (l_suppkey % 7) * 6),
node AS (SELECT * FROM al WHERE type = 'affordance' AND l_partkey < {_POINTS}), nn AS (SELECT node, count(*) AS n_node FROM node GROUP BY 1),
p AS (SELECT gt, node, count(*) AS inter FROM gt JOIN node USING (l_partkey) GROUP BY 1, 2), a AS (SELECT node, coalesce(max(inter / n_node), 0) AS share FROM nn LEFT JOIN p USING (node) GROUP BY 1)
SELECT (SELECT count(DISTINCT node) FROM al WHERE type <> 'affordance') AS filtered, count(*) AS valid, count(*) FILTER (WHERE share >= 0.25) AS success, round(avg(share), 6) AS mean_share FROM a""")
def node_overlap_success(spark, d):
    li = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    gt = li.filter(F.col("l_quantity") <= 5 + (F.col("l_suppkey") % 10) * 5).select(F.col("l_suppkey").alias("gt"), "l_partkey").distinct()
    every = li.filter(F.col("l_quantity") > (F.col("l_suppkey") % 7) * 6).select(F.col("l_suppkey").alias("node"), "l_partkey", F.when(F.col("l_suppkey") % 4 == 0, "other").otherwise("affordance").alias("type"))
    node = every.filter((F.col("type") == "affordance") & (F.col("l_partkey") >= 0) & (F.col("l_partkey") < _POINTS))  # a point that is listed twice counts twice
    best = R.shared_points(gt, node, "l_partkey", "gt", "node").groupBy("node").agg(F.max("inter").alias("inter"))
    a = R.set_sizes(node, "node", "n_node").join(best, "node", "left").select((F.coalesce("inter", F.lit(0)) / F.col("n_node")).alias("share"))
    filtered = every.filter("type <> 'affordance'").agg(F.count_distinct("node").alias("filtered"))
    out = a.agg(F.count(F.lit(1)).alias("valid"), F.count_if(F.col("share") >= 0.25).alias("success"), F.round(F.avg("share"), 6).alias("mean_share"))
    return filtered.crossJoin(out)  # one row each


_INSTRUCTIONS = """de AS (SELECT doc_id AS place, 'd' || doc_id::VARCHAR AS desc_id, left(text, 40) AS text, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['a' || (doc_id % 60)::VARCHAR, ' '] ELSE ['a' || (doc_id % 60)::VARCHAR, 'a' || (doc_id % 70)::VARCHAR] END AS annots FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id AS place, '  ' || left(text, 40) || CASE WHEN doc_id % 9 = 0 THEN '?' ELSE ' ' END AS text, [doc_id % 130, doc_id % 97 + 1, -1] AS candidates FROM documents WHERE text IS NOT NULL)"""
_KEY = "lower(trim(regexp_replace({}, '[ \\t\\r\\n\\f]+', ' ', 'g')))"


def _instructions(spark, d):
    docs = read(spark, d, "documents").filter("text is not null")
    i = F.col("doc_id")
    annots = lambda *ns: F.array(*[F.concat(F.lit("a"), (i % n).cast("string")) for n in ns])
    descriptions = docs.select(i.alias("place"), F.concat(F.lit("d"), i.cast("string")).alias("desc_id"), F.substring("text", 1, 40).alias("text"), F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.concat(annots(60), F.array(F.lit(" ")))).otherwise(annots(60, 70)).alias("annot_ids"))
    said = docs.select(i.alias("place"), F.concat(F.lit("  "), F.substring("text", 1, 40), F.when(i % 9 == 0, "?").otherwise(" ")).alias("text"), F.array(i % 130, i % 97 + 1, F.lit(-1)).alias("candidates"))
    return said, descriptions


_TARGET = f"""{_INSTRUCTIONS}, f AS (SELECT k, arg_min(desc_id, place) AS desc_id, arg_min(annots, place) AS annots FROM (SELECT *, {_KEY.format('text')} AS k FROM de WHERE trim(text) <> '') GROUP BY 1),
t AS (SELECT i.place, candidates, desc_id, annots, CASE WHEN desc_id IS NULL THEN 'instruction' WHEN len(annots) = 0 THEN 'annotation' END AS miss FROM i LEFT JOIN f ON f.k = {_KEY.format('i.text')})"""


@query(f"WITH {_TARGET} SELECT coalesce(miss, '') AS miss, count(*) AS n, count(DISTINCT desc_id) AS descriptions FROM t GROUP BY 1")
def instruction_misses(spark, d):
    t = E.instruction_targets(*_instructions(spark, d))
    return t.groupBy(F.coalesce("miss", F.lit("")).alias("miss")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("desc_id").alias("descriptions"))


def _chosen(spark, d, best_of):
    said, descriptions = _instructions(spark, d)
    li = read(spark, d, "lineitem")
    points = li.select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("point")).distinct()
    truth = li.filter("l_discount > 0.05").select(F.concat(F.lit("a"), (F.col("l_suppkey") % 55).cast("string")).alias("annot_id"), F.col("l_partkey").alias("point")).distinct()
    return E.chosen_nodes(E.instruction_targets(said, descriptions).filter("miss is null"), points, truth, best_of)


_NAMED = f"""{_TARGET}, w AS (SELECT place, desc_id, candidates, unnest(annots) AS annot_id FROM t WHERE miss IS NULL),
la AS (SELECT annot_id, arg_max(desc_id, place) AS desc_id, arg_max(candidates, place) AS candidates FROM w WHERE trim(annot_id) <> '' GROUP BY 1),
po AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS point FROM lineitem), no AS (SELECT node, count(*) AS n_node FROM po GROUP BY 1),
na AS (SELECT annot_id, unnest(candidates) AS node, generate_subscripts(candidates, 1) AS k FROM la), kn AS (SELECT na.*, n_node FROM na JOIN no USING (node))"""


@query(f"WITH {_NAMED}, x AS (SELECT annot_id, arg_min(node, k) AS node FROM kn GROUP BY 1) SELECT annot_id, desc_id, node FROM la LEFT JOIN x USING (annot_id)")
def first_candidates(spark, d):
    return _chosen(spark, d, False)


@query(f"""WITH {_NAMED}, tr AS (SELECT DISTINCT 'a' || (l_suppkey % 55)::VARCHAR AS annot_id, l_partkey AS point FROM lineitem WHERE l_discount > 0.05), nt AS (SELECT annot_id, count(*) AS n_gt FROM tr GROUP BY 1),
it AS (SELECT annot_id, node, count(*) AS inter FROM tr JOIN po USING (point) GROUP BY 1, 2),
s AS (SELECT kn.*, coalesce(inter / (n_gt + n_node - inter), 0) AS iou FROM kn LEFT JOIN nt USING (annot_id) LEFT JOIN it USING (annot_id, node)),
x AS (SELECT annot_id, node FROM (SELECT *, row_number() OVER (PARTITION BY annot_id ORDER BY iou DESC, k) AS r FROM s) WHERE r = 1)
SELECT annot_id, desc_id, node FROM la LEFT JOIN x USING (annot_id)""")
def best_of_candidates(spark, d):
    return _chosen(spark, d, True)


_SAID = "SELECT user_id AS query, event_id AS place, (event_id * 7) % 2100 AS id, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE ' ' || p_name END AS name, CASE WHEN event_id % 7 = 0 THEN 'y' ELSE p_type END AS type, value / 80 AS score FROM events LEFT JOIN part ON p_partkey = (event_id * 7) % 2100"


@query(f"""WITH s AS ({_SAID}), g AS (SELECT query, place, id, p_name AS name, p_type AS type, coalesce(least(greatest(score, 0), 1), 0) AS score FROM s JOIN part ON p_partkey = id WHERE trim(name) = p_name AND trim(type) = p_type),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, id ORDER BY score DESC, place) AS r FROM g) WHERE r = 1)
SELECT query, id, name, type, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS rank FROM o) WHERE rank <= 3""")
def checked_answers(spark, d):
    e, part = read(spark, d, "events"), read(spark, d, "part")
    said = e.withColumn("id", (F.col("event_id") * 7) % 2100).join(part.withColumnRenamed("p_partkey", "id"), "id", "left")
    said = said.select(F.col("user_id").alias("query"), F.col("event_id").alias("place"), "id", F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), F.when(F.col("event_id") % 7 == 0, "y").otherwise(F.col("p_type")).alias("type"), (F.col("value") / 80).alias("score"))
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return E.answers_checked(said, nodes, 3).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


_TOKENS = """tk AS (SELECT DISTINCT p_brand AS query, unnest([lower(substr(p_name, 1 + p_size % 3, 5)), lower(split_part(p_name, ' ', 1)) || ' ' || p_size::VARCHAR, CASE WHEN p_size = 7 THEN lower(p_name) ELSE '' END, CASE WHEN p_brand LIKE '%3' AND p_size = 9 THEN 'the socket opening' ELSE lower(substr(p_name, 2, 2)) END]) AS token FROM part),
nm AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 1 THEN 'socket ' ELSE '' END || lower(p_name) AS name FROM part)"""


@query(f"""WITH {_TOKENS}, wa AS (SELECT query, bool_or(contains(token, 'socket opening')) AS socket FROM tk GROUP BY 1),
q AS (SELECT query, token, socket FROM tk JOIN wa USING (query) WHERE token <> '' AND NOT (socket AND contains(token, 'opening')) UNION SELECT query, 'socket', socket FROM wa WHERE socket),
nn AS (SELECT DISTINCT name FROM nm), un AS (SELECT DISTINCT token FROM q),
sc AS (SELECT token, name, CASE WHEN token = name THEN 1.0 WHEN contains(name, token) THEN 0.85 ELSE 0.45 + 0.1 * len(list_intersect(string_split(token, ' '), string_split(name, ' '))) END::DOUBLE AS score FROM un, nn WHERE contains(name, token) OR len(list_intersect(string_split(token, ' '), string_split(name, ' '))) > 0),
b AS (SELECT query, name, max(score) AS score FROM q JOIN sc USING (token) WHERE NOT socket OR contains(name, 'socket') GROUP BY 1, 2)
SELECT query, id, round(score, 6) AS score, rank FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM b JOIN nm USING (name)) WHERE rank <= 3""")
def topk_candidates(spark, d):
    part = read(spark, d, "part")
    name, size = F.col("p_name"), F.col("p_size")
    tokens = F.array(F.lower(F.substring(name, 1 + size % 3, F.lit(5))), F.concat(F.lower(F.split(name, " ")[0]), F.lit(" "), size.cast("string")), F.when(size == 7, F.lower(name)).otherwise(""), F.when(F.col("p_brand").like("%3") & (size == 9), "the socket opening").otherwise(F.lower(F.substring(name, 2, 2))))
    queries = part.select(F.col("p_brand").alias("query"), F.explode(tokens).alias("token")).distinct()
    nodes = part.select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_partkey") % 40 == 1, "socket ").otherwise(""), F.lower(name)).alias("name"))
    return E.best_names(queries, nodes, 3).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})
