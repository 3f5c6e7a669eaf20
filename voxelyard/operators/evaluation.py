"""Evaluation of predicted nodes against annotations: instructions to annotations, matching, precision and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterative import greedy_match
from .relational import nearest

THRESHOLDS = [t / 100 for t in range(50, 100, 5)]


def average_precision(matched: DataFrame, preds: DataFrame, truths: DataFrame, group: list[str]) -> DataFrame:
    """(group, n_gt, tp, ap): area under the precision envelope. preds (group, pred, score) are ranked by score, then pred;
    matched (group, pred) are those that took a truth; truths (group, n_gt) has a row for each group."""
    up = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("pred").asc())
    down = Window.partitionBy(*group).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    hits = preds.join(matched.select(*group, "pred").withColumn("hit", F.lit(1)), [*group, "pred"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    ranked = hits.withColumn("rank", F.row_number().over(up)).withColumn("tp", F.sum("hit").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    shaped = ranked.withColumn("envelope", F.max(F.col("tp") / F.col("rank")).over(down))
    area = shaped.groupBy(*group).agg(F.sum(F.col("hit") * F.col("envelope")).alias("area"), F.sum("hit").alias("tp"))
    return truths.join(area, group, "left").select(*group, "n_gt", F.coalesce("tp", F.lit(0)).alias("tp"), F.when(F.col("n_gt") > 0, F.coalesce("area", F.lit(0.0)) / F.col("n_gt")).otherwise(0.0).alias("ap"))


def map_over_thresholds(pairs: DataFrame, preds: DataFrame, truths: DataFrame, scene: str, thresholds: list[float] = THRESHOLDS, single: tuple = (0.5, 0.25)) -> DataFrame:
    """(scene, map, ap50, ap25) of pairs (scene, pred, gt, score, iou). At each threshold predictions take their best free
    truth in the order of their scores; map is the mean over thresholds."""
    every = sorted({*thresholds, *single})
    t = F.explode(F.array(*[F.lit(x) for x in every]))
    at = pairs.withColumn("thr", t).filter(F.col("iou") >= F.col("thr"))
    at = at.withColumn("_g", F.struct(scene, "thr"))
    key = F.concat_ws("|", F.col(scene).cast("string"), F.col("thr").cast("string"))
    matched = greedy_match(at.withColumn("_g", key), "_g", "pred", "gt", 0.0)
    names = preds.withColumn("thr", t).withColumn("_g", key)
    counts = truths.withColumn("thr", t).withColumn("_g", key)
    ap = average_precision(matched, names.select("_g", "pred", "score"), counts.select("_g", "n_gt"), ["_g"]).join(counts.select("_g", scene, "thr"), "_g")
    return ap.groupBy(scene).agg(F.avg(F.when(F.col("thr").isin(*thresholds), F.col("ap"))).alias("map"), *[F.max(F.when(F.col("thr") == x, F.col("ap"))).alias(f"ap{round(x * 100)}") for x in single])


def instruction_targets(instructions: DataFrame, descriptions: DataFrame) -> DataFrame:
    """instructions (text, ...) with desc_id and annot_ids of the first description (desc_id, place, text, annot_ids) of
    the same text, compared without case and with blanks folded; ``miss`` says what is lacking, null if nothing."""
    from voxelyard.functions.text import folded

    key = lambda c: F.lower(folded(c))
    first = nearest(descriptions.filter(F.col("text").isNotNull() & (F.trim("text") != "")).withColumn("_k", key(F.col("text"))), ["_k"], [F.col("place").asc()]).select("_k", "desc_id", "annot_ids")
    out = instructions.withColumn("_k", key(F.col("text"))).join(first, "_k", "left").drop("_k")
    return out.withColumn("miss", F.when(F.col("desc_id").isNull(), "instruction").when(F.coalesce(F.size("annot_ids"), F.lit(0)) < 1, "annotation"))


def chosen_nodes(targets: DataFrame, node_points: DataFrame, truth: DataFrame, best_of: bool) -> DataFrame:
    """(annot_id, desc_id, node): the node predicted for each annotation of targets (desc_id, annot_ids, candidates): the
    first candidate that has points, or with best_of the first of greatest IoU among them. node is null where no
    candidate has points. A later instruction (by place) of an annotation replaces an earlier one. node_points is
    (node, point), truth (annot_id, point), both distinct."""
    wanted = targets.select("place", "desc_id", F.explode("annot_ids").alias("annot_id"), "candidates").filter(F.trim("annot_id") != "")
    last = nearest(wanted, ["annot_id"], [F.col("place").desc()])
    named = last.select("annot_id", "desc_id", F.posexplode_outer("candidates").alias("k", "node"))
    sizes = node_points.groupBy("node").agg(F.count(F.lit(1)).alias("n_node"))
    known = named.join(sizes, "node", "left_semi")
    if best_of:
        n_true = truth.groupBy("annot_id").agg(F.count(F.lit(1)).alias("n_gt"))
        inter = truth.join(known.select("annot_id", "node").distinct(), "annot_id").join(node_points, ["node", "point"]).groupBy("annot_id", "node").agg(F.count(F.lit(1)).alias("inter"))
        known = known.join(sizes, "node").join(n_true, "annot_id", "left").join(inter, ["annot_id", "node"], "left")
        iou = F.coalesce(F.col("inter") / (F.col("n_gt") + F.col("n_node") - F.col("inter")), F.lit(0.0))
        picked = nearest(known.withColumn("_iou", iou), ["annot_id"], [F.when(F.col("n_gt").isNull(), 0.0).otherwise(F.col("_iou")).desc(), F.col("k").asc()])
    else:
        picked = nearest(known, ["annot_id"], [F.col("k").asc()])
    return last.select("annot_id", "desc_id").join(picked.select("annot_id", "node"), "annot_id", "left")


def answers_checked(answers: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(query, id, name, type, score, rank) of answers (query, place, id, name, type, score) whose id is a node's and whose
    name and type are that node's; by score, then place, each id once, ``most`` at most."""
    true = nodes.select("id", F.col("name").alias("_n"), F.col("type").alias("_t"))
    good = answers.join(true, "id").filter(F.trim("name").eqNullSafe(F.col("_n")) & F.trim("type").eqNullSafe(F.col("_t")))
    score = F.coalesce(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    once = nearest(good.withColumn("score", score), ["query", "id"], [F.col("score").desc(), F.col("place").asc()])
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("place").asc())
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query", "id", F.col("_n").alias("name"), F.col("_t").alias("type"), "score", "rank")


def best_names(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank): the ``k`` best nodes of each query's tokens, by name: 1 for an equal name, 0.85 for a name
    that holds the token, else 0.45 and 0.1 for each word in common; ties by id. Nodes meet a query by a word in
    common, or by a token's three-letter pieces (all of them), so names are never compared in all pairs. A query
    that wants a socket opening takes sockets only. queries is (query, token), nodes (id, name), both as compared."""
    wants = queries.groupBy("query").agg(F.max(F.contains("token", F.lit("socket opening"))).alias("socket"))
    q = queries.join(wants, "query")
    q = q.filter("not (socket and token like '%opening%')").unionByName(wants.filter("socket").withColumn("token", F.lit("socket")).select(*q.columns)).filter("token <> ''").distinct()
    pieces = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    tokens, names = q.select("token").distinct(), nodes.select("name").filter("name is not null and name <> ''").distinct()
    # all pieces of a token stand in a name that holds it; the rarest is enough, and it is looked up
    held = names.select("name", F.explode(F.array_distinct(pieces(F.col("name")))).alias("piece"))
    often = held.groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
    asked = tokens.filter(F.length("token") >= 3).select("token", F.explode(F.array_distinct(pieces(F.col("token")))).alias("piece")).join(often, "piece")
    rare = nearest(asked, ["token"], [F.col("often").asc(), F.col("piece").asc()]).select("token", "piece")
    inside = rare.join(held, "piece").filter(F.contains("name", F.col("token"))).select("token", "name")
    short = tokens.filter(F.length("token") < 3)  # a handful of letters and pairs
    if short.limit(1).count():
        two = lambda c: F.array_union(F.split(c, ""), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
        inside = inside.union(names.select("name", F.explode(F.array_distinct(two(F.col("name")))).alias("token")).join(short, "token").select("token", "name"))
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("word")).filter("word <> ''")
    shared = words(tokens, "token").join(words(names, "name"), "word").groupBy("token", "name").agg(F.count(F.lit(1)).alias("common"))
    score = F.when(F.col("token") == F.col("name"), 1.0).when(F.col("held"), 0.85).otherwise(0.45 + 0.1 * F.col("common"))
    both = shared.join(inside.distinct().withColumn("held", F.lit(True)), ["token", "name"], "full").withColumn("held", F.coalesce("held", F.lit(False)))
    best = q.join(both.withColumn("score", score), "token").groupBy("query", "socket", "name").agg(F.max("score").alias("score")).filter("not socket or name like '%socket%'")
    # of a name's nodes only the first k can be among the best
    w = Window.partitionBy("name").orderBy("id")
    few = nodes.select("id", "name").distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    ranked = best.join(few, "name").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id")))
    return ranked.filter(F.col("rank") <= k).select("query", "id", "score", "rank")


def point_count(*sets: DataFrame) -> int:
    """One more than the greatest point of some (point) tables; 1 where there is none above 0."""
    most = 0
    for s in sets:
        most = max(most, s.agg(F.max("point").alias("m")).first()["m"] or 0)
    return most + 1 if most > 0 else 1
