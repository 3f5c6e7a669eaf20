"""Scans and sinks over the driver's tables: rows go to files in the format a source reads, into the shared folder, and what
the source reads there is the result. The SQL gives the rows that went in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelyard.operators.iterative import shared_folder
from voxelyard.sources import files, images

from .scene_queries import query, read

W, H = 64, 48


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _one_text(rows: DataFrame, name: str) -> str:
    """Rows (k, value) as one text file in their order; the formats that take this are one file each by nature."""
    path = _folder(rows.sparkSession, name)
    rows.repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


def _by_scene(rows: DataFrame, name: str) -> str:
    """Rows (scene, value) as a text file for each scene."""
    path = _folder(rows.sparkSession, name)
    rows.select("scene", "value").write.partitionBy("scene").text(path)
    return path


def _scene(path: str = "path") -> Column:
    return F.regexp_extract(path, "/scene=([^/]+)/", 1).cast("long").alias("scene")


@query("""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS point_idx, round(embedding[1], 6)::FLOAT::DOUBLE AS x, round(embedding[2], 6)::FLOAT::DOUBLE AS y,
round(embedding[3], 6)::FLOAT::DOUBLE AS z, label * 20 AS r, (vec_id % 256)::INT AS g, 7 AS b FROM embeddings""")
def cloud_scan(spark, d):
    e = read(spark, d, "embeddings")
    points = e.select(F.col("vec_id").alias("point_idx"), *[F.col("embedding")[i].alias(c) for i, c in enumerate("xyz")], (F.col("label") * 20).alias("r"), (F.col("vec_id") % 256).cast("int").alias("g"), F.lit(7).alias("b"))
    files.write_ply(points, path := _folder(spark, "cloud"))
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/cloud.ply"))
    return files.read_points(spark, f"{path}/cloud.ply").select("point_idx", *[F.col(c).cast("double").alias(c) for c in "xyz"], *"rgb")


@query("""SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS frame_idx, (n_nationkey * 0.5)::DOUBLE AS ts, (n_nationkey * 0.25)::DOUBLE AS tx, n_regionkey::DOUBLE AS tz FROM nation""")
def trajectory_scan(spark, d):
    n = read(spark, d, "nation")
    line = F.concat_ws(" ", *[c.cast("string") for c in (F.col("n_nationkey") * F.lit(0.5), F.lit(0.0), F.lit(0.5), F.lit(0.0), F.col("n_nationkey") * F.lit(0.25), F.lit(1.0), F.col("n_regionkey"))])
    noise = n.select((F.col("n_nationkey") + 0.5).alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("# remark")).otherwise("").alias("value"))
    path = _one_text(n.select(F.col("n_nationkey").cast("double").alias("k"), line.alias("value")).unionByName(noise), "poses")
    return files.read_trajectory(spark, path).select("frame_idx", "ts", "tx", "tz")


@query("""SELECT n_nationkey::BIGINT AS scene, 640.0::DOUBLE AS w, (480 + n_regionkey)::DOUBLE AS h, (n_nationkey + 0.5)::DOUBLE AS fx, 320.0::DOUBLE AS cx FROM nation""")
def intrinsics_scan(spark, d):
    n = read(spark, d, "nation")
    line = F.format_string("640 %d  %.1f 500.0\n320 240", F.col("n_regionkey") + 480, F.col("n_nationkey") + F.lit(0.5).cast("double"))
    path = _by_scene(n.select(F.col("n_nationkey").alias("scene"), line.alias("value")), "intrinsics")
    return files.read_intrinsics(spark, path).select(_scene(), "w", "h", "fx", "cx")


@query("""SELECT p_name AS line, (min(k) - 1)::INT AS line_no FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS k FROM part) GROUP BY 1""")
def list_scan(spark, d):
    p = read(spark, d, "part")
    return files.read_list(spark, _one_text(p.select(F.col("p_partkey").alias("k"), F.concat(F.lit("  "), "p_name").alias("value")), "list")).select("line", "line_no")


@query("""SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS line_no, p_size::BIGINT AS number FROM part""")
def number_scan(spark, d):
    p = read(spark, d, "part")
    return files.read_numbers(spark, _one_text(p.select(F.col("p_partkey").alias("k"), F.format_string("size %d of 99", "p_size").alias("value")), "numbers")).select("line_no", "number")


@query("""SELECT lower(p_name) AS text, arg_min(p_size, p_partkey)::BIGINT AS id FROM part GROUP BY 1""")
def predicted_id_scan(spark, d):
    p = read(spark, d, "part")
    line = F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit("\t")).otherwise(" , "), F.col("p_size"))
    return files.read_predicted_ids(spark, _one_text(p.select(F.col("p_partkey").alias("k"), line.alias("value")), "ids")).select("text", "id")


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row_index, c_custkey::VARCHAR AS scene_id, c_name || ', "' || c_mktsegment || '"' AS description_prompt FROM customer""")
def prompt_scan(spark, d):
    c = read(spark, d, "customer")
    rows = c.select("c_custkey", F.col("c_custkey").cast("string").alias("scene_id"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("description_prompt"))
    rows.repartition(1).sortWithinPartitions("c_custkey").drop("c_custkey").write.csv(path := _folder(spark, "prompts"), header=True, escape='"')
    return files.read_prompts(spark, path, ["scene_id", "description_prompt"]).select("_row_index", "scene_id", "description_prompt")


@query("""SELECT l_suppkey % 25 AS scene, (l_suppkey // 25)::VARCHAR || l_returnflag AS annot_id, 'l' || l_returnflag AS label, l_partkey AS point_idx FROM lineitem""")
def annotation_scan(spark, d):
    a = read(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.collect_list("l_partkey").alias("indices"))  # an annotation is one object of its file
    one = F.struct(F.concat(F.floor(F.col("l_suppkey") / 25), "l_returnflag").alias("annot_id"), F.concat(F.lit("l"), "l_returnflag").alias("label"), "indices")
    rows = a.groupBy((F.col("l_suppkey") % 25).alias("scene")).agg(F.collect_list(one).alias("annotations")).select("scene", F.to_json(F.struct("annotations")).alias("value"))
    return files.read_annotations(spark, _by_scene(rows, "annotations")).select(_scene(), "annot_id", "label", "point_idx")


@query("""SELECT c_nationkey::BIGINT AS scene, c_custkey::VARCHAR AS desc_id, c_mktsegment AS annot, 't' || c_custkey::VARCHAR AS text FROM customer""")
def description_scan(spark, d):
    c = read(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    said = F.concat(F.lit("t"), "c_custkey")
    one = F.struct(F.col("c_custkey").cast("string").alias("desc_id"), F.col("c_mktsegment").alias("annot_id"), F.when(even, said).alias("prompt"), F.when(even, F.lit("later")).otherwise(said).alias("sentence"))
    rows = c.groupBy(F.col("c_nationkey").alias("scene")).agg(F.collect_list(one).alias("descriptions")).select("scene", F.to_json(F.struct("descriptions")).alias("value"))
    return files.read_descriptions(spark, _by_scene(rows, "descriptions")).select(_scene(), "desc_id", F.col("annot_ids")[0].alias("annot"), "text")


@query("""SELECT o_custkey % 25 AS scene, trim(o_orderpriority) AS text, o_orderkey AS candidate FROM orders""")
def prediction_scan(spark, d):
    o = read(spark, d, "orders")
    one = F.struct(F.col("o_orderpriority").alias("instruction"), F.array(F.col("o_orderkey").cast("string"), F.lit("no id")).alias("candidate_ids"))
    rows = o.groupBy((F.col("o_custkey") % 25).alias("scene")).agg(F.collect_list(one).alias("results")).select("scene", F.to_json(F.struct("results")).alias("value"))
    return files.read_predictions(spark, _by_scene(rows, "predictions")).select(_scene(), "text", F.explode("candidates").alias("candidate"))


@query("""SELECT s_nationkey::BIGINT AS scene, s_suppkey::VARCHAR AS annot_id, s_name AS prompt_used, s_acctbal AS score, s_nationkey AS frame FROM supplier""")
def best_mask_scan(spark, d):
    s = read(spark, d, "supplier")
    one = F.struct(F.col("s_suppkey").cast("string"), F.struct(F.col("s_name").alias("prompt_used"), F.col("s_acctbal").alias("score"), F.col("s_nationkey").alias("frame")))
    rows = s.groupBy(F.col("s_nationkey").alias("scene")).agg(F.map_from_entries(F.collect_list(one)).alias("m")).select("scene", F.to_json("m").alias("value"))
    return files.read_best_masks(spark, _by_scene(rows, "masks")).select(_scene(), "annot_id", "prompt_used", "score", "frame")


@query("""SELECT c_nationkey::BIGINT AS scene, c_nationkey AS frame, c_acctbal AS x0, c_custkey::DOUBLE AS x1 FROM customer WHERE c_custkey % 3 = 1""")
def box_scan(spark, d):
    """Odd scenes are written in the older shape."""
    c = read(spark, d, "customer")
    box = F.struct(F.array(F.col("c_acctbal"), F.lit(0.0), F.col("c_custkey").cast("double"), F.lit(1.0)).alias("bbox"), (F.col("c_custkey") % 3).cast("int").alias("label"))
    frames = c.groupBy("c_nationkey").agg(F.array(F.struct(F.col("c_nationkey").cast("string").alias("frame_index"), F.create_map(F.lit("door"), F.collect_list(box)).alias("objects"))).alias("frames"))
    shape = F.when(F.col("c_nationkey") % 2 == 1, F.to_json(F.struct(F.array(F.struct("frames")).alias("scenes")))).otherwise(F.to_json(F.struct("frames")))
    path = _by_scene(frames.select(F.col("c_nationkey").alias("scene"), shape.alias("value")), "boxes")
    return files.read_boxes(spark, path).select(_scene(), "frame", "x0", "x1")


_PIXELS = f"SELECT l_suppkey % 25 AS frame, ((l_partkey * 7) % {W * H})::BIGINT AS pixel, max(l_linenumber * 30)::INT AS value FROM lineitem GROUP BY 1, 2"


def _frames(spark, d, name):
    """A picture for each frame, in a folder of its number."""
    px = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("frame"), ((F.col("l_partkey") * 7) % (W * H)).alias("pixel")).agg(F.max(F.col("l_linenumber") * 30).alias("value"))
    path = _folder(spark, name)
    images.write_files(images.png_files(px, ["frame"], W, H).select(F.format_string("%d/a.png", "frame").alias("name"), "content"), path)
    return path


@query(f"SELECT frame, pixel, value FROM ({_PIXELS}) WHERE value >= 60")
def mask_scan(spark, d):
    at = F.regexp_extract("path", r"/([0-9]+)/a\.png$", 1).cast("long")
    return images.read_masks(spark, f"{_frames(spark, d, 'masks')}/*/a.png", 60).select(at.alias("frame"), "pixel", "value")


@query(f"SELECT frame, {W * H}::BIGINT AS pixels, sum(value)::DOUBLE AS raw, max(value)::DOUBLE AS most FROM ({_PIXELS}) GROUP BY 1")
def depth_scan(spark, d):
    px = images.read_depth(spark, f"{_frames(spark, d, 'depth')}/*/a.png")
    at = F.regexp_extract("path", r"/([0-9]+)/a\.png$", 1).cast("long")
    return px.groupBy(at.alias("frame")).agg(F.count("pixel").alias("pixels"), F.sum("raw").cast("double").alias("raw"), F.max("raw").cast("double").alias("most"))


@query("SELECT DISTINCT (l_suppkey % 25)::INT AS frame FROM lineitem")
def frame_listing(spark, d):
    return spark.createDataFrame([(n,) for n in files.frame_folders(spark, _frames(spark, d, "listing"))], "frame int")  # folders of one scene


@query("SELECT (l_suppkey % 25)::INT AS frame, count(*)::INT AS mask_count FROM lineitem GROUP BY 1")
def count_sink(spark, d):
    counts = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 25).cast("int").alias("frame")).agg(F.count(F.lit(1)).cast("int").alias("mask_count"))
    files.write_counts(counts, path := _folder(spark, "counts"))
    return spark.read.csv(path, sep=":", schema="frame int, mask_count int")


@query("SELECT event_id, event_type, value FROM events")
def jsonl_sink(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", "value")
    files.write_jsonl(e, path := _folder(spark, "jsonl"))
    return spark.read.schema(e.schema).json(path)


@query("SELECT o_orderkey, o_orderpriority AS annot_id FROM orders")
def annotation_sink(spark, d):
    files.write_by_annotation(read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("annot_id")), path := _folder(spark, "parts"))
    return spark.read.parquet(path).select("o_orderkey", "annot_id")


@query("SELECT o_orderkey, coalesce(o_totalprice > 150000, false) AS kept FROM orders")
def routed_rows(spark, d):
    o, base = read(spark, d, "orders"), _folder(spark, "routed")
    files.route(o, F.col("o_totalprice") > 150000, f"{base}/kept", f"{base}/dropped")
    return spark.read.parquet(f"{base}/kept").select("o_orderkey", F.lit(True).alias("kept")).unionByName(spark.read.parquet(f"{base}/dropped").select("o_orderkey", F.lit(False).alias("kept")))
