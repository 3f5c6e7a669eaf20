"""Scene files as DataFrames and back. Files are found and read by Spark's readers, so any store that
Spark reaches will do; a cloud or image is decoded in the task that read its bytes."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelyard.functions.boxes import is_rotation
from voxelyard.functions.geometry import rodrigues
from voxelyard.functions.text import folded, natural_key

POINTS = "path string, point_idx long, x float, y float, z float, r int, g int, b int"
CHUNK = 200_000  # points of a batch

#: The scalar types of the PLY format and its colour names.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2",
    "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4",
    "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
PLY_COLOURS = {"r": "red", "g": "green", "b": "blue"}
#: An archive's array names, first match first.
ARRAY_NAMES = ("points", "xyz", "pcd")


def _ply_header(blob: bytes) -> tuple[str, int, list[tuple[str, str]], int]:
    """Format, vertex count, vertex properties, and where the vertices begin; elements before them are skipped, which
    takes properties of fixed size in a binary file."""
    end = blob.index(b"end_header")
    body = blob.index(b"\n", end) + 1
    kind, count, props, inside, before = "", None, [], False, []
    for words in (line.split() for line in blob[:end].decode("ascii").splitlines()):
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            if count is None and not inside:
                before.append([int(words[2]), 0])
            count = int(words[2]) if inside else count
        elif inside and words[:1] == ["property"]:
            if words[1] == "list":
                raise ValueError("a vertex can't have a list property")
            props.append((words[2], PLY_TYPES[words[1]]))
        elif before and count is None and words[:1] == ["property"]:
            before[-1][1] += np.dtype(PLY_TYPES[words[1]]).itemsize if words[1] != "list" else 1 << 60
    if count is None:
        raise ValueError("a PLY file without vertices")
    for n, size in before:
        if kind == "ascii":
            for _ in range(n):
                body = blob.index(b"\n", body) + 1
        elif n and size >= 1 << 60:
            raise ValueError("an element with lists before the vertices")
        else:
            body += n * size
    return kind, count, props, body


def vertex_count(blob: bytes) -> int:
    return _ply_header(blob)[1]


def decode_ply(blob: bytes) -> np.ndarray:
    """Vertices as records named by property."""
    kind, count, props, at = _ply_header(blob)
    if kind == "ascii":
        lines = (line.split() for line in blob[at:].decode("ascii").splitlines()[:count])
        full = [tuple(map(float, x[: len(props)])) for x in lines if len(x) >= len(props)]  # short lines are left out
        return np.array(full, [(n, "f8") for n, _ in props])
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}[kind]
    return np.frombuffer(blob, np.dtype([(n, order + t) for n, t in props]), count, at)


def decode_points(path: str, blob: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(N, 3) coordinates and colours of a .npy, .npz or .ply file; N is over 0."""
    colour, ending = None, path.rsplit(".", 1)[-1].lower()
    if ending == "ply":
        v = decode_ply(blob)
        xyz = np.stack([v[c].astype("f4") for c in "xyz"], axis=1)
        for names in (tuple(PLY_COLOURS.values()), tuple(PLY_COLOURS)):
            if set(names) <= set(v.dtype.names):
                colour = np.stack([v[c].astype("i4") for c in names], axis=1)
                break
    else:
        got = np.load(io.BytesIO(blob), allow_pickle=False)
        xyz = got if ending == "npy" else next(got[n] for n in (*ARRAY_NAMES, *got.files) if n in got.files)
    if xyz.ndim != 2 or xyz.shape[1] != 3 or not len(xyz):
        raise ValueError(f"{path} holds no points: {xyz.shape}")
    return xyz.astype("f4"), colour


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of clouds; point_idx is a point's place in its file. Files without colours have nulls."""

    def run(batches):
        for b in batches:
            for name, blob in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                xyz, colour = decode_points(name, blob)
                for s in range(0, len(xyz), CHUNK):
                    n = len(part := xyz[s : s + CHUNK])
                    rgb = [pa.array(colour[s : s + n, i], pa.int32()) if colour is not None else pa.nulls(n, pa.int32()) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(s, s + n)), *[pa.array(part[:, i], pa.float32()) for i in range(3)], *rgb], names=["path", "point_idx", "x", "y", "z", "r", "g", "b"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, POINTS)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line), trimmed, without empty lines and remarks; files are read whole, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def _numbers(line: Column, n: int, what: str) -> Column:
    """n numbers of a line, or an error."""
    parts = F.split(line, r"\s+")
    return F.when(F.size(parts) == n, F.transform(parts, lambda x: x.cast("double"))).otherwise(F.raise_error(F.concat(F.lit(f"{what}: {n} fields expected: "), line)))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_idx, ts, ax, ay, az, tx, ty, tz): frames in file order, 7 fields each."""
    rows = _lines(spark, path).withColumn("v", _numbers(F.col("line"), 7, "pose"))
    ordered = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "v"))).alias("rows"))  # one file's frames
    each = ordered.select("path", F.posexplode("rows").alias("frame_idx", "row"))
    return each.select("path", "frame_idx", *[F.col("row.v")[i].alias(c) for i, c in enumerate(("ts", "ax", "ay", "az", "tx", "ty", "tz"))])


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, h, fx, fy, cx, cy): 6 numbers a file; sizes and focal lengths are positive."""
    v = _numbers(F.array_join("words", " "), 6, "intrinsics")
    rows = _lines(spark, path).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rows"))  # a file's few lines
    rows = rows.select("path", F.flatten(F.transform("rows", lambda x: F.split(x["line"], r"\s+"))).alias("words")).withColumn("v", v)
    good = F.forall(F.slice("v", 1, 4), lambda x: x > 0)
    rows = rows.withColumn("v", F.when(good, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("intrinsics must be positive: "), F.col("path")))))
    return rows.select("path", *[F.col("v")[i].alias(c) for i, c in enumerate(("w", "h", "fx", "fy", "cx", "cy"))])


def checked_poses(poses: DataFrame) -> DataFrame:
    """Poses (see read_trajectory) with their rotation r00 to r22; one that isn't close to orthogonal is an error."""
    r = rodrigues(F.col("ax"), F.col("ay"), F.col("az"))
    ok = is_rotation(r)
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    return poses.select("*", *[F.when(ok, c).otherwise(F.raise_error(F.concat(F.lit("not a rotation: "), F.col("path")))).alias(n) for n, c in zip(names, r, strict=True)])


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): the first of each text of a file."""
    return _lines(spark, path).groupBy("path", "line").agg(F.min("line_no").alias("line_no")).select("path", "line_no", "line")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, number): the first whole number of each line that has one."""
    n = F.regexp_extract("line", "([0-9]+)", 1)
    return _lines(spark, path).filter(n != "").select("path", "line_no", n.cast("long").alias("number"))


def read_predicted_ids(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, text, id) of a file with an id a line (text is null; an empty line is -1), or a text and an id between
    a tab or a comma, the first line of a text counting; any other line is an error. If a file has texts at all,
    its bare ids are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = whole.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    bare = F.when(F.col("line") == "", F.lit(-1)).when(F.regexp_like("line", F.lit("^[+-]?[0-9]+$")), F.col("line").try_cast("long"))
    tab = F.contains("line", F.lit("\t"))
    said, number = F.trim(F.regexp_extract("line", r"^(.*)[\t,]([^\t,]*)$", 1)), F.trim(F.when(tab, F.substring_index("line", "\t", -1)).otherwise(F.substring_index("line", ",", -1)))
    said = F.when(tab, F.trim(F.regexp_extract("line", r"^(.*)\t", 1))).otherwise(said)
    bad = F.raise_error(F.concat(F.lit("neither an id nor a text with one: "), F.col("line"))).cast("long")
    rows = rows.withColumn("text", F.when(bare.isNull(), plain_text(said))).withColumn("id", F.coalesce(bare, F.when((said != "") & F.regexp_like(number, F.lit("^[+-]?[0-9]+$")), number.try_cast("long")).otherwise(bad)))
    texts = rows.filter("text is not null")
    first = texts.groupBy("path", "text").agg(F.min(F.struct("line_no", "id")).alias("m")).select("path", "m.line_no", "text", "m.id")
    alone = rows.filter("text is null").join(texts.select("path").distinct(), "path", "left_anti").select("path", "line_no", "text", "id")
    return first.unionByName(alone)


def plain_text(c: Column) -> Column:
    """Lower case, blanks folded: how instructions are compared."""
    return F.lower(folded(c))


def read_prompts(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """A CSV file with a header, all text, with ``_row_index`` in the order of its rows; columns that must be there are
    checked. A file is one task's, as its rows may run over lines."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if lacking := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"{path} lacks columns {lacking}")
    return rows.withColumn("_row_index", F.monotonically_increasing_id())  # a file's rows are one partition, in order


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


#: Where a description's text may stand, the first that is there counting.
TEXT_KEYS = ("original_prompt", "description_prompt", "prompt", "text", "description", "sentence", "instruction")


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, desc_id, annot_ids, text): annot_id may be a text or a list; rows without desc_id are left out."""
    shape = f"descriptions array<struct<desc_id string, annot_id string, {', '.join(f'{k} string' for k in TEXT_KEYS)}>>"
    rows = _json(spark, path, shape).select("path", F.posexplode("descriptions").alias("place", "d")).filter(F.trim("d.desc_id") != "")
    one = F.trim("d.annot_id")
    ids = F.when(one.isNull(), F.array().cast("array<string>")).when(one.startswith("["), F.from_json(one, "array<string>")).otherwise(F.array(one))
    text = F.coalesce(*[F.nullif(F.trim(f"d.{k}"), F.lit("")) for k in TEXT_KEYS])
    return rows.select("path", "place", F.trim("d.desc_id").alias("desc_id"), F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != "").alias("annot_ids"), text.alias("text"))


def read_point_indices(spark: SparkSession, path: str) -> DataFrame:
    """(path, node, type, name, inst_id, point_idx): a row for each point of a node; nodes without a whole id or a list are
    left out."""
    rows = _json(spark, path, "node_point_indices array<struct<id string, type string, name string, inst_id string, point_indices array<bigint>>>").select("path", F.explode("node_point_indices").alias("n"))
    rows = rows.withColumn("node", F.col("n.id").try_cast("long")).filter("node is not null and n.point_indices is not null")
    return rows.select("path", "node", F.lower(F.trim("n.type")).alias("type"), F.lower(F.trim("n.name")).alias("name"), F.trim("n.inst_id").alias("inst_id"), F.explode_outer("n.point_indices").alias("point_idx"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, text, candidates): ids that are no whole numbers, and rows without instruction, are left out."""
    rows = _json(spark, path, "results array<struct<instruction string, candidate_ids array<string>>>").select("path", F.posexplode("results").alias("place", "r"))
    ids = F.filter(F.transform(F.coalesce("r.candidate_ids", F.array().cast("array<string>")), lambda x: F.when(F.regexp_like(x, F.lit("^-?[0-9]+$")), x.try_cast("long"))), lambda x: x.isNotNull())
    return rows.filter(F.trim("r.instruction") != "").select("path", "place", F.trim("r.instruction").alias("text"), ids.alias("candidates"))


def read_best_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, annot_id, prompt_used, prompt_slug, score, frame, mask_png): a file is an object by annotation."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    shape = "map<string, struct<prompt_used string, prompt_slug string, score double, frame int, mask_png string>>"
    return whole.select("path", F.explode(F.from_json("value", shape)).alias("annot_id", "m")).select("path", "annot_id", "m.*")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, x0, y0, x1, y1) of boxes labelled 1, from either shape of the file: frames of scenes, or frames."""
    frame = "array<struct<frame_index string, objects map<string, array<struct<bbox array<double>, label int>>>>>"
    rows = _json(spark, path, f"scenes array<struct<frames {frame}>>, frames {frame}")
    every = F.when(F.col("scenes").isNotNull(), F.flatten(F.transform("scenes", lambda s: F.coalesce(s["frames"], F.array().cast(frame))))).otherwise(F.col("frames"))
    rows = rows.select("path", F.explode(every).alias("f")).filter("f.frame_index is not null").select("path", F.col("f.frame_index").cast("int").alias("frame"), F.explode(F.flatten(F.map_values("f.objects"))).alias("o"))
    return rows.filter("o.label = 1 and size(o.bbox) = 4").select("path", "frame", *[F.col("o.bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, annot_id, label, point_idx): a row for each annotated point."""
    shape = "annotations array<struct<annot_id string, label string, indices array<bigint>>>"
    rows = spark.read.schema(shape).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.explode("annotations").alias("a"))
    return rows.select("path", "a.annot_id", "a.label", F.explode_outer("a.indices").alias("point_idx"))


NODE = "struct<id bigint, type string, name string, inst_id string, names array<string>, position array<double>, belong_to bigint, parent_id bigint>"
#: Fields of a node that the compact forms keep.
COMPACT = {"basic": ["id", "type", "name", "parent_id"], "more": ["id", "type", "name", "parent_id", "position", "names", "inst_id"]}


def read_graph(spark: SparkSession, path: str, mode: str = "full") -> DataFrame:
    """A row for each node of a graph's JSON file, an object with nodes or a list of them; ``basic`` and ``more`` keep some
    fields only."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.startswith(F.ltrim("value"), F.lit("["))
    scene = F.when(~listed, F.get_json_object("value", "$.scene_id"))
    nodes = F.when(listed, F.from_json("value", f"array<{NODE}>")).otherwise(F.from_json("value", f"struct<nodes array<{NODE}>>")["nodes"])
    rows = whole.select(scene.alias("scene_id"), F.explode(nodes).alias("n")).select("scene_id", "n.*")
    return rows if mode == "full" else rows.select("scene_id", *COMPACT[mode])


# ------------------------------------------------------------------ finding files
#: What an ending and a word in its name say for a file being the scene's cloud.
CLOUD_ENDINGS = {"ply": 5, "pcd": 5, "npz": 4, "npy": 1}
CLOUD_WORDS = {"laser": 5, "scan": 4, "point": 3, "pcd": 3, "cloud": 2}
NO_CLOUD = ("_transform", "pose", "traj", "intrinsic")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files under a folder, by Spark's lister; their bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def cloud_files(files: DataFrame, root: str) -> DataFrame:
    """(path, score, depth) of clouds that lie in a scene's folder (depth 0) or a sequence's (1)."""
    name = F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    ending = F.regexp_extract(name, r"[.]([a-z]+)$", 1)
    inner = F.regexp_replace(F.substring_index("path", f"{root.rstrip('/')}/", -1), "[^/]+$", "")
    score = sum((F.when(ending == e, s).otherwise(0) for e, s in CLOUD_ENDINGS.items()), F.lit(0)) + sum((F.when(F.contains(name, F.lit(w)), s).otherwise(0) for w, s in CLOUD_WORDS.items()), F.lit(0))
    score = score - F.when(F.contains(name, F.lit("color")) | F.contains(name, F.lit("rgb")), 1).otherwise(0)
    odd = (ending == "npy") & F.regexp_like(name, F.lit("|".join(NO_CLOUD)))
    depth = F.length(inner) - F.length(F.replace(inner, F.lit("/"), F.lit("")))
    return files.filter(ending.isin(*CLOUD_ENDINGS) & ~odd).select("path", score.alias("score"), depth.alias("depth"))


def find_cloud(spark: SparkSession, root: str) -> str | None:
    """The best cloud of a scene's folder, or of its first sequence's."""
    found = cloud_files(list_files(spark, root), root)
    sequence = first_sequence(spark, root)
    if sequence:
        found = found.filter((F.col("depth") == 0) | F.contains("path", F.lit(f"/{sequence}/")))
    best = found.filter("depth <= 1").orderBy("depth", F.desc("score"), natural_key(F.regexp_extract("path", "([^/]+)$", 1))).select("path").first()
    return best["path"] if best else None


def first_sequence(spark: SparkSession, root: str) -> str | None:
    """The first numbered folder by its number, or else the first by name."""
    inner = F.regexp_extract(F.substring_index("path", f"{root.rstrip('/')}/", -1), "^([^/]+)/", 1)
    names = list_files(spark, root).select(inner.alias("name")).filter("name <> ''").distinct()
    best = names.orderBy(F.regexp_like("name", F.lit("^[0-9]+$")).desc(), natural_key(F.col("name"))).first()
    return best["name"] if best else None


def find_json(spark: SparkSession, root: str, name: str, key: str, unique: bool = True) -> str:
    """The path of a scene's JSON file: the only one of that name, or else the only one whose object has that key. Without
    ``unique`` the first of the name will do. None or several is an error."""
    files = list_files(spark, root).filter(F.lower("path").endswith(".json"))
    named = [r["path"] for r in files.filter(F.regexp_extract("path", "([^/]+)$", 1) == name).orderBy(natural_key(F.col("path"))).limit(2).collect()]
    if named and (len(named) == 1 or not unique):
        return named[0]
    if not named and unique:
        texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        named = [r["path"] for r in texts.filter(F.array_contains(F.json_object_keys("value"), key)).select("path").limit(2).collect()]
        if len(named) == 1:
            return named[0]
    raise ValueError(f"{'several' if named else 'no'} files {name} (or with {key}) under {root}")


def frame_folders(spark: SparkSession, root: str) -> list[int]:
    """Numbers of a masks folder's frames; [0] where its files lie flat."""
    inner = F.regexp_extract(F.substring_index("path", f"{root.rstrip('/')}/", -1), "^([0-9]+)/", 1)
    found = list_files(spark, root).select(inner.alias("n")).filter("n <> ''").distinct().collect()
    return sorted(int(r["n"]) for r in found) or [0]


def strided(frames: DataFrame, scene: str, frame: str, stride: int, most: int | None = None, strict: bool = True) -> DataFrame:
    """Every stride-th frame of a scene by place; frames of ``most`` or beyond are an error, or left out if not strict."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(scene).orderBy(frame)) - 1
    out = frames.withColumn("_k", k).filter(F.col("_k") % stride == 0).drop("_k")
    if most is None:
        return out
    inside = (F.col(frame) >= 0) & (F.col(frame) < most)
    if not strict:
        return out.filter(inside)
    return out.withColumn(frame, F.when(inside, F.col(frame)).otherwise(F.raise_error(F.concat(F.lit("a frame out of range: "), F.col(frame))).cast("int")))


# ------------------------------------------------------------------ sinks
def write_ply(points: DataFrame, path: str) -> None:
    """Points (point_idx, x, y, z, r, g, b) as one ASCII PLY file in a folder, in their order. One file is one task's, which
    sorts and writes row by row; clouds that are to stay in parts are better kept as a table."""
    n = points.count()
    names = [f"property float {c}" for c in "xyz"] + [f"property uchar {c}" for c in PLY_COLOURS.values()]
    header = "\n".join(["ply", "format ascii 1.0", f"element vertex {n}", *names, "end_header"])
    body = points.select("point_idx", F.format_string("%.6f %.6f %.6f %d %d %d", *[F.col(c).cast("double") for c in "xyz"], *[F.coalesce(F.col(c), F.lit(0)) for c in "rgb"]).alias("value"))
    head = points.sparkSession.createDataFrame([(-1, header)], "point_idx long, value string")
    head.unionByName(body).repartition(1).sortWithinPartitions("point_idx").select("value").write.text(path)


def write_summary(row: DataFrame, path: str) -> None:
    """One row as one JSON object."""
    row.limit(1).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)


def run_metadata(spark: SparkSession, params: dict, counters: DataFrame) -> DataFrame:
    """One row: a run's parameters as JSON, and its counters (one row)."""
    import json

    made = spark.createDataFrame([(json.dumps(params, sort_keys=True, default=str),)], "params string")
    return made.crossJoin(counters.limit(1))


def write_by_annotation(rows: DataFrame, path: str, key: str = "annot_id") -> None:
    """A folder of Parquet files for each annotation."""
    rows.repartition(key).write.partitionBy(key).parquet(path)


def write_counts(counts: DataFrame, path: str, frame: str = "frame", count: str = "mask_count") -> None:
    """``frame:count`` lines."""
    counts.select(F.format_string("%d:%d", frame, count).alias("value")).write.text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def route(df: DataFrame, keep: Column, kept: str, dropped: str) -> None:
    """Rows that meet a condition to one folder, all others (nulls too) to another."""
    chosen = F.coalesce(keep, F.lit(False))
    df.filter(chosen).write.parquet(kept)
    df.filter(~chosen).write.parquet(dropped)
