"""Scene files: images, JSON shapes, lists, and how files are found."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelyard.operators import frames as P
from voxelyard.sources import files, images


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for image in (rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 65536, (4, 3)).astype(np.uint16), rng.integers(0, 256, (6, 5, 3), np.uint8)):
        got = images.decode_png(images.encode_png(image))
        assert (got.reshape(image.shape) == image).all() and got.dtype == image.dtype
    with pytest.raises(ValueError):
        images.decode_png(b"GIF89a")


def test_png_filters():
    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (6, 9), np.uint8)
    for step in (1, 3):
        raw = np.zeros((6, 10), np.uint8)
        for y in range(6):
            kind = y % 5
            raw[y, 0] = kind
            for x in range(9):
                a = int(want[y, x - step]) if x >= step else 0
                b = int(want[y - 1, x]) if y else 0
                c = int(want[y - 1, x - step]) if y and x >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                raw[y, 1 + x] = (int(want[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256
        assert (images._unfiltered(raw, step) == want).all()


def test_images_and_the_join(spark, tmp_path):
    """From files to kept points: a mask and a depth image of two frames, and four points."""
    for frame in ("0003", "7"):
        (tmp_path / "masks" / frame).mkdir(parents=True)
        (tmp_path / "depth" / frame).mkdir(parents=True)
        mask = np.zeros((4, 6), np.uint8)
        mask[1:3, 2:5] = 200
        (tmp_path / "masks" / frame / "CTX__door__000__area6.png").write_bytes(images.encode_png(mask))
        depth = np.full((4, 6), 2000, np.uint16)
        depth[1, 2] = 0
        (tmp_path / "depth" / frame / "d.png").write_bytes(images.encode_png(depth))
    masks = images.read_masks(spark, f"{tmp_path}/masks/*").withColumn("frame", images.frame_of(F.col("path")))
    assert {(r["frame"], r["pixel"]) for r in masks.collect()} == {(f, v * 6 + u) for f in (3, 7) for v in (1, 2) for u in (2, 3, 4)}
    assert masks.select(images.stem_of(F.col("path"))).first()[0] == "CTX__door__000__area6"
    depth = images.read_depth(spark, f"{tmp_path}/depth/*").withColumn("frame", images.frame_of(F.col("path")))
    assert depth.filter("raw = 2000").count() == 46 and images.read_depth(spark, f"{tmp_path}/depth/7", 1000.0).filter("raw = 2.0").count() == 23
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0), (1, 1, 0.0, 0.0, 2.0), (1, 2, 0.0, 0.0, 9.0), (1, 3, -1.0, -1.0, 2.0), (1, 4, 0.0, 0.0, -1.0), (1, 5, float("nan"), 0.0, 1.0)], "scene int, point_idx long, x double, y double, z double")
    row = {"scene": 1, "w": 6, "h": 4, "fx": 2.0, "fy": 2.0, "cx": 3.0, "cy": 2.0} | {c: 1.0 if i in (0, 5, 10) else 0.0 for i, c in enumerate(P.MATRIX)}
    frames = spark.createDataFrame([row | {"frame": 3}, row | {"frame": 7}])
    seen = P.visible(points, frames)
    assert sorted((r["frame"], r["pixel"], r["point_idx"]) for r in seen.collect()) == [(3, 8, 3), (3, 15, 0), (7, 8, 3), (7, 15, 0)]
    kept = P.depth_kept(P.with_depth(seen, depth.withColumn("scene", F.lit(1))))
    votes = P.mask_votes(kept, masks.withColumn("scene", F.lit(1)), ["scene"])
    assert [(r["point_idx"], r["vis"], r["fg"]) for r in votes.collect()] == [(0, 2, 2)]  # point 3 has no depth


def test_colour_images_and_files(spark, tmp_path):
    picture = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "c.png").write_bytes(images.encode_png(picture))
    got = {(r["u"], r["v"]): (r["r"], r["g"], r["b"]) for r in images.read_colours(spark, str(tmp_path / "c.png")).collect()}
    assert got == {(u, v): tuple(picture[v, u].tolist()) for v in range(2) for u in range(4)}
    px = spark.createDataFrame([("a", 0, 255), ("a", 5, 7), ("b", 99, 1), ("b", 1, 3)], "name string, pixel int, value int")
    made = images.png_files(px, ["name"], 3, 2)
    images.write_files(made.withColumn("name", F.concat("name", F.lit(".png"))), str(tmp_path / "out"))
    assert images.decode_png((tmp_path / "out" / "a.png").read_bytes())[..., 0].tolist() == [[255, 0, 0], [0, 0, 7]]
    assert images.decode_png((tmp_path / "out" / "b.png").read_bytes()).sum() == 3
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        images.read_masks(spark, str(tmp_path / "bad.png")).collect()


def test_json_shapes(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
        return str(tmp_path / name)

    rows = files.read_descriptions(spark, put("d.json", {"descriptions": [{"desc_id": "a", "annot_id": "x", "text": " Open it "}, {"desc_id": "b", "annot_id": ["y", " ", "z"], "prompt": "", "instruction": "go"}, {"desc_id": " "}, {"desc_id": "c"}]}))
    assert [(r["desc_id"], r["annot_ids"], r["text"]) for r in rows.orderBy("place").collect()] == [("a", ["x"], "Open it"), ("b", ["y", "z"], "go"), ("c", [], None)]
    rows = files.read_point_indices(spark, put("p.json", {"node_point_indices": [{"id": 1, "type": "Object", "name": "Door", "point_indices": [4, 4]}, {"id": "x", "point_indices": [1]}, {"id": 2}]}))
    assert [(r["node"], r["type"], r["point_idx"]) for r in rows.collect()] == [(1, "object", 4), (1, "object", 4)]
    rows = files.read_predictions(spark, put("r.json", {"results": [{"instruction": "go", "candidate_ids": [3, "x", 5]}, {"instruction": " "}, {"instruction": "no"}]}))
    assert [(r["text"], r["candidates"]) for r in rows.collect()] == [("go", [3, 5]), ("no", [])]
    rows = files.read_best_masks(spark, put("b.json", {"u": {"score": 0.5, "frame": 3, "prompt_used": "door"}}))
    assert [(r["annot_id"], r["score"], r["frame"]) for r in rows.collect()] == [("u", 0.5, 3)]
    frame = {"frame_index": 4, "objects": {"a": [{"bbox": [1, 2, 3, 4], "label": 1}, {"bbox": [1, 2, 3, 4], "label": 0}]}}
    for k, shape in enumerate(({"frames": [frame, {"objects": {}}]}, {"scenes": [{"frames": [frame]}, {}]})):
        assert [(r["frame"], r["x1"]) for r in files.read_boxes(spark, put(f"g{k}.json", shape)).collect()] == [(4, 3.0)]
    node = {"id": 7, "type": "object", "name": "door", "parent_id": 2, "position": [1, 2, 3]}
    for k, shape in enumerate(({"scene_id": "s", "nodes": [node]}, [node])):
        got = files.read_graph(spark, put(f"n{k}.json", shape), "basic").collect()
        assert [r.asDict() for r in got] == [{"scene_id": None if k else "s", "id": 7, "type": "object", "name": "door", "parent_id": 2}]
    assert files.read_graph(spark, str(tmp_path / "n0.json")).first()["position"] == [1, 2, 3]


def test_lists(spark, tmp_path):
    (tmp_path / "n.txt").write_text("scene 421 x 7\n# 9\nnone\n 33\n")
    assert [r["number"] for r in files.read_numbers(spark, str(tmp_path / "n.txt")).orderBy("line_no").collect()] == [421, 33]
    (tmp_path / "i.txt").write_text("3\n\n-1\n")
    assert [(r["text"], r["id"]) for r in files.read_predicted_ids(spark, str(tmp_path / "i.txt")).orderBy("line_no").collect()] == [(None, 3), (None, -1), (None, -1)]
    (tmp_path / "t.txt").write_text("Open  the door\t4\nopen the door,5\n7\na, b,-1\n")
    assert {(r["text"], r["id"]) for r in files.read_predicted_ids(spark, str(tmp_path / "t.txt")).collect()} == {("open the door", 4), ("a, b", -1)}
    (tmp_path / "x.txt").write_text("open\n")
    with pytest.raises(Exception, match="neither"):
        files.read_predicted_ids(spark, str(tmp_path / "x.txt")).collect()
    (tmp_path / "p.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [(r["a"], r["_row_index"]) for r in files.read_prompts(spark, str(tmp_path / "p.csv"), ["a"]).orderBy("_row_index").collect()] == [("1", 0), ("2", 1)]
    poses = spark.createDataFrame([("p", 0.0, 0.0, 0.0)], "path string, ax double, ay double, az double")
    assert files.checked_poses(poses).first()["r00"] == 1.0


def test_finding_files(spark, tmp_path):
    for name in ("scan/x_transform.npy", "10/rgb_scan.ply", "9/laser_scan.ply", "9/points.npz", "9/more.json", "9/masks/0004/a.png", "9/masks/12/b.png", "flat/c.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"nodes": []}) if name.endswith("json") else "x")
    root = str(tmp_path)
    assert files.first_sequence(spark, root) == "9" and files.find_cloud(spark, root).endswith("9/laser_scan.ply")
    (tmp_path / "cloud.npy").write_text("x")
    assert files.find_cloud(spark, root).endswith("/cloud.npy")
    assert files.frame_folders(spark, f"{root}/9/masks") == [4, 12] and files.frame_folders(spark, f"{root}/flat") == [0]
    assert files.find_json(spark, root, "more.json", "x").endswith("more.json") and files.find_json(spark, root, "other.json", "nodes").endswith("more.json")
    with pytest.raises(ValueError):
        files.find_json(spark, root, "other.json", "absent")
    frames = spark.createDataFrame([("s", i) for i in range(7)], "scene string, frame int")
    assert sorted(r["frame"] for r in files.strided(frames, "scene", "frame", 3).collect()) == [0, 3, 6]
    assert sorted(r["frame"] for r in files.strided(frames, "scene", "frame", 3, 5, False).collect()) == [0, 3]
    with pytest.raises(Exception, match="out of range"):
        files.strided(frames, "scene", "frame", 3, 5).collect()


def test_sinks(spark, tmp_path):
    counters = spark.createDataFrame([(3, 4)], "frames int, masks int")
    files.write_summary(files.run_metadata(spark, {"b": 1, "a": [2]}, counters), str(tmp_path / "m"))
    told = json.loads("".join(p.read_text() for p in (tmp_path / "m").glob("part-*")))
    assert told == {"params": '{"a": [2], "b": 1}', "frames": 3, "masks": 4}
    files.write_counts(spark.createDataFrame([(1, 5)], "frame int, mask_count int"), str(tmp_path / "c"))
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("part-*")) == "1:5\n"
    files.write_by_annotation(spark.createDataFrame([("u", 1), ("v", 2)], "annot_id string, p int"), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a" / "annot_id=v")).first()["p"] == 2
    files.write_jsonl(counters, str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))) == {"frames": 3, "masks": 4}
    ply = b"ply\nformat binary_little_endian 1.0\nelement camera 2\nproperty float a\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + np.array([9, 9, 1, 2, 3], "<f4").tobytes()
    assert files.decode_points("a.ply", ply)[0].tolist() == [[1.0, 2.0, 3.0]]
