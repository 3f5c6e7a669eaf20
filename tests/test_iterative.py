import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelyard.operators import iterative as I
from voxelyard.sources import files
from voxelyard.streaming import pool


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40) if i != 20]
    got = {r["node"]: r["component"] for r in I.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}
    assert I.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dbscan_against_plain(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(c, 0.05, (25, 3)) for c in (0, 1, 2)] + [rng.uniform(-1, 3, (25, 3))])
    rows = spark.createDataFrame(pd.DataFrame({"k": range(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    got = {r["k"]: (r["core"], r["cluster"]) for r in I.dbscan(rows, "k", ["x", "y", "z"], 0.12, 5).collect()}
    near = np.linalg.norm(p[:, None] - p[None], axis=2) < 0.12
    core = near.sum(1) >= 5
    name = np.where(core, np.arange(len(p)), len(p))
    for _ in range(len(p)):
        name = np.where(core, np.where(near & core[None], name[None], len(p)).min(1), len(p))
    want = {}
    for i in range(len(p)):
        c = name[near[i] & core]
        if len(c):
            want[i] = (bool(core[i]), int(c.min()))
    assert got == want and len({c for _, c in got.values()}) >= 3


def plain_dbscan(p, eps, least):
    """{row: (core, cluster)} by all distances."""
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) < eps * eps
    core = near.sum(1) >= least
    name, old = np.where(core, np.arange(len(p)), len(p)), None
    while old is None or (old != name).any():
        old, name = name, np.where(core, np.where(near & core[None], name[None], len(p)).min(1), len(p))
    touched = np.where(near & core[None], name[None], len(p)).min(1)
    return {i: (bool(core[i]), int(touched[i])) for i in np.flatnonzero(touched < len(p)).tolist()}


def written_rows(monkeypatch):
    """The rows of each table that cut() writes from now on."""
    seen, real = [], I.cut

    def cut(df):
        out = real(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(I, "cut", cut)
    return seen


def test_centroids_exchange_no_pairs_of_points(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 0.03, (400, 3)), rng.normal(1, 0.03, (100, 3)), rng.uniform(4, 9, (20, 3))])
    rows = spark.createDataFrame(pd.DataFrame({"k": range(len(p)), "label": 1, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    seen = written_rows(monkeypatch)
    r = I.largest_cluster_centroids(rows, "k", ["x", "y", "z"], 0.1, 4, ("label",)).first()
    want = plain_dbscan(p, 0.1, 4)
    sizes = pd.Series([c for _, c in want.values()]).value_counts()
    assert (r["num_points"], r["num_clusters"], r["largest_cluster_points"], r["noise_points"]) == (len(p), len(sizes), sizes.max(), len(p) - len(want))
    assert np.allclose([r[x] for x in "xyz"], p[[i for i, (_, c) in want.items() if c == sizes.idxmax()]].mean(axis=0))
    assert max(seen) <= 2 * len(p)  # some 80,000 pairs are close


@pytest.mark.parametrize("small", [1, 4096])
def test_clusters_across_tiles(spark, monkeypatch, small):
    """Tiles of a cell or two, chains through many, borders between clusters, and cells that are halved."""
    from voxelyard.operators import density

    rng = np.random.default_rng(7)
    chain = np.stack([np.arange(-2, 2, 0.07), np.zeros(58), 0.2 * np.sin(np.arange(58))], axis=1)
    p = rng.permutation(np.concatenate([chain, chain + [0.01, 0.01, 0.0], rng.normal(-0.5, 0.08, (150, 3)), rng.uniform(-1, 1, (150, 3)), rng.integers(-5, 5, (80, 3)) * 0.1]))
    reach, size = 2, 0.1 / ((np.sqrt(3) + 2) / 2)
    monkeypatch.setattr(density, "SIDE", 2)
    monkeypatch.setattr(density, "SMALL", small)
    monkeypatch.setattr(density, "TILE", 500)
    cell = np.floor(p / size).astype(int)
    span = [np.unique((cell + h) // 2, axis=0) for h in range(-2 * reach, 2 * reach + 1)]
    tiles = np.unique(np.stack(np.meshgrid(*[np.unique(np.concatenate(span)[:, i]) for i in range(3)], indexing="ij"), axis=-1).reshape(-1, 3), axis=0)
    near = ((cell[None] >= 2 * tiles[:, None] - 4) & (cell[None] < 2 * tiles[:, None] + 6)).all(axis=2)
    key, tile = np.nonzero(near.T)
    core, name, border, touched, cells, part = density.tile_clusters(tile, p[key], tiles[tile], 0.1, 4, size, reach)
    root = np.arange(len(p))
    density._link(root, key[cells], key[part])
    got = {int(k): (True, int(root[n])) for k, n in zip(key[core], key[name], strict=True)}
    assert len(got) == len(core)
    for k, n in zip(key[border].tolist(), root[key[touched]].tolist(), strict=True):
        got[k] = min(got.get(k, (False, n)), (False, n))
    assert got == plain_dbscan(p, 0.1, 4) and len({c for _, c in got.values()}) >= 3


def test_points_without_a_place_are_close_to_none(spark):
    nan, inf = float("nan"), float("inf")
    at = [(0, 0.0), (1, 0.05), (2, -0.05), (3, nan), (4, nan), (5, nan), (6, inf), (7, inf), (8, -inf), (9, None), (10, None), (11, None)]
    rows = spark.createDataFrame([(k, x, 0.0) for k, x in at], "k int, x double, y double")
    assert sorted(tuple(r) for r in I.dbscan(rows, "k", ["x", "y"], 0.1, 3).collect()) == [(0, True, 0), (1, False, 0), (2, False, 0)]
    assert sorted(tuple(r) for r in I.dbscan(rows, "k", ["x", "y"], 0.1, 1).collect()) == [(k, True, 0 if k < 3 else k) for k in range(12)]
    with pytest.raises(Exception, match="too far from the origin"):
        I.dbscan(spark.createDataFrame([(0, 1e20, 0.0)], "k int, x double, y double"), "k", ["x", "y"], 0.1, 3).collect()


def test_label_without_core_points_is_one_cluster(spark):
    at = [(k, "dense", 0.01 * k) for k in range(4)] + [(4, "dense", 9.0)] + [(k, "sparse", float(k)) for k in (7, 5, 6)] + [(8, "two", 1.0), (9, "two", 1.01), (10, "two", 5.0), (11, "two", 5.03), (12, None, 1.0)]
    rows = spark.createDataFrame([(k, g, x, 0.0, 2.0) for k, g, x in at], "k long, label string, x double, y double, z double")
    got = sorted((r["k"], r["core"], r["cluster"]) for r in I.instances(rows, "k", ["x", "y", "z"], 0.1, 2, ("label",)).collect())
    assert got == [*((k, True, 0) for k in range(4)), *((k, False, 5) for k in (5, 6, 7)), (8, True, 8), (9, True, 8), (10, True, 10), (11, True, 10), (12, False, 12)]
    assert {r["cluster"] for r in I.instances(rows.filter("label = 'sparse'"), "k", ["x", "y", "z"], 0.1, 2).collect()} == {5}
    centre = {r["label"]: tuple(r)[1:] for r in I.largest_cluster_centroids(rows, "k", ["x", "y", "z"], 0.1, 2, ("label",)).collect()}
    want = {"dense": (0.015, 0, 2, 5, 1, 4, 0.8, 1), "sparse": (6, 0, 2, 3, 0, 0, 0, 3), "two": (1.005, 0, 2, 4, 2, 2, 0.5, 0), None: (1, 0, 2, 1, 0, 0, 0, 1)}
    assert centre.keys() == want.keys() and all(np.allclose(centre[g], want[g]) for g in want)


def test_query_keeps_a_label_without_core_points(spark, tmp_path):
    from voxelyard.plans.iterative_queries import dbscan_clusters

    rows = [(k, [float(k), 0.0, 0.0], 1) for k in range(3)] + [(k, [0.01 * k, 0.0, 0.0], 2) for k in range(3, 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r["vec_id"], r["cluster"]) for r in dbscan_clusters(spark, str(tmp_path)).collect()) == [(k, 0 if k < 3 else 3) for k in range(8)]


def dense_labels(spark, path):
    """A table of two labels, dense each, of which one is two clusters; its points and labels."""
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.normal(0, 0.03, (300, 3)), rng.normal(0.05, 0.03, (200, 3)), rng.normal(1, 0.03, (90, 3)), rng.uniform(3, 9, (9, 3))]).astype("f4")
    label = np.repeat([1, 2, 2, 2], [300, 200, 90, 9])
    order = rng.permutation(len(p))
    p, label = p[order], label[order]
    spark.createDataFrame([(i, x, int(g)) for i, (x, g) in enumerate(zip(p.tolist(), label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return p.astype(float), label


def wanted_clusters(p, label):
    return {int(at[i]): (core, int(at[c])) for g in (1, 2) for at in [np.flatnonzero(label == g)] for i, (core, c) in plain_dbscan(p[at], 0.1, 4).items()}


def test_ranks_exchange_no_pairs_of_points(spark, tmp_path, monkeypatch):
    from voxelyard.plans.graph_queries import cluster_ranks

    p, label = dense_labels(spark, tmp_path)
    seen = written_rows(monkeypatch)
    got = [tuple(r) for r in cluster_ranks(spark, str(tmp_path)).orderBy("label", "rank").collect()]
    n = pd.Series([(int(label[i]), c) for i, (_, c) in wanted_clusters(p, label).items()]).value_counts()
    want = sorted((g, -k, c) for (g, c), k in n.items())
    assert [(g, c, k) for g, c, k, _ in got] == [(g, c, -k) for g, k, c in want] and [r for *_, r in got] == [1, 1, 2]
    assert max(seen) <= 2 * len(p)


def test_clusters_exchange_no_pairs_of_points(spark, tmp_path, monkeypatch):
    from voxelyard.plans.iterative_queries import dbscan_clusters

    p, label = dense_labels(spark, tmp_path)
    seen = written_rows(monkeypatch)
    got = {r["vec_id"]: (r["core"], r["cluster"]) for r in dbscan_clusters(spark, str(tmp_path)).collect()}
    assert got == wanted_clusters(p, label) and len(got) > 500
    assert max(seen) <= 2 * len(p)


def test_cover_takes_the_first_of_ties(spark):
    seen = spark.createDataFrame([("b", 1), ("b", 2), ("a", 2), ("a", 3), ("c", 4)], "frame string, node int")
    assert [tuple(r) for r in I.set_cover(seen, "frame", "node").orderBy("pick").collect()] == [(0, "a", 2), (1, "b", 1), (2, "c", 1)]


def test_suppression(spark):
    rows = [(1, 1, 0.0, 0.0, 2.0, 2.0, 0.9), (1, 2, 0.0, 0.0, 2.0, 2.1, 0.9), (1, 3, 5.0, 5.0, 6.0, 6.0, 0.1), (2, 4, 0.0, 0.0, 2.0, 2.0, 0.5)]
    boxes = spark.createDataFrame(rows, "frame int, k int, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(r["k"] for r in I.suppress(boxes, "frame", "k", 0.5).collect()) == [1, 3, 4]
    assert I.suppress(boxes, "frame", "k", 0).count() == 4


def test_matching_takes_the_best_free_truth(spark):
    rows = [("s", "p", 1, 0.9, 0.6), ("s", "p", 2, 0.9, 0.5), ("s", "q", 1, 0.8, 0.9), ("s", "q", 2, 0.8, 0.4), ("s", "r", 1, 0.7, 0.9)]
    pairs = spark.createDataFrame(rows, "g string, pred string, gt int, score double, iou double")
    assert sorted((r["pred"], r["gt"]) for r in I.greedy_match(pairs, "g", "pred", "gt", 0.3).collect()) == [("p", 1), ("q", 2)]


def test_only_pairs_of_enough_overlap_reach_the_matching(spark):
    pairs = spark.range(100).selectExpr("'s' AS g", "id AS pred", "id AS gt", "1.0D AS score", "id / 100 AS iou")
    plan = str(I.greedy_match(pairs, "g", "pred", "gt", 0.5)._jdf.queryExecution().optimizedPlan())
    assert "Filter" in plan and I.greedy_match(pairs, "g", "pred", "gt", 0.5).count() == 50


def test_folds(spark):
    nodes = spark.createDataFrame([("t", 1, "n", 0.0), ("t", 2, "n", 0.1), ("t", 3, "m", 0.1), ("t", 4, "n", 0.3)], "kind string, k long, name string, x double")
    nodes = nodes.withColumn("names", F.array("name")).withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r["k"]: r["merged"] for r in I.merge_to_centroids(nodes, "kind", "k", "name", "names", ["x", "y", "z"], {"thr": 0.2}).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}  # 4 is too far from the mean of 1 and 2
    cells = spark.createDataFrame([("g", 1, 1), ("g", 1, 2), ("g", 2, 2), ("g", 3, 9)], "g string, o long, c long")
    assert {r["o"]: r["first"] for r in I.assign_instances(cells, "g", "o", "c", 0.5).collect()} == {1: 1, 2: 1, 3: 3}
    assert I.closed_map({"a": "b", "b": "c", "x": "y", "y": "x"}) == {"a": "c", "b": "c", "x": "y", "y": "x"}


def test_pool_as_table_and_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"user_id": rng.integers(0, 6, 200), "event_id": range(200), "support": rng.integers(0, 2, 200)})
    rows["reject"] = 1 - rows["support"]
    kinds = "user_id long, event_id long, support int, reject int"
    whole = {r["user_id"]: tuple(r)[1:] for r in pool.settle(spark.createDataFrame(rows, kinds)).collect()}
    (tmp_path / "in").mkdir()
    for i in range(2):
        rows[i * 100 : (i + 1) * 100].to_json(file := tmp_path / "in" / f"{i}.json", orient="records", lines=True)
        os.utime(file, (1_700_000_000 + i,) * 2)  # the file source's order is that of the files' times
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got: dict = {}

    def take(batch, _):
        got.update({r["user_id"]: tuple(r)[1:] for r in batch.collect()})

    run = pool.settle_stream(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert run.awaitTermination(120) and got == whole


def test_clouds(spark, tmp_path):
    xyz = np.arange(12, dtype="f4").reshape(4, 3)
    np.save(tmp_path / "a.npy", xyz)
    np.savez(tmp_path / "b.npz", other=np.zeros(3), points=xyz)
    head = "ply\nformat {}\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    rec = np.zeros(4, [("x", ">f4"), ("y", ">f4"), ("z", ">f4"), ("c", "u1", 3)])
    rec["x"], rec["y"], rec["z"], rec["c"] = *xyz.T, 7
    (tmp_path / "c.ply").write_bytes(head.format("binary_big_endian 1.0").encode() + rec.tobytes())
    (tmp_path / "d.ply").write_text(head.format("ascii 1.0") + "".join(f"{x} {y} {z} 7 7 7\n" for x, y, z in xyz))
    got = files.read_points(spark, str(tmp_path)).toPandas()
    for _, part in got.groupby("path"):
        assert (part.sort_values("point_idx")[["x", "y", "z"]].to_numpy() == xyz).all()
    assert got["path"].nunique() == 4 and got["r"].notna().sum() == 8 and (got["r"].dropna() == 7).all()
    assert files.vertex_count((tmp_path / "c.ply").read_bytes()) == 4
    with pytest.raises(ValueError):
        files.decode_ply(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n")
    files.write_ply(files.read_points(spark, str(tmp_path / "d.ply")), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) == 1
    again, _ = files.decode_points("x.ply", b"".join(p.read_bytes() for p in parts))
    assert (again == xyz).all()


def test_text_files(spark, tmp_path):
    (tmp_path / "t.traj").write_text("# poses\n\n0.1 1 2 3 4 5 6\n0.2 1 2 3 4 5 7\n")
    assert [(r["frame_idx"], r["ts"], r["tz"]) for r in files.read_trajectory(spark, str(tmp_path / "t.traj")).orderBy("frame_idx").collect()] == [(0, 0.1, 6.0), (1, 0.2, 7.0)]
    (tmp_path / "bad.traj").write_text("0.1 1 2\n")
    with pytest.raises(Exception, match="7 fields"):
        files.read_trajectory(spark, str(tmp_path / "bad.traj")).collect()
    (tmp_path / "k.txt").write_text("64 48 50 50 32 24\n")
    assert files.read_intrinsics(spark, str(tmp_path / "k.txt")).first()["fx"] == 50
    (tmp_path / "ids.txt").write_text("#x\nb\na\nb\n")
    assert [r["line"] for r in files.read_list(spark, str(tmp_path / "ids.txt")).orderBy("line_no").collect()] == ["b", "a"]
    (tmp_path / "p.csv").write_text("scene_id,prompt\n1,\"open, the door\"\n")
    assert files.read_prompts(spark, str(tmp_path / "p.csv"), ["prompt"]).first()["prompt"] == "open, the door"
    with pytest.raises(ValueError):
        files.read_prompts(spark, str(tmp_path / "p.csv"), ["none"])
    (tmp_path / "a.json").write_text(json.dumps({"annotations": [{"annot_id": "u", "label": "door", "indices": [3, 4]}, {"annot_id": "v", "label": "hook"}]}, indent=1))
    got = files.read_annotations(spark, str(tmp_path / "a.json"))
    assert sorted((r["annot_id"], r["point_idx"] or 0) for r in got.collect()) == [("u", 3), ("u", 4), ("v", 0)]
    files.route(got, F.col("point_idx") > 3, str(tmp_path / "kept"), str(tmp_path / "dropped"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1 and spark.read.parquet(str(tmp_path / "dropped")).count() == 2


# ------------------------------------------------------------------ folds against plain versions
def random_boxes(rng, n):
    rows = []
    for k in range(n):
        x, y, w, h = rng.uniform(0, 30, 2).tolist() + rng.uniform(3, 12, 2).tolist()
        rows.append((int(rng.integers(0, 3)), k, x, y, x + w, y + h, float(rng.integers(0, 20))))
    return rows


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


BOX = "frame int, k int, x0 double, y0 double, x1 double, y1 double, score double"


def test_suppression_against_plain(spark):
    rows = random_boxes(np.random.default_rng(4), 120)
    want = set()
    for f in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[6], r[1])):
            if all(plain_iou(r[2:6], o[2:6]) < 0.3 for o in kept):
                kept.append(r)
        want |= {r[1] for r in kept}
    assert {r["k"] for r in I.suppress(spark.createDataFrame(rows, BOX), "frame", "k", 0.3).collect()} == want


def test_cover_against_plain(spark):
    rng = np.random.default_rng(5)
    seen = {(int(f), int(n)) for f, n in rng.integers(0, 25, (120, 2))}
    left, want = {n for _, n in seen}, []
    while left:
        gain = {f: len({n for g, n in seen if g == f} & left) for f in {f for f, _ in seen}}
        best = min(gain, key=lambda f: (-gain[f], f))
        want.append((len(want), best, gain[best]))
        left -= {n for g, n in seen if g == best}
    rows = spark.createDataFrame(sorted(seen), "frame int, node int")
    assert [tuple(r) for r in I.set_cover(rows, "frame", "node").orderBy("pick").collect()] == want
    assert [tuple(r) for r in I.set_cover(rows, "frame", "node", 2).orderBy("pick").collect()] == want[:2]


@pytest.mark.parametrize("rule", [{"mode": "l2", "thr": 0.4}, {"mode": "l2_xy", "thr": 0.3}, {"mode": "weighted_l2", "thr": 0.5, "scale": (1, 2, 0.5)}, {"mode": "mahalanobis", "thr": 1.0}, {"mode": "axis", "axis_thr": (0.3, 0.3, 0.3), "also_l2": 0.4}, {"mode": "hybrid", "thr_xy": 0.35, "thr_z": 0.2}])
def test_rollback_against_plain(spark, rule):
    rng = np.random.default_rng(6)
    at = rng.uniform(0, 1.5, (90, 3))
    at[7] = np.nan
    rows = [("t%d" % (k % 2), k, "n%d" % (k % 4), ["n%d" % (k % 4), "n%d" % (k % 7)], *at[k].tolist()) for k in range(90)]
    cell = {"hybrid": 0.35, "axis": 0.3}.get(rule["mode"], rule.get("thr"))
    want = {}
    for t in ("t0", "t1"):
        mine = [r for r in rows if r[0] == t and np.isfinite(r[4:]).all()]
        inverse = np.linalg.inv(np.cov(np.array([r[4:] for r in mine]).T) + np.eye(3) * 1e-6)
        found = []
        for _, k, n, names, *p in mine:
            p = np.array(p)
            best = None
            for a in found:
                d = a["sum"] / a["n"] - p
                near = all(abs(np.floor(a["at"] / cell) - np.floor(p / cell)) <= 1)
                far = np.sqrt(d @ inverse @ d) if rule["mode"] == "mahalanobis" else np.linalg.norm(d)
                ok = {
                    "l2": far < rule.get("thr", 0), "l2_xy": np.linalg.norm(d[:2]) < rule.get("thr", 0), "mahalanobis": far < rule.get("thr", 0),
                    "weighted_l2": np.linalg.norm(d / np.array(rule.get("scale", (1, 1, 1)))) < rule.get("thr", 0),
                    "axis": (abs(d) < 0.3).all() and far < 0.4, "hybrid": np.linalg.norm(d[:2]) < 0.35 and abs(d[2]) < 0.2,
                }[rule["mode"]]
                if near and ok and (a["name"] == n or a["names"] & set(names)) and (best is None or far < best[0]):
                    best = (far, a)
            if best is None:
                found.append({"k": k, "name": n, "names": set(names), "sum": p.copy(), "n": 1, "at": p})
                want[k] = k
            else:
                a = best[1]
                a["names"] |= set(names)
                a["sum"] = a["sum"] + p
                a["n"] += 1
                want[k] = a["k"]
    nodes = spark.createDataFrame(rows, "kind string, k long, name string, names array<string>, x double, y double, z double")
    merged = I.merge_to_centroids(nodes, "kind", "k", "name", "names", ["x", "y", "z"], rule)
    assert {r["k"]: r["merged"] for r in merged.collect()} == want
    out = {r["node"]: r for r in I.merged_nodes(nodes, merged, "kind", "k", "names", ["x", "y", "z"]).collect()}
    assert set(out) == set(want.values()) and sum(r["n_merged"] for r in out.values()) == 89 and all(r["name"] == r["names"][0] for r in out.values())


@pytest.mark.parametrize("handles", [False, True])
def test_instances_against_plain(spark, handles):
    rng = np.random.default_rng(7)
    obs = {o: (int(rng.integers(0, 2)), set(rng.integers(0, 25, int(rng.integers(2, 9))).tolist()), int(rng.integers(1, 30))) for o in range(80)}
    want = {}
    for g in (0, 1):
        found = []
        for o, (_, mine, area) in sorted((o, x) for o, x in obs.items() if x[0] == g):
            best, score = None, -1.0
            for i in found:
                s = len(mine & i["rep"]) / min(len(mine), len(i["rep"]))
                if s > score:
                    best, score = i, s
            if best is None or score < 0.5:
                found.append({"first": o, "rep": mine, "obs": o, "area": area})
                want[o] = [o, None]
                continue
            want[o] = [best["first"], None]
            if handles and score >= 0.9 and area >= best["area"]:
                want[o][1] = best["obs"]
            elif handles and area < best["area"]:
                if score >= 0.9:
                    want[best["obs"]][1] = o
                best.update(rep=mine, obs=o, area=area)
    rows = [(g, o, c, a) for o, (g, cs, a) in obs.items() for c in cs]
    cells = spark.createDataFrame(rows, "g int, o long, c int, area int")
    got = I.assign_instances(cells, "g", "o", "c", 0.5, handles)
    assert {r["o"]: [r["first"], r["dropped_by"]] for r in got.collect()} == want
    ids = {r["first"]: r["instance"] for r in I.instance_ids(got).collect()}
    assert [ids[f] for f in sorted(ids)] == list(range(1, len(ids) + 1))


def test_guard_against_plain(spark):
    rng = np.random.default_rng(8)
    rows = [("a" if o % 2 else "b", o, p, *(rng.normal(o % 5, 0.02, 3)).tolist()) for o in range(30) for p in range(6)]
    want = {}
    for g in "ab":
        clouds = []
        for o in sorted({r[1] for r in rows if r[0] == g}):
            mine = {}
            for r in sorted(r for r in rows if r[1] == o):
                mine.setdefault(tuple(np.floor(np.array(r[3:]) / 0.05).astype(int)), np.array(r[3:]))
            c = np.mean(list(mine.values()), axis=0)
            far = [np.linalg.norm(np.mean(list(x.values()), axis=0) - c) for x in clouds]
            k = int(np.argmin(far)) if far and min(far) <= 0.5 else len(clouds)
            if k == len(clouds):
                clouds.append({})
            for v, x in mine.items():
                clouds[k].setdefault(v, x)
            want[o] = "000" if k == 0 else f"000__b{k:02d}"
    df = spark.createDataFrame(rows, "g string, o int, point int, x double, y double, z double")
    got = I.guarded_instances(df, ["g"], "o", ["x", "y", "z"], 0.05, 0.5)
    assert {r["o"]: r["id"] for r in got.select("o", I.branch_id(F.lit("000"), F.col("branch")).alias("id")).collect()} == want and len(set(want.values())) == 5


@pytest.mark.parametrize("good_share", [0.4, 2.0])
def test_frames_against_plain(spark, good_share):
    rng = np.random.default_rng(9)
    rows = [(f, n, *b[2:6], float(rng.uniform(0, 1)), float(rng.integers(0, 9))) for f in range(8) for n, b in enumerate(random_boxes(rng, 9))]
    good = [r for r in rows if r[6] >= 0.6]
    kept = set()
    for f in range(8):
        stay = []
        for r in sorted((r for r in good if r[0] == f), key=lambda r: (-r[7], r[1])):
            if all(plain_iou(r[2:6], o[2:6]) < 0.1 for o in stay):
                stay.append(r)
        kept |= {(f, r[1]) for r in stay}
    share = {f: np.mean([r[6] >= 0.6 for r in rows if r[0] == f]) for f in range(8)}
    eligible = {(f, n) for f, n in kept if share[f] >= good_share}
    first = eligible or kept
    left, chosen = {n for _, n in first}, {}
    while left:
        gain = {f: len({n for g, n in first if g == f} & left) for f, _ in first}
        best = min(gain, key=lambda f: (-gain[f], f))
        chosen[best] = 1
        left -= {n for g, n in first if g == best}
    nodes = {r[1] for r in good}
    for n in sorted(nodes - {n for f, n in first if f in chosen}):
        order = sorted((r for r in good if r[1] == n), key=lambda r: (-r[7], r[0]))
        best = next((r[0] for r in order if (r[0], n) in kept), order[0][0])
        chosen.setdefault(best, 2)
    shown = {n for f, n in eligible if f in chosen} | {n for f, n in kept if f in chosen and f not in {g for g, _ in eligible}}
    df = spark.createDataFrame(rows, "frame int, node int, x0 double, y0 double, x1 double, y1 double, vis double, score double")
    got, covered = I.select_frames(df, "frame", "node", 0.1, good_share, 0.6)
    assert {r["frame"]: r["phase"] for r in got.collect()} == chosen
    assert {r["node"]: r["covered"] for r in covered.collect()} == {n: n in shown for n in nodes}


def test_pool_against_plain(spark):
    rng = np.random.default_rng(10)
    rows = [(int(u), e, int(s), 1 - int(s)) for e, (u, s) in enumerate(zip(rng.integers(0, 9, 300), rng.integers(0, 2, 300), strict=True))]
    want = {}
    for u, e, s, r in rows:
        a = want.setdefault(u, [0, 0, -1, True])
        if a[3]:
            a[0], a[1], a[2] = a[0] + s, a[1] + r, e
            a[3] = a[1] - a[0] < pool.LEAD
    df = spark.createDataFrame(rows, "user_id long, event_id long, support int, reject int")
    assert {r["user_id"]: list(r)[1:] for r in pool.settle(df).collect()} == want


def test_superpixels_against_plain(spark):
    from voxelyard.operators import images as M

    rng = np.random.default_rng(11)
    h, w, wanted, compactness = 11, 13, 6, 8.0
    lab = rng.uniform(0, 100, (h, w, 3)).round(3)
    grad = np.zeros((h, w))
    grad[:, 1:-1] += ((lab[:, 2:] - lab[:, :-2]) ** 2).sum(axis=2)
    grad[1:-1] += ((lab[2:] - lab[:-2]) ** 2).sum(axis=2)
    step = (h * w / wanted) ** 0.5
    centres = []
    for y in range(int(step / 2), h, int(step)):
        for x in range(int(step / 2), w, int(step)):
            best = min(((grad[i, j], (i, j) != (y, x), i, j) for i in range(max(0, y - 1), min(h, y + 2)) for j in range(max(0, x - 1), min(w, x + 2))))
            centres.append([*lab[best[2], best[3]], best[3], best[2]])
    label = -np.ones((h, w), int)
    for _ in range(2):
        far = np.full((h, w), np.inf)
        for k, (a, b, c, x, y) in enumerate(centres):
            for i in range(int(max(y - 2 * step, 0)), int(min(y + 2 * step + 1, h))):
                for j in range(int(max(x - 2 * step, 0)), int(min(x + 2 * step + 1, w))):
                    d = ((lab[i, j] - [a, b, c]) ** 2).sum() + ((j - x) ** 2 + (i - y) ** 2) * (compactness / step) ** 2
                    if d ** 0.5 < far[i, j]:
                        far[i, j], label[i, j] = d ** 0.5, k
        for k in range(len(centres)):
            i, j = np.nonzero(label == k)
            if len(i):
                centres[k] = [*lab[i, j].mean(axis=0), j.mean(), i.mean()]
    px = spark.createDataFrame([(0, x, y, *lab[y, x].tolist()) for y in range(h) for x in range(w)], "image int, u int, v int, l double, a double, b double")
    got = M.superpixels(px, "image", wanted, compactness, 2)
    assert {(r["u"], r["v"]): r["label"] for r in got.collect()} == {(x, y): int(label[y, x]) for y in range(h) for x in range(w)}
    grid = spark.createDataFrame([(0, x, y, int(c)) for y, line in enumerate(["00010", "01110", "22200"]) for x, c in enumerate(line)], "image int, u int, v int, label int")
    regions = {(r["u"], r["v"]): r["region"] for r in M.connected(grid, "image", "label", 3).collect()}
    assert ["".join(str(regions[x, y]) for x in range(5)) for y in range(3)] == ["00012", "01112", "33322"]
    small = {(r["u"], r["v"]): r["region"] for r in M.connected(grid, "image", "label", 4).collect()}
    assert ["".join(str(small[x, y]) for x in range(5)) for y in range(3)] == ["00012", "01112", "11122"]


def test_models(spark):
    from voxelyard.operators import models

    def masks():
        areas = {"door handle": 50, "rotate door handle": 20, "knob": 7}
        return lambda b: pd.DataFrame([(k, p, 0, 0.9, areas.get(p.lower(), 0), [1, 2]) for k, p in zip(b["key"], b["prompt"], strict=True)], columns=["key", "prompt", "item", "score", "area", "pixels"])

    prompts = spark.createDataFrame([("a", "Door handle"), ("a", "knob"), ("b", "lamp")], "key string, prompt string")
    assert {(r["key"], r["prompt"], r["used"], r["area"]) for r in models.segmented(prompts, masks).collect()} == {("a", "Door handle", "rotate door handle", 20), ("a", "knob", "knob", 7), ("b", "lamp", "lamp", 0)}

    def video():
        return lambda b: pd.DataFrame([(k, s, f, j, 5 if f >= 2 else 0, [j]) for k, s, fs in zip(b["key"], b["seed"], b["frames"], strict=True) for f in fs for j in (0, 1)], columns=["key", "seed", "frame", "k", "area", "pixels"])

    seeds = spark.createDataFrame([("v", 3, "door")], "key string, seed long, prompt string")
    frames = spark.createDataFrame([("v", f) for f in (2, 1, 4)], "key string, frame long")
    assert sorted((r["frame"], r["object"]) for r in models.tracked(seeds, frames, video).collect()) == [(2, 3000), (2, 3001), (4, 3000), (4, 3001)]

    def answers():
        said = {
            1: 'Sure {"candidates": [{"id": 2, "name": "knob", "type": "a", "score": 3}, {"id": 1, "name": "door", "type": "o", "score": 0.4}, {"id": 9, "name": "x", "type": "o"}]}',
            2: '{"choice": {"id": "1", "name": "door", "type": "o"}, "score": 0.7}', 3: "nothing", 4: '{"choice": {"id": 1, "name": "gate", "type": "o"}}',
        }
        return lambda b: pd.DataFrame({"query": b["query"], "answer": [said[q] for q in b["query"]]})

    asked = spark.createDataFrame([(1, "t", ["x"], False), (2, "t", ["x"], True), (3, "t", ["Red_Door"], False), (4, "t", ["zzz"], True)], "query long, text string, objects array<string>, spatial boolean")
    nodes = spark.createDataFrame([(1, "door", "o"), (2, "knob", "a")], "id long, name string, type string")
    got = {(r["query"], r["id"], None if r["score"] is None else round(r["score"], 3), r["rank"], r["source"], r["error"]) for r in models.grounded(asked, nodes, answers).collect()}
    assert got == {(1, 2, 1.0, 1, "model", None), (1, 1, 0.4, 2, "model", None), (2, 1, 0.7, 1, "model", None), (3, 1, 0.55, 1, "name", "no object"), (4, None, None, None, None, "no valid answer")}
