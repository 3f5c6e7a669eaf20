"""Scans and sinks against the SQL of the rows that went in, and the pool's edge cases."""

import json
import os
import random
from collections import Counter

import duckdb
import pytest

from voxelyard.operators import iterative
from voxelyard.plans import source_queries
from voxelyard.plans.registry import ORACLE, QUERIES, load
from voxelyard.streaming import pool

load()
SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in QUERIES.items() if f.__module__ == source_queries.__name__]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*NAMES, "pool_support_reject", "pool_hysteresis"])
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = Counter(want.fetchall())
    assert rows and Counter(tuple(r[c] for c in names) for r in got.collect()) == rows


def test_pool_edges(spark):
    kinds = "user_id long, event_id long, support int, reject int, lead int"
    rows = [(1, 5, 0, 3, 9), (1, 6, 9, 0, 9), (None, 1, None, None, 0), (None, None, 1, 0, 0), (2, 1, 0, 2, 0), (2, 1, 1, 0, 0), (2, 1, 0, 2, 0)]
    got = {r["user_id"]: tuple(r)[1:] for r in pool.settle(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: (0, 3, 5, False), None: (1, 0, 1, True), 2: (1, 4, 1, False)}
    assert pool.settle(spark.createDataFrame([], kinds)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: None)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError):
        iterative.shared_folder(Session())


def test_hysteresis(spark, tmp_path):
    rng = random.Random(3)
    limits = {"support_keep": 4, "reject_drop": 2, "stale": 3, "every": 2}
    rows = [(p, f, int(rng.random() < 0.3), int(u < 0.2), int(0.2 <= u < 0.8)) for f in range(60) for p in range(8) if (u := rng.random()) < 0.9]
    want = {}
    for p, f, a, s, r in rows:
        x = want.setdefault(p, [False, 0, 0, -1, 0])
        if a and not x[0]:
            x[:4] = True, 1, 0, f
        if x[0]:
            x[1] += s
            x[2] += r
            x[3] = f if s else x[3]
            if f % 2 == 0 and x[2] >= 2 and f - x[3] >= 3 and not (x[1] >= 4 or x[1] / max(1, x[1] + x[2]) >= pool.RATIO_KEEP):
                x[0], x[4] = False, x[4] + 1
    kinds = "point long, frame long, added int, support int, reject int"
    assert sum(x[4] for x in want.values()) > 3
    df = spark.createDataFrame([*rows, rows[0], (99, None, 1, 1, 1), (None, 1, None, 1, None)], kinds)
    got = {r["point"]: list(r)[1:] for r in pool.hysteresis(df, ["point"], **limits).collect()}
    assert got.pop(None) == [False, 0, 0, -1, 0] and got == want
    assert pool.hysteresis(spark.createDataFrame([], kinds), ["point"]).count() == 0
    (tmp_path / "in").mkdir()
    for i in range(2):
        part = [dict(zip(("point", "frame", "added", "support", "reject"), r, strict=True)) for r in rows if r[1] // 30 == i]
        (file := tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(file, (1_700_000_000 + i,) * 2)  # the file source's order is that of the files' times
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen: dict = {}
    run = pool.hysteresis_stream(stream, **limits).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({r["point"]: list(r)[1:] for r in b.collect()})).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert run.awaitTermination(120) and seen == want
