import math

import pytest
from pyspark.sql import functions as F

from voxelyard.functions import boxes as B
from voxelyard.operators import merging as M


def test_union_points_counts_a_shared_point_once(spark):
    sets = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 11), (3, 12)], "n long, p long")
    edges = spark.createDataFrame([(1, 2)], "a long, b long")
    got = {r["n"]: (r["members"], r["n_points"], r["observations"]) for r in M.union_points(sets, "n", "p", edges).collect()}
    assert got == {1: (2, 2, 4), 3: (1, 1, 1)}


def test_the_strongest_stands_for_a_component(spark):
    nodes = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1)], "n long, w long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    got = {r["component"]: r["n"] for r in M.strongest(nodes, "n", edges, [F.col("w").desc(), F.col("n").asc()]).collect()}
    assert got == {1: 2, 4: 4}
    assert {r["n"]: r["members"] for r in M.merge(nodes, "n", edges).collect()} == {1: 3, 4: 1}


@pytest.mark.parametrize("box, want", [((-5.0, 0.0, 5.0, 10.0), 0.5), ((0.2, 0.2, 4.8, 4.8), 1.0), ((20.0, 0.0, 30.0, 5.0), 0.0), ((4.0, 4.0, 4.0, 9.0), 0.0)])
def test_visible_ratio(spark, box, want):
    row = spark.createDataFrame([box], "a double, b double, c double, d double")
    assert row.select(B.visible_ratio([F.col(c) for c in "abcd"], 20, 20).alias("r")).first()["r"] == pytest.approx(want)


def test_rotations(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    rows = [(c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0), (2.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, ", ".join(f"m{i} double" for i in range(9)))
    assert [r["ok"] for r in df.select(B.is_rotation([F.col(f"m{i}") for i in range(9)]).alias("ok")).collect()] == [True, False, False]
