"""Scene queries against their SQL, and literal cases of the functions."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from voxelyard.functions import geometry as G
from voxelyard.functions import text as T
from voxelyard.operators import iterative as I
from voxelyard.operators import relational as R
from voxelyard.plans.registry import ORACLE, QUERIES, load

load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(v[i], 5) if isinstance(v[i], float) else v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
    assert sorted(got.columns) == sorted(names)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("stem,want", [
    ("CTX__door__000__area1234", ("object", "door", "000")),
    ("INT__door_handle__000__area3475", ("affordance", "door_handle", "000")),
    ("instance_0007__INT__door_handle__012__area5", ("affordance", "door_handle", "012")),
    ("CTX__doors__1234", ("object", "door", "1234")),
    ("INT__knob__id000123", ("affordance", "knob id000123", "000")),
    ("CTX__door__handle__000__area1", ("object", "door handle", "000")),
    ("INT_door_handle_000_area5", ("affordance", "door handle", "000")),
    ("CTX__door__AREA12", ("object", "door", "000")),
    ("CTXdoor__001", ("object", "door", "001")),
    ("ctx__door__7", ("object", "ctx door", "007")),
    ("INT____door____3", ("affordance", "door", "003")),
    ("", ("object", "unknown", "000")),
    ("chair", ("object", "chair", "000")),
])
def test_mask_parts(spark, stem, want):
    assert tuple(one(spark, T.mask_parts(F.lit(stem)))) == want


@pytest.mark.parametrize("said,want", [("hook_pull door handle", "door handle"), ("rotate door handle", "door handle"), ("push button", "button"), ("drawer handle,drawer front", "drawer handle"), ("socket opening", "socket"), ("drawer", "drawer handle"), ("n/a", ""), ("twist knob", "knob"), ("open door", "open door"), ("Rotate Handle", "Handle"), ("pinch pull  ring , x", "ring"), ("", ""), (None, "")])
def test_interactive_object(spark, said, want):
    assert one(spark, T.interactive_object(F.lit(said))) == want


def test_fnv_of_abc(spark):
    assert one(spark, T.fnv1a(F.lit("abc"))) == 440920331
    assert one(spark, T.fnv1a(F.lit(""))) == 2166136261


def test_numbers_as_text(spark):
    """As Python and SQL write them: 6.0E-4 is 0.0006."""
    values = [0.0006, 0.0001, 0.00012345, 0.0009999, 0.00001234, 1e-5, 1.5e-12, 0.0, 0.001, 11.2, -0.0004, -3.0, 1e7, 123456789.5, 12345678.0, 1e15, 9.5e15, 1e16, 1.25e17, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.number_text(F.col("v")).alias("t"))
    assert [r["t"] for r in df.collect()] == [repr(v) for v in values]
    assert spark.sql("SELECT CAST(null AS double) AS v").select(T.number_text(F.col("v"))).first()[0] is None


def test_model_answers_of_small_values(spark, tmp_path):
    from datetime import datetime

    rows = [(k, datetime(2024, 1, 1), k, "view", v, '{"k": 1}') for k, v in ((1, 0.03), (6, 0.005), (11, 0.0004), (16, 560.0))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.connect().execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'").execute(ORACLE["model_answers"]).fetchall()
    got = QUERIES["model_answers"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["nearest_on_axis", "precision_curve"])
def test_windows_run_from_the_start(spark, name):
    """No frame reaches from a row to the end: each row would read all rows after it."""
    df = spark.createDataFrame([(0, 1, 1.0)], "g int, k int, x double")
    out = R.nearest_on_axis(df, df.withColumnRenamed("k", "i"), "g", "x", "i", "k") if name == "nearest_on_axis" else R.precision_curve(df, ["g"], [F.col("x").desc()], F.col("k") == 1, "k")
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower().replace("$", "")


def test_list_cells(spark):
    assert one(spark, T.list_cell(F.lit("['a', 'b']"))) == ["a", "b"]
    assert one(spark, T.list_cell(F.lit("a; b"))) == ["a", "b"]


@pytest.mark.parametrize("expr,want", [
    (lambda: T.list_cell(F.lit("[a, b] c")), ["[a", "b] c"]),
    (lambda: T.object_cell(F.lit("Door_Handle|x-y")), ["door handle", "x y"]),
    (lambda: T.single_or_list(F.lit("'a, b'")), ["a, b"]),
    (lambda: T.single_or_list(F.lit('["a", " "]')), ["a"]),
    (lambda: T.all_objects(F.lit("['push drawer', 'drawer handle', 'n/a']")), ["drawer handle"]),
    (lambda: T.prompt_list(F.array(F.lit("A, b"), F.lit(None), F.lit("a"), F.lit("none"))), ["A", "b"]),
    (lambda: T.split_prompts(F.lit("Wall  switch; pull chain;wall switch")), ["Wall switch", "pull chain"]),
    (lambda: T.frame_numbers(F.array(F.lit("36"), F.lit("5-3"), F.lit(" "), F.lit("4"))), [3, 4, 5, 36]),
    (lambda: T.first_object(F.lit('x {"a": {"b": 1}} {"c": 2}')), '{"a": {"b": 1}}'),
    (lambda: T.first_object(F.lit("{ {")), None),
    (lambda: T.clamp01(F.lit("1.7")), 1.0),
    (lambda: T.clamp01(F.lit("x")), None),
    (lambda: T.whole_id(F.lit(" 12 ")), 12),
    (lambda: T.whole_id(F.lit("1.5")), None),
    (lambda: T.handle_group(F.lit("Rotate_door handle")), "door_handle_group"),
    (lambda: T.video_prompt(F.lit("door handle"), F.lit("CTX")), "door handle"),
    (lambda: T.second_prompt(F.lit("Door Handle ")), "rotate door handle"),
    (lambda: T.instance_name(F.lit(7), F.lit("a.png")), "instance_0007__a.png"),
    (lambda: T.mask_name(F.lit("INT"), F.lit("knob"), F.lit(3), F.lit(9)), "INT__knob__003__area9"),
    (lambda: T.frame_path(F.lit("/o/x"), F.lit(36)), "/o/x_f0036.jpg"),
    (lambda: T.slug(F.lit("a" * 79 + " bc")), "a" * 79),
    (lambda: T.clean_phrase(F.lit("Opening-socket")), "socket"),
    (lambda: T.normalize_prompt(F.lit(" a \t b ")), "a b"),
])
def test_phrases(spark, expr, want):
    assert one(spark, expr()) == want


def test_name_maps():
    cycle = I.closed_map({"A": "B", "B": "C", "C": "A", "X": "A"})
    assert cycle == {"A": "B", "B": "C", "C": "A", "X": "A"}
    assert I.closed_map({"a": "b", "b": "c"}) == {"a": "c", "b": "c"} and I.closed_map({"a": "a"}) == {"a": "a"}
    assert I.name_map({"groups": [["Door", "gate", "DOORS"]], "map": {"x": "Handles", "": "y"}}) == {"x": "handle", "door": "door", "gate": "door"}
    assert I.name_map({"Drawers": " big  drawer"}) == {"drawer": "big drawer"}


def test_natural_order(spark):
    df = spark.createDataFrame([("f10",), ("f9",), ("F1",)], "n string")
    assert [r["n"] for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["F1", "f9", "f10"]


def test_rigid_inverse():
    t = [0.0, -1.0, 0.0, 2.0, 1.0, 0.0, 0.0, -3.0, 0.0, 0.0, 1.0, 0.5, 0, 0, 0, 1]
    p = G.apply_rigid(G.invert_rigid(t), *G.apply_rigid(t, 1.0, 2.0, 3.0))
    assert p == (1.0, 2.0, 3.0)


def test_rodrigues_quarter_turn(spark):
    m = [one(spark, e) for e in G.rodrigues(F.lit(0.0), F.lit(0.0), F.lit(1.5707963267948966))]
    assert [round(x, 9) + 0.0 for x in m] == [0, -1, 0, 1, 0, 0, 0, 0, 1]


def test_zbuffer_has_one_winner_whatever_the_partitions(spark):
    df = spark.createDataFrame([(0, 1, 2.0, 7), (0, 1, 2.0, 3), (0, 2, 1.0, 9)], "f int, px int, z double, p int")
    for n in (1, 3):
        got = R.nearest(df.repartition(n), ["f", "px"], [F.col("z").asc(), F.col("p").asc()])
        assert sorted((r["px"], r["p"]) for r in got.collect()) == [(1, 3), (2, 9)]


@pytest.mark.parametrize("dense,block,tile", [(3000, 400_000, 1 << 22), (3000, 50, 100), (5, 60, 40), (0, 400_000, 1 << 22)])
def test_pair_counts_by_matrix_and_one_by_one(spark, monkeypatch, dense, block, tile):
    """The limits change how pairs are counted, not what is counted."""
    rng = random.Random(3)
    sets = sorted({(rng.randrange(30), min(rng.randrange(40), rng.randrange(40))) for _ in range(500)})
    want = {}
    for p in range(40):
        nodes = [n for n, q in sets if q == p]
        for a, b in itertools.combinations(nodes, 2):
            want[a, b] = want.get((a, b), 0) + 1
    for name, value in (("DENSE", dense), ("BLOCK", block), ("TILE", tile)):
        monkeypatch.setattr(R, name, value)
    rows = spark.createDataFrame(sets, "n long, p int")
    for point in (F.col("p"), F.struct("p", (F.col("p") * 2).alias("q"))):
        got = R.pair_counts(rows.select("n", point.alias("x")), "n", "x").collect()
        assert {(r["a"], r["b"]): r["inter"] for r in got} == want
    assert R.pair_counts(rows.filter("n < 0"), "n", "p").count() == 0


@pytest.mark.parametrize("side", [4, 1024])
def test_few_points_are_counted_as_bits(spark, monkeypatch, side):
    """Blocks of nodes meet pairwise; a forest of the pairs connects what the pairs connect."""
    rng = random.Random(6)
    sets = sorted({(rng.randrange(40), rng.randrange(12)) for _ in range(160)})
    of = {n: {p for m, p in sets if m == n} for n, _ in sets}
    at = {n: rng.uniform(0, 3) for n in of}
    monkeypatch.setattr(R, "SIDE", side)
    rows = spark.createDataFrame(sets, "n long, p int")
    assert R.few_points(rows, "n", "p")
    every = {(a, b): len(of[a] & of[b]) for a, b in itertools.combinations(sorted(of), 2) if of[a] & of[b]}
    got = R.overlap_pairs(rows, "n", "p", 1, 0.0).collect()
    assert len(got) == len(every) and {(r["a"], r["b"]): (r["inter"], r["size_a"], r["size_b"]) for r in got} == {(a, b): (k, len(of[a]), len(of[b])) for (a, b), k in every.items()}
    linked = {(a, b) for (a, b), k in every.items() if a % 2 == b % 2 and abs(at[a] - at[b]) < 1 and k / len(of[a] | of[b]) >= 0.3}
    near = (spark.createDataFrame(list(at.items()), "n long, at double"), 1.0)
    some = {(r["a"], r["b"]) for r in R.bit_pairs(rows, "n", "p", min_iou=0.3, within=lambda n: n % 2, near=near, forest=True).collect()}

    def groups(pairs):
        label = {n: n for n in of}
        for _ in of:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert some <= linked and groups(some) == groups(linked)


@pytest.mark.parametrize("masks,cells", [(2048, 1 << 22), (3, 12)])
def test_overlaps_leave_the_task_only_if_asked_for(spark, monkeypatch, masks, cells):
    from voxelyard.operators import masks as M

    rng = random.Random(8)
    px = sorted({(f"f{rng.randrange(3)}", rng.randrange(2), rng.randrange(9), rng.randrange(14)) for _ in range(220)})
    of = {}
    for s, f, i, p in px:
        of.setdefault((s, f), {}).setdefault(i, set()).add(p)
    want = {(s, f, a, b): (len(x[a] & x[b]), len(x[a]), len(x[b]), a % 2, b % 2) for (s, f), x in of.items() for a, b in itertools.combinations(sorted(x), 2) if len(x[a] & x[b]) / min(len(x[a]), len(x[b])) >= 0.5}
    monkeypatch.setattr(M, "MASKS", masks)
    monkeypatch.setattr(M, "CELLS", cells)
    rows = spark.createDataFrame(px, "s string, f int, item long, pixel int").withColumn("odd", F.col("item") % 2)
    got = M.overlaps(rows, ["s", "f"], "item", least=0.5, carry="odd")
    assert {(r["s"], r["f"], r["a"], r["b"]): (r["inter"], r["area_a"], r["area_b"], r["odd_a"], r["odd_b"]) for r in got.collect()} == want
    assert "Join" not in str(got._jdf.queryExecution().executedPlan())  # sizes come with the pairs
    assert M.overlaps(rows.filter("f < 0"), ["s", "f"], "item").count() == 0


@pytest.mark.parametrize("tile,block", [(1 << 22, 400_000), (30, 7)])
def test_sized_pairs_against_plain(spark, monkeypatch, tile, block):
    rng = random.Random(9)
    left, right = (sorted({(rng.randrange(15), rng.randrange(20)) for _ in range(110)}) for _ in "lr")
    a, b = ({n: {p for m, p in x if m == n} for n, _ in x} for x in (left, right))
    every = {(i, j, len(x & y), len(x), len(y)) for i, x in a.items() for j, y in b.items() if x & y}
    monkeypatch.setattr(R, "TILE", tile)
    monkeypatch.setattr(R, "BLOCK", block)
    pair = lambda **how: R.sized_pairs(spark.createDataFrame(left, "g int, p int"), spark.createDataFrame(right, "n long, p int"), "p", "g", "n", **how)
    of = lambda df: sorted((r["g"], r["n"], r["inter"], r["n_g"], r["n_n"]) for r in df.collect())
    assert of(pair()) == sorted(every)
    assert of(pair(same=3)) == sorted(r for r in every if r[0] % 3 == r[1] % 3)
    top = [min((r for r in every if r[0] == i), key=lambda r: (-r[2] / (r[3] + r[4] - r[2]), r[1])) for i in sorted({r[0] for r in every})]
    assert of(pair(best=True)) == top
    assert "Window" not in str(pair(best=True)._jdf.queryExecution().executedPlan())  # the best is found where pairs are counted


def test_overlap_pairs_of_many_points(spark, monkeypatch):
    """Pairs of too little overlap don't leave the task that counts them: no row of theirs is grouped by a pair."""
    rng = random.Random(10)
    sets = sorted({(rng.randrange(25), rng.randrange(2000) ** 2 // 2000) for _ in range(700)})
    of = {n: {p for m, p in sets if m == n} for n, _ in sets}
    want = {(a, b): len(of[a] & of[b]) for a, b in itertools.combinations(sorted(of), 2) if len(of[a] & of[b]) >= 2 and len(of[a] & of[b]) / min(len(of[a]), len(of[b])) >= 0.1}
    rows = spark.createDataFrame(sets, "n long, p int")
    monkeypatch.setattr(R, "few_points", lambda *_: False)
    got = R.overlap_pairs(rows, "n", "p", 2, 0.1)
    assert {(r["a"], r["b"]): r["inter"] for r in got.collect()} == want
    assert not re.search(r"Aggregate \[a#\d+L?, b#", str(got._jdf.queryExecution().optimizedPlan()))


def test_nearest_on_axis_against_plain(spark):
    rng = random.Random(4)
    left = [(k, rng.randrange(3), float(rng.randrange(30))) for k in range(60)]
    right = [(k, rng.randrange(2), float(rng.randrange(30))) for k in range(25)]
    want = {k: min(((abs(x - y), j) for j, h, y in right if h == g), default=(None, None)) for k, g, x in left}
    got = R.nearest_on_axis(spark.createDataFrame(left, "row int, g int, x double"), spark.createDataFrame(right, "item int, g int, x double"), "g", "x", "item", "row")
    assert {r["row"]: (r["dist"], r["item"]) for r in got.collect()} == want


def test_box_pairs_and_ranks(spark):
    rng = random.Random(5)
    rows = [(k, k % 3, x := rng.uniform(-9, 9), x + rng.uniform(0, 4)) for k in range(70)]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    boxes = spark.createDataFrame(rows, "k int, name int, l double, h double")
    got = [(r["a_k"], r["b_k"]) for r in R.box_pairs(boxes, "k", "name", ["l"], ["h"]).collect()]
    assert set(got) == want and len(got) == len(want)
    order = [F.col("name").desc(), F.col("l").asc()]
    places = [r["k"] for r in R.ranked(boxes, order, "place").orderBy("place").collect()]
    assert places == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
