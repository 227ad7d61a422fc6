"""Neighbourhood operators on hand grids and against brute force."""

import math
import random

import pytest

from cellweave.plans.proportions import lc_proportions

from cellweave.operators import neighbourhood as near
from cellweave.operators.neighbourhood import focal_majority, focal_means
from cellweave.operators.tiles import circle, square
from cellweave.plans import barren


def as_dict(df, name):
    return {(row["r"], row["c"]): row[name] for row in df.collect()}


def random_cells(seed, height, width, values, holes=0.1):
    rng = random.Random(seed)
    return {
        (r, c): rng.choice(values)
        for r in range(height)
        for c in range(width)
        if rng.random() >= holes
    }


def frame(spark, cells, name="v"):
    return spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], f"r long, c long, {name} int")


def around(cells, at, offsets):
    found = (cells.get((at[0] + dr, at[1] + dc)) for dr, dc in offsets)
    return [v for v in found if v is not None]


def offsets(n, inside):
    return [(dr, dc) for dr in range(-n, n + 1) for dc in range(-n, n + 1) if inside(dr, dc)]


def most_common(values):
    return min(values, key=lambda v: (-values.count(v), v)) if values else None


def test_majority_removes_a_speckle(spark, grid):
    rows = [[41] * 5 for _ in range(5)]
    rows[2][2] = 82
    assert set(as_dict(focal_majority(grid(rows)), "majority").values()) == {41}


def test_majority_tie_and_nodata_centre(spark, grid):
    got = as_dict(focal_majority(grid([[1, 1, 2], [1, None, 2], [1, 2, 2]])), "majority")
    assert got[1, 1] == 1


def test_majority_of_nothing_is_nodata(spark, grid):
    assert as_dict(focal_majority(grid([[None, None]])), "majority") == {(0, 0): None, (0, 1): None}


def test_expand_gives_a_square(spark, grid):
    rows = [[None] * 9 for _ in range(9)]
    rows[4][4] = 31
    got = as_dict(near.expand_class(grid(rows), 31, 3), "expanded")
    assert {at for at, v in got.items() if v == 31} == {(r, c) for r in range(1, 8) for c in range(1, 8)}


def test_distance_limit(spark, grid):
    rows = [[11] * 9 for _ in range(9)]
    rows[0][0] = 32
    got = as_dict(near.euclid_distance(grid(rows), 32, 100.0), "dist")
    assert got[3, 1] == pytest.approx(30 * math.sqrt(10))
    assert got[2, 3] is None
    assert got[0, 3] == 90.0 and got[0, 4] is None
    assert got[0, 0] == 0.0


@pytest.mark.parametrize("tile", [4, 16, 256])
def test_operators_against_brute_force(spark, tile):
    cells = random_cells(tile, 23, 19, [31, 32, 41, None])
    df = frame(spark, cells)
    box = offsets(1, lambda a, b: True)
    want = {at: around(cells, at, box) for at in cells}
    got = as_dict(near.focal_mean_square(df, 1, tile), "mean")
    assert got == {at: (sum(v) / len(v) if v else None) for at, v in want.items()}
    got = as_dict(focal_majority(df, 1, tile), "majority")
    assert got == {at: most_common(v) for at, v in want.items()}

    grown = {at: around(cells, at, offsets(3, lambda a, b: True)) for at in cells}
    got = as_dict(near.expand_class(df, 31, 3, tile), "expanded")
    assert got == {at: 31 if 31 in grown[at] else v for at, v in cells.items()}

    disk = offsets(3, lambda a, b: 900 * (a * a + b * b) < 10000)
    got = as_dict(near.within_distance(df, 32, 100.0, tile=tile), "near")
    assert got == {at: 32 in around(cells, at, disk) for at in cells}


@pytest.mark.parametrize("tile", [8, 64])
def test_circles_against_brute_force(spark, tile):
    cells = random_cells(7, 31, 17, [0, 1, 100, None])
    disk = offsets(6, lambda a, b: a * a + b * b <= 36)
    got = as_dict(focal_means(frame(spark, cells), ["v"], {"m": circle(6)}, tile), "vm")
    want = {at: around(cells, at, disk) for at in cells}
    assert got == {at: (sum(v) / len(v) if v else None) for at, v in want.items()}


def test_circle_sizes():
    assert sum(2 * w + 1 for w in circle(10)) == 317
    assert sum(2 * w + 1 for w in circle(100)) == 31417


def test_tile_side_does_not_change_results(spark):
    df = frame(spark, random_cells(3, 40, 40, [0, 1, None]))
    assert as_dict(near.focal_mean_square(df, 2, 8), "mean") == as_dict(near.focal_mean_square(df, 2, 64), "mean")


def test_negative_cells_are_refused(spark):
    df = spark.createDataFrame([(-1, 0, 1)], "r long, c long, v int")
    with pytest.raises(Exception, match="start at 0"):
        near.focal_mean_square(df).collect()


def test_tile_must_exceed_halo(spark, grid):
    with pytest.raises(ValueError, match="larger than its halo"):
        focal_means(grid([[1]]), ["v"], {"m": circle(10)}, tile=10)


def test_unsorted_and_scattered_cells(spark):
    cells = random_cells(11, 90, 150, [1, 2, None], holes=0.5)
    shuffled = list(cells.items())
    random.Random(0).shuffle(shuffled)
    df = spark.createDataFrame([(r, c, v) for (r, c), v in shuffled], "r long, c long, v int").repartition(7)
    got = as_dict(focal_means(df, ["v"], {"m": circle(4)}, 40), "vm")
    disk = offsets(4, lambda a, b: a * a + b * b <= 16)
    want = {at: around(cells, at, disk) for at in cells}
    assert got == {at: (sum(v) / len(v) if v else None) for at, v in want.items()}


def test_layers_must_hold_whole_numbers(spark):
    df = spark.createDataFrame([(0, 0, 0.5)], "r long, c long, v double")
    with pytest.raises(TypeError, match="whole numbers"):
        near.focal_mean_square(df)


def test_large_values_do_not_overflow(spark):
    big = 2_000_000_000
    df = frame(spark, {(0, c): big for c in range(9)})
    assert set(as_dict(near.focal_mean_square(df, 2), "mean").values()) == {float(big)}


def brute_split(cur, ref, table):
    likely = {at: table.get(v, v) for at, v in ref.items() if v is not None}
    box = offsets(1, lambda a, b: True)
    smooth = {at: most_common(around(likely, at, box)) for at in ref}
    disk = offsets(3, lambda a, b: 900 * (a * a + b * b) < 10000)
    out = {}
    for at, v in cur.items():
        if v == 31:
            if ref.get(at) in (31, 32):
                v = ref[at]
            elif ref.get(at) is None:
                v = None
            elif 32 in around(ref, at, disk):
                v = 32
            elif 31 in around(smooth, at, offsets(3, lambda a, b: True)):
                v = 31
            else:
                v = smooth[at]
        out[at] = v
    return out


@pytest.mark.parametrize("tile", [16, 128])
def test_barren_chain_against_brute_force(spark, tile):
    from cellweave.functions import codes

    rng = random.Random(tile)
    at = [(r, c) for r in range(30) for c in range(20) if rng.random() > 0.05]
    ref = {x: rng.choice([11, 41, 41, 41, 41, 91, 0, None, 52]) for x in at}
    years = {y: {x: rng.choice([31, 31, 41, 11, None, 0]) for x in at} for y in (2001, 2004, 2006)}
    rows = [(r, c, ref[r, c], *[years[y][r, c] for y in years]) for r, c in at]
    df = spark.createDataFrame(rows, "r long, c long, lc_1992 int, lc_2001 int, lc_2004 int, lc_2006 int")
    got = barren.barren_chain(df, [2001, 2004, 2006], tile=tile).cache()
    prev, table = ref, codes.BARREN_FROM_1992
    for y in years:
        prev, table = brute_split(years[y], prev, table), codes.BARREN_FROM_STANDARD
        assert as_dict(got, f"b_{y}") == prev


def test_barren_chain_keeps_existing_years(spark, grid):
    rows = [(0, 0, 41, 31, 31, 32)]
    df = spark.createDataFrame(rows, "r long, c long, lc_1992 int, lc_2001 int, lc_2004 int, b_2001 int")
    out = barren.barren_chain(df, [2001, 2004], existing=(2001,)).first()
    assert (out["b_2001"], out["b_2004"]) == (32, 32)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_neighbourhoods_need_one_shuffle(spark, grid):
    cells = grid([[1, 2], [3, 4]])
    for out in (
        near.focal_mean_square(cells),
        focal_majority(cells),
        near.expand_class(cells, 31, 3),
        near.within_distance(cells, 32, 100.0),
    ):
        assert exchanges(out) == 1


def test_a_chain_of_years_needs_one_shuffle(spark):
    df = spark.createDataFrame([(0, 0, 41, 31, 31)], "r long, c long, lc_1992 int, lc_2001 int, lc_2004 int")
    assert exchanges(barren.barren_chain(df, [2001, 2004])) == 1


def test_cells_far_from_barren_ones_are_not_shuffled(spark):
    cells = [(r, c, 31 if (r, c) == (10, 10) else 41, 31) for r in range(0, 400, 2) for c in range(0, 400, 2)]
    stack = spark.createDataFrame(cells, "r long, c long, cur int, ref int")
    marked = barren.mark_barren(stack, ["cur"], barren.REACH)
    blocks = {(x.r // 64, x.c // 64): x._barren for x in marked.collect()}
    assert {k for k, v in blocks.items() if v == 1} == {(0, 0)}
    assert {k for k, v in blocks.items() if v == 0} == {(0, 1), (1, 0), (1, 1)}
    out = barren.barren_split(stack, "cur", "ref", "standard")
    assert out.count() == len(cells) and {x.v for x in out.collect()} == {31, 41}


def test_cells_outside_the_study_area_keep_a_mean(spark):
    stack = spark.createDataFrame([(r, c, 41) for r in range(6) for c in range(12)], "r long, c long, cover int")
    mask, area = stack.select("r", "c"), stack.filter("c < 4").select("r", "c")
    out = lc_proportions(stack, "cover", mask, None, None, area=area, shapes={"1": square(1)}, tile=5)
    got = {(x.r, x.c): x.v for x in out.filter("name = 'dfr1'").collect()}
    assert got == {(r, c): 10000 if c <= 4 else 0 for r in range(6) for c in range(12)}


def test_proportions_mark_and_pack_cells_in_one_pass(spark):
    """One Python worker a task reads the cells, whether the study area, the mask, both or neither mark them."""
    stack = spark.createDataFrame([(r, c, 41) for r in range(6) for c in range(12)], "r long, c long, cover int")
    sets = {"mask": stack.filter("r > 0").select("r", "c"), "area": stack.filter("c < 4").select("r", "c")}
    for names in ((), ("mask",), ("area",), ("mask", "area")):
        chosen = {n: sets[n] for n in names}
        out = lc_proportions(stack, "cover", impervious=None, canopy=None, shapes={"1": square(1)}, tile=5, **chosen)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow ") == 1, names
        got = {(x.r, x.c): x.v for x in out.filter("name = 'dfr1'").collect()}
        known, kept = (lambda c: c <= 4 if "area" in names else True), (lambda r: r > 0 or "mask" not in names)
        assert got == {(r, c): 10000 if known(c) else 0 for r in range(6) for c in range(12) if kept(r)}
