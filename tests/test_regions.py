"""Parts, buffers, holes and wraps on hand grids and against brute force."""

import random

import pytest

from pyspark.sql import GroupedData

from cellweave import session
from cellweave.operators import components, regions, runs


def cell_set(df):
    return {(row["r"], row["c"]) for row in df.collect()}


def by_part(df, *keys):
    out = {}
    for row in df.collect():
        out.setdefault((*[row[k] for k in keys], row["part_r"], row["part_c"]), set()).add((row["r"], row["c"]))
    return out


def brute_parts(cells, diagonal=True):
    left, parts = set(cells), {}
    while left:
        first = min(left)
        todo, part = [first], {first}
        while todo:
            r, c = todo.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    at = (r + dr, c + dc)
                    if at in cells and at not in part and (diagonal or not dr * dc):
                        part.add(at)
                        todo.append(at)
        parts[first] = part
        left -= part
    return parts


def disk(k):
    n = int(k)
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= k * k]


def grow(cells, k):
    return {(r + a, c + b) for r, c in cells for a, b in disk(k)}


def shrink(cells, k):
    return {(r, c) for r, c in cells if all((r + a, c + b) in cells for a, b in disk(k))}


def random_region(spark, seed, side, density):
    rng = random.Random(seed)
    cells = {(r, c) for r in range(side) for c in range(side) if rng.random() < density}
    return cells, spark.createDataFrame([(0, r, c) for r, c in cells], "feat_id long, r long, c long")


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("seed, density", [(1, 0.35), (2, 0.6)])
def test_parts_across_tiles(spark, seed, density, diagonal):
    cells, df = random_region(spark, seed, 24, density)
    labelled = components.label_parts(runs.to_runs(df, []), [], diagonal, tile=4)
    assert by_part(runs.to_cells(labelled)) == brute_parts(cells, diagonal)


def test_a_spiral_is_one_part(spark):
    side, path, at, step = 21, set(), (0, 0), (0, 1)
    seen = {at}
    while True:
        path.add(at)
        for turn in (step, (step[1], -step[0])):
            nxt = (at[0] + turn[0], at[1] + turn[1])
            after = (nxt[0] + turn[0], nxt[1] + turn[1])
            if 0 <= nxt[0] < side and 0 <= nxt[1] < side and nxt not in seen and after not in path:
                at, step = nxt, turn
                seen.add(at)
                break
        else:
            break
    assert len(path) > 150
    df = spark.createDataFrame([(0, r, c) for r, c in path], "feat_id long, r long, c long")
    labelled = components.label_parts(runs.to_runs(df, ["feat_id"]), ["feat_id"], False, tile=4)
    assert by_part(runs.to_cells(labelled)) == brute_parts(path, False)


def test_features_stay_apart(spark, region):
    got = by_part(regions.explode_parts(region("aabb", "a.b.")), "feat_id")
    assert got == {(0, 0, 0): {(0, 0), (0, 1), (1, 0)}, (1, 0, 2): {(0, 2), (0, 3), (1, 2)}}
    merged = by_part(regions.dissolve_parts(region("aabb", "a.b.")))
    assert list(merged) == [(0, 0)]


def test_null_and_repeated_cells(spark):
    df = spark.createDataFrame(
        [(0, 0, 0), (0, 0, 0), (0, None, 3), (0, 0, 1)], "feat_id long, r long, c long"
    )
    assert by_part(regions.explode_parts(df), "feat_id") == {(0, 0, 0): {(0, 0), (0, 1)}}


def test_diagonal_cells_touch(spark, region):
    assert len(by_part(regions.dissolve_parts(region("a.", ".a")))) == 1


@pytest.mark.parametrize("distance", [30.0, 45.0, 60.0, 100.0])
def test_buffers_against_brute_force(spark, distance):
    cells, df = random_region(spark, 5, 20, 0.8)
    assert cell_set(regions.buffer_dilate(df, distance)) == grow(cells, distance / 30)
    assert cell_set(regions.buffer_erode(df, distance)) == shrink(cells, distance / 30)


def test_buffers_keep_or_merge_features(spark, region):
    df = region("a.b")
    kept = {(row["feat_id"], row["r"], row["c"]) for row in regions.buffer_dilate(df, 30.0, merge=False).collect()}
    assert (0, 0, 1) in kept and (1, 0, 1) in kept
    rows = regions.buffer_dilate(df, 30.0).collect()
    assert len(rows) == len({(row["r"], row["c"]) for row in rows})


RING = ("aaaaaaa", "a.....a", "a.aaa.a", "a.a.a.a", "a.aaa.a", "a.....a", "aaaaaaa")


def fill(df, **limits):
    parts = components.label_parts(runs.to_runs(df, ["feat_id"]), ["feat_id"], tile=4)
    return runs.to_cells(regions.fill_holes(parts, ["feat_id"], **limits))


def test_small_holes_are_filled(spark, region):
    df = region(*RING)
    solid = {(r, c) for r, row in enumerate(RING) for c, x in enumerate(row) if x == "a"}
    assert cell_set(fill(df, below_area=900.0)) == solid
    assert cell_set(fill(df, below_area=901.0)) == solid | {(3, 3)}
    # The gap of the outer ring holds the inner part: 25 cells in all.
    square = {(r, c) for r in range(7) for c in range(7)}
    assert cell_set(fill(df, below_area=25 * 900.0)) == solid | {(3, 3)}
    assert cell_set(fill(df, below_area=25 * 900.0 + 1)) == square
    assert cell_set(fill(df, below_percent=99.0)) == square
    assert cell_set(fill(df, below_percent=50.0)) == solid | {(3, 3)}


def test_open_gaps_stay(spark, region):
    rows = ("aaaa", "a..a", "aa.a", "aa..")
    df = region(*rows)
    assert cell_set(fill(df, below_percent=100.0)) == cell_set(df)


def test_a_gap_open_at_a_corner_is_a_hole(spark, region):
    # Gaps are 4-connected, parts 8-connected.
    df = region(".aa", "a.a", "aaa")
    assert (1, 1) in cell_set(fill(df, below_percent=99.0))


def brute_holes(part):
    r0, r1 = min(r for r, _ in part) - 1, max(r for r, _ in part) + 1
    c0, c1 = min(c for _, c in part) - 1, max(c for _, c in part) + 1
    free = {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - part
    return [gap for gap in brute_parts(free, False).values() if (r0, c0) not in gap]


@pytest.mark.parametrize("seed", range(3))
def test_holes_against_brute_force(spark, seed):
    cells, df = random_region(spark, seed, 26, 0.62)
    want = {}
    for first, part in brute_parts(cells).items():
        want[(0, *first)] = part.union(*[g for g in brute_holes(part) if len(g) < 4])
    assert by_part(fill(df, below_area=4 * 900.0), "feat_id") == want


def test_closing_merges_and_opening_separates(spark, region):
    blocks = region("aaa.bbb", "aaa.bbb", "aaa.bbb")
    closed = regions.coalesce_regions(blocks, 30.0)
    assert len(by_part(closed)) == 1
    assert cell_set(closed) >= cell_set(blocks)
    bridge = region("aaaaaa......aaaaaa", *["aaaaaaaaaaaaaaaaaa" if r == 2 else "aaaaaa......aaaaaa" for r in range(1, 5)])
    opened = regions.coalesce_regions(bridge, -30.0)
    assert len(by_part(opened)) == 2
    assert cell_set(opened) <= cell_set(bridge)
    with pytest.raises(ValueError, match="zero"):
        regions.coalesce_regions(blocks, 0)


@pytest.mark.parametrize("seed", range(2))
def test_closing_and_opening_against_brute_force(spark, seed):
    cells, df = random_region(spark, seed, 22, 0.3)
    got = by_part(regions.coalesce_regions(df, 60.0))
    assert got == brute_parts(shrink(grow(cells, 2), 2))
    assert set().union(*got.values()) >= cells
    cells, df = random_region(spark, seed, 22, 0.85)
    got = by_part(regions.coalesce_regions(df, -30.0))
    assert got == brute_parts(grow(shrink(cells, 1), 1))


@pytest.mark.parametrize("seed", range(2))
def test_fine_cells_lose_small_gaps_between_buffers(spark, seed):
    """With cells of 10 m a gap of eight cells is below 900 square metres."""
    cells, df = random_region(spark, seed, 18, 0.25)
    grown = grow(cells, 1)
    want = {}
    for part in brute_parts(grown).values():
        part = part.union(*[g for g in brute_holes(part) if len(g) * 100 < 900])
        want |= brute_parts(shrink(part, 1))
    assert by_part(regions.coalesce_regions(df, 10.0, size=10.0)) == want


def test_distances_as_text(spark, region):
    assert regions.metres("100 METERS") == 100.0 and regions.metres("0.5 KILOMETERS") == 500.0
    assert regions.metres(-30) == -30.0
    with pytest.raises(ValueError, match="unit"):
        regions.metres("3 PARSECS")
    df = region("a")
    assert cell_set(regions.buffer_dilate(df, "30 METERS")) == grow({(0, 0)}, 1)


def test_shrink_wrap(spark, region):
    df = region(
        "aaa..b............c",
        "aaa..b............c",
        "a.a..b............c",
        "aaa..b............c",
    )
    got = regions.shrink_wrap(df, 60.0, smooth=2)
    wraps = {}
    for row in got.collect():
        wraps.setdefault((row["wrap_r"], row["wrap_c"]), set()).add((row["r"], row["c"]))
    assert len(wraps) == 2
    left = min(wraps.values(), key=lambda cells: min(c for _, c in cells))
    assert (2, 1) in left and (1, 4) in left
    with pytest.raises(ValueError, match="positive"):
        regions.shrink_wrap(df, 0)


def test_clip_and_erase_split_parts(spark, region):
    df = region("aaaaa")
    hole = region("..x").select("r", "c")
    assert set(by_part(regions.clean_erase(df, hole), "feat_id")) == {(0, 0, 0), (0, 0, 3)}
    assert cell_set(regions.clean_clip(df, hole)) == {(0, 2)}


def test_selection(spark, region):
    df = region("aab", "..b")
    assert [row["feat_id"] for row in regions.select_by_location(df, region(".x").select("r", "c")).collect()] == [0]
    assert tuple(regions.count_selected(df, df["c"] > 1).first()) == (1, 2)


def test_columns_beyond_the_range_of_part_names_are_refused(spark):
    far = 1 << 28
    cells = spark.createDataFrame([(0, 0, far + 3), (0, 1, -far + 3)], "feat_id long, r long, c long")
    with pytest.raises(Exception, match="columns of parts have to lie"):
        regions.explode_parts(cells).collect()
    edge = spark.createDataFrame([(0, 0, far - 1), (0, 1, -far)], "feat_id long, r long, c long")
    assert set(by_part(regions.explode_parts(edge))) == {(0, far - 1), (1, -far)}


def test_features_of_a_tile_are_labelled_apart(spark):
    cells = {f: {(r, c) for r in range(12) for c in range(12) if (r * 7 + c * 5 + f) % 3} for f in range(5)}
    rows = [(f, r, c) for f, of in cells.items() for r, c in of]
    got = by_part(regions.explode_parts(spark.createDataFrame(rows, "feat_id long, r long, c long"), tile=5), "feat_id")
    assert got == {(f, *first): part for f, of in cells.items() for first, part in brute_parts(of).items()}


@pytest.mark.parametrize("block", [4, 8192])
def test_runs_meet_in_blocks(spark, block):
    rng = random.Random(block)
    a = {(r, c) for r in range(6) for c in range(40) if rng.random() < 0.8}
    b = {(r, c) for r in range(5) for c in range(40) if rng.random() < 0.5}
    make = lambda cells: spark.createDataFrame(sorted(cells), "r long, c long")
    ra, rb = runs.to_runs(make(a), []), runs.to_runs(make(b), [])
    assert cell_set(runs.to_cells(runs.intersect(ra, rb, [], block))) == a & b
    outside = runs.subtract(ra, rb, [], block)
    assert cell_set(runs.to_cells(outside)) == a - b
    merged = runs.merge_runs(ra.unionByName(rb), [], block)
    assert cell_set(runs.to_cells(merged)) == a | b
    spans = [(x.r, x.c0, x.c1) for x in merged.collect()]
    assert all((r, c1 + 1) not in a | b and (r, c0 - 1) not in a | b for r, c0, c1 in spans)
    eroded = runs.erode(merged, 1.0, 1.0, [], block)
    assert cell_set(runs.to_cells(eroded)) == shrink(a | b, 1)


def test_steps_are_removed(spark):
    session.clear_steps(spark)
    regions.explode_parts(spark.createDataFrame([(0, r, r) for r in range(20)], "feat_id long, r long, c long"), tile=4).count()
    place = spark._jvm.org.apache.hadoop.fs.Path(session.shared_dir(spark))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    before = len(files.listStatus(place))
    # The pieces and what their labels became are still read; the levels are gone.
    assert session.clear_steps(spark) == 2
    assert len(files.listStatus(place)) == before - 2


@pytest.mark.parametrize("alone", [100_000, 0])
@pytest.mark.parametrize("diagonal", [True, False])
def test_levels_and_one_step_agree(spark, monkeypatch, alone, diagonal):
    """A spiral, a comb and scattered cells over many tiles, negative rows and columns among them."""
    monkeypatch.setattr(components, "ALONE", alone)
    spiral, r, c, step = set(), 0, 0, 40
    for dr, dc in [(0, 1), (1, 0), (0, -1), (-1, 0)] * 8:
        for _ in range(step):
            spiral.add((r - 20, c - 20))
            r, c = r + dr, c + dc
        step -= 2 * (dc == 0)
    comb = {(x, 60) for x in range(-20, 30)} | {(x, y) for x in range(-20, 30, 2) for y in range(60, 75)}
    other, _ = random_region(spark, 5, 30, 0.4)
    cells = spiral | comb | {(r + 40, c + 3) for r, c in other}
    df = spark.createDataFrame(sorted(cells), "r long, c long")
    found = by_part(runs.to_cells(components.label_parts(runs.to_runs(df, []), [], diagonal, tile=4)))
    assert found == brute_parts(cells, diagonal)


def test_small_tiles_share_calls(spark, monkeypatch):
    """Small tiles and squares are labelled many in a call, all features of them too."""
    calls, apply = [], GroupedData.applyInArrow

    def counted(self, func, schema):
        calls.append(self.count().count())
        return apply(self, func, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", counted)
    cells = [(c // 25, r, c) for r in range(60) for c in range(50) if r % 4 == 0 or c % 7 == r % 11]
    df = spark.createDataFrame(cells, "feat_id long, r long, c long")
    few = regions.explode_parts(df, tile=2).collect()
    assert max(calls) == 1
    assert sorted(few) == sorted(regions.explode_parts(df).collect())
    assert len({x[:3] for x in few}) > 2
