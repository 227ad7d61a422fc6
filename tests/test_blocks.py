"""Block log, coded layers, quadtree covers, the distance transform, pyramids, gathers and barren marks."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import session
from cellweave.model import CELLS, GridSpec
from cellweave.operators import distance, overlay, quadtree
from cellweave.operators.neighbourhood import euclid_distance
from cellweave.operators.runs import to_runs
from cellweave.plans import barren
from cellweave.sources import blocklog, coded
from cellweave.sources import cells as store
from cellweave.streaming.ingest import ingest_batch


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, cells):
    return spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "r long, c long, v int")


def scattered(seed, height, width, values, keep=0.8, r0=0, c0=0):
    rng = random.Random(seed)
    return {(r0 + r, c0 + c): rng.choice(values) for r in range(height) for c in range(width) if rng.random() < keep}


# ---- block log


def lots(spark, cells, layer="lc_1", year=1):
    return spark.createDataFrame([(layer, year, r, c, v) for (r, c), v in cells.items()], CELLS)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(0)
    for at in (np.array([], int), np.array([0]), np.array([1024 * 1024 - 1]), rng.choice(1 << 20, 5000, replace=False)):
        flags = blocklog.from_bitmap(blocklog.to_bitmap(at))
        assert np.array_equal(np.flatnonzero(flags), np.sort(at))


def test_log_of_blocks(spark):
    cells = scattered(1, 9, 30, [1, -2, 2**31 - 1, None], r0=-3, c0=-7)
    df = lots(spark, cells).withColumn("batch", F.lit("x")).repartition(3)
    found = {(e.br, e.bc): e for e in blocklog.entries(df, 8).collect()}
    for key in {(r // 8, c // 8) for r, c in cells}:
        own = {at: v for at, v in cells.items() if (at[0] // 8, at[1] // 8) == key}
        entry, known = found.pop(key), [v for v in own.values() if v is not None]
        places = {(key[0] * 8 + i // 8, key[1] * 8 + i % 8) for i in np.flatnonzero(blocklog.from_bitmap(entry.cells, 8))}
        assert places == set(own) and entry.n == len(own)
        assert (entry.r0, entry.r1) == (min(r for r, _ in own), max(r for r, _ in own))
        assert (entry.c0, entry.c1) == (min(c for _, c in own), max(c for _, c in own))
        assert (entry.v0, entry.v1) == (min(known, default=None), max(known, default=None))
        assert (entry.known, entry.s1, entry.s2) == (len(known), sum(known), sum(v * v for v in known))
    assert not found


def test_a_late_lot_reads_the_entries_of_its_blocks_only(spark, tmp_path):
    target = str(tmp_path / "store")
    wide = {(r, c): r + c for r in range(0, 4000, 250) for c in range(0, 4000, 250)}
    ingest_batch(lots(spark, wide), target, "a")
    ingest_batch(lots(spark, wide, "lc_2", 2), target, "a2")
    late = {(10, 10): 1, (0, 0): 9, (1030, 2050): 2}
    packed = blocklog.pack_blocks(lots(spark, late))
    log = blocklog.touched(store.block_log(spark, target), packed)
    assert all(target + ".blocks/" in f for f in log.inputFiles())
    scan = log._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert scan.selectedPartitions().totalNumberOfFiles() == 2  # of 32
    assert {(x.layer, x.br, x.bc) for x in log.collect()} == {("lc_1", 0, 0), ("lc_1", 1, 2)}
    missing = blocklog.lacking(packed, log)
    assert target + "/" not in plan(missing) and not any(target + "/" in f for f in missing.inputFiles())
    assert rows(blocklog.unpack_blocks(missing), "r", "c", "v") == [(10, 10, 1), (1030, 2050, 2)]
    ingest_batch(lots(spark, late), target, "b")
    ingest_batch(lots(spark, late), target, "b")  # again: its own cells do not count as stored
    want = {("lc_1", *at): v for at, v in ({**late, **wide}).items()} | {("lc_2", *at): v for at, v in wide.items()}
    got = {(x.layer, x.r, x.c): x.v for x in store.read_cells(spark, target).collect()}
    assert got == want
    # More blocks than are named one by one: the same cells.
    assert rows(blocklog.unpack_blocks(blocklog.lacking(packed, blocklog.touched(store.block_log(spark, target), packed, 0))), "r") == []


def test_stored_layers_are_listed_without_reading_cells(spark, tmp_path):
    target = str(tmp_path / "store")
    assert store.stored_layers(spark, target).count() == 0
    store.write_cells(lots(spark, {(0, 5): 3, (7, 2): None}, "lc_a=b/c", 7).unionByName(lots(spark, {(1, 1): 4}, "lc_2", 2)), target)
    listed = store.stored_layers(spark, target, "^lc_")
    assert rows(listed, *listed.columns) == [
        ("lc_2", 2, 1, 1, 1, 1, 1, 4, 4, 4.0, 0.0), ("lc_a=b/c", 7, 2, 0, 7, 2, 5, 3, 3, 3.0, 0.0)
    ]
    assert all(".blocks/" in f for f in listed.inputFiles())
    store.write_cells(lots(spark, {(3, 3): 1}, "lc_a=b/c", 7), target)  # replaces the layer and its entries
    assert rows(store.stored_layers(spark, target, "a=b"), "layer", "n", "r0") == [("lc_a=b/c", 1, 3)]
    assert rows(store.stored_layers(spark, target, "^lc_", "2$"), "layer") == [("lc_2",)]


def test_a_store_without_a_log_gets_one(spark, tmp_path):
    target = str(tmp_path / "old")
    cells = lots(spark, {(0, 0): 1, (0, 1): 2}).withColumn("batch", F.lit("early"))
    cells.write.partitionBy("layer", "year", "batch").parquet(target)
    ingest_batch(lots(spark, {(0, 1): 7, (0, 2): 3}), target, "late")
    assert rows(store.read_cells(spark, target), "r", "c", "v") == [(0, 0, 1), (0, 1, 2), (0, 2, 3)]


# ---- coded layers


@pytest.mark.parametrize("width", [8, 1024])
def test_coded_layers_overlay_like_cells(spark, width):
    layers = {x: scattered(s, 20, 45, [1, 1, 1, 2, None], 0.9, r0=-2, c0=-9) for s, x in enumerate("xyz")}
    tables = {x: coded.encode(frame(spark, cells).repartition(4), width) for x, cells in layers.items()}
    stack = coded.overlay_coded(tables, width)
    both = set(layers["x"]) & set(layers["y"]) & set(layers["z"])
    want = sorted([(*at, *[layers[x][at] for x in "xyz"]) for at in both], key=repr)
    assert rows(stack, "r", "c", "x", "y", "z") == want
    runs = coded.overlay_runs({x: tables[x] for x in "xy"}, width)
    counts = runs.groupBy("x", "y").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
    pairs = Counter((layers["x"][at], layers["y"][at]) for at in set(layers["x"]) & set(layers["y"]))
    assert {(r.x, r.y): r.n for r in counts.collect()} == pairs
    with pytest.raises(ValueError, match="named like places"):
        coded.overlay_runs({"c": tables["x"]})


def test_stored_coded_layers_meet_without_a_shuffle(spark, tmp_path):
    for name, value in (("coded_a", 1), ("coded_b", 2)):
        cells = frame(spark, {(r, c): value + c // 7 for r in range(30) for c in range(40)})
        coded.write_coded(cells, name, str(tmp_path / name), 4)
    stack = coded.overlay_coded({"a": spark.table("coded_a"), "b": spark.table("coded_b")})
    assert "Exchange" not in plan(stack) and stack.count() == 1200
    assert spark.table("coded_a").count() == 30  # a record for each row, not for each cell


def test_repeated_cells_are_refused(spark):
    twice = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "r long, c long, v int").coalesce(1)
    with pytest.raises(Exception, match="occurs twice"):
        coded.encode(twice).collect()


# ---- quadtree covers


def blob(seed, side, r0, c0):
    rng = random.Random(seed)
    discs = [(rng.randrange(side), rng.randrange(side), rng.randrange(5, side // 3)) for _ in range(4)]
    return {(r0 + r, c0 + c) for r in range(side) for c in range(side) if any((r - a) ** 2 + (c - b) ** 2 < k * k for a, b, k in discs)}


@pytest.mark.parametrize("limit", [quadtree.COVER_BYTES, 0])
def test_masks_against_sets(spark, limit):
    mask = blob(3, 300, -150, 900)
    cells = {(r, c): r * c for r in range(-160, 160, 3) for c in range(890, 1210, 2)}
    df = frame(spark, cells).withColumn("more", F.array(F.lit("x"), F.lit(None)))
    runs = to_runs(spark.createDataFrame(sorted(mask), "r long, c long"), [])
    got = quadtree.inside(df, runs, limit=limit)
    assert got.columns == df.columns
    assert rows(got, "r", "c", "v") == sorted([(*at, v) for at, v in cells.items() if at in mask], key=repr)
    flagged = quadtree.inside(df, runs, "hit", limit)
    assert {(x.r, x.c): x.hit for x in flagged.collect()} == {at: at in mask for at in cells}
    nothing = quadtree.inside(df, runs.filter("r > 5000"), "hit", limit)
    assert nothing.filter("hit").count() == 0 and nothing.count() == len(cells)


@pytest.mark.parametrize("limit", [quadtree.COVER_BYTES, 700, 0])
def test_two_masks_in_one_pass(spark, limit):
    """Both covers fit together, only each by itself, or neither: 700 bytes hold one border leaf."""
    cells = {(r, c): r * 50 + c for r in range(50) for c in range(50)}
    df = frame(spark, cells)
    masks = {"a": {(r, c) for r, c in cells if r < 20}, "b": {(r, c) for r, c in cells if (r + c) % 3 == 0}}
    sets = {n: to_runs(spark.createDataFrame(sorted(m), "r long, c long"), []) for n, m in masks.items()}
    out = quadtree.flags(df, sets, (lambda batches: batches, "r long, c long, v int, a boolean, b boolean"), limit)
    got = {(x.r, x.c): (x.v, x.a, x.b) for x in out.collect()}
    assert got == {at: (v, at in masks["a"], at in masks["b"]) for at, v in cells.items()}


def test_covers_grow_with_the_border(spark):
    def size(side):
        runs = spark.range(side).selectExpr("id + 13 AS r", "29L AS c0", f"{28 + side}L AS c1")
        return quadtree.cover_bytes(quadtree.cover(runs).cache())

    small, large = size(1000), size(4000)  # four times the border, sixteen times the area
    assert large < 5 * small
    runs = spark.range(4096).selectExpr("id AS r", "0L AS c0", "4095L AS c1")
    nodes = quadtree.cover(runs)
    assert quadtree.cover_bytes(nodes) == 16 * 16  # whole squares only
    assert len(quadtree.Cover.of(nodes.toArrow()).z0) == 1


def test_masks_shuffle_no_cells(spark, grid):
    out = overlay.extract_by_mask(grid([[1, 2]]), grid([[1, 2]]).select("r", "c"))
    assert "Exchange" not in plan(out) and "Join" not in plan(out)


# ---- distance


@pytest.mark.parametrize("band_cells", [1, 90, 1 << 20])
@pytest.mark.parametrize("keep", [1.0, 0.4])
def test_distances_against_brute_force(spark, band_cells, keep):
    cells = scattered(7, 31, 44, [0], keep, r0=-11, c0=500)
    flagged = set(random.Random(2).sample(sorted(cells), 4))
    df = frame(spark, {at: int(at in flagged) for at in cells}).repartition(3)
    got = {(x.r, x.c): x.dist for x in distance.distance_transform(df, F.col("v") == 1, 30.0, band_cells).collect()}
    want = {(r, c): 30 * min((r - a) ** 2 + (c - b) ** 2 for a, b in flagged) ** 0.5 for r, c in cells}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)


def test_envelopes_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        column = rng.choice([0, 1, 4, 25, 400, distance.FAR], (6, 40)).astype(np.int64)
        u = np.arange(40)
        want = (column[:, None, :] + (u[:, None] - u) ** 2).min(axis=2)
        assert np.array_equal(distance.envelope(column), want)


def test_distance_beyond_the_tile_and_without_flags(spark):
    df = frame(spark, {(0, c): int(c == 0) for c in range(50)})
    got = {x.c: x.dist for x in euclid_distance(df, 1, 900.0, tile=8).collect()}
    assert got == {c: 30.0 * c if c < 30 else None for c in range(50)}
    assert {x.c: x.dist for x in euclid_distance(df, 1).collect()} == {c: 30.0 * c for c in range(50)}
    assert {x.dist for x in euclid_distance(df, 5).collect()} == {None}
    assert euclid_distance(df.limit(0), 1).count() == 0


# ---- pyramids and gathers


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_every_level_against_brute_force(spark, bits):
    cells = scattered(9, 37, 50, [1, 2, 2, 5, None], 0.7)
    got = {(x.level, x.r, x.c): x.v for x in overlay.pyramid_levels(frame(spark, cells).repartition(3), 4, bits).collect()}
    want = {}
    for level in range(1, 5):
        below = {}
        for (r, c), v in cells.items():
            below.setdefault((level, r >> level, c >> level), []).append(v)
        for key, values in below.items():
            counts = Counter(v for v in values if v is not None)
            want[key] = min(counts, key=lambda v: (-counts[v], v)) if counts else None
    assert got == want


def test_levels_take_one_exchange(spark, grid):
    assert plan(overlay.pyramid_levels(grid([[1, 2], [3, None]]), 6)).count("Exchange") == 1


@pytest.mark.parametrize("size, x0", [(15.0, 7.0), (30.0, -45.0), (60.0, 15.0), (90.0, 0.0)])
def test_gather_against_brute_force(spark, size, x0):
    cells = scattered(5, 40, 70, [1, 2, None], 0.8)
    wanted = scattered(6, 50, 60, [0], 0.7)
    here, there = GridSpec(0.0, 0.0, 30.0), GridSpec(x0, 30.0, size)
    df, template = frame(spark, cells).repartition(3), frame(spark, wanted).repartition(2)
    for square in (64, 256):
        got = {(x.r, x.c): x.v for x in overlay.gather(df, here, template, there, square).collect()}
        want = {(r, c): cells.get((int(there.y(r) // 30), int(there.x(c) // 30))) for r, c in wanted}
        assert got == want
    assert plan(overlay.gather(df, here, template, there)).count("Exchange hashpartitioning") == 2


# ---- barren marks


def test_marks_get_coarser_and_stay_small(spark):
    cells = [(r * 40, c * 40, 31 if (r + c) % 3 == 0 else 41) for r in range(30) for c in range(30)]
    stack = spark.createDataFrame(cells, "r long, c long, cur int")
    for limit in (100_000, 10, 0):
        marked = barren.mark_barren(stack, ["cur"], barren.REACH, limit=limit)
        assert marked.count() == 900 and marked.filter("cur = 31 AND (_barren IS NULL OR _barren <> 1)").count() == 0
        assert "SortMergeJoin" not in plan(marked) and "BroadcastHashJoin" in plan(marked)


def test_early_barren_layers_reach_less_far(spark):
    stack = spark.createDataFrame([(0, 0, 31, 41), (0, 70, 41, 41), (0, 5, 41, 41)], "r long, c long, a int, b int")
    far = {x.c: x._barren for x in barren.mark_barren(stack, ["a", "b"], 40, block=64).collect()}
    assert far == {0: 1, 5: 1, 70: 0}
    both = barren.mark_barren(stack.selectExpr("r", "c", "b AS a", "a AS b"), ["a", "b"], 40, block=64)
    assert {x.c: x._barren for x in both.collect()} == {0: 1, 5: 1, 70: 0}
    assert stack.count() == 3


def test_log_entries_are_united_by_many_tasks(spark):
    """Bitmaps are few bytes and much work, so their tasks are not coalesced by bytes."""
    cells = spark.range(64).selectExpr("'a' AS layer", "'-' AS batch", "2001 AS year", "id * 8 AS r", "id AS c", "1 AS v")
    logged = blocklog.entries(cells, block=64)
    assert logged.rdd.getNumPartitions() == session.shuffle_partitions(spark) > 1
    assert logged.agg(F.sum("n"), F.count("*")).first() == (64, 8)


@pytest.mark.parametrize("limit", [quadtree.COVER_BYTES, 0])
def test_clipped_and_packed_in_one_pass(spark, monkeypatch, limit):
    """Cells meet the cover and are packed by one pass, or behind the shuffle where the cover is large."""
    monkeypatch.setattr(quadtree.inside, "__defaults__", (None, limit, None))
    cells = spark.range(600).selectExpr("'a' AS layer", "2001 AS year", "id div 20 AS r", "id % 20 AS c", "CAST(id AS INT) AS v")
    mask = to_runs(cells.filter("c % 3 > 0 AND r < 25"), [])
    packed = blocklog.pack_blocks(cells, 16, mask)
    if limit:
        assert plan(packed).count("MapInArrow") == 1
    got = sorted(blocklog.unpack_blocks(packed, 16).collect())
    assert got == sorted(cells.filter("c % 3 > 0 AND r < 25").collect())
