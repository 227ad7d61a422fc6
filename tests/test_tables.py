"""Overlays, masks, tables, change and storage on small inputs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellweave import session
from cellweave.functions import codes
from cellweave.model import CELLS, GridSpec
from cellweave.operators import overlay, tabulate
from cellweave.plans import barren, change
from cellweave.registry import QUERIES
from cellweave.sources import cells as store
from cellweave.sources import events_grid
from cellweave.streaming.ingest import ingest_available, ingest_batch

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


# ---- masks and grids


def edges(spark, *rings):
    pairs = [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    return spark.createDataFrame([tuple(map(float, p)) for p in pairs], "x1 double, y1 double, x2 double, y2 double")


def inside(rings, x, y):
    hit = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
                hit = not hit
    return hit


POLYGONS = [
    [[(0, 0), (10, 0), (10, 10), (0, 10)]],
    [[(1, 1), (18, 3), (12, 9), (17, 17), (4, 12)], [(6, 5), (9, 5), (9, 8), (6, 8)]],
    [[(0.5, 0.5), (19, 0.5), (10, 19)], [(2, 30), (8, 30), (8, 36), (2, 36)]],
]


@pytest.mark.parametrize("rings", POLYGONS)
@pytest.mark.parametrize("band, block", [(4, 4), (4096, 1024)])
def test_polygon_mask_against_ray_casting(spark, rings, band, block):
    spec = GridSpec(0.0, 0.0, 1.0)
    cells = spark.createDataFrame([(r, c) for r in range(40) for c in range(20)], "r long, c long")
    spans = overlay.polygon_spans(edges(spark, *rings), spec, band)
    got = set(rows(overlay.spans_semi(cells, spans, block), "r", "c"))
    assert got == {(r, c) for r in range(40) for c in range(20) if inside(rings, c + 0.5, r + 0.5)}


def test_clip_layer_choices(spark, grid):
    cells = grid([[1, 2], [3, 4]])
    template = grid([[1]]).select("r", "c")
    box = edges(spark, [(0, 0), (60, 0), (60, 30), (0, 30)])
    assert overlay.clip_layer(cells).count() == 4
    assert rows(overlay.clip_layer(cells, edges=box), "v") == [(1,), (2,)]
    assert rows(overlay.clip_layer(cells, template, box), "v") == [(1,)]


def test_mask_extraction(spark, grid):
    cells = grid([[1, 2, None], [4, 5, 6], [7, ".", 9]])
    mask = grid([[".", 0, 0], [0, ".", 0]]).select("r", "c")
    mask = mask.union(mask).union(spark.createDataFrame([(5, 5)], "r long, c long"))
    out = overlay.extract_by_mask(cells, mask)
    assert rows(out, "v") == [(2,), (4,), (6,), (None,)]
    assert exchanges(out) == 0
    assert rows(overlay.extract_by_mask(cells, mask, limit=0), "v") == [(2,), (4,), (6,), (None,)]


def test_align_to_template(spark, grid):
    cells = grid([[1, 2], [3, 4]])
    same = GridSpec()
    assert overlay.align_to_template(cells, same, cells, same) is cells
    fine = GridSpec(0.0, 0.0, 15.0)
    wanted = spark.createDataFrame([(0, 0), (1, 3), (3, 0), (9, 9)], "r long, c long")
    assert rows(overlay.align_to_template(cells, same, wanted, fine), "r", "c", "v") == [
        (0, 0, 1), (1, 3, 2), (3, 0, 3), (9, 9, None),
    ]
    with pytest.raises(ValueError, match="differ"):
        overlay.align_to_template(cells, same, wanted, GridSpec(crs="other"))


def test_pyramid_ties_and_nodata(spark, grid):
    cells = grid([[2, 1, None, None], [2, 1, None, None]])
    assert rows(overlay.pyramid_level(cells, 2), "r", "c", "v") == [(0, 0, 1), (0, 1, None)]


def test_overlay_nodata_propagates(spark, grid):
    g = overlay.overlay_join({"a": grid([[41, None]]), "b": grid([[21, 21]])})
    assert rows(change.change_cells(g, "a", "b"), "c", "v") == [(0, 4121), (1, None)]


def test_extent_filter_reaches_the_scan(spark, grid, tmp_path):
    path = str(tmp_path / "cells")
    cells = grid([[1, 2], [3, 4]]).withColumns({"layer": F.lit("lc_2001"), "year": F.lit(2001)})
    store.write_cells(cells, path)
    read = overlay.extent_clip(store.read_cells(spark, path), r0=1, c1=0).filter("layer = 'lc_2001'").select("v")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(r,1)" in plan and "PartitionFilters: [isnotnull(layer" in plan
    assert rows(read, "v") == [(3,)]


def test_bucketed_layers_overlay_without_a_shuffle(spark, grid, tmp_path):
    for name in ("a", "b"):
        store.write_bucketed(grid([[1, 2], [3, 4]]), f"layer_{name}", str(tmp_path / name), 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = overlay.overlay_join({"a": spark.table("layer_a"), "b": spark.table("layer_b")})
        assert exchanges(g) == 0
        assert g.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_each_layer_of_an_overlay_is_shuffled_once(spark, grid):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(overlay.overlay_join({x: grid([[1, 2]]) for x in "abcd"})) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_large_table_is_not_broadcast(spark):
    left, right = spark.range(5), spark.range(50)
    small = left.join(session.broadcast_if_small(right, 50), "id")
    large = left.join(session.broadcast_if_small(right, 49), "id")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (small, large)]
    assert ["BroadcastHashJoin" in p for p in plans] == [True, False]
    assert small.count() == large.count() == 5


# ---- tables


def rat(spark, *data):
    return spark.createDataFrame(list(data), "year int, v int, n long")


def test_yearly_table_drops_late_classes_and_keeps_the_first_total(spark):
    data = rat(spark, (2001, 1, 60), (2001, 2, 40), (2021, 1, 30), (2021, 3, 70))
    got = {r["v"]: r.asDict() for r in tabulate.tab_lc_types(data, [2001, 2021], "Gen").collect()}
    assert set(got) == {1, 2}
    assert got[1]["Percent_2021"] == 30.0 and got[1]["Change_perc"] == pytest.approx(-50.0)
    assert got[2]["Percent_2021"] is None and got[2]["Change_ha"] is None
    assert got[1]["CoverClass"] == "Open Water"


def test_yearly_table_orders_years_itself(spark):
    data = rat(spark, (2001, 1, 10), (2011, 1, 30))
    row = tabulate.tab_lc_types(data, [2011, 2001]).first()
    assert row["Percent_2001"] == pytest.approx(100 * 10 / 30)
    assert row["Change_ha"] == pytest.approx(20 * 0.09)


def test_join_field_first_does_not_fan_out(spark):
    left = spark.createDataFrame([(1, 5), (2, 6)], "v int, n int")
    right = spark.createDataFrame([(1, "x"), (1, "x")], "k int, label string")
    assert rows(tabulate.join_field_first(left, right, "v", "k", "label"), "v", "n", "label") == [(1, 5, "x"), (2, 6, None)]


def test_lookup_first_refuses_unknown_codes(spark):
    combos = spark.createDataFrame([(4121, 41, 21)], "code int, start_class int, end_class int")
    good = spark.createDataFrame([(4121,)], "code int")
    assert rows(tabulate.lookup_first(good, combos), "start_class", "end_class") == [(41, 21)]
    with pytest.raises(PySparkException, match="no combination for code 9"):
        tabulate.lookup_first(spark.createDataFrame([(9,)], "code int"), combos).collect()


def test_reclass_by_table_broadcasts_a_counted_table(spark, grid):
    table = spark.createDataFrame([(1, 10), (2, None)], "v int, reclass int")
    out = tabulate.reclass_by_table(grid([[1, 2, 3]]), table)
    assert rows(out, "c", "v") == [(0, 10), (1, None), (2, None)]
    assert exchanges(out) == 0


def test_tab_to_dict_keeps_the_last(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, x int, i int")
    assert rows(tabulate.tab_to_dict(df, "k", "x", "i"), "key", "value") == [("a", 2), ("b", 3)]


def test_calculate_field_takes_registered_functions(spark):
    spark.udf.register("twice", F.pandas_udf(lambda s: s * 2, "long"))
    df = tabulate.calculate_field(spark.range(2), "x", "twice(id)")
    assert rows(df, "x") == [(0,), (2,)]


def test_shares(spark):
    df = spark.createDataFrame([(1, 30), (2, 10), (0, 60)], "v int, n long")
    assert rows(df.select("v", tabulate.share().alias("s")), "v", "s") == [(0, 60.0), (1, 30.0), (2, 10.0)]
    part = tabulate.share(where=F.col("v").isin(1, 2))
    assert rows(df.select("v", part.alias("s")), "v", "s") == [(0, None), (1, 75.0), (2, 25.0)]


def test_a_class_that_lacks_a_year_has_no_median(spark):
    long = spark.createDataFrame(
        [(1, "A", "Area_ha_2001", 3.0, 2001), (1, "A", "Area_ha_2004", None, 2004)],
        "v int, CoverClass string, name string, Area_ha double, year int",
    )
    row = tabulate.class_period_stats(long).first()
    assert (row["x"], row["y"], row["area_change"], row["label"]) == (2002.5, None, None, None)


def test_empty_first_class_trends(spark):
    long = spark.createDataFrame(
        [(1, "A", "Area_ha_2001", 0.0, 2001), (1, "A", "Area_ha_2004", 9.0, 2004)],
        "v int, CoverClass string, name string, Area_ha double, year int",
    )
    assert rows(tabulate.lag_pct_change(long), "year", "label") == [(2001, None), (2004, None)]


# ---- change


def test_change_of_two_cells(spark, grid):
    st = overlay.overlay_join({"a": grid([[41, 21, 41]]), "b": grid([[21, 41, 41]])})
    table = {r["v"]: r for r in change.change_rast(st, "a", "b").collect()}
    assert table[4121]["change_type"] == "Deciduous Forest to Developed, Open Space"
    assert table[4141]["change_type"] == "No change"
    moves = {r["v"]: r["change_type"] for r in change.change_to_from(tabulate.build_rat(change.change_cells(st, "a", "b")), [41], "Forest").collect()}
    assert moves == {
        4121: "Forest to Developed, Open Space",
        2141: "Developed, Open Space to Forest",
        1: "Forest both time periods",
    }


def test_to_from_codes_join_digits(spark):
    general = spark.createDataFrame([(402, 1)], "v int, n long")
    got = change.change_to_from(general, [4], "Natural", "Gen").first()
    assert (got["v"], got["change_type"]) == (42, "Natural to Developed")


def test_summary_partitions_the_matrix(spark):
    st = events_grid.stack(spark, SF, "lc_2001", "lc_2021")
    counts = tabulate.build_rat(change.change_cells(st, "lc_2001", "lc_2021"))
    total = st.count()
    for backwards in (True, False):
        assert change.forest_developed(counts, backwards).agg(F.sum("n")).first()[0] == total
    for col, layer in (("start_class", "lc_2001"), ("end_class", "lc_2021")):
        margin = change.change_decode(counts).groupBy(col).agg(F.sum("n").alias("n"))
        single = tabulate.build_rat(events_grid.layer(spark, SF, layer))
        assert rows(margin, col, "n") == rows(single, "v", "n")


def test_loss_of_one_direction_is_gain_of_the_other(spark):
    st = events_grid.stack(spark, SF, "lc_2001", "lc_2021")

    def net(a, b):
        out = tabulate.build_rat(change.change_cells(st, a, b)).withColumn("period", F.lit("p"))
        return {r["chg_class"]: r["ha"] for r in change.net_change(out, codes.FOREST, "Forest", "p").collect()}

    there, back = net("lc_2001", "lc_2021"), net("lc_2021", "lc_2001")
    assert there and there == {k: -v for k, v in back.items()}


def test_successional_codes_count_as_their_own_decade(spark):
    data = spark.createDataFrame([("p", 4175, 10), ("p", 5641, 4), ("q", 4121, 1)], "period string, v int, n long")
    got = rows(change.period_class_area(data, codes.FOREST, exclude=("q",)), "gen_start", "gen_end", "n")
    assert got == [("60", "99", 4), ("99", "60", 10)]


# ---- storage and plans


def layers(spark, *names):
    return events_grid.cells(spark, SF, *names)


def test_ingest_is_idempotent_and_skips_known_layers(spark, tmp_path):
    target = str(tmp_path / "grids")
    ingest_batch(layers(spark, "lc_2001"), target, "one")
    changed = layers(spark, "lc_2001", "lc_2004").withColumn("v", F.lit(1))
    for _ in range(2):
        ingest_batch(changed, target, "two")
    got = store.read_cells(spark, target)
    assert got.count() == 2000
    assert got.filter("layer = 'lc_2001' AND v <> 1").count() > 0
    assert got.filter("layer = 'lc_2004' AND v <> 1").count() == 0


def test_stream_keeps_files_of_one_lot_together(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    layers(spark, "lc_2001").repartition(5).write.parquet(source)
    ingest_available(spark, source, target, check, "s")
    ingest_available(spark, source, target, check, "s")
    assert store.read_cells(spark, target).count() == 1000


def test_write_replaces_one_layer(spark, tmp_path):
    path = str(tmp_path / "cells")
    store.write_cells(layers(spark, "lc_2001", "lc_2004"), path)
    store.write_cells(layers(spark, "lc_2004").limit(7), path)
    got = rows(tabulate.build_rat(store.read_cells(spark, path), "layer").groupBy("layer").agg(F.sum("n").alias("n")), "layer", "n")
    assert got == [("lc_2001", 1000), ("lc_2004", 7)]


def test_a_file_holds_one_block_of_a_layer(spark, tmp_path):
    path = tmp_path / "cells"
    store.write_cells(layers(spark, "lc_2001", "lc_2004"), str(path), tile=4, block=8)
    files = [p for p in path.rglob("*.parquet")]
    assert 2 <= len(files) <= 8
    assert store.read_cells(spark, str(path)).count() == 2000


def test_cells_from_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    layers(spark, "lc_2001").write.csv(path, header=True)
    got = store.read_cells(spark, path, "csv", header=True)
    assert rows(got, "r", "c", "v") == rows(layers(spark, "lc_2001"), "r", "c", "v")


def test_from_stored_layers_to_results(spark, tmp_path):
    path = str(tmp_path / "cells")
    store.write_cells(layers(spark, "lc_1992", "lc_2001", "lc_2021"), path)
    wide = overlay.stack_layers(store.read_cells(spark, path), ["lc_1992", "lc_2001", "lc_2021"])
    table = change.change_rast(wide, "lc_2001", "lc_2021")
    assert rows(table, *sorted(table.columns)) == rows(QUERIES["change_rast_unmasked"](spark, SF), *sorted(table.columns))
    split = barren.barren_chain(wide, [2001, 2021]).select("r", "c", F.col("b_2001").alias("v"))
    assert rows(split, "r", "c", "v") == rows(QUERIES["barren_split"](spark, SF), "r", "c", "v")


def test_stack_of_stored_layers(spark):
    wide = overlay.stack_layers(layers(spark, "lc_2001", "lc_2021"), ["lc_2001", "lc_2021"])
    assert rows(wide, "r", "c", "lc_2001", "lc_2021") == rows(
        events_grid.stack(spark, SF, "lc_2001", "lc_2021"), "r", "c", "lc_2001", "lc_2021"
    )


def test_change_reads_the_columns_it_needs_in_one_scan(spark):
    plan = QUERIES["change_run"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan


def test_yearly_table_scans_once(spark):
    plan = QUERIES["tab_lc_types"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_heavy_keys_are_looked_up_whole(spark):
    left = spark.range(30_000).select(F.when(F.col("id") < 20_000, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 40_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).union(
        spark.createDataFrame([(1, 7)], "k long, x long")
    )
    want = rows(left.join(right, "k", "left"), "k", "id", "x")
    old = session.HEAVY_FLOOR
    session.HEAVY_FLOOR = 10
    try:
        for how in ("left", "inner"):
            got = session.lookup(left, right, ["k"], 30_000, how)
            assert rows(got, "k", "id", "x") == [w for w in want if how == "left" or w[2] is not None]
        assert session.lookup(left, right, ["k"], 30_000, "left_semi").count() == 25_000 + 0
    finally:
        session.HEAVY_FLOOR = old


def test_shared_folder_is_the_session_s_own(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_north_up_grids(spark, grid):
    spec = GridSpec(0.0, 100.0, 10.0, north_up=True, nrows=3, ncols=2)
    cells = grid([[1, 2], [3, 4], [5, 6]])
    box = edges(spark, [(0, 100), (10, 100), (10, 80), (0, 80)])
    assert rows(overlay.polygon_mask(cells, box, spec), "v") == [(1,), (3,)]
    assert rows(overlay.extent_rect(cells, spec), "rect") == [("0.0 70.0 20.0 100.0",)]
    south = GridSpec(0.0, 70.0, 10.0)
    turned = overlay.align_to_template(cells, spec, cells.select("r", "c"), south)
    assert rows(turned, "r", "c", "v") == [(0, 0, 5), (0, 1, 6), (1, 0, 3), (1, 1, 4), (2, 0, 1), (2, 1, 2)]
    assert cells.filter(~spec.inside(F.col("r"), F.col("c"))).count() == 0


def test_late_cells_of_a_known_layer_are_stored(spark, tmp_path):
    cells = spark.createDataFrame([("lc_1", 1, r, c, r * 10 + c) for r in range(4) for c in range(5)], CELLS)
    target = str(tmp_path / "target")
    ingest_batch(cells.filter("c < 2"), target, "a")
    ingest_batch(cells.filter("c < 4"), target, "b")
    ingest_batch(cells, target, "c")
    ingest_batch(cells, target, "c")
    assert rows(store.read_cells(spark, target), "r", "c", "v") == rows(cells, "r", "c", "v")
