"""Column expressions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellweave.functions import codes
from cellweave.functions import columns as col


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in _types(values)))
    return row.select(expr.alias("x")).first()["x"]


def _types(values):
    names = {int: "int", float: "double", str: "string", dt.datetime: "timestamp", type(None): "int"}
    return [(k, names[type(v)]) for k, v in values.items()]


@pytest.mark.parametrize(
    "v, keep, strict",
    [(11, 1, 1), (0, None, None), (99, 99, None), (None, None, None)],
)
def test_reclass(spark, v, keep, strict):
    table = {0: None, 11: 1}
    assert one(spark, col.reclass("v", table), v=v) == keep
    assert one(spark, col.reclass("v", table, keep_unmatched=False), v=v) == strict


@pytest.mark.parametrize("v, want", [(12, 0), (43, 50), (41, 100), (0, None), (99, None)])
def test_indicator_knows_its_codes_only(spark, v, want):
    assert one(spark, col.indicator("v", "dfr"), v=v) == want


@pytest.mark.parametrize(
    "cover, product, want",
    [(52, 11, 56), (71, 11, 75), (52, 1, 52), (52, None, None), (41, 11, 41), (41, None, 41), (None, 11, None)],
)
def test_forest_change(spark, cover, product, want):
    assert one(spark, col.forest_change("a", "b"), a=cover, b=product) == want


def test_cover_class_is_strict_on_request(spark):
    assert one(spark, col.cover_class("v", "NLCD"), v=12) is None
    assert one(spark, col.cover_class("v", "NLCD", strict=True), v=56) == "Shrub/Scrub successional"
    assert one(spark, col.cover_class("v", "anything else"), v=6) == "Harvested/Disturbed"
    with pytest.raises(PySparkException, match="unknown class code 12"):
        one(spark, col.cover_class("v", "NLCD", strict=True), v=12)


@pytest.mark.parametrize(
    "start, end, fwd, bwd",
    [(41, 42, 1, 1), (41, 21, 2, 2), (41, 81, 3, 3), (21, 41, 4, 4), (81, 41, 4, 5), (81, 21, 0, 0), (81, 82, 0, 0)],
)
def test_summary_code(spark, start, end, fwd, bwd):
    for backwards, want in ((False, fwd), (True, bwd)):
        expr = col.summary_code("s", "e", codes.FOREST, codes.DEVELOPED, backwards)
        assert one(spark, expr, s=start, e=end) == want


@pytest.mark.parametrize(
    "x, want", [(2.0, "+2%"), (12.5, "+12.5%"), (0.0, "0%"), (-0.25, "-0.25%"), (-10.0, "-10%"), (100.0, "+100%")]
)
def test_pct_label(spark, x, want):
    assert one(spark, col.pct_label("x"), x=x) == want


def test_pct_label_keeps_null(spark):
    assert one(spark, col.pct_label(F.lit(None).cast("double")), x=1) is None


@pytest.mark.parametrize("x, want", [(1234.4, "+1,234"), (0.2, "0"), (-98765.6, "-98,766")])
def test_signed_number_label(spark, x, want):
    assert one(spark, col.signed_number_label("x"), x=x) == want


def test_concat_code_joins_digits(spark):
    assert one(spark, col.concat_code("a", "b"), a=4, b=21) == 421


def test_scale_measure(spark):
    got = one(spark, col.scale_measure("m", -1), m="100 METERS")
    assert tuple(got) == (-100.0, "METERS", "-100.0 METERS")


def test_elapsed_text(spark):
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3, 4, 5, 6, 700000)
    assert one(spark, col.elapsed_text("a", "b"), a=a, b=b) == "2 days, 4 hours, 5 minutes, 6 seconds"


def test_layer_names(spark):
    assert one(spark, col.layer_year("n"), n="lc_2001_general") == 2001
    assert one(spark, col.layer_period("n"), n="change_2001_2021") == "2001-2021"


def test_decades(spark):
    assert one(spark, col.decade("v", codes.FOREST), v=52) == "99"
    assert one(spark, col.decade("v", codes.FOREST), v=61) == "60"
    assert one(spark, col.decade_label(F.lit("99"), "Forest"), v=1) == "Forest"
    assert one(spark, col.decade_label(F.lit("50"), "Forest"), v=1) == "Shrub/Scrub"
    assert one(spark, col.decade_label(F.lit("0"), "Forest"), v=1) is None


def test_scale_to_int_rounds_half_up(spark):
    assert one(spark, col.scale_to_int("x", "wet"), x=0.12345) == 1235
    assert one(spark, col.scale_to_int("x", "dfr"), x=33.335) == 3334


def test_code_tables():
    assert set(codes.TO_GENERAL.values()) - {None} == set(codes.GENERAL) - {0}
    assert set(codes.TO_GENERAL) == set(codes.DETAILED)
    assert len(codes.BARREN_FROM_1992) == 21 and len(codes.BARREN_FROM_STANDARD) == 17
    assert {k for k, v in codes.BARREN_FROM_1992.items() if v == 31} == {11, 31, 91, 92}
    assert {k for k, v in codes.BARREN_FROM_STANDARD.items() if v == 31} == {11, 31, 90, 95}
