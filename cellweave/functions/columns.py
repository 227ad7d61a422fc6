"""Column expressions. All stay in the JVM and in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions import codes


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reclass(v, table: dict, keep_unmatched: bool = True) -> Column:
    """Remap codes. A ``None`` target is NoData; unmatched codes stay or become NoData.

    Codes with the same target share one ``IN`` test, so the expression is as
    long as the number of targets.
    """
    v = col(v)
    targets: dict = {}
    for src, dst in table.items():
        targets.setdefault(dst, []).append(src)
    out = None
    for dst, srcs in targets.items():
        test, value = v.isin(srcs), F.lit(dst).cast("int")
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(v) if keep_unmatched else out


def lookup_label(v, names: dict) -> Column:
    """Value from a literal map; null for unlisted keys."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(v))


def names_of(schema: str) -> dict:
    """Class names of a schema: ``NLCD`` is the detailed one, any other the general one."""
    return codes.DETAILED if schema == "NLCD" else codes.GENERAL


def cover_class(v, schema: str, strict: bool = False) -> Column:
    """Class name of a code. ``strict`` fails on a code the schema lacks."""
    v = col(v)
    label = lookup_label(v, names_of(schema))
    if not strict:
        return label
    unknown = F.raise_error(F.concat(F.lit("unknown class code "), v.cast("string")))
    return F.when(v.isNull() | label.isNotNull(), label).otherwise(unknown)


def set_null(v, sentinel: int) -> Column:
    return F.nullif(col(v), F.lit(sentinel))


def keep_only(v, code: int) -> Column:
    return F.when(col(v) == code, F.lit(code))


def null_to_zero(v) -> Column:
    return F.coalesce(col(v), F.lit(0))


def indicator(v, name: str) -> Column:
    """One indicator layer: listed codes get their value or 0, others NoData."""
    table = {k: codes.INDICATORS[name].get(k, 0) for k in codes.INDICATOR_CODES}
    return reclass(v, table, keep_unmatched=False)


def forest_change(cover, product) -> Column:
    """Shrub and herbaceous cells of the forest-change class move up by four."""
    cover, product = col(cover), col(product)
    inside = F.when(product == 11, cover + 4).when(product.isNotNull(), cover)
    return F.when(cover.isin(52, 71), inside).otherwise(cover)


def change_code(t1, t2) -> Column:
    return (col(t1) * 100 + col(t2)).cast("int")


def start_class(code) -> Column:
    return F.call_function("div", col(code), F.lit(100)).cast("int")


def end_class(code) -> Column:
    return (col(code) % 100).cast("int")


def change_type(start, end, start_name, end_name) -> Column:
    return F.when(col(start) == col(end), F.lit(codes.NO_CHANGE)).otherwise(
        F.concat(col(start_name), F.lit(" to "), col(end_name))
    )


def area_ha(n) -> Column:
    """Hectares by the per-cell factor."""
    return col(n) * F.lit(codes.CELL_HA)


def area_ac(n) -> Column:
    return col(n) * F.lit(codes.CELL_AC)


def area_ha_900(n) -> Column:
    """Hectares from 900 square metres a cell (last bits differ from the factor)."""
    return col(n) * 900 / F.lit(10000)


def scale_to_int(x, layer: str) -> Column:
    k = 100 if layer in codes.PERCENT_LAYERS else 10000
    return (col(x) * F.lit(k) + F.lit(0.5)).cast("int")


def summary_code(start, end, from_cls: list[int], to_cls: list[int], backwards: bool) -> Column:
    """Change-summary code of a start and end class.

    Code 4 marks a move from the end classes to the start classes in both
    modes; without ``backwards`` it also holds moves from any other class.
    """
    s_from, e_from = col(start).isin(from_cls), col(end).isin(from_cls)
    s_to, e_to = col(start).isin(to_cls), col(end).isin(to_cls)
    return (
        F.when(s_from & e_from, 1)
        .when(s_from & e_to, 2)
        .when(s_from, 3)
        .when(s_to & e_from, 4)
        .when(e_from, 5 if backwards else 4)
        .otherwise(0)
    )


def summary_label(code, from_name: str, to_name: str, backwards: bool) -> Column:
    texts = dict(codes.SUMMARY_LABELS)
    if not backwards:
        texts[4] = codes.SUMMARY_LABEL_4_FORWARD
    return lookup_label(code, {k: t.format(a=from_name, b=to_name) for k, t in texts.items()})


def decade(code, cls: list[int]) -> Column:
    """Tens of a code as text, "99" for the studied classes."""
    tens = F.call_function("div", col(code), F.lit(10)) * 10
    return F.when(col(code).isin(cls), F.lit("99")).otherwise(tens.cast("string"))


def decade_label(dec, cls_name: str) -> Column:
    return lookup_label(col(dec).cast("int"), {**codes.DECADES, 99: cls_name})


def decade_order(dec) -> Column:
    return lookup_label(col(dec).cast("int"), {k: i + 1 for i, k in enumerate([*codes.DECADES, 99])})


def merge_successional(v) -> Column:
    return F.when(col(v).isin(56, 75), F.lit(61)).otherwise(col(v))


def layer_year(name) -> Column:
    """The four characters after the three-letter prefix, as a year."""
    return F.substring(col(name), 4, 4).cast("int")


def layer_period(name) -> Column:
    """The last nine characters with a dash: ``2001-2021``."""
    return F.translate(F.right(col(name), F.lit(9)), "_", "-")


def pct_change(now, before) -> Column:
    return F.round(F.try_divide(col(now) - col(before), col(before)) * 100, 2)


def pct_label(x) -> Column:
    """``+x%`` above zero, ``x%`` otherwise, without trailing zeros."""
    x = col(x)
    text = F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
    return (
        F.when(x > 0, F.concat(F.lit("+"), text, F.lit("%")))
        .when(x == 0, F.lit("0%"))
        .when(x < 0, F.concat(text, F.lit("%")))
    )


def signed_number_label(x) -> Column:
    whole = F.round(col(x)).cast("bigint")
    text = F.format_number(whole, 0)
    return F.when(whole > 0, F.concat(F.lit("+"), text)).otherwise(text)


def millions_label(x) -> Column:
    return F.format_string("%.2f", col(x) / 1e6)


def concat_code(left, right) -> Column:
    """The digits of one code followed by those of another."""
    return F.concat(col(left).cast("string"), col(right).cast("string")).cast("int")


def plain(x) -> Column:
    """A number as text without an exponent: ``3000.0``."""
    return F.regexp_replace(col(x).cast("decimal(24,6)").cast("string"), r"(\.\d+?)0+$", "$1")


def scale_measure(text, by: float) -> Column:
    """``100 METERS`` times a factor, as number, unit and text."""
    parts = F.split(col(text), " ")
    num, unit = parts[0].cast("double") * F.lit(float(by)), parts[1]
    return F.struct(
        num.alias("num"), unit.alias("unit"), F.concat(plain(num), F.lit(" "), unit).alias("text")
    )


def elapsed_text(start, end) -> Column:
    """Whole days, hours, minutes and seconds between two instants."""
    span = col(end) - col(start)
    parts = [F.extract(F.lit(p), span).cast("int") for p in ("DAY", "HOUR", "MINUTE", "SECOND")]
    return F.format_string("%d days, %d hours, %d minutes, %d seconds", *parts)


def period_group(period, full: str) -> Column:
    return F.when(col(period) == full, F.lit(codes.FULL_PERIOD)).otherwise(
        F.lit(codes.OTHER_PERIODS)
    )
