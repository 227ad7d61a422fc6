"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(values: Column, block: int = 64) -> Column:
    """For each element of an array of longs, the sum of those before it.

    Sums of blocks keep the work near ``block`` steps an element.
    """

    def at(i: Column) -> Column:
        return F.floor(i / block).cast("int")

    def inside(x: Column, sums: Column) -> Column:
        before = F.transform(sums, lambda _, b: array_sum(F.slice(sums, F.lit(1), b)))
        return let(
            before,
            lambda starts: F.transform(
                x,
                lambda _, i: F.get(starts, at(i))
                + array_sum(F.slice(x, at(i) * block + 1, i - at(i) * block)),
            ),
        )

    def of_blocks(x: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(0), at(F.size(x) - 1)),
            lambda b: array_sum(F.slice(x, b * block + 1, F.lit(block))),
        )
        return let(sums, lambda s: inside(x, s))

    return F.when(F.size(values) > 0, let(values, of_blocks)).otherwise(F.array().cast("array<long>"))


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row by id and text; rows that share it are equal in both."""
    return F.sha2(F.concat_ws("\0", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(text)), 256)


def remainder(doc_id: Column, by: int) -> Column:
    """CRC-32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def map_texts(
    df: DataFrame, fn: Callable[[list], Iterable[dict]], schema: str, text: str = "text", group: int = 256
) -> DataFrame:
    """Replace the column ``text`` by the columns of ``schema`` that ``fn`` finds.

    ``fn`` gets a list of up to ``group`` texts (None for null) and gives one
    dictionary of column values for each, in order. All other columns of
    ``df`` are kept.
    """
    rest = [c for c in df.columns if c != text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema] + [schema]
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                found = list(fn(batch.column(rest_at).to_pylist()))
                cols = [batch.column(i) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array([f[n] for f in found], type=types[n]) for n in names], [*rest, *names]
                )

    rest_at = len(rest)
    types = {n: _arrow_type(t) for n, t in (x.split() for x in schema.split(","))}
    return df.select(*rest, text).mapInArrow(run, ", ".join(fields))


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def _arrow_type(name: str) -> pa.DataType:
    return _ARROW[name]
