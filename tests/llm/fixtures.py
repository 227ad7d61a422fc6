"""Rows that every operator has to take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, kept string, fp string"

LONG = "the quick brown fox jumps over the lazy dog and runs to the river " * 3_000

ROWS = [
    (1, None, None, None, None, "a", "b", "c", "d"),
    (2, "", "en", "s", 0, None, None, None, None),
    (3, " \n\t\x0b\x0c\r ", "en", None, 7, None, None, None, None),
    (4, LONG, "en", "s", len(LONG), None, None, None, None),
    (4, LONG, "en", "s", len(LONG), None, None, None, None),
    (None, "a text without an id", "en", "s", 20, None, None, None, None),
    (6, "x" * 200_000, None, "s", 200_000, None, None, None, None),
    (7, "7" * 50_000 + " +" * 1000 + "1." * 1000 + "@" * 1000, "en", "s", 1, None, None, None, None),
    (8, "Être là où l’été naît  ñandú 😀 😀 end", "fr", "t", 1, None, None, None, None),
    (9, "a text without an id", "en", "s", 20, None, None, None, None),
]


def odd(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def none(spark):
    return spark.createDataFrame([], COLUMNS)


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
