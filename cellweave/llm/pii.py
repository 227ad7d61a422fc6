"""Personal data: patterns of known kinds, and bootstrapped contextual extraction.

Known kinds (e-mail, IP, payment card, phone) are found by regular expressions
and checked. Their spans, whole and with or without digits, are the seeds of a
graph between lexical patterns, i.e. the one or two words left of an occurrence,
and instances, what is seen after them. Other instances are runs of neighbouring
words that hold a digit, up to ``RUN`` of them, so an identifier may be written in
groups. Spark scores the graph in rounds: a pattern is as good as the share of
its instances that are trusted, an instance as good as the promoted patterns
it was seen with. Trust only grows, so the rounds end when a round promotes no
further pattern. Runs after promoted patterns that no known kind touches, with
``MIN_DIGITS`` digits in all, are reported as kind ``context``.

Everything is made of DataFrame functions. Positions are code points, from the
lengths of matches and of the gaps between them; two-level sums keep that near
linear. The patterns are written so that no input makes them backtrack.

Defined results: null text counts as empty; a row without spans has zero counts
and empty strings. Rows are told apart by id and text, so repeated rows get the
same spans each, and null ids are allowed. An empty table gives no rows, and
columns beyond id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.quality_rules import STOP_WORDS
from cellweave.llm.registry import query
from cellweave.llm.text import let, prefix_sums, table, text_key
from cellweave.session import cut_lineage, lookup, remove_step, write_step

#: A match starts where the last one ended, or not inside a run of its first
#: characters: there a run is tried once, not from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
#: Words of an identifier at most.
RUN = 8
_WORD = r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: What looks like an identifier: neighbouring words that hold a digit.
IDENTIFIER = rf"(?<![^\x20\x09-\x0D]){_WORD}(?:\x20{_WORD}){{0,{RUN - 1}}}+"
#: Characters before an identifier in which its context words are looked for.
REACH = 64

MIN_DIGITS = 4
MIN_SUPPORT = 5
MIN_PRECISION = 0.8
#: What is not part of an identifier at its ends.
EDGES = r"^[^\p{Alnum}+]+|\P{Alnum}+$"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    def total(d: Column) -> Column:
        def digit(i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int") * (1 + (F.length(d) - i) % 2)
            return x - F.when(x > 9, 9).otherwise(0)

        places = F.sequence(F.lit(1), F.length(d))
        return F.aggregate(places, F.lit(0), lambda a, i: a + digit(i)) % 10 == 0

    fits = lambda d: F.when(F.length(d).between(12, 19), total(d)).otherwise(False)
    return let(_digits(match), fits)


def _small_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(digits) <= 3, F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

    return F.forall(F.split(match, r"\."), small)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _found(text: Column, pattern: str, possible: Column) -> tuple[Column, Column]:
    """Matches of a pattern and the gaps around them, empty where it cannot match."""
    none = F.array().cast("array<string>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(possible, matches).otherwise(none), F.when(possible, F.split(text, pattern, -1)).otherwise(none)


def _starts(matches: Column, gaps: Column) -> Column:
    """Where each match begins."""
    steps = F.transform(
        matches, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long")
    )
    return F.transform(prefix_sums(steps), lambda x, i: x + F.length(F.get(gaps, i)))


def _spans(kind: str, matches: Column, gaps: Column) -> Column:
    def of(starts: Column) -> Column:
        spans = F.transform(
            matches,
            lambda m, i: F.when(
                CHECKS[kind](m),
                F.struct(
                    F.get(starts, i).alias("start"),
                    F.lit(KINDS.index(kind)).alias("rank"),
                    (F.get(starts, i) + F.length(m)).alias("end"),
                    F.lit(kind).alias("kind"),
                ),
            ),
        )
        return F.filter(spans, lambda s: s.isNotNull())

    return F.when(F.size(matches) > 0, let(_starts(matches, gaps), of)).otherwise(F.array()).cast(SPAN)


def known_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``, the known kinds in order of start, and ``identifiers`` with their left context.

    Identifiers are the known spans, as seeds, and the runs that none of them touches.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    digit = raw.rlike("[0-9]")
    possible = {
        "email": raw.contains("@"),
        "ip": digit & raw.contains("."),
        "card": digit,
        "phone": digit & raw.contains("+"),
        "id": digit,
    }
    found = {}
    for kind, pattern in {**PATTERNS, "id": IDENTIFIER}.items():
        found[f"_m_{kind}"], found[f"_g_{kind}"] = _found(raw, pattern, possible[kind])
    each = [_spans(k, F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in KINDS]
    kind = "array<struct<start:bigint,end:bigint,word:string,left:string,seed:boolean>>"

    def occurrences(name: str, check, seed: bool) -> Column:
        matches, gaps = F.col(f"_m_{name}"), F.col(f"_g_{name}")

        def at(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                lead = F.length(m) - F.length(F.regexp_replace(m, r"^[^\p{Alnum}+]+", ""))
                word = F.regexp_replace(m, EDGES, "")
                start = F.get(starts, i) + F.when(F.lit(seed), 0).otherwise(lead)
                end = start + F.when(F.lit(seed), F.length(m)).otherwise(F.length(word))
                left = F.lower(F.right(F.get(gaps, i), F.lit(REACH)))
                known = F.struct(
                    start.alias("start"), end.alias("end"), word.alias("word"), left.alias("left"), F.lit(seed).alias("seed")
                )
                touched = F.exists("spans", lambda s: (s["start"] < end) & (s["end"] > start))
                return F.when(check(m) if seed else ~touched, known)

            return F.filter(F.transform(matches, one), lambda x: x.isNotNull())

        return F.when(F.size(matches) > 0, let(_starts(matches, gaps), at)).otherwise(F.array()).cast(kind)

    own = [occurrences(k, CHECKS[k], True) for k in KINDS] + [occurrences("id", None, False)]
    return (
        docs.withColumns(found)
        .withColumn("spans", F.sort_array(F.concat(*each)))
        .withColumn("identifiers", F.concat(*own))
        .drop(*found)
    )


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each identifier of a text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = known_spans(rows).select(text_key().alias("key"), F.explode("identifiers").alias("x"))
    return known.select("key", "x.*")


def _edges(identifiers: DataFrame) -> DataFrame:
    """Identifier occurrences, one row for each of their patterns."""
    left = F.regexp_extract_all("left", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    shaped = F.transform(left, lambda w: F.regexp_replace(w, "[0-9]", "0"))
    named = identifiers.withColumn("_left", shaped)
    one, two = F.get("_left", F.size("_left") - 1), F.get("_left", F.size("_left") - 2)
    alone = F.when(~one.isin(STOP_WORDS), one)
    # Signs alone are no lexical pattern.
    patterns = F.filter(F.array(alone, F.concat_ws(" ", two, one)), lambda p: p.rlike(r"\p{L}"))
    return named.select(
        "key", "start", "end", "seed", F.lower("word").alias("instance"), F.explode(F.array_distinct(patterns)).alias("pattern")
    )


def promoted_patterns(edges: DataFrame, precision: float = MIN_PRECISION, support: int = MIN_SUPPORT) -> DataFrame:
    """Score patterns and instances in turn; the patterns that end above the thresholds.

    ``edges`` has ``pattern, instance, seed``. A pattern counts when at least
    ``support`` different instances of it are trusted. Few instances are seen
    with many patterns, and few patterns with many instances: both are looked up
    whatever their share of the graph.
    """
    spark = edges.sparkSession
    graph = cut_lineage(edges.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")))
    rows = graph.count()
    own = graph.groupBy("instance").agg(F.max("seed").alias("trust"))
    trust, promoted, held = own, -1, None
    while True:
        scored = (
            lookup(graph, trust, ["instance"], rows, "inner")
            .groupBy("pattern")
            .agg(F.avg("trust").alias("score"), F.sum((F.col("trust") >= precision).cast("long")).alias("support"))
            .filter((F.col("score") >= precision) & (F.col("support") >= support))
        )
        patterns, path = write_step(scored)
        if held is not None:
            remove_step(spark, held)
        before, promoted, held = promoted, patterns.count(), path
        if promoted == before:  # trust only grows, and so does the set of patterns
            return patterns
        doubt = F.sum(F.log(1 - F.least("score", F.lit(0.999))))
        seen = lookup(graph, patterns, ["pattern"], rows, "inner").groupBy("instance").agg((1 - F.exp(doubt)).alias("found"))
        both = own.join(seen, "instance", "left")
        trust = cut_lineage(both.select("instance", F.greatest("trust", F.coalesce("found", F.lit(0.0))).alias("trust")))


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of personal data for each row of ``docs``: ``doc_id, base, spans``.

    ``base`` and ``spans`` are arrays of ``start, rank, end, kind``; ``spans``
    adds those found by context.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = known_spans(rows).select(
        "doc_id", text_key().alias("key"), F.col("spans").alias("base"), "identifiers"
    )
    known = cut_lineage(known)
    identifiers = known.select("key", F.explode("identifiers").alias("x")).select("key", "x.*")
    edges = cut_lineage(_edges(identifiers))
    patterns = promoted_patterns(edges)
    unseen = edges.filter(
        ~F.col("seed") & (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= MIN_DIGITS)
    )
    rank = len(KINDS)
    span = F.struct("start", F.lit(rank).alias("rank"), "end", F.lit("context").alias("kind"))
    found = (
        lookup(unseen, patterns.select("pattern"), ["pattern"], unseen.count(), "left_semi")
        .groupBy("key")
        .agg(F.collect_set(span).alias("found"))
    )
    more = F.coalesce(F.col("found").cast(SPAN), F.array().cast(SPAN))
    return known.join(found, "key", "left").select(
        "doc_id", "base", F.sort_array(F.concat("base", more)).alias("spans")
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )
