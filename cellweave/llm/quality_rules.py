"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a column expression of the whole text, so that the rules run
inside the scan, without a shuffle and without Python. ``quality_report`` adds
the measures, the names of the rules that a row breaks, and the verdict.

Defined results: a null text counts as empty, and an empty text breaks the rule
on the number of words. The rule on stop words knows four languages and the one
on word length texts that put spaces between words: neither is applied to texts
with more than ``FOREIGN`` of their letters in other scripts than Latin, the
first nor to texts in Latin script with stop words of one of the other languages
of ``OTHER_STOP_WORDS``. Rows are judged one by one, so repeated rows and null
ids get the same verdicts; columns of the input that clash with those added
are replaced. An empty table gives an empty report.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.registry import query
from cellweave.llm.text import array_sum, let, table, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SHORT_WORD, LONG_WORD = 2, 12
STOP_SHARE = 0.05
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as a be with on are was by this from or an "
    "de la le les et des en que un une qui dans pour sur pas du au est "
    "der die und das von zu mit den ein ist nicht auf für "
    "el los y se del las por para con su"
).split()
#: Frequent function words of other languages in Latin script, without those above.
OTHER_STOP_WORDS = sorted(
    set(
        # Portuguese, Italian, Romanian, Catalan
        "os uma não com mais foi como dos das ao pelo pela são mas também il di che non è per una del della nel gli sono "
        "più anche alla și în este cu nu din care pe mai sau pentru els amb és per què dels "
        # Dutch, Swedish, Danish, Norwegian, Icelandic
        "het een van niet dat met voor zijn op ook wordt aan och att det som på inte för är av har med og af ikke til "
        "blev ble jeg hun å fra eru ekki sem við það "
        # Polish, Czech, Slovak, Slovene, Croatian
        "się nie na jest do że jak przez od są był była oraz ale je že ve byl jsou také pro ako sú aj bol sa ki ter pri "
        "iz bil koji kao što bio ili i z w o v u s k "
        # Hungarian, Finnish, Estonian, Latvian, Lithuanian
        "az és hogy egy nem van volt ez csak meg ja ei oli että mutta kun se hän ovat myös ning kui aga ka ir ar no kas "
        "bija uz kad yra tai iš buvo "
        # Turkish, Azerbaijani, Albanian, Basque, Irish, Welsh
        "ve bir bu için ile çok daha olarak gibi olan və üçün ilə bu da të në dhe për një nga është eta da ez bat agus "
        "na ar an bhí yn yr ac mae oedd i "
        # Vietnamese, Indonesian, Malay, Tagalog, Swahili, Afrikaans
        "và của là có được cho không các những trong một yang dan untuk dengan dari pada adalah ini itu tidak ke oleh "
        "ang ng sa mga at ay na ya wa kwa ni katika za la kama nie het om".split()
    )
    - set(STOP_WORDS)
)
OTHER_KINDS = 3
#: Share of letters that are not Latin from which a text is not judged by stop words and word length.
FOREIGN = 0.3
FOREIGN_LETTERS = r"[\p{L}\p{M}&&[^\p{IsLatin}\p{IsInherited}]]+"
EDGES = r"""[.,;:!?…()\[\]"'“”„«»‘’]+"""


@dataclass(frozen=True)
class Rule:
    """A measure and the range it has to be in, both ends included.

    ``unless`` names measures of texts that the rule does not know, and the shares beyond which it is not applied.
    """

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    unless: tuple[tuple[str, float], ...] = ()


#: The first two rules are the base rules.
BASE_RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_words", "repeat_ratio", high=0.3),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", "mean_word_length", low=SHORT_WORD, high=LONG_WORD, unless=(("foreign_ratio", FOREIGN),)),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("capitals", "upper_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=STOP_SHARE, unless=(("foreign_ratio", FOREIGN), ("other_stop_ratio", STOP_SHARE))),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("bullet_lines", "bullet_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", high=0.3),
)


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the array, the first included.

    Windows are compared by a 64-bit hash. Sorting the hashes brings equal
    windows together, so a text of n words costs n log n steps; texts without
    an equal pair stop at the test for distinct hashes.
    """
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (window - 1)),
        lambda i: F.xxhash64(F.slice(tokens, i, F.lit(window))),
    )

    def starts(s: Column) -> Column:
        def twin(e: Column, k: Column) -> Column:
            near = (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
            return F.when(near, e["i"])

        return F.sort_array(F.filter(F.transform(s, twin), lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        return array_sum(
            F.transform(
                p,
                lambda i, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - i, F.lit(window))).cast("long"),
            )
        )

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeats = let(let(ordered, starts), covered)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), repeats).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(tokens) >= window, let(hashes, count)).otherwise(F.lit(0).cast("long"))


def other_stop_words(tokens: Column) -> Column:
    """Words that other languages in Latin script use most, whatever the case of their first letter.

    Fewer than ``OTHER_KINDS`` different ones are no sign of a language and count 0.
    """

    def core(w: Column) -> Column:
        bare = F.regexp_replace(w, f"^{EDGES}|{EDGES}$", "")
        return F.concat(F.lower(F.left(bare, F.lit(1))), F.substr(bare, F.lit(2)))

    found = F.filter(F.transform(tokens, core), lambda w: w.isin(OTHER_STOP_WORDS))
    return let(found, lambda x: F.when(F.size(F.array_distinct(x)) >= OTHER_KINDS, F.size(x)).otherwise(F.lit(0)))


def measures(text: Column) -> Column:
    """Counts and ratios of a text as one struct; words and lines are made once.

    ``n_letters``, ``n_foreign`` and ``n_other_stops`` are 0 where no rule asks for them.
    """
    raw = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(raw, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column, x: Column) -> Column:
        n_stop = F.size(F.filter(w, lambda v: v.isin(STOP_WORDS)))
        return let(n_stop, lambda n: let(F.length(F.array_join(w, "")), lambda c: all_counts(w, x, n, c)))

    def all_counts(w: Column, x: Column, n_stop: Column, chars: Column) -> Column:
        # Texts that pass the rules on word length and stop words need not be known by script and language.
        unsure = (n_stop < STOP_SHARE * F.size(w)) | (chars > LONG_WORD * F.size(w)) | (chars < SHORT_WORD * F.size(w))

        def if_unsure(count: Column) -> Column:
            return F.when(unsure, count).otherwise(F.lit(0))

        found = {
            "n_words": F.size(w),
            "word_chars": chars,
            "n_symbols": F.length(raw) - F.length(F.regexp_replace(raw, f"[{SYMBOLS}]+", "")),
            "n_lines": F.size(x),
            "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
            "n_repeat_words": repeated_words(w),
            "n_stop_words": n_stop,
            "n_upper": F.length(raw) - F.length(F.regexp_replace(raw, "[A-Z]+", "")),
            "n_bullets": F.size(F.filter(x, lambda v: v.rlike(r"^\s*[-*•‣]"))),
            "n_ellipses": F.size(F.filter(x, lambda v: v.rlike(r"(\.\.\.|…)\s*$"))),
            # Marks are part of the letters of many scripts.
            "n_letters": if_unsure(F.length(raw) - F.length(F.regexp_replace(raw, r"[\p{L}\p{M}]+", ""))),
            "n_foreign": if_unsure(F.length(raw) - F.length(F.regexp_replace(raw, FOREIGN_LETTERS, ""))),
            "n_other_stops": if_unsure(other_stop_words(w)),
        }
        return F.struct(*[c.cast("long").alias(name) for name, c in found.items()])

    return let(words(raw), lambda w: let(lines, lambda x: let(counts(w, x), _with_ratios)))


RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_ratio": ("n_bullets", "n_lines"),
    "ellipsis_ratio": ("n_ellipses", "n_lines"),
    "foreign_ratio": ("n_foreign", "n_letters"),
    "other_stop_ratio": ("n_other_stops", "n_words"),
}
COUNTS = (
    "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_stop_words n_upper n_bullets n_ellipses "
    "n_letters n_foreign n_other_stops"
).split()


def _with_ratios(m: Column) -> Column:
    ratios = [
        F.when(m[whole] > 0, m[part] / m[whole]).otherwise(F.lit(0.0)).alias(name)
        for name, (part, whole) in RATIOS.items()
    ]
    return F.struct(*[m[c].alias(c) for c in COUNTS], *ratios)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each text as further columns."""
    held = docs.withColumn("_m", measures(F.col(text)))
    return held.withColumns({n: F.col("_m")[n] for n in [*COUNTS, *RATIOS]}).drop("_m")


def breaks(rule: Rule, m: Column) -> Column:
    """Whether a struct of measures breaks a rule."""
    value, out = m[rule.measure], F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low)
    if rule.high is not None:
        out = out | (value > rule.high)
    for share, most in rule.unless:
        out = out & (m[share] <= most)
    return out


def quality_report(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with measures, ``broken`` (names of rules broken) and ``kept``."""
    measured = measure(docs, text)
    m = F.struct(*COUNTS, *RATIOS)
    named = [F.when(breaks(r, m), F.lit(r.name)) for r in rules]
    broken = F.filter(F.array(*named), lambda x: x.isNotNull())
    return measured.withColumn("broken", broken).withColumn("kept", F.size("broken") == 0)


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The documents that break no rule, with their own columns.

    The verdict is one expression in which the measures are bound once: a filter
    on columns of a report would be pushed below them and compute each anew.
    """
    good = let(measures(F.col(text)), lambda m: ~reduce(lambda a, b: a | b, [breaks(r, m) for r in rules]))
    return docs.filter(good)


_FEW, _LONG, _SYMBOL, _UPPER, _STOP, _DUP, _BULLET, _ELLIPSIS = (
    r for r in RULES if r.name != "repeated_words"
)
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
MEASURES_SQL = rf"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {{documents}}),
w AS (SELECT rid, i, w FROM (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i
 FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs))),
wc AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars,
 count(*) FILTER (w IN ({_STOP_SQL})) AS n_stop FROM w GROUP BY rid),
win AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o
 || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o AS g
 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, g FROM win WHERE g IS NOT NULL GROUP BY rid, g HAVING count(*) > 1),
spot AS (SELECT win.rid, win.i FROM win JOIN twice ON win.rid = twice.rid AND win.g = twice.g),
rep AS (SELECT rid, sum(CASE WHEN nx IS NULL OR nx - i > 8 THEN 8 ELSE nx - i END) AS n_repeat_words
 FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM spot) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM docs),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
 count(*) FILTER (regexp_matches(l, '^\s*[-*•‣]')) AS n_bullets,
 count(*) FILTER (regexp_matches(l, '(\.\.\.|…)\s*$')) AS n_ellipses
 FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT docs.rid, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
 coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop, 0) AS n_stop,
 coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses
 FROM docs LEFT JOIN wc ON docs.rid = wc.rid LEFT JOIN rep ON docs.rid = rep.rid LEFT JOIN lc ON docs.rid = lc.rid),
verdict AS (SELECT *, n_words < {_FEW.low} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
judged AS (SELECT *, NOT base_failed AND word_chars >= {_LONG.low} * n_words AND word_chars <= {_LONG.high} * n_words
 AND n_symbols / n_words <= {_SYMBOL.high} AND n_upper / word_chars <= {_UPPER.high}
 AND n_stop / n_words >= {_STOP.low} AND n_dup_lines / n_lines <= {_DUP.high}
 AND n_bullets / n_lines <= {_BULLET.high} AND n_ellipses / n_lines <= {_ELLIPSIS.high} AS kept FROM verdict)"""

ORACLE = f"""WITH {MEASURES_SQL.format(documents="documents")}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept FROM judged"""


@query("op6_quality_rules", ORACLE)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("n_words") < 20
    base = base | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"),
    )
