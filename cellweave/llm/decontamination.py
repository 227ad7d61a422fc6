"""Benchmark decontamination by template windows with typed slots.

A text is rewritten as a template: numbers, names and units become typed
placeholders, other words stay in lower case. Windows of the template of each
benchmark item are joined by hash with the windows of all documents, so a
question with other numbers or names still meets its source. Windows of the
words themselves join them, so copies are found where slots dominate, where the
first letters of words have another case, in lower case, and whatever stands
before them. A match counts
along one alignment of document and item, or along neighbouring ones, and only
where its slots are consistent: the same value of the item stands for the same
value in the document. Windows with a mention that differs from most of its value
do not count; an alignment without a majority for a value is none.

Windows of documents are made inside tasks, with rolling hashes over numpy
arrays, and pass a bitmap of fixed size built from the benchmark's windows, so
only windows that may match are written as rows; these are joined on their
whole template.

Defined results: null and empty texts, and texts shorter than a window, match
nothing; items of fewer than ``WINDOW`` words are matched as a whole, with other
slots if they have ``MIN_LITERALS`` words that are not slots. Items of fewer than
``MIN_LITERALS`` words, and copies in capitals throughout, are not sought. Rows are told apart by id and
text, so repeated rows give one result; null ids are kept. An empty table on
either side gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.registry import query
from cellweave.llm.text import array_sum, let, table, text_key
from cellweave.session import broadcast_if_small, cut_lineage

WINDOW = 8
#: Words of a window that have to be words, not slots.
MIN_LITERALS = 4
#: Words of an item that have to be matched in one alignment: this many, or this share of a shorter item.
MIN_WORDS = 13
MIN_SHARE = 0.8
#: Alignments that words put in or left out move apart by so many words at most are added up.
SLACK = 8
BITMAP_BITS = 24
#: Begins a window of the words themselves; no word of a template is this sign.
LITERAL = "= "

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|[A-Za-z°µ]{1,3})?")
PUNCTUATION = "!\"#&'()*,.:;<>?@[\\]^_`{|}~«»“”‘’…¿¡-–—/="
SENTENCE_END = (".", "!", "?", "…")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years percent dollar dollars euro euros cent cents degree degrees kmh mph".split()
)
WORD, NUM, UNIT, CAPITAL = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Templates:
    """Turns texts into templates, remembering the words it has met."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self._reset()
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.cores, self.kinds, self.ends, self.hashes = [], [], [], []
        self.plain, self.folded = [], []
        self.arrays = (np.zeros(0, np.int8), np.zeros(0, bool), *(np.zeros(0, np.uint64) for _ in range(3)))

    def _properties(self) -> tuple[np.ndarray, ...]:
        """Kind, sentence end and hashes of all words met, as arrays that grow with them."""
        n = len(self.arrays[0])
        if n < len(self.cores):
            lists = (self.kinds, self.ends, self.hashes, self.plain, self.folded)
            self.arrays = tuple(
                np.concatenate([a, np.array(x[n:], a.dtype)]) for a, x in zip(self.arrays, lists)
            )
        return self.arrays

    def _learn(self, word: str) -> int:
        core = word.strip(PUNCTUATION)
        lower = core.lower()
        kind = WORD
        if NUMBER.fullmatch(core):
            kind = NUM
        elif lower in UNITS:
            kind = UNIT
        elif len(core) > 1 and core[0].isupper():
            kind = CAPITAL
        self.cores.append(core)
        self.kinds.append(kind if core else -1)
        self.ends.append(word.rstrip("\"')]»”’").endswith(SENTENCE_END))
        self.hashes.append(_hash(lower))
        self.plain.append(_hash(f"={_small_initial(core)}"))
        self.folded.append(_hash(f"={lower}"))
        self.index[word] = at = len(self.cores) - 1
        return at

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            for name, by in (("powers", _BASE), ("inverses", _INVERSE)):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def batch(self, texts: list[str | None]):
        """Words of all texts as arrays: text, index, slot kind (0 for words), hash of the template word."""
        if len(self.index) > self.most:
            self._reset()
        get, learn = self.index.get, self._learn
        found, sizes = [], []
        for text in texts:
            parts = text.split() if text else []
            found += [i if (i := get(w)) is not None else learn(w) for w in parts]
            sizes.append(len(parts))
        at = np.array(found, np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        kinds, word_ends, word_hashes, _, _ = self._properties()
        kind = kinds[at]
        keep = kind >= 0
        # A word opens a sentence if it opens its text or the word before ends one.
        opens = _ends_before(word_ends[at], keep)[keep]
        at, owner, kind = at[keep], owner[keep], kind[keep]
        first = np.ones(len(at), bool)
        first[1:] = owner[1:] != owner[:-1]
        after_number = np.zeros(len(at), bool)
        after_number[1:] = (kind[:-1] == NUM) & ~first[1:]
        slot = np.where(kind == CAPITAL, np.where(opens | first, WORD, CAPITAL), kind)
        slot = np.where((kind == UNIT) & ~after_number, WORD, slot)
        return owner, at, slot, np.where(slot == WORD, word_hashes[at], _SLOT_HASHES[slot])

    def readings(self, at: np.ndarray, hashes: np.ndarray, folds: tuple[bool, ...]):
        """The template and the words themselves, with small initials or in lower case: hashes, least literals, fold."""
        _, _, _, plain, folded = self._properties()
        return [(hashes, MIN_LITERALS, None), *(((folded if f else plain)[at], 0, f) for f in folds)]

    def windows(self, owner: np.ndarray, slot: np.ndarray, hashes: np.ndarray, size: int, least: int = MIN_LITERALS):
        """Starts and hashes of all windows of a size that lie in one text and have enough words."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self._grow(len(hashes) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * self.powers[: len(hashes)], dtype=np.uint64)])
        rolled = (sums[size:] - sums[:-size]) * self.inverses[:n]
        literal = np.concatenate([[0], np.cumsum(slot == WORD)])
        good = (owner[size - 1 :] == owner[:n]) & (literal[size:] - literal[:-size] >= least)
        at = np.flatnonzero(good)
        return at, rolled[at]

    def written(self, at: np.ndarray, slot: np.ndarray, fold: bool | None = None) -> tuple[str, list[str], list[int]]:
        """The template of a window, the values of its slots and their places; with ``fold`` its words, without slots."""
        if fold is not None:
            cores = [self.cores[i] for i in at]
            return LITERAL + " ".join(c.lower() if fold else _small_initial(c) for c in cores), [], []
        names = ("", "<number>", "<unit>", "<name>")
        template = [self.cores[i].lower() if k == WORD else names[k] for i, k in zip(at, slot)]
        values = [f"{names[k]}{self.cores[i]}" for i, k in zip(at, slot) if k != WORD]
        return " ".join(template), values, np.flatnonzero(slot).tolist()


def _ends_before(ends: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Whether a sentence ends between a word and the last one kept before it."""
    last = np.concatenate([[0], np.cumsum(ends)])
    kept = np.concatenate([[0], np.maximum.accumulate(np.where(keep, np.arange(1, len(keep) + 1), 0))])[:-1]
    before = np.maximum(kept - 1, 0)  # the ends from the last kept word on count
    return last[:-1] - last[before] > 0


def _small_initial(word: str) -> str:
    return word[:1].lower() + word[1:]


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7)


_SLOT_HASHES = np.array([_hash(f"\0{k}") for k in range(4)], np.uint64)


def template_windows(
    df: DataFrame,
    key: list[str],
    text: str,
    sizes: list[int],
    bitmap: bytes | None,
    folds: tuple[bool, ...] = (False,),
    group: int = 256,
):
    """Windows of templates and of words: the columns ``key`` and ``size, at, words, hash, template, slots, spots``.

    ``at`` counts words from 0, ``words`` is the length of the whole text. With
    a bitmap only windows whose hash it holds are returned.
    """
    types = {f.name: f.dataType.simpleString() for f in df.select(*key).schema}
    schema = ", ".join(f"`{k}` {t}" for k, t in types.items())
    schema += ", size int, at long, words long, hash long, template string, slots array<string>, spots array<bigint>"
    bits = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        templates = Templates()
        held = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for whole in batches:
            for lo in range(0, whole.num_rows, group):
                batch = whole.slice(lo, group)
                owner, at, slot, hashes = templates.batch(batch.column(len(key)).to_pylist())
                counts = np.bincount(owner, minlength=batch.num_rows)
                firsts = np.cumsum(counts) - counts
                rows, out = [], []
                readings = templates.readings(at, hashes, folds)
                for size, (hashed, least, fold) in product(sizes, readings):
                    starts, rolled = templates.windows(owner, slot, hashed, size, least)
                    if held is not None:
                        place = (rolled >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                        hit = (held[place >> 3] >> (place & 7)) & 1 == 1
                        starts, rolled = starts[hit], rolled[hit]
                    for i, h in zip(starts.tolist(), rolled.view(np.int64).tolist()):
                        o = int(owner[i])
                        template, slots, spots = templates.written(at[i : i + size], slot[i : i + size], fold)
                        rows.append(o)
                        out.append((size, i - int(firsts[o]), int(counts[o]), h, template, slots, spots))
                if not rows:
                    continue
                keys = batch.select(range(len(key))).take(pa.array(rows))
                cols = list(zip(*out))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
                kinds.append(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    keys.columns + [pa.array(c, t) for c, t in zip(cols, kinds)],
                    [*key, "size", "at", "words", "hash", "template", "slots", "spots"],
                )

    return df.select(*key, text).mapInArrow(run, schema)


def _bitmap(windows: DataFrame) -> bytes:
    """A bit for each value of the first bits of a hash; 2 MB whatever the number of windows."""
    per = 32768
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    rows = (
        windows.groupBy(F.floor(place / per).alias("part"))
        .agg(F.bitmap_construct_agg(place % per).alias("bits"))
        .collect()
    )
    out = bytearray(1 << (BITMAP_BITS - 3))
    for r in rows:
        out[r["part"] * per // 8 : (r["part"] + 1) * per // 8] = r["bits"]
    return bytes(out)


def _covered(places: Column) -> Column:
    """Words inside windows of ``size`` words that start at the places, in order."""
    size = F.col("size").cast("long")
    return array_sum(F.transform(places, lambda i, k: F.least(size, F.coalesce(F.get(places, k + 1) - i, size))))


def _judged(places: Column, pairs: Column, size: Column) -> Column:
    """``settled``, whether each value of the item stands for one value in most mentions, and ``places`` that agree."""

    def distinct(x: Column, *names: str) -> Column:
        return F.array_distinct(F.transform(x, lambda p: F.struct(*[p[n].alias(n) for n in names])))

    def plain(kinds: Column) -> Column:
        return F.size(distinct(kinds, "old")) == F.size(kinds)

    def mentions(x: Column, **same: Column) -> Column:
        return F.size(F.filter(x, lambda p: reduce(lambda a, b: a & b, [p[n] == v for n, v in same.items()])))

    def few(p: Column, x: Column) -> Column:
        return 2 * mentions(x, old=p["old"], new=p["new"]) <= mentions(x, old=p["old"])

    def vote(kinds: Column) -> Column:
        outvoted = F.filter(kinds, lambda p: few(p, pairs))
        values = F.size(distinct(kinds, "old"))
        settled = F.size(kinds) - F.size(outvoted) == values
        # A mention that is the same in both texts is a copy, whatever the others are.
        wrong = F.filter(outvoted, lambda p: p["old"] != p["new"])

        def agreeing(bad: Column) -> Column:
            spots = F.transform(
                F.filter(pairs, lambda p: F.exists(bad, lambda b: (b["old"] == p["old"]) & (b["new"] == p["new"]))),
                lambda p: p["place"],
            )
            return let(spots, lambda z: F.filter(places, lambda a: ~F.exists(z, lambda q: q.between(a, a + size - 1))))

        return F.struct(settled.alias("settled"), let(wrong, agreeing).alias("places"))

    def of(kinds: Column) -> Column:
        all_agree = F.struct(F.lit(True).alias("settled"), places.alias("places"))
        return F.when(plain(kinds), all_agree).otherwise(vote(kinds))

    return let(distinct(pairs, "old", "new"), of)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``key, doc_id, item_id, matched_words, item_words, changed`` for each document that holds an item.

    ``changed`` tells that slots of the item have other values in the document.
    ``key`` is the ``text_key`` of the document.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    # Items are sought as written and in lower case; documents are read as written.
    sought_sizes = list(range(MIN_LITERALS, WINDOW + 1))
    windows = template_windows(items, ["item_id"], "item_text", sought_sizes, None, (False, True))
    # Only whole items are windows shorter than WINDOW. A template that an item repeats is sought at its first
    # place, so a repeating document meets a repeating item once a word.
    first = F.min(F.struct("at", "hash", "words", "slots", "spots")).alias("x")
    found = windows.filter(F.col("size") == F.least("words", F.lit(WINDOW)))
    found = cut_lineage(found.groupBy("item_id", "template", "size").agg(first).select("item_id", "template", "size", "x.*"))
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())  # up to WINDOW numbers
    # The words that templates can match; where there are none, those that literal windows can.
    typed = F.collect_set(F.when(~F.startswith("template", F.lit(LITERAL)), F.col("at")))
    places = F.when(F.size(typed) > 0, typed).otherwise(F.collect_set("at"))
    whole = found.groupBy("item_id").agg(F.sort_array(places).alias("places"), F.max("size").alias("size"))
    whole = whole.select("item_id", let(F.col("places"), _covered).alias("item_covered"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", text_key().alias("key"), "text")
    own = template_windows(rows, ["doc_id", "key"], "text", sizes, _bitmap(found))
    sought = broadcast_if_small(
        found.join(whole, "item_id").select(
            "item_id", "template", "size", "item_covered", F.col("at").alias("item_at"),
            F.col("words").alias("item_words"), F.col("slots").alias("item_slots"), "spots",
        )
    )
    met = own.select("doc_id", "key", "template", "at", "slots").join(sought, "template")
    # One alignment is one distance between the places in document and item; it has no more windows than the item.
    pair = F.transform(
        "item_slots",
        lambda old, i: F.struct(
            (F.col("item_at") + F.get("spots", i)).alias("place"), old.alias("old"), F.get("slots", i).alias("new")
        ),
    )
    line = ["doc_id", "key", "item_id", "item_words", "item_covered", "size"]
    lines = met.groupBy(*line, (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.sort_array(F.collect_set("item_at")).alias("places"),
        F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"),
    )
    size = F.col("size").cast("long")
    own = lines.withColumn("own", _judged(F.col("places"), F.col("pairs"), size)).filter("own.settled")
    # Words put in or left out move the rest of the item: alignments from each one on are added up.
    near = Window.partitionBy(*line).orderBy("shift").rangeBetween(0, SLACK)
    pooled = own.select(
        *line,
        F.col("own.places").alias("own"),
        "pairs",
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("own.places").over(near)))).alias("places"),
        F.array_distinct(F.flatten(F.collect_list("pairs").over(near))).alias("all_pairs"),
    ).withColumn("pool", _judged(F.col("places"), F.col("all_pairs"), size))
    pooled = pooled.withColumns({
        "own": let(F.col("own"), _covered),
        "pool": F.when(F.col("pool.settled"), let(F.col("pool.places"), _covered)).otherwise(F.lit(0)),
    })

    need = F.least(F.lit(MIN_WORDS).cast("long"), F.ceil(F.col("item_words") * MIN_SHARE), "item_covered")
    told = F.when(F.col("pool") > F.col("own"), F.col("all_pairs")).otherwise(F.col("pairs"))
    return (
        pooled.withColumn("matched_words", F.greatest("own", "pool"))
        .filter(F.col("matched_words") >= need)
        .withColumn("changed", F.exists(told, lambda p: p["old"] != p["new"]))
        .groupBy("key", "doc_id", "item_id", "item_words")
        .agg(F.max(F.struct("matched_words", ~F.col("changed"))).alias("best"))
        .select(
            "key", "doc_id", "item_id", F.col("best.matched_words").alias("matched_words"), "item_words",
            (~F.col("best.col2")).alias("changed"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    bad = broadcast_if_small(contaminated(docs, benchmark, doc_id, text).select(F.col("key").alias("_key")).distinct())
    return docs.withColumn("_key", text_key(doc_id, text)).join(bad, "_key", "left_anti").select(*docs.columns)


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched_words", "item_words", "changed")
