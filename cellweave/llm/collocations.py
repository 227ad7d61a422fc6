"""Phrase collocations from Rabin-Karp fingerprints.

Words of a task's texts get whole numbers by an exact dictionary, and each word of
the dictionary a polynomial hash of its bytes. Prefix polynomials over the hashes
of successive words give the fingerprint of every n-gram by one subtraction and
one multiplication. Fingerprints are counted in the task, then in a shuffle.

Phrases grow word by word: an n-gram is counted only if both (n-1)-grams in it
may be frequent, which a sieve tells, a bitmap of the frequent fingerprints of
the length before. It is broadcast; its size is fixed by ``SIEVE_BITS`` however
many phrases there are, and what it lets through wrongly costs a count, no more.

A last reading takes all occurrences whose fingerprints pass the sieves. In a
task, each occurrence is compared word by word with the first of its fingerprint;
those that differ are told apart. What leaves the task is a pointer to the first
occurrence, its count and its text, so the shuffle adds up counts of equal text:
fingerprints that collide cannot join two phrases. Only phrases that pass, the
frequent ones and a few more, are ever spelled out.

Defined results: null texts and languages are empty text and ``und``. Repeated
rows count each. Ids only serve to point at an example, null ones too; other
columns are left out. A table without frequent phrases, and an empty one, give an
empty result. Long texts are cut between pieces, never inside them. Ties between
cuts go to the shortest first part, between phrases to the larger count, then to
the smaller text by bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.registry import query
from cellweave.llm.text import table
from cellweave.session import broadcast_if_small, cut_lineage, lookup

LONGEST, LEAST, TOP = 5, 100, 2000
UNKNOWN = "und"
#: A sieve has this many bits for each fingerprint, within these powers of two.
SIEVE_SPARE, SIEVE_LEAST, SIEVE_BITS = 32, 20, 26
#: Bytes of text worked on at once, and distinct fingerprints held by a task.
CHUNK, HELD = 2 << 20, 1 << 20
#: Phrases, and words, that a task holds before it spells them out; partitions it takes one after another.
SPELLED, TOGETHER = 1_000_000, 4
#: Phrases spelled out at once.
ROWS = 20_000
#: Parts by which each language's ranking is begun.
SALTS = 64

# Odd multipliers of the two polynomials; their inverses modulo 2^64 divide.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: space, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2^64."""
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Polynomial:
    """Prefix polynomials over sequences of words of 64 bits, modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = powers(base, 1), powers(self.inverse, 1)

    def slices(self, values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """What gives the polynomial of a slice from ``start`` to ``end``, whatever its place in the sequence."""
        if len(self.up) <= len(values):
            self.up, self.down = (powers(x, len(values) + len(values) // 4 + 1) for x in (self.base, self.inverse))
        prefix, down = np.zeros(len(values) + 1, np.uint64), self.down
        np.cumsum(values * self.up[: len(values)], out=prefix[1:])
        return lambda start, end: (prefix[end] - prefix[start]) * down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some texts at a time, the row each belongs to, and its place in its text.

    A text over ``limit`` bytes is cut after the end of a piece.
    """
    rows: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts.to_pylist()):
        data = np.frombuffer((text or "").encode(), np.uint8)
        cuts = [0]
        if len(data) > limit:
            ends = np.flatnonzero(_KIND[data] == 2) + 1
            while len(data) - cuts[-1] > limit:
                at = np.searchsorted(ends, cuts[-1] + limit, side="right") - 1
                cut = ends[at] if at >= 0 and ends[at] > cuts[-1] else ends[at + 1] if at + 1 < len(ends) else len(data)
                cuts.append(int(cut))
        for a, b in zip(cuts, [*cuts[1:], len(data)]):
            if held and held + b - a > limit:
                yield _joined(rows)
                rows, held = [], 0
            if b > a:
                rows.append((i, a, data[a:b]))
                held += b - a
    if held:
        yield _joined(rows)


def _joined(rows):
    sizes = np.array([len(d) for _, _, d in rows])
    first = np.cumsum(sizes + 1) - sizes - 1  # each text is followed by the end of a piece
    data = np.full(int(sizes.sum()) + len(rows), ord("."), np.uint8)
    for at, (_, _, d) in zip(first, rows):
        data[at : at + len(d)] = d
    return data, np.array([i for i, _, _ in rows]), np.stack([first, [a for _, a, _ in rows]])


class Words:
    """The words of a chunk of one language: exact numbers, pieces, and fingerprints of their sequences."""

    def __init__(self, chunk, salt: int, by_byte: Polynomial, by_word: Polynomial, bits: int = 64):
        self.rows, self.places, self.salt, self.bits = chunk[1], chunk[2], np.uint64(salt), bits
        data = _LOWER[chunk[0]]
        kind = _KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # a chunk ends with the end of a piece
        edge = np.append(0, edge) if inside[0] else edge
        self.start, end = edge[::2], edge[1::2]
        # A word opens a piece if a separator stands before it and after the word before.
        separators = np.flatnonzero(kind == 2)
        opened = np.zeros(len(self.start) + 1, np.int32)
        opened[np.searchsorted(self.start, separators)] = 1
        self.piece = np.cumsum(opened[:-1])
        size = end - self.start
        flat = pa.BinaryArray.from_buffers(
            pa.binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data[inside])]
        )
        coded = flat.dictionary_encode()
        self.id, self.names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        length = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        stop = np.cumsum(length)
        letters = np.frombuffer(b"".join(self.names), np.uint8).astype(np.uint64) + np.uint64(1)
        #: A hash of each word of the dictionary.
        self.hash = mixed(by_byte.slices(letters)(stop - length, stop) + length.astype(np.uint64))
        self.sequences = by_word.slices(self.hash[self.id])

    def grams(self, n: int) -> np.ndarray:
        """Places where n words of one piece begin."""
        count = len(self.id) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[:count])

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the n words from each place; languages have salts of their own."""
        return self._printed(self.sequences(at, at + n), n)

    def names_printed(self) -> np.ndarray:
        """The fingerprints of single words, one for each of the dictionary."""
        return self._printed(self.hash, 1)

    def _printed(self, hashes: np.ndarray, n: int) -> np.ndarray:
        prints = mixed(hashes ^ self.salt ^ np.uint64(n))
        return prints if self.bits == 64 else mixed(prints >> np.uint64(64 - self.bits))

    def pointers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word and where in its text it begins."""
        of = np.searchsorted(self.places[0], self.start[at], side="right") - 1
        return self.rows[of], self.start[at] - self.places[0][of] + self.places[1][of]


def salt_of(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def by_language(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[str, np.ndarray, Words]]:
    """``lang``, the rows of a batch and the words of their texts, chunk by chunk; and the batch."""
    by_byte, by_word = Polynomial(BYTE_BASE), Polynomial(WORD_BASE)
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        indices = coded.indices.to_numpy()
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            rows = np.flatnonzero(indices == i)
            for chunk in chunks(batch.column(1).take(pa.array(rows)), CHUNK):
                yield lang, rows, Words(chunk, salt_of(lang), by_byte, by_word, bits), batch


def passes(sieve: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether fingerprints may be in a sieve: a bitmap of a power of two of bits, by their highest bits."""
    place = prints >> np.uint64(64 - (len(sieve) * 64).bit_length() + 1)
    return (sieve[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def frequent_places(words: Words, n: int, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams that pass a sieve, and their fingerprints."""
    if n == 1:
        prints = words.names_printed()
        at = np.flatnonzero(passes(sieve, prints)[words.id])
        return at, prints[words.id[at]]
    at = words.grams(n)
    prints = words.fingerprints(at, n)
    ok = passes(sieve, prints)
    return at[ok], prints[ok]


def grown(words: Words, n: int, shorter: np.ndarray) -> np.ndarray:
    """Places of the n-grams whose first and last n - 1 words both begin at one of ``shorter``."""
    ok = np.zeros(len(words.id) + 1, bool)
    ok[shorter] = True
    at = shorter[ok[shorter + 1]]
    return at[words.piece[at] == words.piece[at + n - 1]]


def count_fingerprints(docs: DataFrame, n: int, sieve, bits: int = 64) -> DataFrame:
    """``fp, n``: how often each fingerprint of n words occurs. ``sieve`` is a broadcast bitmap, None for single words.

    Fingerprints are cut to ``bits``; tests make them collide so.
    """

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            prints, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(prints)
            prints = prints[order]
            first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
            return prints[first], np.add.reduceat(counts[order], first)

        def out(found, counts):
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["fp", "n"])

        for _, _, words, _ in by_language(batches, bits):
            if n == 1:
                found, counts = words.names_printed(), np.bincount(words.id, minlength=len(words.names))
            else:
                at = grown(words, n, frequent_places(words, n - 1, sieve.value)[0])
                found, counts = np.unique(words.fingerprints(at, n), return_counts=True)
            if not len(found):
                continue
            held.append((found, counts))
            size += len(found)
            if size > 2 * HELD:
                found, counts = merged()
                held, size = [(found, counts)], len(found)
                if size > HELD:
                    yield out(found, counts)
                    held, size = [], 0
        if held:
            yield out(*merged())

    parts = docs.select("lang", "text").mapInArrow(run, "fp long, n long")
    return parts.groupBy("fp").agg(F.sum("n").alias("n"))


def sieve_of(frequent: DataFrame, spark: SparkSession) -> np.ndarray:
    """A bitmap of fingerprints; its size is bounded whatever their number."""
    count = frequent.count()
    power = min(max((SIEVE_SPARE * count).bit_length(), SIEVE_LEAST), SIEVE_BITS)
    word = F.shiftrightunsigned("fp", 64 - power + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - power}) & 63 as int))")
    marks = frequent.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    sieve = np.zeros(1 << (power - 6), np.int64)
    sieve[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    return sieve.view(np.uint64)


class Phrases:
    """Occurrences of phrases of n words by fingerprint, each with the exact words of its first occurrence."""

    def __init__(self, n: int):
        self.n = n
        self.prints, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words, self.pointers = np.zeros((0, n), np.int64), np.zeros((0, 2), np.int64)

    def add(self, prints: np.ndarray, words: np.ndarray, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count occurrences, given by word numbers and pointers.

        Each is compared word by word with the first one of its fingerprint; the
        word numbers and pointers of those that differ are given back.
        """
        _, first, where = np.unique(prints, return_index=True, return_inverse=True)
        same = (words == words[first[where]]).all(axis=1)
        counts = np.bincount(where[same], minlength=len(first))
        place = np.searchsorted(self.prints, prints[first])
        known = np.append(self.prints, np.uint64(0))[place] == prints[first]
        known &= place < len(self.prints)
        alike = known.copy()
        alike[known] = (self.words[place[known]] == words[first[known]]).all(axis=1)
        np.add.at(self.counts, place[alike], counts[alike])
        new = first[~known]
        at = place[~known]
        self.prints = np.insert(self.prints, at, prints[new])
        self.counts = np.insert(self.counts, at, counts[~known])
        self.words = np.insert(self.words, at, words[new], axis=0)
        self.pointers = np.insert(self.pointers, at, pointers[new], axis=0)
        other = ~same | (known & ~alike)[where]
        return words[other], pointers[other]


def spell(docs: DataFrame, sieves: list, bits: int = 64) -> DataFrame:
    """Occurrences that pass: ``lang, n_words, phrase, n`` and a pointer ``doc_id, place`` to one, by task.

    A row of no words tells how many words a language has.
    """

    def run(batches):
        state: dict = {}

        def clear():
            state.update(numbers={}, ids=[], found={}, total={})

        def out():
            names = list(state["numbers"])
            yield batch_of([(lang, 0, "", count, None, 0) for lang, count in state["total"].items()])
            for (lang, n), held in state["found"].items():
                for lo in range(0, len(held.counts), ROWS):  # all rows at once would weigh more than the phrases
                    some = (x[lo : lo + ROWS].tolist() for x in (held.words, held.counts, held.pointers))
                    yield batch_of(
                        [
                            (lang, n, b" ".join([names[w] for w in words]).decode(), count, state["ids"][doc], place)
                            for words, count, (doc, place) in zip(*some)
                        ]
                    )

        def batch_of(rows):
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "n_words", "phrase", "n", "doc_id", "place"]
            )

        clear()
        last = None
        for lang, rows, words, batch in by_language(batches, bits):
            if batch is not last:
                last, base = batch, len(state["ids"])
                state["ids"] += batch.column(2).to_pylist()
            state["total"][lang] = state["total"].get(lang, 0) + len(words.id)
            numbers = state["numbers"]
            # Phrases that pass are made of words that pass, so no other word needs a number.
            kept = np.flatnonzero(passes(sieves[0].value, words.names_printed())) if sieves else np.zeros(0, np.int64)
            number = np.full(len(words.names), -1, np.int64)
            number[kept] = [numbers.setdefault(words.names[i], len(numbers)) for i in kept.tolist()]
            at = None
            for n, sieve in enumerate(sieves, 1):
                if n == 1:
                    at, prints = frequent_places(words, n, sieve.value)
                else:  # as in counting, both shorter ones inside have to pass
                    at = grown(words, n, at)
                    prints = words.fingerprints(at, n)
                    ok = passes(sieve.value, prints)
                    at, prints = at[ok], prints[ok]
                if not len(at):
                    break
                exact = number[np.stack([words.id[at + k] for k in range(n)], axis=1)]
                row, place = words.pointers(at)
                pointers = np.stack([base + rows[row], place], axis=1)
                held = state["found"].setdefault((lang, n), Phrases(n))
                unlike, theirs = held.add(prints, exact, pointers)
                if len(unlike):  # fingerprints that collide: these are spelled out at once
                    names = list(numbers)
                    yield batch_of(
                        [
                            (lang, n, b" ".join([names[w] for w in x]).decode(), 1, state["ids"][doc], place)
                            for x, (doc, place) in zip(unlike.tolist(), theirs.tolist())
                        ]
                    )
            if sum(len(x.prints) for x in state["found"].values()) > SPELLED or len(numbers) > SPELLED:
                yield from out()
                last = None
                clear()
        yield from out()

    schema = "lang string, n_words int, phrase string, n long, doc_id string, place long"
    wanted = docs.select("lang", "text", F.col("doc_id").cast("string").alias("doc_id"))
    # Most tasks see most frequent phrases: a task takes several partitions, and counts what they share once.
    return _fewer(wanted).mapInArrow(run, schema)


def _fewer(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    parts = df.rdd.getNumPartitions()
    return df.coalesce(max(spark.sparkContext.defaultParallelism, -(-parts // TOGETHER)))


def frequent_phrases(
    df: DataFrame, longest: int = LONGEST, least: int = LEAST, lang: str = "lang", text: str = "text",
    key: str = "doc_id", bits: int = 64,
) -> DataFrame:
    """``lang, n_words, phrase, n, doc_id, place`` of all phrases of one to ``longest`` words found ``least`` times.

    ``doc_id`` (as text) and ``place`` (in bytes) point at an example. Rows of
    no words hold the number of words of each language.
    """
    spark = df.sparkSession
    docs = df.select(
        F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"), F.col(key).alias("doc_id")
    )
    sieves: list = []
    for n in range(1, longest + 1):
        counted = count_fingerprints(docs, n, sieves[-1] if sieves else None, bits)
        frequent = cut_lineage(counted.filter(F.col("n") >= least).select("fp"))
        sieves.append(spark.sparkContext.broadcast(sieve_of(frequent, spark)))
    parts = spell(docs, sieves, bits).groupBy("lang", "n_words", "phrase")
    example = F.min_by(F.struct("doc_id", "place"), F.struct(F.coalesce("doc_id", F.lit("")), "place"))
    exact = parts.agg(F.sum("n").alias("n"), example.alias("at"))
    exact = exact.filter((F.col("n") >= least) | (F.col("n_words") == 0))
    return cut_lineage(exact.select("lang", "n_words", "phrase", "n", "at.doc_id", "at.place"))


def scored(phrases: DataFrame) -> DataFrame:
    """The weakest cut of each phrase of two words or more: ``a, l, r, n, score`` and ``cut``."""
    total = phrases.filter("n_words = 0").select("lang", F.col("n").alias("total"))
    words = F.split("phrase", " ", -1)
    cuts = (
        phrases.filter("n_words > 1")
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
        .select(
            "lang", "n_words", "phrase", F.col("n").alias("a"), "doc_id", "place", "cut",
            F.concat_ws(" ", F.slice(words, F.lit(1), F.col("cut"))).alias("left"),
            F.concat_ws(" ", F.slice(words, F.col("cut") + 1, F.col("n_words"))).alias("right"),
        )
    )
    cuts = cut_lineage(cuts)
    rows = cuts.count()
    parts = phrases.filter("n_words > 0").select("lang", "phrase", "n")
    for side, name in (("left", "l"), ("right", "r")):
        named = parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
        cuts = lookup(cuts, named, ["lang", side], rows)
    wide = "decimal(38,0)"
    cuts = cuts.join(broadcast_if_small(total), "lang")
    # Counts have up to 19 digits; products of 38 digits are exact, larger ones an error.
    product = F.expr(f"cast(a as {wide}) * cast(total as {wide}) * cast(1000 as {wide})")
    score = F.expr(f"cast(l as {wide}) * cast(r as {wide})")
    cuts = cuts.withColumns({"_p": product.cast(wide), "_q": score.cast(wide)})
    cuts = cuts.withColumn("score", F.expr("_p div _q"))
    weakest = F.min(F.struct("score", "cut", "l", "r", F.col("total").alias("n"))).alias("w")
    best = cuts.groupBy("lang", "n_words", "phrase", "a", "doc_id", "place").agg(weakest)
    return best.select("lang", "n_words", "phrase", "a", "doc_id", "place", "w.l", "w.r", "w.n", "w.score", "w.cut")


def maximal(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases without those that lie inside a longer one found ``percent`` in a hundred times as often."""
    words = F.split("phrase", " ", -1)
    lengths = F.explode(F.sequence(F.lit(2), F.col("n_words") - 1))
    parts = phrases.filter("n_words > 2").select("lang", "n_words", "a", words.alias("w"), lengths.alias("size"))
    starts = F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1))
    parts = parts.withColumn("at", starts)
    inner = F.concat_ws(" ", F.slice("w", F.col("at"), F.col("size"))).alias("phrase")
    around = parts.select("lang", inner, "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = phrases.join(around, ["lang", "phrase"], "left")
    hides = 100 * F.col("around").cast("decimal(22,0)") >= percent * F.col("a").cast("decimal(22,0)")
    return kept.filter(F.col("around").isNull() | ~hides).drop("around")


def collocations(
    df: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = 100, bits: int = 64, **names
) -> DataFrame:
    """The ``top`` phrases of each language by score, with counts, an example and ``rank``."""
    found = maximal(cut_lineage(scored(frequent_phrases(df, longest, least, bits=bits, **names))), percent)
    order = [F.desc("score"), F.desc("a"), F.col("phrase").asc()]
    # A language may hold most phrases: each of its parts is cut to the first ones before they meet.
    found = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    inside = Window.partitionBy("lang", "_salt").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(inside)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top).drop("_salt")


OP13_SQL = r"""WITH piece AS (SELECT lang, doc_id, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang),
gram AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM (
SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM piece, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS c FROM gram WHERE k > 1),
weighed AS (SELECT cut.*, l.f AS l, r.f AS r, total.n,
CAST((1000::HUGEINT * a * total.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cut
JOIN gram l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.w[1 : cut.c], ' ')
JOIN gram r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.w[cut.c + 1 : cut.k], ' ')
JOIN total ON total.lang = cut.lang),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS i FROM weighed) WHERE i = 1),
hidden AS (SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(f) AS f FROM (
SELECT lang, w, f, m, unnest(generate_series(1, k - m + 1)) AS s FROM (
SELECT lang, k, f, string_split(phrase, ' ') AS w, unnest(generate_series(2, k - 1)) AS m FROM gram WHERE k > 2)) GROUP BY ALL)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM (
SELECT weakest.*, row_number() OVER (PARTITION BY weakest.lang ORDER BY score DESC, a DESC, phrase) AS rank
FROM weakest LEFT JOIN hidden USING (lang, phrase) WHERE hidden.f IS NULL OR 100 * hidden.f < 100 * a) WHERE rank <= 2000"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
