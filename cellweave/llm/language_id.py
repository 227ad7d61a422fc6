"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its byte n-grams, hashed to buckets; a
linear layer and a softmax turn it into probabilities of languages. Both layers
are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows. A temperature, fitted on a part of the sample kept aside, makes
the score a probability; below the score that keeps most of that part, the
prediction is marked as rejected.

As the mean and the linear layer commute, prediction needs one vector of
language weights for each bucket: all n-grams of the whole text are looked up
and averaged.

Defined results: the prediction is ``und`` with score 0 where text is null or
has no letter, or where there is no labelled row to learn from. Ids may be null
or repeated; rows are judged one by one. An empty table gives no rows. Texts of
any length are read whole, in pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.registry import query
from cellweave.llm.text import map_texts, remainder, table

BUCKETS = 1 << 14
GRAMS = (2, 3, 4)
#: The sample to learn from: so many rows in all, so many characters of each.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 6000
PIECE = 1 << 20
#: Part of the labels taken to be wrong when the temperature is fitted, so scores stay below 1.
SMOOTHING = 0.02
UNKNOWN = "und"

#: ASCII letters in lower case and bytes of other letters stay, the rest is a space.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def grams(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams of a text's letters."""
    b = np.frombuffer(raw.translate(_LETTERS), dtype=np.uint8).astype(np.uint32)
    out, h = [], b
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        if n in GRAMS:
            out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(buckets))
    return np.concatenate(out)


def pieces(text: str):
    """The text in lower case, framed by spaces, in pieces that share the bytes n-grams need."""
    raw = b" " + text.lower().encode("utf-8", "replace") + b" "
    reach = max(GRAMS) - 1
    if len(raw) <= PIECE:
        yield raw
        return
    for at in range(0, len(raw) - reach, PIECE):
        yield raw[at : at + PIECE + reach]


@dataclass
class LanguageModel:
    """Language weights by bucket, after the temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.labels)), 0
        for raw in pieces(text):
            found = grams(raw)
            seen = np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS else None
            total += seen @ self.weights if seen is not None else self.weights[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        z = total / max(n, 1) + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def train(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 6, seed: int = 7) -> LanguageModel:
    """Fit the model by SGD, then the temperature and the rejection score on every tenth row."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    bags = []
    for text in texts:
        found = np.concatenate([grams(raw) for raw in pieces(text)])
        ids, n = np.unique(found, return_counts=True)
        bags.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    y = np.array([names.index(x) for x in labels])
    aside = np.arange(len(y)) % 10 == 9
    learn = np.flatnonzero(~aside)
    inner = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    outer = np.zeros((dim, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    outer += rng.normal(0, 0.1, outer.shape)
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            ids, share = bags[i]
            rate = 0.5 * (1 - done / steps)
            done += 1
            h = share @ inner[ids]
            z = h @ outer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = outer @ p
            outer -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            # The mean spreads the gradient over many n-grams: scale it back by their number.
            inner[ids] -= (rate * min(len(ids), 200)) * np.outer(share, back)
    weights = inner @ outer
    logits = np.array([share @ weights[ids] for ids, share in bags]) + bias
    check = np.flatnonzero(aside) if aside.any() else learn

    def sure(t: float) -> np.ndarray:
        z = logits[check] / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        logs = np.log(sure(t) + 1e-12)
        right = logs[np.arange(len(check)), y[check]]
        return -((1 - SMOOTHING) * right + SMOOTHING * logs.mean(axis=1)).mean()

    t = min(np.geomspace(0.05, 20, 80), key=loss)
    return LanguageModel(names, weights / t, bias / t, float(np.quantile(sure(t).max(axis=1), 0.01)))


def learn_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS
) -> LanguageModel:
    """Train on at most about ``rows`` labelled rows of ``docs``, spread evenly over the languages.

    Rows are chosen by a hash of their text; of each, ``chars`` characters are
    read. Languages beyond the ``rows // 20`` most frequent are not learned.
    """
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows // 20).collect()
    if not sizes:
        return train([], [])
    share = rows / len(sizes)
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chance = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, share / r["count"]))])
    sample = (
        labelled.filter(draw < F.coalesce(chance[F.col("lang")], F.lit(0.0)))
        .select("lang", F.substring("text", 1, chars).alias("text"))
        .limit(2 * rows)
        .collect()
    )
    sample.sort()
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``lang_pred, score, rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the data

    def fn(texts):
        for t in texts:
            name, score = shared.value.predict(t)
            yield {"lang_pred": name, "score": score, "rejected": score < shared.value.reject_below}

    kept = docs.drop("lang_pred", "score", "rejected")
    return map_texts(kept, fn, "lang_pred string, score double, rejected boolean", text)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = learn_languages(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model)
