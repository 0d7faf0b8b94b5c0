"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its character 1- to 3-grams (lower case, spaces
included), hashed into ``BUCKETS``.  A text's vector is the mean of its
features' embeddings; a softmax layer maps it to languages.  Both layers are
trained by stochastic gradient descent in numpy on a bounded sample of the
labelled rows: at most ``per_lang`` texts of each language, chosen by hash.
A part of the sample is held back to fit the softmax temperature and the bound
below which a prediction is rejected.  The softmax only tells the languages
apart, a text in none of them may get a high score; rejected are texts whose
grams are too unlikely in the learned languages together (mean log-likelihood
per gram of its runs of letters, in deviations that depend on their length), so
texts that mix learned languages or hold numbers and signs stay.  Prediction reads every row in one pass.

Defined results.  Null or empty text, or one without a letter: ``und``, score
0, rejected.  Null doc_id: predicted like any other.  Repeated rows: each gets
the same prediction.  Very long texts: read whole, piece by piece.  Equal
probabilities: the first language in alphabetical order.  No labelled rows:
``und`` for all.  Empty table: no rows.  Columns besides doc_id, text and lang
are ignored (``accepted_rows`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightmart.llm.common import python_batches

BUCKETS = 1 << 14
DIM = 16
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_PIECE = 1_000_000
KNOWN_REJECTED = 0.001  # share of the held-back known texts that the bound may reject
_MEDIAN_SQUARE = 0.4549  # of a standard normal variable


def features(text: str) -> np.ndarray:
    """How often each bucket occurs among the text's 1- to 3-grams."""
    total = np.zeros(BUCKETS, np.int64)
    text = f" {text.lower()} "
    for at in range(0, len(text), _PIECE):
        one = np.frombuffer(text[max(0, at - 2):at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        fresh = min(at, 2)  # grams that end in the two characters before are counted already
        two = one[1:] + one[:-1] * np.uint32(0x9E3779B1)
        three = one[2:] + two[:-1] * np.uint32(0x85EBCA77)
        for n, gram in enumerate((one, two, three)):
            gram = gram[max(0, fresh - n):]
            mixed = (gram ^ gram >> np.uint32(15)) * np.uint32(0xC2B2AE3D + 2 * n)
            total += np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
    return total


def letters(text: str) -> str:
    """The text's runs of letters, with a space between."""
    return _NO_LETTERS.sub(" ", text).strip()


@dataclass
class Model:
    """weights: per bucket and language the logit that a feature adds, averaged over a text's features.

    likely: per bucket the log-likelihood of a gram in the learned languages together, less its mean over known texts.
    """

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    likely: np.ndarray
    temperature: float = 1.0
    spread: tuple[float, float] = (1.0, 1.0)  # variance of a text's mean: of one gram, and between texts
    reject_below: float = -np.inf

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether it is accepted)."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, False
        counts = features(text)
        p = _softmax((counts @ self.weights / counts.sum() + self.bias) / self.temperature)
        best = int(np.argmax(p))
        counts = features(letters(text))
        return self.langs[best], float(p[best]), bool(self.deviation(counts @ self.likely / counts.sum(), counts.sum()) >= self.reject_below)

    def deviation(self, mean, n_grams):
        """How many deviations a text's mean log-likelihood lies above that of known texts."""
        return mean / np.sqrt(self.spread[0] / n_grams + self.spread[1])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Row = tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def train(rows: list[Row], epochs: int = 6, rate: float = 20.0, batch: int = 32, seed: int = 7) -> Model:
    """rows: (language, buckets, their counts, and both of the letters alone).  Every fifth row of a language is held back for calibration."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(BUCKETS))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    label = np.array([langs.index(r[0]) for r in rows])
    nth = np.zeros(len(rows), np.int64)
    for k in range(len(langs)):
        nth[label == k] = np.arange((label == k).sum())
    held, fit = np.flatnonzero(nth % 5 == 4), np.flatnonzero(nth % 5 != 4)
    weight = len(fit) / (len(langs) * np.maximum(1, np.bincount(label[fit], minlength=len(langs))))  # languages count alike
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            used, x = _dense([rows[i] for i in at])
            mean = x @ embed[used]
            error = _softmax(mean @ out + bias)
            error[np.arange(len(at)), label[at]] -= 1
            error *= (weight[label[at]] / len(at))[:, None].astype(np.float32)
            back = error @ out.T
            out -= step * 0.1 * (mean.T @ error)
            bias -= step * 0.01 * error.sum(axis=0)
            embed[used] -= step * (x.T @ back)
    model = Model(langs, (embed @ out).astype(np.float32), bias, _likely([rows[i] for i in fit], label[fit], len(langs)))
    if len(held):
        logits = np.stack([counts @ model.weights[buckets] / counts.sum() for _, buckets, counts, *_ in (rows[i] for i in held)]) + bias
        truth = label[held]
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
        model.temperature = float(min(losses, key=losses.get))
        n = np.array([rows[i][4].sum() for i in held])
        mean = np.array([rows[i][4] @ model.likely[rows[i][3]] for i in held]) / n
        centre = np.median(mean)
        model.likely, mean = model.likely - centre, mean - centre
        short = n <= np.median(n)  # medians, so that junk among the held-back rows does not widen the bound
        between = np.median(mean[n >= np.median(n)] ** 2) / _MEDIAN_SQUARE
        model.spread = (float(max(1e-6, np.median(np.maximum(0, mean[short] ** 2 / _MEDIAN_SQUARE - between) * n[short]))), float(max(1e-6, between)))
        model.reject_below = _low_quantile(model.deviation(mean, n), KNOWN_REJECTED)
    return model


def _low_quantile(x: np.ndarray, share: float, tail: float = 0.1) -> float:
    """The quantile, or what an exponential tail below the lowest tenth gives, if that is lower: few rows do not show it."""
    start = np.quantile(x, tail)
    excess = (start - x[x <= start]).mean()
    return float(min(np.quantile(x, share), start - excess * np.log(tail / share)))


def _likely(rows: list[Row], label: np.ndarray, n_langs: int) -> np.ndarray:
    """Per bucket the log of its share of all grams, languages counting alike; a bucket not seen counts half a gram."""
    share = np.zeros(BUCKETS)
    for k in range(n_langs):
        total = np.full(BUCKETS, 0.5)
        for i in np.flatnonzero(label == k):
            total[rows[i][3]] += rows[i][4]
        share += total / total.sum() / n_langs
    return np.log(share)


def _dense(rows: list[Row]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and the rows' shares of them."""
    used, column = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    x = np.zeros((len(rows), len(used)), np.float32)
    x[np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows]), column] = np.concatenate([r[2] / r[2].sum() for r in rows])
    return used, x


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in python_batches(batches):
        found: list[list[bytes]] = [[], [], [], []]
        for text in batch.column("text").to_pylist():
            for k, part in ((0, text), (2, letters(text))):
                total = features(part)
                there = np.flatnonzero(total)
                found[k].append(there.astype("<u2").tobytes())
                found[k + 1].append(total[there].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), *[pa.array(x, pa.binary()) for x in found]], names=["lang", "h", *_FOUND])


_FOUND = ["buckets", "counts", "letter_buckets", "letter_counts"]


def fit(docs: DataFrame, learn: Column, per_lang: int = 800, max_rows: int = 4000) -> Model:
    """Train on at most ``per_lang`` texts of each language, and on ``max_rows`` of all, about.

    ``learn`` says which rows may be learnt from.  A language's rows are taken
    by a hash of doc_id and text, in the share that leaves about as many.  At
    most ``max_rows`` languages are told apart, the commonest.  Texts become
    feature counts in the tasks; only those of the sample reach the driver.
    """
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()
    if not counts:
        return train([])
    each = max(1, min(per_lang, max_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.2 * each / r["count"] + 3 / r["count"]))])
    some = rows.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    found = some.mapInArrow(_featurise, "lang string, h long, " + ", ".join(f"{c} binary" for c in _FOUND)).collect()
    taken: dict[str, int] = {}
    sample: list[Row] = []
    # in the hash's order, so that the model does not depend on how the table is dealt
    for r in sorted(found, key=lambda r: (r["h"], r["lang"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= each:
            sample.append((r["lang"], *[np.frombuffer(r[c], "<f4") if c.endswith("counts") else np.frombuffer(r[c], "<u2").astype(np.int64) for c in _FOUND]))
    return train(sample)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row; only the text is looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, accepted boolean")


def _accepted(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            keep = [model.predict(t)[2] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def accepted_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is recognised, with all their columns."""
    return docs.mapInArrow(_accepted(model, docs.columns.index("text")), docs.schema)
