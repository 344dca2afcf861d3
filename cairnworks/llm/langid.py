"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams weighted by TF-IDF. Document frequencies come from all
documents that may be learned from. The weights are fitted by follow-the-regularised-leader
(per-coordinate FTRL-proximal, McMahan et al. 2013) with an elastic-net penalty, in steps of one row for each
language on average, on a bounded sample of labelled rows, and the scores are calibrated by a temperature fitted on a part of that
sample that the weights have not seen, to targets that Platt's rule keeps below one. Every label is learned: the sample holds at most
``per_language`` rows of each, and fewer where ``SAMPLE_ROWS`` are not enough for all, but one at least.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnworks.llm.batches import map_arrow, map_batches
from cairnworks.scratch import discard, materialize

#: Hashed features, n-gram sizes and code points counted at a time.
FEATURES = 1 << 15
SIZES = (1, 2, 3)
CHUNK = 1 << 20
#: Bound of the training sample: labelled rows of each language, and of all.
PER_LANGUAGE = 400
SAMPLE_ROWS = 80_000
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(128, 32, np.uint32)
_FOLD[[*range(65, 91), *range(97, 123)]] = [*range(97, 123), *range(97, 123)]


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole lower-cased text; runs of non-letters of ASCII are one space."""
    out = np.zeros(FEATURES, np.int64)
    held = np.array([32], np.uint32)
    for first in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[first : first + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes)
        seen = len(held)
        folded = np.concatenate([held, folded] if first + CHUNK < len(text) else [held, folded, [np.uint32(32)]])
        real = np.ones(len(folded), bool)
        real[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        real[:seen] = True
        folded = folded[real].astype(np.uint64)
        key = np.zeros(len(folded), np.uint64)
        for n in range(1, max(SIZES) + 1):
            end = len(folded) - n + 1
            if end <= 0:
                break
            key = key[:end] * np.uint64(0x9E3779B1) + folded[n - 1 :] + np.uint64(n)
            if n in SIZES:
                fresh = key[max(0, seen - n + 1) :] if first or seen > 1 else key
                mixed = (fresh ^ (fresh >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=FEATURES)
        held = folded[-(max(SIZES) - 1) :].astype(np.uint32)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # of every feature
    used: np.ndarray  # features with a weight
    weights: np.ndarray  # of those, for each language
    bias: np.ndarray
    temperature: float = 1.0

    def __post_init__(self):
        self.place = np.full(len(self.idf), -1)
        self.place[self.used] = np.arange(len(self.used))

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        x = _tfidf(counts[at], self.idf[at])
        rows = self.place[at]
        return x[rows >= 0] @ self.weights[rows[rows >= 0]] + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(counts) / self.temperature)


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class FtrlProximal:
    """Per-coordinate FTRL for softmax regression with L1 and L2 penalties; classes are taken a block at a time."""

    BLOCK = 256

    def __init__(self, features: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, dtype=np.float64):
        self.z, self.n = np.zeros((features, classes), dtype), np.zeros((features, classes), dtype)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _blocks(self) -> list[slice]:
        return [slice(k, k + self.BLOCK) for k in range(0, self.z.shape[1], self.BLOCK)]

    def weights(self, at=slice(None), of: slice = slice(None)) -> np.ndarray:
        z, n = self.z[at, of], self.n[at, of]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)).astype(z.dtype)

    def scores(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Logits of rows over the features ``at``."""
        return np.concatenate([values @ self.weights(at, of) for of in self._blocks()], axis=-1)

    def learn(self, at: np.ndarray, values: np.ndarray, labels) -> None:
        """One step on a row, or on rows of values over the same features; their gradients are added up."""
        values, labels = np.atleast_2d(values).astype(self.z.dtype), np.atleast_1d(labels)
        z = self.scores(at, values)
        error = np.exp(z - z.max(axis=1, keepdims=True))
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(len(labels)), labels] -= 1
        for of in self._blocks():
            w, n = self.weights(at, of), self.n[at, of]
            g = values.T @ error[:, of]
            grown = n + g * g
            self.z[at, of] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
            self.n[at, of] = grown


#: Most rows of one step.
STEP_ROWS = 256


def _together(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features that any row has, values of each row over them, labels)."""
    at, place = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    values = np.zeros((len(rows), len(at)), np.float32)
    values[np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), place] = np.concatenate([r[1] for r in rows])
    return at, values, np.array([r[2] for r in rows])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 4, seed: int = 7) -> Model | None:
    """A model of (language, features, counts) rows; None without any. One row in five calibrates.

    A step takes as many rows as there are languages, ``STEP_ROWS`` at most, so its matrices stay bounded; the
    learner's state takes 8 bytes for each feature and language (262 KB a language).
    """
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    data, place = [], {x: i for i, x in enumerate(languages)}
    for language, at, counts in rows:
        x = _tfidf(counts, idf[at])
        data.append((np.append(at, FEATURES), np.append(x, 0.1), place[language]))  # the last is the bias
    order = np.random.default_rng(seed).permutation(len(data))
    taught = {data[i][2]: i for i in order[::-1]}  # a row of each language that never calibrates
    spare = [i for i in order if taught[data[i][2]] != i]
    held = spare[: len(data) // 5]
    calibrates = set(held)
    seen = [i for i in order if i not in calibrates]
    learner = FtrlProximal(FEATURES + 1, len(languages), dtype=np.float32)
    step = min(STEP_ROWS, len(languages))
    for _ in range(epochs):
        for first in range(0, len(seen), step):
            learner.learn(*_together([data[i] for i in seen[first : first + step]]))
    used = np.nonzero((np.abs(learner.z[:FEATURES]) > learner.l1).any(axis=1))[0]
    model = Model(languages, idf, used, learner.weights(used), 0.1 * learner.weights(np.array([FEATURES]))[0])
    if held:
        z = np.concatenate([learner.scores(at, x) for at, x, _ in (_together([data[i] for i in held[k : k + STEP_ROWS]]) for k in range(0, len(held), STEP_ROWS))])
        model.temperature = fit_temperature(z, np.array([data[i][2] for i in held]))
    return model


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm.

    A row of a label with n rows counts (n + 1) / (n + 2) for its label (Platt's targets) and the rest for the
    others, so separable rows don't drive all scores to one.
    """
    rows, classes = np.arange(len(labels)), logits.shape[1]
    if classes < 2:
        return 1.0
    target = ((np.bincount(labels)[labels] + 1) / (np.bincount(labels)[labels] + 2))[:, None]
    others = (1 - target) / (classes - 1)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        own = logs[rows, labels][:, None]
        return float(-(target * own + others * (logs.sum(axis=1, keepdims=True) - own)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves remainder 1; a null id is learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the documents that are not held out and have text and a label."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(~held_out("id") & F.col("lang").isNotNull() & F.col("t").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df += ngram_counts(text.as_py()) > 0
                n += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "n"])

    counted = map_arrow(own.select("t"), frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most FEATURES + 1 rows
    found = {r["feature"]: r["n"] for r in counted}
    total = found.pop(-1, 0)
    df = np.zeros(FEATURES)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 1

    place = F.pmod(F.xxhash64(F.col("id").cast("string"), "lang", "t"), F.lit(1 << 40)) / (1 << 40)
    counts = materialize(own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")), "label-counts")
    n_languages = counts.count()
    if not n_languages:
        discard(counts)
        return None
    per_language = max(1, min(per_language, SAMPLE_ROWS // n_languages))
    # a row's place is even in [0, 1): a few more rows than wanted are ranked in each language, and the
    # first by place is among them where all rows of a label are copies
    # a row for each label, which the model holds too: texts must not be dealt by label to meet it
    few = F.broadcast(counts) if n_languages <= SAMPLE_ROWS else counts
    picked = own.join(few, "lang").where((place * F.col("n") < 1.5 * (per_language + 20)) | (place == F.col("least")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(place, F.xxhash64("t")))
    picked = picked.withColumn("nth", nth).where(F.col("nth") <= per_language)

    def make():
        def features(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, values = [], []
            for text in batch.column(1):
                c = ngram_counts(text.as_py())
                nonzero = np.nonzero(c)[0]
                at.append(nonzero.astype("<u2").tobytes())
                values.append(c[nonzero].astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["lang", "nth", "at", "counts"])

        return features

    sample = map_batches(picked.select("lang", "t", "nth"), make, "lang string, nth int, at binary, counts binary").collect()
    discard(counts)
    rows = [(r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4")) for r in sorted(sample, key=lambda r: (r["lang"], r["nth"]))]
    return fit(rows, idf)


def _language(m: Model | None, text: str | None) -> tuple[str, float]:
    if m is None or text is None or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    p = m.probabilities(ngram_counts(text))
    best = int(p.argmax())
    return m.languages[best], float(p[best])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) from the text alone, one for each input row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = [], []
            for value in batch.column(2):
                name, score = _language(m, value.as_py())
                names.append(name)
                scores.append(score)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return map_batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the documents that are not held out and predicts all of them.

    Every whole text is read; ``lang_pred`` is a learned label, or ``und`` with score 0 where the
    text is null or has no letter, or nothing could be learned. Ids pass through, nulls and
    repeats included; a null id is not held out; other columns are not read; equal scores go to the
    label that sorts first; an empty table gives an empty result.
    """
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The input rows, all columns, whose text gets a language; ``und`` ones go.

    Rows are judged where they are read, so nothing is shuffled and repeated rows stay repeated.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_language(held.value, x.as_py())[0] != UNDETERMINED for x in batch.column(at)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
