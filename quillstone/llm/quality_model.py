"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: every word, the
word's character n-grams and pairs of adjacent words, all hashed into one table
of fixed size; a pair of equal words shares one feature. A softmax over two
classes reads the mean. Numpy stochastic gradient descent fits both on a bounded
sample of labelled rows.

The mean is linear in the vectors, so scoring folds the output weights into the
table: a feature is worth one number and a word the sum of its features'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import modest_batches, rows_of

#: Features fixed by the model; the table has ``1 << BITS`` rows.
BITS, GRAMS = 17, (3, 4, 5)
SIZE = 1 << BITS
SAME = SIZE - 1
_PAIR = np.uint64(0x9E3779B97F4A7C15)


#: Windows of characters hashed at once.
WINDOWS = 1 << 18


def grams_of(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Table rows of the words' character n-grams, each with its word's place. Characters are code points; a word has a mark at either end."""
    texts = [f"<{w.decode()}>" for w in words]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    for n in GRAMS:
        for at in range(0, len(points) - n + 1, WINDOWS):
            end = min(at + WINDOWS, len(points) - n + 1)
            inside = np.flatnonzero(owner[at:end] == owner[at + n - 1 : end + n - 1]) + at
            key = np.zeros(len(inside), np.uint64)
            for i in range(n):
                key = (key + points[inside + i] + np.uint64(1)) * _PAIR
            key ^= key >> np.uint64(32)
            yield (key * _PAIR % np.uint64(SIZE - 1)).astype(np.int64), owner[inside]


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_rows(hashes: np.ndarray) -> np.ndarray:
    """Table rows of whole words, given their hashes."""
    return (hashes % np.uint64(SIZE - 1)).astype(np.int64)


class Words:
    """What each word met so far is worth, its number of features and its hash; starts anew beyond ``most`` words."""

    def __init__(self, worth: np.ndarray, most: int = 1 << 17):
        self.worth, self.most = worth, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.total, self.features, self.hashes = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.number))
        if len(self.number) + len(new) > self.most and self.number:
            self.clear()
            new = list(set(words))
        size = len(self.number) + len(new)
        if size > len(self.total):
            for name in ("total", "features", "hashes"):
                setattr(self, name, np.resize(getattr(self, name), 2 * size))
        if new:
            hashes = hashes_of(new)
            total, features = self.worth[word_rows(hashes)].astype(np.float64), np.ones(len(new), np.int64)
            for rows, owner in grams_of(new):
                total += np.bincount(owner, self.worth[rows], len(new))
                features += np.bincount(owner, minlength=len(new))
            at = len(self.number)
            self.number.update(zip(new, range(at, size), strict=True))
            self.total[at:size], self.features[at:size], self.hashes[at:size] = total, features, hashes
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Table rows of adjacent words, given the words' hashes."""
    a, b = hashes[:-1], hashes[1:]
    rows = ((a * _PAIR + b) * _PAIR >> np.uint64(64 - BITS)).astype(np.int64)
    rows[rows == SAME] = 0
    rows[a == b] = SAME
    return rows


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of the whole text and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    distinct, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
    hashes = hashes_of(distinct)
    parts, weights = [word_rows(hashes)], [times]
    for rows, owner in grams_of(distinct):
        parts.append(rows)
        weights.append(times[owner])
    place = dict(zip(distinct, range(len(distinct)), strict=True))
    pairs = pair_features(hashes[np.fromiter(map(place.__getitem__, words), np.int64, len(words))])
    parts.append(pairs)
    weights.append(np.ones(len(pairs), np.int64))
    rows, at = np.unique(np.concatenate(parts), return_inverse=True)
    return rows, np.bincount(at, np.concatenate(weights)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """worth: each table row's share in the log-odds of label 1; bias: the log-odds of a text without words."""

    worth: np.ndarray
    bias: float


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], dims: int = 10, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent over (rows, counts, label), the step falling linearly to zero.

    Without samples of both labels the model always gives the share of label 1,
    a half without any.
    """
    labels = [y for *_, y in samples]
    if len(set(labels)) < 2:
        share = float(np.clip(labels[0], 0.001, 0.999)) if labels else 0.5
        return Model(np.zeros(SIZE, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dims, 1 / dims, (SIZE, dims))
    out = np.zeros((dims, 2))
    prior = sum(labels) / len(labels)
    offset = np.array([0.0, np.log(prior / (1 - prior))])
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            rows, counts, label = samples[k]
            if not len(rows):
                done += 1
                continue
            share = counts / counts.sum()
            vectors = table[rows]
            mean = share @ vectors
            z = mean @ out + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            error = -p
            error[label] += 1
            step = rate * (1 - done / steps)
            back = out @ error
            out += step * np.outer(mean, error)
            table[rows] = vectors + step * len(rows) ** 0.5 * share[:, None] * back
            done += 1
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(offset[1] - offset[0]))


def fit_rows(labelled: DataFrame, most_rows: int) -> Model:
    """Fit on at most ``most_rows`` labelled rows, those of the smallest hash of id and text, in one task.

    ``labelled`` has id, body and label. The task holds the features of so many
    rows at most; the driver receives the folded table alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for text, label in rows_of(batches, "body", "label"):
            rows, counts = document_features(text)
            samples.append((rows.astype(np.int32), counts.astype(np.int32), label))
        model = fit(samples)
        yield pa.RecordBatch.from_arrays([pa.array([model.worth.tobytes()], pa.binary()), pa.array([model.bias])], names=["worth", "bias"])

    picked = labelled.orderBy(F.xxhash64("id", "body"), "id").limit(most_rows).select("body", "label").coalesce(1)
    found = picked.mapInArrow(run, "worth binary, bias double").collect()
    return Model(np.frombuffer(found[0].worth, np.float32), found[0].bias) if found else fit([])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most_rows: int = 2500) -> Model:
    """Fit on at most ``most_rows`` rows of ``docs`` that have a label of 0 or 1.

    A document with several labels counts once for each distinct one; repeated
    rows count once for each label. Null texts are empty, and null ids and labels
    are left out, as are labels besides 0 and 1. Which rows are taken goes by a
    hash of the id, ties by id and label. Texts are read whole. Without rows or
    labels the model scores a half; further columns are ignored.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("bigint").alias("label")).filter(F.col("label").isin(0, 1)).distinct()
    # ids alone choose the rows, so that only the chosen texts move
    chosen = docs.select(F.col(id_column).alias("id")).join(known, "id").distinct()
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(most_rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("body")).join(F.broadcast(chosen), "id")
    return fit_rows(texts, most_rows)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None, score_column: str = "score") -> DataFrame:
    """Per row: id (or the columns in ``keep``) and the score, the probability of label 1.

    Null and empty texts get the score of the labels' prior; very long texts are
    read whole; repeated rows are scored alike; an empty table gives no rows.
    Columns that are not in ``keep`` are ignored.
    """
    modest_batches(docs.sparkSession)
    names = keep or [id_column]
    shared = docs.sparkSession.sparkContext.broadcast((model.worth, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth, bias = shared.value
        known = Words(worth)
        for batch in batches:
            scores = np.empty(batch.num_rows)
            texts = batch.column(0).field(text_column) if has_text else batch.column(1)
            bodies = pa.RecordBatch.from_arrays([texts], names=["body"])
            for i, (text,) in enumerate(rows_of(iter([bodies]), "body")):
                at = known.of(text.split())
                odds = bias
                if len(at):
                    total = known.total[at].sum() + worth[pair_features(known.hashes[at])].sum(dtype=np.float64)
                    odds += total / (known.features[at].sum() + len(at) - 1)
                scores[i] = 1 / (1 + np.exp(-odds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["kept", "score"])

    # the text goes to Python once
    has_text = text_column in names
    picked = docs.select(F.struct(*names).alias("kept"), *([] if has_text else [F.col(text_column).alias("body")]))
    scored = picked.mapInArrow(run, picked.select("kept").schema.add("score", "double"))
    return scored.select("kept.*", F.col("score").alias(score_column))
