"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` consecutive words, over its whole text.  Each passage is encoded by
the mean of learned vectors of its words (hashed into buckets), by surface statistics, and by a learned layer over both;
gated attention (tanh times sigmoid, softmax over the bag) weighs the passages, and the weighted sum is scored.  All
weights, the words' vectors and the attention's included, are learned from document labels alone, on a bounded sample of
labelled rows; scoring streams over all rows and all passages.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import give_back, slices_by_size, sparing, utf8

PASSAGE_WORDS = 64
#: Documented bounds of the training sample: this many labelled rows at most, those with the smallest hashes of doc_id, and
#: of each so many passages, spread evenly over its text.
TRAIN_ROWS, TRAIN_PASSAGES = 4_000, 64
#: Buckets of words and the size of their vectors; of the layer over a passage and of the attention.
BUCKETS, EMBEDDED, HIDDEN, ATTENTION = 4_096, 8, 16, 8
EPOCHS, BATCHES, RATE, DECAY = 50, 8, 0.02, 1e-4
SLICE_BYTES = 2_000_000

_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _BANG, _HIGH = range(8)
_CLASS = np.full(256, 8, np.uint8)
for _kind, _bytes in ((_SPACE, b" \t\n\x0b\x0c\r"), (_UPPER, bytes(range(65, 91))), (_LOWER, bytes(range(97, 123))), (_DIGIT, bytes(range(48, 58))), (_SYMBOL, b"#*$%&|<>"), (_STOP, b".,;:'\"?()-"), (_BANG, b"!"), (_HIGH, bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _kind
FEATURES = 12


class Bags(NamedTuple):
    """Passages of documents, one after the other: surface statistics, the buckets of their words, how many words, and how many passages a document has."""

    x: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    bags: np.ndarray

    def of(self, documents: np.ndarray) -> Bags:
        """The bags of these documents, in their order."""
        first = np.cumsum(self.bags) - self.bags
        rows = np.concatenate([np.arange(first[d], first[d] + self.bags[d]) for d in documents])
        at = np.cumsum(self.sizes) - self.sizes
        words = np.concatenate([self.words[at[r] : at[r] + self.sizes[r]] for r in rows])
        return Bags(self.x[rows], words, self.sizes[rows], self.bags[documents])


def passages(texts: list[bytes]) -> Bags:
    """All passages of the texts, one at least of each."""
    codes: dict[bytes, int] = {}
    words = [[codes.setdefault(w, len(codes)) for w in t.split()] for t in texts]
    n_words = np.array([len(w) for w in words])
    bags = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    out = np.zeros((bags.sum(), FEATURES))
    total = int(n_words.sum())
    sizes = np.zeros(len(out), np.int64)
    if not total:
        return Bags(out, np.zeros(0, np.int64), sizes, bags)
    first_bag = np.concatenate([[0], np.cumsum(bags)[:-1]])
    doc = np.repeat(np.arange(len(texts)), n_words)
    within = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(n_words)[:-1]]), n_words)
    bag = first_bag[doc] + within // PASSAGE_WORDS
    data = np.frombuffer(b" " + b" ".join(texts), np.uint8)
    kind = _CLASS[data]
    solid = kind != _SPACE
    start = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1  # of each word
    opens = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
    own = bag[opens]  # the passages with words
    size = np.diff(np.append(opens, total))
    counts = np.zeros((len(own), 9))
    for k in range(1, 9):
        # a passage's bytes reach to the next one's first word; the white space between counts for nothing
        counts[:, k] = np.add.reduceat((kind == k).astype(np.int32), start[opens])
    letters = counts[:, 1] + counts[:, 2] + counts[:, 7]
    chars = counts[:, 1:].sum(1)
    code = np.fromiter((c for w in words for c in w), np.int64, total)
    same = np.zeros(total)
    same[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    pair = np.sort(bag * len(codes) + code)
    distinct = np.bincount(pair[np.concatenate([[True], pair[1:] != pair[:-1]])] // len(codes), minlength=len(out))[own]
    out[own] = np.column_stack(
        [
            counts[:, _UPPER] / np.maximum(letters, 1),
            counts[:, _DIGIT] / chars,
            counts[:, _SYMBOL] / chars,
            counts[:, _STOP] / chars,
            counts[:, _BANG] / chars,
            counts[:, _HIGH] / chars,
            counts[:, 8] / chars,
            chars / size / 10,
            distinct / size,
            np.add.reduceat(same, opens) / size,
            np.log1p(size) / np.log1p(PASSAGE_WORDS),
            np.minimum(1, 20 * counts[:, _SYMBOL] / chars),
        ]
    )
    sizes[own] = size
    bucket = np.fromiter((zlib.crc32(w.lower()) % BUCKETS for w in codes), np.int64, len(codes))
    return Bags(out, bucket[code], sizes, bags)


class GatedAttention:
    """Encoder, gated attention and scorer over bags of passages."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {
            "E": r.normal(0, 0.1, (BUCKETS, EMBEDDED)), "W": r.normal(0, 0.4, (FEATURES + EMBEDDED, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": r.normal(0, 0.4, (HIDDEN, ATTENTION)), "U": r.normal(0, 0.4, (HIDDEN, ATTENTION)), "w": r.normal(0, 0.4, ATTENTION),
            "c": r.normal(0, 0.4, HIDDEN), "d": np.zeros(1),
        }

    def forward(self, data: Bags) -> dict:
        p, starts = self.p, np.cumsum(data.bags) - data.bags
        of = np.repeat(np.arange(len(data.bags)), data.bags)
        mean = np.zeros((len(data.x), EMBEDDED))
        filled = np.flatnonzero(data.sizes)
        if len(filled):
            at = (np.cumsum(data.sizes) - data.sizes)[filled]
            mean[filled] = np.add.reduceat(p["E"][data.words], at, axis=0) / data.sizes[filled, None]
        x = np.concatenate([(data.x - self.mean) / self.scale, mean], axis=1)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "y": y, "of": of, "starts": starts}

    def score(self, data: Bags) -> np.ndarray:
        return self.forward(data)["y"]

    def attention(self, data: Bags) -> np.ndarray:
        """The weight of each passage within its document."""
        return self.forward(data)["a"]

    def gradients(self, data: Bags, label: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the mean log loss."""
        f, p = self.forward(data), self.p
        of, starts = f["of"], f["starts"]
        dy = (f["y"] - label) / len(label)
        g = {"c": f["z"].T @ dy, "d": np.array([dy.sum()])}
        dz = np.outer(dy, p["c"])[of]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[of])
        g["w"] = (f["v"] * f["u"]).T @ de
        gate = np.outer(de, p["w"])
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["b"] = f["x"].T @ dh, dh.sum(0)
        # each word of a passage has an equal part in its mean
        per_word = (dh @ p["W"].T)[:, FEATURES:] / np.maximum(data.sizes, 1)[:, None]
        passage = np.repeat(np.arange(len(data.x)), data.sizes)
        g["E"] = np.stack([np.bincount(data.words, weights=per_word[passage, k], minlength=BUCKETS) for k in range(EMBEDDED)], axis=1)
        return g

    def fit(self, data: Bags, label: np.ndarray, seed: int = 3) -> GatedAttention:
        """Adam on the mean log loss over fixed batches of documents, with a small weight decay."""
        self.mean, self.scale = data.x.mean(0), data.x.std(0) + 1e-3
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        dealt = np.array_split(np.random.default_rng(seed).permutation(len(label)), min(BATCHES, len(label)))
        batches, t = [(data.of(d), label[d]) for d in dealt], 0
        for _ in range(EPOCHS):
            for part, wanted in batches:
                t += 1
                for k, g in self.gradients(part, wanted).items():
                    grad = g + DECAY * self.p[k]
                    m[k], s[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * s[k] + 0.001 * grad**2
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> GatedAttention | float:
    """A model, or a constant where the sample has no two classes (0.5 without any label).

    labels has (doc_id, quality); rows with a null are dropped, of repeated ids the smallest label counts.
    """
    few = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def run(batches):
        for b in batches:
            texts = [utf8(t) for t in b.column(0).to_pylist()]
            quality = b.column(1).to_pylist()
            for s, e in slices_by_size([len(t) for t in texts], SLICE_BYTES):
                data = passages(texts[s:e])
                rows, first, at = [], np.cumsum(data.bags) - data.bags, np.cumsum(data.sizes) - data.sizes
                for d, n in enumerate(data.bags):
                    own = first[d] + np.unique(np.linspace(0, n - 1, min(n, TRAIN_PASSAGES)).astype(np.int64))
                    words = np.concatenate([data.words[at[k] : at[k] + data.sizes[k]] for k in own])
                    rows.append((data.x[own].astype("<f4").tobytes(), words.astype("<u2").tobytes(), data.sizes[own].astype("<u2").tobytes()))
                yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.binary()) for k in range(3)], pa.array([int(q) for q in quality[s:e]], pa.int32())], ["x", "words", "sizes", "quality"])

    # at most train_rows ids and labels are broadcast, and as many rows of TRAIN_PASSAGES passages come back
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "quality").mapInArrow(sparing(run), "x binary, words binary, sizes binary, quality int").collect()
    found = sorted({(bytes(r.x), bytes(r.words), bytes(r.sizes), r.quality) for r in found})  # the fit doesn't depend on the order of rows
    y = np.array([r[3] for r in found], float)
    if len(set(y.tolist())) < 2:
        return 0.5 if not len(y) else float((y.sum() + 0.5) / (len(y) + 1))
    sizes = [np.frombuffer(r[2], "<u2").astype(np.int64) for r in found]
    x = np.concatenate([np.frombuffer(r[0], "<f4").reshape(-1, FEATURES) for r in found]).astype(float)
    words = np.concatenate([np.frombuffer(r[1], "<u2") for r in found]).astype(np.int64)
    return GatedAttention().fit(Bags(x, words, np.concatenate(sizes), np.array([len(n) for n in sizes])), y)


def score(docs: DataFrame, model: GatedAttention | float, name: str = "quality_score") -> DataFrame:
    """docs with a column ``name`` (0 to 1); every row is scored over its whole text.

    A null text scores as the empty one; repeated rows get equal scores; a column of that name is replaced.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("double")
    def of(texts):
        import pandas as pd

        if isinstance(model, float):
            return pd.Series([model] * len(texts), dtype="float64")
        held = texts.tolist()
        parts = [model.score(passages([utf8(t) for t in held[s:e]])) for s, e in slices_by_size([len(t or "") for t in held], SLICE_BYTES)]
        del held
        give_back()
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.withColumn(name, of(F.col("text")))


def training_labels(labels: DataFrame, folds: int = 5) -> DataFrame:
    """Labels of rows that may be learned from: crc32 of the id's text modulo ``folds`` is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0).select("doc_id", "quality")
