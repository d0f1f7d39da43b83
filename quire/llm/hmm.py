"""Hidden Markov language model: Baum-Welch over all training texts, exact scaled forward scores.

Tokens are coded once, in blocks of neighbouring rows; a block lists each of its words once, so what is
shuffled to count the corpus is a row per block and word, not per token.  The model emits a word class (a
hash of the word, ``CLASSES`` of them, and one for the end) from its latent state, and the word from its
class by smoothed corpus counts, so its parameters are bounded while its counts grow with the corpus.

A text is cut into chunks of ``CHUNK`` tokens.  The product of a chunk's transfer matrices carries the
scaled forward and backward vectors over it exactly, so all chunks of a block advance together whatever
the lengths of their texts, and the whole of a very long text is read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lower_words, materialise

STATES, CLASSES, CHUNK, ROUNDS = 4, 2048, 32, 4
#: Characters of text in a block; bounds what a task holds at once (a longer text is a block of its own).
BLOCK_CHARS = 8_000_000
SMOOTH = 0.1
FOLDS = 10


def word_class(word: bytes, classes: int = CLASSES) -> int:
    """The class of a word; the end (no bytes) has the last class to itself."""
    return zlib.crc32(word) % classes if word else classes


def learns(doc_id, folds: int = FOLDS) -> bool:
    """Whether the model learns from this row; a null id is held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds != 0


def encode_blocks(docs: DataFrame, classes: int = CLASSES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of (block, doc_ids, learn, sizes, codes, words, counts, kinds); code 0 is the end, one after each text."""

    def block_of(name, ids, texts):
        code: dict[bytes, int] = {b"": 0}
        streams = []
        for t in texts:
            own = [code.setdefault(w, len(code)) for w in lower_words(t)]
            own.append(0)
            streams.append(np.array(own, np.int32))
        learn = [learns(i) for i in ids]
        codes = np.concatenate(streams)
        mine = np.repeat(np.array(learn), [len(x) for x in streams])
        counts = np.bincount(codes[mine], minlength=len(code))
        return {"block": name, "doc_ids": ids, "learn": learn, "sizes": [len(x) for x in streams], "codes": zlib.compress(codes.tobytes(), 1), "words": [w.decode("utf-8", "surrogatepass") for w in code], "counts": counts.tolist(), "kinds": [word_class(w, classes) for w in code]}

    def run(batches):
        part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and size + len(t or "") > block_chars:
                    yield pa.RecordBatch.from_pylist([block_of(f"{part}-{n}", ids, texts)], schema=schema)
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield pa.RecordBatch.from_pylist([block_of(f"{part}-{n}", ids, texts)], schema=schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    of = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(of)), ("learn", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int16()))])
    return docs.select("doc_id", "text").mapInArrow(run, f"block string, doc_ids array<{kind}>, learn array<boolean>, sizes array<int>, codes binary, words array<string>, counts array<bigint>, kinds array<smallint>")


@dataclass
class Model:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes + 1, states)

    @classmethod
    def fresh(cls, share: np.ndarray, states: int, seed: int = 3) -> Model:
        """Sticky states whose emissions are the corpus's shares of the classes, perturbed."""
        r = np.random.default_rng(seed)
        emit = (share[:, None] + 1e-9) * np.exp(r.normal(0, 0.5, (len(share), states)))
        move = np.full((states, states), 0.02 / max(states - 1, 1)) if states > 1 else np.ones((1, 1))
        if states > 1:
            np.fill_diagonal(move, 0.98)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))


class Chunks:
    """The chunks of some texts, longest first, with what a pass over them needs."""

    def __init__(self, sizes: np.ndarray, chunk: int = CHUNK):
        self.per_doc = -(-sizes // chunk)
        n = int(self.per_doc.sum())
        self.doc = np.repeat(np.arange(len(sizes)), self.per_doc)
        self.nth = np.arange(n) - np.repeat(np.cumsum(self.per_doc) - self.per_doc, self.per_doc)
        at = np.repeat(np.cumsum(sizes) - sizes, self.per_doc) + self.nth * chunk
        size = np.minimum(chunk, np.repeat(sizes, self.per_doc) - self.nth * chunk)
        self.order = np.argsort(-size, kind="stable")
        self.at, self.size = at[self.order], size[self.order]
        self.place = np.empty(n, np.int64)  # of each chunk, in text order, among the ordered ones
        self.place[self.order] = np.arange(n)
        self.first = np.cumsum(self.per_doc) - self.per_doc
        self.active = [int(np.searchsorted(-self.size, -j, side="left")) for j in range(chunk)]  # those longer than j


def transfer(model: Model, obs: np.ndarray, c: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk the product of diag(emission) * move over its tokens, scaled, and the log of the scale."""
    k, n = len(model.start), len(c.at)
    m, log = np.repeat(np.eye(k)[None], n, 0), np.zeros(n)
    for j, a in enumerate(c.active):
        if not a:
            break
        x = m[:a] * model.emit[obs[c.at[:a] + j]][:, None, :]
        m[:a] = (x.reshape(-1, k) @ model.move).reshape(-1, k, k)
        if j % 8 == 7 or j == len(c.active) - 1:
            top = m.max((1, 2))
            m /= top[:, None, None]
            log += np.log(top)
    return m, log


def forward(model: Model, m: np.ndarray, log: np.ndarray, c: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """State distributions before each chunk (text order of chunks) and the log likelihood of each text."""
    k, docs = len(model.start), len(c.per_doc)
    before, like = np.empty((len(c.doc), k)), np.zeros(docs)
    rank = np.argsort(-c.per_doc, kind="stable")
    q = np.repeat(model.start[None], docs, 0)
    for j in range(int(c.per_doc.max(initial=0))):
        live = rank[: int(np.searchsorted(-c.per_doc[rank], -j, side="left"))]
        at = c.first[live] + j
        before[at] = q[live]
        nxt = np.einsum("nk,nkl->nl", q[live], m[c.place[at]])
        total = nxt.sum(1)
        q[live] = nxt / total[:, None]
        like[live] += np.log(total) + log[c.place[at]]
    return before, like


def expectations(model: Model, obs: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Baum-Welch counts of some texts: starts, moves, emissions and the log likelihood."""
    c = Chunks(sizes)
    k = len(model.start)
    m, log = transfer(model, obs, c)
    before, like = forward(model, m, log, c)
    after = np.ones((len(c.doc), k))
    rank = np.argsort(-c.per_doc, kind="stable")
    for j in range(int(c.per_doc.max(initial=0)) - 1, 0, -1):  # what follows chunk j - 1
        live = rank[: int(np.searchsorted(-c.per_doc[rank], -j, side="left"))]
        at = c.first[live] + j
        b = np.einsum("nkl,nl->nk", m[c.place[at]], after[at])
        after[at - 1] = b / b.sum(1, keepdims=True)
    del m
    q = before[c.order]
    seen = np.empty((len(c.active), len(q), k))
    for j, a in enumerate(c.active):
        seen[j, :a] = q[:a]
        x = q[:a] * model.emit[obs[c.at[:a] + j]]
        x = x @ model.move
        q[:a] = x / x.sum(1, keepdims=True)
    r = after[c.order]
    gamma, moves = np.empty((len(obs), k)), np.zeros((k, k))
    last = np.zeros(len(obs), bool)
    last[np.cumsum(sizes) - 1] = True
    for j in range(len(c.active) - 1, -1, -1):
        a = c.active[j]
        if not a:
            continue
        t = c.at[:a] + j
        b = model.emit[obs[t]]
        ahead = r[:a] @ model.move.T
        u = seen[j, :a] * b
        g = u * ahead
        norm = g.sum(1, keepdims=True)
        gamma[t] = g / norm
        go = ~last[t]
        moves += (u[go] / norm[go]).T @ r[:a][go]
        back = b * ahead
        r[:a] = back / back.sum(1, keepdims=True)
    emits = np.stack([np.bincount(obs, gamma[:, s], minlength=len(model.emit)) for s in range(k)], 1)
    return {"start": gamma[np.cumsum(sizes) - sizes].sum(0), "move": moves * model.move, "emit": emits, "like": np.array([like.sum()])}


def _decoded(row_codes: bytes, kinds) -> np.ndarray:
    return np.asarray(kinds, np.int64)[np.frombuffer(zlib.decompress(row_codes), np.int32)]


def _texts(flags, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens belong to the flagged texts, and the sizes of those."""
    sizes, flags = np.asarray(sizes, np.int64), np.asarray(flags, bool)
    return np.repeat(flags, sizes), sizes[flags], flags


def reestimate(model: Model, blocks: DataFrame) -> tuple[Model, float]:
    """One round of Baum-Welch: counts of every block's training texts, summed over the partitions."""
    shapes = {"start": model.start.shape, "move": model.move.shape, "emit": model.emit.shape, "like": (1,)}

    def run(batches):
        total = {k: np.zeros(s) for k, s in shapes.items()}
        for b in batches:
            for codes, kinds, learn, sizes in zip(*b.columns, strict=True):
                mine, own, flags = _texts(learn.as_py(), sizes.as_py())
                if flags.any():
                    for k, v in expectations(model, _decoded(codes.as_py(), kinds.values.to_numpy())[mine], own).items():
                        total[k] += v
        flat = np.concatenate([total[k].ravel() for k in shapes])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    size = sum(int(np.prod(s)) for s in shapes.values())
    flat = np.zeros(size)
    for r in blocks.select("codes", "kinds", "learn", "sizes").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many rows as parameters
        flat[r.i] = r.v
    got, at = {}, 0
    for k, s in shapes.items():
        got[k] = flat[at : at + int(np.prod(s))].reshape(s)
        at += int(np.prod(s))
    prior = got["emit"].sum(1, keepdims=True)
    emit = got["emit"] + 5 * (prior + 1e-6) / max(prior.sum() + 1e-6 * len(prior), 1e-6)
    start, move = got["start"] + 0.5, got["move"] + 0.5
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), float(got["like"][0])


@dataclass
class Corpus:
    blocks: DataFrame
    words: DataFrame  # (word, c)
    tokens: int
    distinct: int
    mass: np.ndarray  # log-ready denominators of p(word | class), by class
    share: np.ndarray


def count_corpus(docs: DataFrame, classes: int = CLASSES, block_chars: int = BLOCK_CHARS) -> Corpus:
    """Blocks and the exact counts of all training tokens."""
    blocks = materialise(encode_blocks(docs, classes, block_chars), "blocks")
    each = blocks.select(F.explode(F.arrays_zip("words", "counts", "kinds")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("c"), F.col("x.kinds").alias("kind")).where("c > 0")
    words = materialise(each.groupBy("word").agg(F.sum("c").alias("c"), F.first("kind").alias("kind")), "words")
    c, v = np.zeros(classes + 1), np.zeros(classes + 1)
    for r in words.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # a row per class
        c[r.kind], v[r.kind] = r.c, r.v
    mass = c + SMOOTH * (v + 1)
    mass[classes] = c[classes] + SMOOTH  # the end is its class's only word
    return Corpus(blocks, words.select("word", "c"), int(c.sum()), int(v.sum()), mass, c / max(c.sum(), 1))


def train(corpus: Corpus, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    model, told = Model.fresh(corpus.share, states), []
    for _ in range(rounds if corpus.tokens else 0):
        model, like = reestimate(model, corpus.blocks)
        told.append(like)
    return model, told


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, classes: int = CLASSES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    A null or wordless text is its end alone.  Repeated rows are learned from and scored each; a null doc_id
    is held out; without any training row the corpus counts are 0 and the model stays at its start.
    Scores are base-10 logarithms.  An empty table gives an empty one.
    """
    corpus = count_corpus(docs, classes, block_chars)
    model, _ = train(corpus, states, rounds)
    spread = corpus.blocks.select("block", F.posexplode("words").alias("at", "word"))
    known = spread.join(corpus.words, "word").groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c"))  # a block is bounded
    joined = corpus.blocks.select("block", "doc_ids", "learn", "sizes", "codes", "kinds").join(known, "block", "left").drop("block")
    tokens, mass = corpus.tokens, corpus.mass
    under = np.log10(tokens + SMOOTH * (corpus.distinct + 1))

    def run(batches):
        for b in batches:
            for ids, learn, sizes, codes, kinds, at, c in zip(*b.columns, strict=True):
                code = np.frombuffer(zlib.decompress(codes.as_py()), np.int32)
                kind = kinds.values.to_numpy().astype(np.int64)
                count = np.zeros(len(kind))
                if at.is_valid:
                    count[at.values.to_numpy()] = c.values.to_numpy()
                sizes = sizes.values.to_numpy().astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                base = np.add.reduceat((np.log10(count + SMOOTH) - under)[code], starts)
                in_class = np.add.reduceat((np.log10(count + SMOOTH) - np.log10(mass[kind]))[code], starts)
                chunks = Chunks(sizes)
                _, like = forward(model, *transfer(model, kind[code], chunks), chunks)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array([not x for x in learn.as_py()]), pa.array(sizes), pa.array(np.add.reduceat((count > 0)[code].astype(np.int64), starts)), pa.array([tokens] * len(sizes), pa.int64()), pa.array(base), pa.array(like / np.log(10) + in_class)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
