"""Cross-tokenizer alignment by id-striped dense count matrices.

Two tokenizers cut the same bytes; where both end a token, the bytes are cut into groups, and every token of one
side is linked to every token of the other within its group.  A text is taken apart at the single spaces between
two characters that are no white space: both tokenizers always cut there, so a segment is encoded and aligned once
per worker whatever texts it stands in, and a text's links are the sums over its segments.

The links of some thousand documents (a chunk) are packed per *stripe*: the ids of the first side modulo STRIPES.
For counting, stripes are partitions: each adds its pairs into a dense matrix of its ids by all ids of the second
side with ``np.add.at``, and the maxima of its rows are the best counts.  For scoring, counts travel to the
partitions of the links of their stripe, where both are read as a stream.  Long stripes are salted by chunk in both
steps; no task holds more than a matrix and the sums of a few chunks.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import byte_symbols
from quire.llm.common import materialise, slices_by_size, sparing, utf8

#: Partitions of the ids of the first side; a stripe's matrix has 1/STRIPES of its ids as rows.
STRIPES = 256
#: Characters and documents of a chunk.
CHUNK_CHARS, CHUNK_DOCS = 4_000_000, 4_096
#: Rows of a stripe that one task takes in; beyond, the stripe is salted.
ROWS_A_TASK = 64
#: Groups of more links are counted by their distinct ids instead of being written out.
WRITTEN_OUT = 64
#: Characters of segments that a worker remembers.
MEMORY_CHARS = 8_000_000
#: A space that both tokenizers cut before: no white space on either side.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Segments that are encoded as one text.
JOINT = 4_096

_MADE = "chunk bigint, stripe int, pairs binary, docs binary, idx int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_COUNTS = "stripe int, salt int, pairs binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; ``_unpack`` gives them back."""
    head = np.array([len(arrays), *chain.from_iterable((len(a), ord(a.dtype.char)) for a in arrays)], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).tolist()
    out, at = [], 8 + 16 * n
    for size, kind in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(raw, np.dtype(chr(kind)), size, at))
        at += out[-1].nbytes
    return out


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of weights of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))  # keys are not negative
    return keys[first], np.diff(first, append=len(keys))


class Aligner:
    """Both vocabularies, and the alignment of every segment seen so far."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        value = {s: i for i, s in enumerate(byte_symbols())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.n_a, self.n_b = max(vocab.values()) + 1, self.b.vocab_size()
        self.bytes_a = [b""] * self.n_a
        for s, i in vocab.items():
            self.bytes_a[i] = bytes(value[c] for c in s) if all(c in value for c in s) else s.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.n_b)]
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # every id with each of the marks that may follow it
        self.marked = [f"{i}{m}" for n, marks in ((self.n_a, ",|"), (self.n_b, ",;")) for m in marks for i in range(n)]
        self.high = -(-self.n_a // STRIPES)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.edged: set[str] = set()  # of these, those that can't be encoded within a longer text
        self.chars, self.shown = 0, []
        self.whole = np.zeros(0, bool)  # the bytes of both sides are those of the segment
        self.sums = np.zeros((4, 0), np.int64)  # tokens of either side, groups, links
        self.start = np.zeros(1, np.int64)  # of each segment's pairs
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, segments: list[str]) -> tuple[list[int], list[int], list[bool]]:
        """Ids of either side for segments behind a space each, one after another; of a segment that a side does not give back: none."""
        text = " ".join(segments)
        raw = utf8(f" {text}")
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
            ends = np.cumsum([len(utf8(s)) + 1 for s in segments])
            if all(np.isin(ends, np.cumsum(size[ids])).all() for ids, size in ((a, self.len_a), (b, self.len_b))):
                return a, b, [True] * len(segments)
        if len(segments) == 1:
            return [], [], [False]
        half = len(segments) // 2
        return tuple(x + y for x, y in zip(self.encode(segments[:half]), self.encode(segments[half:]), strict=True))

    def learn(self, new: list[str]) -> None:
        """Align segments and remember them; many are encoded as one text where their edges allow it."""
        edged = [s for s in new if _edged(s)]
        self.edged |= set(edged)
        new = [*(s for s in new if s not in self.edged), *edged]
        joint = len(new) - len(edged)
        ids_a, ids_b, whole = [], [], []
        for s, e in [*((i, min(i + JOINT, joint)) for i in range(0, joint, JOINT)), *((i, i + 1) for i in range(joint, len(new)))]:
            for to, part in zip((ids_a, ids_b, whole), self.encode(new[s:e]), strict=True):
                to += part
        ids_a, ids_b, whole = np.array(ids_a, np.int64), np.array(ids_b, np.int64), np.array(whole, bool)
        ends = np.cumsum(np.where(whole, [len(utf8(s)) + 1 for s in new], 0))
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        segment = np.searchsorted(ends, cuts)  # of each group
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        links = in_a * in_b
        at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b

        small = np.flatnonzero(links <= WRITTEN_OUT)
        group = np.repeat(small, links[small])
        within = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        places = [segment[group]], [ids_a[at_a[group] + within // in_b[group]] * self.n_b + ids_b[at_b[group] + within % in_b[group]]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(links > WRITTEN_OUT):
            x, m = np.unique(ids_a[at_a[g] : at_a[g] + in_a[g]], return_counts=True)
            y, n = np.unique(ids_b[at_b[g] : at_b[g] + in_b[g]], return_counts=True)
            for to, part in zip(places, (np.full(len(x) * len(y), segment[g]), (x[:, None] * self.n_b + y).ravel(), np.outer(m, n).ravel()), strict=True):
                to.append(part)
        of, pair, times = map(np.concatenate, places)
        key, times = _summed(of * (self.n_a * self.n_b) + pair, times)
        of, pair = key // (self.n_a * self.n_b), key % (self.n_a * self.n_b)

        # the ids of a group, first side first, each with the mark that follows it
        marked = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = np.arange(1, len(ids_a) + 1) == (at_a + in_a)[group_a], np.arange(1, len(ids_b) + 1) == (at_b + in_b)[group_b]
        marked[np.arange(len(ids_a)) + at_b[group_a]] = ids_a + self.n_a * last_a
        marked[np.arange(len(ids_b)) + (at_a + in_a)[group_b]] = 2 * self.n_a + ids_b + self.n_b * last_b
        sums = np.zeros((4, len(new)), np.int64)
        for total, each in zip(sums, (in_a, in_b, np.ones_like(in_a), links), strict=True):
            np.add.at(total, segment, each)
        shown, at = list(map(self.marked.__getitem__, marked.tolist())), np.cumsum(sums[0] + sums[1]).tolist()
        self.shown += ["".join(shown[s:e])[:-1] for s, e in zip([0, *at], at, strict=False)]

        self.index |= {s: i for i, s in enumerate(new, len(self.index))}
        self.chars += sum(map(len, new))
        self.whole, self.sums = np.concatenate([self.whole, whole]), np.concatenate([self.sums, sums], 1)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.bincount(of, minlength=len(new)))])
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times])

    def chunk(self, texts: pa.Array):
        """Per text (n_a, n_b, n_groups, n_links) and the groups; then distinct (stripe, id pair within it, text) with the number of links."""
        if self.chars > MEMORY_CHARS:
            self.forget()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        parts = pc.split_pattern(texts, " ")
        seg, seen = _coded(parts.flatten())
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
        edged = np.array([s in self.edged or s not in self.index and _edged(s) for s in seen], bool)[seg]
        if edged.any():  # a space beside other white space is no cut: these texts are taken apart again
            again = np.unique(doc[edged])
            kept = ~np.isin(doc, again)
            cut = [CUT.split(t) if t else [] for t in texts.take(pa.array(again)).to_pylist()]
            more = {s: i for i, s in enumerate(dict.fromkeys(chain.from_iterable(cut)), len(seen))}
            seg = np.concatenate([seg[kept], np.fromiter(chain.from_iterable(map(more.__getitem__, p) for p in cut), np.int64)])
            doc = np.concatenate([doc[kept], np.repeat(again, [len(p) for p in cut])])
            order = np.argsort(doc, kind="stable")
            seg, doc, seen = seg[order], doc[order], [*seen, *more]
            used = np.unique(seg)
            seg, seen = np.searchsorted(used, seg), [seen[i] for i in used.tolist()]
        if new := [s for s in dict.fromkeys(seen) if s not in self.index]:
            self.learn(new)
        known = [self.index[s] for s in seen]
        shown = [self.shown[i] for i in known]
        known = np.array(known, np.int64)
        void = np.zeros(len(texts), bool)
        void[doc[~self.whole[known][seg]]] = True
        seg, doc = seg[~void[doc]], doc[~void[doc]]
        at, of = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist(), seg.tolist()
        groups = [";".join(map(shown.__getitem__, of[s:e])) for s, e in zip(at, at[1:], strict=False)]
        seg = known[seg]
        sums = np.zeros((4, len(texts)), np.int64)
        for total, each in zip(sums, self.sums, strict=True):
            np.add.at(total, doc, each[seg])
        key, times = _counted(doc * max(1, len(self.index)) + seg)
        doc, seg = key // max(1, len(self.index)), key % max(1, len(self.index))
        n = self.start[seg + 1] - self.start[seg]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[seg], n)
        a, b = self.pair[at] // self.n_b, self.pair[at] % self.n_b
        own = (a % STRIPES * self.high + a // STRIPES) * self.n_b + b  # stripes one after another, pairs within
        return sums, groups, _summed(own * CHUNK_DOCS + np.repeat(doc, n), self.times[at] * np.repeat(times, n))


def _edged(segment: str) -> bool:
    """Whether white space stands at an end, or nothing at all: its space is no sure cut."""
    return not segment or segment[0].isspace() or segment[-1].isspace()


def _coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The place of each word among the distinct ones, and these."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def _blocks(aligner: Aligner, key: np.ndarray, times: np.ndarray):
    """(stripe, pairs with their numbers of documents, documents of each pair with their numbers of links)."""
    wide = aligner.high * aligner.n_b
    pair, doc = key // CHUNK_DOCS, key % CHUNK_DOCS
    bounds = np.searchsorted(pair, np.arange(STRIPES + 1) * wide).tolist()
    for stripe, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if s < e:
            first = np.flatnonzero(np.concatenate(([True], pair[s + 1 : e] != pair[s : e - 1])))
            held = np.diff(first, append=e - s)
            yield stripe, _pack(_narrow(np.diff(pair[s:e][first] - stripe * wide, prepend=0)), _narrow(held)), _pack(_narrow(doc[s:e]), _narrow(times[s:e]))


def _table(columns: dict, kinds: dict, names: list[str]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in names], names)


def _summing(wide: int, n_b: int, best: bool):
    """Sums the pairs of consecutive rows of a stripe (and salt) in a dense matrix; ``best`` marks the maxima of its rows as well."""

    def run(batches):
        block = np.zeros((wide, n_b), np.int64)
        touched, now = np.zeros(wide, bool), None

        def told():
            rows = np.flatnonzero(touched)
            part = block[rows]
            row, b = np.nonzero(part)
            count, at = part[row, b], rows[row] * n_b + b
            arrays = [np.diff(at, prepend=0), count]
            if best:
                arrays.append((count == part.max(axis=1)[row]).astype(np.uint8))
            block[rows], touched[rows] = 0, False
            row = pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([_pack(*map(_narrow, arrays))], pa.binary())], ["stripe", "salt", "pairs"])
            return row

        for b in batches:
            for stripe, salt, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and now != (stripe, salt):
                    yield told()
                now = (stripe, salt)
                step, count = _unpack(packed)[:2]
                pair = np.cumsum(step.astype(np.int64))
                np.add.at(block.reshape(-1), pair, count.astype(np.int64))
                touched[pair // n_b] = True
        if now is not None:
            yield told()

    return sparing(run)


def _scoring(batches):
    """Sums per document of a chunk, from rows in the order of salt and stripe, a stripe's counts before its links."""
    key = count = best = salt_now = None
    sums: dict[int, np.ndarray] = {}

    def told():
        for c, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([_pack(_narrow(x[0]), _narrow(x[1]))], pa.binary())], ["chunk", "sums"])
        sums.clear()

    for b in batches:
        for salt, _, chunk, pairs, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if salt != salt_now:
                yield from told()
                salt_now = salt
            if chunk is None:
                step, count, best = _unpack(pairs)
                key, count, best = np.cumsum(step.astype(np.int64)), count.astype(np.int64), best.astype(np.int64)
                continue
            step, held = _unpack(pairs)
            doc, times = _unpack(docs)
            times = times.astype(np.int64)
            at = np.repeat(np.searchsorted(key, np.cumsum(step.astype(np.int64))), held)
            x = sums.setdefault(chunk, np.zeros((2, CHUNK_DOCS), np.int64))
            np.add.at(x[0], doc, times * best[at])
            np.add.at(x[1], doc, times * count[at])
    yield from told()


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, which gets the text behind a space; ``b_path`` a
    sentencepiece model, which adds that space itself.  A text that is null or empty, or that either side does not
    give back byte by byte, has no tokens: zeros and ''.  Repeated rows are documents of their own in every count, a
    null doc_id keeps its row, other columns are not read, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        aligner = _aligner(a_path, b_path)
        made, part = 0, TaskContext.get().partitionId()
        schema = {"chunk": pa.int64(), "stripe": pa.int32(), "pairs": pa.binary(), "docs": pa.binary(), "idx": pa.int32(), "groups_sha256": pa.string()} | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64())
        for batch in batches:
            schema["doc_id"] = batch.schema.field(0).type
            names = ["doc_id", *(x.split()[0] for x in _MADE.split(", "))]
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for s, e in slices_by_size([max(n, CHUNK_CHARS // CHUNK_DOCS + 1) for n in sizes], CHUNK_CHARS):
                sums, groups, links = aligner.chunk(batch.column(1).slice(s, e - s))
                chunk, made = part << 32 | made, made + 1
                told = dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True))
                hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield _table(told | {"doc_id": batch.column(0).slice(s, e - s), "chunk": [chunk] * (e - s), "idx": range(e - s), "groups_sha256": hashes}, schema, names)
                blocks = list(_blocks(aligner, *links))
                for at in range(0, len(blocks), 64):
                    stripe, pairs, held = zip(*blocks[at : at + 64], strict=True)
                    yield _table({"chunk": [chunk] * len(stripe), "stripe": stripe, "pairs": pairs, "docs": held}, schema, names)

    made = materialise(docs.select("doc_id", "text").mapInArrow(sparing(run), f"doc_id {kind}, {_MADE}"), "token-links")
    links = made.where("stripe is not null")
    salts = max(1, math.ceil(links.count() / (STRIPES * ROWS_A_TASK)))
    sizes = _vocabulary(a_path, b_path)
    high = -(-sizes[0] // STRIPES)

    def summed(rows: DataFrame, best: bool) -> DataFrame:
        return rows.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").mapInArrow(_summing(high, sizes[1], best), _COUNTS)

    links = links.withColumn("salt", (F.col("chunk") % salts).cast("int"))
    counts = links.select("stripe", "salt", "pairs")
    if salts > 1:
        counts = summed(counts, False)
    counts = materialise(summed(counts.withColumn("salt", F.lit(0)), True), "token-counts")
    everywhere = counts.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "stripe", F.lit(None).cast("bigint").alias("chunk"), "pairs", F.lit(None).cast("binary").alias("docs"))
    both = everywhere.unionByName(links.select("salt", "stripe", "chunk", "pairs", "docs")).repartition("stripe", "salt")
    scores = both.sortWithinPartitions("salt", "stripe", F.col("chunk").asc_nulls_first()).mapInArrow(sparing(_scoring), "chunk bigint, sums binary")
    rows = made.where("stripe is null").select("chunk", "doc_id", "idx", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        x = np.zeros((2, CHUNK_DOCS), np.int64)
        for packed in right.column("sums").to_pylist():
            for total, part in zip(x, _unpack(packed), strict=True):
                total += part
        idx = left.column("idx").to_numpy()
        return left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(x[0][idx])).append_column("count_sum", pa.array(x[1][idx])).append_column("groups_sha256", left.column("groups_sha256"))

    out = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return rows.groupBy("chunk").cogroup(scores.groupBy("chunk")).applyInArrow(joined, out)


def _vocabulary(a_path: str, b_path: str) -> tuple[int, int]:
    """Numbers of ids of both sides."""
    import sentencepiece
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(a_path).get_vocab(with_added_tokens=True).values()) + 1, sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
