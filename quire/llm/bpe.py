"""Byte-level BPE encoding and decoding with a pair occurrence index.

Many distinct pieces are laid out side by side in one array.  An index maps every
adjacent pair that has a merge rank to *all* its positions; the active ranks are taken
in ascending order from a heap, each merges all its live positions at once, and the lists
of the pairs that arise beside a merge are extended.  As pieces are separated by a symbol
that no pair contains, one run encodes the whole partition's new pieces together.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quire.llm.common import slices_by_size, sparing

#: The piece pattern of byte-level vocabularies of this family (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text handled at once in a Python worker.
SLICE_CHARS = 500_000
#: Pieces remembered in a Python worker: twice so many at most, of those that came in two slices.
MEMORY_PIECES = 150_000
#: Marks, a byte each, of pieces that have come in one slice.
MARKS = 1 << 22


def byte_symbols() -> list[str]:
    """The printable character standing for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        value = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[(vocab[a], vocab[b])] = (i, vocab[a + b])
        self.bytes = {i: bytes(value[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.text = {i: str(i) for i in self.bytes}
        # longest first, so that of two special strings at a place the longer one is taken
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.marks, self.marked = bytearray(MARKS), 0

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each piece, all pieces merged in one pass over the ranks."""
        rank, first = self.rank, self.first
        tok: list[int] = []
        starts = []
        for p in pieces:
            starts.append(len(tok))
            tok += map(first.__getitem__, p)
            tok.append(-1)  # no pair holds it: nothing merges across pieces
        n = len(tok)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        spots: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(tok, tok[1:], strict=False)):
            if pair in spots:
                spots[pair].append(i)
            elif pair in rank:
                spots[pair] = [i]
        active = [(rank[pair][0], pair) for pair in spots]
        heapify(active)
        while active:
            _, pair = heappop(active)
            a, b = pair
            made = rank[pair][1]
            places = spots.pop(pair)
            places.sort()
            for i in places:
                if tok[i] != a:
                    continue
                j = right[i]
                if tok[j] != b:
                    continue
                k = right[j]
                tok[i], tok[j] = made, -2
                right[i] = k
                left[k] = i
                h = left[i]
                if h >= 0:
                    new = (tok[h], made)
                    if new in spots:
                        spots[new].append(h)
                    elif new in rank:
                        spots[new] = [h]
                        heappush(active, (rank[new][0], new))
                new = (made, tok[k])
                if new in spots:
                    spots[new].append(i)
                elif new in rank:
                    spots[new] = [i]
                    heappush(active, (rank[new][0], new))
        out = []
        for s, p in zip(starts, pieces, strict=True):
            out.append(tuple([t for t in tok[s : s + len(p)] if t >= 0]))
        return out

    def split(self, text: str) -> list[str]:
        """Pieces of a text; a special string is a piece of its own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        return list(chain.from_iterable([part] if part in self.special else self.pieces.findall(part) for part in self.cut.split(text)))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        known, older = self.known, self.older
        new = []
        for p in set(chain.from_iterable(split)):
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        for p, ids in zip(new, self.merge_all([p.encode("utf-8") for p in new]), strict=True):
            known[p] = ids
        for s, i in self.special.items():
            known[s] = (i,)
        of = known.__getitem__
        out = [list(chain.from_iterable(map(of, pieces))) for pieces in split]
        self.forget(new)
        return out

    def forget(self, new: list[str]) -> None:
        """Of new pieces those that come for the first time are forgotten, as most never come again; of the others those that came longest ago."""
        known, marks = self.known, self.marks
        for p in new:
            at = hash(p) % MARKS
            if not marks[at]:  # a mark of another piece only lets this one stay
                marks[at] = 1
                self.marked += 1
                del known[p]
        if self.marked > MARKS // 2:
            self.marks, self.marked = bytearray(MARKS), 0
        if len(known) > MEMORY_PIECES:
            self.known, self.older = {}, known

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PairIndexBpe:
    """One encoder per Python worker and file."""
    return PairIndexBpe(path)


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """(doc_id, ids, decoded, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    A null text is the empty text: no tokens, digests of nothing.  Repeated rows are encoded each,
    a null doc_id keeps its row, other columns are not read.  ids and decoded are null unless asked for.
    """

    def run(batches):
        bpe = load(path)
        for b in batches:
            sizes = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
            for s, e in slices_by_size(sizes, SLICE_CHARS):
                ids = bpe.encode_batch([t or "" for t in b.column(1).slice(s, e - s).to_pylist()])
                raw = [bpe.decode_bytes(x) for x in ids]
                back = [x.decode("utf-8", "replace") for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(s, e - s),
                        pa.array(ids if keep_ids else [None] * (e - s), pa.list_(pa.int32())),
                        pa.array(back if keep_text else [None] * (e - s), pa.string()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(",".join(map(bpe.text.__getitem__, x)).encode()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in back]),
                    ],
                    ["doc_id", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sparing(run), f"doc_id {kind}, ids array<int>, decoded string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
