"""Exact substring dedup: threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts in a document of smaller id.

1. Rows are packed into blocks.  Each window of ``length`` bytes has an anchor, the least hash of the grams
   in it, so equal windows have equal anchors.  A block lists its anchors once each, in buckets by hash;
   a bucket tells each block which of its anchors other documents have as well.  The others are done with.
2. Runs of windows with one shared anchor are cut out and dealt by anchor, so all windows that may be
   equal meet in one bucket of bounded size, each distinct string of a block once.
3. In a bucket the strings form a text whose suffixes are sorted to the threshold's depth.  Starting from
   the intervals that the sort's last round but one has parted, backward extension on its Burrows-Wheeler transform, breadth first, sets the common
   prefix of neighbouring suffixes by increasing value and stops at the threshold; what is then not set
   is at least that long, so suffixes between set places share a window.  The smallest document of each
   such group is what decides.
4. The result goes back to the blocks that asked.

An anchor with more strings than ``HOT_ROWS`` (the ends of a passage that a third of all documents quote) is
not gathered: its windows are grouped one by one by a summed-up minimum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import give_back, materialise, release, scratch_path, slices_by_size, sparing, utf8

LENGTH, GRAM = 50, 16
#: Bytes of text in a block and of strings in a bucket; bound what a task holds.
BLOCK_BYTES, BUCKET_BYTES = 16_000_000, 2_000_000
#: Bytes of a block whose anchors are looked for at once.
PART_BYTES = 1_000_000
HOT_ROWS = 200_000
#: Bits of an anchor's hash that are kept besides those of its bucket; a collision costs work, not correctness.
KEPT_BYTES = 5

_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", 5).compress(data, asbytes=True)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all grams of so many bytes, by doubling: a gram's hash is made of those of its halves."""
    level, width, out, at, left = _BYTE[data], 1, None, 0, size
    while True:
        if left & 1:
            part = level[at:]
            out = part if out is None else out[: len(part)] * _ODD + part
            at += width
        left >>= 1
        if not left:
            break
        level = level[:-width] * (_ODD + np.uint64(2 * width)) + level[width:]
        width *= 2
    out = out[: len(data) - size + 1]
    out = (out ^ (out >> np.uint64(32))) * _ODD
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def anchor_runs(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, chunk: int = 1 << 15, part: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one text with equal anchors: (anchor, text, first window's place, number of windows).

    Windows are taken a cache-sized chunk at a time, and only where an anchor differs from the one before is it kept.
    Texts are gone through in parts of so many bytes, so that what is passing does not grow with the block.
    """
    ends = np.cumsum(sizes)
    found = []
    for s, e in slices_by_size(sizes.tolist(), part):
        at = int(ends[s] - sizes[s])
        anchor, text, place, many = _part_runs(data[at : ends[e - 1]], sizes[s:e], length, chunk)
        found.append([anchor, text + s, place + at, many])
    out = []
    while found and found[0]:
        out.append(np.concatenate([x.pop(0) for x in found]))
    return tuple(out) or _part_runs(data, sizes, length, chunk)


def _part_runs(data: np.ndarray, sizes: np.ndarray, length: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        return none.astype(np.uint64), none, none, none
    gram, n = min(GRAM, length), len(data) - length + 1
    places, values, last = [], [], None
    for s in range(0, n, chunk):
        e = min(s + chunk, n)
        a = sliding_min(gram_hashes(data[s : e + length - 1], gram), length - gram + 1)
        new = np.flatnonzero(np.concatenate([[last is None or a[0] != last], a[1:] != a[:-1]]))
        places.append(new + s)
        values.append(a[new])
        last = a[-1]
    place, value = np.concatenate(places), np.concatenate(values)
    starts = np.cumsum(sizes) - sizes
    # a text's windows begin at its start, and those that would leave it begin a run of their own
    edges = np.concatenate([starts, starts + windows])
    at = np.sort(np.concatenate([place, edges[edges < n]]), kind="stable")
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    anchor = value[np.searchsorted(place, at, side="right") - 1]
    many = np.diff(np.append(at, n))
    text = np.searchsorted(starts, at, side="right") - 1
    keep = at < (starts + windows)[text]
    return anchor[keep], text[keep], at[keep], many[keep]


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_ids, sizes, data): neighbouring rows together; a longer text is a block of its own."""

    def pack(name, ids, texts):
        return {"block": name, "doc_ids": ids, "sizes": [len(t) for t in texts], "data": squeeze(b"".join(texts))}

    def run(batches):
        part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            # texts become objects one by one
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = utf8(t.as_py())
                if ids and size + len(t) > block_bytes:
                    yield pa.RecordBatch.from_pylist([pack(part << 32 | n, ids, texts)], schema=schema)
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield pa.RecordBatch.from_pylist([pack(part << 32 | n, ids, texts)], schema=schema)

    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sparing(run), "block bigint, doc_ids array<bigint>, sizes array<bigint>, data binary")


def _block(row_ids, row_sizes, row_data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (-1: null), sizes and bytes of a block."""
    ids = np.array([-1 if i is None else i for i in row_ids.as_py()], np.int64)
    sizes = row_sizes.values.to_numpy()
    return ids, sizes, np.frombuffer(pa.decompress(row_data.as_py(), int(sizes.sum()), codec="zstd", asbytes=True), np.uint8)


def _known(ids_row) -> np.ndarray:
    return np.array([i is not None for i in ids_row.as_py()], bool)


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEPT_BYTES, 8), np.uint8)
    out[:, :KEPT_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEPT_BYTES)
    return out.view("<u8").reshape(-1)


def _short(anchor: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits of the anchor hashed anew: those of the bucket and the kept ones.

    An anchor is a least hash, so its own leading bits are mostly zeros, and one bucket would get most anchors.
    """
    x = anchor * _ODD
    x ^= x >> np.uint64(32)
    x *= _ODD
    return x >> np.uint64(64 - bits - 8 * KEPT_BYTES)


def shared_anchors(blocks: DataFrame, bits: int, length: int = LENGTH) -> DataFrame:
    """(block, bucket, anchors): of each block's anchors those that more than one document has."""
    mask = np.uint64((1 << 8 * KEPT_BYTES) - 1)

    def listed(batches):
        for b in batches:
            for name, ids, sizes, data in zip(*b.columns, strict=True):
                i, n, raw = _block(ids, sizes, data)
                a, text = anchor_runs(raw, n, length)[:2]
                del raw
                keep = _known(ids)[text]
                a, doc = _short(a[keep], bits), i[text[keep]]
                order = np.lexsort((doc, a))
                a, doc = a[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
                last = np.append(new[1:], len(a)) - 1
                several = doc[new] != doc[last] if len(a) else np.zeros(0, bool)
                a = a[new]
                bucket = (a >> np.uint64(8 * KEPT_BYTES)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    part, many = a[cut[k] : cut[k + 1]] & mask, several[cut[k] : cut[k + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name.as_py()], pa.int64()), pa.array([_packed(part[~many])], pa.binary()), pa.array([_packed(part[many])], pa.binary())], ["bucket", "block", "single", "several"])

    def judged(table: pa.Table) -> pa.Table:
        single = [_unpacked(x.as_py()) for x in table.column("single")]
        several = [_unpacked(x.as_py()) for x in table.column("several")]
        every = np.concatenate(single + several)
        # in two lists, or in two documents of one
        _, own, counts = np.unique(every, return_inverse=True, return_counts=True)
        keep = counts > 1
        keep[own[sum(map(len, single)) :]] = True
        keep, ends = keep[own], np.cumsum([len(x) for x in single + several])
        kept = [x[keep[e - len(x) : e]] for x, e in zip(single + several, ends, strict=True)]
        out = [_packed(np.concatenate([s, m])) for s, m in zip(kept[: len(single)], kept[len(single) :], strict=True)]
        del every, own, keep, kept, single, several
        give_back()
        return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "anchors"])

    lists = blocks.mapInArrow(sparing(listed), "bucket int, block bigint, single binary, several binary")
    return lists.groupBy("bucket").applyInArrow(judged, "block bigint, bucket int, anchors binary").where(F.length("anchors") > 0)


def by_block(df: DataFrame, name: str) -> str:
    """Write rows in a folder per block, for the tasks that hold the block; the folder's path."""
    path = scratch_path(df.sparkSession, name)
    df.repartition("block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    return path


def _read_block(path: str, block: int) -> pa.Table | None:
    store, base = fs.FileSystem.from_uri(path)
    folder = f"{base}/block={block}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return None
    files = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read() for f in files]) if files else None


def _shared_runs(shared: str, block: int, data: np.ndarray, sizes: np.ndarray, known: np.ndarray, bits: int, length: int):
    """The runs of a block whose anchors other documents have."""
    a, text, at, n = anchor_runs(data, sizes, length)
    got = _read_block(shared, block)
    if got is None or not len(a):
        return a[:0], text[:0], at[:0], n[:0]
    parts = [_unpacked(x.as_py()) | (np.uint64(k.as_py()) << np.uint64(8 * KEPT_BYTES)) for k, x in zip(got.column("bucket"), got.column("anchors"), strict=True)]
    wanted, mine = np.sort(np.concatenate(parts)), _short(a, bits)
    keep = (wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine) & known[text]
    return a[keep], text[keep], at[keep], n[keep]


def shared_strings(blocks: DataFrame, shared: str, bits: int, length: int, buckets: int) -> DataFrame:
    """(bucket, block, anchors, sizes, ids, text): the distinct strings of a block, those of a bucket in one row.

    ids are the least and the greatest id that have a string in the block.  There are never more rows than strings.
    """

    def run(batches):
        for b in batches:
            for name, ids, sizes, data in zip(*b.columns, strict=True):
                i, n, raw = _block(ids, sizes, data)
                a, text, at, many = _shared_runs(shared, name.as_py(), raw, n, _known(ids), bits, length)
                held: dict[bytes, int] = {}
                whole = raw.tobytes()
                own = np.fromiter((held.setdefault(whole[p : p + k + length - 1], len(held)) for p, k in zip(at.tolist(), many.tolist(), strict=True)), np.int64, len(at))
                del whole, raw
                if not len(own):
                    continue
                lo, hi = np.full(len(held), np.iinfo(np.int64).max), np.full(len(held), np.iinfo(np.int64).min)
                np.minimum.at(lo, own, i[text])
                np.maximum.at(hi, own, i[text])
                anchor = np.empty(len(held), np.uint64)
                anchor[own] = a
                strings = list(held)
                held.clear()
                bucket = (anchor % np.uint64(buckets)).astype(np.int64)
                short = (anchor >> np.uint64(33)).astype(np.int32)  # two anchors alike in it cost work, not correctness
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
                rows = []
                for s, e in zip(cut, cut[1:], strict=False):
                    part = np.array(sorted(order[s:e].tolist(), key=strings.__getitem__))  # alike ones side by side
                    mine = [strings[j] for j in part]
                    size = np.array([len(x) for x in mine], "<i4")
                    ids_of = np.concatenate([lo[part], hi[part] - lo[part]]).tobytes()
                    rows.append((int(bucket[part[0]]), name.as_py(), short[part], size.tobytes(), squeeze(ids_of), squeeze(b"".join(mine))))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _PACKED.names)

    kinds = _PACKED.types
    return blocks.mapInArrow(sparing(run), "bucket bigint, block bigint, anchors array<int>, sizes binary, ids binary, text binary")


_PACKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("anchors", pa.list_(pa.int32())), ("sizes", pa.binary()), ("ids", pa.binary()), ("text", pa.binary())])


def unpack(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Blocks, anchors, strings, least and greatest ids of packed rows."""
    block, anchor, strings, lo, hi = [], [], [], [], []
    for b, a, n, x, t in zip(*(rows.column(k) for k in ("block", "anchors", "sizes", "ids", "text")), strict=True):
        size = np.frombuffer(n.as_py(), "<i4")
        ends = np.cumsum(size)
        text = pa.decompress(t.as_py(), int(ends[-1]), codec="zstd", asbytes=True)
        strings += [text[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        least, more = np.frombuffer(pa.decompress(x.as_py(), 16 * len(size), codec="zstd", asbytes=True), np.int64).reshape(2, -1)
        block.append(np.full(len(size), b.as_py()))
        anchor.append(a.values.to_numpy())
        lo.append(least)
        hi.append(least + more)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(block), join(anchor), strings, join(lo), join(hi)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of a text of small numbers, sorted by their first ``depth`` symbols at least."""
    return ranked_suffixes(text, depth)[0]


def ranked_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray]:
    """``sorted_suffixes``, and a smaller depth with the rank of each place's suffix by so many symbols (of 0 symbols all are alike)."""
    n, step = len(text), 7
    padded = np.concatenate([text.astype(np.uint64), np.zeros(step, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(step):
        key <<= np.uint64(9)
        key |= padded[j : j + n]
    del padded
    parted, by = 0, np.zeros(n, np.int32)
    while True:
        order = np.argsort(key).astype(np.int32)
        if step >= depth:
            return order, parted, by
        key = key[order]
        by[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]), dtype=np.int32)
        rank, parted = by.astype(np.uint64), step
        # two or three neighbouring ranks make the next key, as many as fit
        times, width = (3, 21) if rank[order[-1]] < 1 << 21 else (2, 32)
        key[:] = rank
        for k in range(1, times):
            key <<= np.uint64(width)
            key[: max(n - k * step, 0)] |= rank[k * step :]
        step *= times


def common_prefix_breaks(text: np.ndarray, order: np.ndarray, length: int, depth: int = 0, rank: np.ndarray | None = None) -> np.ndarray:
    """Whether the common prefix of each sorted suffix with the one before is shorter than ``length``.

    Symbol 0 parts the strings of the text and is not extended.  Level l of the breadth-first expansion holds the
    intervals of strings of l symbols; extending them backward yields those of l + 1, whose right ends get
    the common prefix l where none is set yet, and only those that set one are extended further.

    Where suffixes have a ``rank`` by their first ``depth`` symbols, the expansion begins at that level: common
    prefixes below it are where ranks change, and the intervals of strings of ``depth`` symbols are those between.
    """
    n = len(text)
    bwt = text[order - 1]  # the text starts with a 0, so suffix 0 is preceded by the last 0
    forward = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int32)  # of each place, the place of the suffix one symbol longer
    step[forward] = np.arange(n, dtype=np.int32)
    first = bwt[forward]  # the first symbols of the sorted suffixes
    del forward, bwt
    done = np.zeros(n + 1, bool)  # where a common prefix is set
    done[0] = done[n] = True
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    if depth:
        by = rank[order]
        done[1:n] = by[1:] != by[:-1]
        del by
        ends = np.flatnonzero(done).astype(np.int32)
        lo, hi = ends[:-1], ends[1:]
        # strings without a 0 whose right end has the common prefix depth - 1; the last symbols part most others
        here, after = order[lo], order[np.minimum(hi, n - 1)]
        keep = (hi < n) & (np.maximum(here, after) <= n - depth)
        keep[keep] = text[here[keep] + depth - 1] != 0
        for k in reversed(range(depth - 1)):
            lo, hi, here, after = lo[keep], hi[keep], here[keep], after[keep]
            symbol = text[here + k]
            keep = (symbol == text[after + k]) & (symbol != 0)
        lo, hi = lo[keep], hi[keep]
    mark = np.zeros(n, np.int32)
    for _ in range(depth, length):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        places = np.repeat(lo - (np.cumsum(size, dtype=np.int32) - size), size)
        places += np.arange(total, dtype=np.int32)
        reach = step[places]
        del places
        own = np.repeat(np.arange(1, len(lo) + 1, dtype=np.int32), size)
        if total * 12 < n:
            order_of = np.argsort(reach)
            at, own = reach[order_of], own[order_of]
        else:  # sorted by marking, as there are many
            mark[reach] = own
            at = np.flatnonzero(mark).astype(np.int32)
            own = mark[at]
            mark[at] = 0
        symbol = first[at]
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])])
        starts = np.flatnonzero(new)
        lo, hi = at[starts], at[np.append(starts[1:], len(at)) - 1] + 1
        # what starts with 0 is in no window; its borders to the others are set all the same
        fresh = ~done[hi] & (first[lo] != 0)
        done[hi] = True
        lo, hi = lo[fresh], hi[fresh]
    return done[:n]


def least_documents(strings: list[bytes], lo: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each string, the least of the ids (one a string) that have it anywhere."""
    if not strings:
        return []
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"\0" + b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    text[0] = 0
    text[starts + sizes] = 0
    order, depth, rank = ranked_suffixes(text, length)
    breaks = np.flatnonzero(common_prefix_breaks(text, order, length, depth, rank))
    owner = np.zeros(len(text), np.int64)
    owner[1:] = np.repeat(np.arange(len(strings)), sizes + 1)
    doc = lo[owner]
    # only places where a whole window fits count
    inside = np.arange(len(text)) - starts[owner]
    doc = np.where((inside >= 0) & (inside <= sizes[owner] - length), doc, np.iinfo(np.int64).max)
    group = np.minimum.reduceat(doc[order], breaks)
    out = np.empty(len(text), np.int64)
    out[order] = np.repeat(group, np.diff(np.append(breaks, len(text))))
    return [out[s : s + n - length + 1] for s, n in zip(starts, sizes, strict=True)]


def string_key(s: bytes) -> bytes:
    return xxhash.xxh3_128_digest(s)


def _answers(blocks, strings, his, least, of=None) -> pa.Table:
    """Rows for the strings in which something goes; ids that are all alike are given once.

    ``least`` has the ids of each string's windows, or, with ``of``, those that its numbers choose.
    """
    sizes = np.array([len(d) for d in least], np.int64)
    flat, at = np.concatenate([*least, np.zeros(0, np.int64)]), np.cumsum(sizes) - sizes
    low, high = (np.minimum.reduceat(flat, at), np.maximum.reduceat(flat, at)) if len(sizes) else (flat, flat)
    of = np.arange(len(sizes)) if of is None else of
    kept = np.flatnonzero(low[of] < np.asarray(his, np.int64))
    raw = [d[:1].astype("<i8").tobytes() if same else d.astype("<i8").tobytes() for d, same in zip(least, (low == high).tolist(), strict=True)]
    rows = [pa.array(np.asarray(blocks, np.int64)[kept]), pa.array([string_key(strings[k]) for k in kept.tolist()], pa.binary()), pa.array([raw[j] for j in of[kept].tolist()], pa.binary())]
    return pa.table(rows, ["block", "key", "least"])


def judge(block: np.ndarray, anchor: np.ndarray, strings: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> pa.Table:
    """The answers to the strings of a bucket."""
    place: dict[bytes, int] = {}
    own = np.fromiter((place.setdefault(x, len(place)) for x in strings), np.int64, len(strings))
    distinct = list(place)
    least_lo = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least_lo, own, lo)
    # a window has one anchor: where an anchor's strings are all equal there is nothing to compare
    of = np.empty(len(distinct), np.int64)
    of[own] = anchor
    _, same, many = np.unique(of, return_inverse=True, return_counts=True)
    found = [least_lo[j : j + 1] for j in range(len(distinct))]  # one id for all windows
    several = np.flatnonzero(many[same] > 1)
    for j, least in zip(several.tolist(), least_documents([distinct[j] for j in several], least_lo[several], length), strict=True):
        found[j] = least
    return _answers(block, strings, hi, found, own)


def resolve(strings: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(block, key, least): for each string of a block in which something goes, the least id of each of its windows (once, if they are alike)."""
    schema = "block bigint, key binary, least binary"
    hot = materialise(strings.select("bucket", F.explode("anchors").alias("anchor")).groupBy("bucket", "anchor").count().where(F.col("count") > hot_rows).select("bucket", "anchor"), "hot")
    release(strings.sparkSession)

    def whole(table: pa.Table) -> pa.Table:
        out = judge(*unpack(table), length)
        give_back()
        return out

    if not hot.count():
        return strings.groupBy("bucket").applyInArrow(whole, schema)

    def flat(batches):
        for b in batches:
            block, anchor, s, lo, hi = unpack(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in b.column(2)])), pa.array(block), pa.array(anchor.astype(np.int32)), pa.array(s, pa.binary()), pa.array(lo), pa.array(hi)], ["bucket", "block", "anchor", "s", "lo", "hi"])

    def judged(table: pa.Table) -> pa.Table:
        return judge(*(table.column(k).to_numpy() for k in ("block", "anchor")), table.column("s").to_pylist(), *(table.column(k).to_numpy() for k in ("lo", "hi")), length)

    plain = strings.mapInArrow(sparing(flat), "bucket bigint, block bigint, anchor int, s binary, lo bigint, hi bigint")
    out = plain.join(hot, ["bucket", "anchor"], "left_anti").groupBy("bucket").applyInArrow(judged, schema)
    few = plain.join(hot, ["bucket", "anchor"], "left_semi")
    each = few.select("block", "s", "lo", "hi", F.explode(F.sequence(F.lit(1), F.length("s") - length + 1)).alias("at")).withColumn("w", F.substring(F.col("s"), F.col("at"), F.lit(length)))
    minima = each.groupBy("w").agg(F.min("lo").alias("least"))
    back = each.join(minima, "w").groupBy("block", "s", "hi").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("least"))  # the windows of one string

    def packed(batches):
        for b in batches:
            least = [np.array([x["least"] for x in row], np.int64) for row in b.column(3).to_pylist()]
            yield from _answers(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), least).to_batches()

    return out.union(back.select("block", "s", "hi", "least").mapInArrow(packed, schema))


#: Windows whose places are written out at a time.
MARK_WINDOWS = 1 << 20


def mark_repeats(bad: np.ndarray, raw: np.ndarray, answers: pa.Table, doc: np.ndarray, at: np.ndarray, many: np.ndarray, length: int) -> None:
    """Set in ``bad`` the bytes of windows that a smaller document has; runs of windows are given by document, first place and number."""
    answers = answers.combine_chunks()
    keys, least = (answers.column(k).combine_chunks() for k in ("key", "least"))
    offsets = np.frombuffer(least.buffers()[1], np.int32)[least.offset : least.offset + len(least) + 1] // 8
    values = np.frombuffer(least.buffers()[2] or b"", "<i8", int(offsets[-1]))
    whole = raw.tobytes()
    mine = pa.array([string_key(whole[p : p + k + length - 1]) for p, k in zip(at.tolist(), many.tolist(), strict=True)], pa.binary())
    del whole
    place = pc.fill_null(pc.index_in(mine, value_set=keys), -1).to_numpy()
    asked = np.flatnonzero(place >= 0)
    for s, e in slices_by_size(many[asked].tolist(), MARK_WINDOWS):
        runs = asked[s:e]
        n, one = many[runs], place[runs]
        own = np.repeat(np.arange(len(runs)), n)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        # one id stands for all windows of a run
        id_ = values[offsets[one][own] + np.where(np.diff(offsets)[one] > 1, 1, 0)[own] * nth]
        bad[(at[runs][own] + nth)[id_ < doc[runs][own]]] = True
    # each place that is marked is the first of a window
    have = 1
    while have < length:
        step = min(have, length - have)
        bad[step:] |= bad[:-step].copy()
        have += step


def _removed_runs(bad: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set places, none across the end of a text."""
    edge = np.flatnonzero(bad[1:] != bad[:-1]) + 1
    inner = np.unique(ends[(ends > 0) & (ends < len(bad))])
    inner = inner[bad[inner] & bad[inner - 1]]  # within a run
    head, tail = (np.zeros(0, np.int64), np.zeros(0, np.int64)) if not len(bad) else (np.zeros(int(bad[0]), np.int64), np.full(int(bad[-1]), len(bad)))
    on = bad[edge]
    return np.sort(np.concatenate([head, edge[on], inner])), np.sort(np.concatenate([edge[~on], tail, inner]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept), one row per input row.

    spans are the maximal runs of bytes removed; kept is the rest, null unless asked for (cutting may leave no
    valid UTF-8, so it is binary).  A null text has no bytes.  Rows that repeat a doc_id are no smaller than each
    other.  A null doc_id is neither smaller nor larger than another: such a row keeps all and removes nothing.
    A text shorter than ``length`` keeps all; an empty table gives an empty one.
    """
    blocks = materialise(pack_blocks(docs, block_bytes), "blocks")
    n = blocks.count()
    bits = max(4, (max(1, n // 4) - 1).bit_length())
    shared = by_block(shared_anchors(blocks, bits, length), "shared") if n else scratch_path(docs.sparkSession, "none")
    release(docs.sparkSession)
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda t, x: t + x))).first()[0] or 0
    strings = materialise(shared_strings(blocks, shared, bits, length, max(1, -(-int(total) // bucket_bytes))), "strings")
    answers = by_block(resolve(strings, length, hot_rows), "answers") if n else shared
    release(docs.sparkSession)

    def run(batches):
        for b in batches:
            for name, ids, sizes, data in zip(*b.columns, strict=True):
                i, size, raw = _block(ids, sizes, data)
                bad = np.zeros(len(raw), bool)
                got = _read_block(answers, name.as_py())
                if got is not None:
                    _, text, at, many = _shared_runs(shared, name.as_py(), raw, size, _known(ids), bits, length)
                    mark_repeats(bad, raw, got, i[text], at, many, length)
                    del got, text, at, many
                # borders of texts part what is removed, so that a run belongs to one text
                ends = np.cumsum(size)
                first, last = _removed_runs(bad, ends)
                own = np.searchsorted(ends, first, side="right")
                base = (ends - size)[own]
                gone = np.bincount(own, last - first, len(size)).astype(np.int64)
                edges = np.searchsorted(own, np.arange(len(size) + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["start", "end"]))
                digests, kept = [], []
                for e, m, g in zip(ends.tolist(), size.tolist(), gone.tolist(), strict=True):
                    rest = raw[e - m : e][~bad[e - m : e]] if g else raw[e - m : e]
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.tobytes() if keep_text else None)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(size), pa.array(gone), spans, pa.array(digests, pa.string()), pa.array(kept, pa.binary())], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    return blocks.mapInArrow(sparing(run), "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary")
