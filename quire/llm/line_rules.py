"""Quality rules with cross-document line frequency.

Lines are normalised and hashed, the distinct documents that hold a line are counted per host over the
whole corpus, lines above the limits are removed, and documents that lose too much are rejected.  Only
hashes and word counts are shuffled, not texts; a line in a third of all rows is summed up before it is.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER_ASCII, materialise, slices_by_size, utf8

#: A line is boilerplate of a host if at least MIN_DOCS of its documents and more than MAX_SHARE of them hold it, or
#: MANY_DOCS, so that a host of very many documents raises no bar for itself.
MIN_DOCS, MAX_SHARE, MANY_DOCS = 20, 0.01, 200
#: A document that keeps less than this share of its words is depleted.
MIN_LEFT = 0.3
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SLICE_BYTES = 2_000_000


def line_hash(line: bytes) -> int:
    """A signed hash of the line's words, A-Z lower-cased, one space between them."""
    h = xxhash.xxh64_intdigest(b" ".join(line.translate(LOWER_ASCII).split()), 0)
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window of so many words found twice or more in the text (window: a power of two).

    Windows are named exactly: pairs of names are numbered, then pairs of those, so equal numbers are equal windows.
    """
    n = np.array([len(w) for w in words], np.int64)
    codes: dict[bytes, int] = {}
    name = np.fromiter((codes.setdefault(w, len(codes)) for ws in words for w in ws), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(words)), n)
    step = 1
    while step < window and len(name) > step:
        pair = name[:-step] * (name.max() + 1) + name[step:]
        name = np.unique(pair, return_inverse=True)[1].reshape(-1)
        step *= 2
    if step < window or not len(name):
        return np.zeros(len(words), np.int64)
    at = np.flatnonzero(doc[: len(name)] == doc[window - 1 :])
    key = name[at] * len(words) + doc[at]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[count[inverse.reshape(-1)] > 1]
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(words))


def line_statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts of each text and its lines: array of (hash, words), each hash once.

    (doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines); a null text has no words.
    """

    def run(batches):
        for b in batches:
            texts = [utf8(t) for t in b.column(2).to_pylist()]
            for s, e in slices_by_size([len(t) for t in texts], SLICE_BYTES):
                part = texts[s:e]
                words = [t.split() for t in part]
                chars = [sum(map(len, w)) for w in words]
                dup, lines = [], []
                for t in part:
                    own = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
                    seen = Counter(own)
                    dup.append(len(own) - len(seen))
                    held: dict[int, int] = {}
                    for x, k in seen.items():
                        h = line_hash(x)
                        held[h] = held.get(h, 0) + k * len(x.split())
                    lines.append([{"h": h, "w": w} for h, w in held.items()])
                # continuation bytes are no code points of their own
                more = [len(t) - len(t.decode("utf-8", "surrogatepass")) if not t.isascii() else 0 for t in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(s, e - s), b.column(1).slice(s, e - s),
                        pa.array([len(w) for w in words], pa.int64()), pa.array([c - m for c, m in zip(chars, more, strict=True)], pa.int64()),
                        pa.array([len(t) - len(t.translate(None, SYMBOLS)) for t in part], pa.int64()), pa.array(dup, pa.int64()),
                        pa.array(repeated_words(words), pa.int64()), pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))),
                    ],
                    ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(host).cast("string").alias("host"), "text").mapInArrow(run, f"doc_id {kind}, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<h:bigint,w:bigint>>")


def boilerplate_lines(stats: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """(host, h) of the lines above the limits; a null host is a host of its own."""
    size = stats.groupBy("host", "doc_id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("docs"))
    held = stats.select("host", "doc_id", F.explode("lines").alias("line")).groupBy("host", F.col("line.h").alias("h"), "doc_id").agg(F.lit(1).alias("one"))
    counted = held.groupBy("host", "h").agg(F.count("*").alias("n")).where((F.col("n") >= min_docs) | (F.col("n") >= many_docs))
    size = size.withColumnRenamed("host", "_host")
    return counted.join(size, counted.host.eqNullSafe(size._host)).where((F.col("n") >= many_docs) | (F.col("n") > max_share * F.col("docs"))).select("host", "h")


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """Statistics of each row with base_failed, removed_words, removed (hashes of its boilerplate lines) and kept.

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows; such rows are not kept
    (so a null or empty text never is).  Rows of one doc_id count as one document of their host; repeated rows
    get equal verdicts; an empty table gives an empty one.
    """
    stats = line_statistics(docs, host)
    stats = materialise(stats.withColumn("_row", F.monotonically_increasing_id()), "lines")
    bad = boilerplate_lines(stats, min_docs, max_share, many_docs).withColumnRenamed("host", "_host").withColumnRenamed("h", "_h")
    held = stats.select("_row", "host", F.explode("lines").alias("line")).select("_row", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    hit = held.join(bad, (F.col("h") == F.col("_h")) & F.col("host").eqNullSafe(F.col("_host"))).select("_row", "h", "w").distinct()
    lost = hit.groupBy("_row").agg(F.sum("w").alias("removed_words"), F.collect_set("h").alias("removed"))  # lines of one text
    out = stats.join(lost, "_row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint"))).withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words")) < min_left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("_row", "lines")


def without_lines(text: str | None, removed: list[int]) -> str:
    """The text without its lines of these hashes; lines without words stay."""
    gone = set(removed)
    return "\n".join(x for x in (text or "").split("\n") if not utf8(x).split() or line_hash(utf8(x)) not in gone)
