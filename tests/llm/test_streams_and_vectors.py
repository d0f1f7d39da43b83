"""Clicks, token alignment and vectors against brute force, and their defined results on odd input."""

import datetime as dt
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

# ── clicks ──

CLICKS = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string"
NAMES = ["click_id", "ts", "arrived_at", "client_id", "kind", "value", "props"]


def windows(rows):
    """The contract, copy by copy."""
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    shown = lambda x: "" if x is None else str(x)
    copies = []
    for r in (dict(zip(NAMES, r, strict=True)) for r in rows):
        if r["click_id"] is None or r["arrived_at"] is None or math.fmod(r["click_id"], 3) < 0:
            continue
        for j in range(r["click_id"] % 3 + 1):
            c = zlib.crc32(f"{r['click_id']}:{j}".encode())
            hour = micros(r["arrived_at"]) // 3_600_000_000 + 6 * j * (c % 10)
            value = None if r["value"] is None else math.floor(100 * r["value"] + 0.5)
            told = [r["client_id"], r["kind"], value, None if r["ts"] is None else micros(r["ts"]), r["props"], c % 3]
            copies.append((hour + c // 10 % 200, r["click_id"], hour, hashlib.sha256("|".join(map(shown, told)).encode()).hexdigest()))
    if not copies:
        return []
    low, high = min(x[0] for x in copies), max(x[0] for x in copies)
    largest, opened, out, late = None, {}, [], 0
    for batch in range(8):
        of = defaultdict(list)
        mine = [x[1:] for x in copies if (x[0] - low) * 8 // (high - low + 1) == batch]
        for i, hour, told in mine:
            if largest is not None and hour < largest - 96:
                late += 1
            else:
                of[i].append((hour, told))
        for i, own in of.items():
            for hour, told in sorted(own):
                w = opened.get(i)
                if w and hour <= w[0] + 24:
                    w[1] += 1
                    if told != w[4]:
                        w[2], w[3] = w[2] + 1, w[3] + zlib.crc32(told.encode())
                else:
                    if w:
                        out.append((i, w[0], batch, *w[1:]))
                    opened[i] = [hour, 0, 0, 0, told]
        hours = [x[1] for x in mine] + ([] if largest is None else [largest])
        largest = max(hours) if hours else None
        for i in [i for i, w in opened.items() if batch == 7 or w[0] + 24 < largest - 96]:
            w = opened.pop(i)
            out.append((i, w[0], batch, *w[1:]))
    assert late
    return sorted(out)


def clicks(n=3_000):
    r = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = day + dt.timedelta(minutes=r.randrange(60 * 24 * 60))
        rows.append((r.randrange(700), at, at + dt.timedelta(seconds=r.randrange(90)), r.choice([1, 2, None]), r.choice(["a", None, "b|c"]), r.choice([None, -0.005, 1.115, 1e6 / 3]), r.choice([None, "", '{"k": 1}'])))
    # a click_id of a third of the rows, repeated rows, and rows without what is needed
    rows += [(11, day + dt.timedelta(hours=k % 900), day + dt.timedelta(hours=k % 900), k % 5, "hot", 1.0, None) for k in range(n // 2)]
    return [*rows, *rows[:40], (None, day, day, 1, "x", 1.0, None), (5, day, None, 1, "x", 1.0, None), (-4, day, day, 1, "x", 1.0, None), (-3, day, day, None, None, None, None)]


def test_windows_of_clicks_by_brute_force(spark):
    from quire.llm.click_dedup import copies, cut, deduplicate
    from quire.llm.common import scratch_path

    rows = clicks()
    df = spark.createDataFrame(rows, CLICKS)
    for c in ("hour", "hash", "place", "batch", "n", "bucket"):
        df = df.withColumn(c, F.lit("x"))
    got = deduplicate(*cut(spark, copies(df), scratch_path(spark, "clicks")))
    assert sorted(map(tuple, got.collect())) == windows(rows)


def test_the_session_zone_changes_no_window(spark):
    from quire.llm.click_dedup import copies

    df = spark.createDataFrame(clicks(50), CLICKS)
    want = Counter(map(tuple, copies(df).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert Counter(map(tuple, copies(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_no_clicks(spark):
    from quire.llm.click_dedup import copies, cut, deduplicate
    from quire.llm.common import scratch_path

    got = deduplicate(*cut(spark, copies(spark.createDataFrame([], CLICKS)), scratch_path(spark, "clicks")))
    assert got.count() == 0 and "conflict_crc" in got.columns


def test_fold_across_chunks_is_that_of_one():
    from quire.llm.click_dedup import _fold, _unpacked

    class Nothing:
        exists = False

    r = np.random.default_rng(4)
    n = 400
    rows = {"click_id": r.integers(0, 9, n), "hour": r.integers(0, 200, n), "crc": r.integers(0, 1 << 32, n), "n": r.integers(1, 4, n), "hash": r.integers(0, 3, (n, 4)).astype(np.uint64)}
    opened, closed = _fold(rows, _unpacked(Nothing), 24)
    mixed = r.permutation(n)
    again, closed_again = _fold({k: v[mixed] for k, v in rows.items()}, _unpacked(Nothing), 24)
    assert all((opened[k] == again[k]).all() for k in opened)
    total = sum(x["n_repeats"].sum() + len(x["click_id"]) for x in (opened, *closed))
    assert total == rows["n"].sum() == sum(x["n_repeats"].sum() + len(x["click_id"]) for x in (again, *closed_again))


# ── alignment of tokens ──


def aligned(docs):
    """The contract, token by token."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from quire.llm.bpe import byte_symbols

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value = {s: i for i, s in enumerate(byte_symbols())}
    told, held = [], Counter()
    for i, text in docs:
        a, b, groups = [], [], []
        if text:
            raw = f" {text}".encode()
            a, b = a_side.encode(f" {text}", add_special_tokens=False).ids, b_side.encode(text)
            bytes_a = [bytes(value[c] for c in a_side.id_to_token(x)) for x in a]
            bytes_b = [bytes([int(b_side.id_to_piece(x)[3:-1], 16)]) if b_side.is_byte(x) else b_side.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
                a, b, bytes_a, bytes_b = [], [], [], []
            ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
            before = 0
            for cut in sorted(set(ends_a) & set(ends_b)):
                groups.append(([x for x, e in zip(a, ends_a, strict=True) if before < e <= cut], [x for x, e in zip(b, ends_b, strict=True) if before < e <= cut]))
                before = cut
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(links.keys())
        shown = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in groups)
        told.append((i, len(a), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return Counter((i, a, b, g, sum(n.values()), sum(m for p, m in n.items() if held[p] == best[p[0]]), sum(m * held[p] for p, m in n.items()), h) for i, a, b, g, n, h in told)


def texts():
    r = random.Random(1)
    odd = ["", None, " ", "  a  b ", "a\n b", "a \n b\n\n c d", "x▁y z", "<|endoftext|> <s> </s> <unk>", "日本語 テキスト 🙂🙂", "=" * 300 + " a", "a\x1c b", "tab\there is  ", "café é", "\n\n\n  \t x", "aéà" * 200, "  x 　y", "don't we'll I'M 123,456.78", "\x00 a", "​ z"]
    odd += ["".join(r.choice("ab \n.é日'🙂1  ") for _ in range(r.randint(1, 80))) for _ in range(150)]
    return [*enumerate(odd), (3, "  a  b "), (None, "no id at all"), (4, "the same id twice")]


def align(df):
    import public_tokenizers

    from quire.llm.token_align import align

    return align(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def test_alignment_by_brute_force(spark):
    df = spark.createDataFrame(texts(), "doc_id bigint, text string").repartition(5)
    for c in ("chunk", "idx", "stripe", "salt", "n_a"):
        df = df.withColumn(c, F.lit("x"))
    assert Counter(map(tuple, align(df).collect())) == aligned(texts())


def test_alignment_in_many_chunks_with_salted_stripes(spark, monkeypatch):
    from quire.llm import token_align

    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["alpha", "Beta,", "gamma-ray", "déjà", "12.5", "x\n\ny", "ωmega"]) for _ in range(60))) for i in range(80)]
    monkeypatch.setattr(token_align, "ROWS_A_TASK", 0.1)  # as if a stripe had very many rows
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    assert Counter(map(tuple, align(df).collect())) == aligned(docs)


def test_nothing_to_align(spark):
    assert align(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert [r.groups_sha256 for r in align(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).collect()] == ["", ""]


def test_groups_of_one_long_word():
    """A group of very many tokens is counted by its distinct ids; segments learned one by one or as one text are alike."""
    import public_tokenizers

    from quire.llm.token_align import Aligner

    aligner = Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    words = ["plain", "wörd", "日本語" * 50, "🙂" * 30, "a_b" * 40, "▁", "x" * 5_000, "plain."]
    aligner.learn(words)
    together = [(s, aligner.sums[:, i].tolist(), aligner.shown[i], bool(aligner.whole[i])) for s, i in sorted(aligner.index.items())]
    aligner.forget()
    for w in words:
        aligner.learn([w])
    assert together == [(s, aligner.sums[:, i].tolist(), aligner.shown[i], bool(aligner.whole[i])) for s, i in sorted(aligner.index.items())]
    assert not dict((s, ok) for s, _, _, ok in together)["▁"]


# ── vectors ──

VECTORS = "vec_id bigint, embedding array<float>, label int"


def linked(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of all pairs of a label."""
    unit = []
    for _, e, label in rows:
        ok = label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        x = np.array(e, np.float64) / max(map(abs, e)) if ok else None
        unit.append(x / np.sqrt(x @ x) if ok else None)
    above, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    groups = defaultdict(list)
    for i, x in enumerate(unit):
        if x is not None:
            groups[rows[i][2], len(x)].append(i)
    for own in groups.values():
        x = np.array([unit[i] for i in own])
        for p, q in np.argwhere(np.triu(x @ x.T >= threshold, 1)):
            i, j = own[p], own[q]
            links[i], links[j] = links[i] + 1, links[j] + 1
            above[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [(r[0], links[i], least.get(top(i)), r[0] is not None and r[0] == least.get(top(i))) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    centres, dense = r.standard_normal((60, 16)), r.standard_normal(16)
    rows = [(i, (centres[r.integers(60)] + r.standard_normal(16) * r.choice([0, 0.05, 0.2, 0.3])).astype(np.float32).tolist(), int(r.integers(3))) for i in range(900)]
    rows += [(i, (dense + r.standard_normal(16) * 0.12).astype(np.float32).tolist(), 0) for i in range(900, 1_300)]  # a ball that shares every bucket
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [None] * 16, 1), (3004, rows[5][1], None), (None, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    rows += [(3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [1e38, 2e38], 1), (3009, [1e-40, 2e-40], 1), (3010, [float("inf"), 1.0], 1), (None, None, None)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    return df, [(x.vec_id, x.embedding, x.label) for x in df.collect()]


@pytest.mark.parametrize("block", [512, 40])
def test_vectors_by_brute_force(vectors, monkeypatch, block):
    from quire.llm import vector_dedup

    monkeypatch.setattr(vector_dedup, "BLOCK", block)  # the dense ball in one block, and in many
    df, rows = vectors
    for c in ("class", "n", "bucket", "least"):
        df = df.withColumn(c, F.lit("x"))
    got, want = Counter(map(tuple, vector_dedup.near_duplicates(df).collect())), Counter(linked(rows))
    assert sum(got.values()) == len(rows)
    found, all_links = (sum(r[1] * n for r, n in x.items()) for x in (got, want))
    assert 0.98 * all_links <= found <= all_links  # none below the threshold, few missed
    assert sum((got - want).values()) <= 0.03 * len(rows)
    odd = lambda x: {r: n for r, n in x.items() if r[0] is None or r[0] >= 3_000}
    assert odd(got) == odd(want)


def test_recall_at_the_threshold():
    """Pairs just at the threshold share a table as often as planned."""
    import pyarrow as pa

    from quire.llm.vector_dedup import _keys, plan

    r = np.random.default_rng(5)
    x = r.standard_normal((1_500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((1_500, 32))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = np.stack([x, 0.93 * x + math.sqrt(1 - 0.93**2) * y], 1).reshape(-1, 32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array(both.tolist(), pa.list_(pa.float64()))], ["class", "embedding"])
    projections, tables = plan(5_000, 0.93, 0.98)
    keys = np.array(next(_keys(projections, tables)([batch])).column("keys").to_pylist()).reshape(-1, 2, tables)
    assert 0.965 < (keys[:, 0] == keys[:, 1]).any(axis=1).mean() < 0.995


def test_no_vectors(spark):
    from quire.llm.vector_dedup import near_duplicates

    got = near_duplicates(spark.createDataFrame([], VECTORS))
    assert got.count() == 0 and got.columns == ["vec_id", "n_links", "component_id", "kept"]
