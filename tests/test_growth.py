"""What a query does once and not several times, and what it holds at a time."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.functions import sequences
from quire.functions import text as T
from quire.operators import ingest, redline, segment, similarity
from quire.streaming import progress


def jaccard(x: set, y: set) -> float:
    return len(x & y) / len(x | y) if x | y else 1.0


def test_sets_of_a_document(spark):
    """Pairs found within documents are all pairs; no row is made for a word."""
    r = random.Random(3)
    left, right = ([[f"t{k}" for k in r.sample(range(30), r.randrange(0, 9))] for _ in range(60)] for _ in range(2))
    rows = lambda sets, name: spark.createDataFrame([(i % 3, i, s) for i, s in enumerate(sets)], f"k int, {name} int, tokens array<string>")
    for least in (0.2, 0.5, 1.0):
        want = sorted((jaccard(set(x), set(y)), a, b) for a, x in enumerate(left) for b, y in enumerate(right) if a % 3 == b % 3 and jaccard(set(x), set(y)) >= least)
        met = similarity.similar_within(rows(left, "a"), rows(right, "r"), "k", least=least)
        assert sorted((x.score, x.a, x.r) for x in met.collect()) == want
        best = similarity.similar_within(rows(left, "a"), rows(right, "r"), "k", least=least, best=True)
        assert sorted((x.score, x.a, x.r) for x in best.collect()) == sorted(p for k in range(3) for p in sequences.one_to_one([x for x in want if x[1] % 3 == k]))
    assert "Generate" not in met._jdf.queryExecution().optimizedPlan().toString()
    both = spark.createDataFrame([(1, ["a b", "", "a b c d"], ["a b", "b c d", ""]), (2, [], ["x"])], "k int, x array<string>, y array<string>")
    assert sorted((p.k, p.a, p.r, p.score) for p in similarity.similar_of_two(both, "x", "y", "k").collect()) == [(1, 0, 0, 1.0), (1, 1, 2, 1.0), (1, 2, 0, 0.5), (1, 2, 1, 0.75)]


def test_equal_sets_are_compared_once():
    """A line that a document repeats costs one comparison, and all its pairs are there."""

    class Counted(frozenset):
        met = 0

        def __and__(self, other):
            Counted.met += 1
            return frozenset.__and__(self, other)

    left, right = [Counted("abcd") for _ in range(200)], [Counted("abce") for _ in range(200)]
    assert len(sequences.alike_sets(left, right, 0.5)) == 40_000
    assert Counted.met == 1


def test_words_and_sentences_at_the_ends(spark):
    """Words in one pass are those of the matching form; blanks before an unusual line end go with the others."""
    texts = ["", " ‘A’ b’s “C”—$3.5% x a", "İ one\ttwo\none", "...", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.token_set(F.col("t")).alias("s"), T.norm_for_match(F.col("t")).alias("n")).collect()
    assert [x.s for x in got] == [None if x.n is None else list(dict.fromkeys(w for w in x.n.split(" ") if w)) for x in got]
    assert got[1].n == "a b s c $3.5% x a"
    said = spark.createDataFrame([(1, "  A first sentence stands here. \u000b Another one follows it. \n")], "k int, text string").select(F.explode(T.sentence_spans(F.col("text"))).alias("s"), "text").collect()
    assert [(x.s.text, x.text[x.s.start : x.s.end]) for x in said] == [(x.s.text, x.s.text) for x in said] and said[-1].s.text.endswith("it.")


def test_frames_of_few_rows(spark):
    """What a worker holds as objects is bounded, whatever the size of a batch; all rows come back."""
    import pandas as pd

    from quire.session import map_in_frames

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "n": [len(f)] * len(f)})

    got = map_in_frames(spark.range(0, 1_000, 1, 2).toDF("id"), run, "id bigint, n int", rows=100).collect()
    assert sorted(x.id for x in got) == list(range(1_000)) and max(x.n for x in got) == 100


def test_centrality_of_groups_of_any_size(spark):
    """Groups that go through as rows and larger ones have the scores of all pairs; rows of one id are not compared."""
    import numpy as np

    from quire.operators import vectors

    r = np.random.default_rng(4)
    rows, want = [], {}
    for key, n in ((1, 1), (2, 2), (3, 64), (4, 65), (5, 3)):
        x = r.normal(size=(n, 4))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        sim = np.clip(x.astype(float) @ x.astype(float).T, 0, 1)
        np.fill_diagonal(sim, 0)
        rows += [(key, i, x[i].tolist()) for i in range(n)]
        want |= {(key, i): sim[i].sum() / (n - 1) if n > 1 else 1.0 for i in range(n)}
    got = vectors.centrality(spark.createDataFrame(rows, "k int, vec_id bigint, embedding array<float>"), "k")
    found = {(x.k, x.vec_id): x.score for x in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_sections_in_one_pass(spark):
    """Documents are neither joined nor read again for their sections, and a header far behind others is outside their table."""
    rows = [(1, "10-K", "\n".join(f"ITEM {k}. The part {k}" for k in range(1, 4)) + "\n" + "x" * 2500 + "\nITEM 2. The second\n body \nITEM 1. The first\nend"), (2, "10-K", " none "), (3, None, "a text"), (4, "S-1", "RISK FACTORS\nmany\nDILUTION\nsome"), (5, "10-K", ""), (6, "S-1", None)]
    docs = spark.createDataFrame(rows, "k int, form string, text string")
    met = segment.sections_by_form(docs, "k")
    text = {k: t for k, _, t in rows}
    got = sorted(tuple(r) for r in met.collect())
    assert [(r[0], r[2], r[6]) for r in got if r[0] != 1] == [(2, "document_body", "none"), (3, "document_body", "a text"), (4, "s1_dilution", "some"), (4, "s1_risk_factors", "many")]
    assert all(text[r[0]][r[4] : r[5]].strip() == r[6] for r in got)
    assert {r[2]: r[6] for r in got if r[0] == 1}["item_1_business"] == "end"
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("LogicalRDD") <= 2 and "Window" not in plan
    hits = segment.item_hits(spark.createDataFrame([(k, f, "\n".join(f"{'x' * (j * k % 700)}\nITEM {j * k % 5} head" for j in range(40))) for k in range(1, 40) for f in ["10-K"]], "k int, form string, text string"), "k")
    by_rows = sorted((r.k, r.head_start, r.head_end, r.item_key) for r in segment.choose_headers(hits, "k").collect())
    held = hits.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("head_start", "head_end", "item_key"))).alias("h"))
    arrays = held.select("k", F.explode(segment._chosen(F.transform("h", lambda h: F.struct(h["item_key"].alias("item_key"), h["head_start"].alias("head_start"), h["head_end"].alias("head_end"))))).alias("c"))
    assert by_rows == sorted((r.k, r.c.head_start, r.c.head_end, r.c.item_key) for r in arrays.collect())


def test_pages_and_files_in_one_pass(spark):
    """A page's tree is made once and a file is parsed once, however often their documents and sections are read."""
    pages = spark.createDataFrame([(1, "https://a.example/x", "<h1>One name</h1><p>" + "word " * 20 + "</p><h2>Two</h2><p>more</p>")], "k int, url string, html string")
    docs, sections = ingest.ingest(pages, "k")
    assert [(r.company, r.n_sections, r.form) for r in docs.collect()] == [("One name", sections.count(), "UNKNOWN")]
    files = spark.createDataFrame([(1, 5, bytearray(b"hello"))], "k int, length bigint, content binary")
    told, cut = ingest.ingest_texts(files, "k")
    for df in (docs, sections, told, cut):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("MapInArrow", "ArrowEval", "detect", "UPPER", "upper("))


def test_plain_facts_without_a_parser(monkeypatch):
    """A document of plain tags is not given to the parser and has the facts that this finds; others are."""
    from quire.sources import html

    def facts(source, plain):
        with monkeypatch.context() as m:
            fed = []
            feed = html._Facts.feed
            m.setattr(html._Facts, "feed", lambda self, x: (fed.append(x), feed(self, x)))
            if not plain:
                m.setattr(html._Facts, "_plain", lambda self, x: False)
            f = html._Facts(source)
            return (f.facts, f.contexts, f.units), bool(fed)

    from quire.queries import _INLINE

    assert facts(_INLINE, True) == (facts(_INLINE, False)[0], False)
    r = random.Random(5)
    pieces = ["<ix:nonFraction name='a:B' contextRef=\"c1\">", "</ix:nonFraction>", "<xbrli:context id='c1'>", "</xbrli:context>", "<context ID=c2>", "<segment/>", "<explicitMember dimension='x' />", "<endDate>2023", "</endDate >", "<p class='a<b'>", "<br/>", "<b>", "</b>", "1,2 &amp; &#160;", "x < y", "<!-- <instant> -->", "<title><instant></title>", "<script>'</b>'</script>", "<unit id='u&amp;'>", "<measure>iso4217:USD</measure>", "</unit>", "\n", "</ b>", "<", "&lt", "<ix:nonFraction contextref='' name>"]
    quick = 0
    for _ in range(3000):
        source = "".join(r.choice(pieces) for _ in range(r.randrange(1, 14)))
        got, fed = facts(source, True)
        quick += not fed
        assert got == facts(source, False)[0], source
    assert quick > 300


def test_silences_by_buckets(spark, tmp_path):
    """Keys of one bucket keep their own spells, with texts as keys too, and Python is called per bucket."""
    r = random.Random(11)
    at = {f"u{k}": sorted(r.randrange(0, 400) for _ in range(r.randrange(1, 40))) for k in range(30)}
    for name, low, high in (("a", 0, 150), ("b", 150, 260), ("c", 260, 401)):
        rows = [(k, m) for k, ms in at.items() for m in ms if low <= m < high]
        spark.createDataFrame(rows, "u string, m int").select("u", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    want, top = [], max(m for ms in at.values() for m in ms)
    for k, ms in at.items():
        cuts = [0, *[i for i in range(1, len(ms)) if ms[i] - ms[i - 1] > 20], len(ms)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e < len(ms) or ms[e - 1] + 20 < top - 10:
                want.append((k, *(1_700_000_000_000_000 + m * 60_000_000 for m in (ms[s], ms[e - 1])), e - s))
    for buckets in (1, 4):
        rows = progress.silences(progress.read_events(spark, f"{tmp_path}/e"), "u", 20 * 60_000, buckets=buckets)
        assert sorted(tuple(x) for x in progress.run_once(rows, mode="append").collect()) == sorted(want)


def test_slices_of_arrow_batches(spark):
    """However many rows a batch has, a scorer and the automaton get a bounded number of them."""
    from quire.operators import flags, models

    rows = spark.range(3000, numPartitions=1).select(F.col("id"), F.concat(F.lit("may be "), F.col("id").cast("string")).alias("sentence"))
    asked = models.classify(rows, scorer=lambda texts: [("positive", 1.0)] * len(texts) if len(texts) <= 1_024 else 1 / 0)
    assert [(x.id, x.label) for x in asked.collect()] == [(k, "positive") for k in range(3000)]
    hits = rows.select(F.size(flags.term_hits(F.col("sentence"), [("may", False)])).alias("n")).collect()
    assert [x.n for x in hits] == [1] * 3000


def test_words_and_sentences_are_cut_once(spark):
    """Neighbours and the sentiment pass read what was cut from a table."""
    from quire import queries

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "split(" not in scans(queries.token_jaccard_pairs(spark, "/root/testdata/sf0.001"))
    x, y = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    assert spark.range(1).select(T.jaccard(x, y).alias("j"), T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("e")).first() == (1 / 3, 1.0)
