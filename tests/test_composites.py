"""Small cases of what is made of several operators, and of rules that queries alone don't pin down."""

import json
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.functions import sequences
from quire.operators import analysis, cache, chunks, composites, evidence, flags, ingest, insights, priors, redline, relevance, report, scoring, similarity
from quire.sources import files, pages
from quire.sources import json as json_rows
from quire.streaming import progress


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stand-in models go to workers


def plain_flags(a, b):
    """Longest common subsequence by the full table; where two are as long, the first list is advanced."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    x, y, i, j = [False] * len(a), [False] * len(b), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            x[i] = y[j] = True
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return x, y


def test_matches_of_sequences():
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcdef") for _ in range(r.randrange(20))] for _ in range(2))
        assert redline.matched_flags(a, b) == plain_flags(a, b)
    # long equal runs, and more edits than fronts that are kept
    for size, kinds in ((300, 4), (300, 40), (900, 900)):
        a = [r.randrange(kinds) for _ in range(size)]
        b = [x for x in a if r.random() > 0.1] + [r.randrange(kinds) for _ in range(size // 9)]
        assert redline.matched_flags(a, b) == plain_flags(a, b)
    a = list(range(100_000))
    b = [x for x in a if x % 1_000]
    assert sum(redline.matched_flags(a, [-1, *b])[1]) == len(b)
    assert redline.one_to_one([(0.5, 0, 0), (0.9, 0, 1), (0.9, 1, 1), (0.5, 1, 0)]) == [(0.9, 0, 1), (0.5, 1, 0)]


def test_sets_that_are_alike(spark):
    """Pairs by the first tokens of each are all pairs, as sets in memory and as rows."""
    r = random.Random(2)
    left, right = ([[f"t{k}" for k in r.sample(range(30), r.randrange(0, 9))] for _ in range(50)] for _ in range(2))
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    rows = lambda sets, name: spark.createDataFrame([(i % 2, i, s) for i, s in enumerate(sets)], f"k int, {name} int, tokens array<string>")
    for least in (0.2, 0.5, 0.8, 1.0):
        want = sorted((jaccard(set(x), set(y)), a, b) for a, x in enumerate(left) for b, y in enumerate(right) if jaccard(set(x), set(y)) >= least)
        assert sorted(sequences.alike_sets([frozenset(x) for x in left], [frozenset(x) for x in right], least)) == want
        if least in (0.2, 0.8):
            got = similarity.similar_sets(rows(left, "a"), rows(right, "r"), "k", least=least).collect()
            assert sorted((x.score, x.a, x.r) for x in got) == [x for x in want if x[1] % 2 == x[2] % 2]
    # one token that all hold makes no pairs to look at
    common = spark.createDataFrame([(i, ["all", f"a{i}", f"b{i}"]) for i in range(200)], "a int, tokens array<string>")
    assert similarity.candidates(common, common.withColumnRenamed("a", "r"), least=0.5).count() == 200


def test_difference_of_sections():
    was = "The first sentence stays as it is. The second one will be changed a lot. This sentence is dropped here."
    now = "The first sentence stays as it is. The second one will be altered a lot. An entirely different thing came."
    d = redline.diff(now, was)
    assert [now[s:e] for s, e in d["added"]] == ["altered", "An entirely different thing came."] and [was[s:e] for s, e in d["removed"]] == ["changed", "This sentence is dropped here."]
    assert (d["added_sentences"], d["removed_sentences"], d["reworded_sentences"]) == (1, 1, 1)
    assert redline.diff(was, was)["pct_changed"] == 0 and redline.diff("", "")["magnitude"] == 0
    whole = redline.diff(now, "")
    assert whole["added_sentences"] == 3 and whole["removed"] == []
    # by vectors: nearly equal sentences are cosmetic, others of one direction are reworded
    same = lambda new, old: [[0.99, 0.1], [0.1, 0.85]]
    two = redline.diff("One sentence that is quite long. Another sentence that is long.", "A sentence, which is quite long. Some other text that is long.", reworded=0.82, cosmetic=0.97, similarity=same)
    assert (two["cosmetic_dropped"], two["reworded_sentences"], two["added_sentences"]) == (1, 1, 0)


def test_comparison_of_filings(spark):
    schema = "doc int, section_id string, ord int, text string"
    long = "Sales of the company grew in every region of the world last year. "
    now = spark.createDataFrame([(1, "item_7_mdna", 1, long * 2), (1, "item_1a_risk_factors", 2, "A new risk that nobody saw before."), (1, "item_2_properties", 3, "Not compared at all."), (2, "item_2_properties", 1, "x"), (3, "item_7_mdna", 1, long + "Costs rose as well, by about the same.")], schema)
    was = spark.createDataFrame([(1, "item_7_mdna", 1, long), (3, "part_9_discussion", 5, long + "Costs fell as well, by about the same.")], schema)
    got = {(r.doc, r.section_id): r for r in redline.compare_filings(now, was, "doc").collect()}
    assert {k: r.status for k, r in got.items()} == {(1, "item_7_mdna"): "matched", (1, "item_1a_risk_factors"): "added", (2, None): "unsupported_form", (3, "item_7_mdna"): "matched"}
    assert got[1, "item_1a_risk_factors"].added_sentences == 1 and got[3, "item_7_mdna"].reworded_sentences == 1 and got[2, None].summary is None


def test_chunks_end_at_borders():
    text = "word " * 300 + ". " + "More text stands here. " * 300 + "\n\n" + "x" * 5000
    got = chunks.chunk(text)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(got, got[1:], strict=False))
    assert all(e - s <= chunks.MOST for s, e in got) and all(text[s] not in chunks.BLANKS and text[e - 1] not in chunks.BLANKS for s, e in got)
    assert chunks.chunk("") == [] and chunks.chunk(" \n ") == [] and chunks.pieces("short", 10) == ["short"]
    joined = "".join(chunks.pieces(text, 700))
    assert joined.replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "") and max(map(len, chunks.pieces(text, 700))) <= 702


def test_organisations():
    data = [{"@type": "Thing"}, {"publisher": {"@type": ["NewsOrganization"], "name": " Acme "}}, {"@type": "Corporation", "name": "Later"}]
    assert ingest.organisation(data) == "Acme" and ingest.organisation({"@type": "Corporation", "name": "  "}) is None and ingest.organisation("x") is None
    deep = {"@type": "Organization", "name": "Deep"}
    for _ in range(4):
        deep = {"publisher": deep}
    assert ingest.organisation(deep) == "Deep" and ingest.organisation({"publisher": deep}) is None


@pytest.mark.parametrize(
    "quote", ["gross margin fell", "restructuring charges", "plan works well enou", "Gross  margin", "“restructuring”", "ucturing char", "rgin fell — beca", "well enough, of course, for everyone here", "12.5% to $3,400", "structuring ch"]
)
def test_quotes_of_any_length(spark, quote):
    text = "In that year gross margin fell - because of \"restructuring\" charges. The restructuring charges ended. The plan works well enough, of course, for everyone here; up 12.5% to $3,400."
    docs = spark.createDataFrame([(1, 1, "Nothing of it stands here."), (2, 1, "An opening."), (2, 2, text)], "doc int, ord int, text string")
    got = evidence.find_quotes(spark.createDataFrame([(7, quote)], "id int, quote string"), docs, "id", "doc").collect()
    assert [(r.id, r.doc, r.ord) for r in got] == [(7, 2, 2)]
    plain = lambda s: " ".join(s.lower().replace("“", '"').replace("”", '"').replace("—", "-").split())
    assert plain(text[got[0].start : got[0].end]) == plain(quote)


def test_quotes_that_are_not_there(spark):
    docs = spark.createDataFrame([(1, 1, "gross margin fell sharply")], "doc int, ord int, text string")
    quotes = spark.createDataFrame([(1, "margin rose sharply"), (2, "short"), (3, "------------------"), (4, None), (5, ""), (6, "gross margin fell sharply today")], "id int, quote string")
    assert evidence.find_quotes(quotes, docs, "id", "doc").count() == 0


def test_insights_keep_only_what_is_evidenced(spark):
    src = spark.createDataFrame([(1, 0, "Revenue grew 12% to $400 million on strong demand.")], "doc int, ord int, text string")
    rows = [(1, 1, "Revenue", "T one", "Revenue grew 12%.", "", "", "High", "grew 12% to $400 million"), (1, 2, "Revenue", "Sales rose 99% in one year", "Sales rose 99%.", "", "It matters.", "High", None), (1, 3, "Revenue", "T three", "Demand is strong.", "", "", "High", "a quote nobody ever said"), (1, 4, "Revenue", "T", "You should buy now.", "", "", "High", None)]
    made = spark.createDataFrame(rows, "doc int, pos int, category string, title string, summary string, why string, meaning string, confidence string, evidence string")
    got = {r.pos: r for r in evidence.finalise(made, src, "doc", quote="evidence", within=("pos",)).collect()}
    assert set(got) == {1, 2, 3} and (got[1].confidence, got[1].quote_start, got[1].evidence) == ("High", 8, "grew 12% to $400 million")
    assert got[2].confidence == "Low" and got[2].summary == "" and got[3].confidence == "Low" and got[3].evidence is None


def test_priors(spark):
    rows = spark.createDataFrame(
        [("c", "a1", "2022-01-01", "2022-12-31", "10-K", "d"), ("c", "a2", "2023-01-01", "2023-12-31", "10-K", "d"), ("c", "a3", "2023-02-01", "2024-06-30", "10-K/A", "d"), ("c", "a4", "2023-02-01", "2024-12-31", "10-K", "d"), ("c", "a5", "x", "2021-12-31", "10-K", ""), ("e", "b1", "", "2024-12-31", "10-K", "d"), ("f", "g1", "", "2024-12-31", "10-K", "d"), ("f", "g2", "", "2024-12-31", "10-K", "d")],
        "cik string, accession string, filing_date string, report_date string, form string, document string",
    )
    older = spark.createDataFrame([("e", "b0", "", "2020-12-31", "10-K", "d"), ("c", "a0", "", "2024-11-30", "10-K", "d")], rows.schema)
    asked = spark.createDataFrame([("c", "10-K", "December 31, 2024"), ("e", "10-K", "2024-12-31"), ("f", "10-K", "2024-12-31"), ("z", "10-K", None)], "cik string, wanted_form string, period string")
    got = {r.cik: r for r in composites.resolve_priors(asked, rows, older, "cik").collect()}
    assert {k: r.accession for k, r in got.items()} == {"c": "a2", "e": "b0", "f": "g1"} and got["c"].url == "https://www.sec.gov/Archives/edgar/data//a2/d"
    unknown = composites.resolve_priors(asked.withColumn("period", F.lit("some day")), rows, older, "cik").collect()
    assert {r.cik: r.accession for r in unknown} == {"c": "a2", "e": "b0", "f": "g1"}
    assert spark.range(1).select(priors.usable(F.lit("10-K/A"), F.lit("a"), F.lit("d"), F.lit("10-K")).alias("u")).first().u is False


STATEMENTS = [(1, "item_7_mdna", 1, 0, "Revenue grew 12% on new bookings.", 0, 40), (1, "item_7_mdna", 1, 1, "Revenue was flat.", 41, 60), (1, "item_1a_risk_factors", 2, 2, "Litigation risk remains with us.", 0, 30), (1, "item_9b_other", 3, 3, "Nothing to say here.", 0, 20), (2, "item_7_mdna", 1, 0, "Net income and margins rose to $4,100.", 0, 40)]
SCHEMA = "doc int, section_id string, section_order int, sent_idx int, sentence string, start int, end int"


def toward(wanted):
    """An encoder that puts texts with a word near every query, others across."""
    return lambda texts: [[1.0, 0.0] if wanted in t or ":" in t else [0.0, 1.0] for t in texts]


def test_excerpts_by_meaning(spark):
    rows = spark.createDataFrame(STATEMENTS, SCHEMA)
    words = {r.doc: r.excerpt for r in relevance.pack(relevance.scored(rows, ["revenue"], "doc"), 40, "doc").collect()}
    assert words == {1: "Revenue grew 12% on new bookings."}
    flat = composites.semantic_excerpts(rows, ["revenue"], 20, "doc", encoder=toward("flat"))
    assert {r.doc: r.excerpt for r in flat.collect()} == {1: "Revenue was flat."}

    def broken(texts):
        raise RuntimeError("no model")

    def fewer(texts):
        return toward("flat")(texts) if ":" in texts[0] else []

    for encoder in (None, broken, fewer):  # no model, one that fails, one that fails later: the keywords' order stands
        got = composites.semantic_excerpts(rows, ["revenue"], 40, "doc", encoder=encoder)
        assert {r.doc: r.excerpt for r in got.collect()} == words


def card_for_some(prompt):
    stage, _, body = prompt.partition("\n")
    if "margins rose" in body:
        return None
    if stage == "risks":
        raise RuntimeError("fails here")
    return json.dumps({"items": [{"title": "On growth", "summary": "Revenue grew 12%.", "label": "Odd", "severity": "High", "confidence": "High", "evidence": "grew 12% on new"}]}) if stage in ("snapshot", "revenue") else "no JSON"


def test_staged_analysis(spark):
    rows = spark.createDataFrame(STATEMENTS, SCHEMA)
    floor = analysis.dimension_cards(rows, 2, "doc")
    cards, docs = composites.staged_analysis(rows, floor, "doc", model=card_for_some)
    assert {r.doc: r.degraded for r in docs.collect()} == {1: False, 2: True}
    got = {(r.doc, r.stage, r.pos): (r.source, r.title, r.severity, r.confidence) for r in cards.collect()}
    assert got[1, "revenue", 1] == ("model", "On growth", "High", "High") and not [k for k, v in got.items() if k[0] == 2 and v[0] == "model"]
    assert got[1, "risks", 1][0] == "floor" and {k[1] for k in got if k[0] == 2} >= {"margins"}
    alone, docs = composites.staged_analysis(rows, floor, "doc")
    assert {r.source for r in alone.collect()} == {"floor"} and docs.where("not degraded").count() == 0


def test_summaries_of_sections(spark):
    text = "The first sentence is about sales in the north. The second sentence is about sales in the south. A third one is about something else."
    sections = spark.createDataFrame([(1, "a", text), (1, "b", "too short"), (2, "a", None), (3, "a", text), (4, "a", "x " * 300)], "doc int, section_id string, text string")
    store = spark.createDataFrame([(3, "a", "extractive", "kept", [(0, 4)], "2024-01-01")], "doc int, section_id string, register string, summary string, anchors array<struct<start:int,end:int>>, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    told, after = composites.summarise(sections, store, "builtin", "doc", "section_id", model=lambda p: " note " if "south" in p else None)
    got = {(r.doc, r.section_id): r for r in told.collect()}
    assert (got[1, "a"].register, got[1, "a"].summary, got[1, "a"].from_cache) == ("builtin", "note", False) and got[3, "a"].from_cache and got[3, "a"].summary == "kept"
    assert got[1, "b"].register == "extractive" and got[1, "b"].summary == "too short" and got[2, "a"].summary == "(empty section)" and got[4, "a"].summary == ("x " * 300).strip()
    assert {(r.doc, r.section_id, r.register) for r in after.collect()} == {(1, "a", "builtin"), (1, "b", "extractive"), (2, "a", "extractive"), (3, "a", "extractive"), (4, "a", "extractive")}
    plain, _ = composites.summarise(sections.where("doc = 1 and section_id = 'a'"), store, "extractive", "doc", "section_id")
    row = plain.first()
    assert row.register == "extractive" and all(text[a.start : a.end] in row.summary for a in row.anchors)


def test_notes_and_digests(spark):
    say = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert say(insights.why_it_matters(F.lit("A lawsuit may follow"), F.lit("revenue"))) == "It tells what comes in. The wording is a lawyer's. The wording leaves room."
    assert say(insights.why_it_matters(F.lit("x"), F.lit("margins"))) == insights.SUBJECT["margins"] and say(insights.why_it_matters(F.lit("x"), F.lit("none"))) == ""
    zero = F.lit(0)
    assert say(insights.what_it_means(F.lit("Sales grew"), F.lit(True), zero, zero, F.lit("Neutral"))) != say(insights.what_it_means(F.lit("Sales grew"), F.lit(False), zero, zero, F.lit("Neutral")))
    assert say(insights.what_it_means(F.lit("x"), F.lit(False), F.lit(3), F.lit(-1), F.lit("Bearish"))).endswith("bad.") and say(insights.what_it_means(F.lit("x"), F.lit(False), F.lit(2), F.lit(-1), F.lit("Bearish"))) == ""
    lines = say(insights.digest_lines(F.lit("head"), {"risk": F.array(*[F.lit(str(i)) for i in range(6)]), "narrative": F.array(*[F.lit(str(i)) for i in range(6)]), "none": F.lit(None).cast("array<string>")}))
    assert lines == ["head", *[f"[risk] {i}" for i in range(4)], *[f"[narrative] {i}" for i in range(3)]]
    told = say(analysis.hints(F.lit("Revenue $1B"), F.lit(4), F.lit(1), F.lit(2), F.array(F.struct(F.lit("weak_modal").alias("type"), F.lit(2).alias("n"))), F.array(F.lit("Risk"))))
    assert told == "Facts: Revenue $1B\nTone: 25 % positive, 50 % negative of 4 sentences\nFlags: weak modal 2\nChanged: Risk"
    assert say(report.shown_passages(F.array(F.lit("a  b"), F.lit("c" * 300)), 6, 220)) == ["a b", "c" * 220 + "…"] and say(report.escaped(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"


def test_flags_of_a_users_own_lexicon(spark):
    docs = spark.createDataFrame([(1, "The § 10 rule, re-brand and Foo foo."), (2, "nothing")], "doc int, text string")
    terms = spark.createDataFrame([("own", "§ 10", "", False), ("own", "re-brand", "", False), ("own", "Foo", "", True)], "type string, term string, note string, case_sensitive boolean")
    got = sorted((r.doc, r.term, r.start) for r in flags.flag(docs, terms, "doc").collect())
    assert got == [(1, "Foo", 28), (1, "re-brand", 15), (1, "§ 10", 4)]
    assert "CartesianProduct" not in flags.flag(docs, terms, "doc")._jdf.queryExecution().toString() and "NestedLoop" not in flags.flag(docs, terms, "doc")._jdf.queryExecution().toString()


def test_every_hit_of_many_terms():
    """The automaton finds what an expression a term finds, also where terms overlap and with five thousand of them."""
    import re
    import time

    r = random.Random(3)
    some = ["a", "a a", "ab", "b-c", "a ab", "Ab", "%x", "c.", "é", "A"]
    terms = [(t, t != t.lower()) for t in some]
    automaton = flags.Automaton(terms)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", "ab", "A", "Ab", " ", " ", "-", "c", ".", "%x", "é", "İ", "K", "_"]) for _ in range(r.randrange(30)))
        want = sorted((k, *m.span()) for k, (t, cased) in enumerate(terms) for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])", text, re.ASCII | (0 if cased else re.I)))
        assert sorted(automaton.hits(text)) == want, text
    assert flags.Automaton([]).hits("x") == [] and flags.Automaton([("", False)]).hits("x") == []
    words = [f"w{r.randrange(10**6)}" for _ in range(5_000)]
    text = " ".join(r.choice(words) if r.random() < 0.05 else f"v{r.randrange(10**6)}" for _ in range(200_000))
    many, start = flags.Automaton([(w, False) for w in words]), time.process_time()
    assert len(many.hits(text)) > 9_000 and time.process_time() - start < 5


def test_layers_of_the_lexicon(spark):
    from quire.plans import registry as R

    assert R.layered([("t", "Loss", "first", True)], [("t", "loss", "second", False), ("u", "loss", "other", False)]) == [("t", "Loss", "first", True), ("u", "loss", "other", False)]
    assert R.inflected("vary") == ["vary", "varies", "varied", "varying"] and R.inflected("breach")[1] == "breaches" and R.inflected("imply")[2] == "implied"
    notes = {r.term: r.note for r in flags.lexicon(spark).where("type = 'negative'").collect()}
    assert notes["decline"] == notes["shortfall"] != notes["declines"]  # a phrase's note stands where both layers have the term
    assert flags.lexicon(spark, words=False).count() == len(R.PHRASES) < flags.lexicon(spark, [("own", "x", "", False)]).count() - 300


def test_quotes_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, 1, f"The gross margin of year {k} rose sharply, to {k} percent.") for k in range(30)] + [(99, 1, None)], "doc int, ord int, text string")
    quotes = spark.createDataFrame([(k, f"margin of year {k} rose") for k in range(30)] + [(100 + k, f"margin of year {k} rose") for k in range(3)], "id int, quote string")
    want = sorted([(k, k) for k in range(30)] + [(100 + k, k) for k in range(3)])
    for most in (100_000, 7):
        monkeypatch.setattr(evidence, "BLOCK_QUOTES", most)
        assert sorted((r.id, r.doc) for r in evidence.find_quotes(quotes, docs, "id", "doc").collect()) == want


def test_stores(spark):
    ev = spark.createDataFrame([(1, "a", 1, 10), (1, "a", 2, 20), (2, "a", 3, 5)], "k int, v string, seq int, ts int")
    assert [(r.seq, r.aborted) for r in cache.last_in_flight(ev, "k").orderBy("seq").collect()] == [(1, True), (2, False), (3, False)]
    assert sorted((r.k, r.replayed) for r in cache.replay(ev.where("k = 1"), ev, "k").collect()) == [(1, True), (1, True), (2, False)]
    assert cache.drop_all(ev)[0].count() == 0 and cache.session_of(ev, ev.where("seq = 3"), "k").count() == 1


def test_streams_keep_state_over_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, float(i), "x") for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "event_id bigint, ts string, user_id bigint, value double, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    s = progress.running_means(progress.read_events(spark, f"{tmp_path}/e"), "user_id", order=("ts", "event_id"))
    out = progress.run_once(s, "update", f"{tmp_path}/state")
    batches = {p.name for p in (tmp_path / "state" / "batches").iterdir()}
    assert len(batches) == 3 and out.count() == 9  # each batch tells of each user
    last = {r.user_id: (r.n, r["mean"]) for r in out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("mean", "n").alias("mean")).collect()}
    for u in range(3):
        mean = None
        for i in range(u, 30, 3):
            mean = float(i) if mean is None else mean * 0.7 + i * 0.3
        assert last[u][0] == 10 and abs(last[u][1] - mean) < 1e-9


def test_batches_are_folded_into_a_table_once(spark, tmp_path):
    """Given twice, again later, or after a failure halfway, a batch counts once; readers never see half of one."""
    from quire.streaming.sinks import FoldedTable

    schema = "k string, n bigint, top int"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    table = FoldedTable(spark, str(tmp_path / "t"), batch(("a", 1, 1)).schema, ["k"], {"n": F.sum("n"), "top": F.max("top")}, buckets=4)
    now = lambda t=table: sorted(map(tuple, t.current(spark).collect()), key=str)
    assert now() == []
    first = batch(("a", 1, 5), ("a", 1, 2), ("b", 1, None), (None, 1, 7))
    for _ in range(2):
        table.merge(first, 0)
    assert now() == sorted([("a", 2, 5), ("b", 1, None), (None, 1, 7)], key=str)
    # rows of a batch that failed before it was told to the ledger are not seen, and written over later
    spark.createDataFrame([("a", 99, 99, 1, 0), ("z", 9, 9, 1, 3)], schema + ", version int, bucket int").write.mode("append").partitionBy("version", "bucket").parquet(table.rows)
    assert len(now()) == 3 and ("a", 2, 5) in now()
    table.merge(batch(("a", 10, 1), ("c", 1, 1)), 1)
    table.merge(first, 0)
    again = FoldedTable(spark, str(tmp_path / "t"), first.schema, ["k"], {"n": F.sum("n"), "top": F.max("top")}, buckets=4)  # another job
    again.merge(batch(("a", 10, 1), ("c", 1, 1)), 1)
    assert now() == now(again) == sorted([("a", 12, 5), ("b", 1, None), ("c", 1, 1), (None, 1, 7)], key=str)
    again.merge(batch(), 2)
    assert len(now()) == 4


def test_sentiment_pass(spark):
    """The model sees each new sentence once, in batches by length; a call that fails leaves its own texts; the store is used and filled."""
    texts = ["Sales grew and margins improved a lot. Nothing else was said here. Losses were feared by everyone.", "Sales grew and margins improved a lot. A bad apple spoils the whole model.", "Stored long ago, as it was told."]
    rows = [(i, f"h{i}", "item_1a_risk_factors" if k else "item_7_mdna", 9 - k, 1_000 * k, t, None) for i, t in enumerate(texts) for k in range(2)]
    sections = spark.createDataFrame(rows, "doc int, text_hash string, section_id string, section_order int, start int, text string, tables array<struct<s:int,e:int>>").coalesce(1)
    kind = "text_hash string, model string, results array<struct<place:int,section_id:string,sent_idx:int,label:string,score:double,start:int,end:int>>"
    store = spark.createDataFrame([("h2", "m", [(1, "x", 0, "positive", 0.9, 0, 5)]), ("h1", "another", [(1, "x", 0, "positive", 0.9, 0, 5)])], kind)
    calls, loads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def model(batch):
            calls.add(1)
            if any("bad apple" in t for t in batch):
                raise RuntimeError("no")
            assert [len(t) for t in batch] == sorted(len(t) for t in batch)
            return [("POSITIVE", 0.8 if "grew" in t else 0.4) for t in batch]

        return model

    results, records = scoring.sentiment_pass(sections, store, "doc", model="m", load=load, tables="tables")
    got = sorted((r.doc, r.place, r.sent_idx, r.label, r.start, r.degraded, r.cached) for r in results.collect())
    assert [(x[1], x[2]) for x in got if x[0] == 0] == [(p, i) for p in (1, 2) for i in range(3)]
    assert [x[1:] for x in got if x[0] == 2] == [(1, 0, "positive", 0, False, True)]  # stored, whatever the sections
    assert all(x[3] == "neutral" and x[5] for x in got if x[0] < 2)  # all four texts were in the call that failed
    assert records.count() == 0 and calls.value == 1 and loads.value == 1
    results, records = scoring.sentiment_pass(sections.where("doc <> 1"), store, "doc", model="m", load=load)
    assert [(r.text_hash, len(r.results)) for r in records.collect()] == [("h0", 6)] and results.count() == 7 and calls.value == 2
    again, none = scoring.sentiment_pass(sections.where("doc <> 1"), store.unionByName(records), "doc", model="m", load=load)
    assert sorted(map(tuple, again.drop("cached").collect())) == sorted(map(tuple, results.drop("cached").collect())) and none.count() == 0 and calls.value == 2
    few = scoring.score_texts(sections.select(F.col("text").alias("sentence")).unionByName(spark.createDataFrame([(None,)], "sentence string")), load, batch=1)
    told = few.collect()
    assert [r.degraded for r in told if r.sentence is None] == [True] and {r.degraded for r in told if r.sentence == texts[0]} == {False} and {r.degraded for r in told if r.sentence == texts[1]} == {True}


def test_silence_is_told_without_a_next_event(spark, tmp_path):
    minute = 60_000_000
    at = {"a": [0, 5, 8, 60, 62, 300], "b": [1, 299], "c": [2, 3], None: [4]}
    since = 1_700_000_000_000_000
    rows = [(u, m) for u, ms in at.items() for m in ms]
    for low, high in ((0, 59), (59, 290), (290, 999)):
        part = [(u, since + m * minute) for u, m in rows if low <= m < high] + [("a", None)]
        spark.createDataFrame(part, "u string, us bigint").select("u", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    told = progress.run_once(progress.silences(progress.read_events(spark, f"{tmp_path}/e"), "u", 30 * 60_000), mode="append")
    got = sorted((r.u, (r.first_us - since) // minute, (r.last_us - since) // minute, r.n) for r in told.collect())
    assert got == [("a", 0, 8, 3), ("a", 60, 62, 2), ("b", 1, 1, 1), ("c", 2, 3, 2)]  # what is open within the last half hour is not told


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.bin").write_bytes(b"page one  \nx\fpage two")
    texts = files.read_texts(spark, f"{tmp_path}/*.txt").collect()
    assert [r.text for r in texts] == ["one\ntwo"]
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe broken")
    (tmp_path / "d.bin").write_bytes(b"x" * 500)
    docs = files.read_documents(spark, f"{tmp_path}/*.bin")
    got = {r.path[-5:]: (r.text, r.pages, r.error and r.error.split(":")[0]) for r in pages.paged_texts(docs, "path", most_bytes=400).collect()}
    assert got == {"b.bin": ("page one\nx\n\npage two", 2, None), "c.bin": (None, 0, "UnicodeDecodeError"), "d.bin": (None, 0, "larger than 400 bytes")}
    odd = spark.createDataFrame([(1, None, None), (2, 0, b"")], "k int, length bigint, content binary")
    assert sorted(map(tuple, pages.paged_texts(odd, "k").collect())) == [(1, "", 0, None), (2, "", 1, None)]


def test_texts_to_documents(spark):
    """Files of different forms, one broken, through detection, sections and cover."""
    ten_k = "Firm A\n(Exact name of registrant as specified in its charter)\nFORM 10-K\nFor the fiscal year ended June 30, 2022\fITEM 1. Business\n" + "We sell. " * 40 + "\nITEM 1A. Risk Factors\n" + "It may rain. " * 40
    s_1 = "FORM S-1\n  RISK FACTORS here\nfirst part\nUSE OF PROCEEDS\nlast words"
    rows = [(1, ten_k.encode(), None), (2, s_1.encode(), None), (3, b"\xff", None), (4, b"A plain letter.", None), (5, b"", None), (6, ten_k.encode(), "https://x.com/a-8-k_b.htm")]
    files_ = spark.createDataFrame(rows, "doc int, content binary, url string").withColumn("length", F.octet_length("content"))
    docs, sections = ingest.ingest_texts(files_, "doc", url="url")
    got = {r.doc: r for r in docs.collect()}
    assert {k: (r.form, r.n_sections) for k, r in got.items() if k != 6} == {1: ("10-K", 2), 2: ("S-1", 2), 3: ("UNKNOWN", 0), 4: ("UNKNOWN", 1), 5: ("UNKNOWN", 0)}
    assert (got[1].company, got[1].period, got[1].pages) == ("Firm A", "2022-06-30", 2) and got[3].error and got[6].form == "8-K"
    ids = {(r.doc, r.section_id) for r in sections.collect()}
    assert {(1, "item_1_business"), (1, "item_1a_risk_factors"), (2, "s1_use_of_proceeds"), (4, "document_body")} <= ids
    whole = {r.doc: r.text for r in docs.collect()}
    assert all(whole[r.doc][r.start : r.end].strip() == r.text for r in sections.collect())


def test_reports_of_all_parts(spark):
    """Parts in their order, ordered within; empty ones are empty lists; what has no document is left out."""
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "doc int, source string")
    flags_ = spark.createDataFrame([(1, 30, 'say "no"'), (1, 4, "x"), (3, 1, "orphan")], "doc int, start int, term string")
    bare = spark.createDataFrame([(1,)], "doc int")
    got = {r.doc: json.loads(r.report) for r in report.assemble(docs, {"flags": (flags_, "start"), "none": (flags_.limit(0), None), "bare": (bare, None)}, "doc").collect()}
    assert got == {1: {"source": "a", "flags": [{"start": 4, "term": "x"}, {"start": 30, "term": 'say "no"'}], "none": [], "bare": [{}]}, 2: {"flags": [], "none": [], "bare": []}}
    only = report.assemble(docs.select("doc").distinct(), {"flags": (flags_, "start")}, "doc")
    assert {r.doc: len(json.loads(r.report)["flags"]) for r in only.collect()} == {1: 2, 2: 0}


def test_json_that_does_not_parse(spark):
    rows = spark.createDataFrame([(1, '{"k": 1, "o": {"x": "a"}}', "c"), (2, '{"k": 2, "o": {"x": "a"}', "c"), (3, None, "c"), (4, "", "c"), (5, '{"k": "x"}', "c"), (6, "{}", "c"), (7, "[1", "c")], "id int, json string, _broken string")
    kind = "k bigint, o struct<x:string>"
    read, rejected = json_rows.parsed(rows, kind)
    assert sorted((r.id, r.parsed and r.parsed.k) for r in read.collect()) == [(1, 1), (3, None), (6, None)] or sorted((r.id, r.parsed and r.parsed.k) for r in read.collect()) == [(1, 1), (3, None), (4, None), (6, None)]
    assert {r.id for r in rejected.collect()} >= {2, 5, 7} and read.count() + rejected.count() == 7 and rejected.columns == rows.columns
    assert json_rows.parsed_strictly(rows.where("id in (1, 3, 6)"), kind).count() == 3
    with pytest.raises(Exception, match="(?i)malformed"):
        json_rows.parsed_strictly(rows.where("id = 2"), kind).collect()


def test_vectors_of_a_comparison():
    sim = redline.cosines(lambda texts: [[1.0, 0.0] if "a" in t else [0.0, 1.0] for t in texts])
    assert np.allclose(sim(["a", "b"], ["a"]), [[1.0], [0.0]])


def test_sections_by_headings(spark):
    from quire.operators import segment

    page = "<p>Opening words that are long enough to count as one.</p><h1>About <b>us</b></h1><p>We are a company.</p><h2>!</h2><h2>News</h2><p>About us: news.</p><h3>About us</h3>"
    text = "Opening words that are long enough to count as one.\n\nAbout us\n\nWe are a company.\n\n!\n\nNews\n\nAbout us: news.\n\nAbout us"
    docs = spark.createDataFrame([(1, page, text), (2, "<p>plain</p>", "plain"), (3, "", None), (4, "<p>short</p><h1>T</h1><p>body</p>", "short\n\nT\n\nbody")], "doc int, html string, text string")
    got = sorted((r.doc, r.section_order, r.section_id, r.label, r.text) for r in segment.heading_texts(docs, "doc").collect())
    assert got == [
        (1, 0, "report_0_preamble", "Preamble", "Opening words that are long enough to count as one."), (1, 1, "report_1_about_us", "About us", "We are a company."), (1, 3, "report_3_news", "News", "About us: news."),
        (2, 0, "document_body", "Preamble", "plain"), (4, 1, "report_1_t", "T", "body"),
    ]
    assert all(r.text in (text, "plain", "short\n\nT\n\nbody")[{1: 0, 2: 1, 4: 2}[r.doc]][r.start : r.end] for r in segment.heading_texts(docs, "doc").collect())
