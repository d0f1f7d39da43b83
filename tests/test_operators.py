"""Small literal cases of the document operators."""

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import text as T
from quire.operators import cache, chunks, classify, evidence, facts, flags, insights, models, priors, redline, relevance, report, segment, sentences, sentiment, vectors
from quire.sources import files, html


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Acme Inc. reported strong growth this year. Sales at Corp. No. 5 rose by 3.2% today.", ["Acme Inc. reported strong growth this year.", "Sales at Corp. No. 5 rose by 3.2% today."]),
        ("The U.S. economy grew by $1.5 billion here! Was it (really so?) Then it stopped short of it", ["The U.S. economy grew by $1.5 billion here!", "Was it (really so?)", "Then it stopped short of it"]),
        ("", []), ("Too short.", []), ("A tail without any stop at all", ["A tail without any stop at all"]),
    ],
)
def test_sentences(spark, text, want):
    if "really so" in text:
        want = [w for w in want if len(w) >= 20]
    got = one(spark, T.sentence_spans(F.col("t")), t=text)
    assert [g.text for g in got] == want
    assert all(text[g.start : g.end] == g.text for g in got)
    assert [text[s:e] for s, e in redline.split_sentences(text)] == want


def test_numbers(spark):
    assert one(spark, N.fact_value(F.col("t"), F.lit("6"), F.lit("-")), t="(1,234.5)") == -1234500000.0
    assert one(spark, N.fact_value(F.col("t"), F.lit(None).cast("string"), F.lit(None).cast("string")), t="n/a") is None
    assert one(spark, N.money(F.lit(-2.5e9)), t="") == "-$2.50B"
    assert one(spark, N.percent(F.lit(1), F.lit(0)), t="") == 0


def test_figures_and_dates(spark):
    assert one(spark, T.figure_cores(F.col("t")), t="Up 12% to $1,300 from 950; in 2024, 3.5 and 42.") == ["12", "1300", "2024", "3.5"]
    assert [one(spark, T.iso_date(F.col("t")), t=t) for t in ("September 30, 2023", "3 Mar 2020", "12/1/2021", "tomorrow")] == ["2023-09-30", "2020-03-03", "2021-12-01", None]


def test_segments(spark):
    body = "word " * 600
    text = "ITEM 1. Business\nITEM 1A. Risk Factors\nITEM 7. Discussion\n" + f"ITEM 1. Business\n{body}\nITEM 1A. Risk Factors\n{body}\nITEM 99. Odd\nx\nITEM 7. Discussion\nshort"
    docs = spark.createDataFrame([(1, "10-K", text), (2, "10-K", "no headers here"), (3, "10-K", "")], "doc_id int, form string, text string")
    got = {(r.doc_id, r.section_id): r for r in segment.item_sections(docs, "doc_id").collect()}
    assert {k for k in got if k[0] == 1} == {(1, "item_1_business"), (1, "item_1a_risk_factors"), (1, "item_7_mdna")}
    assert got[1, "item_7_mdna"].text == "short" and (2, "document_body") in got and not any(k[0] == 3 for k in got)
    for (doc, _), r in got.items():
        assert (text if doc == 1 else "no headers here")[r.start : r.end].strip() == r.text
    low = {r.doc_id: r.segmentation for r in segment.confidence(segment.item_sections(docs, "doc_id"), "doc_id").collect()}
    assert low == {1: "low", 2: "low"}
    assert one(spark, segment.is_by_reference(F.lit("item_7_mdna"), F.col("t")), t="The review is incorporated herein by reference.")


def test_titles(spark):
    text = "USE OF PROCEEDS\nearly\n  RISK FACTORS here\nfirst\nUSE OF PROCEEDS\nlast words"
    docs = spark.createDataFrame([(1, text), (2, "DILUTION\nonly one")], "doc_id int, text string")
    got = {(r.doc_id, r.section_id): text[r.start : r.end].strip() for r in segment.title_sections(docs, "S-1", "doc_id").collect()}
    assert got[1, "s1_use_of_proceeds"] == "last words" and got[1, "s1_risk_factors"] == "first" and (2, "document_body") in got


def test_flags(spark):
    text = "We may lose. The actual results could differ materially from what may be said today. maybe"
    docs = spark.createDataFrame([(1, text, 100, [(100, 107)])], "doc_id int, text string, at int, tables array<struct<s:int,e:int>>")
    got = sorted((r.term, r.start, r.boilerplate) for r in flags.flag(docs, flags.lexicon(spark, words=False), "doc_id", offset="at", tables="tables").collect())
    assert got == [("could", 100 + text.index("could"), True), ("may", 100 + text.index("may be"), True)]


def test_sentiment(spark):
    s = spark.createDataFrame([(1, "positive", 0, 10), (1, "negative", 20, 30), (1, "odd", 40, 50)], "doc_id int, label string, start int, end int")
    f = spark.createDataFrame([(1, 25, 26, True), (1, 5, 6, False)], "doc_id int, start int, end int, boilerplate boolean")
    t = sentiment.tally(sentiment.damp(s, f, "doc_id"), "doc_id").first()
    assert (t.positive, t.negative, t.neutral, t.total) == (1, 0, 2, 3)
    assert abs(one(spark, sentiment.adjusted_net(F.lit(0), F.lit(1), F.lit(2), F.lit("item_1a_risk_factors")), t="") + 0.15) < 1e-9
    assert one(spark, sentiment.consensus(F.lit(6), F.lit(1), F.lit(3), F.lit(10)), t="").startswith("The tone is")


def test_relevance(spark):
    rows = [(1, "item_7_mdna", 1, 0, "Revenue grew 12% this year to a record.", 0, 39), (1, "item_1a_risk_factors", 2, 1, "Litigation remains a risk.", 0, 26), (1, "x", 3, 2, "Nothing.", 0, 8)]
    s = spark.createDataFrame(rows, "doc_id int, section_id string, section_order int, sent_idx int, sentence string, start int, end int")
    got = relevance.scored(s, ["revenue", "risk"], "doc_id")
    assert {r.sent_idx: r.score for r in got.collect()} == {0: 5, 1: 3}
    assert relevance.pack(got, 45, "doc_id").first().excerpt == rows[0][4]
    assert one(spark, relevance.dimensions(F.col("t"), F.lit("20-F")), t="Turnover was flat") == ["revenue"]


def test_facts(spark):
    rows = [("e", "us-gaap:Revenues", "2023-12-31", 365, 1, 120.0, "USD", False), ("e", "us-gaap:Revenues", "2023-12-31", 90, 0, 30.0, "USD", False), ("e", "us-gaap:Revenues", "2022-12-31", 365, 2, 100.0, "EUR", False), ("e", "us-gaap:Revenues", "2021-12-31", 365, 3, 80.0, "USD", False), ("e", "us-gaap:Revenues", "2024-12-31", 365, 4, 1.0, "USD", True)]
    f = spark.createDataFrame(rows, "entity string, concept string, period_end string, duration int, seq int, value double, currency string, dimensional boolean")
    r = facts.current_and_prior(f, "entity", "concept").first()
    assert (r.current_value, r.prior_end, r.prior_value, round(r.yoy, 3)) == (120.0, "2021-12-31", 80.0, 0.5)
    assert facts.line_items(facts.current_and_prior(f, "entity", "concept"), "entity").first().label == "Revenue"


def test_priors(spark):
    rows = [("c", "10-K", "a1", "2021-12-31"), ("c", "10-K", "a2", "2022-12-31"), ("c", "10-K", "a3", "2023-12-31"), ("c", "10-Q", "b1", "2023-06-30")]
    f = spark.createDataFrame(rows, "cik string, form string, accession string, report_date string")
    got = {r.accession: r.prior for r in priors.prior_filing(f, "cik", "form").collect()}
    assert got == {"a1": None, "a2": "a1", "a3": "a2", "b1": None}


def test_redline(spark):
    a, b = "The company grew fast in all markets. New plants opened in Ohio this year.", "The company grew slowly in all markets. It sold its old headquarters then."
    d = redline.diff(a, b)
    assert [a[s:e] for s, e in d["added"]] == ["fast", "New plants opened in Ohio this year."] and d["reworded_sentences"] == 1
    assert redline.diff(a, a)["magnitude"] == 0 and redline.diff("", "")["magnitude"] == 0
    assert redline.diff(a, "")["added_sentences"] == 2
    assert redline.matched_flags(list("abcbd"), list("abd")) == ([True, True, False, False, True], [True, True, True])
    rows = spark.createDataFrame([(1, a, b), (2, None, None)], "id int, current_text string, prior_text string")
    got = {r.id: r.summary for r in redline.redline(rows, "id").collect()}
    assert got[2].startswith("The two versions say") and got[1].startswith("1 new sentence, 1 dropped sentence, 1 edited sentence; about ")
    pairs = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.85), (1, 1, 1, 0.1)], "d int, a int, r int, score double")
    assert sorted((p.a, p.r) for p in redline.greedy_pairs(pairs, "d").collect()) == [(0, 0), (1, 1)]


def test_evidence(spark):
    src = spark.createDataFrame([(1, 1, "He said “the  plan – works well” in 2024 for $5.")], "doc_id int, ord int, text string")
    q = spark.createDataFrame([(7, 'said "the plan - works'), (8, "not in there at all"), (9, "short")], "id int, quote string")
    got = evidence.find_quotes(q, src, "id", "doc_id").collect()
    assert [(r.id, r.start) for r in got] == [(7, 3)]
    ins = spark.createDataFrame([(1, "t", "Cash was $5. Debt was $9,999.", "", "Buy the stock.", "High")], "doc_id int, title string, summary string, why string, meaning string, confidence string")
    r = evidence.finalise(ins, src, "doc_id").first()
    assert (r.summary, r.meaning, r.confidence) == ("Cash was $5.", "", "Low")


def test_insights(spark):
    assert one(spark, insights.compact_figure(F.col("t")), t="Sales of $50.3 billion") == "$50.3B"
    assert one(spark, insights.topic_title(F.col("t"), F.lit("Margins")), t="The gross margin was 44% of sales.") == "Gross margin · 44%"
    assert one(spark, insights.is_bad_title(F.lit("The gross margin was"), F.col("t")), t="The gross margin was 44%.")
    rows = spark.createDataFrame([(1, 0, "A", "x"), (1, 1, "a", "up 5% now"), (1, 2, "A", "y")], "d int, pos int, title string, summary string")
    assert [r.title for r in insights.unique_titles(rows, "d").orderBy("pos").collect()] == ["A", "a · 5%", "A (3)"]


def test_chunks_and_vectors(spark):
    text = ("A sentence of words. " * 300).strip()
    got = chunks.chunk(text)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(got, got[1:], strict=False)) and all(e - s <= chunks.MOST for s, e in got)
    assert "".join(chunks.pieces(text, 500)).replace(" ", "") == text.replace(" ", "")
    v = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [1.0, 0.0]), ("g", 3, [-1.0, 0.0]), ("h", 4, [0.0, 1.0])], "g string, vec_id bigint, embedding array<double>")
    assert {r.vec_id: r.score for r in vectors.centrality(v, "g").collect()} == {1: 0.5, 2: 0.5, 3: 0.0, 4: 1.0}


def test_html(spark):
    src = "<body><script>x</script><div>One <b>two</b></div><p hidden>no</p><table><tr><td>a</td><td>b&amp;c</td></tr></table>tail<br>end</body>"
    n = html.normalise(src)
    assert n["text"] == "One two\n\na\n\nb&c\n\ntail\nend"
    assert [n["text"][s:e] for s, e in n["tables"]] == ["a\n\nb&c"]
    assert all(src[a : a + w].split() == n["text"][s : s + k].split() or "&" in src[a : a + w] for a, w, s, k in n["segments"])
    assert html.normalise(None)["text"] == ""
    t = spark.createDataFrame([("Acme Corp\n(Exact name of registrant)\nFor the fiscal year ended December 31, 2023\nTrading Symbol(s)\nACM\n",)], "t string")
    r = t.select(files.cover(F.col("t")).alias("c")).first().c
    assert (r.company, r.period, r.ticker) == ("Acme Corp", "2023-12-31", "ACM")


def test_stores(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, ts int")
    assert [r.k for r in cache.evictions(s, 2, "k").collect()] == ["a"]
    assert cache.delete(s, s.where("ts = 1"), "k").count() == 2
    r = spark.createDataFrame([("u", 0, 0), ("u", 1, 10), ("u", 2, 500)], "u string, seq int, ms bigint")
    assert [x.start for x in cache.limited_starts(r, "u").orderBy("seq").collect()] == [0, 125, 500]
    t = cache.ttl_hits(r, "u", ttl=100).first()
    assert (t.hits, t.misses) == (1, 2)


def test_models_and_reports(spark):
    s = spark.createDataFrame([(1, "Sales grew on strong demand"), (2, "A loss and weak sales"), (3, None)], "id int, sentence string")
    assert {r.id: r.label for r in models.classify(s).collect()} == {1: "positive", 2: "negative", 3: "neutral"}
    assert one(spark, models.json_body(F.col("t")), t='```json\nsure: {"a": 1}\n```') == '{"a": 1}'
    assert one(spark, classify.normal_form(F.col("t")), t="8-k/a") == "8-K"
    assert one(spark, report.file_name(F.col("t"), F.lit("10-K"), F.lit("2024-01-01")), t="A & B") == "report-A-B-10-K-2024-01-01.json"
    assert sentences.lines(spark.createDataFrame([(1, "a\n\nbc")], "d int, text string"), "d").orderBy("ord").collect()[2].start == 3


def test_ingest(spark):
    from quire.operators import analysis, ingest

    page = '<html><head><title>x</title></head><body><ix:nonNumeric name="dei:DocumentType" contextref="c">10-K/A</ix:nonNumeric><ix:nonNumeric name="dei:DocumentPeriodEndDate" contextref="c">December 31, 2023</ix:nonNumeric><script type="application/ld+json">{"publisher": {"@type": "Organization", "name": "Acme"}}</script><p>ITEM 1. Business</p><p>We make things.</p><p>ITEM 1A. Risk Factors</p><p>Things may break.</p></body></html>'
    docs, sections = ingest.ingest(spark.createDataFrame([(1, "https://www.sec.gov/Archives/edgar/data/1/0000000001-24-000001/a.htm", page), (2, None, None)], "page_id int, url string, html string"), "page_id")
    got = {r.page_id: r for r in docs.collect()}
    assert (got[1].category, got[1].form, got[1].confidence, got[1].company, got[1].period, got[1].accession, got[1].n_sections) == ("edgar_filing", "10-K", "high", "Acme", "2023-12-31", "0000000001-24-000001", 2)
    assert (got[2].category, got[2].n_sections, got[2].segmentation) == ("unsupported", 0, "low")
    assert {r.section_id: r.text for r in sections.collect()} == {"item_1_business": "We make things.", "item_1a_risk_factors": "Things may break."}
    assert ingest.organisation([{"@type": "Person", "name": "x"}, {"author": {"@type": "LocalBusiness", "name": " B "}}]) == "B" and ingest.organisation({"a": 1}) is None
    p = ingest.at_position(spark.createDataFrame([(1, 5), (1, 50), (2, 1)], "d int, position int"), spark.createDataFrame([(1, 4, 9, "a"), (1, 5, 6, "b")], "d int, start int, end int, t string"), "d")
    assert {(r.d, r.position): r.t for r in p.collect()} == {(1, 5): "a", (1, 50): None, (2, 1): None}
    f = spark.createDataFrame([(1, "Net income", "USD", -2.0e6, -0.5), (1, "Revenue", "USD", 1.5e9, 0.25), (1, "Other", "USD", 1.0, None)], "d int, label string, unit string, current_value double, yoy double")
    assert analysis.headline(f, "d").first().headline == "Revenue $1.50B (+25.0% YoY), Net income -$2.0M (-50.0% YoY)"


def test_report_holds_every_sentence(spark, tmp_path):
    from quire.queries import QUERIES

    said = [f"Sentence number {w} is long enough to be kept." for w in ("one", "two", "three", "four", "five")]
    spark.createDataFrame([(1, " ".join(said), "en", "a")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for other in ("lineitem", "labels"):  # parts without rows
        spark.read.parquet(f"/root/testdata/sf0.001/{other}.parquet").limit(0).write.parquet(f"{tmp_path}/{other}.parquet")
    (row,) = QUERIES["export_report_rows"](spark, str(tmp_path)).collect()
    assert all(x in row.report for x in said)


def test_guards_read_whole_turns(spark, tmp_path):
    from quire.queries import QUERIES

    text = "Demand was steady through the whole of the year in every region that we serve. " * 2 + "Cash reached the lighthouse."
    spark.createDataFrame([(1, 3, "user", text)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = QUERIES["finalised_insights"](spark, str(tmp_path)).collect()
    assert "lighthouse" in row.summary
