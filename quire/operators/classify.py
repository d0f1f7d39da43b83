"""Kinds of pages, forms and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import host, once

_SEC = r"(?:^|\.)sec\.gov$"
_STORE = r"(?:^|\.)chromewebstore\.google\.com$|^chrome\.google\.com$"
# Forms by what their address holds, the first that fits.
FORM_IN_URL = [
    ("10-K", r"[/_-]10-k[/_A.]"), ("10-Q", r"[/_-]10-q[/_A.]"), ("8-K", r"[/_-]8-k[/_A.]"), ("20-F", r"[/_-]20-f[/_A.]"), ("6-K", r"[/_-]6-k[/_A.]"),
    ("S-1", r"[/_-]s-1[/_A.]"), ("DEF 14A", r"def[_-]?14a"),
]
# Forms by what the upper-cased head of the text holds.
FORM_IN_TEXT = [
    ("10-K", r"ANNUAL REPORT\s*(?:ON\s*)?FORM\s*10-K|FORM\s+10-K\b"), ("10-Q", r"QUARTERLY REPORT\s*(?:ON\s*)?FORM\s*10-Q|FORM\s+10-Q\b"),
    ("8-K", r"CURRENT REPORT\s*(?:ON\s*)?FORM\s*8-K|FORM\s+8-K\b"), ("20-F", r"ANNUAL REPORT\s*(?:ON\s*)?FORM\s*20-F|FORM\s+20-F\b"),
    ("6-K", r"REPORT OF FOREIGN (?:PRIVATE )?ISSUER|FORM\s+6-K\b"), ("DEF 14A", r"NOTICE OF ANNUAL|PROXY STATEMENT|DEF\s*14A"),
    ("S-1", r"REGISTRATION STATEMENT\s+(?:UNDER|ON FORM)|\b(?:ON\s+)?FORM\s+S-1\b|\bFORM\s+S-11\b"),
]
# Sites with a profile.
SITES = "annualreports.com stockanalysis.com fool.com benzinga.com sec.report finviz.com finance.yahoo.com macrotrends.net bamsec.com cnbc.com reuters.com".split()
HEAD = 8000


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_supported(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#]") & ~host(url).rlike(_STORE), F.lit(False))


def is_index(url: Column) -> Column:
    return _path(url).rlike(r"(?i)/Archives/edgar/data/") & _path(url).rlike(r"(?i)-index\.(html?|json)$")


def page_category(url: Column, html: Column) -> Column:
    """The kind of a page, by address, then by inline facts."""
    dei = html.rlike(r"(?i)name=[\"']dei:(?:documenttype|entityregistrantname)[\"']")
    inline = html.rlike(r"(?i)<[^>]+\scontextref=|<ix:header|<ix:nonnumeric")
    search = host(url).rlike(r"(?:^|\.)efts\.sec\.gov$") | url.rlike(r"(?i)/cgi-bin/browse-edgar|/edgar/search|/cgi-bin/srqsb")
    return (
        F.when(~is_supported(url), "unsupported")
        .when(~host(url).rlike(_SEC), "ir_or_financial")
        .when(is_index(url), "edgar_index")
        .when(url.rlike(r"(?i)/Archives/edgar/data/"), "edgar_filing")
        .when(dei, "edgar_filing")
        .when(inline, "edgar_ixbrl")
        .when(search, "sec_search")
        .otherwise("sec_data_report")
    )


def is_readable_non_filing(category: Column) -> Column:
    return category.isin("sec_data_report", "sec_search")


def host_bucket(category: Column) -> Column:
    return F.when(category.isin("ir_or_financial", "unsupported"), "ir").otherwise("edgar")


def injectability(url: Column) -> Column:
    known = F.coalesce(url.rlike(r"^(?i)(?:https?://[^/?#]|file:)"), F.lit(False))
    return F.when(~known | host(url).rlike(_STORE), "unsupported").when(host(url).rlike(_SEC), "auto_host").otherwise("injectable")


def site_profile(url: Column) -> Column:
    """The registered site of an address, or null; the form with ``www.`` counts, but for one that has none."""
    h = host(url)
    bare = F.when(h.isin("www.finance.yahoo.com", "www.efts.bamsec.com"), h).when(h == "efts.bamsec.com", "bamsec.com").otherwise(F.regexp_replace(h, r"^www\.", ""))
    return F.when(bare.isin(*SITES), bare)


def normal_form(raw: Column) -> Column:
    s = F.regexp_replace(F.trim(F.upper(raw)), "/A$", "")
    return (
        F.when(s.isin("10-K", "10-Q", "20-F"), s).when(s.startswith("8-K"), "8-K").when(s.startswith("6-K"), "6-K").when(s.isin("S-1", "S-11"), "S-1")
        .when(s.isin("DEF 14A", "DEF14A", "DEFA14A"), "DEF 14A").otherwise("UNKNOWN")
    )


def detect_form(declared: Column, url: Column, text: Column) -> Column:
    """struct<form, confidence>: as declared (high), by address (medium), by the head of the text (low)."""
    said = once(F.coalesce(declared, F.lit("")), normal_form)
    by_url = F.coalesce(*[F.when(url.rlike(f"(?i){p}"), F.lit(form)) for form, p in FORM_IN_URL])
    by_text = once(F.upper(F.substring(text, 1, HEAD)), lambda head: F.coalesce(*[F.when(head.rlike(p), F.lit(form)) for form, p in FORM_IN_TEXT], F.lit("UNKNOWN")))
    of = lambda form, confidence: F.struct(form.alias("form"), F.lit(confidence).alias("confidence"))
    guess = F.coalesce(once(by_url, lambda form: F.when(form.isNotNull(), of(form, "medium"))), of(by_text, "low"))
    return once(said, lambda form: F.when(form != "UNKNOWN", of(form, "high")).otherwise(guess))


def low_confidence(category: Column, form: Column, segmentation: Column, by_headings: Column, n_sections: Column) -> Column:
    """Whether a document is too generic for the analyses of a filing; the order of the tests counts."""
    return (
        F.when(segmentation == "low", True)
        .when(category.isin("edgar_filing", "edgar_ixbrl", "edgar_index"), False)
        .when(form == "DATA_REPORT", False)
        .when(by_headings, True)
        .when(form == "UNKNOWN", True)
        .otherwise(n_sections <= 1)
    )


def general_financial(category: Column, low: Column) -> Column:
    return low & category.isin("ir_or_financial", "pdf")


def exhibit(category: Column, form: Column, n_sections: Column) -> Column:
    return category.isin("edgar_filing", "edgar_ixbrl") & (form == "UNKNOWN") & (n_sections <= 1)


def accession(url: Column) -> Column:
    """struct<cik, accession> of an archive address, dashed or compact; nulls otherwise."""
    dashed, compact = r"(?i)/Archives/edgar/data/(\d+)/(\d{10}-\d{2}-\d{6})", r"(?i)/Archives/edgar/data/(\d+)/(\d{10})(\d{2})(\d{6})/"
    part = lambda p, k: F.regexp_extract(url, p, k)
    return (
        F.when(url.rlike(dashed), F.struct(part(dashed, 1).alias("cik"), part(dashed, 2).alias("accession")))
        .when(url.rlike(compact), F.struct(part(compact, 1).alias("cik"), F.concat_ws("-", part(compact, 2), part(compact, 3), part(compact, 4)).alias("accession")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("cik"), F.lit(None).cast("string").alias("accession")))
    )


def padded_cik(cik: Column) -> Column:
    return F.lpad(F.regexp_replace(cik.cast("string"), r"\D", ""), 10, "0")


def archive_url(cik: Column, accession_no: Column, document: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(cik.cast("string"), r"\D", ""), "^0+(?=.)", "")
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), plain, F.lit("/"), F.regexp_replace(accession_no, "-", ""), F.lit("/"), document)


def submissions_url(cik: Column) -> Column:
    return F.concat(F.lit("https://data.sec.gov/submissions/CIK"), padded_cik(cik), F.lit(".json"))


def page_name(html: Column) -> Column:
    """The first h1 of 3 to 160 characters, else the title before a bar or dash."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " "))
    h1 = plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    title = plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    short = F.trim(F.regexp_extract(title, r"^(.*?)(?:\s*[|–—]|$)", 1))
    return F.when(F.length(h1).between(3, 160), h1).when(title == "", None).when(F.length(short) >= 3, short).otherwise(title)


def gate_state(html: Column, consent: Column, paywall: Column) -> Column:
    """Consent before paywall before open; the markers are expressions that a profile gives."""
    return F.when(F.coalesce(F.regexp(html, consent), F.lit(False)), "consent_wall").when(F.coalesce(F.regexp(html, paywall), F.lit(False)), "paywall").otherwise("open")
