"""Text functions as column expressions; offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose full stop ends no sentence (fixed values).
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr vs corp inc ltd llc plc co dept no approx est fig eg ie etc "
    "jan feb mar apr jun jul aug sep oct nov dec us uk eu"
).split()
#: Month names by their first three letters (fixed values).
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_MARK = "\u0001"
_BLANKS = " \t\n\r\f\x0b"


def guard_words(dots: str) -> str:
    """An expression for a guarded word: one letter or an abbreviation, dots between its letters ignored."""
    return "(?:[A-Za-z]|" + "|".join(dots.join(f"[{c.upper()}{c}]" for c in w) for w in ABBREVIATIONS) + ")"


#: Two letters that no guarded word ends with; looked at first, as most words end so and the whole guard is dear.
_PLAIN = r"(?<=[A-Za-z]{2})(?<!" + "|".join(sorted({f"[{w[-2].upper()}{w[-2]}][{w[-1].upper()}{w[-1]}]" for w in ABBREVIATIONS})) + ")"
#: Ends of sentences: a terminator and closing marks before white space and an opening, not after a guarded word.
SENTENCE_END = r"(?=[.!?])(?>" + _PLAIN + r"|(?<!(?<![A-Za-z.])\.{0,3}" + guard_words(r"\.{0,2}") + r"\.{0,3}))([.!?][\"')\]]*)(?=[ \t\n\r]+[A-Z0-9\"'(\[])"
#: The looser ends that ranking of sentences uses.
LOOSE_END = r"(?<=[.!?])(\s+)(?=[A-Z(“\"$0-9])"


def once(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(text: Column) -> Column:
    """The text with the characters that serve as marks turned into blanks; only texts that hold one are gone through by characters."""
    marked = lambda t: F.contains(t, F.lit("\u0001")) | F.contains(t, F.lit("\u0002"))
    return once(F.coalesce(text, F.lit("")), lambda t: F.when(marked(t), F.translate(t, "\u0001\u0002", "  ")).otherwise(t))


def spans_of(marked: Column, least: int, most: int | None = None) -> Column:
    """array<struct<text, start, end>> of the pieces between marks, trimmed, of the given lengths.

    Each piece is measured and trimmed once, before the fold that sums up where it stands.
    """
    none = F.array().cast("array<struct<text:string,start:int,end:int>>")
    blanks = F.lit(_BLANKS)
    pieces = F.transform(F.split(marked, _MARK), lambda p: F.struct(F.length(p).alias("size"), F.length(F.ltrim(p, blanks)).alias("left"), F.btrim(p, blanks).alias("body")))

    def step(acc, p):
        start = acc["at"] + p["size"] - p["left"]
        size = F.length(p["body"])
        fits = size >= least if most is None else (size >= least) & (size <= most)
        one = F.array(F.struct(p["body"].alias("text"), start.alias("start"), (start + size).alias("end")))
        return F.struct((acc["at"] + p["size"]).alias("at"), F.when(fits, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def sentence_spans(text: Column, least: int = 20) -> Column:
    """Sentences of at least ``least`` characters; abbreviations and initials don't end one."""
    return spans_of(F.regexp_replace(clean(text), SENTENCE_END, f"$1{_MARK}"), least)


def loose_sentence_spans(text: Column) -> Column:
    """Sentences of 30 to 600 characters by the looser rule that ranking uses."""
    return spans_of(F.regexp_replace(clean(text), LOOSE_END, f"{_MARK}$1"), 30, 600)


def split_for_scrubbing(text: Column) -> Column:
    """Pieces between a terminator and white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def norm_for_match(text: Column) -> Column:
    """Lower case, straight quotes, only ``[a-z0-9%$.]``, single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9%$.]+", " "))


def token_set(text: Column) -> Column:
    """The distinct words of ``norm_for_match(text)``, cut out in one pass."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9%$.]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets, arrays without repeats; 1 if both are empty."""
    every = F.size(a) + F.size(b)
    return F.when(every == 0, F.lit(1.0)).otherwise(once(F.size(F.array_intersect(a, b)), lambda both: both / (every - both)))


def first_words(text: Column, n: int) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, "…").otherwise(""))


def figure_cores(text: Column) -> Column:
    """Significant figures without commas: with a currency or percent sign, a decimal point, or four digits and more."""
    pattern = F.lit(r"(\$\s?)?(\d[\d,]*(?:\.\d+)?)(\s?%)?")
    parts = F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(k)).alias(n) for k, n in ((1, "sign"), (2, "core"), (3, "percent"))])
    plain = F.transform(parts, lambda x: F.struct(x["sign"].alias("sign"), F.replace(x["core"], F.lit(","), F.lit("")).alias("core"), x["percent"].alias("percent")))
    kept = F.filter(plain, lambda x: (x["sign"] != "") | (x["percent"] != "") | F.contains(x["core"], F.lit(".")) | (F.length(F.regexp_replace(x["core"], r"\D", "")) >= 4))
    return F.transform(kept, lambda x: x["core"])


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` of an ISO prefix, ``Month d, yyyy``, ``d Month yyyy`` or ``m/d/yyyy``; else null."""
    s = F.trim(text)
    names = F.array(*[F.lit(m) for m in MONTHS])

    def of(pattern: str, year: int, month: int, day: int, named: bool) -> Column:
        part = lambda k: F.regexp_extract(s, pattern, k)
        m = F.array_position(names, F.lower(F.substring(part(month), 1, 3))).cast("int") if named else part(month).try_cast("int")
        d = part(day).try_cast("int")
        ok = s.rlike(pattern) & m.between(1, 12) & d.between(1, 31)
        return F.when(ok, F.concat_ws("-", part(year), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))

    return F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10)),
        of(r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$", 3, 1, 2, True),
        of(r"^(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})$", 3, 2, 1, True),
        of(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2, False),
    )


def calendar_date(iso: Column, short: bool = False) -> Column:
    """``January 5, 2024`` (or ``Jan 5, 2024``) of a date that begins like an ISO one, whatever the time zone; other texts as they are."""
    day = F.try_to_timestamp(F.substring(iso, 1, 10), F.lit("yyyy-MM-dd"))
    return F.when(iso.isNull(), "").otherwise(F.coalesce(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.date_format(day, "MMM d, yyyy" if short else "MMMM d, yyyy")), iso))


def fiscal_labels(text: Column) -> Column:
    """``Q1 FY2027`` and the like cut down to ``Q1``."""
    return F.regexp_replace(text, r"(?i)(?<![A-Za-z0-9_])Q([1-4])[\s -]+(?:FY\s*)?(?:19|20)\d{2}(?![A-Za-z0-9_])", "Q$1")


def report_text(text: Column) -> Column:
    """Curly quotes, dashes, bullets and hard blanks made plain, white space collapsed."""
    t = F.translate(text, "‘’“”–—• ", "''\"\"--* ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def slug(text: Column, most: int = 48) -> Column:
    s = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(s, r"^_+|_+$", ""), 1, most)


def url_without_fragment(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")


def host(url: Column) -> Column:
    """Lower-cased host name, or an empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
