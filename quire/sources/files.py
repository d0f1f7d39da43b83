"""Files as tables: plain text, binary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest file that is parsed; larger ones are told, not read (fixed value).
MOST_BYTES = 25 << 20


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row per text file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of binary files; the content of rows that a filter on length leaves out is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def is_pdf(url, mime=None):
    """Whether an address or a content type tells of a PDF."""
    by_path = F.coalesce(url.rlike(r"(?i)^[^?#]*\.pdf(?:[?#]|$)"), F.lit(False))
    return by_path if mime is None else by_path | F.coalesce(F.lower(mime) == "application/pdf", F.lit(False))


def cover(text):
    """struct<company, period, ticker> from the first 6,000 characters of a filing's text.

    The company is what stands before the registrant line, on that line or the last one above it; the period is the date
    behind the first ``year ended`` or ``period ended``; the symbol is the first word in capitals behind its heading.
    """
    from quire.functions.text import iso_date, once

    head = F.substring(text, 1, 6000)

    def around(phrase: str):
        """What stands before and behind the first match of a phrase; the second is null without one."""
        parts = F.split(head, f"(?i){phrase}", 2)
        return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))

    above, named = around(r"\(?\s*exact\s+name\s+of\s+(?:the\s+)?registrant")
    name = F.trim(F.regexp_replace(F.regexp_extract(above, r"([^\n]*)\s*$", 1), r"\s+", " "))
    _, ended = around(r"\b(?:year|period)\s+ended\b")
    _, symbol = around(r"\btrading\s+symbols?(?:\(s\))?")
    date = F.regexp_extract(ended, r"^[\s:]*([A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})", 1)
    return F.struct(
        once(name, lambda x: F.when(named.isNotNull() & F.length(x).between(2, 80), x)).alias("company"), once(date, iso_date).alias("period"), F.nullif(F.regexp_extract(symbol, r"^\W*([A-Z]{1,5})\b", 1), F.lit("")).alias("ticker")
    )
