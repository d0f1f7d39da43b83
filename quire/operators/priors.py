"""The filing before a filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBMISSIONS = "struct<name:string,cik:string,filings:struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,form:array<string>,primaryDocument:array<string>>,files:array<struct<name:string>>>>"


def submission_rows(raw: DataFrame, *keys: str, json: str = "json") -> DataFrame:
    """(keys, seq, accession, filing_date, report_date, form, document): the column arrays of submissions as rows.

    Missing arrays and values are empty strings; the accession numbers say how many rows there are.
    """
    r = F.from_json(F.col(json), SUBMISSIONS)["filings"]["recent"]
    names = {"accession": "accessionNumber", "filing_date": "filingDate", "report_date": "reportDate", "form": "form", "document": "primaryDocument"}
    rows = raw.select(*keys, r.alias("r")).where(F.size("r.accessionNumber") > 0).select(*keys, "r", F.posexplode("r.accessionNumber").alias("seq", "accession"))
    return rows.select(*keys, "seq", *[F.coalesce(F.get(F.col(f"r.{src}"), F.col("seq")), F.lit("")).alias(dst) for dst, src in names.items()])


def prior_filing(filings: DataFrame, *keys: str, date: str = "report_date", key: str = "accession") -> DataFrame:
    """Each filing with ``prior``: the latest of the same keys with a strictly earlier date, the greatest key of equal dates.

    Where none is earlier, the filing that follows among those of the same date.  It is a window of ranges, so
    no filing is joined to any other.
    """
    earlier = Window.partitionBy(*keys).orderBy(F.col("_day")).rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*keys, date).orderBy(F.col(key).desc())
    day = filings.withColumn("_day", F.unix_date(F.col(date).cast("date")).cast("bigint"))
    best = F.max(F.struct(F.col("_day"), F.col(key).alias("k"))).over(earlier)["k"]
    return day.withColumn("prior", F.coalesce(best, F.lead(key).over(same))).drop("_day")


def second_latest(filings: DataFrame, *keys: str, date: str = "report_date", key: str = "accession") -> DataFrame:
    """(keys, prior): for filings of unknown period, the second latest of the same keys."""
    order = Window.partitionBy(*keys).orderBy(F.col(date).desc(), F.col(key).desc())
    return filings.withColumn("_n", F.row_number().over(order)).where("_n = 2").select(*keys, F.col(key).alias("prior"))


def with_continuation(recent: DataFrame, older: DataFrame, resolved: DataFrame, *keys: str) -> DataFrame:
    """Recent filings and, for keys that found no prior among them, those of the continuation."""
    return recent.unionByName(older.join(resolved.select(*keys).distinct(), list(keys), "left_anti"))


def usable(form: Column, accession: Column, document: Column, wanted: Column) -> Column:
    """Filings that may be a prior: the same form exactly, so no amendments, with an accession number and a document."""
    return (form == wanted) & (accession != "") & (document != "")
