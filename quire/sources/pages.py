"""Documents of pages: their texts, and why a file has none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.files import MOST_BYTES


def plain_pages(content: bytes) -> list[str]:
    """Pages of a UTF-8 text, parted by form feeds."""
    return content.decode("utf-8").split("\f")


def tidy(page: str) -> str:
    """A page without blanks at the ends of its lines and around it."""
    return "\n".join(line.rstrip() for line in page.split("\n")).strip()


def paged_texts(documents: DataFrame, *keys: str, parse: Callable[[bytes], list[str]] = plain_pages, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(keys, text, pages, error): one row per row of (keys, length, content), as a reader of binary files gives them.

    ``parse`` gives the pages of a file, such as a PDF parser does; empty pages count but leave nothing in the text, others are parted by a
    blank line.  A file that it fails on has ``error``, a null text and no pages, and so has one of over ``most_bytes``,
    whose content is never read: no file is dropped in silence, and none fails the job.  Null content is no pages.
    """
    from pyspark.sql.functions import arrow_udf

    kind = pa.struct([("text", pa.string()), ("pages", pa.int32()), ("error", pa.string())])

    @arrow_udf("struct<text:string,pages:int,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            out = []
            for content in part:
                try:
                    pages = [tidy(p) for p in parse(content.as_py())] if content.is_valid else []
                    out.append({"text": "\n\n".join(p for p in pages if p), "pages": len(pages), "error": None})
                except Exception as e:  # whatever a parser meets in a file is told beside it
                    out.append({"text": None, "pages": 0, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pa.array(out, kind)

    names = [F.col(f"`{k}`") for k in keys]
    fits = F.coalesce(F.col("length") <= most_bytes, F.lit(True))
    read = documents.where(fits).select(*names, run("content").alias("_p")).select(*names, "_p.text", "_p.pages", "_p.error")
    large = documents.where(~fits).select(*names, F.lit(None).cast("string").alias("text"), F.lit(0).alias("pages"), F.concat(F.lit("larger than "), F.lit(most_bytes).cast("string"), F.lit(" bytes")).alias("error"))
    return read.unionByName(large)
