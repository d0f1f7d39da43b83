"""JSON columns as rows, with a side table for what is no JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parsed(rows: DataFrame, schema: str, json: str = "json", into: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """(read, rejected): rows with ``into``, their JSON as a struct, and rows whose JSON does not parse or does not fit, as they were.

    Together they are all rows; a null is read as a null struct.  What is rejected has none of its values read, also where
    only its end is missing.
    """
    fields = StructType.fromDDL(schema)
    broken = "_broken"
    while broken in fields.names:
        broken += "_"
    kind = StructType([*fields.fields]).add(broken, "string")
    told = rows.withColumn(into, F.from_json(F.col(json), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}))
    lost = F.col(f"{into}.{broken}").isNotNull()
    read = told.where(~F.coalesce(lost, F.lit(False))).withColumn(into, F.when(F.col(into).isNotNull(), F.struct(*[F.col(f"{into}.`{f}`").alias(f) for f in fields.names])))
    return read, told.where(lost).drop(into)


def parsed_strictly(rows: DataFrame, schema: str, json: str = "json", into: str = "parsed") -> DataFrame:
    """rows with ``into``, their JSON as a struct; the first that does not parse or does not fit fails the job."""
    return rows.withColumn(into, F.from_json(F.col(json), StructType.fromDDL(schema), {"mode": "FAILFAST"}))
