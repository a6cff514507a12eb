"""Small cases laid over a whole supplied table: every key of it gets the same rows, and SQL the rows that must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bridges as B


def spread(spark: SparkSession, sf_dir: str, name: str, key: str, rows: list[tuple], columns: str) -> DataFrame:
    """The rows (a handful) for each key of a table, as paper_id."""
    cases = F.from_json(F.lit(_json(rows, columns)), f"array<struct<{columns}>>")
    return B.table(spark, sf_dir, name).select(F.col(key).alias("paper_id"), F.explode(cases).alias("case_")).select("paper_id", "case_.*")


def _json(rows: list[tuple], columns: str) -> str:
    import json

    from pyspark.sql.types import _parse_datatype_string as parsed

    names = [f.name for f in parsed(columns).fields]
    return json.dumps([dict(zip(names, row, strict=True)) for row in rows])


def sql_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def sql_rows(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(sql_value, row)) + ")" for row in rows)
