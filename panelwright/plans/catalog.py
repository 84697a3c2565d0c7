"""Registration of queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name`` with the SQL that must give the same rows."""

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query registered twice: {name}")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql.strip()
        return plan

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, flags as 0/1 and dates as text, for exact comparison."""
    def column(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            c = c.cast("int").cast("bigint")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        return c.alias(field.name)

    return df.select(*[column(f) for f in df.schema.fields])
