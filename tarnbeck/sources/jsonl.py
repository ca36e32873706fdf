"""Tables as JSON lines: reading with a declared schema, and appending what isn't there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tarnbeck.operators.index import exists


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of the files in ``path``. Blank lines are passed over, lines that are no JSON object give nulls; no such path gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys no stored row has, so that a run that was cut off can be started again. Null keys are always new."""
    stored = read_lines(rows.sparkSession, path, rows.schema)
    rows.join(stored.select(*keys).distinct(), keys, "left_anti").write.mode("append").option("ignoreNullFields", "false").json(path)
