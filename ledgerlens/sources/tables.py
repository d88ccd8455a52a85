"""Reading and writing the canonical tables, logs and report files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema
from ledgerlens.functions import values as V


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One stored table with its declared columns; no inference, Parquet pruning applies."""
    ddl = schema.TABLES[table]
    extra = schema.PARTITION_BY.get(table)
    frame = spark.read.schema(ddl + (f", {extra} int" if extra else "")).parquet(f"{root}/{table}")
    return frame


def read_tables(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: read_table(spark, root, n) for n in names}


def partition_column(table: str) -> Column | None:
    """Value of the folder a row belongs to: fiscal year, or trade month as yyyyMM."""
    name = schema.PARTITION_BY.get(table)
    if name == "fiscal_year":
        return F.year("end_date").alias(name)
    if name == "trade_month":
        return (F.year("trade_date") * 100 + F.month("trade_date")).alias(name)
    return None


def write_table(df: DataFrame, root: str, table: str, changed_partitions_only: bool = False) -> None:
    """Write a table; with ``changed_partitions_only`` untouched folders stay as they are."""
    folder = partition_column(table)
    out = align(df, table)
    if folder is None:
        out.write.mode("overwrite").parquet(f"{root}/{table}")
        return
    name = schema.PARTITION_BY[table]
    out = out.select("*", folder)
    # Rows of a folder come together in as many tasks as their size asks for, so one busy month is not one file.
    out = out.hint("rebalance", name)
    writer = out.write.mode("overwrite").partitionBy(name)
    if changed_partitions_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{root}/{table}")


def align(df: DataFrame, table: str) -> DataFrame:
    """Keep the columns the table knows, in its order; fill the absent ones with NULL."""
    have = set(df.columns)
    cols = []
    for part in schema.TABLES[table].split(","):
        name, kind = part.strip().split(" ", 1)
        cols.append((F.col(name) if name in have else F.lit(None)).cast(kind).alias(name))
    return df.select(*cols)


def shared_columns(df: DataFrame, target_columns: Iterable[str]) -> DataFrame:
    """Only the columns both sides know, in the target's order."""
    have = set(df.columns)
    return df.select(*[c for c in target_columns if c in have])


# --- logs ----------------------------------------------------------------------


def parse_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines -> trace events; lines that are not JSON objects are dropped.

    ``ts`` stays text next to the parsed ``at``, because an event with an
    unreadable time is kept.
    """
    ddl = schema.TABLES["trace_events"] + ", __bad string"
    parsed = lines.select(
        F.from_json(F.col(line), ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("e")
    )
    good = parsed.filter(F.col("e").isNotNull() & F.col("e.__bad").isNull()).select("e.*").drop("__bad")
    return good.withColumn("at", F.try_to_timestamp("ts"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def events_since(events: DataFrame, cutoff: Column | None = None, code_prefix: str | None = None) -> DataFrame:
    """Newer than ``cutoff``; an event without a readable time stays in."""
    out = events
    if cutoff is not None:
        out = out.filter(F.col("at").isNull() | (F.col("at") >= cutoff))
    if code_prefix is not None:
        out = out.filter(F.col("code").startswith(code_prefix))
    return out


# --- report files ----------------------------------------------------------------

# File name patterns of the report corpus.
RESULT_FILE = r"invest_result_(\d{6}\.(?:SH|SZ|BJ))_([a-z-]+)\.md$"


def read_reports(spark: SparkSession, path: str, name_pattern: str = RESULT_FILE) -> DataFrame:
    """One row per document; company and analyst come from the file name."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"), F.input_file_name().alias("file")
    )
    return docs.select(
        F.regexp_extract("file", name_pattern, 1).alias("ts_code"),
        F.regexp_extract("file", name_pattern, 2).alias("expert_id"),
        "file",
        "text",
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """File name, size and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL at any depth of structs, arrays and maps, so JSON stays strict."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _finite(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return V.finite(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    return value


def write_json_documents(df: DataFrame, path: str) -> None:
    """One strict JSON object per line, one line per company."""
    finite_columns(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
