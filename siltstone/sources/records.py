"""Sources of records: memory imports and evaluation cases, as JSON arrays or lines, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import trim_space
from siltstone.schema import EVAL_CASE, MEMORY

#: Source type of each name a memory import goes by.
MEMORY_TYPES = {
    **dict.fromkeys(("conversation", "history", "chat"), "conversation"), **dict.fromkeys(("experience", "experiences"), "experience"), **dict.fromkeys(("preference", "preferences", "user_preference"), "preference"),
    **dict.fromkeys(("tool_history", "tool", "tool-history"), "tool_history"), **dict.fromkeys(("fact", "facts"), "fact"),
}
SOURCE_NAMES = {**MEMORY_TYPES, **dict.fromkeys(("knowledge", "document", "documents", "docs"), "document"), **dict.fromkeys(("external_knowledge", "external-knowledge"), "external_knowledge")}
LINE_LIMIT = 1 << 20


def memory_type(name: str) -> str:
    try:
        return MEMORY_TYPES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unsupported memory type {name!r}") from None


def source_type(name: str) -> str:
    try:
        return SOURCE_NAMES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unsupported source type {name!r}") from None


def first_character(spark: SparkSession, path: str) -> str:
    """The first non-blank character of a file or folder of files; empty where there is none."""
    row = spark.read.text(path).select(F.left(trim_space(F.col("value")), F.lit(1)).alias("c")).where("c <> ''").first()
    return row["c"] if row else ""


def _read(spark: SparkSession, path: str, schema: str, whole: bool) -> DataFrame:
    if whole:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path)
    long = F.octet_length("value") > LINE_LIMIT
    checked = lines.where(trim_space(F.col("value")) != "").withColumn("value", F.when(long, F.raise_error(F.lit("a line is longer than 1 MiB"))).otherwise(F.col("value")))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Memory records of a JSON array or of lines. A bad line, a line over 1 MiB or a record without content is an error; an empty file has none."""
    start = first_character(spark, path)
    if not start:
        return spark.createDataFrame([], MEMORY)
    rows = _read(spark, path, MEMORY, start == "[")
    blank = trim_space(F.coalesce("content", F.lit(""))) == ""
    return rows.withColumn("content", F.when(blank, F.raise_error(F.lit("a memory record has no content"))).otherwise(F.col("content")))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases: an array, an object with ``instances`` or ``cases``, or lines. An empty file is an error."""
    start = first_character(spark, path)
    if not start:
        raise ValueError("no evaluation cases")
    if start == "[":
        return _read(spark, path, EVAL_CASE, True)
    wrapped = f"instances array<struct<{_fields(EVAL_CASE)}>>, cases array<struct<{_fields(EVAL_CASE)}>>"
    try:
        both = spark.read.schema(wrapped).option("multiLine", True).json(path)
        rows = both.select(F.explode(F.coalesce("instances", "cases")).alias("c")).select("c.*")
        if not rows.isEmpty():
            return rows
    except Exception:  # noqa: BLE001  lines of objects are not one document
        pass
    return _read(spark, path, EVAL_CASE, False)


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def checked_cases(cases: DataFrame) -> DataFrame:
    """Cases with a query and something expected; any other is an error."""
    none = trim_space(F.concat(F.coalesce("query", F.lit("")), F.coalesce("problem_statement", F.lit("")))) == ""
    empty = (F.coalesce(F.size("expected"), F.lit(0)) + F.coalesce(F.size("oracle_files"), F.lit(0)) <= 0) & ~F.coalesce("patch", F.lit("")).contains("--- a/")
    return cases.withColumn("query", F.when(none | empty, F.raise_error(F.lit("a case needs a query and expectations"))).otherwise(F.col("query")))
