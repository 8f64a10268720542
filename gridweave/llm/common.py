"""What the operators of this subpackage share: tables, scratch space, size-checked broadcasts, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ASCII white space of the word rule, as a regular expression class and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000
#: Nor more bytes than this, measured as JSON.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir). Only a local session, whose driver and
    executors are one machine, gets a folder of its own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='gridweave-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    What is read back has no known partitioning, so a later sort-merge join exchanges both of its sides and
    adaptive execution can split hot keys on either.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    # What this write has shuffled is of no more use once it is done; else it stays on disk until a collection of garbage.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it was measured to have at most ``most`` rows and ``most_bytes``; else as it is, to be shuffled."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(row.cast("long"))).first()
    fits = rows <= most and (size or 0) <= most_bytes
    return (F.broadcast(df) if fits else df), fits


def text_of(column: str | Column = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def row_key() -> tuple[Column, Column]:
    """What tells documents apart where an id repeats with another text; rows that are equal in both get equal results."""
    return F.col("doc_id"), F.xxhash64(text_of()).alias("text_key")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else. Text without other characters takes the quick path."""
    return F.when(F.length(column) == F.octet_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def arrow_batches(spark: SparkSession, rows: int = 512, size: int = 64 << 20) -> None:
    """Rows and bytes in an Arrow batch at most, for the session: what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def stable(docs: DataFrame, tag: str) -> DataFrame:
    """``docs`` such that its rows are numbered alike whenever a task is run again: written first, unless it is read from files as it is."""
    return materialize(docs, tag) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs
