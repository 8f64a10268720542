"""Sample tables: written so that a scan by series or by time reads little, and read back in their roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.roles import Profile, Roles, profile

# Fixed value: the bits of the NaN that marks a series as gone.
STALE_BITS = 0x7FF0000000000002


def decode_stale(df: DataFrame, value: str = "value", stale: str = "stale") -> DataFrame:
    """A boolean column for the marker. A shuffle makes all NaNs alike, so this must come before any."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            bits = batch.column(value).fill_null(0.0).to_numpy(zero_copy_only=False).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits == STALE_BITS)], names=[*batch.schema.names, stale])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{stale}` boolean")


def read_samples(spark: SparkSession, path: str, format: str = "parquet", name: str = "default") -> tuple[DataFrame, Roles]:
    """A table and its roles by profile; any format that Spark reads."""
    p: Profile = profile(name)
    df = spark.read.format(format).load(path)
    return df, p.roles.resolve(df)


def write_samples(df: DataFrame, path: str, roles: Roles = Roles(), days: bool = True, mode: str = "errorifexists") -> None:
    """Parquet sorted by series and time, so that row groups have narrow ranges of both; a folder a day."""
    if days:
        df = df.withColumn("day", F.to_date(roles.ts))
        # Series of a day go together; the day is spread over as many tasks as it has rows for.
        df.repartition("day", *roles.keys).sortWithinPartitions("day", *roles.keys, roles.ts).write.mode(mode).partitionBy("day").parquet(path)
    else:
        df.repartitionByRange(*roles.keys, roles.ts).sortWithinPartitions(*roles.keys, roles.ts).write.mode(mode).parquet(path)


def downsample(df: DataFrame, step: int, roles: Roles = Roles()) -> DataFrame:
    """A row per series and bucket of ``step`` ticks with what later sums need: n, total, low, high, first, last."""
    from ..operators.samples import tick_of, time_of

    roles = roles.resolve(df)
    t = tick_of(df, roles.ts)
    v, ts = F.col(roles.value), F.col(roles.ts)
    rows = df.where(v.isNotNull() & ts.isNotNull()).withColumn("_b", t - F.pmod(t, F.lit(step)))
    out = rows.groupBy(*roles.keys, "_b").agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.min_by(v, ts).alias("first"), F.max_by(v, ts).alias("last"))
    return out.select(*roles.keys, time_of(df.schema[roles.ts].dataType, F.col("_b")).alias("ts"), "n", "total", "low", "high", "first", "last")
