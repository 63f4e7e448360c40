"""Scans of partitioned trade and bar stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAPE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("option_chain_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("executed_at", T.TimestampType()),
        T.StructField("nbbo_bid", T.DoubleType()),
        T.StructField("nbbo_ask", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("premium", T.DoubleType()),
        T.StructField("implied_volatility", T.DoubleType()),
        T.StructField("expiry", T.DateType()),
        T.StructField("strike", T.DoubleType()),
        T.StructField("option_type", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("report_flags", T.StringType()),
        T.StructField("multi_vol", T.DoubleType()),
        T.StructField("date", T.DateType()),
        T.StructField("asset", T.StringType()),
    ]
)


def read_tape(
    spark: SparkSession,
    path: str,
    columns: list[str],
    schema: T.StructType = TAPE_SCHEMA,
    where: Column | None = None,
) -> DataFrame:
    """Scan a ``date=/asset=`` tape with an explicit schema.

    A wanted column that is not in the schema raises here, not at run time; unreadable files
    fail the job (``ignoreCorruptFiles`` stays off).
    """
    missing = sorted(set(columns) - set(schema.fieldNames()))
    if missing:
        raise ValueError(f"tape columns missing: {','.join(missing)}")
    df = spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(path)
    return (df if where is None else df.where(where)).select(*columns)


def usable_trades(tape: DataFrame, iv: str = "iv") -> DataFrame:
    """Positive size, a strike, and an implied volatility in [0.01, 5]."""
    return tape.where(
        (F.col("size") > 0) & F.col("strike").isNotNull() & F.col(iv).between(0.01, 5.0)
    )


def scan_outcome(expected: DataFrame, tape: DataFrame, keys: list[str]) -> DataFrame:
    """Per expected partition: rows found, and whether it is measured or sparse."""
    found = tape.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return expected.join(found, keys, "left").select(
        *keys,
        F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        F.when(F.col("rows") > 0, "measured").otherwise("sparse").alias("outcome"),
    )


def partition_inventory(scan: DataFrame, keys: list[str], role: Column) -> DataFrame:
    """Files, rows and bytes per partition of a file scan, tagged by role.

    ``scan`` must come straight from a file source, so that ``_metadata`` resolves.
    """
    files = (
        scan.select(
            *keys, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("sz")
        )
        .groupBy(*keys, "path", "sz")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        files.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows"), F.sum("sz").alias("bytes")
        )
        .withColumn("role", role)
    )


def union_stores(stores: dict[str, DataFrame], role: Column | None = None) -> DataFrame:
    """Concatenate stores with differing optional columns, tagged by source."""
    out: DataFrame | None = None
    for name in sorted(stores):
        tagged = stores[name].withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no stores given")
    return out if role is None else out.withColumn("role", role)


def normalise_bars(bars: DataFrame, calendar: DataFrame, zone: str) -> DataFrame:
    """Bars with either timestamp spelling to minutes since that session's own open.

    ``timestamp_utc`` wins over the zone-less ``timestamp_local``; rows before the open drop.
    ``calendar`` carries session_date and open_minute in the market zone.
    """
    parts = []
    if "timestamp_utc" in bars.columns:
        parts.append(F.from_utc_timestamp(F.col("timestamp_utc"), zone))
    if "timestamp_local" in bars.columns:
        parts.append(F.col("timestamp_local").cast("timestamp"))
    if not parts:
        raise ValueError("bars carry no timestamp column")
    wall = F.coalesce(*parts)
    numeric = [c for c in ("open", "high", "low", "close", "volume") if c in bars.columns]
    return (
        bars.withColumn("_wall", wall)
        .withColumn("session_date", F.to_date("_wall"))
        .withColumn("_m", F.hour("_wall") * 60 + F.minute("_wall"))
        .join(calendar.select("session_date", "open_minute"), "session_date")
        .withColumn("minute", (F.col("_m") - F.col("open_minute")).cast("bigint"))
        .where(F.col("minute") >= 0)
        .withColumns({c: F.col(c).cast("double") for c in numeric})
        .drop("_wall", "_m", "open_minute")
    )


def timestamp_scan(tape: DataFrame, columns: tuple[str, ...] = ("executed_us", "created_us")) -> DataFrame:
    """Only the clock columns; everything else is pruned from the file scan."""
    return tape.select(*columns)


def merged_panel(base: DataFrame, mid: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """Base origins left-joined to two feature panels; base rows are preserved."""
    return base.join(mid, keys, "left").join(top, keys, "left")
