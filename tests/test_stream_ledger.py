"""The batch ledger of a stream with late and repeated records."""

from datetime import datetime, timedelta

from tidemark.sources.results import shared_folder
from tidemark.streaming.run import files_as_stream, keep_once

SCHEMA = "id bigint, at timestamp, read string"
T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_read_is_kept_late_and_repeated(spark):
    folder = shared_folder(spark)
    batches = [
        [(1, at(0), "x"), (1, at(0), "y"), (2, at(60), None), (3, None, "z")],
        [(4, at(10), "spared"), (5, at(55), "within"), (2, at(60), "again"), (6, at(120), None)],
        [(7, at(20), "late"), (7, at(20), "late"), (6, at(120), "again"), (8, at(125), None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], SCHEMA).schema
    out, ledger = keep_once(files_as_stream(spark, folder, "*.parquet", schema, 1), ["id"], "at", "10 minutes")
    rows = [r.asDict() for r in ledger.orderBy("batch_id").collect()]
    assert all(r["read"] == r["kept"] + r["late"] + r["repeated"] for r in rows)
    assert sum(r["read"] for r in rows) == 12 and sum(r["late"] for r in rows) == 2 and sum(r["repeated"] for r in rows) == 3
    kept = sorted(r["id"] for r in spark.read.schema(schema).parquet(out).collect())
    assert kept == [1, 2, 3, 4, 5, 6, 8] and sum(r["kept"] for r in rows) == len(kept)


def test_no_files_no_rows(spark):
    folder = shared_folder(spark)
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    schema = spark.createDataFrame([], SCHEMA).schema
    out, ledger = keep_once(files_as_stream(spark, folder, "*.parquet", schema), ["id"], "at", "10 minutes")
    assert sum(r["read"] for r in ledger.collect()) == 0
