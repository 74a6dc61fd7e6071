"""Streaming use of the row-local operators.

The reference works on finite files only; nothing in it keeps state across
rows except the order-based repairs (date runs, first-per-group lookups),
which need the whole file and stay batch operators.  The row-local cleaning
(phone/email/name normalisation, customer codes, serial hashing, date and time
parsing) needs no state, so the same Column expressions run unchanged on a
stream arriving as files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillroll.functions import dates as D
from tillroll.functions import pseudonym as N
from tillroll.operators.customers import normalize_customers


def clean_lines(df: DataFrame, cust_salt: int, serial_key: int) -> DataFrame:
    """Stateless part of the sales cleaning: works on batch and streaming
    frames alike (no shuffle, no ordering)."""
    out = normalize_customers(df)
    code = N.phone_code("phone", cust_salt)
    return out.select(
        *[c for c in df.columns if c not in ("phone", "name", "email", "imei_sn", "date", "time")],
        D.parse_date("date").alias("date"),
        D.parse_time("time").alias("time"),
        N.customer_id(code).alias("id"),
        code.alias("phone"),
        F.col("name"),
        F.col("email"),
        N.serial_hash("imei_sn", serial_key).alias("imei_sn"),
    )


def start_cleaning_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                          sink_dir: str, checkpoint_location: str, cust_salt: int,
                          serial_key: int, available_now: bool = True) -> StreamingQuery:
    """Files of sales lines in ``source_dir`` -> cleaned Parquet in
    ``sink_dir``.  The checkpoint location (on shared storage) makes the file
    sink exactly-once across restarts."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    writer = (clean_lines(stream, cust_salt, serial_key).writeStream
              .format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_location).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    return writer.start()
