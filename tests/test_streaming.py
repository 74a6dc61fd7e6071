"""Row-local cleaning gives the same rows on a stream as in batch."""

import tempfile

from tillroll.sources.fixtures import sales_view
from tillroll.streaming.row_local import clean_lines, start_cleaning_stream


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="tillroll-stream-src-", dir="/tmp")
    sink = tempfile.mkdtemp(prefix="tillroll-stream-sink-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="tillroll-stream-ckpt-", dir="/tmp")
    view = sales_view(spark, "/root/testdata/sf0.001").select(
        "invoice", "date", "time", "imei_sn", "phone", "name", "email")
    view.repartition(3).write.mode("overwrite").parquet(src)
    q = start_cleaning_stream(spark, src, view.schema, sink, ckpt, 7919, 7919)
    q.awaitTermination(120)
    streamed = spark.read.parquet(sink)
    batch = clean_lines(spark.read.parquet(src), 7919, 7919)
    assert streamed.count() == batch.count() > 0
    assert streamed.select(*batch.columns).exceptAll(batch).count() == 0
