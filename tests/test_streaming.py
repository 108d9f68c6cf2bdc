"""Monitor windows as a stream that stops and starts again, against the batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sightline.operators import journal
from sightline.streaming.monitor import windowed

SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def test_a_stream_with_late_rows_and_a_restart_equals_the_batch(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [(k, day + timedelta(hours=7 * k % 96), "ab"[k % 2], float(k)) for k in range(40)]  # out of order, by less than the windows wait
    source, log, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    shape = windowed(spark.createDataFrame([], SCHEMA)).schema

    def run():
        stream = windowed(spark.readStream.schema(SCHEMA).parquet(source), late="5 days")
        add = lambda df, number: journal.append(df.coalesce(1), log, number)  # noqa: E731  a batch that comes again is written once
        q = stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None

    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    run()  # nothing new
    told = journal.read(spark, log, shape)
    # the last word on each window
    last = told.groupBy("window", "event_type").agg(F.max("n").alias("n"))
    got = sorted((r.window.start, r.event_type, r.n) for r in last.collect())
    want = sorted((r.window.start, r.event_type, r.n) for r in windowed(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want and len(got) == 8
