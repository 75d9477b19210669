"""Usage metrics over streams: rings that fold forward as samples arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import metrics
from quillon.operators.metrics import TIERS, Tier
from quillon.plans.tables import scratch, written

OPEN = "name string, bucket long"


def fold_forward(samples: DataFrame, path: str, step: int = TIERS[0].step, every: str | None = None) -> StreamingQuery:
    """Starts a stream of samples (name, value, at, arrival) into the finest buckets below ``path``.

    Each micro-batch is reduced by ``metrics.buckets``, which splits a hot metric over tasks, and
    adds a row for each bucket that it touched. All that goes from batch to batch is the open bucket
    of each metric, a small table. A sample that is older than the open bucket goes into it without
    becoming its last value; nothing is dropped, so there is no watermark. A batch that runs again
    writes the same folder again. Without ``every`` the stream takes what is there and ends. Bound
    a batch at the source (maxFilesPerTrigger).
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        opened = _opened(spark, path, number)
        rows = batch.select("name", F.col("value").cast("double").alias("value"), F.col("at").cast("long").alias("at"), F.col("arrival").cast("long").alias("arrival"))
        metrics.buckets(rows, ["name"], step, opened).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")
        now = spark.read.parquet(f"{path}/parts/batch={number}").select("name", "bucket").unionByName(opened)
        now.groupBy("name").agg(F.max("bucket").alias("bucket")).coalesce(1).write.mode("overwrite").parquet(f"{path}/open/batch={number}")

    writer = samples.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/state")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _opened(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The open bucket of each metric before a batch."""
    if number == 0:
        return spark.createDataFrame([], OPEN)
    try:
        return spark.read.schema(OPEN).parquet(f"{path}/open/batch={number - 1}")
    except AnalysisException:
        return spark.createDataFrame([], OPEN)


def latest(spark: SparkSession, path: str, tiers: tuple[Tier, ...] = TIERS) -> DataFrame:
    """(name, tier, bucket, n, sum, min, max, last): the buckets of all tiers, without eviction, of what has arrived."""
    parts = spark.read.parquet(f"{path}/parts")
    in_time = F.when(F.col("last").isNotNull(), F.col("batch"))
    level = parts.groupBy("name", "bucket").agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max_by("last", in_time).alias("last")
    )
    out = None
    for i, shape in enumerate(tiers):
        level = metrics.folded(level, ["name"], shape.step) if i else level
        part = level.withColumn("tier", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.select("name", "tier", "bucket", *metrics.AGGREGATES)


RING = "name string, tier int, slot int, bucket long, n long, sum double, min double, max double, last double, open boolean"


def ring_forward(samples: DataFrame, path: str, tiers: tuple[Tier, ...] = TIERS, every: str | None = None) -> StreamingQuery:
    """Starts a stream of samples (name, value, at, arrival) into the rings of all tiers below ``path``; read them by ``ringed``.

    State is the rings themselves: a row for each slot that a metric fills, however long the stream.
    A micro-batch is reduced to its buckets; those that it closes, each once, are folded into the
    next tier, and so on upwards; a slot's older bucket then goes. A sample older than the open
    bucket goes into that one. The state of each batch is a table of its own, written from that of
    the batch before, so a batch that runs again gives the same; the last two are kept. Without
    ``every`` the stream takes what is there and ends.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _state(spark, path, number)
        rows = batch.select("name", F.col("value").cast("double").alias("value"), F.col("at").cast("long").alias("at"), F.col("arrival").cast("long").alias("arrival"))
        opened = state.filter((F.col("tier") == 0) & F.col("open")).select("name", "bucket")
        coming, out = written(metrics.buckets(rows, ["name"], tiers[0].step, opened)), None
        for i, shape in enumerate(tiers):
            held = state.filter(F.col("tier") == i)
            was = held.filter("open").select("name", F.col("bucket").alias("was"))
            columns = ["name", "bucket", *metrics.AGGREGATES]
            both = held.select(*columns, F.lit(0).alias("turn")).unionByName(coming.select(*columns, F.lit(1).alias("turn")))
            both = both.groupBy("name", "bucket").agg(
                F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("turn"))).alias("last")
            )
            newest = both.groupBy("name").agg(F.max("bucket").alias("newest"))
            # Closed by this batch: from what was open on, behind what is open now. Older ones are folded already.
            both = written(both.join(newest, "name").join(was, "name", "left"))
            part = metrics.evicted(both, ["name"], shape).join(newest, "name").withColumn("open", F.col("bucket") == F.col("newest")).withColumn("tier", F.lit(i)).drop("newest")
            out = part if out is None else out.unionByName(part)
            if i + 1 < len(tiers):
                step = tiers[i + 1].step
                closed = both.filter((F.col("bucket") < F.col("newest")) & (F.col("was").isNull() | (F.col("bucket") >= F.col("was"))))
                closed = closed.withColumn("fine", F.col("bucket")).withColumn("bucket", metrics.bucket(F.col("bucket"), step))
                coming = closed.groupBy("name", "bucket").agg(
                    F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max_by("last", "fine").alias("last")
                )
        names = [x.split(" ")[0] for x in RING.split(", ")]
        out.select(*names).hint("rebalance").write.mode("overwrite").parquet(f"{path}/rings/batch={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rings/batch={number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def step(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            fold(batch, number)

    writer = samples.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _state(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The rings before a batch."""
    if number == 0:
        return spark.createDataFrame([], RING)
    return spark.read.schema(RING).parquet(f"{path}/rings/batch={number - 1}")


def ringed(spark: SparkSession, path: str) -> DataFrame:
    """(name, tier, slot, bucket, n, sum, min, max, last, open) as ``metrics.rings`` gives it, of what has arrived."""
    every = spark.read.schema(RING + ", batch int").parquet(f"{path}/rings")
    last = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == last).drop("batch")


def tumbling(events: DataFrame, at: str = "ts", width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Plain windowed counts with a watermark, for when dropping what is very late is wanted; a stream or a table."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("sum"))
