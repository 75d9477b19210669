"""Metric queries: rings in batch and over a stream, windows and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import control_plane, metrics
from quillon.plans.driver_tables import SAMPLES_SQL, samples
from quillon.plans.tables import shared_dir
from quillon.sources import sinks
from quillon.streaming import metrics as streaming

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def ring_sql(keys: str) -> str:
    """The rings by SQL; the same closed form, in one level."""
    agg = "sum(n) AS n, sum(s) AS s, min(lo) AS lo, max(hi) AS hi, arg_max(last, bucket) AS last"
    tiers = [f"""{SAMPLES_SQL},
own AS (SELECT *, secs // 60 * 60 AS own FROM samples),
eff AS (SELECT *, max(own) OVER (PARTITION BY {keys} ORDER BY arrival) AS bucket FROM own),
t0 AS (SELECT {keys}, bucket, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi, arg_max(value, arrival) FILTER (WHERE own = bucket) AS last FROM eff GROUP BY {keys}, bucket)"""]
    for i, step in ((1, 900), (2, 21600)):
        tiers.append(f"""c{i} AS (SELECT *, max(bucket) OVER (PARTITION BY {keys}) AS newest FROM t{i - 1}),
u{i} AS (SELECT {keys}, bucket // {step} * {step} AS coarse, {agg} FROM c{i} WHERE bucket < newest GROUP BY ALL),
t{i} AS (SELECT {keys}, coarse AS bucket, n, s, lo, hi, last FROM u{i})""")
    rings = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS tier, bucket // {t.step} % {t.slots} AS slot, bucket, n, s, lo, hi, last, max(bucket) OVER (PARTITION BY {keys}) = bucket AS open FROM t{i}" for i, t in enumerate(metrics.TIERS)
    )
    return ",\n".join(tiers) + f""",
every AS ({rings}),
ring AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY {keys}, tier, slot ORDER BY bucket DESC) = 1)"""


@query(f"WITH {ring_sql('name')} SELECT name, tier, slot, bucket, n, round(s, 6) AS total, round(last, 6) AS last, open FROM ring")
def metric_rings(spark, sf_dir):
    r = metrics.rings(metrics.checked_kinds(samples(spark, sf_dir), ["name"]), ["name"])
    return r.select("name", "tier", "slot", "bucket", "n", F.round("sum", 6).alias("total"), F.round("last", 6).alias("last"), "open")


@query(f"""WITH {ring_sql('tenant_id, name')} SELECT tenant_id, name, tier, count(*) AS slots, CAST(sum(n) AS BIGINT) AS n, round(sum(s), 6) AS total, min(lo) AS low, max(hi) AS high
FROM ring GROUP BY tenant_id, name, tier""")
def tenant_rings(spark, sf_dir):
    r = metrics.rings(samples(spark, sf_dir), ["tenant_id", "name"])
    return r.groupBy("tenant_id", "name", "tier").agg(F.count("*").alias("slots"), F.sum("n").alias("n"), F.round(F.sum("sum"), 6).alias("total"), F.min("min").alias("low"), F.max("max").alias("high"))


@query(f"WITH {ring_sql('name')} SELECT name, tier, count(*) AS slots FROM ring WHERE tier <> 1 GROUP BY name, tier")
def reset_tier(spark, sf_dir):
    """Slots that are left when the middle tier gets another shape."""
    ring = metrics.without_tier(metrics.rings(samples(spark, sf_dir), ["name"]), 1)
    return ring.groupBy("name", "tier").agg(F.count("*").alias("slots"))


WEEK = 7 * 86400


def now_of(spark, sf_dir) -> int:
    return samples(spark, sf_dir).agg(F.max("at")).first()[0]


def window_sql(window: int, tier: int, keys: str = "name") -> str:
    return f"""WITH {ring_sql(keys)},
w AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, min(lo) AS lo, max(hi) AS hi, arg_max(last, bucket) AS last, max(bucket) AS last_at FROM ring
      WHERE bucket >= (SELECT max(secs) FROM samples) - {window} AND (tier = {tier} OR tier < {tier} AND open) GROUP BY {keys})"""


@query(window_sql(WEEK, 1) + " SELECT name, n, round(s, 6) AS total, lo AS low, hi AS high, round(last, 6) AS last, last_at FROM w")
def metric_window(spark, sf_dir):
    ring = metrics.rings(samples(spark, sf_dir), ["name"])
    found = metrics.summary(ring, ["name"], now_of(spark, sf_dir), WEEK)
    return found.select("name", "n", F.round("sum", 6).alias("total"), F.col("min").alias("low"), F.col("max").alias("high"), F.round("last", 6).alias("last"), "last_at")


@query(window_sql(30 * 86400, 2, "tenant_id, name") + " SELECT tenant_id, name, n, round(s, 6) AS total FROM w")
def tenant_window(spark, sf_dir):
    ring = metrics.rings(samples(spark, sf_dir), ["tenant_id", "name"])
    return metrics.summary(ring, ["tenant_id", "name"], now_of(spark, sf_dir), 30 * 86400).select("tenant_id", "name", "n", F.round("sum", 6).alias("total"))


def calls(spark, sf_dir):
    """Tool calls: every seventh failed."""
    x = samples(spark, sf_dir)
    return metrics.invocations(x.select(F.col("name").alias("tool"), (F.col("arrival") % 7 == 0).cast("int").alias("exit_code"), F.col("value").alias("millis"), "at", "arrival"))


_CALLS_SQL = SAMPLES_SQL.replace("samples AS (", "samples0 AS (") + ", samples AS (SELECT * FROM samples0 UNION ALL SELECT tenant_id, name || '.err', value, secs, arrival FROM samples0 WHERE arrival % 7 = 0)"


@query(window_sql(86400, 1).replace(SAMPLES_SQL, _CALLS_SQL) + """ SELECT w.name, 'counter' AS kind, w.n AS calls, coalesce(e.n, 0) AS errors, round(w.s / w.n, 6) AS average
FROM w LEFT JOIN w e ON e.name = w.name || '.err' WHERE w.name NOT LIKE '%.err'""")
def usage_report(spark, sf_dir):
    x = calls(spark, sf_dir)
    catalog = x.select("name", "kind").distinct()
    found = metrics.report(metrics.rings(x, ["name"]), catalog, now_of(spark, sf_dir), 86400)
    return found.select("name", "kind", "calls", "errors", F.round("avg", 6).alias("average"))


@query("SELECT event_type AS name, 'counter' AS kind, count(*) AS samples FROM events GROUP BY 1")
def metric_catalog(spark, sf_dir):
    return metrics.catalog(samples(spark, sf_dir))


@query(f"WITH {ring_sql('name')} SELECT name, 0 AS tier, bucket, n, round(s, 6) AS total, round(last, 6) AS last FROM t0 UNION ALL SELECT name, 1, bucket, CAST(n AS BIGINT), round(s, 6), round(last, 6) FROM t1 "
       "UNION ALL SELECT name, 2, bucket, CAST(n AS BIGINT), round(s, 6), round(last, 6) FROM t2")  # fmt: skip
def streamed_rings(spark, sf_dir):
    """The rings' buckets by the streaming operator, run over all events and read back."""
    import uuid

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")
    given = stream.select(F.col("event_type").alias("name"), "value", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("arrival"))
    streaming.fold_forward(given, path).awaitTermination()
    found = streaming.latest(spark, path)
    return found.select("name", "tier", "bucket", "n", F.round("sum", 6).alias("total"), F.round("last", 6).alias("last"))


@query(SQL["metric_rings"])
def ringed_stream(spark, sf_dir):
    """The rings with their slots as a stream of several batches leaves them."""
    import uuid

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    x = samples(spark, sf_dir).select("name", "value", "at", "arrival")
    least, most = x.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.floor((F.col("arrival") - least) * 4 / (most - least + 1))
    for k in range(4):  # one after the other, in the order of arrival
        x.filter(part == k).coalesce(1).write.mode("append").parquet(f"{path}/given")
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/given")
    streaming.ring_forward(stream, path).awaitTermination()
    return streaming.ringed(spark, path).select("name", "tier", "slot", "bucket", "n", F.round("sum", 6).alias("total"), F.round("last", 6).alias("last"), "open")


@query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, event_type AS name, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    found = streaming.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("minute"), F.col("event_type").alias("name"), "n", F.round("sum", 6).alias("total"))


@query(window_sql(86400, 1) + """ SELECT name, printf('%-20s %6d calls  %4d errors  avg %7.2fms  min %7.2fms  max %7.2fms', name, n, 0, s / n, lo, hi) AS line FROM w""")
def usage_lines(spark, sf_dir):
    x = samples(spark, sf_dir)
    return sinks.text_usage(metrics.report(metrics.rings(x, ["name"]), metrics.catalog(x).select("name", "kind"), now_of(spark, sf_dir), 86400))


@query(f"WITH {ring_sql('tenant_id, name')} SELECT tenant_id, name, tier, count(*) AS slots FROM ring GROUP BY tenant_id, name, tier")
def configured_rings(spark, sf_dir):
    """Tenants' rings with the tiers that a table gives."""
    tiers = control_plane.tiers_of(control_plane.tier_table(spark))
    return metrics.rings(samples(spark, sf_dir), ["tenant_id", "name"], tiers).groupBy("tenant_id", "name", "tier").agg(F.count("*").alias("slots"))
