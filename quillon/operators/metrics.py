"""Usage metrics in rings of several resolutions, in closed form over batches.

A sample lands in the bucket that is open when it arrives: the running maximum of its key's own
buckets. A bucket's last value is that of the latest arrival that belongs in it by its own time.
When a bucket closes it is folded into the next tier, so each tier holds all closed buckets of the
finer one. A ring keeps the newest bucket of each slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.tables import written


@dataclass(frozen=True)
class Tier:
    step: int
    slots: int

    def __post_init__(self):
        if self.step < 1 or self.slots < 1:
            raise ValueError("a tier needs a step and slots of one at least")

    @property
    def span(self) -> int:
        return self.step * self.slots


# One minute for 6 hours, 15 minutes for 14 days, 6 hours for a year.
TIERS = (Tier(60, 360), Tier(900, 1344), Tier(21600, 1460))


class KindMismatch(ValueError):
    pass


def bucket(at: Column, step: int) -> Column:
    return (F.floor(at / step) * step).cast("long")


def checked_kinds(samples: DataFrame, keys: list[str]) -> DataFrame:
    """``samples``, if no metric is a counter here and a gauge there."""
    mixed = samples.groupBy(*keys).agg(F.min("kind").alias("a"), F.max("kind").alias("b")).filter("a != b").limit(1).collect()
    if mixed:
        raise KindMismatch(str(mixed[0]))
    return samples


AGGREGATES = ("n", "sum", "min", "max", "last")


#: Arrivals that one task puts in order: a key's samples are cut at multiples of this.
ARRIVALS = 1 << 20


def buckets(samples: DataFrame, keys: list[str], step: int = TIERS[0].step, opened: DataFrame | None = None) -> DataFrame:
    """(keys, bucket, n, sum, min, max, last): the finest tier without eviction.

    ``samples`` has the keys, value, at (epoch seconds) and arrival (a number, a total order within
    a key). The running maximum runs in two levels, over stretches of ARRIVALS and within each, so
    a key with a large share of all samples is not one task's. ``opened`` (keys, bucket) are the
    buckets that were open before these samples.
    """
    def same(left: str, right: str, names: list[str]) -> Column:
        on = F.lit(True)
        for k in names:
            on &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
        return on

    x = samples.withColumn("own", bucket(F.col("at"), step)).withColumn("stretch", F.floor(F.col("arrival") / ARRIVALS))
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = x.groupBy(*keys, "stretch").agg(F.max("own").alias("top")).withColumn("before", F.max("top").over(earlier)).drop("top")
    if opened is not None:
        tops = tops.alias("t").join(opened.alias("o"), same("t", "o", keys), "left").select(*[f"t.{k}" for k in [*keys, "stretch"]], F.greatest("t.before", "o.bucket").alias("before"))
    x = x.alias("x").join(tops.alias("t"), same("x", "t", [*keys, "stretch"])).select("x.*", "t.before")
    order = Window.partitionBy(*keys, "stretch").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("bucket", F.greatest(F.max("own").over(order), F.col("before")))
    in_time = F.when(F.col("own") == F.col("bucket"), F.col("arrival"))
    return x.groupBy(*keys, "bucket").agg(
        F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", in_time).alias("last")
    )


def folded(finer: DataFrame, keys: list[str], step: int) -> DataFrame:
    """The next tier: all buckets of the finer one but the newest, which is still open."""
    newest = Window.partitionBy(*keys)
    closed = finer.withColumn("__open", F.max("bucket").over(newest)).filter(F.col("bucket") < F.col("__open"))
    return closed.withColumn("__fine", F.col("bucket")).withColumn("bucket", bucket(F.col("bucket"), step)).groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max_by("last", "__fine").alias("last")
    )


def evicted(tier: DataFrame, keys: list[str], shape: Tier) -> DataFrame:
    """The newest bucket of each slot of the ring."""
    slot = F.pmod(F.floor(F.col("bucket") / shape.step), F.lit(shape.slots)).cast("int")
    columns = ["bucket", *AGGREGATES]
    return tier.withColumn("slot", slot).groupBy(*keys, "slot").agg(F.max_by(F.struct(*columns), "bucket").alias("newest")).select(*keys, "slot", "newest.*")


def rings(samples: DataFrame, keys: list[str], tiers: tuple[Tier, ...] = TIERS) -> DataFrame:
    """(keys, tier, slot, bucket, n, sum, min, max, last, open) of all tiers."""
    # Read by all tiers: a row for each bucket, not for each sample.
    out, level = None, written(buckets(samples, keys, tiers[0].step))
    for i, shape in enumerate(tiers):
        level = folded(level, keys, shape.step) if i else level
        part = evicted(level, keys, shape)
        part = part.withColumn("open", F.col("bucket") == F.max("bucket").over(Window.partitionBy(*keys))).withColumn("tier", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.select(*keys, "tier", "slot", "bucket", *AGGREGATES, "open")


def catalog(samples: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """(keys, kind, samples) of all metrics, by name; a metric of two kinds is an error."""
    return checked_kinds(samples, list(keys)).groupBy(*keys, "kind").agg(F.count("*").alias("samples")).orderBy(*keys)


def picked(window: int, tiers: tuple[Tier, ...] = TIERS) -> int:
    """The finest tier that spans ``window`` seconds, else the coarsest."""
    return next((i for i, t in enumerate(tiers) if t.span >= window), len(tiers) - 1)


def summary(ring: DataFrame, keys: list[str], now: int, window: int, tiers: tuple[Tier, ...] = TIERS) -> DataFrame:
    """(keys, n, sum, min, max, last, last_at) over the last ``window`` seconds.

    Takes the picked tier's buckets that start in the window, and the open buckets of finer tiers,
    which are not folded yet. A bucket across the start of the window is left out whole.
    """
    at = picked(window, tiers)
    rows = ring.filter((F.col("bucket") >= now - window) & ((F.col("tier") == at) | ((F.col("tier") < at) & F.col("open"))))
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.max_by("last", "bucket").alias("last"), F.max("bucket").alias("last_at"),
    )


def report(ring: DataFrame, catalog: DataFrame, now: int, window: int, tiers: tuple[Tier, ...] = TIERS) -> DataFrame:
    """(name, kind, calls, errors, avg, min, max, last) of metrics with samples in the window.

    A counter's errors are the samples of the metric called ``name.err``, which has no row itself.
    """
    sums = summary(ring, ["name"], now, window, tiers)
    errors = sums.filter(F.col("name").endswith(".err")).select(F.col("name").alias("err_name"), F.col("n").alias("err_n"))
    shown = catalog.filter(~F.col("name").endswith(".err")).join(sums, "name").filter("n > 0")
    both = shown.join(errors, F.concat("name", F.lit(".err")) == F.col("err_name"), "left")
    count = F.when(F.col("kind") == "counter", F.coalesce("err_n", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return both.select("name", "kind", F.col("n").alias("calls"), count.alias("errors"), (F.col("sum") / F.col("n")).alias("avg"), "min", "max", "last")


def invocations(calls: DataFrame) -> DataFrame:
    """Samples of tool calls (tool, exit_code, millis, at, arrival): one by the tool's name, one more for a failure."""
    names = F.array_compact(F.array(F.col("tool"), F.when(F.col("exit_code") != 0, F.concat("tool", F.lit(".err")))))
    return calls.select(F.explode(names).alias("name"), F.lit("counter").alias("kind"), F.col("millis").cast("double").alias("value"), "at", "arrival")


def without_tier(ring: DataFrame, tier: int) -> DataFrame:
    """What stays when a tier's shape changes: its ring starts anew."""
    return ring.filter(F.col("tier") != tier)
