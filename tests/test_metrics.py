import random

import pytest

from quillon.operators import metrics
from quillon.operators.metrics import TIERS, Tier
from quillon.sources import sinks
from quillon.streaming import metrics as streaming

SCHEMA = "name string, kind string, value double, at long, arrival long"


def simulated(samples, tiers):
    """The rings by the rule: a sample at a time, folding what closes."""
    rings, cursors = [{} for _ in tiers], [None] * len(tiers)

    def merge(t, bucket, part, last):
        slot = bucket // tiers[t].step % tiers[t].slots
        have = rings[t].get(slot)
        if have is None or have[0] != bucket:
            rings[t][slot] = [bucket, *part]
        else:
            have[1:5] = [have[1] + part[0], have[2] + part[1], min(have[3], part[2]), max(have[4], part[3])]
            if last:
                have[5] = part[4]

    def apply(t, bucket, part):
        if cursors[t] is not None and bucket < cursors[t]:
            return merge(t, cursors[t], part, last=False)
        if cursors[t] is not None and bucket > cursors[t] and t + 1 < len(tiers):
            closed = rings[t][cursors[t] // tiers[t].step % tiers[t].slots]
            apply(t + 1, closed[0] // tiers[t + 1].step * tiers[t + 1].step, closed[1:])
        cursors[t] = bucket
        merge(t, bucket, part, last=True)

    for value, at in samples:
        apply(0, at // tiers[0].step * tiers[0].step, [1, value, value, value, value])
    return {(t, slot): tuple(x) for t, ring in enumerate(rings) for slot, x in ring.items()}


def stream_of(seed):
    r, at, out = random.Random(seed), 0, []
    for _ in range(r.choice([1, 30, 400])):
        at += r.choice([0, 5, 40, 700, 5000])
        out.append((float(r.randrange(100)), max(-500, at - (r.randrange(4000) if r.random() < 0.3 else 0))))
    return out


@pytest.mark.parametrize("tiers, stretch", [(TIERS, 1 << 20), ((Tier(60, 7), Tier(300, 5), Tier(1000, 3)), 16)])
def test_closed_form_equals_simulation(spark, monkeypatch, tiers, stretch):
    monkeypatch.setattr(metrics, "ARRIVALS", stretch)
    streams = {f"m{i}": stream_of(i) for i in range(40)}
    rows = [(n, "counter", v, at, k) for n, x in streams.items() for k, (v, at) in enumerate(x)]
    got = {}
    for r in metrics.rings(spark.createDataFrame(rows, SCHEMA), ["name"], tiers).collect():
        got[r.name, r.tier, r.slot] = (r.bucket, r.n, r["sum"], r["min"], r["max"], r["last"])
    want = {(n, *k): x for n, s in streams.items() for k, x in simulated(s, tiers).items()}
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    streams = {f"m{i}": stream_of(100 + i) for i in range(6)}
    rows = [(n, "counter", v, at, k) for n, x in streams.items() for k, (v, at) in enumerate(x)]
    source = str(tmp_path / "in")
    rows.sort(key=lambda r: r[4])
    for part in range(3):  # three files, in the order of arrival
        cut = rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3]
        spark.createDataFrame(cut, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    given = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.fold_forward(given, str(tmp_path / "out")).awaitTermination()
    got = {(r.name, r.tier, r.bucket): (r.n, r["sum"], r["min"], r["max"], r["last"]) for r in streaming.latest(spark, str(tmp_path / "out")).collect()}
    wide = tuple(Tier(t.step, 1 << 30) for t in TIERS)
    batch = metrics.rings(spark.createDataFrame(rows, SCHEMA), ["name"], wide)
    assert got == {(r.name, r.tier, r.bucket): (r.n, r["sum"], r["min"], r["max"], r["last"]) for r in batch.collect()}


def test_rings_of_a_stream_stay_bounded(spark, tmp_path):
    """Small rings over many batches: equal to the batch's, with no more rows than slots, and two states on disk."""
    tiers = (Tier(60, 7), Tier(300, 5), Tier(1000, 3))
    streams = {f"m{i}": stream_of(200 + i) for i in range(5)}
    rows = sorted(((n, "counter", v, at, k) for n, x in streams.items() for k, (v, at) in enumerate(x)), key=lambda r: r[4])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(5):
        cut = rows[part * len(rows) // 5 : (part + 1) * len(rows) // 5]
        spark.createDataFrame(cut, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    given = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.ring_forward(given, out, tiers).awaitTermination()
    columns = ["name", "tier", "slot", "bucket", *metrics.AGGREGATES, "open"]
    got = {tuple(r) for r in streaming.ringed(spark, out).select(*columns).collect()}
    assert got == {tuple(r) for r in metrics.rings(spark.createDataFrame(rows, SCHEMA), ["name"], tiers).select(*columns).collect()}
    assert len(got) <= 5 * (7 + 5 + 3) and len([x for x in (tmp_path / "out" / "rings").iterdir() if x.name.startswith("batch=")]) == 2


def ring(spark, samples, kind="counter", name="m"):
    return metrics.rings(spark.createDataFrame([(name, kind, float(v), at, i) for i, (v, at) in enumerate(samples)], SCHEMA), ["name"])


def test_windows(spark):
    assert [metrics.picked(w) for w in (3600, 86400, 7 * 86400, 30 * 86400)] == [0, 1, 1, 2]
    got = metrics.summary(ring(spark, [(10, 10), (20, 40)]), ["name"], 60, 3600).first()
    assert (got.n, got["sum"], got["min"], got["max"], got["last"]) == (2, 30, 10, 20, 20)
    assert metrics.summary(ring(spark, [(10, 5)]), ["name"], 3 * 3600, 300).collect() == []
    assert metrics.summary(ring(spark, [(10, 5)]), ["name"], 100, 20 * 86400).first().n == 1
    late = ring(spark, [(20, 65), (10, 5)]).filter("tier = 0").first()
    assert (late.bucket, late.n, late["sum"], late["last"]) == (60, 2, 30, 20)
    assert ring(spark, [(i, 60 * i) for i in range(500)]).filter("tier = 0").count() == 360
    assert metrics.without_tier(ring(spark, [(1, 5)]), 0).count() == 0


def test_report_and_kinds(spark):
    calls = spark.createDataFrame([("s", 0, 5.0, 10, 1), ("s", 1, 7.0, 20, 2), ("t", 0, 1.0, 30, 3)], "tool string, exit_code int, millis double, at long, arrival long")
    samples = metrics.invocations(calls)
    catalog = samples.select("name", "kind").distinct()
    rows = {r.name: r for r in metrics.report(metrics.rings(samples, ["name"]), catalog, 60, 3600).collect()}
    assert set(rows) == {"s", "t"} and (rows["s"].calls, rows["s"].errors, rows["s"].avg) == (2, 1, 6.0)
    lines = [r.line for r in sinks.text_usage(metrics.report(metrics.rings(samples, ["name"]), catalog, 60, 3600)).collect()]
    assert any("2 calls" in x and "1 errors" in x for x in lines)
    mixed = spark.createDataFrame([("a", "counter", 1.0, 1, 1), ("a", "gauge", 1.0, 1, 2)], SCHEMA)
    with pytest.raises(metrics.KindMismatch):
        metrics.checked_kinds(mixed, ["name"])
    with pytest.raises(ValueError):
        Tier(0, 1)
