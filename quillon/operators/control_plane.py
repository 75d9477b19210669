"""Tenants, devices and grants: the control plane's queries over its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.metrics import Tier
from quillon.plans.tables import ranked, written

GRANT_SECONDS = 600


def latest_state(events: DataFrame) -> DataFrame:
    """A row for each tenant from its events (tenant_id, at, kind, flag): always_warm, running, last_active."""
    def last(kinds: list[str], value: Column) -> Column:
        return F.max_by(F.when(F.col("kind").isin(kinds), value), F.when(F.col("kind").isin(kinds), F.col("at")))

    return events.groupBy("tenant_id").agg(
        F.coalesce(last(["warm"], F.col("flag")), F.lit(False)).alias("always_warm"),
        F.coalesce(last(["started", "stopped"], F.col("kind") == "started"), F.lit(False)).alias("running"),
        F.max("at").alias("last_active"),
    )


def idle_tenants(tenants: DataFrame, now: Column | int, idle_seconds: int) -> DataFrame:
    return tenants.filter(F.col("running") & ~F.col("always_warm") & (F.col("last_active") < F.lit(now) - idle_seconds))


def with_certificates(devices: DataFrame, issued: DataFrame) -> DataFrame:
    """Devices with the serial that was issued to them, where there is a new one."""
    fresh = issued.select("device_id", F.col("serial").alias("__serial"))
    return devices.join(fresh, "device_id", "left").withColumn("serial", F.coalesce("__serial", "serial")).drop("__serial")


def revoked(devices: DataFrame, requests: DataFrame) -> DataFrame:
    """Devices after revocations (device_id, at): the first time stays; notify tells of a change that has a serial."""
    first = requests.groupBy("device_id").agg(F.min("at").alias("__at"))
    both = devices.join(first, "device_id", "left")
    changed = F.col("revoked_at").isNull() & F.col("__at").isNotNull()
    return both.withColumn("notify", changed & F.col("serial").isNotNull()).withColumn("revoked_at", F.coalesce("revoked_at", "__at")).drop("__at")


def live_grants(grants: DataFrame, code: Column, now: int) -> DataFrame:
    """Grants that either code finds before they expire."""
    return grants.filter(((F.col("device_code") == code) | (F.col("user_code") == code)) & (F.col("expires_at") > now))


def poll_states(polls: DataFrame, grants: DataFrame, devices: DataFrame, tenants: DataFrame, now: int) -> DataFrame:
    """(poll_id, state) of device-code polls, tested in the order of the states."""
    g, d = grants.alias("g"), devices.alias("d")
    x = polls.join(g, "device_code", "left").join(d, F.col("g.device_id") == F.col("d.device_id"), "left")
    x = x.join(tenants.select(F.col("tenant_id").alias("t_id")), F.col("g.tenant_id") == F.col("t_id"), "left")
    state = (
        F.when(F.col("g.expires_at").isNull(), "invalid_grant")
        .when(F.col("g.expires_at") <= now, "expired_token")
        .when(F.col("g.device_id").isNull(), "authorization_pending")
        .when(F.col("d.device_id").isNull() | F.col("t_id").isNull(), "server_error")
        .when(F.col("d.serial").isNull(), "authorization_pending")
        .otherwise("approved")
    )
    return x.select("poll_id", state.alias("state"))


def authorized(requests: DataFrame, devices: DataFrame, tenants: DataFrame, started: DataFrame | None = None) -> DataFrame:
    """(request_id, status, tenant_id, start): by method, then certificate serial, device, revocation, tenant and address.

    A tenant that is not running is started for the request: start is true, and the status is that
    of a running one unless ``started`` (tenant_id, ok) says that the start failed (503). tenant_id
    is set where the request reached its tenant, whether or not the start worked.
    """
    d = devices.select("serial", F.col("tenant_id").alias("d_tenant"), "revoked_at", F.lit(True).alias("d_found"))
    t = tenants.select(F.col("tenant_id").alias("t_id"), "slug", "running")
    x = requests.join(d, "serial", "left").join(t, F.col("d_tenant") == F.col("t_id"), "left")
    if started is not None:
        x = x.join(started.select(F.col("tenant_id").alias("t_id"), "ok").distinct(), "t_id", "left")
    failed = F.coalesce(~F.col("ok"), F.lit(False)) if started is not None else F.lit(False)
    reached = F.coalesce(F.col("slug") == tenant_of(F.col("url")), F.lit(False))
    status = (
        F.when(~F.coalesce(F.col("method").isin("GET", "POST"), F.lit(False)), 405)
        .when(F.col("serial").isNull() | F.col("d_found").isNull() | F.col("revoked_at").isNotNull(), 401)
        .when(~reached, 404)
        .when(~F.col("running") & failed, 503)
        .otherwise(200)
    )
    x = x.withColumn("status", status).withColumn("tenant_id", F.when(F.col("status").isin(200, 503), F.col("t_id")))
    return x.select("request_id", "status", "tenant_id", F.coalesce(F.col("tenant_id").isNotNull() & ~F.col("running"), F.lit(False)).alias("start"))


def touched(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(tenant_id, last_active): when each tenant was last reached by ``requests`` (request_id, at), from their ``authorized`` answers."""
    return answers.filter("tenant_id is not null").join(requests.select("request_id", "at"), "request_id").groupBy("tenant_id").agg(F.max("at").alias("last_active"))


def starts(answers: DataFrame) -> DataFrame:
    """(tenant_id): the tenants that ``authorized`` answers ask to start, each once."""
    return answers.filter("start").select("tenant_id").distinct()


def tenant_of(url: Column) -> Column:
    return F.regexp_extract(url, "^/([^/]+)/", 1)


def suffix_of(url: Column) -> Column:
    return F.regexp_extract(url, "^/[^/]+/(.*)$", 1)


def to_close(connections: DataFrame, devices: DataFrame) -> DataFrame:
    """Open connections whose device is revoked."""
    return connections.join(devices.filter("revoked_at is not null").select("serial"), "serial", "left_semi")


class Refused(ValueError):
    pass


def reset_event(events: DataFrame, actor: str, tenant_id: int, at: int) -> DataFrame:
    """``events`` with the record of a reset of all connections; a blank actor is refused."""
    if not actor.strip():
        raise Refused("a reset needs an actor")
    return events.unionByName(events.sparkSession.createDataFrame([(tenant_id, actor, at)], events.select("tenant_id", "actor", "at").schema))


def unique_slugs(tenants: DataFrame) -> DataFrame:
    twice = tenants.groupBy("slug").count().filter("count > 1").limit(1).collect()
    if twice:
        raise Refused(f"slug {twice[0].slug} is taken")
    return tenants


def numbered(rows: DataFrame, by: list[str], after: int, name: str) -> DataFrame:
    """``rows`` with new numbers from ``after`` + 1 in column ``name``, in the order of ``by``, which is total."""
    return ranked(rows, [F.asc(c) for c in by], None).withColumn(name, F.lit(after) + F.col("rank")).drop("rank")


def created_tenants(tenants: DataFrame, slugs: DataFrame) -> DataFrame:
    """``tenants`` (tenant_id, slug, always_warm, running) and new ones for ``slugs`` (slug), all of them cold and stopped.

    A slug that is there already, or is asked for twice, is refused as a whole.
    """
    last = tenants.agg(F.max("tenant_id")).first()[0] or 0
    fresh = numbered(slugs.select("slug"), ["slug"], last, "tenant_id").select("tenant_id", "slug", F.lit(False).alias("always_warm"), F.lit(False).alias("running"))
    return unique_slugs(tenants.select(*fresh.columns).unionByName(fresh))


def found(table: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """For each row of ``keys`` (a column ``by`` and any others) the row of ``table`` with that value, nulls where there is none.

    Looks up tenants by slug or tenant_id and devices by public_key, device_id or serial.
    """
    return keys.join(table, by, "left")


def registered_devices(devices: DataFrame, keys: DataFrame) -> DataFrame:
    """``devices`` and new ones for ``keys`` (tenant_id, public_key), without serial and not revoked; a key belongs to one device."""
    last = devices.agg(F.max("device_id")).first()[0] or 0
    fresh = numbered(keys.select("tenant_id", "public_key"), ["public_key"], last, "device_id").select(
        "device_id", "tenant_id", "public_key", F.lit(None).cast("string").alias("serial"), F.lit(None).cast("long").alias("revoked_at")
    )
    every = devices.select(*fresh.columns).unionByName(fresh)
    twice = every.groupBy("public_key").count().filter("count > 1").limit(1).collect()
    if twice:
        raise Refused(f"public key {twice[0].public_key} is registered")
    return every


def created_grants(grants: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """``grants`` and new ones for ``asked`` (tenant_id, device_code, user_code), good for GRANT_SECONDS and not approved."""
    last = grants.agg(F.max("grant_id")).first()[0] or 0
    fresh = numbered(asked, ["device_code"], last, "grant_id")
    fresh = fresh.select("grant_id", "tenant_id", "device_code", "user_code", F.lit(now + GRANT_SECONDS).cast("long").alias("expires_at"), F.lit(None).cast("long").alias("device_id"))
    return grants.select(*fresh.columns).unionByName(fresh)


def approved_grants(grants: DataFrame, devices: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grants and devices after ``approvals`` (grant_id, public_key).

    Approving twice is approving once: a grant whose device there is keeps it, and of several
    approvals of a grant the smallest key counts. Others get a new device of the grant's tenant.
    """
    asked = approvals.groupBy("grant_id").agg(F.min("public_key").alias("public_key"))
    done = grants.filter("device_id is not null").join(devices.select("device_id"), "device_id", "left_semi").select("grant_id")
    open_ones = asked.join(done, "grant_id", "left_anti").join(grants.select("grant_id", "tenant_id"), "grant_id")
    after = written(registered_devices(devices, open_ones))
    of = open_ones.select("grant_id", "public_key").join(after.select("public_key", F.col("device_id").alias("__new")), "public_key").select("grant_id", "__new")
    both = grants.join(of, "grant_id", "left").withColumn("device_id", F.coalesce("__new", "device_id")).drop("__new")
    return both.select(*grants.columns), after


def other_device_refs(refs: DataFrame, remote: str, device: str) -> DataFrame:
    """Names (name) of the branches that other devices push to ``remote``; a device's own is left out."""
    start = f"{remote}/sync/"
    return refs.filter(F.col("name").startswith(start) & (F.col("name") != start + device))


def refs_below(refs: DataFrame, prefix: str) -> DataFrame:
    """Names that are ``prefix`` or stand below it; a prefix that ends with a slash is taken as it is."""
    return refs.filter(F.col("name").startswith(prefix) if prefix.endswith("/") else (F.col("name") == prefix) | F.col("name").startswith(prefix + "/"))


def branch_exists(refs: DataFrame, branch: str, remote: str | None = None) -> bool:
    """Whether there is a local branch, or one of ``remote``."""
    name = f"refs/remotes/{remote}/{branch}" if remote else f"refs/heads/{branch}"
    return not refs.filter(F.col("name") == name).isEmpty()


def form_decoded(text: Column) -> Column:
    """A form value: + is a space and %XX a byte; what is no such pair stays as it is, invalid UTF-8 becomes U+FFFD."""
    # A percent sign that no two hexadecimal digits follow stands for itself.
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def html_escaped(text: Column) -> Column:
    """With &, <, > and double quotes as entities."""
    # The characters and their entities, the ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def serial_hex(serial: Column) -> Column:
    """A certificate's serial number (binary) in lowercase hexadecimal digits, leading zeros kept."""
    return F.lower(F.hex(serial))


# The tiers that a new control plane starts with (number, step in seconds, slots).
TIER_ROWS = ((0, 60, 360), (1, 900, 1344), (2, 21600, 1460))


def tier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TIER_ROWS), "tier int, step long, slots long")


def tiers_of(table: DataFrame) -> tuple[Tier, ...]:
    """The tiers of a table (tier, step, slots) in their order; a row each."""
    return tuple(Tier(r.step, r.slots) for r in table.orderBy("tier").collect())
