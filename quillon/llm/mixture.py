"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Each source's weight asks for a share of the mix; no source gives more than ``epochs`` times its
size. What capped sources cannot give is shared by the others in proportion to their weights until
none is above its cap. In the order of cap / weight the capped sources are a prefix, so running
sums over the sources (a row each) solve it in one pass.

A source's target is a number of whole repetitions of all its documents and a fraction: documents
in a seeded order are taken once more until the fraction is reached, the last of them in part.
Where the fraction ends is found digit by digit of the seeded hash: sums of a source's 256 buckets
find the bucket, sums of that bucket's 256 parts the part, and so on while a part has more than
AT_ONCE rows; only the last part's rows are put in order, so no task sees a whole source. Digits of
the id's hash come first, then those of the text's and of the row's place, which part rows that
share an id, or have none. Sources themselves (a row each) are put in order in one task: meant for
thousands of sources, not for one for each web host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import reused, text_or_empty, word_count, written

#: Hexadecimal digits of the seeded hash that each step looks at, and the least number of steps.
DIGITS, STEPS = 2, 2
#: Rows of a source's last part that one task puts in order; more make another step.
AT_ONCE = 1 << 18
#: Steps after which all digits are used: those of the id's hash, the size and the tie.
LAST_STEP = (32 + 16 + 32) // DIGITS
#: Sources up to which their table (a row of about 60 bytes each) is broadcast.
BROADCAST_SOURCES = 50_000


def water_fill(sources: DataFrame, share: float, epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size) with each source's target.

    Sources in code point order, null last, weigh ``weights``, repeating. A source of size zero
    has target zero. ``share`` times the total is mixed, or all caps where they sum to less.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    x = x.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("given", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("open_weight", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    # The level if all sources before this one are capped and none from here on.
    x = x.withColumn("level", (F.col("total") - F.col("given")) / F.col("open_weight"))
    # Levels rise up to the first source that is not capped and fall after it.
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    x = x.withColumn("level", level)
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return x.select("source", "source_size", target.alias("target"))


def seeded(seed: int, id_col: str = "doc_id") -> Column:
    """A place in the seeded order: equal on every run and every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def with_params(placed: DataFrame, params: DataFrame) -> DataFrame:
    """Each row with its source's one row of ``params`` (written).

    A broadcast where the table is small, else a join that adaptive execution splits at a hot source.
    """
    p = (F.broadcast(params) if params.count() <= BROADCAST_SOURCES else params).alias("p")
    d = placed.alias("d")
    names = [c for c in params.columns if c != "source"]
    return d.join(p, F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", *[f"p.{c}" for c in names])


def narrowed(placed: DataFrame, params: DataFrame, step: int) -> DataFrame:
    """``params`` with the next digits of the prefix in which a source's fraction ends.

    start is the size of all that stands before the prefix. A source that needs nothing keeps an
    empty prefix.
    """
    inside = with_params(placed, params).filter((F.col("need") > 0) & F.col("place").startswith(F.col("prefix")))
    digits = F.substring("place", 1 + DIGITS * step, DIGITS)
    sums = inside.groupBy("source", digits.alias("digits")).agg(F.sum("size").alias("bucket_size"), F.count("*").alias("n"), F.first("need").alias("need"), F.first("start").alias("start"))
    upto = F.col("start") + F.sum("bucket_size").over(Window.partitionBy("source").orderBy("digits"))
    ends = sums.withColumn("upto", upto).filter(F.col("upto") >= F.col("need"))
    ends = ends.groupBy("source").agg(F.min(F.struct("digits", (F.col("upto") - F.col("bucket_size")).alias("start"), "n")).alias("end"))
    p, e = params.alias("p"), ends.alias("e")
    both = p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    kept = [F.col(f"p.{c}") for c in params.columns if c not in ("prefix", "start", "n")]
    prefix = F.coalesce(F.concat("p.prefix", "e.end.digits"), F.col("p.prefix"))
    return both.select(*kept, prefix.alias("prefix"), F.coalesce("e.end.start", "p.start").alias("start"), F.coalesce("e.end.n", "p.n").alias("n"))


def mix(sizes: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: int = 7) -> DataFrame:
    """For each row of ``sizes`` (doc_id, source, size and perhaps tie; re-readable): what the mix takes of it.

    Returns doc_id, source, size, source_size, target, whole (full repetitions), part (words of
    the fractional repetition, at most size) and taken = whole * size + part, and a column ``row``
    of ``sizes`` as it is. The takings of a
    source sum to its target, rounded. A null source is a source. Rows that share an id, or have
    none, stand by size and then by tie, a string of hexadecimal digits that parts them; equal ones
    change no sum. Empty documents take nothing. An empty table gives no rows.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(sources, share, epochs, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio).cast("long"))
    targets = targets.withColumn("need", F.greatest(F.lit(0).cast("long"), F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    # By id, then by size (16 digits order numbers as text), then by tie.
    tie = "tie" if "tie" in sizes.columns else F.lit("")
    placed = sizes.withColumn("place", F.concat(seeded(seed), F.lpad(F.hex("size"), 16, "0"), tie))
    zero = F.lit(0).cast("long")
    params = written(targets.withColumn("prefix", F.lit("")).withColumn("start", zero).withColumn("n", zero))
    step = 0
    while step < STEPS or (step < LAST_STEP and (params.agg(F.max("n")).first()[0] or 0) > AT_ONCE):
        params = written(narrowed(placed, params, step))
        step += 1
    joined = with_params(placed.withColumn("bucket", F.substring("place", 1, DIGITS * step)), params)
    # A source without a fraction has no prefix, which is less than any bucket.
    other = joined.filter("bucket != prefix").withColumn("part", F.when(F.col("bucket") < F.col("prefix"), F.col("size")).otherwise(F.lit(0).cast("long")))
    inside = joined.filter("bucket = prefix")
    before = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("need") - F.col("start") - F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))
    inside = inside.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    out = other.unionByName(inside)
    row = ["row"] if "row" in sizes.columns else []
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), *row)


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size (words of the whole text; a null text has none), tie and ``more`` for each row."""
    tie = F.concat(F.lpad(F.hex(F.xxhash64(text_or_empty())), 16, "0"), F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0"))
    return docs.select(F.col("doc_id"), F.col("source"), word_count().alias("size"), tie.alias("tie"), *more)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix`` over a documents table; sizes are numbers of words of whole texts, null texts have none."""
    return mix(reused(sized(docs)), **options)


def repeated_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, each row as often as the mix takes it.

    A fractional repetition becomes a whole one where it covers at least half of the text, so no
    text is cut and a source meets its target within one document. Rows that the mix takes nothing
    of go, empty and null texts among them. Rows that share an id, or have none, count each, equal
    ones too. Columns are those of ``docs``, whatever their names. An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    # Written with a place for each row, which a plan that runs again would not repeat.
    rows = written(sized(docs, row))
    times = (F.col("whole") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)).cast("int")
    taken = mix(rows, **options).filter("taken > 0").select("row", F.explode(F.array_repeat(F.lit(0), times)))
    return taken.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
