"""Links between documents: extraction and normalisation, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.derive import strip


def wikilink_names(body: Column) -> Column:
    """Names of ``[[name|alias]]`` and ``[[name#part]]`` in order, repeats kept, blank ones dropped."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    names = F.transform(found, lambda x: strip(F.regexp_extract(x, r"(?s)^([^|#]*)", 1)))
    return F.filter(names, lambda x: x != "")


def normalized_ref(source_path: Column, ref: Column, keep_escapes: bool = False) -> Column:
    """``ref`` relative to the folder of ``source_path``, with . and .. resolved; null if it leaves the root.

    An absolute ref stands on its own. ``keep_escapes`` rejects only a first .. beyond the root and
    lets a further one cancel it, as lexical popping of the parts does.
    """
    ref = F.replace(ref, F.lit("\\"), F.lit("/"))
    folder = F.regexp_replace(source_path, "[^/]*$", "")
    whole = F.when(ref.startswith("/"), ref).otherwise(F.concat(folder, ref))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("left"))

    def step(state: Column, part: Column) -> Column:
        stack, left = state["stack"], state["left"]
        up, empty = part == "..", F.size(stack) == 0
        if keep_escapes:
            popped = F.when(empty, F.array(part)).otherwise(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
            return F.struct(F.when(up, popped).otherwise(F.concat(stack, F.array(part))).alias("stack"), left.alias("left"))
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.struct(F.when(up, popped).otherwise(F.concat(stack, F.array(part))).alias("stack"), (left | (up & empty)).alias("left"))

    end = F.aggregate(parts, start, step)
    bad = end["left"] | (F.size(end["stack"]) == 0)
    if keep_escapes:
        bad = bad | F.array_contains(end["stack"], "..")
    return F.when(~bad, F.array_join(end["stack"], "/"))
