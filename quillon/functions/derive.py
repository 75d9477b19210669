"""Columns derived from an item's metadata, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Java's regular expressions know it; Spark's trim strips spaces only.
BLANK = r"[\s\p{Z}\u0085]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_expired(expires: Column, today: str) -> Column:
    """Dates are ISO text and compare as text; shorter values, and today itself, are not expired."""
    return F.coalesce((F.octet_length(expires) >= 10) & (F.substring(expires, 1, 10) < F.lit(today)), F.lit(False))


def tier(path: Column, kind: Column, human_signed: Column, expires: Column, today: str) -> Column:
    """0 (always loaded), 1 (on demand) or 2 (search only); the first rule that holds decides."""
    scoped = path.startswith("user/") | path.contains("projects/")
    return (
        F.when(path.startswith("inbox/") | path.contains("/inbox/"), 2)
        .when(~F.coalesce(human_signed, F.lit(False)), 2)
        .when(is_expired(expires, today), 2)
        .when(kind == "instruction", F.when(scoped, 0).otherwise(2))
        .when(kind == "project-state", 0)
        .when(kind.isin("feedback", "knowledge"), 1)
        .otherwise(2)
    )


def estimated_tokens(tokens: Column, body: Column) -> Column:
    """The stated number, also zero, or a quarter of the code points, at least one."""
    return F.coalesce(tokens.cast("long"), F.greatest(F.lit(1), F.floor(F.length(F.coalesce(body, F.lit(""))) / 4))).cast("long")


def stated_tokens(raw: Column) -> Column:
    """All digits of a free text as one number; none, or beyond 32 bits, is null."""
    number = F.regexp_replace(raw, "[^0-9]", "").try_cast("decimal(38,0)")
    return F.when(number <= 4294967295, number.cast("long"))


def signer_role(principal: Column) -> Column:
    return F.when(principal.startswith("human:"), "human").when(principal.startswith("agent:"), "agent").otherwise("other")


def slug(title: Column) -> Column:
    """ASCII letters and digits in lower case, other runs as one hyphen; ``memory`` if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(ascii_lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("memory"))


def civil_date(epoch_days: Column) -> Column:
    return F.date_format(F.date_from_unix_date(epoch_days.cast("int")), "yyyy-MM-dd")


def inbox_path(title: Column, nanos: Column) -> Column:
    return F.concat(F.lit("inbox/"), slug(title), F.lit("-"), nanos.cast("string"), F.lit(".md"))


def trailer(message: Column, key: str) -> Column:
    """Value of a ``Key: value`` line in the last paragraph of a commit message; null without one."""
    last = F.element_at(F.split(F.regexp_replace(message, r"\s+$", ""), r"\n\s*\n"), -1)
    return F.nullif(F.regexp_extract(last, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def promotion(path: Column, scope: Column, only_project: Column, taken: Column) -> tuple[Column, Column]:
    """Destination of an inbox item and why there is none.

    ``only_project`` is the store's one project, null if it has none or several; ``taken`` tells
    whether the destination exists.
    """
    target = F.when(scope == "user", F.concat(F.lit("user/"), basename(path))).when(
        scope == "project", F.concat(F.lit("projects/"), only_project, F.lit("/"), basename(path))
    )
    why = (
        F.when(~path.startswith("inbox/"), "not in inbox")
        .when(scope.isNull(), "no scope")
        .when((scope == "project") & only_project.isNull(), "no single project")
        .when(~scope.isin("user", "project"), "scope has no destination")
        .when(taken, "destination exists")
    )
    return F.when(why.isNull(), target), why


def may_promote(principal: Column, automatic: list[str]) -> Column:
    return F.coalesce(principal.startswith("human:") | principal.isin(*automatic), F.lit(False))


def needs_encryption(content: Column, visibility: Column) -> Column:
    """Whether a file must not be stored in the clear: valid UTF-8 and marked private."""
    return F.coalesce(F.is_valid_utf8(content.cast("string")) & (visibility == "private"), F.lit(False))
