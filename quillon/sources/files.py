"""Sources: Markdown stores, change records, key files, snapshots of tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import derive, frontmatter

ENCRYPTED_HEADER = "age-encryption.org/v1"


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all ``*.md`` files below ``root``, paths relative to it."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    full = F.url_decode(F.col("_metadata.file_path"))
    return read.select(F.regexp_replace(full, f"^.*?{_literal(root.rstrip('/'))}/", "").alias("path"), F.col("value").alias("text"))


def _literal(text: str) -> str:
    return r"\Q" + text.removeprefix("file:").replace(r"\E", "") + r"\E"


def items(texts: DataFrame, human_signed: Column, today: str) -> DataFrame:
    """Items with typed columns and all derived ones from (path, text)."""
    x = texts.withColumn("human_signed", human_signed).withColumn("f", frontmatter.parsed(F.col("text"))).select("path", "human_signed", "f.*")
    x = x.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("tier", derive.tier(F.col("path"), F.col("type"), F.col("human_signed"), F.col("expires"), today))
    return x.withColumn("tokens", derive.estimated_tokens(F.col("tokens"), F.col("body")))


def changes(lines: DataFrame) -> DataFrame:
    """(kind, path, old_path) from the records of a version-2 porcelain status, one in ``line``.

    Ordinary records: a D on either side is a deletion, a leading A an addition, others are
    modifications. Renames have both paths behind a tab. Unmerged paths count as modified.
    """
    line = F.col("line")
    fields = lambda n: F.size(F.split(line, " ", n + 1)) == n + 1
    xy = F.split(line, " ")[1]
    ordinary = F.when(xy.contains("D"), "deleted").when(xy.startswith("A"), "added").otherwise("modified")
    x = lines.select(
        F.when(line.startswith("1 ") & fields(8), ordinary)
        .when(line.startswith("2 ") & fields(9) & line.contains("\t"), "renamed")
        .when(line.startswith("? "), "added")
        .when(line.startswith("u ") & fields(10), "modified")
        .alias("kind"),
        F.when(line.startswith("1 "), F.get(F.split(line, " ", 9), F.lit(8)))
        .when(line.startswith("2 "), F.substring_index(F.get(F.split(line, " ", 10), F.lit(9)), "\t", 1))
        .when(line.startswith("? "), F.substring(line, 3, 1 << 30))
        .when(line.startswith("u "), F.get(F.split(line, " ", 11), F.lit(10)))
        .alias("path"),
        F.when(line.startswith("2 "), F.substring_index(line, "\t", -1)).alias("old_path"),
    )
    return x.filter("kind is not null")


def unmerged(lines: DataFrame) -> DataFrame:
    """(path, code) of unmerged records."""
    line = F.col("line")
    return lines.filter(line.startswith("u ")).select(F.get(F.split(line, " ", 11), F.lit(10)).alias("path"), F.split(line, " ")[1].alias("code")).filter("path is not null")


def signers(lines: DataFrame) -> DataFrame:
    """(principal, role, key_type, key) from lines of exactly three fields; others and comments are skipped."""
    parts = F.split(derive.strip(F.col("line")), r"\s+")
    kept = lines.filter(~derive.strip(F.col("line")).startswith("#")).select(parts.alias("p")).filter(F.size("p") == 3)
    return kept.select(F.col("p")[0].alias("principal"), derive.signer_role(F.col("p")[0]).alias("role"), F.col("p")[1].alias("key_type"), F.col("p")[2].alias("key"))


def recipients(lines: DataFrame) -> DataFrame:
    """(recipient, label, kind) from lines of exactly two fields; the label's prefix tells the kind."""
    parts = F.split(derive.strip(F.col("line")), r"\s+")
    kept = lines.filter(~derive.strip(F.col("line")).startswith("#")).select(parts.alias("p")).filter((F.size("p") == 2) & F.col("p")[0].startswith("age1"))
    label = F.col("p")[1]
    kind = F.when(label.startswith("device:"), "device").when(label.startswith("recovery:"), "recovery").otherwise("other")
    return kept.select(F.col("p")[0].alias("recipient"), label.alias("label"), kind.alias("kind"))


def snapshot(blobs: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Items of tenants' snapshots (tenant_id, path, content), and how many files were skipped as private.

    Markdown in valid UTF-8 that is not encrypted; nothing in a snapshot counts as signed by a human.
    """
    text = F.col("content").cast("string")
    clear = blobs.filter(F.col("path").endswith(".md") & F.is_valid_utf8(text) & ~text.startswith(ENCRYPTED_HEADER))
    parsed = clear.select("tenant_id", "path", frontmatter.parsed(text).alias("f")).select("tenant_id", "path", "f.*")
    private = F.coalesce(F.col("visibility") == "private", F.lit(False))
    kept = parsed.filter(~private).withColumn("human_signed", F.lit(False))
    kept = kept.withColumn("tier", derive.tier(F.col("path"), F.col("type"), F.col("human_signed"), F.col("expires"), today))
    kept = kept.withColumn("tokens", derive.estimated_tokens(F.col("tokens"), F.col("body")))
    counts = parsed.groupBy("tenant_id").agg(F.count_if(~private).alias("indexed"), F.count_if(private).alias("skipped_private"))
    return kept, counts


#: Instruction files at a store's root, and what their copies are called; a caller names its own.
INSTRUCTIONS = {"AGENTS.md": "agents-md"}


def imports(files: DataFrame, existing: DataFrame, instructions: dict[str, str] = INSTRUCTIONS, prefix: str = "memory") -> DataFrame:
    """(destination, path, text): documents for foreign memory files that are not imported yet.

    The root files that ``instructions`` names become instructions under their file's name as
    title; ``projects/*/memory/*.md`` become ``<prefix>-<stem>`` with what their own frontmatter
    says. All are proposed, from an import. A destination that exists stays as it is; of several
    files with one destination the first path counts.
    """
    names = F.create_map(*[F.lit(x) for kv in instructions.items() for x in kv]) if instructions else F.lit(None)
    name = names[F.col("path")] if instructions else F.lit(None).cast("string")
    stem = F.regexp_extract("path", r"^projects/[^/]+/memory/([^/]*)\.md$", 1)
    inside = F.col("path").rlike(r"^projects/[^/]+/memory/[^/]+\.md$")
    target = F.coalesce(name, F.when(inside, F.concat(F.lit(f"{prefix}-"), stem)))
    found = files.select(F.concat(F.lit("inbox/import/"), target, F.lit(".md")).alias("destination"), "path", "text", name.isNotNull().alias("root")).filter("destination is not null")
    found = found.groupBy("destination").agg(F.min_by(F.struct("path", "text", "root"), "path").alias("x")).select("destination", "x.*")
    found = found.join(existing.select(F.col("path").alias("destination")), "destination", "left_anti").withColumn("f", frontmatter.parsed_foreign(F.col("text")))
    root, f = F.col("root"), lambda n: F.col(f"f.{n}")
    none = F.lit(None).cast("string")
    known = {"title": F.when(root, F.col("path")).otherwise(f("title")), "type": F.when(root, "instruction").otherwise(f("type")), "scope": F.when(root, none).otherwise(f("scope"))}
    known |= {"source": F.lit("import"), "confidence": F.lit("proposed"), "updated": F.when(root, none).otherwise(f("updated"))}
    body = F.when(root, derive.strip(F.col("text"))).otherwise(f("body"))
    return found.select("destination", "path", F.concat(frontmatter.rendered_known(known), F.lit("\n"), body, F.lit("\n")).alias("text"))


def import_summary(files: DataFrame, existing: DataFrame, **options) -> DataFrame:
    """One row: how many files an import takes, and how many are there already."""
    every = imports(files, existing.limit(0), **options).select("destination")
    there = every.join(existing.select(F.col("path").alias("destination")), "destination", "left_semi").agg(F.count("*").alias("skipped"))
    new = every.join(existing.select(F.col("path").alias("destination")), "destination", "left_anti").agg(F.count("*").alias("imported"))
    return new.join(there)
