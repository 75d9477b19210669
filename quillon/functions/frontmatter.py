"""Markdown frontmatter to typed columns, and back.

The reader is tolerant: it never fails, ignores unknown keys and reports what it skips as warnings.
Parsing one block is a small state machine over lines, so it runs as an Arrow-batched UDF that
returns a struct; everything that follows is Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PROVENANCE = ("actor", "session", "source")
TEXTS = ("title", "type", "scope", "workspace", "visibility", "confidence", "expires", "updated")
LISTS = ("tags", "refs")
SCHEMA = (
    "title string, type string, scope string, workspace string, visibility string, actor string, session string, source string, "
    "confidence string, expires string, tokens_raw string, tokens long, tags array<string>, refs array<string>, updated string, "
    "body string, warnings array<string>"
)
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
FENCE = re.compile(r"^\s*---\s*$")


def unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def present(value: str) -> str | None:
    return None if value in ("", "~", "null") else value


def listed(value: str) -> list[str]:
    if value.startswith("[") and value.endswith("]") and len(value) > 1:
        return [x for x in (unquoted(v) for v in value[1:-1].split(",")) if x]
    return [value] if present(value) else []


def keyed(line: str) -> tuple[str, str] | None:
    key, colon, value = line.partition(":")
    return (key.strip(), value.strip()) if colon and key.strip() else None


def parse(text: str | None) -> dict:
    """All of FIELDS for one document; without a closed block at the very start all of it is body."""
    out: dict = dict.fromkeys(FIELDS) | {"tags": [], "refs": [], "body": text or "", "warnings": []}
    lines = (text or "").split("\n")
    if not FENCE.match(lines[0]):
        return out
    close = next((i for i, line in enumerate(lines[1:], 1) if FENCE.match(line)), None)
    if close is None:
        out["warnings"].append("frontmatter is not closed")
        return out
    out["body"] = "\n".join(lines[close + 1 :])
    owner = None  # the key whose indented lines are being read
    for raw in lines[1:close]:
        line = raw.lstrip(" ").rstrip()
        if not line or line.startswith("#"):
            continue
        pair = keyed(line)
        if raw.startswith(" "):
            if owner is None:
                out["warnings"].append(f"indented line without an owner: {line}")
            elif owner in LISTS:
                if line.startswith("-") and (item := unquoted(line[1:])):
                    out[owner].append(item)
            elif owner == "provenance":
                if pair is None:
                    out["warnings"].append(f"provenance line without a key: {line}")
                elif pair[0] in PROVENANCE:
                    out[pair[0]] = present(unquoted(pair[1]))
            continue
        owner = None
        if pair is None:
            out["warnings"].append(f"line without a key: {line}")
            continue
        key, value = pair[0], unquoted(pair[1])
        if not pair[1]:
            owner = key
            if key in LISTS:
                out[key] = []
        elif key in TEXTS:
            out[key] = present(value)
        elif key in LISTS:
            out[key] = listed(value)
        elif key == "tokens":
            out["tokens_raw"], digits = present(value), re.sub("[^0-9]", "", value)
            out["tokens"] = int(digits) if present(value) and 0 < len(digits) < 20 and int(digits) < 2**32 else None
        elif key in PROVENANCE:
            out["warnings"].append(f"{key} outside provenance")
            out[key] = present(value)
    return out


def struct_of(schema: str) -> str:
    return f"struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>"


def parsed(text: Column) -> Column:
    """A struct of FIELDS."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            rows = pd.DataFrame([parse(x) for x in t], columns=FIELDS)
            rows["tokens"] = rows["tokens"].astype("Int64")
            yield rows

    return F.pandas_udf(run, struct_of(SCHEMA))(text)


def quoted(c: Column) -> Column:
    """In double quotes with quotes, backslashes and line ends escaped; the reader does not undo that."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = F.replace(F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def rendered(get) -> Column:
    """The block for fields given by ``get(name)``: keys in a fixed order, absent ones left out."""

    def row(key: str, value: Column, indent: str = "") -> Column:
        return F.concat(F.lit(f"{indent}{key}: "), value, F.lit("\n"))

    def items(key: str) -> Column:
        return F.when(F.size(get(key)) > 0, row(key, F.concat(F.lit("["), F.array_join(get(key), ", "), F.lit("]"))))

    inner = [row("actor", quoted(get("actor")), "  "), row("session", quoted(get("session")), "  "), row("source", get("source"), "  ")]
    provenance = F.when(F.coalesce(*[get(x) for x in PROVENANCE]).isNotNull(), F.concat(F.lit("provenance:\n"), *[F.coalesce(x, F.lit("")) for x in inner]))
    parts = [
        row("title", quoted(get("title"))), row("type", get("type")), row("scope", get("scope")), row("workspace", get("workspace")),
        row("visibility", get("visibility")), provenance, row("confidence", get("confidence")), row("expires", quoted(get("expires"))),
        row("tokens", F.coalesce(get("tokens_raw"), get("tokens").cast("string"))), items("tags"), items("refs"), row("updated", quoted(get("updated"))),
    ]
    return F.concat(F.lit("---\n"), *[F.coalesce(p, F.lit("")) for p in parts], F.lit("---\n"))


def rendered_known(known: dict[str, Column]) -> Column:
    """The block of the fields that are given; all others are absent."""
    absent = {"tags": F.array().cast("array<string>"), "refs": F.array().cast("array<string>"), "tokens": F.lit(None).cast("long")}
    return rendered(lambda n: known.get(n, absent.get(n, F.lit(None).cast("string"))))


def remembered(title: Column, kind: Column, scope: Column, actor: Column, body: Column) -> Column:
    """The document of a fact noted in a conversation: always proposed, never more."""
    known = {"title": title, "type": kind, "scope": scope, "actor": actor, "source": F.lit("conversation"), "confidence": F.lit("proposed")}
    return F.concat(rendered_known(known), F.lit("\n"), body, F.lit("\n"))


# Kinds of imported memories and what they become (type, scope).
IMPORTED_KINDS = {
    "project": ("project-state", "project"),
    "feedback": ("feedback", "project"),
    "reference": ("reference", "project"),
    "user": ("knowledge", "user"),
}
FOREIGN_SCHEMA = "title string, type string, scope string, updated string, body string"


def parse_foreign(text: str | None) -> tuple:
    """A foreign memory file: name or description as title, ``metadata.type`` and ``metadata.modified``."""
    text = text or ""
    found = re.match(r"---\n(.*?)\n---", text, re.S) if text.startswith("---\n") else None
    if not found:
        return "Imported memory", "knowledge", None, None, text.strip()

    def value(pattern: str) -> str | None:
        m = re.search(pattern, found[1], re.M)
        v = m[1].strip() if m else None
        return v[1:-1] if v and len(v) > 1 and v[0] == v[-1] == '"' else v

    meta = re.search(r"^metadata:[^\n]*\n((?:[ \t]+[^\n]*(?:\n|$))*)", found[1] + "\n", re.M)
    inner = dict(re.findall(r"^[ \t]+(type|modified):[ \t]*(.*?)[ \t]*$", meta[1], re.M)) if meta else {}
    kind, scope = IMPORTED_KINDS.get(inner.get("type", "").strip('"'), ("knowledge", None))
    title = value(r"^description:(.*)$")
    title = value(r"^name:(.*)$") if title is None else title
    return "Imported memory" if title is None else title, kind, scope, (inner.get("modified") or "").strip('"') or None, text[found.end() :].strip()


def parsed_foreign(text: Column) -> Column:
    """A struct of FOREIGN_SCHEMA."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([parse_foreign(x) for x in t], columns=["title", "type", "scope", "updated", "body"])

    return F.pandas_udf(run, struct_of(FOREIGN_SCHEMA))(text)
