"""A gate that refuses texts with credentials. The rules are this library's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the rules and their patterns.
RULES = {
    "access-key-id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "token-prefix": r"\b(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk)[-_][0-9A-Za-z_-]{16,}",
    "assigned-secret": r"(?i)\b[a-z_]*(?:secret|password|passwd|api_?key|token)[a-z_]*\s*[:=]\s*[\"']?[0-9A-Za-z/+_-]{12,}",
    "bearer": r"(?i)\bbearer\s+[0-9a-z._-]{20,}",
}


#: Runs of characters that keys are written in, and what is looked at alone: digits and a to f.
TOKEN, HEX = r"[0-9A-Za-z+/_-]{20,}={0,2}", r"^[0-9a-f]+$|^[0-9A-F]+$"
#: Bits a character from which a token is a key: of 16 digits, and of mixed letters and digits.
HEX_BITS, MIXED_BITS = 3.2, 4.2
#: Least characters of either, and lengths of common digests, which prose is full of.
HEX_LENGTH, MIXED_LENGTH, DIGESTS = 32, 24, (32, 40, 56, 64, 96, 128)
ENTROPY = "high-entropy"


def entropy(token: Column) -> Column:
    """Shannon's entropy of a text's characters, in bits a character; 0 for an empty text.

    A character's count is what the text loses without it.
    """
    n = F.length(token)
    counts = F.transform(F.array_distinct(F.split(token, "")), lambda c: F.when(c == "", 0).otherwise(n - F.length(F.replace(token, c, F.lit("")))))
    bits = F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - bits / n).otherwise(0.0)


def is_random(token: Column) -> Column:
    """Whether a token looks drawn at random: its entropy is high for its alphabet.

    Hexadecimal tokens of a digest's length are left alone, as are mixed ones without a lower-case
    letter, an upper-case one and a digit each: words, names and numbers.
    """
    n, mixed = F.length(token), token.rlike("[a-z]") & token.rlike("[A-Z]") & token.rlike("[0-9]")
    of_hex = (n >= HEX_LENGTH) & ~n.isin(*DIGESTS) & (entropy(token) >= HEX_BITS)
    return F.when(token.rlike(HEX), of_hex).otherwise((n >= MIXED_LENGTH) & mixed & (entropy(token) >= MIXED_BITS))


def random_tokens(text: Column) -> Column:
    """The tokens of a text that look like keys without a known form, in order."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), is_random)


def findings(text: Column) -> Column:
    """Names of the rules that hold, in their order; last the one for tokens without a known form."""
    named = [F.when(F.coalesce(text, F.lit("")).rlike(p), name) for name, p in RULES.items()]
    return F.array_compact(F.array(*named, F.when(F.size(random_tokens(text)) > 0, ENTROPY)))


def excerpt(text: Column, rule: str) -> Column:
    """The first four characters of what a rule finds, the rest masked; null without a finding."""
    found = F.get(random_tokens(text), F.lit(0)) if rule == ENTROPY else F.regexp_extract(text, f"({RULES[rule]})", 1)
    return F.when(found != "", F.concat(F.substring(found, 1, 4), F.lit("***")))
