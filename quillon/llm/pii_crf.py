"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The patterns give base spans of four kinds. The field's nodes are a document's tokens that hold a
digit or an at sign. Neighbouring tokens share a chain potential; tokens that repeat or resemble
each other, however far apart, share a skip potential. Tokens in base spans are observed. Loopy
sum-product message passing then carries labels to their distant likenesses: a number that is
written once as a phone number is one where it stands alone. A token is added if its marginal is
at least ADD and a token of that kind in a base span is linked to it.

Unary weights are a multinomial logistic regression and pair potentials are log ratios of label
pairs, both learnt from what the patterns label in a bounded sample of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, text_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none
ADD, ROUNDS, DAMPING, OBSERVED = 0.9, 8, 0.3, 25.0

LOCAL = r"[A-Za-z0-9._%+-]"
# Possessive runs that start at the start of a run: linear time, and the same leftmost matches.
EMAIL_TAIL = r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_HERE, EMAIL_NEXT = re.compile(LOCAL + EMAIL_TAIL), re.compile(f"(?<!{LOCAL}){LOCAL}{EMAIL_TAIL}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
DIGIT = re.compile("[0-9]")
EDGE = " \t\r\n.,;:!?()[]{}<>\"'|%$*&#"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while "@" in text:
        m = (EMAIL_HERE.match(text, at) if at else None) or EMAIL_NEXT.search(text, at)
        if not m:
            break
        out.append(m.span())
        at = m.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and int(part or 0) <= 255

    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    return [(k, a, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def features(token: str) -> int:
    """Shape features of a token as a bit mask."""
    core = token.strip(EDGE)
    digits = sum(c.isascii() and c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    bits = [
        True, digits == 0, 1 <= digits <= 2, digits == 3, digits == 4, 5 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits > 19,
        "@" in core, core.count(".") == 3, "." in core, "-" in core, token.startswith("+"), "(" in token, letters > 0, letters > digits, len(core) == digits,
    ]
    return sum(1 << i for i, b in enumerate(bits) if b)


FEATURES = 18


def likenesses(token: str) -> set[str]:
    """Keys that a token shares with those that repeat or resemble it."""
    core = token.strip(EDGE).lower()
    digits = "".join(DIGIT.findall(core))
    keys = {"=" + core} if len(core) >= 6 and (len(digits) >= 4 or "@" in core) else set()
    if len(digits) >= 7:
        keys |= {"#" + digits, "~" + digits[-7:]}
    if "@" in core:
        keys.add("@" + core.split("@")[0])
    elif len(core) >= 5 and len(digits) < len(core):
        keys.add("@" + core)
    return keys


class Graph:
    """Nodes and edges of any number of documents; they share no edge, so messages pass in all at once."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.shape: list[int] = []
        self.observed: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, text: str, base: list[tuple[int, int, int]]) -> range:
        first, groups = len(self.spans), defaultdict(list)
        ordered, b, reach = sorted((s, e, k) for k, s, e in base), 0, 0
        for m in TOKEN.finditer(text):
            token, start, end = m[0], m.start(), m.end()
            at, i = start + len(token) - len(token.lstrip(EDGE)), len(self.spans)
            self.spans.append((at, max(at, start + len(token.rstrip(EDGE)))))
            self.shape.append(features(token))
            # Base spans stand in the order of their starts; a token takes the first that it meets.
            while b < len(ordered) and ordered[b][1] <= start:
                b += 1
            label = next((k + 1 for s, e, k in ordered[b : b + 4] if s < end and e > start), 0)
            self.observed.append(label)
            if i > first and start - reach <= 3 and not text[reach:start].strip():
                self.chain.append((i - 1, i))
            reach = end
            for key in likenesses(token):
                groups[key].append(i)
        for members in groups.values():
            # A star around an observed member and a path: linear in the group, and two steps reach all.
            hub = next((i for i in members if self.observed[i]), members[0])
            self.skip += [(min(hub, i), max(hub, i)) for i in members if i != hub]
            self.skip += [(i, j) for i, j in zip(members, members[1:]) if hub not in (i, j)]
        return range(first, len(self.spans))


class Field:
    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, graph: Graph) -> np.ndarray:
        shape = np.array(graph.shape, dtype=np.int64)
        bits = (shape[:, None] >> np.arange(FEATURES)) & 1
        own = bits @ self.unary
        seen = np.array(graph.observed)
        own[np.arange(len(seen))[seen > 0], seen[seen > 0]] += OBSERVED
        edges = np.array(graph.chain + graph.skip, dtype=np.int64).reshape(-1, 2)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(graph.chain), LABELS, LABELS)), np.broadcast_to(self.skip, (len(graph.skip), LABELS, LABELS))])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS if len(edges) else 0):
            belief = own.copy()
            np.add.at(belief, target, messages)
            out = (belief[source] - messages[back])[:, :, None] + pair
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * new
        np.add.at(own, target, messages)
        own -= own.max(axis=1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(axis=1, keepdims=True)

    def added(self, graph: Graph, nodes: list[range]) -> list[list[tuple[int, int, int]]]:
        """For each document's nodes: the spans that the field adds."""
        p = self.marginals(graph) if graph.spans else np.zeros((0, LABELS))
        best = p.argmax(axis=1)
        sure = (best > 0) & (p.max(axis=1, initial=0) >= ADD) & (np.array(graph.observed, dtype=np.int64) == 0)
        backed = np.zeros_like(sure)
        for i, j in graph.skip:
            for a, b in ((i, j), (j, i)):
                if sure[a] and graph.observed[b] == best[a]:
                    backed[a] = True
        joined = set(graph.chain)
        out = []
        for own in nodes:
            spans: list[tuple[int, int, int]] = []
            before = None
            for i in own:
                if backed[i] and graph.spans[i][1] > graph.spans[i][0]:
                    k = int(best[i]) - 1
                    if before is not None and (before, i) in joined and spans and spans[-1][0] == k:
                        spans[-1] = (k, spans[-1][1], graph.spans[i][1])
                    else:
                        spans.append((k, *graph.spans[i]))
                    before = i
            out.append(spans)
        return out


def learnt(docs: DataFrame, sample: int = 3000, smooth: float = 1.0) -> Field:
    """A field from what the patterns label in ``sample`` documents at most, in the order of a hash of the id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], int] = defaultdict(int)
        for batch in batches:
            for x in batch.column("text"):
                graph = Graph()
                text = x.as_py().decode("utf-8", "replace")
                graph.add(text, base_spans(text))
                for shape, label in zip(graph.shape, graph.observed):
                    found[0, shape, label] += 1
                for what, edges in ((1, graph.chain), (2, graph.skip)):
                    for i, j in edges:
                        found[what, graph.observed[i], graph.observed[j]] += 1
        cols = [list(c) for c in zip(*((*k, n) for k, n in found.items()))] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["what", "a", "b", "n"])

    bounded_batches(docs.sparkSession)
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    texts = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(ids), "doc_id").select("text")
    counted = texts.mapInArrow(count, "what long, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    shapes = sorted((r.a, r.b, r.n) for r in counted if r.what == 0)
    unary = np.zeros((FEATURES, LABELS))
    if shapes:
        x = np.array([[s >> i & 1 for i in range(FEATURES)] for s, _, _ in shapes], dtype=float)
        y = np.eye(LABELS)[[label for _, label, _ in shapes]]
        n = np.array([n for _, _, n in shapes], dtype=float)
        n /= n.sum()
        for _ in range(600):
            z = x @ unary
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            unary += 2.0 * (x.T @ ((y - p) * n[:, None]) - 1e-4 * unary)
    pairs = []
    for what in (1, 2):
        m = np.full((LABELS, LABELS), smooth)
        for r in counted:
            if r.what == what:
                m[r.a, r.b] += r.n
                m[r.b, r.a] += r.n
        m /= m.sum()
        pairs.append(np.log(m / np.outer(m.sum(axis=1), m.sum(axis=0))))
    return Field(unary, *pairs)


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """For each row: doc_id, n_total (all spans), n_added (those of the field), n_email, n_ip, n_card, n_phone and base_sha256 (base spans), spans (all).

    Whole texts are searched, however long; a null text counts as empty and has none. Offsets are
    code points. Repeated rows each get their row; other columns are ignored. An empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            graph, nodes, bases = Graph(), [], []
            for x in batch.column("text"):
                raw = np.frombuffer(x.as_buffer(), np.uint8)
                if ((raw - 48 < 10) | (raw == 64)).any():
                    text = x.as_py().decode("utf-8", "replace")
                    bases.append(base_spans(text))
                    nodes.append(graph.add(text, bases[-1]))
                else:
                    bases.append([])
                    nodes.append(range(0))
            more = field.added(graph, nodes)
            counts = [[sum(k == s[0] for s in b) for b in bases] for k in range(len(KINDS))]
            digests = [hashlib.sha256(shown(b).encode()).hexdigest() if b else nothing for b in bases]
            everything = [shown(b + m) for b, m in zip(bases, more)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(b) + len(m) for b, m in zip(bases, more)], pa.int64()), pa.array([len(m) for m in more], pa.int64()),
                    *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(everything),
                ],
                ["doc_id", "n_total", "n_added", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return read.mapInArrow(run, "doc_id long, n_total long, n_added long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
