"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text is lower-cased and everything but letters becomes a boundary. Its subwords are all runs of
two to four code points with no boundary inside, each hashed to a row of an embedding table. The
mean of a text's rows goes through one linear layer to a softmax over languages, so scoring adds up
the rows of embeddings times weights. Both tables are trained by stochastic gradient descent.

Scores are calibrated on every CALIBRATION-th document of the sample, which the training does not
see: one temperature brings the softmax to the least log loss, and ``Model.least`` is the smallest
score down to which at most ``most_errors`` of those texts were taken for another language. Texts
that score less are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, fresh

#: Rows of the embedding table (a power of two of so many bits), their width, and code points of a subword.
BITS, DIMS, SUBWORDS = 16, 16, (2, 3, 4)
#: Code points that are hashed at a time; longer texts go in such pieces, with no subword lost.
PIECE = 1 << 19
CALIBRATION = 5
#: Parts of a language whose first documents are found before those of all of it.
SALTS = 64
UNDETERMINED = "und"
#: Multipliers of the places of a subword and of the hash (fixed values).
PLACES, MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32), np.uint32(374761393)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once in each process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def pieces(texts: list[str]) -> Iterator[tuple[int, str, int]]:
    """(text number, piece, own length): lower-cased texts behind a boundary each, long ones in pieces.

    A later piece starts with a letter, and a piece shows the three code points behind its own, so
    that each subword starts in one piece and is seen whole there.
    """
    for n, text in enumerate(texts):
        low = "\0" + text.lower()
        at = 0
        while at < len(low):
            to = at + PIECE
            while to < len(low) and not low[to].isalpha():
                to += 1
            to = min(to, len(low))
            yield n, low[at : to + 3], to - at
            at = to


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, buckets) of all subwords of all texts, in bounded parts."""
    held, size = [], 0
    for p in pieces(texts):
        held.append(p)
        size += len(p[1])
        if size >= PIECE:
            yield from hashed(held)
            held, size = [], 0
    if held:
        yield from hashed(held)


def hashed(held: list[tuple[int, str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    points = np.frombuffer("".join(p for _, p, _ in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) for _, p, _ in held])
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.array([n for n, _, _ in held], np.int32), sizes)
    own = np.arange(len(points)) - np.repeat(starts, sizes) < np.repeat(np.array([x for *_, x in held]), sizes)
    points = np.where(letters()[points], points, np.uint32(0))
    # Of boundaries in a row one stays, and each piece's first code point.
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    keep[starts] = True
    points, text, own = points[keep], text[keep], own[keep]
    n = len(points)
    points = np.concatenate([points, np.zeros(max(SUBWORDS), np.uint32)])
    letter = points != 0
    h, inside = points[:n] * PLACES[0], letter[:n] | letter[1 : n + 1]
    for length in range(2, max(SUBWORDS) + 1):
        h = h + points[length - 1 : n + length - 1] * PLACES[length - 1]
        if length > 2:
            inside = inside & letter[length - 2 : n + length - 2]
        if length in SUBWORDS:
            at = np.flatnonzero(inside & own)
            x = h[at] + np.uint32(length)
            yield text[at], ((x ^ (x >> np.uint32(15))) * MIX) >> np.uint32(32 - BITS)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its different buckets and their shares of its subwords."""
    parts = list(subwords(texts))
    key = np.concatenate([(n.astype(np.int64) << BITS) | b for n, b in parts]) if parts else np.zeros(0, np.int64)
    key, count = np.unique(key, return_counts=True)
    cuts = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
    return [(key[a:b] & ((1 << BITS) - 1), (count[a:b] / max(1, count[a:b].sum())).astype(np.float32)) for a, b in zip(cuts, cuts[1:])]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    @staticmethod
    def fresh(languages: list[str], seed: int) -> Model:
        r = np.random.default_rng(seed)
        return Model(languages, r.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS)).astype(np.float32), np.zeros((DIMS, len(languages)), np.float32), np.zeros(len(languages), np.float32))

    def logits(self, texts: list[str]) -> np.ndarray:
        """The softmax's inputs for each text, from the mean of its subwords' rows; without subwords the bias alone."""
        few = len(self.languages) <= DIMS
        table = np.ascontiguousarray((self.embeddings @ self.weights if few else self.embeddings).T)
        sums, counts = np.zeros((len(texts), len(table))), np.zeros(len(texts))
        for n, b in subwords(texts):
            counts += np.bincount(n, minlength=len(texts))
            for i, column in enumerate(table):
                sums[:, i] += np.bincount(n, column[b], len(texts))
        mean = sums / np.maximum(counts, 1)[:, None]
        return (mean if few else mean @ self.weights) + self.bias

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, calibrated probability) for each text; of equal ones the first."""
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(texts)), best]


def train(texts: list[str], labels: list[str], epochs: int = 8, rate: float = 0.5, most_errors: float = 0.005, seed: int = 1) -> Model:
    """Stochastic gradient descent, a text at a time, on the log loss; then calibration.

    Each text is seen whole, and as two random stretches of 15 to 200 code points, so that short
    texts are known as well. The step along a text's rows is divided by the squares of their shares.
    """
    languages = sorted(set(labels))
    model, r = Model.fresh(languages, seed), np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    examples, marks, kept_out = [], [], []
    for i, (text, label) in enumerate(zip(texts, labels)):
        stretches = [text]
        for _ in range(2):
            size = int(r.integers(15, 200))
            at = int(r.integers(0, max(1, len(text) - size)))
            stretches.append(text[at : at + size])
        for x in stretches:
            if has_letter(x):
                examples.append(x)
                marks.append(number[label])
                kept_out.append(i % CALIBRATION == CALIBRATION - 1 and len(texts) >= CALIBRATION)
    marks, kept_out = np.array(marks, int), np.array(kept_out, bool)
    # A few texts at a time: the subwords of all, with their repeats, would be large.
    found = [bag for at in range(0, len(examples), 32) for bag in bags(examples[at : at + 32])]
    learnt_from = np.flatnonzero(~kept_out)
    steps, step = max(1, epochs * len(learnt_from)), 0
    e, w, bias = model.embeddings, model.weights, model.bias
    for _ in range(epochs):
        for i in r.permutation(learnt_from):
            rows, share = found[i]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            mine = e[rows]
            mean = share @ mine
            p = softmax(mean @ w + bias).astype(np.float32)
            p[marks[i]] -= 1
            back = w @ p
            w -= now * np.outer(mean, p)
            bias -= np.float32(0.1) * now * p
            e[rows] = mine - np.outer(share * (now / (share @ share)), back)
    calibrate(model, [x for x, out in zip(examples, kept_out) if out], marks[kept_out], most_errors)
    return model


def calibrate(model: Model, texts: list[str], marks: np.ndarray, most_errors: float) -> None:
    """Sets the temperature with the least log loss, and the least score that is accepted."""
    if not texts:
        return
    logits, each = model.logits(texts), np.arange(len(texts))
    tried = np.geomspace(0.05, 20, 121)
    losses = [-np.log(np.maximum(softmax(logits / t)[each, marks], 1e-300)).mean() for t in tried]
    model.temperature = float(tried[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    best, score = p.argmax(axis=1), p.max(axis=1)
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(best[order] != marks[order]) / (each + 1)
    fine = np.flatnonzero(wrong <= most_errors)
    # Nothing is accepted if already the surest are wrong.
    model.least = float(score[order][fine[-1]]) if len(fine) else float(np.nextafter(1, 2))


def held_out(id_col: str = "doc_id", folds: int = 3) -> Column:
    """Whether crc32 of the id as text leaves 1; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 1, F.lit(True))


def learnt(docs: DataFrame, usable: Column, each: int = 500, sample: int = 4000, sample_bytes: int = 8 << 20, **options) -> Model | None:
    """A model of the languages of ``docs`` (doc_id, text, lang), from a bounded sample; None without labelled texts.

    The sample are ``each`` documents of a language at most, the first in the order of a hash of the
    id, taken in turn from all languages until there are ``sample`` documents; one whose whole text
    goes beyond what is left of ``sample_bytes`` is left out, so late in the sample only short
    texts are. Rows without id, language or any letter, and those for which ``usable`` does not
    hold, are not learnt from. Rows that are equal take a place each and are learnt from once; texts
    of one id count each.
    """
    rows = docs.filter(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = [F.col("doc_id").cast("string").alias("i"), F.col("lang").alias("lang"), F.xxhash64("text").alias("h")]
    in_order = [F.xxhash64("i"), F.col("i"), F.col("h")]
    # In two levels: what all tasks have of a frequent language goes to one task only when it is little.
    places = rows.select(*key, F.octet_length("text").alias("n")).withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)))
    for by in (("lang", "salt"), ("lang",)):
        places = places.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*in_order))).filter(F.col("r") <= each)
    places = places.drop("salt")
    # Rows that repeat stand side by side; they are told apart only here, where they are few.
    chosen = places.distinct().orderBy("r", "lang").limit(sample).collect()
    taken, left = {}, sample_bytes
    for r in chosen:
        if r.n <= left and (r.i, r.lang, r.h) not in taken:
            taken[r.i, r.lang, r.h] = r.r
            left -= r.n
    if not taken:
        return None
    wanted = docs.sparkSession.createDataFrame([(*k, r) for k, r in taken.items()], "i string, lang string, h long, r int")
    texts = rows.select(*key, "text").join(F.broadcast(wanted), ["i", "lang", "h"]).dropDuplicates(["i", "lang", "h"]).toArrow().sort_by([("r", "ascending"), ("lang", "ascending"), ("h", "ascending")])
    return train(texts.column("text").to_pylist(), texts.column("lang").to_pylist(), **options)


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted in front; columns of these names are replaced.

    lang_pred is the likeliest language of the whole text, however long, and score its calibrated
    probability; accepted tells whether that is not below ``model.least``. A text that is null,
    empty or has no letter is ``und`` with score 0 and not accepted, as are all texts without a
    model. Repeated rows each get their row, an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    names = ("lang_pred", "score", "accepted")
    kept, found = [c for c in docs.columns if c.lower() not in names], fresh(docs, "found")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = np.array([model is not None and has_letter(x) for x in texts], bool)
            out = pd.DataFrame({"lang_pred": np.full(len(texts), UNDETERMINED, object), "score": np.zeros(len(texts)), "accepted": np.zeros(len(texts), bool)})
            if known.any():
                best, score = model.scores(list(texts[known]))
                out.loc[known, "lang_pred"] = np.array(model.languages, object)[best]
                out.loc[known, "score"] = score
                out.loc[known, "accepted"] = score >= model.least
            yield out

    of = F.pandas_udf(run, "lang_pred string, score double, accepted boolean")
    tagged = docs.select(of(F.col(text_col)).alias(found), *[F.col(f"`{c}`") for c in kept])
    return tagged.select(*[F.col(f"`{found}`.{n}").alias(n) for n in names], *[F.col(f"`{c}`") for c in kept])
