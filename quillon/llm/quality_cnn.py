"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of CHUNK bytes, each overlapping the next, that cover all of it. Bytes
are embedded, one more channel tells how much of the chunk up to a byte repeats what came before in
it, learned filters slide over all channels, and each filter's maximum over the chunk is kept. A
small dense layer turns a chunk's maxima into evidence; the mean evidence of all chunks gives one
probability for the document.

The network is trained on the driver, on a bounded sample of labelled rows in the order of a hash of
the id: ``sample`` documents and ``sample_bytes`` bytes of text at most. Texts in the sample are
whole: all their chunks are seen in each epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, text_bytes

CHUNK, OVERLAP = 512, 32
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 2, 24, 16
CHANNELS = EMBED + 1
#: Chunks that are convolved at a time, and bytes of a window that counts as a repetition.
AT_ONCE, GRAM = 64, 8
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all texts (zero bytes behind the end) and the number of chunks of each text."""
    step = CHUNK - OVERLAP
    counts = np.array([max(1, -(-(len(t) - OVERLAP) // step)) for t in texts], dtype=np.int64)
    out = np.zeros((int(counts.sum()), CHUNK), np.uint8)
    at = 0
    for t, n in zip(texts, counts):
        flat = np.zeros(n * step + OVERLAP, np.uint8)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (step, 1))
        at += n
    return out, counts


def repetition(chunks: np.ndarray) -> np.ndarray:
    """For each byte: the share of the chunk's windows that start up to it and occur before in the chunk."""
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(chunks, GRAM, axis=1)).view(np.uint64)[..., 0]
    order = np.argsort(grams, axis=1, kind="stable")
    ordered = np.take_along_axis(grams, order, axis=1)
    again = np.zeros(grams.shape, bool)
    np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
    # Padding is one repeated window; only windows of the filled part count.
    filled = CHUNK - (chunks[:, ::-1] != 0).argmax(axis=1)
    filled[~(chunks != 0).any(axis=1)] = 0
    windows = np.maximum(1, filled - GRAM + 1)
    again &= np.arange(grams.shape[1]) < windows[:, None]
    out = np.zeros(chunks.shape, np.float32)
    out[:, : grams.shape[1]] = np.cumsum(again, axis=1, dtype=np.float32) / windows[:, None]
    return out


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(seed: int) -> Network:
        r, f = np.random.default_rng(seed), np.float32
        return Network(
            (r.normal(size=(256, EMBED)) * 0.5).astype(f),
            (r.normal(size=(WIDTH * CHANNELS, FILTERS)) / np.sqrt(WIDTH * CHANNELS)).astype(f), np.zeros(FILTERS, f),
            (r.normal(size=(FILTERS, HIDDEN)) / np.sqrt(FILTERS)).astype(f), np.zeros(HIDDEN, f),
            (r.normal(size=HIDDEN) / np.sqrt(HIDDEN)).astype(f), np.zeros(1, f),
        )

    def channels(self, chunks: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        out = np.empty((*chunks.shape, CHANNELS), np.float32)
        out[..., :EMBED] = self.embed[chunks]
        out[..., EMBED] = repeats
        return out

    def pooled(self, chunks: np.ndarray, repeats: np.ndarray, places: bool = False):
        """Each filter's maximum over each chunk, and where it is."""
        best, where = [], []
        for at in range(0, len(chunks), AT_ONCE):
            x = self.channels(chunks[at : at + AT_ONCE], repeats[at : at + AT_ONCE])
            s = x.strides
            windows = np.lib.stride_tricks.as_strided(x, (len(x), PLACES, WIDTH * CHANNELS), (s[0], s[1] * STRIDE, s[2]))
            maps = (windows.reshape(-1, WIDTH * CHANNELS) @ self.filters).reshape(len(x), PLACES, FILTERS)
            if places:
                where.append(maps.argmax(axis=1))
                best.append(np.take_along_axis(maps, where[-1][:, None], axis=1)[:, 0])
            else:
                best.append(maps.max(axis=1))
        pooled = np.maximum(np.concatenate(best) + self.bias, 0)
        return (pooled, np.concatenate(where)) if places else pooled

    def evidence(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.dense + self.dense_bias, 0)
        return hidden @ self.out + self.out_bias[0], hidden

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One probability for each text; an empty text is one empty chunk."""
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            # A bounded number of bytes at a time; a longer text goes alone, in blocks of chunks.
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= 1 << 20:
                size += len(texts[to])
                to += 1
            chunks, counts = chunked(texts[at:to])
            logits = np.concatenate([self.evidence(self.pooled(c, repetition(c)))[0] for c in (chunks[i : i + 1024] for i in range(0, len(chunks), 1024))])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            mean = np.add.reduceat(logits.astype(np.float64), starts) / counts
            out[at:to] = 1 / (1 + np.exp(-np.clip(mean, -40, 40)))
            at = to
        return out


def train(texts: list[bytes], labels: np.ndarray, steps: int = 700, batch: int = 32, rate: float = 4e-3, seed: int = 1) -> Network:
    """Adam on the log loss of whole documents; gradients pass the maxima."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "dense", "dense_bias", "out", "out_bias")
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    every, each = chunked(texts)
    marks = np.concatenate([repetition(every[i : i + 1024]).astype(np.float16) for i in range(0, len(every), 1024)])
    firsts = np.concatenate([[0], np.cumsum(each)[:-1]])
    epochs = -(-steps // -(-len(texts) // batch))
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            counts = each[docs]
            owner = np.repeat(np.arange(len(docs)), counts)
            rows = np.concatenate([np.arange(firsts[i], firsts[i] + each[i]) for i in docs])
            c, e = every[rows], marks[rows].astype(np.float32)
            pooled, where = net.pooled(c, e, places=True)
            logits, hidden = net.evidence(pooled)
            mean = np.bincount(owner, logits, len(docs)) / counts
            error = (1 / (1 + np.exp(-np.clip(mean, -40, 40))) - labels[docs]) / len(docs)
            d_logit = (error / counts)[owner].astype(np.float32)
            d_hidden = d_logit[:, None] * net.out * (hidden > 0)
            d_pooled = (d_hidden @ net.dense.T) * (pooled > 0)
            # The windows at the maxima, for each chunk and filter.
            places = (where * STRIDE)[..., None] + np.arange(WIDTH)
            chunk = np.arange(len(c))[:, None, None]
            taken = c[chunk, places]
            windows = np.concatenate([net.embed[taken], e[chunk, places][..., None]], axis=-1).reshape(len(c), FILTERS, WIDTH * CHANNELS)
            d_windows = (d_pooled[..., None] * net.filters.T).reshape(-1, CHANNELS)[:, :EMBED]
            d_embed = np.stack([np.bincount(taken.reshape(-1), d_windows[:, i], 256) for i in range(EMBED)], axis=1)
            grads = {
                "embed": d_embed, "filters": np.einsum("cf,cfw->wf", d_pooled, windows), "bias": d_pooled.sum(axis=0),
                "dense": pooled.T @ d_hidden, "dense_bias": d_hidden.sum(axis=0), "out": hidden.T @ d_logit, "out_bias": d_logit.sum(keepdims=True),
            }
            step += 1
            now = rate * min(1, step / 20) * (1 - step / (total + 1))
            for n in names:
                m, v = moments[n]
                m += 0.1 * (grads[n] - m)
                v += 0.01 * (grads[n] ** 2 - v)
                setattr(net, n, (getattr(net, n) - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return net


def learnt(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 3000, sample_bytes: int = 16 << 20, **options) -> Network:
    """A network trained on ``sample`` labelled documents and ``sample_bytes`` bytes of text at most.

    ``labels`` has doc_id and quality; rows whose label is neither 0 nor 1 are left out, as are ids
    for which ``usable`` (over doc_id) does not hold. The sample is the first in the order of a
    hash of the id, so every run takes the same; a document whose whole text would go beyond
    ``sample_bytes`` is left out of it. Rows that repeat an id, or share one, count each. Null and
    empty texts are examples too. Without labelled rows all scores are those of an untrained output
    of one half. If all labels agree, the network learns that one.
    """
    rows = labels.filter(usable & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", F.xxhash64(text_bytes()).alias("h"), text_bytes().alias("text"))
    found = texts.join(F.broadcast(rows), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "h", "text")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality"), F.col("h")]
    # Only ids, hashes and lengths are put in order; texts are fetched once it is known which.
    sizes = found.select("doc_id", "quality", "h", F.octet_length("text").alias("n")).orderBy(*order).limit(sample).collect()
    taken, left = [], sample_bytes
    for r in sizes:
        if r.n <= left:
            taken.append((r.doc_id, r.quality, r.h))
            left -= r.n
    if not taken:
        net = Network.fresh(1)
        net.out[:] = 0
        return net
    wanted = docs.sparkSession.createDataFrame(taken, found.select("doc_id", "quality", "h").schema)
    table = found.join(F.broadcast(wanted.groupBy("doc_id", "quality", "h").agg(F.count("*").alias("times"))), ["doc_id", "quality", "h"])
    table = table.orderBy(*order).limit(len(taken)).toArrow()
    return train([x.as_py() for x in table.column("text")], np.array(table.column("quality").to_pylist(), float), **options)


def scored(docs: DataFrame, net: Network, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` in front: the probability that quality is 1.

    Only the whole text counts, however long; null and empty texts are one empty chunk. Repeated
    rows each get their row, an empty table gives none. All columns of ``docs`` are kept; a column
    called ``name`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(net.scores([b"" if x is None else bytes(x) for x in t]))

    score = F.pandas_udf(run, "double")
    return docs.select(score(text_bytes(text_col)).alias(name), *[F.col(f"`{c}`") for c in kept])


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))
