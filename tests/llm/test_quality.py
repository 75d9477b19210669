import zlib

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import quality_cnn as q
from quillon.llm.queries import op2_quality


def test_chunks_cover_every_byte():
    for n in (0, 1, 31, 32, 33, 511, 512, 513, 991, 992, 993, 5000):
        text = bytes(1 + i % 255 for i in range(n))
        chunks, counts = q.chunked([text, b"x"])
        assert counts.sum() == len(chunks) and counts[1] == 1
        step = q.CHUNK - q.OVERLAP
        rebuilt = b"".join(c.tobytes()[:step] for c in chunks[: counts[0]]) + chunks[counts[0] - 1].tobytes()[step:]
        assert rebuilt[:n] == text and not any(rebuilt[n:])


def test_scores_do_not_depend_on_batching():
    net, texts = q.Network.fresh(3), [b"", b"a" * 3000, "é ü".encode() * 500, b"word " * 200000]
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-6)
    assert ((together > 0) & (together < 1)).all()


def test_gradients_lower_the_loss():
    r = np.random.default_rng(0)
    texts = [[bytes(r.integers(97, 123, 300).astype(np.uint8))] if i % 2 else [b"%%% $$$ " * 40] for i in range(80)]
    labels = np.array([i % 2 for i in range(80)], float)
    net = q.train([b"".join(x) for x in texts], labels, steps=60)
    scores = net.scores([t[0] for t in texts])
    assert scores[labels == 1].min() > 0.5 > scores[labels == 0].max()


def test_awkward_tables(spark):
    schema = "doc_id long, text string, score string, held_out int"
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, "x" * 200000, None, None), (None, "abc def", "c", 3), (1, "again", "d", 4)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 1), (2, 7)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        out = q.scored(docs, q.learnt(docs, given, F.lit(True)))
        got = out.collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and sorted(out.columns) == sorted(docs.columns)
    assert q.scored(docs.limit(0), q.Network.fresh(1)).collect() == []


def test_held_out_accuracy(spark, sf):
    sf_dir = sf.replace("0.001", "0.1")
    got = op2_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    right = np.mean([r.predicted == r.quality for r in got])
    kept = np.mean([r.predicted for r in got if r.quality == 1])
    found = np.mean([1 - r.predicted for r in got if r.quality == 0])
    assert right > 0.97 and kept > 0.99 and found > 0.85


def slow_score(net, text):
    """The probability by loops over chunks, windows, filters and bytes."""
    step, evidence = q.CHUNK - q.OVERLAP, []
    for k in range(max(1, -(-(len(text) - q.OVERLAP) // step))):
        piece = text[k * step : k * step + q.CHUNK]
        seen, again, share = set(), 0, []
        windows = max(1, len(piece) - q.GRAM + 1)
        for p in range(q.CHUNK):
            if p + q.GRAM <= len(piece):
                again += piece[p : p + q.GRAM] in seen
                seen.add(piece[p : p + q.GRAM])
            share.append(again / windows if p + q.GRAM <= q.CHUNK else 0.0)
        piece = piece + bytes(q.CHUNK - len(piece))
        best = np.full(q.FILTERS, -np.inf)
        for p in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE):
            row = np.concatenate([np.append(net.embed[piece[i]], share[i]) for i in range(p, p + q.WIDTH)])
            best = np.maximum(best, [float(row @ net.filters[:, f]) for f in range(q.FILTERS)])
        maxima = np.maximum(best + net.bias, 0)
        hidden = np.maximum([float(maxima @ net.dense[:, h]) + net.dense_bias[h] for h in range(q.HIDDEN)], 0)
        evidence.append(float(hidden @ net.out) + net.out_bias[0])
    return 1 / (1 + np.exp(-np.mean(evidence)))


def test_forward_pass_equals_loops():
    net = q.Network.fresh(5)
    net.bias[:], net.dense_bias[:], net.out_bias[:] = 0.1, -0.05, 0.2
    texts = [b"", b"a", b"some words of some words of some words", "é漢 ".encode() * 70, bytes(range(1, 256)) * 3, b"abcdefgh" * 200]
    assert np.allclose(net.scores(texts), [slow_score(net, t) for t in texts], atol=1e-5)


def test_training_sees_whole_texts_within_its_bounds(spark, monkeypatch):
    """All bytes of the sampled texts reach the training, and no more of them than asked for."""
    seen = []
    monkeypatch.setattr(q, "train", lambda texts, labels, **_: seen.append((texts, labels)) or q.Network.fresh(1))
    rows = [(i, f"{i} " * (50 * i + 1)) for i in range(40)] + [(3, "again"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    q.learnt(docs, labels, F.lit(True))
    q.learnt(docs, labels, F.lit(True), sample=10)
    q.learnt(docs, labels, F.lit(True), sample_bytes=20_000)
    assert sorted(seen[0][0]) == sorted((t or "").encode() for _, t in rows) and seen[0][1].sum() == sum(i % 2 for i, _ in rows)
    assert len(seen[1][0]) == 10 and 0 < sum(map(len, seen[2][0])) <= 20_000
    assert set(seen[2][0]) <= {(t or "").encode() for _, t in rows}
