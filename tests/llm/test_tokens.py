import random
import re

import numpy as np
import pytest

from quillon.llm import token_scan as t

SCHEMA = "doc_id long, text string, n_tokens string, file int, ordinal long"


def brute_documents(flat, separator):
    out, n = [], 0
    for x in flat:
        if x == separator:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if n else [])


@pytest.mark.parametrize("group", [2, 1024])
def test_scan_equals_a_loop(spark, monkeypatch, group):
    monkeypatch.setattr(t, "SCAN_GROUP", group)
    r, rows, want = np.random.default_rng(group), [], {}
    for file in range(12):
        flat = r.integers(0, [3, 60, 2][file % 3], [0, 1, 7, 200, 400][file % 5]).astype(np.uint16)
        if file == 7:
            flat[:] = 1  # no separator at all
        cuts = np.sort(r.integers(0, len(flat) + 1, 9))
        for block, part in enumerate(np.split(flat, cuts)):
            rows.append((file, block, part.tobytes()))
        for ordinal, n in enumerate(brute_documents(flat, 0)):
            want[file, ordinal] = n
    got = t.documents_of(spark.createDataFrame(rows, t.BLOCKS), separator=0).collect()
    assert {(x.file, x.ordinal): x.n_tokens for x in got} == want and len(got) == len(want)


def test_round_trip_and_awkward_texts(spark):
    texts = [None, "", "a", "<|endoftext|>", "é ü 漢字 " * 50, "word " * 3000, "x" * 5000, "\n\n"]
    docs = spark.createDataFrame([(i if i != 2 else None, x, "a", 1, 5) for i, x in enumerate(texts * 3)], SCHEMA).repartition(3)
    encode = t.encoding(open(t.VOCABULARY, "rb").read()).encode_ordinary
    want = sorted(((r.doc_id, len(encode(r.text or ""))) for r in docs.collect()), key=str)
    got = t.token_counts(docs, block_tokens=512).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want
    assert t.token_counts(docs.limit(0)).collect() == []


def test_existing_files(spark, tmp_path):
    flat = np.array([5, 6, 9, 9, 7, 9, 8], np.uint16)
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    got = t.documents_of(t.read_token_files(spark, str(tmp_path), block_bytes=4), separator=9).collect()
    assert sorted((r.ordinal, r.n_tokens) for r in got) == [(0, 2), (1, 0), (2, 1), (3, 1)]


def test_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encode = t.encoding(open(t.VOCABULARY, "rb").read()).encode_ordinary
    want = {r.doc_id: len(encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in t.token_counts(docs).collect()} == want


def test_long_runs_are_cut_as_the_pattern_cuts_them(monkeypatch):
    enc, r = t.encoding(open(t.VOCABULARY, "rb").read()), random.Random(0)
    monkeypatch.setattr(t, "RUN", re.compile(f"[{t.SPACES}]{{3,}}"))
    for _ in range(2000):
        text = "".join(r.choice(" \n\t\u3000\x85\x1c\x1fab1.,'s é漢") for _ in range(r.randrange(40)))
        assert t.encode(enc, text) == enc.encode_ordinary(text)


def test_megabytes_without_a_word_or_a_space(spark):
    texts = [" " * 10_000_000 + "a", "\n" * 10_000_000, "x" * 10_000_000, "a" + " \n" * 1_000_000]
    one = t.encoding(open(t.VOCABULARY, "rb").read())._encode_single_piece
    want = [len(one(b" " * 9_999_999)) + len(one(b" a")), len(one(b"\n" * 10_000_000)), len(one(b"x" * 10_000_000)), 1 + len(one(b" \n" * 1_000_000))]
    got = {r.doc_id: r.n_tokens for r in t.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == want


def test_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    """Files of several sizes, ranges that do not end with the file, a broken last identifier; also through Spark alone."""
    r, want = np.random.default_rng(3), []
    for i, n in enumerate((0, 1, 5000, 100_003)):
        flat = r.integers(0, 50, n).astype(np.uint16)
        (tmp_path / f"a b{i}.bin").write_bytes(flat.tobytes() + b"\x07" * (i == 2))
        want += brute_documents(flat, 0)
    for known in (True, False):
        monkeypatch.setattr(t, "known_store", lambda _: known)  # noqa: B023
        got = t.documents_of(t.read_token_files(spark, str(tmp_path), block_bytes=1001), separator=0).collect()
        assert sorted(x.n_tokens for x in got) == sorted(want)
