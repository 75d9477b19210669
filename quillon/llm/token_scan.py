"""Token counts from flat token files by a separator scan.

A token file is nothing but identifiers of one width, documents one after another, each closed by
an end-of-document identifier; there is no index. Files are read as blocks that know nothing of
documents. Each block is searched for the separator as one vector operation and reduced to a row;
a prefix scan over the blocks' rows (tokens before, separators before, place of the last separator
before) then joins documents that cross blocks. The scan runs in two levels, within groups of
SCAN_GROUP blocks and over the groups' sums, so no task sees all blocks of a large file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, tasks, text_or_empty, written

#: Tokens in a block, and blocks in a group of the scan.
BLOCK_TOKENS, SCAN_GROUP = 1 << 18, 1024
#: Neighbouring blocks of a file that one task reads.
BLOCKS_TOGETHER = 64
#: Where the vocabulary lies on the driver; executors get it by broadcast (it is under 2 MB).
VOCABULARY, SEPARATOR = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: what the pattern's \\s stands for (Unicode's white space).
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space in a row from which it is cut out before the text is split.
LONG_RUN = 1024
RUN = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")
BLOCKS = "file long, block long, tokens binary"


def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str) -> list[int]:
    """The text's identifiers; special tokens are plain text.

    The pattern takes white space in a row as one piece, but for its last character where a word
    follows. Its matcher backtracks over such a run and fails on millions, so long runs are cut out
    by that rule and go to the merges as the one piece that they are.
    """
    out, at = [], 0
    for run in RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def token_files(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, width: str = "uint16", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Writes ``docs`` as flat token files, one for each input partition.

    Returns the files' blocks (file, block, tokens) and the order in which documents were written
    (file, ordinal, doc_id). A null text is an empty document: a lone separator.
    """
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file = encoding(held.value), TaskContext.get().partitionId()
        pending: list[np.ndarray] = []
        size, block, ordinal = 0, 0, 0
        end = np.array([separator], width)

        def rows(parts: list[bytes], first: int, ids: list, from_ordinal: int) -> pa.RecordBatch:
            n, m = len(parts), len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * (n + m), pa.int64()),
                    pa.array([*range(first, first + n), *[None] * m], pa.int64()),
                    pa.array([*parts, *[None] * m], pa.binary()),
                    pa.array([*[None] * n, *range(from_ordinal, from_ordinal + m)], pa.int64()),
                    pa.array([*[None] * n, *ids], pa.int64()),
                ],
                ["file", "block", "tokens", "ordinal", "doc_id"],
            )

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for x in batch.column("text"):
                pending += [np.array(encode(enc, x.as_py()), width), end]
                size += len(pending[-2]) + 1
                if size >= block_tokens:
                    flat = np.concatenate(pending)
                    cut = size - size % block_tokens
                    parts = [flat[i : i + block_tokens].tobytes() for i in range(0, cut, block_tokens)]
                    yield rows(parts, block, [], 0)
                    block, pending, size = block + len(parts), [flat[cut:]], size - cut
            yield rows([], 0, ids, ordinal)
            ordinal += len(ids)
        if size:
            yield rows([np.concatenate(pending).tobytes()], block, [], 0)

    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    both = written(read.mapInArrow(run, BLOCKS + ", ordinal long, doc_id long"))
    return both.filter("tokens is not null").select("file", "block", "tokens"), both.filter("ordinal is not null").select("file", "ordinal", "doc_id")


def read_token_files(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS, width: str = "uint16") -> DataFrame:
    """Blocks of existing flat token files of any size; file is the hash of a file's path.

    Spark lists the files with their lengths and deals out byte ranges, a row each; a task reads
    only its ranges, by seeking, with pyarrow's file systems. Stores that these do not know are
    read through Spark instead, a file at a time, which bounds a file by 2 GB there. Ranges end
    between two identifiers; bytes behind a file's last whole one are not read.
    """
    size = np.dtype(width).itemsize
    step = max(size, block_bytes - block_bytes % size)
    files = spark.read.format("binaryFile").load(path)
    names = ["file", "block", "tokens"]

    def batch_of(file: int, block: int, part: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([part], pa.binary())], names)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for file, name, block in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "block"))):
                if held is None or held[0] != name:
                    system, inner = store_of(name)
                    held = name, system.open_input_file(inner)
                held[1].seek(block * step)
                part = held[1].read(step)
                yield batch_of(file, block, part[: len(part) - len(part) % size])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                raw = content.as_buffer()
                raw = raw.slice(0, raw.size - raw.size % size)
                for block, at in enumerate(range(0, raw.size, step)):
                    yield batch_of(file, block, raw.slice(at, min(step, raw.size - at)).to_pybytes())

    named = files.select(F.xxhash64("path").alias("file"), "path", "length")
    first = named.select("path").first()
    if first is None or not known_store(first.path):
        return files.select(F.xxhash64("path").alias("file"), "content").mapInArrow(cut, BLOCKS)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))
    dealt = named.filter("length > 0").select("file", "path", F.explode(blocks).alias("block"))
    dealt = dealt.repartition(tasks(spark), F.xxhash64("path", F.floor(F.col("block") / BLOCKS_TOGETHER))).sortWithinPartitions("path", "block")
    return dealt.mapInArrow(ranges, BLOCKS)


def store_of(name: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark gives it, and the path within it."""
    if name.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", name)
    return pafs.FileSystem.from_uri(quote(name, safe="/:@"))


def known_store(name: str) -> bool:
    try:
        store_of(name)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def documents_of(blocks: DataFrame, separator: int = SEPARATOR, width: str = "uint16") -> DataFrame:
    """(file, ordinal, n_tokens) for each document of the token files; separators do not count.

    Two separators in a row enclose an empty document. Tokens behind a file's last separator are
    one more document. Blocks may have any length, also none.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places = [], []
            for x in batch.column("tokens"):
                tokens = np.frombuffer(x.as_buffer(), width)
                sizes.append(len(tokens))
                places.append(np.flatnonzero(tokens == separator))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["file", "block", "size", "places"]
            )

    found = written(blocks.mapInArrow(search, "file long, block long, size long, places array<long>"))
    each = found.withColumn("part", F.floor(F.col("block") / SCAN_GROUP))
    none = F.lit(-1).cast("long")
    in_part = Window.partitionBy("file", "part").orderBy("block")
    before = in_part.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    each = each.withColumn("tokens_before", F.coalesce(F.sum("size").over(before), zero))
    each = each.withColumn("last_here", F.when(F.size("places") > 0, F.element_at("places", -1) + F.col("tokens_before")))
    each = each.withColumn("ended_before", F.coalesce(F.sum(F.size("places")).over(before), zero)).withColumn("last_before", F.max("last_here").over(before))
    # Sums of the groups, and the same scan over them.
    parts = found.groupBy("file", F.floor(F.col("block") / SCAN_GROUP).alias("part")).agg(F.sum("size").alias("size"), F.sum(F.size("places")).alias("ended"))
    last = each.groupBy("file", "part").agg(F.max("last_here").alias("last_here"))
    parts = parts.join(last, ["file", "part"])
    over = Window.partitionBy("file").orderBy("part")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_tokens", F.coalesce(F.sum("size").over(earlier), zero)).withColumn("part_ended", F.coalesce(F.sum("ended").over(earlier), zero))
    parts = parts.withColumn("part_last_here", F.col("last_here") + F.col("part_tokens"))
    parts = written(parts.withColumn("part_last", F.max("part_last_here").over(earlier)))
    x = each.drop("last_here").join(parts.select("file", "part", "part_tokens", "part_ended", "part_last"), ["file", "part"])
    offset = F.col("part_tokens") + F.col("tokens_before")
    last_before = F.coalesce(F.col("part_tokens") + F.col("last_before"), F.col("part_last"), none)
    ends = F.transform("places", lambda p: p + offset)
    starts = F.concat(F.array(last_before), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    lengths = F.zip_with(ends, starts, lambda a, b: a - b - 1)
    closed = x.filter(F.size("places") > 0).select("file", (F.col("part_ended") + F.col("ended_before")).alias("first"), F.posexplode(lengths).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens")
    tails = parts.groupBy("file").agg(F.sum("ended").alias("ordinal"), (F.sum("size") - F.coalesce(F.max("part_last_here"), none) - 1).alias("n_tokens"))
    return closed.unionByName(tails.filter("n_tokens > 0"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, **options) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``, by way of flat token files.

    Null and empty texts have no tokens. Repeated rows each get their row; other columns are
    ignored. Texts of any length are encoded whole, also tens of megabytes without a space or of
    nothing else. An empty table gives no rows.
    """
    blocks, order = token_files(docs, vocabulary, separator, **options)
    return order.join(documents_of(blocks, separator), ["file", "ordinal"]).select("doc_id", "n_tokens")
