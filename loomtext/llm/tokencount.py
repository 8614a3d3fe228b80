"""Token counts from flat token files by a scan for separators.

A flat file is nothing but token ids of a fixed width, an end-of-document id after each document, no index.
It is cut in blocks without regard to documents.  Each block is searched for the separator by one vector
comparison; what crosses blocks is stitched by a prefix scan over one small row for each block: tokens before
it, separators before it, and the end of the last document before it.

``token_files`` writes such files from texts, as rows (file, block, data), with a manifest (file, ordinal, id).
``blocks_from_files`` cuts files of others.

A block or file that is no multiple of an id is an error, since what follows could not be read.

Nulls: a null text has no tokens; a null id is counted and listed as null.  Repeated rows are documents of
their own.  Tokens after the last separator of a file are a document that is not ``complete``; an empty file
or table has none.  Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import opened, opens
from .scratch import Scratch

# Fixed value: how the public byte-level vocabularies cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES = 1 << 20
#: What Python is given at once is a number of rows: they are cut this small, so that a thousand of them take 64 MB and not a whole file.
SLICE_BYTES = 1 << 16


def _encoder(ranks: bytes | None):
    """Texts to arrays of ids, and the separator's id. Without a vocabulary, ids are UTF-8 bytes."""
    if ranks is None:
        return (lambda text: np.frombuffer(text.encode(), np.uint8)), 256
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
    return (lambda text: np.array(encoding.encode_ordinary(text), np.int64)), max(pairs.values()) + 1


def read_vocabulary(path: str | None) -> tuple[bytes | None, int, int]:
    """A vocabulary's file, the separator's id and the bytes of an id; the file is read on the driver."""
    if path is None:
        return None, 256, 2
    with open(path, "rb") as f:
        ranks = f.read()
    eod = max(int(x.split()[1]) for x in ranks.splitlines() if x) + 1
    return ranks, eod, 2 if eod < 1 << 16 else 4


def token_files(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """Blocks (file, block, data), the manifest (file, ordinal, id), the separator's id and the bytes of an id. One file for each task."""
    spark = docs.sparkSession
    ranks, eod, width = read_vocabulary(vocabulary)
    # A vocabulary's file is of a few MB.
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(shared.value)
        kind = np.dtype(f"<u{width}")
        name = f"part-{TaskContext.get().partitionId():05d}.tokens"
        held, block, ordinal = b"", 0, 0

        def rows(blocks: list[bytes], ids: pa.Array | None) -> pa.RecordBatch:
            m = len(ids) if ids is not None else 0
            n = len(blocks) + m
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * n),
                    pa.array([*range(block, block + len(blocks)), *[None] * m], pa.int64()),
                    pa.array([*blocks, *[None] * m], pa.binary()),
                    pa.array([*[None] * len(blocks), *range(ordinal, ordinal + m)], pa.int64()),
                    pa.concat_arrays([pa.nulls(len(blocks), pa.int64()), ids]) if m else pa.nulls(n, pa.int64()),
                ],
                names=["file", "block", "data", "ordinal", "id"],
            )

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                ids = part.column("id")
                pieces = [held]
                for text in part.column("text"):
                    if text.is_valid:
                        pieces.append(encode(text.as_py()).astype(kind).tobytes())
                    pieces.append(np.array([end], kind).tobytes())
                held = b"".join(pieces)
                cut = len(held) // block_bytes
                full = [held[i * block_bytes : (i + 1) * block_bytes] for i in range(cut)]
                held = held[cut * block_bytes :]
                yield rows(full, ids)
                block += cut
                ordinal += len(ids)
        if held:
            yield rows([held], None)

    both = (scratch or Scratch(spark, "tokens")).keep(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "file string, block long, data binary, ordinal long, id long")
    )
    return both.filter("block is not null").select("file", "block", "data"), both.filter("ordinal is not null").select("file", "ordinal", "id"), eod, width


def blocks_from_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) of flat files of any size. Spark lists them and cuts their lengths in ranges, tasks read the ranges;
    a store that Arrow cannot open is read in whole files, of 2 GB at most."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes)))
    if not opens(files):
        cut = files.select(F.col("path").alias("file"), "content", block.alias("block"))
        return cut.select("file", "block", F.substring("content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = held = None
        for batch in batches:
            for file, n in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if file != name:
                    name, held = file, opened(file)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64()), pa.array([held.read_at(block_bytes, n * block_bytes)], pa.binary())], names=["file", "block", "data"])

    # Ranges of one file go to several tasks, neighbours mostly together.
    ranges = files.select(F.col("path").alias("file"), block.alias("block"))
    return ranges.repartition("file", F.floor(F.col("block") / 64)).sortWithinPartitions("file", "block").mapInArrow(run, "file string, block long, data binary")


def _ids(data: pa.Buffer, width: int) -> np.ndarray:
    if len(data) % width:
        raise ValueError(f"a block of {len(data)} bytes holds no whole ids of {width}: the file is cut off, or its ids or blocks are of another size")
    return np.frombuffer(data, f"<u{width}")


def _search(eod: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_ids(x.as_buffer(), width) for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()), pa.array([np.flatnonzero(x == eod) for x in ids], pa.list_(pa.int64()))],
                names=["file", "block", "n", "ends"],
            )

    return run


def _sliced(blocks: DataFrame) -> DataFrame:
    """Blocks cut in slices, numbered in the same order."""
    last = F.floor((F.greatest(F.octet_length("data"), F.lit(1)) - 1) / SLICE_BYTES).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.substring("data", i * SLICE_BYTES + 1, F.lit(SLICE_BYTES)).alias("data")))
    return blocks.select("file", "block", F.explode(cut).alias("s")).select("file", (F.col("block") * (1 << 24) + F.col("s.i")).alias("block"), F.col("s.data").alias("data"))


def scan_separators(blocks: DataFrame, eod: int, width: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(file, ordinal, start, n_tokens, complete): each document of flat files, the separator not counted."""
    found = (scratch or Scratch(blocks.sparkSession, "separators")).keep(_sliced(blocks).mapInArrow(_search(eod, width), "file string, block long, n long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1) + F.col("base") + 1)
    slim = found.select("file", "block", "n", "ends").withColumn("base", F.coalesce(F.sum("n").over(before), zero))
    slim = slim.withColumns({"done": F.coalesce(F.sum(F.size("ends").cast("long")).over(before), zero), "open": F.coalesce(F.max(last).over(before), zero), "all": F.size("ends") + F.coalesce(F.sum(F.size("ends").cast("long")).over(before), zero), "end": F.coalesce(F.max(last).over(upto), zero), "next": F.lead("block").over(Window.partitionBy("file").orderBy("block"))})
    whole = slim.select("file", "done", "open", "base", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.get("ends", F.col("i") - 1) + 1 + F.col("base"))
    whole = whole.select("file", (F.col("done") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("base") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    stop = F.col("base") + F.col("n")
    rest = slim.filter(F.col("next").isNull() & (stop > F.col("end"))).select("file", F.col("all").alias("ordinal"), F.col("end").alias("start"), (stop - F.col("end")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.union(rest)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens) for each row, by writing flat files and scanning them."""
    scratch = Scratch(docs.sparkSession, "counts")
    blocks, manifest, eod, width = token_files(docs, vocabulary, id_col, text_col, block_bytes, scratch)
    return scratch.finish(manifest.join(scan_separators(blocks, eod, width, scratch), ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens"))
