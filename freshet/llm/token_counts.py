"""Documents and their token counts in flat token files that have no index.

A flat file is a run of little-endian token ids with an end-of-document id after every document, read
as blocks of equal size that know nothing of documents. Each block is searched for the separator with
one vectorised comparison. A running sum of the blocks' separator counts numbers the documents, and
the last separator before a block, carried over blocks without one, tells where the block's first
document began; so documents that cross one or many blocks are counted whole. The running sums hold
a few numbers a block, and go over runs of RUN blocks and then over the runs, so that one file, however
large, is the work of many tasks. Files are read by ranges.

Cases: a document may be empty (two separators in a row); tokens after the last separator are a
document without an end, reported with closed = false; a file without tokens has no documents; null or
empty blocks are skipped; a block listed twice is an error of the input (its documents count twice);
an id that its width cannot hold is an error; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm import bpe
from freshet.llm.common import materialize, table, tokenizer_file

#: Tokens of a block.
BLOCK_TOKENS = 1 << 16
#: Blocks of a run.
RUN = 4096


def read_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens) of flat token files. Spark lists them; tasks open them by pyarrow's file
    systems (local and shared folders, HDFS, the object stores) and read one block's range at a time."""
    size = width * block_tokens
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    cut = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))))
    # runs of neighbouring blocks go to one task
    cut = cut.repartition(F.col("file"), F.expr("block div 64")).select("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if known[0] != file:
                    known = file, _opened(file)
                known[1].seek(block * size)
                tokens = known[1].read(size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([tokens], pa.binary())], names=["file", "block", "tokens"])

    return cut.mapInArrow(run, "file string, block long, tokens binary")


def _opened(file: str):
    """A file of one of pyarrow's file systems, open for reading at any place."""
    if file.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + file.removeprefix("file:").lstrip("/"))
    system, path = fs.FileSystem.from_uri(file)
    return system.open_input_file(path)


def write_stream(
    docs: DataFrame, separator: int = 50256, path: str | None = None, width: int = 2, block_tokens: int = BLOCK_TOKENS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(file, block, tokens, doc_ids) of the encoded documents, each followed by the separator: the flat
    file of every task, in blocks that pay no heed to where documents end. Ids take width bytes: 2 hold
    a vocabulary of up to 65,536. doc_ids names the documents that end in the block, for those who want
    to know which document is which; counting does not need it."""
    import public_tokenizers

    path = path or tokenizer_file("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    if not 0 <= separator < 1 << 8 * width:
        raise ValueError(f"the separator does not fit {width} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = bpe.coder(path, pattern), np.dtype(f"<u{width}")
        end, size = np.array([separator], kind).tobytes(), width * block_tokens
        task, number, held, named = TaskContext.get().partitionId(), 0, bytearray(), []

        def block(data, names):
            return pa.RecordBatch.from_arrays(
                [pa.array([f"task-{task:08d}"]), pa.array([number], pa.int64()), pa.array([bytes(data)], pa.binary()), pa.array([names], pa.list_(pa.int64()))],
                names=["file", "block", "tokens", "doc_ids"],
            )

        for batch in batches:
            for doc_id, value in zip(batch.column(1).to_pylist(), batch.column(0)):
                ids = np.frombuffer(coder.encode(value.as_py() or ""), "<u4")
                if len(ids) and int(ids.max()) >= 1 << 8 * width:
                    raise ValueError(f"id {ids.max()} does not fit {width} bytes")
                held += ids.astype(kind).tobytes() + end
                while len(held) > size:  # the document ends beyond this block
                    yield block(held[:size], named)
                    del held[:size]
                    number, named = number + 1, []
                named.append(doc_id)
        if held:
            yield block(held, named)

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "file string, block long, tokens binary, doc_ids array<long>")


def count_tokens(blocks: DataFrame, separator: int = 50256, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: file, doc (its number there, from 0), start (its first token's place),
    n_tokens (the separator not included), closed, and doc_id where the blocks name their documents."""
    kind = np.dtype(f"<u{width}")
    named = "doc_ids" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [b * block_tokens for b in batch.column(1).to_pylist()]
            ends = [np.flatnonzero(np.frombuffer(x.as_buffer(), kind) == separator) + at for x, at in zip(batch.column(2), first)]
            stops = [at + x.as_buffer().size // width for x, at in zip(batch.column(2), first)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(stops, pa.int64()), pa.array([len(e) for e in ends], pa.int64()),
                    pa.array([int(e[-1]) + 1 if len(e) else None for e in ends], pa.int64()), pa.array(ends, pa.list_(pa.int64())), batch.column(3),
                ],
                names=["file", "block", "stop", "n", "after", "ends", "doc_ids"],
            )

    ids = F.col("doc_ids").cast("array<long>") if named else F.lit(None).cast("array<long>")
    rows = blocks.select("file", F.col("block").cast("long").alias("block"), F.col("tokens").cast("binary").alias("tokens"), ids.alias("doc_ids"))
    found = rows.where("octet_length(tokens) > 0").mapInArrow(run, "file string, block long, stop long, n long, after long, ends array<long>, doc_ids array<long>")
    found = materialize(found, "ends")
    placed = found.join(_before(found.select("file", "block", "n", "after", "stop")), ["file", "block"])
    # an open document at the end of the file ends with it
    tail = F.col("last") & (F.coalesce("after", "begin") < F.col("stop"))
    ends = F.when(tail, F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    starts = F.concat(F.array("begin"), F.transform("ends", lambda e: e + 1))
    docs = placed.select(
        "file", "docs", "doc_ids", F.when(tail, F.size("ends")).alias("open"),
        F.posexplode(F.arrays_zip(ends.alias("stop"), F.slice(starts, F.lit(1), F.size(ends)).alias("start"))),
    )
    own = [F.get("doc_ids", F.col("pos")).alias("doc_id")] if named else []
    return docs.select(
        "file", (F.col("docs") + F.col("pos")).cast("long").alias("doc"), F.col("col.start").alias("start"),
        (F.col("col.stop") - F.col("col.start")).alias("n_tokens"), (~F.coalesce(F.col("pos") == F.col("open"), F.lit(False))).alias("closed"), *own,
    )


def _before(blocks: DataFrame) -> DataFrame:
    """(file, block, begin, docs, last) of blocks (file, block, n, after, stop): where the document began
    that the block's first token belongs to, how many documents ended before, and whether it is the
    file's last block. Runs of blocks are summed up first, then carried over the runs."""
    rows = blocks.withColumn("run", F.expr(f"block div {RUN}"))
    runs = rows.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("after").alias("after"), F.max("block").alias("block"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "file", "run", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("run_docs"), F.coalesce(F.max("after").over(over), F.lit(0)).alias("run_begin"),
        (F.col("block") == F.max("block").over(Window.partitionBy("file"))).alias("final"), F.col("block").alias("newest"),
    )
    within = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(runs, ["file", "run"]).select(
        "file", "block", F.coalesce(F.max("after").over(within), F.col("run_begin")).alias("begin"),
        (F.col("run_docs") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("docs"), (F.col("final") & (F.col("block") == F.col("newest"))).alias("last"),
    )


def op7_separator_scan(spark, sf_dir) -> DataFrame:
    """Token counts of all documents, from the blocks of the flat token streams that hold them."""
    return count_tokens(materialize(write_stream(table(spark, sf_dir, "documents", "doc_id", "text")), "tokens"))
