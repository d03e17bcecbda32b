"""Documents in blocks of bounded size, and exchanges of packed arrays between blocks and hash ranges.

An operator that compares every document with the whole corpus runs in three moves: each block sends what it asks for,
once for each distinct key (so a passage that a third of all documents share costs one entry a block); each hash range
answers; each block applies its answers. Rows of the exchanges are packed numpy arrays of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.shared import compact, make_room, ship, stored

BLOCK_BYTES = 12 << 20
_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))


def write_texts(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_IPC) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_texts(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    make_room()
    task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        return pa.RecordBatch.from_pydict({"block": [(task << 32) + seq], "n_bytes": [size], "n_docs": [table.num_rows], "payload": [write_texts(table)]}, schema=_SCHEMA)

    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), *batch.columns[2:]], names=["doc_id", "text", *batch.schema.names[2:]])
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        lo = 0
        for i, n in enumerate(lengths):
            size += int(n) + 8
            if size >= limit:
                held.append(batch.slice(lo, i + 1 - lo))
                yield flush()
                seq, held, size, lo = seq + 1, [], 0, i + 1
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
    if held:
        yield flush()


_SCHEMA = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])


def in_blocks(docs: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` come along as keep0, keep1 and so on. Write (block, n_bytes, n_docs, payload) to the shared folder; a block has about `limit` bytes of text, or one longer text."""
    ship(docs.sparkSession)
    small = {"compression": "uncompressed", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8", "parquet.enable.dictionary": "false"}
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    packed = compact(texts).mapInArrow(lambda b: _blocks(b, limit), "block long, n_bytes long, n_docs long, payload binary")
    return stored(packed, as_it_is=True, **small)


ANSWER = "block long, kind int, payload binary"
ANSWERS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
ASK = "part int, block long, payload binary"
ASKS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


def rows(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_answers(blocks: DataFrame, answers: DataFrame, n: int, finish: Callable, schema: str, read: Callable = read_texts) -> DataFrame:
    """finish(block, read(its payload), payloads of its answers by kind) -> record batches, for every block."""
    both = blocks.select("block", F.lit(1 << 20).alias("kind"), "payload").unionByName(answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        at, held = None, []
        for batch in batches:
            for block, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != at:
                    at, held = block, []
                if kind == 1 << 20:
                    yield from finish(block, read(payload.as_buffer()), held)
                    held = []
                else:
                    held.append(payload.as_buffer().to_pybytes())

    return both.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def sizes(blocks: DataFrame) -> tuple[int, int]:
    """Documents and bytes of text."""
    n, size = blocks.agg(F.sum("n_docs"), F.sum("n_bytes")).first()
    return n or 0, size or 0
