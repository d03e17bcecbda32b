"""Benchmark decontamination by winnowing.

Fingerprints are the minimal k-gram hashes of each sliding window of w = span + 1 - k k-grams, on both sides, so every
span of `span` shared words has a shared fingerprint. Items of fewer than `span` words are one window of their own length and
are their own fingerprint. Three moves, alike for any size of the benchmark:

1. The test items' fingerprints fill a bit table of fixed size, which is broadcast; a large benchmark fills more of it and no more.
2. Documents are scanned once. Fingerprints whose bit is set are extended to all windows around them, and these windows,
   as words, are the rows that leave a document. Each document row takes a number of its own, written with them.
3. Windows are joined with the items' windows by their words, an equi-join of which Spark splits a window that very many
   documents share, and what is found is gathered by row number.

Defined results: a null or empty text has no words, so it is never hit; an item without words is ignored; items of equal
text or equal id all count (ids once; null counts as one id and is named in no digest); document rows are judged one by one, whatever ids they repeat;
empty tables give an empty result or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm.vec import ALNUM, LOWER, U64, Words, grams, mix, whole, words_of
from ballast.shared import compact, make_room, ship, stored

SPAN, K = 10, 5
#: Bytes of the table of fingerprints, a power of two.
TABLE = 4 << 20
#: Rows to drop that are broadcast at most; more are joined.
BROADCAST_ROWS = 500_000


def winnowed(g: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Positions whose k-gram hash is least in some window of w k-grams of one text."""
    if len(g) < w:
        return np.zeros(0, dtype=np.int64)
    g = np.where(ok, g, U64(0xFFFFFFFFFFFFFFFF))
    least = g[: len(g) - w + 1].copy()
    for i in range(1, w):
        np.minimum(least, g[i : len(g) - w + 1 + i], out=least)
    keep = np.zeros(len(g), dtype=bool)
    for i in range(w):
        keep[i : i + len(least)] |= g[i : i + len(least)] == least
    return np.flatnonzero(keep & ok)


def _bit(h: np.ndarray, n: int, size: int) -> np.ndarray:
    """The bit of each fingerprint in a table of `size` bytes, a power of two."""
    return (mix(h + U64(n)) & U64(8 * size - 1)).astype(np.int64)


class Prints:
    """The bits of the test items' fingerprints, and the lengths of their windows."""

    def __init__(self, bits: np.ndarray, lengths: list[int], span: int = SPAN, k: int = K):
        self.bits, self.lengths, self.span, self.k = bits, lengths, span, k

    def has(self, h: np.ndarray, n: int) -> np.ndarray:
        at = _bit(h, n, len(self.bits))
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def windows(self, w: Words) -> Iterator[tuple[int, np.ndarray]]:
        """(length, first words) of the windows around fingerprints whose bit is set, each within one text."""
        h = w.hashes()
        for n in self.lengths:
            ok = whole(w, n)
            if n == self.span:
                g = grams(h, self.k)
                at = winnowed(g, whole(w, self.k), self.span + 1 - self.k)
                at = at[self.has(g[at], n)]
                near = (at[:, None] - np.arange(self.span - self.k + 1)).ravel()
                near = np.unique(near[(near >= 0) & (near < len(ok))])
            else:
                near = np.flatnonzero(self.has(grams(h, n), n))
            yield n, near[ok[near]]


def _line(w: Words, i: int, n: int) -> bytes:
    return b" ".join(w.word(j) for j in range(i, i + n))


_ITEMS = pa.schema([("item", pa.string()), ("n", pa.int32()), ("window", pa.binary())])
_BITS = pa.schema([("n", pa.int32()), ("bits", pa.binary())])


def _item_windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in words_of(batch.column(1), ALNUM, LOWER):
            for i in range(w.hi - w.lo):
                a, b = int(w.first[i]), int(w.first[i + 1])
                n = min(span, b - a)
                if n:
                    lines = [_line(w, j, n) for j in range(a, b - n + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[w.lo + i].as_py()] * len(lines), pa.string()), pa.array([n] * len(lines), pa.int32()), pa.array(lines, pa.binary())], schema=_ITEMS)


def _item_bits(batches: Iterator[pa.RecordBatch], span: int, k: int, size: int) -> Iterator[pa.RecordBatch]:
    """One bit table for each window length of a task's items."""
    tables: dict[int, np.ndarray] = {}
    for batch in batches:
        for w in words_of(batch.column(1), ALNUM, LOWER):
            h = w.hashes()
            g = grams(h, k)
            at = [(span, g[winnowed(g, whole(w, k), span + 1 - k)])]
            short = np.flatnonzero((w.counts > 0) & (w.counts < span))
            at += [(int(w.counts[i]), grams(h[w.first[i] : w.first[i + 1]], int(w.counts[i]))) for i in short.tolist()]
            for n, x in at:
                if len(x):
                    own = tables.setdefault(n, np.zeros(size, np.uint8))
                    bit = _bit(x, n, size)
                    np.bitwise_or.at(own, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    for n, own in tables.items():
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([own.tobytes()], pa.binary())], schema=_BITS)


_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("window", pa.binary())])
FOUND = "row long, doc_id long, n_words long, first long, n int, window binary"


def _scan(batches: Iterator[pa.RecordBatch], prints: Prints) -> Iterator[pa.RecordBatch]:
    """Of each document row (row, doc_id, n_words); of each window around a fingerprint (row, first, n, window). A third column of a batch is the row number."""
    make_room()
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        own = batch.column(2).to_numpy() if batch.num_columns > 2 else np.arange(row, row + batch.num_rows)
        row += batch.num_rows
        for w in words_of(batch.column(1), ALNUM, LOWER):
            m = w.hi - w.lo
            none = pa.nulls(m)
            yield pa.RecordBatch.from_arrays([pa.array(own[w.lo : w.hi]), batch.column(0).slice(w.lo, m), pa.array(w.counts), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=_FOUND)
            for n, at in prints.windows(w):
                for lo in range(0, len(at), 4096):
                    part = at[lo : lo + 4096]
                    text = np.searchsorted(w.first, part, side="right") - 1
                    none = pa.nulls(len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(own[w.lo + text]), none, none, pa.array(part - w.first[text]), pa.array(np.full(len(part), n, np.int32)), pa.array([_line(w, i, n) for i in part.tolist()], pa.binary())], schema=_FOUND)


def _found(docs: DataFrame, tests: DataFrame, item_col: str, item_text_col: str, span: int, k: int, size: int) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text[, row]). The document rows (row, doc_id, n_words), and the windows that occur (row, first, n, item)."""
    spark = docs.sparkSession
    ship(spark)
    items = tests.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    windows = stored(items.mapInArrow(lambda b: _item_windows(b, span), "item string, n int, window binary").distinct())
    bits, lengths = np.zeros(size, np.uint8), set()
    for r in items.mapInArrow(lambda b: _item_bits(b, span, k, size), "n int, bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
        lengths.add(r["n"])
    shared = spark.sparkContext.broadcast(Prints(bits, sorted(lengths), span, k))
    found = stored(compact(docs).mapInArrow(lambda b: _scan(b, shared.value), FOUND), as_it_is=True)
    occurs = found.where("n is not null").select("row", "first", "n", "window").join(windows, ["n", "window"]).select("row", "first", "n", "item")
    return found.where("n is null").select("row", "doc_id", "n_words"), occurs


def find_leaks(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, table: int = TABLE) -> DataFrame:
    """(doc_id, n_words, hits, items): for each document the merged spans of hit words and the sorted items that occur."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, occurs = _found(texts, tests, item_col, item_text_col, span, k, table)
    at = F.struct("first", (F.col("first") + F.col("n") - 1).alias("last"))
    found = occurs.groupBy("row").agg(F.array_sort(F.collect_set(at)).alias("spans"), F.array_sort(F.collect_set(F.struct("item"))).alias("items"))
    none = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")
    merged = F.aggregate(
        F.col("spans"),
        none,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["first"] <= F.element_at(acc, -1)["last"] + 1),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = found.select("row", merged.alias("hits"), F.array_sort(F.transform("items", lambda x: x["item"])).alias("items"))
    return rows.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def drop_leaks(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, table: int = TABLE) -> DataFrame:
    """The rows of docs, all columns, in which no window of a test item occurs."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    _, occurs = _found(kept.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(row).alias("row")), tests, item_col, item_text_col, span, k, table)
    hit = stored(occurs.select(F.col("row").alias(row)).distinct(), True)
    few = hit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return kept.join(F.broadcast(hit) if few else hit, row, "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return find_leaks(docs, tests).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' '))) g FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) g FROM d, ns WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
