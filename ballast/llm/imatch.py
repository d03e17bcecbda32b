"""Document fingerprints by I-Match over randomised lexicons.

The document frequency of every term is counted over all documents. The lexicon keeps terms within a band of it; as a
document has d distinct terms on average, the lower end of the band bounds the lexicon at d / low terms whatever the
corpus. 32 subsets of the lexicon are drawn at four rates (a quarter down to a 256th). For each subset a document's
distinct terms are sorted and hashed together; subsets in which it has no term give none. A text with words but without a
term in any subset is hashed by all its distinct words instead, so that only texts of the same words are alike. Likeness of two
fingerprints is the share of equal hashes among the subsets where either has one, and 1 where neither has any.

Defined results: a null or empty text has no terms, its fingerprint is all zeros and its likeness to another such is 1;
a null id comes after all others; repeated rows repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.llm.blocks import ASK, ASKS, rows
from ballast.llm.vec import ALNUM, LOWER, U64, Lookup, mix, pack_sorted, unpack_sorted, words_of
from ballast.shared import ship, stored

SUBSETS = 32
LOW, HIGH, LEAST_DOCS = 0.0005, 0.1, 2


def _counts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Document frequencies within this task's documents, by hash range."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        h = np.concatenate([x for x, _ in held])
        terms, at = np.unique(h, return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
        part = ((terms >> U64(40)) * U64(parts) >> U64(24)).astype(np.int64)
        edge = np.searchsorted(part, np.arange(parts + 1)).tolist()
        own = [(p, pack_sorted(terms[a:b], n[a:b])) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]
        return rows(ASKS, [p for p, _ in own], [0] * len(own), [x for _, x in own])

    for batch in batches:
        for w in words_of(batch.column(0), ALNUM, LOWER):
            h = w.hashes()
            once = h[np.unique(mix(h + w.owner().astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]]
            held.append(np.unique(once, return_counts=True))
            size += len(held[-1][0])
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def lexicon(docs: DataFrame, text_col: str, n_docs: int, n_bytes: int, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Hashes of the terms within the band of document frequency, sorted."""
    parts = max(4, n_bytes // (64 << 20))
    least, most = max(LEAST_DOCS, low * n_docs), high * n_docs

    def band(batches):
        found = [unpack_sorted(x) for batch in batches for x in batch.column(2).to_pylist()]
        if found:
            h, c = (np.concatenate(x) for x in zip(*found, strict=True))
            terms, at = np.unique(h, return_inverse=True)
            c = np.bincount(at, c)
            keep = terms[(c >= least) & (c <= most)]
            yield pa.RecordBatch.from_pydict({"terms": [keep.tobytes()]}, schema=pa.schema([("terms", pa.binary())]))

    kept = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda b: _counts(b, parts), ASK).repartition(parts, "part").mapInArrow(band, "terms binary")
    return np.sort(np.concatenate([np.zeros(0, U64), *(np.frombuffer(r["terms"], U64) for r in kept.toLocalIterator())]))


class Printer:
    def __init__(self, terms: np.ndarray):
        self.lookup = Lookup(terms)
        self.terms = self.lookup.values
        self.mask = np.zeros(len(terms), dtype=np.uint32)
        for s in range(SUBSETS):
            rate = 2.0 ** -(2 + 2 * (s % 4))
            keep = mix(self.terms + U64((s + 1) * 0xD1342543DE82EF95 % 2**64)) < U64(int(rate * 2**64))
            self.mask |= keep.astype(np.uint32) << np.uint32(s)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """A row of 32 hashes for each text; 0: no term."""
        out = np.zeros((len(texts), SUBSETS), dtype=np.uint32)
        for w in words_of(texts, ALNUM, LOWER):
            h = w.hashes()
            at = self.lookup(h)
            if len(at):
                key = np.unique(w.owner()[at] * np.int64(len(self.terms)) + np.searchsorted(self.terms, h[at]))  # terms of each text, distinct and sorted
                text, term = key // len(self.terms), key % len(self.terms)
                edge = np.searchsorted(text, np.arange(w.hi - w.lo + 1))
                value, mask = mix(self.terms[term] + U64(1)), self.mask[term]
                for s in range(SUBSETS):
                    sel = (mask >> np.uint32(s)) & np.uint32(1) > 0
                    count = np.concatenate(([0], np.cumsum(sel)))[edge]
                    total = np.concatenate((np.zeros(1, U64), np.cumsum(np.where(sel, value, U64(0)), dtype=U64)))[edge]
                    n = np.diff(count)
                    hashed = (mix(total[1:] - total[:-1] + n.astype(U64)) >> U64(32)).astype(np.uint32)
                    out[w.lo : w.hi, s] = np.where(n > 0, np.maximum(hashed, 1), 0)
            for i in np.flatnonzero((w.counts > 0) & ~out[w.lo : w.hi].any(axis=1)).tolist():
                every = np.unique(h[w.first[i] : w.first[i + 1]])
                total = mix(every + U64(2)).sum(dtype=U64) + U64(len(every))
                out[w.lo + i] = np.maximum(mix(total + np.arange(SUBSETS, dtype=U64)) >> U64(32), 1).astype(np.uint32)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    either = ((a > 0) | (b > 0)).sum(axis=1)
    return np.where(either > 0, ((a == b) & (a > 0)).sum(axis=1) / np.maximum(either, 1), 1.0)


def _hex(a: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in a.astype(">u4")]


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each text, 256 hex digits."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    known = docs.sparkSession.sparkContext.broadcast(lexicon(texts, "text", n, size or 0))

    def run(batches):
        printer = Printer(known.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(printer(batch.column(1))), pa.string())], names=["doc_id", "fingerprint"])

    return texts.mapInArrow(run, "doc_id long, fingerprint string")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OUT = RESULT + ", part int, end int, text string"
#: Ends of a range: its first row, its last.
HEAD, TAIL = 1, 2


def _compared(ids: list[int | None], texts: list[str], printer: Printer) -> pa.RecordBatch:
    """Rows in order against the next each; texts has one more."""
    own, after = texts[:-1], texts[1:]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, after, strict=True)]
    prints, changed = printer(pa.array(texts, pa.string())), printer(pa.array(edited, pa.string()))
    none = [None] * len(own)
    return rows(_OUT, ids, [len(x) for x in own], [hashlib.sha256(x.encode()).hexdigest() for x in edited], _hex(prints[:-1]), _hex(changed), likeness(prints[:-1], changed), likeness(prints[:-1], prints[1:]), none, none, none)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack_text = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack_text(x.as_buffer()) for x in batch.column(3)], pa.binary())], names=["doc_id", "head", "tie", "packed"])


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 12 << 20) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document by descending id.

    Rows are ranged by descending id, rows of one id by their first 8 characters and then as they are read, so ranges are
    even whatever ids repeat; a text moves once, packed. A range is streamed; its first and last row are kept, and the last
    one's next is the first of the range after it, joined by number. The first range comes after the last.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    terms = spark.sparkContext.broadcast(lexicon(texts, "text", n, size or 0))
    keyed = texts.select("doc_id", F.substring("text", 1, 8).alias("head"), F.monotonically_increasing_id().alias("tie"), "text")
    order = (F.desc_nulls_last("doc_id"), F.asc("head"), F.asc("tie"))
    ranged = keyed.mapInArrow(_packed, "doc_id long, head string, tie long, packed binary").repartitionByRange(max(1, (size or 0) // range_bytes), *order).sortWithinPartitions(*order)

    def compare(batches):
        printer, unpack_text = Printer(terms.value), zstandard.ZstdDecompressor().decompress
        part, ids, held, before, first = TaskContext.get().partitionId(), [], [], 0, True

        def end(kind: int, i: int | None, text: str) -> pa.RecordBatch:
            return rows(_OUT, [i], *[[None]] * 6, [part], [kind], [text])

        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                text = unpack_text(packed.as_buffer()).decode()
                if first:
                    yield end(HEAD, i, text)
                    first = False
                ids.append(i)
                held.append(text)
                before += len(text)
                if before > 2_000_000 and len(ids) > 1:
                    yield _compared(ids[:-1], held, printer)
                    ids, held, before = ids[-1:], held[-1:], len(text)
        if len(ids) > 1:
            yield _compared(ids[:-1], held, printer)
        if ids:
            yield end(TAIL, ids[-1], held[-1])

    def join_ends(batches):
        printer = Printer(terms.value)
        for batch in batches:
            for i, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _compared([i], [text, after], printer)

    found = stored(ranged.mapInArrow(compare, OUT), as_it_is=True)
    # one small row for each range that has rows
    numbers = found.where(f"end = {HEAD}").select("part")
    after = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after"))
    heads = found.where(f"end = {HEAD}").select(F.col("part").alias("after"), F.col("text").alias("next"))
    tails = found.where(f"end = {TAIL}").join(after, "part").join(heads, "after").select("doc_id", "text", "next")
    columns = [f.split()[0] for f in RESULT.split(", ")]
    return found.where("end is null").select(*columns).unionByName(tails.mapInArrow(join_ends, OUT).select(*columns))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
