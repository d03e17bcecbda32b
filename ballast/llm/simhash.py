"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits, fewer than the allowed 3 differing bits plus one: of two
fingerprints that link, one segment differs by one bit at most. Each distinct fingerprint is indexed under both segments as
they are and under every one-wildcard variant of both (66 keys), equal keys meet, and each meeting is verified on all 64
bits. Fingerprints whose segment is equal meet under the segment itself; a wildcard's key is passed over unless it has
fingerprints of either bit. A group gives links that join all it connects, not all its pairs.

A key that more than `group` distinct fingerprints share isn't gathered. Those that link agree in that key's segment but for
one bit, so in the other segment one of four bytes is equal: the key's fingerprints are indexed once more under each of
these bytes. What is still over `group` is dealt to blocks of about that size and every pair of blocks is verified by itself,
whatever sizes the deal gives, so no link is lost.

Defined results: a null or empty text has fingerprint zero and is linked like any other; equal texts have equal
fingerprints; a text of fewer words than a shingle has one shingle, the whole; rows of one id are all kept, the component
is the smallest id that can be reached (a null id isn't one; null if there is no other); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm.graph import components
from ballast.shared import compact, make_room, ship, stored

SHINGLE, BITS, SEED, GROUP = 3, 3, 42, 2048


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle of lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h, s = xxhash.xxh64_intdigest, SEED
    if len(words) <= n:
        return np.array([h(b" ".join(words), s)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    return np.array([h(line[a:b], s) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=False)], dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(h):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 4096):
        bits = np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    make_room()
    for batch in batches:
        fps = np.array([fingerprint(shingle_hashes(t.as_buffer().to_pybytes(), n)) if t.is_valid else 0 for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=_PRINTS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    ship(docs.sparkSession)
    return compact(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(lambda b: _fingerprints(b, shingle), "doc_id long, fp long")


_KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


#: A key's place of the wildcard where the segment is taken as it is.
PLAIN = 32


def variants(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each fingerprint: segment, place of the wildcard, and the segment with that bit cleared."""
    keys = []
    for seg in range(2):
        part = (fp >> np.uint64(32 * seg)) & np.uint64(0xFFFFFFFF)
        for bit in range(33):
            keys.append((part & ~(np.uint64(1) << np.uint64(bit))) | np.uint64((seg << 6 | bit) << 32))
    return np.concatenate(keys).view(np.int64), np.tile(fp, 66).view(np.int64)


def bit_of(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """What stands at the key's wildcard; 0 where there is none."""
    k, u = keys.view(np.uint64) >> np.uint64(32), fps.view(np.uint64)
    bit, seg = k & np.uint64(63), k >> np.uint64(6)
    return np.where(bit < PLAIN, (u >> (bit % np.uint64(32) + np.uint64(32) * seg)) & np.uint64(1), np.uint64(0)).astype(np.int8)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room()
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            keys, fps = variants(batch.column(0).slice(lo, 4096).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], schema=_KEYS)


def linked(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within `bits` of each other connect: for each part a star to its least fingerprint. fp is sorted."""
    left, ends, roots = fp, [], []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            hit = np.bitwise_count(left ^ queue.pop()) <= bits
            if hit.any():
                found = left[hit]
                left = left[~hit]
                queue.extend(found)
                ends.append(found)
                roots.append(np.full(len(found), root))
    return (np.concatenate(ends), np.concatenate(roots)) if ends else (fp[:0], fp[:0])


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch], bits: int, group: int | None, wild: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) come sorted. Links (a, b, null); of a key with over `group` fingerprints (None: of none) the members (key, fp, 1). wild: keys are those of `variants`."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, out_a, out_b = fps.view(np.uint64), [], []
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(cut, len(keys)))
        if wild:
            ones = np.add.reduceat(bit_of(keys, fps).astype(np.int64), cut)
            plain = (keys[cut] >> 32) & 63 == PLAIN
            some = (size > 1) & (plain | (ones > 0) & (ones < size))
        else:
            some = size > 1
        two = cut[some & (size == 2)]
        two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= bits]
        out_a.append(fps[two])
        out_b.append(fps[two + 1])
        for a, n in zip(cut[some & (size > 2)].tolist(), size[some & (size > 2)].tolist(), strict=True):
            x, y = linked(u[a : a + n], bits)
            out_a.append(x.view(np.int64))
            out_b.append(y.view(np.int64))
        x, y = np.concatenate(out_a), np.concatenate(out_b)
        if len(x):
            pair = np.unique(np.stack([x, y], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.nulls(len(pair), pa.int64())], schema=_LINKS)

    def members(key: int, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), key)), pa.array(fps), pa.array(np.ones(len(fps), np.int64))], schema=_LINKS)

    make_room()
    none = np.zeros(0, np.int64)
    held_keys, held_fps, hot = none, none, None  # rows of the last key, and that key if its rows are passed on
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if hot is not None:
            own = int(np.searchsorted(keys, hot, side="right")) if len(keys) and keys[0] == hot else 0
            if own:
                yield members(hot, fps[:own])
            keys, fps = keys[own:], fps[own:]
        keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held_fps, fps])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        done_keys, done_fps, held_keys, held_fps, hot = keys[:last], fps[:last], keys[last:], fps[last:], None
        if group is not None and last:
            cut = np.flatnonzero(np.append(True, done_keys[1:] != done_keys[:-1]))
            size = np.diff(np.append(cut, last))
            for a, n in zip(cut[size > group].tolist(), size[size > group].tolist(), strict=True):
                yield members(int(done_keys[a]), done_fps[a : a + n])
            small = np.repeat(size <= group, size)
            done_keys, done_fps = done_keys[small], done_fps[small]
        if len(done_keys):
            yield from links(done_keys, done_fps)
        if group is not None and len(held_keys) > group:
            hot = int(held_keys[0])
            yield members(hot, held_fps)
            held_keys, held_fps = none, none
    if len(held_keys):
        yield from links(held_keys, held_fps)


def _hot_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        plain = (keys >> 32) & 63 == PLAIN
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps), pa.array(np.where(plain, 2, bit_of(keys, fps)).astype(np.int32))], names=["key", "fp", "bit"])


def near_links(prints: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all that differ in `bits` (3 at most) bits or fewer."""
    if bits > 3:
        raise ValueError("two segments with one wildcard find 3 differing bits at most")
    spark = prints.sparkSession
    ship(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = prints.select("fp").distinct().mapInArrow(_index, "key long, fp long")
    found = stored(keys.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(lambda b: _links(b, bits, group), "a long, b long, hot long"), True)
    links = found.where("hot is null").select("a", "b").distinct()
    hot = found.where("hot is not null").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return links
    # a wildcard's key needs fingerprints of either bit
    hot = hot.mapInArrow(_hot_bits, "key long, fp long, bit int")
    met = hot.groupBy("key").agg(F.min("bit").alias("low"), F.max("bit").alias("high")).where("low < high or low = 2").select("key")
    hot = hot.join(met, "key", "left_semi")
    # the bytes of the segment that isn't the key's, in which those that link differ by 3 bits at most
    other = F.when(F.col("key").bitwiseAND(64 << 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    bytes_of = F.array(*[F.xxhash64("key", F.lit(i), F.shiftright(other, 8 * i).bitwiseAND(255)) for i in range(4)])
    sub = stored(hot.select(F.explode(bytes_of).alias("key"), "fp"))
    counts = sub.groupBy("key").agg(F.ceil(F.count("*") / F.lit(group)).cast("int").alias("n"))
    dealt = sub.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = dealt.select("key", "fp", "own", F.explode(F.expr("sequence(0, n - 1)")).alias("other")).select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp").distinct()
    more = pairs.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(lambda b: _links(b, bits, None, False), "a long, b long, hot long")
    return links.unionByName(more.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links, itself included."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), as_it_is=True)
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = near_links(prints, bits)
    parts = components(links)
    named = stored(parts.join(classes, parts["node"] == classes["fp"]).select("node", "component", "first"), True)
    low = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked_fp = named.join(low, "component").select(F.col("node").alias("fp"), "component_id")
    # written, so that the last join is of two plain exchanges and Spark can split a fingerprint that very many rows have
    all_fp = stored(classes.join(linked_fp, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), True)
    return prints.join(all_fp, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
