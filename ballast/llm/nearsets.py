"""SimHash near-dedup for a similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are fingerprints that the deletion-variant signatures of simhash.py link at 3 bits. Most copies at 0.8 differ in 9
to 12 bits of a 64-bit fingerprint, which no index by segments and wildcards finds without proposing nearly everything, so
the sketch also has min-wise keys: 32 keys of 6 minima each, of which a pair at 0.8 shares one with a probability of 0.9999.
Texts of equal sets are one class; every link is verified on whole sets (of 64-bit shingle hashes).

Classes that candidates join are gathered if they are `group` at most, and every pair that could connect something is
verified. Of more, each class is first compared with the least class of its first keys (a leader and its members go to
tasks of bounded size); what that connects is one part. Only classes outside the largest part are then compared with all
the others, in blocks: of all that are joined while those outside are few, else of each key. Sets are moved only for classes
that are joined with another.

Defined results: a null or empty text has the empty set, which is like empty sets only; a text of fewer words than a shingle
has one shingle, the whole; rows of one id are all kept, the component is the smallest id that can be reached (a null id
isn't one; null if there is no other); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.graph import components
from ballast.llm.simhash import SEED, fingerprint, near_links, shingle_hashes
from ballast.shared import compact, make_room, ship, stored

SHINGLE, LEAST, BANDS, ROWS, GROUP = 5, 0.8, 32, 6, 512
#: Keys by which members of large groups meet leaders; members that a leader's task compares; ids that are broadcast at most.
FIRST_KEYS, MEMBERS, BROADCAST_IDS = 4, 2048, 500_000

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MIX = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Distinct shingle hashes in order."""
    return np.unique(shingle_hashes(text or b"", n))


def name_of(s: np.ndarray) -> int:
    """A set's hash."""
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - 2**63


def bands(s: np.ndarray) -> np.ndarray:
    """The keys under which a set meets sets like it."""
    if not len(s):
        return np.zeros(0, np.int64)
    low = np.full(len(_FACTORS), 2**32 - 1, dtype=np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(h), 1024):
        np.minimum(low, np.multiply.outer(_FACTORS, h[lo : lo + 1024]).min(axis=1), out=low)
    return ((low.reshape(BANDS, ROWS) + np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


_SKETCHES = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("same", pa.int64()), ("items", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets_of(batch: pa.RecordBatch, at: int, n: int) -> Iterator[np.ndarray]:
    for t in batch.column(at):
        yield shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, n)


def _sketched(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    make_room()
    for batch in batches:
        same, fps, keys = [], [], []
        for t in batch.column(1):
            h = shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", n)
            s = np.unique(h)
            same.append(name_of(s))
            fps.append(fingerprint(h))
            keys.append(bands(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], schema=_SKETCHES)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    make_room()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            sets = list(_sets_of(batch.slice(lo, 256), 0, n))
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=_SETS)


def linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect what the pairs of sets of similarity `least` or more connect: for each part a star to its first set."""
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    left, links = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            p = queue.pop()
            has = np.zeros(len(words), bool)
            has[at[first[p] : first[p] + size[p]]] = True
            both = np.add.reduceat(has[at], first, dtype=np.int64)
            hits = np.flatnonzero(left & (both / (size + size[p] - both) >= least)).tolist()
            left[hits] = False
            queue += hits
            links += [(x, root) for x in hits]
    return links


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, same, items) come sorted by key."""
    make_room()
    held_key, held = None, {}

    def links() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            names = sorted(held)
            found = linked([np.frombuffer(held[x], np.uint64) for x in names], least)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in found], pa.int64()), pa.array([names[i] for _, i in found], pa.int64())], schema=_LINKS)

    for batch in batches:
        for key, same, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if key != held_key:
                yield from links()
                held_key, held = key, {}
            if same not in held:
                held[same] = items.as_buffer().to_pybytes()
    yield from links()


def _led(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (leader, salt, kind, same, items) come sorted, a leader's own set first."""
    make_room()
    leader, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        links = []
        for to, kind, same, items in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            s = np.frombuffer(items.as_buffer().to_pybytes(), np.uint64)
            if kind == 0:
                leader, own = to, s
            elif leader == to:
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both >= least * (len(own) + len(s) - both):
                    links.append((same, to))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], schema=_LINKS)


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs (column doc_id) with or without these ids; texts stay where they are if a count finds at most `most` ids, else Spark joins by id."""
    few = ids.limit(most + 1).count() <= most
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how).select(*docs.columns)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, group: int = GROUP) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest id reachable over pairs of similarity `least` or more, itself included."""
    spark = docs.sparkSession
    ship(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = stored(compact(texts).mapInArrow(lambda b: _sketched(b, shingle), "doc_id long, same long, fp long, bands array<long>"), as_it_is=True)
    classes = stored(sketches.groupBy("same").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))

    # what candidates join: classes of a key with its least class, classes of linked fingerprints
    keys = classes.select(F.explode("bands").alias("key"), "same")
    low = keys.groupBy("key").agg(F.min("same").alias("m"), F.max("same").alias("x")).where("m < x").select("key", "m")
    by_key = keys.join(low, "key").where("same != m").select(F.col("same").alias("a"), F.col("m").alias("b"))
    prints = classes.groupBy("fp").agg(F.min("same").alias("m"), F.max("same").alias("x"))
    equal = classes.join(prints.where("m < x").select("fp", "m"), "fp").where("same != m").select(F.col("same").alias("a"), F.col("m").alias("b"))
    links = near_links(prints.select("fp"))
    name = lambda c: prints.select(F.col("fp").alias(c), F.col("m").alias(f"m_{c}"))
    by_print = links.join(name("a"), "a").join(name("b"), "b").select(F.col("m_a").alias("a"), F.col("m_b").alias("b"))
    joined = components(by_key.unionByName(equal).unionByName(by_print))
    joined = joined.join(classes, joined["node"] == classes["same"]).select("same", "component", "first")
    sizes = joined.groupBy("component").agg(F.count("*").alias("size"))
    joined = stored(joined.join(sizes, "component"), True)

    def with_sets(some: DataFrame) -> DataFrame:
        """some (same, first, ...) with the classes' sets: of the rows of their first ids, and of rows without an id."""
        own = only(texts, some.select(F.col("first").alias("doc_id")).where("doc_id is not null").distinct()).unionByName(texts.where("doc_id is null"))
        return some.join(own.select("text").mapInArrow(lambda b: _sets(b, shingle), "same long, items binary"), "same")

    def verified(members: DataFrame) -> DataFrame:
        """members (key, same, items): links within each key."""
        pairs = members.select("key", "same", "items").repartition(n, "key").sortWithinPartitions("key")
        return pairs.mapInArrow(lambda b: _verified(b, least), "a long, b long")

    links = stored(verified(with_sets(joined.where(f"size <= {group}").withColumn("key", F.col("component")))), True)
    hot = joined.where(f"size > {group}")
    if not hot.isEmpty():
        links = links.unionByName(_hot_links(hot, classes, with_sets, verified, n, least, group))

    parts = components(links)
    named = stored(parts.join(classes, parts["node"] == classes["same"]).select("node", "component", "first"), True)
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked_same = named.join(least_id, "component").select(F.col("node").alias("same"), "component_id")
    all_same = stored(classes.join(linked_same, "same", "left").select("same", F.coalesce("component_id", "first").alias("component_id")), True)
    return sketches.select("doc_id", "same").join(all_same, "same").select("doc_id", "component_id")


def _hot_links(hot: DataFrame, classes: DataFrame, with_sets, verified, n: int, least: float, group: int) -> DataFrame:
    """Links (a, b) within what joins more than `group` classes. hot: (same, component, first, size)."""
    sets = stored(with_sets(hot.select("same", "first", "component")).select("same", "component", "items").dropDuplicates(["same"]))
    bands_of = hot.select("same", "component").join(classes.select("same", "bands"), "same")

    # members against the leaders of their first keys, a leader's members in tasks of bounded size
    keyed = bands_of.select(F.explode(F.slice("bands", 1, FIRST_KEYS)).alias("key"), "same")
    leaders = keyed.groupBy("key").agg(F.min("same").alias("leader"))
    pairs = keyed.join(leaders, "key").where("same != leader").select("leader", "same").distinct()
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("salts"))
    members = pairs.join(salts, "leader").withColumn("salt", F.pmod(F.xxhash64("same"), F.col("salts")).cast("int")).join(sets, "same").select("leader", "salt", F.lit(1).alias("kind"), "same", "items")
    own = salts.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).withColumn("same", F.col("leader")).join(sets, "same").select("leader", "salt", F.lit(0).alias("kind"), "same", "items")
    led = members.unionByName(own).repartition(n, "leader", "salt").sortWithinPartitions("leader", "salt", "kind")
    first = stored(led.mapInArrow(lambda b: _led(b, least), "a long, b long"), True)

    # the rest of each against all of it
    parts = components(first).withColumnRenamed("node", "same").withColumnRenamed("component", "part")
    marked = stored(sets.select("same", "component").join(parts, "same", "left").withColumn("part", F.coalesce("part", "same")), True)
    counts = marked.groupBy("component", "part").agg(F.count("*").alias("c"))
    main = counts.groupBy("component").agg(F.max_by("part", "c").alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).withColumn("outside", F.col("all") - F.col("most"))
    marked = marked.join(main.select("component", "main", "outside"), "component").where("outside > 0")
    few = marked.where(f"outside <= {BANDS * group}").select(F.col("component").alias("key"), "same", "part", "main")
    by_key = marked.where(f"outside > {BANDS * group}").join(classes.select("same", "bands"), "same").select(F.explode("bands").alias("key"), "same", "part")
    key_parts = by_key.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum(F.xxhash64("same").cast("decimal(38,0)")).alias("h"))
    mixed = key_parts.groupBy("key").agg(F.max_by("part", "c").alias("main"), F.count("*").alias("parts"), F.sum("c").alias("c"), F.sum("h").alias("h")).where("parts > 1")
    mixed = mixed.groupBy("c", "h").agg(F.min(F.struct("key", "main")).alias("k")).select("k.*")  # keys of the same classes are looked at once
    units = few.unionByName(by_key.join(mixed, "key").select("key", "same", "part", "main")).withColumn("rest", (F.col("part") != F.col("main")).cast("int"))
    half = max(group // 2, 1)
    n_of = lambda x: F.ceil(F.sum(x) / F.lit(half)).cast("int")
    deal = units.groupBy("key").agg(n_of(F.col("rest")).alias("r"), n_of(1 - F.col("rest")).alias("m"))
    dealt = units.join(deal, "key").withColumn("own", F.when(F.col("rest") == 1, F.pmod(F.xxhash64("same"), F.col("r"))).otherwise(F.col("r") + F.pmod(F.xxhash64("same"), F.col("m"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, if(rest = 1, r + m - 1, r - 1))")))
    met = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "same").distinct()
    return first.unionByName(stored(verified(met.join(sets, "same")), True))
