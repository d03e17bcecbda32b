"""Byte-level BPE by corpus-level merge replay.

Texts are cut by the tokenizer's pattern. The distinct pieces of a batch that are not known yet are one sequence of byte
tokens with an inverted index from token pair to the places where it stands. Merges are applied in rank order: the pair of
least rank is taken from a heap, merged at all its places, and only the pairs with the two neighbours of each place are
updated. The pieces' ids are then read off, and texts are looked up piece by piece. No row meets another, so there is no
exchange; memory is bounded by one Arrow batch of texts, `learnt` pieces that are replayed at a time and the tables of known
pieces: two generations of half of `known` entries each, where what is met again moves to the younger and the older goes at last.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows repeat; other columns are
ignored; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.shared import CACHES, make_room, ship

#: Pieces whose ids a worker keeps, pieces that are replayed at a time (less of either takes less memory and more time), and pairs of tokens whose rank is kept.
KNOWN, LEARNT, PAIRS = 400_000, 200_000, 500_000

MISS = object()


class Replay:
    def __init__(self, path: str, pattern: str, known: int = KNOWN, learnt: int = LEARNT):
        self.most, self.learnt = known, learnt
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.one = [self.ranks[bytes([b])] for b in range(256)]
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pair_rank: dict[int, int | None] = {}

    def learn(self, words: list[str]) -> None:
        """Replay all merges over the words, which are distinct."""
        data = [w.encode() for w in words]
        plain, rest = [], []
        for w, b in zip(words, data, strict=True):
            if (r := self.ranks.get(b)) is not None:  # a piece that is a token as a whole is that token
                plain.append((w, r))
            else:
                rest.append((w, b))
        self.known.update((w, r.to_bytes(4, "little")) for w, r in plain)
        if not rest:
            return
        # A place holds a token id; -1 parts the pieces. left and right are the neighbouring places that are still in use.
        one, sym = self.one, [-1]
        for _, b in rest:
            sym.extend(map(one.__getitem__, b))
            sym.append(-1)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        known, ranks, strings, width = self.pair_rank, self.ranks, self.bytes, self.size
        index: dict[int, list[int]] = {}
        heap: list[int] = []
        found = known.get

        def rank_of(a: int, b: int) -> int | None:
            key = a * width + b
            try:
                return known[key]
            except KeyError:
                r = known[key] = ranks.get(strings[a] + strings[b])
                return r

        arr = np.array(sym, dtype=np.int64)
        both = np.flatnonzero((arr[:-1] >= 0) & (arr[1:] >= 0))
        keys = arr[both] * width + arr[both + 1]
        order = np.argsort(keys, kind="stable")
        keys, both = keys[order], both[order]
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(keys)).tolist(), strict=True):
            key = int(keys[a])
            r = rank_of(key // width, key % width)
            if r is not None:
                index.setdefault(r, []).extend(both[a:b].tolist())
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()  # leftmost first, as pairs of one rank can overlap
            whole = strings[r]
            held_until, later = -1, []
            for i in places:
                a = sym[i]
                if a < 0:
                    continue
                j = right[i]
                b = sym[j]
                if b < 0:
                    continue
                s = found(a * width + b, MISS)
                if (rank_of(a, b) if s is MISS else s) != r:
                    continue
                if i < held_until:
                    later.append(i)
                    continue
                sym[i], sym[j] = r, -2
                k = right[i] = right[j]
                left[k] = i
                c = sym[k]
                lower = False
                if c >= 0:
                    s = found(r * width + c, MISS)
                    if s is MISS:
                        s = rank_of(r, c)
                    if s is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(heap, s)
                        lower = s < r
                h = left[i]
                c = sym[h]
                if c >= 0:
                    s = found(c * width + r, MISS)
                    if s is MISS:
                        s = rank_of(c, r)
                    if s is not None:
                        if s in index:
                            index[s].append(h)
                        else:
                            index[s] = [h]
                            heapq.heappush(heap, s)
                        lower |= s < r
                if lower:  # this piece has a merge of lower rank now: its later places wait
                    held_until = i
                    while sym[held_until] != -1:
                        held_until = right[held_until]
            if later:
                if r in index:
                    index[r].extend(later)
                else:
                    index[r] = later
                    heapq.heappush(heap, r)
            del whole
        out = np.array(sym, dtype=np.int64)
        out = out[out != -2]
        stops = np.flatnonzero(out == -1)
        ids = out.astype("<u4")
        for (w, _), a, b in zip(rest, stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            self.known[w] = ids[a + 1 : b].tobytes()
        if len(self.pair_rank) > PAIRS:
            self.pair_rank.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, size, cut = lo, 0, []
            while hi < len(texts) and size < 500_000:
                cut.append(self.pieces(texts[hi] or ""))
                size += len(cut[-1])
                hi += 1
            new = set(chain.from_iterable(cut)).difference(self.known)
            again = new.intersection(self.older)
            self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            fresh = sorted(new - again)
            for at in range(0, len(fresh), self.learnt):
                self.learn(fresh[at : at + self.learnt])
            out.extend(b"".join(map(self.known.__getitem__, p)) for p in cut)
            if len(self.known) > self.most // 2:
                self.known, self.older = {}, self.known
            lo = hi
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[tuple, Replay] = {}
_forget = _made.clear
CACHES.append(_forget)


def _replay(*how) -> Replay:
    if how not in _made:
        _made[how] = Replay(*how)
    return _made[how]


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def _run(batches: Iterator[pa.RecordBatch], *how) -> Iterator[pa.RecordBatch]:
    make_room(_forget)
    replay = _replay(*how)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            ids = replay.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([replay.decode(x) for x in ids], pa.binary())], schema=_OUT)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN, learnt: int = LEARNT) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit integers, decoded bytes) by the rank file at `path`, which every node has."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda b: _run(b, path, pattern, known, learnt), "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
