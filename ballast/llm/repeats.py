"""Substring dedup with repeated-phrase automata.

1. Each block of documents sends every distinct window of 13 words (its hash and 24 bits of a second one, the smallest
   document that has it, and whether a second one does). A hash range confirms the windows that more than one document has and sends each block
   that needs them the smallest document of the whole corpus.
2. In each block, maximal runs of recurring windows become phrases. They are compiled into sharded Aho-Corasick automata
   over the block's word numbers; all documents of the block are streamed through each automaton, and every occurrence of
   a phrase marks the windows whose first document is a smaller one.
3. Words under a marked window are cut out. With `layout` the kept text is the original one with its white space, each run of
   cut words leaving with the white space after it; a text without cuts, a null one too, stays as it is.

A window that a third of all documents share costs one entry a block, in both directions.

Defined results: a null or empty text has no words and an empty kept text; a text of fewer than 13 words is kept; white
space of kept text is single spaces (but with `layout`); rows of one id count as one document and are each judged; rows of null id are kept whole
and aren't the first of anything; other columns are ignored.
Which windows recur is decided in step 1, by 88 bits of hash; the automata of step 2 work by word, block by block, and locate
the occurrences of what step 1 confirmed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm.blocks import ANSWER, ANSWERS, ASK, ASKS, in_blocks, read_texts, rows, sizes, with_answers
from ballast.llm.vec import SPACED, U64, Words, checks, grams, pack_sorted, unpack_sorted, whole, words_of
from ballast.shared import make_room, stored, tidy

WINDOW = 13
#: Words in the phrases of one automaton.
SHARD_WORDS = 150_000
#: Bytes of text in a block, and bytes of text whose windows one hash range takes: what a Python worker holds at a time.
BLOCK_BYTES, RANGE_BYTES = 5 << 20, 4 << 20


def _windows(table: pa.Table, n: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Words, hashes of words, hash of the window at each word and whether it lies in one text."""
    for w in words_of(table.column("text"), SPACED):
        h = w.hashes()
        yield w, h, grams(h, n), whole(w, n)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, the smallest number for null, and whether there is one."""
    column = table.column("doc_id")
    return pc.fill_null(column, -(2**63)).to_numpy(), column.is_valid().to_numpy()


def _ask(block: int, table: pa.Table, n: int, parts: int) -> Iterator[pa.RecordBatch]:
    ids, known = _ids(table)
    hs, xs, ds = [np.zeros(0, U64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for w, words, g, ok in _windows(table, n):
        own = w.lo + w.owner()[: len(g)]
        ok = ok & known[own]
        hs.append(g[ok])
        xs.append(checks(words, n)[ok])
        ds.append(ids[own[ok]])
    h, x, d = np.concatenate(hs), np.concatenate(xs), np.concatenate(ds)
    if not len(h):
        return
    order = np.lexsort((d, x, h))
    h, x, d = h[order], x[order], d[order]
    at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])))
    last = np.append(at[1:], len(h)) - 1
    h, x, low, more = h[at], x[at], d[at], (d[last] != d[at]).astype(np.uint8)
    base = int(low.min())
    part = _part(h, parts)
    cut = np.searchsorted(part, np.arange(parts + 1))
    own = [(p, pack_sorted(h[a:b], x[a:b], low[a:b] - base, more[a:b]) + np.int64(base).tobytes()) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
    yield rows(ASKS, [p for p, _ in own], [block] * len(own), [x for _, x in own])


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash range of each hash; ranges keep the order of the hashes."""
    return ((h >> U64(40)) * U64(parts) >> U64(24)).astype(np.int64)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in more than one document, to the blocks where a document other than the first has them."""
    make_room()
    blocks, hs, xs, lows, mores = [], [], [], [], []
    for batch in batches:
        for block, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = payload.as_buffer().to_pybytes()
            h, x, low, more = unpack_sorted(data[:-8])
            blocks.append(np.full(len(h), block))
            hs.append(h)
            xs.append(x)
            lows.append(low + np.frombuffer(data[-8:], np.int64)[0])
            mores.append(more)
    if not hs:
        return
    h, x = np.concatenate(hs), np.concatenate(xs)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (x[order][1:] != x[order][:-1])).any():  # windows that only the second hash tells apart
        order = np.lexsort((x, h))
    h, x = h[order], x[order]
    block, low, more = (np.concatenate(v)[order] for v in (blocks, lows, mores))
    at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])))
    first = np.repeat(np.minimum.reduceat(low, at), np.diff(np.append(at, len(h))))
    need = np.flatnonzero((low > first) | (more > 0))
    need = need[np.argsort(block[need], kind="stable")]
    h, x, block, first = h[need], x[need], block[need], first[need]
    ends = np.flatnonzero(np.append(block[1:] != block[:-1], True)) + 1 if len(block) else []
    a = 0
    for b in ends:
        yield rows(ANSWERS, [int(block[a])], [0], [pack_sorted(h[a:b], x[a:b], first[a:b])])
        a = b


def _found(keys: np.ndarray, bits: np.ndarray, g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each window (hash, second hash) among sorted answers, or -1."""
    at = np.searchsorted(keys, g)
    out = np.full(len(g), -1, dtype=np.int64)
    left = np.arange(len(g))
    while len(left):  # more than once only where a first hash stands for several windows
        left = left[at[left] < len(keys)]
        left = left[keys[at[left]] == g[left]]
        hit = bits[at[left]] == x[left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
    return out


def _covered(texts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], n: int) -> dict[int, np.ndarray]:
    """texts: (number, word numbers, first document of each window or -1, own document). Words to remove, for texts that have any.

    Phrases are the texts' maximal runs of windows that a smaller document has too.
    """
    phrases: dict[tuple[int, ...], np.ndarray] = {}
    for _, ids, first, doc in texts:
        hit = (first >= 0) & (first < doc)
        if hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                phrases.setdefault(tuple(ids[a : b + n - 1].tolist()), first[a:b])
    out: dict[int, np.ndarray] = {}
    shard = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    size, left = 0, len(phrases)
    for phrase, first in phrases.items():
        shard.add_word(phrase, (len(phrase), int(first.max()), first))
        size, left = size + len(phrase), left - 1
        if size < SHARD_WORDS and left:
            continue
        shard.make_automaton()
        for k, ids, own_first, doc in texts:
            if len(ids) < n:
                continue
            mark = None
            for end, (length, most, firsts) in shard.iter(tuple(ids.tolist())):
                a = end - length + 1
                if mark is None:
                    mark = np.zeros(len(ids) + 1, dtype=np.int64)
                if most < doc:
                    mark[a] += 1
                    mark[end + 1] -= 1
                else:
                    for j in np.flatnonzero(firsts < doc).tolist():
                        mark[a + j] += 1
                        mark[a + j + n] -= 1
            if mark is not None:
                cut = np.cumsum(mark[:-1]) > 0
                out[k] = out[k] | cut if k in out else cut
        shard, size = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
REPEATS = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,last:long>>"


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """The text without the words of the spans and the white space after them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for x in spans:
        out.append(text[at : words[x["first"]][0]])
        at = words[x["last"] + 1][0] if x["last"] + 1 < len(words) else words[x["last"]][1]
    return b"".join([*out, text[at:]])


def _finish(table: pa.Table, payloads: list[bytes], n: int, layout: bool = False) -> Iterator[pa.RecordBatch]:
    found = [unpack_sorted(p) for p in payloads]
    keys, bits, firsts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    order = np.argsort(keys, kind="stable")
    keys, bits, firsts = keys[order], bits[order], firsts[order]
    (docs, known), names, runs = _ids(table), [], []
    for w, h, g, ok in _windows(table, n):
        first = np.full(len(h), -1, dtype=np.int64)
        if len(g) and len(keys):
            at = _found(keys, bits, g, checks(h, n))
            first[: len(g)] = np.where((at >= 0) & ok, firsts[at], -1)
        names.append(h)
        runs.extend((w.lo + i, int(w.first[i]), int(w.first[i + 1]), first[w.first[i] : max(w.first[i], w.first[i + 1] - n + 1)], len(names) - 1) for i in range(w.hi - w.lo))
    every = np.unique(np.concatenate(names)) if names else np.zeros(0, U64)
    numbers = [np.searchsorted(every, x) for x in names]
    texts = [(k, numbers[c][a:b], first, int(docs[k])) for k, a, b, first, c in runs]
    cut = _covered(texts, n)
    out: tuple[list, ...] = ([], [], [], [], [])
    size, lo = 0, 0
    extra = [c for c in table.column_names if c.startswith("keep")]

    def flush(hi: int) -> pa.RecordBatch:
        batch = _batch(out)
        for c in extra:
            batch = batch.append_column(c, table.column(c).slice(lo, hi - lo).combine_chunks())
        return batch

    for (k, ids, _, doc), text in zip(texts, table.column("text"), strict=True):
        data = text.as_buffer().to_pybytes() if text.is_valid else None
        words, spans = (data or b"").split(), []
        if (mark := cut.get(k)) is not None:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0])))).tolist()
            spans = [{"first": a, "last": b - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            words = [x for x, m in zip(words, mark.tolist(), strict=True) if not m]
        kept = b" ".join(words) if not layout else without(data, spans) if spans else data
        for column, x in zip(out, (doc if known[k] else None, len(ids), len(ids) - len(words), kept, spans), strict=True):
            column.append(x)
        size += len(kept or b"")
        if size > 4 << 20:
            yield flush(k + 1)
            out, size, lo = ([], [], [], [], []), 0, k + 1
    yield flush(table.num_rows)


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) if f.name != "kept" else pa.array(x, pa.binary()).cast(pa.string()) for x, f in zip(out, _OUT, strict=True)], schema=_OUT)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans, then keep0, keep1 and so on for the columns `keep`): each text without the words of windows that begin in a document of smaller id too."""
    blocks = in_blocks(docs, id_col, text_col, BLOCK_BYTES, keep)
    _, size = sizes(blocks)
    parts = max(8, size // RANGE_BYTES)

    def ask(batches):
        make_room()
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _ask(block, read_texts(payload.as_buffer()), window, parts)

    asked = blocks.select("block", "payload").mapInArrow(ask, ASK).repartition(parts, "part")
    answers = asked.mapInArrow(_answer, ANSWER).coalesce(max(parts // 3, 4 * docs.sparkSession.sparkContext.defaultParallelism))
    answers = stored(answers, as_it_is=True)
    tidy(docs.sparkSession)  # the asks are the larger part of what is exchanged
    return with_answers(blocks, answers, max(8, size // (10 << 20)), lambda _, table, held: _finish(table, held, window, layout), REPEATS + "".join(f", keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) g FROM d WHERE len(w) >= 13),
f AS (SELECT g, min(doc_id) low FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) p FROM g JOIN f USING (g) WHERE low < doc_id),
w AS (SELECT doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) word FROM d),
k AS (SELECT doc_id, count(*) n, string_agg(word, ' ' ORDER BY p) kept FROM w ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
