"""A hierarchical Pitman-Yor language model over word pairs, trained by Gibbs sampling over the whole corpus.

Restaurants: one for every context, be it a word however rare or the start of a text. All share one parent, the restaurant of
single words, whose base spreads evenly over the known words and one unknown. A context without training tokens is an empty
restaurant: it predicts as the parent does.

1. Words are numbered over the whole corpus, each hash range its own and the most frequent first, and texts become streams of
   numbers.
2. The distinct pairs of a block go to the ranges of their predicted words. A range has all cells (word, context, customers,
   tables) of its words, so the parent's seating is local to it.
3. A range samples: a Gibbs step draws how many tables serve a cell, given all others, from its conditional distribution
   (tables.py), cells in groups that see what the groups before them drew, then the parent's tables. What ranges know of each
   other is the number of tables and customers of each context, which are added up by context ranges between rounds.
4. After each round of sampling the predictive probabilities are kept, and ranges send each block their averages for the
   pairs it asked for, as logarithms in steps of 2**-12.

Discounts come from the counts of counts; the strengths are fixed. Nothing is broadcast but a few totals.

Defined results: a null or empty text is its end token alone; texts are scored by word hashes of 64 bits; repeated rows
repeat (and count as often); rows of null id are scored, but not learned from, with held_out null; without training rows
every word is unknown; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm.blocks import ANSWER, ANSWERS, ASK, ASKS, in_blocks, read_texts, rows, sizes, with_answers, write_texts
from ballast.llm.tables import draw, weight_above
from ballast.llm.vec import LOWER, SPACED, U64, pack, pack_sorted, unpack, unpack_sorted, words_of
from ballast.shared import discard, make_room, stored, tidy

END = U64(0x9D39247E33776D41)
#: Numbers that aren't words': an unknown word, and the start of a text as a context.
UNKNOWN, START, FIRST = 0, 1, 2
STRENGTH, STRENGTH_ROOT = 1.0, 10.0
BURN_IN, SAMPLES, GROUPS = 3, 3, 4
#: Bytes of text whose words one range has.
RANGE_BYTES = 16 << 20
STEPS = 1 << 12


def trained(doc_ids: pa.ChunkedArray, mod: int, held: int) -> list[bool | None]:
    """Whether each row is learned from; null for a null id."""
    return [None if d is None else zlib.crc32(str(d).encode()) % mod != held for d in doc_ids.to_pylist()]


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with an end after each text, and tokens of each text."""
    hashes, counts = [], []
    for w in words_of(table.column("text"), SPACED, LOWER):
        hashes.append(np.insert(w.hashes(), w.first[1:], END))
        counts.append(w.counts + 1)
    return np.concatenate(hashes), np.concatenate(counts)


def _learned(table: pa.Table, mod: int, held: int, n: np.ndarray) -> np.ndarray:
    """Whether each token is learned from."""
    return np.repeat(np.array(trained(table.column("doc_id"), mod, held), dtype=bool), n)


def _cut(part: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """Part, start and end of each run of a sorted column of parts."""
    edge = np.searchsorted(part, np.arange(parts + 1)).tolist()
    return [(p, a, b) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]


def _hash_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(40)) * U64(parts) >> U64(24)).astype(np.int64)


@dataclass
class Numbers:
    """How words are numbered: FIRST + rank * parts + part, where rank is the place of the word in its part; `ranks` ranks are in use."""

    parts: int
    ranks: int

    def codes(self, w: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A number for each pair of word and context, in order of part, rank and context. An unknown word has part 0 and the last rank."""
        part, rank = (w - FIRST) % self.parts, (w - FIRST) // self.parts
        unknown = w == UNKNOWN
        order = np.where(unknown, 0, part) * (self.ranks + 1) + np.where(unknown, self.ranks, rank)
        return order.astype(U64) << U64(32) | u.astype(U64)

    def cut(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        return _cut((codes >> U64(32)).astype(np.int64) // (self.ranks + 1), self.parts)

    def base(self, part: int) -> np.uint64:
        """What a part's codes have over those that it counts from 0."""
        return U64(part * (self.ranks + 1)) << U64(32)


def _rank(codes: np.ndarray) -> np.ndarray:
    return (codes >> U64(32)).astype(np.int64)


def _context(codes: np.ndarray) -> np.ndarray:
    return (codes & U64(0xFFFFFFFF)).astype(np.uint32)


def _by_part(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    """Rows (part, ...) by part, and in order of their second column."""
    make_room()
    found: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(row[0], []).append(row[1:])
    for own in found.values():
        own.sort(key=lambda r: r[0])
    return found


_NUMBERED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()), ("n", pa.int64()), ("types", pa.int64())])


def _numbered(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Numbers and counts of the words that each block asked for; a row without a block has the part's tokens and words."""
    for part, asks in _by_part(batches).items():
        found = [unpack_sorted(x) for _, x in asks]
        words, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
        c = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
        known = np.flatnonzero(c)
        number = np.full(len(words), UNKNOWN, np.int64)
        number[known[np.argsort(-c[known], kind="stable")]] = FIRST + np.arange(len(known)) * parts + part
        yield rows(_NUMBERED, [None], [part], [None], [int(c.sum())], [len(known)])
        for (block, _), (h, _) in zip(asks, found, strict=True):
            own = np.searchsorted(words, h)
            yield rows(_NUMBERED, [block], [part], [pack(number[own].astype(np.uint32), c[own])], [None], [None])


_STREAMS = pa.schema([("block", pa.int64()), ("payload", pa.binary())])


def _write_stream(table: pa.Table, tokens: np.ndarray) -> bytes:
    head = write_texts(table)
    return np.uint32(len(head)).tobytes() + head + pack(tokens)


def _read_stream(data: pa.Buffer) -> tuple[pa.Table, np.ndarray]:
    """(doc_id, trained, n_tokens, n_known, base_score) of a block's rows, and the numbers of their tokens."""
    raw = data.to_pybytes()
    n = 4 + int(np.frombuffer(raw, np.uint32, 1)[0])
    return read_texts(pa.py_buffer(raw[4:n])), unpack(raw[n:])[0].astype(np.int64)


def _pairs(numbers: Numbers, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Code of each token after the one before it."""
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.cumsum(n) - n] = START
    return numbers.codes(w, u)


@dataclass
class Model:
    """What all ranges share: discounts, words known, customers and tables of the parent."""

    d: float
    d_root: float
    types: int
    root: tuple[float, float] = (0.0, 0.0)

    @property
    def base(self) -> float:
        return (STRENGTH_ROOT + self.d_root * self.root[1]) / (self.types + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return weight_above(customers, tables, self.d_root, self.base) / (self.root[0] + STRENGTH_ROOT)

    def predict(self, c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """Chance of a word with c customers at t tables of a context that has these customers and tables."""
        return (np.maximum(c - self.d * t, 0) + (STRENGTH + self.d * tables) * p1) / (customers + STRENGTH)


@dataclass
class Cells:
    """The cells of a range: rank of the word, place of the context among the range's, customers; tables of the context elsewhere."""

    rank: np.ndarray
    at: np.ndarray
    c: np.ndarray
    elsewhere: np.ndarray
    ranks: int


def sweep(rng: np.random.Generator, model: Model, cells: Cells, t: np.ndarray, root: np.ndarray, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs sweep: tables of each cell (one where it has one customer), then of each word in the parent."""
    t, root = t.copy(), root.astype(np.float64)
    tables = cells.elsewhere + np.bincount(cells.at, t, minlength=len(cells.elsewhere))
    above = np.bincount(cells.rank, t, minlength=cells.ranks)
    total, k = model.root
    more = np.flatnonzero(cells.c > 1)
    for own in np.array_split(rng.permutation(more), groups):
        if not len(own):
            continue
        r, u, old = cells.rank[own], cells.at[own], t[own]
        left = above[r] - old
        p = weight_above(left, root[r], model.d_root, model.base) / (total + STRENGTH_ROOT)
        new = draw(rng, cells.c[own], tables[u] - old, STRENGTH, model.d, p, (left, root[r], model.d_root, model.base))
        t[own] = new
        tables += np.bincount(u, new - old, minlength=len(tables))
        above += np.bincount(r, new - old, minlength=len(above))
    some = np.flatnonzero(above > 0)
    for own in np.array_split(rng.permutation(some), groups):
        root[own] = draw(rng, above[own].astype(np.int64), np.maximum(k - root[own], 0), STRENGTH_ROOT, model.d_root, np.full(len(own), 1 / (model.types + 1)))
    root[above == 0] = 0
    return t, root


#: What goes by part: the cells of a part, its state, answers of context ranges (their number), and asks.
CELLS, STATE, SAMPLE, ASKED = -2, -1, -10, 1 << 30
_ROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("contexts", pa.binary()), ("counts", pa.list_(pa.float64()))])
ROW = "part int, kind int, block long, payload binary, contexts binary, counts array<double>"


def _row(part: int, kind: int, payload: bytes, contexts: bytes | None = None, block: int | None = None, counts: list[float] | None = None) -> pa.RecordBatch:
    return rows(_ROW, [part], [kind], [block], [payload], [contexts], [counts])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of a part's words, the contexts that were asked for with their customers and cells here, counts of counts, and the asks."""
    for part, asks in _by_part(batches).items():
        found = [unpack_sorted(x) for _, x in asks]
        codes, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
        c = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
        contexts, u = np.unique(_context(codes), return_inverse=True)
        here = [np.bincount(u, x, minlength=len(contexts)).astype(np.int64) for x in (c, c > 0)]
        codes, c = codes[c > 0], c[c > 0]
        above = np.bincount(_rank(codes))
        counts = [float(x.sum()) for x in (c == 1, c == 2, above == 1, above == 2, c > 0, above > 0)]
        yield _row(part, CELLS, pack_sorted(codes, c), pack_sorted(contexts, *here), counts=counts)
        for block, ask in asks:
            yield _row(part, ASKED, ask, block=block)


def _to_contexts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, contexts with some numbers): to each context range, the part's share."""
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            contexts, *values = unpack_sorted(data.as_buffer().to_pybytes())
            owner = (contexts % np.uint32(parts)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            own = _cut(owner[order], parts)
            yield rows(ASKS, [q for q, _, _ in own], [part] * len(own), [pack_sorted(contexts[order[a:b]], *[v[order[a:b]] for v in values]) for _, a, b in own])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over parts of each context's numbers, back to each part in its order."""
    for q, asks in _by_part(batches).items():
        found = [unpack_sorted(x) for _, x in asks]
        every, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([x[i] for x in found])).astype(np.int64) for i in range(1, len(found[0]))]
        for (part, _), x in zip(asks, found, strict=True):
            own = np.searchsorted(every, x[0])
            yield _row(part, q, pack(*[s[own] for s in sums]))


def _spread(contexts: np.ndarray, parts: int, answers: dict[int, bytes]) -> list[np.ndarray]:
    """The answers of all context ranges, in order of the contexts."""
    order = np.argsort(contexts % np.uint32(parts), kind="stable")
    out = []
    for column in zip(*(unpack(answers[q]) for q in sorted(answers)), strict=True):
        values = np.empty(len(contexts), np.int64)
        values[order] = np.concatenate(column)
        out.append(values)
    return out


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(k)[i].as_py() for k in range(5))


def _state(t: np.ndarray, root: np.ndarray) -> bytes:
    a = pack(t.astype(np.uint32))
    return np.uint32(len(a)).tobytes() + a + pack(root.astype(np.uint32))


def _read_state(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = 4 + int(np.frombuffer(data, np.uint32, 1)[0])
    return unpack(data[4:n])[0].astype(np.float64), unpack(data[n:])[0].astype(np.float64)


def _sampled(batches: Iterator[pa.RecordBatch], parts: int, model: Model, seed: int, index: int, sweeps: int) -> Iterator[pa.RecordBatch]:
    """A round of sweeps over each part. The first round begins with every cell at one table. Rows come by part and kind."""

    def done(part: int, held: dict[int, tuple]) -> pa.RecordBatch:
        cells, state = held.pop(CELLS), held.pop(STATE, None)
        (codes, c), asked = unpack_sorted(cells[0]), unpack_sorted(cells[1])[0]
        rng = np.random.default_rng([seed, part, index])
        rank, at = _rank(codes), np.searchsorted(asked, _context(codes))
        ranks = int(rank.max()) + 1 if len(rank) else 0
        t, root = _read_state(state[0]) if state else (np.ones(len(c)), np.ones(ranks))
        tables = _spread(asked, parts, {q: x[0] for q, x in held.items()})[-1]
        own = Cells(rank, at, c, tables - np.bincount(at, t, minlength=len(asked)), ranks)
        for _ in range(sweeps):
            t, root = sweep(rng, model, own, t, root)
        here = np.bincount(at, t, minlength=len(asked)).astype(np.int64)
        return _row(part, STATE, _state(t, root), pack_sorted(asked, here), counts=[float(t.sum()), float(root.sum())])

    at, held = None, {}
    for part, kind, _, payload, contexts in _rows_of(batches):
        if part != at and held:
            yield done(at, held)
            held = {}
        at, held[kind] = part, (payload, contexts)
    if held:
        yield done(at, held)


def _answered(batches: Iterator[pa.RecordBatch], parts: int, models: list[Model]) -> Iterator[pa.RecordBatch]:
    """Averaged predictive probabilities of the pairs that each block asked for. Rows come by part and kind, asks last."""
    at, held, known = None, {}, None
    for part, kind, block, payload, contexts in _rows_of(batches):
        if part != at:
            at, held, known = part, {}, None
        if kind != ASKED:
            held[kind] = (payload, contexts)
            continue
        if known is None:
            (codes, c), asked = unpack_sorted(held[CELLS][0]), unpack_sorted(held[CELLS][1])[0]
            answers = lambda s: _spread(asked, parts, {q - s * parts: x[0] for q, x in held.items() if s * parts <= q < (s + 1) * parts})  # noqa: B023, E731
            customers, each = answers(0)[0], []
            for s, model in enumerate(models):
                t, root = _read_state(held[SAMPLE - s][0])
                above = np.bincount(_rank(codes), t, minlength=len(root))
                each.append((model, np.append(t, 0), answers(s + 1)[-1], np.append(model.parent(above, root), model.parent(np.zeros(1), np.zeros(1)))))
            known, held = (codes, np.append(c, 0), asked, customers, each), {}
        codes, c, asked, customers, each = known
        h, _ = unpack_sorted(payload)
        cell = np.searchsorted(codes, h)
        cell = np.where(codes[np.minimum(cell, len(codes) - 1)] == h, cell, len(codes)) if len(codes) else np.zeros(len(h), np.int64)
        u = np.searchsorted(asked, _context(h))
        p = np.zeros(len(h))
        for model, t, tables, p1 in each:
            p += model.predict(c[cell], t[cell], customers[u], tables[u], p1[np.minimum(_rank(h), len(p1) - 1)])
        steps = np.rint(-np.log10(p / len(each)) * STEPS)
        yield rows(ANSWERS, [block], [part], [pack(steps.astype(np.uint16 if not len(h) or steps.max() < 1 << 16 else np.uint32))])


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_BIG = {"compression": "uncompressed", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4", "parquet.enable.dictionary": "false"}


def _each(read: Callable, do: Callable) -> Callable:
    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from do(block, read(payload.as_buffer()))

    return run


def _discount(n1: float, n2: float) -> float:
    return float(min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5)))


def _streams(docs: DataFrame, id_col: str, text_col: str, mod: int, held: int) -> tuple[DataFrame, int, int, int, Numbers]:
    """Texts as streams of word numbers, bytes of text, training tokens, words known, and how words are numbered."""
    blocks = in_blocks(docs, id_col, text_col)
    _, size = sizes(blocks)
    parts = max(8, size // RANGE_BYTES)

    def count(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, n = _tokens(table)
        words, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, _learned(table, mod, held, n)).astype(np.int64)
        own = _cut(_hash_part(words, parts), parts)
        yield rows(ASKS, [p for p, _, _ in own], [block] * len(own), [pack_sorted(words[a:b], c[a:b]) for _, a, b in own])

    counted = blocks.select("block", "payload").mapInArrow(_each(read_texts, count), ASK).repartition(parts, "part")
    numbered = stored(counted.mapInArrow(lambda b: _numbered(b, parts), "block long, kind int, payload binary, n long, types long"), **_BIG)
    tokens, types, ranks = (x or 0 for x in numbered.agg(F.sum("n"), F.sum("types"), F.max("types")).first())
    divisor = tokens + 0.1 * (types + 1)

    def number(block: int, table: pa.Table, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, n = _tokens(table)
        words, at = np.unique(h, return_inverse=True)
        ids, c = (np.concatenate(x)[at] for x in zip(*map(unpack, payloads), strict=True))
        edge = np.cumsum(n) - n
        doc_ids = table.column("doc_id")
        known, base = np.add.reduceat((c > 0).astype(np.int64), edge), np.add.reduceat(np.log10((c + 0.1) / divisor), edge)
        head = pa.table({"doc_id": doc_ids, "trained": pa.array(trained(doc_ids, mod, held), pa.bool_()), "n": n, "known": known, "base": base})
        yield rows(_STREAMS, [block], [_write_stream(head, ids)])

    n_tasks = max(8, size // (10 << 20))
    streams = stored(with_answers(blocks, numbered.where("block is not null").select("block", "kind", "payload"), n_tasks, number, "block long, payload binary"), **_BIG)
    discard(blocks)
    discard(numbered)
    tidy(docs.sparkSession)
    return streams, n_tasks, tokens, types, Numbers(parts, ranks)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10, held: int = 0, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity by token). Rows with crc32(id as text) mod `mod` = `held` are not learned from."""
    streams, n_tasks, tokens, types, numbers = _streams(docs, id_col, text_col, mod, held)
    parts = numbers.parts

    def ask(block: int, stream: tuple[pa.Table, np.ndarray]) -> Iterator[pa.RecordBatch]:
        table, w = stream
        n = table.column("n").to_numpy()
        codes, at = np.unique(_pairs(numbers, w, n), return_inverse=True)
        c = np.bincount(at, np.repeat(np.array(table.column("trained").to_pylist(), dtype=bool), n)).astype(np.int32)
        own = numbers.cut(codes)
        yield rows(ASKS, [p for p, _, _ in own], [block] * len(own), [pack_sorted(codes[a:b] - numbers.base(p), c[a:b]) for p, a, b in own])

    asked = streams.mapInArrow(_each(_read_stream, ask), ASK).repartition(parts, "part")
    gathered = stored(asked.mapInArrow(_gathered, ROW), **_BIG)
    tidy(docs.sparkSession)
    cells = gathered.where(f"kind = {CELLS}")
    counts = cells.select(*[F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(6)]).first()
    n1, n2, r1, r2, n, k = (x or 0.0 for x in counts)
    model = Model(_discount(n1, n2), _discount(r1, r2), types, (n, k))

    def totals(rows_of: DataFrame) -> DataFrame:
        sent = rows_of.select("part", "contexts").mapInArrow(lambda b: _to_contexts(b, parts), ASK).repartition(parts, "part")
        return stored(sent.mapInArrow(_totals, ROW), **_BIG)

    def by_part(*tables: DataFrame) -> DataFrame:
        every = tables[0]
        for x in tables[1:]:
            every = every.unionByName(x)
        return every.repartition(parts, "part").sortWithinPartitions("part", "kind")

    first = sums = totals(cells)
    state, models, kept = None, [], [cells, first]
    for index in range(samples + 1):
        sweeps = burn_in if index == 0 else 1
        new = stored(by_part(cells, sums, *([state] if state is not None else [])).mapInArrow(lambda b, m=model, i=index, s=sweeps: _sampled(b, parts, m, seed, i, s), ROW), **_BIG)
        if index == 1:  # the round before was burn-in
            discard(state)
            discard(sums)
        state, sums = new, totals(new)
        n, k = (x or 0.0 for x in state.select(F.sum(F.get("counts", F.lit(0))), F.sum(F.get("counts", F.lit(1)))).first())
        model = Model(model.d, model.d_root, types, (n, k))
        if index:
            s = len(models)
            models.append(model)
            kept += [state.withColumn("kind", F.lit(SAMPLE - s)).withColumn("contexts", F.lit(None).cast("binary")), sums.withColumn("kind", F.col("kind") + (s + 1) * parts)]
    answers = by_part(*kept, gathered.where(f"kind = {ASKED}")).mapInArrow(lambda b: _answered(b, parts, models), ANSWER)

    def finish(block: int, stream: tuple[pa.Table, np.ndarray], payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        table, w = stream
        n = table.column("n").to_numpy()
        _, at = np.unique(_pairs(numbers, w, n), return_inverse=True)
        p = np.concatenate([unpack(x)[0].astype(np.int64) for x in payloads])[at]
        held_out = [None if x is None else not x for x in table.column("trained").to_pylist()]
        yield rows(_SCORES, table.column("doc_id").to_pylist(), held_out, n, table.column("known").to_numpy(), table.column("base").to_numpy(), -np.add.reduceat(p, np.cumsum(n) - n) / STEPS)

    scored = with_answers(streams, answers, n_tasks, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double", _read_stream)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
