"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding, normalised by length.

Folding: lower case, homoglyphs and full-width forms to Latin letters, zero-width characters dropped, digits and signs that
stand for letters to those letters; l, 1, ! and | become i, as each stands for either. Words are then runs of letters.

Lexicon: from at most `sample` labelled rows (a documented bound; chosen by hash of the id, and one row only of those
whose least shingle hash is equal, so that copies don't count as evidence). Candidates are whole words and beginnings of
words, of 3 letters or more and of any length; the weight is the log odds ratio between toxic and other rows. A candidate
needs `least` toxic rows or `least_share` of them, and a weight of `least_weight`, and every one that has them is taken, so the
sample bounds the lexicon; of terms that extend each other with equal counts the longest is kept. Candidates are counted by
64-bit hashes, a word's beginnings by one running sum, and only those taken are read off the toxic rows as strings.

Score: each word takes its heaviest match, unless an exception phrase covers it; a logistic function, fitted on the same
sample, of the logarithm of their sum and of their sum for each hundred words.

Defined results: a null or empty text has no matches; ids that are labelled twice count as toxic if any label says so;
without training rows of both kinds every score is 0; null labels are ignored; repeated rows repeat; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm.vec import U64, mix, powers
from ballast.shared import compact, make_room, ship, stored

SAMPLE, LEAST, LEAST_SHARE, LEAST_WEIGHT, SHORTEST = 50_000, 5, 0.002, 3.5, 3
#: Phrases in which a word of the lexicon does no harm.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "sore loser", "pond scum", "worthless check")
#: Characters and the letters that they stand for.
FOLDS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
    "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
}


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in FOLDS.items()}
    for k in range(26):
        table[0xFF21 + k] = table[0xFF41 + k] = "i" if chr(97 + k) == "l" else chr(97 + k)
    return table


_FOLD = _fold_table()
_SPLIT = re.compile(r"[^\W\d_]+")


_ENDS = re.compile(r"[!|]+(?!\w)")


def folded(text: str | None) -> list[str]:
    """Words after folding. Signs at a word's end are punctuation."""
    return _SPLIT.findall(_ENDS.sub(" ", (text or "").lower()).translate(_FOLD))


def candidates(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, line, first and last letter of each candidate and whether it is a whole word. Lines are words joined by single spaces; letters are counted over the lines, each with a space after it."""
    points = np.frombuffer("".join(x + " " for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lines)), [len(x) + 1 for x in lines])
    letter = points != 32
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    start = np.maximum.accumulate(np.where(begins, np.arange(len(points)), 0)) if len(points) else np.zeros(0, np.int64)
    last = np.flatnonzero(letter & (np.arange(len(points)) - start >= SHORTEST - 1))
    power, inverse = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, U64)
    np.cumsum(mix(points.astype(U64) + U64(1)) * power[: len(points)], out=total[1:])
    first = start[last]
    h = mix((total[last + 1] - total[first]) * inverse[first] + (last - first).astype(U64))
    whole = ~letter[last + 1]
    every = np.concatenate([h, mix(h[whole] + U64(1))])
    at = np.concatenate([last, last[whole]])
    return every, owner[at], start[at], at, np.arange(len(every)) >= len(h)


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        self.weights = weights
        self.match = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.match.add_word(term, (len(term), weight))
        for phrase in exceptions:
            words = " ".join(folded(phrase))
            self.match.add_word(f" {words} ", (len(words) + 2, 0.0))
        if len(self.match):
            self.match.make_automaton()

    def total(self, words: list[str]) -> float:
        """Sum over words of the heaviest match that isn't in an exception phrase."""
        if not len(self.match) or not words:
            return 0.0
        line = " " + " ".join(words) + " "
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in self.match.iter(line):
            start = end - n + 1
            if weight == 0.0:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for a, b in spared:
            for k in [k for k in best if a <= k < b]:
                del best[k]
        return sum(best.values())


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.minimum(100 * total / np.maximum(words, 1), 100) / 10], axis=1)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    ridge = np.diag([0.0, *[1e-2] * (x.shape[1] - 1)]) + 1e-6 * np.eye(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b = b + np.clip(step, -5, 5)
    return b


def _texts(batches: Iterator[pa.RecordBatch], labels: dict[int, int]) -> Iterator[pa.RecordBatch]:
    make_room()
    for batch in batches:
        ids, out = batch.column(0).to_pylist(), ([], [], [], [])
        for i in [k for k, d in enumerate(ids) if d in labels]:
            words = folded(batch.column(1)[i].as_py())
            line = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
            key = min(xxhash.xxh64_intdigest(s) >> 1 for s in line)
            for column, x in zip(out, (ids[i], labels[ids[i]], key, " ".join(words)), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "toxic", "key", "words"])


def _parts(lines: list[str], size: int = 200_000) -> Iterator[slice]:
    """Slices of the lines that have about `size` letters each, or one longer line."""
    lo = at = 0
    for i, x in enumerate(lines):
        at += len(x) + 1
        if at >= size:
            yield slice(lo, i + 1)
            lo, at = i + 1, 0
    if lo < len(lines):
        yield slice(lo, len(lines))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some lines that have each candidate; Spark adds them up before it exchanges them."""
    make_room()
    for labels, lines in ((b.column(0).to_numpy()[s], x[s]) for b in batches for x in [b.column(1).to_pylist()] for s in _parts(x)):
        h, owner, _, _, _ = candidates(lines)
        once = np.unique(mix(h + owner.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
        terms, at = np.unique(h[once], return_inverse=True)
        n, bad = np.bincount(at, minlength=len(terms)), np.bincount(at, labels[owner[once]], minlength=len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(bad), pa.array(n - bad)], names=["term", "toxic", "other"])


def _spelled(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(term, word) of the wanted hashes (sorted); a whole word ends with a space."""
    for lines in (x[s] for b in batches for x in [b.column(0).to_pylist()] for s in _parts(x)):
        h, _, first, last, whole = candidates(lines)
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        hit = np.flatnonzero(wanted[at] == h)
        hit = hit[np.unique(h[hit], return_index=True)[1]]
        text = "".join(x + " " for x in lines)
        words = [" " + text[a : b + 1] + " " * w for a, b, w in zip(first[hit].tolist(), last[hit].tolist(), whole[hit].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array(words, pa.string())], names=["term", "word"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[dict[str, float], np.ndarray]:
    """labels: (doc_id, toxic). Weights of the lexicon, and the logistic coefficients."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    known = docs.sparkSession.sparkContext.broadcast({int(r["doc_id"]): int(r["toxic"] > 0) for r in chosen})
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(compact(texts).mapInArrow(lambda b: _texts(b, known.value), "doc_id long, toxic int, key long, words string"), as_it_is=True)
    one = rows.groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id"))
    kept = rows.join(one, ["key", "toxic", "doc_id"], "left_semi")
    sizes = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}, np.array([-50.0, 0.0, 0.0])
    counts = kept.select("toxic", "words").mapInArrow(_counts, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("other") + 0.5) / (n0 + 1))
    taken = {r["term"]: (r["weight"], r["toxic"], r["other"]) for r in counts.where(f"toxic >= {max(LEAST, LEAST_SHARE * n1)}").withColumn("weight", weight).where(f"weight >= {LEAST_WEIGHT}").collect()}
    wanted = np.sort(np.fromiter(taken, np.int64, len(taken)).view(U64))
    spelled = kept.where("toxic = 1").select("words").mapInArrow(lambda b: _spelled(b, wanted), "term long, word string").distinct().collect() if taken else []
    found = {r["word"]: taken[r["term"]] for r in spelled}
    longer = {(w[:-1], n, m) for w, (_, n, m) in found.items()}  # with equal counts, a term one letter (or the word's end) longer is there if any longer one is
    weights = {w: float(x) for w, (x, n, m) in found.items() if (w, n, m) not in longer}

    def total(batches):
        lexicon = Lexicon(weights, exceptions)
        for batch in batches:
            words = [x.split() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.total(w) for w in words], pa.float64()), pa.array([len(w) for w in words], pa.int64())], names=["toxic", "total", "n"])

    fit = kept.select("toxic", "words").mapInArrow(total, "toxic int, total double, n long").collect()
    y, t, n = (np.array([r[k] for r in fit], dtype=float) for k in range(3))
    return weights, _fit(features(t, n), y)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """(doc_id, score, total, n_words) of each row. labels: (doc_id, toxic) of the rows to learn from."""
    ship(docs.sparkSession)
    weights, b = learn(docs, labels, id_col, text_col, sample, exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        make_room()
        lexicon = Lexicon(shared.value, exceptions)
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(batch.column(1)):
                words = folded(text.as_py())
                total[i], n[i] = lexicon.total(words), len(words)
            score = 1 / (1 + np.exp(-np.clip(features(total, n) @ b, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(total), pa.array(n)], names=["doc_id", "score", "total", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, total double, n_words long")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under `cut`."""
    ship(docs.sparkSession)
    weights, b = learn(docs, labels, id_col, text_col)
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text_col)

    def run(batches):
        make_room()
        lexicon = Lexicon(shared.value, EXCEPTIONS)
        for batch in batches:
            words = (folded(t.as_py()) for t in batch.column(at))
            found = np.array([(lexicon.total(w), len(w)) for w in words], dtype=float).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(features(found[:, 0], found[:, 1]) @ b, -50, 50)))
            yield batch.filter(pa.array(score < cut))

    return compact(docs).mapInArrow(run, docs.schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id", "toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), training_labels(spark, sf_dir))
    return scored.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
