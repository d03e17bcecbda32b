"""Language ID with a string kernel.

Kernel: blended-spectrum presence. A text is the set of its 1- to 3-grams of letters (lower-cased, word ends kept), hashed
to 2**14 places; the kernel of two texts is the number of places both have, over the geometric mean of their sizes.
Nyström: landmarks are sampled texts; a text's features are its kernels with them times the inverse root of the landmarks'
kernel. One-versus-rest kernel ridge regression on these features is solved on the driver. Texts are scored in batches:
presence matrix by landmarks, by coefficients.

The classifier is fitted on at most about `per_lang` rows of each language (chosen by hash of the id) and `landmarks`
landmarks; every row is scored over its whole text.

Defined results: a null text or one without letters is 'und' with score 0; null languages aren't learned; without rows to
learn from all is 'und'; ties go to the language first in order; repeated rows repeat; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.shared import ship

PLACES, PER_LANG, LANDMARKS, RIDGE, SHARPNESS = 1 << 14, 1500, 256, 1e-2, 4.0
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The presence matrix of some texts, and whether each has a letter."""
    out = np.zeros((len(texts), PLACES), dtype=bool)
    has = np.zeros(len(texts), dtype=bool)
    lo = 0
    while lo < len(texts):
        hi, size, part = lo, 0, []
        while hi < len(texts) and size < 500_000:
            part.append(" " + (texts[hi] or "").lower() + "  ")
            size += len(part[-1])
            hi += 1
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(lo, hi), [len(p) for p in part])
        letter = _is_letter()[points]
        has[owner[letter]] = True
        c = np.where(letter, points, 32).astype(np.uint64)
        two = c[:-1] * np.uint64(0x110000) + c[1:]
        three = two[:-1] * np.uint64(0x110000) + c[2:]
        one = np.flatnonzero(letter)
        out[owner[one], _place(c[one], 1)] = True
        at = np.flatnonzero(letter[:-1] | letter[1:])
        out[owner[at], _place(two[at], 2)] = True
        at = np.flatnonzero(letter[1:-1])
        out[owner[at], _place(three[at], 3)] = True
        lo = hi
    return out, has


def _place(x: np.ndarray, n: int) -> np.ndarray:
    x = (x + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float32), b.astype(np.float32)
    return (a @ b.T) / np.sqrt(np.maximum(a.sum(axis=1), 1)[:, None] * np.maximum(b.sum(axis=1), 1)[None, :])


class Model:
    """Landmarks and their coefficients for each language."""

    def __init__(self, x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS):
        self.langs = sorted(set(langs))
        own = [[i for i, y in enumerate(langs) if y == lang] for lang in self.langs]
        picked = sorted(i for rows in own for i in rows[: max(1, landmarks // len(own))])
        self.landmarks = np.packbits(x[picked], axis=1)
        z = x[picked]
        values, vectors = np.linalg.eigh(kernel(z, z).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.vstack([kernel(x[i : i + 512], z).astype(np.float64) @ root for i in range(0, len(x), 512)])
        phi = np.hstack([phi, np.ones((len(x), 1))])
        y = np.array([[1.0 if a == lang else -1.0 for lang in self.langs] for a in langs])
        size = np.array([len(rows) for rows in own], dtype=float)
        weight = (len(langs) / len(own) / size)[[self.langs.index(a) for a in langs]][:, None]
        solved = np.linalg.solve(phi.T @ (phi * weight) + RIDGE * len(langs) / 100 * np.eye(phi.shape[1]), phi.T @ (y * weight))
        self.coef, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x, has = presence(texts)
        z = np.unpackbits(self.landmarks, axis=1, count=PLACES)
        s = SHARPNESS * (kernel(x, z) @ self.coef + self.bias)
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        best = s.argmax(axis=1)
        return [self.langs[k] if ok else "und" for k, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, s.max(axis=1), 0).astype(np.float64)


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model | None:
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) / F.lit(1 << 20)
    chosen = known.where(place < F.element_at(share, F.col(lang_col))).select(F.col(id_col).cast("long").alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def features(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, has = presence(part.column(2).to_pylist())
                keep = pa.array(has)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array([r.tobytes() for r in np.packbits(x[has], axis=1)], pa.binary())], names=["i", "lang", "x"])

    rows = sorted(chosen.mapInArrow(features, "i long, lang string, x binary").collect(), key=lambda r: (r["lang"], (r["i"] or 0) * 2654435761 % 2**32, r["x"]))
    if not rows:
        return None
    x = np.unpackbits(np.array([np.frombuffer(r["x"], np.uint8) for r in rows]), axis=1, count=PLACES)
    return Model(x, [r["lang"] for r in rows], landmarks)


def _run(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            langs, score = model.predict(part.column(1).to_pylist()) if model else (["und"] * part.num_rows, np.zeros(part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs, learned from the texts and languages of training."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(training, text_col, lang_col, id_col, per_lang, landmarks))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda b: _run(b, model.value), "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = "crc32(cast(doc_id as string)) % 4"
    found = identify(docs.select("doc_id", "text"), docs.where(f"{rest} <> 2").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.expr(f"{rest} = 2").alias("held_out"), "lang_pred", "score")
