"""Language of whole texts by a string kernel.

The blended-spectrum presence kernel of two texts is the number of distinct
character n-grams, n from 1 to 3, that both hold, over the geometric mean of their
own numbers. N-grams are hashed to ``DIMENSIONS`` places. Kernel ridge regression,
one language against the rest, is fitted in the Nyström space of landmark texts;
texts are scored in batches by two matrix products: with the landmarks, then
with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, release

DIMENSIONS = 1 << 14
ORDERS = 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def presence(text: str, out: np.ndarray) -> None:
    """Set the places of a text's n-grams in a zero row."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        value = points
        for n in range(1, ORDERS + 1):
            if n > 1:
                value = value[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
            mixed = (value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            out[((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64)] = 1


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))


@dataclass(frozen=True)
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, a row each
    weights: np.ndarray  # landmarks x languages

    def unpacked(self) -> np.ndarray:
        """The landmarks' unit rows, transposed for the product."""
        return np.ascontiguousarray(unit_rows(np.unpackbits(self.landmarks, axis=1).astype(np.float32)).T)


def fit(bits: np.ndarray, labels: list[str], *, landmarks: int = 192, ridge: float = 1e-2) -> KernelModel:
    """Nyström kernel ridge regression on packed presence rows; the first rows of each language are landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return KernelModel([], bits[:0], np.zeros((0, 0), dtype=np.float32))
    x = unit_rows(np.unpackbits(bits, axis=1).astype(np.float32))
    each = max(1, landmarks // len(languages))
    owners = np.array(labels)
    chosen = np.concatenate([np.flatnonzero(owners == lang)[:each] for lang in languages])
    k_nm = (x @ x[chosen].T).astype(np.float64)
    values, vectors = np.linalg.eigh(k_nm[chosen])
    use = values > values.max() * 1e-8
    whiten = vectors[:, use] / np.sqrt(values[use])
    z = np.hstack([k_nm @ whiten])
    y = (owners[:, None] == np.array(languages)[None, :]).astype(float)
    share = y.sum(axis=0)
    row_weight = (y / np.maximum(1, share)).sum(axis=1) * len(y) / len(languages)  # languages count alike
    zw = z * row_weight[:, None]
    solved = np.linalg.solve(zw.T @ z + ridge * len(y) * np.eye(z.shape[1]) / 10, zw.T @ y)
    return KernelModel(languages, bits[chosen], (whiten @ solved).astype(np.float32))


def train(
    docs: DataFrame, training: Column, *, max_rows: int = 4000, seed: int = 5, landmarks: int = 192
) -> KernelModel:
    """Learn from at most about ``max_rows`` different rows of ``training`` with a language, the same number from each language.

    ``docs`` needs doc_id, text and lang; other columns are ignored. Rows without text,
    letters or language are skipped; a null doc_id is a row like others. Every language is
    learned, from one row at least, so more languages than ``max_rows`` raise the bound to their number,
    and landmarks grow with them. Rows are drawn by a seeded hash of doc_id, text and language,
    whose 53 bits keep to the bound at any size; a very long text counts with all its n-grams.
    Only their packed presence reaches the driver. An empty table teaches no language.
    """
    draw = F.xxhash64(F.lit(seed), "doc_id", "text", "lang")
    usable = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\p{L}"))
    usable = usable.select("lang", "text", F.shiftrightunsigned(draw, 11).alias("draw"))
    counts = materialize(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")), "language-counts")
    most = max(1, max_rows // max(1, counts.count()))
    drawn = usable.join(counts, "lang").filter(F.col("draw") <= F.greatest(F.lit(2.0**53 * most) / F.col("n"), F.col("least").cast("double")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for draw, text, lang in zip(*(batch.column(i) for i in range(3)), strict=True):
                if _LETTER.search(text := text.as_py()):
                    row = np.zeros(DIMENSIONS, dtype=np.uint8)
                    presence(text, row)
                    for column, value in zip(out, (draw.as_py(), np.packbits(row).tobytes(), lang.as_py()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["draw", "bits", "lang"])

    found = map_batches(drawn.select("draw", "text", "lang"), rows, "draw long, bits binary, lang string")
    sample = sorted((r["draw"], bytes(r["bits"]), r["lang"]) for r in found.dropDuplicates(["draw", "lang"]).collect())
    bits = np.frombuffer(b"".join(b for _, b, _ in sample), dtype=np.uint8).reshape(len(sample), DIMENSIONS // 8)
    release(counts)
    return fit(bits, [lang for _, _, lang in sample], landmarks=landmarks)


def predict(docs: DataFrame, model: KernelModel, *, batch_rows: int = 256) -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or if
    no language was learned. score: the regression's value, cut to 0 to 1. Ties go
    to the first language by name. Repeated rows are predicted one by one. An empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        landmarks = model.unpacked() if model.languages else None
        x = np.zeros((batch_rows, DIMENSIONS), dtype=np.float32)
        for whole in batches:
            for a in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(a, batch_rows)
                n = batch.num_rows
                x[:n] = 0
                known = np.zeros(n, dtype=bool)
                for i, text in enumerate(batch.column(1)):
                    text = text.as_py() or ""
                    if model.languages and _LETTER.search(text):
                        presence(text, x[i])
                        known[i] = True
                langs, scores = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
                if known.any():
                    values = (unit_rows(x[:n]) @ landmarks) @ model.weights
                    best = values.argmax(axis=1)
                    langs[known] = np.array(model.languages, dtype=object)[best[known]]
                    scores[known] = np.clip(values.max(axis=1)[known], 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], schema=schema)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
