"""Operator 6: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters'
vectors, each rotated by its place; a text's vector bundles (adds) those of all its trigrams; a
language's prototype bundles those of all its training texts. A text goes to the prototype with the
largest cosine after the mean of the prototypes, which all of them share, is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import carried, column, keyed, make, pieces

DIMENSIONS = 1024
SEED = 20_240_601
#: Trigram vectors kept in a worker: at a byte an element this bounds the table at 32 MB. Texts are bundled 2 MB at a time.
TABLE_TRIGRAMS, BUNDLE_BYTES = 32_768, 2 << 20
UNKNOWN = "und"
_BITS = 21


class Encoder:
    """Texts to bundled trigram vectors. Vectors follow from the seed and the code points alone."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.d, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.table: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            v = self.letters[code] = (np.random.default_rng([self.seed, code]).integers(0, 2, self.d, dtype=np.int8) * 2 - 1)
        return v

    def trigram(self, key: int) -> np.ndarray:
        if (v := self.table.get(key)) is None:
            a, b, c = key >> 2 * _BITS, key >> _BITS & ((1 << _BITS) - 1), key & ((1 << _BITS) - 1)
            v = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            if len(self.table) >= TABLE_TRIGRAMS:
                self.table.clear()
            self.table[key] = v
        return v

    @staticmethod
    def counts(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Distinct trigrams of the lower-cased text, their counts, and whether it has a letter. Runs of other characters are one blank."""
        low = text.lower()
        codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = ((codes >= 97) & (codes <= 122)) | (codes == 32)
        letter[codes == 32] = False
        high = np.flatnonzero(codes > 127)
        if len(high):
            distinct, back = np.unique(codes[high], return_inverse=True)
            letter[high] = np.array([chr(c).isalpha() for c in distinct])[back]
        if not letter.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), False
        codes = np.where(letter, codes, 32)
        codes = np.concatenate(([32], codes, [32]))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        keys = codes[:-2] << 2 * _BITS | codes[1:-1] << _BITS | codes[2:]
        found, n = np.unique(keys, return_counts=True)
        return found, n, True

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of bundled vectors (float64, whole numbers), and which texts have a letter."""
        out, has = np.zeros((len(texts), self.d)), np.zeros(len(texts), bool)
        for lo in range(0, len(texts), 128):
            each = [self.counts(t) for t in texts[lo : lo + 128]]
            has[lo : lo + len(each)] = [e[2] for e in each]
            if not has[lo : lo + len(each)].any():
                continue
            every, back = np.unique(np.concatenate([e[0] for e in each]), return_inverse=True)
            row = np.repeat(np.arange(len(each)), [len(e[0]) for e in each])
            n = np.concatenate([e[1] for e in each])
            for a in range(0, len(every), 4096):  # bounded pieces of the trigram table
                part = np.stack([self.trigram(int(k)) for k in every[a : a + 4096]]).astype(np.float32)
                inside = (back >= a) & (back < a + 4096)
                grid = np.zeros((len(each), len(part)), np.float32)
                grid[row[inside], back[inside] - a] = n[inside]
                out[lo : lo + len(each)] += grid @ part
        return out, has


def held_out(key: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame, label: str = "lang", text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Each label's bundle over all its texts: label, i, v. Each text counts by its trigrams' shares, in millionths, so sums are whole and exact.

    A task keeps one vector per label and hands on only those. Rows without label, text or letters add nothing.
    """
    rows = docs.select(F.col(label).cast("string").alias("_label"), F.col(text).alias("_text")).where("_label is not null and _text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions, seed), {}
        for batch in pieces(batches, "_text", BUNDLE_BYTES):
            labels = np.array(batch.column("_label").to_pylist(), dtype=object)
            vectors, has = encoder.bundle(batch.column("_text").to_pylist())
            length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
            unit = np.rint(vectors / np.where(length > 0, length, 1) * 1e6).astype(np.int64)
            for name in set(labels[has]):
                sums[name] = sums.get(name, 0) + unit[has & (labels == name)].sum(0)
        schema = pa.schema([("label", pa.string()), ("i", pa.int32()), ("v", pa.int64())])
        for name, v in sorted(sums.items()):
            yield make(schema, [name] * dimensions, np.arange(dimensions, dtype=np.int32), v)

    return rows.mapInArrow(run, "label string, i int, v bigint").groupBy("label", "i").agg(F.sum("v").alias("v"))


def identify(docs: DataFrame, training: DataFrame, key: str = "doc_id", label: str = "lang", text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Each text's language and score: key (or the columns named by carry, untouched, as a struct `row`), lang_pred, score in 0..1 (the cosine, negative ones as 0).

    Null texts and texts without a letter get `und` with score 0, and so does everything if nothing
    could be learned. Ties go to the label that sorts first. Only `text` enters a prediction; very
    long texts are whole. The prototypes are labels x dimensions numbers, whatever the corpus size.
    """
    spark = docs.sparkSession
    model: dict[str, np.ndarray] = {}
    for r in prototypes(training, label, text, dimensions, seed).toLocalIterator():
        model.setdefault(r["label"], np.zeros(dimensions))[r["i"]] = r["v"]
    names = sorted(model)
    if names:
        unit = np.stack([model[n] / max(np.linalg.norm(model[n]), 1e-300) for n in names])
        mean = unit.mean(0) if len(names) > 1 else np.zeros(dimensions)
        centred = unit - mean
        centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-300)
    else:
        mean, centred = np.zeros(dimensions), np.zeros((0, dimensions))
    sent = spark.sparkContext.broadcast((names, mean, centred))
    source, where = keyed(docs, key, text, carry)
    kind = source.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (names, mean, centred) = Encoder(dimensions, seed), sent.value
        for batch in pieces(batches, where, BUNDLE_BYTES):
            schema = pa.schema([batch.schema.field("_key"), ("lang_pred", pa.string()), ("score", pa.float64())])
            vectors, has = encoder.bundle([t or "" for t in column(batch, where).to_pylist()])
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = vectors / np.where(length > 0, length, 1)
            along = vectors @ mean / max(float(mean @ mean), 1e-300)
            rest = vectors - np.clip(along, 0, None)[:, None] * mean
            length = np.linalg.norm(rest, axis=1, keepdims=True)
            cosine = np.round(rest / np.where(length > 0, length, 1) @ centred.T, 9)
            if not names:
                yield make(schema, batch.column("_key"), [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows)
                continue
            best = cosine.argmax(1)
            score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
            yield make(schema, batch.column("_key"), [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score)

    return source.mapInArrow(run, f"_key {kind}, lang_pred string, score double").select(carried(key, carry), "lang_pred", "score")


def query(docs: DataFrame) -> DataFrame:
    out = identify(docs, docs.where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
