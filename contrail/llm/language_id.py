"""Language identification with a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, ridge regression."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.batches import carried, chunks, flat_bytes, large_text, whole
from contrail.sources.scratch import materialize

UNKNOWN = "und"
ROWS = 256  # texts in one matrix product
CHUNK = 1 << 20  # bytes of text whose n-grams are held at once
_SPACE = 1 << 24
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 1-, 2- and 3-grams of UTF-8 bytes (A-Z lower-cased) and the row of each."""
    data, offsets = flat_bytes(texts)
    low, sizes = _LOWER[data], np.diff(offsets)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(low))  # bytes from here to the end of the text
    codes, rows = [low], [row]  # a byte, then a length mark above it: codes of different lengths differ
    if len(low) > 1:
        two = (1 << 8 | low[:-1]) << 8 | low[1:]
        codes.append(two[left[:-1] >= 2])
        rows.append(row[:-1][left[:-1] >= 2])
    if len(low) > 2:
        three = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) + (1 << 17)
        codes.append(three[left[:-2] >= 3])
        rows.append(row[:-2][left[:-2] >= 3])
    return np.concatenate(codes), np.concatenate(rows)


@dataclass
class Model:
    """Codes the landmarks have, which landmark has which, and the projections to features and scores."""

    codes: np.ndarray
    presence: np.ndarray  # code x landmark
    features: np.ndarray  # landmark x feature
    weights: np.ndarray  # feature x language
    languages: list[str]

    def values(self) -> tuple:
        """What it takes to make it again: plain values travel to workers that lack this package."""
        return self.codes, self.presence, self.features, self.weights, self.languages

    @functools.cached_property
    def column(self) -> np.ndarray:
        small = np.int16 if len(self.codes) < 1 << 15 else np.int32
        table = np.full(_SPACE + (1 << 17), -1, small)
        table[self.codes] = np.arange(len(self.codes))
        return table

    def kernel(self, texts: pa.Array) -> np.ndarray:
        """Common n-grams of each text with each landmark, over the root of both sizes."""
        codes, rows = grams(texts)
        column = self.column[codes]
        known = column >= 0
        present = np.zeros((len(texts), len(self.codes)), np.float32)
        present[rows[known], column[known]] = 1
        own = np.maximum(present.sum(1), 1)
        return present @ self.presence / np.sqrt(own[:, None] * self.presence.sum(0)[None])

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.kernel(texts) @ self.features @ self.weights


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    for i in range(0, len(texts), ROWS):
        yield texts.slice(i, ROWS)


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About rows / languages rows of each language, by hash; the same ones every time."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = {lang: min(1.0, rows / len(counts) / n) for lang, n in counts.items()}
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in share.items()], F.lit(0.0))
    place = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / (1 << 30)
    return labelled.withColumn("place", place / limit).filter("place < 1")


def fit(labelled: DataFrame, sample_rows: int = 4096, landmarks: int = 96, ridge: float = 1e-2) -> Model | None:
    """Fit on ``labelled`` (key, text, lang; none null); None if it has no row.

    At most about ``sample_rows`` rows are learned from, the same number of each language. The
    driver holds the n-grams of ``landmarks`` texts and sums of features by features.
    """
    if not labelled.take(1):
        return None
    sample = materialize(_sample(labelled, sample_rows).repartition(8, "key"), "language_sample")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=CHUNK):
            for k, text in enumerate(large_text(part.column("text"))):
                codes = np.unique(grams(pa.array([text.as_py()], pa.large_string()))[0]).astype(np.uint32)
                one = part.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column("lang"), one.column("place"), pa.array([codes.tobytes()])], ["lang", "place", "codes"]
                )

    per = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(1, landmarks // len(per))
    near = F.coalesce(*[F.when(F.col("lang") == k, F.lit(4 * each / n)) for k, n in per.items()], F.lit(0.0))
    few = sample.filter(F.col("place") < near).select("lang", "place", "text")
    rows = few.mapInArrow(coded, "lang string, place double, codes binary").collect()
    chosen = []
    for lang in per:
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.place, r.codes))
        chosen += [np.frombuffer(r.codes, np.uint32) for r in own[:each]]
    if not chosen:
        return None
    codes = np.unique(np.concatenate(chosen))
    presence = np.stack([np.isin(codes, c) for c in chosen], 1).astype(np.float32)
    sizes = presence.sum(0)
    square = presence.T @ presence / np.sqrt(np.maximum(np.outer(sizes, sizes), 1))
    values, vectors = np.linalg.eigh(square.astype(np.float64))
    kept = values > 1e-6 * values.max()
    features = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    languages = sorted(per)
    model = Model(codes, presence, features, np.zeros((features.shape[1], len(languages)), np.float32), languages)
    shared = sample.sparkSession.sparkContext.broadcast(model.values())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, gram, target = Model(*shared.value), 0.0, 0.0
        for part in chunks(batches, most=CHUNK):
            langs = np.array([m.languages.index(x) for x in part.column("lang").to_pylist()])
            texts = large_text(part.column("text"))
            for i, piece in enumerate(_pieces(texts)):
                f = (m.kernel(piece) @ m.features).astype(np.float64)
                want = np.full((len(piece), len(m.languages)), -1.0)
                want[np.arange(len(piece)), langs[i * ROWS : i * ROWS + len(piece)]] = 1
                gram, target = gram + f.T @ f, target + f.T @ want
        if not np.isscalar(gram):
            yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([target.tobytes()])], ["gram", "target"])

    parts = sample.select("lang", "text").mapInArrow(sums, "gram binary, target binary").collect()
    width = features.shape[1]
    gram = sum(np.frombuffer(p.gram).reshape(width, width) for p in parts)
    target = sum(np.frombuffer(p.target).reshape(width, -1) for p in parts)
    weights = np.linalg.solve(gram + ridge * len(chosen) * np.eye(width), target)
    return Model(codes, presence, features, weights.astype(np.float32), languages)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(
    docs: DataFrame,
    sample_rows: int = 4096,
    landmarks: int = 96,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Predict the language of every whole text, learned from labelled rows that are not held out.

    Held out are rows whose crc32 of the key as text, mod 3, is 1. One row per row of ``docs``:
    ``key``, held_out, lang_pred, score (0 to 1, the part of the best language in the scores'
    excess over the lowest possible). Texts that are null or have no letter are ``und`` with score
    0, and so is everything if no row has a label. Rows with a null key are never learned from and
    count as not held out; equal best scores go to the first language by name; repeated rows stay;
    other columns aren't read, but those of ``carry`` come along as the struct carried; an empty
    table gives an empty result. Scoring needs no shuffle.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("lang"), *carried(docs, carry, text))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    learn = rows.filter(~held_out(F.col("key")) & F.col("key").isNotNull() & F.col("lang").isNotNull() & letters)
    model = fit(learn.select("key", "text", "lang"), sample_rows, landmarks)
    along = rows.columns[3:] + ["text"] * (text in carry)
    out = rows.select("key", held_out(F.col("key")).alias("held_out"), letters.alias("letters"), "text", *rows.columns[3:])
    if model is None:
        return out.select(F.col("key").alias(key), "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *whole(carry, text))
    shared = docs.sparkSession.sparkContext.broadcast(model.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for part in chunks(batches, most=CHUNK):
            texts = large_text(part.column("text"))
            values = np.concatenate([m.scores(piece) for piece in _pieces(texts)])
            excess = np.maximum(values + 1, 0)
            best = values.argmax(1)
            score = excess[np.arange(len(best)), best] / np.maximum(excess.sum(1), 1e-9)
            letters = part.column("letters").to_numpy(zero_copy_only=False)
            names = [m.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("held_out"), pa.array(names), pa.array(np.where(letters, score, 0).astype(np.float64))]
                + [part.column(c) for c in along],
                ["key", "held_out", "lang_pred", "score", *along],
            )

    schema = T.StructType().add("key", out.schema["key"].dataType).add("held_out", "boolean")
    schema = schema.add("lang_pred", "string").add("score", "double")
    for c in along:
        schema = schema.add(c, out.schema[c].dataType)
    return out.mapInArrow(run, schema).select(F.col("key").alias(key), "held_out", "lang_pred", "score", *whole(carry, text))
