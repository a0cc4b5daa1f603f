"""Language identification by nearest centroid.

A text is a vector of hashed letter n-grams (one to three letters, words bounded by spaces), weighted by TF-IDF and
normalised. Every language has several centroids, the means of clusters of its training vectors (spherical k-means).
The nearest centroid by cosine names the language; a text farther from it than nearly all training texts of that
language were is marked as rejected.

Document frequencies are counted over all training texts. The centroids are fitted on at most `SAMPLE` training texts
a language, chosen by a hash of the text: the one bounded sample, a parameter. The model holds `DIMENSIONS` weights and
CENTROIDS vectors a language, whatever the input; it is what goes to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.shared import mix64

DIMENSIONS = 1 << 13
GRAMS = (1, 2, 3)
CENTROIDS = 3
SAMPLE = 1_500
ROUNDS = 8
REJECT_SHARE = 0.01
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """Lower-cased code of every letter of the basic plane, a space for all else."""
    codes = np.full(1 << 16, 32, dtype=np.uint32)
    for c in range(1 << 16):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            codes[c] = ord(low) if len(low) == 1 else c
    return codes


_LETTERS = _letter_table()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, counts) of the hashed n-grams of a text, sorted; a long text is counted a piece at a time."""
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    longest = max(GRAMS)
    step = 1 << 18
    for begin in range(0, len(text), step):
        piece = text[max(begin - longest + 1, 0) : begin + step]
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = np.where(codes < 1 << 16, _LETTERS[codes & 0xFFFF], codes)  # characters beyond are taken as letters
        fresh = min(longest - 1, begin)
        if not begin:
            codes = np.concatenate([[np.uint32(32)], codes])
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)  # runs of others are one space
        at = np.cumsum(keep)
        new = at[fresh - 1] if fresh else 0
        codes = codes[keep].astype(np.uint64)
        for n in GRAMS:
            m = len(codes) - n + 1
            first = max(int(new) - n + 1, 0)
            if m > first:
                key = np.full(m - first, n, dtype=np.uint64)
                for j in range(n):
                    key = (key << np.uint64(21)) ^ codes[first + j : m + j]
                blank = (codes[first:m] == 32) if n == 1 else np.zeros(m - first, dtype=bool)
                found = mix64(key[~blank]) & np.uint64(DIMENSIONS - 1)
                total += np.bincount(found.astype(np.int64), minlength=DIMENSIONS)
    dims = np.flatnonzero(total)
    return dims, total[dims]


@dataclass
class Model:
    idf: np.ndarray  # DIMENSIONS weights
    centroids: np.ndarray  # one unit row each
    languages: list[str]  # of the rows
    least: dict[str, float]  # cosine under which a text is rejected

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        dims, counts = gram_counts(text)
        weights = (1 + np.log(counts)) * self.idf[dims]
        norm = np.sqrt((weights**2).sum())
        return dims, (weights / norm if norm else weights)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        dims, weights = self.vector(text)
        scores = self.centroids[:, dims] @ weights
        best = int(np.argmax(scores))  # of equal ones the first, languages being sorted
        score = float(min(max(scores[best], 0.0), 1.0))
        return self.languages[best], score, score < self.least[self.languages[best]]


def _document_frequencies(texts: DataFrame) -> DataFrame:
    """(dim, df): in how many of the texts a dimension occurs; dim -1 is the number of texts."""

    def count(batches):
        seen, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen[gram_counts(text.as_py())[0]] += 1
                n += 1
        dims = np.flatnonzero(seen)
        yield pa.record_batch([pa.array([-1, *dims], pa.int32()), pa.array([n, *seen[dims]], pa.int64())], names=["dim", "df"])

    return texts.select("text").mapInArrow(count, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df"))


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the vector nearest to the mean, then those farthest from all chosen."""
    mean = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ mean))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    # A cluster of a few odd texts speaks for no language.
    own = np.argmax(vectors @ centres.T, axis=1)
    sizes = np.bincount(own, minlength=len(centres))
    return centres[sizes >= max(1, 0.02 * len(vectors))]


def fit(rows: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Model of the rows (text, lang); those with a null or a text without a letter are left out."""
    rows = rows.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    frequencies = {r.dim: r.df for r in _document_frequencies(rows).collect()}  # DIMENSIONS rows at most
    n = frequencies.pop(-1, 0)
    df = np.zeros(DIMENSIONS)
    df[list(frequencies)] = list(frequencies.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    if not counts:
        return Model(idf, np.zeros((0, DIMENSIONS)), [], {})
    share = F.lit(0.0)
    for name, size in sorted(counts.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / size))).otherwise(share)
    spread = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    # Copies of a text are one before they meet in a task, and a task has at most `sample` texts.
    first = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    picked = rows.where(spread < share).select("lang", "text").distinct()
    picked = picked.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).drop("k")

    def train(key: tuple, table: pa.Table) -> pa.Table:
        model = Model(idf, np.zeros((0, 0)), [], {})
        texts = sorted(set(table.column("text").to_pylist()))
        vectors = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
        for i, text in enumerate(texts):
            dims, weights = model.vector(text)
            vectors[i, dims] = weights
        centres = _cluster(vectors, k)
        least = float(np.quantile((vectors @ centres.T).max(axis=1), REJECT_SHARE))
        rows = [centre.astype(np.float32).tobytes() for centre in centres]
        return pa.table({"lang": [key[0].as_py()] * len(rows), "centre": rows, "least": [least] * len(rows)})

    fitted = picked.groupBy("lang").applyInArrow(train, "lang string, centre binary, least double").collect()
    fitted.sort(key=lambda r: (r.lang, bytes(r.centre)))
    centres = np.stack([np.frombuffer(r.centre, np.float32) for r in fitted]) if fitted else np.zeros((0, DIMENSIONS))
    return Model(idf, centres.astype(np.float64), [r.lang for r in fitted], {r.lang: r.least for r in fitted})


def predict(docs: DataFrame, model: Model, text: Column) -> DataFrame:
    """`docs` with a struct column `language`: lang, score (the cosine, 0 to 1), rejected."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def named(texts: pa.Array) -> pa.Array:
        run = shipped.value.predict
        found = [run(t.as_py()) for t in texts]
        columns = zip(*found, strict=True) if found else ([], [], [])
        kinds = (pa.string(), pa.float64(), pa.bool_())
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, names=["lang", "score", "rejected"])

    return docs.withColumn("language", named(text))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    held_fold: int = 1,
    sample: int = SAMPLE,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of `docs`.

    A row is held out where crc32(id as text) mod `folds` is `held_fold`; the model learns from text and non-null
    language of the others (a null id is never learned from, and its held_out is true). A null text, one without a
    letter, and every text where nothing was learned, is `und` with score 0. Equally near languages: the first by name.
    Repeated rows give a row each, an empty table an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(True))
    model = fit(rows.where(~held).select("text", "lang"), sample)
    return predict(rows.select("doc_id", held.alias("held_out"), "text"), model, F.col("text")).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected")
    )
