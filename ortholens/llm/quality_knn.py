"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Features of a text are the weighted frequencies of its words, of character trigrams after letters are mapped to classes and of
letter pairs (hashed), and the level of its immediate repetition of words. A truncated singular value decomposition of the labelled texts'
tf-idf rows, by random projection and power iteration, spans the latent space.
Labelled vectors are broadcast (their number is a parameter); every document's cosine with each of them is computed in blocks
by matrix products, and the labels of the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholens.llm.common import held_out
from ortholens.llm.shingles import words_of_texts

#: Production parameters: labelled rows that vote (expected number), dimensions, neighbours, rows per block; rows longer than
#: FIT_CHARS are not drawn for learning.
FIT_ROWS = 3_000
DIMENSIONS = 48
NEIGHBOURS = 25
BLOCK = 256
FIT_CHARS = 20_000
LEAST_SCORE = 0.3

#: Character classes: other, blank, line end, lower, upper, digit, letter beyond ASCII, then one class a printable sign.
_CLASS = np.zeros(129, np.int64)
_CLASS[128] = 6
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 2 if _ch == "\n" else 1 if _ch.isspace() else 3 if _ch.islower() else 4 if _ch.isupper() else 5 if _ch.isdigit() else 0
_signs = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_signs] = 7 + np.arange(len(_signs))
CLASSES = 7 + len(_signs)
SHAPES = CLASSES**3
PAIRS = 1 << 12
PLACES = SHAPES + PAIRS
#: Levels of the share of words that equal the one before them, by lower bound.
LEVELS = np.array([0.05, 0.2, 0.5, 0.8])
#: Share of the labelled texts that must hold a feature (two of them at least), shares of a row's squared length that shapes and
#: pairs, words, and repetition make, and steps of power iteration.
LEAST_DF = 0.01
SHARES = (0.5, 0.25, 0.25)
POWER = 4


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, 1 + ln frequency) of the class trigrams and hashed letter pairs of a text."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kind = _CLASS[np.minimum(points, 128)]
    shapes = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:] if len(kind) > 2 else kind[:0]
    low = np.where((points >= 65) & (points <= 90), points + 32, points)
    pairs = ((low[:-1] * 2654435761 + low[1:] * 40503) >> 7) % PAIRS + SHAPES if len(low) > 1 else low[:0]
    found, n = np.unique(np.concatenate([shapes, pairs]), return_counts=True)
    return found, 1 + np.log(n)


def terms(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(word hashes, 1 + ln frequency) of each text, and its level of immediate repetition."""
    out, levels = [], np.zeros(len(texts), np.int64)
    for i, w in words_of_texts(texts):
        found, n = np.unique(w, return_counts=True)
        out.append((found, 1 + np.log(n)))
        levels[i] = np.searchsorted(LEVELS, (w[1:] == w[:-1]).sum() / max(len(w), 1), "right")
    return out, levels


class Model:
    """Vocabulary with idf weights, projection, and the labelled vectors with their labels."""

    def __init__(self, texts: list[str], labels: list[int], dimensions: int = DIMENSIONS):
        least = max(2, LEAST_DF * len(texts))

        def vocabulary(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            found, df = np.unique(np.concatenate([p for p, _ in rows]), return_counts=True)
            keep = df >= min(least, df.max(initial=1))
            return found[keep], (np.log((1 + len(texts)) / (1 + df[keep])) + 0.2).astype(np.float32)

        self.places, of_places = vocabulary([features(t) for t in texts])
        self.words, of_words = vocabulary(terms(texts)[0])
        self.idf = np.concatenate([of_places, of_words])
        x = self.matrix(texts)
        self.project = self.directions(x, dimensions)
        self.vectors = self.unit(x @ self.project).T.copy()
        self.labels = np.array(labels, np.float32)

    @staticmethod
    def directions(x: np.ndarray, dimensions: int) -> np.ndarray:
        """The leading right singular vectors of x, as columns; never more memory than a few columns of x."""
        width = min(dimensions + 16, *x.shape)
        y = x @ np.random.RandomState(5).standard_normal((x.shape[1], width)).astype(np.float32)
        for _ in range(POWER):
            y = x @ (x.T @ np.linalg.qr(y)[0])
        q = np.linalg.qr(y)[0]
        _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
        return np.ascontiguousarray(v[:dimensions].T).astype(np.float32)

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        """Rows of tf * idf over the vocabularies; shapes, words and repetition are each of a fixed length, unit together."""
        n = len(self.idf)
        out = np.zeros((len(texts), n + len(LEVELS) + 1), np.float32)
        words, levels = terms(texts)
        parts = ((0, self.places, [features(t) for t in texts], SHARES[0]), (len(self.places), self.words, words, SHARES[1]))
        for begin, known, rows, share in parts:
            for k, (p, w) in enumerate(rows):
                if len(known) and len(p):
                    at = np.minimum(np.searchsorted(known, p), len(known) - 1)
                    hit = known[at] == p
                    at = at[hit] + begin
                    out[k, at] = w[hit] * self.idf[at]
            block = out[:, begin : begin + len(known)]
            block *= np.sqrt(share) / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
        out[np.arange(len(texts)), n + levels] = np.sqrt(SHARES[2])
        return self.unit(out)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    def scores(self, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors; the mean label where nothing is similar."""
        q = self.unit(self.matrix(texts) @ self.project)
        cosine = q @ self.vectors
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(np.float64) ** 2
        total = w.sum(1)
        return np.where(total > 1e-9, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-9), self.labels.mean())


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of about fit_rows hash-drawn labelled rows outside the held-out fold, half of them of either label if there are."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    limit = F.lit(0)
    for q, n in counts.items():
        limit = F.when(F.col("quality") == q, F.lit(int(min(1.0, fit_rows / 2 / n) * (1 << 30)))).otherwise(limit)
    chosen = known.where(draw < limit).select("doc_id", "quality")
    got = docs.where(F.length("text") <= FIT_CHARS).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in got], [r["quality"] for r in got]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    score is the vote for label 1 within 0 and 1, predicted 1 from 0.3 on. Null and empty texts have no
    feature but the lowest level of repetition: they get the vote of what is nearest to that. Without any label score is 0.5. Only text is looked at. Repeated rows are each scored.
    """
    spark = docs.sparkSession
    texts, votes = training_rows(docs, labels)
    sent = spark.sparkContext.broadcast(Model(texts, votes) if texts else None)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for whole in batches:
            for k in range(0, len(whole), BLOCK):
                b = whole.iloc[k : k + BLOCK]
                s = np.clip(model.scores(b["text"].tolist()), 0, 1) if model else np.full(len(b), 0.5)
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "held_out": b["held_out"].to_numpy(), "score": s, "predicted": (s >= LEAST_SCORE).astype(np.int32)})

    # ids travel as strings: pandas turns long columns with a null into doubles
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInPandas(vote, "doc_id string, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
