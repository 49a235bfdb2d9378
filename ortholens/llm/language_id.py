"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams (n = 1, 2, 3) that both have, over the
geometric mean of what each has. Landmark texts span a Nystroem approximation of it; one-versus-rest kernel ridge regression
in that space gives one score per language. A batch of texts is scored by two matrix products: presence times landmarks,
kernel times weights.

Presence is kept over the n-grams that landmarks have; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholens.llm.common import held_out

#: Production parameters: labelled rows per language that are learned from (expected number), of which landmarks; the ridge;
#: rows longer than this many characters are not drawn for learning, so that what reaches the driver is bounded.
FIT_ROWS = 160
LANDMARKS = 40
RIDGE = 1e-2
FIT_CHARS = 20_000

UNKNOWN = "und"
#: Characters outside the learned alphabet share one place.
ALPHABET = 120


def codes(text: str, places: np.ndarray) -> np.ndarray:
    """Place of each character of the lower-cased text; 0 for characters that were not learned."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return places[np.minimum(points, len(places) - 1)]


def ngrams(c: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all 1-, 2- and 3-grams of a coded text, with repeats."""
    s = np.int64(size)
    c = c.astype(np.int64)
    two = c[:-1] * s + c[1:]
    return np.concatenate([c, s + two, s + s * s + two[:-1] * s + c[2:]]) if len(c) > 1 else c


class Model:
    """Trained state: alphabet, vocabulary, landmarks and weights."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(labels))
        seen: dict[str, int] = {}
        for t in texts:
            for ch in set(t.lower()):
                seen[ch] = seen.get(ch, 0) + 1
        letters = sorted(seen, key=lambda ch: (-seen[ch], ch))[: ALPHABET - 1]
        self.places = np.zeros(0x110000 if any(ord(ch) > 0xFFFF for ch in letters) else 0x10001, np.uint8)
        for k, ch in enumerate(letters):
            self.places[ord(ch)] = k + 1
        self.size = len(letters) + 1
        marks, used = [], {}
        for k, lang in enumerate(labels):
            if used.get(lang, 0) < landmarks:
                used[lang] = used.get(lang, 0) + 1
                marks.append(k)
        sets = [np.unique(ngrams(codes(t, self.places), self.size)) for t in texts]
        grams, common = np.unique(np.concatenate([sets[k] for k in marks]), return_counts=True) if marks else (np.zeros(0, np.int64), np.zeros(0))
        grams = grams[common > 1] if (common > 1).any() else grams
        self.column = np.full(self.size + self.size**2 + self.size**3 + 1, -1, np.int32)
        self.column[grams] = np.arange(len(grams))
        self.width = len(grams)
        land = self.presence([texts[k] for k in marks])
        self.land = (land / np.sqrt(np.maximum(land.sum(1, keepdims=True), 1))).T.copy()
        k_mm = self.land.T @ self.land
        value, vector = np.linalg.eigh(k_mm.astype(np.float64))
        keep = value > 1e-6 * max(value.max(initial=0.0), 1e-12)
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = self.kernel(self.presence(texts)).astype(np.float64) @ root
        target = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, 0.0)
        self.shift = phi.mean(0)
        share = target.mean(0)
        centred = phi - self.shift
        w = np.linalg.solve(centred.T @ centred + ridge * len(texts) * np.eye(phi.shape[1]), centred.T @ (target - share))
        self.weights = (root @ w).astype(np.float32)
        self.bias = (share - self.shift @ w).astype(np.float32)

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width + 1), np.float32)
        for k, t in enumerate(texts):
            out[k, self.column[ngrams(codes(t, self.places), self.size)]] = 1.0
        return out[:, : self.width]

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        """Kernel values of rows against all landmarks, by one matrix product."""
        return (presence @ self.land) / np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1))

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(self.presence(texts)) @ self.weights + self.bias


def training_rows(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], list[str]]:
    """Texts and languages: for each language about fit_rows hash-drawn rows whose labels may be learned from.

    Languages are few; their counts decide the share that is drawn of each, so that rare ones are drawn whole.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= FIT_CHARS) & F.col("text").rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30))
    counts = {r["lang"]: r["count"] for r in docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("lang").count().collect()}
    if not counts:
        return [], []
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 1.5 * fit_rows / n) * (1 << 30)))).otherwise(limit)
    got = rows.where(draw < limit).select("lang", "text", draw.alias("draw"), "doc_id").collect()
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["draw"], r["doc_id"], r["text"])):
        if len(by.setdefault(r["lang"], [])) < fit_rows:
            by[r["lang"]].append(r["text"])
    return [t for lang in sorted(by) for t in by[lang]], [lang for lang in sorted(by) for _ in by[lang]]


def identify(docs: DataFrame, model_of: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row.

    lang_pred is `und` with score 0 where text is null or has no letter, or where there is nothing to learn from. score is the
    winner's regression value within 0 and 1. Only text is looked at for a prediction. Repeated rows are each predicted.
    """
    spark = docs.sparkSession
    texts, labels = training_rows(docs if model_of is None else model_of)
    sent = spark.sparkContext.broadcast(Model(texts, labels) if texts else None)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for whole in batches:
            for k in range(0, len(whole), 256):
                b = whole.iloc[k : k + 256]
                lang, score = np.full(len(b), UNKNOWN, object), np.zeros(len(b))
                known = [i for i, t in enumerate(b["text"]) if t and any(map(str.isalpha, t))] if model else []
                if known:
                    s = model.scores([b["text"].iat[i] for i in known])
                    best = s.argmax(1)
                    lang[known] = np.array(model.languages, object)[best]
                    score[known] = np.clip(s[np.arange(len(best)), best], 0, 1)
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "held_out": b["held_out"].to_numpy(), "lang_pred": lang, "score": score})

    # ids travel as strings: pandas turns long columns with a null into doubles
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInPandas(predict, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
