"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text fall into a fixed number of features by hash. Inverse document
frequencies come from every learnable text; weights from a bounded sample for each language, by follow-the-regularised-
leader with elastic-net penalties, which leaves most weights at nought. Rows that the fit has not seen set the
temperature of the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import softmax, temperature
from .rows import fold_texts, held_out, map_texts, text_or_empty

FEATURES = 1 << 14
#: About how many rows of each language the weights are fitted on, taken by a hash of the id.
FIT_ROWS_PER_LANGUAGE = 1_000
#: Characters worked on at a time; n-grams that cross the cut are counted with the part that they begin in.
SPAN = 1 << 18
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, how often) of a whole text; runs of white space count as one space."""
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(FEATURES, np.int64)
    for start in range(0, len(codes), SPAN):
        key = np.zeros(min(SPAN, len(codes) - start), np.uint64)
        for n in range(3):
            tail = codes[start + n : start + n + SPAN]
            key = (key[: len(tail)] * np.uint64(0x100000001B3)) ^ (tail + np.uint64(1))
            counts += np.bincount(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64), minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = gram_counts(text)
    value = np.log1p(n) * idf[found]
    return found, value / max(float(np.sqrt(value @ value)), 1e-12)


@dataclass
class Leader:
    """Per-coordinate FTRL: sums of gradients and of their squares give each weight in closed form."""

    classes: int
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    def __post_init__(self):
        self.z = np.zeros((FEATURES + 1, self.classes))
        self.n = np.zeros((FEATURES + 1, self.classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, FEATURES), np.append(value, 1.0)  # the last row is the constant
        w = self.weights(at)
        slope = softmax(value @ w)
        slope[label] -= 1
        g = value[:, None] * slope
        before = self.n[at]
        after = before + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
        self.n[at] = after


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.weights[FEATURES]

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*tf_idf(text, self.idf)) / self.heat)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def inverse_frequencies(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """log((1 + rows) / (1 + rows with the feature)) + 1 over every whole text; the driver gets a row a feature."""

    def work():
        counts, rows = np.zeros(FEATURES, np.int64), 0

        def add(texts: list[str]) -> None:
            nonlocal rows
            for text in texts:
                counts[gram_counts(text)[0]] += 1
            rows += len(texts)

        def finish():
            found = np.flatnonzero(counts)
            features, n = np.append(found, FEATURES), np.append(counts[found], rows)
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.int32()), pa.array(n, pa.int64())], names=["feature", "n"])

        return add, finish

    counts = np.zeros(FEATURES + 1)
    for r in fold_texts(df, [text_or_empty(text_col)], "feature int, n bigint", work).groupBy("feature").agg(F.sum("n").alias("n")).collect():
        counts[r["feature"]] = r["n"]
    return np.log((1 + counts[FEATURES]) / (1 + counts[:FEATURES])) + 1


def fit(
    df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows_per_language: int = FIT_ROWS_PER_LANGUAGE, epochs: int = 3,
) -> LanguageModel:
    """From text and language of rows that are not held out and whose language is not null. Texts without a letter are not learned from.

    A language with more rows than `rows_per_language` gives about that many; one with fewer gives all. The driver holds the
    sample's n-gram counts: the number of languages times that bound.
    """
    known = df.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)
    idf = inverse_frequencies(known, "text")
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, rows_per_language / sizes[lang])))))
    point = F.pmod(F.xxhash64("id", F.substring(F.coalesce("text", F.lit("")), 1, 256)), F.lit(1 << 30)) / (1 << 30)

    def work():
        def counted(texts: list[str]) -> list[pa.Array]:
            made = [gram_counts(t) if has_letter(t) else (np.empty(0, np.int64),) * 2 for t in texts]
            return [pa.array([m[i].astype(np.int32) for m in made], pa.list_(pa.int32())) for i in (0, 1)]

        return counted

    sample = map_texts(known.where(point < share[F.col("lang")]), ["id", "lang"], "text", "features array<int>, counts array<int>", work)
    rows = sample.toArrow()
    number = {lang: i for i, lang in enumerate(languages)}
    seen = []
    for lang, features, n in zip(rows.column("lang").to_pylist(), rows.column("features"), rows.column("counts")):
        at = features.values.to_numpy(zero_copy_only=False)
        if len(at):
            value = np.log1p(n.values.to_numpy(zero_copy_only=False)) * idf[at]
            seen.append((number[lang], at.astype(np.int64), value / max(float(np.sqrt(value @ value)), 1e-12)))
    seen.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))  # whatever order the rows came in
    order = np.random.default_rng(11).permutation(len(seen))
    aside = order[: len(seen) // 5] if len(seen) >= 50 else order[:0]
    leader = Leader(len(languages))
    for _ in range(epochs):
        for i in order[len(aside) :]:
            label, at, value = seen[i]
            leader.learn(at, value, label)
    model = LanguageModel(languages, idf, leader.weights(slice(None)), 1.0)
    logits = np.array([model.logits(at, value) for _, at, value in (seen[i] for i in aside)]).reshape(len(aside), len(languages))
    model.heat = temperature(logits, np.array([seen[i][0] for i in aside], int))
    return model


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; `und` with score 0 for a null text, one without letters, or an unfitted model.

    Ids may be null or repeat; only the text counts. Other columns are not read; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers

    def work():
        def named(texts: list[str]) -> list[pa.Array]:
            made = [shared.value.predict(t) for t in texts]
            return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]

        return named

    return map_texts(df, [id_col], text_col, "lang_pred string, score double", work)
