"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every token has a fixed sparse index vector; a token's word vector is the sum of the index vectors of the tokens next to
it, over the whole corpus. Tokens share a fixed number of rows by hash, so the table has one size at any scale; tasks add
up whole numbers, and the sums do not depend on their order. A document is the mean of its tokens' vectors together
with the mean's length, spread and counts. The network is trained on a bounded sample of labelled rows; a part of
the sample that it has not seen sets the temperature of its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_merges import Memo
from .calibration import softmax, temperature
from .rows import fold_texts, held_out, map_texts, text_or_empty

#: Rows of the word table, its width, and the entries of an index vector that are not 0.
ROWS, WIDTH, ENTRIES = 1 << 13, 48, 2
#: Most labelled rows that the network is fitted on, taken by a hash of the id.
FIT_ROWS = 12_000
#: Tokens worked on at a time.
SPAN = 1 << 17


def tokens_of(text: str) -> list[bytes]:
    """Words without space and tab to carriage return."""
    return text.encode().split()


_ROW_OF: Memo | None = None


def rows_of(words: Iterable[bytes]) -> np.ndarray:
    """Table rows of tokens. A token is known by what it is made of: its letters for a word, else its signs and case."""
    global _ROW_OF
    if _ROW_OF is None:
        import xxhash

        def row(word: bytes) -> int:
            core = word.strip(b".,;:")
            shape = bytes({*core}) if core and not core.isalnum() and core.isascii() and not any(c.isalpha() for c in core.decode()) else core
            tail = b"|" + word[-3:] if not word[-1:].isalnum() and word[-1] < 128 else b""
            kind = b"U" if core.isupper() else b"l"
            return xxhash.xxh3_64_intdigest(kind + (tail if len(tail) > 3 else shape.lower())) % ROWS

        _ROW_OF = Memo(row, 150_000)
    return np.array(list(map(_ROW_OF.__getitem__, words)), np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its entries and their signs."""
    rng = np.random.default_rng(20_240_101)
    places = np.argsort(rng.random((ROWS, WIDTH)), axis=1)[:, :ENTRIES]
    return places, rng.choice(np.array([-1, 1]), (ROWS, ENTRIES))


def word_table(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(ROWS x WIDTH sums of neighbours' index vectors, tokens per row) over every whole text; neighbours are the token before and after.

    Each task adds up one table and gives its filled rows; the driver gets ROWS rows at most.
    """

    def work():
        places, signs = index_vectors()
        sums, count = np.zeros(ROWS * WIDTH, np.int64), np.zeros(ROWS, np.int64)

        def add(texts: list[str]) -> None:
            nonlocal sums, count
            for text in texts:
                rows = rows_of(tokens_of(text))
                count += np.bincount(rows, minlength=ROWS) if len(rows) > 256 else 0
                if 0 < len(rows) <= 256:
                    np.add.at(count, rows, 1)
                for start in range(0, len(rows) - 1, SPAN):
                    part = rows[start : start + SPAN + 1]
                    for here, there in ((part[1:], part[:-1]), (part[:-1], part[1:])):
                        for e in range(ENTRIES):
                            np.add.at(sums, here * WIDTH + places[there, e], signs[there, e])

        def finish():
            table, filled = sums.reshape(ROWS, WIDTH), np.flatnonzero(count)
            for start in range(0, len(filled), 1024):
                part = filled[start : start + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(count[part], pa.int64()), *(pa.array(table[part, i], pa.int64()) for i in range(WIDTH))],
                    names=["row", "n", *(f"v{i}" for i in range(WIDTH))],
                )

        return add, finish

    schema = ", ".join(["row int", "n bigint", *(f"v{i} bigint" for i in range(WIDTH))])
    summed = fold_texts(df, [text_or_empty(text_col)], schema, work).groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH)))
    sums, count = np.zeros((ROWS, WIDTH)), np.zeros(ROWS)
    for r in summed.collect():
        sums[r["row"]] = r[2:]
        count[r["row"]] = r["n"]
    return sums, count


@dataclass
class WordVectors:
    """Unit word vectors, each with a weight that falls with the token's share of the corpus."""

    table: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray, count: np.ndarray) -> WordVectors:
        own, _ = np.zeros((ROWS, WIDTH)), None
        places, signs = index_vectors()
        for e in range(ENTRIES):
            own[np.arange(ROWS), places[:, e]] += signs[:, e]
        sums = np.where(count[:, None] > 0, sums / np.maximum(count[:, None], 1), 0.0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        context = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
        weight = 1e-3 / (1e-3 + count / max(count.sum(), 1))
        return cls(((context + own) * weight[:, None]).astype(np.float32))

    def pooled(self, text: str) -> np.ndarray:
        """Mean, length of the mean, spread, and counts of one whole text."""
        rows = rows_of(tokens_of(text))
        n = len(rows)
        total, squares = np.zeros(WIDTH), 0.0
        for start in range(0, n, SPAN):
            part = self.table[rows[start : start + SPAN]]
            total += part.sum(axis=0, dtype=np.float64)
            squares += float(np.einsum("ij,ij->", part, part))
        mean = total / max(n, 1)
        length = float(np.sqrt(mean @ mean))
        same = float(np.count_nonzero(rows[1:] == rows[:-1])) / max(n - 1, 1)
        kinds = len(np.unique(rows)) / max(n, 1)
        return np.concatenate([mean, [length, np.sqrt(max(squares / max(n, 1) - length * length, 0.0)), np.log1p(n), kinds, same, length * np.sqrt(n), kinds * np.sqrt(n)]])


@dataclass
class Network:
    """Standardised inputs, one layer of tanh units, two outputs, a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    heat: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def good(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x) / self.heat)[:, 1]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, decay: float = 1e-4) -> Network:
        """Adam on the cross-entropy; every fifth row sets the temperature alone. Without rows of both labels it gives 0.5, or the one label."""
        rng, n_in = np.random.default_rng(7), x.shape[1]
        net = cls(np.zeros(n_in), np.ones(n_in), np.zeros((n_in, hidden)), np.zeros(hidden), np.zeros((hidden, 2)), np.zeros(2))
        if len(set(y.tolist())) < 2:
            net.b2 = np.array([0.0, 0.0]) if not len(y) else np.array([-2.0, 2.0]) * (1 if y[0] else -1)
            return net
        aside = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        xt, yt = x[~aside], y[~aside]
        net.centre, net.scale = xt.mean(axis=0), xt.std(axis=0) + 1e-6
        net.w1 = rng.normal(0, 1 / np.sqrt(n_in), (n_in, hidden))
        net.w2 = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2))
        names = ("w1", "b1", "w2", "b2")
        first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        z = np.clip((xt - net.centre) / net.scale, -8, 8)
        for epoch in range(epochs):
            order = rng.permutation(len(yt))
            for start in range(0, len(order), 64):
                rows = order[start : start + 64]
                a = np.tanh(z[rows] @ net.w1 + net.b1)
                g = softmax(a @ net.w2 + net.b2)
                g[np.arange(len(rows)), yt[rows]] -= 1
                g /= len(rows)
                back = (g @ net.w2.T) * (1 - a * a)
                slopes = {"w2": a.T @ g + decay * net.w2, "b2": g.sum(axis=0), "w1": z[rows].T @ back + decay * net.w1, "b1": back.sum(axis=0)}
                step += 1
                rate = 0.003 * (1 - epoch / epochs)
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                    second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                    setattr(net, k, getattr(net, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
        net.heat = temperature(net.logits(x[aside]), y[aside])
        return net


@dataclass
class QualityModel:
    vectors: WordVectors
    network: Network


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Word vectors from every text of `df`; the network from at most about `fit_rows` labelled rows that are not held out.

    A label counts if id and label are not null; several labels of one id count as good if at least half are.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("__id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("__good"))
    chosen = marked.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)  # bounded, so it may be broadcast
    vectors = WordVectors.of(*word_table(df, text_col))
    shared = df.sparkSession.sparkContext.broadcast(vectors)  # ROWS x WIDTH numbers

    def work():
        return lambda texts: [pa.array([shared.value.pooled(t).tolist() for t in texts], pa.list_(pa.float64()))]

    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    fitted = map_texts(slim.join(F.broadcast(chosen), "__id"), ["__id", "__good"], "__t", "x array<double>", work)
    rows = sorted((r["__id"], r["__good"], tuple(r["x"])) for r in fitted.orderBy(F.xxhash64("__id"), "x").limit(2 * fit_rows).collect())
    x, y = np.array([r[2] for r in rows], float).reshape(len(rows), WIDTH + 7), np.array([r[1] for r in rows], int)
    shuffled = np.random.default_rng(3).permutation(len(rows))
    return QualityModel(vectors, Network.fit(x[shuffled], y[shuffled]))


def score(df: DataFrame, model: QualityModel, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text; a null or empty text is scored as one without words.

    Ids may be null or repeat; each row is scored by its text alone. Other columns are not read; an empty table gives an
    empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work():
        def scored(texts: list[str]) -> list[pa.Array]:
            p = shared.value.network.good(np.array([shared.value.vectors.pooled(t) for t in texts]).reshape(len(texts), WIDTH + 7))
            return [pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32), pa.int32())]

        return scored

    return map_texts(df, [id_col], text_col, "score double, predicted int", work)
