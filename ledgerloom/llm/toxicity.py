"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns words into symbols (insult, threat, target, negation, reporting verb, ...) with weights; stems of words act as
its prefix arcs. Two rewriting transducers follow: negation marks what stands in its scope, reported speech marks what somebody else is
quoted with. A clause acceptor reads the rewritten tape and emits the kind of each clause: how many insults, a threat, a target, or only
negated or reported ones. The four are composed and determinised state by state as texts need them. A logistic regression on the
clauses of a text, their weights and their density gives the score, so one word counts by the clause it stands in.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .rows import fold_texts, map_texts, text_or_empty

#: Most labelled rows that the lexicon and the regression are fitted on.
FIT_ROWS = 20_000
#: Most learned words and stems.
LEXICON = 4_000
#: A learned entry stands in so many toxic texts, in so many different surroundings, and is so many times likelier (as a logarithm) in them.
SUPPORT, SURROUNDINGS, LIFT = 8, 8, 3.0
#: Lengths of the stems that words are also counted under.
STEMS = (4, 5, 6)
#: Counters and caches of a task are flushed at so many entries.
FLUSH = 200_000

# Symbols of the tape.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MODAL, QUOTE, COMMA, END, LINE = range(11)
NEGATED, REPORTED = 20, 40

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:,\n\"“”«»]")
WORDS = {
    INSULT: "idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic worthless useless disgusting clown clowns imbecile jerk creep coward filth vermin pig rat",
    THREAT: "kill hurt destroy beat crush smash burn stab shoot strangle murder punch hunt bury",
    TARGET: "you your you're u he she they them him her his their this that these those everyone nobody people",
    NEGATION: "not no never nor neither without hardly cannot nicht kein keine nie no nunca ni pas jamais sans",
    REPORT: "said says say told called calls wrote writes claimed claims quoted quote according reported shouted sagte dijo dit",
    MODAL: "will gonna shall going i'll we'll must should want",
}
SIGNS = {'"': QUOTE, "“": QUOTE, "”": QUOTE, "«": QUOTE, "»": QUOTE, ",": COMMA, "\n": LINE} | {c: END for c in ".!?;:"}
SEEDS = {word: symbol for symbol, words in reversed(WORDS.items()) for word in words.split()} | SIGNS

KINDS = [f"{n} insults{' threat' * t}{' target' * y}" for n in range(3) for t in range(2) for y in range(2)] + ["reported", "negated"]
FEATURES = len(KINDS) + 3


def negation(state: int, symbol: int) -> tuple[int, int]:
    """Scope of four words after a negation, up to the comma or the clause's end."""
    if symbol == NEGATION:
        return 4, OTHER
    if symbol in (COMMA, END, LINE):
        return 0, symbol
    return max(state - 1, 0), symbol + NEGATED if state and symbol in (INSULT, THREAT) else symbol


def reported(state: int, symbol: int) -> tuple[int, int]:
    """0: own words, 1: after a reporting verb until the clause ends, 2: between quotation marks, at most to the line's end."""
    if symbol == QUOTE:
        return 0 if state == 2 else 2, OTHER
    if symbol == REPORT:
        return max(state, 1), OTHER
    if symbol == LINE or (symbol == END and state == 1):
        return 0, symbol
    return state, symbol + REPORTED if state and symbol in (INSULT, THREAT) else symbol


START = (0, 0, 0, 0, 0, 0)


def clause(state: tuple, symbol: int) -> tuple[tuple, int]:
    """State: insults (two at most), threat, target, words since a modal verb, reported, negated. Gives 0, 1 (add the word's weight) or 2 + kind."""
    insults, threat, target, armed, told, denied = state
    if symbol in (END, LINE):
        if insults or threat:
            return START, 2 + insults * 4 + threat * 2 + target
        return START, 2 + 12 if told else 2 + 13 if denied else 0
    if symbol == INSULT:
        return (min(insults + 1, 2), threat, target, max(armed - 1, 0), told, denied), 1
    if symbol == THREAT:
        return (insults, threat or int(armed > 0), target, 0, told, denied), 1 if armed else 0
    if symbol >= NEGATED:
        return (insults, threat, target, max(armed - 1, 0), told or int(symbol >= REPORTED), denied or int(symbol < REPORTED)), 0
    return (insults, threat, int(target or symbol == TARGET), 4 if symbol == MODAL else max(armed - 1, 0), told, denied), 0


class Composition:
    """negation o reported o clause, determinised lazily: at most 5 x 3 x 240 states."""

    def __init__(self) -> None:
        self.states: list[tuple] = [(0, 0, START)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.arcs: dict[tuple[int, int], tuple[int, int]] = {}

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            n, r, c = self.states[state]
            n, tape = negation(n, symbol)
            r, tape = reported(r, tape)
            c, out = clause(c, tape)
            to = self.number.setdefault((n, r, c), len(self.states))
            if to == len(self.states):
                self.states.append((n, r, c))
            arc = self.arcs[state, symbol] = (to, out)
        return arc


class Lexical(dict):
    """Word -> symbol. Unknown words are looked up by their stems once and kept, in bounds."""

    def __init__(self, learned: dict[str, float]) -> None:
        super().__init__(SEEDS)
        self.learned, self.weights = learned, {w: max(1.0, learned.get(w, 1.0)) for w, s in SEEDS.items() if s in (INSULT, THREAT)}

    def __missing__(self, word: str) -> int:
        if len(self) > FLUSH:
            self.clear()
            self.update(SEEDS)
            self.weights = {w: x for w, x in self.weights.items() if w in SEEDS}
        symbol = NEGATION if word.endswith(("n't", "n’t")) else OTHER
        weight = max((self.learned.get(f, 0.0) for f in entries(word)), default=0.0)
        if weight and symbol == OTHER:
            symbol, self.weights[word] = INSULT, weight
        self[word] = symbol
        return symbol


def entries(word: str) -> Iterator[str]:
    """The lexicon entries a word falls under: itself and its stems."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


@dataclass
class Model:
    learned: dict[str, float]
    centre: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.centre) / self.scale) @ self.slopes + self.bias, -30, 30)))


class Grammar:
    """The composed transducer over a lexicon; one per task."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.lexical, self.composed = Lexical(learned), Composition()

    def clauses(self, text: str) -> tuple[list[tuple[int, int, int, float]], int]:
        """((start, end, kind, weight) of each clause that matches, words of the text); places are code points of the lower-cased text."""
        low = text.lower()
        words = TOKEN.findall(low)
        symbols = [self.lexical[w] for w in words]
        n = sum(1 for s in symbols if s < QUOTE)
        seen = set(symbols)
        if INSULT not in seen and THREAT not in seen:
            return [], n
        found, state, weight, start, step = [], 0, 0.0, None, self.composed.step
        for symbol, match in zip([*symbols, LINE], [*TOKEN.finditer(low), None], strict=True):
            state, out = step(state, symbol)
            if start is None and symbol < QUOTE:
                start = match.start()
            if out == 1:
                weight += self.lexical.weights.get(match.group(), 1.0)
            elif out > 1:
                found.append((start or 0, match.start() if match else len(low), out - 2, weight))
            if symbol in (END, LINE):
                weight, start = 0.0, None
        return found, n

    def features(self, text: str) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
        found, n = self.clauses(text)
        x = np.zeros(FEATURES)
        for _, _, kind, weight in found:
            x[kind] += 1
            if kind < 12:
                x[-3] += weight
                x[-2] = max(x[-2], weight)
        x[-1] = 100 * x[:12].sum() / max(n, 1)
        x[: len(KINDS) + 1] = np.log1p(x[: len(KINDS) + 1])
        x[-1] = np.log1p(x[-1])
        return x, found


def entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, toxic, clean, surroundings): labelled texts that hold a word or stem, and neighbours it has in toxic ones.

    `sample` has `__y, __t`. Counters of a task are flushed in bounds; partial counts and sketches are merged by Spark.
    """

    def work():
        counts: dict[tuple[str, int | None], list[int]] = defaultdict(lambda: [0, 0])
        ready: list[pa.RecordBatch] = []

        def flush() -> None:
            keys = list(counts)
            ready.append(pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.string()), pa.array([counts[k][1] for k in keys], pa.int64()),
                pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
            ], names=["entry", "toxic", "clean", "near"]))
            counts.clear()

        def add(labels: list[int], texts: list[str]) -> None:
            for y, text in zip(labels, texts, strict=True):
                words = [w for w in TOKEN.findall(text.lower()) if w not in SIGNS]
                seen: set[str] = set()
                for i, word in enumerate(words):
                    if word in seen:
                        continue
                    seen.add(word)
                    near = zlib.crc32(f"{words[i - 1] if i else ""} {words[i + 1] if i + 1 < len(words) else ""}".encode()) if y else None
                    for entry in entries(word):
                        if entry == word or entry not in seen:
                            seen.add(entry)
                            counts[entry, near][y] += 1
                if len(counts) >= FLUSH:
                    flush()

        def finish():
            flush()
            yield from ready

        return add, finish

    partial = fold_texts(sample, [F.col("__y"), text_or_empty("__t")], "entry string, toxic bigint, clean bigint, near bigint", work)
    return partial.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.approx_count_distinct("near").alias("surroundings"))


def logistic(x: np.ndarray, y: np.ndarray, learned: dict[str, float], ridge: float = 2.0) -> Model:
    """Newton's method on the penalised likelihood. Without rows of both labels it gives 0.5, or the one label."""
    if len(set(y.tolist())) < 2:
        return Model(learned, bias=0.0 if not len(y) else 4.0 if y[0] else -4.0)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.05)
    z = np.hstack([(x - centre) / scale, np.ones((len(y), 1))])
    w, keep = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Model(learned, centre, scale, w[:-1], float(w[-1]))


def fit(
    df: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS,
) -> Model:
    """Lexicon and regression from at most about `fit_rows` labelled rows; `held_out` (a condition on the id) keeps rows away.

    A label counts if id and label are not null; several labels of one id count as toxic if at least half are.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out)
    marked = marked.groupBy(F.col(id_col).alias("__id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("__y"))
    chosen = marked.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)  # bounded, so it may be broadcast
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(chosen), "__id")
    rows = texts.count()
    if rows > 2 * fit_rows:  # an id with very many rows: the sample stays bounded
        texts = texts.where(F.rand(7) < 2 * fit_rows / rows)
    sample = materialise(texts)
    total = {r["__y"]: r["count"] for r in sample.groupBy("__y").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    lift = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    likely = entry_counts(sample).withColumn("lift", lift).where((F.col("toxic") >= SUPPORT) & (F.col("surroundings") >= SURROUNDINGS) & (F.col("lift") >= LIFT))
    learned = {r["entry"]: float(r["lift"]) for r in likely.orderBy(F.desc("toxic"), F.desc("lift"), "entry").limit(LEXICON).collect()}
    shared = df.sparkSession.sparkContext.broadcast(learned)  # at most LEXICON entries

    def work():
        grammar = Grammar(shared.value)
        return lambda ts: [pa.array([grammar.features(t)[0].tolist() for t in ts], pa.list_(pa.float64()))]

    rows = sorted((tuple(r["x"]), r["__y"]) for r in map_texts(sample, ["__y"], "__t", "x array<double>", work).collect())
    return logistic(np.array([r[0] for r in rows], float).reshape(len(rows), FEATURES), np.array([r[1] for r in rows], int), learned)


def score(df: DataFrame, model: Model, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, clauses) of every whole text; `clauses` are the matched ones with place, kind and weight.

    A null or empty text has no clause and is scored as such. Ids may be null or repeat; each row is scored by its text alone.
    Other columns are not read; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())])

    def work():
        grammar = Grammar(shared.value.learned)

        def scored(texts: list[str]) -> list[pa.Array]:
            made = [grammar.features(t) for t in texts]
            p = shared.value.probability(np.array([x for x, _ in made]).reshape(len(texts), FEATURES))
            found = [[{"start": a, "end": b, "kind": KINDS[k], "weight": w} for a, b, k, w in f] for _, f in made]
            return [pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32), pa.int32()), pa.array(found, pa.list_(item))]

        return scored

    return map_texts(df, [id_col], text_col, "score double, predicted int, clauses array<struct<start:int,end:int,kind:string,weight:double>>", work)
