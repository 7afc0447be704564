"""Quality rules as a short-circuit cascade.

Each rule rejects a document by measures of its text. On a sample, a task times every rule alone and counts what it
rejects; the rules then run in order of rejections per second, and a document is through with its first rejection.
The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import fold_texts, map_texts, text_or_empty

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window in the repetition measure.
WINDOW = 5


class Measures:
    """What rules may ask of a text; each is worked out when first asked. Words are runs without space and tab to carriage return."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_upper_words(self) -> int:
        """Words with a letter A-Z and none of a-z."""
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def n_echo_words(self) -> int:
        """Words equal to the word before."""
        return sum(a == b for a, b in zip(self.words, self.words[1:]))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows that are found twice or more in the text, the first included; exact, by numbering windows."""
        import numpy as np

        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, self.n_words)
        if len(number) == self.n_words:
            return 0

        def joined(left, right):
            return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]

        two = joined(ids[:-1], ids[1:])
        four = joined(two[:-2], two[2:])
        _, window, found = np.unique(four[:-1] * (int(ids.max()) + 1) + ids[4:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(found[window] > 1)
        edges = np.zeros(self.n_words + 1, np.int64)
        edges[again] += 1
        edges[again + WINDOW] -= 1
        return int(np.count_nonzero(np.cumsum(edges)))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: The two base rules, then the method's own.
RULES = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("shouting", lambda m: 10 * m.n_upper_words > 3 * m.n_words),
    Rule("echoes", lambda m: 10 * m.n_echo_words > 3 * m.n_words),
    Rule("word_length", lambda m: not 3 * m.n_words <= m.word_chars <= 10 * m.n_words),
)


def ordered(df: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The rules by rejections per second, best first, from about `sample_rows` rows chosen by a hash of id and text.

    Each task of the sample returns a row for each rule, so the driver gets one row a rule. An empty sample keeps the given order.
    """
    every = max(1, df.count() // sample_rows)
    hashed = F.xxhash64(F.col(f"`{id_col}`"), F.substring(text_or_empty(text_col), 1, 64))

    def work():
        cost, hits = [0.0] * len(rules), [0] * len(rules)

        def add(texts: list[str]) -> None:
            for text in texts:
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    hits[i] += rule.rejects(Measures(text))
                    cost[i] += time.perf_counter() - began

        return add, lambda: [pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(cost), pa.array(hits, pa.int64())], names=["rule", "cost", "hits"])]

    seen = fold_texts(df.where(F.pmod(hashed, F.lit(every)) == 0), [text_or_empty(text_col)], "rule int, cost double, hits bigint", work)
    found = seen.groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits")).collect()
    rate = {r["rule"]: r["hits"] / max(r["cost"], 1e-9) for r in found}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rate.get(i, 0.0), i))]


def judge(
    df: DataFrame, rules: Sequence[Rule] | None = None, measures: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, the named measures, kept, rejected_by) of every whole text; `rules` in the order to run, by default `ordered(df)`.

    `rejected_by` is the first rule of that order that rejects, null where kept. Measures named are worked out for every
    row, others only as far as the cascade needs them. A null or empty text has no words, so `few_words` rejects it. Ids may
    be null or repeat; each row is judged by itself. An empty table gives an empty result; other columns are not read.
    """
    rules = list(ordered(df, id_col=id_col, text_col=text_col) if rules is None else rules)

    def work():
        def verdicts(texts: list[str]) -> list[pa.Array]:
            by, values = [], [[] for _ in measures]
            for text in texts:
                m = Measures(text)
                by.append(next((r.name for r in rules if r.rejects(m)), None))
                for column, name in zip(values, measures):
                    column.append(getattr(m, name))
            return [*(pa.array(v, pa.int64()) for v in values), pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string())]

        return verdicts

    schema = ", ".join([*(f"{m} bigint" for m in measures), "kept boolean", "rejected_by string"])
    return map_texts(df, [id_col], text_col, schema, work)


def keep_good(df: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns and types as they are, that no rule rejects; judged in place, without a join."""
    rules = list(ordered(df, id_col=id_col, text_col=text_col) if rules is None else rules)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            good = []
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(at).slice(start, 256).to_pylist():
                    m = Measures(text or "")
                    good.append(not any(r.rejects(m) for r in rules))
            yield batch.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(run, df.schema)
