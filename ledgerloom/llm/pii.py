"""Personal data: base patterns, and terms of the text around them that give a protected entity away.

How much a term t reveals a kind k of entity is its pointwise mutual information with k over the corpus, as a share of
what k itself would tell: log(N n(t,k) / (n(t) n(k))) / log(N / n(k)). It is 1 if t never stands without k. All counts
are of documents: n(t,k) has t within a few words of an entity. A term over the first threshold is generalised, over the
second removed, in documents that hold an entity of that kind and close to it; other documents are left alone.

In the same way a term is judged against each single entity: with n(t,v) and n(v) for the value v of an address, card or number.
A term that gives one value away does so wherever it stands, so it is replaced at every place of the corpus.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .rows import fold_texts, map_texts, text_or_empty

#: The kinds, in the order of every listing.
KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that a failing start isn't tried again within one run of characters.
_EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = "[0-9@]"
_WORD = re.compile(r"[^\W\d_]{2,}")

#: Words on each side of an entity, and characters, within which a term counts as close to it.
NEAR, REACH = 5, 256
#: Shares of an entity's information from which a term is generalised and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Different surroundings of entities that a term must be met in before it counts; copies of one passage count once.
SUPPORT = 10
#: Documents that a term must be met in close to one and the same value; copies count, as one document is no evidence of a tie.
VALUE_SUPPORT = 2
#: Kind of the terms that give a single value away, anywhere in the corpus.
ANYWHERE = "any"
#: Most terms that are broadcast; more are joined by shuffle, with the same result.
BROADCAST_TERMS = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Each @ takes the name before it, back to the match before; then the host must fit."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _EMAIL_NAME.match(text, start - 1):
            start -= 1
        found = _EMAIL_HOST.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _apart(spans: list[tuple[str, int, int]]):
    """Whether a word meets none of the spans."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):  # as stretches apart from each other
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(word: tuple[int, int]) -> bool:
        i = bisect_left(starts, word[1]) - 1
        return i < 0 or ends[i] <= word[0]

    return free


def close_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, list[tuple[int, int]]]]:
    """For each span its kind and the places of the words near it that meet no span. A word that is cut by the reach is left out."""
    free = _apart(spans)
    out = []
    for kind, start, end in spans:
        low, high = max(0, start - REACH), min(len(text), end + REACH)
        left = [w for m in _WORD.finditer(text, low, start) if (w := m.span())[0] > low or low == 0]
        right = [w for m in _WORD.finditer(text, end, high) if (w := m.span())[1] < high or high == len(text)]
        out.append((kind, [w for w in (*left[-NEAR:], *right[:NEAR]) if free(w)]))
    return out


@dataclass(frozen=True)
class Thresholds:
    generalise: float = GENERALISE
    remove: float = REMOVE
    support: int = SUPPORT
    value_support: int = VALUE_SUPPORT


def near_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, kind, docs, surroundings): documents with the lower-cased term close to an entity of the kind, and a hash set size of its surroundings.

    Only texts with a digit or an @ are looked at. A task sums before it passes rows on.
    """

    def work():
        docs: Counter = Counter()

        def flush():
            keys = list(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), pa.array([docs[k] for k in keys], pa.int64())],
                names=["term", "kind", "around", "docs"],
            )

        def add(texts: list[str]) -> None:
            for text in texts:
                spans = base_spans(text)
                met: dict[tuple[str, str], int] = {}
                for kind, words in close_words(text, spans):
                    names = [text[a:b].lower() for a, b in words]
                    around = int.from_bytes(hashlib.blake2b(" ".join(names).encode(), digest_size=8).digest(), "little", signed=True)
                    for name in names:
                        met.setdefault((name, kind), around)
                for (name, kind), around in met.items():
                    docs[name, kind, around] += 1

        return add, flush

    seen = fold_texts(df.where(text_or_empty(text_col).rlike(_HINT)), [text_or_empty(text_col)], "term string, kind string, around bigint, docs bigint", work)
    once = seen.groupBy("term", "kind", "around").agg(F.sum("docs").alias("docs"))
    return once.groupBy("term", "kind").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("surroundings"))


def value_of(kind: str, found: str) -> int:
    """A hash of the entity as it is compared: addresses in lower case, numbers without their signs."""
    plain = found.lower() if kind == "email" else found if kind == "ip" else _digits(found)
    return int.from_bytes(hashlib.blake2b(f"{kind} {plain}".encode(), digest_size=8).digest(), "little", signed=True)


def value_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, value, docs): documents with the lower-cased term close to the entity of that hash; with a null term all documents with the entity."""

    def run(batches):
        for batch in batches:
            docs: Counter = Counter()
            for text in batch.column(0).to_pylist():
                spans, met = base_spans(text), set()
                for (kind, start, end), (_, words) in zip(spans, close_words(text, spans)):
                    value = value_of(kind, text[start:end])
                    met.update([(None, value)], ((text[a:b].lower(), value) for a, b in words))
                docs.update(met)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in docs], pa.string()), pa.array([k[1] for k in docs], pa.int64()), pa.array(docs.values(), pa.int64())], names=["term", "value", "docs"],
            )

    slim = df.where(text_or_empty(text_col).rlike(_HINT)).select(text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "term string, value bigint, docs bigint").groupBy("term", "value").agg(F.sum("docs").alias("docs"))


def kind_counts(df: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Documents with each kind of entity."""

    def work():
        docs: Counter = Counter()

        def add(texts: list[str]) -> None:
            for text in texts:
                docs.update({k for k, _, _ in base_spans(text)})

        return add, lambda: [pa.RecordBatch.from_arrays([pa.array(KINDS, pa.string()), pa.array([docs[k] for k in KINDS], pa.int64())], names=["kind", "docs"])]

    seen = fold_texts(df.where(text_or_empty(text_col).rlike(_HINT)), [text_or_empty(text_col)], "kind string, docs bigint", work)
    return {r["kind"]: r["n"] for r in seen.groupBy("kind").agg(F.sum("docs").alias("n")).collect()}


def term_counts(df: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): documents of the corpus with each of `terms` (term). A short list goes to the tasks, a long one is joined."""
    if terms.count() <= BROADCAST_TERMS:
        wanted = df.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()))

        def work():
            docs: Counter = Counter()

            def add(texts: list[str]) -> None:
                for text in texts:
                    docs.update(wanted.value.intersection(map(str.lower, _WORD.findall(text))))

            return add, lambda: [pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(docs.values(), pa.int64())], names=["term", "docs"])]

        seen = fold_texts(df, [text_or_empty(text_col)], "term string, docs bigint", work)
        return seen.groupBy("term").agg(F.sum("docs").alias("n"))

    def every():
        docs: Counter = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(docs.values(), pa.int64())], names=["term", "docs"])

        def add(texts: list[str]) -> None:
            for text in texts:
                docs.update(set(map(str.lower, _WORD.findall(text))))

        return add, lambda: [batch()]

    seen = fold_texts(df, [text_or_empty(text_col)], "term string, docs bigint", every)
    return seen.groupBy("term").agg(F.sum("docs").alias("n")).join(terms, "term", "left_semi")


def revealing_terms(df: DataFrame, limits: Thresholds = Thresholds(), text_col: str = "text") -> DataFrame:
    """(term, kind, disclosure) of the terms at or over the first threshold, from every whole text of `df`; kind ANYWHERE if a single value is given away."""
    near = materialise(near_counts(df, text_col).where(F.col("surroundings") >= limits.support))
    values = materialise(value_counts(df, text_col).where(F.col("term").isNull() | (F.col("docs") >= limits.value_support)))
    total, kinds = float(df.count()), kind_counts(df, text_col)
    by_value = values.where("term IS NOT NULL").join(values.where("term IS NULL").select("value", F.col("docs").cast("double").alias("n_of")), "value")
    by_kind = near.withColumn("n_of", F.create_map(*(x for k in KINDS for x in (F.lit(k), F.lit(float(kinds.get(k, 0) or 0)))))[F.col("kind")])
    every = by_kind.select("term", "kind", "docs", "n_of").union(by_value.select("term", F.lit(ANYWHERE), "docs", "n_of"))
    totals = term_counts(df, materialise(every.select("term").distinct()), text_col)
    told = F.try_divide(F.log(F.try_divide(F.lit(total) * F.col("docs"), F.col("n") * F.col("n_of"))), F.log(F.try_divide(F.lit(total), F.col("n_of"))))
    found = every.join(totals, "term").withColumn("disclosure", told).where(F.col("disclosure") >= limits.generalise)
    return found.groupBy("term", "kind").agg(F.max("disclosure").alias("disclosure"))


def told_of(rows) -> tuple[dict[tuple[str, str], float], dict[str, float]]:
    """Disclosures of (term, kind), and of the terms that count anywhere."""
    near = {(r["term"], r["kind"]): r["disclosure"] for r in rows if r["kind"] != ANYWHERE}
    return near, {r["term"]: r["disclosure"] for r in rows if r["kind"] == ANYWHERE}


def term_spans(text: str, spans: list[tuple[str, int, int]], told: tuple[dict[tuple[str, str], float], dict[str, float]]) -> list[tuple[int, int, float]]:
    """(start, end, disclosure) of the revealing terms close to the spans, or anywhere outside them, by start, each place once."""
    near, anywhere = told
    found: dict[tuple[int, int], float] = {}
    for kind, words in close_words(text, spans) if near and spans else ():
        for a, b in words:
            if (share := near.get((text[a:b].lower(), kind))) is not None:
                found[a, b] = max(share, found.get((a, b), 0.0))
    if anywhere and not anywhere.keys().isdisjoint(map(str.lower, _WORD.findall(text))):
        free = _apart(spans)
        for m in _WORD.finditer(text):
            if (share := anywhere.get(m[0].lower())) is not None and free(m.span()):
                found[m.span()] = max(share, found.get(m.span(), 0.0))
    return [(a, b, share) for (a, b), share in sorted(found.items())]


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def generalised(term: str) -> str:
    """What is left of a term over the first threshold: that there was a name or a word."""
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitised(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int, float]], remove: float) -> str:
    """The text with entities replaced by their kinds and terms generalised or removed. Of spans that overlap, the earliest, then longest, names the whole stretch."""
    marks = [(a, -b, f"[{k.upper()}]") for k, a, b in spans] + [(a, -b, "" if share >= remove else generalised(text[a:b])) for a, b, share in terms]
    out, at = [], 0
    for a, minus_b, name in sorted(marks):
        if a >= at:
            out += [text[at:a], name]
        at = max(at, -minus_b)
    return "".join([*out, text[at:]])


def _told(df: DataFrame, terms: DataFrame):
    """The terms as a broadcast table, or None where there are more than a broadcast may hold."""
    if terms.count() > BROADCAST_TERMS:
        return None
    return df.sparkSession.sparkContext.broadcast(told_of(terms.collect()))


def _with_terms(df: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """`df` with the column __told: an array of (term, kind, disclosure) that a text needs, found by a join on its words and those near its entities."""

    def run(batches):
        for batch in batches:
            keys, names, kinds = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                near = {(text[a:b].lower(), k) for k, words in close_words(text, base_spans(text)) for a, b in words}
                for name, kind in near | {(w.lower(), ANYWHERE) for w in _WORD.findall(text)}:
                    keys.append(key)
                    names.append(name)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(kinds, pa.string())], names=["__key", "term", "kind"])

    keyed = df.withColumn("__key", F.sha2(text_or_empty(text_col), 256))
    once = keyed.select("__key", text_or_empty(text_col).alias("t")).dropDuplicates(["__key"])
    near = once.mapInArrow(run, "__key string, term string, kind string").join(terms, ["term", "kind"])
    told = near.groupBy("__key").agg(F.collect_list(F.struct("term", "kind", "disclosure")).alias("__told"))  # at most what one text holds
    return keyed.join(told, "__key", "left").drop("__key")


def find(df: DataFrame, terms: DataFrame | None = None, limits: Thresholds = Thresholds(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_term, base_spans, spans, sanitised) of every whole text.

    `spans` lists kind:start:end by kind, terms last, then start, joined by commas; `base_spans` has no terms. `terms` are
    those of `revealing_terms`, worked out from `df` by default. Null and empty texts give 0, '' and ''. Ids may be null or
    repeat; an empty table gives an empty result; other columns are not read.
    """
    terms = materialise(revealing_terms(df, limits, text_col) if terms is None else terms)
    shared = _told(df, terms)
    schema = ", ".join([*(f"n_{k} bigint" for k in (*KINDS, "term")), "base_spans string, spans string, sanitised string"])
    if shared is None:
        return _find_joined(df, terms, limits, id_col, text_col, schema)

    def work():
        return lambda texts: _columns(texts, [shared.value] * len(texts), limits)

    return map_texts(df, [id_col], text_col, schema, work)


def _columns(texts: list[str], told: list[tuple[dict, dict]], limits: Thresholds) -> list[pa.Array]:
    counts, base, every, clean = [[] for _ in range(5)], [], [], []
    for text, known in zip(texts, told):
        spans = base_spans(text)
        terms = term_spans(text, spans, known)
        kinds = Counter(k for k, _, _ in spans)
        for column, n in zip(counts, (*(kinds[k] for k in KINDS), len(terms))):
            column.append(n)
        base.append(listed(spans))
        every.append(listed([*spans, *(("term", a, b) for a, b, _ in terms)]))
        clean.append(sanitised(text, spans, terms, limits.remove) if spans or terms else text)
    return [*(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (base, every, clean))]


def _find_joined(df: DataFrame, terms: DataFrame, limits: Thresholds, id_col: str, text_col: str, schema: str) -> DataFrame:
    slim = df.select(F.col(f"`{id_col}`"), text_or_empty(text_col).alias("__t"))
    kind = df.schema[id_col].dataType.simpleString()
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            told = [told_of(x or ()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(batch.column(1).to_pylist(), told, limits)], names=[id_col, *names])

    return _with_terms(slim, terms, "__t").select(f"`{id_col}`", "__t", "__told").mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def sanitise(df: DataFrame, limits: Thresholds = Thresholds(), text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """`df`, all columns as they are, with entities and revealing terms of the text replaced; null texts stay null, texts without either as they are.

    `length_col`, if given, becomes the new text's length where the text has changed.
    """
    terms = materialise(revealing_terms(df, limits, text_col))
    shared, columns = _told(df, terms), df.columns
    source = df if shared is not None else _with_terms(df, terms, text_col)
    at, told_at = columns.index(text_col), len(columns)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            told = [shared.value] * len(texts) if shared is not None else [told_of(x or ()) for x in batch.column(told_at).to_pylist()]
            made, lengths = [], batch.column(columns.index(length_col)).to_pylist() if length_col else []
            for i, (text, known) in enumerate(zip(texts, told)):
                spans = base_spans(text) if text else []
                terms = term_spans(text, spans, known) if text else []
                if spans or terms:
                    text = sanitised(text, spans, terms, limits.remove)
                    if length_col:
                        lengths[i] = len(text)
                made.append(text)
            arrays = list(batch.columns[: len(columns)])
            arrays[at] = pa.array(made, arrays[at].type)
            if length_col:
                arrays[columns.index(length_col)] = pa.array(lengths, arrays[columns.index(length_col)].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return source.mapInArrow(run, df.schema)
