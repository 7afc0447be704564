"""N-gram Jaccard join by PartEnum signatures.

Sets of similar size share a band; the band of the smaller of two linked sets fixes how many elements they can differ in (k). The
feature domain is cut into n1 first-level partitions of n2 parts each. If two sets differ in at most k elements, some
first-level partition has at most `differ` differences, so n2 - differ of its parts agree; the set's projections on
all subsets of n2 - differ parts are its signatures, and one is shared.

 1. every text becomes a set of shingle hashes; equal sets become one class
 2. classes that share a signature form a group; groups with the same members count once
 3. in a group, parity sketches give a lower bound of the distance of two sets, which refuses almost all pairs that are
    not linked without losing one; a pair that passes is verified on the whole sets
 4. first a nearest neighbour for each member is verified; then, in groups that still hold several components, those members
    that a sketch lets meet another component bring their whole sets, and only edges that join components leave the group
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialise
from .components import connected_components
from .rows import CHUNK, drop_finished, text_or_empty, type_of

#: Members compared in one place; a larger group is dealt out as pairs of blocks of half as many.
BLOCK = 2048
#: How many times more bits a fine sketch has.
FINE = 4
#: Elements of whole sets in one block; a group with more is dealt out likewise.
ELEMENTS = 4_000_000
#: Most rows of a broadcast list of ids; a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Texts that are looked through for frequent shingles, texts of them that a frequent one is in, and the most of these kept.
SAMPLE, FREQUENT, COMMON = 5_000, 8, 50_000
TAG_SHIFT = 56
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; A-Z lower-cased, words are runs without space and tab to carriage return."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return np.empty(0, _U)
    ids = np.array(list(map(xxhash.xxh3_64_intdigest, found)), _U)
    if len(found) < words:  # the whole sequence as one
        return np.array([xxhash.xxh3_64_intdigest(ids.tobytes(), seed=len(found))], _U)
    n = len(ids) - words + 1
    made = ids[:n].copy()
    for i in range(1, words):
        made *= _U(0x9E3779B97F4A7C15)
        made += ids[i : i + n]
    made = mix(made)
    made.sort()
    return made[np.r_[True, made[1:] != made[:-1]]]


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def set_id(digest_bytes: bytes) -> int:
    return int.from_bytes(digest_bytes[:8], "little", signed=True)


@dataclass(frozen=True)
class PartEnum:
    """Bands and signatures for a threshold in whole per cent."""

    percent: int = 85
    parts: int = 3
    differ: int = 1
    thin: int = 2

    def __post_init__(self):
        if not 0 < self.percent <= 100 or not 0 < self.differ < self.parts:
            raise ValueError("percent is 1 to 100, differ 1 to parts - 1")

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def distance(self, sizes: int) -> int:
        """Most differing elements of two linked sets whose sizes sum to `sizes`."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    @lru_cache(maxsize=None)  # noqa: B019
    def tops(self) -> list[int]:
        """Largest size of each band. A set links at most into its own band and the two beside it."""
        tops = [1]
        while tops[-1] < 1 << 31 and len(tops) < 254:
            low = tops[-1] + 1
            tops.append(max(low, low * 100 // self.percent, low * 112 // 100))
        return tops

    def bands(self, size: int) -> list[int]:
        """Bands that the smaller of two linked sets can lie in: the set's own, and the one below if a partner can be there.

        None where only equal sets can link.
        """
        tops = self.tops()
        own = bisect_left(tops, size)
        both = [own, own - 1] if own and self.percent * size <= 100 * tops[own - 1] else [own]
        return [t for t in both if self.differences(t)]

    def differences(self, band: int) -> int:
        """Most differing elements (k) of two linked sets, the smaller of which lies in the band."""
        top = self.tops()[band]
        return self.distance(top + 100 * top // self.percent)

    @lru_cache(maxsize=None)  # noqa: B019
    def layout(self, band: int) -> tuple[int, int]:
        """(first-level partitions, spare ones of them). Spares let sets do without thin projections, which many would share."""
        k = self.differences(band)
        n1 = k // (self.differ + 1) + 1
        spare = 0 if k < 2 else 1 if k < 8 else 3 + n1 // 12
        return n1 + spare, spare

    def places(self, marks: np.ndarray, band: int, n: int) -> np.ndarray:
        """Which of n parts of the domain each element lies in; another cut for each band."""
        high = (marks * _U(2 * (band * 0x51ED2701 + 0x1B873593) + 1)) >> _U(32)
        return ((high * _U(n)) >> _U(32)).astype(np.int64)

    def projections(self, values: np.ndarray, band: int, channel: int, thin: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """(signatures of all subsets, which of them hold `thin` elements or more, whether those suffice).

        They suffice where no more first-level partitions have a thin projection than there are spare ones: then some
        partition without any agrees with every linked set, and that set has the projection as well.
        """
        n1, spare = self.layout(band)
        marks = mix(values + _U(0x9E3779B97F4A7C15))
        part = self.places(marks, band, n1 * self.parts)
        cells = np.zeros(n1 * self.parts, _U)
        np.add.at(cells, part, marks)
        cells, held = cells.reshape(n1, self.parts), np.bincount(part, minlength=n1 * self.parts).reshape(n1, self.parts)
        # a projection is what a first-level partition holds without the parts left out
        left_out = list(combinations(range(self.parts), self.differ))
        without = lambda table: np.stack([table.sum(axis=1) - sum(table[:, q] for q in out) for out in left_out])
        filled = without(held) >= thin
        numbers = np.arange(n1, dtype=_U) * _U(64) + np.arange(len(left_out), dtype=_U)[:, None] + _U(channel << 48)
        signed = (mix(mix(without(cells)) + numbers) >> _U(64 - TAG_SHIFT)) | _U(band << TAG_SHIFT)
        return signed, filled, int(np.count_nonzero(~filled.all(axis=0))) <= spare

    def signatures(self, values: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """The set's signatures as int64, the band in the top bits.

        Elements in `common` (sorted) are left out at first: that brings no two sets further apart, and what many texts
        share by chance no longer makes groups. A set of which too little is left is unsure; two unsure sets
        meet by the signatures of their whole sets, an unsure and a sure one by those of the rest.
        """
        made = [np.empty(0, _U)]
        rest = values
        if common is not None and len(common):
            rest = values[common[np.minimum(np.searchsorted(common, values), len(common) - 1)] != values]
        for band in self.bands(len(values)):
            signed, filled, sure = self.projections(rest, band, 1, 1)
            made.append(signed[filled])
            if not sure:
                signed, filled, enough = self.projections(values, band, 0, self.thin)
                made.append(signed[filled] if enough else signed.ravel())
        return np.concatenate(made).view(np.int64)

    def sketch(self, values: np.ndarray, band: int, fine: int = 1) -> bytes:
        """Parities of the set's elements by hash: two sets' sketches differ in at most as many bits as the sets in elements.

        `fine` times as many bits bring the difference of the sketches nearer to that of the sets.
        """
        bits = fine * max(256, -(-4 * self.differences(band) // 64) * 64)
        at = ((mix(values + _U(77)) >> _U(32)) * _U(bits)) >> _U(32)
        return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1).tobytes()


_SKETCHES = pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.binary())]))


def _texts(batches, at: int):
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            yield part, part.column(at).to_pylist()


def _sets(df: DataFrame, scheme: PartEnum, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, n_shingles, digest, set, sketches) of each row; set is the digest's first half, a sketch some hundred bytes."""

    def run(batches):
        for part, texts in _texts(batches, 1):
            made = [shingles(t, words) for t in texts]
            keys = [digest(m) for m in made]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(map(len, made), pa.int64()), pa.array(keys, pa.binary()), pa.array(map(set_id, keys), pa.int64()),
                    pa.array([[{"band": t, "bits": scheme.sketch(m, t)} for t in scheme.bands(len(m))] for m in made], _SKETCHES),
                ],
                names=["doc", "n_shingles", "digest", "set", "sketches"],
            )

    slim = df.select(F.col(f"`{id_col}`").alias("doc"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc {type_of(df, id_col)}, n_shingles bigint, digest binary, `set` bigint, sketches array<struct<band:int,bits:binary>>")


def common_shingles(df: DataFrame, words: int, id_col: str, text_col: str) -> np.ndarray:
    """Sorted hashes of at most COMMON shingles that are frequent in about SAMPLE texts, taken by a hash of id and text.

    They steer which groups are formed and never what is linked, so neither bound changes a result.
    """
    every = max(1, df.count() // SAMPLE)
    point = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.substring(text_or_empty(text_col), 1, 64)), F.lit(every))

    def run(batches):
        for _, texts in _texts(batches, 0):
            found, n = np.unique(np.concatenate([shingles(t, words) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    counted = df.where(point == 0).select(text_or_empty(text_col).alias("text")).mapInArrow(run, "shingle bigint, n bigint")
    top = counted.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    return np.sort(np.array([r["shingle"] for r in top], np.int64).view(_U))


def _signature_rows(df: DataFrame, scheme: PartEnum, words: int, text_col: str, common: np.ndarray) -> DataFrame:
    """(signature, set); a task passes over a set that it has just seen, so copies add little."""
    shared = df.sparkSession.sparkContext.broadcast(common)  # at most COMMON numbers

    def run(batches):
        seen: set[int] = set()
        for _, texts in _texts(batches, 0):
            signed, owners = [], []
            for text in texts:
                values = shingles(text, words)
                key = set_id(digest(values))
                if key in seen or not len(values):
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(key)
                made = scheme.signatures(values, shared.value)
                signed.append(made)
                owners.append(np.full(len(made), key, np.int64))
            if signed:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signed)), pa.array(np.concatenate(owners))], names=["signature", "set"])

    return df.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "signature bigint, set bigint")


def _runs(batches, names):
    """Batches of the different rows of sorted ones, cut so that a run of equal first values stays together unless longer than BLOCK.

    Repeated rows go before a run is measured, so a run that is cut has more than BLOCK different rows, and the part that is given out BLOCK or more.
    """
    held = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        if not len(columns[0]):
            continue
        fresh = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]
        columns = [c[fresh] for c in columns]
        start = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        if len(columns[0]) - start > BLOCK:
            start = len(columns[0]) - 1  # all but one row of a long run go on
        if start:
            yield [c[:start] for c in columns]
        held = [c[start:] for c in columns]
    if held is not None:
        yield held


def _groups(signed: DataFrame) -> DataFrame:
    """(group, band, set): sets that share a signature; signatures with the same sets give one group.

    Works on sorted rows as they stream by. A run too long to hold at once is named after its signature instead of its members.
    """

    def run(batches):
        long_run = None
        for signature, owner in _runs(batches, ("signature", "set")):
            begins = np.flatnonzero(np.r_[True, signature[1:] != signature[:-1]])
            lengths = np.diff(np.r_[begins, len(signature)])
            names = np.add.reduceat(mix(owner.view(_U)), begins)
            heads = signature[begins]
            cut = lengths > BLOCK // 2
            if long_run is not None:
                cut[0] |= heads[0] == long_run
            names[cut] = mix(heads[cut].view(_U))
            long_run = heads[-1] if cut[-1] else None
            bands = (heads.view(_U) >> _U(TAG_SHIFT)).astype(np.int32)
            names = mix(names + bands.astype(_U))
            use = (lengths > 1) | cut
            once = np.zeros(len(names), bool)
            once[np.unique(names, return_index=True)[1]] = True
            rows = np.repeat(use & (once | cut), lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, lengths)[rows].view(np.int64)), pa.array(np.repeat(bands, lengths)[rows]), pa.array(owner[rows])],
                names=["group", "band", "set"],
            )

    ordered = signed.repartition("signature").sortWithinPartitions("signature", "set")
    return ordered.mapInArrow(run, "`group` bigint, band int, `set` bigint").distinct()


def _values(df: DataFrame, members: DataFrame, words: int, id_col: str, text_col: str, made_of: Callable | None = None, schema: str = "`values` binary") -> DataFrame:
    """(node, set, values) of the classes in `members` (node, set): their whole sets, as bytes of the hashes, or what `made_of` makes of them."""
    few = members.select("node").distinct()
    if members.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    chosen = df.select(F.col(f"`{id_col}`").alias("node"), text_or_empty(text_col).alias("text")).join(few, "node", "left_semi")
    made_of = made_of or (lambda sets: [pa.array([m.tobytes() for m in sets], pa.binary())])

    def run(batches):
        for part, texts in _texts(batches, 1):
            made = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_id(digest(m)) for m in made], pa.int64()), *made_of(made)], names=["node", "set", "values"])

    made = chosen.mapInArrow(run, f"node {type_of(df, id_col)}, `set` bigint, {schema}")
    return made.join(members.select("node", "set").distinct(), ["node", "set"], "left_semi").dropDuplicates(["node", "set"])


def _blocks(members: DataFrame, elements: int | None = None) -> DataFrame:
    """`members` (group, node, size and more) with a block: their group, or for a large group all pairs of smaller blocks.

    A group is large by its members, and with `elements` also by the sum of their sizes.
    """
    parts = F.ceil(F.count(F.lit(1)) / (BLOCK // 2))
    if elements is not None:
        parts = F.greatest(parts, F.ceil(F.sum("size") / (elements // 2)))
    large = members.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("e"), parts.cast("int").alias("n"))
    large = large.where((F.col("m") > BLOCK) | (F.col("e") > (elements or 1 << 62))).select("group", "n")
    dealt = members.join(large, "group", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    block = F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.withColumn("block", F.when(F.col("n") == 1, F.col("group")).otherwise(block)).drop("group", "n", "mine", "other")


def _apart(bits: list[bytes]):
    """i -> how many bits the sketch of member i differs in from each one before it: no more than their sets differ in elements."""
    rows = np.frombuffer(b"".join(bits), _U).reshape(len(bits), -1)
    return lambda i: np.bitwise_count(rows[:i] ^ rows[i]).sum(axis=1, dtype=np.int64)


def _numbered(labels: list) -> np.ndarray:
    return np.unique(np.array(labels, object).astype(str), return_inverse=True)[1]


def _nearest(blocks: DataFrame, scheme: PartEnum, kind: str) -> DataFrame:
    """(a, b): each member of a block with the nearest earlier one among those that its sketch allows to be linked."""
    ids = to_arrow_type(blocks.schema["node"].dataType)

    def run(batches):
        for batch in _row_groups(batches, 4):
            a, b = [], []
            for node, size, bits in batch:
                sizes, apart_of = np.array(size), _apart(bits)
                for i in range(1, len(node)):
                    apart = apart_of(i)
                    near = np.flatnonzero((100 + scheme.percent) * apart <= (100 - scheme.percent) * (sizes[:i] + sizes[i]))
                    if len(near):
                        a.append(node[near[int(np.argmin(apart[near]))]])
                        b.append(node[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids)], names=["a", "b"])

    ordered = blocks.repartition("block").sortWithinPartitions("block", "node")
    found = ordered.select("block", "node", "size", "bits").mapInArrow(run, f"a {kind}, b {kind}")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(scheme: PartEnum, size: list, bits: list[bytes], component: list):
    """(i, earlier members, their distances): pairs of a block from different components that the sketches allow to be linked."""
    labels, sizes = _numbered(component), np.array(size)
    if labels.max(initial=0) == 0:
        return
    apart_of = _apart(bits)
    for i in range(1, len(size)):
        apart = apart_of(i)
        near = np.flatnonzero(((100 + scheme.percent) * apart <= (100 - scheme.percent) * (sizes[:i] + sizes[i])) & (labels[:i] != labels[i]))
        if len(near):
            yield i, near, apart[near]


def _undecided(blocks: DataFrame, scheme: PartEnum, kind: str) -> DataFrame:
    """(block, node): members of a block that may be linked with a member of another component. At most a row per member."""
    ids, names = to_arrow_type(blocks.schema["node"].dataType), ["block", "node", "size", "bits", "component"]

    def run(batches):
        for batch in _row_groups(batches, len(names), keep_key=True):
            own, found = [], []
            for block, node, size, bits, component in batch:
                named = np.zeros(len(node), bool)
                for i, near, _ in _candidates(scheme, size, bits, component):
                    named[near] = named[i] = True
                own += [block[0]] * int(named.sum())
                found += [node[i] for i in np.flatnonzero(named)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, ids)], names=["block", "node"])

    ordered = blocks.repartition("block").sortWithinPartitions("block", "node")
    return ordered.select(*names).mapInArrow(run, f"block bigint, node {kind}")


def _joining(blocks: DataFrame, scheme: PartEnum, kind: str) -> DataFrame:
    """(a, b): linked members of a block that join its components, fewer than it has; nearest pairs are tried first.

    Pairs that are already joined are passed over, the others verified on the whole sets here, so no pair leaves the task.
    """
    ids, names = to_arrow_type(blocks.schema["node"].dataType), ["block", "node", "size", "bits", "component", "values"]

    def run(batches):
        for batch in _row_groups(batches, len(names)):
            a, b = [], []
            for node, size, bits, component, values in batch:
                root, sets = _numbered(component), [np.frombuffer(v, _U) for v in values]
                tries = [np.stack([apart, near, np.full(len(near), i)]) for i, near, apart in _candidates(scheme, size, bits, component)]
                tries = np.concatenate(tries, axis=1) if tries else np.empty((3, 0), np.int64)
                for n in np.argsort(tries[0], kind="stable"):
                    j, i = tries[1, n], tries[2, n]
                    if root[i] == root[j]:
                        continue
                    union = len(np.union1d(sets[i], sets[j]))
                    if scheme.linked(len(sets[i]) + len(sets[j]) - union, len(sets[i]), len(sets[j])):
                        root[root == root[i]] = root[j]
                        a.append(node[j])
                        b.append(node[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids)], names=["a", "b"])

    ordered = blocks.repartition("block").sortWithinPartitions("block", "node")
    found = ordered.select(*names).mapInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _row_groups(batches, width: int, keep_key: bool = False):
    """For each batch the whole groups (equal first column) in it, as lists of the other columns; the last one waits for more rows."""
    first = 0 if keep_key else 1
    held: list[list] = [[] for _ in range(width)]
    for batch in batches:
        for h, column in zip(held, batch.columns):
            h.extend(column.to_pylist())
        keys, groups, start = held[0], [], 0
        for i in range(1, len(keys)):
            if keys[i] != keys[i - 1]:
                groups.append([h[start:i] for h in held[first:]])
                start = i
        held = [h[start:] for h in held]
        yield groups
    if held[0]:
        yield [held[first:]]


def _verified(pairs: DataFrame, df: DataFrame, classes: DataFrame, scheme: PartEnum, words: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs that are linked, by the whole sets; only texts that a pair names are made sets again."""
    pairs, kind = materialise(pairs), type_of(df, id_col)
    named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _values(df, materialise(classes.select("node", "set").join(named, "node", "left_semi")), words, id_col, text_col)
    one = sets.select(F.col("node").alias("a"), F.col("values").alias("left"))
    two = sets.select(F.col("node").alias("b"), F.col("values").alias("right"))

    def run(batches):
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(c)[i].as_buffer(), _U) for c in (2, 3))
                common = len(left) + len(right) - len(np.union1d(left, right))
                good.append(scheme.linked(common, len(left), len(right)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return materialise(joined.mapInArrow(run, f"a {kind}, b {kind}"))


def jaccard_components(
    df: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, differ: int = 1,
) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of `df`.

    Two rows link when 100 * |A & B| >= percent * |A | B| over their sets of distinct word n-grams; with fewer words the
    whole sequence is the one element. `component_id` is the smallest id reachable by links. A text without words, null
    included, has an empty set, is linked with nothing and is its own component. A row with a null id takes the component
    of rows with an equal set, else null. Rows of one id are one node. Shingles are compared by 64-bit hashes. Other
    columns are not read; an empty table gives an empty result.
    """
    scheme, kind = PartEnum(percent, parts, differ), type_of(df, id_col)
    sets = materialise(_sets(df, scheme, words, id_col, text_col))
    classes = sets.where("n_shingles > 0 AND doc IS NOT NULL").groupBy("digest", "set").agg(F.min("doc").alias("node"))
    drop_finished(df.sparkSession)
    groups = materialise(_groups(_signature_rows(df, scheme, words, text_col, common_shingles(df, words, id_col, text_col))))
    drop_finished(df.sparkSession)
    sketches = sets.where("n_shingles > 0").dropDuplicates(["digest"]).select("digest", "set", F.col("n_shingles").alias("size"), F.explode("sketches").alias("s"))
    sketches = sketches.join(classes.select("digest", "node"), "digest").select("node", "set", "size", "s.band", "s.bits")
    members = groups.join(sketches, ["set", "band"]).select("group", "node", "set", "band", "size", "bits")
    first = _verified(_nearest(_blocks(members.drop("set", "band")), scheme, kind), df, classes, scheme, words, id_col, text_col)
    labels = connected_components(first)
    drop_finished(df.sparkSession)
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group")
    open_blocks = materialise(_blocks(labelled.join(several, "group", "left_semi"), ELEMENTS))
    drop_finished(df.sparkSession)
    # finer sketches for those that coarse ones leave, whole sets for those that fine ones leave
    meeting = open_blocks.drop("bits").join(_undecided(open_blocks, scheme, kind), ["block", "node"])
    meeting = materialise(meeting)
    sketched = lambda sets: [pa.array([[{"band": t, "bits": scheme.sketch(m, t, FINE)} for t in scheme.bands(len(m))] for m in sets], _SKETCHES)]
    fine = _values(df, meeting.select("node", "set"), words, id_col, text_col, sketched, "`values` array<struct<band:int,bits:binary>>")
    fine = fine.select("node", F.explode("values").alias("s")).select("node", "s.band", "s.bits")
    closer = materialise(meeting.join(fine, ["node", "band"]))
    last = materialise(closer.join(_undecided(closer, scheme, kind), ["block", "node"]))
    whole = _values(df, last.select("node", "set"), words, id_col, text_col).select("node", "values")
    rest = materialise(_joining(last.join(whole, "node"), scheme, kind))
    drop_finished(df.sparkSession)
    if not rest.isEmpty():
        labels = connected_components(first.union(rest))

    by_set = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return sets.join(by_set, "digest", "left").select(
        F.col("doc").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"),
    )


def keep_one_of_each(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns as they are, but for those whose component has a smaller id. Null ids stay."""
    found = jaccard_components(df, words, percent, id_col, text_col)
    drop = materialise(found.where(f"component_id < `{id_col}`").select(F.col(f"`{id_col}`").alias("__drop")).distinct())
    if drop.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    return df.join(drop, F.col(f"`{id_col}`") == F.col("__drop"), "left_anti")
