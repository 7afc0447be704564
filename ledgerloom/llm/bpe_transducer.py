"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding. A row of tokens is the BPE result of its bytes exactly when each neighbouring pair is the BPE result of the
pair's bytes. So a nondeterministic machine may follow every token that could be under way: a hypothesis is (tokens not
yet emitted, last token, bytes since). Its determinised state is the list of live hypotheses. Reading a byte drops those
that no token can complete, and exactly one completes; what all survivors agree on is emitted, so output lags the input
by at most the longest token. States and arrows are made when first met and kept in a bounded table.

Decoding. Token by token through a UTF-8 state machine whose arrows for whole tokens, from the start state back to it,
are made when first met; a character may be spread over several tokens.
"""

from __future__ import annotations

import hashlib
import marshal
from bisect import bisect_right
from dataclasses import dataclass
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_merges import Memo, merge_piece, rank_table
from .rows import map_texts


class Neighbours:
    """Which tokens may stand side by side.

    Alone, a token grows by merges of rising rank, so its outermost part changes at known ranks. Two tokens stay apart
    unless, at some rank, the parts that touch join before either is taken into its own token (leftmost first on a tie).
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.lefts: dict[bytes, list[tuple[bytes, float]]] = {}
        self.rights: dict[bytes, list[tuple[bytes, float]]] = {}

    def edges(self, token: bytes) -> None:
        """Outer parts of a token from its first byte (last byte) on, each with the rank that takes it in."""
        ranks = self.ranks
        left = right = token
        lefts, rights = [(token, inf)], [(token, inf)]
        while len(left) > 1:
            whole, left = left, self.halves(left)[0]
            lefts.append((left, ranks[whole]))
        while len(right) > 1:
            whole, right = right, self.halves(right)[1]
            rights.append((right, ranks[whole]))
        self.lefts[token], self.rights[token] = lefts[::-1], rights[::-1]

    def halves(self, token: bytes) -> list[bytes]:
        ranks = self.ranks
        parts = merge_piece(token, lambda a, b: None if len(a) + len(b) == len(token) else ranks.get(a + b))
        if len(parts) != 2:
            raise ValueError(f"token {token!r} is not the join of two tokens")
        return parts

    def apart(self, left: bytes, right: bytes) -> bool:
        if left not in self.rights:
            self.edges(left)
        if right not in self.lefts:
            self.edges(right)
        ranks, outer, inner, i, j = self.ranks, self.rights[left], self.lefts[right], 0, 0
        while True:
            (p, p_until), (q, q_until) = outer[i], inner[j]
            rank = ranks.get(p + q)
            if rank is not None and rank < p_until and rank <= q_until:
                return False
            if p_until <= q_until:
                if p_until == inf:
                    return True
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes of one pre-token in, token ids out as little-endian 32-bit integers.

    A state is kept as marshalled text of its hypotheses, an arrow under (number of its state, byte): some 500 bytes for
    each state with its arrows, so the tables stay below some 200 MB. When full they are emptied and made anew as needed.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 250_000, most_known: int = 400_000):
        self.ranks, self.most_states, self.most_known = ranks, most_states, most_known
        self.packed = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.tokens = sorted(ranks)
        self.neighbours = Neighbours(ranks)
        self.known: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.arrows: dict[int, tuple[int, bytes]] = {}
        self.number(((b"", b"", b""),))

    def number(self, state: tuple) -> int:
        """The state's number times 256, so that adding a byte gives its arrow's key."""
        key = marshal.dumps(state, 2)
        if (n := self.numbers.get(key)) is None:
            n = self.numbers[key] = len(self.states) << 8
            self.states.append(key)
        return n

    def hopeful(self, last: bytes, part: bytes) -> bool:
        """Whether some longer token that begins with `part` may follow `last`."""
        if (known := self.known.get((last, part))) is None:
            if len(self.known) >= self.most_known:
                self.known.clear()
            known, i, tokens = False, bisect_right(self.tokens, part), self.tokens
            while i < len(tokens) and tokens[i].startswith(part):
                if not last or self.neighbours.apart(last, tokens[i]):
                    known = True
                    break
                i += 1
            self.known[last, part] = known
        return known

    def arrow(self, at: int, byte: int) -> tuple[int, bytes]:
        if len(self.states) >= self.most_states:
            here = marshal.loads(self.states[at >> 8])
            self.forget()
            at = self.number(here)
        more, whole, ranks = [], None, self.ranks
        for waiting, last, part in marshal.loads(self.states[at >> 8]):
            part = part + bytes((byte,))
            if whole is None and part in ranks and (not last or self.neighbours.apart(last, part)):
                whole = (waiting + self.packed[part], part, b"")
            if self.hopeful(last, part):
                more.append((waiting, last, part))
        if whole is None:
            raise ValueError("the ranks are not those of a BPE vocabulary over all bytes")
        more.append(whole)
        first = more[0][0]
        agreed = 0 if len(more) > 1 else len(first)
        while agreed < len(first) and all(w[agreed : agreed + 4] == first[agreed : agreed + 4] for w, _, _ in more):
            agreed += 4
        made = self.number(tuple((w[agreed:], last, part) for w, last, part in more) if agreed else tuple(more)), first[:agreed]
        self.arrows[at | byte] = made
        return made

    def encode(self, piece: bytes) -> bytes:
        if (token := self.packed.get(piece)) is not None:
            return token
        out, at, known = b"", 0, self.arrows.get
        for byte in piece:
            if (step := known(at | byte)) is None:
                step = self.arrow(at, byte)
                known = self.arrows.get
            at, emitted = step
            if emitted:
                out += emitted
        return out + marshal.loads(self.states[at >> 8])[-1][0]  # the hypothesis that ends here


@dataclass(frozen=True)
class _Pending:
    """Inside a character: bits read so far, bytes to come, bounds of the next byte."""

    bits: int = 0
    more: int = 0
    low: int = 0x80
    high: int = 0xBF


_START = _Pending()


def utf8_step(state: _Pending, byte: int) -> tuple[_Pending, str]:
    """Next state and the characters that are complete now; a wrong byte gives U+FFFD and, if it can, starts a character."""
    if state.more:
        if state.low <= byte <= state.high:
            bits, more = state.bits << 6 | byte & 0x3F, state.more - 1
            return (_Pending(bits, more), "") if more else (_START, chr(bits))
        after, made = utf8_step(_START, byte)
        return after, "�" + made
    if byte < 0x80:
        return _START, chr(byte)
    if 0xC2 <= byte <= 0xDF:
        return _Pending(byte & 0x1F, 1), ""
    if 0xE0 <= byte <= 0xEF:
        return _Pending(byte & 0x0F, 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF), ""
    if 0xF0 <= byte <= 0xF4:
        return _Pending(byte & 0x07, 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF), ""
    return _START, "�"


class StreamDecoder:
    """Ids in, any number at a time; characters out as soon as they are whole. finish() gives what a cut-off end leaves."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.start: dict[int, str] = {}  # token arrows from the start to the start
        self.state = _START

    def feed(self, ids: list[int]) -> str:
        if self.state is _START and None not in (texts := list(map(self.start.get, ids))):
            return "".join(texts)  # arrows from and to the start, all met before
        out = []
        for i in ids:
            if self.state is _START and (text := self.start.get(i)) is not None:
                out.append(text)
                continue
            state, text = self.state, ""
            for byte in self.tokens[i]:
                state, made = utf8_step(state, byte)
                text += made
            if self.state is _START and state is _START:
                self.start[i] = text
            self.state = state
            out.append(text)
        return "".join(out)

    def finish(self) -> str:
        cut, self.state = self.state is not _START, _START
        return "�" if cut else ""


_CODECS: dict[tuple, tuple] = {}


def codec(ranks_file: bytes, pattern: str):
    """(text -> little-endian ids, token table) of this worker."""
    key = (hashlib.sha256(ranks_file).digest(), pattern)
    if key not in _CODECS:
        import regex

        ranks = rank_table(ranks_file.splitlines())
        machine, split = Transducer(ranks), regex.compile(pattern).findall
        packed = Memo(lambda piece: machine.encode(piece.encode()), 200_000)
        _CODECS[key] = (lambda text: b"".join(map(packed.__getitem__, split(text)))), {i: t for t, i in ranks.items()}
    return _CODECS[key]


def _shared_ranks(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # size: the vocabulary's, under 1 MB


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids) of every whole text; null and empty texts give an empty array. Ids may be null or repeat."""
    shared = _shared_ranks(df, ranks_path)

    def work():
        import numpy as np

        pack, _ = codec(shared.value, pattern)
        return lambda texts: [pa.array([np.frombuffer(pack(t), "<i4") for t in texts], pa.list_(pa.int32()))]

    return map_texts(df, [id_col], text_col, "token_ids array<int>", work)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) of every row of ids, by the streaming decoder; null ids give ''. An unknown id is an error."""
    shared = _shared_ranks(df, ranks_path)

    def run(batches):
        _, tokens = codec(shared.value, pattern)
        decoder = StreamDecoder(tokens)
        for batch in batches:
            texts = [decoder.feed(ids or []) + decoder.finish() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(f"`{id_col}`", f"`{ids_col}`").mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded by the transducer, decoded again from the ids.

    Digests are of the ids as little-endian 32-bit integers and of the decoded text in UTF-8. Null counts as ''; ids may be
    null or repeat; other columns are not read; an empty table gives an empty result. A text is one row's work, however
    long, in time proportional to its length.
    """
    shared = _shared_ranks(df, ranks_path)

    def work():
        import numpy as np

        pack, tokens = codec(shared.value, pattern)
        decoder = StreamDecoder(tokens)

        def digests(texts: list[str]) -> list[pa.Array]:
            n, ids_sha, decoded_sha = [], [], []
            for text in texts:
                ids = pack(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                sha = hashlib.sha256()
                numbers = np.frombuffer(ids, "<u4")
                for start in range(0, len(numbers), 1024):
                    sha.update(decoder.feed(numbers[start : start + 1024].tolist()).encode())
                sha.update(decoder.finish().encode())
                decoded_sha.append(sha.hexdigest())
            return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]

        return digests

    return map_texts(df, [id_col], text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)
