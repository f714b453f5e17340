"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A token sequence is the BPE result exactly if every two neighbours are what BPE makes of their joined bytes. So the
last token before each position follows from the bytes read so far, and reading left to right needs only the bytes a
later token may still reach back over. A state holds the last emitted token and those pending bytes; a transition reads
one byte, extends the chains of last tokens, and emits what all chains that can still grow agree on. States and
transitions are made when first met and kept, so the transducer is determinised only as far as the text asks.
The lookahead is bounded by the longest token.

Vocabularies are files of `base64(token) rank` lines named by a path that executors can open; they are not copied.

Cases: null and empty texts give no ids; any text is encoded whole, also one long run without spaces (states reach back
over one token only); repeated rows are encoded one by one; unknown ids fail loudly on decoding.
"""

from __future__ import annotations

import base64
import gc
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from portentia.llm import arrays as A
from portentia.llm.token_cache import WordCache

#: States and quarters of token pairs that the transducer keeps for good (about 250 MB), and transitions and quarters of
#: pairs made after them before these are forgotten (about 40 MB).
STATES, FRESH = 300_000, 40_000
#: Cuts of texts, and other matches of the pattern, kept per generation (there are two, about 70 MB).
CUTS, PIECES = 200_000, 10_000
#: States with at least so many pending bytes are compared by their continuations.
MERGED_FROM = 3
#: Marks that the pattern keeps apart from the letters before them.
MARKS = frozenset(".,;:!?")
#: The transitions of states that have none yet; never filled.
NONE_YET: dict = {}
assert array("I").itemsize == 4 and sys.byteorder == "little"
#: A space that follows white space: where a text may not simply be cut before spaces.
RAGGED = regex.compile(r"[\s\x1c-\x1f] ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class State:
    """Last emitted token (or -1), pending bytes, and for each pending position that a later token may still start
    from the boundaries and tokens that lead to it."""

    __slots__ = ("emitted", "pending", "paths", "next", "tail")

    def __init__(self, emitted: int, pending: bytes, paths: list):
        self.emitted, self.pending, self.paths = emitted, pending, paths
        self.next: dict[int, tuple[State, tuple[int, ...]]] = NONE_YET
        self.tail: tuple[int, ...] = paths[-1][1]


class Transducer:
    """Encodes bytes by merge ranks (every single byte must have one)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.longest = max(map(len, ranks))
        self.longer: dict[bytes, list[int]] = {}
        for token, rank in ranks.items():
            for k in range(MERGED_FROM, len(token)):
                self.longer.setdefault(token[:k], []).append(rank)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.next.clear()  # states point at each other; without this only the cycle collector would free them
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple[int, bytes], State] = {}
        self.kept: tuple[int, int] | None = None  # how many states and pairs stay
        self.fresh: list[tuple[State, int]] = []  # state and byte of the transitions made since
        self.start = self._state(-1, b"", [((), ())])

    def _bound(self) -> None:
        """The states met first stay, as they are the common ones; what is made after them is forgotten from time to time."""
        if self.kept is None:
            if len(self.states) + len(self.pairs) // 4 > STATES:
                self.kept = len(self.states), len(self.pairs)
        elif len(self.fresh) + (len(self.pairs) - self.kept[1]) // 4 > FRESH:
            for state, byte in self.fresh:
                state.next.pop(byte, None)
            self.fresh = []
            for table, size in zip((self.states, self.pairs), self.kept):
                while len(table) > size:
                    table.popitem()  # the last one put in

    def _state(self, emitted: int, pending: bytes, paths: list) -> State:
        """States that no continuation can tell apart are one: what came before matters only through the tokens that
        begin with the pending bytes and may not follow it."""
        longer = self.longer.get(pending)
        if longer is not None:
            key = (tuple([t for t in longer if not self._fits(emitted, t)]), pending)
        else:
            key = (emitted, pending)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(emitted, pending, paths)
        return found

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            ranks, none = self.ranks, len(self.ranks)
            while len(parts) > 2:
                costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
                i = costs.index(min(costs))
                if costs[i] == none:
                    raise ValueError(f"token {token} is not made by merges")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _fits(self, left: int, right: int) -> bool:
        """May `right` follow `left` (-1: nothing before it)?

        Merges are undone on both sides of the border, the later one first. If some two tokens that met there would
        have merged before the next undone merge, BPE would have joined them across the border.
        """
        if left < 0:
            return True
        pair = left << 32 | right
        found = self.pairs.get(pair)
        if found is None:
            found, before = True, 1 << 60
            while True:
                across = self.ranks.get(self.tokens[left] + self.tokens[right])
                if across is not None and across < before:
                    found = False
                    break
                a, b = self._halves(left), self._halves(right)
                if a is None and b is None:
                    break
                if b is None or (a is not None and left > right):
                    left, before = a[1], left
                else:
                    right, before = b[0], right + 1  # of equal merges the left one comes first
            self.pairs[pair] = found
        return found

    def _step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        pending, ranks, prefixes = state.pending + bytes((byte,)), self.ranks, self.prefixes
        end, paths, ending = len(pending), [], None
        for j, path in enumerate(state.paths):
            if path is None:
                paths.append(None)
                continue
            rest = pending[j:]
            if ending is None:
                token = ranks.get(rest)
                if token is not None and self._fits(path[1][-1] if j else state.emitted, token):
                    ending = (*path[0], end), (*path[1], token)
            paths.append(path if rest in prefixes else None)
        paths.append(ending)
        out: tuple[int, ...] = ()
        emitted = state.emitted
        if paths[0] is None:
            ways = [p for p in paths if p is not None]
            low, high = min(ways), max(ways)  # what the extremes share, all share
            agreed = 0
            for x, y in zip(low[0], high[0]):
                if x != y:
                    break
                agreed += 1
            if agreed:
                out, cut = low[1][:agreed], low[0][agreed - 1]
                emitted, pending = out[-1], pending[cut:]
                paths = [p and (tuple(b - cut for b in p[0][agreed:]), p[1][agreed:]) for p in paths[cut:]]
        step = self._state(emitted, pending, paths), out
        if state.next is NONE_YET:
            state.next = {}
        state.next[byte] = step
        if self.kept is not None:
            self.fresh.append((state, byte))
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece. A piece that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, ids = self.start, []
        for byte in piece:
            step = state.next.get(byte)
            if step is None:
                self._bound()
                step = self._step(state, byte)
            state, out = step
            if out:
                ids += out
        return [*ids, *state.tail]


class TextEncoder:
    """Splits texts by a pattern and encodes every match with the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.words = WordCache(self._word, CUTS)
        self.pieces = WordCache(self._piece, PIECES)

    def release(self) -> None:
        """Forget states and words, which may take 350 MB; a worker process outlives its tasks."""
        self.transducer.reset()
        for cache in (self.words, self.pieces):
            cache.clear()
            cache.old = {}

    def _word(self, word: str) -> bytes:
        """A cut of a text. The common forms, letters with or without one mark at the end, need no pattern."""
        body = word[1:] if word[0] == " " else word
        if body.isalpha():
            return self._piece(word)
        if body[-1:] in MARKS and body[:-1].isalpha():
            return self.words[word[:-1]] + self.words[word[-1]]
        return self._pieces(word)

    def _piece(self, piece: str) -> bytes:
        return array("I", self.transducer.encode(piece.encode())).tobytes()

    def _pieces(self, text: str) -> bytes:
        """Every match of the pattern by itself; letters, with or without a space before them, are words as well."""
        words, pieces = self.words, self.pieces
        found = self.pattern.findall(text)
        return b"".join([words[x] if (x[1:] if x[0] == " " else x).isalpha() else pieces[x] for x in found])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        No match goes on from a printing character to a following space, so a text may be cut before such spaces and
        the cuts be cached; texts where a space follows white space are split by the pattern as a whole.
        """
        if not text:
            return b""
        if RAGGED.search(text):
            return self._pieces(text)
        if "\0" in text:
            first, *rest = text.split(" ")
            cuts = [first, *(" " + w for w in rest)]
        else:
            cuts = text.replace(" ", "\0 ").split("\0")
        return b"".join(map(self.words.__getitem__, cuts if cuts[0] else cuts[1:]))


#: States of the UTF-8 machine: continuation bytes still needed, and the range allowed for the next one.
_LEAD = (
    [(0, 0, 0)] * 0x80 + [None] * 0x42 + [(1, 0x80, 0xBF)] * 0x1E + [(2, 0xA0, 0xBF)] + [(2, 0x80, 0xBF)] * 12
    + [(2, 0x80, 0x9F)] + [(2, 0x80, 0xBF)] * 2 + [(3, 0x90, 0xBF)] + [(3, 0x80, 0xBF)] * 3 + [(3, 0x80, 0x8F)] + [None] * 11
)


class Utf8Stream:
    """Incremental UTF-8: takes bytes as tokens arrive, gives text as soon as code points are complete.

    Only the last bytes of each chunk go through the machine: it finds the incomplete code point at the end, which is
    held back for the next chunk. Ill-formed bytes become U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a code point that is not complete."""
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            state = _LEAD[lead]
            if state is None or state[0] < back:
                return 0
            low, high = state[1:]
            for byte in data[len(data) - back + 1 :]:
                if not low <= byte <= high:
                    return 0
                low, high = 0x80, 0xBF
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        tail = self.open_tail(data)
        self.held = data[len(data) - tail :] if tail else b""
        return data[: len(data) - tail].decode("utf-8", "replace")

    def close(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


class Decoder:
    """Ids back to bytes or, streaming, to text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = {i: t for t, i in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def stream(self, ids: bytes, step: int = 4096) -> Iterator[str]:
        machine = Utf8Stream()
        for at in range(0, len(ids), 4 * step):
            yield machine.feed(self.decode(ids[at : at + 4 * step]))
        yield machine.close()


_made: dict[tuple[str, str], tuple[TextEncoder, Decoder]] = {}


def _coder(path: str, pattern: str) -> tuple[TextEncoder, Decoder]:
    """One per worker and vocabulary, kept between tasks."""
    if (path, pattern) not in _made:
        ranks = read_ranks(path)
        _made[(path, pattern)] = TextEncoder(ranks, pattern), Decoder(ranks)
    return _made[(path, pattern)]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of `docs` and the ids of its text, a binary column of little-endian unsigned 32-bit integers.

    As one step of a longer job: every task forgets its states and words at its end (about a quarter more CPU time), so
    that worker processes hold no memory in the steps that follow.
    """
    return _mapped(docs, path, pattern, text, [ids], lambda coder, x: (coder[0].encode(x),), release=True)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """As `encode`, and in the same pass the ids decoded again: binary columns ids and decoded."""

    def both(coder, x):
        packed = coder[0].encode(x)
        return packed, "".join(coder[1].stream(packed)).encode()

    return _mapped(docs, path, pattern, text, ["ids", "decoded"], both)


def _mapped(docs, path, pattern, text, names, make, release: bool = False) -> DataFrame:
    clash = sorted(set(names) & set(docs.columns))
    if clash:
        raise ValueError(f"columns {clash} are already there")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), *(f"`{n}` binary" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        gc.disable()  # hundreds of thousands of states that live as long as the task: collections would walk them in vain
        try:
            for batch in batches:
                for at, end, _, _ in A.slices(batch.column(text), 8 * A.SLICE_BYTES):
                    part = batch.slice(at, end - at)
                    made = [make(coder, x or "") for x in part.column(text).to_pylist()]
                    new = [pa.array([m[k] for m in made], pa.binary()) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])
        finally:
            if release:
                coder[0].release()
                gc.enable()

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Text of a binary id column (null: empty), decoded as a stream."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n != out), f"`{out}` string"])
    kept = [n for n in df.columns if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(path))
        for batch in batches:
            texts = ["".join(decoder.stream(x or b"")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string())], names=[*kept, out])

    return df.mapInArrow(run, schema)
