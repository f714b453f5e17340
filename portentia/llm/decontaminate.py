"""Benchmark passages in documents, within an edit budget.

An item of L characters may be found with up to L * ERROR_RATE edits. Cut into one piece more than that, at least one
piece must occur unchanged (pigeonhole). Piece hits are found by the hash of their first bytes at every position of a
text; each hit is checked and the stretch around it is compared with the whole item by Myers' bit-parallel edit
distance, one step per character whatever the number of edits.

Items and texts are compared lower-cased and with runs of white space as one space. Items go to the tasks in blocks of
bounded size, one pass over the documents for each; a benchmark of any size is searched whole. There is no shuffle.

Cases: null and empty items match nothing; items too short for the budget get a smaller one, under PIECE characters they
must occur unchanged; null and empty texts hold nothing; texts of any length are searched whole; each row of the
documents is judged by itself; repeated items are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portentia.llm import arrays as A
from portentia.llm.repeats import gram_hashes

ERROR_RATE = 0.08
#: Characters in a piece at least. Items and their characters in one block at most.
PIECE, BLOCK_ITEMS, BLOCK_CHARS = 10, 5_000, 4 << 20
U64 = np.uint64


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def normal_places(text: str) -> tuple[str, list[int]]:
    """The normal form and, for each of its characters, the place in the text it came from."""
    out, places, gap = [], [], False
    for k, c in enumerate(text):
        if c.isspace():
            gap = bool(out)
            continue
        if gap:
            out.append(" ")
            places.append(k - 1)
            gap = False
        for low in c.lower():
            out.append(low)
            places.append(k)
    return "".join(out), places


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for k, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << k
    return found


def closest(pattern: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and where the first such stretch ends (Myers)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text):
        equal = pattern.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus = down | ~(horizontal | up) & full
        minus = up & horizontal
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
        if distance < best:
            best, end = distance, k + 1
    return best, end


@dataclass
class Items:
    """A block of items, cut into pieces."""

    ids: list
    texts: list[str]

    def __post_init__(self) -> None:
        self.budgets, self.pieces = [], []  # pieces: (item, start in characters, bytes)
        for k, text in enumerate(self.texts):
            budget = min(int(len(text) * ERROR_RATE), max(0, len(text) // PIECE - 1))
            self.budgets.append(budget)
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            self.pieces += [(k, a, text[a:b].encode()) for a, b in zip(cuts, cuts[1:])]
        self.masks: dict[tuple[int, bool], dict[str, int]] = {}
        self.width = max(1, min((len(p) for _, _, p in self.pieces), default=1))
        heads = [np.frombuffer(p[: self.width], np.uint8) for _, _, p in self.pieces]
        self.heads = np.concatenate([gram_hashes(h, self.width) for h in heads]) if heads else np.zeros(0, U64)
        order = np.argsort(self.heads, kind="stable")
        self.heads, self.order = self.heads[order], order
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.heads >> U64(44)).astype(np.int64)] = True

    def mask(self, item: int, back: bool) -> dict[str, int]:
        if (item, back) not in self.masks:
            self.masks[(item, back)] = masks(self.texts[item][::-1] if back else self.texts[item])
        return self.masks[(item, back)]

    def hits(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in bytes, piece) of exact piece hits."""
        hashes = gram_hashes(data, self.width)
        at = np.flatnonzero(self.filter[(hashes >> U64(44)).astype(np.int64)])
        low = np.searchsorted(self.heads, hashes[at])
        at, low = at[low < len(self.heads)], low[low < len(self.heads)]
        same = self.heads[low] == hashes[at]
        raw = data.tobytes()
        for place, k in zip(at[same].tolist(), low[same].tolist()):
            h = self.heads[k]
            while k < len(self.heads) and self.heads[k] == h:
                piece = int(self.order[k])
                if raw.startswith(self.pieces[piece][2], place):
                    yield place, piece
                k += 1

    def matches(self, data: np.ndarray, offs: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start, end, distance) of the best place of each item in each of the normal texts."""
        if not len(self.heads):
            return
        chars = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(A.characters(data), out=chars[1:])
        tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for place, piece in self.hits(data):
            row = int(np.searchsorted(offs, place, side="right")) - 1
            item, start, raw = self.pieces[piece]
            if place + len(raw) > offs[row + 1]:
                continue  # runs into the next text
            m, budget, text = len(self.texts[item]), self.budgets[item], texts[row]
            origin = int(chars[place] - chars[offs[row]]) - start
            low, high = max(0, origin - budget), min(len(text), origin + m + budget)
            done = tried.setdefault((row, item), [])
            if any(a <= low and high <= b for a, b in done):
                continue
            done.append((low, high))
            distance, end = closest(self.mask(item, False), m, text[low:high])
            if distance > budget or (row, item) in best and best[(row, item)][0] <= distance:
                continue
            back, length = closest(self.mask(item, True), m, text[low : low + end][::-1])
            best[(row, item)] = distance, low + end - length, low + end
        for (row, item), (distance, start, end) in sorted(best.items()):
            yield row, item, start, end, distance


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items in blocks of bounded size; one block at a time is on the driver."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(benchmark[item].cast("long").alias("i"), benchmark[text].cast("string").alias("t"))
    for row in rows.where("t is not null").toLocalIterator():
        one = normal(row.t)
        if not one:
            continue
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(one) > BLOCK_CHARS):
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(one)
        size += len(one)
    if ids:
        yield Items(ids, texts)


def _normal_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    for at, end, _, _ in A.slices(batch.column("__text")):
        texts = [normal(x or "") for x in batch.column("__text").slice(at, end - at).to_pylist()]
        data, offs = A.text_buffers(pa.array(texts, pa.large_string()))
        yield at, texts, data, offs


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, distance, budget: items found in documents, each at its best place; places count
    code points of the document's own text."""
    found = None
    schema = "doc_id long, item_id long, start long, end long, distance long, budget long"
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for at, texts, data, offs in _normal_texts(batch):
                    for row, item, start, end, distance in items.matches(data, offs, texts):
                        places = normal_places(batch.column("__text")[at + row].as_py())[1]
                        rows.append((batch.column("doc_id")[at + row].as_py(), items.ids[item], places[start], places[end - 1] + 1, distance, items.budgets[item]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int64()) for k in range(6)],
                    names=["doc_id", "item_id", "start", "end", "distance", "budget"],
                )

        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("__text"))
        one = texts.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, that hold no item."""
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for at, texts, data, offs in _normal_texts(batch):
                    for row, *_ in items.matches(data, offs, texts):
                        keep[at + row] = False
                yield batch.drop_columns(["__text"]).filter(pa.array(keep))

        schema = docs.schema
        docs = docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(run, schema)
    return docs
