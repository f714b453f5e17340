"""A hierarchical Pitman-Yor language model over words.

Every context (the word before, by one of CONTEXTS hash values, a fixed number) is a restaurant; they share one parent,
whose base is uniform over the known words and one unknown. Seatings are sampled by block Gibbs: in a sweep every word
of every context is seated anew, as one block, given the table totals of all restaurants after the sweep before. The
predictive probabilities after the sweeps that count are averaged, and their logarithms summed by text.

Words are dealt to parts by hash, with the documents and contexts they occur in; a part holds all counts of its words,
so a sweep needs only the table totals per context (a fixed number of sums) from the other parts. Seatings are not
stored: a part replays them from its seed, so a lost task or a later pass gets the same ones. Sweeps read only a part's
counts, at most CONTEXTS for a word; its tokens are kept in rows of about CELL_BYTES, however frequent a word is.

Cases: null and empty texts are one end token; without training texts every word is unknown; rows with equal or null
ids are scored one by one (a null id counts as training text); texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portentia.llm import arrays as A
from portentia.llm.common import partitions
from portentia.runtime import stage

CONTEXTS = 1 << 16
#: Discount and strength of the context restaurants and of their parent; sweeps, and how many of the last ones count.
DISCOUNT, STRENGTH = 0.75, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.5, 10.0
SWEEPS, SAMPLES = 3, 2
BLOCK, BLOCK_DOCS, PART_BYTES = 4 << 20, 1 << 16, 2 << 20
#: Bytes of parts that go to Python at a time: a part is one row, and Spark's default of 64 MB would be some twenty of them; one goes alone.
BATCH_BYTES = 1 << 20
#: Bytes of tokens of a part in one row, and rows in a file of parts: Spark reads the rows of a file together.
CELL_BYTES, FILE_ROWS = 8 << 20, 6
#: Bytes of scores of documents that a task adds up over its parts before it hands them on.
HELD_BYTES = 20 << 20
U64 = np.uint64
END = U64(0x5851F42D4C957F2D)
OTHER = 0.1  # added to every count of the base score


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables that so many customers of one dish take, each opening one with odds weight : seated - discount
    * tables. The first 32 come one by one, later ones in groups of a sixteenth of those seated."""
    tables = np.minimum(customers, 1).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    n, t, a, c = np.ones(len(live)), np.ones(len(live)), weight[live], customers[live].astype(np.float64)
    while len(live):
        group = np.minimum(np.maximum(1.0, np.where(n < 32, 1.0, np.floor(n / 16))), c - n)
        p = np.clip(a / (a + n - discount * t), 0.0, 1.0)
        single = group == 1
        opened = (rng.random(len(live)) < p).astype(np.float64)
        if not single.all():
            opened[~single] = rng.binomial(group[~single].astype(np.int64), p[~single])
        t += opened
        n += group
        done = n >= c
        if done.any():
            tables[live[done]] = t[done]
            live, n, t, a, c = live[~done], n[~done], t[~done], a[~done], c[~done]
    return tables


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Words, contexts and document numbers of about BLOCK bytes of text, with ids, held-out flags and token counts."""
    held: list[list[np.ndarray]] = [[], [], [], [], [], []]
    ids: list = []
    size = base = 0
    for batch in (b.slice(k, BLOCK_DOCS // 2) for b in batches for k in range(0, b.num_rows, BLOCK_DOCS // 2)):
        flags = batch.column("held_out").to_numpy(zero_copy_only=False)
        names = batch.column("doc_id").to_pylist()
        for at, end, data, offs in A.slices(batch.column("text")):
            n = end - at
            if base + n > BLOCK_DOCS:  # document numbers of a block have 16 bits
                yield ids, *(np.concatenate(h) for h in held[:5])
                held, ids, size, base = [[], [], [], [], [], []], [], 0, 0
            rows, hashes, _ = A.words(data, offs, lower=True)
            counts = np.bincount(rows, minlength=n)
            place = np.cumsum(counts + 1) - 1  # of the end token of each row
            words = np.empty(len(rows) + n, dtype=U64)
            words[place] = END
            inner = np.ones(len(words), dtype=bool)
            inner[place] = False
            words[inner] = hashes
            before = np.empty(len(words), dtype=U64)
            before[1:] = words[:-1]
            before[np.concatenate([[0], place[:-1] + 1])] = 0
            doc = np.repeat(np.arange(n), counts + 1) + base
            for store, value in zip(held, (words, (A.mix(before) >> U64(48)).astype(np.uint16), doc.astype(np.uint16), flags[at:end], counts + 1)):
                store.append(value)
            ids += names[at:end]
            base, size = base + n, size + len(data)
            if size >= BLOCK:
                yield ids, *(np.concatenate(h) for h in held[:5])
                held, ids, size, base = [[], [], [], [], [], []], [], 0, 0
    if ids:
        yield ids, *(np.concatenate(h) for h in held[:5])


def deal(docs: DataFrame, parts: int) -> DataFrame:
    """(part, block, payload, ids, held, tokens): the tokens of each block by part of the word, and one row (a
    negative part) with the documents of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for ids, words, context, doc, held_out, tokens in _blocks(batches):
            block = (task << 24) + seq
            seq += 1
            rank = np.argsort(held_out, kind="stable")  # training documents come first, so that flags compress
            number = np.empty(len(rank), dtype=np.uint16)
            number[rank] = np.arange(len(rank))
            doc, ids, held_out, tokens = number[doc], [ids[k] for k in rank.tolist()], held_out[rank], tokens[rank]
            part = (A.mix(words) % U64(parts)).astype(np.int64)
            order = np.lexsort((context, words, part))
            words, context, doc, part = words[order], context[order], doc[order], part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            flags = np.packbits(held_out)
            rows = []
            for k in np.flatnonzero(np.diff(edges)):
                w = words[edges[k] : edges[k + 1]]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                head = np.array([len(first), len(w), len(flags)], dtype="<u4").tobytes()
                counts = np.diff(np.append(first, len(w))).astype("<u4")
                payload = head + w[first].tobytes() + counts.tobytes() + context[edges[k] : edges[k + 1]].tobytes()
                rows.append((int(k), payload + doc[edges[k] : edges[k + 1]].tobytes() + flags.tobytes()))
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows] + [-1 - block % parts], pa.int32()), pa.array([block] * (len(rows) + 1), pa.int64()),
                    pa.array([r[1] for r in rows] + [None], pa.binary()), pa.array(none + [ids], pa.list_(pa.int64())),
                    pa.array(none + [held_out.tolist()], pa.list_(pa.bool_())),
                    pa.array(none + [tokens.tolist()], pa.list_(pa.int64())),
                ],
                names=["part", "block", "payload", "ids", "held", "tokens"],
            )

    schema = "part int, block long, payload binary, ids array<bigint>, held array<boolean>, tokens array<bigint>"
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


class Counts:
    """Distinct words and pairs of word and context of one part, and how many training tokens each has."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, customers: np.ndarray):
        self.words, self.pairs, self.customers = words, pairs, customers
        self.pair_word, self.context = (pairs >> U64(16)).astype(np.int64), (pairs & U64(0xFFFF)).astype(np.int64)
        self.word_count = np.bincount(self.pair_word, weights=customers, minlength=len(words)).astype(np.int64)

    def places(self, other: Counts) -> np.ndarray:
        """Where the pairs of `other`, all of them among these, are."""
        word = np.searchsorted(self.words, other.words).astype(np.uint64)
        return np.searchsorted(self.pairs, word[other.pair_word] << U64(16) | other.context.astype(np.uint64)).astype(np.uint32)

    def plus(self, other: Counts) -> Counts:
        words = np.union1d(self.words, other.words)
        keys = [np.searchsorted(words, c.words).astype(np.uint64)[c.pair_word] << U64(16) | c.context.astype(np.uint64) for c in (self, other)]
        pairs = np.union1d(*keys)
        customers = np.zeros(len(pairs), dtype=np.int64)
        for key, c in zip(keys, (self, other)):
            customers[np.searchsorted(pairs, key)] += c.customers
        return Counts(words, pairs, customers)

    def packed(self) -> bytes:
        many = np.flatnonzero(self.customers > 254)
        head = np.array([len(self.words), len(self.pairs), len(many)], dtype="<u4").tobytes()
        per_word = np.bincount(self.pair_word, minlength=len(self.words)).astype("<u4")
        few = np.minimum(self.customers, 255).astype(np.uint8)
        return head + self.words.astype("<u8").tobytes() + per_word.tobytes() + self.context.astype("<u2").tobytes() + few.tobytes() + (
            many.astype("<u4").tobytes() + self.customers[many].astype("<i8").tobytes())

    @classmethod
    def unpacked(cls, raw: bytes) -> Counts:
        v, n, m = np.frombuffer(raw, "<u4", 3).tolist()
        words = np.frombuffer(raw, "<u8", v, 12)
        per_word = np.frombuffer(raw, "<u4", v, at := 12 + 8 * v)
        context = np.frombuffer(raw, "<u2", n, at := at + 4 * v)
        customers = np.frombuffer(raw, np.uint8, n, at := at + 2 * n).astype(np.int64)
        many = np.frombuffer(raw, "<u4", m, at := at + n)
        customers[many] = np.frombuffer(raw, "<i8", m, at + 4 * m)
        return cls(words, np.repeat(np.arange(v, dtype=U64), per_word) << U64(16) | context, customers)


class Part(Counts):
    """The tokens of one part, or some of them and the counts of the whole part: for every block its pairs, how often each
    occurs there, and the documents in that order. Tokens are never put together: a frequent word has many."""

    def __init__(self, blocks: list[int], payloads: list[bytes], whole: Counts | None = None):
        self.blocks, self.cells = blocks, []
        words, numbers, contexts, customers, base = [], [], [], [], 0
        for payload in payloads:
            v, n, f = np.frombuffer(payload, "<u4", 3).tolist()
            at = 12
            words.append(np.frombuffer(payload, "<u8", v, at))
            counts = np.frombuffer(payload, "<u4", v, at := at + 8 * v)
            context = np.frombuffer(payload, "<u2", n, at := at + 4 * v)
            docs = np.frombuffer(payload, "<u2", n, at := at + 2 * n)
            flags = np.unpackbits(np.frombuffer(payload, np.uint8, f, at + 2 * n))
            word = np.repeat(np.arange(base, base + v, dtype=np.uint32), counts)
            base += v
            new = np.ones(n + 1, dtype=bool)
            new[1:-1] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
            first = np.flatnonzero(new)
            numbers.append(word[first[:-1]])
            contexts.append(context[first[:-1]])
            customers.append(np.add.reduceat(flags[docs] == 0, first[:-1], dtype=np.uint32))
            self.cells.append((np.diff(first).astype(np.uint32), docs))
        used, number = np.unique(np.concatenate(words), return_inverse=True)
        key = number.astype(np.uint64)[np.concatenate(numbers)]
        key <<= U64(16)
        key |= np.concatenate(contexts)
        edges = np.cumsum([len(c) for c in contexts])[:-1]
        del words, number, numbers, contexts
        pairs, place = np.unique(key, return_inverse=True)  # distinct (word, context)
        super().__init__(used, pairs, np.bincount(place, weights=np.concatenate(customers), minlength=len(pairs)).astype(np.int64))
        if whole is not None:
            place = whole.places(self)[place]
            super().__init__(whole.words, whole.pairs, whole.customers)
        self.places = np.split(place.astype(np.uint32), edges)


@dataclass
class Totals:
    """What a sweep leaves for the next: sums over all parts."""

    tables: np.ndarray  # by context
    parent_customers: int
    parent_tables: int


@dataclass
class Model:
    tokens: int = 0
    vocabulary: int = 0
    customers: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS))
    sweeps: list[Totals] = field(default_factory=list)

    def parent(self, total: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of every word of a part in the parent restaurant."""
        new = (PARENT_STRENGTH + PARENT_DISCOUNT * total.parent_tables) / (self.vocabulary + 1)
        return (np.maximum(customers - PARENT_DISCOUNT * tables, 0) + new) / (PARENT_STRENGTH + total.parent_customers)

    def replay(self, part: Counts, number: int, seed: int, sweeps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tables by pair, parent customers by word, parent tables by word) at the start and after each sweep."""
        tables = np.minimum(part.customers, 1)
        for s in range(sweeps + 1):
            rng = np.random.Generator(np.random.Philox(key=seed, counter=[number, s, 0, 0]))
            if s:
                total = self.sweeps[s - 1]
                base = self.parent(total, customers, parent_tables)[part.pair_word]
                tables = seat(part.customers, (STRENGTH + DISCOUNT * total.tables[part.context]) * base, DISCOUNT, rng)
            customers = np.bincount(part.pair_word, weights=tables, minlength=len(part.words)).astype(np.int64)
            known = PARENT_STRENGTH / (self.vocabulary + 1)
            parent_tables = seat(customers, np.full(len(customers), known), PARENT_DISCOUNT, rng)
            yield tables, customers, parent_tables

    def score(self, part: Counts, number: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and base score of every distinct pair."""
        total_p = np.zeros(len(part.pairs))
        samples = range(len(self.sweeps) - SAMPLES, len(self.sweeps))
        for s, (tables, customers, parent_tables) in enumerate(self.replay(part, number, seed, len(self.sweeps) - 1)):
            if s in samples:
                total = self.sweeps[s]
                base = self.parent(total, customers, parent_tables)[part.pair_word]
                new = STRENGTH + DISCOUNT * total.tables[part.context]
                total_p += (np.maximum(part.customers - DISCOUNT * tables, 0) + new * base) / (STRENGTH + self.customers[part.context])
        share = (part.word_count + OTHER) / (self.tokens + OTHER * (self.vocabulary + 1))
        return np.log10(total_p / SAMPLES), np.log10(share)[part.pair_word]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part]]:
    """Parts by their cells; where `pairs` has the counts of the whole part, the cells may be some of it."""
    for batch in batches:
        whole = batch.column("pairs") if "pairs" in batch.schema.names else pa.nulls(batch.num_rows)
        for k in range(batch.num_rows):
            cells = batch.column("cells")[k].as_py()
            cells.sort(key=lambda c: c["block"])
            counts = Counts.unpacked(whole[k].as_py()) if whole[k].is_valid else None
            yield batch.column("part")[k].as_py(), Part([c["block"] for c in cells], [c["payload"] for c in cells], counts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Counts]]:
    for batch in batches:
        if "pairs" not in batch.schema.names:
            yield from _read([batch])
            continue
        for number, raw in zip(batch.column("part").to_pylist(), batch.column("pairs")):
            yield number, Counts.unpacked(raw.as_py())


GATHERED = "part int, row int, pairs binary, cells array<struct<block:bigint,payload:binary>>, block long, ids array<bigint>, held array<boolean>, tokens array<bigint>"


def gathered(dealt: DataFrame) -> DataFrame:
    """The rows of `deal` by part: rows, numbered from 0, of about CELL_BYTES of its tokens (cells), of which the last has the
    counts of the whole part (pairs); rows of documents go through."""
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.struct([("block", pa.int64()), ("payload", pa.binary())])), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    names = ["part", "row", "pairs", "cells", "block", "ids", "held", "tokens"]

    def row(number: int, at: int, pairs: bytes | None, cells: dict[int, bytes]) -> pa.RecordBatch:
        values = [at, pairs, [{"block": b, "payload": p} for b, p in cells.items()], None, None, None, None]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x], t) for x, t in zip(values, kinds))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, whole, cells, size = -1, 0, None, {}, 0

        def counted() -> Counts:
            own = Part(list(cells), list(cells.values()))
            return own if whole is None else whole.plus(own)

        for batch in batches:
            part = batch.column("part").to_numpy()
            documents = batch.filter(pa.array(part < 0))
            if documents.num_rows:
                none = [pa.nulls(documents.num_rows, t) for t in kinds[:3]]
                yield pa.RecordBatch.from_arrays([documents.column("part"), *none, *(documents.column(c) for c in names[4:])], names=names)
            blocks, payloads = batch.column("block").to_pylist(), batch.column("payload")
            for k in np.flatnonzero(part >= 0).tolist():
                if part[k] != number or size >= CELL_BYTES:
                    if cells:
                        whole = counted()
                        yield row(number, at, whole.packed() if part[k] != number else None, cells)
                    at, whole = (at + 1, whole) if part[k] == number else (0, None)
                    cells, size = {}, 0
                    number = int(part[k])
                cells[blocks[k]] = payloads[k].as_py()
                size += len(cells[blocks[k]])
        if cells:
            yield row(number, at, counted().packed(), cells)

    return dealt.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, GATHERED)


def _sums(parts: DataFrame, run, names: int) -> tuple[np.ndarray, list[int]]:
    """Sums over parts of an array by context and of a few numbers. Only CONTEXTS rows reach the driver."""
    measured = parts.mapInArrow(run, "place array<int>, value array<bigint>")
    rows = measured.select(F.explode(F.arrays_zip("place", "value")).alias("x")).groupBy("x.place").agg(F.sum("x.value").alias("n")).collect()
    by_context, others = np.zeros(CONTEXTS), [0] * names
    for place, n in rows:
        if place < CONTEXTS:
            by_context[place] = n
        else:
            others[place - CONTEXTS] = int(n)
    return by_context, others


def _row(by_context: np.ndarray, others: list[int]) -> pa.RecordBatch:
    used = np.flatnonzero(by_context)
    place = np.concatenate([used, CONTEXTS + np.arange(len(others))]).astype(np.int32)
    value = np.concatenate([by_context[used].astype(np.int64), np.array(others, dtype=np.int64)])
    return pa.RecordBatch.from_arrays([pa.array([place], pa.list_(pa.int32())), pa.array([value], pa.list_(pa.int64()))], names=["place", "value"])


def train(parts: DataFrame, seed: int = 1) -> Model:
    """Counts, then sweeps; one narrow pass over the parts for each."""
    model = Model()
    if "pairs" in parts.columns:
        parts = parts.where("pairs is not null").select("part", "pairs")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, others = np.zeros(CONTEXTS), np.zeros(2, dtype=np.int64)
        for _, part in _counts(batches):
            own += np.bincount(part.context, weights=part.customers, minlength=CONTEXTS)
            others += part.customers.sum(), (part.word_count > 0).sum()
        yield _row(own, others.tolist())

    model.customers, (model.tokens, model.vocabulary) = _sums(parts, count, 2)
    for s in range(SWEEPS + 1):

        def sweep(batches: Iterator[pa.RecordBatch], s: int = s) -> Iterator[pa.RecordBatch]:
            own, others = np.zeros(CONTEXTS), np.zeros(2, dtype=np.int64)
            for number, part in _counts(batches):
                for tables, customers, parent_tables in model.replay(part, number, seed, s):
                    pass
                own += np.bincount(part.context, weights=tables, minlength=CONTEXTS)
                others += customers.sum(), parent_tables.sum()
            yield _row(own, others.tolist())

        tables, (customers, parent_tables) = _sums(parts, sweep, 2)
        model.sweeps.append(Totals(tables, customers, parent_tables))
    return model


SCORES = "block long, payload binary, ids array<bigint>, held array<boolean>, tokens array<bigint>"


def score(blocks: DataFrame, parts: DataFrame, model: Model, seed: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of every document."""

    def added(held: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]]) -> pa.RecordBatch:
        """A row for each block: its documents that occur in the parts read, and their sums."""
        rows = []
        for entries in held.values():
            seen, sums = entries[0]
            if len(entries) > 1:
                docs = np.concatenate([e[0] for e in entries])
                size = int(docs.max()) + 1
                seen = np.flatnonzero(np.bincount(docs, minlength=size))
                sums = [np.bincount(docs, weights=np.concatenate([e[1][k] for e in entries]), minlength=size)[seen] for k in range(3)]
            rows.append(np.array([len(seen)], "<u4").tobytes() + seen.astype("<u2").tobytes() + b"".join(
                x.astype(t).tobytes() for x, t in zip(sums, ("<f8", "<f8", "<u4"))))
        none = pa.nulls(len(rows), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array(rows, pa.binary()), none, pa.nulls(len(rows), pa.list_(pa.bool_())), none],
            names=["block", "payload", "ids", "held", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]] = {}
        total = 0
        for number, part in _read(batches):
            logs, base = model.score(part, number, seed)
            known = (part.word_count > 0)[part.pair_word]
            for block, (counts, docs), place in zip(part.blocks, part.cells, part.places):
                pair = np.repeat(place, counts)
                size = int(docs.max()) + 1
                seen = np.flatnonzero(np.bincount(docs, minlength=size))
                sums = [np.bincount(docs, weights=x[pair], minlength=size)[seen] for x in (logs, base, known)]
                held.setdefault(block, []).append((seen.astype(np.uint16), [*sums[:2], sums[2].astype(np.uint32)]))
                total += 22 * len(seen)
            if total >= HELD_BYTES:
                yield added(held)
                held, total = {}, 0
        if held:
            yield added(held)

    def add(table: pa.Table) -> pa.Table:
        head = next(k for k in range(table.num_rows) if table.column("ids")[k].is_valid)
        ids, held, tokens = (table.column(c)[head].as_py() for c in ("ids", "held", "tokens"))
        sums = np.zeros((3, len(ids)))
        for payload in table.column("payload"):
            data = payload.as_py()
            if data is not None:
                n = int(np.frombuffer(data, "<u4", 1)[0])
                seen = np.frombuffer(data, "<u2", n, 4)
                at = 4 + 2 * n
                for k, (kind, width) in enumerate((("<f8", 8), ("<f8", 8), ("<u4", 4))):
                    sums[k, seen] += np.frombuffer(data, kind, n, at)
                    at += width * n
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens, pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    if "pairs" in parts.columns:  # other rows of a part get the counts that its last row has
        last = parts.where("pairs is not null")
        rest = parts.where("pairs is null").drop("pairs").join(last.where("row > 0").select("part", "pairs"), "part")
        parts = last.unionByName(rest)
    made = parts.mapInArrow(run, SCORES).unionByName(blocks)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return made.groupBy("block").applyInArrow(add, schema)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token by held_out."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))


def language_model(docs: DataFrame, held_out, seed: int = 1) -> tuple[DataFrame, Model]:
    """Scores of all documents (doc_id, text) by a model trained on those for which the `held_out` column is false."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    flagged = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    dealt = gathered(deal(flagged, partitions(docs, PART_BYTES)))
    dealt = stage(dealt, "parts", maxRecordsPerFile=FILE_ROWS)  # a part is a bounded share of the words: their number grows with the input
    parts = dealt.where("part >= 0").select("part", "row", "pairs", "cells")
    blocks = dealt.where("part < 0").select("block", F.lit(None).cast("binary").alias("payload"), "ids", "held", "tokens")
    model = train(parts, seed)
    return score(blocks, parts, model, seed), model
