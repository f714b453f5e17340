"""Token ids as directly addressable codes in shared files.

A sequence of ids is split into chunks of eight bits by level: level 0 holds the low chunk of every id, level 1 the
next chunk of those that go on, and so on. A bitmap per level says which ids go on, and a rank directory (running
counts every 512 bits) gives their place in the next level. Any token is read by one look into each of its levels;
nothing before it is decoded.

The files are a Parquet dataset in the shared folder, so Spark's writer commits them and a lost task is simply repeated.
A row is a segment: whole documents in ascending doc_id order with SEGMENT tokens or a little more. Segments are
ordered by (shard, seq); a shard is one range of doc_id.

Cases: null and empty texts hold the end id only; null doc_ids come first; rows with equal doc_id are all kept, in any
order among themselves; a very long document makes one long segment; an empty table makes an empty dataset.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portentia.llm import arrays as A
from portentia.llm.common import partitions

SEGMENT = 1 << 16
CHUNK_BITS = 8
RANK_BYTES = 64
MAGIC = b"DAC1"
SEGMENTS = "shard int, seq int, first_token long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, codes binary"
#: White space that is not one of the six ASCII characters, and separators that some libraries count as such.
ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f\\u3000\\ufeff]")
#: Letters and the marks after them; not apostrophes, which may belong to an ending.
COMMON = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|<>()\"-]*)")
#: Words that a worker keeps for good, all met in two batches, and those met once before they are forgotten (together about 170 MB).
WORDS, FRESH = 500_000, 300_000
#: Bytes of text encoded at a time; of the words in it every different one is looked up once.
GATHERED = 3 << 20
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """Codes of a sequence of unsigned 32-bit ids."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >> np.uint32(CHUNK_BITS) > 0
        bitmap = np.packbits(more, bitorder="little")
        counts = POPCOUNT[bitmap]
        blocks = np.add.reduceat(counts, np.arange(0, len(counts), RANK_BYTES)) if len(counts) else counts
        directory = np.zeros(len(blocks) + 1, dtype="<u4")
        directory[1:] = np.cumsum(blocks)
        head = np.array([len(rest), len(bitmap), len(directory)], dtype="<u4")
        levels.append(head.tobytes() + (rest & np.uint32(255)).astype(np.uint8).tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[more] >> np.uint32(CHUNK_BITS)
        if not len(rest):
            return MAGIC + bytes((len(levels),)) + b"".join(levels)


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a sequence of codes")
        self.levels, at = [], 5
        for _ in range(data[4]):
            n, bits, ranks = np.frombuffer(data, "<u4", 3, at).tolist()
            at += 12
            chunk = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, bits, at + n)
            directory = np.frombuffer(data, "<u4", ranks, at + n + bits)
            at += n + bits + 4 * ranks
            self.levels.append((chunk, bitmap, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, i: int) -> int:
        """How many of the first i ids of a level go on."""
        _, bitmap, directory = self.levels[level]
        block, byte = i // (8 * RANK_BYTES), i // 8
        count = int(directory[block]) + int(POPCOUNT[bitmap[block * RANK_BYTES : byte]].sum())
        return count + (bin(int(bitmap[byte]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self.rank(level, i), shift + CHUNK_BITS
        return value

    def slice(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """Ids start .. end - 1, all levels at once."""
        chunk, bitmap, _ = self.levels[level]
        values = chunk[start:end].astype(np.uint32)
        first = start // 8
        bits = np.unpackbits(bitmap[first : (end + 7) // 8], bitorder="little")[start - 8 * first : end - 8 * first]
        more = np.flatnonzero(bits)
        if len(more):
            at = self.rank(level, start)
            values[more] |= self.slice(at, at + len(more), level + 1) << np.uint32(CHUNK_BITS)
        return values


class WordIds:
    """Ids of texts by a tokenizer that drops white space: words are encoded once and kept in a bounded cache. Words
    met again in a later batch stay in it, the others are forgotten from time to time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Text that the tokenizer takes for one of its added tokens, even inside a word.
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)", re.IGNORECASE)
        self.words: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}

    def _batch(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in done]

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters: each is one word to the tokenizer, so many go as one text."""
        out: list[bytes] = []
        for at in range(0, len(stems), 256):
            some = stems[at : at + 256]
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(done.ids, dtype="<u4").tobytes()
            ends = np.cumsum(np.bincount(np.array(done.word_ids, dtype=np.int64), minlength=len(some))) * 4
            out += [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of different words. Common ones (Latin letters, perhaps marks at the end) share the ids of their lower-case
        stem, as the tokenizer lower-cases and cuts marks off; other words are encoded as they are."""
        parts, wanted, plain = {}, set(), set()
        found = list(map(self.words.get, words))
        kept, fresh = self.words, self.fresh
        for k in [k for k, ids in enumerate(found) if ids is None]:
            word = words[k]
            ids = fresh.get(word)
            if ids is not None:
                found[k] = ids
                if len(kept) < WORDS:
                    kept[word] = ids
                continue
            common = COMMON.fullmatch(word)
            if common:
                stem = common[1].lower()
                parts[k] = stem, common[2]
                plain.add(stem)
                wanted.add(common[2])
            else:
                parts[k] = word, ""
                wanted.add(word)
        wanted |= plain
        wanted.discard("")
        stems = {w: kept.get(w) or fresh.get(w) for w in wanted}
        new = [w for w, ids in stems.items() if ids is None]
        letters, others = [w for w in new if w in plain], [w for w in new if w not in plain]
        stems.update(zip(letters, self._stems(letters)))
        stems.update(zip(others, self._batch(others)))
        fresh.update((w, stems[w]) for w in new if len(w) <= 64)
        stems[""] = b""
        for k, (stem, mark) in parts.items():
            found[k] = ids = stems[stem] + stems[mark]
            if len(words[k]) <= 64:
                fresh[words[k]] = ids
        if len(fresh) > FRESH:
            self.fresh = {}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of every text. Texts with unusual spaces or added tokens go to the tokenizer whole;
        of the others every different word is looked up once, and the ids are put together for all texts at a time."""
        odd = [k for k, t in enumerate(texts) if ODD_SPACE.search(t) or self.special.search(t)]
        whole = dict(zip(odd, self._batch([texts[k] for k in odd])))
        split = pc.ascii_split_whitespace(pa.array(["" if k in whole else t for k, t in enumerate(texts)], pa.large_string()))
        words = split.flatten().dictionary_encode()
        found = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = words.indices.to_numpy()
        n = size[word]
        end = np.cumsum(n)
        place = np.repeat((np.cumsum(size) - size)[word] - end + n, n) + np.arange(n.sum())
        ids = np.frombuffer(b"".join(found), dtype="<u4")[place]
        edges = np.append(0, end)[split.offsets.to_numpy()].tolist()
        return [whole[k] if k in whole else ids[a:b].tobytes() for k, (a, b) in enumerate(zip(edges, edges[1:]))]


_made: dict[str, WordIds] = {}


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about GATHERED bytes or more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Encode `docs` (doc_id, text) and write the dataset. One shuffle, by ranges of doc_id; no second pass."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _made:
            _made[tokenizer] = WordIds(tokenizer)
        coder, shard = _made[tokenizer], TaskContext.get().partitionId()
        ids, held, size, seq, first = [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            joined = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([len(joined)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())), pa.array([pack(joined)], pa.binary()),
                ],
                names=["shard", "seq", "first_token", "n_tokens", "doc_ids", "lengths", "codes"],
            )

        for batch in gathered(batches):
            for at, stop, _, _ in A.slices(batch.column("text"), GATHERED):
                part = batch.slice(at, stop - at)
                packed = coder.encode([x or "" for x in part.column("text").to_pylist()])
                for doc, one in zip(part.column("doc_id").to_pylist(), packed):
                    ids.append(doc)
                    held.append(one + end)
                    size += len(one) // 4 + 1
                    if size >= SEGMENT:
                        yield segment()
                        seq, first, size, ids, held = seq + 1, first + size, 0, [], []
        if ids:
            yield segment()

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SEGMENTS).write.mode("overwrite").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def shard_starts(segments: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before. One row per shard: the only thing ordered in one place."""
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def documents(segments: DataFrame) -> DataFrame:
    """shard, doc_id, local (start in the shard), n_tokens and ids (packed) of every document in the dataset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                codes, first = Codes(row.column("codes")[0].as_py()), row.column("first_token")[0].as_py()
                lengths = np.array(row.column("lengths")[0].as_py(), dtype=np.int64)
                starts = np.cumsum(lengths) - lengths
                ids = codes.slice(0, len(codes)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row.column("shard")[0].as_py()] * len(lengths), pa.int32()),
                        pa.array(row.column("doc_ids")[0].as_py(), pa.int64()), pa.array(starts + first),
                        pa.array(lengths), pa.array([ids[s : s + n].tobytes() for s, n in zip(starts, lengths)], pa.binary()),
                    ],
                    names=["shard", "doc_id", "local", "n_tokens", "ids"],
                )

    return segments.select("shard", "first_token", "doc_ids", "lengths", "codes").mapInArrow(
        run, "shard int, doc_id long, local long, n_tokens long, ids binary"
    )


def with_starts(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before. Join what is left of a document, not its ids."""
    return docs.join(shard_starts(segments), "shard").withColumn("start", F.col("base") + F.col("local")).drop("base")
