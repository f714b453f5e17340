"""Fuzzy duplicate lines across a corpus; one line of each group stays.

A line is the set of its character shingles, taken from its words in lower case (A-Z only) joined by single spaces:
case and runs of white space are no differences. With shingles of SHINGLE characters one changed character costs at most
SHINGLE shingles of each side, so at 80 percent it is found in lines from 49 characters on; shorter lines link when they
are equal in this form or differ near their ends. Equal lines (by a 64-bit hash) are one class. MinHash signatures are made
with one hash per shingle: its bins give the signature's values, empty bins borrow from others by a fixed sequence.
BANDS bands of BAND_ROWS values bring similar lines together; a pair counts only if the Jaccard similarity of its full
shingle sets, made from the lines' texts, reaches the threshold. Classes and links form components by distributed
union-find, and of each component the first line (smallest doc_id, then hash of the text, then line number) stays.

Band lists are treated as near_duplicates treats its lists: every member meets the most central one first, later only
members of different components meet. These compare, pair by pair in lists of any length (long ones in blocks), the smallest
hashes of PLACES ranges, and where those allow the threshold the full sets, which are made on the spot from the lines; none
is dropped, and only links that join components leave the task. A pair at exactly
80 percent is missed by all bands with probability (1 - 0.8 ** BAND_ROWS) ** BANDS, under 0.001, if its bins are filled;
borrowed bins of short lines raise that to below 0.01. Closer pairs are missed far less often.

Cases: lines without a word are never removed and belong to no group; null and empty texts have no lines to remove; lines
shorter than a shingle are one shingle; a row is known by its doc_id and its text, so different texts under one id (null
ids too, which sort first) keep their own line numbers; of rows with equal ids and texts one counts as the first, and the
others lose all lines with a word; very long lines and texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portentia.llm import arrays as A
from portentia.llm.common import components, partitions
from portentia.llm.near_duplicates import same_sets, several_components, shared_count, star_pairs, text_hash, with_components
from portentia.runtime import stage

SHINGLE = 5
BAND_ROWS, BANDS = 5, 18
BINS = BAND_ROWS * BANDS
BLOCK = 8 << 20
#: Members of a list that meet in one block, rows of lists and bytes of their lines in a task, and pairs compared at a time.
MEMBERS, PART_ROWS, PART_BYTES, MET = 1024, 1 << 13, 8 << 20, 1 << 13
#: Ranges of hashes of which members of a list show the smallest.
PLACES = 256
U64 = np.uint64
#: Where an empty bin looks for a value, attempt by attempt; the last attempts walk all bins.
BORROW = np.concatenate(
    [
        (A.mix(np.arange(24 * BINS, dtype=U64)) % U64(BINS)).astype(np.int64).reshape(24, BINS),
        (np.arange(BINS)[None, :] + np.arange(1, BINS)[:, None]) % BINS,
    ]
)


def shingles(points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of every character shingle; `points` are the code points of the lines, joined."""
    n = np.diff(offs)
    sums = A.prefix_sums(points)
    counts = np.maximum(n - SHINGLE + 1, 1)
    line = np.repeat(np.arange(len(n)), counts)
    start = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts) + offs[:-1][line]
    return line, A.span_hash(sums, start, np.minimum(start + SHINGLE, offs[1:][line]))


def folded(raw: bytes, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Joined UTF-8 lines, lower-cased (A-Z), their words joined by single spaces, and the new offsets."""
    data = A.LOWER[np.frombuffer(raw, np.uint8)]
    solid = ~A.SPACE[data]
    _, end = A.runs(solid, offs)
    line = np.searchsorted(offs, end, side="left")  # a word ends inside its line or with it
    gap = end[:-1][line[1:] == line[:-1]]
    data[gap], solid[gap] = 32, True
    count = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(solid, out=count[1:])
    return data[solid].tobytes(), count[offs]


def code_points(raw: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of joined UTF-8 lines, and their offsets."""
    begins = A.characters(np.frombuffer(raw, np.uint8))
    count = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(begins, out=count[1:])
    return np.frombuffer(raw.decode().encode("utf-32-le"), "<u4"), count[offs]


def signatures(line: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """BINS values for each of n lines (each must have a shingle; fewer than 2**18 lines, at most 256 bins)."""
    bins = ((hashes >> U64(32)) * U64(BINS)) >> U64(32)
    key = np.sort(line.astype(U64) << U64(46) | bins << U64(38) | hashes & U64((1 << 38) - 1))
    group = key >> U64(38)
    first = np.ones(len(key), dtype=bool)
    first[1:] = group[1:] != group[:-1]
    key, group = key[first], group[first].astype(np.int64)
    out, filled = np.zeros((n, BINS), dtype=U64), np.zeros((n, BINS), dtype=bool)
    at = group >> 8, group & 255
    out[at], filled[at] = key & U64((1 << 38) - 1), True
    rows, columns = np.nonzero(~filled)
    for source in BORROW:
        if not len(rows):
            break
        have = filled[rows, source[columns]]
        out[rows[have], columns[have]] = out[rows[have], source[columns[have]]]
        rows, columns = rows[~have], columns[~have]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """Hash of each band, (lines, BANDS)."""
    value = signature.reshape(len(signature), BANDS, BAND_ROWS)
    out = np.broadcast_to(A.mix(np.arange(1, BANDS + 1, dtype=U64)), value.shape[:2]).copy()
    for k in range(BAND_ROWS):
        out = A.mix(out ^ value[:, :, k]) + U64(A.BASE)
    return out


def same_row(other: DataFrame, doc_id: str, text: str) -> Column:
    """Do doc_id and text_hash name the row that the columns of `other` name?"""
    return F.col("doc_id").eqNullSafe(other[doc_id]) & (F.col("text_hash") == other[text])


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, doc_id, text_hash, line) of every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text_hash")
            for at, end, data, offs in A.slices(batch.column("text")):
                row, number, start, stop = A.lines(data, offs)
                h, row = A.span_hash(A.prefix_sums(data), start, stop), pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), ids.take(row), texts.take(row), pa.array(number.astype(np.int32))],
                    names=["h", "doc_id", "text_hash", "line"],
                )

    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(
        run, "h long, doc_id long, text_hash long, line int"
    )


def different_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, bytes]]:
    """Different lines with a word by their hash, about BLOCK bytes of them at a time."""
    texts: dict[int, bytes] = {}
    size = 0
    for batch in batches:
        for _, _, data, offs in A.slices(batch.column("text")):
            _, _, start, stop = A.lines(data, offs)
            raw = data.tobytes()
            for h, a, b in zip(A.span_hash(A.prefix_sums(data), start, stop).view(np.int64).tolist(), start.tolist(), stop.tolist()):
                if h not in texts:
                    texts[h] = raw[a:b]
                    size += b - a
            if size >= BLOCK:
                yield texts
                texts, size = {}, 0
    if texts:
        yield texts


def banded(docs: DataFrame, parts: int) -> DataFrame:
    """(part, payload): line hashes and band names, by part of the band; lines once per block of text. A band is named in its
    part by 40 bits of its hash: lines that meet by chance are compared as others are."""

    def flush(texts: dict[int, bytes]) -> pa.RecordBatch:
        node = np.array(list(texts), dtype=np.int64)
        found = []
        chunk: list[bytes] = []
        size = 0
        for raw in (*texts.values(), None):
            if raw is None or size > A.SLICE_BYTES:
                points, offs = code_points(*folded(b"".join(chunk), np.cumsum([0, *map(len, chunk)])))
                line, hashes = shingles(points, offs)
                found.append(bands(signatures(line, hashes, len(chunk))))
                chunk, size = [], 0
            if raw is not None:
                chunk.append(raw)
                size += len(raw)
        band = np.concatenate(found)
        band, node = band.reshape(-1), np.repeat(node, BANDS)
        part = (band % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        name, node, edges = (band[order] // U64(parts)), node[order], np.searchsorted(part[order], np.arange(parts + 1))
        columns = node.astype("<i8"), (name & U64(0xFFFFFFFF)).astype("<u4"), (name >> U64(32) & U64(0xFF)).astype(np.uint8)
        used = np.flatnonzero(np.diff(edges))
        payloads = [b"".join(c[edges[k] : edges[k + 1]].tobytes() for c in columns) for k in used]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(payloads, pa.binary())], names=["part", "payload"])

    return docs.select("text").mapInArrow(lambda batches: map(flush, different_lines(batches)), "part int, payload binary")


def meeting(table: pa.Table, parts: int) -> pa.Table:
    """(v, id, df) of the bands of one part in which several lines meet."""
    bands, nodes = [], []
    for payload in table.column("payload"):
        raw = payload.as_buffer()
        n = raw.size // 13
        nodes.append(np.frombuffer(raw, "<i8", n))
        bands.append(np.frombuffer(raw, np.uint8, n, 12 * n).astype(U64) << U64(32) | np.frombuffer(raw, "<u4", n, 8 * n))
    band, node = np.concatenate(bands) * U64(parts) + U64(table.column("part")[0].as_py()), np.concatenate(nodes)
    order = np.lexsort((node, band))
    band, node = band[order], node[order]
    new = np.ones(len(band), dtype=bool)
    new[1:] = (band[1:] != band[:-1]) | (node[1:] != node[:-1])
    band, node = band[new], node[new]
    at = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
    counts = np.diff(np.append(at, len(band)))
    df = np.repeat(counts, counts)
    several = df > 1
    return pa.table(
        [pa.array(band[several].view(np.int64)), pa.array(node[several]), pa.array(df[several])],
        names=["v", "id", "df"],
    )


def line_set(raw: bytes) -> np.ndarray:
    return unpacked([raw])[0]


def in_slices(raws: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Joined lines and their offsets, about SLICE_BYTES at a time."""
    chunk: list[bytes] = []
    size = 0
    for raw in raws:
        chunk.append(raw)
        size += len(raw)
        if size > A.SLICE_BYTES:
            yield b"".join(chunk), np.cumsum([0, *map(len, chunk)])
            chunk, size = [], 0
    if chunk:
        yield b"".join(chunk), np.cumsum([0, *map(len, chunk)])


def unpacked(raws: list[bytes]) -> list[np.ndarray]:
    """The shingle sets of lines, sorted."""
    out = []
    for raw, offs in in_slices(raws):
        line, hashes = shingles(*code_points(*folded(raw, offs)))
        edges = np.searchsorted(line, np.arange(len(offs)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            one = np.sort(hashes[a:b])
            new = np.ones(b - a, dtype=bool)
            np.not_equal(one[1:], one[:-1], out=new[1:])
            out.append(one[new])
    return out


def line_texts(docs: DataFrame, met: DataFrame, parts: int) -> DataFrame:
    """(id, s): the bytes of the lines whose hashes are in `met` (id), each once. Lines go to the parts of their hashes in
    compressed pieces, one a part for BLOCK bytes of text."""

    def flush(texts: dict[int, bytes]) -> pa.RecordBatch:
        h, raws = np.array(list(texts), dtype="<i8"), list(texts.values())
        part = h % parts
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        used, payloads = np.flatnonzero(np.diff(edges)), []
        for k in used.tolist():
            own = order[edges[k] : edges[k + 1]]
            mine = [raws[x] for x in own.tolist()]
            raw = h[own].tobytes() + np.array([len(x) for x in mine], dtype="<u4").tobytes() + b"".join(mine)
            payloads.append(np.array([len(raw), len(own)], dtype="<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(payloads, pa.binary())], names=["part", "payload"])

    def pick(lines: pa.Table, met: pa.Table) -> pa.Table:
        wanted = np.unique(met.column("id").to_numpy())
        open_, ids, texts = np.ones(len(wanted), dtype=bool), [], []
        for payload in lines.column("payload") if len(wanted) else ():
            data = payload.as_buffer()
            size, n = np.frombuffer(data, "<i8", 2).tolist()
            raw = pa.decompress(data.slice(16), size, "zstd")
            h, length = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u4", n, 8 * n)
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            new = (wanted[at] == h) & open_[at]
            open_[at[new]] = False
            ends = np.cumsum(np.append(0, length)).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), raw.slice(12 * n)])
            ids.append(h[new])
            texts.append(held.filter(pa.array(new)))
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *ids])), pa.chunked_array(texts, pa.binary())], names=["id", "s"])

    pieces = docs.select("text").mapInArrow(lambda batches: map(flush, different_lines(batches)), "part int, payload binary")
    places = met.select(F.pmod("id", F.lit(parts)).cast("int").alias("part"), "id")
    return pieces.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(pick, "id long, s binary")


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A byte of the smallest hash in each of PLACES ranges, for every set; 0 where a range is empty."""
    out = np.zeros((len(sets), PLACES), dtype=np.uint8)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    hashes = np.concatenate([np.zeros(0, U64), *sets])
    place = ((hashes >> U64(32)) * U64(PLACES) >> U64(32)).astype(np.int64)
    first = np.ones(len(hashes), dtype=bool)  # sets are sorted, so of each range the smallest comes first
    first[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1])
    out[of[first], place[first]] = hashes[first] % U64(255) + U64(1)
    return out


def line_signatures(texts: DataFrame) -> DataFrame:
    """The lines (id, s, ...) with n and m: how many shingles they have and a byte for each of PLACES ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first, of = np.unique(batch.column("id").to_numpy(), return_index=True, return_inverse=True)
            sets = unpacked(batch.column("s").take(pa.array(first)).to_pylist())
            n, m = pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in minima(sets)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, n.take(pa.array(of)), m.take(pa.array(of))], names=[*batch.schema.names, "n", "m"])

    return texts.mapInArrow(run, T.StructType([*texts.schema, T.StructField("n", T.IntegerType()), T.StructField("m", T.BinaryType())]))


def may_reach(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Do the smallest hashes of two rows agree as often as those of a pair at the threshold all but surely do (six standard
    deviations below the mean, over the ranges that one of them fills)?"""
    t = percent / 100
    filled = ((a | b) > 0).sum(axis=1)
    return ((a == b) & (a > 0)).sum(axis=1) >= filled * t - 6 * (filled * t * (1 - t)) ** 0.5


def joining(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) that join the components of members that meet in lists: every pair of a list is compared unless links
    found before have joined its components already, so there are fewer links than members."""
    columns = ("v", "lower", "upper", "block", "id", "comp", "n")
    v, lower, upper, block, id_, comp, n = (table.column(c).to_numpy() for c in columns)
    order = np.lexsort((id_, upper, lower, v))
    v, lower, upper, block, id_, comp, n = (x[order] for x in (v, lower, upper, block, id_, comp, n))
    comp = np.unique(comp, return_inverse=True)[1]
    packed, text = table.column("m").to_pylist(), table.column("s")
    value = np.frombuffer(b"".join(packed[k] for k in order.tolist()), np.uint8).reshape(-1, PLACES)
    new = np.ones(len(v) + 1, dtype=bool)
    new[1:-1] = (v[1:] != v[:-1]) | (lower[1:] != lower[:-1]) | (upper[1:] != upper[:-1])
    edges = np.flatnonzero(new)
    end = np.repeat(edges[1:], np.diff(edges))
    sets: dict[int, np.ndarray] = {}  # by id, of the lines whose smallest hashes allow a link
    found = []
    at = np.arange(len(v))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < end[at]]
        for k in range(0, len(at), MET):
            i = at[k : k + MET]
            j = i + step
            fits = (comp[i] != comp[j]) & ((lower[i] == upper[i]) | (block[i] != block[j]))
            fits &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            fits = may_reach(value[i], value[j], percent)
            i, j = i[fits], j[fits]
            wanted = {int(id_[x]): int(order[x]) for x in np.unique(np.concatenate([i, j])).tolist() if int(id_[x]) not in sets}
            sets |= zip(wanted, unpacked([text[x].as_py() for x in wanted.values()]))
            for x, y in zip(i.tolist(), j.tolist()):
                if comp[x] != comp[y]:
                    one, other = sets[int(id_[x])], sets[int(id_[y])]
                    shared = shared_count(one, other)
                    if shared and 100 * shared >= percent * (len(one) + len(other) - shared):
                        found.append((min(id_[x], id_[y]), max(id_[x], id_[y])))
                        comp[comp == comp[y]] = comp[x]
    return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def meeting_pairs(lists: DataFrame, texts: DataFrame, parts: int, percent: int) -> DataFrame:
    """Similar pairs (a, b) of members of lists (v, id, df, comp) that join their components, by their lines (id, s) or
    the `line_signatures` of these; those of a member are made where its lists meet its line, which then lie together.

    Members of a list of more than MEMBERS are dealt to blocks by hash, and each block meets every other; a meeting holds
    two blocks at most, and a part the meetings of some lists.
    """
    blocks = F.ceil(F.col("df") / MEMBERS).cast("int")
    placed = lists.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lower": F.least("block", "other"), "upper": F.greatest("block", "other")})
    met = met.withColumn("part", F.pmod(F.xxhash64("v", "lower", "upper"), F.lit(parts)))
    met = met.select("part", "v", "lower", "upper", "block", "id", "comp").join(texts, "id")
    met = met if "m" in texts.columns else line_signatures(met)
    groups = met.select("part", "v", "lower", "upper", "block", "id", "comp", "n", "m", "s").groupBy("part")
    return groups.applyInArrow(lambda table: joining(table, percent), "a long, b long").distinct()


def worded_and_gone(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The lines with a word, as `occurrences` gives them, and what `duplicate_lines` gives."""
    seen = stage(occurrences(docs), "lines")
    first = F.min(F.struct("doc_id", "text_hash", "line")).alias("first")
    classes = stage(seen.groupBy(F.col("h").alias("id")).agg(first, F.count("*").alias("n")), "classes")
    parts = partitions(docs)
    met = stage(banded(docs, parts).groupBy("part").applyInArrow(lambda table: meeting(table, parts), "v long, id long, df long"), "met")
    texts = stage(line_texts(docs, met, parts), "line_texts", compression="zstd")
    pairs = stage(star_pairs(met), "pairs")
    links = stage(same_sets(pairs, texts, percent, unpacked), "links")
    found = stage(components(links), "components")
    apart = stage(several_components(with_components(met.where("df > 2"), found)), "apart")
    blocks = F.ceil(F.col("df") / MEMBERS)
    sizes = texts.select("id", F.octet_length("s").alias("size"))
    rows, size = apart.join(sizes, "id").agg(F.coalesce(F.sum(blocks), F.lit(0)), F.coalesce(F.sum(blocks * F.col("size")), F.lit(0))).first()
    joined = stage(meeting_pairs(apart, texts, max(parts, rows // PART_ROWS + 1, size // PART_BYTES + 1), percent), "links")
    grouped = with_components(classes, found)
    if not joined.isEmpty():
        sides = [with_components(joined.select("a", "b", F.col(c).alias("id")), found).select("a", "b", F.col("comp").alias(f"c{c}")) for c in "ab"]
        over = stage(components(sides[0].join(sides[1], ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "components")
        grouped = grouped.join(over, F.col("comp") == over["node"], "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component")
    kept = grouped.groupBy("comp").agg(F.min("first").alias("kept"), F.sum("n").alias("total")).where("total > 1")
    gone = seen.join(grouped.select(F.col("id").alias("h"), "comp").join(kept, "comp").select("h", "kept"), "h")
    gone = gone.where(~F.struct("doc_id", "text_hash", "line").eqNullSafe(F.col("kept")))
    return seen, line_numbers(gone)


def line_numbers(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def duplicate_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, text_hash and removed (array of line numbers from 0): the lines that are not the first of their component."""
    return worded_and_gone(docs, percent)[1]


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)


def _worded(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines, n_removed and removed of every row of (doc_id, text)."""
    seen, gone = worded_and_gone(docs, percent)
    gone = gone.toDF("d", "t", "removed")
    rows = docs.select("doc_id", text_hash().alias("text_hash"), F.size(_lines()).cast("long").alias("n_lines"))
    rows = stage(rows.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.count("*").alias("n")), "rows")
    none = F.array().cast("array<int>")
    first = rows.join(gone, same_row(gone, "d", "t"), "left").select("doc_id", "n_lines", F.coalesce("removed", none).alias("removed"))
    # of equal rows all but one lose every line with a word
    again = rows.where("n > 1").toDF("d", "t", "n_lines", "n")
    worded = line_numbers(seen.join(again, same_row(again, "d", "t"), "left_semi"))
    copied = again.join(worded, same_row(again, "d", "t"), "left").withColumn("doc_id", F.col("d"))
    more = copied.select(
        "doc_id", "n_lines", F.coalesce("removed", none).alias("removed"), F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("copy")
    )
    return first.unionByName(more.drop("copy")).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all columns, their texts without the removed lines. A text that loses its last line with
    a word goes: all it held stays elsewhere."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = duplicate_lines(named, percent).toDF("__d", "__t", "__gone")
    kept = F.filter(_lines(), lambda line, k: ~F.array_contains(F.col("__gone"), k))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row")).withColumns(
        {"__key": F.col("__row.doc_id").cast("long"), "text": F.col("__row.text").cast("string")}
    ).withColumn("__hash", text_hash())
    joined = held.join(gone, held["__key"].eqNullSafe(gone["__d"]) & (held["__hash"] == gone["__t"]), "left").withColumn("__left", text)
    left = joined.where(F.col("__gone").isNull() | _worded(F.col("__left")))
    row = F.struct(*[F.col("__left").alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    left = left.select(row.alias("__row"), "__key", "__hash")
    again = named.where(_worded(F.col("text"))).groupBy("doc_id", text_hash().alias("text_hash")).agg(F.count("*").alias("n")).where("n > 1")
    again = stage(again.select("doc_id", "text_hash"), "copied").toDF("__c", "__u")
    if again.isEmpty():
        return left.select("__row.*")
    # of equal rows with a word one stays
    copied = left["__key"].eqNullSafe(again["__c"]) & (left["__hash"] == again["__u"])
    one = left.join(again, copied, "left_semi").dropDuplicates(["__key", "__hash"])
    return left.join(again, copied, "left_anti").unionByName(one).select("__row.*")
