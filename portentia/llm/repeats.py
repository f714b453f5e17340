"""Removal of byte strings of LENGTH or more that occur earlier in the corpus, by suffix arrays over shards.

Equal strings must meet in one shard. Every window of LENGTH bytes is dealt by the smallest hash among its GRAM-byte
substrings, which depends on its bytes only; neighbouring windows mostly share it, so what is dealt are segments (runs
of windows with one smallest hash). Segments whose hash is met nowhere else cannot hold a repeat and go no further.
Equal segments are collapsed to their earliest copy, the others being repeats as a whole. The texts of the remaining
ones are sorted in shards: a suffix array by induced sorting, common prefixes in text order, and of every group of
suffixes that share LENGTH bytes all but the earliest are repeats.

A hash found in a large part of all documents (a line or passage they share) is spread: its segments are dealt by their
own content, and then window by window, so that only equal windows meet.

Order is by doc_id, then by a hash of the text (for rows that share an id), then by position. Cases: null and empty
texts have nothing to remove; texts under LENGTH bytes stay whole; a null doc_id sorts first; rows with equal id and
text are one document and get the same result each; strings never cross documents; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portentia.llm import arrays as A
from portentia.llm.common import partitions
from portentia.llm.suffix_array import long_common_prefixes, suffix_array
from portentia.runtime import stage

LENGTH = 100
GRAM = 48
#: Windows in a segment at most; text gathered before segments are sent; text in one suffix array.
SEGMENT, BLOCK, ARRAY = 4096, 16 << 20, 16 << 10
#: A hash in this share of the documents of a block, and of half of it of all documents, is spread.
HOT_SHARE = 0.01
U64 = np.uint64
PAYLOAD = "part int, payload binary"
ANSWERS = pa.schema([("part", pa.int32()), ("payload", pa.binary())])


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of data[i : i + k] for every i."""
    sums = A.prefix_sums(data)
    n = len(data) - k + 1
    return A.mix((sums[k:] - sums[:-k]) * A.powers(A.INVERSE, n)) if n > 0 else np.zeros(0, U64)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start in the row, windows, smallest hash, content hash and 'may repeat in itself' of every segment."""
    none = np.zeros(0, np.int64)
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return none, none, none, none.astype(U64), none.astype(U64), none.astype(bool)
    grams = gram_hashes(data, GRAM)
    low = sliding(grams, width, np.minimum)
    valid = np.zeros(len(data) + 1, dtype=np.int32)
    big = np.diff(offs) >= LENGTH
    valid[offs[:-1][big]] += 1
    np.subtract.at(valid, offs[1:][big] - LENGTH + 1, 1)
    valid = (np.cumsum(valid) > 0)[: len(low)]
    fresh = np.ones(len(low), dtype=bool)
    fresh[1:] = low[1:] != low[:-1]
    fresh[offs[:-1][offs[:-1] < len(low)]] = True
    before = np.zeros(len(low), dtype=bool)
    before[1:] = valid[:-1]
    start = np.flatnonzero(valid & (fresh | ~before))
    after = np.zeros(len(low), dtype=bool)
    after[:-1] = valid[1:] & ~fresh[1:]
    windows = np.flatnonzero(valid & ~after) + 1 - start
    if len(windows) and windows.max() > SEGMENT:
        pieces = -(-windows // SEGMENT)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, left = np.repeat(start, pieces) + step * SEGMENT, np.repeat(windows, pieces) - step * SEGMENT
        windows = np.minimum(left, SEGMENT)
    h = low[start]
    # positions that are the smallest of some window; a segment with two of them may repeat in itself
    high = np.zeros(len(grams) + width - 1, dtype=U64)
    high[width - 1 : width - 1 + len(low)] = low
    peaks = np.flatnonzero(sliding(high, width, np.maximum) == grams)
    at = np.searchsorted(peaks, start)
    while len(peaks):
        wrong = np.flatnonzero(grams[peaks[np.minimum(at, len(peaks) - 1)]] != h)
        if not len(wrong):
            break
        at[wrong] += 1
    following = np.minimum(at + 1, len(peaks) - 1)
    twice = (following > at) & (grams[peaks[following]] == h) & (peaks[following] <= start + windows - 1 + width - 1)
    content = A.span_hash(A.prefix_sums(data), start, start + windows + LENGTH - 1)
    row = np.searchsorted(offs, start, side="right") - 1
    return row, start - offs[row], windows, h, content, twice


#: One record per segment in a payload, and per stretch of windows in the answers.
SEGMENT_TYPE = np.dtype([("h", "<u8"), ("content", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("windows", "<u2"), ("flags", "u1")])
STRETCH = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("windows", "<u4"), ("h", "<u8"), ("bucket", "<i4"), ("kind", "u1")])
REPEAT, CHECK, SPREAD = 0, 1, 2
DOC = np.dtype([("doc", "<i8"), ("text", "<i8"), ("bucket", "<i4")])
SELF, HOT = 1, 2


def packed(records: np.ndarray, docs: np.ndarray) -> bytes:
    """Records with the documents they name: a head of two counts, the documents, the records."""
    used, number = np.unique(records["doc"], return_inverse=True)
    records = records.copy()
    records["doc"] = number
    return np.array([len(used), len(records)], "<u4").tobytes() + docs[used].tobytes() + records.tobytes()


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(payload, "<u4", 2).tolist()
    docs = np.frombuffer(payload, DOC, n, 8)
    return np.frombuffer(payload, SEGMENT_TYPE, m, 8 + n * DOC.itemsize), docs


def earliest(order_by: list[np.ndarray], *group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and, in it, where a new group begins; inside groups by `order_by` (first key last)."""
    order = np.lexsort((*order_by, *group))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = False
    for g in group:
        fresh[1:] |= g[order][1:] != g[order][:-1]
    return order, fresh


def keyed(docs: DataFrame, n: int) -> DataFrame:
    """doc, text hash and bucket of every row: what results are matched by."""
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce("doc_id", F.lit(-(1 << 63)))
    return docs.select("doc_id", text.alias("text"), doc.alias("doc"), F.xxhash64(text).alias("hash")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc", "hash"), F.lit(n)).cast("int")
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Segments of about BLOCK bytes of text at a time, and their documents."""
    found, names, size, base = [], [], 0, 0
    for batch in batches:
        keys = np.zeros(batch.num_rows, dtype=DOC)
        for field, column in (("doc", "doc"), ("text", "hash"), ("bucket", "bucket")):
            keys[field] = batch.column(column).to_numpy(zero_copy_only=False)
        for at, end, data, offs in A.slices(batch.column("text")):
            row, start, windows, h, content, twice = segments(data, offs)
            records = np.zeros(len(row), dtype=SEGMENT_TYPE)
            records["h"], records["content"], records["doc"] = h, content, row + base
            records["start"], records["windows"], records["flags"] = start, windows, twice * SELF
            found.append(records)
            names.append(keys[at:end])
            base, size = base + end - at, size + len(data)
            if size >= BLOCK:
                yield np.concatenate(found), np.concatenate(names)
                found, names, size, base = [], [], 0, 0
    if found:
        yield np.concatenate(found), np.concatenate(names)


def hot_hashes(keyed_docs: DataFrame, share: float = HOT_SHARE) -> np.ndarray:
    """Hashes found in a large share of all documents. A block reports what a share of its own documents holds, so no
    such hash is missed and a block reports few; the sums that stay are bounded by segments per document over share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, names in _blocks(batches):
            once = np.unique(records[["h", "doc"]])["h"] if len(records) else np.zeros(0, U64)
            values, counts = np.unique(once, return_counts=True)
            often = counts >= max(2, share / 2 * len(names))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(values[often].view(np.int64), 0)), pa.array(np.append(counts[often], 0)),
                    pa.array(np.append(np.zeros(often.sum(), np.int64), len(names))),
                ],
                names=["h", "n", "docs"],
            )

    seen = keyed_docs.select("text", "doc", "hash", "bucket").mapInArrow(run, "h long, n long, docs long")
    sums = stage(seen.groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "hot")
    docs = sums.agg(F.sum("docs")).first()[0] or 0
    rows = sums.where((F.col("n") >= max(64, share / 2 * docs))).select("h").collect()
    return np.sort(np.array([r.h for r in rows], dtype=np.int64).view(U64))


def deal(keyed_docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """(part, payload): the segments of all documents, dealt by their smallest hash. Copies inside a block are sent
    only as one earliest copy; the others are known to be repeats and are passed on as such (part -1 - bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, names in _blocks(batches):
            order, fresh = earliest(
                [records["start"], names["text"][records["doc"]], names["doc"][records["doc"]]], records["content"], records["h"]
            )
            records = records[order]
            first = np.flatnonzero(fresh)
            lead = np.repeat(first, np.diff(np.append(first, len(order))))
            later = ~fresh & ~same_place(records, names, np.arange(len(order)), lead)
            copies, records = records[later], records[fresh]
            is_hot = np.isin(records["h"], hot)
            records["flags"] |= is_hot.astype(np.uint8) * np.uint8(HOT)
            key = np.where(is_hot, A.mix(records["h"] ^ records["content"]), records["h"])
            part = (A.mix(key) % U64(parts)).astype(np.int64)
            rows = [(int(p), packed(records[part == p], names)) for p in np.unique(part)]
            yield from answer_rows(stretches(copies, names, REPEAT), negative=True)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "payload"])

    return keyed_docs.select("text", "doc", "hash", "bucket").mapInArrow(run, PAYLOAD)


def same_place(records: np.ndarray, names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Are two records one place of one document (from repeated rows)?"""
    x, y = names[records["doc"][a]], names[records["doc"][b]]
    return (x["doc"] == y["doc"]) & (x["text"] == y["text"]) & (records["start"][a] == records["start"][b])


def stretches(records: np.ndarray, names: np.ndarray, kind) -> np.ndarray:
    out = np.zeros(len(records), dtype=STRETCH)
    out["doc"], out["text"] = names["doc"][records["doc"]], names["text"][records["doc"]]
    out["start"], out["windows"], out["h"], out["kind"] = records["start"], records["windows"], records["h"], kind
    out["bucket"] = names["bucket"][records["doc"]]
    return out


def answer_rows(found: np.ndarray, negative: bool = False) -> Iterator[pa.RecordBatch]:
    """Stretches by the bucket of their document."""
    ordered = found[np.argsort(found["bucket"], kind="stable")]
    where = ordered["bucket"]
    values, at = np.unique(where, return_index=True)
    if len(values):
        parts = [ordered[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(ordered)))]
        keys = (-1 - values if negative else values).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(parts, pa.binary())], names=["part", "payload"])


def resolve(table: pa.Table) -> pa.Table:
    """One part: which segments are copies of an earlier one, and which need their text compared; by bucket."""
    part = table.column("part")[0].as_py() if table.num_rows else 0
    if part < 0:
        return table.select(["part", "payload"]).set_column(0, "part", pa.array([-1 - part] * table.num_rows, pa.int32()))
    pairs = [unpacked(p.as_py()) for p in table.column("payload")]
    sizes = np.cumsum([0] + [len(d) for _, d in pairs])
    names = np.concatenate([d for _, d in pairs])
    records = np.concatenate([r for r, _ in pairs])
    records["doc"] += np.repeat(sizes[:-1], [len(r) for r, _ in pairs]).astype(np.uint32)
    order, fresh = earliest(
        [records["start"], names["text"][records["doc"]], names["doc"][records["doc"]]], records["content"], records["h"]
    )
    records = records[order]
    first = np.flatnonzero(fresh)
    lead = np.repeat(first, np.diff(np.append(first, len(order))))
    later = ~fresh & ~same_place(records, names, np.arange(len(order)), lead)
    alone = records[fresh]
    new = np.ones(len(alone), dtype=bool)
    new[1:] = alone["h"][1:] != alone["h"][:-1]
    at = np.flatnonzero(new)
    several = np.repeat(np.diff(np.append(at, len(alone))), np.diff(np.append(at, len(alone)))) > 1
    spread = alone["flags"] & HOT > 0
    own = np.maximum.reduceat(records["flags"], first) & SELF > 0 if len(first) else np.zeros(0, bool)
    check = several | own | spread
    kinds = np.where(spread, SPREAD, CHECK)[check]
    found = np.concatenate([stretches(records[later], names, REPEAT), stretches(alone[check], names, kinds)])
    return pa.Table.from_batches(answer_rows(found), schema=ANSWERS)


def _stretches(table: pa.Table) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, dtype=STRETCH)
    return np.concatenate([np.frombuffer(p.as_py(), STRETCH) for p in table.column("payload")])


def _grouped(found: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    order = np.lexsort((found["start"], found["text"], found["doc"]))
    found = found[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found["doc"][1:] != found["doc"][:-1]) | (found["text"][1:] != found["text"][:-1])
    at = np.flatnonzero(new)
    return {
        (int(found["doc"][a]), int(found["text"][a])): found[a:b] for a, b in zip(at, np.append(at[1:], len(found)))
    }


WINDOW = np.dtype([("place", STRETCH), ("text", "u1", LENGTH)])
SHARDS = pa.schema([("shard", pa.int32()), ("places", pa.binary()), ("texts", pa.binary()), ("windows", pa.binary())])


def cut_texts(shards: int):
    """The texts of the segments to compare, dealt to shards: a segment by its hash, a spread one window by window."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = _stretches(answers)
        wanted = _grouped(found[found["kind"] != REPEAT])
        out: dict[int, tuple[list, list]] = {}
        windows: list[np.ndarray] = []
        seen = set()
        for doc, text, body in zip(docs.column("doc").to_pylist(), docs.column("hash").to_pylist(), docs.column("text")):
            places = wanted.get((doc, text))
            if places is None or (doc, text) in seen:
                continue
            seen.add((doc, text))
            data = np.frombuffer(body.as_py().encode(), np.uint8)
            for place in places:
                start, end = int(place["start"]), int(place["start"] + place["windows"])
                if place["kind"] == SPREAD:
                    own = np.zeros(end - start, dtype=WINDOW)
                    own["place"] = place
                    own["place"]["start"] += np.arange(end - start, dtype=np.uint32)
                    own["place"]["windows"] = 1
                    own["place"]["h"] = gram_hashes(data[start : end + LENGTH - 1], LENGTH)
                    own["text"] = np.lib.stride_tricks.sliding_window_view(data[start : end + LENGTH - 1], LENGTH)
                    windows.append(own)
                else:
                    held = out.setdefault(int(A.mix(place["h"].reshape(1))[0] % U64(shards)), ([], []))
                    held[0].append(place)
                    held[1].append(data[start : end + LENGTH - 1].tobytes())
        rows = [(k, np.array(p, dtype=STRETCH).tobytes(), b"".join(t), None) for k, (p, t) in sorted(out.items())]
        if windows:
            spread = np.concatenate(windows)
            # copies inside the bucket: only the earliest goes on, the others are repeats already
            spread, copies = collapsed(spread)
            to = (spread["place"]["h"] % U64(shards)).astype(np.int64)
            rows += [(int(k), None, None, spread[to == k].tobytes()) for k in np.unique(to)]
            rows += [(-1 - int(k), None, None, copies[copies["bucket"] == k].tobytes()) for k in np.unique(copies["bucket"])]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(SHARDS.types)], schema=SHARDS)

    return run


def collapsed(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each group of equal windows, and the places of the others. Windows with one hash but other bytes
    than the earliest stay."""
    place = windows["place"]
    order, fresh = earliest([place["start"], place["text"], place["doc"]], place["h"])
    windows = windows[order]
    first = np.flatnonzero(fresh)
    lead = np.repeat(first, np.diff(np.append(first, len(order))))
    copy = ~fresh & (windows["text"] == windows["text"][lead]).all(axis=1)
    copies = windows["place"][copy].copy()
    copies["kind"] = REPEAT
    return windows[~copy], copies


def sort_shard(table: pa.Table) -> pa.Table:
    """One shard: suffix arrays over the segments of a few hashes at a time; repeats in stretches, by bucket."""
    shard = table.column("shard")[0].as_py() if table.num_rows else 0
    if shard < 0:
        return pa.table([pa.array([-1 - shard] * table.num_rows, pa.int32()), table.column("windows")], schema=ANSWERS)

    def joined(name: str, kind) -> np.ndarray:
        found = [np.frombuffer(x.as_py(), kind) for x in table.column(name) if x.is_valid]
        return np.concatenate(found) if found else np.zeros(0, kind)

    places, body = joined("places", STRETCH), joined("texts", np.uint8)
    windows, copies = collapsed(joined("windows", WINDOW))
    alone = np.ones(len(windows) + 1, dtype=bool)  # a window whose hash no other has repeats nothing
    h = windows["place"]["h"]
    alone[1:-1] = h[1:] != h[:-1]
    windows = windows[~(alone[1:] & alone[:-1])] if len(windows) else windows
    places, body = np.concatenate([places, windows["place"]]), np.concatenate([body, windows["text"].reshape(-1)])
    sizes = places["windows"].astype(np.int64) + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    order = np.lexsort((places["start"], places["text"], places["doc"], places["h"]))
    h = places["h"][order]
    group_end = np.flatnonzero(np.append(h[1:] != h[:-1], True)) + 1
    total = np.concatenate([[0], np.cumsum(sizes[order])])
    out, at = [copies], 0
    while at < len(order):
        reach = max(int(np.searchsorted(total, total[at] + ARRAY)), at + 1)
        end = int(group_end[min(np.searchsorted(group_end, reach), len(group_end) - 1)])
        # places in order: then an earlier position in the joined text is an earlier place in the corpus
        mine = order[at:end]
        mine = mine[np.lexsort((places["start"][mine], places["text"][mine], places["doc"][mine]))]
        out.append(repeats_in(places[mine], [body[begins[m] : begins[m] + sizes[m]] for m in mine]))
        at = end
    return pa.Table.from_batches(answer_rows(np.concatenate(out)), schema=ANSWERS)


def repeats_in(places: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Windows of the segments (given in the order of their places) that equal an earlier window, in stretches."""
    length = np.array([len(t) for t in texts]) + 1
    edge = np.cumsum(length)
    data, gap = np.zeros(int(edge[-1]), dtype=np.uint8), np.zeros(int(edge[-1]), dtype=bool)
    gap[edge - 1] = True
    data[~gap] = np.concatenate(texts)
    sa = suffix_array(np.where(gap, 0, data.astype(np.int16) + 1))
    shared = long_common_prefixes(data, gap, sa, LENGTH)
    group = np.cumsum(~shared[sa])
    lowest = np.full(int(group[-1]) + 1, len(data))
    np.minimum.at(lowest, group, sa)
    repeat = np.zeros(len(data), dtype=bool)
    repeat[sa] = lowest[group] != sa
    hit = np.flatnonzero(repeat)
    owner = np.searchsorted(edge, hit, side="right")
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    out = places[owner[at]].copy()
    out["start"] += (hit[at] - (edge - length)[owner[at]]).astype(np.uint32)
    out["windows"] = np.diff(np.append(at, len(hit)))
    out["kind"] = REPEAT
    return out


REMOVED = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one bucket without their repeats."""
    found = _stretches(answers)
    wanted = _grouped(found[found["kind"] == REPEAT])
    sizes, spans, kept = [], [], []
    for doc, text, body in zip(docs.column("doc").to_pylist(), docs.column("hash").to_pylist(), docs.column("text")):
        data = body.as_py().encode()
        sizes.append(len(data))
        places = wanted.get((doc, text))
        if places is None:
            spans.append([])
            kept.append(data)
            continue
        start = places["start"].astype(np.int64)
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(edge, start, 1)
        np.subtract.at(edge, start + places["windows"] + LENGTH - 1, 1)
        gone = np.cumsum(edge)[:-1] > 0
        begin, end = A.runs(gone, np.array([0, len(data)]))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(begin, end)])
        kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
    return pa.table(
        [
            docs.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
        ],
        names=["doc_id", "n_bytes", "spans", "kept"],
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans of removed bytes and the bytes kept, for every row of (doc_id, text).

    Documents are shuffled twice by their bucket, to fetch the texts to compare and to cut; segments go as packed
    arrays. What was found about segments is a small table, written to the shared folder between the steps.
    """
    n = partitions(docs)
    texts = keyed(docs, n)
    hot = hot_hashes(texts)
    dealt = deal(texts, n, hot)
    answers = stage(dealt.groupBy("part").applyInArrow(resolve, PAYLOAD), "segments")
    by_bucket = texts.groupBy("bucket").cogroup(answers.groupBy("part"))
    cut = by_bucket.applyInArrow(cut_texts(n), "shard int, places binary, texts binary, windows binary")
    sorted_ = stage(cut.groupBy("shard").applyInArrow(sort_shard, PAYLOAD), "repeats")
    found = answers.unionByName(sorted_)
    return texts.groupBy("bucket").cogroup(found.groupBy("part")).applyInArrow(remove, REMOVED)
