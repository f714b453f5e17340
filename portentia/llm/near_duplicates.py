"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles. Its sketch is the K smallest shingle hashes. Documents with equal sets are
one class, named by its smallest id. The inverted lists of the first LISTED sketch values bring together the classes
that may be similar; the K smallest values of two sketches' union estimate their Jaccard similarity; what may reach the
threshold is verified on the full sets.

Completeness: sets of up to 5 * (LISTED - 1) shingles at 80 percent must share one of their LISTED smallest values; larger
similar sets miss it with probability 0.2 ** LISTED. The estimate only drops pairs six standard deviations low.

No list is expanded into all its pairs. First every member is compared with the most central class of its list (whose
sketch values have the longest lists: the origin of a group of copies), which settles groups of copies; only members of
different components are compared further: pair by pair in lists of up to SHORT, while members of longer lists (a
passage that many documents share) are listed anew by their full sets, rarest values first: similar sets share one of
the n - ceil(n * percent / 100) + 1 rarest. What meets only in long lists even so is compared in blocks, which give the
links that join components and no more; none of it is dropped.

Cases: null and empty texts have the empty set and are linked with nothing; fewer words than a shingle make one shingle;
classes are named by row numbers, so rows under one id (null too) are judged by their own texts; a component's id is the
smallest id in it, null if it has none (its rows then count as kept); texts of any length are hashed whole; empty tables
give an empty result; columns other than doc_id and text are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portentia.llm import arrays as A
from portentia.llm.common import components
from portentia.runtime import stage

K = 32
LISTED = 16
SHORT = 16
BLOCK = 512
U64 = np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by both."""
    rows, hashes, _ = A.words(data, offs, lower=True)
    begin, values = A.windows(hashes, rows, size)
    of = rows[begin]
    counts = np.bincount(rows, minlength=len(offs) - 1)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):  # the whole sequence as one shingle; the seed keeps it apart from longer ones
        first = np.searchsorted(rows, few)
        whole = [np.bitwise_xor.accumulate(A.mix(hashes[a : a + counts[r]] + np.arange(1, counts[r] + 1, dtype=U64)))[-1] for a, r in zip(first, few)]
        of, values = np.concatenate([of, few]), np.concatenate([values, A.mix(np.array(whole, dtype=U64) + U64(size))])
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
    return of[new], values[new]


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offs in A.slices(batch.column("text")):
                n = end - at
                of, values = shingle_sets(data, offs, size)
                edge = np.searchsorted(of, np.arange(n + 1))
                sums = np.zeros(len(values) + 1, dtype=U64)
                np.cumsum(values, out=sums[1:])
                mixed = np.zeros(len(values) + 1, dtype=U64)
                np.cumsum(A.mix(values ^ U64(A.BASE)), out=mixed[1:])
                rank = np.arange(len(values)) - np.repeat(edge[:-1], np.diff(edge))
                low = values[rank < K].view(np.int64)
                counts = np.minimum(np.diff(edge), K)
                sketch = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(low))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n), batch.column("text_hash").slice(at, n), pa.array(np.diff(edge)),
                        pa.array((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64)),
                        pa.array((mixed[edge[1:]] - mixed[edge[:-1]]).view(np.int64)), sketch,
                    ],
                    names=["doc_id", "text_hash", "n", "d1", "d2", "sketch"],
                )

    return run


def text_hash() -> Column:
    """With the doc_id, what a row is known by."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Row number, doc_id, text_hash, n (distinct shingles), d1, d2 (digest of the set) and the K smallest hashes, in
    unsigned order."""
    made = docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(
        _sketch(size), "doc_id long, text_hash long, n long, d1 long, d2 long, sketch array<bigint>"
    )
    return made.withColumn("row", F.monotonically_increasing_id())


def meetings(lists: DataFrame) -> DataFrame:
    """Adds to (v, id) how many meet in v; values met once go."""
    met = lists.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    return lists.join(met, "v")


def star_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a list (v, id, df) and the list's most central member."""
    central = lists.groupBy("id").agg(F.sum(F.log2("df")).alias("c"))
    hubs = lists.join(central, "id").groupBy("v").agg(F.max_by("id", F.struct("c", -F.col("id"))).alias("hub"))
    pairs = lists.join(hubs, "v").where("id != hub")
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def several_components(lists: DataFrame) -> DataFrame:
    """The rows of lists (v, id, comp, ...) whose members lie in more than one component."""
    split = lists.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("v")
    return lists.join(split, "v", "left_semi")


def _stack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of a matrix (missing values are the largest), and their sizes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).view(U64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), K), ~U64(0))
    out[np.arange(K) < sizes[:, None]] = values
    return out, sizes


def may_match(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Can the sets reach the threshold, going by the K smallest values of the union of their sketches?"""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != ~U64(0))
    rank = np.cumsum(np.concatenate([np.ones((len(both), 1), bool), both[:, 1:] != both[:, :-1]], axis=1), axis=1)
    common = (twice & (rank[:, 1:] <= K)).sum(axis=1)
    t = percent / 100
    least = K * t - 6 * (K * t * (1 - t)) ** 0.5
    exact = (na <= K) & (nb <= K)  # then the sketches are the sets
    shared = twice.sum(axis=1)
    enough = np.where(exact, 100 * shared >= percent * (na + nb - shared), common >= np.where((na < K) | (nb < K), 1, least))
    return enough & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch allows the threshold."""
    side = classes.select("id", "n", "sketch")
    both = pairs.join(side.toDF("b", "nb", "sb"), "b").join(side.toDF("a", "na", "sa"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, _ = _stack(batch.column("sa"))
                b, _ = _stack(batch.column("sb"))
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(may_match(a, na, b, nb, percent)))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(id, n, s): the full sets of the classes in `ids`, as packed sorted hashes, made anew from the texts."""
    named = classes.join(ids, "id", "left_semi").select("id", "d1", "doc_id", "text_hash").toDF("id", "d1", "__d", "__t")
    rows = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    same = rows["doc_id"].eqNullSafe(named["__d"]) & (rows["text_hash"] == named["__t"])
    held = rows.join(named, same).select("id", "d1", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offs in A.slices(batch.column("text")):
                of, values = shingle_sets(data, offs, size)
                edge = np.searchsorted(of, np.arange(end - at + 1))
                sums = np.array([values[a:b].sum(dtype=U64) for a, b in zip(edge, edge[1:])], dtype=U64).view(np.int64)
                mine = sums == batch.column("d1").slice(at, end - at).to_numpy()  # not of another text with the same hash
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, end - at).filter(pa.array(mine)), pa.array(np.diff(edge)[mine]),
                        pa.array([values[edge[k] : edge[k + 1]].tobytes() for k in np.flatnonzero(mine)], pa.binary()),
                    ],
                    names=["id", "n", "s"],
                )

    return held.mapInArrow(make, "id long, n long, s binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; each pair meets its two sets in two joins."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return same_sets(pairs, stage(full_sets(ids, docs, classes, size).select("id", "s"), "sets"), percent)


def packed_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, U64)


def packed_sets(raws: list[bytes]) -> list[np.ndarray]:
    return [packed_set(raw) for raw in raws]


def shared_count(u: np.ndarray, v: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(u) or not len(v):
        return 0
    return int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum())


def same_sets(pairs: DataFrame, sets: DataFrame, percent: int, unpack=packed_sets) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; `sets` has (id, s), and `unpack` makes sorted hashes of many s."""
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, raws = [], {}  # a hub is in many pairs, on either side; sets are unpacked once a batch, all together
            first, second = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for ids, packed in ((first, batch.column("sa")), (second, batch.column("sb"))):
                for k, id_ in enumerate(ids):
                    if id_ not in raws:
                        raws[id_] = packed[k].as_py()
            held = dict(zip(raws, unpack(list(raws.values()))))
            for a, b in zip(first, second):
                u, v = held[a], held[b]
                shared = shared_count(u, v)
                keep.append(100 * shared >= percent * (len(u) + len(v) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def cross_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of members of short lists (v, id, comp) that lie in different components: at most SHORT rows a member."""
    other = lists.select("v", F.col("id").alias("id2"), F.col("comp").alias("comp2"))
    return lists.join(other, "v").where("comp < comp2").select(
        F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")
    ).distinct()


def sharing_pairs(members: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets of fitting sizes that share one of their rarest values among these sets, as similar ones must."""
    n = np.array([len(m) for m in members])
    of = np.repeat(np.arange(len(members)), n)
    _, value, counts = np.unique(np.concatenate([np.zeros(0, U64), *members]), return_inverse=True, return_counts=True)
    order = np.lexsort((value, counts[value], of))
    of, value = of[order], value[order]
    rank = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    prefix = (rank <= (n - -(-n * percent // 100))[of]) & (counts[value] > 1)
    of, value = of[prefix], value[prefix]
    order = np.lexsort((of, value))
    of, value = of[order], value[order]
    ends = np.searchsorted(value, value, side="right")
    for k in range(len(members)):
        mine = np.flatnonzero(of == k)
        if len(mine):
            met = np.unique(np.concatenate([of[a + 1 : b] for a, b in zip(mine.tolist(), ends[mine].tolist())]))
            for j in met[(100 * np.minimum(n[met], n[k]) >= percent * np.maximum(n[met], n[k]))].tolist():
                yield k, j


def in_blocks(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of long lists (v, id, comp) in different components, by their sets (id, n, s).

    Members are dealt to blocks by size step and hash; a block meets the blocks of its own and the next size step of its
    list, each meeting being a task's group of at most two blocks. A meeting gives the links that join components
    there, so at most as many as it has members.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    members = lists.join(sets.select("id", "n", "s"), "id").withColumn("step", step)
    sizes = members.groupBy("v", "step").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, ["v", "step"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    after = sizes.select("v", (F.col("step") - 1).alias("step"), F.col("blocks").alias("next_blocks"))
    before = sizes.select("v", (F.col("step") + 1).alias("step"), F.col("blocks").alias("last_blocks"))
    members = members.join(after, ["v", "step"], "left").join(before, ["v", "step"], "left")

    def meet(step, lower, upper):
        return F.struct(step.alias("step"), lower.alias("lower"), upper.alias("upper"))

    none = F.array().cast("array<struct<step:bigint,lower:int,upper:int>>")
    block, s = F.col("block"), F.col("step")
    same = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: meet(2 * s, F.least(o, block), F.greatest(o, block)))
    up = F.transform(F.sequence(F.lit(0), F.col("next_blocks") - 1), lambda o: meet(2 * s + 1, block, o))
    down = F.transform(F.sequence(F.lit(0), F.col("last_blocks") - 1), lambda o: meet(2 * s - 1, o, block))
    meets = members.withColumn("m", F.explode(F.concat(same, F.coalesce(up, none), F.coalesce(down, none))))

    def compare(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids = table.column("id").to_numpy()[order]
        comp = np.unique(table.column("comp").to_numpy()[order], return_inverse=True)[1]
        raw = table.column("s")
        members = [packed_set(raw[int(k)].as_py()) for k in order]
        found = []
        for k, j in sharing_pairs(members, percent):
            if comp[j] != comp[k]:
                shared = shared_count(members[k], members[j])
                if shared and 100 * shared >= percent * (len(members[k]) + len(members[j]) - shared):
                    found.append((ids[k], ids[j]))
                    comp[comp == comp[j]] = comp[k]
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    groups = meets.select("v", "m.step", "m.lower", "m.upper", "id", "comp", "n", "s").groupBy("v", "step", "lower", "upper")
    return groups.applyInArrow(compare, "a long, b long").distinct()


def likely(sets: DataFrame, percent: int) -> DataFrame:
    """The ids whose K smallest values meet other sets often enough for one of these to be similar: six standard
    deviations below what similar sets share, or the exact share where K values are the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [packed_set(raw.as_py())[:K].view(np.int64) for raw in batch.column("s")]
            counts = [len(x) for x in low]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.int64), *low])),
                    pa.array(np.repeat(batch.column("id").to_numpy(), counts)), pa.array(np.repeat(batch.column("n").to_numpy(), counts)),
                ],
                names=["v", "id", "n"],
            )

    t = percent / 100
    least = int(K * t - 6 * (K * t * (1 - t)) ** 0.5)
    met = meetings(sets.select("id", "n", "s").mapInArrow(run, "v long, id long, n long"))
    # sets a similar one of which may be larger than a sketch share fewer of their K smallest values
    enough = F.when(100 * F.col("n") <= K * percent, F.ceil(F.col("n") * percent / 100)).otherwise(least)
    return met.groupBy("id", "n").agg(F.count("*").alias("met")).where(F.col("met") >= enough).select("id")


def rare_links(again: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For members of long lists (id, comp) and their sets (id, n, s): pairs to verify, and links found in blocks.

    Members are listed by the rarest values of their sets, so that only similar sets must meet in a list.
    """
    again = stage(again.join(likely(sets, percent), "id", "left_semi"), "likely")
    sets = sets.join(again, "id", "left_semi")
    rare = stage(several_components(rarest(sets, percent).join(again, "id")), "rare")
    short = cross_pairs(rare.where(F.col("df") <= SHORT))
    # long lists that share members become one: their members meet once, not list by list
    long_lists = rare.where(F.col("df") > SHORT).select("v", "id", "comp")
    heads = long_lists.groupBy("v").agg(F.min("id").alias("head"))
    families = components(long_lists.join(heads, "v").select(F.col("head").alias("a"), F.col("id").alias("b")))
    members = long_lists.select("id", "comp").distinct().join(families.toDF("id", "v"), "id")
    return short, in_blocks(several_components(stage(members, "families")), sets, percent)


def with_components(df: DataFrame, found: DataFrame) -> DataFrame:
    """Adds comp: the component of id, or id itself."""
    return df.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "comp", F.coalesce("component", "id")
    ).drop("component")


def grouped(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash, n, d1, d2) of (doc_id, text), and the component number comp of every set (d1, d2, n)."""
    rows = stage(sketches(docs, size), "sketches")
    full = rows.where("n > 0")
    named = full.groupBy("d1", "d2", "n").agg(F.min("row").alias("id"), F.min("doc_id").alias("first"))
    first = named.select(F.col("id").alias("row"))
    classes = stage(
        full.join(first, "row").select(F.col("row").alias("id"), "n", "d1", "d2", "sketch", "doc_id", "text_hash"), "classes"
    )
    lists = stage(meetings(classes.select("id", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))), "lists")
    first = stage(estimated(star_pairs(lists), classes, percent), "pairs")
    links = stage(verified(first, docs, classes, size, percent), "links")
    found = stage(components(links), "components")
    # what the comparison with the central class left apart
    apart = stage(several_components(with_components(lists, found)), "apart")
    more = estimated(cross_pairs(apart.where(F.col("df") <= SHORT)).join(first, ["a", "b"], "left_anti"), classes, percent)
    again = apart.where(F.col("df") > SHORT).select("id", "comp").distinct()
    sets = stage(full_sets(again, docs, classes, size), "sets")
    short, joined = rare_links(again, sets, percent)
    more = stage(more.union(estimated(short.join(first, ["a", "b"], "left_anti"), classes, percent)).distinct(), "pairs")
    if not more.isEmpty():
        joined = joined.union(verified(more, docs, classes, size, percent))
    joined = stage(joined, "links")
    if not joined.isEmpty():
        found = stage(components(links.union(joined)), "components")
    named = with_components(named, found)
    return rows.drop("sketch"), stage(named.select("d1", "d2", "n", "comp", "first"), "grouped")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest id of its component) of every row (doc_id, text)."""
    rows, named = grouped(docs, size, percent)
    firsts = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    known = named.join(firsts, "comp").select("d1", "d2", "n", "component_id", F.lit(True).alias("known"))
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(known, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")
    ).withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all columns, one of each component: the one with the smallest id (null ids last), of
    different texts under that id the one with the smallest hash, and of equal rows any one. Rows without a word stay."""
    rows, named = grouped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), size, percent)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    # rows with equal ids and texts as one
    texts = rows.where("n > 0").groupBy("doc_id", "text_hash", "d1", "d2", "n").agg(F.count("*").alias("rows"))
    texts = stage(texts.join(named.drop("first"), ["d1", "d2", "n"]).select("doc_id", "text_hash", "comp", "rows", place.alias("place")), "texts")
    best = texts.groupBy("comp").agg(F.min("place").alias("best"))
    texts = stage(texts.join(best, "comp").select("doc_id", "text_hash", "rows", (F.col("place") == F.col("best")).alias("kept")), "verdicts")
    gone = texts.where("not kept").select("doc_id", "text_hash").toDF("__d", "__t")
    again = texts.where("kept and rows > 1").select("doc_id", "text_hash").toDF("__d", "__t")
    key, of = F.col("__row.doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("__row.text").cast("string"), F.lit("")))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    same = key.eqNullSafe(F.col("__d")) & (of == F.col("__t"))
    left = held.join(gone, same, "left_anti")
    if again.isEmpty():
        return left.select("__row.*")
    one = left.join(again, same, "left_semi").withColumns({"__key": key, "__hash": of}).dropDuplicates(["__key", "__hash"])
    return left.join(again, same, "left_anti").unionByName(one.select("__row")).select("__row.*")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(v, id, df) of the rarest values of each set, as many as similar sets must share one of; values met once go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, n, raw in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("s")):
                values = packed_set(raw.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(n, id_)), pa.array(np.full(n, n))], names=["v", "id", "n"])

    values = sets.mapInArrow(run, "v long, id long, n long")
    values = values.join(values.groupBy("v").agg(F.count("*").alias("df")), "v")
    order = Window.partitionBy("id").orderBy("df", "v")  # within one set
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return values.withColumn("r", F.row_number().over(order)).where((F.col("r") <= needed) & (F.col("df") > 1)).select("v", "id", "df")
