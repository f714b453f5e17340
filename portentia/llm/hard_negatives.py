"""Hard negatives by Fagin's threshold algorithm.

An anchor's positives are the rows of its label with the largest inner products; a hard negative of (anchor, positive) is
a row of another label whose product lies in a window below the positive's: least * positive <= 100 * negative <=
most * positive, in per cent.

Both searches run the threshold algorithm. A task takes its rows in blocks and sorts every component of a block into a
list. For an anchor, lists are read from the large end where the anchor's component is positive, from the small end where
it is negative (zero components need no list), a depth that doubles from DEPTH; every row met is scored at once over
all its components (random access), and the anchor's products with the components at the present depth add up to a
threshold that no row still unseen can exceed. Reading stops once the threshold is strictly below the k-th score of
every window (a row of equal score and smaller id may still be unseen otherwise), or below the window itself. What a
task found in earlier blocks counts, so later blocks stop sooner, many at depth 0. The first k of all tasks per window
give the result; a task keeps k rows a window, whatever the number of copies or ties.

Cases: rows with a null label take no part; see integer_vectors for unusable vectors, lengths, null and repeated ids; an
anchor never meets its own row but meets equal ones; anchors without positives, and windows without rows, give nothing
(so do windows of a negative positive score, which are empty); empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.llm import integer_vectors as V
from portentia.llm.vector_file import first_rows

#: Rows read from each list before the threshold is first checked.
DEPTH = 32
FOUND = "anchor_uid long, window int, id long, score long"


class Lists:
    """A block of rows of one length: exact codes, and the rows sorted by every component."""

    def __init__(self, vectors: np.ndarray, uid: np.ndarray, id_: np.ndarray, missing: np.ndarray, label: np.ndarray):
        self.uid, self.id, self.missing, self.label = uid, id_, missing, label
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)  # by component, ascending
        self.largest = V.largest(vectors)
        self.vectors = vectors.astype(np.float64) if self.largest < V.EXACT else vectors

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(anchor) * self.largest * V.largest(anchor) < V.EXACT:
            return (self.vectors[rows] @ anchor).astype(np.int64)
        return V.products(np.broadcast_to(anchor, (len(rows), len(anchor))), self.vectors[rows].astype(np.int64))

    def threshold(self, anchor: np.ndarray, lists: np.ndarray, ends: np.ndarray, depth: int) -> int:
        """Sum of the anchor's products with the values at a depth of its lists."""
        values = self.vectors[self.order[lists, np.where(ends, len(self.uid) - 1 - depth, depth)], lists]
        return int(V.products(anchor[None, lists].astype(np.int64), values[None, :].astype(np.int64))[0])


class Window:
    """The first k rows so far with low <= score <= high, in order of score and id (missing ids last)."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k, self.rows = low, high, k, []

    def add(self, score: np.ndarray, missing: np.ndarray, id_: np.ndarray) -> None:
        inside = (score >= self.low) & (score <= self.high)
        if len(self.rows) == self.k:
            inside &= score >= -self.rows[-1][0]
        at = np.flatnonzero(inside)
        if len(at) > 4 * self.k:  # only the first k need a place in the list
            at = at[np.lexsort((id_[at], missing[at], ~score[at]))[: self.k]]
        new = [(-int(score[a]), bool(missing[a]), int(id_[a])) for a in at]
        self.rows = sorted(self.rows + new)[: self.k]

    def settled(self, threshold: int) -> bool:
        """Can no row with a score up to the threshold come in?"""
        if self.low > self.high or threshold < self.low:
            return True
        return len(self.rows) == self.k and threshold < -self.rows[-1][0]


def read_lists(lists: Lists, anchor: np.ndarray, uid: int, allowed: np.ndarray, windows: list[Window]) -> int:
    """Read the lists for one anchor until all windows are settled; `allowed` rows count. Returns the rows read."""
    n, used = len(lists.uid), np.flatnonzero(anchor)
    ends = anchor[used] > 0
    seen = ~allowed
    seen[lists.uid == uid] = True
    depth, step, read = 0, DEPTH, 0
    while depth < n:
        if not len(used):  # all scores are 0, there is nothing to sort by
            new, stop = np.flatnonzero(~seen), n
        else:
            threshold = lists.threshold(anchor, used, ends, depth)
            if all(w.settled(threshold) for w in windows):
                break
            stop = min(depth + step, n)
            met = np.zeros(n, dtype=bool)
            met[lists.order[used[ends], n - stop : n - depth].ravel()] = True
            met[lists.order[used[~ends], depth:stop].ravel()] = True
            new = np.flatnonzero(met & ~seen)
        if len(new):
            seen[new] = True
            read += len(new)
            score = lists.scores(anchor, new)
            for w in windows:
                w.add(score, lists.missing[new], lists.id[new])
        depth, step = stop, 2 * step
    return read


def _kernel(k: int, same_label: bool, limits: tuple[int, int]):
    def run(queries: V.Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, dims = np.array(queries.others["label"], dtype=np.int64), queries.vectors.shape[1]
        if same_label:
            windows = [[Window(V.LEAST, V.MOST, k)] for _ in labels]
        else:  # whole numbers from low / 100 to high / 100 of the positive's score
            windows = [[Window(-(-limits[0] * p // 100), limits[1] * p // 100, k) for p in of] for of in queries.others["positives"]]
        for table in V.gathered(batches):
            table = table.filter(pa.array(V.lengths(table.column("codes").combine_chunks()) == 8 * dims)).combine_chunks()
            if not table.num_rows:
                continue
            id_, missing = V.id_order(table.column("id").combine_chunks())
            vectors = V.matrix(table.column("codes")) if dims else np.zeros((len(id_), 0), dtype=np.int64)
            lists = Lists(vectors, np.asarray(table.column("uid")), id_, missing, np.asarray(table.column("label")))
            alike: dict[int, np.ndarray] = {}
            for at, label in enumerate(labels.tolist()):
                if label not in alike:
                    alike[label] = (lists.label == label) == same_label
                read_lists(lists, queries.vectors[at], queries.uid[at], alike[label], windows[at])
        found = [
            (uid, w, None if missing else id_, -score)
            for uid, of in zip(queries.uid.tolist(), windows) for w, window in enumerate(of) for score, missing, id_ in window.rows
        ]
        if found:
            columns = list(zip(*found))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor_uid", "window", "id", "score"])

    return run


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
    key: str = "vec_id", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for every row that is an anchor."""
    rows = V.numbered(df.where(label.isNotNull()), key, vector, scale, label=label.cast("long"), is_anchor=F.coalesce(is_anchor, F.lit(False)))
    anchors = rows.where("is_anchor")
    others = rows.select("uid", "id", "label", "codes")
    near = V.meet_all(anchors.select("uid", "codes", "label"), others, _kernel(positives, True, (0, 0)), FOUND)
    near = first_rows(near, ["anchor_uid"], positives).select("anchor_uid", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = V.stage(near, "positives")
    # at most `positives` scores an anchor, in order
    scores = near.groupBy(F.col("anchor_uid").alias("uid")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    wanted = anchors.select("uid", "codes", "label").join(scores, "uid").select("uid", "codes", "label", F.col("p.positive_score").alias("positives"))
    found = V.meet_all(wanted, others, _kernel(negatives, False, (least, most)), FOUND)
    ranked = first_rows(found, ["anchor_uid", "window"], negatives).withColumn("place", F.col("window") + 1)
    names = anchors.select(F.col("uid").alias("anchor_uid"), F.col("id").alias("anchor_id"))
    return ranked.join(near, ["anchor_uid", "place"]).join(names, "anchor_uid").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
