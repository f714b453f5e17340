"""Spelling variants: words that differ by one character, grouped under their most frequent form.

Words are counted over all documents. Their forward trie (prefixes) and reversed trie (suffixes) are numbered: words are
sorted by range, each task numbers the nodes of its sorted words (a word adds the nodes beyond what it shares with the
word before), and nodes that reach across tasks take the number of the first task that has them, going by the last word
of every task. No prefix is ever written out.

A word of L characters gives integer pairs (prefix node, suffix node): L + 1 that split it between two characters, and L
that skip a character. Two words that skip to the same pair differ by a replacement there, and lie in one such pair only;
a word that splits where another one skips lacks that character. The pairs are exact, so nothing is verified and nothing
is missed. A pair has one split word at most and one skipping word for each letter, so the size of the alphabet bounds
its group, whatever the number of words; replacements are counted from the group's size and its two best words without
making pairs.

Cases: null texts and texts without letters have no words; a null doc_id counts as the empty text; repeated rows
count again; ties of n go to the word first in code-point order; words of any length are taken whole; empty tables give
an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.llm.common import partitions
from portentia.runtime import stage

#: What a word is made of, and its capital letters that have lower-case twins here.
LETTERS = "[A-Za-zÀ-ÿ]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Node numbers: the task in the high bits, a count of its nodes in the low ones.
NODE_BITS = 40


def letter_runs(text: Column) -> Column:
    """The maximal runs of letters, in lower case as far as A-Z goes."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(f"({LETTERS})")),
        # lower() of ASCII changes A-Z only, and is faster
        lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, CAPITALS, CAPITALS.lower())),
    )


def without_one(word: Column, at: Column) -> Column:
    """The word without the character at a position from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def planted(doc_id: Column, word: Column, every: int = 199) -> Column:
    """The word, or for one in `every` (by the crc32 of doc_id:word) the word less one character."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, without_one(word, at)).otherwise(word)


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, change=planted) -> DataFrame:
    """word and n of the frequent words of (doc_id, text); `change` makes the word to count from doc_id and a run."""
    found = docs.select("doc_id", F.explode(F.filter(letter_runs(F.col("text")), lambda w: F.length(w) >= least_length)).alias("run"))
    words = found.select(change(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part and path (the numbers of the nodes from the root to the word) to sorted words."""
    part = TaskContext.get().partitionId()
    last, path, free = "", [part << NODE_BITS], (part << NODE_BITS) + 1
    for batch in batches:
        paths = []
        for word in batch.column("word").to_pylist():
            shared = common_prefix(last, word)
            new = len(word) - shared
            path = path[: shared + 1] + list(range(free, free + new))
            last, free = word, free + new
            paths.append(np.array(path, dtype="<i8").tobytes())
        parts = pa.array(np.full(batch.num_rows, part, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(paths, pa.binary())], names=[*batch.schema.names, "part", "path"])


def trie_paths(words: DataFrame) -> tuple[DataFrame, dict[int, tuple[str, bytes]]]:
    """Words (word, ...) in order, with part and path; and for every part the word before it and that word's path as far
    as the part shares it: one word a task, all that the driver sees.

    A node lies in an earlier part exactly if the word before the part goes through it, as words are in order.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in words.dtypes)
    ordered = words.repartitionByRange(partitions(words, text="word"), "word").sortWithinPartitions("word")
    numbered = ordered.mapInArrow(_number, f"{fields}, part int, path binary").withColumn("uid", F.monotonically_increasing_id())
    numbered = stage(numbered, "trie")
    ends = numbered.groupBy("part").agg(F.min("word").alias("first"), F.max_by(F.struct("word", "path"), "word").alias("last"))
    before: dict[int, tuple[str, bytes]] = {}
    word, path = None, b""
    for row in sorted(ends.collect(), key=lambda r: r.part):
        own = bytes(row.last.path)
        if word is not None:
            before[row.part] = word, path[: 8 * (common_prefix(word, row.first) + 1)]
            own = joined_path(row.last.word, own, *before[row.part])
        word, path = row.last.word, own
    return numbered, before


def joined_path(word: str, path: bytes, before: str, path_before: bytes) -> bytes:
    """The path with the numbers of nodes that the word before the part goes through."""
    shared = min(8 * (common_prefix(word, before) + 1), len(path_before))
    return path_before[:shared] + path[shared:]


def true_paths(table: DataFrame, before: dict[int, tuple[str, bytes]]) -> DataFrame:
    """The words with node numbers that hold across parts."""
    names = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [
                joined_path(w, p, *before[k]) if k in before else p
                for w, k, p in zip(*(batch.column(c).to_pylist() for c in ("word", "part", "path")))
            ]
            columns = [pa.array(paths, pa.binary()) if n == "path" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return table.mapInArrow(run, table.schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, s, skip, uid, n) of every split and every skipped character of the words."""
    for batch in batches:
        uid, n = (np.asarray(batch.column(c)) for c in ("uid", "n"))
        for first in range(0, batch.num_rows, 4096):
            rows = slice(first, min(first + 4096, batch.num_rows))
            p, s, skip, of = [], [], [], []
            for k, forward, backward in zip(range(rows.start, rows.stop), batch.column("path")[rows], batch.column("back")[rows]):
                f, b = np.frombuffer(forward.as_py(), "<i8"), np.frombuffer(backward.as_py(), "<i8")[::-1]
                p += [f, f[:-1]]
                s += [b, b[1:]]
                skip += [np.zeros(len(f), bool), np.ones(len(f) - 1, bool)]
                of.append(np.full(2 * len(f) - 1, k))
            at = np.concatenate(of)
            columns = [np.concatenate(p), np.concatenate(s), np.concatenate(skip), uid[at], n[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["p", "s", "skip", "uid", "n"])


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For words (word, n): (uid, word, n) with uid in code-point order, and (uid, n_near, best, best_n) of the words that
    have near ones: how many, and the one of largest n (ties: smallest uid)."""
    forward, before = trie_paths(words)
    backward, behind = trie_paths(forward.select(F.reverse("word").alias("word"), F.col("uid").alias("of")))
    back = true_paths(backward, behind).select(F.col("of").alias("uid"), F.col("path").alias("back"))
    both = true_paths(forward, before).select("uid", "n", "path").join(back, "uid")
    pairs = both.mapInArrow(_pairs, "p long, s long, skip boolean, uid long, n long")
    # smallest first: largest n, then first in code-point order
    rank = F.struct((-F.col("n")).alias("less"), "uid")
    groups = pairs.groupBy("p", "s").agg(
        F.array_sort(F.collect_list(F.when(F.col("skip"), rank))).alias("skips"), F.min(F.when(~F.col("skip"), rank)).alias("split")
    ).where((F.size("skips") > 1) | ((F.size("skips") == 1) & F.col("split").isNotNull()))
    groups = stage(groups.drop("p", "s"), "pairs")
    replaced = groups.where(F.size("skips") > 1).select(
        F.posexplode("skips").alias("at", "own"), F.size("skips").alias("size"), F.slice("skips", 1, 2).alias("first")
    ).select("own.uid", (F.col("size") - 1).cast("long").alias("n_near"), F.when(F.col("at") == 0, F.col("first")[1]).otherwise(F.col("first")[0]).alias("best"))
    # a word may lack the character at several places of a run of equal ones
    lacking = groups.where("split is not null").select(F.explode("skips").alias("a"), F.col("split").alias("b")).distinct()
    changed = lacking.select(F.explode(F.array(
        F.struct(F.col("a.uid").alias("uid"), F.col("b").alias("best")), F.struct(F.col("b.uid").alias("uid"), F.col("a").alias("best"))
    )).alias("x")).select("x.uid", F.lit(1).cast("long").alias("n_near"), "x.best")
    near = replaced.unionByName(changed).groupBy("uid").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return forward.select("uid", "word", "n"), near.select("uid", "n_near", F.col("best.uid").alias("best"), (-F.col("best.less")).alias("best_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(uid, root): where the links (uid, form) end. Every step doubles the distance; n grows along links, so they end."""
    jumps = stage(forms.select("uid", F.col("form").alias("root")), "forms")
    while True:
        ahead = jumps.select(F.col("uid").alias("root"), F.col("root").alias("further"))
        longer = stage(jumps.join(ahead, "root", "left").select("uid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        jumps = longer.select("uid", "root")
        if longer.where("moved").isEmpty():
            return jumps


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (word, n).

    form is the near word of largest n, if that is at least `times` the word's own; root is where the forms end.
    """
    named, near = near_words(words)
    table = stage(
        named.join(near, "uid", "left").withColumn("form", F.when(F.col("best_n") >= times * F.col("n"), F.col("best")))
        .select("uid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "near",
    )
    roots = last_forms(table.where("form is not null"))
    spelled = table.select("uid", "word")
    linked = table.where("form is not null").join(roots, "uid")
    linked = linked.join(spelled.toDF("form", "form_word"), "form").join(spelled.toDF("root", "root_word"), "root")
    linked = linked.select("uid", "form_word", "root_word")
    return table.join(linked, "uid", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
