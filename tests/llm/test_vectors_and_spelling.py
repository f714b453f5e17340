"""Exact search, hard negatives and spelling variants against plain versions, with the awkward cases."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from portentia.llm import integer_vectors as V
from portentia.llm import spelling as S
from portentia.llm import vector_file
from portentia.llm.hard_negatives import hard_negatives
from portentia.llm.vector_file import top_k

LAST = 1 << 62
SCHEMA = "vec_id long, embedding array<double>, label int, uid string, codes string, rank double, score int, id string"


def vectors(seed=3, n=140, dims=6):
    """(id, vector, label): copies, ties, null and repeated ids, missing, non-finite, empty, short and very large vectors."""
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2])) for k in range(n)]
    rows += [(n + k, list(rows[0][1]), 1) for k in range(30)]
    rows += [(200 + k, [float(rng.randint(-1, 1)) for _ in range(dims)], k % 3) for k in range(60)]
    rows += [(300, [0.0] * dims, 0), (350, None, 1), (400, [0.1] * (dims - 1) + [None], 1), (450, [math.nan] * dims, 2), (500, [math.inf] + [0.0] * (dims - 1), 0)]
    rows += [(550, [], 0), (551, [], 1), (552, [], 0), (600, [0.5, 0.25], 0), (601, [0.5, 0.125], 1), (602, [0.75, 0.5], 0), (603, [-0.5, 1.0], 2)]
    rows += [(50, list(rows[7][1]), 0), (50, list(rows[7][1]), 0), (None, list(rows[5][1]), 0), (None, list(rows[0][1]), 2), (100, [rng.gauss(0, 0.2) for _ in range(dims)], None)]
    rows += [(650, [1e9] * dims, 0), (651, [-1e9] * dims, 1), (652, [1e30] + [0.0] * (dims - 1), 1), (653, [1.0] + [1e-9] * (dims - 1), 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 0.5, 7, "z") for i, v, label in rows], SCHEMA).repartition(5)


def clamp(x):
    return max(V.LEAST, min(V.MOST, x))


def coded(rows):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [clamp(math.floor(256 * x)) for x in v], label))
    return out


def product(a, b):
    return clamp(sum(x * y for x, y in zip(a, b)))


def place(i):
    return (i is None, i or 0)


def plain_top_k(rows, step=50, k=5):
    out, held = [], coded(rows)
    for at, (q, a, _) in enumerate(held):
        if q is not None and q % step == 0:
            found = sorted((-product(a, b), *place(c), c) for n, (c, b, _) in enumerate(held) if n != at and len(a) == len(b))
            out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(out, key=str)


def plain_negatives(rows, step=50, k=5):
    out, held = [], [r for r in coded(rows) if r[2] is not None]
    for at, (q, a, label) in enumerate(held):
        if q is None or q % step:
            continue
        met = [(-product(a, b), *place(c), c, other == label) for n, (c, b, other) in enumerate(held) if n != at and len(a) == len(b)]
        near = sorted(x for x in met if x[4])[:k]
        for score, _, _, positive, _ in near:
            p = -score
            hard = sorted(x for x in met if not x[4] and 80 * p <= -100 * x[0] <= 100 * p)[:k]
            out += [(q, positive, r + 1, x[3], p, -x[0]) for r, x in enumerate(hard)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [256, 5])
def test_search_equals_comparing_everything(spark, cells, monkeypatch):
    """Also with few cells, whose bounds are wide, and with blocks of a few queries and rows."""
    monkeypatch.setattr(V, "QUERY_BYTES", 400)
    rows = vectors()
    got = top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, cells=cells)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_top_k(rows)


def test_few_and_no_rows(spark):
    rows = [(50, [1.0, 2.0], 1), (51, [0.5, 0.5], 2)]
    is_query = F.col("vec_id") % 50 == 0
    assert [tuple(r) for r in top_k(frame(spark, rows), is_query).collect()] == plain_top_k(rows)
    assert top_k(frame(spark, rows).limit(0), is_query).count() == 0
    assert hard_negatives(frame(spark, rows).limit(0), is_query, F.col("label")).count() == 0
    assert hard_negatives(frame(spark, rows), is_query, F.col("label")).count() == 0


def test_exact_codes_are_read_only_near_the_bound():
    """Most rows are settled by their cells."""
    import numpy as np

    rng = np.random.default_rng(5)
    codes = np.floor(256 * rng.normal(0, 0.125, (4000, 16))).astype(np.int64)
    stats = [dict(n=4000, low=int(c.min()), high=int(c.max()), total=float(c.sum()), squares=float((c * c).sum())) for c in codes.T]
    grid = vector_file._grid([type("Row", (), s) for s in stats], 256)
    cells = grid.cells(codes)
    for k in range(16):
        assert (grid.low[k, cells[:, k]] <= codes[:, k]).all() and (codes[:, k] <= grid.high[k, cells[:, k]]).all()
    reads = []
    queries = V.Queries(np.arange(20), codes[:20], {})
    best = vector_file.Best(20, 5)
    block = {"uid": np.arange(4000), "id": np.arange(4000), "missing": np.zeros(4000, bool), "cells": cells, "exact": codes.astype("<i2")}
    real = V.products
    try:
        V.products = lambda a, b: (reads.append(len(a)), real(a, b))[1]
        vector_file.scan(queries, slice(0, 20), grid, block, 5, best)
    finally:
        V.products = real
    exact = codes[:20] @ codes.T
    exact[np.arange(20), np.arange(20)] = V.LEAST
    assert (best.score == np.sort(exact, axis=1)[:, ::-1][:, :5]).all() and sum(reads) <= 20 * 40


@pytest.mark.parametrize("seed", [3, 4])
def test_negatives_equal_comparing_everything(spark, seed, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BYTES", 400)
    rows = vectors(seed)
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(rows)


def test_threshold_stops_before_all_rows():
    """With few components and a block in which some rows stand out, most rows are never scored."""
    import numpy as np

    from portentia.llm.hard_negatives import Lists, Window, read_lists

    rng = np.random.default_rng(2)
    codes = np.floor(256 * rng.normal(0, 0.1, (8000, 3))).astype(np.int64)
    codes[:40] += 300
    lists = Lists(codes, np.arange(8000), np.arange(8000), np.zeros(8000, bool), np.zeros(8000, np.int64))
    anchor = np.array([100, 120, 90])
    window = Window(V.LEAST, V.MOST, 5)
    read = read_lists(lists, anchor, -1, np.ones(8000, bool), [window])
    score = codes @ anchor
    assert [-r[0] for r in window.rows] == np.sort(score)[::-1][:5].tolist() and read < 800


def plain_variants(docs, least=5, letters=S.LETTERS):
    import re

    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall(letters, text or ""):
            run = run.translate(str.maketrans(S.CAPITALS, S.CAPITALS.lower()))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [x for x in counts if w != x and one_apart(w, x)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = S.common_prefix(a, b)
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def words_of(seed):
    """Texts with misspelt words, ties, runs of one letter, letters beyond A-Z, and one very long word in two spellings."""
    rng = random.Random(seed)
    stems = ["magnet", "Forest", "straße", "ÀÉîõüÿ", "aaaaaa", "banana", "magnes", "planet", "ébénisterie", "l" * 5000]
    texts = []
    for i in range(260):
        words = []
        for _ in range(rng.randint(0, 12)):
            w = rng.choice(stems if i % 9 == 0 else stems[:-1])
            if rng.random() < 0.3:
                at, letter = rng.randrange(min(len(w), 7)), rng.choice("abe×É")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :]])
            words.append(w)
        texts.append((i if i % 50 else None, " ".join(words) if i % 40 else None))
    chain = [(9, "lantern " * 200 + "lanterm " * 30 + "lanterms " * 6)]  # a form whose form differs
    return [*texts, *chain, (7, ""), (8, "123 -- \n"), texts[3], texts[3]]


@pytest.mark.parametrize("parts", [1, 7])
def test_variants_equal_comparing_everything(spark, parts, monkeypatch):
    """Whatever the number of tasks that share the tries."""
    monkeypatch.setattr(S, "partitions", lambda df, text: parts)
    docs = words_of(parts)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.variants(S.stage(S.word_counts(df), "words"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = plain_variants(docs)
    assert set(map(tuple, got.collect())) == expected and any(x[2] not in (x[0], x[1]) for x in expected)
    assert S.variants(S.stage(S.word_counts(df.limit(0)), "words")).count() == 0
