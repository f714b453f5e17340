"""Which differences between lines the line operator bridges, and how often."""

import random

import numpy as np

from portentia.llm import line_dedup as L

LETTERS = "abcdefghijklmnopqrstuvwxyz     éüñ0123456789"


def line(rng, n):
    return ("x" + "".join(rng.choice(LETTERS) for _ in range(n - 2)) + "z").replace("  ", " y")[:n]


def met(lines):
    """Band hashes of every line."""
    raw = [x.encode() for x in lines]
    of, hashes = L.shingles(*L.code_points(*L.folded(b"".join(raw), np.cumsum([0, *map(len, raw)]))))
    return L.bands(L.signatures(of, hashes, len(lines)))


def similarity(a, b):
    u, v = L.line_set(a.encode()), L.line_set(b.encode())
    shared = len(np.intersect1d(u, v))
    return shared / (len(u) + len(v) - shared)


def test_folding():
    lines = ["  Hello   World\t x ", "É A\u00a0B", "A", "x\r", " one"]
    raw = [x.encode() for x in lines]
    text, offs = L.folded(b"".join(raw), np.cumsum([0, *map(len, raw)]))
    assert [text[a:b].decode() for a, b in zip(offs, offs[1:])] == ["hello world x", "É a\u00a0b", "a", "x", "one"]


def test_recall_of_bands():
    """Pairs that reach 80 percent share a band nearly always, whatever their length."""
    rng = random.Random(2)
    first, second = [], []
    while len(first) < 3000:
        a = line(rng, rng.choice([12, 20, 40, 60, 80, 200, 400]))
        b = a
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8]) if len(a) > 48 else 0):
            k = rng.randrange(len(b))
            b = b[:k] + rng.choice("#%&") + b[k + 1 :]
        b = b + rng.choice(["", "!", " ok"])
        if a != b and similarity(a, b) >= 0.8:
            first.append(a)
            second.append(b)
    found = (met(first) == met(second)).any(axis=1)
    assert found.mean() > 0.99


def test_one_character_edits(spark):
    """Lines from 49 characters on are found with one character replaced; case and spaces do not count at any length."""
    rng = random.Random(7)
    rows, edited, spaced = [], [], []
    for k in range(300):
        a = line(rng, rng.randint(50, 90))
        at = rng.randrange(len(a))
        b = a[:at] + "#" + a[at + 1 :]
        rows += [(2 * k, a), (2 * k + 1, b)]
        if similarity(a, b) >= 0.8:
            edited.append(2 * k + 1)
    for k in range(100):
        a = line(rng, rng.randint(8, 30))
        rows += [(1000 + 2 * k, a), (1001 + 2 * k, "  " + a.upper().replace(" ", " \t ").replace("É", "é").replace("Ü", "ü").replace("Ñ", "ñ") + " ")]
        spaced.append(1001 + 2 * k)
    rows += [(5000 + k, line(rng, 60)) for k in range(200)]
    got = L.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {r.doc_id for r in got if r.n_removed}
    assert len(edited) > 270 and len(gone & set(edited)) >= 0.99 * len(edited)
    assert set(spaced) <= gone
    assert not gone - set(edited) - set(spaced)


def test_members_of_long_lists_meet_by_signature(spark, monkeypatch):
    """Every similar pair of a list is found, also where the list is cut into blocks; the others are not worth a look."""
    monkeypatch.setattr(L, "MEMBERS", 16)
    rng = random.Random(11)
    lines = [line(rng, rng.choice([30, 90, 500])) for _ in range(60)]
    lines += [x + "!" for x in lines[::3]] + [x[:-1] + "#" for x in lines[1::3]]
    rows = [(k, x.encode()) for k, x in enumerate(lines)]
    texts = spark.createDataFrame(rows, "id long, s binary")
    lists = spark.createDataFrame([(5, k, len(rows), k // 2) for k in range(len(rows))], "v long, id long, df long, comp long")
    got = {tuple(r) for r in L.meeting_pairs(lists, L.line_signatures(texts), 3, 80).collect()}
    similar = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if similarity(lines[a], lines[b]) >= 0.8 and a // 2 != b // 2}
    assert len(similar) >= 35 and similar <= got
    long_ones = {k for k, x in enumerate(lines) if len(x) >= 400}
    assert not {(a, b) for a, b in got - similar if a in long_ones and b in long_ones}
    assert not any(a // 2 == b // 2 for a, b in got)


def test_sets_of_many_lines_at_once():
    rng = random.Random(12)
    raw = [line(rng, n).encode() for n in (2, 5, 6, 300, 3000, 40, 40)] + ["é é".encode(), b" a  B "]
    many = L.unpacked(raw * 200)
    one = [np.unique(L.shingles(*L.code_points(*L.folded(x, np.array([0, len(x)]))))[1]) for x in raw]
    assert len(many) == 200 * len(raw) and all((a == b).all() and len(a) == len(b) for a, b in zip(many, one * 200))


def test_members_that_only_resemble_each_other_give_no_rows(spark):
    """Of a list only links that join components leave the task: no pair below the threshold, fewer links than members."""
    rng = random.Random(13)
    base = line(rng, 400)
    alike = []
    for _ in range(40):  # each keeps about 85 percent of the base, so two of them share 70 percent or so
        at = rng.randrange(300)
        alike.append(base[:at] + line(rng, 70) + base[at + 70 :])
    family = [base + "!" * k for k in range(1, 21)]
    lines = alike + family
    texts = spark.createDataFrame([(k, x.encode()) for k, x in enumerate(lines)], "id long, s binary")
    lists = spark.createDataFrame([(5, k, len(lines), k) for k in range(len(lines))], "v long, id long, df long, comp long")
    got = [tuple(r) for r in L.meeting_pairs(lists, L.line_signatures(texts), 3, 80).collect()]
    assert got and all(similarity(lines[a], lines[b]) >= 0.8 for a, b in got)
    assert len(got) < len(lines)
    root = list(range(len(lines)))
    for a, b in got:
        root = [root[a] if r == root[b] else r for r in root]
    assert len(set(root[40:])) == 1
    similar = [(a, b) for a in range(len(lines)) for b in range(a) if similarity(lines[a], lines[b]) >= 0.8]
    assert all(root[a] == root[b] for a, b in similar)


def test_lines_are_shipped_once_and_small(spark):
    """Bands take 13 bytes an entry, lines travel compressed and come once, and documents are not dealt out by their texts."""
    rng = random.Random(14)
    lines = [line(rng, 200) for _ in range(400)]
    docs = spark.createDataFrame([(k, "\n".join(lines[k % 50 * 8 :][:8])) for k in range(100)], "doc_id long, text string").repartition(3).cache()
    sizes = L.banded(docs.where("doc_id < 50").coalesce(1), 4).selectExpr("octet_length(payload) AS n").collect()
    assert sum(r.n for r in sizes) == 13 * 400 * L.BANDS
    met = L.occurrences(docs).where("line % 2 = 0").selectExpr("h AS id")
    got = L.line_texts(docs, met, 4)
    assert sorted(bytes(r.s) for r in got.collect()) == sorted(x.encode() for k, x in enumerate(lines) if k % 2 == 0)
    assert [r.n_removed for r in L.removed_lines(docs.unionByName(docs)).orderBy("doc_id").collect()].count(0) == 50
