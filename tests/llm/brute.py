"""A small corpus with the awkward cases, and plain versions of the operators to compare with."""

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng, n):
    syllables = ["th", "an", "re", "tion", "é", "ing", "über", "ñ", "st"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    lines, at = [], 0
    while at < n:
        step = rng.randint(6, 20)
        lines.append(" ".join(words[at : at + step]).capitalize() + ".")
        at += step
    return "\n".join(lines)


def corpus(seed=5, n=40):
    """(doc_id, text) with exact and near copies, shared passages, nulls, empty and long texts, ties."""
    rng = random.Random(seed)
    docs = [prose(rng, rng.randint(5, 200)) for _ in range(n)]
    passage = prose(rng, 60).replace("\n", " ")
    for k in range(0, n, 4):
        docs[k] = docs[k] + " " + passage + " " + prose(rng, 5)
    docs += [docs[3], docs[3], docs[8]]
    for _ in range(4):
        words = docs[11].split(" ")
        words[rng.randrange(len(words))] = "changed"
        docs.append(" ".join(words))
    docs += [None, "", "   \n\t ", "one", "two words", "a" * 700, "ab" * 300, "x " * 150, prose(rng, 3000)]
    docs += ["Mail a@b.example.org or 10.0.0.256 and 10.0.0.25, +1 (222) 555-0100, 4111 1111 1111 1111"]
    return list(enumerate(docs))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def repeats(rows, size=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            window = data[p : p + size]
            if window in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def groups(sets, percent=80):
    """Smallest id of every id's component; ids link when their sets are similar enough."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i, s in sets.items():
        for v in s:
            held[v].append(i)
    for i, s in sets.items():
        met = collections.Counter(j for v in s for j in held[v] if j > i)
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def shingles(text, size):
    words = WORD.findall(lower(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
