"""Each text operator against a plain version, on a small corpus with the awkward cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import SCHEMA, WORD, corpus, frame, groups, lower, repeats, shingles
from pyspark.sql import functions as F

from portentia.llm import byte_bpe, decontaminate, html_text, line_dedup, near_duplicates, pitman_yor, quality_rules
from portentia.llm import repeats as R
from portentia.llm import sanitise as S
from portentia.llm import suffix_array as SA
from portentia.llm import token_files as T
from portentia.llm.common import components

ROWS = corpus()
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, rng.integers(1, 4) + 1, rng.integers(0, 50))
        assert SA.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("share", [R.HOT_SHARE, 1e-9])
def test_repeats(docs, monkeypatch, share):
    """Also with every hash spread, as those that many documents share."""
    hot = R.hot_hashes
    if share < R.HOT_SHARE:
        every = [r.h for r in R.deal(R.keyed(docs, 1), 1, np.zeros(0, np.uint64)).select(F.lit(0).alias("h")).take(1)]
        assert every
        monkeypatch.setattr(R, "hot_hashes", lambda d, s=share: _all_hashes(d))
    want = repeats(ROWS)
    for r in R.remove_repeats(docs.select("doc_id", "text")).collect():
        removed = sum(s["end"] - s["start"] for s in r.spans)
        assert (r.n_bytes, removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], r.doc_id
    assert hot is not None


def _all_hashes(keyed):
    found = set()
    for row in keyed.collect():
        data = np.frombuffer(row.text.encode(), np.uint8)
        found.update(R.segments(data, np.array([0, len(data)]))[3].tolist())
    return np.sort(np.array(list(found), dtype=np.uint64))


def test_repeats_of_repeated_rows_and_empty(spark, empty):
    text = "The same long line of text, again and again, without any change at all, over a hundred bytes long, really."
    rows = [(1, text), (1, text), (2, text), (None, None)]
    got = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in got) == [(0, 0), (1, len(text)), (1, len(text)), (2, 0)]
    assert R.remove_repeats(empty.select("doc_id", "text")).count() == 0


def test_codes_give_any_token():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), rng.integers(0, 256, 10), rng.integers(0, 1 << 20, 5000), np.full(700, 65535)):
        ids = ids.astype(np.uint32)
        codes = T.Codes(T.pack(ids))
        assert [codes[k] for k in range(0, len(ids), 7)] == ids[::7].tolist()
        assert codes.slice(3, max(3, len(ids) - 2)).tolist() == ids[3 : max(3, len(ids) - 2)].tolist()


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    T.write_tokens(docs.select("doc_id", "text"), path, f"{tmp_path}/ids")
    segments = T.read_segments(spark, f"{tmp_path}/ids")
    got = {r.doc_id: r for r in T.with_starts(T.documents(segments), segments).collect()}
    start = 0
    for i, text in ROWS:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert zlib.crc32(got[i].ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    T.write_tokens(empty.select("doc_id", "text"), path, f"{tmp_path}/none")
    assert T.documents(T.read_segments(spark, f"{tmp_path}/none")).count() == 0


def test_edit_distance_against_the_table():
    import random

    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 80)))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p):
            new = [i + 1]
            for j, b in enumerate(t):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.closest(decontaminate.masks(p), len(p), t)[0] == min(row)


def test_leaks(spark, docs):
    text = dict(ROWS)[13]
    item = " ".join(text.split()[3:40])
    edited = item[:40] + "xy" + item[43:]
    benchmark = spark.createDataFrame([(1, item), (2, edited.upper()), (3, None), (4, ""), (5, "not there at all, sir")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, benchmark).collect()}
    assert set(got) == {(13, 1), (13, 2)}
    found = got[(13, 1)]
    assert found.distance == 0 and " ".join(text[found.start : found.end].split()) == item
    assert 0 < got[(13, 2)].distance <= 3
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_quality_counts_and_verdict(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in ROWS] + [(999, 0, 0), (None, 1, 0), (3, None, 0)], LABELS)
    texts = dict(ROWS)
    for r in quality_rules.quality(docs, labels).collect():
        words = WORD.findall(texts[r.doc_id] or "")
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        inside = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id] or "")), len(lines) - len(set(lines)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert r.kept == (not r.base_failed)  # so few labels prove no cutoff
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    assert quality_rules.quality(empty, labels.limit(0)).count() == 0


def test_cutoffs_hold_their_bound(spark):
    """2,000 good documents under 10 percent symbols, 100 bad ones above 30: a cutoff between them."""
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(i, text, "en", "s", 0) for i in range(2000)] + [(i, text + "".join(f" #{k}#" for k in range(60)), "en", "s", 0) for i in range(2000, 2100)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i in range(2100)], LABELS)
    cutoffs = quality_rules.select_cutoffs(quality_rules.text_counts(df), labels)
    assert 0 < cutoffs[("en", "symbols")] < 0.5
    assert quality_rules.keep_good(df, labels).count() == 2000
    assert math.isclose(quality_rules.binomial_tail(5, 1, 0.3), 0.7**5 + 5 * 0.3 * 0.7**4)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _ok(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data(spark, empty):
    texts = [
        None, "", "a@b.c_d@e.f x@y..z é@b.co a.b+c@d-e.f.g", "1.2.3.4.5 0256.1.1.1 0255.1.1.1 300.1.1.1", "+1 2 +12-345-6789 ++123456789012",
        "4111-1111-1111-1111 4111  1111 4111111111111112 0000000000000", "é " * 50 + "a@b.c", "1" * 5000 + " " + "a" * 3000 + "@", dict(ROWS)[len(ROWS) - 1],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.find_spans(df).collect():
        for kind, pattern in PATTERNS.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, texts[r.doc_id] or "") if _ok(kind, m[0])]
            assert [(s.start, s.end) for s in r[kind]] == want, (r.doc_id, kind)
    assert S.find_spans(empty.select("doc_id", "text")).count() == 0


def test_disclosing_terms(spark):
    """A nickname that only ever stands next to one address gives it away; common words do not."""
    rows = [(k, f"note {k} from zorblat today\nwrite to max@mail.example.org at {k * 7} please") for k in range(8)]
    rows += [(100 + k, f"note {k} write to us please today at {k} from the office, nothing else {k * 3}") for k in range(900)]
    rows += [(2000, "Zorblat was here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = S.find_spans(df).cache()
    terms = {r.doc_id: [t.value for t in r.term or []] for r in spans.collect()}
    assert terms[2000] == ["Zorblat"] and terms[3] == ["zorblat"] and not terms[105]
    clean = {r.doc_id: r.text for r in S.sanitise(df, spans).collect()}
    assert clean[2000] == " was here" and "<email>" in clean[3] and clean[105] == dict(rows)[105]


def test_language_model(spark, docs, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    scores, model = pitman_yor.language_model(docs.select("doc_id", "text"), held)
    tokens = {i: [*WORD.findall(lower(t or "")), None] for i, t in ROWS}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = collections.Counter(w for i, x in tokens.items() if i not in out for w in x)
    n, v = sum(counts.values()), len(counts)
    rows = scores.collect()
    assert (model.tokens, model.vocabulary, len(rows)) == (n, v, len(ROWS))
    for r in rows:
        x = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        assert (r.held_out, r.n_tokens, r.n_known) == (r.doc_id in out, len(x), sum(counts[w] > 0 for w in x))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    again, _ = pitman_yor.language_model(docs.select("doc_id", "text"), held)
    assert {r.doc_id: r.score for r in rows} == {r.doc_id: r.score for r in again.collect()}
    assert pitman_yor.language_model(empty.select("doc_id", "text"), F.lit(False))[0].count() == 0


def test_model_is_a_distribution():
    """The probabilities of all known words and of one unknown add up to one in every context."""
    rng = np.random.default_rng(0)
    words = np.sort(rng.integers(1, 1 << 60, 50).astype(np.uint64))
    word, context = rng.integers(0, 50, 4000), rng.integers(0, 5, 4000).astype("<u2")
    order = np.lexsort((context, word))
    word, context = word[order], context[order]
    used, counts = np.unique(word, return_counts=True)
    every = np.repeat(words, 5)  # held-out document 1 asks for every word in every context
    payloads = []
    for w, c, u, flags in ((words[used], counts, context, b"\0"), (words, np.full(50, 5), np.tile(np.arange(5, dtype="<u2"), 50), b"\x80")):
        head = np.array([len(w), len(u), 1], "<u4").tobytes()
        payloads.append(head + w.tobytes() + c.astype("<u4").tobytes() + u.tobytes() + np.zeros(len(u), "<u2").tobytes() + flags)
    part = pitman_yor.Part([0, 1], payloads)
    assert len(part.pairs) == len(every)
    model = pitman_yor.Model(4000, len(used))
    model.customers = np.bincount(part.context, weights=part.customers, minlength=pitman_yor.CONTEXTS)
    for s in range(pitman_yor.SWEEPS + 1):
        for tables, customers, parents in model.replay(part, 0, 1, s):
            pass
        own = np.bincount(part.context, weights=tables, minlength=pitman_yor.CONTEXTS)
        model.sweeps.append(pitman_yor.Totals(own, int(customers.sum()), int(parents.sum())))
    total = np.bincount(part.context, weights=10 ** model.score(part, 0, 1)[0])
    assert (total < 1).all() and (total > 0.98).all()


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, size):
    sets = {i: shingles(t, size) for i, t in ROWS}
    want = groups(sets)
    for r in near_duplicates.near_duplicates(docs.select("doc_id", "text"), size).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_in_long_lists(spark, empty):
    """A passage in 120 documents, and a chain of copies that all share it: only the chain is linked."""
    passage = [f"p{k}" for k in range(40)]
    rows = [(i, " ".join(passage + [f"d{i}w{k}" for k in range(30)])) for i in range(120)]
    chain = [f"c{k}" for k in range(100)]
    for i in range(200, 240):
        chain = chain[:-2] + [f"n{i}a", f"n{i}b"] if i % 2 else [f"n{i}a", f"n{i}b"] + chain[2:]
        rows.append((i, " ".join(passage + chain)))
    rows.append((None, rows[0][1]))
    sets = {i: shingles(t, 5) for i, t in rows if i is not None}
    want = groups(sets)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert near_duplicates.near_duplicates(empty.select("doc_id", "text")).count() == 0


def test_blocks_join_what_all_pairs_join(spark):
    """Lists longer than a block, compared block by block, link the same components as comparing all pairs."""
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(1, 1 << 60, 40))
    sets = {}
    for i in range(600):
        own = base.copy()
        own[rng.integers(0, len(own), i % 30)] = rng.integers(1, 1 << 60, i % 30)
        sets[i] = np.unique(own).astype(np.uint64)
    df = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in sets.items()], "id long, n long, s binary")
    lists = spark.createDataFrame([(7, i, i) for i in sets], "v long, id long, comp long")
    want = groups({i: set(s.tolist()) for i, s in sets.items()})
    found = {i: i for i in sets} | {r.node: r.component for r in components(near_duplicates.in_blocks(lists, df, 80)).collect()}
    assert found == want and 1 < len(set(want.values())) < 600


def test_lines(docs, empty):
    lines = collections.defaultdict(list)
    for i, text in ROWS:
        for k, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                lines[line].append((i, k))
    names = sorted(lines, key=lambda x: min(lines[x]))
    plain = [" ".join(WORD.findall(lower(x))) for x in names]
    sets = {k: {x[a : a + 5] for a in range(max(1, len(x) - 4))} for k, x in enumerate(plain)}
    gone = collections.defaultdict(set)
    for k, group in groups(sets).items():
        for place in lines[names[k]]:
            if place != min(lines[names[group]]):
                gone[place[0]].add(place[1])
    pairs = docs.select("doc_id", "text")
    for r in line_dedup.removed_lines(pairs).collect():
        assert set(r.removed) == gone[r.doc_id] and r.n_removed == len(r.removed)
    kept = {r.doc_id: r.text for r in line_dedup.without_duplicates(docs).collect()}
    for i, text in ROWS:
        left = [x for k, x in enumerate((text or "").split("\n")) if k not in gone[i]]
        if gone[i] and not any(WORD.search(x) for x in left):
            assert i not in kept
        else:
            assert (kept[i] or "") == "\n".join(left)
    assert line_dedup.without_duplicates(empty).columns == empty.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body>
<header>Site name</header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>The &amp; title</h1></header><p>First  paragraph <b>with</b>
bold text,&nbsp;and a <a href="x>y">link</a> in it.<p>Second one.<div class="share">Share</div><p>Be.</p><form><p>Your name</p></form></article>
<aside>Elsewhere</aside><section id="comments"><article class=comment><p>I agree with all of this, very much indeed.</p></article></section><footer>(c)</footer>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "The & title\nFirst paragraph with bold text, and a link in it.\nSecond one.\nBe."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p><!-- x") == ""
    plain = "<div id=a><a href=1>x</a> <a href=2>y</a></div><div id=b><p>" + "long text here " * 9 + "</p><p>more of it, too, as text goes</p></div>"
    assert html_text.main_text(plain).startswith("long text here") and html_text.main_text(plain).endswith("goes")
    deep = "<div>" * 3000 + "<p>deep text</p>"
    assert html_text.main_text(deep) == "deep text"
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[1].startswith("The & title") and got[2] == ""


def test_byte_bpe_like_the_library(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.TextEncoder(ranks, public_tokenizers.PATTERN)
    import random

    rng = random.Random(4)
    marks = ["a", "b", " ", "  ", "\n", "é", "the", "1", "!", "　", "\x1c", "'s", "ß", "漢", "😀", "\t", "tion", "\r\n", "\x85"]
    for _ in range(2000):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(40)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode_ordinary(text), text
    rows = byte_bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).collect()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(r.text or "")
        assert r.decoded.decode() == (r.text or "")
    back = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN), path, out="again")
    assert {r.doc_id: r.again for r in back.collect()} == {i: t or "" for i, t in ROWS}
    with pytest.raises(ValueError):
        byte_bpe.encode(docs.withColumn("ids", F.lit(1)), path, public_tokenizers.PATTERN)


def test_streaming_decoder_splits_anywhere():
    data = "a é 漢 😀 z".encode()
    for cut in range(len(data)):
        stream = byte_bpe.Utf8Stream()
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.close() == data.decode()
    stream = byte_bpe.Utf8Stream()
    assert stream.feed(b"a\xe6") + stream.close() == "a�"
