"""Cases in which an operator once did less than its whole job."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from portentia.llm import html_text, line_dedup
from portentia.llm import sanitise as S


def test_rows_under_one_id_keep_their_own_lines(spark):
    """Null and repeated ids: a line is removed only from the row that repeats it; equal rows stay once."""
    word = ["amber", "basalt", "cedar", "dune", "ember", "fjord", "gully", "heath"]
    line = {w: f"{w} {w[::-1]} lies {w.upper()} by itself, {w * 2}" for w in word}
    common = "A line that several of the texts hold, word by word and mark by mark."
    for key in (None, 7):
        rows = [
            (1, f"{line['amber']}\n{common}", "a"), (key, f"{line['basalt']}\n{line['cedar']}", "b"),
            (key, f"{common}\n{line['dune']}", "c"), (key, f"{line['ember']}\n{common}", "d"),
            (9, f"{line['fjord']}\n\n{line['gully']}", "e"), (9, f"{line['fjord']}\n\n{line['gully']}", "e"), (9, None, "f"), (9, None, "f"),
        ]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        texts = [r.text for r in line_dedup.without_duplicates(df).collect()]
        assert sum(common in (t or "").split("\n") for t in texts) == 1
        for w in ("amber", "basalt", "cedar", "dune", "ember", "fjord", "gully"):
            assert sum(line[w] in (t or "").split("\n") for t in texts) == 1, w
        assert texts.count(None) == 2 and len(texts) == 7
        got = [(r.doc_id, r.n_lines, r.removed) for r in line_dedup.removed_lines(df.select("doc_id", "text")).collect()]
        assert len(got) == len(rows) and sum(len(r) for *_, r in got) == 4
        assert sorted(r for i, n, r in got if n == 3) == [[], [0, 2]]


def test_equal_places_of_different_texts_are_different_lines(spark):
    """Line 0 of two texts under one id: the second one goes."""
    rows = [(5, "The same first line, long enough to matter.\nalpha beta gamma"), (5, "The same first line, long enough to matter.\ndelta epsilon zeta")]
    got = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.removed for r in got) == [[], [0]]


@pytest.mark.parametrize("contexts", [1, 2, 3])
def test_terms_of_rare_entities_are_found(spark, contexts):
    """A nickname met next to one address only, in one to three passages, also gives it away; copies prove nothing more."""
    rows = [(k, f"note {k + 10} from quuxley today\nwrite to kim@mail.example.org at {k + 10} please") for k in range(contexts)]
    rows += [(50 + k, f"note {k} write to us please today at {k} from office, nothing else {k * 3}") for k in range(600)]
    rows += [(30, rows[0][1]), (40, "From frimble: write to lee@mail.example.org"), (41, "The frimble is gone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [t.value for t in r.term or []] for r in S.find_spans(df).collect()}
    assert found[0] == found[30] == ["quuxley"] and not found[41] and not found[60]


TEXT = "<p>" + "Some words of the article stand here. " * 6 + "</p>"


def test_names_alone_cut_no_article():
    """Wrappers, titles and paragraphs whose class holds a name such as sidebar, header or alert stay."""
    for wrapper in ('class="layout has-sidebar"', 'id="content-with-sidebar"', 'class="sidebar"', "class=header"):
        assert html_text.main_text(f"<div {wrapper}><div>{TEXT}{TEXT}</div></div>").count("Some words") == 12
    for name in ("alert", "notice", "share", "search", "promo"):
        page = f'<article><div class="entry-header"><h1>Title here</h1></div>{TEXT}<p class="{name}">Take great care.</p>{TEXT}</article>'
        got = html_text.main_text(page)
        assert got.startswith("Title here\n") and "\nTake great care.\n" in got
    page = f'<div class="sidebar"><p>Other</p></div><article>{TEXT}<div class="share"><a href=1>Share</a> it</div><div class="comments"><h3>Replies</h3>{TEXT}</div>{TEXT}</article>'
    assert html_text.main_text(page).count("Some words") == 12 and "Share" not in html_text.main_text(page)


def test_text_beside_the_article_is_kept():
    """Title, lead and further sections next to an article stay if they reach the threshold, whatever their tags."""
    article, words = f"<article>{TEXT * 5}<p>One <b>more</b> <i>part</i>.</p></article>", "Words of a lead or section that stands outside the article. " * 4
    page = f"<body><main><h1>The title of the page is long enough</h1><p>{words}</p>{article}<section><p>{words}</p></section></main><div><a href=1>Menu</a> <a href=2>x</a></div></body>"
    got = html_text.main_text(page).split("\n")
    assert got[0] == "The title of the page is long enough" and got[1] == got[-1] == words.strip() and len(got) == 9


def test_added_tokens_are_taken_as_the_library_takes_them():
    """With the library's defaults, also inside words and in capitals."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from portentia.llm.token_files import WordIds

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, mine = Tokenizer.from_file(path), WordIds(path)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    texts = [f"hi {t} you" for t in added] + [f"a{t}b {t.upper()}." for t in added] + ["plain words, <| none of them |>"]
    for text, got in zip(texts, mine.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_many_empty_texts_keep_their_own_scores(spark):
    """More documents in a block than 16 bits can number, whatever the size of the batches."""
    import pyarrow as pa

    from portentia.llm.pitman_yor import BLOCK_DOCS, _blocks

    n = 2 * BLOCK_DOCS + 5000
    for size in (1000, 10_000, n):
        batch = pa.RecordBatch.from_pydict({"text": [""] * n, "doc_id": list(range(n)), "held_out": [False] * n})
        blocks = list(_blocks(batch.slice(k, size) for k in range(0, n, size)))
        assert [i for ids, *_ in blocks for i in ids] == list(range(n))
        assert all(len(ids) <= BLOCK_DOCS and doc.tolist() == list(range(len(ids))) for ids, _, _, doc, *_ in blocks)


def test_parts_of_the_word_model_go_to_python_a_few_at_a_time(spark):
    """A batch of Arrow holds BATCH_BYTES of parts, not Spark's default of 64 MB."""
    import pyarrow as pa

    from portentia.llm import pitman_yor as P

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.createDataFrame([(k, "a b c") for k in range(20)], "doc_id long, text string")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    scores, _ = P.language_model(docs, F.col("doc_id") % 10 == 0)
    assert scores.count() == 20
    rows = spark.range(0, 24, 1, 1).select(F.expr("cast(repeat('abcdefgh', 131072) as binary) as b"))
    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= P.BATCH_BYTES + (2 << 20)


def test_pieces_of_a_cut_are_kept():
    """Letters in a cut with other marks are the word met before; of the rest every piece goes through the transducer once."""
    from portentia.llm import byte_bpe as B

    coder = B.TextEncoder(B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    text = "Zaunkönigin zaunkönigin&&& x\0y zaunkönigin$$$12\n\nab zaunkönigin"
    whole = coder._pieces(text)
    asked: list[bytes] = []
    encode = coder.transducer.encode
    coder.transducer.encode = lambda piece: asked.append(piece) or encode(piece)
    assert coder.encode(text) == whole
    assert coder.encode(" zaunkönigin###### zaunkönigin&&&$$$") == coder._pieces(" zaunkönigin###### zaunkönigin&&&$$$")
    assert " zaunkönigin".encode() not in asked and len(asked) == len(set(asked))


def test_marks_after_letters_cost_no_new_encoding():
    """The letters of a known word are not encoded again because other marks follow them, and ids stay the tokenizer's."""
    from portentia.llm import token_files as T

    coder = T.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" haus  b\tc\n", "", " ", "Haus$$$ haus!!! l'été's don't DON'T#$ (x) a-b, <b> É*** ab1$$ $$ab  x", "a<|endoftext|>b", "it's's--'s ab'-' x$'s"]
    plain = coder._batch(texts)
    assert coder.encode(texts) == plain and coder.encode(texts[::-1]) == plain[::-1]
    asked: list[str] = []
    batch = coder._batch
    coder._batch = lambda words: asked.extend(words) or batch(words)
    again = ["haus### Haus&&& haus%%%.", "HAUS||"]
    assert coder.encode(again) == batch(again)
    assert not any(c.isalpha() for word in asked for c in word)


def test_states_and_words_of_bpe_fit_a_worker(monkeypatch):
    """What a worker keeps takes less than 450 MB at its limits; ids stay the same when states are forgotten."""
    import random
    import tracemalloc

    from portentia.llm import byte_bpe as B

    ranks = B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    parts = ["ein", "haus", "ly", "tra", "ße", "ung", "qu", "xo", "ber", "É", "ati", "on", "9", "ght"]
    words = [" " + "".join(rng.choices(parts, k=rng.randrange(2, 5))) for _ in range(4000)]
    coder = B.TextEncoder(ranks, public_tokenizers.PATTERN)
    machine = coder.transducer
    tracemalloc.start()
    whole = [machine.encode(w.encode()) for w in words]
    states = tracemalloc.get_traced_memory()[0] / (len(machine.states) + len(machine.pairs) / 4)
    before = tracemalloc.get_traced_memory()[0]
    for w in words:
        coder.encode(w)
    word = (tracemalloc.get_traced_memory()[0] - before) / len(coder.words)
    tracemalloc.stop()
    assert states * (B.STATES + getattr(B, "FRESH", 0)) + 2 * word * (B.CUTS + B.PIECES) < 450e6
    monkeypatch.setattr(B, "STATES", 1500)
    monkeypatch.setattr(B, "FRESH", 300)
    machine.reset()
    assert [machine.encode(w.encode()) for w in words] == whole
    kept = list(machine.states)[:500]
    assert len(machine.states) < 2000 and [machine.encode(w.encode()) for w in words] == whole
    assert list(machine.states)[:500] == kept


def test_a_frequent_word_takes_little_memory():
    """A part with one very frequent word needs a few bytes a token (its payload apart), and keeps its counts."""
    import tracemalloc

    import numpy as np

    from portentia.llm import pitman_yor as P

    rng = np.random.default_rng(3)
    n, payloads = 30_000, []
    for _ in range(30):
        context, docs = np.sort(rng.integers(0, 400, n).astype("<u2")), rng.integers(0, 2000, n).astype("<u2")
        head = np.array([1, n, 250], "<u4").tobytes() + np.array([7], "<u8").tobytes() + np.array([n], "<u4").tobytes()
        payloads.append(head + context.tobytes() + docs.tobytes() + bytes(125) + b"\xff" * 125)
    tracemalloc.start()
    part = P.Part(list(range(30)), payloads)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * 30 * n
    docs = [np.frombuffer(p, "<u2", n, 24 + 2 * n) for p in payloads]
    assert int(part.customers.sum()) == sum(int((d < 1000).sum()) for d in docs)
    assert all(counts.sum() == n and (d == own).all() for (counts, own), d in zip(part.cells, docs))


def test_scores_are_added_up_before_they_leave_a_task(spark):
    """A block's document gets one row of sums from a task, however many parts the task reads."""
    from portentia.llm import pitman_yor as P

    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.expr("concat('a b c ', id, ' d e ', id % 7)").alias("text"))
    flagged = docs.withColumn("held_out", F.col("doc_id") % 10 == 0)
    dealt = P.deal(flagged, 8).groupBy("part").agg(F.collect_list(F.struct("block", "payload", "ids", "held", "tokens")).alias("cells"))
    dealt = dealt.coalesce(1).cache()
    parts = dealt.where("part >= 0").select("part", F.transform("cells", lambda c: F.struct(c["block"].alias("block"), c["payload"].alias("payload"))).alias("cells"))
    blocks = dealt.where("part < 0").select(F.explode("cells").alias("c")).select("c.*")
    assert parts.count() > 4
    rows = []
    union = type(blocks).unionByName
    try:
        type(blocks).unionByName = lambda self, other: rows.append(self.where("payload is not null").count()) or union(self, other)
        scores = P.score(blocks, parts, P.train(parts)).collect()
    finally:
        type(blocks).unionByName = union
    assert rows == [1]
    assert sorted((r.doc_id, r.held_out, r.n_tokens) for r in scores) == [(k, k % 10 == 0, 8) for k in range(40)]


def test_words_met_again_outlive_those_met_once(monkeypatch):
    """However many new words come between, a word met in two batches is not encoded again; ids stay the tokenizer's."""
    from portentia.llm import token_files as T

    monkeypatch.setattr(T, "WORDS", 50)
    monkeypatch.setattr(T, "FRESH", 50, raising=False)
    coder = T.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    common = "Zaunkönig ab's zaunkönig, x1y"
    for _ in range(2):
        assert coder.encode([common]) == coder._batch([common])
    for k in range(6):
        rare = [" ".join(f"r{k}z{j}q" for j in range(60)), "y" * 80]
        assert coder.encode(rare) == coder._batch(rare)
    assert len(coder.words) < 60
    asked: list[str] = []
    stems, batch = coder._stems, coder._batch
    monkeypatch.setattr(coder, "_stems", lambda words: asked.extend(words) or stems(words))
    monkeypatch.setattr(coder, "_batch", lambda words: asked.extend(words) or batch(words))
    assert coder.encode([common]) == batch([common])
    assert asked == []


def test_a_frequent_word_has_many_small_rows(spark, monkeypatch):
    """Rows of a part stay small however often its words occur, sweeps read counts only, and scores stay the same."""
    from portentia.llm import pitman_yor as P

    docs = spark.range(0, 300, 1, 12).select(F.col("id").alias("doc_id"), F.expr("concat('a ', id % 11, ' a ', id, ' b a ', id % 7)").alias("text"))
    want = {r.doc_id: r for r in P.language_model(docs, F.col("doc_id") % 10 == 0)[0].collect()}
    monkeypatch.setattr(P, "CELL_BYTES", 100, raising=False)
    rows = P.gathered(P.deal(docs.withColumn("held_out", F.col("doc_id") % 10 == 0), 4)).where("part >= 0")
    sizes = rows.select("part", F.aggregate("cells", F.lit(0), lambda n, c: n + F.octet_length(c["payload"])).alias("n"), "pairs").collect()
    assert len(sizes) > 40 and max(r.n for r in sizes) < 1000
    assert sorted(r.part for r in sizes if r.pairs is not None) == [0, 1, 2, 3]
    got = {r.doc_id: r for r in P.language_model(docs, F.col("doc_id") % 10 == 0)[0].collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r[:4] == want[k][:4] and abs(r.score - want[k].score) < 1e-9 and abs(r.base_score - want[k].base_score) < 1e-9
