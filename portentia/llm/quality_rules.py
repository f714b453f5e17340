"""Quality rules with risk-controlled thresholds.

Every document gets surface counts (one pass over its bytes). Each rule turns them into a badness score; a rule may
only use a cutoff for which labelled holdout documents prove, with an exact binomial bound, that good documents are
rejected no more often than `max_false_rejection`. Cutoffs are tested per stratum from lenient to strict and the walk
stops at the first that cannot be proven (fixed-sequence testing, which needs no correction inside a rule); the error
probability is divided over rules and strata (Bonferroni), so all proven bounds hold together with probability
1 - `delta`. The allowed rejection rate is divided over the rules as well, so their union stays below it. Strata are
languages; those with too few labels to prove anything share one stratum. Among proven cutoffs the most lenient one
that still catches what the strictest catches is used, so a bound is never spent without a gain.

Cases: null or empty text has no words and fails the base rule; labels for unknown documents, null labels and strata
with too few labels change nothing (a stratum without a proven cutoff rejects by the base rule only); a document
labelled several times counts once, as good only if all its labels say so; repeated rows are judged one by one; a table
without lang is one stratum; other columns, whatever their names, come through `keep_good` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.llm import arrays as A
from portentia.runtime import stage

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
NAMES = [c.split()[0] for c in COUNTS.split(", ")]
#: Of the proven cutoffs, the most lenient that rejects this share of the bad documents the strictest one rejects.
GAIN = 0.99


@dataclass(frozen=True)
class Rule:
    """A badness score in 0..1 and the number of equal steps between lenient (1) and strict (0) cutoffs."""

    name: str
    numerator: str
    denominator: str
    steps: int = 100

    def score(self) -> Column:
        return F.coalesce(F.col(self.numerator) / F.nullif(F.col(self.denominator), F.lit(0)), F.lit(0.0))


RULES = (
    Rule("symbols", "n_symbols", "word_chars"),
    Rule("duplicate_lines", "n_dup_lines", "n_lines"),
    Rule("repeated_words", "n_repeat_words", "n_words"),
)


def _counts(batches: Iterator[pa.RecordBatch], keep: list[str], place: int | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of the text column, or of the field at a place of the column row."""
    for batch in batches:
        texts = batch.column("text") if place is None else pc.struct_field(batch.column("row"), [place])
        for at, end, data, offs in A.slices(texts):
            rows, hashes, _ = A.words(data, offs, lower=False)
            n_words = np.bincount(rows, minlength=end - at)
            begin, win = A.windows(hashes, rows, 3)
            twice, _ = A.repeated(rows[begin], win)
            inside = np.zeros(len(hashes) + 3, dtype=bool)
            for k in range(3):
                inside[begin[twice] + k] = True
            line_row, _, line_start, line_end = A.lines(data, offs)
            line_hash = A.span_hash(A.prefix_sums(data), line_start, line_end)
            _, later = A.repeated(line_row, line_hash)
            measured = [
                n_words,
                A.row_sums(A.characters(data) & ~A.SPACE[data], offs),
                A.row_sums(SYMBOLS[data], offs),
                np.bincount(line_row[later], minlength=end - at),
                np.bincount(rows[inside[: len(rows)]], minlength=end - at),
                np.bincount(line_row, minlength=end - at),
            ]
            columns = [batch.column(c).slice(at, end - at) for c in keep]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(m.astype(np.int64)) for m in measured], names=keep + NAMES)


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """`keep` columns and the surface counts of every row's text."""
    picked = docs.select(*[_language(docs) if c == "lang" else docs[c] for c in keep], docs["text"].cast("string").alias("text"))
    fields = [f"`{n}` {t}" for n, t in picked.drop("text").dtypes]
    kept = list(keep)
    return picked.mapInArrow(lambda batches: _counts(batches, kept), ", ".join([*fields, COUNTS]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Binomial(n, p) <= k), the exact p-value of 'the rate is at least p' after k events in n."""
    if n == 0:
        return 1.0
    i = np.arange(k + 1)
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    logs = log_fact[n] - log_fact[i] - log_fact[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs - logs.max()).sum() * math.exp(logs.max())))


def select_cutoffs(
    counts: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, max_false_rejection: float = 0.01, delta: float = 0.05
) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> proven cutoff; scores above it may be rejected. Missing where nothing could be proven.

    The driver sees rows per stratum, rule and step only: their number depends on the languages and rules.
    """
    verdicts = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q"))
        .where("doc_id is not null and q is not null").groupBy("doc_id").agg(F.min("q").alias("q"))
    )
    held = counts.where(~base_failed()).join(verdicts, "doc_id").select(
        F.coalesce("lang", F.lit("")).alias("stratum"),
        (F.col("q") == 1).alias("good"),
        F.explode(
            F.array(*[
                # the strictest cutoff step that still accepts this document
                F.struct(F.lit(r.name).alias("rule"), F.ceil(F.least(r.score(), F.lit(1.0)) * r.steps).cast("int").alias("step"))
                for r in rules
            ])
        ).alias("x"),
    ).groupBy("stratum", "good", "x.rule", "x.step").agg(F.count("*").alias("n"))
    rows = held.collect()
    sizes: dict[str, int] = {}
    for row in rows:
        if row.rule == rules[0].name and row.good:
            sizes[row.stratum] = sizes.get(row.stratum, 0) + row.n
    each_rate = max_false_rejection / len(rules)
    each_delta = delta / (len(rules) * (len(sizes) + 1))
    provable = math.log(each_delta) / math.log1p(-each_rate)  # smaller strata could not prove even a perfect rule
    steps = {r.name: r.steps for r in rules}
    good: dict[tuple[str, str], np.ndarray] = {}
    bad: dict[tuple[str, str], np.ndarray] = {}
    for row in rows:
        stratum = row.stratum if sizes.get(row.stratum, 0) >= provable else ""
        hist = (good if row.good else bad).setdefault((stratum, row.rule), np.zeros(steps[row.rule] + 1, dtype=np.int64))
        hist[row.step] += row.n
    chosen: dict[tuple[str, str], float] = {}
    for key, hist in good.items():
        n, top, proven = int(hist.sum()), steps[key[1]], None
        for step in range(top - 1, -1, -1):
            if binomial_tail(n, int(hist[step + 1 :].sum()), each_rate) > each_delta:
                break
            proven = step
        if proven is None or key not in bad:
            continue
        caught = bad[key][::-1].cumsum()[::-1]  # caught[s + 1]: bad documents that cutoff s rejects
        worth = [s for s in range(proven, top) if caught[s + 1] >= GAIN * caught[proven + 1] > 0]
        if worth:
            chosen[key] = worth[-1] / top
    return chosen


def judge(counts: DataFrame, cutoffs: dict[tuple[str, str], float], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, failed_rules (array) and kept."""
    named = sorted({s for s, _ in cutoffs if s})
    stratum = F.when(F.col("lang").isin(named), F.col("lang")).otherwise(F.lit("")) if named else F.lit("")
    checks = []
    for r in rules:
        limit = F.lit(None).cast("double")
        for (s, name), cut in cutoffs.items():
            if name == r.name:
                limit = F.when(stratum == s, F.lit(cut)).otherwise(limit)
        checks.append(F.when(F.coalesce(r.score() > limit, F.lit(False)), F.lit(r.name)))
    return counts.withColumn("base_failed", base_failed()).withColumn(
        "failed_rules", F.filter(F.array(*checks), lambda x: x.isNotNull())
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, **risk: float) -> DataFrame:
    """Counts, failed rules and verdict of every document.

    The counts are a narrow table: written once, then read for the labelled holdout and for the verdicts.
    """
    counts = stage(text_counts(docs), "quality")
    return judge(counts, select_cutoffs(counts, labels, rules, **risk), rules)


def keep_good(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, **risk: float) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    Cutoffs come from one pass over the texts; the verdict is then taken row by row in a second pass, so no text is
    shuffled and rows need no unique id.
    """
    cutoffs = select_cutoffs(text_counts(docs), labels, rules, **risk)
    place = docs.columns.index("text")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _language(docs))
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    counted = rows.mapInArrow(lambda batches: _counts(batches, ["row", "lang"], place), f"{fields}, {COUNTS}")
    return judge(counted, cutoffs, rules).where("kept").select("row.*")


def _language(docs: DataFrame) -> Column:
    """The stratum column; a table without one is one stratum."""
    return (docs["lang"] if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")
