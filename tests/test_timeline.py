import pytest
from pyspark.sql import functions as F

from helpers import by_key, minutes_of, series, states_df
from portentia import Timeline
from portentia.operators import sequences as S
from portentia.timeline import over_blocks, with_row_index

ROWS = series(150, keys=("a", "b"))
TL = Timeline(60, ("key",), block_buckets=16)


def test_row_index_counts_across_chunks(spark):
    got = with_row_index(states_df(spark, ROWS), TL).orderBy("key", "time_window").collect()
    for key, rows in by_key(ROWS).items():
        assert [r["row_index"] for r in got if r["key"] == key] == list(range(len(rows)))


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_row_frames_cross_gaps_and_blocks(spark, block):
    tl = Timeline(60, ("key",), block_buckets=block)
    out = over_blocks(
        states_df(spark, ROWS),
        tl,
        lambda w: {
            "s": F.sum("a").over(w.rowsBetween(-7, 0)),
            "n": F.count("a").over(w.rowsBetween(-7, 3)),
            "l": F.lag("a", 3).over(w),
        },
        before=7,
        after=3,
        rows=True,
    ).collect()
    assert len(out) == len(ROWS)
    got = {(r["key"], minutes_of(r["time_window"])): r for r in out}
    for key, rows in by_key(ROWS).items():
        for j, row in enumerate(rows):
            r = got[(key, row[1])]
            assert r["s"] == pytest.approx(sum(x[3] for x in rows[max(0, j - 7) : j + 1]))
            assert r["n"] == len(rows[max(0, j - 7) : j + 4])
            assert r["l"] == (rows[j - 3][3] if j >= 3 else None)


def contiguous(rows, lo, hi):
    return 0 <= lo and hi < len(rows) and rows[hi][1] - rows[lo][1] == hi - lo


@pytest.mark.parametrize("block", [12, 64])
def test_sequences_targets_and_coverage(spark, block):
    tl = Timeline(60, ("key",), block_buckets=block)
    df = states_df(spark, ROWS)
    seq = {
        (r["key"], minutes_of(r["time_window"])): r
        for r in S.sequences(df, tl, ["a", "b"], length=4).collect()
    }
    normal = {
        (r["key"], minutes_of(r["time_window"]))
        for r in S.sequences(df, tl, ["a"], length=4, normal_only=True).collect()
    }
    naive = S.sequences(df, tl, ["a"], length=4, check_gaps=False).collect()
    targets = {
        (r["key"], minutes_of(r["time_window"])): r
        for r in S.forecast_targets(df, tl, (3, 6)).collect()
    }
    covered = {
        (r["key"], minutes_of(r["time_window"])): r["covered"]
        for r in S.normal_coverage(df, tl, 4).collect()
    }
    expected_naive = 0
    for key, rows in by_key(ROWS).items():
        expected_naive += len(rows) - 4
        qualifying = set()
        for j, row in enumerate(rows):
            at = (key, row[1])
            full = contiguous(rows, j - 3, j + 1)
            assert (at in seq) == full
            if full:
                assert seq[at]["x"] == [[x[3], x[4]] for x in rows[j - 3 : j + 1]]
                assert seq[at]["y"] == [rows[j + 1][3], rows[j + 1][4]]
            all_normal = full and not any(x[2] for x in rows[j - 3 : j + 2])
            assert (at in normal) == all_normal
            if all_normal:
                qualifying.update(range(j - 3, j + 2))
            for h in (3, 6):
                if contiguous(rows, j, j + h):
                    hit = int(any(x[2] for x in rows[j + 1 : j + h + 1]))
                    labels = [x[2] for x in rows[j : j + h + 1]]
                    starts = any(p == 0 and q == 1 for p, q in zip(labels, labels[1:]))
                    want = (hit, 0 if row[2] else int(starts))
                else:
                    want = (None, None)
                r = targets[at]
                assert (r[f"positive_within_{h}"], r[f"starts_within_{h}"]) == want
        for j, row in enumerate(rows):
            assert covered[(key, row[1])] == int(j in qualifying)
    assert len(naive) == expected_naive


def test_runs_transitions_and_splits(spark):
    df = states_df(spark, ROWS)
    periods = {
        (r["key"], minutes_of(r["start"]), minutes_of(r["end"]), r["duration"])
        for r in S.attack_periods(df, TL).collect()
    }
    changes = {(r["key"], minutes_of(r["time_window"])) for r in S.state_transitions(df, TL).collect()}
    split = S.chronological_split(df, TL, 0.7).collect()
    positional = S.positional_split(df, TL, 40, 60, 10).collect()
    want_periods, want_changes = set(), set()
    for key, rows in by_key(ROWS).items():
        run = []
        for r in [x for x in rows if x[2] == 1] + [None]:
            if run and (r is None or r[1] - run[-1] != 1):
                want_periods.add((key, run[0], run[-1], len(run)))
                run = []
            if r:
                run.append(r[1])
        want_changes |= {(key, b[1]) for a, b in zip(rows, rows[1:]) if a[2] != b[2]}
        train = [r for r in split if r["key"] == key and r["split"] == "train"]
        assert len(train) == int(len(rows) * 0.7)
        parts = [r["split"] for r in positional if r["key"] == key]
        assert (parts.count("test"), parts.count("buffer")) == (20, 20)
    assert periods == want_periods
    assert changes == want_changes


def test_index_blocks_ignore_time(spark):
    indexed = with_row_index(states_df(spark, ROWS), TL)
    got = S.index_blocks(indexed, TL, F.col("is_positive") == 1).collect()
    total = sum(r["length"] for r in got)
    assert total == sum(r[2] for r in ROWS)
    assert all(r["last_index"] - r["first_index"] + 1 == r["length"] for r in got)


def test_keyed_result_equals_single_key_run(spark):
    only = [r for r in ROWS if r[0] == "a"]
    keyed = S.forecast_targets(states_df(spark, ROWS), TL).filter("key = 'a'").drop("key")
    single = S.forecast_targets(
        states_df(spark, only).drop("key"), Timeline(60, (), block_buckets=16)
    )
    assert sorted(map(tuple, keyed.collect()), key=str) == sorted(map(tuple, single.collect()), key=str)


@pytest.mark.parametrize("n, expected", [(9, 0), (10, 0), (11, 1)])
def test_short_series(spark, n, expected):
    rows = [("a", i, 0, 1.0, 2.0) for i in range(n)]
    assert S.sequences(states_df(spark, rows), TL, ["a"]).count() == expected


def test_ids_in_time_order(spark):
    df = states_df(spark, ROWS).withColumn("id", F.unix_timestamp("time_window"))
    assert S.is_time_ordered(df, TL, "id").first()[0]
    assert not S.is_time_ordered(df.withColumn("id", -F.col("id")), TL, "id").first()[0]
