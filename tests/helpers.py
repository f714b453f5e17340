"""Small series with gaps, and straightforward Python versions of the rules to compare with."""

import datetime as dt
import random

from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def minute(i):
    return START + dt.timedelta(minutes=i)


def series(n=120, seed=3, gap=0.08, keys=("a",), positive=0.25):
    """Rows (key, minute, is_positive, a, b) with missing minutes."""
    rng = random.Random(seed)
    rows = []
    for key in keys:
        for i in range(n):
            if rng.random() < gap:
                continue
            rows.append(
                (key, i, int(rng.random() < positive), rng.gauss(5, 2), float(rng.randint(0, 9)))
            )
    return rows


def states_df(spark, rows):
    data = [(k, minute(i), p, a, b, float(p)) for k, i, p, a, b in rows]
    df = spark.createDataFrame(
        data, "key string, time_window timestamp, is_positive int, a double, b double, label_ratio double"
    )
    return df.withColumn("time_window", F.col("time_window").cast("timestamp"))


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def minutes_of(t):
    return int((t - START).total_seconds() // 60)
