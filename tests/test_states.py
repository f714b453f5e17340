import pytest
from pyspark.sql import functions as F

from helpers import minute
from portentia import Timeline
from portentia.operators.quality import compare_tables, missing_check
from portentia.operators.scaling import fit_scaler, scale_states, scaler_row, scaler_table, unscale_states
from portentia.operators.states import (
    build_states,
    feature_medians,
    fill_medians,
    fill_normal_medians,
    fill_zero,
)
from portentia.sources import flows as FL
from portentia.sources import tables as TB

TL = Timeline(60)
CSV = """Timestamp , Label, x ,y,z
01/02/2024 10:00:05,Benign,1.5,Infinity,
01/02/2024 10:00:45, INFILTERATION ,2.5,3,
Timestamp,Label,x,y,z
01/02/2024 10:01:00,Benign,junk,NaN,
1/2/2024 10:01,Benign,4,-inf,
31/31/2024 10:01:00,Benign,9,9,
13/02/2024 08:30:00,Infilteration,,5,
"""


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "flows.csv"
    path.write_text(CSV)
    columns = FL.csv_columns(spark, str(path))
    return FL.read_csv(spark, str(path), columns)


def test_clean_flows(raw):
    assert raw.columns == ["Timestamp", "Label", "x", "y", "z"]
    rows = FL.clean_flows(raw, ["x", "y", "z"]).orderBy("ts", "x").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [
        (1.5, None, None), (2.5, 3.0, None), (None, None, None), (4.0, None, None), (None, 5.0, None),
    ]
    assert str(rows[-1]["ts"]) == "2024-02-13 08:30:00"


def test_missing_column_is_an_error(raw):
    with pytest.raises(ValueError, match="missing columns: q"):
        FL.clean_flows(raw, ["q"])


def test_missing_check(raw):
    got = {r["feature"]: tuple(r)[1:] for r in missing_check(raw, ["x", "y"]).collect()}
    assert got["x"] == (7, 1, 3, 2)
    assert got["y"] == (7, 1, 2, 1)


def test_fused_imputation_equals_two_steps(raw):
    clean = FL.clean_flows(raw, ["x", "y", "z"])
    medians = feature_medians(clean, ["x", "y", "z"])
    fused = build_states(clean, ["x", "y", "z"], TL, "Label", "infilteration", medians=medians)
    two = build_states(
        fill_medians(clean, ["x", "y", "z"], medians), ["x", "y", "z"], TL, "Label", "infilteration"
    )
    a = [tuple(r) for r in fused.orderBy("time_window").collect()]
    assert a == [tuple(r) for r in two.orderBy("time_window").collect()]
    assert a[0][1:] == (2.0, 3.5, None, 2, 0.5, 1)
    stored = TB.as_dict(medians, "feature", "median")
    from_dict = build_states(clean, ["x", "y", "z"], TL, "Label", "infilteration", medians=stored)
    assert a == [tuple(r) for r in from_dict.orderBy("time_window").collect()]


def test_row_order_and_partitioning_do_not_matter(raw):
    clean = FL.clean_flows(raw, ["x", "y"])
    one = build_states(clean, ["x"], TL, "Label", "infilteration")
    other = build_states(clean.orderBy(F.desc("ts")).repartition(5), ["x"], TL, "Label", "infilteration")
    diff = compare_tables(one, other, ["time_window"], ["x", "flow_count"]).collect()
    assert all(r["mismatches"] == 0 for r in diff) and diff[1]["rows"] == 3


def test_ratio_threshold_is_strict(spark):
    rows = [(minute(0), "p"), (minute(0), "n"), (minute(1), "p"), (minute(1), "p")]
    df = spark.createDataFrame(rows, "ts timestamp, label string")
    flags = build_states(df, [], TL, "label", "p", ratio_threshold=0.5).orderBy("time_window").collect()
    assert [r["is_positive"] for r in flags] == [0, 1]


def test_normal_median_fill_and_zero_fill(spark):
    rows = [(0, 1.0, None), (0, 3.0, None), (0, None, None), (1, 100.0, None), (1, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "is_positive int, v double, w double")
    got = fill_normal_medians(df, ["v", "w"]).collect()
    assert [r["v"] for r in got] == [1.0, 3.0, 2.0, 100.0, 2.0]
    assert [r["w"] for r in got] == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert [r["v"] for r in fill_zero(df, ["v"]).collect()] == [1.0, 3.0, 0.0, 100.0, 0.0]


def test_scaler_roundtrip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    scaler = fit_scaler(df, ["a", "c"], fit_rows="all")
    assert tuple(scaler.first()) == (2.0, 1.0, 5.0, 1.0)
    reloaded = scaler_row(scaler_table(scaler, ["a", "c"]))
    scaled = scale_states(df, ["a", "c"], reloaded)
    assert [tuple(r) for r in scaled.collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert unscale_states(scaled, ["a", "c"], scaler).collect() == df.collect()


def test_table_store(spark, tmp_path):
    rows = [(minute(i * 400), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "time_window timestamp, v double")
    path = str(tmp_path / "t")
    TB.write_table(df, path)
    part = TB.read_table(spark, path, "2024-01-02", "2024-01-04")
    assert part.count() == sum(1 for t, _ in rows if 2 <= t.day < 4)
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in scan
    TB.export_csv(df, str(tmp_path / "csv"))
    back = FL.parse_times(FL.read_csv(spark, str(tmp_path / "csv"), ["time_window", "v"]))
    assert dict(back.dtypes)["time_window"] == "timestamp" and back.count() == 20


def test_schema_helpers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "s")], "id int, b double, label string")
    assert FL.feature_columns(df, ["label"]) == ["id", "b"]
    assert FL.feature_columns(df, ["id"], numeric_only=True) == ["b"]
    out = FL.with_features(df, ["c", "b"], {"c": 7.0})
    assert out.columns == ["id", "label", "c", "b"] and out.first()["c"] == 7.0
    with pytest.raises(LookupError):
        FL.require_rows(df.filter("id = 9"), "id 9")
    for name in ("train", "test"):
        (tmp_path / f"{name}.csv").write_text("id,label\n1,0\n")
    both = FL.read_split_csv(
        spark, {n: str(tmp_path / f"{n}.csv") for n in ("train", "test")}, ["id", "label"]
    )
    assert sorted(r["split"] for r in both.collect()) == ["test", "train"]


def test_time_range_bounds(spark):
    df = spark.createDataFrame([(minute(i),) for i in range(5)], "time_window timestamp")
    a, b = "2024-01-01 00:01:00", "2024-01-01 00:03:00"
    assert FL.in_time_range(df, a, b).count() == 2
    assert FL.in_time_range(df, a, b, closed=True).count() == 3
