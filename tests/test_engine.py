"""Stages on hand-made rows, and a sample of queries against their SQL."""

import datetime as dt
import math
import numbers

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hotgrid.config import Config, IncrementalWindow
from hotgrid.functions import exprs, hexgrid, rules
from hotgrid.operators import evaluate, features, gold, learn, panel, rank, silver
from hotgrid.plans import oracle, queries, shapes
from hotgrid.sources import layers, tables

CFG = Config(first_year=1995)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list:
    def plain(v):
        if pd.isna(v):
            return "None"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    days = {"date", "prediction_date", "day", "month", "run_date", "start", "end", "chunk_start", "chunk_end", "parsed", "first", "last", "month_start"}
    return sorted(tuple(plain(v)[:10] if c in days else plain(v) for c, v in zip(df.columns, r, strict=True)) for r in df.itertuples(index=False, name=None))


FITS = {"groupblend_predictions", "model_predictions", "feature_importance", "run_summary", "ablation", "ablation_errors", "stored_run_predictions", "stored_run_summary", "boosting_curve", "stored_run_importance"}


@pytest.mark.parametrize("name", list(oracle.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(oracle.ORACLE[name]).df()
    assert list(got.columns) == list(want.columns) and _rows(got) == _rows(want)


def test_every_query_but_fits_has_a_statement():
    assert set(queries.QUERIES) - set(oracle.ORACLE) == FITS


def test_every_statement_parses(duck):
    for name, sql in oracle.ORACLE.items():
        assert duck.sql(sql).columns == [c.split()[0] for c in queries.COLUMNS[name].split(", ")], name


def test_dates_in_two_formats(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05+00:00",), ("01/02/2020 03:04:05 PM",), ("x",), (None,)], "date string")
    got = [r.t for r in df.select(exprs.parse_ts("date").cast("string").alias("t")).collect()]
    assert got == ["2020-01-02 03:04:05", "2020-01-02 15:04:05", None, None]


def test_ratio_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 2.0), (9.0, 1.0), (-9.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(exprs.safe_ratio(F.col("a"), F.col("b"), 5)).collect()] == [0.0, 0.0, None, 5.0, -5.0]


def test_cells_and_rings(spark):
    df = spark.createDataFrame([(41.83, -87.73), (None, -87.7), (99.0, -87.7), (math.nan, -87.7)], "lat double, lon double")
    assert [r[0] for r in df.select(hexgrid.cell("lat", "lon")).collect()] == ["0_0", None, None, None]
    cells = spark.createDataFrame([(f"{q}_{r}",) for q in range(-3, 4) for r in range(-3, 4)] + [("50_50",)], "cell string")
    n = {(r.cell, r.ring): r["count"] for r in hexgrid.edges(cells).groupBy("cell", "ring").count().collect()}
    assert n["0_0", 1] == 6 and n["0_0", 2] == 12 and ("50_50", 1) not in n


def test_distance_of_equal_points_is_zero(spark):
    got = spark.range(1).select(exprs.great_circle_km(F.lit(41.8832), F.lit(-87.6324), F.lit(41.8832), F.lit(-87.6324))).first()[0]
    assert got == pytest.approx(0, abs=1e-4)


RAW = "unique_key long, case_number string, incident_ts timestamp, primary_type string, arrest boolean, domestic boolean, community_area int, latitude double, longitude double"


def _raw(spark, rows):
    return spark.createDataFrame([(k, f"C{k}", ts, t, a, False, 1, la, lo) for k, ts, t, a, la, lo in rows], RAW)


def test_cleaning_is_inclusive_and_deterministic(spark):
    day = dt.datetime(2000, 1, 1)
    rows = [(1, day, " theft ", True, 41.64, -87.94), (1, day, "ARSON", True, 41.64, -87.94), (2, day, "THEFT", True, 41.6399, -87.94), (3, None, "THEFT", True, 41.7, -87.7), (4, dt.datetime(2030, 1, 1), "THEFT", True, 41.7, -87.7)]
    got = silver.silver(_raw(spark, rows), "2001-01-01", CFG).collect()
    assert [(r.unique_key, r.primary_type) for r in got] == [(1, "ARSON")]
    assert silver.silver(_raw(spark, rows).limit(0), "2001-01-01", CFG).count() == 0
    with pytest.raises(ValueError):
        silver.validate(_raw(spark, rows).drop("latitude"))


def test_rolling_leaves_out_the_same_second(spark):
    d = dt.datetime(2000, 1, 1)
    rows = [(1, d, "THEFT", True, 41.7, -87.7), (2, d, "THEFT", False, 41.7, -87.7), (3, d + dt.timedelta(days=7), "THEFT", True, 41.7, -87.7), (4, d + dt.timedelta(days=31), "THEFT", True, 41.7, -87.7)]
    got = gold.rolling_events(silver.encode(_raw(spark, rows), CFG)).orderBy("unique_key").collect()
    assert [(r.crime_density_7d, r.crime_density_30d, r.arrest_rate) for r in got] == [(0, 0, 0), (0, 0, 0), (2, 2, 0.5), (0, 1, 1.0)]


@pytest.fixture(scope="module")
def toy():
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    rows = [(c, x, (i * 7 + k * 3) % 5 * ((i + k) % 3 > 0)) for k, c in enumerate(("0_0", "1_0", "9_9")) for i, x in enumerate(days)]
    return pd.DataFrame(rows, columns=["cell", "date", "crimes"])


def _panel(spark, toy):
    """A panel of the toy's incidents, a part of them violent, the rest property."""
    df = spark.createDataFrame(toy, "cell string, date date, crimes long").withColumns({"violent": F.col("crimes") % 3, "property": F.col("crimes") - F.col("crimes") % 3})
    zeros = {c: F.lit(0) for c in ("theft", "battery", "narcotics", "arrests")} | {c: F.dayofmonth("date").cast("double") for c in features.WEATHER}
    return df.withColumns(zeros | {"crime_today": (F.col("crimes") > 0).cast("int"), "dayofweek": F.weekday("date")})


def test_windows_equal_pandas(spark, toy):
    got = features.own_features(_panel(spark, toy)).toPandas().sort_values(["cell", "date"])
    for cell, own in toy.groupby("cell"):
        x, mine = own.crimes.reset_index(drop=True), got[got.cell == cell].reset_index(drop=True)
        same = lambda name, want, mine=mine: pd.testing.assert_series_equal(mine[name].astype(float), want.astype(float), check_names=False, atol=1e-9)
        past = x.shift(1)
        for w in (3, 30):
            for how in ("mean", "std", "max"):
                same(f"roll_{how}_{w}", getattr(past.rolling(w, min_periods=2), how)())
        for s in (7, 90):
            same(f"ewm_{s}", past.ewm(span=s, adjust=False, min_periods=2).mean())
        run, want = 0, []
        for v in x:
            run = 0 if v > 0 else run + 1
            want.append(run)
        assert list(mine.zero_streak) == want
        mean, std = past.rolling(30, min_periods=2).mean().fillna(0), past.rolling(30, min_periods=2).std().fillna(0)
        same("crime_z_30", ((x - mean) / std.where(std > 1e-12)).fillna(0).clip(-10, 10))
        same("near_repeat_5d", (past > 0).astype(int).rolling(5, min_periods=1).sum())
        same("near_repeat_3d", sum((x.shift(k) > 0).astype(int) for k in (1, 2, 3)))
        violent, prop = past % 3, past - past % 3
        same("property_lead_violent", (prop * (violent == 0)).where(past.notna()))


def test_features_do_not_see_the_future(spark, toy):
    cut = dt.date(2000, 3, 1)
    changed = toy.assign(crimes=toy.crimes.where(toy.date <= cut, 99))
    a, b = (features.own_features(_panel(spark, t)).where(F.col("date") <= F.lit(cut)).toPandas().sort_values(["cell", "date"]).reset_index(drop=True) for t in (toy, changed))
    pd.testing.assert_frame_equal(a, b)


def test_rules_of_names():
    want = {"nbr_r1_active_burst": "temporal", "city_total_lag1": "temporal", "nbr_r1_active_roll7": "spatial", "total_crimes": "context", "roll_mean_7": "temporal", "high_prior_x_friday": "context"}
    assert {n: rules.bucket(n) for n in want} == want
    assert rules.label("h3_recent_vs_comm", rules.ABLATION, rules.ABLATION_REST) == "community_city" and rules.label("sim_x", rules.FAMILY, "") == "Similarity graph"


def test_columns_of_rules_are_the_rules(spark):
    names = [c.split()[0] for c in shapes.FRAME_COLS.split(", ")]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in ((rules.BLEND, rules.BLEND_REST), (rules.ABLATION, rules.ABLATION_REST), (rules.FAMILY, rules.FAMILY_REST)):
        assert all(got == rules.label(n, *r) for n, got in df.select("n", rules.label_column(F.col("n"), *r)).collect())


def test_hot_and_many_repeated_keys(spark):
    day = dt.datetime(2000, 1, 1)
    df = _raw(spark, [(1, day, t, True, 41.7, -87.7) for t in "CABAA"] + [(k, day, "X", True, 41.7, -87.7) for k in range(2, 9)])
    found = silver.deduplicate(df)
    assert sorted((r.unique_key, r.primary_type) for r in found.collect()) == [(1, "A")] + [(k, "X") for k in range(2, 9)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    assert silver.nothing_new(df, df) and not silver.nothing_new(df, df.where("unique_key > 1")) and not silver.nothing_new(df, None)
    with pytest.raises(ValueError):
        silver.require_rows(df.limit(0), "the batch")


def test_census_and_weather_files(spark, tmp_path):
    (tmp_path / "census.json").write_text('[["NAME", "tract"], ["a", "000100"], ["b", null]]')
    got = {(r.row, r.name): r.value for r in tables.read_census_json(spark, str(tmp_path / "census.json")).select("row", F.col("name"), "value").collect()}
    assert got == {(0, "NAME"): "a", (0, "tract"): "000100", (1, "NAME"): "b", (1, "tract"): None}
    (tmp_path / "w.json").write_text('{"results": [{"date": "2000-01-02T00:00:00", "datatype": "TMAX", "value": 1.5, "station": "S"}]}\n{"results": []}')
    assert [tuple(r) for r in tables.read_weather_json(spark, str(tmp_path / "w.json")).collect()] == [(dt.date(2000, 1, 2), "TMAX", 1.5, "S")]
    assert tables.loaded_days(spark, "no_such_table").count() == 0


def test_metrics_with_ties(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.3, 0), (0.1, 1), (0.5, None)]
    m = evaluate.ranker_metrics(spark.createDataFrame(rows, "score double, y int"), "score", "y", 0.5).first()
    pairs = [(p, n) for p, y in rows if y == 1 for n, z in rows if z == 0]
    assert m.auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs))
    assert (m.precision, m.recall) == (pytest.approx(2 / 3), pytest.approx(2 / 3)) and m.ap == pytest.approx((1 * 1 + 2 / 3 * 1 + 3 / 6 * 1) / 3)


def test_tiers_break_ties_by_cell(spark):
    df = spark.createDataFrame([(f"c{i:02d}", dt.date(2000, 1, 1), 0.5) for i in range(20)], "cell string, date date, score double")
    got = {r.cell: r.risk_level for r in rank.tiers(df).collect()}
    assert got["c00"] == "CRITICAL" and got["c01"] == got["c02"] == "HIGH" and got["c05"] == "MEDIUM" and got["c19"] == "LOW"


def test_holidays(spark):
    days = spark.createDataFrame([(dt.date(2000, 7, d),) for d in (3, 4, 5, 20)] + [(dt.date(2001, 12, 31),)], "date date")
    hol = spark.createDataFrame([(dt.date(2000, 7, 4),)], "holiday date")
    got = {r.date.isoformat(): (r.is_holiday, r.days_from_holiday, r.days_to_holiday) for r in panel.holiday_features(days, hol).collect()}
    assert got["2000-07-04"] == (1, 0, 30) and got["2000-07-03"] == (0, 30, 1) and got["2000-07-05"] == (0, 1, 30) and got["2001-12-31"] == (0, 30, 30)


def test_repeated_writes_change_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2000, 1, 1)), (2, dt.date(2000, 1, 2))], "unique_key long, day date")
    path = str(tmp_path / "t")
    tables.write_days(df, path)
    tables.write_days(df.where("unique_key = 1"), path)
    assert spark.read.parquet(path).count() == 2
    window = IncrementalWindow(dt.date(2000, 1, 6))
    assert tables.read_days(spark, path, window).count() == 1


def test_geojson_is_one_feature_a_row(spark):
    df = spark.createDataFrame([("a", 1.5, 2.5, dt.date(2000, 1, 2)), ("b", None, 2.5, None)], "name string, latitude double, longitude double, day date")
    assert [r.value for r in rank.geojson(df).collect()] == ['{"type":"Feature","geometry":{"type":"Point","coordinates":[2.5,1.5]},"properties":{"name":"a","day":"2000-01-02"}}']


def _supervised(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(100)]
    rows = [(f"c{k}", day, *[float((i * (j + 3) + k * 7 + j) % (11 + j)) for j in range(15)], 1.0, 5, int(i % 5 == 0), 2 * int(i % 5 == 0), int(i % 5 == 0), int(i % 7 == 0), "train" if i < 75 else "calib" if i < 85 else "val" if i < 92 else "test") for k in range(4) for i, day in enumerate(days)]
    names = [*[f"lag_{k}" for k in range(1, 6)], *[f"nbr_r2_{k}" for k in range(5)], *[f"nbr_r1_mean_{k}" for k in range(5)]]
    ddl = ", ".join(["cell string", "date date", *[f"{n} double" for n in names], "wind_speed double, h3_train_sum int, next_hotspot int, next_total int, next_violent int, next_property int, split string"])
    extra = {"local_sudden_activation_3d": F.lit(1), "h3_train_percentile": F.lit(0.9), "nbr_r1_spike_vs_roll7": F.col("lag_1")}
    return spark.createDataFrame(rows, ddl).withColumns(extra), names


def test_models_of_buckets_types_and_scenarios(spark, tmp_path):
    df, names = _supervised(spark)
    kept = learn.select(df)
    assert set(kept) == {*names, "nbr_r1_spike_vs_roll7"}  # not the constant, guarded or future ones
    with pytest.raises(ValueError):
        learn.select(df.drop(*[f"nbr_r2_{k}" for k in range(5)]))
    out, models = learn.group_blend(df, kept, "next_hotspot", trees=2)
    out, types = learn.type_models(out, kept, trees=2)
    assert out.count() == df.count() and {"temporal", "spatial", "context", "score", "violent_probability", "property_probability"} <= set(out.columns)
    learn.save(models | types, str(tmp_path / "m"), learn.profile(df))
    back = learn.load(str(tmp_path / "m"), [*models, *types])
    imp = learn.importances(spark, back, kept, top=3).toPandas()
    assert len(imp) == len(kept) * 3 and imp[imp.in_top].groupby("bucket").size().max() == 3 and (imp.splits[imp.gain > 0] > 0).all()
    scored = learn.ablation(df, kept, "next_hotspot", trees=1)
    got = {r.scenario: r.auc for r in learn.scenario_metrics(scored, "next_hotspot", lambda x: evaluate.ranker_metrics(x, "score", "next_hotspot", 0.3)).collect()}
    assert set(got) == set(learn.SCENARIOS) and got["temporal_only"] > 0.6
    assert {r.error for r in evaluate.error_rows(scored, ["spatial_only"], "next_hotspot", 0.3).collect()} <= {"FN", "FP"}


def test_sample_weights_are_bounded(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 2.0), (1, 0, 0.9, 0.0), (0, 1, 0.1, 9.0), (1, 1, 0.9, None)], "y int, local_sudden_activation_3d int, h3_train_percentile double, nbr_r1_spike_vs_roll7 double")
    assert [r[0] for r in df.select(evaluate.sample_weight("y")).collect()] == [1.75, 1.0, 1.0, 1.25]


def test_metrics_over_ranges(spark):
    import random

    rnd = random.Random(4)
    rows = [(round(rnd.random(), 3) if i % 2 else rnd.random(), int(rnd.random() < 0.3)) for i in range(400)] + [(0.0, 1), (1.0, 0)]
    m = evaluate.ranker_metrics(spark.createDataFrame(rows, "score double, y int"), "score", "y", 0.5).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert m.auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))
    assert m.ap == pytest.approx(sum(sum(y for t, y in rows if t >= s) / sum(t >= s for t, _ in rows) for s in pos) / len(pos))


def test_layers_are_made_once_and_again_if_gone(spark):
    import shutil

    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    for _ in range(2):
        assert layers.layer(spark, "here", "three", make).count() == 3 and len(made) == 1
    shutil.rmtree(layers._written[spark.sparkContext.applicationId, "here", "three"].removeprefix("file:"))
    assert layers.layer(spark, "here", "three", make).count() == 3 and len(made) == 2


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
