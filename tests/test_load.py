"""Loading with a quarantine: one pass, nothing lost."""

from hotgrid.operators import silver

RAW = "unique_key string, case_number string, date string, primary_type string, arrest string, latitude string, longitude string, _corrupt string"


def test_rows_are_typed_or_kept_with_their_reasons(spark, tmp_path):
    good = ("1", "c", "2020-01-02 03:04:05+00:00", "T", "true", "41.8", "-87.7", None)
    rows = [good, ("x", *good[1:]), (*good[:2], "never", *good[3:]), (*good[:2], None, *good[3:]), (*good[:4], "maybe", "north", *good[6:]), (*good[:7], "1,2,3"), good]
    df = spark.createDataFrame(rows, RAW)
    typed, bad, seen = silver.load(df, str(tmp_path / "t"), ("unique_key", "date", "latitude"))
    assert dict(typed.dtypes)["unique_key"] == "bigint" and dict(typed.dtypes)["latitude"] == "double" and dict(typed.dtypes)["date"] == "timestamp"
    assert typed.count() == 2 and typed.where("date is null or latitude is null").count() == 0
    assert sorted(tuple(r.reasons) for r in bad.collect()) == sorted([("unique_key is no long",), ("date is no timestamp",), ("date is missing",), ("arrest is no boolean", "latitude is no double"), ("row does not fit the schema",)])
    assert seen == {"rows": 7, "bad": 5, "no_unique_key": 0, "no_date": 1, "no_latitude": 0}
    none = silver.load(df.limit(0), str(tmp_path / "e"))
    assert none[0].count() == none[1].count() == 0 and none[2]["rows"] == 0
