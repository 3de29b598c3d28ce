"""Merging rules, storage, refresh and the file stream."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from helpers import exchanges, plan_of, rows
from terrapanel.operators import upsert
from terrapanel.sources.daily_grid import list_files, unnamed_files
from terrapanel.streaming import refresh

KEYS = ["k", "period_year"]
SCHEMA = "k string, period_year int, v double, label string"


def frame(spark, *records):
    return spark.createDataFrame(list(records), SCHEMA)


def stored(spark, path):
    return rows(spark.read.parquet(path).select("k", "period_year", "v", "label"), "k", "period_year")


def test_replace_rows(spark):
    old = frame(spark, ("a", 1, 1.0, "x"), ("b", 1, 2.0, "x"))
    new = frame(spark, ("b", 1, None, None), ("c", 2, 3.0, "y"))
    merged = upsert.replace_rows(old, new, KEYS)
    assert rows(merged, *KEYS) == [("a", 1, 1.0, "x"), ("b", 1, None, None), ("c", 2, 3.0, "y")]


def test_patch_rows_keeps_other_columns(spark):
    old = frame(spark, ("a", 1, 1.0, "x"), ("b", 1, 2.0, "x"))
    new = frame(spark, ("b", 1, None, "changed"), ("c", 2, 3.0, "y"))
    merged = upsert.patch_rows(old, new, KEYS, ["v"])
    assert rows(merged, *KEYS) == [("a", 1, 1.0, "x"), ("b", 1, None, "x"), ("c", 2, 3.0, "y")]


@pytest.mark.parametrize("old_rank, new_rank, winner", [(1, 0, "new"), (0, 1, "old"), (0, 0, "new"), (1, 1, "new")])
def test_preliminary_never_replaces_final(spark, old_rank, new_rank, winner):
    schema = "k string, v string, status_rank int"
    old = spark.createDataFrame([("a", "old", old_rank)], schema)
    new = spark.createDataFrame([("a", "new", new_rank)], schema)
    merged = upsert.replace_unless_better(old, new, ["k"])
    assert [r.v for r in merged.collect()] == [winner]
    assert merged.columns == old.columns


def test_small_batch_leaves_the_table_unshuffled(spark, tmp_path):
    frame(spark, ("a", 1, 1.0, "x")).write.parquet(str(tmp_path / "t"))
    frame(spark, ("a", 1, 2.0, "y")).write.parquet(str(tmp_path / "b"))
    merged = upsert.replace_rows(spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "b")), KEYS)
    assert exchanges(merged) == 0 and "BroadcastHashJoin" in plan_of(merged)


def test_upsert_table(spark, tmp_path):
    path = str(tmp_path / "table")
    upsert.upsert_table(path, frame(spark, ("a", 1, 1.0, "x"), ("b", 1, 2.0, "x"), ("a", 2, 5.0, "x")), KEYS)
    untouched = sorted(p.name for p in (tmp_path / "table" / "period_year=2").iterdir())
    batch = frame(spark, ("b", 1, None, "y"), ("c", 3, 7.0, "y"))
    upsert.upsert_table(path, batch, KEYS)
    wanted = [("a", 1, 1.0, "x"), ("a", 2, 5.0, "x"), ("b", 1, None, "y"), ("c", 3, 7.0, "y")]
    assert stored(spark, path) == wanted
    assert sorted(p.name for p in (tmp_path / "table" / "period_year=2").iterdir()) == untouched
    upsert.upsert_table(path, batch, KEYS)
    assert stored(spark, path) == wanted
    upsert.upsert_table(path, batch.limit(0), KEYS)
    assert stored(spark, path) == wanted


def test_duplicate_key_in_a_batch_is_refused(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(upsert.DuplicateKeys):
        upsert.upsert_table(path, frame(spark, ("a", 1, 1.0, "x"), ("a", 1, 2.0, "x")), KEYS)
    assert not (tmp_path / "table").exists()


def test_population_upsert_keeps_the_label(spark, tmp_path):
    path = str(tmp_path / "table")
    upsert.upsert_table(path, frame(spark, ("a", 1, 1.0, "AL")), KEYS)
    upsert.upsert_table(path, frame(spark, ("a", 1, 2.0, "??"), ("b", 1, 3.0, "AZ")), KEYS, updates=["v"])
    assert stored(spark, path) == [("a", 1, 2.0, "AL"), ("b", 1, 3.0, "AZ")]


def test_publish(spark, tmp_path):
    df = frame(spark, ("a", 1, 1.0, "x"), ("b", 2, 2.0, "x"))
    assert upsert.publish_view(df, "staging_x").count() == 2
    table = upsert.publish_table(df, "mart_x", str(tmp_path / "mart"), "period_year", ["k"])
    assert rows(table.select("k"), "k") == [("a",), ("b",)]
    assert "PartitionFilters: [isnotnull(period_year" in plan_of(table.where("period_year = 1"))
    spark.sql("DROP TABLE mart_x")


# ---- files -----------------------------------------------------------------


def land(root, name, value):
    (root / name).write_text(f"ste,01,XX: Name,1900,1,x,{value},{value}\n")


def measures(spark, table):
    columns = ["period_year", "period_month", "tmax_f", "tmin_f", "source_file"]
    stored = spark.read.parquet(table)
    assert dict(stored.dtypes)["tmax_f"] == "decimal(6,2)"
    bare = stored.withColumn("source_file", F.regexp_replace("source_file", "[^;]*/", ""))
    return rows(bare.select(*columns), "period_year", "period_month")


def test_refresh_loads_two_years(spark, tmp_path):
    root, table = tmp_path / "landing", str(tmp_path / "table")
    root.mkdir()
    for year in (1998, 1999, 2000):
        land(root, f"tmax-{year}01-ste-scaled.csv", 10)
    refresh.refresh(spark, str(root), table, F.lit("2000-03-31").cast("date"))
    assert [r[0] for r in measures(spark, table)] == [1999, 2000]
    stored_on = spark.read.parquet(table).select("ingested_at").distinct().collect()
    assert [r[0] for r in stored_on] == [datetime.date(2000, 3, 31)]


def test_stream_equals_batch_and_keeps_final_values(spark, tmp_path):
    root, table, batch_table = tmp_path / "landing", str(tmp_path / "table"), str(tmp_path / "batch")
    root.mkdir()

    def arrive():
        refresh.stream_arrivals(spark, str(root), table, str(tmp_path / "cp"), files_per_batch=2).awaitTermination()

    land(root, "tmax-199901-ste-prelim.csv", 0)
    land(root, "tmin-199901-ste-prelim.csv", 5)
    land(root, "tmax-199902-ste-prelim.csv", 20)
    arrive()
    assert [(r[2], r[3]) for r in measures(spark, table)] == [(32.0, 41.0), (68.0, None)]
    land(root, "tmax-199901-ste-scaled.csv", 10)  # revision
    arrive()
    revised = measures(spark, table)
    assert revised[0][2:] == (50.0, 41.0, "tmax-199901-ste-scaled.csv;tmin-199901-ste-prelim.csv")
    land(root, "tmin-199902-ste-scaled.csv", 0)
    arrive()
    arrive()  # nothing new
    refresh.load_files(list_files(spark, str(root)), batch_table)
    assert measures(spark, table) == measures(spark, batch_table)


def test_late_preliminary_file_changes_nothing(spark, tmp_path):
    root, table = tmp_path / "landing", str(tmp_path / "table")
    root.mkdir()
    land(root, "tmax-199901-ste-scaled.csv", 10)
    refresh.stream_arrivals(spark, str(root), table, str(tmp_path / "cp")).awaitTermination()
    before = measures(spark, table)
    land(root, "tmax-199901-ste-prelim.csv", 99)
    refresh.stream_arrivals(spark, str(root), table, str(tmp_path / "cp")).awaitTermination()
    assert measures(spark, table) == before
    # the final file may move on: the stored rank still guards its month
    (root / "tmax-199901-ste-scaled.csv").rename(tmp_path / "archived.csv")
    land(root, "tmax-199901-ste-prelim.csv", 98)
    refresh.load_files(list_files(spark, str(root)), table)
    assert measures(spark, table) == before


def test_load_report(spark, tmp_path):
    root, table = tmp_path / "landing", str(tmp_path / "table")
    root.mkdir()
    land(root, "tmax-199901-ste-scaled.csv", 10.004)
    (root / "tmin-199903-ste-scaled.csv").write_text("ste,77,XX: Name,1900,1,x,1\nste,77,XX: Name,1900,1,x,1\n")
    land(root, "tmin-199803-ste-scaled.csv", 1)
    land(root, "notes.csv", 1)
    report = refresh.backfill(spark, str(root), table, 1999, 1999, F.lit("1999-03-31").cast("date"))
    found = {(r.item, r.detail): r.n for r in report.collect()}
    assert found == {
        ("rows of an unknown region code", "77"): 2,
        ("rows written", table): 1,
        ("month without files", "1999-02"): 1,
        **{("variable without a file", f"1999-01 {v}"): 1 for v in ("tmin", "tavg", "prcp")},
        **{("variable without a file", f"1999-03 {v}"): 1 for v in ("tmax", "tavg", "prcp")},
    }
    (stored,) = spark.read.parquet(table).collect()
    assert (stored.tmax_f, stored.tmin_f) == (decimal.Decimal("50.01"), None)
    assert stored.source_file.endswith("/landing/tmax-199901-ste-scaled.csv") and "://" not in stored.source_file[:4]
    assert unnamed_files(spark, str(root)).count() == 1


def test_a_batch_with_other_columns_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert_table(path, frame(spark, ("a", 2000, 1.0, "x")), KEYS)
    with pytest.raises(upsert.DifferentColumns):
        upsert.upsert_table(path, frame(spark, ("b", 2000, 1.0, "x")).drop("label"), KEYS)
    assert [r.label for r in spark.read.parquet(path).collect()] == ["x"]


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert_table(path, frame(spark, ("a", 2000, 1.0, "x"), ("a", 2001, 1.0, "x")), KEYS)
    untouched = sorted(p.name for p in (tmp_path / "t" / "period_year=2000").glob("*.parquet"))
    assert upsert.upsert_table(path, frame(spark, ("a", 2001, 2.0, "y"), ("b", 2001, 2.0, "y")), KEYS) == 2
    assert sorted(p.name for p in (tmp_path / "t" / "period_year=2000").glob("*.parquet")) == untouched
