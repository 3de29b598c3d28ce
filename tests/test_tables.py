"""Switched partitions, bucketed merges, runs of the marts, kept sums and counts."""

import pytest
from pyspark.sql import functions as F

from helpers import exchanges, plan_of, rows
from terrapanel.operators import cleaning, quality, upsert
from terrapanel.operators.tables import YearTable, bucketed_copy, with_period
from terrapanel.plans import marts, population
from terrapanel.plans.baselines import baseline_of_parts, baseline_parts, parts_table
from terrapanel.plans.build import build_marts, read_marts, refresh_marts, retire_runs

CELL = "fips_code string, period_year int, period_month int, v double, status_rank int"


def failing(df, column="v"):
    return df.withColumn(column, F.raise_error(F.lit("broken")).cast("double"))


@pytest.fixture
def raw(spark, tmp_path):
    cells = [(f"{i:05d}", y, m, float(i), 1) for i in range(20) for y in (2000, 2001) for m in range(1, 13)]
    frame = with_period(spark.createDataFrame(cells, CELL))
    name = f"raw_{tmp_path.name.replace('-', '_')}"
    table = YearTable(spark, name, str(tmp_path / "raw"), ("fips_code", "period"), 4).create(frame.schema)
    table.merge(frame)
    yield table
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch_of(spark, *cells):
    return with_period(spark.createDataFrame(list(cells), CELL))


def test_merge_moves_the_batch_and_not_the_table(spark, raw):
    batch = batch_of(spark, ("00001", 2001, 1, 99.0, 0), ("99999", 2001, 2, 5.0, 0), ("00002", 2001, 1, 7.0, 2))
    merged = raw.merged(batch, [2001], "status_rank")
    table_side, batch_side = plan_of(merged).split("Exchange hashpartitioning")
    assert "FileScan parquet" in table_side and "Bucketed: true" in table_side and "FileScan" not in batch_side
    untouched = raw.location(2000)
    assert raw.merge(batch, "status_rank") == [2001] and raw.location(2000) == untouched
    found = {(r.fips_code, r.period): r.v for r in raw.read().collect()}
    assert len(found) == 20 * 24 + 1
    assert (found["00001", 200101], found["99999", 200102], found["00002", 200101]) == (99.0, 5.0, 2.0)
    raw.merge(batch)  # without rank, the batch wins
    assert raw.read().where("v = 7 AND fips_code = '00002'").count() == 1


def test_merge_equals_a_plain_merge(spark, raw):
    batch = batch_of(spark, ("00003", 2000, 5, None, 0), ("00003", 2001, 5, 1.0, 1), ("7", 1999, 1, 3.0, 2))
    want = upsert.replace_unless_better(raw.read(), batch, ["fips_code", "period"])
    want = rows(want.select(*sorted(want.columns)), "fips_code", "period")
    raw.merge(batch, "status_rank")
    assert rows(raw.read().select(*sorted(raw.read().columns)), "fips_code", "period") == want


def test_bad_batches_leave_the_table(spark, raw):
    before = raw.read().count(), raw.location(2001)
    with pytest.raises(upsert.DuplicateKeys):
        raw.merge(batch_of(spark, ("a", 2001, 1, 1.0, 0), ("a", 2001, 1, 2.0, 0)))
    with pytest.raises(upsert.DifferentColumns):
        raw.merge(batch_of(spark, ("a", 2001, 1, 1.0, 0)).drop("v"))
    with pytest.raises(Exception, match="broken"):
        raw.replace_years(failing(raw.read()))
    assert (raw.read().count(), raw.location(2001)) == before
    assert raw.merge(batch_of(spark, ("a", 2001, 1, 1.0, 0)).limit(0)) == []


def test_replaced_versions_are_retired(spark, raw):
    first = raw.location(2001)
    raw.merge(batch_of(spark, ("00001", 2001, 1, 99.0, 0)))
    assert len(raw.retire()) == 1 and raw.location(2001) != first
    assert raw.read().count() == 20 * 24 and raw.retire() == []


def test_a_failed_publish_leaves_the_old_mart(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "k string, period_year int, v double")
    upsert.publish_table(df, "mart_kept", str(tmp_path / "mart"), "period_year", ["k"])
    with pytest.raises(Exception, match="broken"):
        upsert.publish_table(failing(df), "mart_kept", str(tmp_path / "mart"), "period_year", ["k"])
    assert rows(spark.table("mart_kept").select("k", "v"), "k") == [("a", 1.0), ("b", 2.0)]
    upsert.publish_table(df.where("k = 'b'"), "mart_kept", str(tmp_path / "mart"), "period_year", ["k"])
    assert rows(spark.table("mart_kept").select("k", "v")) == [("b", 2.0)]
    spark.sql("DROP TABLE mart_kept")


RAW = "state_fips string, state_abbr string, period_year int, period_month int, tmax_f double, tmin_f double, tavg_f double, prcp_in double"


def panel(spark, years, shift=0.0):
    return spark.createDataFrame(
        [(f, a, y, m, 1.0, 0.0, None if (f, m) == ("02", 3) else float(y % 7 + m) + shift, 1.0)
         for f, a in (("01", "AL"), ("02", "AK")) for y in years for m in (1, 2, 3)], RAW
    )


def test_a_failed_build_leaves_the_last_run(spark, tmp_path):
    root = str(tmp_path / "marts")
    with pytest.raises(FileNotFoundError):
        read_marts(spark, root)
    build_marts(panel(spark, (1999, 2000)), None, root, 1999, 1999)
    before = read_marts(spark, root)["mart_annual"].collect()
    with pytest.raises(Exception, match="broken"):
        build_marts(failing(panel(spark, (1999, 2000)), "prcp_in"), None, root, 1999, 1999)
    assert read_marts(spark, root)["mart_annual"].collect() == before
    build_marts(panel(spark, (2000,)), None, root, 1999, 1999)
    assert read_marts(spark, root)["mart_monthly"].count() == 6
    assert len(retire_runs(spark, root)) >= 1 and retire_runs(spark, root) == []  # the failed run may have left a folder
    assert len([p for p in (tmp_path / "marts").iterdir() if p.is_dir()]) == 1
    assert read_marts(spark, root)["mart_monthly"].count() == 6


def mart_tables(spark, tmp_path):
    tag = tmp_path.name.replace("-", "_")
    layout = marts.mart_monthly(marts.anomaly_by_region(marts.stage_climate(panel(spark, (1999,)))))
    return (
        parts_table(spark, f"p_{tag}", str(tmp_path / "parts")),
        YearTable(spark, f"m_{tag}", str(tmp_path / "m"), ("state_fips",)).create(layout.schema),
        YearTable(spark, f"a_{tag}", str(tmp_path / "a"), ("state_fips",)).create(marts.mart_annual(layout).schema),
    )


def test_refreshed_marts_equal_built_ones_and_read_touched_years_only(spark, tmp_path):
    path = str(tmp_path / "raw")
    upsert.write_partitioned(panel(spark, range(1990, 2000)), path, "period_year", ["state_fips"])
    tables = mart_tables(spark, tmp_path)
    raw = lambda: spark.read.schema(panel(spark, (1999,)).schema).parquet(path)
    assert refresh_marts(raw(), list(range(1990, 2000)), *tables, 1991, 1995) == list(range(1990, 2000))
    upsert.write_partitioned(panel(spark, (1999, 2000), 2.0), path, "period_year", ["state_fips"])
    whole = marts.mart_monthly(marts.anomaly_by_region(marts.stage_climate(raw()), 1991, 1995))
    want = rows(whole.select(*sorted(whole.columns)), "state_fips", "period_date")
    annual = marts.mart_annual(whole)
    want_annual = rows(annual.select(*sorted(annual.columns)), "state_fips", "period_year")
    # years that the load did not touch cannot even be read
    for file in (tmp_path / "raw").glob("period_year=199[0-8]/*.parquet"):
        file.write_bytes(b"not a parquet file")
    assert refresh_marts(raw(), [1999, 2000], *tables, 1991, 1995) == [1999, 2000]
    monthly, yearly = tables[1].read(), tables[2].read()
    assert rows(monthly.select(*sorted(whole.columns)), "state_fips", "period_date") == want
    assert rows(yearly.select(*sorted(annual.columns)), "state_fips", "period_year") == want_annual


def test_a_touched_baseline_year_rewrites_all_years(spark, tmp_path):
    tables = mart_tables(spark, tmp_path)
    refresh_marts(panel(spark, (1999, 2000, 2001)), [1999, 2000, 2001], *tables, 1999, 2000)
    revised = panel(spark, (1999, 2001)).unionByName(panel(spark, (2000,), 5.0))
    assert refresh_marts(revised, [2000], *tables, 1999, 2000) == [1999, 2000, 2001]
    whole = marts.mart_monthly(marts.anomaly_by_region(marts.stage_climate(revised), 1999, 2000))
    order = sorted(whole.columns)
    assert rows(tables[1].read().select(*order), "state_fips", "period_date") == rows(whole.select(*order), "state_fips", "period_date")


def test_baseline_of_parts_equals_the_baseline(spark):
    staged = marts.stage_climate(panel(spark, range(1995, 2003)))
    got = baseline_of_parts(baseline_parts(staged), 1996, 1999)
    assert rows(got, "state_fips", "period_month") == rows(marts.baseline(staged, 1996, 1999), "state_fips", "period_month")


def test_key_counts_of_touched_partitions(spark, tmp_path):
    path, counts, keys = str(tmp_path / "t"), str(tmp_path / "counts"), ["fips_code", "period_year", "period_month"]
    first = batch_of(spark, *[("a", y, m, 1.0, 0) for y in (2000, 2001) for m in (1, 2)]).drop("period")
    upsert.upsert_table(path, first, keys, counts=counts)
    # a copy slips into a year that the next load does not touch: its kept count stays, as nothing of it is read
    spark.read.parquet(path).where("period_year = 2000").drop("period_year").write.mode("append").parquet(f"{path}/period_year=2000")
    upsert.upsert_table(path, batch_of(spark, ("b", 2001, 1, 1.0, 0)).drop("period"), keys, counts=counts)
    kept = spark.read.parquet(counts)
    assert rows(kept.select("period_year", "row_count", "key_count", "repeated"), "period_year") == [(2000, 2, 2, 0), (2001, 3, 3, 0)]
    upsert.keep_key_counts(spark.read.parquet(path), counts, keys, "period_year", [2000])
    report = quality.unique_key_from_counts(spark.read.parquet(counts), "t", keys)
    assert report.collect() == quality.unique_key(spark.read.parquet(path), "t", keys).collect()
    assert report.first().failing_rows == 2


def test_clashes_inside_a_source(spark):
    kinds = "state_fips string, period_year int, population long"
    old = spark.createDataFrame([("01", 2010, 1), ("01", 2010, 5), ("02", 2010, 3), ("02", 2010, 3)], kinds)
    new = spark.createDataFrame([("01", 2010, 9), ("03", 2010, None), ("03", 2010, 4)], kinds)
    stacked, keys = population.stack_sources(old, new), ["state_fips", "period_year"]
    (clash,) = population.source_clashes(stacked, keys).collect()
    assert (clash.state_fips, clash.source_rank, clash.another) == ("03", 1, '{"population":4}')
    with pytest.raises(Exception, match="different rows for 03 2010"):
        population.keep_last(stacked, keys, refuse_clashes=True).collect()
    lookup = spark.createDataFrame([("03", "AZ")], "state_fips string, state_abbr string")
    named = [df.withColumn("source", F.lit("s")) for df in (old, new)]
    with pytest.raises(Exception, match="different rows for 03 2010"):
        population.population_long(*named, lookup).collect()
    clean = population.keep_last(stacked.where("state_fips <> '03'"), keys, refuse_clashes=True)
    assert exchanges(clean) == 1 and rows(clean, "state_fips") == [("01", 2010, 9), ("02", 2010, 3)]


def test_variables_are_merged_where_they_lie(spark):
    long = spark.createDataFrame(
        [(f"{i % 40:02d}", i % 12, v, float(i)) for i in range(480) for v in ("tmax", "prcp")], "k string, m int, variable string, value double"
    ).dropDuplicates(["k", "m", "variable"])
    merged = cleaning.merge_variables(long, ["k", "m"], buckets=4)
    merged.collect()
    assert exchanges(merged) == 0 and "Bucketed: true" in plan_of(merged)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = cleaning.merge_variables(long, ["k", "m"], buckets=4)
        assert exchanges(merged) == 0 and plan_of(merged).count("SortMergeJoin") == 4
        assert rows(merged, "k", "m") == rows(cleaning.pivot_variables(long, ["k", "m"]), "k", "m")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_bucketed_copy_serves_aggregates(spark, tmp_path):
    placed = bucketed_copy(spark.range(100).selectExpr("id % 10 AS k", "id AS v"), ["k"], 4, str(tmp_path / "b"))
    assert exchanges(placed.groupBy("k").agg(F.sum("v"))) == 0
