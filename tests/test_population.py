import json

import pytest
from pyspark.sql import functions as F

from helpers import exchanges, rows
from terrapanel.plans import population as plan
from terrapanel.sources import population as sources
from terrapanel.sources.regions import state_lookup


def test_json_matrix(spark, tmp_path):
    header = ["NAME", "POP", "DATE_CODE", "state"]
    body = [["Alabama", "10", str(code), "1"] for code in (1, 2, 3, 12, 13)]
    (tmp_path / "a.json").write_text(json.dumps([header, *body], indent=1))
    # another document, columns in another order
    (tmp_path / "b.json").write_text(json.dumps([header[::-1], ["56", "4", "7", "Wyoming"]]))
    matrix = sources.read_json_matrix(spark, str(tmp_path), ["POP", "DATE_CODE", "state"])
    assert matrix.count() == 6
    old = sources.old_population(matrix)
    assert rows(old, "state_fips", "period_year") == [
        ("01", 2010, 10, "api_2019_vintage"),
        ("01", 2019, 10, "api_2019_vintage"),
        ("56", 2011, 7, "api_2019_vintage"),
    ]


def test_wide_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text(
        "SUMLEV,REGION,STATE,NAME,POPESTIMATE2020,POPESTIMATE2021,OTHER2021\n"
        "010,0,00,Total,900,901,1\n040,3,01,Alabama,5,6,1\n40,3,4,Arizona,7,8,1\n"
    )
    wide = sources.read_wide_csv(spark, str(tmp_path / "e.csv"))
    assert rows(sources.new_population(wide, "e"), "state_fips", "period_year") == [
        ("01", 2020, 5, "e"),
        ("01", 2021, 6, "e"),
        ("04", 2020, 7, "e"),
        ("04", 2021, 8, "e"),
    ]


def test_newest_vintage(spark):
    listing = spark.createDataFrame([("x", "2020"), ("y", "2021"), ("z", "2021"), ("w", "1900")], "path string, vintage string")
    assert rows(sources.newest_vintage(listing, ["2022", "2021", "2020"]).select("path"), "path") == [("y",), ("z",)]
    with pytest.raises(Exception, match="no population file"):
        sources.newest_vintage(listing, ["2030"]).collect()


def test_read_newest(spark, tmp_path):
    for vintage, value in (("2020-2024", 4), ("2020-2025", 5)):
        (tmp_path / vintage).mkdir()
        (tmp_path / vintage / "e.csv").write_text(f"SUMLEV,STATE,POPESTIMATE2020\n40,1,{value}\n")
    found = sources.read_newest(spark, str(tmp_path), ["2020-2026", "2020-2025", "2020-2024"])
    assert rows(found) == [("01", 2020, 5, "2020-2025")]


def people(spark, records):
    return spark.createDataFrame(records, "state_fips string, period_year int, population long, source string")


def test_newer_source_wins_and_scope_holds(spark):
    old = people(spark, [("01", 2019, 1, "old"), ("01", 2020, 2, "old"), ("02", 2020, 3, "old")])
    new = people(spark, [("01", 2020, 9, "new"), ("72", 2020, 5, "new")])
    long = plan.population_long(old, new, state_lookup(spark))
    assert rows(long, "period_year") == [("01", "AL", 2019, 1, "old"), ("01", "AL", 2020, 9, "new")]


def test_copies_of_one_key_collapse_before_the_shuffle(spark):
    hot = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "01").otherwise(F.lpad((F.col("id") % 48).cast("string"), 2, "0")).alias("state_fips"),
        F.lit(2020).alias("period_year"),
        F.col("id").alias("population"),
        F.lit("old").alias("source"),
    )
    best = plan.keep_last(plan.stack_sources(hot, hot.where("id < 10")), ["state_fips", "period_year"])
    assert exchanges(best) == 1
    by_fips = {r.state_fips: r.population for r in best.collect()}
    assert by_fips["01"] == 9 and by_fips["02"] == 2  # rank first, then the larger value
