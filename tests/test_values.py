"""Number grammar, markers, units, keys, dates."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrapanel.functions import values
from terrapanel.refdata import state_rows

GRAMMAR = [
    (" 1.00", 1.0),
    ("\t1.5 ", 1.5),
    ("1e2", 100.0),
    ("-3.25", -3.25),
    ("+.5", 0.5),
    ("7.", 7.0),
    ("abc", None),
    ("", None),
    (None, None),
    ("NaN", None),
    ("nan", None),
    ("inf", None),
    ("-Infinity", None),
    ("1e999", None),
    ("1d", None),
    ("1f", None),
    ("1D", None),
    ("0x1p3", None),
    ("1_0", None),
    ("1 2", None),
]


def test_number_grammar(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GRAMMAR)], "i int, t string")
    found = df.select("i", values.to_number(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in found] == [wanted for _, wanted in GRAMMAR]


def test_row_form_follows_the_same_grammar(spark):
    """readings_of takes a shortcut for plain rows; both ways must give the cell-wise result."""
    texts = [t for t, _ in GRAMMAR] + ["-900", "-899.99", "-999.99"]
    plain = [t for t in texts if t is None or not set(t) & set("dDfFxX")]
    for cells in (texts, plain):
        df = spark.createDataFrame([tuple(cells)], ", ".join(f"c{i} string" for i in range(len(cells))))
        columns = [F.col(c) for c in df.columns]
        cellwise = F.array_compact(F.array(*[values.drop_missing(values.to_number(c)) for c in columns]))
        row = df.select(values.readings_of(columns), cellwise).first()
        assert row[0] == row[1]
        assert -899.99 in row[0] and -900.0 not in row[0]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.floats().map(repr), st.text(alphabet="0123456789+-.eEdfxINa ", max_size=6)), min_size=1, max_size=8))
def test_row_form_equals_cell_form(spark, cells):
    df = spark.createDataFrame([tuple(cells)], ", ".join(f"c{i} string" for i in range(len(cells))))
    columns = [F.col(c) for c in df.columns]
    cellwise = F.array_compact(F.array(*[values.drop_missing(values.to_number(c)) for c in columns]))
    row = df.select(values.readings_of(columns), cellwise).first()
    assert row[0] == row[1]


def test_missing_markers(spark):
    readings = [-899.99, -900.0, -999.99, float("nan"), float("inf"), 0.0, None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(readings)], "i int, r double")
    found = [r[0] for r in df.orderBy("i").select(values.drop_missing(F.col("r"))).collect()]
    assert found == [-899.99, None, None, None, None, 0.0, None]


def test_units(spark):
    row = spark.range(1).select(
        values.celsius_to_fahrenheit(F.lit(0.0)),
        values.celsius_to_fahrenheit(F.lit(100.0)),
        values.mm_to_inches(F.lit(25.4)),
    ).first()
    assert tuple(row) == (32.0, 212.0, 1.0)


@pytest.mark.parametrize(
    "key, width, padded",
    [("1", 2, "01"), ("01", 2, "01"), ("123", 2, "123"), ("123456", 5, "123456"), ("7", 5, "00007"), (None, 2, None)],
)
def test_pad_key_never_truncates(spark, key, width, padded):
    df = spark.createDataFrame([(key,)], "k string")
    assert df.select(values.pad_key(F.col("k"), width)).first()[0] == padded


def test_first_of_month_and_probe(spark):
    row = spark.range(1).select(
        values.first_of_month(F.lit(1991), F.lit(13)),
        values.first_of_month(F.lit(1991), F.lit(2)),
        values.probe_month(F.lit(datetime.date(2026, 1, 31))),
        values.probe_month(F.lit(datetime.date(2026, 3, 1))),
    ).first()
    assert tuple(row) == (None, datetime.date(1991, 2, 1), datetime.date(2025, 11, 1), datetime.date(2026, 1, 1))


def test_split_ids():
    assert values.split_ids(" ga, FL ,,tx") == ["GA", "FL", "TX"]
    assert values.split_ids(["ny "]) == ["NY"]


def test_state_table():
    rows = state_rows()
    assert len(rows) == 48 and len({r[1] for r in rows}) == 48
    assert rows[0] == ("01", "01", "AL") and rows[1] == ("02", "04", "AZ") and rows[-1] == ("48", "56", "WY")
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
