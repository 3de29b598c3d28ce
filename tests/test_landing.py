"""Landed folders, remembered files, and loads that read only what they must."""

import pytest
from pyspark.sql import functions as F

from helpers import exchanges, plan_of, rows
from terrapanel.registry import storage
from terrapanel.schemas import COUNTY, DAY_COLUMNS, STATE
from terrapanel.sources import daily_grid, file_memory, landed_grid, sample_tables
from terrapanel.streaming import refresh

SF = "/root/testdata/sf0.001"


def put(root, variable, period, status, value, code="01", scale="ste"):
    """One file in its folder, as a download would leave it."""
    year, month = int(period[:4]), int(period[4:])
    folder = root / f"scale={scale}" / f"period_year={year}" / f"period_month={month}" / f"variable={variable}" / f"status={status}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{variable}-{period}-{scale}-{status}.csv").write_text(f"{scale},{code},XX: Name,1900,1,x,{value},{value}\n")


def stored(spark, table):
    found = spark.read.parquet(table).withColumn("source_file", F.regexp_replace("source_file", "[^;]*/variable=([a-z]+)/status=", "$1 "))
    return rows(found.select("period_year", "period_month", "tmax_f", "tmin_f", "source_file"), "period_year", "period_month")


def test_names_come_from_folders(spark, tmp_path):
    put(tmp_path, "tmax", "199901", "scaled", 1)
    paths = [(f"file:{next(tmp_path.rglob('*.csv'))}",), ("/elsewhere/notes.csv",)]
    tagged = landed_grid.with_folder_tags(spark.createDataFrame(paths, "path string"))
    named = tagged.where("file_name <> ''").collect()
    assert [(r.file_name, r.scale, r.period_year, r.period_month, r.status_rank) for r in named] == [
        ("tmax-199901-ste-scaled.csv", "ste", 1999, 1, 0)
    ]


def test_a_load_lists_and_reads_its_years_only(spark, tmp_path, monkeypatch):
    for year in (1998, 1999, 2000):
        for status in ("scaled", "prelim"):
            put(tmp_path, "tmax", f"{year}01", status, 10)
    landing = landed_grid.open_landing(spark, str(tmp_path))
    as_of = F.lit("2000-03-31").cast("date")
    wanted = daily_grid.refresh_scope(as_of)
    batch = refresh.raw_batch(landing.scan("ste", wanted), landing.chosen("ste", wanted), STATE, as_of)
    text = plan_of(batch)
    filters = text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "period_year" in filters and "status" in filters and "FileScan csv" in text
    # the other years' and the superseded files may be gone: nothing looks at them
    for path in tmp_path.rglob("*.csv"):
        if "1998" in path.name or "prelim" in path.name:
            path.unlink()
    monkeypatch.setattr(refresh, "list_files", pytest.fail)
    monkeypatch.setattr(refresh, "read_files", pytest.fail)
    table = f"{tmp_path}-table"
    report = refresh.refresh(spark, landing, table, as_of)
    assert [(r[0], r[4]) for r in stored(spark, table)] == [(1999, "tmax scaled"), (2000, "tmax scaled")]
    assert report.where("item = 'rows written'").first().n == 2
    landing.close()


def test_flat_and_landed_loads_agree(spark, tmp_path):
    flat, folders = tmp_path / "flat", tmp_path / "folders"
    flat.mkdir()
    for variable, period, status, value in (
        ("tmax", "199901", "scaled", 10), ("tmax", "199901", "prelim", 99), ("tmin", "199901", "prelim", 5), ("tmin", "199902", "scaled", 0),
    ):
        put(folders, variable, period, status, value)
        (flat / f"{variable}-{period}-ste-{status}.csv").write_text(f"ste,01,XX: Name,1900,1,x,{value},{value}\n")
    as_of = F.lit("1999-12-31").cast("date")
    refresh.backfill(spark, str(flat), f"{tmp_path}/a", 1999, 1999, as_of)
    refresh.backfill(spark, landed_grid.open_landing(spark, str(folders)), f"{tmp_path}/b", 1999, 1999, as_of)
    measures = ["state_fips", "period_month", "tmax_f", "tmin_f", "status_rank"]
    a, b = (rows(spark.read.parquet(f"{tmp_path}/{t}").select(*measures), "period_month") for t in "ab")
    assert a == b and len(a) == 2


def test_months_beside_the_calendar_are_no_folders(spark, tmp_path):
    assert landed_grid.open_landing(spark, str(tmp_path)).partitions().count() == 0


class Listings:
    """Counts what looks through the landing folder."""

    def __init__(self, monkeypatch):
        self.count = 0
        for place, name in ((refresh, "list_files"), (landed_grid.Landing, "discover")):
            monkeypatch.setattr(place, name, self.called(getattr(place, name)))

    def called(self, function):
        def counted(*args, **kwargs):
            self.count += 1
            return function(*args, **kwargs)

        return counted


@pytest.mark.parametrize("flat", [False, True])
def test_stream_remembers_files_and_lists_nothing(spark, tmp_path, monkeypatch, flat):
    root = tmp_path / "landing"
    root.mkdir()
    listings = Listings(monkeypatch)

    def arrive(variable, period, status, value):
        if flat:
            (root / f"{variable}-{period}-ste-{status}.csv").write_text(f"ste,01,XX: Name,1900,1,x,{value},{value}\n")
        else:
            put(root, variable, period, status, value)

    def run(table="t", checkpoint="cp", per_batch=2):
        landing = str(root) if flat else landed_grid.open_landing(spark, str(root), discover=False)
        refresh.stream_arrivals(
            spark, landing, f"{tmp_path}/{table}", f"{tmp_path}/{checkpoint}", files_per_batch=per_batch
        ).awaitTermination()

    arrive("tmax", "199901", "prelim", 0)
    arrive("tmin", "199901", "prelim", 5)
    arrive("tmax", "199902", "prelim", 20)
    run()
    if not flat:  # a restart that knows nothing of the session before
        landed_grid.open_landing(spark, str(root), discover=False).close()
    arrive("tmax", "199901", "scaled", 10)  # a revision, whose month also needs tmin from the list
    run()
    run()  # nothing new
    found = stored(spark, f"{tmp_path}/t")
    assert [(r[2], r[3]) for r in found] == [(50, 41), (68, None)]
    assert listings.count == 0
    remembered = file_memory.remembered(spark, f"{tmp_path}/cp-files")
    assert remembered.count() == 4
    # a stream that begins anew, all files in one batch, gives the same table
    if not flat:
        landed_grid.open_landing(spark, str(root), discover=False).close()
    run("u", "cp2", 100)
    assert stored(spark, f"{tmp_path}/u") == found


def test_memory_of_a_repeated_batch(spark, tmp_path):
    memory = str(tmp_path / "files")
    names = ["tmax-199901-ste-scaled.csv", "tmax-200002-ste-prelim.csv"]
    files = daily_grid.with_file_tags(spark.createDataFrame([(f"/x/{n}",) for n in names], "path string"))
    for _ in range(2):
        file_memory.remember(files, memory, file_memory.batch_name("s", 0))
    file_memory.remember(files.where("period_year = 1999"), memory, file_memory.batch_name("s", 1))
    assert file_memory.remembered(spark, memory).count() == 2
    assert file_memory.months_of(spark, memory, file_memory.batch_name("s", 1)) == [199901]
    pruned = file_memory.remembered(spark, memory).where(file_memory.in_months([200002]))
    assert "period_year" in plan_of(pruned).split("PartitionFilters: [")[1].split("]")[0]
    assert [r.file_name for r in pruned.collect()] == [names[1]]
    file_memory.compact(spark, memory, before=2000)
    assert file_memory.remembered(spark, memory).count() == 2
    assert [p.name for p in (tmp_path / "files" / "period_year=1999").iterdir() if p.is_dir()] == ["batch=compacted"]


def test_source_report(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'ste,01,"XX, Name",1900,1,tmax,1, ,3\nste,77,XX: Name,1900,1,tmax,1\nste,77,,1900,1,tmax,1,2,3\n'
    )
    lines = spark.read.text(str(tmp_path / "a.csv"))
    known = spark.createDataFrame([("01",)], "region_code string")
    for sketch in (False, True):
        found = {(r.section, r.name): r.value for r in daily_grid.source_report(lines, known, 2, sketch).collect()}
        assert found[("rows", "")] == "3" and found[("codes", "")] == "2"
        assert (found[("columns", "least")], found[("columns", "most")]) == ("7", "9")
        blanks = {n: found[("blank cells", n)] for n in ("region_name", "d01", "d02", "d03", *DAY_COLUMNS[3:4])}
        assert blanks == {"region_name": "1", "d01": "0", "d02": "2", "d03": "1", "d04": "3"}
        assert found[("unmatched code", "77")] == "2" and ("unmatched code", "01") not in found
        assert found[("first row", "1")].startswith('ste,01,"XX') and ("first row", "3") not in found
    empty = {(r.section, r.name): r.value for r in daily_grid.source_report(lines.limit(0), known).collect()}
    assert empty[("rows", "")] == "0" and empty[("blank cells", "d01")] == "0"
    assert COUNTY.scale == "cty"


def _readings(spark, path):
    """A hot month, one of few readings, nulls and repeated days."""
    hot = spark.range(3000).selectExpr("id % 700 AS l_suppkey", "timestamp'1995-03-01' + make_dt_interval(int(id % 9)) AS l_shipdate", "id")
    few = spark.range(20).selectExpr("nullif(id, 3) AS l_suppkey", "if(id = 5, NULL, timestamp'1996-07-09') AS l_shipdate", "id")
    lines = hot.unionByName(few).selectExpr(
        "*", "int(id % 5 + 1) AS l_linenumber", "double(id % 50) AS l_quantity", "double(id % 4) AS l_tax", "if(id % 3 = 0, 'F', 'O') AS l_linestatus"
    )
    lines.drop("id").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_county_readings_move_once_and_narrow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sample_tables, "FILE_READINGS", 100)
    monkeypatch.setattr(sample_tables, "TASK_READINGS", 200)
    sf = _readings(spark, tmp_path)
    placed = sample_tables.grid_rows(spark, sf, COUNTY, placed=True)
    plain = sample_tables.grid_rows(spark, sf, COUNTY)
    assert sorted(map(repr, placed.collect())) == sorted(map(repr, plain.collect()))
    assert exchanges(placed) == 1 and placed.rdd.getNumPartitions() == 16  # 3,020 readings, 200 each
    root = sample_tables.landed_folders(spark, sf, COUNTY)
    landed = spark.read.text(f"{root}/scale=cty/period_year=1995/period_month=3/variable=tmax")
    assert landed.count() == sum((r.file or "").startswith("tmax-199503") for r in plain.collect())
    assert 1 < len(landed.inputFiles()) < 32  # a hot month is divided, but not by region


def test_buckets_of_the_county_table_grow(spark, tmp_path, monkeypatch):
    seen = []

    class Counted(storage.YearTable):
        def create(self, schema):
            seen.append(self.buckets)
            return super().create(schema)

    monkeypatch.setattr(storage, "YearTable", Counted)
    want = sorted(map(repr, storage.prelim_to_scaled_revision(spark, SF).collect()))
    monkeypatch.setattr(storage, "BUCKET_READINGS", 300)
    assert sorted(map(repr, storage.prelim_to_scaled_revision(spark, SF).collect())) == want
    assert seen == [16, -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300)]
