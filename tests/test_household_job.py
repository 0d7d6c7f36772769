"""The household job over raw files that arrive, change and go missing halfway."""

from types import SimpleNamespace

import pytest

from hearthline import fixed_values as fv
from hearthline.catalog import sources
from hearthline.plans import household_job as hj
from hearthline.plans.household import household_stress_dataset
from hearthline.plans.household_job import CONSUMPTION, DATASET, INCOME, PEOPLE, HouseholdJob

HOUSEHOLD = {"STATE": "Goa", "HR": "R", "DISTRICT": "D", "REGION_TYPE": "URBAN", "STRATUM": "S"}
MONTHS = {"20200131": "Jan 2020", "20200229": "Feb 2020", "20200331": "Mar 2020"}


def row(names, **values):
    return [values.get(n, HOUSEHOLD.get(n, "")) for n in names]


class Raw:
    def __init__(self, base):
        self.base = base
        for unit in (INCOME, CONSUMPTION, PEOPLE):
            (base / unit).mkdir(parents=True)

    def folders(self):
        return {unit: str(self.base / unit) for unit in (INCOME, CONSUMPTION, PEOPLE)}

    def write(self, unit, names, stamp, rows, tag=""):
        lines = [",".join(names)] + [",".join(row(names, **r)) for r in rows]
        (self.base / unit / f"{unit}{tag}_{stamp}.csv").write_text("\n".join(lines) + "\n")

    def month(self, stamp, income=100, households=("h1", "h2"), status="Accepted"):
        slot = {"MONTH_SLOT": MONTHS[stamp], "MONTH": MONTHS[stamp], "RESPONSE_STATUS": status}
        self.write(INCOME, list(fv.INC_COLUMNS), stamp, [{**slot, "HH_ID": h, "TOT_INC": str(income)} for h in households])
        total = [c for c, n in fv.CON_COLUMNS.items() if n == "total_expenditure_adjusted"][0]
        self.write(CONSUMPTION, list(fv.CON_COLUMNS), stamp, [{**slot, "HH_ID": h, total: "90"} for h in households])

    def people(self, stamp, age, tag="", slot=None):
        self.write(PEOPLE, list(fv.POI_COLUMNS), stamp, [
            {"HH_ID": "h1", "MEM_ID": "1", "MONTH_SLOT": MONTHS[slot or stamp], "AGE_YRS": str(age), "RESPONSE_STATUS": "Accepted"}], tag)


def rows_of(df):
    return sorted((r.file_stamp, r.household_id, r.financial_stress, r.age_years_hh_mean) for r in df.collect())


@pytest.fixture
def raw(tmp_path):
    made = Raw(tmp_path / "raw")
    made.month("20200131")
    made.month("20200229")
    made.people("20200131", 40)
    made.people("20200229", 20)
    return made


def in_one_plan(spark, raw):
    surveys = [hj.ingest_raw_csv(spark, folder, hj.RAW_COLUMNS[unit], hj.stamp_of_path) for unit, folder in raw.folders().items()]
    return household_stress_dataset(*surveys)


def test_later_runs_work_on_new_and_changed_months_only(spark, raw, tmp_path):
    def run():  # a new object each time, as after a restart
        job = HouseholdJob(spark, raw.folders(), str(tmp_path / "out"))
        done = job.run()
        assert rows_of(job.dataset()) == rows_of(in_one_plan(spark, raw))
        return done

    both = ["20200131", "20200229"]
    assert run() == {INCOME: both, CONSUMPTION: both, PEOPLE: both, DATASET: both}
    assert run() == {INCOME: [], CONSUMPTION: [], PEOPLE: [], DATASET: []}
    raw.month("20200331", households=("h1",))
    assert run() == {INCOME: ["20200331"], CONSUMPTION: ["20200331"], PEOPLE: [], DATASET: ["20200331"]}
    raw.month("20200229", income=50)  # a month arrives once more, with other amounts
    assert run()[DATASET] == ["20200229"]
    raw.people("20200331", 60, slot="20200131")  # a later file with members of January: mean of means
    assert run() == {INCOME: [], CONSUMPTION: [], PEOPLE: ["20200331"], DATASET: ["20200131"]}
    raw.month("20200131", status="Refused")  # nothing of the month is accepted any more
    assert run()[INCOME] == ["20200131"]


def test_a_job_that_died_before_its_manifest_row_does_the_month_again(spark, raw, tmp_path, monkeypatch):
    job = HouseholdJob(spark, raw.folders(), str(tmp_path / "out"))

    class Died(Exception):
        pass

    def die(*args):
        raise Died

    whole = hj.write_month_partitions
    monkeypatch.setattr(hj, "write_month_partitions", lambda df, path: (whole(df, path), die()))
    with pytest.raises(Died):
        job.run()
    monkeypatch.setattr(hj, "write_month_partitions", whole)
    assert job.months(INCOME) is None and job.manifest().count() == 0
    assert job.run()[DATASET] == ["20200131", "20200229"]
    assert rows_of(job.dataset()) == rows_of(in_one_plan(spark, raw))


def test_without_people_or_pairs(spark, tmp_path):
    raw = Raw(tmp_path / "raw")
    raw.month("20200131")
    (raw.base / CONSUMPTION / f"{CONSUMPTION}_20200131.csv").unlink()
    job = HouseholdJob(spark, raw.folders(), str(tmp_path / "out"))
    assert job.run() == {INCOME: ["20200131"], CONSUMPTION: [], PEOPLE: [], DATASET: []}
    with pytest.raises(ValueError):
        job.dataset()
    raw.month("20200131")
    assert job.run()[DATASET] == ["20200131"]
    assert rows_of(job.dataset()) == [("20200131", "h1", 0, None), ("20200131", "h2", 0, None)]


def test_stamps_come_from_the_folder_or_the_name(spark):
    paths = ["/d20190101/file_stamp=20200131/part-0.csv", "/d20190101/inc_20200229_MS.csv", "/d20190101/x.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(hj.stamp_of_path(df.p)).collect()] == ["20200131", "20200229", None]


def test_the_query_compresses_its_raw_months_and_splits_large_ones(spark, raw, tmp_path, monkeypatch):
    surveys = {unit: hj.ingest_raw_csv(spark, folder, hj.RAW_COLUMNS[unit], hj.stamp_of_path) for unit, folder in raw.folders().items()}
    tables = SimpleNamespace(spark=spark, inc_raw=surveys[INCOME], con_raw=surveys[CONSUMPTION], poi_raw=surveys[PEOPLE])
    monkeypatch.setattr(sources, "shared_dir", lambda *_: str(tmp_path / "query"))
    monkeypatch.setattr(sources, "DEMO_CUTOFF", "2020-02-15")
    monkeypatch.setattr(sources, "RAW_FILE_ROWS", 1)
    assert rows_of(sources.household_job(tables)) == rows_of(in_one_plan(spark, raw))
    files = [f.name for f in (tmp_path / "query" / "raw" / INCOME).rglob("part-*")]
    assert len(files) == 4 and all(name.endswith(".csv.gz") for name in files)
