"""Queries for sources and sinks: each writes survey tables and reads them back."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from hearthline.catalog.oracle_views import over
from hearthline.catalog.registry import query, text
from hearthline.catalog.survey_views import DEMO_CUTOFF
from hearthline.plans.household import household_stress_dataset
from hearthline.plans.household_job import CONSUMPTION, INCOME, PEOPLE, HouseholdJob
from hearthline.session import shared_dir
from hearthline.sources import raw as r
from hearthline.sources import sinks as s

RAW = ["HH_ID", "STATE", "MONTH_SLOT", "MONTH", "TOT_INC", "INC_OF_ALL_MEMS_FRM_WAGES", "RESPONSE_STATUS"]


@query("ingest_raw_csv", over(f"""
    SELECT {", ".join(f"nullif({c}, '') AS {c}" for c in RAW)}, CASE WHEN TOT_INC IS NULL THEN 'new' END AS PSU_MISSING,
           NULL::VARCHAR AS file_stamp FROM inc_raw""", "inc_raw"))
def ingest_raw_csv(t):
    """Two versions of the header: another order, and a column that only one has."""
    folder = shared_dir(t.spark, "raw-csv")
    old, new = t.inc_raw.filter("TOT_INC is not null"), t.inc_raw.filter("TOT_INC is null")
    old.write.option("header", True).option("compression", "gzip").csv(folder)
    new.select(*reversed(new.columns)).withColumn("PSU_MISSING", F.lit("new")).write.option("header", True).mode(
        "append").csv(folder)
    return r.ingest_raw_csv(t.spark, folder, [*RAW, "PSU_MISSING"])


@query("ingest_raw_zip", over(f"""
    SELECT {", ".join(f"coalesce({c}, '') AS {c}" for c in RAW)} FROM inc_raw""", "inc_raw"))
def ingest_raw_zip(t):
    """Archives made from the raw table, one per month, two CSV members in each."""
    def archives(batches):
        for batch in batches:
            for month, rows in batch.groupby("MONTH_SLOT", dropna=False):
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
                    for part, half in enumerate((rows.iloc[::2], rows.iloc[1::2])):
                        archive.writestr(f"part_{part}.csv", half.to_csv(index=False))
                yield pd.DataFrame({"content": [packed.getvalue()]})

    made = t.inc_raw.select(*RAW).mapInPandas(archives, "content binary")
    return r.parse_archives(made.withColumn("path", F.lit("income.zip")), RAW).drop("file_stamp")


@query("file_stamp", """
    SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '2000-01-01' THEN strftime(o_orderdate, '%Y%m%d') END AS file_stamp
    FROM orders""")
def file_stamp(t):
    name = F.concat(F.lit("income_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_MS.zip"))
    return t.table("orders").select("o_orderkey", r.file_stamp(name).alias("file_stamp"))


@query("read_clean_parquet", over("""
    SELECT household_id, cast(month_slot AS VARCHAR) AS month_slot, total_income FROM inc""", "inc"))
def read_clean_parquet(t):
    folder = shared_dir(t.spark, "clean-inc")
    t.inc.write.parquet(folder)
    return r.read_clean_parquet(t.spark, folder, t.inc.schema).select(
        "household_id", text("month_slot"), "total_income")


@query("read_projected", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def read_projected(t):
    return r.read_projected(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("write_month_partitions", over("""
    SELECT file_stamp, count(*) AS n, count(total_income) AS with_income FROM inc GROUP BY file_stamp""", "inc"))
def write_month_partitions(t):
    folder = shared_dir(t.spark, "months")
    s.write_month_partitions(t.inc, folder)
    return t.spark.read.parquet(folder).groupBy(F.col("file_stamp").cast("string").alias("file_stamp")).agg(
        F.count(F.lit(1)).alias("n"), F.count("total_income").alias("with_income"))


@query("incremental_skip_done", over("""
    SELECT file_stamp, household_id, total_income FROM inc WHERE month_slot >= DATE '2000-01-01'""", "inc"))
def incremental_skip_done(t):
    folder = shared_dir(t.spark, "done")
    s.write_month_partitions(t.inc.filter(F.col("month_slot") < F.lit("2000-01-01").cast("date")), folder)
    return s.incremental_skip_done(t.inc, folder).select("file_stamp", "household_id", "total_income")


@query("merge_union_schema", over("""
    SELECT household_id, reference_month, total_income AS amount, NULL::DOUBLE AS exp_food_adjusted FROM inc
    UNION ALL SELECT household_id, reference_month, try_cast(reference_month AS DOUBLE), exp_food_adjusted FROM con
    UNION ALL SELECT household_id, NULL::VARCHAR, age_years, NULL::DOUBLE FROM poi""", "inc", "con", "poi"))
def merge_union_schema(t):
    return r.merge_union_schema([
        t.inc.select("household_id", "reference_month", F.col("total_income").alias("amount")),
        t.con.select("household_id", "reference_month", F.col("reference_month").alias("amount"), "exp_food_adjusted"),
        t.poi.select("household_id", F.col("age_years").cast("string").alias("amount")),
    ])


@query("write_json_report", over("""
    SELECT state, count(*) AS n, count(total_income) AS with_income FROM household GROUP BY state""", "household"))
def write_json_report(t):
    folder = shared_dir(t.spark, "report")
    report = t.household.groupBy("state").agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count("total_income").alias("with_income")).alias("rows"))
    s.write_json_report(report, folder)
    return t.spark.read.json(folder).select("state", "rows.n", "rows.with_income")


@query("latest_report", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def latest_report(t):
    folder = shared_dir(t.spark, "reports")
    events = t.table("events")
    first_half = events.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    for day, rows in (("20240116", first_half), ("20240131", events)):
        s.write_json_report(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
                            f"{folder}/drift_report_{day}")
    return s.latest_report(t.spark, folder).select("event_type", "n")


@query("dataset_inventory")
def dataset_inventory(t):
    return s.dataset_inventory(t.spark, {"given tables": t.sf_dir}, "*.parquet")


@query("size_reduction")
def size_reduction(t):
    raw, clean = shared_dir(t.spark, "inventory-raw"), shared_dir(t.spark, "inventory-clean")
    t.inc_raw.write.option("header", True).csv(raw)
    t.inc.write.parquet(clean)
    return s.size_reduction(s.dataset_inventory(t.spark, {"raw": raw, "clean": clean}), ["raw"], ["clean"])


@query("table_shape", """
    SELECT 'lineitem' AS table_name, count(*) AS n_rows, 11 AS n_columns FROM lineitem""")
def table_shape(t):
    return s.table_shape(t.table("lineitem"), "lineitem")


#: Rows of a compressed raw file, which one task reads.
RAW_FILE_ROWS = 500_000

DATASET_SQL = over("""
    SELECT file_stamp, household_id, cast(month_slot AS VARCHAR) AS month_slot, financial_stress, food_stress, debt_stress,
           health_stress, composite_stress_score, emi_to_income_ratio, savings_proxy, exp_food_adjusted, age_years_hh_mean,
           num_members, gender_hh_mode FROM household""", "household")


def shown_dataset(df):
    return df.select("file_stamp", "household_id", text("month_slot"), "financial_stress", "food_stress", "debt_stress",
                     "health_stress", "composite_stress_score", "emi_to_income_ratio", "savings_proxy", "exp_food_adjusted",
                     "age_years_hh_mean", "num_members", "gender_hh_mode")


@query("household_stress_dataset", DATASET_SQL)
def stress_dataset_in_one_plan(t):
    return shown_dataset(household_stress_dataset(t.inc_raw, t.con_raw, t.poi_raw))


@query("household_job", DATASET_SQL)
def household_job(t):
    """Raw CSV months to the dataset in two runs. The second finds the older raw months done; of the
    dataset it builds the new months, and older ones that new people files belong to. The raw
    months are compressed, many files to a large one, because text takes several times the space of all else."""
    base = shared_dir(t.spark, "household")
    raw = {INCOME: t.inc_raw, CONSUMPTION: t.con_raw, PEOPLE: t.poi_raw}
    folders = {unit: f"{base}/raw/{unit}" for unit in raw}
    job, cutoff = HouseholdJob(t.spark, folders, f"{base}/out"), DEMO_CUTOFF.replace("-", "")
    done = []
    for arrived in (F.col("file_stamp") < cutoff, F.col("file_stamp") >= cutoff):
        for unit, rows in raw.items():
            (rows.filter(arrived).repartition("file_stamp").write.mode("append").option("header", True).option("compression", "gzip")
             .option("maxRecordsPerFile", RAW_FILE_ROWS).partitionBy("file_stamp").csv(folders[unit]))
        done.append(set(job.run()[INCOME]))
    if done[0] & done[1]:
        raise AssertionError("a month was ingested twice")
    return shown_dataset(job.dataset())
