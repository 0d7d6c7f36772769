"""Models that outlive the session: saved ensembles with their preparation, under versions.

A model folder holds, per label, immutable versions and a pointer table. A version has the
ensemble in MLlib's own format, the preparation (numbers, words and one table of all levels as
Parquet), the bounds that inputs are checked against, and one row about the fit. Publishing writes the whole
version first and then appends one row to the pointer; the newest row names the version in
force. A job that dies before that append leaves the version in force as it was, and its retry
starts the version over. Going back to an older version is one more row.
"""

from __future__ import annotations

from collections.abc import Sequence
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.plans.training import Preparation, StressModel

POINTER = "label string, version string, trained_on string, rounds int, depth int, published_at timestamp"
NUMBERS = "position int, feature string, median double, mean double, scale double"
WORDS = "position int, feature string, mode string, typical_code int"
LEVELS = "feature string, level string, code int"
BOUNDS = "feature string, p1 double, p99 double"
ABOUT = "label string, kind string, scale_pos_weight double"
#: Two appends to one folder at once would clear each other's unfinished files.
POINTING = Lock()
KINDS = {"classifier": GBTClassificationModel, "regressor": GBTRegressionModel}


def fingerprint(df: DataFrame) -> str:
    """A short name of a table's rows, whatever their order: their number and the sum of their hashes."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("h")).first()
    return f"{row.n}-{int(row.h or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def save_model(model: StressModel, path: str, bounds: DataFrame | None = None, spark: SparkSession | None = None) -> None:
    """Writes one model with everything that scoring needs; an unfinished folder is replaced."""
    prep = model.prep
    spark = spark or SparkSession.getActiveSession()  # a thread of its own has no active session

    def write(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{name}")

    model.model.write().overwrite().save(f"{path}/trees")
    write(spark.createDataFrame([(i, c, prep.medians[c], prep.means[c], prep.scales[c]) for i, c in enumerate(prep.numeric)], NUMBERS).coalesce(1),
          "numbers")
    write(spark.createDataFrame([(i, c, prep.modes[c], prep.typical_codes.get(c)) for i, c in enumerate(prep.categorical)], WORDS).coalesce(1),
          "words")
    levels = spark.createDataFrame([], LEVELS)
    for c, table in prep.level_tables.items():
        levels = levels.union(table.select(F.lit(c), F.col(c), F.col("code").cast("int")))
    write(levels, "levels")
    write((bounds.select("feature", "p1", "p99") if bounds is not None else spark.createDataFrame([], BOUNDS)).coalesce(1), "bounds")
    kind = "regressor" if isinstance(model.model, GBTRegressionModel) else "classifier"
    write(spark.createDataFrame([(model.label, kind, model.scale_pos_weight)], ABOUT).coalesce(1), "about")


def load_model(spark: SparkSession, path: str) -> StressModel:
    """The model saved at `path`; level tables of any size stay tables."""
    numbers = spark.read.schema(NUMBERS).parquet(f"{path}/numbers").orderBy("position").collect()
    words = spark.read.schema(WORDS).parquet(f"{path}/words").orderBy("position").collect()
    levels = spark.read.schema(LEVELS).parquet(f"{path}/levels")
    about = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
    prep = Preparation([r.feature for r in numbers], [r.feature for r in words])
    prep.medians = {r.feature: r.median for r in numbers}
    prep.means = {r.feature: r.mean for r in numbers}
    prep.scales = {r.feature: r.scale for r in numbers}
    prep.modes = {r.feature: r.mode for r in words}
    prep.typical_codes = {r.feature: r.typical_code for r in words if r.typical_code is not None}
    prep.level_tables = {r.feature: levels.filter(F.col("feature") == r.feature).select(F.col("level").alias(r.feature), "code")
                         for r in words}
    bounds = {r.feature: (r.p1, r.p99) for r in spark.read.schema(BOUNDS).parquet(f"{path}/bounds").collect()}
    return StressModel(about.label, prep, KINDS[about.kind].load(f"{path}/trees"), about.scale_pos_weight, f"{path}/trees", bounds)


class ModelFolder:
    """Versions of the models of several labels, and which one is in force."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, label: str, version: str) -> str:
        return f"{self.root}/{label}/{version}"

    def published(self) -> DataFrame:
        """All pointer rows, the newest of a label being in force."""
        try:
            return self.spark.read.schema(POINTER).parquet(f"{self.root}/pointer")
        except AnalysisException:
            return self.spark.createDataFrame([], POINTER)

    def _point(self, label: str, version: str, trained_on: str, rounds: int, depth: int) -> None:
        row = self.spark.createDataFrame([(label, version, trained_on, rounds, depth)], ", ".join(POINTER.split(", ")[:-1]))
        with POINTING:
            row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")

    def publish(self, model: StressModel, version: str, trained_on: str, rounds: int, depth: int,
                bounds: DataFrame | None = None) -> StressModel:
        """Saves `model` as `version` and puts it in force; returns it as loaded from there."""
        if not self.published().filter((F.col("label") == model.label) & (F.col("version") == version)).isEmpty():
            raise ValueError(f"version {version} of {model.label} is published already")
        save_model(model, self.path(model.label, version), bounds, self.spark)
        self._point(model.label, version, trained_on, rounds, depth)
        return load_model(self.spark, self.path(model.label, version))

    def back_to(self, label: str, version: str) -> None:
        """Puts an older version in force again."""
        known = self.published().filter((F.col("label") == label) & (F.col("version") == version)).first()
        if known is None:
            raise ValueError(f"{label} has no version {version}")
        self._point(label, version, known.trained_on, known.rounds, known.depth)

    def version_in_force(self, label: str, trained_on: str | None = None, least_rounds: int = 0) -> str | None:
        rows = self.published().filter((F.col("label") == label) & (F.col("rounds") >= least_rounds))
        if trained_on is not None:
            rows = rows.filter(F.col("trained_on") == trained_on)
        return rows.agg(F.max_by("version", "published_at")).first()[0]

    def load(self, label: str, trained_on: str | None = None, least_rounds: int = 0) -> StressModel | None:
        """The version in force, if there is one that was trained on those rows and long enough."""
        version = self.version_in_force(label, trained_on, least_rounds)
        return None if version is None else load_model(self.spark, self.path(label, version))

    def load_all(self, labels: Sequence[str]) -> dict[str, StressModel]:
        found = {label: self.load(label) for label in labels}
        return {label: model for label, model in found.items() if model is not None}
