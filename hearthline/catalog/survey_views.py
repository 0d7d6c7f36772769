"""Survey-shaped tables derived by Spark from the given order, line item and event tables.

A customer is a household, an order month is a survey month, a line item is a household
member. The raw tables carry the survey's raw column names, everything as text, with the
sentinels, null markers and odd spellings real survey files have. Every table is a lazy plan
over the whole source tables.

Lines are aggregated per order before they meet the orders, and orders per household month
before they meet the customers, so a household with a large share of all rows is reduced
map-side before any shuffle.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.functions.features import engineer_features
from hearthline.operators.cleaning import clean_con, clean_inc, clean_poi
from hearthline.plans.household import household_with_totals, people_aggregate
from hearthline.session import spread

MONEY = "decimal(18,2)"
DEMO_CUTOFF = "2000-01-01"
# the third order priority plays a null marker
PRIORITIES = ["1-URGENT", "2-HIGH", "Not Applicable", "4-NOT SPECIFIED", "5-LOW"]
OCCUPATIONS = ["Wage Labourer", "Support Staff", "Student", "Unoccupied", "Home Maker"]


def literal_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def picked(values: list[str], index: Column) -> Column:
    return F.element_at(literal_array(values), index.cast("int") + 1)


def cents(column: str) -> Column:
    """Money as whole cents: sums stay exact and in machine integers."""
    return F.round(F.col(column) * 100).cast("long")


def money_text(total: Column) -> Column:
    return (total.cast("decimal(19,0)") * F.lit(Decimal("0.01"))).cast("string")


def month(ts: str) -> Column:
    return F.trunc(F.col(ts).cast("date"), "month")


def marked(divisor: int, marker: str, by: str, otherwise: Column) -> Column:
    """`marker` where the row's key is a multiple of `divisor`, else the value."""
    return F.when(F.col(by) % divisor == 0, F.lit(marker)).otherwise(otherwise)


class SurveyTables:
    """The given tables and the survey tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return spread(self.table("lineitem"), "l_orderkey")

    # -- keys -----------------------------------------------------------------
    @cached_property
    def keys(self) -> DataFrame:
        """Customers as household keys. Nation and region are fixed-size dimension tables."""
        nation = F.broadcast(self.table("nation").join(
            F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey")))
        region_type = F.when(F.col("c_custkey") % 2 == 0, "RURAL").otherwise("URBAN")
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("custkey"),
                F.col("c_custkey").cast("string").alias("HH_ID"),
                picked(fv.STATES, F.col("n_nationkey")).alias("STATE"),
                F.col("r_name").alias("HR"),
                F.col("c_mktsegment").alias("DISTRICT"),
                region_type.alias("REGION_TYPE"),
                F.concat_ws("-", "r_name", region_type).alias("STRATUM"),
            )
        )

    @staticmethod
    def _stamp(column: str) -> Column:
        return F.date_format(F.last_day(column), "yyyyMMdd")

    # -- raw surveys ------------------------------------------------------------
    @cached_property
    def inc_raw(self) -> DataFrame:
        price = cents("o_totalprice")

        def part(condition: Column) -> Column:
            return money_text(F.sum(F.when(condition, price).otherwise(F.lit(0))))

        orders = spread(self.table("orders"), "o_custkey")
        monthly = orders.groupBy("o_custkey", month("o_orderdate").alias("month")).agg(
            F.min("o_orderkey").alias("first_key"),
            F.count(F.lit(1)).alias("n_orders"),
            F.min(F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"),
            money_text(F.sum(price)).alias("total"),
            part(F.col("o_orderstatus") == "F").alias("wages"),
            part(F.col("o_orderstatus") == "O").alias("rent"),
            part(F.col("o_orderstatus") == "P").alias("business"),
            part(F.col("o_orderpriority") == "5-LOW").alias("own_production"),
            part(F.col("o_orderpriority") == "1-URGENT").alias("transfers"),
        )
        slot = F.date_format("month", "MMM yyyy")
        by = "first_key"
        return monthly.join(self.keys, F.col("o_custkey") == F.col("custkey")).select(
            self._stamp("month").alias("file_stamp"),
            "HH_ID", "STATE", "HR", "DISTRICT", "REGION_TYPE", "STRATUM",
            F.when(F.col("REGION_TYPE") == "RURAL", F.upper(slot)).otherwise(slot).alias("MONTH_SLOT"),
            slot.alias("MONTH"),
            marked(13, "Data Not Available", "custkey", F.lower("DISTRICT")).alias("AGE_GROUP"),
            picked(PRIORITIES, F.col("priority") - 1).alias("OCCUPATION_GROUP"),
            marked(17, "DK", "custkey", picked(fv.EDUCATION_GROUPS, F.col("custkey") % 11)).alias("EDU_GROUP"),
            marked(19, "dk", "custkey", picked(fv.GENDER_GROUPS, F.col("custkey") % 7)).alias("GENDER_GROUP"),
            F.concat(F.col("n_orders").cast("string"), F.lit(" Members")).alias("SIZE_GROUP"),
            marked(53, "-99", by, F.col("total")).alias("TOT_INC"),
            marked(47, "abc", by, marked(59, "12d", by, F.col("wages"))).alias("INC_OF_ALL_MEMS_FRM_WAGES"),
            marked(61, "NaN", by, F.col("rent")).alias("INC_OF_HH_FRM_RENT"),
            marked(67, "", by, F.col("own_production")).alias("INC_OF_HH_FRM_SELF_PRODN"),
            marked(71, "-99", by, F.col("transfers")).alias("INC_OF_HH_FRM_PVT_TRF"),
            marked(73, " -99.0 ", by, F.col("business")).alias("INC_OF_HH_FRM_BIZ_PROFIT"),
            F.concat(F.lit("PSU"), F.col("HH_ID")).alias("PSU_ID"),
            marked(11, "Refused", by, F.lit("Accepted")).alias("RESPONSE_STATUS"),
        )

    @cached_property
    def con_raw(self) -> DataFrame:
        price, none = cents("l_extendedprice"), F.lit(0)
        spend = {
            "food": F.col("l_linenumber") % 2 == 0,
            "emi": (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25),
            "health": (F.col("l_returnflag") == "A") & (F.col("l_quantity") <= 10),
            "education": (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 3),
            "recreation": (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 5),
            "vacation": (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7),
            "restaurants": (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1),
        }
        per_order = self.lines.groupBy("l_orderkey").agg(
            F.sum(price).alias("total"),
            *[F.sum(F.when(cond, price).otherwise(none)).alias(name) for name, cond in spend.items()],
        )
        orders = self.table("orders").select(
            "o_orderkey", "o_custkey", month("o_orderdate").alias("month"))
        monthly = (
            per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_custkey", "month")
            .agg(F.min("o_orderkey").alias("first_key"),
                 *[money_text(F.sum(c)).alias(c) for c in ["total", *spend]])
        )
        slot = F.date_format("month", "MMM yyyy")
        return monthly.join(self.keys, F.col("o_custkey") == F.col("custkey")).select(
            self._stamp("month").alias("file_stamp"),
            "HH_ID", "STATE", "HR", "DISTRICT", "REGION_TYPE", "STRATUM",
            slot.alias("MONTH_SLOT"), slot.alias("MONTH"),
            F.col("total").alias("ADJ_TOT_EXP"),
            F.col("food").alias("ADJ_M_EXP_FOOD"),
            F.col("emi").alias("M_EXP_ALL_EMIS"),
            F.col("health").alias("M_EXP_HEALTH"),
            marked(41, "-99", "first_key", F.col("education")).alias("M_EXP_EDU"),
            F.col("recreation").alias("M_EXP_RECREATION"),
            marked(43, "abc", "first_key", F.col("vacation")).alias("M_EXP_VACATION"),
            F.col("restaurants").alias("ADJ_M_EXP_RESTAURANTS"),
            F.lit("Accepted").alias("RESPONSE_STATUS"),
        )

    @cached_property
    def poi_raw(self) -> DataFrame:
        orders = self.table("orders").select(
            "o_orderkey", "o_custkey", month("o_orderdate").alias("month"))
        people = (
            self.lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.keys, F.col("o_custkey") == F.col("custkey"))
        )

        def every(divisor: int, by: str = "l_suppkey", yes: str = "Y", no: str = "N") -> Column:
            return F.when(F.col(by) % divisor == 0, F.lit(yes)).otherwise(F.lit(no))

        wave = F.when(F.col("l_linenumber") <= 4, F.col("month")).otherwise(F.add_months("month", 1))
        return people.select(
            F.date_format(F.last_day(wave), "yyyyMMdd").alias("file_stamp"),
            "HH_ID",
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("MEM_ID"),
            "STATE", "HR", "DISTRICT", "REGION_TYPE", "STRATUM",
            F.date_format("month", "MMM yyyy").alias("MONTH_SLOT"),
            marked(37, "Not Applicable", "l_partkey",
                   F.when(F.col("l_linestatus") == "O", "M").otherwise("F")).alias("GENDER"),
            marked(29, "-100", "l_partkey",
                   (F.col("l_quantity") + 10).cast("int").cast("string")).alias("AGE_YRS"),
            marked(23, "DK", "l_partkey",
                   picked(fv.EDUCATION_LEVELS, F.col("l_suppkey") % 11)).alias("EDU"),
            picked(OCCUPATIONS, F.col("l_partkey") % 5).alias("NATURE_OF_OCCUPATION"),
            every(11, yes="N", no="Y").alias("LITERACY"),
            every(31, "l_partkey", yes=" n ", no="Y").alias("IS_HEALTHY"),
            F.when(F.col("l_partkey") % 127 == 0, " y ").when(F.col("l_partkey") % 5 == 0, "maybe")
            .otherwise("N").alias("IS_ON_ORAL_MEDICATION"),
            F.when(F.col("l_partkey") % 31 == 0, "Y").when(F.col("l_partkey") % 7 == 0, "DK")
            .otherwise("N").alias("IS_HOSPITALISED"),
            every(3, yes="N", no="Y").alias("HAS_BANK_AC"),
            every(5).alias("HAS_CREDITCARD"),
            every(9).alias("HAS_KISAN_CREDITCARD"),
            every(7).alias("HAS_DEMAT_AC"),
            every(11).alias("HAS_PF_AC"),
            every(4).alias("HAS_LIC"),
            every(6).alias("HAS_HEALTH_INS"),
            every(13, yes="N", no="y").alias("HAS_MOBILE"),
            F.lit("Accepted").alias("RESPONSE_STATUS"),
        )

    # -- clean and joined -------------------------------------------------------
    @cached_property
    def inc(self) -> DataFrame:
        return clean_inc(self.inc_raw)

    @cached_property
    def con(self) -> DataFrame:
        return clean_con(self.con_raw)

    @cached_property
    def poi(self) -> DataFrame:
        return clean_poi(self.poi_raw)

    @cached_property
    def people(self) -> DataFrame:
        return people_aggregate(self.poi)

    @cached_property
    def household(self) -> DataFrame:
        """Household months with labels, ratios, engineered features and totals."""
        return engineer_features(household_with_totals(self.inc, self.con, self.people))

    @cached_property
    def profiles(self) -> DataFrame:
        return profiles_of(self.household)

    # -- prediction log -----------------------------------------------------------
    @cached_property
    def prediction_log(self) -> DataFrame:
        """One row per event: a served prediction of one stress domain."""
        domain = (F.when(F.col("event_type") == "purchase", "financial_stress")
                  .when(F.col("event_type") == "view", "food_stress")
                  .when(F.col("event_type") == "click", "debt_stress")
                  .when(F.col("event_type") == "signup", "health_stress")
                  .otherwise("composite"))
        return prediction_log_of(self.table("events"), domain)

    @cached_property
    def assessments(self) -> DataFrame:
        """One assessment per event with four probabilities and the derived flags."""
        value = F.col("value")
        return self.table("events").select(
            F.col("event_id").alias("conversation_id"),
            F.col("user_id"),
            F.col("ts").alias("assessed_at"),
            F.least(value / 250, F.lit(1.0)).alias("financial_stress_prob"),
            F.least(value / 200, F.lit(1.0)).alias("food_stress_prob"),
            F.least(value / 400, F.lit(1.0)).alias("debt_stress_prob"),
            F.when(F.col("event_type") != "error", F.least(value / 500, F.lit(1.0))).alias("health_stress_prob"),
            (value > 60).alias("is_stressed"),
            F.when(F.col("event_type") != "view", value / 1000).alias("prediction_confidence"),
            F.when(F.col("user_id") % 2 == 0, "v4").otherwise("v5").alias("ab_group"),
            F.when(F.col("event_type") == "click", "v4").otherwise("v5").alias("model_version"),
        )

    @cached_property
    def chats(self) -> DataFrame:
        """Conversation headers: one per event, its user and session."""
        return self.table("events").select(
            F.col("event_id").alias("conversation_id"),
            F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_id"),
            F.concat(F.lit("session-"), F.col("event_id").cast("string")).alias("session_id"),
            F.col("ts").alias("started_at"),
            (F.col("value") > 10).alias("completed"),
        )


    # -- questionnaire answers -----------------------------------------------------
    @cached_property
    def answers(self) -> DataFrame:
        """Every order as a questionnaire session: one row per answer, up to 16 of them."""
        key, price = F.col("o_orderkey"), F.col("o_totalprice")

        def turn(by: Column, *texts: str) -> Column:
            return picked(list(texts), by % len(texts))

        whole = price.cast("long").cast("string")
        income = (F.when(key % 4 == 0, F.concat(F.lit("₹"), whole))
                  .when(key % 4 == 1, F.concat(F.floor(price / 1000).cast("string"), F.lit("K")))
                  .when(key % 4 == 2, F.concat(F.floor(price / 10000).cast("string"), F.lit(".5 lakh")))
                  .otherwise(F.concat(price.cast(MONEY).cast("string"), F.lit(" rupees"))))
        first = F.array(
            F.concat(F.lit("  "), F.lower("STATE")),
            F.concat((key % 6).cast("string"), F.lit(" people")),
            turn(F.col("o_custkey"), "Urban area", "a big CITY", "village"),
            income,
            F.concat(whole, F.lit(" rupees per month")),
            F.concat(F.lit("about 12,"), F.lpad((key % 1000).cast("string"), 3, "0")),
            turn(key, "none", "0", "5k"),
            (key % 50 * 100).cast("string"),
            turn(key, "neither", "hospitalised", "Medication", " BOTH"),
        )
        rest = F.array(
            turn(key, "Yes", "no", "HAAN", "ji han", "maybe"),
            turn(key, " y ", "n"),
            turn(key, "bilkul", "nahi", "no", "1"),
            turn(key, "self-employed", "DAILY wage worker", "business owner's son"),
            F.lower(picked(fv.EDUCATION_LEVELS, key % 11)),
            F.concat((key % 120).cast("string"), F.lit(" years")),
        )
        extra = F.when(key % 7 == 0, F.array(F.lit("thanks"))).otherwise(F.array().cast("array<string>"))
        texts = F.when(key % 13 == 0, first).otherwise(F.concat(first, rest, extra))
        return (
            spread(self.table("orders"), "o_orderkey").join(self.keys, F.col("o_custkey") == F.col("custkey"))
            .select(F.concat(F.lit("S"), key.cast("string")).alias("session"), "o_orderkey",
                    F.posexplode(texts).alias("position", "text"))
            .select("session", (F.col("o_orderkey") * 100 + F.col("position")).alias("message_id"), "text")
        )


def profiles_of(household: DataFrame) -> DataFrame:
    """Household months as questionnaire profiles."""
    yes = {
        "is_hospitalised": "is_hospitalised_hh_any",
        "is_on_medication": "is_on_regular_medication_hh_any",
        "has_bank_account": "has_bank_account_hh_any",
        "has_health_insurance": "has_health_insurance_hh_any",
        "has_life_insurance": "has_life_insurance_hh_any",
        "has_provident_fund": "has_provident_fund_account_hh_any",
        "has_credit_card": "has_credit_card_hh_any",
        "has_demat_account": "has_demat_account_hh_any",
        "has_mobile_phone": "has_mobile_phone_hh_any",
    }
    amounts = {
        "monthly_income": "total_income",
        "monthly_total_expense": "total_expenditure_adjusted",
        "monthly_food_expense": "exp_food_adjusted",
        "monthly_emi": "exp_all_emis",
        "monthly_health_expense": "exp_health",
        "monthly_education_expense": "exp_education",
        "monthly_recreation_expense": "exp_recreation",
        "monthly_vacation_expense": "exp_vacation",
        "monthly_restaurant_expense": "exp_restaurants_adjusted",
        "income_wages": "income_all_members_from_wages",
        "income_rent": "income_household_from_rent",
        "income_self_production": "income_household_from_self_production",
        "income_private_transfers": "income_household_from_private_transfers",
        "income_business": "income_household_from_business_profit",
    }
    return household.select(
        "household_id", "month_slot", "state", "region_type",
        *[F.col(c).alias(n) for n, c in amounts.items()],
        *[(F.col(c) > 0).alias(n) for n, c in yes.items()],
        F.col("num_members").cast("double").alias("num_members"),
        F.col("age_years_hh_mean").alias("age_head"),
        F.col("education_rank_hh_max").cast("double").alias("education_rank"),
        "age_group", "occupation_group", "education_group", "gender_group", "household_size_group",
        F.col("gender_hh_mode").alias("gender"),
        F.col("occupation_type_hh_mode").alias("occupation"),
        F.col("education_level_hh_mode").alias("education"),
    )


def prediction_log_of(events: DataFrame, domain: Column) -> DataFrame:
    return events.select(
        F.col("event_id").alias("conversation_id"), "user_id",
        F.col("ts").alias("assessed_at"),
        domain.alias("domain"),
        F.least(F.col("value") / 250, F.lit(1.0)).alias("probability"),
        (F.col("value") / 400).alias("latency"),
    )
