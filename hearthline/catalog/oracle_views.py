"""The survey tables once more, as plain SQL for the independent check."""

from __future__ import annotations

from hearthline import fixed_values as fv


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def text_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def number_of(expr: str) -> str:
    pattern = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    return f"(CASE WHEN regexp_matches({expr}, '{pattern}') THEN try_cast(trim({expr}) AS DOUBLE) END)"


def money_of(expr: str) -> str:
    return f"nullif({number_of(expr)}, -99)"


def text_of(expr: str) -> str:
    return f"(CASE WHEN {expr} NOT IN {text_in(fv.STRING_NULLS)} THEN {expr} END)"


def slot_of(expr: str) -> str:
    return f"cast(try_strptime({expr}, '%b %Y') AS DATE)"


def yes_no_of(expr: str) -> str:
    return f"(CASE upper(trim({expr})) WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END)"


def stamp_of(expr: str) -> str:
    return f"strftime(last_day({expr}), '%Y%m%d')"


def flag_of(expr: str) -> str:
    return f"(CASE WHEN {expr} THEN 1 ELSE 0 END)"


HOUSEHOLD_RAW = "HH_ID, STATE, HR, DISTRICT, REGION_TYPE, STRATUM"
HOUSEHOLD_CLEAN = ", ".join(
    f"{text_of(raw)} AS {clean}" for raw, clean in list(fv.HOUSEHOLD_COLUMNS.items())[:6])
KEYS = "household_id, state, homogeneous_region, district, region_type, stratum, month_slot"

SPEND = {
    "food": "l_linenumber % 2 = 0",
    "emi": "l_returnflag = 'R' AND l_quantity > 25",
    "health": "l_returnflag = 'A' AND l_quantity <= 10",
    "education": "l_returnflag = 'N' AND l_linenumber = 3",
    "recreation": "l_returnflag = 'N' AND l_linenumber = 5",
    "vacation": "l_returnflag = 'N' AND l_linenumber = 7",
    "restaurants": "l_returnflag = 'N' AND l_linenumber = 1",
}
INCOME_PARTS = {
    "wages": "o_orderstatus = 'F'", "rent": "o_orderstatus = 'O'", "business": "o_orderstatus = 'P'",
    "own_production": "o_orderpriority = '5-LOW'", "transfers": "o_orderpriority = '1-URGENT'",
}


def _parts(conditions: dict[str, str], price: str) -> str:
    return ", ".join(
        f"cast(sum(CASE WHEN {cond} THEN cast({price} AS DECIMAL(18,2)) ELSE cast(0 AS DECIMAL(18,2)) END) AS VARCHAR) AS {name}"
        for name, cond in conditions.items())


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "keys": ((), f"""
        SELECT c_custkey AS custkey, cast(c_custkey AS VARCHAR) AS HH_ID,
               list_extract({text_list(fv.STATES)}, n_nationkey + 1) AS STATE, r_name AS HR,
               c_mktsegment AS DISTRICT,
               CASE WHEN c_custkey % 2 = 0 THEN 'RURAL' ELSE 'URBAN' END AS REGION_TYPE,
               r_name || '-' || CASE WHEN c_custkey % 2 = 0 THEN 'RURAL' ELSE 'URBAN' END AS STRATUM
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "inc_raw": (("keys",), f"""
        SELECT {stamp_of('month')} AS file_stamp, {HOUSEHOLD_RAW},
               CASE WHEN REGION_TYPE = 'RURAL' THEN upper(strftime(month, '%b %Y'))
                    ELSE strftime(month, '%b %Y') END AS MONTH_SLOT,
               strftime(month, '%b %Y') AS MONTH,
               CASE WHEN custkey % 13 = 0 THEN 'Data Not Available' ELSE lower(DISTRICT) END AS AGE_GROUP,
               CASE WHEN priority = '3-MEDIUM' THEN 'Not Applicable' ELSE priority END AS OCCUPATION_GROUP,
               CASE WHEN custkey % 17 = 0 THEN 'DK'
                    ELSE list_extract({text_list(fv.EDUCATION_GROUPS)}, custkey % 11 + 1) END AS EDU_GROUP,
               CASE WHEN custkey % 19 = 0 THEN 'dk'
                    ELSE list_extract({text_list(fv.GENDER_GROUPS)}, custkey % 7 + 1) END AS GENDER_GROUP,
               n_orders || ' Members' AS SIZE_GROUP,
               CASE WHEN first_key % 53 = 0 THEN '-99' ELSE total END AS TOT_INC,
               CASE WHEN first_key % 47 = 0 THEN 'abc' WHEN first_key % 59 = 0 THEN '12d'
                    ELSE wages END AS INC_OF_ALL_MEMS_FRM_WAGES,
               CASE WHEN first_key % 61 = 0 THEN 'NaN' ELSE rent END AS INC_OF_HH_FRM_RENT,
               CASE WHEN first_key % 67 = 0 THEN '' ELSE own_production END AS INC_OF_HH_FRM_SELF_PRODN,
               CASE WHEN first_key % 71 = 0 THEN '-99' ELSE transfers END AS INC_OF_HH_FRM_PVT_TRF,
               CASE WHEN first_key % 73 = 0 THEN ' -99.0 ' ELSE business END AS INC_OF_HH_FRM_BIZ_PROFIT,
               'PSU' || HH_ID AS PSU_ID,
               CASE WHEN first_key % 11 = 0 THEN 'Refused' ELSE 'Accepted' END AS RESPONSE_STATUS
        FROM (SELECT o_custkey, cast(date_trunc('month', o_orderdate) AS DATE) AS month,
                     min(o_orderkey) AS first_key, count(*) AS n_orders, min(o_orderpriority) AS priority,
                     cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total,
                     {_parts(INCOME_PARTS, 'o_totalprice')}
              FROM orders GROUP BY 1, 2) JOIN keys ON o_custkey = custkey"""),
    "con_raw": (("keys",), f"""
        SELECT {stamp_of('month')} AS file_stamp, {HOUSEHOLD_RAW},
               strftime(month, '%b %Y') AS MONTH_SLOT, strftime(month, '%b %Y') AS MONTH,
               total AS ADJ_TOT_EXP, food AS ADJ_M_EXP_FOOD, emi AS M_EXP_ALL_EMIS,
               health AS M_EXP_HEALTH,
               CASE WHEN first_key % 41 = 0 THEN '-99' ELSE education END AS M_EXP_EDU,
               recreation AS M_EXP_RECREATION,
               CASE WHEN first_key % 43 = 0 THEN 'abc' ELSE vacation END AS M_EXP_VACATION,
               restaurants AS ADJ_M_EXP_RESTAURANTS, 'Accepted' AS RESPONSE_STATUS
        FROM (SELECT o_custkey, cast(date_trunc('month', o_orderdate) AS DATE) AS month,
                     min(o_orderkey) AS first_key,
                     cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR) AS total,
                     {_parts(SPEND, 'l_extendedprice')}
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
        JOIN keys ON o_custkey = custkey"""),
    "poi_raw": (("keys",), f"""
        SELECT {stamp_of("CASE WHEN l_linenumber <= 4 THEN month ELSE cast(month + INTERVAL 1 MONTH AS DATE) END")} AS file_stamp,
               HH_ID,
               l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS MEM_ID,
               STATE, HR, DISTRICT, REGION_TYPE, STRATUM, strftime(month, '%b %Y') AS MONTH_SLOT,
               CASE WHEN l_partkey % 37 = 0 THEN 'Not Applicable'
                    WHEN l_linestatus = 'O' THEN 'M' ELSE 'F' END AS GENDER,
               CASE WHEN l_partkey % 29 = 0 THEN '-100'
                    ELSE cast(cast(l_quantity + 10 AS INTEGER) AS VARCHAR) END AS AGE_YRS,
               CASE WHEN l_partkey % 23 = 0 THEN 'DK'
                    ELSE list_extract({text_list(fv.EDUCATION_LEVELS)}, l_suppkey % 11 + 1) END AS EDU,
               list_extract(['Wage Labourer', 'Support Staff', 'Student', 'Unoccupied', 'Home Maker'],
                            l_partkey % 5 + 1) AS NATURE_OF_OCCUPATION,
               CASE WHEN l_suppkey % 11 = 0 THEN 'N' ELSE 'Y' END AS LITERACY,
               CASE WHEN l_partkey % 31 = 0 THEN ' n ' ELSE 'Y' END AS IS_HEALTHY,
               CASE WHEN l_partkey % 127 = 0 THEN ' y ' WHEN l_partkey % 5 = 0 THEN 'maybe'
                    ELSE 'N' END AS IS_ON_ORAL_MEDICATION,
               CASE WHEN l_partkey % 31 = 0 THEN 'Y' WHEN l_partkey % 7 = 0 THEN 'DK'
                    ELSE 'N' END AS IS_HOSPITALISED,
               CASE WHEN l_suppkey % 3 = 0 THEN 'N' ELSE 'Y' END AS HAS_BANK_AC,
               CASE WHEN l_suppkey % 5 = 0 THEN 'Y' ELSE 'N' END AS HAS_CREDITCARD,
               CASE WHEN l_suppkey % 9 = 0 THEN 'Y' ELSE 'N' END AS HAS_KISAN_CREDITCARD,
               CASE WHEN l_suppkey % 7 = 0 THEN 'Y' ELSE 'N' END AS HAS_DEMAT_AC,
               CASE WHEN l_suppkey % 11 = 0 THEN 'Y' ELSE 'N' END AS HAS_PF_AC,
               CASE WHEN l_suppkey % 4 = 0 THEN 'Y' ELSE 'N' END AS HAS_LIC,
               CASE WHEN l_suppkey % 6 = 0 THEN 'Y' ELSE 'N' END AS HAS_HEALTH_INS,
               CASE WHEN l_suppkey % 13 = 0 THEN 'N' ELSE 'y' END AS HAS_MOBILE,
               'Accepted' AS RESPONSE_STATUS
        FROM lineitem
        JOIN (SELECT o_orderkey, o_custkey, cast(date_trunc('month', o_orderdate) AS DATE) AS month
              FROM orders) ON l_orderkey = o_orderkey
        JOIN keys ON o_custkey = custkey"""),
    "inc": (("inc_raw",), f"""
        SELECT file_stamp, {HOUSEHOLD_CLEAN}, {slot_of('MONTH_SLOT')} AS month_slot,
               {text_of('MONTH')} AS reference_month, {text_of('AGE_GROUP')} AS age_group,
               {text_of('OCCUPATION_GROUP')} AS occupation_group, {text_of('EDU_GROUP')} AS education_group,
               {text_of('GENDER_GROUP')} AS gender_group, {text_of('SIZE_GROUP')} AS household_size_group,
               {money_of('TOT_INC')} AS total_income,
               {money_of('INC_OF_ALL_MEMS_FRM_WAGES')} AS income_all_members_from_wages,
               {money_of('INC_OF_HH_FRM_RENT')} AS income_household_from_rent,
               {money_of('INC_OF_HH_FRM_SELF_PRODN')} AS income_household_from_self_production,
               {money_of('INC_OF_HH_FRM_PVT_TRF')} AS income_household_from_private_transfers,
               {money_of('INC_OF_HH_FRM_BIZ_PROFIT')} AS income_household_from_business_profit
        FROM inc_raw WHERE RESPONSE_STATUS = 'Accepted'"""),
    "con": (("con_raw",), f"""
        SELECT file_stamp, {HOUSEHOLD_CLEAN}, {slot_of('MONTH_SLOT')} AS month_slot,
               {text_of('MONTH')} AS reference_month,
               {money_of('ADJ_TOT_EXP')} AS total_expenditure_adjusted,
               {money_of('ADJ_M_EXP_FOOD')} AS exp_food_adjusted,
               {money_of('ADJ_M_EXP_RESTAURANTS')} AS exp_restaurants_adjusted,
               {money_of('M_EXP_RECREATION')} AS exp_recreation, {money_of('M_EXP_EDU')} AS exp_education,
               {money_of('M_EXP_HEALTH')} AS exp_health, {money_of('M_EXP_ALL_EMIS')} AS exp_all_emis,
               {money_of('M_EXP_VACATION')} AS exp_vacation
        FROM con_raw WHERE RESPONSE_STATUS = 'Accepted'"""),
    "poi": (("poi_raw",), f"""
        SELECT file_stamp, {HOUSEHOLD_CLEAN}, {slot_of('MONTH_SLOT')} AS month_slot,
               MEM_ID AS member_id, {text_of('GENDER')} AS gender,
               nullif({number_of('AGE_YRS')}, -100) AS age_years,
               {yes_no_of('LITERACY')} AS is_literate, {text_of('EDU')} AS education_level,
               {text_of('NATURE_OF_OCCUPATION')} AS occupation_type,
               {yes_no_of('IS_HEALTHY')} AS is_healthy,
               {yes_no_of('IS_ON_ORAL_MEDICATION')} AS is_on_regular_medication,
               {yes_no_of('IS_HOSPITALISED')} AS is_hospitalised,
               {yes_no_of('HAS_BANK_AC')} AS has_bank_account,
               {yes_no_of('HAS_CREDITCARD')} AS has_credit_card,
               {yes_no_of('HAS_KISAN_CREDITCARD')} AS has_kisan_credit_card,
               {yes_no_of('HAS_DEMAT_AC')} AS has_demat_account,
               {yes_no_of('HAS_PF_AC')} AS has_provident_fund_account,
               {yes_no_of('HAS_LIC')} AS has_life_insurance,
               {yes_no_of('HAS_HEALTH_INS')} AS has_health_insurance,
               {yes_no_of('HAS_MOBILE')} AS has_mobile_phone,
               list_position({text_list(fv.EDUCATION_LEVELS)}, {text_of('EDU')}) - 1 AS education_rank
        FROM poi_raw WHERE RESPONSE_STATUS = 'Accepted'"""),
    "people_by_file": (("poi",), f"""
        SELECT file_stamp, {KEYS},
               min(is_healthy) AS is_healthy_hh_min, max(is_hospitalised) AS is_hospitalised_hh_any,
               max(is_on_regular_medication) AS is_on_regular_medication_hh_any,
               max(has_bank_account) AS has_bank_account_hh_any,
               max(has_health_insurance) AS has_health_insurance_hh_any,
               max(has_life_insurance) AS has_life_insurance_hh_any,
               max(has_provident_fund_account) AS has_provident_fund_account_hh_any,
               max(has_credit_card) AS has_credit_card_hh_any,
               max(has_demat_account) AS has_demat_account_hh_any,
               max(has_mobile_phone) AS has_mobile_phone_hh_any,
               avg(age_years) AS age_years_hh_mean, max(education_rank) AS education_rank_hh_max,
               arg_min(gender, member_id) FILTER (WHERE gender IS NOT NULL) AS gender_hh_mode,
               arg_min(occupation_type, member_id) FILTER (WHERE occupation_type IS NOT NULL) AS occupation_type_hh_mode,
               arg_min(education_level, member_id) FILTER (WHERE education_level IS NOT NULL) AS education_level_hh_mode,
               count(*) AS num_members
        FROM poi WHERE household_id IS NOT NULL AND state IS NOT NULL AND homogeneous_region IS NOT NULL
          AND district IS NOT NULL AND region_type IS NOT NULL AND stratum IS NOT NULL
          AND month_slot IS NOT NULL
        GROUP BY file_stamp, {KEYS}"""),
    "people": (("people_by_file",), f"""
        SELECT {KEYS},
               min(is_healthy_hh_min) AS is_healthy_hh_min,
               max(is_hospitalised_hh_any) AS is_hospitalised_hh_any,
               max(is_on_regular_medication_hh_any) AS is_on_regular_medication_hh_any,
               max(has_bank_account_hh_any) AS has_bank_account_hh_any,
               max(has_health_insurance_hh_any) AS has_health_insurance_hh_any,
               max(has_life_insurance_hh_any) AS has_life_insurance_hh_any,
               max(has_provident_fund_account_hh_any) AS has_provident_fund_account_hh_any,
               max(has_credit_card_hh_any) AS has_credit_card_hh_any,
               max(has_demat_account_hh_any) AS has_demat_account_hh_any,
               max(has_mobile_phone_hh_any) AS has_mobile_phone_hh_any,
               avg(age_years_hh_mean) AS age_years_hh_mean,
               max(education_rank_hh_max) AS education_rank_hh_max,
               arg_min(gender_hh_mode, file_stamp) FILTER (WHERE gender_hh_mode IS NOT NULL) AS gender_hh_mode,
               arg_min(occupation_type_hh_mode, file_stamp) FILTER (WHERE occupation_type_hh_mode IS NOT NULL) AS occupation_type_hh_mode,
               arg_min(education_level_hh_mode, file_stamp) FILTER (WHERE education_level_hh_mode IS NOT NULL) AS education_level_hh_mode,
               max(num_members) AS num_members
        FROM people_by_file GROUP BY {KEYS}"""),
    "joined": (("inc", "con", "people"), f"""
        SELECT inc.*, con.* EXCLUDE (file_stamp, {KEYS}, reference_month), people.* EXCLUDE ({KEYS})
        FROM inc JOIN con ON {" AND ".join(f"inc.{k} IS NOT DISTINCT FROM con.{k}" for k in ["file_stamp", *fv.MONTHLY_KEYS])}
        LEFT JOIN people ON {" AND ".join(f"inc.{k} = people.{k}" for k in fv.HOUSEHOLD_KEYS)}"""),
    "labelled": (("joined",), f"""
        SELECT *, financial_stress + food_stress + debt_stress + health_stress AS composite_stress_score FROM (
        SELECT *, {flag_of('(total_expenditure_adjusted - total_income) / (total_income + 1e-9) > 0.1')} AS financial_stress,
               {flag_of('exp_food_adjusted / (total_expenditure_adjusted + 1e-9) > 0.5')} AS food_stress,
               {flag_of('exp_all_emis / (total_income + 1e-9) > 0.3')} AS debt_stress,
               {flag_of('coalesce(is_hospitalised_hh_any, 0) > 0 OR coalesce(is_on_regular_medication_hh_any, 0) > 0')} AS health_stress
        FROM joined)"""),
    "household": (("labelled",), """
        SELECT *,
               CASE WHEN num_members / (total_income / 10000 + 1e-9) > 200 THEN 200.0
                    ELSE num_members / (total_income / 10000 + 1e-9) END AS dependents_ratio,
               savings_proxy / (total_expenditure_adjusted + 1e-9) AS savings_buffer_months,
               (1 - coalesce(has_health_insurance_hh_any, 0)) * coalesce(health_to_expense_ratio, 0) AS no_insurance_vulnerability,
               CASE WHEN upper(region_type) IN ('RURAL', 'VILLAGE')
                     AND coalesce(total_income, 0) < 25000 THEN 1 ELSE 0 END AS rural_low_income_flag,
               emi_to_income_ratio * least(coalesce(is_hospitalised_hh_any, 0)
                     + coalesce(is_on_regular_medication_hh_any, 0), 1) AS emi_health_interaction
        FROM (
        SELECT *,
               coalesce(exp_all_emis, 0) / (coalesce(total_income, 0) + 1e-9) AS emi_to_income_ratio,
               coalesce(exp_food_adjusted, 0) / (coalesce(total_expenditure_adjusted, 0) + 1e-9) AS food_to_expense_ratio,
               coalesce(exp_health, 0) / (coalesce(total_expenditure_adjusted, 0) + 1e-9) AS health_to_expense_ratio,
               coalesce(exp_education, 0) / (coalesce(total_expenditure_adjusted, 0) + 1e-9) AS education_to_expense_ratio,
               (coalesce(exp_recreation, 0) + coalesce(exp_vacation, 0) + coalesce(exp_restaurants_adjusted, 0))
                     / (coalesce(total_expenditure_adjusted, 0) + 1e-9) AS discretionary_to_expense_ratio,
               coalesce(total_income, 0) - coalesce(total_expenditure_adjusted, 0) AS savings_proxy,
               CASE WHEN income_all_members_from_wages > 0 THEN 1 ELSE 0 END
             + CASE WHEN income_household_from_rent > 0 THEN 1 ELSE 0 END
             + CASE WHEN income_household_from_self_production > 0 THEN 1 ELSE 0 END
             + CASE WHEN income_household_from_private_transfers > 0 THEN 1 ELSE 0 END
             + CASE WHEN income_household_from_business_profit > 0 THEN 1 ELSE 0 END AS income_diversity_score
        FROM labelled)"""),
    "profiles": (("household",), """
        SELECT household_id, month_slot, state, region_type, total_income AS monthly_income,
               total_expenditure_adjusted AS monthly_total_expense, exp_food_adjusted AS monthly_food_expense,
               exp_all_emis AS monthly_emi, exp_health AS monthly_health_expense,
               exp_education AS monthly_education_expense, exp_recreation AS monthly_recreation_expense,
               exp_vacation AS monthly_vacation_expense, exp_restaurants_adjusted AS monthly_restaurant_expense,
               income_all_members_from_wages AS income_wages, income_household_from_rent AS income_rent,
               income_household_from_self_production AS income_self_production,
               income_household_from_private_transfers AS income_private_transfers,
               income_household_from_business_profit AS income_business,
               is_hospitalised_hh_any > 0 AS is_hospitalised,
               is_on_regular_medication_hh_any > 0 AS is_on_medication,
               has_bank_account_hh_any > 0 AS has_bank_account,
               has_health_insurance_hh_any > 0 AS has_health_insurance,
               has_life_insurance_hh_any > 0 AS has_life_insurance,
               has_provident_fund_account_hh_any > 0 AS has_provident_fund,
               has_credit_card_hh_any > 0 AS has_credit_card,
               has_demat_account_hh_any > 0 AS has_demat_account,
               has_mobile_phone_hh_any > 0 AS has_mobile_phone,
               cast(num_members AS DOUBLE) AS num_members, age_years_hh_mean AS age_head,
               cast(education_rank_hh_max AS DOUBLE) AS education_rank,
               age_group, occupation_group, education_group, gender_group, household_size_group,
               gender_hh_mode AS gender, occupation_type_hh_mode AS occupation,
               education_level_hh_mode AS education
        FROM household"""),
    "prediction_log": ((), """
        SELECT event_id AS conversation_id, user_id, ts AS assessed_at,
               CASE event_type WHEN 'purchase' THEN 'financial_stress' WHEN 'view' THEN 'food_stress'
                    WHEN 'click' THEN 'debt_stress' WHEN 'signup' THEN 'health_stress'
                    ELSE 'composite' END AS domain,
               least(value / 250, 1.0) AS probability, value / 400 AS latency
        FROM events"""),
    "assessments": ((), """
        SELECT event_id AS conversation_id, user_id, ts AS assessed_at,
               least(value / 250, 1.0) AS financial_stress_prob, least(value / 200, 1.0) AS food_stress_prob,
               least(value / 400, 1.0) AS debt_stress_prob,
               CASE WHEN event_type <> 'error' THEN least(value / 500, 1.0) END AS health_stress_prob,
               value > 60 AS is_stressed,
               CASE WHEN event_type <> 'view' THEN value / 1000 END AS prediction_confidence,
               CASE WHEN user_id % 2 = 0 THEN 'v4' ELSE 'v5' END AS ab_group,
               CASE WHEN event_type = 'click' THEN 'v4' ELSE 'v5' END AS model_version
        FROM events"""),
    "answers": (("keys",), f"""
        SELECT 'S' || o_orderkey AS session, o_orderkey * 100 + position AS message_id, text FROM (
        SELECT o_orderkey, unnest(range(0, len(texts))) AS position, unnest(texts) AS text FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN first ELSE list_concat(list_concat(first, rest),
               CASE WHEN o_orderkey % 7 = 0 THEN ['thanks'] ELSE [] END) END AS texts FROM (
        SELECT o_orderkey,
               ['  ' || lower(STATE), (o_orderkey % 6) || ' people',
                list_extract(['Urban area', 'a big CITY', 'village'], o_custkey % 3 + 1),
                CASE o_orderkey % 4 WHEN 0 THEN '₹' || cast(trunc(o_totalprice) AS BIGINT)
                     WHEN 1 THEN cast(floor(o_totalprice / 1000) AS BIGINT) || 'K'
                     WHEN 2 THEN cast(floor(o_totalprice / 10000) AS BIGINT) || '.5 lakh'
                     ELSE cast(o_totalprice AS DECIMAL(18,2)) || ' rupees' END,
                cast(trunc(o_totalprice) AS BIGINT) || ' rupees per month',
                'about 12,' || lpad(cast(o_orderkey % 1000 AS VARCHAR), 3, '0'),
                list_extract(['none', '0', '5k'], o_orderkey % 3 + 1),
                cast(o_orderkey % 50 * 100 AS VARCHAR),
                list_extract(['neither', 'hospitalised', 'Medication', ' BOTH'], o_orderkey % 4 + 1)] AS first,
               [list_extract(['Yes', 'no', 'HAAN', 'ji han', 'maybe'], o_orderkey % 5 + 1),
                list_extract([' y ', 'n'], o_orderkey % 2 + 1),
                list_extract(['bilkul', 'nahi', 'no', '1'], o_orderkey % 4 + 1),
                list_extract(['self-employed', 'DAILY wage worker', 'business owner''s son'], o_orderkey % 3 + 1),
                lower(list_extract({text_list(fv.EDUCATION_LEVELS)}, o_orderkey % 11 + 1)),
                (o_orderkey % 120) || ' years'] AS rest
        FROM orders JOIN keys ON o_custkey = custkey)))"""),
    "steps": (("answers",), """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY message_id) AS step
                       FROM answers) WHERE step <= 15"""),
    "chats": ((), """
        SELECT event_id AS conversation_id,
               CASE WHEN event_type <> 'signup' THEN user_id END AS user_id,
               'session-' || event_id AS session_id, ts AS started_at, value > 10 AS completed
        FROM events"""),
}


def over(select: str, *views: str) -> str:
    """A SELECT with the named views, and what they need, as common table expressions."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for parent in VIEWS[name][0]:
            need(parent)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{select}" if ordered else select
