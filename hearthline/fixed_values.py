"""Survey vocabularies, column names, thresholds and sentences.

Everything in this module is data that has to be equal everywhere the surveys are
read or scored. It is stated once, plainly, in the order the surveys use.
"""

# ---------------------------------------------------------------------------
# Null markers and ordinal levels
# ---------------------------------------------------------------------------
STRING_NULLS = [
    "Data Not Available", "Not Applicable", "Not applicable",
    "data not available", "not applicable", "DK",
]
MONEY_SENTINEL = -99.0
AGE_SENTINEL = -100.0

EDUCATION_LEVELS = [
    "Illiterate", "Literate but no formal schooling", "Below Primary",
    "Primary", "Middle", "Secondary", "Higher Secondary",
    "Diploma", "Graduate", "Post Graduate", "Doctorate",
]

# ---------------------------------------------------------------------------
# Raw column name -> clean column name
# ---------------------------------------------------------------------------
HOUSEHOLD_COLUMNS = {
    "HH_ID": "household_id",
    "STATE": "state",
    "HR": "homogeneous_region",
    "DISTRICT": "district",
    "REGION_TYPE": "region_type",
    "STRATUM": "stratum",
    "MONTH_SLOT": "month_slot",
}

MONTHLY_COLUMNS = {
    **HOUSEHOLD_COLUMNS,
    "MONTH": "reference_month",
    "AGE_GROUP": "age_group",
    "OCCUPATION_GROUP": "occupation_group",
    "EDU_GROUP": "education_group",
    "GENDER_GROUP": "gender_group",
    "SIZE_GROUP": "household_size_group",
}

INC_COLUMNS = {
    **MONTHLY_COLUMNS,
    "TOT_INC": "total_income",
    "INC_OF_ALL_MEMS_FRM_WAGES": "income_all_members_from_wages",
    "INC_OF_HH_FRM_RENT": "income_household_from_rent",
    "INC_OF_HH_FRM_SELF_PRODN": "income_household_from_self_production",
    "INC_OF_HH_FRM_PVT_TRF": "income_household_from_private_transfers",
    "INC_OF_HH_FRM_BIZ_PROFIT": "income_household_from_business_profit",
    "PSU_ID": "primary_sampling_unit_id",
    "RESPONSE_STATUS": "response_status",
}

POI_COLUMNS = {
    "HH_ID": "household_id",
    "MEM_ID": "member_id",
    "STATE": "state",
    "HR": "homogeneous_region",
    "DISTRICT": "district",
    "REGION_TYPE": "region_type",
    "STRATUM": "stratum",
    "MONTH_SLOT": "month_slot",
    "GENDER": "gender",
    "AGE_YRS": "age_years",
    "RELATION_WITH_HOH": "relation_with_head_of_household",
    "RELIGION": "religion",
    "CASTE": "caste",
    "CASTE_CATEGORY": "caste_category",
    "LITERACY": "is_literate",
    "EDU": "education_level",
    "NATURE_OF_OCCUPATION": "occupation_type",
    "IS_HEALTHY": "is_healthy",
    "IS_ON_ORAL_MEDICATION": "is_on_regular_medication",
    "IS_HOSPITALISED": "is_hospitalised",
    "HAS_BANK_AC": "has_bank_account",
    "HAS_CREDITCARD": "has_credit_card",
    "HAS_KISAN_CREDITCARD": "has_kisan_credit_card",
    "HAS_DEMAT_AC": "has_demat_account",
    "HAS_PF_AC": "has_provident_fund_account",
    "HAS_LIC": "has_life_insurance",
    "HAS_HEALTH_INS": "has_health_insurance",
    "HAS_MOBILE": "has_mobile_phone",
    "RESPONSE_STATUS": "response_status",
}

# Monthly expenditure columns of the consumption survey.
CON_EXPENSE_COLUMNS = {
    "ADJ_TOT_EXP": "total_expenditure_adjusted",
    "ADJ_M_EXP_FOOD": "exp_food_adjusted",
    "ADJ_M_EXP_EDIBLE_OILS": "exp_edible_oils_adjusted",
    "ADJ_M_EXP_VEGGIE_N_FRUITS": "exp_vegetables_and_fruits_adjusted",
    "ADJ_M_EXP_VEGGIE_N_WET_SPICES": "exp_vegetables_and_wet_spices_adjusted",
    "ADJ_M_EXP_FRUITS": "exp_fruits_adjusted",
    "ADJ_M_EXP_POTATOES_N_ONIONS": "exp_potatoes_and_onions_adjusted",
    "ADJ_M_EXP_MILK_N_MILK_PRDS": "exp_milk_and_milk_products_adjusted",
    "ADJ_M_EXP_BREAD": "exp_bread_adjusted",
    "ADJ_M_EXP_BISCUITS": "exp_biscuits_adjusted",
    "ADJ_M_EXP_SALTY_SNACKS": "exp_salty_snacks_adjusted",
    "ADJ_M_EXP_CHOCLATE_CAKE_ICECREAM": "exp_chocolate_cake_icecream_adjusted",
    "ADJ_M_EXP_MEAT_EGGS_N_FISH": "exp_meat_eggs_and_fish_adjusted",
    "ADJ_M_EXP_BEVERAGES_N_WATER": "exp_beverages_and_water_adjusted",
    "ADJ_M_EXP_BOTTLED_WATER": "exp_bottled_water_adjusted",
    "ADJ_M_EXP_INTOXICANTS": "exp_intoxicants_adjusted",
    "ADJ_M_EXP_CIGARETTES_N_TOBACCO": "exp_cigarettes_and_tobacco_adjusted",
    "M_EXP_CEREALS_N_PULSES": "exp_cereals_and_pulses",
    "M_EXP_DRY_SPICES": "exp_dry_spices",
    "M_EXP_NOODLES_N_FLAKES": "exp_noodles_and_flakes",
    "M_EXP_JAM_KETCHUP_PICKLES": "exp_jam_ketchup_pickles",
    "M_EXP_HEALTH_SUPPLEMENTS": "exp_health_supplements",
    "M_EXP_READY_TO_EAT_FOOD": "exp_ready_to_eat_food",
    "M_EXP_TEA_COFFEE": "exp_tea_and_coffee",
    "M_EXP_SUGAR_N_OTH_SWEETENERS": "exp_sugar_and_sweeteners",
    "M_EXP_OTH_FOODS": "exp_other_food",
    "M_EXP_LIQUOR": "exp_liquor",
    "M_EXP_CLOTHING_N_FOOTWEAR": "exp_clothing_and_footwear",
    "M_EXP_CLOTHING": "exp_clothing",
    "M_EXP_FOOTWEAR": "exp_footwear",
    "M_EXP_CLOTHING_ACCESSORIES": "exp_clothing_accessories",
    "M_EXP_COSMETIC_N_TOILETRIES": "exp_cosmetics_and_toiletries",
    "M_EXP_DENTAL_CARE_PRDS": "exp_dental_care_products",
    "M_EXP_BATHING_SOAP": "exp_bathing_soap",
    "M_EXP_COSMETICS": "exp_cosmetics",
    "M_EXP_FACE_WASH": "exp_face_wash",
    "M_EXP_SHAVING_ARTICLES": "exp_shaving_articles",
    "M_EXP_HAIR_OIL": "exp_hair_oil",
    "M_EXP_SHAMPOO_N_CONDITIONER": "exp_shampoo_and_conditioner",
    "M_EXP_POWDER": "exp_powder",
    "M_EXP_CREAMS": "exp_creams",
    "M_EXP_DEODORANTS_N_PERFUMES": "exp_deodorants_and_perfumes",
    "M_EXP_ALL_TYPES_OF_DETERGENT": "exp_detergent_all_types",
    "M_EXP_APPLIANCES": "exp_appliances",
    "ADJ_M_EXP_RESTAURANTS": "exp_restaurants_adjusted",
    "M_EXP_RECREATION": "exp_recreation",
    "M_EXP_ENTMT": "exp_entertainment",
    "M_EXP_TOYS": "exp_toys",
    "M_EXP_BILLS_N_RENT": "exp_bills_and_rent",
    "M_EXP_HOUSE_RENT": "exp_house_rent",
    "M_EXP_WATER_CHARGES": "exp_water_charges",
    "M_EXP_SOCIETY_CHARGES": "exp_society_charges",
    "M_EXP_OTH_TAXES": "exp_other_taxes",
    "M_EXP_COOKING_FUEL": "exp_cooking_fuel",
    "ADJ_M_EXP_PETROL_N_CNG": "exp_petrol_and_cng_adjusted",
    "ADJ_M_EXP_DIESEL": "exp_diesel_adjusted",
    "M_EXP_ELECTRICITY": "exp_electricity",
    "ADJ_M_EXP_TRANSPORT": "exp_transport_adjusted",
    "ADJ_M_EXP_AUTORICKSHAW_N_CAB": "exp_autorickshaw_and_cab_adjusted",
    "M_EXP_AIRFARE": "exp_airfare",
    "M_EXP_COMMUNICATION_N_INFO": "exp_communication_and_information",
    "M_EXP_CELL_PHONE": "exp_mobile_phone",
    "M_EXP_CABLE_TV": "exp_cable_tv",
    "M_EXP_INTERNET": "exp_internet",
    "M_EXP_NEWSPAPERS_N_MAGAZINES": "exp_newspapers_and_magazines",
    "M_EXP_EDU": "exp_education",
    "M_EXP_SCHOOL_COLLEGE_FEES": "exp_school_and_college_fees",
    "M_EXP_PVT_TUITION_FEES": "exp_private_tuition_fees",
    "M_EXP_HOBBY_CLASSES": "exp_hobby_classes",
    "M_EXP_ADDITIONAL_PROF_EDU": "exp_additional_professional_education",
    "M_EXP_HEALTH": "exp_health",
    "M_EXP_MEDICINES": "exp_medicines",
    "M_EXP_HOSPITALISATION_FEES": "exp_hospitalisation_fees",
    "M_EXP_HEALTH_INS_PREMIUM": "exp_health_insurance_premium",
    "M_EXP_HEALTH_ENHANCEMENT": "exp_health_enhancement",
    "M_EXP_ALL_EMIS": "exp_all_emis",
    "M_EXP_EMI_FOR_HOUSE": "exp_emi_house",
    "M_EXP_EMI_FOR_VEHICLE": "exp_emi_vehicle",
    "M_EXP_MISC": "exp_miscellaneous",
    "M_EXP_DOMESTIC_HELP": "exp_domestic_help",
    "M_EXP_MOTOR_VEHICLE_REPAIRS": "exp_motor_vehicle_repairs",
    "M_EXP_REMITTANCES_SENT": "exp_remittances_sent",
    "M_EXP_SOCIAL_OBLIGATIONS": "exp_social_obligations",
    "M_EXP_RELIGIOUS_OBLIGATIONS": "exp_religious_obligations",
    "M_EXP_GENERAL_INS": "exp_general_insurance",
    "M_EXP_VACATION": "exp_vacation",
    "M_EXP_FURNITURE_N_FURNISHINGS": "exp_furniture_and_furnishings",
    "M_EXP_PAINTING_N_RENOVATION": "exp_painting_and_renovation",
}

CON_COLUMNS = {
    **MONTHLY_COLUMNS,
    **CON_EXPENSE_COLUMNS,
    "RESPONSE_STATUS": "response_status",
}

# ---------------------------------------------------------------------------
# Column roles
# ---------------------------------------------------------------------------
HOUSEHOLD_KEYS = list(HOUSEHOLD_COLUMNS.values())
MONTHLY_KEYS = HOUSEHOLD_KEYS + ["reference_month"]

INCOME_SOURCES = [
    "income_all_members_from_wages",
    "income_household_from_rent",
    "income_household_from_self_production",
    "income_household_from_private_transfers",
    "income_household_from_business_profit",
]
INCOME_AMOUNTS = ["total_income"] + INCOME_SOURCES

# The income table keeps everything it renames but the two administrative columns.
INC_KEEP = [c for c in INC_COLUMNS.values()
            if c not in ("primary_sampling_unit_id", "response_status")]
POI_YES_NO = [
    "is_literate", "is_healthy", "is_on_regular_medication", "is_hospitalised",
    "has_bank_account", "has_credit_card", "has_kisan_credit_card",
    "has_demat_account", "has_provident_fund_account", "has_life_insurance",
    "has_health_insurance", "has_mobile_phone",
]
POI_KEEP = [c for c in POI_COLUMNS.values() if c != "response_status"] + ["education_rank"]
CON_KEEP = [c for c in CON_COLUMNS.values() if c != "response_status"]

# member column -> (household column, aggregate); nulls never take part
PEOPLE_AGGREGATES = {
    "is_healthy": ("is_healthy_hh_min", "min"),
    "is_hospitalised": ("is_hospitalised_hh_any", "max"),
    "is_on_regular_medication": ("is_on_regular_medication_hh_any", "max"),
    "has_bank_account": ("has_bank_account_hh_any", "max"),
    "has_health_insurance": ("has_health_insurance_hh_any", "max"),
    "has_life_insurance": ("has_life_insurance_hh_any", "max"),
    "has_provident_fund_account": ("has_provident_fund_account_hh_any", "max"),
    "has_credit_card": ("has_credit_card_hh_any", "max"),
    "has_demat_account": ("has_demat_account_hh_any", "max"),
    "has_mobile_phone": ("has_mobile_phone_hh_any", "max"),
    "age_years": ("age_years_hh_mean", "mean"),
    "education_rank": ("education_rank_hh_max", "max"),
}
PEOPLE_CATEGORIES = {
    "gender": "gender_hh_mode",
    "occupation_type": "occupation_type_hh_mode",
    "education_level": "education_level_hh_mode",
}

STRESS_LABELS = ["financial_stress", "food_stress", "debt_stress", "health_stress"]
COMPOSITE_LABEL = "composite_stress_score"
LEAKAGE_TOTALS = ["total_income", "total_expenditure_adjusted"]
RATIO_COLUMNS = [
    "emi_to_income_ratio", "food_to_expense_ratio", "health_to_expense_ratio",
    "education_to_expense_ratio", "discretionary_to_expense_ratio",
    "savings_proxy",
]
ENGINEERED_FEATURES = [
    "dependents_ratio", "savings_buffer_months", "no_insurance_vulnerability",
    "rural_low_income_flag", "emi_health_interaction",
]
NUMERIC_FEATURES = RATIO_COLUMNS + [
    "income_diversity_score", "age_years_hh_mean", "education_rank_hh_max",
    "exp_all_emis", "exp_food_adjusted", "exp_health", "exp_education",
    "exp_recreation", "exp_vacation", "exp_restaurants_adjusted",
] + INCOME_SOURCES + [
    "is_healthy_hh_min", "is_hospitalised_hh_any", "is_on_regular_medication_hh_any",
    "has_bank_account_hh_any", "has_health_insurance_hh_any", "has_life_insurance_hh_any",
    "has_provident_fund_account_hh_any", "has_credit_card_hh_any",
    "has_demat_account_hh_any", "has_mobile_phone_hh_any",
] + ENGINEERED_FEATURES
CATEGORICAL_FEATURES = [
    "state", "region_type", "age_group", "occupation_group", "education_group",
    "gender_group", "household_size_group", "gender_hh_mode", "occupation_type_hh_mode",
]
EXCLUDED_FEATURES = {
    "financial_stress": ["savings_proxy"],
    "food_stress": ["food_to_expense_ratio"],
    "debt_stress": [],
    "health_stress": [],
    COMPOSITE_LABEL: [],
}

# ---------------------------------------------------------------------------
# Formula constants and decision limits
# ---------------------------------------------------------------------------
EPS = 1e-9
FINANCIAL_GAP_LIMIT = 0.1
FOOD_SHARE_LIMIT = 0.5
EMI_SHARE_LIMIT = 0.3
HEALTH_SHARE_LIMIT = 0.10
LOW_INCOME_LIMIT = 25000.0
DEPENDENTS_RATIO_CAP = 200.0
TEMPORAL_CUTOFF = "2023-01-01"
RECENCY_CUTOFF = "2022-01-01"
RECENCY_WEIGHT = 2.0
SMOTE_TRIGGER_RATIO = 50.0
SMOTE_TARGET_RATIO = 0.1
SMOTE_NEIGHBOURS = 5
MAX_TRAINING_ROWS = 1_000_000
EVALUATION_THRESHOLDS = {
    "financial_stress": 0.5, "food_stress": 0.5, "debt_stress": 0.5, "health_stress": 0.2,
}
SERVING_THRESHOLDS = {
    "financial_stress": 0.35, "food_stress": 0.45, "debt_stress": 0.50, "health_stress": 0.50,
}
HIGH_INCOME = 150000.0
HIGH_INCOME_HEALTH_THRESHOLD = 0.65
LOW_SAVINGS_SHARE = 0.10
OVERRIDE_PROBABILITY = 0.40
UNCERTAIN_STD = 0.15
BASELINE_STRESS_RATE = 0.42
DRIFT_SHARE_LIMIT = 0.30
RATE_SHIFT_LIMIT = 0.15
MODEL_VERSION = "v5"

STATE_PRIOR_WEIGHT = 0.20
DEFAULT_STATE_PRIOR = 0.42
STATE_PRIORS = {
    "Bihar": 0.70, "Uttar Pradesh": 0.65, "Jharkhand": 0.62,
    "Madhya Pradesh": 0.60, "Assam": 0.58, "Rajasthan": 0.56,
    "Odisha": 0.55, "Chhattisgarh": 0.58, "Meghalaya": 0.54,
    "Delhi": 0.30, "Kerala": 0.28, "Karnataka": 0.32,
    "Tamil Nadu": 0.34, "Himachal Pradesh": 0.30, "Goa": 0.25,
    "Punjab": 0.35, "Haryana": 0.38,
}

# ---------------------------------------------------------------------------
# Category levels of the surveys
# ---------------------------------------------------------------------------
STATES = [
    "Andhra Pradesh", "Assam", "Bihar", "Chandigarh", "Chhattisgarh", "Delhi", "Goa",
    "Gujarat", "Haryana", "Himachal Pradesh", "Jammu & Kashmir", "Jharkhand", "Karnataka",
    "Kerala", "Madhya Pradesh", "Maharashtra", "Meghalaya", "Odisha", "Puducherry", "Punjab",
    "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh",
    "Uttarakhand", "West Bengal",
]
EDUCATION_GROUPS = [
    "All Graduates household", "All Matriculates household", "Graduates dominated household",
    "Graduates majority household", "Graduates minority household",
    "Households of all illiterates", "Households of all literates",
    "Households of some literates", "Matriculates dominated household",
    "Matriculates majority household", "Matriculates minority household",
]
GENDER_GROUPS = [
    "Balanced", "Female Dominated", "Female Majority", "Male Dominated", "Male Majority",
    "Only Females", "Only Males",
]

# ---------------------------------------------------------------------------
# Questionnaire vocabulary and sentences
# ---------------------------------------------------------------------------
YES_WORDS = ["yes", "y", "ha", "haan", "true", "1", "ji han", "bilkul"]
FLAG_WORDS = ["yes", "y", "true", "1"]
QUESTION_STEPS = 15
HEALTH_GUARD_MESSAGE = (
    "Please answer whether any household member has been hospitalised "
    "or is on regular medication to assess health stress."
)
DEFAULT_REASON = "Multiple financial risk factors detected"
LEVEL_NAMES = ["None", "Mild", "Moderate", "Severe"]
STEP_SECTIONS = [
    (1, "Location"), (3, "Household Info"), (8, "Income & Expenses"),
    (12, "Health & Insurance"), (None, "Final Details"),
]
ADVICE_BY_DOMAIN = {
    "financial_stress": "Your spending is exceeding your income. "
                        "Try to reduce non-essential expenses by 10-15%.",
    "food_stress": "Food costs are consuming more than 50% of your budget. "
                   "Consider planning meals in advance.",
    "debt_stress": "EMI payments are high relative to income. "
                   "Explore loan restructuring options.",
    "health_stress": "Health expenses are significant. "
                     "Look into PM-JAY (Ayushman Bharat) scheme.",
}
ADVICE_ACTIONS = [
    "Build an emergency fund of 3 months’ expenses.",
    "Open a Jan Dhan account if you don’t have one.",
    "Check eligibility for PMJJBY (life insurance ₹2 lakh at ₹436/year).",
    "Track daily expenses for 30 days to find savings opportunities.",
    "Consult a local bank for loan consolidation options.",
]
