"""Names, labels and types that downstream readers rely on."""

from __future__ import annotations

# Plant state code -> Arabic label.
STATE_LABELS = {
    "new": "تحت التأسيس",
    "established": "تحت الانشاء",
    "closed": "مغلق",
    "active": "منتج",
    "canceled": "ملغي",
}

# Land provider code -> Arabic label.
PROVIDER_LABELS = {
    "RCJY": "الهيئة الملكية للجبيل وينبع",
    "MOMRAH": "وزارة الشؤون البلدية والقروية والإسكان",
    "MODON": "الهيئة السعودية للمدن الصناعية ومناطق التقنية",
    "ECZA": "هيئة المدن والمناطق الإقتصادية الخاصة",
    "MEWA": "وزارة البيئة والمياه والزراعة",
    "GACA": "الهيئة العامة للطيران المدني",
    "MAWANI": "هيئة الموانئ السعودية",
    "UNIVERSITIES": "الجامعات",
    "MIM": "وزارة الصناعة والثروة المعدنية",
    "SAR": "المؤسسة العامة للخطوط الحديدية",
    "ARAMCO": "أرامكو السعودية",
    "NEOM": "نيوم",
    "SPARK": "مدينة الملك سلمان للطاقة",
    "OTHER": "اخرى",
}

# Plant attributes kept in the meta document, name -> Spark type.
PLANT_META = {
    "GAS_WASTE": "string",
    "LAND_AREA": "double",
    "SOLID_WASTE": "string",
    "STORES_AREA": "double",
    "LIQUID_WASTE": "string",
    "PRODUCT_AREA": "double",
    "BUILDING_AREA": "double",
    "RENTAL_AMOUNT": "double",
    "MANAGMENT_AREA": "double",
    "CONSTRUCTION_COST": "double",
    "ANNUAL_WORKING_DAYS": "int",
    "DAILY_WORKING_HOURS": "int",
    "EXPECTED_LABOR_POWER": "int",
    "MANUFACTURING_METHOD": "string",
}

# License attributes kept in the meta document, name -> Spark type.
LICENSE_META = {
    "AREA": "string",
    "CITY": "string",
    "ENERGY_SOURCE": "string",
    "CURRENT_ASSETS": "double",
    "HAS_OTHER_SOURCES": "boolean",
    "NON_CURRENT_ASSETS": "double",
    "EXPECTED_LOAN_AMOUNT": "double",
    "ELECTRIC_SERVICE_NUMBER": "double",
    "HAS_ELECTRICAL_INFORMATION": "boolean",
    "EXPECTED_FINANCING_FROM_FUNDS_BANKS": "double",
    "EXPECTED_FINANCING_FROM_OTHER_SOURCES": "double",
    "EXPECTED_FINANCING_FROM_INDUSTRIAL_FUND": "double",
    "ANNUAL_EXPECTED_ELECTRICAL_ENERGY_VOLUME": "string",
}

# Landing columns of the two modelled source tables.
LANDING_PLANTS = """
    id bigint, updated_at timestamp_ntz, state string, number string,
    land_provider string, license_id bigint, address_id bigint,
    industrial_city_id bigint, is_rent boolean, has_approved_manpower boolean,
    inside_industrial_city boolean, closed_at timestamp_ntz,
    created_at timestamp_ntz, canceled_at timestamp_ntz,
    established_at timestamp_ntz, hs_12_confirmed_at timestamp_ntz,
    started_production_at timestamp_ntz, ndb_synched_at timestamp_ntz,
    ndb_last_ops_at timestamp_ntz, main_activity_code_l2 string,
    main_activity_code_l4 string, meta string
"""
LANDING_LICENSES = """
    id bigint, updated_at timestamp_ntz, number string,
    created_at timestamp_ntz, deleted_at timestamp_ntz,
    canceled_at timestamp_ntz, suspended_at timestamp_ntz,
    expires_at timestamp_ntz, issue_date timestamp_ntz,
    renewed_at timestamp_ntz, user_id bigint, investor_id bigint,
    commercial_entity_id bigint, cancelled_by bigint, investment_size string,
    investment_type string, meta string
"""

# License columns carried into the plant profile, source -> output.
PROFILE_LICENSE_COLUMNS = {
    "LICENSE_KEY": "LICENSE_KEY",
    "USER_ID": "USER_ID",
    "LICENSE_NUMBER": "LICENSE_NUMBER",
    "LICENSE_EXPIRES_AT": "LICENSE_EXPIRES_AT",
    "LICENSE_ISSUE_DATE": "LICENSE_ISSUE_DATE",
    "LICENSE_RENEWED_AT": "LICENSE_RENEWED_AT",
    "LICENSE_CYCLE": "LICENSE_CYCLE",
    "license_status": "LICENSE_STATUS",
    "INVESTOR_ID": "INVESTOR_ID",
    "INVESTMENT_SIZE": "INVESTMENT_SIZE",
    "INVESTMENT_TYPE": "INVESTMENT_TYPE",
    "ENTITY_ID": "ENTITY_ID",
    "AREA": "LICENSE_AREA",
    "CITY": "LICENSE_CITY",
}

# Plant columns carried into the plant profile, in output order.
PROFILE_PLANT_COLUMNS = (
    "PLANT_KEY", "PLANT_ID", "LICENSE_ID", "ADDRESS_ID", "INDUSTRIAL_CITY_ID",
    "PLANT_status", "PLANT_NUMBER", "plant_status_ar", "land_provider_ar",
    "LAND_PROVIDER_en", "IS_RENT", "CLOSED_AT", "CREATED_AT", "UPDATED_AT",
    "CANCELED_AT", "ESTABLISHED_AT", "HS_12_CONFIRMED_AT",
    "HAS_APPROVED_MANPOWER", "MAIN_ACTIVITY_CODE_L2", "MAIN_ACTIVITY_CODE_L4",
    "STARTED_PRODUCTION_AT", "INSIDE_INDUSTRIAL_CITY", *PLANT_META,
)
PROFILE_RENAMED = {
    "CREATED_AT": "PLANT_CREATED_AT",
    "UPDATED_AT": "PLANT_UPDATED_AT",
    "CANCELED_AT": "PLANT_CANCELED_AT",
}

# The watermark of an empty target.
EPOCH = "1970-01-01 00:00:00"

# Default calendar range.
DIM_DATE_START = "2010-01-01"
DIM_DATE_END = "2030-12-31"

# Rows per fetch from a source database.
FETCH_SIZE = 50_000

# Pattern of accepted schema, table, bucket and key names.
IDENTIFIER = r"^[a-zA-Z0-9_.-]+$"

# Seconds before an API request is given up.
API_TIMEOUT = 60

# Bronze columns in output order, name -> (landing column, rule).
# Rules: keep, timestamp, date, long_blank / int_blank (text of only spaces is
# NULL), long_empty (only the empty text is NULL), state, provider, cycle, status.
PLANT_COLUMNS = {
    "PLANT_ID": ("id", "keep"),
    "ADDRESS_ID": ("address_id", "keep"),
    "INDUSTRIAL_CITY_ID": ("industrial_city_id", "keep"),
    "PLANT_status": ("state", "keep"),
    "PLANT_NUMBER": ("number", "long_blank"),
    "plant_status_ar": ("state", "state"),
    "land_provider_ar": ("land_provider", "provider"),
    "IS_RENT": ("is_rent", "keep"),
    "CLOSED_AT": ("closed_at", "timestamp"),
    "CREATED_AT": ("created_at", "timestamp"),
    "LICENSE_ID": ("license_id", "keep"),
    "UPDATED_AT": ("updated_at", "timestamp"),
    "CANCELED_AT": ("canceled_at", "timestamp"),
    "LAND_PROVIDER_en": ("land_provider", "keep"),
    "ESTABLISHED_AT": ("established_at", "timestamp"),
    "HS_12_CONFIRMED_AT": ("hs_12_confirmed_at", "timestamp"),
    "NDB_SYNCHED_AT": ("ndb_synched_at", "keep"),
    "NDB_LAST_OPS_AT": ("ndb_last_ops_at", "keep"),
    "HAS_APPROVED_MANPOWER": ("has_approved_manpower", "keep"),
    "MAIN_ACTIVITY_CODE_L2": ("main_activity_code_l2", "int_blank"),
    "MAIN_ACTIVITY_CODE_L4": ("main_activity_code_l4", "int_blank"),
    "STARTED_PRODUCTION_AT": ("started_production_at", "timestamp"),
    "INSIDE_INDUSTRIAL_CITY": ("inside_industrial_city", "keep"),
}
LICENSE_COLUMNS = {
    "LICENSE_ID": ("id", "keep"),
    "USER_ID": ("user_id", "keep"),
    "LICENSE_NUMBER": ("number", "long_empty"),
    "CREATED_AT": ("created_at", "timestamp"),
    "created_date": ("created_at", "date"),
    "DELETED_AT": ("deleted_at", "timestamp"),
    "LICENSE_EXPIRES_AT": ("expires_at", "timestamp"),
    "LICENSE_ISSUE_DATE": ("issue_date", "timestamp"),
    "LICENSE_RENEWED_AT": ("renewed_at", "timestamp"),
    "UPDATED_AT": ("updated_at", "timestamp"),
    "LICENSE_CANCELED_AT": ("canceled_at", "timestamp"),
    "LICENSE_CYCLE": ("expires_at", "cycle"),
    "license_status": ("expires_at", "status"),
    "INVESTOR_ID": ("investor_id", "keep"),
    "CANCELLED_BY": ("cancelled_by", "keep"),
    "SUSPENDED_AT": ("suspended_at", "timestamp"),
    "INVESTMENT_SIZE": ("investment_size", "keep"),
    "INVESTMENT_TYPE": ("investment_type", "keep"),
    "ENTITY_ID": ("commercial_entity_id", "keep"),
}
