"""Fixed values of the planning domain.

Values below must equal the planner's configuration for identical results;
they are stated plainly and kept together.
"""

from __future__ import annotations

# --- fixed values: workflow steps -------------------------------------------
STEP_SENDER = "EVALUATE_SENDER_LIMIT"
STEP_DRIVER = "EVALUATE_DRIVER_CAPACITY"
STEP_RESIDUAL = "EVALUATE_RESIDUAL_CAPACITY"
STEP_PRINT = "EVALUATE_PRINT_CAPACITY"
STEP_PHASE_2 = "SENT_TO_PREPARE_PHASE_2"
DELETED_PREFIX = "DELETED~"

#: Final step of a shipment that no driver covers (a value of our own).
NO_DRIVER = "NO_DRIVER"
#: Final step of a shipment that no week to come has capacity for (a value of our own).
NO_CAPACITY = "NO_CAPACITY"

# --- fixed values: products ---------------------------------------------------
PRODUCT_RS = "RS"
ESTIMATED_PRODUCTS = ["AR", "890"]

# --- fixed values: priority map (priority -> PRODUCT_<p>.ATTEMPT_<a> keys) ---
PRIORITY_MAP = {
    1: ["PRODUCT_RS.ATTEMPT_0"],
    2: ["PRODUCT_AR.ATTEMPT_1", "PRODUCT_890.ATTEMPT_1"],
    3: ["PRODUCT_AR.ATTEMPT_0", "PRODUCT_890.ATTEMPT_0"],
}
DEFAULT_PRIORITY = 3

# --- fixed values: print capacity ---------------------------------------------
PRINT_WEEKLY_WORKING_DAYS = 7
PRINT_EXECUTIONS_PER_DAY = 17

# --- fixed values: horizons ------------------------------------------------------
DEDUPE_HORIZON_SECONDS = 86400
COUNTER_TTL_DAYS = 14
ESTIMATE_TTL_DAYS = 365
ORDER_TTL_DAYS = 3650

# --- fixed values: tries of a failing record, page sizes --------------------------
INGEST_TRIES = 3
SWITCH_OFF_EXECUTION_LIMIT = 5000
DELIVERY_WEEKDAY = "Mon"

# --- fixed values: the report source table names ------------------------------
CDC_TIMELINE_TABLE = "timelines"
CANCELLATION_CATEGORY = "NOTIFICATION_CANCELLATION_REQUEST"
PREPARE_PREFIX = "PREPARE_"
PREPARE_CATEGORIES = ["PREPARE_ANALOG_DOMICILE", "PREPARE_SIMPLE_REGISTERED_LETTER"]

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
