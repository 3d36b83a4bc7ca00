"""Fixed values the results depend on, kept together in their natural order."""

# --- how a spell ends -----------------------------------------------------
END_STOCKOUT = "stockout"
END_REPLENISHED = "replenished"
END_WINDOW = "window_end"
END_DISCONTINUED = "discontinued"
END_STORE_CLOSED = "store_closed"

# --- feature windows ------------------------------------------------------
TRAILING_WINDOW = 56
SHORT_WINDOW = 7
OPEN_ORDER_WINDOW = 14
HISTORY_DAYS = 90
BURN_IN_DAYS = 28
PROMO_HORIZON = 14

# --- accounting checks ----------------------------------------------------
STOCK_TOLERANCE = 0.5
RECEIPT_LOOKBACK_DAYS = 30
RECEIPT_MATCH_THRESHOLD = 0.80
REFERENTIAL_THRESHOLD = 0.99
DATE_ARTIFACTS = ["########", "#######", "######", "#####", "####", "#VALUE!", "#N/A", "#REF!"]
SEVERITY_ORDER = {"error": 0, "warn": 1, "info": 2}

# --- sizes ----------------------------------------------------------------
SIZE_SCALES = {"EU": (15, 55), "ALT": (75, 99)}

# --- scoring --------------------------------------------------------------
HORIZONS = (7, 14, 28)
LIKELY, POSSIBLE = 0.60, 0.30
EXPENSIVE_QUANTILE, NOTABLE_QUANTILE = 0.80, 0.50
BANDS = ["Critical", "High", "Medium", "Low"]
NON_ACTIONABLE = [
    "store_stockout_rate_90d",
    "prior_stockout_rate",
    "prior_stockouts_90d",
    "tier_rank",
    "seasonality_index",
    "starts_on_weekend",
]

# --- rollups --------------------------------------------------------------
EXCESS_COVER_DAYS = 60
RATE_DAYS = 56
TURNOVER_DAYS = 90
DAYS_IN_YEAR = 365
COVER_BUCKETS = [("0-7", 7), ("7-14", 14), ("14-30", 30), ("30-60", 60), ("60+", None)]
SHORTFALL_DAYS = 14

# --- policy ---------------------------------------------------------------
SERVICE_LEVEL = 0.95
COVER_BOUNDS = (0.1, 400.0)
TEXTBOOK_Z = 1.645
DISPERSION_BOUNDS = (0.1, 1e6)
MIN_DISPERSION = 0.05
FORECAST_FALLBACK = (1.0, 0.35)
FORECAST_MIN_ROWS = 30
WEEKDAY_BOUNDS = (0.1, 5.0)
LEAD_FALLBACK_DAYS = 7.0

# --- levers ---------------------------------------------------------------
REBALANCE = "rebalance_from_store"
EXPEDITE_DC = "expedite_from_dc"
EXPEDITE_SUPPLIER = "expedite_from_supplier"
NO_ACTION = "no_action"
LEVER_COSTS = {REBALANCE: 40.0, EXPEDITE_DC: 90.0, EXPEDITE_SUPPLIER: 220.0}
MARGIN_RATE = 0.40
MIN_DONOR_COVER_DAYS = 14
TRANSFER_LEAD_DAYS = 2.0
DC_EXPEDITE_FALLBACK_DAYS = 1.0
VENDOR_EXPEDITE_FALLBACK_DAYS = 20.0
LEVER_LEAD_SIGMA = 0.5
