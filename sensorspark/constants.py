"""Fixed values that results depend on.

These must equal the behaviour being reproduced; they are stated plainly here
in one place and referenced everywhere else.
"""

# --- fixed values: measurement model -------------------------------------
PARAMETERS = ["pm25", "pm10", "no2", "o3"]          # allow-list, in order
TARGET = "pm25"
UNIT_MAP = {"pm25": "µg/m³", "pm10": "µg/m³", "no2": "µg/m³", "o3": "µg/m³"}
REQUIRED_COLUMNS = ["datetime", "value", "parameter", "unit", "location", "latitude", "longitude"]
DEDUP_KEY = ["datetime", "parameter", "location"]
CITY_BBOX = (76.8, 28.4, 77.4, 28.9)                 # lon_min, lat_min, lon_max, lat_max
MAX_RADIUS_M = 25000
DEFAULT_ROLLING_DAYS = 90
SHORT_SPAN_DAYS = 30
# ISO code -> country id lookup of the location service
COUNTRY_IDS = {"IN": 13, "US": 5, "FR": 67, "DE": 73, "GB": 2, "CN": 20,
               "PK": 163, "BD": 16, "NP": 155, "TN": 212, "NG": 157, "MX": 142}

# --- fixed values: features ------------------------------------------------
TARGET_LAGS = [1, 2, 3, 6, 12, 24, 48, 72]
ROLLING_WINDOWS = [24, 48, 72]
CROSS_PARAMS = ["pm10", "no2", "o3"]
CROSS_LAGS = [24, 48, 72]
INTERP_LIMIT = 6        # linear interpolation, at most 6 steps forward
FFILL_LIMIT = 3         # then forward fill at most 3 more steps
SEQ_LENGTH = 72         # T
TRAIN_FRAC = 0.70
VAL_FRAC = 0.15

# --- fixed values: metrics, drift, run decisions ---------------------------
MAPE_FLOOR = 1.0
WITHIN_PCT = 0.25
WITHIN_UNITS = 50.0
IOA_EPS = 1e-8
IMPROVEMENT_EPS = 1e-8
CLAIM_MSE_IMPROVEMENT = 7.5
PSI_BINS = 10
PSI_FLOOR = 1e-10
PSI_RETRAIN = 0.15
PSI_BANDS = (0.1, 0.25)          # <0.1 none, 0.1-0.25 moderate, >0.25 significant
PSI_MIN_FEATURES = 5
PSI_SAMPLE_ROWS = 1000
PERSISTENCE_ALARM_FACTOR = 3.0
LATEST_WINDOWS = 100
FORECAST_HOURS = 24
# dashboard status bands: (lower step, upper step, colours low->high)
BAND_MSE_IMPROVEMENT = (5.0, 7.5, ("red", "yellow", "green"))
BAND_RMSE = (20.0, 35.0, ("green", "yellow", "red"))
BAND_R2 = (0.7, 0.85, ("red", "yellow", "green"))

# --- fixed values: test-data measurement view over `events` ----------------
EVENT_PARAMETER = {"click": "pm25", "error": "pm10", "purchase": "no2", "view": "o3", "signup": "other"}
