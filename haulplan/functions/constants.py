"""Fixed values that define the planning rules."""

EARTH_RADIUS_KM = 6371.0
ROAD_FACTOR = 1.35

# Weight is counted in whole grams wherever loads are added up, so that sums
# are exact and do not depend on the order of the rows.
WEIGHT_UNITS_PER_KG = 1000
MAX_PAYLOAD_KG = 22000
MAX_PAYLOAD_U = MAX_PAYLOAD_KG * WEIGHT_UNITS_PER_KG

# review bands
REVIEW_DETOUR_OK = 0.10
REVIEW_DEST_KM_OK = 25.0

# route filter
SHORT_HAUL_ROAD_KM = 20.0
ROUTE_VOLUME_CAP_CM3 = 960.0 * 240.0 * 240.0
TWO_OPT_MAX_STOPS = 8
TWO_OPT_MAX_PASSES = 10
TWO_OPT_TOLERANCE_KM = 0.01

# load factor
LF_TARGET = 0.72
LF_FLOOR = 0.40
LF_WEIGHT_SHARE = 0.60
LF_SPACE_SHARE = 0.40
FIT_SCORE_SHARE = 0.5
BULK_FACTOR = 1.2
BULK_HOLD_SHARE = 0.95
AXLE_FRONT_KG = 6000.0
AXLE_REAR_KG = 10200.0
DEFER_BELOW_LF = 0.45
FEASIBLE_LF = 0.60

# flat savings model of the console summary
FLAT_INR_PER_TRIP = 850
FLAT_KM_PER_TRIP = 12
FLAT_CO2_PER_KM = 0.27

# zone learning
EMA_ALPHA = 0.5
MIN_RESOLUTION, MAX_RESOLUTION, DEFAULT_RESOLUTION = 6, 10, 8
LOW_LF, HIGH_LF = 0.65, 0.92
MIN_RUNS_TO_ADJUST = 2
MIN_ZONE_LF = 0.01
GRID_STEP = {6: 1.0, 7: 0.5, 8: 0.25, 9: 0.1, 10: 0.05}
GRID_STEP_OTHER = 0.5

# coordinates
COORD_DECIMALS = 3
BUCKET_DEG = 0.2
REGION_LAT = (6.0, 38.0)
REGION_LNG = (68.0, 98.0)

# singleton analysis
MISSED_PICKUP_KM = 60.0
MISSED_DELIVERY_KM = 100.0

LTL_BELOW_KG = 8000.0
