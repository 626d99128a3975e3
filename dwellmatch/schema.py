"""Domain values and row schemas of the listing tables."""

from pyspark.sql import types as T

# Fixed values.
STATES = [
    "Baden-Württemberg",
    "Bayern",
    "Berlin",
    "Brandenburg",
    "Bremen",
    "Hamburg",
    "Hessen",
    "Mecklenburg-Vorpommern",
    "Niedersachsen",
    "Nordrhein-Westfalen",
    "Rheinland-Pfalz",
    "Saarland",
    "Sachsen",
    "Sachsen-Anhalt",
    "Schleswig-Holstein",
    "Thüringen",
]
# Fixed values.
BOOLEAN_ATTRIBUTES = [
    "balcony",
    "terrace",
    "elevator",
    "parking",
    "cellar",
    "furnished",
    "pets_allowed",
    "new_building",
    "provisionfrei",
]
# Fixed values.
DEAL_TYPES = ["rent", "buy"]
LISTING_STATUSES = ["active", "updated", "expired", "removed"]
MATCHABLE_STATUSES = ["active", "updated"]
MATCH_STATES = ["pending", "notified", "dismissed"]
NOTIFICATION_STATUSES = ["queued", "pending", "sent", "failed", "skipped"]
RUN_STATUSES = ["running", "success", "partial", "failed"]
# Latitude and longitude limits of the served country.
BBOX = {"lat": (47.2, 55.1), "lng": (5.8, 15.1)}
# Accepted ranges of the numeric listing columns.
RANGES = {
    "price": (50.0, 50000.0),
    "warm_rent": (50.0, 60000.0),
    "area": (5.0, 1000.0),
    "rooms": (0.5, 20.0),
}
MAX_IMAGES = 10

# Decimals the stored listing columns are rounded to.
STORED_DECIMALS = {
    "price": "decimal(10,2)",
    "warm_rent": "decimal(10,2)",
    "area": "decimal(7,2)",
    "rooms": "decimal(4,1)",
}

IMAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("position", T.IntegerType())])

# Attributes map a key to canonical JSON text ('true', '"x"', '2'), which keeps
# the JSON type: the string "2" and the number 2 stay different.
LISTING = T.StructType(
    [
        T.StructField("source_slug", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("deal_type", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("warm_rent", T.DoubleType()),
        T.StructField("area", T.DoubleType()),
        T.StructField("rooms", T.DoubleType()),
        T.StructField("city", T.StringType()),
        T.StructField("bundesland", T.StringType()),
        T.StructField("postal_code", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("images", T.ArrayType(IMAGE)),
        T.StructField("raw", T.StringType()),
    ]
)
LISTING_COLUMNS = LISTING.fieldNames()

FILTER = T.StructType(
    [
        T.StructField("profile_id", T.LongType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("value_json", T.StringType()),
    ]
)
