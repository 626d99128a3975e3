"""Filter definitions and source rows: the seed dimensions and their idempotent upsert."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellmatch.functions.lifecycle import resolve_binding
from dwellmatch.schema import BOOLEAN_ATTRIBUTES, STATES

DEFINITION_SCHEMA = (
    "key string, label map<string,string>, data_type string, operator_set array<string>, config string, is_active boolean"
)
SOURCE_SCHEMA = "slug string, kind string, is_active boolean, rate_limit_rpm int, config string"

# Fixed values: (key, label de, label en, data type, operators, config).
PLAIN_FILTERS = [
    ("city", "Stadt", "City", "text", ["eq", "in"], {}),
    ("bundesland", "Bundesland", "State", "enum", ["eq", "in"], {"values": STATES}),
    ("postal_code", "PLZ", "Postal code", "text", ["eq", "in"], {}),
    ("location", "Umkreis", "Radius", "geo", ["within"], {}),
    ("price", "Preis", "Price", "number", ["gte", "lte"], {"unit": "EUR", "validation": {"min": 0}}),
    ("area", "Fläche", "Area", "number", ["gte", "lte"], {"unit": "m2", "validation": {"min": 0}}),
    ("rooms", "Zimmer", "Rooms", "number", ["gte", "lte"], {"validation": {"min": 0}}),
]
# Labels of the boolean filters (de, en).
BOOLEAN_LABELS = {
    "balcony": ("Balkon", "Balcony"),
    "terrace": ("Terrasse", "Terrace"),
    "elevator": ("Aufzug", "Elevator"),
    "parking": ("Parkplatz / Garage", "Parking / Garage"),
    "cellar": ("Keller", "Cellar"),
    "furnished": ("Möbliert", "Furnished"),
    "pets_allowed": ("Haustiere erlaubt", "Pets allowed"),
    "new_building": ("Neubau", "New building"),
    "provisionfrei": ("Provisionsfrei", "No commission"),
}
# Source kinds with an extraction spec: (kind, active, requests per minute, lifecycle, approved).
SOURCE_KINDS = [
    ("synthetic", True, 120, "ready", True),
    ("marketplace", True, 10, "beta", True),
    ("portal_html", False, 5, "permission-needed", False),
    ("portal_api", False, 5, "permission-needed", False),
    ("aggregator", False, 4, "experimental", False),
    ("landlord", True, 6, "beta", True),
    ("shared_flats", False, 5, "permission-needed", False),
    ("exchange", False, 4, "blocked", False),
]


def filter_definitions(spark: SparkSession) -> DataFrame:
    """The seed rules: seven column filters and one per boolean attribute."""
    rows = [(k, {"de": de, "en": en}, t, ops, json.dumps(cfg), True) for k, de, en, t, ops, cfg in PLAIN_FILTERS]
    rows += [
        (k, dict(zip(("de", "en"), BOOLEAN_LABELS[k])), "bool", ["eq"], "{}", True) for k in BOOLEAN_ATTRIBUTES
    ]
    return spark.createDataFrame(rows, DEFINITION_SCHEMA)


def source_rows(spark: SparkSession) -> DataFrame:
    rows = [
        (kind, kind, active, rpm, json.dumps({"lifecycleStatus": status, "activationApproved": ok}))
        for kind, active, rpm, status, ok in SOURCE_KINDS
    ]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def bind_definitions(definitions: DataFrame) -> DataFrame:
    """Active definitions with their resolved column or attribute."""
    return (
        definitions.filter(F.col("is_active"))
        .withColumn("binding", resolve_binding(F.col("key"), F.col("data_type"), F.col("config")))
        .select(
            "key",
            "data_type",
            "operator_set",
            "config",
            F.col("binding.column").alias("bound_column"),
            F.col("binding.attribute").alias("bound_attribute"),
        )
    )


def upsert_by_key(stored: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Seed rows replace stored rows of the same key; running it twice changes nothing."""
    kept = stored.join(F.broadcast(seed.select(key)), key, "left_anti")
    return kept.unionByName(seed, allowMissingColumns=True)
