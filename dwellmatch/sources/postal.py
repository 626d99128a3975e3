"""Postal code → city → centre lookups over caller-supplied dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RADIUS_KM = 10.0  # fixed value


def fill_location(forms: DataFrame, postal_city: DataFrame, city_centre: DataFrame) -> DataFrame:
    """Fill city, centre and radius of form rows from their postal code.

    ``forms``: postal_code, city, lat, lng, radius_km. A city already given stays; the
    centre follows the postal code; the radius defaults only when a centre is found.
    """
    looked_up = (
        forms.withColumn("_zip", F.when(F.length("postal_code") == 5, F.col("postal_code")))
        .join(postal_city.select(F.col("postal_code").alias("_zip"), F.col("city").alias("_city")), "_zip", "left")
        .join(
            city_centre.select(F.col("city").alias("_city"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng")),
            "_city",
            "left",
        )
    )
    found = F.col("_lat").isNotNull()
    return (
        looked_up.withColumn("city", F.coalesce("city", "_city"))
        .withColumn("lat", F.coalesce("_lat", "lat"))
        .withColumn("lng", F.coalesce("_lng", "lng"))
        .withColumn("radius_km", F.when(found, F.coalesce("radius_km", F.lit(DEFAULT_RADIUS_KM))).otherwise(F.col("radius_km")))
        .drop("_zip", "_city", "_lat", "_lng")
    )
