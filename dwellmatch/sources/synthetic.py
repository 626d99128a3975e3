"""Arithmetic listing generator for dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (city, state, postal code, lat, lng).
CITIES = [
    ("Berlin", "Berlin", "10115", 52.52, 13.405),
    ("München", "Bayern", "80331", 48.137, 11.575),
    ("Hamburg", "Hamburg", "20095", 53.55, 9.993),
    ("Frankfurt", "Hessen", "60311", 50.11, 8.682),
    ("Köln", "Nordrhein-Westfalen", "50667", 50.937, 6.96),
]


def synthetic_rows(ids: DataFrame, seed: int) -> DataFrame:
    """One listing per number in ``ids.i``; the seed is a parameter, so runs repeat."""
    i = F.col("i")
    places = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("city", "bundesland", "postal_code", "lat", "lng"), c)]) for c in CITIES])
    flag = lambda name, mod, rest=0: (F.lit(name), (i % mod == rest).cast("string"))
    flags = [flag("balcony", 2), flag("elevator", 3), flag("parking", 4), flag("pets_allowed", 5), flag("provisionfrei", 2, 1)]
    price = F.lit(500) + (F.lit(seed) + i * 137) % 1500
    ref = F.concat(F.lit(f"{seed}-"), i.cast("string"))
    return (
        ids.withColumn("p", F.element_at(places, (i % len(CITIES) + 1).cast("int")))
        .select(
            F.concat(F.lit("mock-"), ref).alias("id"),
            F.concat(F.lit("https://synthetic.example/listing/"), ref).alias("url"),
            F.concat("p.city", F.lit(" "), (i % 4 + 1).cast("string"), F.lit("-Zi Wohnung")).alias("title"),
            price.cast("double").alias("price"),
            (price + 150).cast("double").alias("warm_rent"),
            (F.lit(30) + (F.lit(seed) + i * 7) % 80).cast("double").alias("area"),
            ((i % 4) * 0.5 + 2.0).cast("double").alias("rooms"),
            "p.*",
            F.create_map(*[c for f in flags for c in f]).alias("attributes"),
        )
    )
