"""Coordinates and great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.constants import EARTH_RADIUS_KM, GAZETTEER


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER, "country string, place string, lat double, lon double")


def with_coordinates(df: DataFrame, places: DataFrame, country: str, place: str) -> DataFrame:
    """Add lat and lon of (country, place), falling back to the country's centre; null when unknown."""
    key_country = F.trim(F.upper(F.coalesce(F.col(country), F.lit(""))))
    key_place = F.substring(F.trim(F.upper(F.coalesce(F.col(place), F.lit("")))), 1, 50)
    exact = F.broadcast(places.select(
        F.col("country").alias("_c1"), F.col("place").alias("_p1"),
        F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1")))
    centre = F.broadcast(places.where("place = ''").select(
        F.col("country").alias("_c2"), F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2")))
    return (
        df.join(exact, (key_country == F.col("_c1")) & (key_place == F.col("_p1")), "left")
        .join(centre, key_country == F.col("_c2"), "left")
        .withColumn("lat", F.coalesce("_lat1", "_lat2"))
        .withColumn("lon", F.coalesce("_lon1", "_lon2"))
        .drop("_c1", "_p1", "_lat1", "_lon1", "_c2", "_lat2", "_lon2")
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = (
        F.sin(half_dlat) * F.sin(half_dlat)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_dlon) * F.sin(half_dlon)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))
