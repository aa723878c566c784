"""Dimensions: lookups by key, options, active universities, schools.

No broadcast hint here: a dimension's size is the caller's, so Spark compares it
with ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges, with
adaptive skew handling for a hot key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondas import schema as S
from rondas.functions.checks import mapped


def with_commune(rows: DataFrame, communes: DataFrame, *, key: str = "comuna_id", strict: bool = False) -> DataFrame:
    """Add the commune's name as ``comuna``."""
    names = communes.select(F.col("comuna_id").alias("_key"), F.col("comuna").alias("_name"))
    return (
        rows.join(names, F.col(key) == F.col("_key"), "left")
        .withColumn("comuna", mapped(F.col(key), F.col("_name"), "commune", strict))
        .drop("_key", "_name")
    )


def with_university(
    rows: DataFrame, universities: DataFrame, *, key: str = "codigo", name: str = "universidad", strict: bool = False
) -> DataFrame:
    """Add the university's name under ``name``."""
    names = universities.select(F.col("codigo").alias("_key"), F.col("universidad").alias("_name"))
    return (
        rows.join(names, F.col(key) == F.col("_key"), "left")
        .withColumn(name, mapped(F.col(key), F.col("_name"), "university", strict))
        .drop("_key", "_name")
    )


def with_slot_label(
    rows: DataFrame, slots: DataFrame, column: str, *, name: str | None = None, suffix: str = " hrs.", strict: bool = False
) -> DataFrame:
    """Replace a time of day by its slot label and ``suffix``; null stays null."""
    labels = slots.select(F.col("hora").alias("_key"), F.concat("etiqueta", F.lit(suffix)).alias("_name"))
    return (
        rows.join(labels, F.col(column) == F.col("_key"), "left")
        .withColumn(name or column, mapped(F.col(column), F.col("_name"), "time slot", strict))
        .drop("_key", "_name")
    )


def school_enrichment(rows: DataFrame, schools: DataFrame, communes: DataFrame, *, strict: bool = False) -> DataFrame:
    """Add school name and commune of each ``rbd``; an unknown school gives nulls."""
    facts = schools.select(F.col("rbd").alias("_rbd"), F.col("nombre").alias("_nombre"), F.col("cod_com").alias("comuna_id"))
    rows = rows.drop("nombre", "comuna_id", "comuna").join(facts, F.col("rbd") == F.col("_rbd"), "left")
    rows = rows.withColumn("nombre", mapped(F.col("rbd"), F.col("_nombre"), "school", strict)).drop("_rbd", "_nombre")
    return with_commune(rows, communes, strict=strict)


def lookup_misses(rows: DataFrame, dimension: DataFrame, key: str, dimension_key: str) -> DataFrame:
    """Keys of ``rows`` the dimension does not know, with the number of rows they affect."""
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("clave"))
        .agg(F.count(F.lit(1)).alias("filas"))
        .join(dimension.select(F.col(dimension_key).alias("_key")), F.col("clave") == F.col("_key"), "left_anti")
    )


def active_universities(universities: DataFrame, excluded: Iterable[int]) -> DataFrame:
    return universities.filter(~F.col("codigo").isin(*excluded))


def users(universities: DataFrame) -> DataFrame:
    """Active universities and the public, who is user 0."""
    public = universities.sparkSession.range(1).select(
        F.lit(S.PUBLIC_USER).alias("codigo"), F.lit(S.PUBLIC_USER_LABEL).alias("universidad")
    )
    return public.unionByName(universities.select("codigo", "universidad"))


def options(dimension: DataFrame, key: str, label: str) -> DataFrame:
    """Value / label pairs of a lookup table."""
    return dimension.select(F.col(key).alias("value"), F.col(label).alias("label"))


def commune_options(communes: DataFrame) -> DataFrame:
    """Communes as options, by name."""
    return options(communes, "comuna_id", "comuna").orderBy("label", "value")


def slot_options(slots: DataFrame) -> DataFrame:
    """Times of day as options, in order."""
    return options(slots, "hora", "etiqueta").orderBy("value")
