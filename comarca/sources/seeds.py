"""Small typed lookup tables shipped with the package as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings of unit names seen in the sources, and the region each belongs to
# (0 Andean, 1 Caribbean, 2 Pacific, 3 Orinoco, 4 Amazon).
REGION_OF_NAME = {
    "atlantico": 1,
    "atlántico": 1,
    "bolivar": 1,
    "bolívar": 1,
    "magdalena": 1,
    "la guajira": 1,
    "guajira": 1,
    "cesar": 1,
    "cordoba": 1,
    "córdoba": 1,
    "sucre": 1,
    "san andres": 1,
    "san andrés": 1,
    "san andres,prov y santa catalina": 1,
    "antioquia": 0,
    "boyaca": 0,
    "boyacá": 0,
    "caldas": 0,
    "cundinamarca": 0,
    "bogota": 0,
    "bogotá": 0,
    "bogota d.c.": 0,
    "bogotá d.c.": 0,
    "norte de santander": 0,
    "santander": 0,
    "risaralda": 0,
    "quindio": 0,
    "quindío": 0,
    "tolima": 0,
    "huila": 0,
    "choco": 2,
    "chocó": 2,
    "valle del cauca": 2,
    "valle": 2,
    "cauca": 2,
    "narino": 2,
    "nariño": 2,
    "arauca": 3,
    "casanare": 3,
    "meta": 3,
    "vichada": 3,
    "amazonas": 4,
    "caqueta": 4,
    "caquetá": 4,
    "guainia": 4,
    "guainía": 4,
    "guaviare": 4,
    "putumayo": 4,
    "vaupes": 4,
    "vaupés": 4,
}


def region_variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGION_OF_NAME.items()), "variant string, region_id int")


def seed_values_sql() -> str:
    return ", ".join(f"('{k}', {v}::int)" for k, v in REGION_OF_NAME.items())


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV lookup with an explicit schema. Codes are declared as text so leading zeros survive."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def lookup_region(df: DataFrame, name: str) -> DataFrame:
    """Attach ``region_id`` by trimmed, lower-cased name; unknown names stay NULL."""
    variants = region_variants(df.sparkSession)
    return df.join(variants, F.trim(F.lower(F.col(name))) == F.col("variant"), "left").drop("variant")
