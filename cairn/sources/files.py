"""File sources: JSON envelopes, JSON lines, delimited text, sheets, features, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_envelope(spark: SparkSession, path: str, key: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """The rows of the list under ``key`` in JSON documents ``{key: [...]}`` below ``path``."""
    outer = T.StructType([T.StructField(key, T.ArrayType(schema))])
    docs = spark.read.schema(outer).option("multiLine", True).option("encoding", encoding).json(path)
    return docs.select(F.explode(key).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Delimited text with a header and quoting."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def read_sheets(spark: SparkSession, paths: dict[str, str], schema: T.StructType | str, skip: tuple[str, ...] = ()) -> DataFrame:
    """One delimited file a sheet; the sheet's name becomes a column."""
    parts = [read_delimited(spark, p, schema).withColumn("sheet", F.lit(s)) for s, p in sorted(paths.items()) if s not in skip]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_features(spark: SparkSession, path: str, properties: T.StructType, coordinates: T.DataType) -> DataFrame:
    """The features of GeoJSON collections: their properties, geometry type and coordinates."""
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", coordinates)])
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", geometry)])
    rows = read_envelope(spark, path, "features", feature)
    return rows.select("properties.*", F.col("geometry.type").alias("geometry_type"), "geometry.coordinates")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, path, bytes) of the files below a folder, their contents unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", F.col("length").alias("bytes"))


def slices(dimension: DataFrame, column: str, kinds: list[str], other: str = "other") -> DataFrame:
    """Every value of a small dimension with every kind, and a remainder slice for each kind."""
    each = F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")
    named = dimension.select(F.col(column).alias("member"), each)
    rest = dimension.sparkSession.range(1).select(F.lit(other).alias("member"), each)
    return named.unionByName(rest)
