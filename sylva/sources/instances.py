"""Rows to learn from: labelled delimited text, DataFrames with maps of features or targets, rows in memory, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_csv(spark: SparkSession, path: str, features: list[str], types: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """Text lines whose last field is the label: id (the whole line), ts 0, label, weight 1 and the features, doubles unless typed."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    fields = F.split("value", sep, -1)
    types = types or {}
    columns = [F.try_element_at(fields, F.lit(k + 1)).try_cast(types.get(f, "double")).alias(f) for k, f in enumerate(features)]
    return lines.select(F.col("value").alias("id"), F.lit(0).cast("long").alias("ts"), F.element_at(fields, -1).alias("label"), F.lit(1.0).alias("weight"), *columns)


def from_table(df: DataFrame, id_: str, label: str, features: list[str], ts: str | None = None, weight: str | None = None) -> DataFrame:
    """The columns of instances from those of any table.  Timestamps become microseconds."""
    at = F.lit(0).cast("long")
    if ts:
        at = F.unix_micros(F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts].startswith("timestamp") else F.col(ts).cast("long")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.col(id_).alias("id"), at.alias("ts"), F.col(label).cast("string").alias("label"), w.alias("weight"), *features)


def from_maps(df: DataFrame, features: list[str], feature_map: str = "features", target: str = "target") -> DataFrame:
    """Rows (id, ts, map of features, map label -> weight) as one row per label, a column per feature; absent keys are null."""
    picked = [F.try_element_at(F.col(feature_map), F.lit(f)).alias(f) for f in features]
    return df.select("id", "ts", F.explode(target).alias("label", "weight"), *picked).withColumn("weight", F.col("weight").cast("double"))


def tagged_map(kinds: dict[str, str], columns: dict[str, Column], maps: list[Column] = ()) -> Column:
    """A map from features to values (kind, num, str), of columns and of maps from names to texts.

    kinds: of features by name; numbers are ordinal or continuous.  Names that a map brings and kinds doesn't name are
    nominal, or ordinal if they spell a number.  Missing values are left out; a later map's value comes first.
    """

    def value(kind: Column, v: Column) -> Column:
        numeric = kind.isin("ordinal", "continuous")
        return F.struct(kind.alias("kind"), F.when(numeric, v.try_cast("double")).alias("num"), F.when(~numeric, v.cast("string")).alias("str"))

    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    parts = []
    if columns:
        parts.append(F.create_map(*[x for f, c in columns.items() for x in (F.lit(f), value(F.lit(kinds[f]), c))]))
    for m in maps:
        guess = lambda v: F.when(v.try_cast("double").isNotNull(), F.lit("ordinal")).otherwise(F.lit("nominal"))
        parts.append(F.transform_values(m, lambda k, v: value(F.coalesce(F.try_element_at(named, k), guess(v)), v)))
    out = F.coalesce(parts[0], F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<kind:string,num:double,str:string>>>")))
    for more in parts[1:]:
        out = F.map_zip_with(out, F.coalesce(more, F.map_filter(out, lambda k, v: F.lit(False))), lambda k, a, b: F.coalesce(b, a))
    return F.map_filter(out, lambda k, v: v["num"].isNotNull() | v["str"].isNotNull())


def boolean_label(column: str) -> Column:
    """A boolean label as the string 'true' or 'false'."""
    return F.when(F.col(column), F.lit("true")).when(~F.col(column), F.lit("false"))


def parse_boolean(column: str) -> Column:
    """Exactly 'true' or 'false'; anything else is null."""
    return F.when(F.col(column) == "true", True).when(F.col(column) == "false", False)


def in_memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_metrics(df: DataFrame, path: str, header: bool = False) -> None:
    """A metric as tab-separated text."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)
