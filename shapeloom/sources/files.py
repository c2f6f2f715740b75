"""File sources and sinks. Schemas are always given; a file that can't be read is an error."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A


def read_csv(spark: SparkSession, path, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """One path or several; _metadata.file_path tells them apart."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "FAILFAST").csv(path)


def read_subjects(spark: SparkSession, template: str, subjects: list[int], schema: str, width: int = 2) -> DataFrame:
    """One file per subject, whose number is padded into the template's {id}; adds subject."""
    paths = [template.format(id=str(k).zfill(width)) for k in subjects]
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\D*$", 1)
    return read_csv(spark, paths, schema).withColumn("subject", name.cast("int"))


def read_ucr(spark: SparkSession, path: str, points: int, split: str = "train", normalise: bool = True) -> DataFrame:
    """Tab-separated rows: label, then `points` values."""
    names = [f"v{k}" for k in range(points)]
    rows = read_csv(spark, path, "label string, " + ", ".join(f"{n} double" for n in names), header=False, sep="\t")
    x = F.array(*names)
    return rows.select("label", (A.znorm(x) if normalise else x).alias("x"), F.lit(split).alias("split"))


def class_count(*splits: DataFrame) -> DataFrame:
    rows = splits[0].select("label")
    for s in splits[1:]:
        rows = rows.union(s.select("label"))
    return rows.agg(F.countDistinct("label").alias("classes"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Numeric and nominal attributes of a dense relation. The header (its first lines) is read on the driver, the data in parallel."""
    lines = spark.read.text(path).withColumn("value", F.trim("value"))
    head = lines.filter(F.lower("value").startswith("@attribute")).collect()
    columns = []
    for r in head:
        _, name, kind = r.value.split(None, 2)
        columns.append((name.strip("'\""), "double" if kind.lower() in ("numeric", "real", "integer") else "string"))
    data = lines.filter((F.col("value") != "") & ~F.col("value").startswith("@") & ~F.col("value").startswith("%"))
    parts = F.split("value", ",")
    return data.select(*[F.trim(F.get(parts, F.lit(k))).cast(t).alias(n) for k, (n, t) in enumerate(columns)])


def write_arff(df: DataFrame, path: str, relation: str, most_values: int = 10_000) -> None:
    """One text file: the header, then the rows in order of their partitions."""
    head = [f"@relation {relation}", ""]
    for f in df.schema:
        if f.dataType.typeName() == "string":
            values = sorted(r[0] for r in df.select(f.name).filter(F.col(f.name).isNotNull()).distinct().limit(most_values + 1).collect())
            if len(values) > most_values:
                raise ValueError(f"{f.name} has over {most_values} values; a header must list them all")
            head.append(f"@attribute {f.name} {{{','.join(values)}}}")
        else:
            head.append(f"@attribute {f.name} numeric")
    body = df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in df.columns]).alias("value"))
    top = df.sparkSession.createDataFrame([("\n".join([*head, "", "@data"]),)], "value string")
    top.union(body).coalesce(1).write.mode("overwrite").text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Rows of numbers between blanks."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.cast("double")).alias("x"))


def write_matrix(df: DataFrame, path: str, column: str = "x") -> None:
    df.select(F.array_join(F.transform(column, lambda v: v.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.write.mode("overwrite").parquet(path)


def write_run(spark: SparkSession, record: dict, path: str) -> None:
    """One run's record: each name with its value as JSON."""
    spark.createDataFrame([(k, json.dumps(v)) for k, v in record.items()], "name string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def read_run(spark: SparkSession, path: str) -> dict:
    return {r.name: json.loads(r.value) for r in spark.read.parquet(path).collect()}


def open_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results table at path; an empty one of that schema is made if there is none."""
    from ..operators.tables import exists

    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def columns_between(df: DataFrame, first: int, last: int) -> DataFrame:
    """Columns by position, last excluded; negative positions count from the end."""
    return df.select(*[df[f"`{c}`"] for c in df.columns[first:last]])


def append_results(rows: DataFrame, path: str) -> None:
    """Append to a results table, which need not exist."""
    rows.write.mode("append").parquet(path)


def plot_rows(x: DataFrame, column: str = "x") -> DataFrame:
    """t and value of arrays, for plots."""
    return x.select(*[c for c in x.columns if c != column], F.posexplode(column).alias("t", "value"))


def decode_labels(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.decode(column, "UTF-8"))
