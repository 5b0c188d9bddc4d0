"""Files: folders of text, CSV, JSON, images; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What makes a UTF-8 file begin with a byte order mark.
BOM = chr(0xFEFF)


def text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of every .txt file; undecodable bytes are dropped. Order by name where order matters."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    # bytes that aren't UTF-8 become the replacement character first
    text = F.replace(F.make_valid_utf8("value"), F.lit(chr(0xFFFD)), F.lit(""))
    return rows.select(F.col("_metadata.file_name").alias("name"), text.alias("text"))


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; types are inferred where no schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header. With ``bom`` every part begins with a byte order mark, as the first column's name carries it."""
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, BOM + first)
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one array of objects."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A line for each row; characters beyond ASCII stay as they are."""
    df.write.mode("overwrite").json(path)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's image rows; files that aren't images are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(folder)


def studies(spark: SparkSession, folder: str, pattern: str = "*.dcm") -> DataFrame:
    """name, path, content of one file for each study, the parent folder's parent; of several the last by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    rows = rows.withColumn("study", F.element_at(F.split("path", "/"), -3))
    last = F.row_number().over(Window.partitionBy("study").orderBy(F.desc("path")))
    return rows.withColumn("r", last).where("r = 1").select(F.concat("study", F.lit("_study.png")).alias("name"), "path", "content")


def field_or(*options: Column) -> Column:
    """First that isn't null; an empty string counts."""
    return F.coalesce(*options)
