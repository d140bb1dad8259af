"""JSON documents as tables: typed reads, snapshots with their hashes, arrays as rows."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_typed(spark: SparkSession, path: str, schema: T.StructType | str, many: bool = True) -> DataFrame:
    """JSON with a fixed schema; a malformed file fails the read. many: one object a line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not many).json(path)


def read_snapshots(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row a file: path, sha256 and bytes of its content, and the document parsed from that
    same content; null where it is not such a document."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.from_json(text, schema).alias("document"))


def rows_of(df: DataFrame, array: str, keep: list[str] | None = None) -> DataFrame:
    """A row for each element of an array of structs, its fields as columns; empty ones give none."""
    return df.select(*(keep or []), F.explode(array).alias("_row")).select(*(keep or []), "_row.*")


def manifest_violations(fixtures: DataFrame, minima: dict[str, int]) -> DataFrame:
    """What a corpus manifest breaks: name and detail. fixtures: id, category. Ids are unique
    and plain, and each category has its least number of fixtures."""
    repeated = fixtures.groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("name"), F.col("id").alias("detail"))
    odd = fixtures.where(~F.coalesce(F.col("id").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))).select(F.lit("bad id").alias("name"), F.col("id").alias("detail"))
    least = fixtures.sparkSession.createDataFrame(list(minima.items()), "category string, least int")
    short = least.join(fixtures.groupBy("category").count(), "category", "left").where("coalesce(count, 0) < least").select(F.lit("too few").alias("name"), F.col("category").alias("detail"))
    return repeated.union(odd).union(short)
