"""Report sinks and content-addressed bundles."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernweave.operators.relational import inventory_diff
from fernweave.sources.shared import scratch

__all__ = ["scratch"]

# Roles of bundle files by name, then by ending; those that must be there.
ROLES = {"report.json": "report_json", "report.csv": "report_csv", "build-provenance.json": "build_provenance"}
ENDINGS = {".html": "blind_html", ".gif": "blind_asset"}
REQUIRED = ["report_json", "report_csv", "build_provenance", "blind_html"]
OWN_MANIFEST = "bundle-manifest.json"


def write_csv_report(runs: DataFrame, sources: DataFrame, profiles: DataFrame, path: str) -> None:
    """One line for each run with the columns of its source and profile; missing ones are empty.
    Written in parts, each with a header, as a directory that the committer makes whole."""
    dims = lambda d, key: d.select(F.col(key), *[F.col(c).alias(f"{key.removesuffix('_id')}_{c}") for c in d.columns if c != key])
    wide = runs.join(dims(sources, "fixture_id"), "fixture_id", "left").join(dims(profiles, "profile_id"), "profile_id", "left")
    wide.write.option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines; the directory appears whole or has no _SUCCESS."""
    report.write.option("ignoreNullFields", False).json(path)


def bundle_role(name: Column) -> Column:
    """The role of a file in a bundle by its relative path."""
    out = F.lit("artifact")
    for ending, role in ENDINGS.items():
        out = F.when(name.endswith(ending), role).otherwise(out)
    for own, role in ROLES.items():
        out = F.when(name == own, role).otherwise(out)
    return out


def bundle_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Role, relative path, bytes and SHA-256 of every file below a folder but its own manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), f"^{root}/", "")
    return files.select(name.alias("relative_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(F.col("relative_path") != OWN_MANIFEST).select(bundle_role(F.col("relative_path")).alias("role"), "*")


def bundle_violations(listed: DataFrame, found: DataFrame) -> DataFrame:
    """relative_path and difference: missing, unexpected, duplicate or changed files, and
    required roles that no listed file has (the role stands for the path)."""
    wrong = inventory_diff(listed, found, ["relative_path"], ["bytes", "sha256"])
    due = listed.sparkSession.createDataFrame([(r,) for r in REQUIRED], "role string")
    absent = due.join(listed.select("role").distinct(), "role", "left_anti").select(F.col("role").alias("relative_path"), F.lit("missing role").alias("difference"))
    return wrong.union(absent)
