"""A report sink of two phases: tasks write side files, the commit names them in a report.

`df.write.format("committed_report").save(folder)`, after `register(spark)`. Each task writes
its rows as JSON lines below `folder/.staged-<id of the write>`; the commit moves the files that
the committed attempts name into `folder/side-<id>` and writes `report.json` last, by a rename.
So a report only ever names whole files, and a write that fails leaves no report and no side
file. The report holds one entry a task (name, rows, bytes, SHA-256); nothing else passes the
driver. Writes to one folder follow one another: an append keeps the entries of the report that
was there, an overwrite drops them and their files. Two writers at once are not guarded against.
In a store without folders an attempt that outlives an abort can leave a staged file; no report
names it, and the next commit takes it away.
"""

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, REPORT = "committed_report", "report.json"
_ENTRY = "name string, rows long, bytes long, sha256 string"


@dataclass
class SideFile(WriterCommitMessage):
    """What a task wrote; no name for a task without rows."""

    name: str | None
    rows: int
    bytes: int
    sha256: str


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.id = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> SideFile:
        """One file an attempt: attempts of one task never share a name."""
        store, base = _store(self.folder)
        staged, name = f"{base}/.staged-{self.id}", f"{uuid.uuid4().hex}.jsonl"
        digest, rows, size, out = hashlib.sha256(), 0, 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    out = store.open_output_stream(f"{staged}/{name}")
                data = "".join(json.dumps(r, ensure_ascii=False, separators=(",", ":"), default=str) + "\n" for r in batch.to_pylist()).encode()
                digest.update(data)
                out.write(data)
                rows, size = rows + batch.num_rows, size + len(data)
        finally:
            if out is not None:
                out.close()
        return SideFile(name if rows else None, rows, size, digest.hexdigest())

    def commit(self, messages: list[SideFile | None]) -> None:
        store, base = _store(self.folder)
        done = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.name)
        side, staged, report = f"side-{self.id}", f"{base}/.staged-{self.id}", f"{base}/{REPORT}"
        before = json.loads(store.open_input_stream(report).read())["files"] if _exists(store, report) else []
        store.create_dir(f"{base}/{side}" if done else base, recursive=True)
        for m in done:
            store.move(f"{staged}/{m.name}", f"{base}/{side}/{m.name}")
        files = [] if self.overwrite else before
        files = files + [{"name": f"{side}/{m.name}", "rows": m.rows, "bytes": m.bytes, "sha256": m.sha256} for m in done]
        with store.open_output_stream(f"{report}.{self.id}") as out:
            out.write(json.dumps({"rows": sum(f["rows"] for f in files), "files": files}).encode())
        store.move(f"{report}.{self.id}", report)
        for entry in store.get_file_info(fs.FileSelector(base)):
            if entry.base_name.startswith(".staged-"):
                self._clear(store, entry.path)
        if self.overwrite:
            for old in {f["name"].split("/")[0] for f in before}:
                self._clear(store, f"{base}/{old}")

    def abort(self, messages: list[SideFile | None]) -> None:
        store, base = _store(self.folder)
        for path in (f"{base}/.staged-{self.id}", f"{base}/side-{self.id}"):
            self._clear(store, path)
        if _exists(store, part := f"{base}/{REPORT}.{self.id}"):
            store.delete_file(part)

    @staticmethod
    def _clear(store: fs.FileSystem, path: str) -> None:
        """An attempt that is still being stopped can add a file while its folder goes."""
        for last in (False, False, True):
            try:
                if _exists(store, path):
                    store.delete_dir(path)
                return
            except OSError:
                if last:
                    raise


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        """Made at the driver, with the folder for staged files: an attempt that outlives an
        abort finds no folder to write to."""
        writer = ReportWriter(self.options["path"], overwrite)
        store, base = _store(writer.folder)
        store.create_dir(f"{base}/.staged-{writer.id}", recursive=True)
        return writer


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReportSink)


def write_committed(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    """df as side files and a report that names them; nothing is seen before the report is."""
    register(df.sparkSession)
    df.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(folder)


def committed_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, rows, bytes and sha256 of the side files that the folder's report names."""
    report = spark.read.schema(f"rows long, files array<struct<{', '.join(c.replace(' ', ': ') for c in _ENTRY.split(', '))}>>")
    found = report.option("multiLine", True).option("mode", "FAILFAST").json(f"{folder.rstrip('/')}/{REPORT}")
    return found.select(F.explode("files").alias("f")).select("f.*")


def read_committed(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The rows of the side files that the report names, no others that lie beside them. The
    names, one for each task of the writes, are listed at the driver, as any reader lists files."""
    names = [r.name for r in committed_files(spark, folder).select("name").collect()]
    rows = spark.read.schema(schema).option("mode", "FAILFAST")
    return rows.json([f"{folder.rstrip('/')}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def damaged_files(spark: SparkSession, folder: str) -> DataFrame:
    """name and difference of side files that are missing or not what the report says."""
    listed = committed_files(spark, folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder)
    there = found.select(F.regexp_extract("path", "(side-[0-9a-f]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("_sha256"))
    both = listed.join(there, "name", "left").withColumn("difference", F.when(F.col("_sha256").isNull(), "missing").when(F.col("_sha256") != F.col("sha256"), "changed"))
    return both.where("difference is not null").select("name", "difference")
