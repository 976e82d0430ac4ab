"""File sources: trees of files, archives, paged JSON landings."""

from __future__ import annotations

import io
import json
import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = "archive string, path string, content binary, problem string"


class Unsafe(ValueError):
    """An archive that must not be unpacked."""


def members(data: bytes, *, max_files: int = 50_000, max_total: int = 1 << 30, max_file: int = 5 << 20) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the regular files in a tar archive, its top folder dropped. Links, folders and files over max_file are
    passed over; absolute paths, '..', special files and archives over the limits raise Unsafe."""
    count = total = 0
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
        for m in tar:
            parts = m.name.split("/")
            if m.name.startswith("/") or ".." in parts:
                raise Unsafe(f"path {m.name}")
            if m.isdir() or m.issym() or m.islnk():
                continue
            if not m.isfile():
                raise Unsafe(f"special file {m.name}")
            if m.size > max_file or len(parts) < 2:
                continue
            count, total = count + 1, total + m.size
            if count > max_files or total > max_total:
                raise Unsafe("archive over its limits")
            yield "/".join(parts[1:]), tar.extractfile(m).read()


def _unpack(limits: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
        names = ["archive", "path", "content", "problem"]
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                try:
                    rows = [(name, p, c, None) for p, c in members(data or b"", **limits)]
                except (Unsafe, tarfile.TarError, EOFError) as e:
                    rows = [(name, None, None, str(e) or type(e).__name__)]
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 500]), kinds)], names=names)
    return run


def unpack(archives: DataFrame, *, name: str = "path", data: str = "content", **limits: int) -> DataFrame:
    """Files (FILES) of tar archives; an unsafe or broken one gives one row with the problem and no file."""
    return archives.select(F.col(name).alias("archive"), F.col(data).alias("content")).mapInArrow(_unpack(limits), FILES)


def tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, length) of the files below root, paths relative to it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = "file:" + root.rstrip("/") + "/" if "://" not in root and not root.startswith("file:") else root.rstrip("/") + "/"
    return f.select(F.expr(f"substring(path, {len(base) + 1})").alias("path"), "content", "length")


class PagedJson(DataSource):
    """spark.read.format('paged_json').option('path', folder).schema(...): pages of JSON arrays, one file a page, in order of name. Reading
    ends after the first page that is shorter than `per_page`, or at `most` rows, as a paged service would end it."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "filename string, status string, additions int, deletions int, patch string, previous_filename string, sha string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options, [f.name for f in schema.fields])


class _Pages(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.folder, self.names = options["path"], names
        self.per_page, self.most = int(options.get("per_page", 100)), int(options.get("most", 3000))

    def partitions(self) -> list[InputPartition]:
        # pages are looked at once, in order, up to the one that ends them: no more than `most` rows
        out, first = [], 0
        for page in sorted(x for x in os.listdir(self.folder) if x.endswith(".json")):
            if first >= self.most:
                break
            out.append(InputPartition((page, first)))
            with open(os.path.join(self.folder, page)) as f:
                if len(json.load(f)) < self.per_page:
                    break
            first += self.per_page
        return out or [InputPartition((None, 0))]

    def read(self, partition: InputPartition):
        page, first = partition.value
        if page is None:
            return
        with open(os.path.join(self.folder, page)) as f:
            for k, row in enumerate(json.load(f)):
                if first + k < self.most:
                    yield tuple(row.get(n) for n in self.names)


def analyzer_findings(reports: DataFrame, *, tool: str = "tool", report: str = "report") -> DataFrame:
    """(tool, rule, path, line, severity, message) out of the JSON reports of three analyzers; broken reports give no rows."""
    r = reports.select(F.col(tool).alias("tool"), F.col(report).alias("report"))
    flat = F.from_json("report", "array<struct<code:string,filename:string,message:string,location:struct<row:int>>>")
    nested = F.from_json("report", "struct<results:array<struct<test_id:string,filename:string,line_number:int,issue_severity:string,issue_confidence:string,issue_text:string,"
                                   "check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string>>>>")
    a = r.filter("tool = 'ruff'").select("tool", F.explode(flat).alias("x")).select(
        "tool", F.col("x.code").alias("rule"), F.col("x.filename").alias("path"), F.col("x.location.row").alias("line"), F.lit("low").alias("severity"), F.col("x.message").alias("message"))
    n = r.filter("tool in ('bandit', 'semgrep')").select("tool", F.explode(nested["results"]).alias("x"))
    b = n.filter("tool = 'bandit' and not (x.issue_severity = 'LOW' and x.issue_confidence = 'LOW')").select(
        "tool", F.col("x.test_id").alias("rule"), F.col("x.filename").alias("path"), F.col("x.line_number").alias("line"), F.lower("x.issue_severity").alias("severity"), F.col("x.issue_text").alias("message"))
    level = F.when(F.col("x.extra.severity") == "ERROR", "high").when(F.col("x.extra.severity") == "WARNING", "medium").otherwise("low")
    s = n.filter("tool = 'semgrep'").select("tool", F.substring_index("x.check_id", ".", -1).alias("rule"), F.col("x.path").alias("path"), F.col("x.start.line").alias("line"), level.alias("severity"), F.col("x.extra.message").alias("message"))
    return a.unionByName(b).unionByName(s).withColumn("path", F.regexp_replace("path", r"^\./", "")).filter("path is not null and line is not null")
