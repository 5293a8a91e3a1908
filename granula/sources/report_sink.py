"""Reports written by their tasks: df.write.format("granula_report").mode(...).save(folder).

Each task writes one Parquet file with the footer keys and the text of the fields, below a
folder of the job in ``_temporary``. When all have ended the driver moves the files into place
and writes _SUCCESS last; overwritten files go after that. A job that fails leaves nothing
that a reader sees; its folder is removed while its last tasks end.
Nothing is gathered in one task and nothing is rewritten.

Options: ``footer`` and ``columns`` are JSON objects of texts (footer keys; descriptions by
column). The folder lies on a file system that pyarrow and all executors reach.

Defined results: partitions without rows write no file; a report without rows is refused and
leaves the folder as it was; without overwriting, files are added to those that are there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PREFIX = "granula."
#: Times that the folder of a failed job is looked at again.
SETTLE = 10


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path on it; a path without a scheme is local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    rows: int


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, footer: dict[str, str], columns: dict[str, str], overwrite: bool):
        self.path, self.footer, self.columns, self.overwrite = path.rstrip("/"), footer, columns, overwrite
        self.job = uuid.uuid4().hex
        self.at = f"_temporary/{self.job}"

    def _schema(self, schema: pa.Schema) -> pa.Schema:
        fields = [f.with_metadata({"description": self.columns[f.name]}) if f.name in self.columns else f for f in schema]
        return pa.schema(fields, metadata={**(schema.metadata or {}), **{(PREFIX + k).encode(): str(v).encode() for k, v in self.footer.items()}})

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, path = located(self.path)
        task = TaskContext.get()
        name, rows, writer = f"part-{task.partitionId():05d}-{self.job}-{task.attemptNumber()}.parquet", 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    fs.create_dir(f"{path}/{self.at}", recursive=True)
                    schema = self._schema(batch.schema)
                    writer = pq.ParquetWriter(f"{path}/{self.at}/{name}", schema, filesystem=fs, compression="zstd")
                writer.write_batch(batch.cast(schema))
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Part(name if rows else None, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = located(self.path)
        parts = [m for m in messages if m is not None and m.name]
        if not parts:
            self.abort(messages)
            raise ValueError("the report is empty")
        old = [f.path for f in fs.get_file_info(pa.fs.FileSelector(path)) if f.type == pa.fs.FileType.File] if self.overwrite else []
        for m in parts:
            fs.move(f"{path}/{self.at}/{m.name}", f"{path}/{m.name}")
        with fs.open_output_stream(f"{path}/_SUCCESS") as done:
            done.write(b"")
        for f in old:
            if not f.endswith("/_SUCCESS"):
                fs.delete_file(f)
        self._clear(fs, path)

    def abort(self, messages: list[Part | None]) -> None:
        for _ in range(SETTLE):  # tasks that are being stopped may still make a file
            self._clear(*located(self.path))
            time.sleep(0.2)

    def _clear(self, fs: pa.fs.FileSystem, path: str) -> None:
        for folder in (f"{path}/{self.at}", f"{path}/_temporary", path):  # the last two if nothing else is in them
            found = fs.get_file_info(folder)
            if found.type == pa.fs.FileType.Directory and (folder.endswith(self.job) or not fs.get_file_info(pa.fs.FileSelector(folder))):
                fs.delete_dir(folder)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "granula_report"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if "path" not in self.options:
            raise ValueError("say where to save the report")
        columns = json.loads(self.options.get("columns", "{}"))
        footer = {"created_at": datetime.now(timezone.utc).isoformat(), "columns": json.dumps(columns)} | json.loads(self.options.get("footer", "{}"))
        return ReportWriter(self.options["path"], footer, columns, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReportSink)


def write_report(df, path: str, descriptions: dict[str, str] | None = None, noun: str = "object", **provenance: str) -> str:
    """Narrow and write ``df`` as a folder of files at ``path``; the counterpart of reports.write_report without a single file."""
    from granula.functions import scalar
    from granula.sources.reports import with_noun

    register(df.sparkSession)
    text = {k: with_noun(v, noun) for k, v in (descriptions or {}).items()}
    scalar.narrowed(df).write.format("granula_report").mode("overwrite").option("footer", json.dumps(provenance)).option("columns", json.dumps(text)).save(path)
    return path


def read_footer(path: str) -> dict[str, str]:
    """Footer keys of a report folder, from its first file."""
    fs, at = located(path)
    files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.path.endswith(".parquet"))
    meta = pq.read_schema(files[0], filesystem=fs).metadata or {}
    return {k.decode()[len(PREFIX) :]: v.decode() for k, v in meta.items() if k.decode().startswith(PREFIX)}
