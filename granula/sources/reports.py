"""Reports on disk: one Parquet file with descriptions on its fields and provenance in its footer."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from granula.functions import scalar, settings
from granula.operators import report
from granula.sources import report_sink

PREFIX = "granula."


def write_report(df: DataFrame, path: str, descriptions: dict[str, str] | None = None, noun: str = "object", **provenance: str) -> str:
    """Narrow, write and describe ``df`` at ``path`` (``.parquet`` is forced); an empty report is refused.

    The report is the final, aggregated table and comes out as one file; Spark keeps only its
    own footer keys, so the file is streamed once more, row group by row group, to add ours.
    """
    if df.isEmpty():
        raise ValueError("the report is empty")
    path = path if path.endswith(".parquet") else path + ".parquet"
    parts = path + ".parts"
    scalar.narrowed(df).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(parts)
    from pyspark.sql import SparkSession as S

    fs_path = S.active()._jvm.org.apache.hadoop.fs.Path(parts)
    fs = fs_path.getFileSystem(S.active()._jsc.hadoopConfiguration())
    found = [str(s.getPath().toUri().getPath()) for s in fs.listStatus(fs_path) if s.getPath().getName().endswith(".parquet")]
    text = {k: with_noun(v, noun) for k, v in (descriptions or {}).items()}
    footer = {"created_at": datetime.now(timezone.utc).isoformat(), "columns": json.dumps(text), **provenance}
    _rewritten(found[0], path, footer, text)
    fs.delete(fs_path, True)
    return path


def with_noun(text: str, noun: str) -> str:
    """``object`` and ``objects`` as whole words replaced by the run's noun."""
    return re.sub(r"\bobject\b", noun.split("/")[0], re.sub(r"\bobjects\b", scalar.plural(noun), text))


def recolour(spark: SparkSession, path: str, palette: dict[str, str]) -> int:
    """Replace the colours of a report's structures and return how many rows have one; the footer stays."""
    import os

    found = pq.read_schema(path)
    columns = {f.name: f.metadata[b"description"].decode() for f in found if f.metadata and b"description" in f.metadata}
    rows = report.recoloured(spark.read.parquet(path), palette)
    n = rows.where("entity_colour is not null").count()
    footer = {k: v for k, v in read_footer(path).items() if k not in ("columns", "created_at")}
    write_report(rows, path + ".writing.parquet", columns, **footer)
    os.replace(path + ".writing.parquet", path)
    return n


def _rewritten(source: str, target: str, footer: dict[str, str], text: dict[str, str]) -> None:
    reader = pq.ParquetFile(source)
    old = reader.schema_arrow
    old = pa.schema([f.with_type(pa.timestamp("us", f.type.tz)) if pa.types.is_timestamp(f.type) else f for f in old], metadata=old.metadata)
    fields = [f.with_metadata({**(f.metadata or {}), "description": text[f.name]}) if f.name in text else f for f in old]
    meta = {**(old.metadata or {}), **{(PREFIX + k).encode(): v.encode() for k, v in footer.items()}}
    schema = pa.schema(fields, metadata=meta)
    with pq.ParquetWriter(target, schema, compression="zstd") as writer:
        for k in range(reader.num_row_groups):
            writer.write_table(reader.read_row_group(k).cast(schema))


def read_footer(path: str) -> dict[str, str]:
    if path.endswith("/"):
        return report_sink.read_footer(path)
    meta = pq.read_schema(path).metadata or {}
    return {k.decode()[len(PREFIX) :]: v.decode() for k, v in meta.items() if k.decode().startswith(PREFIX)}


def read_report(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Rows and footer keys; if ``strict``, a table that is no report is an error with the reason."""
    rows = spark.read.parquet(path)
    if strict:
        settings.readable(rows.columns)
    return rows, read_footer(path)


def describe(path: str, text: str) -> None:
    """Set the description in the footer; rows stay as they are."""
    import os

    schema = pq.read_schema(path)
    columns = {f.name: f.metadata[b"description"].decode() for f in schema if f.metadata and b"description" in f.metadata}
    _rewritten(path, path + ".writing", {**read_footer(path), "description": text}, columns)
    os.replace(path + ".writing", path)
