"""Sinks (K-1, K-4..K-14, A-10, A-19): snapshots with numbered pointers written last, JSONL and Parquet exports, verified archives."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Names of the pointers that were written whole, oldest first; refuses a root that holds snapshots but none of them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = path(root).getFileSystem(conf)
    if not fs.exists(path(root)):
        return []
    held = [s.getPath().getName() for s in fs.listStatus(path(root))]
    at = path(root, "_pointers")
    whole = sorted(s.getPath().getName() for s in fs.listStatus(at) if fs.exists(path(s.getPath(), "_SUCCESS"))) if fs.exists(at) else []
    if not whole and any(n.startswith("snapshot=") for n in held) and "_pointers" in held and fs.listStatus(at):
        raise RuntimeError(f"{root} holds snapshots, but no pointer was written whole")
    return whole


def write_snapshot(tables: dict[str, DataFrame], root: str) -> str:
    """K-1: every table under a new snapshot, then a new pointer; nothing is overwritten, so a failure at any moment leaves the last valid set in place."""
    spark = next(iter(tables.values())).sparkSession
    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/snapshot={name}/{table}")
    told = _pointers(spark, root)
    number = int(told[-1].split("-")[0]) + 1 if told else 1
    _write_text(spark, f"{root}/_pointers/{number:012d}-{name}", json.dumps({"snapshot": name, "tables": sorted(tables)}))
    return name


def has_snapshot(spark: SparkSession, root: str) -> bool:
    return bool(_pointers(spark, root))


def read_snapshot(spark: SparkSession, root: str, table: str) -> DataFrame:
    now = json.loads(spark.read.text(f"{root}/_pointers/{_pointers(spark, root)[-1]}").first()[0])["snapshot"]
    return spark.read.parquet(f"{root}/snapshot={now}/{table}")


#: tables that the engine keeps, with the key they are read in order of
RECORDS = {"suppliers": "supplier_id", "invoices": "invoice_id", "entities": "entity_id"}


def records(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A-19: a table of the active snapshot in order of its key; other names than the engine's own are refused."""
    if table not in RECORDS:
        raise ValueError(f"no table {table!r}")
    return read_snapshot(spark, root, table).orderBy(RECORDS[table])


def export_jsonl(tables: dict[str, DataFrame], path: str) -> None:
    """K-6: rows of several tables as JSON lines that name their table."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.to_json(F.struct(F.lit(name).alias("table"), *df.columns)).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    out.write.mode("errorifexists").text(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """K-12: a JSON artifact, written under another name beside its place and moved there whole; an old one is replaced."""
    jvm = spark.sparkContext._jvm
    at, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
    finally:
        out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(tmp, at):
        raise RuntimeError(f"{path} was not put in place")


def read_json(spark: SparkSession, path: str) -> dict:
    """A-22: a JSON artifact."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def export_labels(rows: DataFrame, path: str, form: str = "jsonl") -> int:
    """K-5, K-7: labels as JSON lines or Parquet; the job's commit puts all files in place, a path in use is refused."""
    if form not in ("jsonl", "parquet"):
        raise ValueError("form must be jsonl or parquet")
    writer = rows.write.mode("errorifexists")
    writer.json(path) if form == "jsonl" else writer.parquet(path)
    spark = rows.sparkSession
    return (spark.read.schema(rows.schema).json(path) if form == "jsonl" else spark.read.parquet(path)).count()


def _content_mark(df: DataFrame) -> dict:
    """Rows and a digest sum that doesn't depend on their order or files."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return {"rows": row.n, "columns": df.columns, "digest": str(row.h or 0)}


class PreparedRefused(ValueError):
    """A prepared dataset that isn't what its manifest says."""


def write_prepared(tables: dict[str, DataFrame], root: str, mappings: dict[str, dict]) -> dict:
    """K-10, K-11: every canonical table as CSV with its mapping, and the manifest last, so a torn directory never validates."""
    spark, manifest = next(iter(tables.values())).sparkSession, {"version": "prepared-v1", "mappings": mappings, "tables": {}}
    for name, df in tables.items():
        text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
        text.write.mode("errorifexists").csv(f"{root}/{name}", header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        manifest["tables"][name] = _content_mark(_read_prepared(spark, f"{root}/{name}", df.columns))
        if manifest["tables"][name] != _content_mark(text):
            raise PreparedRefused(f"{name} was not written as it is")
    write_json(spark, f"{root}/manifest.json", manifest)
    return manifest


def _read_prepared(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).fillna("")


def read_prepared(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """A-10: the tables of a prepared directory, each checked against its manifest; changed ones are refused."""
    manifest = read_json(spark, f"{root}/manifest.json")
    if manifest.get("version") != "prepared-v1":
        raise PreparedRefused("unknown manifest")
    out = {}
    for name, mark in manifest["tables"].items():
        out[name] = _read_prepared(spark, f"{root}/{name}", mark["columns"])
        if _content_mark(out[name]) != mark:
            raise PreparedRefused(f"{name} changed after it was prepared")
    return out


def archive_then_compact(df: DataFrame, old, archive: str, keep: str) -> int:
    """K-13: old rows are archived and the copy verified before the rest is written; returns how many went."""
    gone, rest = df.where(old), df.where(~old)
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)"))).first())
    gone.write.mode("errorifexists").parquet(archive)
    if mark(df.sparkSession.read.parquet(archive)) != (seen := mark(gone)):
        raise RuntimeError("archive differs from its source")
    rest.write.mode("errorifexists").parquet(keep)
    return seen[0]


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K-4: the old table with the new rows in place of those with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def escape_markdown(text: str) -> str:
    """S-25."""
    import html
    import re

    return re.sub(r"([\\`*_{}\[\]()#+.!|-])", r"\\\1", html.escape(text))


def report(title: str, rows: DataFrame, limit: int = 200) -> str:
    """K-8, K-9: a Markdown table of a bounded report."""
    lines = [f"# {escape_markdown(title)}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(escape_markdown(str(v)) for v in r) + " |" for r in rows.limit(limit).collect()]) + "\n"
