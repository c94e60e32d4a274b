"""Scans (A-1, A-3..A-7, A-9, A-11..A-17, A-22): strict and sniffed delimited text, JSON pages, JSON lines, benchmark pairs, published payments."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V
from ..operators.benchmark import representatives
from ..operators.profile import normalize_header

SUPPLIER_FIELDS = ("supplier_id", "name", "country", "registration_id", "tax_id", "postcode")
SUPPLIER_OPTIONAL = ("address", "aliases", "lei", "parent_lei", "bank_account_hash")
SPEND_FIELDS = ("invoice_id", "supplier_id", "invoice_date", "amount", "currency", "category", "description")


#: fixed values: kinds of other names that name the same entity
OTHER_NAMES = ("PREVIOUS_LEGAL_NAME", "ALTERNATIVE_LEGAL_NAME")
#: bytes of a source that is loaded on the driver, and of one line of published awards
MAX_SOURCE_BYTES, MAX_LINE_BYTES = 20_000_000, 5_000_000
#: characters of an observed name, address or postcode
MAX_FIELD = 1000


class SourceRefused(ValueError):
    """A source that can't be read without guessing or losing rows."""


def load_bytes(source: bytes | str | Path, most: int = MAX_SOURCE_BYTES) -> bytes:
    """A-9: a small source given as bytes, as a path or as its text (any string of several lines, or that names no file).

    A driver-side loader for interactive uploads; tables are read by Spark. More than ``most`` bytes are refused.
    """
    if isinstance(source, str):
        named = "\n" not in source and len(source) < 4096 and Path(source).is_file()
        source = Path(source) if named else source.encode()
    if isinstance(source, Path):
        if source.stat().st_size > most:
            raise SourceRefused(f"{source} holds more than {most} bytes")
        source = source.read_bytes()
    if not isinstance(source, bytes | bytearray):
        raise SourceRefused("give a path, text or bytes")
    if len(source) > most:
        raise SourceRefused(f"more than {most} bytes")
    return bytes(source)


def decode(data: bytes) -> tuple[str, str]:
    """A-4: text and the encoding that fits, tried in a fixed order."""
    for name in ("utf-8-sig", "utf-8", "cp1252", "latin-1"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    raise SourceRefused("undecodable")


def _whole(head: bytes) -> bool:
    """Is the head of a file UTF-8 but for a character it may cut at its end."""
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start >= len(head) - 3 and len(head) == 1 << 16
    return True


def sniff_delimiter(text: str) -> str:
    """A-5: the sign whose most common count a line, times how often it occurs, is largest over 50 lines."""
    lines = [x for x in text.splitlines() if x.strip()][:50]

    def worth(sign: str) -> float:
        (count, lines_of), *_ = Counter(x.count(sign) for x in lines).most_common(1) or [(0, 0)]
        return count * lines_of / max(1, len(lines))

    return max((",", ";", "\t", "|"), key=worth)


def find_header_row(rows: list[list[str]]) -> int:
    """A-6, E-11: the first of twenty rows that is as wide as rows mostly are, with filled, distinct cells of which at
    most a third are numbers; the first row if there is none. A row is as wide as it has filled cells."""
    widths = Counter(sum(bool(c.strip()) for c in r) or len(r) for r in rows)
    often = max(widths.values(), default=0)
    width = max((w for w, n in widths.items() if n == often), default=0)
    for i, r in enumerate(rows[:20]):
        cells = [c.strip() for c in r[:width]]
        plain = {normalize_header(c) for c in cells}
        numbers = sum(re.fullmatch(r"-?[\d.,]+", c) is not None for c in cells)
        if len(r) >= max(width, 2) and all(cells) and len(plain) == width and numbers <= width // 3:
            return i
    return 0


def read_canonical(spark: SparkSession, path: str, fields: tuple[str, ...] = SUPPLIER_FIELDS, optional: tuple[str, ...] = SUPPLIER_OPTIONAL) -> DataFrame:
    """A-1, A-7, P-1: strict CSV with the exact header set, physical line numbers and originals.

    Whole files are the unit of work, as quoted fields may span lines; ragged rows fail the scan.
    """
    named = [*fields, *optional]

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for source, content in zip(part["path"], part["content"], strict=True):
                text, _ = decode(bytes(content))
                reader = csv.reader(io.StringIO(text, newline=""), strict=True)
                head = [h.strip() for h in next(reader, [])]
                if len(set(head)) != len(head) or not set(fields) <= set(head) or not set(head) <= set(named):
                    raise SourceRefused(f"{source}: header {head}")
                rows, line = [], reader.line_num + 1
                for r in reader:
                    if r and any(c.strip() for c in r):
                        if len(r) != len(head):
                            raise SourceRefused(f"{source}:{line}: {len(r)} cells")
                        got = dict(zip(head, r, strict=True))
                        rows.append({**{f: got.get(f, "").strip() for f in named}, "_source": source, "_line": line, "_original": got})
                    line = reader.line_num + 1
                yield pd.DataFrame(rows, columns=[*named, "_source", "_line", "_original"])

    schema = ", ".join(f"{f} string" for f in named) + ", _source string, _line int, _original map<string,string>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A-3: a delimited source of unknown encoding, delimiter and banner rows; all columns are strings.

    Delimiter and header are sniffed on the driver from the head of one file; every file's encoding is told from all of
    it. A row is left out if all its cells are those of the header or of a row above it.
    """
    head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16)).first()[0])
    text = head.decode("utf-8-sig", "ignore") if _whole(head) else decode(head)[0]
    sign = sniff_delimiter(text)
    rows = list(csv.reader(io.StringIO(text), delimiter=sign))[:50]
    skip = find_header_row(rows)
    names = [c.strip() for c in rows[skip]] if rows else []
    if not names or not all(names) or len({normalize_header(c) for c in names}) < len(names):
        raise SourceRefused(f"header {names}")
    schema = ", ".join(f"`{c}` string" for c in names) + ", _corrupt string"
    files = spark.read.format("binaryFile").load(path)
    if files.where(~F.is_valid_utf8(F.col("content").cast("string"))).isEmpty():
        df = spark.read.schema(schema).csv(path, sep=sign, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE")
    else:
        df = _decoded(spark, path, sign, schema, len(names))
    told = F.array(*[F.coalesce(F.trim(F.regexp_replace(f"`{c}`", "^\ufeff", "")), F.lit("")) for c in names])
    above = [[c.strip().lstrip("\ufeff") for c in (*r, *[""] * len(names))][: len(names)] for r in rows[: skip + 1]]
    body = df.where(~F.coalesce(told.isin(*[F.array(*map(F.lit, r)) for r in above]), F.lit(False)))
    if bad := body.where("_corrupt is not null").limit(1).collect():
        raise SourceRefused(f"ragged row: {bad[0]['_corrupt'][:80]}")
    return body.drop("_corrupt")


def _decoded(spark: SparkSession, path: str, sign: str, schema: str, width: int) -> DataFrame:
    """Rows of files in an encoding Spark's reader doesn't take; whole files are the unit of work."""

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for content in part["content"]:
                rows = [r for r in csv.reader(io.StringIO(decode(bytes(content))[0]), delimiter=sign) if r]
                yield pd.DataFrame([(r + [None] * width)[:width] + [None if len(r) == width else sign.join(r)] for r in rows])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def _award_suppliers(spark: SparkSession, path: str) -> DataFrame:
    """Suppliers of active awards with the ``status`` of their observation. Processes without an id of their own, lines
    that aren't JSON and lines over MAX_LINE_BYTES refuse the source."""
    lines = spark.read.text(path)
    doc = F.from_json("value", "ocid string, awards array<struct<status:string,suppliers:array<struct<id:string>>>>, parties array<string>")
    rows = lines.select(F.octet_length("value").alias("bytes"), doc.alias("d")).select("bytes", "d.*")
    told = rows.groupBy("ocid").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    if not told.where(F.expr("ocid is null or ocid = '' or n > 1") | (F.col("bytes") > MAX_LINE_BYTES)).isEmpty():
        raise SourceRefused(f"{path}: every line is one process with an id of its own, of at most {MAX_LINE_BYTES} bytes")
    awarded = rows.select("ocid", F.explode("awards").alias("a")).where("a.status = 'active'").select("ocid", F.explode("a.suppliers.id").alias("party_id")).distinct()
    shape = "id string, name string, roles array<string>, identifier struct<scheme:string,id:string>, address struct<streetAddress:string,locality:string,region:string,postalCode:string>"
    parties = rows.select("ocid", F.explode("parties").alias("raw")).withColumn("p", F.from_json("raw", shape))
    one = parties.groupBy("ocid", F.col("p.id").alias("party_id")).agg(F.min("raw").alias("a"), F.max("raw").alias("b"), F.min_by("p", "raw").alias("p"))
    met = awarded.join(one, ["ocid", "party_id"], "left")
    company, name = F.upper(F.trim(F.coalesce("p.identifier.id", F.lit("")))), F.trim(F.coalesce("p.name", F.lit("")))
    address = F.concat_ws(" ", *[F.coalesce(f"p.address.{c}", F.lit("")) for c in ("streetAddress", "locality", "region")])
    seen = met.select("ocid", "party_id", company.alias("company_id"), name.alias("name"), address.alias("address"), F.coalesce("p.address.postalCode", F.lit("")).alias("postcode"), "a", "b", "p")
    seen = seen.withColumn("name_key", S.name_key("name"))
    valid = F.col("company_id").rlike(r"^([0-9]{8}|[A-Z]{2}[0-9]{6})$") & ~F.col("company_id").rlike(r"^(.)\1*$")
    faults = (
        ("ambiguous_party", F.col("a") != F.col("b")),
        ("unjoined", ~F.coalesce(F.array_contains("p.roles", "supplier"), F.lit(False))),
        ("other_scheme", ~F.coalesce(F.col("p.identifier.scheme") == "GB-COH", F.lit(False))),
        ("invalid_id", ~valid),
        ("invalid_name", (F.col("name_key") == "") | (F.length("name") > MAX_FIELD)),
        ("oversized_address", (F.length("address") > MAX_FIELD) | (F.length("postcode") > MAX_FIELD)),
    )
    status = F.coalesce(*[F.when(test, F.lit(fault)) for fault, test in faults], F.lit("usable"))
    return seen.withColumn("status", status).drop("a", "b", "p")


def read_ocds(spark: SparkSession, path: str) -> DataFrame:
    """A-16, J-20, P-35, E-26: active awards' suppliers with a valid company number, one observation per company and
    name key: that of the smallest digest. Their country is unknown (ZZ), as a company number doesn't tell it.

    Companies to leave out whole (E-27) are those of ``benchmark.unusable_groups(rows, 'company_id', 'name_key')``.
    """
    usable = _award_suppliers(spark, path).where("status = 'usable'").drop("status")
    sid = F.substring(S.fingerprint(F.col("company_id"), F.col("name_key")), 1, 32)
    return representatives(usable, "company_id", "name_key").withColumn("supplier_id", sid).withColumn("country", F.lit("ZZ"))


def ocds_counts(spark: SparkSession, path: str) -> DataFrame:
    """A-16: awarded suppliers by what became of them."""
    return _award_suppliers(spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def read_gleif(spark: SparkSession, path: str) -> DataFrame:
    """A-15: one record per LEI and distinct name key, in order of first use: the legal name, then earlier and alternative
    ones. The record's id hides the LEI. A LEI that stands twice refuses the pages."""
    name = "struct<name:string,type:string>"
    entity = f"legalName:struct<name:string>,otherNames:array<{name}>,legalAddress:struct<addressLines:array<string>,city:string,country:string,postalCode:string>"
    pages = spark.read.schema(f"data array<struct<id:string,attributes:struct<entity:struct<{entity}>>>>").json(path, multiLine=True)
    rows = pages.select(F.explode("data").alias("d")).select(F.col("d.id").alias("lei"), "d.attributes.entity.*")
    if not rows.groupBy("lei").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or lei is null").isEmpty():
        raise SourceRefused("every LEI of the pages stands once")
    others = F.transform(F.filter(F.coalesce("otherNames", F.array().cast(f"array<{name}>")), lambda n: n["type"].isin(*OTHER_NAMES)), lambda n: n["name"])
    street = F.concat(F.coalesce("legalAddress.addressLines", F.array().cast("array<string>")), F.array(F.coalesce("legalAddress.city", F.lit(""))))
    where = F.array_join(street, " ").alias("address"), F.coalesce("legalAddress.country", F.lit("")).alias("country"), F.coalesce("legalAddress.postalCode", F.lit("")).alias("postcode")
    named = rows.select("lei", *where, F.posexplode(F.concat(F.array("legalName.name"), others)).alias("at", "name")).withColumn("key", S.name_key("name")).where("key <> ''")
    first = named.groupBy("lei", "key").agg(F.min(F.struct("at", "name", "address", "country", "postcode")).alias("r"))
    nth = F.row_number().over(Window.partitionBy("lei").orderBy("r.at")) - 1
    sid = F.concat(F.substring(F.sha2("lei", 256), 1, 24), F.lit(":"), nth.cast("string"))
    return first.select(sid.alias("supplier_id"), "lei", "r.name", "r.address", "r.country", "r.postcode")


def read_pairs_benchmark(spark: SparkSession, left: str, right: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """A-11, A-13: records of two tables and labelled pairs with ordered ends."""
    read = lambda p: spark.read.csv(p, header=True, comment="#")
    records = read(left).withColumn("side", F.lit("l")).unionByName(read(right).withColumn("side", F.lit("r")), allowMissingColumns=True)
    pairs = read(labels)
    a, b, y = pairs.columns[:3]
    return records, pairs.select(F.concat(F.lit("l:"), F.col(a)).alias("left_id"), F.concat(F.lit("r:"), F.col(b)).alias("right_id"), F.col(y).cast("int").alias("label"))


def read_grouped_truth(spark: SparkSession, sources: list[str], truth: str, groups: int, seed: str = "1729") -> tuple[DataFrame, DataFrame]:
    """A-14: records of several TSVs and their groups, for the ``groups`` truth rows of the smallest seeded hash.

    A truth row names its own entity and, comma separated, those that match it. An entity in two groups, or one that no
    source holds, is refused. Returns (records with group, positive pairs with ordered ends).
    """
    read = lambda p: spark.read.csv(p, sep="\t", header=True)
    rows = hash_sample(read(truth), "source1_entity_id", groups, seed)
    named = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    pairs = rows.select(F.col("source1_entity_id").alias("group"), F.explode(named).alias("entity_id")).distinct()
    members = rows.select(F.col("source1_entity_id").alias("group"), F.col("source1_entity_id").alias("entity_id")).union(pairs).distinct()
    if not members.groupBy("entity_id").count().where("count > 1").isEmpty():
        raise ValueError("a record belongs to several groups")
    found = None
    for path in sources:
        part = read(path).select("entity_id", *[F.coalesce(c, F.lit("")).alias(n) for c, n in (("business_name", "name"), ("business_address", "address"), ("country", "country"))], F.lit("").alias("postcode"))
        found = part if found is None else found.unionByName(part)
    if not members.join(found, "entity_id", "left_anti").isEmpty():
        raise ValueError("the sources lack records of the chosen groups")
    records = found.join(members, "entity_id").withColumnRenamed("entity_id", "supplier_id")
    ordered = pairs.where("group <> entity_id").select(F.least("group", "entity_id").alias("left_id"), F.greatest("group", "entity_id").alias("right_id"))
    return records, ordered


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A-22: JSON lines of reviewed pairs; a line that isn't such a label refuses the file."""
    schema = "evaluation_id string, config_id string, split string, similarity_score double, human_label string, entity_group_ids array<string>, _bad string"
    rows = spark.read.schema(schema).json(path, columnNameOfCorruptRecord="_bad")
    ok = F.col("_bad").isNull() & F.col("evaluation_id").isNotNull() & F.col("human_label").isin("Match", "NonMatch") & (F.size("entity_group_ids") > 0)
    if not rows.where(~F.coalesce(ok, F.lit(False))).isEmpty():
        raise ValueError("a line is no definite label")
    return rows.drop("_bad")


def files_digest(spark: SparkSession, *paths: str) -> str:
    """E-28: one digest of a set of files: the hashes of names and contents, by name. Contents are hashed where they are read."""
    rows = spark.read.format("binaryFile").load(list(paths)).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat_ws("\n", x["name"], x["h"])), "\n"), 256)).first()[0]


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """A-12, O-6: all rows of the n keys with the smallest seeded hash; a sampling operator."""
    keys = df.select(key).distinct().orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")  # at most n rows


@dataclass(frozen=True)
class Publication:
    """A publisher's payment file: its receipt's SHA-256 and the headers of canonical fields (``postcode`` may lack)."""

    publisher: str
    path: str
    sha256: str
    headers: dict[str, str]


def _payment_lines(of: Publication):
    """Parser of one publication; whole files are the unit of work."""
    fields = ("name", "entity", "amount", "date", "transaction", "category", "description")
    if not set(fields) <= set(of.headers):
        raise SourceRefused(f"{of.publisher}: headers of {sorted(set(fields) - set(of.headers))} are not named")

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for path, content in zip(part["path"], part["content"], strict=True):
                if hashlib.sha256(bytes(content)).hexdigest() != of.sha256:
                    raise SourceRefused(f"{path}: the bytes are not those of the receipt")
                text, _ = decode(bytes(content))
                rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sniff_delimiter(text)) if any(c.strip() for c in r)]
                top = find_header_row(rows[:50])
                head = [c.strip() for c in rows[top]] if rows else []
                if not set(of.headers.values()) <= set(head):
                    raise SourceRefused(f"{path}: the published headers changed")
                made = []
                for line, r in enumerate(rows[top + 1 :], top + 2):
                    if len(r) != len(head):
                        raise SourceRefused(f"{path}:{line}: {len(r)} cells")
                    row = dict(zip(head, r, strict=True))
                    got = {f: row[h].strip() for f, h in of.headers.items()}
                    if not got["name"] or not got["entity"]:
                        raise SourceRefused(f"{path}:{line}: no supplier or entity")
                    seen = json.dumps([got["entity"], got["name"], got.get("postcode", "")], ensure_ascii=False)
                    sid = f"{of.publisher}-{hashlib.sha256(seen.encode()).hexdigest()[:24]}"
                    made.append((f"{of.publisher}-{of.sha256[:12]}-line{line}", sid, *[got[f] for f in fields], got.get("postcode", ""), path.rsplit("/", 1)[-1], line, row))
                yield pd.DataFrame(made, columns=["invoice_id", "supplier_id", *fields, "postcode", "source_file", "source_line", "original"])

    return parse


def read_payments(spark: SparkSession, *publications: Publication) -> DataFrame:
    """A-17, E-13: every payment line of several publishers, none merged, in sterling.

    A line's id is made of its publisher, the receipt and its place in the file, a supplier's of publisher, entity, name
    and postcode as written; its country is unknown (ZZ). Bytes that differ from the receipt, changed headers, lines
    without a supplier and amounts that don't parse fail the scan. ``profile.reconciliation`` gives totals per file.
    """
    schema = "invoice_id string, supplier_id string, name string, entity string, amount string, date string, transaction string, category string, description string, postcode string, source_file string, source_line int, original map<string,string>"
    out = None
    for p in publications:
        rows = spark.read.format("binaryFile").load(p.path).select("path", "content").mapInPandas(_payment_lines(p), schema).withColumn("publisher", F.lit(p.publisher))
        out = rows if out is None else out.unionByName(rows)
    said = F.concat_ws(" ", F.lit("no amount:"), "invoice_id", "amount")
    amount = F.coalesce(V.parse_amount("amount", "point"), F.raise_error(said).cast("decimal(38,10)")).cast("decimal(38,2)")
    return out.select("publisher", "invoice_id", "supplier_id", "name", "entity", "postcode", F.lit("ZZ").alias("country"), F.col("date").alias("invoice_date"), F.col("amount").alias("published_amount"), amount.alias("amount"),
        F.lit("GBP").alias("currency"), "category", "description", F.col("transaction").alias("reference"), "source_file", "source_line", "original")


def payment_suppliers(lines: DataFrame) -> DataFrame:
    """A-17: the suppliers that payment lines name."""
    empty = [F.lit("").alias(c) for c in ("registration_id", "tax_id")]
    return lines.select("supplier_id", "name", "country", *empty, "postcode").distinct()
