"""Column profiles and source mappings (E-10..E-13, S-10, S-11, S-14, P-14, P-21, P-22, P-25, S-26, J-21, O-9)."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V

#: fixed values: columns whose samples are never shown; header names of canonical fields, first wins
SENSITIVE = {"bankn", "iban", "bankaccount", "bankaccountnumber", "accountnumber", "routingnumber", "sortcode", "password", "apikey", "token", "secret"}
SUPPLIER_HEADERS = {
    "supplier_id": ("supplierid", "vendorid", "vendorno", "vendornumber", "lifnr", "suppliernumber", "supplierno", "vendorcode", "suppliercode", "accountnumber", "partnerid", "bpnumber", "creditorid"),
    "name": ("name", "suppliername", "vendorname", "name1", "legalname", "companyname", "businessname", "tradingname", "partnername"),
    "country": ("country", "countrycode", "land1", "countrykey", "countryregion", "isocountry", "ctry"),
    "registration_id": ("registrationid", "registrationnumber", "companynumber", "companieshouse", "crn", "regno", "registrationno", "legalregistrationnumber", "orgnumber", "organisationnumber", "organizationnumber"),
    "tax_id": ("taxid", "vatnumber", "vatregistrationnumber", "vatno", "vat", "stceg", "taxnumber", "taxregistrationnumber", "gstin", "tin", "ustid", "siret", "abn"),
    "postcode": ("postcode", "postalcode", "zip", "zipcode", "pstlz", "pincode"),
    "address": ("address", "address1", "addressline1", "street", "stras", "streetaddress", "fulladdress", "registeredaddress"),
    "aliases": ("aliases", "alternatenames", "alsoknownas", "aka", "name2", "tradingnames", "previousname"),
    "lei": ("lei", "leicode", "legalentityidentifier"),
    "parent_lei": ("parentlei", "parentlegalentityidentifier", "ultimateparentlei"),
    "bank_account_hash": ("bankaccounthash", "bankhash", "accounthash"),
}
SPEND_HEADERS = {
    "invoice_id": ("invoiceid", "invoiceno", "invoicenumber", "documentno", "documentnumber", "belnr", "billnumber", "voucherno", "transactionid", "xblnr", "referencenumber"),
    "supplier_id": SUPPLIER_HEADERS["supplier_id"],
    "invoice_date": ("invoicedate", "documentdate", "bldat", "postingdate", "budat", "date", "transactiondate", "billdate"),
    "amount": ("amount", "netamount", "net", "amountnet", "invoiceamount", "value", "dmbtr", "wrbtr", "totalamount", "linetotal", "amountindocumentcurrency"),
    "currency": ("currency", "currencycode", "waers", "curr", "txncurrency", "documentcurrency"),
    "category": ("category", "spendcategory", "commodity", "commoditycode", "matkl", "materialgroup", "glaccount", "costcategory", "expensetype"),
    "description": ("description", "text", "sgtxt", "lineitemtext", "narrative", "details", "itemdescription", "memo"),
}

AUXILIARY_HEADERS = {
    "tax_amount": ("taxamount", "vatamount", "tax", "vat", "wmwst", "mwskzamt", "taxvalue", "salestax", "vatvalue"),
    "gross_amount": ("grossamount", "gross", "amountgross", "totalinclvat", "totalincludingvat", "grosstotal"),
    "document_type": ("documenttype", "blart", "doctype", "invoicetype", "transactiontype"),
    "company_code": ("companycode", "bukrs", "entity", "legalentity", "orgunit"),
}


def normalize_header(name: str) -> str:
    """S-10."""
    return re.sub(r"[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower())


def sensitive(name: str) -> bool:
    """S-11, P-14."""
    return normalize_header(name) in SENSITIVE


def profile(df: DataFrame, *cols: str) -> DataFrame:
    """E-10: one row per column, in one pass over the data: rows unpivot to (column, value) counts before distinct counts."""
    names = cols or tuple(df.columns)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), S.strip(F.col(c).cast("string")).alias("value")) for c in names])).alias("p")).select("p.*")
    per = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    full = F.col("value") != ""
    held = F.upper("value").isin(*S.PLACEHOLDER_TEXT) & full
    return per.groupBy("column_name").agg(
        F.sum("n").alias("total"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("filled"), F.count_if(full).alias("distinct_values"),
        F.sum(F.when(held, F.col("n")).otherwise(0)).alias("placeholders"), F.max(F.length("value")).cast("long").alias("max_length"),
    )


def samples(df: DataFrame, column: str, n: int = 5) -> list[str]:
    """The smallest distinct values of a column; redacted where its name is sensitive."""
    if sensitive(column):
        return ["[REDACTED]"]
    v = S.strip(F.col(column).cast("string"))
    return [r[0] for r in df.select(v.alias("v")).where("v <> ''").distinct().orderBy("v").limit(n).collect()]


@dataclass(frozen=True)
class SourceMapping:
    """P-22: canonical field -> source column, with transforms and formats; an artifact, kept as data."""

    target: str
    columns: dict[str, str]
    transforms: dict[str, list[str]] = field(default_factory=dict)
    date_order: str = "ymd"
    decimal_style: str = "point"
    #: S-26: the system that ids are told apart by, if they need it; what stands between the parts of an id
    source_system: str | None = None
    key_separator: str = ":"
    #: "supplier" where invoice numbers repeat between suppliers
    invoice_key_scope: str = "dataset"
    #: columns that are known but not canonical; they stay among the extras
    auxiliary: dict[str, str] = field(default_factory=dict)


class MappingRefused(ValueError):
    """A source can't be mapped without guessing."""


def infer_mapping(df: DataFrame, target: str) -> SourceMapping:
    """J-21: headers by ordered synonym lists; dates or amounts that could be read two ways are refused."""
    wanted = SUPPLIER_HEADERS if target == "suppliers" else SPEND_HEADERS
    heads = {normalize_header(c): c for c in df.columns}
    columns = {f: next(heads[s] for s in known if s in heads) for f, known in wanted.items() if any(s in heads for s in known)}
    known = {} if target == "suppliers" else AUXILIARY_HEADERS
    auxiliary = {f: c for f, names in known.items() for c in [next((heads[n] for n in names if n in heads and heads[n] not in columns.values()), None)] if c}
    order, style = "ymd", "point"
    if "invoice_date" in columns:
        order = V.date_order(df, columns["invoice_date"]).first().date_order
        if order in ("ambiguous", "conflicting"):
            raise MappingRefused(f"{order} dates in {columns['invoice_date']}")
    if "amount" in columns:
        style = V.decimal_style(df, columns["amount"]).first().decimal_style
        if style in ("ambiguous", "conflicting"):
            raise MappingRefused(f"{style} decimals in {columns['amount']}")
    return SourceMapping(target, columns, {}, order, "point" if style == "plain" else style, auxiliary=auxiliary)


def apply_mapping(df: DataFrame, mapping: SourceMapping) -> DataFrame:
    """P-22, P-25, E-12: canonical columns, extras of unmapped ones, and the reason a row is rejected (null if none)."""

    def one(f: str, c: str) -> Column:
        raw = F.col(f"`{c}`")
        if f == "invoice_date":
            return V.parse_date(raw, mapping.date_order)
        if f == "amount":
            money = V.parse_amount(raw, mapping.decimal_style)
            return V.exact_minor_units(money, F.upper(S.strip(F.col(f"`{mapping.columns['currency']}`"))) if "currency" in mapping.columns else F.lit(""))
        return S.apply_transforms(raw, mapping.transforms.get(f, ["trim"]))

    rest = [c for c in df.columns if c not in mapping.columns.values()]
    extras = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]), lambda k, v: v != "") if rest else F.create_map().cast("map<string,string>")
    out = df.select(*[one(f, c).alias(f) for f, c in mapping.columns.items()], extras.alias("extras"))
    reason = F.concat_ws(", ", *[F.when(F.col(f).isNull(), F.lit(f"unreadable {f}")) for f in ("invoice_date", "amount") if f in mapping.columns])
    return out.withColumn("rejected_reason", F.when(reason != "", reason))


def with_keys(mapped: DataFrame, mapping: SourceMapping) -> DataFrame:
    """S-26: ids unique in the whole dataset: system and supplier before the own number, as the mapping says.

    A native id that holds the separator is rejected, as two different ids could give one key. Empty ids stay empty.
    """
    sign, out = mapping.key_separator, mapped
    own = [f for f in ("supplier_id", "invoice_id") if f in mapped.columns]
    clash = F.concat_ws(", ", *[F.when(F.contains(F.col(f), F.lit(sign)), F.lit(f"{f} holds the key separator {sign}")) for f in own])
    out = out.withColumn("rejected_reason", F.coalesce("rejected_reason", F.when(clash != "", clash)))
    scoped = mapping.invoice_key_scope == "supplier" and len(own) == 2
    keyed = {}
    for f in own:
        parts = [F.lit(mapping.source_system)] if mapping.source_system else []
        if f == "invoice_id" and scoped:
            parts.append(F.when(F.col("supplier_id") != "", F.col("supplier_id")))
        keyed[f] = F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit("")).otherwise(F.concat_ws(sign, *parts, f))
    return out.withColumns(keyed)


def key_conflicts(mapped: DataFrame, key: str) -> DataFrame:
    """S-26: keys that rows of different contents share; such a source is refused."""
    rest = [c for c in mapped.columns if c not in (key, "rejected_reason")]
    row = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return mapped.where("rejected_reason is null").select(key, F.sha2(row, 256).alias("h")).groupBy(key).agg(F.count_distinct("h").alias("variants")).where("variants > 1")


def change_counts(df: DataFrame, mapping: SourceMapping) -> DataFrame:
    """E-12: (field, changed): values of each canonical field that its transforms alter beyond white space at the ends."""
    mapped = {f: S.apply_transforms(F.col(f"`{c}`"), mapping.transforms.get(f, ["trim"])) for f, c in mapping.columns.items() if f != "amount"}
    if "invoice_date" in mapped:
        mapped["invoice_date"] = V.parse_date(F.col(f"`{mapping.columns['invoice_date']}`"), mapping.date_order).cast("string")
    counts = [F.struct(F.lit(f).alias("field"), F.count_if(v != S.strip(F.col(f"`{mapping.columns[f]}`").cast("string"))).alias("changed")) for f, v in mapped.items()]
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.field", "c.changed")


def reconciliation(lines: DataFrame, *keys: str) -> DataFrame:
    """E-13: per publisher (or other keys): lines, sum of amounts, distinct references and references that repeat."""
    per = lines.groupBy(*keys, "reference").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total"))
    return per.groupBy(*keys).agg(F.sum("n").alias("lines"), F.sum("total").cast("decimal(38,2)").alias("total"), F.count("reference").alias("references"), F.count_if(F.col("reference").isNotNull() & (F.col("n") > 1)).alias("repeated_references"))


def modal_width(rows: DataFrame, width: str, *keys: str) -> DataFrame:
    """E-11: the commonest width of each key's rows, the greater of equally common ones."""
    sizes = rows.groupBy(*keys, width).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*keys).agg(F.max(F.struct("n", width)).alias("m")).select(*keys, F.col(f"m.{width}").alias("width"), F.col("m.n").alias("n"))


def infer_type(df: DataFrame, column: str, first: int = 400) -> str:
    """S-14: date, currency, country, number or text of more than nine tenths of the first filled values."""
    x = S.strip(F.col(column).cast("string"))
    few = df.select(x.alias("x")).where("x <> ''").limit(first)
    tests = {"date": V.parse_date("x").isNotNull(), "currency": F.col("x").rlike("^[A-Z]{3}$"), "country": F.col("x").rlike("^[A-Z]{2}$"), "number": F.col("x").rlike(r"^[-+(]?[0-9][0-9.,]*\)?$")}
    row = few.agg(*[F.avg(t.cast("double")).alias(k) for k, t in tests.items()]).first()
    return next((k for k in tests if (row[k] or 0) > 0.9), "text")
