"""Scalar text functions as column expressions (S-1..S-9, S-12, S-13, S-20..S-24, S-27, S-28, C-9..C-11)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: company forms dropped from names, placeholder identifiers, placeholder texts
COMPANY_FORMS = ("limited", "ltd", "inc", "llc", "gmbh", "plc")
BLANK_IDS = ("NA", "NIL", "NONE", "NULL", "UNKNOWN", "NOTAVAILABLE", "NOTAPPLICABLE", "MISSING", "TBD")
PLACEHOLDER_IDS = (
    "TBC", "TBA", "PENDING", "SAME", "ASABOVE", "DUMMY", "TEMP", "TEST", "VARIOUS", "MISC", "SUNDRY", "ONEOFF",
    "NOTREG", "NOTREGISTERED", "NOREG", "NONREG", "REFER", "SEEABOVE",
)
PLACEHOLDER_TEXT = (
    "", "-", "--", "---", "----", ".", "..", "N/A", "NA", "N.A.", "NIL", "NONE", "NULL", "UNKNOWN", "NOT AVAILABLE",
    "NOTAVAILABLE", "NOT APPLICABLE", "NOTAPPLICABLE", "MISSING", "TBD", "TBC", "TBA", "PENDING", "SAME", "AS ABOVE",
    "ASABOVE", "SEE ABOVE", "DUMMY", "TEMP", "TEST", "VARIOUS", "MISC", "SUNDRY", "XXX", "XXXX", "0", "00", "000",
    "0000", "999", "9999",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))

    return texts.map(one)


def folded(c: Column | str, ascii_only: bool = False) -> Column:
    """Case-folded text without combining marks. Plain ASCII stays in the JVM; ``ascii_only`` leaves the slow path out."""
    x = F.coalesce(col(c), F.lit(""))
    return F.lower(x) if ascii_only else F.when(x.rlike(r"^[\x00-\x7F]*$"), F.lower(x)).otherwise(_fold(x))


def tokens(c: Column | str, ascii_only: bool = False) -> Column:
    """S-1: runs of letters and digits."""
    return F.regexp_extract_all(folded(c, ascii_only), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def name_key(c: Column | str, ascii_only: bool = False) -> Column:
    """S-2: tokens without company forms, joined by a space."""
    return F.array_join(F.filter(tokens(c, ascii_only), lambda t: ~t.isin(*COMPANY_FORMS)), " ")


def strip(c: Column | str) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse_space(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def identifier(c: Column | str) -> Column:
    """S-3: upper case without spaces, dots, hyphens, slashes; words for 'none' become ''."""
    x = F.upper(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)[\s.\-/]", ""))
    return F.when(x.isin(*BLANK_IDS), F.lit("")).otherwise(x)


def degenerate(c: Column | str, min_length: int = 0) -> Column:
    """S-4: an identifier that can't carry identity: a placeholder, one repeated character, or too short."""
    x = identifier(c)
    bad = x.isin(*PLACEHOLDER_IDS) | x.rlike(r"^(.)\1*$")
    return (x != "") & (bad | (F.length(x) < min_length) if min_length else bad)


def authority(c: Column | str, min_length: int = 0) -> Column:
    """The identifier, '' where degenerate."""
    return F.when(degenerate(c, min_length), F.lit("")).otherwise(identifier(c))


def valid_lei(c: Column | str) -> Column:
    """S-5: 20 ASCII letters and digits, the last two digits, ISO 7064 mod 97-10 remainder 1."""
    x = col(c)
    digits = F.split(F.upper(x), "")
    value = F.aggregate(
        F.filter(digits, lambda d: d != ""),
        F.lit(0).cast("long"),
        lambda a, d: F.when(d.rlike("[0-9]"), (a * 10 + F.try_to_number(d, F.lit("9")).cast("long")) % 97).otherwise((a * 100 + F.ascii(d) - 55) % 97),
    )
    return F.coalesce(x.rlike("^[A-Za-z0-9]{18}[0-9]{2}$") & (value == 1), F.lit(False))


def soundex_key(c: Column | str, ascii_only: bool = False) -> Column:
    """S-6: Soundex of the name key's Latin letters, '' without any."""
    return F.soundex(F.regexp_replace(F.upper(name_key(c, ascii_only)), "[^A-Z]", ""))


def ngrams(key: Column | str, n: int = 3) -> Column:
    """S-7: distinct n-grams of a name key between blanks; none of an empty key."""
    x = F.concat(F.lit(" "), col(key), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
    return F.when((F.trim(x) != "") & (F.length(x) >= n), F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def levenshtein_similarity(a: Column, b: Column, limit: int = 256) -> Column:
    """C-9: 1 - distance / longer length of the first ``limit`` characters; 0 if either is empty."""
    a, b = F.substring(a, 1, limit), F.substring(b, 1, limit)
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """C-10: of two token arrays; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    """Twice the common share of two distinct gram arrays; 0 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def sorted_words(key: Column) -> Column:
    return F.array_join(F.array_sort(F.split(key, " ")), " ")


def sigmoid(z: Column, clip: float = 40.0) -> Column:
    """S-28."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))


def node_id(kind: str, scope: Column) -> Column:
    """S-23: name of an attribute node."""
    return F.concat(F.lit(kind + ":"), F.sha2(scope, 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """S-27: keyed pseudonym from built-in digests; the padded keys are made on the driver."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def strip_leading_zeros(c: Column | str) -> Column:
    """S-12: '000' is '0', '' stays ''."""
    x = strip(c)
    return F.when(x.rlike("^0+$"), F.lit("0")).otherwise(F.regexp_replace(x, "^0+", ""))


def blank_placeholders(c: Column | str) -> Column:
    x = strip(c)
    return F.when(F.upper(x).isin(*PLACEHOLDER_TEXT), F.lit("")).otherwise(x)


#: P-21: transforms a mapping may name
TRANSFORMS = {"trim": strip, "upper": lambda c: F.upper(strip(c)), "strip_leading_zeros": strip_leading_zeros, "collapse_space": collapse_space, "blank_placeholders": blank_placeholders}


def apply_transforms(c: Column | str, names: list[str]) -> Column:
    out = col(c)
    for name in names:
        out = TRANSFORMS[name](out)
    return out


def fingerprint(*cols: Column) -> Column:
    """S-22: SHA-256 of the canonical JSON of a struct, null fields kept."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def month_before(period: Column, k: int) -> Column:
    """S-20."""
    return F.date_format(F.add_months(F.to_date(F.concat(period, F.lit("-01"))), -k), "yyyy-MM")
