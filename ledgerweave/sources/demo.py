"""A-2: a small invented source for demonstrations: ten suppliers, twelve invoice lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .readers import SPEND_FIELDS, SUPPLIER_FIELDS

SUPPLIERS = (
    ("D01", "Harbour Paper Limited", "GB", "01110001", "GB700000011", "LS1 4AP"),
    ("D02", "Harbour Paper Ltd", "GB", "01110001", "", "LS1 4AP"),
    ("D03", "Harbor Paper Co", "GB", "", "GB700000011", "LS1 4AP"),
    ("D04", "Nordlicht Logistik GmbH", "DE", "HRB 20417", "DE810000017", "20095"),
    ("D05", "Nordlicht Logistic", "DE", "", "DE810000017", "20095"),
    ("D06", "Atelier Verrier SARL", "FR", "552000123", "", "69002"),
    ("D07", "Atelier Verrier", "FR", "552000124", "", "69002"),
    ("D08", "Prairie Instruments Inc", "US", "", "", "50309"),
    ("D09", "Prairie Instrument Incorporated", "US", "", "", "50309"),
    ("D10", "Quarry Lane Catering", "GB", "N/A", "", "YO1 7HH"),
)
SPEND = (
    ("V001", "D01", "2026-01-14", "1200.00", "GBP", "Stationery", "Copier paper"),
    ("V002", "D02", "2026-02-11", "1180.00", "GBP", "Stationery", "Copier paper"),
    ("V003", "D01", "2026-03-12", "1215.50", "GBP", "Stationery", "Copier paper"),
    ("V004", "D02", "2026-04-13", "4890.00", "GBP", "Stationery", "Envelopes and paper"),
    ("V005", "D03", "2026-04-20", "-75.00", "GBP", "Stationery", "Credit for damage"),
    ("V006", "D04", "2026-03-02", "8400.00", "EUR", "Freight", "Road freight"),
    ("V007", "D05", "2026-04-02", "8350.00", "EUR", "Freight", "Road freight"),
    ("V008", "D06", "2026-02-18", "2310.25", "EUR", "Laboratory", "Glassware"),
    ("V009", "D07", "2026-04-22", "640.00", "EUR", "Laboratory", "Glassware repair"),
    ("V010", "D08", "2026-01-28", "15200.00", "USD", "Laboratory", "Spectrometer lease"),
    ("V011", "D09", "2026-04-28", "15200.00", "USD", "Laboratory", "Spectrometer lease"),
    ("V012", "D10", "2026-04-30", "310.40", "GBP", "Catering", "Meeting lunch"),
)


def demo(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Suppliers and spend lines as the strict reader gives them: all columns are strings."""
    return spark.createDataFrame(SUPPLIERS, ", ".join(f"{c} string" for c in SUPPLIER_FIELDS)), spark.createDataFrame(SPEND, ", ".join(f"{c} string" for c in SPEND_FIELDS))
