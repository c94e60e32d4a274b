"""Golden cases and brute-force checks of validation, identity, matching, graph and risk."""

import hashlib
import hmac
import random
from datetime import date
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import text as S
from ledgerweave.functions import values as V
from ledgerweave.operators import evidence, graph, match, model, profile, resolve, risk, validate
from ledgerweave.operators import spend as E

SUP = "supplier_id string, name string, country string, registration_id string, tax_id string, postcode string, lei string, parent_lei string, bank_account_hash string"


def sup(*rows):
    return [(r[0], r[1], r[2], *(list(r[3:]) + [""] * (9 - len(r)))[:6]) for r in rows]


DEMO = sup(
    ("SUP-001", "Northbridge Components Ltd", "GB", "REG-GB-41001", "GB123450001", "SW1A1AA"), ("SUP-002", "Northbridge Components Limited", "GB", "REG-GB-41001", "", "SW1A 1AA"),
    ("SUP-003", "Northbridge Components Trading", "GB", "", "GB123450001", "SW1A1AA"), ("SUP-004", "Northbridge Component Services", "GB", "REG-GB-99001", "GB999990001", "SW1A1AB"),
    ("SUP-005", "Atlas Packaging Inc", "US", "US-A700", "", "10001"), ("SUP-006", "Atlas Packaging LLC", "US", "US-A700", "US-TAX-770", "10001"),
    ("SUP-007", "Harbour Office Supplies", "GB", "", "", "BS11AA"), ("SUP-008", "Harbour Office Supply", "GB", "", "", "BS11AB"),
    ("SUP-009", "Rhein Werkzeug GmbH", "DE", "DE-R901", "DE123450009", "10115"), ("SUP-010", "Rhein Werkzeug Vertrieb", "DE", "", "DE123450009", "10115"),
)
LINES = """INV-001 SUP-001 1200.10 GBP|INV-002 SUP-002 399.90 GBP|INV-003 SUP-003 50.00 GBP|INV-004 SUP-001 250.00 EUR|INV-005 SUP-004 800.00 GBP|INV-006 SUP-005 1000.05 USD
|INV-007 SUP-006 499.95 USD|INV-008 SUP-007 200.00 GBP|INV-009 SUP-008 300.00 GBP|INV-010 SUP-009 700.70 EUR|INV-011 SUP-010 299.30 EUR|INV-002 SUP-002 399.90 GBP"""


def spend_rows(spark):
    rows = [x.split() for x in LINES.replace("\n", "").split("|")]
    return spark.createDataFrame([(i, s, date(2026, 1, 2), Decimal(a), c, "x") for i, s, a, c in rows], "invoice_id string, supplier_id string, invoice_date date, amount decimal(14,2), currency string, category string")


def test_demo_goldens(spark):
    s, v = spark.createDataFrame(DEMO, SUP), spend_rows(spark)
    lines = validate.accept(s.drop("lei", "parent_lei", "bank_account_hash"), v)
    assert {r.currency: (r.total, r.n_lines) for r in E.totals(lines).collect()} == {"GBP": (Decimal("2950.00"), 6), "EUR": (Decimal("1250.00"), 3), "USD": (Decimal("1500.00"), 2)}
    members = resolve.memberships(s)
    assert sorted(r.members for r in resolve.entities(s, members).collect() if r.n_members > 1) == ["SUP-001|SUP-002", "SUP-005|SUP-006"]
    assert members.select("entity_id").distinct().count() == 8
    assert [r.invoice_id for r in validate.exact_duplicates(v).collect()] == ["INV-002"]


def test_refusals(spark):
    s, v = spark.createDataFrame(DEMO, SUP).drop("lei", "parent_lei", "bank_account_hash"), spend_rows(spark)
    with pytest.raises(validate.DatasetRefused, match="conflicting"):
        validate.accept(s, v.union(v.limit(1).withColumn("amount", F.lit(Decimal("1.00")))))
    with pytest.raises(validate.DatasetRefused, match="orphan"):
        validate.accept(s.where("supplier_id <> 'SUP-001'"), v)


def clique(rows):
    for a, b in combinations(rows, 2):
        if a[2] != b[2] or any(a[i] and b[i] and a[i] != b[i] for i in (3, 4, 6)) or (a[6] and a[6] == b[7]) or (b[6] and b[6] == a[7]):
            return False
        if not ((a[3] and a[3] == b[3]) or (a[6] and a[6] == b[6])):
            return False
    return True


def sequential(rows):
    """Buckets by registration, then LEI, merged where the union of the touched groups is a clique."""
    root = {r[0]: r[0] for r in rows}
    by = {r[0]: r for r in rows}
    for f in (3, 6):
        for key in sorted({(r[2], r[f]) for r in rows if r[f]}):
            ids = {root[r[0]] for r in rows if (r[2], r[f]) == key}
            group = [i for i in root if root[i] in ids]
            if len(group) > 1 and clique([by[i] for i in group]):
                for i in group:
                    root[i] = min(group)
    return root


def test_two_passes_equal_sequential_grouping(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for case in range(150):
        own = sup(*[(f"{case:03}-{i}", "n", rng.choice(["GB", "GB", "US"]), rng.choice(["", f"R{case}A", f"R{case}B"]), rng.choice(["", "", f"T{case}A", f"T{case}B"]), "p", rng.choice(["", f"L{case}A", f"L{case}B"]), rng.choice(["", "", f"L{case}A"])) for i in range(rng.randint(2, 6))])
        own = [(*r[:7], "" if r[7] == r[6] else r[7], r[8]) for r in own]  # a record that is its own parent is refused before
        rows += own
        want |= sequential(own)
    got = {r.supplier_id: r.root for r in resolve.memberships(spark.createDataFrame(rows, SUP).repartition(7)).collect()}
    assert got == want


def test_cliques(spark):
    cases = [
        (sup(("A", "a", "GB", "", "VAT", ""), ("B", "b", "GB", "", "VAT", "")), 2), (sup(("A", "a", "GB", "R12", "", "", "", "", "a" * 64), ("B", "b", "GB", "R12", "", "", "", "", "b" * 64)), 2),
        (sup(("A", "a", "GB", "R12", "", "", "PARENT"), ("B", "b", "GB", "R12", "", "", "CHILD", "PARENT")), 2), (sup(("A", "a", "GB", "R12", "", "", "L12"), ("B", "b", "GB", "R12"), ("C", "c", "GB", "", "", "", "L12")), 2),
        (sup(("A", "a", "GB", "R12"), ("B", "b", "US", "R12")), 2), (sup(*[(str(i), "n", "GB", v) for i, v in enumerate(("0", "X", "----", "999999", "00000000"))]), 5),
    ]
    for rows, n in cases:
        assert resolve.memberships(spark.createDataFrame(rows, SUP)).select("entity_id").distinct().count() == n


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr).first()[0]


def test_text(spark):
    assert one(spark, S.name_key("x"), x="Straße Café Ltd") == "strasse cafe"
    assert one(spark, S.valid_lei("x"), x="5493001KJTIIGC8Y1R12") and not one(spark, S.valid_lei("x"), x="5493001KJTIIGC8Y1R13") and not one(spark, S.valid_lei("x"), x="")
    assert one(spark, S.soundex_key("x"), x="Acme") == one(spark, S.soundex_key("x"), x="Akme")
    assert round(one(spark, S.levenshtein_similarity(F.col("a"), F.col("b")), a="abcdef", b="abcdeg"), 9) == round(5 / 6, 9)
    assert one(spark, S.hmac_sha256(b"key", F.col("x")), x="m") == hmac.new(b"key", b"m", hashlib.sha256).hexdigest()
    assert one(spark, S.identifier("x"), x=" gb-12.3/4 ") == "GB1234" and one(spark, S.identifier("x"), x="n.a.") == ""
    assert one(spark, S.month_before(F.col("x"), 3), x="2025-02") == "2024-11"


@pytest.mark.parametrize("text,order,want", [("2026-03-15", "dmy", 1), ("20260315", "dmy", 1), ("15032026", "dmy", 1), ("03152026", "mdy", 1), ("15/03/2026", "dmy", 1), ("03/15/2026", "mdy", 1), ("15.03.2026", "dmy", 1), ("15-Mar-2026", "dmy", 1), ("", "dmy", 0), ("2026-13-01", "dmy", 0), ("32/01/2026", "dmy", 0)])
def test_dates(spark, text, order, want):
    assert one(spark, V.parse_date("x", order), x=text) == (date(2026, 3, 15) if want else None)


def test_short_years(spark):
    assert one(spark, V.parse_date("x"), x="31-Dec-69") == date(2069, 12, 31) and one(spark, V.parse_date("x"), x="01-Jan-70") == date(1970, 1, 1) and one(spark, V.parse_date("x", "dmy", 20), x="03-Mar-25") == date(1925, 3, 3)


@pytest.mark.parametrize("text,style,want", [("1.234,56", "comma", "1234.56"), ("1,234.56", "point", "1234.56"), ("€ 1.234,56", "comma", "1234.56"), ("(250,00)", "comma", "-250"), ("-250.00", "point", "-250"), ("250.00 CR", "point", "-250"), ("250.00 DR", "point", "250"), ("-1.00 CR", "point", None), ("1,23.4", "point", None)])
def test_amounts(spark, text, style, want):
    got = one(spark, V.parse_amount("x", style), x=text)
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize("amount,currency,want", [("1.234", "KWD", None), ("1.234", "GBP", None), ("1.25", "JPY", None), ("1.230", "KWD", "1.23"), ("7", "JPY", "7")])
def test_minor_units(spark, amount, currency, want):
    got = one(spark, V.exact_minor_units(F.col("a").cast("decimal(38,10)"), F.col("c")), a=amount, c=currency)
    assert got == (None if want is None else Decimal(want))


def test_candidates(spark):
    rows = [("1", "Acme industrial", "GB", ""), ("2", "Akme industrial", "GB", ""), ("3", "Unrelated holding", "GB", "Acme industrial")]
    s = spark.createDataFrame(rows, "supplier_id string, name string, country string, aliases string")
    got = {(r.left_id, r.right_id) for r in match.candidates(match.postings(s)).collect()}
    assert {("1", "2"), ("1", "3")} <= got
    five = spark.createDataFrame(sup(*[(str(i), "Acme", "GB") for i in range(5)]), SUP)
    cfg = match.MatchConfig(max_posting=2)
    assert match.candidates(match.postings(five, cfg), cfg).count() == 0
    with pytest.raises(match.BudgetExceeded):
        match.within_budget(match.candidates(match.postings(five)), match.MatchConfig(max_evaluations=1))


def test_graph_paths(spark):
    rows = [("A", "a", "GB", "10 Shared Street York", "", ""), ("B", "b", "GB", "10 shared street, York", "", "P12"), ("C", "c", "GB", "", "P12", "")]
    s = spark.createDataFrame(rows, "supplier_id string, name string, country string, address string, lei string, parent_lei string")
    got = {(r.left_id, r.right_id): r.hops for r in graph.association_pairs(s).collect()}
    assert got == {("A", "B"): 2, ("B", "C"): 2, ("A", "C"): 4}
    many = spark.createDataFrame([(str(i), "n", "GB", "YO1") for i in range(8)], "supplier_id string, name string, country string, postcode string")
    assert graph.association_pairs(many, graph.GraphPolicy(max_posting=3)).count() == 0


def test_spikes_and_churn(spark):
    rows = [("A", date(2025, m, 1), Decimal(a), "GBP", str(i)) for i, (m, a) in enumerate([(1, "100"), (2, "100"), (3, "100"), (4, "2000"), (4, "-1900")])]
    v = spark.createDataFrame(rows, "supplier_id string, invoice_date date, amount decimal(14,2), currency string, invoice_id string")
    got = risk.spikes(risk.monthly(v, "supplier_id"), "supplier_id", before_month="2026-10").collect()
    assert [(r.month, r.positive, r.credits, r.baseline) for r in got] == [("2025-04", 2000, -1900, 100)]
    assert risk.spikes(risk.monthly(v.where("month(invoice_date) <> 2"), "supplier_id"), "supplier_id").count() == 0
    tokens = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("x", 3, "c"), ("y", 1, "a"), ("y", 2, ""), ("y", 3, "b")], "supplier_id string, snapshot_seq long, token string")
    assert [(r.supplier_id, r.changes) for r in risk.churn(tokens).collect()] == [("x", 2)]


def test_model(spark):
    rows = [(f"{s}{i}", s, 0.8, float(i % 2), i % 2) for s in ("train", "validation") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, split string, name double, address double, y int")
    got = model.fit_pair_model(df.where("split = 'train'"), df.where("split = 'validation'"), ["name", "address"], "y", rounds=200)
    assert got["key"][0] == 1.0 and got["weights"]["name"] == 0.0
    w, b = model.fold_constants({"a": 2.0, "c": 3.0}, 1.0, {"c": 0.5})
    assert w == {"a": 2.0, "c": 0.0} and b == 2.5


def test_evidence(spark):
    items = spark.createDataFrame([("k", 1, 60), ("k", 2, 50), ("k", 3, 40)], "k string, o int, n int")
    assert tuple(evidence.pack_evidence(items, "k", "o", "n", 100).first()) == ("k", 100, 2, 3)
    ev = spark.createDataFrame([("c", i, "t", "e", str(i)) for i in range(5)], "chain string, sequence long, timestamp string, event string, payload string")
    done = evidence.chain(ev)
    assert evidence.broken_links(done).count() == 0
    assert [r.sequence for r in evidence.broken_links(done.withColumn("payload", F.when(F.col("sequence") == 2, "x").otherwise(F.col("payload")))).collect()] == [2]


def test_mapping(spark):
    rows = [("1", "V1", "15.03.2026", "1.234,56", "EUR", "n"), ("2", "V1", "16.03.2026", "(250,00)", "EUR", ""), ("3", "V2", "32.03.2026", "1,00", "EUR", "")]
    df = spark.createDataFrame(rows, "BELNR string, LIFNR string, BLDAT string, WRBTR string, WAERS string, Note string")
    m = profile.infer_mapping(df, "spend")
    assert (m.date_order, m.decimal_style) == ("dmy", "comma")
    got = profile.apply_mapping(df, m).orderBy("invoice_id").collect()
    assert got[0].amount == Decimal("1234.56") and got[0].invoice_date == date(2026, 3, 15) and got[0].extras == {"Note": "n"} and got[1].amount == Decimal("-250.00") and got[2].rejected_reason == "unreadable invoice_date"
    with pytest.raises(profile.MappingRefused):
        profile.infer_mapping(df.withColumn("BLDAT", F.lit("01/02/2026")), "spend")


def test_graph_only_pairs_are_reviewed(spark):
    from ledgerweave.operators import match

    fields = "supplier_id string, name string, country string, registration_id string, tax_id string, postcode string, address string"
    s = spark.createDataFrame([("A", "Zqx", "GB", "", "", "", ""), ("B", "Yvw", "GB", "", "", "", ""), ("C", "Kjh", "GB", "", "", "", "")], fields)
    none = spark.createDataFrame([], "left_id string, right_id string")
    paths = spark.createDataFrame([("A", "B")], "left_id string, right_id string")
    members = s.selectExpr("supplier_id", "supplier_id AS root")
    done = match.governed(match.evaluated(s, match.augmented(none, paths)), members, paths)
    assert [(r.left_id, r.right_id, r.reason) for r in match.review_queue(done, none, none).collect()] == [("A", "B", "Graph_Context_Review")]


def test_reused_authority_no_longer_identifies(spark):
    from ledgerweave.operators import resolve, validate

    rows = [(f"S{i:02}", "n", "GB", "SC123456" if i < 30 else "R1", "", "LEI9") for i in range(32)]
    s = spark.createDataFrame(rows, "supplier_id string, name string, country string, registration_id string, tax_id string, lei string")
    got = {r.field: r.n for r in validate.reused_authority(s).collect()}
    assert got == {"registration_id": 30, "lei": 32}
    roots = {r.supplier_id: r.root for r in resolve.memberships(s).collect()}
    assert len(set(roots.values())) == 31 and roots["S31"] == roots["S30"] == "S30"


def test_threshold_sweep_in_slices(spark):
    import random

    from ledgerweave.operators import model

    rng = random.Random(1)
    rows = [(rng.choice([rng.random(), 0.5, 0.0, 1.0]), rng.randint(0, 1)) for _ in range(500)]
    got = {r.threshold: (r.tp, r.fp) for r in model.threshold_sweep(spark.createDataFrame(rows, "p double, y int"), "p", "y").collect()}
    assert got == {t: (sum(y for p, y in rows if p >= t), sum(1 - y for p, y in rows if p >= t)) for t in {p for p, _ in rows}}


def test_pair_numbers():
    assert [match.pair_at(x) for x in range(10)] == [(i, j) for j in range(5) for i in range(j)]
    assert match.pair_at(10**38 - 1) == (10**38 - 1 - (j := match.pair_at(10**38 - 1)[1]) * (j - 1) // 2, j) and 0 <= match.pair_at(10**38 - 1)[0] < j


def test_excluded_tax_sample_draws_without_listing(spark):
    rows = [(f"S{i:03}", f"N{i}", "GB", "", "HOT99" if i < 60 else f"T{i % 5}X" if i < 90 else "", "") for i in range(100)]
    s = spark.createDataFrame(rows, "supplier_id string, name string, country string, registration_id string, tax_id string, postcode string").withColumn("lei", F.lit("")).withColumn("parent_lei", F.lit(""))
    tax = {r[0]: r[4] for r in rows}
    every = {(a, b) for a in tax for b in tax if a < b and tax[a] and tax[a] == tax[b]}
    known = {p for p in every if int(p[0][1:]) % 3 == 0} | {("S001", "S095"), ("S001", "S070")}
    pairs = spark.createDataFrame(sorted(known), "left_id string, right_id string")
    seen = set()
    for seed in range(3):
        for size in (0, 12, 10_000):  # numbers are drawn for the first two, all pairs listed for the last
            cfg = match.MatchConfig(excluded_tax_sample_size=size, random_seed=seed)
            got = match.excluded_tax_sample(s, pairs, cfg).collect()
            drawn = [(r.left_id, r.right_id) for r in got]
            assert len(set(drawn)) == len(drawn) == min(size, len(every - known)) and set(drawn) <= every - known
            assert all(int(r.population) == len(every - known) and r.sampling_probability == min(1.0, size / len(every - known)) for r in got)
            if size == 12:
                assert drawn == [(r.left_id, r.right_id) for r in match.excluded_tax_sample(s.repartition(3), pairs, cfg).collect()]
                seen |= set(drawn)
    assert len(seen) > 24
