"""Explanations, reviews as labels, benchmarks, calibration, keys and prepared datasets, on small cases by hand or brute force."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import benchmark, evidence, explain, feedback, graph, match, model, profile, resolve, risk
from ledgerweave.sources import readers, sinks

from .test_identity import DEMO, SUP

PAIR = "pair_key string, left_source string, right_source string, human_label string"


def test_pair_explanations_by_what_must_be_told(spark):
    rows = spark.createDataFrame(
        [("a", ["tax_id_disagreement"], "Conflict_Review", "Conflict_Review", 0.5, None, 0.2), ("b", [], "Authority_Grouped", "Human_Review", 0.9375, 0.25, 0.98765), ("c", [], "Below_Threshold", "Uncalibrated_Diagnostic", 0.0625, 1.0, 0.5)],
        "id string, reasons array<string>, outcome string, tier string, name_levenshtein double, address_jaccard double, p double",
    )
    got = {r.id: r.explanation for r in explain.explained(rows).collect()}
    assert got["a"] == "Recorded evidence contains an identity conflict. Operational tier is Conflict_Review; this explanation does not approve a merge or ledger action."
    assert got["b"].startswith("Every pair in the resolved group shares a direct legal identity key")
    assert got["c"].startswith(f"Recorded name similarity is {0.0625:.3f}. Operational tier")
    told = {r.id: r.facts for r in explain.facts(rows, "p").collect()}
    assert "address" not in told["a"] and told["b"]["address"].endswith("0.250") and told["b"]["probability"].endswith("0.9876") and "conflict" not in told["c"]


def test_group_rationales(spark):
    s = spark.createDataFrame(DEMO, SUP)
    got = {r.rationale.split(" / ")[0][-7:] if r.n_members > 1 else r.rationale: r for r in explain.rationales(s, resolve.memberships(s)).collect()}
    pair = got["SUP-001"]
    assert pair.n_members == 2 and 'Grouped source labels "Northbridge Components Ltd", "Northbridge Components Limited": ' in pair.rationale
    assert 'shares supplied registration ID "REGGB41001"; all 1 group pair checks' in pair.rationale and "SUP-001 / SUP-002 is 1.000;" in pair.rationale
    assert 'Source label "Rhein Werkzeug GmbH" remains a single supplier record. No supplier merge or external write was performed by this resolution.' in got


def test_rationale_of_a_large_group_shows_three_quoted_names(spark):
    s = spark.createDataFrame([(f"S{i}", f'A "{i}" \\ Ltd', "GB", "R77", "", "", "", "", "") for i in range(5)], SUP)
    (row,) = explain.rationales(s, resolve.memberships(s)).collect()
    assert row.n_members == 5 and '"A \\"0\\" \\\\ Ltd", ' in row.rationale and "and 2 more source labels" in row.rationale and "all 10 group pair checks" in row.rationale


def test_pair_states_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"e{rng.randrange(30)}", rng.choice(["Match", "NonMatch", "Unsure"]), i) for i in range(200)]
    rows = [(e, f"p{int(e[1:]) // 2}", y, i) for e, y, i in rows]
    newest = {}
    for r in rows:
        newest[r[0]] = r
    pairs = {}
    for e, p, y, i in sorted(newest.values(), key=lambda r: r[3]):
        pairs.setdefault(p, []).append(y)
    want = {p: "unsure" if h[-1] == "Unsure" else "conflicting" if len(set(h) - {"Unsure"}) > 1 else "eligible" for p, h in pairs.items()}
    df = spark.createDataFrame(rows, "evaluation_id string, pair_key string, human_label string, seq long")
    assert {r.pair_key: r.state for r in feedback.pair_states(df).collect()} == want
    told = feedback.statistics(df).first()
    assert (told.review_events, told.eligible_pairs, told.unsure_pairs, told.conflicting_pairs) == (200, *[sum(v == k for v in want.values()) for k in ("eligible", "unsure", "conflicting")])
    assert feedback.statistics(df.limit(0)).first().review_events == 0


def test_feedback_rows_and_backfill(spark):
    s = spark.createDataFrame(DEMO, SUP)
    evaluations = spark.createDataFrame([("e1", "r1", "SUP-001", "SUP-002", 0.9), ("e2", "r1", "SUP-002", "SUP-001", 0.9)], "evaluation_id string, run_id string, left_id string, right_id string, score double")
    runs = spark.createDataFrame([("r1", "cfg")], "run_id string, config_id string")
    decisions = spark.createDataFrame([("d1", "e1", "Match", 1), ("d2", "e2", "Match", 2), ("d3", "gone", "Match", 3)], "decision_id string, evaluation_id string, human_label string, seq long")
    rows = feedback.feedback(decisions, evaluations, runs, s).collect()
    assert len(rows) == 2 and rows[0].pair_key == rows[1].pair_key and rows[0].left_key != rows[0].right_key and rows[0].config_id == "cfg"
    assert [r.decision_id for r in feedback.missing(decisions, spark.createDataFrame([(r.decision_id,) for r in rows], "decision_id string")).collect()] == ["d3"]
    reviews = spark.createDataFrame([("SUP-001", "SUP-002"), ("SUP-001", "SUP-009")], "left_id string, right_id string")
    assert {r.right_id: r.evaluation_id for r in feedback.with_evaluation(reviews, evaluations).collect()} == {"SUP-002": "e1", "SUP-009": None}


def test_splits_keep_components_whole_and_known_ones_in_place(spark):
    pairs = spark.createDataFrame([("1", "a", "b", "Match"), ("2", "b", "c", "Match"), ("3", "c", "d", "NonMatch"), ("4", "e", "f", "NonMatch")], PAIR)
    known = spark.createDataFrame([("c", "test"), ("e", "train"), ("f", "validation")], "source string, split string")
    got = {r.source: (r.root, r.split) for r in feedback.assignments(pairs, known).collect()}
    assert got["a"] == got["b"] == got["c"] == ("a", "test") and got["e"][1] == "train"
    split = {r.pair_key: r.split for r in feedback.with_splits(pairs, feedback.assignments(pairs, known)).collect()}
    assert split["1"] == split["2"] == "test" and split["4"] is None
    with pytest.raises(feedback.LabelsRefused, match="NonMatch"):
        feedback.assignments(pairs.union(spark.createDataFrame([("5", "a", "c", "NonMatch")], PAIR)))
    with pytest.raises(feedback.LabelsRefused, match="two splits"):
        feedback.assignments(pairs, known.union(spark.createDataFrame([("a", "train")], known.schema)))


def test_training_from_reviews(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", f"p{i}", f"l{i}", f"r{i}", y, i, x) for i in range(160) for y in [rng.choice(["Match", "NonMatch"])] for x in [(y == "Match") * 0.6 + rng.random() * 0.3]]
    df = spark.createDataFrame(rows, "evaluation_id string, pair_key string, left_source string, right_source string, human_label string, seq long, x double")
    ends = df.select("left_source").union(df.select("right_source")).toDF("source")
    known = ends.withColumn("split", F.when(F.substring("source", -1, 1) < "6", "train").otherwise("validation"))
    fitted, assigned = feedback.train_from_reviews(df, ["x"], known)
    assert fitted["weights"]["x"] > 0 and assigned.count() == 320
    with pytest.raises(feedback.LabelsRefused):
        feedback.train_from_reviews(df.where("human_label = 'Match'"), ["x"], known)


def test_baseline_against_a_loop(spark):
    s = spark.createDataFrame(DEMO, SUP)
    want = {(a[0], b[0]) for a, b in combinations(DEMO, 2) if a[2] == b[2] and a[1].split()[0] == b[1].split()[0]}
    pairs = benchmark.baseline_pairs(s)
    assert {tuple(r) for r in pairs.collect()} == want
    key = lambda n: " ".join(w for w in n.lower().split() if w not in ("ltd", "limited", "inc", "llc", "gmbh"))
    names = {r[0]: key(r[1]) for r in DEMO}
    assert {tuple(r) for r in benchmark.baseline_matches(s, pairs).collect()} == {p for p in want if SequenceMatcher(None, names[p[0]], names[p[1]]).ratio() >= 0.88}
    with pytest.raises(match.BudgetExceeded):
        benchmark.baseline_pairs(s, limit=2)
    assert benchmark.baseline_pairs(s.limit(0)).count() == 0


def test_benchmark_counts(spark):
    s = spark.createDataFrame(DEMO, SUP).withColumn("address", F.lit(""))
    true = spark.createDataFrame([("SUP-001", "SUP-002"), ("SUP-005", "SUP-006"), ("SUP-001", "SUP-010")], "left_id string, right_id string")
    rows = {r.method: r for r in benchmark.benchmark(s, true).collect()}
    assert rows["baseline"].positives == 3 and rows["baseline"].retrieved == 2 and rows["baseline"].tp == 2 and rows["indexed"].fn == 3 - rows["indexed"].tp
    none = {r.method: r for r in benchmark.candidate_recall(true.limit(0), baseline=true).collect()}
    assert none["baseline"].recall is None and none["baseline"].positives == 0
    pairs = spark.createDataFrame([("S1-a", "S2-b"), ("S1-a", "S1-b"), ("S2-a", "S3-b")], "left_id string, right_id string")
    assert [tuple(r) for r in benchmark.cross_source(pairs).collect()] == [("S1-a", "S2-b")]


def test_groups_of_companies(spark):
    rows = [("c1", "alpha", 1), ("c1", "alpha", 2), ("c2", "alpha", 3), ("c3", "beta", 4), *[("c4", f"n{i}", i) for i in range(9)]]
    df = spark.createDataFrame(rows, "company string, name string, v int")
    assert {tuple(r) for r in benchmark.unusable_groups(df, "company", "name").collect()} == {("c1", "name_collision"), ("c2", "name_collision"), ("c4", "oversized_variants")}
    one = sorted(map(tuple, benchmark.representatives(df, "company", "name").collect()))
    assert len(one) == 12 and one == sorted(map(tuple, benchmark.representatives(df.repartition(3).orderBy(F.desc("v")), "company", "name").collect()))


def test_labelled_pairs_refuse_leaks(spark):
    rows = [(f"r{g}{i}", f"Company Number{g} {x}", "ZZ", "", "", "", f"g{g}", ("train", "validation", "test")[g % 3]) for g in range(6) for i, x in enumerate(("Works", "Worker"))]
    df = spark.createDataFrame(rows, "supplier_id string, name string, country string, registration_id string, tax_id string, postcode string, grp string, split string").withColumn("address", F.lit(""))
    got = benchmark.labelled_pairs(df, "grp", "split").collect()
    assert {(r.left_id, r.right_id) for r in got if r.y == 1} == {(f"r{g}0", f"r{g}1") for g in range(6)} and all({r.left_id[1], r.right_id[1]} <= {"0", "3"} for r in got if r.split == "train")
    with pytest.raises(ValueError, match="identifiers"):
        benchmark.labelled_pairs(df.withColumn("tax_id", F.lit("GB1")), "grp", "split")
    with pytest.raises(ValueError, match="two splits"):
        benchmark.labelled_pairs(df.withColumn("grp", F.lit("g")), "grp", "split")


def test_calibration_equals_a_plain_descent(spark):
    rng = random.Random(1)
    rows = [(i, s, (i * 7 % 20) / 20, int(rng.random() < (i * 7 % 20) / 20)) for s in ("train", "validation", "test") for i in range(60)]
    df = spark.createDataFrame([(f"{s}{i}", s, x, y) for i, s, x, y in rows], "group string, split string, score double, y int")
    got = model.fit_calibration(df, "score", "y")
    x, y = (np.array([r[k] for r in rows if r[1] == "train"], float) for k in (2, 3))
    a, b = 1.0, 0.0
    for _ in range(1500):
        e = 1 / (1 + np.exp(-(a * x + b))) - y
        a, b = a - 0.5 * ((e * x).mean() + got["penalty"] * a), b - 0.5 * e.mean()
    assert got["slope"] == pytest.approx(a) and got["intercept"] == pytest.approx(b) and got["training_rows"] == 60
    with pytest.raises(ValueError, match="ten rows"):
        model.fit_calibration(df.where("split <> 'test'"), "score", "y")
    with pytest.raises(ValueError, match="0..1"):
        model.fit_calibration(df.withColumn("score", F.col("score") + 2), "score", "y")


def test_keys_and_counts_of_a_mapping(spark):
    df = spark.createDataFrame([("7", "v1", " 2024-01-02"), ("7", "v2", "2024-01-02"), ("a:b", "v1", "2024-01-02"), ("", "v3", "2024-01-02")], "doc string, vendor string, day string")
    m = profile.SourceMapping("spend", {"invoice_id": "doc", "supplier_id": "vendor", "invoice_date": "day"}, {"supplier_id": ["upper"]}, source_system="E", invoice_key_scope="supplier")
    rows = profile.with_keys(profile.apply_mapping(df, m), m).collect()
    assert [(r.supplier_id, r.invoice_id) for r in rows if r.rejected_reason is None] == [("E:V1", "E:V1:7"), ("E:V2", "E:V2:7"), ("E:V3", "")]
    assert {r.field: r.changed for r in profile.change_counts(df, m).collect()} == {"invoice_id": 0, "supplier_id": 4, "invoice_date": 0}
    flat = profile.SourceMapping("spend", m.columns, source_system="E")
    assert [r.invoice_id for r in profile.key_conflicts(profile.with_keys(profile.apply_mapping(df.where("doc = '7'"), flat), flat), "invoice_id").collect()] == ["E:7"]


def test_optional_and_auxiliary_headers(spark):
    s = spark.createDataFrame([("1", "A", "GB", "x", "y")], "LIFNR string, NAME1 string, LAND1 string, STRAS string, `LEI Code` string")
    assert profile.infer_mapping(s, "suppliers").columns == {"supplier_id": "LIFNR", "name": "NAME1", "country": "LAND1", "address": "STRAS", "lei": "LEI Code"}
    v = spark.createDataFrame([("1", "A", "10.00", "2.00", "12.00")], "invoiceno string, vendorid string, net string, vat string, gross string")
    assert profile.infer_mapping(v, "spend").auxiliary == {"tax_amount": "vat", "gross_amount": "gross"}


def test_newly_grouped(spark):
    kind = "supplier_id string, entity_id string"
    now = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "z"), ("f", "w"), ("g", "w")], kind)
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("f", "5"), ("g", "5")], kind)
    assert {r.entity_id: r.newly_grouped for r in risk.newly_grouped(now, before).collect()} == {"x": True, "y": False, "z": False, "w": False}


def test_chain_coverage_and_stale_flag(spark):
    e = spark.createDataFrame([("c", i, f"t{i}", "e", f"p{i}") for i in range(6)], "chain string, sequence long, timestamp string, event string, payload string")
    chained = evidence.chain(e)
    assert tuple(evidence.chain_coverage(e, chained, "chain", "sequence").first()) == (6, 6, 0, 0, 0)
    bent = e.where("sequence <> 2").withColumn("payload", F.when(F.col("sequence") == 4, "x").otherwise(F.col("payload")))
    assert tuple(evidence.chain_coverage(bent, chained.where("sequence <> 5"), "chain", "sequence").first()) == (5, 5, 1, 1, 1)
    actions = spark.createDataFrame([("1", "s1"), ("2", "s2"), ("3", None)], "id string, snapshot_id string")
    assert [r.stale for r in evidence.with_stale(actions, "s2").orderBy("id").collect()] == [True, False, True]
    rows, total = evidence.page_with_total(e, 2, 1, "sequence")
    assert (rows.count(), total) == (2, 6)


def test_broken_links_are_found(spark):
    e = spark.createDataFrame([("c", i, f"t{i}", "e", f"p{i}") for i in range(6)], "chain string, sequence long, timestamp string, event string, payload string")
    bent = evidence.chain(e).withColumn("payload", F.when(F.col("sequence") == 3, "x").otherwise(F.col("payload")))
    assert [r.sequence for r in evidence.broken_links(bent).collect()] == [3]
    assert [r.sequence for r in evidence.broken_links(evidence.chain(e).where("sequence <> 3")).collect()] == [4]


def test_neighborhood_tells_what_it_left_out(spark):
    e = spark.createDataFrame([("a", f"n{i}") for i in range(5)] + [("n0", f"m{i}") for i in range(9)], "source string, target string")
    rows, truncated = graph.neighborhood(e, "a", hops=2, max_posting=6)
    assert {r.node_id: r.expanded for r in rows.collect()} == {"n0": False, "n1": True, "n2": True, "n3": True, "n4": True} and not truncated
    rows, truncated = graph.neighborhood(e, "a", hops=2, limit=7)
    assert rows.count() == 7 and truncated


def test_grouped_truth(spark, tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for i, rows in enumerate(("S1-1\tAlpha\tx\tGB\nS1-2\tBeta\t\tUS\n", "S2-1\tAlfa\tx\tGB\n", "S3-9\tBetta\ty\tUS\nS3-5\tother\ty\tUS\n")):
        (tmp_path / f"s{i}.tsv").write_text(head + rows)
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\tS3-9, \n")
    sources = [str(tmp_path / f"s{i}.tsv") for i in range(3)]
    records, pairs = readers.read_grouped_truth(spark, sources, str(truth), 10)
    assert {r.supplier_id: r.group for r in records.collect()} == {"S1-1": "S1-1", "S2-1": "S1-1", "S1-2": "S1-2", "S3-9": "S1-2"} and {tuple(r) for r in pairs.collect()} == {("S1-1", "S2-1"), ("S1-2", "S3-9")}
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\tS2-1\n")
    with pytest.raises(ValueError, match="several"):
        readers.read_grouped_truth(spark, sources, str(truth), 10)
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-77\n")
    with pytest.raises(ValueError, match="lack"):
        readers.read_grouped_truth(spark, sources, str(truth), 10)


def test_labels_and_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "c", "train", 0.5, "Match", ["g"])], "evaluation_id string, config_id string, split string, similarity_score double, human_label string, entity_group_ids array<string>")
    assert sinks.export_labels(rows, str(tmp_path / "l")) == 1 and readers.read_labels(spark, str(tmp_path / "l")).first().human_label == "Match"
    assert sinks.export_labels(rows, str(tmp_path / "p"), "parquet") == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.export_labels(rows, str(tmp_path / "l"))
    sinks.export_labels(rows.withColumn("human_label", F.lit("Unsure")), str(tmp_path / "u"))
    with pytest.raises(ValueError):
        readers.read_labels(spark, str(tmp_path / "u"))
    at = str(tmp_path / "m.json")
    sinks.write_json(spark, at, {"a": 1})
    sinks.write_json(spark, at, {"a": "é"})
    assert sinks.read_json(spark, at) == {"a": "é"} and not list(tmp_path.glob("*.tmp"))


def test_prepared_dataset(spark, tmp_path):
    df = spark.createDataFrame([("1", 'A "q", \\ B\nC', " x "), ("2", "", None)], "supplier_id string, name string, country string")
    root = str(tmp_path / "prep")
    sinks.write_prepared({"suppliers": df}, root, {"suppliers": {"name": "NAME1"}})
    assert sorted(map(tuple, sinks.read_prepared(spark, root)["suppliers"].collect())) == [("1", 'A "q", \\ B\nC', " x "), ("2", "", "")]
    part = next(p for p in (tmp_path / "prep" / "suppliers").glob("part-*") if "q" in p.read_text())
    part.write_text(part.read_text().replace("q", "z"))
    for crc in (tmp_path / "prep" / "suppliers").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(sinks.PreparedRefused):
        sinks.read_prepared(spark, root)


def test_files_digest(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    paths = [str(tmp_path / k) for k in "ab"]
    first = readers.files_digest(spark, *paths)
    assert first == readers.files_digest(spark, *paths[::-1])
    (tmp_path / "b").write_text("z")
    assert readers.files_digest(spark, *paths) != first
