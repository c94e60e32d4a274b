"""Published registers, awards and payments, bounded loading, model artifacts and the checks before a split."""

import gzip
import hashlib
import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from ledgerweave.operators import benchmark, evidence, graph, match, model, profile
from ledgerweave.sources import demo, readers, sinks


def test_demo_source(spark):
    suppliers, spend = demo.demo(spark)
    assert suppliers.columns == list(readers.SUPPLIER_FIELDS) and spend.columns == list(readers.SPEND_FIELDS)
    assert (suppliers.count(), spend.count()) == (10, 12) and spend.join(suppliers, "supplier_id", "left_anti").isEmpty()


def test_bounded_loader(tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,2\n")
    assert readers.load_bytes(tmp_path / "a.csv") == readers.load_bytes(str(tmp_path / "a.csv")) == readers.load_bytes("a,b\n1,2\n") == b"a,b\n1,2\n"
    assert readers.load_bytes(bytearray(b"x")) == b"x" and readers.load_bytes("no such file") == b"no such file"
    for source in (tmp_path / "a.csv", "a,b\n1,2\n", b"a,b\n1,2\n"):
        with pytest.raises(readers.SourceRefused):
            readers.load_bytes(source, 3)
    with pytest.raises(readers.SourceRefused):
        readers.load_bytes(5)


def test_header_row():
    body = [["1", "x", "2.50"], ["2", "y", "3"]]
    assert readers.find_header_row([["Report", "", ""], ["", "", ""], ["Id", "Name", "Amount"], *body, *body]) == 2
    assert readers.find_header_row([["Id", "Name", "Amount"], *body]) == 0
    assert readers.find_header_row([["Id", "I-d", "Amount"], *body]) == 0  # none fits: the first
    assert readers.find_header_row([["Id", "Name", "Amount", ""], *body]) == 0
    assert readers.find_header_row([]) == 0


def test_delimited_header_is_whole(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Id,I-d\n1,2\n3,4\n")
    with pytest.raises(readers.SourceRefused):
        readers.read_delimited(spark, str(tmp_path / "d.csv"))


def _entity(lei, name, *others, city="Leeds"):
    return {"id": lei, "attributes": {"entity": {"legalName": {"name": name}, "otherNames": [{"name": n, "type": t} for n, t in others], "legalAddress": {"addressLines": ["1 Mill Row"], "city": city, "country": "GB", "postalCode": "LS1"}}}}


def test_gleif_pages(spark, tmp_path):
    was, alternative, trading = "PREVIOUS_LEGAL_NAME", "ALTERNATIVE_LEGAL_NAME", "TRADING_OR_OPERATING_NAME"
    one = _entity("L1", "Alpha Ltd", ("Alpha Limited", was), ("Beta", was), ("Gamma", alternative), ("Delta", trading), ("Beta Ltd", alternative), ("Epsilon", None))
    bare = {"id": "L3", "attributes": {"entity": {"legalName": {"name": "Zeta"}, "legalAddress": {}}}}
    (tmp_path / "page-1.json").write_text(json.dumps({"data": [one]}))
    (tmp_path / "page-2.json").write_text(json.dumps({"data": [_entity("L2", "Beta"), bare]}))
    rows = {(r.lei, r.supplier_id[-2:]): r for r in readers.read_gleif(spark, str(tmp_path)).collect()}
    assert {k: r.name for k, r in rows.items()} == {("L1", ":0"): "Alpha Ltd", ("L1", ":1"): "Beta", ("L1", ":2"): "Gamma", ("L2", ":0"): "Beta", ("L3", ":0"): "Zeta"}
    assert rows["L1", ":0"].supplier_id[:-2] == hashlib.sha256(b"L1").hexdigest()[:24] and rows["L1", ":1"].address == "1 Mill Row Leeds" and rows["L3", ":0"].postcode == ""
    (tmp_path / "page-3.json").write_text(json.dumps({"data": [_entity("L2", "Again")]}))
    with pytest.raises(readers.SourceRefused):
        readers.read_gleif(spark, str(tmp_path))


def _party(pid, name="Alpha Ltd", company="01234567", scheme="GB-COH", roles=("supplier",), street="1 Mill Row", **more):
    return {"id": pid, "name": name, "roles": list(roles), "identifier": {"scheme": scheme, "id": company}, "address": {"streetAddress": street, "postalCode": "LS1"}} | more


def _process(ocid, *parties, status="active", ids=None):
    return {"ocid": ocid, "awards": [{"status": status, "suppliers": [{"id": i} for i in (ids or [p["id"] for p in parties])]}], "parties": list(parties)}


def test_award_suppliers(spark, tmp_path):
    processes = [
        _process("o1", _party("p1"), _party("p1"), _party("p2", name="Beta plc", company=" sc123456 ")),
        _process("o2", _party("p1"), _party("p1", telephone="5"), ids=["p1"]),  # ambiguous
        _process("o3", _party("p1"), status="cancelled"),
        _process("o4", _party("p1", roles=("buyer",)), ids=["p1", "p9"]),  # both unjoined
        _process("o5", _party("a", scheme="XX"), _party("b", company="11111111"), _party("c", name=" "), _party("d", street="x" * 1001), _party("e", name="n" * 1001)),
        _process("o6", _party("p1", name="ALPHA LIMITED", street="2 Mill Row")),  # the same company and name key as o1
        _process("o7", _party("p1", name="Beta PLC", company="76543210")),
        {"ocid": "o8"},
    ]
    path = tmp_path / "awards.jsonl.gz"
    path.write_bytes(gzip.compress("\n".join(map(json.dumps, processes)).encode()))
    counts = {r.status: r.n for r in readers.ocds_counts(spark, str(path)).collect()}
    assert counts == {"usable": 4, "ambiguous_party": 1, "unjoined": 2, "other_scheme": 1, "invalid_id": 1, "invalid_name": 2, "oversized_address": 1}
    rows = readers.read_ocds(spark, str(path))
    found = sorted((r.company_id, r.name_key) for r in rows.collect())
    assert [c for c, _ in found] == ["01234567", "76543210", "SC123456"] and found[0][1] == "alpha" and found[1][1] == found[2][1]
    assert {r.group for r in benchmark.unusable_groups(rows, "company_id", "name_key").collect()} == {"76543210", "SC123456"}
    for bad in ([{"ocid": ""}], [{"awards": []}], [{"ocid": "a"}, {"ocid": "a"}]):
        path.write_bytes(gzip.compress("\n".join(map(json.dumps, bad)).encode()))
        with pytest.raises(readers.SourceRefused):
            readers.read_ocds(spark, str(path))
    path.write_bytes(gzip.compress(b'{"ocid": "a"}\nnot json'))
    with pytest.raises(readers.SourceRefused):
        readers.read_ocds(spark, str(path))


HEADERS = {"name": "Supplier", "entity": "Entity", "amount": "Amount", "date": "Date", "transaction": "Ref", "category": "Type", "description": "Text"}


def _publication(path, body, **headers):
    path.write_bytes(body)
    return readers.Publication(path.stem, str(path), hashlib.sha256(body).hexdigest(), HEADERS | headers)


def test_payments(spark, tmp_path):
    head = "Entity,Supplier,Date,Amount,Ref,Type,Text\n"
    a = _publication(tmp_path / "dept.csv", (head + 'HQ,Alpha,01/02/26,"1,200.50",R1,Goods,Paper\nHQ,Alpha,01/02/26,"1,200.50",R1,Goods,Paper\n\nHQ,Beta,02/02/26,-7.00,R2,Goods,"two\nlines"\n').encode())
    b = _publication(tmp_path / "office.csv", "Supplier;Entity;PC;Amount;Date;Ref;Type;Text\nAlphaé;HQ;LS1;5.00;03/02/26;R1;Services;Audit\nAlphaé;HQ;LS2;6.00;03/02/26;R9;Services;Audit\n".encode("cp1252"), postcode="PC")
    lines = readers.read_payments(spark, a, b)
    rows = {r.invoice_id: r for r in lines.collect()}
    assert len(rows) == 5 and f"dept-{a.sha256[:12]}-line2" in rows and len({r.supplier_id for r in rows.values()}) == 4
    assert sorted(rows) == sorted(r.invoice_id for r in readers.read_payments(spark, b, a).repartition(7).collect())
    one = rows[f"dept-{a.sha256[:12]}-line2"]
    assert (str(one.amount), one.published_amount, one.currency, one.country, one.original["Text"]) == ("1200.50", "1,200.50", "GBP", "ZZ", "Paper")
    totals = {r.source_file: (r.lines, str(r.total), r.references, r.repeated_references) for r in profile.reconciliation(lines, "source_file").collect()}
    assert totals == {"dept.csv": (3, "2394.00", 2, 1), "office.csv": (2, "11.00", 2, 0)}
    assert readers.payment_suppliers(lines).count() == 4


@pytest.mark.parametrize("line", ["HQ,,01/02/26,5,R,T,x", ",A,01/02/26,5,R,T,x", "HQ,A,01/02/26,five,R,T,x", "HQ,A,01/02/26,5,R,T"])
def test_payments_refuse_bad_lines(spark, tmp_path, line):
    of = _publication(tmp_path / "dept.csv", f"Entity,Supplier,Date,Amount,Ref,Type,Text\nHQ,B,01/02/26,5,R,T,x\nHQ,C,01/02/26,5,R,T,x\n{line}\n".encode())
    with pytest.raises(Exception, match="no supplier|no amount|cells"):
        readers.read_payments(spark, of).collect()


def test_payments_refuse_other_bytes_and_headers(spark, tmp_path):
    of = _publication(tmp_path / "dept.csv", b"Entity,Supplier,Date,Amount,Ref,Type,Text\nHQ,B,01/02/26,5,R,T,x\n")
    (tmp_path / "dept.csv").write_bytes(b"Entity,Supplier,Date,Amount,Ref,Type,Text\nHQ,B,01/02/26,6,R,T,x\n")
    with pytest.raises(PythonException, match="receipt"):
        readers.read_payments(spark, of).collect()
    of = _publication(tmp_path / "dept.csv", b"Entity,Supplier,Day,Amount,Ref,Type,Text\nHQ,B,01/02/26,5,R,T,x\n")
    with pytest.raises(PythonException, match="headers changed"):
        readers.read_payments(spark, of).collect()
    with pytest.raises(readers.SourceRefused):
        readers.read_payments(spark, readers.Publication("p", of.path, of.sha256, {"name": "Supplier"}))


def test_records_of_the_active_snapshot(spark, tmp_path):
    root = str(tmp_path / "store")
    suppliers, _ = demo.demo(spark)
    sinks.write_snapshot({"suppliers": suppliers.orderBy(F.desc("supplier_id"))}, root)
    assert [r.supplier_id for r in sinks.records(spark, root, "suppliers").collect()] == [f"D{i:02}" for i in range(1, 11)]
    with pytest.raises(ValueError):
        sinks.records(spark, root, "metadata")


def test_configurations_refuse_what_is_out_of_range():
    for bad in ({"ngram_size": 1}, {"ngram_size": 6}, {"max_posting": 1}, {"max_posting": True}, {"max_posting": 2.5}, {"review_threshold": 0.8}, {"review_threshold": 1.2}, {"name_weight": 0}, {"address_weight": float("nan")}, {"max_feature_chars": 8}, {"soundex": 1}, {"random_seed": -1}):
        with pytest.raises(ValueError):
            match.MatchConfig(**bad)
    for bad in ({"max_posting": 1}, {"max_paths": 6}, {"max_neighbors": 0}, {"max_expansions": True}):
        with pytest.raises(ValueError):
            graph.GraphPolicy(**bad)
    assert match.MatchConfig().config_id == match.MatchConfig().config_id != match.MatchConfig(soundex=False).config_id
    assert graph.GraphPolicy().policy_id != graph.GraphPolicy(max_paths=3).policy_id


def _label(i, split, label="Match", **more):
    return {"evaluation_id": f"e{i}", "pair_key": f"p{i}", "split": split, "human_label": label, "entity_group_ids": [f"g{i}"], "record_keys": [f"l{i}", f"r{i}"]} | more


LABELS = "evaluation_id string, pair_key string, split string, human_label string, entity_group_ids array<string>, record_keys array<string>"


def test_split_faults(spark):
    good = [_label(f"{s}{i}", s, ("Match", "NonMatch")[i % 2]) for s in ("train", "validation", "test") for i in range(10)]
    faults = lambda rows: {(r.fault, r.key) for r in model.split_faults(spark.createDataFrame(rows, LABELS)).collect()}
    assert faults(good) == set()
    odd = [
        _label("x", "train", record_keys=["ltest1", "x"]), _label("x", "train", pair_key="ptrain1"), _label("y", "spare"), _label("z", "test", "Unsure"), _label("w", "test", entity_group_ids=[]),
        _label("v", "test", entity_group_ids=["gtrain3", "gv"], record_keys=["a", "a"]), _label("u", "test", record_keys=None, entity_group_ids=None), _label("t", None, None, pair_key=None),
    ]
    assert faults(good + odd) == {
        ("repeated evaluation", "ex"), ("repeated pair", "ptrain1"), ("record in several splits", "ltest1"), ("unknown split", "ey"), ("unknown split", "et"), ("label", "ez"), ("label", "et"), ("no id", "et"),
        ("groups", "ew"), ("groups", "eu"), ("group in several splits", "gtrain3"), ("records", "ev"), ("records", "eu"),
    }
    assert faults(good[:9]) == {("small split or one label", s) for s in ("train", "validation", "test")}
    assert faults([]) == {("small split or one label", s) for s in ("train", "validation", "test")}


def test_model_artifact(spark):
    train = spark.createDataFrame([(0.0, 0.5), (1.0, 0.5)], "a double, b double")
    support = model.training_support(train, "a", "b")
    assert support == {"rows": 2, "ranges": {"a": [0.0, 1.0], "b": [0.5, 0.5]}, "constants": {"b": 0.5}}
    whole = model.model_artifact({"weights": {"a": 2.0, "b": 0.0}, "intercept": -1.0, "threshold": 0.7}, support, "c1", "test", {"slope": 1.0, "intercept": 0.0, "rows": 20})
    check = lambda m, c="c1": model.check_artifact(m, ("a", "b"), c, "test")
    assert check(whole) == whole == check(json.loads(json.dumps(whole)))
    seal = lambda **new: (made := whole | new) | {"model_id": model._model_id(made)}
    for bad in (
        whole | {"threshold": 0.8}, {}, [], seal(version="x"), seal(weights={"a": 1.0}), seal(weights={"a": float("inf"), "b": 0.0}), seal(weights={"a": 1.0, "b": 0.1}), seal(threshold=1.5), seal(intercept=None),
        seal(support=support | {"rows": 0}), seal(support=support | {"constants": {}}), seal(support=support | {"ranges": {"a": [1.0, 0.0], "b": [0.5, 0.5]}}), seal(calibration={"slope": -1.0, "intercept": 0.0, "rows": 20}), seal(calibration={"slope": 1.0, "intercept": 0.0, "rows": 9}),
    ):
        with pytest.raises(model.ModelRefused):
            check(bad)
    with pytest.raises(model.ModelRefused):
        check(whole, "c2")
    for rows in ([(None, 0.5)], [(float("nan"), 0.5)], [(1.1, 0.5)], []):
        with pytest.raises(model.ModelRefused):
            model.training_support(spark.createDataFrame(rows, "a double, b double"), "a", "b")


def test_dispatch_and_intents(spark):
    outbox = spark.createDataFrame([("a", 1, 0, 99.0), ("b", 1, 1, 10.0), ("c", 1, 1, 90.0), ("d", 1, 0, 5.0), ("e", 2, 1, 1.0)], "action_id string, epoch int, published_epoch int, last_published double")
    jobs = spark.createDataFrame([("a", "h", "queued"), ("b", "h", "running"), ("c", "h", "queued"), ("d", "h", "done")], "action_id string, intent_hash string, state string")
    assert [r.action_id for r in evidence.pending_dispatch(outbox, jobs, 100.0).collect()] == ["b", "a"]
    assert [r.action_id for r in evidence.pending_dispatch(outbox, jobs, 100.0, 1).collect()] == ["b"]
    actions = spark.createDataFrame([tuple("abcdefg")], ", ".join(f"{c} string" for c in evidence.INTENT_FIELDS)).withColumn("state", F.lit("staged"))
    got = evidence.intents(actions).first()
    assert got.asDict().keys() == {*evidence.INTENT_FIELDS, "intent_hash"} and len(got.intent_hash) == 64
    assert got.intent_hash != evidence.intents(actions.withColumn("payload", F.lit("z"))).first().intent_hash


def test_modal_width(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 3), ("a", 4), ("a", 4), ("b", 1)], "source string, width int")
    assert sorted(map(tuple, profile.modal_width(rows, "width", "source").collect())) == [("a", 4, 2), ("b", 1, 1)]
