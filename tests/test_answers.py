"""Questions, certificates, the dashboard and what else has no test of its own."""

from dataclasses import replace
from datetime import date, datetime, timezone
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fundflow.functions import codecs, metadata
from fundflow.operators import assistant, evidence, flow, forensics, motifs, store
from fundflow.plans import shared
from fundflow.sources import chains
from helpers import legs

A, B, C = (f"0x{n:040x}" for n in (1, 2, 3))


@pytest.fixture(scope="module")
def tables(spark):
    t = legs(spark, [(A, B, 100, 0, "0x" + "a" * 64), (B, C, 90, 60), (A, B, 10, 90_000)])
    raw = t.select("tx_hash", "chain", "block_number", "timestamp", "from_address", "to_address", (F.col("value_usd") * 1e18).cast("decimal(30,0)").cast("string").alias("value"), "value_usd", F.lit(None).cast("string").alias("token_address"), F.lit(None).cast("string").alias("token_symbol"), F.lit("transfer").alias("method"))
    wallets = spark.createDataFrame([(7, 1, A, "ethereum", "pending", 80.0)], "wallet_id long, case_id long, address string, chain string, attribution_status string, risk_score double")
    cases = spark.createDataFrame([(1, "TRX-20240101-0001", "open")], "case_id long, case_number string, status string")
    entities = spark.createDataFrame([("Some Exchange", "exchange", C, "Ethereum", "CONFIRMED")], "name string, entity_type string, address string, chain string, confidence string")
    return assistant.Tables(t, raw, wallets, cases, entities, "2024-02-01 00:00:00")


def test_every_kind_of_question_is_answered(spark, tables):
    asked = {
        1: f"How risky is wallet {A}?", 2: f"Where did the money of {A} flow to?", 3: f"Who owns the address {C}?", 4: f"history of transactions of {A}", 5: f"Compare wallet {A} and wallet {B}",
        6: "case TRX-20240101-0001, a summary", 7: f"Which exchange is {A} attributed to?", 8: "any structuring", 9: " 12 ", 10: None, 11: "Who owns this address?", 12: f"Who owns the address {'0x' + 'f' * 40}?",
        13: f"risk of the wallet behind 0x{'A' * 64}", 14: "case TRX-20240101-9999, a summary",
        15: "Please sing me a song", 16: "hello", 17: "Risk of the wallets of case TRX-20240101-0001", 18: "risk of the wallets of case TRX-20240101-9999", 19: "Any rapid movement in case TRX-20240101-0001?",
        20: "structuring in case TRX-20240101-9999", 21: "tell me about case status", 22: "risk of a wallet",
    }
    got = {r.id: r for r in assistant.answers(spark.createDataFrame(list(asked.items()), "id long, text string"), tables).collect()}
    assert {i: r.kind for i, r in got.items()} == {1: "risk_summary", 2: "fund_flow", 3: "entity_lookup", 4: "timeline", 5: "comparison", 6: "case_overview", 7: "attribution", 8: "pattern_detection", 9: "general", 10: "general", 11: "entity_lookup", 12: "entity_lookup", 13: "risk_summary", 14: "case_overview",
        15: "general", 16: "general", 17: "risk_summary", 18: "risk_summary", 19: "pattern_detection", 20: "pattern_detection", 21: "case_overview", 22: "risk_summary"}
    assert got[2].answer == f"Wallet {A} sent 110.00 USD in 2 transactions and got 0.00 USD in 0. Nearest service: Some Exchange, 2 hops away."
    assert got[3].answer == f"{C} belongs to Some Exchange (exchange, CONFIRMED)." and "2 transfers on 2 days, most on 2024-01-01 (1)" in got[4].answer
    assert got[5].answer == f"{A} moved 110.00 USD, {B} 200.00 USD." and got[6].answer == "Case TRX-20240101-0001 is open: 1 wallets, 1 of high risk."
    assert "Some Exchange" in got[7].answer and "rapid movement" in got[8].answer and "risk summary" in got[9].answer
    assert got[17].answer == "Case TRX-20240101-0001 has 1 wallets with an average risk of 80.0: 1 critical, 0 medium, 0 low; 0 are attributed." and got[18].answer == got[20].answer == got[14].answer
    assert "1 rapid movement" in got[19].answer and "with wallets of case TRX-20240101-0001" in got[19].answer and got[15].answer == got[9].answer and got[22].answer.startswith("Name a wallet")
    assert {i for i, r in got.items() if r.confidence == "UNKNOWN"} == {9, 10, 11, 12, 14, 15, 16, 18, 20, 21, 22} and got[13].target == A and got[13].answer == got[1].answer
    assert assistant.answers(spark.createDataFrame([], "id long, text string"), tables).count() == 0


def test_certificates(spark):
    at = datetime(2024, 1, 2, 3, 4, 5)
    rows = [(i, codecs.hashlib.sha256(str(i).encode()).hexdigest()) for i in range(5)]
    hashes = spark.createDataFrame(rows, "position long, record_hash string")
    made, chain = evidence.certificate(hashes, "TRX-1", "Officer", at), evidence.hash_chain(hashes)
    row = made.first()
    assert row.certificate_id == f"TRX-S63-20240102-{row.merkle_root[:10].upper()}" and row.record_count == 5 and row.chain_tip == chain.orderBy(F.desc("position")).first().link
    assert evidence.verify_certificate(made, chain, hashes).count() == 0
    edited = made.withColumn("declaration", F.lit("other"))
    assert [r.problem for r in evidence.verify_certificate(edited, chain, hashes).collect()] == ["declaration"]
    less = hashes.where("position <> 3")
    assert {(r.problem, r.position) for r in evidence.verify_certificate(made, chain, less).collect()} == {("missing", 3), ("chain", 3), ("record_count", None), ("merkle_root", None), ("chain_tip", None)}
    assert evidence.certificate(hashes.limit(0), "TRX-1", "Officer", at).first().merkle_root == evidence.EMPTY


def test_transfers_are_made_once(spark, tables, monkeypatch):
    """Handlers of several kinds read one table of transfers, not its sources."""
    made, stored = [], assistant.stored
    monkeypatch.setattr(assistant, "stored", lambda df, name: made.append(name) or stored(df, name))
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    t = replace(tables, transfers=tables.transfers.mapInArrow(seen, tables.transfers.schema))
    texts = {1: f"Compare wallet {A} and wallet {B}", 2: f"history of transactions of {A}", 3: f"Where did the money of {A} flow to?"}
    ask = lambda *ids: assistant.answers(spark.createDataFrame([(i, texts[i]) for i in ids], "id long, text string"), t).collect()
    several = {r.id: r.answer for r in ask(1, 2, 3)}
    assert made == ["questions", "asked-transfers"] and reads.value == 3
    assert several == {r.id: r.answer for i in texts for r in ask(i)} and "asked-transfers" not in made[2:]


def test_dashboard(spark, tables):
    fan = [("s", f"m{i}", 40, i, f"i{i}") for i in range(4)] + [(f"m{i}", "t", 39, 60 + i, f"o{i}") for i in range(4)]
    t = legs(spark, fan)
    risky = spark.createDataFrame([("s", 90.0)], "address string, risk_score double")
    row = forensics.summary(t, risky).first()
    assert row.transfer_count == 8 and row.address_count == 6 and row.motif_counts == {"fan_out_fan_in": 1} and row.top_motifs[0].motif == "fan_out_fan_in"
    assert row.largest_cluster == 5 and row.tainted_address_count == 6 and row.top_destinations[0].address == "s"


def test_bounds():
    assert forensics.checked("taint", max_hops=12, top_n=1) == {"max_hops": 12, "top_n": 1}
    for request, values in (("taint", {"max_hops": 13}), ("taint", {"top_n": 0}), ("flow", {"max_hops": 16}), ("motifs", {"depth": 1})):
        with pytest.raises(ValueError):
            forensics.checked(request, **values)


def test_requests_are_checked(tables):
    assert forensics.requested("flow", tables, source=A, target=C, max_hops=3).first().hops == 2
    assert forensics.requested("attributions", tables, start=A, max_hops=2).first().name == "Some Exchange"
    assert forensics.requested("transactions", tables, address=B, page=1, page_size=2).count() == 2
    assert forensics.requested("clusters", tables, window_seconds=60).count() == 0 and forensics.requested("motifs", tables, max_cycle_length=3).count() == 0
    for request, values in (("attributions", {"start": A, "max_hops": 11}), ("listing", {"page_size": 101}), ("paths", {"start": A, "hops": 1})):
        with pytest.raises(ValueError):
            forensics.requested(request, tables, **values)


def test_canonical_values():
    at = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    value = {"b": at, "a": Decimal("1.10"), "c": b"\x01\xff", "d": {"y", "x"}, "e": date(2024, 1, 2), "f": at.replace(tzinfo=None), "é": None}
    assert codecs.canonical_json(value) == '{"a":"1.10","b":"2024-01-01T12:00:00Z","c":"0x01ff","d":["x","y"],"e":"2024-01-02","f":"2024-01-01T12:00:00Z","é":null}'
    good = codecs.checksum_address("0x" + "ab" * 20)
    assert codecs.is_evm(good) and codecs.is_evm(good.lower()) and not codecs.is_evm(good.swapcase().replace("0X", "0x")) and not codecs.is_evm("0x12") and not codecs.is_evm(None)


def test_bounds_of_shapes_can_be_lifted(spark):
    """Twelve transfers on one edge: the ninth is beyond the default bound."""
    rows = [("s", "m", 100, i, f"a{i:02d}") for i in range(12)] + [("m", "t", 100, 1000 + 1, "out")]
    t = legs(spark, rows)
    best = lambda most: motifs.mule_hops(t, 1800, 1, tx_per_edge=most).first().hash_in
    assert best(motifs.TX_PER_EDGE) == "a07" and best(None) == "a11"
    many = legs(spark, [e for i in range(7) for e in (("s", f"m{i}", 10, 0), (f"m{i}", "t", 10, 1))])
    cut = flow.cut_edges(many, flow.max_flow(many, "s", "t")).collect()
    assert len(cut) == 7 and all(r.tx_count == 1 and len(r.tx_hashes) == 1 and r.capacity_usd == 10 for r in cut)
    assert len(flow.max_flow(many, "s", "t").first().paths) == 5 and len(flow.max_flow(many, "s", "t", None).first().paths) == 7


def test_no_table_in_a_local_folder_of_a_cluster():
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session, "x")


def test_metadata_of_any_kind(spark):
    texts = ['{"k": 3, "s": "x"}', '{"k": "no"}', '{"k": 3', "[1]", "", None, '"{}"', '{"s": {"k": 1}}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    got = {r.i: (r.k, r.s) for r in metadata.with_fields(rows, "m", k="long", s="string").collect()}
    assert got[0] == (3, "x") and all(got[i] == (None, None) for i in range(1, 7)) and got[7][0] is None
    assert {r.i for r in rows.where(metadata.is_object(F.col("m"))).collect()} == {0, 1, 7}


def test_intelligence(spark):
    bodies = [(A.upper().replace("0X", "0x"), '{"category": "sanctions", "riskScore": 99, "tags": ["t"]}'), (A, '{"name": "n", "riskScore": 5}'), (B, "<html>"), (C, '{"name": "Shop", "riskScore": "high"}')]
    known = chains.intelligence(spark.createDataFrame([(a, "Ethereum", b) for a, b in bodies], "address string, chain string, body string"))
    rows = {r.entity_name: r for r in known.collect()}
    assert rows["sanctions"].tags == ["t"] and rows["sanctions"].is_sanctioned and rows["Shop"].risk_score is None and rows[None].failed and rows["n"].tags == []
    own = spark.createDataFrame([(1, A), (2, B), (3, "0x9")], "wallet_id int, address string").withColumn("risk_score", F.lit(1.0))
    got = {r.wallet_id: (r.risk_score, r.is_sanctioned, r.failed) for r in store.with_intelligence(own, known).collect()}
    assert got == {1: (99.0, True, False), 2: (None, False, True), 3: (None, False, None)}


def test_report_sections(spark, tables):
    cases = tables.cases.withColumns({"title": F.lit("T"), "crime_type": F.lit("fraud")}).unionByName(spark.createDataFrame([(2, "TRX-2", "open", "U", "theft")], "case_id long, case_number string, status string, title string, crime_type string"))
    runs = spark.createDataFrame([(1, 1, "failed", 1, "{}"), (2, 1, "completed", 2, None)], "run_id int, case_id long, status string, started_at int, result_summary string")
    rows = sorted(map(tuple, store.report_sections(cases, tables.wallets, runs).collect()))
    assert rows == [
        (1, 1, "Case Overview", 1, "Case TRX-20240101-0001: T"), (1, 1, "Case Overview", 2, "Crime type: fraud"), (1, 1, "Case Overview", 3, "Status: open"),
        (1, 2, "Tracked Wallets", 1, f"- {A} (ethereum) - risk score 80.00, attribution: pending"), (1, 3, "Investigation Findings", 1, "Investigation status: completed"), (1, 3, "Investigation Findings", 2, "{}"),
        (2, 1, "Case Overview", 1, "Case TRX-2: U"), (2, 1, "Case Overview", 2, "Crime type: theft"), (2, 1, "Case Overview", 3, "Status: open"), (2, 2, "Tracked Wallets", 1, "No wallets tracked in this case."),
    ]
