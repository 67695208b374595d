import hashlib

from fundflow.functions import codecs
from fundflow.operators import evidence, router
from fundflow.sources import chains


def coins(*rows):
    return [{"address": a, "value": v} for a, v in rows]


def test_utxo(spark):
    kind = "txid string, fee long, is_coinbase boolean, inputs array<struct<address: string, value: long>>, outputs array<struct<address: string, value: long>>"
    rows = [
        ("one", None, False, coins(("a", 100)), coins(("b", 90))),
        ("change", None, False, coins(("a", 100)), coins(("b", 60), ("a", 35))),
        ("many", 3, False, coins(("a", 60), ("c", 40)), coins(("x", 70), ("y", 27), (None, 0))),
        ("mint", None, True, [], coins(("m", 50))),
        ("nothing", None, False, coins(("a", 5)), []),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {}
    for r in chains.utxo_legs(df).orderBy("txid", "leg_index").collect():
        got.setdefault(r.txid, []).append((r.from_address, r.to_address, int(r.value)))
    assert got == {"one": [("a", "b", 90)], "change": [("a", "b", 60)], "many": [("a", "x", 42), ("c", "x", 28), ("a", "y", 16), ("c", "y", 10)], "mint": [("COINBASE", "m", 50)]}
    assert {r.txid: r.fee for r in chains.utxo_fees(df).collect()}["many"] == 3


def test_tokens_and_calls(spark):
    kind = "transaction_id string, block_timestamp long, `from` string, `to` string, value string, token_info struct<address: string, symbol: string, decimals: int>"
    rows = [("t1", 1700000000000, "a", "b", "2500000", ("T", "USDT", 6)), ("t2", 1700000000000, "a", "b", "7", ("Q", "??", None))]
    assert [r.value for r in chains.trc20_legs(spark.createDataFrame(rows, kind)).orderBy("tx_hash").collect()] == [2.5, 7.0]
    data = "a9059cbb" + "00" * 12 + "11" * 20 + hex(10**30)[2:].rjust(64, "0")
    r = chains.call_transfers(spark.createDataFrame([("c1", data), ("c2", "ffff")], "tx_hash string, data string")).collect()
    assert len(r) == 1 and r[0].value == str(10**30) and codecs.is_tron(r[0].to_address)


def test_sanctions_list(spark):
    row = ["7", "EVIL CO", "x", "[CYBER2]", *[""] * 7, "Digital Currency Address - ETH 0xAbC1; Digital Currency Address - XBT 1abc; Digital Currency Address - ETH 0xabc1"]
    got = chains.sanctioned(spark.createDataFrame([row], ", ".join(f"_c{i} string" for i in range(12)))).collect()
    assert [(r.name, r.address, r.chain, r.program) for r in got] == [("OFAC: EVIL CO", "0xAbC1", "Ethereum", "CYBER2")]


def test_codecs():
    assert codecs.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert codecs.checksum_address("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed") == "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"
    assert codecs.is_bitcoin("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa") and codecs.is_bitcoin("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4")
    assert not codecs.is_bitcoin("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb") and not codecs.is_tron(None) and codecs.checksum_address("0x12") is None
    assert codecs.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_evidence(spark):
    for n in range(6):
        hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        level = hashes or [evidence.EMPTY]
        while len(level) > 1:
            level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
        df = spark.createDataFrame([(i * 10, h) for i, h in enumerate(hashes)], "position long, record_hash string")
        assert evidence.merkle_root(df).first().merkle_root == level[0]
    link = evidence.EMPTY
    for r in evidence.hash_chain(df).orderBy("position").collect():
        link = hashlib.sha256((link + r.record_hash).encode()).hexdigest()
        assert r.link == link
    bad = spark.createDataFrame([(0, hashes[0]), (10, "x"), (99, "y")], "position long, record_hash string")
    assert {(r.position, r.problem) for r in evidence.verify(df, bad).collect()} == {(10, "changed"), (20, "missing"), (30, "missing"), (40, "missing"), (99, "added")}


def test_questions(spark):
    asked = {
        "risk score for wallet 0x123": "risk_summary", "how risky is this address": "risk_summary", "which exchange did the money end up at": "attribution",
        "detect peel chains": "pattern_detection", "suspicious patterns on Ethereum": "pattern_detection", "trace the money from wallet": "fund_flow", "follow the money": "fund_flow",
        "who owns address 0xabc": "entity_lookup", "tell me about case TRX-20240115-0042": "case_overview", "anything": "case_overview", "show me transaction timeline for wallet": "timeline", "compare wallet A versus wallet B": "comparison",
    }
    got = router.classify(spark.createDataFrame([(q,) for q in asked], "text string"))
    assert {r.text: r.kind for r in got.collect()} == asked
    address, tx = "0x" + "ab" * 20, "0x" + "cd" * 32
    r = router.classify(spark.createDataFrame([(f"{tx} and {address} on polygon, case trx-20240115-0042",), (None,)], "text string")).collect()
    assert (r[0].tx_hash, r[0].address, r[0].chain, r[0].case_number) == (tx, address, "Polygon", "trx-20240115-0042") and r[1].address is None
