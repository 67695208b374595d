"""The registered queries of the engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundflow.functions import codecs, metadata
from fundflow.functions.columns import total
from fundflow.operators import assistant, attribution, clusters, correlation, evidence, flow, forensics, graph, motifs, risk, router, store, taint, wallets
from fundflow.plans.shared import shared_dir
from fundflow.shipping import ship
from fundflow.sources import chains, pages, views
from fundflow.streaming import alerts, merges
from fundflow.streaming import taint as live_taint

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-02-15 00:00:00"
START = "0x" + "0" * 39 + "8"

# -- the views in SQL ------------------------------------------------------
_HEX = "'0x' || lpad(lower(to_hex({})), {}, '0')"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
TRANSFERS = f"""transfers AS (SELECT {_HEX.format("event_id", 64)} AS tx_hash, {_HEX.format("user_id", 40)} AS from_address, {_HEX.format(_K, 40)} AS to_address,
  value AS value_usd, ts AS timestamp, CASE WHEN event_id % 4 = 0 THEN 'Polygon' ELSE 'Ethereum' END AS chain, 'ETH' AS asset, event_id AS block_number FROM events)"""
MOVES = f"{TRANSFERS}, moves AS (SELECT * FROM transfers WHERE value_usd > 0 AND from_address <> to_address)"
TRANSACTIONS = f"""transactions AS (SELECT {_HEX.format("event_id", 64)} AS tx_hash, CASE WHEN event_id % 4 = 0 THEN 'Polygon' ELSE 'Ethereum' END AS chain, event_id AS block_number, ts AS timestamp,
  {_HEX.format("user_id", 40)} AS from_address, {_HEX.format(_K, 40)} AS to_address, CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) || '00000000000000000' AS value, CAST(value AS DECIMAL(18,2)) AS value_usd,
  CASE WHEN event_id % 7 < 2 THEN {_HEX.format("event_id % 7 + 1", 40)} END AS token_address,
  CASE WHEN event_id % 7 = 0 THEN 'USDC' WHEN event_id % 7 = 1 AND event_id % 2 = 0 THEN 'SCAMCOIN' END AS token_symbol,
  CASE event_type WHEN 'purchase' THEN 'bridgeOut' WHEN 'click' THEN 'transfer' WHEN 'signup' THEN 'swap' END AS method FROM events)"""
COSPEND = f"""cospend AS (SELECT {_HEX.format("l_orderkey", 64)} AS tx_hash, {_HEX.format("l_partkey", 40)} AS from_address, {_HEX.format("l_suppkey + 1000000", 40)} AS to_address,
  l_extendedprice AS value_usd, l_shipdate AS timestamp FROM lineitem)"""
PAYMENTS = f"""payments AS (SELECT 'UPI' || event_id AS reference_id, 'payer-' || user_id AS payer_account, 'payee-' || json_extract_string(props, '$.k') AS payee_account,
  round(value * (82 + event_id % 4), 2) AS amount_inr, ts + to_seconds(event_id % 1300 - 600) AS timestamp FROM events)"""
ENTITIES = f"""entities AS (SELECT s_name AS name, CASE s_suppkey % 10 WHEN 0 THEN 'exchange' WHEN 1 THEN 'exchange' WHEN 2 THEN 'exchange' WHEN 3 THEN 'mixer' WHEN 4 THEN 'bridge' WHEN 5 THEN 'defi' WHEN 6 THEN 'sanctioned' WHEN 7 THEN 'gambling' ELSE 'merchant' END AS entity_type,
  {_HEX.format("s_suppkey", 40)} AS address, CASE s_suppkey % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'HIGH_CONFIDENCE' ELSE 'PROBABLE' END AS confidence FROM supplier)"""
WALLETS = f"""wallets AS (SELECT o_orderkey AS wallet_id, o_custkey AS case_id, {_HEX.format("o_orderkey % 150", 40)} AS address, CASE WHEN o_orderkey % 4 = 0 THEN 'Polygon' ELSE 'Ethereum' END AS chain,
  CASE o_orderstatus WHEN 'F' THEN 'attributed' WHEN 'O' THEN 'unattributed' ELSE 'pending' END AS attribution_status, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) AS risk_score, o_orderdate AS created_at FROM orders)"""
CASES = """cases AS (SELECT c_custkey AS case_id, 'TRX-2024' || lpad(CAST(c_custkey % 1231 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS case_number, 'Case of ' || c_name AS title, lower(c_mktsegment) AS crime_type,
  CASE WHEN c_acctbal < 0 THEN 'closed' WHEN c_acctbal < 5000 THEN 'active' ELSE 'open' END AS status, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS assigned_to, to_timestamp(1700000000 + c_custkey * 3600)::TIMESTAMP AS created_at FROM customer)"""
_SUM = "CAST(sum(CAST(value_usd AS DECIMAL(38,2))) AS DOUBLE)"
_SECS = "(epoch_us({1}) - epoch_us({0})) / 1e6"
_WEIGHT = "CASE WHEN {0} > 0 AND log10({0} + 1) > 1e-6 THEN 1 / log10({0} + 1) ELSE 1e6 END"

_registry: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is its oracle where there is one."""

    def add(f: Query) -> Query:
        _registry[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transfers(spark, sf_dir)


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(START,)], "start string")


# -- scans, filters, listings ----------------------------------------------
query("transfers_normalized", f"WITH {TRANSFERS} SELECT * FROM transfers")(_t)
query("movement_filter", f"WITH {MOVES} SELECT tx_hash, from_address, to_address, value_usd FROM moves")(lambda s, d: flow.movements(_t(s, d)).select("tx_hash", "from_address", "to_address", "value_usd"))
query("address_universe", f"WITH {TRANSFERS} SELECT from_address AS address FROM transfers UNION SELECT to_address FROM transfers")(lambda s, d: wallets.addresses(_t(s, d)))
query("case_transfer_scan", f"""WITH {TRANSACTIONS}, {WALLETS}, own AS (SELECT DISTINCT address FROM wallets WHERE case_id = 7)
SELECT tx_hash, from_address, to_address, CAST(value_usd AS DOUBLE) AS value_usd, timestamp, chain, coalesce(token_symbol, 'NATIVE') AS asset, block_number FROM transactions
WHERE value_usd > 0 AND (from_address IN (SELECT address FROM own) OR to_address IN (SELECT address FROM own))
QUALIFY row_number() OVER (PARTITION BY tx_hash, from_address, to_address ORDER BY timestamp, block_number) = 1""")(lambda s, d: wallets.case_transfers(views.chain_transactions(s, d), views.wallets(s, d), case_id=7))
query("evidence_scan", f"WITH {TRANSACTIONS} SELECT tx_hash, timestamp, value_usd FROM transactions QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY timestamp, block_number) = 1")(
    lambda s, d: wallets.evidence_rows(views.chain_transactions(s, d)).select("tx_hash", "timestamp", "value_usd")
)
query("wallet_tx_page", f"""WITH {TRANSACTIONS}, mine AS (SELECT * FROM transactions WHERE from_address = '{START}' OR to_address = '{START}')
SELECT tx_hash, block_number, (SELECT count(*) FROM mine) AS total, CAST((SELECT count(*) FROM mine) + 19 AS BIGINT) // 20 AS total_pages FROM mine ORDER BY block_number DESC, tx_hash LIMIT 20 OFFSET 20""")(
    lambda s, d: wallets.wallet_transactions(views.chain_transactions(s, d), START, page=2).select("tx_hash", "block_number", "total", "total_pages")
)
query("resolve_wallet", f"WITH {WALLETS} SELECT wallet_id, address FROM wallets WHERE lower(address) = '{START}' ORDER BY wallet_id LIMIT 1")(lambda s, d: wallets.resolve_wallet(views.wallets(s, d), START.upper().replace("0X", "0x")).select("wallet_id", "address"))
query("list_cases", f"WITH {CASES} SELECT case_id, case_number, status FROM cases WHERE status IN ('open', 'active') AND lower(title) LIKE '%customer%' ORDER BY created_at DESC, case_id LIMIT 20 OFFSET 20")(
    lambda s, d: wallets.listed(views.cases(s, d), {"status": "open,active,bogus"}, {"status": ("draft", "open", "active", "closed")}, (("case_number", "title"), "Customer"), page=2).select("case_id", "case_number", "status")
)
query("list_wallets", f"WITH {WALLETS} SELECT wallet_id, case_id, address FROM wallets WHERE chain = 'Polygon' AND attribution_status = 'pending' ORDER BY created_at DESC, wallet_id LIMIT 50")(
    lambda s, d: wallets.listed(views.wallets(s, d), {"chain": "Polygon", "attribution_status": "pending"}, page_size=50).select("wallet_id", "case_id", "address")
)


@query("stale_investigations", "SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 24 HOURS THEN 'failed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status FROM orders")
def _stale(s: SparkSession, d: str) -> DataFrame:
    runs = views.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("string").alias("error_message"))
    return wallets.stale(runs, "1998-01-01").select("run_id", "status")


# -- flow -------------------------------------------------------------------
query("flow_edges", f"""WITH {MOVES}, e AS (SELECT from_address, to_address, {_SUM} AS capacity_usd, count(*) AS tx_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, string_agg(tx_hash, ',' ORDER BY timestamp, tx_hash) AS tx_hashes FROM moves GROUP BY ALL)
SELECT *, round({_WEIGHT.format("capacity_usd")}, 6) AS weight FROM e""")(lambda s, d: flow.flow_edges(_t(s, d)).withColumn("tx_hashes", F.array_join("tx_hashes", ",")).withColumn("weight", F.round("weight", 6)))
query("graph_projection_edges", f"WITH {TRANSFERS} SELECT from_address, to_address, count(*) AS tx_count, CAST(sum(CAST(coalesce(value_usd, 0) AS DECIMAL(38,2))) AS DOUBLE) AS value_usd FROM transfers WHERE from_address <> to_address GROUP BY ALL")(lambda s, d: flow.projection_edges(_t(s, d)))
for _unit in ("hour", "day", "week"):
    query(f"temporal_flow_{_unit}", f"WITH {TRANSFERS} SELECT CAST(date_trunc('{_unit}', timestamp) AS TIMESTAMP) AS bucket, from_address, count(*) AS tx_count, {_SUM} AS value_usd, list_aggregate(list(tx_hash ORDER BY timestamp, tx_hash)[1:5], 'string_agg', ',') AS sample_hashes FROM transfers GROUP BY 1, 2")(
        lambda s, d, u=_unit: flow.temporal_flow(_t(s, d), u).withColumn("sample_hashes", F.array_join("sample_hashes", ","))
    )
query("timeline_stats", f"""WITH {TRANSFERS}, b AS (SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS bucket, count(*) AS n, {_SUM} AS v FROM transfers GROUP BY 1)
SELECT count(*) AS active_buckets, CAST(sum(n) AS BIGINT) AS tx_count, CAST(sum(CAST(v AS DECIMAL(38,2))) AS DOUBLE) AS value_usd, (SELECT bucket FROM b ORDER BY n DESC, bucket LIMIT 1) AS peak_bucket, max(n) AS peak_count FROM b""")(lambda s, d: flow.timeline(_t(s, d)))
_RELAXED = ", ".join(
    f"l{i} AS MATERIALIZED (SELECT node, min(l) AS l FROM (SELECT * FROM l{i - 1} UNION ALL SELECT w.b, {{'cost': l.cost + w.w, 'path': list_append(l.path, w.b), 'total': l.total + w.c, 'least': least(l.least, w.c)}} FROM l{i - 1} JOIN w ON node = w.a WHERE NOT list_contains(l.path, w.b)) x GROUP BY node)" for i in range(1, 11)
)
query("weighted_path", f"""WITH {MOVES}, e AS (SELECT from_address AS a, to_address AS b, {_SUM} AS c FROM moves GROUP BY ALL), w AS MATERIALIZED (SELECT a, b, c, {_WEIGHT.format("c")} AS w FROM e),
l0 AS (SELECT '{START}' AS node, {{'cost': 0::DOUBLE, 'path': ['{START}'], 'total': 0::DOUBLE, 'least': 'inf'::DOUBLE}} AS l), {_RELAXED}
SELECT list_aggregate(l.path, 'string_agg', ',') AS path, CAST(len(l.path) - 1 AS INTEGER) AS hops, round(l.cost, 6) AS cost, l.total AS total_usd, l.least AS bottleneck_usd FROM l10 WHERE node = '0x' || lpad('3', 40, '0')""")(
    lambda s, d: flow.weighted_path(_t(s, d), START, "0x" + "0" * 39 + "3").select(F.array_join("path", ",").alias("path"), "hops", _r("cost"), _r("total_usd", 2), "bottleneck_usd")
)
query("max_flow")(lambda s, d: flow.max_flow(_t(s, d), START, "0x" + "0" * 39 + "3"))
query("max_flow_cut")(lambda s, d: flow.cut_edges(_t(s, d), flow.max_flow(_t(s, d), START, "0x" + "0" * 39 + "3")))

# -- wallets ------------------------------------------------------------------
query("wallet_activity", f"""WITH {TRANSFERS}, l AS (SELECT from_address AS address, timestamp, value_usd AS sent, NULL AS received FROM transfers UNION ALL SELECT to_address, timestamp, NULL, value_usd FROM transfers)
SELECT address, min(timestamp) AS first_seen, max(timestamp) AS last_seen, coalesce(CAST(sum(CAST(sent AS DECIMAL(38,2))) AS DOUBLE), 0) AS sent_usd, coalesce(CAST(sum(CAST(received AS DECIMAL(38,2))) AS DOUBLE), 0) AS received_usd, count(*) AS tx_count FROM l GROUP BY 1""")(lambda s, d: wallets.activity(_t(s, d)))
query("wallet_stats", f"""WITH {TRANSFERS}, s AS (SELECT from_address AS address, count(DISTINCT tx_hash) AS n, {_SUM} AS v FROM transfers GROUP BY 1), g AS (SELECT to_address AS address, count(DISTINCT tx_hash) AS n, {_SUM} AS v FROM transfers GROUP BY 1)
SELECT address, coalesce(s.n, 0) AS sent_count, coalesce(s.v, 0) AS sent_usd, coalesce(g.n, 0) AS received_count, coalesce(g.v, 0) AS received_usd FROM s FULL JOIN g USING (address)""")(lambda s, d: wallets.wallet_stats(_t(s, d)))
query("wallet_degree", f"""WITH {TRANSFERS}, e AS (SELECT DISTINCT from_address, to_address FROM transfers WHERE from_address <> to_address), l AS (SELECT from_address AS address, 0 AS i, 1 AS o FROM e UNION ALL SELECT to_address, 1, 0 FROM e)
SELECT address, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM l GROUP BY 1""")(lambda s, d: wallets.degrees(_t(s, d)))
query("entity_exposure", f"""WITH {TRANSFERS}, {ENTITIES}, m AS (SELECT tx_hash, value_usd, from_address AS address, to_address AS other FROM transfers UNION ALL SELECT tx_hash, value_usd, to_address, from_address FROM transfers)
SELECT name, entity_type, count(DISTINCT other) AS wallet_count, count(DISTINCT tx_hash) AS tx_count, coalesce({_SUM}, 0) AS value_usd, coalesce(list_aggregate(list_sort(list(DISTINCT other) FILTER (other IS NOT NULL))[1:20], 'string_agg', ','), '') AS sample_wallets FROM entities LEFT JOIN m USING (address) GROUP BY 1, 2""")(lambda s, d: wallets.entity_exposure(_t(s, d), views.entities(s, d)).withColumn("sample_wallets", F.array_join("sample_wallets", ",")))
query("entity_enrichment", f"WITH {TRANSFERS}, {ENTITIES} SELECT t.tx_hash, e.name, e.entity_type FROM transfers t LEFT JOIN entities e ON t.to_address = e.address")(
    lambda s, d: _t(s, d).join(views.entities(s, d).select(F.col("address").alias("to_address"), "name", "entity_type"), "to_address", "left").select("tx_hash", "name", "entity_type")
)
for _name, _amount, _rounded in (("repeated_amounts", "round(value_usd)", True), ("repeated_exact_amounts", "value_usd", False)):
    query(_name, f"""WITH {TRANSFERS}, z AS (SELECT chain, max(timestamp) AS e FROM transfers GROUP BY 1)
SELECT t.chain, from_address, {_amount} AS amount, count(*) AS repeats, list_aggregate(list(tx_hash ORDER BY timestamp, tx_hash)[1:5], 'string_agg', ',') AS tx_hashes FROM transfers t JOIN z USING (chain) WHERE timestamp >= e - INTERVAL 720 HOURS
GROUP BY 1, 2, 3 HAVING count(*) >= {3 if _rounded else 2} ORDER BY repeats DESC, amount DESC, from_address, chain LIMIT 20""")(
        lambda s, d, r=_rounded: wallets.repeated_amounts(_t(s, d), hours=720, least=3 if r else 2, rounded=r).withColumn("tx_hashes", F.array_join("tx_hashes", ","))
    )
query("rapid_movement", f"""WITH {TRANSFERS} SELECT a.from_address AS w1, a.to_address AS w2, b.to_address AS w3, a.tx_hash AS tx1, b.tx_hash AS tx2, a.value_usd AS value1, b.value_usd AS value2, {_SECS.format("a.timestamp", "b.timestamp")} AS seconds
FROM transfers a JOIN transfers b ON a.to_address = b.from_address WHERE a.from_address <> b.to_address AND a.tx_hash <> b.tx_hash AND {_SECS.format("a.timestamp", "b.timestamp")} BETWEEN 0 AND 300""")(lambda s, d: wallets.rapid_movements(_t(s, d)))
query("balance_violations", f"""WITH {TRANSFERS}, l AS (SELECT asset, to_address AS address, CAST(value_usd AS DECIMAL(38,2)) AS v FROM transfers UNION ALL SELECT asset, from_address, -CAST(value_usd AS DECIMAL(38,2)) FROM transfers)
SELECT address, asset, CAST(sum(v) AS DOUBLE) AS balance_usd FROM l GROUP BY 1, 2 HAVING sum(v) < 0""")(lambda s, d: wallets.balance_violations(_t(s, d)))
query("case_risk_summary", f"""WITH {WALLETS} SELECT case_id, count(*) AS wallet_count, count(*) FILTER (risk_score >= 75) AS critical, count(*) FILTER (risk_score >= 40 AND risk_score < 75) AS medium, count(*) FILTER (risk_score >= 20 AND risk_score < 40) AS low, count(*) FILTER (risk_score < 20) AS minimal,
count(*) FILTER (attribution_status = 'attributed') AS attributed, round(CAST(sum(CAST(coalesce(risk_score, 0) AS DECIMAL(38,2))) AS DOUBLE) / count(*), 1) AS average_risk, list_aggregate(list(wallet_id ORDER BY risk_score DESC, wallet_id)[1:5], 'string_agg', ',') AS worst_wallets FROM wallets GROUP BY 1""")(
    lambda s, d: wallets.case_risk(views.wallets(s, d)).withColumn("worst_wallets", F.array_join(F.col("worst_wallets").cast("array<string>"), ","))
)
query("case_overview", f"""WITH {CASES}, {WALLETS}, p AS (SELECT case_id, count(*) AS w, count(*) FILTER (risk_score >= 75) AS h, string_agg(DISTINCT chain, ',' ORDER BY chain) AS c, count(*) FILTER (attribution_status = 'pending') AS q FROM wallets GROUP BY 1)
SELECT case_id, case_number, status, coalesce(w, 0) AS wallet_count, coalesce(h, 0) AS high_risk, coalesce(q, 0) AS pending, coalesce(c, '') AS chains FROM cases LEFT JOIN p USING (case_id)""")(lambda s, d: wallets.case_overview(views.cases(s, d), views.wallets(s, d)).withColumn("chains", F.array_join("chains", ",")))
query("investigation_summary", f"WITH {TRANSACTIONS} SELECT count(*) AS tx_count, CAST(sum(CAST(value AS HUGEINT)) AS VARCHAR) AS total_value, (SELECT count(*) FROM (SELECT from_address FROM transactions UNION SELECT to_address FROM transactions)) AS unique_addresses FROM transactions")(lambda s, d: wallets.investigation_summary(views.chain_transactions(s, d)))
query("forensic_summary", f"WITH {TRANSFERS} SELECT count(*) AS transfer_count, {_SUM} AS value_usd, count(DISTINCT chain) AS chain_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, (SELECT count(*) FROM (SELECT from_address FROM transfers UNION SELECT to_address FROM transfers)) AS address_count FROM transfers")(lambda s, d: wallets.forensic_summary(_t(s, d)))
query("dataset_summary", f"""WITH {TRANSFERS}, {ENTITIES}, b AS (SELECT address FROM entities WHERE entity_type IN ('mixer', 'sanctioned'))
SELECT chain, count(*) AS tx_count, {_SUM} AS value_usd, max(value_usd) AS largest_usd, count(DISTINCT from_address) AS senders, count(DISTINCT to_address) AS receivers, count(*) FILTER (from_address IN (SELECT address FROM b) OR to_address IN (SELECT address FROM b)) AS flagged FROM transfers GROUP BY 1""")(
    lambda s, d: wallets.dataset_summary(_t(s, d), views.entities(s, d))
)

# -- clusters and roles ---------------------------------------------------------
query("cospend_edges", f"""WITH {COSPEND}, m AS (SELECT tx_hash, min(from_address) AS a FROM cospend GROUP BY 1 HAVING count(DISTINCT from_address) > 1)
SELECT DISTINCT m.a, c.from_address AS b FROM cospend c JOIN m USING (tx_hash) WHERE c.from_address <> m.a""")(lambda s, d: clusters.cospend_links(views.cospend_transfers(s, d)))
query("first_receipts", f"WITH {TRANSFERS} SELECT to_address, tx_hash, from_address FROM transfers QUALIFY row_number() OVER (PARTITION BY to_address ORDER BY timestamp, tx_hash) = 1")(lambda s, d: clusters.first_receipts(_t(s, d)).select("to_address", "tx_hash", "from_address"))
query("gas_funding_children", f"""WITH {TRANSFERS}, f AS (SELECT * FROM transfers QUALIFY row_number() OVER (PARTITION BY to_address ORDER BY timestamp, tx_hash) = 1), o AS (SELECT from_address AS x, min(timestamp) AS t FROM transfers GROUP BY 1),
g AS (SELECT f.from_address AS a, f.to_address AS b, f.timestamp AS t FROM f LEFT JOIN o ON o.x = f.to_address WHERE f.value_usd <= 500 AND f.from_address <> f.to_address AND (o.t IS NULL OR o.t >= f.timestamp)),
c AS (SELECT *, count(*) OVER (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM g),
p AS (SELECT *, max(n) OVER (PARTITION BY a ORDER BY t RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOURS FOLLOWING) AS m FROM c) SELECT DISTINCT a, b FROM p WHERE m >= 2""")(
    lambda s, d: clusters.gas_funding_links(_t(s, d), 86400, 2, 500.0)
)
# every node takes its neighbours' least root until none is less
_COMPONENTS = """e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), k(node, root) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM e GROUP BY 1
  UNION SELECT e.b, min(k.root) FROM k JOIN e ON e.a = k.node JOIN recurring.k AS z ON z.node = e.b WHERE k.root < z.root GROUP BY e.b)"""
_CLUSTERS = f"""n AS (SELECT *, row_number() OVER () AS rid FROM moved), t AS (SELECT rid, value_usd, root FROM n JOIN k ON node = from_address UNION SELECT rid, value_usd, root FROM n JOIN k ON node = to_address),
v AS (SELECT root, {_SUM} AS total_value_usd FROM t GROUP BY 1), h AS (SELECT root, string_agg(DISTINCT heuristic, ',' ORDER BY heuristic) AS heuristics FROM l JOIN k ON node = a GROUP BY 1)
SELECT 'cluster:' || root AS cluster_id, root, string_agg(node, ',' ORDER BY node) AS members, count(*) AS member_count, any_value(heuristics) AS heuristics, any_value(total_value_usd) AS total_value_usd FROM k JOIN h USING (root) JOIN v USING (root) GROUP BY root"""
_flat = lambda df: df.withColumn("members", F.array_join("members", ",")).withColumn("heuristics", F.array_join("heuristics", ","))
query("clusters", f"""WITH RECURSIVE {COSPEND}, moved AS MATERIALIZED (SELECT * FROM cospend), m AS (SELECT tx_hash, min(from_address) AS a FROM moved GROUP BY 1 HAVING count(DISTINCT from_address) > 1),
l AS MATERIALIZED (SELECT DISTINCT m.a, c.from_address AS b, 'cospend' AS heuristic FROM moved c JOIN m USING (tx_hash) WHERE c.from_address <> m.a), {_COMPONENTS}, {_CLUSTERS}""")(
    lambda s, d: _flat(clusters.build_clusters(views.cospend_transfers(s, d), gas_funding=False))
)
query("cluster_members", f"""WITH RECURSIVE {COSPEND}, m AS (SELECT tx_hash, min(from_address) AS a FROM cospend GROUP BY 1), l AS MATERIALIZED (SELECT DISTINCT m.a, c.from_address AS b FROM cospend c JOIN m USING (tx_hash) WHERE c.from_address <> m.a), {_COMPONENTS}
SELECT root, node AS member FROM k""")(lambda s, d: clusters.cluster_members(views.cospend_transfers(s, d), gas_funding=False))
query("clusters_by_gas_funding", f"""WITH RECURSIVE {TRANSFERS}, moved AS MATERIALIZED (SELECT * FROM transfers), f AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY to_address ORDER BY timestamp, tx_hash) = 1), o AS (SELECT from_address AS x, min(timestamp) AS t FROM moved GROUP BY 1),
g AS (SELECT f.from_address AS a, f.to_address AS b, f.timestamp AS t FROM f LEFT JOIN o ON o.x = f.to_address WHERE f.value_usd <= 500 AND f.from_address <> f.to_address AND (o.t IS NULL OR o.t >= f.timestamp)),
c AS (SELECT *, count(*) OVER (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM g), p AS (SELECT *, max(n) OVER (PARTITION BY a ORDER BY t RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOURS FOLLOWING) AS m FROM c),
l AS MATERIALIZED (SELECT DISTINCT a, b, 'gas_funding' AS heuristic FROM p WHERE m >= 2), {_COMPONENTS}, {_CLUSTERS}""")(
    lambda s, d: _flat(clusters.build_clusters(_t(s, d), window_seconds=86400, min_children=2, max_funding_usd=500.0))
)
_ROLE = f"""{TRANSFERS}, real AS (SELECT * FROM transfers WHERE from_address <> to_address), l AS (SELECT to_address AS address, from_address AS other, 1 AS i, value_usd, timestamp FROM real UNION ALL SELECT from_address, to_address, 0, value_usd, timestamp FROM real),
f AS (SELECT address, count(DISTINCT other) FILTER (i = 1) AS in_degree, count(DISTINCT other) FILTER (i = 0) AS out_degree, coalesce(CAST(sum(CAST(value_usd AS DECIMAL(38,2))) FILTER (i = 1) AS DOUBLE), 0) AS value_in_usd, coalesce(CAST(sum(CAST(value_usd AS DECIMAL(38,2))) FILTER (i = 0) AS DOUBLE), 0) AS value_out_usd,
  min(timestamp) FILTER (i = 1) AS first_in, {_SECS.format("min(timestamp)", "max(timestamp)")} AS active_seconds, len(list_intersect(list(DISTINCT other) FILTER (i = 1), list(DISTINCT other) FILTER (i = 0))) AS rt FROM l GROUP BY 1),
h AS (SELECT r.from_address AS address, {_SECS.format("any_value(f.first_in)", "min(r.timestamp)")} AS hold_seconds FROM real r JOIN f ON f.address = r.from_address WHERE r.timestamp >= f.first_in GROUP BY 1),
x AS (SELECT f.*, coalesce(rt, 0) AS round_trip, hold_seconds, CASE WHEN value_in_usd > 0 THEN value_out_usd / value_in_usd ELSE 0 END AS fwd FROM f LEFT JOIN h USING (address))"""
query("wallet_role_features", f"WITH {_ROLE} SELECT address, in_degree, out_degree, CAST(round_trip AS BIGINT) AS round_trip, value_in_usd, value_out_usd, active_seconds, hold_seconds, round(fwd, 6) AS forwarded_ratio FROM x")(
    lambda s, d: clusters.role_features(_t(s, d)).select("address", "in_degree", "out_degree", "round_trip", "value_in_usd", "value_out_usd", "active_seconds", "hold_seconds", _r("forwarded_ratio"))
)
_up = lambda *parts: "round(least(1.0, greatest(0.0, " + " + ".join([parts[0], *[f"greatest(0.0, {p})" for p in parts[1:]]]) + ")), 2)"
_RULES = (
    ("in_degree >= 5 AND out_degree >= 5", "mixer", "fan_in_and_fan_out", _up("0.55", "least(in_degree, out_degree) / 40", "round_trip / 20")),
    ("in_degree >= 3 AND out_degree = 1 AND fwd >= 0.7", "exchange_deposit", "sweeps_to_single_sink", _up("0.55", "in_degree / 40", "fwd / 10")),
    ("out_degree >= 5 AND out_degree >= 3 * greatest(in_degree, 1)", "distributor", "fan_out", _up("0.55", "out_degree / 50", "fwd / 10")),
    ("in_degree > 0 AND out_degree > 0 AND out_degree <= 3 AND fwd >= 0.7 AND hold_seconds <= 86400", "mule", "pass_through", _up("0.5", "fwd / 5", "(86400 - hold_seconds) / 864000")),
    ("in_degree > 0 AND fwd < 0.3", "holder", "retains_balance", _up("0.5", "0.3 - fwd")),
)
_by_rule = lambda k, otherwise: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k] if k == 3 else repr(r[k])}" for r in _RULES) + f" ELSE {otherwise} END"
query("wallet_role", f"""WITH {_ROLE}, y AS (SELECT *, CASE WHEN active_seconds > 0 THEN value_out_usd / (active_seconds / 3600) ELSE value_out_usd END AS velocity FROM x)
SELECT address, {_by_rule(1, "'unknown'")} AS role, CAST({_by_rule(3, "0.2")} AS DOUBLE) AS confidence, concat_ws('; ', printf('in_degree=%d', in_degree), printf('out_degree=%d', out_degree), printf('forwarded_ratio=%.2f', fwd::DOUBLE),
  printf('value_in_usd=%.2f', value_in_usd::DOUBLE), printf('velocity_usd_per_hour=%.2f', velocity::DOUBLE), 'hold_seconds=' || CAST(floor(hold_seconds) AS BIGINT), CASE WHEN round_trip > 0 THEN 'round_trip_counterparties=' || CAST(round_trip AS BIGINT) END, {_by_rule(2, "NULL")}) AS signals FROM y""")(
    lambda s, d: clusters.wallet_roles(_t(s, d)).withColumn("signals", F.array_join("signals", "; "))
)

# -- motifs -----------------------------------------------------------------------
query("fan_pairs", f"""WITH {MOVES}, e AS (SELECT DISTINCT from_address AS a, to_address AS b FROM moves) SELECT x.a AS source, y.b AS sink, count(*) AS n_mules FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b AND x.a IN (SELECT a FROM e GROUP BY 1 HAVING count(*) >= 3) AND y.b IN (SELECT b FROM e GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1, 2 HAVING count(*) >= 3""")(
    lambda s, d: motifs.fan_pairs(_t(s, d), 3)
)
_LEGS = f"{MOVES}, legs AS (SELECT *, row_number() OVER (PARTITION BY from_address, to_address ORDER BY timestamp, tx_hash) AS n FROM moves)"
_HOPS = f"""{_LEGS}, e AS (SELECT DISTINCT from_address AS a, to_address AS b FROM moves), w AS (SELECT x.a AS source, y.b AS sink FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b AND x.a IN (SELECT a FROM e GROUP BY 1 HAVING count(*) >= 2) AND y.b IN (SELECT b FROM e GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1, 2 HAVING count(*) >= 2),
hops AS (SELECT i.from_address AS source, i.to_address AS mule, o.to_address AS sink, i.tx_hash AS hash_in, o.tx_hash AS hash_out, {_SECS.format("i.timestamp", "o.timestamp")} AS gap, abs(o.value_usd - i.value_usd) / i.value_usd AS deviation
FROM legs i JOIN legs o ON i.to_address = o.from_address JOIN w ON w.source = i.from_address AND w.sink = o.to_address WHERE i.n <= 8 AND o.n <= 8 AND {_SECS.format("i.timestamp", "o.timestamp")} BETWEEN 0 AND 86400 AND abs(o.value_usd - i.value_usd) / i.value_usd <= 0.25
QUALIFY row_number() OVER (PARTITION BY i.from_address, i.to_address, o.to_address ORDER BY gap, deviation, o.tx_hash, i.tx_hash) = 1)"""
query("mule_hops", f"WITH {_HOPS.replace('i.n <= 8 AND o.n <= 8 AND ', '')} SELECT source, mule, sink, hash_in, hash_out, gap, round(deviation, 6) AS deviation FROM hops")(lambda s, d: motifs.mule_hops(_t(s, d), 86400, 2, tx_per_edge=None).select("source", "mule", "sink", "hash_in", "hash_out", "gap", _r("deviation")))
_score = lambda a, x, b, y, c, z: f"round(0.95 * ({a} * {x} + {b} * {y} + {c} * {z}), 3)"
_unit = lambda x: f"least(1.0, greatest(0.0, {x}))"
_TIMED = _HOPS[: _HOPS.index(", e AS (SELECT DISTINCT")] + ", hops AS (SELECT " + _HOPS[_HOPS.index("hops AS (SELECT ") + len("hops AS (SELECT ") :].replace("i.tx_hash AS hash_in", "i.tx_hash AS hash_in, i.value_usd AS value_in, o.value_usd AS value_out, i.timestamp AS at_in, o.timestamp AS at_out").replace(" JOIN w ON w.source = i.from_address AND w.sink = o.to_address WHERE", " WHERE i.from_address <> o.to_address AND")
_FANS = f"""{_TIMED}, h AS MATERIALIZED (SELECT * FROM hops QUALIFY count(*) OVER (PARTITION BY source, sink) >= 2), ev AS (SELECT source, sink, mule, at_in AS moment, hash_in AS hash FROM h UNION ALL SELECT source, sink, mule, at_out, hash_out FROM h),
c AS (SELECT *, CASE WHEN {_SECS.format("lag(moment) OVER o", "moment")} > 86400 THEN 1 ELSE 0 END AS cut FROM ev WINDOW o AS (PARTITION BY source, sink ORDER BY moment, hash, mule)), n AS (SELECT *, sum(cut) OVER (PARTITION BY source, sink ORDER BY moment, hash, mule ROWS UNBOUNDED PRECEDING) AS run FROM c),
m AS (SELECT source, sink, run, mule FROM n GROUP BY ALL HAVING count(*) = 2),
f AS (SELECT source, sink, run, list(mule ORDER BY mule) AS mules, count(*) AS mule_count, CAST(sum(CAST(value_in AS DECIMAL(38,2))) AS DOUBLE) AS fan_out_usd, CAST(sum(CAST(value_out AS DECIMAL(38,2))) AS DOUBLE) AS fan_in_usd, avg(deviation) AS dev, max(gap) AS max_hop_seconds, {_SECS.format("min(at_in)", "max(at_out)")} AS span,
  list_sort(list_distinct(flatten(list([hash_in, hash_out])))) AS hs FROM m JOIN h USING (source, sink, mule) GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
query("fan_out_fan_in", f"""WITH {_FANS}
SELECT 'fan_out_fan_in' AS motif, source, sink, list_aggregate(mules, 'string_agg', ',') AS mules, source || ',' || list_aggregate(mules, 'string_agg', ',') || ',' || sink AS addresses, list_aggregate(hs, 'string_agg', ',') AS tx_hashes, fan_out_usd AS value_usd, fan_out_usd, fan_in_usd, mule_count, max_hop_seconds, span AS span_seconds,
  round(dev, 4) AS mean_value_deviation, {_score(0.45, _unit("mule_count / 4"), 0.35, _unit("1 - dev / 0.25"), 0.20, _unit("1 - span / 86400"))} AS confidence FROM f""")(
    lambda s, d: motifs.fan_out_fan_in(_t(s, d), 86400, 2).withColumns({c: F.array_join(c, ",") for c in ("addresses", "tx_hashes", "mules")})
)
# a walk's next step: of what leaves in time, the largest goes on and the largest slice is peeled
_PEELS = f"""{MOVES}, og AS MATERIALIZED (SELECT from_address AS node, {{'v': value_usd, 'h': tx_hash, 't': to_address, 'm': timestamp}} AS x FROM moves), pw(entry, node, held, clock, began, path, visited, fwd, peels) AS (
  SELECT tx_hash, to_address, value_usd, timestamp, timestamp, [from_address, to_address], [from_address, to_address], [{{'v': value_usd, 'h': tx_hash, 't': to_address, 'm': timestamp}}], CAST([] AS STRUCT(v DOUBLE, h VARCHAR, t VARCHAR, m TIMESTAMP, r DOUBLE)[]) FROM moves
  UNION ALL SELECT entry, f.t, f.v, f.m, began, list_append(path, f.t), visited || [f.t, p.t], list_append(fwd, f), list_append(peels, {{'v': p.v, 'h': p.h, 't': p.t, 'm': p.m, 'r': p.v / held}})
  FROM (SELECT *, list_max(list_filter(opts, lambda o: o.v / held <= 0.4 AND o.h <> f.h)) AS p FROM (SELECT *, list_max(opts) AS f FROM (
    SELECT w.entry, w.held, w.began, w.path, w.visited, w.fwd, w.peels, list(o.x) AS opts FROM pw w JOIN og o ON o.node = w.node WHERE len(w.peels) < 64 AND o.x.m >= w.clock AND {_SECS.format("w.began", "o.x.m")} <= 86400 AND NOT list_contains(w.visited, o.x.t) GROUP BY ALL))
    WHERE len(opts) >= 2 AND f.v / held >= 0.6) WHERE p IS NOT NULL),
pc AS MATERIALIZED (SELECT *, list_transform(fwd, lambda f: f.h) AS hashes, len(peels) AS links FROM pw QUALIFY row_number() OVER (PARTITION BY entry ORDER BY len(peels) DESC) = 1 AND len(peels) >= 2),
pi AS (SELECT DISTINCT x.entry FROM pc x JOIN (SELECT unnest(hashes) AS hop, hashes, links FROM pc) y ON x.entry = y.hop WHERE y.links > x.links AND list_has_all(y.hashes, x.hashes)),
pk AS (SELECT *, list_sum(list_transform(peels, lambda p: p.r)) / links AS mean, list_transform(fwd, lambda f: f.m) || list_transform(peels, lambda p: p.m) AS times FROM pc WHERE entry NOT IN (SELECT entry FROM pi))"""
_PEEL_SPAN = _SECS.format("list_min(times)", "list_max(times)")
query("peel_chains", f"""WITH RECURSIVE {_PEELS} SELECT 'peel_chain' AS motif, list_aggregate(path, 'string_agg', ',') || ',' || list_aggregate(list_sort(list_distinct(list_transform(peels, lambda p: p.t))), 'string_agg', ',') AS addresses,
  list_aggregate(list_sort(list_distinct(hashes || list_transform(peels, lambda p: p.h))), 'string_agg', ',') AS tx_hashes, fwd[1].v AS value_usd, {_score(0.45, _unit("links / 4"), 0.35, _unit("1 - mean / 0.4"), 0.20, _unit(f"1 - {_PEEL_SPAN} / 86400"))} AS confidence, {_PEEL_SPAN} AS span_seconds,
  CAST(links AS INTEGER) AS links, list_aggregate(path, 'string_agg', ',') AS path, round(mean, 4) AS mean_peel_ratio, fwd[-1].v AS residual_usd, round(list_sum(list_transform(peels, lambda p: p.v)), 6) AS peeled_usd FROM pk""")(
    lambda s, d: motifs.peel_chains(_t(s, d), min_length=2).withColumns({c: F.array_join(c, ",") for c in ("addresses", "tx_hashes", "path")}).withColumn("peeled_usd", F.round("peeled_usd", 6))
)
query("cycles_len2", f"""WITH {_LEGS}, c AS (SELECT x.from_address AS a, x.to_address AS b, x.n AS k, x.tx_hash AS h1, x.value_usd AS v1, x.timestamp AS t1, y.tx_hash AS h2, y.value_usd AS v2, y.timestamp AS t2 FROM legs x JOIN legs y ON x.to_address = y.from_address AND y.to_address = x.from_address
  WHERE x.from_address < x.to_address AND x.n <= 8 AND y.timestamp >= x.timestamp QUALIFY row_number() OVER (PARTITION BY x.from_address, x.to_address, x.n ORDER BY y.timestamp, y.tx_hash) = 1),
g AS (SELECT * FROM c WHERE {_SECS.format("t1", "t2")} <= 86400 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY k) = 1)
SELECT a || ',' || b AS addresses, h1 || ',' || h2 AS tx_hashes, least(v1, v2) AS value_usd, {_SECS.format("t1", "t2")} AS span_seconds FROM g""")(
    lambda s, d: motifs.cycles(_t(s, d), 2).select(F.array_join("addresses", ",").alias("addresses"), F.array_join("tx_hashes", ",").alias("tx_hashes"), "value_usd", "span_seconds")
)
_RINGS = f"""{_LEGS}, g AS MATERIALIZED (SELECT * FROM legs), r(start, node, k, path, t0, t1, hashes, vals) AS (SELECT from_address, to_address, n, [from_address, to_address], timestamp, timestamp, [tx_hash], [value_usd] FROM g WHERE to_address > from_address AND n <= 8
  UNION ALL SELECT r.start, l.to_address, r.k, list_append(r.path, l.to_address), r.t0, l.timestamp, list_append(r.hashes, l.tx_hash), list_append(r.vals, l.value_usd) FROM r JOIN g l ON l.from_address = r.node
  WHERE r.node <> r.start AND l.timestamp >= r.t1 AND {_SECS.format("r.t0", "l.timestamp")} <= 86400 AND (l.to_address = r.start OR (len(r.path) < 6 AND l.to_address > r.start AND NOT list_contains(r.path, l.to_address)))
  QUALIFY row_number() OVER (PARTITION BY r.start, r.path, r.k, l.to_address ORDER BY l.timestamp, l.tx_hash) = 1),
z AS (SELECT *, len(path) - 1 AS length, {_SECS.format("t0", "t1")} AS span, list_min(vals) / list_max(vals) AS keep FROM r WHERE node = start QUALIFY row_number() OVER (PARTITION BY path ORDER BY k) = 1)"""
query("cycles_upto6")(lambda s, d: motifs.cycles(_t(s, d), 6))
query("cycles_upto6_joined", f"""WITH RECURSIVE {_RINGS}
SELECT 'cycle' AS motif, list_aggregate(path[:length], 'string_agg', ',') AS addresses, list_aggregate(hashes, 'string_agg', ',') AS tx_hashes, list_min(vals) AS value_usd, {_score(0.40, _unit("keep"), 0.35, _unit("1 - span / 86400"), 0.25, _unit("3.0::DOUBLE / length"))} AS confidence, span AS span_seconds,
  CAST(length AS INTEGER) AS length, round(keep, 4) AS retention, list_max(vals) AS max_hop_usd FROM z""")(lambda s, d: motifs.cycles(_t(s, d), 6).withColumn("addresses", F.array_join("addresses", ",")).withColumn("tx_hashes", F.array_join("tx_hashes", ",")))
query("motif_counts", f"""WITH RECURSIVE {_FANS}, {_RINGS.removeprefix(_LEGS + ", ")}, {_PEELS.removeprefix(MOVES + ", ")}, shapes AS (SELECT 'fan_out_fan_in' AS motif, fan_out_usd AS v FROM f UNION ALL SELECT 'peel_chain', fwd[1].v FROM pk UNION ALL SELECT 'cycle', list_min(vals) FROM z)
SELECT motif, count(*) AS n, CAST(sum(CAST(v AS DECIMAL(38,2))) AS DOUBLE) AS value_usd FROM shapes GROUP BY 1""")(lambda s, d: motifs.detect_motifs(_t(s, d), window_seconds=86400, min_mules=2, min_length=2, max_length=6).groupBy("motif").agg(F.count("*").alias("n"), total(F.col("value_usd")).alias("value_usd")))

# -- correlation --------------------------------------------------------------------
_prox = lambda x, limit: f"greatest(0.0, 1 - {x} / {limit})"
_SURE = "round(least(1.0, greatest(0.0, 0.4 * {0} + 0.6 * {1})), 4)"
query("bridge_candidates", f"""WITH {TRANSFERS}, p AS (SELECT a.tx_hash AS source_tx, b.tx_hash AS destination_tx, a.chain AS source_chain, b.chain AS destination_chain, a.from_address AS source_address, b.to_address AS destination_address, a.value_usd, {_SECS.format("a.timestamp", "b.timestamp")} AS elapsed_seconds,
  abs(b.value_usd - a.value_usd) / a.value_usd * 100 AS delta FROM transfers a JOIN transfers b ON a.chain <> b.chain AND b.timestamp BETWEEN a.timestamp AND a.timestamp + INTERVAL 3600 SECONDS WHERE a.value_usd > 0 AND b.value_usd > 0)
SELECT * EXCLUDE (delta), round(delta, 4) AS value_delta_pct, {_SURE.format(_prox("elapsed_seconds", 3600), _prox("delta", 2))} AS confidence FROM p WHERE delta <= 2""")(lambda s, d: correlation.bridge_candidates(_t(s, d), _t(s, d)).drop("bridge_address"))
query("fiat_candidates", f"""WITH {TRANSFERS}, {PAYMENTS}, p AS (SELECT reference_id AS payment_reference, payer_account, payee_account, tx_hash AS chain_tx, to_address AS crypto_address, amount_inr, value_usd, {_SECS.format("p.timestamp", "t.timestamp")} AS elapsed_seconds, abs(amount_inr - value_usd * 83) / (value_usd * 83) * 100 AS delta
  FROM payments p JOIN transfers t ON t.timestamp BETWEEN p.timestamp - INTERVAL 600 SECONDS AND p.timestamp + INTERVAL 600 SECONDS WHERE amount_inr > 0 AND value_usd > 0)
SELECT * EXCLUDE (delta), round(amount_inr / value_usd, 4) AS implied_rate, {_SURE.format(_prox("abs(elapsed_seconds)", 600), _prox("delta", 5))} AS confidence FROM p WHERE delta <= 5""")(lambda s, d: correlation.fiat_candidates(views.fiat_payments(s, d), _t(s, d)))


def _greedy(ctes: str, candidates: str, left: str, right: str, rounds: int = 24) -> str:
    """SQL of the assignment: in each round the candidates that lead on both sides."""
    best = lambda c: f"row_number() OVER (PARTITION BY {c} ORDER BY confidence DESC, {left}, {right}) = 1"
    out = [f"c0 AS MATERIALIZED ({candidates})"]
    for i in range(rounds):
        out.append(f"t{i} AS MATERIALIZED (SELECT * FROM c{i} QUALIFY {best(left)} AND {best(right)})")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} WHERE {left} NOT IN (SELECT {left} FROM t{i}) AND {right} NOT IN (SELECT {right} FROM t{i}))")
    return f"WITH {ctes}, {', '.join(out)} " + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(rounds))


_BRIDGES = f"""b AS MATERIALIZED (SELECT a.chain AS source_chain, a.tx_hash AS source_tx, a.from_address AS source_address, b.chain AS destination_chain, b.tx_hash AS destination_tx, b.to_address AS destination_address, a.value_usd, a.to_address AS bridge,
  {_SECS.format("a.timestamp", "b.timestamp")} AS elapsed_seconds, abs(b.value_usd - a.value_usd) / a.value_usd * 100 AS delta FROM transfers a JOIN transfers b ON a.chain <> b.chain AND b.timestamp BETWEEN a.timestamp AND a.timestamp + INTERVAL 3600 SECONDS WHERE a.value_usd > 0 AND b.value_usd > 0)"""
_BRIDGED = f"SELECT * EXCLUDE (delta, bridge), round(delta, 4) AS value_delta_pct, {_SURE.format(_prox('elapsed_seconds', 3600), _prox('delta', 2))} AS confidence, {{0}} AS bridge_address FROM b WHERE delta <= 2{{1}}"
query("bridge_matches", _greedy(f"{TRANSFERS}, {_BRIDGES}", _BRIDGED.format("NULL::VARCHAR", ""), "source_tx", "destination_tx"))(lambda s, d: correlation.bridge_matches(_t(s, d), _t(s, d)))
query("bridge_matches_allowlist", _greedy(f"{TRANSFERS}, {ENTITIES}, {_BRIDGES}", _BRIDGED.format("bridge", " AND bridge IN (SELECT address FROM entities WHERE entity_type = 'bridge')"), "source_tx", "destination_tx"))(lambda s, d: correlation.bridge_matches(_t(s, d), _t(s, d), bridges=views.entities(s, d).where("entity_type = 'bridge'").select("address")))
query("fiat_matches", _greedy(f"""{TRANSFERS}, {PAYMENTS}, p AS (SELECT reference_id AS payment_reference, payer_account, payee_account, tx_hash AS chain_tx, to_address AS crypto_address, amount_inr, value_usd, {_SECS.format("p.timestamp", "t.timestamp")} AS elapsed_seconds, abs(amount_inr - value_usd * 83) / (value_usd * 83) * 100 AS delta
  FROM payments p JOIN transfers t ON t.timestamp BETWEEN p.timestamp - INTERVAL 600 SECONDS AND p.timestamp + INTERVAL 600 SECONDS WHERE amount_inr > 0 AND value_usd > 0)""",
    f"SELECT * EXCLUDE (delta), round(amount_inr / value_usd, 4) AS implied_rate, {_SURE.format(_prox('abs(elapsed_seconds)', 600), _prox('delta', 5))} AS confidence FROM p WHERE delta <= 5", "payment_reference", "chain_tx"))(lambda s, d: correlation.fiat_matches(views.fiat_payments(s, d), _t(s, d)))

# -- risk -----------------------------------------------------------------------------
_ETH = "CAST(value AS DOUBLE) / 1e18"
_MEASURES = f"""{TRANSACTIONS}, l AS (SELECT from_address AS address, * FROM transactions UNION ALL SELECT to_address AS address, * FROM transactions WHERE to_address <> from_address),
q AS (SELECT *, {_ETH} AS eth, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY address ORDER BY timestamp, tx_hash))) / 1e6 AS gap, upper(coalesce(token_symbol, '')) AS sym FROM l),
m AS (SELECT address, count(*) AS tx_count, min(timestamp) AS first_seen, count(*) FILTER (eth >= 1 AND eth = floor(eth)) AS round_count, count(*) FILTER (gap < 300) AS rapid_count, count(*) FILTER (eth >= 100) AS large_count, max(eth) AS max_eth,
  count(*) FILTER (sym IN ('USDC', 'USDT', 'WETH', 'MATIC') AND lower(method) LIKE '%bridge%') AS bridge_count, count(*) FILTER (method <> '' AND method <> 'transfer') AS contract_count,
  count(*) FILTER (token_address <> '' AND (sym = '' OR length(sym) > 10 OR sym LIKE '%SCAM%' OR sym LIKE '%FAKE%')) AS shady_count, count(*) FILTER (eth > 0 AND eth <= 0.0001) AS dust_count FROM q GROUP BY 1)"""
query("risk_measures", f"WITH {_MEASURES} SELECT * FROM m")(lambda s, d: risk.measures(views.chain_transactions(s, d)))
_FACTORS = f"""{_MEASURES}, {ENTITIES}, j AS (SELECT m.*, e.entity_type AS kind FROM m LEFT JOIN entities e USING (address)),
f AS ({" UNION ALL ".join(f"SELECT address, '{k}' AS factor, CAST({v} AS DOUBLE) AS score, {risk.WEIGHTS[k]}::DOUBLE AS weight FROM j" for k, v in {
    "sanctions_hit": "CASE WHEN kind = 'sanctioned' THEN 100 ELSE 0 END",
    "high_risk_entity": "CASE kind WHEN 'sanctioned' THEN 100 WHEN 'mixer' THEN 95 WHEN 'darknet' THEN 90 WHEN 'gambling' THEN 70 ELSE 0 END",
    "rapid_movement": "CASE WHEN rapid_count >= 5 THEN 75 WHEN rapid_count >= 3 THEN 50 ELSE 0 END",
    "round_amounts": "CASE WHEN round_count >= 5 THEN 60 WHEN round_count >= 3 THEN 35 ELSE 0 END",
    "large_value_transfer": "CASE WHEN kind IN ('defi', 'exchange', 'bridge', 'merchant') THEN 0 WHEN max_eth >= 1000 THEN 70 WHEN large_count > 0 THEN 50 ELSE 0 END",
    "cross_chain_bridge": "CASE WHEN bridge_count > 0 THEN 45 ELSE 0 END",
    "contract_interaction": "CASE WHEN contract_count > 10 THEN 30 ELSE 0 END",
    "new_wallet": f"CASE WHEN tx_count < 5 AND floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(first_seen)) / 1e6 / 86400) < 30 THEN 25 ELSE 0 END",
    "low_liquidity_token": "CASE WHEN shady_count > 0 THEN 55 ELSE 0 END",
    "dusting_attack": "CASE WHEN dust_count >= 4 THEN 30 ELSE 0 END",
}.items())})"""
query("risk_factors", f"WITH {_FACTORS} SELECT address, factor, score, weight, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 5 THEN 'low' ELSE 'info' END AS severity FROM f WHERE score > 0")(
    lambda s, d: risk.factors(views.chain_transactions(s, d), AS_OF, entities=views.entities(s, d))
)
query("risk_score", f"""WITH {_FACTORS}, r AS (SELECT address, least(sum(score * weight) / sum(weight) * 1.1, max(score), 100) AS risk_score, count(*) AS factor_count FROM f WHERE score > 0 GROUP BY 1)
SELECT address, round(risk_score, 6) AS risk_score, factor_count FROM r""")(lambda s, d: risk.assess(views.chain_transactions(s, d), AS_OF, entities=views.entities(s, d)).select("address", _r("risk_score"), "factor_count"))


def _tables(s: SparkSession, d: str) -> assistant.Tables:
    return assistant.Tables(_t(s, d), views.chain_transactions(s, d), views.wallets(s, d), views.cases(s, d), views.entities(s, d), AS_OF)


_BANDS = "CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' WHEN risk_score >= 5 THEN 'low' ELSE 'info' END"


def _full_sql(out: str) -> str:
    """All twelve factors: with mixers within two hops and peel chains."""
    infra = "coalesce(kind, '') IN ('defi', 'exchange', 'bridge', 'merchant')"
    return f"""WITH RECURSIVE {_FACTORS}, {MOVES}, {_BOTH.removeprefix(TRANSFERS + ", ")}, {_PEELS.removeprefix(MOVES + ", ")},
x1 AS (SELECT t.address AS s, e.b AS w FROM entities t JOIN e ON e.a = t.address WHERE entity_type = 'mixer'), x2 AS (SELECT DISTINCT x1.s, e.b AS w FROM x1 JOIN e ON e.a = x1.w WHERE e.b <> x1.s),
near AS (SELECT w AS address, min(h) AS hops FROM (SELECT w, 1 AS h FROM x1 UNION ALL SELECT w, 2 FROM x2) WHERE w IN (SELECT from_address FROM transfers) GROUP BY 1),
more AS (SELECT * FROM f UNION ALL SELECT j.address, 'mixer_interaction', CAST(CASE WHEN {infra} THEN CASE hops WHEN 1 THEN 15 WHEN 2 THEN 8 ELSE 0 END ELSE CASE hops WHEN 1 THEN 95 WHEN 2 THEN 50 ELSE 0 END END AS DOUBLE), {risk.WEIGHTS["mixer_interaction"]}::DOUBLE FROM j LEFT JOIN near USING (address)
  UNION ALL SELECT address, 'peel_chain', 85::DOUBLE, {risk.WEIGHTS["peel_chain"]}::DOUBLE FROM j WHERE address IN (SELECT path[1] FROM pk)),
r AS (SELECT address, least(sum(score * weight) / sum(weight) * 1.1, max(score), 100) AS risk_score, count(*) AS factor_count, string_agg(factor, ',' ORDER BY weight DESC, factor DESC) AS factors FROM more WHERE score > 0 GROUP BY 1)
{out}"""


# -- graph ----------------------------------------------------------------------------
_BOTH = f"{TRANSFERS}, e AS (SELECT from_address AS a, to_address AS b FROM transfers WHERE from_address <> to_address UNION SELECT to_address, from_address FROM transfers WHERE from_address <> to_address)"
query("k_hop_neighbors", f"WITH RECURSIVE {_BOTH}, r(n, h) AS (SELECT '{START}', 0 UNION SELECT e.b, r.h + 1 FROM r JOIN e ON e.a = r.n WHERE r.h < 2) SELECT n AS address, CAST(min(h) AS INTEGER) AS hops FROM r GROUP BY 1")(lambda s, d: graph.neighborhood(_t(s, d), _start(s), 2))
query("subgraph", f"""WITH RECURSIVE {_BOTH}, r(n, h) AS (SELECT '{START}', 0 UNION SELECT e.b, r.h + 1 FROM r JOIN e ON e.a = r.n WHERE r.h < 1), s AS (SELECT DISTINCT n FROM r)
SELECT from_address, to_address, count(*) AS tx_count, {_SUM} AS value_usd FROM transfers WHERE from_address <> to_address AND from_address IN (SELECT n FROM s) AND to_address IN (SELECT n FROM s) GROUP BY 1, 2""")(lambda s, d: graph.subgraph(_t(s, d), _start(s), 1))
query("trace_fund_flow", f"""WITH RECURSIVE {TRANSFERS}, e AS (SELECT DISTINCT from_address AS a, to_address AS b FROM transfers WHERE value_usd >= 100), r(n, h) AS (SELECT '{START}', 0 UNION SELECT e.b, r.h + 1 FROM r JOIN e ON e.a = r.n WHERE r.h < 2), m AS (SELECT n, min(h) AS h FROM r GROUP BY 1)
SELECT CAST(m.h + 1 AS INTEGER) AS hop, from_address, to_address, count(*) AS tx_count, {_SUM} AS value_usd FROM transfers t JOIN m ON m.n = t.from_address WHERE value_usd >= 100 AND from_address <> to_address GROUP BY 1, 2, 3""")(lambda s, d: graph.trace(_t(s, d), START, 3, 100.0))
query("paths_to_entities", f"""WITH RECURSIVE {_BOTH}, {ENTITIES}, p(n, h, path) AS (SELECT '{START}', 0, ['{START}'] UNION ALL SELECT e.b, p.h + 1, list_append(p.path, e.b) FROM p JOIN e ON e.a = p.n WHERE p.h < 2 AND NOT list_contains(p.path, e.b)),
b AS (SELECT n, h, path FROM p WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY n ORDER BY h, path) = 1)
SELECT n AS address, name, entity_type, confidence, CAST(h AS INTEGER) AS hops, list_aggregate(path, 'string_agg', ',') AS path FROM b JOIN entities ON address = n WHERE entity_type IN ('exchange', 'bridge', 'defi')""")(
    lambda s, d: graph.paths_to_entities(_t(s, d), _start(s), views.entities(s, d), 2, attribution.SEARCHED).select("address", "name", "entity_type", "confidence", "hops", F.array_join("path", ",").alias("path"))
)
query("mixer_interactions", f"""WITH RECURSIVE {_BOTH}, {ENTITIES}, r(n, h) AS (SELECT '{START}', 0 UNION SELECT e.b, r.h + 1 FROM r JOIN e ON e.a = r.n WHERE r.h < 3), m AS (SELECT n, min(h) AS h FROM r GROUP BY 1 HAVING min(h) > 0)
SELECT name, CAST(h AS INTEGER) AS hops FROM m JOIN entities ON address = n WHERE entity_type = 'mixer' ORDER BY h, n LIMIT 10""")(lambda s, d: graph.paths_to_entities(_t(s, d), _start(s), views.entities(s, d), 3, ("mixer",), top=10).select("name", "hops"))
_NEAR = f"""{_BOTH}, {ENTITIES}, p(n, h, path) AS (SELECT '{START}', 0, ['{START}'] UNION ALL SELECT e.b, p.h + 1, list_append(p.path, e.b) FROM p JOIN e ON e.a = p.n WHERE p.h < 2 AND NOT list_contains(p.path, e.b)),
b AS (SELECT n, h, path FROM p WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY n ORDER BY h, path) = 1),
q AS (SELECT address, name, entity_type, confidence AS listed, h AS hops, list_aggregate(path, 'string_agg', ',') AS path FROM b JOIN entities ON address = n WHERE entity_type IN ('exchange', 'bridge', 'defi') QUALIFY row_number() OVER (ORDER BY h, address, name) <= 20),
k AS (SELECT *, CASE WHEN hops = 1 OR listed = 'CONFIRMED' AND hops <= 2 THEN 'direct' WHEN entity_type = 'defi' THEN 'heuristic' ELSE 'indirect' END AS kind FROM q),
c AS (SELECT *, CASE listed WHEN 'CONFIRMED' THEN CASE WHEN hops <= 2 AND kind = 'direct' THEN 'CONFIRMED' WHEN hops <= 4 THEN 'HIGH_CONFIDENCE' ELSE 'PROBABLE' END WHEN 'HIGH_CONFIDENCE' THEN CASE WHEN hops <= 3 THEN 'HIGH_CONFIDENCE' ELSE 'PROBABLE' END
  WHEN 'PROBABLE' THEN CASE WHEN hops <= 2 THEN 'PROBABLE' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END AS sure FROM k),
s AS (SELECT *, least(1, greatest(0, CASE sure WHEN 'CONFIRMED' THEN 1.0 WHEN 'HIGH_CONFIDENCE' THEN 0.85 WHEN 'PROBABLE' THEN 0.65 ELSE 0.3 END::DOUBLE * greatest(0, 1 - (hops - 1) * 0.1::DOUBLE) * CASE kind WHEN 'direct' THEN 1.0 WHEN 'indirect' THEN 0.8 ELSE 0.4 END::DOUBLE * (0.7::DOUBLE + 0.3::DOUBLE * least(1, hops / 10)))) AS score FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, hops, address, name) AS rank FROM s QUALIFY rank <= 10)"""
_STEPS = f"{_BOTH}, {ENTITIES}, p0 AS (SELECT '{START}' AS n, 0 AS h, ['{START}'] AS path), " + ", ".join(
    f"p{i} AS MATERIALIZED (SELECT e.b AS n, {i} AS h, list_append(min(p.path), e.b) AS path FROM p{i - 1} p JOIN e ON e.a = p.n WHERE e.b NOT IN ({' UNION ALL '.join(f'SELECT n FROM p{j}' for j in range(i))}) GROUP BY e.b)" for i in range(1, 7)
)
_FAR = f"{_STEPS}, b AS ({' UNION ALL '.join(f'SELECT * FROM p{i}' for i in range(1, 7))}), q AS (" + _NEAR.split("q AS (", 1)[1]
_ATTRIBUTED = """SELECT CAST(rank AS INTEGER) AS rank, address, name, entity_type, kind AS attribution_type, sure AS confidence, round(score, 6) AS confidence_score, CAST(hops AS INTEGER) AS hops, path,
  'on_chain_path,entity_registry' || CASE WHEN listed = 'CONFIRMED' THEN ',manual_verification' ELSE '' END AS evidence FROM r"""
_SUMMED = """SELECT count(*) AS total, (SELECT name FROM r WHERE rank = 1) AS nearest, round(max(score), 6) AS highest_score, round(avg(hops), 6) AS average_hops, count(*) FILTER (entity_type = 'exchange') AS exchange_count,
  count(*) FILTER (entity_type = 'bridge') AS bridge_count, count(*) FILTER (entity_type = 'defi') AS defi_count, count(*) FILTER (entity_type = 'mixer') AS mixer_count FROM r HAVING count(*) > 0"""
_listed = lambda df: df.drop("start").withColumn("confidence_score", F.round("confidence_score", 6)).withColumn("path", F.array_join("path", ",")).withColumn("evidence", F.array_join("evidence", ","))
_summed = lambda df: attribution.summary(df).drop("start").withColumn("highest_score", F.round("highest_score", 6)).withColumn("average_hops", F.round("average_hops", 6))
query("risk_assessment_full", _full_sql(f"SELECT address, round(risk_score, 6) AS risk_score, factor_count, factors, {_BANDS} AS severity FROM r"))(lambda s, d: assistant.wallet_risk(assistant.Tables(_t(s, d), views.chain_transactions(s, d), None, None, views.entities(s, d), AS_OF)).withColumn("factors", F.array_join("factors", ",")).withColumn("risk_score", F.round("risk_score", 6)))
query("attributions", f"WITH {_FAR} {_ATTRIBUTED}")(lambda s, d: _listed(attribution.attributions(_t(s, d), _start(s), views.entities(s, d))))
query("attribution_summary", f"WITH {_FAR} {_SUMMED}")(lambda s, d: _summed(attribution.attributions(_t(s, d), _start(s), views.entities(s, d))))
query("shortest_path_to_vasp", f"WITH {_STEPS}, b AS ({' UNION ALL '.join(f'SELECT * FROM p{i}' for i in range(1, 7))}) SELECT address, name, CAST(h AS INTEGER) AS hops, list_aggregate(path, 'string_agg', ',') AS path FROM b JOIN entities ON address = n WHERE entity_type = 'exchange' ORDER BY h, address, name LIMIT 1")(
    lambda s, d: graph.paths_to_entities(_t(s, d), _start(s), views.entities(s, d), 6, ("exchange",), top=1).select("address", "name", "hops", F.array_join("path", ",").alias("path"))
)
query("attributions_two_hops", f"WITH RECURSIVE {_NEAR} {_ATTRIBUTED}")(lambda s, d: _listed(attribution.attributions(_t(s, d), _start(s), views.entities(s, d), 2)))
query("attribution_summary_two_hops", f"WITH RECURSIVE {_NEAR} {_SUMMED}")(lambda s, d: _summed(attribution.attributions(_t(s, d), _start(s), views.entities(s, d), 2)))
query("busy_chains", f"""WITH {TRANSFERS}, e AS (SELECT from_address AS a, to_address AS b, {_SUM} AS v FROM transfers WHERE from_address <> to_address GROUP BY 1, 2 HAVING {_SUM} > 300), k AS (SELECT from_address FROM transfers GROUP BY 1 HAVING count(*) > 10)
SELECT x.a || ',' || x.b || ',' || y.b AS addresses, round(x.v + y.v, 2) AS value_usd FROM e x JOIN e y ON x.b = y.a WHERE x.a IN (SELECT from_address FROM k) AND y.b <> x.a AND x.v + y.v > 600 ORDER BY x.v + y.v DESC, 1 LIMIT 20""")(
    lambda s, d: graph.busy_chains(_t(s, d), 2, 10, 300.0).select(F.array_join("addresses", ",").alias("addresses"), _r("value_usd", 2))
)
_RANK = f"""{TRANSFERS}, e AS (SELECT from_address AS a, to_address AS b, {_SUM} AS v FROM transfers WHERE from_address <> to_address GROUP BY 1, 2), n AS (SELECT from_address AS x FROM transfers UNION SELECT to_address FROM transfers), o AS (SELECT a, sum(v) AS v, count(*) AS k FROM e GROUP BY 1),
w AS MATERIALIZED (SELECT e.a, e.b, CASE WHEN o.v > 0 THEN e.v / o.v ELSE 1.0 / o.k END AS w FROM e JOIN o USING (a)), z AS MATERIALIZED (SELECT x, x NOT IN (SELECT a FROM w) AS sink, (SELECT count(*) FROM n) AS n FROM n), r0 AS (SELECT x, sink, n, 1.0::DOUBLE / n AS s FROM z)""" + "".join(
    f", r{i} AS MATERIALIZED (SELECT z.x, z.sink, z.n, 0.15 / z.n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(s), 0) FROM r{i - 1} WHERE sink) / z.n) AS s FROM z LEFT JOIN (SELECT w.b, sum(r.s * w.w) AS got FROM r{i - 1} r JOIN w ON w.a = r.x GROUP BY 1) g ON g.b = z.x)" for i in range(1, 21)
)
_ranked = f"WITH {_RANK} SELECT x AS address, round(s, 9) AS score FROM r20"
query("pagerank", _ranked)(lambda s, d: graph.pagerank(_t(s, d)).select("address", _r("score", 9)))
_LEVELS = 6
_SEARCH = f"""{TRANSFERS}, e AS MATERIALIZED (SELECT DISTINCT from_address AS a, to_address AS b FROM transfers WHERE from_address <> to_address), n AS MATERIALIZED (SELECT from_address AS v FROM transfers UNION SELECT to_address FROM transfers), l0 AS MATERIALIZED (SELECT v AS s, v, 1::DOUBLE AS w FROM n), """ + ", ".join(
    [f"l{i} AS MATERIALIZED (SELECT x.s, e.b AS v, sum(x.w) AS w FROM l{i - 1} x JOIN e ON e.a = x.v WHERE {' AND '.join(f'(x.s, e.b) NOT IN (SELECT (s, v) FROM l{j})' for j in range(i))} GROUP BY 1, 2)" for i in range(1, _LEVELS + 1)]
    + [f"d{_LEVELS} AS (SELECT s, v, w, 0::DOUBLE AS d FROM l{_LEVELS})"]
    + [f"d{i} AS MATERIALIZED (SELECT h.s, h.v, h.w, coalesce(sum(h.w * (1 + x.d) / x.w), 0) AS d FROM l{i} h LEFT JOIN e ON e.a = h.v LEFT JOIN d{i + 1} x ON x.s = h.s AND x.v = e.b GROUP BY 1, 2, 3)" for i in range(_LEVELS - 1, 0, -1)]
)
query("betweenness", f"""WITH {_SEARCH}, u AS ({' UNION ALL '.join(f'SELECT v, d FROM d{i}' for i in range(1, _LEVELS + 1))})
SELECT n.v AS address, round(coalesce(sum(d), 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 9) AS score FROM n LEFT JOIN u USING (v) GROUP BY 1""")(lambda s, d: graph.betweenness(_t(s, d)).select("address", _r("score", 9)))
query("centrality", f"""WITH {_SEARCH.removeprefix(TRANSFERS + ", ")}, u AS ({' UNION ALL '.join(f'SELECT v, d FROM d{i}' for i in range(1, _LEVELS + 1))}), c AS (SELECT n.v AS address, round(coalesce(sum(d), 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 9) AS betweenness FROM n LEFT JOIN u USING (v) GROUP BY 1),
g AS (SELECT v AS address, CAST(count(*) FILTER (i = 1) AS BIGINT) AS in_degree, CAST(count(*) FILTER (i = 0) AS BIGINT) AS out_degree FROM (SELECT a AS v, 0 AS i FROM e UNION ALL SELECT b, 1 FROM e) GROUP BY 1),
k AS ({_ranked}) SELECT address, k.score AS pagerank, betweenness, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) + coalesce(out_degree, 0) AS degree FROM c JOIN k USING (address) LEFT JOIN g USING (address)""".replace("WITH ", f"WITH {TRANSFERS}, ", 1))(
    lambda s, d: graph.centrality(_t(s, d)).withColumn("pagerank", F.round("pagerank", 9)).withColumn("betweenness", F.round("betweenness", 9))
)
query("communities")(lambda s, d: graph.communities(_t(s, d), views.wallets(s, d)))

# -- taint ------------------------------------------------------------------------------
_seed = lambda s: s.createDataFrame([(START, 5000.0)], "address string, amount_usd double")
_MODEL = {
    # haircut: a share of what the sender holds; FIFO: shares of the lots that a spend lies over, lots standing in order of time
    taint.HAIRCUT: ("""e AS MATERIALIZED (SELECT n, i.i AS a, j.i AS b, CASE WHEN balance > 1e-9 THEN least(1.0::DOUBLE, (-amount)::DOUBLE / balance::DOUBLE) ELSE 0::DOUBLE END AS share FROM own JOIN ids i ON i.address = own.address JOIN ids j ON j.address = own.other WHERE amount < 0)""",
        "list_resize([]::DOUBLE[], 1, 0)", "CASE WHEN held[e.a] > 1e-9 THEN held[e.a] * share ELSE 0 END", "lots"),
    taint.FIFO: ("""lot AS (SELECT address, n, amount, received AS lo, received + amount AS hi FROM own WHERE amount > 0), spend AS (SELECT address, other, n, received - balance AS lo, received - balance + least(-amount, balance) AS hi FROM own WHERE amount < 0),
piece AS (SELECT s.n, l.n + (SELECT count(*) FROM seeds) AS lot, (least(s.hi, l.hi) - greatest(s.lo, l.lo))::DOUBLE / l.amount::DOUBLE AS share FROM spend s JOIN lot l ON l.address = s.address AND l.lo < s.hi AND s.lo < l.hi),
e AS MATERIALIZED (SELECT s.n, i.i AS a, j.i AS b, list({'lot': lot, 'share': share} ORDER BY lot) FILTER (WHERE lot IS NOT NULL) AS pieces FROM spend s JOIN ids i ON i.address = s.address JOIN ids j ON j.address = s.other LEFT JOIN piece p ON p.n = s.n GROUP BY ALL)""",
        "(SELECT list(amount ORDER BY address DESC) FROM seeds)", "coalesce(list_sum(list_transform(pieces, lambda p: p.share * lots[p.lot])), 0)", "list_append(lots, passed)"),
}


def _taint_sql(model: str, seeds: str, out: str, max_hops: int = 6) -> str:
    """One step of the recursion for every transfer, in order; lists by address."""
    steps, lots, moved, then = _MODEL[model]
    return f"""WITH RECURSIVE {MOVES}, {seeds}, m AS (SELECT from_address, to_address, value_usd, row_number() OVER (ORDER BY timestamp, tx_hash, from_address, to_address, value_usd) AS n FROM moves),
leg AS (SELECT from_address AS address, to_address AS other, n, -CAST(value_usd AS DECIMAL(38,10)) AS amount FROM m UNION ALL SELECT to_address, from_address, n, CAST(value_usd AS DECIMAL(38,10)) FROM m
  UNION ALL SELECT address, NULL, 1 - row_number() OVER (ORDER BY address), CAST(amount AS DECIMAL(38,10)) FROM seeds),
ran AS (SELECT *, sum(amount) OVER w - amount AS before, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) OVER w - CASE WHEN amount > 0 THEN amount ELSE 0 END AS received FROM leg WINDOW w AS (PARTITION BY address ORDER BY n)),
own AS MATERIALIZED (SELECT address, other, n, amount, received, before - least(0, min(before) OVER (PARTITION BY address ORDER BY n)) AS balance FROM ran),
ids AS MATERIALIZED (SELECT address, row_number() OVER (ORDER BY address) AS i, sum(amount) FILTER (WHERE amount > 0) AS received, coalesce(sum(amount) FILTER (WHERE other IS NULL), 0)::DOUBLE AS planted FROM leg GROUP BY address), {steps},
r(n, held, got, hops, lots) AS (SELECT 0::BIGINT, list(planted ORDER BY i), list(planted ORDER BY i), list(CASE WHEN planted > 0 THEN 0 ELSE 1000000 END ORDER BY i), {lots} FROM ids
  UNION ALL SELECT n, list_transform(held, lambda x, i: CASE WHEN i = a THEN x - moved WHEN i = b THEN x + passed ELSE x END), list_transform(got, lambda x, i: CASE WHEN i = b THEN x + passed ELSE x END),
  list_transform(hops, lambda x, i: CASE WHEN i = b AND passed > 1e-9 THEN least(x, hops[a] + 1) ELSE x END), {then} FROM (SELECT *, CASE WHEN hops[a] < {max_hops} THEN moved ELSE 0 END AS passed
  FROM (SELECT e.n, e.a, e.b, held, got, hops, lots, {moved} AS moved FROM r JOIN e ON e.n = r.n + 1) x) y),
f AS (SELECT got, hops FROM r ORDER BY n DESC LIMIT 1), result AS (SELECT address, least(got[i], received::DOUBLE) AS tainted, received::DOUBLE AS received, hops[i] AS hops FROM ids, f WHERE hops[i] < 1000000 AND least(got[i], received::DOUBLE) >= 1)
{out}"""


_PLANTED = f"seeds AS (SELECT '{START}' AS address, 5000.0::DOUBLE AS amount)"
_TAINTED = "SELECT address, round(tainted / received, 6) AS taint_ratio, round(tainted, 4) AS tainted_value_usd, round(received, 4) AS received_value_usd, hops::INT AS hops, '{}' AS model FROM result"


def _tainted(s: SparkSession, d: str, model: str) -> DataFrame:
    found = taint.propagate(_t(s, d), _seed(s), model)
    return found.withColumns({"taint_ratio": F.round("taint_ratio", 6), "tainted_value_usd": F.round("tainted_value_usd", 4), "received_value_usd": F.round("received_value_usd", 4)})


query("taint_haircut", _taint_sql(taint.HAIRCUT, _PLANTED, _TAINTED.format("haircut")))(lambda s, d: _tainted(s, d, taint.HAIRCUT))
query("taint_fifo", _taint_sql(taint.FIFO, _PLANTED, _TAINTED.format("fifo")))(lambda s, d: _tainted(s, d, taint.FIFO))
query("taint_in_batches", _taint_sql(taint.FIFO, _PLANTED, "SELECT address, round(tainted, 4) AS tainted_value_usd, hops::INT AS hops FROM result"))(
    lambda s, d: live_taint.in_batches(_t(s, d), _seed(s), ["2024-01-05 00:00:00", "2024-01-12 06:00:00"], taint.FIFO).select("address", F.round("tainted_value_usd", 4).alias("tainted_value_usd"), "hops")
)
_RISKIEST = f"""{WALLETS}, worst AS (SELECT address, max(risk_score) AS risk FROM wallets GROUP BY 1 ORDER BY risk DESC, address LIMIT 3),
seeds AS (SELECT address, coalesce((SELECT sum(value_usd) FROM transfers WHERE from_address = address), (SELECT sum(value_usd) FROM transfers WHERE to_address = address)) AS amount FROM worst)"""
query("taint_summary", _taint_sql(taint.HAIRCUT, _RISKIEST, """SELECT address, round(tainted / received, 6) AS taint_ratio, round(tainted / received * 100, 2) AS taint_percent, round(tainted, 2) AS tainted_value_usd, round(received, 2) AS received_value_usd, hops::INT AS hops, 'haircut' AS model
FROM result ORDER BY tainted DESC, address LIMIT 20"""))(lambda s, d: taint.summary(taint.propagate(_t(s, d), taint.default_sources(_t(s, d), views.wallets(s, d)))))
query("requested_taint", _taint_sql(taint.HAIRCUT, _RISKIEST, "SELECT address, round(tainted, 2) AS tainted_value_usd, hops::INT AS hops FROM result ORDER BY tainted DESC, address LIMIT 7", max_hops=2))(
    lambda s, d: forensics.requested("taint", _tables(s, d), max_hops=2, top_n=7).select("address", "tainted_value_usd", "hops")
)
query("default_taint_sources", f"""WITH {TRANSFERS}, {WALLETS}, w AS (SELECT address, max(risk_score) AS r FROM wallets GROUP BY 1 ORDER BY r DESC, address LIMIT 3)
SELECT address, round(coalesce((SELECT sum(value_usd) FROM transfers WHERE from_address = address), (SELECT sum(value_usd) FROM transfers WHERE to_address = address)), 2) AS amount_usd FROM w""")(lambda s, d: taint.default_sources(_t(s, d), views.wallets(s, d)).select("address", _r("amount_usd", 2)))


# -- sources -----------------------------------------------------------------------------
@query("utxo_legs", """WITH i AS (SELECT l_orderkey AS txid, 'in' || (l_partkey % 50) AS a, CAST(l_quantity AS BIGINT) * 1000 AS v FROM lineitem), o AS (SELECT l_orderkey AS txid, 'in' || (l_suppkey % 50) AS a, CAST(l_quantity AS BIGINT) * 990 AS v FROM lineitem),
n AS (SELECT txid, a, CAST(sum(v) AS HUGEINT) AS net FROM (SELECT txid, a, -v AS v FROM i UNION ALL SELECT * FROM o) GROUP BY 1, 2 HAVING sum(v) <> 0), s AS (SELECT txid, a, -net AS sent FROM n WHERE net < 0), g AS (SELECT txid, a, net AS got FROM n WHERE net > 0), t AS (SELECT txid, sum(sent) AS total FROM s GROUP BY 1),
l AS (SELECT g.txid, s.a AS from_address, g.a AS to_address, CAST((got * sent) // CAST(total AS HUGEINT) AS BIGINT) AS value FROM g JOIN s USING (txid) JOIN t USING (txid))
SELECT txid, from_address, to_address, value, CAST(row_number() OVER (PARTITION BY txid ORDER BY to_address, from_address) - 1 AS INTEGER) AS leg_index FROM l WHERE value > 0""")
def _utxo(s: SparkSession, d: str) -> DataFrame:
    coin = lambda key, rate: F.collect_list(F.struct(F.concat(F.lit("in"), (F.col(key) % 50).cast("string")).alias("address"), (F.col("l_quantity").cast("long") * rate).alias("value")))
    tx = views.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("txid")).agg(coin("l_partkey", 1000).alias("inputs"), coin("l_suppkey", 990).alias("outputs"))
    legs = chains.utxo_legs(tx.select("txid", F.lit(None).cast("long").alias("fee"), F.lit(False).alias("is_coinbase"), "inputs", "outputs"))
    return legs.withColumn("value", F.col("value").cast("long"))


_said = lambda p, flags="i": f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}', '{flags}')"
_kind_sql = "CASE " + " ".join(f"WHEN {' OR '.join(_said(p) for p in ps)} THEN '{k}'" for k, ps in router.KINDS.items()) + f" ELSE '{router.FALLBACK}' END"
# this engine's patterns know no look-ahead: what follows is a group of its own
_name_sql = {k: f"nullif(regexp_extract(text, '{p.removeprefix('(?i)').replace('(?![a-f0-9])', '([^a-fA-F0-9]|$)')}', 1, 'i'), '')" for k, p in router.NAMED.items()}
_name_sql["chain"] = f"upper({_name_sql['chain']}[1]) || lower({_name_sql['chain']}[2:])"
query("nl_classify", f"SELECT conv_id, turn, {_kind_sql} AS kind, {', '.join(f'{v} AS {k}' for k, v in _name_sql.items())} FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')")(lambda s, d: router.classify(views.table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")).drop("text"))
query("chains", f"""WITH {WALLETS}, c AS (SELECT * FROM (VALUES (1::BIGINT, 'Ethereum', 'ETH'), (137, 'Polygon', 'MATIC'), (56, 'BSC', 'BNB'), (42161, 'Arbitrum', 'ETH'), (10, 'Optimism', 'ETH'), (8453, 'Base', 'ETH')) t(chain_id, name, symbol))
SELECT chain_id, name, symbol, count(wallet_id) AS wallet_count FROM c LEFT JOIN wallets ON chain = name GROUP BY ALL""")(
    lambda s, d: views.wallets(s, d).groupBy(F.col("chain").alias("name")).agg(F.count("*").alias("n")).join(chains.chains(s), "name", "right").select("chain_id", "name", "symbol", F.coalesce("n", F.lit(0)).alias("wallet_count"))
)

# -- evidence ------------------------------------------------------------------------------
query("evidence_hashes", f"WITH {TRANSACTIONS} SELECT block_number AS position, sha256(tx_hash || '|' || from_address || '|' || to_address || '|' || value) AS record_hash FROM transactions")(
    lambda s, d: evidence.plain_hashes(views.chain_transactions(s, d), ["tx_hash", "from_address", "to_address", "value"]).select(F.col("block_number").alias("position"), "record_hash")
)
_hashes = lambda s, d: evidence.plain_hashes(views.chain_transactions(s, d), ["tx_hash", "from_address", "to_address", "value"]).select(F.col("block_number").alias("position"), "record_hash")
query("merkle_root", f"""WITH RECURSIVE {TRANSACTIONS}, h0 AS (SELECT list(sha256(tx_hash || '|' || from_address || '|' || to_address || '|' || value) ORDER BY block_number) AS l FROM transactions),
r(l) AS (SELECT l FROM h0 UNION ALL SELECT list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1]))) FROM r WHERE len(l) > 1) SELECT l[1] AS merkle_root FROM r WHERE len(l) = 1""")(lambda s, d: evidence.merkle_root(_hashes(s, d)))
query("evidence_chain", f"""WITH RECURSIVE {TRANSACTIONS}, h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY block_number) AS i, block_number AS position, sha256(tx_hash || '|' || from_address || '|' || to_address || '|' || value) AS record_hash FROM transactions),
r(i, link) AS (SELECT 0::BIGINT, sha256('') UNION ALL SELECT h.i, sha256(r.link || h.record_hash) FROM r JOIN h ON h.i = r.i + 1) SELECT position, record_hash, link, '' AS chain FROM h JOIN r USING (i)""")(lambda s, d: evidence.hash_chain(_hashes(s, d)))


@query("evidence_records", f"""WITH {TRANSACTIONS} SELECT block_number AS position, tx_hash AS record_id, sha256('{{"payload":{{"from_address":"' || from_address || '","to_address":"' || to_address || '","value":"' || value || '"}},"record_id":"' || tx_hash || '","record_type":"transaction","source":"' || chain || '"}}') AS record_hash FROM transactions""")
def _records(s: SparkSession, d: str) -> DataFrame:
    t = views.chain_transactions(s, d)
    return evidence.record_hashes(t.select(F.col("block_number").alias("position"), F.col("tx_hash").alias("record_id"), F.lit("transaction").alias("record_type"), F.col("chain").alias("source"), F.to_json(F.struct("from_address", "to_address", "value")).alias("payload")))


# -- merging and lookups ------------------------------------------------------------------
query("wallets_in_batches", f"""WITH {TRANSFERS}, l AS (SELECT from_address AS address, chain, timestamp, value_usd AS s, 0 AS r FROM transfers UNION ALL SELECT to_address, chain, timestamp, 0, value_usd FROM transfers)
SELECT address, chain, count(*) AS tx_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, CAST(sum(CAST(s AS DECIMAL(38,2))) AS DOUBLE) AS sent_usd, CAST(sum(CAST(r AS DECIMAL(38,2))) AS DOUBLE) AS received_usd FROM l GROUP BY 1, 2""")(
    lambda s, d: merges.in_batches(_t(s, d), ["2024-01-08 00:00:00", "2024-01-20 12:00:00"]).drop("label", "risk_score")
)


@query("upsert_wallets", f"""WITH {TRANSFERS}, l AS (SELECT from_address AS address, chain, timestamp, value_usd AS s, 0 AS r FROM transfers UNION ALL SELECT to_address, chain, timestamp, 0, value_usd FROM transfers)
SELECT address, chain, CAST(sum(1) AS BIGINT) AS tx_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, CAST(sum(CAST(s AS DECIMAL(38,2))) AS DOUBLE) AS sent_usd, CAST(sum(CAST(r AS DECIMAL(38,2))) AS DOUBLE) AS received_usd FROM l GROUP BY 1, 2""")
def _upsert_wallets(s: SparkSession, d: str) -> DataFrame:
    """Two halves of the transfers, merged one after the other."""
    t = _t(s, d)

    def facts(part: DataFrame) -> DataFrame:
        legs = part.select("chain", "timestamp", F.inline(F.array(
            F.struct(F.col("from_address").alias("address"), F.col("value_usd").alias("sent"), F.lit(0.0).alias("received")), F.struct(F.col("to_address").alias("address"), F.lit(0.0).alias("sent"), F.col("value_usd").alias("received")),
        )))
        return legs.groupBy("address", "chain").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("tx_count"), total(F.col("sent")).alias("sent_usd"), total(F.col("received")).alias("received_usd"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("risk_score"))

    merged = store.upsert_wallets(facts(t.where("block_number % 2 = 0")), facts(t.where("block_number % 2 = 1")))
    return merged.select("address", "chain", "tx_count", "first_seen", "last_seen", "sent_usd", "received_usd")


_RANK_OF = "CASE confidence WHEN 'CONFIRMED' THEN 4 WHEN 'HIGH_CONFIDENCE' THEN 3 WHEN 'PROBABLE' THEN 2 ELSE 1 END"
query("upsert_entities", f"""WITH {ENTITIES}, b AS (SELECT name, address, confidence, 0 AS k FROM entities UNION ALL SELECT 'Renamed ' || name, address, 'HIGH_CONFIDENCE', 1 FROM entities)
SELECT name, address, confidence FROM b QUALIFY row_number() OVER (PARTITION BY address ORDER BY {_RANK_OF} DESC, k DESC, name) = 1""")(
    lambda s, d: store.upsert_entities(views.entities(s, d), views.entities(s, d).withColumn("name", F.concat(F.lit("Renamed "), "name")).withColumn("confidence", F.lit("HIGH_CONFIDENCE"))).select("name", "address", "confidence")
)
query("update_risk", f"WITH {WALLETS}, {ENTITIES} SELECT wallet_id, CASE WHEN address IN (SELECT address FROM entities WHERE entity_type = 'mixer') THEN 99 ELSE risk_score END AS risk_score FROM wallets")(
    lambda s, d: store.update_risk(views.wallets(s, d), views.entities(s, d).where("entity_type = 'mixer'").select("address", F.lit(99.0).alias("risk_score"))).select("wallet_id", "risk_score")
)
query("entity_lookup", f"WITH {WALLETS}, {ENTITIES} SELECT wallet_id, name, entity_type FROM wallets w LEFT JOIN entities e ON w.address = e.address AND w.chain = 'Ethereum'")(
    lambda s, d: store.lookup_entities(views.wallets(s, d), views.entities(s, d)).select("wallet_id", "name", "entity_type")
)
query("notice_rows", f"""WITH {TRANSACTIONS}, l AS (SELECT tx_hash, block_number, CAST(value_usd AS DOUBLE) AS value_usd, value_usd AS v FROM transactions WHERE '{START}' IN (from_address, to_address) ORDER BY block_number DESC, tx_hash LIMIT 20)
SELECT tx_hash, block_number, value_usd, (SELECT CAST(sum(v) AS DOUBLE) FROM l) AS total_usd FROM l""")(lambda s, d: store.notice_rows(views.chain_transactions(s, d), START))
query("case_narrative", f"WITH {WALLETS} SELECT case_id, count(*) AS wallet_count, count(*) FILTER (attribution_status = 'attributed') AS attributed, count(*) FILTER (risk_score >= 75) AS critical, count(*) FILTER (risk_score >= 50 AND risk_score < 75) AS high, count(*) FILTER (risk_score >= 25 AND risk_score < 50) AS medium, count(*) FILTER (risk_score < 25) AS low FROM wallets GROUP BY 1")(
    lambda s, d: store.narrative(views.wallets(s, d))
)
query("compare_wallets", f"""WITH {TRANSFERS}, s AS (SELECT from_address AS address, count(DISTINCT tx_hash) AS n, {_SUM} AS v FROM transfers GROUP BY 1), g AS (SELECT to_address AS address, count(DISTINCT tx_hash) AS n, {_SUM} AS v FROM transfers GROUP BY 1),
w AS (SELECT address, coalesce(s.n, 0)::DOUBLE AS sent_count, coalesce(s.v, 0)::DOUBLE AS sent_usd, coalesce(g.n, 0)::DOUBLE AS received_count, coalesce(g.v, 0)::DOUBLE AS received_usd FROM s FULL JOIN g USING (address)),
u AS (UNPIVOT (SELECT * FROM w WHERE address IN ('{START}', '0x' || lpad('3', 40, '0'))) ON sent_count, sent_usd, received_count, received_usd INTO NAME measure VALUE v)
SELECT measure, max(v) FILTER (address = '{START}') AS left_value, max(v) FILTER (address <> '{START}') AS right_value FROM u GROUP BY 1""")(lambda s, d: store.compare_wallets(wallets.wallet_stats(_t(s, d)), START, "0x" + "0" * 39 + "3"))


# -- raw sources over derived rows -------------------------------------------------------------
@query("trc20_legs", """SELECT 't' || event_id AS tx_hash, CASE WHEN event_id % 3 = 0 THEN CAST(CAST(floor(value * 1000000) AS BIGINT) AS DOUBLE) / 1e6 WHEN event_id % 3 = 1 THEN CAST(CAST(floor(value * 1000000) AS BIGINT) AS DOUBLE) / 1e2 ELSE CAST(CAST(floor(value * 1000000) AS BIGINT) AS DOUBLE) END AS value FROM events""")
def _trc20(s: SparkSession, d: str) -> DataFrame:
    """Decimals from the entry, from a table of tokens, or unknown."""
    e, kind = views.table(s, d, "events"), F.col("event_id") % 3
    token = F.struct(F.concat(F.lit("T"), kind.cast("string")).alias("address"), F.lit("TOK").alias("symbol"), F.when(kind == 0, 6).alias("decimals"))
    rows = e.select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("transaction_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("block_timestamp"), F.lit("a").alias("from"), F.lit("b").alias("to"), F.floor(F.col("value") * 1_000_000).cast("string").alias("value"), token.alias("token_info"))
    return chains.trc20_legs(rows, s.createDataFrame([("T1", 2)], "address string, decimals int")).select("tx_hash", "value")


@query("asset_transfers", "SELECT 'h' || event_id AS tx_hash, event_id AS block_number, ts AS timestamp, CASE WHEN event_id % 2 = 0 THEN value * 2000 END AS value_usd FROM events")
def _assets(s: SparkSession, d: str) -> DataFrame:
    """Indexer rows: hex blocks and ISO times, priced where there is a price."""
    e = views.table(s, d, "events")
    rows = e.select(
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("hash"), F.lit("a").alias("from"), F.lit("b").alias("to"), "value", F.when(F.col("event_id") % 2 == 0, "ETH").otherwise("XYZ").alias("asset"),
        F.concat(F.lit("0x"), F.hex("event_id")).alias("blockNum"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("blockTimestamp"), F.lit("external").alias("category"),
    )
    return chains.asset_transfers(rows, s.createDataFrame([("ETH", 2000.0)], "asset string, usd double")).select("tx_hash", "block_number", "timestamp", "value_usd")


@query("log_transfers", f"SELECT 'l' || event_id // 2 AS tx_hash, {_HEX.format('max(user_id)', 40)} AS from_address, CAST(max(event_id) * 1000 AS VARCHAR) AS value FROM events GROUP BY event_id // 2")
def _logs(s: SparkSession, d: str) -> DataFrame:
    """Two logs of a transaction, sent and received: the received one counts."""
    e = views.table(s, d, "events")
    most = F.max("user_id").over(Window.partitionBy(F.expr("event_id div 2")))
    logs = e.select("event_id", F.concat(F.lit("l"), F.expr("event_id div 2").cast("string")).alias("transactionHash"), F.array(F.lit("0xddf2"), views.hex_id(most, 64), views.hex_id(F.col("event_id"), 64)).alias("topics"), views.hex_id(F.col("event_id") * 1000, 64).alias("data"), F.concat(F.lit("0x"), F.hex("event_id")).alias("blockNumber"))
    return chains.log_transfers(logs.where("event_id % 2 = 0").drop("event_id"), logs.where("event_id % 2 = 1").drop("event_id")).select("tx_hash", "from_address", "value")


@query("sanctioned_addresses", f"""SELECT 'OFAC: ' || s_name AS name, {_HEX.format('s_suppkey', 40)} AS address, CASE s_suppkey % 4 WHEN 0 THEN 'Ethereum' WHEN 1 THEN 'Ethereum Classic' ELSE 'BSC' END AS chain, 'P' || s_suppkey % 5 AS program FROM supplier WHERE s_suppkey % 4 < 3""")
def _listed_addresses(s: SparkSession, d: str) -> DataFrame:
    """A sanctions list with its fixed columns, one entry per supplier."""
    k = F.col("s_suppkey")
    code = F.when(k % 4 == 0, "ETH").when(k % 4 == 1, "ETC").when(k % 4 == 2, "BNB").otherwise("XBT")
    remark = F.concat(F.lit("DOB 1970; Digital Currency Address - "), code, F.lit(" "), views.hex_id(k, 40), F.lit("; alt. Digital Currency Address - XMR 4abc."))
    rows = views.table(s, d, "supplier").select(k.cast("string").alias("_c0"), F.col("s_name").alias("_c1"), F.lit("x").alias("_c2"), F.concat(F.lit("[P"), (k % 5).cast("string"), F.lit("]")).alias("_c3"), *[F.lit("").alias(f"_c{i}") for i in range(4, 11)], remark.alias("_c11"))
    return chains.sanctioned(rows).select("name", "address", "chain", "program")


query("held_tokens", "SELECT event_id FROM events WHERE event_id % 5 <> 0")(
    lambda s, d: chains.held_tokens(views.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "0x" + "0" * 64).otherwise(views.hex_id(F.col("event_id"), 64)).alias("tokenBalance"))).select("event_id")
)
query("block_filter", f"WITH {TRANSFERS} SELECT tx_hash FROM transfers WHERE block_number = 0 OR block_number BETWEEN 100 AND 500")(lambda s, d: chains.in_blocks(_t(s, d), 100, 500).select("tx_hash"))
query("address_checks", None)(lambda s, d: _addresses(s, d))
@query("account_walk", f"WITH {TRANSFERS}, r AS (SELECT from_address AS account, tx_hash, value_usd, row_number() OVER (PARTITION BY from_address ORDER BY block_number DESC, tx_hash) - 1 AS n FROM transfers) SELECT account, CAST(n // 25 AS INTEGER) + 1 AS page, CAST(n % 25 AS INTEGER) AS place, tx_hash, value_usd FROM r")
def _account_walk(s: SparkSession, d: str) -> DataFrame:
    """Every account's transfers laid down as pages of 25, and walked by cursor."""
    folder = shared_dir(ship(s), "account-pages")
    pages.lay_down(_t(s, d).select("tx_hash", "from_address", "value_usd", "block_number"), folder, "from_address", [F.desc("block_number"), F.col("tx_hash")], 25).count()
    entry = lambda name: F.get_json_object("entry", f"$.{name}")
    return pages.register(s).read.format("account_pages").option("path", folder).load().select("account", "page", "place", entry("tx_hash").alias("tx_hash"), entry("value_usd").cast("double").alias("value_usd"))


query("entity_directory", "SELECT s_name AS name, lower('0x' || upper(lpad(lower(to_hex(s_suppkey)), 40, '0'))) AS address, CASE WHEN i = 1 THEN 'Ethereum' ELSE 'Polygon' END AS chain, CASE WHEN s_suppkey % 10 = 3 THEN 'mixer' ELSE 'exchange' END AS entity_type FROM supplier, (VALUES (1), (137)) t(i) WHERE i = 1 OR s_suppkey % 2 = 0")(
    lambda s, d: chains.directory_rows(views.directory(s, d)).select("name", "address", "chain", "entity_type")
)
_INTEL = """intel AS (SELECT '0x' || lpad(lower(to_hex(s_suppkey)), 40, '0') AS address, s_suppkey % 7 <> 6 AS answered, CASE WHEN s_suppkey % 5 <> 4 THEN ['exchange', 'mixer', 'sanctions', 'gambling', ''][s_suppkey % 5 + 1] END AS category, s_name AS name, CAST(s_suppkey % 101 AS DOUBLE) AS risk FROM supplier)"""
query("entity_intelligence", f"""WITH {WALLETS}, {_INTEL} SELECT wallet_id, CASE WHEN answered THEN coalesce(category, name) END AS entity_name, CASE WHEN answered THEN category END AS entity_category, CASE WHEN answered THEN risk END AS risk_score,
  coalesce(answered AND category = 'sanctions', false) AS is_sanctioned, NOT answered AS failed FROM wallets LEFT JOIN intel USING (address)""")(
    lambda s, d: store.with_intelligence(views.wallets(s, d), chains.intelligence(views.intelligence_answers(s, d))).select("wallet_id", "entity_name", "entity_category", "risk_score", "is_sanctioned", "failed")
)
query("event_metadata", """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 3 THEN left(props, 4) WHEN event_id % 11 = 5 THEN '[1]' WHEN event_id % 11 = 7 THEN NULL ELSE props END AS metadata FROM events)
SELECT event_id, CASE WHEN json_valid(metadata) AND left(metadata, 1) = '{' THEN CAST(json_extract_string(metadata, '$.k') AS BIGINT) END AS k, coalesce(json_valid(metadata) AND left(metadata, 1) = '{', false) AS is_object FROM e""")(
    lambda s, d: metadata.with_fields(views.event_metadata(s, d), "metadata", k="long").select("event_id", "k", metadata.is_object(F.col("metadata")).alias("is_object"))
)
_RUNS = """runs AS (SELECT o_custkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, '{"orders":' || CAST(o_orderkey AS VARCHAR) || '}' AS found FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""
query("report_sections", f"""WITH {CASES}, {WALLETS}, {_RUNS}, lines AS (
  SELECT case_id, 1 AS section, 'Case Overview' AS title, unnest([1, 2, 3]) AS line, unnest(['Case ' || case_number || ': ' || title, 'Crime type: ' || crime_type, 'Status: ' || status]) AS text FROM cases
  UNION ALL SELECT c.case_id, 2, 'Tracked Wallets', coalesce(row_number() OVER (PARTITION BY c.case_id ORDER BY risk_score DESC, address, wallet_id), 1), CASE WHEN wallet_id IS NULL THEN 'No wallets tracked in this case.' ELSE '- ' || address || ' (' || chain || ') - risk score ' || printf('%.2f', risk_score) || ', attribution: ' || attribution_status END FROM cases c LEFT JOIN wallets w ON w.case_id = c.case_id
  UNION ALL SELECT r.case_id, 3, 'Investigation Findings', unnest([1, 2]), unnest(['Investigation status: ' || r.status, found]) FROM runs r JOIN cases USING (case_id))
SELECT case_id, section::INT AS section, title, line::INT AS line, text FROM lines""")(lambda s, d: store.report_sections(views.cases(s, d), views.wallets(s, d), views.investigation_runs(s, d)))


def _addresses(s: SparkSession, d: str) -> DataFrame:
    """Checksummed form and validity of every address."""
    a = wallets.addresses(_t(ship(s), d))
    return a.select("address", codecs.checksum_address_udf("address").alias("checksum"), codecs.is_bitcoin_udf("address").alias("bitcoin"), codecs.is_tron_udf("address").alias("tron"))


# -- more sources ------------------------------------------------------------------------------
_TRON = lambda n: F.concat(F.lit("41"), F.lpad(F.lower(F.hex(n)), 40, "0"))


@query("tron_native", """SELECT 't' || event_id AS tx_hash, event_id AS block_number, event_id % 3 <> 0 AS ok, CASE WHEN event_id % 4 = 1 THEN 'transfer' ELSE 'TransferContract' END AS method, CAST(event_id * 1000 AS VARCHAR) AS raw_value,
CASE WHEN event_id % 8 = 1 THEN CAST(event_id * 1000 AS DOUBLE) ELSE event_id * 1000 / 1e6 END AS value, event_id % 8 <> 1 AS decimals_known, CASE WHEN event_id % 4 <> 1 THEN 'TRX' WHEN event_id % 8 = 5 THEN 'USDT' END AS asset FROM events WHERE event_id % 4 < 2""")
def _tron_native(s: SparkSession, d: str) -> DataFrame:
    """Payments of TRX and calls of a token's transfer; other contracts and empty entries don't count."""
    e, k = views.table(s, d, "events"), F.col("event_id")
    data = F.concat(F.lit("a9059cbb"), F.lpad(F.lower(F.hex("user_id")), 64, "0"), F.lpad(F.lower(F.hex(k * 1000)), 64, "0"))
    value = F.struct(_TRON(F.col("user_id")).alias("owner_address"), _TRON(k).alias("to_address"), (k * 1000).alias("amount"), data.alias("data"), _TRON(F.when(k % 8 == 5, 7).otherwise(8).cast("long")).alias("contract_address"))
    kind = F.when(k % 4 == 0, "TransferContract").when(k % 4 == 1, "TriggerSmartContract").otherwise("VoteWitnessContract")
    contracts = F.when(k % 4 == 3, F.array().cast("array<struct<type: string, parameter: struct<value: struct<owner_address: string, to_address: string, amount: bigint, data: string, contract_address: string>>>>")).otherwise(F.array(F.struct(kind.alias("type"), F.struct(value.alias("value")).alias("parameter"))))
    rows = e.select(
        F.concat(F.lit("t"), k.cast("string")).alias("txID"), k.alias("blockNumber"), F.unix_millis(F.col("ts").cast("timestamp")).alias("block_timestamp"), F.array(F.struct(F.when(k % 3 == 0, "REVERT").otherwise("SUCCESS").alias("contractRet"))).alias("ret"),
        F.struct(F.lit(None).cast("long").alias("timestamp"), contracts.alias("contract")).alias("raw_data"),
    )
    known = s.createDataFrame([(codecs.tron_address(f"{7:040x}"), "USDT", 6)], "address string, symbol string, decimals int")
    return chains.tron_native(rows, known).select("tx_hash", "block_number", "ok", "method", "raw_value", "value", "decimals_known", "asset")


query("erc20_transfers", "SELECT 'h' || event_id AS tx_hash FROM events WHERE event_id % 3 = 1")(
    lambda s, d: chains.asset_transfers(views.table(s, d, "events").select(
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("hash"), F.lit("a").alias("from"), F.lit("b").alias("to"), "value", F.lit("TOK").alias("asset"), F.lit("0x1").alias("blockNum"), F.lit("").alias("blockTimestamp"),
        F.when(F.col("event_id") % 3 == 0, "external").when(F.col("event_id") % 3 == 1, "erc20").otherwise("erc721").alias("category"),
    ), categories=("erc20",)).select("tx_hash")
)
query("transactions_of_logs", f"""WITH {TRANSFERS}, h AS (SELECT tx_hash, block_number FROM transfers WHERE block_number % 2 = 0 ORDER BY 2, 1 LIMIT 100 OFFSET 100)
SELECT tx_hash, CASE WHEN block_number % 3 = 0 THEN NULL ELSE '0xa9059cbb' END AS method FROM transfers WHERE tx_hash IN (SELECT tx_hash FROM h)""")(
    lambda s, d: chains.transactions_of_logs(_t(s, d).where("block_number % 2 = 0").unionByName(_t(s, d).where("block_number % 4 = 0")), _t(s, d).withColumn("input", F.when(F.col("block_number") % 3 == 0, "0x").otherwise("0xa9059cbb00000000")), page=2).select("tx_hash", "method")
)
query("account_page", f"WITH {TRANSFERS} SELECT tx_hash, timestamp FROM transfers WHERE from_address = '{START}' ORDER BY timestamp DESC, tx_hash LIMIT 20 OFFSET 40")(
    lambda s, d: chains.page_of(wallets.of_wallet(_t(s, d), START).where(F.col("from_address") == START), [F.desc("timestamp"), "tx_hash"], 3, 20).select("tx_hash", "timestamp")
)
query("wallet_scan", f"WITH {TRANSFERS} SELECT tx_hash FROM transfers WHERE '{START}' IN (from_address, to_address) OR block_number % 97 = 5")(lambda s, d: wallets.of_wallet(_t(s, d).withColumn("wallet_id", F.col("block_number") % 97), START, 5).select("tx_hash"))
query("utxo_fees", "WITH i AS (SELECT l_orderkey AS txid, sum(CAST(l_quantity AS BIGINT) * 1000) - sum(CAST(l_quantity AS BIGINT) * 990) AS d FROM lineitem GROUP BY 1) SELECT txid, CAST(CASE WHEN txid % 5 = 0 THEN 77 ELSE greatest(d, 0) END AS BIGINT) AS fee FROM i")(
    lambda s, d: chains.utxo_fees(views.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("txid")).agg(
        F.collect_list(F.struct((F.col("l_quantity").cast("long") * 1000).alias("value"))).alias("inputs"), F.collect_list(F.struct((F.col("l_quantity").cast("long") * 990).alias("value"))).alias("outputs")
    ).withColumn("fee", F.when(F.col("txid") % 5 == 0, F.lit(77).cast("long"))))
)
query("address_legs", f"""WITH {TRANSFERS} SELECT tx_hash, CASE WHEN block_number % 10 = 0 THEN 0 ELSE block_number END AS block_number FROM transfers WHERE '{START}' IN (from_address, to_address) AND (block_number % 10 = 0 OR block_number BETWEEN 100 AND 8000) ORDER BY 2 DESC, 1 LIMIT 25 OFFSET 25""")(
    lambda s, d: chains.address_legs(_t(s, d).select(F.col("tx_hash").alias("txid"), "from_address", "to_address", F.col("value_usd").alias("value"), F.lit(0).alias("leg_index"), F.when(F.col("block_number") % 10 == 0, F.lit(0)).otherwise(F.col("block_number")).cast("long").alias("block_number")), START, 100, 8000, 2, 25).select(F.col("txid").alias("tx_hash"), "block_number")
)
query("call_transfers", "SELECT 'c' || event_id AS tx_hash, CAST(event_id * 7 AS VARCHAR) AS value FROM events WHERE event_id % 3 = 0")(
    lambda s, d: chains.call_transfers(views.table(s, d, "events").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("tx_hash"), F.concat(F.when(F.col("event_id") % 3 == 0, "a9059cbb").otherwise("23b872dd"), F.lpad(F.hex("user_id"), 64, "0"), F.lpad(F.hex(F.col("event_id") * 7), 64, "0")).alias("data"))).select("tx_hash", "value")
)
query("chain_resolve", f"WITH {WALLETS} SELECT wallet_id, CASE chain WHEN 'Polygon' THEN 137 WHEN 'Ethereum' THEN 1 END::BIGINT AS chain_id, CASE chain WHEN 'Polygon' THEN 'MATIC' ELSE 'ETH' END AS native_symbol, chain AS chain_name FROM wallets")(
    lambda s, d: chains.chain_info(chains.resolve_chains(views.wallets(s, d)).drop("native_symbol")).select("wallet_id", "chain_id", "native_symbol", "chain_name")
)
query("evm_addresses", f"WITH {TRANSFERS}, a AS (SELECT from_address AS address FROM transfers UNION SELECT to_address FROM transfers) SELECT address, 1 AS chain_id FROM a UNION ALL SELECT 'x' || address, NULL FROM a")(
    lambda s, d: wallets.addresses(_t(ship(s), d)).unionByName(wallets.addresses(_t(s, d)).select(F.concat(F.lit("x"), "address").alias("address"))).select("address", chains.detect_chain(F.col("address")).alias("chain_id"))
)
query("bitcoin_amounts", "SELECT event_id, rtrim(rtrim(CAST(CAST(event_id * 12345 AS DECIMAL(30,8)) / 100000000 AS DECIMAL(30,8))::VARCHAR, '0'), '.') AS btc FROM events")(lambda s, d: views.table(s, d, "events").select("event_id", chains.bitcoins(F.col("event_id") * 12345).alias("btc")))
query("nonces_and_blocks", f"""WITH {TRANSFERS} SELECT tx_hash, row_number() OVER (PARTITION BY chain, from_address ORDER BY timestamp, tx_hash) - 1 AS nonce, CAST(18900000 + round_even((epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 12, 0) AS BIGINT) AS block FROM transfers""")(
    lambda s, d: chains.nonces(_t(s, d)).select("tx_hash", "nonce", chains.block_at(F.col("timestamp"), 18_900_000, "2024-01-01 00:00:00", 12.0).alias("block"))
)

# -- merges and listings of the graph ----------------------------------------------------------
_runs = lambda s, d: views.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
_RUNS = "runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS created_at FROM orders)"
query("list_investigations", f"WITH {_RUNS} SELECT run_id, status FROM runs WHERE status IN ('completed', 'failed') ORDER BY created_at DESC, run_id LIMIT 20 OFFSET 20")(lambda s, d: wallets.listed(_runs(s, d), {"status": "completed,failed"}, {"status": ("running", "completed", "failed")}, page=2).select("run_id", "status"))
query("list_reports", "SELECT p_partkey AS report_id, p_name AS title FROM part WHERE lower(p_name) LIKE '%a%' ORDER BY p_size DESC, p_partkey LIMIT 50")(
    lambda s, d: wallets.listed(views.table(s, d, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_name").alias("title"), F.col("p_size").alias("created_at")), {}, search=(("title",), "A"), page_size=50).select("report_id", "title")
)
query("upsert_transactions", f"""WITH {TRANSFERS} SELECT tx_hash, chain, CASE WHEN block_number % 3 = 0 AND block_number % 2 = 0 THEN 1.5 ELSE value_usd END AS value_usd, block_number % 3 = 0 AS is_suspicious, block_number FROM transfers""")(
    lambda s, d: store.upsert_transactions(
        _t(s, d).select("tx_hash", "chain", "block_number", "value_usd", F.lit("m").alias("metadata"), F.lit(False).alias("is_suspicious")),
        _t(s, d).where("block_number % 3 = 0").select(F.upper("tx_hash").alias("tx_hash"), "chain", F.lit(-1).cast("long").alias("block_number"), F.when(F.col("block_number") % 2 == 0, 1.5).alias("value_usd"), F.lit(None).cast("string").alias("metadata"), F.lit(True).alias("is_suspicious")),
    ).select("tx_hash", "chain", "value_usd", "is_suspicious", "block_number")
)
query("wallet_links", f"""WITH {TRANSFERS}, {WALLETS}, l AS (SELECT from_address AS address, chain, tx_hash, 'sent' AS direction FROM transfers UNION SELECT to_address, chain, tx_hash, 'received' FROM transfers) SELECT * FROM l WHERE (address, chain) IN (SELECT address, chain FROM wallets)""")(lambda s, d: store.wallet_links(views.wallets(s, d), _t(s, d)))
query("entity_links", f"WITH {ENTITIES}, {WALLETS} SELECT DISTINCT address, 'Ethereum' AS chain, name, confidence FROM entities WHERE address IN (SELECT address FROM wallets WHERE chain = 'Ethereum')")(lambda s, d: store.entity_links(views.wallets(s, d), views.entities(s, d)))
query("node_projection", f"""WITH {TRANSFERS}, {WALLETS}, l AS (SELECT chain, from_address AS address FROM transfers UNION ALL SELECT chain, to_address FROM transfers WHERE to_address <> from_address), c AS (SELECT chain, address, count(*) AS n FROM l GROUP BY 1, 2), w AS (SELECT chain, address, max(risk_score) AS risk_score FROM wallets GROUP BY 1, 2)
SELECT chain, address, risk_score, coalesce(n, 0) AS tx_count FROM w FULL JOIN c USING (chain, address)""")(lambda s, d: graph.node_projection(_t(s, d), views.wallets(s, d).withColumn("label", F.lit(None).cast("string"))).drop("label"))
query("hop_levels", f"""WITH RECURSIVE {_BOTH}, o AS (SELECT DISTINCT from_address AS a, to_address AS b FROM transfers), f(n, h) AS (SELECT '{START}', 0 UNION SELECT o.b, f.h + 1 FROM f JOIN o ON o.a = f.n WHERE f.h < 3), g(n, h) AS (SELECT '{START}', 0 UNION SELECT e.b, g.h + 1 FROM g JOIN e ON e.a = g.n WHERE g.h < 3),
d AS (SELECT n, min(h) AS h FROM f GROUP BY 1), u AS (SELECT n, min(h) AS h FROM g GROUP BY 1) SELECT n AS address, CAST(h AS INTEGER) AS hops, true AS directed FROM d UNION ALL SELECT n, CAST(h AS INTEGER), false FROM u WHERE n NOT IN (SELECT n FROM d)""")(lambda s, d: graph.hop_levels(_t(s, d), START, 3))
query("traced_paths", f"""WITH RECURSIVE {TRANSFERS}, e AS (SELECT from_address AS a, to_address AS b, {_SUM} AS v FROM transfers WHERE value_usd >= 100 AND from_address <> to_address GROUP BY 1, 2),
p(n, h, path, v) AS (SELECT '{START}', 0, ['{START}'], 0::DOUBLE UNION ALL SELECT e.b, p.h + 1, list_append(p.path, e.b), p.v + e.v FROM p JOIN e ON e.a = p.n WHERE p.h < 2 AND NOT list_contains(p.path, e.b))
SELECT list_aggregate(path, 'string_agg', ',') AS path, CAST(h AS INTEGER) AS length, round(v, 2) AS value_usd FROM p WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY n ORDER BY h, path) = 1""")(lambda s, d: graph.traced_paths(_t(s, d), START, 2, 100.0).select(F.array_join("path", ",").alias("path"), "length", _r("value_usd", 2)))
query("wallet_activity_cases", f"""WITH {WALLETS}, {TRANSFERS}, l AS (SELECT from_address AS address FROM transfers UNION ALL SELECT to_address FROM transfers), w AS (SELECT address, list_aggregate(list_sort(list(DISTINCT case_id)), 'string_agg', ',') AS cases FROM wallets GROUP BY 1)
SELECT address, count(*) AS tx_count, any_value(cases) AS cases FROM l LEFT JOIN w USING (address) GROUP BY 1""")(lambda s, d: wallets.activity(_t(s, d), views.wallets(s, d)).select("address", "tx_count", F.array_join(F.col("cases").cast("array<string>"), ",").alias("cases")))
query("balance_violations_by_case", f"""WITH {TRANSFERS}, t AS (SELECT *, block_number % 5 AS case_id, CASE WHEN block_number % 2 = 0 THEN 0.25 END AS fee FROM transfers), l AS (SELECT case_id, asset, to_address AS address, CAST(value_usd AS DECIMAL(38,2)) AS v FROM t UNION ALL SELECT case_id, asset, from_address, -CAST(value_usd AS DECIMAL(38,2)) - CAST(coalesce(fee, 0) AS DECIMAL(38,2)) FROM t)
SELECT address, case_id, asset, CAST(sum(v) AS DOUBLE) AS balance_usd FROM l GROUP BY 1, 2, 3 HAVING sum(v) < 0""")(
    lambda s, d: wallets.balance_violations(_t(s, d).withColumn("case_id", F.col("block_number") % 5).withColumn("fee", F.when(F.col("block_number") % 2 == 0, 0.25)), by=("case_id",), fee="fee")
)

# -- certificates, dashboard, questions --------------------------------------------------------
_AT = datetime(2024, 3, 1, 12, 0, 0)
_CERTIFIED = f"""{TRANSACTIONS}, h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY block_number) AS i, block_number AS position, sha256(tx_hash || '|' || from_address || '|' || to_address || '|' || value) AS record_hash FROM transactions),
c(i, link) AS (SELECT 0::BIGINT, sha256('') UNION ALL SELECT h.i, sha256(c.link || h.record_hash) FROM c JOIN h ON h.i = c.i + 1),
m(l) AS (SELECT list(record_hash ORDER BY i) FROM h UNION ALL SELECT list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1]))) FROM m WHERE len(l) > 1)"""
query("certificate", f"""WITH RECURSIVE {_CERTIFIED}, z AS (SELECT (SELECT count(*) FROM h) AS record_count, (SELECT l[1] FROM m WHERE len(l) = 1) AS merkle_root, (SELECT link FROM c ORDER BY i DESC LIMIT 1) AS chain_tip)
SELECT 'TRX-S63-20240301-' || upper(merkle_root[:10]) AS certificate_id, 'TRX-1' AS case_number, 'An Officer' AS officer, '2024-03-01T12:00:00Z' AS generated_at, record_count, merkle_root, chain_tip,
  printf('An Officer certifies that the %d records of case TRX-1 were produced by this system in the ordinary course; Merkle root %s, chain tip %s, at 2024-03-01T12:00:00Z.', record_count, merkle_root, chain_tip) AS declaration FROM z""")(
    lambda s, d: evidence.certificate(_hashes(s, d), "TRX-1", "An Officer", _AT)
)


@query("certificate_problems", f"""WITH RECURSIVE {_CERTIFIED}, f AS (SELECT min(position) AS p FROM h WHERE position % 1000 = 7), n AS (SELECT count(*) AS n FROM h)
SELECT 'changed' AS problem, position FROM h WHERE position % 1000 = 7 UNION ALL SELECT 'added', 10000000 UNION ALL SELECT 'chain', p FROM f UNION ALL SELECT unnest(['record_count', 'merkle_root', 'chain_tip']), NULL""")
def _problems(s: SparkSession, d: str) -> DataFrame:
    """Some records were changed and one was added after they were certified."""
    was = _hashes(s, d)
    now = was.withColumn("record_hash", F.when(F.col("position") % 1000 == 7, F.sha2("record_hash", 256)).otherwise(F.col("record_hash"))).unionByName(s.createDataFrame([(10_000_000, "0" * 64)], "position long, record_hash string"))
    return evidence.verify_certificate(evidence.certificate(was, "TRX-1", "An Officer", _AT), evidence.hash_chain(was), now).select("problem", "position")


query("forensic_summary_full")(lambda s, d: forensics.summary(_t(s, d), views.wallets(s, d)))
_PATTERNS = f"""{TRANSFERS}, e AS (SELECT from_address AS a, to_address AS b, {_SUM} AS v FROM transfers WHERE from_address <> to_address GROUP BY 1, 2 HAVING {_SUM} > 0), k AS (SELECT from_address FROM transfers GROUP BY 1 HAVING count(*) > 10),
p AS (SELECT [x.a, x.b, y.b, w.b] AS who, x.v + y.v + w.v AS v FROM e x JOIN e y ON x.b = y.a JOIN e w ON y.b = w.a WHERE x.a IN (SELECT from_address FROM k) AND y.b <> x.a AND w.b NOT IN (x.a, x.b) ORDER BY v DESC, who LIMIT 20), z AS (SELECT chain, max(timestamp) AS e FROM transfers GROUP BY 1),
r AS (SELECT [from_address] AS who, count(*) AS n, round(value_usd) AS v FROM transfers t JOIN z USING (chain) WHERE timestamp >= e - INTERVAL 24 HOURS GROUP BY t.chain, from_address, round(value_usd) HAVING count(*) >= 3 ORDER BY n DESC, v DESC, from_address, t.chain LIMIT 20),
m AS (SELECT [a.from_address, a.to_address, b.to_address] AS who, least(a.value_usd, b.value_usd) AS v FROM transfers a JOIN transfers b ON a.to_address = b.from_address WHERE a.from_address <> b.to_address AND a.tx_hash <> b.tx_hash AND {_SECS.format("a.timestamp", "b.timestamp")} BETWEEN 0 AND 300),
u AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM (SELECT 'peel_chain' AS pattern, v, who FROM p UNION ALL SELECT 'round_amount', n * v, who FROM r UNION ALL SELECT 'rapid_movement', v, who FROM m))"""
query("pattern_counts", f"WITH {_PATTERNS} SELECT pattern, count(*) AS n, round(max(v), 2) AS most_usd FROM u GROUP BY 1")(lambda s, d: assistant.pattern_counts(_t(s, d)).withColumn("most_usd", F.round("most_usd", 2)))
ASKED = (
    "How risky is wallet {0}?", "Where did the money of {0} flow to?", "Who owns the address {0}?", "When was the last transaction of {0}, as a timeline of its transactions?", "Compare wallet {0} and wallet {1} please",
    "Case {2}: a summary", "Which exchange is {0} attributed to?", "Show suspicious patterns like structuring", "12 + 34 = ?", "What is the risk of the wallets of case {2}?", "Any structuring in case {2}?", "Please sing me a song",
)


def _questions(s: SparkSession, *texts: str) -> DataFrame:
    """Each text about wallets 0 to 19."""
    who = lambda i: f"0x{i:040x}"
    return s.createDataFrame([(1000 * k + i, t.format(who(i), who(i + 1), f"TRX-2024{i + 1:04d}-{i + 1:04d}")) for k, t in enumerate(texts) for i in range(20)], "id long, text string")


_WHO = "who AS (SELECT i AS id, '0x' || lpad(lower(to_hex(i)), 40, '0') AS address, 'TRX-2024' || lpad((i + 1)::VARCHAR, 4, '0') || '-' || lpad((i + 1)::VARCHAR, 4, '0') AS case_number FROM range(20) t(i))"
_SURE = "CASE WHEN {} THEN 'HIGH_CONFIDENCE' ELSE 'UNKNOWN' END AS confidence"
query("assistant_risk", _full_sql(f""", {_WHO} SELECT id, 'risk_summary' AS kind, q.address AS target, CASE WHEN risk_score IS NULL THEN 'No risk factor of wallet ' || q.address || '.'
  ELSE 'Wallet ' || q.address || ' has a risk of ' || printf('%.1f', round(risk_score, 1)) || ' of 100 (' || {_BANDS} || '): ' || replace(factors, ',', ', ') || '.' END AS answer, {_SURE.format("risk_score IS NOT NULL")} FROM who q LEFT JOIN r USING (address)"""))(
    lambda s, d: assistant.answers(_questions(s, ASKED[0]), _tables(s, d))
)
query("assistant_entities", f"""WITH {ENTITIES}, {WALLETS}, {_WHO}, e AS (SELECT DISTINCT ON (address) address, name, entity_type, confidence FROM entities ORDER BY address, name), w AS (SELECT address, count(*) AS n, max(risk_score) AS risk FROM wallets GROUP BY 1)
SELECT id, 'entity_lookup' AS kind, q.address AS target, CASE WHEN name IS NOT NULL THEN q.address || ' belongs to ' || name || ' (' || entity_type || ', ' || confidence || ').' WHEN n IS NOT NULL THEN q.address || ' is a wallet without a known owner, in ' || n || ' cases, with a risk of up to ' || printf('%.0f', risk) || '.' ELSE 'Nothing is known of ' || q.address || '.' END AS answer,
  CASE WHEN name IS NULL AND n IS NULL THEN 'UNKNOWN' ELSE 'HIGH_CONFIDENCE' END AS confidence FROM who q LEFT JOIN e USING (address) LEFT JOIN w USING (address)""")(lambda s, d: assistant.answers(_questions(s, ASKED[2]), _tables(s, d)))
query("assistant_timeline", f"""WITH {TRANSFERS}, {_WHO}, b AS (SELECT from_address AS address, date_trunc('day', timestamp) AS day, count(*) AS n FROM transfers GROUP BY 1, 2), p AS (SELECT address, sum(n)::BIGINT AS n, count(*) AS days, max(n) AS most, arg_max(day, n * 100000 - datediff('day', DATE '1970-01-01', day::DATE)) AS peak FROM b GROUP BY 1)
SELECT id, 'timeline' AS kind, q.address AS target, 'Wallet ' || q.address || CASE WHEN n IS NULL THEN ': no transfers.' ELSE ': ' || n || ' transfers on ' || days || ' days, most on ' || strftime(peak, '%Y-%m-%d') || ' (' || most || ').' END AS answer, CASE WHEN n IS NULL THEN 'UNKNOWN' ELSE 'HIGH_CONFIDENCE' END AS confidence FROM who q LEFT JOIN p USING (address)""")(
    lambda s, d: assistant.answers(_questions(s, ASKED[3]), _tables(s, d))
)
query("assistant_comparison", f"""WITH {TRANSFERS}, {_WHO}, w AS (SELECT address, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT from_address AS address, CAST(value_usd AS DECIMAL(38,2)) AS v FROM transfers UNION ALL SELECT to_address, CAST(value_usd AS DECIMAL(38,2)) FROM transfers) GROUP BY 1), o AS (SELECT id, address, '0x' || lpad(lower(to_hex(id + 1)), 40, '0') AS other FROM who)
SELECT id, 'comparison' AS kind, o.address AS target, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'Name two wallets that have transfers.' ELSE o.address || ' moved ' || printf('%.2f', a.v) || ' USD, ' || other || ' ' || printf('%.2f', b.v) || ' USD.' END AS answer, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'UNKNOWN' ELSE 'HIGH_CONFIDENCE' END AS confidence
FROM o LEFT JOIN w a ON a.address = o.address LEFT JOIN w b ON b.address = other""")(lambda s, d: assistant.answers(_questions(s, ASKED[4]), _tables(s, d)))

_REACHED = f"""{_BOTH}, {ENTITIES}, {_WHO}, g(s, n, h) AS (SELECT address, address, 0 FROM who UNION SELECT g.s, e.b, g.h + 1 FROM g JOIN e ON e.a = g.n WHERE g.h < 6), reached AS MATERIALIZED (SELECT s, n, min(h) AS h FROM g GROUP BY 1, 2 HAVING min(h) > 0)"""
_COUNTED = "string_agg(c || ' ' || replace(pattern, '_', ' '), ', ' ORDER BY pattern) AS listed, sum(c)::BIGINT AS c, replace(arg_max(pattern, {'m': m, 'p': pattern}), '_', ' ') AS top, max(m) AS m"
_SAID = {
    "assistant_fund_flow": (1, f"""WITH RECURSIVE {_REACHED}, near AS (SELECT s AS address, arg_min(name, {{'h': h, 'n': name}}) AS name, min(h) AS h FROM reached JOIN entities ON address = n WHERE entity_type IN ('exchange', 'bridge') GROUP BY 1),
w AS (SELECT address, count(DISTINCT tx_hash) FILTER (WHERE o) AS sent, coalesce(sum(v) FILTER (WHERE o), 0) AS sent_usd, count(DISTINCT tx_hash) FILTER (WHERE NOT o) AS got, coalesce(sum(v) FILTER (WHERE NOT o), 0) AS got_usd
  FROM (SELECT from_address AS address, tx_hash, true AS o, CAST(value_usd AS DECIMAL(38,2)) AS v FROM transfers UNION ALL SELECT to_address, tx_hash, false, CAST(value_usd AS DECIMAL(38,2)) FROM transfers) GROUP BY 1)
SELECT id, 'fund_flow' AS kind, q.address AS target, CASE WHEN sent IS NULL THEN 'No transfer of wallet ' || q.address || '.' ELSE 'Wallet ' || q.address || ' sent ' || printf('%.2f', sent_usd::DOUBLE) || ' USD in ' || sent || ' transactions and got ' || printf('%.2f', got_usd::DOUBLE) || ' USD in ' || got || '. '
  || CASE WHEN name IS NULL THEN 'No exchange or bridge within reach.' ELSE 'Nearest service: ' || name || ', ' || h || ' hops away.' END END AS answer, {_SURE.format("sent IS NOT NULL")} FROM who q LEFT JOIN w USING (address) LEFT JOIN near USING (address)"""),
    "assistant_cases": (5, f"""WITH {CASES}, {WALLETS}, {_WHO}, w AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE risk_score >= 75) AS high FROM wallets GROUP BY 1)
SELECT id, 'case_overview' AS kind, q.case_number AS target, CASE WHEN status IS NULL THEN 'There is no case ' || q.case_number || '.' ELSE 'Case ' || q.case_number || ' is ' || status || ': ' || coalesce(n, 0) || ' wallets, ' || coalesce(high, 0) || ' of high risk.' END AS answer, {_SURE.format("status IS NOT NULL")}
FROM who q LEFT JOIN cases c USING (case_number) LEFT JOIN w USING (case_id)"""),
    "assistant_attributions": (6, f"""WITH RECURSIVE {_REACHED}, q AS (SELECT s, address, name, entity_type, confidence AS listed, h AS hops FROM reached JOIN entities ON address = n WHERE entity_type IN ('exchange', 'bridge', 'defi') QUALIFY row_number() OVER (PARTITION BY s ORDER BY h, address, name) <= 20),
{"k AS (" + _NEAR.split("k AS (", 1)[1].split("r AS (SELECT *, row_number()", 1)[0].rstrip().rstrip(",")}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(score, 9) DESC, hops, address, name) AS rank FROM s QUALIFY rank <= 10), t AS (SELECT s AS address, count(*) AS n, arg_min(name, rank) AS first, max(score) AS best FROM r GROUP BY 1)
SELECT id, 'attribution' AS kind, q.address AS target, CASE WHEN n IS NULL THEN 'No known service within reach of wallet ' || q.address || '.' ELSE 'Wallet ' || q.address || ' leads to ' || n || ' services, first of all ' || first || ' (score ' || printf('%.2f', best) || ').' END AS answer, {_SURE.format("n IS NOT NULL")} FROM who q LEFT JOIN t USING (address)"""),
    "assistant_patterns": (7, f"""WITH {_PATTERNS}, {_WHO}, o AS (SELECT pattern, count(*) AS c, max(v) AS m FROM u GROUP BY 1), l AS (SELECT {_COUNTED} FROM o)
SELECT id, 'pattern_detection' AS kind, NULL::VARCHAR AS target, coalesce(c || ' suspicious patterns: ' || listed || '. The largest is a ' || top || ' of ' || printf('%.2f', m) || ' USD.', 'No suspicious pattern.') AS answer, CASE WHEN c > 0 THEN 'HIGH_CONFIDENCE' ELSE 'PROBABLE' END AS confidence FROM who, l"""),
    "assistant_general": (8, f"WITH {_WHO} SELECT id, 'general' AS kind, NULL::VARCHAR AS target, 'Questions of these kinds are answered: {', '.join(k.replace('_', ' ') for k in router.KINDS)}.' AS answer, 'UNKNOWN' AS confidence FROM who"),
    "assistant_case_risk": (9, f"""WITH {CASES}, {WALLETS}, {_WHO}, w AS (SELECT case_id, count(*) AS n, round(avg(CAST(risk_score AS DECIMAL(38,2)))::DOUBLE, 1) AS mean, count(*) FILTER (WHERE risk_score >= 75) AS a, count(*) FILTER (WHERE risk_score >= 40 AND risk_score < 75) AS b, count(*) FILTER (WHERE risk_score >= 20 AND risk_score < 40) AS c, count(*) FILTER (WHERE attribution_status = 'attributed') AS k FROM wallets GROUP BY 1)
SELECT id, 'risk_summary' AS kind, q.case_number AS target, CASE WHEN x.case_id IS NULL THEN 'There is no case ' || q.case_number || '.' WHEN n IS NULL THEN 'Case ' || q.case_number || ' has no wallets.'
  ELSE 'Case ' || q.case_number || ' has ' || n || ' wallets with an average risk of ' || printf('%.1f', mean) || ': ' || a || ' critical, ' || b || ' medium, ' || c || ' low; ' || k || ' are attributed.' END AS answer, {_SURE.format("x.case_id IS NOT NULL")} FROM who q LEFT JOIN cases x USING (case_number) LEFT JOIN w ON w.case_id = x.case_id"""),
    "assistant_case_patterns": (10, f"""WITH {_PATTERNS}, {CASES}, {WALLETS}, {_WHO}, own AS (SELECT DISTINCT case_number, address FROM cases JOIN wallets USING (case_id) WHERE case_number IN (SELECT case_number FROM who)), hit AS (SELECT DISTINCT case_number, i, pattern, v FROM (SELECT i, pattern, v, unnest(who) AS address FROM u) x JOIN own USING (address)),
o AS (SELECT case_number, pattern, count(*) AS c, max(v) AS m FROM hit GROUP BY 1, 2), l AS (SELECT case_number, {_COUNTED} FROM o GROUP BY 1)
SELECT id, 'pattern_detection' AS kind, q.case_number AS target, CASE WHEN l.c > 0 THEN l.c || ' suspicious patterns with wallets of case ' || q.case_number || ': ' || listed || '. The largest is a ' || top || ' of ' || printf('%.2f', m) || ' USD.' WHEN x.case_id IS NULL THEN 'There is no case ' || q.case_number || '.' ELSE 'No suspicious pattern with wallets of case ' || q.case_number || '.' END AS answer,
  CASE WHEN l.c > 0 THEN 'HIGH_CONFIDENCE' WHEN x.case_id IS NULL THEN 'UNKNOWN' ELSE 'PROBABLE' END AS confidence FROM who q LEFT JOIN cases x USING (case_number) LEFT JOIN l USING (case_number)"""),
}
for _name, (_k, _oracle) in _SAID.items():
    query(_name, _oracle)(lambda s, d, k=_k: assistant.answers(_questions(s, ASKED[k]), _tables(s, d)))
_BY_KIND = {0: "assistant_risk", 2: "assistant_entities", 3: "assistant_timeline", 4: "assistant_comparison", 11: "assistant_general"} | {k: name for name, (k, _) in _SAID.items()}
query("assistant_answers", " UNION ALL ".join(f"SELECT {1000 * k} + id AS id, kind, target, answer, confidence FROM ({_sql[name]}) a{k}" for k, name in sorted(_BY_KIND.items())))(lambda s, d: assistant.answers(_questions(s, *ASKED), _tables(s, d)))

# -- streaming (batch twins) ------------------------------------------------------------------
query("watchlist_alerts", f"""WITH {TRANSFERS}, {ENTITIES}, w AS (SELECT address AS watched, entity_type AS label FROM entities WHERE entity_type IN ('mixer', 'sanctioned'))
SELECT tx_hash, watched, label, CASE WHEN watched = from_address THEN 'sent' ELSE 'received' END AS side FROM transfers JOIN w ON watched IN (from_address, to_address) WHERE value_usd >= 50""")(
    lambda s, d: alerts.watchlist_alerts(_t(s, d), views.entities(s, d).where("entity_type in ('mixer', 'sanctioned')").select("address", F.col("entity_type").alias("label")), 50.0).select("tx_hash", "watched", "label", "side")
)
query("velocity_hourly", f"WITH {TRANSFERS} SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS window_start, from_address, count(*) AS tx_count, CAST(sum(CAST(value_usd AS DECIMAL(18,2))) AS DOUBLE) AS value_usd FROM transfers GROUP BY 1, 2")(lambda s, d: alerts.velocity(_t(s, d)).drop("window_end"))
query("session_velocity", f"""WITH {TRANSFERS}, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY from_address ORDER BY timestamp) < INTERVAL 5 MINUTES THEN 0 ELSE 1 END AS c FROM transfers), r AS (SELECT *, sum(c) OVER (PARTITION BY from_address ORDER BY timestamp, tx_hash) AS k FROM g)
SELECT min(timestamp) AS session_start, from_address, count(*) AS tx_count, CAST(sum(CAST(value_usd AS DECIMAL(18,2))) AS DOUBLE) AS value_usd FROM r GROUP BY from_address, k""")(lambda s, d: alerts.sessions(_t(s, d)).drop("session_end"))


def queries() -> dict[str, Query]:
    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
