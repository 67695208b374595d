"""Tamper-evident digests of a set of records: hashes, chain, Merkle root."""

from __future__ import annotations

import hashlib
from datetime import datetime
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.functions.codecs import canonical_json_udf
from fundflow.plans.shared import discard, stored
from fundflow.shipping import ship

EMPTY = hashlib.sha256(b"").hexdigest()
DECLARATION = "%s certifies that the %d records of case %s were produced by this system in the ordinary course; Merkle root %s, chain tip %s, at %s."


def record_hashes(records: DataFrame) -> DataFrame:
    """``records(position, record_id, record_type, source, payload)`` (payload:
    JSON) -> position, record_id, record_hash of the canonical envelope."""
    ship(records.sparkSession)
    envelope = canonical_json_udf("record_id", "record_type", "source", "payload")
    return records.select("position", "record_id", F.sha2(envelope, 256).alias("record_hash"))


def plain_hashes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of columns joined by ``|``, JVM-side; nulls are empty."""
    return rows.withColumn("record_hash", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256))


def merkle_root(hashes: DataFrame) -> DataFrame:
    """One row: merkle_root of ``hashes(position, record_hash)`` by position.

    Positions need not be dense. Every round halves the leaves: a pair is two
    neighbours, an odd last leaf pairs with itself. Ranks are dealt by ranges of
    position, so no round sorts everything in one task.
    """
    level = last = stored(_ranked(hashes), "merkle")
    n = level.count()
    if not n:
        return hashes.sparkSession.createDataFrame([(EMPTY,)], "merkle_root string")
    for round_ in count(1):
        if n <= 1:
            break
        pair = level.groupBy(F.expr("rank div 2").alias("rank")).agg(F.min_by("h", "rank").alias("a"), F.max_by("h", "rank").alias("b"))
        level, n = pair.select("rank", F.sha2(F.concat("a", "b"), 256).alias("h")), (n + 1) // 2
        if round_ % 4 == 0:  # or the plan grows with the rounds
            level = stored(level, "merkle")
            discard(last)
            last = level
    return level.select(F.col("h").alias("merkle_root"))


def _ranked(hashes: DataFrame) -> DataFrame:
    """Dense ranks from 0 by position: ranks within ranges, plus what comes before."""
    parts = hashes.select("position", F.col("record_hash").alias("h")).repartitionByRange("position").withColumn("part", F.spark_partition_id())
    parts = stored(parts, "ranges")
    # one row per partition: their running sum is as short as the list of partitions
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("position")) - 1
    return parts.withColumn("i", inside).join(F.broadcast(before), "part").select((F.col("i") + F.col("before")).alias("rank"), "h")


def hash_chain(hashes: DataFrame, group: str | None = None) -> DataFrame:
    """``hashes(position, record_hash)`` and, per group, link = sha256(previous
    link || hash) in order. A chain is sequential by definition: one task
    streams a group, holding one link; hex digests travel as 32 bytes."""
    ship(hashes.sparkSession)
    key = F.col(group).cast("string") if group else F.lit("")
    digest = F.col("record_hash").rlike("^[0-9a-f]{64}\\z")
    packed = F.when(digest, F.unhex("record_hash")).alias("packed"), F.when(~digest, F.col("record_hash")).alias("plain")
    rows = hashes.select(key.alias("chain"), "position", *packed).repartition("chain").sortWithinPartitions("chain", "position")

    def run(parts):
        chain, link = None, EMPTY
        for pdf in parts:
            links, said = [], [plain if packed is None else packed.hex() for packed, plain in zip(pdf.packed, pdf.plain)]
            for c, h in zip(pdf["chain"], said):
                if c != chain:
                    chain, link = c, EMPTY
                link = hashlib.sha256((link + h).encode()).hexdigest()
                links.append(link)
            yield pd.DataFrame({"chain": pdf["chain"], "position": pdf.position, "record_hash": said, "link": links})

    return rows.mapInPandas(run, "chain string, position long, record_hash string, link string")


def verify(certified: DataFrame, current: DataFrame) -> DataFrame:
    """Positions at which two lists of hashes differ: position, certified,
    current, problem (changed, missing, added)."""
    a, b = certified.select("position", F.col("record_hash").alias("certified")), current.select("position", F.col("record_hash").alias("current"))
    both = a.join(b, "position", "full").where(~F.col("certified").eqNullSafe(F.col("current")))
    return both.withColumn("problem", F.when(F.col("current").isNull(), "missing").when(F.col("certified").isNull(), "added").otherwise("changed"))


def certificate(hashes: DataFrame, case_number: str, officer: str, at: datetime) -> DataFrame:
    """One row that certifies ``hashes(position, record_hash)``: certificate_id,
    case_number, officer, generated_at, record_count, merkle_root, chain_tip and
    declaration. The id follows from the records, so that the same ones always
    have the same."""
    root = merkle_root(hashes).select("merkle_root")
    last = hash_chain(hashes).agg(F.count("*").alias("record_count"), F.max_by("link", "position").alias("tip"))
    text = F.format_string(DECLARATION, F.lit(officer), F.col("record_count"), F.lit(case_number), F.col("merkle_root"), F.col("chain_tip"), F.lit(f"{at:%Y-%m-%dT%H:%M:%S}Z"))
    row = root.join(last).select("merkle_root", "record_count", F.coalesce("tip", F.lit(EMPTY)).alias("chain_tip"))
    return row.select(
        F.concat(F.lit(f"TRX-S63-{at:%Y%m%d}-"), F.upper(F.substring("merkle_root", 1, 10))).alias("certificate_id"), F.lit(case_number).alias("case_number"), F.lit(officer).alias("officer"),
        F.lit(f"{at:%Y-%m-%dT%H:%M:%S}Z").alias("generated_at"), "record_count", "merkle_root", "chain_tip", text.alias("declaration"),
    )


def verify_certificate(certified: DataFrame, chain: DataFrame, records: DataFrame) -> DataFrame:
    """What differs between a certificate, its ``chain(position, record_hash,
    link)`` and the ``records(position, record_hash)`` at hand: problem,
    position, certified, found. No row: the evidence is untouched.

    Problems: changed, missing or added (by position), record_count,
    merkle_root, chain (the first position from which links differ), chain_tip,
    declaration (the document itself was edited).
    """
    own, said = chain.select("position", "record_hash"), certified.first()
    now = stored(hash_chain(records).select("position", "record_hash", "link"), "chain-now")
    fresh = certificate(now, said.case_number, said.officer, datetime.strptime(said.generated_at, "%Y-%m-%dT%H:%M:%SZ"))
    each = verify(own, now).select("problem", "position", "certified", F.col("current").alias("found"))
    links = chain.select("position", F.col("link").alias("certified")).join(now.select("position", F.col("link").alias("found")), "position", "full").where(~F.col("certified").eqNullSafe(F.col("found")))
    broken = links.agg(F.min("position").alias("position")).where("position is not null").select(F.lit("chain").alias("problem"), "position", F.lit(None).cast("string").alias("certified"), F.lit(None).cast("string").alias("found"))
    both = certified.select(F.struct("record_count", "merkle_root", "chain_tip").alias("a"), "declaration", "officer", "case_number", "generated_at").join(fresh.select(F.struct("record_count", "merkle_root", "chain_tip").alias("b")))
    whole = [F.struct(F.lit(c).alias("problem"), F.lit(None).cast("long").alias("position"), F.col(f"a.{c}").cast("string").alias("certified"), F.col(f"b.{c}").cast("string").alias("found")) for c in ("record_count", "merkle_root", "chain_tip")]
    due = F.format_string(DECLARATION, F.col("officer"), F.col("a.record_count"), F.col("case_number"), F.col("a.merkle_root"), F.col("a.chain_tip"), F.col("generated_at"))
    whole.append(F.struct(F.lit("declaration").alias("problem"), F.lit(None).cast("long").alias("position"), F.col("declaration").alias("certified"), due.alias("found")))
    sums = both.select(F.inline(F.array(*whole))).where("certified <> found")
    return each.unionByName(broken).unionByName(sums)
