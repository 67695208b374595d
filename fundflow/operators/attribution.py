"""Which known service a wallet's money is nearest to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.functions.columns import clamp
from fundflow.operators.graph import paths_to_entities

SEARCHED = ("exchange", "bridge", "defi")
# Scores by confidence and by kind of attribution.
BASE = {"CONFIRMED": 1.0, "HIGH_CONFIDENCE": 0.85, "PROBABLE": 0.65, "UNKNOWN": 0.3}
KINDS = {"direct": 1.0, "indirect": 0.8, "cluster": 0.6, "heuristic": 0.4}


def _choice(c: Column, values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def attribution_type(length: Column, confidence: Column, entity_type: Column) -> Column:
    direct = (length == 1) | ((confidence == "CONFIRMED") & (length <= 2))
    return F.when(direct, "direct").when(entity_type == "defi", "heuristic").otherwise("indirect")


def attributed_confidence(length: Column, confidence: Column, kind: Column) -> Column:
    sure = F.when((length <= 2) & (kind == "direct"), "CONFIRMED").when(length <= 4, "HIGH_CONFIDENCE").otherwise("PROBABLE")
    high = F.when(length <= 3, "HIGH_CONFIDENCE").otherwise("PROBABLE")
    fair = F.when(length <= 2, "PROBABLE").otherwise("UNKNOWN")
    return F.when(confidence == "CONFIRMED", sure).when(confidence == "HIGH_CONFIDENCE", high).when(confidence == "PROBABLE", fair).otherwise("UNKNOWN")


def attribution_score(length: Column, confidence: Column, kind: Column, cost: Column) -> Column:
    near = F.greatest(F.lit(0.0), 1 - (length - 1) * 0.1)
    value = F.when(cost > 0, F.least(F.lit(1.0), cost / 10)).otherwise(0.5)
    return clamp(_choice(confidence, BASE) * near * _choice(kind, KINDS) * (0.7 + 0.3 * value))


def attributions(transfers: DataFrame, starts: DataFrame, entities: DataFrame, max_hops: int = 6, paths_per_wallet: int = 20, top: int = 10) -> DataFrame:
    """Ranked services per wallet: start, rank, name, entity_type,
    attribution_type, confidence, confidence_score, hops, path, evidence."""
    found = paths_to_entities(transfers, starts, entities, max_hops, SEARCHED, "PROBABLE", top=paths_per_wallet)
    length, cost = F.col("hops"), F.col("hops").cast("double")
    typed = found.withColumn("attribution_type", attribution_type(length, F.col("confidence"), F.col("entity_type")))
    sure = typed.withColumn("listed", F.col("confidence")).withColumn("confidence", attributed_confidence(length, F.col("listed"), F.col("attribution_type")))
    scored = sure.withColumn("confidence_score", attribution_score(length, F.col("confidence"), F.col("attribution_type"), cost))
    order = Window.partitionBy("start").orderBy(F.desc("confidence_score"), "hops", "address", "name")
    evidence = F.array_compact(F.array(F.lit("on_chain_path"), F.lit("entity_registry"), F.when(F.col("listed") == "CONFIRMED", "manual_verification")))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("start", "rank", "address", "name", "entity_type", "attribution_type", "confidence", "confidence_score", "hops", "path", evidence.alias("evidence"))


def summary(ranked: DataFrame) -> DataFrame:
    """Per wallet: how many, the best, counts by kind, mean hops."""
    return ranked.groupBy("start").agg(
        F.count("*").alias("total"), F.max_by("name", -F.col("rank")).alias("nearest"), F.max("confidence_score").alias("highest_score"), F.avg("hops").alias("average_hops"),
        *[F.count_if(F.col("entity_type") == k).alias(f"{k}_count") for k in (*SEARCHED, "mixer")],
    )
