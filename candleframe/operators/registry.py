"""Model registry as a small dimension table with insert-if-absent (anti join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signals import DEFAULT_DESCRIPTION, descriptions_table

# The reference's built-in model registry (id, name, type, description).
BASE_MODELS: list[tuple[str, str, str, str]] = [
    ("finbert", "ProsusAI/finbert", "sentiment", "Specialized in financial sentiment analysis"),
    ("bert_market", "bert-base-market", "market_analysis", "Fine-tuned BERT for pattern recognition"),
    ("gpt2_trading", "gpt2-trading", "prediction", "GPT-2 fine-tuned on trading patterns"),
    ("roberta_market", "roberta-base-market", "technical_analysis", "RoBERTa for technical analysis"),
    ("xlnet_market", "xlnet-market", "volume_analysis", "XLNet for volume and price action analysis"),
    ("distilbert_market", "distilbert-market", "momentum_analysis", "DistilBERT for momentum analysis"),
    ("albert_market", "albert-market", "support_resistance", "ALBERT for support/resistance analysis"),
    ("electra_market", "electra-market", "trend_analysis", "ELECTRA for trend strength analysis"),
    ("longformer_market", "longformer-market", "long_term_patterns", "Longformer for long-term pattern analysis"),
    ("deberta_market", "deberta-market", "market_sentiment", "DeBERTa for advanced market sentiment"),
]

SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)


def base_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASE_MODELS, SCHEMA)


def register_models(registry: DataFrame, candidates: DataFrame, model_type: str = "rule_strategy") -> DataFrame:
    """Add candidate model ids that are not registered yet (anti join; duplicates ignored).
    New entries take their description from the strategy description table."""
    new = candidates.select("model").distinct().join(registry.select("model"), "model", "left_anti")
    desc = descriptions_table(registry.sparkSession).withColumnRenamed("strategy", "model")
    added = new.join(F.broadcast(desc), "model", "left").select(
        "model",
        F.col("model").alias("name"),
        F.lit(model_type).alias("type"),
        F.coalesce(F.col("description"), F.lit(DEFAULT_DESCRIPTION)).alias("description"),
    )
    return registry.unionByName(added)
