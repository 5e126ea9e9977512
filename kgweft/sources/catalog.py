"""Curated topics, their aliases, and the choice of a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Paper ids by topic; the order of topics decides between several that fit.
TOPICS = {
    "rag": ["2005.11401", "2312.10997", "2301.12652", "2208.09257", "2302.00083", "2305.14283"],
    "llm": ["2303.08774", "2302.13971", "2307.09288", "1706.03762", "1810.04805", "2005.14165"],
    "transformer": ["1706.03762", "1810.04805", "2005.14165", "2010.11929", "1910.10683"],
    "knowledge graph": ["2306.08302", "2304.11116", "2305.04757", "2308.06374"],
    "diffusion": ["2006.11239", "2010.02502", "2112.10752", "2204.05862"],
    "reinforcement learning": ["1509.02971", "1707.06347", "1312.5602", "2005.12729"],
    "mixture of experts": ["2101.03961", "2112.06905", "2401.04088"],
    "cnn": ["1409.1556", "1512.03385", "1608.06993", "1409.4842"],
    "rnn": ["1409.3215", "1508.04025", "1506.02078"],
    "agent": ["2210.03629", "2303.11366", "2308.11432", "2304.03442"],
    "fine tuning": ["2106.09685", "2110.07602", "2104.08691", "2312.12148"],
    "multimodal": ["2204.05862", "2304.08485", "2301.13688", "2309.17421"],
}
ALIASES = {
    "retrieval augmented generation": "rag", "retrieval-augmented generation": "rag", "large language model": "llm",
    "large language models": "llm", "transformers": "transformer", "knowledge graph": "knowledge graph", "graph rag": "knowledge graph",
    "mixture of experts": "mixture of experts", "reinforcement learning": "reinforcement learning", "convolutional neural network": "cnn",
    "recurrent neural network": "rnn", "fine tuning": "fine tuning", "multimodal": "multimodal",
}


def topics(spark: SparkSession) -> DataFrame:
    """``(topic, ord, paper_id, pos)``."""
    rows = [(t, n, p, m) for n, (t, ids) in enumerate(TOPICS.items()) for m, p in enumerate(ids)]
    return spark.createDataFrame(rows, "topic string, ord int, paper_id string, pos int")


def resolve_topics(asked: DataFrame, column: str = "query") -> DataFrame:
    """``asked`` with ``topic``: the first in catalogue order that is the alias's topic, or contains or is contained in the query; else null."""
    q = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?U)^\s+|\s+$", ""))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[q]
    found = F.lit(None).cast("string")
    for key in reversed(TOPICS):
        hit = F.coalesce(alias == key, F.lit(False)) | F.contains(q, F.lit(key)) | F.contains(F.lit(key), q)
        found = F.when(hit, F.lit(key)).otherwise(found)
    return asked.withColumn("topic", found)
