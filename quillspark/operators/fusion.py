"""Reciprocal rank fusion of a lexical and a semantic ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, W_SEMANTIC, W_LEXICAL = 60.0, 2.0, 1.0


def ranked(hits: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Adds the rank from 0; the input is a top-k list, so one task ranks a bounded number of rows."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)) - 1)


def rrf(lexical: DataFrame, semantic: DataFrame, key: str, k: float = K, w_semantic: float = W_SEMANTIC, w_lexical: float = W_LEXICAL) -> DataFrame:
    """key, rrf, both ranks and both scores; inputs have key, score and rank."""
    a = semantic.select(key, F.col("rank").alias("sem_rank"), F.col("score").alias("sem_score"))
    b = lexical.select(key, F.col("rank").alias("lex_rank"), F.col("score").alias("lex_score"))
    share = lambda w, rank: F.coalesce(F.lit(w) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    return a.join(b, key, "full_outer").withColumn("rrf", share(w_semantic, "sem_rank") + share(w_lexical, "lex_rank"))


def fused_top(fused: DataFrame, k: int) -> DataFrame:
    """The k best; ties in order of discovery: semantic rank, then lexical rank."""
    return fused.orderBy(F.desc("rrf"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("lex_rank")).limit(k)
