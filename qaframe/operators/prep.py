"""Training-text preparation: clean, accept/skip, chat and prompt text.

All narrow (map-only) plans: one scan, no shuffle except the single-row
report aggregate, which Spark computes partially per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X


def clean_pairs(df: DataFrame, query: str = "query", response: str = "response") -> DataFrame:
    """Clean both fields (absent -> '')."""
    return df.select("sample_id", X.clean_text(query).alias("query"), X.clean_text(response).alias("response"))


def accept_condition(query="query", response="response", min_len: int = 2):
    return (F.length(X.col_(query)) > min_len) & (F.length(X.col_(response)) > min_len)


def accepted_pairs(df: DataFrame) -> DataFrame:
    """Cleaned pairs whose two texts are both longer than two characters.

    The pairs come out of a generator of one row, below which the optimizer does not push the
    filter: it would clean every text twice."""
    pair = F.struct(X.clean_text("query").alias("query"), X.clean_text("response").alias("response"))
    cleaned = df.select("sample_id", F.explode_outer(F.array(pair)).alias("c"))
    return cleaned.filter(accept_condition(F.col("c.query"), F.col("c.response"))).select("sample_id", "c.query", "c.response")


def acceptance_report(df: DataFrame) -> DataFrame:
    """Total / accepted / skipped counts (one row)."""
    c = clean_pairs(df)
    ok = accept_condition()
    return c.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(ok).alias("accepted"),
                 F.count_if(~ok).alias("skipped"))


def training_texts(df: DataFrame, system_prompt: str = C.SYSTEM_PROMPT_VI) -> DataFrame:
    """clean -> accept -> chat text; the same plan serves batch and stream."""
    return accepted_pairs(df).select("sample_id", X.chat_text("query", "response", system_prompt).alias("text"))


def inference_prompts(df: DataFrame, system_prompt: str = C.SYSTEM_PROMPT_VI) -> DataFrame:
    return df.select("sample_id", X.inference_prompt(X.clean_text("query"), system_prompt).alias("prompt"))
