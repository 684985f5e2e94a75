"""Batch retrieval: every question at once.

questions -> embed -> search_topk (+ floor) -> dedup -> context -> route ->
prompts.  All per-question groups are bounded by k, so collecting a
question's hits into one array is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X


def type_rank(chunk_type) -> Column:
    t = F.col(chunk_type) if isinstance(chunk_type, str) else chunk_type
    e = F.when(t.isNull(), F.lit(C.MISSING_TYPE_RANK))
    for name, r in C.TYPE_RANK.items():
        e = e.when(t == name, F.lit(r))
    return e.otherwise(F.lit(C.UNKNOWN_TYPE_RANK))


def type_label(chunk_type) -> Column:
    t = F.col(chunk_type) if isinstance(chunk_type, str) else chunk_type
    e = None
    for name, label in C.TYPE_LABEL.items():
        e = F.when(t == name, F.lit(label)) if e is None else e.when(t == name, F.lit(label))
    return e.otherwise(F.lit(C.DEFAULT_LABEL))


def score_text(score) -> Column:
    """`{:.2f}`: the score (already rounded to 6 places) as decimal, HALF_UP."""
    s = F.col(score) if isinstance(score, str) else score
    return F.round(s.cast("decimal(10,6)"), 2).cast("decimal(10,2)").cast("string")


def dedup_hits(hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Best hit per (question, sample); the first in hit order wins ties; a
    hit without sample_id groups under -1."""
    sid = F.coalesce(F.col("sample_id"), F.lit(-1))
    w = Window.partitionBy(query_key, sid).orderBy(F.col("score").desc(), F.col("rank"))
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def build_context(dedup: DataFrame, query_key: str = "query_id", max_chars: int = C.CONTEXT_MAX) -> DataFrame:
    """One context string per question: hits ordered by type (question,
    solution, full, other), then score desc, then hit order; each part
    `label (score=0.00):\\ntext`; joined by the separator; cut to max_chars + '...'."""
    part = F.concat(type_label("chunk_type"), F.lit(" (score="), score_text("score"), F.lit("):\n"),
                    F.coalesce(F.col("text"), F.lit("")))
    g = dedup.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct(
        type_rank("chunk_type").alias("r"), (-F.col("score")).alias("s"), F.col("rank").alias("o"),
        part.alias("p")))).alias("_parts"))
    ctx = F.array_join(F.transform("_parts", lambda x: x["p"]), C.CONTEXT_SEPARATOR)
    return g.select(query_key, F.when(F.length(ctx) > max_chars,
                                      F.concat(F.substring(ctx, 1, max_chars), F.lit(C.ELLIPSIS)))
                    .otherwise(ctx).alias("context"))


def route(questions: DataFrame, hits: DataFrame, query_key: str = "query_id",
          gate: float = C.GATE, min_hits: int = C.MIN_HITS) -> DataFrame:
    """best score (0 without hits), hit count, and use_web = best < gate or
    fewer than min_hits hits.  Questions without any hit are kept."""
    agg = hits.groupBy(query_key).agg(F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n_hits"))
    j = questions.select(query_key).join(agg, query_key, "left")
    best = F.coalesce(F.col("best_score"), F.lit(0.0))
    n = F.coalesce(F.col("n_hits"), F.lit(0)).cast("long")
    return j.select(query_key, best.alias("best_score"), n.alias("n_hits"),
                    ((best < gate) | (n < min_hits)).alias("use_web"))


def sources(hits: DataFrame, query_key: str = "query_id", n: int = C.QUERY_REF_MAX) -> DataFrame:
    """Per question: the first n characters of every hit text, in hit order."""
    g = hits.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank").alias("o"), F.substring(F.coalesce("text", F.lit("")), 1, n).alias("t")))).alias("_s"))
    return g.select(query_key, F.transform("_s", lambda x: x["t"]).alias("sources"))


def generation_prompt(question, context, hint) -> Column:
    """`### context`, `### hint` (each only when non-empty), blank line, question."""
    q, c, h = (F.col(x) if isinstance(x, str) else x for x in (question, context, hint))
    parts = F.concat_ws("\n\n",
                        F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(C.CONTEXT_HEADER), c)),
                        F.when(F.coalesce(h, F.lit("")) != "", F.concat(F.lit(C.WEB_HINT_HEADER), h)))
    return F.when(parts != "", F.concat(parts, F.lit("\n\n" + C.QUESTION_HEADER), q)) \
        .otherwise(F.concat(F.lit(C.QUESTION_HEADER), q))


def web_search_query(question) -> Column:
    q = F.col(question) if isinstance(question, str) else question
    return F.concat(F.lit(C.WEB_QUERY_PREFIX), q)


def web_summary_prompt(question, raw_results) -> Column:
    q = F.col(question) if isinstance(question, str) else question
    r = F.col(raw_results) if isinstance(raw_results, str) else raw_results
    return F.concat(F.lit(C.WEB_SUMMARY_PROBLEM), q, F.lit(C.WEB_SUMMARY_RESULTS), r, F.lit(C.WEB_SUMMARY_ASK))


def web_request(question, raw_results) -> Column:
    """What is sent after a web search: the summary prompt, or the bare question
    when the search found nothing (blank results)."""
    q = F.col(question) if isinstance(question, str) else question
    r = F.col(raw_results) if isinstance(raw_results, str) else raw_results
    return F.when(X.is_blank(r), q).otherwise(web_summary_prompt(q, r))
