"""Row -> chunks.

Each sample's chunks are built as one array<struct> inside its own row and
then exploded: a single narrow stage, no shuffle, and the work per row is
bounded by that row's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X

_CHUNK_STRUCT = "struct<chunk_type:string, step_idx:int, text:string, query_ref:string>"


def _chunk(chunk_type: str, step_idx, text: Column, query_ref: Column) -> Column:
    return F.struct(F.lit(chunk_type).alias("chunk_type"),
                    (step_idx if isinstance(step_idx, Column) else F.lit(step_idx)).cast("int").alias("step_idx"),
                    text.alias("text"), query_ref.alias("query_ref"))


def with_steps(df: DataFrame, response: str = "response", window: int = C.WINDOW,
               overlap: int = C.OVERLAP, min_part: int = C.MIN_PART, name: str = "_steps") -> DataFrame:
    """Add the final solution steps as a column (null for an absent response).

    Staged as separate projections so every later use reads the stored array
    instead of re-running split, windows and merge (the optimizer keeps
    projections apart when collapsing them would repeat a costly expression)."""
    d = df.withColumn("_split", X.solution_steps(F.col(response)))
    d = d.withColumn("_present", F.when(X.present(response), F.col(response)))
    d = d.withColumn(name, X.steps_for_response("_present", window, overlap, min_part, split_name="_split"))
    return d.drop("_split", "_present")


def chunk_array(query: str = "query", response: str = "response", steps_col: str = "_steps",
                full_max: int = C.FULL_MAX, ref_max: int = C.QUERY_REF_MAX) -> Column:
    """array of chunk structs for one sample: question, solution steps in
    order, full; empty when query and response are both absent.  Expects the
    steps in column `steps_col` (see `with_steps`)."""
    q, r = F.col(query), F.col(response)
    q_ok, r_ok = X.present(q), X.present(r)
    ref = X.prefix(F.coalesce(q, F.lit("")), ref_max)      # a missing query counts as ''
    steps = F.col(steps_col)
    n = F.size(steps)
    empty = F.array().cast(f"array<{_CHUNK_STRUCT}>")

    question = F.when(q_ok, F.array(_chunk("question", None, F.concat(F.lit(C.QUESTION_PREFIX), q), ref)))
    solutions = F.when(r_ok, F.transform(steps, lambda s, i: _chunk(
        "solution", i,
        F.concat(F.lit(C.SOLUTION_PREFIX), (i + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit("] "), s),
        ref)))
    full_text = F.concat(F.lit(C.FULL_PREFIX), q, F.lit(C.FULL_SEPARATOR), r)
    full = F.when(q_ok & r_ok, F.array(_chunk(
        "full", None, X.truncate(full_text, full_max, full_max - len(C.ELLIPSIS), C.ELLIPSIS), ref)))
    return F.concat(F.coalesce(question, empty), F.coalesce(solutions, empty), F.coalesce(full, empty))


def chunk_samples(df: DataFrame, query: str = "query", response: str = "response",
                  math_type: str = "math_type", window: int = C.WINDOW, overlap: int = C.OVERLAP,
                  min_part: int = C.MIN_PART, full_max: int = C.FULL_MAX,
                  ref_max: int = C.QUERY_REF_MAX, carry: list[str] | None = None) -> DataFrame:
    """Chunk rows: sample_id, chunk_pos (order inside the sample), chunk_type,
    step_idx (solutions only), text, math_type, query_ref, and the columns to carry."""
    carry = carry or []
    d = with_steps(df.select("sample_id", query, response, math_type, *carry), response, window, overlap, min_part)
    return chunk_steps(d, query, response, math_type, full_max, ref_max, carry)


def chunk_steps(steps: DataFrame, query: str = "query", response: str = "response", math_type: str = "math_type",
                full_max: int = C.FULL_MAX, ref_max: int = C.QUERY_REF_MAX, carry: list[str] | None = None) -> DataFrame:
    """`chunk_samples` of samples that have their steps (`with_steps`)."""
    carry = carry or []
    d = steps.withColumn("_chunks", chunk_array(query, response, "_steps", full_max, ref_max))
    return (X.explode_rows(d, ["sample_id", F.col(math_type).alias("math_type"), *carry], F.col("_chunks"), "chunk_pos", "c")
            .select("sample_id", F.col("chunk_pos").cast("int").alias("chunk_pos"),
                    "c.chunk_type", "c.step_idx", "c.text", "math_type", "c.query_ref", *carry))


def chunk_count(query: str = "query", response: str = "response", steps_col: str = "_steps") -> Column:
    """The size of `chunk_array`, without making the chunks' texts."""
    q, r = X.present(query), X.present(response)
    return q.cast("long") + F.when(r, F.size(steps_col)).otherwise(0) + (q & r).cast("long")


def split_parts(df: DataFrame, response: str = "response") -> DataFrame:
    """Marker split of each response: sample_id, part_idx, part."""
    return (X.explode_rows(df, ["sample_id"], X.solution_steps(response), "part_idx", "part")
            .select("sample_id", F.col("part_idx").cast("long").alias("part_idx"), "part"))


def text_windows(df: DataFrame, key: str, text: str, window: int = C.WINDOW,
                 overlap: int = C.OVERLAP) -> DataFrame:
    """Raw sliding windows of every text: key, idx, start, window."""
    w = X.sliding_windows(F.coalesce(F.col(text), F.lit("")), window, overlap)
    return (X.explode_rows(df, [key], w, "idx", "w")
            .select(key, F.col("idx").cast("long").alias("idx"),
                    F.col("w.start").cast("long").alias("start"), F.col("w.text").alias("window")))


def final_steps(df: DataFrame, response: str = "response", **params) -> DataFrame:
    """Final solution steps of each present response: sample_id, step_idx, step."""
    d = with_steps(df.filter(X.present(response)).select("sample_id", response), response, **params)
    return (X.explode_rows(d, ["sample_id"], F.col("_steps"), "step_idx", "step")
            .select("sample_id", F.col("step_idx").cast("long").alias("step_idx"), "step"))
