"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in
full; the only row limits are the ones that are the feature itself (top-k,
positional slice, head limits of a split).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X
from ..operators import ann, batches, bpe, chunking, ids, prep, retrieval, search, sessions, sparse, vectors
from ..sources import corpus as src
from ..sources import points as pts_src
from ..sources.versioned import Collection
from ..session import ensure_checkpoint_dir, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def qa_vi(spark, sf_dir) -> DataFrame:
    return src.project_lang(src.qa_corpus(spark, sf_dir), "vi")


# --- 1. sources, projections ---------------------------------------------------

@query("scan_qa")
def scan_qa(spark, sf_dir):
    return src.qa_corpus(spark, sf_dir)


@query("project_lang")
def project_lang(spark, sf_dir):
    qa = src.qa_corpus(spark, sf_dir)
    return (src.project_lang(qa, "vi").withColumn("lang", F.lit("vi"))
            .unionByName(src.project_lang(qa, "en").withColumn("lang", F.lit("en"))))


@query("slice_rows")
def slice_rows(spark, sf_dir):
    """The inspection slice (start 0, n 3) with its cleaned chat text."""
    rows = src.slice_rows(qa_vi(spark, sf_dir), start=0, n=3)
    c = prep.clean_pairs(rows)
    return c.select("sample_id", "query", "response",
                    X.chat_text("query", "response").alias("chat_text"))


@query("corpus_counts")
def corpus_counts(spark, sf_dir):
    qa = qa_vi(spark, sf_dir)
    return qa.agg(F.count(F.lit(1)).alias("n_samples"),
                  F.count_if(X.present("query")).alias("n_with_query"),
                  F.count_if(X.present("response")).alias("n_with_response"),
                  F.count_if(X.absent("query") & X.absent("response")).alias("n_empty"))


# --- 2. text ---------------------------------------------------------------------

@query("clean_text")
def clean_text(spark, sf_dir):
    return prep.clean_pairs(qa_vi(spark, sf_dir))


@query("accepted_pairs")
def accepted_pairs(spark, sf_dir):
    return prep.accepted_pairs(qa_vi(spark, sf_dir))


@query("acceptance_report")
def acceptance_report(spark, sf_dir):
    return prep.acceptance_report(qa_vi(spark, sf_dir))


@query("chat_text")
def chat_text(spark, sf_dir):
    qa = src.qa_corpus(spark, sf_dir)
    vi = qa.select("sample_id", F.lit("vi").alias("lang"),
                   X.chat_text(X.clean_text("query_vi"), X.clean_text("response_vi"), C.SYSTEM_PROMPT_VI).alias("text"))
    en = qa.select("sample_id", F.lit("en").alias("lang"),
                   X.chat_text(X.clean_text("query_en"), X.clean_text("response_en"), C.SYSTEM_PROMPT_EN).alias("text"))
    return vi.unionByName(en)


@query("training_texts")
def training_texts(spark, sf_dir):
    return prep.training_texts(qa_vi(spark, sf_dir))


@query("inference_prompts")
def inference_prompts(spark, sf_dir):
    return prep.inference_prompts(qa_vi(spark, sf_dir))


@query("validate_prompts")
def validate_prompts(spark, sf_dir):
    qa = qa_vi(spark, sf_dir)
    train = prep.training_texts(qa).select("sample_id", F.lit("train").alias("kind"), "text")
    infer = prep.inference_prompts(qa).select("sample_id", F.lit("inference").alias("kind"),
                                              F.col("prompt").alias("text"))
    raw = qa.select("sample_id", F.lit("raw").alias("kind"), F.col("query").alias("text"))
    return (train.unionByName(infer).unionByName(raw)
            .select("sample_id", "kind", X.has_template_tags("text").alias("valid")))


@query("math_spans")
def math_spans(spark, sf_dir):
    qa = qa_vi(spark, sf_dir)
    fields = qa.select("sample_id", F.array(
        F.struct(F.lit("query").alias("field"), F.col("query").alias("t")),
        F.struct(F.lit("response").alias("field"), F.col("response").alias("t"))).alias("f"))
    f = fields.select("sample_id", F.explode("f").alias("f")).select("sample_id", "f.field", "f.t")
    return X.explode_rows(f, ["sample_id", "field"], X.math_spans("t"), "pos", "span") \
        .select("sample_id", "field", F.col("pos").cast("long").alias("pos"), "span")


@query("valid_messages")
def valid_messages(spark, sf_dir):
    conv = src.read_table(spark, sf_dir, "conversations")
    return conv.filter(~X.is_blank("text")).select("conv_id", "turn", "role", "text")


# --- 3. chunking -----------------------------------------------------------------

def chunks_df(spark, sf_dir) -> DataFrame:
    return chunking.chunk_samples(qa_vi(spark, sf_dir))


def with_chunk_ids(rows: DataFrame) -> DataFrame:
    """Dense chunk ids = position in the concatenation of all samples' chunks:
    the start of the sample plus the position inside it.  Only one narrow row per
    sample is ranked."""
    counts = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    starts = ids.prefix_starts(counts, ["sample_id"], "n").drop("n")
    return rows.join(starts, "sample_id").withColumn("chunk_id", F.col("start") + F.col("chunk_pos")).drop("start")


def chunk_ids_df(spark, sf_dir) -> DataFrame:
    """(chunk_id, sample_id, chunk_pos, chunk_type): chunked once, without texts."""
    return with_chunk_ids(chunks_df(spark, sf_dir).select("sample_id", "chunk_pos", "chunk_type").checkpoint(eager=True))


@query("solution_steps")
def solution_steps(spark, sf_dir):
    return chunking.split_parts(qa_vi(spark, sf_dir))


@query("sliding_windows")
def sliding_windows(spark, sf_dir):
    docs = src.read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    return chunking.text_windows(docs, "doc_id", "text")


@query("merged_steps")
def merged_steps(spark, sf_dir):
    return chunking.final_steps(qa_vi(spark, sf_dir))


@query("chunks")
def chunks(spark, sf_dir):
    return chunks_df(spark, sf_dir)


@query("chunk_type_counts")
def chunk_type_counts(spark, sf_dir):
    return chunks_df(spark, sf_dir).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("chunk_ids")
def chunk_ids(spark, sf_dir):
    return chunk_ids_df(spark, sf_dir).select("chunk_id", "sample_id", "chunk_pos", "chunk_type")


@query("batch_manifest")
def batch_manifest(spark, sf_dir):
    """Index batches of 256 consecutive chunk ids."""
    c = chunk_ids_df(spark, sf_dir)
    return (c.groupBy(F.floor(F.col("chunk_id") / C.INDEX_BATCH).cast("long").alias("batch_id"))
            .agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_id"),
                 F.max("chunk_id").alias("last_id")))




# --- 4. vectors --------------------------------------------------------------------

MAX_BROADCAST_STARTS = 1_000_000     # 16 bytes each


def build_points(spark, sf_dir) -> DataFrame:
    """The chunk index: dense chunk ids, hashed vectors, payload columns.

    An id is the start of its sample plus the chunk's place in it.  The samples are cut
    into steps once, and written with them.  The starts come from one narrow row per
    sample and are joined to the samples before these are chunked: neither chunks nor
    vectors move."""
    docs = src.spread_wide(src.read_table(spark, sf_dir, "documents"), "doc_id")
    qa = src.project_lang(src.qa_from_documents(docs), "vi")
    path = scratch_dir(spark, "index-steps")
    (chunking.with_steps(qa.select("sample_id", "query", "response", "math_type"))
     .withColumn("n", chunking.chunk_count()).write.parquet(path))
    cut = spark.read.parquet(path)
    starts = ids.prefix_starts(cut.select("sample_id", "n"), ["sample_id"], "n").drop("n").checkpoint()
    if starts.count() <= MAX_BROADCAST_STARTS:
        starts = F.broadcast(starts)
    pts = vectors.hash_embed(chunking.chunk_steps(cut.join(starts, "sample_id"), carry=["start"]), "text", "vector")
    return pts.select((F.col("start") + F.col("chunk_pos")).alias("chunk_id"), "vector", "sample_id", "chunk_type",
                      "step_idx", "text", "math_type", "query_ref")


INDEX_VERSION = 2        # raise when the chunks or vectors of unchanged texts change


def points_df(spark, sf_dir) -> DataFrame:
    """The chunk index, built once per corpus content and saved in the shared
    checkpoint folder (the original builds its index in a separate job and
    answers from it).  Its folder is named by the names, sizes and times of the
    corpus files and by every parameter, so a changed corpus gets a new index and no
    question scans the corpus."""
    files = pts_src.stamp(spark, src.table_path(sf_dir, "documents"))
    tag = "-".join(map(str, (files, INDEX_VERSION, C.HASH_DIM, C.WINDOW, C.OVERLAP, C.MIN_PART,
                             C.FULL_MAX, C.QUERY_REF_MAX)))
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/index-{tag}"
    if not pts_src._complete(spark, path):
        build_points(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def questions_df(spark, sf_dir) -> DataFrame:
    b = src.read_table(spark, sf_dir, "benchmark")
    return vectors.hash_embed(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")),
                              "question", "vector")


MAX_BROADCAST_HITS = 1_000_000       # 32 bytes each


def hits_df(spark, sf_dir, find=search.search_topk) -> DataFrame:
    """Top-5 chunks per benchmark question (floor 0.45) with their payload."""
    pts = points_df(spark, sf_dir)
    asked = questions_df(spark, sf_dir)
    top = find(asked, pts, C.TOP_K, C.FLOOR, key="chunk_id")
    # at most k rows per question: the payload of a large index is not shuffled for them
    if asked.count() * C.TOP_K <= MAX_BROADCAST_HITS:
        top = F.broadcast(top)
    payload = pts.select(F.col("chunk_id").alias("id"), "sample_id", "chunk_type", "text")
    return top.join(payload, "id")


@query("index_points")
def index_points(spark, sf_dir):
    """A fresh build of the chunk index (chunk -> vector -> dense id)."""
    p = vectors.hash_embed(chunks_df(spark, sf_dir), "text", "vector")
    narrow = p.select("sample_id", "chunk_pos", "chunk_type",
                      F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("n_terms"),
                      F.round(vectors.norm("vector"), 6).alias("norm"))
    return with_chunk_ids(narrow.checkpoint(eager=True)).select("chunk_id", "sample_id", "chunk_type", "n_terms", "norm")


@query("hash_embed")
def hash_embed(spark, sf_dir):
    docs = src.read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    e = vectors.sparse_entries(vectors.hash_embed(docs, "text"), "doc_id")
    return e.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def label_directions(spark, sf_dir) -> DataFrame:
    """(label, u): unit direction of the summed vectors of each label."""
    emb = src.read_table(spark, sf_dir, "embeddings")
    e = X.explode_rows(emb, ["label"], F.col("embedding"), "pos", "x")
    sums = e.groupBy("label", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    vec = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("_v"))
    return vec.select("label", vectors.l2_normalize(F.transform("_v", lambda x: x["s"])).alias("u"))


@query("l2_normalize")
def l2_normalize(spark, sf_dir):
    out = X.explode_rows(label_directions(spark, sf_dir), ["label"], F.col("u"), "pos", "value")
    return out.select(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos"),
                      F.round("value", 6).alias("value"))


@query("vector_contract_violations")
def vector_contract_violations(spark, sf_dir):
    emb = src.read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", F.size("embedding").cast("long").alias("dim"),
                      F.round(vectors.norm("embedding"), 6).alias("norm"),
                      vectors.contract_status("embedding", 64).alias("status"))


def search_directions(spark, sf_dir, **blocks) -> DataFrame:
    emb = src.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.search_topk(label_directions(spark, sf_dir), emb, C.TOP_K, C.FLOOR, query_key="label", query_vec="u",
                              key="vec_id", vec="embedding", **blocks) \
        .select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("search_topk")
def search_topk(spark, sf_dir):
    """The direction of every label searched in the whole collection."""
    return search_directions(spark, sf_dir)


@query("search_topk_blocks")
def search_topk_blocks(spark, sf_dir):
    """The same with query blocks of about three vectors."""
    return search_directions(spark, sf_dir, max_block_bytes=3 * 64 * 8)


@query("search_vectors")
def search_vectors(spark, sf_dir):
    """Every stored vector whose id is divisible by 20 searched in the whole collection."""
    emb = src.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.search_topk(emb.where("vec_id % 20 = 0"), emb, C.TOP_K, C.FLOOR, query_key="vec_id",
                              query_vec="embedding", key="vec_id", vec="embedding") \
        .select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def ann_hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Approximate and exact hits of every twentieth vector in the whole collection."""
    emb = src.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    names = {"query_key": "vec_id", "query_vec": "embedding"}
    index = ann.build_index(emb, "vec_id", "embedding", 64)
    asked = emb.where("vec_id % 20 = 0")
    nprobe = ann.choose_nprobe(asked, emb, index, key="vec_id", vec="embedding", **names)
    found = ann.search_cells(asked, index, nprobe, **names)
    exact = search.search_topk(asked, emb, C.TOP_K, C.FLOOR, key="vec_id", vec="embedding", **names)
    return found, exact


@query("search_ann")
def search_ann(spark, sf_dir):
    """Approximate search of every twentieth stored vector, each hit with the query's recall."""
    found, exact = ann_hits(spark, sf_dir)
    found = found.checkpoint()
    return found.join(ann.recall(found, exact), "query_id").select(
        "query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "recall")


@query("search_ann_recall")
def search_ann_recall(spark, sf_dir):
    """Whether the approximate search finds nine tenths of the exact hits or more, over all queries."""
    per_query = ann.recall(*ann_hits(spark, sf_dir))
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n_exact").alias("n_hits"),
                         (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("recall_reached"))


# --- 5. retrieval -------------------------------------------------------------------

@query("search_chunks")
def search_chunks(spark, sf_dir):
    h = hits_df(spark, sf_dir)
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score", "sample_id", "chunk_type")


@query("search_topk_sparse")
def search_topk_sparse(spark, sf_dir):
    """search_chunks by inverted lists."""
    h = hits_df(spark, sf_dir, sparse.search_sparse)
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score", "sample_id", "chunk_type")


@query("dedup_hits")
def dedup_hits(spark, sf_dir):
    d = retrieval.dedup_hits(hits_df(spark, sf_dir))
    return d.select("query_id", "sample_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("build_context")
def build_context(spark, sf_dir):
    return retrieval.build_context(retrieval.dedup_hits(hits_df(spark, sf_dir)))


@query("route_questions")
def route_questions(spark, sf_dir):
    return retrieval.route(questions_df(spark, sf_dir), hits_df(spark, sf_dir))


@query("answer_sources")
def answer_sources(spark, sf_dir):
    h = hits_df(spark, sf_dir)
    s = retrieval.sources(h)
    q = questions_df(spark, sf_dir).select("query_id")
    j = q.join(s, "query_id", "left")
    return j.select("query_id", F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("n_hits"),
                    F.coalesce(F.array_join("sources", "\n"), F.lit("")).alias("sources"))


def answered_df(spark, sf_dir) -> DataFrame:
    """question, context ('' without hits) and route for every question."""
    h = hits_df(spark, sf_dir)
    q = questions_df(spark, sf_dir).select("query_id", "question")
    ctx = retrieval.build_context(retrieval.dedup_hits(h))
    r = retrieval.route(q, h)
    return (q.join(ctx, "query_id", "left").join(r, "query_id")
            .withColumn("context", F.coalesce("context", F.lit(""))))


def web_results(spark, sf_dir) -> DataFrame:
    """(query_id, raw): what a web search returned for a question.  Stands in for
    the search engine: the address of the page with the question's number, for
    every seventh question a blank result."""
    p = src.read_table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("query_id"),
                    F.when(F.col("page_id") % 7 == 0, F.lit(" \n")).otherwise(F.col("url")).alias("raw"))


@query("generation_prompts")
def generation_prompts(spark, sf_dir):
    """System and user message; questions routed to the web carry a hint."""
    a = answered_df(spark, sf_dir).join(web_results(spark, sf_dir), "query_id", "left")
    hint = F.when(F.col("use_web"), X.strip("raw"))
    return a.select("query_id", "use_web", F.lit(C.RAG_SYSTEM_PROMPT).alias("system"),
                    retrieval.generation_prompt("question", "context", hint).alias("prompt"))


@query("web_prompts")
def web_prompts(spark, sf_dir):
    """Search query, and what is sent with its results to be summarised."""
    a = answered_df(spark, sf_dir).filter("use_web").join(web_results(spark, sf_dir), "query_id", "left")
    return a.select("query_id", retrieval.web_search_query("question").alias("search_query"),
                    F.lit(C.WEB_SYSTEM_PROMPT).alias("system"),
                    retrieval.web_request("question", F.coalesce("raw", F.lit(""))).alias("request"))


@query("prefixed_embeddings")
def prefixed_embeddings(spark, sf_dir):
    """Passages and queries embedded with their prefixes."""
    docs = src.read_text_table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("id"), "text")
    asked = src.read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    def entries(df, kind, prefix):
        e = vectors.sparse_entries(vectors.hash_embed(df, "text", prefix=prefix), "id")
        return e.select(F.lit(kind).alias("kind"), "id", "bucket", F.round("weight", 6).alias("weight"))
    return entries(docs, "passage", C.PASSAGE_PREFIX).unionByName(entries(asked, "query", C.QUERY_PREFIX))


PROJECTION_DIM = 8


def letter_projection(path: str):
    """A small model kept in a file: letter counts of a text times a matrix of 26 rows."""
    import numpy as np
    from ..sources.files import read_bytes
    matrix = np.frombuffer(read_bytes(path), dtype="<f8").reshape(26, PROJECTION_DIM)

    def embed(texts: list[str]):
        counts = np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=np.float64)
        return counts.reshape(-1, 26) @ matrix
    return embed


@query("model_embeddings")
def model_embeddings(spark, sf_dir):
    """Documents embedded by a model that every task loads once from a file in the shared folder."""
    import numpy as np
    from ..session import scratch_dir
    from ..sources.files import write_bytes
    path = scratch_dir(spark, "model") + "/projection.f8"
    matrix = np.array([[((7 * b + 3 * d) % 11 - 5) / 10 for d in range(PROJECTION_DIM)] for b in range(26)])
    write_bytes(path, matrix.astype("<f8").tobytes())
    docs = src.read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    e = vectors.embed_with_model(docs, "text", "vector", lambda: letter_projection(path), PROJECTION_DIM)
    values = X.explode_rows(e, ["doc_id"], F.col("vector"), "pos", "value")
    return values.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


# --- 6. tables over time --------------------------------------------------------------

@query("upsert_points")
def upsert_points(spark, sf_dir):
    """Two loads of the collection: labels 0-6 stored, labels 3-9 arriving
    with a new payload; 3-6 are replaced, 0-2 kept, 7-9 inserted."""
    emb = src.read_table(spark, sf_dir, "embeddings")
    existing = emb.filter(F.col("label") <= 6).select("vec_id", F.col("label").cast("long").alias("label"))
    incoming = emb.filter(F.col("label") >= 3).select("vec_id", (F.col("label") + 100).cast("long").alias("label"))
    return pts_src.upsert(existing, incoming, "vec_id")


@query("saved_corpus")
def saved_corpus(spark, sf_dir):
    """The corpus fetched once and kept: the second call reads the saved copy, not its input."""
    from ..session import scratch_dir
    path = scratch_dir(spark, "corpus") + "/qa"
    pts_src.materialize_once(spark, src.qa_corpus(spark, sf_dir), path)
    return pts_src.materialize_once(spark, src.qa_corpus(spark, sf_dir).limit(0), path)


@query("saved_chunks")
def saved_chunks(spark, sf_dir):
    """The chunk table kept under the fingerprint of its corpus, read back."""
    from ..session import scratch_dir
    base = scratch_dir(spark, "chunks")
    for _ in range(2):                                   # the second call finds the folder
        saved = pts_src.chunk_sink(spark, qa_vi(spark, sf_dir), chunking.chunk_samples, base)
    return saved


@query("saved_splits")
def saved_splits(spark, sf_dir):
    """The splits written one folder each, and each read back by itself."""
    from ..session import scratch_dir
    path = scratch_dir(spark, "splits")
    pts_src.write_splits(batches.train_eval_split(accepted_ids(spark, sf_dir)).select("sample_id", "split"), path)
    parts = [spark.read.parquet(f"{path}/split={x}").withColumn("split", F.lit(x)) for x in ("train", "eval")]
    return parts[0].unionByName(parts[1])


@query("resume_pending")
def resume_pending(spark, sf_dir):
    """Chunks still to index when the chunks of English documents were
    indexed by an earlier run (resume by key, not by a row count)."""
    c = chunk_ids_df(spark, sf_dir)
    en = src.read_table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select(F.col("doc_id").alias("sample_id"))
    done = c.join(en, "sample_id", "left_semi").select("chunk_id")
    return pts_src.pending(c, done, "chunk_id").select("chunk_id", "sample_id", "chunk_type")


@query("collection_state")
def collection_state(spark, sf_dir):
    """A collection created when absent, filled, and opened again."""
    from ..session import scratch_dir
    emb = src.read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = scratch_dir(spark, "collection")
    made = Collection.ensure(spark, path, emb.schema, "id", vector="vector", dim=64)
    was_empty = made.read().isEmpty()
    made.upsert(emb)
    again = Collection.ensure(spark, path, emb.schema, "id", vector="vector", dim=64).read()
    return again.agg(F.lit(was_empty).alias("was_empty"), F.count(F.lit(1)).alias("n_points"),
                     F.count_if(vectors.contract_status("vector", 64) != "ok").alias("n_violations"))


@query("upsert_versions")
def upsert_versions(spark, sf_dir):
    """Every version of a collection after three commits, vectors included: labels 0-6 stored,
    labels 3-9 arriving with negated vectors, the second load repeated under its epoch."""
    from ..session import scratch_dir
    emb = src.read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    first = emb.where("label <= 6")
    second = emb.where("label >= 3").withColumn("label", F.col("label") + 100).withColumn(
        "embedding", F.transform("embedding", lambda x: -x))
    table = Collection.ensure(spark, scratch_dir(spark, "versions"), emb.schema, "vec_id", 16, vector="embedding", dim=64)
    numbers = [table.upsert(first, stream="loads", epoch=0), table.upsert(second, stream="loads", epoch=1),
               table.upsert(first, stream="loads", epoch=1)]          # comes again: changes nothing
    rows = [table.read(n).withColumn("version", F.lit(n).cast("long")) for n in sorted(set(numbers))]
    both = rows[0].unionByName(rows[1])
    total = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return both.select("version", "vec_id", "label", F.round(total, 5).alias("weighted_sum"))


# --- 7. sessions -------------------------------------------------------------------------

def messages_df(spark, sf_dir) -> DataFrame:
    return sessions.messages_from_conversations(src.read_table(spark, sf_dir, "conversations"))


@query("session_memory")
def session_memory(spark, sf_dir):
    """Last 3 messages per conversation (no test conversation reaches 20)."""
    return sessions.last_n(messages_df(spark, sf_dir), 3).select("session_id", "seq", "role", "content")


@query("session_memory_events")
def session_memory_events(spark, sf_dir):
    """Last 20 events per user, in time order."""
    ev = src.read_table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (ev.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= C.SESSION_MEMORY)
            .select("user_id", "event_id", "event_type", "value"))


@query("session_history")
def session_history(spark, sf_dir):
    mem = sessions.last_n(messages_df(spark, sf_dir), C.SESSION_MEMORY)
    return sessions.history(mem)


@query("session_after_clear")
def session_after_clear(spark, sf_dir):
    """A system row clears its conversation; keep what follows (last 20)."""
    m = messages_df(spark, sf_dir)
    kept = sessions.after_last_clear(m, F.col("role") == "system")
    return sessions.last_n(kept, C.SESSION_MEMORY).select("session_id", "seq", "role", "content")


@query("session_pairs")
def session_pairs(spark, sf_dir):
    """Memory of completed exchanges only (question and answer), last 3 of them."""
    return sessions.last_n(sessions.completed_pairs(messages_df(spark, sf_dir)), 6).select("session_id", "seq", "role", "content")


@query("session_lookup")
def session_lookup(spark, sf_dir):
    """Every known session and as many unknown ones; those are empty."""
    m = messages_df(spark, sf_dir)
    return sessions.lookup_history(lookup_requests(spark, sf_dir), sessions.last_n(m, C.SESSION_MEMORY))


def lookup_requests(spark, sf_dir) -> DataFrame:
    m = messages_df(spark, sf_dir)
    return m.select("session_id").unionByName(m.select(F.concat(F.lit("unknown-"), "session_id").alias("session_id")))


@query("session_titles")
def session_titles(spark, sf_dir):
    return sessions.titles(messages_df(spark, sf_dir))


@query("session_count")
def session_count(spark, sf_dir):
    return sessions.session_count(messages_df(spark, sf_dir))


# --- 8. dataset preparation -----------------------------------------------------------------

def accepted_ids(spark, sf_dir) -> DataFrame:
    return prep.accepted_pairs(qa_vi(spark, sf_dir)).select("sample_id")


@query("train_eval_split")
def train_eval_split(spark, sf_dir):
    return batches.train_eval_split(accepted_ids(spark, sf_dir)).select("sample_id", "split")


@query("limited_splits")
def limited_splits(spark, sf_dir):
    return batches.limited_splits(accepted_ids(spark, sf_dir), 50).select("sample_id", "split", "pos")


WORD = r"[\p{L}\p{N}]+"


def word_lengths(spark, sf_dir) -> DataFrame:
    t = prep.training_texts(qa_vi(spark, sf_dir))
    return t.select("sample_id", F.size(F.regexp_extract_all("text", F.lit(WORD), 0)).cast("long").alias("n_tokens"))


@query("token_length_stats")
def token_length_stats(spark, sf_dir):
    w = word_lengths(spark, sf_dir)
    return w.agg(F.count(F.lit(1)).alias("n_texts"), F.round(F.avg("n_tokens"), 6).alias("avg_len"),
                 F.max("n_tokens").alias("max_len"), F.min("n_tokens").alias("min_len"))


@query("padded_batches")
def padded_batches(spark, sf_dir):
    w = word_lengths(spark, sf_dir).withColumn("n_tokens", F.least("n_tokens", F.lit(C.MAX_SEQ_LEN)).cast("long"))
    tr = batches.train_positions(w)
    return batches.padded_lengths(tr, "n_tokens").select("sample_id", "batch_id", "n_tokens", "padded_len", "n_pad")




# --- 9. byte-level BPE ------------------------------------------------------------------------
# NFKC and the tokens of a learned vocabulary have no DuckDB form: those rows are
# compared with the public `tokenizers` package in the tests.

def training_texts_df(spark, sf_dir) -> DataFrame:
    return prep.training_texts(qa_vi(spark, sf_dir))


def bpe_model(spark, sf_dir, vocab_size: int = C.VOCAB_SIZE) -> tuple[DataFrame, DataFrame]:
    """Learn once and save (vocab, merges) under the shared checkpoint folder;
    later calls load the saved tables, like a saved tokenizer folder.  The folder
    is named by the files of the texts and by the parameters."""
    tag = f"{pts_src.stamp(spark, src.table_path(sf_dir, 'documents'))}-{vocab_size}-{C.MIN_FREQUENCY}"
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/bpe-{tag}"
    if not pts_src._complete(spark, base + "/merges"):
        vocab, merges = bpe.learn_bpe(spark, training_texts_df(spark, sf_dir), vocab_size=vocab_size)
        vocab.coalesce(1).write.mode("overwrite").parquet(base + "/vocab")
        merges.coalesce(1).write.mode("overwrite").parquet(base + "/merges")       # the last one written
    return spark.read.schema("token string, id int").parquet(base + "/vocab"), \
        spark.read.schema("rank int, left int, right int, id int").parquet(base + "/merges")


@query("nfkc_texts")
def nfkc_texts(spark, sf_dir):
    t = training_texts_df(spark, sf_dir)
    return t.select("sample_id", bpe.nfkc(F.col("text")).alias("text"))


@query("pretoken_counts")
def pretoken_counts(spark, sf_dir):
    return bpe.pretoken_counts(training_texts_df(spark, sf_dir))


@query("pair_counts")
def pair_counts(spark, sf_dir):
    """Adjacent pairs of initial symbols over all pre-tokens: the counts that learning starts from."""
    p = bpe.pair_counts(training_texts_df(spark, sf_dir))
    return p.select(F.shiftright("p", 32).alias("left"), F.col("p").bitwiseAND(0xFFFFFFFF).alias("right"), F.col("c").alias("n"))


@query("bpe_merges")
def bpe_merges(spark, sf_dir):
    vocab, merges = bpe.learn_bpe(spark, training_texts_df(spark, sf_dir))
    return merges.join(vocab, "id").select("rank", "left", "right", "id", "token")


@query("encode_texts")
def encode_texts(spark, sf_dir):
    vocab, merges = bpe_model(spark, sf_dir)
    e = bpe.encode(training_texts_df(spark, sf_dir), "sample_id", "text", vocab, merges)
    return e.select("sample_id", "n_ids", "truncated", (F.col("labels") == F.col("input_ids")).alias("labels_equal"),
                    F.array_join("input_ids", " ").alias("ids"))


@query("roundtrip_mismatches")
def roundtrip_mismatches(spark, sf_dir):
    """decode(encode(text)) against the NFKC text, whole texts."""
    vocab, merges = bpe_model(spark, sf_dir)
    t = training_texts_df(spark, sf_dir)
    both = t.select(F.struct("sample_id", bpe.nfkc(F.col("text")).alias("norm")).alias("row"), "text")
    e = bpe.encode(both, "row", "text", vocab, merges, max_len=None)
    d = bpe.decode(e, "row", vocab)
    return d.select("row.sample_id", (F.col("text") == F.col("row.norm")).alias("roundtrip_ok"))


@query("padded_encoded_batches")
def padded_encoded_batches(spark, sf_dir):
    """Training batches of 2 over the encoded train split: ids padded with
    [PAD], labels with -100, attention mask with 0, to a multiple of 8."""
    vocab, merges = bpe_model(spark, sf_dir)
    e = bpe.encode(training_texts_df(spark, sf_dir), "sample_id", "text", vocab, merges)
    # only the ids are ranked; the encoded rows meet their positions afterwards
    tr = e.join(batches.train_positions(accepted_ids(spark, sf_dir)), "sample_id")
    b = batches.padded_lengths(tr, "n_ids")
    ids_p, lab_p, mask_p = batches.pad_arrays("input_ids", "labels", "attention_mask", "padded_len",
                                              C.SPECIAL_TOKENS.index(C.PAD_TOKEN))
    out = b.select("sample_id", "batch_id", "n_ids", "padded_len", ids_p.alias("ids"), lab_p.alias("lab"),
                   mask_p.alias("mask"))
    return out.select("sample_id", "batch_id", "n_ids", "padded_len", *[
        F.array_join(c, " ").alias(c) for c in ("ids", "lab", "mask")])


@query("vocab_specials")
def vocab_specials(spark, sf_dir):
    vocab, _ = bpe_model(spark, sf_dir)
    specials = vocab.filter(F.col("token").isin(C.SPECIAL_TOKENS)).select("token", F.col("id").cast("long").alias("id"))
    size = vocab.agg(F.count(F.lit(1)).alias("id")).select(F.lit("<vocab_size>").alias("token"), "id")
    return specials.unionByName(size)




@query("bpe_length_stats")
def bpe_length_stats(spark, sf_dir):
    """Token length of the encoded training texts (cut to the maximum)."""
    vocab, merges = bpe_model(spark, sf_dir)
    e = bpe.encode(training_texts_df(spark, sf_dir), "sample_id", "text", vocab, merges)
    return e.agg(F.count(F.lit(1)).alias("n_texts"), F.round(F.avg("n_ids"), 6).alias("avg_len"),
                 F.max("n_ids").alias("max_len"), F.min("n_ids").alias("min_len"))


# --- 10. training log ---------------------------------------------------------------------------

def training_log_entries(spark, sf_dir) -> DataFrame:
    """Log entries derived from `events`: views and clicks log a loss, errors an
    evaluation, the others neither; the learning rate decays with the step.  Purchases
    add a metric of their own; every seventh step reports `epoch` again, which replaces it."""
    e = src.read_table(spark, sf_dir, "events")
    kind, step = F.col("event_type"), F.col("event_id")
    metrics = {"loss": F.when(kind.isin("view", "click"), F.col("value") / 7),
               "eval_loss": F.when(kind == "error", F.col("value") / 11),
               "learning_rate": F.when(kind != "signup", F.lit(2e-4) * (1 + F.pmod(step, F.lit(9)))),
               "grad_norm": F.when(kind == "purchase", F.col("value")),
               "epoch": F.when(step % 7 == 0, (step / 1000).cast("double"))}
    return e.select(step.cast("long").alias("step"),
                    F.when(step % 7 == 0, -1.0).otherwise((step / 1000).cast("double")).alias("epoch"),
                    F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v)]).alias("metrics"),
                    F.date_format("ts", "HH:mm:ss").alias("timestamp"))


def training_log_df(spark, sf_dir) -> DataFrame:
    """The entries written as JSON lines, by two writers, and read back."""
    from ..operators import logs
    from ..session import scratch_dir
    path = scratch_dir(spark, "training-log")
    entries = training_log_entries(spark, sf_dir)
    logs.append_log(entries.where("step % 2 = 0"), path)
    logs.append_log(entries.where("step % 2 <> 0"), path)
    return logs.read_log(spark, path)


@query("training_log_keys")
def training_log_keys(spark, sf_dir):
    """Every key of the written lines and the number of lines that have it."""
    from ..operators import logs
    from ..session import scratch_dir
    path = scratch_dir(spark, "training-log")
    logs.append_log(training_log_entries(spark, sf_dir), path)
    return logs.log_keys(spark, path)


@query("training_log_report")
def training_log_report(spark, sf_dir):
    from ..operators import logs
    return logs.log_report(training_log_df(spark, sf_dir)).select("step", "message")


@query("best_checkpoint")
def best_checkpoint(spark, sf_dir):
    from ..operators import logs
    return logs.best_checkpoint(training_log_df(spark, sf_dir)).select("best_step", F.round("best_eval_loss", 6).alias("best_eval_loss"))


# --- 11. streams ---------------------------------------------------------------------------------

def _conv_schema(spark, sf_dir):
    return src.read_table(spark, sf_dir, "conversations").schema


@query("session_memory_stream")
def session_memory_stream(spark, sf_dir):
    """session_memory computed by a Structured Streaming job with per-session state."""
    from ..streaming import sessions as S
    mem = S.run_memory_stream(spark, sf_dir, "conversations.parquet", _conv_schema(spark, sf_dir),
                              sessions.messages_from_conversations, 3)
    return mem.select("session_id", "seq", "role", "content")


@query("session_after_clear_stream")
def session_after_clear_stream(spark, sf_dir):
    """session_after_clear on a stream: a system row clears the session state."""
    from ..streaming import sessions as S
    mem = S.run_memory_stream(spark, sf_dir, "conversations.parquet", _conv_schema(spark, sf_dir),
                              sessions.messages_from_conversations, C.SESSION_MEMORY, clear_role="system")
    return mem.select("session_id", "seq", "role", "content")


def events_as_messages(ev: DataFrame) -> DataFrame:
    """Events as rows of a session: a user's events in the order of time, then id (below 1,000
    events of a user in one microsecond)."""
    ts = F.col("ts").cast("timestamp")
    return ev.select(F.col("user_id").cast("string").alias("session_id"),
                     (F.unix_micros(ts) * 1000 + F.pmod("event_id", F.lit(1000))).alias("seq"),
                     F.col("event_type").alias("role"), F.col("event_id").cast("string").alias("content"), ts.alias("ts"))


@query("session_memory_events_stream")
def session_memory_events_stream(spark, sf_dir):
    """session_memory_events by a stream in event time."""
    from ..streaming import sessions as S
    ev = src.read_table(spark, sf_dir, "events")
    mem = S.run_event_memory_stream(spark, sf_dir, "events.parquet", ev.schema, events_as_messages, C.SESSION_MEMORY,
                                    per_trigger=None)          # a table's files are in no order of time
    kept = mem.select(F.col("content").cast("long").alias("event_id"))
    return ev.join(kept, "event_id", "left_semi").select("user_id", "event_id", "event_type", "value")


@query("session_count_stream")
def session_count_stream(spark, sf_dir):
    """Whether a stream's sketch estimates the number of conversations within 3 percent."""
    from ..streaming import sessions as S
    counted = S.run_session_count(spark, sf_dir, "conversations.parquet", _conv_schema(spark, sf_dir),
                                  sessions.messages_from_conversations)
    exact = sessions.session_count(messages_df(spark, sf_dir))
    both = counted.select(F.col("n_sessions").alias("e"), F.lit(None).cast("long").alias("n")).unionByName(
        exact.select(F.lit(None).cast("long").alias("e"), F.col("n_sessions").alias("n")))
    return both.agg(F.max("n").alias("n_sessions"),
                    (F.abs(F.max("e") - F.max("n")) <= 0.03 * F.max("n")).alias("within_bound"))


@query("session_state_lookup")
def session_state_lookup(spark, sf_dir):
    """session_lookup answered from the stream's state store."""
    from ..streaming import sessions as S
    checkpoint = S.run_state(spark, sf_dir, "conversations.parquet", _conv_schema(spark, sf_dir),
                             sessions.messages_from_conversations, C.SESSION_MEMORY)
    return sessions.lookup_history(lookup_requests(spark, sf_dir), S.state_memory(spark, checkpoint))


def index_stream_table(spark, sf_dir, base: str, checkpoint: str, files: str = "documents.parquet", on_batch=None,
                       keep: int | None = None):
    from ..streaming import index as I
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{files}").schema
    stream = src.stream_table(spark, sf_dir, files, schema)
    return I.run_index_stream(spark, stream, base + "/points", base + f"/{checkpoint}",
                              lambda b: src.project_lang(src.qa_from_documents(b), "vi"),
                              n_buckets=16, name=checkpoint, on_batch=on_batch, keep=keep)


def stored_points(p: DataFrame) -> DataFrame:
    """Payload of stored points, with the number of their vector's terms and a weighted sum of it."""
    weighted = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.select("sample_id", "chunk_pos", "chunk_type", "step_idx", "text", "math_type", "query_ref",
                    F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("n_terms"),
                    F.round(weighted, 5).alias("vector_sum"))


@query("index_stream")
def index_stream(spark, sf_dir):
    """Chunk + embed + upsert as a stream over the corpus, run twice (the second run
    re-reads everything under a fresh checkpoint): the collection must equal the batch
    chunk table, vectors included.  Nobody reads while the stream runs: two versions are kept."""
    from ..session import scratch_dir
    base = scratch_dir(spark, "index-stream")
    for run in range(2):
        table = index_stream_table(spark, sf_dir, base, f"checkpoint-{run}", keep=2)
    return stored_points(table.read())


@query("index_stream_resumed")
def index_stream_resumed(spark, sf_dir):
    """The stream over the corpus in four files, broken off before batch 1 is committed and
    after batch 2 is, and started again from its checkpoint each time."""
    from pyspark.errors import StreamingQueryException
    from ..session import scratch_dir
    base = scratch_dir(spark, "index-resumed")
    src.read_table(spark, sf_dir, "documents").repartition(4, "doc_id").write.parquet(f"{base}/files")
    breaks = {(1, "before"), (2, "after")}

    def on_batch(epoch: int, when: str) -> None:
        if (epoch, when) in breaks:
            breaks.remove((epoch, when))
            raise RuntimeError(f"broken off {when} batch {epoch}")

    for _ in range(len(breaks) + 1):
        try:
            table = index_stream_table(spark, f"{base}/files", base, "checkpoint", "*.parquet", on_batch)
        except StreamingQueryException:
            continue
    if breaks or table.versions()[-1] != table.version().epochs["checkpoint"] + 1:
        raise RuntimeError("a batch was left out or applied twice")
    return stored_points(table.read())


FLAGSHIP = "route_questions"
