"""The registered queries of this subpackage: thin digests of the operators
over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaframe.llm.byte_bpe import decode_bytes, encode_bytes
from qaframe.llm.common import stage, table, workdir
from qaframe.llm.embeddings import near_vectors
from qaframe.llm.idstore import read_ids, write_ids
from qaframe.llm.line_dedup import line_dedup
from qaframe.llm.manifest import fold, leaf_digest, merkle_manifest, proof_digest
from qaframe.llm.minhash import near_duplicates
from qaframe.llm.packing import pack
from qaframe.llm.pieces import decode_pieces, encode_pieces
from qaframe.llm.quality import quality
from qaframe.llm.runs import periodic_runs
from qaframe.llm.sharding import shard_by_bytes
from qaframe.llm.urls import UrlRule, judge_urls
from qaframe.llm.warc import read_packages, write_packages


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("cleaned")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; a parameter of the operators, never part of this repository."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again: a digest of both directions."""
    model = tokenizer("piece_bpe_32k.model")
    encoded = stage(encode_pieces(table(spark, sf_dir, "documents"), model), workdir(spark, "pieces"))
    digest = encoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "n_bytes",
                            F.crc32("ids").alias("ids_crc32"), "ids")
    # decoded from the stored ids alone, in the same row order
    texts = decode_pieces(digest.select(F.struct("doc_id", "n_tokens", "n_bytes", "ids_crc32").alias("row"), "ids"),
                          model, id_col="row")
    return texts.select("row.*", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written, then every document fetched by its key."""
    docs, folder = table(spark, sf_dir, "documents"), workdir(spark, "ids")
    write_ids(docs, tokenizer("word_bpe_49k.json"), folder=folder)
    return read_ids(folder, docs.select("doc_id")).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


URL_RULES = [UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"),
             UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/")]


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block list of the query: URLs of pages whose document is labelled toxic."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf_dir, "pages").join(toxic, "page_id", "left_semi").select("url")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), listed_urls(spark, sf_dir), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_packages(table(spark, sf_dir, "pages"))
    return read_packages(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the ranks; decoded from the stored ids alone."""
    import public_tokenizers
    model = (tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = stage(encode_bytes(table(spark, sf_dir, "documents"), *model), workdir(spark, "byte-bpe"))
    row = F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                   F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"))
    decoded = decode_bytes(encoded.select(row.alias("row"), "ids"), *model, id_col="row")
    return decoded.select("row.*", F.sha2("bytes", 256).alias("decoded_sha256"))


def _repeated_tails(docs: DataFrame) -> DataFrame:
    """Of a tenth of the documents (by the crc32 h of the id) the words from number
    g % n on are replaced by repetitions of the first p of them, g = h div 10."""
    h = "crc32(cast(cast(doc_id as string) as binary))"
    words = "filter(split(text, r'[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    split = docs.select("doc_id", "text", F.expr(f"{h} div 10").alias("g"),
                        F.expr(f"if({h} % 10 = 0, {words}, cast(array() as array<string>))").alias("w"))
    placed = split.select("doc_id", "text", "g", "w", F.size("w").cast("long").alias("n"))
    cut = placed.withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    cut = cut.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = ("array_join(concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), "
            "int((n - a) div p) + 1)), 1, int(n - a))), ' ')")
    return cut.select("doc_id", F.expr(f"if(n > 0, {tail}, text)").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN if(x.length > y.length, -1, 1) "
                  "WHEN x.start <> y.start THEN if(x.start < y.start, -1, 1) ELSE if(x.period < y.period, -1, 1) END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    first = found.withColumn("best", F.get(best, F.lit(0)))
    return first.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, checked against documents of which half may have lost line breaks."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*columns)
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    seen = F.when(picked, F.translate("text", "\n", "")).otherwise(F.col("text"))
    manifest = merkle_manifest(docs, columns, carry={"seen_leaf": leaf_digest(
        [seen if c == "text" else F.col(c) for c in columns])})
    folded = manifest.withColumn("folded_root", fold(F.col("path"), F.col("seen_leaf")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_ids": op3_token_ids,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
