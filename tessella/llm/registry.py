"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, chat_tree, hard_negatives, images, jaccard, licenses, maxscore, packing, prefix_bpe, quality, speculative_bpe, suffix_dedup, wavelet
from .common import spread
from .tokenizing import public_file

#: Runs a query by name; SQL by name. Filled below.
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op5_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_count_vector_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.token_store(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"))
    return wavelet.read_documents(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def decimal_texts(most: int, after: bytes = b" "):
    """Every number below most in decimal with a space or other byte after it, in one buffer, with starts and lengths."""
    table = [str(i).encode() + after for i in range(most)]
    lengths = np.array([len(x) for x in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths


@query
def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_file("byte_bpe_50k.tiktoken")
    encoded = prefix_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)

    def digests(batches):
        flat, starts, lengths = decimal_texts(len(prefix_bpe.token_bytes(ranks)[1]))
        for batch in batches:
            for i, ids, at, raw, ends in prefix_bpe.decode_batch(batch, ranks):
                sizes = lengths[ids]
                text = flat[spread(starts[ids], sizes)].tobytes()
                marks = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
                spelled = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(marks, marks[1:])]
                raw, marks = raw.tobytes(), ends.tolist()
                decoded = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(marks, marks[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(spelled)), pa.array(np.diff(at)), pa.array(spelled), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query
def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


ORACLE["op3_maxscore"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


@query
def op4_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    nodes, paths = chat_tree.prefix_tree(turns.union(extra), public_file("byte_bpe_50k.json"))
    back = chat_tree.read_back(nodes, paths, public_file("byte_bpe_50k.json"))
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op7_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op2_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so every embedding vector is drawn as one."""
    return images.copies(images.rendered(table(spark, sf_dir, "embeddings")))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model"))


@query
def op13_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_file("byte_bpe_50k.json")

    def digests(batches):
        flat, starts, lengths = decimal_texts(len(speculative_bpe.id_bytes(path)[1]), b",")
        for batch in batches:
            for i, ids, at, texts in speculative_bpe.decode_batch(batch, path):
                sizes = lengths[ids]
                spelled = flat[spread(starts[ids], sizes)].tobytes()
                marks = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
                of_ids = [hashlib.sha256(spelled[a : max(a, b - 1)]).hexdigest() for a, b in zip(marks, marks[1:])]
                of_texts = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(np.diff(at)), pa.array(of_ids), pa.array(of_texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    encoded = speculative_bpe.encode_documents(table(spark, sf_dir, "documents"), path)
    return encoded.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


ORACLE["op12_hard_negatives"] = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.r as a, a.vec_id as anchor_id, c.r as c, c.vec_id, a.label = c.label as same,
    cast(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) as bigint) as score
  from v a join v c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id
), p as (
  select *, row_number() over (partition by a order by score desc, vec_id, c) as nth from s where same qualify nth <= 5
), n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.a, p.nth order by s.score desc, s.vec_id, s.c) as rank
  from p join s on p.a = s.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
