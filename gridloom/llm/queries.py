"""One query per operator, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.substring_dedup import substring_dedup

    done = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@_query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.jaccard_join import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents"))


@_query("op5_token_store")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.token_store import read_store, write_store
    from gridloom.session import scratch

    store = scratch(spark, "tokens")
    write_store(_table(spark, sf_dir, "documents"), store, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_store(spark, store)


@_query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.byte_bpe import byte_bpe

    return bpe_digest(byte_bpe(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))


def bpe_digest(coded: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint) n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


@_query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


@_query("op4_chat_format", """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role as opens from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(replace(text, '<|', '<||')) + case when opens then 24 + length(replace(role, '<|', '<||')) else 8 end) as bigint) as formatted_chars
from o group by conv_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.chat_format import format_chats, read_chats

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    back = read_chats(format_chats(turns.unionByName(more)))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length("trained").cast("long").alias("loss_chars"),
        sha(F.col("trained")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _crc(remainder: str):
    return F.expr(f"crc32(cast(cast(doc_id as string) as binary)) {remainder}")


@_query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.language_id import fit, language_id

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(_crc("% 3 <> 1")))
    return language_id(docs.select("doc_id", _crc("% 3 = 1").alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@_query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import fit, labelled, toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(labelled(docs, labels.where(_crc("% 5 <> 0"))))
    return toxicity(docs.select("doc_id", _crc("% 5 = 0").alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")


@_query("op7_topk_search", """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), s as (
  select q.vec_id as query_id, x.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v x on q.vec_id % 20 = 0 and q.vec_id <> x.vec_id
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.topk_search import integer_vectors, top_k

    vectors = integer_vectors(_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


@_query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op11_quality_rules")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality_rules import quality_rules

    done = quality_rules(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.spelling_variants import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


@_query("op13_lexical_search", r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), f as (
  select r, doc_id, cast(len(terms) as bigint) as n, unnest(terms) as term from d
), p as (select r, doc_id, n, term, count(*) as tf from f group by all
), s as (select cast(count(distinct r) as bigint) as nn, cast(count(*) as bigint) as ll from f
), q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), w as (
  select term, cast(floor(1000 * ln(cast(2 * nn + 2 as double) / (2 * count(*) + 1))) as bigint) as w from p, s where term in (select term from q) group by term, nn
), x as (
  select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) as bigint) as score
  from q join w using (term) join p using (term), s group by item_id, r, doc_id
), k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from x where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.lexical_search import ranked_search

    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
