"""Registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultscope.llm import (
    bpe, conversation_repair, embedding_dedup, exact_dedup, html_main, language, mixing, quality_classifier, quality_rules, search, simhash, token_file,
    transducer,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    return transducer.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op3_exact_dedup", """
with d as (
  select doc_id, length(coalesce(text, '')) as size,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
  from documents),
g as (select *, row_number() over (partition by text_sha256 order by size desc, doc_id nulls last) as nth,
             first_value(doc_id) over (partition by text_sha256 order by size desc, doc_id nulls last) as keep_id,
             count(*) over (partition by text_sha256) as group_size from d)
select doc_id, keep_id, group_size, nth = 1 as kept, text_sha256 from g""")
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_language")
def op5_language(spark, sf_dir):
    return language.identify_languages(table(spark, sf_dir, "documents"))


@query("op6_html_main")
def op6_html_main(spark, sf_dir):
    return html_main.extract_main_text(table(spark, sf_dir, "pages"))


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_token_file")
def op8_token_file(spark, sf_dir):
    return token_file.token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_mixing")
def op10_mixing(spark, sf_dir):
    out = mixing.mixture(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query("op11_search", """
with recursive terms(doc_id, row, text) as (
  select doc_id, row_number() over (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from documents),
d as (select row, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from terms),
sizes as (select row, doc_id, count(*) as n from d group by 1, 2),
total as (select count(*)::hugeint as documents, sum(n)::hugeint as words from sizes),
tf as (select row, term, count(*)::hugeint as tf from d group by 1, 2),
df as (select term, count(*) as df from tf group by 1),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
weights as (select item_id, term, floor(1000 * ln((2 * documents + 2)::double / (2 * df + 1)::double))::hugeint as w from asked join df using (term), total),
scores as (
  select item_id, row, s.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // words))))::bigint as score
  from weights join tf using (term) join sizes s using (row), total group by 1, 2, 3),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= 50""")
def op11_search(spark, sf_dir):
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_embedding_dedup", """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
least as (select u, min(v) as m from reach group by 1),
counts as (select u, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id = least(vec_id, coalesce(m, vec_id)) as kept
from embeddings left join counts c on c.u = vec_id left join least l on l.u = vec_id""")
def op12_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    report = conversation_repair.repair_report(conversation_repair.damaged(conversations))
    return conversation_repair.with_emptied(report, conversations)
