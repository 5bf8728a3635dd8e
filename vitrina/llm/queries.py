"""The corpus operators bound to the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import (
    conversations, jaccard_join, line_quality, mixing, packing, pseudonyms, quality, repeats, token_files, topk, toxicity, treap, url_filter,
)
from vitrina.llm.common import read, ship
from vitrina.llm.encoding import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


@_query
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_token_files(read(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_files.read_documents(files)


@_query
def op4_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_quality.clean_documents(read(spark, folder, "documents"), with_text=False)
    return cleaned.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op5_pack(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_documents(read(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op8_mix_sources"] = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('7:' || coalesce(doc_id::varchar, '')) as draw
  from documents
), s as (
  select source, sum(size)::bigint as words, (list_value(5, 2, 1))[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from d group by source
), r as (
  -- Sources by the level at which they are full; those before the first that stays open are clamped.
  select *, row_number() over (order by 3 * words / weight, source nulls last) as k,
         sum(3 * words) over (order by 3 * words / weight, source nulls last rows between unbounded preceding and 1 preceding) as capped,
         sum(weight) over (order by 3 * words / weight, source nulls last rows between current row and unbounded following) as open_weight,
         sum(words) over () as budget
  from s
), o as (
  select k, (budget - coalesce(capped, 0))::bigint::double / open_weight::bigint::double as level
  from r where (budget - coalesce(capped, 0)) / open_weight <= 3 * words / weight
  order by k limit 1
), t as (
  select source, words, case when r.k < o.k then (3 * words)::double else weight * level end as target from r, o
), u as (
  select *, case when words > 0 then floor(target / words)::bigint else 0 end as epochs from t
), x as (
  select doc_id, size, words as source_size, target, epochs,
         greatest(0, round(target)::bigint - epochs * words) as extra,
         coalesce(sum(size) over (partition by d.source order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join u on d.source is not distinct from u.source
)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, extra - before)))::bigint as taken from x
"""


@_query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = toxicity.score_documents(
        read(spark, folder, "documents"), read(spark, folder, "labels"), train=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query
def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read(spark, folder, "embeddings"))


ORACLES["op7_top_k"] = """
with v as (
  select vec_id, [floor(1024 * x::double) for x in embedding] as e
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""


#: Rules of the URL filter: whether each blocks.
URL_RULES = {"net/": True, "example.net/en/": False, "example.com/de/": True, "org/fr/": False}


@_query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@_query
def op10_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="corpus-key", count="n_found")


@_query
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, folder, "documents"))


@_query
def op6_remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op13_repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damage(read(spark, folder, "conversations")), with_turns=False)


@_query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return treap.ranked_search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op12_ranked_search"] = f"""
with d as (
  select row_number() over () as row_no, doc_id, {_TERMS} as words from documents
), size as (
  select count(*)::bigint as n_docs, sum(len(words))::bigint as n_terms from d where len(words) > 0
), p as (
  select row_no, doc_id, n, term, count(*)::bigint as tf
  from (select row_no, doc_id, len(words)::bigint as n, unnest(words) as term from d) group by all
), i as (
  select distinct item_id, unnest({_TERMS}) as term from benchmark
), f as (
  select term, count(*)::bigint as df from p group by term
), w as (
  select item_id, term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as weight
  from i join f using (term), size
), s as (
  select item_id, row_no, doc_id,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::bigint as score
  from w join p using (term), size group by all
), r as (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::integer as rank from s where score > 0
)
select item_id, rank, doc_id, score from r where rank <= 10
"""


@_query
def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = quality.score_documents(read(spark, folder, "documents"), read(spark, folder, "labels"), train=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
