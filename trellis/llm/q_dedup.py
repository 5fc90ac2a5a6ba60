"""Queries of the deduplication operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import jaccard, neardup, substring, suffix_dedup
from trellis.llm.q_text import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair is compared, with row numbers telling rows that repeat an id or have none apart; components by recursion.
_NEAR_SQL = """
with recursive v as (select vec_id, embedding::double[] as e, r, coalesce(vec_id::varchar, 'row ' || r) as node from (select *, row_number() over () as r from embeddings)),
 good as (select *, sqrt(list_dot_product(e, e)) as norm from v where e is not null and len(e) > 0
   and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
 link as (select a.node as u, b.node as w, a.r as r from good a join good b on a.r <> b.r and len(a.e) = len(b.e)
   and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
 reach(u, w) as (select node, node from v union select reach.u, link.w from reach join link on link.u = reach.w),
 c as (select u, min(x.vec_id) as component_id from reach join v x on x.node = reach.w group by u),
 n as (select r, count(*) as n_links from link group by r)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, coalesce(v.vec_id = component_id, false) as kept
from v join c on c.u = v.node left join n on n.r = v.r"""


QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup, "op4_ngram_jaccard": op4_ngram_jaccard, "op1_suffix_array_dedup": op1_suffix_array_dedup, "op3_substring_dedup": op3_substring_dedup}
ORACLE_SQL = {"op10_embedding_near_dedup": _NEAR_SQL}
