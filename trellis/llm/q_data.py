"""Queries of the operators on archives and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import mixing, warc
from trellis.llm.q_text import table


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"), "page_id", "url", "html")
    lost = F.raise_error(F.concat(F.lit("unreadable bytes in "), "path", F.lit(": "), F.coalesce("reason", F.lit(""))))
    return found.select(F.when(F.col("record_type") == "gap", lost.cast("long")).otherwise(warc.row_id("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.row_id("refers_to").alias("refers_to"))


#: DuckDB has no SHA-1 in base32; it is put together from the hex digits, five bits at a time.
_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
 h as (select page_id, payload, strlen(payload)::bigint as payload_bytes, sha1(payload) as hex from p),
 bits as (select *, list_aggregate(list_transform(string_split(hex, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', instr('0123456789abcdef', c) * 4 - 3, 4)), 'string_agg', '') as b from h),
 d as (select page_id, payload_bytes, hex, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   1 + 16 * substr(b, i * 5 + 1, 1)::int + 8 * substr(b, i * 5 + 2, 1)::int + 4 * substr(b, i * 5 + 3, 1)::int + 2 * substr(b, i * 5 + 4, 1)::int + substr(b, i * 5 + 5, 1)::int, 1)), 'string_agg', '') as payload_digest,
   min(page_id) over (partition by payload) as first_id from bits)
select page_id, payload_bytes, payload_digest, case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
 case when page_id = first_id then null else first_id end as refers_to from d"""

QUERIES = {"op5_mix_sources": op5_mix_sources, "op9_warc": op9_warc}
ORACLE_SQL = {"op9_warc": _WARC_SQL}
