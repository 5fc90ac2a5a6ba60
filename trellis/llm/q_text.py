"""Queries of the operators that judge or measure single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import html_text, pieces, quality, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    decoded = pieces.decode(encoded, digest_col="pieces_sha256")
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "pieces_sha256", same.alias("round_trip"))


#: DuckDB: the words of a text, and its lines that hold a word.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_sql() -> str:
    rules = quality.Rules()

    def gram(n: int) -> str:
        return "concat_ws(' ', w, " + ", ".join(f"lead(w, {i}) over p" for i in range(1, n)) + f") as g{n}, lead(w, {n - 1}) over p is not null as full{n}"

    sizes = sorted({rules.window, *rules.ngram_limits})
    grams = ", ".join(gram(n) for n in sizes)
    flags = ", ".join(f"case when full{n} then row_number() over (partition by doc_id, full{n}, g{n} order by pos) > 1 else false end as later{n}" for n in sizes)
    twice = f"case when full{rules.window} then count(*) over (partition by doc_id, full{rules.window}, g{rules.window}) > 1 else false end as twice"
    spread = ", ".join(f"max(later{n}::int) over (partition by doc_id order by pos rows between {n - 1} preceding and current row) as in{n}" for n in rules.ngram_limits)
    sums = ", ".join(f"sum(case when in{n} = 1 then length(w) else 0 end)::bigint as dup_chars_{n}" for n in rules.ngram_limits)
    checks = " or ".join([f"100 * dup_line_chars > {rules.line_limit} * line_chars", *(f"100 * dup_chars_{n} > {limit} * word_chars" for n, limit in rules.ngram_limits.items())])
    zero = ", ".join(f"coalesce(dup_chars_{n}, 0)::bigint as dup_chars_{n}" for n in rules.ngram_limits)
    return rf"""
with words as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos from (select doc_id, {WORDS} as ws from documents)),
 grams as (select doc_id, pos, w, {grams} from words window p as (partition by doc_id order by pos)),
 flags as (select doc_id, pos, w, {flags}, {twice} from grams),
 spread as (select doc_id, w, max(twice::int) over (partition by doc_id order by pos rows between {rules.window - 1} preceding and current row) as rep, {spread} from flags),
 per as (select doc_id, count(*) as n_words, sum(length(w))::bigint as word_chars, sum(rep)::bigint as n_repeat_words, {sums} from spread group by doc_id),
 lines as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
 marked as (select doc_id, l, row_number() over (partition by doc_id, l order by pos) > 1 as dup from lines where regexp_matches(l, '[^\x20\x09-\x0D]')),
 by_line as (select doc_id, sum(dup::int)::bigint as n_dup_lines, sum(length(l))::bigint as line_chars, sum(case when dup then length(l) else 0 end)::bigint as dup_line_chars from marked group by doc_id),
 base as (select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
   length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
   coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(line_chars, 0)::bigint as line_chars, coalesce(dup_line_chars, 0)::bigint as dup_line_chars, {zero}
  from documents d left join per using (doc_id) left join by_line using (doc_id)),
 judged as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.window_percent} * n_words as base_failed from base)
select *, not base_failed and not ({checks}) as kept from judged"""


QUERIES = {"op2_html_extraction": op2_html_extraction, "op6_token_counts": op6_token_counts, "op8_sentencepiece": op8_sentencepiece, "op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": _quality_sql()}
