"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from trellis.llm import q_data, q_dedup, q_text

QUERIES = {**q_text.QUERIES, **q_data.QUERIES, **q_dedup.QUERIES}
ORACLE_SQL = {**q_text.ORACLE_SQL, **q_data.ORACLE_SQL, **q_dedup.ORACLE_SQL}
