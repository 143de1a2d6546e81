"""All queries outside the llm subpackage, with the SQL that checks them."""

from __future__ import annotations

from inkwell.plans import q_answers, q_cascade, q_cost, q_more, q_pairs, q_quality, q_retrieval, q_risk, q_stream, q_text, q_votes  # noqa: F401  (they register)
from inkwell.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
