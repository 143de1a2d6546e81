"""Registry of the subpackage's queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Module of each query, by name.
MODULES = {
    "p1_found": "encoding", "p1_restored": "encoding",
    "p2_found": "answers", "p2_by_model": "answers",
    "p3_found": "cuts", "p3_shares": "cuts",
    "p4_found": "refine", "p4_collapsed": "refine",
    "p5_found": "confusables", "p5_forms": "confusables", "p5_classes": "confusables",
    "p6_found": "langs", "p6_labels": "langs", "p6_segments": "langs",
    "p7_ids": "bpe",
    "p8_found": "leaks", "p8_spans": "leaks", "p8_items": "leaks",
    "p9_found": "subjects", "p9_make_up": "subjects",
}

#: DuckDB SQL of the queries that SQL can express.
_BARE = r"replace(replace(lower(regexp_replace(coalesce({c},''), '[\s\p{{Z}}\x{{85}}\p{{P}}$+<=>^`|~]+', '', 'g')), 'ß', 'ss'), 'ς', 'σ')"
_SETS = f"n AS (SELECT row_id, {_BARE.format(c='src')} AS a, {_BARE.format(c='tgt')} AS b FROM gold_annotations), k AS (SELECT row_id, least(a,b) AS x, greatest(a,b) AS y FROM n WHERE a <> '' OR b <> ''), m AS (SELECT row_id, min(row_id) OVER (PARTITION BY x, y) AS first_id, count(*) OVER (PARTITION BY x, y) AS copies FROM k)"
_WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
ORACLE: dict[str, str] = {
    "p4_found": f"WITH {_SETS} SELECT first_id AS row_id_a, row_id AS row_id_b FROM m WHERE row_id <> first_id",
    "p4_collapsed": f"WITH {_SETS} SELECT g.row_id, coalesce(m.copies, 1) AS copies FROM gold_annotations g LEFT JOIN m USING (row_id) WHERE m.row_id IS NULL OR m.row_id = m.first_id",
    "p8_found": f"""WITH i AS (SELECT item_id, text, regexp_extract(text, '(?s)^([^:.!?…]*:)', 1) AS h FROM benchmark_items WHERE text IS NOT NULL),
c AS (SELECT h FROM i WHERE h <> '' GROUP BY h HAVING count(DISTINCT substr(text, length(h) + 1)) >= 2),
w AS (SELECT item_id, {_WORDS.format(c="CASE WHEN h IN (SELECT h FROM c) THEN substr(text, length(h) + 1) ELSE text END")} AS w FROM i),
g AS (SELECT DISTINCT item_id, array_to_string(w[j:j+9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS j FROM w)),
d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT doc_id, array_to_string(w[j:j+9], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS j FROM d))
SELECT DISTINCT doc_id, item_id FROM e JOIN g USING (p)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"inkwell.llm.{module}"), name) for name, module in MODULES.items()}
