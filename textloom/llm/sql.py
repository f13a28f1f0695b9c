"""SQL of those queries of this subpackage that SQL can express."""

from __future__ import annotations

_REMARKS = r"'\[[^\[\]]*\]|\([^()]*\)'"


def _grams(table: str, key: str) -> str:
    text = "text"
    for _ in range(3):
        text = f"regexp_replace({text}, {_REMARKS}, ' ', 'g')"
    return rf"""
  SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS gram
  FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 11)) AS i
        FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {table}) WHERE len(w) >= 12)"""


_P7 = f"""
WITH d AS ({_grams('documents', 'doc_id')}), e AS ({_grams('eval_items', 'item_id')})
SELECT DISTINCT d.doc_id, e.item_id FROM d JOIN e USING (gram)
"""


def oracle_sql() -> dict[str, str]:
    return {"p7_found": _P7, "p7_items": f"SELECT item_id, count(*) AS documents FROM ({_P7}) GROUP BY 1"}
