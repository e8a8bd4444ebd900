"""The bindings as SQL text, for checks in another engine."""
from __future__ import annotations

import re

# Each entry: view name -> SELECT text. A view may use the views above it.
VIEWS: dict[str, str] = {
    "samples": r"""
  SELECT user_id AS record_id, user_id // 2 AS cluster_id, CAST(user_id % 12 AS INTEGER) AS site,
         i // 10 AS seg_idx, i % 10 AS sample_idx, x, y, event_type, ts
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
               CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE value END AS x,
               CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS y
        FROM events)""",
    "segments": """
  SELECT record_id, cluster_id, site, seg_idx, count(*) AS n,
         CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') >= 3 THEN 1 ELSE 0 END AS target,
         avg(y) / 100 AS score, avg(CASE WHEN x = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS missing_fraction,
         avg(x) AS x_mean, max(x) AS x_max, avg(y) AS y_mean,
         CAST(count(*) FILTER (WHERE x > 100) AS DOUBLE) AS n_high
  FROM samples GROUP BY ALL""",
    "predictions": """
  SELECT l_orderkey AS record_id, o_custkey AS cluster_id, c_nationkey AS site,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS seg_idx,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target, l_quantity / 50 AS m1, l_discount * 10 AS m2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "preds": """
  SELECT record_id, cluster_id, site, seg_idx, target, 'm1' AS model, m1 AS score FROM predictions
  UNION ALL
  SELECT record_id, cluster_id, site, seg_idx, target, 'm2' AS model, m2 AS score FROM predictions""",
    "records": """
  SELECT o_orderkey AS record_id, o_custkey AS cluster_id, c_nationkey AS site, any_abnormal, abnormal_fraction, n_segments,
         c_acctbal AS balance, o_totalprice AS price, o_orderdate AS order_date, o_orderpriority AS priority, o_orderstatus AS status_code
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_segments, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_abnormal,
                    avg(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS abnormal_fraction
             FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "doc_outcomes": """
  SELECT documents.doc_id AS record_id, source AS cluster_id, lang AS site, quality, toxic, n_chars, labels.doc_id AS label_id
  FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id""",
    "raw_files": """
  SELECT CAST(doc_id AS VARCHAR) AS id, 'documents' AS kind, text AS payload FROM documents
  UNION ALL SELECT CAST(page_id AS VARCHAR), 'pages', html FROM pages
  UNION ALL SELECT conv_id || '_' || turn, 'conversations', text FROM conversations""",
    "journal": """
  SELECT ts AS timestamp, user_id AS run, event_type AS event, value AS metric, event_id, props FROM events""",
}


def with_views(body: str) -> str:
    """Puts the views the text mentions, and those they need, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, select in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(select)

    visit(body)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    body = body.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\b", body):
        recursive = re.match(r"(?i)with\s+recursive\b", body)
        rest = re.sub(r"(?i)^with(\s+recursive)?\b", "", body, count=1)
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest.strip()}"
    recursive = any("RECURSIVE" in VIEWS[n] for n in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
