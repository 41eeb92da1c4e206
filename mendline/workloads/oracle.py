"""The same results in plain SQL, for a check in a second engine.

The source and target tables are common table expressions, defined here
independently of the DataFrame code.
"""

from __future__ import annotations

from . import retail

COLUMNS = "sale_id, line_no, sale_ts, customer, product, amount, period"

S = """
S AS (
  SELECT l.l_orderkey AS sale_id, l.l_linenumber AS line_no, l.l_shipdate AS sale_ts,
         coalesce(c.c_name, '') AS customer, coalesce(p.p_name, '') AS product,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount,
         strftime(l.l_shipdate, '%Y-%m') AS period
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
)"""

T = """
T AS (
  SELECT sale_id, line_no, sale_ts,
         CASE WHEN month(sale_ts) = 2 THEN 'X' ELSE customer END AS customer, product,
         CASE WHEN month(sale_ts) = 7 AND sale_id % 5 = 0
              THEN CAST(amount + 1 AS DECIMAL(18,2)) ELSE amount END AS amount, period
  FROM S
  WHERE month(sale_ts) <> 4 AND NOT (month(sale_ts) = 10 AND line_no = 1)
  UNION ALL
  SELECT sale_id, line_no, sale_ts, customer, product, amount, '1994-12' FROM S
  WHERE period = '1995-01'
)"""

K = """
K AS (
  SELECT o.o_orderkey AS sale_id, 1 AS line_no, o.o_orderdate AS sale_ts,
         coalesce(c.c_name, '') AS customer, coalesce(o.o_orderpriority, '') AS product,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount,
         strftime(o.o_orderdate, '%Y-%m') AS period
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""

P = f"""
ranked AS (
  SELECT *, md5('7|' || sale_id) AS mark,
         row_number() OVER (PARTITION BY period ORDER BY md5('7|' || sale_id), sale_id) AS place,
         count(*) OVER (PARTITION BY period) AS n
  FROM K
),
P AS (
  SELECT sale_id, line_no, sale_ts, customer, product,
         CASE WHEN period = '{retail.PERTURBED_PERIOD}' AND place <= greatest(1, n // 5)
              THEN CAST(amount * (CAST(0.5 AS DECIMAL(4,3))
                     + CAST(('0x' || substr(mark, 25, 8))::BIGINT % 1000 AS DECIMAL(4,0))
                       * CAST(0.001 AS DECIMAL(4,3))) AS DECIMAL(18,2))
              ELSE amount END AS amount,
         period
  FROM ranked
)"""


def _headers(name: str, table: str, digest: str = "md5") -> str:
    return f"""
{name} AS (
  SELECT period, row_count, amount_sum,
         {digest}(CAST(amount_sum AS VARCHAR) || '|' || CAST(row_count AS VARCHAR)) AS block_hash
  FROM (SELECT period, count(*) AS row_count, CAST(sum(amount) AS DECIMAL(28,2)) AS amount_sum
        FROM {table} GROUP BY period)
)"""


_FIELDS = ("sale_id", "line_no", "strftime(sale_ts, '%Y-%m-%d %H:%M:%S.%f')", "customer", "product", "amount")
_MARK = "md5(" + " || '|' || ".join(
    f"coalesce(length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in _FIELDS
) + ")"


def _content(name: str, table: str) -> str:
    number = lambda first: f"CAST(sum(('0x' || substr(mark, {first}, 15))::BIGINT) AS VARCHAR)"
    return f"""
{name} AS (
  SELECT period, count(*) AS row_count, CAST(sum(amount) AS DECIMAL(28,2)) AS amount_sum,
         md5({number(1)} || '|' || {number(17)} || '|' || CAST(count(*) AS VARCHAR)) AS block_hash
  FROM (SELECT *, {_MARK} AS mark FROM {table}) GROUP BY period
)"""


def _leaves(name: str, table: str) -> str:
    """Leaves with all their rows, as one text."""
    return f"""
{name} AS (
  SELECT period, strftime(sale_ts, '%Y-%m-%d') AS day,
         CAST(('0x' || substr(md5(CAST(sale_id AS VARCHAR)), 1, 8))::BIGINT % 16 AS INTEGER) AS bucket,
         count(*) AS n, string_agg({_MARK}, ',' ORDER BY {_MARK}) AS rows
  FROM {table} GROUP BY ALL
)"""


HS = _headers("HS", "S")
HT = _headers("HT", "T")


def _plan(source: str, target: str, name: str = "plan") -> str:
    return f"""
{name} AS (
  SELECT s.period,
         CASE WHEN t.period IS NULL THEN 'INSERT'
              WHEN s.block_hash = t.block_hash THEN 'SKIP' ELSE 'REPAIR' END AS action,
         s.block_hash AS source_hash, t.block_hash AS target_hash_before, s.row_count
  FROM {source} s LEFT JOIN {target} t ON s.period = t.period
)"""


PLAN = _plan("HS", "HT")
RESULTS = """
results AS (
  SELECT period, action, source_hash, target_hash_before, row_count AS rows_processed,
         CASE WHEN action = 'SKIP' THEN 0 ELSE row_count END AS rows_inserted,
         CASE action WHEN 'INSERT' THEN 'new: ' || row_count || ' rows copied'
                     WHEN 'SKIP' THEN 'unchanged'
                     ELSE 'differed: replaced by ' || row_count || ' rows' END AS message,
         false AS failed
  FROM plan
)"""
SYNCED = f"""
synced AS (
  SELECT {COLUMNS} FROM T WHERE period NOT IN (SELECT period FROM plan WHERE action <> 'SKIP')
  UNION ALL
  SELECT {COLUMNS} FROM S WHERE period IN (SELECT period FROM plan WHERE action <> 'SKIP')
)"""
COMPARISON = """
comparison AS (
  SELECT s.period,
         CASE WHEN t.period IS NULL THEN 'MISSING_IN_TARGET'
              WHEN s.block_hash = t.block_hash THEN 'IN_SYNC' ELSE 'CORRUPT' END AS state,
         s.block_hash AS source_hash, s.row_count AS source_rows, s.amount_sum AS source_amount,
         t.block_hash AS target_hash, t.row_count AS target_rows, t.amount_sum AS target_amount
  FROM HS s LEFT JOIN HT t ON s.period = t.period
)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select.strip()


def _statistics(table: str) -> str:
    return f"""
SELECT count(*) AS total_rows, count(DISTINCT period) AS total_blocks,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(28,2)) AS amount_total,
       CASE WHEN count(*) > 0
            THEN CAST(CAST(sum(amount) AS DECIMAL(28,2)) AS DOUBLE) / count(*)
            ELSE CAST(0 AS DOUBLE) END AS amount_avg,
       CAST(coalesce(min(amount), 0) AS DECIMAL(18,2)) AS amount_min,
       CAST(coalesce(max(amount), 0) AS DECIMAL(18,2)) AS amount_max,
       min(sale_ts) AS first_date, max(sale_ts) AS last_date,
       coalesce(CAST(arg_min(sale_id, ROW(sale_ts, sale_id, line_no)) AS VARCHAR), '') AS first_id,
       coalesce(CAST(arg_max(sale_id, ROW(sale_ts, sale_id, line_no)) AS VARCHAR), '') AS last_id,
       count(DISTINCT customer) AS distinct_customers,
       count(DISTINCT product) AS distinct_products
FROM {table}"""


STATISTICS = (
    "total_rows total_blocks amount_total amount_avg amount_min amount_max first_date last_date "
    "first_id last_id distinct_customers distinct_products"
).split()


def _top(table: str) -> str:
    return f"""
(SELECT string_agg(period || ':' || row_count || ':' || amount_sum || ':' || block_hash, ',' ORDER BY row_count DESC, period)
 FROM (SELECT * FROM {table} ORDER BY row_count DESC, period LIMIT 10))"""


def _info(side: str, table: str) -> str:
    return f"""
SELECT '{side}' AS side, CAST(sum(row_count) AS BIGINT) AS rows, count(*) AS blocks,
       string_agg(period, ',' ORDER BY period) AS periods
FROM {table}"""


def _state(source: str, target: str) -> str:
    return f"""
CASE WHEN (SELECT count(*) FROM {target}) = 0 THEN 'NEVER_SYNCED'
     WHEN (SELECT count(*) FROM {source}) <> (SELECT count(*) FROM {target}) THEN 'OUT_OF_SYNC'
     WHEN NOT EXISTS (SELECT 1 FROM {source} s LEFT JOIN {target} t ON s.period = t.period
                      WHERE s.block_hash IS DISTINCT FROM t.block_hash) THEN 'IN_SYNC'
     ELSE 'PARTIALLY_SYNCED' END"""


def _json_info(side: str) -> str:
    return (
        f"""'{{"hash":"' || {side}_hash || '","rows":' || {side}_rows"""
        f""" || ',"amount":' || {side}_amount || '}}'"""
    )


PLAN_COLUMNS = "period, action, source_hash, target_hash_before, row_count"


ORACLE: dict[str, str] = {
    "scan_source": _with(S, select=f"SELECT {COLUMNS} FROM S"),
    "scan_target": _with(S, T, select=f"SELECT {COLUMNS} FROM T"),
    "fetch_source_block": _with(S, select=f"SELECT {COLUMNS} FROM S WHERE period = '1997-03'"),
    "fetch_target_block": _with(S, T, select=f"SELECT {COLUMNS} FROM T WHERE period = '1994-12'"),
    "fetch_changed_blocks": _with(
        S, T, HS, HT, PLAN,
        select=f"""
SELECT {COLUMNS} FROM S WHERE period IN (SELECT period FROM plan WHERE action <> 'SKIP')""",
    ),
    "insert_block": _with(
        S, T,
        select=f"SELECT {COLUMNS} FROM T UNION ALL SELECT {COLUMNS} FROM S WHERE period = '1997-04'",
    ),
    "delete_block": _with(S, T, select=f"SELECT {COLUMNS} FROM T WHERE period <> '1997-05'"),
    "replace_block": _with(
        S, T,
        select=f"""
SELECT {COLUMNS} FROM T WHERE period <> '1997-07'
UNION ALL SELECT {COLUMNS} FROM S WHERE period = '1997-07'""",
    ),
    "clear_target": _with(
        S, T,
        select="SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM T",
    ),
    "period_of_sale": _with(S, select="SELECT sale_id, line_no, sale_ts, period FROM S"),
    "period_requests": f"""
SELECT request_id, year, month,
       CASE WHEN year IS NOT NULL AND month IS NOT NULL THEN printf('%04d-%02d', year, month) END AS period,
       CASE WHEN year IS NULL OR month IS NULL THEN 'a period needs a year and a month'
            WHEN month NOT BETWEEN 1 AND 12 THEN 'no such month: give 1 to 12'
            WHEN year NOT BETWEEN 2020 AND {retail.CURRENT_YEAR}
            THEN 'no data for that year: give 2020 to {retail.CURRENT_YEAR}' END AS problem
FROM (SELECT o_orderkey AS request_id,
             CASE WHEN o_orderkey % 23 <> 0 THEN CAST(year(o_orderdate) + 22 AS INTEGER) END AS year,
             CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_orderkey % 15 AS INTEGER) END AS month FROM orders)""",
    "headers_source": _with(S, HS, select="SELECT * FROM HS"),
    "headers_target": _with(S, T, HT, select="SELECT * FROM HT"),
    "headers_of_files": _with(S, T, HT, select="SELECT * FROM HT"),
    "files_between": _with(
        S, T,
        select=f"SELECT {COLUMNS} FROM T WHERE sale_ts >= TIMESTAMP '1995-01-20' AND sale_ts < TIMESTAMP '1995-02-24'",
    ),
    "headers_streamed": _with(S, HS, select="SELECT * FROM HS"),
    "headers_sha256": _with(S, _headers("H2", "S", "sha256"), select="SELECT * FROM H2"),
    "header_equality": _with(
        S, T, HS, HT,
        select="""
SELECT s.period, s.block_hash AS source_hash, t.block_hash AS target_hash,
       coalesce(s.block_hash = t.block_hash, false) AS same
FROM HS s LEFT JOIN HT t ON s.period = t.period""",
    ),
    "sync_plan": _with(S, T, HS, HT, PLAN, select=f"SELECT {PLAN_COLUMNS} FROM plan"),
    "first_load_plan": _with(
        S, HS,
        select="""
SELECT period, 'INSERT' AS action, block_hash AS source_hash,
       CAST(NULL AS VARCHAR) AS target_hash_before, row_count FROM HS""",
    ),
    "block_results": _with(S, T, HS, HT, PLAN, RESULTS, select="SELECT * FROM results"),
    "sync_report": _with(
        S, T, HS, HT, PLAN, RESULTS,
        select="""
SELECT count(*) AS total_blocks, count(*) FILTER (action = 'SKIP') AS skipped,
       count(*) FILTER (action = 'INSERT') AS inserted,
       count(*) FILTER (action = 'REPAIR') AS repaired,
       CAST(sum(rows_processed) AS BIGINT) AS rows_processed,
       CAST(sum(rows_inserted) AS BIGINT) AS rows_inserted
FROM results""",
    ),
    "report_head": _with(
        S, T, HS, HT, PLAN, RESULTS,
        select="""
SELECT 1 AS line_no, 'blocks compared: ' || format('{:,}', count(*)) AS line FROM results
UNION ALL SELECT 2, 'unchanged: ' || format('{:,}', count(*) FILTER (action = 'SKIP')) FROM results
UNION ALL SELECT 3, 'new: ' || format('{:,}', count(*) FILTER (action = 'INSERT')) FROM results
UNION ALL SELECT 4, 'replaced: ' || format('{:,}', count(*) FILTER (action = 'REPAIR')) FROM results
UNION ALL SELECT 5, 'rows looked at: ' || format('{:,}', CAST(sum(rows_processed) AS BIGINT)) FROM results
UNION ALL SELECT 6, 'rows copied: ' || format('{:,}', CAST(sum(rows_inserted) AS BIGINT)) FROM results""",
    ),
    "report_lines": _with(
        S, T, HS, HT, PLAN, RESULTS,
        select="""
SELECT period, printf('%s | %-6s | %5d rows', period, action, rows_processed) AS line
FROM results ORDER BY period""",
    ),
    "sync_document": _with(
        S, T, HS, HT, PLAN, RESULTS,
        select="""
SELECT count(*) AS total_blocks,
       '{"total_blocks":' || count(*) || ',"skipped":' || count(*) FILTER (action = 'SKIP') ||
       ',"inserted":' || count(*) FILTER (action = 'INSERT') ||
       ',"repaired":' || count(*) FILTER (action = 'REPAIR') ||
       ',"rows_processed":' || sum(rows_processed) || ',"rows_inserted":' || sum(rows_inserted) ||
       ',"details":[' || string_agg(
         '{"period":"' || period || '","action":"' || action ||
         '","source_hash":"' || source_hash || '","target_hash_before":' ||
         coalesce('"' || target_hash_before || '"', 'null') ||
         ',"rows_processed":' || rows_processed || ',"rows_inserted":' || rows_inserted ||
         ',"message":"' || message || '","failed":' || failed || '}', ',' ORDER BY period) ||
       ']}' AS document
FROM results""",
    ),
    "sync_apply": _with(S, T, HS, HT, PLAN, SYNCED, select=f"SELECT {COLUMNS} FROM synced"),
    "sync_results": _with(S, T, HS, HT, PLAN, RESULTS, select="SELECT * FROM results"),
    "sync_history": _with(
        S, T, HS, HT, PLAN, RESULTS,
        select="""
SELECT CAST(1 AS BIGINT) AS run, * FROM results
UNION ALL
SELECT CAST(2 AS BIGINT), period, 'SKIP', source_hash, source_hash, rows_processed, 0, 'unchanged', false FROM results""",
    ),
    "repair_delta": _with(
        S, T, HS, HT, PLAN,
        select=f"""
SELECT {COLUMNS}, CAST(sum(side) AS BIGINT) AS copies
FROM (SELECT {COLUMNS}, 1 AS side FROM S UNION ALL SELECT {COLUMNS}, -1 AS side FROM T)
WHERE period IN (SELECT period FROM plan WHERE action = 'REPAIR')
GROUP BY {COLUMNS} HAVING sum(side) <> 0""",
    ),
    "sync_patch": _with(S, T, HS, HT, PLAN, SYNCED, select=f"SELECT {COLUMNS} FROM synced"),
    "file_patch": _with(S, T, HS, HT, PLAN, SYNCED, select=f"SELECT {COLUMNS} FROM synced"),
    "sync_merge": _with(S, T, HS, HT, PLAN, SYNCED, select=f"SELECT {COLUMNS} FROM synced"),
    "resync_plan": _with(
        S, T, HS, HT, PLAN, SYNCED, _headers("HN", "synced"), _plan("HS", "HN", "again"),
        select=f"SELECT {PLAN_COLUMNS} FROM again",
    ),
    "reset_then_plan": _with(
        S, HS,
        select="""
SELECT period, 'INSERT' AS action, block_hash AS source_hash,
       CAST(NULL AS VARCHAR) AS target_hash_before, row_count FROM HS""",
    ),
    "snapshot_reset": _with(
        S, HS,
        select="""
SELECT period, 'INSERT' AS action, block_hash AS source_hash,
       CAST(NULL AS VARCHAR) AS target_hash_before, row_count FROM HS""",
    ),
    "headers_content": _with(S, _content("CS", "S"), select="SELECT * FROM CS"),
    "headers_added": _with(S, _content("CS", "S"), select="SELECT * FROM CS"),
    "content_plan": _with(S, T, _content("CS", "S"), _content("CT", "T"), _plan("CS", "CT"), select=f"SELECT {PLAN_COLUMNS} FROM plan"),
    "tree_leaves": _with(S, T, _leaves("LS", "S"), _leaves("LT", "T"), select="""
SELECT coalesce(s.period, t.period) AS period, coalesce(s.day, t.day) AS day, coalesce(s.bucket, t.bucket) AS bucket,
       coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows
FROM LS s FULL JOIN LT t ON s.period = t.period AND s.day = t.day AND s.bucket = t.bucket
WHERE s.rows IS DISTINCT FROM t.rows AND coalesce(s.period, t.period) IN (SELECT period FROM S)"""),
    "tree_mend": _with(S, T, select=f"SELECT {COLUMNS} FROM S UNION ALL SELECT {COLUMNS} FROM T WHERE period NOT IN (SELECT period FROM S)"),
    "overlapping_syncs": _with(S, T, HS, HT, PLAN, SYNCED, select=f"SELECT {COLUMNS} FROM synced"),
    "snapshot_sync": _with(
        S, T, HS, HT, PLAN, SYNCED,
        """versions AS (
  SELECT 1 AS version, 'append' AS kind, period, amount FROM T
  UNION ALL SELECT 2, 'replace', period, amount FROM synced
  UNION ALL SELECT 4, 'restore', period, amount FROM synced)""",
        select="""SELECT v.version::BIGINT AS version, v.kind, count(s.period) AS rows, count(DISTINCT s.period) AS blocks,
  CAST(coalesce(sum(s.amount), 0) AS DECIMAL(28,2)) AS amount_sum
FROM (VALUES (1, 'append'), (2, 'replace'), (3, 'clear'), (4, 'restore')) v(version, kind)
LEFT JOIN versions s ON s.version = v.version GROUP BY v.version, v.kind""",
    ),
    "failed_blocks": _with(
        S, T, HS, HT, PLAN, RESULTS,
        select="""
SELECT period, action, period = '1998-07' AS failed,
       CASE WHEN period = '1998-07' THEN 0 ELSE rows_processed END AS rows_processed,
       CASE WHEN period = '1998-07' THEN 0 ELSE rows_inserted END AS rows_inserted
FROM results""",
    ),
    "system_info": _with(
        S, T, HS, HT, select=_info("source", "HS") + "\nUNION ALL" + _info("target", "HT")
    ),
    "system_status": _with(
        S, T, HS, HT,
        "I AS (" + _info("source", "HS") + ")",
        "J AS (" + _info("target", "HT") + ")",
        select=f"""
SELECT I.rows AS source_rows, I.blocks AS source_blocks, I.periods AS source_periods,
       J.rows AS target_rows, J.blocks AS target_blocks, J.periods AS target_periods,
       {_state("HS", "HT")} AS state
FROM I, J""",
    ),
    "hash_comparison": _with(
        S, T, HS, HT, COMPARISON, select="SELECT * FROM comparison ORDER BY period"
    ),
    "comparison_summary": _with(
        S, T, HS, HT, COMPARISON,
        select="""
SELECT count(*) AS total_periods, count(*) FILTER (state = 'IN_SYNC') AS in_sync,
       count(*) FILTER (state = 'MISSING_IN_TARGET') AS missing_in_target,
       count(*) FILTER (state = 'CORRUPT') AS corrupt
FROM comparison""",
    ),
    "comparison_json": _with(
        S, T, HS, HT, COMPARISON,
        select=f"""
SELECT period, '{{"period":"' || period || '","state":"' || state || '","source":' ||
       {_json_info("source")} || ',"target":' ||
       CASE WHEN target_hash IS NULL THEN 'null' ELSE {_json_info("target")} END || '}}' AS document
FROM comparison""",
    ),
    "stats_source": _with(S, select=_statistics("S")),
    "stats_target": _with(S, T, select=_statistics("T")),
    "stats_first_last": _with(
        S,
        select="""
SELECT CAST(arg_min(sale_id, ROW(sale_ts, sale_id, line_no)) AS VARCHAR) AS first_id,
       CAST(arg_max(sale_id, ROW(sale_ts, sale_id, line_no)) AS VARCHAR) AS last_id FROM S""",
    ),
    "stats_empty": _with(
        S, "N AS (SELECT * FROM S WHERE period = '1890-01')", select=_statistics("N")
    ),
    "stats_summary": _with(
        S, T,
        select="""
SELECT 'Source holds ' || format('{:,}', (SELECT count(*) FROM S)) || ' rows in ' ||
       (SELECT count(DISTINCT period) FROM S) || ' blocks, target holds ' ||
       format('{:,}', (SELECT count(*) FROM T)) || ' rows; source has ' ||
       format('{:,}', (SELECT count(DISTINCT customer) FROM S)) || ' distinct customers and ' ||
       format('{:,}', (SELECT count(DISTINCT product) FROM S)) || ' distinct products.' AS summary""",
    ),
    "thousands_per_block": _with(
        S, HS, select="SELECT period, format('{:,}', row_count) AS row_count_text FROM HS"
    ),
    "top_periods": _with(
        S, HS, select="SELECT * FROM HS ORDER BY row_count DESC, period LIMIT 10"
    ),
    "top_periods_of_both": _with(
        S, T, HS, HT,
        select="""
SELECT 'source' AS side, * FROM (SELECT * FROM HS ORDER BY row_count DESC, period LIMIT 10)
UNION ALL
SELECT 'target' AS side, * FROM (SELECT * FROM HT ORDER BY row_count DESC, period LIMIT 10)""",
    ),
    "diagnostics": _with(
        S, T,
        "A AS (" + _statistics("S") + ")",
        "B AS (" + _statistics("T") + ")",
        select="SELECT 'source' AS side, * FROM A UNION ALL SELECT 'target' AS side, * FROM B",
    ),
    "diagnostics_document": _with(
        S, T, HS, HT,
        "A AS (" + _statistics("S") + ")",
        "B AS (" + _statistics("T") + ")",
        """
picked AS (
  SELECT * FROM S ORDER BY md5('7|' || CAST(S.sale_id AS VARCHAR)), S.sale_id, amount, customer,
         line_no, period, product, sale_ts LIMIT 10
)""",
        select="SELECT " + ", ".join(f"{t}.{c} AS {side}_{c}" for t, side in (("A", "source"), ("B", "target")) for c in STATISTICS)
        + f""", {_top("HS")} AS source_top, {_top("HT")} AS target_top,
(SELECT string_agg(sale_id || ':' || customer || ':' || product || ':' || amount || ':' || period, ','
                   ORDER BY CAST(sale_id AS VARCHAR), sale_ts, customer, product, amount) FROM picked) AS sample,
'Source holds ' || format('{{:,}}', A.total_rows) || ' rows in ' || A.total_blocks || ' blocks, target holds ' ||
format('{{:,}}', B.total_rows) || ' rows; source has ' || format('{{:,}}', A.distinct_customers) ||
' distinct customers and ' || format('{{:,}}', A.distinct_products) || ' distinct products.' AS summary
FROM A, B""",
    ),
    "sample_records": _with(
        K,
        select="""
SELECT CAST(sale_id AS VARCHAR) AS sale_id, sale_ts, customer, product, amount, period
FROM K ORDER BY md5('7|' || CAST(K.sale_id AS VARCHAR)), K.sale_id LIMIT 10""",
    ),
    "sample_repeated_keys": _with(
        S,
        select=f"""
SELECT {COLUMNS} FROM S ORDER BY md5('7|' || CAST(S.sale_id AS VARCHAR)), S.sale_id, amount, customer,
       line_no, period, product, sale_ts LIMIT 12""",
    ),
    "perturb_repair": _with(
        K, P, _headers("HK", "K"), _headers("HP", "P"), _plan("HK", "HP"),
        select="""
SELECT period, action AS action_before, CASE WHEN action = 'SKIP' THEN 0 ELSE row_count END AS rows_inserted,
       false AS failed, 'SKIP' AS action_after FROM plan""",
    ),
    "perturb_block": _with(K, P, select=f"SELECT {COLUMNS} FROM P"),
    "perturb_plan": _with(
        K, P, _headers("HK", "K"), _headers("HP", "P"), _plan("HK", "HP"),
        select=f"SELECT {PLAN_COLUMNS} FROM plan",
    ),
    "perturb_status": _with(
        K, P, _headers("HK", "K"), _headers("HP", "P"),
        select=f"""
SELECT (SELECT count(*) FROM HK) AS source_blocks, (SELECT count(*) FROM HP) AS target_blocks,
       {_state("HK", "HP")} AS state""",
    ),
}
ORACLE["reconciled_delta"] = ORACLE["repair_delta"]
