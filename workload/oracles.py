"""DuckDB SQL for the registered queries, written on its own over the driver's tables."""

from __future__ import annotations

# ---- common table expressions ------------------------------------------------------------------

_PLACES = """
lines AS (
  SELECT l.*, p.p_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice, r.r_name
  FROM lineitem l
  JOIN part p ON p.p_partkey = l.l_partkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
)"""

_LEDGER = (
    _PLACES
    + """,
typed AS (
  SELECT *, CASE
    WHEN l_linenumber <= 4 AND l_returnflag = 'A' THEN 'RECEIVED'
    WHEN l_linenumber <= 4 AND l_returnflag = 'N' AND l_linestatus = 'F' THEN 'INVOICED'
    WHEN l_linenumber <= 4 AND l_returnflag = 'N' AND l_linestatus = 'O' THEN 'PICKED'
    WHEN l_linenumber <= 4 AND l_linestatus = 'F' THEN
      ['RETURNED', 'TRANSFERRED IN', 'TRANSFERRED OUT', 'DESPATCH CANCELLED'][l_linenumber]
    WHEN l_linenumber <= 4 AND l_linestatus = 'O' THEN
      ['STOCK ADJ IN - STOCK TAKE IN', 'STOCK ADJ OUT - STOCK TAKE OUT', 'ASN', 'STOCK ADJ IN - STOCK ADJUST- IN'][l_linenumber]
    WHEN l_returnflag = 'A' THEN 'RECEIPT'
    WHEN l_returnflag = 'N' THEN 'DESPATCH'
    WHEN l_linestatus = 'F' THEN ['RETURN', 'SALE STOCK', 'RTV'][l_linenumber - 4]
    WHEN l_linestatus = 'O' THEN ['STOCK ADJ IN', 'STOCK ADJ OUT', 'CANCELLED DESPATCH'][l_linenumber - 4]
    END AS mtype
  FROM lines
  WHERE l_linenumber BETWEEN 1 AND 7
),
signs AS (
  SELECT *, CASE WHEN mtype IN ('INVOICED', 'PICKED', 'TRANSFERRED OUT', 'DESPATCH', 'SALE STOCK', 'RTV')
                   OR mtype LIKE 'STOCK ADJ OUT%' THEN -1.0 ELSE 1.0 END::DOUBLE AS sgn
  FROM typed
),
mov AS (
  SELECT
    CASE WHEN l_linenumber <= 4 THEN l_partkey || '|' || p_size ELSE 'RM' || l_partkey END AS item_code,
    p_name AS item_description,
    r_name AS warehouse,
    l_shipdate AS movement_date,
    mtype AS movement_type,
    sgn * l_quantity * CASE WHEN l_orderkey % 499 = 0 THEN 40.0 ELSE 1.0 END::DOUBLE AS quantity,
    'D' || l_orderkey AS reference,
    l_orderkey::VARCHAR AS job,
    sgn * l_extendedprice AS value,
    CASE WHEN l_linenumber <= 4 THEN p_brand ELSE p_type END AS category,
    CASE WHEN l_linenumber <= 4 THEN 'fg_movements' ELSE 'rm_movements' END AS dataset,
    l_orderkey, l_partkey, p_retailprice,
    CASE
      WHEN mtype IN ('RECEIVED', 'TRANSFERRED IN', 'RETURNED', 'RECEIPT', 'RETURN') THEN 'receipt'
      WHEN mtype IN ('INVOICED', 'TRANSFERRED OUT', 'PICKED', 'DESPATCH CANCELLED', 'DESPATCH', 'SALE STOCK',
                     'RTV', 'CANCELLED DESPATCH') THEN 'issue'
      WHEN mtype LIKE 'STOCK ADJ%' THEN 'adjustment'
      ELSE 'other' END AS direction
  FROM signs
),
pos AS (
  SELECT *,
    CASE WHEN direction = 'issue' THEN -abs(quantity) ELSE quantity END AS signed_qty,
    CASE WHEN direction = 'issue' THEN -abs(value) ELSE value END AS signed_val
  FROM mov
)"""
)

_STOCK = (
    _PLACES
    + """,
fg_lots AS (
  SELECT 'fg_balance' AS dataset, l_partkey || '|' || p_size AS item_code, p_name AS item_description,
         r_name AS warehouse, l_quantity AS quantity, l_quantity * p_retailprice AS value, p_brand AS category
  FROM lines WHERE l_linenumber BETWEEN 1 AND 4
),
rm_lots AS (
  SELECT 'rm_balance' AS dataset, 'RM' || l_partkey AS item_code, p_name AS item_description,
         r_name AS warehouse, l_quantity AS quantity, l_quantity * p_retailprice AS value, p_type AS category
  FROM lines WHERE l_linenumber BETWEEN 5 AND 7
  AND (CASE WHEN l_partkey % 29 = 0 THEN 'Missing' WHEN l_partkey % 31 <> 0 THEN 'OK' END) IS DISTINCT FROM 'Missing'
),
jobs AS (
  SELECT 'wip_balance' AS dataset, 'DO-' || o_orderkey AS item_code, '' AS item_description,
         c_mktsegment AS warehouse, o_totalprice * (o_orderkey % 101)::DOUBLE * 0.01::DOUBLE AS quantity,
         o_totalprice AS value, o_orderpriority AS category, o_orderdate
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'
),
live AS (
  SELECT * FROM fg_lots UNION ALL SELECT * FROM rm_lots UNION ALL SELECT * EXCLUDE (o_orderdate) FROM jobs
)"""
)

_SNAPSHOTS = """
cuts AS (
  SELECT * FROM (VALUES (0, DATE '1998-01-01'), (1, DATE '1998-07-01'), (2, DATE '1999-01-01'), (3, DATE '1999-07-01'))
    AS t(i, day)
),
moved_before AS (
  SELECT dataset, item_code, item_description, warehouse, category, l_partkey, i, day, any_value(p_retailprice) AS price,
         sum(CASE WHEN movement_date < day THEN quantity ELSE 0 END) AS moved
  FROM mov CROSS JOIN cuts
  GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
),
ledger_snaps AS (
  SELECT replace(dataset, 'movements', 'balance') AS dataset, item_code, item_description, warehouse, category,
         l_partkey, i, day AS snapshot_date, day::TIMESTAMP AS balance_date,
         200.0::DOUBLE + moved
           + CASE WHEN l_partkey % 11 = 0 THEN -7.0 * i ELSE 0 END::DOUBLE
           + CASE WHEN l_partkey % 13 = 0 AND i = 1 THEN 320.0 ELSE 0 END::DOUBLE
           + CASE WHEN l_partkey % 17 = 0 AND i >= 1 THEN 100.0 ELSE 0 END::DOUBLE
           - CASE WHEN l_partkey % 17 = 0 AND i >= 2 THEN 30.0 ELSE 0 END::DOUBLE AS quantity,
         price
  FROM moved_before
),
snaps AS (SELECT * EXCLUDE (price), quantity * price AS value FROM ledger_snaps),
fg_snaps AS (SELECT * FROM snaps WHERE dataset = 'fg_balance'),
rm_snaps AS (SELECT * FROM snaps WHERE dataset = 'rm_balance'),
dated AS (SELECT * FROM snaps WHERE NOT (i = 2 AND l_partkey % 5 = 0))"""

_HISTORY = """
history AS (
  SELECT dataset, snapshot_date, quantity, value FROM snaps
  UNION ALL
  SELECT dataset, day, quantity, value FROM jobs JOIN cuts ON o_orderdate < day
)"""


def _money(expression: str) -> str:
    return f"CAST(sum(CAST({expression} AS DECIMAL(38, 9))) AS DOUBLE)"


_TOTALS = ", ".join(
    f"coalesce(sum({{amount}}) FILTER (direction = '{name}'), 0.0)::DOUBLE AS {name}"
    for name in ("receipt", "issue", "adjustment", "other")
)
_DAY = "strftime({}, '%Y-%m-%d')"
_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _summary(source: str, period: str, amount: str) -> str:
    return f"""
SELECT *, receipt + issue + adjustment + other AS net FROM (
  SELECT item_code, warehouse, {_TIME.format(f"date_trunc('{period}', movement_date)")} AS period,
         {_TOTALS.format(amount=amount)}
  FROM {source} GROUP BY 1, 2, 3)"""


def _reconcile(opening: str, moved: str, closing: str) -> str:
    """Full outer joins, and the description from the first leg that has one."""
    return f"""
o AS (SELECT item_code, warehouse, sum(quantity) AS q FROM ({opening}) GROUP BY 1, 2),
m AS (SELECT item_code, warehouse, sum(signed) AS q FROM ({moved}) GROUP BY 1, 2),
c AS (SELECT item_code, warehouse, sum(quantity) AS q FROM ({closing}) GROUP BY 1, 2),
o_desc AS (SELECT item_code, min(item_description) AS d FROM ({opening}) WHERE item_description <> '' GROUP BY 1),
c_desc AS (SELECT item_code, min(item_description) AS d FROM ({closing}) WHERE item_description <> '' GROUP BY 1),
m_desc AS (SELECT item_code, min(item_description) AS d FROM ({moved}) WHERE item_description <> '' GROUP BY 1),
rec AS (
  SELECT k.item_code, k.warehouse, coalesce(o.q, 0.0)::DOUBLE AS opening_qty, coalesce(m.q, 0.0)::DOUBLE AS net_movement,
         coalesce(c.q, 0.0)::DOUBLE AS closing_qty,
         coalesce(o.q, 0.0)::DOUBLE + coalesce(m.q, 0.0) AS expected_closing,
         coalesce(c.q, 0.0)::DOUBLE - (coalesce(o.q, 0.0) + coalesce(m.q, 0.0)) AS variance,
         abs(coalesce(c.q, 0.0) - (coalesce(o.q, 0.0) + coalesce(m.q, 0.0))) <= 0.5 AS within_tolerance,
         coalesce(o_desc.d, c_desc.d, m_desc.d, '') AS item_description
  FROM (SELECT item_code, warehouse FROM o UNION SELECT item_code, warehouse FROM m
        UNION SELECT item_code, warehouse FROM c) k
  LEFT JOIN o USING (item_code, warehouse) LEFT JOIN m USING (item_code, warehouse)
  LEFT JOIN c USING (item_code, warehouse)
  LEFT JOIN o_desc USING (item_code) LEFT JOIN c_desc USING (item_code) LEFT JOIN m_desc USING (item_code)
)"""


_KEPT = "NOT (movement_type = 'STOCK ADJ IN - STOCK ADJUST- IN' AND warehouse = 'AFRICA')"


def _moved(ledger: str, start: str, end: str, source: str = "mov", amount: str = "quantity", kept: str = _KEPT) -> str:
    return (
        f"SELECT item_code, warehouse, item_description, {amount} AS signed FROM {source} WHERE dataset = '{ledger}' "
        f"AND movement_date >= TIMESTAMP '{start}' AND movement_date < TIMESTAMP '{end}' AND {kept}"
    )


def _snap(table: str, i: int) -> str:
    return f"SELECT item_code, warehouse, item_description, quantity FROM {table} WHERE i = {i}"


def _asof(table: str, day: str, before: str) -> str:
    return (
        f"SELECT item_code, warehouse, item_description, quantity FROM {table} WHERE balance_date < TIMESTAMP '{before}' "
        f"AND balance_date <= TIMESTAMP '{day}' "
        "QUALIFY balance_date = max(balance_date) OVER (PARTITION BY item_code, warehouse)"
    )


_REC_SECOND = _reconcile(
    _snap("fg_snaps", 1), _moved("fg_movements", "1998-07-01", "1999-01-01"), _snap("fg_snaps", 2)
)


def _chain(table: str, ledger: str) -> str:
    """Pair by pair: each interval is its own reconciliation."""
    days = ["1998-01-01", "1998-07-01", "1999-01-01", "1999-07-01"]
    pairs = []
    for i, (start, end) in enumerate(zip(days, days[1:])):
        pair = _reconcile(_snap(table, i), _moved(ledger, start, end), _snap(table, i + 1))
        label = f"{start}->{end}".replace("-", "").replace(">", "->")
        pairs.append(f"SELECT *, {i + 1}::INTEGER AS \"interval\", '{label}' AS period FROM (WITH {pair} SELECT * FROM rec)")
    return "periods AS (" + " UNION ALL ".join(pairs) + ")"


_CLASSIFIED = """
classified AS (
  SELECT *, CASE WHEN gross_variance <= 0.5 THEN 'clean' WHEN abs(net_variance) <= 0.5 THEN 'timing'
                 WHEN abs(net_variance) >= gross_variance - 0.5 THEN 'persistent' ELSE 'mixed' END AS classification
  FROM (SELECT item_code, warehouse, coalesce(min(item_description) FILTER (item_description <> ''), '') AS item_description,
               sum(abs(variance)) AS gross_variance, sum(variance) AS net_variance,
               count(*) FILTER (abs(variance) > 0.5) AS periods_flagged
        FROM periods GROUP BY 1, 2)
)"""

_STATS = """
med AS (SELECT item_code, warehouse, median(quantity) AS median, count(*) AS n FROM mov GROUP BY 1, 2),
stats AS (
  SELECT item_code, warehouse, median, n,
         CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad ELSE 1.2533::DOUBLE * mean_dev END AS scale
  FROM (SELECT item_code, warehouse, any_value(med.median) AS median, any_value(n) AS n,
               median(abs(quantity - med.median)) AS mad, avg(abs(quantity - med.median)) AS mean_dev
        FROM mov JOIN med USING (item_code, warehouse) GROUP BY 1, 2)
),
far AS (
  SELECT mov.*, median, scale FROM mov JOIN stats USING (item_code, warehouse)
  WHERE n >= 5 AND scale > 0 AND abs(quantity - median) / scale > 3.0
)"""

_FINDINGS = (
    _STATS
    + """,
low AS (
  SELECT item_code, warehouse, max(balance_date) AS balance_date, sum(quantity) AS quantity
  FROM (SELECT * FROM dated QUALIFY balance_date = max(balance_date) OVER (PARTITION BY item_code, warehouse))
  GROUP BY 1, 2 HAVING sum(quantity) < 0
),
idle AS (
  SELECT item_code, warehouse, max(movement_date) AS last_move,
         floor(epoch(TIMESTAMP '2001-12-01' - max(movement_date)) / 86400)::BIGINT AS days
  FROM mov GROUP BY 1, 2
),
findings AS (
  SELECT 'negative_balance' AS kind, item_code, warehouse,
         format('balance {:.1f} on {}', quantity, strftime(balance_date, '%Y-%m-%d')) AS detail, quantity AS value FROM low
  UNION ALL
  SELECT 'outlier_movement', item_code, warehouse,
         format('{} of {:.1f} on {} (ref {}), typical {:.1f} (robust spread {:.1f})', movement_type, quantity,
                strftime(movement_date, '%Y-%m-%d'), reference, median, scale), quantity FROM far
  UNION ALL
  SELECT 'dormant_item', item_code, warehouse,
         format('no movement since {} ({} days as of 2001-12-01)', strftime(last_move, '%Y-%m-%d'), days), days::DOUBLE
  FROM idle WHERE days > 90
)"""
)

_FLOW = """
sized AS (
  SELECT *, abs(quantity) AS units, dataset = 'rm_movements' AS raw,
         CASE WHEN dataset = 'rm_movements' THEN 'RM · ' ELSE 'FG · ' END || warehouse AS store FROM mov
),
routed AS (
  SELECT *, CASE
    WHEN movement_type IN ('TRANSFERRED IN', 'TRANSFERRED OUT') THEN NULL
    WHEN movement_type = 'RECEIPT' THEN 'Vendors'
    WHEN movement_type = 'RECEIVED' THEN 'Production (DO/IC jobs)'
    WHEN movement_type IN ('DESPATCH', 'CANCELLED DESPATCH', 'RETURN', 'SALE STOCK', 'RTV', 'INVOICED', 'PICKED',
                           'RETURNED', 'DESPATCH CANCELLED') THEN store
    WHEN direction = 'adjustment' AND quantity > 0 THEN 'Adj in (' || CASE WHEN raw THEN 'RM' ELSE 'FG' END || ')'
    WHEN direction = 'adjustment' THEN store END AS source,
  CASE
    WHEN movement_type IN ('TRANSFERRED IN', 'TRANSFERRED OUT') THEN NULL
    WHEN movement_type IN ('RECEIPT', 'RECEIVED') THEN store
    WHEN movement_type IN ('DESPATCH', 'CANCELLED DESPATCH', 'RETURN') THEN 'Production (DO/IC jobs)'
    WHEN movement_type = 'SALE STOCK' THEN 'Direct sales (RM)'
    WHEN movement_type = 'RTV' THEN 'Returned to vendor'
    WHEN movement_type IN ('INVOICED', 'PICKED', 'RETURNED', 'DESPATCH CANCELLED') THEN 'Customers'
    WHEN direction = 'adjustment' AND quantity > 0 THEN store
    WHEN direction = 'adjustment' THEN 'Adj out (' || CASE WHEN raw THEN 'RM' ELSE 'FG' END || ')' END AS target,
  CASE
    WHEN movement_type IN ('TRANSFERRED IN', 'TRANSFERRED OUT') THEN NULL
    WHEN movement_type IN ('RETURN', 'RETURNED') THEN -1
    WHEN movement_type IN ('CANCELLED DESPATCH', 'DESPATCH CANCELLED') AND quantity > 0 THEN -1
    WHEN direction = 'other' THEN NULL ELSE 1 END AS sign
  FROM sized
),
edges AS (
  SELECT source, target, CAST(sum(CAST(abs(value) * sign AS DECIMAL(28, 6))) AS DOUBLE) AS weight, sum(units * sign) AS units
  FROM routed WHERE source IS NOT NULL GROUP BY 1, 2
),
netted AS (
  SELECT e.source, e.target, e.weight - coalesce(r.weight, 0) AS weight, e.units - coalesce(r.units, 0) AS units
  FROM edges e LEFT JOIN edges r ON r.source = e.target AND r.target = e.source
  WHERE r.source IS NULL OR e.source < e.target
),
links AS (
  SELECT CASE WHEN weight < 0 THEN target ELSE source END AS source,
         CASE WHEN weight < 0 THEN source ELSE target END AS target,
         round(abs(weight), 2) AS weight, round(abs(units), 1) AS units, 'value' AS measure
  FROM netted WHERE abs(weight) > 0.5
)"""


def _cube(source: str, top: int, name: str) -> str:
    cells = ", ".join(
        f"coalesce({total} FILTER (direction = '{direction}'), 0.0)::DOUBLE AS {letter}{measure}"
        for measure, total in (("u", "sum(signed_qty)"), ("v", "sum(CAST(signed_val AS DECIMAL(28, 6)))"))
        for letter, direction in (("r", "receipt"), ("i", "issue"), ("a", "adjustment"), ("o", "other"))
    )
    return f"""
{name}_top AS (
  SELECT category FROM {source} GROUP BY 1
  ORDER BY sum(CAST(abs(signed_val) AS DECIMAL(28, 6))) DESC, category LIMIT {top}
),
{name} AS (
  SELECT {_DAY.format('movement_date')} AS day,
         CASE WHEN category IN (SELECT category FROM {name}_top) THEN category ELSE 'Other' END AS category,
         {cells}
  FROM {source} GROUP BY 1, 2
)"""


_RAW = "raw AS (SELECT *, quantity AS signed_qty, value AS signed_val FROM mov)"
_FG_RAW = _RAW + ", fg_raw AS (SELECT * FROM raw WHERE dataset = 'fg_movements'), rm_raw AS (SELECT * FROM raw WHERE dataset = 'rm_movements')"
_BOTH_CUBES = (
    _FG_RAW + "," + _cube("fg_raw", 20, "fg_cube") + "," + _cube("rm_raw", 20, "rm_cube")
    + ", cube AS (SELECT *, 'fg' AS ledger FROM fg_cube UNION ALL SELECT *, 'rm' AS ledger FROM rm_cube)"
)

_POINTS = f"""
points AS (
  SELECT dataset, snapshot_date, sum(quantity)::DOUBLE AS quantity, {_money('value')} AS value, false AS live
  FROM (SELECT dataset, snapshot_date, CAST(quantity AS DECIMAL(28, 6)) AS quantity, value FROM history) GROUP BY 1, 2
  UNION ALL
  SELECT dataset, DATE '2001-12-01', sum(quantity)::DOUBLE, {_money('value')}, true
  FROM (SELECT dataset, CAST(quantity AS DECIMAL(28, 6)) AS quantity, value FROM live) GROUP BY 1
)"""

_CANONICAL = (
    "item_code, item_description, warehouse, " + _TIME.format("movement_date")
    + " AS movement_date, movement_type, quantity, reference, job, value, category"
)

_CATALOG = """
catalog AS (
  SELECT 's' || (t % 3) AS table_schema,
         ['Finished', 'RawMaterial', 'WIP', 'Fabric', 'Customer'][t % 5 + 1]
           || ['Trans', 'StockBalance', 'MovementHistory', 'SOH', 'Codes', 'Names', 'List'][(t // 5) % 7 + 1] || t AS table_name,
         ['ItemCode', 'Descr', 'Whse', 'TransDate', 'TransType', 'Qty', 'DocRef', 'AsAtDate', 'Store', 'Quantity', 'Notes']
           [(p_partkey * 7 + t) % 11 + 1] || p_size AS column_name,
         ['varchar', 'datetime', 'decimal(18,2)', 'date', 'int', 'timestamp_ntz', 'double', 'string'][p_size % 8 + 1] AS data_type,
         (p_partkey % 8 + 1)::INTEGER AS ordinal
  FROM (SELECT *, p_partkey // 8 AS t FROM part)
),
words AS (
  SELECT * FROM (VALUES
    ('fg_movements', 'kind', ['movement', 'movmnt', 'transaction', 'trans', 'history']),
    ('fg_movements', 'subject', ['finish', 'product', 'fg', 'garment']),
    ('rm_movements', 'kind', ['movement', 'movmnt', 'transaction', 'trans', 'history']),
    ('rm_movements', 'subject', ['raw', 'material', 'rm', 'fabric']),
    ('wip_balance', 'kind', ['balance', 'bal', 'soh', 'onhand', 'on_hand', 'stock']),
    ('wip_balance', 'subject', ['wip', 'progress', 'work']),
    ('fg_balance', 'kind', ['balance', 'bal', 'soh', 'onhand', 'on_hand', 'stock']),
    ('fg_balance', 'subject', ['finish', 'product', 'fg', 'garment']),
    ('rm_balance', 'kind', ['balance', 'bal', 'soh', 'onhand', 'on_hand', 'stock']),
    ('rm_balance', 'subject', ['raw', 'material', 'rm', 'fabric'])) AS w(dataset, part, list)
),
scores AS (
  SELECT table_schema, table_name, dataset,
         CASE WHEN min(hits) > 0 THEN sum(hits) ELSE 0 END::INTEGER AS score
  FROM (SELECT table_schema, table_name, dataset, part,
               len(list_filter(list, lambda w: contains(lower(table_name), w))) AS hits
        FROM (SELECT DISTINCT table_schema, table_name FROM catalog), words)
  GROUP BY 1, 2, 3
),
patterns AS (
  SELECT canonical, unnest(list) AS word, unnest(range(len(list))) AS place FROM (VALUES
    ('item_code', ['itemcode', 'item_code', 'stockcode', 'stock_code', 'itemno', 'item_no', 'sku', 'partno', 'code']),
    ('item_description', ['itemdesc', 'description', 'descr', 'itemname', 'item_name', 'desc']),
    ('warehouse', ['warehouse', 'whse', 'store', 'location', 'site', 'branch']),
    ('movement_date', ['movementdate', 'movement_date', 'transdate', 'trans_date', 'txndate', 'docdate', 'date']),
    ('movement_type', ['movementtype', 'movement_type', 'transtype', 'trans_type', 'txntype', 'doctype', 'type']),
    ('quantity', ['quantity', 'qty']),
    ('reference', ['reference', 'docref', 'docno', 'doc_no', 'document', 'refno', 'ref']),
    ('balance_date', ['balancedate', 'balance_date', 'asatdate', 'as_at', 'snapshotdate', 'perioddate', 'date'])
  ) AS p(canonical, list)
),
guesses AS (
  SELECT t.table_schema, t.table_name, t.canonical, g.column_name
  FROM (SELECT * FROM (SELECT DISTINCT table_schema, table_name FROM catalog), (SELECT DISTINCT canonical FROM patterns)) t
  LEFT JOIN (
    SELECT table_schema, table_name, canonical, column_name FROM catalog, patterns
    WHERE contains(lower(column_name), word)
      AND (canonical NOT IN ('movement_date', 'balance_date') OR data_type IN ('date', 'datetime', 'timestamp_ntz'))
      AND (canonical <> 'quantity' OR data_type IN ('int', 'double') OR data_type LIKE 'decimal%')
    QUALIFY row_number() OVER (PARTITION BY table_schema, table_name, canonical ORDER BY place, ordinal) = 1
  ) g USING (table_schema, table_name, canonical)
),
best AS (
  SELECT * FROM scores WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, table_schema, table_name) = 1
),
suggestions AS (
  SELECT b.dataset, b.table_schema, b.table_name, b.score, g.canonical, g.column_name
  FROM best b JOIN guesses g USING (table_schema, table_name)
  WHERE g.canonical IN ('item_code', 'item_description', 'warehouse', 'quantity')
     OR (b.dataset LIKE '%movements' AND g.canonical IN ('movement_date', 'movement_type', 'reference'))
     OR (b.dataset LIKE '%balance' AND g.canonical = 'balance_date')
  UNION ALL
  SELECT DISTINCT dataset, NULL, NULL, NULL::INTEGER, NULL, NULL FROM words WHERE dataset NOT IN (SELECT dataset FROM best)
)"""

_EXPORT = (
    _PLACES
    + """,
cells AS (
  SELECT coalesce(CASE WHEN l_orderkey % 19 <> 0 THEN l_partkey::VARCHAR END, '') AS style,
         coalesce(CASE WHEN l_orderkey % 19 <> 0 THEN p_size::VARCHAR END, '') AS size,
         month(l_shipdate) || '/' || day(l_shipdate) AS shipped,
         coalesce(CASE WHEN l_orderkey % 23 <> 0 THEN r_name END, '') AS store,
         CASE WHEN l_orderkey % 211 = 0 THEN 0.0::DOUBLE ELSE l_quantity END AS units, p_name, p_brand
  FROM lines WHERE l_linenumber BETWEEN 1 AND 4
)"""
)


def _with(*parts: str) -> str:
    *ctes, select = parts
    return "WITH " + ",".join(ctes) + " " + select


def oracle_sql() -> dict[str, str]:
    canonical_mov = f"SELECT {_CANONICAL} FROM mov WHERE dataset = 'fg_movements'"
    windowed = "movement_date >= TIMESTAMP '1998-01-01' AND movement_date < TIMESTAMP '2000-01-01'"
    drill = (
        f"SELECT {_TIME.format('movement_date')} AS movement_date, dataset, job, item_code, warehouse, movement_type, "
        f"quantity, reference, item_description FROM mov WHERE {windowed}"
    )
    chain_fg = _chain("fg_snaps", "fg_movements")
    chain_rm = _chain("rm_snaps", "rm_movements")
    chain_columns = (
        'item_code, warehouse, "interval", period, opening_qty, net_movement, closing_qty, expected_closing, variance, '
        "within_tolerance, item_description"
    )
    labels = ("19980101->19980701", "19980701->19990101", "19990101->19990701")
    wide = ", ".join(f"coalesce(sum(variance) FILTER (period = '{label}'), 0.0) AS \"{label}\"" for label in labels)
    return {
        "canonical_scan": _with(_STOCK, "SELECT item_code, item_description, warehouse, quantity, value, category FROM fg_lots"),
        "date_window": _with(_LEDGER, f"{canonical_mov} AND {windowed}"),
        "item_filter": _with(_LEDGER, f"SELECT {_CANONICAL}, dataset FROM mov WHERE item_code = 'RM7'"),
        "item_filter_composite": _with(
            _LEDGER,
            f"SELECT {_CANONICAL}, dataset FROM mov WHERE item_code = (SELECT '7|' || p_size FROM part WHERE p_partkey = 7)",
        ),
        "warehouse_filter": _with(_LEDGER, f"SELECT {_CANONICAL}, dataset FROM mov WHERE warehouse = 'ASIA'"),
        "exclude_where": _with(_STOCK, "SELECT item_code, item_description, warehouse, quantity, value, category FROM rm_lots"),
        "normalize_movements": _with(
            _LEDGER,
            f"""SELECT item_code, CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE item_description END AS item_description,
                CASE WHEN l_orderkey % 13 = 0 THEN '-' ELSE warehouse END AS warehouse,
                {_TIME.format('movement_date')} AS movement_date,
                CASE WHEN l_orderkey % 17 = 0 THEN 'NONE' ELSE movement_type END AS movement_type,
                CASE WHEN l_orderkey % 211 = 0 OR l_orderkey % 223 = 0 OR l_orderkey % 227 = 0 THEN 0.0 ELSE quantity END AS quantity,
                reference, job, value, category FROM mov WHERE dataset = 'fg_movements'""",
        ),
        "normalize_balances": _with(
            _STOCK,
            "SELECT item_code, item_description, warehouse, '2001-12-01 08:30:15' AS balance_date, quantity, value, category FROM jobs",
        ),
        "ledger_union": _with(_LEDGER, f"SELECT {_CANONICAL}, dataset FROM mov"),
        "snapshot_csv_load": _with(
            _STOCK,
            f"""SELECT item_code, warehouse, min(item_description) AS item_description, '2001-12-01 08:30:15' AS balance_date,
                sum(quantity) AS quantity, {_money('value')} AS value, min(category) AS category FROM fg_lots GROUP BY 1, 2""",
        ),
        "snapshot_write": _with(
            _STOCK,
            f"""SELECT dataset, '1999-07-01' AS snapshot_date, count(*) AS rows, sum(q)::DOUBLE AS quantity, sum(v)::DOUBLE AS value
                FROM (SELECT dataset, item_code, warehouse, sum(CAST(quantity AS DECIMAL(28, 6))) AS q,
                             sum(CAST(value AS DECIMAL(28, 6))) AS v FROM live GROUP BY 1, 2, 3) GROUP BY 1""",
        ),
        "snapshot_history": _with(
            _LEDGER, _STOCK.replace(_PLACES + ",", ""), _SNAPSHOTS, _HISTORY,
            f"SELECT DISTINCT dataset, {_DAY.format('snapshot_date')} AS snapshot_date FROM history",
        ),
        "snapshot_files": f"""
            SELECT 'fg_balance' AS dataset, {_DAY.format('o_orderdate')} AS snapshot_date,
                   'fg_balance_' || strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 2 = 0 THEN '_late.csv' ELSE '.csv' END AS file_name
            FROM orders WHERE o_orderkey % 3 <> 0""",
        "baseline_asof": _with(
            _LEDGER, _STOCK.replace(_PLACES + ",", ""), _SNAPSHOTS, _HISTORY,
            f"""SELECT dataset, '1998-09-01' AS as_of, {_DAY.format('max(snapshot_date)')} AS snapshot_date
                FROM history WHERE snapshot_date <= DATE '1998-09-01' GROUP BY 1""",
        ),
        "baseline_asof_join": _with(
            _LEDGER, _SNAPSHOTS,
            f"""SELECT d.dataset, {_DAY.format('as_of')} AS as_of, {_DAY.format('snapshot_date')} AS snapshot_date
                FROM (SELECT DISTINCT replace(dataset, 'movements', 'balance') AS dataset, movement_date::DATE AS as_of FROM mov) d
                ASOF LEFT JOIN (SELECT DISTINCT dataset, snapshot_date FROM snaps) s
                  ON d.dataset = s.dataset AND d.as_of >= s.snapshot_date""",
        ),
        "balance_before": _with(
            _LEDGER, _SNAPSHOTS,
            f"""SELECT m.item_code, m.warehouse, {_TIME.format('movement_date')} AS movement_date, movement_type, m.quantity, reference,
                       {_DAY.format('snapshot_date')} AS snapshot_date, s.quantity AS balance
                FROM (SELECT * FROM mov WHERE dataset = 'fg_movements') m
                ASOF LEFT JOIN (SELECT item_code, warehouse, snapshot_date, sum(quantity) AS quantity FROM fg_snaps GROUP BY ALL) s
                  ON m.item_code = s.item_code AND m.warehouse = s.warehouse AND m.movement_date >= s.snapshot_date""",
        ),
        "baseline_import": _with(
            _EXPORT,
            """SELECT style || '|' || size AS item_code, CASE WHEN store = '' THEN '-' ELSE store END AS warehouse,
               '2001-12-01 00:00:00' AS balance_date, min(p_name) AS item_description, sum(units) AS quantity, min(p_brand) AS category
               FROM cells WHERE style <> '' GROUP BY 1, 2""",
        ),
        "key_cell_repair": _with(_EXPORT, "SELECT style, size, shipped, store FROM cells"),
        "classify_direction": _with(_LEDGER, f"SELECT {_CANONICAL}, dataset, direction FROM mov"),
        "signed_quantity": _with(_LEDGER, f"SELECT {_CANONICAL}, dataset, direction, signed_qty FROM pos"),
        "signed_value": _with(_LEDGER, f"SELECT {_CANONICAL}, dataset, direction, signed_qty, signed_val FROM pos"),
        "apply_exclusions": _with(_LEDGER, f"SELECT {_CANONICAL}, dataset, NOT ({_KEPT}) AS excluded FROM mov"),
        "exclusion_totals": _with(
            _LEDGER, f"SELECT NOT ({_KEPT}) AS excluded, count(*) AS movements, sum(quantity) AS quantity FROM mov GROUP BY 1"
        ),
        "movement_drilldown": _with(_LEDGER, drill),
        "drilldown_totals": _with(
            _LEDGER, f"SELECT sum(quantity) AS net_quantity, count(*) AS movements FROM mov WHERE {windowed}"
        ),
        "flow_route": _with(
            _LEDGER, _FLOW, f"SELECT {_CANONICAL}, dataset, direction, source, target, coalesce(sign, 0)::INTEGER AS sign FROM routed"
        ),
        "movement_summary": _with(_LEDGER, _summary("mov", "month", "quantity")),
        "movement_summary_buckets": _with(
            _LEDGER,
            """SELECT *, receipt + issue + adjustment + other AS net FROM (
               SELECT item_code, warehouse, strftime(date_trunc('month', movement_date), '%Y-%m-%d %H:%M:%S') AS period,
                      sum(CASE WHEN direction = 'receipt' AND movement_type NOT LIKE 'RETURN%' THEN quantity ELSE 0 END)::DOUBLE AS receipt,
                      sum(CASE WHEN direction = 'issue' THEN quantity ELSE 0 END)::DOUBLE AS issue,
                      sum(CASE WHEN direction = 'adjustment' THEN quantity ELSE 0 END)::DOUBLE AS adjustment,
                      sum(CASE WHEN direction = 'other' THEN quantity ELSE 0 END)::DOUBLE AS other,
                      sum(CASE WHEN direction = 'receipt' AND movement_type LIKE 'RETURN%' THEN quantity ELSE 0 END)::DOUBLE AS "return"
               FROM mov GROUP BY 1, 2, 3)""",
        ),
        "movement_summary_weekly": _with(_LEDGER, _summary("pos", "week", "signed_qty")),
        "movement_summary_daily": _with(
            _LEDGER, "rm_only AS (SELECT * FROM mov WHERE dataset = 'rm_movements')", _summary("rm_only", "day", "quantity")
        ),
        "category_summary": _with(
            _LEDGER,
            f"""SELECT *, receipt + issue + adjustment + other AS net FROM (
                SELECT category, count(*) AS movements, {_TOTALS.format(amount='quantity')}, {_money('value')} AS net_value
                FROM mov GROUP BY 1)""",
        ),
        "movement_types": _with(
            _LEDGER,
            """SELECT dataset, movement_type, count(*) AS rows, sum(quantity) AS total_units, min(quantity) AS min_qty,
               max(quantity) AS max_qty FROM mov GROUP BY 1, 2""",
        ),
        "movement_net": _with(_LEDGER, "SELECT item_code, warehouse, sum(signed_qty) AS net_movement FROM pos GROUP BY 1, 2"),
        "snapshot_current": _with(
            _STOCK,
            f"""SELECT item_code, warehouse, min(item_description) AS item_description, '2001-12-01 08:30:15' AS balance_date,
                sum(quantity) AS quantity, {_money('value')} AS value, min(category) AS category FROM fg_lots GROUP BY 1, 2""",
        ),
        "snapshot_asof": _with(
            _LEDGER, _SNAPSHOTS,
            f"""SELECT item_code, warehouse, min(item_description) AS item_description,
                {_TIME.format('max(balance_date)')} AS balance_date, sum(quantity) AS quantity, {_money('value')} AS value,
                min(category) AS category
                FROM (SELECT * FROM dated WHERE dataset = 'fg_balance' AND balance_date <= TIMESTAMP '1999-03-01'
                      QUALIFY balance_date = max(balance_date) OVER (PARTITION BY item_code, warehouse)) GROUP BY 1, 2""",
        ),
        "stock_balances_report": _with(
            _LEDGER, _STOCK.replace(_PLACES + ",", ""), _SNAPSHOTS, _HISTORY, _POINTS,
            f"""SELECT s.label AS stock_type, o.quantity AS opening_qty, c.quantity AS closing_qty,
                c.quantity - o.quantity AS qty_change, s.unit, o.value AS opening_value, c.value AS closing_value,
                c.value - o.value AS value_change, {_DAY.format('o.snapshot_date')} AS opening_source
                FROM (VALUES ('rm_balance', 'Raw materials', 'units'), ('fg_balance', 'Finished goods', 'units'),
                             ('wip_balance', 'Work in progress', 'R')) AS s(dataset, label, unit)
                JOIN (SELECT * FROM points WHERE live) c ON c.dataset = s.dataset
                LEFT JOIN (SELECT * FROM points WHERE snapshot_date = DATE '1998-07-01' AND NOT live) o ON o.dataset = s.dataset""",
        ),
        "balance_points": _with(
            _LEDGER, _STOCK.replace(_PLACES + ",", ""), _SNAPSHOTS, _HISTORY, _POINTS,
            f"SELECT dataset, {_DAY.format('snapshot_date')} AS snapshot_date, quantity, value, live FROM points",
        ),
        "category_day_cube": _with(_LEDGER, _BOTH_CUBES, "SELECT * FROM cube"),
        "category_day_cube_folded": _with(
            _LEDGER, "fg_pos AS (SELECT * FROM pos WHERE dataset = 'fg_movements')", _cube("fg_pos", 5, "cube"), "SELECT * FROM cube"
        ),
        "category_rank_topn": _with(
            _LEDGER,
            f"""SELECT category, {_money('abs(value)')} AS gross_value, sum(abs(quantity)) AS gross_units
                FROM mov WHERE dataset = 'fg_movements' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""",
        ),
        "category_order": _with(
            _LEDGER,
            f"""SELECT place::INTEGER AS place, CASE WHEN place < 7 THEN category ELSE 'Other' END AS category FROM (
                SELECT category, row_number() OVER (ORDER BY {_money('abs(value)')} DESC, sum(abs(quantity)) DESC, category) - 1 AS place
                FROM mov WHERE dataset = 'fg_movements' GROUP BY 1) WHERE place <= 7""",
        ),
        "window_category_net": _with(
            _LEDGER, _FG_RAW, _cube("fg_raw", 20, "cube"),
            """SELECT *, rv + iv + av + ov AS net FROM (
               SELECT category, """
            + ", ".join(f"{_money(name)} AS {name}" for name in ("ru", "iu", "au", "ou", "rv", "iv", "av", "ov"))
            + """ FROM cube WHERE day BETWEEN '1998-01-01' AND '2000-01-01' GROUP BY 1) WHERE abs(rv + iv + av + ov) > 0.5""",
        ),
        "store_reconciliation": _with(
            _LEDGER, _STOCK.replace(_PLACES + ",", ""), _SNAPSHOTS, _HISTORY, _POINTS, _BOTH_CUBES,
            f"""SELECT s.dataset, s.store, '1998-01-01' AS opening_date, o.quantity AS opening_qty, '1999-01-01' AS closing_date,
                c.quantity AS closing_qty,
                CASE WHEN s.ledger IS NULL THEN c.quantity - o.quantity END AS change, n.net AS net_movement,
                o.quantity + n.net AS expected_closing, c.quantity - (o.quantity + n.net) AS variance,
                CASE WHEN s.ledger IS NOT NULL THEN greatest(1.0, abs(c.quantity) * 0.5 / 100) END AS tolerance,
                CASE WHEN s.ledger IS NULL THEN 'no ledger'
                     WHEN abs(c.quantity - (o.quantity + n.net)) <= greatest(1.0, abs(c.quantity) * 0.5 / 100) THEN 'reconciles'
                     ELSE 'off' END AS verdict, NULL::VARCHAR AS reason
                FROM (VALUES ('rm_balance', 'Raw materials', 'rm'), ('fg_balance', 'Finished goods', 'fg'),
                             ('wip_balance', 'Work in progress', NULL)) AS s(dataset, store, ledger)
                JOIN points o ON o.dataset = s.dataset AND o.snapshot_date = DATE '1998-01-01'
                JOIN points c ON c.dataset = s.dataset AND c.snapshot_date = DATE '1999-01-01'
                LEFT JOIN (SELECT replace(dataset, '_movements', '') AS ledger, sum(quantity) AS net FROM mov
                           WHERE movement_date >= TIMESTAMP '1998-01-01' AND movement_date < TIMESTAMP '1999-01-01' GROUP BY 1) n
                  ON n.ledger = s.ledger""",
        ),
        "reconcile": _with(
            _LEDGER, _SNAPSHOTS,
            _reconcile(
                _snap("fg_snaps", 0),
                "SELECT item_code, warehouse, item_description, signed_qty AS signed FROM pos WHERE dataset = 'fg_movements'",
                _snap("fg_snaps", 3),
            ),
            "SELECT * FROM rec",
        ),
        "reconcile_snapshots": _with(_LEDGER, _SNAPSHOTS, _REC_SECOND, "SELECT * FROM rec"),
        "reconcile_live": _with(
            _LEDGER, _STOCK.replace(_PLACES + ",", ""), _SNAPSHOTS,
            _reconcile(
                _snap("rm_snaps", 3),
                _moved("rm_movements", "1999-07-01", "2001-12-01 08:30:15"),
                "SELECT item_code, warehouse, item_description, quantity FROM rm_lots",
            ),
            "SELECT * FROM rec",
        ),
        "reconcile_dated": _with(
            _LEDGER, _SNAPSHOTS,
            _reconcile(
                _asof("(SELECT * FROM dated WHERE dataset = 'fg_balance')", "1998-07-01", "1999-03-01"),
                _moved("fg_movements", "1998-07-01", "1999-03-01"),
                _asof("(SELECT * FROM dated WHERE dataset = 'fg_balance')", "1999-03-01", "1999-03-01"),
            ),
            "SELECT * FROM rec",
        ),
        "reconcile_window": _with(
            _LEDGER, _SNAPSHOTS,
            f"""SELECT (SELECT {_TIME.format('max(balance_date)')} FROM fg_snaps WHERE i = 1) AS window_from,
                (SELECT {_TIME.format('max(balance_date)')} FROM fg_snaps WHERE i = 2) AS window_to""",
        ),
        "item_description_lookup": _with(
            _LEDGER, _STOCK.replace(_PLACES + ",", ""), _SNAPSHOTS,
            """SELECT item_code, coalesce(min(d) FILTER (leg = 0), min(d) FILTER (leg = 1), min(d) FILTER (leg = 2), '') AS item_description
               FROM (SELECT item_code, item_description AS d, 0 AS leg FROM fg_snaps WHERE i = 0
                     UNION ALL SELECT item_code, item_description, 1 FROM rm_lots
                     UNION ALL SELECT item_code, item_description, 2 FROM mov) GROUP BY 1""",
        ),
        "reconcile_chain": _with(_LEDGER, _SNAPSHOTS, chain_fg, f"SELECT {chain_columns} FROM periods"),
        "chain_from_files": _with(_LEDGER, _SNAPSHOTS, chain_fg, f"SELECT {chain_columns} FROM periods"),
        "chain_classify": _with(_LEDGER, _SNAPSHOTS, chain_fg, _CLASSIFIED, "SELECT * FROM classified"),
        "chain_classify_rm": _with(_LEDGER, _SNAPSHOTS, chain_rm, _CLASSIFIED, "SELECT * FROM classified"),
        "chain_wide": _with(_LEDGER, _SNAPSHOTS, chain_fg, f"SELECT item_code, warehouse, {wide} FROM periods GROUP BY 1, 2"),
        "chain_class_counts": _with(
            _LEDGER, _SNAPSHOTS, chain_fg, _CLASSIFIED,
            "SELECT classification, count(*) AS items, sum(net_variance) AS net_variance FROM classified GROUP BY 1",
        ),
        "chain_period_stats": _with(
            _LEDGER, _SNAPSHOTS, chain_fg,
            "SELECT period, count(*) AS rows, count(*) FILTER (abs(variance) > 0.5) AS variance_rows FROM periods GROUP BY 1",
        ),
        "negative_balance": _with(
            _LEDGER, _SNAPSHOTS,
            f"""SELECT item_code, warehouse, {_TIME.format('balance_date')} AS balance_date, quantity FROM (
                SELECT * FROM dated WHERE dataset = 'fg_balance'
                QUALIFY row_number() OVER (PARTITION BY item_code, warehouse ORDER BY balance_date DESC, quantity) = 1)
                WHERE quantity < 0""",
        ),
        "robust_stats": _with(_LEDGER, _STATS, "SELECT item_code, warehouse, median, scale, n AS count FROM stats"),
        "robust_stats_split": _with(
            _LEDGER, _STATS, "SELECT item_code, warehouse, median / 1024 AS median, scale / 1024 AS scale, n AS count FROM stats"
        ),
        "outlier_movements": _with(_LEDGER, _STATS, f"SELECT {_CANONICAL}, dataset, median, scale FROM far"),
        "dormant_items": _with(
            _LEDGER,
            f"""SELECT item_code, warehouse, {_TIME.format('last_move')} AS last_move, {_TIME.format('as_of')} AS as_of,
                floor(epoch(as_of - last_move) / 86400)::INTEGER AS idle_days FROM (
                SELECT item_code, warehouse, max(movement_date) AS last_move,
                       (SELECT max(movement_date) FROM mov) AS as_of FROM mov GROUP BY 1, 2)
                WHERE floor(epoch(as_of - last_move) / 86400) > 90""",
        ),
        "anomalies": _with(_LEDGER, _SNAPSHOTS, _FINDINGS, "SELECT * FROM findings"),
        "flow_contributions": _with(_LEDGER, _FLOW, "SELECT source, target, weight, units, 'value' AS measure FROM edges"),
        "flow_contributions_units": _with(
            _LEDGER, _FLOW, "SELECT source, target, units AS weight, units, 'units' AS measure FROM edges"
        ),
        "flow_links": _with(_LEDGER, _FLOW, "SELECT * FROM links"),
        "flow_nodes": _with(
            _LEDGER, _FLOW,
            """SELECT name, CASE WHEN name = 'Vendors' THEN 'vendors' WHEN name = 'Customers' THEN 'customers'
                 WHEN name LIKE 'Production%' THEN 'production' WHEN name LIKE 'RM · %' THEN 'rm_store'
                 WHEN name LIKE 'FG · %' THEN 'fg_store' ELSE 'hub' END AS role,
               CASE WHEN name IN ('Vendors', 'Adj in (RM)') THEN 0 WHEN name LIKE 'RM · %' THEN 1
                 WHEN name LIKE 'FG · %' THEN 3 WHEN name IN ('Customers', 'Adj out (FG)') THEN 4 ELSE 2 END::INTEGER AS "column"
               FROM (SELECT source AS name FROM links UNION SELECT target FROM links)""",
        ),
        "flow_node_totals": _with(
            _LEDGER, _FLOW,
            """SELECT name, inward, outward, greatest(inward, outward) AS total FROM (
               SELECT name, CAST(sum(CAST(i AS DECIMAL(28, 2))) AS DOUBLE) AS inward, CAST(sum(CAST(o AS DECIMAL(28, 2))) AS DOUBLE) AS outward
               FROM (SELECT source AS name, 0.0 AS i, weight AS o FROM links UNION ALL SELECT target, weight, 0.0 FROM links) GROUP BY 1)""",
        ),
        "flow_components": _with(
            _LEDGER,
            f"""SELECT dataset, movement_type, count(*) AS rows, sum(quantity) AS units, {_money('abs(value)')} AS value
                FROM mov GROUP BY 1, 2""",
        ),
        "explain_summary": _with(
            _LEDGER, "s AS (" + _summary("mov", "month", "quantity") + ")",
            """SELECT 0::INTEGER AS line_no, format('Across {} items and {} warehouse(s): received {:,}, issued {:,}, adjusted {}, for a net stock change of {} units.',
                 count(DISTINCT item_code), count(DISTINCT warehouse), sum(receipt)::BIGINT, abs(sum(issue))::BIGINT,
                 CASE WHEN sum(adjustment) >= 0 THEN '+' ELSE '' END || format('{:,}', sum(adjustment)::BIGINT),
                 CASE WHEN sum(net) >= 0 THEN '+' ELSE '' END || format('{:,}', sum(net)::BIGINT)) AS line FROM s
               UNION ALL
               SELECT row_number() OVER (ORDER BY abs(net) DESC, item_code, warehouse)::INTEGER,
                 format('{} ({}) in {} {} {:,} units net.', item_code, item_code, warehouse,
                        CASE WHEN net > 0 THEN 'built up' ELSE 'drew down' END, abs(net)::BIGINT)
               FROM (SELECT item_code, warehouse, sum(net) AS net FROM s GROUP BY 1, 2 ORDER BY abs(sum(net)) DESC, 1, 2 LIMIT 10)""",
        ),
        "explain_reconciliation": _with(
            _LEDGER, _SNAPSHOTS, _REC_SECOND,
            """SELECT 0::INTEGER AS line_no, format('Reconciled {} item/warehouse combinations: {} balance, {} show unexplained variance.',
                 count(*), count(*) FILTER (within_tolerance), count(*) FILTER (NOT within_tolerance)) AS line FROM rec
               UNION ALL
               SELECT row_number() OVER (ORDER BY abs(variance) DESC, item_code, warehouse)::INTEGER,
                 format('{} ({}) in {}: closing balance is {:,}.0 but opening {:,}.0 plus recorded movements {}.0 predicts {:,}.0 — {:,}.0 units {} than the movements explain. Check for unposted transactions, stocktake adjustments captured outside the movement tables, or timing cut-off.',
                   item_code, item_description, warehouse, closing_qty::BIGINT, opening_qty::BIGINT,
                   CASE WHEN net_movement >= 0 THEN '+' ELSE '' END || format('{:,}', net_movement::BIGINT), expected_closing::BIGINT,
                   abs(variance)::BIGINT, CASE WHEN variance > 0 THEN 'more' ELSE 'less' END)
               FROM (SELECT * FROM rec WHERE NOT within_tolerance ORDER BY abs(variance) DESC, item_code, warehouse LIMIT 10)""",
        ),
        "explain_anomalies": _with(
            _LEDGER, _SNAPSHOTS, _FINDINGS,
            """SELECT row_number() OVER (ORDER BY place, item_code, warehouse, detail)::INTEGER AS line_no,
                 item_code || ' in ' || warehouse || CASE place
                   WHEN 1 THEN ' has a NEGATIVE balance: ' || detail || '. Stock was issued that the system never received — check GRN backlogs and issue timing.'
                   WHEN 2 THEN ' had an unusually large movement: ' || detail || '. Verify the document capture (possible unit-of-measure or keying error).'
                   ELSE ' is dormant: ' || detail || '. Candidate for stock count, write-off review or reallocation.' END AS line
               FROM (SELECT *, CASE kind WHEN 'negative_balance' THEN 1 WHEN 'outlier_movement' THEN 2 ELSE 3 END AS place
                     FROM findings ORDER BY place, item_code, warehouse, detail LIMIT 20)
               UNION ALL
               SELECT 21, '...and ' || (count(*) - 20) || ' more finding(s); export with --csv for the full list.' FROM findings
               HAVING count(*) > 20""",
        ),
        "discover_table_scores": _with(_CATALOG, "SELECT * FROM scores"),
        "discover_columns": _with(_CATALOG, "SELECT * FROM guesses"),
        "discover_datasets": _with(_CATALOG, "SELECT * FROM suggestions"),
        "discovery_gaps": _with(
            _CATALOG,
            """SELECT dataset, table_schema, table_name, score,
               coalesce(string_agg(canonical, ', ' ORDER BY canonical) FILTER (column_name IS NULL), '') AS unmapped_columns
               FROM suggestions GROUP BY 1, 2, 3, 4""",
        ),
        "list_columns": _with(
            _CATALOG, "SELECT * FROM catalog WHERE table_name IN ('FinishedTrans0', 'WIPStockBalance7', 'FabricTrans3')"
        ),
    }
