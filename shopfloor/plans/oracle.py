"""Independent DuckDB SQL for every registered query that SQL can express.

The fixture tables are CTEs over the pre-registered views (``orders``,
``customer``, ``lineitem``, ``part``, ``events``); each query body names the
fixtures it uses and ``sql_for`` prepends exactly those CTEs.  Line items are
taken from ``fx_lines`` directly (what the JSON encodes); Spark parses the
JSON text it wrote, so the comparison also checks the JSON round trip.
"""

from __future__ import annotations

import re

from shopfloor.functions.text import CATEGORIES, NUMBER_RE

AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"
WEEKLY_SPEND = "CAST(12000.0 AS DOUBLE)"

# ------------------------------------------------------------ SQL helpers


def cents(x: str) -> str:
    return (f"(CAST(CAST(floor(({x}) / 100) AS BIGINT) AS VARCHAR) || '.' || "
            f"lpad(CAST(({x}) % 100 AS VARCHAR), 2, '0'))")


def cat(x: str) -> str:
    lst = ", ".join(f"'{c}'" for c in CATEGORIES)
    return f"([{lst}][({x}) % 7 + 1])"


def num(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{NUMBER_RE}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def money(x: str) -> str:
    return f"COALESCE(TRY_CAST({num(x)} AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2)))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def pdate(x: str) -> str:
    fmts = ["%B %d, %Y", "%Y-%m-%d", "%d/%m/%Y", "%d/%m/%Y %H:%M:%S"]
    return "COALESCE(" + ", ".join(f"try_strptime({strip(x)}, '{f}')" for f in fmts) + ")"


def title(x: str) -> str:
    return (f"list_aggr(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|\\P{{L}}+)'), "
            f"lambda t: upper(t[1]) || t[2:]), 'string_agg', '')")


def paid(status: str = "payment_status") -> str:
    return f"COALESCE(contains({status}, 'Paid'), false)"


def fmt(x: str, decimals: int) -> str:
    return f"format('{{:,.{decimals}f}}', CAST({x} AS DOUBLE))"


def days_before(days: int) -> str:
    return f"({AS_OF} - INTERVAL {days} DAY)"


def display_category(c: str = "category", d: str = "details") -> str:
    det = strip(f"COALESCE({d}, '')")
    return (f"(CASE WHEN {c} IS NULL OR {strip(c)} = '' THEN 'Unknown' "
            f"WHEN {title(strip(c))} = 'Other' AND {det} <> '' AND lower({det}) <> 'nan' "
            f"THEN 'Other: ' || CASE WHEN length({det}) > 15 THEN substr({det}, 1, 15) || '...' ELSE {det} END "
            f"ELSE {title(strip(c))} END)")


# ------------------------------------------------------------ fixtures
_S = "CAST(round(l_extendedprice / l_quantity) AS BIGINT)"
_N = "CAST(round(o_totalprice) AS BIGINT)"
_VN = "CAST(round(p_retailprice * 100) AS BIGINT)"


def _price_text(mod: int, n: str) -> str:
    return (f"CASE p_partkey % {mod} WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'ask' "
            f"ELSE {cents(n)} END")


FIXTURES: dict[str, str] = {
    "fx_lines": f"""
  SELECT l_orderkey AS row_pos,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
                       l_extendedprice, l_quantity) AS line_no,
    CASE l_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'N/A' ELSE 'JK-' || CAST(l_partkey AS VARCHAR) END AS sku,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 2 THEN lower({cat('l_partkey')})
         ELSE {cat('l_partkey')} END AS category,
    CASE WHEN l_partkey % 3 = 0 THEN p_name || ' ' || p_brand ELSE '' END AS details,
    l_quantity AS quantity,
    CAST(floor({_S} * 6 / 10) AS BIGINT) / CAST(100 AS DOUBLE) AS source_price,
    {_S} / CAST(100 AS DOUBLE) AS selling_price
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_sales": f"""
  SELECT o_orderkey AS row_pos,
    strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%d/%m/%Y %H:%M:%S') AS sale_ts_text,
    CASE WHEN o_orderkey % 20 = 0 THEN '' WHEN o_orderkey % 20 = 1 THEN 'n/a'
         WHEN o_orderkey % 20 BETWEEN 2 AND 5 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN o_orderkey % 20 BETWEEN 6 AND 8 THEN strftime(o_orderdate, '%d/%m/%Y')
         ELSE strftime(o_orderdate, '%B %d, %Y') END AS sale_date_text,
    CASE o_orderkey % 25 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE c_name END AS client_name,
    CASE WHEN c_custkey % 75 = 0 THEN '' WHEN c_custkey % 74 = 0 THEN NULL
         ELSE '@u' || CAST(c_custkey AS VARCHAR) END AS handle,
    CASE o_orderkey % 40 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE {cents(_N)} END AS paid_text,
    {cents(f'CAST(floor({_N} / 2) AS BIGINT)')} AS cost_text,
    CAST(o_orderkey % 7 * 10 AS VARCHAR) AS courier_text,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'Paid Online'
         WHEN o_orderstatus = 'F' THEN 'Paid (UPI/Bank)'
         WHEN o_orderstatus = 'O' THEN 'Cash on Delivery'
         WHEN o_orderstatus = 'P' AND o_orderkey % 50 = 0 THEN 'Not Paid'
         WHEN o_orderstatus = 'P' AND o_orderkey % 50 = 1 THEN 'Unpaid'
         WHEN o_orderstatus = 'P' AND o_orderkey % 50 = 2 THEN NULL
         WHEN o_orderstatus = 'P' THEN 'Pending' END AS payment_status,
    CASE WHEN o_orderkey % 30 = 0 THEN 'blank' WHEN o_orderkey % 30 = 1 THEN 'junk'
         WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'ok' ELSE 'none' END AS items_state,
    o_orderdate AS order_ts
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fx_sales_t": f"""
  SELECT row_pos, sale_ts_text, try_strptime(sale_ts_text, '%d/%m/%Y %H:%M:%S') AS sale_ts,
    sale_date_text, {pdate('sale_date_text')} AS sale_date, client_name, handle,
    {money('cost_text')} AS cost, {money('courier_text')} AS courier, {money('paid_text')} AS paid,
    payment_status, items_state, order_ts
  FROM fx_sales""",
    "fx_paid_lines": f"""
  SELECT l.* FROM fx_lines l JOIN fx_sales_t s ON l.row_pos = s.row_pos
  WHERE s.items_state = 'ok' AND {paid('s.payment_status')}""",
    "fx_purchases": f"""
  SELECT CASE WHEN l_orderkey % 30 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS purchase_date_text,
    CASE WHEN l_orderkey % 31 = 0 THEN 'x' ELSE {cents('CAST(round(l_extendedprice) AS BIGINT)')} END AS amount_text
  FROM lineitem""",
    "fx_vault": f"""
  SELECT p_partkey AS row_pos, 'JK-' || CAST(p_partkey AS VARCHAR) AS sku,
    {cents(_VN)} AS sourcing_price_text,
    {cat('p_partkey')} || ', ' || p_name || ', ' || p_type AS tags,
    'https://img.example/JK-' || CAST(p_partkey AS VARCHAR) AS image_url,
    {_price_text(4, f'2 * {_VN}')} AS standard_price_text,
    {_price_text(5, f'2 * {_VN}')} AS vip_price_text,
    {_price_text(6, _VN)} AS clearance_price_text,
    CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN '0' WHEN p_partkey % 101 = 0 THEN 'x'
         ELSE CAST(p_size AS VARCHAR) END AS stock_text
  FROM part""",
    "fx_client_value": f"""
  SELECT handle, count(sale_ts_text) AS total_orders, CAST(sum(paid) AS DOUBLE) AS lifetime_spend,
    CAST(sum(paid - cost) AS DOUBLE) AS total_profit,
    CASE WHEN sum(paid) > 15000 THEN '💎 Diamond VIP' WHEN sum(paid) > 5000 THEN '🥇 Gold Tier'
         WHEN count(sale_ts_text) > 1 THEN '⭐ Repeat Buyer' ELSE '🆕 New Client' END AS client_status
  FROM fx_sales_t WHERE {paid()} AND handle IS NOT NULL GROUP BY handle""",
    "fx_guard": """
  SELECT COALESCE(bool_or(payment_status = 'Paid (UPI/Bank)'), false) AS enabled FROM fx_sales_t""",
    "fx_months": f"""
  SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, CAST(sum(paid) AS DOUBLE) AS revenue,
    count(*) AS sales
  FROM fx_sales_t WHERE {paid()} AND sale_date IS NOT NULL GROUP BY 1""",
    "fx_mom": """
  SELECT CASE WHEN (SELECT NOT enabled FROM fx_guard) THEN 0.0
              WHEN n < 2 THEN 0.0 WHEN prev = 0 THEN NULL ELSE (revenue / prev - 1.0) * 100.0 END AS mom_growth_pct,
         n AS months
  FROM (SELECT max_by(revenue, month) AS revenue, max_by(prev, month) AS prev, count(*) AS n
        FROM (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS prev FROM fx_months))""",
    "fx_cac": f"""
  SELECT CASE WHEN g.enabled THEN n ELSE 0 END AS new_clients,
         CASE WHEN NOT g.enabled THEN 0.0 WHEN n > 0 THEN {WEEKLY_SPEND} / n ELSE {WEEKLY_SPEND} END AS cac,
         {WEEKLY_SPEND} AS weekly_spend
  FROM (SELECT count(DISTINCT handle) AS n FROM fx_sales_t
        WHERE {paid()} AND sale_date >= {days_before(7)}) c, fx_guard g""",
    "fx_kpi": f"""
  SELECT CAST(COALESCE(sum(paid), 0) AS DOUBLE) AS realised_revenue,
    CAST(COALESCE(sum(paid - cost - courier), 0) AS DOUBLE) AS true_profit, count(*) AS paid_sales
  FROM fx_sales_t WHERE {paid()}""",
    "fx_top": """
  SELECT COALESCE((SELECT category FROM fx_paid_lines WHERE category IS NOT NULL GROUP BY category
                   ORDER BY sum(quantity) DESC, category LIMIT 1), 'N/A') AS top_category""",
    "fx_dead": f"""
  SELECT CAST(COALESCE(sum(amount), 0) AS DOUBLE) AS dead_stock_capital, count(*) AS old_purchases
  FROM (SELECT {pdate('purchase_date_text')} AS purchase_date, {money('amount_text')} AS amount FROM fx_purchases)
  WHERE purchase_date < {days_before(45)}""",
}

# ------------------------------------------------------------ query bodies
Q: dict[str, str] = {}

Q["scan_sales"] = """SELECT row_pos, sale_ts_text, sale_date_text, client_name, handle, paid_text, cost_text,
  courier_text, payment_status FROM fx_sales"""
Q["scan_purchases"] = "SELECT * FROM fx_purchases"
Q["scan_vault"] = "SELECT * FROM fx_vault"
Q["normalize_sales"] = """SELECT row_pos, sale_ts, sale_date, client_name, handle, CAST(cost AS DOUBLE) AS cost,
  CAST(courier AS DOUBLE) AS courier, CAST(paid AS DOUBLE) AS paid, payment_status FROM fx_sales_t"""
Q["clean_amounts"] = f"""SELECT row_pos, paid_text, {num('paid_text')} AS paid_num,
  CAST({money('paid_text')} AS DOUBLE) AS paid, CAST({money('cost_text')} AS DOUBLE) AS cost,
  CAST({money('courier_text')} AS DOUBLE) AS courier FROM fx_sales"""
Q["clean_dates"] = """SELECT row_pos, sale_date_text, sale_date, sale_ts, CAST(sale_date AS DATE) AS sale_day
  FROM fx_sales_t"""
Q["clean_text"] = f"""SELECT row_pos, client_name, {strip('client_name')} AS client_name_clean,
  COALESCE({strip('client_name')} = '', true) AS name_blank FROM fx_sales"""
Q["paid_sales"] = f"""SELECT row_pos, handle, sale_date, CAST(paid AS DOUBLE) AS paid, payment_status
  FROM fx_sales_t WHERE {paid()}"""
Q["sale_profit"] = f"""SELECT row_pos, CAST(paid - cost - courier AS DOUBLE) AS profit_with_courier,
  CAST(paid - cost AS DOUBLE) AS profit_without_courier FROM fx_sales_t WHERE {paid()}"""
Q["recent_sales"] = f"""SELECT row_pos, handle, sale_date, CAST(paid AS DOUBLE) AS paid FROM fx_sales_t
  WHERE {paid()} AND sale_date >= {days_before(7)}"""
Q["kpi_financial"] = "SELECT * FROM fx_kpi"
Q["top_category"] = "SELECT * FROM fx_top"
Q["dead_stock"] = "SELECT * FROM fx_dead"
Q["cac"] = "SELECT * FROM fx_cac"
Q["monthly_revenue"] = "SELECT * FROM fx_months"
Q["mom_growth"] = "SELECT * FROM fx_mom"
Q["daily_trend"] = f"""SELECT CAST(sale_date AS DATE) AS sale_day, CAST(sum(paid) AS DOUBLE) AS gross_revenue,
  CAST(sum(paid - cost - courier) AS DOUBLE) AS true_profit FROM fx_sales_t
  WHERE {paid()} AND sale_date >= {days_before(90)} GROUP BY 1"""
Q["client_value"] = "SELECT * FROM fx_client_value"
Q["top_clients"] = "SELECT * FROM fx_client_value ORDER BY lifetime_spend DESC, handle LIMIT 5"
Q["repeat_rate"] = """SELECT count(*) FILTER (WHERE total_orders > 1) AS repeat_buyers, count(*) AS total_clients,
  CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE total_orders > 1) AS DOUBLE) / CAST(count(*) AS DOUBLE)
       * 100.0 ELSE 0.0 END AS repeat_rate_pct FROM fx_client_value"""
Q["line_items"] = """SELECT l.* FROM fx_lines l JOIN fx_sales s ON l.row_pos = s.row_pos WHERE s.items_state = 'ok'"""
Q["cart_totals"] = """SELECT l.row_pos, sum(quantity) AS total_pieces,
  CAST(sum(CAST(quantity AS DECIMAL(18,2)) * CAST(source_price AS DECIMAL(18,2))) AS DOUBLE) AS total_cost,
  CAST(sum(CAST(quantity AS DECIMAL(18,2)) * CAST(selling_price AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
  count(*) AS n_lines
  FROM fx_lines l JOIN fx_sales s ON l.row_pos = s.row_pos WHERE s.items_state = 'ok' GROUP BY l.row_pos"""
Q["display_category"] = f"""SELECT l.row_pos, line_no, category, details, {display_category()} AS display_category
  FROM fx_lines l JOIN fx_sales s ON l.row_pos = s.row_pos WHERE s.items_state = 'ok'"""
Q["category_mix"] = f"""SELECT display_category, quantity, quantity / sum(quantity) OVER () AS share FROM (
  SELECT {display_category()} AS display_category, sum(quantity) AS quantity FROM fx_paid_lines GROUP BY 1)"""
Q["weekly_summary"] = f"""SELECT k.realised_revenue, k.true_profit, t.top_category, d.dead_stock_capital,
  c.new_clients, c.cac, m.mom_growth_pct, {WEEKLY_SPEND} > 100000.0 AS spend_warning,
  '📊 *Weekly Operations Update*' || chr(10) ||
  'Total Sales: ₹' || {fmt('k.realised_revenue', 0)} || chr(10) ||
  'True Profit: ₹' || {fmt('k.true_profit', 0)} || chr(10) ||
  '🚀 MoM Growth: ' || COALESCE({fmt('m.mom_growth_pct', 1)}, 'nan') || '%' || chr(10) ||
  '🎯 CAC: ' || CASE WHEN {WEEKLY_SPEND} > 0 THEN '₹' || {fmt('c.cac', 2)} ELSE '₹0 ' END ||
  '/client (₹' || {fmt(WEEKLY_SPEND, 2)} || ' total spend)' || chr(10) ||
  '🔥 Top Performer: ' || t.top_category || chr(10) ||
  '⚠️ Note: You have ₹' || {fmt('d.dead_stock_capital', 0)} ||
  ' tied up in stock older than 45 days. Consider discounting older pieces on the next live!' AS summary
  FROM fx_kpi k, fx_top t, fx_dead d, fx_cac c, fx_mom m"""


def stock(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN CAST(0 AS BIGINT) "
            f"ELSE TRY_CAST({strip(x)} AS BIGINT) END)")


# Python's whitespace set
_BLANKS = ("[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
           "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+")


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(replace({x}, ',', ' ')), '{_BLANKS}'), lambda t: t <> '')"


def describe(cat_: str, custom: str) -> str:
    name = (f"(CASE WHEN lower({cat_}) = 'other' AND {custom} <> '' THEN {custom} "
            f"WHEN {custom} <> '' THEN {cat_} || ' (' || {custom} || ')' ELSE {cat_} END)")
    return f"(CASE WHEN length({name}) > 35 THEN substr({name}, 1, 32) || '..' ELSE {name} END)"


_CHOICE = " ".join(f"WHEN contains(cp, '{c.lower()}') THEN '{c}'" for c in CATEGORIES)

FIXTURES.update({
    "fx_all_lines": """
  SELECT l.* FROM fx_lines l JOIN fx_sales s ON l.row_pos = s.row_pos WHERE s.items_state = 'ok'""",
    "fx_sellable": f"""
  SELECT row_pos, line_no, sku, quantity, {strip('sku')} AS sku_key, TRY_CAST(trunc(quantity) AS BIGINT) AS qty
  FROM fx_all_lines
  WHERE {strip('sku')} <> '' AND upper({strip('sku')}) <> 'N/A' AND TRY_CAST(trunc(quantity) AS BIGINT) > 0""",
    "fx_movements": """
  SELECT 'JK-' || CAST(l_partkey AS VARCHAR) AS sku, o_orderdate AS ts, l_orderkey, l_linenumber, l_suppkey,
    l_extendedprice, CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS BIGINT) AS delta,
    CAST(p_size AS BIGINT) AS s0
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "fx_queries": """
  SELECT p_partkey AS query_id,
    CASE WHEN p_partkey % 70 = 0 THEN ''
         WHEN p_partkey % 50 = 0 THEN p_name || ', ' || p_type || ' ' || split_part(p_name, ' ', 1)
         ELSE p_name || ', ' || p_type END AS query
  FROM part""",
    "fx_responses": f"""
  SELECT p_partkey AS response_id,
    'Category: ' || CASE WHEN p_partkey % 7 = 0 THEN 'Kundan Choker Set' ELSE {cat('p_partkey')} END ||
    CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE ' | ' END || 'Tags: ' || p_name AS response
  FROM part""",
    "fx_restock": """
  SELECT 'JK-' || CAST(p_partkey AS VARCHAR) AS sku, CAST(p_size - 10 AS BIGINT) AS qty FROM part
  UNION ALL SELECT * FROM (VALUES ('JK-MISSING-1', CAST(5 AS BIGINT)), ('JK-MISSING-2', CAST(5 AS BIGINT)),
                                 ('JK-MISSING-3', CAST(5 AS BIGINT))) t(sku, qty)""",
    "fx_deletes": """
  SELECT sku FROM fx_vault WHERE stock_text = '0' UNION ALL SELECT 'JK-UNKNOWN'""",
    "fx_match": f"""
  SELECT query_id, row_pos, sku, score FROM (
    SELECT qt.query_id, v.row_pos, v.sku, CAST(sum(qt.weight) AS BIGINT) AS score,
      row_number() OVER (PARTITION BY qt.query_id ORDER BY sum(qt.weight) DESC, v.row_pos) AS rn
    FROM (SELECT query_id, token, count(*) AS weight
          FROM (SELECT query_id, unnest({tokens('query')}) AS token FROM fx_queries) GROUP BY ALL) qt
    JOIN fx_vault v ON contains(lower(COALESCE(v.tags, '')), qt.token)
    GROUP BY qt.query_id, v.row_pos, v.sku) WHERE rn = 1""",
    "fx_quotes": f"""
  SELECT row_pos, sku, {num('sourcing_price_text')} AS cost,
    COALESCE({num('standard_price_text')}, {num('sourcing_price_text')} * CAST(1.8 AS DOUBLE)) AS standard_quote,
    COALESCE({num('vip_price_text')}, {num('sourcing_price_text')} * CAST(1.5 AS DOUBLE)) AS vip_quote,
    COALESCE({num('clearance_price_text')}, {num('sourcing_price_text')} * CAST(1.2 AS DOUBLE)) AS clearance_quote
  FROM fx_vault""",
})

Q["vault_add"] = f"""
  SELECT row_pos, sku, {num('sourcing_price_text')} AS sourcing_price, tags, image_url,
    {num('standard_price_text')} AS standard_price, {num('vip_price_text')} AS vip_price,
    {num('clearance_price_text')} AS clearance_price, {stock('stock_text')} AS stock_qty
  FROM fx_vault
  UNION ALL
  SELECT (SELECT max(row_pos) FROM fx_vault) + p_partkey AS row_pos, sku, p_retailprice AS sourcing_price,
    CASE WHEN p_partkey % 3 = 0 THEN {cat('p_partkey')} ELSE {cat('p_partkey')} || ', ' || p_name END AS tags,
    'https://img.example/' || sku AS image_url,
    CASE WHEN ovr > 0 THEN ovr ELSE p_retailprice * CAST(1.8 AS DOUBLE) END AS standard_price,
    CASE WHEN ovr * CAST(0.75 AS DOUBLE) > 0 THEN ovr * CAST(0.75 AS DOUBLE)
         ELSE p_retailprice * CAST(1.5 AS DOUBLE) END AS vip_price,
    p_retailprice * CAST(1.2 AS DOUBLE) AS clearance_price,
    CAST(p_size AS BIGINT) AS stock_qty
  FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 2 ELSE CAST(0.0 AS DOUBLE) END AS ovr,
          'JK-' || CAST(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', {AS_OF} + to_seconds(p_partkey)) AS VARCHAR)
          || '-' || upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 4)) AS sku
        FROM part)"""
Q["vault_delete"] = f"""SELECT * FROM fx_vault WHERE {strip('sku')} NOT IN (SELECT {strip('sku')} FROM fx_deletes)"""
Q["stock_deduct"] = f"""
  SELECT row_pos, sku, stock_text AS old_stock_text, COALESCE(sold_qty, 0) AS sold_qty,
    CASE WHEN sold_qty IS NOT NULL AND {stock('stock_text')} IS NOT NULL
         THEN CAST(greatest(0, {stock('stock_text')} - sold_qty) AS VARCHAR) ELSE stock_text END AS new_stock_text
  FROM fx_vault v LEFT JOIN (SELECT sku_key, CAST(sum(qty) AS BIGINT) AS sold_qty FROM fx_sellable GROUP BY sku_key) s
    ON {strip('v.sku')} = s.sku_key"""
Q["stock_restock"] = f"""
  SELECT row_pos, sku, stock_text AS old_stock_text, COALESCE(added_qty, 0) AS added_qty,
    CASE WHEN added_qty IS NOT NULL THEN CAST(COALESCE({stock('stock_text')}, 0) + added_qty AS VARCHAR)
         ELSE stock_text END AS new_stock_text
  FROM fx_vault v LEFT JOIN (SELECT {strip('sku')} AS sku_key, CAST(sum(qty) AS BIGINT) AS added_qty FROM fx_restock
                             WHERE qty > 0 GROUP BY 1) r ON {strip('v.sku')} = r.sku_key"""
Q["restock_rejects"] = f"""
  SELECT sku, qty FROM fx_restock r WHERE qty > 0
    AND NOT EXISTS (SELECT 1 FROM fx_vault v WHERE {strip('v.sku')} = {strip('r.sku')})"""
Q["unmatched_lines"] = f"""
  SELECT row_pos, line_no, sku, quantity FROM fx_sellable l
  WHERE NOT EXISTS (SELECT 1 FROM fx_vault v WHERE {strip('v.sku')} = l.sku_key
                      AND {strip('v.sku')} NOT IN (SELECT {strip('sku')} FROM fx_deletes))"""
Q["stock_ledger"] = """
  SELECT sku, ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, delta, s0,
    CAST(x + greatest(0, max(-x) OVER w) AS BIGINT) AS stock
  FROM (SELECT *, greatest(s0, 0) + sum(delta) OVER w AS x FROM fx_movements
        WINDOW w AS (PARTITION BY sku ORDER BY ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, delta
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WINDOW w AS (PARTITION BY sku ORDER BY ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, delta
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
Q["gallery"] = f"""
  SELECT row_pos, sku, CAST(trunc(st) AS BIGINT) AS stock,
    CASE WHEN trunc(st) >= 3 THEN 'In Stock' WHEN trunc(st) > 0 THEN 'Low Stock' ELSE 'SOLD OUT' END AS stock_badge,
    'Cost: ₹' || {fmt(num('sourcing_price_text'), 0)} AS cost_text, tags
  FROM (SELECT *, COALESCE({num('stock_text')}, 0.0) AS st FROM fx_vault)
  WHERE st > 0 AND COALESCE(contains(lower(tags), 'ring'), false)
  ORDER BY row_pos DESC LIMIT 6"""
Q["default_price"] = f"""
  SELECT sku, COALESCE(CAST(TRY_CAST(trunc({num('standard_price_text')}) AS BIGINT) AS VARCHAR), '') AS default_price
  FROM fx_vault ORDER BY row_pos DESC LIMIT 1"""
Q["price_quotes"] = f"""
  SELECT *, '₹' || {fmt('standard_quote', 0)} AS standard_quote_text, '₹' || {fmt('vip_quote', 0)} AS vip_quote_text,
    '₹' || {fmt('clearance_quote', 0)} AS clearance_quote_text FROM fx_quotes"""
Q["catalog_match"] = "SELECT * FROM fx_match"
Q["match_quotes"] = """
  SELECT m.query_id, m.row_pos, m.sku, m.score, q.cost, q.standard_quote, q.vip_quote, q.clearance_quote
  FROM fx_match m JOIN fx_quotes q ON m.row_pos = q.row_pos"""
Q["tag_responses"] = f"""
  SELECT response_id,
    CASE WHEN contains(t, '|') THEN CASE {_CHOICE} ELSE 'Other' END ELSE 'Other' END AS category,
    CASE WHEN contains(t, '|') THEN {strip("replace(split_part(t, '|', 2), 'Tags:', '')")} ELSE '' END AS tags
  FROM (SELECT response_id, t, lower({strip("replace(split_part(t, '|', 1), 'Category:', '')")}) AS cp
        FROM (SELECT response_id, {strip('response')} AS t FROM fx_responses))"""
Q["tag_categories"] = f"SELECT category, count(*) AS responses FROM ({Q['tag_responses']}) GROUP BY category"
Q["invoice_headers"] = f"""
  SELECT row_pos,
    'INV-' || right(regexp_replace(COALESCE(sale_ts_text, 'N/A'), '[/: ]', '', 'g'), 6) AS invoice_id,
    COALESCE(client_name, '') AS billed_to, COALESCE(sale_date_text, 'N/A') AS invoice_date,
    {num('paid_text')} AS grand_total, 'INR ' || {fmt(num('paid_text'), 2)} AS grand_total_text,
    {num('paid_text')} IS NOT NULL AS ok,
    'Invoice_' || replace(COALESCE(client_name, ''), ' ', '_') || '.pdf' AS file_name
  FROM fx_sales"""
Q["invoice_lines"] = f"""
  SELECT row_pos, line_no, description, qty, unit_price, qty * unit_price AS line_total,
    'INR ' || {fmt('unit_price', 2)} AS unit_price_text, 'INR ' || {fmt('qty * unit_price', 2)} AS amount_text
  FROM (
    SELECT l.row_pos, l.line_no,
      {describe("COALESCE(category, 'Item')", strip("COALESCE(details, '')"))} AS description,
      COALESCE(TRY_CAST(trunc(quantity) AS BIGINT), 1) AS qty, COALESCE(selling_price, 0.0) AS unit_price
    FROM fx_lines l JOIN fx_sales s ON l.row_pos = s.row_pos
    WHERE s.items_state = 'ok' AND {num('s.paid_text')} IS NOT NULL
    UNION ALL
    SELECT row_pos, 1, 'Item', CAST(1 AS BIGINT), {num('paid_text')} FROM fx_sales
    WHERE items_state <> 'ok' AND {num('paid_text')} IS NOT NULL)"""
Q["recent_transactions"] = f"""
  SELECT row_pos, COALESCE(sale_date_text, '') || ' - ' || COALESCE(client_name, '') || ' (₹' ||
    COALESCE(paid_text, '') || ')' AS label
  FROM fx_sales WHERE NOT COALESCE({strip('client_name')} = '', true) ORDER BY row_pos DESC LIMIT 10"""
_IST = "(order_ts + to_seconds(s.row_pos % 86400) + INTERVAL 330 MINUTE)"
Q["log_sales"] = f"""
  SELECT s.row_pos, strftime({_IST}, '%d/%m/%Y %H:%M:%S') AS sale_ts_text, strftime({_IST}, '%B %d, %Y') AS sale_date_text,
    client_name, handle, CAST(sum(quantity) AS BIGINT) AS total_pieces,
    CAST(sum(CAST(quantity AS DECIMAL(18,2)) * CAST(source_price AS DECIMAL(18,2))) AS DOUBLE) AS total_cost,
    CAST({money('courier_text')} AS DOUBLE) AS courier,
    CAST(sum(CAST(quantity AS DECIMAL(18,2)) * CAST(selling_price AS DECIMAL(18,2))) AS DOUBLE) AS amount_paid,
    payment_status, count(*) AS n_items, sum(quantity) AS json_qty
  FROM fx_sales s JOIN fx_lines l ON s.row_pos = l.row_pos
  GROUP BY s.row_pos, order_ts, client_name, handle, courier_text, payment_status"""
Q["pii_roundtrip"] = """
  SELECT row_pos, handle, client_name, handle AS handle_plain_read, COALESCE(handle <> '', false) AS handle_protected
  FROM fx_sales"""
Q["sessions"] = """
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 900 SECOND AS session_end, count(*) AS events
  FROM (SELECT user_id, ts,
          sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 900 SECOND THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
        FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events))
  GROUP BY user_id, sid"""


# lines of sales with readable items, as fx_faulty_sales spoils them; a sale without lines has no list
_FAULTY = """(SELECT l.row_pos, l.line_no, l.sku, l.category, l.quantity, l.selling_price, l.row_pos % 17 AS k,
    count(*) OVER (PARTITION BY l.row_pos) AS n
  FROM fx_lines l JOIN fx_sales s ON l.row_pos = s.row_pos WHERE l.row_pos % 30 > 1)"""
Q["checked_lines"] = f"""SELECT row_pos, line_no, sku, category, CASE WHEN k IN (5, 6) THEN 0.0::DOUBLE ELSE quantity END AS quantity,
  selling_price FROM {_FAULTY} WHERE k <> 7"""
Q["line_rejects"] = f"""
  SELECT row_pos, CAST(0 AS BIGINT) AS element_no, 'not JSON' AS reason FROM fx_sales WHERE row_pos % 30 = 1
  UNION ALL
  SELECT DISTINCT row_pos, 0, 'not a list' FROM {_FAULTY} WHERE k = 7
  UNION ALL
  SELECT row_pos, n + i, 'not an object' FROM (SELECT DISTINCT row_pos, n FROM {_FAULTY} WHERE k = 3), range(1, 4) r(i)
  UNION ALL
  SELECT row_pos, line_no, 'quantity is not a number' FROM {_FAULTY} WHERE k IN (5, 6)"""


_CLIENTS = "SELECT '{0}' AS frame, handle AS item, CAST(total_orders AS DOUBLE) AS v1, lifetime_spend AS v2, total_profit AS v3, client_status AS label"
Q["dashboard"] = f"""
  SELECT 'summary' AS frame, '' AS item, realised_revenue AS v1, true_profit AS v2, dead_stock_capital AS v3, summary AS label
  FROM ({Q['weekly_summary']})
  UNION ALL
  SELECT 'daily_trend', CAST(sale_day AS VARCHAR), gross_revenue, true_profit, NULL, NULL FROM ({Q['daily_trend']})
  UNION ALL
  SELECT 'category_mix', display_category, quantity, share, NULL, NULL FROM ({Q['category_mix']})
  UNION ALL {_CLIENTS.format('client_value')} FROM fx_client_value
  UNION ALL {_CLIENTS.format('top_clients')} FROM ({Q['top_clients']})
  UNION ALL
  SELECT 'repeat_rate', '', CAST(repeat_buyers AS DOUBLE), CAST(total_clients AS DOUBLE), repeat_rate_pct, NULL FROM ({Q['repeat_rate']})"""
Q["stream_dashboard"] = Q["dashboard"]
Q["stock_copartitioned"] = Q["stock_deduct"]
Q["scan_quarantine"] = """
  SELECT sheet, row_pos, CASE WHEN outcome = 'kept' THEN paid_text END AS paid_text, outcome
  FROM (SELECT *, CASE WHEN row_pos % 19 IN (3, 4) THEN 'malformed'
               WHEN payment_status IS NULL THEN 'missing payment_status' ELSE 'kept' END AS outcome FROM fx_sales),
       (VALUES ('csv'), ('json')) v(sheet)"""


def _written(usual: str, other: str, by: int) -> str:
    return (f"CASE o_orderkey % {by} WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN strftime(o_orderdate, '{other}') "
            f"WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN strftime(o_orderdate, '%B %d, %Y') "
            f"ELSE strftime(o_orderdate, '{usual}') END")


FIXTURES["fx_dated"] = f"""
  SELECT o_orderkey AS row_pos, {_written('%d/%m/%Y', '%m/%d/%Y', 23)} AS here,
    {_written('%m/%d/%Y', '%d/%m/%Y', 29)} AS there FROM orders"""


def _read(c: str, slashes: str) -> str:
    return "COALESCE(" + ", ".join(f"try_strptime({c}, '{f}')" for f in (slashes, "%Y-%m-%d", "%B %d, %Y")) + ")"


def _votes(c: str, slash_order: str) -> str:
    day, month = f"try_strptime({c}, '%d/%m/%Y') IS NOT NULL", f"try_strptime({c}, '%m/%d/%Y') IS NOT NULL"
    other = f"COALESCE(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%B %d, %Y')) IS NOT NULL"
    return f"""SELECT '{c}' AS column_name, count(*) AS n_values, count(*) FILTER ({c} = '') AS blank,
    count(*) FILTER ({day} AND NOT {month}) AS day_first, count(*) FILTER ({month} AND NOT {day}) AS month_first,
    count(*) FILTER ({day} AND {month}) AS either, count(*) FILTER ({other}) AS other_formats,
    count(*) FILTER ({c} = 'soon') AS no_date, '{slash_order}' AS slash_order FROM fx_dated"""


Q["column_formats"] = _votes("here", "day first") + " UNION ALL " + _votes("there", "month first")
Q["voted_dates"] = f"""SELECT row_pos, {_read('here', '%d/%m/%Y')} AS here_ts, {_read('there', '%m/%d/%Y')} AS there_ts
  FROM fx_dated"""
Q["stream_ingest"] = Q["normalize_sales"]
Q["stream_daily_trend"] = f"""SELECT CAST(sale_date AS DATE) AS sale_day, CAST(sum(paid) AS DOUBLE) AS gross_revenue,
  CAST(sum(paid - cost - courier) AS DOUBLE) AS true_profit FROM fx_sales_t
  WHERE {paid()} AND sale_date IS NOT NULL GROUP BY 1"""
Q["stream_sessions"] = Q["sessions"]
Q["stream_late"] = Q["stream_daily_trend"]
Q["stream_weekly_clients"] = f"""
  SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, count(DISTINCT handle) AS clients
  FROM (SELECT handle, date_trunc('day', sale_date) - to_days(CAST(k AS INTEGER)) AS window_start
        FROM fx_sales_t, range(0, 7) r(k)
        WHERE {paid()} AND sale_date IS NOT NULL AND handle IS NOT NULL)
  GROUP BY window_start"""
Q["client_sketches"] = "SELECT *, true AS within_bound FROM (" + Q["stream_weekly_clients"] + ")"
Q["client_value_protected"] = "SELECT * FROM fx_client_value"
Q["stream_stock"] = f"""
  SELECT sku, CAST(arg_max(stock, rn) AS BIGINT) AS closing_stock, count(*) AS movements FROM (
    SELECT sku, x + greatest(0, max(-x) OVER w) AS stock, row_number() OVER w AS rn
    FROM (SELECT *, greatest(s0, 0) + sum(delta) OVER w AS x FROM fx_movements
          WINDOW w AS (PARTITION BY sku ORDER BY ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, delta
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    WINDOW w AS (PARTITION BY sku ORDER BY ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, delta
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  GROUP BY sku"""
Q["stream_late_stock"] = Q["stream_stock"]
# the newer texts of each step feed the next; SKUs that are deleted had the text '0' at first
Q["vault_changes"] = f"""
  SELECT row_pos, sku, CASE WHEN sold IS NOT NULL AND n IS NOT NULL THEN CAST(greatest(0, n - sold) AS VARCHAR) ELSE t END AS stock_text
  FROM (SELECT r.row_pos, r.sku, r.new_stock_text AS t, r.old_stock_text AS first_text,
          CASE WHEN trim(r.new_stock_text) = '' THEN 0 ELSE TRY_CAST(r.new_stock_text AS BIGINT) END AS n,
          CASE WHEN d.sold_qty > 0 THEN d.sold_qty END AS sold
        FROM ({Q["stock_restock"]}) r JOIN ({Q["stock_deduct"]}) d ON r.row_pos = d.row_pos)
  WHERE first_text <> '0'"""
Q["stream_upsert"] = f"SELECT row_pos, sku, new_stock_text FROM ({Q['stock_deduct']})"


def _deps(body: str) -> list[str]:
    """Fixture CTEs a body needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in re.findall(r"\b(fx_\w+)\b", FIXTURES[name]):
            if dep in FIXTURES and dep != name:
                visit(dep)
        order.append(name)

    for name in re.findall(r"\b(fx_\w+)\b", body):
        if name in FIXTURES:
            visit(name)
    return order


def sql_for(name: str) -> str:
    body = Q[name]
    ctes = _deps(body)
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{c} AS ({FIXTURES[c]})" for c in ctes) + "\n" + body


def all_sql() -> dict[str, str]:
    return {k: sql_for(k) for k in Q}
