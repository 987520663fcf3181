"""DuckDB oracle SQL for every registered query.

Each oracle restates the definition of an operator in plain SQL over the
pre-registered test tables (window functions, recursive CTEs, joins): it
is the brute-force twin of the Spark job, not a translation of it. The
derived planner tables (shipments, coverage, capacity, estimates, print
configuration) are the CTEs below, written to give identical values to
``capaflow.sources.testdata``.
"""

from __future__ import annotations

TS = "'%Y-%m-%dT%H:%M:%S.%gZ'"

BASE = f"""
shipments AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS request_id,
         'IUN-' || l_orderkey AS iun,
         'REC-' || o_custkey AS recipient_id,
         CASE l_returnflag WHEN 'A' THEN 'AR' WHEN 'N' THEN '890' ELSE 'RS' END AS product_type,
         CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS attempt,
         'PA' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') AS sender_pa_id,
         n_name AS province, r_name AS region,
         lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(l_partkey % 5 AS VARCHAR), 3, '0') AS cap,
         strftime(l_shipdate, {TS}) AS notification_sent_at,
         strftime(o_orderdate, {TS}) AS prepare_request_date,
         CAST(date_trunc('week', date_trunc('quarter', l_shipdate)) AS DATE) AS delivery_week,
         'TENDER_1' AS tender_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
coverage AS (
  SELECT 'TENDER_1' AS tender_id,
         lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || lpad(CAST(k AS VARCHAR), 3, '0') AS cap,
         p AS product_type, n_name AS province, n_nationkey AS nation_key,
         'DRV_' || chr(CAST(65 + (n_nationkey + CASE WHEN n_nationkey % 3 = 0 THEN 0
                                                    WHEN n_nationkey % 3 = 1 THEN (CASE WHEN p = '890' THEN 1 ELSE 0 END)
                                                    ELSE (CASE WHEN k <= 2 THEN 0 WHEN p = 'AR' THEN 1 ELSE 2 END) END) % 4 AS INTEGER))
           AS unified_delivery_driver
  FROM nation, range(5) t(k), (VALUES ('AR'), ('890'), ('RS')) pp(p)
  WHERE NOT (n_nationkey = 23 AND k = 4 AND p = 'RS')),
ship_drv AS (
  SELECT s.*, c.unified_delivery_driver AS cov_driver
  FROM shipments s JOIN coverage c ON s.cap = c.cap AND s.product_type = c.product_type),
base_prov AS (
  SELECT province, unified_delivery_driver, sum(n) // count(*) AS base
  FROM (SELECT province, cov_driver AS unified_delivery_driver, delivery_week, count(*) AS n
        FROM ship_drv GROUP BY ALL) GROUP BY ALL),
base_cap AS (
  SELECT cap, unified_delivery_driver, sum(n) // count(*) AS base
  FROM (SELECT cap, cov_driver AS unified_delivery_driver, delivery_week, count(*) AS n
        FROM ship_drv GROUP BY ALL) GROUP BY ALL),
prov_products AS (
  SELECT province, unified_delivery_driver, list_sort(list_distinct(list(product_type))) AS products,
         min(nation_key) AS nation_key
  FROM coverage GROUP BY ALL),
capacity AS (
  SELECT 'TENDER_1' AS tender_id, b.unified_delivery_driver, b.province AS geo_key, 'PROVINCE' AS geo_level,
         b.province, v.f AS activation_from, v.t AS activation_to,
         CAST(CASE v.i WHEN 1 THEN (b.base * 9) // 10 WHEN 2 THEN (b.base * 11) // 10
                       ELSE (CASE WHEN pp.nation_key % 5 = 0 THEN 0 ELSE (b.base * 7) // 10 END) END AS INTEGER) AS capacity,
         pp.products
  FROM base_prov b JOIN prov_products pp USING (province, unified_delivery_driver),
       (VALUES (1, '1990-01-01T00:00:00.000Z', '1998-06-30T23:59:59.999Z'),
               (2, '1997-01-01T00:00:00.000Z', NULL),
               (3, '1999-01-01T00:00:00.000Z', '1999-12-31T23:59:59.999Z')) v(i, f, t)
  UNION ALL
  SELECT 'TENDER_1', b.unified_delivery_driver, b.cap, 'CAP', cp.province, v.f, v.t,
         CAST(CASE v.i WHEN 1 THEN (b.base * (CAST(substr(b.cap, 3, 3) AS INTEGER) + 8)) // 10
                       ELSE (b.base * (CAST(substr(b.cap, 3, 3) AS INTEGER) + 5)) // 10 END AS INTEGER),
         CAST(NULL AS VARCHAR[])
  FROM base_cap b JOIN (SELECT DISTINCT cap, province FROM coverage) cp USING (cap),
       (VALUES (1, '1990-01-01T00:00:00.000Z', NULL),
               (2, '2000-01-01T00:00:00.000Z', '2000-12-31T23:59:59.999Z')) v(i, f, t)),
est_counts AS (
  SELECT sender_pa_id, product_type, province, delivery_week, count(*) AS n
  FROM shipments WHERE product_type IN ('AR', '890') GROUP BY ALL),
estimates AS (
  SELECT sender_pa_id AS pa_id, product_type, province,
         CAST(date_trunc('week', delivery_week + INTERVAL 3 MONTH) AS DATE) - 7 AS delivery_date,
         CAST((n * 4) // 5 AS INTEGER) AS weekly_estimate,
         CAST(((n * 4) // 5) * 4 AS DOUBLE) AS monthly_estimate,
         CAST(n AS INTEGER) AS original_estimate,
         strftime(CAST(date_trunc('week', delivery_week + INTERVAL 3 MONTH) AS DATE) - 7, '%Y-%m-%d')
           || 'T00:00:00.000Z' AS last_update,
         'orders/' || sender_pa_id || '/'
           || strftime(CAST(date_trunc('week', delivery_week + INTERVAL 3 MONTH) AS DATE) - 7, '%Y-%m-%d')
           || '.json' AS file_key
  FROM est_counts),
avg_week AS (
  SELECT sum(n) // count(*) AS avg_week FROM (SELECT delivery_week, count(*) AS n FROM shipments GROUP BY 1)),
print_config AS (
  SELECT DATE '1970-01-01' AS start_date, CAST(avg_week // 12 AS INTEGER) AS daily_capacity,
         17 AS executions_per_day FROM avg_week
  UNION ALL
  SELECT DATE '1998-01-01', CAST(avg_week // 9 AS INTEGER), 17 FROM avg_week),
priority_map AS (
  SELECT * FROM (VALUES (1, 'PRODUCT_RS.ATTEMPT_0'), (2, 'PRODUCT_AR.ATTEMPT_1'),
                        (2, 'PRODUCT_890.ATTEMPT_1'), (3, 'PRODUCT_AR.ATTEMPT_0'),
                        (3, 'PRODUCT_890.ATTEMPT_0')) v(priority, priority_key))
"""

# --- sender step ------------------------------------------------------------
SENDER = f"""
pw AS (SELECT DISTINCT tender_id, province, delivery_week FROM shipments),
drivers AS (
  SELECT pw.tender_id, pw.province, pw.delivery_week, c.unified_delivery_driver,
         arg_max(c.capacity, c.activation_from) AS capacity,
         arg_max(c.products, c.activation_from) AS products,
         max(c.activation_from) AS activation_from
  FROM pw JOIN capacity c ON c.tender_id = pw.tender_id AND c.province = pw.province
                         AND c.geo_key = c.province
  WHERE c.activation_from <= strftime(CAST(pw.delivery_week AS TIMESTAMP), {TS})
    AND (c.activation_to IS NULL OR c.activation_to = ''
         OR c.activation_to >= strftime(CAST(pw.delivery_week AS TIMESTAMP), {TS}))
  GROUP BY ALL),
dp AS (SELECT tender_id, province, delivery_week, unified_delivery_driver, unnest(products) AS p FROM drivers),
adj AS (
  SELECT DISTINCT x.tender_id, x.province, x.delivery_week, x.p AS a, y.p AS b
  FROM dp x JOIN dp y ON x.tender_id = y.tender_id AND x.province = y.province
                     AND x.delivery_week = y.delivery_week
                     AND x.unified_delivery_driver = y.unified_delivery_driver),
reach AS (
  WITH RECURSIVE r(tender_id, province, delivery_week, a, b) AS (
    SELECT * FROM adj
    UNION
    SELECT r.tender_id, r.province, r.delivery_week, r.a, adj.b
    FROM r JOIN adj ON r.tender_id = adj.tender_id AND r.province = adj.province
                   AND r.delivery_week = adj.delivery_week AND r.b = adj.a)
  SELECT * FROM r),
comp_of AS (SELECT tender_id, province, delivery_week, a, min(b) AS component FROM reach GROUP BY ALL),
components AS (
  SELECT d.tender_id, d.province, d.delivery_week, co.component,
         list_sort(list_distinct(flatten(list(d.products)))) AS products,
         list_sort(list(d.unified_delivery_driver)) AS drivers,
         CAST(sum(d.capacity) AS BIGINT) AS capacity
  FROM drivers d JOIN comp_of co ON co.tender_id = d.tender_id AND co.province = d.province
                               AND co.delivery_week = d.delivery_week AND co.a = d.products[1]
  GROUP BY ALL),
exempt_counters AS (
  SELECT delivery_week, province, product_type, count(*) AS number_of_shipments
  FROM shipments WHERE upper(product_type) = 'RS' OR attempt = 1 GROUP BY ALL),
comp_excl AS (
  SELECT c.tender_id, c.province, c.delivery_week, c.component, sum(e.number_of_shipments) AS excl
  FROM (SELECT tender_id, province, delivery_week, component, unnest(products) AS product_type FROM components) c
  JOIN exempt_counters e USING (delivery_week, province, product_type)
  GROUP BY ALL),
net AS (
  SELECT c.*, CAST(greatest(0, c.capacity - coalesce(x.excl, 0)) AS BIGINT) AS net_capacity
  FROM components c LEFT JOIN comp_excl x USING (tender_id, province, delivery_week, component)),
totals AS (
  SELECT delivery_date, product_type, province, last_update,
         CAST(sum(weekly_estimate) AS BIGINT) AS number_of_shipments
  FROM estimates GROUP BY ALL),
latest AS (
  SELECT delivery_date, product_type, province,
         arg_max(number_of_shipments, last_update) AS total_estimate
  FROM totals GROUP BY ALL),
lt AS (SELECT delivery_date + 7 AS delivery_week, product_type, province, total_estimate FROM latest),
comp_products AS (
  SELECT province, delivery_week, component, unnest(products) AS product_type FROM net),
relevant AS (
  SELECT cp.province, cp.delivery_week, cp.component, count(*) AS n_rel,
         sum(coalesce(lt.total_estimate, 0)) AS sum_rel
  FROM comp_products cp LEFT JOIN lt USING (delivery_week, province, product_type)
  WHERE upper(cp.product_type) <> 'RS' GROUP BY ALL),
limits AS (
  SELECT e.pa_id AS sender_pa_id, e.product_type, e.province, e.delivery_date + 7 AS delivery_week,
         e.weekly_estimate, cp.component, n.net_capacity,
         CASE WHEN r.n_rel > 1 THEN r.sum_rel ELSE coalesce(lt.total_estimate, 0) END AS total
  FROM estimates e
  LEFT JOIN comp_products cp ON cp.province = e.province AND cp.delivery_week = e.delivery_date + 7
                            AND cp.product_type = e.product_type
  LEFT JOIN net n ON n.province = e.province AND n.delivery_week = e.delivery_date + 7
                 AND n.component = cp.component
  LEFT JOIN relevant r ON r.province = e.province AND r.delivery_week = e.delivery_date + 7
                      AND r.component = cp.component
  LEFT JOIN lt ON lt.delivery_week = e.delivery_date + 7 AND lt.province = e.province
              AND lt.product_type = e.product_type),
sender_limits AS (
  SELECT delivery_week, province, sender_pa_id, product_type, weekly_estimate,
         CAST(total AS BIGINT) AS total_estimate, net_capacity,
         CAST(CASE WHEN component IS NULL OR total = 0 THEN 0
                   ELSE floor(CAST(net_capacity AS DOUBLE) * (CAST(weekly_estimate AS DOUBLE) / CAST(total AS DOUBLE)))
              END AS INTEGER) AS sender_limit
  FROM limits),
sole AS (
  SELECT tender_id, province, delivery_week, min(drivers[1]) AS sole_driver
  FROM components GROUP BY ALL HAVING count(*) = 1 AND sum(len(drivers)) = 1),
enriched AS (
  SELECT s.*, coalesce(so.sole_driver, c.unified_delivery_driver) AS unified_delivery_driver,
         coalesce(pm.priority, 3) AS priority,
         CASE WHEN upper(s.product_type) = 'RS' OR s.attempt = 1 THEN s.prepare_request_date
              ELSE s.notification_sent_at END AS rank_date,
         (upper(s.product_type) = 'RS' OR s.attempt = 1) AS exempt
  FROM shipments s
  LEFT JOIN coverage c ON c.tender_id = s.tender_id AND c.cap = s.cap AND c.product_type = s.product_type
  LEFT JOIN (SELECT priority_key, min(priority) AS priority FROM priority_map GROUP BY 1) pm
         ON pm.priority_key = 'PRODUCT_' || s.product_type || '.ATTEMPT_' || CAST(s.attempt AS VARCHAR)
  LEFT JOIN sole so ON so.tender_id = s.tender_id AND so.province = s.province
                   AND so.delivery_week = s.delivery_week),
split AS (
  SELECT e.*, l.sender_limit,
         row_number() OVER (PARTITION BY e.delivery_week, e.province, e.sender_pa_id, e.product_type
                            ORDER BY e.rank_date, e.request_id) AS sender_rank
  FROM enriched e LEFT JOIN sender_limits l
    ON l.delivery_week = e.delivery_week AND l.province = e.province
   AND l.sender_pa_id = e.sender_pa_id AND l.product_type = e.product_type
  WHERE NOT e.exempt AND e.unified_delivery_driver IS NOT NULL),
sender_split AS (
  SELECT *, CASE WHEN sender_rank <= coalesce(sender_limit, 0) THEN 'EVALUATE_DRIVER_CAPACITY'
                 ELSE 'EVALUATE_RESIDUAL_CAPACITY' END AS next_step FROM split
  UNION ALL BY NAME
  SELECT *, CAST(NULL AS INTEGER) AS sender_limit, CAST(NULL AS BIGINT) AS sender_rank,
         'EVALUATE_DRIVER_CAPACITY' AS next_step FROM enriched WHERE exempt AND unified_delivery_driver IS NOT NULL)
"""


def _in_force(name: str, needs: str) -> str:
    """JOIN-01 as SQL: newest valid version per need, else 0."""
    return f"""
{name} AS (
  SELECT n.tender_id, n.unified_delivery_driver, n.geo_key, n.delivery_week,
         coalesce((SELECT arg_max(c.capacity, c.activation_from) FROM capacity c
                   WHERE c.tender_id = n.tender_id AND c.unified_delivery_driver = n.unified_delivery_driver
                     AND c.geo_key = n.geo_key
                     AND c.activation_from <= strftime(CAST(n.delivery_week AS TIMESTAMP), {TS})
                     AND (c.activation_to IS NULL OR c.activation_to = ''
                          OR c.activation_to >= strftime(CAST(n.delivery_week AS TIMESTAMP), {TS}))), 0)
           AS declared_capacity
  FROM (SELECT DISTINCT * FROM ({needs})) n)"""


def _alloc(prefix: str, rows: str, order: str, used: str | None) -> str:
    """Two running positions compared with limits (cap, then province)."""
    if used is None:
        prov_used = "0"
        prov_decl = "pf.declared_capacity"
        cap_used = "0"
        cap_decl = "cf.declared_capacity"
        used_join_p = used_join_c = ""
    else:
        prov_used = "coalesce(up.used_capacity, 0)"
        prov_decl = "CASE WHEN up.used_capacity IS NOT NULL THEN up.declared_capacity ELSE pf.declared_capacity END"
        cap_used = "coalesce(uc.used_capacity, 0)"
        cap_decl = "CASE WHEN uc.used_capacity IS NOT NULL THEN uc.declared_capacity ELSE cf.declared_capacity END"
        used_join_p = (f"LEFT JOIN {used} up ON up.unified_delivery_driver = r.unified_delivery_driver "
                       "AND up.geo_key = r.province AND up.delivery_week = r.delivery_week")
        used_join_c = (f"LEFT JOIN {used} uc ON uc.unified_delivery_driver = r.unified_delivery_driver "
                       "AND uc.geo_key = r.cap AND uc.delivery_week = r.delivery_week")
    return f"""
{_in_force(prefix + '_pf', f"SELECT tender_id, unified_delivery_driver, province AS geo_key, delivery_week FROM {rows}")},
{_in_force(prefix + '_cf', f"SELECT tender_id, unified_delivery_driver, cap AS geo_key, delivery_week FROM {rows}")},
{prefix}_lim AS (
  SELECT r.*, {prov_decl} AS prov_declared, {prov_decl} - {prov_used} AS prov_residual,
         {cap_decl} AS cap_declared, greatest(0, {cap_decl} - {cap_used}) AS cap_residual
  FROM {rows} r
  LEFT JOIN {prefix}_pf pf ON pf.tender_id = r.tender_id AND pf.unified_delivery_driver = r.unified_delivery_driver
                         AND pf.geo_key = r.province AND pf.delivery_week = r.delivery_week
  LEFT JOIN {prefix}_cf cf ON cf.tender_id = r.tender_id AND cf.unified_delivery_driver = r.unified_delivery_driver
                         AND cf.geo_key = r.cap AND cf.delivery_week = r.delivery_week
  {used_join_p}
  {used_join_c}),
{prefix}_cap AS (
  SELECT *, row_number() OVER (PARTITION BY delivery_week, unified_delivery_driver, province, cap
                               ORDER BY {order}) AS cap_pos
  FROM {prefix}_lim),
{prefix}_elig AS (
  SELECT *, row_number() OVER (PARTITION BY delivery_week, unified_delivery_driver, province
                               ORDER BY {order}) AS prov_pos
  FROM {prefix}_cap WHERE cap_pos <= cap_residual),
{prefix} AS (
  SELECT *, coalesce(prov_pos <= prov_residual, false) AS accepted FROM {prefix}_elig
  UNION ALL BY NAME
  SELECT *, CAST(NULL AS BIGINT) AS prov_pos, false AS accepted FROM {prefix}_cap
  WHERE NOT coalesce(cap_pos <= cap_residual, false))"""


def _used(name: str, alloc: str, previous: str | None) -> str:
    inc = f"""
  SELECT unified_delivery_driver, province AS geo_key, delivery_week, 'PROVINCE' AS geo_level,
         CAST(count(*) FILTER (WHERE accepted) AS INTEGER) AS inc, min(prov_declared) AS declared_capacity
  FROM {alloc} WHERE prov_residual > 0 GROUP BY ALL
  UNION ALL
  SELECT unified_delivery_driver, cap, delivery_week, 'CAP', CAST(count(*) AS INTEGER), min(cap_declared)
  FROM {alloc} WHERE accepted GROUP BY ALL"""
    if previous is None:
        return f"""
{name} AS (
  SELECT unified_delivery_driver, geo_key, delivery_week, geo_level, inc AS used_capacity, declared_capacity
  FROM ({inc}))"""
    return f"""
{name} AS (
  SELECT coalesce(i.unified_delivery_driver, p.unified_delivery_driver) AS unified_delivery_driver,
         coalesce(i.geo_key, p.geo_key) AS geo_key,
         coalesce(i.delivery_week, p.delivery_week) AS delivery_week,
         coalesce(i.geo_level, p.geo_level) AS geo_level,
         CAST(coalesce(i.inc, 0) + coalesce(p.used_capacity, 0) AS INTEGER) AS used_capacity,
         coalesce(i.declared_capacity, p.declared_capacity) AS declared_capacity
  FROM ({inc}) i FULL JOIN {previous} p
    ON i.unified_delivery_driver = p.unified_delivery_driver AND i.geo_key = p.geo_key
   AND i.delivery_week = p.delivery_week)"""


CAPACITY = ",\n".join([
    "drv_rows AS (SELECT * FROM sender_split WHERE next_step = 'EVALUATE_DRIVER_CAPACITY')",
    _alloc("drv", "drv_rows", "CAST(priority AS VARCHAR), rank_date, request_id", None),
    _used("used1", "drv", None),
    "res_rows AS (SELECT * FROM sender_split WHERE next_step = 'EVALUATE_RESIDUAL_CAPACITY')",
    _alloc("res", "res_rows", "rank_date, request_id", "used1"),
    _used("used2", "res", "used1"),
])

PRINT = """
print_rows AS (
  SELECT *, 'EVALUATE_DRIVER_CAPACITY' AS via_step FROM drv WHERE accepted
  UNION ALL BY NAME
  SELECT *, 'EVALUATE_RESIDUAL_CAPACITY' AS via_step FROM res WHERE accepted),
print_cap AS (
  SELECT w.delivery_week, arg_max(pc.daily_capacity, pc.start_date) AS daily_print_capacity,
         arg_max(pc.executions_per_day, pc.start_date) AS executions_per_day
  FROM (SELECT DISTINCT delivery_week FROM print_rows) w JOIN print_config pc ON pc.start_date <= w.delivery_week
  GROUP BY ALL),
queue AS (
  SELECT p.*, c.daily_print_capacity, c.executions_per_day,
         c.daily_print_capacity * 7 AS weekly_print_capacity,
         CAST(ceil(CAST(c.daily_print_capacity AS DOUBLE) / CAST(c.executions_per_day AS DOUBLE)) AS INTEGER) AS slice_size,
         row_number() OVER (PARTITION BY p.delivery_week
                            ORDER BY CAST(p.priority AS VARCHAR), p.rank_date, p.request_id) AS print_pos
  FROM print_rows p JOIN print_cap c USING (delivery_week)),
released AS (
  SELECT *, print_pos <= weekly_print_capacity AS released,
         CASE WHEN print_pos <= weekly_print_capacity
              THEN CAST(ceil(CAST(print_pos AS DOUBLE) / CAST(daily_print_capacity AS DOUBLE)) AS INTEGER) END AS release_day
  FROM queue),
release_plan AS (
  SELECT *, CASE WHEN released THEN CAST(ceil(CAST(print_pos - (release_day - 1) * daily_print_capacity AS DOUBLE)
                                              / CAST(slice_size AS DOUBLE)) AS INTEGER) END AS release_no,
         CASE WHEN released THEN 'SENT_TO_PREPARE_PHASE_2' ELSE 'EVALUATE_SENDER_LIMIT' END AS next_step2,
         CASE WHEN released THEN delivery_week ELSE delivery_week + 7 END AS next_week
  FROM released)
"""


def with_ctes(*blocks: str, select: str) -> str:
    if not blocks:
        return select
    return "WITH " + ",\n".join(b.strip().rstrip(",") for b in blocks) + "\n" + select


PLAN = (BASE, SENDER, CAPACITY, PRINT)


def _ledger_part(src: str, step: str, week: str, hours: int, driver: str = "unified_delivery_driver",
                 prio: str = "priority", where: str = "") -> str:
    return f"""
  SELECT {week} AS delivery_week, '{step}' AS workflow_step,
         strftime({week}, '%Y-%m-%d') || '~{step}' AS pk, request_id, iun, product_type, attempt,
         sender_pa_id, province, cap, {driver} AS unified_delivery_driver, {prio} AS priority,
         prepare_request_date, notification_sent_at,
         strftime(CAST(delivery_week AS TIMESTAMP) + INTERVAL {hours} HOUR, {TS}) AS created_at
  FROM {src} {where}"""


LEDGER = "ledger AS (" + "\n  UNION ALL".join([
    _ledger_part("shipments", "EVALUATE_SENDER_LIMIT", "delivery_week", 0,
                 "CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)"),
    _ledger_part("sender_split", "EVALUATE_DRIVER_CAPACITY", "delivery_week", 1,
                 where="WHERE next_step = 'EVALUATE_DRIVER_CAPACITY'"),
    _ledger_part("sender_split", "EVALUATE_RESIDUAL_CAPACITY", "delivery_week", 1,
                 where="WHERE next_step = 'EVALUATE_RESIDUAL_CAPACITY'"),
    _ledger_part("release_plan", "EVALUATE_PRINT_CAPACITY", "delivery_week", 2),
    _ledger_part("release_plan", "SENT_TO_PREPARE_PHASE_2", "delivery_week", 3, where="WHERE released"),
    _ledger_part("drv", "EVALUATE_SENDER_LIMIT", "delivery_week + 7", 4, where="WHERE NOT accepted"),
    _ledger_part("res", "EVALUATE_SENDER_LIMIT", "delivery_week + 7", 4, where="WHERE NOT accepted"),
    _ledger_part("release_plan", "EVALUATE_SENDER_LIMIT", "delivery_week + 7", 4, where="WHERE NOT released"),
]) + ")"

HISTORY = PLAN + (LEDGER,)

# events as shipment records (stream source mapping; see capaflow.sources.events)
EVENTS = f"""
event_records AS (
  SELECT event_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS sequence_number, ts,
         'EVT-' || CAST(user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS request_id,
         'IUN-E' || CAST(event_id AS VARCHAR) AS iun,
         CASE event_type WHEN 'click' THEN 'AR' WHEN 'view' THEN '890' WHEN 'purchase' THEN 'RS'
                         WHEN 'signup' THEN 'AR' ELSE '890' END AS product_type,
         CASE WHEN event_type = 'error' THEN NULL
              WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 7 THEN 1 ELSE 0 END AS attempt,
         'PA' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS sender_pa_id,
         'NATION_' || CAST(user_id % 25 AS VARCHAR) AS province,
         lpad(CAST(user_id % 25 AS VARCHAR), 2, '0')
           || lpad(CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR), 3, '0') AS cap,
         CASE WHEN event_type = 'view' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN ''
              ELSE strftime(ts - INTERVAL 1 DAY, {TS}) END AS notification_sent_at,
         strftime(ts, {TS}) AS prepare_request_date
  FROM events)
"""
