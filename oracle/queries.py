"""Oracle SQL per registered query (DuckDB dialect)."""

from __future__ import annotations

from oracle.sql import BASE, CAPACITY, PLAN, PRINT, SENDER, TS, with_ctes

ORACLES: dict[str, str] = {}


def d(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


def q(name: str, *blocks: str, select: str) -> None:
    ORACLES[name] = with_ctes(*blocks, select=select)


# Values of the order documents at their three levels.
DOC_ROWS = """
  SELECT sender_pa_id AS pa_id, CAST(substr(notification_sent_at, 1, 7) || '-01' AS DATE) AS month,
         product_type, 'V' || CAST(attempt + 1 AS VARCHAR) AS variant, region, count(*) AS value
  FROM shipments GROUP BY ALL"""


PLACED = """
SELECT request_id, delivery_week, unified_delivery_driver, CAST(priority AS BIGINT) AS priority, via_step,
       next_step2 AS final_step, next_week AS final_week, CAST(release_day AS BIGINT) AS release_day,
       CAST(release_no AS BIGINT) AS release_no
FROM release_plan
UNION ALL
SELECT request_id, delivery_week, unified_delivery_driver, CAST(priority AS BIGINT), via, 'EVALUATE_SENDER_LIMIT',
       delivery_week + 7, NULL, NULL
FROM (SELECT *, 'EVALUATE_DRIVER_CAPACITY' AS via FROM drv UNION ALL BY NAME
      SELECT *, 'EVALUATE_RESIDUAL_CAPACITY' AS via FROM res) WHERE NOT accepted
UNION ALL
SELECT request_id, delivery_week, NULL, CAST(priority AS BIGINT), 'EVALUATE_SENDER_LIMIT', 'NO_DRIVER', delivery_week, NULL, NULL
FROM enriched WHERE unified_delivery_driver IS NULL"""
AS_TEXT = f"* REPLACE ({d('delivery_week')} AS delivery_week, {d('final_week')} AS final_week)"
q("weekly_plan", *PLAN, f"placed AS ({PLACED})", select=f"SELECT {AS_TEXT} FROM placed")

# The second round plans what the first pushed to its next week, where no other shipment is;
# carried shipments are not counted as exempt ones again.
_STEPS = ",\n".join(b.strip() for b in (SENDER, CAPACITY, PRINT))
_LATER = _STEPS.replace("FROM shipments WHERE upper(product_type)", "FROM (FROM shipments WHERE false) WHERE upper(product_type)")
q("weekly_plan_chained", BASE, f"""
round1 AS (WITH {_STEPS} {PLACED}),
later AS (SELECT s.* REPLACE (r.final_week AS delivery_week) FROM shipments s JOIN round1 r USING (request_id)
          WHERE r.final_step = 'EVALUATE_SENDER_LIMIT'),
round2 AS (WITH shipments AS (SELECT * FROM later), {_LATER} {PLACED}),
placed AS (SELECT *, 1 AS attempts FROM round1 WHERE final_step <> 'EVALUATE_SENDER_LIMIT'
           UNION ALL SELECT *, 2 FROM round2 WHERE final_step <> 'EVALUATE_SENDER_LIMIT'
           UNION ALL SELECT request_id, final_week, NULL, NULL, NULL, final_step, final_week, NULL, NULL, 2
           FROM round2 WHERE final_step = 'EVALUATE_SENDER_LIMIT')""", select=f"SELECT {AS_TEXT} FROM placed")

q("alc_01", BASE, SENDER, select=f"""
SELECT request_id, {d('delivery_week')} AS delivery_week, province, sender_pa_id, product_type,
       exempt, CAST(sender_limit AS BIGINT) AS sender_limit, CAST(sender_rank AS BIGINT) AS sender_rank,
       next_step
FROM sender_split""")

q("alc_02", BASE, SENDER, select=f"""
SELECT {d('delivery_week')} AS delivery_week, next_step, exempt, count(*) AS n
FROM sender_split GROUP BY ALL""")

q("flt_02", BASE, select=f"""
SELECT {d('delivery_week')} AS delivery_week, province,
       (upper(product_type) = 'RS' OR attempt = 1) AS exempt, count(*) AS n
FROM shipments GROUP BY ALL""")

q("agg_03", BASE, SENDER, select=f"""
SELECT {d('delivery_week')} AS delivery_week, province, product_type, number_of_shipments
FROM exempt_counters""")

q("join_02", BASE, SENDER, select=f"""
SELECT tender_id, province, {d('delivery_week')} AS delivery_week, unified_delivery_driver,
       CAST(capacity AS BIGINT) AS capacity, array_to_string(products, ',') AS products
FROM drivers""")

q("agg_04", BASE, SENDER, select=f"""
SELECT tender_id, province, {d('delivery_week')} AS delivery_week, component,
       array_to_string(products, ',') AS products, array_to_string(drivers, ',') AS drivers, capacity
FROM components""")

q("agg_05", BASE, SENDER, select=f"""
SELECT tender_id, province, {d('delivery_week')} AS delivery_week, component,
       array_to_string(products, ',') AS products, array_to_string(drivers, ',') AS drivers,
       capacity, net_capacity
FROM net""")

q("agg_07", BASE, SENDER, select=f"""
SELECT {d('delivery_date')} AS delivery_date, product_type, province, last_update, number_of_shipments
FROM totals""")

q("agg_08", BASE, SENDER, select=f"""
SELECT {d('delivery_date')} AS delivery_date, product_type, province, total_estimate FROM latest""")

q("agg_09", BASE, SENDER, select=f"""
SELECT {d('l.delivery_week')} AS delivery_week, l.province, l.sender_pa_id, l.product_type,
       CAST(l.weekly_estimate AS BIGINT) AS weekly_estimate, l.total_estimate, l.net_capacity,
       CAST(l.sender_limit AS BIGINT) AS sender_limit
FROM sender_limits l
WHERE EXISTS (SELECT 1 FROM shipments s WHERE s.delivery_week = l.delivery_week
              AND s.province = l.province AND s.sender_pa_id = l.sender_pa_id
              AND s.product_type = l.product_type)""")

q("join_07", BASE, select=f"""
SELECT {d('p.delivery_week')} AS delivery_week, p.province, p.sender_pa_id, p.product_type,
       CAST(e.weekly_estimate AS BIGINT) AS weekly_estimate
FROM (SELECT DISTINCT delivery_week, province, sender_pa_id, product_type FROM shipments
      WHERE NOT (upper(product_type) = 'RS' OR attempt = 1)) p
LEFT JOIN estimates e ON e.pa_id = p.sender_pa_id AND e.product_type = p.product_type
      AND e.province = p.province AND e.delivery_date + 7 = p.delivery_week""")

q("agg_10", BASE, SENDER, select=f"""
SELECT sender_pa_id || '~' || product_type || '~' || province AS pk,
       {d('delivery_week - 7')} AS delivery_date, sender_pa_id AS pa_id, product_type, province,
       count(*) AS number_of_shipment, CAST(max(sender_limit) AS BIGINT) AS sender_limit
FROM sender_split WHERE NOT exempt AND next_step = 'EVALUATE_DRIVER_CAPACITY'
GROUP BY ALL""")

q("join_05", BASE, SENDER, select="""
SELECT request_id, unified_delivery_driver, CAST(priority AS BIGINT) AS priority FROM enriched""")

q("prj_04", BASE, select="""
SELECT s.product_type, CAST(s.attempt AS BIGINT) AS attempt, CAST(coalesce(pm.priority, 3) AS BIGINT) AS priority,
       count(*) AS n
FROM shipments s LEFT JOIN priority_map pm
  ON pm.priority_key = 'PRODUCT_' || s.product_type || '.ATTEMPT_' || CAST(s.attempt AS VARCHAR)
GROUP BY ALL""")

q("prj_01", BASE, select="""
SELECT request_id, CASE WHEN upper(product_type) = 'RS' OR attempt = 1 THEN prepare_request_date
                        ELSE notification_sent_at END AS rank_date
FROM shipments""")

ALLOC = f"""
SELECT request_id, {d('delivery_week')} AS delivery_week, unified_delivery_driver, province, cap,
       CAST(cap_declared AS BIGINT) AS cap_declared, CAST(cap_residual AS BIGINT) AS cap_residual,
       CAST(prov_declared AS BIGINT) AS prov_declared, CAST(prov_residual AS BIGINT) AS prov_residual,
       CAST(cap_pos AS BIGINT) AS cap_pos, CAST(prov_pos AS BIGINT) AS prov_pos, accepted
FROM {{t}}"""

q("join_01", BASE, SENDER, CAPACITY, select=f"""
SELECT tender_id, unified_delivery_driver, geo_key, {d('delivery_week')} AS delivery_week,
       CAST(declared_capacity AS BIGINT) AS declared_capacity FROM drv_pf
UNION
SELECT tender_id, unified_delivery_driver, geo_key, {d('delivery_week')},
       CAST(declared_capacity AS BIGINT) FROM drv_cf""")

q("alc_03", BASE, SENDER, CAPACITY, select=f"""
SELECT request_id, {d('delivery_week')} AS delivery_week, unified_delivery_driver, cap,
       CAST(cap_declared AS BIGINT) AS cap_declared, CAST(cap_residual AS BIGINT) AS cap_residual,
       CAST(cap_pos AS BIGINT) AS cap_pos, cap_pos <= cap_residual AS eligible
FROM drv""")

q("alc_04", BASE, SENDER, CAPACITY, select=ALLOC.format(t="drv"))
q("alc_06", BASE, SENDER, CAPACITY, select=ALLOC.format(t="res"))

q("alc_05", BASE, SENDER, CAPACITY, select="""
SELECT request_id, concat_ws('~', unified_delivery_driver, province, CAST(priority AS VARCHAR),
                             rank_date, request_id) AS sk
FROM drv""")

q("agg_11", BASE, SENDER, CAPACITY, select=f"""
SELECT unified_delivery_driver, geo_key, {d('delivery_week')} AS delivery_week, geo_level,
       CAST(used_capacity AS BIGINT) AS used_capacity, CAST(declared_capacity AS BIGINT) AS declared_capacity
FROM used2""")

q("join_04", BASE, SENDER, CAPACITY, select=f"""
SELECT n.tender_id, n.unified_delivery_driver, n.geo_key, {d('n.delivery_week')} AS delivery_week,
       CAST(CASE WHEN u.used_capacity IS NOT NULL THEN u.declared_capacity ELSE n.declared_capacity END AS BIGINT)
         AS declared_capacity,
       CAST(coalesce(u.used_capacity, 0) AS BIGINT) AS used_capacity
FROM (SELECT * FROM res_pf UNION SELECT * FROM res_cf) n
LEFT JOIN used1 u ON u.unified_delivery_driver = n.unified_delivery_driver AND u.geo_key = n.geo_key
                 AND u.delivery_week = n.delivery_week""")

q("alc_07", BASE, SENDER, CAPACITY, select=f"""
SELECT request_id, {d('delivery_week + 7')} AS next_week, 'EVALUATE_SENDER_LIMIT' AS workflow_step
FROM (SELECT request_id, delivery_week FROM drv WHERE NOT accepted
      UNION ALL SELECT request_id, delivery_week FROM res WHERE NOT accepted)""")

PRINT_CAP = f"""
SELECT {d('w.delivery_week')} AS delivery_week,
       CAST(arg_max(pc.daily_capacity, pc.start_date) AS BIGINT) AS daily_print_capacity,
       CAST(arg_max(pc.executions_per_day, pc.start_date) AS BIGINT) AS executions_per_day
FROM (SELECT DISTINCT delivery_week FROM shipments) w JOIN print_config pc ON pc.start_date <= w.delivery_week
GROUP BY ALL"""

q("alc_08", BASE, select=PRINT_CAP)
q("alc_09", BASE, select=f"""
SELECT delivery_week,
       CAST(ceil(CAST(daily_print_capacity AS DOUBLE) / CAST(executions_per_day AS DOUBLE)) AS BIGINT) AS slice_size
FROM ({PRINT_CAP})""")

q("alc_10", *PLAN, select=f"""
SELECT request_id, {d('delivery_week')} AS delivery_week, print_pos,
       CAST(release_day AS BIGINT) AS release_day, CAST(release_no AS BIGINT) AS release_no
FROM release_plan WHERE released""")

q("alc_11", *PLAN, select=f"""
SELECT request_id, print_pos, {d('next_week')} AS next_week FROM release_plan WHERE NOT released""")

q("alc_12", *PLAN, select=f"""
SELECT {d('delivery_week')} AS delivery_week, print_pos, request_id, page
FROM (SELECT *, count(*) OVER (PARTITION BY delivery_week) AS n FROM release_plan),
     (VALUES ('first', 0), ('next', 1000), ('last', NULL)) p(page, cursor)
WHERE CASE WHEN page = 'last' THEN print_pos > n - 1000 ELSE print_pos > cursor AND print_pos <= cursor + 1000 END""")

q("alc_13", *PLAN, select=f"""
SELECT {d('delivery_week')} AS delivery_week, CAST(release_day AS BIGINT) AS release_day,
       CAST(release_no AS BIGINT) AS release_no, count(*) AS sent,
       CAST(sum(count(*)) OVER (PARTITION BY delivery_week ORDER BY release_day, release_no
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sent_to_phase_two
FROM release_plan WHERE released GROUP BY delivery_week, release_day, release_no""")

q("agg_12", *PLAN, select=f"""
SELECT {d('delivery_week')} AS delivery_week, count(*) AS number_of_shipments,
       CAST(min(daily_print_capacity) AS BIGINT) AS daily_print_capacity,
       CAST(min(weekly_print_capacity) AS BIGINT) AS weekly_print_capacity,
       CAST(min(executions_per_day) AS BIGINT) AS daily_execution_number,
       count(*) FILTER (WHERE released) AS sent_to_phase_two,
       count(*) FILTER (WHERE NOT released) AS sent_to_next_week,
       count(*) FILTER (WHERE released) >= count(*) AS stop_send_to_phase_two
FROM release_plan GROUP BY delivery_week""")

# ====================== keys, filters, ledger, lookups, maintenance ======================
from oracle.sql import EVENTS, HISTORY  # noqa: E402

SK = """CASE workflow_step
  WHEN 'EVALUATE_SENDER_LIMIT' THEN concat_ws('~', province, rank_date, request_id)
  WHEN 'EVALUATE_DRIVER_CAPACITY' THEN concat_ws('~', unified_delivery_driver, province, CAST(priority AS VARCHAR), rank_date, request_id)
  WHEN 'EVALUATE_RESIDUAL_CAPACITY' THEN concat_ws('~', unified_delivery_driver, province, rank_date, request_id)
  ELSE concat_ws('~', CAST(priority AS VARCHAR), rank_date, request_id) END"""
RANKED_LEDGER = """ledger_r AS (
  SELECT *, CASE WHEN upper(product_type) = 'RS' OR attempt = 1 THEN prepare_request_date
                 ELSE notification_sent_at END AS rank_date FROM ledger)"""

q("prj_02", *HISTORY, RANKED_LEDGER, select=f"SELECT request_id, pk, {SK} AS sk FROM ledger_r")

q("prj_03", *HISTORY, select=f"""
SELECT {d('delivery_week')} AS delivery_week, workflow_step, pk, request_id, iun, product_type,
       CAST(attempt AS BIGINT) AS attempt, sender_pa_id, province, cap, unified_delivery_driver,
       CAST(priority AS BIGINT) AS priority, prepare_request_date, notification_sent_at, created_at
FROM ledger""")

q("prj_05", BASE, select="""
SELECT s.request_id, CASE WHEN pm.priority IS NOT NULL AND s.attempt IN (0, 1) THEN CAST(pm.priority AS BIGINT) END AS priority,
       CASE WHEN pm.priority IS NOT NULL AND s.attempt IN (0, 1) THEN 'OK' ELSE 'QUARANTINE' END AS status
FROM shipments s LEFT JOIN (SELECT priority_key, min(priority) AS priority FROM priority_map GROUP BY 1) pm
  ON pm.priority_key = 'PRODUCT_' || s.product_type || '.ATTEMPT_' || CAST(s.attempt AS VARCHAR)""")

q("prj_06", EVENTS, select=f"""
SELECT event_id, {d("CAST(ts AS DATE) + CAST(8 - isodow(CAST(ts AS DATE)) AS INTEGER)")} AS delivery_week FROM event_records""")

q("prj_07", EVENTS, select=f"""
SELECT event_id, {d("CAST(ts AS DATE) - CAST(isodow(CAST(ts AS DATE)) - 1 AS INTEGER)")} AS planning_week FROM event_records""")

q("flt_01", EVENTS, select="""
SELECT event_id, attempt IS NOT NULL AND coalesce(length(prepare_request_date) > 0, false)
                 AND coalesce(length(notification_sent_at) > 0, false) AS valid
FROM event_records""")

q("flt_03", *HISTORY, RANKED_LEDGER, select=f"""
SELECT pk, sk, request_id FROM (SELECT pk, request_id, {SK} AS sk FROM ledger_r
                                 WHERE workflow_step = 'EVALUATE_DRIVER_CAPACITY')
WHERE starts_with(sk, 'DRV_A~')""")

LATEST = """latest AS (
  SELECT request_id, arg_max(workflow_step, created_at) AS workflow_step, arg_max(pk, created_at) AS pk,
         max(created_at) AS created_at
  FROM ledger GROUP BY request_id)"""

q("flt_05", *HISTORY, LATEST.replace("latest AS", "latest_row AS"), select="""
SELECT request_id, workflow_step,
       workflow_step = 'EVALUATE_SENDER_LIMIT'
       AND try_strptime(split_part(pk, '~', 1), '%Y-%m-%d') IS NOT NULL
       AND CAST(try_strptime(split_part(pk, '~', 1), '%Y-%m-%d') AS DATE) <> DATE '1998-01-05' AS cancellable
FROM latest_row""")

q("flt_06", BASE, select="""
SELECT iun, 'PREPARE_' || request_id AS element_id,
       CASE WHEN product_type = 'RS' THEN 'PREPARE_SIMPLE_REGISTERED_LETTER' ELSE 'PREPARE_ANALOG_DOMICILE' END AS category
FROM shipments""")

q("agg_01", BASE, select=f"""
SELECT {d('delivery_week')} AS delivery_week, sender_pa_id, product_type, province, count(*) AS n
FROM shipments GROUP BY ALL""")

q("agg_02", BASE, select=f"""
SELECT {d('delivery_week')} AS delivery_week, 'cap' AS level, cap AS k1, NULL AS k2, NULL AS k3, count(*) AS n
FROM shipments GROUP BY delivery_week, cap
UNION ALL
SELECT {d('delivery_week')}, 'cap_product', cap, product_type, NULL, count(*)
FROM shipments GROUP BY delivery_week, cap, product_type
UNION ALL
SELECT {d('delivery_week')}, 'pa_product_province', sender_pa_id, product_type, province, count(*)
FROM shipments GROUP BY delivery_week, sender_pa_id, product_type, province""")

q("agg_06", *HISTORY, select=f"""
SELECT {d('delivery_week')} AS delivery_week, province, product_type, arg_min(n, src) AS number_of_shipments
FROM (SELECT delivery_week, province, product_type, number_of_shipments AS n, 1 AS src FROM exempt_counters
      UNION ALL
      SELECT delivery_week, province, product_type, count(*), 2 FROM ledger
      WHERE workflow_step = 'EVALUATE_SENDER_LIMIT' AND (upper(product_type) = 'RS' OR attempt = 1)
      GROUP BY ALL)
GROUP BY ALL""")

STRICT_DRIVERS = f"""
SELECT pw.tender_id, pw.province, {{wk}} AS {{wkname}}, c.unified_delivery_driver,
       CAST(arg_max(c.capacity, c.activation_from) AS BIGINT) AS capacity,
       array_to_string(arg_max(c.products, c.activation_from), ',') AS products
FROM (SELECT DISTINCT tender_id, province, {{wkexpr}} AS wk FROM shipments) pw
JOIN capacity c ON c.tender_id = pw.tender_id AND c.province = pw.province AND c.geo_key = c.province
WHERE c.activation_from < strftime(CAST(pw.wk AS TIMESTAMP), {TS})
  AND (c.activation_to IS NULL OR c.activation_to = '' OR c.activation_to > strftime(CAST(pw.wk AS TIMESTAMP), {TS}))
GROUP BY ALL"""

q("join_03", BASE, select=STRICT_DRIVERS.format(wk=d('pw.wk'), wkname="delivery_week", wkexpr="delivery_week"))
q("lkp_05", BASE, select=STRICT_DRIVERS.format(wk=d('pw.wk'), wkname="at_date", wkexpr="delivery_week + 3"))

q("join_06", BASE, select="""
SELECT DISTINCT s.tender_id, s.cap, s.product_type FROM shipments s
WHERE NOT EXISTS (SELECT 1 FROM coverage c WHERE c.tender_id = s.tender_id AND c.cap = s.cap
                  AND c.product_type = s.product_type)""")

STRICT = """strict AS (
  SELECT s.*, CASE WHEN pm.priority IS NOT NULL AND s.attempt IN (0, 1) THEN pm.priority END AS priority,
         CASE WHEN upper(s.product_type) = 'RS' OR s.attempt = 1 THEN s.prepare_request_date
              ELSE s.notification_sent_at END AS rank_date
  FROM shipments s LEFT JOIN (SELECT priority_key, min(priority) AS priority FROM priority_map GROUP BY 1) pm
    ON pm.priority_key = 'PRODUCT_' || s.product_type || '.ATTEMPT_' || CAST(s.attempt AS VARCHAR))"""

q("alc_14", BASE, STRICT, select=f"""
SELECT request_id, {d('delivery_week')} AS delivery_week,
       CASE WHEN priority IS NOT NULL THEN 'EVALUATE_PRINT_CAPACITY' ELSE 'QUARANTINE' END AS workflow_step,
       CAST(priority AS BIGINT) AS priority,
       CASE WHEN priority IS NOT NULL THEN concat_ws('~', CAST(priority AS VARCHAR), rank_date, request_id) END AS sk,
       CASE WHEN priority IS NOT NULL THEN count(priority) OVER (PARTITION BY delivery_week) END AS print_counter
FROM strict""")

q("alc_15", BASE, STRICT, select=f"""
SELECT request_id, {d('delivery_week')} AS queue_week,
       CASE queue WHEN 'current' THEN {d('delivery_week')} ELSE {d('delivery_week - 7')} END AS delivery_week, switch_pos,
       CAST(ceil(switch_pos / 5000) AS BIGINT) AS batch_no, 'SENT_TO_PREPARE_PHASE_2' AS workflow_step,
       CAST(priority AS BIGINT) AS priority, queue
FROM (SELECT *, row_number() OVER (PARTITION BY delivery_week
                                   ORDER BY concat_ws('~', province, rank_date, request_id)) AS switch_pos
      FROM strict WHERE priority IS NOT NULL), (VALUES ('current'), ('next')) modes(queue)
UNION ALL
SELECT request_id, {d('delivery_week')}, NULL, NULL, NULL, 'REJECTED', NULL, queue FROM strict, (VALUES ('current'), ('next')) modes(queue)
WHERE priority IS NULL""")

q("alc_17", *HISTORY, LATEST.replace("latest AS", "latest_row AS"),
  select="SELECT request_id, workflow_step, pk, created_at FROM latest_row")

q("set_03", EVENTS, select="""
SELECT request_id, min(sequence_number) AS sequence_number FROM event_records GROUP BY request_id""")

q("fn_01", *HISTORY, select="""
SELECT request_id, pk, split_part(pk, '~', 1) AS pk_week, split_part(pk, '~', 2) AS pk_step,
       concat_ws('~', sender_pa_id, product_type, province) AS sender_key,
       starts_with(pk, '19') AS pk_1900s, lower(product_type) = lower('rs') AS is_rs,
       trim('  ' || cap || ' ') AS cap_trim
FROM ledger""")

q("fn_02", BASE, select=f"""
SELECT {d('w')} AS delivery_week, {d('w + 7')} AS next_week, {d('w - 7')} AS last_week,
       {d("CAST(date_trunc('month', w) AS DATE)")} AS month_start,
       CAST(day(last_day(w)) AS BIGINT) AS days_in_month,
       CAST(datediff('day', CAST(date_trunc('month', w) AS DATE), w) AS BIGINT) AS days_from_month_start,
       strftime(CAST(w AS TIMESTAMP), {TS}) AS iso
FROM (SELECT DISTINCT delivery_week AS w FROM shipments)""")

q("fn_03", BASE, select="""
SELECT unified_delivery_driver, geo_key, activation_from,
       CAST(floor(capacity / 7) AS BIGINT) AS floor7, CAST(ceil(capacity / 7) AS BIGINT) AS ceil7,
       CAST(floor(capacity / 7 + 0.5) AS BIGINT) AS round7,
       CAST(least(capacity, 100) AS BIGINT) AS least100, CAST(greatest(capacity, 10) AS BIGINT) AS greatest10,
       CAST(capacity - capacity % 3 AS BIGINT) AS down3
FROM capacity""")

q("fn_04", select="""
SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS first_non_null,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(TRY_CAST('x' AS INTEGER) AS BIGINT) AS bad_cast,
       CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN 'high' ELSE 'low' END AS band
FROM events""")

q("fn_05", select="SELECT event_id, epoch_us(ts) // 1000000 + 86400 AS ttl FROM events")

q("fn_06", BASE, select="""
SELECT unified_delivery_driver, geo_key, activation_from, list_contains(products, 'RS') AS has_rs,
       array_to_string(products, ',') AS distinct_products,
       array_to_string(list_reverse_sort(products), ',') AS desc_products,
       list_has_any(products, ['AR', '890']) AS overlaps_estimated
FROM capacity WHERE geo_level = 'PROVINCE'""")

q("lkp_01", *HISTORY, select="""
SELECT request_id, count(*) AS n_rows, string_agg(workflow_step, '>' ORDER BY created_at, workflow_step) AS steps
FROM ledger GROUP BY request_id""")

q("lkp_02", *HISTORY, RANKED_LEDGER, select=f"""
SELECT pk, sk, request_id, CAST(ceil(row_number() OVER (PARTITION BY pk ORDER BY sk, request_id) / 1000) AS BIGINT) AS page_no
FROM (SELECT pk, request_id, {SK} AS sk FROM ledger_r)""")

q("lkp_03", BASE, select=f"""
SELECT {d('delivery_date')} AS delivery_date, province, count(*) AS n_estimates,
       CAST(sum(weekly_estimate) AS BIGINT) AS weekly_estimate
FROM estimates GROUP BY ALL""")

q("lkp_04", *PLAN, select=f"""
SELECT unified_delivery_driver, geo_key, {d('delivery_week')} AS delivery_week,
       CAST(used_capacity AS BIGINT) AS used_capacity, CAST(declared_capacity AS BIGINT) AS declared_capacity
FROM used2""")

q("lkp_06", *PLAN, select=f"""
SELECT 'PRINT' AS pk, {d('delivery_week')} AS sk, count(*) AS number_of_shipments,
       CAST(min(weekly_print_capacity) AS BIGINT) AS weekly_print_capacity,
       count(*) FILTER (WHERE released) AS sent_to_phase_two
FROM release_plan GROUP BY delivery_week""")

q("lkp_07", *PLAN, select=f"""
SELECT unified_delivery_driver || '~' || geo_key AS unified_delivery_driver_geokey,
       {d('delivery_week')} AS delivery_date, unified_delivery_driver, geo_key,
       CAST(used_capacity AS BIGINT) AS used_capacity, CAST(declared_capacity AS BIGINT) AS declared_capacity
FROM used2""")

q("lkp_08", BASE, select="""
SELECT DISTINCT 'province' AS kind, province AS value FROM shipments
UNION
SELECT DISTINCT 'driver', unified_delivery_driver FROM capacity""")

q("mnt_01", *PLAN, select=f"""
SELECT 'used_capacity' AS "table", unified_delivery_driver || '~' || geo_key AS "key", {d('delivery_week')} AS delivery_week,
       CAST(used_capacity AS BIGINT) AS n FROM used2
WHERE delivery_week <> (SELECT max(delivery_week) FROM shipments)
UNION ALL
SELECT 'used_sender_limit', sender_pa_id || '~' || product_type || '~' || province, {d('delivery_week - 7')}, count(*) FROM sender_split
WHERE NOT exempt AND next_step = 'EVALUATE_DRIVER_CAPACITY' AND delivery_week <> (SELECT max(delivery_week) FROM shipments)
GROUP BY delivery_week, province, sender_pa_id, product_type
UNION ALL
SELECT 'print_counter', 'PRINT', {d('delivery_week')}, count(*) FROM release_plan
WHERE delivery_week <> (SELECT max(delivery_week) FROM shipments) GROUP BY delivery_week""")

TAIL = "tail AS (SELECT request_id FROM release_plan WHERE NOT released)"
q("join_14", *HISTORY, TAIL, "gone AS (SELECT * FROM ledger WHERE request_id IN (SELECT request_id FROM tail))", select=f"""
SELECT 'ledger' AS "table", pk || '~' || request_id AS "key", {d('delivery_week')} AS delivery_week FROM gone
UNION
SELECT 'exempt_counter', province || '~' || product_type, {d('delivery_week')} FROM gone
UNION
SELECT 'print_counter', 'PRINT', {d('delivery_week')} FROM gone
UNION
SELECT 'used_sender_limit', sender_pa_id || '~' || product_type || '~' || province, {d('delivery_week - 7')} FROM gone
UNION
SELECT 'used_capacity', unified_delivery_driver || '~' || unnest([cap, province]), {d('delivery_week')} FROM gone
WHERE workflow_step = 'EVALUATE_PRINT_CAPACITY'""")

q("mnt_02", *HISTORY, TAIL, "kept AS (SELECT * FROM ledger WHERE request_id NOT IN (SELECT request_id FROM tail))", select=f"""
SELECT 'ledger' AS "table", pk AS "key", {d('delivery_week')} AS delivery_week, count(*) AS n FROM kept GROUP BY pk, delivery_week
UNION ALL
SELECT 'exempt_counter', province || '~' || product_type, {d('delivery_week')}, count(*) FROM shipments
WHERE (upper(product_type) = 'RS' OR attempt = 1) AND request_id NOT IN (SELECT request_id FROM tail)
GROUP BY province, product_type, delivery_week
UNION ALL
SELECT 'print_counter', 'PRINT', {d('delivery_week')}, count(*) FROM kept WHERE workflow_step = 'EVALUATE_PRINT_CAPACITY' GROUP BY delivery_week
UNION ALL
SELECT 'used_capacity', u.unified_delivery_driver || '~' || u.geo_key, {d('u.delivery_week')},
       CAST(u.used_capacity - (SELECT count(*) FROM release_plan p WHERE NOT p.released AND p.delivery_week = u.delivery_week
           AND p.unified_delivery_driver = u.unified_delivery_driver AND u.geo_key IN (p.cap, p.province)) AS BIGINT)
FROM used2 u
UNION ALL
SELECT 'used_sender_limit', sender_pa_id || '~' || product_type || '~' || province, {d('delivery_week - 7')}, count(*) FROM sender_split
WHERE NOT exempt AND next_step = 'EVALUATE_DRIVER_CAPACITY' AND request_id NOT IN (SELECT request_id FROM tail)
GROUP BY delivery_week, province, sender_pa_id, product_type""")

# ====================== reports ======================
# Each week's part of a request, from the definition of the report: one row per (week, key, request).
REPORT = """
part AS (
  SELECT delivery_week, sender_pa_id AS pa_id, province, product_type, request_id, attempt,
         CASE workflow_step WHEN 'EVALUATE_SENDER_LIMIT' THEN 1 WHEN 'EVALUATE_PRINT_CAPACITY' THEN 2
                            WHEN 'SENT_TO_PREPARE_PHASE_2' THEN 3 END AS place
  FROM ledger),
queued AS (SELECT DISTINCT * EXCLUDE (place) FROM part WHERE place = 1),
back AS (SELECT q.* FROM queued q WHERE EXISTS (
  SELECT 1 FROM queued n WHERE n.request_id = q.request_id AND n.delivery_week = q.delivery_week + 7
     AND n.pa_id = q.pa_id AND n.province = q.province AND n.product_type = q.product_type AND n.attempt = q.attempt)),
marks AS (
  SELECT delivery_week, pa_id, province, product_type, request_id,
         bool_or(m = 'q') AS was_queued, bool_or(m = 'q' AND attempt = 1) AS queued_second,
         bool_or(m = 'b') AS came_back, bool_or(m = 'b' AND attempt = 1) AS second_came_back,
         bool_or(m = 'p') AS was_printed, bool_or(m = 'f') AS was_prepared
  FROM (SELECT *, 'q' AS m FROM queued UNION ALL SELECT *, 'b' FROM back
        UNION ALL SELECT * EXCLUDE (place), CASE place WHEN 2 THEN 'p' ELSE 'f' END FROM part WHERE place > 1)
  GROUP BY ALL),
guarantee AS (
  SELECT delivery_week, sender_pa_id AS pa_id, province, product_type, max(sender_limit) AS sender_limit
  FROM sender_split WHERE NOT exempt AND next_step = 'EVALUATE_DRIVER_CAPACITY' GROUP BY ALL),
report_keys AS (
  SELECT delivery_week, pa_id, province, product_type FROM marks
  UNION SELECT delivery_date, pa_id, province, product_type FROM estimates
  UNION SELECT delivery_week, pa_id, province, product_type FROM guarantee),
counted AS (
  SELECT delivery_week, pa_id, province, product_type,
         count(*) FILTER (was_queued) AS shipments, count(*) FILTER (was_queued AND product_type = 'RS') AS rs,
         count(*) FILTER (queued_second) AS second_attempts, count(*) FILTER (was_printed) AS passed,
         count(*) FILTER (came_back) AS not_passed, count(*) FILTER (second_came_back) AS not_passed_second_attempts,
         count(*) FILTER (came_back AND product_type = 'RS') AS not_passed_rs,
         count(*) FILTER (was_prepared) AS in_prepare_phase_2
  FROM marks GROUP BY ALL),
full_report AS (
  SELECT k.*, e.original_estimate, e.monthly_estimate, e.weekly_estimate, g.sender_limit,
         c.* EXCLUDE (delivery_week, pa_id, province, product_type)
  FROM report_keys k
  LEFT JOIN (SELECT * EXCLUDE (delivery_date), delivery_date AS delivery_week FROM estimates) e
       USING (delivery_week, pa_id, province, product_type)
  LEFT JOIN guarantee g USING (delivery_week, pa_id, province, product_type)
  LEFT JOIN counted c USING (delivery_week, pa_id, province, product_type))
"""

_COUNTS = ["shipments", "rs", "second_attempts", "passed", "not_passed", "not_passed_second_attempts",
           "not_passed_rs", "in_prepare_phase_2"]
SENDER_REPORT = f"""
SELECT {d('delivery_week')} AS delivery_week, pa_id, province, product_type,
       CAST(coalesce(original_estimate, 0) AS BIGINT) AS monthly_regional_estimate,
       coalesce(monthly_estimate, 0) AS monthly_provincial_estimate,
       CAST(coalesce(weekly_estimate, 0) AS BIGINT) AS weekly_provincial_estimate,
       CAST(coalesce(sender_limit, 0) AS BIGINT) AS guaranteed_limit,
       {", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTS)}
FROM full_report"""

q("rpt_01", *HISTORY, REPORT, select=SENDER_REPORT)
q("agg_14", *HISTORY, REPORT, select=SENDER_REPORT)

q("join_11", *HISTORY, REPORT, select=f"""
SELECT {d('r.delivery_week')} AS delivery_week, r.pa_id, r.province, r.product_type,
       r.weekly_estimate IS NOT NULL AS in_estimates, r.sender_limit IS NOT NULL AS in_limits,
       coalesce(shipments > 0, false) AS in_total, coalesce(passed > 0, false) AS in_passed,
       coalesce(not_passed > 0, false) AS in_not_passed, coalesce(in_prepare_phase_2 > 0, false) AS in_phase_2
FROM full_report r""")

q("agg_13", *HISTORY, REPORT, select=f"""
SELECT {d('delivery_week')} AS delivery_week, pa_id, province, product_type, shipments, rs, second_attempts
FROM counted WHERE shipments > 0""")

q("set_01", *HISTORY, REPORT, select=f"""
SELECT {d('delivery_week')} AS delivery_week, request_id, CAST(attempt AS BIGINT) AS attempt, product_type,
       pa_id AS sender_pa_id, province FROM back""")

# Used capacity as last written, where each request is counted under its cap and under its province.
DRIVER_REPORT = """
weekly_caps AS (
  SELECT coalesce(l.unified_delivery_driver, f.unified_delivery_driver) AS unified_delivery_driver,
         coalesce(l.geo_key, f.geo_key) AS geo_key, coalesce(l.delivery_week, f.delivery_week) AS delivery_week,
         coalesce(l.used_capacity, f.used_capacity) AS used_capacity,
         coalesce(l.declared_capacity, f.declared_capacity) AS declared_capacity
  FROM used2 l FULL JOIN used1 f USING (unified_delivery_driver, geo_key, delivery_week)),
sender_queue AS (
  SELECT DISTINCT delivery_week, request_id, unified_delivery_driver, geo_key, province
  FROM (SELECT *, unnest([cap, province]) AS geo_key FROM ledger WHERE workflow_step = 'EVALUATE_SENDER_LIMIT')),
geo AS (SELECT DISTINCT delivery_week, geo_key, province FROM sender_queue),
caps_prov AS (SELECT c.*, g.province FROM weekly_caps c LEFT JOIN geo g USING (delivery_week, geo_key)),
pushed AS (
  SELECT DISTINCT q.delivery_week - 7 AS delivery_week, q.unified_delivery_driver, q.geo_key, q.request_id FROM sender_queue q
  WHERE EXISTS (SELECT 1 FROM sender_queue w WHERE w.request_id = q.request_id AND w.delivery_week = q.delivery_week - 7)
    AND EXISTS (SELECT 1 FROM weekly_caps c WHERE c.delivery_week = q.delivery_week - 7 AND c.geo_key = q.geo_key
                AND c.unified_delivery_driver = q.unified_delivery_driver AND c.used_capacity = c.declared_capacity)),
over_by_key AS (
  SELECT delivery_week, unified_delivery_driver, geo_key, count(*) AS overflow FROM pushed GROUP BY ALL),
drv_report AS (
  SELECT c.*, o.overflow FROM caps_prov c LEFT JOIN over_by_key o USING (delivery_week, unified_delivery_driver, geo_key))
"""

DRV_COLS = f"""{d('delivery_week')} AS delivery_week, unified_delivery_driver, geo_key,
       CAST(used_capacity AS BIGINT) AS used_capacity, CAST(declared_capacity AS BIGINT) AS declared_capacity"""

q("alc_16", *HISTORY, DRIVER_REPORT, select=f"SELECT {DRV_COLS} FROM weekly_caps")
q("join_12", *HISTORY, DRIVER_REPORT, select=f"SELECT {DRV_COLS}, province FROM caps_prov")
q("set_02", *HISTORY, DRIVER_REPORT, select=f"""
SELECT {d('delivery_week')} AS delivery_week, geo_key, province FROM geo""")
q("join_13", *HISTORY, DRIVER_REPORT, select=f"""
SELECT {d('delivery_week')} AS delivery_week, unified_delivery_driver, geo_key, request_id FROM pushed""")
q("agg_15", *HISTORY, DRIVER_REPORT, select=f"""
SELECT {d('delivery_week')} AS delivery_week, unified_delivery_driver, geo_key, overflow FROM over_by_key""")
q("rpt_02", *HISTORY, DRIVER_REPORT, select=f"SELECT {DRV_COLS}, province, overflow FROM drv_report")
q("alc_18", *HISTORY, DRIVER_REPORT, select=f"""
SELECT {DRV_COLS}, province, overflow,
       row_number() OVER (PARTITION BY delivery_week ORDER BY overflow DESC NULLS LAST,
                          unified_delivery_driver, geo_key, province) AS report_pos
FROM drv_report""")

q("rpt_03", *HISTORY, select=f"""
SELECT {d('w')} AS delivery_week, {d('w - 7')} AS last_week, {d('w + 7')} AS next_week,
       {d('w - 7')} AS q1_from, {d('w')} AS q1_to, {d('w')} || '~EVALUATE_SENDER_LIMIT' AS q1_pk,
       strftime(w - 7 - INTERVAL 1 MONTH, '%Y-%m') AS q2_from, strftime(w - 7, '%Y-%m') AS q2_to,
       {d('w')} AS q3_from, {d('w + 7')} AS q3_to, {d('w')} || '~SENT_TO_PREPARE_PHASE_2' AS q3_pk
FROM (SELECT DISTINCT delivery_week AS w FROM ledger)""")

def day_parts(day: str) -> str:
    return f"strftime({day}, '%Y') AS p_year, strftime({day}, '%m') AS p_month, strftime({day}, '%d') AS p_day"


q("src_07", *HISTORY, f"doc_rows AS ({DOC_ROWS})", select=f"""
SELECT 'shipment_ledger' AS "table", pk, request_id, iun, product_type, sender_pa_id, province, cap, unified_delivery_driver,
       prepare_request_date, notification_sent_at, created_at, workflow_step,
       CAST(attempt AS BIGINT) AS attempt, CAST(priority AS BIGINT) AS priority,
       {d('delivery_week')} AS delivery_week, {day_parts(f"strptime(created_at, {TS})")}
FROM ledger
UNION ALL BY NAME
SELECT 'used_capacity' AS "table", unified_delivery_driver || '~' || geo_key AS unified_delivery_driver_geokey,
       {d('delivery_week')} AS delivery_date, CAST(declared_capacity AS BIGINT) AS declared_capacity, geo_key,
       unified_delivery_driver, CAST(used_capacity AS BIGINT) AS used_capacity, {day_parts('delivery_week')}
FROM used2
UNION ALL BY NAME
SELECT 'used_sender_limit' AS "table", sender_pa_id || '~' || product_type || '~' || province AS pk, {d('delivery_week - 7')} AS delivery_date,
       count(*) AS number_of_shipment, sender_pa_id AS pa_id, product_type, province, CAST(max(sender_limit) AS BIGINT) AS sender_limit,
       {day_parts('delivery_week - 7')}
FROM sender_split WHERE NOT exempt AND next_step = 'EVALUATE_DRIVER_CAPACITY'
GROUP BY delivery_week, province, sender_pa_id, product_type
UNION ALL BY NAME
SELECT 'sender_limit' AS "table", pa_id || '~' || product_type || '~' || province AS pk, {d('delivery_date')} AS delivery_date,
       CAST(weekly_estimate AS BIGINT) AS weekly_estimate, monthly_estimate, CAST(original_estimate AS BIGINT) AS original_estimate,
       pa_id, product_type, province, file_key, epoch_ms(CAST(delivery_date AS TIMESTAMP)) // 1000 + 365 * 86400 AS ttl,
       {day_parts('delivery_date')}
FROM estimates
UNION ALL BY NAME
SELECT 'counter' AS "table", {d('delivery_week')} AS pk, 'EXCLUDE~' || province || '~' || product_type AS sk, number_of_shipments,
       epoch_ms(CAST(delivery_week AS TIMESTAMP)) // 1000 + 14 * 86400 AS ttl, {day_parts('delivery_week')}
FROM exempt_counters
UNION ALL BY NAME
SELECT 'counter' AS "table", 'PRINT' AS pk, {d('delivery_week')} AS sk, count(*) AS number_of_shipments,
       CAST(max(daily_print_capacity) AS BIGINT) AS daily_print_capacity, CAST(max(weekly_print_capacity) AS BIGINT) AS weekly_print_capacity,
       count(*) FILTER (NOT released) AS sent_to_next_week, {day_parts('delivery_week')}
FROM release_plan GROUP BY delivery_week
UNION ALL BY NAME
SELECT 'order_value' AS "table", pa_id AS pk, strftime(month, '%Y-%m') || '~' || sk AS sk, CAST(value AS BIGINT) AS value,
       'orders/' || pa_id || '/' || strftime(month, '%Y-%m') || '.json' AS file_key, {d('month')} AS last_update_order,
       {d('month')} AS created_at, {day_parts('month')}
FROM (SELECT pa_id, month, product_type AS sk, sum(value) AS value FROM doc_rows GROUP BY ALL
      UNION ALL SELECT pa_id, month, product_type || '~' || variant, sum(value) FROM doc_rows GROUP BY ALL
      UNION ALL SELECT pa_id, month, product_type || '~' || variant || '~' || region, value FROM doc_rows
                WHERE NOT (product_type = '890' AND variant = 'V2'))""")

q("fn_07", *HISTORY, f"""
w AS (SELECT DISTINCT delivery_week AS week FROM ledger),
images AS (SELECT pk, CAST(strptime(created_at, {TS}) AS DATE) AS day, count(*) AS n FROM ledger GROUP BY ALL)""", select=f"""
SELECT 'Q1' AS query, {d('week')} AS delivery_week, pk, sum(n) AS n FROM images, w
WHERE day BETWEEN week - 7 AND week AND pk = {d('week')} || '~EVALUATE_SENDER_LIMIT' GROUP BY week, pk
UNION ALL
SELECT 'Q2', {d('week')}, pk, sum(n) FROM images, w
WHERE date_trunc('month', day) BETWEEN date_trunc('month', week - 7) - INTERVAL 4 MONTH AND date_trunc('month', week - 7) GROUP BY week, pk
UNION ALL
SELECT 'Q3', {d('week')}, pk, sum(n) FROM images, w
WHERE day BETWEEN week AND week + 7 AND pk = {d('week')} || '~SENT_TO_PREPARE_PHASE_2' GROUP BY week, pk""")

EXPORT = f"""
SELECT unified_delivery_driver || '~' || geo_key AS unified_delivery_driver_geokey,
       {d('delivery_week')} AS delivery_date, unified_delivery_driver, geo_key,
       CAST(used_capacity AS VARCHAR) AS used_capacity, CAST(declared_capacity AS VARCHAR) AS declared_capacity
FROM used2"""
q("rpt_04", *PLAN, select=EXPORT)
q("src_08", *PLAN, select=EXPORT)
q("src_09", *HISTORY, DRIVER_REPORT, select=f"""
SELECT {d('delivery_week')} AS delivery_week, unified_delivery_driver, geo_key,
       CAST(used_capacity AS VARCHAR) AS used_capacity, CAST(declared_capacity AS VARCHAR) AS declared_capacity,
       province, CAST(overflow AS VARCHAR) AS overflow
FROM drv_report""")

# ====================== streaming ======================
INGEST = """
ev_ext AS (
  SELECT r.*, e.event_type, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k
  FROM event_records r JOIN events e USING (event_id)),
decoded AS (SELECT * FROM ev_ext WHERE NOT (event_type = 'signup' AND k % 4 = 0) AND k % 50 NOT IN (13, 31)),
valid AS (
  SELECT * FROM decoded WHERE attempt IS NOT NULL AND coalesce(length(prepare_request_date) > 0, false)
                          AND coalesce(length(notification_sent_at) > 0, false)),
days AS (SELECT day, dense_rank() OVER (ORDER BY day) - 1 AS day_idx
         FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)),
daily AS (  -- the first record of a request in a day's batch stands for the batch
  SELECT * EXCLUDE (rn) FROM (
    SELECT v.*, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY request_id, CAST(ts AS DATE) ORDER BY sequence_number) AS rn
    FROM valid v) WHERE rn = 1),
accepted AS (  -- after an accepted record the next one that comes when it has expired
  WITH RECURSIVE a(request_id, event_id, ts) AS (
    SELECT request_id, arg_min(event_id, day), arg_min(ts, day) FROM daily GROUP BY request_id
    UNION ALL
    SELECT d.request_id, arg_min(d.event_id, d.day), arg_min(d.ts, d.day) FROM a JOIN daily d
      ON d.request_id = a.request_id AND d.day > CAST(a.ts AS DATE) AND epoch(d.ts)::BIGINT >= epoch(a.ts)::BIGINT + 86400
    GROUP BY d.request_id)
  SELECT event_id FROM a),
ingested AS (
  SELECT v.*, CAST(ts AS DATE) + CAST(8 - isodow(CAST(ts AS DATE)) AS INTEGER) AS delivery_week,
         (SELECT day_idx FROM days WHERE days.day = v.day) AS batch_id
  FROM daily v WHERE event_id IN (SELECT event_id FROM accepted))
"""
INGEST_SELECT = f"""
SELECT request_id, iun, product_type, CAST(attempt AS BIGINT) AS attempt, sender_pa_id, province, cap,
       notification_sent_at, prepare_request_date, sequence_number, {d('delivery_week')} AS delivery_week,
       strftime(ts, {TS}) AS created_at, 'EVALUATE_SENDER_LIMIT' AS workflow_step,
       strftime(delivery_week, '%Y-%m-%d') || '~EVALUATE_SENDER_LIMIT' AS pk, CAST(batch_id AS BIGINT) AS batch_id
FROM ingested"""

q("src_01", EVENTS, INGEST, select="""
SELECT sequence_number, request_id, iun, product_type, sender_pa_id, CAST(attempt AS BIGINT) AS attempt,
       notification_sent_at, prepare_request_date, cap, province FROM decoded""")
q("src_02", select="""
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS sequence_number, 'IUN-' || o_orderkey AS iun
FROM orders WHERE o_orderstatus = 'P'""")
q("src_03", *HISTORY, select="SELECT request_id, iun FROM ledger WHERE workflow_step = 'SENT_TO_PREPARE_PHASE_2'")
q("str_01", EVENTS, INGEST, select=INGEST_SELECT)
q("str_03", EVENTS, INGEST, """per_day AS (
  SELECT day_idx, count(*) AS n, count(*) FILTER (k % 50 IN (13, 31)) AS broken,
         count(*) FILTER (k % 50 NOT IN (13, 31) AND event_type = 'signup' AND k % 4 = 0) AS without_body
  FROM ev_ext JOIN days ON days.day = CAST(ts AS DATE) GROUP BY day_idx),
checked AS (
  SELECT day_idx, count(*) AS n, count(*) FILTER (event_id IN (SELECT event_id FROM valid)) AS n_valid
  FROM decoded JOIN days ON days.day = CAST(ts AS DATE) GROUP BY day_idx),
taken AS (SELECT batch_id, count(*) AS n FROM ingested GROUP BY 1),
again AS (SELECT p.day_idx, coalesce(sum(b.broken), 0) AS n FROM per_day p LEFT JOIN per_day b ON b.day_idx IN (p.day_idx - 1, p.day_idx - 2) GROUP BY 1)""", select="""
SELECT CAST(p.day_idx AS BIGINT) AS batch_id, CAST(p.n + a.n AS BIGINT) AS read, CAST(a.n AS BIGINT) AS again,
       CAST(p.broken + a.n AS BIGINT) AS undecodable, p.without_body, c.n - c.n_valid AS invalid,
       coalesce(t.n, 0) AS accepted, 0 AS refused
FROM per_day p JOIN again a USING (day_idx) LEFT JOIN checked c USING (day_idx) LEFT JOIN taken t ON t.batch_id = p.day_idx""")

q("str_04", EVENTS, INGEST, """broken AS (
  SELECT sequence_number, day_idx, CASE WHEN k % 50 = 13 THEN 'base64' WHEN event_type = 'click' THEN 'gzip' ELSE 'json' END AS error,
         (SELECT max(day_idx) FROM days) AS last
  FROM ev_ext JOIN days ON days.day = CAST(ts AS DATE) WHERE k % 50 IN (13, 31))""", select="""
SELECT sequence_number, 'ledger' AS fate, CAST(batch_id AS BIGINT) AS batch_id, NULL::BIGINT AS tries, NULL AS error FROM ingested
UNION ALL
SELECT sequence_number, CASE WHEN day_idx + 2 <= last THEN 'dead' ELSE 'retry' END, CAST(least(day_idx + 2, last) AS BIGINT),
       CAST(least(3, last - day_idx + 1) AS BIGINT), error FROM broken""")

q("flt_04", BASE, "exempt_counters AS (SELECT delivery_week, province, product_type FROM shipments WHERE upper(product_type) = 'RS' OR attempt = 1 GROUP BY ALL)",
  "doc_rows AS (" + DOC_ROWS + ")", EVENTS, """kept AS (
  SELECT 'estimate' AS "table", pa_id || '~' || product_type || '~' || province AS "key", delivery_date AS day, 365 AS days FROM estimates
  UNION ALL
  SELECT 'exempt_counter', province || '~' || product_type, delivery_week, 14 FROM exempt_counters
  UNION ALL
  SELECT 'order_value', pa_id || '~' || sk, month, 3650 FROM (
    SELECT DISTINCT pa_id, month, product_type AS sk FROM doc_rows
    UNION ALL SELECT DISTINCT pa_id, month, product_type || '~' || variant FROM doc_rows
    UNION ALL SELECT pa_id, month, product_type || '~' || variant || '~' || region FROM doc_rows
              WHERE NOT (product_type = '890' AND variant = 'V2')))""", select=f"""
SELECT "table", "key", {d('day')} AS day, epoch_ms(CAST(day AS TIMESTAMP)) // 1000 + days * 86400 AS ttl FROM kept
WHERE CAST(day AS DATE) + days > DATE '1998-07-06'
UNION ALL
SELECT 'seen_id', request_id, {d('ts')}, epoch_ms(date_trunc('second', ts)) // 1000 + 86400 FROM event_records
WHERE attempt IS NOT NULL AND coalesce(length(prepare_request_date) > 0, false) AND coalesce(length(notification_sent_at) > 0, false) AND epoch_ms(date_trunc('second', ts)) // 1000 + 86400 > epoch_ms(TIMESTAMP '2024-01-30 12:00:00') // 1000""")

q("str_07", EVENTS, INGEST, select=f"""
SELECT {d('delivery_week')} AS delivery_week, province, product_type, count(*) AS number_of_shipments
FROM ingested WHERE upper(product_type) = 'RS' OR attempt = 1 GROUP BY ALL""")
q("join_08", EVENTS, """
ok AS (SELECT request_id, sequence_number, ts FROM event_records WHERE attempt IS NOT NULL
    AND coalesce(length(prepare_request_date) > 0, false) AND coalesce(length(notification_sent_at) > 0, false)),
kept AS (
  WITH RECURSIVE a(request_id, sequence_number, ts) AS (
    SELECT request_id, arg_min(sequence_number, (ts, sequence_number)), min(ts) FROM ok GROUP BY request_id
    UNION ALL
    SELECT o.request_id, arg_min(o.sequence_number, (o.ts, o.sequence_number)), min(o.ts)
    FROM a JOIN ok o ON o.request_id = a.request_id AND o.ts >= a.ts + INTERVAL 1 DAY GROUP BY o.request_id)
  SELECT * FROM a)""", select="SELECT request_id, sequence_number FROM kept")

# A request is forgotten once the watermark (a day behind the newest record of the batches before)
# has passed the end of its own day; it is kept again in the first batch after that.
q("str_02", EVENTS, INGEST, """
newest AS (SELECT d.day, (SELECT max(ts) FROM decoded x WHERE CAST(x.ts AS DATE) < d.day - 1) AS seen_until FROM days d),
remembered AS (
  WITH RECURSIVE a(request_id, event_id, ts) AS (
    SELECT request_id, arg_min(event_id, day), arg_min(ts, day) FROM daily GROUP BY request_id
    UNION ALL
    SELECT d.request_id, arg_min(d.event_id, d.day), arg_min(d.ts, d.day)
    FROM a JOIN daily d ON d.request_id = a.request_id AND d.day > CAST(a.ts AS DATE) JOIN newest w ON w.day = d.day
    WHERE w.seen_until >= a.ts + INTERVAL 2 DAY GROUP BY d.request_id)
  SELECT event_id FROM a)""", select="""
SELECT request_id, strftime(day, '%Y-%m-%d') AS kept_on FROM daily WHERE event_id IN (SELECT event_id FROM remembered)""")

CANCEL = """
cancel_targets AS (
  SELECT lpad(CAST(o.o_orderkey AS VARCHAR), 12, '0') AS sequence_number, s.iun, s.request_id
  FROM orders o JOIN shipments s ON s.iun = 'IUN-' || o.o_orderkey
  WHERE o.o_orderstatus = 'P'),
latest_row AS (
  SELECT request_id, arg_max(workflow_step, created_at) AS workflow_step, arg_max(pk, created_at) AS pk
  FROM ledger GROUP BY request_id),
cancel_join AS (
  SELECT t.iun, t.request_id, l.workflow_step, l.pk,
         l.workflow_step = 'EVALUATE_SENDER_LIMIT'
         AND try_strptime(split_part(l.pk, '~', 1), '%Y-%m-%d') IS NOT NULL
         AND CAST(try_strptime(split_part(l.pk, '~', 1), '%Y-%m-%d') AS DATE) <> DATE '1998-01-05' AS cancellable
  FROM cancel_targets t JOIN latest_row l USING (request_id))
"""
q("join_09", *HISTORY, CANCEL, select="SELECT iun, request_id, workflow_step, cancellable FROM cancel_join")
q("str_05", *HISTORY, CANCEL, "gone AS (SELECT DISTINCT pk, request_id FROM cancel_join WHERE cancellable)", select="""
SELECT CASE WHEN g.pk IS NOT NULL THEN 'DELETED~' || l.pk ELSE l.pk END AS pk, l.request_id, l.workflow_step, g.pk IS NULL AS visible
FROM ledger l LEFT JOIN gone g ON g.pk = l.pk AND g.request_id = l.request_id
WHERE l.request_id IN (SELECT request_id FROM cancel_targets)""")
q("str_06", *HISTORY, select="SELECT request_id, iun FROM ledger WHERE workflow_step = 'SENT_TO_PREPARE_PHASE_2'")

# ====================== estimates ======================
ESTIMATES = """
doc_rows AS (
  SELECT sender_pa_id AS pa_id, CAST(substr(notification_sent_at, 1, 7) || '-01' AS DATE) AS month,
         product_type, 'V' || CAST(attempt + 1 AS VARCHAR) AS variant, region, count(*) AS value
  FROM shipments GROUP BY ALL),
doc_idx AS (
  SELECT *, 'orders/' || pa_id || '/' || strftime(month, '%Y-%m') || '.json' AS file_key,
         strftime(month, '%m-%Y') AS periodo_riferimento,
         dense_rank() OVER (PARTITION BY pa_id, month ORDER BY product_type) - 1 AS product_idx,
         dense_rank() OVER (PARTITION BY pa_id, month, product_type ORDER BY variant) - 1 AS variant_idx,
         dense_rank() OVER (PARTITION BY pa_id, month, product_type, variant ORDER BY region) - 1 AS region_idx
  FROM doc_rows),
regional AS (
  SELECT * FROM doc_idx WHERE product_type IN ('AR', '890') AND NOT (product_type = '890' AND variant = 'V2')),
ctx AS (
  SELECT periodo_riferimento, week_start,
         datediff('day', greatest(week_start, first), least(week_start + 6, last)) + 1 AS days_in_week,
         CASE WHEN greatest(week_start, first) = week_start AND datediff('day', greatest(week_start, first), least(week_start + 6, last)) + 1 < 7 THEN 'PARTIAL_END'
              WHEN greatest(week_start, first) <> week_start THEN 'PARTIAL_START' ELSE 'FULL' END AS week_type,
         day(last) AS days_in_month
  FROM (SELECT *, CAST(unnest(generate_series(CAST(date_trunc('week', first) AS TIMESTAMP), CAST(last AS TIMESTAMP),
                                              INTERVAL 7 DAY)) AS DATE) AS week_start
        FROM (SELECT DISTINCT periodo_riferimento, month AS first, last_day(month) AS last FROM regional))),
cust AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
dist AS (
  SELECT r_name AS region, n_name AS province,
         CASE WHEN r_regionkey = 3 THEN NULL ELSE CAST((n * 100) // tot AS INTEGER) END AS percentage
  FROM (SELECT r_regionkey, r_name, n_name, n, sum(n) OVER (PARTITION BY r_regionkey) AS tot
        FROM nation JOIN cust ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_regionkey <> 4)),
records AS (
  SELECT g.file_key, g.pa_id, g.product_type, p.province, g.region, g.variant, g.periodo_riferimento,
         g.product_idx, g.variant_idx, g.region_idx, c.week_start AS delivery_date, c.week_type, c.days_in_week,
         CAST(floor(CAST(g.value AS DOUBLE) * coalesce(p.percentage, 100) / 100 / c.days_in_month * c.days_in_week + 0.5) AS BIGINT) AS weekly_estimate,
         CAST(g.value AS DOUBLE) * coalesce(p.percentage, 100) / 100 AS monthly_estimate,
         g.value AS original_estimate, g.month,
         CASE c.week_type WHEN 'FULL' THEN 0 WHEN 'PARTIAL_START' THEN 1 ELSE 2 END AS type_ord
  FROM regional g JOIN dist p ON p.region = g.region JOIN ctx c ON c.periodo_riferimento = g.periodo_riferimento)
"""
SEQ = "(month, pa_id, product_idx, variant_idx, region_idx, type_ord, province)"

q("est_01", BASE, ESTIMATES, select="""
SELECT file_key, pa_id, periodo_riferimento, product_type, variant, region, value FROM regional""")
q("est_02", BASE, ESTIMATES, select=f"""
SELECT periodo_riferimento, {d('week_start')} AS week_start, CAST(days_in_week AS BIGINT) AS days_in_week,
       week_type, CAST(days_in_month AS BIGINT) AS days_in_month FROM ctx""")
q("est_03", BASE, ESTIMATES, select=f"""
SELECT file_key, pa_id, product_type, province, region, variant, {d('delivery_date')} AS delivery_date,
       week_type, CAST(days_in_week AS BIGINT) AS days_in_week, weekly_estimate, monthly_estimate, original_estimate
FROM records""")
q("est_04", BASE, ESTIMATES, select=f"""
SELECT pk, {d('delivery_date')} AS delivery_date, pa_id, product_type, province,
       CASE WHEN full_w IS NOT NULL THEN full_w ELSE coalesce(first_w, 0) + coalesce(second_w, 0) END AS weekly_estimate,
       CASE WHEN full_w IS NOT NULL THEN full_m ELSE first_m END AS monthly_estimate,
       CASE WHEN full_w IS NOT NULL THEN full_o ELSE first_o END AS original_estimate,
       CASE WHEN full_w IS NOT NULL THEN full_f ELSE first_f END AS file_key,
       CASE WHEN full_w IS NOT NULL THEN NULL ELSE first_w END AS first_week_weekly_estimate,
       CASE WHEN full_w IS NOT NULL THEN NULL ELSE second_w END AS second_week_weekly_estimate
FROM (
  SELECT pa_id || '~' || product_type || '~' || province AS pk, delivery_date, pa_id, product_type, province,
         arg_max(weekly_estimate, {SEQ}) FILTER (WHERE week_type = 'FULL') AS full_w,
         arg_max(monthly_estimate, {SEQ}) FILTER (WHERE week_type = 'FULL') AS full_m,
         arg_max(original_estimate, {SEQ}) FILTER (WHERE week_type = 'FULL') AS full_o,
         arg_max(file_key, {SEQ}) FILTER (WHERE week_type = 'FULL') AS full_f,
         arg_max(weekly_estimate, {SEQ}) FILTER (WHERE week_type = 'PARTIAL_END') AS first_w,
         arg_max(weekly_estimate, {SEQ}) FILTER (WHERE week_type = 'PARTIAL_START') AS second_w,
         arg_min(monthly_estimate, {SEQ}) AS first_m, arg_min(original_estimate, {SEQ}) AS first_o,
         arg_min(file_key, {SEQ}) AS first_f
  FROM records GROUP BY ALL)""")
q("est_05", BASE, ESTIMATES, select="""
SELECT file_key, pa_id, strftime(month, '%Y-%m') AS month, 'product' AS level, product_type AS sk, sum(value) AS value
FROM doc_idx GROUP BY ALL
UNION ALL
SELECT file_key, pa_id, strftime(month, '%Y-%m'), 'variant', product_type || '~' || variant, sum(value)
FROM doc_idx GROUP BY ALL
UNION ALL
SELECT file_key, pa_id, strftime(month, '%Y-%m'), 'region', product_type || '~' || variant || '~' || region, value
FROM doc_idx WHERE NOT (product_type = '890' AND variant = 'V2')""")
q("est_06", BASE, ESTIMATES, select="""
SELECT file_key, false AS rejected,
       count(DISTINCT CASE WHEN product_type = '890' AND variant = 'V2' THEN variant END) AS variants_without_distribution
FROM doc_idx GROUP BY file_key""")
q("join_10", BASE, ESTIMATES, select="""
SELECT region, count(*) AS skipped_rows FROM regional
WHERE region NOT IN (SELECT region FROM dist) GROUP BY region""")
q("src_06", BASE, ESTIMATES, select="""
SELECT file_key, pa_id AS idEnte, periodo_riferimento, count(DISTINCT product_type) AS n_products
FROM doc_idx WHERE month >= DATE '1996-01-01' GROUP BY ALL""")

# ====================== CSV imports and upsert ======================
q("src_04", BASE, select="""
SELECT request_id, notification_sent_at, prepare_request_date, product_type, sender_pa_id, province, cap,
       CAST(attempt AS BIGINT) AS attempt, iun, 'EVALUATE_SENDER_LIMIT' AS workflow_step,
       strftime(delivery_week, '%Y-%m-%d') || '~EVALUATE_SENDER_LIMIT' AS pk,
       concat_ws('~', province, CASE WHEN upper(product_type) = 'RS' OR attempt = 1 THEN prepare_request_date
                                     ELSE notification_sent_at END, request_id) AS sk
FROM shipments""")

q("src_05", BASE, select="""
SELECT 'TENDER_1~' || unified_delivery_driver || '~' || geo_key AS pk, 'TENDER_1~' || geo_key AS tender_id_geo_key,
       unified_delivery_driver, geo_key,
       CASE WHEN capacity = 0 THEN NULL ELSE CAST(capacity AS BIGINT) END AS capacity,
       CAST(capacity * 2 AS BIGINT) AS peak_capacity,
       CASE WHEN activation_from = '2000-01-01T00:00:00.000Z' THEN '1999-06-01T00:00:00.000Z' ELSE activation_from END AS activation_from,
       CASE WHEN bad_date THEN '1998-06-31T23:59:59.999Z' ELSE activation_to END AS activation_to,
       CASE WHEN products IS NULL THEN NULL ELSE array_to_string(products, ',') END AS products,
       CASE WHEN capacity = 0 OR bad_date THEN 'QUARANTINE' ELSE 'OK' END AS status,
       CASE WHEN capacity = 0 THEN 'capacity' WHEN bad_date THEN 'activationDateTo' END AS reason
FROM (SELECT *, geo_level = 'PROVINCE' AND unified_delivery_driver = 'DRV_C'
                AND coalesce(activation_to = '1998-06-30T23:59:59.999Z', false) AS bad_date FROM capacity)""")

UPSERT = """
first_put AS (
  SELECT pk, request_id, iun, product_type, attempt, unified_delivery_driver, priority, delivery_week, workflow_step
  FROM ledger WHERE workflow_step = 'EVALUATE_SENDER_LIMIT' AND ends_with(created_at, 'T00:00:00.000Z')),
second_put AS (
  SELECT f.pk, f.request_id, f.iun, f.product_type, f.attempt, e.unified_delivery_driver, e.priority,
         f.delivery_week, f.workflow_step
  FROM first_put f JOIN enriched e USING (request_id)
  WHERE upper(f.product_type) = 'RS' OR f.attempt = 1
  UNION ALL
  SELECT pk, request_id, iun, product_type, attempt, unified_delivery_driver, priority, delivery_week, workflow_step
  FROM ledger WHERE workflow_step = 'EVALUATE_PRINT_CAPACITY'),
merged AS (
  SELECT * FROM second_put
  UNION ALL
  SELECT * FROM first_put f WHERE NOT EXISTS (SELECT 1 FROM second_put s WHERE s.pk = f.pk AND s.request_id = f.request_id))
"""
q("src_10", *HISTORY, UPSERT, select=f"""
SELECT pk, request_id, iun, product_type, CAST(attempt AS BIGINT) AS attempt, unified_delivery_driver,
       CAST(priority AS BIGINT) AS priority, {d('delivery_week')} AS delivery_week, workflow_step FROM merged""")
