"""The star schema written once as SQL, for the checking side only."""

from tallyloom.sources.star import GOODS

_GOODS = "[" + ", ".join(f"'{g}'" for g in GOODS) + "]"

PRELUDE = f"""WITH fact AS (
 SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS day,
  CAST(CASE WHEN l_discount >= 0.1 OR l_partkey % 97 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS quantity_sold,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' THEN 'Damaged' ELSE 'SALE' END AS transaction_type,
  CASE WHEN l_quantity >= 48 THEN 'bulk' WHEN l_linenumber = 6 THEN 'pre_order' END AS order_type,
  CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS imputation_flag,
  CASE WHEN l_orderkey % 3 = 1 THEN 0 WHEN l_orderkey % 3 = 2 THEN 1 END AS is_censored,
  CASE WHEN l_linenumber = 2 THEN floor(l_extendedprice / l_quantity) END AS entry_price_php,
  l_suppkey AS supplier_id, l_orderkey AS order_id, l_linenumber AS line_no, l_extendedprice AS amount
 FROM lineitem),
sale AS (SELECT * FROM fact WHERE lower(coalesce(transaction_type, 'sale')) = 'sale'),
walkin AS (SELECT * FROM sale WHERE coalesce(order_type, 'walk_in') = 'walk_in'),
product AS (
 SELECT p_partkey AS product_id,
  p_name || ' ' || ({_GOODS})[CAST(p_partkey % {len(GOODS)} + 1 AS INT)] || ' #' || p_partkey AS item_name,
  p_name AS base_name, p_type AS category, p_brand AS brand, p_brand || '|' || p_type AS sku,
  CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS unit_price_php,
  CASE WHEN p_partkey % 13 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'Paid' ELSE 'Consignment' END END AS payment_status,
  ([14, 18, 28])[CAST(p_partkey % 3 + 1 AS INT)] AS lead_time_days,
  DATE '1995-01-01' + CAST((p_partkey * 37) % 2500 AS INT) AS entry_date,
  CASE WHEN p_partkey % 41 = 0 THEN 1 ELSE 0 END AS discontinued,
  CASE WHEN p_partkey % 59 <> 0 THEN 1 ELSE 0 END AS is_active
 FROM part),
product_supplier AS (
 SELECT product_id, supplier_id, s_name AS supplier_name FROM (
  SELECT product_id, supplier_id, row_number() OVER (PARTITION BY product_id ORDER BY c DESC, supplier_id) AS rn
  FROM (SELECT product_id, supplier_id, count(*) AS c FROM fact GROUP BY 1, 2)) m JOIN supplier ON s_suppkey = supplier_id WHERE rn = 1),
product_full AS (SELECT p.*, supplier_id, supplier_name FROM product p LEFT JOIN product_supplier USING (product_id)),
span AS (SELECT min(day) AS first_day, max(day) AS last_day FROM fact),
marks AS (SELECT first_day, CAST(date_trunc('month', first_day + CAST(date_diff('day', first_day, last_day) // 2 AS INT)) AS DATE) AS middle, CAST(date_trunc('month', last_day) AS DATE) AS newest FROM span),
days AS (SELECT CAST(unnest(generate_series(date_trunc('year', first_day), date_trunc('year', last_day) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
days_md AS (SELECT day, month(day) * 100 + day(day) AS md, year(day) AS y FROM days),
days_term AS (SELECT *, CASE WHEN md >= 805 THEN make_date(y, 8, 5) WHEN md < 105 THEN make_date(y - 1, 8, 5)
   WHEN md BETWEEN 610 AND 804 THEN make_date(y, 6, 10) ELSE make_date(y, 1, 5) END AS term_start,
  CASE WHEN md >= 805 OR md < 105 THEN 'T1' WHEN md BETWEEN 610 AND 804 THEN 'ST' ELSE 'T2' END AS term,
  CASE WHEN md >= 805 THEN y ELSE y - 1 END AS ay FROM days_md),
calendar AS (
 SELECT day,
  CASE WHEN md BETWEEN 101 AND 114 OR md BETWEEN 601 AND 614 THEN 1 ELSE 0 END AS is_enrollment_period,
  CASE WHEN md BETWEEN 515 AND 520 OR md BETWEEN 1215 AND 1220 THEN 1 ELSE 0 END AS is_exam_week,
  CASE WHEN md BETWEEN 424 AND 428 OR md BETWEEN 1210 AND 1212 THEN 1 ELSE 0 END AS is_event_day,
  CASE WHEN md BETWEEN 1222 AND 1231 THEN 1 ELSE 0 END AS is_sem_break,
  CASE WHEN md = 1225 OR (md BETWEEN 201 AND 229 AND isodow(day) = 7) THEN 1 ELSE 0 END AS is_store_closed,
  'AY' || lpad(CAST(ay % 100 AS VARCHAR), 2, '0') || lpad(CAST((ay + 1) % 100 AS VARCHAR), 2, '0') || '-' || term AS semester_id,
  date_diff('day', term_start, day) // 7 + 1 AS semester_week
 FROM days_term),
kinds AS (SELECT *,
  CASE WHEN is_enrollment_period = 1 THEN 'enrollment' WHEN semester_id LIKE '%-T1' AND semester_week BETWEEN 1 AND 2 THEN 'term_start'
   WHEN is_exam_week = 1 THEN 'exam' WHEN is_sem_break = 1 THEN 'sem_break' WHEN is_event_day = 1 THEN 'event' ELSE 'regular' END AS planning_kind,
  CASE WHEN is_enrollment_period = 1 THEN 'enrol' WHEN is_sem_break = 1 THEN 'break' WHEN is_exam_week = 1 THEN 'exam' ELSE 'normal' END AS demand_kind,
  CASE WHEN is_store_closed = 1 THEN 'closed' WHEN is_event_day = 1 THEN 'event' WHEN is_enrollment_period = 1 THEN 'enrollment'
   WHEN is_exam_week = 1 THEN 'exam' WHEN is_sem_break = 1 THEN 'break' END AS sheet_mark,
  CASE WHEN is_store_closed = 1 THEN 'Closed' WHEN is_sem_break = 1 THEN 'Sem break' WHEN is_enrollment_period = 1 THEN 'Enrollment'
   WHEN is_exam_week = 1 THEN 'Exam week' WHEN is_event_day = 1 THEN 'Event' ELSE 'Regular' END AS report_kind
 FROM calendar),
price_change AS (
 SELECT product_id * 2 AS change_id, product_id, DATE '1998-06-01' AS effective_from, CAST(500 + product_id % 300 AS DOUBLE) AS price_php FROM product WHERE product_id % 5 = 0
 UNION ALL SELECT product_id * 2 + 1, product_id, DATE '2000-03-15', CAST(650 + product_id % 200 AS DOUBLE) FROM product WHERE product_id % 10 = 0),
product_months AS (SELECT DISTINCT product_id, CAST(date_trunc('month', day) AS DATE) AS month_start FROM fact),
counts AS (SELECT *, year(month_start) * 12 + month(month_start) - 1 AS month_no,
  (product_id * 7 + (year(month_start) * 12 + month(month_start) - 1) * 13) % 90 AS quantity FROM product_months),
workbook_count AS (SELECT product_id, strftime(month_start, '%Y-%m') AS month, quantity FROM counts WHERE (product_id + month_no) % 4 <> 0),
staff_count AS (SELECT product_id, strftime(month_start, '%Y-%m') AS month, quantity + 5 AS quantity FROM counts WHERE (product_id + month_no) % 3 = 0),
restock_log AS (SELECT o_custkey % 100 AS supplier_id, CAST(o_orderdate AS DATE) AS ordered_on,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey * 31 % 23 + 5 AS INT) END AS delivered_on FROM orders),
upcoming_order AS (SELECT product_id, sku, category, (SELECT last_day FROM span) + CAST(product_id % 30 + 1 AS INT) AS expected_date, product_id % 9 + 1 AS quantity FROM product),
sku_day AS (SELECT sku, category, day, CAST(sum(quantity_sold) AS DOUBLE) AS qty FROM walkin JOIN product USING (product_id) GROUP BY ALL),
hist AS (SELECT min(day) AS d0, max(CASE WHEN qty > 0 THEN day END) AS d1 FROM sku_day),
hist_days AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day, d0, d1 FROM hist),
series AS (
 SELECT k.sku, k.category, h.day, date_diff('day', h.d0, h.day) AS pos, coalesce(s.qty, 0.0) AS qty, date_diff('day', h.d0, h.d1) + 1 AS n
 FROM (SELECT DISTINCT sku, category FROM sku_day) k CROSS JOIN hist_days h LEFT JOIN sku_day s ON s.sku = k.sku AND s.day = h.day),
category_series AS (SELECT category, day, pos, sum(qty) AS qty, n FROM series GROUP BY ALL)"""
