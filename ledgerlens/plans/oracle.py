"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on the raw fixture tables (``lineitem orders customer part
nation`` are views) and starts from the same line-item adapter as
``sources.lines.lines_from_tpch``. Doubles that are not rounded by the
analysis itself are rounded for comparison with ``cmp4`` (the same IEEE
operations in both engines, so equal inputs give equal text).
"""

from __future__ import annotations

from ledgerlens.sources.lines import B2B_SEGMENTS, CUSTOMER_TYPES

ANALYSIS_DATE = "2001-12-31"


# Break points of the comparison grid sit at an irrational offset, so values
# that are exact decimals (means of cents hit x.xxxx5 often) never straddle
# one because of a last-bit difference in summation order.
CMP_OFFSET = 0.41421356237309503


def cmp4(x: str) -> str:
    return f"(floor(({x}) * 10000.0 + {CMP_OFFSET!r}) / 10000.0)"


_b2b = ", ".join(f"'{s}'" for s in B2B_SEGMENTS)
_types = ", ".join(f"'{t}'" for t in CUSTOMER_TYPES)

LINES = f"""
lines_raw AS (
  SELECT l.l_orderkey AS order_id,
         o.o_custkey AS customer_id,
         CASE WHEN c.c_mktsegment IN ({_b2b}) THEN 'B2B' ELSE 'B2C' END AS customer_type,
         p.p_name AS product,
         p.p_type AS category,
         n.n_name AS region,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CASE WHEN l.l_quantity = 0 THEN NULL ELSE l.l_extendedprice / l.l_quantity END AS unit_price,
         l.l_quantity AS quantity,
         CASE WHEN c.c_mktsegment IN ({_b2b}) THEN l.l_discount ELSE 0.0 END AS discount,
         l.l_extendedprice
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
lines AS (
  SELECT order_id, customer_id, customer_type, product, category, region, order_date,
         unit_price, quantity, discount, l_extendedprice * (1.0 - discount) AS total_price
  FROM lines_raw
),
tlines AS (SELECT * FROM lines WHERE customer_type IN ({_types}))"""

LINE_COLS = [
    "order_id", "customer_id", "customer_type", "product", "category", "region",
    "order_date", "unit_price", "quantity", "discount", "total_price",
]
DOUBLE_COLS = ["unit_price", "quantity", "discount", "total_price"]

BASE = f"""{LINES},
base AS (
  SELECT customer_type, customer_id, order_date, coalesce(sum(total_price), 0.0) AS total_price
  FROM tlines GROUP BY customer_type, customer_id, order_date
)"""

MEASURES = """coalesce(sum(quantity), 0.0) AS quantity, avg(discount) AS discount,
         avg(unit_price) AS unit_price, coalesce(sum(total_price), 0.0) AS total_price"""

NUMERIC_INVOICE = f"""{LINES},
inv AS (
  SELECT customer_type, customer_id, order_date, {MEASURES}
  FROM tlines GROUP BY customer_type, customer_id, order_date
)"""

FULL_INVOICE = f"""{LINES},
finv AS (
  SELECT customer_type, order_id, customer_id, order_date, region, {MEASURES}
  FROM tlines GROUP BY customer_type, order_id, customer_id, order_date, region
)"""

CUSTOMERS = f"""{BASE},
cust AS (
  SELECT customer_type, customer_id, max(order_date) AS date_most_recent,
         CAST(date_diff('day', max(order_date), DATE '{ANALYSIS_DATE}') AS BIGINT) AS recency_days,
         count(*) AS transaction_count, coalesce(sum(total_price), 0.0) AS amount
  FROM base GROUP BY customer_type, customer_id
),
cuts AS (
  SELECT customer_type,
         quantile_cont(recency_days, 0.2) AS r1, quantile_cont(recency_days, 0.4) AS r2,
         quantile_cont(recency_days, 0.6) AS r3, quantile_cont(recency_days, 0.8) AS r4,
         quantile_cont(transaction_count, 0.2) AS f1, quantile_cont(transaction_count, 0.4) AS f2,
         quantile_cont(transaction_count, 0.6) AS f3, quantile_cont(transaction_count, 0.8) AS f4,
         quantile_cont(amount, 0.2) AS m1, quantile_cont(amount, 0.4) AS m2,
         quantile_cont(amount, 0.6) AS m3, quantile_cont(amount, 0.8) AS m4
  FROM cust GROUP BY customer_type
),
sc0 AS (
  SELECT c.*,
    CAST(5 - ((recency_days >= r1)::INT + (recency_days >= r2)::INT + (recency_days >= r3)::INT + (recency_days >= r4)::INT) AS INTEGER) AS recency_score,
    CAST(1 + ((transaction_count >= f1)::INT + (transaction_count >= f2)::INT + (transaction_count >= f3)::INT + (transaction_count >= f4)::INT) AS INTEGER) AS frequency_score,
    CAST(1 + ((amount >= m1)::INT + (amount >= m2)::INT + (amount >= m3)::INT + (amount >= m4)::INT) AS INTEGER) AS monetary_score
  FROM cust c JOIN cuts USING (customer_type)
),
scores AS (
  SELECT customer_type, customer_id, date_most_recent, recency_days, transaction_count, amount,
         recency_score, frequency_score, monetary_score,
         recency_score * 100 + frequency_score * 10 + monetary_score AS rfm_score
  FROM sc0
)"""


# Fixed values, written by hand and apart from the library's rule lists, so
# that a wrong rule there shows: the two case lists of the analysis and the
# script's variant of the second, and the level orders of the reports.
SEGMENT_CASES = {
    "lecture": """
  WHEN r BETWEEN 4 AND 5 AND f BETWEEN 4 AND 5 AND m BETWEEN 4 AND 5 THEN 'Champions'
  WHEN r BETWEEN 2 AND 5 AND f BETWEEN 3 AND 5 AND m BETWEEN 3 AND 5 THEN 'Loyal Customers'
  WHEN r BETWEEN 3 AND 5 AND f BETWEEN 1 AND 3 AND m BETWEEN 1 AND 3 THEN 'Potential Loyalist'
  WHEN r BETWEEN 4 AND 5 AND f <= 1 AND m <= 1 THEN 'New Customers'
  WHEN r BETWEEN 3 AND 4 AND f <= 1 AND m <= 1 THEN 'Promising'
  WHEN r BETWEEN 2 AND 3 AND f BETWEEN 2 AND 3 AND m BETWEEN 2 AND 3 THEN 'Need Attention'
  WHEN r BETWEEN 2 AND 3 AND f <= 2 AND m <= 2 THEN 'About To Sleep'
  WHEN r <= 2 AND f BETWEEN 2 AND 5 AND m BETWEEN 2 AND 5 THEN 'At Risk'
  WHEN r <= 1 AND f BETWEEN 4 AND 5 AND m BETWEEN 4 AND 5 THEN 'Can’t Lose Them'
  WHEN r BETWEEN 1 AND 2 AND f BETWEEN 1 AND 2 AND m BETWEEN 1 AND 2 THEN 'Hibernating'
  WHEN r <= 2 AND f <= 2 AND m <= 2 THEN 'Lost'""",
    "custom": """
  WHEN r >= 5 AND f >= 5 AND m >= 5 THEN 'Champions'
  WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Loyal Customers'
  WHEN r >= 4 AND f >= 3 AND m >= 3 THEN 'Potential Loyalist'
  WHEN r >= 4 AND f >= 2 AND m >= 2 THEN 'New Customers'
  WHEN r >= 3 AND f = 2 THEN 'Occasional Shoppers'
  WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Need Attention'
  WHEN r >= 3 AND f = 1 THEN 'Promising'
  WHEN r >= 2 AND f >= 3 THEN 'At Risk'
  WHEN r >= 2 AND f = 2 THEN 'About To Sleep'
  WHEN r >= 1 AND f >= 3 THEN 'Can’t Lose Them'
  WHEN r >= 1 AND f <= 2 AND m <= 3 THEN 'Hibernating'
  WHEN r >= 3 AND m >= 3 THEN 'Active High Value'
  WHEN r >= 3 AND m >= 2 THEN 'Active Medium Value'
  WHEN r < 3 AND m >= 2 THEN 'Dormant High Value'
  WHEN r <= 1 AND f <= 1 AND m <= 1 THEN 'Lost'""",
    "custom16": """
  WHEN r >= 5 AND f >= 5 AND m >= 5 THEN 'Champions'
  WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Loyal Customers'
  WHEN r >= 4 AND f >= 3 AND m >= 3 THEN 'Potential Loyalist'
  WHEN r >= 4 AND f >= 2 AND m >= 2 THEN 'New Customers'
  WHEN r >= 3 AND f = 2 THEN 'Occasional Shoppers'
  WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Need Attention'
  WHEN r >= 3 AND f = 1 THEN 'Promising'
  WHEN r >= 2 AND f >= 3 THEN 'At Risk'
  WHEN r >= 2 AND f = 2 THEN 'About To Sleep'
  WHEN r >= 1 AND f >= 3 THEN 'Can’t Lose Them'
  WHEN r >= 1 AND f <= 2 AND m <= 3 THEN 'Hibernating'
  WHEN r <= 3 AND f <= 1 AND m <= 2 THEN 'Lost'
  WHEN r >= 3 AND m >= 3 THEN 'Active High Value'
  WHEN r >= 3 AND m >= 2 THEN 'Active Medium Value'
  WHEN r < 3 AND m >= 2 THEN 'Dormant High Value'""",
}
SEGMENT_LEVELS = {
    "lecture": "Champions|Loyal Customers|Potential Loyalist|New Customers|Promising|Need Attention|About To Sleep|At Risk|Can’t Lose Them|Hibernating|Lost|Uncategorized",
    "custom": "Champions|Loyal Customers|Potential Loyalist|New Customers|Need Attention|Promising|About To Sleep|At Risk|Can’t Lose Them|Hibernating|Lost|Dormant High Value|Occasional Shoppers",
    "custom16": "Champions|Loyal Customers|Potential Loyalist|New Customers|Need Attention|Promising|About To Sleep|At Risk|Can’t Lose Them|Hibernating|Lost|Active High Value|Active Medium Value|Dormant High Value|Occasional Shoppers|Dormant Big Spenders",
}


def segmented(rule_set: str) -> str:
    return f"""{CUSTOMERS},
seg AS (SELECT *, CASE {SEGMENT_CASES[rule_set]}
  ELSE 'Uncategorized' END AS segment
  FROM (SELECT *, recency_score AS r, frequency_score AS f, monetary_score AS m FROM scores))"""


def half_up(num: str, den: str, digits: int) -> str:
    """Integer-exact half-up rounding of num/den (see segments.half_up_ratio)."""
    scale = 10**digits
    return (
        f"(CAST(sign({num}) * ((abs(CAST({num} AS HUGEINT)) * {2 * scale} + ({den})) // (2 * ({den}))) AS DOUBLE) / {float(scale)})"
    )


def segment_report(rule_set: str) -> str:
    levels = SEGMENT_LEVELS[rule_set].split("|")
    vals = ", ".join(
        f"('{t}', '{s}', {i + 1})" for t in CUSTOMER_TYPES for i, s in enumerate(levels)
    )
    return f"""WITH {segmented(rule_set)},
agg0 AS (
  SELECT customer_type, segment, count(*) AS no_customers,
         sum(CAST(floor(amount * 10000.0 + 0.5) AS HUGEINT)) AS s_amt,
         sum(CAST(transaction_count AS HUGEINT)) AS s_tc, sum(CAST(recency_days AS HUGEINT)) AS s_rd
  FROM seg GROUP BY customer_type, segment
),
agg AS (
  SELECT customer_type, segment, no_customers,
         {half_up('s_amt', 'no_customers * 10000', 2)} AS avg_spending,
         {half_up('s_tc', 'no_customers', 2)} AS avg_transactions,
         {half_up('s_rd', 'no_customers', 1)} AS avg_recency_days
  FROM agg0
),
tot AS (SELECT customer_type, CAST(sum(no_customers) AS BIGINT) AS total_customers FROM agg GROUP BY customer_type),
dim AS (SELECT * FROM (VALUES {vals}) AS t(customer_type, segment, seg_order))
SELECT d.customer_type, d.segment,
       CAST(coalesce(a.no_customers, 0) AS BIGINT) AS no_customers,
       coalesce(a.avg_spending, 0.0) AS avg_spending,
       coalesce(a.avg_transactions, 0.0) AS avg_transactions,
       coalesce(a.avg_recency_days, 0.0) AS avg_recency_days,
       t.total_customers,
       coalesce({half_up('100 * a.no_customers', 't.total_customers', 1)}, 0.0) AS percentage
FROM dim d JOIN tot t USING (customer_type)
LEFT JOIN agg a USING (customer_type, segment)
ORDER BY d.customer_type, d.seg_order"""


def profile_sql(source_cte: str, table: str) -> str:
    cols = ["discount", "quantity", "total_price", "unit_price"]
    parts = " UNION ALL ".join(
        f"SELECT customer_type, '{c}' AS variable, {i + 1} AS var_order, CAST({c} AS DOUBLE) AS value FROM {table}"
        for i, c in enumerate(cols)
    )
    return f"""WITH {source_cte},
lv AS ({parts}),
cl AS (SELECT *, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM lv)
SELECT customer_type, variable, count(*) AS count,
       {cmp4('avg(v)')} AS mean, {cmp4('stddev_samp(v)')} AS sd, {cmp4('min(v)')} AS min,
       {cmp4('quantile_cont(v, 0.25)')} AS q25, {cmp4('quantile_cont(v, 0.5)')} AS median,
       {cmp4('quantile_cont(v, 0.75)')} AS q75, {cmp4('max(v)')} AS max
FROM cl GROUP BY customer_type, variable, var_order
ORDER BY customer_type, var_order"""


def _line_select(exprs: dict[str, str] | None = None) -> str:
    exprs = exprs or {}
    out = []
    for c in LINE_COLS:
        e = exprs.get(c, c)
        out.append(f"{cmp4(e)} AS {c}" if c in DOUBLE_COLS else f"{e} AS {c}")
    return ", ".join(out)


def histogram(metric: str, n_bins: int = 30) -> str:
    col = {"recency": "recency_days", "frequency": "transaction_count", "monetary": "amount"}[metric]
    return f"""WITH {CUSTOMERS},
rng AS (SELECT customer_type, min(CAST({col} AS DOUBLE)) AS mn, max(CAST({col} AS DOUBLE)) AS mx FROM scores GROUP BY customer_type),
b AS (
  SELECT s.customer_type, mn, mx,
         CAST(CASE WHEN mx - mn = 0 THEN 0
              ELSE least(floor((CAST({col} AS DOUBLE) - mn) * {float(n_bins)} / (mx - mn)), {n_bins - 1}) END AS INTEGER) AS bin
  FROM scores s JOIN rng USING (customer_type) WHERE {col} IS NOT NULL
)
SELECT customer_type, bin,
       {cmp4(f'mn + bin * (mx - mn) / {float(n_bins)}')} AS bin_lo,
       {cmp4(f'mn + (bin + 1) * (mx - mn) / {float(n_bins)}')} AS bin_hi,
       count(*) AS n_customers
FROM b GROUP BY customer_type, bin, mn, mx"""


# the dirtying projection of ``catalog.dirty_lines``
DIRTY = f"""{LINES},
d0 AS (
  SELECT order_id, customer_id, customer_type,
         CASE WHEN order_id % 31 = 10 THEN '' ELSE product END AS product, category,
         CASE WHEN order_id % 37 = 11 THEN '' ELSE region END AS region, order_date,
         CASE WHEN order_id % 19 = 7 THEN 0.0 WHEN order_id % 23 = 8 THEN NULL ELSE unit_price END AS unit_price,
         CASE WHEN order_id % 11 = 3 THEN 'NaN'::DOUBLE WHEN order_id % 13 = 5 THEN -quantity ELSE quantity END AS quantity,
         CASE WHEN order_id % 7 = 2 THEN NULL WHEN order_id % 11 = 4 THEN 'NaN'::DOUBLE WHEN order_id % 17 = 6 THEN 1.5 ELSE discount END AS discount,
         CASE WHEN order_id % 11 = 3 THEN 'NaN'::DOUBLE WHEN order_id % 29 = 9 THEN -total_price ELSE total_price END AS total_price
  FROM lines
),
dirty AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE order_id % 41 = 12),
dknown AS (
  SELECT * REPLACE (CASE WHEN isnan(unit_price) THEN NULL ELSE unit_price END AS unit_price,
                    CASE WHEN isnan(quantity) THEN NULL ELSE quantity END AS quantity,
                    CASE WHEN isnan(discount) THEN NULL ELSE discount END AS discount,
                    CASE WHEN isnan(total_price) THEN NULL ELSE total_price END AS total_price)
  FROM dirty
)"""


def oracle_sql() -> dict[str, str]:
    blank = {c: f"NULLIF({c}, '')" for c in ("customer_type", "product", "category", "region")}
    blanked = ", ".join(f"{blank.get(c, c)} AS {c}" for c in LINE_COLS)
    null_parts = " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{c}' AS column_name, "
        f"CAST(count_if({c} IS NULL{' OR isnan(' + c + ')' if c in DOUBLE_COLS else ''}) AS BIGINT) AS n_missing FROM bl"
        for i, c in enumerate(LINE_COLS)
    )
    all_cols = ", ".join(LINE_COLS)
    q: dict[str, str] = {
        "date_range": f"WITH {LINES} SELECT min(order_date) AS min_date, max(order_date) AS max_date FROM lines",
        "null_profile": f"WITH {LINES}, bl AS (SELECT {blanked} FROM lines) {null_parts}",
        "duplicate_count": f"""WITH {LINES},
bl AS (SELECT {blanked} FROM lines),
g AS (SELECT {all_cols}, count(*) AS c FROM bl GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM g""",
        "invalid_count": f"""WITH {LINES}
SELECT CAST(count_if(unit_price <= 0 OR quantity <= 0 OR discount < 0 OR discount > 1 OR total_price < 0) AS BIGINT) AS invalid_rows,
       CAST(count_if(unit_price <= 0) AS BIGINT) AS bad_unit_price, CAST(count_if(quantity <= 0) AS BIGINT) AS bad_quantity,
       CAST(count_if(discount < 0 OR discount > 1) AS BIGINT) AS bad_discount, CAST(count_if(total_price < 0) AS BIGINT) AS bad_total_price
FROM lines""",
        "null_profile_dirty": f"WITH {DIRTY}, bl AS (SELECT {blanked} FROM dirty) {null_parts}",
        "duplicate_count_dirty": f"""WITH {DIRTY},
bl AS (SELECT {blanked} FROM dirty),
g AS (SELECT {all_cols}, count(*) AS c FROM bl GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM g""",
        "invalid_count_dirty": f"""WITH {DIRTY}
SELECT CAST(count_if(unit_price <= 0 OR quantity <= 0 OR discount < 0 OR discount > 1 OR total_price < 0) AS BIGINT) AS invalid_rows,
       CAST(count_if(unit_price <= 0) AS BIGINT) AS bad_unit_price, CAST(count_if(quantity <= 0) AS BIGINT) AS bad_quantity,
       CAST(count_if(discount < 0 OR discount > 1) AS BIGINT) AS bad_discount, CAST(count_if(total_price < 0) AS BIGINT) AS bad_total_price
FROM dknown""",
        "blank_to_null_dirty": f"""WITH {DIRTY}
SELECT order_id, customer_id, NULLIF(product, '') AS product, NULLIF(region, '') AS region, order_date FROM dirty""",
        "numeric_invoice_dirty": f"""WITH {DIRTY},
inv AS (
  SELECT customer_type, customer_id, order_date, {MEASURES}
  FROM dknown GROUP BY customer_type, customer_id, order_date
)
SELECT customer_type, customer_id, order_date, {cmp4('quantity')} AS quantity, {cmp4('discount')} AS discount,
       {cmp4('unit_price')} AS unit_price, {cmp4('total_price')} AS total_price FROM inv""",
        "top_products_dirty": f"""WITH {DIRTY},
pr AS (SELECT customer_type, product, coalesce(sum(total_price), 0.0) AS total_revenue FROM dknown GROUP BY customer_type, product),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer_type ORDER BY total_revenue DESC, product ASC) AS INTEGER) AS rank FROM pr)
SELECT customer_type, rank, product, {cmp4('total_revenue')} AS total_revenue FROM rk WHERE rank <= 10""",
        "rfm_customer_default_date": f"""WITH {BASE},
day AS (SELECT make_date(CAST(year(max(order_date)) AS BIGINT), 12, 31) AS d FROM base)
SELECT customer_type, customer_id, max(order_date) AS date_most_recent,
       CAST(date_diff('day', max(order_date), any_value(d)) AS BIGINT) AS recency_days,
       count(*) AS transaction_count, {cmp4('coalesce(sum(total_price), 0.0)')} AS amount
FROM base, day GROUP BY customer_type, customer_id""",
        "clean_columns": f"WITH {LINES} SELECT {_line_select()} FROM lines",
        "blank_to_null": f"WITH {LINES} SELECT {_line_select(blank)} FROM lines",
        "preview": f"""WITH {LINES}
SELECT {_line_select()} FROM lines
ORDER BY {', '.join(c + ' ASC NULLS FIRST' for c in LINE_COLS)} LIMIT 4""",
        "rfm_base": f"WITH {BASE} SELECT customer_type, customer_id, order_date, {cmp4('total_price')} AS total_price FROM base",
        "numeric_invoice": f"""WITH {NUMERIC_INVOICE}
SELECT customer_type, customer_id, order_date, {cmp4('quantity')} AS quantity, {cmp4('discount')} AS discount,
       {cmp4('unit_price')} AS unit_price, {cmp4('total_price')} AS total_price FROM inv""",
        "full_invoice": f"""WITH {FULL_INVOICE}
SELECT customer_type, order_id, customer_id, order_date, region, {cmp4('quantity')} AS quantity,
       {cmp4('discount')} AS discount, {cmp4('unit_price')} AS unit_price, {cmp4('total_price')} AS total_price FROM finv""",
        "combined_invoices": f"""WITH {FULL_INVOICE}
SELECT customer_type, order_id, customer_id, order_date, region, {cmp4('quantity')} AS quantity,
       {cmp4('discount')} AS discount, {cmp4('unit_price')} AS unit_price, {cmp4('total_price')} AS total_price FROM finv""",
        "top_products": f"""WITH {LINES},
pr AS (SELECT customer_type, product, coalesce(sum(total_price), 0.0) AS total_revenue FROM tlines GROUP BY customer_type, product),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer_type ORDER BY total_revenue DESC, product ASC) AS INTEGER) AS rank FROM pr)
SELECT customer_type, rank, product, {cmp4('total_revenue')} AS total_revenue FROM rk WHERE rank <= 10""",
        "line_summary": profile_sql(LINES, "tlines"),
        "invoice_summary": profile_sql(NUMERIC_INVOICE, "inv"),
        "rfm_customer": f"""WITH {CUSTOMERS}
SELECT customer_type, customer_id, date_most_recent, recency_days, transaction_count, {cmp4('amount')} AS amount FROM cust""",
        "rfm_scores": f"""WITH {CUSTOMERS}
SELECT customer_type, customer_id, date_most_recent, recency_days, transaction_count, {cmp4('amount')} AS amount,
       recency_score, frequency_score, monetary_score, rfm_score FROM scores""",
        "rfm_score_counts": f"""WITH {CUSTOMERS}
SELECT customer_type, rfm_score, recency_score, frequency_score, monetary_score, count(*) AS n_customers
FROM scores GROUP BY ALL""",
        "rfm_histogram_recency": histogram("recency"),
        "rfm_histogram_frequency": histogram("frequency"),
        "rfm_histogram_monetary": histogram("monetary"),
        "rfm_order_dist": f"""WITH {CUSTOMERS}
SELECT customer_type, transaction_count, count(*) AS n_customers FROM scores GROUP BY ALL""",
        "rfm_heatmap": f"""WITH {CUSTOMERS}
SELECT customer_type, recency_score, frequency_score, {cmp4('avg(amount)')} AS avg_monetary, count(*) AS n_customers
FROM scores GROUP BY customer_type, recency_score, frequency_score""",
        "rfm_scatter": f"""WITH {CUSTOMERS}
SELECT customer_type, customer_id, recency_days, {cmp4('amount')} AS amount FROM scores""",
        "segment_report_lecture": segment_report("lecture"),
        "segment_report_custom": segment_report("custom"),
        "segment_report_custom16": segment_report("custom16"),
        "report_sink": segment_report("lecture"),
    }
    for metric in ("recency", "frequency", "monetary"):
        q[f"rfm_score_dist_{metric}"] = f"""WITH {CUSTOMERS}
SELECT customer_type, {metric}_score AS score, count(*) AS n_customers FROM scores GROUP BY ALL"""
    for rs in ("lecture", "custom"):
        q[f"segment_{rs}"] = f"""WITH {segmented(rs)}
SELECT customer_type, customer_id, recency_score, frequency_score, monetary_score, rfm_score, segment FROM seg"""
    q.update(regression_sql())
    q["coef_compare"] = coef_compare_sql()
    q["invoice_model_metrics"] = invoice_metrics_sql()
    q.update(predict_sql())
    q["coef_table"] = coef_table_sql()
    q["train_test_split_stratified"] = f"""WITH {NUMERIC_INVOICE},
cuts AS (
  SELECT customer_type, quantile_cont(total_price, 0.25) AS c1, quantile_cont(total_price, 0.5) AS c2,
         quantile_cont(total_price, 0.75) AS c3
  FROM inv GROUP BY customer_type
),
b AS (
  SELECT inv.customer_type, customer_id, order_date,
         (total_price > c1)::INT + (total_price > c2)::INT + (total_price > c3)::INT AS bin,
         substr(md5(concat_ws('|', CAST(customer_id AS VARCHAR), CAST(order_date AS VARCHAR))), 1, 8) AS hx
  FROM inv JOIN cuts USING (customer_type)
),
r AS (
  SELECT *, rank() OVER (PARTITION BY customer_type, bin ORDER BY hx) AS rk,
         count(*) OVER (PARTITION BY customer_type, bin) AS nb
  FROM b
)
SELECT customer_type, customer_id, order_date, rk <= ceil(0.8 * nb) AS is_train FROM r"""
    q["uncategorized_sample"] = f"""WITH {segmented('lecture')},
u AS (SELECT *, row_number() OVER (PARTITION BY customer_type ORDER BY customer_id) AS rn FROM seg WHERE segment = 'Uncategorized')
SELECT customer_type, customer_id, recency_score, frequency_score, monetary_score, {cmp4('amount')} AS amount,
       transaction_count, recency_days FROM u WHERE rn <= 10"""
    q["top_products_csv"] = q["top_products"]
    q["glimpse"] = glimpse_sql()
    q["ols_moments_merged"] = q["ols_moments"]
    q["ols_predict_stored"] = q["ols_predict"]
    q["rfm_customer_merged"] = q["rfm_customer"]
    q["ols_customer_effects"] = customer_effects_sql()
    q["line_summary_approx"] = f"""SELECT customer_type, variable, count, mean, sd, min, max, TRUE AS quartiles_ok FROM ({q['line_summary']})"""
    q.update(quality_run_sql(f"WITH {DIRTY}, bl AS (SELECT {blanked} FROM dirty)"))
    from ledgerlens.plans import sweep_sql

    q.update(sweep_sql.oracle(q["train_test_split_stratified"]))
    return q


def glimpse_sql(n: int = 4) -> str:
    kinds = dict.fromkeys(("order_id", "customer_id"), "bigint") | dict.fromkeys(DOUBLE_COLS, "double") | {"order_date": "date"}
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in LINE_COLS)
    parts = " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INTEGER) AS position, '{c}' AS column_name, '{kinds.get(c, 'string')}' AS data_type, "
        f"(SELECT string_agg(coalesce(CAST({c} AS VARCHAR), 'NA'), ', ' ORDER BY rn) FROM head) AS sample"
        for i, c in enumerate(LINE_COLS)
    )
    return f"""WITH {LINES},
head AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM lines) WHERE rn <= {n})
{parts}"""


def cmp_sig(x: str, digits: int = 9) -> str:
    """Round to ``digits`` significant digits (for large sums of squares).

    Only exact powers of ten (10^k, k >= 0) are used, so both engines do the
    same IEEE operations."""
    e = f"(floor(log10(abs({x}))) - {digits - 1})"
    return (
        f"(CASE WHEN ({x}) = 0 OR ({x}) IS NULL THEN ({x}) "
        f"WHEN {e} >= 0 THEN floor(({x}) / pow(10.0, {e}) + {CMP_OFFSET!r}) * pow(10.0, {e}) "
        f"ELSE floor(({x}) * pow(10.0, -{e}) + {CMP_OFFSET!r}) / pow(10.0, -{e}) END)"
    )


def regression_sql() -> dict[str, str]:
    vs = ["quantity", "discount", "unit_price", "total_price"]
    means = ", ".join(f"{cmp_sig(f'avg({v})')} AS mean_{v}" for v in vs)
    covs = ", ".join(
        f"{cmp_sig(f'covar_pop({a}, {b})')} AS cov_{a}__{b}" for i, a in enumerate(vs) for b in vs[i:]
    )
    notnull = " AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in vs) + " AND region IS NOT NULL"
    return {
        "ols_moments": f"""WITH {FULL_INVOICE}
SELECT customer_type, region, count(*) AS n, {means}, {covs}
FROM finv WHERE {notnull} GROUP BY customer_type, region""",
        "train_test_split": f"""WITH {NUMERIC_INVOICE}
SELECT customer_type, customer_id, order_date,
       substr(md5(concat_ws('|', CAST(customer_id AS VARCHAR), CAST(order_date AS VARCHAR))), 1, 8) < 'cccccccc' AS is_train
FROM inv""",
    }


def coef_compare_sql(digits: int = 6) -> str:
    """Slopes of total_price ~ quantity + discount + unit_price + region per type.

    Independent of the Spark solver: the slopes of a model with region
    effects equal the within-region regression, solved here from pooled
    within-region co-moments by Cramer's rule. A constant discount (all
    values equal within the type) is aliased and the 2x2 system is solved.
    Standard errors use sigma² = RSS / (n - rank), rank = 1 + slopes + (R - 1).
    """
    xs = ["quantity", "discount", "unit_price"]
    pairs = [(a, b) for i, a in enumerate(xs + ["total_price"]) for b in (xs + ["total_price"])[i:]]
    s_reg = ", ".join(f"covar_pop({a}, {b}) * count(*) AS s_{a}__{b}" for a, b in pairs)
    s_sum = ", ".join(f"sum(s_{a}__{b}) AS s_{a}__{b}" for a, b in pairs)
    notnull = " AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in xs + ["total_price"]) + " AND region IS NOT NULL"
    q, d, u, y = "s_quantity__quantity", "s_discount__discount", "s_unit_price__unit_price", "s_total_price__total_price"
    qd, qu, du = "s_quantity__discount", "s_quantity__unit_price", "s_discount__unit_price"
    qy, dy, uy = "s_quantity__total_price", "s_discount__total_price", "s_unit_price__total_price"
    det3 = f"({q} * ({d} * {u} - {du} * {du}) - {qd} * ({qd} * {u} - {du} * {qu}) + {qu} * ({qd} * {du} - {d} * {qu}))"
    b1_3 = f"({qy} * ({d} * {u} - {du} * {du}) - {qd} * ({dy} * {u} - {du} * {uy}) + {qu} * ({dy} * {du} - {d} * {uy})) / {det3}"
    b2_3 = f"({q} * ({dy} * {u} - {uy} * {du}) - {qy} * ({qd} * {u} - {du} * {qu}) + {qu} * ({qd} * {uy} - {dy} * {qu})) / {det3}"
    b3_3 = f"({q} * ({d} * {uy} - {du} * {dy}) - {qd} * ({qd} * {uy} - {dy} * {qu}) + {qy} * ({qd} * {du} - {d} * {qu})) / {det3}"
    det2 = f"({q} * {u} - {qu} * {qu})"
    b1_2 = f"({qy} * {u} - {qu} * {uy}) / {det2}"
    b3_2 = f"({q} * {uy} - {qu} * {qy}) / {det2}"
    inv = {
        "quantity": (f"({d} * {u} - {du} * {du}) / {det3}", f"{u} / {det2}"),
        "discount": (f"({q} * {u} - {qu} * {qu}) / {det3}", "NULL"),
        "unit_price": (f"({q} * {d} - {qd} * {qd}) / {det3}", f"{q} / {det2}"),
    }
    est = {"quantity": (b1_3, b1_2), "discount": (b2_3, "NULL"), "unit_price": (b3_3, b3_2)}
    parts = []
    for t in xs:
        e = f"CASE WHEN al THEN {est[t][1]} ELSE {est[t][0]} END"
        v = f"CASE WHEN al THEN {inv[t][1]} ELSE {inv[t][0]} END"
        parts.append(
            f"SELECT '{t}' AS term, customer_type AS \"group\", {cmp_sig(e, digits)} AS estimate, "
            f"{cmp_sig(f'sqrt(sigma2 * ({v}))', digits)} AS std_error, "
            f"{'al' if t == 'discount' else 'FALSE'} AS aliased FROM s2"
        )
    return f"""WITH {FULL_INVOICE},
m AS (SELECT * FROM finv WHERE {notnull}),
reg AS (SELECT customer_type, region, {s_reg} FROM m GROUP BY customer_type, region),
w AS (SELECT customer_type, count(*) AS n_regions, {s_sum} FROM reg GROUP BY customer_type),
tot AS (SELECT customer_type, count(*) AS n, var_pop(discount) AS v_d, avg(discount * discount) AS r_d FROM m GROUP BY customer_type),
s1 AS (SELECT w.*, tot.n, (tot.v_d <= 1e-14 * tot.r_d) AS al FROM w JOIN tot USING (customer_type)),
s2 AS (
  SELECT s1.*,
         ({y} - CASE WHEN al THEN ({b1_2}) * {qy} + ({b3_2}) * {uy}
                     ELSE ({b1_3}) * {qy} + ({b2_3}) * {dy} + ({b3_3}) * {uy} END)
         / (n - (CASE WHEN al THEN 2 ELSE 3 END) - n_regions) AS sigma2
  FROM s1
)
{' UNION ALL '.join(parts)}"""


def _perm_sign(p):
    sign, p = 1, list(p)
    for i in range(len(p)):
        while p[i] != i:
            j = p[i]
            p[i], p[j] = p[j], p[i]
            sign = -sign
    return sign


def _det(m: list[list[str]]) -> str:
    """Leibniz determinant of a small matrix of SQL expressions."""
    from itertools import permutations

    k = len(m)
    terms = []
    for p in permutations(range(k)):
        s = _perm_sign(p)
        prod = " * ".join(m[i][p[i]] for i in range(k))
        terms.append(("+ " if s > 0 else "- ") + f"({prod})")
    return "(" + " ".join(terms) + ")"


def _cramer(vs: list[str], S) -> dict[str, str]:
    """Slopes b_v solving S_xx b = S_xy for the numerics ``vs``."""
    mat = [[S(a, b) for b in vs] for a in vs]
    rhs = [S(a, "y") for a in vs]
    det = _det(mat)
    out = {}
    for j, v in enumerate(vs):
        mj = [[rhs[i] if c == j else mat[i][c] for c in range(len(vs))] for i in range(len(vs))]
        out[v] = f"({_det(mj)} / {det})"
    return out


def _fit_predict_metrics(name: str, source_cte: str, table: str, keys: list[str], xs: list[str], factor: str | None, digits: int = 6) -> str:
    """SQL for hold-out metrics of ``total_price ~ xs (+ factor)`` per type.

    Slopes come from within-level co-moments of the training rows (or plain
    co-moments without a factor); level intercepts are ybar - b·xbar; a
    constant ``discount`` is aliased (dropped) as in the Spark solver.
    """
    split = f"substr(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8) < 'cccccccc'"
    lv = [factor] if factor else []
    allv = xs + ["y"]
    src = ", ".join([f"{x} AS {x}" for x in xs] + ["total_price AS y"])
    notnull = " AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in xs + ["total_price"])
    if factor:
        notnull += f" AND {factor} IS NOT NULL"
    grp = ", ".join(["customer_type", *lv])
    comoments = ", ".join(
        f"covar_pop({a}, {b}) * count(*) AS s_{a}__{b}" for i, a in enumerate(allv) for b in allv[i:]
    )
    means = ", ".join(f"avg({v}) AS m_{v}" for v in allv)
    pooled = ", ".join(f"sum(s_{a}__{b}) AS s_{a}__{b}" for i, a in enumerate(allv) for b in allv[i:])

    def S(a, b):
        i, j = allv.index(a), allv.index(b)
        a, b = (a, b) if i <= j else (b, a)
        return f"s_{a}__{b}"

    full = _cramer(xs, S)
    red_x = [x for x in xs if x != "discount"]
    red = _cramer(red_x, S)
    slope = {x: f"CASE WHEN al THEN {red[x] if x in red else 'NULL'} ELSE {full[x]} END" for x in xs}
    slope_cols = ", ".join(f"{slope[x]} AS b_{x}" for x in xs)
    fit_xb = " + ".join(f"coalesce(b_{x}, 0) * m_{x}" for x in xs)
    pred_xb = " + ".join(f"coalesce(b_{x}, 0) * t.{x}" for x in xs)
    join_lv = f" AND t.{factor} = c.{factor}" if factor else ""
    mets = {
        "rmse_test": "sqrt(avg(e2))",
        "r2_corr": "CASE WHEN var_pop(ys) > 0 AND var_pop(p) > 0 THEN covar_pop(ys, p) * covar_pop(ys, p) / (var_pop(ys) * var_pop(p)) END",
        "test_r2": "CASE WHEN var_pop(ys) * count(e2) > 0 THEN 1 - sum(e2) / (var_pop(ys) * count(e2)) END",
    }
    sel = ", ".join(f"{cmp_sig(e, digits)} AS {k}" for k, e in mets.items())
    return f"""WITH {source_cte},
mf AS (SELECT customer_type, {', '.join(keys)}{', ' + factor if factor and factor not in keys else ''}, {src}, {split} AS is_train
       FROM {table} WHERE {notnull}),
tr AS (SELECT * FROM mf WHERE is_train),
cell AS (SELECT {grp}, {comoments}, {means} FROM tr GROUP BY {grp}),
pool AS (SELECT customer_type, {pooled} FROM cell GROUP BY customer_type),
al AS (SELECT customer_type, var_pop(discount) <= 1e-14 * avg(discount * discount) AS al FROM tr GROUP BY customer_type),
sl AS (SELECT pool.customer_type, {slope_cols} FROM pool JOIN al USING (customer_type)),
c AS (SELECT cell.customer_type{', cell.' + factor if factor else ''}, sl.*, m_y - ({fit_xb}) AS a
      FROM cell JOIN sl USING (customer_type)),
sc AS (
  SELECT t.customer_type, t.y, c.a + {pred_xb} AS p
  FROM mf t LEFT JOIN c ON t.customer_type = c.customer_type{join_lv}
  WHERE NOT t.is_train
),
ev AS (SELECT customer_type, y, p, CASE WHEN p IS NOT NULL THEN y END AS ys,
              CASE WHEN p IS NOT NULL THEN (y - p) * (y - p) END AS e2 FROM sc)
SELECT '{name}' AS model, customer_type, {sel}, count(*) AS n_test, CAST(count_if(p IS NULL) AS BIGINT) AS n_unscored
FROM ev GROUP BY customer_type"""


def invoice_metrics_sql() -> str:
    xs = ["quantity", "discount", "unit_price"]
    a = _fit_predict_metrics("invoice", NUMERIC_INVOICE, "inv", ["customer_id", "order_date"], xs, None)
    fq = FULL_INVOICE.replace(
        "FROM tlines GROUP BY customer_type, order_id, customer_id, order_date, region\n)",
        "FROM tlines GROUP BY customer_type, order_id, customer_id, order_date, region\n),\nfinvq AS (SELECT *, CAST(quarter(order_date) AS DOUBLE) AS quarter FROM finv)",
    )
    b = _fit_predict_metrics(
        "invoice_region_quarter", fq, "finvq", ["order_id", "customer_id", "order_date", "region"], xs + ["quarter"], "region"
    )
    return f"SELECT * FROM ({a}) UNION ALL SELECT * FROM ({b})"


def _region_model_cte(digits: int = 6) -> str:
    """Full-data fit of total_price ~ quantity + discount + unit_price + region
    per type (within-region Cramer solve), with per-row predictions ``pr``."""
    xs = ["quantity", "discount", "unit_price"]
    allv = xs + ["y"]
    notnull = " AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in xs + ["total_price"]) + " AND region IS NOT NULL"
    comoments = ", ".join(f"covar_pop({a}, {b}) * count(*) AS s_{a}__{b}" for i, a in enumerate(allv) for b in allv[i:])
    means = ", ".join(f"avg({v}) AS m_{v}" for v in allv)
    pooled = ", ".join(f"sum(s_{a}__{b}) AS s_{a}__{b}" for i, a in enumerate(allv) for b in allv[i:])

    def S(a, b):
        i, j = allv.index(a), allv.index(b)
        a, b = (a, b) if i <= j else (b, a)
        return f"s_{a}__{b}"

    full, red = _cramer(xs, S), _cramer(["quantity", "unit_price"], S)
    slope_cols = ", ".join(
        f"CASE WHEN al THEN {red.get(x, 'NULL')} ELSE {full[x]} END AS b_{x}" for x in xs
    )
    fit_xb = " + ".join(f"coalesce(b_{x}, 0) * m_{x}" for x in xs)
    pred_xb = " + ".join(f"coalesce(b_{x}, 0) * t.{x}" for x in xs)
    return f"""{FULL_INVOICE},
mf AS (SELECT customer_type, order_id, customer_id, order_date, region, quantity, discount, unit_price,
              total_price, total_price AS y FROM finv WHERE {notnull}),
cell AS (SELECT customer_type, region, {comoments}, {means} FROM mf GROUP BY customer_type, region),
pool AS (SELECT customer_type, {pooled} FROM cell GROUP BY customer_type),
al AS (SELECT customer_type, var_pop(discount) <= 1e-14 * avg(discount * discount) AS al FROM mf GROUP BY customer_type),
sl AS (SELECT pool.customer_type, {slope_cols} FROM pool JOIN al USING (customer_type)),
c AS (SELECT cell.customer_type, cell.region, sl.*, m_y - ({fit_xb}) AS a FROM cell JOIN sl USING (customer_type)),
pr AS (SELECT t.*, c.a + {pred_xb} AS prediction FROM mf t JOIN c ON t.customer_type = c.customer_type AND t.region = c.region)"""


def predict_sql() -> dict[str, str]:
    cte = _region_model_cte()
    dbl = ["quantity", "discount", "unit_price", "total_price"]
    pred = f"""WITH {cte}
SELECT customer_type, order_id, customer_id, order_date, region,
       {', '.join(f'{cmp4(c)} AS {c}' for c in dbl)}, {cmp_sig('prediction', 6)} AS prediction
FROM pr"""
    qs = {"min": "min(r)", "q25": "quantile_cont(r, 0.25)", "median": "quantile_cont(r, 0.5)", "q75": "quantile_cont(r, 0.75)", "max": "max(r)"}
    resid = f"""WITH {cte},
rr AS (SELECT customer_type, total_price - prediction AS r FROM pr)
SELECT customer_type, {', '.join(f'{cmp_sig(e, 6)} AS {k}' for k, e in qs.items())}
FROM rr GROUP BY customer_type"""
    return {"ols_predict": pred, "ols_residuals": resid}


def coef_table_sql(digits: int = 6) -> str:
    """All coefficients (term, estimate, group) of the invoice model with region:
    intercept = baseline region's intercept, region effects relative to it."""
    cte = _region_model_cte()
    e = lambda x: cmp_sig(x, digits)
    return f"""WITH {cte},
base AS (SELECT customer_type, min(region) AS region FROM c GROUP BY customer_type),
ab AS (SELECT c.* FROM c JOIN base USING (customer_type, region))
SELECT '(Intercept)' AS term, customer_type AS "group", {e('a')} AS estimate FROM ab
UNION ALL SELECT 'quantity', customer_type, {e('b_quantity')} FROM ab
UNION ALL SELECT 'discount', customer_type, {e('b_discount')} FROM ab
UNION ALL SELECT 'unit_price', customer_type, {e('b_unit_price')} FROM ab
UNION ALL SELECT 'region' || c.region, c.customer_type, {e('c.a - ab.a')}
  FROM c JOIN ab USING (customer_type) WHERE c.region <> ab.region"""


RULES = {
    "bad_unit_price": "unit_price <= 0",
    "bad_quantity": "quantity <= 0",
    "bad_discount": "(discount < 0 OR (discount > 1 AND NOT isnan(discount)))",
    "bad_total_price": "total_price < 0",
}


def quality_run_sql(source: str) -> dict[str, str]:
    """The one-scan report and its rejects over the CTE ``bl`` of ``source``."""
    measures = [("rows", "all", "count(*)"), ("rows", "rejected", f"count_if({' OR '.join(RULES.values())})")]
    measures += [("missing", c, f"count_if({c} IS NULL{f' OR isnan({c})' if c in DOUBLE_COLS else ''})") for c in LINE_COLS]
    measures += [("broken_rule", name, f"count_if({rule})") for name, rule in RULES.items()]
    measures += [("date", "first", "min(order_date)"), ("date", "last", "max(order_date)")]
    parts = " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INTEGER) AS position, '{section}' AS section, '{name}' AS name, CAST({m} AS VARCHAR) AS value FROM bl" for i, (section, name, m) in enumerate(measures)
    )
    broken = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULES.items())
    return {
        "quality_report_dirty": f"{source} {parts}",
        "quality_rejects_dirty": f"{source} SELECT order_id, customer_id, product, order_date, concat_ws(',', {broken}) AS failed_rules FROM bl WHERE {' OR '.join(RULES.values())}",
    }


def customer_effects_sql(digits: int = 6) -> str:
    """Slopes beside customer effects: each variable less its customer's mean, then Cramer's rule.

    A customer has one region, so region adds nothing to the customers and is left out: its effects are aliased.
    """
    xs = ["quantity", "discount", "unit_price"]
    allv = [*xs, "y"]
    notnull = " AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in [*xs, "total_price"]) + " AND region IS NOT NULL AND customer_id IS NOT NULL"

    def S(a, b):
        i, j = sorted((allv.index(a), allv.index(b)))
        return f"s_{allv[i]}__{allv[j]}"

    pooled = ", ".join(f"fsum(w_{a} * w_{b}) AS {S(a, b)}" for i, a in enumerate(allv) for b in allv[i:])
    some = ["quantity", "unit_price"]
    full, red = _cramer(xs, S), _cramer(some, S)

    def variance(x, vs):
        rest = [v for v in vs if v != x]
        return f"({_det([[S(a, b) for b in rest] for a in rest])} / {_det([[S(a, b) for b in vs] for a in vs])})"

    b = {x: f"CASE WHEN al THEN {red.get(x, 'NULL')} ELSE {full[x]} END" for x in xs}
    v = {x: f"CASE WHEN al THEN {variance(x, some) if x in some else 'NULL'} ELSE {variance(x, xs)} END" for x in xs}
    fitted = " + ".join(f"coalesce(b_{x}, 0) * {S(x, 'y')}" for x in xs)
    rows = " UNION ALL ".join(
        f"SELECT customer_type, '{x}' AS term, {cmp_sig(f'b_{x}', digits)} AS estimate, {cmp_sig(f'sigma * sqrt(v_{x})', digits)} AS std_error, "
        f"{cmp_sig('sigma', digits)} AS sigma, {cmp_sig('1 - rss / tss', digits)} AS r2, {'al' if x == 'discount' else 'FALSE'} AS aliased, n, rank, "
        f"customers - 1 AS n_effects, {cmp_sig('sum_effects', digits)} AS sum_effects FROM done"
        for x in xs
    )
    return f"""WITH {FULL_INVOICE},
m AS (SELECT customer_type, customer_id, quantity, discount, unit_price, total_price AS y FROM finv WHERE {notnull}),
w AS (SELECT *, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY customer_type, customer_id) AS w_{c}' for c in allv)} FROM m),
s AS (SELECT customer_type, {pooled}, count(*) AS n, count(DISTINCT customer_id) AS customers, var_pop(y) * count(*) AS tss,
             var_pop(discount) <= 1e-14 * avg(discount * discount) AS al FROM w GROUP BY customer_type),
sl AS (SELECT *, {', '.join(f'{e} AS b_{x}' for x, e in b.items())}, {', '.join(f'{e} AS v_{x}' for x, e in v.items())} FROM s),
rs AS (SELECT *, s_y__y - ({fitted}) AS rss, CAST(customers + CASE WHEN al THEN 2 ELSE 3 END AS INTEGER) AS rank FROM sl),
means AS (SELECT customer_type, customer_id, {', '.join(f'avg({c}) AS m_{c}' for c in allv)} FROM m GROUP BY customer_type, customer_id),
eff AS (SELECT customer_type, customer_id, m_y - ({' + '.join(f'coalesce(b_{x}, 0) * m_{x}' for x in xs)}) AS e FROM means JOIN sl USING (customer_type)),
base AS (SELECT customer_type, arg_min(e, customer_id) AS e0, fsum(e) AS total, count(*) AS k FROM eff GROUP BY customer_type),
done AS (SELECT rs.*, sqrt(rss / (n - rank)) AS sigma, total - k * e0 AS sum_effects FROM rs JOIN base USING (customer_type))
{rows}"""
