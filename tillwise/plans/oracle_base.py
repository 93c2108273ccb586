"""DuckDB text shared by the oracle queries: the derived tables as CTEs.

Written as flat joins on purpose, so that the pre-aggregated Spark plans are
checked against an independent formulation.
"""

AS_OF = "(SELECT max(o_orderdate) FROM orders)"

RETAIL_TX = """
retail_tx AS (
  SELECT c_custkey AS customer_id, l_orderkey AS order_id, l_partkey AS product_id,
         p_type AS product_category, p_brand AS product_brand, p_size AS product_size,
         o_orderpriority AS payment_method, sn.n_name AS store_city,
         cn.n_name AS customer_city, r_name AS customer_state,
         l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
         l_discount AS discount_applied, l_extendedprice * (1 - l_discount) AS total_sales,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
         o_orderdate AS transaction_date
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN region ON cn.n_regionkey = r_regionkey
)"""

C360 = f"""
bought AS (
  SELECT o_custkey AS k, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines,
         coalesce(sum(l_quantity), 0) AS qty, coalesce(sum(l_extendedprice), 0) AS gross,
         coalesce(sum(l_extendedprice * (1 - l_discount)), 0) AS net, avg(l_discount) AS disc,
         avg(CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_returnflag = 'R' THEN 1.0::double ELSE 0.0::double END) AS ret,
         min(o_orderdate) AS first_d, max(o_orderdate) AS last_d
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
), web AS (
  SELECT user_id AS k,
         count(*) FILTER (event_type IN ('view', 'click')) AS visits,
         count(*) FILTER (event_type = 'click') AS clicks,
         count(*) FILTER (event_type = 'purchase') AS online,
         count(*) FILTER (event_type = 'error') AS calls,
         count(*) FILTER (event_type = 'signup') AS signups
  FROM events GROUP BY 1
), c0 AS (
  SELECT c_custkey AS customer_id, n_name AS customer_city, r_name AS customer_state,
         c_mktsegment AS segment, c_acctbal AS acct_balance,
         CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS loyalty_program,
         coalesce(n_orders, 0) AS total_transactions, coalesce(n_orders, 0) AS in_store_purchases,
         coalesce(n_lines, 0) AS num_purchases, coalesce(qty, 0) AS quantity,
         coalesce(gross, 0) AS gross_sales, coalesce(net, 0) AS total_sales,
         gross / nullif(qty, 0) AS unit_price, net / nullif(n_lines, 0) AS avg_purchase_value,
         disc AS discount_applied, ret AS product_return_rate, last_d AS last_purchase_date,
         date_diff('day', last_d, {AS_OF})::integer AS days_since_last_purchase,
         coalesce(floor(date_diff('day', first_d, {AS_OF}) / 365.0::double), 0)::integer AS membership_years,
         CASE WHEN coalesce(n_lines, 0) >= 50 THEN 'Weekly' WHEN coalesce(n_lines, 0) >= 20 THEN 'Monthly'
              ELSE 'Yearly' END AS purchase_frequency,
         coalesce(visits, 0) AS website_visits, coalesce(online, 0) AS online_purchases,
         coalesce(calls, 0) AS customer_support_calls,
         CASE WHEN coalesce(visits, 0) <= 23 THEN 'Low' WHEN visits <= 30 THEN 'Medium' ELSE 'High' END
           AS app_usage_frequency,
         CASE WHEN coalesce(clicks, 0) < 12 THEN 'Low' WHEN clicks < 16 THEN 'Medium' ELSE 'High' END
           AS social_media_engagement,
         CASE WHEN coalesce(signups, 0) >= 13 THEN 1 ELSE 0 END AS email_subscriptions
  FROM customer
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN bought ON bought.k = c_custkey
  LEFT JOIN web ON web.k = c_custkey
), c360 AS (
  SELECT *, CASE WHEN 0.7::double * coalesce(days_since_last_purchase / 365.0::double, 0.5::double)
                      + 0.3::double * (0.8::double * (purchase_frequency = 'Yearly')::integer) > 0.6::double
                 THEN 1 ELSE 0 END AS churned
  FROM c0
)"""

SCORED = C360 + """, scored AS (
  SELECT *, least(0.95::double, 0.2::double
      + CASE WHEN total_sales < (SELECT avg(total_sales) FROM c360) THEN 0.3::double ELSE 0.0::double END
      + CASE WHEN days_since_last_purchase > (SELECT avg(days_since_last_purchase) FROM c360)
             THEN 0.3::double ELSE 0.0::double END) AS p
  FROM c360
)"""

CLV = SCORED + """, clv0 AS (
  SELECT *, last_purchase_date AS transaction_date,
         1 - days_since_last_purchase::double / nullif((SELECT max(days_since_last_purchase) FROM c360), 0)
           AS recency_factor,
         total_transactions / (CASE WHEN membership_years = 0 THEN 1.0::double ELSE membership_years::double END)
           AS estimated_annual_frequency
  FROM scored
), clv1 AS (
  SELECT *, (membership_years + 1) * (1 + recency_factor * 0.3::double) AS adjusted_lifespan FROM clv0
), clv AS (
  SELECT *, avg_purchase_value * estimated_annual_frequency * adjusted_lifespan AS clv_estimate,
         avg_purchase_value * estimated_annual_frequency * adjusted_lifespan * (1 - p) AS expected_clv
  FROM clv1
)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"
