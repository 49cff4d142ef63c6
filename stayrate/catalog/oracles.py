"""DuckDB SQL that computes the same answers independently, from the given tables alone."""

from __future__ import annotations

import re

from stayrate import schema
from stayrate.catalog.queries import ANCHOR, RISK_LIMIT
from stayrate.operators.derive import TIER_CITIES


def quantile(x: str, p: str) -> str:
    """Linear interpolation between the values at two ranks of the sorted column."""
    x = f"CAST({x} AS DOUBLE)"
    place = f"(CAST({p} AS DOUBLE)*(count({x}) - 1))"
    rank = f"CAST(floor({place}) AS BIGINT)"
    ordered = f"list_sort(list({x}) FILTER ({x} IS NOT NULL))"
    low, high = f"{ordered}[{rank} + 1]", f"{ordered}[least({rank} + 2, count({x}))]"
    return f"({low} + ({high} - {low})*({place} - {rank}))"


def r6(x: str, name: str | None = None) -> str:
    text = f"floor(CAST({x} AS DOUBLE)*1e6+5e-1)/1e6"
    return f"{text} AS {name}" if name else text


def even(x: str, places: int = 2) -> str:
    f = f"1e{places}"
    return f"(round_even(({x})*{f}, 0)/{f})"


def title(x: str) -> str:
    stripped = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    runs = f"regexp_extract_all(lower({stripped}), '[a-z]+|[^a-z]+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || w[2:]), '')"


def frequency(orders: str, months: str) -> str:
    return even(f"{orders} / greatest(coalesce({months}, 1e0)/12, 1e-1)")


def order_value(spend: str, orders: str) -> str:
    return even(f"{spend} / greatest({orders}, 1)")


def value(spend: str, factor: str) -> str:
    return even(f"CASE WHEN churn = 1 THEN {spend} ELSE {spend}*{factor} END")


def tier(score: str) -> str:
    return (
        f"CASE WHEN {score} > 85 THEN 'Premium' WHEN {score} > 60 THEN 'Gold' "
        f"WHEN {score} > 30 THEN 'Silver' ELSE 'Basic' END"
    )


def recode(x: str, names: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {arms} ELSE {default} END"


def clipped(x: str, low: str, high: str) -> str:
    return f"CASE WHEN {x} < {low} THEN {low} WHEN {x} > {high} THEN {high} ELSE {x} END"


def band(x: str, edges: str) -> str:
    """1 plus the number of inner edges below ``x``; missing without bands."""
    return (
        f"CASE WHEN {x} IS NULL OR len({edges}) < 2 THEN NULL "
        f"ELSE CAST(1 + len(list_filter({edges}[2:len({edges})-1], lambda e: {x} > e)) AS BIGINT) END"
    )


def edge_list(x: str) -> str:
    items = ", ".join(quantile(x, p) for p in ("0", "0.2", "0.4", "0.6", "0.8", "1"))
    return f"list_sort(list_distinct([{items}]))"


CAPPED = schema.CAPPED_COLUMNS
MONEY = "DECIMAL(18,2)"
BACK = "(l_returnflag = 'R' AND l_quantity >= 45)"
TEXT = "', '".join
RISK = "(complaints*4e-1 + cart_abandonment*3e-1 + support_calls*2e-1 + (5-customer_satisfaction)*1e-1)"


def _stages() -> dict[str, str]:
    st: dict[str, str] = {}
    st["line_facts"] = f"""
        SELECT l_orderkey, count(*) FILTER (l_discount >= 5e-2) AS discounts,
            count(*) FILTER (l_discount >= 9e-2) AS coupons, max(CASE WHEN {BACK} THEN 1 ELSE 0 END) AS returned,
            sum(CASE WHEN {BACK} THEN CAST(l_extendedprice AS {MONEY})*(1-CAST(l_discount AS DECIMAL(4,2))) END) AS refund
        FROM lineitem GROUP BY 1"""
    st["latest_orders"] = """
        SELECT o_custkey AS lk, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
    st["order_facts"] = f"""
        SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_order, CAST(max(o_orderdate) AS DATE) AS last_order,
            count(*) AS orders, CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS spend,
            sum(discounts) AS discounts, sum(coupons) AS coupons, sum(returned) AS returned,
            CAST(sum(refund) AS DOUBLE) AS refund
        FROM orders LEFT JOIN line_facts ON o_orderkey = l_orderkey GROUP BY 1"""
    st["event_facts"] = f"""
        SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
            count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors,
            CAST(sum(CAST(value AS {MONEY})) AS DOUBLE) AS value_sum,
            CAST(sum(CAST(value AS {MONEY})) AS DOUBLE)/count(value) AS value_mean
        FROM events GROUP BY 1"""
    zero = ("orders", "discounts", "coupons", "returned", "views", "clicks", "purchases", "errors", "spend", "refund", "value_sum")
    st["facts"] = f"""
        SELECT c_custkey AS k, c_acctbal, c_mktsegment, n_name, r_name, first_order, last_order, priority, value_mean,
            (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS last_day,
            CAST(date_diff('day', first_order, last_order) AS DOUBLE)/30 AS months,
            {", ".join(f"coalesce({c}, 0) AS {c}" for c in zero)}
        FROM customer
        LEFT JOIN order_facts ON c_custkey = o_custkey
        LEFT JOIN latest_orders ON c_custkey = lk
        LEFT JOIN event_facts ON c_custkey % (SELECT max(user_id)+1 FROM events) = user_id
        LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
    st["loyal"] = """
        SELECT *, CASE WHEN last_order IS NULL THEN NULL
                WHEN date_diff('day', last_order, last_day) > 365 THEN 1 ELSE 0 END AS churn,
            orders*5 + coalesce(months, 0e0)*2 + spend/1000 AS loyalty_raw FROM facts"""
    st["loyal2"] = """
        SELECT *, CAST(floor((loyalty_raw - lo)/(hi - lo + 1e-5)*99 + 1) AS BIGINT) AS loyalty
        FROM loyal, (SELECT min(loyalty_raw) AS lo, max(loyalty_raw) AS hi FROM loyal)"""
    st["raw"] = f"""
        SELECT 'C' || lpad(CAST(k AS VARCHAR), CAST(greatest(8, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS customer_id,
            CASE WHEN k % 11 <> 3 THEN CAST(18 + (k*7919) % 53 AS DOUBLE) END AS age,
            CASE WHEN k % 13 <> 5 THEN CASE k % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END END AS gender,
            CASE WHEN k % 19 <> 7 THEN CASE WHEN k % 4 = 0 THEN '  ' || lower(n_name) ELSE n_name END END AS city,
            r_name AS state, '{schema.COUNTRY}' AS country, {tier("loyalty")} AS membership_type,
            CASE WHEN k % 97 <> 13 THEN strftime(CAST(first_order - CAST(k % 365 AS INTEGER) AS DATE), '%Y-%m-%d') END AS registration_date,
            strftime(last_order, '%Y-%m-%d') AS last_purchase_date,
            {frequency("orders", "months")} AS purchase_frequency, CAST(orders AS BIGINT) AS total_orders,
            {order_value("spend", "orders")} AS average_order_value, CAST(spend + copy AS DOUBLE) AS total_spend,
            CAST(discounts AS BIGINT) AS discount_usage, CAST(coupons AS BIGINT) AS coupon_usage,
            CASE WHEN k % 17 <> 4 THEN value_mean END AS session_duration,
            CAST(floor(value_sum) AS BIGINT) AS browsing_time, CAST(views + k % 7 AS BIGINT) AS pages_viewed,
            CAST(clicks + k % 5 AS BIGINT) AS wishlist_items,
            CASE WHEN k % 31 <> 6 THEN CAST(greatest(clicks - purchases, 0) AS BIGINT) END AS cart_abandonment,
            CASE WHEN k % 23 <> 1 THEN CASE priority WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Debit Card'
                WHEN 3 THEN ' upi ' WHEN 4 THEN 'COD' WHEN 5 THEN 'Wallet' END END AS payment_method,
            CAST(returned AS BIGINT) AS returned_orders, {even("refund")} AS refund_amount,
            {even("(c_acctbal + 1000)*4/11000 + 1", 1)} AS customer_rating, CAST(1 + k % 5 AS BIGINT) AS delivery_rating,
            CASE WHEN k % 37 <> 8 THEN CAST(errors AS DOUBLE) END AS support_calls,
            CAST(errors > 16 AS BIGINT) AS complaints,
            CASE WHEN k % 29 <> 2 THEN CAST(1 + (k*31) % 5 AS BIGINT) END AS customer_satisfaction,
            {value("spend", "13e-1")} AS customer_lifetime_value,
            CASE WHEN k % 41 <> 9 THEN c_mktsegment END AS customer_segment, loyalty AS loyalty_score,
            CAST(churn AS BIGINT) AS churn, CAST(k*2 + copy AS BIGINT) AS ingest_seq
        FROM (SELECT *, unnest(CASE WHEN k % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM loyal2)"""
    st["dedup"] = """
        SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ingest_seq) = 1"""
    medians = ", ".join(f"{quantile(c, '0.5')} AS {c}" for c in schema.MEDIAN_FILL_COLUMNS)
    modes = ", ".join(
        f"(SELECT {c} FROM dedup WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}"
        for c in schema.MODE_FILL_COLUMNS
    )
    st["medians"] = f"SELECT {medians} FROM dedup"
    st["modes"] = f"SELECT {modes}"

    def filled(c: str) -> str:
        if c in schema.ZERO_FILL_COLUMNS:
            return f"coalesce(d.{c}, 0) AS {c}"
        if c in schema.MEDIAN_FILL_COLUMNS:
            return f"coalesce(CAST(d.{c} AS DOUBLE), (SELECT {c} FROM medians)) AS {c}"
        if c in schema.MODE_FILL_COLUMNS:
            return f"coalesce(d.{c}, (SELECT {c} FROM modes)) AS {c}"
        return f"d.{c}"

    st["filled"] = f"""
        SELECT {", ".join(filled(c) for c in schema.ALL_COLUMNS)}, ingest_seq FROM dedup d
        WHERE d.customer_id IS NOT NULL AND d.registration_date IS NOT NULL AND d.churn IS NOT NULL"""

    def typed(c: str) -> str:
        if c in schema.INT_COLUMNS:
            return f"CAST(trunc(coalesce(CAST({c} AS DOUBLE), 0)) AS BIGINT) AS {c}"
        if c in schema.FLOAT_COLUMNS:
            return f"coalesce(CAST({c} AS DOUBLE), 0e0) AS {c}"
        if c in schema.DATE_COLUMNS:
            return f"try_strptime({c}, '%Y-%m-%d') AS {c}"
        if c == "payment_method":
            return recode(title(c), schema.PAYMENT_REPAIRS, title(c)) + f" AS {c}"
        if c in schema.CATEGORY_COLUMNS:
            return f"coalesce({title(c)}, 'Nan') AS {c}"
        return c

    st["typed"] = f"SELECT {', '.join(typed(c) for c in schema.ALL_COLUMNS)}, ingest_seq FROM filled"
    quartiles = ", ".join(
        f"{quantile(c, p)} AS {c}_{n}"
        for c in CAPPED for n, p in (("q1", "0.25"), ("q3", "0.75"))
    )
    st["quartiles"] = f"SELECT {quartiles} FROM typed"
    st["bounds"] = "SELECT " + ", ".join(
        f"{c}_q1 - 15e-1*({c}_q3 - {c}_q1) AS {c}_lo, {c}_q3 + 15e-1*({c}_q3 - {c}_q1) AS {c}_hi" for c in CAPPED
    ) + " FROM quartiles"

    def capped(c: str) -> str:
        return clipped(f"CAST(t.{c} AS DOUBLE)", f"b.{c}_lo", f"b.{c}_hi") + f" AS {c}" if c in CAPPED else f"t.{c}"

    st["prepared"] = f"SELECT {', '.join(capped(c) for c in schema.ALL_COLUMNS)} FROM typed t, bounds b"
    st["parted"] = """
        SELECT *, row_number() OVER (PARTITION BY churn ORDER BY substr(md5(customer_id || '|42'), 1, 15), customer_id) AS rn,
            count(*) OVER (PARTITION BY churn) AS cn FROM prepared"""
    st["split"] = "SELECT *, rn <= floor(2e-1*cn + 5e-1) AS is_test FROM parted"
    st["train"] = "SELECT * FROM split WHERE NOT is_test"
    st["test"] = "SELECT * FROM split WHERE is_test"
    st["ref"] = "SELECT max(last_purchase_date) AS ref FROM train"
    st["edges"] = f"""
        SELECT {edge_list("date_diff('day', last_purchase_date, ref)")} AS r, {edge_list("total_orders")} AS f,
            {edge_list("total_spend")} AS m FROM train, ref"""
    st["rfm_scores"] = f"""
        SELECT *, len(r) - {band("recency", "r")} AS rs, {band("total_orders", "f")} AS fs, {band("total_spend", "m")} AS ms
        FROM (SELECT *, date_diff('day', last_purchase_date, ref) AS recency FROM split, ref), edges"""
    st["segmented"] = """
        SELECT *, CASE WHEN rs IS NULL OR fs IS NULL OR ms IS NULL THEN 'Unknown'
            WHEN rs >= 4 AND fs >= 4 AND ms >= 4 THEN 'Champions' WHEN rs >= 3 AND fs >= 3 THEN 'Loyal Customers'
            WHEN rs >= 4 AND fs <= 2 THEN 'Recent Users' WHEN rs <= 2 AND fs >= 4 THEN 'At Risk'
            WHEN rs <= 2 AND fs <= 2 THEN 'Lost' ELSE 'Average' END AS rfm_segment FROM rfm_scores"""
    eng = list(schema.ENGAGEMENT_WEIGHTS)
    st["eng_range"] = "SELECT " + ", ".join(
        f"min(CAST({c} AS DOUBLE)) AS {c}_lo, max(CAST({c} AS DOUBLE)) AS {c}_hi" for c in eng
    ) + " FROM train"

    def scaled(c: str) -> str:
        return (f"(CAST({c} AS DOUBLE) - {c}_lo)/(CASE WHEN {c}_hi = {c}_lo THEN 1e0 ELSE {c}_hi - {c}_lo END)")

    weights = {"session_duration": "3e-1", "pages_viewed": "4e-1", "wishlist_items": "2e-1", "discount_usage": "1e-1"}
    total = " + ".join(f"({scaled(c)})*{weights[c]}" for c in eng)
    st["eng_total"] = f"SELECT min({total}) AS t_lo, max({total}) AS t_hi FROM train, eng_range"
    share = f"(({total}) - t_lo)/(CASE WHEN t_hi = t_lo THEN 1e0 ELSE t_hi - t_lo END)"
    score = f"({share})*1e2 + 0e0"
    st["featured"] = f"""
        SELECT *, {even(clipped(score, "0e0", "1e2"))} AS engagement_score
        FROM segmented, eng_range, eng_total"""
    st["scored"] = f"""
        SELECT {', '.join(schema.ALL_COLUMNS)}, rfm_segment, engagement_score,
            CAST({RISK} >= {RISK_LIMIT} AS BIGINT) AS predicted_churn, {RISK} AS risk_score FROM featured"""
    st["scaled_parts"] = "SELECT " + ", ".join(f"{scaled(c)} AS s_{c}" for c in eng) + ", customer_id FROM prepared, eng_range"
    st["base"] = f"""
        SELECT CAST(k AS VARCHAR) AS CustomerID,
            coalesce(CAST(date_diff('day', last_order, last_day) > 365 AS INTEGER), 0) AS Churn,
            CASE WHEN k % 13 <> 5 THEN CASE k % 2 WHEN 0 THEN 'Male' ELSE 'Female' END END AS Gender,
            CASE WHEN k % 29 <> 2 THEN CAST(1 + (k*31) % 5 AS INTEGER) END AS SatisfactionScore,
            CASE WHEN k % 43 <> 3 THEN CAST(errors > 16 AS INTEGER) END AS Complain,
            CASE WHEN k % 59 <> 7 THEN CAST(orders AS INTEGER) END AS OrderCount,
            CASE WHEN k % 61 <> 11 THEN CAST(coupons AS INTEGER) END AS CouponUsed,
            CASE WHEN k % 23 <> 1 THEN CASE priority WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Debit Card' WHEN 3 THEN 'UPI'
                WHEN 4 THEN 'COD' WHEN 5 THEN 'E wallet' ELSE 'CC' END END AS PreferredPaymentMode,
            CASE WHEN k % 17 <> 4 THEN floor(value_sum)/60 END AS HourSpendOnApp,
            CASE WHEN k % 19 <> 6 THEN CAST(floor(months) AS INTEGER) END AS Tenure,
            CASE WHEN k % 31 <> 5 THEN CAST(date_diff('day', last_order, last_day) AS INTEGER) END AS DaySinceLastOrder,
            CASE WHEN k % 37 <> 9 THEN CAST(1 + k % 3 AS INTEGER) END AS CityTier,
            CASE WHEN k % 47 <> 8 THEN {even("spend/1000")} END AS CashbackAmount FROM facts"""
    st["curve"] = """
        SELECT risk_score AS threshold, count(*) FILTER (churn = 1) AS pos, count(*) FILTER (churn = 0) AS neg FROM scored GROUP BY 1"""
    st["running"] = """
        SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
            sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM curve"""
    return st


STAGES = _stages()


def with_stages(body: str) -> str:
    """Prefix the query with the stages it names, directly or through other stages."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in STAGES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(STAGES[name])

    visit(body)
    parts = [f"{n} AS ({t})" for n, t in STAGES.items() if n in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def cols(names, prefix: str = "") -> str:
    return ", ".join(f"{prefix}{n}" for n in names)


def _rounded(names, among) -> str:
    return ", ".join(r6(c, c) if c in among else c for c in names)


def _city_of_tier() -> str:
    arms = " ".join(
        f"WHEN coalesce(CityTier, 3) = {t} THEN (['{TEXT(c)}'])[CAST(CAST(CustomerID AS BIGINT) % {len(c)} + 1 AS INTEGER)]"
        for t, c in TIER_CITIES.items()
    )
    return f"CASE {arms} END"


CITY = _city_of_tier()


def _augment_sql() -> str:
    session = even("browsing_time / greatest(CAST(total_orders*35e-1 AS DOUBLE), 1e0)", 1)
    return f"""
        SELECT {cols(schema.ALL_COLUMNS)} FROM (
        SELECT *, {tier("loyalty_score")} AS membership_type FROM (
        SELECT *, CAST(floor((lraw - min(lraw) OVER ())/(max(lraw) OVER () - min(lraw) OVER () + 1e-5)*99 + 1) AS BIGINT) AS loyalty_score FROM (
        SELECT *, {recode("city", schema.CITY_STATE)} AS state, CAST(floor(session_duration*225e-2) AS BIGINT) AS pages_viewed,
            {even("returned_orders*average_order_value*9e-1")} AS refund_amount,
            {value("total_spend", "13e-1")} AS customer_lifetime_value,
            total_orders*5 + tenure*2 + total_spend/1000 AS lraw FROM (
        SELECT *, {session} AS session_duration FROM (
        SELECT CustomerID AS customer_id, CAST(35 AS BIGINT) AS age, coalesce(Gender, 'Other') AS gender, {CITY} AS city,
            'India' AS country,
            strftime(DATE '{ANCHOR}' - coalesce(Tenure, 0)*30, '%Y-%m-%d') AS registration_date,
            strftime(DATE '{ANCHOR}' - coalesce(DaySinceLastOrder, 0), '%Y-%m-%d') AS last_purchase_date,
            {frequency("coalesce(OrderCount, 1)", "CAST(Tenure AS DOUBLE)")} AS purchase_frequency,
            CAST(coalesce(OrderCount, 1) AS BIGINT) AS total_orders,
            {order_value("(coalesce(CashbackAmount, 1e2)/35e-3)", "coalesce(OrderCount, 1)")} AS average_order_value,
            {even("coalesce(CashbackAmount, 1e2)/35e-3")} AS total_spend,
            CAST(floor(coalesce(CouponUsed, 0)*16e-1) AS BIGINT) AS discount_usage,
            CAST(coalesce(CouponUsed, 0) AS BIGINT) AS coupon_usage,
            CAST(trunc(coalesce(HourSpendOnApp, 2e0)*60) AS BIGINT) AS browsing_time,
            CAST(3 AS BIGINT) AS wishlist_items, CAST(2 AS BIGINT) AS cart_abandonment,
            {recode("PreferredPaymentMode", schema.PAYMENT_MODE_MAP, "'Credit Card'")} AS payment_method,
            CAST(least(coalesce(Complain, 0)*3, coalesce(OrderCount, 1)) AS BIGINT) AS returned_orders,
            {even("CAST(coalesce(SatisfactionScore, 3) AS DOUBLE)", 1)} AS customer_rating,
            CAST(coalesce(SatisfactionScore, 3) AS BIGINT) AS delivery_rating,
            CAST(floor(coalesce(Complain, 0)*225e-2) AS BIGINT) AS support_calls,
            CAST(coalesce(Complain, 0) AS BIGINT) AS complaints,
            CAST(coalesce(SatisfactionScore, 3) AS BIGINT) AS customer_satisfaction,
            'Regular' AS customer_segment, CAST(Churn AS BIGINT) AS churn, coalesce(Tenure, 0) AS tenure
        FROM base)))))"""


def _report_sql() -> str:
    per = """
        SELECT CAST(class AS VARCHAR) AS class, coalesce(h/nullif(named, 0), 0) AS precision, coalesce(h/nullif(support, 0), 0) AS recall,
            coalesce(2*h/nullif(named + support, 0), 0) AS f1, support, h
        FROM (SELECT class, CAST(sum(named) AS DOUBLE) AS named, CAST(sum(support) AS DOUBLE) AS support, CAST(sum(h) AS DOUBLE) AS h FROM (
            SELECT churn AS class, 0 AS named, 1 AS support, CAST(churn = predicted_churn AS INTEGER) AS h FROM scored
            UNION ALL SELECT predicted_churn, 1, 0, 0 FROM scored) GROUP BY 1)"""
    figures = ("precision", "recall", "f1")
    return f"""
        SELECT class, {', '.join(r6(c, c) for c in figures)}, CAST(support AS BIGINT) AS support FROM (
        SELECT class, precision, recall, f1, support FROM ({per})
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM ({per})
        UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM ({per})
        UNION ALL SELECT 'accuracy', sum(h)/sum(support), sum(h)/sum(support), sum(h)/sum(support), sum(support) FROM ({per}))"""


SCALED = tuple(c for c in schema.ALL_COLUMNS if c in (*schema.INT_COLUMNS, *schema.FLOAT_COLUMNS) and c != "churn")


def _scaler_sql(method: str, names=SCALED, source: str = "test", kept: str = "customer_id") -> str:
    def pair(c: str) -> tuple[str, str]:
        x = f"CAST({c} AS DOUBLE)"
        if method == "standard":
            return f"avg({x})", f"stddev_pop({x})"
        if method == "minmax":
            return f"min({x})", f"max({x}) - min({x})"
        q = [quantile(x, p) for p in ("0.25", "0.5", "0.75")]
        return q[1], f"{q[2]} - {q[0]}"

    fit = ", ".join(f"{a} AS {c}_a, {b} AS {c}_b" for c in names for a, b in [pair(c)])
    out = ", ".join(
        r6(f"(CAST({c} AS DOUBLE) - {c}_a)/(CASE WHEN {c}_b = 0 THEN 1e0 ELSE {c}_b END)", c) for c in names
    )
    return f"SELECT {kept}, {out} FROM {source}, (SELECT {fit} FROM train)"


def _onehot_sql() -> str:
    """One column per category but the first, for the categories the derived customers have."""
    known = {
        "gender": ["Female", "Male", "Other"],
        "city": sorted(f"Nation_{i}" for i in range(25)),
        "state": ["Africa", "America", "Asia", "Europe", "Middle East"],
        "country": ["India"],
        "membership_type": ["Basic", "Gold", "Premium", "Silver"],
        "payment_method": sorted(["Credit Card", "Debit Card", "UPI", "Cash on Delivery", "Wallet"]),
        "customer_segment": ["Automobile", "Building", "Furniture", "Household", "Machinery", "Nan"],
    }
    flags = ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END AS \"{c}_{v}\"" for c in schema.CATEGORY_COLUMNS for v in known[c][1:]
    )
    return f"SELECT customer_id, {flags} FROM test"


def _orders_by(period: str, label: str) -> str:
    return (
        f"SELECT '{period}' AS period, {label} AS start, CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS revenue, "
        "count(*) AS orders FROM orders GROUP BY 2"
    )


def _bounds_rows(pairs: dict[str, tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r6(lo, 'low')}, {r6(hi, 'high')} FROM {source}" for c, (lo, hi) in pairs.items()
    )


def _money(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(24,6))) AS DOUBLE)"


def _bodies() -> dict[str, str]:
    all_columns = cols(schema.ALL_COLUMNS)
    prepared_rounded = _rounded(schema.ALL_COLUMNS, CAPPED)
    q: dict[str, str] = {}
    q["scan_table"] = f"SELECT {all_columns}, ingest_seq FROM raw"
    q["drop_missing_critical"] = f"""SELECT {all_columns}, ingest_seq FROM dedup
        WHERE customer_id IS NOT NULL AND registration_date IS NOT NULL AND churn IS NOT NULL"""
    q["filter_membership_lists"] = """SELECT customer_id, gender, membership_type, rfm_segment, churn FROM scored
        WHERE gender IN ('Female', 'Other') AND membership_type IN ('Silver', 'Gold') AND rfm_segment IN ('Champions', 'At Risk', 'Lost')"""
    q["filter_predicted_churn"] = "SELECT customer_id, predicted_churn, churn FROM scored WHERE predicted_churn = 1"
    q["distinct_options"] = " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS \"column\", {c} AS option FROM scored WHERE {c} IS NOT NULL"
        for c in ("gender", "membership_type", "rfm_segment")
    )
    q["domain_violations"] = " UNION ALL ".join(
        [f"SELECT '{c}' AS rule, count(*) FILTER (coalesce({c} NOT IN ('{TEXT(v)}'), true)) AS violations FROM typed"
         for c, v in schema.DOMAINS.items()]
        + [f"SELECT 'city_state', count(*) FILTER ({recode('city', schema.CITY_STATE)} <> state) FROM typed"]
    )
    q["label_rate_check"] = f"SELECT {r6('avg(churn)', 'churn_rate')}, avg(churn) BETWEEN 15e-2 AND 25e-2 AS in_range FROM typed"
    q["cast_int"] = "SELECT customer_id, " + ", ".join(
        f"CAST(trunc(coalesce(CAST({c} AS DOUBLE), 0)) AS BIGINT) AS {c}" for c in schema.INT_COLUMNS) + " FROM dedup"
    q["cast_float"] = "SELECT customer_id, " + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), 0e0) AS {c}" for c in schema.FLOAT_COLUMNS) + " FROM dedup"
    q["parse_dates"] = "SELECT customer_id, " + ", ".join(
        f"try_strptime({c}, '%Y-%m-%d') AS {c}" for c in schema.DATE_COLUMNS) + " FROM dedup"
    q["normalise_strings"] = "SELECT customer_id, " + ", ".join(
        f"coalesce({title(c)}, 'Nan') AS {c}" for c in schema.CATEGORY_COLUMNS) + " FROM dedup"
    q["null_category_label"] = "SELECT customer_id, " + ", ".join(
        f"coalesce({c}, 'Nan') AS {c}" for c in ("country", "membership_type", "customer_segment")) + " FROM dedup"
    pm = f"coalesce({title('payment_method')}, 'Nan')"
    q["fix_acronyms"] = f"SELECT customer_id, {recode(pm, schema.PAYMENT_REPAIRS, pm)} AS payment_method FROM dedup"
    q["map_values"] = f"""SELECT CustomerID, coalesce(Gender, 'Other') AS gender,
        {recode("PreferredPaymentMode", schema.PAYMENT_MODE_MAP, "'Credit Card'")} AS payment_method FROM base"""
    q["recode_labels"] = """SELECT customer_id, CASE churn WHEN 0 THEN 'Retained' WHEN 1 THEN 'Churned' END AS churn_status,
        CASE predicted_churn WHEN 0 THEN 'Predicted Retained' WHEN 1 THEN 'Predicted Churned' END AS prediction FROM scored"""
    defaults = {"SatisfactionScore": "3", "Complain": "0", "OrderCount": "1", "CouponUsed": "0", "HourSpendOnApp": "2e0",
                "Tenure": "0", "DaySinceLastOrder": "0", "CityTier": "3", "CashbackAmount": "1e2"}
    q["fill_defaults"] = "SELECT " + ", ".join(
        f"coalesce({c}, {defaults[c]}) AS {c}" if c in defaults else c for c in schema.BASE_SCHEMA.names) + " FROM base"
    q["hours_to_minutes"] = "SELECT CustomerID, CAST(trunc(coalesce(HourSpendOnApp, 2e0)*60) AS BIGINT) AS browsing_time FROM base"
    q["date_back_from_anchor"] = f"""SELECT CustomerID,
        strftime(DATE '{ANCHOR}' - coalesce(Tenure*30, 0), '%Y-%m-%d') AS registration_date,
        strftime(DATE '{ANCHOR}' - coalesce(DaySinceLastOrder, 0), '%Y-%m-%d') AS last_purchase_date FROM base"""
    q["city_to_state"] = f"""SELECT CustomerID, city, {recode("city", schema.CITY_STATE)} AS state, 'India' AS country
        FROM (SELECT CustomerID, {CITY} AS city FROM base)"""
    q["spend_from_cashback"] = f"SELECT CustomerID, {even('coalesce(CashbackAmount, 1e2)/4e-2')} AS total_spend FROM base"
    q["average_order_value"] = f"SELECT ingest_seq, {order_value('total_spend', 'total_orders')} AS average_order_value FROM raw"
    q["purchase_frequency"] = f"SELECT CustomerID, {frequency('coalesce(OrderCount, 1)', 'CAST(Tenure AS DOUBLE)')} AS purchase_frequency FROM base"
    q["bounded_returns"] = "SELECT ingest_seq, least(returned_orders*7, total_orders) AS returned_orders FROM raw"
    q["lifetime_value"] = f"SELECT ingest_seq, {value('total_spend', '125e-2')} AS customer_lifetime_value FROM raw"
    q["loyalty_score"] = """SELECT CustomerID, CAST(floor((l - min(l) OVER ())/(max(l) OVER () - min(l) OVER () + 1e-5)*99 + 1) AS BIGINT) AS loyalty_score
        FROM (SELECT CustomerID, coalesce(OrderCount, 1)*5 + coalesce(Tenure, 0)*2 + coalesce(CashbackAmount, 1e2)*25/1000 AS l FROM base)"""
    q["membership_tier"] = f"SELECT ingest_seq, loyalty_score, {tier('loyalty_score')} AS membership_type FROM raw"
    q["constant_columns"] = "SELECT CustomerID, 'India' AS country, 'Regular' AS customer_segment FROM base"
    session = even("browsing_time / greatest(CAST(total_orders*35e-1 AS DOUBLE), 1e0)", 1)
    q["behaviour_from_factors"] = f"""SELECT ingest_seq, CAST(floor(coupon_usage*15e-1) AS BIGINT) AS discount_usage,
        {session} AS session_duration, CAST(floor({session}*225e-2) AS BIGINT) AS pages_viewed,
        {even("returned_orders*average_order_value*9e-1")} AS refund_amount,
        CAST(floor(complaints*225e-2) AS BIGINT) AS support_calls FROM raw"""
    rounded_up = clipped("round_even(SatisfactionScore + 75e-2, 0)", "1e0", "5e0")
    q["bounded_ratings"] = f"""SELECT CustomerID, CAST({rounded_up} AS BIGINT) AS delivery_rating,
        {even(clipped("(SatisfactionScore + -25e-2)", "1e0", "5e0"), 1)} AS customer_rating FROM base"""
    q["augment_base"] = _augment_sql()
    q["reorder_columns"] = f"SELECT {all_columns} FROM raw"
    q["drop_columns"] = "SELECT " + cols(
        [c for c in schema.ALL_COLUMNS if c not in ("customer_id", "churn", *schema.DATE_COLUMNS)]
    ) + ", rfm_segment, engagement_score, predicted_churn FROM scored"
    q["rename_columns"] = "SELECT " + ", ".join(f'{a} AS "{b}"' for a, b in schema.RISK_DISPLAY.items()) + " FROM scored"
    q["month_bucket"] = "SELECT customer_id, coalesce(left(registration_date, 7), 'NaT') AS month FROM dedup"
    q["days_between"] = """SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts))/864e8) AS BIGINT) AS days FROM events"""
    q["clip"] = f"SELECT customer_id, {clipped('age', '25e0', '60e0')} AS age FROM dedup"
    q["round_half_even"] = f"SELECT l_orderkey, l_linenumber, {even('l_extendedprice*125e-3')} AS eighth FROM lineitem"
    q["log_sqrt_transform"] = "SELECT customer_id, " + ", ".join(
        f"{r6(f'ln(1 + CAST({c} AS DOUBLE))', f'{c}_log')}, {r6(f'sqrt({c})', f'{c}_sqrt')}" for c in schema.SKEWED_COLUMNS) + " FROM typed"
    q["dedupe_first"] = f"SELECT {all_columns}, ingest_seq FROM dedup"
    q["dedupe_all_columns"] = f"SELECT DISTINCT {all_columns} FROM raw"
    q["duplicate_count"] = "SELECT count(*) - count(DISTINCT customer_id) AS duplicates FROM raw"
    q["impute_zero"] = "SELECT customer_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in schema.ZERO_FILL_COLUMNS) + " FROM dedup"
    q["impute_median"] = "SELECT customer_id, " + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM medians)) AS {c}" for c in schema.MEDIAN_FILL_COLUMNS) + " FROM dedup"
    q["impute_mode"] = "SELECT customer_id, " + ", ".join(
        f"coalesce({c}, (SELECT {c} FROM modes)) AS {c}" for c in schema.MODE_FILL_COLUMNS) + " FROM dedup"
    q["clean_customers"] = f"SELECT {all_columns}, ingest_seq FROM typed"
    q["iqr_bounds"] = _bounds_rows({c: (f"{c}_lo", f"{c}_hi") for c in CAPPED}, "bounds")
    q["zscore_bounds"] = _bounds_rows(
        {c: (f"avg({c}) - 3*stddev_samp({c})", f"avg({c}) + 3*stddev_samp({c})") for c in CAPPED}, "typed")
    q["outlier_flag_count"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < {c}_lo OR {c} > {c}_hi) AS outliers FROM typed, bounds" for c in CAPPED)
    q["outlier_keep"] = f"SELECT customer_id, {cols(CAPPED)} FROM typed"
    step, source = "", "typed"
    for i, c in enumerate(CAPPED):
        a, b = (quantile(c, p) for p in ("0.25", "0.75"))
        step += f"left{i} AS (SELECT s.* FROM {source} s, (SELECT {a} AS a, {b} AS b FROM {source}) WHERE {c} >= a - 15e-1*(b-a) AND {c} <= b + 15e-1*(b-a)), "
        source = f"left{i}"
    q["outlier_remove"] = f"SELECT customer_id, {cols(CAPPED)} FROM (WITH {step[:-2]} SELECT * FROM {source})"
    q["outlier_cap"] = "SELECT customer_id, " + ", ".join(
        r6(clipped(c, f"{c}_a - 2*{c}_s", f"{c}_a + 2*{c}_s"), c) for c in CAPPED
    ) + " FROM typed, (SELECT " + ", ".join(f"avg({c}) AS {c}_a, stddev_samp({c}) AS {c}_s" for c in CAPPED) + " FROM typed)"
    q["cap_continuous_features"] = "SELECT customer_id, " + ", ".join(r6(c, c) for c in CAPPED) + " FROM prepared"
    q["preprocess_customers"] = f"SELECT {prepared_rounded} FROM prepared"
    percentiles = ", ".join(
        f"{quantile(c, p)} AS {c}_{n}" for c in CAPPED for n, p in (("a", "0.01"), ("b", "0.99")))
    q["winsorize_percentile"] = "SELECT customer_id, " + ", ".join(
        r6(clipped(f"CAST({c} AS DOUBLE)", f"{c}_a", f"{c}_b"), c) for c in CAPPED) + f" FROM typed, (SELECT {percentiles} FROM typed)"
    q["stratified_split"] = "SELECT customer_id, churn, is_test FROM split"
    folds = " + ".join(f"CAST(rn > floor({i}*2e-1*cn + 5e-1) AS BIGINT)" for i in range(1, 5))
    q["stratified_folds"] = f"SELECT customer_id, churn, {folds} AS fold FROM parted"
    q["rfm_fit"] = " UNION ALL ".join(
        f"SELECT '{n}' AS measure, i - 1 AS place, {r6(f'{k}[i]', 'edge')}, ref AS reference FROM (SELECT {k}, ref, unnest(range(1, len({k}) + 1)) AS i FROM edges, ref)"
        for n, k in (("recency", "r"), ("orders", "f"), ("spend", "m")))
    q["rfm_recency"] = "SELECT customer_id, date_diff('day', last_purchase_date, ref) AS recency_days FROM prepared, ref"
    q["rfm_score"] = "SELECT customer_id, rs AS recency_score, fs AS frequency_score, ms AS monetary_score FROM rfm_scores"
    q["concat_scores"] = "SELECT customer_id, CAST(rs AS VARCHAR) || CAST(fs AS VARCHAR) || CAST(ms AS VARCHAR) AS rfm_score_text FROM rfm_scores"
    q["rfm_numeric_score"] = "SELECT customer_id, rs*100 + fs*10 + ms AS rfm_score FROM rfm_scores"
    q["rfm_components"] = f"""SELECT customer_id, recency, total_orders AS frequency, {r6('total_spend', 'monetary')},
        rs AS recency_score, fs AS frequency_score, ms AS monetary_score FROM rfm_scores"""
    q["rfm_segment"] = "SELECT customer_id, rfm_segment FROM segmented"
    q["rfm_transform"] = "SELECT customer_id, recency AS recency_days, rfm_segment FROM segmented WHERE is_test"
    q["engagement_fit"] = " UNION ALL ".join(
        [f"SELECT '{c}' AS measure, {r6(f'{c}_lo', 'low')}, {r6(f'{c}_hi', 'high')} FROM eng_range" for c in schema.ENGAGEMENT_WEIGHTS]
        + [f"SELECT 'weighted_sum', {r6('t_lo', 'low')}, {r6('t_hi', 'high')} FROM eng_total"])
    q["min_max_normalise"] = "SELECT customer_id, " + ", ".join(r6(f"s_{c}", c) for c in schema.ENGAGEMENT_WEIGHTS) + " FROM scaled_parts"
    q["engagement_score"] = "SELECT customer_id, engagement_score FROM featured"
    q["engineer_features"] = "SELECT customer_id, recency AS recency_days, rfm_segment, engagement_score FROM featured WHERE is_test"
    q["age_group"] = """SELECT customer_id, CASE WHEN age <= 0 THEN NULL WHEN age <= 24 THEN '18-24' WHEN age <= 34 THEN '25-34' WHEN age <= 44 THEN '35-44'
        WHEN age <= 54 THEN '45-54' WHEN age <= 64 THEN '55-64' WHEN age <= 100 THEN '65+' END AS customer_age_group FROM prepared"""
    lifetime = "date_diff('day', registration_date, last_purchase_date)"
    q["lifetime_days"] = f"SELECT customer_id, {lifetime} AS customer_lifetime_days FROM prepared"
    q["avg_monthly_spend"] = f"SELECT customer_id, {r6(f'total_spend/greatest({lifetime}/30, 1e0)', 'avg_monthly_spend')} FROM typed"
    q["purchase_interval"] = f"""SELECT o_custkey, {r6('avg(gap)', 'purchase_interval')} FROM (SELECT o_custkey, date_diff('day',
        lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), o_orderdate) AS gap FROM orders) GROUP BY 1"""
    q["engagement_score_v2"] = f"""SELECT customer_id, {r6("browsing_time/bm*5e-1 + pages_viewed/pm*3e-1 + purchase_frequency*2e-1", "engagement_score_v2")}
        FROM typed, (SELECT CAST(max(browsing_time) AS DOUBLE) AS bm, CAST(max(pages_viewed) AS DOUBLE) AS pm FROM typed)"""
    q["risk_score"] = f"SELECT customer_id, {r6(RISK, 'customer_risk_score')} FROM typed"
    for name, (a, b) in {"discount_dependency": ("discount_usage", "total_orders"), "complaint_ratio": ("complaints", "support_calls"),
                         "return_ratio": ("returned_orders", "total_orders")}.items():
        q[name] = f"SELECT customer_id, {r6(f'{a}/nullif({b}, 0)', name)} FROM typed"
    q["browsing_score"] = f"""SELECT customer_id, {r6("((browsing_time - b0)/(b1 - b0) + (pages_viewed - p0)/(p1 - p0))/2", "browsing_score")}
        FROM typed, (SELECT min(browsing_time) AS b0, max(browsing_time) AS b1, min(pages_viewed) AS p0, max(pages_viewed) AS p1 FROM typed)"""
    q["vip_flag"] = f"""SELECT customer_id, CAST(customer_lifetime_value >= (SELECT {quantile("customer_lifetime_value", "0.9")} FROM typed) AS BIGINT) AS vip_flag FROM typed"""
    q["premium_flag"] = "SELECT customer_id, CAST(membership_type = 'Premium' AS BIGINT) AS premium_flag FROM typed"
    q["activity_level"] = f"""SELECT customer_id, (['{TEXT(schema.ACTIVITY_LEVELS)}'])[{band("engagement_score", "e")}] AS activity_level
        FROM scored, (SELECT {edge_list("engagement_score")} AS e FROM scored)"""
    q["onehot_fit"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY {c}) - 1 AS place, {c} AS category FROM (SELECT DISTINCT {c} FROM train)"
        for c in schema.CATEGORY_COLUMNS)
    q["onehot_transform"] = _onehot_sql()
    for method in ("standard", "minmax", "robust"):
        q[f"scale_{method}"] = _scaler_sql(method)
    q["scale_frozen"] = _scaler_sql("standard", SCALED, "prepared", "customer_id, gender")
    places = {c: f"SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS place FROM (SELECT DISTINCT {c} FROM train)" for c in schema.CATEGORY_COLUMNS}
    q["dictionary_fit"] = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", v AS value, place FROM ({p})" for c, p in places.items())
    q["dictionary_places"] = "SELECT customer_id, " + ", ".join(f"p_{c}.place AS {c}_place" for c in places) + " FROM test " + " ".join(
        f"LEFT JOIN ({p}) p_{c} ON p_{c}.v = test.{c}" for c, p in places.items())
    q["sparse_onehot"] = " UNION ALL ".join(
        f"SELECT customer_id, '{c}' AS \"column\", v AS value FROM test JOIN ({p}) ON v = test.{c} WHERE place > 0" for c, p in places.items())
    q["export_columns"] = q["batch_columns"] = f"SELECT {prepared_rounded}, rfm_segment, engagement_score FROM featured"
    q["prediction_checks"] = "SELECT customer_id, churn, TRUE AS known, TRUE AS in_range, TRUE AS agrees FROM prepared"
    inputs = " UNION ALL ".join([f"SELECT '{c}' AS feature" for c in (*SCALED, "engagement_score") if c != "customer_lifetime_value"] + [
        f"SELECT '{c}_' || v FROM ({p}) WHERE place > 0" for c, p in places.items()])
    q["importance_features"] = f"SELECT feature, TRUE AS in_range FROM ({inputs})"
    q["class_weights"] = f"SELECT churn, n AS rows, {r6('sum(n) OVER ()/(count(*) OVER ()*n)', 'weight')} FROM (SELECT churn, count(*) AS n FROM train GROUP BY 1)"
    q["risk_level"] = """SELECT customer_id, CASE WHEN p < 33e-2 THEN 'Low' WHEN p < 66e-2 THEN 'Medium' ELSE 'High' END AS risk_level
        FROM (SELECT customer_id, least(risk_score/8, 1e0) AS p FROM scored)"""
    q["accuracy"] = f"SELECT {r6('avg(CAST(churn = predicted_churn AS INTEGER))', 'accuracy')} FROM scored"
    q["classification_report"] = _report_sql()
    q["confusion_matrix"] = """SELECT churn AS label, count(*) FILTER (predicted_churn = 0) AS predicted_0,
        count(*) FILTER (predicted_churn = 1) AS predicted_1 FROM scored GROUP BY 1"""
    q["roc_auc"] = f"""SELECT {r6("(sum(r) FILTER (churn = 1) - any_value(p)*(any_value(p) + 1)/2)/(any_value(p)*any_value(n))", "roc_auc")} FROM (
        SELECT churn, sum(churn) OVER () AS p, sum(1 - churn) OVER () AS n,
            rank() OVER (ORDER BY risk_score) + (count(*) OVER (PARTITION BY risk_score) - 1)/2 AS r FROM scored)"""
    q["roc_points"] = f"SELECT {r6('threshold', 'threshold')}, {r6('fp/n', 'fpr')}, {r6('tp/p', 'tpr')} FROM running"
    q["pr_points"] = f"SELECT {r6('threshold', 'threshold')}, {r6('tp/(tp + fp)', 'precision')}, {r6('tp/p', 'recall')} FROM running"
    rate, aov = r6("100*sum(churn)/count(*)", "churn_rate"), f"{_money('average_order_value')}/count(average_order_value)"
    pred = "CAST(sum(predicted_churn) AS BIGINT) AS predicted_churn"
    q["dashboard_kpis"] = f"SELECT count(*) AS total_customers, {rate}, {r6(aov, 'avg_order_value')}, {pred} FROM scored"
    q["kpi_total_customers"] = "SELECT count(*) AS total_customers FROM scored"
    q["kpi_churn_rate"] = f"SELECT {rate} FROM scored"
    q["kpi_avg_order_value"] = f"SELECT {r6(aov, 'avg_order_value')} FROM typed"
    q["kpi_predicted_churn"] = f"SELECT {pred} FROM scored"
    status = "CASE churn WHEN 0 THEN 'Retained' ELSE 'Churned' END AS churn_status"
    q["churn_distribution"] = f"SELECT {status}, count(*) AS customers FROM scored GROUP BY churn"
    q["segment_counts"] = "SELECT rfm_segment, count(*) AS customers FROM scored GROUP BY 1"
    q["monthly_revenue"] = f"SELECT coalesce(strftime(last_purchase_date, '%Y-%m'), 'NaT') AS month, {r6(_money('total_spend'), 'revenue')} FROM typed GROUP BY 1"
    q["churn_by_membership"] = f"SELECT membership_type, {status}, count(*) AS customers FROM scored GROUP BY membership_type, churn"
    q["engagement_by_prediction"] = f"""SELECT CASE predicted_churn WHEN 0 THEN 'Predicted Retained' ELSE 'Predicted Churned' END AS prediction,
        {r6("avg(engagement_score)", "avg_engagement")} FROM scored GROUP BY predicted_churn"""
    q["top_high_risk"] = f"SELECT {_rounded(schema.RISK_DISPLAY, ['total_spend'])} FROM (SELECT * FROM scored WHERE predicted_churn = 1 ORDER BY total_spend DESC, customer_id LIMIT 100)"
    q["kpi_active_inactive"] = """SELECT count(*) FILTER (churn = 0) AS active_customers, count(*) FILTER (churn = 1) AS inactive_customers,
        count(*) FILTER (total_orders >= 2) AS repeat_customers FROM scored"""
    q["kpi_retention_rate"] = f"SELECT {r6('1 - avg(churn)', 'retention_rate')} FROM scored"
    q["kpi_revenue_net"] = f"""SELECT {r6('a', 'revenue')}, {r6('b', 'refunds')}, {r6('b/a', 'refund_rate')}, {r6('a - b', 'net_revenue')}
        FROM (SELECT {_money('total_spend')} AS a, {_money('refund_amount')} AS b FROM typed)"""
    q["kpi_clv_session"] = f"""SELECT {r6(f"{_money('customer_lifetime_value')}/count(*)", "avg_lifetime_value")},
        {r6("avg(session_duration)", "avg_session_duration")} FROM typed"""
    q["kpi_growth_rate"] = f"""SELECT month, {r6('revenue', 'revenue')}, {r6("(revenue - b)/b", "growth_rate")} FROM (
        WITH sums AS (SELECT date_trunc('month', o_orderdate) AS m, {_money('o_totalprice')} AS revenue
            FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
        SELECT strftime(a.m, '%Y-%m') AS month, a.revenue, b.revenue AS b
        FROM sums a LEFT JOIN sums b ON b.m + INTERVAL 1 MONTH = a.m)"""
    q["kpi_conversion_rate"] = f"""SELECT a AS purchases, b AS views, {r6('a/b', 'conversion_rate')} FROM (
        SELECT count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'view') AS b FROM events)"""
    periods = " UNION ALL ".join([
        _orders_by("month", "strftime(o_orderdate, '%Y-%m')"),
        _orders_by("quarter", "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)"),
        _orders_by("year", "strftime(o_orderdate, '%Y')"),
    ])
    q["sales_by_period"] = f"SELECT period, start, {r6('revenue', 'revenue')}, orders FROM ({periods})"
    q["cohort_retention"] = """SELECT strftime(f, '%Y-%m') AS cohort, date_diff('month', f, o_orderdate) AS months_since, count(DISTINCT o_custkey) AS customers
        FROM (SELECT o_custkey, o_orderdate, date_trunc('month', min(o_orderdate) OVER (PARTITION BY o_custkey)) AS f FROM orders) GROUP BY 1, 2"""
    q["cohort_retention_bucketed"], q["purchase_interval_bucketed"] = q["cohort_retention"], q["purchase_interval"]
    q["observed_checks"] = f"""SELECT 'domain' AS "check", rule AS name, CAST(violations AS DOUBLE) AS figure FROM ({q["domain_violations"]})
        UNION ALL SELECT 'outlier', "column", CAST(outliers AS DOUBLE) FROM ({q["outlier_flag_count"]})
        UNION ALL SELECT 'label', 'rate', churn_rate FROM ({q["label_rate_check"]})"""
    q["sales_by_payment"] = f"SELECT payment_method, {r6(_money('total_spend'), 'revenue')}, count(*) AS customers FROM typed GROUP BY 1"
    q["sales_by_region"] = f"""SELECT r_name AS region, n_name AS nation, {r6(_money('o_totalprice'), 'revenue')}, count(*) AS orders
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
    ages = """CASE WHEN age <= 0 THEN 'Unknown' WHEN age <= 24 THEN '18-24' WHEN age <= 34 THEN '25-34' WHEN age <= 44 THEN '35-44'
        WHEN age <= 54 THEN '45-54' WHEN age <= 64 THEN '55-64' WHEN age <= 100 THEN '65+' ELSE 'Unknown' END"""
    q["demographic_segments"] = f"""SELECT coalesce(a, 'All') AS age_group, coalesce(gender, 'All') AS gender, coalesce(city, 'All') AS city,
        count(*) AS customers, {r6('avg(churn)', 'churn_rate')}, {r6(_money('total_spend'), 'revenue')}
        FROM (SELECT *, {ages} AS a FROM typed) GROUP BY CUBE (a, gender, city)"""
    all_edges = "SELECT max(last_purchase_date) AS ref FROM typed"
    q["clean_and_segment"] = f"""WITH day AS ({all_edges}), cut AS (
            SELECT {edge_list("date_diff('day', last_purchase_date, day.ref)")} AS r, {edge_list("total_orders")} AS f, {edge_list("total_spend")} AS m FROM typed, day),
        marks AS (SELECT len(r) - {band("date_diff('day', last_purchase_date, day.ref)", "r")} AS rs, {band("total_orders", "f")} AS fs, {band("total_spend", "m")} AS ms FROM typed, day, cut)
        SELECT CASE WHEN rs IS NULL OR fs IS NULL OR ms IS NULL THEN 'Unknown'
            WHEN rs >= 4 AND fs >= 4 AND ms >= 4 THEN 'Champions' WHEN rs >= 3 AND fs >= 3 THEN 'Loyal Customers'
            WHEN rs >= 4 AND fs <= 2 THEN 'Recent Users' WHEN rs <= 2 AND fs >= 4 THEN 'At Risk'
            WHEN rs <= 2 AND fs <= 2 THEN 'Lost' ELSE 'Average' END AS rfm_segment, count(*) AS customers FROM marks GROUP BY 1"""
    return q


def oracle_sql() -> dict[str, str]:
    """Every checkable query's SQL, complete with the stages it builds on."""
    made = {}
    for name, body in _bodies().items():
        body = body.strip()
        made[name] = with_stages(f"SELECT * FROM ({body})" if body.startswith("WITH") else body)
    return made
