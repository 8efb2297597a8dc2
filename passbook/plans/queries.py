"""The queries of the analytics engine over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import asof, behaviour, canonical, columns, partials, profile, recurring, store, synthetic, tables, tier2
from ..operators.scratch import laid
from ..streaming import statements
from .ledger import LEDGER_SQL, entries, ledger, table, together

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, money: str = ""):
    """Register a query and its SQL; ``money`` names decimal columns of the result, which both sides give as double."""
    columns = money.split()

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in columns})

        QUERIES[f.__name__] = run if columns else f
        if sql is not None:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)}) FROM ({sql})" if columns else sql
        return f

    return add


def _d(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {_d(b)} > 0 THEN {_d(a)} / {_d(b)} ELSE 0.0 END"


def _slope(n="n", sx="sx", sy="sy", sxx="sxx", sxy="sxy") -> str:
    n, sx, sy, sxx, sxy = map(_d, (n, sx, sy, sxx, sxy))
    return f"CASE WHEN {n} >= 2 AND {n} * {sxx} - {sx} * {sx} > 0 THEN ({n} * {sxy} - {sx} * {sy}) / ({n} * {sxx} - {sx} * {sx}) ELSE 0.0 END"


def _var(n="n", s="s", ss="ss") -> str:
    n, s, ss = map(_d, (n, s, ss))
    return f"greatest({ss} / {n} - ({s} / {n}) * ({s} / {n}), 0.0)"


_WITH = "WITH RECURSIVE " + LEDGER_SQL

_TOTALS = f"""
    t AS (
      SELECT customer_id, count(*) AS n_transactions, min(date) AS first_date, max(date) AS last_date,
        CAST(coalesce(sum(credit), 0) AS DECIMAL(28,2)) AS incoming_total, CAST(coalesce(sum(debit), 0) AS DECIMAL(28,2)) AS outgoing_total,
        coalesce(sum(debit) FILTER (WHERE isodow(date) >= 6), 0) AS weekend, CAST(coalesce(sum(debit) FILTER (WHERE category = 'Investments'), 0) AS DECIMAL(28,2)) AS investment_spend,
        CAST(coalesce(sum(debit) FILTER (WHERE category = 'EMI'), 0) AS DECIMAL(28,2)) AS emi_spend, CAST(coalesce(sum(debit) FILTER (WHERE category IN ('Loan', 'EMI')), 0) AS DECIMAL(28,2)) AS debt_spend,
        CAST(datesub('day', min(date), max(date)) AS BIGINT) AS days_covered
      FROM ledger GROUP BY customer_id
    ), totals AS (
      SELECT *, CAST(incoming_total - outgoing_total AS DECIMAL(28,2)) AS net_cashflow, greatest({_d('days_covered')} / 30.0::DOUBLE, 1.0::DOUBLE / 30.0::DOUBLE) AS months_covered,
        greatest({_d('days_covered')} / 7.0::DOUBLE, 1.0::DOUBLE / 7.0::DOUBLE) AS weeks FROM t
    )
"""


@query(
    f"""{_WITH}, {_TOTALS} SELECT customer_id, n_transactions, days_covered, incoming_total, outgoing_total, net_cashflow, {_d('outgoing_total')} / months_covered AS monthly_spend,
    {_d('outgoing_total')} / weeks AS weekly_spend, {_d('net_cashflow')} / months_covered AS monthly_saving FROM totals"""
, money="incoming_total outgoing_total net_cashflow")
def behaviour_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.totals(entries(spark, sf_dir)).select("customer_id", "n_transactions", "days_covered", "incoming_total", "outgoing_total", "net_cashflow", "monthly_spend", "weekly_spend", "monthly_saving")


@query(
    f"""{_WITH}, {_TOTALS} SELECT customer_id, {_ratio('weekend', 'outgoing_total')} AS weekend_spend_ratio, investment_spend, emi_spend, debt_spend, {_ratio('net_cashflow', 'incoming_total')} AS savings_ratio,
    {_ratio('investment_spend', 'incoming_total')} AS investment_ratio, {_ratio('emi_spend', 'incoming_total')} AS emi_ratio, {_ratio('debt_spend', 'incoming_total')} AS debt_ratio,
    {_ratio('outgoing_total', 'incoming_total')} AS expense_ratio FROM totals"""
, money="investment_spend emi_spend debt_spend")
def behaviour_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.totals(entries(spark, sf_dir)).select("customer_id", "weekend_spend_ratio", "investment_spend", "emi_spend", "debt_spend", "savings_ratio", "investment_ratio", "emi_ratio", "debt_ratio", "expense_ratio")


@query(f"{_WITH} SELECT customer_id, {_d('min(balance)')} AS balance_min, {_d('max(balance)')} AS balance_max, {_d('sum(balance)')} / {_d('count(balance)')} AS balance_mean FROM ledger GROUP BY customer_id")
def balance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.balance_stats(ledger(spark, sf_dir))


def _trend_sql(points: str, name: str) -> str:
    return f"""{_WITH}, p AS ({points}), s AS (SELECT customer_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM p GROUP BY customer_id)
    SELECT customer_id, {_slope()} AS {name} FROM s"""


@query(_trend_sql("SELECT customer_id, CAST(datesub('day', min(date) OVER (PARTITION BY customer_id), date) AS DECIMAL(12,0)) AS x, balance AS y FROM ledger", "balance_daily_trend"))
def balance_trend_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.daily_trend(ledger(spark, sf_dir))


def _period_sql(period: str) -> str:
    last = f"SELECT customer_id, date_trunc('{period}', date) AS period, arg_max(balance, seq) AS y FROM ledger GROUP BY ALL"
    return _trend_sql(f"SELECT customer_id, y, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY period) - 1 AS DECIMAL(12,0)) AS x FROM ({last})", f"balance_{period}ly_trend")


@query(_period_sql("month"))
def balance_trend_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.period_trend(ledger(spark, sf_dir), "month")


@query(_period_sql("quarter"))
def balance_trend_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.period_trend(ledger(spark, sf_dir), "quarter")


@query(
    f"""{_WITH}, s AS (SELECT customer_id, count(*) AS n, sum(debit) AS s, sum(CAST(debit * debit AS DECIMAL(38,4))) AS ss, quantile_cont({_d('debit')}, 0.5) AS txn_size_median FROM ledger WHERE debit > 0 GROUP BY customer_id)
    SELECT customer_id, {_d('s')} / {_d('n')} AS txn_size_mean, txn_size_median, {_var()} AS txn_size_variance FROM s"""
)
def txn_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.size_stats(entries(spark, sf_dir))


def _add_frequency(column: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return behaviour.frequencies(entries(spark, sf_dir), column)

    f.__name__ = f"freq_{column}"
    query(f"{_WITH} SELECT customer_id, {column} AS name, count(*) AS n FROM ledger WHERE coalesce({column}, '') <> '' GROUP BY ALL")(f)


for _c in ("merchant", "category", "payment_mode"):
    _add_frequency(_c)


@query(
    _WITH + "".join(f"{' UNION ALL' if i else ''} SELECT customer_id, '{c}' AS kind, {c} AS name, count(*) AS n FROM ledger WHERE coalesce({c}, '') <> '' GROUP BY ALL" for i, c in enumerate(("merchant", "category", "payment_mode")))
)
def all_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.all_frequencies(entries(spark, sf_dir, together(spark, sf_dir)))


@query(f"{_WITH}, f AS (SELECT customer_id, merchant, count(*) AS n FROM ledger WHERE merchant <> '' GROUP BY ALL) SELECT customer_id, {_ratio('max(n)', 'sum(n)')} AS merchant_loyalty FROM f GROUP BY customer_id")
def merchant_loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.loyalty(entries(spark, sf_dir))


@query(
    f"""{_WITH}, m AS (SELECT customer_id, date_trunc('month', date) AS month, CAST(sum(coalesce(credit, 0)) - sum(coalesce(debit, 0)) AS DECIMAL(18,2)) AS net FROM ledger GROUP BY ALL),
    spine AS (SELECT customer_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY customer_id),
    f AS (SELECT s.customer_id, coalesce(m.net, 0) AS net FROM spine s LEFT JOIN m ON s.customer_id = m.customer_id AND s.month = m.month),
    s AS (SELECT customer_id, count(*) AS n, sum(net) AS s, sum(CAST(net * net AS DECIMAL(38,4))) AS ss FROM f GROUP BY customer_id)
    SELECT customer_id, CASE WHEN n >= 2 AND {_d('s')} / {_d('n')} <> 0 THEN abs(sqrt({_var()}) / ({_d('s')} / {_d('n')})) ELSE 0.0 END AS cashflow_volatility FROM s"""
)
def cashflow_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.volatility(entries(spark, sf_dir))


@query(
    f"""{_WITH}, c AS (SELECT customer_id, credit FROM ledger WHERE credit > 0), q AS (SELECT customer_id, quantile_cont({_d('credit')}, 0.75) AS q FROM c GROUP BY customer_id HAVING count(*) >= 2),
    b AS (SELECT customer_id, CAST(round_even(CAST(credit / 1000 AS DOUBLE), 0) AS BIGINT) AS bucket, count(*) AS n, quantile_cont({_d('credit')}, 0.5) AS m FROM c JOIN q USING (customer_id) WHERE {_d('credit')} >= q GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY customer_id) AS kept, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, bucket) AS k FROM b)
    SELECT customer_id, m AS salary_amount FROM r WHERE k = 1 AND n >= 2 AND kept >= 2"""
)
def salary_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.salaries(entries(spark, sf_dir))


_CLUSTERS = f"""
    rows3 AS (
      SELECT customer_id, lower(coalesce(merchant, '')) AS merchant, CASE WHEN credit > 0 THEN 'credit' ELSE 'debit' END AS direction,
             CAST(CASE WHEN credit > 0 THEN credit ELSE coalesce(debit, 0) END AS DECIMAL(18,2)) AS amount, date, lower(coalesce(description, '')) AS description FROM ledger
    ), prep AS (SELECT * FROM rows3 WHERE merchant <> '' AND amount <> 0),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY customer_id, merchant, direction ORDER BY amount, date, description) AS k FROM prep),
    fold AS (
      SELECT customer_id, merchant, direction, k, amount, date, description, CAST(amount AS DECIMAL(28,2)) AS s, CAST(1 AS BIGINT) AS n, amount AS cluster FROM numbered WHERE k = 1
      UNION ALL
      SELECT x.customer_id, x.merchant, x.direction, x.k, x.amount, x.date, x.description,
             CASE WHEN near THEN CAST(f.s + x.amount AS DECIMAL(28,2)) ELSE CAST(x.amount AS DECIMAL(28,2)) END, CASE WHEN near THEN f.n + 1 ELSE 1 END, CASE WHEN near THEN f.cluster ELSE x.amount END
      FROM fold f JOIN numbered x ON f.customer_id = x.customer_id AND f.merchant = x.merchant AND f.direction = x.direction AND x.k = f.k + 1,
           LATERAL (SELECT abs({_d('x.amount')} - {_d('f.s')} / {_d('f.n')}) <= greatest(0.1::DOUBLE * abs({_d('f.s')} / {_d('f.n')}), 1.0::DOUBLE) AS near)
    ), clustered AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY customer_id, merchant, direction, cluster) AS occurrences FROM fold) WHERE occurrences >= 3)
"""
_HAS = {k: " OR ".join(f"contains(merchant, '{w}') OR contains(description, '{w}')" for w in ws) for k, ws in recurring.KINDS.items()}
_KIND_CASE = "CASE WHEN direction = 'credit' AND h5 THEN 'Loan Repayment' WHEN direction = 'credit' THEN 'Salary' " + " ".join(f"WHEN h{i} THEN '{k}'" for i, k in enumerate(recurring.KINDS)) + " WHEN cadence = 'monthly' AND median_amount >= 5000 THEN 'Rent' ELSE 'Subscription' END"
_RECURRING = f"""
    gaps AS (SELECT *, datesub('day', lag(date) OVER (PARTITION BY customer_id, merchant, direction, cluster ORDER BY date), date) AS gap FROM clustered),
    g AS (SELECT customer_id, merchant, direction, cluster, count(*) AS occurrences, quantile_cont({_d('amount')}, 0.5) AS median_amount, quantile_cont({_d('gap')}, 0.5) FILTER (WHERE gap > 0) AS median_gap,
          count(gap) FILTER (WHERE gap > 0) AS n, sum(gap) FILTER (WHERE gap > 0) AS s, sum(gap * gap) FILTER (WHERE gap > 0) AS ss, {', '.join(f'bool_or({t}) AS h{i}' for i, t in enumerate(_HAS.values()))} FROM gaps GROUP BY ALL),
    c AS (SELECT *, CASE {' '.join(f"WHEN median_gap BETWEEN {a} AND {b} THEN '{k}'" for k, (a, b) in recurring.CADENCES.items())} END AS cadence FROM g),
    recurring AS (SELECT customer_id, merchant, direction, {_d('cluster')} AS cluster, {_KIND_CASE} AS category, cadence, median_amount, greatest(0.1::DOUBLE * median_amount, 1.0::DOUBLE) AS amount_tolerance, occurrences,
          1.0::DOUBLE - least(sqrt({_var()}) / median_gap, 1.0::DOUBLE) AS regularity FROM c WHERE cadence IS NOT NULL)
"""


@query(f"{_WITH}, {_CLUSTERS} SELECT customer_id, merchant, direction, amount, date, cluster, occurrences FROM clustered", money="amount cluster")
def recurring_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = together(spark, sf_dir)
    return recurring.clustered(entries(spark, sf_dir, parts), parts).select("customer_id", "merchant", "direction", "amount", "date", "cluster", "occurrences")


@query(f"{_WITH}, {_CLUSTERS}, {_RECURRING} SELECT *, 0.5::DOUBLE * regularity + 0.5::DOUBLE * least({_d('occurrences')} / 6.0::DOUBLE, 1.0::DOUBLE) AS confidence FROM recurring")
def recurring_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = together(spark, sf_dir)
    return recurring.recurring(entries(spark, sf_dir, parts), parts)


@query(
    f"""{_WITH}, {_CLUSTERS}, {_RECURRING}, c2 AS (SELECT *, 0.5::DOUBLE * regularity + 0.5::DOUBLE * least({_d('occurrences')} / 6.0::DOUBLE, 1.0::DOUBLE) AS confidence FROM recurring)
    SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY confidence DESC, occurrences DESC, merchant, direction, cluster) AS rank, merchant, direction, cluster, confidence FROM c2"""
)
def recurring_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recurring.ranked(recurring_items(spark, sf_dir))
    return found.select("customer_id", F.col("rank").cast("long").alias("rank"), "merchant", "direction", "cluster", "confidence")


@query(f"{_WITH}, f AS (SELECT customer_id, merchant AS name, count(*) AS n FROM ledger WHERE merchant <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, name) AS rank FROM f) SELECT customer_id, rank, name, n FROM r WHERE rank <= 5")
def top_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_names(entries(spark, sf_dir), "merchant").select("customer_id", F.col("rank").cast("long").alias("rank"), "name", "n")


@query(f"{_WITH}, f AS (SELECT customer_id, category, count(*) AS n FROM ledger WHERE category <> '' GROUP BY ALL) SELECT customer_id, category, {_d('n')} / {_d('sum(n) OVER (PARTITION BY customer_id)')} AS share FROM f")
def spend_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.category_shares(entries(spark, sf_dir))


_PAID = """
    items AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY confidence DESC, occurrences DESC, merchant, direction, cluster) AS rank,
      row_number() OVER (PARTITION BY customer_id, category ORDER BY confidence DESC, occurrences DESC, cluster) AS in_kind FROM recurring_items),
    paid AS (SELECT customer_id, max(median_amount) FILTER (WHERE category = 'Salary' AND in_kind = 1) AS sure, max(confidence) FILTER (WHERE category = 'Salary') AS stability,
      count(*) FILTER (WHERE category = 'Subscription') AS subscriptions, string_agg(concat_ws(':', merchant, direction, category, cadence, occurrences), ',' ORDER BY rank) AS items FROM items GROUP BY customer_id)
"""
_PARTS = ["behaviour_totals", "behaviour_ratios", "balance_stats", "balance_trend_monthly", "txn_size_stats", "merchant_loyalty", "cashflow_volatility", "salary_detection"]
_JOINED = "behaviour_totals " + " ".join(f"LEFT JOIN {q} USING (customer_id)" for q in [*_PARTS[1:], "paid"])
_INCOME = "coalesce(sure, salary_amount)"
_STABILITY = "coalesce(stability, CASE WHEN salary_amount IS NOT NULL THEN 0.5::DOUBLE END)"


def _with_parts(*more: str) -> str:
    """The SQL of other queries as common table expressions of their names."""
    return _WITH + "".join(f", {q} AS ({SQL[q]})" for q in [*_PARTS, "recurring_items", *more]) + f", {_PAID}"


@query(
    f"""{_with_parts("top_merchants", "spend_by_category")}, {_TOTALS},
    m AS (SELECT customer_id, string_agg(name, '|' ORDER BY rank) AS preferred_merchants FROM top_merchants GROUP BY customer_id),
    f AS (SELECT customer_id, payment_mode AS name, count(*) AS n FROM ledger WHERE payment_mode <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, name) AS rank FROM f),
    p AS (SELECT customer_id, string_agg(name, '|' ORDER BY rank) AS preferred_payment_modes FROM r WHERE rank <= 5 GROUP BY customer_id),
    s AS (SELECT customer_id, string_agg(category || '=' || CAST(floor(share * 1000000) AS BIGINT), ',' ORDER BY category) AS spend_by_category FROM spend_by_category GROUP BY customer_id)
    SELECT customer_id, {_INCOME} AS income, {_STABILITY} AS income_stability, b.monthly_spend, b.monthly_saving, b.savings_ratio, b.investment_ratio, b.debt_ratio, b.expense_ratio,
      coalesce(preferred_merchants, '') AS preferred_merchants, coalesce(preferred_payment_modes, '') AS preferred_payment_modes, coalesce({_INCOME}, 0.0::DOUBLE) AS expected_income, b.net_cashflow, coalesce(spend_by_category, '') AS spend_by_category,
      coalesce(b.cashflow_volatility, 0.0::DOUBLE) AS cashflow_volatility, coalesce(b.items, '') AS recurring, coalesce(b.subscriptions, 0) AS subscription_count, b.balance_mean, totals.months_covered
    FROM (SELECT * FROM {_JOINED}) b LEFT JOIN totals USING (customer_id) LEFT JOIN m USING (customer_id) LEFT JOIN p USING (customer_id) LEFT JOIN s USING (customer_id)"""
)
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the lists and the expected cash flow as plain columns."""
    parts = together(spark, sf_dir)
    df, flow = profile.profiles(ledger(spark, sf_dir, parts), parts), "expected_cashflow"
    share = F.transform(F.array_sort(F.map_entries(f"{flow}.spend_by_category")), lambda e: F.concat_ws("=", e["key"], F.floor(e["value"] * 1000000).cast("string")))
    item = F.transform(f"{flow}.recurring", lambda i: F.concat_ws(":", i["merchant"], i["direction"], i["category"], i["cadence"], i["occurrences"]))
    text_of = lambda c, by: F.coalesce(F.array_join(c, by), F.lit(""))
    return df.select(
        "customer_id", "income", "income_stability", "monthly_spend", "monthly_saving", "savings_ratio", "investment_ratio", "debt_ratio", "expense_ratio",
        text_of("preferred_merchants", "|").alias("preferred_merchants"), text_of("preferred_payment_modes", "|").alias("preferred_payment_modes"), f"{flow}.expected_income",
        F.col(f"{flow}.net_cashflow").cast("double").alias("net_cashflow"), text_of(share, ",").alias("spend_by_category"), f"{flow}.cashflow_volatility", text_of(item, ",").alias("recurring"),
        F.col(f"{flow}.subscription_count").cast("long").alias("subscription_count"), f"{flow}.balance_mean", f"{flow}.months_covered",
    )


_mode_is = lambda *names: f"count(*) FILTER (WHERE payment_mode IN ({', '.join(repr(n) for n in names)}))"
_COUNTS = ", ".join(
    [
        "count(*) AS n", "count(*) FILTER (WHERE category = 'Salary') AS salaries", "count(*) FILTER (WHERE category <> '') AS with_category", "count(*) FILTER (WHERE payment_mode <> '') AS with_mode",
        f"{_mode_is(*profile.ONLINE)} AS online", f"{_mode_is(*profile.ONLINE, *profile.OFFLINE)} AS known", "count(DISTINCT merchant) FILTER (WHERE merchant <> '') AS merchants",
        *[f"count(*) FILTER (WHERE category = '{c}') AS c_{c}" for c in profile.SHARES], *[f"{_mode_is(m)} AS m_{m}" for m in rules.KNOWN_SHARES],
    ]
)
_FEATURE_SQL = {
    "avg_income": _INCOME, "income_consistency": _STABILITY, "avg_monthly_spend": "monthly_spend", "avg_monthly_saving": "monthly_saving", "savings_rate": "savings_ratio",
    "credit_frequency": _ratio("salaries", "n"), "debit_frequency": _ratio("(n - salaries)", "n"), "upi_frequency": _ratio("m_UPI", "n"), "atm_frequency": _ratio("m_ATM", "n"),
    "online_spend_ratio": _ratio("online", "known"), "merchant_diversity": _ratio("merchants", "n"), "subscription_count": "CAST(subscriptions AS DOUBLE)",
} | {f"pct_{c.lower()}": _ratio(f"c_{c}", "with_category") for c in profile.SHARES} | {f"freq_{m.lower()}": _ratio(f"m_{m}", "with_mode") for m in rules.KNOWN_SHARES}


@query(
    f"""{_with_parts()}, counts AS (SELECT customer_id, {_COUNTS} FROM ledger GROUP BY customer_id)
    SELECT customer_id, {', '.join(f"coalesce({_FEATURE_SQL.get(c, c)}, 0.0::DOUBLE) AS {c}" for c in profile.FEATURES[1:])} FROM {_JOINED} LEFT JOIN counts USING (customer_id)"""
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = together(spark, sf_dir)
    return profile.feature_table(ledger(spark, sf_dir, parts), parts)


@query(SQL["feature_table"])
def feature_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows from sums that took in the ledger in three parts, by a hash of the transaction, one after the other."""
    parts = together(spark, sf_dir)
    whole = profile.narrow(ledger(spark, sf_dir, parts), parts)
    part = F.pmod(F.xxhash64("customer_id", "seq"), F.lit(3))
    kept: dict[str, DataFrame] = {}
    for k in range(3):
        new = partials.partials(whole.where(part == k))
        kept = {name: laid(df, name, "customer_id", parts) for name, df in (partials.merged(kept, new) if kept else new).items()}
    return profile.features_of(kept, parts)


@query(
    f"""{_WITH}, l AS (SELECT customer_id, date, balance FROM ledger QUALIFY row_number() OVER (PARTITION BY customer_id, date ORDER BY balance DESC) = 1),
    a AS (SELECT o_orderkey, o_custkey AS customer_id, o_orderdate AS date FROM orders)
    SELECT a.o_orderkey, a.customer_id, a.date, {_d('l.balance')} AS balance FROM a ASOF LEFT JOIN l ON a.customer_id = l.customer_id AND a.date >= l.date"""
)
def balance_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's balance when an order was made: that of the last transaction not after it."""
    at = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("date"))
    held = ledger(spark, sf_dir).select("customer_id", F.col("date").cast("timestamp_ntz").alias("date"), "balance")
    return asof.asof(at, held, ["customer_id"], "date", ["balance"]).withColumn("balance", F.col("balance").cast("double"))


@query(
    """WITH s AS (SELECT o_custkey AS customer_id, o_orderkey, o_orderdate AS opens, o_orderdate + INTERVAL 30 DAY AS closes FROM orders), t AS (SELECT o_custkey AS customer_id, l_shipdate AS date, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT s.o_orderkey, count(*) AS n, CAST(sum(price) AS DECIMAL(28,2)) AS total FROM t JOIN s ON t.customer_id = s.customer_id AND t.date >= s.opens AND t.date < s.closes GROUP BY s.o_orderkey""",
    money="total",
)
def shipped_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer was shipped in the thirty days after each of their orders, whichever order it belongs to."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("opens"))
    spans = orders.withColumn("closes", F.col("opens") + F.expr("INTERVAL 30 DAY"))
    price = F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp_ntz").alias("date"), price).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "customer_id"), "l_orderkey").drop("l_orderkey")
    met = asof.in_intervals(rows, spans, ["customer_id"], "date", "opens", "closes", unit="month")
    return met.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("decimal(28,2)").alias("total"))


_PIECES = {**{m: f"regexp_matches(description, '(?i){p}')" for m, p in rules.MODE_PREFIXES.items()}}


@query(f"{_WITH} SELECT customer_id, seq, CASE {' '.join(f'WHEN {t} THEN {m!r}' for m, t in _PIECES.items())} END AS mode FROM ledger")
def payment_mode_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("customer_id", "seq", text.mode_by_prefix(F.col("description")).alias("mode"))


@query(f"{_WITH} SELECT customer_id, seq, CASE {' '.join(f'''WHEN regexp_matches(description, '(?i){p}') THEN '{m}' ''' for m, p in rules.MODE_WORDS.items())} END AS mode FROM ledger")
def payment_mode_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("customer_id", "seq", text.mode_by_word(F.col("description")).alias("mode"))


def _strip_sql(c: str) -> str:
    for p in [*rules.HANDLES, *[rf"\b{w}\b" for w in rules.NOISE_WORDS]]:
        c = f"regexp_replace({c}, '(?i){p}', ' ', 'g')"
    return f"regexp_replace({c}, '\\d{{6,}}', ' ', 'g')"


_CANDIDATE = f"""
    pieces AS (SELECT customer_id, seq, list_filter(list_transform(regexp_split_to_array({_strip_sql('description')}, '{rules.TOKEN_BREAKS}'), lambda t: trim(t)),
      lambda t: length(t) > 1 AND NOT list_contains([{', '.join(f"'{r}'" for r in rules.ROUTING)}], upper(t)) AND NOT regexp_full_match(t, '\\d+')) AS tokens FROM ledger),
    cand AS (SELECT customer_id, seq, trim(regexp_replace(array_to_string(tokens, ' '), '\\s+', ' ', 'g')) AS candidate FROM pieces)
"""
_NAMES_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ({m.upper(): m for m in rules.MERCHANTS} | rules.ALIASES).items()) + "}"


@query(f"{_WITH}, {_CANDIDATE} SELECT customer_id, seq, candidate FROM cand")
def merchant_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("customer_id", "seq", text.candidate(F.col("description")).alias("candidate"))


@query(
    f"""{_WITH}, {_CANDIDATE}, n AS (SELECT *, {_NAMES_SQL} AS names FROM cand),
    w AS (SELECT customer_id, seq, names[upper(candidate)] AS whole, list_filter(list_transform(string_split(upper(candidate), ' '), lambda x: names[x]), lambda x: x IS NOT NULL)[1] AS word FROM n)
    SELECT customer_id, seq, coalesce(whole, word) AS merchant, CASE WHEN whole IS NOT NULL THEN 0.95::DOUBLE WHEN word IS NOT NULL THEN 0.9::DOUBLE END AS confidence FROM w"""
)
def merchant_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("customer_id", "seq", text.canonical(text.candidate(F.col("description"))).alias("m")).select("customer_id", "seq", "m.merchant", "m.confidence")


_KEYWORD_CASE = "CASE " + " ".join(f"WHEN contains(low, '{k}') THEN '{c}'" for k, c in rules.keywords_by_length()) + " END"


@query(f"SELECT doc_id, {_KEYWORD_CASE} AS category FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)")
def category_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_category(F.col("text")).alias("category"))


_OVERRIDE = "CASE merchant " + " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in rules.MERCHANT_CATEGORIES.items()) + " END"


@query(
    f"""{_WITH}, r AS (SELECT customer_id, seq, {_OVERRIDE} AS a, {_KEYWORD_CASE} AS b FROM (SELECT *, lower(concat_ws(' ', merchant, description)) AS low FROM ledger))
    SELECT customer_id, seq, coalesce(a, b, 'Others') AS category, CASE WHEN a IS NOT NULL THEN 0.95::DOUBLE WHEN b IS NOT NULL THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS category_confidence FROM r"""
)
def category_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.with_categories(ledger(spark, sf_dir).drop("category")).select("customer_id", "seq", "category", "category_confidence")


@query()
def category_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier 2 over merchants and descriptions that no rule settles; rows only, as the model is learned."""
    df = table(spark, sf_dir, "part").select(F.col("p_partkey"), F.lit(None).cast("string").alias("merchant"), F.col("p_name").alias("description"))
    return canonical.with_categories(df, tier2.fit(spark)).select("p_partkey", "category", "category_confidence")


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS date FROM orders", money="amount")
def parsed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with thousands separators and day-first dates, read back."""
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("a"), F.date_format("o_orderdate", "d/M/yyyy").alias("d"))
    return raw.select("o_orderkey", text.amount(F.col("a")).alias("amount"), text.statement_date(F.col("d")).alias("date"))


@query(
    "SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in ws) + f" THEN '{b}'" for b, ws in text.BANKS.items())
    + " END AS bank, CASE WHEN contains(low, 'debit') AND contains(low, 'credit') THEN 'dual_amount_columns' WHEN contains(low, 'withdrawal') OR contains(low, 'deposit') THEN 'withdrawal_deposit_columns'"
    " WHEN contains(low, 'particulars') OR contains(low, 'narration') THEN 'narration_table' ELSE 'generic_table' END AS layout FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)"
)
def bank_and_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.bank_of(F.col("text")).alias("bank"), text.layout_hint(F.col("text")).alias("layout"))


def _numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with path (the customer) and row."""
    from pyspark.sql import Window

    row = (F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey")) - 1).cast("long")
    return table(spark, sf_dir, "orders").withColumn("path", F.col("o_custkey").cast("string")).withColumn("row", row)


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw cells of one file a customer."""
    o = _numbered_orders(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(h).alias("header"), v.alias("value")) for i, (h, v) in enumerate([("When", F.date_format("o_orderdate", "dd/MM/yyyy")), ("What", F.col("o_orderpriority")), ("Sum", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))])])
    return o.select("path", "row", F.explode(cells).alias("c")).select("path", "row", "c.*")


@query(
    """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
    w AS (SELECT *, lag(v) OVER (PARTITION BY path ORDER BY k) AS b FROM o WHERE k < 30),
    g AS (SELECT path, count(*) FILTER (WHERE k < 20) AS n, count(*) AS m, count(b) AS steps, count(*) FILTER (WHERE b <> v) AS moves FROM w GROUP BY path),
    t AS (SELECT *, n >= greatest(3, n // 3) AS enough FROM g)
    SELECT path, 0 AS pos, 'When' AS header, enough AS is_date, FALSE AS is_amount, FALSE AS is_balance FROM t UNION ALL SELECT path, 1, 'What', FALSE, FALSE, FALSE FROM t
    UNION ALL SELECT path, 2, 'Sum', FALSE, enough, enough AND m >= 3 AND moves >= steps // 2 FROM t"""
)
def column_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_tests(_order_cells(spark, sf_dir))


@query(
    f"""WITH t AS ({SQL['column_tests']}) SELECT path, pos, CASE WHEN header = 'When' AND is_date THEN 'date' WHEN header = 'Sum' AND is_balance THEN 'balance' WHEN header = 'Sum' AND is_amount THEN 'debit' END AS field, header AS source_column,
    CASE WHEN header = 'When' AND is_date THEN 0.75::DOUBLE WHEN header = 'Sum' AND is_balance THEN 0.7::DOUBLE WHEN header = 'Sum' AND is_amount THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
    CASE WHEN header <> 'What' AND (is_date OR is_amount) THEN 'inferred' ELSE 'unmapped' END AS method FROM t"""
)
def column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that no name fits, so what their values show decides."""
    return columns.column_mapping(_order_cells(spark, sf_dir))


_HEADS = [
    # header of the file of suppliers whose key leaves this remainder, field, confidence and method
    [("Txn Date", "date", 1.0, "exact"), ("NARRATION", "description", 1.0, "exact"), ("Debit", "debit", 1.0, "exact"), ("Credit  Amount", "credit", 1.0, "exact"), ("Closing Balance", "balance", 1.0, "exact"), ("Chq No", "reference_number", 1.0, "exact")],
    [("Date Value", "date", 1.0, "fuzzy"), ("Particulars", "description", 1.0, "exact"), ("Withdrawals", "debit", 0.952, "fuzzy"), ("Deposits", "credit", 0.933, "fuzzy"), ("Balance Closing", "balance", 1.0, "fuzzy"), ("Extra Notes", None, 0.0, "unmapped")],
    [("Posting Date", "date", 1.0, "exact"), ("Details", "description", 1.0, "exact"), ("Signed Amount", "amount", 1.0, "exact"), ("Something", None, 0.0, "unmapped")],
]
_HEAD_ROWS = ", ".join(f"({k}, {i}, '{h}', {repr(f) if f else 'NULL'}, {c}::DOUBLE, '{m}')" for k, heads in enumerate(_HEADS) for i, (h, f, c, m) in enumerate(heads))


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS path, pos, field, header AS source_column, confidence, method FROM supplier JOIN (VALUES {_HEAD_ROWS}) AS h(k, pos, header, field, confidence, method) ON s_suppkey % {len(_HEADS)} = k")
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three layouts whose headers say what a column is, exactly, in another order or nearly."""
    heads = F.array(*[F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(h).alias("header"), F.lit("x").alias("value")) for i, (h, *_) in enumerate(hs)]) for hs in _HEADS])
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.lit(0).cast("long").alias("row"), F.explode(F.get(heads, (F.col("s_suppkey") % len(_HEADS)).cast("int"))).alias("c"))
    return columns.column_mapping(cells.select("path", "row", "c.*"))


@query(
    f"""{_with_parts()} SELECT c_custkey AS customer_id, coalesce(n_transactions, 0) AS n_transactions, coalesce(incoming_total, 0) AS incoming_total, coalesce(monthly_spend, 0) AS monthly_spend, coalesce(savings_ratio, 0) AS savings_ratio, balance_min,
    coalesce(cashflow_volatility, 0) AS cashflow_volatility, salary_amount, salary_amount IS NOT NULL AS salary_detected FROM customer LEFT JOIN (SELECT * FROM {_JOINED}) ON customer_id = c_custkey""",
    money="incoming_total",
)
def customers_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, with zeros where the ledger has none of their rows."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    parts = together(spark, sf_dir)
    customers = customers.repartition(parts, "customer_id") if parts else customers  # so that what was found is not moved
    found = behaviour.with_customers(behaviour.summary(profile.narrow(ledger(spark, sf_dir, parts), parts, payments=False)), customers)
    return found.select("customer_id", "n_transactions", "incoming_total", "monthly_spend", "savings_ratio", "balance_min", "cashflow_volatility", "salary_amount", "salary_detected")


_ORDER_ROWS = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row, * FROM orders)"


_TITLED = "array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(candidate, ' ')], ' ')"
_MERCHANT = f"CASE WHEN candidate <> '' THEN coalesce(names[upper(candidate)], [names[x] FOR x IN string_split(upper(candidate), ' ') IF names[x] IS NOT NULL][1], {_TITLED}) END"


@query(
    f"""WITH {_ORDER_ROWS}, mapped AS (SELECT path, max(field) FILTER (WHERE source_column = 'Sum') AS sum_is, count(*) FILTER (WHERE field = 'date') AS has_date FROM ({SQL['column_mapping']}) GROUP BY path),
    ledger AS (SELECT path AS customer_id, row AS seq, o_orderpriority AS description, * FROM o JOIN mapped USING (path) WHERE has_date > 0), {_CANDIDATE},
    n AS (SELECT customer_id, seq, {_MERCHANT} AS merchant FROM (SELECT *, {_NAMES_SQL} AS names FROM cand)),
    r AS (SELECT path, row, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS date, description, merchant, CAST(o_totalprice AS DECIMAL(18,2)) AS v, sum_is, lower(concat_ws(' ', merchant, description)) AS low FROM ledger JOIN n USING (customer_id, seq))
    SELECT path, row, date, description, merchant, CASE WHEN sum_is = 'debit' THEN v END AS debit, CAST(NULL AS DECIMAL(18,2)) AS credit, CASE WHEN sum_is = 'balance' THEN v END AS balance, coalesce({_KEYWORD_CASE}, 'Others') AS category FROM r""",
    money="debit credit balance",
)
def statement_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cells of many files to transactions with merchant and category: mapping, normalising, merchants, rules."""
    return canonical.ingested(_order_cells(spark, sf_dir))[0].select("path", "row", "date", "description", "merchant", "debit", "credit", "balance", "category")


@query(
    """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_orderkey % 2 = 0 AS named, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row, l_shipdate AS day, l_linestatus AS kind,
      CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS v FROM lineitem),
    w AS (SELECT *, lag(v) OVER (PARTITION BY path ORDER BY row) AS b FROM l),
    g AS (SELECT path, count(*) AS n, count(b) AS steps, count(*) FILTER (WHERE b <> v) AS moves, avg(CAST(v < 0 AS INT)) AS minus FROM w GROUP BY path),
    f AS (SELECT *, n >= 3 AS enough, n >= 3 AND moves >= steps // 2 AS balance_like FROM l JOIN g USING (path)),
    s AS (SELECT *, NOT named AND enough AND NOT balance_like AS as_debit, NOT named AND balance_like AS as_balance, named OR (minus > 0.1 AND NOT (enough AND NOT balance_like)) AS splits FROM f)
    SELECT path, row, CAST(date_trunc('day', day) AS TIMESTAMP) AS date, CASE WHEN NOT named AND NOT enough THEN kind || ' ' || v ELSE kind END AS description,
      CASE WHEN as_debit THEN v WHEN splits AND v < 0 THEN -v END AS debit, CASE WHEN splits AND v > 0 THEN v END AS credit, CASE WHEN as_balance THEN v END AS balance FROM s""",
    money="debit credit balance",
)
def signed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files with one column of signed amounts, which half of them name and the others only show."""
    from pyspark.sql import Window

    row = (F.row_number().over(Window.partitionBy("path").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1).cast("long")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    named = F.when(F.col("l_orderkey") % 2 == 0, "Amount").otherwise("Value")
    values = [(F.lit("Date"), F.date_format("l_shipdate", "dd/MM/yyyy")), (F.lit("Kind"), F.col("l_linestatus")), (named, F.when(F.col("l_returnflag") == "R", -price).otherwise(price).cast("string"))]
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), h.alias("header"), v.alias("value")) for i, (h, v) in enumerate(values)])
    # Rows of a file are together from here on, so what is asked of a file or a row moves none of them again.
    rows = table(spark, sf_dir, "lineitem").withColumn("path", F.col("l_orderkey").cast("string")).withColumn("row", row)
    cells = rows.select("path", "row", F.explode(cells).alias("c")).select("path", "row", "c.*")
    found, _ = canonical.normalised(cells, columns.column_layouts(cells), signed=columns.signed_amount_columns(cells))
    return found.select("path", "row", "date", "description", "debit", "credit", "balance")


_MISSPELT = "list_value(" + ", ".join(f"'{m}'" for m in rules.MERCHANTS) + f")[1 + CAST(p_partkey % {len(rules.MERCHANTS)} AS INT)]"


@query(
    rf"""WITH RECURSIVE m AS (SELECT p_partkey, {_MISSPELT} AS m FROM part), k AS (SELECT *, CAST(1 + (p_partkey // {len(rules.MERCHANTS)}) % length(m) AS INT) AS spot FROM m),
    ledger AS (SELECT 0 AS customer_id, p_partkey AS seq, 'UPI/DR/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '/' || CASE p_partkey % 3 WHEN 0 THEN left(m, spot - 1) || substr(m, spot + 1) WHEN 1 THEN left(m, spot) || 'q' || substr(m, spot + 1) ELSE m || 's' END AS description FROM k),
    {_CANDIDATE}, t AS (SELECT DISTINCT candidate AS text FROM cand WHERE candidate <> ''), n AS (SELECT unnest({[m for m in rules.MERCHANTS]}) AS name, unnest(range({len(rules.MERCHANTS)})) AS place),
    p AS (SELECT text, name, place, list_sort(list_distinct(string_split(text, ' '))) AS x, list_sort(list_distinct(string_split(name, ' '))) AS y FROM t, n),
    q AS (SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS b, array_to_string(list_sort([w FOR w IN x IF NOT list_contains(y, w)]), ' ') AS rx, array_to_string(list_sort([w FOR w IN y IF NOT list_contains(x, w)]), ' ') AS ry FROM p),
    pairs AS (SELECT DISTINCT unnest([[trim(b || ' ' || rx), trim(b || ' ' || ry)], [b, trim(b || ' ' || rx)], [b, trim(b || ' ' || ry)]]) AS d FROM q),
    lcs AS (
      SELECT d, 0 AS i, [0 FOR z IN range(length(d[2]) + 1)] AS best FROM pairs WHERE d[1] <> '' AND d[2] <> ''
      UNION ALL SELECT d, i + 1, [0] || [list_max([greatest(best[j + 1], CASE WHEN d[1][i + 1] = d[2][j] THEN best[j] + 1 ELSE 0 END) FOR j IN range(1, h + 1)]) FOR h IN range(1, length(d[2]) + 1)] FROM lcs WHERE i < length(d[1])
    ), alike AS (SELECT d, 200.0::DOUBLE * best[-1] / (length(d[1]) + length(d[2])) AS s FROM lcs WHERE i = length(d[1])),
    scored AS (SELECT text, name, place, CASE WHEN b <> '' AND (rx = '' OR ry = '') THEN 100.0::DOUBLE ELSE greatest(a.s, coalesce(CASE WHEN b <> '' THEN c.s END, 0), coalesce(CASE WHEN b <> '' THEN e.s END, 0)) END AS s
      FROM q JOIN alike a ON a.d = [trim(b || ' ' || rx), trim(b || ' ' || ry)] LEFT JOIN alike c ON c.d = [b, trim(b || ' ' || rx)] LEFT JOIN alike e ON e.d = [b, trim(b || ' ' || ry)]),
    likest AS (SELECT text, arg_max(struct_pack(name := name, s := s), struct_pack(s := s, p := -place)) AS f FROM scored WHERE s >= {rules.FUZZY_MERCHANT} GROUP BY text),
    w AS (SELECT seq, candidate, names[upper(candidate)] AS whole, [names[x] FOR x IN string_split(upper(candidate), ' ') IF names[x] IS NOT NULL][1] AS word FROM (SELECT *, {_NAMES_SQL} AS names FROM cand))
    SELECT seq AS p_partkey, CASE WHEN candidate <> '' THEN coalesce(whole, word, f.name, {_TITLED}) END AS merchant,
      CASE WHEN candidate = '' THEN 0.0::DOUBLE WHEN whole IS NOT NULL THEN 0.95::DOUBLE WHEN word IS NOT NULL THEN 0.9::DOUBLE WHEN f IS NOT NULL THEN round(f.s / 100, 3) ELSE 0.4::DOUBLE END AS confidence FROM w LEFT JOIN likest ON text = candidate"""
)
def similar_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants of descriptions that misspell them: a letter left out, replaced or added."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    n = len(rules.MERCHANTS)
    m = F.get(F.array(*map(F.lit, rules.MERCHANTS)), (F.col("p_partkey") % n).cast("int"))
    at = (1 + F.floor(F.col("p_partkey") / n) % F.length(m)).cast("int")
    wrong = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substr(m, F.lit(1), at - 1), F.substr(m, at + 1))).when(F.col("p_partkey") % 3 == 1, F.concat(F.substr(m, F.lit(1), at), F.lit("q"), F.substr(m, at + 1))).otherwise(F.concat(m, F.lit("s")))
    df = p.select("p_partkey", F.concat(F.lit("UPI/DR/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("/"), wrong).alias("description"))
    return canonical.with_merchants(df).select("p_partkey", "merchant", F.col("merchant_confidence").alias("confidence"))


@query(
    f"""WITH {_ORDER_ROWS}, m AS (SELECT path, count(*) FILTER (WHERE field = 'date') AS has_date FROM ({SQL['column_mapping']}) GROUP BY path)
    SELECT path, row, 'no date' AS reason FROM o JOIN m USING (path) WHERE has_date = 0"""
)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _order_cells(spark, sf_dir)
    return canonical.normalised(cells, columns.column_layouts(cells))[1]


_CODE = "CAST(CASE p_size % 4 WHEN 0 THEN 5411 WHEN 1 THEN 5812 ELSE p_size END AS VARCHAR)"


@query(
    f"""WITH r AS (SELECT p_partkey, {_CODE} AS code, lower(concat_ws(' ', p_brand, p_name)) AS low FROM part)
    SELECT p_partkey, coalesce(by_code, by_word, 'Others') AS category, CASE WHEN by_code IS NOT NULL THEN {rules.CONFIDENCE['code']}::DOUBLE WHEN by_word IS NOT NULL THEN {rules.CONFIDENCE['keyword']}::DOUBLE ELSE {rules.CONFIDENCE['default']}::DOUBLE END AS category_confidence
    FROM (SELECT p_partkey, CASE code {' '.join(f"WHEN '{n}' THEN '{c}'" for c, ns in rules.CATEGORY_CODES.items() for n in ns)} END AS by_code, {_KEYWORD_CASE} AS by_word FROM r)"""
)
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of merchants that come with a category code, which goes before keywords."""
    code = F.when(F.col("p_size") % 4 == 0, 5411).when(F.col("p_size") % 4 == 1, 5812).otherwise(F.col("p_size"))
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("merchant"), F.col("p_name").alias("description"), code.alias("code"))
    return canonical.with_categories(df, code_col="code").select("p_partkey", "category", "category_confidence")


@query(
    f"""WITH {_ORDER_ROWS}, c AS (SELECT path, row, CASE o_orderkey % 3 WHEN 0 THEN [o_orderpriority, o_orderstatus] WHEN 1 THEN [o_orderpriority, o_orderstatus, 'x', 'y'] ELSE [o_orderpriority, o_orderstatus, 'x'] END AS cells FROM o),
    h AS (SELECT *, first_value(cells) OVER (PARTITION BY path ORDER BY row) AS header FROM c),
    k AS (SELECT *, len(list_filter(range(1, least(len(cells), len(header)) + 1), lambda i: lower(cells[i]) = lower(header[i]))) AS same, len(header) AS w FROM h WHERE row > 0)
    SELECT path, row, array_to_string(CASE WHEN len(cells) > w THEN list_append(cells[1 : w - 1], array_to_string(cells[w:], ' ')) ELSE list_concat(cells, [x FOR x IN ['', '', '', ''][1 : w - len(cells)]]) END, '|') AS cells
    FROM k WHERE same < greatest(2, w // 2)"""
)
def joined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables cut over pages: repeated headers go, rows get the header's width."""
    o = _numbered_orders(spark, sf_dir)
    kind = F.col("o_orderkey") % 3
    first = [F.col("o_orderpriority"), F.col("o_orderstatus")]
    cells = F.when(kind == 0, F.array(*first)).when(kind == 1, F.array(*first, F.lit("x"), F.lit("y"))).otherwise(F.array(*first, F.lit("x")))
    rows = o.select("path", F.floor(F.col("row") / 4).cast("int").alias("page"), "row", cells.alias("cells"))
    return tables.joined_tables(rows).select("path", "row", F.array_join("cells", "|").alias("cells"))


@query(
    """WITH t AS (SELECT c_nationkey AS path, c_custkey AS tab, c_custkey % 40 AS n_rows, CASE c_custkey % 4 WHEN 0 THEN ['Date', 'Debit', 'Credit', 'Balance'] WHEN 1 THEN ['Account Summary', 'x'] WHEN 2 THEN ['a', 'b', 'c'] ELSE ['Value Date', 'Narration', 'Amount', 'Ref'] END AS header FROM customer),
    s AS (SELECT *, len(header) AS width, lower(array_to_string(header, ' ')) AS low FROM t),
    c AS (SELECT path, tab, width, 10 * n_rows + width + 100 * ("""
    + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in tables.TABLE_WORDS)
    + """) - CASE WHEN contains(low, 'account summary') OR contains(low, 'available balance') THEN 500 ELSE 0 END AS score FROM s),
    b AS (SELECT path, width FROM (SELECT path, width, row_number() OVER (PARTITION BY path ORDER BY sum(score) DESC, width DESC) AS k FROM c GROUP BY path, width) WHERE k = 1)
    SELECT path, tab, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY path ORDER BY score DESC, tab) AS rank FROM c JOIN b USING (path, width)"""
)
def best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables of their nation's file: the width of the best total score, ranked."""
    heads = [["Date", "Debit", "Credit", "Balance"], ["Account Summary", "x"], ["a", "b", "c"], ["Value Date", "Narration", "Amount", "Ref"]]
    header = F.get(F.array(*[F.array(*map(F.lit, h)) for h in heads]), (F.col("c_custkey") % 4).cast("int"))
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("path"), F.col("c_custkey").alias("table"), header.alias("header"), (F.col("c_custkey") % 40).alias("n_rows"))
    return tables.best_tables(t).select("path", F.col("table").alias("tab"), F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    """WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_returnflag = 'R' AS minus FROM lineitem), p AS (SELECT path, avg(CAST(minus AS INT)) AS share FROM c GROUP BY path)
    SELECT path, CASE WHEN CAST(path AS BIGINT) % 2 = 0 THEN 'Amount' ELSE 'Value' END AS header FROM p WHERE CAST(path AS BIGINT) % 2 = 0 OR share > 0.1"""
)
def signed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files with one column of amounts, signed where returned; half of them under a telling header."""
    li = table(spark, sf_dir, "lineitem")
    value = F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise(""), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    both = F.array(F.struct(F.lit(0).alias("pos"), F.lit("Kind").alias("header"), F.col("l_linestatus").alias("value")), F.struct(F.lit(1).alias("pos"), F.when(F.col("l_orderkey") % 2 == 0, "Amount").otherwise("Value").alias("header"), value.alias("value")))
    return columns.signed_amount_columns(li.select(F.col("l_orderkey").cast("string").alias("path"), F.explode(both).alias("c")).select("path", "c.*"))


@query(f"WITH {_ORDER_ROWS} SELECT path, CAST(row AS BIGINT) AS row, array_to_string([substr(o_orderpriority, 13, 4), substr(o_orderpriority, 9, 4), substr(o_orderpriority, 5, 4), substr(o_orderpriority, 1, 4)], '|') AS cells FROM o")
def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of scanned tokens, four a row of text and slightly off its line: put together in rows again."""
    o = _numbered_orders(spark, sf_dir)
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.lit(100.0) - i).alias("x"), (F.col("row") * 40.0 + (i % 2) * 5).alias("y"), F.substr(F.col("o_orderpriority"), i * 4 + 1, F.lit(4)).alias("text")))
    tokens = o.select("path", F.lit(1).alias("page"), F.explode(parts).alias("t")).select("path", "page", "t.*")
    return tables.token_rows(tokens).select("path", F.col("row").cast("long").alias("row"), F.array_join("cells", "|").alias("cells"))


@query(
    """WITH w AS (SELECT DISTINCT p_brand AS merchant FROM part), c AS (SELECT DISTINCT p_brand AS merchant FROM part WHERE p_size = 1) SELECT w.merchant, CASE WHEN c.merchant IS NOT NULL THEN '{}' END AS payload, CASE WHEN c.merchant IS NOT NULL THEN 'cache' ELSE 'queued' END AS source FROM w LEFT JOIN c USING (merchant)"""
)
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("merchant"), "p_size")
    cache = p.where("p_size = 1").select("merchant", F.lit("{}").alias("payload"), F.lit(True).alias("success")).distinct()
    return store.enrichment(p.select("merchant").distinct(), cache)


@query(
    """WITH q AS (SELECT DISTINCT p_brand AS merchant FROM part), r AS (SELECT merchant, CAST(right(merchant, 1) AS INT) % 3 AS k FROM q)
    SELECT merchant, CASE WHEN k = 1 THEN 2 ELSE 1 END AS attempts, CASE WHEN k = 1 THEN '500' ELSE 'old' END AS last_error FROM r WHERE k > 0"""
)
def after_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue after one round of look-ups: of three merchants one succeeds, one fails, one is not tried."""
    merchants = table(spark, sf_dir, "part").select(F.col("p_brand").alias("merchant")).distinct()
    k = F.substring("merchant", -1, 1).cast("int") % 3
    queue = merchants.select("merchant", F.lit(None).cast("timestamp").alias("queued_at"), F.lit(1).alias("attempts"), F.lit("old").alias("last_error"))
    results = merchants.where(k < 2).select("merchant", (k == 0).alias("success"), F.when(k == 1, "500").alias("error"))
    return store.after_drain(queue, results).select("merchant", "attempts", "last_error")


@query(
    """WITH o AS (SELECT o_custkey AS customer_id, max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS old, max(o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS new FROM orders GROUP BY o_custkey)
    SELECT customer_id, '{"last":' || coalesce(new, old) || '}' AS payload FROM o WHERE coalesce(new, old) IS NOT NULL"""
)
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles stored as JSON by customer: the newer version of a key replaces the older one."""
    o = table(spark, sf_dir, "orders")
    version = lambda d, n: o.where(F.col("o_orderkey") % d == 0).groupBy(F.col("o_custkey").alias("customer_id")).agg(F.max("o_orderkey").alias("last")).select("customer_id", F.to_json(F.struct("last")).alias("payload"), F.lit(n).alias("version"))
    return store.upserted(version(2, 1), version(3, 2), ["customer_id"], "version").select("customer_id", "payload")


@query(
    """WITH q AS (SELECT p_partkey, p_brand AS merchant, p_name AS description FROM part), k AS (SELECT *, sha256(lower(trim(merchant)) || chr(10) || lower(trim(description))) AS key FROM q),
    c AS (SELECT DISTINCT key FROM k WHERE p_partkey % 2 = 0) SELECT p_partkey, CASE WHEN c.key IS NOT NULL THEN 'Shopping' ELSE 'Travel' END AS category FROM k LEFT JOIN c USING (key)"""
)
def category_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories from a cache by key, the rest from an injected function, each distinct key asked once."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("merchant"), F.col("p_name").alias("description"))
    cache = store.category_keys(df.where("p_partkey % 2 = 0")).select("key", F.lit("Shopping").alias("category"), F.lit(0.9).alias("confidence")).distinct()
    return store.cached_categories(df, cache, lambda texts: [("Travel", 0.7) for _ in texts]).select("p_partkey", "category")


@query("WITH h AS (SELECT l_orderkey AS path, l_linenumber AS pos, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, CASE WHEN l_returnflag = 'N' THEN 'col' ELSE l_returnflag END AS base FROM lineitem) SELECT path, k AS pos, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '_' || (row_number() OVER w - 1) END AS uniq FROM h WINDOW w AS (PARTITION BY path, base ORDER BY k)")
def column_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    heads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), k.alias("pos"), F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("header"))
    return columns.unique_headers(heads).select("path", "pos", F.col("unique").alias("uniq"))


@query(f"{_WITH} SELECT customer_id, seq, strftime(date, '%d/%m/%Y') AS date, description, CAST(coalesce(debit, 0) AS VARCHAR) AS debit, CAST(coalesce(credit, 0) AS VARCHAR) AS credit, CAST(balance AS VARCHAR) AS balance FROM ledger")
def text_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows printed as statement lines and read again."""
    line = F.concat_ws(" ", F.date_format("date", "dd/MM/yyyy"), "description", F.coalesce("debit", F.lit(0).cast("decimal(18,2)")).cast("string"), F.coalesce("credit", F.lit(0).cast("decimal(18,2)")).cast("string"), F.col("balance").cast("string"))
    pages = ledger(spark, sf_dir).select(F.struct("customer_id", "seq").alias("path"), F.concat(F.lit("Statement of account\n"), line).alias("text"))
    return tables.text_lines(pages).select("path.customer_id", "path.seq", "date", "description", "debit", "credit", "balance")


@query(f"{_WITH} SELECT customer_id, seq, date, description FROM ledger WHERE category = 'Food' ORDER BY date DESC, sha256(concat_ws('~', customer_id, seq)) LIMIT 100 OFFSET 10")
def ledger_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.transactions(ledger(spark, sf_dir), category="Food", limit=100, offset=10).select("customer_id", "seq", "date", "description")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return store.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("SELECT DISTINCT p_brand AS merchant FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1) AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice < 901)")
def queue_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("merchant"), "p_size", "p_retailprice")
    cache = p.where("p_size = 1").select("merchant", F.lit("{}").alias("payload"), F.lit(True).alias("success")).distinct()
    return store.queue_additions(p, cache, p.where("p_retailprice < 901").select("merchant").distinct())


@query("SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS \"column\", (SELECT count(*) FROM nation) AS n_rows, unnest([(SELECT avg(n_nationkey) FROM nation), NULL, (SELECT avg(n_regionkey) FROM nation)]) AS mean")
def csv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.table_summary(table(spark, sf_dir, "nation"))


@query("SELECT a.vec_id AS id, round(min(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS distance FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label <> 0 GROUP BY a.vec_id")
def nearest_neighbour_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from each vector of label 0 to the nearest of the others."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    return synthetic.nearest(e.where("label = 0").select("id", "v"), e.where("label <> 0").select("v")).withColumn("distance", F.round("distance", 6))


@query(
    """WITH e AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b, min(c_nationkey) AS c, max(c_nationkey) AS d FROM customer),
    r AS (SELECT (c_acctbal - a) / (b - a) AS x, (c_nationkey - c) / CAST(d - c AS DOUBLE) AS y FROM customer, e), m AS (SELECT (s_acctbal - a) / (b - a) AS x, (s_nationkey - c) / CAST(d - c AS DOUBLE) AS y FROM supplier, e),
    n AS (SELECT m.x, m.y, min(sqrt((m.x - r.x) * (m.x - r.x) + (m.y - r.y) * (m.y - r.y))) AS d FROM m, r GROUP BY m.x, m.y)
    SELECT round(min(d), 6) AS min_distance, count(*) AS n, min(d) > 1e-6 AS passed FROM n"""
)
def privacy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as if they were made from customers: balance and nation scaled by the customers' ranges."""
    real = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("customer_id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return synthetic.privacy_check(real, made, ["balance", "nation"]).select(F.round("min_distance", 6).alias("min_distance"), "n", "passed")


@query(
    """WITH v AS (SELECT 'balance' AS "column", c_acctbal AS value, 0 AS side FROM customer UNION ALL SELECT 'balance', s_acctbal, 1 FROM supplier UNION ALL SELECT 'nation', c_nationkey, 0 FROM customer UNION ALL SELECT 'nation', s_nationkey, 1 FROM supplier),
    n AS (SELECT "column", CAST(value AS DOUBLE) AS value, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM v WHERE value IS NOT NULL GROUP BY ALL),
    r AS (SELECT "column", sum(a) OVER w AS x, sum(b) OVER w AS y, sum(a) OVER p AS m, sum(b) OVER p AS n FROM n WINDOW w AS (PARTITION BY "column" ORDER BY value), p AS (PARTITION BY "column"))
    SELECT "column", round(max(abs(x / CAST(m AS DOUBLE) - y / CAST(n AS DOUBLE))), 9) AS statistic FROM r GROUP BY "column" """
)
def two_sample_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov-Smirnov statistics of suppliers as if they were made from customers."""
    real = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    made = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return synthetic.distances(real, made, ["balance", "nation"]).select("column", F.round("statistic", 9).alias("statistic"))


@query(
    """WITH c AS (SELECT l_returnflag AS x, l_linenumber AS y, count(*) FILTER (WHERE l_orderkey % 2 = 0) AS a, count(*) FILTER (WHERE l_orderkey % 2 <> 0) AS b FROM lineitem GROUP BY ALL)
    SELECT round(1 - sum(abs(a / (SELECT CAST(sum(a) AS DOUBLE) FROM c) - b / (SELECT CAST(sum(b) AS DOUBLE) FROM c))) / 2, 9) AS similarity, count(*) AS pairs FROM c"""
)
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike line items of even and odd orders are in flag and number together."""
    li = table(spark, sf_dir, "lineitem")
    return synthetic.contingency(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 <> 0"), "l_returnflag", "l_linenumber").select(F.round("similarity", 9).alias("similarity"), "pairs")


@query()
def copula_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return synthetic.copula_samples(df, 1000)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY ALL", money="total")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.tumbling(table(spark, sf_dir, "events"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.sessions(table(spark, sf_dir, "events"))


@query(
    """WITH e AS (SELECT event_type, CAST(value AS DECIMAL(18,2)) AS value, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start FROM events, range(4) AS r(k) WHERE ts IS NOT NULL)
    SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n, CAST(sum(coalesce(value, 0)) AS DECIMAL(28,2)) AS total FROM e GROUP BY event_type, window_start""",
    money="total",
)
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = statements.sliding(table(spark, sf_dir, "events"))
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM customer GROUP BY c_mktsegment", money="total")
def sql_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM {customer} GROUP BY c_mktsegment", customer=table(spark, sf_dir, "customer"))
