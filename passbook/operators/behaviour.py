"""Behaviour of customers from their transactions: one row a customer, for all customers at once.

All of it is worked out from the mergeable sums of ``partials``; nothing sorts or collects a customer's rows.

Input columns: customer_id, date (timestamp_ntz), seq (order among equal dates), merchant, debit, credit, balance
(decimals, nullable), category, payment_mode. Null debit and credit count as 0, a null balance is left out, blank or
null names are left out of frequencies. Totals are exact decimals; each ratio is one division, 0 where the
denominator is not positive. Customers without transactions have no row; ``with_customers`` adds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import double, ratio, slope, variance
from .partials import partials
from .quantiles import counted, quantiles


def _one_part(ledger: DataFrame, part: str) -> DataFrame:
    """One table of ``partials``; columns that it does not need may be missing."""
    missing = {c: F.lit(None).cast(t) for c, t in (("balance", "decimal(18,2)"), ("seq", "long"), ("description", "string")) if c not in ledger.columns}
    return partials(ledger.withColumns(missing), (part,))[part]


def _totals(df: DataFrame, *more: str) -> DataFrame:
    """Span, totals and ratios from the sums of each customer, beside the columns ``more``."""
    money = ("incoming_total", "outgoing_total", "weekend_spend", "investment_spend", "emi_spend", "debt_spend")
    df = df.withColumns({c: F.coalesce(c, F.lit(0)).cast("decimal(28,2)") for c in money})
    df = df.withColumn("days_covered", F.greatest(F.expr("timestampdiff(DAY, first_date, last_date)"), F.lit(0)).cast("long"))
    months = F.greatest(double(F.col("days_covered")) / 30.0, F.lit(1.0) / 30.0)
    weeks = F.greatest(double(F.col("days_covered")) / 7.0, F.lit(1.0) / 7.0)
    incoming, outgoing = F.col("incoming_total"), F.col("outgoing_total")
    net = (incoming - outgoing).cast("decimal(28,2)")
    return df.select(
        "customer_id", "n_transactions", "first_date", "last_date", "days_covered", months.alias("months_covered"), incoming, outgoing, net.alias("net_cashflow"),
        (double(outgoing) / months).alias("monthly_spend"), (double(outgoing) / weeks).alias("weekly_spend"), (double(net) / months).alias("monthly_saving"),
        ratio(F.col("weekend_spend"), outgoing).alias("weekend_spend_ratio"), "investment_spend", "emi_spend", "debt_spend",
        ratio(net, incoming).alias("savings_ratio"), ratio(F.col("investment_spend"), incoming).alias("investment_ratio"), ratio(F.col("emi_spend"), incoming).alias("emi_ratio"),
        ratio(F.col("debt_spend"), incoming).alias("debt_ratio"), ratio(outgoing, incoming).alias("expense_ratio"), *more,
    )


def totals(ledger: DataFrame) -> DataFrame:
    """Span, totals, spend by kind and ratios of each customer; sums are combined before the one shuffle."""
    return _totals(_one_part(ledger, "totals"))


def _balance_columns() -> dict[str, Column]:
    mean = F.when(F.col("balances") > 0, double(F.col("balance_sum")) / double(F.col("balances")))
    return {"balance_min": double(F.col("balance_low")), "balance_max": double(F.col("balance_high")), "balance_mean": mean}


def balance_stats(ledger: DataFrame) -> DataFrame:
    """Least, greatest and mean balance over the rows that have one."""
    return _one_part(ledger, "totals").select("customer_id", *[c.alias(n) for n, c in _balance_columns().items()])


def _point_sums(x: Column, y: Column) -> list[Column]:
    """Exact sums of a line through points; null points are left out."""
    x = F.when(y.isNotNull(), x).cast("decimal(12,0)")
    return [F.count(y), F.sum(x), F.sum(y), F.sum((x * x).cast("decimal(24,0)")), F.sum((x * y).cast("decimal(30,2)"))]


def _slopes(points: DataFrame, name: str) -> DataFrame:
    """Slope of y over x (integers) for each customer, from exact sums."""
    return points.groupBy("customer_id").agg(slope(*_point_sums(F.col("x"), F.col("y"))).alias(name))


def daily_trend(ledger: DataFrame) -> DataFrame:
    """Slope of the balance on whole days since the customer's first row with a balance; 0 if it has no slope.

    Sums are made by customer and time of day first: whole days since the first row are days since 1970 less a number that is
    the same for all rows of one time of day. So no row has to meet the first one.
    """
    days = lambda c: F.datediff(c.cast("date"), F.lit("1970-01-01"))
    clock = F.expr("timestampdiff(MICROSECOND, date_trunc('day', date), date)")
    held = ledger.where(F.col("balance").isNotNull()).select("customer_id", "date", "balance", days(F.col("date")).cast("decimal(12,0)").alias("day"), clock.alias("clock"))
    n, s, y, ss, sy = _point_sums(F.col("day"), F.col("balance"))
    part = held.groupBy("customer_id", "clock").agg(F.min("date").alias("first"), n.alias("n"), s.alias("s"), y.alias("y"), ss.alias("ss"), sy.alias("sy"))
    first = F.min(F.struct("first", F.col("clock").alias("at"))).over(Window.partitionBy("customer_id"))  # a row for each time of day
    part = part.withColumn("f", first)
    off = (days(F.col("f.first")) + (F.col("clock") < F.col("f.at")).cast("int")).cast("decimal(12,0)")
    n, s, y, ss, sy = (F.col(c) for c in ("n", "s", "y", "ss", "sy"))
    moved = [n, s - off * n, y, ss - 2 * off * s + off * off * n, sy - off * y]
    sums = [F.sum(c.cast(k)) for c, k in zip(moved, ("long", "decimal(24,0)", "decimal(28,2)", "decimal(38,0)", "decimal(38,2)"))]
    return part.groupBy("customer_id").agg(slope(*sums).alias("balance_daily_trend"))


def period_trend(ledger: DataFrame, period: str) -> DataFrame:
    """Slope of each period's last balance over the periods that have one, numbered without gaps."""
    held = ledger.where(F.col("balance").isNotNull())
    last = held.groupBy("customer_id", F.date_trunc(period, "date").alias("period")).agg(F.max_by("balance", F.struct("date", "seq")).alias("y"))
    x = F.row_number().over(Window.partitionBy("customer_id").orderBy("period")) - 1
    return _slopes(last.select("customer_id", x.alias("x"), "y"), f"balance_{period}ly_trend")


def _size_columns() -> dict[str, Column]:
    n, total, squares = F.col("spent_n"), F.col("spent_sum"), F.col("spent_squares")
    return {"txn_size_mean": F.when(n > 0, double(total) / double(n)), "txn_size_variance": variance(n, total, squares)}


def _size_median(amounts: DataFrame) -> DataFrame:
    return quantiles(amounts.where("side = 'debit'"), ["customer_id"], "amount", {"txn_size_median": 0.5})


def size_stats(ledger: DataFrame) -> DataFrame:
    """Mean, median and population variance of debits over 0."""
    spent = ledger.where("debit > 0")
    sums = _one_part(spent, "totals").select("customer_id", *[c.alias(n) for n, c in _size_columns().items()])
    return sums.join(quantiles(counted(spent, ["customer_id"], "debit"), ["customer_id"], "debit", {"txn_size_median": 0.5}), "customer_id")


def frequencies(ledger: DataFrame, column: str) -> DataFrame:
    """(customer_id, name, n): how often each name that is not blank occurs."""
    return ledger.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("customer_id", F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def all_frequencies(ledger: DataFrame) -> DataFrame:
    """(customer_id, kind, name, n) for merchant, category and payment_mode from one scan and one shuffle."""
    return _one_part(ledger, "names").select("customer_id", "kind", "name", "n")


def loyalty(ledger: DataFrame) -> DataFrame:
    """Share of the commonest merchant among rows with a merchant."""
    return frequencies(ledger, "merchant").groupBy("customer_id").agg(ratio(F.max("n"), F.sum("n")).alias("merchant_loyalty"))


def _volatility(net: Column, month: Column) -> Column:
    """Absolute coefficient of variation of the months' net flow, months without rows as 0.

    Such months add nothing to the sums, so only their number is needed and no calendar is generated.
    """
    number = F.year(month) * 12 + F.month(month)
    n, total, squares = F.max(number) - F.min(number) + 1, F.sum(net), F.sum((net * net).cast("decimal(38,4)"))
    mean = double(total) / double(n)
    return F.when((n >= 2) & (mean != 0), F.abs(F.sqrt(variance(n, total, squares)) / mean)).otherwise(F.lit(0.0))


def volatility(ledger: DataFrame) -> DataFrame:
    """Absolute coefficient of variation of monthly net flow from first to last month, empty months as 0."""
    return _one_part(ledger, "months").groupBy("customer_id").agg(_volatility(F.col("net"), F.col("month")).alias("cashflow_volatility"))


def salaries(ledger: DataFrame) -> DataFrame:
    """(customer_id, salary_amount) where large credits repeat: median of the commonest thousand among the top quarter."""
    return salaries_of(counted(ledger.where("credit > 0"), ["customer_id"], "credit").withColumnRenamed("credit", "amount"))


def salaries_of(credits: DataFrame) -> DataFrame:
    """``salaries`` from how often each credit occurs: (customer_id, amount, n)."""
    top = quantiles(credits, ["customer_id"], "amount", {"q": 0.75})
    large = credits.join(top, "customer_id").where(double(F.col("amount")) >= F.col("q"))
    large = large.select("customer_id", "amount", "n", F.bround((F.col("amount") / 1000).cast("decimal(24,8)"), 0).cast("long").alias("bucket"))
    buckets = large.groupBy("customer_id", "bucket").agg(F.sum("n").alias("n"))
    best = buckets.groupBy("customer_id").agg(F.max_by("bucket", F.struct(F.col("n"), -F.col("bucket"))).alias("bucket"), F.max("n").alias("most")).where("most >= 2")
    # As equality the bucket would be a key of the join, for which Spark moves rows that lie by customer.
    chosen = large.join(best.select("customer_id", F.col("bucket").alias("_best")), "customer_id").where(F.col("bucket").between(F.col("_best"), F.col("_best"))).drop("_best")
    return quantiles(chosen, ["customer_id"], "amount", {"salary_amount": 0.5}, most=None)  # cents of a thousand


def period_stats(ledger: DataFrame) -> DataFrame:
    """(customer_id, balance_monthly_trend, balance_quarterly_trend, cashflow_volatility) from one roll-up by month."""
    return period_stats_of(_one_part(ledger, "months"))


def period_stats_of(months: DataFrame) -> DataFrame:
    monthly = months.select("customer_id", "month", "net", F.col("last.balance").alias("y"))
    by_month = Window.partitionBy("customer_id").orderBy("month")
    held = F.when(F.col("y").isNotNull(), F.date_trunc("quarter", "month"))
    after = F.first(held, ignorenulls=True).over(by_month.rowsBetween(1, Window.unboundedFollowing))
    # The last month with a balance stands for its quarter.
    closes = F.when(F.col("y").isNotNull() & (after.isNull() | (after != F.date_trunc("quarter", "month"))), F.col("y"))
    df = monthly.select("*", closes.alias("q")).select("*", (F.count("y").over(by_month) - 1).alias("x"), (F.count("q").over(by_month) - 1).alias("qx"))
    return df.groupBy("customer_id").agg(
        slope(*_point_sums(F.col("x"), F.col("y"))).alias("balance_monthly_trend"), slope(*_point_sums(F.col("qx"), F.col("q"))).alias("balance_quarterly_trend"),
        _volatility(F.col("net"), F.col("month")).alias("cashflow_volatility"),
    )


def summary(ledger: DataFrame) -> DataFrame:
    """Everything above in one row a customer."""
    out = summary_of(partials(ledger)).join(daily_trend(ledger), "customer_id", "left")
    return out.withColumn("balance_daily_trend", F.coalesce("balance_daily_trend", F.lit(0.0)))


def summary_of(parts: dict[str, DataFrame], *more: Column) -> DataFrame:
    """Everything above, but for the daily trend, from mergeable sums; ``more`` are aggregates (named) over a customer's ``names``."""
    sizes, held = _size_columns(), _balance_columns()
    out = _totals(parts["totals"].withColumns(sizes | held), *sizes, *held)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("n"))
    merchants = of("merchant")
    names = parts["names"].groupBy("customer_id").agg(ratio(F.max(merchants), F.sum(merchants)).alias("merchant_loyalty"), F.count(merchants).alias("n_merchants"), *more)
    for part in (period_stats_of(parts["months"]), names, salaries_of(parts["amounts"].where("side = 'credit'")), _size_median(parts["amounts"])):
        out = out.join(part, "customer_id", "left")
    none = ["balance_monthly_trend", "balance_quarterly_trend", "txn_size_mean", "txn_size_median", "txn_size_variance", "merchant_loyalty", "cashflow_volatility"]
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in none} | {"n_merchants": F.coalesce("n_merchants", F.lit(0)), "salary_detected": F.col("salary_amount").isNotNull()})


def with_customers(found: DataFrame, customers: DataFrame) -> DataFrame:
    """A row for each customer of ``customers``; those without transactions have 0 in totals, ratios, trends and counts.

    Dates, the balance's least, greatest and mean, and a salary stay null, as there is none.
    """
    none = {"first_date", "last_date", "balance_min", "balance_max", "balance_mean", "salary_amount"}
    out = customers.select("customer_id").distinct().join(found, "customer_id", "left")
    kinds = {c: t for c, t in found.dtypes if c != "customer_id" and c not in none}
    empty = {c: F.lit(False) if t == "boolean" else F.lit(0).cast(t) for c, t in kinds.items() if t in ("boolean", "int", "bigint", "double") or t.startswith("decimal")}
    return out.withColumns({c: F.coalesce(c, v) for c, v in empty.items()})
