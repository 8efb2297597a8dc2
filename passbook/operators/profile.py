"""Financial profile and feature row of each customer, from behaviour and recurring payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.stats import double, ratio
from . import behaviour
from .partials import partials, with_kinds
from .recurring import ranked, recurring_of
from .scratch import laid

TOP = 5
# Categories and payment modes with a column of their own.
SHARES = ["Food", "Groceries", "Shopping", "Healthcare", "Travel", "Entertainment", "Utilities", "Investments", "Rent", "Education", "Insurance", "Transfers", "Telecom", "Fuel"]
ONLINE, OFFLINE = ["UPI", "NEFT", "IMPS", "RTGS"], ["ATM", "POS"]
# The columns of a feature row, in order.
FEATURES = [
    "customer_id", "avg_income", "income_consistency", "avg_monthly_spend", "avg_monthly_saving", "savings_rate", "investment_ratio", "emi_ratio", "debt_ratio", "expense_ratio",
    "balance_min", "balance_max", "balance_mean", "balance_monthly_trend", "txn_size_mean", "txn_size_median", "txn_size_variance", "credit_frequency", "debit_frequency",
    "upi_frequency", "atm_frequency", "online_spend_ratio", "merchant_diversity", "subscription_count", "cashflow_volatility",
    *[f"pct_{c.lower()}" for c in SHARES], *[f"freq_{m.lower()}" for m in rules.KNOWN_SHARES],
]


def _paid(found: DataFrame, *more) -> DataFrame:
    """Of the recurring items of each customer: the surest salary, its confidence, the number of subscriptions, and ``more``."""
    salary = F.col("category") == "Salary"
    order = F.when(salary, F.struct(F.col("confidence"), F.col("occurrences"), -F.col("cluster")))
    sure = [F.max_by("median_amount", order).alias("sure"), F.max(F.when(salary, F.col("confidence"))).alias("stability")]
    return found.groupBy("customer_id").agg(*sure, F.count_if(F.col("category") == "Subscription").alias("subscriptions"), *more)


def _income() -> dict:
    """Income and its stability: the surest recurring salary, else the detected one (stability 0.5)."""
    return {"income": F.coalesce("sure", "salary_amount"), "income_stability": F.coalesce("stability", F.when(F.col("salary_amount").isNotNull(), F.lit(0.5)))}


def income(found: DataFrame, salaries: DataFrame) -> DataFrame:
    """(customer_id, income, income_stability) of customers with a recurring or detected salary."""
    both = _paid(found).join(salaries, "customer_id", "full").withColumns(_income())
    return both.where("income IS NOT NULL").select("customer_id", "income", "income_stability")


def top_names(ledger: DataFrame, column: str, most: int = TOP) -> DataFrame:
    """(customer_id, rank, name, n): the commonest names, ties by name."""
    w = Window.partitionBy("customer_id").orderBy(F.desc("n"), "name")
    return behaviour.frequencies(ledger, column).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def category_shares(ledger: DataFrame) -> DataFrame:
    """(customer_id, category, share): share of the customer's rows with a category, by count."""
    f = behaviour.frequencies(ledger, "category")
    total = f.groupBy("customer_id").agg(F.sum("n").alias("total"))
    return f.join(total, "customer_id").select("customer_id", F.col("name").alias("category"), ratio(F.col("n"), F.col("total")).alias("share"))


def narrow(ledger: DataFrame, together: int | None = None, *, payments: bool = True) -> DataFrame:
    """What the sums need of ``ledger`` (those of ``payments`` need kinds), written once, in ``together`` buckets of customers if given."""
    columns = ["customer_id", "date", "seq", "merchant", "debit", "credit", "balance", "category", "payment_mode"]
    df = with_kinds(ledger) if payments else ledger.withColumn("_kinds", F.lit(None).cast("int"))
    return laid(df.select(*columns, "_kinds"), "ledger", "customer_id", together)


def _parts(ledger: DataFrame, together: int | None) -> dict[str, DataFrame]:
    """The mergeable sums of ``ledger``; those that are asked for several times are written once, as is the narrow ledger."""
    return {name: laid(part, name, "customer_id", together) if name in ("amounts", "payments") else part for name, part in partials(narrow(ledger, together)).items()}


def _items(payments: DataFrame, together: int | None) -> DataFrame:
    """``recurring_of``, few rows; they go to the ``together`` buckets of customers if given, else Spark moves all that lies there to them."""
    found = recurring_of(payments, together)
    return found.repartition(together, "customer_id") if together else found


def profiles(ledger: DataFrame, together: int | None = None) -> DataFrame:
    """One row a customer: income, spend, saving, ratios, preferred names and the expected cash flow as a struct.

    ``together`` is a number of buckets of customers, for ledgers of which every customer fits a task: rows then move once.
    """
    return profiles_of(_parts(ledger, together), together)


def profiles_of(parts: dict[str, DataFrame], together: int | None = None) -> DataFrame:
    """``profiles`` from mergeable sums (see ``partials``), which lie in ``together`` buckets of customers if given."""
    item = F.struct("rank", "merchant", "direction", "category", "cadence", "median_amount", "amount_tolerance", "occurrences", "confidence")
    items = F.array_sort(F.collect_list(item)).alias("items")
    of = lambda kind: F.col("kind") == kind
    rank = F.row_number().over(Window.partitionBy("customer_id", "kind").orderBy(F.desc("n"), "name"))
    total = F.sum("n").over(Window.partitionBy("customer_id", "kind"))
    names = parts["names"].withColumns({"rank": rank, "share": ratio(F.col("n"), total)})
    # ``TOP`` elements at most, and one for each category.
    top = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(of(kind) & (F.col("rank") <= TOP), F.struct("rank", "name")))), lambda r: r["name"])
    lists = names.groupBy("customer_id").agg(
        top("merchant").alias("preferred_merchants"), top("payment_mode").alias("preferred_payment_modes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(of("category"), F.struct(F.col("name").alias("category"), "share"))))).alias("shares"),
    )
    df = behaviour.summary_of(parts).join(_paid(ranked(_items(parts["payments"], together)), items), "customer_id", "left").withColumns(_income()).join(lists, "customer_id", "left")
    flow = F.struct(
        F.coalesce("income", F.lit(0.0)).alias("expected_income"), F.col("monthly_spend").alias("expected_spend"), F.col("monthly_saving").alias("expected_saving"), "net_cashflow",
        F.col("shares").alias("spend_by_category"), "cashflow_volatility", F.col("items").alias("recurring"), F.coalesce("subscriptions", F.lit(0)).alias("subscription_count"), "balance_mean", "months_covered",
    )
    return df.select("customer_id", "income", "income_stability", "monthly_spend", "monthly_saving", "savings_ratio", "investment_ratio", "debt_ratio", "expense_ratio", "preferred_merchants", "preferred_payment_modes", flow.alias("expected_cashflow"))


def feature_table(ledger: DataFrame, together: int | None = None) -> DataFrame:
    """The feature row: exactly the columns ``FEATURES``, nulls as 0. ``together`` as in ``profiles``."""
    return features_of(_parts(ledger, together), together)


def features_of(parts: dict[str, DataFrame], together: int | None = None) -> DataFrame:
    """``feature_table`` from mergeable sums (see ``partials``), which lie in ``together`` buckets of customers if given."""
    total = lambda kind, *names: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("name").isin(*names) if names else F.lit(True)), F.col("n"))), F.lit(0))
    mode = lambda *names: total("payment_mode", *names)
    counts = [
        total("category", "Salary").alias("salaries"), total("category").alias("with_category"), total("payment_mode").alias("with_mode"), mode(*ONLINE).alias("online"), mode(*ONLINE, *OFFLINE).alias("known"),
        *[total("category", c).alias(f"c_{c}") for c in SHARES], *[mode(m).alias(f"m_{m}") for m in rules.KNOWN_SHARES],
    ]
    df = behaviour.summary_of(parts, *counts).join(_paid(_items(parts["payments"], together)), "customer_id", "left").withColumns(_income())
    df = df.withColumn("salaries", F.coalesce("salaries", F.lit(0)))
    n, zero = F.col("n_transactions"), F.lit(0.0)
    values = {
        "avg_income": F.col("income"), "income_consistency": F.col("income_stability"), "avg_monthly_spend": F.col("monthly_spend"), "avg_monthly_saving": F.col("monthly_saving"),
        "savings_rate": F.col("savings_ratio"), "credit_frequency": ratio(F.col("salaries"), n), "debit_frequency": ratio(n - F.col("salaries"), n), "upi_frequency": ratio(F.col("m_UPI"), n),
        "atm_frequency": ratio(F.col("m_ATM"), n), "online_spend_ratio": ratio(F.col("online"), F.col("known")), "merchant_diversity": ratio(F.col("n_merchants"), n), "subscription_count": double(F.col("subscriptions")),
    } | {f"pct_{c.lower()}": ratio(F.col(f"c_{c}"), F.col("with_category")) for c in SHARES} | {f"freq_{m.lower()}": ratio(F.col(f"m_{m}"), F.col("with_mode")) for m in rules.KNOWN_SHARES}
    return df.select("customer_id", *[F.coalesce(values.get(c, F.col(c)), zero).alias(c) for c in FEATURES[1:]])
