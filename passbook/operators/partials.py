"""Mergeable sums of a ledger: what behaviour, recurring payments, profile and feature row are worked out from.

``partials`` turns transactions into five tables; ``merged`` puts those of two sets of transactions together, and gives
the same as ``partials`` of both sets at once, however they were divided. So a stored set can take in new transactions
without the old ones. Every table is one aggregate, combined before its shuffle:

* ``totals``: a row a customer, exact sums, counts and extremes
* ``months``: a row a customer and month, net flow and the last balance
* ``names``: how often each merchant, category and payment mode occurs
* ``amounts``: how often each debit and credit over 0 occurs
* ``payments``: a row for each customer, merchant, direction, amount and time, with the kinds of payment its words name

Input columns are those of ``behaviour``. Null debit and credit count as 0, null balances are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that name a kind of payment, in order (fixed values).
KINDS = {
    "Rent": ["rent", "landlord", "nobroker"],
    "EMI": ["emi", "installment", "instalment"],
    "Insurance": ["insurance", "premium", "lic", "policy"],
    "SIP": ["sip", "mutual", "groww", "zerodha", "upstox", "nps"],
    "Subscription": ["netflix", "spotify", "prime", "subscription", "hotstar"],
    "Loan Repayment": ["loan", "repayment", "disbursement"],
    "Utility": ["electricity", "water", "gas", "broadband", "bill", "recharge"],
}
INVESTMENTS, EMI, DEBT = ["Investments"], ["EMI"], ["Loan", "EMI"]
NAMES = ("merchant", "category", "payment_mode")
PAYMENT = ["customer_id", "merchant", "direction"]

_TOTALS = {
    "n_transactions": "sum", "first_date": "min", "last_date": "max", "incoming_total": "sum", "outgoing_total": "sum", "weekend_spend": "sum", "investment_spend": "sum", "emi_spend": "sum", "debt_spend": "sum",
    "balances": "sum", "balance_low": "min", "balance_high": "max", "balance_sum": "sum", "spent_n": "sum", "spent_sum": "sum", "spent_squares": "sum",
}
#: Name -> (key, column -> how two rows of a key become one).
PARTS: dict[str, tuple[list[str], dict[str, str]]] = {
    "totals": (["customer_id"], _TOTALS),
    "months": (["customer_id", "month"], {"net": "sum", "last": "max"}),
    "names": (["customer_id", "kind", "name"], {"n": "sum"}),
    "amounts": (["customer_id", "side", "amount"], {"n": "sum"}),
    "payments": ([*PAYMENT, "amount", "date"], {"n": "sum", "kinds": "bit_or"}),
}


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)"))


def _one(how: str, c: str, kind: str) -> Column:
    return F.expr(f"{how}(`{c}`)").cast(kind).alias(c)


def _rows(ledger: DataFrame) -> dict[str, DataFrame]:
    """Each table before its aggregate: a row for each transaction that takes part."""
    debit, credit = zero("debit"), zero("credit")
    spent = lambda names: F.when(F.col("category").isin(*names), debit)
    over = F.when(F.col("debit") > 0, F.col("debit"))
    one, money = F.lit(1).cast("long"), "decimal(28,2)"
    totals = {
        "n_transactions": one, "first_date": F.col("date"), "last_date": F.col("date"), "incoming_total": credit.cast(money), "outgoing_total": debit.cast(money), "weekend_spend": F.when(F.weekday("date") >= 5, debit).cast(money),
        "investment_spend": spent(INVESTMENTS).cast(money), "emi_spend": spent(EMI).cast(money), "debt_spend": spent(DEBT).cast(money), "balances": F.col("balance").isNotNull().cast("long"), "balance_low": F.col("balance"),
        "balance_high": F.col("balance"), "balance_sum": F.col("balance").cast(money), "spent_n": over.isNotNull().cast("long"), "spent_sum": over.cast(money), "spent_squares": (over * over).cast("decimal(38,4)"),
    }
    held = F.when(F.col("balance").isNotNull(), F.struct("date", "seq", "balance"))
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in NAMES])
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).cast("decimal(18,2)").alias("amount")) for s in ("debit", "credit")])
    return {
        "totals": ledger.select("customer_id", *[c.alias(n) for n, c in totals.items()]),
        "months": ledger.select("customer_id", F.date_trunc("month", "date").alias("month"), (credit - debit).cast("decimal(18,2)").alias("net"), held.alias("last")),
        "names": ledger.select("customer_id", F.explode(named).alias("f")).where(F.coalesce("f.name", F.lit("")) != "").select("customer_id", "f.*", one.alias("n")),
        "amounts": ledger.select("customer_id", F.explode(sides).alias("s")).where("s.amount > 0").select("customer_id", "s.*", one.alias("n")),
        "payments": payment_rows(ledger),
    }


def _low(c: str) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def with_kinds(ledger: DataFrame) -> DataFrame:
    """``ledger`` with the kinds of payment that its words name in ``_kinds``, if they are not there yet; then it needs no description."""
    if "_kinds" in ledger.columns:
        return ledger
    any_of = lambda ws: reduce(Column.__or__, [F.contains("_words", F.lit(w)) for w in ws])
    kinds = reduce(Column.bitwiseOR, [F.when(any_of(ws), F.lit(1 << k)).otherwise(0) for k, ws in enumerate(KINDS.values())])
    return ledger.withColumn("_words", F.concat_ws("\n", _low("merchant"), _low("description"))).withColumn("_kinds", kinds).drop("_words")


def payment_rows(ledger: DataFrame) -> DataFrame:
    """Rows of ``payments``: those with a merchant and an amount; bit k of ``kinds`` is the k-th of ``KINDS``."""
    credit, debit = F.coalesce("credit", F.lit(0)), F.coalesce("debit", F.lit(0))
    named = with_kinds(ledger.where(_low("merchant") != ""))
    df = named.select(
        "customer_id", _low("merchant").alias("merchant"), F.when(credit > 0, "credit").otherwise("debit").alias("direction"), F.when(credit > 0, credit).otherwise(debit).cast("decimal(18,2)").alias("amount"), "date",
        F.lit(1).cast("long").alias("n"), F.col("_kinds").alias("kinds"),
    )
    return df.where(F.col("amount") != 0)


def combined(rows: DataFrame, part: str) -> DataFrame:
    key, how = PARTS[part]
    kinds = dict(rows.dtypes)
    return rows.groupBy(*key).agg(*[_one(h, c, kinds[c]) for c, h in how.items()])


def partials(ledger: DataFrame, only: tuple[str, ...] = tuple(PARTS)) -> dict[str, DataFrame]:
    return {part: combined(rows, part) for part, rows in _rows(ledger).items() if part in only}


def merged(*sets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of all transactions behind ``sets``."""
    return {part: combined(reduce(DataFrame.unionByName, [s[part] for s in sets]), part) for part in sets[0]}
