"""A transaction ledger from the star schema: line items as transactions of the customer who ordered them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import MOST, scanned

MONEY = "decimal(18,2)"
MERCHANT_OF = {"ECONOMY": "Swiggy", "SMALL": "Netflix", "MEDIUM": "Amazon", "PROMO": "Landlord", "STANDARD": "Acme Corp"}
MODE_OF = {1: "UPI", 2: "NEFT", 3: "POS", 4: "ATM", 5: "IMPS", 6: "RTGS"}
CATEGORY_OF = {0: "Salary", 1: "Rent", 2: "Food", 3: "Investments", 4: "EMI", 5: "Loan", 6: "Shopping", 7: "ATM", 8: "Subscription"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(c, values: dict, kind: str = "string"):
    out = F.lit(None).cast(kind)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


#: Rows of a bucket of customers, of a task of a join at most, and for a cell of the counts that bound a customer's rows.
PART_ROWS, JOIN_ROWS, CELL_ROWS = 250_000, 4_000_000, 1024
#: Rows of a narrow table that is sent to every task instead.
SENT = 2_000_000
#: Stands for a line number that is null; no int is as large.
NO_NUMBER = 1 << 40


def together(spark: SparkSession, sf_dir: str) -> int | None:
    """Buckets of customers for tables in which every customer fits a task; None where one (or an order, or a part) has over ``scan.MOST`` rows and has to be spread.

    No customer has more rows than the largest number of orders of one times the largest number of rows of an order; both
    are bounded by counts of hashed keys, which are small. Only where that is too much rows are counted by customer.
    """
    li, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = li.count()
    if rows > MOST:
        cells = 1 << max(16, (rows // CELL_ROWS).bit_length())
        most = lambda df, key: df.groupBy(F.pmod(F.xxhash64(key), F.lit(cells))).count().agg(F.max("count")).first()[0] or 0
        of_order = most(li, "l_orderkey")
        if max(of_order, most(li, "l_partkey")) > MOST:
            return None
        if of_order * most(orders, "o_custkey") > MOST and li.join(orders, "l_orderkey").groupBy("o_custkey").count().where(F.col("count") > MOST).limit(1).count():
            return None
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def _met(lines: DataFrame, other: DataFrame, key: str, parts: int) -> DataFrame:
    """``lines`` with the row of ``other`` of their ``key``. What a task holds is its rows of ``other``; lines pass by and are not sorted.

    Spark puts 64 MB of a shuffle in a task, in so many tasks at most as the session says; more are asked for where these are too few.
    """
    tasks = parts * PART_ROWS // JOIN_ROWS
    if tasks > int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        lines, other = lines.repartition(tasks, key), other.repartition(tasks, key)
    return lines.join(other.hint("shuffle_hash"), key)


def _packed(number: Column, credit: Column) -> Column:
    """Line number and credit in one number, as a shuffle pays for each column; ``_part_code`` is added to it, ``_unpacked`` takes it apart. Unknown values have codes of their own."""
    return F.coalesce(number.cast("long"), F.lit(NO_NUMBER)) * 256 + F.coalesce(credit.cast("long"), F.lit(2))


def _part_code(kind: Column, size: Column) -> Column:
    """Merchant and category (by the last figure of the size) as they lie in the number of ``_packed``: its lowest byte, with the credit."""
    category = F.when(size.between(0, 8), size).otherwise(9)
    return (3 * F.coalesce(_case(kind, {k: i for i, k in enumerate(MERCHANT_OF)}, "int"), F.lit(len(MERCHANT_OF))) + 18 * category).cast("long")


def _unpacked(line: Column) -> dict[str, Column]:
    number, low = F.shiftright(line, 8), line.bitwiseAND(255).cast("int")
    credit, kind = low % 3, F.floor(low / 3).cast("int") % 6
    return {
        "l_linenumber": F.when(number != NO_NUMBER, number).cast("int"), "is_credit": F.when(credit < 2, credit == 1),
        "type": F.when(kind < len(MERCHANT_OF), kind), "size": F.floor(low / 18).cast("int"),
    }


def _lines(spark: SparkSession, sf_dir: str, parts: int | None) -> DataFrame:
    """Line items with customer and part in few bytes, as they cross three shuffles; texts are made of them by ``_worded``."""
    price = F.col("l_extendedprice").cast(MONEY).alias("price")
    line = _packed(F.col("l_linenumber"), F.col("l_returnflag") == "R").alias("line")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", price, line, F.col("l_shipdate").alias("date"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer_id"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), _part_code(F.col("p_type"), F.col("p_size") % 10).alias("code"))
    coded = lambda df: df.withColumn("line", F.col("line") + F.col("code")).drop("code")
    if parts is None:
        df = coded(li.join(orders, "l_orderkey").join(part, "l_partkey"))
    else:
        df = _met(li, orders, "l_orderkey", parts)
        df = df.join(F.broadcast(part), "l_partkey") if part.count() <= SENT else _met(df, part, "l_partkey", parts)
        df = coded(df).repartition(parts, "customer_id")
    return df.withColumns(_unpacked(F.col("line"))).drop("line")


def _worded(lines: DataFrame, *more) -> DataFrame:
    mode, merchant = _case(F.col("l_linenumber"), MODE_OF), _case(F.col("type"), dict(enumerate(MERCHANT_OF.values())))
    return lines.select(
        "customer_id", "date", F.concat_ws("/", mode, F.lit("DR"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.upper(merchant), F.lit("HDFC")).alias("description"),
        merchant.alias("merchant"), F.when(~F.col("is_credit"), F.col("price")).alias("debit"), F.when(F.col("is_credit"), F.col("price")).alias("credit"),
        _case(F.col("size"), CATEGORY_OF).alias("category"), mode.alias("payment_mode"), *more,
    )


def entries(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Ledger without balance and order: customer_id, date, description, merchant, debit, credit, category, payment_mode.

    Rows of a customer are in one of ``parts`` partitions, which are found if not given (see ``together``).
    """
    return _worded(_lines(spark, sf_dir, parts or together(spark, sf_dir)))


def ledger(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """``entries`` with seq (order within the customer), running balance and a deterministic transaction id.

    Without ``parts`` they are found. Months and days cut the rows of a customer with too many of them in slices, so none has to
    pass through one task.
    """
    parts = parts or together(spark, sf_dir)
    zero = F.lit(0).cast(MONEY)
    signed = F.coalesce(F.when(F.col("is_credit"), F.col("price")), zero) - F.coalesce(F.when(~F.col("is_credit"), F.col("price")), zero)
    slices = [F.date_trunc("month", "date"), F.date_trunc("day", "date")]
    order = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]
    df = scanned(_lines(spark, sf_dir, parts), ["customer_id"], order, slices, number="seq", sums={"balance": signed}, small=parts is not None)
    df = _worded(df, "seq", F.col("balance").cast(MONEY).alias("balance"))
    return df.withColumn("transaction_id", F.sha2(F.concat_ws("~", "customer_id", "seq"), 256))


def _sql_case(c: str, values: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in values.items()) + " END"


#: The same ledger in ANSI SQL, as a common table expression ``ledger``.
LEDGER_SQL = f"""
    e AS (
      SELECT o_custkey AS customer_id, l_shipdate AS date, {_sql_case("l_linenumber", MODE_OF)} AS payment_mode, {_sql_case("p_type", MERCHANT_OF)} AS merchant,
             CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS debit,
             CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS credit,
             {_sql_case("p_size % 10", CATEGORY_OF)} AS category, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS price
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    ), ledger AS (
      SELECT customer_id, date, concat_ws('/', payment_mode, 'DR', lpad(CAST(l_orderkey AS VARCHAR), 9, '0'), upper(merchant), 'HDFC') AS description,
             merchant, debit, credit, category, payment_mode,
             row_number() OVER w AS seq, CAST(sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance
      FROM e WINDOW w AS (PARTITION BY customer_id ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey, price)
    )
"""
