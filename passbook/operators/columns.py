"""Which column of a raw table holds what: scans over long ``cells`` tables, then a small assignment by header.

``cells`` has (path, row, pos, header, value), all files in one table whatever their headers. The scans are grouped
aggregates over all files; only the headers of a file (dozens at most) are assigned by a sequential rule, per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.similarity import token_sort
from .scratch import written

# Fields in the order of assignment, confidence of what a column's values show, rows looked at, dates.
FIELDS = ["date", "description", "debit", "credit", "balance", "reference_number", "amount"]
INFERRED = {"date": 0.75, "balance": 0.70, "debit": 0.65, "credit": 0.65, "amount": 0.65}
SEEN, SEEN_BALANCE, LEAST = 20, 30, 3
COLUMNS = "array<struct<pos:int,field:string,source_column:string,confidence:double,method:string>>"
_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}"


def header_name(c):
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def column_tests(cells: DataFrame) -> DataFrame:
    """(path, pos, header, is_date, is_amount, is_balance) by the first rows of each column."""
    key = ["path", "pos", "header"]
    value = F.coalesce("value", F.lit(""))
    # What has neither slash nor dash is no date.
    number = text.number(F.translate(F.trim(value), ",", ""), "decimal(38,10)")
    date = (F.contains(value, F.lit("/")) | F.contains(value, F.lit("-"))) & value.rlike(_DATE)
    df = cells.where(F.col("row") < SEEN_BALANCE).select(*key, "row", number.alias("number"), date.alias("date"))
    seen = F.col("row") < SEEN
    before = F.last("number", ignorenulls=True).over(Window.partitionBy(*key).orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("moves", F.when(F.col("number").isNotNull() & before.isNotNull(), (F.abs(F.col("number") - before) > 0).cast("int")))
    df = df.groupBy(*key).agg(
        F.count_if(seen).alias("n"), F.count_if(seen & F.col("date")).alias("dates"), F.count_if(seen & F.col("number").isNotNull()).alias("numbers"),
        F.count("number").alias("all_numbers"), F.count("moves").alias("steps"), F.coalesce(F.sum("moves"), F.lit(0)).alias("moves"),
    )
    least = F.greatest(F.lit(LEAST), F.floor(F.col("n") / 3))
    amount = F.col("numbers") >= least
    balance = amount & (F.col("all_numbers") >= LEAST) & (F.col("moves") >= F.floor(F.col("steps") / 2))
    return df.select(*key, (F.col("dates") >= least).alias("is_date"), amount.alias("is_amount"), balance.alias("is_balance"))


def column_layouts(cells: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, columns): the mapping of a file as an array of (pos, field, source_column, confidence, method).

    Files whose columns have equal places, headers and tests get the same mapping, so each such layout is assigned once.
    """
    names = names or rules.COLUMN_NAMES
    tests = column_tests(cells).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "header", "is_date", "is_amount", "is_balance"))).alias("tests"))
    tests = written(tests.withColumn("layout", F.to_json("tests", {"ignoreNullFields": "false"})), "tests")

    def assign(batches):
        import pandas as pd

        for df in batches:
            yield pd.DataFrame([(layout, _assigned(columns, names)) for layout, columns in zip(df["layout"], df["columns"])], columns=["layout", "columns"])

    layouts = tests.groupBy("layout").agg(F.first("tests").alias("columns")).mapInPandas(assign, f"layout string, columns {COLUMNS}")
    return tests.select("path", "layout").join(written(layouts, "layouts"), "layout").select("path", "columns")


def column_mapping(cells: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, pos, field, source_column, confidence, method): exact names, then similar ones, then what a column looks like.

    A column is used once and is known by its place, as headers may repeat; fields go in a fixed order. Columns that no
    field takes have field null. Files without rows have none here.
    """
    return column_layouts(cells, names).select("path", F.explode("columns").alias("c")).select("path", "c.*")


def _assigned(columns: list[dict], names: dict[str, list[str]]) -> list[dict]:
    """The mapping of a file with such columns (pos, header and what their values show)."""
    free = {c["pos"]: c for c in columns}
    norm = lambda h: " ".join((h or "").lower().split())
    taken: dict[str, tuple] = {}

    def take(field, c, sure, how):
        taken[field] = (c["pos"], field, c["header"], sure, how)
        del free[c["pos"]]

    for field in FIELDS:
        wanted = [field, *names.get(field, [])]
        exact = next((c for c in free.values() if norm(c["header"]) in wanted), None)
        if exact is not None:
            take(field, exact, 1.0, "exact")
            continue
        scored = [(max(token_sort(norm(c["header"]), w) for w in wanted), -i, c) for i, c in enumerate(free.values())]
        best = max(scored, key=lambda s: s[:2], default=None)
        if best and best[0] >= rules.FUZZY_COLUMN:
            take(field, best[2], round(best[0] / 100, 3), "fuzzy")
    for field, sure in INFERRED.items():
        test = {"date": "is_date", "balance": "is_balance"}.get(field, "is_amount")
        if field not in taken and (c := next((c for c in free.values() if c[test]), None)) is not None:
            take(field, c, sure, "inferred")
    rows = [*taken.values(), *[(c["pos"], None, c["header"], 0.0, "unmapped") for c in free.values()]]
    return [dict(zip(("pos", "field", "source_column", "confidence", "method"), r)) for r in rows]


def mapped(mapping: DataFrame) -> DataFrame:
    """A row a file: for each field its column (null if none has it) and the confidence (0.0 then)."""
    of = lambda c, f: F.max(F.when(F.col("field") == f, F.col(c)))
    return mapping.groupBy("path").agg(*[of("source_column", f).alias(f) for f in FIELDS], *[F.coalesce(of("confidence", f), F.lit(0.0)).alias(f"{f}_confidence") for f in FIELDS])


def unique_headers(headers: DataFrame) -> DataFrame:
    """(path, pos, header, unique): blanks become ``col``, repeats get _1, _2 ... in order."""
    base = F.regexp_replace(F.trim(F.coalesce("header", F.lit(""))), r"\s+", " ")
    df = headers.withColumn("base", F.when(F.lower(base).isin("", "nan"), "col").otherwise(base))
    n = F.row_number().over(Window.partitionBy("path", "base").orderBy("pos")) - 1
    return df.withColumn("n", n).select("path", "pos", "header", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", "n")).alias("unique"))


def signed_amount_columns(cells: DataFrame) -> DataFrame:
    """(path, header): the column of signed amounts, by name or as the first that is numeric with leading minus signs."""
    named = header_name(F.col("header")).isin("amount", "txn amount", "transaction amount", "signed amount")
    value = F.trim(F.coalesce("value", F.lit("")))
    share = lambda test: F.avg(test.cast("int"))
    df = cells.groupBy("path", "pos", "header").agg(share(F.translate(value, ",", "").rlike(r"^-?\d+\.?\d*$")).alias("numeric"), share(F.startswith(value, F.lit("-"))).alias("minus"))
    df = df.withColumn("named", named).where(F.col("named") | ((F.col("numeric") > 0.6) & (F.col("minus") > 0.1)))
    return df.groupBy("path").agg(F.min_by("header", F.struct((~F.col("named")).cast("int"), "pos")).alias("header"))
