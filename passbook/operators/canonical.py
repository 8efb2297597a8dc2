"""From raw cells to canonical transactions, and their merchants, modes and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from . import columns
from .names import similar_names
from .scratch import written

CONTRACT = ["transaction_id", "date", "merchant", "description", "debit", "credit", "balance", "currency", "bank", "reference_number", "account_type", "payment_mode", "category", "category_confidence"]
_KEPT = 200


def normalised(cells: DataFrame, mapping: DataFrame, *, bank: DataFrame | None = None, currency: str = "INR", compat_dates: bool = False, signed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(transactions, rejected): cells (path, row, pos, header, value) by the mapping of their file.

    A column is known by its place, so headers may repeat; ``mapping`` is that of ``column_mapping`` or ``column_layouts``. Rows without a date or with a cell that is no amount are rejected with a reason. A signed amount splits into debit
    and credit where neither is mapped; ``signed`` (path, header) names its column in files that map no amount. An empty description is made of the unmapped cells.
    """
    if "columns" not in mapping.columns:
        mapping = mapping.groupBy("path").agg(F.collect_list(F.struct("pos", "field")).alias("columns"))
    wide = cells.groupBy("path", "row").agg(F.array_sort(F.collect_list(F.struct("pos", text.clean_cell(F.col("value")).alias("v"), "header"))).alias("cells"))
    fields = ("date", "description", "debit", "credit", "balance", "reference_number", "amount")
    of = lambda test: F.transform(F.filter("columns", test), lambda m: m["pos"])
    at = lambda f: of(lambda m: m["field"] == f)
    places = {f"_{f}": at(f) for f in fields} | {"_known": of(lambda m: m["field"].isNotNull()), "has_sides": F.exists("columns", lambda m: F.coalesce(m["field"].isin("debit", "credit"), F.lit(False))).cast("int")}
    wide = wide.join(mapping.select("path", *[c.alias(n) for n, c in places.items()]), "path", "left")
    pick = lambda f: F.when(F.size(f"_{f}") > 0, F.array_max(F.transform(F.filter("cells", lambda c: F.array_contains(f"_{f}", c["pos"])), lambda c: c["v"]))).alias(f)
    spare = F.filter("cells", lambda c: (c["v"] != "") & ~F.coalesce(F.array_contains("_known", c["pos"]), F.lit(False)))
    kept = []
    if signed is not None:
        wide = wide.join(signed.select("path", F.col("header").alias("_header")), "path", "left")
        kept = [F.get(F.filter("cells", lambda c: c["header"] == F.col("_header")), F.lit(0))["v"].alias("_signed")]
    wide = wide.select("path", "row", *[pick(f) for f in fields], spare.alias("spare"), "has_sides", *kept)
    if signed is not None:
        wide = wide.withColumn("amount", F.coalesce("amount", "_signed")).drop("_signed")
    if bank is not None:
        wide = wide.join(bank.select("path", "bank"), "path", "left")
    signed = F.when(F.coalesce("has_sides", F.lit(0)) == 0, text.amount(F.col("amount")))
    when = text.statement_date(F.col("date"), compat_dates)
    described = F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(F.substring(F.array_join(F.transform("spare", lambda s: s["v"]), " "), 1, _KEPT))
    bad = F.greatest(*[text.bad_amount(F.col(c)).cast("int") for c in ("debit", "credit", "balance", "amount")])
    reason = F.when(when.isNull(), "no date").when(bad == 1, "no amount")
    df = wide.withColumn("reason", reason)
    ok = df.where("reason IS NULL").select(
        "path", "row", F.sha2(F.concat_ws("~", "path", "row", "date", described, "debit", "credit", "amount", "balance"), 256).alias("transaction_id"), when.alias("date"), described.alias("description"),
        F.coalesce(text.amount(F.col("debit")), F.when(signed < 0, -signed)).cast("decimal(18,2)").alias("debit"), F.coalesce(text.amount(F.col("credit")), F.when(signed > 0, signed)).alias("credit"),
        text.amount(F.col("balance")).alias("balance"), F.lit(currency).alias("currency"), (F.col("bank") if bank is not None else F.lit(None).cast("string")).alias("bank"),
        F.nullif("reference_number", F.lit("")).alias("reference_number"), F.lit(None).cast("string").alias("account_type"), text.mode_by_prefix(described).alias("payment_mode"),
    )
    return ok, df.where("reason IS NOT NULL").select("path", "row", "reason")


def with_merchants(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Adds merchant and merchant_confidence (null and 0 if none is found) and fills a missing payment_mode from the description.

    Candidates without an exact name look for a similar one of ``names`` (the known merchants by default), each distinct one once.
    """
    spark = df.sparkSession
    known = spark.createDataFrame(list(enumerate(names or rules.MERCHANTS)), "place int, name string")
    described = F.coalesce("description", F.lit(""))
    texts = written(df.select(described.alias("_t")).distinct().withColumn("_m", text.merchant_of(F.col("_t"))), "merchants")
    unsure = F.when(F.col("_m.confidence") == rules.CONFIDENCE["fallback"], F.col("_m.cleaned"))
    similar = similar_names(texts.select(unsure.alias("text")).where("text IS NOT NULL"), known, rules.FUZZY_MERCHANT).select(F.col("text").alias("_c"), F.col("name").alias("_n"), F.round(F.col("score") / 100, 3).alias("_s"))
    found = texts.join(similar, unsure == F.col("_c"), "left").select("_t", F.coalesce("_n", "_m.merchant").alias("_merchant"), F.coalesce("_s", "_m.confidence").alias("_sure"))
    df = df.join(written(found, "named"), described == F.col("_t"), "left")
    mode = F.col("payment_mode") if "payment_mode" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"merchant": F.col("_merchant"), "merchant_confidence": F.col("_sure"), "payment_mode": F.coalesce(mode, text.mode_by_word(F.col("description")))}).drop("_t", "_merchant", "_sure")


def with_categories(df: DataFrame, model=None, *, code_col: str | None = None) -> DataFrame:
    """Adds category and category_confidence: by merchant, category code (column ``code_col``) or keyword, else by ``model``
    (see ``tier2``), else Others. One pass; texts that a rule settles are blank to the model.
    """
    rule = text.ruled_category(F.col("merchant"), F.col("description"), F.col(code_col).cast("string") if code_col else None)
    df = df.withColumn("_r", rule)
    none = F.lit(None)
    guess, sure = none.cast("string"), none.cast("double")
    if model is not None:
        from .tier2 import predicted

        df = predicted(df, model, where=F.col("_r.category").isNull())
        guess, sure = F.col("guess"), F.col("guess_confidence")
    category = F.coalesce("_r.category", guess, F.lit("Others"))
    confidence = F.coalesce("_r.confidence", sure, F.lit(rules.CONFIDENCE["default"]).cast("double"))
    return df.withColumn("category", category).withColumn("category_confidence", confidence).drop("_r", "guess", "guess_confidence")


def ingested(cells: DataFrame, *, names: dict[str, list[str]] | None = None, model=None, strict: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(transactions, rejected) of raw cells: mapping, signed columns, normalising, merchants and categories, one after the other.

    ``options`` go to ``normalised``. With ``strict`` there has to be something in it: ValueError without cells or without a valid row.
    """
    if strict and cells.isEmpty():
        raise ValueError("no cells to normalise")
    mapping = written(columns.column_layouts(cells, names), "mapping")  # a row a file; asked for several times
    found, bad = normalised(cells, mapping, signed=columns.signed_amount_columns(cells), **options)
    found = written(found, "normalised")
    if strict and found.isEmpty():
        raise ValueError("no valid transactions")
    # Merchant and category depend on the description alone, so each distinct one is looked at once.
    named = written(with_categories(with_merchants(found.select("description", "payment_mode").distinct()), model), "named")
    return found.drop("payment_mode").join(named, "description"), bad


def contract(df: DataFrame) -> DataFrame:
    """The columns of a canonical transaction, in order; those that ``df`` lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in CONTRACT])
