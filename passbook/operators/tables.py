"""Raw tables from text: lines of statements, tokens with a place on the page, tables cut over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that make a line a credit, words of transaction tables, the height of a row of tokens, lines with a
# date in front and amounts at the end.
CREDIT_HINTS = ["salary", "neft-", "imps-", "rtgs-", "interest", "refund", "deposit", "credit", "upi-cr"]
TABLE_WORDS = ["date", "debit", "credit", "balance", "description", "particular", "narration", "withdrawal", "deposit", "ref"]
ROW_HEIGHT = 12.0
_LINE = r"^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+(.+)$"
_AMOUNTS = r"((?:\s+-?\d[\d,]*\.\d{2})+)$"


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each worked out once: Spark moves filters and expressions that use a column below a plain select, which repeats it, but not below a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def text_lines(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, line_no, date, description, debit, credit, balance) of the lines that read as transactions; blanks as ''."""
    lines = texts.select(F.col(id_col), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
    # A line has no line feed, so these part what one match finds.
    df = _once(lines, parts=F.split(F.regexp_replace(F.trim("line"), _LINE, "$1\n$2\n"), "\n")).where(F.size("parts") == 3)
    df = df.select(id_col, "line_no", F.col("parts")[0].alias("date"), F.col("parts")[1].alias("rest"))
    df = _once(df, tail=F.regexp_extract("rest", _AMOUNTS, 1)).where("tail <> ''")
    description = F.trim(F.substr("rest", F.lit(1), F.length("rest") - F.length("tail")))
    df = _once(df, description=description, low=F.lower(description), amounts=F.regexp_extract_all("tail", F.lit(r"\S+"), F.lit(0)))
    low = F.col("low")
    df = df.where((F.col("description") != "") & ~(F.contains(low, F.lit("debit")) & F.contains(low, F.lit("credit"))))
    n = F.size("amounts")
    at = lambda k: F.get("amounts", n - k)
    one = F.when(n == 2, at(2)).otherwise(at(1))
    credit = _any(low, CREDIT_HINTS)
    return df.select(
        id_col, "line_no", "date", "description", F.when(n >= 3, at(3)).when(~credit, one).otherwise("").alias("debit"),
        F.when(n >= 3, at(2)).when(credit, one).otherwise("").alias("credit"), F.when(n >= 2, at(1)).otherwise("").alias("balance"),
    )


def token_rows(tokens: DataFrame, height: float = ROW_HEIGHT) -> DataFrame:
    """(path, page, row, cells) of tokens (path, page, x, y, text): a token joins the row whose mean height is near.

    The fold runs within a page, whose tokens are bounded by what a page can show.
    """
    points = F.array_sort(F.collect_list(F.struct("y", "x", "text")))
    kind = "array<struct<row:int,x:double,text:string>>"

    def step(acc: Column, t: Column) -> Column:
        joins = (acc["n"] > 0) & (F.abs(t["y"].cast("double") - acc["s"] / F.greatest(acc["n"], F.lit(1))) <= height)
        row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(
            (F.when(joins, acc["s"]).otherwise(0.0) + t["y"].cast("double")).alias("s"), (F.when(joins, acc["n"]).otherwise(0) + 1).alias("n"), row.alias("row"),
            F.concat(acc["out"], F.array(F.struct(row.alias("row"), t["x"].cast("double").alias("x"), t["text"].alias("text")))).alias("out"),
        )

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(-1).alias("row"), F.array().cast(kind).alias("out"))
    df = tokens.groupBy("path", "page").agg(points.alias("points")).select("path", "page", F.explode(F.aggregate("points", zero, step, lambda a: a["out"])).alias("t"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("t.x", "t.text"))), lambda c: c["text"])
    return df.groupBy("path", "page", F.col("t.row").alias("row")).agg(cells.alias("cells"))


def fitted(cells: Column, width: Column) -> Column:
    """Cells padded with '' to ``width``, or with what is too much joined into the last one."""
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    joined = F.concat(F.slice(cells, F.lit(1), F.greatest(width - 1, F.lit(0))), F.array(F.array_join(F.slice(cells, F.greatest(width, F.lit(1)), F.size(cells) + 1), " ")))
    return F.when(F.size(cells) > width, joined).otherwise(padded)


def repeats_header(cells: Column, header: Column) -> Column:
    """Whether a row says the header again: at least half of the places (two at least) agree in either case."""
    same = F.aggregate(F.zip_with(cells, header, lambda a, b: (F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return same >= F.greatest(F.lit(2), F.floor(F.size(header) / 2))


def joined_tables(rows: DataFrame) -> DataFrame:
    """(path, page, row, header, cells): the first row of a file is its header, repeats of it are dropped, widths fit."""
    first = rows.groupBy("path").agg(F.min_by("cells", F.struct("page", "row")).alias("header"), F.min(F.struct("page", "row")).alias("at"))
    df = rows.join(first, "path").where(F.struct("page", "row") > F.col("at")).where(~repeats_header(F.col("cells"), F.col("header")))
    return df.select("path", "page", "row", "header", fitted(F.col("cells"), F.size("header")).alias("cells"))


def best_tables(tables: DataFrame) -> DataFrame:
    """Of (path, table, header array, n_rows): the tables of the width with the largest total score, best first (rank)."""
    text = F.lower(F.array_join("header", " "))
    words = sum((F.contains(text, F.lit(w)).cast("int") for w in TABLE_WORDS), F.lit(0))
    summary = F.contains(text, F.lit("account summary")) | F.contains(text, F.lit("available balance"))
    df = tables.withColumn("width", F.size("header")).withColumn("score", 10 * F.col("n_rows") + F.col("width") + 100 * words - F.when(summary, 500).otherwise(0))
    best = df.groupBy("path", "width").agg(F.sum("score").alias("total")).groupBy("path").agg(F.max_by("width", F.struct("total", "width")).alias("width"))
    ranked = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "table"))
    return df.join(best, ["path", "width"]).withColumn("rank", ranked)
