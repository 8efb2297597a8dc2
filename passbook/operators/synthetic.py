"""Synthetic rows by a Gaussian copula, and checks of their fidelity and privacy."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import MOST, scanned
from .scratch import written
from .store import registered

GRID = 200
CLOSE = 1e-6
#: Values of a text column that are learned at most.
VALUES = 1000
#: Numbers of rows that are made and served.
SIZES = (100, 1000, 10000)


def _quantiles(df: DataFrame, columns: list[str], grid: int) -> list[list[float]]:
    """``grid`` + 1 quantiles of each column: a bounded summary, whatever the number of rows."""
    return df.approxQuantile(columns, [i / grid for i in range(grid + 1)], 0.001)


def _intervals(df: DataFrame, column: str) -> list[tuple[str | None, float, float]]:
    """(value, start, end) of each value of a text column, in order, as wide as its share of the rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first(column)).limit(VALUES + 1).collect()
    if len(counts) > VALUES:
        raise ValueError(f"{column} has over {VALUES} values")
    total, at, out = sum(r["n"] for r in counts), 0, []
    for r in counts:
        out.append((r[column], at / total, (at + r["n"]) / total))
        at += r["n"]
    return out


def copula_samples(df: DataFrame, n: int, *, id_col: str = "customer_id", seed: int = 7, grid: int = GRID) -> DataFrame:
    """``n`` rows with the columns' distributions and the correlation of their normal scores; ids ``syn-000000`` on.

    The fit is grid quantiles of numeric columns, the shares of the values of text columns and one correlation matrix; rows are
    drawn where they are made. The values of a text column, in order (null first), are intervals of the unit line as wide as
    their shares: a value scores as the middle of its interval, and a draw gives the value in whose interval it falls.
    ValueError for an empty table, without a column to learn, or for a text column of over ``VALUES`` values.
    """
    import bisect
    from statistics import NormalDist

    import numpy as np

    columns = [c for c, t in df.dtypes if c != id_col and t in ("int", "bigint", "float", "double")]
    words = [c for c, t in df.dtypes if c != id_col and t == "string"]
    clean = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], *words)
    marks = _quantiles(clean, columns, grid) if columns else []
    if not columns + words or any(not m for m in marks) or clean.isEmpty():
        raise ValueError("nothing to learn from")
    spans = [_intervals(clean, c) for c in words]

    @F.pandas_udf("array<double>")
    def scores(values):
        import pandas as pd

        inverse = NormalDist().inv_cdf
        place = lambda m, v: min(max((bisect.bisect_left(m, v) + bisect.bisect_right(m, v)) / 2 / len(m), 0.5 / len(m)), 1 - 0.5 / len(m))
        return pd.Series([[inverse(place(m, v)) for m, v in zip(marks, row)] for row in values])

    middle = [{v: NormalDist().inv_cdf((a + b) / 2) for v, a, b in span} for span in spans]
    # A null is the value "" of its own interval, which has another number.
    scored = [F.element_at(F.create_map(*[F.lit(x) for v, z in m.items() for x in ("\0" if v is None else v, z)]), F.coalesce(c, F.lit("\0"))) for m, c in zip(middle, words)]
    numbers = scores(F.array(*columns)) if columns else F.array().cast("array<double>")
    got = clean.select(numbers.alias("s"), *[c.alias(f"w{i}") for i, c in enumerate(scored)]).select(*[F.get("s", F.lit(i)).alias(f"s{i}") for i in range(len(columns))], *[f"w{i}" for i in range(len(words))])
    vectors = VectorAssembler(inputCols=got.columns, outputCol="v").transform(got)
    corr = np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray())
    np.fill_diagonal(corr, 1.0)
    low = np.linalg.cholesky(corr + 1e-6 * np.eye(len(corr)))
    ends, values = [np.array([b for *_, b in span]) for span in spans], [[v for v, *_ in span] for span in spans]

    def draw(batches):
        import pandas as pd

        cdf = np.vectorize(NormalDist().cdf, otypes=[float])
        for b in batches:
            normal = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(len(corr)) for i in b["id"]]) if len(b) else np.zeros((0, len(corr)))
            u = cdf(normal @ low.T)
            out = {c: np.interp(u[:, i] * grid, np.arange(len(marks[i])), marks[i]) for i, c in enumerate(columns)}
            for k, c in enumerate(words):
                at = np.minimum(np.searchsorted(ends[k], u[:, len(columns) + k], side="right"), len(values[k]) - 1)
                out[c] = [values[k][j] for j in at]
            yield pd.DataFrame({id_col: [f"syn-{i:06d}" for i in b["id"]], **out})

    return df.sparkSession.range(n).mapInPandas(draw, f"{id_col} string, " + ", ".join([*[f"`{c}` double" for c in columns], *[f"`{c}` string" for c in words]]))


def grid(df: DataFrame, datasets: DataFrame, folder: str, *, id_col: str = "customer_id", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """The registry with a dataset ``copula-n`` of n made rows for each size, written under ``folder``."""
    for n in sizes:
        datasets = registered(datasets, copula_samples(df, n, id_col=id_col), f"copula-{n}", f"{folder}/copula-{n}")
    return datasets


def _correlation(df: DataFrame, columns: list[str]):
    import numpy as np

    clean = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return np.nan_to_num(Correlation.corr(VectorAssembler(inputCols=columns, outputCol="v").transform(clean), "v").first()[0].toArray())


def fidelity(real: DataFrame, made: DataFrame, columns: list[str], grid: int = GRID) -> dict[str, float]:
    """1 minus the greatest difference of the distribution functions, by column, on the grid of the real quantiles.

    ``correlation`` is 1 minus half of the mean difference of the correlations of all pairs of columns (1 for one column).
    """
    import numpy as np

    marks = _quantiles(real.select(*columns), columns, grid)

    def shares(df: DataFrame) -> list[float]:
        tests = [F.avg((F.col(c) <= m).cast("int")) for c, ms in zip(columns, marks) for m in ms]
        return list(df.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first())

    a, b, out, at = shares(real), shares(made), {}, 0
    for c, ms in zip(columns, marks):
        out[c] = 1 - max(abs((x or 0) - (y or 0)) for x, y in zip(a[at : at + len(ms)], b[at : at + len(ms)]))
        at += len(ms)
    apart = np.abs(_correlation(real, columns) - _correlation(made, columns))[np.triu_indices(len(columns), 1)]
    out["correlation"] = 1 - float(apart.mean()) / 2 if len(apart) else 1.0
    return out


def distances(real: DataFrame, made: DataFrame, columns: list[str], *, most: int = MOST) -> DataFrame:
    """(column, statistic): of each numeric column the exact two-sample Kolmogorov-Smirnov statistic, nulls left out.

    Values of both tables are counted together and ranked in one segmented scan, so the greatest difference of the
    distribution functions is found over all values. Slices are cut at approximate quantiles; they decide nothing else. A
    column that one table lacks or has no values in has the statistic 1, or none if neither has any.
    """
    long = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select("v.*", F.lit(side).alias("side"))
    both = long(real, 0).unionByName(long(made, 1)).where(F.col("value").isNotNull())
    counts = written(both.groupBy("column", "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")), "counts")
    marks = real.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(columns, [i / GRID for i in range(GRID + 1)], 0.001)
    inside = F.coalesce(*[F.when(F.col("column") == c, F.size(F.filter(F.array(*map(F.lit, m)) if m else F.array().cast("array<double>"), lambda x: x <= F.col("value")))) for c, m in zip(columns, marks)])
    run = scanned(counts, ["column"], ["value"], [inside], sums={"below_a": F.col("a"), "below_b": F.col("b")}, most=most)
    totals = counts.groupBy("column").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    share = lambda c: F.when(F.col(f"all_{c}") > 0, F.col(f"below_{c}") / F.col(f"all_{c}")).otherwise(0.0)
    return run.join(F.broadcast(totals), "column").groupBy("column").agg(F.max(F.abs(share("a") - share("b"))).alias("statistic"))


def contingency(real: DataFrame, made: DataFrame, one: str, two: str) -> DataFrame:
    """A row: 1 minus half of the summed differences of the shares of each pair of values of two columns; null is a value."""
    pairs = lambda df, side: df.select(F.col(one).alias("x"), F.col(two).alias("y"), F.lit(side).alias("side"))
    counts = pairs(real, 0).unionByName(pairs(made, 1)).groupBy("x", "y").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    counts = written(counts, "pairs")
    totals = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))  # one row
    both = counts.crossJoin(F.broadcast(totals))
    return both.agg((1 - F.sum(F.abs(F.col("a") / F.col("all_a") - F.col("b") / F.col("all_b"))) / 2).alias("similarity"), F.count(F.lit(1)).alias("pairs"))


def _cells(df: DataFrame, pivots) -> DataFrame:
    """Adds ``far``, the distance of v to each pivot."""

    @F.pandas_udf("array<double>")
    def far(v):
        import numpy as np
        import pandas as pd

        at = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, pivots.shape[1]))
        return pd.Series([np.sqrt(((pivots - x) ** 2).sum(1)) for x in at])

    return df.withColumn("far", far("v"))


def _least(asked: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """(id, h, best): least distance of each query (id, h, v, cell) to the rows (v, cell) of its cells.

    A cell is cut in blocks of about ``block`` rows and of as many queries; a pair of blocks is one unit of work, so none
    grows with a cell.
    """
    count = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = count(rows, "row_blocks").join(count(asked, "asked_blocks"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    q = asked.join(sizes, "cell").select("cell", every("row_blocks").alias("x"), mine("asked_blocks").alias("y"), "id", "h", "v")
    r = rows.join(sizes, "cell").select("cell", mine("row_blocks").alias("x"), every("asked_blocks").alias("y"), "v")

    def unit(q, r):
        import numpy as np

        out = q[["id", "h"]].copy()
        out["best"] = np.inf
        if len(q) and len(r):
            a, b = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (q, r))
            out["best"] = [np.sqrt(((b - x) ** 2).sum(1).min()) for x in a]
        return out

    kind = T.StructType([asked.schema["id"], *T.StructType.fromDDL("h long, best double").fields])
    return q.groupBy("cell", "x", "y").cogroup(r.groupBy("cell", "x", "y")).applyInPandas(unit, kind).groupBy("id", "h").agg(F.min("best").alias("best"))


def nearest(queries: DataFrame, rows: DataFrame, *, block: int = 2048, pivots: int = 64) -> DataFrame:
    """(id, distance): Euclidean distance of each query (id, v: array<double>) to the nearest of ``rows`` (v), exactly.

    Rows belong to the cell of their nearest pivot (a bounded choice of rows). A query looks in its own cell first, then
    only in those cells that, by their radius, could hold something nearer. Queries without any row get null; of an id
    with several vectors each has a row; null vectors are left out.
    """
    import numpy as np

    # New names for the columns: both may come of one table.
    queries, rows = queries.where("v IS NOT NULL").select("id", "v").toDF("id", "v"), rows.where("v IS NOT NULL").select("v").toDF("v")
    chosen = np.array([r["v"] for r in rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()], np.float64)
    if not len(chosen):
        return queries.select("id", F.lit(None).cast("double").alias("distance"))
    cell = F.array_position("far", F.array_min("far")).cast("int")
    placed = _cells(rows.select("v"), chosen).select("v", cell.alias("cell"), F.array_min("far").alias("r"))
    radius = placed.groupBy("cell").agg(F.max("r").alias("radius"))
    asked = _cells(queries.select("id", "v", F.xxhash64("id", "v").alias("h")), chosen)
    cells = radius.agg(F.collect_list(F.struct("cell", "radius")).alias("cells"))  # one row, as many cells as pivots
    asked = asked.join(F.broadcast(cells))
    own = F.array_min(F.transform("cells", lambda c: F.struct(F.get("far", c["cell"] - 1).alias("far"), c["cell"].alias("cell"))))["cell"]
    first = _least(asked.select("id", "h", "v", own.alias("cell")), placed.select("v", "cell"), block)
    # Rounding must not hide a cell.
    reach = asked.join(first, ["id", "h"]).select("id", "h", "v", own.alias("own"), "best", "far", F.explode("cells").alias("c"))
    near = (F.col("c.cell") != F.col("own")) & (F.get("far", F.col("c.cell") - 1) - F.col("c.radius") <= F.col("best") * (1 + 1e-9) + 1e-9)
    more = _least(reach.where(near).select("id", "h", "v", F.col("c.cell").alias("cell")), placed.select("v", "cell"), block)
    return first.unionByName(more).groupBy("id", "h").agg(F.min("best").alias("distance")).select("id", "distance")


def scaled(df: DataFrame, real: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with v: the columns, each from 0 to 1 over the range of the real rows (a range of 0 counts as 1), nulls as 0."""
    ends = real.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))])
    unit = [F.coalesce((F.col(c).cast("double") - F.col(f"low_{i}")) / F.coalesce(F.nullif(F.col(f"high_{i}") - F.col(f"low_{i}"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for i, c in enumerate(columns)]
    return df.join(F.broadcast(ends)).select(*df.columns, F.array(*unit).alias("v"))


def privacy_check(real: DataFrame, made: DataFrame, columns: list[str], *, id_col: str = "customer_id") -> DataFrame:
    """``privacy`` of the made rows' distances to the nearest real row, columns scaled by the real range."""
    return privacy(nearest(scaled(made, real, columns).select(F.col(id_col).alias("id"), "v"), scaled(real, real, columns).select("v")))


def privacy(distances: DataFrame) -> DataFrame:
    """(min_distance, mean_distance, n, passed): passed unless some made row is a real one."""
    return distances.agg(F.min("distance").alias("min_distance"), F.avg("distance").alias("mean_distance"), F.count(F.lit(1)).alias("n")).withColumn("passed", F.col("min_distance") > CLOSE)
