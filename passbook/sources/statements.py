"""Statement files as tables: an inventory of a folder, and long ``cells`` tables of what files hold.

``cells`` has (path, row, pos, header, value) for any mix of headers. Files are read where Spark puts them; a file that
cannot be read becomes a row of errors, not a failed job.
"""

from __future__ import annotations

import csv
import functools
import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import compute
from pyarrow import csv as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

SUFFIXES = {"csv": "csv", "xlsx": "xlsx", "xls": "xlsx", "pdf": "pdf"}
SAMPLE_BYTES, TEXT_LAYER = 8192, 20
CELLS = "path string, row long, pos int, header string, value string"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return spark.read.format("binaryFile").load(folder).withColumn("file_type", F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), suffix)).where("file_type IS NOT NULL")


def inventory(spark: SparkSession, folder: str, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, file_type, pdf_kind, detected_bank, layout_hint, has_text_layer, errors) of the folder's files, by path.

    ``pdf_text`` gives the text of the first pages of a PDF; without it PDFs count as scanned, with an error.
    """

    @F.pandas_udf("text string, error string")
    def layer(contents):
        import pandas as pd

        out = []
        for c in contents:
            try:
                out.append((pdf_text(bytes(c)) if pdf_text else "", None if pdf_text else "no reader for PDF text"))
            except Exception as e:  # the error is the result
                out.append(("", str(e)[:500]))
        return pd.DataFrame(out, columns=["text", "error"])

    files = _files(spark, folder)
    sample = F.replace(F.decode(F.substring("content", 1, SAMPLE_BYTES), "UTF-8"), F.lit("�"), F.lit(""))
    other = files.where("file_type <> 'pdf'").select("path", "file_type", sample.alias("text"), F.lit(None).cast("string").alias("error"))
    pdf = files.where("file_type = 'pdf'").select("path", "file_type", layer("content").alias("l")).select("path", "file_type", "l.text", "l.error")
    df = other.unionByName(pdf)
    is_pdf, has = F.col("file_type") == "pdf", F.length(F.trim("text")) >= TEXT_LAYER
    return df.select(
        "path", "file_type", F.when(is_pdf, F.when(has, "native").otherwise("scanned")).alias("pdf_kind"), text.bank_of(F.col("text")).alias("detected_bank"),
        F.when(is_pdf & has, text.layout_hint(F.col("text"))).alias("layout_hint"), F.when(is_pdf, has).alias("has_text_layer"), F.filter(F.array("error"), F.isnotnull).alias("errors"),
    ).orderBy("path")


def settings(spark: SparkSession, path: str) -> dict[str, dict]:
    """Names and words that a JSON file (an object of objects) gives for ``column_mapping``, ``bank_of`` and others.

    ValueError if the file holds anything else.
    """
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(found, dict) or not all(isinstance(v, dict) for v in found.values()):
        raise ValueError(f"{path} is no mapping of mappings")
    return found


def _csv_columns(content: bytes) -> tuple[list[str], list[pa.Array]]:
    """Header and columns of a CSV file, all text; short rows are padded, and what a row has beyond the header is joined to its last cell."""
    text = content.decode("utf-8-sig", "replace")
    head = next((r for r in csv.reader(io.StringIO(text)) if r), [])
    try:
        table = pc.read_csv(
            io.BytesIO(text.encode()), pc.ReadOptions(autogenerate_column_names=True), pc.ParseOptions(newlines_in_values=True),
            pc.ConvertOptions(column_types={f"f{i}": pa.string() for i in range(len(head))}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:  # rows of several lengths, or nothing at all
        return _as_columns(list(csv.reader(io.StringIO(text))))
    return head, [c.slice(1).combine_chunks() for c in table.columns]


def _as_columns(rows: list[list[str]]) -> tuple[list[str], list[pa.Array]]:
    """Header and columns of rows of cells; blank rows count as none."""
    head, *rest = [r for r in rows if any(x.strip() for x in r)] or [[]]
    rest = [r if len(r) <= len(head) or not head else [*r[: len(head) - 1], " ".join(r[len(head) - 1 :])] for r in rest]
    return head, [pa.array([r[j] if j < len(r) else "" for r in rest], pa.string()) for j in range(len(head))]


def _xlsx_rows(content: bytes) -> list[list[str]]:
    """Rows of the first sheet of a workbook, as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row.findall("m:c", ns)):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                pos = 0
                for x in letters:
                    pos = pos * 26 + ord(x.upper()) - 64
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                value = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else (v.text or "") if v is not None else ""
                cells[pos - 1 if letters else i] = shared[int(value)] if c.get("t") == "s" and value else value
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return rows


def cells(spark: SparkSession, folder: str, readers: dict[str, Callable[[bytes], list[list[str]]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, errors) of the CSV and workbook files of a folder, all values text; ``readers`` adds or replaces types.

    A file is read whole by one task, as statements are files of some MB, and given column by column; a file without rows
    is an error. Spark passes over files of no bytes.
    """
    how = {k: (lambda content, f=f: _as_columns(f(content))) for k, f in ({"xlsx": _xlsx_rows} | (readers or {})).items()}
    how.setdefault("csv", _csv_columns)

    def column(path: str, rows: pa.Array, pos: int | None, header: str | None, values: pa.Array, error: str | None) -> pa.RecordBatch:
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), len(rows))
        return pa.RecordBatch.from_arrays([same(path, pa.string()), rows, same(pos, pa.int32()), same(header, pa.string()), values, same(error, pa.string())], names=["path", "row", "pos", "header", "value", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, content in zip(b.column("path").to_pylist(), b.column("file_type").to_pylist(), b.column("content")):
                try:
                    head, values = how[kind](content.as_py())
                    blank = [compute.equal(compute.utf8_trim_whitespace(v), "") for v in values]
                    filled = compute.invert(functools.reduce(compute.and_, blank)) if values else pa.array([], pa.bool_())
                    values = [v.filter(filled) for v in values]
                    if not values or not len(values[0]):
                        raise ValueError("No rows")
                except Exception as e:  # the error is the result
                    yield column(path, pa.nulls(1, pa.int64()), None, None, pa.nulls(1, pa.string()), f"{kind}: {e}"[:500])
                    continue
                rows = pa.array(range(len(values[0])), pa.int64())
                for pos, (h, v) in enumerate(zip(head, values)):
                    yield column(path, rows, pos, h.strip(), v, None)

    files = _files(spark, folder).where(F.col("file_type").isin(*how)).select("path", "file_type", "content")
    both = files.mapInArrow(run, f"{CELLS}, error string")
    return both.where("error IS NULL").drop("error"), both.where("error IS NOT NULL").select("path", "error")


def csv_table(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """One CSV layout as a table of text: blanks are '' and headers are trimmed; the first ``most`` rows if given, which is the feature."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in df.columns])
    return df if most is None else df.limit(most)
