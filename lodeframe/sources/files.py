"""Sources of entity lists, uploads and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header; blank lines are dropped, values trimmed."""
    return spark.read.options(**_CSV).csv(path)


def csv_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """The same for lines of a request's body, which is small; they travel as one row."""
    head, *rest = [x for x in lines if x.strip()]
    names = [n.strip().strip('"') for n in head.split(",")]
    body = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in rest])).alias("line"))
    row = F.from_csv("line", ", ".join(f"`{n}` string" for n in names), {k: str(v).lower() if isinstance(v, bool) else v for k, v in _CSV.items() if k != "header"})
    return body.select(row.alias("r")).select("r.*")


# What a pasted list's header says.
HEADERS = ("name", "company", "company name", "ticker", "isin")


def pasted(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, pos, name of every line of each body: one name for each line; the first field where lines look like CSV; blank lines and a header are left out."""
    lines = F.filter(F.transform(F.split(body, "\r?\n"), lambda x: F.trim(F.split(x, ",")[0])), lambda x: x != "")
    names = F.when(F.lower(F.get(lines, F.lit(0))).isin(*HEADERS), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return rows.select(key, F.posexplode(names).alias("pos", "name"))


def json_list(rows: DataFrame, key: str, body: str, schema: str) -> DataFrame:
    """key and the fields of every object in each body, a list; a body that is none gives no rows."""
    return rows.select(key, F.explode(F.from_json(body, f"array<struct<{', '.join(x.strip().replace(' ', ':') for x in schema.split(','))}>>")).alias("r")).select(key, "r.*")


def flexible(rows: DataFrame, names: list[str]) -> Column:
    """The column with one of these names, else those whose name contains one; the first value that isn't blank."""
    exact = [c for n in names for c in rows.columns if c.lower() == n.lower()]
    found = exact or [c for n in names for c in rows.columns if n.lower() in c.lower()]
    return F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in found]) if found else F.lit(None).cast("string")


def doc_type(url: str | Column) -> Column:
    col = F.col(url) if isinstance(url, str) else url
    return F.when(F.lower(col).rlike(r"(\.pdf$|/pdf/|format=pdf)"), "pdf").otherwise("html")
