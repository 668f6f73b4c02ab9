"""Reading, writing, run records and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; a temporary one
    is made only in a local session that names none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gazetta-"))
    return df.checkpoint()


def save(df: DataFrame, path: str, keys: list[str] | None = None, columns: list[str] | None = None, newest: Column | None = None) -> None:
    """Overwrites a table; of rows with equal keys (nulls are equal) one stays, the
    newest by `newest`; expected columns that df lacks are null; NaN becomes null."""
    for c in columns or []:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.when(F.isnan(name), None).otherwise(F.col(name)))
    if keys:
        rest = [c for c in df.columns if c not in keys]
        sortable = [c for c in rest if "map<" not in dict(df.dtypes)[c]]  # maps have no order
        order = newest if newest is not None else F.struct(*sortable) if sortable else F.lit(0)
        picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")) if rest else df.distinct()
        df = picked.select(*keys, "__row.*").select(*df.columns) if rest else picked
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, compression="gzip" if compress else "none")


def export_json(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").json(path, compression="gzip" if compress else "none")


def latex_table(df: DataFrame, caption: str = "", label: str = "", precision: int = 3, most_rows: int = 50) -> str:
    """The first rows as a LaTeX table; the row limit is the feature."""
    from gazetta.functions.text import latex_text

    cells = [latex_text(F.format_number(c, precision) if k in ("double", "float") else F.col(c).cast("string")).alias(c) for c, k in df.dtypes]
    rows = df.limit(most_rows).select(*cells).collect()
    body = [" & ".join("" if v is None else v for v in r) + r" \\" for r in rows]
    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\"
    begin = [r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", head, r"\hline"]
    return "\n".join([*begin, *body, r"\hline", r"\end{tabular}", r"\end{table}"])


def markdown_report(title: str, parts: dict[str, DataFrame], most_rows: int = 20) -> str:
    """Headed tables of the first rows of each part."""
    out = [f"# {title}"]
    for name, df in parts.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(most_rows).collect()]
    return "\n".join(out)


def run_record(spark: SparkSession, run_id: str, kind: str, parameters: dict[str, str], created: str) -> DataFrame:
    return spark.createDataFrame([(run_id, kind, created, parameters)], "run_id string, kind string, created_at string, parameters map<string,string>")


def active_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each kind, the larger id on ties."""
    return runs.groupBy("kind").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), F.max("created_at").alias("created_at"))


def parameter_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parameters that differ between two runs, also where one lacks them."""
    x = a.select(F.explode("parameters").alias("name", "value_a"))
    y = b.select(F.explode("parameters").alias("name", "value_b"))
    return x.join(y, "name", "full_outer").filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def top_overlap(a: DataFrame, b: DataFrame, item: str, order: Column, n: int = 100) -> DataFrame:
    """The share of common items among the n first of two tables."""
    x, y = (df.orderBy(order, item).limit(n).select(item) for df in (a, b))
    return x.intersect(y).agg((F.count(F.lit(1)) / F.lit(float(n))).alias("overlap"))


def checksum(df: DataFrame, item: str, count: str, n: int = 1000) -> DataFrame:
    """MD5 of the n largest items as 'item:count', in order; n bounds what is gathered."""
    rows = df.orderBy(F.desc(count), item).limit(n).select(F.struct((-F.col(count)).alias("k"), F.col(item).alias("i")).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat_ws(":", s["i"], -s["k"])), "")
    return rows.agg(F.md5(text).alias("checksum"))


def drop_tables(spark: SparkSession, names: list[str], dry_run: bool = True) -> list[str]:
    """Drops the listed tables that exist, or only names them."""
    found = [n for n in names if spark.catalog.tableExists(n)]
    if not dry_run:
        for n in found:
            spark.sql(f"DROP TABLE {n}")
    return found


def install_views(spark: SparkSession, views: dict[str, tuple[DataFrame, dict[str, str]]]) -> None:
    """Temporary views with logical column names: name -> (table, logical -> expression)."""
    for name, (df, columns) in views.items():
        df.select(*[F.expr(e).alias(c) for c, e in columns.items()]).createOrReplaceTempView(name)


def export_excel(sheets: dict[str, DataFrame], path: str, most_rows: int = 100_000) -> None:
    """A workbook with a sheet per table, up to a row limit; needs an Excel writer for pandas."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("writing workbooks needs openpyxl") from e
    import pandas as pd

    with pd.ExcelWriter(path) as out:
        for name, df in sheets.items():
            df.limit(most_rows).toPandas().to_excel(out, sheet_name=name[:31], index=False)
