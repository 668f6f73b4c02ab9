"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger holds, per blob, the
rule versions that it was scanned with and the spans they found. A scan
looks only at pairs of blob and rule version that the ledger lacks, once for all
documents that share the blob, and the findings are joined back to all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, id_and_text, numbered, picked, place, salted_left_join


@dataclass(frozen=True)
class Rule:
    """A kind of secret: all leftmost non-overlapping matches of `pattern`, of
    which those stay whose `group` has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: Rules of the method's own, for secrets that the base ones miss.
MORE_RULES = (
    Rule("pem", 2, r"-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----"),  # bounded: a repeated group is matched by recursion
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (*BASE_RULES, *MORE_RULES)
LEDGER = "blob binary, scanned array<string>, spans array<struct<start:int,at:int,end:int,kind:string>>"
_NONE = "cast(array() as array<struct<start:int,at:int,end:int,kind:string>>)"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


#: Matches or spans that are placed together. Blocks keep the cost of a text with very
#: many of them near the number, where one list that grows by one each would cost its square.
_BLOCK = 256


def _blocks(n: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))


def rule_spans(text: Column, rule: Rule, at: int) -> Column:
    """Spans in code points. The texts between matches give their places."""
    pattern = F.lit(rule.pattern)
    none = F.expr(_NONE)

    def placed(m: Column) -> Column:
        between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
        size = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else m, lambda x: F.length(x))
        lengths = F.struct(between.alias("b"), F.transform(m, lambda x: F.length(x)).alias("m"), size.alias("g"))
        return F.when(F.size(m) == 0, none).otherwise(_let(lengths, walked))

    def walked(x: Column) -> Column:
        n = F.size(x["m"])

        def length_of(k: Column) -> Column:
            both = F.concat(F.slice(x["b"], k * _BLOCK + 1, F.least(F.lit(_BLOCK), n - k * _BLOCK)), F.slice(x["m"], k * _BLOCK + 1, F.lit(_BLOCK)))
            return F.aggregate(both, F.lit(0), lambda s, v: s + v)

        state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        starts = F.aggregate(_blocks(n), state, lambda a, k: F.struct((a["at"] + length_of(k)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.get(x["b"], i)
            end = start + F.get(x["m"], i)
            one = F.struct(start.alias("start"), F.lit(at).alias("at"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            more = F.when(F.get(x["g"], i) >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
            return F.struct(end.alias("at"), more.alias("out"))

        def block(k: Column, start: Column) -> Column:
            inside = F.sequence(k * _BLOCK, F.least(n, (k + 1) * _BLOCK) - 1)
            return F.aggregate(inside, F.struct(start.alias("at"), none.alias("out")), add, lambda a: a["out"])

        return F.flatten(F.zip_with(_blocks(n), starts, block))

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans (sorted by start) replaced by the mark."""
    n = F.size(spans)

    def part(k: Column) -> Column:
        return F.slice(spans, k * _BLOCK + 1, F.lit(_BLOCK))

    def reached(a: Column, k: Column) -> Column:
        far = F.greatest(a["at"], F.array_max(F.transform(part(k), lambda s: s["end"])))
        return F.struct(far.alias("at"), F.concat(a["out"], F.array(far)).alias("out"))

    reach = F.aggregate(_blocks(n), F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("out")), reached, lambda a: a["out"])

    def rebuilt(ends: Column) -> Column:
        def block(k: Column) -> Column:
            base = F.get(ends, k)
            segment = F.substring(text, base + 1, F.get(ends, k + 1) - base)
            return _let(F.struct(base.alias("base"), segment.alias("text")), lambda y: F.aggregate(part(k), F.struct(y["base"].alias("at"), F.lit("").alias("out")), add(y), lambda a: a["out"]))

        def add(y: Column):
            def step(a: Column, s: Column) -> Column:
                gap = F.substring(y["text"], a["at"] - y["base"] + 1, s["start"] - a["at"])
                out = F.when(s["start"] >= a["at"], F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"])
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

            return step

        rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(_blocks(n), block), ""), rest)

    return F.when(n == 0, text).otherwise(_let(reach, rebuilt))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or e):
            return None
        raise


def update_ledger(df: DataFrame, ledger_path: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the blobs of df for the rule versions that the ledger at
    `ledger_path` hasn't got, appends what is found, and returns the ledger."""
    spark = df.sparkSession
    texts = picked(df, text=(text_col, "string")).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.unhex(F.sha2("text", 256)))
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    known = _ledger(spark, ledger_path)
    keys = F.array(*[F.lit(r.key) for r in rules])
    if known is None:
        pending = blobs.withColumn("todo", keys)
    else:
        seen = known.select("blob", F.explode("scanned").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("seen"))
        todo = F.array_except(keys, F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        pending = blobs.join(seen, "blob", "left").withColumn("todo", todo).filter(F.size("todo") > 0)
    spans = [F.when(F.array_contains("todo", r.key), rule_spans(F.col("text"), r, i)).otherwise(F.expr(_NONE)) for i, r in enumerate(rules)]
    rows = pending.select("blob", F.col("todo").alias("scanned"), F.concat(*spans).alias("spans"))
    rows.write.mode("append").parquet(ledger_path)
    return _ledger(spark, ledger_path)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(df: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts per base kind, the base spans' digest and all spans.

    Without a ledger_path an empty ledger is begun in the shared folder. A
    null text is an empty blob; a null id stays null; documents with equal texts, and repeated
    rows, share a blob and each get its findings; other columns are ignored;
    an empty table gives an empty result.
    """
    ledger = update_ledger(df, ledger_path or fresh_dir(df.sparkSession, "ledger"), text_col)
    paths = id_and_text(df, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"))
    hits = _hits(ledger)
    rows = salted_left_join(paths, hits, "blob").withColumn("spans", F.coalesce("__spans", F.expr(_NONE)))
    base = F.filter("spans", lambda s: s["at"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _hits(ledger: DataFrame) -> DataFrame:
    return ledger.select("blob", F.explode("spans").alias("s")).groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("__spans"))


def redact_secrets(df: DataFrame, ledger_path: str | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every found span replaced by `mark`; overlapping spans get one."""
    ledger = update_ledger(df, ledger_path or fresh_dir(df.sparkSession, "ledger"), text_col)
    at = place(df, text_col)
    paths = numbered(df).withColumn("__text", F.coalesce(F.col(at).cast("string"), F.lit(""))).withColumn("blob", F.unhex(F.sha2("__text", 256)))
    rows = salted_left_join(paths, _hits(ledger), "blob")
    clean = masked(F.col("__text"), F.col("__spans"), mark)
    kept = F.when(F.col("__spans").isNull(), F.col(at)).otherwise(clean)
    return rows.select(*[kept if f"__c{i}" == at else F.col(f"__c{i}") for i in range(len(df.columns))]).toDF(*df.columns)
