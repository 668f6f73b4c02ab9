"""Place tables: logical columns over physical ones, and their hierarchy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hierarchy:
    """Administrative levels from wide to narrow; a level's key is all columns down to it."""

    levels: tuple[str, ...] = ("city", "county", "township")

    def key(self, level: str) -> list[str]:
        return [*self.levels[: self.levels.index(level) + 1]]


@dataclass(frozen=True)
class PlaceSchema:
    """Logical name -> expression over the physical table."""

    columns: dict[str, str]
    hierarchy: Hierarchy = field(default_factory=Hierarchy)

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.expr(e).alias(n) for n, e in self.columns.items()])

    def missing(self, df: DataFrame) -> list[str]:
        """Logical columns that the table cannot give."""
        out = []
        for name, e in self.columns.items():
            try:
                df.select(F.expr(e)).schema  # noqa: B018  (analysis only)
            except Exception:  # noqa: BLE001
                out.append(name)
        return out


#: The driver's part table in the roles of a place table.
PARTS = PlaceSchema({"id": "p_partkey", "city": "p_brand", "county": "p_type", "township": "cast(p_size as string)", "name": "p_name"})
#: Customers with coordinates derived from their keys.
CUSTOMERS = PlaceSchema(
    {
        "id": "c_custkey",
        "city": "cast(c_nationkey as string)",
        "county": "c_mktsegment",
        "name": "c_name",
        "lon": "109.67D + ((c_custkey * 7919) % 7640) / 1000.0D",
        "lat": "20.23D + ((c_custkey * 104729) % 5370) / 1000.0D",
    },
    Hierarchy(("city", "county")),
)
PLACES_SQL = "places AS (SELECT p_partkey AS id, p_brand AS city, p_type AS county, CAST(p_size AS VARCHAR) AS township, p_name AS name FROM part)"
POINTS_SQL = (
    "points AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS city, c_mktsegment AS county, c_name AS name, "
    "CAST(109.67 AS DOUBLE) + ((c_custkey * 7919) % 7640) / CAST(1000.0 AS DOUBLE) AS lon, "
    "CAST(20.23 AS DOUBLE) + ((c_custkey * 104729) % 5370) / CAST(1000.0 AS DOUBLE) AS lat FROM customer)"
)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PARTS.select(spark.read.parquet(f"{sf_dir}/part.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CUSTOMERS.select(spark.read.parquet(f"{sf_dir}/customer.parquet"))


def load_places(df: DataFrame, schema: PlaceSchema = PARTS, **equal: str | None) -> DataFrame:
    """Projected scan with equality filters on hierarchy columns."""
    out = schema.select(df)
    for column, value in equal.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def load_coordinates(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float] = (73.0, 136.0, 3.0, 54.0)) -> DataFrame:
    """Rows with numeric coordinates inside (west, east, south, north)."""
    x, y = F.col(lon).try_cast("double"), F.col(lat).try_cast("double")
    return df.withColumns({lon: x, lat: y}).filter(F.col(lon).between(box[0], box[1]) & F.col(lat).between(box[2], box[3]))


def missing_columns(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Names that the table lacks or has with another type."""
    have = dict(df.dtypes)
    return sorted(n for n, t in expected.items() if have.get(n) != t)


def with_ids(df: DataFrame, order: list[str], prefix: str = "v_") -> DataFrame:
    """Identifiers that depend on the row's content only."""
    return df.withColumn("village_id", F.concat(F.lit(prefix), F.hex(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in order]))))


def with_committees(df: DataFrame, committee: str = "committee") -> DataFrame:
    """The places and, as rows of their own, the distinct committees."""
    others = [c for c in df.columns if c not in ("city", "county", "township", committee, "name")]
    rows = df.filter(F.col(committee).isNotNull()).select("city", "county", "township", committee).distinct()
    rows = rows.select("*", F.col(committee).alias("name"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in others])
    return df.unionByName(rows.select(*df.columns))


def level_name(level: Column, names: dict[str, str]) -> Column:
    """A level's name in another vocabulary; unknown names stay."""
    pairs = [F.lit(x) for p in names.items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level), level)
