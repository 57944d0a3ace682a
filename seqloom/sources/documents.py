"""Document libraries: one JSON object per file, with a rule column per contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CARD_SCHEMA = (
    "schema_version int, card_id string, version int, card_type string, family string, tags array<string>, title string, "
    "authors array<string>, year int, source_url string, source_locator string, claim_confidence string, mechanism string, "
    "useful_when string, limitations string, verified_on string"
)
# Allowed categories, patterns and limits of a card.
CARD_TYPES = ("paper", "concept")
CONFIDENCE = ("high", "moderate", "limited")
ID_PATTERN = "^[a-z][a-z0-9_-]{2,63}$"
URL_PATTERN = r"^https://\S+$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
YEARS = (1900, 2100)
LIST_LIMIT = 12
SIZE_LIMIT = 5_000


def read_documents(spark: SparkSession, path: str, schema: str = CARD_SCHEMA, bundled: bool = False) -> DataFrame:
    """All documents of a folder, with the file name without its ending as `file_id`.

    A file holds one document; in a bundled folder (`write_bundles`) it holds one per line, next to the name it would have.
    Opening, listing and renaming files costs some milliseconds each, so large libraries are bundled.
    """
    if bundled:
        return spark.read.schema(f"{schema}, file_id string").json(path)
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return df.select("*", name.alias("file_id"))


def write_bundles(df: DataFrame, path: str, name: Column) -> None:
    """Documents as lines of as many files as `df` has partitions, each line with its `file_id`."""
    df.withColumn("file_id", name).write.json(path)


def failed_rules(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that do not hold; an unknown answer counts as a failure."""
    return F.sort_array(F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ])))


def text_ok(c: Column, limit: int, forbidden: str | None = None) -> Column:
    ok = c.isNotNull() & (F.length(F.trim(c)) > 0) & (F.length(F.trim(c)) <= limit)
    return ok & ~F.lower(c).rlike(forbidden) if forbidden else ok


def list_ok(c: Column, limit: int, item_limit: int, forbidden: str | None = None) -> Column:
    return c.isNotNull() & (F.size(c) > 0) & (F.size(c) <= limit) & F.forall(c, lambda x: text_ok(x, item_limit, forbidden))


def card_rules(texts: Sequence[str], forbidden: str | None = None) -> dict[str, Column]:
    """Rules of a research card."""
    rules = {f"text_{t}": text_ok(F.col(t), 600, forbidden) for t in texts}
    rules |= {f"list_{t}": list_ok(F.col(t), LIST_LIMIT, 120, forbidden) for t in ("tags", "authors")}
    return rules | {
        "schema_version": F.col("schema_version") == 1,
        "card_type": F.col("card_type").isin(*CARD_TYPES),
        "claim_confidence": F.col("claim_confidence").isin(*CONFIDENCE),
        "card_id": F.col("card_id").rlike(ID_PATTERN),
        "version": F.col("version") >= 1,
        "year": F.col("year").between(*YEARS),
        "source_url": F.col("source_url").rlike(URL_PATTERN),
        "verified_on": F.col("verified_on").rlike(DATE_PATTERN),
        "file_name": F.col("card_id") == F.col("file_id"),
    }


def validate_documents(df: DataFrame, rules: dict[str, Column], size_limit: int | None = SIZE_LIMIT) -> DataFrame:
    """Add `failed`, the list of broken rules; an accepted document has an empty one."""
    if size_limit is not None:
        everything = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
        rules = rules | {"size": F.length(everything) <= size_limit}
    return df.withColumn("failed", failed_rules(rules))


def duplicate_sources(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of each listed column that occur more than once."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("_c")).select("_c.*").groupBy("field", "value").agg(F.count("*").alias("uses")).filter("uses > 1")
