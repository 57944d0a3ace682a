"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import settle

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only the id and the text, a null text as the empty text."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Functions that empty what a module remembers between rows; a task calls them when it ends.
FORGET: list[Callable[[], None]] = []


def resting(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same stage function; after its task, idle workers keep neither remembered rows nor freed memory.

    Workers outlive their tasks, and several of them wait next to the one at work.
    """
    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for forget in FORGET:
                forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own counsel
                pass

    return wrapped


def map_texts(df: DataFrame, schema: str, each: Callable[[list, list], dict]) -> DataFrame:
    """Run `each(ids, texts as bytes)` over Arrow batches of `(id, text)` rows; it returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                columns = each(part.column(0).to_pylist(), texts)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(resting(run), schema)


#: Edges to a task of `min_label`.
EDGES = 250_000


def min_label(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges as `(node, root)`, root being the smallest node of the component.

    Alternates large-star and small-star steps, each two narrow shuffles over the edge list, and stores the edges
    after every round. A node's partners never meet in one task; only their minimum does. Each step runs in as many tasks as
    the edges ask for: files of a shuffle are tasks times partitions, and there are several shuffles to a round.
    """
    def gathered(df: DataFrame) -> DataFrame:
        return df.coalesce(tasks)

    edges = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    tasks = max(8, -(-edges.count() // EDGES))
    edges, seen = gathered(edges), None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = gathered(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = gathered(gathered(large).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        low = gathered(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(gathered(gathered(small.union(low.select("a", F.col("m").alias("b"))).filter("a <> b")).distinct()))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).distinct()


def rewrite_texts(docs: DataFrame, extras: str, each: Callable[..., dict], reads: tuple[str, ...] = ()) -> DataFrame:
    """All columns with `text` replaced and the `extras` added; `each(texts as bytes or None, values of the columns read)` returns both by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*docs.schema.fields, *_parse_datatype_string(extras).fields])
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                new = each(part.column("text").cast(pa.binary()).to_pylist(), *(part.column(n).to_pylist() for n in reads))
                columns = {n: part.column(n) for n in part.schema.names} | {n: pa.array(v, fields.field(n).type) for n, v in new.items()}
                yield pa.RecordBatch.from_arrays([columns[n].cast(fields.field(n).type) for n in fields.names], schema=fields)

    return docs.mapInArrow(resting(run), schema)


def with_length(docs: DataFrame) -> DataFrame:
    """`n_chars`, where a table has it, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


#: A key is heavy when it holds more than this part of all rows, so there are at most as many heavy keys as its inverse.
HEAVY_PART = 1 / 1000


def join_heavy(rows: DataFrame, classes: DataFrame, sizes: DataFrame, key: str, size: str) -> DataFrame:
    """Join one class row per key onto rows where a few keys may hold most of them.

    `sizes` counts the rows of each key. Keys above `HEAVY_PART` of all rows, at most 1,000, are joined by
    broadcast and never shuffled by key; all others by an ordinary join.
    """
    total = sizes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    heavy = sizes.filter(F.col(size) > total * HEAVY_PART).select(key)
    few = classes.join(F.broadcast(heavy), key, "left_semi")
    names = [c for c in classes.columns if c != key]
    marked = rows.join(F.broadcast(few.withColumn("_few", F.lit(True))), key, "left")
    light = rows.join(F.broadcast(heavy), key, "left_anti").join(classes, key)
    return marked.filter("_few").select(*rows.columns, *names).unionByName(light.select(*rows.columns, *names))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
