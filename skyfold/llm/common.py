"""Helpers that several operators share: tables in the shared folder, word hashes, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import drop_stored, shuffles_dropped, stored

#: Words are the longest runs of code points outside these ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Edges of a graph, or parents of a forest, that one task solves at most: 16 bytes each there.  Beyond them distributed steps do.
FEW = 1 << 18

_U = np.uint64
#: An odd base and its inverse modulo 2**64, for hashes of byte ranges out of running sums.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For jobs that run inside: texts go to Python by so many rows at most, so that long ones need little memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def rename_inputs(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the names that an operator uses inside: other columns of df can't clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in names.items()])


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_POWERS = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def powers(n: int, down: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse."""
    key, base = ("down", _BASE_INV) if down else ("up", _BASE)
    have = _POWERS[key]
    while len(have) < n:
        step = _U(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _POWERS[key] = have
    return have[:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row begins (with the end): nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column holds about limit bytes in each: temporary arrays stay small."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        _, at = buffer_of(column)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z in lower case, and the row of each word."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)  # where a row begins, a word begins
    edge[at] = True
    solid = ~gap
    before = np.concatenate([[False], solid[:-1]])
    first = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    last = np.flatnonzero(solid & (~after | edge[1:])) + 1
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((low.astype(_U) + _U(1)) * powers(len(data)), out=sums[1:])
    h = mix64((sums[last] - sums[first]) * powers(len(data) + 1, down=True)[first])
    return h, np.searchsorted(at, first, "right") - 1


def _solved(pairs: DataFrame, solve: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """(node, root) by one task, of a stored table of two columns that are not null and `FEW` rows at most."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if rows:
            node, root = solve(*(np.concatenate(x) for x in zip(*rows, strict=True)))
            yield pa.record_batch([pa.array(node), pa.array(root)], schema=schema)

    return stored(pairs.coalesce(1).mapInArrow(run, "node bigint, root bigint"), name)


def _jumped(node: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(node)
    node, parent = node[order], parent[order]
    at = np.minimum(np.searchsorted(node, parent), len(node) - 1)
    up = np.where(node[at] == parent, at, np.arange(len(node)))
    while (more := up[up]).tolist() != up.tolist():
        up = more
    return node, parent[up]


def _least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while (root[u] != root[v]).any():
        x, y = root[u], root[v]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def forest_roots(parents: DataFrame, name: str = "roots", few: int = FEW) -> DataFrame:
    """(node, root) of a forest given as (node, parent), one parent each, by pointer jumping: rounds by log of the depth.

    The join's other side is a table with one row for each node, so a parent of very many nodes can be split.  A forest of
    up to `few` rows takes one task.
    """
    p = stored(parents.select("node", "parent"), name)
    if p.count() <= few:
        out = _solved(p, _jumped, name)
        drop_stored(p)
        return out
    while True:
        up = p.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        last, p = p, stored(p.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), name)
        drop_stored(last)
        with shuffles_dropped(p.sparkSession):
            moved = p.where("moved").limit(1).count()
        if not moved:
            return p.select("node", F.col("parent").alias("root"))


def components(edges: DataFrame, name: str = "components", few: int = FEW) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges (a, b) reaches.

    Alternating large-star and small-star steps.  Each step is a minimum by node, joined back: a node with very many
    neighbours is pre-aggregated before the shuffle, and its join side can be split.  The edges of each step are
    written to the shared folder, in place of the last one's.  As soon as there are `few` edges or less, one task
    solves the rest.  Null ends and loops are left out.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = stored(e.distinct(), name)
    left = e.count()
    while left > few:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        small = stored(small, name)
        drop_stored(e)
        # a forest of stars that a step leaves as it was is the end: no root has a parent, no node has two
        ends = small.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(small.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        with shuffles_dropped(small.sparkSession):
            more, left = ends.agg(F.max(F.expr("up > 1 OR up = 1 AND down = 1")), F.sum("up")).first()
        if not more:
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = small
    out = _solved(e, _least_reached, name)
    drop_stored(e)
    return out
