"""File sources and sinks."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import parse_time

_WIDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest common type: the wider number, an instant for both kinds of time, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WIDER and type(b) in _WIDER:
        wide = max(_WIDER.index(type(a)), _WIDER.index(type(b)))
        return T.DoubleType() if wide == 4 and T.LongType in (type(a), type(b)) else _WIDER[wide]()
    if {type(a), type(b)} == {T.TimestampType, T.TimestampNTZType}:
        return T.TimestampType()
    return T.StringType()


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns by name, cast to their common type."""
    kinds: dict[str, T.DataType] = {}
    for f in frames:
        for x in f.schema.fields:
            kinds[x.name] = supertype(kinds.get(x.name, x.dataType), x.dataType)
    cast = [f.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in f.columns]) for f in frames]
    out = cast[0]
    for f in cast[1:]:
        out = out.unionByName(f)
    return out


def read_many(spark: SparkSession, *paths: str) -> DataFrame:
    """One frame of files whose types may differ; raises if there are none."""
    if not (there := [p for p in paths if _exists(spark, p)]):
        raise FileNotFoundError(f"no such files: {', '.join(paths)}")
    return union_relaxed([spark.read.parquet(p) for p in there])


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _exists(spark, path) else None


def times_parsed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that are text, as instants where they parse."""
    text = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: parse_time(c) for c in text}) if text else df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, comment: str | None = None, infer: bool = False) -> DataFrame:
    """A CSV file with a header; with a schema in that order, else as text, or with types inferred from all of it.

    Lines that begin with comment are left out.
    """
    r = spark.read.option("header", True).option("enforceSchema", False).option("inferSchema", infer)
    if comment:
        r = r.option("comment", comment)
    return r.schema(schema).csv(path) if schema else r.csv(path)


def read_sheet(spark: SparkSession, path: str, numbers: Sequence[str] = (), dates: Sequence[str] = ()) -> DataFrame:
    """A spreadsheet's data, exported to CSV: text, but for the named columns, which are null where a cell doesn't parse."""
    d = read_csv(spark, path)
    return d.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in numbers} | {c: F.col(f"`{c}`").try_cast("date") for c in dates})


def fetched(folder: str, name: str, fetch: Callable[[], bytes]) -> Path:
    """The file in the folder; made by fetch if it isn't there.  It gets its name when it is whole."""
    path = Path(folder) / name
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{name}.{os.getpid()}")
        part.write_bytes(fetch())
        part.replace(path)
    return path


def fetch_chunks(chunks: Iterable, fetch: Callable[..., bytes], folder: str, name: Callable[..., str], tries: int = 3, wait: float = 2.0, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> list[Path]:
    """A file for each chunk (a month's edges, say).  A failing fetch is tried again after a wait that doubles each time.

    pause: seconds between fetches.  Files that are there already are not fetched.
    """

    def with_retries(chunk) -> bytes:
        for turn in range(tries):
            try:
                return fetch(chunk)
            except OSError:
                if turn == tries - 1:
                    raise
                sleep(wait * 2**turn)
        raise ValueError("tries is below 1")

    out = []
    for chunk in chunks:
        there = (Path(folder) / name(chunk)).exists()
        out.append(fetched(folder, name(chunk), lambda c=chunk: with_retries(c)))
        if pause and not there:
            sleep(pause)
    return out


def fetch_pages(fetch: Callable[[str | None], dict], items: str = "items", cursor: str = "nextCursor") -> Iterator[dict]:
    """The items of a paged listing, page after page until one names no next cursor; a cursor that comes again raises."""
    at, seen = None, set()
    while True:
        page = fetch(at)
        yield from page.get(items) or []
        at = page.get(cursor)
        if not at:
            return
        if at in seen:
            raise ValueError(f"the listing goes in a circle: {at}")
        seen.add(at)


def read_pages(spark: SparkSession, path: str, schema: str, items: str = "items") -> DataFrame:
    """The items of saved JSON pages, a row each."""
    return spark.read.option("multiLine", True).json(path, schema=f"{items} array<struct<{schema}>>").select(F.explode(items).alias("_x")).select("_x.*")


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A report's table.  For results of at most `most` rows; more raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are not a report")

    def cell(x) -> str:
        if x is None:
            return "-"
        return f"{x:,.{digits}f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    lines = [df.columns, ["---"] * len(df.columns), *[[cell(x) for x in r] for r in rows]]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)
