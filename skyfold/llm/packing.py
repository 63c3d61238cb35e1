"""Best-fit packing with certified partitions.

Documents become token pieces of at most one sequence.  Pieces that fill a sequence are placed at once; the others are
dealt over partitions, each packed by best-fit decreasing.  Dual feasible functions give a lower bound on the sequences
that a partition needs: one that meets its bound is certified and done.  A partition with a gap gives up the documents
of its sequences that are not full; those of all such partitions are exchanged (dealt anew, over fewer partitions) and
packed again, as long as that lowers the sum of the gaps.  Each row says how many sequences its part of the packing has
and the bound on them, so what stays without a certificate is seen: part_bins is above part_bound.

Inputs that need a rule: a null text is an empty one, which is the single end id; repeated rows are documents of their
own; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import stored
from . import tokens
from .common import rename_inputs

CAPACITY = 2048
END_ID = 0
#: Pieces for one packing task.  More of them waste less, and bound the task's memory (some 100 bytes each).
PER_PARTITION = 1 << 16
#: Rounds at most; far fewer are run, as one that doesn't lower the gaps is the last.
ROUNDS = 100

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, where: str | None = None, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and with ids the ids themselves.

    A document longer than the capacity is cut from its end into pieces of the capacity, so the first may be shorter.
    """
    where = where or tokens.folder()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = np.append(tokens.encode(text.as_py() or "", where), np.uint32(END_ID)).astype("<u4")
                cuts = [0, *range(len(found) % capacity or capacity, len(found) + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((key.as_py(), n, a, b - a, zlib.crc32(found[a:b].tobytes()), *[found[a:b].view("<i4")] * ids))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return rename_inputs(docs, doc_id=doc_id, text=text).mapInArrow(run, _PIECES + ", ids array<int>" * ids)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, steps: int = 40) -> int:
    """The sequences that pieces of these sizes need at least: the best of two families of dual feasible functions."""
    if not len(sizes):
        return 0
    kinds, counts = np.unique(sizes, return_counts=True)
    best = -(-int((kinds * counts).sum()) // capacity)
    # whole above 1 - e, nothing below e, itself between
    for e in [x for x in np.unique(np.append(kinds[2 * kinds <= capacity], 0)) if x][:: max(1, len(kinds) // steps)]:
        value = np.where(kinds > capacity - e, capacity, np.where(kinds < e, 0, kinds))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    # rounded down to a multiple of 1/k, except where (k + 1) times the size is whole
    for k in range(1, steps):
        whole, rest = np.divmod((k + 1) * kinds, capacity)
        value = np.where(rest == 0, kinds * k, whole * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins.

    The bins with each free length are a stack; a bit set of the free lengths that occur finds the least that is enough.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, made = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = have >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                have &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            if not free[room - size]:
                have |= 1 << (room - size)
            free[room - size].append(b)
    return bins, offsets, made


def _packer(capacity: int, step: int) -> Callable[[pa.Table], pa.Table]:
    """Packs a partition; _open marks what a partition without a certificate gives up."""

    def run(part: pa.Table) -> pa.Table:
        number = part["_part"][0].as_py() if part.num_rows else 0
        part = part.drop_columns("_part")
        sizes, keys = part["length"].to_numpy().astype(np.int64), part["_key"].to_numpy()
        bins, offsets, made = best_fit_decreasing(sizes, capacity)
        first = np.full(made, np.iinfo(np.int64).max)
        np.minimum.at(first, bins, keys)
        fill = np.bincount(bins, weights=sizes, minlength=made)
        bound = lower_bound(sizes, capacity)
        gives = fill < capacity if made > bound else np.zeros(made, bool)
        freed = gives[bins]
        closed = int((~gives).sum())
        # full sequences are as few as can be; the others are held against the bound of what is in them
        rest = lower_bound(sizes[freed], capacity) if freed.any() else 0
        values = {
            "sequence_id": first[bins],  # the least key in it: no other sequence has that piece
            "offset": offsets,
            "part": (2 * step + freed) * (1 << 32) + number,
            "part_bins": np.where(freed, made - closed, closed),
            "part_bound": np.where(freed, rest, bound if not freed.any() else closed),
            "_open": freed,
        }
        for name, column in values.items():
            part = part.append_column(name, pa.array(column))
        return part

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """items (at least: length, at most the capacity) with sequence_id, offset, part, part_bins and part_bound.

    sequence_id is unique over rounds and partitions.  part: what was certified, or not, as one; the sequences in it and the
    bound on them.  A piece that fills a sequence is a part of its own (null).  items are written to the shared folder once,
    with a row key that holds from there on.  Keys and lengths alone are packed, whatever else the items have; their places
    come back by the key.  Each round's result is written too, as the next round and the answer both read it.
    """
    items = stored(items.withColumn("_key", F.monotonically_increasing_id()), "pieces")
    more = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "part", "part_bins", "part_bound")]
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("length", T.LongType()), *more, T.StructField("_open", T.BooleanType())])
    sizes, full = items.select("_key", F.col("length").cast("long").alias("length")), F.col("length") >= capacity
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    done, left, last = [], sizes.where(~full), None
    for step in range(rounds):
        n = left.count()
        if not n:
            break
        parts = -(-n // per_partition)
        dealt = left.withColumn("_part", F.pmod(F.xxhash64("_key", F.lit(step)), F.lit(parts)))
        out = stored(dealt.groupBy("_part").applyInArrow(_packer(capacity, step), schema), "packed")
        gap = out.where("_open").select("part", "part_bins", "part_bound").distinct().agg(F.sum(F.col("part_bins") - F.col("part_bound"))).first()[0]
        if gap is None or parts == 1 or step == rounds - 1 or last is not None and gap >= last:
            done.append(out)
            break
        done.append(out.where("NOT _open"))
        left, last = out.where("_open").select("_key", "length"), gap
    names = [f.name for f in more]
    whole = items.where(full).select("*", F.col("_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), none.alias("part"), one.alias("part_bins"), one.alias("part_bound"))
    if done:
        places = reduce(DataFrame.unionByName, done).select("_key", *names)
        whole = whole.unionByName(items.where(~full).join(places, "_key"))
    return whole.drop("_key")
