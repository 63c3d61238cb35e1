"""Line dedup: runs of lines that occurred before are deleted.

A document is a sequence of line ids: its lines that have a word, in order; an id is the line's MD5.  The suffixes of all
sequences are ranked by distributed prefix doubling: round k orders them by their first 2**k lines, from the ranks of the
first and second halves.  Suffixes alike so far are an interval of the suffix array with a longest common prefix of 2**k
lines or more; its left end is their rank.  Only suffixes whose interval holds others go on: the array has places for those
alone.  Any run of lines, of length l, is an interval too: that of the suffixes with one rank for the first 2**k lines and
one rank for the last 2**k lines, for the largest 2**k up to l, so with a longest common prefix of l or more.  The first of
them (by document id, then line) is the run's first place.

A run qualifies with at least `min_words` words.  The maximal repeated runs that qualify are the unions of their least
qualifying runs (from each line on, and up to each line), so those are looked up, and rounds end where they are covered.
Every line of a qualifying run that begins earlier too is deleted; the first place of a run stays, unless another run's
copy covers it.  Where copies overlap, the one that begins earlier is the first.  Lines are compared without the ASCII white
space at their ends.

Inputs that need a rule: a null text stays null and has no lines; lines without words belong to no run and stay, but a
text left without words becomes empty; documents with a null id come last; rows alike in id and text are one document,
first or later as one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_total
from ..tables import stored
from .common import rename_inputs

MIN_WORDS = 10
BLANK = " \t\n\x0b\x0c\r"
_DOC = ("late", "id", "key")


def least_runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that have min_words words and lose them without their first or their last line."""
    sums = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    start = np.arange(n)
    end = np.searchsorted(sums, sums[:-1] + min_words)  # the least from each line on
    runs = [np.stack([start, end - start])[:, end <= n]]
    stop = np.arange(1, n + 1)
    begin = np.searchsorted(sums, sums[1:] - min_words, "right") - 1  # the least up to each line
    runs.append(np.stack([begin, stop - begin])[:, begin >= 0])
    found = np.unique(np.concatenate(runs, axis=1), axis=1)
    return found[0], found[1]


def _sequences(min_words: int):
    schema = pa.schema([("late", pa.bool_()), ("id", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("runs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, places, offsets, lengths = [], [], [], [0], []
            for i, text in enumerate(batch["text"]):
                # bytes are stripped and split at ASCII white space alone
                lines = [s for x in (text.as_py() or "").encode().split(b"\n") if (s := x.strip())]
                if not lines:
                    continue
                words = np.fromiter((len(s.split()) for s in lines), np.int64, len(lines))
                start, length = least_runs(words, min_words)
                cuts = np.searchsorted(start, np.arange(len(lines) + 1))
                rows.append(np.full(len(lines), i))
                places.append(np.arange(len(lines)))
                hashes.extend(hashlib.md5(s, usedforsecurity=False).digest() for s in lines)
                lengths.append(length)
                offsets.extend((cuts[1:] + offsets[-1]).tolist())
            if not rows:
                continue
            take = pa.array(np.concatenate(rows))
            ab = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lengths), pa.int32()))
            yield pa.record_batch([*[batch[c].take(take) for c in _DOC], pa.array(np.concatenate(places), pa.int32()), pa.array(ab[:, 0]), pa.array(ab[:, 1]), runs], schema=schema)

    return run


def _ranked(here: DataFrame, step: int) -> DataFrame:
    """Of suffixes with the classes a and b of their halves: lo, the left end of their interval; those alone in it go."""
    many = here.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    many = running_total(many, [F.col("a").asc(), F.col("b").asc()], F.col("n"), "end")
    # intervals are a table before they are joined back, so that a hot interval's side of the join can be split
    many = stored(many.select("a", "b", (F.col("end") - F.col("n")).alias("lo")), f"intervals{step}")
    return stored(here.join(many, ["a", "b"]).select(*_DOC, "place", "lo", "runs"), f"ranks{step}")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(late, id, key, runs): of the documents with later copies, the runs to delete as (start, length)."""
    here = stored(_keyed(docs, doc_id, text).mapInArrow(_sequences(min_words), "late boolean, id bigint, key bigint, place int, a bigint, b bigint, runs array<int>"), "lines")
    place = F.struct(*_DOC, "place")
    found, step = None, 1
    while True:
        here = _ranked(here, step)
        sized = here.select(*_DOC, "place", "lo", F.explode(F.filter("runs", lambda x: (x >= step) & (x < 2 * step))).alias("length"))
        if step > 1:
            tail = here.select(*_DOC, F.col("place").alias("tail"), F.col("lo").alias("end"))
            sized = sized.withColumn("tail", F.col("place") + F.col("length") - step).join(tail, [*_DOC, "tail"])
        else:
            sized = sized.withColumn("end", F.col("lo"))
        sized = sized.select(*_DOC, "place", "lo", "end", "length")
        firsts = sized.groupBy("lo", "end", "length").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        firsts = stored(firsts, f"firsts{step}")
        later = sized.join(firsts, ["lo", "end", "length"]).where(place != F.col("first")).select(*_DOC, "place", "length")
        later = stored(later, f"later{step}")
        found = later if found is None else found.union(later)
        # suffixes from which a longer run is still to be looked up, and those that its end needs
        longest = here.agg(F.max(F.array_max("runs"))).first()[0]
        if not longest or longest < 2 * step:
            break
        ahead = here.select(*_DOC, (F.col("place") - step).alias("place"), F.col("lo").alias("b"))
        here = here.join(ahead, [*_DOC, "place"]).select(*_DOC, "place", F.col("lo").alias("a"), "b", "runs")
        step *= 2
    return found.groupBy(*_DOC).agg(F.collect_list(F.struct("place", "length")).alias("cut"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    d = rename_inputs(docs, doc_id=doc_id, text=text)
    return d.select("doc_id", F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("key"), "text")


def cut_lines(text: str, start: np.ndarray, length: np.ndarray) -> tuple[str, int, int]:
    """The text without the runs, the lines deleted and the maximal runs that they form."""
    lines = text.split("\n")
    solid = [i for i, x in enumerate(lines) if x.strip(BLANK)]
    cover = np.zeros(len(solid) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + length, -1)
    gone = np.cumsum(cover)[:-1] > 0
    runs = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
    if gone.all():
        return "", len(solid), runs
    drop = {solid[i] for i in np.flatnonzero(gone).tolist()}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(drop), runs


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64())])
    for batch in batches:
        rows = []
        for key, value, cut in zip(batch["doc_id"].to_pylist(), batch["text"], batch["cut"], strict=True):
            text, removed, runs = value.as_py(), 0, 0
            n = sum(1 for x in (text or "").split("\n") if x.strip(BLANK))
            if cut.is_valid:
                at = cut.values
                text, removed, runs = cut_lines(text, at.field("place").to_numpy(), at.field("length").to_numpy())
            rows.append((key, text, n, removed, runs))
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without later copies, n_lines, n_removed and n_runs, for every document."""
    return _deduped(docs, doc_id, text, min_words).drop("row")


def rewrite(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their own columns, the text without later copies and its length renewed.

    A document that is left without a line, all of it being later copies, goes.
    """
    out = _deduped(docs, doc_id, text, min_words).where("n_removed = 0 OR n_removed < n_lines")
    new = {text: F.col("text"), n_chars: F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(f"row.`{n_chars}`"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _deduped(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    cut = copies(docs, doc_id, text, min_words)
    # the other columns go along, the text once
    rest = [docs[f"`{c}`"] for c in docs.columns if c != text]
    d = docs.select(F.struct(*rest).alias("row"), docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    d = d.select("row", "doc_id", F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    joined = d.join(cut, list(_DOC), "left").select("doc_id", "text", "cut", "row")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_with_row, f"doc_id bigint, text string, n_lines bigint, n_removed bigint, n_runs bigint, row {kind}")


def _with_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in _cut(iter([batch])):
            yield pa.record_batch([*out.columns, batch["row"]], names=[*out.schema.names, "row"])
