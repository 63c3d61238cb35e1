"""Token counts by field or section, with tokens mapped to character spans.

A document is encoded once, as a whole, so that its tokens are those a model sees.  Each token's character span follows
from the bytes its id stands for.  The spans are then joined with the sections' spans: both are sorted, so a binary
search of the sections' bounds in the tokens' bounds is the interval join.  A token that crosses a bound goes by rule:

    first  to the section of its first character (the rule of the query)
    last   to the section of its last character
    most   to the section with most of its characters, the earlier of equals
    split  to each section by its share of the characters, as a double

Inputs that need a rule: a null text is an empty one; an empty text is one empty section with no token; repeated rows
are documents of their own; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .common import rename_inputs


def line_sections(raw: np.ndarray) -> np.ndarray:
    """The byte bounds of a text's lines, with the first 0 and the last the text's end; a line feed ends its line."""
    ends = np.flatnonzero(raw == 10) + 1
    return np.unique(np.concatenate([[0], ends, [len(raw)]])) if len(raw) else np.array([0, 0])


def token_bounds(ids: np.ndarray, where: str) -> np.ndarray:
    """The byte bounds of the tokens, from 0 to the text's end."""
    return np.concatenate([[0], np.cumsum(tokens.byte_lengths(where)[ids])]).astype(np.int64)


def char_starts(raw: np.ndarray) -> np.ndarray:
    """For each byte bound, the characters that begin before it."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]).astype(np.int64)


def allocate(bounds: np.ndarray, sections: np.ndarray, chars: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section.  All bounds are in bytes; chars turns them into characters.

    A token of only a part of a character's bytes has that character's span.
    """
    n = len(sections) - 1
    a, b = bounds[:-1], bounds[1:]
    cut = sections[1:-1]
    owner = lambda byte: np.searchsorted(cut, byte, "right")
    if rule == "first":
        # the section of the character that holds the token's first byte; sections begin at characters
        return np.bincount(owner(a), minlength=n)
    if rule == "last":
        return np.bincount(owner(b - 1), minlength=n)
    lo, hi = owner(a), owner(b - 1)
    out = np.zeros(n, np.float64 if rule == "split" else np.int64)
    same = lo == hi
    out += np.bincount(lo[same], minlength=n)
    for t in np.flatnonzero(~same):
        edges = np.concatenate([[a[t]], sections[lo[t] + 1 : hi[t] + 1], [b[t]]])
        # the first edge may lie within a character: that character counts
        at = chars[edges]
        at[0] -= a[t] < len(chars) - 1 and bool(chars[a[t] + 1] == chars[a[t]])
        share = np.diff(at)
        if rule == "split":
            out[lo[t] : hi[t] + 1] += share / share.sum()
        elif rule == "most":
            out[lo[t] + int(share.argmax())] += 1
        else:
            raise ValueError(f"no such rule: {rule}")
    return out


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sections: Callable[[np.ndarray], np.ndarray] = line_sections, rule: str = "first", where: str | None = None) -> DataFrame:
    """A row for each section: doc_id, section (from 0), start and end (characters), n_tokens, n_crossing, doc_tokens.

    n_crossing: tokens that lie in this section and in another.  sections: byte bounds from a text's bytes, sorted,
    at characters' beginnings, with 0 and the length.
    """
    where = where or tokens.folder()
    number = pa.float64() if rule == "split" else pa.int64()
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", number), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, many, columns = [], [], [[] for _ in range(6)]
            for key, value in zip(batch["doc_id"], batch["text"], strict=True):
                value = value.as_py() or ""
                raw = np.frombuffer(value.encode(), np.uint8)
                ids = tokens.encode(value, where)
                bounds, cuts, chars = token_bounds(ids, where), sections(raw), char_starts(raw)
                inner = cuts[1:-1]
                n = len(cuts) - 1
                got = allocate(bounds, cuts, chars, rule)
                lo, hi = np.searchsorted(inner, bounds[:-1], "right"), np.searchsorted(inner, bounds[1:] - 1, "right")
                crossing = np.zeros(n + 1, np.int64)
                across = lo != hi
                np.add.at(crossing, lo[across], 1)
                np.add.at(crossing, hi[across] + 1, -1)
                keys.append(key.as_py())
                many.append(n)
                for to, x in zip(columns, (np.arange(n), chars[cuts[:-1]], chars[cuts[1:]], got, np.cumsum(crossing)[:-1], np.full(n, len(ids))), strict=True):
                    to.append(x)
            if keys:
                ids_out = pa.array(keys, pa.int64()).take(pa.array(np.repeat(np.arange(len(keys)), many)))
                yield pa.record_batch([ids_out, *[pa.array(np.concatenate(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    kind = "double" if rule == "split" else "bigint"
    return rename_inputs(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id bigint, section bigint, start bigint, end bigint, n_tokens {kind}, n_crossing bigint, doc_tokens bigint")
