"""Removal of repeated byte strings: every byte that a string of `least` bytes covers which also starts anywhere else.

1. Anchors.  A window of `least` bytes picks, among the grams of `gram` bytes in it, the first of least hash.  Equal
   windows pick alike, so a window can repeat only if its anchor's hash does.  Neighbouring windows that pick one anchor
   are an entry; its context is the bytes that they cover.  Each window is in one entry.
2. Contexts.  (anchor, context) pairs are counted, summed within tasks first.  A context that occurs twice is repeated
   whole: both hashes, 128 bits with the anchor's, agree.  Distinct contexts of one anchor, one occurrence of each, are
   compared by their bytes.
3. Bounds.  Sorted by what follows the anchor, and by what precedes it read backwards, a context's longest match on either
   side is with a neighbour.  Both lengths together bound its repeated range; contexts are cut to their bounds, and those
   below `least` go.
4. Transform.  What is left becomes one text, equal cuts once, with a Burrows-Wheeler transform.  Intervals of equal
   prefixes are extended backwards, breadth first, which finds the longest common prefixes of neighbouring suffixes by
   increasing value; it stops at `least`.  Neighbours without a value by then share `least` bytes or more.
5. A group of more than `hot` distinct contexts is split by content before it is compared: windows that begin in one half
   of the places where they can cover the bytes between the halves' ends, and equal windows have equal bytes there.  So
   each half is dealt by those bytes, contexts are cut to what its windows cover, and equal cuts are one.  At worst a part
   is a single window.
6. The repeated ranges go back to every occurrence, and each text loses them.

Inputs that need a rule: a null text is empty; texts shorter than `least` stay whole; repeated rows are documents of
their own, so that they remove each other; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import stored
from .common import _U, buffer_of, mix64, powers, rename_inputs, slices

LEAST = 400
GRAM = 100
#: Distinct contexts that a task compares at once, some 0.7 KB each.
HOT = 2_000
#: Bytes of contexts in one transform.
CHUNK = 1 << 20


def sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each w neighbours: from running values within blocks of w, forwards and backwards."""
    n = len(a)
    if n < w:
        return a[:0]
    rows = -(-n // w) + 1
    padded = np.full(rows * w, a[-1], a.dtype)
    padded[:n] = a
    blocks = padded.reshape(rows, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, at: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of every entry: row, the anchor's place in the row and its hash, the context's hash, its bytes before and from the anchor on."""
    n, w = len(data), least - gram + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none, none, none
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(n), out=sums[1:])
    inverse = powers(n + 1, down=True)
    h = mix64((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    # the place in the low bits: of equal hashes the first is the least
    mask = (1 << n.bit_length()) - 1
    low = sliding(h & _U(~mask & 0xFFFFFFFFFFFFFFFF) | np.arange(len(h), dtype=_U), w, np.minimum)
    place = (low & _U(mask)).astype(np.int64)
    # windows that reach into the next row are none
    inside = np.ones(len(place), bool)
    ends = at[1:-1]
    for back in range(0, len(ends), 4096):
        reach = (ends[back : back + 4096, None] - np.arange(1, least)).ravel()
        inside[reach[(reach >= 0) & (reach < len(place))]] = False
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none, none, none, none, none
    place = place[start]
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    begin, place = start[fresh], place[fresh]
    end = start[np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)] + least
    row = np.searchsorted(at, place, "right") - 1
    before, after = place - begin, end - place
    context = mix64((sums[end] - sums[begin]) * inverse[begin] + mix64((before * (4 * least) + after).astype(_U)))
    return row, place - at[row], h[place].view(np.int64), context.view(np.int64), before, after


def suffix_order(text: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """The suffixes in the order of their first `reach` characters or more; of those alike so far, in any order.

    text: codes, 0 where a piece ends; ends: the place of that 0 for each place.  Prefixes double.
    """
    n = len(text)
    codes = np.zeros(int(text.max()) + 1, np.int64)
    used = np.unique(text)
    codes[used] = np.arange(len(used)) + (used[0] > 0)
    bits = int(len(used)).bit_length()
    width = 63 // bits
    padded = np.concatenate([codes[text], np.zeros(width, np.int64)])
    rank = padded[:n].copy()
    left = ends - np.arange(n)
    for i in range(1, width):
        rank <<= bits
        rank |= np.where(left >= i, padded[i : i + n], 0)
    while True:
        order = np.argsort(rank)
        ordered = rank[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        if width >= reach or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        behind = np.zeros(n, np.int64)
        behind[: n - width] = np.where(left[: n - width] >= width, rank[width:], 0)
        rank *= n + 1
        rank += behind
        width *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each suffix but the first, in order: whether it shares `least` bytes with the one before it.

    Breadth-first backward extension.  Intervals of one level are disjoint; their occurrences of each character, which
    the transform maps to an interval of the next level, are found for all of them by array operations.
    """
    n = len(text)
    before = text[order - 1].astype(np.uint16)
    before[order == 0] = 0
    by_char = np.argsort(before, kind="stable")
    target = np.empty(n, np.int64)
    target[by_char] = np.arange(n)
    ordered = before[by_char]
    same = ordered[1:] == ordered[:-1]
    follow, lead = np.full(n, n), np.full(n, -1)
    follow[by_char[:-1][same]] = by_char[1:][same]
    lead[by_char[1:][same]] = by_char[:-1][same]
    del by_char, ordered, same
    # where suffixes begin with another character, they share nothing; where a piece ends, neither
    known = np.zeros(n + 1, bool)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=258))])
    known[starts] = True
    known[: starts[1] + 1] = True
    chars = np.flatnonzero(np.diff(starts))
    chars = chars[chars > 0]
    # each piece's end is a character of its own
    lo, hi = np.concatenate([np.arange(starts[1]), starts[chars]]), np.concatenate([np.arange(starts[1]), starts[chars + 1] - 1])
    for _ in range(1, least):
        if not len(lo):
            break
        sizes = hi - lo + 1
        owner = np.repeat(np.arange(len(lo)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[owner]
        solid = before[place] > 0
        last = target[place[solid & (follow[place] > hi[owner])]]
        first = target[place[solid & (lead[place] < lo[owner])]]
        last.sort()
        first.sort()
        fresh = ~known[last + 1]
        lo, hi = first[fresh], last[fresh]
        known[hi + 1] = True
    return ~known[1:n]


def repeated_ranges(contexts: list[bytes], least: int = LEAST) -> list[tuple[list[int], list[int]]]:
    """For each context the ranges covered by `least` bytes that occur again in any."""
    sizes = np.array([len(c) for c in contexts])
    raw = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8).astype(np.int64) + 1
    stops = np.cumsum(sizes + 1) - 1
    raw[stops] = 0
    begins = stops - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    order = suffix_order(raw, stops[owner], least)
    alike = common_prefixes(raw, order, least)
    shared = np.concatenate([[False], alike]) | np.concatenate([alike, [False]])
    found = order[shared]
    cover = np.zeros(len(raw) + 1, np.int64)
    cover[found] += 1
    cover[found + least] -= 1
    edge = np.diff(np.concatenate([[0], np.cumsum(cover) > 0, [0]]).astype(np.int8))
    up, down = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.searchsorted(owner[up], np.arange(len(sizes) + 1))
    return [((up[a:b] - s).tolist(), (down[a:b] - s).tolist()) for a, b, s in zip(cuts, cuts[1:], begins, strict=False)]


def _longest(side: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The longest match of each row of side with another of its group, from their beginnings; -1 without another."""
    m = len(side)
    digits = np.stack([group // 255 ** (3 - i) % 255 + 1 for i in range(4)], axis=1).astype(np.uint8)
    keys = np.ascontiguousarray(np.concatenate([digits, side], axis=1))
    order = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
    match = np.full(m + 1, -1)
    a, b = order[:-1], order[1:]
    match[1:m] = np.where(group[a] == group[b], _common(side, size, a, b), -1)
    out = np.empty(m, np.int64)
    out[order] = np.maximum(match[:-1], match[1:])
    return out


def _common(side: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bytes that rows a and b of side share from their beginning."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 4096):
        p, q = a[i : i + 4096], b[i : i + 4096]
        differ = side[p] != side[q]
        out[i : i + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
    return np.minimum(out, np.minimum(size[a], size[b]))


def compared(contexts: list[bytes], before: np.ndarray, group: np.ndarray, least: int = LEAST) -> list[tuple[list[int], list[int]]]:
    """For each context the ranges covered by `least` bytes that another of its group has too, relative to the anchor."""
    m = len(contexts)
    sizes = np.array([len(c) for c in contexts])
    after = sizes - before
    flat = np.frombuffer(b"".join(contexts), np.uint8) + np.uint8(1)  # 0 pads: no text in UTF-8 has the byte 255
    anchor = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + before
    padded = np.concatenate([flat, np.zeros(least, np.uint8)])

    def side(width: int, size: np.ndarray, step: int) -> np.ndarray:
        at = np.arange(width)
        out = np.zeros((m, width), np.uint8)
        for i in range(0, m, 4096):
            j = slice(i, i + 4096)
            index = anchor[j, None] + (at if step > 0 else -1 - at)
            out[j] = np.where(at < size[j, None], padded[np.maximum(index, 0)], 0)
        return out

    longest = _longest(side(int(after.max()), after, 1), after, group)
    back = _longest(side(max(1, int(before.max())), before, -1), before, group)
    hopeful = np.flatnonzero((longest >= 0) & (back >= 0) & (back + longest >= least)).tolist()
    # equal cuts of a group are one; alone in its group, one that others equal needs no comparison
    cuts: dict[tuple[int, bytes], list[int]] = {}
    for i in hopeful:
        cuts.setdefault((int(group[i]), contexts[i][before[i] - back[i] : before[i] + longest[i]]), []).append(i)
    several = Counter(g for g, _ in cuts)
    rest = [(k, own) for k, own in cuts.items() if several[k[0]] > 1]
    ranges = dict(zip([k for k, _ in rest], repeated_ranges([c for (_, c), _ in rest], least), strict=True)) if rest else {}
    out: list[tuple[list[int], list[int]]] = [([], [])] * m
    for k, own in cuts.items():
        begins, ends = ([0], [len(k[1])]) if len(own) > 1 else ranges.get(k, ([], []))
        for i in own:
            out[i] = ([x - int(back[i]) for x in begins], [x - int(back[i]) for x in ends])
    return out


def _entries(least: int, gram: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("before", pa.int16()), ("after", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, place, anchor, context, before, after = anchors(*buffer_of(batch["text"]), least, gram)
            take = pa.array(row)
            yield pa.record_batch([batch["id"].take(take), batch["key"].take(take), *[pa.array(x, f.type) for x, f in zip((place, anchor, context, before, after), list(schema)[2:], strict=True)]], schema=schema)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for: a row for each."""
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("before", pa.int32()), ("whole", pa.bool_()), ("bytes", pa.binary())])
    for batch in slices(batches, "text"):
        rows: list[tuple] = []
        for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
            raw, w = text.as_py().encode(), wanted.values
            place, before, after = (w.field(c).to_numpy().astype(np.int64) for c in ("place", "before", "after"))
            pieces = [raw[a:b] for a, b in zip((place - before).tolist(), (place + after).tolist(), strict=True)]
            rows.append((w.field("anchor").to_numpy(), w.field("context").to_numpy(), before, w.field("whole").to_numpy(zero_copy_only=False), pieces))
        if rows:
            columns = [np.concatenate(x) for x in list(zip(*rows, strict=True))[:4]]
            yield pa.record_batch([*[pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], pa.array([p for r in rows for p in r[4]], pa.binary())], schema=schema)


def _compare(least: int, chunk: int):
    """Contexts, sorted by anchor, to their repeated ranges relative to the anchor."""
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def done(held: pa.Table) -> pa.RecordBatch:
        contexts = held["bytes"].to_pylist()
        anchor = held["anchor"].to_numpy()
        group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        ranges = compared(contexts, held["before"].to_numpy().astype(np.int64), group, least)
        keep = [i for i, ((a, _), whole) in enumerate(zip(ranges, held["whole"].to_pylist(), strict=True)) if a and not whole]
        begins = pa.array([ranges[i][0] for i in keep], schema.field(2).type)
        ends = pa.array([ranges[i][1] for i in keep], schema.field(3).type)
        some = held.select(["anchor", "context"]).take(pa.array(keep, pa.int64())).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in some.columns]
        return pa.record_batch([*columns, begins, ends], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(iter([batch]), "bytes", chunk):
                held.append(part)
                size += part["bytes"].nbytes
                if size < chunk:
                    continue
                table = pa.Table.from_batches(held)
                anchor = table["anchor"].to_numpy()
                whole = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                if whole:
                    yield done(table.slice(0, whole))
                    table = table.slice(whole)
                held, size = table.to_batches(), table.nbytes
        if held and sum(b.num_rows for b in held):
            yield done(pa.Table.from_batches(held))

    return run


def _halves(least: int):
    """Each context's two halves: the windows that begin up to the middle of first..last, and those after it.

    group: of the bytes that all windows of a half cover; cut: the hash of the bytes kept, from `low` on (relative to the
    anchor).  A half without a window goes.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "context", "group", "cut")] + [(c, pa.int32()) for c in ("first", "last", "low")] + [("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            rows = []
            for anchor, context, group, first, last, low, raw in zip(*[batch[c].to_pylist() for c in ("anchor", "context", "group", "first", "last", "low", "bytes")], strict=True):
                middle = (first + last) // 2
                for a, b in ((first, middle), (middle + 1, last)):
                    begin, end = max(low, a), min(low + len(raw) - least, b)
                    if begin > end:
                        continue
                    shared, kept = raw[b - low : a + least - low], raw[begin - low : end + least - low]
                    digest = lambda *x: int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little", signed=True)
                    rows.append((anchor, context, digest(group, a, b, shared), digest(begin, kept), a, b, begin, kept))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for batch in batches:
        rows = []
        for key, text, begins, ends in zip(batch["doc_id"].to_pylist(), batch["text"], batch["begins"], batch["ends"], strict=True):
            raw = text.as_py().encode()
            kept, removed, spans = raw, 0, 0
            if begins.is_valid:
                a, b = begins.values.to_numpy(), ends.values.to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.concatenate([[True], a[1:] > b[:-1]])
                a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                pieces = [raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)]
                kept, removed, spans = b"".join(pieces), int((b - a).sum()), len(a)
            rows.append((key, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _contexts(d: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes of the contexts asked for.  Both joins of the texts take the same columns, so that one shuffle serves them."""
    w = asked.select("one.id", "one.key", F.struct("anchor", "context", "one.place", "one.before", "one.after", (F.col("n") > 1).alias("whole")).alias("w"))
    w = w.groupBy("id", "key").agg(F.collect_list("w").alias("wanted"))
    # a document and its exact copy have one key: either gives the bytes
    return d.join(w, ["id", "key"]).select("doc_id", "text", "key", "wanted").mapInArrow(_cut, "anchor bigint, context bigint, before int, whole boolean, bytes binary")


def _split(contexts: DataFrame, least: int, gram: int, hot: int, chunk: int) -> list[DataFrame]:
    """(anchor, context, begins, ends) of contexts in groups that are too large, split until they aren't."""
    found = []
    parts = contexts.select("anchor", "context", F.col("anchor").alias("group"), F.lit(gram - least).alias("first"), F.lit(0).alias("last"), (-F.col("before")).alias("low"), "bytes")
    while True:
        parts = stored(parts.mapInArrow(_halves(least), "anchor bigint, context bigint, group bigint, cut bigint, first int, last int, low int, bytes binary"), "halves")
        one = F.struct("anchor", "context")
        cuts = parts.groupBy("group", "cut").agg(F.count("*").alias("n"), F.min(one).alias("one"))
        kinds = cuts.groupBy("group").agg(F.count("*").alias("kinds"))
        # each context's cut, and whether it stands for those equal to it
        cuts = stored(cuts.join(kinds, "group").select("group", "cut", "n", "kinds", "one"), "cuts")
        whole = parts.join(cuts.where("n > 1").select("group", "cut"), ["group", "cut"])
        found.append(whole.select("anchor", "context", F.array("low").alias("begins"), F.array((F.col("low") + F.length("bytes")).cast("int")).alias("ends")))
        mine = parts.join(cuts.where("kinds > 1").select("group", "cut", "n", "kinds", F.col("one.anchor").alias("anchor"), F.col("one.context").alias("context")), ["group", "cut", "anchor", "context"])
        calm = mine.where(F.col("kinds") <= hot).select(F.col("group").alias("anchor"), F.col("cut").alias("context"), (-F.col("low")).alias("before"), (F.col("n") > 1).alias("whole"), "bytes")
        got = _compared(calm, least, chunk).withColumnsRenamed({"anchor": "group", "context": "cut"})
        found.append(parts.join(got, ["group", "cut"]).select("anchor", "context", "begins", "ends"))
        more = cuts.where(F.col("kinds") > hot)
        if not more.limit(1).count():
            return found
        # equal cuts are repeated whole: one of them goes on, for others to be held against
        parts = mine.where(F.col("kinds") > hot).select("anchor", "context", "group", "first", "last", "low", "bytes")


def _compared(contexts: DataFrame, least: int, chunk: int) -> DataFrame:
    contexts = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return contexts.mapInArrow(_compare(least, chunk), "anchor bigint, context bigint, begins array<int>, ends array<int>")


def repeats(d: DataFrame, least: int, gram: int, hot: int, chunk: int) -> DataFrame:
    """(id, key, begins, ends): the repeated byte ranges, not yet joined up, of the documents (keyed) that have some."""
    entries = d.mapInArrow(_entries(least, gram), "id bigint, key bigint, place bigint, anchor bigint, context bigint, before smallint, after smallint")
    entries = stored(entries, "anchors")
    # counts are tables before they are joined back, so that a hot anchor's side of the join can be split
    again = stored(entries.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "again")
    entries = stored(entries.join(again, "anchor"), "entries")
    place = F.struct("id", "key", "place", "before", "after")
    pairs = stored(entries.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("one")), "pairs")
    kinds = stored(pairs.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
    pairs = pairs.join(kinds, "anchor")
    # the same context has the same place about its anchor
    whole = pairs.where("n > 1").select("anchor", "context", F.array((-F.col("one.before")).cast("int")).alias("begins"), F.array(F.col("one.after").cast("int")).alias("ends"))
    found = _compared(_contexts(d, pairs.where(f"kinds BETWEEN 2 AND {hot}")), least, chunk).union(whole)
    if pairs.where(f"kinds > {hot}").limit(1).count():
        for more in _split(_contexts(d, pairs.where(f"kinds > {hot}")), least, gram, hot, chunk):
            found = found.union(more)
    hits = entries.join(found, ["anchor", "context"])
    shift = lambda c: F.transform(c, lambda x: x + F.col("place"))
    hits = hits.select("id", "key", shift("begins").alias("begins"), shift("ends").alias("ends"))
    return hits.groupBy("id", "key").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    d = rename_inputs(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("key"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that stay, of every document."""
    d = _keyed(docs, doc_id, text)
    d = d.join(repeats(d, least, gram, hot, chunk), ["id", "key"], "left").select("doc_id", "text", "key", "begins", "ends")
    return d.mapInArrow(_remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
