"""N-gram Jaccard self-join: documents link when their sets of word shingles have a similarity of t or more.

Equal sets are one node from the start, whatever their number: two 64-bit sums of hashes say which are equal, and where sets
agree in the first alone (looked for in every corpus), all but one of them get another name.  For the others the join is
exact:

1. Order.  Shingles are 64-bit hashes.  Those found often within slices of the corpus (counted over all of it; the most
   frequent, up to `HOT` of them) come last in the order of all sets, the rest by hash.  Any fixed order is correct; this
   one keeps shared passages out of prefixes.
2. Tiles.  Two linked sets share a shingle within the first n - ceil(t n) + 1 of each, and of the smaller one within the
   first n - ceil(2t / (1 + t) n) + 1.  Entries (shingle, node, size) meet by shingle; sorted by size, those farther
   apart than the threshold allows fall into different size bands.  The entries of a frequent shingle are dealt by node
   too, so that no task gathers them; their bands come with the blocks below.
3. Signatures.  A node's bitmap has the parity of the shingles hashed to each bit.  Bits that differ between two nodes
   are shingles that one of them lacks, so they bound the overlap from above.
4. Exact intersection of sorted arrays for what is left, from the whole texts.

Groups of near copies are not expanded into pairs.  First each node meets neighbours by size in its first tiles and is
held against the likeliest few, and the links give components.  Then only pairs of a tile's nodes in different components
are made, filtered and verified: no link between components is lost, and links within one add nothing.  A large tile is
cut into cells by size band, its largest component apart; cells of that component don't meet each other, so that their
cost is in proportion to the nodes outside it.

Inputs that need a rule: a null text, or one without words, has an empty set and links with nothing; a text of fewer
words than a shingle has one shingle, all its words; repeated ids and rows are documents of their own that link (equal
sets), and a component is named after its smallest id, nulls apart; a document with a null id may link others but takes
its component's name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import only_result, stored
from .common import _U, buffer_of, components, forest_roots, mix64, rename_inputs, slices, small_batches, word_hashes

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
#: Shingles that come last at most: what each task is sent, 8 bytes each.
HOT = 1 << 18
#: Copies of a shingle in a slice, and in all such slices together, from which on it may come last.
HOT_IN_SLICE, HOT_IN_ALL = 3, 48
#: Pieces that a slice's entries are dealt into at least; twice the shuffle partitions, if those are more.
BUCKETS = 256
#: Tiles in which a node first meets neighbours, the neighbours that it is held against, and children of one parent in a
#: verifying task.
FIRST_TILES, FIRST_LINKS, CHILDREN = 40, 8, 256
#: Nodes of a tile that a task gathers, twice as many at most.
PART = 2000
#: Bytes of entries in a bucket, about.
BUCKET_BYTES = 1 << 25
#: Blocks of up to so many nodes are compared many at a time.
SMALL = 64
_SCALE = 1024  # of the logarithm of sizes in entries
_TURNS = _U(0x9FB21C651E98DF25)


def shingle_rows(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle, sorted and distinct within each row, and where each row's begin (with the end)."""
    h, row = word_hashes(data, at)
    n = len(at) - 1
    per = np.bincount(row, minlength=n)
    if not len(h):
        return h, np.zeros(n + 1, np.int64)
    firsts = np.concatenate([[0], np.cumsum(per)])
    padded = np.concatenate([h, np.zeros(k, _U)])
    out = np.zeros(len(h), _U)
    left = firsts[row + 1] - np.arange(len(h))  # words from here to the row's end
    for i in range(k):
        out = out * _TURNS + np.where(left > i, mix64(padded[i : i + len(h)] + _U(1)), _U(0))
    out = mix64(out)
    whole = (left >= k) | ((per[row] < k) & (np.arange(len(h)) == firsts[row]))
    out, row = out[whole], row[whole]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    sets = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        s = np.sort(out[a:b])
        sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b - a > 1 else s)
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _first(flat: np.ndarray, cuts: np.ndarray, bits: int = 64, salt: np.uint64 = _TURNS) -> np.ndarray:
    """A hash of each row's set.  bits: how many of it are kept (fewer in tests)."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(flat ^ salt), dtype=_U)])
    return mix64(sums[cuts[1:]] - sums[cuts[:-1]] + mix64(np.diff(cuts).astype(_U) ^ salt)) & _U((1 << bits) - 1)


def _second(flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return _first(flat, cuts, salt=_U(0x2545F4914F6CDD1D))


@dataclass
class Survey:
    """What one pass over the corpus tells before the join.

    hot: frequent shingles, sorted, at most a limit of them (which they are changes the work, never the result).  clashes:
    names of sets whose first hash is another set's too; n documents have some n ** 2 / 2 ** 65 of them, 300 in 10 ** 11.
    entries: how many the join makes.
    """

    hot: np.ndarray
    clashes: dict[tuple[int, int], int]
    entries: int

    def named(self, flat: np.ndarray, cuts: np.ndarray, bits: int) -> np.ndarray:
        """The name of each row's set."""
        first = _first(flat, cuts, bits)
        if self.clashes:
            pairs = zip(first.tolist(), _second(flat, cuts).tolist(), strict=True)
            first = np.array([self.clashes.get(p, p[0]) for p in pairs], _U)
        return first


def survey(docs: DataFrame, t: Fraction, k: int = SHINGLE, limit: int = HOT, bits: int = 64) -> Survey:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, cuts = shingle_rows(*buffer_of(batch["text"]), k)
            found, count = np.unique(flat, return_counts=True)
            some = count >= HOT_IN_SLICE
            first, second = _first(flat, cuts, bits), _second(flat, cuts)
            once = np.unique(first ^ second, return_index=True)[1] if bits == 64 else np.arange(len(first))
            first, second = first[once], second[once]
            made = sum(_prefix(n, t) for n in np.diff(cuts)[once].tolist() if n)
            a, b = np.concatenate([found[some], first]), np.concatenate([count[some].astype(_U), second])
            kind = np.concatenate([np.zeros(int(some.sum()), np.int8), np.ones(len(once), np.int8), [2]])
            a, b = np.append(a, _U(0)), np.append(b, _U(made))
            yield pa.record_batch([pa.array(kind.astype(np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

    seen = stored(docs.select("text").mapInArrow(run, "kind tinyint, a bigint, b bigint"), "survey")
    counts = seen.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= HOT_IN_ALL)
    hot = np.sort(counts.orderBy(F.desc("n"), "a").limit(limit).select("a").toArrow()["a"].to_numpy().view(_U))
    entries = seen.where("kind = 2").agg(F.sum("b")).first()[0] or 0
    sets = seen.where("kind = 1").select("a", "b")
    twice = sets.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).where("least <> most")
    clashes = {}
    for r in sets.join(twice, "a").where("b <> least").select("a", "b").distinct().collect():
        a, b = int(r.a) % (1 << 64), int(r.b) % (1 << 64)
        clashes[a, b] = int(mix64(np.array([a * 0x9E3779B97F4A7C15 + b & 0xFFFFFFFFFFFFFFFF], _U))[0])
    return Survey(hot, clashes, entries)


def bitmap(s: np.ndarray) -> bytes:
    """Parities of a set's shingles by their low bits, about two bits for a shingle; a power of two of bytes."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _prefix(n: int, share: Fraction) -> int:
    return n - ceil(share * n) + 1


def _entries(found: Survey, t: Fraction, buckets: int, k: int, bits: int):
    """A row for each document (kind 0), and for each slice and bucket the entries in one piece (kind 1).

    Entries of a hot shingle have buckets of their own, from `buckets` on, dealt by shingle and node.
    """
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
    shorter, hot = 2 * t / (1 + t), found.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, cuts = shingle_rows(*buffer_of(batch["text"]), k)
            late = np.zeros(len(flat), bool)
            if len(hot):
                late = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat
            key = flat >> _U(1) | late.astype(_U) << _U(63)
            size = np.diff(cuts)
            node = found.named(flat, cuts, bits)
            _, once = np.unique(node, return_index=True)  # equal sets of a slice make their entries once
            keys, maps, parts, roles = [], [], [], []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                maps.append(bitmap(flat[a:b]) if b > a else b"")
            for i in once.tolist():
                a, b = cuts[i], cuts[i + 1]
                if b > a:
                    p = _prefix(b - a, t)
                    own = key[a:b]
                    keys.append((np.sort(own) if late[a:b].any() else own)[:p])
                    parts.append(np.full(p, i))
                    roles.append(np.arange(p) < _prefix(b - a, shorter))
            n = batch.num_rows
            spread = mix64(node) % _U(buckets)
            yield pa.record_batch([pa.array(spread.astype(np.int32)), pa.array(np.zeros(n, np.int8)), batch["doc_id"], batch["key"], pa.array(node.view(np.int64)), pa.array(size), pa.array(maps, pa.binary())], schema=schema)
            if not keys:
                continue
            keys, part, role = np.concatenate(keys), np.concatenate(parts), np.concatenate(roles)
            mixed = mix64(keys)
            frequent = keys >> _U(63) > 0
            bucket = (mix64(mixed ^ np.where(frequent, mix64(node[part]), _U(0))) >> _U(32)) % _U(buckets) + frequent * _U(buckets)
            bucket = bucket.astype(np.int32)
            rows = np.empty(len(keys), _ENTRY)
            rows["key"] = mixed.astype(np.uint32)
            rows["node"] = node[part]
            rows["size"] = (np.log(size[part]) * _SCALE).astype(np.uint16) << 1 | ~role  # even sizes may be the smaller set
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
            data = [rows[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
            none = pa.nulls(len(ends), pa.int64())
            yield pa.record_batch([pa.array(bucket[ends - 1]), pa.array(np.ones(len(ends), np.int8)), none, none, none, none, pa.array(data, pa.binary())], schema=schema)

    return run


#: The size is the logarithm by _SCALE, above a bit that is set where the entry can't be the smaller set's.
_ENTRY = np.dtype([("key", "<u4"), ("node", "<u8"), ("size", "<u2")])


def _tiles(t: Fraction, buckets: int):
    """Documents pass; of the entries, sorted by bucket, those go on that meet another node in their size band.

    Those of hot shingles all go on (kind 2), each node once; their tile is the shingle.
    """
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("tile", pa.int64()), ("size", pa.int32()), ("data", pa.binary())])
    reach = int(-log(t) * _SCALE) + 2

    def meet(bucket: int, pieces: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(pieces), _ENTRY)
        rows = rows[np.lexsort((rows["node"], rows["size"], rows["key"]))]
        key, size, node = rows["key"], rows["size"].astype(np.int32), rows["node"]
        keep = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (size[1:] != size[:-1])])
        key, size, node = key[keep], size[keep], node[keep]
        if bucket >= buckets:
            none, n = pa.nulls(len(key), pa.int64()), len(key)
            tile = mix64(key.astype(_U) | _U(1) << _U(62))
            return pa.record_batch([pa.array(np.full(n, 2, np.int8)), none, none, pa.array(node.view(np.int64)), none, pa.array(tile.view(np.int64)), pa.array(size), pa.nulls(n, pa.binary())], schema=schema)
        # a band ends where the next size is out of reach
        band = np.concatenate([[True], (key[1:] != key[:-1]) | ((size[1:] >> 1) - (size[:-1] >> 1) > reach)])
        at = np.cumsum(band) - 1
        first = np.flatnonzero(band)
        some = (np.bincount(at) > 1) & (np.bincount(at, weights=size & 1 == 0) > 0)
        live = some[at]
        tile = mix64(_U(bucket) << _U(32) | key[first].astype(_U)) + np.arange(len(first), dtype=_U)
        n = int(live.sum())
        none = pa.nulls(n, pa.int64())
        return pa.record_batch([pa.array(np.ones(n, np.int8)), none, none, pa.array(node[live].view(np.int64)), none, pa.array(tile[at[live]].view(np.int64)), pa.array(size[live]), pa.nulls(n, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []
        for batch in batches:
            kind = batch["kind"].to_numpy()
            docs = batch.filter(pa.array(kind == 0))
            if n := docs.num_rows:
                yield pa.record_batch([docs["kind"], docs["doc_id"], docs["key"], docs["node"], docs["n"], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), docs["data"]], schema=schema)
            rest = batch.filter(pa.array(kind == 1))
            for bucket, data in zip(rest["bucket"].to_numpy().tolist(), rest["data"], strict=True):
                if bucket != now and pieces:
                    yield meet(now, pieces)
                    pieces = []
                now = bucket
                pieces.append(data.as_py())
        if pieces:
            yield meet(now, pieces)

    return run


def _bounded(t: Fraction):
    """Pairs whose bitmaps and sizes allow a link, with the most that their similarity can be.

    The larger bitmap is folded onto the smaller one.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("most", pa.float64())])

    def most(na: int, nb: int, x: bytes, y: bytes) -> float | None:
        if min(na, nb) * t.denominator < max(na, nb) * t.numerator:
            return None
        if len(x) > len(y):
            x, y = y, x
        p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        if len(q) > len(p):
            q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)
        overlap = (na + nb - int(np.bitwise_count(p ^ q).sum())) // 2
        union = na + nb - overlap
        return overlap / union if overlap * t.denominator >= union * t.numerator else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([most(*row) for row in zip(*[batch[c].to_pylist() for c in ("na", "nb", "xa", "xb")], strict=True)], pa.float64())
            yield pa.record_batch([batch["a"], batch["b"], found], schema=schema).filter(found.is_valid())

    return run


def _intersect(t: Fraction, k: int):
    """Links, from rows sorted by parent and place: the parent's text, then its children's."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, own = None, None
        for batch in slices(batches, "text"):
            flat, cuts = shingle_rows(*buffer_of(batch["text"]), k)
            links = []
            for i, (a, salt, b) in enumerate(zip(*[batch[c].to_pylist() for c in ("a", "salt", "b")], strict=True)):
                s = flat[cuts[i] : cuts[i + 1]]
                if b is None:
                    parent, own = (a, salt), s
                    continue
                assert parent == (a, salt)
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                common = int((own[at] == s).sum())
                if common * t.denominator >= (len(own) + len(s) - common) * t.numerator:
                    links.append((a, b))
            own = None if own is None else own.copy()
            yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=schema)

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, t: Fraction, k: int) -> DataFrame:
    """The pairs (a, b) that link.  Each parent a meets its children in parts of some CHILDREN."""
    many = pairs.groupBy("a").agg(F.count("*").alias("many"))
    dealt = stored(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / CHILDREN)).alias("salt")), "pairs")
    parents = dealt.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    wanted = parents.union(dealt.select("a", "salt", "b", F.col("b").alias("node")))
    # a document and its exact copy have one id and key: either gives the text
    own = nodes.select("node", F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
    needed = stored(wanted.select("node").distinct().join(own, "node"), "needed")
    # by a merge join at every size: the wanted grow with the corpus
    texts = docs.join(needed.hint("merge"), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    rows = wanted.join(texts, "node").select("a", "salt", "b", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return stored(rows.mapInArrow(_intersect(t, k), "a bigint, b bigint"), "links")


def _allowed(pairs: DataFrame, nodes: DataFrame, t: Fraction) -> DataFrame:
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("data").alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("data").alias("xb"))
    return stored(pairs.join(left, "a").join(right, "b").mapInArrow(_bounded(t), "a bigint, b bigint, most double"), "candidates")


def _neighbours(tiles: DataFrame) -> DataFrame:
    """Pairs next to each other by size in the first tiles of a node; a tile of very many is dealt into parts."""
    first = tiles.withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("tile"))).where(F.col("i") <= FIRST_TILES)
    first = stored(first.drop("i"), "first")
    crowd = first.groupBy("tile").agg(F.count("*").alias("many")).where("many > 1")
    first = first.join(crowd, "tile").withColumn("part", F.pmod(F.xxhash64("node", "tile"), F.ceil(F.col("many") / 1000)))
    before = F.lag("node").over(Window.partitionBy("tile", "part").orderBy("size", "node"))
    near = first.select("node", before.alias("other")).where("other IS NOT NULL AND other <> node")
    return near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs those with the greatest bounds.  A node has at most two pairs for each of its first tiles."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "most").union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "most"))
    turn = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("most"), "v"))
    best = both.withColumn("i", turn).where(F.col("i") <= FIRST_LINKS)
    return best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


@only_result
def _first_links(tiles: DataFrame, nodes: DataFrame, docs: DataFrame, t: Fraction, k: int) -> DataFrame:
    return _verified(_likeliest(_allowed(_neighbours(tiles), nodes, t)), nodes, docs, t, k)


def _blocks(t: Fraction):
    """Pairs of a block of a tile that may link: different roots, sizes in reach, and a bitmap bound that allows it.

    Rows come sorted by block.  A block is one part of a tile with itself (lo = hi), or two parts with each other.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ["tile", "lo", "hi", "part", "node", "size", "root", "n", "data"]

    def pairs(cols: dict[str, np.ndarray], cross: bool, x: np.ndarray, mine: np.ndarray, y: np.ndarray, others: np.ndarray) -> Iterator[np.ndarray]:
        """Rows x with bitmaps `mine` against rows y with bitmaps `others`, those in reach by size."""
        if not len(x) or not len(y):
            return
        order = np.argsort(cols["n"][x], kind="stable")
        x, mine = x[order], mine[order]
        order = np.argsort(cols["n"][y], kind="stable")
        y, others = y[order], others[order]
        sizes = cols["n"][y]
        for k in range(0, len(x), 256):
            u = x[k : k + 256]
            na = cols["n"][u][:, None]
            a = np.searchsorted(sizes, -(-int(na[0, 0]) * t.numerator // t.denominator))
            b = np.searchsorted(sizes, int(na[-1, 0]) * t.denominator // t.numerator, "right")
            v, other = y[a:b], others[a:b]
            nb = sizes[a:b][None]
            differ = np.zeros((len(u), len(v)), np.int64)
            for word in range(mine.shape[1]):
                differ += np.bitwise_count(mine[k : k + 256, None, word] ^ other[None, :, word])
            overlap = (na + nb - differ) // 2
            fit = overlap * t.denominator >= (na + nb - overlap) * t.numerator
            fit &= np.minimum(na, nb) * t.denominator >= np.maximum(na, nb) * t.numerator
            fit &= cols["root"][u][:, None] != cols["root"][v][None]
            ea, eb = cols["even"][u][:, None], cols["even"][v][None]
            fit &= np.where(na < nb, ea, np.where(nb < na, eb, ea & eb))
            if cross:
                fit &= cols["part"][u][:, None] != cols["part"][v][None]
            i, j = np.nonzero(fit)
            yield np.stack([cols["node"][u[i]], cols["node"][v[j]]])

    def meet(cols: dict[str, np.ndarray], cross: bool, maps: list[bytes]) -> Iterator[np.ndarray]:
        width = np.array([len(x) for x in maps])
        roots, at, count = np.unique(cols["root"], return_inverse=True, return_counts=True)
        main = at == count.argmax()  # the largest component's nodes needn't meet each other
        for w in np.unique(width).tolist():
            # sizes in reach have bitmaps of one length, or of one and its double, which is folded
            same, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            small = np.frombuffer(b"".join(maps[i] for i in same), np.uint64).reshape(len(same), -1)
            raw = np.frombuffer(b"".join(maps[i] for i in wider), np.uint64).reshape(len(wider), 2, small.shape[1])
            folded = raw[:, 0] ^ raw[:, 1]
            out, in_ = ~main[same], main[same]
            yield from pairs(cols, cross, same[out], small[out], np.concatenate([same, wider]), np.concatenate([small, folded]))
            far = ~main[wider]
            yield from pairs(cols, cross, same[in_], small[in_], wider[far], folded[far])

    def within(cols: dict[str, np.ndarray], block: np.ndarray, maps: list[bytes]) -> np.ndarray:
        """The pairs of many small blocks at once: each row with the k-th after it, for every k."""
        found, many = [], len(block)
        for k in range(1, many):
            a = np.flatnonzero(block[k:] == block[:-k])
            if not len(a):
                break
            b = a + k
            na, nb, ea, eb = cols["n"][a], cols["n"][b], cols["even"][a], cols["even"][b]
            fit = np.minimum(na, nb) * t.denominator >= np.maximum(na, nb) * t.numerator
            fit &= cols["root"][a] != cols["root"][b]
            fit &= np.where(na < nb, ea, np.where(nb < na, eb, ea & eb))
            fit &= ~cols["cross"][a] | (cols["part"][a] != cols["part"][b])
            found.append(np.stack([a[fit], b[fit]]))
        if not found:
            return np.zeros((2, 0), np.int64)
        a, b = np.concatenate(found, axis=1)
        width = np.array([len(x) for x in maps])
        a, b = np.where(width[a] <= width[b], a, b), np.where(width[a] <= width[b], b, a)
        keep = []
        for w in np.unique(width[a]).tolist():
            for v in (w, 2 * w):  # sizes in reach have bitmaps of one length, or of one and its double, which is folded
                own = np.flatnonzero((width[a] == w) & (width[b] == v))
                for k in range(0, len(own), 4096):
                    x, y = a[own[k : k + 4096]], b[own[k : k + 4096]]
                    p = np.frombuffer(b"".join([maps[i] for i in x.tolist()]), np.uint64).reshape(len(x), -1)
                    q = np.frombuffer(b"".join([maps[i] for i in y.tolist()]), np.uint64).reshape(len(x), v // w, -1)
                    differ = np.bitwise_count(p ^ np.bitwise_xor.reduce(q, axis=1)).sum(axis=1, dtype=np.int64)
                    size = cols["n"][x] + cols["n"][y]
                    overlap = (size - differ) // 2
                    fit = overlap * t.denominator >= (size - overlap) * t.numerator
                    keep.append(np.stack([x[fit], y[fit]]))
        return cols["node"][np.concatenate(keep, axis=1)] if keep else np.zeros((2, 0), np.int64)

    def done(held: pa.Table) -> pa.RecordBatch:
        """Of rows that are whole blocks."""
        cols = {c: held[c].to_numpy() for c in names[:-1]}
        cols["even"], cols["cross"] = cols["size"] % 2 == 0, cols["lo"] != cols["hi"]
        maps = held["data"].to_pylist()
        new = np.concatenate([[True], np.any([cols[c][1:] != cols[c][:-1] for c in names[:3]], axis=0)])
        block = np.cumsum(new) - 1
        count = np.bincount(block)
        small = np.flatnonzero(count[block] <= SMALL)
        found = [within({c: v[small] for c, v in cols.items()}, block[small], [maps[i] for i in small.tolist()])]
        starts = np.flatnonzero(new)
        for k in np.flatnonzero(count > SMALL).tolist():
            a, b = starts[k], starts[k] + count[k]
            found += meet({c: v[a:b] for c, v in cols.items()}, bool(cols["cross"][a]), maps[a:b])
        pairs_ = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.record_batch([pa.array(pairs_[0]), pa.array(pairs_[1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 2 * PART:
                continue
            rows = pa.Table.from_batches(held)
            keys = np.stack([rows[c].to_numpy() for c in names[:3]], axis=1)
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if last:  # the last block may go on
                yield done(rows.slice(0, last))
            held = rows.slice(last).to_batches()
        if sum(b.num_rows for b in held):
            yield done(pa.Table.from_batches(held))

    return run


def _across(tiles: DataFrame, roots: DataFrame, nodes: DataFrame, t: Fraction) -> DataFrame:
    """All pairs of a tile whose nodes are in different components and may link.

    A tile of up to `PART` nodes is one cell.  A larger one is dealt into cells of some `PART` nodes by size band, those of
    its largest component apart.  Cells of one band or of neighbouring ones meet two by two, but not two of that component.
    """
    inside = tiles.join(roots, "node", "left").select("tile", "node", "size", F.coalesce("root", "node").alias("root"))
    own = inside.groupBy("tile", "root").agg(F.count("*").alias("c"))
    mixed = own.groupBy("tile").agg(F.sum("c").alias("many"), F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main")).where("roots > 1")
    inside = inside.join(stored(mixed.select("tile", "many", "main"), "mixed"), "tile")
    small = F.col("many") <= PART
    reach = int(-log(t) * _SCALE) + 2
    apart = F.when(small, False).otherwise(F.col("root") == F.col("main"))
    band = F.when(small, 0).otherwise(F.floor(F.shiftright("size", 1) / reach)).cast("int")
    inside = stored(inside.select("tile", "node", "size", "root", apart.alias("apart"), band.alias("band")), "inside")
    sizes = inside.groupBy("tile", "apart", "band").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("c"))
    # cells of a tile in order; a cell is a row here
    cells = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.struct("apart", "band", "salt")
    cells = stored(cells.select("tile", cell.alias("cell"), "c", "parts"), "cells")
    other = cells.select("tile", F.col("cell").alias("with"))
    near = ~(F.col("cell.apart") & F.col("with.apart")) & (F.abs(F.col("cell.band") - F.col("with.band")) <= 1) & ((F.col("cell") != F.col("with")) | (F.col("c") > 1))
    meets = cells.join(other, "tile").where(near)
    meets = stored(meets.select("tile", "cell", F.least("cell", "with").alias("lo"), F.greatest("cell", "with").alias("hi")), "meets")
    dealt = inside.join(sizes.select("tile", "apart", "band", "parts"), ["tile", "apart", "band"])
    dealt = dealt.select("tile", "node", "size", "root", F.struct("apart", "band", F.pmod(F.xxhash64("node", "tile"), "parts").cast("int").alias("salt")).alias("cell"))
    number = lambda c: F.xxhash64(F.col(c)["apart"], F.col(c)["band"], F.col(c)["salt"])
    blocks = dealt.join(meets, ["tile", "cell"]).select("tile", number("lo").alias("lo"), number("hi").alias("hi"), number("cell").alias("part"), "node", "size", "root")
    full = blocks.join(nodes.select("node", "n", "data"), "node").select("tile", "lo", "hi", "part", "node", "size", "root", "n", "data")
    full = full.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi")
    return stored(full.mapInArrow(_blocks(t), "a bigint, b bigint").distinct(), "across")


@only_result
def _other_links(tiles: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, t: Fraction, k: int) -> DataFrame:
    return _verified(_across(tiles, roots, nodes, t), nodes, docs, t, k)


def _merged(nodes: DataFrame, roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after the links `more`: of those between components, only the roots are walked."""
    every = stored(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "rooted")
    end = lambda x: every.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    edges = more.join(end("a"), "a").join(end("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
    top = components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return every.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD, k: int = SHINGLE, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (equal sets share it; null for an empty set), key and kept.

    A row for each document.  key: the hash of id and text; kept: the component's first document, or an empty set.
    """
    with small_batches(docs.sparkSession):
        return _joined(docs, doc_id, text, threshold, k, bits)


def _joined(docs: DataFrame, doc_id: str, text: str, threshold: Fraction, k: int, bits: int) -> DataFrame:
    d = rename_inputs(docs, doc_id=doc_id, text=text)
    # a document and its exact copy under one id have one key
    d = d.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = survey(d, threshold, k, bits=bits)
    buckets = max(BUCKETS, 2 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found.entries * _ENTRY.itemsize // BUCKET_BYTES))
    entries = d.mapInArrow(_entries(found, threshold, buckets, k, bits), "bucket int, kind tinyint, doc_id bigint, key bigint, node bigint, n bigint, data binary")
    met = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tiles(threshold, buckets), "kind tinyint, doc_id bigint, key bigint, node bigint, n bigint, tile bigint, size int, data binary")
    met = stored(met, "tiles")
    rows = met.where("kind = 0").select("doc_id", "key", "node", "n", "data")
    hot = met.where("kind = 2").select("tile", "node", "size")
    shared = hot.groupBy("tile").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("tile")
    tiles = met.where("kind = 1").select("tile", "node", "size").union(stored(hot.join(shared, "tile").select("tile", "node", "size"), "shared"))
    # one of a node's documents stands for it
    nodes = rows.where("n > 0").join(tiles.select("node").distinct(), "node", "left_semi")
    one = F.struct("key", "doc_id")
    nodes = nodes.groupBy("node").agg(F.min(one).alias("one"), F.first("n").alias("n"), F.first("data").alias("data"))
    nodes = stored(nodes.select("node", "one.key", "one.doc_id", "n", "data"), "nodes")

    # a few of a node's neighbours are enough here: what they leave apart comes up again below
    links = _first_links(tiles, nodes, d, threshold, k)
    # with one smaller neighbour for each node the links are a forest; the other links merge its trees
    parents = links.groupBy("b").agg(F.min("a").alias("a"))
    roots = _merged(nodes, forest_roots(parents.select(F.col("b").alias("node"), F.col("a").alias("parent"))), links)
    more = _other_links(tiles, roots, nodes, d, threshold, k)
    roots = _merged(nodes, roots, more)

    rows = rows.select("doc_id", "key", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n")
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")
    names = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("name"), F.min(first).alias("first"))
    named = rooted.join(names, "root", "left")
    kept = F.col("first").isNull() | (first == F.col("first"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"), F.col("node").alias("class_id"), "key", kept.alias("kept"), "root")


def earlier_texts(docs: DataFrame, before: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) as they were in `before`, of the documents whose text is another now.

    Ids that more than one row of either table has tell nothing, nor do nulls: such documents have no earlier text.
    """
    h = lambda d: rename_inputs(d, doc_id=doc_id, text=text).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("h")).where("n = 1")
    now, then = h(docs).select("doc_id", "h"), h(before).select("doc_id", F.col("h").alias("was"))
    changed = now.join(then, "doc_id").where("h <> was").select("doc_id")
    return rename_inputs(before, doc_id=doc_id, text=text).join(changed, "doc_id", "left_semi")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD, k: int = SHINGLE, before: DataFrame | None = None) -> DataFrame:
    """The first document of each component, by id, with its own columns; those with empty sets all stay.

    before: the documents as they were before their texts were cut.  A document is then held by both of its texts, and two
    documents are near copies if a text of one is a near copy of a text of the other.  Of rows alike in id and text the one
    stays whose other columns have the least hash.
    """
    id_, text_ = docs[f"`{doc_id}`"], docs[f"`{text}`"]
    own = F.xxhash64(id_, text_)
    found = join(docs, doc_id, text, threshold, k)
    if before is not None:
        found = _by_either(stored(found, "now"), docs, before, doc_id, text, threshold, k)
    keep = found.where("kept").select(F.col("key").alias("_key"), F.col("doc_id").alias("_kept")).distinct()
    others = [docs[f"`{c}`"] for c in docs.columns if c not in (doc_id, text)]
    tie = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    d = docs.select(F.struct("*").alias("_row"), id_.alias("_id"), own.alias("_own"), tie.alias("_tie"))
    d = d.join(keep, (F.col("_own") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_kept")))
    return d.groupBy("_id", "_own").agg(F.min_by("_row", "_tie").alias("_row")).select("_row.*")


def _by_either(now: DataFrame, docs: DataFrame, before: DataFrame, doc_id: str, text: str, threshold: Fraction, k: int) -> DataFrame:
    """doc_id, key and kept of the documents, linked by their texts now or by those before.

    A second join holds the texts before against each other (and those that are as they were); a set has one name in both, so
    that a document's two roots are an edge.  A document's text now and before needn't be compared.
    """
    was = earlier_texts(docs, before, doc_id, text).select("doc_id", F.col("text").alias("was"))
    d = rename_inputs(docs, doc_id=doc_id, text=text)
    then = d.join(was, "doc_id", "left").select("doc_id", F.coalesce("was", "text").alias("text"), F.xxhash64("doc_id", "text").alias("own"))
    then = stored(then, "then")
    names = then.select(F.col("doc_id").alias("_id"), F.col("own"), F.xxhash64("doc_id", "text").alias("_then")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    first = stored(join(then, threshold=threshold, k=k).select("doc_id", "key", "root"), "found").distinct().withColumnsRenamed({"doc_id": "_bid", "key": "_bkey", "root": "b"})
    rows = now.where("root IS NOT NULL").select("doc_id", "key", F.col("root").alias("a")).distinct()
    both = rows.join(names, (F.col("key") == F.col("own")) & same).join(first, (F.col("_then") == F.col("_bkey")) & F.col("doc_id").eqNullSafe(F.col("_bid")))
    both = stored(both.select("doc_id", "key", "a", "b"), "roots")
    top = components(both.where("b IS NOT NULL AND a <> b").select("a", "b")).select(F.col("node").alias("a"), F.col("root").alias("top"))
    grouped = both.join(top, "a", "left").select("doc_id", "key", F.coalesce("top", "a").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")
    least = grouped.groupBy("group").agg(F.min(order).alias("first"))
    kept = grouped.join(least, "group").select("doc_id", "key", (order == F.col("first")).alias("kept"))
    # a document without a set now stays, whatever it was
    return kept.union(now.where("root IS NULL").select("doc_id", "key", F.lit(True).alias("kept")))
