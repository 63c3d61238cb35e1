"""Secret scans with an incremental blob ledger.

Every historical version of a path is addressed by the SHA-256 of its content (its blob).  The ledger says which rule
versions were run on a blob, and what they found.  Only unseen pairs of blob and rule version are scanned, each blob once
however many paths hold it, and stored and new findings are joined to every path that holds the blob.

Inputs that need a rule: a null text is an empty blob; an empty blob has no findings; repeated rows are paths that share
a blob; a null path is a path like any other; an empty table gives empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored
from .common import rename_inputs

# The patterns of the three base kinds, the least length of each, and the words of the first.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches are leftmost and don't overlap; those whose group is shorter than least are dropped.

    words: a text, in lower case, without any of these has no match, so the pattern isn't tried on it.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    words: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str, low: str) -> list[tuple[int, int]]:
        """Start and end (exclusive) of each match, in code points."""
        if self.words and not any(w in low for w in self.words):
            return []
        found = _compiled(self.pattern, self.any_case).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


_CACHE: dict[tuple[str, bool], re.Pattern] = {}


def _compiled(pattern: str, any_case: bool) -> re.Pattern:
    if (pattern, any_case) not in _CACHE:
        _CACHE[pattern, any_case] = re.compile(pattern, re.ASCII | (re.IGNORECASE if any_case else 0))
    return _CACHE[pattern, any_case]


#: In the order in which spans that begin together are listed.
RULES = (
    Rule("assign", 1, ASSIGN, 6, group=2, any_case=True, words=ASSIGN_WORDS),
    Rule("access", 1, ACCESS, 20, words=("akia",)),
    # a maximal run of the class is one match, so runs below the least length can be left out in the pattern
    Rule("hex", 1, HEX[:-1] + "{24,}", 24),
)


def blobs(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob, text): versions with the address of their content."""
    return rename_inputs(versions, path=path, text=text).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.unhex(F.sha2("text", 256)))


_SPANS = "array<struct<rule:string,start:bigint,end:bigint>>"


def _names(rules: Sequence[Rule]) -> Column:
    return F.array(*[F.lit(r.name) for r in rules])


def unseen(held: DataFrame, rules: Sequence[Rule], ledger: DataFrame | None) -> DataFrame:
    """(blob, path, rules): the blobs with rules not yet run on them, each with one path that holds it."""
    one = held.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return one.withColumn("rules", _names(rules))
    one = one.join(rename_inputs(ledger, blob="blob", seen="rules"), "blob", "left")
    left = F.array_except(_names(rules), F.coalesce("seen", F.array().cast("array<string>")))
    return one.select("blob", "path", left.alias("rules")).where(F.size("rules") > 0)


def scan(held: DataFrame, todo: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, rules, spans): what the rules of todo find in each of its blobs.

    A blob's text comes from one of its paths: the join's key is unique, whatever share of the rows is one blob.
    """
    by_name = {r.name: r for r in rules}
    out = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, names in zip(batch["text"], batch["rules"].to_pylist(), strict=True):
                text = text.as_py()
                low = text.lower()
                found.append([{"rule": n, "start": a, "end": b} for n in names for a, b in by_name[n].spans(text, low)])
            yield pa.record_batch([batch["blob"], batch["rules"], pa.array(found, out.field("spans").type)], schema=out)

    t = todo.select(F.col("blob").alias("_blob"), F.col("path").alias("_path"), "rules")
    texts = held.join(t, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path"))).select("blob", "rules", "text")
    return texts.mapInArrow(run, f"blob binary, rules array<string>, spans {_SPANS}")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) of versions (path, text; a path may have many).

    findings: (path, blob, spans), a row for each version; spans (kind, start, end), by start, then in the rules' order, are
    all that the rules find in its blob, in this call or an earlier one.  ledger: (blob, rules, spans), a row for each blob
    seen before or now, with the rule versions that were run on it and all that they found.  The rules of a call are of
    different kinds.
    """
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("two rules of one kind")
    held = blobs(versions, path, text)
    # a blob comes twice where rows alike in path and text hold it
    now = stored(scan(held, unseen(held, rules, ledger), rules).dropDuplicates(["blob"]), "scanned")
    if ledger is not None:
        old = rename_inputs(ledger, blob="blob", _rules="rules", _spans="spans")
        both = now.join(old, "blob", "full")
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        now = both.select("blob", F.array_union(none("_rules", "array<string>"), none("rules", "array<string>")).alias("rules"), F.concat(none("_spans", _SPANS), none("spans", _SPANS)).alias("spans"))
        now = stored(now, "ledger")
    names = _names(rules)
    mine = F.filter("spans", lambda s: F.array_contains(names, s["rule"]))
    placed = F.sort_array(F.transform(mine, lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["rule"]).alias("i"), s["end"].alias("end"))))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    shown = F.transform(placed, lambda s: F.struct(F.element_at(kinds, s["i"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return held.select("path", "blob").join(now.select("blob", shown.alias("spans")), "blob", "left").select("path", "blob", "spans"), now


def scan_increments(increments: Iterable[DataFrame], ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) of versions that come in parts, one after the other: each part is held to the ledger of all before."""
    found = None
    for part in increments:
        here, ledger = scan_versions(part, ledger, rules, path, text)
        found = here if found is None else found.unionByName(here)
    if found is None:
        raise ValueError("no increments")
    return found, ledger


def digest(findings: DataFrame) -> DataFrame:
    """path, n_assign, n_access, n_hex, base_sha256 and spans of findings by the base rules."""
    spans = F.coalesce("spans", F.array())
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings.select("path", *[count(r.kind) for r in RULES], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
