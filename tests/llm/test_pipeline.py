"""The pipeline's stages, each on its own input, against brute-force versions."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as p

from . import helpers as h
from .test_operators import DOCS


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    texts = [t for t in h.corpus(11, 150, (40, 90))] + [None, ""]
    rows = [(i, t, "en" if i % 3 else "fr", f"src{i % 6}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


def test_stages(spark, tables, tmp_path):
    """Each stage on what the one before kept, against its brute-force version."""
    from skyfold.llm import mixing, quality, tokens

    docs = first = spark.read.parquet(f"{tables}/documents.parquet")
    original = [(r.doc_id, r.text) for r in first.collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{tables}/labels.parquet").collect() if r.quality == 1}
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mixing", "packing"]
    for k, (name, stage) in enumerate(p.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        got = [tuple(r) for r in after.collect()]
        if k < 4:
            assert after.columns == docs.columns
        if name == "quality_rules":
            kept = h.quality_kept([(r[0], r[1]) for r in before], trusted, quality.BUCKETS, quality.THRESHOLD)
            assert sorted(got) == sorted(r for r, x in zip(before, kept) if x) and 0 < len(got) < len(before)
        elif name == "line_dedup":
            want = h.later_lines([(r[0], r[1]) for r in before], 10)
            assert sorted(got) == sorted((r[0], w, r[2], r[3], len(w)) for r, w in zip(before, want) if w)
        elif name == "jaccard_join":
            names = h.both_texts_components([(r[0], r[1]) for r in before], original)
            assert sorted(got) == sorted(r for r, c in zip(before, names) if r[0] == c)
        elif name == "mixing":
            times = h.mixed([(r[0], r[1], r[2], r[3]) for r in before], mixing.TARGETS)
            assert Counter(got) == Counter({r: n for r, n in zip(before, times) if n}) and max(times) > min(times)
        else:
            ids = lambda t: [*map(int, tokens.encode(t or "", tokens.folder())), 0]
            assert Counter(r[0] for r in got if r[1] == 0) == Counter(r[0] for r in before)
            own = {r[0]: ids(r[1]) for r in before}
            sequences = {}
            for r in after.collect():
                assert r.ids == own[r.doc_id][r.start : r.start + r.length]
                sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for placed in sequences.values():
                assert sorted(placed)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(placed), sorted(placed)[1:])) and sum(n for _, n in placed) <= 2048
        docs = after


def test_near_copies_through_line_dedup(spark, tmp_path):
    """Near copies whose shared lines line dedup cuts are still told: one of each group stays, whole, and strangers stay."""
    import random

    rnd, words = random.Random(5), h.vocabulary(5, 4000)
    line = lambda: " ".join(rnd.choice(words) for _ in range(14))
    rows, groups = [], []
    for g in range(40):
        base = [line() for _ in range(8)]
        own = []
        for c in range(rnd.choice([1, 1, 2, 3, 6])):
            lines = list(base)
            if c:
                lines[rnd.randrange(8)] += " " + rnd.choice(words)
            own.append(len(rows))
            rows.append((len(rows), "\n".join(lines), "en", f"src{g % 5}", 1))
        groups.append(own)
    root = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    cut = p.line_dedup_stage(spark, docs, root)
    got = {r.doc_id: r.text for r in p.jaccard_join_stage(spark, cut, root).collect()}
    assert sorted(got) == [own[0] for own in groups]
    assert all(got[own[0]] == rows[own[0]][1] for own in groups)


@pytest.mark.parametrize("k", range(5))
def test_odd_inputs(spark, tables, k):
    """Empty tables, columns with clashing names, ties, nulls, very long texts."""
    from .test_operators import clashing

    stage = p.STAGES[k][1]
    empty = stage(spark, spark.createDataFrame([], DOCS), tables)
    assert empty.count() == 0
    words = h.vocabulary(9, 3000)
    long = " ".join(words[i * 7 % 3000] + str(i % 101) for i in range(60_000))
    text = "\n".join(" ".join(words[j : j + 20]) for j in range(0, 200, 20))
    rows = [(900, text, "en", "src1", 1), (900, text, "en", "src1", 1), (None, text, None, None, None), (901, None, "en", "src1", None), (902, "", None, "src2", 0), (903, long, "en", "src0", len(long))]
    d = clashing(spark.createDataFrame(rows, DOCS))
    out = stage(spark, d, tables)
    got = out.collect()
    if k < 4:
        assert out.columns == d.columns
        assert any(r.doc_id == 903 and r.text == long for r in got)
    else:
        assert {r.doc_id for r in got} == {900, 901, 902, 903, None} and sum(r.length for r in got if r.doc_id == 903) > 60_000


def test_near_copies_leave_one(spark):
    words = h.vocabulary(3, 500)
    base = words[:200]
    texts = [" ".join(base), " ".join([*base[:100], "zz", *base[101:]]), " ".join(words[200:400]), " ".join(base)]
    rows = [(9 - i, t, "en", "src1", len(t)) for i, t in enumerate(texts)] * 2
    got = p.jaccard_join_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r.doc_id for r in got) == [6, 7]


def test_run(spark, tables):
    assert p.run(spark, tables).count() > 0
