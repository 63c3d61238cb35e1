"""Brute-force versions, from the contracts alone."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_components(docs, num=4, den=5):
    """docs: (id, text).  For each row its set's size and component, in order."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [(d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(docs)]


def remove_repeats(texts, least):
    count = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        count.update(b[i : i + least] for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def later_lines(docs, min_words):
    """docs: (id, text), all different.  The texts without lines of runs that began earlier."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    lines = {i: [x.strip(" \t\n\x0b\x0c\r") for x in (docs[i][1] or "").split("\n")] for i in order}
    solid = {i: [k for k, x in enumerate(lines[i]) if x] for i in order}
    seen, gone = {}, defaultdict(set)
    for i in order:
        s = [lines[i][k] for k in solid[i]]
        for a in range(len(s)):
            words = 0
            for b in range(a, len(s)):
                words += len(WORD.findall(s[b]))
                if words >= min_words:
                    run = tuple(s[a : b + 1])
                    if run in seen:
                        gone[i].update(solid[i][a : b + 1])
                    seen.setdefault(run, (i, a))
    out = []
    for i, (_, text) in enumerate(docs):
        if text is None:
            out.append(None)
            continue
        rest = [x for k, x in enumerate(text.split("\n")) if k not in gone[i]]
        out.append("\n".join(rest) if any(k not in gone[i] for k in solid[i]) or not solid[i] else "")
    return out


def vocabulary(seed=0, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnoprstuvé") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def corpus(seed=0, n=60, words=(5, 120)):
    """Texts with exact and near copies, shared passages, repeated lines, blanks, nulls and a long text."""
    rnd, vocab = random.Random(seed), vocabulary(seed)
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passage, line = text(80), text(12)
    out = [None, "", " \n\t ", "one", "a b c d", "A b C d", text(3000)]
    for i in range(n):
        kind = rnd.random()
        if kind < 0.2 and len(out) > 8:
            out.append(rnd.choice(out[7:]))
        elif kind < 0.5 and len(out) > 8:
            w = rnd.choice(out[7:]).split(" ")
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
        else:
            parts = [text(rnd.randint(*words)) for _ in range(rnd.randint(1, 4))]
            if rnd.random() < 0.4:
                parts.insert(rnd.randrange(len(parts) + 1), passage)
            if rnd.random() < 0.4:
                parts.insert(rnd.randrange(len(parts) + 1), line)
            out.append(rnd.choice(["\n", "\n\n", " \n"]).join(parts))
    return out


def both_texts_components(now, before):
    """now, before: (id, text), ids unique in each.  The component of each document now, by either of its texts."""
    was = dict(before)
    rows = [*now, *((i, was[i]) for i, t in now if i in was and was[i] is not None and was[i] != t)]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] == rows[j][0] and a and b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k in range(len(now)):
        least[find(k)] = min(now[k][0], least.get(find(k), now[k][0]))
    return [least[find(k)] for k in range(len(now))]


def quality_kept(docs, trusted, buckets, threshold):
    """docs: (id, text).  Whether each is kept, from the definitions."""
    import math

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grams, raw, target = [], Counter(), Counter()
    for i, t in docs:
        w = WORD.findall(t or "")
        one = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in w]
        two = [xxhash.xxh64(b.to_bytes(8, "little"), seed=xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()).intdigest() for a, b in zip(one, one[1:])]
        grams.append([signed(x) % buckets for x in one + two])
        raw.update(grams[-1])
        target.update(grams[-1] if i in trusted else [])
    n_raw, n_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    out = []
    for (_, t), g in zip(docs, grams):
        w = WORD.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        score = sum(math.log((target[x] + 1) / n_target) - math.log((raw[x] + 1) / n_raw) for x in g) / max(1, len(g))
        out.append(len(w) >= 50 and 2 * len(cover) <= len(w) and score >= threshold)
    return out


def mixed(docs, weights, epochs=2, seed=17):
    """docs: (id, text, lang, source).  How often each is taken, from the definitions."""
    import hashlib

    def domain(source):
        m = re.fullmatch(r"src(\d{1,9})", source or "")
        return f"domain{int(m[1]) % 4}" if m else "other"

    def fill(budget, caps, own):
        """caps and weights by child: what each gets."""
        got, open_ = {}, set(caps)
        while open_:
            mark = max(budget - sum(got.values()), 0) / sum(own[c] for c in open_)
            full = {c for c in open_ if caps[c] <= mark * own[c]}
            if not full:
                return got | {c: min(mark * own[c], caps[c]) for c in open_}
            got |= {c: caps[c] for c in full}
            open_ -= full
        return got

    tokens = [len(WORD.findall(t or "")) for _, t, _, _ in docs]
    leaf = [(domain(s), x, s) for _, _, x, s in docs]
    total = Counter()
    for k, n in zip(leaf, tokens):
        total[k] += n
    weight = {r[:3]: r[3] for r in weights}
    budgets = {(): float(sum(tokens))}
    for depth in (1, 2, 3):
        nodes = {k[:depth] for k in total}
        for parent in {k[:-1] for k in nodes}:
            kids = [k for k in nodes if k[:-1] == parent]
            caps = {k: epochs * sum(n for full, n in total.items() if full[:depth] == k) for k in kids}
            budgets |= fill(budgets[parent], caps, {k: 1.0 if k[-1] is None else weight.get((*k, *[None] * (3 - depth)), 1.0) for k in kids})
    out = []
    order = {}
    for k in total:
        b = int(budgets[k] + 1e-6)
        whole, rest = (b // total[k], b % total[k]) if total[k] else (1, 0)
        rows = []
        for i, (d, t, _, _) in enumerate(docs):
            if leaf[i] == k:
                parts = [str(d) if d is not None else None, hashlib.md5(t.encode()).hexdigest() if t is not None else None, str(seed), str(whole)]
                rows.append((int(hashlib.md5("|".join(x for x in parts if x is not None).encode()).hexdigest()[:15], 16), i))
        for o, i in rows:
            ahead = sum(tokens[j] for p, j in rows if p < o)
            order[i] = whole + (ahead < rest)
    for i in range(len(docs)):
        out.append(order[i])
    return out
