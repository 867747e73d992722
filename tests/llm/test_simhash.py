"""SimHash components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from millrace.llm import simhash
from millrace.llm.common import components
from millrace.llm.simhash import allocations, fingerprint, links, partitioned, probe_counts, simhash_components, thresholds

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def chains(fps):
    """The least fingerprint that each one reaches; 0 is a fingerprint like any other."""
    x = np.array(fps, np.uint64)
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*(v.tolist() for v in np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 2)), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(x))]


def cloud(seed, n):
    """Random fingerprints, chains of single flips, and a dense cloud around one of them."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 3, 7 << 61}
    out |= {rng.getrandbits(64) for _ in range(n)}
    x = rng.getrandbits(64)
    for _ in range(30):
        x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        out.add(x)
    x, bits = rng.getrandbits(64), rng.sample(range(64), 11)
    for _ in range(n):
        y = x
        for b in rng.sample(bits, rng.randrange(6)):
            y ^= 1 << b
        out.add(y)
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", " \n\t", "A", "a B", "a b c", "ÄÖ ß x y \x0bq z", "word " * 40, "ab cd ef " * 30_000 + "end", " " * 250_000 + "a b", "a b" + " " * 250_000 + "C d"])
def test_fingerprint(text):
    assert fingerprint(text or "") == plain_fingerprint(text)


def test_thresholds_are_the_cheapest_allowed():
    rng = np.random.default_rng(3)
    for m in (2, 3):
        near = np.append(np.zeros((50, m, 1)), rng.exponential(60, (50, m, 3)).cumsum(2), 2).astype(np.float32)
        cost = probe_counts(partitioned(100, np.eye(64) * 50, m))
        for x, t in zip(near, thresholds(near, cost), strict=True):
            each = {tuple(a): sum(x[k, s + 1] + cost[k, s + 1] for k, s in enumerate(a)) for a in allocations(m).tolist()}
            assert tuple(t) in each and each[tuple(t)] == pytest.approx(min(each.values()), rel=1e-5)


def test_correlated_bits_stand_together():
    both = np.full((64, 64), 250)
    np.fill_diagonal(both, 500)
    for k in (5, 17, 40, 63):
        both[5, k] = both[k, 5] = 480
    assert any({5, 17, 40, 63} <= set(g) for g in partitioned(1000, both, 3))


@pytest.mark.parametrize(("hot", "n"), [(64, 900), (6, 300)])
def test_links_join_what_chains_do(spark, monkeypatch, hot, n):
    monkeypatch.setattr(simhash, "HOT", hot)
    fps = cloud(hot, n)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    found = links(df)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in found.collect())
    roots = {r.node & (1 << 64) - 1: r.root for r in components(found).collect()}
    want = chains(fps)
    groups = lambda of: sorted(sorted(x for x in fps if of[x] == r) for r in set(of.values()))
    assert groups({x: roots.get(x, ("alone", x)) for x in fps}) == groups(dict(zip(fps, want, strict=True)))


def test_documents(spark, corpus, odd, empty):
    extra = [(None, "alone and without an id"), (10**6, corpus[3][1]), (corpus[5][0], "a second text of one id"), (2 * 10**6, None), (3 * 10**6, "  ")]
    for docs in (spark.createDataFrame(corpus + extra, "doc_id long, text string"), odd):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        fps = [plain_fingerprint(t) for _, t in rows]
        root = chains(fps)
        least = {}
        for (i, _), r in zip(rows, root, strict=True):
            least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
        want = sorted(((i, f"{fp:016x}", least[r]) for (i, _), fp, r in zip(rows, fps, root, strict=True)), key=str)
        assert sorted(map(tuple, simhash_components(docs).collect()), key=str) == want
    assert simhash_components(empty).count() == 0
