"""Operators that compare texts: exact and near duplicates, passages, benchmark items; and the pipeline."""

from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import decontaminate, exact, near, substrings
from millrace.llm.common import components

DATA = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# exact


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=60), min_size=1, max_size=4))
def test_filters_lose_nothing(parts):
    filters = [exact.QuotientFilter.unpack(exact.QuotientFilter(np.array(p, np.uint64)).pack()) for p in parts]
    fps, n = exact.QuotientFilter.merge(filters).items()
    every = [x for p in parts for x in p]
    assert dict(zip(fps.tolist(), n.tolist(), strict=True)) == {x: every.count(x) for x in set(every)} and list(fps) == sorted(fps)


def test_exact_groups_match_sorting(spark, corpus):
    rows = [*corpus, (9001, "Ab É"), (9002, "aB É"), (9003, "ab é"), (9004, None), (9005, ""), (9006, corpus[0][1].swapcase().upper())]
    want = {}
    for i, t in rows:
        want.setdefault(exact.normal(t or ""), []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(k).hexdigest()) for k, g in want.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs(spark, rows)).collect()}
    assert got == want
    kept = exact.drop_exact(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in want.items() if v[2])


def test_exact_of_odd_rows(odd, empty):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == odd.count() and exact.exact_groups(empty).count() == 0
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id in (4, 5)} == {(5, 3)} and {r.keep_id for r in rows if r.doc_id in (1, 2)} == {2}
    assert exact.drop_exact(odd).columns == odd.columns


# near


def edited(base, edits, rng):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def family(rng):
    """Copies of a few originals with more and fewer edits, some beyond the threshold, and strangers."""
    rows = []
    for f in range(4):
        base = " ".join(f"w{f}x{rng.randrange(400)}" for _ in range(160))
        rows += [base, *(edited(base, rng.choice([1, 2, 4, 6, 9]), rng) for _ in range(40))]
    rows += [" ".join(f"z{rng.randrange(10**6)}" for _ in range(80)) for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute_classes(rows):
    sets = {i: near.shingles(t or "") for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations([i for i in sets if len(sets[i][0])], 2):
        if near.weighted_jaccard(sets[a], sets[b]) >= near.SIMILARITY:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("block", [600, 7])
def test_near_classes_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_ROWS", block)
    rows = family(random.Random(5))
    got = {r.doc_id: (r.class_id, r.class_size) for r in near.near_classes(docs(spark, rows)).collect()}
    want = brute_classes(rows)
    size = {c: list(want.values()).count(c) for c in want.values()}
    assert got == {i: (c, size[c]) for i, c in want.items()}


def test_near_classes_of_corpus(spark, corpus):
    got = {r.doc_id: r.class_id for r in near.near_classes(docs(spark, corpus)).collect()}
    assert got == brute_classes(corpus)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(60)}" for _ in range(300)) + " a b c d e f" * 40
    for k in (5, 20, 60):
        pair = [near.shingles(base), near.shingles(edited(base, k, rng))]
        s = near.dart_minhash(pair, 2048)
        assert abs((s[0] == s[1]).mean() - near.weighted_jaccard(*pair)) < 0.05
    one = near.shingles("one two")
    assert len(one[0]) == 1 and (near.dart_minhash([one, one])[0] == near.dart_minhash([one])[0]).all()


def test_near_of_odd_rows(odd, empty):
    rows = near.near_classes(odd).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5, 6, 7, 8] and {r.doc_id: r.class_id for r in rows}[5] == 4
    assert near.near_classes(empty).count() == 0
    kept = near.drop_near(odd)
    assert kept.columns == odd.columns and 5 not in {r.doc_id for r in kept.collect()} and None in {r.doc_id for r in kept.collect()}


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


# passages


def brute_removal(rows, length, later_only=False):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    for k in order:
        b = (rows[k][1] or "").encode()
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((k, s))
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            where = seen[b[s : s + length]]
            if len(where) > 1 and (not later_only or where[0] != (k, s)):
                gone[s : s + length] = [True] * length
        out.append((len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3).map(lambda b: b"ab" + b) | st.sampled_from([b"abcabcabcabc" * 3, b"xyz" * 9, b"aaaa" * 10]), min_size=1, max_size=6), st.booleans())
def test_suffix_arrays_find_repeated_windows(parts, later):
    parts, n = [p + b"0123456789" for p in parts], 9
    got = [s.tolist() for s in substrings.repeated_starts(parts, n, later)]
    seen = {}
    for k, p in enumerate(parts):
        for s in range(len(p) - n + 1):
            seen.setdefault(p[s : s + n], []).append((k, s))
    assert got == [[s for s in range(len(p) - n + 1) if (seen[p[s : s + n]][0] != (k, s) if later else len(seen[p[s : s + n]]) > 1)] for k, p in enumerate(parts)]


def passages(rng):
    words = lambda n: " ".join(f"{rng.randrange(10**5)}é" for _ in range(n))
    shared, rows = [words(60) for _ in range(3)], []
    for _ in range(40):
        rows.append(words(rng.randrange(1, 60)) + rng.choice(shared)[rng.randrange(40) :] + words(rng.randrange(40)))
    rows += [rows[0], rows[1][:-1], "ab" * 400, "line of text again\n" * 30, "z" * 1000, None, "", "short", words(5) + shared[0] * 2]
    return list(enumerate(rows))


@pytest.mark.parametrize(("hot", "keep"), [(1_000_000, False), (0, False), (3_000, False), (1_000_000, True), (0, True)])
def test_removal_matches_brute_force(spark, monkeypatch, hot, keep):
    monkeypatch.setattr(substrings, "GROUP_BYTES", hot)
    rows = passages(random.Random(2))
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in substrings.remove_repeats(docs(spark, rows), keep_first=keep).collect()}
    assert got == dict(enumerate(brute_removal(rows, substrings.LENGTH, keep)))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_longer_anchors_part_windows_by_their_bytes(seed):
    """Each window lies in one half at every step, equal windows meet, and the anchor stands where its place says."""
    r = random.Random(seed)
    length, text = 20, bytes(r.choice(b"ab") for _ in range(90))
    at, anchor = 40, 5
    todo = [(text[at + anchor - length : at + length], length - anchor + 1, length - anchor, [])]
    while anchor < length:
        seen, after = {}, []
        for part, starts, place, path in todo:
            halves = substrings.lengthened(part, starts, place, anchor, length)
            assert sorted(s for a, b, *_ in halves for s in range(a, b + 1)) == list(range(starts))
            more = (length - anchor + 1) // 2
            for a, b, p, key in halves:
                assert part[p : p + anchor + more] == key and b <= p and p + anchor + more <= a + length
                for s in range(a, b + 1):
                    assert seen.setdefault(part[s : s + length], key) == key or path
                after.append((part[a : b + length], b - a + 1, p - a, [*path, key]))
        todo, anchor = after, anchor + more
    assert all(starts == 1 for _, starts, *_ in todo)


def test_passages_of_odd_rows(odd, empty):
    rows = substrings.remove_repeats(odd, keep_first=False).collect()
    assert len(rows) == odd.count() and substrings.remove_repeats(empty).count() == 0
    assert {r.doc_id: r.n_removed for r in rows}[6] == 40_000


def test_passages_of_rows_without_ids(spark):
    """Null and repeated ids: each text is judged by itself."""
    r = random.Random(3)
    words = lambda n: " ".join(f"{r.randrange(10**6)}" for _ in range(n))
    shared = words(60)
    rows = [(None, words(20) + shared), (None, shared + words(30)), (None, words(50)), (7, shared), (7, words(40)), (7, shared)]
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed) for x in substrings.remove_repeats(docs(spark, rows), keep_first=False).collect())
    assert got == sorted((i or 0, *v[:2]) for (i, _), v in zip(rows, brute_removal([(k, t) for k, (_, t) in enumerate(rows)], substrings.LENGTH), strict=True))


def test_the_first_of_repeated_rows_stays(spark):
    """Rows that are equal in id and text, or have no id: one copy is kept whole, all others go."""
    r = random.Random(4)
    t, u = (" ".join(f"{r.randrange(10**6)}" for _ in range(80)) for _ in range(2))
    rows = [(1, t), (1, t), (None, u), (None, u), (None, u), (2, "short")]
    got = [(x.doc_id, x.n_bytes, x.n_removed) for x in substrings.remove_repeats(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, len(t), 0), (1, len(t), len(t)), (None, len(u), 0), (None, len(u), len(u)), (None, len(u), len(u)), (2, 5, 0)], key=str)


def test_repeated_rows_give_their_intervals_once(spark):
    t = " ".join(str(k * 7919) for k in range(90))
    one, many = (substrings.repeated_passages(docs(spark, [(None, t)] * n + [(1, t)]), keep_first=False) for n in (1, 5))
    assert {r.doc_id: len(r.marks) for r in one.collect()} == {r.doc_id: len(r.marks) for r in many.collect()}


# benchmark items


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        last, row = row, [k]
        for j, b in enumerate(text):
            row.append(min(last[j] + (a != b), last[j + 1] + 1, row[j] + 1))
    return min(row)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=12).map(lambda b: bytes(97 + x % 4 for x in b)), st.binary(max_size=40).map(lambda b: bytes(97 + x % 4 for x in b)))
def test_bit_parallel_distance(item, text):
    assert decontaminate.myers(decontaminate.masks(item), len(item), text)[0] == edit_distance_inside(item, text)


def test_matches_are_those_within_budget():
    rng = random.Random(4)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(30))
    m, e = decontaminate.Matcher([(1, item)]), decontaminate.budget(decontaminate.normal(item))
    for edits in (0, 1, e // 2, e, e + 4, 3 * e):
        s = list(decontaminate.normal(item).decode())
        for _ in range(edits):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(["x", "", "yz"[: rng.randrange(3)]])
        text = "some words before " + "".join(s).upper() + "!! and after"
        d = edit_distance_inside(decontaminate.normal(item), decontaminate.normal(text))
        got = m.find(text)
        assert (got[0][1] == d if got else d > e), (edits, d, e, got)


def test_contaminated(spark, odd, empty):
    items = spark.createDataFrame([(1, "plain words of a short text"), (2, None), (3, ""), (None, "x"), (4, "!!"), (5, "one two three"), (5, "one two three")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(odd, items).collect())
    assert got == [(4, 1), (4, 1), (5, 1), (7, 5)]
    blocks = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(odd, items, block_bytes=10).collect())
    assert blocks == got
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0 == decontaminate.contaminated(empty, items).count()
    assert {r.doc_id for r in decontaminate.drop_contaminated(odd, items).collect()} == {None, 1, 2, 3, 6, 8}


def test_edited_items_planted_in_a_whole_table(spark):
    """Every item with edits up to its budget is found, in texts of the table, at a distance no greater than the edits."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if r.text]
    r, planted, want = random.Random(4), [], {}
    for n, (doc, text) in enumerate(rows):
        item_id, item = items[n % len(items)]
        s = list(decontaminate.normal(item).decode())
        edits = decontaminate.budget(decontaminate.normal(item))
        for _ in range(edits):
            at = r.randrange(len(s))
            s[at : at + 1] = r.choice([["q"], [], [s[at], "z"]])
        # a word that goes takes a space along, so a few planted passages lie beyond the budget
        n_item, plain = decontaminate.normal(item), decontaminate.normal("".join(s))
        want[doc, item_id] = decontaminate.myers(decontaminate.masks(n_item), len(n_item), plain)[0], edits
        planted.append((doc, f"{text} {''.join(s)} {text[:50]}"))
    found = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(docs(spark, planted).repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not [(k, d, most, found.get(k)) for k, (d, most) in want.items() if d <= most and found.get(k, 1 << 30) > d]
    assert sum(d <= most for d, most in want.values()) > 0.8 * len(want)


def test_planted_items(spark, corpus):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {(i, k) for i, t in corpus for k, b in items if decontaminate.normal(b) in decontaminate.normal(t)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, corpus), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 2


# pipeline


def test_pipeline_against_plain_stages(spark):
    """Each stage against a plain one, on what the stage before it kept."""
    import corpus_pipeline as p
    from millrace.llm import bpe, quality

    assert [n for n, _ in p.STAGES] == ["quality", "exact", "near", "decontaminate", "encode"]
    now = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    net, encoder = quality.learn(now, labels), bpe.encoder(bpe.word_vocabulary())
    for name, stage in p.STAGES:
        rows = {r.doc_id: r.text for r in now.collect()}
        after = stage(spark, now, DATA)
        if name == "encode":
            assert {r.doc_id: " ".join(map(str, r.ids)) for r in after.collect()} == {i: encoder.encode(t or "")[0] for i, t in rows.items()}
            break
        kept = {r.doc_id for r in after.collect()}
        assert after.columns == now.columns
        if name == "quality":
            s = net.scores([(t or "").encode() for t in rows.values()])
            assert kept == {i for i, x in zip(rows, s, strict=True) if x >= 0.5}
        elif name == "exact":
            best = {}
            for i, t in rows.items():
                best[exact.normal(t)] = max(i, best.get(exact.normal(t), i))
            assert kept == set(best.values())
        elif name == "near":
            assert kept == {i for i, c in brute_classes(rows.items()).items() if i == c}
        else:
            m = decontaminate.Matcher(items)
            assert kept == {i for i, t in rows.items() if not m.find(t)}
        now = spark.createDataFrame(after.collect(), after.schema)


def test_stages_judge_rows_of_repeated_and_null_ids(spark):
    import corpus_pipeline as p

    rng = random.Random(8)
    base, other, lone = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(120)) for k in "bol")
    item = " ".join(f"i{rng.randrange(10**6)}" for _ in range(30))
    schema, stages = "doc_id long, text string, _row int", dict(p.STAGES)

    def after(name, rows):
        df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], schema).repartition(3)
        out = stages[name](spark, df, "items")
        assert out.columns == df.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    def some(*rows):
        return sorted(rows, key=str)

    assert after("exact", [(1, "a"), (1, "b"), (2, "a")]) == some((1, "b"), (2, "a"))
    assert after("exact", [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (None, None), (3, None)]) == some((1, "a"), (None, "b"), (3, None))
    assert after("near", [(1, base), (1, other), (2, edited(base, 2, rng)), (None, edited(other, 2, rng)), (2, lone), (2, lone), (None, "n w"), (None, "n w")]) == some((1, base), (1, other), (2, lone), (None, "n w"))
    real = p.table
    p.table = lambda *_: spark.createDataFrame([(1, item)], "item_id long, text string")
    try:
        assert after("decontaminate", [(1, base + " " + item), (1, base), (None, item), (None, lone), (1, base)]) == some((1, base), (1, base), (None, lone))
    finally:
        p.table = real


def test_pipeline_of_empty_and_odd_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline as p

    def after(name, docs, labels, items):
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        return p.run(spark, f"{tmp_path}/{name}")

    labels = spark.createDataFrame([(None, 1), (4, None), (None, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(None, "plain words"), (1, None), (2, ""), (3, "one two three")], "item_id long, text string")
    assert after("empty", empty, labels.where("false"), items.where("false")).count() == 0
    # labels that teach nothing reject nothing; null and empty texts are one, of equal texts the greatest id stays, 7 holds an item
    got = sorted((r.doc_id or 0, r.n_tokens > 0) for r in after("odd", odd, labels, items).collect())
    assert [i for i, _ in got] == [0, 2, 3, 5, 6, 8] and not dict(got)[2]


def test_run_leaves_no_stage_behind_but_the_last(spark, monkeypatch):
    import corpus_pipeline as p

    written, gone = [], []
    stored, discard = p.stored, p.discard
    monkeypatch.setattr(p, "stored", lambda df, name: written.append(stored(df, name)) or written[-1])
    monkeypatch.setattr(p, "discard", lambda *frames: gone.extend(frames) or discard(*frames))
    out = p.run(spark, DATA)
    assert len(written) == 4 and gone == written[:3] and out.count() == written[3].count() > 0
