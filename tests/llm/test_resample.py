"""Importance resampling against a plain computation in Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from millrace.llm import resample
from millrace.llm.resample import chunks, importance_sample, plain

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, words):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, words + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, words, buckets, least, percent):
    bucket = lambda x: crc32(x.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, words)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        n, fs = features(text, words)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("words", [1, 3])
def test_corpus(spark, corpus, words):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    target = ["the quick brown fox " * 3, None, "Über allen Gipfeln ist Ruh 2024"]
    got = importance_sample(docs, spark.createDataFrame([(x,) for x in target], "text string"), words=words, percent=30)
    assert Counter(map(tuple, got.collect())) == brute(corpus, target, words, 10_000, 20, 30)


def test_odd_rows_in_chunks(spark, odd, empty, monkeypatch):
    """Repeated and null ids, empty texts, and texts of many chunks."""
    target = spark.createDataFrame([("plain words seven",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for words in (1, 2):
        got = importance_sample(odd, target, words=words, buckets=50, least=1, percent=50)
        assert Counter(map(tuple, got.collect())) == brute(rows, ["plain words seven"], words, 50, 1, 50)
    assert importance_sample(empty, target).count() == 0
    none = importance_sample(odd, target.where("false"), buckets=50, least=1, percent=50)
    assert Counter(map(tuple, none.collect())) == brute(rows, [], 1, 50, 1, 50)
    cut = resample.sums(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id", "text", resample.gains(*[resample.np.arange(50)] * 2), words=2, size=100)
    whole = resample.sums(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id", "text", resample.gains(*[resample.np.arange(50)] * 2), words=2)
    assert Counter(map(tuple, cut.collect())) == Counter(map(tuple, whole.collect()))


def test_long_text_is_dealt_over_tasks(spark):
    docs = spark.createDataFrame([(1, "ab cde " * 20_000)], "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("key"), "text")
    n = sum(1 for _ in chunks(plain(rows.first().text), 2, 1000))
    assert n == 140
    assert b"".join(own for own, _ in chunks(plain(rows.first().text), 2, 1000)) == plain(rows.first().text)


@pytest.mark.parametrize("words", [1, 2, 4])
def test_chunks_own_each_start_once(words):
    text = "a bb ccc  dddd\n\n" * 7 + "x" * 90 + " " * 60 + "end of it"
    w = plain(text).split()
    want = Counter(b" ".join(w[k : k + n]) for n in range(1, words + 1) for k in range(len(w) - n + 1))
    got = Counter()
    for own, carry in chunks(plain(text), words, 16):
        o = own.split()
        all_ = o + carry.split()[: words - 1]
        got.update(b" ".join(all_[k : k + n]) for n in range(1, words + 1) for k in range(min(len(o), len(all_) - n + 1)))
    assert got == want
