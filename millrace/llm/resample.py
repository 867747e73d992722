"""Resampling documents towards a target text by hashed n-gram importance weights (operator 11)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, keyed, modest, stored, strings, utf8
from millrace.llm.ranking import ranked

#: Buckets of hashed features, words of the longest feature, least words of a drawn document, and percent drawn.
BUCKETS, WORDS, LEAST, PERCENT = 10_000, 1, 20, 10
SEED = "2024"
#: Bytes of text from which a document is cut into chunks, and that a chunk has but for its last word.
CHUNK_BYTES = 200_000
#: Words whose bucket is remembered at once in a worker.
CACHED = 500_000

# Every byte of a character beyond ASCII belongs to a word, so bytes tell words as characters do: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
# after lower-casing A-Z.
_CLASS = bytes(k if k >= 0x80 or chr(k) in "0123456789abcdefghijklmnopqrstuvwxyz" else k + 32 if chr(k) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for k in range(256))


def plain(text: str) -> bytes:
    """The words of a text in lower case, with single bytes of white space for all that stands between them."""
    return utf8(text).translate(_CLASS)


def chunks(data: bytes, words: int, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, bytes]]:
    """(own, carry) pieces of ``data``: cut behind the word that byte ``size`` falls in, with the next ``words`` - 1 words.

    A chunk owns the features that begin in it; the carry completes those that end beyond it.
    """
    gap, follow = re.compile(rb" |\Z"), re.compile(rb"(?: *[^ ]+){0,%d}" % (words - 1))
    at = 0
    while at < len(data):
        end = gap.search(data, min(at + size, len(data))).start()
        yield data[at:end], follow.match(data, end).group()
        at = end


class Buckets:
    """Buckets of features, by the CRC-32 of their bytes; those of frequent words are remembered."""

    def __init__(self, words: int, buckets: int):
        self.words, self.buckets, self.known = words, buckets, {}

    def of(self, own: bytes, carry: bytes = b"") -> tuple[int, np.ndarray]:
        """How many words ``own`` has, and the bucket of each feature that begins there."""
        w, known = own.split(), self.known
        if len(known) > CACHED:
            known.clear()
        for x in set(w).difference(known):
            known[x] = crc32(x) % self.buckets
        out = [np.fromiter(map(known.__getitem__, w), np.int64, len(w))]
        if self.words > 1:
            all_ = w + carry.split()[: self.words - 1]
            for n in range(2, self.words + 1):
                runs = [b" ".join(all_[k : k + n]) for k in range(min(len(w), len(all_) - n + 1))]
                out.append(np.fromiter((crc32(x) % self.buckets for x in runs), np.int64, len(runs)))
        return len(w), np.concatenate(out)


def bucket_counts(texts: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: each task sums up what it has seen, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(buckets, np.int64), Buckets(words, buckets)
        for b in bounded(batches):
            for text in b.column(0):
                for own, carry in chunks(plain(text.as_py() or ""), words):
                    total += np.bincount(of.of(own, carry)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    seen = modest(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    for r in seen:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed share in the target and in the corpus."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = (((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets)) for s, t in zip(map(float, corpus), map(float, target), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def sums(docs: DataFrame, key: str, text_col: str, gain: np.ndarray, words: int = WORDS, size: int = CHUNK_BYTES) -> DataFrame:
    """(key, n_words, n_features, total): the gains of each document's features.

    Texts of at most ``size`` bytes are summed where they are. Longer ones are cut into chunks, which are dealt over all tasks by key and
    number, summed each, and added up by document.
    """
    buckets = len(gain)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(words, buckets)
        for b in bounded(batches):
            found = [of.of(plain(t)) for t in strings(b.column(1))]
            yield summed(b.column(0), found)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, rows=1):
            text = b.column(1)[0].as_py()
            for n, (own, carry) in enumerate(chunks(plain(text), words, size)):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n], pa.int64()), pa.array([own], pa.binary()), pa.array([carry], pa.binary())], ["key", "n", "own", "carry"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(words, buckets)
        for b in bounded(batches):
            found = [of.of(own.as_py(), carry.as_py()) for own, carry in zip(b.column(1), b.column(2), strict=True)]
            yield summed(b.column(0), found)

    def summed(keys: pa.Array, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        columns = [[n for n, _ in found], [len(x) for _, x in found], [int(gain[x].sum()) for _, x in found]]
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in columns)], ["key", "n_words", "n_features", "total"])

    form = "key long, n_words long, n_features long, total long"
    texts = modest(docs).select(F.col(key).cast("long").alias("key"), F.col(text_col).alias("text"))
    long_ = F.coalesce(F.octet_length("text") > size, F.lit(False))
    cut_up = texts.where(long_).mapInArrow(pieces, "key long, n long, own binary, carry binary")
    dealt = cut_up.repartition("key", "n").select("key", "own", "carry").mapInArrow(parts, form)
    added = dealt.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "total")))
    return texts.where(~long_).mapInArrow(whole, form).unionByName(added)


def importance_sample(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row: ``rank`` counts the drawn ones, the rest have null.

    A document's weight is the floored mean gain of its features, 0 if it has none; its score adds Gumbel noise that
    depends on id and seed alone, so the highest scores are a draw without replacement in proportion to the weights.
    ``percent`` of the documents with at least ``least`` words are drawn, rounded down, ties to the smaller id.

    Null and empty texts, and such without words, have no features and are never drawn unless ``least`` is 0. A null id counts
    as an empty one for the noise and comes after all others among ties. Rows of one id are documents of their own.
    Empty tables of documents give no rows; an empty target makes all its counts 0. Other columns are ignored.
    """
    rows, key = keyed(docs.select(id_col, text_col), id_col)
    gain = gains(bucket_counts(rows.select(text_col), words, buckets), bucket_counts(target.select(target_col), words, buckets))
    found = sums(rows, key, text_col, gain, words)
    if key != id_col:
        found = found.join(rows.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("doc_id")), "key")
    else:
        found = found.withColumn("doc_id", F.col("key"))
    n = F.col("n_features")
    mean = F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(found.select("doc_id", "n_words", "n_features", mean.alias("weight")).withColumn("score", F.col("weight") + noise), "scores")
    able = scored.where(F.col("n_words") >= least)
    draw = able.count() * percent // 100
    order = {"score": F.desc("score")}
    ties = {"doc_id": F.asc_nulls_last("doc_id"), "weight": F.asc("weight"), "n_features": F.asc("n_features")}
    drawn = ranked(able.select("doc_id", "n_features", "weight", "score"), [], order, ties, names=("rank", "_place", "_dense", "_tied"))
    columns = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    first = drawn.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return first.unionByName(scored.where(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank")))
