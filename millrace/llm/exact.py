"""Exact duplicates by counting quotient filters (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, cut, keyed, modest, small, strings, utf8, without

#: Distinct fingerprints that a merging task should hold, on average.
SLICE_ROWS = 2_000_000


class QuotientFilter:
    """A counting quotient filter over 64-bit fingerprints, without loss.

    The top ``q`` bits of a fingerprint are its quotient, which names its home slot; the rest is its remainder.
    Remainders of one quotient form a run of ascending slots, shifted right where an earlier run is in the way.
    ``occupied`` marks quotients that have a run, ``run_end`` the last slot of each run; ``counts`` stands beside
    the remainders. Runs are in the order of their quotients, so the fingerprints come back sorted.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray | None = None):
        fps, back = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
        many = np.bincount(back, weights=counts, minlength=len(fps)).astype(np.int64) if len(fps) else np.zeros(0, np.int64)
        self.q = max(1, int(np.ceil(np.log2(max(1, len(fps)) / 0.75))))
        quotient = (fps >> np.uint64(64 - self.q)).astype(np.int64)
        order = np.arange(len(fps))
        slot = np.maximum.accumulate(quotient - order) + order if len(fps) else order
        size = max(1 << self.q, int(slot[-1]) + 1 if len(fps) else 1)
        self.occupied, self.run_end, self.used = np.zeros(1 << self.q, bool), np.zeros(size, bool), np.zeros(size, bool)
        self.remainders, self.counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.occupied[quotient] = True
        self.used[slot] = True
        self.run_end[slot[np.flatnonzero(np.append(quotient[1:] != quotient[:-1], True))] if len(fps) else []] = True
        self.remainders[slot] = fps & np.uint64((1 << (64 - self.q)) - 1)
        self.counts[slot] = many

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order and their counts, from the bit vectors and slots alone."""
        at = np.flatnonzero(self.used)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        run = np.cumsum(self.run_end[at]) - self.run_end[at]
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotient << np.uint64(64 - self.q)) | self.remainders[at], self.counts[at]

    def pack(self) -> bytes:
        """Bytes of the filter: q, slots, then bit vectors and the used slots' remainders and counts."""
        at = np.flatnonzero(self.used)
        head = np.array([self.q, len(self.used), len(at)], np.int64).tobytes()
        return b"".join([head, np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(), np.packbits(self.used).tobytes(), self.remainders[at].tobytes(), self.counts[at].tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> QuotientFilter:
        f = cls.__new__(cls)
        f.q, size, n = (int(x) for x in np.frombuffer(data, np.int64, 3))
        at = 24

        def bits(count: int) -> np.ndarray:
            nonlocal at
            length = (count + 7) // 8
            out = np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=count).astype(bool)
            at += length
            return out

        f.occupied, f.run_end, f.used = bits(1 << f.q), bits(size), bits(size)
        f.remainders, f.counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        f.remainders[f.used] = np.frombuffer(data, np.uint64, n, at)
        f.counts[f.used] = np.frombuffer(data, np.int64, n, at + 8 * n)
        return f

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with the sums of the counts; nothing is lost, as quotient and remainder give the fingerprint."""
        parts = [f.items() for f in filters]
        return cls(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def normal(text: str) -> bytes:
    """UTF-8 of the text with A-Z, and nothing else, in lower case."""
    return utf8(text).lower()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, sha) of every row: the first 8 bytes of SHA-256 of the normalised text, and all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            sha = [hashlib.sha256(normal(x)).digest() for x in strings(b.column(1))]
            fp = np.frombuffer(b"".join(x[:8] for x in sha), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), pa.array(sha, pa.binary())], ["doc_id", "fp", "sha"])

    return modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long, sha binary")


def repeated_fingerprints(fps: DataFrame, slices: int) -> DataFrame:
    """(fp, n) of fingerprints that occur more than once in column ``fp``.

    Each task builds filters of its own rows, one for each of ``slices`` equal ranges of fingerprints; filters of
    the same range meet in one task and merge. A hot fingerprint is one slot with a count before anything moves.
    """
    step = (1 << 64) // slices + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for b in bounded(batches):
            held.append(np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), return_counts=True))
            if len(held) > 16:
                held = [QuotientFilter(*map(np.concatenate, zip(*held, strict=True))).items()]
        fps, n = QuotientFilter(*map(np.concatenate, zip(*held, strict=True))).items()
        edge = np.searchsorted(fps, np.array([min(k * step, (1 << 64) - 1) for k in range(1, slices)], np.uint64))
        bounds = [0, *edge.tolist(), len(fps)]
        full = [k for k in range(slices) if bounds[k] < bounds[k + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([QuotientFilter(fps[bounds[k] : bounds[k + 1]], n[bounds[k] : bounds[k + 1]]).pack() for k in full], pa.binary())], ["slice", "filter"])

    def meet(t: pa.Table) -> pa.Table:
        fps, n = QuotientFilter.merge([QuotientFilter.unpack(x) for x in t.column("filter").to_pylist()]).items()
        return pa.table({"fp": fps[n > 1].astype(np.int64), "n": n[n > 1]})

    return fps.select("fp").mapInArrow(build, "slice int, filter binary").groupBy("slice").applyInArrow(meet, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of texts that are identical after lower-casing A-Z: one row per row of ``docs``.

    Columns doc_id, keep_id (largest doc_id of the class), group_size, kept, text_sha256. Null text counts as
    empty, so null and empty texts are one class. A null doc_id ranks below all others; a class of nothing else
    has a null keep_id and keeps its rows. Rows that repeat a doc_id count each in group_size, and each is kept if
    its id is the class's keep_id. An empty table gives no rows. Other columns are ignored.

    Fingerprints that the merged filters count once are unique. Rows of the others are read again, and their whole
    texts are grouped byte by byte (with partial aggregation, so a hot text moves once per task).
    """
    seen = cut(digests(docs, id_col, text_col))
    slices = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), seen.count() // SLICE_ROWS + 1)
    again = cut(repeated_fingerprints(seen, slices))
    keys = small(again.select("fp"))

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            texts = [normal(x) for x in strings(b.column(1))]
            fp = np.frombuffer(b"".join(hashlib.sha256(x).digest()[:8] for x in texts), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), pa.array(texts, pa.binary())], ["doc_id", "fp", "bytes"])

    rows = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    suspects = rows.mapInArrow(normalise, "doc_id long, fp long, bytes binary").join(keys, "fp", "left_semi")
    classes = suspects.groupBy("fp", "bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = cut(classes.select("fp", F.unhex(F.sha2("bytes", 256)).alias("sha"), "keep_id", "group_size"))
    out = seen.join(small(classes), ["fp", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of ``exact_groups``; columns as they were.

    It is the row of the largest id, null ranking below all; any one of them where that id is repeated in the class.
    """
    rows, key = keyed(docs, id_col)
    found = exact_groups(rows, key, text_col)
    if key == id_col:
        gone = cut(found.where("not kept").select("doc_id"))
    else:
        ids = rows.select(F.col(key).alias("doc_id"), F.col(id_col).cast("long").alias("id"))
        many = cut(found.where("group_size > 1").select("doc_id", F.col("keep_id").alias("class")).join(ids, "doc_id"))
        best = many.groupBy("class").agg(F.max(F.struct("id", "doc_id"))["doc_id"].alias("doc_id"))
        gone = cut(many.select("doc_id").join(best.select("doc_id"), "doc_id", "left_anti"))
    return without(rows, key, gone).select(*docs.columns)
