"""Repeated passages by suffix arrays and longest previous factors (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, cut, discard, keyed, mix64, modest, small, stored, strings, utf8

#: Bytes of a passage that counts as repeated.
LENGTH = 200
#: Bytes of an anchor; every window of LENGTH bytes has the anchor of least hash among its LENGTH - ANCHOR + 1.
ANCHOR = 48
#: Bytes of distinct surroundings of one anchor that one suffix array takes; an anchor with more is made longer.
GROUP_BYTES = 1_000_000
#: Bytes that a task gathers before it sorts their suffixes, and bytes of text whose anchors are found at once.
SORT_BYTES, SCAN_BYTES = 300_000, 150_000
_BASE = 0x100000001B3
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        p, q = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        return np.cumprod(p), np.cumprod(q)


class Hasher:
    """Polynomial hashes, modulo 2 ** 64, of the stretches of one buffer that have the same width."""

    def __init__(self, data: np.ndarray, base: int):
        self.up, self.down = powers(base, len(data) + 1)
        with np.errstate(over="ignore"):
            self.total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:-1]))

    def rolling(self, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.total[width:] - self.total[:-width]) * self.down[: len(self.total) - width])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours (van Herk, Gil and Werman)."""
    n = len(x)
    blocks = np.append(x, np.full(-n % width, _MOST, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def digests(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b of each stretch of the bytes, 128 bits as a row of two longs: equal digests stand for equal bytes."""
    found = b"".join([hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def anchored(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR, digest: bool = True) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: (text, first start, last start, anchor hash, and the stretch's digest).

    Equal windows have equal anchors, so a window can only repeat among stretches of the same anchor. A stretch ends
    where its anchor leaves the window, so no two windows of one stretch are equal.
    """
    kept = [k for k, t in enumerate(texts) if len(t) >= length]
    if not kept:
        return (*(np.zeros(0, np.int64),) * 4, np.zeros((0, 2), np.int64))
    sizes = np.array([len(texts[k]) for k in kept])
    joined = b"".join(texts[k] for k in kept)
    first = np.cumsum(sizes) - sizes
    grams = Hasher(np.frombuffer(joined, np.uint8), _BASE).rolling(anchor)
    least = sliding_min(grams, length - anchor + 1)
    valid = np.ones(len(least), bool)
    for f in first[1:].tolist():
        valid[f - length + 1 : f] = False
    change = np.append(True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (grams[: len(least) - 1] == least[:-1]))
    lo = np.flatnonzero(change)
    hi = np.append(lo[1:], len(least)) - 1
    lo, hi = lo[valid[lo]], hi[valid[lo]]
    # texts that touch: a stretch never holds windows of two, as those between are invalid (if LENGTH > 1)
    of = np.searchsorted(first, lo, side="right") - 1
    content = digests(joined, lo, hi + length) if digest else np.zeros((len(lo), 2), np.int64)
    return np.array(kept)[of], lo - first[of], hi - first[of], least[lo].view(np.int64), content


def anchor_place(stretch: bytes, starts: int, key: int, anchor: int = ANCHOR) -> int:
    """Where in the bytes of a stretch of so many windows its anchor stands: at its first place in each of them."""
    grams = Hasher(np.frombuffer(stretch, np.uint8), _BASE).rolling(anchor).view(np.int64)
    return int(np.flatnonzero(grams[starts - 1 :] == key)[0]) + starts - 1


def lengthened(stretch: bytes, starts: int, at: int, anchor: int, length: int) -> list[tuple[int, int, int, bytes]]:
    """The stretch in two, each with an anchor longer by half of what a window has beside it, rounded up.

    Windows with that much before the anchor get it before, the others have it behind. That depends on their bytes
    alone, so equal windows get equal anchors. Entries: first and last start, place of the new anchor, its bytes.
    """
    more, out = (length - anchor + 1) // 2, []
    if at >= more:
        out.append((0, min(starts - 1, at - more), at - more, stretch[at - more : at + anchor]))
    if at - more < starts - 1:
        out.append((max(0, at - more + 1), starts - 1, at, stretch[at : at + anchor + more]))
    return out


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the values."""
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
    return out


class Suffixes:
    """Suffixes of a buffer in the order of their first ``cap`` bytes, by prefix doubling.

    ``begin`` selects the suffixes that take part, those whose ``cap`` bytes lie within one stretch. ``order`` has
    them sorted, equal ones by position; ``lcp[k]`` is the length up to ``cap`` that k and k - 1 share.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, cap: int):
        self.n, self.cap, self.data = len(data), cap, data
        padded = np.append(data, np.zeros(cap + 8, np.uint8))
        key = np.zeros(self.n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : k + self.n].astype(np.uint64)
        rank, width, self.levels = dense(key), 8, []
        while True:
            self.levels.append((width, rank))
            if width * 2 > cap:
                break
            rank = dense(rank * (self.n + 1) + self.shifted(rank, width))
            width *= 2
        if cap > width:
            rank = dense(rank * (self.n + 1) + self.shifted(rank, cap - width))
        order = begin[np.lexsort((begin, rank[begin]))]
        self.order, self.rank = order, rank
        self.lcp = np.append(0, self.common(order[1:], order[:-1])) if len(order) else np.zeros(0, np.int64)

    def shifted(self, rank: np.ndarray, by: int) -> np.ndarray:
        return np.append(rank[by:] + 1, np.zeros(min(by, self.n), np.int64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length up to ``cap`` that the suffixes at ``a`` and ``b`` share, by ranks of halving widths, then bytes."""
        l = np.where(self.rank[a] == self.rank[b], self.cap, 0)
        for width, rank in reversed(self.levels):
            x, y = a + l, b + l
            ok = (l < self.cap) & (np.maximum(x, y) + width <= self.n)
            l = np.where(ok & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)]), l + width, l)
        going = l < self.cap
        for _ in range(8):
            x, y = np.minimum(a + l, self.n - 1), np.minimum(b + l, self.n - 1)
            going &= (np.maximum(a, b) + l < self.n) & (self.data[x] == self.data[y])
            l = l + going
        return np.minimum(l, self.cap)

    def previous_factors(self) -> np.ndarray:
        """For each place of ``order``, the longest match up to ``cap`` with a suffix that begins earlier.

        It is with the nearest smaller position before or behind in suffix order (Crochemore and Ilie, 2008); both
        are found by pointer jumps for all places at once, with the least shared length on the way.
        """
        out = np.zeros(len(self.order), np.int64)
        for back in (False, True):
            sa = self.order[::-1] if back else self.order
            lcp = np.append(0, self.lcp[:0:-1]) if back else self.lcp
            near, shared = np.arange(len(sa)) - 1, lcp.copy()
            todo = np.flatnonzero((near >= 0) & (sa[near] > sa))
            while len(todo):
                j = near[todo]
                shared[todo] = np.minimum(shared[todo], shared[j])
                near[todo] = near[j]
                todo = todo[(near[todo] >= 0) & (sa[near[todo]] > sa[todo])]
            shared[near < 0] = 0
            out = np.maximum(out, shared[::-1] if back else shared)
        return out


def repeated_starts(parts: list[bytes], length: int, later_only: bool) -> list[np.ndarray]:
    """For each part, the starts of its ``length``-byte windows that also stand elsewhere in the parts (or earlier)."""
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes) - sizes
    begin = np.concatenate([np.arange(f, f + s - length + 1) for f, s in zip(first.tolist(), sizes.tolist(), strict=True)])
    s = Suffixes(np.frombuffer(b"".join(parts), np.uint8), begin, length)
    hit = s.previous_factors() >= length
    if not later_only:
        # the first of equal windows, too: the next place in suffix order shares all of it
        hit |= np.append(s.lcp[1:] >= length, False)
    at = np.sort(s.order[hit])
    return [x - f for x, f in zip(np.split(at, np.searchsorted(at, first[1:])), first, strict=True)]


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)]


_PLACE = ("doc_id", "txt", "lo", "hi")


def text_rows(docs: DataFrame, id_col: str, text_col: str, own: str | None = None) -> DataFrame:
    """(doc_id, txt, text) of every row, and as ``own`` another id. ``txt``, a hash of the text, tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = [F.col(own).cast("long").alias("own")] if own else []
    return modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("txt"), text.alias("text"), *more)


def anchors(rows: DataFrame, length: int, digest: bool) -> DataFrame:
    """One row for each stretch of windows of one anchor, in every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            texts, at = [utf8(t) for t in strings(b.column(2))], 0
            while at < len(texts):
                begin, size = at, 0
                while at < len(texts) and (at == begin or size < SCAN_BYTES):
                    size += len(texts[at])
                    at += 1
                of, lo, hi, h, seg = anchored(texts[begin:at], length, digest=digest)
                ids = b.select([0, 1]).take(pa.array(of + begin))
                yield pa.RecordBatch.from_arrays([pa.array(h), *map(pa.array, seg.T), *ids.columns, pa.array(lo), pa.array(hi)], ["hash", "seg", "seg2", *_PLACE])

    return rows.mapInArrow(run, "hash long, seg long, seg2 long, doc_id long, txt long, lo long, hi long")


def sorted_marks(parts: DataFrame, length: int, later_only: bool) -> DataFrame:
    """(doc_id, txt, lo, hi) of repeated starts among parts (hash, doc_id, txt, lo, bytes) of equal hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            # document order, so that "earlier" means the same everywhere
            rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
            out = []
            for r, starts in zip(rows, repeated_starts([r[4] for r in rows], length, later_only), strict=True):
                out += [(r[1], r[2], r[3] + x, r[3] + y) for x, y in zip(*(v.tolist() for v in runs(starts)), strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], list(_PLACE))

        size = 0
        for b in bounded(batches):
            for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= SORT_BYTES and held[-1][0] != r[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield flush(held)

    rows = parts.select("hash", "doc_id", "txt", "lo", "bytes").repartition(F.col("hash")).sortWithinPartitions("hash")
    return rows.mapInArrow(run, "doc_id long, txt long, lo long, hi long")


def concerned(rows: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose (doc_id, txt) is among ``ids`` (or is not): a filter in place while the ids are few enough to broadcast."""
    keys = small(ids.select(F.col("doc_id").alias("c_id"), F.col("txt").alias("c_txt")).distinct())
    return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("txt") == F.col("c_txt")), "left_semi" if inside else "left_anti")


def beside(rows: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """``rows`` with the list ``name`` that ``lists`` has for their (doc_id, txt); rows without one are left out."""
    other = lists.select(F.col("doc_id").alias("w_id"), F.col("txt").alias("w_txt"), name)
    return concerned(rows, lists).join(other, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("txt") == F.col("w_txt"))).drop("w_id", "w_txt")


def classes(found: DataFrame, *others: str) -> DataFrame:
    """One row for each anchor and digest: how many stretches, the place of the first, and ``others``, equal in all."""
    place = F.min(F.struct(*_PLACE)).alias("at_place")
    return found.groupBy("hash", "seg", "seg2").agg(F.count("*").alias("n"), place, *(F.first(c).alias(c) for c in others)).select("hash", "seg", "seg2", "n", "at_place.*", *others)


def copied(found: DataFrame, each: DataFrame, keep_first: bool) -> DataFrame:
    """Places of stretches of equal bytes: all their windows repeat (with ``keep_first``, but for the first such stretch)."""
    many = each.where("n > 1").select("hash", "seg", "seg2", *(F.struct(*_PLACE).alias("f"),) * keep_first)
    out = found.join(small(many), ["hash", "seg", "seg2"])
    return (out.where(~F.struct(*_PLACE).eqNullSafe(F.col("f"))) if keep_first else out).select(*_PLACE)


def in_company(each: DataFrame, length: int) -> DataFrame:
    """Rows of ``classes`` whose anchor has several, with ``hot``: whether these have more bytes than one suffix array takes."""
    size = F.sum(F.col("hi") - F.col("lo") + length)
    mixed = each.groupBy("hash").agg(F.count("*").alias("kinds"), size.alias("size")).where("kinds > 1")
    return each.join(mixed.select("hash", (F.col("size") > GROUP_BYTES).alias("hot")), "hash")


def repeated_passages(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, txt, marks): intervals of starts (lo, hi) by text, checkpointed; every ``length``-byte window that begins at lo..hi of the text also stands elsewhere.

    With ``keep_first`` only where it stands earlier, in the order of doc_id, hash of the text (``txt``) and place. Texts are UTF-8
    bytes, null is empty; windows lie within one document, and matches within the same document count, overlapping
    ones too. Rows are documents even if they repeat an id or a text.

    1. Windows are grouped into stretches by their least anchor; anchors that occur once drop out by a count.
    2. Stretches of equal bytes, as a 128-bit digest tells, stand as one, and all their windows are marked.
    3. Of anchors with several surroundings the distinct stretches meet, and suffix arrays with longest previous
       factors decide on each window.
    4. An anchor with over ``GROUP_BYTES`` of them is made longer first: its stretches are cut in two by the side on
       which a window has more room, and meet again by the longer anchor from step 2. Half of the room goes each time,
       so after eight times an anchor is a window, of which there is one kind.
    """
    rows = text_rows(docs, id_col, text_col)
    often = cut(anchors(rows, length, False).select("hash").groupBy("hash").count().where("count > 1").select("hash"))
    found = stored(anchors(rows, length, True).join(small(often), "hash", "left_semi"), "stretches")
    each = cut(classes(found))
    marks, written = [copied(found, each, keep_first)], [found]
    wanted = in_company(each, length).select("doc_id", "txt", "hash", "lo", F.col("hi").alias("last"), "hot")
    by_doc = cut(wanted.groupBy("doc_id", "txt").agg(F.collect_list(F.struct("hash", "lo", "last", "hot")).alias("want")))
    # rows that repeat both id and text give their slices once
    parts = stored(beside(rows, by_doc, "want").mapInArrow(slicer(length), _PART), "parts")
    written.append(parts)
    parts, anchor = parts.dropDuplicates(["hash", "doc_id", "txt", "lo"]), ANCHOR
    while True:
        marks.append(sorted_marks(parts.where("not hot"), length, keep_first))
        hot = parts.where("hot")
        if not hot.limit(1).count():
            break
        split = stored(hot.mapInArrow(splitter(anchor, length), _SPLIT), "split")
        anchor += (length - anchor + 1) // 2
        each = stored(classes(split, "at", "bytes"), "classes")
        marks.append(copied(split, each, keep_first))
        parts = stored(in_company(each, length).select("hash", "doc_id", "txt", "lo", "at", "bytes", "hot"), "parts")
        written += [split, each, parts]
    every = reduce(DataFrame.unionByName, marks)
    # rows that repeat both id and text give the same intervals, which count once
    out = cut(every.groupBy("doc_id", "txt").agg(F.collect_set(F.struct("lo", "hi")).alias("marks")))
    discard(*written)
    return out


_PART = "hash long, doc_id long, txt long, lo long, at long, bytes binary, hot boolean"
_SPLIT = "hash long, seg long, seg2 long, doc_id long, txt long, lo long, hi long, at long, bytes binary"


def slicer(length: int) -> Callable:
    """From texts with the stretches wanted of them to the bytes of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            out = []
            for doc, txt, text, want in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                data = utf8(text)
                for w in want:
                    part = data[w["lo"] : w["last"] + length]
                    at = anchor_place(part, w["last"] - w["lo"] + 1, w["hash"]) if w["hot"] else -1
                    out.append((w["hash"], doc, txt, w["lo"], at, part, w["hot"]))
            yield table_batch(out, _PART)

    return run


def splitter(anchor: int, length: int) -> Callable:
    """From stretches of an anchor of so many bytes to those of longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            out = []
            for doc, txt, lo, at, part in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4, 5)), strict=True):
                for first, last, place, key in lengthened(part, len(part) - length + 1, at, anchor, length):
                    name = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)
                    sub = part[first : last + length]
                    seg = digests(sub, np.array([0]), np.array([len(sub)]))[0].tolist()
                    out.append((name, *seg, doc, txt, lo + first, lo + last, place - first, sub))
            yield table_batch(out, _SPLIT)

    return run


def table_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of longs, binaries and booleans, as the schema names them."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def covered(intervals: list[tuple[int, int]], length: int, size: int) -> list[tuple[int, int]]:
    """Maximal byte runs [begin, end) that windows starting in the intervals cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept bytes) of every row, without the passages that stand elsewhere.

    ``spans`` are the maximal removed runs [begin, end) in bytes, ``kept`` the remaining bytes concatenated. Null and
    empty texts have 0 bytes and no spans. An empty table gives no rows. Other columns are ignored. With ``keep_first``, rows of
    null or repeated ids are told apart by a number given as they are written once, and the first is that of the least
    number; those files stay.
    """
    docs, key = keyed(docs.select(id_col, text_col), id_col) if keep_first else (docs, id_col)
    by_doc = repeated_passages(docs, length, keep_first, key, text_col)
    rows = text_rows(docs, key, text_col, id_col)
    marked = beside(rows, by_doc, "marks").select("own", "text", "marks")
    joined = marked.unionByName(concerned(rows, by_doc, False).select("own", "text", F.lit(None).cast(by_doc.schema["marks"].dataType).alias("marks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            size, gone, spans, kept = [], [], [], []
            for text, marks in zip(strings(b.column(1)), b.column(2).to_pylist(), strict=True):
                data = utf8(text)
                off = covered([(m["lo"], m["hi"]) for m in marks or ()], length, len(data))
                size.append(len(data))
                gone.append(sum(y - x for x, y in off))
                spans.append([{"begin": x, "end": y} for x, y in off])
                edge = [0, *(v for s in off for v in s), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin: long, end: long>>, kept binary")
