"""Benchmark passages in documents by pigeonhole edit matching (operator 9)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, cut, keyed, modest, stored, strings, utf8, without

#: Edits allowed for each byte of an item's normal form.
ERROR_RATE = 0.08
#: Bytes of item text that one pass over the documents broadcasts to the workers; more items mean more passes.
BLOCK_BYTES = 4_000_000
#: ASCII that is no letter or digit separates words; A-Z becomes a-z.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower-cased words joined by one space; punctuation and layout are gone."""
    return b" ".join(utf8(text.lower()).translate(_WORDS).split())


def budget(item: bytes, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    """(offset, piece) for ``errors + 1`` pieces: that many edits leave one of them untouched."""
    edge = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:], strict=False) if b > a]


def masks(item: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(peq: dict[int, int], m: int, text: bytes) -> tuple[int, int]:
    """(least edit distance of the item to any substring of ``text``, end of the first such), by bit-parallel columns."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, end


class Matcher:
    """Finds items in texts: exact hits of pieces give diagonals, and Myers' distance decides on the windows around them."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        normalised = sorted({(i, normal(t)) for i, t in items if i is not None})
        self.items = [(i, t, budget(t, rate), masks(t)) for i, t in normalised if t]
        found: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, t, e, _) in enumerate(self.items):
            for at, piece in pieces(t, e):
                found.setdefault(piece, []).append((k, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece.decode("latin-1"), where)
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, errors allowed, end in the normal form) for each item within its budget."""
        if not self.items:
            return []
        s = normal(text)
        hits: dict[int, set[int]] = {}
        for end, where in self.automaton.iter(s.decode("latin-1")):
            for k, off in where:
                hits.setdefault(k, set()).add(end + 1 - off)
        out = []
        for k, starts in hits.items():
            item_id, t, e, peq = self.items[k]
            m, best = len(t), None
            if not e:
                whole = [d for d in sorted(starts) if (d == 0 or s[d - 1] == 32) and (d + m == len(s) or s[d + m : d + m + 1] == b" ")]
                best = (0, whole[0] + m) if whole else None
            else:
                order = sorted(starts)
                first = last = order[0]
                for d in [*order[1:], None]:
                    if d is not None and d - last <= 2 * e:
                        last = d
                        continue
                    a = max(0, first - e)
                    dist, end = myers(peq, m, s[a : last + m + e])
                    if dist <= e and (best is None or dist < best[0]):
                        best = (dist, a + end)
                        if not dist:
                            break
                    first = last = d
            if best:
                out.append((item_id, best[0], e, best[1]))
        return sorted(out)


_MATCHERS: dict[str, Matcher] = {}


def matcher(name: str, block, rate: float) -> Matcher:
    """The matcher of one broadcast block, built once in a worker process; only the latest is kept."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(block.value, rate)
    return _MATCHERS[name]


def matches(rows: DataFrame, items: DataFrame, rate: float) -> tuple[DataFrame, Broadcast]:
    """Matches of ``rows`` (doc_id, text) with ``items`` (i, t), whose texts are few enough to broadcast."""
    block = rows.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in items.collect()])
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(name, block, rate)
        for b in bounded(batches):
            found = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True) for hit in m.find(t)]
            cols = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()], strict=True)], ["doc_id", "item_id", "distance", "errors_allowed", "end_at"])

    return rows.mapInArrow(run, "doc_id long, item_id long, distance int, errors_allowed int, end_at long"), block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item it holds within the item's error budget.

    Columns doc_id, item_id, distance (edits of the best occurrence), errors_allowed, end_at (end of the first best
    occurrence, in bytes of the document's normal form). The budget is ``rate`` times the bytes of the item's normal
    form; an item with budget 0 must stand there exactly, between word ends. Null or empty items, items without a
    letter or digit and items without an id match nothing; null and empty texts hold nothing. Repeated items count
    once, repeated rows of ``docs`` each give their matches. Either table may be empty. Documents are scanned whole,
    without a shuffle.

    Items are broadcast, never more than about ``block_bytes`` of their texts at a time, as a sum of their sizes tells
    beforehand. Where there are more, they go in blocks by a hash: the documents are scanned once for each, its
    matches are written to the shared folder, and its items leave driver and workers before the next.
    """
    rows = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null").distinct()
    blocks = (every.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes + 1
    if blocks == 1:
        return matches(rows, every, rate)[0]
    every, parts = cut(every), []
    for k in range(blocks):
        found, block = matches(rows, every.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k), rate)
        parts.append(stored(found, "matches"))
        block.destroy()
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns as they were. Each row is judged by its own text, whatever its id."""
    rows, key = keyed(docs, id_col)
    bad = cut(contaminated(rows, items, id_col=key, text_col=text_col).select("doc_id").distinct())
    return without(rows, key, bad).select(*docs.columns)
