"""Near-duplicates by SimHash fingerprints and the generalised pigeonhole principle (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from millrace.llm.common import bounded, components, cut, discard, mix64, modest, small, stored, utf8
from millrace.llm.resample import chunks

#: Words of a shingle, and bits in which the fingerprints of a link may differ.
WORDS, DISTANCE = 3, 2
#: Seed of the shingle hashes.
SEED = 42
#: Counters of the sketch that estimates how many fingerprints share the bits of a partition, and the least count that it reports.
COUNTERS, REPORTED = 1 << 16, 8
#: Fingerprints of one bucket beyond which it is not probed; its members and probers meet at single flipped bits instead.
HOT = 64
_BITS = 64
_LOWER = bytes(k + 32 if chr(k) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 if chr(k) in " \t\n\v\f\r" else k for k in range(256))


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned SimHash of a text: a bit is 1 if it is set in over half the hashes of its shingles, repeats included.

    A text of fewer words has one shingle, of all its words; one without words has the fingerprint 0.
    """
    ones, n = np.zeros(_BITS, np.int64), 0
    data = utf8(text).translate(_LOWER)
    for own, carry in chunks(data, words):
        w = own.split()
        first = len(w)
        w += carry.split()[: words - 1]
        runs = [b" ".join(x) for x in zip(*(w[k:] for k in range(words)), strict=False)][:first]
        if not runs and not n and len(w) < words:
            runs = [b" ".join(data.split())] if len(data.split(maxsplit=words)) < words and w else []
        h = np.array([xxh64_intdigest(x, SEED) for x in runs], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            fp = np.array([fingerprint(t.as_py() or "", words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def column(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them each two bits are both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((_BITS, _BITS))
        for b in batches:
            x = np.unpackbits(column(b).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(x)
        values = np.append(both.astype(np.int64).ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "n"])

    seen = fps.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    out = np.zeros(_BITS * _BITS + 1, np.int64)
    for r in seen:
        out[r.cell] = r.n
    return int(out[-1]), out[:-1].reshape(_BITS, _BITS)


def partitioned(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of about the same size, each grown around the bit of most correlation.

    Bits that agree say little more together than alone, so they stand in one group: a query then has groups of few
    companions, to which thresholds can go, and groups of many, to which none goes.
    """
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(_BITS)), []
    for k in range(parts):
        size = (_BITS * (k + 1)) // parts - (_BITS * k) // parts
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


class Sketch:
    """Fixed-size counts of the fingerprints that share the bits of a partition, over all of them."""

    def __init__(self, n: int, parts: list[list[int]]):
        self.n, self.parts = n, parts
        self.masks = np.array([sum(1 << b for b in g) for g in parts], np.uint64)
        self.usual = [n / 2.0 ** len(g) for g in parts]
        self.counts = np.zeros((len(parts), COUNTERS), np.float32)

    def slots(self, part: int, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(values + np.uint64(part + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(COUNTERS)).astype(np.int64)

    def build(self, fps: DataFrame) -> Sketch:
        """Sums each task's counters; those well above the mean come to the driver, a bounded number."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(self.parts), COUNTERS), np.int64)
            for b in batches:
                x = column(b)
                for k, mask in enumerate(self.masks):
                    total[k] += np.bincount(self.slots(k, x & mask), minlength=COUNTERS)
            some = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], ["slot", "n"])

        mean = self.n / COUNTERS
        seen = fps.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > max(REPORTED, 4 * mean)).toArrow()
        self.counts.ravel()[seen["slot"].to_numpy()] = seen["n"].to_numpy() - mean
        return self

    def near(self, x: np.ndarray) -> np.ndarray:
        """(fingerprint, partition, threshold -1 to DISTANCE): how many others lie within the threshold, estimated.

        Up to one flipped bit by the counters of all the values that would be probed; from two on by as many usual buckets.
        """
        out = np.zeros((len(x), len(self.parts), DISTANCE + 2), np.float32)
        for k, (bits, mask) in enumerate(zip(self.parts, self.masks, strict=True)):
            v, probes = x & mask, 1
            out[:, k, 1] = self.counts[k, self.slots(k, v)] + self.usual[k]
            out[:, k, 2] = out[:, k, 1] + sum(self.counts[k, self.slots(k, v ^ np.uint64(1 << b))] + self.usual[k] for b in bits)
            for t in range(2, DISTANCE + 1):
                probes *= (len(bits) - t + 1) / t * (len(bits) if t == 2 else 1)
                out[:, k, t + 1] = out[:, k, t] + probes * (self.usual[k] + 1)
        return out


def allocations(parts: int, distance: int = DISTANCE) -> np.ndarray:
    """Every way to give partitions thresholds of -1 or more that sum up to ``distance`` - ``parts`` + 1."""
    return np.array([t for t in product(range(-1, distance + 1), repeat=parts) if sum(t) == distance - parts + 1], np.int64)


def thresholds(near: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The thresholds of each fingerprint that cost least, by dynamic programming over partitions and what is left of the sum.

    A partition costs its probes and the companions that it is expected to find. Whatever two fingerprints differ in, if
    they differ in no more bits than allowed, some partition differs by no more than its threshold, as the thresholds
    sum up to the distance less the other partitions.
    """
    n, parts, steps = near.shape
    budget = (steps - 2) - parts + 1 + parts  # thresholds + 1, summed over partitions
    cost = near + probes[None]
    best = np.full((n, budget + 1), np.inf, np.float32)
    best[:, 0] = 0
    taken = np.zeros((n, parts, budget + 1), np.int8)
    for k in range(parts):
        now = np.full_like(best, np.inf)
        for step in range(min(steps, budget + 1)):
            reach = best[:, : budget + 1 - step] + cost[:, k, step, None]
            better = reach < now[:, step:]
            now[:, step:][better] = reach[better]
            taken[:, k, step:][better] = step
        best = now
    out, left = np.zeros((n, parts), np.int64), np.full(n, budget)
    for k in range(parts - 1, -1, -1):
        out[:, k] = taken[np.arange(n), k, left]
        left -= out[:, k]
    return out - 1


def probe_counts(parts: list[list[int]], distance: int = DISTANCE) -> np.ndarray:
    """(partition, threshold -1 to ``distance``): values within the threshold of one."""
    out = np.zeros((len(parts), distance + 2))
    for k, g in enumerate(parts):
        ball, total = 1.0, 0.0
        for t in range(distance + 1):
            total += ball
            out[k, t + 1] = total
            ball *= (len(g) - t) / (t + 1)
    return out


def probes(fps: DataFrame, sketch: Sketch) -> DataFrame:
    """(part, value, a): what each fingerprint looks up, by thresholds of its own."""
    cost = probe_counts(sketch.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, rows=20_000):
            x = column(b)
            t = thresholds(sketch.near(x), cost)
            found = []
            for k, (bits, mask) in enumerate(zip(sketch.parts, sketch.masks, strict=True)):
                flips = [np.zeros(1, np.uint64)]
                one = np.array([1 << bit for bit in bits], np.uint64)
                for radius in range(DISTANCE + 1):
                    if radius:  # one more bit than the last, which stands above those that are flipped
                        last = flips[-1]
                        flips.append(np.array([f | o for f in last.tolist() for o in one.tolist() if o > f], np.uint64))
                    mine = x[t[:, k] >= radius]
                    if len(mine):
                        v = (mine & mask)[:, None] ^ flips[radius][None]
                        found.append((np.full(v.size, k), v.ravel(), np.repeat(mine, v.shape[1])))
            part, value, a = map(np.concatenate, zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(a.view(np.int64))], ["part", "value", "a"])

    return fps.mapInArrow(run, "part int, value long, a long")


def meetings(fps: DataFrame) -> DataFrame:
    """(a, b): links among ``fps``, which meet at what one flipped bit makes of them.

    Two of them within two bits have a value within one bit of both. No more than 65 can meet at a value, and all
    that do are within two bits of each other; so the least of them stands for them.
    """
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << k) - (1 << _BITS if k == _BITS - 1 else 0)).cast("long") for k in range(_BITS)))
    at = fps.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("value"))
    met = at.groupBy("value").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): enough links of at most ``distance`` (2) differing bits to join all distinct fingerprints that any chain of such links does."""
    n, both = bit_statistics(fps)
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    # with two partitions a query probes 34 buckets of 32 bits, with three 3 of 21: few probes for few fingerprints
    parts = min((2, 3), key=lambda m: 33 * (3 - m) + 3 + (34 if m == 2 else 3) * n / 2.0 ** (_BITS // m))
    sketch = Sketch(n, partitioned(n, both, parts)).build(fps)
    masks = F.array(*(F.lit(int(m.astype(np.int64))) for m in sketch.masks))
    index = fps.select(F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("part", "value"), F.col("fp").alias("b"))
    asked = stored(probes(fps, sketch), "probes")
    full = cut(index.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("part", "value"))
    hot = small(full)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    cool = index.join(hot, ["part", "value"], "left_anti").alias("i")
    found = asked.alias("q").join(cool, (F.col("q.part") == F.col("i.part")) & (F.col("q.value") == F.col("i.value")) & (F.col("a") < F.col("b")) & near).select("a", "b")
    late = cut(asked.join(hot, ["part", "value"], "left_semi").select("part", "value", F.col("a").alias("fp")))
    reached = small(late.select("part", "value").distinct())
    crowd = late.select("fp").unionByName(index.join(reached, ["part", "value"], "left_semi").select(F.col("b").alias("fp"))).distinct()
    out = cut(found.unionByName(meetings(crowd)).distinct())
    discard(asked)
    return out


def simhash_components(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: chains of fingerprints that differ in at most two bits.

    The component id is the least doc_id of the chain. Null and empty texts, and texts without words, have fingerprint 0,
    which links like any other. Rows with a null id belong to components but name none; one of such rows alone has a null
    component. Rows of one id are documents of their own. An empty table gives no rows; other columns are ignored.

    1. Equal fingerprints are one from here on.
    2. Correlated bits are grouped into partitions. Each fingerprint gets thresholds that sum up to what the generalised
       pigeonhole principle asks for, by least estimated cost, and probes the buckets within them; matches are verified.
    3. Buckets of over ``HOT`` members (a dense cloud of near copies) are not probed: their members and those that would probe
       them meet at single flipped bits, which is as exact and never makes a large group.
    """
    seen = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    heads = cut(seen.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(heads.select("fp"))).withColumnRenamed("node", "fp")
    linked = heads.join(roots, "fp").select("fp", "root", "least")
    joined = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    # those alone name themselves; hot ones are met where their documents are
    alone = heads.where("n > 1").join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    named = cut(joined.unionByName(alone))
    out = seen.join(small(named), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out
