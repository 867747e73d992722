"""Near-duplicates by DartMinHash and banded joining (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, components, cut, discard, keyed, mix64, modest, small, stored, strings, utf8, without

#: Words of a shingle and weighted Jaccard similarity from which two texts are linked.
WORDS, SIMILARITY = 5, 0.8
#: Bands and coordinates of each: two texts of similarity 0.8 share no band with probability (1 - 0.8 ** 4) ** 28 = 4e-7.
BANDS, ROWS = 28, 4
#: Members, and characters of their texts, that a block of a cell holds on average.
BLOCK_ROWS, BLOCK_BYTES = 600, 4_000_000
#: Texts that are sketched at once, by words.
BATCH_WORDS = 120_000
_SEED = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text, words being runs without white space."""
    data = b" " + b" ".join(utf8(x) for x in text.lower().split()) + b" "
    b = np.frombuffer(data, np.uint8)
    gap = np.flatnonzero(b == 32)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(b), _BASE, np.uint64))
        back = np.cumprod(np.full(len(b), pow(_BASE, -1, 1 << 64), np.uint64))
        total = np.cumsum(b.astype(np.uint64) * power)
        return mix64((total[gap[1:] - 1] - total[gap[:-1]]) * back[gap[:-1]])


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each stands in the text.

    A text of fewer words than a shingle has one shingle, of all its words; one without words has none.
    """
    if not text or text.isspace():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = word_hashes(text)
    n = min(words, len(w))
    with np.errstate(over="ignore"):
        s = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            s = mix64(s + w[k : k + len(s)] + _SEED)
    return np.unique(s, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of the two texts' shingle counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 1.0


def dart_minhash(sets: list[tuple[np.ndarray, np.ndarray]], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash signatures (Christiani, 2020) of weighted sets: one 64-bit dart for each coordinate, row by set.

    An element of weight w owns the region of heights up to w above its name. Darts, placed by hashing the element,
    fall over regions at one per unit of height and unit of rank; each aims at one coordinate. A set throws only the
    darts of rank below (ln t + 2) t / W, of which there are about t ln t whatever its size W, and each coordinate keeps the
    dart of least rank, so two sets agree on a coordinate with the probability of their weighted Jaccard similarity.
    Sets that leave a coordinate empty throw again up to twice that rank. Whole units of weight are cells of the
    region, each with darts of its own.
    """
    t = coordinates
    out = np.zeros((len(sets), t), np.uint64)
    size = np.array([c.sum() for _, c in sets], np.float64)
    todo = np.flatnonzero(size > 0)
    limit = np.zeros(len(sets))
    limit[todo] = t * (np.log(t) + 2) / size[todo]
    while len(todo):
        elements = np.concatenate([np.repeat(sets[k][0], sets[k][1]) for k in todo])
        cell = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for c in (sets[k][1] for k in todo)]).astype(np.uint64)
        of = np.repeat(np.arange(len(todo)), size[todo].astype(np.int64))
        with np.errstate(over="ignore"):
            key = mix64(elements ^ mix64((cell + np.uint64(1)) * _SEED))
        most = limit[todo]
        rank, found = np.zeros(len(key)), []
        while len(key):  # the next dart of each cell: ranks grow by exponential gaps
            with np.errstate(over="ignore"):
                key = mix64(key + _SEED)
            rank = rank - np.log((key >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            keep = rank < most[of]
            key, rank, of = key[keep], rank[keep], of[keep]
            found.append((of, (mix64(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(t)).astype(np.int64), rank, key))
        of, place, rank, key = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((rank, place, of))
        slot = of[order] * t + place[order]
        first = order[np.append(True, slot[1:] != slot[:-1])] if len(order) else order
        full = np.bincount(of[first], minlength=len(todo)) == t
        done = full[of[first]]
        out[todo[of[first][done]], place[first][done]] = key[first][done]
        todo = todo[~full]
        limit[todo] *= 2
    return out


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each run of ``rows`` coordinates and its place."""
    s = signatures.reshape(len(signatures), -1, rows)
    with np.errstate(over="ignore"):
        h = np.repeat(np.arange(1, s.shape[1] + 1, dtype=np.uint64)[None, :] * _SEED, len(s), 0)
        for k in range(rows):
            h = mix64(h ^ s[:, :, k]) + _SEED
    return h


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, size, bands): a pair of 64-bit hashes of the shingle counts, characters, and the band hashes; none for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            ids, texts, at = b.column(0), strings(b.column(1)), 0
            while at < len(texts):
                sets, words, begin = [], 0, at
                while at < len(texts) and (not sets or words < BATCH_WORDS):
                    sets.append(shingles(texts[at]))
                    words += int(sets[-1][1].sum())
                    at += 1
                h = bands(dart_minhash(sets)).view(np.int64)
                some = np.array([len(s) > 0 for s, _ in sets])
                with np.errstate(over="ignore"):
                    content = [b"".join(mix64(s * (c.astype(np.uint64) * np.uint64(2) + np.uint64(1)) + np.uint64(k)).sum(dtype=np.uint64).tobytes() for k in (1, 2)) for s, c in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(some, h.shape[1], 0))).astype(np.int32)), pa.array(h[some].ravel()))
                size = pa.array([len(t) for t in texts[begin:at]], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(begin, at - begin), pa.array(content, pa.binary()), size, lists], ["doc_id", "content", "size", "bands"])

    rows = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, content binary, size long, bands array<long>")


def elements(text: str) -> np.ndarray:
    """One hash for each unit of weight of each shingle, so that weighted similarity is that of these sets."""
    s, c = shingles(text)
    unit = (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.repeat(s, c) ^ (unit * _SEED)


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Elements that each set of ``a`` shares with each of ``b``: products of 0/1 matrices over what both sides hold."""
    out = np.zeros((len(a), len(b)), np.float32)
    ea, eb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ea, eb)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    ka, kb = np.isin(ea, both), np.isin(eb, both)
    ca, cb = np.searchsorted(both, ea[ka]), np.searchsorted(both, eb[kb])
    ra, rb = ra[ka], rb[kb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    for at in range(0, len(both), width):
        m = []
        for rows, c, r in ((len(a), ca, ra), (len(b), cb, rb)):
            x, y = np.searchsorted(c, [at, at + width])
            part = np.zeros((rows, min(width, len(both) - at)), np.float32)
            part[r[x:y], c[x:y] - at] = 1
            m.append(part)
        out += m[0] @ m[1].T
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each run of equal first ``keys`` columns."""
    held: list[tuple] = []
    for b in bounded(batches):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def blocked(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, id, ..., block, blocks): members dealt by hash over as many blocks as bound their number and bytes."""
    many = cells.join(sizes, "id")
    blocks = many.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK_ROWS), F.sum("size") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    return many.drop("size").join(small(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def star_links(cells: DataFrame, sizes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the members of each cell that are like its hub, whose id names the cell. A hub goes to each block of its cell."""
    dealt = blocked(cells, sizes)
    at = F.when(F.col("id") == F.col("cell"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = dealt.select("cell", F.explode(at).alias("block"), (F.col("id") != F.col("cell")).alias("other"), "id").join(texts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, None
        for b in bounded(batches):
            links = []
            for cell, other, i, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if not other:
                    hub, mine = cell, elements(text)
                elif hub == cell:
                    x = elements(text)
                    n = len(np.intersect1d(mine, x, assume_unique=True))
                    if n >= similarity * (len(mine) + len(x) - n) - 1e-9:
                        links.append((hub, i))
            yield pairs_batch(links)

    ordered = rows.select("cell", "block", "other", "id", "text").repartition(F.col("cell"), F.col("block")).sortWithinPartitions("cell", "block", "other")
    return ordered.mapInArrow(run, "a long, b long")


def cross_links(cells: DataFrame, sizes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) for members of a cell that are alike but have different roots: a link for each two roots that have any.

    Each two blocks of a cell meet in one task, which holds no more than they have.
    """
    dealt = blocked(cells, sizes).join(texts, "id")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("lo"), F.greatest(x, F.col("block")).alias("hi")))
    rows = dealt.select("cell", F.explode(pair).alias("p"), "block", "id", "root", "text").select("cell", "p.lo", "p.hi", "block", "id", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 3):
            lo, hi = rows[0][1:3]
            sides = [[(r[4], r[5], elements(r[6])) for r in rows if r[3] == k] for k in (lo, hi)]
            if not sides[0] or not sides[1] or len({r[1] for s in sides for r in s}) < 2:
                continue
            a, b = sides
            n = overlaps([x[2] for x in a], [x[2] for x in b])
            size = [np.array([len(x[2]) for x in s], np.float32) for s in sides]
            roots = [np.array([x[1] for x in s]) for s in sides]
            alike = (n >= similarity * (size[0][:, None] + size[1][None] - n) - 1e-3) & (roots[0][:, None] != roots[1][None])
            links = {}
            for i, j in zip(*(v.tolist() for v in np.nonzero(alike)), strict=True):
                links.setdefault((a[i][1], b[j][1]), (a[i][0], b[j][0]))
            yield pairs_batch(list(links.values()))

    ordered = rows.repartition(F.col("cell"), F.col("lo"), F.col("hi")).sortWithinPartitions("cell", "lo", "hi")
    return ordered.mapInArrow(run, "a long, b long")


def pairs_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, kept) of every document: classes are chains of links of ``similarity`` or more.

    The class id is the least doc_id of the class, and that document is the one to keep. Null and empty texts, and
    texts without words, are classes of their own; so are documents that are like no other. Rows that repeat a
    doc_id are one document, of the text that sorts first. Rows with a null doc_id are left out. Other columns are
    ignored.

    1. Texts of equal shingle counts are one content, for which one document stands from here on.
    2. Each bucket of a band has a hub, the member with the most company over all its bands, as the original of many
       edited copies has; the members of all buckets of a hub are its cell. Members are held against their hubs on
       whole texts, and components follow.
    3. In buckets whose members are still in different components, all those of a cell are held against each other,
       block by block; only links come out. So a link is lost only if two texts share no band.
    """
    text = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = text.groupBy("doc_id").agg(F.min("text").alias("text")) if repeats(docs, id_col) else text
    seen = stored(sketches(docs), "sketches")
    some = seen.where(F.size("bands") > 0)
    # contents of several documents alone, so that a hot one moves once per task and is joined where its documents are
    heads = cut(some.groupBy("content").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("content", "head"))
    member = cut(some.select("doc_id", "content").join(small(heads), "content", "left").select("doc_id", F.coalesce("head", "doc_id").alias("head")))
    stand = some.join(member.where("doc_id = head").select("doc_id"), "doc_id", "left_semi")
    spread = stand.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    shared = cut(spread.join(spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band"))
    company = shared.groupBy("id").agg(F.sum("n").alias("company"))
    ranked = shared.join(company, "id")
    # the greatest company, then the least id: two aggregations, as neither orders by the other
    most = ranked.groupBy("band").agg(F.max("company").alias("company"))
    hubs = ranked.join(most, ["band", "company"]).groupBy("band").agg(F.min("id").alias("hub"))
    placed = cut(shared.select("band", "id").join(hubs, "band"))
    texts = docs.withColumnRenamed("doc_id", "id").where("id is not null")
    sizes = stand.select(F.col("doc_id").alias("id"), "size")
    links = cut(star_links(placed.select(F.col("hub").alias("cell"), "id").distinct(), sizes, texts, similarity))
    roots = components(links)
    labelled = cut(placed.join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "hub", "id", F.coalesce("root", "id").alias("root")))
    split = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    open_ = labelled.join(split, "band", "left_semi").select(F.col("hub").alias("cell"), "id", "root").distinct()
    more = cut(cross_links(open_, sizes, texts, similarity))
    roots = cut(components(links.unionByName(more)))
    named = member.join(roots.withColumnRenamed("node", "head"), "head", "left").select("doc_id", F.coalesce("root", "head").alias("class_id"))
    named = cut(named)
    sizes = cut(named.groupBy("class_id").agg(F.count("*").alias("class_size")).where("class_size > 1"))
    sized = named.join(small(sizes), "class_id", "left").withColumn("class_size", F.coalesce("class_size", F.lit(1)))
    alone = seen.where(F.size("bands") == 0).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    out = cut(sized.select("doc_id", "class_id", "class_size").unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("class_id")))
    discard(seen)
    return out


def repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether any document's id stands in more than one row."""
    return bool(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col)).count().where("count > 1").limit(1).count())


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates; columns as they were.

    Each row is judged by its own text, also where ids are null or repeated. The row of the least id stays, null ranking
    above all; any one of them where that id is repeated in the class.
    """
    rows, key = keyed(docs, id_col)
    found = near_classes(rows, id_col=key, text_col=text_col)
    if key == id_col:
        gone = found.where("not kept").select("doc_id")
    else:
        ids = rows.select(F.col(key).alias("doc_id"), F.col(id_col).cast("long").alias("id"))
        many = cut(found.where("class_size > 1").select("doc_id", "class_id").join(ids, "doc_id"))
        best = many.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))["doc_id"].alias("doc_id"))
        gone = cut(many.select("doc_id").join(best.select("doc_id"), "doc_id", "left_anti"))
    return without(rows, key, gone).select(*docs.columns)
