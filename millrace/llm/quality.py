"""Quality of a text by a byte-level convolutional network in numpy (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, cut, modest, small, strings, utf8
from millrace.llm.samples import hash_sample, held_out, training_rows

#: Labelled rows drawn for each of the two labels, and bytes of their texts; the network learns from no more than these.
#: Where the texts have more bytes, those of greatest hash are left out, whole.
ROWS_EACH, BYTES_EACH = 1500, 48_000_000
#: Bytes of a chunk and from one chunk's start to the next: neighbours overlap and the last reaches the end.
CHUNK, STEP = 512, 448
#: Bytes that a filter sees, bytes between its places, numbers for each byte, filters.
WIDTH, STRIDE, DIM, FILTERS = 6, 2, 8, 24
#: The symbol after a text's end; its embedding stays zero.
PAD = 256
PLACES = (CHUNK - WIDTH) // STRIDE + 1
UPDATES, BATCH_DOCS, RATE = 700, 32, 0.01
#: Chunks whose responses are held at once.
BLOCK = 48


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all chunks of all texts, and the text of each chunk. An empty text has one chunk of padding."""
    sizes = np.array([len(t) for t in texts], np.int64)
    many = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    of = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    data = np.append(np.frombuffer(b"".join(texts), np.uint8).astype(np.int16), np.int16(PAD))
    at = (nth * STEP)[:, None] + np.arange(CHUNK)
    inside = at < sizes[of][:, None]
    first = np.cumsum(sizes) - sizes
    return data[np.where(inside, at + first[of][:, None], len(data) - 1)], of


@dataclass
class ByteNet:
    """Embedding of bytes, filters with ReLU pooled over each chunk, and a logistic unit over what chunks show.

    A text's features are the maximum and the mean over its chunks of each filter's largest response.
    """

    embed: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, seed: int = 7) -> ByteNet:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32)
        embed[PAD] = 0
        return cls(embed, r.normal(0, 0.2, (WIDTH * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """Filter values (chunk, place, filter)."""
        e = np.ascontiguousarray(self.embed[chunks])
        s = e.strides
        windows = np.lib.stride_tricks.as_strided(e, (len(chunks), PLACES, WIDTH * DIM), (s[0], STRIDE * s[1], s[2]), writeable=False)
        return windows.reshape(-1, WIDTH * DIM) @ self.weight + self.bias

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk, in blocks that stay in the cache."""
        parts = [self.responses(chunks[k : k + BLOCK]).reshape(-1, PLACES, FILTERS).max(1) for k in range(0, len(chunks), BLOCK)]
        return np.maximum(np.concatenate(parts), 0) if parts else np.zeros((0, FILTERS), np.float32)

    def scores(self, texts: list[bytes], batch: int = 500_000) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        out, k = [np.zeros(0)], 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) <= batch):
                size += len(texts[end]) + 1
                end += 1
            chunks, of = chunked(texts[k:end])
            p = self.pooled(chunks)
            starts = np.searchsorted(of, np.arange(end - k))
            most = np.maximum.reduceat(p, starts, axis=0)
            mean = np.add.reduceat(p, starts, axis=0) / np.diff(np.append(starts, len(of)))[:, None]
            out.append(1 / (1 + np.exp(-(np.hstack([most, mean]) @ self.out + self.out_bias[0]).astype(np.float64))))
            k = end
        return np.concatenate(out)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.weight, self.bias, self.out, self.out_bias]

    def gradients(self, chunks: np.ndarray, of: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over the texts, by each part."""
        n, docs = len(chunks), len(labels)
        place, top = np.empty((n, FILTERS), np.int64), np.empty((n, FILTERS), np.float32)
        for k in range(0, n, BLOCK):
            z = self.responses(chunks[k : k + BLOCK]).reshape(-1, PLACES, FILTERS)
            place[k : k + BLOCK] = z.argmax(1)
            top[k : k + BLOCK] = np.take_along_axis(z, place[k : k + BLOCK, None, :], 1)[:, 0, :]
        a = np.maximum(top, 0)
        starts = np.searchsorted(of, np.arange(docs))
        size = np.diff(np.append(starts, n))[:, None]
        most, mean = np.maximum.reduceat(a, starts, axis=0), np.add.reduceat(a, starts, axis=0) / size
        features = np.hstack([most, mean])
        p = 1 / (1 + np.exp(-(features @ self.out + self.out_bias[0])))
        d = ((p - labels) / docs).astype(np.float32)
        back = d[:, None] * self.out
        da = (back[:, FILTERS:] / size)[of]
        hit = a == most[of]
        first = hit & (np.cumsum(hit, 0) - np.vstack([np.zeros((1, FILTERS)), np.cumsum(hit, 0)])[starts][of] == 1)
        da = np.where(first, da + back[:, :FILTERS][of], da) * (top > 0)
        where = place[:, :, None] * STRIDE + np.arange(WIDTH)  # (chunk, filter, offset)
        symbols = chunks[np.arange(n)[:, None, None], where]
        seen = self.embed[symbols].reshape(n, FILTERS, WIDTH * DIM)
        dw = np.einsum("nf,nfk->kf", da, seen)
        de_rows = (da[:, :, None] * self.weight.T[None]).reshape(-1, DIM)
        flat = symbols.reshape(-1).astype(np.int64)
        de = np.stack([np.bincount(flat, weights=de_rows[:, k], minlength=PAD + 1) for k in range(DIM)], 1).astype(np.float32)
        de[PAD] = 0
        return [de, dw, da.sum(0), features.T @ d, d.sum(keepdims=True)]


def fit(texts: list[bytes], labels: np.ndarray, odds: float = 1.0, updates: int = UPDATES, seed: int = 7) -> ByteNet:
    """Adam over batches with as many texts of either label; the bias then moves by the log of ``odds``, label 1 to 0."""
    net, r = ByteNet.new(seed), np.random.default_rng(seed)
    classes = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not len(classes[0]) or not len(classes[1]):
        net.out[:] = 0
        net.out_bias[:] = 4.0 if len(classes[1]) else -4.0 if len(classes[0]) else 0.0
        return net
    m = [np.zeros_like(x) for x in net.parts()]
    v = [np.zeros_like(x) for x in net.parts()]
    for step in range(1, updates + 1):
        pick = np.concatenate([r.choice(c, BATCH_DOCS // 2) for c in classes])
        chunks, of = chunked([texts[k] for k in pick])
        rate = RATE * min(1.0, 2 * (1 - step / (updates + 1)))
        for k, (x, g) in enumerate(zip(net.parts(), net.gradients(chunks, of, labels[pick]), strict=True)):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            x -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.out_bias += np.float32(np.log(odds))
    return net


def fitting(rows: list[tuple[int, int, int, int]], bytes_each: int) -> set[tuple[int, int]]:
    """(label, id) of the rows (label, draw, id, bytes) that fit into ``bytes_each`` of their label, in the order of the draw; the shortest if none does."""
    left: dict[int, int] = {}
    taken = set()
    for label, _, i, size in sorted(rows):
        if size <= left.setdefault(label, bytes_each):
            left[label] -= size
            taken.add((label, i))
    some = {label for label, _, i, size in rows if size <= bytes_each}
    for label in left.keys() - some:
        taken.add((label, min((size, draw, i) for k, draw, i, size in rows if k == label)[2]))
    return taken


def learn(docs: DataFrame, labels: DataFrame, rows_each: int = ROWS_EACH, bytes_each: int = BYTES_EACH, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteNet:
    """A network fitted to at most ``rows_each`` labelled rows, and ``bytes_each`` bytes, of either label, drawn by hash of the id.

    A text that does not fit into what is left of the bytes is passed over; if no text of a label fits, its shortest one teaches.
    Rows without id or label teach nothing; a null text is empty; of an id that is repeated the text that sorts first counts. Without rows of both labels the score is constant.
    """
    marked = training_rows(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))).distinct()
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}  # two rows at most
    odds = counts[1] / counts[0] if len(counts) == 2 else 1.0
    chosen = hash_sample(marked, "label", rows_each)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(small(chosen, 2 * rows_each), "doc_id")
    # one text for each id, however often it is repeated
    rows = cut(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).withColumn("_draw", F.xxhash64("doc_id", F.lit("bytes"))))
    taken = fitting([tuple(r) for r in rows.select("label", "_draw", "doc_id", F.octet_length("text")).collect()], bytes_each)  # 2 * rows_each rows at most
    texts = rows.where(F.col("doc_id").isin([i for _, i in taken])).toLocalIterator() if taken else []
    found = sorted((r["doc_id"], r["label"], r["text"]) for r in texts if (r["label"], r["doc_id"]) in taken)
    return fit([utf8(t) for _, _, t in found], np.array([k for _, k, _ in found], np.float32), odds)


def score(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, whole texts, without a shuffle; only the text decides. Null texts score as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            found = net.scores([utf8(t) for t in strings(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: learned from rows that may be learned from, applied to all."""
    found = score(docs, learn(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that the network rejects; columns as they were, decided in one pass row by row."""
    net = learn(docs, labels, id_col=id_col, text_col=text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield b.filter(pa.array(net.scores([utf8(t) for t in strings(b.column(place))]) >= 0.5))

    return modest(docs).mapInArrow(run, docs.schema)
