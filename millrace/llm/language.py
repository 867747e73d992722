"""Language of a text by cross-parsing entropy over suffix automata (operator 2)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, modest, strings, utf8
from millrace.llm.samples import hash_sample, held_out, training_rows

#: Labelled rows drawn for each language, and bytes of their texts that each automaton holds.
ROWS_EACH, BYTES_EACH = 60, 24_000
#: Bytes that all automata together hold; with many languages each gets less.
BYTES_ALL = 480_000
#: Bytes of a stretch; longer texts are walked in several side by side, until each begins where the one before ends.
STRETCH = 4096
#: Bytes of text that are parsed side by side.
BATCH = 4_000_000

#: Letters stay; digits are one symbol; every other ASCII byte is a space.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 48 if chr(b).isdigit() else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower-cased UTF-8 with one space between words."""
    return b" ".join(utf8(text.lower()).translate(_FOLD).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of ``text`` (Blumer et al.); state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(move)
        move.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p != -1:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return move


class CrossParser:
    """Counts the phrases into which each language's labelled text parses a text.

    A phrase is the longest match from where the last one ended: a walk through the suffix automaton until no
    transition fits (Ziv and Merhav, 1993), from a text's first byte to its last. Languages' tables stand below each other in one array; an entry holds
    twice the next row plus 1 if a phrase ended there, with the walk begun again at the start.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        used = sorted({c for s in samples.values() for c in s})
        self.code = np.full(256, len(used), np.int64)
        self.code[used] = np.arange(len(used))
        self.width = width = len(used) + 1
        tables, self.start, base = [], [], 0
        for lang in self.langs:
            move = suffix_automaton(samples[lang])
            t = np.full((len(move), width), -1, np.int64)
            for state, out in enumerate(move):
                for c, to in out.items():
                    t[state, self.code[c]] = base + to * width
            first = np.where(t[0] < 0, base, t[0])
            tables.append(np.where(t < 0, first * 2 + 1, t * 2).ravel().astype(np.int32))
            self.start.append(base)
            base += len(move) * width
        self.table = np.concatenate(tables)
        # phrases of n labelled bytes: each costs log2(n) bits
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.langs])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases by text and language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= BATCH):
                size += len(texts[end])
                end += 1
            out[begin:end] = self.parse(texts[begin:end])
            begin = end
        return out

    def parse(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts])
        data = self.code[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int32)
        of = np.repeat(np.arange(len(texts)), -(-sizes // STRETCH))
        if not len(of):
            return np.zeros((len(texts), len(self.langs)), np.int64)
        first = np.cumsum(sizes) - sizes
        nth = np.arange(len(of)) - np.repeat(np.cumsum(-(-sizes // STRETCH)) - -(-sizes // STRETCH), -(-sizes // STRETCH))
        at = first[of] + nth * STRETCH
        left = np.minimum(STRETCH, sizes[of] - nth * STRETCH)
        # each stretch is walked from the start of the automata, then again from where the one before it ended, until
        # no such entry differs: walks that begin apart soon fall together at the end of a phrase
        entry = np.repeat(np.array(self.start, np.int32)[:, None], len(of), 1)
        count, leave = self.walk(data, at, left, entry)
        follows = np.flatnonzero(nth > 0)
        while len(again := follows[(leave[:, follows - 1] != entry[:, follows]).any(0)]):
            entry[:, again] = leave[:, again - 1]
            count[:, again], leave[:, again] = self.walk(data, at[again], left[again], entry[:, again])
        out = np.stack([np.bincount(of, weights=c, minlength=len(texts)) for c in count], 1).astype(np.int64)
        out[sizes > 0] += 1  # the phrase that the end cuts off
        return out

    def walk(self, data: np.ndarray, at: np.ndarray, left: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each stretch, and the rows that the walks reach, by language."""
        order = np.argsort(-left, kind="stable")
        at, left, state = at[order], left[order], entry[:, order]
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")  # stretches longer than each step
        for step, n in enumerate(active.tolist()):
            found = self.table[state[:, :n] + data[at[:n] + step]]
            count[:, :n] += found & 1
            np.right_shift(found, 1, out=state[:, :n])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return count[:, back], state[:, back]

    def best(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language of fewest normalised phrases for each text, and how far it leads: 0.5 is a tie, 1 no rival."""
        cost = self.phrases(texts) * self.bits
        lead = cost.argmin(1)
        if len(self.langs) == 1:
            return [self.langs[0]] * len(texts), [1.0] * len(texts)
        two = np.partition(cost, 1, axis=1)[:, :2]
        return [self.langs[k] for k in lead], (two[:, 1] / np.maximum(two.sum(1), 1e-9)).tolist()


def learn(docs: DataFrame, rows_each: int = ROWS_EACH, bytes_each: int = BYTES_EACH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Labelled text by language: at most ``rows_each`` rows of ``bytes_each`` bytes in all, drawn by hash of id and text, ids null or repeated included."""
    rows = training_rows(docs, id_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    samples: dict[str, list[bytes]] = {}
    for r in hash_sample(rows.select("doc_id", "lang", F.substring("text", 1, bytes_each).alias("text")), "lang", rows_each).orderBy("lang", F.xxhash64(F.col("doc_id").cast("string"), "text"), "text").toLocalIterator():
        samples.setdefault(r["lang"], []).append(folded(r["text"]))
    size = min(bytes_each, BYTES_ALL // max(1, len(samples)))
    return {lang: joined for lang, parts in samples.items() if (joined := share(parts, size))}


def share(parts: list[bytes], size: int) -> bytes:
    """Parts joined to ``size`` bytes, of each an equal share where there is enough."""
    out, left = [], size
    for k, p in enumerate(sorted(parts, key=len)):
        take = p[: left // (len(parts) - k)]
        out.append(take)
        left -= len(take)
    return b" ".join(x for x in out if x)


@functools.lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, bytes], ...]) -> CrossParser:
    """One set of automata for each worker process and model."""
    return CrossParser(dict(samples))


def identify(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, whole texts, without a shuffle.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. Ties go to the language that sorts
    first. Only the text decides; repeated rows give equal results; other columns are ignored.
    """
    model = tuple(sorted(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(model) if model else None
        for b in bounded(batches):
            texts = strings(b.column(1))
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            known = [k for k, t in enumerate(texts) if p and any(map(str.isalpha, t))]
            if known:
                for k, x, y in zip(known, *p.best([folded(texts[k]) for k in known]), strict=True):
                    lang[k], score[k] = x, y
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``identify`` with what it learned from the rows that may be learned from, and which rows were held out."""
    found = identify(docs, learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
