"""BPE encoding and decoding by forced boundaries (operator 7)."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, modest, strings, utf8

#: Bytes, about, of a worker's cache of stretches between white space, which are looked up first; the generation before it is
#: kept beside it. That of words has half as many, that of fragments a sixth.
CACHE = 72_000_000
#: Bytes of a cache entry beside its strings, and symbols from which a stretch is never kept and merges through a heap.
ENTRY, LONG = 350, 128
# Letters and numbers of Unicode 16 and 17, which the tokenizers library, of Unicode 15.1 here, takes for neither.
LATER = """
558 58b-58c 88f c5c cdc 1c89 208f 209d-209f a7cb-a7cc a7ce-a7cf a7d2 a7d4 a7da a7dc-a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10d50-10d65 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
# Capitals of Unicode 16 and 17 with their small letters, which the library does know.
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Ids are numbers of so many bits, so that two fit one; what stands for a pair that does not merge.
BITS = 20
MASK, NEVER = (1 << BITS) - 1, 1 << 62


def word_vocabulary() -> str:
    """Path of the 49k word vocabulary; the file stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Generations(dict):
    """A cache bounded by the bytes of what it holds: when full, it becomes the old generation and an empty one takes its place."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.old, self.size = make, limit, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONG:
                return value
        size = ENTRY + len(key) + len(value[0]) + len(value[1])
        if self.size + size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += size
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.size = {}, 0


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder for a byte-level BPE file with an end-of-word suffix.

    Two adjacent symbols that stand together inside no token can never be merged into one, so there is a certain
    cut between them, whatever stands around: fragments between such cuts are encoded on their own and their ids
    concatenated. White space, which no token holds, is the most frequent such cut.
    """

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.word = regex.compile(pattern)
        later = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split())
        self.later = regex.compile(f"[{later}]")
        #: The pattern for words with such a character: letters and numbers less the later ones.
        self.word_later = regex.compile("(?V1)" + regex.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--[{later}]]", pattern))
        self.plain = [self.ids[c] for c in self.symbols]  # ids of the bytes, within a word and at its end
        self.final = [self.ids[c + self.suffix] for c in self.symbols]
        self.id_text = {i: str(i) for i in self.ids.values()}
        #: Of each two ids that may stand together in a token: rank and id of their merge, or NEVER; other pairs are certain cuts.
        self.pair = {self.ids[x] << BITS | self.ids[y]: NEVER for token in self.ids for x, y in self.pairs(token)}
        for rank, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.pair[self.ids[x] << BITS | self.ids[y]] = rank << BITS | self.ids[x + y]
        self.fragment = Generations(self.merge, cache // 6)
        self.words = Generations(self.encode_word, cache // 2)
        self.chunk = Generations(self.encode_chunk, cache)

    def pairs(self, token: str) -> Iterator[tuple[str, str]]:
        s = self.split_symbols(token)
        return zip(s, s[1:], strict=False)

    def split_symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, symbols: tuple[int, ...]) -> tuple[str, str]:
        """Ids and tokens of one fragment."""
        return self.merge_found(list(symbols), [self.pair.get(x << BITS | y, NEVER) for x, y in zip(symbols, symbols[1:], strict=False)])

    def merge_found(self, parts: list[int], found: list[int]) -> tuple[str, str]:
        """The adjacent pair of least rank, leftmost first, merges until none can; ``found`` holds what ``pair`` says of each."""
        if len(parts) > LONG:
            return self.merge_long(parts)
        get = self.pair.get
        while found:
            least = min(found)
            if least == NEVER:
                break
            at = found.index(least)
            del found[at], parts[at]
            parts[at] = new = least & MASK
            if at:
                found[at - 1] = get(parts[at - 1] << BITS | new, NEVER)
            if at < len(found):
                found[at] = get(new << BITS | parts[at + 1], NEVER)
        return self.shown(parts)

    def merge_long(self, symbols: list[int]) -> tuple[str, str]:
        """As ``merge``, in n log n: pairs wait in a heap, by rank and place, and are skipped if they are no more."""
        parts: list[int | None] = list(symbols)
        n, get = len(parts), self.pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f, k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if (f := get(x << BITS | y, NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            least, k = heapq.heappop(heap)
            j = after[k]
            if parts[k] is None or j >= n or get(parts[k] << BITS | parts[j]) != least:
                continue
            parts[k], parts[j] = least & MASK, None
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (f := get(parts[k] << BITS | parts[j], NEVER)) != NEVER:
                    heapq.heappush(heap, (f, k))
            i = before[k]
            if i >= 0 and (f := get(parts[i] << BITS | parts[k], NEVER)) != NEVER:
                heapq.heappush(heap, (f, i))
        return self.shown([t for t in parts if t is not None])

    def shown(self, parts: list[int]) -> tuple[str, str]:
        return " ".join([self.id_text[t] for t in parts]), " ".join([self.strings[t] for t in parts])

    def encode_word(self, word: str) -> tuple[str, str]:
        """Ids and tokens of one word of the pattern: its fragments' results, one after another."""
        data = utf8(word)
        s = [self.plain[b] for b in data]
        s[-1] = self.final[data[-1]]
        get = self.pair.get
        pairs = [get(x << BITS | y) for x, y in zip(s, s[1:], strict=False)]
        if None not in pairs:
            return self.merge_found(s, pairs)
        cuts = [0, *(k for k, p in enumerate(pairs, 1) if p is None), len(s)]
        return joined([self.fragment[tuple(s[i:k])] for i, k in zip(cuts, cuts[1:], strict=False)])

    def encode_chunk(self, chunk: str) -> tuple[str, str]:
        """Ids and tokens of a stretch without white space."""
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # sigma: without regard to word ends
        if not chunk.isascii() and self.later.search(text):
            return joined([self.words[w] for w in self.word_later.findall(text.translate(LATER_LOWER).lower())])
        text = text.lower()
        if text.isalpha():
            return self.words[text]
        if text[-1] in ".,!?;:" and text[:-1].isalpha():
            return joined([self.words[text[:-1]], self.words[text[-1]]])
        return joined([self.words[w] for w in self.word.findall(text)])

    def encode(self, text: str) -> tuple[str, str]:
        """(ids joined by one space, decoded text). Decoding joins token strings by spaces, as the file names no decoder."""
        parts = self.at_special.split(text) if self.at_special and "<|" in text else [text]
        found = []
        for part in parts:
            if part in self.special:
                found.append((str(self.special[part]), part))
            else:
                chunks = part.split() if not any(c in part for c in "\x1c\x1d\x1e\x1f") else [c for c in regex.split(r"\s+", part) if c]
                found += map(self.chunk.__getitem__, chunks)
        return joined(found)

    def forget(self) -> None:
        """Empties the caches; the vocabulary stays."""
        for cache in (self.fragment, self.words, self.chunk):
            cache.forget()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids if i in self.strings)


def joined(found: list[tuple[str, str]]) -> tuple[str, str]:
    if len(found) == 1:
        return found[0]
    ids, tokens = zip(*found, strict=True) if found else ((), ())
    return " ".join(ids), " ".join(tokens)


@functools.cache
def encoder(path: str, cache: int = CACHE) -> ForcedBoundaryBpe:
    """One encoder for each worker process."""
    return ForcedBoundaryBpe(path, cache)


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``, whole texts.

    Null and empty texts, and texts of white space, have no tokens; both digests are then of the empty string.
    Rows are independent: repeated rows and null ids come back as they are. Other columns are ignored. No shuffle.
    """
    path = path or word_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in bounded(batches):
            n, a, d = [], [], []
            for text in strings(b.column(1)):
                ids, tokens = bpe.encode(text)
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                d.append(hashlib.sha256(tokens.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE // 3) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, decoded) of every row; same rules as ``encode_digests``.

    Caches are smaller here, and emptied after each task, as ids and decoded texts take their room.
    """
    path = path or word_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, cache)
        for b in bounded(batches, 250):
            pairs = [bpe.encode(t) for t in strings(b.column(1))]
            n = [i.count(" ") + 1 if i else 0 for i, _ in pairs]
            flat = np.array(" ".join(i for i, _ in pairs if i).split(), np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(n, pa.int64()), pa.array([d for _, d in pairs], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])
        bpe.forget()

    rows = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")
