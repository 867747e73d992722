"""Token counts by a compiled finite-state transducer (operator 6)."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded, modest, strings

#: Characters with a column of their own in the transition table: those that stand in most pieces.
COLUMNS = 120
#: Characters of a chunk, and of the texts whose chunks run side by side.
CHUNK, BATCH = 1024, 3_000_000
#: Places before a chunk without a certain cut from which its likely entry states are found.
PHASES = 24
#: Transitions hold the next state above these bits, and the emitted count plus BIAS in them.
BITS, BIAS = 6, 32
#: States after which the table is emptied and compiled anew as texts ask for it; bounds a worker's memory.
MAX_STATES = 220_000
SPACE = "▁"


def piece_model() -> str:
    """Path of the 32k piece model; the file stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter:
    """Counts the tokens of a BPE model with byte fallback by a deterministic transducer over characters.

    After each prefix of a text the encoding of that prefix has one last token. With a next character, the last token
    of the longer prefix is the one piece ending there that may follow the token before it: BPE of the two joined
    gives back the two. Its count is one more than that of the prefix before it. So all that the future can ask of a prefix is, for
    each of its ends that begins some piece, the last token before that end and the count there relative to now. That
    is a state; each transition is annotated with the tokens it emits, which may be negative where pieces merge.
    States and transitions are compiled when a text first needs them and kept in a dense table.

    Between two characters that stand together in no piece every state leads to one and the same, so the map of states
    of a chunk with such a place is constant, and all those chunks run side by side from there. Of a chunk without, the
    map is built over all states that it may be entered in, again side by side; maps of such chunks in a row compose
    through a parallel prefix scan, in as many steps as the logarithm of their number.
    """

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.score = dict(kind)
        self.begins = {s[:k] for s in self.score for k in range(1, len(s))}
        self.longest = max(map(len, self.score))
        if self.longest >= BIAS:
            raise ValueError(f"a piece of {self.longest} characters: emitted counts of less than -{BIAS} have no room")
        self.inner = {(a, b) for s in self.score for a, b in zip(s, s[1:], strict=False)}
        often = Counter(c for s in self.score if len(s) > 1 for c in set(s))
        self.column = {c: k for k, (c, _) in enumerate(often.most_common(COLUMNS))}
        # further columns: a rare character of a long piece, then characters alone by the tokens they give (1 to 4)
        self.rare = COLUMNS
        self.width = COLUMNS + 5
        self.table_of = np.empty(0x110000, np.int16)
        codes = np.arange(0x110000)
        self.table_of[:] = COLUMNS + np.select([codes < 0x80, codes < 0x800, codes < 0x10000], [1, 2, 3], 4)
        for c in self.score:
            if len(c) == 1:
                self.table_of[ord(c)] = COLUMNS + 1
        for c in often:
            self.table_of[ord(c)] = self.column.get(c, self.rare)
        self.table_of[32] = self.table_of[ord(SPACE)]
        names = list(self.column)
        self.joined = np.zeros((self.width, self.width), bool)
        for a, b in self.inner:
            self.joined[self.column.get(a, self.rare), self.column.get(b, self.rare)] = True
        self.names = names
        self.follows: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states but the one at a certain cut (0)."""
        self.states: list[tuple] = [("", (("", 0),))]
        self.number = {self.states[0]: 0}
        self.table = np.full((4096, self.width), -1, np.int32)
        self.rare_moves: dict[tuple[int, str], int] = {}
        self.isolate(0)

    def isolate(self, state: int) -> None:
        for n in (1, 2, 3, 4):
            self.table[state, COLUMNS + n] = 0 << BITS | n + BIAS

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the model's rule: best score first, leftmost on ties."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        """Whether a text's tokens can have ``b`` right after ``a``."""
        if not a or (a[-1], b[0]) not in self.inner:
            return self.merged(b) == [b]
        key = (a, b)
        known = self.follows.get(key)
        if known is None:
            known = self.follows[key] = self.merged(a + b) == [a, b]
            if len(self.follows) > 2_000_000:
                self.follows.clear()
        return known

    def step(self, state: int, c: str) -> int:
        """Packed transition of ``state`` by a character of the long pieces."""
        end, ends = self.states[state]
        # ends: (last token before the suffix, relative count) for each suffix length that begins a piece, ascending; the first has length 0
        lengths = self.lengths(end)
        if ends[0][0] and (ends[0][0][-1], c) not in self.inner:
            end, ends, lengths = "", (("", 0),), (0,)
        token, count = None, 0
        for k, (before, rel) in zip(reversed(lengths), reversed(ends), strict=True):
            piece = (end[-k:] if k else "") + c
            if piece in self.score and self.may_follow(before, piece):
                token, count = piece, rel + 1
                break
        if token is None:
            raise ValueError(f"no token ends at {c!r} after {end!r}")
        longer = end + c
        new_ends, keep = [(token, 0)], ""
        for k, (before, rel) in zip(lengths, ends, strict=True):
            suffix = longer[len(longer) - k - 1 :]
            if suffix in self.begins:
                new_ends.append((before, rel - count))
                keep = suffix
        key = (keep, tuple(new_ends))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            if number >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.isolate(number)
        return number << BITS | count + BIAS

    @functools.lru_cache(maxsize=200_000)
    def lengths(self, end: str) -> tuple[int, ...]:
        """Lengths of the suffixes of ``end`` that begin a piece, with 0."""
        return (0, *(k for k in range(1, len(end) + 1) if end[-k:] in self.begins))

    def compile(self, state: np.ndarray, column: np.ndarray, code: np.ndarray, found: np.ndarray, missing: np.ndarray) -> None:
        """Fill in the transitions that ``found`` lacks."""
        for k in missing.tolist():
            s, c = int(state[k]), int(column[k])
            if c < COLUMNS:
                v = int(self.table[s, c])
                if v < 0:
                    v = self.step(s, self.names[c])
                    self.table[s, c] = v
            else:
                v = self.rare_moves.get((s, chr(code[k])))
                if v is None:
                    v = self.rare_moves[(s, chr(code[k]))] = self.step(s, chr(code[k]))
            found[k] = v

    def run(self, at: np.ndarray, length: np.ndarray, state: np.ndarray, columns: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and emitted counts of stretches that begin at ``at`` in ``state``."""
        order = np.argsort(-length, kind="stable")
        at, length, state = at[order], length[order], state[order].astype(np.int64)
        count = np.zeros(len(at), np.int64)
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for step, n in enumerate(active.tolist()):
            here = at[:n] + step
            column = columns[here]
            found = self.table.ravel()[state[:n] * self.width + column]
            missing = np.flatnonzero(found < 0)
            if len(missing):
                self.compile(state, column, codes[here], found, missing)
            count[:n] += (found & ((1 << BITS) - 1)) - BIAS
            state[:n] = found >> BITS
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def composed(self, whole: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, count: np.ndarray, columns: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``state`` and ``count`` with the ends and counts of the chunks ``whole``, which have no certain cut.

        The map of a chunk is a list of rows (chunk, state in) -> (state out, count). The first of a row of such
        chunks is entered in one known state; for the others the likely ones are found by runs from places shortly
        before the chunk, and what the map of the chunk before leads to is added until nothing is missing.
        """
        first = np.append(True, np.diff(whole) > 1)  # its chunk before has a certain cut, so a known end
        later = np.flatnonzero(~first)
        # a run begun at any place stands for "a text that begins here"; places lie within the chunk before
        back = np.arange(1, min(PHASES, CHUNK) + 1)
        at = (begin[whole[later]][:, None] - back).ravel()
        guess, _ = self.run(at, np.tile(back, len(later)), np.zeros(len(at), np.int64), columns, codes)
        base = np.int64(1) << 32
        new = np.unique(np.concatenate([np.flatnonzero(first) * base + state[whole[first] - 1], np.repeat(later, len(back)) * base + guess]))
        key, out, emitted = (np.zeros(0, np.int64) for _ in range(3))
        follows = np.append(~first[1:], False)  # whether the next of ``whole`` is the next chunk
        while len(new):
            k = new // base
            s, n = self.run(begin[whole[k]], (end - begin)[whole[k]], new % base, columns, codes)
            key, out, emitted = np.append(key, new), np.append(out, s), np.append(emitted, n)
            order = np.argsort(key)
            key, out, emitted = key[order], out[order], emitted[order]
            on = follows[key // base]
            new = np.setdiff1d((key[on] // base + 1) * base + out[on], key)
        # compose: jump[p] is the row that 2 ** level chunks lead to from row p, or one past the last where the row of chunks ends
        jump = np.where(follows[key // base], np.searchsorted(key, (key // base + 1) * base + out), len(key))
        levels = [np.append(jump, len(key))]
        while (levels[-1][:-1] < len(key)).any():
            levels.append(levels[-1][levels[-1]])
        entered = np.searchsorted(key, np.flatnonzero(first) * base + state[whole[first] - 1])
        for step in reversed(levels):
            entered = np.unique(np.append(entered, step[entered]))
        entered = entered[entered < len(key)]
        chunk = whole[key[entered] // base]
        state, count = state.copy(), count.copy()
        state[chunk], count[chunk] = out[entered], emitted[entered]
        return state, count

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each whole text."""
        out, k = np.zeros(len(texts), np.int64), 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) <= BATCH):
                size += len(texts[end])
                end += 1
            out[k:end] = self.batch(texts[k:end])
            k = end
            if len(self.states) > MAX_STATES:
                self.clear()
        return out

    def batch(self, texts: list[str]) -> np.ndarray:
        # the dummy prefix: a space before each text that is not empty
        full = [" " + t if t else "" for t in texts]
        sizes = np.array([len(t) for t in full], np.int64)
        codes = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(len(texts), np.int64)
        codes = np.where(codes == 32, np.uint32(ord(SPACE)), codes)
        columns = self.table_of[codes].astype(np.int64)
        many = -(-sizes // CHUNK)
        of = np.repeat(np.arange(len(texts)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        begin = (np.cumsum(sizes) - sizes)[of] + nth * CHUNK
        end = begin + np.minimum(CHUNK, sizes[of] - nth * CHUNK)
        cut = np.append(True, ~self.joined[columns[:-1], columns[1:]])  # before this character every state is as good as 0
        cut[begin[nth == 0]] = True
        after = np.append(np.flatnonzero(cut), len(codes))
        sure = np.minimum(after[np.searchsorted(after, begin)], end)  # from here on a chunk's map is constant
        state, count = self.run(sure, end - sure, np.zeros(len(of), np.int64), columns, codes)
        head = sure - begin
        whole = head == end - begin
        whole[nth == 0] = False  # empty heads
        if whole.any():
            state, count = self.composed(np.flatnonzero(whole), begin, end, state, count, columns, codes)
        # all chunks are now known to their ends; what is left are heads before certain cuts
        rest = np.flatnonzero((head > 0) & ~whole)
        _, n = self.run(begin[rest], head[rest], state[rest - 1], columns, codes)
        count[rest] += n
        return np.bincount(of, weights=count, minlength=len(texts)).astype(np.int64)


@functools.cache
def counter(path: str) -> PieceCounter:
    """One transducer for each worker process."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, whole texts, without a shuffle.

    Null and empty texts have no bytes and no tokens. Rows are independent: repeated rows and null ids come back as
    they are, and other columns are ignored.
    """
    path = path or piece_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in bounded(batches):
            n = c.counts(strings(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
