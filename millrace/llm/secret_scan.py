"""Secrets in texts by patterns and sliding-window entropy, with DataFrame functions only (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_VALUE = "[A-Za-z0-9+/_.=-]+"
#: Base kinds in their order: name, pattern. Runs of one character class are matched with their least length at once,
#: which finds the same as matching the run and dropping short ones; assignments are filtered after matching.
ASSIGN = rf"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?({_VALUE})"
BASE = [("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]{24,}")]
LEAST_VALUE = 6


@dataclass(frozen=True)
class CharClass:
    """Runs that ``pattern`` finds are candidates; one tells that holds all ``needs`` and, in some window of ``window``
    characters, ``bits`` of entropy per character."""

    name: str
    alphabet: str
    pattern: str
    window: int
    bits: float
    needs: tuple[str, ...]


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_WIDE = _DIGITS + _LOWER + _LOWER.upper() + "+/_-"
_RUN = "[A-Za-z0-9+/_-]"
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdef" + "ABCDEF", "[0-9a-fA-F]{24,}", 24, 3.0, ("[0-9]", "[A-Za-z]")),
    CharClass("entropy_base64", _WIDE, _RUN + "{24,}", 24, 3.9, ("[0-9]", "[A-Za-z]")),
    CharClass("entropy_short", _WIDE, f"(?<!{_RUN}){_RUN}{{16,23}}(?!{_RUN})", 16, 3.5, ("[0-9]", "[a-z]", "[A-Z]")),
)
#: What is no secret, wherever it stands: placeholders, alphabets, UUIDs, digests of nothing.
_ALONE = "(?<![0-9A-Za-z]){}(?![0-9A-Za-z])"
ALLOW = (
    "(?i)example|sample|dummy|placeholder|changeme|x{8,}|0{8,}|1234567890|abcdefghij|"
    + _ALONE.format("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
    + "|"
    + _ALONE.format("(?:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)")
)
#: Counts of a window stand in 5 bits each, 12 to a word.
_BITS, _PER_WORD = 5, 12


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the value, which is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out`` of each of the items, of which there are some, in order, as ``step`` (state, item) -> (state, out) gives it; ``out`` is of type ``kind``.

    Arrays never change, so adding to one copies it. The items are taken in blocks of about the square root of their
    number, each with an array of its own: n items cost about n ** 1.5 moves of references.
    """
    empty = F.array().cast(f"array<{kind}>")

    def block(state: Column, part: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        return F.aggregate(part, F.struct(state.alias("state"), empty.alias("out")), add)

    def outer(acc: Column, part: Column) -> Column:
        return let(block(acc["state"], part), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return let(items, lambda xs: let(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda k: F.aggregate(F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / k).cast("int")), lambda b: F.slice(xs, b * k + 1, k)), start, outer, lambda acc: F.flatten(acc["out"]))))


def located(text: Column, found: Column, pattern: str) -> Column:
    """(start, end, match) of each of ``found``, in code points: between matches stand the pieces of a split."""

    def step(at: Column, x: Column) -> Column:
        begin = at + F.length(x["piece"])
        end = begin + F.length(x["match"])
        return F.struct(end.alias("state"), F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match")).alias("out"))

    pairs = F.slice(F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))), F.lit(1), F.size(found))
    kind = "struct<start:int,end:int,match:string>"
    return F.when(F.size(found) > 0, running(pairs, F.lit(0), step, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def blanked(text: Column, found: Column, pattern: str, drop: Callable[[Column], Column] | None = None) -> Column:
    """The text with each of ``found`` for which ``drop`` holds replaced by as many spaces."""
    gone = lambda m: F.when(drop(m) if drop else F.lit(True), F.repeat(F.lit(" "), F.length(m))).otherwise(m)
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.concat(p, F.when(m.isNull(), "").otherwise(gone(m))))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)


def greatest_entropy(match: Column, c: CharClass) -> Column:
    """The largest Shannon entropy, in bits per character, of any window of the match.

    One pass: a character enters and one leaves, and only their two counts change, with the sum of n log2 n beside them.
    """
    terms = F.array(*(F.lit(math.log2(n**n) if n else 0.0) for n in range(c.window + 1)))
    words = -(-len(c.alphabet) // _PER_WORD)
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), words).alias("counts"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    # places in the alphabet, from 1; before the first window is full nothing leaves (0)
    codes = F.transform(F.split(match, "", 0), lambda x: F.instr(F.lit(c.alphabet), x))
    pairs = let(codes, lambda a: F.slice(F.zip_with(a, F.concat(F.array_repeat(F.lit(0), c.window), a), lambda new, old: F.struct(new.alias("new"), old.alias("old"))), F.lit(1), F.size(a)))

    def word(code: Column) -> Column:
        return F.floor((code - 1) / _PER_WORD).cast("int")

    def shift(code: Column) -> Column:
        return ((code - 1) % _PER_WORD) * _BITS

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, word(code)), shift(code)).bitwiseAND(2**_BITS - 1).cast("int")

    def one(here: Column, code: Column) -> Column:
        return F.when(here == word(code), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(code))).otherwise(F.lit(0).cast("bigint"))

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        more, less = count(acc["counts"], new), count(acc["counts"], old)
        left = F.when(old > 0, F.get(terms, less - 1) - F.get(terms, less)).otherwise(F.lit(0.0))
        total = acc["sum"] + F.when(new == old, F.lit(0.0)).otherwise(F.get(terms, more + 1) - F.get(terms, more) + left)
        counts = F.transform(acc["counts"], lambda w, k: w + one(k, new) - F.when(old > 0, one(k, old)).otherwise(F.lit(0).cast("bigint")))
        n = acc["n"] + 1
        bits = F.when(n >= c.window, F.lit(math.log2(c.window)) - total / c.window).otherwise(F.lit(0.0))
        return F.struct(F.when(new == old, acc["counts"]).otherwise(counts).alias("counts"), n.alias("n"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    return F.aggregate(pairs, start, step, lambda acc: acc["best"])


def tells(match: Column, c: CharClass) -> Column:
    """Whether a candidate is a secret; entropy comes last, for what is left."""
    shape = F.lit(True)
    for need in c.needs:
        shape = shape & match.rlike(need)
    return F.when(shape, greatest_entropy(match, c) >= c.bits - 1e-9).otherwise(False)


def secrets(docs: DataFrame, allow: str = ALLOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id and ``base`` and ``found``, arrays of (start, rank, kind, end) in order.

    Base kinds are leftmost and non-overlapping for each kind, on the whole text. Entropy kinds are then looked for in
    what is left when assignments, access keys, hex runs and what is on the allow-list have been blanked, one after
    another; a run that one class tells is blanked before the next class. Runs of fewer than 16 characters are never
    candidates. Null and empty texts have no spans; rows are independent, ids may repeat or be null; other columns are
    ignored. No shuffle; the work on a text grows about as its length, with the matches to the power of 1.5.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keep = {
        "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE,
        "access": lambda m: F.length(m) >= 20,
        "hex": lambda m: F.length(m) >= 24,
    }

    def matches(text: str, pattern: str) -> Column:
        return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))

    def spans(kind: str, rank: int, items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    df = df.withColumns({f"m_{n}": matches("text", p) for n, p in BASE})
    df = df.withColumns({f"s_{n}": located(F.col("text"), F.col(f"m_{n}"), p) for n, p in BASE})
    def kept(name: str) -> Column:
        return F.filter(F.col(f"s_{name}"), lambda x: keep[name](x["match"]))

    def told(items: Column, c: CharClass) -> Column:
        return F.filter(F.transform(items, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), tells(x["match"], c).alias("tells"))), lambda x: x["tells"])

    def untold(text: str, k: int, c: CharClass) -> Column:
        return F.when(F.size(f"s_{k}") > 0, blanked(F.col(text), F.col(f"m_{k}"), c.pattern, lambda m: tells(m, c))).otherwise(F.col(text))

    df = df.withColumn("base", F.concat(*(spans(n, k, kept(n)) for k, (n, _) in enumerate(BASE))))
    left = "text"
    for k, (n, p) in enumerate(BASE):
        # after the first, a kind is looked for again where it was found, as blanks may have cut its runs
        if k:
            df = df.withColumn(f"m_{n}", F.when(F.size(f"m_{n}") > 0, matches(left, p)).otherwise(F.col(f"m_{n}")))
        df = df.withColumn(f"t_{n}", blanked(F.col(left), F.col(f"m_{n}"), p, keep[n]))
        left = f"t_{n}"
    # most texts have no run that any class or the allow-list looks at
    df = df.withColumn("some", F.col(left).rlike(_RUN + "{16}"))
    none = F.array().cast("array<string>")
    df = df.withColumn("m_allow", F.when(F.col("some"), matches(left, allow)).otherwise(none))
    df = df.withColumn("t_allow", blanked(F.col(left), F.col("m_allow"), allow))
    left, every = "t_allow", [F.col("base")]
    for k, c in enumerate(CLASSES, len(BASE)):
        df = df.withColumn(f"m_{k}", F.when(F.col("some"), matches(left, c.pattern)).otherwise(none))
        df = df.withColumn(f"s_{k}", told(located(F.col(left), F.col(f"m_{k}"), c.pattern), c))
        df = df.withColumn(f"e_{k}", spans(c.name, k, F.col(f"s_{k}")))
        every.append(F.col(f"e_{k}"))
        if c is not CLASSES[-1]:
            df = df.withColumn(f"t_{k}", untold(left, k, c))
            left = f"t_{k}"
    return df.select("doc_id", F.array_sort(F.col("base")).alias("base"), F.array_sort(F.concat(*every)).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of ``secrets``: doc_id, counts of the base kinds, base_sha256, spans, n_entropy."""
    found = secrets(docs, id_col=id_col, text_col=text_col)

    def count(name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *(count(n) for n, _ in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_entropy"))
