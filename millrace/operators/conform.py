"""One conformance engine for every dataset: type, rank duplicates, probe parents, name the first defect, split."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from millrace.functions.expr import blank, first_reason, row_hash
from millrace.session import reliable

#: Columns that describe the delivery, not the record; the ingestion id is part of the content.
SYSTEM = {"_source_file", "_source_path", "_ingestion_date", "_adf_run_id", "_ingested_timestamp"}
#: Why a row is set aside that a later delivery repeats; no defect, so quarantine rates leave it out.
REDELIVERED = "REDELIVERED"
#: What tells one delivery from another, the first to differ deciding which is later.
DELIVERY = ("_ingested_timestamp", "_ingestion_date", "_ingestion_id")
#: Repeated keys, as hashes of 8 bytes, that may be broadcast.
REPEATED = 1_000_000
#: Window partitions over which rows without a key are dealt, as they need no rank.
SALTS = 997


class ReconciliationError(ValueError):
    """Source rows are not valid plus quarantined rows."""


@dataclass(frozen=True)
class Parent:
    """A reference ``column`` -> ``parent``.``key``; ``carry`` names parent columns that rules may look at, as p_<name>."""

    column: str
    parent: str
    reason: str
    key: str = ""
    carry: tuple[str, ...] = ()

    @property
    def parent_key(self) -> str:
        return self.key or self.column

    def found(self) -> Column:
        return F.col(f"_ref_{self.column}").isNotNull()


@dataclass(frozen=True)
class Spec:
    """What conforming a dataset means, as data.

    ``shape`` gives typed columns from raw ones (others stay); ``order`` ranks rows of a key, best first; ``rules`` are
    (reason, condition) in order, where the string "duplicate" stands for rank > 1 and a Parent for a miss.
    """

    name: str
    key: str
    shape: dict[str, Callable[[], Column]]
    order: tuple[Callable[[], Column], ...]
    rules: tuple[tuple[str, Callable[[], Column] | str] | Parent, ...]
    output: tuple[str, ...] = ()
    parents: tuple[Parent, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "parents", tuple(r for r in self.rules if isinstance(r, Parent)))

    @property
    def reasons(self) -> tuple[str, ...]:
        """Every reason that a row can have, each once."""
        return tuple(dict.fromkeys((REDELIVERED, *(r.reason if isinstance(r, Parent) else r[0] for r in self.rules))))


@dataclass
class Conformed:
    """Both sides of the split and the tagged rows that they come from."""

    spec: Spec
    tagged: DataFrame

    @property
    def valid(self) -> DataFrame:
        df = self.tagged.where(F.col("_reason").isNull())
        return df.select(*self.spec.output) if self.spec.output else df.drop("_reason", "_raw")

    @property
    def rejected(self) -> DataFrame:
        """Conformed rows with ``quarantine_reason``, ``_raw`` (the row as delivered) and ``_quarantined_at``."""
        return self.tagged.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "quarantine_reason").withColumn("_quarantined_at", F.current_timestamp())

    @property
    def quarantine(self) -> DataFrame:
        """The uniform audit form: record_id, source_dataset, rejection_reason, raw_record, ingested_at."""
        return quarantined(self.tagged.where(F.col("_reason").isNotNull()), self.spec.key, self.spec.name, "_reason", F.col("_raw"))

    def observed(self) -> tuple[DataFrame, Callable[[], dict[str | None, int]]]:
        """The valid rows, and rows by reason as ``by_reason`` gives them, counted while the valid ones are written.

        All rows pass the counters before the valid ones are kept, in the tasks that write, so no pass is made for them. Call
        the second after the first was written, once.
        """
        seen, reason = Observation(), F.col("_reason")
        counts = [F.count_if(reason == r).alias(r) for r in self.spec.reasons]
        watched = self.tagged.drop("_raw").observe(seen, F.count_if(reason.isNull()).alias("_valid"), *counts)

        def counted() -> dict[str | None, int]:
            found = dict(seen.get)
            return {k: n for k, n in {None: found.pop("_valid"), **found}.items() if n}

        return Conformed(self.spec, watched).valid, counted

    def by_reason(self) -> dict[str | None, int]:
        """Rows by reason, NULL for valid ones, in one pass (the number of reasons is fixed by the spec)."""
        return {r["_reason"]: r["n"] for r in self.tagged.groupBy("_reason").agg(F.count("*").alias("n")).collect()}


def quarantined(df: DataFrame, key: str, dataset: str, reason: str, record: Column | None = None) -> DataFrame:
    record = F.struct("*") if record is None else record
    return df.select(
        F.col(key).cast("string").alias("record_id"),
        F.lit(dataset).alias("source_dataset"),
        F.col(reason).alias("rejection_reason"),
        F.to_json(record).alias("raw_record"),
        F.current_timestamp().alias("ingested_at"),
    )


def redelivered(raw: DataFrame, delivery: tuple[str, ...] = DELIVERY) -> DataFrame:
    """``raw`` with ``_redelivered``: whether a later delivery holds a row of equal content.

    The columns ``delivery`` tell deliveries apart (NULL comes first; those that ``raw`` lacks do not count). Content is all else but
    what describes the delivery, as it was delivered; NULL differs from empty text. Equal rows of one delivery are all
    alike: none is the later. The last delivery of each content is found with partial sums, and only contents that came more
    than once meet the rows again, in a join that adaptive execution splits where a content is hot.
    """
    told = [c for c in delivery if c in raw.columns]
    if not told:
        return raw.withColumn("_redelivered", F.lit(False))
    about = SYSTEM | set(delivery)
    came = F.struct(*(F.col(c) for c in told))
    content = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(raw.columns) if c not in about)))
    rows = raw.withColumn("_content", F.sha2(content, 256))
    last = rows.groupBy("_content").agg(F.max(came).alias("_last"), F.min(came).alias("_first")).where("_first < _last")
    rows = rows.join(last.select(F.col("_content").alias("_again"), "_last"), F.col("_content") == F.col("_again"), "left")
    return rows.withColumn("_redelivered", F.coalesce(came < F.col("_last"), F.lit(False))).drop("_content", "_again", "_last")


def conform(raw: DataFrame, spec: Spec, parents: dict[str, DataFrame] | None = None, supersede: bool = False) -> Conformed:
    """Tags each row of ``raw`` with the first rule it breaks. Ranks are given before validity is looked at.

    One window and one probe per parent; parents are read for their keys only (and ``carry``). Rows without a key
    are dealt over many window partitions, so they make no hot one. With ``supersede`` a row that a later delivery repeats has
    the reason ``REDELIVERED``, whatever else is wrong with it, and is ranked behind all that are not.
    """
    parents = parents or {}
    raw_columns = raw.columns
    if supersede:
        raw = redelivered(raw)
    df = raw.withColumn("_raw", F.struct(*(F.col(f"`{c}`") for c in raw_columns)))
    df = df.withColumns({name: make() for name, make in spec.shape.items()})
    content = [c for c in df.columns if c not in SYSTEM and c not in ("_raw", "_redelivered")]
    df = df.withColumn("_hash", F.unhex(row_hash(content)))  # 32 bytes in the order of their 64 digits, as all rows are shuffled with it
    salt = F.when(blank(spec.key), F.pmod(F.xxhash64("_hash"), F.lit(SALTS)))
    ranked = Window.partitionBy(F.col(spec.key), salt).orderBy(*([F.col("_redelivered").asc()] if supersede else []), *(o() for o in spec.order), F.col("_hash").asc())
    df = df.withColumn("_rank", F.row_number().over(ranked))
    for p in spec.parents:
        keys = parents[p.parent].where(F.col(p.parent_key).isNotNull()).select(F.col(p.parent_key).alias(f"_ref_{p.column}"), *(F.col(c).alias(f"p_{c}") for c in p.carry))
        keys = keys.dropDuplicates([f"_ref_{p.column}"])
        df = df.join(keys, F.col(p.column) == F.col(f"_ref_{p.column}"), "left")
    checks = [(REDELIVERED, F.col("_redelivered"))] if supersede else []
    for r in spec.rules:
        if isinstance(r, Parent):
            checks.append((r.reason, ~r.found()))
        else:
            checks.append((r[0], F.col("_rank") > 1 if r[1] == "duplicate" else r[1]()))
    df = df.withColumn("_reason", first_reason(checks))
    helpers = ["_hash", "_rank", "_redelivered", *(f"_ref_{p.column}" for p in spec.parents), *(f"p_{c}" for p in spec.parents for c in p.carry)]
    return Conformed(spec, df.drop(*helpers))


def orphans(child: DataFrame, parent: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose reference is NULL or not there."""
    keys = parent.select(F.col(key or column).alias("_key"))
    return child.join(keys, F.col(column) == F.col("_key"), "left_anti")


def referenced(child: DataFrame, parent: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose reference is there."""
    keys = parent.select(F.col(key or column).alias("_key"))
    return child.join(keys, F.col(column) == F.col("_key"), "left_semi")


def latest(df: DataFrame, keys: Iterable[str], order: Iterable[Column], bound: int = REPEATED) -> DataFrame:
    """One row for each key: the first by ``order``, ties broken by a hash of the row. NULL keys are one key.

    A first pass counts rows by a 64-bit hash of the key, with partial sums, so only hashes are shuffled. Where up to ``bound``
    hashes repeat, they are broadcast, rows of other keys stay where they are, and only rows that share a hash are ranked (keys
    that merely meet in one are ranked apart). Beyond it all rows are ranked. ``df`` is read up to three times, so it should be
    a table or what was written, not a costly plan, and give the same rows each time.
    """
    keys, order = list(keys), list(order)
    hashed = F.xxhash64(*(F.col(f"`{k}`") for k in keys))

    def ranked(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order, row_hash(df.columns).asc())
        return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")

    repeated = reliable(df.select(hashed.alias("_twice")).groupBy("_twice").count().where("count > 1").select("_twice"))
    n = repeated.count()
    if n > bound:
        return ranked(df)
    if not n:
        return df
    repeated = F.broadcast(repeated)
    single = df.join(repeated, hashed == F.col("_twice"), "left_anti")
    return single.unionByName(ranked(df.join(repeated, hashed == F.col("_twice"), "left_semi")))
