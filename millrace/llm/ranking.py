"""Ranks and ties within groups of any size, over one global range sort (operator 13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from millrace.llm.common import stored

#: Bits of a row's ``edge``: it stands in the first group, the first run or the last run of its partition.
FIRST_GROUP, FIRST_RUN, LAST_RUN = 1, 2, 4
#: ``edge`` of the two rows that sum a partition up, by its first and by its last row.
HEAD, TAIL = -1, -2


def differs(values: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal, and so are NaNs."""
    a, b = values.slice(1), values.slice(0, len(values) - 1)
    out = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(values.type):
        out = out & ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    return out | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


class Scan:
    """One pass over a sorted partition: places within it, and what the partition looks like from outside.

    A run is what stands together with equal group and pair. Its rows wait until it ends, as only then its length is
    known; so a scan holds no more than one run, which is at most its range partition.
    """

    def __init__(self, part: int, group: int, keys: int, at_most: int | None):
        self.part, self.group, self.keys, self.at_most = part, group, keys, at_most
        self.rows = self.group_start = self.run_start = self.runs = self.group_run = 0
        self.last: pa.RecordBatch | None = None
        self.first: pa.RecordBatch | None = None
        self.first_group: tuple[int, int] | None = None
        self.first_run: int | None = None
        self.held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []

    def feed(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        new = [np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)]
        if self.first is None:
            self.first = b.slice(0, 1)
            new[0][0] = new[1][0] = True
        for k in range(self.keys if self.last is not None or b.num_rows > 1 else 0):
            column = b.column(k) if self.last is None else pa.concat_arrays([self.last.column(k), b.column(k)])
            d = differs(column)
            for x in new[0 if k < self.group else 1 :]:
                x[-len(d) :] |= d
        new_group, new_run = new[0], new[0] | new[1]
        at = np.arange(b.num_rows, dtype=np.int64) + self.rows
        starts = np.flatnonzero(new_run)
        run = np.cumsum(new_run) + self.runs

        def since(flags: np.ndarray, values: np.ndarray, before: int) -> np.ndarray:
            """The value where the flag was last up."""
            out = np.maximum.accumulate(np.where(flags, values, -1))
            return np.where(out < 0, before, out)

        group_start, run_start, group_run = since(new_group, at, self.group_start), since(new_run, at, self.run_start), since(new_group, run, self.group_run)
        if self.first_group is None and len(ends := np.flatnonzero(new_group & (at > 0))):
            self.first_group = (int(at[ends[0]]), int(run[ends[0]]) - 1)
        if self.first_run is None and len(ends := starts[at[starts] > 0]):
            self.first_run = int(at[ends[0]])
        edge = np.where(group_start == 0, FIRST_GROUP, 0) | np.where(run_start == 0, FIRST_RUN, 0)
        found = [at - group_start + 1, run_start - group_start + 1, run - group_run + 1, edge]
        if len(starts):
            for rows, columns in self.held:
                yield self.out(rows, columns, self.rows + int(starts[0]) - self.run_start)
            self.held = []
        ended = int(starts[-1]) if len(starts) else 0
        if ended:
            bounds = np.concatenate([[self.run_start - self.rows], starts]) if starts[0] else starts
            yield self.kept(b.slice(0, ended), [x[:ended] for x in found], np.repeat(np.diff(bounds), np.diff(np.maximum(bounds, 0))))
        rest = [x[ended:] for x in found]
        keep = self.wanted(rest)
        rows = b.slice(ended)
        if keep is not None:
            rows, rest = rows.filter(pa.array(keep)), [x[keep] for x in rest]
        if rows.num_rows:
            self.held.append((rows, rest))
        self.last = b.slice(b.num_rows - 1)
        self.rows += b.num_rows
        self.group_start, self.run_start, self.runs, self.group_run = int(group_start[-1]), int(run_start[-1]), int(run[-1]), int(group_run[-1])

    def wanted(self, found: list[np.ndarray]) -> np.ndarray | None:
        """No later count makes a place smaller, so rows beyond ``at_most`` can go."""
        return None if self.at_most is None else found[1] <= self.at_most

    def kept(self, rows: pa.RecordBatch, found: list[np.ndarray], tied: np.ndarray) -> pa.RecordBatch:
        keep = self.wanted(found)
        if keep is not None:
            rows, found, tied = rows.filter(pa.array(keep)), [x[keep] for x in found], tied[keep]
        return self.out(rows, found, tied)

    def out(self, rows: pa.RecordBatch, found: list[np.ndarray], tied: np.ndarray | int) -> pa.RecordBatch:
        n = rows.num_rows
        pos, place, dense, edge = found
        more = [pa.array(np.full(n, self.part, np.int32)), *(pa.array(np.broadcast_to(x, n).astype(np.int64)) for x in (pos, place, dense, tied)), pa.array(edge.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], names=[str(k) for k in range(rows.num_columns + 6)])

    def end(self) -> Iterator[pa.RecordBatch]:
        """The open run, then the two rows that sum the partition up."""
        if self.first is None:
            return
        length = self.rows - self.run_start
        for rows, found in self.held:
            yield self.out(rows, [*found[:3], found[3] | LAST_RUN], length)
        group_rows, group_runs = self.first_group or (self.rows, self.runs)
        one = lambda *x: [np.array([v]) for v in x]
        yield self.out(self.first, one(group_rows, self.first_run or self.rows, group_runs, HEAD), self.rows)
        yield self.out(self.last, one(self.rows - self.group_start, self.run_start - self.group_start + 1, self.runs - self.group_run + 1, TAIL), length)


def carried(heads: list[Row], tails: list[Row], group: list[str], keys: list[str], names: list[str]) -> list[tuple]:
    """(part, rows, runs, place, tied_before, tied_after) that each partition gets from those before and after it.

    A segmented prefix scan over one summary a partition: ``rows`` and ``runs`` go to its first group, ``place`` and
    ``tied_before`` to its first run if that began earlier (else null and 0), ``tied_after`` to its last run.
    """
    part, pos, place, dense, tied = names
    key = lambda r, cols: tuple("NaN" if r[c] != r[c] else r[c] for c in cols)
    out: list[list] = []
    was = None
    ordered = sorted(zip(sorted(heads, key=lambda r: r[part]), sorted(tails, key=lambda r: r[part]), strict=True), key=lambda x: x[0][part])
    for head, tail in ordered:
        total = head[tied]
        same_group = was is not None and was[0] == key(head, group)
        same_run = same_group and was[1] == key(head, keys)
        rows, runs = (was[2], was[3] - same_run) if same_group else (0, 0)
        before, at = (was[4], was[5]) if same_run else (0, None)
        out.append([head[part], rows, runs, at, before, 0])
        one_group, one_run = head[pos] == total, head[place] == total
        was = (
            key(tail, group), key(tail, keys),
            rows + total if one_group else tail[pos], runs + head[dense] if one_group else tail[dense],
            before + total if one_run else tail[tied], at if one_run and same_run else tail[place] + (rows if one_group else 0),
        )
    for k in range(len(out) - 2, -1, -1):
        head = ordered[k + 1][0]
        if out[k + 1][3] is not None:
            out[k][5] = head[place] + (out[k + 1][5] if head[place] == head[tied] else 0)
    return [tuple(x) for x in out]


def ranked(df: DataFrame, group: list[str], by: dict[str, Column], then: dict[str, Column] | None = None, at_most: int | None = None, names: tuple[str, str, str, str] = ("pos", "place", "dense", "tied")) -> DataFrame:
    """``df`` with four longs: position, rank, dense rank and number of ties of each row within its group.

    ``by`` orders a group by columns (name to sort order), and rows that are equal in all of them are ties; ``then``
    orders ties for the position alone. Rows that are equal in everything are counted one by one, in any order.
    ``at_most`` returns only rows of at most that rank. Groups of null keys are groups; nulls are equal to each other,
    and so are NaNs. Columns of ``group`` and ``by`` have atomic types. An empty ``df`` gives no rows; other columns go
    along, and none of them may have one of the ``names``.

    1. One range sort on group, pair, tie-breakers and a number of the row, so that neither a hot group nor many equal rows
       make a large partition. A scan of each sorted partition numbers its rows from its own start and sums it up in
       two rows; the result is written once.
    2. The summaries, two for a partition, are combined on the driver by a segmented prefix scan.
    3. What the partitions before and after add goes to each row of a partition's first group and its first and last run.
    """
    spark, taken = df.sparkSession, {c.lower() for c in df.columns}
    if clash := taken & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(clash)} are there already; give other names")

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        taken.add(name)
        return name

    salt, part, edge, *local = map(free, ("_salt", "_part", "_edge", "_pos", "_place", "_dense", "_tied"))
    keys = [*group, *by]
    columns = [*keys, *(c for c in df.columns if c not in keys)]
    order = [*(F.col(g).asc_nulls_first() for g in group), *by.values(), *(then or {}).values(), F.col(salt)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns)
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema), StructField(part, IntegerType()), *(StructField(n, LongType()) for n in local), StructField(edge, IntegerType())])
    done = stored(rows.mapInArrow(scanner(len(group), len(keys), at_most, schema.names), schema), "ranked")
    found = done.where(F.col(edge) < 0).select(part, *local, edge, *keys).collect()
    more = carried([r for r in found if r[edge] == HEAD], [r for r in found if r[edge] == TAIL], group, keys, [part, *local])
    add = [free(n) for n in ("_rows", "_runs", "_at", "_before", "_after")]
    carry = spark.createDataFrame(more, f"`{part}` int, " + ", ".join(f"`{n}` long" for n in add))
    out = done.where(F.col(edge) >= 0).join(F.broadcast(carry), part)  # one row a partition
    bit = lambda flag, value: F.when(F.col(edge).bitwiseAND(flag) != 0, value).otherwise(F.lit(0).cast("long"))
    started = F.when(F.col(edge).bitwiseAND(FIRST_RUN) != 0, F.col(add[2]))
    values = {
        names[0]: F.col(local[0]) + bit(FIRST_GROUP, F.col(add[0])),
        names[1]: F.coalesce(started, F.col(local[1]) + bit(FIRST_GROUP, F.col(add[0]))),
        names[2]: F.col(local[2]) + bit(FIRST_GROUP, F.col(add[1])),
        names[3]: F.col(local[3]) + bit(FIRST_RUN, F.col(add[3])) + bit(LAST_RUN, F.col(add[4])),
    }
    out = out.select(*df.columns, *(v.alias(n) for n, v in values.items()))
    return out if at_most is None else out.where(F.col(names[1]) <= at_most)


def scanner(group: int, keys: int, at_most: int | None, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(TaskContext.get().partitionId(), group, keys, at_most)
        for b in batches:
            for out in scan.feed(b):
                if out.num_rows:
                    yield out.rename_columns(names)
        for out in scan.end():
            yield out.rename_columns(names)

    return run


def line_places(lines: DataFrame, at_most: int = 3) -> DataFrame:
    """Sale lines of place ``at_most`` or better within vendor, part and month, as the query's contract has it.

    Lines whose sale_id has a CRC-32 divisible by five are one group, of key -1. Nulls: see the contract; repeated lines
    are ranked one by one; an empty table gives no rows.
    """
    one = F.coalesce(F.crc32(F.col("sale_id").cast("string")) % 5 == 0, F.lit(False))
    key = lambda c: F.when(one, F.lit(-1)).otherwise(F.coalesce(c, F.lit(-1))).cast("long")
    rows = lines.select(
        F.when(one, F.lit(-1)).otherwise(F.col("vendor_id")).cast("long").alias("vendor_id"),
        key(F.col("item_id") % 10).alias("part"),
        key(100 * F.year("shipped_at") + F.month("shipped_at")).alias("month"),
        F.floor(F.col("quantity") / 10).alias("tens"),
        F.floor(100 * F.col("discount") + 0.5).alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"),
        F.floor(100 * F.col("amount") + 0.5).alias("amount_cents"),
    )
    by = {"tens": F.desc_nulls_first("tens"), "percent": F.asc_nulls_first("percent")}
    then = {c: F.asc_nulls_last(c) for c in ("sale_id", "line_no", "quantity", "amount_cents")}
    found = ranked(rows, ["vendor_id", "part", "month"], by, then, at_most)
    return found.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")
