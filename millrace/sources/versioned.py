"""Versioned Parquet tables: atomic commits, time travel, schema enforcement and evolution, update and merge.

Layout: ``data/<uuid>/part-*.parquet`` and ``_log/<20-digit version>.json``. A commit writes its data, then a log entry
aside, which takes its name in one step that fails if another writer was first. So no reader meets half an entry, and
one that a broken disk cut short is passed over. An entry names the files that it adds and removes; every tenth has
the whole list. Updates and merges rewrite only files that hold a row to change, and merges open only files that may
hold a key of the source, as an index of key ranges and Bloom filters beside the log tells. A merge of few rows also
keeps what it changed, under ``_changes/<uuid>``, so that a change feed need not compare whole files. Readers take the newest
version or the one asked for. Paths go through Hadoop's FileSystem, so any scheme that Spark reads will do; commits are atomic
on local disks and HDFS. Not for several writers on object stores.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.sources.filestats import Index, describe, holders, indexable, spans, within_spans
from millrace.sources.tablelog import AmbiguousMergeError, ConcurrentCommitError, SchemaMismatchError, TableLog, TableNotFoundError

#: Every so many versions the log entry has the whole list of files.
WHOLE_EVERY = 10
#: A table of fewer files has no index; all are opened.
INDEXED_FILES = 16
#: A merge whose source has at most this part of the table's rows keeps what it changed.
CHANGES_UP_TO = 8
#: Keys of a source that may be broadcast.
BROADCAST_KEYS = 1_000_000


class VersionedTable(TableLog):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(path)
        self.spark = spark
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(f"{self.path}/_log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # log

    def _names(self) -> list[str]:
        at = self._jpath(f"{self.path}/_log")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _load(self, path: str) -> str:
        if not self._fs.exists(self._jpath(path)):
            raise TableNotFoundError(path)
        stream = self._fs.open(self._jpath(path))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def history(self) -> DataFrame:
        """(version, timestamp, operation, rows_added, live_files), newest first. Rows that were there before do not count as added."""
        rows = [(e["version"], datetime.fromisoformat(e["timestamp"]), e["operation"], e["rows_added"], len(e["live"])) for e in map(self.entry, reversed(self.versions()))]
        return self.spark.createDataFrame(rows, "version long, timestamp timestamp, operation string, rows_added long, live_files long")

    def _commit(self, operation: str, schema: StructType, add: list[str], remove: list[str], rows: int, base: int, at: datetime | None = None, index: dict[str, dict] | None = None, opened: int | None = None, notes: dict | None = None, total: int | None = None, changes: str | None = None) -> int:
        """The next version on top of ``base``; fails if there is one already.

        ``index`` has what was built for files that were there before, ``opened`` how many files were looked into; ``notes``
        are kept in the entry. ``total`` are the table's rows, if not those of ``base`` and ``rows`` more; ``changes`` is where the rows
        that came and went are kept, if they are.
        """
        numbers = self._numbers()
        if any(v > base and self._parsed(v) is not None for v in reversed(numbers)):
            raise ConcurrentCommitError(f"{self.path}: there is a version after {base}")
        version = max([base, *numbers]) + 1
        at = at or datetime.now(UTC)
        body = {"version": version, "base": base, "timestamp": at.isoformat(), "operation": operation, "rows_added": rows, "add": add, "remove": remove, "schema": json.loads(schema.json())}
        if opened is not None:
            body["opened"] = opened
        if notes:
            body["notes"] = notes
        if changes:
            body["changes"] = changes
        was, gone = self.entry(base) if base >= 0 else {"live": [], "index": {}, "total_rows": 0}, set(remove)
        if total is None and was.get("total_rows") is not None:
            total = was["total_rows"] + rows
        body["total_rows"] = total
        body["index"] = {n: {"paths": list(x["paths"]), "files": [f for f in x["files"] if f not in gone]} for n, x in (index or {}).items()}
        for name in {**was["index"], **body["index"]}:
            if add and indexable(schema, Index.named(name).key):
                x = body["index"].setdefault(name, {"paths": [], "files": []})
                x["paths"].append(self._describe(self._files(add, schema), Index.named(name)))
                x["files"] += add
        if version % WHOLE_EVERY == 0:
            body["live"] = [f for f in was["live"] if f not in gone] + add
            body["index"] = {n: self._compact(n, was["index"].get(n), body["index"].get(n), set(body["live"])) for n in {**was["index"], **body["index"]}}
        aside = self._jpath(f"{self.path}/_log/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        try:
            self._name(aside, self._jpath(f"{self.path}/_log/{version:020d}.json"))
        finally:
            self._fs.delete(aside, False)
        return version

    def _name(self, aside, target) -> None:
        """Gives a finished file its name, in one step, unless the name is taken."""
        if self._fs.getUri().getScheme() == "file":
            file = self.spark.sparkContext._jvm.java.io.File
            try:  # a rename would replace what is there, a link does not
                self.spark.sparkContext._jvm.java.nio.file.Files.createLink(file(target.toUri().getPath()).toPath(), file(aside.toUri().getPath()).toPath())
            except Py4JJavaError as e:
                raise ConcurrentCommitError(f"{self.path}: {target.getName()} exists") from e
        elif not self._fs.rename(aside, target):
            raise ConcurrentCommitError(f"{self.path}: {target.getName()} exists")

    def _write(self, df: DataFrame) -> tuple[list[str], int]:
        """Writes a data folder; its files, and their rows, counted while they are written (a task that runs again counts once)."""
        name, seen = f"data/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{name}")
        files, found = self._fs.listFiles(self._jpath(f"{self.path}/{name}"), True), []
        while files.hasNext():
            part = files.next().getPath().getName()
            if part.endswith(".parquet"):
                found.append(f"{name}/{part}")
        return found, seen.get["n"]

    def _rows(self, files: list[str], schema: StructType) -> int:
        return self._files(files, schema).count() if files else 0

    def _files(self, files: list[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in files))

    # index

    def _describe(self, rows: DataFrame, index: Index) -> str:
        """Writes the index rows of the files that ``rows`` are read from; where they are."""
        return self._keep(describe(rows, index, _local))

    def _keep(self, index_rows: DataFrame) -> str:
        name = f"_index/{uuid.uuid4().hex}"
        index_rows.write.parquet(f"{self.path}/{name}")
        return name

    def _compact(self, name: str, old: dict | None, new: dict | None, live: set[str]) -> dict:
        """An index as one Parquet folder, less the files that are no more."""
        paths = [p for x in (old, new) if x for p in x["paths"]]
        files = [f for x in (old, new) if x for f in x["files"] if f in live]
        if len(paths) > 1:
            there = self.spark.createDataFrame([(f,) for f in files], "file string")
            paths = [self._keep(self.spark.read.parquet(*(f"{self.path}/{p}" for p in paths)).join(there, "file", "left_semi"))]
        return {"paths": paths, "files": files}

    def _possible(self, entry: dict, index: Index, keys: DataFrame) -> tuple[list[str], dict[str, dict]]:
        """Files that may hold a row of the index with one of ``keys``, and what had to be built to tell.

        Where there is no index yet, the least and greatest keys of the files come first; it is built only if few keys are left to look up.
        """
        live, schema = entry["live"], StructType.fromJson(entry["schema"])
        if len(live) < INDEXED_FILES or not indexable(schema, index.key):
            return live, {}
        known = entry["index"].get(index.name, {"paths": [], "files": []})
        wanted = keys.select(F.col(index.key).cast(schema[index.key].dataType).alias(index.key))
        if not known["files"]:
            found = spans(self._files(live, schema), index, _local)
            near, few = within_spans(self.spark.createDataFrame(found.collect(), found.schema), wanted, index.key)  # one row for each file
            if not few:
                return near, {}
        missing = sorted(set(live) - set(known["files"]))
        built = {index.name: {"paths": [self._describe(self._files(missing, schema), index)], "files": missing}} if missing else {}
        paths = known["paths"] + [p for x in built.values() for p in x["paths"]]
        rows = self.spark.read.parquet(*(f"{self.path}/{p}" for p in paths))
        return sorted({r.file for r in holders(rows, wanted, index.key).collect()} & set(live)), built

    @staticmethod
    def _touched(rows: DataFrame) -> list[str]:
        """Files of this table that the rows stand in; a list of names, as long as the files are many."""
        return ["data/" + r[0].rsplit("/data/", 1)[1] for r in rows.select(F.col("_file")).distinct().collect()]

    # reads

    def read(self, version: int | None = None, as_of: datetime | str | None = None) -> DataFrame:
        """The table now, at a version or as of a moment. Columns that older files lack are NULL."""
        e = self.entry(self.resolve(version, as_of))
        return self._files(e["live"], StructType.fromJson(e["schema"]))

    def rows(self, version: int | None = None) -> int:
        """Rows of the table at a version, as the log has them; of a table whose log is too old for that, as the footers do."""
        e = self.entry(self.resolve(version))
        total = e.get("total_rows")
        return self._rows(e["live"], StructType.fromJson(e["schema"])) if total is None else total

    def changes(self, since: int, until: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """What differs between two versions: rows of ``columns`` (all if not given), ``_change`` and ``_copies``.

        ``_change`` is insert or delete, ``_copies`` the number of equal rows that came or went; an updated row is a deletion and
        an insertion. Where every commit between the two added files only or kept what it changed, just that is read; else only files
        that one version has and the other lacks, and of them only ``columns``. Rows that were copied from file to file, or that differ in other columns alone, cancel out in one aggregation, whose partial sums
        take up repeated rows before the shuffle. Columns that the older version lacks are NULL in it; retyped ones raise.
        """
        until = self.resolve(until)
        if until < since:
            raise ValueError(f"{self.path}: version {until} is before {since}")
        old, new = self.entry(since), self.entry(until)
        schema, was = StructType.fromJson(new["schema"]), StructType.fromJson(old["schema"])
        names = list(columns or schema.names)
        retyped = [n for n in names if n in was.names and was[n].dataType.simpleString() != schema[n].dataType.simpleString()]
        if retyped:
            raise SchemaMismatchError(f"{self.path}: retyped {retyped}")

        def side(files: set[str], sign: int) -> DataFrame:
            return self._files(sorted(files), schema).select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), F.lit(sign).alias("sign"))

        live = set(old["live"]), set(new["live"])
        steps = self._steps(since, until)
        if steps and any("changes" in e for e in steps) and all("changes" in e or not e["remove"] for e in steps):
            sides = [self._kept(e["changes"], schema, names) if "changes" in e else side(set(e["add"]), 1) for e in steps]
        else:
            sides = [side(live[0] - live[1], -1), side(live[1] - live[0], 1)]
        net = reduce(DataFrame.unionByName, sides).groupBy("row").agg(F.sum("sign").alias("net")).where("net <> 0")
        return net.select("row.*", F.when(F.col("net") > 0, "insert").otherwise("delete").alias("_change"), F.abs("net").alias("_copies"))

    def _steps(self, since: int, until: int) -> list[dict] | None:
        """The log entries after ``since``, to ``until``; None if the one does not stand on the other."""
        steps, version = [], until
        while version > since:
            steps.append(self.entry(version))
            version = steps[-1]["base"]
        return steps if version == since else None

    def _kept(self, path: str, schema: StructType, names: Sequence[str]) -> DataFrame:
        """The rows that a commit kept, as (row, sign)."""
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("_sign", IntegerType())])).parquet(f"{self.path}/{path}")
        return rows.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), F.col("_sign").alias("sign"))

    # writes

    def overwrite(self, df: DataFrame, operation: str = "OVERWRITE", notes: dict | None = None) -> int:
        return self.replace(df, operation, self.latest() if self.exists() else -1, notes)

    def append(self, df: DataFrame, merge_schema: bool = False) -> int:
        """Adds rows. Unknown or retyped columns raise unless ``merge_schema`` admits new ones; missing ones are NULL."""
        if not self.exists():
            return self.overwrite(df, "CREATE")
        base = self.latest()
        e = self.entry(base)
        schema = StructType.fromJson(e["schema"])
        known = {f.name: f.dataType for f in schema}
        retyped = [f.name for f in df.schema if f.name in known and f.dataType.simpleString() != known[f.name].simpleString()]
        extra = [f for f in df.schema if f.name not in known]
        if retyped or extra and not merge_schema:
            raise SchemaMismatchError(f"{self.path}: retyped {retyped}, unknown {[f.name for f in extra]}")
        merged = StructType([*schema.fields, *extra])
        have = set(df.columns)
        files, rows = self._write(df.select(*(F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in merged)))
        return self._commit("APPEND", merged, files, [], rows, base)

    def update(self, condition: Column, values: dict[str, Column]) -> int:
        """Sets columns where the condition is true. Files without such a row stay as they are."""
        base, hit = self.latest(), F.coalesce(condition, F.lit(False))
        touched = self._touched(self.read(base).withColumn("_file", F.col("_metadata.file_path")).where(hit))
        df = self._files(touched, self.schema(base))
        new = df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns))
        files = self._write(new)[0] if touched else []
        return self._commit("UPDATE", df.schema, files, touched, 0, base)

    def replace(self, df: DataFrame, operation: str, base: int, notes: dict | None = None) -> int:
        """A new content computed from version ``base``; fails if that is no longer the newest."""
        files, rows = self._write(df)
        return self._commit(operation, df.schema, files, self.entry(base)["live"] if base >= 0 else [], rows, base, notes=notes, total=rows)

    def merge(self, source: DataFrame, key: str | Sequence[str], when: Callable[[str, str], Column] | None = None, keep: tuple[str, ...] = ()) -> int:
        """Upsert on ``key``, one column or several, in one commit, which rewrites only files with a row that changes; creates the table if there is none.

        Matched rows take the source's columns (but ``keep``) if ``when("t", "s")`` is true or not given; rows with a
        key that the table lacks are inserted. A NULL key matches nothing. Several source rows for a key raise. The source
        is computed once, and only files that may hold one of its keys are opened.
        """
        key = (key,) if isinstance(key, str) else tuple(key)
        base = self.latest() if self.exists() else -1
        if base < 0:
            wanted = source
        else:
            e = self.entry(base)
            schema = StructType.fromJson(e["schema"])
            wanted = source.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
        with self._staged(wanted) as (new, names):
            self._once_each(new, key)
            n = new.count()
            if base < 0:
                return self._commit("CREATE", new.schema, names.pop(), [], n, base, total=n)
            possible, built = self._possible(e, Index(key[0]), new)
            if not possible:
                return self._commit("MERGE", schema, names.pop(), [], n, base, index=built, opened=0)
            if n * CHANGES_UP_TO <= (e.get("total_rows") or 0):
                return self._merge_few(new, n, key, when, keep, base, possible, built)
            target = self._files(possible, schema)
            if not when and not keep:
                # the source's rows are the result, but for rows that have none of its keys: those of touched files are copied
                keys = new.select(*key)
                held = target.select(*key, _local(F.col("_metadata.file_path")).alias("_file"))
                left = {r["_file"]: r["count"] for r in held.join(keys, list(key), "left_anti").groupBy("_file").count().collect()}  # one row for each file
                touched = sorted(r["_file"] for r in held.groupBy("_file").count().collect() if r["count"] > left.get(r["_file"], 0))
                rest = [f for f in touched if left.get(f)]
                files, rows = self._write(self._files(rest, schema).join(keys, list(key), "left_anti").select(*schema.names)) if rest else ([], 0)
                return self._commit("MERGE", schema, names.pop() + files, touched, n + rows - self._rows(touched, schema), base, index=built, opened=len(possible))
            # files with a row that the source changes, and source rows that the table lacks: only keys, and what ``when`` looks at, are read
            pairs = target.withColumn("_file", F.col("_metadata.file_path")).alias("t").join(new.alias("s"), _same(key))
            touched = self._touched(pairs.where(F.coalesce(when("t", "s"), F.lit(False))) if when else pairs)
            old = self._files(touched, schema)
            fresh = new.alias("s").join(target.select(*key).alias("t"), _same(key), "left_anti")
            changed = merged(old, new.alias("s").join(old.select(*key).alias("t"), _same(key), "left_semi"), key, when, keep)
            files, rows = self._write(changed.unionByName(fresh) if touched else fresh)
            return self._commit("MERGE", schema, files, touched, rows - self._rows(touched, schema), base, index=built, opened=len(possible))

    def _once_each(self, new: DataFrame, key: tuple[str, ...]) -> None:
        """Raises if several rows have one key. Hashes of keys are counted first; only rows that share one are looked at by key."""
        keys = new.select(*key).where(reduce(Column.__and__, (F.col(k).isNotNull() for k in key)))
        shared = keys.groupBy(F.xxhash64(*key).alias("_hash")).count().where("count > 1").select("_hash")
        some = shared.limit(BROADCAST_KEYS + 1).count()
        if not some:
            return
        if some <= BROADCAST_KEYS:
            keys = keys.withColumn("_hash", F.xxhash64(*key)).join(F.broadcast(shared), "_hash", "left_semi")
        twice = keys.groupBy(*key).count().where("count > 1").select(*key).first()
        if twice is not None:
            raise AmbiguousMergeError(f"{self.path}: several source rows for {', '.join(f'{k} = {v!r}' for k, v in zip(key, twice, strict=True))}")

    def _merge_few(self, new: DataFrame, n: int, key: tuple[str, ...], when: Callable[[str, str], Column] | None, keep: tuple[str, ...], base: int, possible: list[str], built: dict[str, dict]) -> int:
        """``merge`` of ``n`` rows that are few beside the table's: rows that meet one are found in one pass and written once, the
        others are copied in a second. Neither sorts the table, and the rows that came and went are kept for ``changes``."""
        schema, keys = self.schema(base), new.select(*key)
        keys = F.broadcast(keys) if n <= BROADCAST_KEYS else keys.hint("shuffle_hash")
        take = F.coalesce(when("t", "s"), F.lit(False)) if when else F.lit(True)

        def signed(df: DataFrame, sign: int) -> DataFrame:
            return df.withColumn("_sign", F.lit(sign))

        found = self._files(possible, schema).withColumn("_file", F.col("_metadata.file_path")).join(keys, list(key), "left_semi").select(*schema.names, "_file")
        with self.once(found) as met:
            pairs = met.alias("t").join(new.alias("s"), _same(key)).withColumn("_take", take)
            taken = pairs.where("_take")
            touched = self._touched(taken.select("t._file"))
            gone = taken.select("t.*").drop("_file")
            came = taken.select(*(F.col(f"{'t' if c in keep else 's'}.{c}").cast(schema[c].dataType).alias(c) for c in schema.names))
            fresh = new.alias("s").join(met.select(*key).distinct().alias("t"), _same(key), "left_anti").select(*(F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names))
            changes = f"_changes/{uuid.uuid4().hex}"
            signed(gone, -1).unionByName(signed(came, 1)).unionByName(signed(fresh, 1)).write.parquet(f"{self.path}/{changes}")
            rows = self.spark.read.schema(StructType([*schema.fields, StructField("_sign", IntegerType())])).parquet(f"{self.path}/{changes}").where("_sign > 0").drop("_sign")
            if touched:
                rows = rows.unionByName(self._files(touched, schema).join(keys, list(key), "left_anti").select(*schema.names))
                if when:  # rows that meet one of the source but stay as they are
                    rows = rows.unionByName(pairs.where(~F.col("_take") & _local(F.col("t._file")).isin(touched)).select("t.*").drop("_file"))
            files, total = self._write(rows)
            return self._commit("MERGE", schema, files, touched, total - self._rows(touched, schema), base, index=built, opened=len(possible), changes=changes)

    def revise(self, keys: DataFrame, key: str, where: str, values: dict[str, Column], added: DataFrame, operation: str, base: int) -> int:
        """Sets columns of the rows ``where`` a condition holds and the key is one of ``keys``, and adds rows, in one commit.

        Only files that may hold such a row are opened, and only those that do are rewritten; fails if ``base`` is no longer
        the newest version. ``keys`` are read several times.
        """
        e = self.entry(base)
        schema = StructType.fromJson(e["schema"])
        keys = keys.select(key).where(F.col(key).isNotNull()).distinct()
        possible, built = self._possible(e, Index(key, where), keys)
        touched = self._touched(self._files(possible, schema).withColumn("_file", F.col("_metadata.file_path")).where(where).join(keys, key, "left_semi")) if possible else []
        rows = self._files(touched, schema).join(keys.withColumn("_hit", F.lit(True)), key, "left")
        hit = F.col("_hit").isNotNull() & F.coalesce(F.expr(where), F.lit(False))
        changed = rows.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(schema[c].dataType).alias(c) if c in values else F.col(c) for c in schema.names))
        added = added.select(*schema.names)
        files, n = self._write(changed.unionByName(added) if touched else added)
        return self._commit(operation, schema, files, touched, n - self._rows(touched, schema), base, index=built, opened=len(possible))

    def exchange(self, keys: DataFrame, build: Callable[[DataFrame], DataFrame], operation: str, base: int, notes: dict | None = None) -> int:
        """Rows whose key is one of ``keys`` give way to the rows that ``build(keys)`` makes, in one commit; how many keys.

        The columns of ``keys`` are the key; it is NULL-safe. ``keys`` are computed once. Only files with such a row are rewritten;
        of a key of one column only those that may hold one are opened. Fails if ``base`` is no longer the newest version.
        """
        e = self.entry(base)
        schema, on = StructType.fromJson(e["schema"]), keys.columns
        with self.once(keys.distinct()) as wanted:
            n = wanted.count()
            if not n:
                self._commit(operation, schema, [], [], 0, base, notes=notes)
                return 0
            possible, built = e["live"], {}
            if len(on) == 1 and not wanted.where(F.col(on[0]).isNull()).head(1):
                possible, built = self._possible(e, Index(on[0]), wanted)
            renamed = wanted.select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(on)))
            same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(on)))
            touched = self._touched(self._files(possible, schema).withColumn("_file", F.col("_metadata.file_path")).join(renamed, same, "left_semi")) if possible else []
            rest = self._files(touched, schema).join(renamed, same, "left_anti")
            new = build(wanted).select(*schema.names)
            files, rows = self._write(rest.unionByName(new) if touched else new)
            self._commit(operation, schema, files, touched, rows - self._rows(touched, schema), base, index=built, opened=len(possible), notes=notes)
            return n

    @contextlib.contextmanager
    def once(self, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` computed once, as files of its own beside the table until the end of the block."""
        path = f"{self.path}/_source/{uuid.uuid4().hex}"
        try:
            df.write.parquet(path)
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            self._fs.delete(self._jpath(path), True)

    @contextlib.contextmanager
    def _staged(self, df: DataFrame) -> Iterator[tuple[DataFrame, list[list[str]]]]:
        """``df`` computed once, as data files of the table that no log entry names yet, and a list of the one list of their names.

        Who takes that out of the list is about to commit them; otherwise they are deleted at the end of the block.
        """
        files, _ = self._write(df)
        names = [files]
        try:
            yield self._files(files, df.schema), names
        finally:
            if names and files:
                self._fs.delete(self._jpath(f"{self.path}/{files[0].rsplit('/', 1)[0]}"), True)


def _local(path: Column) -> Column:
    """A file's name within its table."""
    return F.concat(F.lit("data/"), F.element_at(F.split(path, "/data/"), -1))


def _same(key: Sequence[str]) -> Column:
    """Rows t and s have one key; NULL equals nothing."""
    return reduce(Column.__and__, (F.col(f"t.{k}") == F.col(f"s.{k}") for k in key))


def merged(target: DataFrame, source: DataFrame, key: str | Sequence[str], when: Callable[[str, str], Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of an upsert as one full outer join; both sides have the same columns, the key once in the source."""
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    take = F.col("_s").isNotNull() & (F.col("_t").isNull() | (F.coalesce(when("t", "s"), F.lit(False)) if when else F.lit(True)))

    def value(c: str) -> Column:
        new = F.when(take & F.col("_t").isNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in keep else F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
        return new.alias(c)

    return t.join(s, _same((key,) if isinstance(key, str) else key), "full").select(*(value(c) for c in target.columns))


