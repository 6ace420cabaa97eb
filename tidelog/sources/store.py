"""A durable versioned table: transactions, snapshots, flush and compaction over Parquet runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog import model
from tidelog.metrics import Profiler
from tidelog.operators import merge, scan
from tidelog.plans import levels
from tidelog.sources import runs


class Store:
    """One table of a key and string columns under a folder.

    Writes append Parquet slices (the memtable); `flush` merges those of ended writers into sorted runs of level 0; `compact`
    merges levels. Both write runs of a bounded size, each with its own key range, so that a later step rewrites only what it
    meets and reads open only what may hold their keys. The manifest names the slices and runs of each version and is replaced
    as a whole, after the data it names is written. One process writes; any number may read.

    With `options.maintain`, ending a writer flushes once `memtable_rows` mutations or `max_memtables` times as many slices as
    level 0 may hold files have gathered, and then compacts as long as a level is due.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], options: model.Options = model.Options()):
        self.spark, self.path, self.columns, self.options = spark, path.rstrip("/"), columns, options
        self.schema = model.log_schema(columns)
        self.profiler = Profiler()
        self.active: dict[int, int] = {}
        self.pins: dict[int, int] = {}
        self.named: dict[int, list[dict]] = {}
        found = self._versions()
        self.version = max(found, default=0)
        self.files = [r.asDict() for r in self._manifest(self.version).collect()] if found else []
        self.epoch = 1 + max((f["max_epoch"] or 0 for f in self.files), default=0)

    # Transactions

    def begin(self) -> Transaction:
        """A read-write transaction: its writes carry its epoch, and it reads what was there before the oldest open writer."""
        epoch, self.epoch = self.epoch, self.epoch + 1
        self.active[epoch] = 0
        return Transaction(self, epoch, min(self.active) - 1)

    def begin_read_only(self) -> Transaction:
        return Transaction(self, None, self.latest())

    def latest(self) -> int:
        """The newest epoch that is complete: later writers never change what it shows."""
        return min(self.active, default=self.epoch) - 1

    def snapshot(self, epoch: int | None = None) -> DataFrame:
        """The state as of an epoch, the latest complete one if none is given. `vacuum` may take its files away; a transaction
        keeps them."""
        return model.state(self.log(), self.latest() if epoch is None else epoch)

    def log(self, files: list[dict] | None = None, lo: str | None = None, hi: str | None = None) -> DataFrame:
        """All versions, or those in the files that may hold keys from `lo` to `hi`."""
        chosen = levels.prune_files(self.files if files is None else files, lo, hi)
        slices, sorted_runs = [f["path"] for f in chosen if f["level"] < 0], [f["path"] for f in chosen if f["level"] >= 0]
        parts = [self.spark.read.schema(self.schema).parquet(*slices)] if slices else []
        parts += [self.spark.read.schema(runs.run_schema(self.schema)).parquet(*sorted_runs).select(*self.schema.names)] if sorted_runs else []
        return merge.union_runs(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def select(self, predicates: dict[str, runs.Predicate], epoch: int, files: list[dict] | None = None) -> DataFrame:
        """The state at an epoch where every predicate holds: each a range, or another that flips once along the order of values.

        Predicates are read off the runs' dictionaries, and files are scanned for the codes found; runs without any are not
        opened. What is found is a candidate, as a newer version may lie elsewhere: candidates of files that share their key
        range with others are held against the newest versions there, for which keys and epochs are read, and no values.
        """
        files = [f for f in (self.files if files is None else files) if f["n_versions"]]
        apart = levels.apart(files, epoch)
        out = []
        for chosen, alone in (([f for f in files if f["run_id"] in apart], True), ([f for f in files if f["run_id"] not in apart], False)):
            slices, sorted_runs = [f["path"] for f in chosen if f["level"] < 0], [f["path"] for f in chosen if f["level"] >= 0]
            found = []
            if slices:
                rows = self.spark.read.schema(self.schema).parquet(*slices)
                for c, p in predicates.items():
                    rows = rows.where((F.col(c) != "") & p(F.col(c)))
                found.append(rows)
            if bounds := runs.code_bounds(self.spark, sorted_runs, predicates):
                found.append(runs.scan_codes(self.spark, self.schema, bounds))
            if not found:
                continue
            rows = merge.union_runs(*found).where((F.col("epoch") <= epoch) & ~F.col("deleted"))
            if not alone:
                versions = model.visible(self.log(chosen).select("k", "epoch", "seq"), epoch)
                newest = versions.groupBy("k").agg(F.max(F.struct("epoch", "seq")).alias("v")).select("k", "v.*")
                rows = rows.join(newest, ["k", "epoch", "seq"], "left_semi")
            out.append(rows.select("k", *self.columns))
        return merge.union_runs(*out) if out else self.spark.createDataFrame([], self.schema).select("k", *self.columns)

    # Maintenance

    def flush(self) -> bool:
        """Merge the memtable slices of ended writers into runs of level 0. Versions that a snapshot sees, or may come to see, are
        kept."""
        slices = [f for f in self.files if f["level"] == -1 and f["max_epoch"] not in self.active]
        if not slices:
            return False
        with self.profiler.timed("flush") as sample:
            self._merge(slices, 0, bottom=False, sample=sample)
        return True

    def compact(self, level: int = 0) -> bool:
        """Merge a level that is due, by the policy in plans.levels, into the next one. A single run without overlap only changes level."""
        chosen = {(r["level"], r["run_id"]) for r in levels.pick(self.manifest().where("level >= 0"), level, self.options).collect()}
        inputs = [f for f in self.files if (f["level"], f["run_id"]) in chosen]
        if not any(f["level"] == level for f in inputs):
            return False
        with self.profiler.timed("compact") as sample:
            if len(inputs) == 1:
                self._install([{**inputs[0], "level": level + 1}], inputs)
            else:
                # Tombstones may go where no other file can hold an older version of a key, be it below or in a late slice above.
                lo, hi = min((f["key_min"] for f in inputs), key=str.encode), max((f["key_max"] for f in inputs), key=str.encode)
                others = levels.prune_files([f for f in self.files if f not in inputs], lo, hi)
                self._merge(inputs, level + 1, bottom=not others, sample=sample)
        return True

    def maintain(self) -> None:
        """What ending a writer starts: a flush if the memtable is full, then compactions until no level is due."""
        slices = [f for f in self.files if f["level"] == -1 and f["max_epoch"] not in self.active]
        full = sum(f["n_versions"] for f in slices) >= self.options.memtable_rows
        if (full or len(slices) > self.options.max_memtables * self.options.slices_per_memtable) and self.flush():
            while todo := levels.due(self.files, self.options):
                if not any([self.compact(level) for level in todo]):
                    break

    def stalled(self) -> bool:
        """Whether level 0 holds more files than writers should add to."""
        return sum(f["level"] == 0 for f in self.files) > self.options.zero_level_files

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(f[c] for c in self._names()) for f in self.files], runs.MANIFEST)

    def vacuum(self) -> None:
        """Delete folders and manifests that neither the present version nor an open transaction names."""
        keep = {f["path"] for files in (self.files, *self.named.values()) for f in files}
        bases = {p.split("/runs/part=")[0] for p in keep}
        for p in self._list(f"{self.path}/data"):
            if not any(b.endswith(p.split(self.path, 1)[-1]) for b in bases):
                self._delete(p)
            else:
                for part in self._list(f"{p}/runs"):
                    if "/part=" in part and not any(k.endswith(part.split(self.path, 1)[-1]) for k in keep):
                        self._delete(part)
        for p in self._list(f"{self.path}/manifest"):
            if p.rsplit("/", 1)[-1] != str(self.version):
                self._delete(p)

    # Inner steps

    def _append(self, rows: DataFrame) -> dict:
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        model.checked(rows.select(*self.schema.names)).write.parquet(path)
        found = runs.describe(self.spark.read.schema(self.schema).parquet(path))
        entry = self._entry(-1, path, found.get(0, {"n_versions": 0, "key_num": 0, "bytes": 0}))
        self._install([entry] if found else [], [])
        return entry

    def _merge(self, inputs: list[dict], level: int, bottom: bool, sample: dict) -> None:
        log = self.log(inputs)
        # Epochs that are read now, or become the newest complete one when a writer ends.
        held = set(self.pins) | ({self.latest()} if self.active else set()) | {epoch - 1 for epoch in self.active}
        merged = merge.compact(log, bottom=bottom and not held)
        for epoch in sorted(held):
            merged = merged.unionByName(model.newest(log.where(F.col("epoch") <= epoch)))
        versions = sum(f["n_versions"] for f in inputs)
        written = runs.write_runs(merged.distinct() if held else merged, f"{self.path}/data", versions, self.options)
        entries = [self._entry(level, d["path"], d) for d in written]
        sample |= {"read": sum(f["bytes"] or 0 for f in inputs), "written": sum(e["bytes"] for e in entries)}
        self._install(entries, inputs)

    def _entry(self, level: int, path: str, found: dict) -> dict:
        return {"level": level, "run_id": uuid.uuid4().hex, "path": path} | {c: found.get(c) for c in self._names()[3:]}

    def _drop(self, entries: list[dict]) -> None:
        self._install([], entries)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _install(self, added: list[dict], removed: list[dict]) -> None:
        gone = {f["run_id"] for f in removed}
        self.files = [f for f in self.files if f["run_id"] not in gone] + added
        self.version += 1
        self.manifest().coalesce(1).write.parquet(f"{self.path}/manifest/{self.version}")

    def _names(self) -> list[str]:
        return [c.split()[0] for c in runs.MANIFEST.split(", ")]

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest/{version}")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _versions(self) -> list[int]:
        done = [p for p in self._list(f"{self.path}/manifest") if any(q.endswith("_SUCCESS") for q in self._list(p))]
        return [int(p.rsplit("/", 1)[-1]) for p in done]


class Transaction:
    """Reads at one epoch, from the files of the version it began with; writes, if it may, at its own. Leaving the context
    commits, unless an exception leaves it: then all its writes go."""

    def __init__(self, store: Store, write_epoch: int | None, read_epoch: int):
        self.store, self.write_epoch, self.read_epoch = store, write_epoch, read_epoch
        self.seq = 0
        self.written: list[dict] = []
        self.files = store.files
        store.pins[read_epoch] = store.pins.get(read_epoch, 0) + 1
        store.named[id(self)] = self.files
        self.open = True

    def put(self, rows: DataFrame) -> None:
        """Upsert rows (k and the value columns); the last row of a key in the same transaction wins by call order."""
        self._write("put", rows, False)

    def put_one(self, key: str, *values: str) -> None:
        self.put(self.store.spark.createDataFrame([(key, *values)], ["k", *self.store.columns]))

    def delete(self, keys: DataFrame) -> None:
        empty = [F.lit(None).cast("string").alias(c) for c in self.store.columns]
        self._write("delete", keys.select("k", *empty), True)

    def delete_one(self, key: str) -> None:
        self.delete(self.store.spark.createDataFrame([(key,)], ["k"]))

    def state(self, lo: str | None = None, hi: str | None = None) -> DataFrame:
        """What this transaction sees, read from the files that may hold keys from `lo` to `hi`."""
        return model.state(self.store.log(self.files, lo, hi), self.read_epoch)

    def get(self, key: str) -> Row | None:
        with self.store.profiler.timed("get") as sample:
            sample["read"] = self._bytes(key, key)
            return scan.get(self.state(key, key), key).first()

    def value_range(self, column: str, lo: str, hi: str) -> DataFrame:
        return self.select({column: lambda v: v.between(lo, hi)})

    def select(self, predicates: dict[str, runs.Predicate]) -> DataFrame:
        """Rows whose values satisfy all predicates (column: a function of the value), through the codes of the runs."""
        return self.store.select(predicates, self.read_epoch, self.files)

    def where(self, predicate: Column) -> DataFrame:
        return self.state().where(predicate)

    def scan(self) -> DataFrame:
        return self.state()

    def key_range(self, lo: str, hi: str) -> DataFrame:
        return scan.key_range(self.state(lo, hi), lo, hi)

    def scan_k(self, k: int, start: str) -> DataFrame:
        return scan.scan_k(self.state(start), k, start)

    def iterate(self, start: str) -> Iterator[Row]:
        """A cursor in key order; its sample is the time until the last row that was asked for."""
        with self.store.profiler.timed("iterate") as sample:
            sample["read"] = self._bytes(start, None)
            yield from self.state(start).where(F.col("k") >= start).orderBy("k").toLocalIterator()

    def fetch(self, op: str, rows: DataFrame) -> list[Row]:
        """The rows of a read of this transaction, timed: what a DataFrame costs shows when it runs, not when it is made."""
        with self.store.profiler.timed(op) as sample:
            sample["read"] = self._bytes(None, None)
            return rows.collect()

    def close(self) -> None:
        if self.open:
            self._end()
            if self.write_epoch is not None and self.store.options.maintain:
                self.store.maintain()

    commit = close

    def abort(self) -> None:
        """Take all writes of this transaction back. Nothing else has read them: its epoch was not complete."""
        if self.open:
            if self.written:
                self.store._drop(self.written)
            self._end()

    def _end(self) -> None:
        self.open = False
        self.store.active.pop(self.write_epoch, None)
        del self.store.named[id(self)]
        self.store.pins[self.read_epoch] -= 1
        if not self.store.pins[self.read_epoch]:
            del self.store.pins[self.read_epoch]

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self.close()
        else:
            self.abort()

    def _bytes(self, lo: str | None, hi: str | None) -> int:
        return sum(f["bytes"] or 0 for f in levels.prune_files(self.files, lo, hi))

    def _write(self, op: str, rows: DataFrame, deleted: bool) -> None:
        if self.write_epoch is None:
            raise PermissionError("a read-only transaction cannot write")
        if not self.open:
            raise PermissionError("the transaction has ended")
        self.seq += 1
        system = {"epoch": F.lit(self.write_epoch).cast("long"), "seq": F.lit(self.seq).cast("long"), "deleted": F.lit(deleted)}
        with self.store.profiler.timed(op) as sample:
            entry = self.store._append(rows.select("k", *self.store.columns).withColumns(system))
            sample["written"] = entry["bytes"]
        self.written.append(entry)
