"""A table that many small batches write: levels of sorted runs with a manifest for each version."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from talkweave.operators.durable import hadoop_path

_SLOTS_IN_A_FILTER = 2048
_KEYS_IN_A_FILTER = 1000


@dataclass
class Snapshot:
    """One version: the last batch in it, its columns, and its runs (name, level, files: name, lowest and highest slot, bytes, rows)."""

    version: int = 0
    batch: int = -1
    schema: str | None = None
    runs: list[dict] = field(default_factory=list)


class Store:
    """Rows by a key, in runs sorted by slot (a hash of the key), key and ``order``.

    A batch adds a run of few files at level 0. ``fanout`` runs of a level are merged into one of the next, so a row is written as often
    as there are levels, their number grows with the logarithm of the batches, and files grow with their level. A reader takes one version's manifest and sees that
    version alone; the last ``keep`` versions' runs stay for those who still read. A key's rows are found by the files' slot ranges, then by the
    statistics of row groups, so what is read follows the keys that are asked for. ``replaces``: a key's rows in a later
    batch stand for all its earlier ones, which go when runs are merged. A batch that comes again changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "S", order: tuple[str, ...] = (), replaces: bool = False, slots: int = 1 << 14, fanout: int = 4, keep: int = 3):
        self.spark, self.path, self.key, self.order, self.replaces = spark, path, key, order, replaces
        self.slots, self.fanout, self.keep = slots, fanout, keep

    # manifests

    def _versions(self) -> list[int]:
        p, files = hadoop_path(self.spark, f"{self.path}/manifest")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in files.listStatus(p) if f.getPath().getName().endswith(".json")) if files.exists(p) else []

    def _manifest(self, version: int) -> Snapshot:
        p, files = hadoop_path(self.spark, f"{self.path}/manifest/{version:012}.json")
        stream = files.open(p)
        try:
            return Snapshot(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def snapshot(self) -> Snapshot:
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else Snapshot()

    def _commit(self, now: Snapshot) -> None:
        """A manifest appears whole, by a rename; then versions before the last ``keep`` go, and runs that none of these name."""
        target, files = hadoop_path(self.spark, f"{self.path}/manifest/{now.version:012}.json")
        draft, _ = hadoop_path(self.spark, f"{self.path}/manifest/{uuid.uuid4().hex}.draft")
        out = files.create(draft)
        out.write(json.dumps(vars(now)).encode())
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"another writer made version {now.version} of {self.path}")
        versions = self._versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        if old:
            named = {r["name"] for v in kept for r in self._manifest(v).runs}
            for r in {r["name"] for v in old for r in self._manifest(v).runs} - named:
                p, _ = hadoop_path(self.spark, f"{self.path}/runs/{r}")
                files.delete(p, True)
            for v in old:
                p, _ = hadoop_path(self.spark, f"{self.path}/manifest/{v:012}.json")
                files.delete(p, False)

    # runs

    def _run(self, rows: DataFrame, level: int, batch: int) -> dict:
        """Writes rows (with slot and written) as a run; a line for each of its files."""
        name = f"{level}-{batch}-{uuid.uuid4().hex[:8]}"
        place = ["slot", self.key, *self.order]
        rows.repartitionByRange(*place).sortWithinPartitions(*place).write.option("parquet.block.size", str(8 << 20)).parquet(f"{self.path}/runs/{name}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.path}/runs/{name}")
        per = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("slot"), F.max("slot"), F.max("_metadata.file_size"), F.count("*"))
        return {"name": name, "level": level, "files": [list(r) for r in per.collect()]}

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.slots)).cast("int")

    def append(self, rows: DataFrame, batch: int) -> None:
        now = self.snapshot()
        if now.batch >= batch:
            return
        run = self._run(rows.withColumns({"slot": self.slot(), "written": F.lit(batch).cast("long")}), 0, batch)
        self._commit(Snapshot(now.version + 1, batch, rows.schema.json(), now.runs + ([run] if run["files"] else [])))
        self._merge()

    def _merge(self) -> None:
        while True:
            now = self.snapshot()
            levels: dict[int, list[dict]] = {}
            for r in now.runs:
                levels.setdefault(r["level"], []).append(r)
            full = [k for k, runs in sorted(levels.items()) if len(runs) >= self.fanout]
            if not full:
                return
            some = levels[full[0]]
            rows = self._rows(now, some)
            merged = self._run(self._newest(rows) if self.replaces else rows, full[0] + 1, now.batch)
            names = {r["name"] for r in some}
            self._commit(Snapshot(now.version + 1, now.batch, now.schema, [r for r in now.runs if r["name"] not in names] + [merged]))

    def _rows(self, now: Snapshot, runs: list[dict], slots: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(now.schema)).add("slot", IntegerType()).add("written", LongType())
        paths = [f"{self.path}/runs/{r['name']}/{f[0]}" for r in runs for f in r["files"] if slots is None or _any_between(slots, f[1], f[2])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy("slot", self.key).agg(F.max("written").alias("written"))
        return rows.join(last, ["slot", self.key, "written"], "left_semi").select(rows.columns)

    # reading

    def read(self, keys: DataFrame | None = None, now: Snapshot | None = None) -> DataFrame:
        """The rows of a version, of all keys or of those in ``keys``, with slot and written (their batch)."""
        now = now or self.snapshot()
        if not now.schema:
            raise ValueError(f"nothing was written to {self.path} yet")
        if keys is None:
            rows = self._rows(now, now.runs)
        else:
            keys = keys.select(self.key).distinct().withColumn("slot", self.slot())
            slots = sorted(r.slot for r in keys.select("slot").distinct().collect())  # at most ``slots``
            rows = self._rows(now, now.runs, slots)
            if len(slots) <= _SLOTS_IN_A_FILTER:
                self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(_SLOTS_IN_A_FILTER))
                rows = rows.where(F.col("slot").isin(slots))
            few = [r[0] for r in keys.select(self.key).limit(_KEYS_IN_A_FILTER + 1).collect()]
            if len(few) <= _KEYS_IN_A_FILTER:
                rows = rows.where(F.col(self.key).isin(few))
            else:
                rows = rows.join(keys, ["slot", self.key], "left_semi").select(rows.columns)
        return self._newest(rows) if self.replaces and len(now.runs) > 1 else rows

    def files(self, keys: DataFrame, now: Snapshot | None = None) -> list[list]:
        """The lines of the files that a reader of these keys opens."""
        now = now or self.snapshot()
        slots = sorted(r[0] for r in keys.select(self.key).distinct().select(self.slot()).distinct().collect())
        return [f for r in now.runs for f in r["files"] if _any_between(slots, f[1], f[2])]


def _any_between(values: list[int], low: int, high: int) -> bool:
    at = bisect_left(values, low)
    return at < len(values) and values[at] <= high
