"""A table of rows with a key, changed batch by batch: base files, deltas and merge on read.

A batch writes only the rows it changes, as a delta beside what is there. Of equal keys the newest row counts. Parts
(the months) with too many deltas are merged level by level, and only these are rewritten. Which files count is said by
a manifest (`sluice.sinks.manifest`), so a batch is seen whole or not at all, and a lost driver leaves the table as it was.

The layout is plain Parquet: data/seg=<version>/<part>=.../<split>=.../. The version, the part and the split are
partition columns, so conditions on part and split are pruned to the folders they need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sinks import files
from sluice.sinks.manifest import Entry, Manifest, Version, levels_to_merge


@dataclass(frozen=True)
class KeyedTable:
    """`schema` is DDL of all columns, among them the key, the part and the split column (both strings).

    A key never changes its part. Its split value may change (an open row is closed): reading one split value leaves out
    the older rows that newer ones have moved out of it.
    """

    spark: SparkSession
    root: str
    schema: str
    keys: tuple[str, ...]
    part: str
    split: str
    fan: int = 4

    @property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.root}/versions")

    @property
    def data(self) -> str:
        return f"{self.root}/data"

    def _scan(self, entries: Sequence[Entry]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], f"{self.schema}, seg bigint")
        paths = [f"{self.data}/seg={e.seg}/{self.part}={e.part}" for e in entries]
        reader = self.spark.read.schema(f"{self.schema}, seg bigint").option("basePath", self.data)
        return reader.parquet(*paths)

    def read(
        self, version: Version | None = None, split: str | None = None, parts: Callable[[str], bool] | None = None
    ) -> DataFrame:
        """The rows as of a version (the newest by default), of one split value, of the parts `parts` accepts."""
        version = version or self.manifest.load()
        wanted = [p for p in version.parts() if parts is None or parts(p)]
        return self._merged({p: version.of_part(p) for p in wanted}, split)

    def _merged(self, by_part: dict[str, list[Entry]], split: str | None) -> DataFrame:
        """Newest row per key. A part's oldest entry is read as it is, less the keys that newer entries hold."""
        bases = [entries[0] for entries in by_part.values()]
        deltas = [e for entries in by_part.values() for e in entries[1:]]
        here = F.lit(True) if split is None else F.col(self.split) == split
        base = self._scan(bases).filter(here)
        if not deltas:
            return base.drop("seg")
        newer = self._scan(deltas)
        key = [self.part, *self.keys]
        others = [c for c in newer.columns if c not in key]
        latest = newer.groupBy(*key).agg(F.max_by(F.struct(*others), "seg").alias("_r")).select(*key, "_r.*")
        kept = base.join(newer.select(*key).distinct(), key, "left_anti")
        return kept.unionByName(latest.filter(here)).drop("seg")

    def _write(self, rows: DataFrame, seg: int, level: int) -> list[Entry]:
        """Write rows as the files of a version; what an attempt that failed left there is replaced."""
        path = f"{self.data}/seg={seg}"
        # Files are cut by size, so a part that holds most rows is written by many tasks.
        shaped = rows.select(*self._columns()).hint("rebalance", F.col(self.part), F.col(self.split))
        shaped.write.mode("overwrite").partitionBy(self.part, self.split).parquet(path)
        written = self.spark.read.schema(f"{self.part} string, {self.split} string").option("basePath", path).parquet(path)
        counts = written.groupBy(self.part).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per month
        return [Entry(seg, r[0], level, r[1]) for r in counts]

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def upsert(self, batch: str, rows: DataFrame) -> Version:
        """Store new and changed rows (one per key) as a batch; repeating the last batch replaces it."""
        newest, start = self.manifest.start_of(batch)
        entries = self._write(rows, newest.number + 1, 0)
        return self.manifest.commit(newest, batch, start.number, [*start.entries, *entries])

    def compact(self) -> Version:
        """Merge the parts that hold too many entries, each up to the level it needs; others stay as they are."""
        version = self.manifest.load()
        due = {p: m for p in version.parts() if (m := levels_to_merge(version.of_part(p), self.fan))}
        if not due:
            return version
        seg = version.number + 1
        levels = {p: 1 + max(e.level for e in m) for p, m in due.items()}
        made = [Entry(e.seg, e.part, levels[e.part], e.rows) for e in self._write(self._merged(due, None), seg, 1)]
        gone = {e for m in due.values() for e in m}
        return self.manifest.commit(version, version.batch, version.before, [*(e for e in version.entries if e not in gone), *made])

    def delete(self, victims: DataFrame) -> Version:
        """Remove keys; `victims` has the part and the key columns. Only the parts that hold victims are rewritten."""
        version = self.manifest.load()
        key = [self.part, *self.keys]
        touched = {r[0] for r in self._scan(version.entries).join(victims.select(*key), key, "left_semi").select(self.part).distinct().collect()}
        if not touched:
            return version
        kept = self.read(version, parts=touched.__contains__).join(victims.select(*key), key, "left_anti")
        top = max(e.level for e in version.entries)
        made = self._write(kept, version.number + 1, top)
        rest = [e for e in version.entries if e.part not in touched]
        # The batch before can no longer be repeated from where it started: its start still holds the victims.
        return self.manifest.commit(version, None, 0, [*rest, *made])

    def drop_parts(self, parts: Sequence[str]) -> Version:
        """Forget whole parts; their files go with the versions that still list them."""
        version = self.manifest.load()
        rest = [e for e in version.entries if e.part not in set(parts)]
        return version if len(rest) == len(version.entries) else self.manifest.commit(version, None, 0, rest)

    def expire(self, keep: int = 2) -> None:
        """Keep the last versions only and delete the files no kept version lists. No reader may be on older ones."""
        kept = self.manifest.expire(keep)
        live = {(e.seg, e.part) for v in kept for e in v.entries}
        for folder in files.names(self.spark, self.data):
            seg = int(folder.removeprefix("seg="))
            parts = [n for n in files.names(self.spark, f"{self.data}/{folder}") if "=" in n]
            dead = [p for p in parts if (seg, p.split("=", 1)[1]) not in live]
            if len(dead) == len(parts):
                files.remove(self.spark, f"{self.data}/{folder}")
            else:
                for p in dead:
                    files.remove(self.spark, f"{self.data}/{folder}/{p}")


@dataclass(frozen=True)
class SummedTable(KeyedTable):
    """Counters kept up to date: a batch stores its increments, equal keys add up, a repeated batch replaces its own.

    `sums` are the columns that add up; key columns may be null. Merging adds too, so reading sums a few entries per part.
    """

    sums: tuple[str, ...] = ()

    def _merged(self, by_part: dict[str, list[Entry]], split: str | None) -> DataFrame:
        rows = self._scan([e for entries in by_part.values() for e in entries])
        if split is not None:
            rows = rows.filter(F.col(self.split) == split)
        return rows.groupBy(self.part, self.split, *self.keys).agg(*(F.sum(c).alias(c) for c in self.sums))


@dataclass(frozen=True)
class SketchTable(KeyedTable):
    """Quantile sketches kept up to date: a batch stores its own, equal keys merge (KLL sketches of doubles)."""

    sketch: str = "sketch"

    def _merged(self, by_part: dict[str, list[Entry]], split: str | None) -> DataFrame:
        rows = self._scan([e for entries in by_part.values() for e in entries])
        if split is not None:
            rows = rows.filter(F.col(self.split) == split)
        merged = F.kll_merge_agg_double(self.sketch).alias(self.sketch)
        return rows.groupBy(self.part, self.split, *self.keys).agg(merged)


def changed_rows(after: DataFrame, tags: Sequence[str], tag: str) -> DataFrame:
    """Rows whose `tags` columns no longer hash to what `tagged` noted before the steps."""
    return after.filter(F.xxhash64(*tags) != F.col(tag)).drop(tag)


def tagged(rows: DataFrame, tags: Sequence[str], tag: str) -> DataFrame:
    return rows.withColumn(tag, F.xxhash64(*tags))
