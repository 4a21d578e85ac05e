"""A keyed table in a shared folder that is merged when it is read: hash buckets, one delta per batch, compaction."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.operators.sizes import small_side

BUCKETS = 64
#: Deltas that may pile up before ``commit`` compacts the buckets they touch.
MOST_DELTAS = 8
LOG = "version long, state string"


@dataclass(frozen=True)
class State:
    """What a version of the table consists of: the base folder of each bucket, and the deltas since, oldest first."""

    version: int = 0
    batch: int = -1
    base: dict[int, str] = field(default_factory=dict)
    deltas: tuple[tuple[str, tuple[int, ...]], ...] = ()

    def folders(self) -> set[str]:
        return set(self.base.values()) | {name for name, _ in self.deltas}


@dataclass(frozen=True)
class KeyedStore:
    """Rows of ``schema``, one per ``keys`` (nulls equal nulls), in the shared folder ``root``.

    A row's bucket is a hash of ``bucket_by`` (some of the keys, by default all), so that a lookup by those columns reads
    its buckets only. A batch is written as a delta that holds its own rows; readers take the newest row of a key. A version
    is one file of the log, which appears by one rename when it is complete: a reader sees all of a batch or nothing of it.
    There is one writer. Batch numbers rise; a batch that is committed already is left out, and one that died before
    its commit overwrites its own folder, so a replay changes nothing.
    """

    spark: SparkSession
    root: str
    schema: StructType
    keys: tuple[str, ...]
    bucket_by: tuple[str, ...] = ()
    buckets: int = BUCKETS
    most_deltas: int = MOST_DELTAS

    def state(self) -> State:
        """The newest complete version; the log holds one short row per version kept."""
        log = self._path("log")
        if not log.getFileSystem(self._hadoop()).exists(log):
            return State()
        rows = self.spark.read.schema(LOG).option("recursiveFileLookup", True).json(log.toString())
        newest = rows.orderBy(F.desc("version")).first()
        if newest is None:
            return State()
        got = json.loads(newest["state"])
        return State(newest["version"], got["batch"], {int(b): name for b, name in got["base"].items()},
                     tuple((name, tuple(touched)) for name, touched in got["deltas"]))

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The merged table, or the given buckets of it. The base is not shuffled while the deltas' keys fit a broadcast."""
        return self._merged(self.state(), buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.bucket_by or self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with the ``bucket_by`` columns fall in: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def commit(self, rows: DataFrame, batch: int) -> bool:
        """Upsert the rows, one per key, as this batch; False when the batch is there already.

        Columns that the rows do not carry keep their stored value. Only then are stored rows read, from the touched
        buckets. Compacts once more than ``most_deltas`` deltas have gathered.
        """
        state = self.state()
        if batch <= state.batch:
            return False
        missing = [c for c in self.schema.names if c not in rows.columns]
        given = rows.select(*[c for c in self.schema.names if c not in missing])
        if missing:
            stored = self._merged(state, self.touched(given)).select(*[F.col(k).alias(f"_k_{k}") for k in self.keys], *missing)
            given = given.join(stored, self._same(lambda k: F.col(f"_k_{k}")), "left")
        name = f"delta-{batch:012d}"
        self._write(given, name)
        touched = tuple(self._written(name))
        deltas = (*state.deltas, (name, touched)) if touched else state.deltas
        self._publish(replace(state, version=state.version + 1, batch=batch, deltas=deltas))
        if len(deltas) > self.most_deltas:
            self.compact()
        return True

    def compact(self) -> None:
        """Write the buckets that deltas touch anew, as their base; the other buckets stay as they are."""
        state = self.state()
        touched = sorted({b for _, bs in state.deltas for b in bs})
        if not touched:
            return
        name = f"base-{state.version + 1:012d}"
        self._write(self._merged(state, touched), name)
        self._publish(State(state.version + 1, state.batch, {**state.base, **dict.fromkeys(self._written(name), name)}))

    def vacuum(self) -> list[str]:
        """Delete the data folders that the newest version does not name, and older versions of the log.

        For the writer, when no reader of an older version is left. Returns what was deleted.
        """
        state = self.state()
        kept = state.folders()
        gone = [n for n in self._names("data") if n not in kept]
        old = [n for n in self._names("log") if int(n) < state.version]
        for kind, names in (("data", gone), ("log", old)):
            for name in names:
                path = self._path(kind, name)
                path.getFileSystem(self._hadoop()).delete(path, True)
        return gone

    # ------------------------------------------------------------ inside

    def _merged(self, state: State, buckets: Sequence[int] | None) -> DataFrame:
        wanted = set(range(self.buckets)) if buckets is None else set(buckets)
        base = self._load([(state.base[b], b) for b in sorted(wanted & set(state.base))])
        parts = [self._load([(name, b) for b in bs if b in wanted]).withColumn("_nth", F.lit(i)) for i, (name, bs) in enumerate(state.deltas) if wanted & set(bs)]
        if not parts:
            return base
        changes = parts[0]
        for part in parts[1:]:
            changes = changes.unionByName(part)
        newest = Window.partitionBy(*self.keys).orderBy(F.desc("_nth"))
        latest = changes.withColumn("_spot", F.row_number().over(newest)).where("_spot = 1").select(*self.schema.names)
        changed = small_side(changes.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).distinct())
        return base.join(changed, self._same(lambda k: F.col(f"_k_{k}")), "left_anti").unionByName(latest)

    def _same(self, other) -> Column:
        met = F.lit(True)
        for k in self.keys:
            met = met & F.col(k).eqNullSafe(other(k))
        return met

    def _load(self, places: Sequence[tuple[str, int]]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{name}/_bucket={b}" for name, b in places])

    def _write(self, rows: DataFrame, name: str) -> None:
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        dealt = typed.withColumn("_bucket", self.bucket()).repartition("_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/data/{name}")

    def _written(self, name: str) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self._names("data", name) if n.startswith("_bucket="))

    def _publish(self, state: State) -> None:
        text = json.dumps({"batch": state.batch, "base": state.base, "deltas": state.deltas})
        row = self.spark.createDataFrame([(state.version, text)], LOG).coalesce(1)
        row.write.mode("overwrite").json(f"{self.root}/log/{state.version:012d}")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _hadoop(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        system = path.getFileSystem(self._hadoop())
        if not system.exists(path):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(path) if not s.getPath().getName().startswith((".", "_SUCCESS", "_temporary")))
