"""Warehouse tables on plain Parquet with replaceable directories.

A table is a folder of ``part=<value>/rev=<token>`` directories plus one small commit file per
revision that lists the current directories of each part. A change writes new directories with
an ordinary Spark job and then publishes a commit file by one rename: a job that dies half-way
leaves the table as it was, readers never see a mixture, and directories that are not touched
are neither read nor rewritten. New rows only add a directory to their part; a part that has
gathered many is folded into one the next time it changes.

A large table with keys also keeps an index, ``keys/bucket=<n>/rev=<token>``: which parts a key may
be in, dealt out by the key's hash. It is written with the data and published by the same commit. Entries are
added when a key first comes to a part and never taken back, so the index names every part that
holds a key, and sometimes one that held it before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import date, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashgrid.functions.labels import month_text
from crashgrid.functions.predicates import in_dates
from crashgrid.schemas import VERSION

UNKNOWN_PART = "unknown"
ONE_PART = "all"
# A part with this many directories is folded into one when it is next written.
FOLD_AT = 16
# A table with so many rows keeps a key index, with about as many entries in a bucket.
INDEX_FROM = 1_000_000

Directory = tuple[str, str]


def month_part(column: str = "crash_date") -> Column:
    """Partition value of a dated row; rows without a date share one partition."""
    return F.coalesce(month_text(column), F.lit(UNKNOWN_PART))


def observed(passed: Observation) -> dict:
    """What was observed; nothing where no row passed, as Spark then leaves the observing step out of the plan."""
    try:
        return passed.get
    except Py4JJavaError:
        return {}


class ConcurrentCommit(RuntimeError):
    """Another writer published the same revision first."""


class PartedTable:
    """Parquet table whose directories are replaced as a whole."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        part: Column,
        sort: tuple[str, ...] = (),
        keys: tuple[str, ...] = (),
        index_from: int = INDEX_FROM,
    ) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.part = part
        self.sort = sort
        self.keys = keys
        self.index_from = index_from

    # -- state ---------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return hadoop_path.getFileSystem(conf), hadoop_path

    def revision(self) -> int:
        """Latest published revision; zero for a table that was never written."""
        fs, folder = self._fs(f"{self.path}/_commits")
        if not fs.exists(folder):
            return 0
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def state(self, revision: int | None = None) -> dict:
        """Commit of a revision: current directories per part, and the applied batch ids."""
        revision = self.revision() if revision is None else revision
        if revision == 0:
            return {"revision": 0, "parts": {}, "batches": {}, "rows": 0}
        fs, file = self._fs(f"{self.path}/_commits/{revision:09d}.json")
        stream = fs.open(file)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(
                stream, "UTF-8"
            )
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, state: dict) -> None:
        """Write the commit aside and rename it into place, so that no reader sees half of it."""
        fs, file = self._fs(f"{self.path}/_commits/{state['revision']:09d}.json")
        _, draft = self._fs(f"{self.path}/_commits/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(state, sort_keys=True), "utf-8"))
        finally:
            stream.close()
        if fs.exists(file) or not fs.rename(draft, file):
            fs.delete(draft, False)
            raise ConcurrentCommit(f"{self.path}: revision {state['revision']} already exists")

    def directories(self, parts: Iterable[str] | None = None, state: dict | None = None) -> set[Directory]:
        """Current (part, rev) directories, of all parts or of some."""
        current = (state or self.state())["parts"]
        chosen = current if parts is None else {p: current[p] for p in parts if p in current}
        return {(p, token) for p, tokens in chosen.items() for token in tokens}

    # -- reading -------------------------------------------------------------
    def read(self, parts: Iterable[str] | None = None, revision: int | None = None) -> DataFrame:
        """Current rows, or only those of some parts (other directories are not listed).

        Without the version of the rows, which only a merge looks at.
        """
        state = self.state(revision)
        return self.read_directories(self.directories(parts, state)).drop("part", "rev", *VERSION)

    def read_directories(self, directories: Iterable[Directory]) -> DataFrame:
        """Rows of some directories, with the ``part`` and ``rev`` they come from."""
        stored = T.StructType(
            [*self.schema.fields, T.StructField("part", T.StringType()),
             T.StructField("rev", T.StringType())]
        )
        folders = [f"{self.path}/data/part={p}/rev={r}" for p, r in sorted(directories)]
        if not folders:
            return self.spark.createDataFrame([], stored)
        reader = self.spark.read.schema(stored).option("basePath", f"{self.path}/data")
        return reader.parquet(*folders)

    def read_between(
        self, start: datetime | None = None, end: datetime | None = None, column: str = "crash_date"
    ) -> DataFrame:
        """Rows of an inclusive date range of a monthly table; other months are not listed."""
        return self.read(self.months(start, end)).where(in_dates(column, start, end))

    def months(self, start: date | datetime | None, end: date | datetime | None) -> list[str]:
        """Monthly parts that can hold rows of a date range."""
        low = "" if start is None else f"{start:%Y-%m}"
        high = "9999-99" if end is None else f"{end:%Y-%m}"
        parts = self.state()["parts"]
        if start is None and end is None:
            return list(parts)
        return [p for p in parts if p != UNKNOWN_PART and low <= p <= high]

    # -- key index -----------------------------------------------------------
    def _entries(self, index: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        """Index entries (keys and ``part``) of all buckets or of some."""
        fields = [f for f in self.schema.fields if f.name in self.keys]
        stored = T.StructType([*fields, T.StructField("part", T.StringType())])
        chosen = index["directories"] if buckets is None else buckets
        folders = [
            f"{self.path}/keys/bucket={b}/rev={token}" for b in sorted(chosen) for token in index["directories"].get(b, ())
        ]
        if not folders:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*folders)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def lookup(self, wanted: DataFrame, state: dict) -> DataFrame | None:
        """Parts that may hold the keys of ``wanted``: keys and ``part``; None without an index.

        Only the buckets of these keys are read.
        """
        index = state.get("index")
        if index is None:
            return None
        touched = None
        if index["buckets"] > 1:
            bucket = self._bucket(index["buckets"]).cast("string").alias("bucket")
            touched = [r["bucket"] for r in wanted.select(bucket).distinct().collect()]
        return self._entries(index, touched).join(wanted, list(self.keys)).select(*self.keys, "part").distinct()

    def _indexed(self, index: dict, fresh: DataFrame, token: str) -> dict:
        """Add entries; fold crowded buckets, and deal all out anew when they have outgrown their number."""
        buckets, kept, added = index["buckets"], index["directories"], Observation()
        fresh = fresh.select(*self.keys, "part").observe(added, F.count(F.lit(1)).alias("n"))
        if index["entries"] > 4 * buckets * self.index_from:
            fresh, kept = fresh.unionByName(self._entries(index)).distinct(), {}
            buckets = -(-index["entries"] // self.index_from)
        elif crowded := [b for b, tokens in kept.items() if len(tokens) >= FOLD_AT]:
            fresh = fresh.unionByName(self._entries(index, crowded)).distinct()
            kept = {b: tokens for b, tokens in kept.items() if b not in crowded}
        laid_out = (
            fresh.withColumn("bucket", self._bucket(buckets))
            .hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.keys).withColumn("rev", F.lit(token))
        )
        laid_out.write.mode("append").partitionBy("bucket", "rev").parquet(f"{self.path}/keys")
        directories = {b: list(tokens) for b, tokens in kept.items()}
        for bucket in self._written("keys", "bucket", token):
            directories.setdefault(bucket, []).append(token)
        return {"buckets": buckets, "entries": index["entries"] + observed(added).get("n", 0), "directories": directories}

    def _next_index(
        self, state: dict, token: str, directories: set[Directory], rows: int, fresh: DataFrame | bool
    ) -> dict | None:
        """Index after a write of ``token``, or None while the table is small."""
        index = state.get("index")
        if not self.keys or (index is None and rows < self.index_from):
            return None
        if index is None:
            every = self.read_directories(directories).select(*self.keys, "part")
            empty = {"buckets": max(1, rows // self.index_from), "entries": 0, "directories": {}}
            return self._indexed(empty, every, token)
        if fresh is False:
            return index
        written = {d for d in directories if d[1] == token}
        return self._indexed(index, self.read_directories(written) if fresh is True else fresh, token)

    # -- writing -------------------------------------------------------------
    def rewrite(
        self,
        rows: DataFrame,
        replaced: Iterable[Directory],
        batch: tuple[str, int, list[int]] | None = None,
        based_on: dict | None = None,
        fresh: DataFrame | bool = True,
        added: int | None = None,
        cursor: tuple[str, dict] | None = None,
    ) -> int:
        """Put ``rows`` in the place of some directories; with none given, append them.

        Output is rebalanced by part, which splits a part that holds most of the rows over
        many tasks and packs small parts together. For the key index, ``fresh`` holds the keys that
        are new to a part (True: all that are written may be, False: none is), and ``added`` says by
        how many rows the table grows (else they are counted). ``cursor`` is published with the rows.
        """
        state = based_on or self.state()
        revision = state["revision"] + 1
        # Unique per attempt, so leftovers of a failed one are never picked up.
        token = f"{revision:09d}-{uuid.uuid4().hex[:8]}"
        names = [f.name for f in self.schema.fields]
        rows = rows.withColumns({c: F.lit(None) for c in VERSION if c in names and c not in rows.columns})
        gone = set(replaced)
        size = state.get("rows")
        if self.keys and added is None:
            size = self.read_directories(self.directories(state=state) - gone).count()
        written = Observation()
        laid_out = (
            rows.observe(written, F.count(F.lit(1)).alias("n")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
            .withColumn("part", self.part.cast("string"))
            .hint("rebalance", "part")
            .sortWithinPartitions("part", *[c for c in self.sort if c in names])
            .withColumn("rev", F.lit(token))
        )
        laid_out.write.mode("append").partitionBy("part", "rev").parquet(f"{self.path}/data")
        kept = self.directories(state=state) - gone
        kept |= {(part, token) for part in self._written("data", "part", token)}
        size = (size or 0) + (observed(written).get("n", 0) if added is None else added)
        self._commit(state, kept, batch, size, self._next_index(state, token, kept, size, fresh), cursor)
        return revision

    def cursor(self, name: str) -> dict | None:
        """Where the last run of that name has got to."""
        return self.state().get("cursors", {}).get(name)

    def remember(self, name: str, value: dict, based_on: dict) -> None:
        """Publish a cursor alone; fails like any commit if ``based_on`` is no longer the latest state."""
        self._commit(based_on, self.directories(state=based_on), None, based_on.get("rows"), based_on.get("index"), (name, value))

    def _commit(self, state: dict, directories: set[Directory], batch=None, rows=None, index=None, cursor=None) -> None:
        parts: dict[str, list[str]] = {}
        for part, token in sorted(directories):
            parts.setdefault(part, []).append(token)
        batches = dict(state["batches"])
        if batch is not None:
            batches[batch[0]] = {"id": batch[1], "counts": batch[2]}
        cursors = dict(state.get("cursors", {})) | ({} if cursor is None else {cursor[0]: cursor[1]})
        rest = {"rows": rows} | ({} if index is None else {"index": index}) | ({"cursors": cursors} if cursors else {})
        self._publish({"revision": state["revision"] + 1, "parts": parts, "batches": batches} | rest)

    def _written(self, folder: str, level: str, token: str) -> list[str]:
        """Values of ``level`` (parts or buckets) that one write has put rows into."""
        fs, pattern = self._fs(f"{self.path}/{folder}/{level}=*/rev={token}")
        found = fs.globStatus(pattern) or []
        return [f.getPath().getParent().getName().removeprefix(f"{level}=") for f in found]

    def replace(self, rows: DataFrame, parts: Iterable[str]) -> int:
        """Make ``rows`` the whole content of ``parts``; parts left without rows disappear."""
        state = self.state()
        return self.rewrite(rows, self.directories(parts, state), based_on=state)

    def drop_parts(self, parts: Iterable[str]) -> None:
        """Forget whole parts without reading or writing any data."""
        state = self.state()
        left = self.directories(state=state) - self.directories(parts, state)
        size = self.read_directories(left).count() if self.keys else None
        self._commit(state, left, rows=size, index=state.get("index"))

    def load(self, rows: DataFrame) -> int:
        """Replace the whole table by ``rows``."""
        state = self.state()
        return self.rewrite(rows, self.directories(state=state), based_on=state)

    def vacuum(self, keep: int = 1) -> int:
        """Delete directories that none of the last ``keep`` revisions uses; returns how many.

        Directories of a revision newer than the ones read here are left alone, so a writer
        may be at work.
        """
        latest = self.revision()
        live: set[Directory] = set()
        index: set[Directory] = set()
        for revision in range(max(1, latest - keep + 1), latest + 1):
            state = self.state(revision)
            live |= self.directories(state=state)
            buckets = state.get("index", {}).get("directories", {})
            index |= {(b, token) for b, tokens in buckets.items() for token in tokens}
        if latest == 0:
            return 0
        self._delete_others("keys", "bucket", index, latest)
        return self._delete_others("data", "part", live, latest)

    def _delete_others(self, folder: str, level: str, live: set[Directory], latest: int) -> int:
        fs, data = self._fs(f"{self.path}/{folder}")
        if not fs.exists(data):
            return 0
        removed = 0
        for part_dir in fs.listStatus(data):
            part = part_dir.getPath().getName().removeprefix(f"{level}=")
            if not part_dir.isDirectory():
                continue
            for rev_dir in fs.listStatus(part_dir.getPath()):
                token = rev_dir.getPath().getName().removeprefix("rev=")
                made_at = token.split("-")[0]
                old = made_at.isdigit() and int(made_at) <= latest
                if old and (part, token) not in live:
                    fs.delete(rev_dir.getPath(), True)
                    removed += 1
        return removed


def warehouse_table(spark: SparkSession, path: str, spec, index_from: int = INDEX_FROM) -> PartedTable:
    """One of the four crash tables, partitioned by month and sorted for row-group skipping."""
    return PartedTable(
        spark, f"{path.rstrip('/')}/{spec.name}", spec.schema, month_part(),
        sort=("crash_date", *spec.keys), keys=spec.keys, index_from=index_from,
    )


def append_rows(spark: SparkSession, path: str, ddl: str, rows: list[tuple]) -> None:
    """Append a few log rows to a small Parquet table."""
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
