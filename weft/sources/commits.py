"""Several tables written as one commit.

    root/data/<folder of a run>/<table>/...      rows, as Parquet
    root/_commits/<number>.json                  manifests

A commit writes all its tables to a folder of its own, reads each back and
compares the number of rows with the number written, and then creates the next
manifest, which is what makes the rows visible: readers follow manifests and
never list data.  A run that stops before leaves the old state as it was, and
what it wrote stays unseen (``orphans``).  A manifest is created exclusively, so
of two writers one gets the number and the other takes the next; one that was cut
off while being written does not parse and counts as none.

A run has an id: a second commit of the same id writes nothing and returns the
first.  Every commit is also a backup: ``read(..., as_of=n)`` has the tables as
commit n left them.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

APPEND, REPLACE = "append", "replace"
_END = "committed"


@dataclasses.dataclass(frozen=True)
class Commit:
    number: int
    run_id: str
    tables: dict            # name -> {"mode", "path", "rows", "schema"}


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[p for p in parts if p]]))

    def _numbers(self) -> list[int]:
        folder = self._path("_commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> Commit | None:
        """None: the manifest was not written to its end."""
        stream = self._fs.open(self._path("_commits", f"{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            m = json.loads(text)
        except json.JSONDecodeError:
            return None
        return Commit(number, m["run_id"], m["tables"]) if m.get("state") == _END else None

    def history(self) -> list[Commit]:
        """All commits, the latest first."""
        return [c for c in map(self._load, reversed(self._numbers())) if c]

    def find(self, run_id: str) -> Commit | None:
        return next((c for c in map(self._load, reversed(self._numbers())) if c and c.run_id == run_id), None)

    def commit(self, run_id: str, tables: dict[str, DataFrame], replace: tuple[str, ...] = ()) -> Commit:
        """Write ``tables`` (those named in ``replace`` instead of what they hold,
        the others after it) as one commit."""
        done = self.find(run_id)
        if done:
            return done
        folder = f"data/{uuid.uuid4().hex}"
        written = {}
        for name, df in tables.items():
            path, seen = f"{folder}/{name}", Observation(f"commit {name} {uuid.uuid4().hex}")
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{path}")
            back = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}").count()
            if back != seen.get["n"]:
                raise IOError(f"{name}: wrote {seen.get['n']} rows, read back {back}; nothing is committed")
            written[name] = {"mode": REPLACE if name in replace else APPEND, "path": path, "rows": back, "schema": df.schema.jsonValue()}
        text = json.dumps({"run_id": run_id, "tables": written, "state": _END}, ensure_ascii=False)
        number = max(self._numbers(), default=0) + 1
        while True:
            try:
                stream = self._fs.create(self._path("_commits", f"{number:012d}.json"), False)
                break
            except Exception as e:  # noqa: BLE001 - another writer took the number
                if "AlreadyExists" not in str(e):
                    raise
                other = self._load(number)
                if other and other.run_id == run_id:
                    return other
                number += 1
        stream.write(bytearray(text.encode()))
        stream.close()
        return Commit(number, run_id, written)

    def _parts(self, name: str, as_of: int | None) -> list[dict]:
        found = []
        for number in reversed(self._numbers()):
            if as_of is not None and number > as_of:
                continue
            c = self._load(number)
            if c and name in c.tables:
                found.append(c.tables[name])
                if c.tables[name]["mode"] == REPLACE:
                    break
        return found[::-1]

    def read(self, name: str, as_of: int | None = None) -> DataFrame | None:
        """The table (as commit ``as_of`` left it), with the columns of its latest
        part; None where no commit has it."""
        parts = self._parts(name, as_of)
        if not parts:
            return None
        schema = StructType.fromJson(parts[-1]["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p['path']}" for p in parts])

    def rows(self, name: str, as_of: int | None = None) -> int:
        """Number of rows, from the manifests."""
        return sum(p["rows"] for p in self._parts(name, as_of))

    def orphans(self) -> list[str]:
        """Data folders that no commit names: of runs that stopped, or that still write."""
        folder = self._path("data")
        if not self._fs.exists(folder):
            return []
        named = {t["path"].split("/")[1] for c in self.history() for t in c.tables.values()}
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(folder)) if n not in named)
