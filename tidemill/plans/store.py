"""Versioned datasets: immutable Parquet directories, and metadata in logs of numbered commits.

A commit is a small file that holds the metadata after it. Its number is one more than that of the commit it changes, and
only one process can create it; whoever comes second reads again and repeats its change. So drivers that share a folder lose
no commit of one another. Data go to a directory of their own before they are committed.
"""

from __future__ import annotations

import functools
import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..functions.stats import col
from ..operators import analyze
from ..sources import readers
from ..sources.files import Files

KEEP_VERSIONS, KEEP_HISTORY, MAX_CARDS = 20, 200, 12


_WIDER = {frozenset(("bigint", "double")): T.DoubleType(), frozenset(("int", "bigint")): T.LongType(), frozenset(("int", "double")): T.DoubleType(), frozenset(("date", "timestamp_ntz")): T.TimestampNTZType()}


def widened(a: T.StructType, b: T.StructType) -> T.StructType:
    """The columns of both, each of a type that holds the values of either."""
    kinds = {f.name: f.dataType for f in a}
    for f in b:
        old = kinds.get(f.name)
        if old is None or isinstance(old, T.NullType):
            kinds[f.name] = f.dataType
        elif old != f.dataType and not isinstance(f.dataType, T.NullType):
            kinds[f.name] = _WIDER.get(frozenset((old.simpleString(), f.dataType.simpleString())), T.StringType())
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of a schema that its own widen to; what it lacks is null."""
    have = {f.name: f.dataType for f in df.schema}
    return df.select(*[(col(f.name) if have.get(f.name) == f.dataType else col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


class Store:
    """Datasets below one folder, in any store that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, str(root).rstrip("/"), Files(spark)
        self.files.make_dir(f"{self.root}/datasets")

    # metadata

    def _latest(self, log: str) -> tuple[int, object]:
        """Number and content of a log's last commit; -1 and None for an empty log."""
        numbers = [int(n[:-5]) for n in self.files.names(log) if n.endswith(".json") and n[:-5].isdigit()]
        return (max(numbers), json.loads(self.files.read(f"{log}/{max(numbers):010d}.json"))) if numbers else (-1, None)

    def _commit(self, log: str, change: Callable[[object], object]) -> object:
        """The log's content after ``change``, which is called again with what others have committed meanwhile."""
        while True:
            number, found = self._latest(log)
            new = change(found)
            if self.files.create(f"{log}/{number + 1:010d}.json", json.dumps(new, ensure_ascii=False).encode()):
                return new
            time.sleep(random.uniform(0, 0.02))

    def _dir(self, ds: str) -> str:
        if not ds.isalnum():
            raise InputError("bad dataset id")
        return f"{self.root}/datasets/{ds}"

    def folder(self, ds: str) -> str:
        """Where a dataset's directories are."""
        return self._dir(ds)

    def meta(self, ds: str) -> dict:
        found = self._latest(f"{self._dir(ds)}/log")[1]
        if found is None:
            raise InputError(f"no such dataset: {ds}")
        return found

    def _change(self, ds: str, change: Callable[[dict], dict]) -> dict:
        """Metadata after a change of the dataset's latest."""

        def made(found):
            if found is None:
                raise InputError(f"no such dataset: {ds}")
            m = change(found)
            return m | {"updated_at": time.time(), "history": m["history"][-KEEP_HISTORY:]}

        return self._commit(f"{self._dir(ds)}/log", made)

    def list(self) -> list[dict]:
        """Latest first; folders without metadata are skipped."""
        found = [self._latest(f"{self.root}/datasets/{name}/log")[1] for name in self.files.names(f"{self.root}/datasets")]
        return sorted((m for m in found if m), key=lambda m: m["updated_at"], reverse=True)

    # data

    def _read(self, ds: str, m: dict, version: int) -> DataFrame:
        """A version's directories, those of one schema together, as the version's schema."""
        parts, root = m["paths"][str(version)], self._dir(ds)
        by_schema: dict[str, list[str]] = {}
        for name, schema in parts:
            by_schema.setdefault(schema, []).append(f"{root}/{name}")
        whole = T.StructType([])
        for schema in by_schema:
            whole = widened(whole, T.StructType.fromJson(json.loads(schema)))
        frames = [self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*names) for schema, names in by_schema.items()]
        return functools.reduce(DataFrame.unionByName, [as_schema(df, whole) for df in frames])

    def _new_path(self, ds: str) -> str:
        return f"{self._dir(ds)}/data-{uuid.uuid4().hex[:12]}.parquet"

    def create(self, df: DataFrame, name: str, project: str | None = None, parent: str | None = None, original: str | None = None) -> dict:
        """A dataset that holds ``df``; ``original``, the file that it comes from, is kept beside it."""
        ds = uuid.uuid4().hex[:12]
        path = self._new_path(ds)
        df.write.parquet(path)
        return self._created(ds, path, df, name, project, parent, original)

    def _created(self, ds: str, path: str, df: DataFrame, name: str, project: str | None, parent: str | None, original: str | None) -> dict:
        kept = None
        if original:
            kept = f"original.{original.rsplit('.', 1)[-1]}"
            self.files.copy(original, f"{self._dir(ds)}/{kept}")
        inherited = self.meta(parent).get("project") if parent and not project else project
        columns = [{"name": n, "type": t} for n, t in df.dtypes]
        parts = [[path.rsplit("/", 1)[-1], self.spark.read.parquet(path).schema.json()]]
        first = {"id": ds, "name": name, "project": inherited, "parent": parent, "original": kept, "current": 0, "versions": [0], "next": 1, "paths": {"0": parts}, "columns": columns, "history": [{"version": 0, "action": "create"}], "updated_at": time.time()}
        return self._commit(f"{self._dir(ds)}/log", lambda _: first)

    def ingest_csv(self, path: str, name: str, project: str | None = None) -> dict:
        """A delimited file as a dataset in one pass: types come from its head, and only if a later row doesn't fit them are they taken from all rows."""
        ds = uuid.uuid4().hex[:12]
        table = self._new_path(ds)
        df = readers.ingest_csv(self.spark, path, table)
        return self._created(ds, table, df, name, project, None, None)

    def import_sheet(self, ds: str, sheet: str) -> dict:
        """Another sheet of a dataset's workbook as a dataset below it, in its project."""
        m = self.meta(ds)
        if not (m.get("original") or "").endswith(".xlsx"):
            raise InputError("the dataset doesn't come from a workbook")
        path = f"{self._dir(ds)}/{m['original']}"
        return self.create(readers.read_xlsx(self.spark, path, sheet), f"{m['name']}-{sheet}", parent=ds, original=path)

    def load(self, ds: str, version: int | None = None) -> DataFrame:
        m = self.meta(ds)
        return self._read(ds, m, m["current"] if version is None else version)

    def save(self, ds: str, df: DataFrame, action: str) -> dict:
        """A new version after the current one; what had been undone is pruned, and the oldest beyond KEEP_VERSIONS go (never version 0)."""
        self.meta(ds)
        path = self._new_path(ds)
        self._written(df, path)
        part = [path.rsplit("/", 1)[-1], self.spark.read.parquet(path).schema.json()]
        return self._next_version(ds, lambda m: [part], action)

    def _written(self, df: DataFrame, path: str) -> None:
        try:
            df.write.mode("overwrite").parquet(path)
        except BaseException:
            self.files.delete(path)
            raise

    def _next_version(self, ds: str, parts: Callable[[dict], list], action: str, more: Callable[[dict], dict] = lambda m: {}) -> dict:
        """A version of these directories; directories that no version has any more go."""
        gone: list[str] = []

        def change(m: dict) -> dict:
            version, made = m["next"], parts(m)
            dropped = [v for v in m["versions"] if v > m["current"]]
            kept = [v for v in m["versions"] if v <= m["current"]] + [version]
            while len(kept) > KEEP_VERSIONS:
                dropped.append(kept.pop(1))
            paths = {k: v for k, v in m["paths"].items() if int(k) not in dropped} | {str(version): made}
            needed = {name for v in paths.values() for name, _ in v}
            gone[:] = {name for v in m["paths"].values() for name, _ in v} - needed
            schema = functools.reduce(widened, [T.StructType.fromJson(json.loads(x)) for x in dict.fromkeys(x for _, x in made)])
            columns = [{"name": f.name, "type": f.dataType.simpleString()} for f in schema]
            return m | {"current": version, "versions": kept, "next": version + 1, "paths": paths, "columns": columns, "history": [*m["history"], {"version": version, "action": action}]} | more(m)

        m = self._change(ds, change)
        for name in gone:
            self.files.delete(f"{self._dir(ds)}/{name}")
        return m

    def append(self, ds: str, df: DataFrame, action: str, batch: tuple[str, int]) -> dict:
        """A new version with the rows of one more batch of a stream, beside what is there; a batch that is in already is left out.

        Only the new rows are written. Columns whose types differ are read as the narrowest type that holds both, text in the end.
        """
        stream, number = batch
        if not stream.isalnum():
            raise InputError("bad stream id")
        m = self.meta(ds)
        if m.get("batches", {}).get(stream, -1) >= number:
            return m
        name = f"data-{stream}-{number}.parquet"  # a batch that is repeated after a failure takes the place of its first try
        self._written(df, f"{self._dir(ds)}/{name}")
        schema = self.spark.read.parquet(f"{self._dir(ds)}/{name}").schema.json()
        return self._next_version(ds, lambda m: [*m["paths"][str(m["current"])], [name, schema]], action, lambda m: {"batches": m.get("batches", {}) | {stream: number}})

    def restore(self, ds: str, version: int) -> dict:
        """Move the pointer; later versions stay until the next save."""
        m = self.meta(ds)
        if version not in m["versions"]:
            raise InputError(f"no version {version}")
        if version == m["current"]:
            return m
        columns = [{"name": n, "type": t} for n, t in self.load(ds, version).dtypes]

        def change(m: dict) -> dict:
            if version not in m["versions"]:
                raise InputError(f"no version {version}")
            return m | {"current": version, "columns": columns, "history": [*m["history"], {"version": version, "action": "restore"}]}

        return self._change(ds, change)

    def undo(self, ds: str) -> dict:
        m = self.meta(ds)
        before = [v for v in m["versions"] if v < m["current"]]
        if not before:
            raise InputError("nothing to undo")
        return self.restore(ds, before[-1])

    def reset(self, ds: str) -> dict:
        """A new version that holds version 0."""
        return self.save(ds, self.load(ds, 0), "reset")

    def versions(self, ds: str) -> dict:
        m = self.meta(ds)
        return {"current": m["current"], "snapshots": m["versions"]}

    def rename(self, ds: str, name: str) -> dict:
        if not name.strip():
            raise InputError("a name is needed")
        return self._change(ds, lambda m: m | {"name": name.strip()})

    def delete(self, ds: str) -> None:
        self.meta(ds)
        self.files.delete(self._dir(ds))
        if ds in (self._latest(f"{self.root}/dashboards")[1] or {}):
            self._commit(f"{self.root}/dashboards", lambda boards: {k: v for k, v in (boards or {}).items() if k != ds})

    def views(self, current: str | None = None) -> dict[str, DataFrame]:
        """Tables of the SQL console: ds1.. by last change, and df for the current dataset."""
        listed = self.list()
        out = {f"ds{i + 1}": self.load(m["id"]) for i, m in enumerate(listed)}
        if listed:
            out["df"] = self.load(current or listed[0]["id"])
        return out

    # projects

    def projects(self) -> list[dict]:
        return self._latest(f"{self.root}/projects")[1] or []

    def _projects(self, change: Callable[[list[dict]], list[dict]]) -> list[dict]:
        return self._commit(f"{self.root}/projects", lambda found: change(found or []))

    @staticmethod
    def _project_name(name: str, others: list[dict]) -> str:
        name = name.strip()
        if not name or any(p["name"] == name for p in others):
            raise InputError("project names are unique and not empty")
        return name

    def create_project(self, name: str) -> dict:
        p = {"id": uuid.uuid4().hex[:8], "created_at": time.time()}
        return self._projects(lambda all: [*all, p | {"name": self._project_name(name, all)}])[-1]

    def rename_project(self, project: str, name: str) -> None:
        self._projects(lambda all: [p | {"name": self._project_name(name, [q for q in all if q["id"] != project])} if p["id"] == project else p for p in all])

    def delete_project(self, project: str) -> None:
        """Its datasets stay, without a project."""
        self._projects(lambda all: [p for p in all if p["id"] != project])
        for m in self.list():
            if m.get("project") == project:
                self._change(m["id"], lambda m: m | {"project": None})

    def move(self, ds: str, project: str | None) -> dict:
        if project and all(p["id"] != project for p in self.projects()):
            raise InputError("no such project")
        return self._change(ds, lambda m: m | {"project": project})

    # dashboards

    def dashboard(self, ds: str) -> list[dict]:
        self.meta(ds)
        return (self._latest(f"{self.root}/dashboards")[1] or {}).get(ds, [])

    def save_dashboard(self, ds: str, cards: list[dict]) -> None:
        if len(cards) > MAX_CARDS:
            raise InputError(f"at most {MAX_CARDS} cards")
        wrong = [c.get("kind") for c in cards if c.get("kind") not in analyze.KINDS]
        if wrong:
            raise InputError(f"unknown analysis: {wrong[0]}")
        self.meta(ds)
        self._commit(f"{self.root}/dashboards", lambda boards: (boards or {}) | {ds: cards})

    def replay(self, ds: str) -> list[DataFrame]:
        df = self.load(ds)
        return [analyze.run(df, c["kind"], c.get("params")) for c in self.dashboard(ds)]
