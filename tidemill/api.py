"""The engine's front door: a workspace of datasets, each with everything that can be done to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .errors import InputError
from .operators import analyze, clean, health
from .plans import console, usercode
from .plans.store import Store
from .plans.tools import Tools, table
from .sources import readers, sample, writers
from .streaming.ingest import Follower


class Dataset:
    """A stored table by id. What changes it makes a new version; what looks at it gives a DataFrame or plain values."""

    def __init__(self, workspace: Workspace, ds: str):
        self.workspace, self.id = workspace, ds
        workspace.store.meta(ds)

    @property
    def meta(self) -> dict:
        return self.workspace.store.meta(self.id)

    @property
    def df(self) -> DataFrame:
        return self.workspace.store.load(self.id)

    # looking

    def rows(self, page: int = 1, page_size: int = 50, sort: str | None = None, order: str = "asc", filters: dict | None = None, order_by=()) -> dict:
        rows, total, before = analyze.page(self.df, page, page_size, sort, order, filters, order_by)
        return {"total": total, "unfiltered_total": before, "page": page, "page_size": page_size} | table(rows, page_size)

    def profile(self) -> DataFrame:
        return analyze.profile(self.df)

    def insights(self) -> dict:
        return health.health_check(self.df)

    def analyze(self, kind: str, params: dict | None = None) -> DataFrame:
        return analyze.run(self.df, kind, params)

    def corr(self, columns=None, method: str = "pearson") -> DataFrame:
        return analyze.corr(self.df, columns, method)

    def missing_matrix(self, order_by, buckets: int = 40) -> DataFrame:
        return analyze.missing_matrix(self.df, order_by, buckets)

    def duplicates(self) -> dict:
        return analyze.duplicates(self.df).first().asDict() | table(analyze.duplicate_rows(self.df))

    def interactions(self, x: str, y: str, order_by, max_points: int = 1000) -> dict:
        return analyze.interactions(self.df, x, y, order_by, max_points)

    def cross_heat(self, row: str, col: str) -> DataFrame:
        return analyze.crosstab(self.df, row, col)

    def chart_suggest(self) -> list[dict]:
        return analyze.suggest_charts(self.df)

    # changing

    def _save(self, df: DataFrame, action: str) -> Dataset:
        self.workspace.store.save(self.id, df, action)
        return self

    def clean(self, op: str, params: dict | None = None) -> str:
        out, message = clean.apply_op(self.df, op, params)
        self._save(out, message)
        return message

    def transform(self, code: str, preview: bool = False, seconds: float = usercode.SECONDS) -> DataFrame:
        """User code in Python; a preview leaves the dataset as it is. ``seconds`` is the time for the code and for writing its result."""
        if preview:
            return usercode.preview(self.df, code, seconds)
        return usercode.apply_code(self.df, code, lambda out: self._save(out, "transform"), seconds).df

    def undo(self) -> dict:
        return self.workspace.store.undo(self.id)

    def restore(self, version: int) -> dict:
        return self.workspace.store.restore(self.id, version)

    def reset(self) -> dict:
        return self.workspace.store.reset(self.id)

    def versions(self) -> dict:
        return self.workspace.store.versions(self.id)

    def rename(self, name: str) -> dict:
        return self.workspace.store.rename(self.id, name)

    def move(self, project: str | None) -> dict:
        return self.workspace.store.move(self.id, project)

    def delete(self) -> None:
        self.workspace.store.delete(self.id)

    # deriving and leaving

    def sample(self, method: str = "random", n: int = 100, by: str | None = None, seed: int = 42, order_by=None) -> Dataset:
        made = analyze.sample(self.df, method, n, by, seed, order_by)
        return self.workspace.add(made, f"{self.meta['name']}-{method}", parent=self.id)

    def import_sheet(self, sheet: str) -> Dataset:
        return Dataset(self.workspace, self.workspace.store.import_sheet(self.id, sheet)["id"])

    def export(self, path: str, kind: str = "csv") -> str:
        if kind not in ("csv", "xlsx"):
            raise InputError("exports are csv or xlsx")
        (writers.write_csv if kind == "csv" else writers.write_xlsx)(self.df, path)
        return path

    def dashboard(self) -> list[dict]:
        return self.workspace.store.dashboard(self.id)

    def pin(self, cards: list[dict]) -> None:
        self.workspace.store.save_dashboard(self.id, cards)

    def replay(self) -> list[DataFrame]:
        return self.workspace.store.replay(self.id)


class Workspace:
    """Datasets, projects and the SQL console below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.tools = Tools(self.store)

    def add(self, df: DataFrame, name: str, project: str | None = None, parent: str | None = None, original: str | None = None) -> Dataset:
        return Dataset(self, self.store.create(df, name, project, parent, original)["id"])

    def upload(self, path: str, name: str | None = None, project: str | None = None, sheet: str | int = 0) -> Dataset:
        """A file by its kind: delimited text, JSON, a workbook, Parquet."""
        kind = path.rsplit(".", 1)[-1].lower()
        name = name or path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if kind in ("csv", "txt"):
            return Dataset(self, self.store.ingest_csv(path, name, project)["id"])
        if kind == "json":
            df = readers.read_json(self.spark, path)
        elif kind == "xlsx":
            df = readers.read_xlsx(self.spark, path, sheet)
        elif kind == "parquet":
            df = readers.read_parquet(self.spark, path)
        else:
            raise InputError(f"files of kind {kind!r} can't be read: CSV, TXT, JSON, XLSX or Parquet")
        if df.isEmpty():
            raise InputError("the file has no rows")
        return self.add(df, name, project, original=path if kind == "xlsx" else None)

    def paste(self, text: str, name: str = "pasted", project: str | None = None) -> Dataset:
        return self.add(readers.read_paste(self.spark, text), name, project)

    def make_sample(self, project: str | None = None) -> Dataset:
        return self.add(sample.make_sample(self.spark), "sample", project)

    def follow(self, folder: str, ds: str, checkpoint: str) -> Dataset:
        """New delimited files of a folder as further rows of a dataset, each file once."""
        Follower(self.store, folder, ds).start(checkpoint).awaitTermination()
        return Dataset(self, ds)

    def datasets(self, project: str | None = None) -> list[dict]:
        return [m for m in self.store.list() if project is None or m.get("project") == project]

    def dataset(self, ds: str) -> Dataset:
        return Dataset(self, ds)

    def sql_tables(self) -> list[dict]:
        return [{"alias": f"ds{i + 1}", "id": m["id"], "name": m["name"], "columns": m["columns"]} for i, m in enumerate(self.store.list())]

    def sql(self, query: str, current: str | None = None, save_as: str | None = None) -> DataFrame | Dataset:
        if save_as:
            return Dataset(self, console.save_as(self.store, query, save_as, current)["id"])
        return console.run_sql(self.spark, query, self.store.views(current))
