"""Named tools over stored datasets: each has a JSON schema of its parameters and a bounded, JSON-safe result."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import InputError
from ..operators import analyze, health
from ..sources.writers import json_cell
from . import console
from .store import Store

#: Rows of a tool's result, rows of a card, characters of a text.
MAX_ROWS, CARD_ROWS, TEXT_CHARS = 200, 500, 3500


def _object(required=(), **properties) -> dict:
    return {"type": "object", "properties": properties, "required": list(required)}


_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}
_NAMES = {"type": "array", "items": _TEXT}
_METRICS = {"type": "array", "items": _object(("column", "agg"), column=_TEXT, agg={"type": "string", "enum": list(analyze.AGGS)})}
_FREQ = {"type": "string", "enum": ["D", "W", "M", "Q", "Y"]}
_METHOD = {"type": "string", "enum": ["pearson", "spearman", "kendall"]}


def table(df: DataFrame, most: int = MAX_ROWS) -> dict:
    """Columns and at most ``most`` rows of a result, and whether there are more."""
    rows = df.limit(most + 1).collect()
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    return {"columns": [{"name": c, "numeric": c in numeric} for c in df.columns], "rows": [[json_cell(v) for v in r] for r in rows[:most]], "truncated": len(rows) > most}


class Tools:
    """The tools of one store. ``schemas`` describes them, ``run`` runs one by name."""

    def __init__(self, store: Store):
        self.store = store
        dataset = {"dataset_id": _TEXT}
        self._tools: dict[str, tuple[str, dict, Callable]] = {
            "list_datasets": ("All datasets: id, name, columns.", _object(), self._list),
            "column_profile": ("Kind, missing share, distinct values, statistics and frequent values of every column.", _object(("dataset_id",), **dataset), self._profile),
            "read_rows": ("A page of a dataset's rows.", _object(("dataset_id",), **dataset, page=_WHOLE, page_size=_WHOLE), self._rows),
            "sql_query": ("A read-only query (SELECT or WITH) over ds1, ds2 and so on by last change, and df, the dataset named.", _object(("query",), query=_TEXT, **dataset), self._sql),
            "health_check": ("Quality score and findings with level, column, evidence and fix.", _object(("dataset_id",), **dataset), self._health),
            "describe": ("Count, mean, deviation and quantiles by column.", _object(("dataset_id",), **dataset), self._analysis("describe")),
            "groupby": ("Metrics by group.", _object(("dataset_id", "by", "metrics"), **dataset, by=_NAMES, metrics=_METRICS, top=_WHOLE), self._analysis("groupby", top=20)),
            "correlation": ("Correlation matrix of numeric columns.", _object(("dataset_id",), **dataset, columns=_NAMES, method=_METHOD), self._analysis("corr")),
            "histogram": ("Distribution of a numeric column.", _object(("dataset_id", "column"), **dataset, column=_TEXT, bins=_WHOLE), self._analysis("histogram")),
            "value_counts": ("The most frequent values of a column.", _object(("dataset_id", "column"), **dataset, column=_TEXT, top=_WHOLE), self._analysis("value_counts", top=15)),
            "trend": ("A value over time by day, week, month, quarter or year.", _object(("dataset_id", "date_column", "value_column"), **dataset, date_column=_TEXT, value_column=_TEXT, freq=_FREQ), self._analysis("trend")),
        }

    def schemas(self) -> list[dict]:
        return [{"name": name, "description": text, "parameters": schema} for name, (text, schema, _) in self._tools.items()]

    def run(self, name: str, params: dict | None = None) -> dict:
        """The tool's result as plain values; unknown and missing parameters are errors."""
        if name not in self._tools:
            raise InputError(f"unknown tool: {name}")
        _, schema, call = self._tools[name]
        params = dict(params or {})
        unknown, absent = set(params) - set(schema["properties"]), set(schema["required"]) - set(params)
        if unknown or absent:
            raise InputError(f"parameters {'unknown' if unknown else 'missing'}: {', '.join(sorted(unknown or absent))}")
        return call(**params)

    def brief(self, name: str, params: dict | None = None) -> str:
        """A tool's result as JSON text of at most TEXT_CHARS characters."""
        text = json.dumps(self.run(name, params), ensure_ascii=False, default=str)
        return text if len(text) <= TEXT_CHARS else f"{text[: TEXT_CHARS - 1]}…"

    def card(self, dataset_id: str, spec: dict) -> dict:
        """A chart or table from a spec (``kind``, ``params``, ``title``), with at most CARD_ROWS rows."""
        return {"title": spec.get("title") or spec["kind"], "kind": spec["kind"]} | table(analyze.run(self.store.load(dataset_id), spec["kind"], spec.get("params")), CARD_ROWS)

    def _list(self) -> dict:
        return {"datasets": [{"dataset_id": m["id"], "name": m["name"], "columns": [c["name"] for c in m["columns"]]} for m in self.store.list()]}

    def _profile(self, dataset_id: str) -> dict:
        return table(analyze.profile(self.store.load(dataset_id)))

    def _rows(self, dataset_id: str, page: int = 1, page_size: int = 20) -> dict:
        page, page_size = max(1, int(page)), max(1, min(int(page_size), MAX_ROWS))
        rows, total, _ = analyze.page(self.store.load(dataset_id), page, page_size)
        return {"total": total, "page": page, "page_size": page_size} | table(rows)

    def _sql(self, query: str, dataset_id: str | None = None) -> dict:
        return table(console.run_sql(self.store.spark, query, self.store.views(dataset_id)))

    def _health(self, dataset_id: str) -> dict:
        return health.health_check(self.store.load(dataset_id))

    def _analysis(self, kind: str, **defaults) -> Callable:
        def run(dataset_id: str, **params) -> dict:
            params = {**defaults, **params}
            if "top" in params:
                params["top"] = max(1, min(int(params["top"]), MAX_ROWS))
            return table(analyze.run(self.store.load(dataset_id), kind, params))

        return run
