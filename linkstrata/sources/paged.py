"""A paginated source as a Python data source (S17, S18, F31): pages follow a cursor, so a stream resumes where it ended.

The transport is a function from cursor to (records, next cursor), named by 'module:function'; tests give a local one, since
this library opens no connection of its own.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def _fetch(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PagedSource(DataSource):
    """Options: ``fetch`` ('module:function'), ``schema`` by .schema(), ``pages`` (most pages a micro-batch, default 10),
    ``retries`` (of a page that fails, default 3) and ``pause`` (seconds between pages, doubled with each retry, default 0)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "title string, description string"

    def reader(self, schema):
        return _Batch(schema, self.options)

    def simpleStreamReader(self, schema):
        return _Stream(schema, self.options)


def _field(record, path: str):
    """A field, or one inside nested objects by a path with dots; None where any step is missing."""
    if path in record:
        return record[path]
    for step in path.split("."):
        record = record.get(step) if isinstance(record, dict) else None
    return record


def _rows(records, names):
    return [tuple(_field(r, n) for n in names) for r in records]


def _patient(fetch, retries: int, pause: float):
    """``fetch`` that waits between pages and tries a failed one again."""

    def page(cursor):
        for left in range(retries, -1, -1):
            try:
                if pause:
                    time.sleep(pause * 2 ** (retries - left))
                return fetch(cursor)
            except Exception:
                if not left:
                    raise

    return page


def _options(options):
    return {"retries": int(options.get("retries", "3")), "pause": float(options.get("pause", "0"))}


def looked_up(rows: DataFrame, key: str, fetch: Callable[[list], dict], schema: str, size: int = 50, clip: int = 300) -> DataFrame:
    """(key, fields): what ``fetch`` knows of each key, asked for ``size`` different ones at a time; texts are clipped to ``clip`` characters.

    ``fetch`` maps a list of keys to {key: {field: value}}; keys it does not know have nulls, null keys aren't asked.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def ask(batches):
        for b in batches:
            keys = b[key].tolist()
            known: dict = {}
            for at in range(0, len(keys), size):
                known |= fetch(keys[at : at + size])
            cut = lambda v: v[:clip] if isinstance(v, str) else v
            yield pd.DataFrame([(k, *(cut(known.get(k, {}).get(n)) for n in names)) for k in keys], columns=[key, *names])

    return rows.filter(F.col(key).isNotNull()).select(key).distinct().mapInPandas(ask, f"{key} {dict(rows.dtypes)[key]}, {schema}")


class _Batch(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.fetch, self.how = schema.fieldNames(), options["fetch"], _options(options)

    def partitions(self):
        return [InputPartition(0)]  # a cursor is a chain: each page names the next

    def read(self, partition):
        fetch, cursor = _patient(_fetch(self.fetch), **self.how), None
        while True:
            records, cursor = fetch(cursor)
            yield from _rows(records, self.names)
            if cursor is None:
                return


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, schema, options):
        self.names, self.fetch, self.pages, self.how = schema.fieldNames(), options["fetch"], int(options.get("pages", "10")), _options(options)

    def initialOffset(self):
        return {"cursor": None, "done": False}

    def read(self, start):
        fetch, at, rows = _patient(_fetch(self.fetch), **self.how), dict(start), []
        for _ in range(self.pages):
            if at["done"]:
                break
            records, cursor = fetch(at["cursor"])
            rows += _rows(records, self.names)
            at = {"cursor": cursor, "done": cursor is None}
        return iter(rows), at

    def readBetweenOffsets(self, start, end):
        fetch, at = _patient(_fetch(self.fetch), **self.how), dict(start)
        while at != end and not at["done"]:
            records, cursor = fetch(at["cursor"])
            yield from _rows(records, self.names)
            at = {"cursor": cursor, "done": cursor is None}

    def commit(self, end):
        pass
