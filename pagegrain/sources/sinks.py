"""Sinks for chunk tables, JSON and drawings."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, mode: str = "error") -> None:
    """The chunk table as Parquet. Rows of one page stay together where they were, so nothing is shuffled."""
    chunks.write.mode(mode).option("compression", "zstd").parquet(path)


def write_json(jsons: DataFrame, path: str, mode: str = "error") -> None:
    """One line of JSON for each page or document part."""
    jsons.select(F.col("json").alias("value")).write.mode(mode).text(path)


def write_json_file(json_rows: DataFrame, path: str, indent: int | None = 2) -> str:
    """The one row of ``json_rows``, such as a page's, as an indented file on the driver; gives the path.

    Folders on the way are made. None or several rows raise ValueError: many pages
    are for ``write_json``.
    """
    rows = json_rows.select("json").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a JSON file takes exactly one row")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(rows[0].json), f, indent=indent, ensure_ascii=False)
    return path


def write_drawings(drawings: DataFrame, path: str, mode: str = "error") -> None:
    """Drawings as Parquet with one file's text in each row; for many pages single files would burden the file system."""
    drawings.write.mode(mode).parquet(path)


def write_drawing_file(drawings: DataFrame, path: str) -> str:
    """The one drawing of ``drawings`` (``svg`` or ``png``) as a file on the driver; gives the path."""
    kind = "png" if "png" in drawings.columns else "svg"
    rows = drawings.select(kind).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a file takes exactly one drawing")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(rows[0][0] if kind == "png" else rows[0][0].encode())
    return path
