"""Boxes and dirty texts derived from the plain test tables, by SQL that two engines run alike.

Doubles are written with a D behind them; ``for_duckdb`` turns that into casts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pagegrain.runtime import table

#: Boxes of twelve events a page on a grid of quarter points, with echoes, boxes off
#: the page, boxes without height, texts in tables and images as large as the page.
LAYOUT_BOXES = r"""
WITH base AS (
  SELECT event_id, CAST(floor(event_id / 12) AS BIGINT) AS page, event_id % 12 AS slot, 1 + CAST(floor(event_id / 12) AS BIGINT) % 3 AS ncol,
    CAST(floor(value * 4.0D) AS BIGINT) % 32 / 4.0D AS dx, user_id % 16 / 4.0D AS dy,
    CASE event_type WHEN 'error' THEN 'table' WHEN 'purchase' THEN 'image' ELSE 'text' END AS kind
  FROM events),
placed AS (
  SELECT event_id, page, kind, 540.0D / ncol AS cw, 60.0D * ncol AS rh,
    36.0D + (slot % ncol) * (540.0D / ncol) + dx - CASE WHEN page % 11 = 0 AND slot = 0 THEN 150.0D ELSE 0.0D END AS x0,
    36.0D + CAST(floor(slot / ncol) AS BIGINT) * (60.0D * ncol) + dy AS y0,
    CASE WHEN page % 13 = 0 THEN 1.25D ELSE 0.75D END AS fw, CASE WHEN page % 13 = 0 THEN 1.25D ELSE 0.5D END AS fh
  FROM base),
grid AS (SELECT page, event_id AS id, kind, x0, y0, x0 + cw * fw AS x1, CASE WHEN event_id % 97 = 0 THEN y0 ELSE y0 + rh * fh END AS y1 FROM placed)
SELECT page, id, kind, x0, y0, x1, y1 FROM grid
UNION ALL SELECT page, id + 1000000000 AS id, kind, x0 + 0.25D AS x0, y0, x1 + 0.25D AS x1, y1 FROM grid WHERE id % 5 = 0 AND kind <> 'text'
UNION ALL SELECT page, id + 2000000000 AS id, 'text' AS kind, x0 + 4.0D AS x0, y0 + 4.0D AS y0, x1 - 4.0D AS x1, y1 - 4.0D AS y1 FROM grid WHERE kind = 'table' AND id % 7 = 0 AND id % 97 <> 0
UNION ALL SELECT page, 3000000000 + page AS id, 'image' AS kind, 0.0D AS x0, 0.0D AS y0, 612.0D AS x1, 792.0D AS y1 FROM grid WHERE id % 12 = 0 AND page % 10 = 0
"""

#: Documents with mixed line ends, NULs, blanks at line ends and empty lines put in.
DIRTY_TEXT = r"""
SELECT doc_id, concat(chr(10), chr(10), '  ', replace(replace(text, '. ',
  concat('. ', chr(160), chr(9), chr(13), chr(10), ' ', chr(13), chr(10), chr(13), chr(13), '  ')),
  ', ', concat(',', chr(0), ' ')), chr(31), chr(10), chr(0), chr(10)) AS text
FROM documents WHERE text IS NOT NULL
"""


def for_duckdb(sql: str) -> str:
    return re.sub(r"(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", sql)


def layout_boxes(spark: SparkSession, root: str) -> DataFrame:
    """``page, id, kind, x0, y0, x1, y1``; pages are 612 by 792."""
    return spark.sql(LAYOUT_BOXES.replace("FROM events", "FROM {events}"), events=table(spark, root, "events"))


def dirty_text(spark: SparkSession, root: str) -> DataFrame:
    return spark.sql(DIRTY_TEXT.replace("FROM documents", "FROM {documents}"), documents=table(spark, root, "documents"))
