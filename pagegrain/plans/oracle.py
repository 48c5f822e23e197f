"""SQL against which the queries of the core are held; it runs in DuckDB on the same tables."""

from __future__ import annotations

from pagegrain.plans.fixtures import DIRTY_TEXT, LAYOUT_BOXES, for_duckdb

_BLANKS = r"[\t\x0B\f\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def w(b: str) -> str:
    return f"greatest(0::DOUBLE, {b}.x1 - {b}.x0)"


def h(b: str) -> str:
    return f"greatest(0::DOUBLE, {b}.y1 - {b}.y0)"


def area(b: str) -> str:
    return f"({w(b)} * {h(b)})"


def meet(a: str, b: str) -> str:
    return f"({a}.x1 > {b}.x0 AND {a}.x0 < {b}.x1 AND {a}.y1 > {b}.y0 AND {a}.y0 < {b}.y1)"


def common(a: str, b: str) -> str:
    return f"(CASE WHEN {meet(a, b)} THEN greatest(0::DOUBLE, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0::DOUBLE, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) ELSE 0::DOUBLE END)"


def overlap(a: str, b: str) -> str:
    return f"(CASE WHEN {area(a)} > 0 THEN {common(a, b)} / {area(a)} ELSE 0::DOUBLE END)"


def iou(a: str, b: str) -> str:
    total = f"({area(a)} + {area(b)} - {common(a, b)})"
    return f"(CASE WHEN {total} > 0 THEN {common(a, b)} / {total} ELSE 0::DOUBLE END)"


def coarse(b: str, width: str, height: str) -> str:
    x, y = f"(({b}.x0 + {b}.x1) / 2)", f"(({b}.y0 + {b}.y1) / 2)"
    return (
        f"(CASE WHEN {y} < {height} * 0.33::DOUBLE THEN 'TOP' WHEN {y} < {height} * 0.66::DOUBLE THEN 'MIDDLE' ELSE 'BOTTOM' END || '_' || "
        f"CASE WHEN {x} < {width} * 0.33::DOUBLE THEN 'LEFT' WHEN {x} < {width} * 0.66::DOUBLE THEN 'CENTER' ELSE 'RIGHT' END)"
    )


def normal(text: str) -> str:
    lines = f"replace(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), '')"
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({lines}, '{_BLANKS}(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A\n+', ''), '\n+\z', '')"


BOXES = f"boxes AS MATERIALIZED ({for_duckdb(LAYOUT_BOXES)})"
#: Pairs of a page's tables and texts that intersect.
PAIRS = f"{BOXES}, pairs AS (SELECT a.page, a.id AS id_a, b.id AS id_b, a, b FROM boxes a JOIN boxes b ON a.page = b.page AND a.kind = 'table' AND b.kind = 'text' AND {meet('a', 'b')})"
IMAGE_PAIRS = f"{BOXES}, pairs AS (SELECT a.page, a.id AS id_a, b.id AS id_b, a, b FROM boxes a JOIN boxes b ON a.page = b.page AND a.kind = 'image' AND b.kind = 'image' AND a.id < b.id AND {meet('a', 'b')})"

PAGES = "pages AS MATERIALIZED (SELECT doc_id, page_number, rect, blocks, tables, rect.x1 - rect.x0 AS width, rect.y1 - rect.y0 AS height FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ingested_at) AS n FROM raw_pages) WHERE n = 1)"
BLOCKS = f"{PAGES}, blocks AS MATERIALIZED (SELECT doc_id, page_number, rect, width, height, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS no FROM pages)"
_SPAN = "coalesce(s.text, coalesce(array_to_string(list_transform(coalesce(s.chars, []), lambda c: c.c), ''), ''))"
_LINE = f"coalesce(array_to_string(list_transform(coalesce(l.spans, []), lambda s: {_SPAN}), ''), '')"
_RAW = f"coalesce(array_to_string(list_transform(coalesce(b.lines, []), lambda l: {_LINE}), chr(10)), '')"
TEXT_BLOCKS = f"""{BLOCKS}, raw_texts AS (SELECT doc_id, page_number, width, height, no, b, {_RAW} AS content_raw, len(coalesce(b.lines, [])) AS line_count,
  coalesce(list_sum(list_transform(coalesce(b.lines, []), lambda l: len(coalesce(l.spans, [])))), 0)::INTEGER AS span_count FROM blocks WHERE b.type = 0 AND b.bbox IS NOT NULL),
text_blocks AS MATERIALIZED (SELECT *, {normal('content_raw')} AS content FROM raw_texts)"""
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

#: Lines of blocks with their spans by left side, then the runs between wide gaps.
TAGGED = f"""{BLOCKS}, ls AS (SELECT doc_id, page_number, width, height, no, unnest(b.lines) AS l, generate_subscripts(b.lines, 1) AS line_no FROM blocks WHERE b.type = 0 AND b.bbox IS NOT NULL),
sp AS (SELECT doc_id, page_number, width, height, no, line_no, unnest(l.spans) AS s, generate_subscripts(l.spans, 1) AS i FROM ls),
kept AS (SELECT doc_id, page_number, width, height, no, line_no, i, s.bbox AS b, {_SPAN} AS t FROM sp WHERE s.bbox IS NOT NULL AND {_SPAN} <> ''),
gaps AS (SELECT *, b.x0 - lag(b.x1) OVER (PARTITION BY doc_id, page_number, no, line_no ORDER BY b.x0, i) AS gap,
  greatest(18::DOUBLE, avg({h('b')}) OVER (PARTITION BY doc_id, page_number, no, line_no) * 1.8::DOUBLE) AS wide FROM kept),
runs AS (SELECT *, sum(CASE WHEN gap > wide THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number, no, line_no ORDER BY b.x0, i ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
segs AS (SELECT doc_id, page_number, no, line_no, run, any_value(width) AS width, any_value(height) AS height, string_agg(t, '' ORDER BY b.x0, i) AS t,
  {{'x0': min(b.x0), 'y0': min(b.y0), 'x1': max(b.x1), 'y1': max(b.y1)}} AS b FROM runs GROUP BY doc_id, page_number, no, line_no, run),
tags AS (SELECT *, {coarse('b', 'width', 'height')} AS tag FROM segs),
lined AS (SELECT doc_id, page_number, no, line_no, '<LINE>' || string_agg('<' || tag || '>' || {_ESCAPED.format('t')} || '</' || tag || '>', '' ORDER BY run) || '</LINE>' AS line FROM tags GROUP BY doc_id, page_number, no, line_no),
tagged AS MATERIALIZED (SELECT doc_id, page_number, no, '<TEXT>' || coalesce(string_agg(line, '' ORDER BY line_no), '') || '</TEXT>' AS content_tagged
  FROM (SELECT doc_id, page_number, no FROM blocks WHERE b.type = 0 AND b.bbox IS NOT NULL) LEFT JOIN lined USING (doc_id, page_number, no) GROUP BY doc_id, page_number, no)"""


def fold(items: str, same: str) -> str:
    """Those of a list of one-element lists that aren't ``same`` (of ``k`` and ``y[1]``) as one kept before."""
    return f"(CASE WHEN len({items}) = 0 THEN [] ELSE list_reduce({items}, lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: {same})) > 0 THEN acc ELSE list_concat(acc, y) END) END)"


PADDED = f"{PAGES}, found AS (SELECT doc_id, page_number, unnest(tables) AS x, generate_subscripts(tables, 1) - 1 AS no FROM pages), padded AS (SELECT doc_id, page_number, no, x.png AS png, {{'x0': greatest(0::DOUBLE, x.bbox.x0 - 2), 'y0': greatest(0::DOUBLE, x.bbox.y0 - 2), 'x1': x.bbox.x1 + 2, 'y1': x.bbox.y1 + 2}} AS b FROM found WHERE x.bbox IS NOT NULL)"
TABLES = f"""{PADDED}, table_lists AS (SELECT doc_id, page_number, list([{{'k': -{area('b')}, 'no': no, 'b': b, 'png': png}}] ORDER BY -{area('b')}, no) AS l FROM padded GROUP BY doc_id, page_number),
tables AS MATERIALIZED (SELECT doc_id, page_number, u.k AS k, u.no AS no, u.b AS b, CASE WHEN octet_length(u.png) > 0 THEN base64(u.png) END AS content FROM (SELECT doc_id, page_number, unnest({fold('l', iou('y[1].b', 'k.b') + ' >= 0.90::DOUBLE')}) AS u FROM table_lists))"""

_EDGE = " AND ".join(f"abs(i.b.bbox.{s} - i.rect.{s}) <= 3" for s in ("x0", "y0", "x1", "y1"))
COVERED = f"""covered AS MATERIALIZED (SELECT i.doc_id, i.page_number, i.no, any_value(i.b) AS b, any_value({area('i.b.bbox')} / greatest(1::DOUBLE, i.width * i.height)) AS ratio, bool_or({_EDGE}) AS near_full,
  CASE WHEN any_value({area('i.b.bbox')}) > 0 THEN coalesce(sum({common('i.b.bbox', 'x.b.bbox')}), 0) / any_value({area('i.b.bbox')}) ELSE 0::DOUBLE END AS coverage
  FROM blocks i LEFT JOIN blocks x ON i.doc_id = x.doc_id AND i.page_number = x.page_number AND x.b.type = 0 AND x.b.bbox IS NOT NULL WHERE i.b.type = 1 AND i.b.bbox IS NOT NULL GROUP BY i.doc_id, i.page_number, i.no)"""
BACKGROUND = "(ratio >= 0.90::DOUBLE OR near_full OR (ratio >= 0.65::DOUBLE AND coverage >= 0.55::DOUBLE))"


def images(payload: bool) -> str:
    content = "CASE WHEN octet_length(b.image) > 0 THEN base64(b.image) END" if payload else "NULL::VARCHAR"
    ext = "lower(CASE WHEN length(b.ext) > 0 THEN b.ext ELSE 'png' END)"
    sign = "ext || '|' || coalesce(pw, -1) || '|' || coalesce(ph, -1) || '|' || CASE WHEN length(content) > 0 THEN substr(sha1(substr(content, 1, 2048)), 1, 12) ELSE '' END"
    same = f"k.sig = y[1].sig AND ({iou('y[1].b', 'k.b')} >= 0.92::DOUBLE OR {overlap('y[1].b', 'k.b')} >= 0.98::DOUBLE OR {overlap('k.b', 'y[1].b')} >= 0.98::DOUBLE)"
    return f"""{COVERED}, loaded AS (SELECT doc_id, page_number, no, b.bbox AS bb, {ext} AS ext, b.width AS pw, b.height AS ph, {content} AS content FROM covered WHERE NOT {BACKGROUND}),
signed AS MATERIALIZED (SELECT *, {sign} AS sig, CASE WHEN content IS NULL THEN 1 ELSE 0 END AS bare FROM loaded),
image_lists AS (SELECT doc_id, page_number, list([{{'k': -{area('bb')}, 'bare': bare, 'no': no, 'b': bb, 'ext': ext, 'pw': pw, 'ph': ph, 'content': content, 'sig': sig}}] ORDER BY -{area('bb')}, bare, no) AS l FROM signed GROUP BY doc_id, page_number),
images AS MATERIALIZED (SELECT doc_id, page_number, u.* FROM (SELECT doc_id, page_number, unnest({fold('l', same)}) AS u FROM image_lists))"""


OUTSIDE = f"outside AS (SELECT t.* FROM text_blocks t WHERE t.content <> '' AND NOT EXISTS (SELECT 1 FROM tables x WHERE x.doc_id = t.doc_id AND x.page_number = t.page_number AND {overlap('t.b.bbox', 'x.b')} >= 0.60::DOUBLE))"


def atoms(payload: bool) -> str:
    """CTEs up to ``atoms``, in reading order."""
    table_content = "content" if payload else "NULL::VARCHAR"
    parts = TAGGED + ", " + TEXT_BLOCKS.removeprefix(BLOCKS + ", ") + ", " + TABLES.removeprefix(PAGES + ", ") + ", " + images(payload) + ", " + OUTSIDE
    return f"""{parts}, united AS (
SELECT doc_id, page_number, 0 AS rank, 0::DOUBLE AS k1, 0 AS k2, no AS k3, 'text' AS type, o.b.bbox AS b, content, content_raw, content_tagged, NULL::VARCHAR AS mime_type, line_count, span_count, length(content_raw) AS char_count_raw, length(content) AS char_count_clean,
  0 AS source_block_type, NULL::VARCHAR AS source_ext, NULL::INTEGER AS pixel_width, NULL::INTEGER AS pixel_height FROM outside o JOIN tagged USING (doc_id, page_number, no)
UNION ALL SELECT doc_id, page_number, 1, k, bare, no, 'image', b, content, NULL, NULL, CASE WHEN content IS NOT NULL THEN 'image/' || ext END, 0, 0, 0, 0, 1, ext, pw, ph FROM images
UNION ALL SELECT doc_id, page_number, 2, k, 0, no, 'table', b, {table_content}, NULL, NULL, CASE WHEN {table_content} IS NOT NULL THEN 'image/png' END, 0, 0, 0, 0, NULL, 'png', NULL, NULL FROM tables),
atoms AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY b.y0, b.x0, rank, k1, k2, k3) - 1)::INTEGER AS atom_no FROM united)"""


_SIDES = "b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1"
_ATOM = f"doc_id, page_number, atom_no, type, {_SIDES}, content, content_raw, content_tagged, mime_type, line_count::INTEGER AS line_count, span_count, char_count_raw::INTEGER AS char_count_raw, char_count_clean::INTEGER AS char_count_clean, coalesce(source_block_type, -1) AS source_block_type, source_ext, coalesce(pixel_width, -1) AS pixel_width, coalesce(pixel_height, -1) AS pixel_height"


def tree(source: str, key: str) -> str:
    """Recursive cuts of ``source`` (key columns, ``a``: boxes with ``no`` in reading order, ``r``: the page's rect) down to ``tree``.

    Each step's values are unnested from a list of one, so that the engine keeps
    them apart and doesn't put the expressions into one another.
    """

    def free(iv: str, lo: str, hi: str) -> str:
        inner = f"list_transform({iv}, lambda v: {{'s': greatest({lo}, coalesce(list_max(list_transform(list_filter({iv}, lambda u: u.s < v.s), lambda u: u.e)), {lo})), 'e': v.s}})"
        return f"list_filter(list_concat({inner}, CASE WHEN len({iv}) > 0 THEN [{{'s': list_max(list_transform({iv}, lambda u: u.e)), 'e': {hi}}}] ELSE [] END), lambda v: v.e > v.s)"

    def judged(gaps: str, lo: str, hi: str, side: str, axis: int, least: str) -> str:
        extent = f"({hi} - {lo})"
        wide = f"list_filter({gaps}, lambda v: {extent} > 0 AND (v.e - v.s) / {extent} >= {least}::DOUBLE)"
        counted = f"list_transform({wide}, lambda v: {{'s': v.s, 'e': v.e, 'f': len(list_filter(a, lambda x: (x.{side}0 + x.{side}1) / 2 <= (v.s + v.e) / 2))}})"
        both = f"list_filter({counted}, lambda v: v.f > 0 AND v.f < len(a))"
        return f"list_transform({both}, lambda v: {{'k': -((v.e - v.s) / {extent} * 0.7::DOUBLE + least(v.f, len(a) - v.f)::DOUBLE / greatest(v.f, len(a) - v.f)::DOUBLE * 0.3::DOUBLE), 'ax': {axis}, 's': v.s, 'e': v.e}})"

    def interval(side: str) -> str:
        return f"list_filter(list_transform(a, lambda x: {{'s': greatest(r.{side}0, x.{side}0), 'e': least(r.{side}1, x.{side}1)}}), lambda v: v.e > v.s)"

    def held(region: str) -> str:
        return f"list_filter(a, lambda x: {common('x', region)} / greatest({area('x')}, 1e-6::DOUBLE) >= 0.80::DOUBLE)"

    before = "{'x0': r.x0, 'y0': r.y0, 'x1': CASE WHEN c.ax = 0 THEN c.s ELSE r.x1 END, 'y1': CASE WHEN c.ax = 1 THEN c.s ELSE r.y1 END}"
    behind = "{'x0': CASE WHEN c.ax = 0 THEN c.e ELSE r.x0 END, 'y0': CASE WHEN c.ax = 1 THEN c.e ELSE r.y0 END, 'x1': r.x1, 'y1': r.y1}"
    enough = "(CASE WHEN c.ax = 0 THEN c.s - r.x0 > 1 AND r.x1 - c.e > 1 ELSE c.s - r.y0 > 1 AND r.y1 - c.e > 1 END)"
    return f"""tree AS (
SELECT {key}, '0000' AS path, 0 AS depth, r, a, NULL::VARCHAR AS above, 1 AS siblings, 0 AS ordinal, false AS fell FROM {source}
UNION ALL
SELECT {key}, path || '.' || lpad((u.k)::VARCHAR, 4, '0'), depth + 1, u.r, u.a, layout, n, u.k, fell FROM (
 SELECT {key}, path, depth, layout, fell, len(kids) AS n, unnest(kids) AS u FROM (
  SELECT {key}, path, depth, NOT cut AS fell, CASE WHEN cut AND c.ax = 0 THEN 'horizontal' ELSE 'vertical' END AS layout,
    CASE WHEN cut THEN [{{'k': 0, 'r': p, 'a': ap}}, {{'k': 1, 'r': q, 'a': aq}}] ELSE list_transform(a, lambda x, i: {{'k': (i - 1)::INTEGER, 'r': r, 'a': [x]}}) END AS kids FROM (
   SELECT *, c IS NOT NULL AND depth <= 12 AND coalesce({enough}, false) AND len(ap) > 0 AND len(aq) > 0 AS cut FROM (
    SELECT *, unnest([{held('p')}]) AS ap, unnest([{held('q')}]) AS aq FROM (
     SELECT *, unnest([{before}]) AS p, unnest([{behind}]) AS q FROM (
      SELECT *, unnest([list_sort(list_concat({judged('gx', 'r.x0', 'r.x1', 'x', 0, '0.04')}, {judged('gy', 'r.y0', 'r.y1', 'y', 1, '0.03')}))[1]]) AS c FROM (
       SELECT *, unnest([{free('ix', 'r.x0', 'r.x1')}]) AS gx, unnest([{free('iy', 'r.y0', 'r.y1')}]) AS gy FROM (
        SELECT *, unnest([{interval('x')}]) AS ix, unnest([{interval('y')}]) AS iy FROM tree WHERE len(a) > 1))))))))),
nodes AS MATERIALIZED (SELECT {key}, t.path, left(t.path, greatest(len(t.path) - 5, 0)) AS parent_path, depth, ordinal, siblings, above, fell, k.layout, CASE WHEN len(a) = 1 THEN a[1].no END AS no, a
  FROM tree t LEFT JOIN (SELECT {key}, left(path, len(path) - 5) AS path, min(above) AS layout FROM tree WHERE depth > 0 GROUP BY ALL) k USING ({key}, path)),
ancestors AS (SELECT {key}, unnest(list_transform(range(0, depth + 1), lambda d: left(path, 4 + 5 * d))) AS path, a[1] AS x FROM nodes WHERE no IS NOT NULL),
hulls AS MATERIALIZED (SELECT {key}, path, {{'x0': min(x.x0), 'y0': min(x.y0), 'x1': max(x.x1), 'y1': max(x.y1)}} AS b FROM ancestors GROUP BY {key}, path)"""


def relative(above: str, ordinal: str, siblings: str) -> str:
    return (
        f"CASE WHEN {above} = 'horizontal' THEN CASE WHEN {siblings} <= 1 THEN 'CENTER' WHEN {ordinal} = 0 THEN 'LEFT' WHEN {ordinal} = {siblings} - 1 THEN 'RIGHT' ELSE 'CENTER' END "
        f"WHEN {above} IS NOT NULL THEN CASE WHEN {siblings} <= 1 THEN 'MIDDLE' WHEN {ordinal} = 0 THEN 'TOP' WHEN {ordinal} = {siblings} - 1 THEN 'BOTTOM' ELSE 'MIDDLE' END END"
    )


def zones(axis: str, gap: str, key: str) -> str:
    """CTEs from ``middles`` (key, path, x, y) to ``zone_{axis}``."""
    return f"""step_{axis} AS (SELECT *, CASE WHEN {axis} - lag({axis}) OVER (PARTITION BY {key} ORDER BY {axis}) >= {gap}::DOUBLE THEN 1 ELSE 0 END AS new FROM middles),
cluster_{axis} AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY {axis} RANGE UNBOUNDED PRECEDING) AS c, sum(new) OVER (PARTITION BY {key}) AS last FROM step_{axis}),
zone_{axis} AS (SELECT {key}, path, (CASE WHEN c = 0 AND {axis} < 0 THEN last ELSE c END)::INTEGER AS {axis}_zone, (last + 1)::INTEGER AS {axis}_zone_count FROM cluster_{axis})"""


BOX_PAGES = f"{BOXES}, box_pages AS (SELECT page, {{'x0': 0::DOUBLE, 'y0': 0::DOUBLE, 'x1': 612::DOUBLE, 'y1': 792::DOUBLE}} AS r, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'no': id}} ORDER BY y0, x0, id) AS a FROM boxes GROUP BY page)"
BOX_TREE = f"{BOX_PAGES}, {tree('box_pages', 'page')}"
BOX_ZONES = f"{BOX_TREE}, middles AS (SELECT page, path, (b.x0 + b.x1) / 2 / 612 AS x, (b.y0 + b.y1) / 2 / 792 AS y FROM hulls), {zones('x', '0.08', 'page')}, {zones('y', '0.07', 'page')}"

_PAGE_ATOMS = "page_atoms AS (SELECT doc_id, page_number, any_value(rect) AS r, list({'x0': a.b.x0, 'y0': a.b.y0, 'x1': a.b.x1, 'y1': a.b.y1, 'no': atom_no} ORDER BY atom_no) AS a FROM atoms a JOIN pages USING (doc_id, page_number) GROUP BY doc_id, page_number)"
_KEY = "doc_id, page_number"
CHUNKS = f"""{atoms(True)}, {_PAGE_ATOMS}, {tree('page_atoms', _KEY)},
middles AS (SELECT doc_id, page_number, path, (b.x0 + b.x1) / 2 / width AS x, (b.y0 + b.y1) / 2 / height AS y FROM hulls JOIN pages USING (doc_id, page_number)), {zones('x', '0.08', _KEY)}, {zones('y', '0.07', _KEY)},
parsed AS (SELECT n.doc_id, n.page_number, n.path, n.parent_path, n.depth, n.ordinal, (row_number() OVER (PARTITION BY n.doc_id, n.page_number ORDER BY n.path) - 1)::INTEGER AS chunk_index, coalesce(t.type, 'group') AS type, n.layout, h.b AS b, t.content, t.content_raw, t.content_tagged, t.mime_type,
  m.x, m.y, {coarse('h.b', 'width', 'height')} AS coarse, x_zone, x_zone_count, y_zone, y_zone_count, {relative('n.above', 'n.ordinal', 'n.siblings')} AS relative_position
  FROM nodes n JOIN hulls h USING (doc_id, page_number, path) JOIN middles m USING (doc_id, page_number, path) JOIN zone_x USING (doc_id, page_number, path) JOIN zone_y USING (doc_id, page_number, path) JOIN pages USING (doc_id, page_number)
  LEFT JOIN atoms t ON t.doc_id = n.doc_id AND t.page_number = n.page_number AND t.atom_no = n.no)"""

_NODES = "known AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, path ORDER BY ingested_at) AS n FROM chunks) WHERE n = 1)"
_CHUNK_COLUMNS = "chunk_id, doc_id, page_number, path, depth, chunk_index, absolute_position_coarse"


def page_text(column: str) -> str:
    return f"WITH {_NODES}, texts AS (SELECT doc_id, page_number, string_agg({column}, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM known WHERE type = 'text' GROUP BY doc_id, page_number) SELECT doc_id, page_number, coalesce(text, '') AS text FROM (SELECT DISTINCT doc_id, page_number FROM known) LEFT JOIN texts USING (doc_id, page_number)"


_LABELS = f"""{CHUNKS}, drawn AS (SELECT doc_id, page_number, chunk_index AS k, type, b.x0 * 2 AS x0, b.y0 * 2 AS y0, b.x1 * 2 AS x1, b.y1 * 2 AS y1, width * 2 AS pw, height * 2 AS ph,
  CASE WHEN type = 'group' THEN CASE WHEN layout = 'horizontal' THEN 'G:H' ELSE 'G:V' END ELSE upper(type) END || ' [' || coarse || '] {{x:' || x_zone || '/' || x_zone_count || ',y:' || y_zone || '/' || y_zone_count || '}}' || CASE WHEN length(relative_position) > 0 THEN ' <' || relative_position || '>' ELSE '' END AS label
  FROM parsed JOIN pages USING (doc_id, page_number)),
sized AS (SELECT *, greatest(20, 7 * length(label)) + 8::DOUBLE AS w, 18::DOUBLE AS h, 8 * CASE WHEN type = 'group' THEN 1.8::DOUBLE ELSE 1::DOUBLE END AS m, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM drawn),
corners AS (SELECT *, [{{'n': 0, 'l': x0, 't': y0 - h - m, 'ax': x0, 'ay': y0}}, {{'n': 1, 'l': x1 - w, 't': y0 - h - m, 'ax': x1, 'ay': y0}}, {{'n': 2, 'l': x1 + m, 't': my - h / 2, 'ax': x1, 'ay': my}}, {{'n': 3, 'l': x0 - m - w, 't': my - h / 2, 'ax': x0, 'ay': my}},
  {{'n': 4, 'l': x0, 't': y1 + m, 'ax': x0, 'ay': y1}}, {{'n': 5, 'l': x1 - w, 't': y1 + m, 'ax': x1, 'ay': y1}}, {{'n': 6, 'l': mx - w / 2, 't': y0 - h - m, 'ax': mx, 'ay': y0}}, {{'n': 7, 'l': mx - w / 2, 't': y1 + m, 'ax': mx, 'ay': y1}}] AS ps FROM sized),
shifted AS (SELECT *, list_transform(ps, lambda p: {{'n': p.n, 'ax': p.ax, 'ay': p.ay, 'l': p.l, 't': p.t, 'dx': CASE WHEN p.l < 0 THEN -p.l WHEN p.l + w > pw THEN pw - (p.l + w) ELSE 0 END, 'dy': CASE WHEN p.t < 0 THEN -p.t WHEN p.t + h > ph THEN ph - (p.t + h) ELSE 0 END}}) AS qs FROM corners),
options AS MATERIALIZED (SELECT doc_id, page_number, k, mx, my, list_transform(qs, lambda p: {{'n': p.n, 'ax': p.ax, 'ay': p.ay, 'x0': p.l + p.dx, 'y0': p.t + p.dy, 'x1': p.l + w + p.dx, 'y1': p.t + h + p.dy}}) AS rs FROM shifted),
all_boxes AS MATERIALIZED (SELECT doc_id, page_number, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) AS bs FROM drawn GROUP BY doc_id, page_number),
placed AS (SELECT doc_id, page_number, -1 AS k, NULL::STRUCT(n INTEGER, ax DOUBLE, ay DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE) AS r, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS taken FROM all_boxes
UNION ALL SELECT doc_id, page_number, k, r, list_append(taken, {{'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) FROM (
 SELECT doc_id, page_number, k, taken, list_sort(list_transform(rs, lambda r: CASE WHEN len(list_filter(taken, lambda u: {meet('u', 'r')})) > 0
   THEN {{'tier': 2, 'cost': len(list_filter(taken, lambda u: {meet('u', 'r')})) * 1000::DOUBLE + len(list_filter(bs, lambda u: {meet('u', 'r')})) * 300::DOUBLE + (pow(mx - least(greatest(mx, r.x0), r.x1), 2) + pow(my - least(greatest(my, r.y0), r.y1), 2)) * 0.001::DOUBLE, 'n': r.n, 'r': r}}
   ELSE {{'tier': CASE WHEN len(list_filter(bs, lambda u: {meet('u', 'r')})) > 0 THEN 1 ELSE 0 END, 'cost': 0::DOUBLE, 'n': r.n, 'r': r}} END))[1].r AS r
 FROM (SELECT p.taken, o.*, a.bs FROM placed p JOIN options o ON o.doc_id = p.doc_id AND o.page_number = p.page_number AND o.k = p.k + 1 JOIN all_boxes a ON a.doc_id = p.doc_id AND a.page_number = p.page_number)))"""


_INTERVALS = f"""{BOXES}, cut AS (SELECT page, axis, s, e FROM (SELECT page, 'x' AS axis, greatest(x0, 0) AS s, least(x1, 612) AS e FROM boxes UNION ALL SELECT page, 'y', greatest(y0, 0), least(y1, 792) FROM boxes) WHERE e > s),
reach AS (SELECT *, max(e) OVER (PARTITION BY page, axis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cut),
isle AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY page, axis ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM reach),
merged AS (SELECT page, axis, min(s) AS s, max(e) AS e FROM isle GROUP BY page, axis, k),
free AS (SELECT page, axis, lag(e, 1, 0) OVER (PARTITION BY page, axis ORDER BY s) AS s, s AS e FROM merged UNION ALL SELECT page, axis, max(e), CASE axis WHEN 'x' THEN 612 ELSE 792 END FROM merged GROUP BY page, axis),
gaps AS (SELECT page, axis, s::DOUBLE AS s, e::DOUBLE AS e FROM free WHERE e > s)"""
_SCORES = f"""{_INTERVALS}, sided AS (SELECT g.page, g.axis, g.s, g.e, count(*) FILTER (WHERE CASE g.axis WHEN 'x' THEN (b.x0 + b.x1) / 2 ELSE (b.y0 + b.y1) / 2 END <= (g.s + g.e) / 2) AS f, count(*) AS n FROM gaps g JOIN boxes b USING (page) GROUP BY ALL),
extents AS (SELECT *, CASE axis WHEN 'x' THEN 612::DOUBLE ELSE 792::DOUBLE END AS extent, CASE axis WHEN 'x' THEN 0.04::DOUBLE ELSE 0.03::DOUBLE END AS least_gap FROM sided),
scored AS (SELECT page, CASE axis WHEN 'x' THEN 'vertical' ELSE 'horizontal' END AS axis, s, e, f::INTEGER AS first, (n - f)::INTEGER AS second, (e - s) / extent * 0.7::DOUBLE + least(f, n - f)::DOUBLE / greatest(f, n - f)::DOUBLE * 0.3::DOUBLE AS score
  FROM extents WHERE (e - s) / extent >= least_gap AND f > 0 AND f < n)"""



def _elements(value: str) -> str:
    """The elements of a JSON array; an object alone counts as an array of one."""
    return f"(CASE json_type({value}) WHEN 'ARRAY' THEN json_extract({value}, '$[*]') WHEN 'OBJECT' THEN [{value}] ELSE [] END)"


_RECORDS = f"""WITH RECURSIVE valid AS (SELECT record_id, body::JSON AS j FROM page_records WHERE body IS NOT NULL AND json_valid(body)),
record_pages AS (SELECT record_id, page_index::INTEGER - 1 AS page_index, p FROM (SELECT record_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS page_index FROM (SELECT record_id, {_elements("(j->'pages')")} AS ps FROM valid WHERE json_type(j) = 'OBJECT')) WHERE json_type(p) = 'OBJECT'),
tops AS (SELECT record_id, page_index, (p->>'page_number')::INTEGER AS page_number, {_elements("(p->'chunks')")} AS kids FROM record_pages),
walk AS (SELECT record_id, page_index, page_number, lpad((i - 1)::VARCHAR, 4, '0') AS node_path, '' AS parent_path, (i - 1)::INTEGER AS ordinal, n FROM (SELECT record_id, page_index, page_number, unnest(kids) AS n, generate_subscripts(kids, 1) AS i FROM tops)
UNION ALL SELECT record_id, page_index, page_number, node_path || '.' || lpad((i - 1)::VARCHAR, 4, '0'), node_path, (i - 1)::INTEGER, c FROM (SELECT record_id, page_index, page_number, node_path, unnest(kids) AS c, generate_subscripts(kids, 1) AS i
  FROM (SELECT record_id, page_index, page_number, node_path, {_elements("(n->'children')")} AS kids FROM walk WHERE json_type(n) = 'OBJECT'))),
chunk_objects AS MATERIALIZED (SELECT * FROM walk WHERE json_type(n) = 'OBJECT'),
notes AS (SELECT record_id, page_index, page_number, node_path || '.' || lpad((i - 1)::VARCHAR, 4, '0') AS node_path, node_path AS parent_path, (i - 1)::INTEGER AS ordinal, n FROM (SELECT record_id, page_index, page_number, node_path, unnest(l) AS n, generate_subscripts(l, 1) AS i
  FROM (SELECT record_id, page_index, page_number, node_path, json_extract((n->'annotations'), '$[*]') AS l FROM chunk_objects WHERE json_type(n->'annotations') = 'ARRAY')) WHERE json_type(n) = 'OBJECT')"""


def _scalar(path: str, kind: str = "VARCHAR") -> str:
    """A value below the object ``n`` as plain text or number; null for objects, arrays and what isn't of the kind."""
    value = "n" + "".join(f"->{step}" if step.isdigit() else f"->'{step}'" for step in path.split("."))
    return f"(CASE WHEN json_type(({value})) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN try_cast((({value}) ->> '$') AS {kind}) END)"


_NODE_BOX = ", ".join("coalesce(" + _scalar(f"bbox.{s}", "DOUBLE") + ", " + _scalar(f"bbox.{k}", "DOUBLE") + f") AS {s}" for k, s in enumerate(("x0", "y0", "x1", "y1")))
_NODE_KEYS = "record_id, page_index, page_number, node_path, parent_path, ordinal"
_NODE = f"{_NODE_KEYS}, {_scalar('chunk_index', 'INTEGER')} AS chunk_index, {_scalar('type')} AS type, {_NODE_BOX}, {_scalar('size_normalized.w', 'DOUBLE')} AS w, {_scalar('size_normalized.h', 'DOUBLE')} AS h"
_GROUPS = f"coalesce({_scalar('type')}, '') = 'group'"
_TAGS = "coalesce(array_to_string(list_transform(list_filter(list_transform(CASE WHEN json_type(n->'tags') = 'ARRAY' THEN json_extract((n->'tags'), '$[*]') ELSE [] END, lambda t, i: {'i': i - 1, 't': t}), lambda x: json_type(x.t) <> 'NULL'), lambda x: x.i || '=' || (x.t ->> '$')), ','), '')"

_PLACES = f"""{BOXES}, scaled AS (SELECT page, id, x0 * 2 AS x0, y0 * 2 AS y0, x1 * 2 AS x1, y1 * 2 AS y1, greatest(20, 7 * length(kind)) + 8::DOUBLE AS w, 18::DOUBLE AS h, 8 * CASE WHEN kind = 'table' THEN 1.8::DOUBLE ELSE 1::DOUBLE END AS m FROM boxes),
middled AS (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM scaled),
listed AS (SELECT page, id, w, h, [
  {{'l': x0, 't': y0 - h - m, 'ax': x0, 'ay': y0}}, {{'l': x1 - w, 't': y0 - h - m, 'ax': x1, 'ay': y0}}, {{'l': x1 + m, 't': my - h / 2, 'ax': x1, 'ay': my}}, {{'l': x0 - m - w, 't': my - h / 2, 'ax': x0, 'ay': my}},
  {{'l': x0, 't': y1 + m, 'ax': x0, 'ay': y1}}, {{'l': x1 - w, 't': y1 + m, 'ax': x1, 'ay': y1}}, {{'l': mx - w / 2, 't': y0 - h - m, 'ax': mx, 'ay': y0}}, {{'l': mx - w / 2, 't': y1 + m, 'ax': mx, 'ay': y1}}] AS ps FROM middled),
places AS (SELECT page, id, w, h, unnest(ps) AS p, generate_subscripts(ps, 1)::INTEGER - 1 AS place_no FROM listed),
moved AS (SELECT page, id, place_no, p, w, h, CASE WHEN p.l < 0 THEN -p.l WHEN p.l + w > 1224 THEN 1224 - (p.l + w) ELSE 0 END AS dx, CASE WHEN p.t < 0 THEN -p.t WHEN p.t + h > 1584 THEN 1584 - (p.t + h) ELSE 0 END AS dy FROM places)"""

ORACLES: dict[str, str] = {
    # overlays
    "overlay_candidates": f"WITH {_PLACES} SELECT page, id, place_no, p.l + dx AS x0, p.t + dy AS y0, p.l + w + dx AS x1, p.t + h + dy AS y1, p.ax AS ax, p.ay AS ay FROM moved",
    # nested records
    "p6_found": f"{_RECORDS} SELECT record_id, page_number, node_path, parent_path FROM chunk_objects",
    "p6_pages": f"{_RECORDS} SELECT record_id, page_index, (n->>'page_number')::INTEGER AS page_number, {_scalar('width', 'DOUBLE')} AS width, {_scalar('height', 'DOUBLE')} AS height, {_scalar('debug.atom_count', 'INTEGER')} AS atom_count FROM (SELECT record_id, page_index, p AS n FROM record_pages)",
    "p6_groups": f"{_RECORDS} SELECT {_NODE}, {_scalar('layout')} AS layout FROM chunk_objects WHERE {_GROUPS}",
    "p6_leaves": f"{_RECORDS} SELECT {_NODE}, {_scalar('content')} AS content, {_scalar('mime_type')} AS mime_type, {_scalar('debug.line_count', 'INTEGER')} AS line_count, {_scalar('debug.dropped_reason')} AS dropped_reason FROM chunk_objects WHERE NOT {_GROUPS}",
    "p6_annotations": f"{_RECORDS} SELECT {_NODE_KEYS}, {_scalar('kind')} AS kind, {_NODE_BOX}, {_TAGS} AS tags FROM notes",
    # geometry
    "bbox_measures": f"WITH {BOXES} SELECT page, id, {w('boxes')} AS width, {h('boxes')} AS height, {area('boxes')} AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM boxes",
    "bbox_union": f"WITH {BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page",
    "bbox_intersection": f"WITH {PAIRS} SELECT page, id_a, id_b, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM pairs",
    "bbox_contains": f"WITH {PAIRS} SELECT page, id_a, id_b, b.x0 >= a.x0 AND b.y0 >= a.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1 AS inside, b.x0 >= a.x0 - 4 AND b.y0 >= a.y0 - 4 AND b.x1 <= a.x1 + 4 AND b.y1 <= a.y1 + 4 AS nearly_inside FROM pairs",
    "bbox_overlap_ratio": f"WITH {PAIRS} SELECT page, id_a, id_b, {overlap('a', 'b')} AS a_in_b, {overlap('b', 'a')} AS b_in_a FROM pairs",
    "bbox_iou": f"WITH {IMAGE_PAIRS} SELECT page, id_a, id_b, {iou('a', 'b')} AS iou FROM pairs",
    "bbox_scale": f"WITH {BOXES} SELECT page, id, x0 * 2 AS x0, y0 * 2 AS y0, x1 * 2 AS x1, y1 * 2 AS y1 FROM boxes",
    "point_distance": f"WITH {BOXES} SELECT page, id, pow(306 - least(greatest(306, x0), x1), 2) + pow(396 - least(greatest(396, y0), y1), 2) AS distance FROM boxes",
    "coarse_position": f"WITH {BOXES} SELECT page, id, {coarse('boxes', '612::DOUBLE', '792::DOUBLE')} AS coarse FROM boxes",
    "normalized_geometry": f"WITH {BOXES} SELECT page, id, (x0 + x1) / 2 / 612 AS x, (y0 + y1) / 2 / 792 AS y, {w('boxes')} / 612 AS w, {h('boxes')} / 792 AS h FROM boxes",
    "page_area_ratio": f"WITH {BOXES} SELECT page, id, {area('boxes')} / greatest(1::DOUBLE, 612::DOUBLE * 792) AS ratio FROM boxes",
    # text
    "span_text": f"WITH {BLOCKS}, ls AS (SELECT doc_id, page_number, no, unnest(b.lines) AS l, generate_subscripts(b.lines, 1) - 1 AS line_no FROM blocks), ss AS (SELECT doc_id, page_number, no, line_no, unnest(l.spans) AS s, generate_subscripts(l.spans, 1) - 1 AS span_no FROM ls) SELECT doc_id, page_number, no::INTEGER AS block_no, line_no::INTEGER AS line_no, span_no::INTEGER AS span_no, {_SPAN} AS text FROM ss",
    "text_normalize": f"WITH dirty AS ({DIRTY_TEXT}) SELECT doc_id, {normal('text')} AS text FROM dirty",
    "block_text": f"WITH {TEXT_BLOCKS} SELECT doc_id, page_number, no::INTEGER AS block_no, content_raw, content, line_count::INTEGER AS line_count, span_count, length(content_raw)::INTEGER AS char_count_raw, length(content)::INTEGER AS char_count_clean FROM text_blocks",
    "tagged_text": f"WITH {TAGGED} SELECT doc_id, page_number, no::INTEGER AS block_no, content_tagged FROM tagged",
    "html_escape": f"SELECT doc_id, {_ESCAPED.format('text')} AS text FROM documents",
    "base64_payload": "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 0 THEN base64(encode(text)) END AS payload FROM documents",
    "image_signature": f"WITH {BLOCKS}, {images(True)} SELECT doc_id, page_number, no::INTEGER AS block_no, sig AS signature, CASE WHEN content IS NOT NULL THEN 'image/' || ext END AS mime_type FROM signed",
    "chunk_label": f"""WITH {_NODES} SELECT chunk_id, CASE WHEN type = 'group' THEN CASE WHEN layout = 'horizontal' THEN 'G:H' ELSE 'G:V' END ELSE upper(type) END
  || CASE WHEN length(absolute_position_coarse) > 0 THEN ' [' || absolute_position_coarse || ']' ELSE '' END
  || CASE WHEN absolute_position_dynamic IS NOT NULL THEN ' {{x:' || absolute_position_dynamic.x_zone || '/' || absolute_position_dynamic.x_zone_count || ',y:' || absolute_position_dynamic.y_zone || '/' || absolute_position_dynamic.y_zone_count || '}}' ELSE '' END
  || CASE WHEN length(relative_position) > 0 THEN ' <' || relative_position || '>' ELSE '' END AS label,
  CASE WHEN type = 'group' THEN CASE WHEN layout = 'horizontal' THEN '#ff8c00' ELSE '#9933ff' END WHEN type = 'text' THEN '#0066cc' WHEN type = 'image' THEN '#009933' WHEN type = 'table' THEN '#cc0000' ELSE '#000000' END AS colour FROM known""",
    # atoms
    "table_pad": f"WITH {PADDED} SELECT doc_id, page_number, no::INTEGER AS table_no, {_SIDES} FROM padded",
    "table_dedupe": f"WITH {TABLES} SELECT doc_id, page_number, no::INTEGER AS table_no, {_SIDES} FROM tables",
    "text_table_antijoin": f"WITH {TEXT_BLOCKS}, {TABLES.removeprefix(PAGES + ', ')}, {OUTSIDE} SELECT doc_id, page_number, no::INTEGER AS block_no, content FROM outside",
    "text_coverage": f"WITH {BLOCKS}, {COVERED} SELECT doc_id, page_number, no::INTEGER AS block_no, coverage FROM covered",
    "background_images": f"WITH {BLOCKS}, {COVERED} SELECT doc_id, page_number, no::INTEGER AS block_no, ratio, {BACKGROUND} AS is_background FROM covered",
    "image_dedupe": f"WITH {BLOCKS}, {images(True)} SELECT doc_id, page_number, no::INTEGER AS block_no, {_SIDES}, sig AS signature FROM images",
    "atom_union": f"WITH {atoms(True)} SELECT type, count(*) AS n, count(content) AS n_content, count(DISTINCT doc_id) AS n_docs FROM atoms GROUP BY type",
    "reading_order": f"WITH {atoms(True)} SELECT doc_id, page_number, atom_no, type, k3::INTEGER AS source_no FROM atoms",
    "page_debug": f"WITH {atoms(True)} SELECT doc_id, page_number, any_value(width) AS width, any_value(height) AS height, count(a.type)::INTEGER AS atom_count, count(*) FILTER (WHERE a.type = 'text')::INTEGER AS text_atom_count, count(*) FILTER (WHERE a.type = 'image')::INTEGER AS image_atom_count, count(*) FILTER (WHERE a.type = 'table')::INTEGER AS table_atom_count FROM pages LEFT JOIN atoms a USING (doc_id, page_number) GROUP BY doc_id, page_number",
    "extract_atoms": f"WITH {atoms(True)} SELECT {_ATOM} FROM atoms",
    "extract_atoms_no_payload": f"WITH {atoms(False)} SELECT {_ATOM} FROM atoms",
    # tree
    "occupied_intervals": f"WITH {_INTERVALS} SELECT page, axis, s::DOUBLE AS s, e::DOUBLE AS e FROM merged",
    "find_gaps": f"WITH {_INTERVALS} SELECT page, axis, s, e FROM gaps",
    "split_scores": f"WITH {_SCORES} SELECT * FROM scored",
    "best_split": f"WITH {_SCORES} SELECT page, axis, s, e, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, axis DESC, s) AS n FROM scored) WHERE n = 1",
    "region_members": f"WITH {BOXES}, regions AS (SELECT 'left' AS region, {{'x0': 0::DOUBLE, 'y0': 0::DOUBLE, 'x1': 306::DOUBLE, 'y1': 792::DOUBLE}} AS r UNION ALL SELECT 'right', {{'x0': 306::DOUBLE, 'y0': 0::DOUBLE, 'x1': 612::DOUBLE, 'y1': 792::DOUBLE}}) SELECT page, id, region FROM boxes b, regions WHERE {common('b', 'r')} / greatest({area('b')}, 1e-6::DOUBLE) >= 0.80::DOUBLE",
    "layout_tree": f"WITH RECURSIVE {BOX_TREE} SELECT page, path, parent_path, depth, layout, coalesce(no, -1) AS id FROM nodes",
    "layout_tree_levels": f"WITH RECURSIVE {BOX_TREE} SELECT page, path, parent_path, depth, layout, coalesce(no, -1) AS id FROM nodes",
    "tree_leaves": f"WITH RECURSIVE {BOX_TREE} SELECT page, no AS id, path FROM nodes WHERE no IS NOT NULL",
    "group_bbox": f"WITH RECURSIVE {BOX_TREE} SELECT page, path, {_SIDES} FROM hulls JOIN nodes USING (page, path) WHERE no IS NULL",
    "preorder_index": f"WITH RECURSIVE {BOX_TREE} SELECT page, path, (row_number() OVER (PARTITION BY page ORDER BY path) - 1)::INTEGER AS chunk_index FROM nodes",
    "relative_position": f"WITH RECURSIVE {BOX_TREE} SELECT page, path, {relative('above', 'ordinal', 'siblings')} AS relative FROM nodes",
    "zone_clusters": f"WITH RECURSIVE {BOX_ZONES} SELECT DISTINCT page, x_zone_count, y_zone_count FROM zone_x JOIN zone_y USING (page, path)",
    "dynamic_position": f"WITH RECURSIVE {BOX_ZONES} SELECT page, path, x_zone, x_zone_count, y_zone, y_zone_count FROM zone_x JOIN zone_y USING (page, path)",
    "fallback_flow": f"WITH RECURSIVE {BOX_TREE} SELECT page, path, no AS id, ordinal FROM nodes WHERE fell",
    "flat_index": f"WITH {BOXES} SELECT page, id, (row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) - 1)::INTEGER AS chunk_index FROM boxes",
    "parse_document": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, page_number, path, parent_path, depth, ordinal, chunk_index, type, layout, {_SIDES}, content, content_raw, content_tagged, mime_type, x, y, coarse, x_zone, x_zone_count, y_zone, y_zone_count, relative_position FROM parsed",
    "parse_page": f"WITH RECURSIVE {CHUNKS}, one AS (SELECT doc_id, max(page_number) AS page_number FROM pages WHERE doc_id = (SELECT min(doc_id) FROM pages) GROUP BY doc_id) SELECT doc_id, page_number, path, parent_path, depth, ordinal, chunk_index, type, layout, {_SIDES}, content, content_raw, content_tagged, mime_type, x, y, coarse, x_zone, x_zone_count, y_zone, y_zone_count, relative_position FROM parsed JOIN one USING (doc_id, page_number)",
    "page_json_tree": f"WITH RECURSIVE {CHUNKS} SELECT doc_id || '/' || page_number AS key, substr(path, 1) AS node_path, parent_path, type, layout, chunk_index, coarse, relative_position, content, b.x0 AS x0, b.y1 AS y1 FROM parsed",
    "document_json_parts": f"WITH RECURSIVE {CHUNKS}, counted AS (SELECT doc_id, page_number, count(p.path) AS n FROM pages LEFT JOIN parsed p USING (doc_id, page_number) GROUP BY ALL) SELECT doc_id || '/' || ((page_number - 1) // 3) AS key, count(*) AS n_pages, sum(n)::BIGINT AS n_chunks FROM counted GROUP BY ALL",
    "overlay_labels": f"WITH RECURSIVE {_LABELS} SELECT doc_id, page_number, k AS at, r.n AS place_no, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1, r.ax AS ax, r.ay AS ay FROM placed WHERE k >= 0",
    "overlay_png": f"WITH {PAGES} SELECT doc_id, page_number, '504E47' AS kind, (width * 2)::INTEGER AS width, (height * 2)::INTEGER AS height FROM pages",
    "overlay_frames": f"""WITH RECURSIVE {CHUNKS} SELECT doc_id, page_number, chunk_index AS at, b.x0 * 2 AS x, b.y0 * 2 AS y, {w('b')} * 2 AS width, {h('b')} * 2 AS height,
  CASE WHEN type = 'group' THEN CASE WHEN layout = 'horizontal' THEN '#ff8c00' ELSE '#9933ff' END WHEN type = 'text' THEN '#0066cc' WHEN type = 'image' THEN '#009933' WHEN type = 'table' THEN '#cc0000' ELSE '#000000' END AS colour,
  greatest(1, 2 - depth)::INTEGER AS line_width FROM parsed""",
    # views
    "all_chunks": f"WITH {_NODES} SELECT {_CHUNK_COLUMNS}, type FROM known",
    **{f"{k}_chunks": f"WITH {_NODES} SELECT {_CHUNK_COLUMNS} FROM known WHERE type = '{k}'" for k in ("text", "image", "table", "group")},
    "parent_children": f"WITH {_NODES} SELECT p.chunk_id AS parent_id, c.chunk_id AS child_id, c.ordinal FROM known p JOIN known c ON p.doc_id = c.doc_id AND p.page_number = c.page_number AND p.path = c.parent_path",
    "page_text": page_text("content"),
    "page_text_raw": page_text("content_raw"),
    "page_text_tagged": page_text("content_tagged"),
    "page_blocks": f"WITH {_NODES} SELECT doc_id, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY chunk_index) - 1)::INTEGER AS block_index, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, content AS text FROM known WHERE type = 'text'",
    "point_page": f"WITH {_NODES} SELECT chunk_id, path, type FROM known WHERE page_number = 2",
}
