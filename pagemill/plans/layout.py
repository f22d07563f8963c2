"""Queries over layout blocks, quality and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from ..functions.pandas_udfs import nfc, sequence_ratio, unified_diff
from ..operators import evaluation as ev
from ..operators import layout as ly
from ..operators import quality as qu
from .documents import S, collapse
from .registry import Tables, query

IOU = "CASE WHEN i <= 0 OR aa + ab - i <= 0 THEN 0.0 ELSE i / (aa + ab - i) END"
PAIRS = """pr AS (SELECT a.doc_id, a.page_no, a.idx AS ai, b.idx AS bi, a.confidence AS ac, b.confidence AS bc, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab
  FROM blocks a JOIN blocks_b b ON a.doc_id = b.doc_id AND a.page_no = b.page_no),
c AS (SELECT doc_id, page_no, ai, bi, iou, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ai, iou DESC, bi) AS k FROM (SELECT *, """ + IOU + """ AS iou FROM pr) WHERE iou >= {least}),
m AS (SELECT doc_id, page_no, k, ai AS last, [bi] AS used, true AS hit, ai, bi, iou FROM c WHERE k = 1
  UNION ALL SELECT c.doc_id, c.page_no, c.k, CASE WHEN c.ai <> m.last AND NOT list_contains(m.used, c.bi) THEN c.ai ELSE m.last END, CASE WHEN c.ai <> m.last AND NOT list_contains(m.used, c.bi) THEN list_append(m.used, c.bi) ELSE m.used END, c.ai <> m.last AND NOT list_contains(m.used, c.bi), c.ai, c.bi, c.iou FROM m JOIN c ON c.doc_id = m.doc_id AND c.page_no = m.page_no AND c.k = m.k + 1)"""


@query("P04_validate_blocks", "blocks", oracle="SELECT doc_id, page_no, bool_and(ok) AS valid, count(*) FILTER (WHERE NOT ok) AS bad FROM (SELECT doc_id, page_no, idx % 40 <> 39 AND x2 > x1 AND y2 > y1 AS ok FROM blocks) GROUP BY 1, 2")
def _(t: Tables):
    b = t["blocks"].withColumn("x2", F.when(F.col("idx") % 40 == 39, F.lit(float("nan"))).otherwise(F.col("x2")))
    return ly.validate_blocks(b).select("doc_id", "page_no", "valid", F.size("bad").cast("long").alias("bad"))


@query("P05_renderable_blocks", "blocks", oracle="SELECT doc_id, idx FROM blocks WHERE abs(x2 - x1 - idx % 60) >= 4 AND abs(y2 - y1) >= 4")
def _(t: Tables):
    return ly.renderable(t["blocks"].withColumn("x2", F.col("x2") - F.col("idx") % 60)).select("doc_id", "idx")


@query("P06_validate_results", "documents", oracle="SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END) <> '' OR doc_id % 4 > 0 ELSE doc_id % 5 > 0 END AS valid FROM documents")
def _(t: Tables):
    i = F.col("doc_id")
    d = t["documents"].select("doc_id", F.when(i % 2 == 0, "pdf").otherwise("image").alias("type"), F.when(i % 3 == 0, " ").otherwise(F.col("text")).alias("text"), (i % 4).alias("pages"), (i % 5).alias("blocks"))
    return ly.validate_results(d).select("doc_id", "valid")


@query("F01_bbox_iou", "blocks", "blocks_b", oracle=f"WITH {PAIRS.format(least=0.0).split('c AS')[0].rstrip().rstrip(',')} SELECT doc_id, ai, bi, round({IOU}, 9) AS iou FROM pr WHERE ai = bi")
def _(t: Tables):
    a, b = t["blocks"].alias("a"), t["blocks_b"].alias("b")
    j = a.join(b, ["doc_id", "page_no", "idx"])
    return j.select("doc_id", F.col("idx").alias("ai"), F.col("idx").alias("bi"), F.round(geo.iou(geo.box("a."), geo.box("b.")), 9).alias("iou"))


@query("F02_bbox_scale", "blocks", oracle="""SELECT doc_id, idx, CASE WHEN b <= a OR d <= c THEN NULL ELSE a END AS sx1, CASE WHEN b <= a OR d <= c THEN NULL ELSE d END AS sy2 FROM (SELECT doc_id, idx, least(greatest(x1 / 999.0 * 800, 0.0), 800.0) AS a, least(greatest(x2 / 999.0 * 800, 0.0), 800.0) AS b, least(greatest(y1 / 999.0 * 600, 0.0), 600.0) AS c, least(greatest(y2 / 999.0 * 600, 0.0), 600.0) AS d FROM blocks)""")
def _(t: Tables):
    s = geo.scale(F.array("x1", "y1", "x2", "y2"), F.lit(800), F.lit(600))
    return t["blocks"].select("doc_id", "idx", F.element_at(s, 1).alias("sx1"), F.element_at(s, 4).alias("sy2"))


@query("F03_bbox_shrink_ok", "blocks", oracle="SELECT doc_id, idx, x2 - x1 - 4 >= 24 AND y2 - y1 - 4 >= 24 AS ok FROM blocks")
def _(t: Tables):
    return t["blocks"].select("doc_id", "idx", geo.shrink(geo.box()).isNotNull().alias("ok"))


@query("F04_box_nearby", "blocks", oracle="SELECT a.doc_id, a.idx, greatest(b.x1 - a.x2, a.x1 - b.x2, 0) <= 30 AND greatest(b.y1 - a.y2, a.y1 - b.y2, 0) <= 30 AS near FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND b.idx = a.idx + 2")
def _(t: Tables):
    a, b = t["blocks"].alias("a"), t["blocks"].withColumn("idx", F.col("idx") - 2).alias("b")
    return a.join(b, ["doc_id", "page_no", "idx"]).select("doc_id", "idx", geo.nearby(geo.box("a."), geo.box("b."), 30).alias("near"))


@query("F05_parse_boxes", "blocks", oracle="SELECT doc_id, idx, CASE idx % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n, CASE WHEN idx % 4 < 3 THEN x2 END AS x2 FROM blocks")
def _(t: Tables):
    one = F.concat_ws(", ", *(F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")))
    k = F.col("idx") % 4
    raw = F.when(k == 0, F.concat(F.lit("text ["), one, F.lit("]"))).when(k == 1, F.concat(F.lit("[["), one, F.lit("], ["), one, F.lit("]]"))).when(k == 2, one).otherwise(F.lit("[1, 2, x, 4]"))
    return t["blocks"].withColumn("b", geo.parse_boxes(raw)).select("doc_id", "idx", F.size("b").alias("n"), F.try_element_at(F.try_element_at("b", F.lit(1)), F.lit(3)).alias("x2"))


@query("F06_label_map", "blocks", oracle="SELECT doc_id, idx, CASE idx % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'formula' WHEN 2 THEN 'annotation' WHEN 3 THEN 'heading' ELSE 'body' END AS region_class, CASE idx % 5 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS hierarchy_level FROM blocks")
def _(t: Tables):
    label = F.element_at(F.array(*(F.lit(x) for x in (" Headline", "math", "page_number", "section", "other"))), (F.col("idx") % 5 + 1).cast("int"))
    return t["blocks"].select("doc_id", "idx", qu.label_region(label).alias("r")).select("doc_id", "idx", "r.*")


@query("F08_normalize_loose", "blocks", oracle=f"SELECT doc_id, idx, {collapse('lower(text)')} AS text FROM blocks")
def _(t: Tables):
    return t["blocks"].select("doc_id", "idx", tx.loose(F.col("text")).alias("text"))


@query("F14_mixed_direction", "blocks", oracle="SELECT doc_id, idx, idx % 2 = 0 AND regexp_matches(text, '\\p{L}') AS mixed FROM blocks")
def _(t: Tables):
    return t["blocks"].select("doc_id", "idx", tx.mixed_direction(F.when(F.col("idx") % 2 == 0, F.concat("text", F.lit(" שלום"))).otherwise(F.col("text"))).alias("mixed"))


@query("F16_confidence_delta", "blocks", "blocks_b", oracle="SELECT a.doc_id, a.idx, greatest(-1.0, least(1.0, round(b.confidence - a.confidence, 4))) AS delta FROM blocks a JOIN blocks_b b USING (doc_id, page_no, idx)")
def _(t: Tables):
    j = t["blocks"].alias("a").join(t["blocks_b"].alias("b"), ["doc_id", "page_no", "idx"])
    return j.select("doc_id", "idx", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(F.col("b.confidence") - F.col("a.confidence"), 4))).alias("delta"))


@query("F20_lines_to_blocks", "documents", oracle=f"SELECT doc_id, CAST(k - 1 AS INT) AS idx, round((k - 1) * (1000.0 / n), 2) AS y1, round(k * (1000.0 / n), 2) AS y2 FROM (SELECT doc_id, len(l) AS n, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{S}+', '', 'g') <> '') AS l FROM documents WHERE text IS NOT NULL))")
def _(t: Tables):
    d = t["documents"].where("text IS NOT NULL").select("doc_id", F.lit(1).alias("page_no"), "text", F.lit(800.0).alias("width"), F.lit(1000.0).alias("height"))
    return ly.lines_to_blocks(d).select("doc_id", "idx", "y1", "y2")


COLS = """ctr AS (SELECT *, (x1 + x2) / 2 AS c, greatest(20.0, max(x2) OVER (PARTITION BY doc_id, page_no) * 0.08) AS gap FROM blocks),
dst AS (SELECT DISTINCT doc_id, page_no, c, gap FROM ctr), brk AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY doc_id, page_no ORDER BY c) >= gap THEN 1 ELSE 0 END AS b FROM dst),
ids AS (SELECT doc_id, page_no, c, CAST(sum(b) OVER (PARTITION BY doc_id, page_no ORDER BY c) AS INT) AS column_id FROM brk),
cols AS (SELECT ctr.*, ids.column_id FROM ctr JOIN ids USING (doc_id, page_no, c))"""


@query("W11_detect_columns", "blocks", oracle=f"WITH {COLS} SELECT doc_id, idx, column_id FROM cols")
def _(t: Tables):
    return ly.detect_columns(t["blocks"]).select("doc_id", "idx", "column_id")


@query("W12_reading_order", "blocks", oracle=f"WITH {COLS} SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY column_id, y1, x1, idx) AS INT) AS reading_order FROM cols")
def _(t: Tables):
    return ly.reading_order(ly.detect_columns(t["blocks"])).select("doc_id", "idx", "reading_order")


@query("W12_reading_order_rtl", "blocks", oracle=f"""
WITH RECURSIVE {COLS.replace("AS (SELECT *, (x1", "AS (SELECT * REPLACE (y2 + idx % 4 * 15 AS y2), (x1", 1)},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, column_id ORDER BY y1, x1 DESC, idx) AS k FROM cols),
f AS (SELECT doc_id, page_no, column_id, k, idx, [y1] AS tops, [y2] AS ends, 1::BIGINT AS line FROM o WHERE k = 1
  UNION ALL SELECT doc_id, page_no, column_id, k, idx,
    CASE WHEN hit = 0 THEN list_append(tops, y1) ELSE list_transform(range(1, len(tops) + 1), lambda i: CASE WHEN i = hit THEN least(tops[i], y1) ELSE tops[i] END) END,
    CASE WHEN hit = 0 THEN list_append(ends, y2) ELSE list_transform(range(1, len(ends) + 1), lambda i: CASE WHEN i = hit THEN greatest(ends[i], y2) ELSE ends[i] END) END,
    CASE WHEN hit = 0 THEN len(tops) + 1 ELSE hit END
  FROM (SELECT o.doc_id, o.page_no, o.column_id, o.k, o.idx, o.y1, o.y2, tops, ends,
      coalesce(list_position(list_transform(range(1, len(tops) + 1), lambda i: least(o.y2, ends[i]) > greatest(o.y1, tops[i])), true), 0)::BIGINT AS hit
    FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_no = f.page_no AND o.column_id = f.column_id AND o.k = f.k + 1)),
z AS (SELECT doc_id, page_no, column_id, arg_max(tops, k) AS tops FROM f GROUP BY ALL)
SELECT o.doc_id, o.idx, CAST(row_number() OVER (PARTITION BY o.doc_id, o.page_no ORDER BY o.column_id DESC, z.tops[f.line], f.line, o.x1 DESC, o.y1, o.idx) AS INT) AS reading_order
FROM o JOIN f USING (doc_id, page_no, column_id, k) JOIN z USING (doc_id, page_no, column_id)""")
def _(t: Tables):
    b = t["blocks"].withColumns({"lang": F.lit("ar"), "y2": F.col("y2") + F.col("idx") % 4 * 15})
    return ly.reading_order(ly.detect_columns(b)).select("doc_id", "idx", "reading_order")


@query("W13_classify_region", "blocks", oracle=r"""
WITH t AS (SELECT *, trim(text) AS tt, y2 - y1 AS f, max(x2) OVER p AS w, max(y2) OVER p AS h, list(y2 - y1) FILTER (WHERE trim(text) <> '') OVER p AS hs FROM blocks WINDOW p AS (PARTITION BY doc_id, page_no)),
m AS (SELECT *, length(tt) AS n, list_sort(hs)[len(hs) // 2 + 1] AS m, y1 / h AS ry, (x2 - x1) / w AS rw FROM t),
k AS (SELECT doc_id, idx, CASE WHEN n BETWEEN 3 AND 120 AND (regexp_matches(tt, '[=(){}\[\];]') OR starts_with(tt, '//') OR starts_with(tt, '#')) AND regexp_matches(tt, '^[\p{L}\p{N}\p{M}_\s.,;:!?()\[\]{}=+\-*/\\|#@&%^<>~`"'']+$') THEN 'code:0'
  WHEN n <= 40 AND (ends_with(tt, ':') OR ends_with(tt, '：')) THEN 'form_field:0' WHEN f / h < 0.015 AND ry > 0.85 THEN 'annotation:0' WHEN n <= 80 AND ry > 0.75 AND f <= m * 0.85 THEN 'caption:0'
  WHEN rw > 0.7 AND n <= 60 AND length(regexp_replace(tt, '[^\p{Nd}.,|%]', '', 'g')) / greatest(n, 1) > 0.4 THEN 'table:0' WHEN f >= m * 1.6 AND ry < 0.25 AND rw > 0.4 AND n <= 120 THEN 'title:1'
  WHEN f >= m * 1.3 AND n <= 120 AND rw > 0.4 THEN 'heading:2' WHEN f >= m * 1.1 AND n <= 80 THEN 'heading:3' ELSE 'body:0' END AS r FROM m)
SELECT doc_id, idx, split_part(r, ':', 1) AS region_class, CAST(split_part(r, ':', 2) AS INT) AS hierarchy_level FROM k""")
def _(t: Tables):
    return ly.classify_region(t["blocks"]).select("doc_id", "idx", "region_class", "hierarchy_level")


@query("J05_ensemble_merge", "blocks", "blocks_b", oracle=f"""
WITH RECURSIVE {PAIRS.format(least=0.3)}, h AS (SELECT doc_id, page_no, ai, bi FROM m WHERE hit),
w AS (SELECT a.doc_id, a.page_no, a.idx, 0 AS side, CASE WHEN b.confidence > a.confidence THEN 'b' ELSE 'a' END AS engine, CASE WHEN b.confidence > a.confidence THEN b.x1 ELSE a.x1 END AS x1, CASE WHEN b.confidence > a.confidence THEN b.y1 ELSE a.y1 END AS y1
  FROM blocks a LEFT JOIN h ON h.doc_id = a.doc_id AND h.ai = a.idx LEFT JOIN blocks_b b ON b.doc_id = h.doc_id AND b.idx = h.bi
  UNION ALL SELECT b.doc_id, b.page_no, b.idx, 1, 'b', b.x1, b.y1 FROM blocks_b b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = b.doc_id AND h.bi = b.idx))
SELECT doc_id, idx, engine, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y1, x1, side, idx) AS INT) AS reading_order FROM w""")
def _(t: Tables):
    return ly.ensemble_merge(t["blocks"], t["blocks_b"]).select("doc_id", "idx", "engine", "reading_order")


@query("J06_block_detection_score", "blocks", "blocks_b", oracle=f"""
WITH RECURSIVE {PAIRS.format(least=0.5)}, h AS (SELECT doc_id, count(*) AS tp, avg(iou) AS mean FROM m WHERE hit GROUP BY 1), e AS (SELECT doc_id, count(*) AS expected_count FROM blocks GROUP BY 1), d AS (SELECT doc_id, count(*) AS detected_count FROM blocks_b GROUP BY 1),
j AS (SELECT e.doc_id, expected_count, coalesce(detected_count, 0) AS detected_count, coalesce(tp, 0) AS tp, coalesce(mean, 0) AS mean FROM e LEFT JOIN d USING (doc_id) LEFT JOIN h USING (doc_id)), q AS (SELECT *, CASE WHEN detected_count > 0 THEN tp / detected_count ELSE 0.0 END AS p, tp / expected_count AS r FROM j)
SELECT doc_id, expected_count, detected_count, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, round(mean, 4) AS mean_iou FROM q""")
def _(t: Tables):
    return ly.block_detection_score(t["blocks"], t["blocks_b"])


@query("J10_overlap_suppression", "blocks", oracle=f"""
WITH RECURSIVE o AS (SELECT doc_id, idx, x1 - 25 AS x1, y1, x2 + 470 * (idx % 3) AS x2, y2 + idx % 4 * 15 AS y2, {collapse('lower(text)')} AS t FROM blocks), r AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY doc_id ORDER BY (x2 - x1) * (y2 - y1) DESC, y1, x1, idx) AS k FROM o),
x AS (SELECT i.doc_id, i.k, list(j.k) AS clash FROM r i JOIN r j ON i.doc_id = j.doc_id AND j.k < i.k AND (greatest(0.0, least(i.x2, j.x2) - greatest(i.x1, j.x1)) * greatest(0.0, least(i.y2, j.y2) - greatest(i.y1, j.y1)) / i.area >= 0.45
  OR (greatest(j.x1 - i.x2, i.x1 - j.x2, 0) <= 30 AND greatest(j.y1 - i.y2, i.y1 - j.y2, 0) <= 30 AND i.t <> '' AND j.t <> '' AND (contains(i.t, j.t) OR contains(j.t, i.t)))) GROUP BY 1, 2),
q AS (SELECT r.doc_id, r.idx, r.k, coalesce(x.clash, []) AS clash FROM r LEFT JOIN x ON x.doc_id = r.doc_id AND x.k = r.k),
f AS (SELECT doc_id, idx, k, [k] AS kept, true AS ok FROM q WHERE k = 1 UNION ALL SELECT q.doc_id, q.idx, q.k, CASE WHEN list_has_any(f.kept, q.clash) THEN f.kept ELSE list_append(f.kept, q.k) END, NOT list_has_any(f.kept, q.clash) FROM f JOIN q ON q.doc_id = f.doc_id AND q.k = f.k + 1)
SELECT doc_id, idx, ok AS kept FROM f""")
def _(t: Tables):
    i = F.col("idx")
    b = t["blocks"].withColumns({"x1": F.col("x1") - 25, "x2": F.col("x2") + 470 * (i % 3), "y2": F.col("y2") + i % 4 * 15})
    return ly.overlap_suppression(b).select("doc_id", "idx", "kept")


@query("A26_confidence_means", "blocks", oracle="SELECT doc_id, round(avg(confidence), 4) AS mean_all, coalesce(avg(confidence) FILTER (WHERE confidence > 0), 0) AS mean_positive FROM blocks GROUP BY 1")
def _(t: Tables):
    return qu.confidence_means(t["blocks"])


@query("A26_page_means", "blocks", oracle="SELECT doc_id, CAST(idx % 3 AS INT) AS page_no, CAST(round(CAST(avg(confidence) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS page_mean FROM blocks GROUP BY ALL")
def _(t: Tables):
    return qu.page_means(t["blocks"].withColumn("page_no", (F.col("idx") % 3).cast("int")))


@query("A26_pooled_means", "blocks", oracle="""
WITH p AS (SELECT doc_id, idx % 3 AS page_no, CASE WHEN (doc_id + idx % 3) % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS c, confidence FROM blocks), own AS (SELECT DISTINCT doc_id, page_no, c FROM p),
pool AS (SELECT doc_id, c FROM own WHERE c > 0 UNION ALL SELECT doc_id, confidence FROM p WHERE c = 0 AND confidence > 0) SELECT d.doc_id, round(coalesce(avg(pool.c), 0.25), 9) AS confidence FROM (SELECT DISTINCT doc_id FROM blocks) d LEFT JOIN pool USING (doc_id) GROUP BY 1""")
def _(t: Tables):
    b = t["blocks"].withColumn("page_no", (F.col("idx") % 3).cast("int"))
    pages = b.select("doc_id", "page_no").distinct().withColumn("confidence", F.when((F.col("doc_id") + F.col("page_no")) % 2 == 0, 0.5).otherwise(0.0))
    docs = b.select("doc_id").distinct().withColumn("confidence", F.lit(0.25))
    return qu.pooled_means(pages, b, docs).withColumn("confidence", F.round("confidence", 9))


@query("A29_repetition_quality", "documents", oracle=f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, list_filter(string_split({collapse('text')}, ' '), lambda w: w <> '') AS w, text FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, count(*) AS t, count(DISTINCT g) AS d FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 33, 1)), lambda i: array_to_string(w[i:i + 34], ' '))) AS g FROM l WHERE len(w) >= 35) GROUP BY 1)
SELECT *, repeated_line_ratio > 0.4 OR repetition_ratio > 0.05 OR char_count > 40000 OR table_rows > 200 AS degenerate, repetition_ratio > 0.05 AS repeated
FROM (SELECT l.doc_id, CASE WHEN len(l) < 3 THEN 0.0 ELSE (len(l) - len(list_distinct(l))) / len(l) END AS repeated_line_ratio, round(coalesce((t - d) / t, 0.0), 9) AS repetition_ratio, length(text) AS char_count, (length(text) - length(replace(text, '<tr', ''))) // 3 AS table_rows FROM l LEFT JOIN g USING (doc_id))""")
def _(t: Tables):
    return qu.page_quality(t["documents"].where("text IS NOT NULL")).select(
        "doc_id", "repeated_line_ratio", F.round("repetition_ratio", 9).alias("repetition_ratio"), F.col("char_count").cast("long").alias("char_count"), F.col("table_rows").cast("long").alias("table_rows"),
        "degenerate", F.array_contains("warnings", "possible repeated output detected").alias("repeated"),
    )


@query("A30_page_quality", "pages", oracle="""SELECT page_id, (length(html) - length(replace(html, '<tr', ''))) // 3 AS table_rows, length(html) AS char_count, false AS markup_leak FROM pages""")
def _(t: Tables):
    return qu.page_quality(t["pages"], "page_id", "html").select("page_id", F.col("table_rows").cast("long").alias("table_rows"), F.col("char_count").cast("long").alias("char_count"), "markup_leak")


def _lines(t: Tables):
    changed = F.when(F.col("idx") % 4 == 0, F.translate("text", "eo", "ac")).when(F.col("idx") % 4 == 1, F.lit("nothing alike")).otherwise(F.col("text"))
    lines = t["blocks"].select("doc_id", "idx", F.col("text").alias("raw"), changed.alias("corrected"), "confidence")
    # dealt over all tasks: comparing costs far more than the move, and files may have few parts
    return lines.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "idx")


@query("A31_correction_stats", "blocks")
def _(t: Tables):
    return qu.correction_stats(_lines(t))


@query("A31_correction_totals", "blocks")
def _(t: Tables):
    return qu.correction_totals(_lines(t).withColumn("page_no", (F.col("idx") % 3).cast("int")))


@query("U03_unified_diff", "blocks")
def _(t: Tables):
    return qu.correction_diff(_lines(t)).select("doc_id", "idx", "diff")


@query("U01_nfc", "documents", oracle="SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def _(t: Tables):
    return t["documents"].select("doc_id", nfc("text").alias("text"))


def _pairs(t: Tables):
    """The passages dealt over all tasks: an edit distance costs far more than the move, and one text may have thousands."""
    return t["eval_pairs"].repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "pos")


def _codes(items: str) -> str:
    """DuckDB's distance counts bytes: the distinct items of a pair (characters, words; up to 127) stand as single bytes."""
    return f"array_to_string(list_transform({items}, lambda w: chr(list_position(known, w)::INT)), '')"


WER = f"""n AS (SELECT * EXCLUDE (reference, hypothesis), nfc_normalize(reference) AS reference, nfc_normalize(hypothesis) AS hypothesis FROM eval_pairs),
v AS (SELECT *, list_filter(string_split(r, ' '), lambda x: x <> '') AS rw, list_filter(string_split(h, ' '), lambda x: x <> '') AS hw FROM (SELECT *, {collapse('reference')} AS r, {collapse('hypothesis')} AS h FROM n)),
k AS (SELECT *, levenshtein({_codes("string_split(r, '')")}, {_codes("string_split(h, '')")}) / length(r) AS cer FROM (SELECT *, list_distinct(string_split(r || h, '')) AS known FROM v WHERE len(rw) > 0)),
s AS (SELECT *, levenshtein({_codes('rw')}, {_codes('hw')}) / len(rw) AS wer FROM (SELECT * REPLACE (list_distinct(list_concat(rw, hw)) AS known) FROM k))"""


@query("U02_sequence_ratio", "eval_pairs")
def _(t: Tables):
    return _pairs(t).select("doc_id", "pos", F.round(sequence_ratio("reference", "hypothesis"), 6).alias("ratio"))


@query("U04_word_levenshtein", "eval_pairs", oracle=f"WITH {WER} SELECT doc_id, pos, CAST(round(wer * len(rw)) AS INT) AS edits FROM s UNION ALL SELECT doc_id, pos, 0 FROM v WHERE len(rw) = 0")
def _(t: Tables):
    return _pairs(t).select("doc_id", "pos", ev.word_distance(tx.words(F.col("reference")), tx.words(F.col("hypothesis"))).cast("int").alias("edits"))


@query("A27_cer_wer", "eval_pairs", oracle=f"WITH {WER} SELECT doc_id, pos, round(cer, 6) AS cer, round(wer, 6) AS wer FROM s UNION ALL SELECT doc_id, pos, 0, 0 FROM v WHERE len(rw) = 0")
def _(t: Tables):
    return ev.cer_wer(_pairs(t)).select("doc_id", "pos", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


@query("A28_eval_summary", "eval_pairs", oracle=f"WITH {WER} SELECT engine, document_type, count(*) AS samples, CAST(round(CAST(sum(CAST(round(cer, 4) AS DECIMAL(18,4))) / count(*) AS DECIMAL(18,9)), 4) AS DOUBLE) AS mean_cer, CAST(round(CAST(sum(CAST(round(wer, 4) AS DECIMAL(18,4))) / count(*) AS DECIMAL(18,9)), 4) AS DOUBLE) AS mean_wer FROM (SELECT engine, document_type, cer, wer FROM s UNION ALL SELECT engine, document_type, 0, 0 FROM v WHERE len(rw) = 0) GROUP BY 1, 2")
def _(t: Tables):
    return ev.eval_summary(ev.cer_wer(_pairs(t)), "engine", "document_type")


def _documents(t: Tables):
    """Whole texts and a misread copy: letters taken for others, and every ninth line lost."""
    lines = F.filter(F.split("text", "\n"), lambda x, i: i % 9 != 4)
    d = t["documents"].where("text IS NOT NULL").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return d.select("doc_id", F.col("source").alias("document_type"), F.when(F.col("doc_id") % 2 == 0, "paddle").otherwise("unlimited").alias("engine"), F.col("text").alias("reference"), F.translate(F.array_join(lines, "\n"), "eo", "ac").alias("hypothesis"))


@query("A27_document_cer_wer", "documents")
def _(t: Tables):
    return ev.cer_wer(_documents(t)).select("doc_id", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


@query("A28_document_summary", "documents")
def _(t: Tables):
    return ev.eval_summary(ev.cer_wer(_documents(t)), "engine", "document_type")


@query("U04_document_word_edits", "documents")
def _(t: Tables):
    return _documents(t).select("doc_id", ev.word_distance(tx.words(F.col("reference")), tx.words(F.col("hypothesis"))).alias("edits"))


@query("J08_pair_eval", "conversations", "documents", oracle="SELECT d.doc_id, md5(string_agg(c.text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM documents d JOIN conversations c ON c.conv_id = d.doc_id GROUP BY 1")
def _(t: Tables):
    pages = t["conversations"].select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return ev.pair_eval(t["documents"].select("doc_id"), pages).select("doc_id", F.md5(F.col("hypothesis").cast("binary")).alias("digest"))


_SCORED = "SELECT doc_id, length(text) / 4 AS latency_ms, length(text) % 7 / 10 AS confidence, CASE WHEN doc_id % 4 > 0 THEN doc_id % 9 / 10 END AS f1 FROM documents"


@query("J11_engine_delta", "documents", oracle=f"WITH a AS ({_SCORED}) SELECT count(*) AS documents, round(avg(latency_ms), 4) AS raw_avg_latency_ms, round(avg(latency_ms * 2), 4) AS new_avg_latency_ms, round(avg(confidence), 4) AS raw_avg_confidence, round(avg(confidence + 0.1), 4) AS new_avg_confidence, round(avg(f1), 4) AS raw_avg_f1, round(avg(f1 / 2), 4) AS new_avg_f1 FROM a")
def _(t: Tables):
    i = F.col("doc_id")
    n = F.length("text")
    a = t["documents"].select("doc_id", (n / 4).alias("latency_ms"), (n % 7 / 10).alias("confidence"), F.when(i % 4 > 0, i % 9 / 10).alias("f1"))
    b = a.select("doc_id", (F.col("latency_ms") * 2).alias("latency_ms"), (F.col("confidence") + 0.1).alias("confidence"), (F.col("f1") / 2).alias("f1"))
    m = ("latency_ms", "confidence", "f1")
    return ev.delta_summary(ev.engine_delta(a, b, m), m)


@query("J12_canary_compare", "eval_pairs", oracle="""
WITH p AS (SELECT engine, avg(CAST(i % 50 = 1 AS INT)) AS failed, avg(CAST(i % 30 = 3 AS INT)) AS fallback, avg(CAST(i % 200 = 5 AS INT)) AS flagged, count(*) FILTER (WHERE trim(reference) = '') AS empty, quantile_cont((i % 300 + n) * CASE engine WHEN 'unlimited' THEN 3 ELSE 1 END, 0.95) AS p95
  FROM (SELECT *, doc_id + pos AS i, length(reference) AS n FROM eval_pairs) GROUP BY 1)
SELECT y.engine, round(y.failed, 6) AS failed, round(y.p95, 4) AS p95, y.failed - x.failed > 0.005 AS breach_failure, y.fallback > 0.05 AS breach_fallback, y.flagged > 0.01 AS breach_flags, y.p95 > 2 * x.p95 AS breach_latency, y.empty > 0 AS breach_empty FROM p y, p x WHERE y.engine = 'unlimited' AND x.engine = 'paddle'""")
def _(t: Tables):
    i = F.col("doc_id") + F.col("pos")
    d = t["eval_pairs"].select("engine", (i % 50 == 1).alias("failed"), (i % 30 == 3).alias("fallback"), (i % 200 == 5).alias("flagged"), (F.trim("reference") == "").alias("empty"), ((i % 300 + F.length("reference")) * F.when(F.col("engine") == "unlimited", 3).otherwise(1)).alias("latency_ms"))
    return ev.canary_compare(d, "paddle", "unlimited").select("engine", F.round("failed", 6).alias("failed"), F.round("p95", 4).alias("p95"), "breach_failure", "breach_fallback", "breach_flags", "breach_latency", "breach_empty")


def _markup(t: Tables):
    box = F.concat(F.lit("["), F.concat_ws(", ", *(F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2"))), F.lit("]"))
    k = F.col("doc_id") % 3
    piece = F.when(k == 0, F.concat(F.lit("<BLOCK>title<LEVEL2>"), box, F.lit("<FORK>"), "text")).when(k == 1, F.concat(F.lit("<|ref|>Table<|/ref|><|det|>["), box, F.lit("]<|/det|>\n"), "text", F.lit("\n"))).otherwise(F.concat(F.lit("<|det|>caption "), box, F.lit("<|/det|>"), "text", F.lit("\n")))
    per = t["blocks"].groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("idx", piece.alias("p")))).alias("q"))
    return per.select("doc_id", "page_no", F.array_join(F.transform("q", lambda x: x["p"]), "").alias("raw"), F.lit(999).alias("width"), F.lit(5000).alias("height"))


@query("F23_parse_markup", "blocks", oracle="""
SELECT doc_id, idx AS text_group, CASE WHEN x2 <= x1 OR least(y2 / 999.0 * 5000, 5000.0) <= least(y1 / 999.0 * 5000, 5000.0) OR least(x2, 999.0) <= x1 THEN 0.0 ELSE x1 END AS x1, CASE doc_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'table' ELSE 'caption' END AS region_class, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 0 END AS hierarchy_level FROM blocks""")
def _(t: Tables):
    return qu.parse_markup(_markup(t)).select("doc_id", F.col("text_group").cast("long").alias("text_group"), F.round("x1", 6).alias("x1"), "region_class", "hierarchy_level")


@query("F23_plain_text", "blocks", oracle="SELECT doc_id, string_agg(trim(text), chr(10) ORDER BY idx) AS text FROM blocks WHERE trim(text) <> '' GROUP BY 1")
def _(t: Tables):
    return qu.plain_text(qu.parse_markup(_markup(t))).select("doc_id", "text")


@query("W18_block_fallback_pick", "blocks", oracle="""
WITH v AS (SELECT doc_id, idx % 2 AS page_no, idx % 5 AS variant_idx, avg(confidence) AS c, count(*) FILTER (WHERE idx % 7 > 1) AS n FROM blocks GROUP BY ALL)
SELECT doc_id, page_no, coalesce(min(variant_idx) FILTER (WHERE c >= 0.72), arg_min(variant_idx, (1 - c) * 1000000 + variant_idx / 1000)) AS variant_idx FROM v WHERE n > 0 GROUP BY 1, 2""")
def _(t: Tables):
    v = t["blocks"].groupBy("doc_id", (F.col("idx") % 2).alias("page_no"), (F.col("idx") % 5).alias("variant_idx")).agg(F.avg("confidence").alias("confidence"), F.count(F.when(F.col("idx") % 7 > 1, 1)).alias("n_blocks"))
    return qu.pick_variant(v)


@query("P15_routing_gates", "blocks", oracle="SELECT doc_id, idx, CASE WHEN idx % 4 = 0 THEN 'paddle' WHEN idx % 4 = 1 AND lang IN ('de', 'fr') THEN 'unlimited' WHEN idx % 4 = 2 THEN 'unlimited' ELSE 'paddle' END AS engine, lang IN ('de', 'fr') AND confidence < 0.6 AS again, lang IN ('de', 'fr') AS correct FROM blocks")
def _(t: Tables):
    want = F.element_at(F.array(*(F.lit(x) for x in ("paddle", "auto", "Unlimited", ""))), (F.col("idx") % 4 + 1).cast("int"))
    return qu.route_pages(t["blocks"].withColumn("requested", want), True, ("de", "fr"), 0.6).select("doc_id", "idx", "engine", "again", "correct")


@query("T04_stable_sort", "blocks", oracle="SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY (x2 - x1) * (y2 - y1) DESC, y1, x1, idx) AS INT) AS place FROM blocks")
def _(t: Tables):
    from pyspark.sql import Window

    return t["blocks"].select("doc_id", "idx", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(geo.area(geo.box())), "y1", "x1", "idx")).alias("place"))
