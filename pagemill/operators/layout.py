"""Layout blocks: validity, columns, reading order, regions, matching, suppression.

Blocks: doc_id, page_no, idx, text, confidence, x1, y1, x2, y2, lang. Work is per page, whose blocks fit one row. Boxes of a page
that may overlap are found by grids (see :func:`box_pairs`), not by comparing all of them. A null document or page number is a page like
others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx

PAGE = ["doc_id", "page_no"]
#: Fixed values.
ENSEMBLE_IOU, DETECTION_IOU = 0.3, 0.5
MAX_OVERLAP, NEARBY = 0.45, 30
CODE = r"(?U)^[\w\s.,;:!?()\[\]{}=+\-*/\\|#@&%^<>~`\"']+$"


def validate_blocks(blocks: DataFrame) -> DataFrame:
    """Per page: valid, and the places of the blocks that are not. One bad block rejects the page."""
    b = geo.box()
    good = geo.finite(b[0]) & geo.finite(b[1]) & geo.finite(b[2]) & geo.finite(b[3]) & (b[2] > b[0]) & (b[3] > b[1])
    per = blocks.withColumn("_ok", F.coalesce(good, F.lit(False))).groupBy(*PAGE).agg(F.bool_and("_ok").alias("valid"), F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.col("idx")))).alias("bad"))
    return per


def renderable(blocks: DataFrame) -> DataFrame:
    b = geo.box()
    return blocks.where(geo.finite(b[0]) & geo.finite(b[1]) & geo.finite(b[2]) & geo.finite(b[3]) & (F.abs(b[2] - b[0]) >= 4) & (F.abs(b[3] - b[1]) >= 4))


def validate_results(results: DataFrame) -> DataFrame:
    """(type, text, pages, blocks): a PDF needs text or pages, an image needs blocks."""
    pdf = (F.coalesce(F.trim("text"), F.lit("")) != "") | (F.coalesce("pages", F.lit(0)) > 0)
    return results.withColumn("valid", F.when(F.col("type") == "pdf", pdf).otherwise(F.coalesce("blocks", F.lit(0)) > 0))


def detect_columns(blocks: DataFrame, width: Column | None = None) -> DataFrame:
    """column_id: number of wide gaps between distinct x-centres that lie left of the block; 0 without coordinates."""
    d = blocks.withColumn("_c", (F.col("x1") + F.col("x2")) / 2)
    width = width if width is not None else F.max("x2").over(Window.partitionBy(*PAGE))
    d = d.withColumn("_gap", F.greatest(F.lit(20.0), width * 0.08))
    w = Window.partitionBy(*PAGE).orderBy("_c")
    d = d.withColumn("_b", F.when(F.col("_c") - F.lag("_c").over(w) >= F.col("_gap"), 1).otherwise(0))
    # blocks of one centre are peers, so they share the sum
    return d.withColumn("column_id", F.sum("_b").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_c", "_gap", "_b")


def reading_order_ltr(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy("column_id", "y1", "x1", "idx")))


def reading_order(blocks: DataFrame) -> DataFrame:
    """By lang: left to right by column, top, left; right to left by columns from the right and rows of overlapping blocks.

    A block joins the first row whose span it overlaps, and widens it; blocks come by top, then from the right.
    """
    rtl = tx.is_rtl_lang(F.col("lang"))
    straight = reading_order_ltr(blocks.where(~rtl))
    item = F.struct("y1", (-F.col("x1")).alias("nx"), "idx", "y2")
    per = blocks.where(rtl).groupBy(*PAGE, "column_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.expr("named_struct('rows', CAST(array() AS array<struct<y1:double,y2:double>>), 'out', CAST(array() AS array<struct<idx:bigint,row:int>>))")

    def step(acc: Column, b: Column) -> Column:
        meets = F.transform(acc["rows"], lambda r: F.least(b["y2"], r["y2"]) - F.greatest(b["y1"], r["y1"]) > 0)
        at = F.array_position(meets, True).cast("int")
        grown = F.transform(acc["rows"], lambda r, i: F.when(i + 1 == at, F.struct(F.least(r["y1"], b["y1"]).alias("y1"), F.greatest(r["y2"], b["y2"]).alias("y2"))).otherwise(r))
        rows = F.when(at > 0, grown).otherwise(F.concat(acc["rows"], F.array(F.struct(b["y1"].alias("y1"), b["y2"].alias("y2")))))
        row = F.when(at > 0, at).otherwise(F.size(acc["rows"]) + 1)
        return F.struct(rows.alias("rows"), F.concat(acc["out"], F.array(F.struct(b["idx"].alias("idx"), row.alias("row")))).alias("out"))

    folded = per.withColumn("f", F.aggregate("items", zero, step))
    placed = folded.select(*PAGE, "column_id", F.expr("inline(transform(f.out, o -> struct(o.idx AS idx, o.row AS row_id, element_at(f.rows, o.row).y1 AS row_y)))"))
    d = blocks.where(rtl).join(placed, [*PAGE, "column_id", "idx"])
    w = Window.partitionBy(*PAGE).orderBy(F.desc("column_id"), "row_y", "row_id", F.desc("x1"), "y1", "idx")
    return straight.unionByName(d.withColumn("reading_order", F.row_number().over(w)).drop("row_id", "row_y"))


def classify_region(blocks: DataFrame) -> DataFrame:
    """region_class and hierarchy_level, by the page's extent and its upper-median height of blocks with text."""
    text = tx.trimmed(F.col("text"))
    h = F.col("y2") - F.col("y1")
    page = blocks.groupBy(*PAGE).agg(F.max("x2").alias("_w"), F.max("y2").alias("_h"), F.array_sort(F.collect_list(F.when(text != "", h))).alias("_hs"))
    page = page.withColumn("_m", F.try_element_at("_hs", F.floor(F.size("_hs") / 2).cast("int") + 1)).drop("_hs")
    size = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1000.0)
    d = joined(blocks, page, PAGE).withColumns({"_w": size("_w"), "_h": size("_h"), "_t": text}).withColumns({"_n": F.length("_t"), "_f": h, "_m": F.coalesce("_m", h)})
    n, f, m, y = F.col("_n"), F.col("_f"), F.col("_m"), F.col("y1") / F.col("_h")
    wide = (F.col("x2") - F.col("x1")) / F.col("_w")
    t = F.col("_t")
    code = n.between(3, 120) & (t.rlike(r"[=(){}\[\];]") | t.startswith("//") | t.startswith("#")) & t.rlike(CODE)
    digits = F.length(F.regexp_replace(t, r"[^\p{Nd}.,|%]", "")) / F.greatest(n, F.lit(1))
    kind = (
        F.when(code, "code:0")
        .when((n <= 40) & (t.endswith(":") | t.endswith("：")), "form_field:0")
        .when((f / F.col("_h") < 0.015) & (y > 0.85), "annotation:0")
        .when((n <= 80) & (y > 0.75) & (f <= m * 0.85), "caption:0")
        .when((wide > 0.7) & (n <= 60) & (digits > 0.4), "table:0")
        .when((f >= m * 1.6) & (y < 0.25) & (wide > 0.4) & (n <= 120), "title:1")
        .when((f >= m * 1.3) & (n <= 120) & (wide > 0.4), "heading:2")
        .when((f >= m * 1.1) & (n <= 80), "heading:3")
        .otherwise("body:0")
    )
    parts = F.split(kind, ":")
    return d.withColumn("region_class", parts[0]).withColumn("hierarchy_level", parts[1].cast("int")).drop("_w", "_h", "_t", "_n", "_f", "_m")


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins with keys in which nulls are equal; one copy of the keys stays, that of ``a``."""
    other = b.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    if how == "full_outer":
        both = a.withColumn("_left", F.lit(True)).join(other, on, how)
        return both.withColumns({k: F.when(F.col("_left"), F.col(k)).otherwise(F.col(f"_key_{k}")) for k in keys}).drop("_left", *(f"_key_{k}" for k in keys))
    return a.join(other, on, how).drop(*(f"_key_{k}" for k in keys))


def box_pairs(a: DataFrame, b: DataFrame | None = None, reach: float = 0.0) -> DataFrame:
    """Pairs of boxes of one page that meet when each is drawn wider by ``reach``: the columns of a as a_*, those of b as b_*.

    Without ``b``, pairs of boxes of ``a``, a box with itself too. Boxes must have all coordinates and no side below 0. A page has grids
    of cells that grow fourfold from its mean box on; a box is at home in the first grid whose cells are not smaller than it, so it lies in
    four of them at most. It is also entered in the coarser grids of its page, up to the largest box, and two boxes meet in the coarser one of
    their homes: in the cell of their common top left corner, once. Boxes cross the network once, by page; cells are groups within its task.
    """
    corners = (("x1", -1), ("y1", -1), ("x2", 1), ("y2", 1))
    kept = lambda d: [c for c in d.columns if c not in PAGE]
    entry = lambda d, side: d.select(*PAGE, F.struct(*kept(d)).alias(side), *((F.col(c) + sign * reach).alias(f"g{c}") for c, sign in corners))
    d = entry(a, "a") if b is None else entry(a, "a").unionByName(entry(b, "b"), allowMissingColumns=True)
    d = d.withColumns({"w": F.col("gx2") - F.col("gx1"), "h": F.col("gy2") - F.col("gy1")})
    page = Window.partitionBy(*PAGE)
    cell = {f"m{c}": F.avg(c).over(page) for c in "wh"} | {f"top_{c}": F.max(c).over(page) for c in "wh"}
    d = d.withColumns(cell).withColumns({f"m{c}": F.when(F.col(f"m{c}") > 0, F.col(f"m{c}")).otherwise(1.0) for c in "wh"})
    grid = lambda w, h: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(w) / F.col("mw"), F.col(h) / F.col("mh"), F.lit(1.0))) / 2).cast("int"))
    d = d.withColumn("home", grid("w", "h")).withColumn("level", F.explode(F.sequence("home", grid("top_w", "top_h"))))
    at = lambda c, m: F.floor(c / (F.col(m) * F.pow(F.lit(4.0), F.col("level"))))
    d = d.withColumn("cx", F.explode(F.sequence(at(F.col("gx1"), "mw"), at(F.col("gx2"), "mw")))).withColumn("cy", F.explode(F.sequence(at(F.col("gy1"), "mh"), at(F.col("gy2"), "mh"))))
    entered = lambda side: F.collect_list(F.when(F.col(side).isNotNull(), F.struct("home", "gx1", "gy1", "gx2", "gy2", F.col(side).alias("box"))))
    sides = ["a"] if b is None else ["a", "b"]
    d = d.groupBy(*PAGE, "level", "cx", "cy").agg(F.first("mw").alias("mw"), F.first("mh").alias("mh"), *(entered(c).alias(c) for c in sides))
    # one of the two is at home in this grid: those at home meet all, the others meet those at home
    first, other = F.col("a"), F.col(sides[-1])
    home = lambda x: x["home"] == F.col("level")
    parts = F.array(F.struct(F.filter(first, home).alias("i"), other.alias("j")), F.struct(F.filter(first, lambda x: ~home(x)).alias("i"), F.filter(other, home).alias("j")))
    d = d.select(*PAGE, "level", "cx", "cy", "mw", "mh", F.inline(parts)).withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))
    d = d.where((at(F.greatest("i.gx1", "j.gx1"), "mw") == F.col("cx")) & (at(F.greatest("i.gy1", "j.gy1"), "mh") == F.col("cy")))
    meet = lambda s, t: (F.col(f"{s}.gx1") <= F.col(f"{t}.gx2")) & (F.col(f"{s}.gy1") <= F.col(f"{t}.gy2"))
    out = lambda d, side, at: [F.col(c if c in PAGE else f"{at}.box.{c}").alias(f"{side}_{c}") for c in d.columns]
    return d.where(meet("i", "j") & meet("j", "i")).select(*out(a, "a", "i"), *out(a if b is None else b, "b", "j"))


def _is_proper() -> Column:
    """Four finite coordinates and an area."""
    b = geo.box()
    return F.coalesce(geo.finite(b[0]) & geo.finite(b[1]) & geo.finite(b[2]) & geo.finite(b[3]) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))


def _proper(blocks: DataFrame) -> DataFrame:
    return blocks.where(_is_proper())


def greedy_matches(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """One-to-one matches per page (a_idx, b_idx, iou): each a in order takes the best b left, ties to the lower b. ``least`` is above 0."""
    cols = [*PAGE, "idx", "x1", "y1", "x2", "y2"]
    pairs = box_pairs(_proper(a).select(*cols), _proper(b).select(*cols)).withColumn("iou", geo.iou(geo.box("a_"), geo.box("b_"))).where(F.col("iou") >= least)
    pairs = pairs.select(*(F.col(f"a_{c}").alias(c) for c in PAGE), "a_idx", "b_idx", "iou")
    item = F.struct("a_idx", (-F.col("iou")).alias("neg"), "b_idx")
    per = pairs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("c"))
    zero = F.expr("named_struct('last', CAST(NULL AS BIGINT), 'used', CAST(array() AS array<bigint>), 'out', CAST(array() AS array<struct<a_idx:bigint,b_idx:bigint,iou:double>>))")

    def step(acc: Column, x: Column) -> Column:
        take = ~acc["last"].eqNullSafe(x["a_idx"]) & ~F.array_contains(acc["used"], x["b_idx"])
        match = F.struct(x["a_idx"].alias("a_idx"), x["b_idx"].alias("b_idx"), (-x["neg"]).alias("iou"))
        new = F.struct(x["a_idx"].alias("last"), F.concat(acc["used"], F.array(x["b_idx"])).alias("used"), F.concat(acc["out"], F.array(match)).alias("out"))
        return F.when(take, new).otherwise(acc)

    return per.select(*PAGE, F.inline(F.aggregate("c", zero, step)["out"]))


def ensemble_merge(a: DataFrame, b: DataFrame, least: float = ENSEMBLE_IOU) -> DataFrame:
    """Blocks of two engines: of a match the surer one (a on ties), the rest of both; ordered by top and left."""
    m = greedy_matches(a, b, least).select(*PAGE, "a_idx", "b_idx")
    cols = [*PAGE, "idx", "text", "confidence", "x1", "y1", "x2", "y2"]
    bb = b.select(*PAGE, F.col("idx").alias("b_idx"), *(F.col(c).alias(f"_{c}") for c in cols[3:]))
    left = joined(joined(a.select(*cols), m.withColumnRenamed("a_idx", "idx"), [*PAGE, "idx"], "left"), bb, [*PAGE, "b_idx"], "left")
    other = F.coalesce(F.col("_confidence") > F.col("confidence"), F.lit(False))
    won = left.select(*PAGE, F.lit(0).alias("side"), "idx", F.when(other, "b").otherwise("a").alias("engine"), *(F.when(other, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols[3:]))
    rest = joined(b.select(*cols), m.select(*PAGE, F.col("b_idx").alias("idx")), [*PAGE, "idx"], "left_anti")
    every = won.unionByName(rest.withColumns({"side": F.lit(1), "engine": F.lit("b")}))
    return every.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y1", "x1", "side", "idx"))).drop("side")


def block_detection_score(expected: DataFrame, actual: DataFrame, least: float = DETECTION_IOU) -> DataFrame:
    """Per document: counts, precision, recall, F1, mean IoU; null where nothing is expected."""
    m = greedy_matches(expected, actual, least).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean"))
    e = expected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected_count"))
    d = actual.groupBy("doc_id").agg(F.count(F.lit(1)).alias("detected_count"))
    j = joined(joined(e, d, ["doc_id"], "full_outer"), m, ["doc_id"], "left").withColumn("detected_count", F.coalesce("detected_count", F.lit(0))).withColumn("tp", F.coalesce("tp", F.lit(0)))
    p = F.when(F.col("detected_count") > 0, F.col("tp") / F.col("detected_count")).otherwise(0.0)
    r = F.col("tp") / F.col("expected_count")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    has = F.col("expected_count").isNotNull()
    out = {"precision": p, "recall": r, "f1": f1, "mean_iou": F.coalesce("mean", F.lit(0.0))}
    return j.select("doc_id", "expected_count", "detected_count", *(F.when(has, F.round(v, 4)).alias(k) for k, v in out.items()))


def overlap_suppression(blocks: DataFrame, overlap: float = MAX_OVERLAP, distance: float = NEARBY) -> DataFrame:
    """kept per block: boxes by area, top and left; one goes if a kept box covers enough of it, or stands near with the same text.

    Boxes without an area, or without all coordinates, are not kept and suppress none.
    """
    b = blocks.withColumn("_a", geo.area(geo.box()))
    boxes = _proper(b).select(*PAGE, "idx", "_a", tx.loose(F.col("text")).alias("_t"), "x1", "y1", "x2", "y2")
    boxes = boxes.withColumn("_r", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("_a"), "y1", "x1", "idx")))
    i, j = geo.box("a_"), geo.box("b_")
    same = (F.col("a__t") != "") & (F.col("b__t") != "") & (F.col("a__t").contains(F.col("b__t")) | F.col("b__t").contains(F.col("a__t")))
    hit = (geo.intersection(i, j) / F.col("a__a") >= overlap) | (geo.nearby(i, j, distance) & same)
    before = F.col("b__r") < F.col("a__r")
    # a box meets itself, so it has a row without clashes too
    pairs = box_pairs(boxes, reach=distance / 2).where((F.col("b__r") == F.col("a__r")) | (before & hit))
    item = (F.first("a_idx").alias("idx"), F.first("a__a").alias("_a"), F.collect_list(F.when(before, F.col("b__r"))).alias("_x"))
    clash = pairs.groupBy(*(F.col(f"a_{c}").alias(c) for c in PAGE), F.col("a__r").alias("_r")).agg(*item)
    # only boxes that clash are decided one after the other; those without a clash that stand in their way are kept from the start
    per = clash.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.when(F.size("_x") > 0, F.struct("_r", "_x", "_a", "idx")))).alias("q"),
        F.collect_list(F.when(F.size("_x") == 0, F.struct("_r", "_a", "idx"))).alias("clear"),
        F.array_distinct(F.flatten(F.collect_list("_x"))).alias("_named"),
    )
    free = F.transform(F.filter("clear", lambda e: e["_a"] > 0), lambda e: e["_r"])
    zero = F.struct(F.array_intersect(free, "_named").alias("kept"), F.expr("CAST(array() AS array<boolean>)").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        take = (e["_a"] > 0) & ~F.arrays_overlap(acc["kept"], e["_x"])
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(e["_r"]))).otherwise(acc["kept"]).alias("kept"), F.concat(acc["out"], F.array(take)).alias("out"))

    per = per.withColumn("_out", F.aggregate("q", zero, step)["out"])
    decided = F.transform("q", lambda e, k: F.struct(e["idx"].alias("idx"), F.get("_out", k).alias("kept")))
    clear = F.transform("clear", lambda e: F.struct(e["idx"].alias("idx"), (e["_a"] > 0).alias("kept")))
    rest = b.where(~_is_proper()).select(*PAGE, "idx", F.coalesce(F.col("_a") > 0, F.lit(False)).alias("kept"))
    return per.select(*PAGE, F.inline(F.concat(clear, decided))).unionByName(rest)


def lines_to_blocks(pages: DataFrame, confidence: float = 0.85) -> DataFrame:
    """(doc_id, page_no, text, width, height) -> full-width rows of equal height, one per line with text."""
    lines = F.filter(F.transform(F.split("text", "\n"), tx.trimmed), lambda x: x != "")
    d = pages.withColumn("_l", lines).where(F.size("_l") > 0).withColumn("_h", F.greatest(F.col("height"), F.lit(1.0)) / F.size("_l"))
    d = d.select(*PAGE, F.greatest(F.col("width"), F.lit(1.0)).alias("x2"), "_h", F.posexplode("_l").alias("idx", "text"))
    return d.select(*PAGE, "idx", "text", F.lit(confidence).alias("confidence"), F.lit(0.0).alias("x1"), F.round(F.col("idx") * F.col("_h"), 2).alias("y1"), "x2", F.round((F.col("idx") + 1) * F.col("_h"), 2).alias("y2"))
