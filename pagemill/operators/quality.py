"""Output quality, confidence, corrections, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from ..functions.pandas_udfs import sequence_reaches, unified_diff

#: Fixed values.
NGRAM, MAX_CHARS, MAX_ROWS, MAX_LINES, MAX_NGRAMS = 35, 40_000, 200, 0.4, 0.05
SIMILARITY, BOOST = 0.55, 0.90
LABELS = {
    "title": ("title", 1), "headline": ("title", 1), "heading": ("heading", 2), "section": ("heading", 2), "subheading": ("subheading", 3), "table": ("table", 0), "formula": ("formula", 0), "equation": ("formula", 0), "math": ("formula", 0),
    "figure": ("figure", 0), "image": ("figure", 0), "chart": ("figure", 0), "header": ("annotation", 0), "footer": ("annotation", 0), "page_number": ("annotation", 0), "footnote": ("annotation", 0), "caption": ("caption", 0),
}
KEPT_LABELS = ("title", "heading", "text", "table", "formula", "image", "caption", "body")


#: Everything that ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def repeated_line_ratio(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, LINE_END), tx.trimmed), lambda x: x != "")
    n = F.size(lines)
    return F.when(n < 3, 0.0).otherwise((n - F.size(F.array_distinct(lines))) / n)


def _runs(h: Column, n: int, step: int = 1) -> Column:
    """A hash of the elements i, i + step, ... (n of them) for every place i of an array that has them all."""
    last = F.size(h) - (n - 1) * step
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), lambda i: F.xxhash64(*(F.get(h, i + k * step) for k in range(n))))


def ngram_repetition(c: Column, n: int = NGRAM) -> Column:
    """Share of the runs of n words that have occurred before in the text: computed in the row, from hashes of short runs of words."""
    inner = max(k for k in range(1, int(n**0.5) + 1) if n % k == 0)

    def of(h: Column) -> Column:
        grams = tx.once(_runs(h, inner), lambda short: _runs(short, n // inner, inner))
        return F.when(F.size(h) < n, 0.0).otherwise(tx.once(grams, lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)))

    return tx.once(F.transform(tx.words(c), lambda w: F.xxhash64(w)), of)


def page_quality(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ratios, table rows, characters, degenerate, markup leak, warnings. One row out for each row in."""
    d = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_c")).withColumn("repetition_ratio", ngram_repetition(F.col("_c")))
    d = d.withColumns({"repeated_line_ratio": repeated_line_ratio(F.col("_c")), "table_rows": F.regexp_count("_c", F.lit("<tr")), "char_count": F.length("_c"), "markup_leak": F.col("_c").rlike(r"<\|ref\|>|<\|det\|>|<BLOCK>|<FORK>")})
    bad = (F.col("char_count") > MAX_CHARS) | (F.col("table_rows") > MAX_ROWS) | (F.col("repeated_line_ratio") > MAX_LINES) | (F.col("repetition_ratio") > MAX_NGRAMS)
    d = d.withColumn("degenerate", bad)
    notes = F.array_compact(F.array(F.when(F.col("repetition_ratio") > MAX_NGRAMS, F.lit("possible repeated output detected")), F.when(F.col("degenerate"), F.lit("degenerate output detected")), F.when(F.col("markup_leak"), F.lit("unparsed grounding markers"))))
    return d.select(key, "repeated_line_ratio", "repetition_ratio", "table_rows", "char_count", "markup_leak", "degenerate", notes.alias("warnings"))


def confidence_means(blocks: DataFrame) -> DataFrame:
    """Per document: the mean over all blocks, and over those above 0; 0 without any."""
    c = F.col("confidence")
    return blocks.groupBy("doc_id").agg(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias("mean_all"), F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)).alias("mean_positive"))


def page_means(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page_no").agg(F.round(F.avg("confidence"), 4).alias("page_mean"))


def pooled_means(pages: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """A page counts with its own value if above 0, else with its blocks above 0; without any, the document's value."""
    own = pages.where("confidence > 0").select("doc_id", "confidence")
    rest = pages.where("NOT coalesce(confidence > 0, false)").select("doc_id", "page_no")
    inner = blocks.where("confidence > 0").join(rest, ["doc_id", "page_no"], "left_semi").select("doc_id", "confidence")
    pool = own.unionByName(inner).groupBy("doc_id").agg(F.avg("confidence").alias("_m"))
    return documents.join(pool, "doc_id", "left").select("doc_id", F.coalesce("_m", F.when(F.col("confidence") > 0, F.col("confidence")), F.lit(0.0)).alias("confidence"))


def correction_stats(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, raw, corrected, confidence) -> counts for each key (doc_id if none is given); lines that changed too much are rejected."""
    keys = keys or ("doc_id",)
    changed = F.col("raw") != F.col("corrected")
    d = lines.withColumn("alike", sequence_reaches(F.col("raw"), F.col("corrected"), SIMILARITY))
    ok = changed & F.col("alike")
    after = F.when(ok, F.least(F.lit(1.0), F.greatest(F.col("confidence"), F.lit(BOOST)))).otherwise(F.col("confidence"))
    delta = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg(after) - F.avg("confidence")))
    per = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("considered_blocks"), F.count(F.when(ok, 1)).alias("corrected_blocks"), F.count(F.when(changed & ~ok, 1)).alias("rejected_lines"),
        F.coalesce(F.sum(F.when(ok, tx.changed_chars(F.col("raw"), F.col("corrected")))), F.lit(0)).alias("changed_characters"), F.round(delta, 4).alias("confidence_delta"),
    )
    return per.withColumn("reason", F.when(F.col("corrected_blocks") > 0, "ok").otherwise("no_changes"))


SUMS = ("considered_blocks", "corrected_blocks", "rejected_lines", "changed_characters", "confidence_delta")


def running(rows: DataFrame, order: str, values: tuple[str, ...], size: int = 10_000) -> DataFrame:
    """Adds ``running_<value>``: sums up to each row in the order of a whole number that is unique.

    Slices of ``size`` numbers are summed first, and their sums carried from slice to slice (one row for each), so no task holds more than a
    slice. Rows without a number come first, as a slice of their own.
    """
    d = rows.withColumn("_slice", F.coalesce(F.floor(F.col(order) / size), F.lit(-(2**62))))
    w = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("_slice").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    carried = sums.select(F.col("_slice").alias("_of"), *(F.coalesce(F.sum(f"_s_{v}").over(w), F.lit(0)).alias(f"_c_{v}") for v in values))
    inner = Window.partitionBy("_slice").orderBy(order)
    d = d.join(carried, F.col("_slice") == F.col("_of"))
    return d.select(*rows.columns, *((F.col(f"_c_{v}") + F.sum(v).over(inner.rowsBetween(Window.unboundedPreceding, 0))).alias(f"running_{v}") for v in values))


def correction_totals(lines: DataFrame) -> DataFrame:
    """Corrections of pages (doc_id, page_no), of documents, and over all documents up to each one: level, doc_id, page_no and the sums.

    A document's sums are those of its pages, whose changes of confidence are rounded to 4 places before and after; so are the running ones.
    """
    page = correction_stats(lines, "doc_id", "page_no")
    total = [F.round(F.sum(c), 4).alias(c) if c == "confidence_delta" else F.sum(c).alias(c) for c in SUMS]
    document = page.groupBy("doc_id").agg(*total)
    so_far = running(document, "doc_id", SUMS).select("doc_id", *(F.round(f"running_{c}", 4).alias(c) if c == "confidence_delta" else F.col(f"running_{c}").alias(c) for c in SUMS))
    none = F.lit(None).cast(dict(lines.dtypes)["page_no"]).alias("page_no")
    levels = [page.select(F.lit("page").alias("level"), "doc_id", "page_no", *SUMS)]
    levels += [d.select(F.lit(name).alias("level"), "doc_id", none, *SUMS) for name, d in (("document", document), ("running", so_far))]
    out = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return out.withColumn("reason", F.when(F.col("corrected_blocks") > 0, "ok").otherwise("no_changes"))


def correction_diff(lines: DataFrame) -> DataFrame:
    return lines.withColumn("diff", unified_diff("raw", "corrected"))


def label_region(label: Column) -> Column:
    low, out = F.lower(tx.trimmed(label)), F.struct(F.lit("body").alias("region_class"), F.lit(0).alias("hierarchy_level"))
    for name, (region, level) in LABELS.items():
        out = F.when(low == name, F.struct(F.lit(region).alias("region_class"), F.lit(level).alias("hierarchy_level"))).otherwise(out)
    return out


def _before(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def _after(c: Column, mark: str) -> Column:
    """What follows the first mark; null without one."""
    return F.when(c.contains(mark), F.substr(c, F.length(_before(c, mark)) + len(mark) + 1))


def _groups(raw: Column, form: str, opening: str, fields) -> Column:
    """The text groups of one form: the pieces after each opening mark whose ``fields`` (label, level, box, text) are all there."""
    cut = F.split(raw, opening.replace("|", r"\|"))
    pieces = F.transform(F.slice(cut, F.lit(2), F.size(cut) - 1), lambda x: F.struct(*(c.alias(n) for n, c in zip(("label", "level", "box", "text"), fields(x), strict=True))))
    whole = F.filter(pieces, lambda x: (x["label"] != "") & x["level"].isNotNull() & x["box"].isNotNull() & x["text"].isNotNull())
    return F.transform(whole, lambda x: F.struct(F.lit(form).alias("form"), x["label"].alias("label"), x["level"].alias("level"), x["box"].alias("box"), tx.trimmed(x["text"]).alias("text")))


def _block_fields(x: Column) -> tuple[Column, ...]:
    """label<LEVELn>[box]<FORK>text"""
    head = _before(x, "<FORK>")
    level = F.coalesce(_before(_after(head, "<LEVEL"), ">"), F.lit(""))
    return F.trim(_before(_before(head, "["), "<LEVEL")), level, F.concat(F.lit("["), _before(_after(head, "["), "]"), F.lit("]")), _after(x, "<FORK>")


def _ref_fields(x: Column) -> tuple[Column, ...]:
    """label<|/ref|><|det|>boxes<|/det|>text, up to the next box"""
    det = _after(_after(x, "<|/ref|>"), "<|det|>")
    return _before(x, "<|/ref|>"), F.lit(""), _before(det, "<|/det|>"), _before(_after(det, "<|/det|>"), "<|det|>")


def _det_fields(x: Column) -> tuple[Column, ...]:
    """label boxes<|/det|>text"""
    inner = F.split(tx.trimmed(_before(x, "<|/det|>")), r"\s+", 2)
    return F.get(inner, F.lit(0)), F.lit(""), F.coalesce(F.get(inner, F.lit(1)), F.lit("")), _after(x, "<|/det|>")


def parse_markup(raw: DataFrame) -> DataFrame:
    """(doc_id, page_no, raw, width, height) -> blocks. Forms in order of priority: BLOCK/FORK, ref/det, bare det, plain text.

    A text is cut at the opening marks of a form, and each piece at its inner marks; pieces that lack one are left out. Several boxes share
    one text group; a group without a usable box spans the page.
    """
    r = F.coalesce(F.col("raw"), F.lit(""))
    blocks, refs, dets = _groups(r, "block", "<BLOCK>", _block_fields), _groups(r, "ref", "<|ref|>", _ref_fields), _groups(r, "det", "<|det|>", _det_fields)
    plain = F.when(tx.trimmed(r) != "", F.array(F.struct(F.lit("plain").alias("form"), F.lit("text").alias("label"), F.lit("").alias("level"), F.lit("").alias("box"), tx.trimmed(r).alias("text")))).otherwise(F.slice(refs, 1, 0))
    v2 = r.contains("<BLOCK>") & r.contains("<FORK>")
    chosen = F.when(v2, blocks).when(F.size(refs) > 0, refs).when(F.size(dets) > 0, dets).otherwise(plain)
    d = raw.select("doc_id", "page_no", "width", "height", F.posexplode(chosen).alias("text_group", "g"))
    scaled = F.filter(F.transform(geo.parse_boxes(F.col("g.box")), lambda b: geo.scale(b, F.col("width"), F.col("height"))), lambda b: b.isNotNull())
    whole = F.array(F.array(F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double")))
    d = d.withColumn("boxes", F.when(F.size(scaled) > 0, scaled).otherwise(whole)).select("doc_id", "page_no", "text_group", "g", F.posexplode("boxes").alias("k", "b"))
    region = label_region(F.col("g.label"))
    kept = (F.col("g.form") == "ref") & F.lower(tx.trimmed(F.col("g.label"))).isin(*KEPT_LABELS)
    level = F.nullif(F.coalesce(F.nullif("g.level", F.lit("")).cast("int"), F.lit(0)), F.lit(0))
    order = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("text_group", "k"))
    return d.select(
        "doc_id", "page_no", "text_group", F.col("g.text").alias("text"), *(F.element_at("b", i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"), 1)),
        F.when(kept, F.lower(tx.trimmed(F.col("g.label")))).otherwise(region["region_class"]).alias("region_class"), F.coalesce(level, region["hierarchy_level"]).alias("hierarchy_level"), order.alias("reading_order"),
    )


def plain_text(blocks: DataFrame) -> DataFrame:
    """Each text group once, joined by line breaks."""
    one = blocks.groupBy("doc_id", "page_no", "text_group").agg(F.first("text").alias("text")).where("text <> ''")
    per = one.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("text_group", "text"))).alias("_t"))
    return per.select("doc_id", "page_no", F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("text"))


def pick_variant(variants: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(doc_id, page_no, variant_idx, confidence, n_blocks): the first that reaches the threshold, else the surest, the earliest on ties."""
    d = variants.where("n_blocks > 0")
    first = F.min(F.when(F.col("confidence") >= threshold, F.col("variant_idx")))
    best = F.min_by("variant_idx", F.struct((-F.col("confidence")).alias("c"), "variant_idx"))
    return d.groupBy("doc_id", "page_no").agg(F.coalesce(first, best).alias("variant_idx"))


def route_pages(pages: DataFrame, enabled: bool, langs: tuple[str, ...], threshold: float, mode: str = "layout", override: bool | None = None) -> DataFrame:
    """(requested, lang, confidence) -> engine, whether to process again, and whether to correct."""
    lang = F.lower(F.trim(F.coalesce("lang", F.lit(""))))
    allowed = lang.isin(*langs) & F.lit(enabled)
    want = F.lower(F.trim(F.coalesce("requested", F.lit(""))))
    engine = F.when(want.isin("paddle", "unlimited"), want).when((want == "auto") & allowed, "unlimited").otherwise("paddle")
    correct = F.lit(override) if override is not None else allowed & F.lit(mode in ("layout", "ocr_only"))
    return pages.withColumns({"engine": engine, "again": allowed & (F.col("confidence") < threshold), "correct": correct})
