"""Documents: normalising, chunking, windows, caches, assembly."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Fixed values.
MIN_WORDS, MAX_WORDS = 80, 150
LANG = r"^[a-z]{2,3}(?:-[a-z0-9]{2,8})?$"
MAX_BYTES = 10_000
CACHE_TTL, CHECKPOINT_TTL = timedelta(days=30), timedelta(hours=24)


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Normalised pages without the empty ones, numbered anew per document."""
    d = pages.withColumn("text", tx.normalize_text(F.col("text"))).where("text <> ''")
    return d.withColumn("page_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")) - 1)


def validate_requests(rows: DataFrame) -> DataFrame:
    """(text, source, target, mode, type) -> normalised fields and the first reason to reject, if any."""
    low = lambda c: F.lower(tx.trimmed(F.coalesce(F.col(c), F.lit(""))))
    d = rows.withColumns({"text": tx.trimmed(F.coalesce("text", F.lit(""))), "target": low("target"), "source": F.coalesce(F.nullif(low("source"), F.lit("")), F.lit("auto")), "mode": F.coalesce(F.nullif(F.trim("mode"), F.lit("")), F.lit("overlay"))})
    modes = F.col("mode").isin("overlay", "layout") | ((F.col("type") != "text") & (F.col("mode") == "ocr_only"))
    reason = (
        F.when(F.col("target") == "", "target is required")
        .when((F.col("source") != "auto") & ~F.col("source").rlike(LANG), "source must be auto or a valid language code")
        .when((F.col("target") == "auto") | ~F.col("target").rlike(LANG), "target must be a valid language code")
        .when(F.col("text") == "", "text is required")
        .when(F.octet_length("text") > MAX_BYTES, "text exceeds max length")
        .when(~modes, "mode is not allowed")
    )
    return d.withColumn("reason", reason)


def chunk_units(pages: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """(doc_id, page_index, text) -> units of at most ``most`` words: doc_id, unit_idx, page_index, text, words."""
    cut = F.expr(f"transform(sequence(0, size(_w) - 1, {most}), i -> slice(_w, i + 1, {most}))")
    d = pages.withColumn("_w", tx.words(F.col("text"))).where(F.size("_w") > 0).select("doc_id", "page_index", F.posexplode(cut).alias("part", "_u"))
    d = d.select("doc_id", "page_index", "part", F.array_join("_u", " ").alias("text"), F.size("_u").alias("words"))
    return d.withColumn("unit_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "part")) - 1).drop("part")


def _fold(sizes: str, close: Column) -> Column:
    """Chunk number of each element of array ``sizes``; ``close``(acc, n) says when a new chunk starts."""
    zero = F.expr("named_struct('chunk', 0, 'used', CAST(-1 AS BIGINT), 'out', CAST(array() AS array<int>))")

    def step(acc: Column, n: Column) -> Column:
        new = (acc["used"] >= 0) & close(acc["used"], n)
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        used = F.when(new | (acc["used"] < 0), n.cast("long")).otherwise(acc["used"] + n)
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, zero, step)["out"]


def _packed(rows: DataFrame, keys: list[str], order: str, size: str, close) -> DataFrame:
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("_u"))
    per = per.withColumn("_c", _fold(F.transform("_u", lambda u: u[size]), close))
    return per.select(*keys, F.inline(F.arrays_zip(F.transform("_u", lambda u: u[order]).alias(order), F.col("_c").alias("chunk_id"))))


def pack_chunks(units: DataFrame, least: int = MIN_WORDS, most: int = MAX_WORDS) -> DataFrame:
    """doc_id, unit_idx, chunk_id: a chunk closes when it has ``least`` words and the next unit would exceed ``most``."""
    return _packed(units, ["doc_id"], "unit_idx", "words", lambda used, n: (used >= least) & (used + n > most))


def pack_low_confidence(blocks: DataFrame, limit: float = 0.80, most: int = 1400) -> DataFrame:
    """Blocks of low confidence with text, packed in order into groups of at most ``most`` characters."""
    low = blocks.where((F.col("confidence") <= limit) & (tx.trimmed(F.col("text")) != "")).withColumn("chars", F.length("text"))
    return _packed(low, ["doc_id", "page_no"], "idx", "chars", lambda used, n: used + n > most)


def page_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, page_count) -> [start, end) windows; the first that reaches the end is the last."""
    size = max(1, min(size, 100))
    step = max(1, size - max(0, min(overlap, size - 1)))
    starts = F.expr(f"filter(sequence(0, page_count - 1, {step}), s -> s = 0 OR s - {step} + {size} < page_count)")
    d = docs.where("page_count > 0").select("doc_id", "page_count", F.explode(starts).alias("start"))
    return d.select("doc_id", "start", F.least(F.col("start") + size, F.col("page_count")).alias("end"))


def merge_windows(outputs: DataFrame) -> DataFrame:
    """The first window's output of each page wins."""
    w = Window.partitionBy("doc_id", "page").orderBy("window_start")
    return outputs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_pages(docs: DataFrame, merged: DataFrame) -> DataFrame:
    want = docs.where("page_count > 0").select("doc_id", F.explode(F.expr("sequence(0, page_count - 1)")).alias("page"))
    return want.join(merged.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def retry_windows(results: DataFrame) -> DataFrame:
    """One round of planning: halves where the page count differs, single pages where an output is degenerate.

    results (doc_id, start, end, pages_returned, degenerate_pages array<int>).
    """
    n, half = F.col("end") - F.col("start"), F.expr("start + (`end` - start) div 2")
    halves = F.array(F.struct(F.col("start"), half.cast("int").alias("end")), F.struct(half.cast("int").alias("start"), F.col("end")))
    singles = F.transform("degenerate_pages", lambda p: F.struct(p.alias("start"), (p + 1).alias("end")))
    todo = F.when((F.col("pages_returned") != n) & (n > 1), halves).when((F.col("pages_returned") == n) & (n > 1), singles)
    return results.select("doc_id", F.inline(F.coalesce(todo, F.expr("CAST(array() AS array<struct<start:int,end:int>>)"))))


def retry_plan(windows: DataFrame, results: DataFrame) -> DataFrame:
    """All windows that are asked for until nothing is left to retry: doc_id, round (0: the given windows), start, end.

    A round's windows come from the outcomes of the round before (see :func:`retry_windows`), looked up in ``results``; a window without
    an outcome ends there. Halves get smaller and single pages are not divided, so the recursion ends.
    """
    spark = windows.sparkSession
    n, half = F.col("end") - F.col("start"), F.expr("CAST(start + (`end` - start) div 2 AS INT)")
    parts = F.when((F.col("pages_returned") != n) & (n > 1), F.array(F.struct(F.col("start").alias("s"), half.alias("e")), F.struct(half.alias("s"), F.col("end").alias("e"))))
    parts = parts.when((F.col("pages_returned") == n) & (n > 1), F.transform("degenerate_pages", lambda p: F.struct(p.alias("s"), (p + 1).alias("e"))))
    follows = results.select("doc_id", F.col("start").alias("of_start"), F.col("end").alias("of_end"), F.explode(parts).alias("w")).select("doc_id", "of_start", "of_end", "w.s", "w.e")
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)  # the bound is the number of pages of each window
    return spark.sql("""
WITH RECURSIVE plan(doc_id, round, start, end) AS (
  SELECT doc_id, 0, start, end FROM {windows}
  UNION ALL SELECT f.doc_id, p.round + 1, f.s, f.e FROM plan AS p JOIN {follows} AS f ON f.doc_id <=> p.doc_id AND f.of_start = p.start AND f.of_end = p.end)
SELECT * FROM plan""", windows=windows.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")), follows=follows)


def cache_key(source: Column, target: Column, text: Column) -> Column:
    return tx.content_key(source, target, text)


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """Hits with their translation, and the worklist of misses; old entries are misses.

    Of several live entries of one key the latest counts, so every request is in one of the two, as often as it is asked.
    """
    keyed = requests.withColumn("cache_key", cache_key(F.col("source"), F.col("target"), F.col("text")))
    live = cache.where(F.col("written_at") >= F.lit(as_of - CACHE_TTL)).groupBy("cache_key").agg(F.max_by(F.struct("translated"), F.struct("written_at", "translated")).alias("_e"))
    live = live.select("cache_key", "_e.translated")
    return keyed.join(live, "cache_key"), keyed.join(live, "cache_key", "left_anti")


def checkpoint_keys(units: DataFrame, chunks: DataFrame, source: str, target: str) -> DataFrame:
    """doc_id, chunk_id, chunk_key over the languages and each unit's page and text."""
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("unit_idx") == F.col("_unit"))
    d = units.join(chunks.select(F.col("doc_id").alias("_doc"), F.col("unit_idx").alias("_unit"), "chunk_id"), same).groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("unit_idx", "page_index", "text"))).alias("_u"))
    parts = F.flatten(F.transform("_u", lambda u: F.array(u["page_index"].cast("string"), u["text"])))
    return d.select("doc_id", "chunk_id", F.sha2(F.concat_ws("\0", F.lit(source), F.lit(target), parts), 256).alias("chunk_key"))


def checkpoint_lookup(keys: DataFrame, stored: DataFrame, as_of: datetime) -> DataFrame:
    """keys with hit true or false."""
    live = stored.where(F.col("written_at") >= F.lit(as_of - CHECKPOINT_TTL)).select("doc_id", "chunk_key").distinct().withColumn("_hit", F.lit(True))
    return keys.join(live, ["doc_id", "chunk_key"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def drop_terminal(stored: DataFrame, jobs: DataFrame) -> DataFrame:
    """Checkpoints without those of finished PDF jobs."""
    done = jobs.where((F.col("type") == "translate_pdf") & F.col("status").isin("completed", "failed")).select("job_id")
    return stored.join(done, "job_id", "left_anti")


def page_progress(units: DataFrame) -> DataFrame:
    """(doc_id, page_index, done) -> pages whose units are all done."""
    per = units.groupBy("doc_id", "page_index").agg(F.bool_and("done").alias("whole"))
    return per.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("whole"), 1)).alias("processed_pages"))


def assemble(units: DataFrame) -> DataFrame:
    """(doc_id, page_index, unit_idx, text, translated) -> document text; failed units keep their source and count as degraded."""
    d = units.withColumn("_t", F.coalesce("translated", "text"))
    page = d.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("unit_idx", "_t"))).alias("_u"), F.count(F.when(F.col("translated").isNull(), 1)).alias("bad"))
    page = page.withColumn("_p", tx.trimmed(F.array_join(F.transform("_u", lambda u: u["_t"]), " ")))
    whole = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "_p"))).alias("_d"), F.sum("bad").alias("degraded_units"))
    return whole.select("doc_id", F.array_join(F.transform("_d", lambda p: p["_p"]), "\n\n").alias("text"), "degraded_units")


def map_lines_to_blocks(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """The n-th non-empty line goes to the n-th non-empty block; blocks without one keep their text.

    blocks (doc_id, idx, text), lines (doc_id, pos, line).
    """
    b = blocks.withColumn("_t", tx.trimmed(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy("idx")
    b = b.withColumn("_n", F.when(F.col("_t") != "", F.sum(F.when(F.col("_t") != "", 1).otherwise(0)).over(w)))
    ln = lines.withColumn("_l", tx.trimmed(F.col("line"))).where("_l <> ''")
    ln = ln.select(F.col("doc_id").alias("_d"), F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("_k"), "_l")
    j = b.join(ln, (F.col("doc_id") == F.col("_d")) & (F.col("_n") == F.col("_k")), "left")
    return j.select("doc_id", "idx", F.when(F.col("_t") == "", "").otherwise(F.coalesce("_l", "_t")).alias("mapped"))


def segments_to_blocks(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Translated units to segments to blocks: the n-th block with text is segment n (from 0), and its units join in order by a space.

    blocks (doc_id, idx, text), units (doc_id, segment, unit_idx, text) -> doc_id, idx, source, translated ('' without any text), used: the
    text to draw, which is the source where nothing came back, and '' for an empty block. Units without a segment among the blocks are left out.
    """
    b = blocks.select("doc_id", "idx", tx.trimmed(F.coalesce("text", F.lit(""))).alias("source"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    has = F.col("source") != ""
    b = b.withColumn("_n", F.when(has, F.sum(has.cast("int")).over(w) - 1))
    part = units.select(F.col("doc_id").alias("_d"), "segment", "unit_idx", tx.trimmed(F.coalesce("text", F.lit(""))).alias("_t"))
    per = part.groupBy("_d", "segment").agg(F.array_sort(F.collect_list(F.struct("unit_idx", "_t"))).alias("_u"))
    per = per.select("_d", "segment", tx.trimmed(F.array_join(F.transform("_u", lambda u: u["_t"]), " ")).alias("_s"))
    j = b.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_n") == F.col("segment")), "left")
    translated = F.coalesce("_s", F.lit(""))
    return j.select("doc_id", "idx", "source", translated.alias("translated"), F.when(translated != "", translated).otherwise(F.col("source")).alias("used"))


def segment_texts(mapped: DataFrame) -> DataFrame:
    """Per document: sources and translations of the blocks that have one, by lines; without any, all sources stand for both."""
    kept = F.when(F.col("translated") != "", F.struct("idx", "source", "translated"))
    every = F.when(F.col("source") != "", F.struct("idx", "source"))
    per = mapped.groupBy("doc_id").agg(F.array_sort(F.collect_list(kept)).alias("_k"), F.array_sort(F.collect_list(every)).alias("_e"))
    lines = lambda a, c: F.array_join(F.transform(a, lambda x: x[c]), "\n")
    none = F.size("_k") == 0
    return per.select("doc_id", F.when(none, lines("_e", "source")).otherwise(lines("_k", "source")).alias("source"), F.when(none, lines("_e", "source")).otherwise(lines("_k", "translated")).alias("translated"))
