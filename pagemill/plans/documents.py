"""Queries over documents: text functions, chunking, caches, assembly, alerts over counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import alerts as al
from ..operators import documents as dc
from ..operators import series as sr
from .registry import Tables, query

# DuckDB: \s of RE2 is ASCII only, so Unicode separators are named
S = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}+', ' ', 'g'))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


WORDS = f"list_filter(string_split({collapse('text')}, ' '), lambda w: w <> '')"
NORMAL = rf"array_to_string(list_filter(list_transform(string_split({trim('text')}, chr(10) || chr(10)), lambda p: {collapse('p')}), lambda p: p <> ''), chr(10) || chr(10))"
# documents with a paragraph break after every third line
PAGED = "(SELECT doc_id, lang, source, regexp_replace(text, '([^\\n]*\\n[^\\n]*\\n[^\\n]*\\n)', '\\1' || chr(10), 'g') AS text FROM documents)"
UNITS = f"""u0 AS (SELECT doc_id, CAST(0 AS INT) AS page_index, {WORDS} AS w FROM documents WHERE text IS NOT NULL),
u1 AS (SELECT doc_id, page_index, w, unnest(generate_series(0, len(w) - 1, 150)) AS lo FROM u0 WHERE len(w) > 0),
units AS (SELECT doc_id, CAST(lo // 150 AS INT) AS unit_idx, page_index, array_to_string(w[lo + 1 : lo + 150], ' ') AS text, CAST(len(w[lo + 1 : lo + 150]) AS INT) AS words FROM u1)"""
CHUNKS = """ord AS (SELECT doc_id, unit_idx, words, row_number() OVER (PARTITION BY doc_id ORDER BY unit_idx) AS k FROM units),
pack AS (SELECT doc_id, k, unit_idx, CAST(0 AS INT) AS chunk_id, CAST(words AS BIGINT) AS used FROM ord WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, o.unit_idx, CASE WHEN p.used >= 80 AND p.used + o.words > 150 THEN p.chunk_id + 1 ELSE p.chunk_id END, CASE WHEN p.used >= 80 AND p.used + o.words > 150 THEN o.words ELSE p.used + o.words END FROM pack p JOIN ord o ON o.doc_id = p.doc_id AND o.k = p.k + 1)"""


def _paged(t: Tables):
    return t["documents"].where("text IS NOT NULL").withColumn("text", F.regexp_replace("text", r"([^\n]*\n[^\n]*\n[^\n]*\n)", "$1\n"))


def _pages(t: Tables):
    return t["documents"].where("text IS NOT NULL").select("doc_id", F.lit(0).alias("page_index"), "text")


@query("P01_normalize_text", "documents", oracle=f"SELECT doc_id, md5({NORMAL}) AS digest FROM {PAGED} WHERE text IS NOT NULL")
def _(t: Tables):
    return _paged(t).select("doc_id", F.md5(tx.normalize_text(F.col("text")).cast("binary")).alias("digest"))


@query("P02_normalize_pages", "conversations", oracle=rf"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS INT) AS page_index, text FROM (SELECT conv_id AS doc_id, turn AS page_no, {NORMAL} AS text FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '  ' ELSE text END AS text FROM conversations)) WHERE text <> ''""")
def _(t: Tables):
    d = t["conversations"].select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(F.col("turn") % 3 == 1, "  ").otherwise(F.col("text")).alias("text"))
    return dc.normalize_pages(d).select("doc_id", "page_index", "text")


@query("P03_validate_requests", "documents", oracle=rf"""
WITH r AS (SELECT doc_id, {trim("coalesce(CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END, '')")} AS text, CASE doc_id % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'en' WHEN 2 THEN 'x' ELSE 'pt-br' END AS source, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'auto' WHEN 2 THEN 'de' WHEN 3 THEN 'toolong' ELSE 'fr' END AS target,
  CASE doc_id % 3 WHEN 0 THEN 'overlay' WHEN 1 THEN 'ocr_only' ELSE 'layout' END AS mode, CASE doc_id % 2 WHEN 0 THEN 'text' ELSE 'pdf' END AS type FROM documents)
SELECT doc_id, source, target, mode, CASE WHEN target = '' THEN 'target is required' WHEN source <> 'auto' AND NOT regexp_matches(source, '{dc.LANG}') THEN 'source must be auto or a valid language code' WHEN target = 'auto' OR NOT regexp_matches(target, '{dc.LANG}') THEN 'target must be a valid language code'
  WHEN text = '' THEN 'text is required' WHEN octet_length(encode(text)) > 10000 THEN 'text exceeds max length' WHEN mode = 'ocr_only' AND type = 'text' THEN 'mode is not allowed' END AS reason FROM r""")
def _(t: Tables):
    i = F.col("doc_id")
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (i % n + 1).cast("int"))
    d = t["documents"].select("doc_id", F.when(i % 11 == 0, " ").otherwise(F.col("text")).alias("text"), pick(5, " AUTO", "EN ", "x", "pt-BR", "pt-br").alias("source"), pick(7, " ", "auto", "de", "toolong", "fr", "FR", "fr").alias("target"), pick(3, "", "ocr_only", "layout").alias("mode"), pick(2, "text", "pdf").alias("type"))
    return dc.validate_requests(d).select("doc_id", "source", "target", "mode", "reason")


@query("W04_chunk_units", "documents", oracle=f"WITH {UNITS} SELECT doc_id, unit_idx, page_index, md5(text) AS digest, words FROM units")
def _(t: Tables):
    return dc.chunk_units(_pages(t)).select("doc_id", "unit_idx", "page_index", F.md5(F.col("text").cast("binary")).alias("digest"), "words")


@query("W05_pack_chunks", "documents", oracle=f"WITH RECURSIVE {UNITS}, {CHUNKS} SELECT doc_id, unit_idx, chunk_id FROM pack")
def _(t: Tables):
    return dc.pack_chunks(dc.chunk_units(_pages(t)))


@query("W06_pack_low_confidence", "blocks", oracle="""
WITH ord AS (SELECT doc_id, page_no, idx, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM blocks WHERE confidence <= 0.8 AND trim(text) <> ''),
pack AS (SELECT doc_id, page_no, idx, k, CAST(0 AS INT) AS chunk_id, CAST(n AS BIGINT) AS used FROM ord WHERE k = 1
  UNION ALL SELECT o.doc_id, o.page_no, o.idx, o.k, CASE WHEN p.used + o.n > 1400 THEN p.chunk_id + 1 ELSE p.chunk_id END, CASE WHEN p.used + o.n > 1400 THEN o.n ELSE p.used + o.n END FROM pack p JOIN ord o ON o.doc_id = p.doc_id AND o.k = p.k + 1)
SELECT doc_id, page_no, idx, chunk_id FROM pack""")
def _(t: Tables):
    return dc.pack_low_confidence(t["blocks"])


@query("W07_page_windows", "documents", oracle="""
WITH RECURSIVE d AS (SELECT doc_id, CAST(n_chars % 40 AS INT) AS n FROM documents), w AS (SELECT doc_id, n, 0 AS start, least(5, n) AS "end" FROM d WHERE n > 0
  UNION ALL SELECT doc_id, n, "end" - 1, least("end" + 4, n) FROM w WHERE "end" < n) SELECT doc_id, start, "end" FROM w""")
def _(t: Tables):
    return dc.page_windows(t["documents"].select("doc_id", (F.col("n_chars") % 40).cast("int").alias("page_count")), 5, 1)


@query("W08_merge_windows", "documents", oracle="""
WITH RECURSIVE d AS (SELECT doc_id, CAST(n_chars % 40 AS INT) AS n FROM documents), w AS (SELECT doc_id, n, 0 AS start, least(5, n) AS "end" FROM d WHERE n > 0 UNION ALL SELECT doc_id, n, "end" - 1, least("end" + 4, n) FROM w WHERE "end" < n),
p AS (SELECT doc_id, start, unnest(range(start, "end")) AS page FROM w WHERE start % 3 < 2)
SELECT doc_id, count(DISTINCT page) AS pages, any_value(n) - count(DISTINCT page) AS missing, CAST(sum(first) AS BIGINT) AS window_sum FROM (SELECT p.doc_id, page, d.n, min(start) OVER (PARTITION BY p.doc_id, page) / count(*) OVER (PARTITION BY p.doc_id, page) AS first FROM p JOIN d ON d.doc_id = p.doc_id) GROUP BY doc_id""")
def _(t: Tables):
    docs = t["documents"].select("doc_id", (F.col("n_chars") % 40).cast("int").alias("page_count"))
    win = dc.page_windows(docs, 5, 1).where("start % 3 < 2")
    out = win.select("doc_id", F.col("start").alias("window_start"), F.explode(F.expr("sequence(start, `end` - 1)")).alias("page"))
    merged = dc.merge_windows(out)
    gone = dc.missing_pages(docs, merged).groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))
    got = merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("window_start").cast("long").alias("window_sum"))
    return got.join(gone, "doc_id", "left").select("doc_id", "pages", F.coalesce("missing", F.lit(0)).alias("missing"), "window_sum")


@query("W09_retry_windows", "documents", oracle="""
WITH r AS (SELECT doc_id, CAST(n_chars % 9 AS INT) AS s, CAST(n_chars % 9 + 1 + doc_id % 6 AS INT) AS e, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 6 ELSE 1 + doc_id % 6 END AS INT) AS got FROM documents)
SELECT doc_id, s AS start, CAST(s + (e - s) // 2 AS INT) AS "end" FROM r WHERE got <> e - s AND e - s > 1 UNION ALL SELECT doc_id, CAST(s + (e - s) // 2 AS INT), e FROM r WHERE got <> e - s AND e - s > 1
UNION ALL SELECT doc_id, s, s + 1 FROM r WHERE got = e - s AND e - s > 1 AND doc_id % 2 = 0""")
def _(t: Tables):
    i = F.col("doc_id")
    d = t["documents"].select("doc_id", (F.col("n_chars") % 9).cast("int").alias("start"), (F.col("n_chars") % 9 + 1 + i % 6).cast("int").alias("end"), F.when(i % 3 == 0, i % 6).otherwise(1 + i % 6).cast("int").alias("pages_returned"))
    return dc.retry_windows(d.withColumn("degenerate_pages", F.when(i % 2 == 0, F.array("start")).otherwise(F.expr("CAST(array() AS array<int>)"))))


@query("W09_retry_plan", "documents", oracle="""
WITH RECURSIVE p AS (SELECT doc_id, 0 AS round, 0 AS s, CAST(1 + n_chars % 12 AS INT) AS e FROM documents
  UNION ALL SELECT doc_id, round + 1, CAST(CASE WHEN bad THEN s + k ELSE s + k * ((e - s) // 2) END AS INT), CAST(CASE WHEN bad THEN s + k + 1 WHEN k = 0 THEN s + (e - s) // 2 ELSE e END AS INT)
  FROM (SELECT *, (doc_id + s + e) % 3 = 0 AS bad FROM p), (SELECT 0 AS k UNION ALL SELECT 1) WHERE e - s > 1 AND (NOT bad OR (doc_id + s + k) % 2 = 0))
SELECT doc_id, round, s AS start, e AS "end" FROM p""")
def _(t: Tables):
    d = t["documents"].select("doc_id", (1 + F.col("n_chars") % 12).cast("int").alias("n"))
    # the outcome of every window that may be asked for
    every = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start")).select("doc_id", "start", F.explode(F.sequence(F.col("start") + 1, F.col("n"))).alias("end"))
    k = F.col("doc_id") + F.col("start") + F.col("end")
    bad = F.filter(F.array(F.col("start"), F.col("start") + 1), lambda p: (F.col("doc_id") + p) % 2 == 0)
    every = every.withColumns({"pages_returned": F.when(k % 3 > 0, 0).otherwise(F.col("end") - F.col("start")), "degenerate_pages": bad})
    return dc.retry_plan(d.select("doc_id", F.lit(0).alias("start"), F.col("n").alias("end")), every)


def _cache(t: Tables):
    d = t["documents"].where("text IS NOT NULL").withColumn("source", F.lit("auto")).withColumn("target", F.col("lang"))
    stored = d.where("doc_id % 3 = 0").select(dc.cache_key(F.col("source"), F.col("target"), F.col("text")).alias("cache_key"), F.upper("text").alias("translated"), F.when(F.col("doc_id") % 2 == 0, F.to_timestamp(F.lit("2024-02-01"))).otherwise(F.to_timestamp(F.lit("2023-12-01"))).alias("written_at"))
    return d, stored.dropDuplicates(["cache_key", "written_at"])


@query("J02_cache_lookup", "documents", oracle="""
WITH d AS (SELECT doc_id, sha256('auto' || chr(0) || lang || chr(0) || text) AS k FROM documents WHERE text IS NOT NULL), live AS (SELECT DISTINCT k FROM d WHERE doc_id % 6 = 0)
SELECT d.doc_id, CASE WHEN live.k IS NULL THEN 'miss' ELSE 'hit' END AS state, d.k AS cache_key FROM d LEFT JOIN live USING (k)""")
def _(t: Tables):
    from datetime import datetime

    hits, misses = dc.cache_lookup(*_cache(t), datetime(2024, 2, 10))
    return hits.select("doc_id", F.lit("hit").alias("state"), "cache_key").unionByName(misses.select("doc_id", F.lit("miss").alias("state"), "cache_key"))


@query("J03_checkpoint_lookup", "documents", oracle=f"""
WITH RECURSIVE {UNITS}, {CHUNKS}, k AS (SELECT p.doc_id, p.chunk_id, sha256('en' || chr(0) || 'de' || chr(0) || string_agg(CAST(u.page_index AS VARCHAR) || chr(0) || u.text, chr(0) ORDER BY u.unit_idx)) AS chunk_key FROM pack p JOIN units u ON u.doc_id = p.doc_id AND u.unit_idx = p.unit_idx GROUP BY 1, 2)
SELECT doc_id, chunk_id, chunk_key, chunk_id % 2 = 0 AND doc_id % 3 > 0 OR EXISTS (SELECT 1 FROM k k2 WHERE k2.doc_id = k.doc_id AND k2.chunk_key = k.chunk_key AND k2.chunk_id % 2 = 0 AND k2.doc_id % 3 > 0) AS hit FROM k""")
def _(t: Tables):
    from datetime import datetime

    units = dc.chunk_units(_pages(t))
    keys = dc.checkpoint_keys(units, dc.pack_chunks(units), "en", "de")
    stored = keys.where("chunk_id % 2 = 0").select("doc_id", "chunk_key", F.when(F.col("doc_id") % 3 > 0, F.to_timestamp(F.lit("2024-02-09 12:00:00"))).otherwise(F.to_timestamp(F.lit("2024-02-01"))).alias("written_at"))
    return dc.checkpoint_lookup(keys, stored, datetime(2024, 2, 10))


@query("A36_page_progress", "conversations", oracle="SELECT conv_id AS doc_id, count(*) AS pages, count(*) FILTER (WHERE done) AS processed_pages FROM (SELECT conv_id, turn // 2 AS p, bool_and(length(text) % 5 > 0) AS done FROM conversations GROUP BY ALL) GROUP BY 1")
def _(t: Tables):
    return dc.page_progress(t["conversations"].select(F.col("conv_id").alias("doc_id"), F.expr("turn div 2").alias("page_index"), (F.length("text") % 5 > 0).alias("done")))


@query("A37_document_assembly", "conversations", oracle=f"""
SELECT doc_id, string_agg({trim('p')}, chr(10) || chr(10) ORDER BY page_index) AS text, CAST(sum(bad) AS BIGINT) AS degraded_units FROM (SELECT conv_id AS doc_id, turn // 2 AS page_index, string_agg(CASE WHEN length(text) % 4 = 0 THEN text ELSE lower(text) END, ' ' ORDER BY turn) AS p, count(*) FILTER (WHERE length(text) % 4 = 0) AS bad FROM conversations GROUP BY ALL) GROUP BY 1""")
def _(t: Tables):
    d = t["conversations"].select(F.col("conv_id").alias("doc_id"), F.expr("turn div 2").alias("page_index"), F.col("turn").alias("unit_idx"), "text", F.when(F.length("text") % 4 != 0, F.lower("text")).alias("translated"))
    return dc.assemble(d)


@query("J07_map_lines_to_blocks", "blocks", "blocks_b", oracle="""
WITH b AS (SELECT *, trim(text) AS t FROM (SELECT doc_id, idx, CASE WHEN idx % 5 = 4 THEN ' ' ELSE text END AS text FROM blocks)), bn AS (SELECT *, CASE WHEN t <> '' THEN count(*) FILTER (WHERE t <> '') OVER (PARTITION BY doc_id ORDER BY idx) END AS n FROM b),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n, trim(text) AS l FROM blocks_b WHERE idx % 4 > 0 AND trim(text) <> '')
SELECT bn.doc_id, bn.idx, CASE WHEN t = '' THEN '' ELSE coalesce(l.l, t) END AS mapped FROM bn LEFT JOIN l ON l.doc_id = bn.doc_id AND l.n = bn.n""")
def _(t: Tables):
    b = t["blocks"].withColumn("text", F.when(F.col("idx") % 5 == 4, " ").otherwise(F.col("text")))
    return dc.map_lines_to_blocks(b, t["blocks_b"].where("idx % 4 > 0").select("doc_id", F.col("idx").alias("pos"), F.col("text").alias("line")))


_SEGMENTS = """b AS (SELECT doc_id, idx, trim(CASE WHEN idx % 5 = 4 THEN ' ' ELSE text END) AS source FROM blocks),
n AS (SELECT *, CASE WHEN source <> '' THEN count(*) FILTER (WHERE source <> '') OVER (PARTITION BY doc_id ORDER BY idx) - 1 END AS segment FROM b),
u AS (SELECT doc_id, segment, trim(string_agg(trim(part), ' ' ORDER BY k)) AS s FROM (SELECT doc_id, segment, k, CASE WHEN segment % 6 = 5 OR (segment + k) % 4 = 3 THEN ' ' ELSE translate(source, 'eo', 'ac') END AS part FROM n, (SELECT 0 AS k UNION ALL SELECT 1) WHERE segment % 7 < 6) GROUP BY 1, 2),
m AS (SELECT n.doc_id, idx, source, coalesce(s, '') AS translated FROM n LEFT JOIN u ON u.doc_id = n.doc_id AND u.segment = n.segment)"""


def _mapped(t: Tables):
    b = t["blocks"].withColumn("text", F.when(F.col("idx") % 5 == 4, " ").otherwise(F.col("text")))
    n = b.where(tx.trimmed(F.col("text")) != "").withColumn("segment", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1)
    s = F.col("segment")
    u = n.where(s % 7 < 6).select("doc_id", "segment", F.explode(F.array(F.lit(0), F.lit(1))).alias("unit_idx"), "text")
    return dc.segments_to_blocks(b, u.withColumn("text", F.when((s % 6 == 5) | ((s + F.col("unit_idx")) % 4 == 3), " ").otherwise(F.translate("text", "eo", "ac"))))


@query("J07_segments_to_blocks", "blocks", oracle=f"WITH {_SEGMENTS} SELECT doc_id, idx, translated, CASE WHEN translated <> '' THEN translated ELSE source END AS used FROM m")
def _(t: Tables):
    return _mapped(t).select("doc_id", "idx", "translated", "used")


@query("J07_segment_texts", "blocks", oracle=f"""
WITH {_SEGMENTS} SELECT doc_id, coalesce(string_agg(source, chr(10) ORDER BY idx) FILTER (WHERE translated <> ''), string_agg(source, chr(10) ORDER BY idx) FILTER (WHERE source <> ''), '') AS source,
  coalesce(string_agg(translated, chr(10) ORDER BY idx) FILTER (WHERE translated <> ''), string_agg(source, chr(10) ORDER BY idx) FILTER (WHERE source <> ''), '') AS translated FROM m GROUP BY 1""")
def _(t: Tables):
    return dc.segment_texts(_mapped(t))


@query("J03_drop_terminal", "jobs", oracle="SELECT event_id FROM jobs WHERE NOT (type = 'translate_pdf' AND status IN ('completed', 'failed'))")
def _(t: Tables):
    stored = t["jobs"].select("job_id", "event_id")
    return dc.drop_terminal(stored, t["jobs"]).select("event_id")


@query("F07_normalize_eval", "documents", oracle=f"SELECT doc_id, md5({collapse('text')}) AS eval_digest, md5({collapse('lower(text)')}) AS loose_digest FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    c = F.col("text")
    return t["documents"].where("text IS NOT NULL").select("doc_id", F.md5(tx.collapsed(c).cast("binary")).alias("eval_digest"), F.md5(tx.loose(c).cast("binary")).alias("loose_digest"))


#: Whole texts with words of other scripts before or behind them.
SCRIPT_TEXT = """CASE doc_id % 5 WHEN 0 THEN text || ' 漢字 かな' WHEN 1 THEN 'שלום עולם ' || text WHEN 2 THEN text || ' हिन्दी ไทย'
  WHEN 3 THEN repeat('مرحبا ', CAST(floor(length(text) / 4) AS INT) + 1) || text ELSE text END"""
#: Whole texts of which a third is mostly Han characters.
TALL_TEXT = "CASE doc_id % 3 WHEN 0 THEN repeat('漢字漢字', CAST(length(text) AS INT) + 1) || text WHEN 1 THEN '漢' || text ELSE '漢字' || text END"
_CLASS = {n: r for n, r in tx.SCRIPTS}


@query("F09_rtl", "documents", oracle=f"""SELECT doc_id, lang IN ('ar', 'ur', 'fa', 'he', 'ps', 'sd', 'ug') AS rtl_lang, length(bare) > 0 AND length(regexp_replace(bare, '[^{tx.RTL}]', '', 'g')) * 2 >= length(bare) AS rtl_text, regexp_matches(text, '[\\x{{0590}}-\\x{{08FF}}]') AS has_rtl,
  regexp_matches(text, '[{tx.RTL}]') AND regexp_matches(regexp_replace(text, '[{tx.RTL}]', '', 'g'), '\\p{{L}}') AS mixed FROM (SELECT *, regexp_replace(text, '{S}+', '', 'g') AS bare FROM (SELECT doc_id, lang, {SCRIPT_TEXT} AS text FROM documents WHERE text IS NOT NULL))""")
def _(t: Tables):
    c = F.col("text")
    d = t["documents"].where("text IS NOT NULL").selectExpr("doc_id", "lang", f"{SCRIPT_TEXT} AS text")
    return d.select("doc_id", tx.is_rtl_lang(F.col("lang")).alias("rtl_lang"), tx.is_rtl_text(c).alias("rtl_text"), tx.has_rtl(c).alias("has_rtl"), tx.mixed_direction(c).alias("mixed"))


@query("F10_detect_scripts", "documents", oracle=f"SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f'''CASE WHEN regexp_matches(text, '[{r}]') THEN '{n}' END''' for n, r in tx.SCRIPTS)}], lambda x: x IS NOT NULL)), ',') AS scripts FROM (SELECT doc_id, {SCRIPT_TEXT} AS text FROM documents WHERE text IS NOT NULL)")
def _(t: Tables):
    d = t["documents"].where("text IS NOT NULL").selectExpr("doc_id", f"{SCRIPT_TEXT} AS text")
    return d.select("doc_id", F.array_join(tx.detect_scripts(F.col("text")), ",").alias("scripts"))


@query("F11_script_segments", "documents", oracle=f"SELECT doc_id, CAST(len(r) AS INT) AS segments, CAST(len(list_filter(r, lambda x: regexp_matches(x, '^[{tx.FALLBACK}]'))) AS INT) AS fallback FROM (SELECT doc_id, regexp_extract_all(text, '[{tx.FALLBACK}]+|[^{tx.FALLBACK}]+') AS r FROM (SELECT doc_id, {SCRIPT_TEXT} AS text FROM documents WHERE text IS NOT NULL))")
def _(t: Tables):
    d = t["documents"].where("text IS NOT NULL").selectExpr("doc_id", f"{SCRIPT_TEXT} AS text").withColumn("s", tx.script_segments(F.col("text")))
    return d.select("doc_id", F.size("s").alias("segments"), F.size(F.filter("s", lambda x: x["fallback"])).alias("fallback"))


@query("F12_vertical_text", "documents", oracle=f"SELECT doc_id, h / w >= 2.2 AND length(c) >= 2 AND length(c) / length(text) >= 0.8 AS vertical FROM (SELECT doc_id, doc_id % 50 + 10 AS w, 100 AS h, t AS text, regexp_replace(t, '[^{tx.CJK}]', '', 'g') AS c FROM (SELECT doc_id, {TALL_TEXT} AS t FROM documents WHERE text IS NOT NULL))")
def _(t: Tables):
    d = t["documents"].where("text IS NOT NULL").selectExpr("doc_id", "doc_id % 50 + 10 AS w", "100 AS h", f"{TALL_TEXT} AS text")
    return d.select("doc_id", tx.is_vertical(F.col("text"), F.col("w"), F.col("h")).alias("vertical"))


@query("F13_cjk_tokens", "documents", oracle=f"SELECT doc_id, array_to_string(flatten(list_transform({WORDS}, lambda w: CASE WHEN regexp_matches(w, '^[{tx.CJK}]+$') THEN regexp_extract_all(w, '.') ELSE [w] END)), '|') AS tokens FROM (SELECT doc_id, {SCRIPT_TEXT} AS text FROM documents WHERE text IS NOT NULL)")
def _(t: Tables):
    d = t["documents"].where("text IS NOT NULL").selectExpr("doc_id", f"{SCRIPT_TEXT} AS text")
    return d.select("doc_id", F.array_join(tx.cjk_tokens(F.col("text")), "|").alias("tokens"))


@query("F17_changed_chars", "documents", oracle="SELECT doc_id, CAST(length(text) - length(replace(replace(text, 'e', ''), 'o', '')) AS INT) AS changed FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    return t["documents"].where("text IS NOT NULL").select("doc_id", tx.changed_chars(F.col("text"), F.translate("text", "eo", "ac")).alias("changed"))


@query("F18_content_key", "documents", oracle="SELECT doc_id, sha256('auto' || chr(0) || lang || chr(0) || text) AS k FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    return t["documents"].where("text IS NOT NULL").select("doc_id", tx.content_key(F.lit("auto"), F.col("lang"), F.col("text")).alias("k"))


@query("F19_split_pages", "documents", oracle=rf"SELECT doc_id, CAST(len(list_filter(p, lambda x: true)) - CASE WHEN p[1] = '' THEN 1 ELSE 0 END AS INT) AS pages FROM (SELECT doc_id, list_transform(string_split(CASE WHEN doc_id % 2 = 0 THEN '<PAGE>' ELSE '' END || replace(text, chr(10), '<PAGE>'), '<PAGE>'), lambda x: trim(x)) AS p FROM documents WHERE text IS NOT NULL)")
def _(t: Tables):
    d = t["documents"].where("text IS NOT NULL").withColumn("raw", F.concat(F.when(F.col("doc_id") % 2 == 0, "<Page>").otherwise(""), F.replace("text", F.lit("\n"), F.lit("<PAGE>"))))
    return d.select("doc_id", F.size(tx.split_pages(F.col("raw"))).alias("pages"))


@query("F24_json_access", "events", oracle="SELECT event_id, coalesce(props->>'$.missing', props->>'$.k', props->>'$.page', props) AS v FROM events")
def _(t: Tables):
    return t["events"].select("event_id", F.coalesce(tx.first_path(F.col("props"), "$.missing", "$.k", "$.page"), "props").alias("v"))


@query("F15_safe_percent", "jobs", oracle="SELECT job_id, CASE WHEN attempt <= 0 THEN 0.0 ELSE event_id / attempt * 100 END AS pct FROM jobs")
def _(t: Tables):
    from ..operators.providers import safe_percent

    return t["jobs"].select("job_id", safe_percent(F.col("event_id"), F.col("attempt")).alias("pct"))


@query("F22_date_time", "events", oracle="SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS secs FROM events")
def _(t: Tables):
    back = F.to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")
    return t["events"].select("event_id", F.date_trunc("hour", "ts").alias("hour"), F.unix_timestamp(back).alias("secs"))


_INC = """s AS (SELECT *, CASE WHEN lag(value) OVER o IS NULL THEN 0.0 WHEN value < lag(value) OVER o THEN value ELSE value - lag(value) OVER o END AS d FROM m WINDOW o AS (PARTITION BY label ORDER BY ts, event_id)),
i AS (SELECT event_id, label, ts, value, sum(d) OVER (PARTITION BY label ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS increase FROM s)"""
_RESET = "m AS (SELECT event_id, ts, metric, label, value % 100 AS value FROM metric_samples)"


@query("W02_counter_increase", "metric_samples", oracle=f"WITH {_RESET}, {_INC} SELECT event_id, label, increase FROM i")
def _(t: Tables):
    m = t["metric_samples"].withColumn("value", F.col("value") % 100)
    return al.counter_increase(m, 86_400).select("event_id", "label", "increase")


@query("W03_alert_eval", "metric_samples", oracle=f"""
WITH {_RESET}, {_INC}, h AS (SELECT *, increase > 20 AS holds FROM i), g AS (SELECT *, sum(CASE WHEN holds IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY ts) AS island FROM (SELECT *, lag(holds) OVER (PARTITION BY label ORDER BY ts) AS prev FROM h))
SELECT label, ts, 'ProviderTimeoutSpike' AS rule, 'warning' AS severity FROM (SELECT *, min(ts) OVER (PARTITION BY label, island) AS since FROM g WHERE holds) WHERE epoch_us(ts) - epoch_us(since) >= 21600000000""")
def _(t: Tables):
    m = al.counter_increase(t["metric_samples"].withColumn("value", F.col("value") % 100), 86_400).withColumnRenamed("increase", "provider_timeout_total_inc5m")
    rule = al.Rule("ProviderTimeoutSpike", "provider_timeout_total_inc5m > 20", 21_600, "warning")
    return al.alert_eval(m, (rule,)).drop("since")


_SERIES = "metric, label, instance"
_GROWTH = f"""m AS (SELECT *, CAST(ceil(epoch_us(ts) / 30000000.0) AS BIGINT) AS step0, lag(value) OVER (PARTITION BY {_SERIES} ORDER BY ts, event_id) AS before FROM rule_samples),
d AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS growth FROM m),
steps AS (SELECT unnest(generate_series((SELECT min(step0) FROM m), (SELECT max(step0) FROM m))) AS step)"""


def _increase_sql(window_s: int, metrics: str) -> str:
    """Every step with the samples of its window, one join by time."""
    return f"""SELECT {_SERIES}, step, sum(growth) AS increase FROM d JOIN steps ON epoch_us(ts) > (step * 30 - {window_s}) * 1000000 AND epoch_us(ts) <= step * 30000000
WHERE metric IN ({metrics}) GROUP BY ALL"""


@query("W02_rate_grid", "rule_samples", oracle=f"""
WITH {_GROWTH} SELECT label, make_timestamp(step * 30000000) AS at, sum(increase / 300) AS rate FROM ({_increase_sql(300, "'provider_timeout_total'")}) GROUP BY label, step""")
def _(t: Tables):
    grid = sr.increases(t["rule_samples"], 300, ("metric", "label", "instance")).where("metric = 'provider_timeout_total'")
    return sr.total_by(grid, ("label",)).select("label", sr.step_time("step").cast("timestamp_ntz").alias("at"), "rate")


_CLAMP = ("adaptive_concurrency_clamp_total", "adaptive_concurrency_reduce_total", "adaptive_concurrency_boost_total")


@query("W02_clamp_share", "rule_samples", oracle=f"""
WITH {_GROWTH}, i AS ({_increase_sql(900, str(_CLAMP)[1:-1])})
SELECT label, instance, a.step, a.increase / greatest(a.increase + b.increase + c.increase, 1) AS share
FROM i AS a JOIN i AS b USING (label, instance, step) JOIN i AS c USING (label, instance, step) WHERE a.metric = '{_CLAMP[0]}' AND b.metric = '{_CLAMP[1]}' AND c.metric = '{_CLAMP[2]}'""")
def _(t: Tables):
    grid = sr.increases(t["rule_samples"], 900, ("metric", "label", "instance"))
    return sr.share(grid, _CLAMP[0], _CLAMP, ("label", "instance"))


def _rules_sql() -> str:
    """Steps that fire, by islands of the steps that hold; one select for each operand."""
    holds = []
    for r in sr.RULES:
        for i, o in enumerate(r.operands):
            if o.metric == "up":
                values = "SELECT CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS instance, step, CASE WHEN step IN (SELECT step0 FROM m) THEN 1 ELSE 0 END AS v FROM steps"
            elif o.window_s is None:
                values = f"""SELECT k.label, k.instance, k.step, m.value AS v FROM (SELECT DISTINCT label, instance, step, make_timestamp(step * 30000000) AS at FROM m, steps WHERE metric = '{o.metric}') AS k
ASOF JOIN (SELECT * FROM m WHERE metric = '{o.metric}') AS m ON k.label = m.label AND k.instance = m.instance AND k.at >= m.ts WHERE epoch_us(m.ts) > (step * 30 - {sr.LOOKBACK_S}) * 1000000"""
            else:
                values = f"SELECT label, instance, step, increase AS v FROM ({_increase_sql(o.window_s, repr(o.metric))})"
                if o.total_by:
                    values = f"SELECT label, CAST(NULL AS VARCHAR) AS instance, step, sum(v) AS v FROM ({values}) GROUP BY label, step"
            op = "=" if o.op == "==" else o.op
            holds.append(f"SELECT '{r.name}' AS rule, '{r.severity}' AS severity, {len(r.operands)} AS needed, {r.hold_s // 30} AS hold, {i} AS operand, label, instance, step FROM ({values}) WHERE v {op} {o.threshold}")
    by = "rule, severity, hold, label, instance"
    return f"""WITH {_GROWTH}, h AS ({" UNION ALL ".join(holds)}),
both_hold AS (SELECT {by}, step FROM h GROUP BY {by}, step, needed HAVING count(*) = needed),
g AS (SELECT *, step - row_number() OVER (PARTITION BY {by} ORDER BY step) AS island FROM both_hold)
SELECT rule, severity, label, instance, step FROM (SELECT *, min(step) OVER (PARTITION BY {by}, island) AS since FROM g) WHERE step - since >= hold"""


@query("W03_alert_rules", "rule_samples", oracle=_rules_sql())
def _(t: Tables):
    return sr.firing(t["rule_samples"])


@query("W20_repeated_warn_promotion", "jobs", oracle="""
WITH a AS (SELECT event_id, type AS label, updated_at AS ts, CASE WHEN status = 'failed' THEN 'warn' ELSE 'ok' END AS level FROM jobs)
SELECT event_id, level = 'warn' AND count(*) FILTER (WHERE level = 'warn') OVER (PARTITION BY label ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) >= 3 AS escalate, coalesce(lag(level, 1) OVER o = 'ok' AND lag(level, 2) OVER o = 'ok', false) AS demote FROM a WINDOW o AS (PARTITION BY label ORDER BY ts, event_id)""")
def _(t: Tables):
    a = t["jobs"].select("event_id", F.col("type").alias("label"), F.col("updated_at").alias("ts"), F.when(F.col("status") == "failed", "warn").otherwise("ok").alias("level"))
    return al.promote_warnings(a).select("event_id", "escalate", "demote")
