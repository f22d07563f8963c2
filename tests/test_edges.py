"""Edge cases and large inputs: null keys and times, empty boxes, repeated entries, replays, half-done runs, long texts, big pages."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.functions.pandas_udfs import edits
from pagemill.operators import alerts, documents, evaluation, layout, lifecycle, quality, series
from pagemill.sources import logs, results
from pagemill.streaming import streams

BLOCK = "doc_id int, page_no int, idx long, text string, confidence double, x1 double, y1 double, x2 double, y2 double, lang string"
T0 = datetime(2024, 1, 1)


def blocks_of(spark, rows):
    return spark.createDataFrame([(d, p, i, t, 0.9, *map(float, box), "en") if box else (d, p, i, t, 0.9, None, None, None, None, "en") for i, (d, p, t, box) in enumerate(rows)], BLOCK)


# --- layout


def test_empty_boxes_and_null_pages_are_suppressed_or_kept(spark):
    rows = [(1, 1, "a", (0, 0, 10, 10)), (1, 1, "a", (0, 0, 9, 9)), (1, 1, "z", (5, 5, 5, 9)), (1, 1, "n", None), (None, None, "a", (0, 0, 10, 10)), (None, None, "b", (1, 1, 9, 9)), (None, None, "c", (500, 500, 510, 510))]
    got = {r.idx: r.kept for r in layout.overlap_suppression(blocks_of(spark, rows)).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False, 6: True}


def test_regions_and_matches_keep_null_pages(spark):
    rows = [(1, 1, "A title", (0, 0, 100, 40)), (None, 1, "x", (0, 0, 5, 5)), (1, None, "y", (0, 0, 5, 5)), (None, None, "z", (0, 0, 5, 5))]
    b = blocks_of(spark, rows)
    assert layout.classify_region(b).count() == 4
    assert layout.ensemble_merge(b, b).count() == 4
    score = {r.doc_id: (r.expected_count, r.f1) for r in layout.block_detection_score(b, b).collect()}
    assert score == {1: (2, 1.0), None: (2, 1.0)}


def test_box_pairs_are_all_that_meet(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        x, y, size = r.uniform(-500, 500), r.uniform(-500, 500), r.choice([1, 8, 60, 700]) * r.uniform(0.5, 1)
        rows.append((r.choice([1, None]), 1, str(i), (x, y, x + size, y + size * r.uniform(0.1, 3))))
    b = blocks_of(spark, rows).select("doc_id", "page_no", "idx", "x1", "y1", "x2", "y2")
    for reach in (0.0, 15.0):
        got = [(x.a_idx, x.b_idx) for x in layout.box_pairs(b, b, reach).select("a_idx", "b_idx").collect()]
        want = {(i, j) for i, (d, _, _, p) in enumerate(rows) for j, (e, _, _, q) in enumerate(rows) if d == e and p[0] - reach <= q[2] + reach and q[0] - reach <= p[2] + reach and p[1] - reach <= q[3] + reach and q[1] - reach <= p[3] + reach}
        assert len(got) == len(set(got)) and set(got) == want


def test_a_page_of_20000_blocks(spark):
    rows = [(1, 1, str(i), ((i % 200) * 20, (i // 200) * 20, (i % 200) * 20 + 15, (i // 200) * 20 + 15)) for i in range(20_000)] + [(1, 1, "page", (0, 0, 4000, 2000))]
    b = blocks_of(spark, rows)
    small = b.select("doc_id", "page_no", "idx", "x1", "y1", "x2", "y2")
    assert layout.box_pairs(small, small).count() == 20_000 + 2 * 20_000 + 1
    assert layout.greedy_matches(b, b, 0.5).where("a_idx = b_idx AND iou = 1").count() == 20_001


def test_boxes_cross_the_network_once(spark):
    """Copies of a box for its cells, and texts with them, stay in the task of their page."""
    b = blocks_of(spark, [(d, 1, t, (x, x, x + 30, x + 20)) for d in (1, 2, None) for t, x in (("a", 0), ("a b", 5), ("c", 40), ("", 300))])
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(layout.overlap_suppression(b)) == 1
    assert exchanges(layout.greedy_matches(b, b, 0.3)) == 1
    small = b.select("doc_id", "page_no", "idx", "x1", "y1", "x2", "y2")
    assert sorted(map(repr, layout.box_pairs(small, reach=5.0).collect())) == sorted(map(repr, layout.box_pairs(small, small, 5.0).collect()))


# --- documents


def test_cache_and_checkpoints_with_repeats_and_nulls(spark):
    asked = spark.createDataFrame([(1, "auto", "de", "x"), (2, "auto", "de", "x"), (3, "auto", "de", "y"), (4, "auto", "de", None)], "id int, source string, target string, text string")
    key = asked.where("id = 1").select(documents.cache_key(F.col("source"), F.col("target"), F.col("text"))).first()[0]
    cache = spark.createDataFrame([(key, "old", T0), (key, "new", T0 + timedelta(hours=1)), (key, "gone", T0 - timedelta(days=90))], "cache_key string, translated string, written_at timestamp")
    hits, misses = documents.cache_lookup(asked, cache, T0 + timedelta(days=1))
    assert sorted((r.id, r.translated) for r in hits.collect()) == [(1, "new"), (2, "new")]
    assert sorted(r.id for r in misses.collect()) == [3, 4]
    units = spark.createDataFrame([(None, 0, 0, "a"), (None, 1, 0, "b"), (1, 0, 0, "a")], "doc_id int, unit_idx int, page_index int, text string")
    chunks = spark.createDataFrame([(None, 0, 0), (None, 1, 0), (1, 0, 0)], "doc_id int, unit_idx int, chunk_id int")
    assert sorted(str(r.doc_id) for r in documents.checkpoint_keys(units, chunks, "en", "de").collect()) == ["1", "None"]


def test_retry_plan_runs_to_its_end(spark):
    first = spark.createDataFrame([(1, 0, 6), (2, 0, 1), (None, 0, 2)], "doc_id int, start int, end int")
    outcome = [(1, 0, 6, 5, []), (1, 0, 3, 3, [1]), (1, 3, 6, 2, []), (1, 3, 4, 1, []), (1, 4, 6, 2, [4, 5]), (1, 1, 2, 1, [1]), (2, 0, 1, 0, []), (None, 0, 2, 0, [])]
    known = spark.createDataFrame(outcome, "doc_id int, start int, end int, pages_returned int, degenerate_pages array<int>")
    got = sorted(((r.doc_id, r["round"], r.start, r.end) for r in documents.retry_plan(first, known).collect()), key=str)
    want = [(1, 0, 0, 6), (1, 1, 0, 3), (1, 1, 3, 6), (1, 2, 1, 2), (1, 2, 3, 4), (1, 2, 4, 6), (1, 3, 4, 5), (1, 3, 5, 6), (2, 0, 0, 1), (None, 0, 0, 2), (None, 1, 0, 1), (None, 1, 1, 2)]
    assert got == sorted(want, key=str)


def test_segments_fall_back_to_their_source(spark):
    blocks = spark.createDataFrame([(1, 0, " one "), (1, 1, " "), (1, 2, "two"), (1, 3, "three"), (1, 4, None), (2, 0, "alone"), (None, 0, "n")], "doc_id int, idx int, text string")
    units = spark.createDataFrame([(1, 0, 1, "eins "), (1, 0, 0, " und"), (1, 1, 0, "  "), (1, 9, 0, "x"), (None, 0, 0, "m")], "doc_id int, segment int, unit_idx int, text string")
    mapped = documents.segments_to_blocks(blocks, units)
    got = {(r.doc_id, r.idx): (r.translated, r.used) for r in mapped.collect()}
    assert got == {(1, 0): ("und eins", "und eins"), (1, 1): ("", ""), (1, 2): ("", "two"), (1, 3): ("", "three"), (1, 4): ("", ""), (2, 0): ("", "alone"), (None, 0): ("m", "m")}
    assert {r.doc_id: (r.source, r.translated) for r in documents.segment_texts(mapped).collect()} == {1: ("one", "und eins"), 2: ("alone", "alone"), None: ("n", "m")}


# --- alerts and series


def sample(i, ts, value, metric="m", label="p", instance="i"):
    return (i, ts, metric, label, instance, value)


SAMPLE = "event_id int, ts timestamp, metric string, label string, instance string, value double"


def test_rows_without_a_time_stay(spark):
    d = spark.createDataFrame([sample(0, T0, 1.0), sample(1, None, 5.0), sample(2, T0 + timedelta(seconds=30), 4.0)], SAMPLE)
    assert {r.event_id: r.increase for r in alerts.counter_increase(d, 60).collect()} == {0: 0.0, 1: None, 2: 3.0}
    a = spark.createDataFrame([(0, "l", T0, "warn"), (1, "l", None, "warn"), (2, None, T0, "ok")], "event_id int, label string, ts timestamp, level string")
    assert {r.event_id: (r.escalate, r.demote) for r in alerts.promote_warnings(a).collect()} == {0: (False, False), 1: (False, False), 2: (False, False)}
    with pytest.raises(Exception, match="missing"):
        alerts.alert_eval(d, (alerts.Rule("r", "missing > 1", 0, "warning"),)).collect()


def test_increases_over_steps(spark):
    at = [0, 10, 30, 31, 200, 3590, 3605]
    value = [5.0, 7.0, 8.0, 2.0, 4.0, 9.0, 1.0]
    rows = [sample(i, T0 + timedelta(seconds=s), v) for i, (s, v) in enumerate(zip(at, value, strict=True))] + [sample(90, None, 1.0), sample(91, T0, None)]
    got = {r.step: r.increase for r in series.increases(spark.createDataFrame(rows, SAMPLE), 60, ("metric", "label", "instance")).collect()}
    base, before, growth = int(T0.timestamp()), None, {}
    for s, v in zip(at, value, strict=True):
        growth[s] = 0.0 if before is None else v if v < before else v - before
        before = v
    want = {}
    for step in range(0, -(-3605 // 30) + 1):
        seen = [g for s, g in growth.items() if step * 30 - 60 < s <= step * 30]
        if seen:
            want[base // 30 + step] = sum(seen)
    assert got == pytest.approx(want)
    with pytest.raises(ValueError, match="whole number"):
        series.increases(spark.createDataFrame(rows, SAMPLE), 45)


def test_rules_hold_and_fire(spark):
    rule = series.Rule("both", (series.Operand("a", ">", 2, 60), series.Operand("b", "<", 1)), 60, "warning")
    rows = []
    for k in range(20):
        t = T0 + timedelta(seconds=30 * k)
        rows.append(sample(2 * k, t, float(3 * k), "a"))
        rows.append(sample(2 * k + 1, t, 0.0 if k < 10 else 2.0, "b"))
    fired = series.firing(spark.createDataFrame(rows, SAMPLE), (rule, series.Rule("none", (series.Operand("nowhere", ">", 0),), 0, "x")))
    base = int(T0.timestamp()) // 30
    assert sorted(r.step - base for r in fired.collect()) == [3, 4, 5, 6, 7, 8, 9]
    gap = [x for x in rows if not T0 + timedelta(seconds=100) < x[1] < T0 + timedelta(seconds=400)]
    down = series.firing(spark.createDataFrame(gap, SAMPLE), tuple(r for r in series.RULES if r.name == "BackendDown")).collect()
    assert sorted(r.step - base for r in down) == [8, 9, 10, 11, 12, 13]
    assert len(series.RULES) == 18


def test_pressure_is_carried_between_days(spark):
    rows = [(T0 + timedelta(hours=13 * k), k * 2, 0, 0, 0) for k in range(6)] + [(None, 7, 0, 0, 0)]
    d = spark.createDataFrame(rows, "sampled_at timestamp, litellm_retry long, litellm_circuit_opened long, ocr_retry long, ocr_rejected long")
    got = {r.sampled_at: r.delta for r in lifecycle.pressure(d).collect()}
    assert [got[T0 + timedelta(hours=13 * k)] for k in range(1, 6)] == [2] * 5 and got[None] == 0


# --- texts


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("few", [0, 1])
def test_edit_distance(monkeypatch, few):
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randint(0, 40))) for _ in range(2))
        b = b if r.random() < 0.5 else a[:20] + b[:5] + a[22:]
        a, b = (a * 20, b * 20) if few and r.random() < 0.1 else (a, b)
        assert edits(a, b) == plain_distance(a, b)
        assert edits(a.split("a"), b.split("a")) == plain_distance(a.split("a"), b.split("a"))


def test_scores_of_a_million_characters(spark):
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(125_000))
    places = sorted({r.randrange(len(text)) // 8 * 8 for _ in range(40)})
    other = list(text)
    for p in places:
        other[p] = "z"
    got = evaluation.cer_wer(spark.createDataFrame([(text, "".join(other))], "reference string, hypothesis string")).select("cer", "wer").first()
    assert got.cer == pytest.approx(len(places) / len(text)) and got.wer == pytest.approx(len(places) / 125_000)


def test_corrections_by_page_document_and_so_far(spark):
    r = random.Random(4)
    rows = [(d, p, raw, raw if r.random() < 0.5 else raw[:-1] + "x" if r.random() < 0.7 else "quite another", r.random()) for d in (3, 7, 20_001, 20_002) for p in (1, 2) for raw in ("some words here", "more of them", "and the last")]
    lines = spark.createDataFrame(rows, "doc_id int, page_no int, raw string, corrected string, confidence double")
    got = {(x.level, x.doc_id, x.page_no): x for x in quality.correction_totals(lines).collect()}
    total = Counter()
    for d in (3, 7, 20_001, 20_002):
        document = Counter()
        for p in (1, 2):
            mine = [x for x in rows if x[:2] == (d, p)]
            ok = [x for x in mine if x[3] != x[2] and x[3] != "quite another"]
            after = [min(1.0, max(x[4], 0.9)) if x in ok else x[4] for x in mine]
            page = Counter(considered_blocks=3, corrected_blocks=len(ok), rejected_lines=sum(x[3] == "quite another" for x in mine), changed_characters=len(ok))
            row = got["page", d, p]
            assert {c: row[c] for c in page} == dict(page)
            assert row.confidence_delta == pytest.approx(sum(after) / 3 - sum(x[4] for x in mine) / 3, abs=6e-5)
            document.update(page)
        total.update(document)
        assert all(got["document", d, None][c] == document[c] and got["running", d, None][c] == total[c] for c in document)
    deltas = [got["page", d, p].confidence_delta for d in (3, 7, 20_001, 20_002) for p in (1, 2)]
    assert got["running", 20_002, None].confidence_delta == pytest.approx(sum(deltas), abs=1e-4)


def test_diffs_match_a_plain_version(spark):
    """A diff, applied to the first text, gives the second."""
    r = random.Random(5)
    pairs = [("\n".join(r.choice("abcd") for _ in range(r.randint(0, 8))), "\n".join(r.choice("abcd") for _ in range(r.randint(0, 8)))) for _ in range(80)] + [(None, "a"), ("a", "a"), ("", "")]
    for x in quality.correction_diff(spark.createDataFrame(pairs, "raw string, corrected string")).collect():
        a, b = (x.raw or "").splitlines(), (x.corrected or "").splitlines()
        if (x.raw or "") == (x.corrected or ""):
            assert x.diff == ""
            continue
        out, at = [], 0
        for line in x.diff.split("\n")[2:] if x.diff else []:
            if line.startswith("@@"):
                begin, n = (line.split()[1][1:].split(",") + ["1"])[:2]
                begin = int(begin) - (int(n) > 0)
                out, at = out + a[at:begin], begin
            elif line[0] == "+":
                out.append(line[1:])
            else:
                assert a[at] == line[1:]
                out, at = out + a[at : at + 1] * (line[0] == " "), at + 1
        assert out + a[at:] == b


# --- logs and tables


def test_types_come_from_the_log_not_from_its_text(spark):
    lines = [
        r'{"msg":"litellm_retry","reason":"said \"attempt\":\"7\" twice","attempt":2,"status":"503"}', '{"msg":"ocr_x","attempt":"+4","status":" 5"}', '{"msg":"ocr_y","attempt":2.9,"status":true}',
        '{"msg":"ocr_z","attempt":null,"status":12345678901234567890}', '{"msg":"ocr_fallback_triggered","total_ms":"1e3","extract_ms":1e3,"ocr_ms":[1]}',
    ]
    ocr, rel = logs.route(logs.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert {x.event_name: (x.attempt, x.status) for x in rel.collect()} == {"litellm_retry": (2, 503), "ocr_x": (4, 0), "ocr_y": (2, 0), "ocr_z": (0, 0)}
    row = ocr.first()
    assert (row.total_ms, row.extract_ms, row.ocr_ms) == (0, 1000, 0)
    plan = logs.route(logs.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string")))[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1


def test_a_batch_of_logs_that_is_run_again_is_written_once(spark, tmp_path):
    lines = [('{"time":"2024-01-0%dT00:00:00Z","msg":"%s"}' % (1 + i % 3, "ocr_fallback_triggered" if i % 2 else "ocr_retry"),) for i in range(10)]
    src, a, b = (str(tmp_path / n) for n in ("in", "a", "b"))
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(src)

    class Broken(Exception):
        pass

    def failing(batch, n):
        ocr, _ = logs.route(logs.parse_log_lines(batch))
        results.write_events(ocr, a, batch=n)
        raise Broken

    s = spark.readStream.text(src)
    with pytest.raises(Exception, match="Broken"):
        s.writeStream.foreachBatch(failing).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(a).count() == 5
    streams.route_logs(s, a, b, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(a).count() == 5 and spark.read.parquet(b).count() == 5
    streams.log_writer(a, b)(spark.read.text(src), 0)
    assert spark.read.parquet(a).count() == 5 and spark.read.parquet(b).count() == 5


def test_retention_on_storage(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, T0 + timedelta(hours=6 * i)) for i in range(40)] + [(99, None)]
    results.write_events(spark.createDataFrame(rows, "id int, recorded_at timestamp"), path)
    cut = T0 + timedelta(hours=6 * 21)  # inside of a day
    as_of = cut + timedelta(days=30)
    assert results.prune_events(spark, path, as_of) == 21
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [*range(21, 40), 99]
    days = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("event_date")}
    assert min(d for d in days if "HIVE" not in d) == f"event_date={cut.date()}"
    assert results.prune_events(spark, path, as_of) == 0


@pytest.mark.parametrize("gone", [False, True])
def test_retention_that_stopped_half_way(spark, tmp_path, gone):
    path, cut = tmp_path / "t", T0 + timedelta(hours=12)
    d = spark.createDataFrame([(i, T0 + timedelta(hours=3 * i)) for i in range(16)], "id int, recorded_at timestamp")
    results.write_events(d, str(path))
    beside = path / "_retention" / f"event_date={T0.date()}"
    d.where(F.to_date("recorded_at") == F.lit(T0.date())).where(F.col("recorded_at") >= F.lit(cut)).write.parquet(str(beside))
    if gone:  # the old folder had been deleted, the new one not yet moved
        (path / f"event_date={T0.date()}").rename(tmp_path / "old")
    assert results.prune_events(spark, str(path), cut + timedelta(days=30)) == (0 if gone else 4)
    assert sorted(r.id for r in spark.read.parquet(str(path)).collect()) == list(range(4, 16))
    assert not (path / "_retention").exists()


def test_jobs_are_forgotten(spark, tmp_path):
    import os

    schema = "event_id int, job_id string, status string, stage string, updated_at timestamp"
    batches = [
        [(i, f"j{i}", "processing", "a", T0 + timedelta(minutes=i)) for i in range(20)],
        [(20 + i, f"j{i}", "completed", "b", T0 + timedelta(minutes=30 + i)) for i in range(20)] + [(50, "late", "pending", "", T0 + timedelta(hours=2))],
        [(60, "j0", "processing", "again", T0 + timedelta(hours=3)), (61, "next", "pending", "", T0 + timedelta(hours=40))],
        [(70, "j1", "processing", "anew", T0 + timedelta(hours=41)), (71, "next", "pending", "", T0 + timedelta(hours=41))],
        [(80, "next", "pending", "", T0 + timedelta(hours=42))],
    ]
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        for f in src.glob("*.parquet"):
            if f.stat().st_mtime > 1e9:
                os.utime(f, (i + 1, i + 1))
    streams.use_rocksdb(spark)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    w = streams.job_changes(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    w.awaitTermination()
    got = sorted((r.job_id, r.status, r.stage) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [(f"j{i}", *x) for i in range(20) for x in (("processing", "a"), ("completed", "b"))] + [("late", "pending", ""), ("next", "pending", ""), ("j1", "processing", "anew"), ("j1", "stuck", "anew")]
    assert got == sorted(want)  # the row of a closed job says nothing, and that of a forgotten one begins it anew
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "last").load()
    assert {r["key"]["job_id"] for r in state.select("key").collect()} == {"j1", "next"}


def test_markup_pieces_without_their_marks_are_left_out(spark):
    raws = ["<BLOCK>text[0,0,9,9]<FORK>x<BLOCK>broken<BLOCK>nobox<FORK>n<BLOCK>title<LEVEL2>[0,0,99,99]<FORK>y [1]", "<|ref|>t<|/ref|>no box<|ref|>table<|/ref|> <|det|>[[0,0,9,9],[1,1,5,5]]<|/det|>z<|det|>stray", "<|det|>caption [0,0,9,9]<|/det|>c<|det|>open", None]
    d = spark.createDataFrame([(i, 1, r, 999, 999) for i, r in enumerate(raws)], "doc_id int, page_no int, raw string, width int, height int")
    got = sorted((r.doc_id, r.reading_order, r.text, r.region_class, r.hierarchy_level, r.x2) for r in quality.parse_markup(d).collect())
    assert got == [(0, 1, "x", "body", 0, 9.0), (0, 2, "y [1]", "title", 2, 99.0), (1, 1, "z", "table", 0, 9.0), (1, 2, "z", "table", 0, 5.0), (2, 1, "c", "caption", 0, 9.0)]


def test_metric_samples_count_the_errors_of_a_label(spark, tmp_path):
    """A sample's value is the number of its label's errors so far, over hours and at equal times."""
    from pagemill.bindings import bound

    at = [datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 5, 0), datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 3, 0, 0), datetime(2024, 1, 1, 0, 10), datetime(2024, 1, 1, 6, 0)]
    rows = [(900 - i, t, 3 * (i % 2), "error" if i != 5 else "view") for i, t in enumerate(at)] + [(7, at[0], 1, "error"), (8, at[3], None, "error")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.label, r.value) for r in bound(spark, str(tmp_path), "metric_samples").collect()}
    assert got == {896: ("p0", 1.0), 898: ("p0", 2.0), 900: ("p0", 3.0), 899: ("p0", 4.0), 897: ("p0", 5.0), 7: ("p1", 1.0), 8: ("p2", 1.0)}


def test_windows_full_of_samples_are_running_sums(spark):
    """Sums over a window don't go over its rows once for each row: no frame of the plan begins at a distance."""
    import contextlib
    import io
    import re

    n = 6_000
    d = spark.range(n).selectExpr("CAST(id AS INT) AS event_id", "timestamp_micros(1700000000000000 + id DIV 2 * 20000000) AS ts", "'m' AS metric", "'p' AS label", "CAST(id AS DOUBLE) AS value")
    grown = alerts.counter_increase(d, 86_400)
    a = alerts.promote_warnings(d.selectExpr("event_id", "label", "ts", "CASE WHEN event_id % 3 = 0 THEN 'warn' ELSE 'ok' END AS level"))
    for frame, start in ((grown, "86400"), (a, "3600")):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            frame.explain(True)
        plan = out.getvalue()
        assert re.findall(r"RangeFrame, (\S+),", plan) and set(re.findall(r"RangeFrame, (\S+),", plan)) == {"unboundedpreceding$()"}, start
    got = {r.event_id: r.increase for r in grown.collect()}
    first = lambda i, size: max(0, (i // 2 * 20 - size + 19) // 20 * 2)
    assert got == {i: float(sum(1 for k in range(first(i, 86_400), i // 2 * 2 + 2) if k)) for i in range(n)}
    warns = {r.event_id: r.warns_1h for r in a.collect()}
    assert warns == {i: sum(1 for k in range(first(i, 3_600), i // 2 * 2 + 2) if k % 3 == 0) for i in range(n)}


def test_edit_distance_of_long_unlike_texts():
    """Bounds that meet need no matrix, and a band that is too narrow is widened; misread texts are of any length."""
    import time

    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmno") for _ in range(6)) for _ in range(20_000)]
    text = " ".join(words)
    began = time.process_time()
    assert edits(text, text.translate(str.maketrans("eo", "xy"))) == text.count("e") + text.count("o")
    assert time.process_time() - began < 2  # the whole matrix takes more than ten times that
    for change in (0.02, 0.2, 0.6):
        a = words[:400]
        b = [w[::-1] if r.random() < change else w for i, w in enumerate(a) if i % 9 != 4] + words[r.randint(390, 410) : 430]
        x, y = " ".join(a), " ".join(b)
        assert edits(x, y) == edits(y, x) == plain_distance(x, y)
        assert edits(a * 4, b * 4) == plain_distance(a * 4, b * 4)


def test_steps_of_up_are_made_by_many_tasks(spark):
    """Steps between the first sample and the last one are no work of a single task."""
    rows = [sample(1, T0, 1.0), sample(2, T0 + timedelta(seconds=30 * 9_999), 1.0)]
    d = series.up(spark.createDataFrame(rows, SAMPLE))
    got = {r.step: (r.end, r.last) for r in d.collect()}
    first = int(T0.timestamp()) // 30
    assert got == {first + k: (first + 9_999, 1.0 if k in (0, 9_999) else 0.0) for k in range(10_000)}
    sizes = [r.n for r in d.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 1


def test_ratios_by_bounds_are_those_of_difflib(monkeypatch):
    import difflib

    from pagemill.functions import pandas_udfs as udfs

    r = random.Random(8)
    texts = ["".join(r.choice("abc dé") for _ in range(r.choice([0, 1, 20, 199, 200, 260]))) for _ in range(40)]
    pairs = [(x, r.choice([x, x[: len(x) // 2], r.choice(texts), x.replace("a", "z"), x[::-1]])) for x in texts * 4]
    for x, y in pairs:
        want = difflib.SequenceMatcher(None, x, y).ratio()
        assert udfs.ratio(x, y) == want
        assert all(udfs.reaches(x, y, least) == (want >= least) for least in (0.0, 0.3, 0.55, 0.9, want, 1.0))
    monkeypatch.setattr(udfs.difflib, "SequenceMatcher", None)  # bounds need no matching
    assert udfs.reaches("x" * 300, "x" * 300, 0.55) and not udfs.reaches("a line of text", "no", 0.55) and not udfs.reaches("abc" * 9, "xyz" * 9, 0.55)


def test_job_changes_asks_the_state_seldom():
    """ST05: a new job costs one read, one write and one timer; the timer of a stuck job sets the one that forgets it."""
    import pandas as pd

    from pagemill.streaming import streams

    class Handle:
        state, timers = None, set()

        def __init__(self):
            self.calls = []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.state

        def exists(self):
            self.calls.append("exists")
            return self.state is not None

        def update(self, new):
            self.calls.append("update")
            self.state = new

        def clear(self):
            self.state = None

        def registerTimer(self, at):
            self.calls.append("timer")
            self.timers = self.timers | {at}

        def deleteTimer(self, at):
            self.timers = self.timers - {at}

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    def rows(*found):
        return iter([pd.DataFrame([("j", i, status, "s", pd.Timestamp(ms, unit="ms")) for i, (ms, status) in enumerate(found)], columns=["job_id", "event_id", "status", "stage", "updated_at"])])

    job, handle, day = streams.JobState(), Handle(), 24 * 60 * 60 * 1000
    job.init(handle)
    assert [list(d["status"]) for d in job.handleInputRows(("j",), rows((5, "processing"), (0, "pending")), None)] == [["pending", "processing"]]
    assert handle.calls == ["get", "update", "timer"] and handle.timers == {5 + 600_000}
    assert list(job.handleInputRows(("j",), rows((5, "processing")), None)) == []
    handle.timers = set()
    assert [list(d["status"]) for d in job.handleExpiredTimer(("j",), At(5 + 600_000), At(5 + 600_000))] == [["stuck"]]
    assert handle.timers == {5 + day} and handle.state is not None
    assert list(job.handleExpiredTimer(("j",), At(5 + day), At(5 + day))) == [] and handle.state is None
    list(job.handleInputRows(("j",), rows((5, "processing")), None))
    assert len(list(job.handleExpiredTimer(("j",), At(6 + day), At(5 + 600_000)))) == 1 and handle.state is None
