"""Small examples whose results are known by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagemill.functions import errors, geometry
from pagemill.functions import text as tx
from pagemill.operators import alerts, documents, evaluation, events, jobs, layout, lifecycle, providers, quality
from pagemill.sources import logs, results


def one(spark, sql):
    return spark.sql(f"SELECT {sql}")


def test_normalize_text(spark):
    cases = {"": "", "  a  b ": "a b", "line one\nline two\n\nline three": "line one line two\n\nline three", "\n\n\n\n": "", "a b": "a b", "x\n\n \n\ny": "x\n\ny"}
    d = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", tx.normalize_text(F.col("t")))
    assert [(r.t, r.got) for r in d.collect()] == [(k, v) for k, v in cases.items()]


def test_windows_and_chunks(spark):
    d = spark.createDataFrame([(1, 12), (2, 0), (3, 3)], "doc_id int, page_count int")
    got = sorted((r.doc_id, r.start, r.end) for r in documents.page_windows(d, 5, 1).collect())
    assert got == [(1, 0, 5), (1, 4, 9), (1, 8, 12), (3, 0, 3)]
    units = spark.createDataFrame([(1, i, w) for i, w in enumerate([50, 40, 70, 60, 90, 10])], "doc_id int, unit_idx int, words int")
    assert [r.chunk_id for r in documents.pack_chunks(units, 80, 150).orderBy("unit_idx").collect()] == [0, 0, 1, 1, 2, 2]


def test_window_argument():
    assert events.parse_window("")[0] == "last_24h"
    with pytest.raises(ValueError, match="invalid window"):
        events.parse_window("99d")


def test_boxes(spark):
    d = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0), (0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 6.0, 6.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    got = [r[0] for r in d.select(geometry.iou(geometry.box("a"), geometry.box("b"))).collect()]
    assert got == [pytest.approx(1 / 3), 0.0]


BLOCK = "doc_id int, page_no int, idx long, text string, confidence double, x1 double, y1 double, x2 double, y2 double, lang string"


def test_reading_order_both_directions(spark):
    rows = [(i, 1, k, t, 0.9, x, y, x + 180.0, y + 20.0, lang) for i, lang in ((1, "en"), (2, "ar")) for k, (t, x, y) in enumerate([("r1", 400.0, 0.0), ("l1", 0.0, 0.0), ("l2", 0.0, 40.0), ("r2", 400.0, 40.0)])]
    d = layout.reading_order(layout.detect_columns(spark.createDataFrame(rows, BLOCK), F.lit(600.0)))
    got = {i: [r.text for r in d.where(f"doc_id = {i}").orderBy("reading_order").collect()] for i in (1, 2)}
    assert got == {1: ["l1", "l2", "r1", "r2"], 2: ["r1", "r2", "l1", "l2"]}
    row = spark.createDataFrame([(1, 1, 0, "left", 0.9, 0.0, 2.0, 50.0, 20.0, "ur"), (1, 1, 1, "right", 0.9, 55.0, 4.0, 70.0, 22.0, "ur")], BLOCK)
    assert [r.text for r in layout.reading_order(layout.detect_columns(row)).orderBy("reading_order").collect()] == ["right", "left"]


def test_ensemble_merge(spark):
    a = spark.createDataFrame([(1, 1, 0, "a0", 0.5, 0.0, 0.0, 10.0, 10.0, "en"), (1, 1, 1, "a1", 0.9, 0.0, 20.0, 10.0, 30.0, "en")], BLOCK)
    b = spark.createDataFrame([(1, 1, 0, "b0", 0.8, 0.0, 0.0, 10.0, 10.0, "en"), (1, 1, 1, "b1", 0.2, 0.0, 50.0, 10.0, 60.0, "en")], BLOCK)
    assert [r.text for r in layout.ensemble_merge(a, b).orderBy("reading_order").collect()] == ["b0", "a1", "b1"]


def test_cer_and_wer(spark):
    d = spark.createDataFrame([(1, "abcde", "abXde"), (2, "the quick brown fox", "the quick brawn fox"), (3, "", "text"), (4, "", "")], "doc_id int, reference string, hypothesis string")
    got = {r.doc_id: (r.cer, r.wer) for r in evaluation.cer_wer(d).collect()}
    assert got[1][0] == pytest.approx(0.2) and got[2][1] == pytest.approx(0.25) and got[3] == (1.0, 1.0) and got[4] == (0.0, 0.0)


def test_corrections_that_go_too_far_are_rejected(spark):
    d = spark.createDataFrame([(1, "helo world", "hello world", 0.5), (1, "abc", "something else", 0.5)], "doc_id int, raw string, corrected string, confidence double")
    r = quality.correction_stats(d).first()
    assert (r.considered_blocks, r.corrected_blocks, r.rejected_lines, r.reason) == (2, 1, 1, "ok") and r.confidence_delta == 0.2


def test_markup_forms(spark):
    raws = ["<|det|>text [10,20,30,40]<|/det|>Hello", "plain words", "<|ref|>Title<|/ref|><|det|>[[0,0,999,999]]<|/det|>\nHi\n<|ref|>x<|/ref|><|det|>bad<|/det|>yo", "<BLOCK>heading<LEVEL3>[0,0,10,10]<FORK>One<BLOCK>text[1,1,2,2]<FORK>Two", ""]
    d = spark.createDataFrame([(i, 1, r, 1000, 2000) for i, r in enumerate(raws)], "doc_id int, page_no int, raw string, width int, height int")
    b = quality.parse_markup(d).orderBy("doc_id", "reading_order").collect()
    got = [(r.doc_id, r.text, r.region_class, r.hierarchy_level) for r in b]
    assert got == [(0, "Hello", "body", 0), (1, "plain words", "body", 0), (2, "Hi", "title", 1), (2, "yo", "body", 0), (3, "One", "heading", 3), (3, "Two", "body", 0)]
    assert b[0].x1 == pytest.approx(10 / 999 * 1000) and b[1].x2 == 1000.0
    assert quality.plain_text(quality.parse_markup(d)).where("doc_id = 3").first().text == "One\nTwo"


def test_page_quality(spark):
    d = spark.createDataFrame([(1, "same\nsame\nsame\nsame"), (2, "<tr" * 250), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.repeated_line_ratio, r.degenerate) for r in quality.page_quality(d).collect()}
    assert got == {1: (0.75, True), 2: (0.0, True), 3: (0.0, False)}


def test_timeout_reasons(spark):
    cases = {"context deadline exceeded": "context_deadline", "provider x status 504: y": "gateway_timeout", "Client.Timeout exceeded": "client_timeout", "boom": ""}
    d = spark.createDataFrame(list(cases.items()), "m string, want string").withColumn("got", errors.timeout_reason(F.col("m")))
    assert all(r.got == r.want for r in d.collect())


def test_retry_plan(spark):
    d = spark.createDataFrame([("a", "failed", "request timeout", 0, 3), ("b", "failed", "request timeout", 2, 3), ("c", "failed", "Invalid API key", 0, 3), ("d", "failed", "  ", 0, 0), ("e", "completed", "", 0, 3)], "job_id string, status string, error string, attempt long, max_attempts long")
    now = datetime(2024, 1, 1)
    got = {r.job_id: (r.next_status, r.delay_s, r.dead_reason) for r in jobs.retry_plan(d, False, now).collect()}
    assert got == {"a": ("pending", 2.0, None), "b": ("failed", None, "request timeout"), "c": ("failed", None, "Invalid API key"), "d": ("failed", None, "job failed without an error message")}


def test_counter_reset_counts_from_zero(spark):
    d = spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i), "m", "p", v) for i, v in enumerate([5.0, 9.0, 2.0, 3.0])], "event_id int, ts timestamp, metric string, label string, value double")
    assert [r.increase for r in alerts.counter_increase(d, 60).orderBy("ts").collect()] == [0.0, 4.0, 6.0, 3.0]


def test_checkpoint_levels(spark):
    d = spark.createDataFrame([(30, 70, 100, 0), (90, 10, 80, 20), (60, 40, 100, 0), (90, 10, 94, 6), (90, 10, 100, 0), (0, 0, 0, 0)], "hits long, misses long, persists long, persist_failures long")
    assert [r.cause for r in providers.checkpoint_health(d).collect()] == ["hit_critical", "persist_critical", "hit_warn", "persist_warn", "normal", "hit_critical"]


def test_log_coercion_and_routing(spark):
    lines = ['{"time":"2024-01-01T00:00:00Z","msg":"ocr_fallback_triggered","job_id":"j","extract_ms":11,"ocr_ms":"22","translate_ms":3.9,"total_ms":"1.5"}', '{"msg":"litellm_retry","attempt":2,"status":503}', '{"msg":"ocr_x"}', "", "nope", "[1]", '{"msg": "other"}', "{bad"]
    rec = logs.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rec.count() == 4
    ocr, rel = logs.route(rec)
    r = ocr.first()
    assert (r.job_id, r.extract_ms, r.ocr_ms, r.translate_ms, r.total_ms, r.lang) == ("j", 11, 22, 3, 0, "")
    assert sorted((x.integration, x.attempt, x.status) for x in rel.collect()) == [("litellm", 2, 503), ("ocr", 0, 0)]


def test_metric_text(spark):
    lines = ["# HELP x", "queue_depth 12", 'score{provider="p1"} 0.75', "bad line here", ""]
    got = [(r.metric, r.label, r.value) for r in results.parse_metrics(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("queue_depth", "", 12.0), ("score", "p1", 0.75)]


def test_lifecycle_contract(spark):
    d = spark.createDataFrame([("job_created", "j", "c", "p", "t", -1, 0, 0), ("", "j", "c", "p", "t", 1, 0, 0)], "event string, job_id string, correlation_id string, provider string, event_time string, duration_ms long, retry_count long, queue_depth long")
    assert sorted(r.reasons for r in lifecycle.invalid_events(d).collect()) == [["missing event"], ["negative duration_ms"]]
    assert "ocr_started" in lifecycle.missing_events(d).first().missing


def test_scores_keep_rows_with_a_null_side(spark):
    d = spark.createDataFrame([(1, None, "ab"), (2, "ab", None), (3, None, None), (4, "a b c", "a x c")], "doc_id int, reference string, hypothesis string")
    got = {r.doc_id: (r.cer, r.wer) for r in evaluation.cer_wer(d).collect()}
    assert got == {1: (1.0, 1.0), 2: (1.0, 1.0), 3: (0.0, 0.0), 4: (pytest.approx(0.2), pytest.approx(1 / 3))}


def test_word_distance_matches_a_plain_version(spark):
    import random

    r = random.Random(1)

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            diagonal, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (p != q))
        return row[-1]

    pairs = [([r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(0, 12))], [r.choice("abcde") for _ in range(r.randint(0, 12))]) for _ in range(60)]
    d = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert [x.n for x in d.select(evaluation.word_distance(F.col("a"), F.col("b")).alias("n")).collect()] == [plain(*p) for p in pairs]


def test_page_quality_has_a_row_for_each_row(spark):
    text = " ".join(f"w{i}" for i in range(50))
    d = spark.createDataFrame([(1, text), (1, f"{text} {text}"), (None, "a\x0cb\u2028a\x85a"), (2, "w " * 34)], "doc_id int, text string")
    rows = sorted((str(r.doc_id), r.repetition_ratio, r.repeated_line_ratio, r.degenerate) for r in quality.page_quality(d).collect())
    assert rows == [("1", 0.0, 0.0, False), ("1", pytest.approx(16 / 66), 0.0, True), ("2", 0.0, 0.0, False), ("None", 0.0, 0.5, True)]


def test_columns_keep_blocks_without_coordinates(spark):
    d = spark.createDataFrame([(1, 1, 0, "a", 0.9, None, 0.0, None, 9.0, "en"), (1, 1, 1, "b", 0.9, 0.0, 0.0, 50.0, 9.0, "en"), (1, 1, 2, "c", 0.9, 400.0, 0.0, 450.0, 9.0, "en"), (1, 1, 3, "d", 0.9, 400.0, 20.0, 450.0, 29.0, "en")], BLOCK)
    assert {r.text: r.column_id for r in layout.detect_columns(d).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_health_over_hours_and_unknown_results(spark):
    results = ["success", "what", "transient", "permanent", "success", "success"]
    d = spark.createDataFrame([(i, "p", datetime(2024, 1, 1 + i // 4, 10 + i % 4 // 2, i), x) for i, x in enumerate(results)], "event_id int, provider string, attempt_time timestamp, result string")
    score, want = 1.0, {}
    for i, x in enumerate(results):
        score = min(1.5, max(0.05, 0.78 * score + 0.22 * {"success": 1.2, "transient": 0.35}.get(x, 0.15)))
        want[str(datetime(2024, 1, 1 + i // 4).date())] = pytest.approx(score)
    assert {str(r.day): r.score for r in providers.provider_health(d).collect()} == want


def test_increase_over_slices_matches_a_plain_version(spark):
    import random

    r = random.Random(5)
    rows, at = [], 0
    for i in range(300):
        at += r.choice([1, 20, 200])
        rows.append((i, datetime.fromtimestamp(1_700_000_000 + at), "m", r.choice(["a", None]), float(r.randint(0, 9))))
    want = {}
    for label in ("a", None):
        mine = [(x[0], x[1].timestamp(), x[4]) for x in rows if x[3] == label]
        steps = [0.0] + [v if v < w else v - w for (_, _, w), (_, _, v) in zip(mine, mine[1:], strict=False)]
        for i, t, _ in mine:
            want[i] = sum(s for s, (_, u, _) in zip(steps, mine, strict=True) if t - 60 <= u <= t)
    d = spark.createDataFrame(rows, "event_id int, ts timestamp, metric string, label string, value double")
    assert {x.event_id: x.increase for x in alerts.counter_increase(d, 60).collect()} == pytest.approx(want)


def test_alert_runs_over_days_match_a_plain_version(spark):
    import random

    r = random.Random(8)
    rule, rows = alerts.Rule("High", "v > 0", 7_200, "warning"), []
    for label in ("a", None):
        at, up = 1_700_000_000, 1
        for _ in range(200):
            at += r.choice([600, 7_200, 40_000, 200_000])
            up = up if r.random() < 0.85 else 1 - up
            rows.append((label, datetime.fromtimestamp(at), float(up)))
    want = []
    for label in ("a", None):
        since = None
        for mine, ts, v in rows:
            if mine == label:
                since = (since or ts) if v > 0 else None
                if since and (ts - since).total_seconds() >= 7_200:
                    want.append((str(label), ts, since))
    got = alerts.alert_eval(spark.createDataFrame(rows, "label string, ts timestamp, v double"), (rule,)).collect()
    assert sorted((str(x.label), x.ts, x.since) for x in got) == sorted(want)


def test_promotion_over_hours_matches_a_plain_version(spark):
    import random

    r = random.Random(9)
    rows, at = [], 1_700_000_000
    for i in range(300):
        at += r.choice([0, 60, 900, 3_600, 9_000])
        rows.append((i, r.choice(["a", None]), datetime.fromtimestamp(at), r.choice(["warn", "ok", "ok", None])))
    want = {}
    for label in ("a", None):
        mine = [x for x in rows if x[1] == label]
        for k, (i, _, ts, level) in enumerate(mine):
            n = sum(1 for x in mine if x[3] == "warn" and 0 <= (ts - x[2]).total_seconds() <= 3_600)
            want[i] = (n, level == "warn" and n >= 3, k > 1 and mine[k - 1][3] == "ok" and mine[k - 2][3] == "ok")
    d = alerts.promote_warnings(spark.createDataFrame(rows, "event_id int, label string, ts timestamp, level string"))
    assert {x.event_id: (x.warns_1h, x.escalate, x.demote) for x in d.collect()} == want


def test_scores_of_long_texts_in_other_scripts(spark):
    words = ["größe", "漢字", "naïve", "שלום", "café", "x"] * 400
    edited = [w if i % 7 else "🙂" for i, w in enumerate(words)]
    d = spark.createDataFrame([(1, "  ".join(words), "\n".join(edited))], "doc_id int, reference string, hypothesis string")
    got = evaluation.cer_wer(d).first()
    changed = sum(1 for i in range(len(words)) if i % 7 == 0)
    assert got.wer == pytest.approx(changed / len(words)) and 0 < got.cer < 1
    assert got.asDict().keys() == {"doc_id", "reference", "hypothesis", "cer", "wer"}


def test_sequence_ratio_matches_a_plain_version(spark):
    """Matching blocks by the longest common run, leftmost first; short texts, so that no character is too popular."""
    import random

    from pagemill.functions.pandas_udfs import sequence_ratio

    def matched(a, b):
        best = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in [next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))]), default=(0, 0, 0))
        k, i, j = best[0], -best[1], -best[2]
        return 0 if k == 0 else k + matched(a[:i], b[:j]) + matched(a[i + k :], b[j + k :])

    r = random.Random(3)
    pairs = [("".join(r.choices("abc ", k=r.randint(0, 14))), "".join(r.choices("abc ", k=r.randint(0, 14)))) for _ in range(150)] + [(None, "a"), (None, None)]
    want = [2 * matched(a or "", b or "") / (len(a or "") + len(b or "")) if (a or b) else 1.0 for a, b in pairs]
    d = spark.createDataFrame(pairs, "a string, b string").select(sequence_ratio("a", "b").alias("x"))
    assert [x.x for x in d.collect()] == pytest.approx(want)


def test_scores_are_carried_from_batch_to_batch(spark, tmp_path):
    import os

    from pagemill.streaming import streams

    schema = "event_id int, provider string, attempt_time timestamp, result string"
    src, results = tmp_path / "in", ["success", "transient", "permanent", "success"]
    for i, x in enumerate(results):
        spark.createDataFrame([(i, "p", datetime(2024, 1, 1, i), x)] + [(9, "q", datetime(2024, 1, 1), "success")] * (i == 0), schema).coalesce(1).write.mode("append").parquet(str(src))
        for f in src.glob("*.parquet"):
            if f.stat().st_mtime > 1e9:
                os.utime(f, (i + 1, i + 1))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    streams.provider_scores(s, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    d = spark.read.parquet(str(tmp_path / "out"))
    score = 1.0
    for n, x in enumerate(results):
        score = 0.78 * score + 0.22 * {"success": 1.2, "transient": 0.35, "permanent": 0.15}[x]
        assert {r.provider: r.score for r in d.where(f"batch = {n}").collect()} == {"p": pytest.approx(score), "q": pytest.approx(0.78 + 0.22 * 1.2)}
