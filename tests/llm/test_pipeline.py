"""The pipeline keeps what it should, and its stages agree with the operators."""

import pytest

DATA = "/root/testdata/sf0.001"


def test_pipeline_end_to_end(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        path = f"{cp.common.shared_dir(spark)}/test-{cp.common.new_name()}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    first, lines, near, mixed, packed = seen.values()
    assert lines.select("doc_id").subtract(first.select("doc_id")).count() == 0
    assert near.join(lines, ["doc_id", "text"], "left_anti").count() == 0
    assert mixed.join(near, ["doc_id", "text"], "left_anti").count() == 0
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    again = cp.near_dedup.near_groups(near, 5)
    assert again.where("NOT kept").count() == 0


def test_run_matches_a_plain_version(spark, tmp_path):
    """Every stage recomputed plainly on a small table: scores per text, lines and groups by brute force, the mix by SQL, ids by the library."""
    import random
    from collections import Counter

    import duckdb
    import pandas as pd
    from test_near import plain_groups, plain_lines
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    line = lambda: " ".join(word() for _ in range(r.randint(8, 14)))
    shared, rows, labels = [line() for _ in range(3)], [], []
    for i in range(160):
        lines = [line() for _ in range(r.randint(1, 5))]
        if i % 5 == 0:
            lines.append(r.choice(shared))
        bad = i % 8 == 3
        if bad:
            lines.append("you stupid scum idiot " + line())
        rows.append((i, "\n".join(lines), "en", r.choice(["a", "b", "c"])))
        labels.append((i, 1, int(bad)))
    # near copies whose lines differ by far more than two edits
    for i in range(160, 175):
        w = rows[i - 160][1].replace("\n", " ").split()
        rows.append((i, " ".join([*w, word()]) if len(w) > 25 else line(), "en", "a"))
        labels.append((i, 1, int((i - 160) % 8 == 3 and len(w) > 25)))
    rows += [(300, None, "en", "b"), (301, "", None, None), (302, rows[0][1], "en", "c")]
    docs = pd.DataFrame([(*x, len(x[1] or "")) for x in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    where = f"file://{tmp_path}"
    got = cp.run(spark, where).collect()

    of = cp.toxicity.fit(cp.common.table(spark, where, "documents"), cp.common.table(spark, where, "labels")).scorer()
    kept = {x[0]: x for x in rows if of(x[1]) < 0.5}
    assert len(rows) - len(kept) >= 15
    fates = plain_lines([(i, x[1]) for i, x in kept.items()])
    texts = {}
    for i, x in kept.items():
        if x[1] is None or not any(f != k for k, f in fates.items() if k[0] == i):
            texts[i] = x[1]
        elif left := [t for k, t in enumerate(x[1].split("\n")) if fates.get((i, k), (i, k)) == (i, k)]:
            texts[i] = "\n".join(left)
    assert 302 not in texts
    groups = plain_groups(list(texts.items()), 5)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    documents = pd.DataFrame([(i, t, kept[i][3]) for i, t in texts.items()], columns=["doc_id", "text", "source"])  # noqa: F841
    copies = {i: c for i, c in duckdb.sql(f"SELECT doc_id, copies FROM ({cp.mixing.ORACLE})").fetchall() if c}
    library = Tokenizer.from_file(cp.queries.tokenizer_path(cp.queries.WORD_BPE))
    sizes = {i: len(library.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in copies}
    held = Counter()
    for x in got:
        assert x.doc_tokens == sizes[x.doc_id]
        held[x.doc_id] += x.length
    assert held == {i: c * sizes[i] for i, c in copies.items()}


@pytest.mark.parametrize("part", ["queries", "oracle_sql"])
def test_entry_lists_them(part):
    import __spark_entry__ as e

    assert sum(k.startswith("op") or k == "pipeline" for k in getattr(e, part)()) == (14 if part == "queries" else 1)
