"""Near-duplicate documents and lines against plain versions."""

import random
from collections import Counter, defaultdict

from pyspark.sql import Row

from pagemill.llm import line_dedup, linking, near_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size int"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9, "k", 1) for i, t in rows], DOC)


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_groups(rows, width=4):
    sets, held, groups = {}, defaultdict(list), Sets([i for i, _ in rows])
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in held[s])
        for s in sets[i]:
            held[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                groups.join(i, j)
    return {i: (len(sets[i]), groups.find(i)) for i in sets}


def crowd(seed=5, n=260):
    """A chain of near copies around the threshold, copies, unrelated and tiny texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    base = [word() for _ in range(90)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base).upper()) for i in range(40)]
    rows += [(2000 + i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(60)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "one"), (3004, "ONE"), (3005, "a b c d e"), (3006, "a b c d"), (3007, "Été one two three"), (3008, "été one two three")]
    return rows


def test_groups_match_brute_force(spark):
    rows = crowd()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs_of(spark, rows)).collect()}
    want = plain_groups(rows)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_small_buckets_and_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(linking, "SMALL", 2)
    monkeypatch.setattr(linking, "BLOCK", 16)
    monkeypatch.setattr(linking, "STARS", 1)
    rows = crowd(8, 120)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs_of(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in plain_groups(rows).items()}


def test_hot_keys_are_treated_apart(spark, monkeypatch):
    monkeypatch.setattr(linking, "LEAST_HOT", 4)
    monkeypatch.setattr(linking, "SAMPLED", 0.6)
    seen = []
    real = linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df, name: (out := real(df, name), seen.append((name, out.count())))[0])
    rows = crowd(9, 100)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs_of(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in plain_groups(rows).items()}
    assert dict(seen)["hot-keys"] > 0


def test_large_groups_are_compared_in_blocks_without_a_row_for_each_pair(spark, monkeypatch):
    made = []
    real = linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df, name: (out := real(df, name), made.append((name, out.count())))[0])
    for block, small in ((1024, 1), (24, 1), (24, 4)):
        monkeypatch.setattr(linking, "BLOCK", block)
        monkeypatch.setattr(linking, "SMALL", small)
        made.clear()
        rows = crowd(10, 150)
        got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs_of(spark, rows)).collect()}
        assert got == {i: c for i, (_, c) in plain_groups(rows).items()}
        # one spanning forest for each pair of blocks, not a row for each pair of items
        assert [n for name, n in made if name == "links"][-1] < 1500


def test_texts_under_one_id_are_decided_on_their_own(spark):
    near = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "something else that is not repeated anywhere"), (2, None)]
    assert sorted(str(r.text) for r in near_dedup.keep_one(docs_of(spark, near)).collect()) == ["None", "a b c d e f g", "something else that is not repeated anywhere"]
    lines = [(1, "one line of text\nother"), (2, "new line here\none line of text"), (2, "one line of text\nlast of all")]
    assert sorted(r.text for r in line_dedup.dedup_lines(docs_of(spark, lines)).collect()) == ["last of all", "new line here", "one line of text\nother"]


def test_very_long_lines_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, long), (2, long + "x\nshort"), (3, long.upper())]
    got = {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_fates(docs_of(spark, rows)).collect()}
    assert got == {(1, 0): True, (2, 0): False, (2, 1): True, (3, 0): False}
    from pyspark.sql import functions as F

    extra = ("gone_doc", "gone_mark", "gone_lines", "lines_left", "new_text", "mark", "_id", "_gone", "a.b")
    d = docs_of(spark, [(1, "aa\nbb"), (2, "bb\ncc"), (3, "aa")]).withColumns({c: F.lit(c) for c in extra})
    for stage, want in ((line_dedup.dedup_lines, ["aa\nbb", "cc"]), (near_dedup.keep_one, ["aa", "aa\nbb", "bb\ncc"])):
        out = stage(d)
        assert out.columns == d.columns and sorted(r.text for r in out.collect()) == want
        assert all(r[c] == c for r in out.collect() for c in extra)


def test_segment_keys_find_every_pair_in_reach():
    r = random.Random(12)
    for _ in range(400):
        a = "".join(r.choice("abc") for _ in range(r.randint(12, 40)))
        b = list(a)
        for _ in range(r.randint(0, line_dedup.edits(len(a)))):
            k, p = r.randint(0, 2), r.randrange(len(b))
            b[p:p + (k > 0)] = [] if k == 1 else [r.choice("xyz")]
        b = "".join(b)
        short, long = sorted((a, b), key=len)
        if len(short) >= 12 and plain_distance(a, b) <= line_dedup.edits(len(short)):
            line, key, role = line_dedup.segment_keys([short, long])
            assert set(key[(line == 0) & (role == 0)]) & set(key[line == 1]), (short, long)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=str)
    assert near_dedup.near_groups(docs_of(spark, [])).count() == 0
    kept = near_dedup.keep_one(docs_of(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None", "None"]
    assert kept.columns == docs_of(spark, []).columns


def plain_lines(rows):
    first, occurrences = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for k, line in enumerate((t or "").split("\n")):
            line = line_dedup.normalised(line)
            if line:
                occurrences.append((i, k, line))
                first.setdefault(line, (i, k))
    lines = sorted(first)
    groups = Sets(lines)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for n, a in enumerate(lines):
        for b in lines[n + 1 :]:
            if abs(len(a) - len(b)) <= line_dedup.TAU and distance(a, b) <= line_dedup.TAU:
                groups.join(a, b)
    best = {}
    for line in lines:
        root = groups.find(line)
        best[root] = min(best.get(root, first[line]), first[line])
    return {(i, k): best[groups.find(line)] for i, k, line in occurrences}


def line_rows(seed=3):
    r = random.Random(seed)
    base = ["the quick brown fox jumps over it", "completely different line of text", "a b c d e f g h i j k l m n o p"]
    rows = []
    for i in range(60):
        lines = []
        for b in r.sample(base, 2):
            w = list(b)
            for _ in range(r.randint(0, 3)):
                k, p = r.randint(0, 2), r.randrange(len(w))
                if k == 0:
                    w.insert(p, r.choice("xyz"))
                elif k == 1:
                    del w[p]
                else:
                    w[p] = r.choice("xyz")
            lines.append("".join(w))
        lines.append("short")
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "THE  quick brown fox jumps over it")]


def test_lines_match_brute_force(spark):
    rows = line_rows()
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in line_dedup.line_fates(docs_of(spark, rows)).collect()}
    assert got == plain_lines(rows)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines_of_all_lengths(seed=11):
    """Copies and near copies of lines of 1 to 30 characters, in particular around those where an edit more is allowed."""
    r = random.Random(seed)
    lines = ["}", "}", "ok", "OK", "on", "all rights reserved.", "All  rights reserved.", "all right reserved.", "日本", "日本", ""]
    for n in [*range(1, 31), 10, 11, 12, 13, 22, 23, 24, 25, 26]:
        base = "".join(r.choice("abcdef gh") for _ in range(n)).strip() or "x"
        for k in (0, 0, 1, 1, 2, 3):
            w = list(base)
            for _ in range(k):
                kind, p = r.randint(0, 2), r.randrange(len(w) or 1)
                if kind == 0 or not w:
                    w.insert(p, r.choice("xyz"))
                elif kind == 1:
                    del w[p]
                else:
                    w[p] = r.choice("xyz")
            lines.append("".join(w))
    r.shuffle(lines)
    return [(i, "\n".join(lines[at : at + 4])) for i, at in enumerate(range(0, len(lines), 4))] + [(900, None), (901, "\n \n")]


def test_lines_of_every_length_match_brute_force(spark):
    rows = lines_of_all_lengths()
    at, groups = [], {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line := line_dedup.normalised(line):
                at.append((i, k, line))
    sets = Sets(sorted({x for _, _, x in at}))
    for a in sets.up:
        for b in sets.up:
            tau = min(2, min(len(a), len(b)) // 12)
            if a < b and abs(len(a) - len(b)) <= tau and plain_distance(a, b) <= tau:
                sets.join(a, b)
    for i, k, line in at:
        groups.setdefault(sets.find(line), (i, k))
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.kept) for r in line_dedup.line_fates(docs_of(spark, rows)).collect()}
    assert got == {(i, k): (*groups[sets.find(x)], groups[sets.find(x)] == (i, k)) for i, k, x in at}
    assert any(len(x) < 12 and groups[sets.find(x)] != (i, k) for i, k, x in at)


def test_short_copies_are_dropped(spark):
    rows = [(1, "All rights reserved.\n}"), (2, "}\nall  rights reserved.\nnew"), (3, "}")]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()} == {1: rows[0][1], 2: "new"}


def test_edit_distance_band_of_fewer_edits():
    r = random.Random(2)
    for tau in (0, 1, 2):
        for _ in range(1500):
            a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
            assert line_dedup.within(a, b, tau) == (plain_distance(a, b) <= tau)


def test_dedup_lines_keeps_first_occurrences(spark):
    rows = [(1, "a line that is long enough to count\nshort"), (2, "A line that is long enough to count\nand a second line that is only here"), (3, "a line that is long enough to count"), (4, None), (5, "")]
    out = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: ("and a second line that is only here", 35), 4: (None, 0), 5: ("", 0)}
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0
    assert line_dedup.line_fates(docs_of(spark, [(None, "a line that is long enough to count"), (7, "a line that is long enough to count")])).where("kept").collect()[0].doc_id == 7


def test_edit_distance_band():
    r = random.Random(1)
    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 9)))
        b = "".join(r.choice("ab") for _ in range(r.randint(0, 9)))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert line_dedup.within(a, b) == (row[-1] <= 2)


def test_sketch_fills_every_coordinate_and_estimates():
    import numpy as np

    from pagemill.llm.common import splitmix

    for n in (1, 2, 5, 50, 700):
        x = np.unique(splitmix(np.arange(1, n + 1, dtype=np.uint64)))
        s = near_dedup.sketch(x)
        assert len(s) == near_dedup.BANDS * near_dedup.ROWS and s.max() < np.iinfo(np.uint64).max
    a = np.unique(splitmix(np.arange(1000, dtype=np.uint64)))
    b = np.unique(splitmix(np.arange(200, 1200, dtype=np.uint64)))
    assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - 800 / 1200) < 0.1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([Row(a=i, b=i + 1) for i in range(40)] + [Row(a=100, b=101)])
    got = {r.id: r.component for r in linking.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
