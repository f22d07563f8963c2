"""Spelling variants and periodic runs against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import periodic_runs, queries, spelling

DOC = "doc_id long, text string, lang string, word string, n int, start string, key string, shard int"
ODD = [None, "", " ", "\n\t", "a", "É", "a b a b", "x" * 3000, "日本語 テキスト", "ÀÉÎ×÷ÿ Straße STRASSE", "z " * 5000]


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "w", 1, "s", "k", 2) for i, t in enumerate(texts)], DOC)


# --- spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: b for w, vs in found.items() if vs and n[b := min(vs, key=lambda v: (-n[v], v))] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(found[w]), n.get(form.get(w))) for w in n)


def result(df):
    return sorted((x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in df.collect())


def misspelt_texts(r, n):
    words = ["".join(r.choice("abcdeéÿ") for _ in range(r.randint(4, 9))) for _ in range(60)]
    weights = [1 / (i + 1) for i in range(60)]

    def spell(w):
        k, at = r.randrange(12), r.randrange(len(w))
        return w[:at] + w[at + 1 :] if k == 0 else w[:at] + r.choice("abcé") + w[at:] if k == 1 else w[:at] + r.choice("abÿ") + w[at + 1 :] if k == 2 else w

    return [" ".join(spell(w) for w in r.choices(words, weights, k=r.randint(1, 60))).replace("ab", r.choice(["ab", "AB", "aB"])) for _ in range(n)]


@pytest.mark.parametrize("shard", [spelling.SHARD_WORDS, 7])
def test_variants(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    texts = misspelt_texts(random.Random(shard), 150) + ["kmnopq " * 40 + "kmnopr " * 9 + "kmnosr " * 3] + ODD * 3
    ids = [None if i % 40 == 7 else i // 2 for i in range(len(texts))]
    got = result(spelling.variants(docs_of(spark, texts, ids), spelling.mistyped))
    want = plain_variants(list(zip(ids, texts, strict=True)))
    assert got == want
    chained, crowded = sum(x[1] is not None and x[1] != x[2] for x in want), sum(x[4] > 3 for x in want)
    assert len(want) > 60 and chained and crowded


def test_search_over_small_alphabets():
    r = random.Random(5)
    for _ in range(60):
        words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 60))})
        index, halves = spelling.Index(words), np.array([len(w) // 2 for w in words])
        q, w = index.near([*words, "ax"], np.append(halves, 1))
        got = set(zip(q.tolist(), w.tolist(), strict=True))
        asked = [*words, "ax"]
        assert got == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if b[: len(a) // 2] == a[: len(a) // 2] and near(a[len(a) // 2 :], b[len(a) // 2 :])}


def test_variants_of_nothing(spark):
    assert spelling.variants(docs_of(spark, [])).collect() == []
    assert spelling.variants(docs_of(spark, [None, "", "one two"])).collect() == []
    assert result(spelling.variants(docs_of(spark, ["hello hello HELLO", "hellÀ"]))) == [("hello", None, "hello", 3, 0, None)]


# --- runs


def plain_runs(x, least=12):
    longest = {}
    for q in range(1, len(x)):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                longest.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in longest.items())


def plain_rows(rows):
    out = []
    for doc_id, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        n = len(words)
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = sorted(plain_runs(words), key=lambda x: (x[0], x[2]))
        dropped = {i for s, length, q in found for i in range(s + q, s + length)}
        top = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        out.append((doc_id, len(found), *top, found and 1000 * top[1] // top[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [periodic_runs.BATCH, 50])
def test_runs_of_documents(spark, monkeypatch, batch):
    monkeypatch.setattr(periodic_runs, "BATCH", batch)
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefghijklmnop"[: r.choice([1, 2, 3, 16])]) for _ in range(r.randint(0, 120))) for _ in range(150)] + [t for t in ODD if t != "z " * 5000]
    texts += ["u v w " * 20 + "x " + "w v " * 9, texts[3]]
    ids = [None if i % 50 == 9 else i for i in range(len(texts))]
    got = sorted((tuple(x) for x in periodic_runs.describe(docs_of(spark, texts, ids), periodic_runs.stretched).collect()), key=str)
    want = plain_rows(list(zip(ids, texts, strict=True)))
    assert got == want
    assert sum(x[1] > 0 for x in want) > 10


def test_every_run_of_small_alphabets():
    r = random.Random(7)
    for _ in range(1500):
        x = [r.randrange(r.choice([1, 2, 2, 3])) for _ in range(r.randint(0, 60))]
        if x and r.random() < 0.5:
            p, at = r.randint(1, 12), r.randrange(len(x))
            x = [x[i] if i < at else x[at + (i - at) % p] for i in range(len(x))] * r.choice([1, 3])
        least = r.choice([1, 2, 12])
        assert [tuple(map(int, row)) for row in zip(*periodic_runs.runs(np.array(x, np.int64), least), strict=True)] == plain_runs(x, least)


def test_runs_of_fibonacci_and_long_repeats():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    x = np.array([ord(c) for c in b])
    assert [tuple(map(int, row)) for row in zip(*periodic_runs.runs(x), strict=True)] == plain_runs(list(x))
    for q in (1, 7, 20_000):
        assert [c.tolist() for c in periodic_runs.runs(np.arange(100_000) % q)] == [[0], [100_000], [q]]


def test_runs_of_nothing(spark):
    assert periodic_runs.describe(docs_of(spark, [])).collect() == []
    row = periodic_runs.describe(docs_of(spark, ["z " * 5000])).collect()[0]
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 5000, 1, 5_000_000)
    assert row.collapsed_sha256 == hashlib.sha256(b"z").hexdigest()


def test_queries_are_registered():
    assert {"op11_spelling", "op13_periodic_runs"} <= set(queries.QUERIES)
