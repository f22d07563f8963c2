"""Language-model scores against a plain model, the trie against its definition, and edge cases."""

import math
import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import lm_score, queries
from pagemill.llm.lm_score import EliasFano, Trie, keyed

DOC = "doc_id long, text string, lang string, chunk string, held_out string, words int, shard int"
ODD = [None, "", " \n", "one", "A a A", "x" * 5000, "日本語 テキスト", "a b a b", "the the the " * 300]


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "c", "h", 1, 2) for i, t in enumerate(texts)], DOC)


def prose(r, n):
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 4))) for _ in range(120)]
    out = []
    for _ in range(n):
        text = r.choices(words, [1 / (i + 1) for i in range(120)], k=r.randint(1, 80))
        out.append(" ".join(w.upper() if r.random() < 0.1 else w for w in text) + (" " + out[-1] if out and r.random() < 0.3 else ""))
    return out


def plain_scores(rows, fixed=None):
    docs = [(i, [b.decode() for b in (t or "").encode().lower().split()], i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]
    one, three = Counter(), Counter()
    for _, ws, held in docs:
        if not held:
            one.update([*ws, None])
            three.update(zip([0, 0, *ws], [0, *ws], [*ws, None], strict=False))
    n, v = sum(one.values()), len(one)
    two = Counter((b, c) for _, b, c in three)
    d3, d2 = ([0.0, *fixed],) * 2 if fixed else (lm_score.discounts(np.array(list(x.values()), np.int64)) if x else np.zeros(4) for x in (three, two))
    context, middle = defaultdict(list), defaultdict(list)
    for (a, b, _), k in three.items():
        context[a, b].append(k)
    for (b, _), k in two.items():
        middle[b].append(k)
    seen = set(one)

    def p1(w):
        return (one[w] + 0.5) / (n + 0.5 * (v + 1))

    def p2(b, w):
        if b not in middle:
            return p1(w)
        k = two[b, w]
        return (k - d2[min(k, 3)] + sum(d2[min(x, 3)] for x in middle[b]) * p1(w)) / sum(middle[b])

    def p3(a, b, w):
        if (a, b) not in context:
            return p2(b, w)
        k = three[a, b, w]
        return (k - d3[min(k, 3)] + sum(d3[min(x, 3)] for x in context[a, b]) * p2(b, w)) / sum(context[a, b])

    out = []
    for i, ws, held in docs:
        base = sum(math.log10(p1(w)) for w in [*ws, None])
        model = sum(math.log10(p3(a, b, w)) for a, b, w in zip([0, 0, *ws], [0, *ws], [*ws, None], strict=False))
        out.append((i, held, len(ws) + 1, sum(w in seen for w in [*ws, None]), n, base, model))
    return sorted(out, key=str)


def check(df, want):
    got = sorted((tuple(x) for x in df.collect()), key=lambda x: str((x[0], x[1], x[2], x[3], x[4])))
    want = sorted(want, key=lambda x: str((x[0], x[1], x[2], x[3], x[4])))
    by_key = defaultdict(list)
    for x in want:
        by_key[x[:5]].append(x[5:])
    for x in got:
        close = [y for y in by_key[x[:5]] if math.isclose(x[5], y[0], abs_tol=1e-6) and abs(x[6] - y[1]) < 0.0025 * x[2]]
        assert close, (x, by_key[x[:5]])
        by_key[x[:5]].remove(close[0])
    assert not any(by_key.values())


def test_scores(spark):
    texts = prose(random.Random(1), 200) + ODD * 2
    ids = [None if i % 50 == 9 else i - i % 60 // 59 for i in range(len(texts))]
    check(lm_score.score(docs_of(spark, texts, ids)), plain_scores(list(zip(ids, texts, strict=True))))


def test_scores_do_not_depend_on_chunks_and_shards(spark, monkeypatch):
    fixed = (0.6, 1.1, 1.4)
    monkeypatch.setattr(lm_score, "CHUNK", 700)
    monkeypatch.setattr(lm_score, "SHARD", 400)
    texts = prose(random.Random(2), 150) + ODD
    tries = tempfile.mkdtemp(prefix="tries-", dir="/tmp") + "/t"
    check(lm_score.score(docs_of(spark, texts).repartition(3), keep=tries, fixed=fixed), plain_scores(list(enumerate(texts)), fixed))
    assert spark.read.parquet(tries).count() > 3


def test_frequent_words_divide_by_the_word_before(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HOT", 50)
    monkeypatch.setattr(lm_score, "SHARD", 500)
    texts = prose(random.Random(3), 150)
    got, want = lm_score.score(docs_of(spark, texts)).collect(), {x[0]: x for x in plain_scores(list(enumerate(texts)))}
    assert all(math.isclose(x.base_score, want[x.doc_id][5], abs_tol=1e-6) and (x.n_tokens, x.n_known) == want[x.doc_id][2:4] for x in got)
    assert np.mean([abs(x.score - want[x.doc_id][6]) / x.n_tokens for x in got]) < 0.2


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    rows = [x for x in lm_score.score(docs_of(spark, prose(random.Random(4), 400))).collect() if x.held_out]
    assert sum(x.score for x in rows) > sum(x.base_score for x in rows)


def test_scores_of_nothing(spark):
    assert lm_score.score(docs_of(spark, [])).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm_score.score(docs_of(spark, ["a b"], [only])).collect()[0]
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 10**9), (1000, 1000), (5000, 10**6), (3000, 10**15)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n + top)
    x = np.sort(r.integers(0, top, n))
    e = EliasFano.of(x)
    assert (e[np.arange(n)] == x.astype(np.uint64)).all()
    asked = np.unique(np.concatenate([x, x + 1, r.integers(0, 2 * top, 500)]))
    got = e.find(asked)
    assert ((got >= 0) == np.isin(asked, x)).all()
    assert (x[got[got >= 0]] == asked[got >= 0]).all()


def test_a_mapped_trie_sums_to_one(tmp_path):
    r = np.random.default_rng(5)
    n, words = 4000, 40
    p = r.dirichlet(np.ones(words + 1))  # the last is the unknown word
    ids = lm_score.FIRST + np.arange(words)
    key = np.append(keyed(ids.astype(np.uint64), p[:-1]), keyed(np.array([lm_score.UNKNOWN], np.uint64), p[-1:]))
    v, u, w = (key[r.integers(0, 12, n)], key[r.integers(0, 20, n)], key[r.integers(0, words, n)])
    rows, c = np.unique(np.stack([v, u, w]), axis=1, return_counts=True)
    path = tmp_path / "trie"
    path.write_bytes(Trie.build(*rows, c))
    trie = Trie.open(str(path))
    for v, u in ((key[0], key[1]), (key[3], key[30]), (key[35], key[2]), (key[5], key[5])):
        q = trie.logp(np.full(words + 1, v), np.full(words + 1, u), key)
        assert math.isclose((10.0 ** (-q / lm_score.STEP)).sum(), 1, abs_tol=0.005)


def test_packed_trigrams():
    r = np.random.default_rng(6)
    for n in (1, 500):
        rows = np.unique(r.integers(0, 1 << 50, (3, n)).astype(np.uint64) % np.array([[5], [9], [1 << 50]], np.uint64), axis=1)
        c = r.integers(0, 9, rows.shape[1])
        got = lm_score._unpack_trigrams(lm_score._pack_trigrams(*rows, c))
        assert all((a == b).all() for a, b in zip(got, (*rows, c), strict=True))


def test_the_query_is_registered():
    assert "op12_lm_score" in queries.QUERIES
