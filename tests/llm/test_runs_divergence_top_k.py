"""Periodic runs, source divergence and exact top-k against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import divergence, periodic, top_k, workload
from tideline.llm.divergence import source_divergence
from tideline.llm.periodic import collapse_runs, find_runs
from tideline.llm.top_k import top_k as search
from tideline.llm.workload import with_planted_runs


def plain_runs(words, least=24):
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 3 * q):
                part = words[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts_with_runs():
    rnd = random.Random(11)
    thue = [bin(i).count("1") % 2 for i in range(512)]
    fib = [0]
    while len(fib) < 400:
        fib = [y for x in fib for y in ((0, 1) if x == 0 else (0,))]
    out = [thue, thue * 3 + [2], fib, [0] * 23, [0] * 24, [0, 1] * 40 + [0], [5] * 30 + [6] * 30, [0] * 12 + [1] + [0] * 12]
    for q in (1, 2, 3, 7, 8, 15, 16, 17, 23, 24, 25, 32, 33, 48, 49, 64, 65, 90, 97, 128, 129, 150):
        for times in (2, 3, 4):
            for off in (-1, 0, 1):
                unit = [rnd.randrange(5 if q % 2 else 1000) for _ in range(q)]
                body = (unit * (times + 1))[: q * times + off]
                out.append([rnd.randrange(1000) for _ in range(rnd.randrange(30))] + body + [rnd.randrange(1000) for _ in range(rnd.randrange(30))])
    for _ in range(30):  # runs in runs
        unit = [rnd.randrange(3) for _ in range(rnd.randrange(2, 9))] * rnd.randrange(4, 9) + [rnd.randrange(9)]
        out.append(unit * 3 + unit[: rnd.randrange(len(unit))])
        out.append([rnd.randrange(2) for _ in range(300)])
    return [[f"w{x}" for x in words] for words in out]


def test_runs_like_brute_force(spark):
    docs = list(enumerate(texts_with_runs()))
    want = {i: plain_runs(w) for i, w in docs}
    assert sum(map(len, want.values())) > 150 and len({q for rs in want.values() for _, _, q in rs}) > 30
    rows = spark.createDataFrame([(i, " \n".join(w)) for i, w in docs], "doc_id long, text string")
    for r in collapse_runs(rows).collect():
        words = docs[r.doc_id][1]
        assert [tuple(x) for x in r.runs] == want[r.doc_id], r.doc_id
        gone = {i for s, n, q in want[r.doc_id] for i in range(s + q, s + n)}
        assert r.n_words == len(words) and r.text == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_with_colliding_names(monkeypatch):
    texts = [[hash(w) % 997 for w in words] for words in texts_with_runs()]
    monkeypatch.setattr(periodic, "mix", lambda x: x % np.uint64(3))
    for words in texts:
        assert find_runs(np.array(words), len(words), 24) == plain_runs(words)


def test_pieces_do_not_change_runs(spark, monkeypatch):
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts_with_runs())], "doc_id long, text string")
    whole = sorted(map(str, collapse_runs(rows).collect()))
    sizes = np.array([len(t) for t in texts_with_runs()])
    pieces = [periodic._piece([" ".join(w)], 24)[1][0] for w in texts_with_runs()]
    assert len(whole) == len(sizes) and [len(r.runs) for r in collapse_runs(rows).orderBy("doc_id").collect()] == list(map(len, pieces))


def test_planted_runs_and_digests(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " \t".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(0, 260)))) for i in range(120)]
    rows += [(None, "a b " * 40), (200, None), (201, ""), (202, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in workload.op11_periodic_runs(spark, str(tmp_path)).collect()}
    some = 0
    for i, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            some += 1
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert some >= 8 and with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def plain_divergence(rows, min_docs=3, top=200):
    import re

    docs, counts, groups = defaultdict(set), Counter(), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for term in re.findall(TERM, low):
            docs[lang, term].add(k)
            counts[lang, source, term] += 1
    kept = {g: sorted((t for (la, t), d in docs.items() if la == g and len(d) >= min_docs), key=str.encode) for g in {la for la, _ in groups}}
    total = {(la, s): sum(counts[la, s, t] for t in kept[la]) for la, s in groups}
    scale = 1_000_000_000
    out = []
    for la, s in groups:
        terms = kept[la]
        p = {x: {t: 1 + scale * (counts[la, x, t] + 1) // (total[la, x] + len(terms)) for t in terms} for lb, x in groups if lb == la}
        pairs = [(sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in terms), x) for x in p if x != s]
        out += [(la, s, "pair", x, v, k) for k, (v, x) in enumerate(sorted(pairs, key=lambda r: (-r[0], r[1].encode())), 1)]
        whole = sum(total[la, x] for x in p)
        q = {t: 1 + scale * (sum(counts[la, x, t] for x in p) + 1) // (whole + len(terms)) for t in terms}
        more = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in terms if counts[la, s, t] and p[s][t] > q[t]]
        out += [(la, s, "term", t, v, k) for k, (v, t) in enumerate(sorted(more, key=lambda r: (-r[0], r[1].encode()))[:top], 1)]
    return sorted(out)


def divergence_rows():
    rnd = random.Random(7)
    ends = ["", ",", ".", "!", "-x", "_2"]
    rows = []
    for _ in range(240):
        lang = rnd.choice(["en", "en", "en", "fr", None])
        words = [rnd.choice(["Alpha", "beta", f"t{rnd.randrange(60)}", f"T{rnd.randrange(900)}", "é", "ß😀", "x1y"]) + rnd.choice(ends) for _ in range(rnd.randrange(40))]
        rows.append((" \n".join(words), lang, rnd.choice(["a", "b", "c", None, "é"])))
    rows += [(None, "de", "a"), ("", "de", "b"), ("only here", "de", "b"), (None, None, None), ("word", "es", "single"), ("1 2 3", "it", "x"), ("!!", "it", "y")]
    return rows + [("Twice twice, TWICE", "pt", "s"), ("Twice twice, TWICE", "pt", "s"), ("twice!", "pt", "t")]


@pytest.mark.parametrize("small", (False, True))
def test_divergence_like_brute_force(spark, monkeypatch, small):
    rows = divergence_rows()
    if small:  # many blocks and tiles
        monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
        monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
        monkeypatch.setattr(divergence, "PIECE_BYTES", 300)
        monkeypatch.setattr(divergence, "HELD", 100)
        monkeypatch.setattr(divergence, "LEAST_BUCKETS", 9)
        monkeypatch.setattr(divergence, "FAN", 4)  # coarse buckets first
    docs = spark.createDataFrame([(k, *r, 1, "n") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, rank int, term string")
    for min_docs, top in ((3, 200), (2, 5), (1, 200)):
        got = [tuple(r) for r in source_divergence(docs.repartition(5), min_docs, top).collect()]
        assert sorted(got) == plain_divergence(rows, min_docs, top)


def plain_top(rows, k=5, scale=256):
    import math

    good = [(r, i, [math.floor(scale * x) for x in v]) for r, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, i, v in good:
        if i is not None and i % 50 == 0:
            near = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            scores = [(-near(sum(a * b for a, b in zip(v, w))), j is None, j or 0, j) for s, j, w in good if s != r]
            out += [(i, n, j, -score) for n, (score, _, _, j) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int, row int, score double"


def found(df, k=5):
    return sorted((tuple(r) for r in search(df, F.expr("vec_id % 50 = 0"), k).select("query_id", "rank", "id", "score").collect()), key=str)


@pytest.mark.parametrize("small", (False, True))
def test_top_k_like_brute_force(spark, monkeypatch, small):
    rnd = np.random.default_rng(5)
    if small:
        monkeypatch.setattr(top_k, "CELL_VECTORS", 20)
        monkeypatch.setattr(top_k, "PART_BYTES", 200)
        monkeypatch.setattr(top_k, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(top_k, "PRODUCTS", 64)
    centres = rnd.normal(size=(6, 4)) * 3
    rows = [(i, (centres[i % 6] * (1 + i % 3) + rnd.normal(size=4) * 0.05).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]  # one vector has a third of the rows, with ties
    rows += [(50, rows[50][1]), (None, [9.0, 9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0, 9.0]), (2000, None), (2050, [1.0, None, 0.0, 0.0])]
    rows += [(2100, [float("nan"), 0.0, 0.0, 0.0]), (2101, [float("inf"), 0.0, 0.0, 0.0]), (2150, []), (2151, [7.0]), (2200, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], VECTORS)
    assert found(df) == plain_top(df.select("vec_id", "embedding").collect())


def test_top_k_leaves_far_cells_out(spark, monkeypatch):
    monkeypatch.setattr(top_k, "CELL_VECTORS", 20)
    monkeypatch.setattr(top_k, "PART_BYTES", 64)
    rnd = np.random.default_rng(6)
    turn = np.arange(1500) % 12 * np.pi / 6
    rows = [(i, [float(np.cos(a) * 5 + e[0]), float(np.sin(a) * 5 + e[1])]) for i, (a, e) in enumerate(zip(turn, rnd.normal(size=(1500, 2)) * 0.02))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    low, high = [], []
    real = top_k.reach
    monkeypatch.setattr(top_k, "reach", lambda *a: (lambda b: low.append(b[0]) or high.append(b[1]) or b)(real(*a)))
    assert found(df) == plain_top(rows)
    assert (low[0] > 1e3).mean() > 0.2  # such cells send nothing


def test_top_k_of_large_numbers_and_few_rows(spark):
    rows = [(0, [1e20, -1e3]), (1, [1e9, 3.0]), (2, [-1e9, 5e8]), (50, [1e15, 1.0])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain_top(rows)
    huge = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e200, -1e300]), (2, [0.0, 1e300])], "vec_id long, embedding array<double>")
    assert [r[2] for r in found(huge)] == [1, 2]  # squares pass a double
    for rows in ([], [(0, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, None)]):
        assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == []


def test_empty_table_and_odd_rows(spark, odd):
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        assert collapse_runs(docs).count() == n
        assert (source_divergence(docs).count() > 0) == (n > 0)
    got = {r.doc_id: r for r in collapse_runs(odd).collect()}
    assert got[3].n_words == 0 and got[3].text == "" and got[5].text == "" and got[None].n_words == 5
    runs = [(1, "word " * 30_000 + "x" * 200_000 + " y" * 25)]
    one = collapse_runs(spark.createDataFrame(runs, "doc_id string, text string")).first()
    assert [tuple(r) for r in one.runs] == [(0, 30_000, 1), (30_001, 25, 1)] and one.doc_id == "1"
