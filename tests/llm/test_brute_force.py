"""Operators against plain Python on small fixtures with many near copies."""

import random

from tideline.llm.lines import SHINGLE, line_report
from tideline.llm.ngram_join import near_duplicates, tree_links


def _components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _links(sets, percent):
    return [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]


def _texts(seed, n, cut):
    rnd = random.Random(seed)
    bases = [[f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(3, 90))] for _ in range(12)]
    line = [f"common{i}" for i in range(14)]
    out = []
    for _ in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, cut)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(4000)}"
        out.append(" ".join(words + line * rnd.randrange(2)))
    return out


def test_join_links_like_brute_force(spark, monkeypatch):
    from tideline.llm import ngram_join

    texts = _texts(1, 300, 5)
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (t.split() for t in texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (90, 80):
        want = _components(len(texts), _links(sets, percent))
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, percent).collect()}
        assert [got[i] for i in range(len(texts))] == want
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 1 << 12)  # groups in many chunks
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 90).collect()}
    assert [got[i] for i in range(len(texts))] == _components(len(texts), _links(sets, 90))


def test_tree_gives_all_components():
    import numpy as np

    rnd = random.Random(3)
    steps = np.zeros(1 << 20, np.uint8)
    for _ in range(30):
        base = [rnd.randrange(1 << 64) for _ in range(40)]
        sets = [set(rnd.sample(base, rnd.randrange(20, 41))) | {rnd.randrange(1 << 64) for _ in range(rnd.randrange(3))} for _ in range(40)]
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        assert _components(40, tree_links(arrays, 80, steps)) == _components(40, _links(sets, 80))


def test_lines_like_brute_force(spark):
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    bases = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(4, 160))).strip() or "x" for _ in range(40)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            line = list(rnd.choice(bases))
            if rnd.random() < 0.5:
                line[rnd.randrange(len(line))] = rnd.choice("XYZ")
            lines.append("".join(line))
        docs.append((i, "\n".join(lines)))
    places = [(d, p, line) for d, t in docs for p, line in enumerate(t.split("\n")) if line.strip()]
    lines = list(dict.fromkeys(line for _, _, line in places))
    sets = [{line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))} for line in lines]
    part = dict(zip(lines, _components(len(lines), _links(sets, 80)), strict=True))
    first = {}
    for d, p, line in places:
        first.setdefault(part[line], (d, p))
    got = {r.doc_id: r.text for r in line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        want = [x for p, x in enumerate(t.split("\n")) if not x.strip() or first[part[x]] == (d, p)]
        assert got[d] == "\n".join(want)


def test_lines_of_a_large_band_that_one_line_joins(spark):
    rnd = random.Random(8)
    hub = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(87))
    # each changes 8 of the 80 shingles: similar to the hub, not to each other
    variants = [hub[:p] + "#" + hub[p + 1 :] for p in range(8, 79)]
    docs = list(enumerate([*variants[:40], hub, *variants[40:], "a line that resembles no other one"]))
    got = {r.doc_id: r.text for r in line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i for i, t in got.items() if t} == {0, len(docs) - 1}


def test_short_lines_meet(spark):
    rnd = random.Random(9)
    bases = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(400)]
    # 5 of 6 shingles shared
    docs = list(enumerate(x for b in bases for x in (b, b + "#")))
    got = {r.doc_id: r.text for r in line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(not got[i] for i in range(1, 800, 2)) >= 399 and all(got[i] for i in range(0, 800, 2))
