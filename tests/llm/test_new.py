"""Near vectors, periodic runs and spelling variants against brute force, and their defined cases."""

import random
import re
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from gridspark.llm import multiindex, periodic, variants
from gridspark.llm.common import components, least_reached, spread_lookup

VECTORS = "vec_id long, embedding array<float>, label int, node string, cell long, n double, home string, unit string"
HASH_OF_NOTHING = sha256(b"").hexdigest()


def brute_links(rows, threshold=0.93):
    """n_links and component by row number."""
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    live = [i for i, (vec_id, v, label) in enumerate(rows) if vec_id is not None and label is not None and usable(v)]
    links = {i: set() for i in range(len(rows))}
    for i in live:
        for j in live:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, left = {i}, [i]
        while left:
            new = links[left.pop()] - seen
            seen |= new
            left += new
        out.append((rows[i][0], len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def found_links(spark, rows, **parameters):
    df = spark.createDataFrame([(*r, "x", 1, 0.5, "h", "u") for r in rows], VECTORS)
    got = multiindex.near_vectors(df, **parameters).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def families(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dims)
        if i % 3 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.2, 0.3])
        rows.append((i * 7 % 1009, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    return rows


def test_near_vectors_finds_the_links_of_brute_force(spark):
    rows = families(1, 400)
    assert found_links(spark, rows) == brute_links(rows)
    assert found_links(spark, rows, cell=4, share=1) == brute_links(rows)
    strict = dict((r[0], r) for r in brute_links(rows))
    loose = found_links(spark, rows, cell=4)
    assert sum(r[1] for r in loose) >= 0.99 * sum(r[1] for r in strict.values())


def test_near_vectors_defines_every_case(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e30, 1e29], 1), (13, [-1.0, 0.0], 1),
        (14, [1e-30, 1e-31], 1), (15, [0.0], 1), (16, [3.0], 1), (17, [5.0], 1), (None, None, None),
    ]
    assert found_links(spark, rows) == brute_links(rows)
    assert multiindex.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_a_large_family_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, [float(x) for x in base], 1) for i in range(3000)]
    rows += [(3000 + i, [float(x) for x in base + 0.01 * rng.normal(size=8)], 1) for i in range(1500)]
    got = found_links(spark, rows)
    assert {r[1:] for r in got} == {(4499, 0)}


def test_visits_hold_the_stated_share():
    rng = np.random.default_rng(2)
    x = multiindex.unit_rows(rng.normal(size=(6000, 32)))
    book = tuple(multiindex.learn_codebook(h, 12) for h in multiindex._halves(x[:3000]))
    way = rng.normal(size=x.shape)
    way = multiindex.unit_rows(way - (way * x).sum(axis=1)[:, None] * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * way
    home, _, _ = multiindex.visited_cells(y, book, 0.0)
    shares = []
    for share in (0.9, 0.999, 1):
        _, rows, cells = multiindex.visited_cells(x, book, multiindex.learn_radius(x[:3000], book, 0.93, share))
        shares.append((len(np.unique(rows[cells == home[rows]])) / len(x), len(rows)))
    assert shares[0][0] >= 0.85 and shares[1][0] >= 0.995 and shares[2][0] == 1
    assert shares[0][1] < 0.5 * shares[2][1]


def test_spanning_links_join_what_links_join():
    rng = np.random.default_rng(0)
    for _ in range(30):
        linked = rng.random((20, 15)) < 0.06
        label = list(range(35))
        for some in (np.argwhere(linked).tolist(), multiindex.spanning_links(linked)):
            own = list(range(35))
            for i, j in list(some) * 35:
                own[i] = own[20 + j] = min(own[i], own[20 + j])
            label, last = own, label
        assert label == last


@pytest.mark.parametrize("local", [7, 10**6])
def test_components_of_a_chain_and_a_star(spark, local):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(300)] + [(500, 499), (499, 500), (7, 7), (600, 600)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), local_links=local).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(301)} | {499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_reached_is_the_component():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 400):
        a, b = rng.integers(0, 300, n), rng.integers(0, 300, n)
        label = {x: x for x in np.concatenate([a, b]).tolist()}
        for _ in label:
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                label[i] = label[j] = min(label[i], label[j])
        nodes, least = least_reached(a, b)
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == label


def test_spread_lookup_is_a_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1), (3, 2), (None, 3)], "k long, x long")
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k long, y string")
    got = sorted(map(tuple, spread_lookup(rows, "k", facts, rows_a_part=50).select("k", "x", "y").collect()))
    assert got == sorted(map(tuple, rows.join(facts, "k").select("k", "x", "y").collect()))


def brute_runs(w, least=24, exponent=3):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n = rng.choice([0, 1, 5, 23, 24, 30, 60, 100, 200])
    w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 3:
            start, stop = rng.randrange(n), rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - start) // 2))
            for i in range(start, stop):
                w[i] = w[start + (i - start) % p]
    return w


@pytest.mark.parametrize("least, exponent", [(24, 3), (6, 3), (1, 3), (10, 4)])
def test_runs_are_those_of_brute_force(least, exponent):
    rng = random.Random(least)
    docs = [periodic_words(rng) for _ in range(400)]
    got = periodic.periodic_runs([np.array(d, dtype=np.int64) for d in docs], least, exponent)
    assert got == [brute_runs(d, least, exponent) for d in docs]
    assert sum(map(len, got)) > 10


def brute_periodic_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
    digest = [sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), " ".join(kept))]
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *digest)


def test_find_runs_agrees_with_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([" ", "\n", "\t \r"]).join(f"w{x}" for x in periodic_words(rng))) for i in range(300)]
    rows += [(None, "a " * 40), (None, None), (301, None), (302, ""), (303, "x y\x1cz\x85 " * 30), (303, "x y\x1cz\x85 " * 30), (304, "é\x0b\x0c" * 50)]
    df = spark.createDataFrame([(*r, "r", 1) for r in rows], "doc_id long, text string, start string, length long")
    got = sorted(map(tuple, periodic.find_runs(df, plant=True).collect()), key=str)
    assert got == sorted((brute_periodic_row(*r) for r in rows), key=str)
    assert periodic.find_runs(df.limit(0)).collect() == []


def test_find_runs_takes_nulls_and_long_texts(edge, nothing):
    rows = [r for r in periodic.find_runs(edge).collect() if r.n_runs]
    assert [(r.doc_id, r.n_runs, r.start, r.length, r.period) for r in rows] == [(5, 2, 0, 32000, 8)]
    assert periodic.find_runs(edge).count() == edge.count() and periodic.find_runs(nothing).count() == 0
    assert {r.collapsed_sha256 for r in periodic.find_runs(edge).collect() if r.doc_id in (2, 3, 9)} == {HASH_OF_NOTHING}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, drop=None, least=7, occurrences=2, factor=10):
    n = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if drop and (h := crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())) % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= occurrences}
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {w: next((x for x in sorted(near[w], key=lambda x: (-n[x], x))[:1] if n[x] >= factor * n[w]), None) for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def sorted_rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_agree_with_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcÀéÿß") for _ in range(rng.randrange(6, 10))) for _ in range(40)]
    words += [w[:i] + rng.choice(["", "b", "ab", "X"]) + w[i + 1 :] for w in words for i in (0, 3, len(w) - 1)]
    counts = [rng.choice([1, 2, 3, 25, 300]) for _ in words] + [2, 25, 300]
    words += ["abcdefgh", "abcdefgz", "abcdefyz"]
    docs = [(i % 50, w.upper() if i % 3 == 0 else w) for i, (w, c) in enumerate(zip(words, counts, strict=True)) for _ in range(c)]
    docs = [(d, f"{w}, {w}× und-{w}÷x") for d, w in docs] + [(None, None), (7, ""), (None, "anderswo anderswo"), (9, "a" * 300 + " " + "a" * 300 + " " + "a" * 299 + "b " + "a" * 299 + "b")]
    df = spark.createDataFrame([(*r, "r", "f") for r in docs], "doc_id long, text string, root string, form string")
    for drop in (None, 3):
        assert sorted_rows(variants.spelling_variants(df, drop=drop)) == brute_variants(docs, drop)
    assert any(r[1] and r[2] != r[1] for r in brute_variants(docs)) and sum(r[4] for r in brute_variants(docs)) > 50


def test_variants_of_the_given_documents(spark, sf, docs):
    assert sorted_rows(variants.spelling_variants(docs, drop=31)) == brute_variants([(r.doc_id, r.text) for r in docs.collect()], 31)


def test_near_words_share_a_signature():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 12)))
        at = rng.randrange(len(a) + 1)
        b = rng.choice([a[:at] + "x" + a[at:], a[: max(0, at - 1)] + rng.choice("abx") + a[at:] if at else a + "a"])
        a, b = sorted((a, b), key=len)
        own, longer = variants.signatures([a, b])
        theirs = own[1] if len(a) == len(b) else longer[1]
        assert set(own[0].tolist()) & set(theirs.tolist()), (a, b)


def test_variants_take_nulls_and_empty_tables(edge, nothing):
    assert variants.spelling_variants(nothing).collect() == []
    assert sorted_rows(variants.spelling_variants(edge, least=4)) == brute_variants([(r.doc_id, r.text) for r in edge.collect()], least=4)
