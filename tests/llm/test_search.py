"""Near duplicates, decontamination and nearest neighbours against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from gridspark.llm import common, curvesearch, dartminhash, decontaminate
from gridspark.llm.common import words


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(rows))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_classes_equal_brute_force(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in dartminhash.near_duplicates(docs).collect()}
    assert same_partition(brute_classes(rows), [got[i].class_id for i, _ in rows])
    assert all(g.kept == (g.class_id == i) for i, g in got.items())
    sizes = Counter(g.class_id for g in got.values())
    assert all(g.class_size == sizes[g.class_id] for g in got.values())


def variants(seed, n, edits, length=120):
    """Texts that differ from one another by a few words."""
    r = np.random.default_rng(seed)
    base = [f"w{x}" for x in r.integers(0, 10**6, length)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in r.integers(0, length, edits):
            own[at] = f"v{r.integers(0, 10**9)}"
        out.append(" ".join(own))
    return out


def test_large_groups_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(dartminhash, "BUCKET", 8)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = variants(1, 60, 1) + ["the same text again and again and again"] * 50 + [f"{shared} {' '.join(variants(s, 1, 0, 30))}" for s in range(100, 140)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert same_partition(brute_classes(rows), [got[i] for i in range(len(rows))])


def edited(base, places, tag):
    """``base`` with other words at ``places``; equal tags put equal words in equal places."""
    own = list(base)
    for at in places:
        own[at] = f"{tag}x{at}"
    return own


def agrees_with_brute_force(spark, texts):
    rows = list(enumerate(" ".join(t) for t in texts))
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_classes(rows)
    assert 1 < len(set(want)) < len(rows)
    return same_partition(want, [got[i] for i in range(len(rows))])


def test_links_hidden_among_pairs_just_below_the_threshold(spark):
    r = np.random.default_rng(9)
    base = [f"w{x}" for x in range(1000)]
    texts = [edited(base, 6 * r.choice(160, 13, replace=False) + 5, f"s{n}") for n in range(120)]
    for n in range(15):  # pairs that share five of their fourteen edits
        shared = edited(base, 6 * r.choice(80, 5, replace=False) + 5, f"p{n}")
        texts += [edited(shared, 6 * (80 + r.choice(80, 9, replace=False)) + 5, f"q{n}{x}") for x in "ab"]
    assert agrees_with_brute_force(spark, texts)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_prefix_pairs_hold_all_links_between_labels(spark):
    r = np.random.default_rng(3)
    sets = [set(r.choice(60, r.integers(1, 40), replace=False).tolist()) for _ in range(60)]
    sets += [set(list(s)[: len(s) - int(r.integers(0, 4))]) | set(range(100 + i, 100 + i + int(r.integers(0, 3)))) for i, s in enumerate(sets)]
    sets = [s or {1} for s in sets]
    rows = [(i, int(i % 7 == 0), i % 5 != 0, sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, label long, away boolean, elements array<long>")
    for threshold in (0.5, 0.8, 1.0):
        got = {(x.a, x.b) for x in dartminhash.prefix_pairs(df, threshold).collect()}
        open_pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and (a[2] or b[2])}
        want = {(a, b) for a, b in open_pairs if jaccard(sets[a], sets[b]) >= threshold - 1e-9}
        assert want <= got <= open_pairs and want


def test_pairs_grow_in_proportion_to_a_family(spark, monkeypatch):
    """Members that lie just outside their family's class don't meet all of it."""
    found, made = [], dartminhash.prefix_pairs
    monkeypatch.setattr(dartminhash, "prefix_pairs", lambda *a: found.append(made(*a).cache()) or found[-1])
    for n in (150, 600):
        texts = variants(4, n, 1) + variants(4, n // 3, 6)
        rows = list(enumerate(texts))
        got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert same_partition(brute_classes(rows), [got[i] for i in range(len(rows))])
    small, large = (x.count() for x in found)
    assert large <= 6 * max(small, 100)


def test_bucket_links_connect_what_all_pairs_connect():
    r = np.random.default_rng(5)
    base = r.integers(0, 256, (6, 125), dtype=np.uint8)
    members = np.repeat(base, 10, axis=0)
    noise = r.random(members.shape) < r.choice([0.02, 0.15, 0.3], len(members))[:, None]
    members = np.where(noise, r.integers(0, 256, members.shape), members).astype(np.uint8)

    def parts(links):
        label = list(range(len(members)))
        for _ in range(len(members)):
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
        return label

    share = (members[:, None] == members[None]).mean(axis=2)
    every = [(i, j) for i in range(len(members)) for j in range(i) if share[i, j] >= dartminhash.CANDIDATE]
    links = dartminhash.bucket_links(members)
    assert parts(links) == parts(every) and len(links) < len(every)


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_the_weighted_similarity(weighted):
    r = np.random.default_rng(6)
    k, sets, want = 2000, [], []
    pool = dartminhash.mix(np.arange(1, 400, dtype=np.uint64))
    for _ in range(6):
        take = r.random(len(pool)) < 0.8
        w = np.exp(r.normal(0, 1.5, len(pool))) if weighted else np.ones(len(pool))
        sets.append({int(e): float(x) for e, x in zip(pool[take], w[take])})
    e = np.concatenate([np.array(list(s), dtype=np.uint64) for s in sets])
    sig = dartminhash.signatures(e, np.concatenate([list(s.values()) for s in sets]), np.repeat(np.arange(6), [len(s) for s in sets]), 6, k)
    for i in range(6):
        for j in range(i):
            keys = set(sets[i]) | set(sets[j])
            low = sum(min(sets[i].get(x, 0), sets[j].get(x, 0)) for x in keys)
            high = sum(max(sets[i].get(x, 0), sets[j].get(x, 0)) for x in keys)
            want.append(((sig[i] == sig[j]).mean(), low / high))
    assert all(abs(a - b) < 5 * math.sqrt(b * (1 - b) / k) + 0.005 for a, b in want)


def test_weighted_classes_count_repeats(spark):
    once = " ".join(f"a{i}" for i in range(40))
    rows = [(1, once), (2, once + " " + " ".join(f"b{i}" for i in range(3))), (3, " ".join([once] * 6)), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(df).collect()}
    heavy = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(df, weighted=True).collect()}
    assert plain[1] == plain[2] == plain[3] and heavy[1] == heavy[2] == 1 and heavy[3] == 3 and heavy[4] == 4


def test_edge_rows_of_near_duplicates(edge, nothing):
    got = dartminhash.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    label = {g.doc_id: g.class_id for g in got if g.doc_id is not None}
    assert label[6] == label[8] == 6 and label[7] == label[13] == 7 and label[14] == label[15] == 14 and label[2] == 2 and label[9] == 9 and label[3] == 3
    assert dartminhash.near_duplicates(nothing).count() == 0
    kept = dartminhash.keep_one(edge)
    assert kept.columns == edge.columns
    # one of each class; the two repeats of id 6 and id 8 leave one row
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 14]
    assert kept.filter("doc_id is null").count() == 2
    assert dartminhash.keep_one(nothing).count() == 0


def test_components(spark):
    r = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == label[n] for n in got) and {n for a, b in edges if a != b for n in (a, b)} == set(got)


# --- decontamination ------------------------------------------------------------------------


def brute_scores(items, text, size):
    """(item, passage, score): the BM25 share of every item in every passage, by definition."""
    own = {i: Counter(decontaminate.terms(words(t))) for i, t in items if words(t)}
    df = Counter(t for c in own.values() for t in c)
    n, mean = len(items), np.mean([sum(c.values()) for c in own.values()])
    ws = words(text)
    out = {}
    for a, z in decontaminate.passages(len(ws), size):
        held = {tuple(ws[i : i + k]) for k in (1, 2, 3) for i in range(a, z - k + 1)}
        for i, c in own.items():
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x * 2.2 / (x + norm) for t, x in c.items()}
            out[i, a] = sum(x for t, x in w.items() if t in held) / sum(w.values())
    return out


def test_wand_finds_all_above_the_threshold(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "the of"), (901, "alone"), (902, "Is this it? Answer: yes it is the one")]
    index = item_index(items)
    r = np.random.default_rng(1)
    base = [w for _, t in items for w in words(t)]
    mixed = [" ".join(r.choice(base, 300)) for _ in range(5)]
    mixed += [" ".join(words(items[k][1])[: int(len(words(items[k][1])) * f)]) + " tail words here" for k in range(12) for f in (0.3, 0.5, 0.7, 1.0)]
    mixed += ["alone", "the of", "Is this it yes it is the one"] + [x.text for x in docs.limit(60).collect()]
    for text in mixed:
        for threshold in (0.2, 0.5):
            want = {}
            for (i, a), s in brute_scores(items, text, max(256, 2 * index.longest)).items():
                if s >= threshold - 1e-9 and s > want.get(i, (0, 0))[0] + 1e-12:
                    want[i] = (s, a)
            got = {h[0]: (h[2], h[1]) for h in decontaminate.search_text(index, text, threshold, 0.7, 0.6)}
            assert got.keys() == want.keys()
            assert all(abs(got[i][0] - want[i][0]) < 1e-9 for i in got)


def test_block_bounds_skip_and_keep(spark):
    r = np.random.default_rng(2)
    items = [(i, " ".join(f"t{x}" for x in r.integers(0, 4, 12))) for i in range(400)]
    index = item_index(items)
    assert max(len(b) for b in index.block_tops) > 3
    for text in [t for _, t in items[:20]]:
        want = {i for (i, _), s in brute_scores(items, text, 256).items() if s >= 0.6 - 1e-9}
        assert {h[0] for h in decontaminate.search_text(index, text, 0.6, 0.7, 0.6)} == want


def item_index(items):
    lengths = [len(words(t)) for _, t in items]
    return decontaminate._index(None, items, None, len(items), sum(max(1, n - 2) for n in lengths) / len(items), max(lengths))


def test_leaks_do_not_depend_on_shards(spark):
    """Items of unlike length, null and repeated ids: any number of shards gives the rows of one index."""
    r = np.random.default_rng(12)
    texts = [" ".join(f"t{x}" for x in r.integers(0, 30, n)) for n in [5, 8, 12, 200, 20, 30, 9, 14, 60, 25] * 3]
    items = spark.createDataFrame([*enumerate(texts), (None, texts[1]), (-1, texts[2]), (3, texts[3]), (40, None), (41, "..")], "item_id long, text string")
    docs = [(i, f"{' '.join(f'z{x}' for x in r.integers(0, 99, 300))} {t} {' '.join(w for w in t.split() if r.random() < 0.8)}") for i, t in enumerate(texts)]
    table = spark.createDataFrame([*docs, (None, texts[0]), (7, None)], "doc_id long, text string")
    rows = lambda n: sorted(map(str, decontaminate.find_leaks(table, items, shard_items=n).collect()))
    one = rows(20_000)
    assert rows(5) == one and rows(1) == one and len(one) > 30 and any("item_id=None" in x for x in one) and any("doc_id=None" in x for x in one)
    assert decontaminate.find_leaks(table, items.limit(0)).count() == 0 and decontaminate.find_leaks(table.limit(0), items).count() == 0


def test_leaks_are_those_that_hold_an_item(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = {r.item_id: " ".join(words(r.text)) for r in items.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in plain.items() if f" {t} " in f" {' '.join(words(d.text))} "}
    for shard in (20_000, 7):
        got = decontaminate.find_leaks(docs, items, shard_items=shard).filter("contaminated").collect()
        assert {(g.doc_id, g.item_id) for g in got} == want and want
    left = {r.doc_id for r in decontaminate.clean(docs, items).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {i for i, _ in want}


def test_a_better_passage_without_the_answer_hides_none(spark):
    question = [f"q{i}" for i in range(40)]
    items = [(1, f"{' '.join(question)} Answer: " + " ".join(f"a{i}" for i in range(10)))]
    index = item_index(items)
    edited = [w if i % 10 != 9 else "x" for i, w in enumerate(question)]
    gap = " ".join(f"f{i}" for i in range(600))
    leak = f"{' '.join(edited)} answer {' '.join(f'a{i}' for i in range(10))}"
    alone = decontaminate.search_text(index, f"{gap} {leak}", 0.5, 0.7, 0.6)
    decoy = decontaminate.search_text(index, " ".join(question), 0.5, 0.7, 0.6)
    assert alone[0][5] and not decoy[0][5] and decoy[0][2] > alone[0][2]
    for text in (f"{' '.join(question)} {gap} {leak}", f"{leak} {gap} {' '.join(question)}"):
        hit = decontaminate.search_text(index, text, 0.5, 0.7, 0.6)
        assert len(hit) == 1 and hit[0][5] and abs(hit[0][2] - alone[0][2]) < 1e-9


def test_answers_and_coverage():
    assert decontaminate.question_answer("What is it? It is a red fox.") == (["what", "is", "it"], ["it", "is", "a", "red", "fox"])
    assert decontaminate.question_answer("Q Answer: b c") == (["q"], ["b", "c"])
    assert decontaminate.question_answer("one two") == ([], ["one", "two"])
    assert decontaminate.covered(["a", "b", "c"], ["x", "a", "c", "b"]) == pytest.approx(2 / 3)
    assert decontaminate.covered([], ["x"]) == 1.0


def test_edge_rows_of_decontamination(spark, edge, nothing):
    items = spark.createDataFrame([(1, "Le chat est sur la table et il dort", "x"), (2, None, "x"), (3, "", "x"), (None, "one two", "x"), (1, "Le chat est sur la table et il dort", "x")], "item_id long, text string, score string")
    got = decontaminate.find_leaks(edge, items).filter("contaminated").collect()
    assert {(g.doc_id, g.item_id) for g in got} == {(7, 1), (13, 1), (14, -1), (15, -1)}
    assert decontaminate.find_leaks(nothing, items).count() == 0 and decontaminate.find_leaks(edge, items.limit(0)).count() == 0
    kept = decontaminate.clean(edge, items)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 4
    assert decontaminate.clean(edge, items.limit(0)).count() == edge.count()


# --- nearest neighbours ---------------------------------------------------------------------


def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            scored = sorted(((-float(q @ v), j) for j, v in ok if j != i))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    rows = [(i, [float(x) for x in (centres[i % 12] + 0.4 * r.normal(size=16)) * r.uniform(0.5, 2)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows, 20, 20)
    got = {}
    for x in curvesearch.search(df, 20).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 21)) for g in got.values())
    recall = np.mean([len({v for v, _ in g.values()} & {j for j, _ in want[q]}) / 20 for q, g in got.items()])
    assert recall >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    assert all(abs(s - vectors[q] @ vectors[v]) < 1e-9 for q, g in got.items() for v, s in g.values())


def test_ties_copies_and_bad_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, None), (120, [0.0, 0.0]), (140, [1.0, nan]), (160, [None, 1.0]), (180, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(200 + i, [0.5, float(i)]) for i in range(5)]
    df = spark.createDataFrame([(*x, "e") for x in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for x in curvesearch.search(df, 20).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got == brute_nearest(rows, 20, 20)
    assert curvesearch.search(df.limit(0), 20).count() == 0
    few = curvesearch.search(df.filter("vec_id >= 200"), 20).collect()
    assert sorted(x.vec_id for x in few) == [201, 202, 203, 204]


def test_no_vector_is_named_twice(spark):
    up = float(np.nextafter(0.5, 1))
    scored = spark.createDataFrame([(1, 7, 0.5), (1, 7, up), (1, 8, 0.4), (1, 9, 0.3), (2, 7, up)], "query long, vid long, score double")
    assert sorted((x.query, x.vid) for x in curvesearch._top(scored, 1).collect()) == [(1, 7), (1, 8), (2, 7)]
    r = np.random.default_rng(11)
    q, c = r.normal(size=(33, 64)).astype(np.float32).astype(float), r.normal(size=(500, 64)).astype(np.float32).astype(float)
    i, j = (x.reshape(-1) for x in np.indices((33, 500)))
    whole = curvesearch.pair_scores(q, c, i, j).reshape(33, 500)
    assert all((curvesearch.pair_scores(q[a:], c[b:], np.array([32 - a]), np.array([499 - b])) == whole[32, 499]).all() for a, b in ((0, 0), (7, 3), (32, 499)))
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(r.normal(size=(2501, 64)).astype(np.float32))]
    named = Counter((x.query_id, x.vec_id) for x in curvesearch.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).collect())
    assert len(named) == 20 * 126 and max(named.values()) == 1


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert_neighbours_touch(dims, bits):
    side = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = curvesearch.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(side**dims))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_word_pattern():
    assert words("Don't STOP_it é²") == re.findall(r"\w+", "don't stop_it é²")
