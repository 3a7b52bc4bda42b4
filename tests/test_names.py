"""Name matching against scoring all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from gridspark.operators import names as M


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(names, candidates, measure):
    out = []
    for a in sorted(set(names)):
        scored = []
        for b in set(candidates):
            x, y = set(a.split(" ")), set(b.split(" "))
            letters = 1 - distance(a, b) / max(len(a), len(b), 1) if measure == "edit" else SequenceMatcher(None, a, b).ratio()
            scored.append((-round(0.65 * letters + 0.35 * len(x & y) / len(x | y), 9), b))
        score, b = min(scored)
        out.append((a, b, round(-score, 6)))
    return out


def text(rng, words):
    out = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    if rng.random() < 0.4:
        at = rng.randrange(len(out))
        out = out[:at] + rng.choice("abcdexyz") + out[at + rng.randrange(2) :]
    return out


@pytest.mark.parametrize("measure", ["edit", "sequence"])
@pytest.mark.parametrize("letters", ["abc", "abcdefghijklmnop"])
def test_indexes_find_what_all_pairs_find(spark, measure, letters, monkeypatch):
    monkeypatch.setattr(M, "SEEDS", (2, 3, 1))
    monkeypatch.setattr(M, "BLOCK", (16, 32))
    rng = random.Random(len(letters))
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(40)]
    names = [text(rng, words) for _ in range(120)] + ["", "zzz", "ÿÿ ÿ"]
    candidates = [text(rng, words) for _ in range(150)] + ["seed " + w for w in words]
    a, b = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in [*candidates, None]], "candidate string")
    got = M.fuzzy_best_match(a, b, measure=measure, chunk=0)
    want = brute(names, candidates, measure)
    assert sorted((r.name, r.candidate, r.score) for r in got.collect()) == want
    if measure == "edit":
        assert sorted((r.name, r.candidate, r.score) for r in M.fuzzy_best_match(a, b).collect()) == want


def test_prefers_the_same_words(spark):
    names = spark.createDataFrame([("maize corn",), ("qqq",), (None,), ("qqq",)], "name string")
    options = spark.createDataFrame([("corn maize",), ("wheat",), (None,)], "candidate string")
    for measure in ("edit", "sequence"):
        got = {r.name: r for r in M.fuzzy_best_match(names, options, measure=measure).collect()}
        assert got["maize corn"].candidate == "corn maize" and got["qqq"].needs_manual_check and len(got) == 3
        assert got[None].candidate is None and got[None].score is None


def test_without_candidates_nothing_matches(spark):
    names = spark.createDataFrame([("a",)], "name string")
    got = M.fuzzy_best_match(names, spark.createDataFrame([], "candidate string"), chunk=0).collect()
    assert [(r.name, r.candidate) for r in got] == [("a", None)]


def test_few_pairs_are_scored(spark, monkeypatch):
    """Names with one letter changed meet few of a thousand candidates."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(800)]
    candidates = sorted({" ".join(rng.sample(words, 2)) for _ in range(1000)})
    names = [c[:3] + "q" + c[4:] for c in candidates[::4]]
    scored = []
    best = M._best
    monkeypatch.setattr(M, "_best", lambda df: scored.append(df.count()) or best(df))
    got = M.fuzzy_best_match(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in candidates], "candidate string"), chunk=0)
    assert {(r.name, r.candidate) for r in got.collect()} == set(zip(names, candidates[::4], strict=True))
    assert sum(scored) < 0.05 * len(names) * len(candidates)
