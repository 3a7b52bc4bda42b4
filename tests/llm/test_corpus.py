"""Archives, shards, language ID, licences and the pipeline."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import langid, licenses, sharding, warc
from gridspark.llm.common import numbered, shared_folder

# --- archives -------------------------------------------------------------------------------


def brute_records(rows, least=1000):
    """(page_id, bytes, digest, type, refers to) by the contract; ``rows`` have distinct ids."""
    out, largest = [], {}
    for i, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            largest[body] = max(largest.get(body, i), i)
    for i, html in rows:
        body = (html or "").encode()
        first = largest.get(body, i)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out)


def test_archives_equal_the_contract(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    big = max(rows, key=lambda r: len(r[1]))[1]
    rows += [(10_000 + i, big) for i in range(5)] + [(20_000 + i, "short") for i in range(3)] + [(30_000, None), (30_001, ""), (30_002, "é" * 500), (30_003, "é" * 500), (30_004, "x" * 999), (30_005, "x" * 999), (30_006, "y" * 300_000)]
    df = spark.createDataFrame([(i, None, h, "p") for i, h in rows], "page_id long, url string, html string, problem string")
    for segment in (1000, 16384):
        got = warc.archive_pages(df, segment_bytes=segment).collect()
        assert sorted((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got) == brute_records(rows)
        assert all(g.problem is None for g in got)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_repeated_pages_and_missing_ids(spark):
    body = "z" * 2000
    df = spark.createDataFrame([(1, "u\r\nX: 1", body), (1, "u", body), (None, "u", body), (None, None, None)], "page_id long, url string, html string")
    got = warc.archive_pages(df).collect()
    assert Counter((g.page_id, g.record_type, g.refers_to, g.payload_bytes) for g in got) == Counter({(1, "response", None, 2000): 1, (1, "revisit", 1, 2000): 1, (None, "revisit", 1, 2000): 1, (None, "response", None, 0): 1})


def test_members_are_records_and_broken_ones_are_named(spark):
    payload = b"hello " * 1000
    members = list(warc.page_records("urn:page:5:0", "http://x/", payload, hashlib.sha1(payload).hexdigest(), None, 1000))
    assert len(members) > 3 and all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in members)
    headers, block = next(warc.parse(members[-1]))
    assert headers["warc-segment-origin-id"] == "<urn:page:5:0>" and int(headers["warc-segment-total-length"]) > len(payload)

    def read(parts):
        folder = shared_folder(spark, "broken")
        from gridspark.llm.common import put_file

        for i, p in enumerate(parts):
            put_file(folder, f"{i}.warc.gz", p)
        return [(r.kind, r.payload_bytes, r.problem) for r in warc.read_archives(spark, folder).collect()]

    assert read(members[::-1]) == [("response", 6000, None)]  # segments in other files, in any order
    assert read([b"".join(members[:2] + members[3:])]) == [("response", None, "a segment is missing")]
    assert read([b"".join(members[:-1])]) == [("response", None, "a segment is missing")]
    other = list(warc.page_records("urn:page:5:0", "http://x/", payload, "0" * 40, None, 1000))
    assert read([b"".join(other)]) == [("response", 6000, "the digest differs")]


@pytest.mark.parametrize("size", [0, 1, 8191, 8192, 8193, 50_000])
def test_chunked_framing(size):
    body = bytes(i % 251 for i in range(size))
    framed = warc.chunked(body)
    assert warc.dechunked(framed) == body
    assert warc.dechunked(b"5;name=x\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.dechunked(framed[:-5] if size else b"5\r\nhel")


# --- shards ---------------------------------------------------------------------------------


def plain_best_fit(sizes, capacity):
    """One item after another into the bin with the least room that holds it."""
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= s]
        if fit:
            room[min(fit)[1]] -= s
        else:
            room.append(capacity - s)
    return sorted(room)


def test_histogram_packing_equals_the_plain_rule():
    r = np.random.default_rng(1)
    for seed in range(30):
        sizes = r.integers(1, 60 if seed % 2 else 9, r.integers(1, 120)).tolist()
        plan = sharding.best_fit_decreasing(list(Counter(sizes).items()), 64)
        room = {}
        for size, number, n in plan:
            room[number] = room.get(number, 64) - size * n
        assert sorted(room.values()) == plain_best_fit(sizes, 64)
        assert Counter({s: sum(n for x, _, n in plan if x == s) for s in set(sizes)}) == Counter(sizes)
    assert sharding.best_fit_decreasing([(65, 1)], 64) is None and sharding.best_fit_decreasing([(40, 3)], 64, 2) is None


def test_tree_gives_the_tightest_bin():
    tree, held, r = sharding.CapacityTree(), set(), np.random.default_rng(2)
    tree.LEAF = 8
    for n in range(3000):
        size = int(r.integers(0, 500))
        if r.random() < 0.6:
            tree.add(size, n)
            held.add((size, n))
        else:
            want = min((x for x in held if x[0] >= size), default=None)
            assert tree.take_tightest(size) == want
            held.discard(want)


def test_one_large_group_has_a_shard_of_its_own():
    plan = sharding.plan_shards([(10_000, 1), (100, 390), (7, 50)], 40)
    load = {}
    for size, shard, n in plan:
        load[shard] = load.get(shard, 0) + size * n
    rest = sorted(load.values())[:-1]
    assert max(load.values()) == 10_000 and len(load) == 40 and rest[-1] - rest[0] <= 100


def test_shards(spark, docs, edge, nothing):
    for table, shards in ((docs, 40), (edge, 3)):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = sharding.shard_by_bytes(table, shards).collect()
        key = lambda i, t: (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
        assert sorted((str(g.doc_id), g.size, g.text_crc32) for g in got) == sorted(key(i, t) for i, t in rows)
        home = {}
        for g in got:
            home.setdefault((g.size, g.text_crc32), set()).add(g.shard)
        assert all(len(s) == 1 for s in home.values())
        slots = {}
        for g in got:
            slots.setdefault(g.shard, []).append(g.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    load = Counter()
    for g in sharding.shard_by_bytes(docs, 10).collect():
        load[g.shard] += g.size
    assert max(load.values()) < 1.02 * min(load.values())
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_size_classes_round_up_by_little(spark):
    values = [1, 16, 8191, 8192, 8193, 16385, 123_456_789, 10**15 + 1]
    for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", sharding.size_class(F.col("v")).alias("c")).collect():
        assert r.v <= r.c <= r.v * (1 + 2**-12) and (r.c == r.v or r.v >= 8192)


def test_numbers_are_gapless_in_hot_groups(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").alias("k"))
    got = {}
    for r in numbered(df, ["k"], [F.col("id")], "n", F.col("id"), 16).collect():
        got.setdefault(r.k, []).append(r.n)
    assert {k: len(v) for k, v in got.items()} == {"hot": 4000, "b": 500, None: 500}
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


# --- language -------------------------------------------------------------------------------


def brute_grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in range(1, 5):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    return out


def code(gram):
    out = 0
    for c in gram:
        out = (out << 16) | (ord(c) & 0xFFFF)
    return out


@pytest.mark.parametrize("text", ["Das ist, ja!! Über-Straße 12 x", "a", "  ", "ÎÉ  b\nc d", "A1b2", "the cat the cat"])
def test_grams_equal_brute_force(text):
    codes, counts = langid.counted(text)
    assert dict(zip(codes.tolist(), counts.tolist())) == {code(g): n for g, n in brute_grams(text).items()}


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "some words and others, " * 300
    whole = langid.counted(text)
    monkeypatch.setattr(langid, "STEP", 100)
    parts = langid.counted(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_predictions_equal_brute_force_and_hold_out(docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    sums = {}
    for i, text, lang in rows:
        if not held[i]:
            sums.setdefault(lang, Counter()).update(brute_grams(text))
    top = lambda c: [code(g) for g in sorted(c, key=lambda g: (-c[g], code(g)))[:400]]
    ranks = {k: {g: n for n, g in enumerate(top(c))} for k, c in sorted(sums.items())}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    right = []
    for i, text, lang in rows:
        own = top(brute_grams(text))
        away = {k: sum(abs(n - p[g]) if g in p else 400 for n, g in enumerate(own)) for k, p in ranks.items()}
        best = min(away, key=lambda k: (away[k], k))
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 - away[best] / (400 * len(own))) and got[i].held_out == held[i]
        if held[i]:
            right.append(best == lang)
    assert np.mean(right) > 0.97


def test_edge_rows_of_language(edge, nothing, docs):
    got = langid.identify(edge).collect()
    assert len(got) == edge.count()
    none = [g for g in got if g.lang_pred == "und"]
    assert len(none) == 5 and all(g.score == 0 for g in none)  # null twice, empty, blank, no letter
    assert all(0 <= g.score <= 1 for g in got) and langid.identify(nothing).count() == 0
    assert {g.lang_pred for g in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.readable(edge, margin=0.0)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 5 and langid.readable(nothing).count() == 0


# --- licences -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark, docs):
    return licenses.fit(spark, docs)


def test_notices(spark, model):
    cases = {
        1: ("Bla bla.\nReleased under the MIT License.\nMore", "MIT"), 2: ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "GPL"), 4: ("licensed under cc by-nc 4.0", "CC-BY-NC"),
        5: ("Licensed under CC BY 4.0", "CC-BY"), 6: ("This file is licensed under the GNU Lesser General Public License, version 2.1", "LGPL"),
        7: ("Ich fahre mit dem Bus", "none"), 8: ("A license to fish is needed in the public park", "none"), 9: (None, "none"), 10: ("", "none"),
        11: ("words " * 3000 + "Released under the MIT License " + "words " * 3000, "MIT"), 12: ("Licensed under the Mozilla Public License 2.0", "MPL-2.0"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, model).collect()}
    assert {i: got[i].license for i in cases} == {i: x for i, (_, x) in cases.items()}
    assert got[1].n_notices == 1 and got[7].n_notices == 0 and got[9].n_paragraphs == 0


def test_planted_notices_are_found_and_no_other(docs, model):
    marks = {"MIT": "the mit license", "Apache-2.0": "the apache license", "GPL": "gnu general public license", "CC-BY-NC": "cc by-nc"}
    want = {r.doc_id: next((f for f, m in marks.items() if m in r.text.lower()), "none") for r in docs.collect()}
    got = {r.doc_id: r.license for r in licenses.scan(docs, model).collect()}
    assert got == want and len(set(want.values())) > 2


def test_edge_rows_of_licences(edge, nothing, model):
    got = licenses.scan(edge, model).collect()
    assert len(got) == edge.count() and {g.license for g in got} == {"none"}
    assert licenses.scan(nothing, model).count() == 0


def test_licenses_threshold_counts_every_paragraph(spark):
    # A common paragraph that looks like a notice, is held out and has the last hash; the fit gets little weight of it.
    odd = spark.createDataFrame([(f"redistribution and use {i}",) for i in range(400)], "text string")
    late = odd.where(F.pmod(F.xxhash64("text"), F.lit(2)) == 1).orderBy(F.xxhash64("text").desc()).first().text
    docs = spark.createDataFrame([(f"license desk {i}",) for i in range(200)] + [(f"{late}\n{late}\n{late}",)] * 100, "text string")
    model = licenses.fit(spark, docs, 2)
    got = model.score(spark.createDataFrame([(late,)], "text string").withColumn("_tokens", licenses.split_words(F.col("text")))).first()
    assert got.family != licenses.NONE and got.probability > 0.5
    assert model.believed >= got.probability - 1e-9
    assert licenses.background_features(docs, model.counter).agg(F.sum("_n")).first()[0] == 500


def test_every_anchor_has_a_stem_and_every_template_an_anchor():
    assert all(any(s in a for s in licenses.STEMS) for a in licenses.ANCHORS)
    pairs = [" ".join(licenses._pairs(t)).split() for ts in licenses.TEMPLATES.values() for t in ts]
    assert all(set(p) & set(licenses.ANCHORS) for p in pairs)


def test_features_are_all_runs_with_an_anchor(spark):
    cases = ["released under the mit license", "mit", "a mit", "no notice here at all", "", "mit mit mit bsd x y z gpl"]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", licenses.features(licenses.split_words(F.col("t"))).alias("g"))
    for r in df.collect():
        w = r.t.split()
        want = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1) if set(w[i : i + n]) & {*licenses.ANCHORS, *licenses.NAMES}}
        assert set(r.g) == want and len(r.g) == len(want)


def test_licence_scan_has_no_python(docs, model):
    plan = licenses.scan(docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- pipeline -------------------------------------------------------------------------------


def test_stages_equal_their_parts(spark, sf, docs):
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.schema.names == docs.schema.names
        rows = after.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in kept.collect()} and len(rows) < docs.count() or kept is docs
        kept = spark.createDataFrame(rows, docs.schema)
    ids = {r.doc_id for r in kept.collect()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == ids
    from tests_brute import survivors

    assert ids == survivors(docs.collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect())


def test_stages_take_edge_rows(spark, sf, edge, nothing):
    for table in (edge, nothing):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = spark.createDataFrame(stage(spark, kept, sf).collect(), table.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf).count()
        assert (pieces > 0) == (table is edge)


def test_text_unlike_all_languages_goes(spark, docs):
    rng = random.Random(3)
    noise = [(10**6 + i, "".join(rng.choice("0123456789abcdefABCDEF+/") for _ in range(400)), None) for i in range(30)]
    given = docs.select("doc_id", "text", "lang")
    kept = {r.doc_id for r in langid.readable(given.union(spark.createDataFrame(noise, given.schema))).collect()}
    plain = {r.doc_id for r in given.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert len([i for i, *_ in noise if i in kept]) <= 3 and len(plain & kept) >= 0.995 * len(plain)


def test_without_languages_all_letters_stay(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, "123", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.readable(rows).collect()} == {1, 4}
