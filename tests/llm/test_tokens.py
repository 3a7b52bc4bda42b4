"""Packing, token files and token counts against the tokenizer libraries and the rules of their contracts."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridspark.llm import packing, tokencount, tokenfile
from gridspark.llm.wordbpe import TextEncoder

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LETTERS = "aAbéÉİßſKÅ'’'sS'T'RElL  \n\t 　  12²½٣ $%_-—\U0001f642́̈𝒳ΩΣςﬁ\x00\x1c\x85▁"


def noise(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(n)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("cache", [50, 700_000])
def test_encoder_equals_the_library(path, cache, docs):
    texts = [r.text for r in docs.select("text").collect()] + noise(3000) + ["a<|endoftext|>b", "", " ", "a  b", " a", "a ", "\n a"]
    own = TextEncoder(path, cache)
    for text, want in zip(texts, Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.ids, text


def test_counts_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    machine = tokencount.Transducer(PIECE)
    small = tokencount.Transducer(PIECE, max_transitions=300)
    for text in [*noise(1500), "aab  e t" * 50, "", " "]:
        want = len(model.encode(text))
        small.trim()
        assert machine.count(text) == small.count(text) == want


def test_chunk_maps_compose_in_any_grouping():
    machine = tokencount.Transducer(PIECE)
    r = random.Random(4)
    for text in ["Some words, and  more   words\nwith é and unbrokenruns" * 3, "x" * 300, "▁▁▁ a▁b  " * 9, *noise(40, 9)]:
        whole = machine.count(text)
        full = "▁" + text.replace(" ", "▁")
        cuts = sorted({0, len(full), *(r.randrange(len(full) + 1) for _ in range(5))})
        state, n = machine.run(machine.start, full[: cuts[1]])
        maps = [("", n, state.live), *[machine.chunk_map(full[a:b]) for a, b in zip(cuts[1:], cuts[2:])]]
        left = maps[0]
        for m in maps[1:]:
            left = machine.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = machine.compose(m, right)
        assert (left[1] if text else 0) == (right[1] if text else 0) == whole


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_token_counts(edge, nothing, chunk):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = edge.select("doc_id", "text").collect()
    got = tokencount.token_counts(edge, PIECE, chunk=chunk).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 4096) for r in rows]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((g.doc_id, g.n_bytes, g.n_tokens, g.over_limit) for g in got), key=order) == sorted(want, key=order)
    assert tokencount.token_counts(nothing, PIECE).count() == 0


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for ids in (r.integers(0, 50000, 1000), r.integers(0, 2**32, 777), np.zeros(0, int), r.zipf(1.3, 5001) % 70000, np.array([2**32 - 1]), np.full(300, 9)):
        ids = ids.astype(np.uint32)
        content = tokenfile.write_bytes(np.array([1, 2]), np.array([len(ids), 0]), ids)
        header, s = tokenfile.read_bytes(content)
        assert header["ids"] == len(ids) and (tokenfile.decode_blocks(s, 0, len(s["widths"]))[: len(ids)] == ids).all()
        a, b = len(ids) // 3, len(ids) // 2
        assert (tokenfile.read_range(content, a, b) == ids[a:b]).all()
    narrow = np.r_[np.arange(120), [60000] * 8]
    assert len(tokenfile.write_bytes(np.array([1]), np.array([128]), narrow.astype(np.uint32))) < 128 * 2 + 300
    with pytest.raises(ValueError):
        tokenfile.read_bytes(content[:-1])


def test_token_files(edge, nothing, docs):
    library = Tokenizer.from_file(BYTE)
    for table in (edge, docs):
        rows = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in table.select("doc_id", "text").collect()]
        got = tokenfile.token_files(table, BYTE, parts=3).collect()
        assert sorted((str(g.doc_id), g.n_tokens, g.ids_crc32) for g in got) == sorted((str(i), len(x), crc(x)) for i, x in rows)
        at = 0
        for g in sorted(got, key=lambda g: g.start):
            assert g.start == at
            at += g.n_tokens
        order = [g.doc_id for g in sorted(got, key=lambda g: g.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert tokenfile.token_files(nothing, BYTE).count() == 0


def check_pieces(rows, got):
    library = Tokenizer.from_file(WORD)
    left = {}
    for i, text in rows:
        left.setdefault(i, []).append(library.encode(text or "", add_special_tokens=False).ids + [1])
    pieces = {}
    for g in got:
        pieces.setdefault(g.doc_id, []).append(g)
    for i, wanted in left.items():
        # rows that repeat an id can't be told apart by it, so their pieces are matched by content
        spans = sorted(crc(x[g.start : g.start + g.length]) == g.ids_crc32 for g in pieces[i] for x in wanted[:1]) if len(wanted) == 1 else [True]
        assert all(spans)
        assert sum(g.length for g in pieces[i]) == sum(map(len, wanted))
        if len(wanted) == 1:
            at = 0
            for g in sorted(pieces[i], key=lambda g: g.start):
                assert g.start == at and g.length > 0 and g.doc_tokens == len(wanted[0])
                at += g.length
    fill = {}
    for g in got:
        fill.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(2048 - sum(n for _, n in s) for s in fill.values())


def test_packing(edge, nothing, docs):
    for table in (edge, docs):
        padding = check_pieces([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], packing.pack(table, WORD).collect())
        assert padding < 2048
    check_pieces([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, WORD, shard_docs=40).collect())
    assert packing.pack(nothing, WORD).count() == 0


def test_neighbours_are_the_best_by_bm25():
    r = np.random.default_rng(2)
    docs = [r.integers(0, 300, r.integers(20, 60)).astype(np.uint32) for _ in range(120)]
    index = packing.ShardIndex(docs, common=1.0)
    unused = r.random(120) < 0.7
    unused[5] = False
    df = {}
    for d in docs:
        for t in set(d.tolist()):
            df[t] = df.get(t, 0) + 1
    mean = np.mean([len(d) for d in docs])
    idf = {t: np.log(1 + (120 - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    top = sorted((t for t in set(docs[5].tolist()) if df[t] > 1), key=lambda t: (-idf[t], t))[:10]
    score = {}
    for i, d in enumerate(docs):
        if unused[i]:
            c = {t: d.tolist().count(t) for t in top}
            s = sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, n in c.items() if n)
            if s:
                score[i] = s
    want = sorted(score, key=lambda i: (-score[i], i))[:6]
    found, scores = index.neighbours(docs[5], unused, 10, 6)
    np.testing.assert_allclose(scores, [score[i] for i in want])
    assert found.tolist() == want or np.allclose([score[i] for i in found.tolist()], [score[i] for i in want])


def test_similar_documents_share_windows():
    r = np.random.default_rng(3)
    docs = [(r.integers(0, 40, 200) + 1000 * (i % 10)).astype(np.uint32) for i in range(100)]
    placed = {}
    for doc, _, _, sequence, *_ in packing.pack_shard(docs, 1000):
        placed.setdefault(sequence, []).append(doc % 10)
    assert np.mean([len(set(x)) for x in placed.values()]) < 2.5  # at random nearly every piece would have another topic


def test_probes_refuse_other_models(tmp_path):
    spec = json.load(open(WORD, encoding="utf-8"))
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        TextEncoder(str(path))
