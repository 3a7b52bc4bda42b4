"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage with block-max WAND.

Terms are runs of three words, so a passage that shares only common words with an item meets no postings. Impacts are BM25
weights divided by the item's score for its own text, so the score of a passage is the share of an item's information that it
holds, and one threshold fits all items. Items are numbered in index order; postings are cut into blocks with their largest
impact, and a block whose bound can't reach the threshold is skipped. What passes is verified: the words of the item's
question and of its answer must be found in the passage in order.

An item is one text. Its answer is its last sentence if that has at least three words and is not all of it, else its last
three words; the question is what stands before. Where the text holds a mark such as ``Answer:``, that parts the two."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import free_name, materialize, put_file, shared_folder, words

GRAM = 3
BLOCK = 16
MARK = re.compile(r"\b(?:answer|antwort|réponse|respuesta)\s*:", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
RESULT = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double, contaminated boolean"


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer; a text of few words is all answer."""
    mark = MARK.search(text)
    if mark:
        return words(text[: mark.start()]), words(text[mark.end() :])
    parts = [p for p in map(words, SENTENCE.split(text)) if p]
    every = [w for p in parts for w in p]
    last = len(parts[-1]) if len(parts) > 1 and len(parts[-1]) >= 3 else 3
    return every[:-last], every[-last:]


@dataclass
class ItemIndex:
    """The inverted index of some items: words and terms by number, postings by term in item order, block maxima."""

    items: list[int | None]
    questions: list[list[str]]
    answers: list[list[str]]
    word_ids: dict[str, int]
    codes: np.ndarray
    first: np.ndarray
    postings: np.ndarray
    impacts: np.ndarray
    tops: np.ndarray
    longest: int
    short: bool
    block_tops: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, rows: list[tuple[int | None, str]], frequencies: dict[tuple, int], n_items: int, mean_length: float, longest: int, k1: float = 1.2, b: float = 0.75) -> ItemIndex:
        rows = [(i, t, words(t)) for i, t in rows]
        rows = sorted(((i, t, w) for i, t, w in rows if w), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        word_ids = {w: n for n, w in enumerate(dict.fromkeys(w for _, _, ws in rows for w in ws))}
        entries = []
        for number, (_, _, ws) in enumerate(rows):
            counts = Counter(terms(ws))
            norm = k1 * (1 - b + b * sum(counts.values()) / mean_length)
            weight = {t: math.log(1 + (n_items - frequencies[t] + 0.5) / (frequencies[t] + 0.5)) * c * (k1 + 1) / (c + norm) for t, c in counts.items()}
            total = sum(weight.values())
            entries += [(code([word_ids[w] for w in t], len(word_ids)), number, x / total) for t, x in weight.items()]
        entries.sort()
        every = np.array([e[0] for e in entries], dtype=np.int64)
        codes, first = np.unique(every, return_index=True)
        out = cls(
            [r[0] for r in rows], *zip(*[question_answer(t) for _, t, _ in rows], strict=True), word_ids, codes, np.append(first, len(entries)),
            np.array([e[1] for e in entries], dtype=np.int64), np.array([e[2] for e in entries]), np.zeros(0), longest, min(len(r[2]) for r in rows) < GRAM,
        )
        out.tops = np.maximum.reduceat(out.impacts, first)
        out.block_tops = [np.maximum.reduceat(out.impacts[a:z], np.arange(0, z - a, BLOCK)) for a, z in zip(out.first, out.first[1:], strict=False)]
        return out

    def search(self, found: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item number, score) of all items that reach ``threshold`` for the distinct terms ``found``: block-max WAND.

        Lists are kept in the order of their current item. The pivot is the first list at which the sum of the lists' maxima
        reaches the threshold; no item before its own can reach it. The blocks that hold the pivot's item bound its score
        more tightly: if they fail, all lists before the next block border are skipped at once."""
        lists = [[int(self.first[t]), int(self.first[t]), int(self.first[t + 1]), float(self.tops[t]), self.block_tops[t]] for t in found.tolist()]
        post, impact, out = self.postings, self.impacts, []
        least = threshold - 1e-9
        while True:
            lists = sorted((x for x in lists if x[0] < x[2]), key=lambda x: post[x[0]])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[3]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = post[lists[pivot][0]]
            while pivot + 1 < len(lists) and post[lists[pivot + 1][0]] == item:
                pivot += 1
            tight, border = 0.0, None
            for x in lists[: pivot + 1]:
                at = x[0] + int(np.searchsorted(post[x[0] : x[2]], item))
                if at < x[2]:
                    block = (at - x[1]) // BLOCK
                    tight += float(x[4][block])
                    end = x[1] + (block + 1) * BLOCK
                    after = int(post[end]) if end < x[2] else None
                    border = after if border is None or (after is not None and after < border) else border
            if tight < least:
                go = item + 1 if border is None else max(item + 1, border)
                if pivot + 1 < len(lists):
                    go = min(go, int(post[lists[pivot + 1][0]]))
                go = max(go, item + 1)
                for x in lists[: pivot + 1]:
                    x[0] += int(np.searchsorted(post[x[0] : x[2]], go))
                continue
            score = 0.0
            for x in lists[: pivot + 1]:
                x[0] += int(np.searchsorted(post[x[0] : x[2]], item))
                if x[0] < x[2] and post[x[0]] == item:
                    score += float(impact[x[0]])
                    x[0] += 1
            if score >= least:
                out.append((int(item), round(score, 9)))  # the order of a sum's parts must not show


def terms(ws: list[str]) -> list[tuple[str, ...]]:
    """Runs of three words; a shorter text is one term."""
    return [tuple(ws[i : i + GRAM]) for i in range(max(1, len(ws) - GRAM + 1))]


def code(ids: list[int], size: int) -> int:
    """One number for a run of word numbers; a shorter run (an item of one or two words) is filled by ``size``."""
    out = 0
    for i in range(GRAM):
        out = out * (size + 1) + (ids[i] if i < len(ids) else size)
    return out


def covered(wanted: list[str], passage: list[str]) -> float:
    """The share of ``wanted`` in the passage in order: the longest common subsequence of words."""
    if not wanted:
        return 1.0
    own = set(wanted)
    row = np.zeros(len(wanted) + 1, dtype=np.int32)
    target = np.array(wanted, dtype=object)
    for w in passage:
        if w in own:
            row[1:] = np.maximum(row[1:], np.where(target == w, row[:-1] + 1, 0))
            row = np.maximum.accumulate(row)
    return float(row[-1]) / len(wanted)


def passages(n: int, size: int) -> list[tuple[int, int]]:
    """Word ranges of ``size`` words, each overlapping the one before by half; the last ends with the text."""
    step = size // 2
    return [(at, min(n, at + size)) for at in range(0, max(1, n - step), step)]


def search_text(index: ItemIndex, text: str | None, threshold: float, least_question: float, least_answer: float) -> list[tuple]:
    """(item_id, passage, score, question overlap, answer overlap, contaminated): an item's best passage of one text.

    Every passage that reaches the threshold is verified; the best one that passes is named, or the best if none does."""
    ws = words(text)
    if not ws:
        return []
    base = len(index.word_ids)
    numbers = np.array([index.word_ids.get(w, -1) for w in ws], dtype=np.int64)
    padded = np.append(numbers, [base] * (GRAM - 1))
    spans = [padded[i : i + len(ws)] for i in range(GRAM)]
    known = np.nonzero((spans[0] >= 0) & (spans[1] >= 0) & (spans[2] >= 0))[0]
    hits = [_lookup(index, spans, known, base, GRAM)]
    if index.short:
        for filled in (1, 2):  # items of one or two words are terms by themselves
            own = [spans[i] if i < filled else np.full(len(ws), base) for i in range(GRAM)]
            at = np.nonzero(np.all([own[i] >= 0 for i in range(filled)], axis=0))[0]
            hits.append(_lookup(index, own, at, base, filled))
    place, end, term = (np.concatenate(x) for x in zip(*hits, strict=True))
    if not len(place):
        return []
    size = max(256, 2 * index.longest)
    best: dict[int, tuple] = {}
    for a, z in passages(len(ws), size):
        found = np.unique(term[(place >= a) & (end <= z)])
        if len(found) and index.tops[found].sum() >= threshold - 1e-9:
            for item, score in index.search(found, threshold):
                held = best.get(item)
                better = held is None or score > held[1] + 1e-12
                if held is not None and held[4] and not better:
                    continue  # a verified one with at least this score is held
                own = ws[a:z]
                q, r = covered(index.questions[item], own), covered(index.answers[item], own)
                passes = q >= least_question and r >= least_answer
                if held is None or passes > held[4] or (passes == held[4] and better):
                    best[item] = (a, score, q, r, passes)
    return [(index.items[item], *hit) for item, hit in sorted(best.items())]


def _lookup(index: ItemIndex, spans: list[np.ndarray], at: np.ndarray, base: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 places and terms of the runs at ``at`` that the index holds."""
    codes = np.zeros(len(at), dtype=np.int64)
    for s in spans:
        codes = codes * (base + 1) + s[at]
    found = np.minimum(np.searchsorted(index.codes, codes), len(index.codes) - 1)
    hit = index.codes[found] == codes
    return at[hit], at[hit] + length, found[hit]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, least_question: float = 0.7, least_answer: float = 0.6, shard_items: int = 20_000) -> DataFrame:
    """doc_id, item_id, passage, score, question_overlap, answer_overlap, contaminated: a row per document and item whose
    score reaches ``threshold`` in some passage (the best verified one, or the best if none is; ``passage`` is its first
    word's place).

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Null and wordless texts match
    nothing, repeated items and documents are answered one by one, null ids stay null. Ties between passages go to the first.
    Whole texts are searched, in overlapping passages; empty tables give no rows. Statistics (frequencies of terms, number of
    items, mean and greatest length) cover all items, so results don't depend on shards. The index is cut into shards of at
    most ``shard_items`` items, a few MB each. A single one goes to the tasks by itself; more are files of the shared folder,
    which a task loads one after another for each batch of its documents, so the corpus is read once."""
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    n_items, mean, longest = _lengths(own)
    if not n_items:
        return spark.createDataFrame([], RESULT)
    shards = -(-n_items // shard_items)
    dealt = own.withColumn("_shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    counts = None if shards == 1 else materialize(_frequencies(own), "item-terms")
    folder = None if shards == 1 else shared_folder(spark, "item-index")
    loads: list[Callable[[], ItemIndex]] = []
    for shard in range(shards):
        rows = [(r["item_id"], r["text"]) for r in dealt.filter(F.col("_shard") == shard).select("item_id", "text").collect()]
        rows = [(i, t) for i, t in rows if words(t)]
        if rows:
            index = _index(spark, rows, counts, n_items, mean, longest)
            if folder is None:
                loads.append(partial(_given, index))
            else:
                put_file(folder, f"{shard}.pickle", pickle.dumps(index))
                loads.append(partial(_load, folder, f"{shard}.pickle"))
    return slim.mapInArrow(_searcher(loads, threshold, least_question, least_answer), RESULT)


def _given(index: ItemIndex) -> ItemIndex:
    return index


def _load(folder: str, name: str) -> ItemIndex:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    with fs.open_input_stream(f"{path}/{name}", compression=None) as file:
        return pickle.loads(file.read())


def _lengths(items: DataFrame) -> tuple[int, float, int]:
    """Number of items with a word, their mean number of terms, and the most words of one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(words(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    n = F.col("n")
    found = items.select("text").mapInArrow(run, "n long").filter(n > 0)
    row = found.agg(F.count(n), F.avg(F.greatest(n - (GRAM - 1), F.lit(1))), F.max(n)).first()
    return row[0], row[1] or 0.0, row[2] or 0


def _frequencies(items: DataFrame) -> DataFrame:
    """term (words joined by a space), df and length statistics over all items, as a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(" ".join(t), len(ws)) for ws in map(words, batch.column(0).to_pylist()) if ws for t in dict.fromkeys(terms(ws))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["term", "length"])

    found = items.select("text").mapInArrow(run, "term string, length long")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _index(spark, rows: list[tuple[int | None, str]], counts: DataFrame | None, n_items: int, mean: float, longest: int) -> ItemIndex:
    """The index of one shard, with the statistics of all items."""
    own = Counter(t for _, text in rows for t in dict.fromkeys(terms(words(text))))
    if counts is not None:
        asked = spark.createDataFrame([(" ".join(t),) for t in own], "term string")
        total = {r["term"]: r["df"] for r in counts.join(asked, "term").collect()}
        own = {t: total[" ".join(t)] for t in own}
    return ItemIndex.build(rows, own, n_items, mean, longest)


def _searcher(loads: list[Callable[[], ItemIndex]], threshold: float, least_question: float, least_answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            for load in loads:
                index = load()
                out = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in search_text(index, text.as_py(), threshold, least_question, least_answer)]
                columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def clean(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no contaminated passage. Rows without a doc_id are searched by
    their text as all others are."""
    key, text_key = free_name(docs, "_key"), free_name(docs, "_text_key")
    bad = find_leaks(docs.select(F.xxhash64("text").alias("doc_id"), "text"), items, **parameters).filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(text_key, F.xxhash64("text")).join(bad, F.col(text_key) == F.col(key), "left_anti").drop(text_key)
