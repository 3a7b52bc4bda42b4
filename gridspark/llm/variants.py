"""Spelling variants of a corpus's words: near words by PartEnum signatures over letter multisets.

A word's letters with their counts are a binary vector: one place for the first, second, ... occurrence of each letter. Words
one insertion, deletion or replacement apart have vectors at a Hamming distance of at most two. The places are parted into
``PARTS``; a distance of two touches at most two parts, so the vectors agree on the rest for some choice of two parts to leave
out. A signature is such a choice with the vector on the other parts: near words share one, whatever the words are.

Letters alone leave all anagrams of a word together. A single edit also leaves the first or the last half of the shorter word
as it is (common start and common end of two near words together lack at most one letter of it), so signatures are taken
with the shorter length and with either half. Every choice is made in full, so nothing is lost; equal signatures meet in one
equi-join, whose condition verifies the pair, and only verified pairs leave it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import materialize, mix

#: Parts of the places; all choices of two of them are left out in turn.
PARTS = 4
#: Words a task counts before it passes the counts on.
HELD = 200_000
#: Characters of a text from which its words are counted one by one, not from a list.
LONG = 1 << 20
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
U = np.uint64


def _count(least: int, drop: int | None):
    run_of = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)  # a shorter run gives no word, a longer one matches whole

    def words_of(doc_id: str, text: str, into: Counter) -> None:
        own: dict[str, int] = {}
        found = Counter(run_of.findall(text) if len(text) < LONG else (m.group() for m in run_of.finditer(text)))
        for run, n in found.items():
            word = run.lower() if run.isascii() else run.translate(LOWER)
            own[word] = own.get(word, 0) + n
        for word, n in own.items():
            if drop and (h := crc32(f"{doc_id}:{word}".encode())) % drop == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                into[word] += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    words_of(str(doc_id.as_py()) if doc_id.is_valid else "", text.as_py(), held)
                    if len(held) > HELD:
                        yield flush()
        if held:
            yield flush()

    return run


def vocabulary(docs: DataFrame, least: int = 7, occurrences: int = 2, drop: int | None = None) -> DataFrame:
    """word, n: the distinct words of at least ``least`` code points, with at least ``occurrences`` in all texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased. Texts are counted in their
    tasks first, so a common word sends a row from each. With ``drop``, runs whose crc32 of ``<doc_id>:<run>`` it divides lose
    one letter first (a null doc_id is written as nothing). Null and empty texts have no words."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = own.mapInArrow(_count(least, drop), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= occurrences)


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``own`` and ``longer``, (words, signatures) each: the signatures of a word as the shorter of a pair, or as long as the
    other, and those as the longer. Of two near words, one's own and the other's own or longer share a value."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(U)
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(letters)) - first[owner]
    # the binary vector's places: a letter and the number of its occurrence
    order = np.lexsort((letters, owner))
    new = np.ones(len(letters), dtype=bool)
    new[1:] = (letters[order][1:] != letters[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    starts = np.maximum.accumulate(np.where(new, np.arange(len(letters)), 0))
    place = mix((letters[order] << U(32)) + (np.arange(len(letters)) - starts).astype(U) + U(1))
    parts = np.zeros((len(words), PARTS), dtype=U)
    np.add.at(parts, (owner[order], (place >> U(40)) % U(PARTS)), place)
    total = parts.sum(axis=1, dtype=U)
    # hashes of all starts and ends of a word
    heads = np.concatenate([np.zeros(1, U), np.cumsum(mix((letters << U(32)) + at.astype(U) + U(0x51ED)), dtype=U)])
    tails = np.concatenate([np.zeros(1, U), np.cumsum(mix((letters << U(32)) + (sizes[owner] - 1 - at).astype(U) + U(0xA5A5)), dtype=U)])
    sides = []
    for shorter in (sizes, np.maximum(sizes - 1, 0)):
        half = shorter // 2
        columns = []
        for number, (a, b) in enumerate(combinations(range(PARTS), 2)):
            kept = mix(total - parts[:, a] - parts[:, b] + U(number + 1))
            for value in (heads[first + half] - heads[first], mix(tails[first + sizes] - tails[first + sizes - half])):
                columns.append(mix(mix(kept + value) + shorter.astype(U)))
        sides.append(np.stack(columns, axis=1))
    return sides[0], sides[1]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 8192) for b in batches for at in range(0, b.num_rows, 8192)):
        own, longer = signatures(batch.column(0).to_pylist())
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel().view(np.int64))) for x in (own, longer)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["word", "n", "own", "longer"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every ordered pair of words (word, n; words are distinct) exactly one edit apart, once."""
    signed = words.mapInArrow(_sign, "word string, n long, own array<long>, longer array<long>")
    left = signed.select(F.explode("own").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = signed.select(F.explode(F.concat("own", "longer")).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    sizes = F.length("b") - F.length("a")
    pairs = left.join(right, "key").filter(((sizes == 0) & (F.col("a") < F.col("b")) | (sizes == 1)) & (F.levenshtein("a", "b", 1) == 1))
    held = pairs.select("a", "a_n", "b", "b_n").distinct()
    return held.toDF("word", "n", "other", "other_n").union(held.select("b", "b_n", "a", "a_n"))


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; distinct, not null).

    n_near counts a word's near words. ``form`` is its near word of the largest n (ties: the least in code-point order) if
    that n is at least ``factor`` (2 or more) times its own, else null; counts grow along forms, so they end, and ``root`` is
    the last, or the word itself. A word has no more forms pointing at it than there are strings one edit away."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("_best"))
    large = -F.col("_best.less") >= factor * F.col("n")
    found = materialize(best.select("word", "n_near", F.when(large, F.col("_best.other")).alias("form"), F.when(large, -F.col("_best.less")).alias("form_n")), "near")
    steps = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the way that is followed
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = materialize(steps.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        steps = further.select("word", "root")
        if further.filter("_moved").isEmpty():
            break
    return words.join(found, "word", "left").join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )


def spelling_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, drop: int | None = None, factor: int = 10) -> DataFrame:
    """``group_variants`` of the ``vocabulary`` of ``docs`` (doc_id, text; other columns are ignored).

    Repeated rows count each; an empty table and texts without long words give no rows. Long texts are read whole."""
    return group_variants(vocabulary(docs, least, occurrences, drop), factor)
