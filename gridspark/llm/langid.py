"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 4 letters, words padded by a space) in order. A document's
own list is compared with each profile: an n-gram's distance is the difference of its two ranks, or the length of the list
where the profile lacks it. The language with the least sum is the prediction.

Words are runs of letters; case, digits and other signs do not count. N-grams are 64-bit codes of their letters, exact for
letters of the basic plane (rarer letters share codes by their low 16 bits)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import free_name

MAX_N = 4
UNKNOWN = "und"
#: Characters of a numpy step; a longer text is counted in parts.
STEP = 1 << 20
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _LETTERS[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def grams(text: str) -> np.ndarray:
    """The codes of all n-grams of a text's words, each word between two spaces; an n-gram of a lone space is left out."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    letter = letter_table()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one separator after each word
    codes = np.where(letter, points & np.uint32(0xFFFF), np.uint32(32))[kept].astype(np.uint64)
    codes = np.concatenate([np.array([32], dtype=np.uint64), codes, np.array([32], dtype=np.uint64)])
    space = codes == 32
    out, value = [codes[~space]], codes
    inner = np.zeros(len(codes), dtype=bool)
    for n in range(2, MAX_N + 1):
        inner = (inner[:-1] | space[n - 2 : -1]) if n > 2 else np.zeros(len(codes) - 1, dtype=bool)
        value = (value[:-1] << np.uint64(16)) | codes[n - 1 :]
        # no space inside, and not two spaces alone
        good = ~inner & ~(space[: len(value)] & space[n - 1 :]) if n == 2 else ~inner
        out.append(value[good])
    return np.concatenate(out)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a whole text, ascending, and their counts; long texts are cut at separators into parts."""
    if len(text) <= STEP:
        return np.unique(grams(text), return_counts=True)
    total: dict[int, int] = {}
    at = 0
    while at < len(text):
        end = min(len(text), at + STEP)
        while end < len(text) and text[end - 1].isalpha() and end - at < 2 * STEP:
            end += 1
        for code, n in zip(*(x.tolist() for x in np.unique(grams(text[at:end]), return_counts=True)), strict=True):
            total[code] = total.get(code, 0) + n
        at = end
    codes = np.array(sorted(total), dtype=np.uint64)
    return codes, np.array([total[c] for c in codes.tolist()], dtype=np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties to the smaller code."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(docs: DataFrame, size: int) -> dict[str, np.ndarray]:
    """Profiles from the text and non-null lang of all rows of ``docs``: n-gram counts are summed per task, then per language.

    Only a language's ``size`` most frequent n-grams reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            for lang, parts in held.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()
            waiting = 0

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                value = text.as_py()
                for at in range(0, len(value), STEP):
                    found = grams(value[at : at + STEP])
                    held.setdefault(lang, []).append(found)
                    waiting += len(found)
                    if waiting > 1 << 23:
                        yield from flush()
        yield from flush()

    counts = docs.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of each of 64 shares of the n-grams first, so a language's own step has 64 * size rows at most
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), F.col("gram")))
    shares = sums.withColumn("_share", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("place", place("_share")).filter(F.col("place") <= size)
    rows = shares.withColumn("place", place()).filter(F.col("place") <= size).collect()
    out: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return {k: np.array([g for _, g in sorted(v)], dtype=np.int64).view(np.uint64) for k, v in sorted(out.items())}


class Profiles:
    """Profiles laid out for comparison: all their n-grams ascending, and each language's rank of each."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = list(profiles), size
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int32)
        for i, codes in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.codes, codes), i] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 less its distance as a share of the largest possible one."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        own = ranked(*counted(text), self.size)
        at = np.searchsorted(self.codes, own)
        found = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own), at, len(self.codes))
        ranks = self.ranks[found]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score``; ties go to the first language by name."""
    names = docs.columns
    if {pred, score} & set(names):
        raise ValueError("the table has a column of that name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(profiles, size)
        at = names.index("text")
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, pred, score],
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    ``und`` with score 0 for a null text, a text without a letter, or when no row has a lang to learn from. Rows without a
    doc_id count as not held out. Repeated rows and very long texts are ordinary; an empty table gives no rows."""
    profiles = learn_profiles(docs.filter(~held_out()), size)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(slim, profiles, size).select("doc_id", "held_out", "lang_pred", "score")


def readable(docs: DataFrame, size: int = 400, rare: float = 0.001, margin: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns as they are.

    Profiles are learnt from all rows that have a lang. The least score is learnt too: ``margin`` times the score below which
    a share of ``rare`` of the rows with a lang lie, so text unlike all profiles (codes, keys, noise) goes and documents
    in the languages learnt stay. Null texts and those without a letter go; where no row has a lang all others stay. Ties,
    repeated rows and very long texts are ordinary; an empty table gives no rows."""
    profiles = learn_profiles(docs, size)
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    if not profiles:
        lettered = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
        return docs.filter(lettered)
    known = predict(docs.filter("lang is not null").select("text"), profiles, size).filter(F.col("lang_pred") != UNKNOWN)
    least = known.agg(F.percentile_approx("score", rare, 100_000)).first()[0] or 0.0
    marked = predict(docs, profiles, size, pred, score)
    return marked.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= margin * least)).drop(pred, score)
