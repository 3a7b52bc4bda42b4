"""Best match of names among candidates, found through indexes and bounds.

A score is 0.65 of a likeness of letters and 0.35 of the share of common words. A few likely candidates, which share rare
three-letter pieces or words with a name, give each name a score to beat. What may beat it is looked up, not tried out:

* candidates with a common word, by an index of words and a bound from lengths and numbers of words;
* others need a likeness of letters of at least the score divided by 0.65. Where that is high, names that near have a
  number of two-letter pieces in common, so one of the name's rarest pieces must be among them: an index of pieces;
* where it is low, letters are counted: no likeness is above the share of letters that two names have in common, whatever
  their order. Blocks of names and of candidates are compared by their counts and only pairs above the score go on.

Every bound holds for any names, so the result is that of scoring all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridspark.session import cut_lineage

#: Candidates up to which a name scores all of them in its own row.
CHUNK_NAMES = 512
#: Weights of letters and words.
LETTERS, WORDS = 0.65, 0.35
#: For the first guess: rare pieces of a name, candidates a piece may have, and candidates scored.
SEEDS = (6, 500, 3)
#: Sides of a block of counts.
BLOCK = (256, 4096)
BINS = 64
EPS = 1e-8


def _common_words(a: Column, b: Column) -> Column:
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))


def similarity(a: Column, b: Column) -> Column:
    """0.65 edit similarity + 0.35 word overlap, computed by built-in functions."""
    edit = F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.lit(LETTERS) * edit + F.lit(WORDS) * _common_words(a, b)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over all letters, for the few pairs that are scored."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _score(a: str, b: str, measure: str) -> Column:
    if measure == "edit":
        return F.round(similarity(F.col(a), F.col(b)), 9)
    return F.round(F.lit(LETTERS) * sequence_ratio(a, b) + F.lit(WORDS) * _common_words(F.col(a), F.col(b)), 9)


def _pieces(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: text.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _bag(table: DataFrame, column: str) -> DataFrame:
    """column, token: the two-letter pieces, the second of a kind being another one than the first."""
    pieces = table.select(column, F.explode(_pieces(F.col(column), 2)).alias("p")).groupBy(column, "p").count()
    return pieces.select(column, F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("i"), "p").select(column, F.concat_ws("#", "p", "i").alias("token"))


def _best(scored: DataFrame) -> DataFrame:
    """name, score, best: the highest score; the alphabetically first candidate on ties."""
    top = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("candidate").alias("c"))).alias("b"))
    return top.select("name", (-F.col("b.s")).alias("score"), F.col("b.c").alias("best"))


def _first_guess(names: DataFrame, options: DataFrame, measure: str) -> DataFrame:
    """name, score, best: the best of a few candidates that share rare pieces, and of the alphabetically first candidate."""
    rare, posting, tried = SEEDS

    def tokens(table: DataFrame, column: str) -> DataFrame:
        text = F.concat(F.lit("  "), F.col(column), F.lit(" "))
        return table.select(column, F.explode(F.array_distinct(F.concat(_pieces(text, 3), F.transform(F.split(column, " "), lambda w: F.concat(F.lit("w:"), w))))).alias("token"))

    theirs = tokens(options, "candidate")
    often = theirs.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= posting)
    own = tokens(names, "name").join(often, "token")
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("df", "token"))).where(F.col("_n") <= rare)
    shared = own.select("name", "token").join(theirs, "token").groupBy("name", "candidate").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("name").orderBy(F.desc("shared"), F.abs(F.length("name") - F.length("candidate")), "candidate")
    few = shared.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= tried).select("name", "candidate")
    default = names.select("name", F.lit(options.agg(F.min("candidate")).first()[0]).alias("candidate"))
    return _best(few.unionByName(default).distinct().withColumn("score", _score("name", "candidate", measure)))


def _may_win(bound: Column) -> Column:
    return (bound > F.col("score") + EPS) | ((bound >= F.col("score") - EPS) & (F.col("candidate") < F.col("best")))


def _by_words(guessed: DataFrame, options: DataFrame, measure: str) -> DataFrame:
    """Pairs with a common word that lengths and numbers of words allow to win."""
    def words(table: DataFrame, column: str, n: str, size: str) -> DataFrame:
        listed = F.array_distinct(F.split(column, " "))
        return table.select("*", F.length(column).alias(n), F.size(listed).alias(size), F.explode(listed).alias("word"))

    a, b = words(guessed, "name", "la", "wa"), words(options, "candidate", "lb", "wb")
    short, long = F.least("la", "lb"), F.greatest("la", "lb")
    letters = short / long if measure == "edit" else 2 * short / (short + long)
    bound = F.lit(LETTERS) * F.coalesce(letters, F.lit(1.0)) + F.lit(WORDS) * F.least("wa", "wb") / F.greatest("wa", "wb")
    met = a.join(b, "word").where(_may_win(bound)).select("name", "candidate", "score", "best", letters.alias("_letters")).distinct()
    exact = F.lit(LETTERS) * F.coalesce("_letters", F.lit(1.0)) + F.lit(WORDS) * _common_words(F.col("name"), F.col("candidate"))
    return met.where(_may_win(exact)).select("name", "candidate")


def _by_pieces(guessed: DataFrame, options: DataFrame, n_options: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that share one of the name's rarest pieces, and the names whose rare pieces are too common for that.

    Two names with an edit similarity of s have at least m (2 s - 1) - 1 pieces in common, m being the longer's length."""
    theirs = _bag(options, "candidate")
    often = theirs.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    need = guessed.select("*", F.length("name").alias("la"), ((F.col("score") - EPS) / LETTERS).alias("s"))
    need = need.withColumn("shared", F.ceil(F.col("la") * (2 * F.col("s") - 1) - 1 - EPS))
    own = _bag(need, "name").join(often, "token", "left").select("name", "token", F.coalesce("df", F.lit(0)).alias("df"))
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("df", "token")))
    probe = ranked.join(need, "name").where((F.col("s") <= 1) & (F.col("shared") >= 1) & (F.col("_n") <= F.col("la") - F.col("shared")))
    cost = probe.groupBy("name").agg(F.sum("df").alias("cost")).where(F.col("cost") <= max(1, n_options // 8))
    probed = cut_lineage(probe.join(cost, "name", "left_semi").select("name", "score", "best", "la", "token"))
    short, long = F.least("la", F.length("candidate")), F.greatest("la", F.length("candidate"))
    pairs = probed.join(theirs, "token").where(_may_win(F.lit(LETTERS) * short / long)).select("name", "candidate").distinct()
    weak = need.where("s <= 1").join(probed.select("name").distinct(), "name", "left_anti").select("name", "score", "best")
    return pairs, weak


def counts(texts: list[str]) -> np.ndarray:
    """Letters of each text in a fixed number of bins; letters that share a bin can only raise a bound."""
    out = np.zeros((len(texts), BINS), dtype=np.int16)
    for i, text in enumerate(texts):
        if text:
            out[i] = np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) % BINS, minlength=BINS)
    return out


def _above(measure: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for names, options in zip(batch["names"], batch["options"], strict=True):
                options = list(options)
                held, sizes = counts(options), np.array([len(o) for o in options])
                for row in names:
                    own = counts([row["name"]])[0]
                    common = np.minimum(held, own).sum(axis=1)
                    n = len(row["name"])
                    likeness = common / np.maximum(np.maximum(sizes, n), 1) if measure == "edit" else 2 * common / np.maximum(sizes + n, 1)
                    likeness = np.where(sizes + n == 0, 1.0, likeness)
                    bound = LETTERS * likeness
                    near = np.flatnonzero(bound >= row["score"] - EPS)
                    near = [i for i in near.tolist() if bound[i] > row["score"] + EPS or options[i] < row["best"]]
                    if near:
                        yield pd.DataFrame({"name": row["name"], "candidate": [options[i] for i in near]})

    return run


def _by_counts(weak: DataFrame, options: DataFrame, n_names: int, n_options: int, measure: str) -> DataFrame:
    """Pairs whose letters alone allow a win, block by block."""
    parts = [max(1, -(-n // size)) for n, size in zip((n_names, n_options), BLOCK, strict=True)]
    a = weak.groupBy(F.pmod(F.xxhash64("name"), F.lit(parts[0])).alias("_a")).agg(F.collect_list(F.struct("name", "score", "best")).alias("names"))
    b = options.groupBy(F.pmod(F.xxhash64("candidate"), F.lit(parts[1])).alias("_b")).agg(F.collect_list("candidate").alias("options"))
    spread = a.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1)).cast("array<long>")))
    blocks = spread.join(b, "_b").select("names", "options").repartition(parts[0] * parts[1])
    return blocks.mapInPandas(_above(measure), "name string, candidate string")


def _all_in_row(names: DataFrame, options: DataFrame) -> DataFrame:
    """Each name with the array of all candidates, of which there are few."""
    packed = options.agg(F.sort_array(F.collect_list("candidate")).alias("_options"))
    scored = F.transform("_options", lambda x: F.struct((-F.round(similarity(F.col("name"), x), 9)).alias("s"), x.alias("c")))
    best = names.withColumn("_options", packed.scalar()).select("name", F.array_min(scored).alias("b"))
    return best.select("name", (-F.col("b.s")).alias("score"), F.col("b.c").alias("best"))


def fuzzy_best_match(names: DataFrame, candidates: DataFrame, name: str = "name", candidate: str = "candidate",
                     threshold: float = 0.72, measure: str = "edit", chunk: int = CHUNK_NAMES) -> DataFrame:
    """name, candidate, score, needs_manual_check: the best candidate of each distinct name.

    ``measure``: "edit" is one less the edit distance over the longer length, "sequence" the ratio of letters in matching
    blocks. Null candidates are left out; a null name has no candidate and no score. Ties take the first in order.
    """
    if measure not in ("edit", "sequence"):
        raise ValueError(f"unknown measure: {measure}")
    own = names.select(F.col(name).cast("string").alias("name")).distinct()
    options = candidates.select(F.col(candidate).cast("string").alias("candidate")).where("candidate is not null").distinct()
    n_options = options.count()
    known = own.where("name is not null")
    if measure == "edit" and n_options <= chunk:
        best = _all_in_row(known, options)
    else:
        known, options = cut_lineage(known), cut_lineage(options)
        guessed = cut_lineage(_first_guess(known, options, measure))
        found = [_by_words(guessed, options, measure)]
        weak = guessed
        if measure == "edit":
            pairs, weak = _by_pieces(guessed, options, n_options)
            weak = cut_lineage(weak)
            found.append(pairs)
        found.append(_by_counts(weak, options, weak.count(), n_options, measure))
        pairs = reduce(DataFrame.union, found).distinct()
        best = _best(pairs.withColumn("score", _score("name", "candidate", measure)).union(guessed.select("name", F.col("best").alias("candidate"), "score")))
    missing = own.where("name is null").select("name", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("best"))
    score = F.round("score", 6)
    return best.unionByName(missing).select(
        F.col("name").alias(name), F.col("best").alias(candidate), score.alias("score"), (score < threshold).alias("needs_manual_check"),
    )
