"""Periodic runs of words by a dictionary of basic factors.

Basic factors are the stretches of 2^k words. Level by level each gets a number, its name, from the names of its two halves;
a factor that occurs once in its document can't be part of a longer one that repeats and is left out from there on. Two
neighbouring occurrences of a factor that lie in a window of twice its length (at a distance d of at most 2^k) make 2^k + d
words with period d, and d is their smallest period, or the factor would have come again sooner. Occurrences at d from
successive positions form a progression; it starts and ends where the run does, so its ends are the run extended as far as
it goes. A period is taken at the one level whose length it fits (2^(k-1) < d <= 2^k, all up to the first level's length at
the first), so no run is found twice, and a run of three periods or more is found at that level.

The documents of a batch are handled together in one array, names never cross a document's end, and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a group of documents handled in one array; a longer document is a group of its own.
GROUP_WORDS = 1 << 17
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbers(words: list[bytes]) -> np.ndarray:
    """Words as the numbers of their first occurrences."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def periodic_runs(documents: list[np.ndarray], least: int = 24, exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """For each array of word numbers its runs (start, length, period), by start, then period: the maximal stretches whose
    smallest period is q and whose length is at least max(``least``, ``exponent`` * q). ``exponent`` is at least 3."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    total = int(sizes.sum())
    if not total or int(sizes.max()) < least:
        return out
    ends = np.cumsum(sizes)
    shift = np.cumsum([0, *[int(d.max()) + 1 if len(d) else 0 for d in documents[:-1]]])
    name = np.concatenate([d + s for d, s in zip(documents, shift, strict=True)])  # equal words of two documents differ
    end = np.repeat(ends, sizes)
    # The first level is the longest of 2^k whose length and period together fit the shortest run.
    first = max(0, (least // exponent).bit_length() - 1)
    at, k = np.arange(total), 0
    found = []
    while True:
        at, name, order = _repeated(at, name)
        if not len(at):
            break
        if k >= first:
            same = name[order[1:]] == name[order[:-1]]
            where, gap = at[order[:-1]][same], np.diff(at[order])[same]
            low = 0 if k == first else 1 << (k - 1)
            fits = (gap > low) & (gap <= 1 << k)
            found.append(_progressions(where[fits], gap[fits], 1 << k, total))
        there = np.full(total + (1 << k), -1, dtype=np.int64)
        there[at] = name
        right = there[at + (1 << k)]
        whole = (right >= 0) & (at + (2 << k) <= end[at])
        at, name, k = at[whole], name[whole] * (int(name.max()) + 1) + right[whole], k + 1
        if not len(at):
            break
    starts, lengths, periods = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))
    long = lengths >= np.maximum(least, exponent * periods)
    starts, lengths, periods = starts[long], lengths[long], periods[long]
    owner = np.searchsorted(ends, starts, side="right")
    for i in np.lexsort((periods, starts)).tolist():
        d = int(owner[i])
        out[d].append((int(starts[i] - ends[d] + sizes[d]), int(lengths[i]), int(periods[i])))
    return out


def _repeated(at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose code occurs twice or more, dense names for their codes, and the order by (name, position)."""
    order = np.argsort(code, kind="stable")
    own = code[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    last = np.ones(len(own), dtype=bool)
    last[:-1] = new[1:]
    name = np.empty(len(own), dtype=np.int64)
    name[order] = np.cumsum(new) - 1
    keep = np.empty(len(own), dtype=bool)
    keep[order] = ~(new & last)
    place = np.cumsum(keep) - 1
    return at[keep], name[keep], place[order][keep[order]]


def _progressions(where: np.ndarray, gap: np.ndarray, size: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, period of each progression: positions in succession whose factor comes again after the same gap."""
    key = np.sort(gap * (total + 1) + where)
    cut = np.flatnonzero(np.diff(key) != 1)
    head, tail = key[np.concatenate([[0], cut + 1]).astype(np.int64)[: len(key)]], key[np.concatenate([cut, [len(key) - 1]]).astype(np.int64)[: len(key)]]
    return head % (total + 1), tail - head + size + head // (total + 1), head // (total + 1)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, for some doc_ids with a period planted from one of them on."""
    h = crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def _row(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    kept = words
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    best: tuple = (None, None, None, None)
    if runs:
        start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())


def _scan(plant: bool, least: int, exponent: int):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]

    def rows(group: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        runs = periodic_runs([numbers(w) for _, w in group], least, exponent)
        columns = zip(*[_row(i, w, r) for (i, w), r in zip(group, runs, strict=True)], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                i = doc_id.as_py()
                # bytes.split() cuts at the six ASCII blanks and nowhere else
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if plant:
                    words = planted(words, i)
                if group and size + len(words) > GROUP_WORDS:
                    yield rows(group)
                    group, size = [], 0
                group.append((i, words))
                size += len(words) + 1
        if group:
            yield rows(group)

    return run


def find_runs(docs: DataFrame, plant: bool = False, least: int = 24, exponent: int = 3) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text; other columns are ignored), with its runs of words.

    A run is a stretch of words with smallest period q and a length of at least max(``least``, ``exponent`` * q) that can't
    be longer on either side. start, length, period, exponent_milli describe the run of the greatest exact length / period
    (ties: least start, then period) and are null without a run; runs_sha256 is over all runs, collapsed_sha256 over the text
    whose runs keep their first period only. Null and empty texts have no word, no run and the hashes of nothing. Repeated
    rows and null doc_ids each give their own row; an empty table gives none. A text is handled whole, by one task, in memory
    of a fixed number of bytes a word. ``plant`` makes the words of some documents periodic before, by their doc_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scan(plant, least, exponent), SCHEMA)
