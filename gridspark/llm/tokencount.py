"""Token counts of a sentencepiece BPE model by a deterministic transducer.

Greedy pair merging has a local law: a row of tokens is the model's own cut if and only if every two neighbours are the
model's cut of their joined text. So the last token of a prefix is the one token that ends it, is reached by merging alone
and agrees with the last token of what is before it. What later characters can still change are the suffixes that are a
proper beginning of some token; the state is the list of those suffixes, with the token before each and how many tokens
fewer the text had there. There are finitely many such states, so this is a deterministic transducer: reading a character
leads to one state, and the transition carries the change of the token count (it may be negative).

States and transitions are compiled when first met and kept by the task; the table is emptied when full, which changes no
count. Long texts are cut into chunks. A chunk's state map (entry state -> exit state and count) is kept as its head, the
characters up to the first place where every entry state leads to the same state, and a constant for the rest; composing
two maps gives a map of the same form, so a prefix scan over a document's chunk maps gives its count."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Where a word begins: every entry state leads to the start state there (checked when a model is compiled).
RESET = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_COMPILED: dict[str, Transducer] = {}
#: Texts on which a compiled model must agree with the library; fixed.
PROBES = ("", " ", "a", " a  b\tc\nd  ", "   ", SPACE, "ab　cｆé é ﬁ \U0001f600<s>\x00", "<0x41> <unk> </s>", "aaaaaaaaaaaaaaa", "The quick   brown-fox, 12345!")


class _State(dict):
    """Transitions by character: (next state, change of the count). ``live``: (suffix, token before it, tokens fewer there)."""

    def __init__(self, machine: Transducer, live: tuple):
        super().__init__()
        self.machine, self.live = machine, live

    def __missing__(self, letter: str) -> tuple[_State, int]:
        return self.machine.compile(self, letter)


class Transducer:
    def __init__(self, path: str, max_transitions: int = 1_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if sum(model.is_byte(i) for i in range(size)) != 256:
            raise ValueError("the model has no byte fallback")
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("the model has tokens that span the beginning of a word")
        self.begins = {p[:n] for p in self.score for n in range(1, len(p))}
        self.bigrams = {p[n : n + 2] for p in self.score for n in range(len(p) - 1)}
        self.inner = {b[0] for b in self.bigrams}
        self.reached: dict[str, bool] = {}
        self.agrees: dict[tuple[str, str], bool] = {}
        self.max_transitions = max_transitions
        self.clear()
        for text in PROBES:
            if self.count(text) != len(model.encode(text)):
                raise ValueError("the model normalises its input in a way that is not supported")

    def clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.transitions = 0
        self.reached.clear()
        self.agrees.clear()
        self.start = self.state((("", None, 0),))

    def state(self, live: tuple) -> _State:
        if live not in self.states:
            self.states[live] = _State(self, live)
        return self.states[live]

    def merged(self, text: str) -> list[str]:
        """The model's cut of a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max((self.score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if score == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def ends(self, before: str | None, token: str) -> bool:
        """Whether ``token`` can follow ``before``."""
        if token not in self.reached:
            self.reached[token] = (token in self.score or len(token) == 1) and self.merged(token) == [token]
        if before is None or not self.reached[token]:
            return self.reached[token]
        if (before, token) not in self.agrees:
            self.agrees[before, token] = self.merged(before + token) == [before, token]
        return self.agrees[before, token]

    def compile(self, state: _State, letter: str) -> tuple[_State, int]:
        found = [(s + letter, fewer) for s, before, fewer in state.live if self.ends(self.near(before, s + letter), s + letter)]
        if len(found) != 1:
            raise AssertionError("the model's merges do not follow the local law")
        token, fewer = found[0]
        change = (1 if token in self.score else len(token.encode())) - fewer
        live = [(s + letter, self.near(before, s + letter), fewer + change) for s, before, fewer in state.live if s + letter in self.begins]
        step = self.state((*live, ("", token if letter in self.inner else None, 0))), change
        state[letter] = step
        self.transitions += 1
        return step

    def near(self, before: str | None, suffix: str) -> str | None:
        """The token before a suffix, or None where no token spans their border, so that any pair agrees."""
        return before if before is not None and before[-1] + suffix[0] in self.bigrams else None

    def run(self, state: _State, text: str) -> tuple[_State, int]:
        n = 0
        for letter in text:
            state, change = state[letter]
            n += change
        return state, n

    def trim(self) -> None:
        """Empty a full table; between chunks no state is held but by its suffixes."""
        if self.transitions >= self.max_transitions:
            self.clear()

    def count(self, text: str) -> int:
        return self.run(self.start, SPACE + text.replace(" ", SPACE))[1] if text else 0

    def chunk_map(self, text: str) -> tuple[str, int, tuple | None]:
        """(head, tokens after it, exit state); without a place where all states meet, all is head."""
        found = RESET.search(text)
        if found is None:
            return text, 0, None
        state, n = self.run(self.start, text[found.start() :])
        return text[: found.start()], n, state.live

    def compose(self, a: tuple[str, int, tuple | None], b: tuple[str, int, tuple | None]) -> tuple[str, int, tuple | None]:
        """First ``a``, then ``b``; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(self.state(a[2]), b[0])
        return a[0], a[1] + n + b[1], (state.live if b[2] is None else b[2])


def transducer(path: str) -> Transducer:
    """The transducer of this Python worker, which keeps its states from task to task."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks for every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty: no bytes, no tokens. Rows that repeat a doc_id are counted one by one; an empty table gives none."""
    pieces = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "_row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.posexplode_outer(F.when(F.length("text") > chunk, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).otherwise(F.array("text"))).alias("_at", "_piece"),
    )

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            heads, counts, exits = [], [], []
            for at, piece in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
                text = piece.as_py().replace(" ", SPACE)
                machine.trim()
                if at == 0:
                    state, n = machine.run(machine.start, SPACE + text) if text else (machine.start, 0)
                    head, live = "", state.live
                else:
                    head, n, live = machine.chunk_map(text)
                heads.append(head)
                counts.append(n)
                exits.append(json.dumps(live) if live is not None and len(text) >= chunk else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(heads, pa.string()), pa.array(counts, pa.int64()), pa.array(exits, pa.string())], names=["_row", "doc_id", "n_bytes", "_at", "head", "count", "exit"])

    mapped = pieces.mapInArrow(maps, "_row long, doc_id long, n_bytes long, _at int, head string, count long, exit string")
    held = mapped.groupBy("_row", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("_at", "head", "count", "exit"))).alias("chunks"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            totals = []
            for chunks in batch.column(3):
                row = [(c["head"], c["count"], c["exit"]) for c in chunks.as_py()]
                if len(row) == 1:
                    totals.append(row[0][1])
                    continue
                level = [(h, n, None if e is None else _live(json.loads(e))) for h, n, e in row]
                while len(level) > 1:
                    machine.trim()
                    level = [machine.compose(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
                totals.append(level[0][1])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(totals, pa.int64()), pa.array([len(c) for c in batch.column(3)], pa.int32())], names=["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    return held.mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long, n_chunks int").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")


def _live(value: list) -> tuple:
    return tuple(tuple(x) for x in value)
