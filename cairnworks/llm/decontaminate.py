"""Benchmark decontamination with one Aho-Corasick automaton.

Test items become windows of consecutive normalised words; all windows are the keys of one automaton
over word numbers (``word_automaton``). Each text is normalised and scanned once, many texts side
by side; a match's end tells which words it covers, and word offsets lead back to the original
text. The automaton is built once on the driver and broadcast; its size follows the benchmark, not
the corpus: some 40 bytes for a character of benchmark text. Beyond ``MOST_CHARS`` of window text
(a benchmark of about 12 MB) the items are dealt into groups with an automaton each; a task then
takes its texts in slices past one automaton after the other, so that it holds one at a time and
still reads its input once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.batches import by_bytes, map_arrow, map_batches
from cairnworks.llm.columns import whole_text
from cairnworks.llm.word_automaton import WordAutomaton, build, scan

WINDOW_WORDS = 13
#: Characters of window text in one automaton (about 3 bytes of memory each).
MOST_CHARS = 160_000_000
#: Bytes of text scanned at a time, and taken past each of several automata.
SLICE_BYTES = 4 << 20
GROUP_SLICE_BYTES = 32 << 20

#: A-Z to lower case; other ASCII bytes that are not digits or letters to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def text_hits(texts: list[bytes], a: WordAutomaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int]]]:
    """Of each text: the number of words, hit words [first, end) as rows (text, first, end), and the owners of windows found."""
    n_words, numbers = np.zeros(len(texts), np.int64), []
    known = a.vocabulary.get
    for row, text in enumerate(texts):
        words = normal_words(text)
        n_words[row] = len(words)
        numbers.append(np.fromiter(map(known, words, repeat(0)), np.int64, len(words)))
        numbers.append(np.zeros(1, np.int64))  # between texts
    found: list[set[int]] = [set() for _ in texts]
    none = np.zeros((0, 3), np.int64)
    if not texts or a.longest < 1:
        return n_words, np.zeros(len(texts), np.int64), none, found
    stream = np.concatenate(numbers)
    last, nodes = scan(a, stream)
    if not len(last):
        return n_words, np.zeros(len(texts), np.int64), none, found
    starts = np.concatenate([[0], np.cumsum(n_words + 1)])
    text_of = np.searchsorted(starts, last, side="right") - 1
    at, owners = a.owned(nodes)
    for row, owner in np.unique(np.stack([text_of[at], owners], axis=1), axis=0).tolist():
        found[row].add(owner)
    marks = np.zeros(len(stream) + 1, np.int64)
    np.add.at(marks, last - a.sizes(nodes) + 1, 1)
    np.add.at(marks, last + 1, -1)
    edge = np.diff(np.concatenate([[0], np.cumsum(marks)[:-1] > 0, [0]]).astype(np.int8))
    first, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    row = np.searchsorted(starts, first, side="right") - 1
    runs = np.stack([row, first - starts[row], end - starts[row]], axis=1)
    return n_words, np.bincount(row, weights=end - first, minlength=len(texts)).astype(np.int64), runs, found


def _merged(runs: np.ndarray) -> np.ndarray:
    """Rows (text, first, end), sorted, with overlapping or touching ones of a text joined."""
    out: list[list[int]] = []
    for row, first, end in runs[np.lexsort((runs[:, 1], runs[:, 0]))].tolist():
        if out and out[-1][0] == row and first <= out[-1][2]:
            out[-1][2] = max(end, out[-1][2])
        else:
            out.append([row, first, end])
    return np.array(out, np.int64).reshape(-1, 3)


class _Held:
    """Broadcast automata of all groups; a worker keeps one."""

    def __init__(self, broadcasts: list):
        self.broadcasts, self.token = broadcasts, uuid.uuid4().hex

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray, list[set[str]]]]:
        """(first row, texts, numbers of words, numbers of hit words, runs, items) of slices of a binary column."""
        alone = len(self.broadcasts) == 1
        for first, end in by_bytes(texts, SLICE_BYTES if alone else GROUP_SLICE_BYTES):
            part = texts.slice(first, end - first).to_pylist()
            n_words, n_hit, all_runs, items = np.zeros(0, np.int64), np.zeros(0, np.int64), [], [set() for _ in part]
            for k in range(len(self.broadcasts)):
                automaton, names = _automaton(self, k)
                n_words, n_hit, runs, found = text_hits(part, automaton)
                all_runs.append(runs)
                for held, owners in zip(items, found, strict=True):
                    held.update(names[o] for o in owners)
            runs = all_runs[0]
            if not alone:
                runs = _merged(np.concatenate(all_runs))
                n_hit = np.bincount(runs[:, 0], weights=runs[:, 2] - runs[:, 1], minlength=len(part)).astype(np.int64)
            yield first, part, n_words, n_hit, runs, items


_kept: dict[str, tuple] = {}


def _automaton(held: _Held, k: int) -> tuple[WordAutomaton, list[str]]:
    """The k-th automaton and its owners' names; the worker's last one is kept, others are read from the broadcast's file."""
    key = f"{held.token}-{k}"
    if key not in _kept:
        _kept.clear()
        source = held.broadcasts[k]
        path = getattr(source, "_path", None)
        _kept[key] = source.load_from_path(path) if len(held.broadcasts) > 1 and path else source.value
    return _kept[key]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (start, end) in the original text of runs of words."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def _groups(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> list[DataFrame]:
    """Tables (id, t) of distinct items; each group's windows are about MOST_CHARS at most."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null").dropDuplicates()
    size = rows.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    n = -(-size * window // MOST_CHARS) or 1
    return [rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k) for k in range(n)] if n > 1 else [rows]


def _held(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> _Held:
    """Automata of bounded size, one for each group of items; an empty benchmark has an empty one."""
    broadcasts = []
    for group in _groups(benchmark, window, item_col, text_col):
        rows = group.collect()  # a group of bounded size
        names = sorted({r["id"] for r in rows})
        place = {name: k for k, name in enumerate(names)}
        automaton = build([(normal_words(r["t"].encode()), place[r["id"]]) for r in rows], window)
        broadcasts.append(benchmark.sparkSession.sparkContext.broadcast((automaton, names)))
    return _Held(broadcasts)


_RUNS = "array<struct<start:int,end:int>>"
_SCANNED = f"doc_id long, text_hash long, n_words long, n_hit long, items array<string>, runs {_RUNS}, spans {_RUNS}"


def _scan(texts: DataFrame, held: _Held) -> DataFrame:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def make():
        def scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_hit, items, places, spans = [], [], [], [], []
            for _, part, words, hit, runs, found in held.hits(batch.column(2).cast(pa.binary())):
                own: list[list[tuple[int, int]]] = [[] for _ in part]
                for row, a, b in runs.tolist():
                    own[row].append((a, b))
                n_words.append(words)
                n_hit.append(hit)
                items += [sorted(x) for x in found]
                places += [[{"start": a, "end": b} for a, b in x] for x in own]
                spans += [[{"start": a, "end": b} for a, b in original_spans(text.decode() if x else "", x)] for text, x in zip(part, own, strict=True)]
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_hit)), pa.array(items, pa.list_(pa.string())), pa.array(places, pa.list_(span)), pa.array(spans, pa.list_(span))],
                names=["doc_id", "text_hash", "n_words", "n_hit", "items", "runs", "spans"],
            )

        return scan_batch

    return map_batches(texts, make, _SCANNED)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, text_hash, n_words, n_hit, items, runs, spans), one for each input row.

    ``items`` are the ids, as sorted strings, of items with an occurring window; ``runs`` are hit
    words [start, end) and ``spans`` the code points of those stretches in the original text.
    Null or empty text has no words and no hits. Items without words or without an id match
    nothing; repeated items count once. Document ids pass through unread, nulls and repeats
    included; other columns are not read; an empty table on either side gives rows without hits,
    or none.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t")).select("doc_id", F.xxhash64("t").alias("text_hash"), "t")
    return _scan(texts, _held(benchmark, window, item_col, item_text_col))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The input rows, all columns, that are not contaminated; repeated rows stay repeated.

    Null and empty texts are clean. Rows are judged where they are read, so nothing is shuffled.
    """
    held = _held(benchmark, window, item_col, item_text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [(hit == 0) | (hit * 20 < words) for _, _, words, hit, _, _ in held.hits(batch.column(at).cast(pa.binary()).fill_null(b""))]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else [], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def item_digest(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)
