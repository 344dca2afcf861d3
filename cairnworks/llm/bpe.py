"""Byte-pair encoding of whole texts by rank arrays, and decoding.

A pre-token is held as its parts and, beside them, one contiguous array with the rank of every two
neighbours. The smallest rank is looked up by a scan, its boundary is deleted, and the ranks left
and right of it are read anew, until no neighbours have one. A scan of a short word is a few
steps; long runs without a boundary, for which scans would take quadratic time, keep the same ranks in a
heap over a linked list and merge in the same order.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.batches import by_bytes, map_batches
from cairnworks.llm.columns import whole_text
from cairnworks.llm.tokens import LOOKUP_BYTES, IdEncoder, load, whole_ids

#: Parts of the longest word that is scanned.
SHORT = 64
#: Rank of neighbours that no merge joins.
NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies of byte-level tokenizers: printable Latin-1 bytes are themselves, others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class RankTable:
    """Merges of a .json file of byte-level BPE: ``ranks`` gives rank and merged id of two ids as one number, ordered by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"no plain byte-pair encoding: {model['type']} {odd}")
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank << 32 | vocab[a + b]
        self.specials = {x["content"]: x["id"] for x in told["added_tokens"]}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in told["added_tokens"]):
            raise ValueError("added tokens that depend on what stands around them")
        size = max([*vocab.values(), *self.specials.values()], default=-1) + 1
        self.strings = [""] * size
        for token, i in (vocab | self.specials).items():
            self.strings[i] = token

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token, given as its bytes."""
        if not data:
            return []
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank = self.ranks.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            parts[at] = least & 0xFFFFFFFF
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NEVER)
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NEVER)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank, n = self.ranks.get, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)] + [NEVER]
        heap = [(r, k) for k, r in enumerate(ranks) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            least, at = heapq.heappop(heap)
            if ranks[at] != least:  # was joined or has other neighbours by now
                continue
            gone = after[at]
            parts[at], parts[gone], ranks[gone] = least & 0xFFFFFFFF, -1, NEVER
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            for k in (before[at], at):
                if k >= 0:
                    ranks[k] = rank((parts[k], parts[after[k]]), NEVER) if after[k] < n else NEVER
                    if ranks[k] != NEVER:
                        heapq.heappush(heap, (ranks[k], k))
        return [p for p in parts if p >= 0]


@lru_cache(maxsize=2)
def rank_table(path: str) -> RankTable:
    return RankTable(path)


class RankEncoder(IdEncoder):
    """Ids of whole texts as the tokenizers library gives them, merged by :class:`RankTable`.

    The library only normalises and cuts texts that hold uncommon characters or special strings; Arrow does
    so for all others. Distinct pre-tokens are encoded once and looked up from then on.
    """

    def __init__(self, tokenizer: str):
        self.table = rank_table(tokenizer)
        self.special = re.compile("|".join(map(re.escape, sorted(self.table.specials, key=len, reverse=True))) or "(?!)")
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        super().__init__(tokenizer)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = array("I"), np.zeros(len(words), np.int64)
        for k, word in enumerate(words):
            found = self.table.word(word.encode())
            ids.extend(found)
            lengths[k] = len(found)
        return np.frombuffer(ids.tobytes(), "<u4"), lengths

    def _library(self, texts: list[str]) -> list[bytes]:
        """Texts whole: special strings as they stand, what lies between them normalised and cut by the library's own parts."""
        out = []
        for text in texts:
            ids, first = array("I"), 0
            for m in [*self.special.finditer(text), None]:
                between = text[first : m.start() if m else len(text)]
                if between:
                    normal = self.model.normalizer.normalize_str(between) if self.model.normalizer else between
                    for word, _ in self.model.pre_tokenizer.pre_tokenize_str(normal):
                        ids.extend(self.table.word(bytes(map(self.byte_of.__getitem__, word))))
                if m:
                    ids.append(self.table.specials[m[0]])
                    first = m.end()
            out.append(ids.tobytes())
        return out


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids), one for each input row: the whole text's token ids, without added special tokens.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library; special strings in a text become their
    ids, as is the library's default. Null counts as empty and has no ids; ids of documents pass through
    unread, nulls and repeats included; other columns are not read; an empty table gives an empty result. Long
    texts are cut before white space where the tokenizer drops it.
    """

    def make():
        encoder = RankEncoder(tokenizer)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, found = batch.column(1), []
            for first, end in by_bytes(texts, LOOKUP_BYTES):
                part = texts.slice(first, end - first).to_pylist()
                found += [whole_ids(encoder, part[0])] if len(part) == 1 else encoder.encode(part)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.array(np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], names=["doc_id", "ids"])

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t"))
    return map_batches(rows, make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with the column ``decoded``: the text the library decodes from the ids, special tokens kept.

    A file without a decoder gives the tokens' own strings with a space between, which Arrow joins; other
    files' ids go to the library's decoder. No ids, or null, give an empty text.
    """

    def make():
        model = load(tokenizer)[1]
        strings = pa.array(rank_table(tokenizer).strings)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            if model.decoder is None:
                words = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), strings.take(lists.flatten()))
                texts = pc.binary_join(words, " ")
            else:
                texts = pa.array(model.decode_batch(lists.to_pylist(), skip_special_tokens=False), pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "ids", "decoded"])

        return run

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, ids array<int>, decoded string")
