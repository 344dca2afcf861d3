"""Token counts and token ids under a public tokenizer file.

The tokenizer's path is a parameter; executors load the file once for each Python worker.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.batches import by_bytes, map_batches
from cairnworks.llm.columns import whole_text

#: Bytes of text encoded at a time, and characters of one piece of a long text.
BATCH_BYTES = 4 << 20
#: Bytes of text whose distinct words are looked up together.
LOOKUP_BYTES = 4 << 20
PIECE_CHARS = 1 << 18


@lru_cache(maxsize=2)
def load(path: str):
    """(kind, model) for a .json file of tokenizers or a .model file of sentencepiece."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return "sentencepiece", sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return "tokenizers", model


def drops_white_space(model) -> bool:
    """Whether white space never reaches the model, so that a text may be cut before any of it."""
    probe = "a b\n\tc  d e"
    alone = [i for word in probe.split() for i in model.encode(word, add_special_tokens=False).ids]
    return model.encode(probe, add_special_tokens=False).ids == alone


def pieces(text: str, most: int) -> Iterator[str]:
    """Cuts a long text before ASCII spaces or line ends that follow ``most`` characters; a text without any stays whole."""
    first = 0
    while len(text) - first > most:
        cut = re.compile(r"[ \n]").search(text, first + most)
        if not cut:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:] if first else text


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each input row.

    Whole texts are counted as the library gives them, without added tokens, truncation or
    padding; null counts as empty. Batches are balanced by bytes; of a tokenizer that drops white
    space only the distinct words of a batch are encoded (see :class:`IdEncoder`), and a text over
    ``PIECE_CHARS`` is cut before white space. Other tokenizers encode whole texts.
    Ids pass through unread, nulls and repeats included; other columns, whatever their names, are not
    read; an empty table gives an empty result.
    """

    def make():
        kind, model = load(tokenizer)
        encoder = IdEncoder(tokenizer) if kind == "tokenizers" else None
        safe, most = (True, LOOKUP_BYTES) if encoder and encoder.fast else (False, BATCH_BYTES)

        def lengths(texts: list[str]) -> list[int]:
            if kind == "sentencepiece":
                return [len(x) for x in model.encode(texts, num_threads=1)]
            return encoder.count(texts)

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            totals = np.zeros(batch.num_rows, np.int64)
            texts = batch.column(1)
            for first, end in by_bytes(texts, most):
                rows, parts, size = [], [], 0
                for row, text in enumerate(texts.slice(first, end - first).to_pylist(), first):
                    for part in pieces(text, PIECE_CHARS) if safe else (text,):
                        rows.append(row)
                        parts.append(part)
                        size += len(part)
                        if size > most:
                            np.add.at(totals, rows, lengths(parts))
                            rows, parts, size = [], [], 0
                if parts:
                    np.add.at(totals, rows, lengths(parts))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(totals), pa.array(totals > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

        return count

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t"))
    rows = rows.select("doc_id", "t", F.octet_length("t").cast("long").alias("n_bytes"))
    return map_batches(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


#: Text of these characters alone is its own NFC form, and every library agrees on its letters,
#: digits, white space and lower case (İ, whose lower case is two characters, is left out).
_PLAIN = "^[\t-\r\x20-~¡-įı-ɏ]*$"
#: The pre-tokenizer's pattern: contractions, runs of letters, single digits, runs of the rest.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \p{L}\p{N}]+"
#: Entries of a worker's table of encoded words; a full table is emptied.
CACHE_ENTRIES = 400_000


class IdEncoder:
    """Token ids of whole texts, for tokenizers that drop white space.

    Arrow lower-cases texts, splits them into pre-tokens and numbers the distinct ones; only
    pre-tokens not seen before reach the library, many to a call. Texts with uncommon characters
    or with something like a special token go to the library whole. ``fast`` is off for a
    tokenizer with another pre-tokenizer or that keeps white space; then all texts do.
    """

    def __init__(self, tokenizer: str):
        kind, self.model = load(tokenizer)
        if kind != "tokenizers":
            raise ValueError("ids come from a .json file of the tokenizers library")
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        vocab = self.model.get_vocab()
        self.word_ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.word_ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self._forget()
        self.fast = drops_white_space(self.model)
        self.fast = self.fast and self._agrees()

    def _forget(self) -> None:
        """An empty table: words, and where each one's ids are in one array of ids."""
        self.words = pa.array([], pa.large_string())
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _agrees(self) -> bool:
        """Whether words give what whole texts give, for every common character among others."""
        texts = [f"a{c}b {c}{c} 1{c}\n{c}A'{c}" for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)])]
        texts += ["it's we'll I'd 'RE 42nd x_y a1b2 café ½²", "".join(map(chr, range(0x20, 0x7F)))]
        return [x.tobytes() for x in self.encode(texts)] == self._library(texts)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another, and the number of each.

        All go in long texts, cut after the ids that end a word; one by one where that can't be.
        """
        texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
        ids = np.frombuffer(b"".join(self._library(texts)), "<u4")
        ends = np.flatnonzero(self.word_ends[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            return ids, np.diff(ends, prepend=0)
        each = self._library(words)
        return np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) >> 2

    def _look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words as places in the table, and each text's last place among them."""
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), _WORDS, r"\0 ")
        lists = pc.ascii_split_whitespace(apart)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        known = pc.index_in(distinct, value_set=self.words)
        if len(self.words) + known.null_count > CACHE_ENTRIES:
            self._forget()
            known = pc.index_in(distinct, value_set=self.words)
        place = known.fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            fresh = distinct.take(pa.array(missing))
            ids, lengths = self._encode_words(fresh.to_pylist())
            place[missing] = len(self.words) + np.arange(len(missing))
            self.words = pa.concat_arrays([self.words, fresh])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
        return place[coded.indices.to_numpy()], lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Whether each text may go word by word."""
        if not self.fast:
            return np.zeros(len(texts), bool)
        special = pc.match_substring(texts, "<|")
        return pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.invert(special)).to_numpy(zero_copy_only=False)

    def count(self, texts: list[str]) -> list[int]:
        """Numbers of ids, without putting the ids together."""
        held = pa.array(texts, pa.large_string())
        plain = self._plain(held)
        out = np.zeros(len(texts), np.int64)
        if plain.any():
            at, ends = self._look_up(held.filter(pa.array(plain)))
            out[plain] = np.diff(np.concatenate([[0], np.cumsum(self.lengths[at])])[np.concatenate([[0], ends])])
        rest = np.flatnonzero(~plain)
        out[rest] = [len(x) for x in self.model.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)]
        return out.tolist()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Arrays of little-endian unsigned 32-bit ids, one for each text."""
        held = pa.array(texts, pa.large_string())
        plain = self._plain(held)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        if plain.any():
            at, ends = self._look_up(held.filter(pa.array(plain)))
            n = self.lengths[at]
            after = np.cumsum(n)
            all_ids = self.ids[np.repeat(self.starts[at] - (after - n), n) + np.arange(after[-1] if len(after) else 0)]
            bounds = np.concatenate([[0], after])[ends]
            for k, part in zip(np.flatnonzero(plain), np.split(all_ids, bounds[:-1]), strict=True):
                out[k] = part
        rest = np.flatnonzero(~plain)
        for k, part in zip(rest, self._library([texts[k] for k in rest]), strict=True):
            out[k] = np.frombuffer(part, "<u4")
        return out


def whole_ids(encoder: IdEncoder, text: str) -> np.ndarray:
    """Ids of one text of any length, encoded in pieces where that is safe."""
    parts = pieces(text, PIECE_CHARS) if encoder.fast else (text,)
    return np.concatenate([encoder.encode([part])[0] for part in parts])
