"""Token ids of whole texts, by the ``tokenizers`` library and a vocabulary file."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "\x01"
BLANKS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_END = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]\z"
CACHE_PIECES = 600_000
"""Pieces in each of two generations that a worker remembers (speed only, not results)."""
JOINED = 5_000
SLICE_BYTES = 12 << 20
"""Bytes of text that are encoded in one go; a longer text is encoded by itself."""


def parts_of(column: pa.Array, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """So many bytes of each string from its start on."""
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column)] + starts
    ends = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[np.repeat(first - ends[:-1], lengths) + np.arange(ends[-1])]
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(ends), pa.py_buffer(data))


class Pieces:
    """Known pieces of text and their ids, end to end."""

    def __init__(self):
        self.names = pa.array([""], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(2, np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Add pieces and return their places."""
        first = len(self.names)
        self.names = pa.concat_arrays([self.names, names])
        self.ids = np.concatenate((self.ids, ids))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(lengths)))
        return np.arange(first, len(self.names))

    def find(self, names: pa.Array) -> np.ndarray:
        """Places of these pieces; -1 if unknown."""
        return pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places, end to end, and the number of each."""
        starts = self.bounds[at]
        lengths = self.bounds[at + 1] - starts
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class Encoder:
    """Encode texts piece by piece and remember the ids of pieces already seen.

    The byte-level pre-tokenizer always cuts before a single space and around a
    single line feed, so ids of a text are the ids of those pieces in turn.
    Texts with three blanks in a row, or two at the end, or the string of a
    special token, are encoded in one go, because there its rules look across
    the cut.

    Strings of special tokens in a text become those tokens, as the library does
    by itself; with ``ordinary`` they are text like any other.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join((f"[{BLANKS}]{{3}}", f"[{BLANKS}]{{2}}\\z", MARK, *special))
        vocabulary = self.tokenizer.get_vocab()
        # In this vocabulary a character of a token is a byte of the text.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        self.known, self.older = Pieces(), Pieces()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.array([len(x) for x in found], np.int64)

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without a blank but for a space at the start, many to a call.

        The others are put after a line feed, whose id is left out.
        """
        fed = pc.invert(pc.starts_with(words, " "))
        feed, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        column = pc.if_else(fed, pc.binary_join_element_wise(feed, words, nothing), words)
        bounds = np.frombuffer(column.buffers()[1], np.int64)[: len(words) + 1]
        data = memoryview(column.buffers()[2])
        cuts = [*range(0, len(words), JOINED), len(words)]
        ids, _ = self._library([str(data[bounds[i] : bounds[j]], "utf-8") for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        at = np.searchsorted(np.cumsum(self.widths[ids]), bounds[1:]) + 1
        first = np.concatenate(([0], at[:-1]))
        fed = fed.to_numpy(zero_copy_only=False)
        return np.delete(ids, first[fed]), at - first - fed

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Look up new pieces and return their places.

        Punctuation that ends a word is a piece by itself, as the pre-tokenizer cuts there.
        """
        known = self.known
        bases = pc.ascii_rtrim(pieces, characters=PUNCTUATION)
        size, whole = (pc.binary_length(x).to_numpy() for x in (bases, pieces))
        parted = (size < whole) & pc.match_substring_regex(bases, WORD_END).to_numpy(zero_copy_only=False)
        bases = pc.if_else(pa.array(parted), bases, pieces)
        two = pieces.filter(pa.array(parted))
        tails = parts_of(two, size[parted], (whole - size)[parted])
        coded = pa.concat_arrays([bases, tails]).dictionary_encode()
        fresh, code = coded.dictionary, coded.indices.to_numpy()
        place = known.find(fresh)
        plain = pc.match_substring_regex(fresh, rf"\A ?[^{BLANKS}]+\z").to_numpy(zero_copy_only=False)
        for at, how in ((np.flatnonzero((place < 0) & plain), self._joined), (np.flatnonzero((place < 0) & ~plain), lambda x: self._library(x.to_pylist()))):
            if len(at):
                some = fresh.take(pa.array(at))
                place[at] = known.add(some, *how(some))
        out = place[code[: len(pieces)]]
        if len(two):
            ids, lengths = known.get(np.stack((out[parted], place[code[len(pieces) :]]), axis=1).ravel())
            out[parted] = known.add(two, ids, lengths[::2] + lengths[1::2])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of an Arrow array, end to end, and their bounds; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, self.whole)
        cut = pc.if_else(whole, "", texts) if pc.any(whole).as_py() else texts
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(cut, " ", MARK + " "), "\n", MARK + "\n" + MARK), MARK)
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary
        place = self.known.find(names)
        if (place < 0).any():
            if len(self.known.names) > CACHE_PIECES:
                # The generation before goes; what this call needs of the current one is taken over.
                self.older, self.known = self.known, Pieces()
                place = self.known.find(names)
            at = np.flatnonzero(place < 0)
            new = names.take(pa.array(at))
            older = self.older.find(new)
            again = older >= 0
            place[at[again]] = self.known.add(new.filter(pa.array(again)), *self.older.get(older[again]))
            place[at[~again]] = self._learn(new.filter(pa.array(~again)))
        ids, lengths = self.known.get(place[coded.indices.to_numpy()])
        bounds = np.concatenate(([0], np.cumsum(lengths)))[cut.offsets.to_numpy()]
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(at):
            parts = np.split(ids, bounds[1:-1])
            for i in at:
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, bounds


def ended(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds with an end id after each text."""
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))


@lru_cache(maxsize=4)
def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path, ordinary)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of one of the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)
