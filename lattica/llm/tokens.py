"""Token ids of whole texts from the tokenizers library.

The library is slow on running text and text repeats itself, so a text is cut
where the vocabulary's own pre-tokenizer always cuts, each distinct chunk is
encoded by the library once, and its ids are kept for later tasks of the worker,
up to a fixed number of bytes. ``tests/llm`` holds the ids against the library's
for whole texts.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkit

#: Bytes of text that are split and told apart at once.
PORTION_BYTES = 4 << 20
#: What Python's objects and dictionary take for a chunk, and for a pre-token, beside their bytes.
_CHUNK_BYTES, _PIECE_BYTES = 150, 200
#: New chunks that are cut into pre-tokens in one pass.
_TOGETHER = 8192
#: Letters and digits up to U+00FF as the vocabularies' patterns class them.
_L, _N = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_PIECES = {
    "words": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"),
    "spaces": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
}
#: Chunks with such characters (combining marks, separators that libraries class differently, special tokens) go to the library whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ÿ]*")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The byte-level alphabet: a printed byte stands for itself, the others for the characters from U+0100 on; plain text has no zero byte, which stays and parts pre-tokens.
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in set(_PRINTED))}
_MAPPED = np.array([_BYTES.get(b, b) if b else 0 for b in range(0x100)], "<u4")
_ODD_SPACE = re.compile(rb" [\x00-\x20\xc2\xe1-\xe3]| $")
_CUT = re.compile(rb" (?=[^\x00-\x20\xc2\xe1-\xe3])")


def _is_plain(chunk: str) -> bool:
    return _PLAIN.fullmatch(chunk) is not None and "<|" not in chunk


def _gathered(flat: array, ends: array, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the numbered parts one after the other, end of each part's ids)."""
    bounds = np.frombuffer(ends, np.int64)
    start, size = bounds[order], bounds[order + 1] - bounds[order]
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.uint32), total
    index = np.arange(total[-1]) + np.repeat(start - (total - size), size)
    return np.frombuffer(flat, np.uint32)[index], total


class Encoder:
    """cut: "words" for vocabularies that drop white space, "spaces" for byte-level ones that join a space to the next word, "whole" for any other."""

    def __init__(self, path: str, cut: str, keep_bytes: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.cut, self.half = cut, keep_bytes // 2  # for chunks, and for pre-tokens
        self.lower = cut == "words"
        if cut in _PIECES:
            self.find = re.compile(_PIECES[cut].pattern + "|\n").findall if self.lower else _PIECES[cut].findall
        self._clear_pieces()
        self._clear()

    def _clear(self) -> None:
        self.chunks: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        self.flat, self.ends = array("I"), array("q", [0])
        self.chunk_bytes = 0

    def _clear_pieces(self) -> None:
        """Pre-tokens: number of each, ids one after the other, their ends, and characters."""
        self.pieces: dict[str, int] = {}
        self.piece_flat, self.piece_ends = array("I"), array("q", [0])
        self.piece_size = array("q")
        self.piece_bytes = 0
        if self.lower:
            # what stands between the chunks of one pass
            self.pieces["\n"] = 0
            self.piece_ends.append(0)
            self.piece_size.append(1)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pre-tokens one after the other, number of ids of each), straight from the library's model."""
        data = np.frombuffer("\0".join(pieces).encode(), np.uint8)
        mapped = _MAPPED[data].tobytes().decode("utf-32-le").split("\0")
        made = [[t.id for t in tokens] for tokens in map(self.model.tokenize, mapped)]
        return np.array(list(itertools.chain.from_iterable(made)), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def _numbers(self, found: list[str]) -> np.ndarray:
        """The numbers of the pre-tokens; new ones are encoded."""
        if self.piece_bytes > self.half:
            self._clear_pieces()
        known = self.pieces
        numbers = list(map(known.get, found))
        if None in numbers:
            new = list(dict.fromkeys(p for p, n in zip(found, numbers, strict=True) if n is None))
            ids, count = self._encoded(new)
            known.update(zip(new, range(len(self.piece_size), len(self.piece_size) + len(new)), strict=True))
            size = np.fromiter(map(len, new), np.int64, len(new))
            self.piece_ends.frombytes((len(self.piece_flat) + np.cumsum(count)).tobytes())
            self.piece_flat.frombytes(ids.tobytes())
            self.piece_size.frombytes(size.tobytes())
            self.piece_bytes += int(size.sum()) + 4 * len(ids) + _PIECE_BYTES * len(new)
            numbers = list(map(known.__getitem__, found))
        return np.array(numbers, np.int64)

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of all chunks one after the other, number of ids of each), of plain chunks that are cut in one pass; None if their edges can't be told."""
        joined = "\n".join([*chunks, ""]) if self.lower else "".join(chunks)
        numbers = self._numbers(self.find(joined.lower() if self.lower else joined))
        ends = np.cumsum(np.frombuffer(self.piece_size, np.int64)[numbers])
        want = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + self.lower)
        last = np.searchsorted(ends, want)
        if not len(ends) or last[-1] >= len(ends) or (ends[last] != want).any():
            return None
        total = _gathered(self.piece_flat, self.piece_ends, numbers)
        return total[0], np.diff(total[1][last], prepend=0)

    def _alone(self, chunk: str) -> np.ndarray:
        if not _is_plain(chunk):
            return np.array(self.library.encode(chunk, add_special_tokens=False).ids, np.uint32)
        numbers = self._numbers(self.find(chunk.lower() if self.lower else chunk))
        return _gathered(self.piece_flat, self.piece_ends, numbers)[0]

    def _learn(self, missing: list[bytes], known: dict[bytes, int], lead: str) -> None:
        for lo in range(0, len(missing), _TOGETHER):
            part, before = missing[lo : lo + _TOGETHER], len(self.flat)
            chunks = [lead + c for c in map(bytes.decode, part)]
            # a chunk that starts with a space of its own may grow together with the one before it
            plain = [m[:1] > b" " for m in part]
            if not _is_plain("".join(chunks)):
                plain = [ok and _is_plain(c) for ok, c in zip(plain, chunks, strict=True)]
            done = self._together(list(itertools.compress(chunks, plain))) if any(plain) and (lead or self.lower) else None
            if done is None:
                plain = [False] * len(part)
            else:
                ids, size = done
                known.update(zip(itertools.compress(part, plain), range(len(self.ends) - 1, len(self.ends) - 1 + len(size)), strict=True))
                self.ends.frombytes((len(self.flat) + np.cumsum(size)).tobytes())
                self.flat.frombytes(ids.tobytes())
            for m, chunk, ok in zip(part, chunks, plain, strict=True):
                if not ok:
                    known[m] = len(self.ends) - 1
                    self.flat.frombytes(self._alone(chunk).tobytes())
                    self.ends.append(len(self.flat))
            self.chunk_bytes += sum(map(len, part)) + _CHUNK_BYTES * len(part) + 4 * (len(self.flat) - before)

    def _indexes(self, parts: list[bytes], which: int) -> list[int]:
        known = self.chunks[which]
        found = list(map(known.get, parts))
        if None in found:
            self._learn(list(dict.fromkeys(p for p, i in zip(parts, found, strict=True) if i is None)), known, " " * which)
            found = list(map(known.__getitem__, parts))
        return found

    def ids(self, text: str) -> np.ndarray:
        """The text's ids as uint32; empty for an empty text."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.cut == "whole":
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.chunk_bytes > self.half:
            self._clear()
        data = text.encode()
        if self.cut == "words":
            # the vocabulary is lower-case; special tokens are told apart by case
            order = self._indexes((data if b"<|" in data else data.lower()).split(), 0)
        else:
            parts = _CUT.split(data) if _ODD_SPACE.search(data) else data.split(b" ")
            lead = parts[0] == b"" and len(parts) > 1
            order = ([] if lead else self._indexes(parts[:1], 0)) + self._indexes(parts[1:], 1)
        return _gathered(self.flat, self.ends, np.array(order, np.int64))[0]

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """``ids`` of each text (null: empty); chunks are split and told apart for all texts at once, so they should be some megabytes at most."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.cut == "whole":
            return [self.ids(t) for t in texts.to_pylist()]
        slow = pc.match_substring(texts, "<|")
        if self.cut == "spaces":
            slow = pc.or_(slow, pc.match_substring_regex(texts, "(?s) [\\x00-\\x20\\x{80}-\\x{bf}\\x{1000}-\\x{3fff}]| $"))
        slow = slow.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(slow).tolist():
            out[i] = self.ids(texts[i].as_py())
        plain = np.flatnonzero(~slow)
        for i, ids in zip(plain.tolist(), self._slice(texts.take(pa.array(plain))), strict=True):
            out[i] = ids
        return out

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        if self.chunk_bytes > self.half:
            self._clear()
        words = self.cut == "words"
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts)) if words else pc.split_pattern(texts, " ")
        flat, bounds = lists.flatten().cast(pa.large_binary()), lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        known = np.array(self._indexes(coded.dictionary.to_pylist(), 0 if words else 1), np.int64)
        order = known[coded.indices.to_numpy()]
        if not words:
            order[bounds[:-1]] = self._indexes(flat.take(pa.array(bounds[:-1])).to_pylist(), 0)
        ids, ends = _gathered(self.flat, self.ends, order)
        ends = np.concatenate([[0], ends])[bounds]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encoded(batches: Iterator[pa.RecordBatch], encode: Callable[[pa.Array], list[np.ndarray]]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in portions with the ids of their texts (``many`` of an encoder). Larger portions share more chunks; memory is given back after each batch."""
    for batch in batches:
        for portion in textkit.portions(batch, PORTION_BYTES):
            yield portion, encode(portion.column("text"))
        textkit.give_back()


@functools.lru_cache(maxsize=4)
def encoder(path: str, cut: str) -> Encoder:
    """One per worker process."""
    return Encoder(path, cut)
