"""Byte-level BPE ids of many texts, with a cache of pieces between spaces."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

_MOST_PIECES = 400_000
#: Characters of texts that are cut into pieces at a time, and joined texts of 256 new pieces that the library gets at a time.
_TOGETHER, _BLOCK = 250_000, 16


class _Index(dict):
    """Piece -> its number; new pieces are noted. A text's first piece is kept under a leading space, which no other piece has."""

    def __missing__(self, piece: str) -> int:
        self[piece] = i = len(self)
        self.new.append(piece)
        return i


def _uneven(piece: str) -> bool:
    """Whether white space meets the space before or after the piece."""
    if piece[:1] == " ":
        return piece.rstrip() != piece and len(piece) > 1
    return not piece or piece.strip() != piece


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for the vocabulary as loaded, with add_special_tokens=False:
    a special token's string within a text is that token.

    A byte-level BPE starts a new word at a space between two characters that aren't white space, and no rule looks
    back across that place. So such texts are cut at their spaces, each distinct piece is encoded once by the tokenizers
    library, and ids are gathered from an array. Texts with more white space beside a space, or with a special token's
    string, go to the library whole. Beyond 400,000 pieces the later half is forgotten; that changes no result.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        added = self.model.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        # what parts pieces that are encoded in one text: the library cuts there before all else
        self.mark = next(((t.content, k) for k, t in sorted(added.items()) if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.index, self.ids = _Index(), np.zeros(0, self.dtype)
        self.index.new = []
        self.first, self.size, self.uneven = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without special tokens' strings, and the number of each text's."""
        if self.mark:
            text, mark = self.mark
            joined = [text.join(texts[a : a + 256]) for a in range(0, len(texts), 256)]
            ids = np.concatenate([np.array([*e, mark], np.int64) for a in range(0, len(joined), _BLOCK) for e in self._plain(joined[a : a + _BLOCK])])
            at = np.nonzero(ids == mark)[0]
            if len(at) == len(texts):
                return ids[ids != mark], np.diff(at, prepend=-1) - 1
        got = self._plain(texts)
        return np.fromiter(chain.from_iterable(got), np.int64), np.fromiter(map(len, got), np.int64, len(got))

    def _forget(self) -> None:
        n = _MOST_PIECES // 2
        kept = _Index(list(self.index.items())[:n])
        kept.new = []
        self.index = kept
        self.first, self.size, self.uneven = self.first[:n], self.size[:n], self.uneven[:n]
        self.ids = self.ids[: self.first[-1] + self.size[-1]].copy()

    def _learn(self) -> None:
        new = self.index.new
        if not new:
            return
        ids, size = self._marked([x[1:] if x[:1] == " " else " " + x for x in new])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.uneven = np.concatenate([self.uneven, np.fromiter(map(_uneven, new), bool, len(new))])
        self.ids = np.concatenate([self.ids, ids.astype(self.dtype)])
        self.index.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text's ids."""
        done = [self._together([texts[i] for i in part]) for part in slices(texts, _TOGETHER)]
        return np.concatenate([np.zeros(0, self.dtype), *(ids for ids, _ in done)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in done)])

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > _MOST_PIECES:
            self._forget()
        pieces: list[str] = []
        counts = []
        for t in texts:
            own = t.split(" ") if not any(x in t for x in self.special) else ["", ""]  # an empty piece: goes whole
            own[0] = " " + own[0]
            pieces += own
            counts.append(len(own))
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        size = self.size[at]
        ids = self.ids[np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        starts = np.cumsum(counts) - counts
        lengths = np.add.reduceat(size, starts)
        whole = np.nonzero(np.logical_or.reduceat(self.uneven[at], starts))[0].tolist()
        if whole:
            got = {k: np.array(x, self.dtype) for k, x in zip(whole, self._plain([texts[k] for k in whole]), strict=True)}
            ends = np.cumsum(lengths)
            ids = np.concatenate([got[k] if k in got else ids[ends[k] - lengths[k] : ends[k]] for k in range(len(texts))])
            lengths = np.array([len(got[k]) if k in got else n for k, n in enumerate(lengths)], np.int64)
        return ids, lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary; workers are used again."""
    return Encoder(path)


def forget() -> None:
    """Frees the encoder of a worker that now does other work: a worker holds one operator's caches at a time."""
    encoder.cache_clear()
    trim()


def trim() -> None:
    """Gives freed memory, Arrow's too, back to the system where the C library can: workers live on from operator to operator."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more id at each text's end."""
    out = np.insert(ids, np.cumsum(lengths), end) if len(lengths) else ids
    return out, lengths + 1


def runs(sizes: Iterable[int], most: int, rows: int = 1 << 62) -> Iterator[list[int]]:
    """Runs of neighbours of about so much size in all and at most so many rows."""
    run, n = [], 0
    for i, size in enumerate(sizes):
        run.append(i)
        n += size
        if n >= most or len(run) == rows:
            yield run
            run, n = [], 0
    if run:
        yield run


def slices(texts: list[str], most: int = 2_000_000, rows: int = 1 << 62) -> Iterator[list[int]]:
    """Runs of texts of about so many characters: what is in memory at a time doesn't follow the batch."""
    return runs(map(len, texts), most, rows)
