"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once.

The library splits a text into pre-tokens and encodes each by itself, and white space always
separates pre-tokens.  So a text is cut at white space, the distinct pieces of a batch are encoded
by the library, and the ids are put together again by gathering.  Pieces are kept for later batches
of the same worker, up to a bound; the bound changes speed only.

New pieces go to the library many in one string, with a control character between them.  It is
one token of its own that no merge of the vocabulary touches, so the ids between two of them are
those of the piece alone.  Pieces for which that would not hold (they contain it, end in white
space, or do not start with the space that shields them) are encoded one by one.

``separated`` vocabularies drop white space; the others carry a space at the head of the word after
it.  There a text is cut at single spaces between two non-space characters only, so that a run of
white space stays whole inside its piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP_PIECES = 600_000
SLICE_BYTES = 6 << 20
#: A single space between two characters that no reading of "white space" counts as such.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: All characters that ``str.isspace`` counts.
_SPACE = frozenset(c for c in map(chr, range(0x110000)) if c.isspace())
MARK = "\x01"
JOINED = 40


class Encoder:
    """Ids of texts; ``separated``: the vocabulary ignores white space."""

    def __init__(self, path: str, separated: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separated = separated
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int32)

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each piece by itself, one after the other, and how many each has."""
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        between = f" {MARK} " if self.separated else MARK
        if len(mark) != 1:
            alone = set(range(len(pieces)))
        elif self.separated:
            alone = {k for k, p in enumerate(pieces) if MARK in p}
        else:
            alone = {k for k, p in enumerate(pieces) if p[:1] != " " or p[-1] in _SPACE or MARK in p}
        order = [k for k in range(len(pieces)) if k not in alone] if alone else range(len(pieces))
        texts = [between.join([pieces[k] for k in order[at:at + JOINED]]) for at in range(0, len(order), JOINED)]
        ids: list[int] = []
        for encoding in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids += encoding.ids
            ids += mark
        found = np.array(ids, np.uint32)
        marks = np.flatnonzero(found == mark[0]) if order else np.zeros(0, np.int64)
        counts = np.zeros(len(pieces), np.int32)
        counts[order] = np.diff(np.concatenate(([-1], marks))) - 1
        joined = np.delete(found, marks)
        if not alone:
            return joined, counts
        single = sorted(alone)
        parts = dict(zip(single, (e.ids for e in self.tokenizer.encode_batch_fast(
            [pieces[k] for k in single], add_special_tokens=False)), strict=True))
        counts[single] = [len(parts[k]) for k in single]
        out, at, last = [], 0, 0
        for k in single:
            step = int(counts[last:k].sum())
            out += [joined[at:at + step], np.array(parts[k], np.uint32)]
            at, last = at + step, k + 1
        return np.concatenate([*out, joined[at:]]), counts

    def _slots_of(self, pieces: list[str]) -> np.ndarray:
        """The slot of each piece; new pieces are encoded in one call.

        Slots of the pieces found first are kept; those beyond the bound live for one call.
        """
        kept = len(self.slots)
        if len(self.ends) > kept + 1:
            self.flat, self.ends = self.flat[:self.ends[kept]].copy(), self.ends[:kept + 1].copy()
        found = list(map(self.slots.get, pieces))
        new = [k for k, slot in enumerate(found) if slot is None]
        if new:
            texts = [pieces[k] for k in new]
            ids, counts = self._ids_of(texts)
            self.slots.update(zip(texts[:max(0, KEEP_PIECES - kept)], range(kept, KEEP_PIECES)))
            for number, k in enumerate(new, kept):
                found[k] = number
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts, dtype=np.int32)))
            self.flat = np.concatenate((self.flat, ids))
        return np.array(found, np.int32)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if self.separated:
            lists = pc.ascii_split_whitespace(texts)
            units = lists.flatten().dictionary_encode()
            pieces, index = _strings(units.dictionary), np.asarray(units.indices)
        else:
            lists, index, pieces = self._spaced(texts)
        slot = self._slots_of(pieces)[index] if len(pieces) else np.zeros(0, np.int32)
        starts = self.ends[slot]
        lengths = self.ends[slot + 1] - starts
        before = np.zeros(len(slot) + 1, np.int32)
        np.cumsum(lengths, out=before[1:])
        starts -= before[:-1]
        at = np.repeat(starts, lengths)
        at += np.arange(before[-1], dtype=np.int32)
        offsets = np.asarray(lists.offsets)
        return self.flat[at], np.diff(before[offsets - offsets[0]]).astype(np.int64)

    def _spaced(self, texts: pa.StringArray):
        """Pieces for a vocabulary whose words carry the space before them."""
        plain = pc.invert(pc.match_substring_regex(texts, r"^ | $|  "))
        if pc.all(plain).as_py() is not False:
            lists = pc.split_pattern(texts, " ")
        else:
            lists = pa.array([_CUT.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        units = lists.flatten().dictionary_encode()
        offsets = np.asarray(lists.offsets).astype(np.int64)
        offsets = offsets - offsets[0]
        words = _strings(units.dictionary)
        pieces = [" " + w for w in words]
        index = np.array(units.indices)
        heads = offsets[:-1][np.diff(offsets) > 0]
        # the first piece of a text has no space before it; its number is that of a piece of its own
        distinct, inverse = np.unique(index[heads], return_inverse=True)
        index[heads] = len(pieces) + inverse
        firsts = [words[k] for k in distinct]
        taken = {p: k for k, p in enumerate(pieces)} if any(w[:1] == " " for w in firsts) else {}
        if taken:
            at = np.array([taken.get(w, len(pieces) + k) for k, w in enumerate(firsts)])
            index[heads] = at[inverse]
        return lists, index, pieces + firsts


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, separated: bool) -> Encoder:
    """The encoder of this worker process."""
    if (path, separated) not in _ENCODERS:
        _ENCODERS[path, separated] = Encoder(path, separated)
    return _ENCODERS[path, separated]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of a few megabytes each, one text at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > SLICE_BYTES:
            yield start, k
            start, held = k, 0
        held += size
    if len(sizes):
        yield start, len(sizes)
