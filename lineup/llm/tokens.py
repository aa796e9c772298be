"""Token ids of whole texts from a public tokenizer file.

Both vocabularies used here split a text at white space before any merge, so
the ids of a text are the ids of its space-separated pieces put together.  A
worker keeps the ids of the pieces it has met (beyond ``MAX_PIECES`` it forgets
those met in one text only) and asks the tokenizer for new pieces only, many in one call;
plain words of a byte-level vocabulary go to the tokenizer's model directly.  Texts with any irregular white space (doubled, leading,
trailing, or other than space and newline) go to the tokenizer whole, so the
result always equals ``encode(text, add_special_tokens=False)``; the strings of
special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
MAX_PIECES = 600_000

_ENCODERS: dict[str, "PieceEncoder"] = {}


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file (absolute paths are taken as they are)."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))


def encoder(name: str) -> "PieceEncoder":
    """The worker's encoder for one tokenizer file, kept between batches and tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(name)
    return _ENCODERS[name]


#: White space other than the space and the newline, as any tokenizer may see it.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00\x01]")


#: A piece of a byte-level vocabulary that is one word and signs after it: its two parts are the
#: tokenizer's own, whatever follows.  A leading newline is a token of its own.
_PLAIN = r"^(?P<lead>[\n\x00]?)(?P<word>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<signs>[.,;:!?()]*)$"
#: The pre-tokenizer whose rules ``_PLAIN`` follows.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


#: The letter that stands for the space in a byte-level vocabulary.
SPACE_LETTER = chr(256 + 32)


def _byte_letters() -> dict[int, str]:
    """For letters beyond ASCII the letters that stand for their bytes in a byte-level vocabulary:
    printable bytes stand for themselves, the others are numbered from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letter = [chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)]
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Index(dict):
    """piece -> position in the id table; a new piece gets the next position and is noted."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self)
        self.new.append(piece)
        return at


class PieceEncoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path(name))
        self.tok.encode_special_tokens = True
        self.vocab_size = self.tok.get_vocab_size()
        # A byte-level vocabulary keeps the newline as a token of its own; one
        # that drops white space needs a visible mark between pieces instead.
        self.keeps_space = len(self._ids("\n")) > 0
        self.mark = "\n" if self.keeps_space else "\x01"
        mark = self._ids(self.mark)
        if len(mark) != 1:
            raise ValueError(f"{name}: no single token can mark the ends of pieces")
        self.mark_id = mark[0]
        spec = json.loads(self.tok.to_str())
        rule = spec["pre_tokenizer"] or {}
        self.direct = (self.keeps_space and spec["normalizer"] is None
                       and _BYTE_LEVEL.items() <= rule.items())
        self.letters = _byte_letters()
        self.letters_set = frozenset(map(chr, self.letters))
        self.index = _Index()
        self.start = self.length = self.hits = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget_rare(self) -> None:
        """Keep the pieces met at least twice, or none if they alone fill half of the table."""
        keep = np.flatnonzero(self.hits[:len(self.index)] > 1)
        if len(keep) > MAX_PIECES // 2:
            keep = keep[:0]
        pieces = list(self.index)
        n = self.length[keep]
        self.flat = self.flat[_ranges(self.start[keep], n)]
        self.start = np.cumsum(n) - n
        self.length, self.hits = n, np.ones(len(keep), np.int64)
        self.index = _Index(zip([pieces[i] for i in keep], range(len(keep))))

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of single units of the pre-tokenizer, a leading space being a letter already."""
        model = self.tok.model.tokenize
        # the space letter alone is beyond ASCII in most units
        found = [[x.id for x in model(u if u[1:].isascii() and u[0] not in self.letters_set else u.translate(self.letters))]
                 if u else [] for u in units]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, length.sum()), length

    def _learn(self) -> None:
        """Encode the pieces met for the first time: plain words by the model, the rest joined."""
        new, self.index.new = self.index.new, []
        # up to three parts a piece (newline, word, signs), as ranges of ``flat``
        start, length = np.zeros((len(new), 3), np.int64), np.zeros((len(new), 3), np.int64)
        other = np.ones(len(new), bool)
        flats = [np.array([self.mark_id], np.uint32)]
        if self.direct and new:
            parts = pc.extract_regex(pa.array(new, pa.large_string()), _PLAIN)
            plain = np.flatnonzero(parts.is_valid().to_numpy(zero_copy_only=False))
            lead, word, signs = parts.take(pa.array(plain)).flatten()
            other[plain] = False
            length[plain, 0] = pc.equal(lead, "\n").to_numpy(zero_copy_only=False)
            text = pa.large_string()
            space = pc.if_else(pc.equal(lead, ""), pa.scalar(SPACE_LETTER, text), pa.scalar("", text))
            spaced = pc.binary_join_element_wise(space, word, pa.scalar("", text))
            for k, units in ((1, spaced), (2, signs)):
                coded = units.dictionary_encode()
                ids, n = self._units(coded.dictionary.to_pylist())
                at = coded.indices.to_numpy()
                start[plain, k] = (sum(map(len, flats)) + np.cumsum(n) - n)[at]
                length[plain, k] = n[at]
                flats.append(ids)
        rest = np.flatnonzero(other).tolist()
        ids, first, n = self._joined([new[i] for i in rest])
        start[rest, 1], length[rest, 1] = sum(map(len, flats)) + first, n
        flats.append(ids)
        total = length.sum(1)
        at = len(self.flat)
        self.flat = np.concatenate([self.flat, np.concatenate(flats)[_ranges(start.ravel(), length.ravel())]])
        self.start = np.concatenate([self.start, at + np.cumsum(total) - total])
        self.length = np.concatenate([self.length, total])

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first and number of each piece's) of pieces, many in one call.  Every piece follows a mark,
        so the marks among the ids are the borders; for a piece that starts with a newline the mark is
        its first token."""
        flat, starts, lengths, used = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for lo in range(0, len(pieces), 4096):
            part = pieces[lo:lo + 4096]
            if self.keeps_space:
                text = "".join(["\n" + p[1:] if p[0] in "\n\x00" else "\n " + p for p in part])
                broken = np.fromiter([p[0] == "\n" for p in part], bool, len(part))
            else:
                text = "\x01 " + " \x01 ".join(part)
                broken = np.zeros(len(part), bool)
            ids = np.asarray(self._ids(text), np.uint32)
            marks = np.flatnonzero(ids == self.mark_id)
            assert len(marks) == len(part)
            first = marks + 1 - broken
            flat.append(ids)
            starts.append(first + used)
            lengths.append(np.append(marks[1:], len(ids)) - first)
            used += len(ids)
        return np.concatenate(flat), np.concatenate(starts), np.concatenate(lengths)

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces of a text whose white space is regular, else None.  A piece
        after a newline starts with it; the first piece of a text starts with NUL."""
        if _OTHER_SPACE.search(text):
            return None
        if not self.keeps_space:
            return text.split()
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[0] in " \n" \
                or text[-1] in " \n":
            return None
        return ("\x00" + text).replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids per text (NULL is the empty text)."""
        if len(self.index) > MAX_PIECES:
            self._forget_rare()
        found: list[np.ndarray | None] = []
        get = self.index.__getitem__
        for text in texts:
            pieces = self._pieces(text) if text else None
            found.append(np.asarray(list(map(get, pieces)), np.int64) if pieces else None)
        if self.index.new:
            self._learn()
            self.hits = np.concatenate([self.hits, np.zeros(len(self.start) - len(self.hits), np.int64)])
        out = []
        for text, at in zip(texts, found):
            if at is None:
                out.append(np.asarray(self._ids(text) if text else [], np.uint32))
            else:
                self.hits[at] += 1  # once per text is enough to tell rare pieces
                out.append(self.flat[_ranges(self.start[at], self.length[at])])
        return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[0], start[0]+1, ..., for each range in turn."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
