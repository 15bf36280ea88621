"""Whole-text encoding with a public byte-level BPE vocabulary.

Runs of text between safe cut points always encode to the same ids, so each
worker keeps the ids of runs it has met and asks the tokenizers library only
for new ones. Arrow numbers the runs of many texts at once, so that each is
looked up once among them. A cut is safe before a single space, and around a single
newline, that stands between two characters which are not white space: the
pre-tokenizer never joins characters across such a place.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliomill.llm.common import begins, keeps_cache

#: White space other than a single space or newline, and places where two meet.
_ODD = ("  ", "\n\n", " \n", "\n ", *map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Letters, which are one pre-token, and the ASCII marks that may end the run, which are another.
_WORD = re.compile(r"(\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")
#: Byte-level vocabularies write each byte as one character: printable Latin-1 as it is, the 68 others from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE = {b: chr(b if b in _PLAIN else 0x100 + sum(x not in _PLAIN for x in range(b))) for b in range(256)}
_BYTES = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def default_path() -> str:
    """The 50k byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Runs(dict):
    """Ids of runs as bytes; a run is a word after a space (kept without it) or after a newline (kept with it).

    A run that is asked for and missing is encoded. ``old`` holds the runs of
    the generation before; those asked for again move on.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.old = tokenizer, {}
        self.newline, self.marks = self.encode("\n"), {}
        self.merged = tokenizer.model.tokenize

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def mark(self, marks: str) -> bytes:
        """The ids of marks after letters; short ones are kept."""
        ids = self.marks.get(marks)
        if ids is None:
            ids = self.encode(marks)
            if len(marks) <= 3:
                self.marks[marks] = ids
        return ids

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            found = _WORD.fullmatch(run)
            if found and found[2]:
                ids = self[found[1]] + self.mark(found[2])
            elif run[:1] == "\n":
                ids = self.newline + (self.word(run[1:], "") if found else self.encode(run[1:]))
            else:
                ids = self.word(run, "\u0120") if found else self.encode(" " + run)
        self[run] = ids
        return ids

    def word(self, letters: str, space: str) -> bytes:
        """The ids of one pre-token: straight to the vocabulary's merges."""
        return array("I", [x.id for x in self.merged(space + (letters if letters.isascii() else letters.translate(_BYTES)))]).tobytes()


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids, as bytes; ``most`` bounds the runs kept."""

    def __init__(self, path: str | None = None, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.most, self.runs = most, Runs(self.tokenizer)

    def plain(self, text: str) -> bool:
        """Whether every single space and newline of a text is a safe cut."""
        return not (text[0].isspace() or text[-1].isspace() or any(x in text for x in _ODD) or (self.added and self.added.search(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        if not text:
            return b""
        if self.plain(text):
            runs = text.replace("\n", " \n").split(" ")
            runs[0] = "\n" + runs[0]
            return b"".join(map(self.runs.__getitem__, runs))[len(self.runs.newline) :]
        if self.added and self.added.search(text):  # the library cuts such a text at its added tokens first
            return self.runs.encode(text)
        return b"".join(map(self.runs.encode, _SAFE.split(text)))

    def together(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts: each distinct run is looked up once, Arrow puts the ids in place."""
        runs = pc.split_pattern(pa.array(["\n" + x.replace("\n", " \n") for x in texts], pa.string()), " ")
        numbered = runs.values.dictionary_encode()
        known, ids = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), []
        for at in range(0, len(known), 4096):
            ids += map(self.runs.__getitem__, known[at : at + 4096])
            self.turn()
        placed = pa.array(ids, pa.binary()).take(numbered.indices)
        _, ends, data = placed.buffers()
        bounds = np.frombuffer(ends, np.int32)[runs.offsets.to_numpy()].tolist()
        data, skip = memoryview(data), len(self.runs.newline)
        return [bytes(data[a + skip : b]) for a, b in zip(bounds, bounds[1:])]

    def turn(self) -> None:
        """Begins a new generation of runs once the present one is half of what is kept."""
        if len(self.runs) > self.most // 2:
            self.runs.old = dict(self.runs)
            self.runs.clear()

    def batch(self, texts: list[str], chars: int | None = None) -> list[bytes]:
        """The ids of each text; plain ones are taken together, up to ``chars`` characters (four a run kept), longer ones alone."""
        chars = 4 * self.most if chars is None else chars
        out, plain = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if text and len(text) <= chars and self.plain(text):
                plain.append(i)
            else:
                out[i] = self.encode(text)
                self.turn()
        for at, some in chunks([texts[i] for i in plain], len(plain), chars):
            for i, ids in zip(plain[at : at + len(some)], self.together(some), strict=True):
                out[i] = ids
        return out


_ENCODERS: dict[tuple[str | None, int], Encoder] = {}


keeps_cache("tokens", _ENCODERS.clear)


def encoder(path: str | None = None, most: int = 1_000_000) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    begins("tokens")
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


def chunks(texts: list[str], rows: int = 4096, chars: int = 4_000_000) -> Iterable[tuple[int, list[str]]]:
    """Parts of a batch of bounded size (one text at least), with their first index."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and (i - begin >= rows or size + len(text) > chars):
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]
