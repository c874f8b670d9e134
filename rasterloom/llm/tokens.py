"""Fast exact encoding with the tokenizers library: each distinct white-space chunk is encoded once per worker.

Both kinds of tokenizer used here split texts before merging, and a split never joins characters across these
cuts: before a single space, and around a single line feed, that stand between characters that are no white space
(byte-level), or at any white space (word-level, which drops it); and between Latin letters and the punctuation
after them. A text with other spacing is encoded whole. Letters go straight to the library's merge model, anything
else through its whole pipeline. Results equal encode() of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Sequence

#: Chunks in each of the two generations that a worker remembers: together about 250 MB.
REMEMBER = 500_000
#: White space of Python's str.split that is no white space to the word-level tokenizer; and all but space and line feed.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_OTHER_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: ASCII punctuation but for the apostrophe, which can begin a contraction.
_AFTER = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LOADED: dict[tuple[str, str], Encoder] = {}


def byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ... in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class _Chunks(dict):
    """chunk -> ids, learned when first asked for. before: the generation that was held until this one began."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn, self.before = learn, {}

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.before.get(chunk)) is None:
            ids = self.learn(chunk)
        self[chunk] = ids
        return ids

    def trim(self, most: int) -> None:
        if len(self) > most:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes. kind: byte or word."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        alphabet = byte_alphabet()
        self.shown = {c: "".join(chr(alphabet[x]) for x in chr(c).encode()) for c in [32, *range(0xC0, 0x100)]}
        self.kind = kind
        self.bare, self.spaced, self.tails = _Chunks(lambda c: self._learn("", c)), _Chunks(lambda c: self._learn(" ", c)), _Chunks(self._whole)
        self.feed = self._whole("\n") if kind == "byte" else b""

    @classmethod
    def shared(cls, path: str, kind: str) -> Encoder:
        """One per worker process."""
        if (path, kind) not in _LOADED:
            _LOADED[path, kind] = cls(path, kind)
        return _LOADED[path, kind]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, space: str, chunk: str) -> bytes:
        """Ids of a chunk with the space before it; or with a line feed, which a chunk may begin with, instead."""
        if chunk[:1] == "\n":
            return self.feed + self.bare[chunk[1:]]
        core = chunk.rstrip(_AFTER)
        if core.isascii():
            if not core.isalpha():
                return self._whole(space + chunk) if chunk or space else b""
            shown = core
        elif _LETTERS(core):
            shown = core
        else:
            return self._whole(space + chunk)
        if len(core) < len(chunk):
            return (self.spaced if space else self.bare)[core] + self.tails[chunk[len(core) :]]
        if self.kind == "word":
            shown = shown.lower()
        if not shown.isascii():
            shown = shown.translate(self.shown)
        return array("I", [t.id for t in self.merge("\u0120" + shown if space else shown)]).tobytes()

    def _encode(self, text: str) -> bytes:
        if self.kind == "word":
            return self._whole(text) if any(map(text.__contains__, _SEPARATORS)) else b"".join(map(self.bare.__getitem__, text.split()))
        line = text.replace("\n", " ")
        if "  " in line or line[0] == " " or line[-1] == " " or any(map(line.__contains__, _OTHER_SPACE)):
            return self._whole(text)
        first, _, rest = text.replace("\n", " \n").partition(" ")
        return self.bare[first] + (b"".join(map(self.spaced.__getitem__, rest.split(" "))) if rest else b"")

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        for held in (self.bare, self.spaced, self.tails):
            held.trim(REMEMBER)
        return [self._encode(t) if t else b"" for t in texts]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
