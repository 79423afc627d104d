"""Token ids of whole texts with a public tokenizer.

Texts repeat words far more often than they bring new ones, so ids are looked up by the
stretch between two blanks and the tokenizer runs for stretches not seen before.  The cut
before a blank is exact for tokenizers whose pattern lets a blank only lead a piece:

* ``byte_bpe``: blanks belong to the piece behind them; a text in which other white space
  stands before a blank, or two blanks in a row, is encoded as one;
* ``word_bpe``: white space only separates pieces.

A test compares the ids with the plain encoding, blanks of all kinds included.
"""

from __future__ import annotations

from array import array

import numpy as np

MOST = 600_000  # stretches kept by a Python worker
SIGNS = ".,;:!?#$%&*"  # never in one piece with a letter


def _byte_signs() -> list[str]:
    """The sign that byte-level BPE writes for each byte: itself if it is printable Latin-1,
    else the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Uneven(Exception):
    """The text has white space that must not be cut."""


class Encoder(dict):
    """Ids as little-endian bytes by stretch; ``type`` is that of one id.

    Keys are the stretches behind a blank, without it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.blank_leads = self.tokenizer.encode("a b", add_special_tokens=False).ids != (
            self.tokenizer.encode("a\tb", add_special_tokens=False).ids)
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.signs = _byte_signs()
        self.starts: dict[str, bytes] = {}
        self.blank = self.signs[32] if self.blank_leads else ""

    def plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return array(self.code, ids).tobytes()

    def _piece(self, stretch: str, blank: str) -> bytes | None:
        """Ids of Latin-1 letters, which are one piece, so the model alone is asked."""
        if not stretch.isalpha():
            return None
        if stretch.isascii():
            written = stretch if self.blank_leads else stretch.lower()
        elif max(stretch) > "\xff":
            return None
        else:
            low = stretch if self.blank_leads else stretch.lower()
            written = "".join(map(self.signs.__getitem__, low.encode()))
        return array(self.code, [x.id for x in self.tokenizer.model.tokenize(
            blank + written)]).tobytes()

    def start(self, stretch: str) -> bytes:
        """Ids of a stretch that no blank leads."""
        out = self.starts.get(stretch)
        if out is None:
            out = self._piece(stretch, "")
            if out is None:
                out = self.plain(stretch)
            if len(self.starts) < MOST // 6 and len(stretch) < 64:
                self.starts[stretch] = out
        return out

    def __missing__(self, stretch: str) -> bytes:
        if not stretch or stretch[-1].isspace():
            if self.blank_leads:
                raise _Uneven
            return b"" if not stretch else self.plain(stretch)
        keep, head = True, stretch.rstrip(SIGNS)
        if len(head) < len(stretch) and head.isalpha() and head[-1] <= "\xff":
            keep = head in self
            out = self[head] + self.start(stretch[len(head):])
        else:
            out = self._piece(stretch, self.blank)
            if out is None and self.blank_leads and "\n" in stretch[1:]:
                keep, (head, tail) = False, stretch.split("\n", 1)
                if head and tail and not head[-1].isspace() and not tail[0].isspace():
                    lines = tail.split("\n")
                    if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                        line = self.start("\n")
                        out = self[head] + b"".join(line + self.start(x) for x in lines)
            if out is None:
                out = self.plain((" " if self.blank_leads else "") + stretch)
        if keep and len(self) < MOST and len(stretch) < 64:
            self[stretch] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.blank_leads:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Uneven
            return self.start(first) * bool(first) + b"".join(map(self.__getitem__, rest))
        except _Uneven:
            return self.plain(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, which Spark keeps for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
