"""Token ids from a public tokenizer file, with each distinct piece of text encoded once.

No token of the vocabularies used here reaches over the border in front of a run of white space, so
a text may be cut there and the ids of the pieces joined. A text with white space that the engines
of Python and of the tokenizer see differently is encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Sequence

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: In a text of these characters only, a run of letters or of digits is a piece of its own.
_OTHER = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LETTER}]")
_GAP = r"[ \t\n\x0b\x0c\r]"
_FINE = re.compile(rf"{_GAP}*'?[{_LETTER}]+|{_GAP}*[0-9]+|{_GAP}*[^ \t\n\x0b\x0c\r0-9{_LETTER}]+|{_GAP}+")
#: White space outside ASCII, or taken for it by one engine only.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_PIECE = re.compile(rf"{_GAP}*[^ \t\n\x0b\x0c\r]+|{_GAP}+")
_LONGEST_PIECE = 64


#: The same without white space, for a tokenizer that drops it.
_SOLID = re.compile(rf"'?[{_LETTER}]+|[0-9]+|[^ \t\n\x0b\x0c\r0-9{_LETTER}]+")


def _pieces(text: str, folds: bool) -> list[str] | None:
    if not _OTHER.search(text):
        return _SOLID.findall(text.lower()) if folds else _FINE.findall(text)
    return None if _ODD_SPACE.search(text) else _PIECE.findall(text)


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


_LETTERS = re.compile(f"[{_LETTER}]+")
_SPACED = re.compile(f" ?[{_LETTER}]+")
#: A byte as the character that byte-level models know it by: itself where it can be seen, else the next from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SEEN]
_BYTE_CHARS = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_MODEL_CHARS = {c: "".join(_BYTE_CHARS[b] for b in chr(c).encode()) for c in [0x20, *range(0x80, 0x100)]}
_MODEL_SPACE = _MODEL_CHARS[0x20]
_PROBES = ["a", "the", "x" * 40, "unbelievably", "été", "ÿßñ", "übergrößen", "àéîõü"]
_SPACED_PROBES = [*_PROBES, "The", "ÉTÉ", *[f" {p}" for p in _PROBES], " THE", " Ünï"]


class _Known(dict):
    """Ids of pieces; a piece not seen before is encoded when it is asked for."""

    def __init__(self, encode) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = self._encode(piece)
        if len(piece) <= _LONGEST_PIECE:  # long pieces (a text without spaces) are not worth the memory
            self[piece] = out
        return out


class IdEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``remember`` bounds the pieces kept; when it is full the memory starts anew. Strings of special
    tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, remember: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        # whether case and white space leave no trace in the ids
        self._folds = len(set(self._encoded(["A b É", "a  B\té", " a\n\nb É "]))) == 1
        # a run of letters (in lower case where case is folded, else with a space in front or none) needs no
        # normalising or splitting: its bytes go straight to the model
        probes = _PROBES if self._folds else _SPACED_PROBES
        self._straight = [self._of_letters(p) for p in probes] == self._encoded(probes)
        self._known = _Known(self._fresh)
        self._remember = remember

    def _encoded(self, texts: Sequence[str]) -> list[bytes]:
        made = self._tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [_bytes(e.ids) for e in made]

    def _of_letters(self, piece: str) -> bytes:
        try:
            chars = piece.replace(" ", _MODEL_SPACE) if piece.isascii() else piece.translate(_MODEL_CHARS)
            return _bytes([t.id for t in self._model.tokenize(chars)])
        except Exception:  # a model without these characters
            return self._encoded([piece])[0]

    def _fresh(self, piece: str) -> bytes:
        if self._straight and (_LETTERS.fullmatch(piece) and piece == piece.lower() if self._folds else _SPACED.fullmatch(piece)):
            return self._of_letters(piece)
        return self._encoded([piece])[0]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text. Callers bound the size of a batch; see ``batches``."""
        known, out = self._known, []
        for text in texts:
            pieces = _pieces(text, self._folds)
            out.append(self._encoded([text])[0] if pieces is None else b"".join(map(known.__getitem__, pieces)))
        if len(known) > self._remember:
            known.clear()
        return out


_ENCODERS: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]


def batches(texts: Sequence[str], chars: int = 400_000):
    """Index ranges of about ``chars`` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
