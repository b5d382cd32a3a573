"""Token ids of whole texts, worked out once per distinct run of letters.

word_bpe_49k folds case, drops white space and never merges across it or across the runs
that its own pattern finds in a piece between blanks, so the ids of a text are those of its
runs in a row. Runs are looked up in a table of bounded bytes; new ones go straight to the
library's BPE model. That holds for printable ASCII and Latin-1 letters; any other piece
goes to the library's full pipeline as it is. Texts that hold `<|` are not folded beforehand,
as special strings are matched as written.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array

from tokenizers import Tokenizer

from planmatch.llm.batches import LOWER

# Bytes of remembered runs per worker, in two generations: when the younger one has half
# of this, it takes the place of the older one. A run counts ENTRY bytes besides its text
# and its ids; longer ones than LONGEST characters are not remembered.
TABLE_BYTES = 40_000_000
ENTRY = 200
LONGEST = 64
# Bytes of a text that are worked on at once, up to the next blank.
SLICE = 1 << 18

# Letters whose folding is a plain shift; `'` starts contractions, so it is left out.
_LETTERS = "!-&(-~ß-öø-ÿÀ-ÖØ-Þ"
_BLANKS = r"\t-\r "
_EASY = re.compile(f"[{_LETTERS}]+")
_EASY_TEXT = re.compile(f"[{_LETTERS}{_BLANKS}]*")
# Whole pieces that hold any other character.
_HARD = re.compile(f"((?<![^{_BLANKS}])[^{_BLANKS}]*[^{_LETTERS}{_BLANKS}][^{_BLANKS}]*)")
_RUNS = re.compile(f"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ{_BLANKS}]+")
_BLANK = re.compile(rb"[\t-\r ]")


def _byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as one printable character: itself where it is
    printable in Latin-1, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class PieceEncoder:
    """Encoder for a tokenizer file with word ends, folded case and no white space."""

    _open: dict[str, "PieceEncoder"] = {}

    def __init__(self, path: str):
        if sys.byteorder != "little":
            raise RuntimeError("ids are written in little-endian order")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        # Keys are runs, or a blank and a whole piece.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the younger generation

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        """One per worker and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _ids(self, key: str) -> bytes:
        if key[0] == " ":
            return array("H", self.tokenizer.encode(key[1:], add_special_tokens=False).ids).tobytes()
        mapped = key if key.isascii() else "".join(self.letters[b] for b in key.encode())
        return array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of keys that are not in the younger generation; long ones are returned,
        others remembered."""
        long = {}
        for key in keys:
            if len(key) > LONGEST:
                long[key] = self._ids(key)
                continue
            ids = self.old.get(key)
            if ids is None:
                ids = self._ids(key)
            self.young[key] = ids
            self.held += len(key) + len(ids) + ENTRY
        return long

    def _joined(self, keys: list[str]) -> bytes:
        young = self.young
        try:
            return b"".join([young[k] for k in keys])
        except KeyError:
            long = self._learn(set(keys).difference(young))
            if long:
                ids = b"".join([long[k] if k in long else young[k] for k in keys])
            else:
                ids = b"".join([young[k] for k in keys])
            if 2 * self.held > TABLE_BYTES:
                self.old, self.young, self.held = young, {}, 0
            return ids

    def _keys(self, raw: bytes) -> list[str]:
        if b"<|" in raw:
            keys = []
            for piece in raw.split():
                text = piece.decode("utf-8")
                keys += [" " + text] if b"<|" in piece or not _EASY.fullmatch(text) else _RUNS.findall(text.lower())
            return keys
        text = raw.translate(LOWER).decode("utf-8")
        if _EASY_TEXT.fullmatch(text):
            return _RUNS.findall(text.lower())
        keys = []
        for number, part in enumerate(_HARD.split(text)):
            if number % 2:
                keys.append(" " + part)
            else:
                keys += _RUNS.findall(part.lower())
        return keys

    def encode(self, raw: bytes) -> bytes:
        """Ids of a UTF-8 text, 16 bits each, little-endian."""
        if len(raw) <= SLICE:
            return self._joined(self._keys(raw))
        parts, at = [], 0
        while at < len(raw):
            blank = _BLANK.search(raw, at + SLICE)
            end = blank.end() if blank else len(raw)
            parts.append(self._joined(self._keys(raw[at:end])))
            at = end
        return b"".join(parts)


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: its version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()
