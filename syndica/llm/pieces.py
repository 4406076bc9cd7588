"""Cutting text where no tokenizer of this pattern family looks across, and remembering pieces.

A pre-token never spans the place where white space follows something else: whatever stands
before ends there, and what follows does not depend on it. Text may therefore be encoded piece
by piece, and equal pieces (mostly a space and a word) need to be encoded once.
"""

from __future__ import annotations

import re

# Unicode white space, as the split pattern's \\s has it (Python's own adds the separators 1C-1F).
SPACES = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_SPACE = "".join(SPACES)
_BEFORE_SPACE = [c + " " for c in SPACES]
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_SYNC = re.compile(f"[^{_SPACE}][{_SPACE}]")


def split_pieces(text: str) -> list[str]:
    """The pieces of ``text`` in order; joined they give the text."""
    return _PIECE.findall(text)


def spaced_pieces(text: str) -> list[str] | None:
    """Parts with text == " ".join(parts), where every cut is allowed; None if one is not."""
    if any(c in text for c in _BEFORE_SPACE):
        return None
    return text.split(" ")


def sync_points(text: str) -> tuple[int, int] | None:
    """First and last place where white space follows something else."""
    first = _SYNC.search(text)
    if not first:
        return None
    start = len(text)
    while True:  # from the end, in windows that overlap by one character
        end, start = start, max(0, start - 256)
        found = [m.start() + 1 for m in _SYNC.finditer(text, start, min(len(text), end + 1))]
        if found:
            return first.start() + 1, found[-1]


class Memo(dict):
    """Values of pieces, computed on a miss.

    Two generations of at most ``limit`` pieces: what was used since the last turn stays.
    """

    def __init__(self, compute, limit: int = 100_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.compute(piece)
        self.store(piece, value)
        return value

    def store(self, piece: str, value) -> None:
        if len(piece) > 64:
            return  # long pieces hardly come again
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value
