"""Cutting text where no token can cross, and remembering what each word gave."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: The characters with the Unicode property White_Space.
WHITE = "\t\n\v\f\r \x85\xa0  -     　"
SPACES = re.compile(f"[{WHITE}]+")
#: A text is handled in pieces of about so many characters.
PIECE = 1 << 16
#: Words remembered by a task, and the longest of them.
REMEMBERED, LONGEST = 500_000, 48


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, each cut before white space that follows
    something else.

    No alternative of the pre-splitting pattern holds white space after another character and
    none looks behind, so no match crosses such a cut and the rest is matched alike without
    what precedes it. Where there is no such place the piece is longer.
    """
    start = 0
    while len(text) - start > size:
        at = start + size
        cut = next((m.start() for m in SPACES.finditer(text, at) if m.start() > at or not text[at - 1].isspace()), None)
        if cut is None:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


class WordMemo:
    """``values(text)``: what ``measure`` gives for the parts of a text, cut before its spaces.

    ``measure`` takes a list of parts and gives a list of values; a part never depends on its
    neighbours. Parts are a word with the space before it. The values of short words are kept,
    up to REMEMBERED of them; others are measured again.
    """

    def __init__(self, measure: Callable[[list[str]], list], remembered: int = REMEMBERED):
        self.measure = measure
        self.known: dict[str, object] = {}
        self.room = remembered

    def values(self, text: str) -> Iterator[list]:
        """A list for each piece of the text."""
        for piece in safe_pieces(text):
            words = piece.split(" ")
            found = list(map(self.known.get, words))
            found[0] = None if words[0] else []
            if None in found:
                gaps = [i for i, v in enumerate(found) if v is None]
                # A cut before a space is safe unless white space precedes it.
                if any(not words[i] or words[i][-1].isspace() for i in gaps if 0 < i < len(words) - 1) or (
                    len(words) > 1 and words[0][-1:].isspace()
                ):
                    yield self.measure([piece])
                    continue
                parts = [" " + words[i] if i else words[i] for i in gaps]
                for i, value in zip(gaps, self.measure(parts), strict=True):
                    found[i] = value
                    if i and i < len(words) - 1 and len(self.known) < self.room and len(words[i]) <= LONGEST:
                        self.known[words[i]] = value
            if not words[0]:
                del found[0]
            yield found
