"""Exact token counts of every prefix of a text, by dynamic programming over its bytes."""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.llm.batches import map_slices, text_bytes
from namestrata.llm.rank_codec import byte_alphabet
from namestrata.llm.words import SPACES, WHITE, WordMemo

#: Pairs of tokens and matches remembered by a task.
PAIRS_KEPT, MATCHES_KEPT = 1 << 19, 400_000


def exact_spaces(pattern: str) -> str:
    """The pattern with white space spelled out, as the matchers differ on control characters."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


class PrefixCounter:
    """Token counts as the tokenizer file at ``path`` gives them (byte-level BPE, special strings
    cut out first).

    For one match of the pre-splitting pattern: the last token of a prefix's encoding is the one
    token that ends there and whose left neighbour, the last token of the remaining prefix, would
    stay beside it if the two were encoded alone. So one pass gives the count of every prefix,
    ``count[i] = count[i - len(token)] + 1``, and a longer text never has to be encoded again.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        special = [t["content"] for t in spec["added_tokens"]]
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in set(special)}
        merges = spec["model"]["merges"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        #: (left, right) -> (order, joined)
        self.merges = {
            (vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate((raw(x), raw(y)) for x, y in pairs)
        }
        self.bytes_of = {i: t for t, i in vocab.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        # A token that its own bytes do not encode to never comes out of an encoding.
        self.tokens = {t: i for t, i in vocab.items() if len(t) == 1 or self._merged(t) == [i]}
        self.longest = max(map(len, self.tokens))
        self.beside: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(exact_spaces(pattern))
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo = WordMemo(lambda parts: [self.count_part(p) for p in parts])
        self.matches: dict[str, int] = {}

    def _merged(self, text: bytes) -> list[int]:
        """Merges in their order; for single tokens and pairs, so at most a few hundred bytes."""
        ids = [self.single[b] for b in text]
        while len(ids) > 1:
            best = min(
                ((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None
            )
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def _stay(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        stays = self._merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        if len(self.beside) < PAIRS_KEPT:
            self.beside[left, right] = stays
        return stays

    def match_prefixes(self, data: bytes) -> list[int]:
        """Tokens of ``data[:i]`` for i from 0, ``data`` being one match of the pattern."""
        find, longest, known, stay = self.tokens.get, self.longest, self.beside.get, self._stay
        last: list[int] = [-1] * (len(data) + 1)
        count = [0] * (len(data) + 1)
        for end in range(1, len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = find(data[begin:end])
                if token is None:
                    continue
                beside = not begin or known((last[begin], token))
                if beside is None:
                    beside = stay(last[begin], token)
                if beside:
                    last[end], count[end] = token, count[begin] + 1
                    break
        return count

    def _match(self, match: str) -> int:
        n = self.matches.get(match)
        if n is None:
            n = self.match_prefixes(match.encode())[-1]
            if len(match) <= 64 and len(self.matches) < MATCHES_KEPT:
                self.matches[match] = n
        return n

    def count_part(self, text: str) -> int:
        if self.specials is None:
            return sum(map(self._match, self.pattern.findall(text)))
        between = self.specials.split(text)
        return len(between) - 1 + sum(self._match(m) for t in between for m in self.pattern.findall(t))

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(map(sum, self.memo.values(text)))

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` encoded alone, for every i from 0 to its length.

        A prefix that ends inside a special string, a contraction or after a run of white space
        splits otherwise than the whole text does there; it is counted by the parts it has.
        """
        out = np.zeros(len(text) + 1, dtype=np.int64)
        start = 0
        for special in [*(self.specials.finditer(text) if self.specials else ()), None]:
            end = special.start() if special else len(text)
            cut = self._segment(text, start, end, out)
            if special:
                start = special.end()
                for i in range(end + 1, start):
                    out[i] = out[cut] + self.count_part(text[cut:i])
                out[start] = out[end] + 1
        return out

    def _segment(self, text: str, start: int, end: int, out: np.ndarray) -> int:
        """Fill ``out`` for one stretch without special strings; its last safe cut."""
        done = int(out[start])
        segment = text[start:end]
        for m in self.pattern.finditer(segment):
            match, at = m.group(), start + m.start()
            if match[0] == "'" and match[1:].isalpha():
                # A contraction: until it is complete, its parts are matches of their own.
                for i in range(1, len(match)):
                    out[at + i] = done + self.count_part(match[:i])
            else:
                counts, place = self.match_prefixes(match.encode()), 0
                for i, c in enumerate(match):
                    # Inside a character of several bytes there is no prefix of text.
                    place += len(c.encode())
                    out[at + i + 1] = done + counts[place]
            done += self._match(match)
            out[at + len(match)] = done
        cut = start
        for m in SPACES.finditer(segment):
            cut = start + m.start()
            if 1 < m.end() - m.start() and m.end() < len(segment):
                # Before something else a run loses its last character to it; as the end of a
                # prefix it is one match.
                out[start + m.end()] = out[cut] + self._match(m.group())
        return cut

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that encodes to at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])


@cache
def prefix_counter(path: str, pattern: str) -> PrefixCounter:
    """One for all tasks of a worker, so that words stay remembered."""
    return PrefixCounter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """Bytes, tokens and whether the tokens exceed ``limit``, for every row of ``docs``.

    Null text counts as empty: 0 bytes, 0 tokens, not over the limit. Repeated rows give
    repeated results; other columns are ignored. No shuffle.
    """

    def start():
        counter = prefix_counter(path, pattern)

        def step(piece):
            texts = [t or b"" for t in piece.column("text").to_pylist()]
            n = [counter.count(t.decode("utf-8", "replace")) for t in texts]
            return [piece.column("doc_id"), list(map(len, texts)), n, [x > limit for x in n]]

        return step

    return map_slices(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        start,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
        weight="text",
    )


def truncate(docs: DataFrame, path: str, pattern: str, budget: int) -> DataFrame:
    """(doc_id, text, n_tokens): each text's longest prefix of at most ``budget`` tokens."""

    def start():
        counter = prefix_counter(path, pattern)

        def step(piece):
            texts = [(t or b"").decode("utf-8", "replace") for t in piece.column("text").to_pylist()]
            cut = [t[: counter.fitting(t, budget)] for t in texts]
            return [piece.column("doc_id"), cut, [counter.count(t) for t in cut]]

        return step

    return map_slices(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        start,
        "doc_id long, text string, n_tokens long",
        weight="text",
    )
