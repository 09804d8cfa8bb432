"""Byte-level BPE by a local rank file: whole texts to ids and back."""

from __future__ import annotations

import base64
import hashlib
import json
from functools import cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namestrata.llm.batches import map_slices, text_bytes
from namestrata.llm.words import PIECE, REMEMBERED, SPACES, WordMemo

#: Longer runs of white space go to the merges directly; the library's matcher recurses on them.
LONG_RUN = 1000


def load_ranks(path: str) -> dict[bytes, int]:
    """The file's lines are ``base64(token) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes, as a rule: printable
    Latin-1 stands for itself, the other bytes take the characters from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def file_ranks(path: str) -> dict[str, dict]:
    """Ranks and special strings of a byte-level BPE file of the ``tokenizers`` library.

    Its ids serve as ranks, which holds if its merges make the ids in order; anything else is
    refused.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = spec["model"]["type"] == "BPE" and spec["normalizer"] is None and not spec["model"]["dropout"]
    letters = byte_alphabet()
    vocab = spec["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if not plain or spec["pre_tokenizer"]["type"] != "ByteLevel" or made != sorted(made):
        raise ValueError(f"{path} is no byte-level BPE whose ids follow its merges")
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    return {"ranks": ranks, "special": special}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return np.array(ids, dtype="<u4").tobytes()


class RankCodec:
    """The library's encoding of whole texts, with words it has met before remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None, remembered: int = REMEMBERED):
        self.special = special or {}
        if any(SPACES.search(s) for s in self.special):
            raise ValueError("texts are cut before white space, so special strings must hold none")
        self.encoding = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special
        )
        self.memo = WordMemo(lambda parts: [self._part(p) for p in parts], remembered)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        return b"".join(b"".join(v) for v in self.memo.values(text))

    def _part(self, text: str) -> bytes:
        out, start = [], 0
        for m in SPACES.finditer(text) if len(text) >= LONG_RUN else ():
            if m.end() - m.start() >= LONG_RUN:
                # One match takes the run but for its last character, which goes with what follows.
                end = m.end() if m.end() == len(text) else m.end() - 1
                out.append(self._matched(text[start : m.start()]))
                run = self.encoding._encode_single_piece(text[m.start() : end])
                out.append(packed(run))
                start = end
        out.append(self._matched(text[start:]))
        return b"".join(out)

    def _matched(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return packed(self.encoding.encode(text, allowed_special="all"))
        return packed(self.encoding.encode_ordinary(text)) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return self.encoding.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


@cache
def codec(path: str, pattern: str) -> RankCodec:
    """One for all tasks of a worker, so that words stay remembered."""
    return RankCodec(load_ranks(path), pattern)


@cache
def file_codec(path: str, pattern: str, remembered: int = REMEMBERED) -> RankCodec:
    """A codec for a tokenizer file of the ``tokenizers`` library, with its special strings.

    It stays with the worker, whatever runs there afterwards, as do ``remembered`` words.
    """
    return RankCodec(pattern=pattern, remembered=remembered, **file_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and decoded bytes for every row of ``docs``.

    Null text counts as empty (no ids; digests of no bytes); repeated rows give repeated
    results; other columns are ignored. ``path`` is the rank file, present on every node.
    ``with_ids`` adds ``ids``, the little-endian 32-bit numbers themselves. No shuffle.
    """

    def start():
        own = codec(path, pattern)

        def step(piece):
            rows = []
            for text in piece.column("text").to_pylist():
                ids = own.encode(text.decode("utf-8", "replace")) if text else b""
                digest, back = hashlib.sha256(ids), hashlib.sha256()
                for i in range(0, len(ids), 4 * PIECE):
                    back.update(own.decode(ids[i : i + 4 * PIECE]))
                row = len(ids) // 4, digest.hexdigest(), back.hexdigest()
                rows.append((*row, ids) if with_ids else row)
            return [piece.column("doc_id"), *zip(*rows, strict=True)]

        return step

    return map_slices(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        start,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids,
        weight="text",
    )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, bytes): the raw bytes, which need not be valid UTF-8."""

    def start():
        own = codec(path, pattern)

        def step(piece):
            return [piece.column("doc_id"), [own.decode(x) if x else b"" for x in piece.column("ids").to_pylist()]]

        return step

    return map_slices(encoded.select("doc_id", "ids"), start, "doc_id long, bytes binary", weight="ids")
