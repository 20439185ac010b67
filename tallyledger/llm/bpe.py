"""Byte-level BPE by a contiguous array of ranks, over whole texts, and the way back.

The vocabulary is a tokenizers JSON file on every worker; its path is a parameter. Defined results: null
text is empty and has no ids; repeated rows are encoded row by row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyledger.llm.text import ready_workers, table

# The public pattern of byte-level BPE; white space and letters as Unicode has them.
_SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def _pattern(letter: str, number: str) -> str:
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+"
        rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


PATTERN = _pattern(r"\p{L}", r"\p{N}")
# Texts of ASCII and Latin letters alone are split by the same pattern with its classes spelt out, which is faster.
_LATIN = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_BEYOND_LATIN = re.compile(f"[^\\x00-\\x7F{_LATIN}]")
_NONE = 1 << 30
# Up to this length words are merged side by side in a matrix of ranks; beyond SHORT_WORD a heap replaces the scan.
WIDTHS = (8, 16, 32, 64)
SHORT_WORD = 512
# Words whose ids a worker remembers; emptied when full, so memory stays bounded.
REMEMBERED = 1 << 17
# Characters of the texts that are encoded together.
TOGETHER = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The vocabulary spells bytes as letters: printable Latin-1 as itself, the rest from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class RankArrayBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.byte_ids = [0] * 256
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocabulary[letter]
        self.rank, self.merged = {}, []
        for k, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocabulary[left] << 32 | vocabulary[right], k)
            self.merged.append(vocabulary[left + right])
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self._pairs, self._ranks = keys[order], np.fromiter(self.rank.values(), np.int32, len(keys))[order]
        self._merged, self._byte_ids = np.array([*self.merged, -1], np.int32), np.array(self.byte_ids, np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        by_length = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.pattern = regex.compile(PATTERN)
        self.latin = re.compile(_pattern(_LATIN, "0-9"))
        spelt = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self._lengths = np.array([len(x) for x in spelt], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.known: dict[str, bytes] = {}

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one word: scan the ranks of adjacent parts for the least, join there, refresh both neighbours."""
        if len(word) > SHORT_WORD:
            return self._merge_long(word)
        ids, rank = [self.byte_ids[b] for b in word], self.rank.get
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            ids[at] = self.merged[least]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | ids[at], _NONE)
            if at < len(ranks):
                ranks[at] = rank(ids[at] << 32 | ids[at + 1], _NONE)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same joins in the same order, from a heap of (rank, place), for words without a useful bound."""
        ids, rank, n = [self.byte_ids[b] for b in word], self.rank.get, len(word)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def ranked(at: int) -> int:
            return rank(ids[at] << 32 | ids[after[at]], _NONE) if ids[at] >= 0 and after[at] >= 0 else _NONE

        heap = [(r, at) for at in range(n) if (r := ranked(at)) != _NONE]
        heapq.heapify(heap)
        while heap:
            least, at = heapq.heappop(heap)
            if ranked(at) != least:
                continue  # a neighbour has changed since
            gone = after[at]
            ids[at], ids[gone], after[at] = self.merged[least], -1, after[gone]
            if after[gone] >= 0:
                before[after[gone]] = at
            for spot in (before[at], at):
                if spot >= 0 and (r := ranked(spot)) != _NONE:
                    heapq.heappush(heap, (r, spot))
        return [i for i in ids if i >= 0]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        return np.where((self._pairs[at] == keys) & (left >= 0) & (right >= 0), self._ranks[at], _NONE).astype(np.int32)

    def _merge_matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """merge_word for many words at once, one row each: every row joins its least rank in each round."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        column = np.arange(width)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width][column < lengths[:, None]] = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, : width - 1] = self._rank_of(ids[:, : width - 1], ids[:, 1:width])
        final, final_length = np.full((n, width), -1, np.int32), lengths.copy()
        rows = np.arange(n)
        while len(rows):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            ended = least == _NONE
            if ended.any():
                final[rows[ended]] = ids[ended, :width]
                rows, ids, ranks, at, least = (x[~ended] for x in (rows, ids, ranks, at, least))
            if not len(rows):
                break
            each = np.arange(len(rows))
            ids[each, at] = self._merged[least]
            ids[:, :width] = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            ranks[:, : width - 1] = np.take_along_axis(ranks, (column + (column >= at[:, None]))[:, : width - 1], 1)
            ranks[each, at] = self._rank_of(ids[each, at], ids[each, at + 1])
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self._rank_of(ids[inner, at[inner] - 1], ids[inner, at[inner]])
            final_length[rows] -= 1
        data, ends = final[column < final_length[:, None]].astype("<u4").tobytes(), np.cumsum(final_length) * 4
        return [data[e - 4 * k : e] for e, k in zip(ends.tolist(), final_length.tolist(), strict=True)]

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of new words as little-endian unsigned 32-bit integers."""
        coded = [(w, w.encode()) for w in words]
        low = 0
        for width in WIDTHS:
            some = [(w, b) for w, b in coded if low < len(b) <= width]
            low = width
            for k in range(0, len(some), 20_000):
                part = some[k : k + 20_000]
                self.known.update(zip([w for w, _ in part], self._merge_matrix([b for _, b in part], width), strict=True))
        self.known.update((w, np.array(self.merge_word(b), "<u4").tobytes()) for w, b in coded if len(b) > low)

    def _words(self, text: str) -> list[str]:
        return (self.pattern if _BEYOND_LATIN.search(text) else self.latin).findall(text)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [[(p, None if p in self.special else self._words(p)) for p in (self.marks.split(t) if self.marks else [t])] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        self._learn({w for pieces in split for _, words in pieces for w in words or () if w not in known})
        return [
            b"".join(
                self.special[p].to_bytes(4, "little") if words is None else b"".join(map(known.__getitem__, words))
                for p, words in pieces
            )
            for pieces in split
        ]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        """Text in UTF-8; bytes that are no UTF-8 become the replacement character."""
        ids = np.frombuffer(packed, "<u4")
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        place = np.repeat(self._starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self._spelt[place].tobytes().decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(np.array(ids, "<u4").tobytes()).decode()


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> RankArrayBPE:
    return RankArrayBPE(path)


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in order, so many at a time as make a bounded number of characters."""
    group, size = [], 0
    for value in column:
        group.append(value.as_py() or "")
        size += len(group[-1])
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


_OUTPUTS = {
    "n_tokens": ("bigint", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def encode_documents(
    documents: DataFrame, vocabulary: str, key: str = "doc_id", outputs: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """key and the outputs asked for: ids and the text decoded from them, their SHA-256 digests, n_tokens."""
    ready_workers(documents.sparkSession)
    key_type = documents.schema[key].dataType.simpleString()
    unknown = set(outputs) - set(_OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    decode = any(o.startswith("decoded") for o in outputs)

    def row(bpe: RankArrayBPE, packed: bytes) -> list:
        text = bpe.decode_packed(packed) if decode else b""
        made = {
            "n_tokens": lambda: len(packed) // 4,
            "ids": lambda: np.frombuffer(packed, "<i4"),
            "decoded": lambda: text.decode(),
            "ids_sha256": lambda: hashlib.sha256(packed).hexdigest(),
            "decoded_sha256": lambda: hashlib.sha256(text).hexdigest(),
        }
        return [made[o]() for o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for batch in batches:
            begin = 0
            for group in _groups(batch.column("text")):
                rows = [row(bpe, packed) for packed in bpe.encode_many(group)]
                arrays = [pa.array([r[k] for r in rows], _OUTPUTS[o][1]) for k, o in enumerate(outputs)]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(begin, len(group)), *arrays], [key, *outputs])
                begin += len(group)

    schema = ", ".join([f"`{key}` {key_type}", *(f"{o} {_OUTPUTS[o][0]}" for o in outputs)])
    return documents.select(key, "text").mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
