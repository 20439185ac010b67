"""Byte-level BPE from a file of ranks, with pre-tokenisation by a scan of transition functions, and the way back.

1. Every code point has a class (letter, number, white space, other); with a look at what follows it becomes one of eight
   symbols. A symbol is a function from the state before it to the state after it, and functions compose: all states of
   many texts come from one prefix scan over small numbers, in blocks side by side. No regular expression is run.
2. Places where the automaton begins a piece are mapped to bytes. Pieces of up to seven bytes are told apart as whole
   numbers, so that each distinct one is looked up once per group of texts; longer ones by their bytes.
3. Ids of pieces are kept by the worker. New pieces are merged together in one flat array: in every round each piece joins
   its leftmost least pair. A heap takes pieces beyond LONG_PIECE bytes.
4. The offset of every token is a running sum of token lengths; decoding copies the tokens' bytes to these places.

Defined results: null text is empty and has no ids; repeated rows are encoded row by row; extra columns, whatever their
names, are ignored; an empty table gives no rows. A very long text is cut before blanks between two words, where a piece
always begins, and held a part at a time beside its ids. Ties of rank go to the leftmost pair. Classes of code points are
those of Python's Unicode tables; a code point they do not know counts as other.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyledger.llm.text import ready_workers, table

# Symbols. JOIN is a blank before a visible character, LAST another white space there; MARK_1 and MARK_2 are apostrophes
# before one or two letters that belong to them.
LETTER, NUMBER, OTHER, SPACE, JOIN, LAST, MARK_1, MARK_2 = range(8)
# States: the next character begins a piece; inside a run; behind a joining blank; letters of an ending still to come.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
_SYMBOLS = _STATES = 8
# White space as Unicode has it, and the endings that an apostrophe opens.
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ENDINGS_1 = "stmd"
_ENDINGS_2 = ("re", "ve", "ll")

# Characters of the texts that are encoded together, and the width of a block of the scan.
TOGETHER = 1 << 19
BLOCK = 128
# Pieces beyond this many bytes are merged by a heap.
LONG_PIECE = 256
# Pieces whose ids a worker keeps; emptied when full, so memory stays bounded.
REMEMBERED = 1 << 18
_NONE = np.int32(2**31 - 1)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, SPACE or OTHER."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(_WHITE)] = SPACE
    return out


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """State after a symbol, and whether a piece begins with it."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return CLOSED, False
    if symbol == JOIN:
        return JOINED, True
    if symbol == LAST:
        return CLOSED, True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, SPACE: IN_SPACE}.get(symbol, IN_OTHERS)
    if state in (run, JOINED):
        return run, False
    return {MARK_1: ONE_MORE, MARK_2: TWO_MORE}.get(symbol, run), True


@functools.lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that texts can make of the symbols, numbered.

    Returns the table of compositions (first, then second), the state that each function gives for each state, the functions
    of the symbols, of the symbols at the beginning of a text (where the state is CLOSED) and the identity, and where a
    symbol begins a piece by state.
    """
    plain = [tuple(_step(s, q)[0] for q in range(_STATES)) for s in range(_SYMBOLS)]
    first = [(f[CLOSED],) * _STATES for f in plain]
    numbers: dict[tuple, int] = {}
    for f in [*plain, *first, tuple(range(_STATES))]:
        numbers.setdefault(f, len(numbers))
    given = np.array([numbers[f] for f in [*plain, *first]], np.uint16)
    identity = numbers[tuple(range(_STATES))]
    at = 0
    functions = list(numbers)
    while at < len(functions):
        for generator in {*plain, *first}:
            made = tuple(generator[q] for q in functions[at])
            if made not in numbers:
                numbers[made] = len(functions)
                functions.append(made)
        at += 1
    compose = np.array([[numbers[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint16)
    begins = np.array([[_step(s, q)[1] for q in range(_STATES)] for s in range(_SYMBOLS)])
    return compose, np.array(functions, np.uint8), np.append(given, np.uint16(identity)), begins


def _scan(functions: np.ndarray, compose: np.ndarray, identity: int) -> np.ndarray:
    """Composition of all functions up to and with each place; blocks run side by side, their totals are scanned in turn."""
    n = len(functions)
    if n <= BLOCK:
        return np.fromiter(itertools.accumulate(functions.tolist(), lambda f, g: int(compose[f, g])), np.uint16, n)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, identity, np.uint16)
    padded[:n] = functions
    across = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    flat, size = compose.reshape(-1), np.int32(len(compose))
    for k in range(1, BLOCK):
        across[k] = flat[across[k - 1] * size + across[k]]
    before = np.empty(rows, np.uint16)
    before[0], before[1:] = identity, _scan(across[-1], compose, identity)[:-1]
    out = flat[before * size + across]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def piece_starts(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts laid end to end: points are their code points, sizes how many each has."""
    compose, states, numbers, begins = _monoid()
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    symbols = classes()[points]
    ends = np.cumsum(sizes)[sizes > 0]
    starts = ends - sizes[sizes > 0]
    visible = np.zeros(n, bool)
    visible[:-1] = symbols[1:] != SPACE
    visible[ends - 1] = False
    white = symbols == SPACE
    symbols[white & visible] = LAST
    symbols[white & visible & (points == 32)] = JOIN
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        left = ends[np.searchsorted(ends, marks, "right")] - marks
        one = np.where(left > 1, points[np.minimum(marks + 1, n - 1)], 0)
        two = np.where(left > 2, points[np.minimum(marks + 2, n - 1)], 0)
        symbols[marks[np.isin(one, [ord(c) for c in _ENDINGS_1])]] = MARK_1
        for ending in _ENDINGS_2:
            symbols[marks[(one == ord(ending[0])) & (two == ord(ending[1]))]] = MARK_2
    made = numbers[symbols]
    made[starts] = numbers[symbols[starts] + np.uint8(_SYMBOLS)]
    after = states[_scan(made, compose, int(numbers[-1])), CLOSED]
    before = np.empty(n, np.uint8)
    before[1:] = after[:-1]
    before[starts] = CLOSED
    return np.flatnonzero(begins.reshape(-1)[symbols * np.uint8(_STATES) + before])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class ByteBPE:
    """Encoder and decoder of one file of ranks: a line is a token's bytes in base64 and its rank, which is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        spelt = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            spelt[rank] = token
        self._lengths = np.array([len(x) for x in spelt], np.int64)
        self._places = np.cumsum(self._lengths) - self._lengths
        self._spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self._single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {
            self.rank[token[:k]] << 32 | self.rank[token[k:]]: rank
            for token, rank in self.rank.items()
            for k in range(1, len(token))
            if token[:k] in self.rank and token[k:] in self.rank
        }
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.int64(2**63 - 1))
        self._merged = np.append(np.fromiter(self.pairs.values(), np.int32, len(keys))[order], _NONE)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[int | bytes, int] = {}
        self._starts = np.zeros(1 << 12, np.int64)
        self._counts = np.zeros(1 << 12, np.int64)
        self._ids = np.zeros(1 << 14, np.int32)
        self._filled = 0

    # Merging.

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._merged[at], _NONE)

    def _merge_flat(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, one after another, and how many each has."""
        done_ids, done_of, done_counts = [], [], []
        ids, counts, of = self._single[data], lengths.copy(), np.arange(len(lengths))
        ends = np.cumsum(counts)
        rank = np.full(len(ids), _NONE, np.int32)
        rank[:-1] = self._rank_of(ids[:-1], ids[1:])
        rank[ends - 1] = _NONE
        while len(of):
            starts = ends - counts
            least = np.minimum.reduceat(rank, starts)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, counts)
                done_ids.append(ids[gone])
                done_of.append(of[over])
                done_counts.append(counts[over])
                ids, rank, of, counts, least = ids[~gone], rank[~gone], of[~over], counts[~over], least[~over]
                if not len(of):
                    break
                starts = np.cumsum(counts) - counts
            equal = np.flatnonzero(rank == np.repeat(least, counts))
            at = equal[np.searchsorted(equal, starts)]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            ids, rank = ids[keep], np.delete(rank, at + np.arange(len(at)))
            counts -= 1
            ends = np.cumsum(counts)
            inner = at[at < ends - 1]
            rank[ends - 1] = _NONE
            rank[inner] = self._rank_of(ids[inner], ids[inner + 1])
            inner = at[at > ends - counts]
            rank[inner - 1] = self._rank_of(ids[inner - 1], ids[inner])
        if not done_of:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids, of, counts = map(np.concatenate, (done_ids, done_of, done_counts))
        order = np.argsort(of)
        return ids[_ranges((np.cumsum(counts) - counts)[order], counts[order])], counts[order]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same joins in the same order, from a heap of (rank, place)."""
        ids, n, pairs = self._single[np.frombuffer(piece, np.uint8)].tolist(), len(piece), self.pairs
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := pairs.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            gone = right[at]
            if ids[at] < 0 or gone < 0 or pairs.get(ids[at] << 32 | ids[gone]) != rank:
                continue  # one of the two has been joined since
            ids[at], ids[gone], right[at] = rank, -1, right[gone]
            if right[gone] >= 0:
                left[right[gone]] = at
            for a, b in ((left[at], at), (at, right[at])):
                if a >= 0 and b >= 0 and (r := pairs.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Append ids of new pieces to what is kept; the number of the first of them."""
        first = len(self._known)
        for name, need in (("_starts", first + len(counts)), ("_counts", first + len(counts)), ("_ids", self._filled + len(ids))):
            if need > len(held := getattr(self, name)):
                setattr(self, name, np.concatenate((held, np.zeros(max(need, len(held)), held.dtype))))
        self._starts[first : first + len(counts)] = self._filled + np.cumsum(counts) - counts
        self._counts[first : first + len(counts)] = counts
        self._ids[self._filled : self._filled + len(ids)] = ids
        self._filled += len(ids)
        return first

    def _learn(self, keys: list[int | bytes], pieces: list[bytes]) -> None:
        """Keep the ids of new distinct pieces. A piece that is a token has its id; the others are merged."""
        whole = [self.rank.get(p, -1) for p in pieces]
        for chosen in (
            [k for k, w in enumerate(whole) if w >= 0],
            [k for k, w in enumerate(whole) if w < 0 and len(pieces[k]) <= LONG_PIECE],
            [k for k, w in enumerate(whole) if w < 0 and len(pieces[k]) > LONG_PIECE],
        ):
            if not chosen:
                continue
            if whole[chosen[0]] >= 0:
                ids, counts = np.array([whole[k] for k in chosen], np.int32), np.ones(len(chosen), np.int64)
            elif len(pieces[chosen[0]]) <= LONG_PIECE:
                lengths = np.array([len(pieces[k]) for k in chosen], np.int64)
                ids, counts = self._merge_flat(np.frombuffer(b"".join([pieces[k] for k in chosen]), np.uint8), lengths)
            else:
                merged = [self._merge_long(pieces[k]) for k in chosen]
                ids, counts = np.array([i for m in merged for i in m], np.int32), np.array([len(m) for m in merged], np.int64)
            first = self._keep(ids, counts)
            self._known.update(zip([keys[k] for k in chosen], range(first, first + len(chosen)), strict=True))

    # Texts.

    def _numbered(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number under which the ids of every piece are kept."""
        known, out = self._known, np.empty(len(starts), np.int64)
        short = lengths < 8
        at = np.flatnonzero(short)
        windows = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
        size = lengths[at].astype(np.uint64)
        bits = np.uint64(8) * size
        # The bytes of a piece and its length make one whole number.
        coded = windows[starts[at]] & ((np.uint64(1) << bits) - np.uint64(1)) | size << np.uint64(56)
        distinct, index = np.unique(coded, return_inverse=True)
        keys = distinct.tolist()
        long_at = np.flatnonzero(~short)
        long_keys = [data[s:e] for s, e in zip(starts[long_at].tolist(), (starts + lengths)[long_at].tolist(), strict=True)]
        new = [k for k in keys if k not in known]
        new_long = [k for k in dict.fromkeys(long_keys) if k not in known]
        if new or new_long:
            self._learn(new + new_long, [(k & (1 << 56) - 1).to_bytes(k >> 56, "little") for k in new] + new_long)
        out[at] = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[index]
        out[long_at] = np.fromiter(map(known.__getitem__, long_keys), np.int64, len(long_keys))
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        data = joined.encode()
        starts = piece_starts(points, sizes)
        of_text = np.searchsorted(starts, np.cumsum(sizes) - sizes)
        if len(data) > len(points):
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            starts = (np.cumsum(width) - width)[starts]
        if len(self._known) > REMEMBERED:
            self._forget()
        number = self._numbered(data, starts, np.diff(starts, append=len(data)))
        counts = self._counts[number]
        ids = self._ids[_ranges(self._starts[number], counts)]
        until = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        return np.split(ids, until[of_text[1:]]) if len(texts) else []

    def encode_grouped(self, texts: list[str]) -> list[np.ndarray]:
        """The same for texts of any length, a bounded number of characters at a time."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0

        def flush() -> None:
            for (k, _), ids in zip(held, self.encode_many([part for _, part in held]), strict=True):
                parts[k].append(ids)
            held.clear()

        for k, text in enumerate(texts):
            for part in _cut(text):
                held.append((k, part))
                size += len(part)
                if size >= TOGETHER:
                    flush()
                    size = 0
        flush()
        return [p[0] if len(p) == 1 else np.concatenate([np.zeros(0, np.int32), *p]) for p in parts]

    def encode(self, text: str) -> list[int]:
        return self.encode_grouped([text])[0].tolist()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token begins in the bytes of the text, and last the number of bytes."""
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(self._lengths[ids])))

    def decode(self, ids: np.ndarray) -> bytes:
        return self._spelt[_ranges(self._places[ids], self._lengths[ids])].tobytes()


def _cut(text: str) -> Iterator[str]:
    """A long text in parts that begin with a blank between two visible characters, where a piece always begins."""
    begin = 0
    while len(text) - begin > 2 * TOGETHER:
        at = text.find(" ", begin + TOGETHER)
        while 0 < at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if not 0 < at < len(text) - 1:
            break
        yield text[begin:at]
        begin = at
    yield text[begin:]


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


_OUTPUTS = {
    "n_tokens": ("bigint", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "offsets": ("array<bigint>", pa.list_(pa.int64())),
    "decoded": ("binary", pa.binary()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def encode_documents(
    documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "offsets")
) -> DataFrame:
    """key and the outputs asked for: ids, the byte offset of every token, the bytes decoded from the ids, digests, n_tokens.

    vocabulary is the path of a file of ranks on every worker.
    """
    ready_workers(documents.sparkSession)
    unknown = set(outputs) - set(_OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")

    def row(bpe: ByteBPE, ids: np.ndarray) -> list:
        decoded = bpe.decode(ids) if any(o.startswith("decoded") for o in outputs) else b""
        made = {
            "n_tokens": lambda: len(ids),
            "ids": lambda: ids,
            "offsets": lambda: bpe.offsets(ids)[:-1],
            "decoded": lambda: decoded,
            "ids_sha256": lambda: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest(),
        }
        return [made[o]() for o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [row(bpe, ids) for ids in bpe.encode_grouped(texts)]
            arrays = [pa.array([r[k] for r in rows], _OUTPUTS[o][1]) for k, o in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, *outputs])

    schema = ", ".join([f"`{key}` {documents.schema[key].dataType.simpleString()}", *(f"{o} {_OUTPUTS[o][0]}" for o in outputs)])
    return documents.select(documents[key].alias("key"), documents[text].alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the bytes that the ids stand for; null ids stand for none. An id beyond the file is an error."""
    ready_workers(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.array(row or [], np.int64)) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], [key, "decoded"])

    schema = f"`{key}` {encoded.schema[key].dataType.simpleString()}, decoded binary"
    return encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids")).mapInArrow(run, schema)


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_ranks(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
