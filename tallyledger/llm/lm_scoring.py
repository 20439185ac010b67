"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Words are lower-cased (A-Z) between ASCII white space; every text ends with one end token. Word and bigram counts
cover all training rows. Defined results: null text is empty, so only its end token is scored; a null doc_id trains
or not by the hash of empty text; repeated rows count and are scored row by row; without training rows every count is 0 and
both scores come from the smoothing alone; a text of any length is scored whole; an empty table gives no rows; extra columns are
ignored. The probabilities of a context add up to at most 1 (false positives of the filter, of which there are few, aside).

1. Tasks cut their documents into blocks: distinct word hashes and, per token, a place among them. The table of
   blocks is written once.
2. Exact word counts: a block sends each range of hashes what it holds, ranges add up and answer each block, so a
   frequent word travels once per block.
3. Bigram counts go to segments of the filter by hash, combined per task. A count c is quantised to
   1 + floor(log2 c) levels; each level is set in the segment as a key of its own, at twelve bits a key.
4. Scoring probes level after level until one is missing. A filter within the bound is broadcast; a larger one
   stays where it was built, and the blocks' probes are sent to its segments instead, with the same answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyledger.llm.text import fold_of, ready_workers, table
from tallyledger.llm.words import BASE, finish, grouped, word_hashes
from tallyledger.sources.scratch import written_once

# Text of a block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 22
# The largest filter that is broadcast.
MAX_BROADCAST_BYTES = 128 << 20
BITS_PER_KEY, PROBES = 12, 8
# Weight of the bigram estimate: LAMBDA * c / (c + KAPPA) for a context met c times.
LAMBDA, KAPPA = 0.5, 4.0
_PER_TASK = 1 << 22
_KEY_BITS = 48
_BEGIN, _END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers in few bytes: like bytes side by side, compressed."""
    planes = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _blocks(rows: DataFrame) -> DataFrame:
    """block, docs, train, sizes (words per document), words (sorted distinct hashes), places (per token, among the words by
    frequency), ranks (the word at each place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            docs = [d for h in held for d in h[0]]
            train = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            words, places, met = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
            ranks = np.argsort(-met, kind="stable")
            by_frequency = np.empty(len(words), np.int64)
            by_frequency[ranks] = np.arange(len(words))
            row = {
                "block": pa.array([part << 32 | number], pa.int64()),
                "docs": pa.array([docs], pa.list_(pa.int64())),
                "train": pa.array([train.astype(np.uint8).tobytes()], pa.binary()),
                "sizes": pa.array([_packed(sizes)], pa.binary()),
                "words": pa.array([words.tobytes()], pa.binary()),
                "places": pa.array([_packed(by_frequency[places])], pa.binary()),
                "ranks": pa.array([_packed(ranks)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            train = np.array(batch.column("train").to_pylist(), bool)
            for begin, texts in grouped(batch.column("text")):
                hashes, sizes = word_hashes(texts)
                docs = batch.column("doc_id").slice(begin, len(texts)).to_pylist()
                held.append((docs, train[begin : begin + len(texts)], sizes, hashes))
                size += sum(map(len, texts)) + 64 * len(texts)
                if size >= BLOCK_BYTES:
                    yield closed()
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()

    return rows.mapInArrow(
        run,
        "block bigint, docs array<bigint>, train binary, sizes binary, words binary, places binary, ranks binary",
    )


class _Block:
    """One row of the table of blocks, unpacked."""

    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.train = np.frombuffer(row["train"], np.uint8) > 0
        self.sizes = _unpacked(row["sizes"]).astype(np.int64)
        self.words = np.frombuffer(row["words"], "<u8")
        self.places = _unpacked(row["ranks"]).astype(np.int64)[_unpacked(row["places"]).astype(np.int64)]

    def train_counts(self) -> np.ndarray:
        mask = np.repeat(self.train, self.sizes)
        return np.bincount(self.places[mask], minlength=len(self.words))

    def chained(self, of_word: np.ndarray, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """A value of context and of next token for every bigram: a text's n words make n + 1."""
        n = len(self.places) + len(self.sizes)
        last = np.cumsum(self.sizes + 1) - 1
        is_last = np.zeros(n, bool)
        is_last[last] = True
        after = np.empty(n, of_word.dtype)
        after[~is_last] = of_word[self.places]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        after[last] = end
        before[last - self.sizes] = begin
        return before, after

    def keys(self) -> np.ndarray:
        before, after = self.chained(self.words, _BEGIN, _END)
        return finish(finish(before * BASE) + after) >> np.uint64(64 - _KEY_BITS)

    def train_keys(self) -> np.ndarray:
        return self.keys()[np.repeat(self.train, self.sizes + 1)]


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            yield row["block"], _Block(row)


def _word_counts(blocks: DataFrame, range_bits: int) -> DataFrame:
    """block, range, counts: the corpus counts of a block's words of that range, in order; block -1: distinct words."""
    shift = np.uint64(64 - range_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in _unpack(batches):
            counts = data.train_counts()
            cuts = np.searchsorted(data.words >> shift, np.arange((1 << range_bits) + 1))
            made = [
                (r, block, data.words[a:b].tobytes(), _packed(counts[a:b]))
                for r, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
                if a < b
            ]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["range", "block", "words", "counts"])

    def add(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(w.as_buffer(), "<u8") for w in group.column("words")]
        counts = np.concatenate([_unpacked(c.as_py()) for c in group.column("counts")])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, counts).astype(np.uint64)
        cuts = np.cumsum([len(p) for p in parts])
        answers = [_packed(total[x]) for x in np.split(at, cuts[:-1])]
        range_ = group.column("range")[0].as_py()
        return pa.table(
            {
                "block": pa.array([*group.column("block").to_pylist(), -1], pa.int64()),
                "range": pa.array([range_] * (len(answers) + 1), pa.int32()),
                "counts": pa.array([*answers, _packed(np.array([(total > 0).sum()]))], pa.binary()),
            }
        )

    sent = blocks.mapInArrow(send, "range int, block bigint, words binary, counts binary")
    return sent.groupBy("range").applyInArrow(add, "block bigint, range int, counts binary")


def _levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def expected_count(levels: np.ndarray) -> np.ndarray:
    """The least of the counts with so many levels: 0, 1, 2, 4, ... More would give a context more than probability 1."""
    return np.where(levels > 0, 2.0 ** (levels - 1), 0.0)


def _segments(blocks: DataFrame, segment_bits: int) -> DataFrame:
    """segment, bits: the filter by hash range of the bigrams, each segment as large as its keys need."""
    shift = np.uint64(_KEY_BITS - segment_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys >> shift, np.arange((1 << segment_bits) + 1))
            made = []
            for s, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
                if a < b:
                    made.append((s, _packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(counts[a:b])))
            kinds = (pa.int32(), pa.binary(), pa.binary())
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(arrays, ["segment", "steps", "counts"])

        held, size = [], 0
        for _, data in _unpack(batches):
            held.append(data.train_keys())
            size += len(held[-1])
            if size >= _PER_TASK:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def build(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_unpacked(x.as_py())) for x in group.column("steps")])
        counts = np.concatenate([_unpacked(x.as_py()) for x in group.column("counts")])
        keys, at = np.unique(keys, return_inverse=True)
        levels = _levels(np.bincount(at, counts))
        size = (int(levels.sum()) * BITS_PER_KEY // 8 + 1) * 8
        bits = np.zeros(size, bool)
        for level in range(1, int(levels.max()) + 1):
            h = finish(keys[levels >= level] * BASE + np.uint64(level))
            step = finish(h) | np.uint64(1)
            for _ in range(PROBES):
                bits[h % np.uint64(size)] = True
                h += step
        data = pa.array([np.packbits(bits).tobytes()], pa.binary())
        return pa.table({"segment": group.column("segment")[:1], "bits": data})

    sent = blocks.mapInArrow(send, "segment int, steps binary, counts binary")
    return sent.groupBy("segment").applyInArrow(build, "segment int, bits binary")


def _probe(keys: np.ndarray, bits: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Levels of each key in its segment, which begins at bit `begin` and has `sizes` bits: probed upwards until one is
    missing."""
    levels = np.zeros(len(keys), np.int64)
    live, level = np.flatnonzero(sizes > 0), 0
    while len(live):
        level += 1
        h = finish(keys[live] * BASE + np.uint64(level))
        step = finish(h) | np.uint64(1)
        for _ in range(PROBES):
            place = (h % sizes[live].astype(np.uint64)).astype(np.int64) + begin[live]
            hit = (bits[place >> 3] << (place & 7).astype(np.uint8) & 128) > 0
            live, h, step = live[hit], h[hit], step[hit]
            h += step
        levels[live] = level
    return levels


def _scores(block: _Block, counts: np.ndarray, levels: np.ndarray, total: int, distinct: int, ends: int) -> pa.Table:
    """A row per document of the block. counts: corpus counts of the block's words; ends: training documents."""
    n_docs = len(block.sizes)
    before, after = block.chained(counts.astype(np.float64), float(ends), float(ends))
    of = np.repeat(np.arange(n_docs), block.sizes + 1)
    plain = (after + 0.5) / (total + 0.5 * (distinct + 1))
    weight = LAMBDA * before / (before + KAPPA)
    seen = np.minimum(expected_count(levels), np.minimum(before, after))
    smoothed = weight * seen / np.maximum(before, 1) + (1 - weight) * plain
    per_doc = lambda x: np.bincount(of, x, n_docs)
    return pa.table(
        {
            "doc_id": pa.array(block.docs, pa.int64()),
            "held_out": pa.array(~block.train),
            "n_tokens": pa.array(block.sizes + 1),
            "n_known": pa.array(per_doc(after > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(n_docs, total, np.int64)),
            "base_score": pa.array(per_doc(np.log10(plain))),
            "score": pa.array(per_doc(np.log10(smoothed))),
        }
    )


_RESULT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def _power_of_two(x: float) -> int:
    """Bits for at least x parts, 16 of them at least."""
    return max(int(np.ceil(np.log2(max(x, 1)))), 4)


def score_documents(documents: DataFrame, train: Column, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A row per document: held_out, n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    spark = documents.sparkSession
    ready_workers(spark)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", train.alias("train"))
    blocks = written_once(_blocks(rows))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _unpack(batches):
            words = int(data.sizes[data.train].sum())
            row = {"words": [words], "docs": [int(data.train.sum())], "entries": [len(data.words)]}
            yield pa.RecordBatch.from_pydict(row)

    sizes = blocks.mapInArrow(measure, "words bigint, docs bigint, entries bigint")
    words, ends, entries = (x or 0 for x in sizes.agg(F.sum("words"), F.sum("docs"), F.sum("entries")).first())
    total = words + ends
    counts = written_once(_word_counts(blocks, min(_power_of_two(entries / (1 << 20)), 20)))
    found = counts.where("block = -1").select("counts").collect()  # one small row per range
    distinct = sum(int(_unpacked(r["counts"])[0]) for r in found) + (ends > 0)
    segment_bits = min(_power_of_two(total / (1 << 21)), 24)
    segments = written_once(_segments(blocks, segment_bits))
    needed = segments.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    shift = np.uint64(_KEY_BITS - segment_bits)
    answers = counts.where("block >= 0")

    def counts_of(table: pa.Table) -> np.ndarray:
        parts = sorted(zip(table.column("range").to_pylist(), table.column("counts").to_pylist(), strict=True))
        return np.concatenate([np.zeros(0, np.uint64), *(_unpacked(c) for _, c in parts)])

    def one(table: pa.Table) -> _Block:
        return _Block({c: table.column(c)[0].as_py() for c in table.schema.names})

    if needed <= max_broadcast:
        begin = np.zeros(1 << segment_bits, np.int64)
        size = np.zeros(1 << segment_bits, np.int64)
        data = bytearray()
        for row in segments.toLocalIterator():
            begin[row["segment"]], size[row["segment"]] = len(data) * 8, len(row["bits"]) * 8
            data += row["bits"]
        shared = spark.sparkContext.broadcast((bytes(data), begin, size))
        del data

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            bits, begin, size = shared.value
            block = one(left)
            keys = block.keys()
            at = (keys >> shift).astype(np.int64)
            levels = _probe(keys, np.frombuffer(bits, np.uint8), begin[at], size[at])
            return _scores(block, counts_of(right), levels, total, distinct, ends)

        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _RESULT)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, data in _unpack(batches):
            keys = data.keys()
            keys = keys[np.argsort(keys >> shift, kind="stable")]
            cuts = np.searchsorted(keys >> shift, np.arange((1 << segment_bits) + 1))
            made = [(s, number, keys[cuts[s] : cuts[s + 1]].tobytes()) for s in np.flatnonzero(np.diff(cuts)).tolist()]
            kinds = (pa.int32(), pa.int64(), pa.binary())
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["segment", "block", "keys"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        bits = np.frombuffer(left.column("bits")[0].as_buffer(), np.uint8) if left.num_rows else np.zeros(0, np.uint8)
        made = []
        for keys in right.column("keys"):
            k = np.frombuffer(keys.as_buffer(), "<u8")
            made.append(_probe(k, bits, np.zeros(len(k), np.int64), np.full(len(k), len(bits) * 8)).astype(np.uint8).tobytes())
        return pa.table(
            {"block": right.column("block"), "range": right.column("segment"), "counts": pa.array(made, pa.binary())}
        )

    asked = blocks.mapInArrow(ask, "segment int, block bigint, keys binary").groupBy("segment")
    probed = segments.groupBy("segment").cogroup(asked).applyInArrow(answer, "block bigint, range int, counts binary")
    both = answers.withColumn("what", F.lit(0)).unionByName(probed.withColumn("what", F.lit(1)))

    def score_asked(left: pa.Table, right: pa.Table) -> pa.Table:
        block = one(left)
        what = np.array(right.column("what").to_pylist())
        told = right.filter(pa.array(what == 1))
        parts = sorted(zip(told.column("range").to_pylist(), told.column("counts").to_pylist(), strict=True))
        levels = np.empty(len(block.places) + len(block.sizes), np.int64)
        levels[np.argsort(block.keys() >> shift, kind="stable")] = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
        return _scores(block, counts_of(right.filter(pa.array(what == 0))), levels, total, distinct, ends)

    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score_asked, _RESULT)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(documents, fold_of(F.col("doc_id"), 5) != 1)
