"""Exact removal of repeated byte strings across documents, with suffix arrays per shard.

A byte goes if a string of `length` bytes covers it that also starts earlier: in a smaller doc_id, or in the same
document further left. Defined results: null text is empty; a null doc_id comes after all others; rows that share
a doc_id count as the same document, and at the same place neither is earlier, so repeated rows keep their text; texts shorter
than `length` stay whole; an empty table gives no rows; extra columns are ignored.

1. Anchors: from each window the least hash of its 32-byte strings, strings frequent in some slice of the corpus after all
   others. Equal windows have equal anchors. The hashes that occur twice in the corpus are counted exactly by shuffle and set a filter of fixed size, which is broadcast; false
   positives only cost time.
2. Stretches of windows with one anchor that passes the filter go, as text, to the shard of their anchor's
   hash. Equal stretches of one task travel once, so a passage that a third of all documents share reaches its
   shard once per task, and is taken once there.
3. A shard's different stretches whose anchor can be met again, in order of document and place, form texts of bounded size. Each gets a suffix array and
   common prefixes; a window that repeats an earlier one goes, and the first of each class is looked up in the arrays before it
   by binary search.
4. The places that go meet their documents again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyledger.llm.suffix_array import found_in, window_classes
from tallyledger.llm.text import ready_workers, table
from tallyledger.llm.words import finish
from tallyledger.sources.scratch import written_once

LENGTH = 100
_GRAM = 32
# The filter's size in bits whatever the input: 32 MB.
FILTER_BITS = 28
# Strings of 32 bytes that occur so often in one slice are frequent; their filter's size in bits: 4 MB.
FREQUENT = 4
FREQUENT_BITS = 25
# Bytes of text that numpy works on at once, that one suffix array covers at most, and that make one more shard.
SLICE = 1 << 20
ARRAY_BYTES = 1 << 21
SHARD_BYTES = 1 << 22
# A task sends on what it has gathered at this size.
GATHERED_BYTES = 1 << 25
GATHERED_ANCHORS = 1 << 21
_LAST = np.iinfo(np.int64).max
_RUN = [("doc", "<i8"), ("key", "<i8"), ("at", "<i8"), ("run", "<i4")]
# sign: 32 bits of the anchor's hash; alone: the anchor stands once in the stretch, which then cannot repeat itself.
_STRETCH = [*_RUN, ("sign", "<u4"), ("alone", "?")]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a * np.uint64(0x9E3779B97F4A7C15)
    t ^= t >> np.uint64(31)
    t += b * np.uint64(0xC2B2AE3D27D4EB4F)
    t ^= t >> np.uint64(29)
    t *= np.uint64(0x165667B19E3779F9)
    t ^= t >> np.uint64(32)
    return t


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every run of `width` values, by doubling."""
    out, covered = values, 1
    while covered * 2 <= width:
        out = pick(out[:-covered], out[covered:])
        covered *= 2
    return pick(out[: len(out) - (width - covered)], out[width - covered :]) if covered < width else out


def _bits_at(bits: bytes, hashes: np.ndarray, size: int) -> np.ndarray:
    at = finish(hashes) >> np.uint64(64 - size)
    return (np.frombuffer(bits, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] << (at & np.uint64(7)).astype(np.uint8) & 128) > 0


class _Slice:
    """Texts, or pieces of long ones, side by side: bytes, valid window starts, anchor of every window."""

    def __init__(self, pieces: list[tuple[int, int, int, bytes]], length: int, frequent: bytes | None = None):
        self.pieces, self.length = pieces, length
        self.data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        sizes = np.array([len(p[3]) for p in pieces])
        self.begin = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        n = len(self.data) - length + 1
        change = np.zeros(n + 1, np.int32)
        change[self.begin] += 1
        change[self.begin + windows] -= 1
        self.valid = np.cumsum(change[:n]) > 0
        eight = np.ndarray(len(self.data) - 7, "<u8", self.data.tobytes(), 0, (1,)).astype(np.uint64)
        sixteen = _mix(eight[:-8], eight[8:])
        self.grams = _mix(sixteen[:-16], sixteen[16:])
        if frequent is not None:
            # Frequent strings come after all others, so that a common line is no anchor of the text around it.
            late = _bits_at(frequent, self.grams, FREQUENT_BITS).astype(np.uint64)
            self.grams = (self.grams >> np.uint64(1)) | (late << np.uint64(63))
        self.width = length - _GRAM + 1
        self.anchor = _sliding(self.grams, self.width, np.minimum)

    def _anchor_places(self) -> np.ndarray:
        """The places that are the anchor of some window, each once."""
        inner = slice(self.width - 1, self.width - 1 + len(self.anchor))
        padded = np.zeros(len(self.anchor) + 2 * (self.width - 1), np.uint64)
        padded[inner] = np.where(self.valid, self.anchor, 0)
        most = _sliding(padded, self.width, np.maximum)
        # 0 is a hash like any other, that of 32 NULs: whether a valid window is there is told apart from it.
        held = np.zeros(len(padded), bool)
        held[inner] = self.valid
        return np.flatnonzero((most == self.grams) & _sliding(held, self.width, np.maximum))

    def frequent(self) -> np.ndarray:
        """The hashes of strings that occur FREQUENT times or more here, sorted."""
        values = np.sort(self.grams)
        often = values[FREQUENT - 1 :]
        return np.unique(often[often == values[: len(often)]])

    def anchors(self) -> np.ndarray:
        """Hash of each place that is the anchor of some window: once per place."""
        return self.grams[self._anchor_places()]

    def stretches(self, passes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window and number of windows of the runs with one anchor that passes, that anchor, and whether it stands there
        once."""
        n = len(self.anchor)
        starts = np.zeros(n, bool)
        starts[1:] = self.anchor[1:] != self.anchor[:-1]
        starts[self.begin[self.begin < n]] = True
        starts &= self.valid
        first = np.flatnonzero(starts)
        ends = np.flatnonzero(self.valid & np.append(starts[1:] | ~self.valid[1:], True))
        kept = passes(self.anchor[first])
        first, run, anchor = first[kept], ends[kept] - first[kept] + 1, self.anchor[first][kept]
        places = self._anchor_places()
        low = np.searchsorted(places, first)
        high = np.searchsorted(places, first + run - 1 + self.width)
        # Other anchors in between are few; where they are many, the stretch is not taken for alone.
        met = np.zeros(len(first), np.int64)
        for k in range(4):
            at = np.minimum(low + k, len(places) - 1)
            met += (low + k < high) & (self.grams[places[at]] == anchor)
        return first, run, anchor, (met == 1) & (high - low <= 4)


def _slices(batches: Iterator[pa.RecordBatch], length: int, frequent: bytes | None = None) -> Iterator[_Slice]:
    """Texts of at least one window, long ones in pieces that share length - 1 bytes, so that no window is lost."""
    held, size = [], 0
    for batch in batches:
        for doc, key, text in zip(*(batch.column(c) for c in ("doc", "key", "text")), strict=True):
            raw = text.as_buffer()
            if raw is None or raw.size < length:
                continue
            doc, key = doc.as_py(), key.as_py()
            for at in range(0, raw.size - length + 1, SLICE):
                piece = raw.slice(at, min(SLICE + length - 1, raw.size - at)).to_pybytes()
                held.append((doc, key, at, piece))
                size += len(piece)
                if size >= SLICE:
                    yield _Slice(held, length, frequent)
                    held, size = [], 0
    if held:
        yield _Slice(held, length, frequent)


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_LAST))).alias("doc"),
        F.xxhash64(text).alias("key"),
        F.encode(text, "UTF-8").alias("text"),
    )


def _frequent_filter(rows: DataFrame, length: int) -> bytearray:
    """Bits of the 32-byte strings that are frequent in some slice, by 16 ranges."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << FREQUENT_BITS, bool)
        for part in _slices(batches, length):
            mine[(finish(part.frequent()) >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)] = True
        if mine.any():
            parts = [np.packbits(p).tobytes() for p in mine.reshape(16, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(16), pa.int32()), pa.array(parts, pa.binary())], ["bucket", "bits"]
            )

    def both(group: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b.as_buffer(), np.uint8) for b in group.column("bits")])
        return pa.table({"bucket": group.column("bucket")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    found = rows.mapInArrow(find, "bucket int, bits binary").groupBy("bucket").applyInArrow(both, "bucket int, bits binary")
    size = (1 << FREQUENT_BITS) // 8 // 16
    out = bytearray(16 * size)
    for row in found.collect():  # as large as the filter, whatever the input
        out[row["bucket"] * size : (row["bucket"] + 1) * size] = row["bits"]
    return out


def _repeated_filter(rows: DataFrame, length: int, total: int, frequent=None) -> bytearray:
    """Bits of the anchors that occur twice or more in the corpus; frequent: the broadcast filter of frequent strings."""
    bucket_bits = min(max(math.ceil(math.log2(max(total, 1) / 32 / GATHERED_ANCHORS + 1)), 4), 16)
    shift = np.uint64(64 - bucket_bits)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            # Anchors are minima, so their top bits are mostly 0; mixed, they fill all buckets and the whole filter.
            values = np.sort(finish(np.concatenate(held)))
            # Each value once or, if it was met again, twice: all that counting needs.
            kept = np.ones(len(values), bool)
            kept[2:] = values[2:] != values[:-2]
            values = values[kept]
            cuts = np.searchsorted(values >> shift, np.arange((1 << bucket_bits) + 1))
            made = [(b, values[cuts[b] : cuts[b + 1]].tobytes()) for b in range(1 << bucket_bits) if cuts[b] < cuts[b + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], ["bucket", "values"]
            )

        held, size = [], 0
        for part in _slices(batches, length, frequent and frequent.value):
            held.append(part.anchors())
            size += len(held[-1])
            if size >= GATHERED_ANCHORS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def count(group: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([np.frombuffer(v.as_buffer(), "<u8") for v in group.column("values")]))
        twice = np.unique(values[1:][values[1:] == values[:-1]])
        bits = np.zeros(1 << (FILTER_BITS - bucket_bits), bool)
        bits[(twice >> np.uint64(64 - FILTER_BITS)).astype(np.int64) & (len(bits) - 1)] = True
        return pa.table({"bucket": group.column("bucket")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    gathered = rows.mapInArrow(gather, "bucket int, values binary")
    counted = gathered.groupBy("bucket").applyInArrow(count, "bucket int, bits binary")
    size = (1 << FILTER_BITS) // 8 >> bucket_bits
    bits = bytearray((1 << FILTER_BITS) // 8)
    for row in counted.collect():  # as large as the filter, whatever the input
        bits[row["bucket"] * size : (row["bucket"] + 1) * size] = row["bits"]
    return bits


def _whole_repeats(rows: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order of document and place: those to look at further, and those that equal an earlier one as a whole."""
    order = np.lexsort((rows["at"], rows["doc"]))
    first: dict[bytes, int] = {}
    repeat = np.zeros(len(rows), bool)
    for k in order.tolist():
        if (f := first.setdefault(texts[k], k)) != k:
            # Rows that share doc_id and place are one place: not earlier than each other.
            repeat[k] = rows["doc"][f] != rows["doc"][k] or rows["at"][f] != rows["at"][k]
    return order[~repeat[order]], order[repeat[order]]


def _runs_of(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), _RUN)
    for name, _ in _RUN:
        out[name] = rows[name]
    return out


def _can_repeat(rows: np.ndarray) -> np.ndarray:
    """Of different stretches, those that share an anchor with another or hold theirs twice: equal windows have equal anchors."""
    _, of, met = np.unique(rows["sign"], return_inverse=True, return_counts=True)
    return (met[of] > 1) | ~rows["alone"]


def _sent(held: list[tuple[np.ndarray, list[bytes], np.ndarray]], shards: int) -> Iterator[tuple[int, bytes, bytes]]:
    """What a task has gathered, by shard: stretches and their text, compressed. Of equal stretches only the earliest goes to the
    shard; those after it repeat it, and go without text to a negative shard, which only passes them on."""
    rows = np.concatenate([h[0] for h in held])
    texts = [t for h in held for t in h[1]]
    shard = (np.concatenate([h[2] for h in held]) % np.uint64(shards)).astype(np.int64)
    rest, gone = _whole_repeats(rows, texts)
    if len(gone):
        yield -1 - int(rows["key"][gone[0]]) % shards, _runs_of(rows[gone]).tobytes(), b""
    rest = rest[np.argsort(shard[rest], kind="stable")]
    cuts = np.searchsorted(shard[rest], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        part = rest[cuts[s] : cuts[s + 1]]
        data = pa.compress(b"".join(texts[k] for k in part.tolist()), "zstd", asbytes=True)
        yield s, rows[part].tobytes(), data


def _shard_repeats(rows: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """Of a shard's stretches in order of document and place: the runs of windows that repeat an earlier window."""
    found, arrays, at = [], [], 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (size == 0 or size + len(texts[end]) <= ARRAY_BYTES):
            size += len(texts[end])
            end += 1
        part = rows[at:end]
        text = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        run = part["run"].astype(np.int64)
        of = np.repeat(np.arange(len(part)), run)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(run) - run, run)
        starts = np.repeat(np.cumsum(run + length - 1) - (run + length - 1), run) + inside
        doc, place = part["doc"][of], part["at"][of] + inside
        leftmost, firsts = window_classes(text, starts, length)
        # Where each class is met first, by its leftmost place here: in this array, or in one before it.
        origin = np.zeros((2, len(text)), np.int64)
        origin[0, starts], origin[1, starts] = doc, place
        arrays.append((text, firsts, origin[:, firsts]))
        left = firsts
        for other, windows, met in arrays[:-1]:
            hit = found_in(text, left, other, windows, length)
            origin[:, left[hit >= 0]] = met[:, hit[hit >= 0]]
            left = left[hit < 0]
        # Rows that share doc_id and place are one place: not earlier than each other.
        repeats = (origin[0, leftmost] != doc) | (origin[1, leftmost] != place)
        found.append(_runs(part, of, inside, repeats))
        at = end
    return np.concatenate(found) if found else np.empty(0, _RUN)


def _runs(part: np.ndarray, of: np.ndarray, inside: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    where = np.flatnonzero(repeats)
    if not len(where):
        return np.empty(0, _RUN)
    begins = np.ones(len(where), bool)
    begins[1:] = (where[1:] != where[:-1] + 1) | (of[where[1:]] != of[where[:-1]])
    first = where[begins]
    out = np.empty(len(first), _RUN)
    out["doc"], out["key"] = part["doc"][of[first]], part["key"][of[first]]
    out["at"] = part["at"][of[first]] + inside[first]
    out["run"] = np.diff(np.append(np.flatnonzero(begins), len(where)))
    return out


def _unpacked(runs: np.ndarray) -> pa.Table:
    names = ("doc", "key", "at", "run")
    return pa.table({c: pa.array(runs[c]) for c in names})


def repeated_runs(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, key (hash of the text), at, run: from byte `at`, `run` windows one after another that start earlier elsewhere."""
    if length < _GRAM + 8:
        raise ValueError(f"length must be at least {_GRAM + 8} bytes")
    spark = documents.sparkSession
    ready_workers(spark)
    rows = _rows(documents)
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(total // SHARD_BYTES, 1)
    frequent = spark.sparkContext.broadcast(_frequent_filter(rows, length))
    filter_ = spark.sparkContext.broadcast(_repeated_filter(rows, length, total, frequent))

    def passes(anchors: np.ndarray) -> np.ndarray:
        return _bits_at(filter_.value, anchors, FILTER_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held) -> pa.RecordBatch:
            made = list(_sent(held, shards))
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], ["shard", "stretches", "texts"]
            )

        held, size = [], 0
        for part in _slices(batches, length, frequent.value):
            first, run, anchor, alone = part.stretches(passes)
            if not len(first):
                continue
            of = np.searchsorted(part.begin, first, "right") - 1
            stretch = np.empty(len(first), _STRETCH)
            pieces = part.pieces
            stretch["doc"] = np.array([p[0] for p in pieces], np.int64)[of]
            stretch["key"] = np.array([p[1] for p in pieces], np.int64)[of]
            stretch["at"] = np.array([p[2] for p in pieces], np.int64)[of] + first - part.begin[of]
            stretch["run"], stretch["alone"] = run, alone
            stretch["sign"] = anchor & np.uint64(0xFFFFFFFF)
            raw = part.data.tobytes()
            texts = [raw[a : a + r + length - 1] for a, r in zip(first.tolist(), run.tolist(), strict=True)]
            held.append((stretch, texts, anchor))
            size += int(run.sum()) + len(run) * (length - 1)
            if size >= GATHERED_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def repeats(group: pa.Table) -> pa.Table:
        if group.column("shard")[0].as_py() < 0:
            return _unpacked(np.concatenate([np.frombuffer(x.as_buffer(), _RUN) for x in group.column("stretches")]))
        rows = np.concatenate([np.frombuffer(x.as_buffer(), _STRETCH) for x in group.column("stretches")])
        texts = []
        for stretches, data in zip(group.column("stretches"), group.column("texts"), strict=True):
            sizes = (np.frombuffer(stretches.as_buffer(), _STRETCH)["run"].astype(np.int64) + length - 1).tolist()
            raw, at = pa.decompress(data.as_buffer(), sum(sizes), "zstd", asbytes=True), 0
            for size in sizes:
                texts.append(raw[at : at + size])
                at += size
        rest, gone = _whole_repeats(rows, texts)
        rest = rest[_can_repeat(rows[rest])]
        found = _shard_repeats(rows[rest], [texts[k] for k in rest.tolist()], length)
        return _unpacked(np.concatenate((_runs_of(rows[gone]), found)))

    sent = rows.mapInArrow(send, "shard bigint, stretches binary, texts binary")
    found = written_once(sent.groupBy("shard").applyInArrow(repeats, "doc bigint, key bigint, at bigint, run int"))
    frequent.destroy()
    filter_.destroy()
    return found


def remove_repeats(documents: DataFrame, length: int = LENGTH, in_place: bool = False) -> DataFrame:
    """The documents' columns with n_bytes, n_removed, spans (removed: at, length; maximal) and kept (the bytes that stay).

    in_place puts what stays into text instead of kept; of a character cut in two, nothing stays. A column of the documents
    that has the name of a result gives way to it.
    """
    added = {"n_bytes": "bigint", "n_removed": "bigint", "spans": "array<struct<at: bigint, length: bigint>>"}
    if not in_place:
        added["kept"] = "binary"
    documents = documents.drop(*[c for c in documents.columns if c.lower() in added])
    runs = repeated_runs(documents, length).groupBy("doc", "key")
    runs = runs.agg(F.collect_list(F.struct("at", "run")).alias("_dedup_runs"))
    runs = runs.select(F.col("doc").alias("_dedup_doc"), F.col("key").alias("_dedup_key"), "_dedup_runs")
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_LAST)))
    joined = documents.join(runs, (doc == F.col("_dedup_doc")) & (F.xxhash64(text) == F.col("_dedup_key")), "left")
    columns = documents.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    span = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())]))

    def one(raw: bytes, runs: list[dict] | None) -> tuple[list[dict], bytes]:
        spans: list[dict] = []
        for at, run in sorted((r["at"], r["run"]) for r in runs or ()):
            end = at + run + length - 1
            if spans and at <= spans[-1]["at"] + spans[-1]["length"]:
                spans[-1]["length"] = max(spans[-1]["length"], end - spans[-1]["at"])
            else:
                spans.append({"at": at, "length": end - at})
        kept, at = [], 0
        for s in spans:
            kept.append(raw[at : s["at"]])
            at = s["at"] + s["length"]
        return spans, b"".join([*kept, raw[at:]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, all_spans, all_kept = [], [], []
            for text, runs in zip(batch.column("text"), batch.column("_dedup_runs"), strict=True):
                raw = (text.as_py() or "").encode()
                spans, kept = one(raw, runs.as_py())
                sizes.append(len(raw))
                all_spans.append(spans)
                all_kept.append(kept)
            removed = [n - len(k) for n, k in zip(sizes, all_kept, strict=True)]
            made = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(all_spans, span)]
            made.append(pa.array(all_kept, pa.binary()))
            own = {c: batch.column(c) for c in columns}
            if in_place:
                was = batch.column("text").is_null().to_pylist()
                texts = [None if null else k.decode("utf-8", "ignore") for null, k in zip(was, all_kept, strict=True)]
                own["text"] = pa.array(texts, pa.string())
                made.pop()
            yield pa.RecordBatch.from_arrays([*own.values(), *made], [*own, *added])

    return joined.select(*columns, "_dedup_runs").mapInArrow(cut, f"{schema}, {', '.join(f'{k} {v}' for k, v in added.items())}")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    removed = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return removed.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
