"""Ranked search over an index of bit-sliced signatures, with exact scores.

Terms are runs of ASCII digits, letters (A-Z lower-cased) and anything beyond ASCII.

1. build_index: a task gives every text the keys (term, level) for each level of LEVELS that the term's count reaches,
   groups texts of like size, and writes a group's Bloom signatures by slices: the row of a bit is a bitmap of documents.
   Beside them it counts how many of its texts hold each term. Both are one written table, as long as the corpus.
2. Queries are taken in blocks of about QUERIES. For a block, a scan of the slices ANDs the rows of each key; a bitmap holds
   every document that has the key, and some that do not. The levels add up to the largest count a term can have, its
   weight makes that a gain, and the gains of a query's terms add up to the largest score a document can have.
3. The few documents with the highest bounds are scored exactly, which gives each query a score to beat. A second scan
   keeps every document whose bound reaches it: the others are provably not among the first.
4. What is kept is scored exactly from its text. Only texts whose bits are set in a filter of at most FILTER_BITS travel.

Defined results: null texts and texts without a term are no documents; queries without a term have no rows. Repeated rows are
ranked row by row; among equal scores the smaller key goes first, null last. Queries are distinct pairs of key and terms, so a
repeated one counts once and one key with two texts has two lists. Very long texts share a signature of at most 2^LARGEST
bits, whose bits may all be set: then they are scored exactly. Extra columns are ignored; empty tables give no rows.
Keys of documents are whole numbers. Counts of documents by term go by 64-bit hashes of terms; scores by the terms.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyledger.llm.text import NOT_ALNUM, ascii_lower, ready_workers, split_words, table
from tallyledger.llm.words import finish, word_hashes
from tallyledger.sources.scratch import written_once

# Everything in ASCII but digits and letters separates terms.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_SPLIT = bytes(32 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
# Counts a signature tells apart: 1, 2, 3, 4, 6, 8, 12, 16, 24, ...
LEVELS = np.array([1, *(x for p in range(1, 32) for x in (1 << p, 3 << (p - 1)))], np.int64)
BITS_PER_KEY, PROBES = 16, 5
# Signatures have 2^SMALLEST to 2^LARGEST bits; a group has at most GROUP documents and about 2^GROUP_BITS bits.
SMALLEST, LARGEST, GROUP, GROUP_BITS = 8, 22, 4096, 24
# Entries of a task's term counts before they are handed on.
HELD_TERMS = 1 << 20
# Queries of a block, and documents scored for the first score to beat, beyond the rows asked for.
QUERIES, MORE = 256, 6
_TERMS_TOGETHER = 512
FILTER_BITS = 1 << 27


def _keys(terms: np.ndarray, level: np.ndarray) -> np.ndarray:
    return finish(terms + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _rows_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The rows of each key in a signature of 2^bits bits, a column for each probe."""
    mask = np.uint64((1 << bits) - 1)
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return ((keys[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & mask).astype(np.int64)


class _Groups:
    """Documents waiting for their group to fill, by the size of their signature."""

    def __init__(self) -> None:
        self.waiting: dict[int, list[tuple]] = {}

    def add(self, doc: int | None, check: int, n: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = min(max(math.ceil(math.log2(BITS_PER_KEY * len(keys))), SMALLEST), LARGEST)
        group = self.waiting.setdefault(bits, [])
        group.append((doc, check, n, keys))
        if len(group) >= min(GROUP, max(8, 1 << GROUP_BITS >> bits)):
            yield self.closed(bits)

    def closed(self, bits: int) -> pa.RecordBatch:
        group = self.waiting.pop(bits)
        width = -(-len(group) // 8)
        flat = np.zeros((1 << bits, width * 8), bool)
        for place, (_, _, _, keys) in enumerate(group):
            flat[_rows_of(keys, bits), place] = True
        return pa.RecordBatch.from_pydict(
            {
                "term": pa.array([None], pa.int64()),
                "df": pa.array([None], pa.int64()),
                "docs": pa.array([[g[0] for g in group]], pa.list_(pa.int64())),
                "checks": pa.array([[g[1] for g in group]], pa.list_(pa.int64())),
                "sizes": pa.array([[g[2] for g in group]], pa.list_(pa.int64())),
                "slices": pa.array([np.packbits(flat, 1).tobytes()], pa.binary()),
            }
        )


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return terms, np.bincount(index, np.concatenate([p[1] for p in parts])).astype(np.int64)


@dataclass(frozen=True)
class Index:
    """The written table of slices and term counts, documents with a term, and terms of all texts with repeats."""

    rows: DataFrame
    n_docs: int
    n_terms: int


_INDEX = "term bigint, df bigint, docs array<bigint>, checks array<bigint>, sizes array<bigint>, slices binary"


def _named(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text and a hash of the text, by which a row is found again."""
    return documents.select(
        documents[key].cast("bigint").alias("doc"),
        F.xxhash64(documents[text]).alias("check"),
        documents[text].cast("binary").alias("text"),
    )


def build_index(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    ready_workers(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, parts, entries = _Groups(), [], 0

        def told() -> pa.RecordBatch:
            terms, df = _counted(parts)
            none = pa.nulls(len(terms))
            arrays = [pa.array(terms.view(np.int64)), pa.array(df), *(none.cast(t) for t in [pa.list_(pa.int64())] * 3), none.cast(pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["term", "df", "docs", "checks", "sizes", "slices"])

        for batch in batches:
            docs, checks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, texts in _byte_groups(batch.column(2)):
                hashes, sizes = word_hashes(texts, SEPARATORS)
                if not len(hashes):
                    continue
                terms, index = np.unique(hashes, return_inverse=True)
                of = np.repeat(np.arange(len(texts)), sizes)
                pairs, counts = np.unique(of * len(terms) + index, return_counts=True)
                doc, term = np.divmod(pairs, len(terms))
                levels = np.searchsorted(LEVELS, counts, "right")
                ends = np.cumsum(levels)
                level = np.arange(ends[-1]) - np.repeat(ends - levels, levels)
                keys = _keys(np.repeat(terms[term], levels), level)
                edges = np.searchsorted(np.repeat(doc, levels), np.arange(len(texts) + 1))
                for k in np.flatnonzero(sizes).tolist():
                    yield from groups.add(docs[begin + k], checks[begin + k], int(sizes[k]), keys[edges[k] : edges[k + 1]])
                parts.append((terms, np.bincount(term, minlength=len(terms))))
                entries += len(terms)
                if entries > HELD_TERMS:
                    parts = [_counted(parts)]
                    entries = len(parts[0][0])
                    if entries > HELD_TERMS // 2:
                        yield told()
                        parts, entries = [], 0
        for bits in sorted(groups.waiting):
            yield groups.closed(bits)
        if parts:
            yield told()

    rows = written_once(_named(documents, key, text).mapInArrow(run, _INDEX))
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sums = rows.where("slices IS NOT NULL").agg(F.sum(F.size("docs")), F.sum(total)).first()
    return Index(rows, int(sums[0] or 0), int(sums[1] or 0))


def _byte_groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a binary column, a bounded number of bytes at a time, and where in the batch each lot begins."""
    begin, held, size = 0, [], 0
    for k, value in enumerate(column):
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= 1 << 20:
            yield begin, held
            begin, held, size = k + 1, [], 0
    if held:
        yield begin, held


def gain(tf: np.ndarray | int, m: np.ndarray | int):
    """What a term met tf times adds, per weight, in a document of relative length m; whole numbers, rounded down."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class _Block:
    """Some queries: their distinct terms with hashes and weights, (query, term, times) and the score and key to beat."""

    terms: list[bytes]
    hashes: np.ndarray
    weights: np.ndarray
    wanted: list[list[tuple[int, int]]]
    n_docs: int
    n_terms: int
    least: list[int] = field(default_factory=list)
    last: list[int | None] = field(default_factory=list)

    def relative_length(self, n):
        return 25 + 75 * n * self.n_docs // self.n_terms

    @functools.cached_property
    def times(self) -> np.ndarray:
        out = np.zeros((len(self.wanted), len(self.terms)))
        for q, terms in enumerate(self.wanted):
            for t, k in terms:
                out[q, t] = k
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "times"}

    def bounds(self, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """The largest score that each document of a group can have for each query: whole numbers, exact in doubles."""
        width = -(-len(sizes) // 8)
        rows = np.frombuffer(slices, np.uint8).reshape(-1, width)
        bits = len(rows).bit_length() - 1
        m = self.relative_length(sizes)
        out = np.zeros((len(self.wanted), len(sizes)))
        for a in range(0, len(self.terms), _TERMS_TOGETHER):
            hashes = self.hashes[a : a + _TERMS_TOGETHER]
            levels = np.zeros((len(hashes), width * 8), np.uint8)
            some, held = np.arange(len(hashes)), None
            for level in range(len(LEVELS)):
                found = np.bitwise_and.reduce(rows[_rows_of(_keys(hashes[some], np.full(len(some), level)), bits)], 1)
                held = found if held is None else held & found
                any_left = held.any(1)
                some, held = some[any_left], held[any_left]
                if not len(some):
                    break
                levels[some] += np.unpackbits(held, axis=1)
            term, doc = np.nonzero(levels[:, : len(sizes)])
            # A count below the next level, and no more than all terms of the text.
            most = np.append(LEVELS[1:] - 1, np.int64(1 << 40))[levels[term, doc].astype(np.int64) - 1]
            most = np.minimum(most, sizes[doc])
            gains = np.zeros((len(hashes), len(sizes)))
            gains[term, doc] = self.weights[a + term] * gain(most, m[doc])
            out += self.times[:, a : a + _TERMS_TOGETHER] @ gains
        return out

    def scores(self, text: bytes, queries: list[int]) -> list[int]:
        counts = Counter(text.translate(_SPLIT).split())
        m = self.relative_length(counts.total())
        each: dict[int, int] = {}
        weights = self.weights.tolist()

        def of(t: int) -> int:
            if t not in each:
                tf = counts.get(self.terms[t], 0)
                each[t] = weights[t] * gain(tf, m) if tf else 0
            return each[t]

        return [sum(k * of(t) for t, k in self.wanted[q]) for q in queries]


_CANDIDATE = "query int, doc bigint, check bigint, bound bigint"


def _candidate_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query", "doc", "check", "bound"])


def _groups_of(batch: pa.RecordBatch) -> Iterator[tuple[list, list, np.ndarray, bytes]]:
    for k in range(batch.num_rows):
        docs, checks, sizes, slices = (batch.column(c)[k].as_py() for c in range(4))
        yield docs, checks, np.array(sizes, np.int64), slices


def _highest(index: Index, block: _Block, most: int) -> DataFrame:
    """Of every task and query the documents with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block.wanted]
        for batch in batches:
            for docs, checks, sizes, slices in _groups_of(batch):
                bounds = block.bounds(sizes, slices)
                keep = min(most, len(docs))
                at = np.argpartition(-bounds, keep - 1, 1)[:, :keep] if keep < len(docs) else np.tile(np.arange(keep), (len(bounds), 1))
                for q, places in enumerate(at.tolist()):
                    best[q] += [(bounds[q, p], checks[p], docs[p]) for p in places if bounds[q, p] > 0]
                    if len(best[q]) > 8 * most:
                        best[q] = sorted(best[q], key=lambda b: -b[0])[:most]
        rows = [(q, d, c, int(b)) for q, held in enumerate(best) for b, c, d in sorted(held, key=lambda b: -b[0])[:most]]
        yield _candidate_batch(rows)

    found = _slices(index).mapInArrow(run, _CANDIDATE)
    first = Window.partitionBy("query").orderBy(F.desc("bound"), "doc", "check")
    return found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).drop("k")


def _possible(index: Index, block: _Block) -> DataFrame:
    """All documents that are not provably beaten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.array(block.least, np.float64)
        for batch in batches:
            for docs, checks, sizes, slices in _groups_of(batch):
                bounds = block.bounds(sizes, slices)
                at = np.argwhere(bounds >= least[:, None]).tolist()
                # With the score to beat and no more, only the keys up to that score's own can be among the first.
                rows = [
                    (q, docs[p], checks[p], int(bounds[q, p]))
                    for q, p in at
                    if bounds[q, p] > least[q] or block.last[q] is None or docs[p] is not None and docs[p] <= block.last[q]
                ]
                yield _candidate_batch(rows)

    return _slices(index).mapInArrow(run, _CANDIDATE)


def _slices(index: Index) -> DataFrame:
    return index.rows.where("slices IS NOT NULL").select("docs", "checks", "sizes", "slices")


def _bit(name: str, bits: int):
    """Place of a document in the filter."""
    return F.pmod(F.xxhash64("doc", name), F.lit(bits))


def _filter_of(candidates: DataFrame, count: int) -> bytes:
    """A bit for every candidate, in at most FILTER_BITS."""
    buckets = 1
    while buckets * 32768 < min(16 * count, FILTER_BITS):
        buckets *= 2
    place = candidates.select(_bit("check", buckets * 32768).alias("p"))
    place = place.select((F.col("p") / 32768).cast("bigint").alias("b"), (F.col("p") % 32768).alias("p"))
    out = bytearray(buckets * 4096)
    for row in place.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect():
        out[row.b * 4096 : row.b * 4096 + 4096] = row.bits
    return bytes(out)


def _scored(documents: DataFrame, candidates: DataFrame, block: _Block) -> DataFrame:
    """query, doc and exact score above 0 of every row that is a candidate."""
    candidates = written_once(candidates)
    queries = candidates.groupBy("doc", "check").agg(F.collect_set("query").alias("queries"))
    bits = _filter_of(candidates, candidates.count())
    filled = documents.sparkSession.sparkContext.broadcast(bits)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = np.frombuffer(filled.value, np.uint8)
        for batch in batches:
            p = np.asarray(batch.column(3))
            hit = is_set[p >> 3] >> (p & 7) & 1
            if hit.any():
                yield batch.select(["doc", "check", "text"]).filter(pa.array(hit > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (q, doc.as_py(), score)
                for doc, text, wanted in zip(*batch.columns, strict=True)
                for qs in [wanted.as_py()]
                for q, score in zip(qs, block.scores(text.as_py(), qs), strict=True)
                if score > 0
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["query", "doc", "score"])

    # A row is found by its bit before any text leaves its executor: all candidates, and few others.
    texts = documents.withColumn("bit", _bit("check", 8 * len(bits))).mapInArrow(passing, "doc bigint, check bigint, text binary")
    found = texts.alias("t").join(queries.alias("c"), F.expr("t.doc <=> c.doc AND t.check <=> c.check"))
    scored = found.select("t.doc", "t.text", "c.queries").mapInArrow(run, "query int, doc bigint, score bigint")
    out = written_once(scored)
    filled.destroy()
    return out


def _first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_of(index: Index, queries: list[list[str]]) -> _Block:
    """Weights come from the index's counts of the block's terms."""
    spark = index.rows.sparkSession
    terms = {t: k for k, t in enumerate(dict.fromkeys(t.encode() for q in queries for t in q))}
    hashes = word_hashes([b" ".join(terms)], SEPARATORS)[0]
    asked = spark.createDataFrame([(h,) for h in hashes.view(np.int64).tolist()], "term bigint")
    counts = index.rows.where("term IS NOT NULL").select("term", "df").join(asked, "term", "left_semi")
    df = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("df").alias("n")).collect()}
    top = 2 * index.n_docs + 2
    weights = [math.floor(1000 * math.log(top / (2 * df.get(h, 0) + 1))) for h in hashes.view(np.int64).tolist()]
    wanted = [[(terms[t], n) for t, n in Counter(t.encode() for t in q).items()] for q in queries]
    return _Block(list(terms), hashes, np.array(weights, np.int64), wanted, index.n_docs, index.n_terms)


def search(
    index: Index, documents: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "item_id"
) -> DataFrame:
    """For every query its k highest-scoring documents: query_key, rank, key, score."""
    spark: SparkSession = documents.sparkSession
    ready_workers(spark)
    named = _named(documents, key, text)
    asked = queries.select(
        queries[query_key].alias("id"), split_words(ascii_lower(queries["text"]), NOT_ALNUM).alias("terms")
    ).where(F.size("terms") > 0).distinct()
    id_type = queries.schema[query_key].dataType.simpleString()
    blocks = -(-asked.count() // QUERIES) if index.n_docs else 0
    results = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id", "terms"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        block = _block_of(index, [r.terms for r in rows])
        ahead = _first(_scored(named, _highest(index, block, k + MORE), block), k).where(F.col("rank") == k).collect()
        beat = {r.query: r for r in ahead}
        block.least = [beat[q].score if q in beat else 1 for q in range(len(rows))]
        block.last = [beat[q].doc if q in beat else None for q in range(len(rows))]
        names = spark.createDataFrame([(q, r.id) for q, r in enumerate(rows)], f"query int, id {id_type}")
        first = _first(_scored(named, _possible(index, block), block), k)
        results.append(first.join(names, "query").select(F.col("id").alias(query_key), "rank", F.col("doc").alias(key), "score"))
    if not results:
        return spark.createDataFrame([], f"`{query_key}` {id_type}, rank int, `{key}` bigint, score bigint")
    return functools.reduce(DataFrame.unionAll, results)


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return search(build_index(documents), documents, table(spark, sf_dir, "benchmark"))
