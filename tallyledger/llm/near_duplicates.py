"""N-gram Jaccard join: MinHash bands find candidates, whole n-gram sets decide.

Words are lower-cased (A-Z) and separated by ASCII white space; an n-gram is five of them, or all of a shorter text.
Defined results: null text, empty text and text without words have no n-grams and link to nothing; texts with the
same words are copies and link to each other; rows that share a doc_id are one document and share a class; null
doc_ids are one document; an empty table gives no rows; extra columns are ignored.

1. Every text gives a hash of its words and band hashes of its MinHash signature; equal texts become one node.
2. A shuffle on band hashes ties each node to the least of its band; connected components of these ties hold every
   pair that shares a band. Totals combine before the shuffle, no band's pairs are listed.
3. Components meet with their whole n-gram sets. A large one is cut in blocks, each pair of blocks a task, in which
   products of membership matrices count what sets share. Tasks give links per node and a spanning tree, not pairs.
4. Components of the verified links are the classes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyledger.llm.components import connected_components
from tallyledger.llm.text import ready_workers, table
from tallyledger.llm.words import BASE, finish, grouped, powers, word_hashes
from tallyledger.sources.scratch import written_once

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.99999
MOST_HASHES = 160
# Nodes of a block; two blocks and their n-gram sets are one task.
BLOCK = 256
# Small components that share a task, in nodes.
TOGETHER = 2000
_COLUMNS = 4096
_LAST = np.iinfo(np.int64).max


def bands_for(similarity: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows, then the fewest bands, with which a pair at the threshold shares a band with
    probability `recall` or more."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError(f"no {most} hashes reach a recall of {recall}")


def ngram_hashes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' n-grams (in order, repeats included), how many each text has, and a hash of each text's words."""
    word, n_words = word_hashes(texts)
    word_begin = np.cumsum(n_words) - n_words
    place = np.arange(len(word)) - np.repeat(word_begin, n_words)
    weight = powers(int(n_words.max(initial=0)) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * weight[place])))
    whole = finish(sums[word_begin + n_words] - sums[word_begin] + n_words.astype(np.uint64))
    n_grams = np.where(n_words >= n, n_words - n + 1, np.minimum(n_words, 1))
    of = np.repeat(np.arange(len(texts)), n_words)
    full = place + n <= np.repeat(n_words, n_words)
    short = (np.repeat(n_words, n_words) < n) & (place == 0)
    at = np.flatnonzero(full | short)
    gram = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = full[at]
        gram = np.where(inside, gram * BASE + word[np.minimum(at + k, len(word) - 1)], gram)
    gram = np.where(full[at], gram, whole[of[at]])
    return finish(gram), n_grams, whole


@functools.lru_cache(maxsize=4)
def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def band_hashes(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each text with n-grams."""
    own = counts[counts > 0]
    begin = np.cumsum(own) - own
    out = np.empty((len(own), bands), np.uint64)
    a, b = _coefficients(bands * rows)
    for band in range(bands):
        code = np.full(len(own), band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            code = code * BASE + np.minimum.reduceat(grams * a[k] + b[k], begin)
        out[:, band] = finish(code)
    return out


def _signed(documents: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (its id, never null), same (hash of the words), grams (0 for texts without words), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in grouped(batch.column("text")):
                grams, counts, whole = ngram_hashes(texts, n)
                made = iter(band_hashes(grams, counts, bands, rows).view(np.int64))
                per_text = [next(made) if c else None for c in counts.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, len(texts)),
                        pa.array(whole.view(np.int64)),
                        pa.array(counts),
                        pa.array(per_text, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "same", "grams", "bands"],
                )

    signed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, same bigint, grams bigint, bands array<bigint>"
    )
    return signed.withColumn("node", F.coalesce("doc_id", F.lit(int(_LAST))))


def _verified(ids: np.ndarray, weights: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float):
    """Per node with links: weight of its links and the least node of those it hangs together with here.

    side: which of two blocks a node is of; with two, only pairs across are looked at.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = met[column] > 1
    owner, column = owner[shared], np.cumsum(met > 1)[column[shared]] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    total = int((met > 1).sum())
    for low in range(0, total, _COLUMNS):
        a, b = np.searchsorted(column, (low, low + _COLUMNS))
        member = np.zeros((len(sets), min(_COLUMNS, total - low)), np.float32)
        member[owner[a:b], column[a:b] - low] = 1
        common += (member @ member.T).astype(np.int64)  # at most _COLUMNS: exact
    # In integers, so that a pair exactly at the similarity p / q is linked: common / (a + b - common) >= p / q.
    ratio = Fraction(similarity).limit_denominator(1_000_000)
    p, q = ratio.numerator, ratio.denominator
    linked = common * (p + q) >= p * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    links = linked @ weights
    root = ids.copy()
    while True:
        least = np.where(linked, root[None, :], _LAST).min(1, initial=_LAST)
        fresh = np.minimum(root, least)
        if (fresh == root).all():
            break
        root = fresh
    some = links > 0
    return ids[some], links[some], root[some]


def similarity_classes(
    documents: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_links (other documents at the similarity or above), n_copies
    (documents with the same words, itself included), n_grams: one row for each row of the input."""
    spark = documents.sparkSession
    ready_workers(spark)
    bands, rows = bands_for(similarity, recall)
    signed = written_once(_signed(documents, n, bands, rows))
    nodes = signed.where("grams > 0").groupBy("same").agg(
        F.min("node").alias("node"), F.count(F.lit(1)).alias("weight"), F.any_value("bands").alias("bands")
    )
    nodes = written_once(nodes)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ties = banded.join(least.select("band", "least"), "band").select(F.col("node").alias("a"), F.col("least").alias("b"))
    parts = connected_components(ties)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    members = (
        parts.join(sizes, "component")
        .join(nodes.select("node", "weight"), "node")
        .select("node", "component", "weight", blocks.alias("blocks"), F.col("members"))
    )
    members = written_once(members)
    tasks = max(int((members.agg(F.count(F.lit(1))).first()[0] or 0) // TOGETHER), 1)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    whole = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_LAST))).alias("node"), "text")
    texts = whole.join(members, "node").select("node", "component", "weight", "blocks", mine.alias("mine"), "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ["node", "component", "weight", "blocks", "mine"]
        for batch in batches:
            for begin, some in grouped(batch.column("text")):
                grams, counts, _ = ngram_hashes(some, n)
                cuts = np.cumsum(counts)
                packed = [np.unique(grams[e - c : e]).tobytes() for e, c in zip(cuts.tolist(), counts.tolist(), strict=True)]
                columns = [batch.column(c).slice(begin, len(some)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], [*keep, "grams"])

    sets = texts.mapInArrow(sets_of, "node bigint, component bigint, weight bigint, blocks int, mine int, grams binary")
    dealt = sets.where("octet_length(grams) > 0").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    single = F.col("blocks") == 1
    dealt = dealt.select(
        F.when(single, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component")).alias("task"),
        F.when(single, F.lit(-1)).otherwise(F.least("mine", "other")).alias("low"),
        F.when(single, F.lit(-1)).otherwise(F.greatest("mine", "other")).alias("high"),
        "component",
        "node",
        "weight",
        "mine",
        "grams",
    )

    def verify(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        component = group.column("component").to_numpy()
        node, weight, mine = (group.column(c).to_numpy() for c in ("node", "weight", "mine"))
        grams = [g.as_py() for g in group.column("grams")]
        # The same node with the same set comes twice where its row is repeated.
        seen: dict[tuple, int] = {}
        for k in range(len(node)):
            seen.setdefault((component[k], node[k], grams[k]), k)
        kept = np.array(sorted(seen.values()))
        kept = kept[np.argsort(component[kept], kind="stable")]
        cuts = np.flatnonzero(np.diff(component[kept], prepend=component[kept[0]] - 1))
        found = []
        for part in np.split(kept, cuts[1:]):
            side = (mine[part] == high) if low != high else np.zeros(len(part), bool)
            found.append(
                _verified(node[part], weight[part], side, [np.frombuffer(grams[k], "<u8") for k in part.tolist()], similarity)
            )
        ids, links, roots = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"node": ids, "links": links.astype(np.int64), "root": roots})

    linked = written_once(
        dealt.groupBy("task", "low", "high").applyInArrow(verify, "node bigint, links bigint, root bigint")
    )
    classes = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    copies = nodes.select(F.col("same").alias("_same"), F.col("node").alias("_node"), "weight")
    about = (
        copies.join(links, copies["_node"] == links["node"], "left")
        .drop("node")
        .join(classes, F.col("_node") == classes["node"], "left")
        .select("_same", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "_node").alias("class"))
    )
    out = signed.join(about, (F.col("same") == F.col("_same")) & (F.col("grams") > 0), "left")
    class_id = F.nullif(F.coalesce("class", "node"), F.lit(int(_LAST)))
    return out.select(
        "doc_id",
        class_id.alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("weight", F.lit(1)).cast("bigint").alias("n_copies"),
        F.col("grams").alias("n_grams"),
    )


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
