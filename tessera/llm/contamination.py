"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity with it, so a document is
first reduced to those of its shingles that occur in any item; containment of items does not
change by this, and a document without such shingles is clean. Items and reduced documents are
then partitioned by size into powers of two. For an item of q shingles contained to ``least``
in a set of up to u, their similarity is at least ``least * q / (u + q - least * q)``; this
gives the number of minima, one band each, with which a class pair misses a contained item
with probability ``MISS`` at most. Where that number is no smaller than the set itself, as for
the smallest items, every shingle is its own band, which misses nothing. Candidates are
verified on the exact sets.

Items are held in memory in blocks of bounded size; each block is one pass over the documents, whose
result is written before the next block is held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm.shared import drop, mapper, table

MISS = 1e-6
#: Shingles of items that are held in memory, and broadcast, at once.
BLOCK = 1_000_000



def _low(texts: list[str | None]) -> list[str]:
    """Lower case of all scripts, as items are often quoted in another case."""
    return [(t or "").lower() for t in texts]


def minima(sets: list[np.ndarray], functions: int) -> Iterator[np.ndarray]:
    """For each hash function the minimum over each set."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.int64)
    x = np.concatenate(sets)
    for k in range(functions):
        a = S.mix(np.array([2 * k + 1], np.uint64))[0] | np.uint64(1)
        b = S.mix(np.array([2 * k + 2], np.uint64))[0]
        yield np.minimum.reduceat(S.mix(x * a + b), starts)


def bands(size_class: int, item_class: int, least: float) -> int:
    """Minima for a document class (sizes from 2**c) and an item class; 0 if every shingle is a band."""
    u, q = (2 << size_class) - 1, 1 << item_class
    j = min(1.0, least * q / (u + q - least * q))
    n = math.ceil(math.log(MISS) / math.log1p(-j)) if j < 1 else 1
    return 0 if n >= u else n


@dataclass
class Items:
    """A block of items: their sets, and for each class pair met the bands."""

    ids: np.ndarray
    sets: list[np.ndarray]
    least: float

    def __post_init__(self) -> None:
        self.universe = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.universe >> np.uint64(42)).astype(np.int64)] = True
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.classes.setdefault(len(s).bit_length() - 1, []).append(i)
        self._made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def shared(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes occur in an item."""
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(42)).astype(np.int64)])
        at = np.searchsorted(self.universe, hashes[maybe])
        at[at == len(self.universe)] = 0
        return maybe[self.universe[at] == hashes[maybe]] if len(self.universe) else maybe[:0]

    def _bands(self, item_class: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted band keys of the items of a class and the item of each; made once for each number of bands."""
        got = self._made.get((item_class, n))
        if got is None:
            mine = self.classes[item_class]
            sets = [self.sets[i] for i in mine]
            if n:
                keys = np.concatenate([S.mix(m ^ np.uint64(k + 1)) for k, m in enumerate(minima(sets, n))])
                owner = np.tile(mine, n)
            else:
                keys, owner = np.concatenate(sets), np.repeat(mine, [len(s) for s in sets])
            order = np.argsort(keys, kind="stable")
            got = self._made[item_class, n] = keys[order], owner[order]
        return got

    def search(self, sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(set, item, shared shingles) for reduced, sorted sets that contain an item to ``least``."""
        found = []
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                by_class.setdefault(len(s).bit_length() - 1, []).append(i)
        for c, mine in by_class.items():
            for q in self.classes:
                if self.least * (1 << q) > (2 << c) - 1:
                    continue  # larger than any set of the class
                n = bands(c, q, self.least)
                keys, owner = self._bands(q, n)
                some = [sets[i] for i in mine]
                if n:
                    probes = np.concatenate([S.mix(m ^ np.uint64(k + 1)) for k, m in enumerate(minima(some, n))])
                    who = np.tile(mine, n)
                else:
                    probes, who = np.concatenate(some), np.repeat(mine, [len(s) for s in some])
                lo, hi = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
                pairs = {(int(who[p]), int(owner[k])) for p in np.flatnonzero(hi > lo) for k in range(lo[p], hi[p])}
                for d, i in pairs:
                    both = len(np.intersect1d(sets[d], self.sets[i], assume_unique=True))
                    if both >= self.least * len(self.sets[i]):
                        found.append((d, i, both))
        return sorted(found)


def _item_blocks(items: DataFrame, width: int, block: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    def sets_of(rows: pa.Table) -> pa.Table:
        sets = S.distinct(*S.sequence(*S.words(_low(rows["text"].to_pylist())), width))
        return pa.table({"item_id": rows["item_id"], "n": pa.array([len(s) for s in sets], pa.int64()), "s": pa.array([s.tobytes() for s in sets], pa.binary())})

    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    made = table(named.mapInArrow(mapper(lambda: sets_of), "item_id long, n long, s binary").where("n > 0"), "items")
    total = made.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / (block / 2)))
    for b in range(blocks):
        part = made.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = part.orderBy("item_id", "s").collect()  # bounded by ``block`` on average; hashing splits evenly
        yield [r["item_id"] for r in rows], [np.frombuffer(bytes(r["s"]), np.uint64) for r in rows]
    drop(made)


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.75, width: int = S.WIDTH, block: int = BLOCK) -> DataFrame:
    """A row (doc_id, item_id, n_shared, item_shingles, containment) for each document and benchmark item
    of whose distinct ``width``-word shingles the document has at least the share ``least``.

    * Null or empty texts and items, and items without words, match nothing; null ids are left out.
    * An item or document with fewer than ``width`` words has one shingle, the whole sequence.
    * Whole documents of any length are searched; repeated rows give one result row for each distinct pair.
    * Other columns of either table are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = "doc_id long, item_id long, n_shared long, item_shingles long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    out: DataFrame | None = None
    for ids, sets in _item_blocks(items, width, block):
        held = spark.sparkContext.broadcast((np.array(ids, np.int64), sets))

        def make(held=held):
            index = Items(*held.value, least)

            def step(rows: pa.Table) -> pa.Table:
                docs_of, words = rows["doc_id"].to_numpy(), _low(rows["text"].to_pylist())
                found = []
                for a, b in S.pieces(words):
                    hashes, starts = S.sequence(*S.words(words[a:b]), width)
                    at = index.shared(hashes)
                    cut = np.searchsorted(at, starts)
                    reduced = [np.unique(hashes[at[x:y]]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    found += [(int(docs_of[a + d]), int(index.ids[i]), n, len(index.sets[i])) for d, i, n in index.search(reduced)]
                cols = list(zip(*found, strict=True)) or [(), (), (), ()]
                return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("doc_id", "item_id", "n_shared", "item_shingles"), cols, strict=True)})

            return step

        part = table(texts.mapInArrow(mapper(make), kind), "found")
        held.destroy()
        out = part if out is None else out.union(part)
    best = out.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("item_shingles").alias("item_shingles"))
    return best.withColumn("containment", F.col("n_shared") / F.col("item_shingles"))
