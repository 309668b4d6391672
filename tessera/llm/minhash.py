"""Near-duplicate documents: many universal hash minima, banding, signature verification,
confirmation on full shingle sets, and components by alternating large-star and small-star.

Plan. One scan makes a digest of each document's shingle set, its size and its
signature. Equal sets collapse to one representative by a map-side aggregation,
so a group of exact copies of any size costs one row. Representatives are dealt
to band buckets. Round one links every member of a bucket with the bucket's hub,
the member that shares most buckets with others; pairs whose signatures rule out
the limit are dropped, the rest are confirmed on full sets, and components give
labels. Round two treats the buckets that still hold several labels: every member
outside a bucket's largest label is compared with all members of other labels, by
signature and then on full sets, in blocks of bounded size. Only links that join
two labels leave a block, so the output stays linear in the members, and no link
between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm.components import components
from tessera.llm.shared import drop, mapper, passing, table, whole_groups

#: Hash functions are ``BANDS * ROWS``. A pair at similarity 0.75 misses all bands with probability 2e-6.
BANDS, ROWS = 24, 3
#: Similarity below the limit, in shares of equal minima, that rules a pair out: five standard deviations at 0.75.
SLACK = 0.25
#: Members of a bucket that meet in one task: outside the largest label, and of all.
FEW, MANY = 256, 1024

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of all hash functions ``a * x + b mod 2**64`` over each set (none may be empty)."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= 60_000):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
        for k in range(BANDS * ROWS):
            out[at:end, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
        at = end
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row; the band's number is part of it."""
    keys = np.empty((len(minima), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(minima), (b + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64), np.uint64)
        for r in range(ROWS):
            k = S.mix(k ^ minima[:, b * ROWS + r]) * np.uint64(0x165667B19E3779F9)
        keys[:, b] = S.mix(k)
    return keys


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, w = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.array(values.ravel(), kind))


def sets_of(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    for a, b in S.pieces(texts):
        yield from S.distinct(*S.sequence(*S.words(texts[a:b]), width))


def _scan(width: int) -> Callable:
    def make() -> Callable:
        def step(rows: pa.Table) -> pa.Table:
            sets = list(sets_of(rows["text"].to_pylist(), width))
            full = [i for i, s in enumerate(sets) if len(s)]
            minima = signatures([sets[i] for i in full]) if full else np.zeros((0, BANDS * ROWS), np.uint64)
            digests = np.zeros((len(sets), 2), np.uint64)
            for i, s in enumerate(sets):
                digests[i] = (S.mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(S.mix(s ^ np.uint64(0x5851F42D4C957F2D)))) if len(s) else (0, 0)
            at = np.full(len(sets), -1)
            at[full] = np.arange(len(full))
            take = pa.array(at, pa.int64(), mask=at < 0)
            return pa.table({
                "doc_id": rows["doc_id"],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "d1": pa.array(digests[:, 0].view(np.int64)),
                "d2": pa.array(digests[:, 1].view(np.int64)),
                "minima": _lists((minima >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()).take(take),
                "bands": _lists(band_keys(minima).view(np.int64), pa.int64()).take(take),
            })

        return step

    return mapper(make)


_SCANNED = "doc_id long, n_shingles long, d1 long, d2 long, minima array<int>, bands array<long>"
_LINKED = "a long, b long"


def _verify(percent: int, forest: bool, width: int) -> Callable:
    """Links within blocks. Rows arrive sorted by (k1, k2, k3, side): a block's few members (side 0) come before
    the others (side 1). Yields pairs of a few and another member of another label whose sets are similar enough;
    with ``forest`` only such as join two labels that the block has not joined yet."""

    def block(ids: np.ndarray, sides: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        found, joined = [], {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                joined[x] = joined.get(joined[x], joined[x])
                x = joined[x]
            return x

        few = np.flatnonzero(sides == 0)
        if not len(few) or len(few) == len(ids) == 1:
            return found
        # for each shingle of the few, who of them has it
        keys = np.concatenate([sets[i] for i in few])
        owner = np.repeat(np.arange(len(few)), [len(sets[i]) for i in few])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        sizes = np.array([len(sets[i]) for i in few])
        for j in range(len(ids)):
            s = sets[j]
            lo, hi = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
            n = hi - lo
            total = int(n.sum())
            if not total:
                continue
            hit = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            both = np.bincount(owner[hit], minlength=len(few))
            for i in np.flatnonzero(100 * both >= percent * (sizes + len(s) - both)):
                a, b = int(few[i]), j
                if a == b or labels[a] == labels[b] or ids[a] == ids[b]:
                    continue
                if forest:
                    x, y = root(int(labels[a])), root(int(labels[b]))
                    if x == y:
                        continue
                    joined[x] = y
                found.append((int(ids[a]), int(ids[b])))
        return found

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["k1", "k2", "k3"]
        for part in whole_groups(rows, keys, 1 << 24):
            k = np.stack([part[c].to_numpy() for c in keys])
            cut = np.flatnonzero(np.any(k[:, 1:] != k[:, :-1], axis=0)) + 1
            ids, sides, labels = part["id"].to_numpy(), part["side"].to_numpy(), part["label"].to_numpy()
            sets = list(sets_of(part["text"].to_pylist(), width))
            out = [p for a, b in zip([0, *cut], [*cut, len(ids)], strict=True) for p in block(ids[a:b], sides[a:b], labels[a:b], sets[a:b])]
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    return run


def _confirm(rows: DataFrame, docs: DataFrame, width: int, percent: int, forest: bool) -> DataFrame:
    """Confirmed links (a, b) from block rows (k1, k2, k3, side, id, label). The texts of the ids travel, which
    compress better than sets; those of all other documents are dropped before any shuffle."""
    wanted = rows.select("id").distinct()
    texts = passing(docs.where("doc_id is not null and text is not null"), "doc_id", wanted).select(F.col("doc_id").alias("id"), "text")
    full = rows.join(texts, "id").select("k1", "k2", "k3", "side", "id", "label", "text")
    dealt = full.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "side", "id")
    return dealt.mapInArrow(_verify(percent, forest, width), _LINKED).distinct()


def _near(percent: int) -> Callable:
    """Marks the rows of a block that may have a partner of another label, by their signatures. In: rows sorted
    by (k1, k2, k3) with side, id, label, minima. Out: the rows of sides 0 and 1 that remain."""
    least = percent / 100 - SLACK

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["k1", "k2", "k3"]
        for part in whole_groups(rows, keys):
            k = np.stack([part[c].to_numpy() for c in keys])
            cut = np.flatnonzero(np.any(k[:, 1:] != k[:, :-1], axis=0)) + 1
            sides, labels = part["side"].to_numpy(), part["label"].to_numpy()
            minima = part["minima"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, BANDS * ROWS)
            keep = np.zeros(part.num_rows, bool)
            for a, b in zip([0, *cut], [*cut, part.num_rows], strict=True):
                for i in range(a, b):
                    if sides[i] == 0:
                        ok = ((minima[a:b] == minima[i]).mean(axis=1) >= least) & (labels[a:b] != labels[i]) & (sides[a:b] == 1)
                        if ok.any():
                            keep[a:b] |= ok
                            keep[i] = True
            if keep.any():
                yield from part.drop_columns(["minima"]).filter(pa.array(keep)).to_batches()

    return run


def links(docs: DataFrame, width: int = S.WIDTH, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(scan, components): the scan has a row for each row of ``docs``; components has (node, component)
    for representatives of distinct sets that have a link."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = table(docs.mapInArrow(_scan(width), _SCANNED), "scan")
    named = scan.where("doc_id is not null and n_shingles > 0")
    reps = table(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("minima", "bands"), "doc_id").alias("s")).select("id", "s.*"), "reps")
    rows = reps.select("id", F.explode("bands").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = table(rows.join(counts, "key"), "shared")
    central = shared.groupBy("id").agg(F.sum("n").alias("c"))
    hubs = shared.join(central, "id").groupBy("key").agg(F.max(F.struct("c", (-F.col("id")).alias("i"))).alias("h")).select("key", (-F.col("h.i")).alias("hub"))
    minima = reps.select("id", "minima")
    pairs = shared.join(hubs, "key").where("id <> hub").select("hub", "id").distinct()
    alike = F.size(F.filter(F.zip_with("minima", "hub_minima", lambda x, y: x == y), lambda e: e)) >= (percent / 100 - SLACK) * BANDS * ROWS
    pairs = table(
        pairs.join(minima, "id").join(minima.select(F.col("id").alias("hub"), F.col("minima").alias("hub_minima")), "hub").where(alike).select("hub", "id"), "pairs"
    )
    block = (F.pmod(F.xxhash64("id"), F.lit(64))).cast("long")
    members = pairs.select(F.col("hub").alias("k1"), block.alias("k2"), F.lit(0).cast("long").alias("k3"), F.lit(1).alias("side"), "id", F.col("id").alias("label"))
    heads = members.select("k1", "k2", "k3").distinct().select("k1", "k2", "k3", F.lit(0).alias("side"), F.col("k1").alias("id"), F.col("k1").alias("label"))
    first = table(_confirm(members.union(heads), docs, width, percent, False), "links")
    found = components(first)

    labelled = shared.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1")
    held = table(labelled.join(mixed, "key").select("key", "id", "label", F.col("top.label").alias("most"), (F.col("all") - F.col("top.n")).alias("few"), "all"), "mixed")
    few_blocks = F.ceil(F.col("few") / FEW).cast("long")
    all_blocks = F.ceil(F.col("all") / MANY).cast("long")
    mine = F.pmod(F.xxhash64("id"), few_blocks).cast("long")
    other = F.pmod(F.xxhash64("id", F.lit(1)), all_blocks).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = held.where("label <> most").select(F.col("key").alias("k1"), mine.alias("k2"), every(all_blocks).alias("k3"), F.lit(0).alias("side"), "id", "label")
    many = held.select(F.col("key").alias("k1"), every(few_blocks).alias("k2"), other.alias("k3"), F.lit(1).alias("side"), "id", "label")
    blocks = few.union(many).join(minima, "id").select("k1", "k2", "k3", "side", "id", "label", "minima")
    kept = "k1 long, k2 long, k3 long, side int, id long, label long"
    marked = table(blocks.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "side", "id").mapInArrow(_near(percent), kept), "marked")
    second = table(_confirm(marked, docs, width, percent, True), "links")
    every_link = first.union(second)
    result = components(every_link)
    out = table(reps.join(result.withColumnRenamed("node", "id"), "id").select("id", "component"), "components")
    drop(reps, shared, pairs, held, marked, first, second)
    return scan, out


def near_duplicates(docs: DataFrame, width: int = S.WIDTH, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if ``100 * |A and B| >= percent * |A or B|`` for their sets of
    ``width``-word shingles. component_id is the smallest doc_id reachable by links, itself
    included; kept is true where it is the document's own.

    * Null or empty text, or text without words: n_shingles 0, linked with nothing, kept.
    * Null doc_id: n_shingles is given, component_id and kept are null; such a row links nothing.
    * Repeated doc_id: the rows are one document for links; each row is returned.
    * Fewer than ``width`` words: one shingle, the whole sequence.
    * Columns other than doc_id and text are not read, so their names can't clash; an empty table gives an empty result.
    """
    scan, found = links(docs, width, percent)
    named = scan.where("doc_id is not null and n_shingles > 0")
    reps = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("n_shingles").alias("has"))
    of_set = reps.join(found, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("c"), F.lit(True).alias("full"))
    # only a set with another document behind it needs the join; all rows carry the digest
    keyed = scan.join(of_set, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).alias("c"))
    own = F.coalesce(F.least("c", "doc_id"), "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), own)
    return keyed.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
