"""A Merkle manifest of a dataset: a tree for each source, a tree over their roots, and proofs for each row.

Leaves are laid in order over partitions by ranges and get their index in their source from
the counts of the partitions before. Each task then runs over its leaves with a stack of mountains:
for each level the nodes of the run that isn't full yet. A full run of ``FANOUT`` nodes becomes their
parent one level up, which may fill a run there, as a carry does in a sum. Runs that begin in
one task and end in another can't be closed by either; their nodes, at most one run at either end of a
task's leaves for each level, are left open and merged level by level by grouping. The last run of a
level is short and hashed without padding, and also if it is of one node, unless that is all of its level.

Proofs come from the node records: leaves meet the records of their block of ``FANOUT ** DEPTH`` leaves
and the one chain of runs above the block, so that neither a source nor the tree has to fit in a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import drop, give_back, partitions, table, whole_groups

FANOUT = 16
#: Levels that a block of leaves spans.
DEPTH = 3
#: Leaves of a task.
LAID = 1_000_000
#: Fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is laid in order: by key, then name, id and hash.
ITEM = ["key", "name", "id", "hash", "shown"]
ORDER = ["key", "name", "id", "hash"]
NODE = "key string, level int, index long, hash string, open boolean, top boolean"
CHAIN = "array<struct<place: int, run: string>>"


def joined(hashes: str) -> str:
    """The digest of hex digests one behind the other."""
    return hashlib.sha256(hashes.encode()).hexdigest()


def leaf(text: Column | None = None) -> Column:
    """The digest of a row: each field's length in UTF-8 bytes, a colon and its value, or ``-`` for null."""

    def field(name: str) -> Column:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def tampered(share: int = 5) -> Column:
    """The leaf of a row whose text was changed to lower case, where ``share`` divides the CRC-32 of the id; else its own."""
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(share)) == 0, F.lit(False))
    return F.when(hit, leaf(F.translate("text", UPPER, LOWER))).otherwise(leaf())


@dataclass
class Tree:
    """``leaves`` (key, index, hash, name, id, shown), ``nodes`` (key, level, index, hash) above them, ``tops`` (key, level, hash) of each key."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    height: int
    tasks: int


def _lay(items: DataFrame, tasks: int) -> DataFrame:
    """``items`` in order, with part, the place in it (at) and the index among its rows of the key (place)."""
    # equal rows are parted by a salt, which is stable as items are read from a table
    ready = items.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(tasks, *ORDER, "salt").sortWithinPartitions(*ORDER, "salt").drop("salt")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last, place = TaskContext.get().partitionId(), 0, None, 0
        for b in rows:
            places = []
            for key in b["key"].to_pylist():
                place = place + 1 if key == last else 0
                last = key
                places.append(place)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(places, pa.int64())], names=[*b.schema.names, "part", "at", "place"])
            at += n

    return ready.mapInArrow(run, "key string, name string, id long, hash string, shown string, part int, at long, place long")


class Mountains:
    """The stack of one stretch of neighbouring leaves of a key; ``rows`` gets a node record for each node above them, and the open ones."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        self.key: str | None = None
        self.runs: list[list[str]] = []  # by level: the nodes of the run that isn't full yet
        self.first: list[int] = []  # index of the first of them

    def _out(self, level: int, open_: bool) -> None:
        if level or open_:  # a closed leaf needs no record
            self.rows.extend((self.key, level, self.first[level] + i, h, open_, False) for i, h in enumerate(self.runs[level]))
        self.runs[level] = []

    def push(self, index: int, digest: str, level: int = 0) -> None:
        while True:
            if level == len(self.runs):
                self.runs.append([])
                self.first.append(index)
            if not self.runs[level]:
                self.first[level] = index
            self.runs[level].append(digest)
            if index % FANOUT < FANOUT - 1:
                return
            whole = len(self.runs[level]) == FANOUT
            digest = joined("".join(self.runs[level])) if whole else ""
            self._out(level, not whole)
            if not whole:
                return
            index, level = index // FANOUT, level + 1

    def end(self, last: bool) -> None:
        """Ends the stretch; ``last`` tells that the key has no leaf behind it."""
        level = 0
        while level < len(self.runs):
            run, first = self.runs[level], self.first[level]
            if run and last and not first % FANOUT:
                if len(run) == 1 and not first:
                    self.rows.append((self.key, level, 0, run[0], False, True))
                    self.runs[level] = []
                else:
                    parent = joined("".join(run))
                    self._out(level, False)
                    self.push(first // FANOUT, parent, level + 1)
            elif run:
                self._out(level, True)
                last = False  # the parent of these is missing above
            level += 1
        self.runs, self.first = [], []


def _raise(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node records of the leaves (key, index, hash, part, at) that arrive; any break in their order ends a stretch."""
    out: list[tuple] = []
    stack = Mountains(out)
    before = (None, None, None, None)

    def ready() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in NODE.split(", ")])
        out.clear()
        return b

    for b in rows:
        for key, index, digest, part, at in zip(*(b[c].to_pylist() for c in ("key", "index", "hash", "part", "at")), strict=True):
            neighbour = (part, at) == before[2:]
            if not neighbour or (key, index) != before[:2]:
                stack.end(neighbour and key != before[0])
                stack.key = key
            stack.push(index, digest)
            before = (key, index + 1, part, at + 1)
        if len(out) > 20_000:
            yield ready()
    stack.end(False)
    if out:
        yield ready()


def _wide(level: int) -> int:
    return FANOUT**level


def build(items: DataFrame) -> Tree:
    """The trees of ``items`` (key, name, id, hash, shown), one for each key; items of a key are leaves by name, id and hash, nulls first."""
    spark = items.sparkSession
    tasks = max(partitions(spark), math.ceil(items.count() / LAID))
    laid = table(_lay(items, tasks), "laid")
    counts = table(laid.groupBy("part", "key").agg(F.count("*").alias("n")), "counts")
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part that a key is in
    begun = counts.select("part", "key", earlier.alias("earlier")).where("earlier > 0")  # only the first key of a part began before it
    leaves = laid.join(F.broadcast(begun), ["part", "key"], "left").withColumn("index", F.col("place") + F.coalesce("earlier", F.lit(0)))
    raised = table(leaves.select("key", "index", "hash", "part", "at").mapInArrow(_raise, NODE), "raised")
    sizes = counts.groupBy("key").agg(F.sum("n").alias("size"))
    height, most = 0, sizes.agg(F.max("size")).first()[0] or 0
    while _wide(height) < most:
        height += 1
    nodes, tops, merged = [raised.where("level > 0")], [raised.where("top")], []
    left = table(raised.where("open").join(sizes, "key").select("key", "level", "index", "hash", "size"), "open")  # two runs a level and task at most
    above = left.limit(0)
    for level in range(height + 1):
        of_level = left.where(F.col("level") == level).unionByName(above)
        count = F.expr(f"(size + {_wide(level) - 1}) div {_wide(level)}")
        tops.append(of_level.where(count == 1).select("key", "level", "index", "hash"))
        run = F.array_sort(F.collect_list(F.struct("index", "hash")))  # one run of nodes
        parents = of_level.where(count > 1).groupBy("key", F.expr(f"index div {FANOUT}").alias("parent"), "size", count.alias("count")).agg(run.alias("run"))
        whole = F.size("run") == F.least(F.lit(FANOUT), F.col("count") - F.col("parent") * FANOUT)
        digest = F.when(whole, F.sha2(F.array_join(F.col("run.hash"), ""), 256)).otherwise(F.raise_error(F.lit("a run of nodes is not whole")))
        above = table(parents.select("key", F.lit(level + 1).alias("level"), F.col("parent").alias("index"), digest.alias("hash"), "size"), "merged")
        merged.append(above)
        nodes.append(above)
    names = ["key", "level", "index", "hash"]

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0].select(names)
        for f in frames[1:]:
            out = out.unionByName(f.select(names))
        return out

    return Tree(leaves.select("index", *ITEM), table(union(nodes), "nodes"), table(union(tops), "tops"), height, tasks)


def _chains(tree: Tree, above: DataFrame) -> DataFrame:
    """For each block of leaves the runs above it: key, block, level, index (the height of the key's tree), hash (its top) and chain; ``above`` (key, chain) has what lies above each top."""
    tops = tree.tops.join(above, "key").select("key", "level", "index", "chain", F.struct("hash", F.col("level").alias("height")).alias("top"))
    high = tree.nodes.where(F.col("level") >= DEPTH)
    found = None
    for level in range(tree.height, DEPTH - 1, -1):
        here = tops.where(F.col("level") == level).select("key", "index", "top", "chain")
        if found is not None:
            run = F.array_sort(F.collect_list(F.struct("index", "hash")))
            runs = high.where(F.col("level") == level).groupBy("key", F.expr(f"index div {FANOUT}").alias("parent")).agg(run.alias("run"))
            down = runs.join(found.withColumnRenamed("index", "parent"), ["key", "parent"]).select("key", "top", "chain", F.array_join(F.col("run.hash"), "").alias("run"), F.explode("run.index").alias("index"))
            link = F.struct((F.col("index") % FANOUT).cast("int").alias("place"), "run")
            here = here.unionByName(down.select("key", "index", "top", F.concat(F.array(link), "chain").alias("chain")))
        found = here
    low = tops.where(F.col("level") < DEPTH).select("key", F.lit(0).cast("long").alias("index"), "top", "chain")
    found = low if found is None else found.unionByName(low)
    return found.select("key", F.col("index").alias("block"), F.lit(DEPTH).alias("level"), F.col("top.height").cast("long").alias("index"), "top.hash", "chain")


def _without(run: str, place: int) -> str:
    return run[: place * HEX] + run[place * HEX + HEX :]


def _walk(t: pa.Table) -> Iterator[tuple[str, str, str | None, list[tuple[int, str]], list[tuple]]]:
    """For each run of leaves of whole blocks: key, top, the run's text (none if its leaf is the top), the links (place, run) above it, and its leaves."""
    cols = [t[c].to_pylist() for c in ("key", "block", "level", "index", "hash", "chain", "id", "name", "shown")]
    for (key, _), rows in groupby(zip(*cols, strict=True), key=lambda r: r[:2]):
        levels = {k: list(g) for k, g in groupby(rows, key=lambda r: r[2])}
        _, _, _, height, top, chain, *_ = levels[DEPTH][0]
        above = [(c["place"], c["run"]) for c in chain]
        runs = {(level, parent): "".join(r[4] for r in g) for level in range(1, DEPTH) for parent, g in groupby(levels.get(level, ()), key=lambda r: r[3] // FANOUT)}
        for parent, g in groupby(levels[0], key=lambda r: r[3] // FANOUT):
            own = list(g)
            links = [(parent // _wide(level - 1) % FANOUT, runs[level, parent // _wide(level)]) for level in range(1, min(DEPTH, height))]
            yield key, top, "".join(r[4] for r in own) if height else None, links + above, own


def _blocks(tree: Tree, above: DataFrame) -> DataFrame:
    """All that proofs of a block need, in order: the chain above it, its nodes from the highest level down, its leaves."""
    none = F.lit(None)
    inner = tree.nodes.where(F.col("level") < DEPTH)
    wide = F.when(F.col("level") == 1, _wide(DEPTH - 1)).otherwise(_wide(DEPTH - 2))
    inner = inner.select("key", F.floor(F.col("index") / wide).alias("block"), "level", "index", "hash", none.cast(CHAIN).alias("chain"))
    rows = _chains(tree, above).unionByName(inner).select("*", none.cast("long").alias("id"), none.cast("string").alias("name"), none.cast("string").alias("shown"))
    leaves = tree.leaves.select("key", F.expr(f"index div {_wide(DEPTH)}").alias("block"), F.lit(0).alias("level"), "index", "hash", none.cast(CHAIN).alias("chain"), "id", "name", "shown")
    return rows.unionByName(leaves).repartition(tree.tasks, "key", "block").sortWithinPartitions("key", "block", F.desc("level"), "index")


def _over_blocks(make: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(rows, ["key", "block"], 1 << 22):
            yield make(t)
        give_back()

    return run


def links(tree: Tree) -> DataFrame:
    """Of a tree that is the only one: for each leaf its name as key, and as chain the place in each run up to the top and that run."""

    def make(t: pa.Table) -> pa.RecordBatch:
        keys, chains = [], []
        for _, _, run, above, leaves in _walk(t):
            for k, row in enumerate(leaves):
                keys.append(row[7])
                chains.append([{"place": p, "run": r} for p, r in ([] if run is None else [(k, run)]) + above])
        kind = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.string())]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(chains, kind)], names=["key", "chain"])

    spark = tree.leaves.sparkSession
    none = spark.createDataFrame([("", [])], f"key string, chain {CHAIN}")
    return _blocks(tree, none).mapInArrow(_over_blocks(make), f"key string, chain {CHAIN}")


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<string>"


def _without(run: str, place: int) -> str:
    return run[: place * HEX] + run[place * HEX + HEX :]


def _prove(root: str, whole: bool) -> Callable[[pa.Table], pa.RecordBatch]:
    """``whole``: the siblings themselves are returned too."""

    def make(t: pa.Table) -> pa.RecordBatch:
        out: list[tuple] = []
        for _, top, run, above, leaves in _walk(t):
            rest = "".join(_without(r, p) for p, r in above)
            sides = [(r[: p * HEX], r[p * HEX + HEX :]) for p, r in above]
            for k, (_, _, _, _, digest, _, doc, _, shown) in enumerate(leaves):
                siblings = rest if run is None else _without(run, k) + rest
                folded = shown if run is None else joined(run[: k * HEX] + shown + run[k * HEX + HEX :])
                for left, right in sides:
                    folded = joined(left + folded + right)
                out.append((doc, digest, top, root, joined(siblings), folded, folded == root, [siblings[i : i + HEX] for i in range(0, len(siblings), HEX)] if whole else None))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PROOF.split(", ")])

    return make


@dataclass
class Manifest:
    """``rows``: the trees of all sources, a leaf for each row; ``sources``: the tree over their roots; ``root``: its top, None if there is no row."""

    rows: Tree
    sources: Tree
    root: str | None


def manifest(docs: DataFrame, shown: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text); ``shown`` is the leaf that each row presents for its proof, its own by default.

    A source's leaves are in order of doc_id, then of digest, nulls first; sources in order of their UTF-8 bytes, null first.

    * Null fields have a form of their own, so null and empty text differ; null doc_ids and sources are rows and a source like others.
    * Repeated rows are a leaf each. Texts are read whole; other columns are not read. An empty table has no root.
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    items = table(typed.select(key.alias("key"), F.lit("").alias("name"), F.col("doc_id").alias("id"), leaf().alias("hash"), (leaf() if shown is None else shown).alias("shown")), "leaves")
    rows = build(items)
    drop(items)
    over = table(rows.tops.select(F.lit("").alias("key"), F.col("key").alias("name"), F.lit(None).cast("long").alias("id"), "hash", F.col("hash").alias("shown")), "subroots")
    sources = build(over)
    drop(over)
    top = sources.tops.first()
    return Manifest(rows, sources, top["hash"] if top else None)


def proofs(made: Manifest, siblings: bool = False) -> DataFrame:
    """For each row doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, and with ``siblings`` the proof itself.

    The proof is the other nodes of each run from the leaf to the root, left to right, level by level. folded_root is
    the root that the leaf as shown and the proof lead to; verified tells if it is the manifest's.
    """
    names = [x.split()[0] for x in PROOF.split(", ")][: 8 if siblings else 7]
    if made.root is None:
        return made.rows.leaves.sparkSession.createDataFrame([], PROOF).select(names)
    above = table(links(made.sources), "links")
    return _blocks(made.rows, above).mapInArrow(_over_blocks(_prove(made.root, siblings)), PROOF).select(names)
