"""Substring dedup by compact windows: passages of documents that occur in an earlier document.

The tokens are word shingles. For a hash function, a compact window (l, c, r) stands for all
subsequences of [l, r] that contain c, whose min-hash is that of the token at c. A run of
``SPAN`` tokens has a minimum for each of ``FUNCTIONS`` functions, and the minima of each two
functions make a key, so ``HASHES`` functions agree in every run that has it, wherever in the run
the minima are: inserted and deleted words move them without changing the key. A run whose
likeness is s is missed if less than two functions agree: never at 1, with 0.027 at 0.8 and 0.051
at 0.75; longer passages have more runs. A key's documents are pre-aggregated where they are made:
each batch keeps its first document and links the others to it; then first documents meet by key
and link likewise, and the batch's others follow to the key's first document. So a passage in a third
of all documents costs a row for each, never a pair for each two, and links don't depend on batches.
Pairs are verified on whole texts: stretches in which the tokens are shared, grown over
edits, whose exact Jaccard similarity is ``SIMILAR`` or more.

A key's first document may have only a part of a passage, or an edited form of it, and so hide a
better partner. Where tokens shared with it end, the next token of the document on either side is a
border, if no passage found covers it. Two documents that have more of the passage in common have the
same border, as both were compared with the same first document, and half of a run of ``SPAN`` tokens
on one side of it: these are its keys. For borders whose key several documents have, the whole runs of ``SPAN``
tokens with the border are compared by their hashes, and each document meets the first one that has
the run: so equal passages are found however many documents hide them. Documents also meet the first
one with the border's key, which finds edited passages unless that one hides them again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm.shared import drop, give_back, mapper, passing, table, whole_groups
from tessera.plans.catalogue import small

#: Shingles of a passage of fifty words.
SPAN = 46
FUNCTIONS, HASHES, SIMILAR = 4, 2, 0.75
#: Documents verified in one task against the text of their first document.
MEMBERS = 256

#: Documents whose cuts are broadcast at most; beyond it texts are shuffled to meet them.
CUTS = 200_000

MADE = "first long, key long, doc long"
LINKS = "key long, first long, doc long, made boolean"


def _hashed(x: np.ndarray, fn: int) -> np.ndarray:
    """A universal hash of tokens, which are mixed already."""
    return x * np.uint64(0x9E3779B97F4A7C15 * (2 * fn + 3) ** 5 % (1 << 64) | 1) + np.uint64(0xD1B54A32D192ED03 * (fn + 1) % (1 << 64))


def _minima(x: np.ndarray, fn: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the minimum of each run of ``span`` tokens, ties to the left, and the hashes it is taken from, with places in their lowest bits."""
    n = len(x)
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    packed = (_hashed(x, fn) & ~low) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // span)
    padded = np.full(blocks * span, ~np.uint64(0))
    padded[:n] = packed
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
    return (least & low).astype(np.int64), packed


def windows(x: np.ndarray, fn: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows (l, c, r) of at least ``span`` tokens of one sequence, ties to the left."""
    n = len(x)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none
    c, packed = _minima(x, fn, span)
    c = c[np.concatenate([[True], c[1:] != c[:-1]])]
    values = packed[c].tolist()
    before, after = [-1] * len(c), [len(c)] * len(c)
    stack: list[int] = []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    ends = np.concatenate([c, [n, -1]])  # index len(c) is the end, -1 the start
    return ends[before] + 1, c, ends[after] - 1


def _keys(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the runs of several sequences, one behind the other: key, and the number of its sequence. Repeats stay."""
    none = np.zeros(0, np.int64)
    if len(x) < SPAN:
        return none.view(np.uint64), none
    at = [_minima(x, fn, SPAN)[0] for fn in range(FUNCTIONS)]
    sizes = np.diff(starts)
    last = np.repeat(starts[1:], sizes)[: len(at[0])] - SPAN  # where the last run of each token's sequence begins
    inside = np.arange(len(at[0])) <= last
    new = []
    for c in at:
        fresh = np.concatenate([[True], c[1:] != c[:-1]])
        fresh[starts[:-1][sizes >= SPAN]] = True
        new.append(fresh & inside)
    of = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    for i in range(FUNCTIONS):
        for j in range(i + 1, FUNCTIONS):
            run = np.flatnonzero(new[i] | new[j])
            keys.append(S.mix(x[at[i][run]] * np.uint64(2 * i + 3) + S.mix(x[at[j][run]] + np.uint64(i * FUNCTIONS + j))))
            owners.append(of[run])
    return np.concatenate(keys), np.concatenate(owners)


def _linked(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (key, doc): which begin a key, which are a further document of one, and each row's first."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    again = ~new & (doc != doc[lead]) & np.concatenate([[True], doc[1:] != doc[:-1]])
    return new, again, lead


def _scan() -> Callable:
    """Rows (key, doc) of each batch's first documents, and its other documents with their first."""

    def make() -> Callable:
        def step(rows: pa.Table) -> pa.Table | None:
            ids, texts = rows["doc_id"].to_numpy(), rows["text"].to_pylist()
            parts: list[tuple] = []
            for a, b in S.pieces(texts):
                key, owner = _keys(*S.sequence(*S.words(texts[a:b])))
                parts.append((key, ids[a + owner]))
            key, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
            if not len(key):
                return None
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new, again, lead = _linked(key, doc)
            keep = new | again
            return pa.table({"first": pa.array(doc[lead][keep], mask=new[keep]), "key": key.view(np.int64)[keep], "doc": doc[keep]})

        return step

    return mapper(make, 1 << 23)


def _lead(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links: those made before, and from the other rows, sorted by (key, doc), those of each to the first document of its key."""
    now: tuple[int, int] | None = None
    names = ["key", "first", "doc", "made"]
    for b in rows:
        made = b.filter(pc.is_valid(b.column("first")))
        if made.num_rows:
            yield pa.record_batch([made.column("key"), made.column("first"), made.column("doc"), pa.repeat(True, made.num_rows)], names)
        b = b.filter(pc.is_null(b.column("first")))
        if not b.num_rows:
            continue
        key, doc = (b.column(c).to_numpy() for c in ("key", "doc"))
        if now is not None:
            key, doc = (np.concatenate([[x], c]) for x, c in zip(now, (key, doc), strict=True))
        _, again, lead = _linked(key, doc)
        now = key[lead[-1]], doc[lead[-1]]
        if again.any():
            yield pa.record_batch([key[again], doc[lead][again], doc[again], pa.repeat(False, int(again.sum()))], names)
    give_back()


def _shared(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token of ``b`` is among the sorted ones of ``a``, whether it is there, and begins and ends of the runs that are."""
    at = np.searchsorted(a[order], b)
    at[at == len(a)] = 0
    shared = a[order][at] == b
    return at, shared, np.flatnonzero(np.diff(np.concatenate([[0], shared.view(np.int8), [0]])))


def borders(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of the borders of ``b``: the tokens right before and behind its runs of tokens that ``a`` has, each
    with the tokens on its left, and with those on its right. A run of ``SPAN`` tokens with the border has half of it on one side."""
    edge = _shared(a, b, order)[2]
    half = SPAN // 2
    at = np.unique(np.concatenate([edge[0::2] - 1, edge[1::2]]))
    weights = _hashed(np.arange(half, dtype=np.uint64), 1) | np.uint64(1)
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for side, begin in enumerate((at - half + 1, at)):
        ok = (begin >= 0) & (begin + half <= len(b)) & (at >= 0)
        begin = begin[ok]
        if len(begin):
            places.append(at[ok])
            keys.append(S.mix((np.lib.stride_tricks.sliding_window_view(b, half)[begin] * weights).sum(axis=1, dtype=np.uint64) + np.uint64(side)))
    return np.concatenate(keys), np.concatenate(places)


def stretches(a: np.ndarray, b: np.ndarray, least: float = SIMILAR, span: int = SPAN, order: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """(begin, end, begin in a, end in a, similarity) of the stretches of ``b`` that ``a`` has nearly too, in tokens.

    A stretch grows over unshared tokens as long as enough of it is shared; its counterpart spans
    the first places in ``a`` of its tokens, near their median shift. Where that fails, as with two passages that stand side by side
    in ``b`` only, its runs are chained by their shifts and each chain is a stretch. Stretches and counterparts have ``span`` tokens or more.
    ``order`` sorts ``a``, where known.
    """
    order = np.argsort(a, kind="stable") if order is None else order
    at, shared, edge = _shared(a, b, order)
    runs = list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))
    cost = 2 * least / (1 + least)
    merged: list[list[int]] = []
    for x, y in runs:
        if merged:
            m = merged[-1]
            if m[2] + y - x >= cost * (y - m[0]):
                m[1], m[2] = y, m[2] + y - x
                continue
        merged.append([x, y, y - x])
    found = []
    last = np.searchsorted(a[order], b, "right") - 1

    def match(x: int, y: int) -> bool:
        if y - x < span:
            return False
        here = np.flatnonzero(shared[x:y]) + x
        # the k-th time that a token occurs stands for the k-th time in ``a``, so runs of one word match too
        by = np.argsort(b[here], kind="stable")
        same = np.concatenate([[True], b[here][by][1:] != b[here][by][:-1]])
        rank = np.empty(len(here), np.int64)
        rank[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(same, np.arange(len(by)), 0))
        places = order[np.minimum(at[here] + rank, last[here])]
        shift = places - here
        values, counts = np.unique(shift, return_counts=True)
        near = places[np.abs(shift - values[counts.argmax()]) <= (y - x) // 4 + 8]
        u, v = int(near.min()), int(near.max()) + 1
        one, two = np.unique(b[x:y]), np.unique(a[u:v])
        both = len(np.intersect1d(one, two, assume_unique=True))
        alike = both / (len(one) + len(two) - both)
        if v - u >= span // 2 and alike >= least:
            found.append((x, y, u, v, alike))
            return True
        return False

    def chains(x: int, y: int) -> list[list[int]]:
        """A stretch's runs, chained while their places in ``a`` follow each other as they do in ``b`` but for edits."""
        parts: list[list[int]] = []
        before = 0
        for u, v in runs:
            if x <= u and v <= y:
                shift = int(np.median(order[at[u:v]] - np.arange(u, v)))
                if parts and abs(shift - before) <= span // 2 and parts[-1][2] + v - u >= cost * (v - parts[-1][0]):
                    parts[-1][1:] = [v, parts[-1][2] + v - u]
                else:
                    parts.append([u, v, v - u])
                before = shift
        return parts

    for x, y, _ in merged:
        if match(x, y):
            continue
        # passages that stand side by side here may be far apart there, or in another order
        for u, v, _ in chains(x, y):
            if (u, v) != (x, y) and match(u, v):
                continue
            for w, z in runs:
                if u <= w and z <= v and (w, z) not in ((u, v), (x, y)):
                    match(w, z)
    return found


SPANS = "doc_id long, start long, stop long, first_doc_id long, first_start long, first_stop long, similarity double"


#: A passage, or a border: its key, the document that has it, and as start its place.
FOUND = f"{SPANS}, token long"


def _verify(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (first, block, side): the first document's text, then those linked with it."""
    now, first, order = None, np.zeros(0, np.uint64), None
    names = ["doc_id", "start", "stop", "first_doc_id", "first_start", "first_stop"]
    for t in whole_groups(rows, ["first", "block", "side", "doc"], 1 << 22):
        texts = t["text"].to_pylist()
        out: list[tuple] = []
        ends: list[tuple[int, np.ndarray, np.ndarray]] = []
        group = list(zip(t["first"].to_pylist(), t["block"].to_pylist(), strict=True))
        sides, docs = t["side"].to_pylist(), t["doc"].to_pylist()
        for a, b in S.pieces(texts):
            hashes, starts = S.sequence(*S.words(texts[a:b]))
            for i in range(a, b):
                x = hashes[starts[i - a] : starts[i - a + 1]]
                if sides[i] == 0:
                    now, first = group[i], x.copy()
                    order = np.argsort(first, kind="stable")
                elif group[i] == now and len(first) >= SPAN and len(x) >= SPAN:
                    out += [(docs[i], s, e + S.WIDTH - 1, now[0], u, v + S.WIDTH - 1, j) for s, e, u, v, j in stretches(first, x, order=order)]
                    ends.append((docs[i], *borders(first, x, order)))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.record_batch({**{n: pa.array(c, pa.int64()) for n, c in zip(names, cols[:6], strict=True)}, "similarity": pa.array(cols[6], pa.float64()), "token": pa.nulls(len(out), pa.int64())})
        sizes = [len(e) for _, e, _ in ends]
        if sum(sizes):
            owner = np.repeat(np.array([d for d, *_ in ends], np.int64), sizes)
            keys, places = np.concatenate([e for _, e, _ in ends]), np.concatenate([e for *_, e in ends])
            none = pa.nulls(len(owner), pa.int64())
            yield pa.record_batch({**dict.fromkeys(names, none), "doc_id": pa.array(owner), "start": pa.array(places), "similarity": pa.nulls(len(owner), pa.float64()), "token": pa.array(keys.view(np.int64))})
    give_back()


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of 50 words or more that occur, equal or nearly, in a document with a smaller doc_id.

    A row for each: doc_id, start and stop (words, stop excluded), first_doc_id, first_start,
    first_stop, similarity. A word is a run of characters other than space and U+0009..U+000D,
    compared with A-Z lower-cased. Every document with a passage gets a row against a document
    with a smaller id that has it; the smallest keeps it without one. Repeats within one document don't count.

    * Null or short texts and null doc_ids give no rows; rows with the same doc_id are one document
      for this purpose and not compared with each other.
    * Texts of any length are read whole; empty in, empty out; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    dealt = docs.mapInArrow(_scan(), MADE).repartition(F.when(F.col("first").isNull(), F.col("key")).otherwise(F.xxhash64("doc")))
    links = table(dealt.sortWithinPartitions("key", "doc").mapInArrow(_lead, LINKS), "links")
    led = links.where("not made").select("key", "first", "doc")
    follow = links.where("made").select("key", F.col("first").alias("batch"), "doc").join(led.withColumnsRenamed({"first": "top", "doc": "batch"}), ["key", "batch"], "left")
    pairs = led.select("first", "doc").union(follow.select(F.coalesce("top", "batch"), "doc"))
    tried = table(pairs.where("first < doc").distinct(), "pairs")
    drop(links)
    # only documents with a link have borders, so later rounds need no others
    texts = table(passing(docs, "doc_id", table(tried.select(F.col("first").alias("id")).union(tried.select("doc")).distinct(), "wanted")), "texts")
    found = _verified(texts, tried)
    marks = table(_open(found), "marks")
    met = table(_meeting(texts, marks).join(tried, ["first", "doc"], "left_anti"), "met")
    hidden = _verified(texts, met)
    out = table(found.union(hidden).where("token is null").drop("token").distinct(), "spans")
    drop(tried, texts, found, marks, met, hidden)
    return out


def _open(found: DataFrame) -> DataFrame:
    """(token, doc, place) of the borders that no passage of their document covers, and another document has."""
    spans = found.where("token is null").groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    marks = found.where("token is not null").select("doc_id", "token", F.col("start").alias("place")).distinct()
    covered = F.exists("spans", lambda p: (p["start"] <= F.col("place")) & (p["stop"] >= F.col("place") + S.WIDTH))
    left = marks.join(spans, "doc_id", "left").where(~F.coalesce(covered, F.lit(False))).select("token", F.col("doc_id").alias("doc"), "place")
    left = table(left, "open")
    several = left.groupBy("token").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    return left.join(several.select("token"), "token")


def _firsts(rows: DataFrame, key: str) -> DataFrame:
    """(first, doc): each document of ``rows`` (key, doc) with the first one of its key."""
    first = rows.groupBy(key).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select(key, "first")
    return rows.join(first, key).where("doc > first").select("first", "doc")


def _meeting(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (first, doc) that have a run of ``SPAN`` tokens with a border in common, or a border's key."""
    places = marks.groupBy("doc").agg(F.collect_set("place").alias("places"))
    with_text = texts.select(F.col("doc_id").alias("doc"), "text").join(places, "doc")
    runs = table(with_text.mapInArrow(mapper(_runs), "run long, doc long").distinct(), "runs")
    return _firsts(runs, "run").union(_firsts(marks.select("token", "doc"), "token")).distinct()


def _runs() -> Callable:
    """Hashes of the runs of ``SPAN`` tokens with one of ``places``."""

    def step(rows: pa.Table) -> pa.Table:
        texts, ids, places = rows["text"].to_pylist(), rows["doc"].to_pylist(), rows["places"].to_pylist()
        hashed, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        weights = _hashed(np.arange(SPAN, dtype=np.uint64), 2) | np.uint64(1)
        for a, b in S.pieces(texts):
            tokens, starts = S.sequence(*S.words(texts[a:b]))
            for i in range(a, b):
                x = tokens[starts[i - a] : starts[i - a + 1]]
                if len(x) < SPAN:
                    continue
                step_ = np.zeros(len(x) + 1, np.int64)
                at = np.array(places[i], np.int64)
                np.add.at(step_, np.maximum(at - SPAN + 1, 0), 1)
                np.add.at(step_, np.minimum(at + 1, len(x)), -1)
                begin = np.flatnonzero(np.cumsum(step_)[: len(x) - SPAN + 1] > 0)
                for k in range(0, len(begin), 4096):
                    run = np.lib.stride_tricks.sliding_window_view(x, SPAN)[begin[k : k + 4096]]
                    hashed.append(S.mix((run * weights).sum(axis=1, dtype=np.uint64)))
                    owner.append(np.full(len(run), ids[i], np.int64))
        return pa.table({"run": np.concatenate(hashed).view(np.int64), "doc": np.concatenate(owner)})

    return step


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages of each of ``pairs`` (first, doc), compared on whole ``texts``, and the borders of what they share."""
    counts = pairs.groupBy("first").agg(F.count("*").alias("n"))
    blocks = pairs.join(counts, "first").withColumn("block", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / MEMBERS).cast("long")))
    members = blocks.select("first", "block", F.lit(1).alias("side"), "doc").join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("first", "block", "side", "doc", "text")
    heads = blocks.select("first", "block").distinct().join(texts.withColumnRenamed("doc_id", "first"), "first")
    heads = heads.select("first", "block", F.lit(0).alias("side"), F.col("first").alias("doc"), "text")
    dealt = heads.union(members).repartition("first", "block").sortWithinPartitions("first", "block", "side", "doc")
    return table(dealt.mapInArrow(_verify, FOUND), "found")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (start, stop); what stands between kept words stays as it is."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    gone = np.zeros(len(places) + 1, bool)
    for a, b in spans:
        gone[a : min(b, len(places))] = True
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])))
    for a, b in zip(edges[0::2], edges[1::2], strict=True):
        out.append(text[at : places[a][0]])
        at = places[b][0] if b < len(places) else places[-1][1]
    return "".join(out) + text[at:]


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of ``spans`` cut from text and n_chars, if there, made anew; documents left without words go."""
    per = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    joined = docs.join(small(table(per, "cuts"), CUTS), "doc_id", "left").select(*docs.columns, "_spans")
    place = docs.columns.index("text")

    def make() -> Callable:
        def step(t: pa.Table) -> pa.Table:
            texts, some = t["text"].to_pylist(), t["_spans"].to_pylist()
            new = [x if s is None or x is None else cut(x, [(p["start"], p["stop"]) for p in s]) for x, s in zip(texts, some, strict=True)]
            keep = pa.array([s is None or bool(_WORD.search(x or "")) for x, s in zip(new, some, strict=True)])
            return t.drop_columns(["_spans"]).set_column(place, t.schema.field("text"), pa.array(new, t.schema.field("text").type)).filter(keep)

        return step

    out = joined.mapInArrow(mapper(make), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
