"""Best-fit packing of tokenized documents into sequences, with certified bounds and exchange between partitions.

A document's ids are those of its text followed by an end id. Documents longer than a
sequence are cut into full pieces and a rest. Pieces are dealt to partitions of bounded
size, each packed by best-fit decreasing. Dual feasible functions give a lower bound on
the bins of each partition; where it meets the count, the packing is certified optimal
for that partition. The badly filled bins of partitions that leave a gap, and of those
whose last bins waste room, are opened and exchanged over fewer partitions and packed
again, until one partition is left or nothing more can be saved; then the bins stay as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.shared import drop, mapper, table

CAPACITY = 2048
#: Pieces packed together in one task.
DEALT = 60_000
#: Bytes of words and ids that a worker keeps, and characters of a word that is kept at most.
KNOWN, LONGEST = 64 << 20, 48
#: Bytes that a kept word takes beside its characters and ids.
_ENTRY = 200

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_characters() -> dict[str, str]:
    """The visible character by which byte-level vocabularies write each byte: itself if printable, else the next from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(b): chr(256 + i) for i, b in enumerate(hidden)}


class Ids:
    """Little-endian 32-bit ids of texts, word by word, as most words recur.

    The tokenizer normalises to NFC and lower case, drops white space and never joins over
    it, nor a letter with punctuation behind it; ``splits`` tells if that holds for a
    tokenizer, else each text is encoded in one, as are texts in which it could fail.
    Words of letters not seen yet go to the vocabulary's model directly, others are
    encoded together, set apart by a special token.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted(i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.mark = special[0] if special else None
        self.between = self.tokenizer.id_to_token(self.mark) if special else ""
        self.bytes = str.maketrans(_byte_characters())
        probe = self._one("Ab, c.").startswith(self._one("ab") + self._one(",")) and self._one(" a b ") == self._one("a") + self._one("b")
        self.splits = bool(special) and probe and not self._one(" ") and all(self._word(w) == self._one(w) for w in ("a", "street", "größe", "ciónque"))
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    def _one(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.bytes))]).tobytes()

    def _encoded(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        rest = []
        for w in new:
            if w.isalpha():
                yield w, self._word(w)
            else:
                rest.append(w)
        if rest:
            ids = np.array(self.tokenizer.encode(self.between.join(rest), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            for w, a, b in zip(rest, [0, *(ends + 1)], [*ends, len(ids)], strict=True):
                yield w, ids[a:b].tobytes()

    def of(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, text by text, so that no more than one text's words are held beside those kept."""
        for text in texts:
            low = _plain(text) if self.splits else None
            if low is None:
                yield self._one(text)
                continue
            words = _BEHIND.sub(r" \g<0>", low).replace("\n", " ").split(" ")
            try:
                yield b"".join(map(self.known.__getitem__, words))
            except KeyError:
                found = dict(self._encoded([w for w in set(words) if w not in self.known]))
                yield b"".join([found[w] if w in found else self.known[w] for w in words])
                self._keep(found)

    def _keep(self, found: dict[str, bytes]) -> None:
        short = {w: ids for w, ids in found.items() if len(w) <= LONGEST}
        self.known |= short
        self.held += sum(_ENTRY + len(w) + len(ids) for w, ids in short.items())
        if self.held > KNOWN:
            self.known, self.held = {"": b""}, 0


#: Punctuation right behind a letter.
_BEHIND = re.compile(r"(?<=[^\W\d_])[.,;:!?#*%&$|()]")


def _plain(text: str) -> str | None:
    """The text in lower case, if this is all that the tokenizer would change: no special token's beginning, no final sigma, NFC before and after."""
    if "<|" in text or "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
        return None
    low = text.lower()
    return low if low.isascii() or unicodedata.is_normalized("NFC", low) else None


#: Kept while a worker lives, so that its next task starts with what is known.
_ids: dict[str, Ids] = {}


def _cut(path: str, capacity: int, end_id: int) -> Callable:
    def make() -> Callable:
        if path not in _ids:
            _ids[path] = Ids(path)
        ids, end = _ids[path], np.array([end_id], "<u4").tobytes()

        def step(rows: pa.Table) -> pa.Table:
            out: list[tuple] = []
            texts = (t.as_py() or "" for chunk in rows["text"].chunks for t in chunk)
            for doc, raw in zip(rows["doc_id"].to_pylist(), ids.of(texts), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return step

    return mapper(make)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, capacity, end_id), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of several dual feasible functions: no packing of these lengths has fewer bins."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = math.ceil(int((sizes * counts).sum()) / capacity)
    for k in range(1, 11):  # rounding functions: x is worth floor((k + 1) x) / k unless (k + 1) x is whole
        whole = (k + 1) * sizes % capacity == 0
        worth = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((worth * counts).sum()) // (k * capacity)))
    for e in np.unique(np.concatenate([sizes[sizes <= capacity // 2], capacity - sizes[sizes > capacity // 2]]))[:256]:  # small ones dropped, large ones rounded up
        worth = np.where(sizes > capacity - e, capacity, np.where(sizes >= e, sizes, 0))
        best = max(best, -(-int((worth * counts).sum()) // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, taken in descending order (ties by position), and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room left
    has, n = 0, 0  # bit r of has: some bin has room r
    for i in order.tolist():
        size = int(lengths[i])
        fits = has >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                has &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            rooms[left].append(b)
            has |= 1 << left
    return bins, offsets, n


def _pack(capacity: int, base: int, last: bool) -> Callable:
    """Packs a partition; rows of bins that stay get a sequence_id, those of opened bins -1 less what their bin's would be."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for r in rows if r.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths = t["length"].to_numpy()
        bins, offsets, n = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        certified = n == lower_bound(lengths, capacity)
        waste = capacity - fill
        opened = np.zeros(n, bool)
        if not last:
            # Without a gap only the room of all bins together can be saved elsewhere; with one, more bins are opened.
            opened = waste > (capacity // 8 if certified else capacity // 64)
        part = int(t["dealt"][0].as_py())
        ids = (base << 48) + (part << 24) + bins
        ids = np.where(opened[bins], -1 - ids, ids)
        t = t.drop_columns(["dealt"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from t.combine_chunks().to_batches()

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, dealt: int = DEALT) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    A task holds about ``dealt`` pieces at most, so sequences never depend on one task
    seeing everything. A piece longer than ``capacity`` is an error, one of length 0 too.
    Opened bins stay where a turn saves none and leaves as many groups as before, and after the
    last turn. It is an error if not every piece has a place.
    """
    kind = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    done: list[DataFrame] = []
    total = parts.count()
    rest, n, before = parts, total, math.inf
    for turn in range(1, 64):
        count = max(1, math.ceil(n / dealt))
        group = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(turn)), F.lit(count)).cast("int")
        ready = rest.withColumn("dealt", group).repartition(count, "dealt") if count > 1 else rest.withColumn("dealt", F.lit(0)).coalesce(1)
        # two groups may share a partition, and another be empty: each partition is packed as a whole, named by its first group
        out = table(ready.mapInArrow(_pack(capacity, turn, count == 1), kind), "packed")
        left, bins, opened = out.agg(F.count_if(F.expr("sequence_id < 0")), F.count_if(F.expr("offset = 0")), F.count_if(F.expr("sequence_id < 0 and offset = 0"))).first()
        if turn == 63 or (bins >= before and math.ceil(left / dealt) >= count):
            out, left = out.withColumn("sequence_id", F.when(F.col("sequence_id") < 0, -1 - F.col("sequence_id")).otherwise(F.col("sequence_id"))), 0
        done.append(out.where("sequence_id >= 0"))
        if not left:
            break
        rest, n, before = out.where("sequence_id < 0").select(parts.columns), left, opened
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    placed = packed.count()
    if placed != total:
        raise RuntimeError(f"{placed} of {total} pieces have a place")
    return packed


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """All of ``docs`` (doc_id, text) as pieces with places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    * Null or empty text: only the end id. Null doc_id: packed like any other.
    * Very long texts are cut into full pieces; only the last may be shorter.
    * Repeated rows or doc_ids are packed once for each row; ties go by doc_id, then piece.
    * An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    parts = table(pieces(docs, tokenizer, capacity, end_id), "pieces")
    out = table(pack(parts, capacity), "sequences")
    drop(parts)
    return out
