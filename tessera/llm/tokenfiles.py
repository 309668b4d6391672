"""Token ids as Arrow files of equal-length sequences, written by Spark and read without copies.

The ids of all documents, each followed by an end id, are one stream in order of doc_id. It is cut
into sequences of ``SEQUENCE`` ids. A file in Arrow's file format (a stream of batches and a footer with
their places) holds batches of fixed-size lists: ``ids``, ``mask`` (false where the last sequence of the
file is filled up) and ``begins``, the documents that start in a sequence and where. As lists of a fixed
size have no offsets, sequence i of a mapped file is a slice of one buffer.

Files begin and end with a document. They are made in tasks as bytes and written by the text source, whose
line separator is the magic that ends the format, one line a file: so Spark's commit protocol covers them
on any file system, and a lost executor leaves no half file.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.packing import _byte_characters
from tessera.llm.shared import drop, give_back, in_batches, mapper, partitions, scratch, table
from tessera.plans.catalogue import small

SEQUENCE = 2048
#: Sequences of a batch, and of a file, which a document that is longer may exceed.
BATCH, FILE = 256, 4096
#: Files whose places are broadcast at most.
FILES = 200_000
#: What ends, as it begins, a file of the format.
MAGIC = b"ARROW1"
#: Words whose ids a worker keeps, some 32 bytes each.
KNOWN = 4_000_000
#: Characters from which a word is none: it has fewer than 2**20 ids.
WORD = 1 << 17

#: Fixed value: how the vocabulary's tokenizer parts a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space but spaces and line ends, and what some call so: a text with it isn't parted by splitting.
_ODD = re.compile("[\\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
#: A Latin letter and punctuation behind it, where a piece begins.
_TAIL = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([,.;:!?])"
#: Texts in which all agree on what is a letter, a digit or white space.
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f]*")
_LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


class Known:
    """Ids of words by two independent hashes of 64 bits, in sorted arrays: a fraction of the room that words and ids take as objects."""

    def __init__(self, kind: np.dtype) -> None:
        self.blob = np.zeros(0, kind)
        self.keys, self.checks, self.places = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Where the ids of each word stand, as first place times 2**20 and their number; -1 for words that aren't known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), self.places[at], -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Keeps words, and tells their places."""
        new = np.frombuffer(b"".join(ids), self.blob.dtype)
        sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids)) // self.blob.itemsize
        places = (len(self.blob) + np.cumsum(sizes) - sizes << 20) + sizes
        self.blob = np.concatenate([self.blob, new])
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.checks, self.places = (np.insert(old, at, x[order]) for old, x in ((self.keys, keys), (self.checks, checks), (self.places, places)))
        return places


class ByteIds:
    """Ids of texts by a byte-level vocabulary, word by word as most recur.

    A piece's ids don't depend on its neighbours. A space before anything but white space begins a piece,
    and so do punctuation behind a letter, a line end and what follows it, unless white space stands beside it. So texts are split there, known words
    are looked up, and new ones parted into pieces for the tokenizer's model. Texts and words with special
    tokens or characters on whose kind tools may disagree go to the tokenizer as a whole, as do all
    with another kind of tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code, self.kind = ("H", np.dtype("<u2")) if self.width == 2 else ("I", np.dtype("<u4"))
        self.bytes = str.maketrans(_byte_characters())
        self.space = _byte_characters()[" "]
        self.model = self.tokenizer.model
        self.parts = regex.compile(PIECES)
        self.known = Known(self.kind)
        probes = ["It's 12,5 %", " don't...\n\nthey've  gone\t \n", "Größe ½ niño's #1", "x" * 40, "\r\n a", "'S 'll9z", "a\nb, c"]
        self.fast = all(self._parted(p) == self._whole(p) for p in probes)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        # letters of ASCII stand for themselves, and a space before them for one sign
        shown = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bytes)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _parted(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.parts.findall(text)))

    def _new(self, text: str) -> bytes:
        if _LETTERS.fullmatch(text):
            return self._piece(text)
        return self._parted(text) if _PLAIN.fullmatch(text) else self._whole(text)

    def of(self, text: str) -> np.ndarray:
        """The ids of one text, not word by word."""
        return np.frombuffer(self._whole(text) if not self.fast or any(s in text for s in self.special) else self._new(text), self.kind)

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the ids of each of these different words stand among the known ones; -1 for words that don't stand alone.

        Those are words with white space that may belong to a longer run, and very long ones, which aren't kept.
        """
        keys = np.fromiter(map(hash, words), np.int64, len(words))
        checks = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        places = self.known.find(keys, checks)
        new = [i for i in np.flatnonzero(places < 0).tolist() if len(words[i]) < WORD and (_LETTERS.fullmatch(words[i]) or not _ODD.search(words[i]))]
        if len(self.known.keys) and len(self.known.keys) + len(new) > KNOWN:  # all go, and those of this batch come back
            self.known = Known(self.kind)
            return self._places(words)
        places[new] = self.known.add(keys[new], checks[new], [self._new(words[i]) if words[i] else b"" for i in new])
        return places

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of ``texts``; words are split and told apart by Arrow, so that Python sees each word of the batch once."""
        odd = pc.match_substring_regex(texts, r"[ \t\n\r\v\f]\z")
        for part in ("  ", "\n\n", " \n", "\n ", "\0", *self.special):
            odd = pc.or_(odd, pc.match_substring(texts, part))
        odd = odd.to_numpy(zero_copy_only=False) if self.fast else np.ones(len(texts), bool)
        out: list[np.ndarray | None] = [None] * len(texts)
        if not odd.all():
            marked = pc.replace_substring_regex(texts.filter(pa.array(~odd)), _TAIL, "\\1\0\\2")
            marked = pc.replace_substring(pc.replace_substring(marked, " ", "\0 "), "\n", "\0\n\0")
            split = pc.split_pattern(marked, "\0")
            words = split.flatten().dictionary_encode()
            codes, bounds = words.indices.to_numpy(), split.offsets.to_numpy()
            places = self._places(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            sizes, firsts, alone, blob = places & ((1 << 20) - 1), places >> 20, places >= 0, self.known.blob
            for i, a, b in zip(np.flatnonzero(~odd).tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = codes[a:b]
                if alone[own].all():
                    n = sizes[own]
                    ends = np.cumsum(n)
                    out[i] = blob[np.repeat(firsts[own] - ends + n, n) + np.arange(ends[-1])]
        return [self.of(texts[i].as_py()) if x is None else x for i, x in enumerate(out)]


#: Kept while a worker lives, so that its next task starts with what is known.
_ids: dict[str, ByteIds] = {}


def kind(width: int, sequence: int) -> pa.Schema:
    """The schema of files whose ids take ``width`` bytes."""
    begins = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())]))
    return pa.schema([("ids", pa.list_(pa.uint16() if width == 2 else pa.uint32(), sequence)), ("mask", pa.list_(pa.bool_(), sequence)), ("begins", begins)])


def encode_file(documents: Iterable[tuple[int | None, np.ndarray]], part: int, number: int, sequence: int = SEQUENCE) -> bytes:
    """A file of the ids of ``documents``; ``part`` and ``number`` are its place among the files."""
    docs = list(documents)
    ids = np.concatenate([x for _, x in docs])
    n = -(-len(ids) // sequence)
    filled = np.zeros(n * sequence, ids.dtype)
    filled[: len(ids)] = ids
    starts = np.cumsum([0, *(len(x) for _, x in docs[:-1])])
    offsets = np.searchsorted(starts // sequence, np.arange(n + 1)).astype(np.int32)
    begins = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(starts % sequence, pa.int32())], names=["doc_id", "at"]))
    schema = kind(ids.itemsize, sequence)
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(filled), sequence), pa.FixedSizeListArray.from_arrays(pa.array(np.arange(n * sequence) < len(ids)), sequence), begins]
    rows = pa.table(columns, schema=schema.with_metadata({"part": str(part), "number": str(number)}))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, rows.schema) as out:
        out.write_table(rows, max_chunksize=BATCH)
    return sink.getvalue().to_pybytes()


@dataclass
class Shard:
    """An open file: sequences by number, without copies, and documents by their place in it."""

    reader: pa.RecordBatchFileReader

    def __post_init__(self) -> None:
        self.sequence = self.reader.schema.field("ids").type.list_size
        names = self.reader.schema.metadata
        self.part, self.number = int(names[b"part"]), int(names[b"number"])
        self.batches = [self.reader.get_batch(i) for i in range(self.reader.num_record_batches)]
        self.first = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def ids(self, at: int) -> np.ndarray:
        """The ids of sequence ``at``, a view of the file's bytes."""
        k = int(np.searchsorted(self.first, at, side="right")) - 1
        return self.batches[k]["ids"].values.slice((at - int(self.first[k])) * self.sequence, self.sequence).to_numpy()

    def mask(self, at: int) -> pa.BooleanArray:
        """Which ids of sequence ``at`` are a document's, a view of the file's bits."""
        k = int(np.searchsorted(self.first, at, side="right")) - 1
        return self.batches[k]["mask"].values.slice((at - int(self.first[k])) * self.sequence, self.sequence)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the file and ids of each document."""
        total = int(sum(b["mask"].values.true_count for b in self.batches))
        ids = np.concatenate([b["ids"].values.to_numpy() for b in self.batches])[:total]
        names, starts = [], []
        for k, b in enumerate(self.batches):
            begins = b["begins"]
            rows = np.repeat(np.arange(b.num_rows), np.diff(begins.offsets.to_numpy())) + int(self.first[k])
            flat = begins.flatten()
            names += flat.field("doc_id").to_pylist()
            starts.append(rows * self.sequence + flat.field("at").to_numpy())
        bounds = np.append(np.concatenate(starts), total)
        for doc, a, b in zip(names, bounds[:-1], bounds[1:], strict=True):
            yield doc, int(a), ids[a:b]


def open_shard(source: str | pa.Buffer) -> Shard:
    """A file by its local path, mapped into memory, or as bytes."""
    return Shard(pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source)))


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, sequence: int = SEQUENCE, most: int = FILE) -> None:
    """Files of all rows of ``docs`` (doc_id, text) under ``path``, in order of doc_id, then of the text's hash."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # equal rows are parted by a salt, so that a task gets no more than its share of them
    salted = rows.withColumn("hash", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    ready = salted.repartitionByRange(partitions(spark), "doc_id", "hash", "salt").sortWithinPartitions("doc_id", "hash", "salt").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        if tokenizer not in _ids:
            _ids[tokenizer] = ByteIds(tokenizer)
        ids = _ids[tokenizer]
        end = np.array([end_id], ids.kind)
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def ready_file() -> pa.RecordBatch:
            nonlocal held, size, number
            made = pa.RecordBatch.from_arrays([pa.array([encode_file(held, part, number, sequence)[: -len(MAGIC)]], pa.binary())], names=["value"])
            held, size, number = [], 0, number + 1
            return made

        for t in in_batches(batches, 1 << 24):
            for doc, own in zip(t["doc_id"].to_pylist(), ids.batch(t["text"].combine_chunks()), strict=True):
                held.append((doc, np.concatenate([own, end])))
                size += len(own) + 1
                if size >= most * sequence:
                    yield ready_file()
        if held:
            yield ready_file()
        give_back()

    files = ready.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).text(path)


READ = "part int, number int, doc_id long, at long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files under ``path``, from the files alone: part, number, doc_id, at (its start in the file), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def make() -> Callable[[pa.Table], pa.Table | None]:
        def step(t: pa.Table) -> pa.Table | None:
            out: list[tuple] = []
            for data in (x for c in t["content"].chunks for x in c):
                if len(data.as_buffer()):
                    shard = open_shard(data.as_buffer())
                    out += ((shard.part, shard.number, doc, at, len(own), zlib.crc32(own.astype("<u4"))) for doc, at, own in shard.documents())
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
            return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(READ.split(", "), zip(*out, strict=True), kinds, strict=True)}) if out else None

        return step

    return files.mapInArrow(mapper(make), READ)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) as Arrow files and reads them back: doc_id, start, n_tokens, ids_crc32, a row for each row.

    start counts the ids of all documents before, n_tokens those of the document with its end id, of
    which ids_crc32 is the checksum as 32-bit numbers. The files stay in the shared folder, or under ``path``.

    * Null or empty text: only the end id. Null doc_ids come first.
    * Repeated doc_ids are documents each, in order of their texts' hashes.
    * Very long texts are one document over many sequences and batches of one file. An empty table gives no rows.
    * Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write(docs, tokenizer, path, end_id)
    found = table(read(spark, path), "documents")
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file of a task
    files = table(files.withColumn("within", F.coalesce(within, F.lit(0))), "files")
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task that wrote
    places = files.join(F.broadcast(parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))), "part").select("part", "number", (F.col("before") + F.col("within")).alias("base"))
    out = found.join(small(places, FILES), ["part", "number"])
    out = table(out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"), "token_files")
    drop(found, files)
    return out
