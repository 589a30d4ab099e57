"""Token ids of a corpus as Arrow files of equal-length sequences.

A shard is one Arrow file in the random-access format. Every row is a sequence of ``length`` ids with
two bit masks, ``real`` (false: padding) and ``ends`` (true: last id of a document), each a
fixed-size list, so that the ids of a record batch are one buffer and row i of a mapped file is a
slice of it. Documents follow each other without gaps in ascending id; only the last sequence of a
shard is padded. Beside it lies an Arrow file with the shard's documents: doc_id, start, n_tokens.

Rows are dealt to shards by ranges of (doc_id, hash of the text), so that the shards in order hold the
corpus in order, a repeated id is spread over shards, and no task holds more than a batch of texts
and a batch of sequences. A task that is run again writes files of new names; the manifest names
those of the attempt that counts, and is itself a table in the shared folder.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LENGTH = 2048  # ids in a sequence
BATCH_ROWS = 256  # sequences in a record batch
SHARD_BYTES = 64 << 20  # text in a shard
CACHE_CHUNKS = 1_000_000  # chunks whose ids a task remembers; beyond, it starts over
CACHE_IDS = 1 << 23
PIECE_BYTES = 1 << 21  # text encoded at once

# Fixed value: the rule for pieces that ``parted`` follows.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Kinds of bytes: 0 not to be cut at (white space, apostrophe, non-ASCII), 1 letter, 2 digit, 3 other printable sign.
_KINDS = np.array(
    [0 if b <= 0x20 or b >= 0x7F or b == 0x27 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8
)
_APART = np.array([[False] * 4, [False, False, True, True], [False, True, True, True], [False, True, True, False]])
_WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_END = None  # stands for the end of a document among chunks
LISTING = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, sequences string, documents string, n_documents long, n_tokens long"


def drops_white_space(spec: dict) -> bool:
    """Whether the file's rules are: lower case, white space dropped, pieces of letters, single digits or other signs.

    Then a text encodes as its chunks do, cut at ASCII white space and where those three meet.
    """
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    kinds = {n["type"] for n in norm.get("normalizers", [norm] if norm else [])}
    splits = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex") == PIECES
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in spec["added_tokens"])
    return bool("Lowercase" in kinds and kinds <= {"NFC", "Lowercase", "Replace"} and splits and plain)


class _Slots(dict):
    """Chunk to number; unknown chunks take the next one and are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes | None] = []

    def __missing__(self, chunk: bytes | None) -> int:
        self[chunk] = slot = len(self)
        self.new.append(chunk)
        return slot


class Encoder:
    """Ids of texts as the library gives them, without special tokens of its own; ``end_id`` after each text.

    Where the tokenizer's rules allow it, texts are cut into chunks and equal chunks are encoded once.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = drops_white_space(spec)
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.kind = np.uint16 if max(self.library.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.slots[_END]
        self.slots.new.clear()
        self.ids = np.array([self.end_id], self.kind)
        self.starts, self.sizes = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self) -> None:
        """Encode the chunks noted as unknown."""
        found = self.library.encode_batch_fast([c.decode("utf-8", "replace") for c in self.slots.new], add_special_tokens=False)
        ids = [e.ids for e in found]
        self.slots.new.clear()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), self.kind, int(sizes.sum()))])

    def _chunks(self, text: bytes) -> Iterator[list[bytes | None]]:
        """The chunks of a text in lists of about ``PIECE_BYTES``."""
        if not self.chunked:
            yield [text] if text else []
            return
        special = any(s in text for s in self.specials)
        at = 0
        while at < len(text):
            cut = _WHITE.search(text, at + PIECE_BYTES)
            end = cut.start() if cut else len(text)
            # Special strings count as they stand, so a text with any is cut at white space only.
            yield text[at:end].split() if special else parted(text[at:end]).split()
            at = end

    def _look_up(self, chunks: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and the places after each document's end among them."""
        if len(self.slots) > CACHE_CHUNKS or len(self.ids) > CACHE_IDS or not self.chunked:
            self._clear()
        slots = np.fromiter(map(self.slots.__getitem__, chunks), np.int64, len(chunks))
        if self.slots.new:
            self._learn()
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[slots] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        return ids, ends[slots == 0]

    def encode(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the texts in bounded runs, with the places in the run after which a document ends."""
        waiting, size = [], 0
        for text in (t or b"" for t in texts):
            for chunks in self._chunks(text):
                if size >= PIECE_BYTES:
                    yield self._look_up(waiting)
                    waiting, size = [], 0
                waiting += chunks
                size += min(len(text), PIECE_BYTES)
            waiting.append(_END)
        if waiting:
            yield self._look_up(waiting)


def parted(text: bytes) -> bytes:
    """The text in ASCII lower case, with blanks where ASCII letters, digits and other signs meet.

    Nothing is put beside an apostrophe, which may open a piece with the letters after it, nor beside a
    byte of a non-ASCII sign, whose kind it does not tell.
    """
    data = np.frombuffer(text.lower(), np.uint8)
    kind = _KINDS[data]
    apart = _APART[kind[:-1], kind[1:]] if len(data) else np.empty(0, bool)
    out = np.full(len(data) + int(apart.sum()), 0x20, np.uint8)
    out[np.arange(len(data)) + np.concatenate([[0], np.cumsum(apart)])[: len(data)]] = data
    return out.tobytes()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    system, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
    return system, path


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches of ``batch_rows``."""

    def __init__(self, sink, kind: type, length: int, batch_rows: int):
        self.length, self.rows = length, batch_rows
        ids, bits = pa.list_(pa.from_numpy_dtype(kind), length), pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("ids", ids), ("real", bits), ("ends", bits)])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.kind, self.ids, self.ends, self.size = kind, [], [], 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids.append(ids)
        self.ends.append(self.size + ends - 1)
        self.size += len(ids)
        full = self.length * self.rows
        if self.size >= full:
            ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
            whole = self.size // full * full
            for at in range(0, whole, full):
                self._write(ids[at : at + full], ends[(ends >= at) & (ends < at + full)] - at)
            self.ids, self.ends, self.size = [ids[whole:]], [ends[ends >= whole] - whole], self.size - whole

    def _write(self, ids: np.ndarray, ends: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        values = np.zeros(rows * self.length, self.kind)
        values[: len(ids)] = ids
        marks = np.zeros(len(values), bool)
        marks[ends] = True
        columns = (values, np.arange(len(values)) < len(ids), marks)
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in columns]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._write(np.concatenate(self.ids), np.concatenate(self.ends))
        self.file.close()


class SequenceFile:
    """Random access to the sequences of one shard; local files are mapped and nothing is copied."""

    def __init__(self, uri: str):
        system, path = open_folder(uri)
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batches = self.file.num_record_batches
        self.rows = self.file.get_batch(0).num_rows if self.batches else 0  # of all batches but the last

    def __len__(self) -> int:
        return (self.batches - 1) * self.rows + self.file.get_batch(self.batches - 1).num_rows if self.batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        """Ids, real and ends of sequence ``i``: views of the file."""
        batch, row = self.file.get_batch(i // self.rows), i % self.rows
        ids, real, ends = (batch.column(c).values.slice(row * self.length, self.length) for c in ("ids", "real", "ends"))
        return ids.to_numpy(zero_copy_only=True), real, ends

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per batch its real ids and the places after which a document ends."""
        for i in range(self.batches):
            batch = self.file.get_batch(i)
            size = batch.column("real").values.true_count  # padding stands at the end
            ids = batch.column("ids").values.to_numpy(zero_copy_only=True)[:size]
            yield ids, np.flatnonzero(batch.column("ends").values.to_numpy(zero_copy_only=False)) + 1


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, length: int = LENGTH, batch_rows: int = BATCH_ROWS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Encode ``docs`` into shards below ``folder``; returns the manifest, which is stored there too.

    Manifest: shard, sequences and documents (the two files), n_documents, n_tokens (end ids
    included), first (ids in all shards before). Documents stand by doc_id, null last; rows with the
    same id by a hash of their text. A null text has its end id only; bytes that are not UTF-8 count as
    replacement characters. An empty table gives no shards. Only doc_id and text are read; every
    worker opens ``tokenizer_path``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("size")).first()["size"] or 0
    shards = max(-(-size // shard_bytes), min(2 * spark.sparkContext.defaultParallelism, -(-size // (1 << 20))), 1)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/shard-{context.partitionId():06d}-{uuid.uuid4().hex[:12]}"
        encoder = writer = None
        n_documents = n_tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = Encoder(tokenizer_path, end_id)
                system, path = open_folder(name)
                if isinstance(system, fs.LocalFileSystem):
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                sinks = [system.open_output_stream(f"{path}.{part}.arrow") for part in ("sequences", "documents")]
                writer = SequenceWriter(sinks[0], encoder.kind, length, batch_rows)
                listing = pa.ipc.new_file(sinks[1], LISTING)
            ends = []
            upto = n_tokens
            for ids, here in encoder.encode(batch.column(1).to_pylist()):
                writer.add(ids, here)
                ends.append(upto + here)
                upto += len(ids)
            ends = np.concatenate(ends)
            starts = np.concatenate([[n_tokens], ends[:-1]])
            listing.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts), pa.array(ends - starts)], schema=LISTING))
            n_documents, n_tokens = n_documents + batch.num_rows, upto
        if writer is not None:
            for file in (writer, listing, *sinks):
                file.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([context.partitionId()], pa.int32()), "sequences": [f"{name}.sequences.arrow"], "documents": [f"{name}.documents.arrow"],
                "n_documents": pa.array([n_documents], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()),
            })

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, in order: the sum runs over shards, not over documents."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/manifest").withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the files, one row: doc_id, start (in the corpus), n_tokens, ids_crc32.

    Lengths and checksums come from the sequences and their marks, ids from the list of documents; files
    that contradict each other are an error.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    names = [f.split()[0] for f in schema.split(", ")]

    def documents(sequences: str) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Ends in the shard and checksums of the documents that end in each batch."""
        at, crc = 0, 0
        for ids, ends in SequenceFile(sequences).stream():
            wide, start, sums = memoryview(ids.astype("<u4")).cast("B"), 0, []
            for end in ends.tolist():
                sums.append(zlib.crc32(wide[4 * start : 4 * end], crc))
                start, crc = end, 0
            crc = zlib.crc32(wide[4 * start :], crc)
            yield ends + at, sums
            at += len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sequences, listed, first in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                system, path = open_folder(listed)
                with system.open_input_file(path) as source:
                    file = pa.ipc.open_file(source)
                    waiting = (file.get_batch(i) for i in range(file.num_record_batches))
                    rows, used, last = None, 0, 0
                    for ends, sums in documents(sequences):
                        done = 0
                        while done < len(ends):
                            if rows is None or used == rows.num_rows:
                                rows, used = next(waiting), 0
                            take = min(len(ends) - done, rows.num_rows - used)
                            part, here = rows.slice(used, take), ends[done : done + take]
                            starts = np.concatenate([[last], here[:-1]])
                            if not np.array_equal(part.column("start").to_numpy(), starts) or not np.array_equal(part.column("n_tokens").to_numpy(), here - starts):
                                raise ValueError(f"{listed} does not fit {sequences}")
                            columns = [part.column("doc_id"), pa.array(first + starts), pa.array(here - starts), pa.array(sums[done : done + take], pa.int64())]
                            yield pa.RecordBatch.from_arrays(columns, names=names)
                            done, used, last = done + take, used + take, int(here[-1])
                    if next(waiting, None) is not None or (rows is not None and used < rows.num_rows):
                        raise ValueError(f"{listed} names more documents than {sequences} holds")

    files = manifest.select("sequences", "documents", "first")
    # A shard is read by one task; their number is in the manifest.
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)
