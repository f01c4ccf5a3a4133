"""Token ids in length-delimited binary record files, with an offset index.

A file is a sequence of frames, little-endian::

    u64 length | u32 masked crc32 of those 8 bytes | data | u32 masked crc32 of data

and the data of a document are its id (i64), the bytes of a token id (u8: 2 where
the vocabulary allows, else 4), and its token ids in so many bytes each.  A
checksum is masked (rotated by 15 bits, plus a constant) because data that holds
its own checksum is badly guarded by it.  The checksum is the common CRC-32.

The index is a table beside the files with the place of every frame, so records
can be read in any order.  Files are written by the tasks, under a name of the
attempt; the index is written by Spark and names the files that count.  So a task
that is lost, repeated or run twice leaves no wrong record, only a file that
``sweep`` removes.

Defined results: a null or empty text has the end id only; repeated rows make a
record each, in the order of a hash of their texts; rows with a null id come first, as id
``NULL_ID``, and are read back as null; an empty table makes an empty index.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import new_folder, stage
from .words import give_back, slices, words_of

NULL_ID = -(1 << 63)
_MASK = 0xA282EAD8  # fixed value of the masked checksums of record files
#: text bytes of one file, about; and bytes read at once
FILE_BYTES, READ_BYTES = 64 * 1024 * 1024, 8 * 1024 * 1024
_HEAD, _RECORD = "<QI", "<qB"
_CACHED = 700_000  # words kept by a worker


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(head)), data, struct.pack("<I", masked(data))))


def frames(stream) -> Iterator[bytes]:
    """Data of every frame of a file; raises on a wrong length or checksum."""
    while head := stream.read(struct.calcsize(_HEAD)):
        length, check = struct.unpack(_HEAD, head)
        if masked(head[:8]) != check:
            raise ValueError("wrong checksum of a length")
        yield _data(stream, length)


def _data(stream, length: int) -> bytes:
    data = stream.read(length)
    if len(data) != length or masked(data) != struct.unpack("<I", stream.read(4))[0]:
        raise ValueError("wrong checksum of data")
    return data


def _files(folder: str):
    """The file system of a folder and its path there."""
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    """Id and token ids (u32) of a record."""
    doc, width = struct.unpack_from(_RECORD, data)
    return None if doc == NULL_ID else doc, np.frombuffer(data, f"<u{width}", offset=struct.calcsize(_RECORD)).astype("<u4")


# -- tokens -------------------------------------------------------------------


class Encoder:
    """Token ids of texts, exactly as the tokenizer file's ``encode`` gives them.

    For a tokenizer that never looks across white space (``by_word``) distinct words
    are encoded once per worker, and texts are put together from them.  Plain Latin
    words are cut up here as the file's normalizer and pattern say, and their pieces
    go to the library's model; all other words go through the library as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        if _plain(word):
            ids: list[int] = []
            for piece in _PIECE.findall(word.lower()):
                known = self.pieces.get(piece)
                if known is None:
                    spelled = piece.encode().decode("latin-1").translate(_SPELLED)
                    known = [t.id for t in self.tokenizer.model.tokenize(spelled)]
                    self.pieces[piece] = known
                ids += known
            return ids
        return self.whole(word)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text ends."""
        words = words_of(texts)
        if len(self.words) > _CACHED:
            self.words.clear()
            self.pieces.clear()
        known, found = self.words, []
        for w in words.vocabulary.to_pylist():
            ids = known.get(w)
            if ids is None:
                ids = known[w] = array("I", self.word(w)).tobytes()
            found.append(ids)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        first = np.cumsum(lengths) - lengths
        counts = lengths[words.codes]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(first[words.codes] - (ends - counts), counts)
        return flat[place], np.concatenate([[0], ends])[words.offsets]


def _byte_spelling() -> dict[int, str]:
    """Byte-level models spell bytes that do not print as characters from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _plain(word: str) -> bool:
    return _LATIN.fullmatch(word) is not None and "<|" not in word


# printing characters up to U+00FF: nothing is composed, and each has one lower case
_LATIN = re.compile("[!-~\u00a1-\u00ff]+")
_SPELLED = _byte_spelling()
_ENCODERS = "_encoders_of_this_worker"


def _pattern():
    import regex

    # the pattern stated in the tokenizer file
    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


_PIECE = _pattern()


def encoder(path: str) -> Encoder:
    """The worker's encoder: kept from task to task in the library's module, as
    functions that travel with the job are new for every task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault(_ENCODERS, {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# -- writing and reading ------------------------------------------------------

_INDEX = "shard int, file string, record long, doc_id long, offset long, bytes long, n_tokens long"
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the texts of ``docs`` in ascending doc_id order; gives the index."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // file_bytes))
    # rows of one id follow each other by a hash of their texts, and may be spread too
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        name = f"part-{shard:06d}.{uuid.uuid4().hex}.records"
        encode, offset, record = encoder(tokenizer), 0, 0
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        # on stores the file appears when it is closed, elsewhere only the index makes it count
        with files.open_output_stream(f"{path}/{name}", buffer_size=READ_BYTES) as out:
            for batch in batches:
                for part in slices(batch):
                    ids, ends = encode.texts(part.column("text"))
                    raw, ends = ids.astype(f"<u{width}").tobytes(), ends.tolist()
                    found = []
                    for doc, a, b in zip(part.column("doc_id").to_pylist(), ends, ends[1:]):
                        data = frame(struct.pack(_RECORD, doc, width) + raw[width * a : width * b] + end)
                        out.write(data)
                        found.append((shard, name, record, doc, offset, len(data), b - a + 1))
                        offset, record = offset + len(data), record + 1
                    yield pa.record_batch([pa.array(c) for c in zip(*found)], _INDEX_NAMES).cast(_INDEX_TYPES)
        give_back()

    ordered.mapInArrow(write, _INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


_INDEX_TYPES = pa.schema(
    [(n, {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}[c.split()[1]]) for n, c in zip(_INDEX_NAMES, _INDEX.split(", "))]
)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Removes record files that the index does not name; gives their names.  Files
    are as many as shards, so their names may be listed here."""
    files, path = _files(folder)
    named = {r["file"] for r in read_index(spark, folder).select("file").distinct().collect()}
    found = [f for f in files.get_file_info(pa.fs.FileSelector(path)) if f.base_name.endswith(".records")]
    lost = [f for f in found if f.base_name not in named]
    for f in lost:
        files.delete_file(f.path)
    return [f.base_name for f in lost]


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, record) of every record, read from
    the files in their order.  ``start`` counts the ids of all records before."""
    index = read_index(spark, folder)
    sums = stage(index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("ids")), "shards")
    # a row per file
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    names = sums.select("shard", "file", F.coalesce(before, F.lit(0)).alias("start"))
    tasks = max(1, names.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            start, found = row["start"], []
            with files.open_input_stream(f"{path}/{row['file']}", buffer_size=READ_BYTES) as stream:
                for record, data in enumerate(frames(stream)):
                    doc, ids = parsed(data)
                    found.append((doc, start, len(ids), zlib.crc32(ids), row["shard"], record))
                    start += len(ids)
                    if len(found) == 10_000:
                        yield _read_batch(found)
                        found = []
            if found:
                yield _read_batch(found)

    return names.repartitionByRange(tasks, "shard").mapInArrow(read, _READ)


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, record long"


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32() if c.split()[1] == "int" else pa.int64() for c in _READ.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in _READ.split(", ")])


def fetch_records(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the index rows given, in any order, each read at its place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        name, stream = None, None
        for batch in batches:
            docs, ids = [], []
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, stream = row["file"], files.open_input_file(f"{path}/{row['file']}")
                stream.seek(row["offset"])
                data = next(frames(stream))
                doc, found = parsed(data)
                docs.append(doc)
                ids.append(found.astype(np.int64))
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return index.select("file", "offset").mapInArrow(read, "doc_id long, ids array<long>")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "records")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_records(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_records(spark, folder)
