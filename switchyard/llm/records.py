"""Token ids in length-delimited binary records, with a separate offset index.

A record file holds frames, one per document, in ascending order of ``doc_id`` (rows
without an id first, equal ids by the hash of their text)::

    length   8 bytes   of the data, little-endian unsigned
    check    4 bytes   masked CRC-32 of the eight length bytes
    data               1 byte id width, 1 byte "has an id", 8 bytes doc_id, then the ids
    check    4 bytes   masked CRC-32 of the data

A checksum is masked by a rotation and an added constant, so that data which contain
checksums don't have a trivial one themselves.  Ids take two bytes each where all ids
of the sequence allow it, else four.

Beside each record file lies its index: 24 bytes per record (offset, length of the
data, number of ids), so records can be read in any order without a scan.

Tasks write files under names of their own and only report them; the manifest, which
Spark's committed writer stores last, names the files that count.  A lost or repeated
task leaves files that no manifest names.  Files are closed at ``FILE_BYTES``, so a
partition of any size gives files of a size.
"""

from __future__ import annotations

import json
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Split

FILE_BYTES = 256 << 20
#: Distinct words that a worker keeps encoded in each of two generations.
KNOWN = 400_000
#: Rows of a batch that leaves a task, and bytes of ids after which it leaves earlier.
OUT_ROWS, OUT_BYTES = 512, 8 << 20
# Fixed value: what a masked checksum adds, as in the TFRecord layout.
MASK = 0xA282EAD8
_LENGTH = struct.Struct("<QI")
_HEAD = struct.Struct("<BBq")
_CHECK = struct.Struct("<I")
_ENTRY, _ENTRY_SIZE = "<QQQ", 24
MANIFEST = "part long, seq int, file string, index string, records long, tokens long, bytes long"
RECORDS = "doc_id long, start long, n_tokens long, ids binary"

_BESIDE_SPACE = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# White space other than a line end in front, or "<|"; what comes first is the character to look for.
_ODD = re.compile(r"[\s<](?:(?<=[^\S\n])|(?<=[\s\S]\n)|(?<=\n)\Z|(?<=<)\|)")
#: Marks that can follow letters without being a part of their pre-token, and letters that every version of Unicode has.
_MARKS = string.punctuation.replace("'", "")
_LETTERS = [c for c in map(chr, range(0x250)) if c.isalpha()]


class Encoder:
    """Texts -> ids, each different word encoded once.

    No pre-token of a byte-level vocabulary goes on beyond a single space or line end
    that stands between two other characters, so texts are cut before those.  A word's
    key is the word itself after a space, and the word with its line end after one.

    What is known lies in two generations, ``store`` and ``old``: when the first is full it
    becomes the other, and keys that come again move on.  The library's own cache of words
    is off: a word comes to it once."""

    def __init__(self, tokenizer: Tokenizer, known: int = KNOWN):
        described, self.known = tokenizer.to_str(), known
        self.tokenizer = Tokenizer.from_str(described)
        self.tokenizer.model = _uncached(described)
        self.store: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.line = self._each(["\n"])[0]
        # A word of letters is one pre-token, so spelt in the vocabulary's characters it needs no pattern.
        self.spelt = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in (" ", "\n", *_LETTERS)}
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = Split(self.spelt[ord("\n")], "isolated")

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _lines(self, words: list[str], before: str, letters: bool = False) -> Iterator[bytes]:
        """The ids of words without line ends, each with ``before`` in front, encoded line by line in one text."""
        tokenizer, end = self.letters if letters else self.tokenizer, int.from_bytes(self.line, "little")
        for at in range(0, len(words), 20_000):
            text = before + f"\n{before}".join(words[at : at + 20_000]) + "\n"
            if letters and text.isascii():
                text = text.replace(" ", self.spelt[32]).replace("\n", self.spelt[10])
            elif letters:
                text = text.translate(self.spelt)
            found = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(found == end)).tolist()
            raw = found.tobytes()
            yield from [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]

    def _spell(self, words: list[str], before: str = " ") -> Iterator[tuple[str, bytes]]:
        """(word, ids) of words of letters."""
        simple = [w for w in words if w.isascii()]
        wide = [w for w in words if not w.isascii()] if len(simple) < len(words) else []
        if wide and max(map(max, wide)) > _LETTERS[-1]:
            strange = {w for w in wide if max(w) > _LETTERS[-1]}
            yield from zip(strange, self._lines(list(strange), before), strict=True)
            wide = [w for w in wide if w not in strange]
        for some in (simple, wide):
            yield from zip(some, self._lines(some, before, True), strict=True)

    def _learn(self, keys: set[str]) -> None:
        """Keys that hold white space or the mark of a special token are encoded each on its own."""
        store, search, line = self.store, _ODD.search, self.line
        odd = [k for k in keys if search(k)]
        if odd:
            store.update(zip(odd, self._each([k if k[0].isspace() else " " + k for k in odd]), strict=True))
            keys = keys.difference(odd)
        store.update(self._spell([k for k in keys if k.isalpha()]))
        closed, others, lines = [], [], {}
        for key in [k for k in keys if not k.isalpha()]:
            body = key.rstrip(_MARKS)  # letters and the marks that follow them are two pre-tokens
            if key[0] == "\n":
                lines[key] = key[1:]
            elif body.isalpha():
                closed.append((key, body, key[len(body) :]))
            else:
                others.append(key)
        store.update(zip(others, self._lines(others, " "), strict=True))
        known = {b: store.get(b) for _, b, _ in closed}
        known.update(self._spell([b for b, ids in known.items() if ids is None]))
        marks = {t for *_, t in closed}
        marks = dict(zip(marks, self._each(list(marks)), strict=True))
        store.update((k, known[b] + marks[t]) for k, b, t in closed)
        store.update((k, line + ids) for k, ids in zip(lines, self._lines(list(lines.values()), ""), strict=True))

    def _keys(self, text: str) -> list[str]:
        """The first key stands for a text that begins behind a line end."""
        if text[0].isspace() or text[-1].isspace() or _BESIDE_SPACE.search(text):
            parts = _CUT.split("\n" + text if not text[0].isspace() else text)
            return [p[1:] if p[:1] == " " and not p[1:2].isspace() and len(p) > 1 else p for p in parts]
        return ("\n" + text).replace("\n", " \n")[1:].split(" ")

    def _found(self, lists: list[list[str]]) -> Iterator[bytes]:
        """The joined ids of each list of keys: one look-up per key, new keys learned together."""
        if len(self.store) + sum(map(len, lists)) > self.known:
            self.old, self.store = self.store, {}
        store, old = self.store, self.old
        found = [list(map(store.get, keys)) for keys in lists]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        new = {keys[i] for keys, gap in zip(lists, gaps, strict=True) for i in gap}
        if new:
            again = new & old.keys()
            store.update((k, old[k]) for k in again)
            self._learn(new - again)
        for keys, ids, gap in zip(lists, found, gaps, strict=True):
            for i in gap:
                ids[i] = store[keys[i]]
            yield b"".join(ids)

    def _whole(self, text: str, ids: bytes) -> bytes:
        return ids if not text or text[0].isspace() else ids[len(self.line) :]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        for at in range(0, len(texts), 32):
            part = texts[at : at + 32]
            if sum(map(len, part)) > 1 << 20:  # long texts by parts that the store can hold
                for text in part:
                    keys = self._keys(text) if text else []
                    parts = (keys[a : a + self.known // 4] for a in range(0, len(keys), self.known // 4))
                    yield self._whole(text, b"".join(next(self._found([k])) for k in parts))
                continue
            lists = [self._keys(t) if t else [] for t in part]
            yield from map(self._whole, part, self._found(lists))


def _uncached(described: str) -> BPE:
    """The model of a tokenizer without a cache of words."""
    settings = {k: v for k, v in json.loads(described)["model"].items() if v is not None and k != "type"}
    vocab, merges = settings.pop("vocab"), [tuple(m) for m in settings.pop("merges")]
    return BPE(vocab, merges, cache_capacity=0, **settings)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(Tokenizer.from_file(path))


# --- files --------------------------------------------------------------------------------


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record; ``ids`` are unsigned 32-bit numbers."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    data = _HEAD.pack(width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    length = len(data).to_bytes(8, "little")
    return b"".join([length, _CHECK.pack(masked(length)), data, _CHECK.pack(masked(data))])


def _take(stream, n: int) -> bytes:
    found = stream.read(n)
    if len(found) != n:
        raise ValueError("a record file ends inside a record")
    return found


def read_frame(stream) -> tuple[int | None, np.ndarray] | None:
    """The record at the stream's place, checked; None at the end of the file."""
    head = stream.read(_LENGTH.size)
    if not head:
        return None
    if len(head) != _LENGTH.size:
        raise ValueError("a record file ends inside a record")
    length, check = _LENGTH.unpack(head)
    if check != masked(head[:8]):
        raise ValueError("the length of a record is damaged")
    data = _take(stream, length)
    if _CHECK.unpack(_take(stream, 4))[0] != masked(data):
        raise ValueError("the data of a record are damaged")
    width, known, doc_id = _HEAD.unpack_from(data)
    return (doc_id if known else None), np.frombuffer(data, f"<u{width}", offset=_HEAD.size).astype("<u4")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it; a plain path is a local one."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class _Files:
    """What a task has written: the open pair of files, and a manifest row per closed pair."""

    def __init__(self, path: str, limit: int):
        self.store, self.root = _store(path)
        self.limit, self.part, self.attempt = limit, TaskContext.get().partitionId(), uuid.uuid4().hex
        self.rows: list[tuple] = []
        self.data = self.index = None

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.data is None:
            name = f"part-{self.part:06d}-{len(self.rows):04d}-{self.attempt}"
            self.store.create_dir(self.root, recursive=True)
            self.names = f"{name}.records", f"{name}.index"
            self.data, self.index = (self.store.open_output_stream(f"{self.root}/{n}", compression=None, buffer_size=1 << 20) for n in self.names)
            self.records = self.tokens = self.size = 0
        record = frame(doc_id, ids)
        self.data.write(record)
        self.index.write(struct.pack(_ENTRY, self.size, len(record) - _LENGTH.size - _CHECK.size, len(ids)))
        self.records, self.tokens, self.size = self.records + 1, self.tokens + len(ids), self.size + len(record)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.data is not None:
            self.data.close()
            self.index.close()
            self.rows.append((self.part, len(self.rows), *self.names, self.records, self.tokens, self.size))
            self.data = self.index = None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def write_records(docs: DataFrame, path: str, tokenizer: str, end: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Encode (doc_id, text) and write the record files, their indexes and the manifest below ``path``.

    Each sequence is closed by the id ``end``.  A null text is empty: its record has the
    closing id only.  Rows without an id come first, repeated rows have a record each,
    other columns are left out.  An empty table gives a manifest without files.  ``path``
    must be a new folder that all executors can write to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, files = _encoder(tokenizer), _Files(f"{path}/data", file_bytes)
        closing = np.array([end], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                files.add(doc_id, np.frombuffer(ids + closing, "<u4"))
        files.close()
        yield _batch(files.rows, MANIFEST)

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files in their order, with ``first``: the ids of all files before each."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    return files.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _spread(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as (doc_id, start, n_tokens, ids): ``start`` counts the ids of all records
    before it, ``ids`` are little-endian unsigned 32-bit numbers.  A damaged record raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(f"{path}/data")
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as stream:
                    while (found := read_frame(stream)) is not None:
                        doc_id, ids = found
                        rows.append((doc_id, start, len(ids), ids.tobytes()))
                        start, size = start + len(ids), size + 4 * len(ids)
                        if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                            yield _batch(rows, RECORDS)
                            rows, size = [], 0
                yield _batch(rows, RECORDS)

    return _spread(manifest(spark, path).select("file", "first")).mapInArrow(run, RECORDS)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, start, n_tokens) of every record, from the index files alone."""
    schema = "file string, offset long, length long, start long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(f"{path}/data")
        for batch in batches:
            for file, name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    while part := stream.read(_ENTRY_SIZE * 4096):
                        rows = []
                        for offset, length, n in struct.iter_unpack(_ENTRY, part):
                            rows.append((file, offset, length, start, n))
                            start += n
                        yield _batch(rows, schema)

    return _spread(manifest(spark, path).select("file", "index", "first")).mapInArrow(run, schema)


def read_shuffled(spark: SparkSession, path: str, seed: int = 42) -> DataFrame:
    """(position, doc_id, start, n_tokens, ids): all records in an order that ``seed`` decides.

    Index entries are dealt by a hash and each task reads its records where the index says,
    sorted by file and offset for the reads, so no task scans a file; ``position`` is the
    hash, and sorting by it gives the order of an epoch."""
    schema = f"position long, {RECORDS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(f"{path}/data")
        for batch in batches:
            entries = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            rows, size = [], 0
            for name, group in groupby(entries, key=lambda e: e[0]):
                with store.open_input_file(f"{root}/{name}") as stream:
                    for _, offset, start, position in group:
                        stream.seek(offset)
                        doc_id, ids = read_frame(stream)
                        rows.append((position, doc_id, start, len(ids), ids.tobytes()))
                        size += 4 * len(ids)
                        if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                            yield _batch(rows, schema)
                            rows, size = [], 0
            yield _batch(rows, schema)

    position = F.xxhash64(F.lit(seed), "file", "offset")
    dealt = index(spark, path).select("file", "offset", "start", position.alias("position"))
    return dealt.repartitionByRange("position").mapInArrow(run, schema)
