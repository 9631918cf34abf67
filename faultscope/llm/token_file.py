"""Token ids in seekable zstandard files.

A shard is one file: independent zstandard frames, each with the ids of some whole
documents, then a skippable frame with the document index, then a skippable frame with
the seek table of the seekable zstandard format: compressed size, uncompressed size and
checksum (low half of XXH64) of every frame before it. A reader takes the footer, the
index and the frames that hold the documents it wants, and checks what it decompresses.

Shards hold ascending ranges of doc_id. A task writes its shards one after the other
under names of its own, so a task that is run again leaves a file nobody refers to: the
manifest that Spark collects from the tasks names the files that count.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.llm.bpe import BEYOND_LATIN
from faultscope.llm.common import slices, texts_of
from faultscope.staging import new_path, stage

#: Uncompressed bytes after which a frame ends (a document is never cut).
FRAME = 256 << 10
#: Documents of about this many text bytes form a shard.
SHARD_BYTES = 64 << 20
END_ID = 2
#: Distinct pieces that a worker keeps before the table starts anew beside the old one.
CACHE = 1_000_000
#: Text bytes encoded at once.
STEP = 2 << 20
#: New pieces that the library encodes in one text.
RUN = 64
LEVEL = 3

# Fixed values of the seekable format and of its skippable frames.
_SEEK_FRAME, _INDEX_FRAME, _SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_CHECKSUMS = 1 << 7
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u8")])
_NO_ID = -(1 << 63)


class SeekableWriter:
    """Writes documents' ids to a binary file object."""

    def __init__(self, out, frame: int = FRAME, level: int = LEVEL):
        import zstandard

        self.out, self.frame = out, frame
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True).compress
        self.parts: list[bytes] = []
        self.held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """One document; ``ids`` are little-endian 32-bit numbers."""
        if self.held and self.held + len(ids) > self.frame:
            self._end_frame()
        self.docs.append((_NO_ID if doc_id is None else doc_id, len(self.frames), self.held // 4, len(ids) // 4))
        self.parts.append(ids)
        self.held += len(ids)

    def _end_frame(self) -> None:
        import xxhash

        plain = b"".join(self.parts)
        packed = self.pack(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.parts, self.held = [], 0

    def close(self) -> None:
        import xxhash

        if self.parts:
            self._end_frame()
        index = self.pack(np.array(self.docs, _DOC).tobytes())
        body = struct.pack("<QI", len(self.docs), xxhash.xxh64_intdigest(index) & 0xFFFFFFFF) + index
        self.out.write(struct.pack("<II", _INDEX_FRAME, len(body)) + body)
        # The index counts as a frame without content, as the format wants for skippable frames.
        table = np.array([*self.frames, (len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)], _ENTRY).tobytes()
        footer = struct.pack("<IBI", len(self.frames) + 1, _CHECKSUMS, _SEEKABLE)
        self.out.write(struct.pack("<II", _SEEK_FRAME, len(table) + len(footer)) + table + footer)


class SeekableReader:
    """Reads documents of a file written by ``SeekableWriter``, a frame at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE or not flags & _CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        length = frames * _ENTRY.itemsize
        self.table = np.frombuffer(self._at(size - 9 - length, length), _ENTRY)
        self.starts = np.concatenate(([0], np.cumsum(self.table["packed"], dtype=np.int64)))
        body = self._at(int(self.starts[-2]) + 8, int(self.table["packed"][-1]) - 8)
        n, check = struct.unpack("<QI", body[:12])
        self.docs = np.frombuffer(self._unpack(body[12:], n * _DOC.itemsize, check, packed=True), _DOC)

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def _unpack(self, data: bytes, size: int, check: int, packed: bool = False) -> bytes:
        import xxhash
        import zstandard

        if packed and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError("the document index fails its checksum")
        plain = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        if not packed and (len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check):
            raise ValueError("a frame fails its checksum")
        return plain

    def frame(self, k: int) -> np.ndarray:
        entry = self.table[k]
        return np.frombuffer(self._unpack(self._at(int(self.starts[k]), int(entry["packed"])), int(entry["size"]), int(entry["check"])), "<u4")

    def read(self, doc_id: int) -> np.ndarray:
        """Ids of one document; only its frame is decompressed."""
        found = self.docs[self.docs["id"] == doc_id]
        if not len(found):
            raise KeyError(doc_id)
        doc = found[0]
        return self.frame(int(doc["frame"]))[int(doc["first"]):int(doc["first"]) + int(doc["n"])]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in the order of the file, one frame in memory at a time."""
        at, ids = -1, np.zeros(0, "<u4")
        for doc in self.docs:
            if doc["frame"] != at:
                at = int(doc["frame"])
                ids = self.frame(at)
            yield (None if doc["id"] == _NO_ID else int(doc["id"])), ids[int(doc["first"]):int(doc["first"]) + int(doc["n"])]


_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x24F)
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The byte-level pattern with its character classes spelt out for Latin text (fixed value).
_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[{_DIGITS}]+| ?[^\s{_LATIN}{_DIGITS}]+|\s+(?!\S)|\s+")
#: Elsewhere: before a blank between two characters that are no white space a new word always begins.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Where the library's white space and Python's differ.
_ODD = re.compile("[\x1c-\x1f\x85]")


class Encoder:
    """Ids of texts by the tokenizer library, which encodes each distinct piece once.

    Texts are cut where the byte-level pattern cuts them anyway, so the ids of a text are
    those of its pieces. Pieces not met again fade out of the table.
    """

    def __init__(self, spec: str, kind: str = "<u4"):
        from tokenizers import Tokenizer

        self.kind = np.dtype(kind)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A special token that texts are split at before all else parts pieces for good.
        self.part = next(((t["content"], t["id"]) for t in json.loads(spec)["added_tokens"] if t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"]), None)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces. Many short ones go through the library as one text."""
        alone = [p for p in pieces if self.part is None or len(p) > 100 or self.part[0][:2] in p]
        for piece, got in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self.known[piece] = np.array(got.ids, self.kind).tobytes()
        if self.part is None:
            return
        text, number = self.part
        apart = set(alone)
        short = [p for p in pieces if p not in apart]
        runs = [short[k:k + RUN] for k in range(0, len(short), RUN)]
        for run, got in zip(runs, self.tokenizer.encode_batch_fast([text.join(r) for r in runs], add_special_tokens=False)):
            ids, size = np.array(got.ids, self.kind), self.kind.itemsize
            cuts = [0, *((np.flatnonzero(ids == number) + 1) * size).tolist(), (len(ids) + 1) * size]
            data = ids.tobytes()
            if len(cuts) != len(run) + 1:
                raise ValueError("pieces and their ids don't match")
            for piece, a, b in zip(run, cuts, cuts[1:]):
                self.known[piece] = data[a:b - size]

    @staticmethod
    def pieces(text: str) -> list[str]:
        if "<|" in text or _ODD.search(text) or not text.isascii() and max(text) >= BEYOND_LATIN:
            return [text] if _ODD.search(text) else _CUT.split(text)
        return _WORDS.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text. Every piece is looked up once; those not found
        are learnt together and filled in."""
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
        known, old = self.known.get, self.old.get
        # Gaps are three lists side by side: a tuple for each would keep the garbage collector busy.
        found, new, where, places, pieces = [], {}, [], [], []
        for text in texts:
            cut = self.pieces(text)
            ids = list(map(known, cut))
            if None in ids:
                for k in [k for k, x in enumerate(ids) if x is None]:
                    piece = cut[k]
                    ids[k] = old(piece)
                    if ids[k] is None:
                        new[piece] = None
                        where.append(ids)
                        places.append(k)
                        pieces.append(piece)
                    else:
                        self.known[piece] = ids[k]
            found.append(ids)
        self._learn(list(new))
        for ids, k, piece in zip(where, places, pieces):
            ids[k] = self.known[piece]
        return list(map(b"".join, found))


@lru_cache(maxsize=2)
def _encoder(spec: str, kind: str) -> Encoder:
    """A worker keeps its encoder, and what it has learnt, from task to task."""
    return Encoder(spec, kind)


def encoded(docs: DataFrame, spec: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", narrow: bool = False, bounds: Sequence[int] = ()) -> DataFrame:
    """doc_id, shard and ``ids``, the ids of the text and the end id as little-endian numbers.

    They take 16 bits each with ``narrow``, for vocabularies of at most 65,536, else 32.
    ``shard`` counts the ``bounds`` below the doc_id; a null doc_id is in the last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    edges = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))
    kind = "<u2" if narrow else "<u4"
    stop = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = _encoder(shared.value, kind)
        for batch in batches:
            for part in slices(batch, "text", STEP):
                ids = [x + stop for x in encoder.encode(part.column("text").to_pylist())]
                doc, last = part.column("doc_id"), len(edges.value)
                shard = np.searchsorted(edges.value, doc.fill_null(0).to_numpy(zero_copy_only=False))
                shard = np.where(doc.is_null().to_numpy(zero_copy_only=False), last, shard).astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc, pa.array(shard), pa.array(ids, pa.binary())], names=["doc_id", "shard", "ids"])

    return texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, shard int, ids binary")


def _largest_id(spec: str, end_id: int) -> int:
    parsed = json.loads(spec)
    return max(end_id, *parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"]))


def _open(path: str, write: bool = False):
    """A binary stream on a file of any store that Arrow knows; makes its folder to write."""
    path = re.sub(r"^file:/+", "/", path)
    store, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    if not write:
        return store.open_input_file(inner)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)  # else by the name


def shard_bounds(docs: DataFrame, shards: int, id_col: str = "doc_id") -> list[int]:
    """Ids that end the shards but the last, from quantiles of the id column alone."""
    if shards <= 1:
        return []
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [k / shards for k in range(1, shards)], 100 * shards)).first()[0]
    return sorted(set(cuts or []))


def write_token_files(docs: DataFrame, spec: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the ids of all documents below ``folder``; the manifest: shard, path, docs, tokens.

    Documents lie in ascending doc_id, null ids last; rows that repeat an id lie next to
    each other by their ids. Null and empty texts give just the end id. No file is written
    for an empty table.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bounds = shard_bounds(docs, -(-size // shard_bytes), id_col)
    n = len(bounds) + 1
    narrow = _largest_id(spec, end_id) < 1 << 16
    ids = encoded(docs, spec, end_id, id_col, text_col, narrow, bounds)
    ranged = (ids.repartitionById(n, F.col("shard"))
              .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "ids"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, now, writer, out, docs_in, tokens = uuid.uuid4().hex[:12], None, None, None, 0, 0

        def done() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([path]), pa.array([docs_in]), pa.array([tokens])], names=["shard", "path", "docs", "tokens"])

        for batch in batches:
            for k, doc, data in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if k != now:
                    if writer:
                        yield done()
                    now, path, docs_in, tokens = k, f"{folder}/shard-{k:06d}-{run}.tok.zst", 0, 0
                    out = _open(path, write=True)
                    writer = SeekableWriter(out)
                raw = data.as_py()
                if narrow:
                    raw = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                writer.add(doc, raw)
                docs_in += 1
                tokens += len(raw) // 4
        if writer:
            yield done()

    return stage(ranged.mapInArrow(write, "shard int, path string, docs long, tokens long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    ``start`` counts the ids of all documents before it. One task reads one shard, a
    frame at a time; every frame's checksum is verified.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per shard: a file of some ten megabytes, so this window is over a short list.
    files = manifest.select("path", "shard", before.alias("base"))
    files = files.repartition(max(1, files.count()), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with _open(path) as source:
                    rows: list[tuple] = []
                    for doc, ids in SeekableReader(source):
                        rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 20_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids to files of the shared folder and read them back.

    ``path`` is the tokenizer file, read by the driver. See ``write_token_files``.
    """
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    folder = new_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, spec, folder, id_col, text_col))
