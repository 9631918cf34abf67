"""Documents of any size from ordered fragments.

Fragments are sorted by ranges over the whole table, so the fragments of one large document
lie on several tasks. A task writes one file, the fragments of its documents one after the
other, and a manifest row for each document: where its part lies, whether it begins with a
list element and whether it ends with one. A document is its parts in order, with a comma
where an element follows an element of the part before.
"""

from __future__ import annotations

import contextlib
import functools
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultscope.schema import KEY
from faultscope.staging import stage

MANIFEST = T.StructType([T.StructField("family", T.StringType()), T.StructField("artifact", T.StringType()), T.StructField("part", T.LongType()),
                         T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                         T.StructField("opens", T.BooleanType()), T.StructField("ends", T.BooleanType())])
_DOCUMENT = T.StructType([T.StructField("family", T.StringType()), T.StructField("artifact", T.StringType()), T.StructField("document", T.StringType())])


#: Files that a reader of documents keeps open, and characters that it hands on together.
_FILES, _BATCH = 256, 1 << 22


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "/", path))
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_documents(fragments: DataFrame, folder: str) -> DataFrame:
    """Write ``(family, artifact, section, at, pos, element, ends, text)`` below ``folder``; gives the manifest.

    ``element`` marks a fragment that begins a list element, ``ends`` one that completes it.
    """
    order = [*KEY, "section", "at", "pos"]
    rows = fragments.repartitionByRange(*order).sortWithinPartitions(*order).select(*KEY, "element", "ends", "text")
    kinds = to_arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, done = TaskContext.get().partitionId(), None, []
        # A task that is run again writes a file of its own; the manifest names those that count.
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.txt"
        for batch in batches:
            for family, artifact, element, ends, text in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if out is None:
                    store, inner = _store(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(inner, compression=None)
                if not done or done[-1][:2] != [family, artifact]:
                    done.append([family, artifact, part, path, out.tell(), 0, element, False])
                elif element and done[-1][7]:
                    text = "," + text
                data = text.encode()
                out.write(data)
                done[-1][5] += len(data)
                done[-1][7] = ends
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kinds)], schema=kinds)

    return stage(rows.mapInArrow(write, MANIFEST), "report-manifest")


def _open_file(path: str) -> pa.NativeFile:
    store, inner = _store(path)
    return store.open_input_file(inner)


def document_pieces(parts: list[dict], piece: int = 1 << 20, opened: Callable[[str], AbstractContextManager[pa.NativeFile]] = _open_file) -> Iterator[bytes]:
    """The bytes of one document, piece by piece, from its manifest rows. ``opened`` gives the
    file of a path; who reads many documents hands in one that keeps files open."""
    ends = False
    for part in sorted(parts, key=lambda p: p["part"]):
        if ends and part["opens"]:
            yield b","
        ends = part["ends"]
        with opened(part["path"]) as source:
            source.seek(part["start"])
            left = part["length"]
            while left:
                data = source.read(min(left, piece))
                left -= len(data)
                yield data


def read_documents(manifest: DataFrame) -> DataFrame:
    """``(family, artifact, document)`` of documents that fit a row; ``document_pieces`` streams any."""
    parts = manifest.groupBy(*KEY).agg(F.collect_list(F.struct("part", "path", "start", "length", "opens", "ends")).alias("parts"))
    kinds = to_arrow_schema(_DOCUMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A file holds the documents of a range of artifacts, and a task reads of every file:
        # files stay open, the least used one is closed for the next. Documents leave together.
        keep = functools.lru_cache(_FILES)(_open_file)
        rows, size = [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        for batch in batches:
            for row in batch.to_pylist():
                text = b"".join(document_pieces(row["parts"], opened=lambda path: contextlib.nullcontext(keep(path)))).decode()
                if rows and (size + len(text) > _BATCH or len(rows) >= 10_000):
                    yield packed()
                    rows, size = [], 0
                rows.append((row["family"], row["artifact"], text))
                size += len(text)
        if rows:
            yield packed()

    return parts.mapInArrow(run, _DOCUMENT)
