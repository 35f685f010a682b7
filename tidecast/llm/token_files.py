"""Token ids as flat binary files with 64-bit document offsets, read through memory maps.

Documents are dealt out by ranges of doc_id and sorted, so partition order is document order.
Each partition writes three files: ``.ids`` (unsigned integers, two bytes each where the
vocabulary allows it, else four), ``.off`` (64-bit starts of its documents and the end of the
last) and ``.doc`` (64-bit doc_id). A manifest row tells the file's name, documents and ids; a
prefix sum over the manifest gives every partition's base. File names hold the task attempt, and
only files named in the manifest count, so a lost executor or a second attempt does no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import column, cores, slices, texts_of, to_batch, written
from tidecast.llm.tokens import token_ids
from tidecast.session import fresh_path

#: doc_id as stored for a null.
NULL_ID = -(2**63)
#: Bytes of ids read at once where files can't be mapped.
READ = 8 << 20

_MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _store(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, end: int = 1, folder: str | None = None) -> DataFrame:
    """Write the ids of every document, ``end`` closing each, and return the manifest.

    Columns: part, file, n_docs, n_ids, width, first_doc and first_id (documents and ids before
    the partition). Order is by doc_id, nulls first, rows of one doc_id by text. A null text is
    empty. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    texts = texts_of(docs)
    parts = max(2 * cores(spark), texts.rdd.getNumPartitions())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name = f"{part:06d}-{attempt}"
        docs_done = ids_done = 0
        with store.open_output_stream(f"{root}/{name}.ids") as ids_out, store.open_output_stream(f"{root}/{name}.off") as off_out, store.open_output_stream(f"{root}/{name}.doc") as doc_out:
            for batch in slices(batches):
                ids, bounds = token_ids(batch, path, end)
                ids_out.write(ids.astype(f"<u{width}"))
                off_out.write((bounds[:-1] + ids_done).astype("<i8"))
                doc_out.write(column(batch, "doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                docs_done, ids_done = docs_done + batch.num_rows, ids_done + len(ids)
            off_out.write(np.array([ids_done], "<i8"))
        if docs_done:
            yield to_batch(_MANIFEST, part=[part], file=[f"{folder}/{name}"], n_docs=[docs_done], n_ids=[ids_done], width=[width])

    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(work, "part long, file string, n_docs long, n_ids long, width long"), "manifest")
    # One row per partition: the only ordered sum over all of them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns({f"first_{n}": F.coalesce(F.sum(f"n_{n}s").over(before), F.lit(0)) for n in ("doc", "id")})


def opened(name: str, width: int):
    """A function that gives ids from a place to a place, from a memory map where there can be one."""
    store, path = _store(name)
    if store.type_name == "local":
        mapped = np.memmap(f"{path}.ids", f"<u{width}", mode="r")
        return lambda a, b: mapped[a:b]
    whole = store.open_input_file(f"{path}.ids")
    return lambda a, b: np.frombuffer(whole.read_at((b - a) * width, a * width), f"<u{width}")


def _array(name: str, kind: str) -> np.ndarray:
    store, path = _store(f"{name}.{kind}")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), "<i8")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts, docs = _array(row["file"], "off"), _array(row["file"], "doc")
                ids = opened(row["file"], row["width"])
                at = 0
                while at < len(docs):
                    to = max(at + 1, int(np.searchsorted(starts, starts[at] + READ // row["width"], side="right")) - 1)
                    here = np.asarray(ids(int(starts[at]), int(starts[to]))).astype("<u4")
                    cuts = starts[at : to + 1] - starts[at]
                    yield to_batch(
                        _READ,
                        doc_id=pa.array(docs[at:to], mask=docs[at:to] == NULL_ID),
                        start=starts[at:to] + row["first_id"],
                        n_tokens=np.diff(cuts),
                        ids_crc32=[zlib.crc32(here[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)],
                    )
                    at = to

    spread = manifest.repartition(max(cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """Write ``docs`` and read the files back."""
    return read(docs.sparkSession, write(docs, path, end))
