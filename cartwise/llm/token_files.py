"""Token ids in flat binary files.

A folder holds, for each part, ``tokens-NNNNN.bin`` (unsigned 16- or 32-bit little-endian ids,
document after document), ``offsets-NNNNN.bin`` (64-bit positions in that file, one more than
there are documents) and ``ids-NNNNN.bin`` (64-bit doc_id; the smallest number stands for
null), and ``manifest.json`` with each part's base: the ids of all parts before it, by a prefix
sum over the parts. Parts are ranges of doc_id, so bases and offsets give the place of every
document in one long sequence of ids. Readers map the files into memory.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import tokens
from cartwise.llm.common import give_back, partitions, text_batches, text_of

NO_ID = np.iinfo(np.int64).min
_BATCH = 8 << 20  # bytes of ids handed over at once


def _file_system(folder: str):
    """File system and path of a folder that is given as a path or as a URI."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return fs.LocalFileSystem(), folder


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0) -> dict:
    """Encode ``docs`` (``doc_id``, ``text``) with the tokenizers file ``tokenizer``, add ``end_id``
    to each document and write the files in ascending ``doc_id``. Returns the manifest.

    A null text gives the end id alone; rows without id come first, rows that repeat an id are
    ordered by their text. An empty table gives a manifest without parts. A task that is run
    again writes its files anew under the same names.
    """
    path = tokenizer or tokens.default_path("byte_bpe_50k.json")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.Encoder(path)
        kind = "<u2" if own.vocabulary <= 1 << 16 else "<u4"
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        files, base = _file_system(folder)
        names = [f"{base}/{n}-{part:05d}.bin" for n in ("tokens", "offsets", "ids")]
        count = total = 0
        out = None
        for batch in tokens.text_slices(batches, 1):
            if out is None:
                files.create_dir(base, recursive=True)
                out = [files.open_output_stream(f"{n}.{attempt}") for n in names]
                out[1].write(np.zeros(1, "<i8").tobytes())
            ids, ends = own.encode_column(batch.column(1))
            out[0].write(np.insert(ids, ends, end_id).astype(kind).tobytes())
            ends = total + ends + np.arange(1, len(ends) + 1)  # with the end ids
            out[1].write(ends.astype("<i8").tobytes())
            out[2].write(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            total, count = int(ends[-1]), count + batch.num_rows
        del own
        give_back()
        if out is not None:
            for stream, name in zip(out, names, strict=True):
                stream.close()
                files.move(f"{name}.{attempt}", name)
            yield pa.record_batch([pa.array([part]), pa.array([count]), pa.array([total]), pa.array([kind])], ["part", "docs", "tokens", "kind"])

    spark = docs.sparkSession
    text_batches(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
        .repartitionByRange(partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    # one row for each part: at most as many as there are partitions
    rows = sorted(map(tuple, ordered.mapInArrow(write, "part long, docs long, tokens long, kind string").collect()))
    bases = accumulate((r[2] for r in rows), initial=0)
    parts = [{"part": p, "docs": d, "tokens": t, "kind": k, "base": b} for (p, d, t, k), b in zip(rows, bases)]
    files, base = _file_system(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"parts": parts}).encode())
    return {"parts": parts}


def read_manifest(folder: str) -> dict:
    files, base = _file_system(folder)
    with files.open_input_stream(f"{base}/manifest.json") as stream:
        return json.loads(stream.read())


def _mapped(files, path: str, kind: str) -> np.ndarray:
    """The file as an array: mapped into memory where the file system is a mounted one."""
    if files.type_name == "local":
        return np.memmap(path, kind, "r")
    with files.open_input_file(path) as stream:
        return np.frombuffer(stream.read(), kind)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of a folder: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for,
    ``ids`` (unsigned 32-bit little-endian bytes). One task reads one part."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['part']:05d}.bin"
                ids = _mapped(files, f"{base}/tokens-{name}", row["kind"])
                offsets = _mapped(files, f"{base}/offsets-{name}", "<i8")
                doc_ids = _mapped(files, f"{base}/ids-{name}", "<i8")
                at = 0
                while at < row["docs"]:
                    room = offsets[at] + _BATCH // 4
                    to = max(at + 1, int(np.searchsorted(offsets, room, "right")) - 1)
                    own = [ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() for i in range(at, to)]
                    starts = np.asarray(offsets[at:to])
                    who = np.asarray(doc_ids[at:to])
                    columns = [
                        pa.array(who, pa.int64(), mask=who == NO_ID),
                        pa.array(row["base"] + starts, pa.int64()),
                        pa.array(np.asarray(offsets[at + 1 : to + 1]) - starts, pa.int64()),
                        pa.array([zlib.crc32(b) for b in own], pa.int64()),
                    ]
                    yield pa.record_batch(columns + [pa.array(own, pa.binary())] * with_ids, [f.split()[0] for f in schema.split(", ")])
                    at = to

    parts = read_manifest(folder)["parts"]
    rows = [(p["part"], p["docs"], p["kind"], p["base"]) for p in parts]
    listed = spark.createDataFrame(rows, "part long, docs long, kind string, base long")
    return listed.repartition(max(1, len(rows))).mapInArrow(read, schema)
