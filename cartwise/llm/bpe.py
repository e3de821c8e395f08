"""Byte-level BPE in Spark: a global shuffle of distinct words.

Tasks cut texts into the matches of the pattern ("words"), gather whole documents into blocks
of bounded size and keep, for each document, the positions of its words in the word list of
its block. The distinct words of a block are dealt into buckets by their hash and shuffled by
bucket, so that one task meets all copies of a word and encodes it once; the ids go back to
the blocks and are put together by position. Word lists make hot words harmless: a block
sends a word once. Decoding looks ids up in the table of token bytes, whose size
is that of the vocabulary.

Blocks are formed twice, for the words and for the documents, so the input must give the same
rows in the same partitions each time, as a scan does; a block without its words raises.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import partitions, slices, text_of
from cartwise.llm.tokens import default_path

BLOCK_CHARS = 6_000_000
KNOWN_WORDS = 500_000  # words whose ids a task keeps; others are encoded again


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _word_encoder(path: str):
    """Encodes a whole string as one word."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        table[rank] = word
    return table


class _Positions(dict):
    """Position of each word in the word list of a block, in the order of first use."""

    def __missing__(self, word: str) -> int:
        position = self[word] = len(self)
        return position


class _Block:
    """Whole documents: the positions of their words, and the word list, dealt into buckets by hash."""

    def __init__(self, find, part: int, number: int):
        # Blocks of equal documents are told apart by their place.
        self.digest = hashlib.blake2b(f"{part}:{number}".encode(), digest_size=8)
        self.ids: list[int | None] = []
        self.positions: list[bytes] = []
        self.find, self.words = find, _Positions()
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        raw = text.encode()
        self.digest.update(f"{doc_id}:{len(raw)}:".encode())
        self.digest.update(raw)
        self.ids.append(doc_id)
        words = self.find(text)
        self.positions.append(np.fromiter(map(self.words.__getitem__, words), "<u4", len(words)).tobytes())
        self.size += len(text) + 1

    @property
    def name(self) -> int:
        return int.from_bytes(self.digest.digest(), "little", signed=True)

    def dealt(self, buckets: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, their buckets and the order by bucket."""
        words = list(self.words)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        return words, bucket, np.argsort(bucket, kind="stable")


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, room: int) -> Iterator[_Block]:
    import regex

    find = regex.compile(pattern).findall
    part = TaskContext.get().partitionId()
    number = 0
    block = _Block(find, part, number)
    for batch in slices(batches):
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block.ids and block.size + len(text) > room:
                yield block
                number += 1
                block = _Block(find, part, number)
            block.add(doc_id, text)
    if block.ids:
        yield block


def _shrink(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers: the low halves, then the high halves, compressed."""
    return _shrink(numbers.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes())


def _unpack_numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_expand(packed), "<u2").reshape(2, -1).T).view("<u4").reshape(-1)


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id`` and ``ids`` (unsigned 32-bit little-endian bytes) of every row of ``docs``
    (``doc_id``, ``text``; other columns are ignored), as tiktoken encodes without special tokens.

    A null text gives no ids; ids that repeat or are null are kept as they are; an empty table
    gives no rows. A document longer than a block is a block of its own.
    """
    path, pattern = ranks or default_path("byte_bpe_multi_50k.tiktoken"), pattern or default_pattern()
    n = partitions(docs.sparkSession)
    buckets = 4 * n
    lean = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))

    def word_rows(batches):
        for block in _blocks(batches, pattern, block_chars):
            words, bucket, order = block.dealt(buckets)
            rows = []
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(own):
                    raw = [words[i].encode() for i in own]
                    sizes = np.array([len(r) for r in raw])
                    rows.append((int(bucket[own[0]]), block.name, _pack_numbers(sizes), _shrink(b"".join(raw))))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                ["bucket", "block", "sizes", "words"],
            )

    def document_rows(batches):
        for block in _blocks(batches, pattern, block_chars):
            _, _, order = block.dealt(buckets)
            counts = np.array([len(p) // 4 for p in block.positions])
            row = [block.name, block.ids, _pack_numbers(counts), _pack_numbers(np.frombuffer(b"".join(block.positions), "<u4")), _pack_numbers(order)]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["doc_block", "doc_ids", "counts", "positions", "order"]
            )

    def encode_words(batches):
        encoder = _word_encoder(path)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            if len(known) > KNOWN_WORDS:
                known.clear()
            for sizes, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw, at, ids = _expand(packed), 0, []
                for size in _unpack_numbers(sizes).tolist():
                    word = raw[at : at + size]
                    at += size
                    own = known.get(word)
                    if own is None:
                        own = known[word] = np.array(encoder.encode_ordinary(word.decode()), "<u4").tobytes()
                    ids.append(own)
                out.append((_pack_numbers(np.array([len(i) // 4 for i in ids])), _pack_numbers(np.frombuffer(b"".join(ids), "<u4"))))
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "block", "sizes", "ids"]
            )

    def join_ids(documents: pa.Table, words: pa.Table) -> pa.Table:
        rows = sorted(zip(*(words[c].to_pylist() for c in ("bucket", "sizes", "ids")), strict=True))
        sizes = np.concatenate([np.zeros(0, np.int64), *(_unpack_numbers(r[1]) for r in rows)]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, "<u4"), *(_unpack_numbers(r[2]) for r in rows)]).astype("<u4")
        doc_ids, out = [], []
        for row in documents.to_pylist():
            order = _unpack_numbers(row["order"])
            if len(order) != len(sizes):
                raise RuntimeError("the words of a block are missing: the input gave other rows when it was read again")
            count, first = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            count[order] = sizes
            first[order] = np.cumsum(sizes) - sizes
            positions = _unpack_numbers(row["positions"])
            ends = np.cumsum(_unpack_numbers(row["counts"]), dtype=np.int64)
            for doc_id, start, end in zip(row["doc_ids"], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                own = positions[start:end]
                n = count[own]
                stops = np.cumsum(n)
                where = np.repeat(first[own] - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)
                doc_ids.append(doc_id)
                out.append(ids[where].tobytes())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(out, pa.binary())})

    by_word = lean.mapInArrow(word_rows, "bucket int, block long, sizes binary, words binary").repartition(n, "bucket")
    back = by_word.mapInArrow(encode_words, "bucket int, block long, sizes binary, ids binary")
    documents = lean.mapInArrow(document_rows, "doc_block long, doc_ids array<long>, counts binary, positions binary, order binary")
    return documents.groupBy("doc_block").cogroup(back.groupBy("block")).applyInArrow(join_ids, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``encoded`` (``ids``: unsigned 32-bit bytes) with ``decoded``, the bytes of the text."""
    path = ranks or default_path("byte_bpe_multi_50k.tiktoken")
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")

    def look_up(batches):
        table = _token_bytes(path)
        for batch in slices(batches):
            texts = [b"".join(map(table.__getitem__, np.frombuffer(i, "<u4").tolist())) if i else b"" for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(look_up, encoded.withColumn("decoded", F.col("ids")).schema)


def digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Encode and decode: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return decode(encode(docs, ranks), ranks).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
