"""Token ids in seekable zstandard shards.

Layout of a shard (``part-NNNNN.ztok``), documents in ascending id order over
all shards:

* one zstandard frame per document, with the frame format's own checksum,
  holding the ids as little-endian unsigned 16- or 32-bit integers;
* one skippable frame with the document index: width of an id in bytes, then
  the document ids (int64), then one byte per document, 1 where the id is null;
* one skippable frame with the seek table of the public seekable format: per
  frame compressed size, decompressed size and the low 32 bits of the content's
  xxh64, then the footer (number of frames, descriptor, magic number).

A reader fetches the two trailing frames and then only the byte ranges of the
documents asked for.

Encoding: a text of plain Latin characters is cut where the tokenizer's own
pre-tokenizer always cuts, and each distinct piece is encoded once by the
library and remembered (under a 64-bit hash); any other text goes to the
library whole.

Defined cases: a null or empty text is the end id alone; rows that repeat an id
all appear, ordered by a hash of their text; null ids come first; an empty
table writes no shard and gives an empty result; a text of any length is one
frame; other columns are not carried into shards.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import Workspace
from docloom.llm.words import mix, span_hash, split_words
from docloom.ship import released, ship
from docloom.sources.storage import Store

_SKIPPABLE_INDEX = 0x184D2A50
_SKIPPABLE_TABLE = 0x184D2A5E
_SEEKABLE_MAGIC = 0x8F92EAB1
_TABLE_DESCRIPTOR = 0x80  # checksums present

#: Characters that are blanks, letters, digits or symbols for the pre-tokenizer as for us.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u017f\\u2010-\\u2027\\u2030-\\u205e]*\\Z")
#: Pairs of blanks; with them, or a blank at either end, a text is not cut.
_ODD_BLANKS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_AT_BLANKS = np.array([0 if b == 32 else b for b in range(256)], np.uint8)
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_NOT_STOP = _ALNUM | (np.arange(256) >= 128) | (np.arange(256) <= 32)


class Encoder:
    """Texts to id bytes with one tokenizer file; remembers the ids of pieces it has met.

    A text is cut where the pre-tokenizer always cuts: before every blank
    between two words, and between a letter or digit and the ASCII symbols that
    end a word. Pieces are found, hashed and looked up in numpy; only a piece
    that the table lacks goes to the library. The table holds at most about
    ``max_pieces`` pieces and starts anew when it is full.
    """

    def __init__(self, path: str, end_id: int, max_pieces: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuttable = self._is_byte_level()
        self.max_pieces = max_pieces
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted piece hashes
        self.places = np.zeros(0, np.int64)  # of each key's ids in flat
        self.sizes = np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, self.dtype), 0

    def _is_byte_level(self) -> bool:
        told = json.loads(self.tokenizer.to_str())
        pre = told.get("pre_tokenizer") or {}
        return told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum())), sizes

    def _can_cut(self, text: str) -> bool:
        if not self.cuttable or text[:1] == " " or text[-1:] == " " or any(s in text for s in _ODD_BLANKS) or any(s in text for s in self.special):
            return False
        return _PLAIN.match(text) is not None

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        ids, sizes = self._ids(texts)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.places = np.insert(self.places, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.used += len(ids)

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text number, start, end, whether a blank precedes) of all pieces, in order."""
        words = split_words(data, bounds, _AT_BLANKS)
        start, end, owner = words.start, words.end, words.owners()
        blank = np.ones(len(start), bool)
        blank[words.first[:-1][words.counts > 0]] = False
        index = np.where(_NOT_STOP[data], np.arange(len(data)), -1)
        stem = np.maximum.accumulate(index)[end - 1] + 1  # end of the word without its last symbols
        final, before = data[np.maximum(stem, 1) - 1], data[np.maximum(stem, 2) - 2]
        letter = _ALNUM[final] | ((final >= 128) & (before >= 0xC3) & (before <= 0xC5) & ~((before == 0xC3) & ((final == 0x97) | (final == 0xB7))))
        split = (stem > start) & (stem < end) & letter
        stem = np.where(split, stem, end)
        order = np.arange(len(start)) + np.cumsum(split) - split
        n = len(start) + int(split.sum())
        out = [np.zeros(n, c.dtype) for c in (owner, start, end, blank)]
        for k, c in enumerate((owner, start, stem, blank)):
            out[k][order] = c
        tail = order[split] + 1
        out[0][tail], out[1][tail], out[2][tail] = owner[split], stem[split], end[split]
        return tuple(out)

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner, start, end, blank = self._cut(data, np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
        if not len(start):
            return [b""] * len(texts)
        keys = mix(span_hash(data, start, end) + blank.astype(np.uint64))
        distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
            lacks = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
            if not lacks.any():
                break
            if len(self.keys) and len(self.keys) + int(lacks.sum()) > self.max_pieces:
                self._clear()
                continue
            pieces = [(" " if b else "") + data[x:y].tobytes().decode() for b, x, y in zip(*(c[sample[lacks]].tolist() for c in (blank, start, end)))]
            self._add(distinct[lacks], pieces)
        at = np.searchsorted(self.keys, distinct)
        size, place = self.sizes[at][which], self.places[at][which]
        to = np.cumsum(size)
        ids = self.flat[np.arange(to[-1]) + np.repeat(place - (to - size), size)].tobytes()
        cut = np.concatenate(([0], to))[np.searchsorted(owner, np.arange(len(texts) + 1))] * self.width
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._can_cut(t) for t in texts]
        known = iter(self._encode_cut([t for t, c in zip(texts, cut) if c]) if any(cut) else ())
        ids, sizes = self._ids([t for t, c in zip(texts, cut) if not c])
        to = np.cumsum(sizes).tolist()
        other = (ids[b - n : b].tobytes() for b, n in zip(to, sizes.tolist()))
        return [(next(known) if c else next(other)) + self.end for c in cut]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


class ShardWriter:
    def __init__(self, sink, width: int, level: int = 3):
        import zstandard

        self.sink, self.width = sink, width
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries, self.ids = [], []

    def add(self, doc_id, ids: bytes) -> None:
        import xxhash

        frame = self.packer.compress(ids)
        self.sink.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        index = struct.pack("<B", self.width) + np.array([0 if i is None else i for i in self.ids], "<i8").tobytes() + bytes(i is None for i in self.ids)
        self.sink.write(struct.pack("<II", _SKIPPABLE_INDEX, len(index)) + index)
        self.entries.append((len(index) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), _TABLE_DESCRIPTOR, _SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", _SKIPPABLE_TABLE, len(table)) + table)
        self.sink.close()


class ShardReader:
    """Random access to one shard's documents."""

    def __init__(self, path: str):
        fs, at = Store(path).opened()
        self.source = fs.open_input_file(at)
        size = self.source.size()
        count, descriptor, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != _SEEKABLE_MAGIC or not descriptor & _TABLE_DESCRIPTOR:
            raise OSError(f"{path} has no seek table with checksums")
        table = self.source.read_at(12 * count, size - 9 - 12 * count)
        self.entries = np.frombuffer(table, "<u4").reshape(count, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries[:, 0].astype(np.int64))))
        n = count - 1
        index = self.source.read_at(int(self.entries[n, 0]), int(self.offsets[n]))[8:]
        self.width = index[0]
        ids = np.frombuffer(index, "<i8", n, 1)
        null = np.frombuffer(index, np.uint8, n, 1 + 8 * n)
        self.ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.n_tokens = self.entries[:n, 1].astype(np.int64) // self.width

    def __len__(self) -> int:
        return len(self.ids)

    def documents(self, rows: Iterable[int], span: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids as uint32) for ascending ``rows``; neighbouring frames are fetched together, up to ``span`` bytes."""
        import xxhash
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        held, lo, hi = b"", 0, 0
        wanted = list(rows)
        for k, row in enumerate(wanted):
            a, b = int(self.offsets[row]), int(self.offsets[row + 1])
            if b > hi or a < lo:
                lo = hi = a
                for j in range(k, len(wanted)):
                    if (j > k and wanted[j] != wanted[j - 1] + 1) or (j > k and self.offsets[wanted[j] + 1] - lo > span):
                        break
                    hi = int(self.offsets[wanted[j] + 1])
                held = self.source.read_at(hi - lo, lo)
            content = unpacker.decompress(held[a - lo : b - lo], max_output_size=int(self.entries[row, 1]) or 1)
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.entries[row, 2]):
                raise OSError(f"checksum differs in frame {row}")
            yield row, np.frombuffer(content, f"<u{self.width}").astype("<u4")


def write_tokens(docs: DataFrame, root: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3, batch_chars: int = 1 << 20) -> list[tuple[str, int, int]]:
    """Write ``docs`` below ``root``; returns (path, documents, tokens) per shard, in order.

    One range shuffle by id puts documents in order. A shard is written under a
    draft name and moved when complete, so a retried task replaces it whole.
    Only the shard list comes to the driver.
    """
    ship(docs.sparkSession)
    store = Store(root)
    fs, at = store.opened()
    fs.create_dir(at, recursive=True)
    out_schema = pa.schema([("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, fs, at = TaskContext.get(), *store.opened()
        name = f"part-{task.partitionId():05d}.ztok"
        draft = f"{at}/{name}.{task.taskAttemptId()}.tmp"
        code, shard, tokens = encoder(tokenizer, end_id), None, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            row = 0
            while row < len(ids):
                if shard is None:
                    shard = ShardWriter(fs.open_output_stream(draft, compression=None), code.width, level)
                part, held, first = [], 0, row
                while row < len(ids) and held < batch_chars:
                    part.append(texts[row].as_py() or "")
                    held, row = held + len(part[-1]), row + 1
                for doc_id, found in zip(ids[first:row], code.encode(part)):
                    shard.add(doc_id, found)
                    tokens += len(found) // code.width
        if shard is not None:
            shard.close()
            fs.move(draft, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "documents": [len(shard.ids)], "tokens": [tokens]}, out_schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("id"), F.col("tie")).sortWithinPartitions("id", "tie", "text").select("id", "text")
    done = ordered.mapInArrow(released(write), "path string, documents long, tokens long").collect()
    return sorted((r.path, r.documents, r.tokens) for r in done)


def read_tokens(spark: SparkSession, shards: list[tuple[str, int, int]], *, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``; with ``doc_ids`` only their frames are read."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not shards:
        return spark.createDataFrame([], schema)
    ship(spark)
    wanted = None if doc_ids is None else set(doc_ids)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    arrow = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(path)
                starts = start + np.concatenate(([0], np.cumsum(shard.n_tokens)))
                rows = range(len(shard)) if wanted is None else [k for k, i in enumerate(shard.ids) if i in wanted]
                out, held = [], 0
                for row, ids in shard.documents(rows):
                    found = {"doc_id": shard.ids[row], "start": int(starts[row]), "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
                    out.append(found | {"ids": ids.tolist()} if with_ids else found)
                    held += len(ids) if with_ids else 1
                    if held >= 1 << 18 or len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, arrow)

    listed, start = [], 0
    for path, _, tokens in shards:
        listed.append((path, start))
        start += tokens
    table = pa.table({"path": [x[0] for x in listed], "start": pa.array([x[1] for x in listed], pa.int64())})
    return spark.createDataFrame(table).repartition(len(listed)).mapInArrow(released(read), schema)


def production_tokenizer() -> str:
    """Path of the default vocabulary file; installed beside the libraries, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = Workspace(spark, "tokens").path("shards")
    shards = write_tokens(docs, root, tokenizer=production_tokenizer(), end_id=2)
    return read_tokens(spark, shards, with_ids=False)
