"""Records of one large JSON file, read in splits.

The file is an array of records, or an object one of whose keys has that array. A byte
of the middle of such a file may be within a string or at any depth, so it is
read in three passes over chunks of fixed size:

1. every task summarises its chunks for each of the three states that a chunk may begin in
   (outside strings, within one, within one after a backslash): the state it ends in,
   how the depth changes and how low it gets, and where the wanted key's array may begin;
2. the driver runs through these summaries, some numbers a chunk, which gives each
   chunk's true state and depth, and the chunks that the array lies in;
3. every task cuts the records that begin in its chunks, reading on to the end of the last one.

So a task holds a chunk and the record that leaves it, whatever the file's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.ship import released, ship
from docloom.sources.storage import Store

CHUNK = 8 << 20
#: States that a chunk may begin in: outside strings, within one, within one after a backslash.
_STATES = (0, 1, 2)


def _scan(raw: bytes, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of brackets outside strings, +1 or -1 of each, depth after each from 0, state at the end)."""
    data = np.frombuffer((b"\\" if state == 2 else b"") + raw, np.uint8)
    slash = data == 92
    edges = np.flatnonzero(np.diff(np.concatenate(([0], slash.view(np.int8), [0]))))
    start, end = edges[::2], edges[1::2]
    odd = end[(end - start) % 2 == 1]  # what stands after an odd run of backslashes is escaped
    quote = data == 34
    quote[odd[odd < len(data)]] = False
    inside = (np.cumsum(quote, dtype=np.int32) + (state > 0)) % 2 == 1
    bracket = ((data == 123) | (data == 125) | (data == 91) | (data == 93)) & ~inside
    at = np.flatnonzero(bracket)
    step = np.where((data[at] == 123) | (data[at] == 91), 1, -1)
    last = int(inside[-1]) if len(data) else int(state > 0)
    if last and len(odd) and odd[-1] == len(data):
        last = 2
    return at - (state == 2), step, np.cumsum(step), last


def _openings(raw: bytes, name: str | None) -> list[int]:
    """Places of brackets that may open the wanted array."""
    if name is None:
        return [m.start() for m in re.finditer(rb"\[", raw[:65536])][:1]
    import json

    key = re.escape(json.dumps(name).encode())
    return [m.end() - 1 for m in re.finditer(key + rb"[ \t\r\n]*:[ \t\r\n]*\[", raw)]


_SUMMARY = pa.schema([("chunk", pa.int64()), ("state", pa.int32()), ("end", pa.int32()), ("change", pa.int64()), ("lowest", pa.int64()), ("place", pa.int64()), ("depth", pa.int64()), ("after", pa.int64())])
#: A key whose bracket is in a chunk may begin so many bytes before it.
_BACK = 4096


def _summaries(store: Store, path: str, chunk: int, name: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                back = min(k * chunk, _BACK)
                raw, rows = store.span(path, k * chunk - back, back + chunk), []
                found, own = [p - back for p in _openings(raw, name) if p >= back], raw[back:]
                for state in _STATES:
                    at, _, depth, end = _scan(own, state)
                    change, lowest = (int(depth[-1]), int(min(0, depth.min()))) if len(depth) else (0, 0)
                    rows.append((k, state, end, change, lowest, None, None, None))
                    for place in found:
                        i = int(np.searchsorted(at, place))
                        if i < len(at) and at[i] == place:
                            rows.append((k, state, end, change, lowest, k * chunk + place, int(depth[i]) - 1, int(depth[i:].min() - depth[i])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMMARY)], schema=_SUMMARY)

    return run


def _records(store: Store, path: str, chunk: int, known: dict[int, tuple[int, int]], begin: int, level: int):
    """Chunk numbers -> (place, text) of the records that begin in them; ``level``: depth within the array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                state, depth0 = known[k]
                raw = store.span(path, k * chunk, chunk)
                at, step, depth, end = _scan(raw, state)
                depth = depth + depth0
                after = at + k * chunk > begin
                over = np.flatnonzero(after & (depth < level))  # the array's own end
                stop = int(over[0]) if len(over) else len(at)
                opens = np.flatnonzero(after & (step == 1) & (depth == level + 1))
                closes = np.flatnonzero(after & (step == -1) & (depth == level))
                opens, closes = opens[opens < stop], closes[closes < stop]
                places, texts = [], []
                if len(opens):
                    last = None
                    if not len(closes) or closes[-1] < opens[-1]:  # the last record goes on beyond the chunk
                        last, more, inner, beyond = [raw[at[opens[-1]] :]], end, int(depth[-1]) - level, k * chunk + len(raw)
                        while inner > 0:
                            piece = store.span(path, beyond, chunk)
                            if not piece:
                                raise ValueError(f"{path} ends within a record")
                            a, _, d, more = _scan(piece, more)
                            done = np.flatnonzero(d + inner == 0)
                            cut = int(a[done[0]]) + 1 if len(done) else len(piece)
                            last.append(piece[:cut])
                            inner, beyond = (0, beyond) if len(done) else (inner + (int(d[-1]) if len(d) else 0), beyond + len(piece))
                    ends = closes[np.searchsorted(closes, opens[: len(opens) - (last is not None)])]
                    found = [(int(at[i]) + k * chunk, raw[at[i] : at[j] + 1]) for i, j in zip(opens, ends)] + ([(int(at[opens[-1]]) + k * chunk, b"".join(last))] if last is not None else [])
                    places, texts = zip(*found)
                    kept = [n for n, t in enumerate(texts) if t[:1] == b"{"]
                    places, texts = [places[n] for n in kept], [texts[n] for n in kept]
                for first in range(0, len(places), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(places[first : first + 1000], pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts[first : first + 1000]], pa.string())], ["place", "text"])

    return run


def read_records(spark: SparkSession, path: str, schema: str, *, name: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The objects of the array under ``name`` (null: the file is the array) as rows of ``schema``.

    Missing keys are null, as they are to Spark's own reader; elements that are no
    objects give no row; a file without such an array gives none. A missing file raises.
    """
    ship(spark)
    store = Store(path)
    at = store.opened()[1]
    size = store.size(at)
    if size is None:
        raise FileNotFoundError(path)
    empty = spark.createDataFrame([], f"struct<{schema}>" if not schema.startswith("struct") else schema)
    chunks = -(-size // chunk)
    if not chunks:
        return empty
    numbers = spark.range(0, chunks, 1, min(chunks, 100_000))
    told = numbers.mapInArrow(released(_summaries(store, at, chunk, name)), ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in _SUMMARY)).toArrow().to_pylist()
    by = {}
    for row in told:
        by.setdefault((row["chunk"], row["state"]), []).append(row)
    state = depth = 0
    known, begin, last, level = {}, None, chunks - 1, 2 if name is not None else 1
    for k in range(chunks):
        known[k] = (state, depth)
        rows = by[k, state]
        if begin is None:
            for row in sorted((r for r in rows if r["place"] is not None), key=lambda r: r["place"]):
                if depth + row["depth"] == level - 1:
                    begin, last = row["place"], k if row["after"] < 0 else last
                    break
        elif last == chunks - 1 and depth + rows[0]["lowest"] < level:
            last = k
        state, depth = rows[0]["end"], depth + rows[0]["change"]
    if begin is None:
        return empty
    wanted = {k: known[k] for k in range(begin // chunk, last + 1)}
    cut = spark.range(begin // chunk, last + 1, 1, min(len(wanted), 100_000)).mapInArrow(released(_records(store, at, chunk, wanted, begin, level)), "place long, text string")
    return cut.select(F.from_json("text", schema).alias("r")).where("r IS NOT NULL").select("r.*")
