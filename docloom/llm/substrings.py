"""Suffix-array dedup of repeated byte strings.

Every byte covered by a string of ``length`` bytes that also starts earlier in
the corpus (smaller document, or same document and earlier start) is removed.

Equal windows of ``length`` bytes hold the same bytes, so also the same least
hash of their ``gram``-byte substrings. Consecutive windows that share the
place of that least gram (the leftmost, if several) are a unit; the gram is its
anchor. Windows can only be equal at equal distance from equal anchors, so the
corpus-wide question splits into one small string per anchor:

1. One pass cuts all texts into units and keeps, per task, the first place of
   each distinct (anchor, unit); other places repeat it and are covered whole.
   Units travel as compressed sorted runs, merged by ranges of the anchor whose number follows from the number of units.
2. Anchors of one distinct unit have nothing left to decide. For the others the
   distinct units are joined to a string, the anchor gram folded to one symbol,
   and its suffix array is built (see ``suffixes``). Windows that share their
   prefix are neighbours there; all but the earliest of them are covered.
3. An anchor with ``HOT_UNITS`` or more different units, in one task or in all, such as the edge of a
   passage that very many documents share, is hot. Its units are cut: windows whose distance from the anchor lies in
   one band of 8 share a core of bytes, and only windows with equal bands and cores can be equal, so band and core
   are the anchor of smaller units, which go through steps 1 and 2 again as smaller suffix-array groups. Where such a group is hot once
   more, bands have width 1: a unit is a window, and equal windows are settled as repeats by step 1.
   A task that finds an anchor hot tells the others through the runs, so units that
   another task did not find hot follow; no list of hot anchors is collected.
4. Covered stretches are merged per document and cut out.

Hash equality (64-bit anchor and 64-bit unit, from two different hashes of the bytes where a unit is cut) stands for
byte equality. Texts are joined to their places by broadcast below ``MAX_BROADCAST_BYTES``, else by a shuffle.

Defined cases: null is an empty text; texts under ``length`` bytes are never
cut; documents are ordered by id (null first), those that share an id by a hash
of their text; rows that repeat id and text count as one document and are cut
alike; an empty table gives an empty result; other columns are kept and the
added ones (``n_bytes, n_removed, n_spans, kept``) replace columns so named.
Removed stretches may split a multi-byte character, so ``kept`` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.jaccard import _pack, _pack_sorted, _unpack, _unpack_sorted
from docloom.llm.shared import Columns, Workspace, dealt
from docloom.llm.suffixes import equal_windows
from docloom.llm.words import _BYTE, _power_tables, mix, runs, text_slices
from docloom.ship import released, ship

_PLACE = np.uint64((1 << 20) - 1)
_SEGMENT = 1 << 19
_FLUSH_UNITS = 350_000
#: So many different units of one anchor are not sorted as one group but cut.
HOT_UNITS = 64
#: Widths of the bands of distances that units are cut by; 0: whole units.
BANDS = (0, 8, 1)
_RANGE_UNITS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
_SA_SYMBOLS = 500_000
_END, _SEPARATOR, _FOLD = 0, 1, 2


def cut_units(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, anchor offset in the unit, anchor, unit hash) of all units."""
    n = len(data)
    if n > 2 * _SEGMENT:  # one long text: windows are dealt to overlapping segments
        parts, at = [], 0
        while at < n - length + 1 or at == 0:
            stop = min(n, at + _SEGMENT + length - 1)
            owner, first, *rest = cut_units(data[at:stop], np.array([0, stop - at]), length, gram)
            parts.append((owner, first + at, *rest))
            at += _SEGMENT
        return tuple(np.concatenate(c) for c in zip(*parts))
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    width = length - gram + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    value = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.concatenate((value, np.full((-len(value)) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, 1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    least = (np.minimum(backward[:windows], forward[width - 1 : width - 1 + windows]) & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(owner[:windows] == owner[length - 1 :])
    if not len(inside):
        return none
    anchor, owner = least[inside], owner[inside]
    lead = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    first = inside[lead]
    count = np.diff(np.append(lead, len(inside)))
    anchor = anchor[lead]
    offset = anchor - first
    body = (total[first + count + length - 1] - total[first]) * down[first]
    unit = mix(body + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + offset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return owner[lead], first, count, offset, mix(grams[anchor]), unit


def cut_bands(data: np.ndarray, begin: np.ndarray, count: np.ndarray, offset: np.ndarray, length: int, band: int) -> tuple[np.ndarray, ...]:
    """(unit number, first window after the unit's, number of windows, anchor offset, key of band and core, hash of the bytes) of the parts of units that begin at ``begin``."""
    n = len(data)
    low, high = (offset - count + 1) // band, offset // band
    parts = high - low + 1
    unit = np.repeat(np.arange(len(begin)), parts)
    c = np.arange(len(unit)) - np.repeat(np.cumsum(parts) - parts, parts) + low[unit]
    first = np.maximum(0, offset[unit] - band * (c + 1) + 1)
    last = np.minimum(count[unit] - 1, offset[unit] - band * c)
    up, down = _power_tables(n + 1)

    def hashes(table: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=total[1:])
        return (total[z] - total[a]) * down[a]

    anchor = begin[unit] + offset[unit]
    core = hashes(_BYTE, anchor - band * c, anchor - band * (c + 1) + 1 + length)
    key = mix(core + (c + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    body = hashes(_BYTE[::-1], begin[unit] + first, begin[unit] + last + length)
    rest = offset[unit] - first
    number = last - first + 1
    return unit, first, number, rest, key, mix(body + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rest.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _first_places(anchor, unit, doc, first, count, offset):
    """Sorted by (anchor, unit, doc, first): the arrays, and masks of group heads and of exact repeats of a place."""
    order = np.argsort(anchor, kind="stable")
    same = anchor[order][1:] == anchor[order][:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    some = order[shared]
    order[shared] = some[np.lexsort((first[some], doc[some], unit[some], anchor[some]))]
    cols = [c[order] for c in (anchor, unit, doc, first, count, offset)]
    a, u, d, f = cols[:4]
    head = np.concatenate(([True], (a[1:] != a[:-1]) | (u[1:] != u[:-1])))
    again = np.concatenate(([False], ~head[1:] & (d[1:] == d[:-1]) & (f[1:] == f[:-1])))
    return cols, head, again


_RUN = ("anchors", "units", "docs", "firsts", "counts", "offsets", "marks")
_FIRST = pa.schema([(k, pa.int64()) for k in ("doc", "a", "z", "first", "count", "offset", "n")] + [(k, pa.binary()) for k in _RUN])
_FIRST_DDL = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in _FIRST)


def _rows(schema: pa.Schema, **known) -> pa.RecordBatch:
    n = len(next(iter(known.values())))
    return pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(n, f.type) for f in schema], schema=schema)


def _merged(doc, a, z):
    """Merge overlapping or touching [a, z) of the same document (rows sorted by doc, a)."""
    if not len(doc):
        return doc, a, z
    order = np.lexsort((a, doc))
    doc, a, z = doc[order], a[order], z[order]
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    block = np.cumsum(new_doc) - 1
    shift = block * (int(z.max()) + 2)  # keeps documents apart in one running maximum
    reach = np.maximum.accumulate(z + shift)
    head = np.concatenate(([True], (a + shift)[1:] > reach[:-1]))
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], a[at], reach[last] - shift[last]


def _unit_pass(docs: DataFrame, length: int, gram: int, band: int) -> DataFrame:
    """Rows of three kinds: covered (doc, a, z), units of hot anchors (doc, first, count, offset), and runs of first places.

    ``docs`` has ``doc, text``, and with ``band`` also the ``spans`` (first, count, offset) of the units to cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush():
            anchor, unit, doc, first, count, offset = (np.concatenate(c) for c in zip(*held))
            cols, head, again = _first_places(anchor, unit, doc, first, count, offset)
            repeat = ~head & ~again
            doc_, a, z = _merged(cols[2][repeat], cols[3][repeat], cols[3][repeat] + cols[4][repeat] + length - 1)
            if len(doc_):
                yield _rows(_FIRST, doc=doc_, a=a, z=z)
            anchor, unit, doc, first, count, offset = (c[head] for c in cols)
            at = runs(anchor)
            many = np.diff(np.append(at, len(anchor))) >= HOT_UNITS
            hot = np.repeat(many, np.diff(np.append(at, len(anchor))))
            if hot.any():
                yield _rows(_FIRST, doc=doc[hot], first=first[hot], count=count[hot], offset=offset[hot])
            rest = ~hot
            yield _rows(
                _FIRST, n=[int(rest.sum())], anchors=[_pack_sorted(anchor[rest])], units=[_pack(unit[rest])], docs=[_pack(doc[rest])], firsts=[_pack(first[rest].astype(np.int64))],
                counts=[_pack(count[rest].astype(np.uint16))], offsets=[_pack(offset[rest].astype(np.uint16))], marks=[_pack_sorted(anchor[at[many]])],
            )

        def units(batch):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for top, stop, data, bounds in text_slices(batch.column(1), _SEGMENT):
                bounds = bounds - bounds[0]
                if not band:
                    owner, first, count, offset, anchor, unit = cut_units(data, bounds, length, gram)
                    yield anchor, unit, ids[top + owner], first - bounds[owner], count, offset
                    continue
                lists = batch.column(2).slice(top, stop - top)
                owner = np.repeat(np.arange(stop - top), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
                first, count, offset = (lists.flatten().field(k).to_numpy() for k in ("first", "count", "offset"))
                order = np.lexsort((first, owner))
                owner, first, count, offset = owner[order], first[order], count[order], offset[order]
                begin = first + bounds[owner]
                at = 0
                while at < len(begin):  # a long text is taken in parts
                    to = max(int(np.searchsorted(begin, begin[at] + 2 * _SEGMENT)), at + 1)
                    low, high = int(begin[at]), int((begin[at:to] + count[at:to]).max()) + length - 1
                    k, inner, number, rest, key, unit = cut_bands(data[low:high], begin[at:to] - low, count[at:to], offset[at:to], length, band)
                    yield key, unit, ids[top + owner[at:to][k]], first[at:to][k] + inner, number, rest
                    at = to

        for batch in batches:
            for part in units(batch):
                held.append(part)
                n_held += len(part[0])
                if n_held > _FLUSH_UNITS:
                    yield from flush()
                    held, n_held = [], 0
        if n_held:
            yield from flush()

    return docs.mapInArrow(released(run), _FIRST_DDL)


def _split_runs(runs_: DataFrame, ranges: int) -> DataFrame:
    """Each run cut by range of the anchor."""
    types = (np.uint64, np.int64, np.int64, np.uint16, np.uint16)
    schema = pa.schema([("range", pa.int32())] + [(k, pa.binary()) for k in _RUN])
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchor, marks = _unpack_sorted(row["anchors"], np.uint64), _unpack_sorted(row["marks"], np.uint64)
                cols = [_unpack(row[k], t) for k, t in zip(_RUN[1:6], types)]
                cut = np.concatenate(([0], np.searchsorted(anchor, edges), [len(anchor)]))
                at = np.concatenate(([0], np.searchsorted(marks, edges), [len(marks)]))
                pieces = zip(range(ranges), cut[:-1], cut[1:], at[:-1], at[1:])
                out = [(r, _pack_sorted(anchor[a:b]), *[_pack(c[a:b]) for c in cols], _pack_sorted(marks[x:y])) for r, a, b, x, y in pieces if b > a or y > x]
                if out:
                    yield _rows(schema, **dict(zip(schema.names, zip(*out))))

    return runs_.select(*_RUN).mapInArrow(released(split), "range int, " + ", ".join(f"{k} binary" for k in _RUN))


def _merge_runs(parts: DataFrame, ranges: int, length: int) -> DataFrame:
    """Covered stretches (doc, a, z), and the first places of units (anchor, doc, first, count, offset, hot) whose anchor has several or is hot."""
    schema = pa.schema([(k, pa.int64()) for k in ("doc", "a", "z", "anchor", "first", "count", "offset")] + [("hot", pa.bool_())])
    types = (np.uint64, np.int64, np.int64, np.uint16, np.uint16)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done():
            cols = [np.concatenate([_unpack_sorted(h[0], np.uint64) for h in held])]
            cols += [np.concatenate([_unpack(h[k], t) for h in held]) for k, t in enumerate(types, 1)]
            marks = np.unique(np.concatenate([_unpack_sorted(h[6], np.uint64) for h in held]))
            order = np.argsort(cols[0], kind="stable")
            sorted_ = cols[0][order]
            same = sorted_[1:] == sorted_[:-1]
            marked = marks[np.minimum(np.searchsorted(marks, sorted_), len(marks) - 1)] == sorted_ if len(marks) else np.zeros(len(sorted_), bool)
            some = order[np.concatenate((same, [False])) | np.concatenate(([False], same)) | marked] if len(order) else order
            if not len(some):
                return
            (anchor, unit, doc, first, count, offset), head, again = _first_places(*(c[some] for c in cols))
            count, offset = count.astype(np.int64), offset.astype(np.int64)
            repeat = ~head & ~again
            doc_, a, z = _merged(doc[repeat], first[repeat], first[repeat] + count[repeat] + length - 1)
            if len(doc_):
                yield _rows(schema, doc=doc_, a=a, z=z)
            anchor, doc, first, count, offset = (c[head] for c in (anchor, doc, first, count, offset))
            at = runs(anchor)
            size = np.repeat(np.diff(np.append(at, len(anchor))), np.diff(np.append(at, len(anchor))))
            hot = size >= HOT_UNITS
            if len(marks):
                hot |= marks[np.minimum(np.searchsorted(marks, anchor), len(marks) - 1)] == anchor
            keep = hot | (size > 1)
            if keep.any():
                yield _rows(schema, anchor=anchor[keep].view(np.int64), doc=doc[keep], first=first[keep], count=count[keep], offset=offset[keep], hot=hot[keep])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != current and held:
                    yield from done()
                    held = []
                current = row[0]
                held.append(row[1:])
        if held:
            yield from done()

    return dealt(parts, ranges, "range").mapInArrow(released(merge), "doc long, a long, z long, anchor long, first long, count long, offset long, hot boolean")


def _with_texts(docs: DataFrame, spans: DataFrame, key: str = "doc") -> DataFrame:
    """``docs`` with the spans of those that have some; a table of spans (written, arrays in ``spans``) of few bytes is broadcast, a larger one shuffled."""
    element = spans.schema["spans"].dataType.elementType
    rows, entries = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    size = rows * 40 + (entries or 0) * (16 + 8 * len(element.fields))  # as unsafe rows
    return docs.join(F.broadcast(spans) if size <= MAX_BROADCAST_BYTES else spans.hint("merge"), key)


def _decide(units: DataFrame, ranges: int, length: int, gram: int) -> DataFrame:
    """Suffix arrays over each anchor's units (anchor, doc, first, count, offset, body), under ``HOT_UNITS`` of them: covered stretches (doc, a, z)."""
    window = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, symbols, last = [], 0, None

        def done():
            number: dict = {}
            anchor = np.array([number.setdefault(h[0], len(number)) for h in held], np.int64)
            doc, first, count, offset = (np.array(c, np.int64) for c in list(zip(*held))[1:5])
            bodies = [h[5] for h in held]
            raw = np.frombuffer(b"".join(bodies), np.uint8)
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            opens = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            closes = np.concatenate((opens[1:], [True]))
            # a unit becomes: bytes before the gram, one symbol for the gram, bytes after it, a separator; a string ends with its own end
            room = sizes - gram + 2 + closes
            at = np.concatenate(([0], np.cumsum(room)))
            text = np.full(at[-1], _SEPARATOR, np.int16)
            source = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            inside = np.arange(len(raw)) - source[owner]
            before, after = inside < offset[owner], inside >= offset[owner] + gram
            text[(at[:-1][owner] + inside)[before]] = raw[before].astype(np.int16) + 3
            text[(at[:-1][owner] + inside - gram + 1)[after]] = raw[after].astype(np.int16) + 3
            text[at[:-1] + offset] = _FOLD
            text[at[1:][closes] - 1] = _END
            valid = np.zeros(len(text), bool)
            index = np.repeat(at[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            valid[index] = True
            base = np.concatenate((at[:-1][opens], at[-1:]))
            place, group = equal_windows(text, base, valid, window)
            if not len(place):
                return
            unit = np.searchsorted(at, place, side="right") - 1
            begin = first[unit] + place - at[unit]
            order = np.lexsort((begin, doc[unit], group))
            doc_, begin, group = doc[unit][order], begin[order], group[order]
            later = np.concatenate(([False], group[1:] == group[:-1]))
            doc_, a, z = _merged(doc_[later], begin[later], begin[later] + length)
            if len(doc_):
                yield pa.RecordBatch.from_arrays([pa.array(doc_), pa.array(a), pa.array(z)], ["doc", "a", "z"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if symbols > _SA_SYMBOLS and row[0] != last:
                    yield from done()
                    held, symbols = [], 0
                held.append(row)
                symbols += len(row[5]) - gram + 3
                last = row[0]
        if held:
            yield from done()

    return units.repartition(ranges, "anchor").sortWithinPartitions("anchor").mapInArrow(released(run), "doc long, a long, z long")


def _numbered(docs: DataFrame, work: Workspace, id_: Column, text: Column) -> tuple[DataFrame, bool]:
    """``docs`` with ``doc``, a long that orders documents and names one (id, text), and whether it is the id itself, as ids are unique."""
    ids = docs.select(id_.cast("long").alias("i"))
    unique = ids.where("i IS NULL").isEmpty() and ids.groupBy("i").count().where("count > 1").isEmpty()
    if unique:
        return docs.withColumn("doc", id_.cast("long")), True
    spark = docs.sparkSession
    keyed = docs.withColumn("i", id_.cast("long")).withColumn("t", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    ordered = keyed.select("i", "t").distinct().orderBy(F.col("i").asc_nulls_first(), "t")
    numbered = ordered.rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1]))
    table = work.table(spark.createDataFrame(numbered, "i2 long, t2 long, doc long"), "numbers")
    return keyed.join(table, F.col("i").eqNullSafe(F.col("i2")) & (F.col("t") == F.col("t2"))), False


def covered_spans(docs: DataFrame, work: Workspace, *, length: int = 100, gram: int = 40) -> DataFrame:
    """``doc, text``, one row per ``doc`` -> ``doc, spans array<struct<a, z>>``: the merged covered stretches, only documents that have some."""
    spark = docs.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                cols = [[s[k] for s in spans] for k in ("anchor", "first", "count", "offset")]
                found = [raw[s["first"] : s["first"] + s["count"] + length - 1] for s in spans]
                arrays = [pa.array(cols[0], pa.int64()), pa.array([doc] * len(spans), pa.int64()), *[pa.array(c, pa.int64()) for c in cols[1:]], pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "doc", "first", "count", "offset", "body"])

    covered, level = [], docs.select("doc", "text")
    for band in BANDS:
        first = work.table(_unit_pass(level, length, gram, band), f"first{band}")
        n_units = first.agg(F.sum("n")).first()[0] or 0
        ranges = max(least, -(-n_units // _RANGE_UNITS))
        merged = work.table(_merge_runs(_split_runs(first.where("anchors IS NOT NULL"), ranges), ranges, length), f"merged{band}")
        covered += [first.where("z IS NOT NULL").select("doc", "a", "z"), merged.where("z IS NOT NULL").select("doc", "a", "z")]
        spans = merged.where("NOT hot").groupBy("doc").agg(F.collect_list(F.struct("anchor", "first", "count", "offset")).alias("spans"))
        opened = _with_texts(docs, work.table(spans, f"spans{band}"))
        units = opened.select("doc", "text", "spans").mapInArrow(released(bodies), "anchor long, doc long, first long, count long, offset long, body binary")
        covered.append(work.table(_decide(units, ranges, length, gram), f"decided{band}"))
        hot = first.where("first IS NOT NULL").select("doc", "first", "count", "offset").union(merged.where("hot").select("doc", "first", "count", "offset"))
        if band == BANDS[-1] or hot.isEmpty():
            break
        spans = work.table(hot.groupBy("doc").agg(F.collect_list(F.struct("first", "count", "offset")).alias("spans")), f"hot{band}")
        level = _with_texts(docs, spans).select("doc", "text", "spans")
    every = covered[0]
    for part in covered[1:]:
        every = every.union(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, out = [], []
            for doc, spans in zip(*(c.to_pylist() for c in batch.columns)):
                _, a, z = _merged(np.zeros(len(spans), np.int64), np.array([s["a"] for s in spans], np.int64), np.array([s["z"] for s in spans], np.int64))
                docs_.append(doc)
                out.append([{"a": int(x), "z": int(y)} for x, y in zip(a, z)])
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))], ["doc", "spans"])

    gathered = every.groupBy("doc").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    out = work.table(gathered.mapInArrow(released(merge), "doc long, spans array<struct<a: long, z: long>>"), "covered")
    work.drop(*[f"{name}{band}" for name in ("first", "merged", "spans", "decided", "hot") for band in BANDS])
    return out


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 40) -> DataFrame:
    """Adds ``n_bytes, n_removed, n_spans`` and ``kept`` (binary, what is left of the text)."""
    ship(docs.sparkSession)
    columns, work = Columns(docs), Workspace(docs.sparkSession, "substrings")
    text = F.col(columns.at(text_col))
    numbered, unique = _numbered(columns.plain, work, F.col(columns.at(id_col)), text)
    texts = numbered.select("doc", F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    if not unique:  # repeated rows are one document
        texts = work.table(texts.dropDuplicates(["doc"]), "texts")
    spans = covered_spans(texts, work, length=length, gram=gram)
    work.drop("texts")
    rows, entries = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    few = rows * 40 + (entries or 0) * 32 <= MAX_BROADCAST_BYTES
    spans = spans.withColumnRenamed("doc", "of")
    joined = numbered.join(F.broadcast(spans) if few else spans.hint("merge"), F.col("doc") == F.col("of"), "left")
    joined = joined.withColumn("raw", F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    gone = F.expr("CASE WHEN spans IS NULL THEN 0L ELSE aggregate(spans, 0L, (s, x) -> s + x.z - x.a) END")
    # what lies between the removed stretches
    kept = F.expr("""CASE WHEN spans IS NULL THEN raw
        ELSE aggregate(transform(sequence(0, size(spans)), k -> substring(raw,
            cast(CASE WHEN k = 0 THEN 1 ELSE spans[greatest(k - 1, 0)].z + 1 END AS int),
            cast(CASE WHEN k = size(spans) THEN n_bytes ELSE spans[least(k, size(spans) - 1)].a END
               - CASE WHEN k = 0 THEN 0 ELSE spans[greatest(k - 1, 0)].z END AS int))), X'', (s, x) -> concat(s, x)) END""")
    number = F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long")
    return columns.back(joined.withColumns({"n_removed": gone, "n_spans": number, "kept": kept}), "n_bytes", "n_removed", "n_spans", "kept")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
