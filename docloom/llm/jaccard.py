"""Exact n-gram Jaccard join through a token-group matrix.

A text's set holds the hashes of its distinct ``width``-word shingles. Texts
with equal word sequences form one class and take part once. Then:

1. Counting. One pass over the texts counts, for every shingle, the texts that
   hold it (as compressed sorted runs, merged by ranges of the hash). The most
   frequent shingles, at most ``max_hot`` of them, are broadcast; they only
   decide the order of shingles, so neither that bound nor counts that end at 65,535 lose a link.
2. Grouping. Eight one-permutation min-hashes propose, for each class, the
   most central class with the same min-hash. A class joins the group of the one it agrees with
   most, in at least half of the eight. Similar texts so share a group, linked or not.
3. Which groups can meet. Shingles are ordered: rare ones by hash, frequent ones last, by
   frequency. Of a set of n only the first n - ceil(t n) + 1 can be the first
   one it shares with a set it links to (t: the threshold). Per group the union of these leading shingles is
   kept, and only those that two groups hold. Groups that share some are
   paired, and the number they share bounds the overlap of any two members: the set whose shingles end first in
   the order has all its leading shingles decided, so at most n - alpha of them
   may be missing from the other, alpha being the overlap that the threshold
   asks for. Its leading shingles that lead in no other group are missing anyway;
   of the other set this says nothing, as they may lie behind this one's leading part.
4. Matrix. Groups with several members or a partner are stored in blocks of bounded size. A block is a
   token-member matrix of whole sets: the union of its members' shingles, each once, and for each shingle the members that hold it.
5. Opening. First every block is opened by itself, together with the text its group is named after, so a family
   of near copies collapses with one link per member. Then blocks meet in pairs: those of one
   group at growing distances, those of paired groups at once, and a pair is left out when one component holds all members of both.
   A member of one block is compared with another block only if it shares enough shingles with that block's
   union; what qualifies is counted by a matrix product. A row of work is two blocks, never a pair of texts, and the
   links it finds leave as a spanning forest, at most one per member.

The components are exact but for 63-bit hash collisions. Pairs within a component are not all looked at, so the operator gives no number of links.
Min-hashes, blocks and rounds that many classes share are dealt by ``join_groups`` or by block, and no group is gathered in one task.

Cost: leading shingles that g groups hold make g * g / 2 comparisons of bounds, in parts of 256 groups a side.
A family whose members neither link nor differ in their leading shingles, as copies a little below the threshold from each other
do, is opened block by block: the number of block pairs grows with the square of its size, by 256 * 256 text pairs each.

Defined cases: a null or empty text has an empty set and links with nothing; a
text of fewer words than ``width`` has its whole sequence as its only shingle;
repeated rows and equal texts link; a null id never names a component while
another id is there; an empty table gives an empty result; other columns are
not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.graph import components
from docloom.llm.shared import Columns, Workspace, dealt, join_groups
from docloom.llm.words import _STEP, BLANK_SEPARATED, Words, _power_tables, mix, runs, split_words, text_slices
from docloom.ship import released, ship

BINS = 8
_HOT = np.uint64(1 << 63)
_LOW43 = np.uint64((1 << 43) - 1)
MAX_HOT = 1 << 19
MAX_BROADCAST_IDS = 1_000_000
_FLUSH = 3_000_000
_RANGE_TOKENS = 2_000_000
#: A block holds about so many members, and about so many shingles.
BLOCK_MEMBERS = 256
BLOCK_TOKENS = 1 << 16
#: Groups that hold one leading shingle are compared in parts of so many.
PART = 256


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, size of each text's set): distinct 63-bit shingle hashes, ascending within a text."""
    texts = len(words.bounds) - 1
    h, at = words.windows(width)
    owner = words.owners()
    parts = [(owner[at], h)]
    counts = words.counts
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            hn, an = words.windows(n)
            parts.append((short, mix(hn[np.searchsorted(an, words.first[short])] + np.uint64(n))))
    owner, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) >> np.uint64(1)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[keep], h[keep]
    return owner, h, np.bincount(owner, minlength=texts)


def sequence_hash(words: Words) -> np.ndarray:
    """One 64-bit hash of each text's whole word sequence."""
    n = len(words.hash)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words.hash + _STEP) * up[:n], out=total[1:])
    a, b = words.first[:-1], words.first[1:]
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_sorted(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(_unpack(blob, dtype), dtype=dtype)


def prefix_size(n, num: int, den: int):
    """How many leading shingles of a set of ``n`` decide whether it can link."""
    return n - -(-num * n // den) + 1


_FIRST = "id long, class long, size long, keys array<long>, range int, runs binary, counts binary"


def _first_pass(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """Per text: id, class, set size and min-hashes. Per range of shingles: sorted runs with document counts."""
    schema = pa.schema([("id", pa.int64()), ("class", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("range", pa.int32()), ("runs", pa.binary()), ("counts", pa.binary())])
    edges = (np.arange(1, ranges) * (2**32 / ranges)).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))
            rows = [(r, _pack_sorted(values[a:b]), _pack(np.minimum(counts[a:b], 65535).astype(np.uint16))) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            k = len(rows)
            return pa.RecordBatch.from_arrays([pa.nulls(k, t) for t in schema.types[:4]] + [pa.array(c, t) for c, t in zip(zip(*rows), schema.types[4:])], schema=schema)

        for batch in batches:
            for first, stop, data, bounds in text_slices(batch.column(1)):
                words = split_words(data, bounds, BLANK_SEPARATED)
                owner, h, size = shingle_sets(words, width)
                n = stop - first
                lowest = np.zeros((n, BINS), np.uint64)
                bins = (h >> np.uint64(60)).astype(np.int64)
                lead = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (bins[1:] != bins[:-1])))) if len(h) else np.zeros(0, np.int64)
                lowest[owner[lead], bins[lead]] = h[lead]
                keys = pa.ListArray.from_arrays(np.arange(0, n * BINS + 1, BINS, dtype=np.int32), pa.array(lowest.reshape(-1).view(np.int64)))
                columns = [batch.column(0).slice(first, n), pa.array(sequence_hash(words).view(np.int64)), pa.array(size.astype(np.int64)), keys]
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(n, t) for t in schema.types[4:]], schema=schema)
                long = words.counts[owner] >= width
                held.append((h[long] >> np.uint64(31)).astype(np.uint32))
                n_held += len(h)
                if n_held > _FLUSH:
                    yield flush()
                    held, n_held = [], 0
        if n_held and sum(map(len, held)):
            yield flush()

    return docs.mapInArrow(released(run), _FIRST)


def _frequent(runs: DataFrame, ranges: int, least: int, max_hot: int) -> np.ndarray:
    """Buckets (32 leading bits) of frequent shingles, ascending by frequency; at most ``max_hot``.

    A task holds one sum per bucket of its range, so at most 2**32 / ``ranges``, however many runs it reads.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def summed():
            values, counts = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(values, kind="stable")
            values, counts = values[order], counts[order]
            start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            return values[start], np.add.reduceat(counts, start)

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns[1:])):
                held.append((_unpack_sorted(a, np.uint32), _unpack(b, np.uint16).astype(np.int64)))
                n_held += len(held[-1][0])
                if n_held > 2 * len(held[0][0]) + _FLUSH:
                    held = [summed()]
                    n_held = len(held[0][0])
        if n_held:
            values, total = summed()
            hot = total >= least
            yield pa.RecordBatch.from_arrays([pa.array(values[hot].astype(np.int64)), pa.array(total[hot])], ["bucket", "n"])

    counted = dealt(runs, ranges, "range").mapInArrow(released(merge), "bucket long, n long")
    found = counted.orderBy(F.desc("n"), "bucket").limit(max_hot).toPandas()
    return found["bucket"].to_numpy(np.int64)[::-1].astype(np.uint32)


def _order_keys(h: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of each 63-bit shingle in the global order, as a distinct 64-bit number."""
    if not len(hot):
        return h
    bucket = (h >> np.uint64(31)).astype(np.uint32)
    place = np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)
    known = hot[place] == bucket
    return np.where(known, _HOT | (rank[place].astype(np.uint64) << np.uint64(43)) | (h & _LOW43), h)


def _leading_pass(docs: DataFrame, width: int, num: int, den: int, ranges: int, frequent: np.ndarray) -> DataFrame:
    """``class, size, last, rare`` per text and its leading shingles: rare ones as sorted runs by range, frequent ones as rows."""
    order = np.argsort(frequent, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int64)))
    schema = pa.schema([("class", pa.int64()), ("size", pa.int64()), ("last", pa.int64()), ("rare", pa.int64()), ("token", pa.int64()), ("range", pa.int32()), ("runs", pa.binary()), ("classes", pa.binary())])

    def rows(**known):
        n = len(next(iter(known.values())))
        return pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        tokens, classes, n_held = [], [], 0

        def flush():
            token, of = np.concatenate(tokens), np.concatenate(classes)
            place = (mix(token) % np.uint64(ranges)).astype(np.int64)
            by = np.lexsort((token, place))
            token, of, place = token[by], of[by], place[by]
            cut = np.searchsorted(place, np.arange(ranges + 1))
            found = [(r, _pack_sorted(token[a:b]), _pack(of[a:b])) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            r, a, b = zip(*found)
            return rows(range=r, runs=a, classes=b)

        for batch in batches:
            for first, stop, data, bounds in text_slices(batch.column(0)):
                words = split_words(data, bounds, BLANK_SEPARATED)
                owner, h, size = shingle_sets(words, width)
                of = sequence_hash(words)
                long = words.counts[owner] >= width
                owner, h = owner[long], h[long]
                size = np.where(words.counts >= width, size, 0)
                key = _order_keys(h, hot, rank)
                by = np.lexsort((key, owner))
                owner, key = owner[by], key[by]
                begin = np.concatenate(([0], np.cumsum(size)))[:-1]
                leading = prefix_size(size, num, den)
                lead = np.arange(len(key)) - begin[owner] < leading[owner]
                some = np.flatnonzero(size)
                last = key[begin[some] + leading[some] - 1]
                rare = np.bincount(owner[key < _HOT], minlength=len(size))[some]
                yield rows(**{"class": of[some].view(np.int64), "size": size[some], "last": (last ^ _HOT).view(np.int64), "rare": rare})
                owner, key = owner[lead], key[lead]
                frequent_one = key >= _HOT
                if frequent_one.any():
                    yield rows(**{"class": of[owner[frequent_one]].view(np.int64), "token": key[frequent_one].view(np.int64)})
                tokens.append(key[~frequent_one])
                classes.append(of[owner[~frequent_one]])
                n_held += int((~frequent_one).sum())
                if n_held > _FLUSH // 4:
                    yield flush()
                    tokens, classes, n_held = [], [], 0
        if n_held:
            yield flush()

    return docs.mapInArrow(released(run), "class long, size long, last long, rare long, token long, range int, runs binary, classes binary")


def _shared_tokens(runs: DataFrame, ranges: int) -> DataFrame:
    """``token, class`` for every rare leading shingle that two classes hold."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done():
            token = np.concatenate([_unpack_sorted(r, np.uint64) for r, _ in held])
            of = np.concatenate([_unpack(c, np.uint64) for _, c in held])
            by = np.lexsort((of, token))
            token, of = token[by], of[by]
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (of[1:] != of[:-1])))
            token, of = token[new], of[new]
            same = token[1:] == token[:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            return pa.RecordBatch.from_arrays([pa.array(token[shared].view(np.int64)), pa.array(of[shared].view(np.int64))], ["token", "class"])

        for batch in batches:
            for r, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if r != current and held:
                    yield done()
                    held = []
                current = r
                held.append((a, b))
        if held:
            yield done()

    return dealt(runs, ranges, "range").mapInArrow(released(merge), "token long, class long")


def _of_class(width: int):
    """Texts as (class, shingles): ascending 63-bit hashes, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(0)):
                words = split_words(data, bounds, BLANK_SEPARATED)
                _, h, size = shingle_sets(words, width)
                raw = h.tobytes()
                ends = np.concatenate(([0], np.cumsum(size))) * 8
                sets = [raw[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(sequence_hash(words).view(np.int64)), pa.array(sets, pa.binary())], ["class", "shingles"])

    return run


_MATRIX = pa.schema([("comp", pa.int64()), ("block", pa.int32()), ("of", pa.binary()), ("size", pa.binary()), ("union", pa.binary()), ("held", pa.binary()), ("member", pa.binary())])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, block, members with their sets) -> the block's token-member matrix.

    ``of`` and ``size`` are the members' classes and numbers of shingles, ``union`` has every shingle of the block once and in
    order, ``held`` the number of members that hold it, and ``member`` names them, shingle by shingle.
    """
    for batch in batches:
        for comp, block, members in zip(*batch.columns):
            items = members.values
            sets = [np.frombuffer(x, np.uint64) for x in items.field("shingles").to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            token, member = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), size)
            order = np.argsort(token, kind="stable")
            start = runs(token[order])
            columns = (items.field("class").to_numpy(), size, token[order][start], np.diff(np.append(start, len(token))).astype(np.uint32), member[order])
            yield pa.RecordBatch.from_arrays([pa.array([comp.as_py()], pa.int64()), pa.array([block.as_py()], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], schema=_MATRIX)


class _Block:
    """A block's matrix: members' classes and sizes, the token union, and (token, member) pairs in order of tokens."""

    def __init__(self, row: dict):
        self.of, self.size = np.frombuffer(row["of"], np.int64), np.frombuffer(row["size"], np.int64)
        self.union = np.frombuffer(row["union"], np.uint64)
        self.token = np.repeat(self.union, np.frombuffer(row["held"], np.uint32))
        self.member = np.frombuffer(row["member"], np.uint32).astype(np.int64)

    def only(self, members: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token number, member) pairs of chosen members and of the tokens of a sorted list."""
        place = np.minimum(np.searchsorted(tokens, self.token), max(len(tokens) - 1, 0))
        keep = members[self.member] & (tokens[place] == self.token) if len(tokens) else np.zeros(len(self.token), bool)
        return place[keep], self.member[keep]


def _enough(p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
    """The overlap that sets of p and q shingles need to link."""
    return -(-num * (p + q) // (num + den))


def _product(x: tuple, y: tuple, nx: int, ny: int, n_tokens: int) -> np.ndarray:
    """Overlaps of all members of two blocks, from their (token number, member) pairs; by counting or by a matrix product, whichever is less."""
    (tx, mx), (ty, my) = x, y
    cx, cy = np.bincount(tx, minlength=n_tokens), np.bincount(ty, minlength=n_tokens)
    common = np.flatnonzero((cx > 0) & (cy > 0))
    met = int((cx[common] * cy[common]).sum())
    if met <= max(nx * ny * len(common) // 16, 1 << 12) and met <= 1 << 22:
        low, count = np.searchsorted(ty, tx, "left"), cy[tx]
        at = np.arange(met) + np.repeat(low - (np.cumsum(count) - count), count)
        return np.bincount(np.repeat(mx, count) * ny + my[at], minlength=nx * ny).reshape(nx, ny)
    out = np.zeros((nx, ny), np.float32)
    number = np.full(n_tokens, -1)
    number[common] = np.arange(len(common))
    for from_ in range(0, len(common), 4096):
        a, b = np.zeros((nx, 4096), np.float32), np.zeros((ny, 4096), np.float32)
        for side, t, m in ((a, tx, mx), (b, ty, my)):
            column = number[t] - from_
            inside = (number[t] >= 0) & (column >= 0) & (column < 4096)
            side[m[inside], column[inside]] = 1
        out += a @ b.T
    return np.rint(out).astype(np.int64)


def _across(x: _Block, y: _Block, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(member of x, member of y) that link. A block whose union shares too little with a member is not opened for it."""
    chosen = []
    for one, other in ((x, y), (y, x)):
        place = np.minimum(np.searchsorted(other.union, one.token), max(len(other.union) - 1, 0))
        held = np.bincount(one.member[other.union[place] == one.token], minlength=len(one.of)) if len(other.union) else np.zeros(len(one.of), np.int64)
        chosen.append(held >= _enough(one.size, np.maximum(int(other.size.min()), -(-num * one.size // den)), num, den))
    keep_x, keep_y = chosen
    if not keep_x.any() or not keep_y.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.intersect1d(x.union, y.union, assume_unique=True)
    shared = _product(x.only(keep_x, both), y.only(keep_y, both), len(x.of), len(y.of), len(both))
    return np.nonzero((shared > 0) & (shared >= _enough(x.size[:, None], y.size[None, :], num, den)))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest one its links reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _links(of: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    label = _forest(len(of), i, j)
    k = np.flatnonzero((label != np.arange(len(of))) & (of != of[label]))
    return pa.RecordBatch.from_arrays([pa.array(of[k]), pa.array(of[label[k]])], ["a", "b"])


def _open_alone(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0).to_pylist():
                x = _Block(row)
                if len(x.of) > 1:
                    yield _links(x.of, *_across(x, x, num, den))

    return run


def _open_pair(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = _Block(left), _Block(right)
                i, j = _across(x, y, num, den)
                if len(i):
                    yield _links(np.concatenate((x.of, y.of)), i, j + len(x.of))

    return run


def _grouped(work: Workspace, classes: DataFrame, last: DataFrame) -> DataFrame:
    """``class, size, last, comp``: the class that names the group it joins, itself if it joins none."""
    keyed = classes.select("class", F.posexplode("keys").alias("bin", "key")).where("key <> 0")
    met = work.table(keyed.groupBy("bin", "key").agg(F.count("*").alias("n")).where("n > 1"), "met")
    shared = work.table(join_groups(keyed, met, ["bin", "key"], F.col("class")).where("n IS NOT NULL"), "shared")
    # the leader of the classes with one min-hash is the middle of a family: the smallest share of shingles that few texts hold
    common = shared.groupBy("class").agg(F.sum("n").alias("n")).join(last, "class")
    central = common.select("class", F.struct(F.round(-F.col("rare") / F.col("size"), 3), "n", "class").alias("score"))
    leaders = shared.join(central, "class").groupBy("bin", "key").agg(F.max("score").alias("leader"), F.count("*").alias("n"))
    leaders = work.table(leaders, "leaders")
    led = join_groups(shared.drop("n"), leaders, ["bin", "key"], F.col("class")).where("leader.class <> class")
    proposed = led.groupBy("class", "leader").agg(F.count("*").alias("agree")).where(F.col("agree") >= BINS // 2)
    best = proposed.groupBy("class").agg(F.max(F.struct("agree", "leader"))["leader"]["class"].alias("comp"))
    member = work.table(last.drop("rare").join(best, "class", "left").withColumn("comp", F.coalesce("comp", "class")), "member")
    work.drop("met", "shared", "leaders")
    return member


def _paired(work: Workspace, held: DataFrame, member: DataFrame, num: int, den: int) -> DataFrame:
    """``compx, compy``: pairs of groups whose leading shingles (``token, class``) leave room for a link."""
    tokens = work.table(held.join(member, "class"), "tokens")
    several = work.table(tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("token", "n"), "several")
    inside = join_groups(tokens, several, ["token"], F.col("class")).where("n IS NOT NULL").drop("n")
    # leading shingles that lead in no other group are missing from every set whose leading shingles end later:
    # ``reach`` bounds the overlap with those sets, and with no others
    inside = work.table(inside, "inside")
    alive = inside.groupBy("class").agg(F.count("*").alias("alive"))
    reach = F.expr(f"size - (size - ceil({num} * size / {den}) + 1 - alive)")
    matrix = inside.join(alive, "class").withColumn("reach", reach).groupBy("token", "comp")
    matrix = work.table(matrix.agg(F.min("size").alias("n0"), F.max("size").alias("n1"), F.min("last").alias("l0"), F.max("last").alias("l1"), F.max("reach").alias("r")), "matrix")
    crowded = work.table(matrix.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > PART), "crowded")
    parted = join_groups(matrix, crowded, ["token"], F.col("comp")).withColumn("parts", F.coalesce(F.ceil(F.col("n") / PART), F.lit(1)).cast("int")).drop("n")

    def side(df: DataFrame, k: str) -> DataFrame:
        return df.select("token", "part", *[F.col(c).alias(c + k) for c in ("comp", "n0", "n1", "l0", "l1", "r")])

    alpha = f"ceil({num} * (n0x + n0y) / {num + den})"
    reached = "CASE WHEN l1x <= l0y THEN rx WHEN l1y <= l0x THEN ry ELSE greatest(rx, ry) END"
    left = side(parted.withColumn("part", F.pmod(F.xxhash64("comp"), F.col("parts")).cast("int")), "x")
    right = side(parted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "y")
    met = left.join(right, ["token", "part"])
    met = met.where(f"compx < compy AND {den} * n1x >= {num} * n0y AND {den} * n1y >= {num} * n0x AND {reached} >= {alpha}")
    met = met.groupBy("compx", "compy").agg(F.count("*").alias("s"), *[f(c + k).alias(c + k) for k in "xy" for c, f in (("n0", F.min), ("n1", F.max), ("l0", F.min), ("l1", F.max))])
    spare = lambda k: f"(1 - ceil({num} * n1{k} / {den}))"  # noqa: E731  leading shingles less all, of the largest member
    need = f"{alpha} + CASE WHEN l1x <= l0y THEN {spare('x')} WHEN l1y <= l0x THEN {spare('y')} ELSE least({spare('x')}, {spare('y')}) END"
    found = work.table(met.where(f"s >= {need}").select("compx", "compy"), "paired")
    work.drop("tokens", "several", "inside", "matrix", "crowded")
    return found


def _blocks(work: Workspace, docs: DataFrame, classes: DataFrame, member: DataFrame, paired: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``comp, block, matrix`` of the groups to open; ``class, comp, block`` of their members; ``comp, parts``, in how many blocks a group is.

    The class that a group is named after is in each of the group's blocks.
    """
    crowd = member.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.max(F.col("class") == F.col("comp")).alias("own"))
    partners = paired.select(F.col("compx").alias("comp")).union(paired.select(F.col("compy").alias("comp"))).distinct().withColumn("partner", F.lit(True))
    opened = crowd.join(partners, "comp", "left").where("partner OR n > 1 OR NOT own")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    opened = work.table(opened.select("comp", "n", parts.alias("parts")), "opened")
    others = join_groups(member.where("class <> comp").select("class", "comp"), opened, ["comp"], F.col("class")).where("parts IS NOT NULL")
    others = others.select("class", "comp", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("block"))
    named = opened.select(F.col("comp").alias("class"), "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    placed = work.table(others.union(named), "placed")
    wanted = work.table(placed.select("class").distinct().join(classes.select("class", "_row"), "class").select("_row").distinct(), "wanted")
    few = wanted.count() <= MAX_BROADCAST_IDS  # one long each
    # a semi-join: each row once, however many texts share its id; those of other classes meet no place
    texts = docs.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("_row")), "left_semi").select("text")
    sets = texts.mapInArrow(released(_of_class(width)), "class long, shingles binary").dropDuplicates(["class"])
    gathered = placed.join(sets, "class").groupBy("comp", "block").agg(F.collect_list(F.struct("class", "shingles")).alias("members"))
    ddl = "comp long, block int, of binary, size binary, union binary, held binary, member binary"
    parts_of = ["of", "size", "union", "held", "member"]
    blocks = work.table(gathered.mapInArrow(released(_matrices), ddl).select("comp", "block", F.struct(*parts_of).alias("matrix")), "blocks")
    work.drop("wanted")
    return blocks, placed, opened.select("comp", "parts")


def _attached(work: Workspace, pairs: DataFrame, blocks: DataFrame, k: str, other: list[str]) -> DataFrame:
    """``pairs`` with the matrix of their block ``k``; a block that many pairs name is dealt in copies, one for each 64 of them."""
    name = [f"comp{k}", f"block{k}"]
    counts = work.table(pairs.groupBy(*name).agg(F.count("*").alias("n")), f"counts{k}", pairs.count())
    copies = F.ceil(F.col("n") / 64).cast("int")
    spread_ = join_groups(pairs, counts, name, F.struct(*other)).withColumn("deal", F.pmod(F.xxhash64(*other), copies).cast("int")).drop("n")
    counted = counts.select(F.col(name[0]).alias("comp"), F.col(name[1]).alias("block"), "n")
    ready = blocks.join(counted, ["comp", "block"]).select(F.col("comp").alias(name[0]), F.col("block").alias(name[1]), F.col("matrix").alias(f"matrix{k}"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("deal"))
    return spread_.join(ready, [*name, "deal"]).drop("deal")


def _opened(work: Workspace, blocks: DataFrame, placed: DataFrame, parts: DataFrame, paired: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``a, b``: verified links that join all that link; ``node, comp``: the components they make."""
    links = work.table(blocks.where(F.octet_length("matrix.of") > 8).select("matrix").mapInArrow(released(_open_alone(num, den)), "a long, b long"), "links0")
    largest, n_blocks = parts.agg(F.max("parts"), F.sum("parts")).first()
    largest, n_blocks = largest or 0, n_blocks or 0
    reach, step, some = 0, 0, False
    if largest <= 1 and paired.isEmpty():
        return links, components(work, links, "joined")
    while True:
        found = components(work, links, f"round{step}")
        # a block within one component, and which
        labelled = placed.join(found.withColumnRenamed("node", "class").withColumnRenamed("comp", "label"), "class", "left")
        label = F.coalesce("label", "class")
        whole = work.table(labelled.groupBy("comp", "block").agg(F.min(label).alias("lo"), F.max(label).alias("hi")), "whole", n_blocks)
        # blocks of a group stand in a ring; a round takes the pairs at the distances that follow those of the round before
        far = min(max(2, 4 * reach), largest // 2)
        ring = parts.where(F.col("parts") > 2 * reach + 1).withColumn("blockx", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        ring = ring.where(F.expr(f"floor(parts / 2) > {reach}")).withColumn("away", F.explode(F.expr(f"sequence({reach + 1}, least({max(far, reach + 1)}, floor(parts / 2)))").cast("array<int>")))
        pairs = ring.select(F.col("comp").alias("compx"), "blockx", F.col("comp").alias("compy"), F.pmod(F.col("blockx") + F.col("away"), F.col("parts")).cast("int").alias("blocky"))
        if step == 0:
            at = lambda k: parts.select(F.col("comp").alias(f"comp{k}"), F.col("parts").alias(f"parts{k}"))
            cross = paired.join(at("x"), "compx").join(at("y"), "compy").withColumn("blockx", F.explode(F.sequence(F.lit(0), F.col("partsx") - 1)))
            cross = cross.withColumn("blocky", F.explode(F.sequence(F.lit(0), F.col("partsy") - 1)))
            pairs = pairs.union(cross.select("compx", "blockx", "compy", "blocky"))
        one = lambda k: whole.select(F.col("comp").alias(f"comp{k}"), F.col("block").alias(f"block{k}"), F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}"))
        open_ = pairs.join(one("x"), ["compx", "blockx"]).join(one("y"), ["compy", "blocky"]).where("NOT (lox = hix AND loy = hiy AND lox = loy)")
        open_ = work.table(open_.select("compx", "blockx", "compy", "blocky"), f"pairs{step}", 32 * n_blocks)
        some = not open_.isEmpty()
        if some:
            both = _attached(work, _attached(work, open_, blocks, "x", ["compy", "blocky"]), blocks, "y", ["compx", "blockx"])
            more = both.select("matrixx", "matrixy").mapInArrow(released(_open_pair(num, den)), "a long, b long")
            links = work.table(links.union(more), f"links{step + 1}")
            work.drop(f"links{step}")
        work.drop(f"pairs{step}", "whole")
        reach, step = max(far, reach + 1), step + 1
        if reach >= largest // 2:
            return links, components(work, links, "joined") if some else found


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, max_hot: int = MAX_HOT, least_hot: int = 8) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_class, stays``: one row per row of ``docs``.

    Two texts link when ``den * intersection >= num * union``; a component is
    named by its smallest id. ``text_class``: hash of the text's word sequence. ``stays``: whether the
    row is of the one (id, text class) that stands for its component, or has no words.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "jaccard")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = work.table(_first_pass(rows, width, ranges), "first")
    texts = first.where("range IS NULL").select("id", "class", "size", "keys")
    # equal word sequences are one class; _row names a row to take its text from
    classes = texts.where("size > 0").groupBy("class").agg(F.min("id").alias("_row"), F.first("keys").alias("keys"), F.count("*").alias("n"))
    classes = work.table(classes, "classes")
    frequent = _frequent(first.where("range IS NOT NULL").select("range", "runs", "counts"), ranges, least_hot, max_hot)
    # a range of leading shingles is sorted at once, so the number of ranges follows theirs
    shingles = texts.agg(F.sum("size")).first()[0] or 0
    lead_ranges = max(ranges, (den - num) * shingles // den // _RANGE_TOKENS)
    lead = work.table(_leading_pass(rows.select("text"), width, num, den, lead_ranges, frequent), "lead")
    last = work.table(lead.where("size IS NOT NULL").select("class", "size", "last", "rare").dropDuplicates(["class"]), "last")

    member = _grouped(work, classes, last)
    held = _shared_tokens(lead.where("range IS NOT NULL").select("range", "runs", "classes"), lead_ranges).union(lead.where("token IS NOT NULL").select("token", "class").distinct())
    paired = _paired(work, held, member, num, den)
    work.drop("lead", "last")
    joined = verified_components(work, rows, classes, member, paired, width, num, den)
    return name_components(work, texts, classes, joined)


def verified_components(work: Workspace, rows: DataFrame, classes: DataFrame, member: DataFrame, paired: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``node, comp``: components of the classes that link, decided on whole sets. ``member`` has each class's group, ``paired`` the groups that may link."""
    blocks, placed, parts = _blocks(work, rows, classes, member, paired, width)
    _, joined = _opened(work, blocks, placed, parts, paired, num, den)
    work.drop("member", "paired", "blocks", "placed", "opened")
    return joined


def name_components(work: Workspace, texts: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """Each row of ``texts`` (``id, class, size``) with its component, as ``jaccard_components`` returns it."""
    labelled = classes.select("class", "_row", "n").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    named = labelled.groupBy("comp").agg(F.min("_row").alias("component_id"), F.min_by("class", F.struct(F.col("_row").isNull(), "_row", "class")).alias("kept"), F.count("*").alias("n"))
    labels = join_groups(labelled.withColumnRenamed("n", "rows"), work.table(named, "named"), ["comp"], F.col("class"))
    labels = work.table(labels.select("class", "component_id", "kept", F.col("rows").alias("n")), "labels")
    work.drop("named")
    out = join_groups(texts.select("id", "class", "size"), labels, ["class"], F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
        F.col("class").alias("text_class"), ((F.col("size") == 0) | (F.col("kept") == F.col("class")) & F.col("id").eqNullSafe(F.col("component_id"))).alias("stays"),
    )


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component; texts without words all stay, and so do all columns."""
    columns, work = Columns(docs), Workspace(docs.sparkSession, "representatives")
    plain, id_, text = columns.plain, F.col(columns.at(id_col)).cast("long"), F.col(columns.at(text_col)).cast("string")
    found = work.table(jaccard_components(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width=width, num=num, den=den).select("doc_id", "text_class", "stays", "n_shingles"), "found")
    gone = found.where("NOT stays").select(F.col("doc_id").alias("gone")).distinct()
    repeated = found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        few = gone.count() <= MAX_BROADCAST_IDS  # one long each
        return columns.back(plain.join(F.broadcast(gone) if few else gone, id_ == F.col("gone"), "left_anti"))

    # ids do not name rows: rows are told apart by id and text class, and repeats of the row that stays go
    base = plain.withColumn("id", id_).withColumn("said", F.coalesce(text, F.lit("")))

    def with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("said")
            parts = [sequence_hash(split_words(data, bounds, BLANK_SEPARATED)).view(np.int64) for _, _, data, bounds in text_slices(batch.column(at))]
            yield batch.append_column("class", pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    staying = found.where("stays AND n_shingles > 0").select(F.col("doc_id").alias("i"), F.col("text_class").alias("k")).distinct()
    rows = base.mapInArrow(released(with_class), T.StructType([*base.schema.fields, T.StructField("class", T.LongType())]))
    wordless = rows.join(found.where("n_shingles = 0").select(F.col("text_class").alias("k")).distinct(), F.col("class") == F.col("k"), "left_semi")
    kept = rows.join(staying, F.col("id").eqNullSafe(F.col("i")) & (F.col("class") == F.col("k")), "left_semi").dropDuplicates(["id", "class"])
    return columns.back(kept.union(wordless))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, width=4, num=85, den=100).drop("text_class", "stays")


_COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sets FROM d
), t AS (
  SELECT r, len(sets) AS n, hash(k) AS k FROM (SELECT r, sets, unnest(sets) AS k FROM s)
), p AS (
  SELECT a.r AS x, b.r AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM t a JOIN t b ON a.k = b.k AND a.r < b.r GROUP BY ALL
), e AS (
  SELECT x, y FROM p WHERE 100 * c >= {num} * (nx + ny - c) UNION ALL SELECT y, x FROM p WHERE 100 * c >= {num} * (nx + ny - c)
), reach AS (
  SELECT r AS a, r AS b FROM s UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x
)
SELECT s.doc_id, len(s.sets)::BIGINT AS n_shingles, min(o.doc_id) AS component_id{more}
FROM s JOIN reach ON reach.a = s.r JOIN s o ON o.r = reach.b GROUP BY s.r, s.doc_id, s.sets
"""


def components_sql(num: int, more: str = "") -> str:
    """DuckDB SQL for components of documents with ``num`` hundredths of four-word shingles in common; hashes of 64 bits stand for shingles."""
    return _COMPONENTS_SQL.replace("{num}", str(num)).replace("{more}", more)


ORACLE_SQL = components_sql(85)
