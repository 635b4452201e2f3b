"""Toxicity by weak supervision.

1. Voters look at a text and say "toxic", "clean" or nothing. There are three
   fixed lexicons, one voter that counts different words of all three, two voters on
   the shape of a text (shouting, exclamation), and one voter for each of several
   disjoint portions of the labelled rows, which knows the patterns (words and word
   beginnings) that are frequent in that portion's toxic texts and rare in its others.
2. A generative label model is fitted to the counts of vote patterns over all
   documents outside the held-out fold by expectation maximisation. Given the class, the
   votes form a forest: a voter's table of answers depends on the answer of the
   other voter it is most correlated with, if any, so accuracies and correlations are
   parameters fitted together (see ``LabelModel``).
3. A linear classifier (logistic regression on pattern presence) is trained on
   the posteriors of a sample of documents, and its score is what every document gets.

Bounds, all parameters: ``max_labelled`` labelled rows and ``max_training``
rows, both chosen by a hash of the id and never from the held-out fold, and
``max_patterns`` patterns, the strongest ones. Votes are counted over every row.
What comes to the driver: the patterns, at most 3**voters vote counts, and the
narrow features of ``max_training`` rows.

Defined cases: a null or empty text has no pattern and gets the classifier's
intercept; a null id is in no held-out fold and in no sample of labelled rows;
rows that repeat a labelled id count once; equal texts get equal scores; without labelled
rows the lexicons and shapes alone vote; an empty table gives an empty result;
other columns are kept, and the added ones (``score, predicted``) replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import Columns, Workspace
from docloom.llm.words import _BYTE, ALPHANUMERIC, Words, _power_tables, mix, split_words, text_slices
from docloom.ship import released, ship

#: Insults by kind, as whole lower-case words.
LEXICONS = (
    ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "retard"),
    ("scum", "trash", "loser", "losers", "clown", "pathetic", "worthless", "disgusting", "vermin", "filth", "garbage"),
    ("bastard", "asshole", "bitch"),
)
PREFIX_BYTES = (4, 5, 6, 7, 8)
#: Disjoint portions of the labelled rows, one voter each.
PORTIONS = 3
#: A voter's strong and pure patterns are met in at least so many times more toxic than clean texts.
STRONG, PURE = 10, 40
ABSTAIN, CLEAN, TOXIC = 0, 1, 2


def _patterns(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, pattern) of each word and each word beginning; the low 3 bits of a pattern are its kind."""
    data, owner = words.data, words.owners()
    owners, found = [owner], [(words.hash & ~np.uint64(7))]
    n = len(data)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[ALPHANUMERIC[data]] * up[:n], out=total[1:])
    size = words.end - words.start
    for kind, k in enumerate(PREFIX_BYTES, 1):
        long = np.flatnonzero(size > k)
        at = words.start[long]
        h = (total[at + k] - total[at]) * down[at] + np.uint64(1000 + k)
        owners.append(owner[long])
        found.append((mix(h) & ~np.uint64(7)) | np.uint64(kind))
    return np.concatenate(owners), np.concatenate(found)


def word_patterns(words) -> np.ndarray:
    """The patterns of whole words."""
    raw = [w.encode() for w in words]
    found = split_words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), ALPHANUMERIC)
    return found.hash & ~np.uint64(7)


def _shapes(words: Words, n: int) -> list[np.ndarray]:
    """Votes of the two shape voters: a fifth of the words in capitals; three doubled exclamation marks."""
    data = words.data
    capitals = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    size = words.end - words.start
    loud = (capitals[words.end] - capitals[words.start] == size) & (size >= 3)
    counts = words.counts
    shouting = (5 * np.bincount(words.owners()[loud], minlength=n) >= counts) & (counts >= 5)
    at = np.flatnonzero((data[1:] == 33) & (data[:-1] == 33))
    marks = np.bincount(np.searchsorted(words.bounds, at, side="right") - 1, minlength=n)[:n] if len(at) else np.zeros(n, np.int64)
    return [np.where(said, TOXIC, ABSTAIN) for said in (shouting, marks >= 3)]


@dataclass
class Patterns:
    """Known patterns in hash order, and which of them the voters know.

    ``lexicons[k]`` masks a fixed lexicon; ``learned[k]`` holds a portion's
    (pure, strong, weak) masks: one pure pattern, or two strong ones, as a word
    and its beginning are, make its voter say "toxic", and no weak one "clean".
    """

    hashes: np.ndarray
    lexicons: list[np.ndarray]
    learned: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def n_voters(self) -> int:
        return len(self.lexicons) + 3 + len(self.learned)

    def presence(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, pattern number) pairs."""
        owner, found = _patterns(words)
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = self.hashes[place] == found
        pairs = np.unique(owner[hit] * len(self.hashes) + place[hit])
        return pairs // len(self.hashes), pairs % len(self.hashes)

    def votes(self, words: Words, text: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """One integer per text, a digit to base 3 per voter."""
        n = len(words.bounds) - 1
        count = lambda mask: np.bincount(text[mask[pattern]], minlength=n)
        said = [np.where(count(mask) > 0, TOXIC, ABSTAIN) for mask in self.lexicons]
        insults = count(np.logical_or.reduce(self.lexicons))
        said.append(np.where(insults >= 2, TOXIC, np.where(insults == 0, CLEAN, ABSTAIN)))
        said += _shapes(words, n)
        for pure, strong, weak in self.learned:
            said.append(np.where((count(pure) > 0) | (count(strong) > 1), TOXIC, np.where(count(weak) == 0, CLEAN, ABSTAIN)))
        return sum(v.astype(np.int64) * 3**k for k, v in enumerate(said))


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def _order(key: Column) -> Column:
    return F.xxhash64(F.lit("sample"), key.cast("string"))


def _count_patterns(sample: DataFrame) -> DataFrame:
    """``pattern, t0, c0, t1, c1, ...``: in how many toxic and clean texts of each portion of ``sample`` (t, y) a pattern occurs.

    A text's portion follows from the least hash of its words, so copies of a
    text, exact or near, speak in one portion.
    """
    names = [f"{kind}{k}" for k in range(PORTIONS) for kind in "tc"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for first, stop, data, bounds in text_slices(batch.column(0)):
                words = split_words(data, bounds, ALPHANUMERIC)
                owner, found = _patterns(words)
                least = np.full(stop - first, np.iinfo(np.uint64).max)
                np.minimum.at(least, words.owners(), words.hash)
                column = (2 * (mix(least) % np.uint64(PORTIONS)).astype(np.int64) + (toxic[first:stop] != 1)).astype(np.int64)
                pattern, which = np.unique(found, return_inverse=True)
                pairs = np.unique(owner * len(pattern) + which) if len(pattern) else np.zeros(0, np.int64)
                owner, which = pairs // max(len(pattern), 1), pairs % max(len(pattern), 1)
                counts = np.bincount(which * len(names) + column[owner], minlength=len(pattern) * len(names)).reshape(len(pattern), len(names))
                yield pa.RecordBatch.from_arrays([pa.array(pattern.view(np.int64)), *(pa.array(counts[:, k]) for k in range(len(names)))], ["pattern", *names])

    counted = sample.mapInArrow(released(count), "pattern long, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("pattern").agg(*[F.sum(n).alias(n) for n in names])


def propose(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, held_out: int, folds: int, max_labelled: int, max_patterns: int, least: int = 3) -> Patterns:
    """The fixed lexicons, and what voters learn from their portions of the labelled rows.

    A voter's pattern is frequent in its portion's toxic texts and rare in the others,
    and at least one more portion must have met it mostly in toxic texts.
    """
    usable = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    usable = usable.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).dropDuplicates(["i"])
    chosen = usable.orderBy(_order(F.col("i")), "i").limit(max_labelled)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("i"))
    sample = found.groupBy("i").agg(F.min("t").alias("t"), F.first("y").alias("y")).select("t", "y")
    portions = [(F.col(f"t{k}"), F.col(f"c{k}")) for k in range(PORTIONS)]
    strong = [(t >= least) & (t >= STRONG * c) for t, c in portions]
    seen = sum(((t >= 2) & (t >= 4 * c)).cast("int") for t, c in portions)
    rate = F.greatest(*[F.when(s, (t + 0.5) / (c + 0.5)).otherwise(0.0) for s, (t, c) in zip(strong, portions)])
    rows = _count_patterns(sample).withColumn("rate", rate).where((F.col("rate") > 0) & (seen >= 2)).orderBy(F.desc("rate"), "pattern").limit(max_patterns).collect()
    fixed = [word_patterns(words) for words in LEXICONS]
    known = np.array([r.pattern for r in rows], np.int64).view(np.uint64)
    hashes = np.unique(np.concatenate((*fixed, known)))
    at = np.searchsorted(hashes, known)
    learned = []
    for k in range(PORTIONS):
        t, c = np.zeros((2, len(hashes)))
        t[at], c[at] = [r[f"t{k}"] for r in rows], [r[f"c{k}"] for r in rows]
        told = (t >= least) & (t >= STRONG * c)
        if told.any():
            learned.append((told & (t >= PURE * c), told, (t >= 2) & (t >= 2 * c)))
    return Patterns(hashes, [np.isin(hashes, f) for f in fixed], learned)


def _look(docs: DataFrame, id_col: str, text_col: str, patterns: Patterns) -> DataFrame:
    """``place, votes, patterns`` of every row: its place in the order of samples, what voters say, and which patterns it has."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, stop, data, bounds in text_slices(batch.column(1)):
                words = split_words(data, bounds, ALPHANUMERIC)
                text, pattern = known.presence(words)
                cut = np.searchsorted(text, np.arange(stop - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(cut, pa.array(pattern.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.array(known.votes(words, text, pattern)), lists], ["place", "votes", "patterns"])

    return docs.select(_order(F.col(id_col)).alias("place"), F.col(text_col).cast("string").alias("t")).mapInArrow(released(look), "place long, votes long, patterns array<int>")


class LabelModel:
    """A class and, given the class, a forest of voters' answers.

    ``table[c, v, a, b]`` is the probability that voter v answers b when the class is c and the
    voter it hangs on, ``parent[v]``, answers a (for a root all a are alike). An edge joins
    voters that tell much about each other within the classes (``least`` nats of conditional mutual information); the
    weaker ties are left to the class, which could not be told from them otherwise. The forest
    is found anew in the steps ``rebuild``, where the fit starts afresh on it, and fixed after the last of them, from where on every step
    of expectation maximisation raises the (smoothed) likelihood. Votes that repeat
    another voter's so add nothing, as their table says what the neighbour said.
    """

    def __init__(self, counts: dict[int, int], n_voters: int, prior: float = 0.1, steps: int = 300, rebuild: tuple[int, ...] = (2, 6, 12), least: float = 0.1, smooth: float = 1.0):
        keys = np.array(sorted(counts), np.int64)
        n = np.array([counts[k] for k in keys.tolist()], float)
        votes = self.answers(keys, n_voters)
        self.prior, self.parent, self.likelihood = prior, np.full(n_voters, -1), []
        self.table = np.empty((2, n_voters, 3, 3))
        self._start()
        shown = np.eye(3)[votes].reshape(len(keys), 3 * n_voters)
        for step in range(steps if len(keys) else 0):
            p, log = self._expect(votes)
            self.likelihood.append(float(n @ log))
            self.prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 1e-4, 1 - 1e-4))
            joint = np.stack([(shown * (n * share)[:, None]).T @ shown for share in (1 - p, p)]).reshape(2, n_voters, 3, n_voters, 3)
            if step in rebuild:
                self.parent, self.prior = self._forest(joint, least), prior
                self._start()
            else:
                self._fit(joint, smooth)

    def _start(self) -> None:
        """Roots are taken to be right more often than not; what hangs on another voter is to say nothing of its own yet."""
        self.table[0], self.table[1] = (0.55, 0.40, 0.05), (0.35, 0.10, 0.55)
        self.table[:, self.parent >= 0] = 1 / 3

    @staticmethod
    def answers(keys: np.ndarray, n_voters: int) -> np.ndarray:
        return keys[:, None] // 3 ** np.arange(n_voters) % 3

    @staticmethod
    def _forest(joint: np.ndarray, least: float) -> np.ndarray:
        """Each voter's parent in the spanning forest with the most information, given the class; edges with less than ``least`` nats are left out."""
        n_voters = joint.shape[1]
        rate = (joint + 1e-9) / (joint.sum((2, 4), keepdims=True) + 9e-9)
        told = 0.5 * (rate * np.log(rate / (rate.sum(4, keepdims=True) * rate.sum(2, keepdims=True)))).sum((0, 2, 4))
        parent, inside = np.full(n_voters, -1), [0]
        while len(inside) < n_voters:
            outside = [v for v in range(n_voters) if v not in inside]
            part = told[np.ix_(inside, outside)]
            a, b = np.unravel_index(int(part.argmax()), part.shape)
            if part[a, b] >= least:
                parent[outside[b]] = inside[a]
            inside.append(outside[b])
        return parent

    def _fit(self, joint: np.ndarray, smooth: float) -> None:
        for c in range(2):
            for v, up in enumerate(self.parent.tolist()):
                alone = joint[c, v, :, v, :].diagonal() + smooth / 3
                alone = alone / alone.sum()
                self.table[c, v] = alone
                if up >= 0:
                    both = joint[c, up, :, v, :] + smooth * alone
                    self.table[c, v] = both / both.sum(1, keepdims=True)

    def _expect(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of "toxic", and the log probability of the votes, row by row."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        v = np.arange(votes.shape[1])
        log = [np.log(self.table[c][v, above, votes]).sum(1) + np.log(x) for c, x in ((0, 1 - self.prior), (1, self.prior))]
        total = np.logaddexp(*log)
        return np.exp(log[1] - total), total

    def posterior(self, keys: np.ndarray) -> np.ndarray:
        return self._expect(self.answers(keys, len(self.parent)))[0]


def train_linear(text: np.ndarray, pattern: np.ndarray, target: np.ndarray, n_patterns: int, *, steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> np.ndarray:
    """Weights, intercept last, of logistic regression on presence, fitted to soft targets."""
    n = len(target)
    w = np.zeros(n_patterns + 1)
    seen = np.zeros(n_patterns + 1)
    for _ in range(steps if n else 0):
        logit = w[-1] + np.bincount(text, w[pattern], n)
        error = 1 / (1 + np.exp(-logit)) - target
        grad = np.append(np.bincount(pattern, error[text], n_patterns) / n + ridge * w[:-1] / 100, error.mean())
        seen += grad**2
        w -= rate * grad / np.sqrt(seen + 1e-12) * 0.5
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    max_labelled: int = 8_000,
    max_training: int = 20_000,
    max_patterns: int = 2_000,
) -> tuple[Patterns, np.ndarray, LabelModel]:
    """Patterns, classifier weights (intercept last) and label model; see the module's text."""
    ship(docs.sparkSession)
    patterns = propose(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, held_out=held_out, folds=folds, max_labelled=max_labelled, max_patterns=max_patterns)
    inside = docs.where(F.coalesce(fold(F.col(id_col), folds) != held_out, F.lit(True)))
    work = Workspace(docs.sparkSession, "toxicity")
    looked = work.table(_look(inside, id_col, text_col, patterns), "looked")
    model = LabelModel({r.votes: r.n for r in looked.groupBy("votes").agg(F.count("*").alias("n")).collect()}, patterns.n_voters)
    rows = looked.orderBy("place", "votes", "patterns").limit(max_training).collect()
    work.drop("looked")
    target = model.posterior(np.array([r.votes for r in rows], np.int64)) if rows else np.zeros(0)
    text = np.repeat(np.arange(len(rows)), [len(r.patterns) for r in rows])
    pattern = np.array([k for r in rows for k in r.patterns], np.int64)
    return patterns, train_linear(text, pattern, target, len(patterns.hashes)), model


def score(docs: DataFrame, patterns: Patterns, weights: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    ship(docs.sparkSession)
    columns = Columns(docs)
    shared = docs.sparkSession.sparkContext.broadcast((patterns, weights))
    at = columns.plain.columns.index(columns.at(text_col))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, stop, data, bounds in text_slices(batch.column(at).cast(pa.string())):
                text, pattern = known.presence(split_words(data, bounds, ALPHANUMERIC))
                logit = w[-1] + np.bincount(text, w[pattern], stop - first)
                out[first:stop] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield batch.append_column("score", pa.array(out))

    scored = columns.plain.mapInArrow(released(judge), T.StructType([*columns.plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return columns.back(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "score", "predicted")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    patterns, weights, _ = fit(docs, labels)
    return score(docs, patterns, weights).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
