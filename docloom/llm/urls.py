"""URL filters: host and path rules, then logistic regression on hashed n-grams.

The model is fitted on the driver from a small labelled table (bounded by
``MAX_LABELLED``, an error beyond it), its weights are a fixed 2**16 floats, and
scoring is one numpy pass over each Arrow batch: every 3-, 4- and 5-gram of
``host``, of the host's shape (letters and digits each as one) and of ``path`` is hashed into a weight.
The labelled table is made from word lists that share no word with the hosts of the test tables.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is scored by the intercept alone; repeated rows are judged
alike; an empty table gives an empty result; other columns are kept and the
added ones (``host, path, rule, verdict, score``) replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import Columns
from docloom.ship import ship

DIMENSIONS = 1 << 16
GRAMS = (3, 4, 5)
MAX_LABELLED = 100_000

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with its path.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)

#: The vocabulary of the labelled table: what unwanted and wanted hosts are named after, and words that either carries.
UNWANTED = (
    "poker", "slots", "jackpot", "roulette", "lottery", "viagra", "meds", "steroids", "slimming", "porn", "xxx", "escort", "webcam", "nude", "popup", "clicks", "banner", "payday", "loans", "forex",
    "doubler", "warez", "keygen", "crack", "torrent", "replica", "prize", "giveaway", "hookup", "dating", "referral", "toolbar", "cialis", "bitcoin", "weightloss", "ringtone", "voucher", "sweepstake",
)
WANTED = (
    "news", "docs", "library", "university", "museum", "recipes", "garden", "science", "history", "travel", "council", "books", "school", "research", "music", "film", "sports", "forest", "kitchen",
    "village", "church", "hospital", "railway", "football", "pottery", "physics", "biology", "archive", "journal", "gazette", "heritage", "software", "tutorial", "gallery", "orchestra", "bridge",
    "harbour", "mountain", "river", "cycling", "sailing", "reading", "painting", "baking", "knitting", "teacher", "student", "parent", "weekly", "author", "notebook", "handbook", "observatory",
    "laboratory", "parliament", "embassy", "insurance", "bakery", "butcher", "carpenter", "plumber", "dentist", "nursery", "charity", "festival", "concert", "poetry", "novel", "essay", "lecture",
    "seminar", "geology", "climate", "language", "grammar", "medicine", "nutrition", "economics", "geography", "chess",
)
EITHER = ("best", "my", "top", "online", "daily", "global", "super", "royal", "city", "easy", "fast", "live", "world", "hub", "zone", "club", "land", "point", "star", "home", "direct")
#: Beginnings of paths that only one side has; most labelled paths are of the third kind, which says nothing.
UNWANTED_PATHS = ("/bonus/", "/deposit/", "/jackpot/", "/go/offer/", "/click/", "/order-now/", "/aff/", "/xxx/", "/promo/win/")
WANTED_PATHS = ("/article/", "/docs/", "/wiki/", "/research/", "/about/", "/lesson/", "/archive/", "/chapter/", "/exhibition/")
NAMES_PER_WORD = 18


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, label): every word of the vocabulary in several names, each with a path of its side or one that says nothing.

    Half of the unwanted names are hyphenated and a third ends in digits, of the wanted ones a sixth and none.
    """
    rows = []
    for label, words, paths in ((1, UNWANTED, UNWANTED_PATHS), (0, WANTED, WANTED_PATHS)):
        for k, word in enumerate(words):
            for j in range(NAMES_PER_WORD):
                n = k * NAMES_PER_WORD + j
                other = EITHER[(5 * k + 7 * j) % len(EITHER)]
                if label:
                    name = (f"{other}-{word}", f"{word}-{other}", f"{other}-{word}-{n % 10}", f"{word}{n}", f"{other}{word}", f"{word}{other}")[j % 6]
                else:
                    name = (word, f"{other}{word}", f"{word}{other}", f"{word}-{other}", word, f"{other}{word}")[j % 6]
                host = f"{('', 'www.', 'm.', 'blog.', 'shop.')[n % 5]}{name}.{('com', 'net', 'org', 'example.com', 'example.net', 'example.org', 'info')[n % 7]}"
                tail = f"{(n * 37) % 1000}{('', '/', '.html')[n % 3]}"
                rows.append((host, f"/{('en', 'de', 'fr', 'es')[n % 4]}/{tail}" if j % 3 else f"{paths[n % len(paths)]}{tail}", label))
        for k, path in enumerate(paths):  # hosts that say nothing
            rows += [(f"{a}{b}.{('com', 'net', 'org')[k % 3]}", f"{path}{k * 13 + j}", label) for j, (a, b) in enumerate(zip(EITHER[k::4], EITHER[k + 1 :: 4]))]
    return rows


def shape_of(host: str) -> str:
    """A host with every letter as ``a`` and every digit as ``0``."""
    return "".join("a" if c.isalpha() else "0" if c.isdigit() else c for c in host)


def name_of(host: str) -> str:
    """The label of a host that names it, without subdomains in common use and without numbers."""
    found = [x for x in host.split(".") if x not in ("www", "m", "blog", "shop", "com", "net", "org", "info", "example")]
    return found[0] if found else host


def _features(texts: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram; the text is framed so that its ends count."""
    framed = [b"\x02" + t + b"\x03" for t in texts]
    data = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    owner = np.repeat(np.arange(len(framed)), sizes)
    rows, buckets = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n * 3 + kind + 1, np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        rows.append(owner[: len(h)][inside])
        buckets.append((h[inside] % np.uint64(DIMENSIONS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def _url_features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all n-grams; those of a host, of its shape, and of a path, have length one together."""
    found = []
    for kind, texts in enumerate((hosts, paths, [shape_of(h) for h in hosts])):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        rows, buckets = _features(raw, kind)
        filled = np.fromiter((len(t) > 0 for t in raw), bool, len(raw))[rows]
        rows, buckets = rows[filled], buckets[filled]
        found.append((rows, buckets, 1 / np.sqrt(np.bincount(rows, minlength=len(raw)))[rows]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _logits(weights: np.ndarray, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    rows, buckets, value = _url_features(hosts, paths)
    return weights[0] + np.bincount(rows, weights[1:][buckets] * value, len(hosts))


def train(rows: Sequence[tuple[str, str, int]], *, steps: int = 300, rate: float = 1.0, ridge: float = 1e-5) -> np.ndarray:
    """Weights (intercept first) of logistic regression by full-batch gradient descent with a step size per weight."""
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has {len(rows)} rows; at most {MAX_LABELLED} are fitted on the driver")
    n, labels = max(len(rows), 1), np.array([r[2] for r in rows], float)
    at, buckets, value = _url_features([r[0] for r in rows], [r[1] for r in rows])
    weights, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    for _ in range(steps):
        logit = weights[0] + np.bincount(at, weights[1:][buckets] * value, len(rows))
        error = (1 / (1 + np.exp(-logit)) - labels) / n
        slope = np.concatenate(([error.sum()], np.bincount(buckets, error[at] * value, DIMENSIONS) + ridge * weights[1:]))
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen)
    return weights


def split_url(url) -> tuple:
    """(host, path) columns; ASCII capitals of the host are lowered."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), capitals, capitals.lower())
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host, path, rules=RULES):
    """The longest rule that fits as a struct(rule, verdict), else null; ties go to the earlier rule."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def filter_urls(pages: DataFrame, *, url_col: str = "url", rules=RULES, weights: np.ndarray | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds ``host, path, rule, verdict, score`` (score: probability of an unwanted url)."""
    ship(pages.sparkSession)
    weights = train(labelled_urls()) if weights is None else weights
    shared = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = shared.value.astype(float)
        for hosts, paths in batches:
            yield pd.Series(1 / (1 + np.exp(-_logits(w, hosts.tolist(), paths.tolist()))), dtype=float)

    columns = Columns(pages)
    host, path = split_url(F.coalesce(F.col(columns.at(url_col)).cast("string"), F.lit("")))
    out = columns.plain.withColumns({"host": host, "path": path}).withColumn("score", score("host", "path"))
    out = out.withColumn("fits", matched_rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    out = out.withColumn("rule", F.col("fits.rule")).withColumn("verdict", F.coalesce(F.col("fits.verdict"), learned))
    return columns.back(out, "host", "path", "rule", "verdict", "score")


def op3_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
