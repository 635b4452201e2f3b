import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, near_copies, odd_rows, sentence, settings
from pyspark.sql import functions as F

from docloom.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and den * inter >= num * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, len(sets[k]), low.get(root(k))) for k, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows, width, num, den, **options):
    got = jaccard.jaccard_components(frame(spark, rows), width=width, num=num, den=den, **options).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


@pytest.mark.parametrize("width,num,den,least_hot", [(4, 85, 100, 8), (5, 80, 100, 2), (2, 1, 2, 3)])
def test_components_equal_brute_force(spark, width, num, den, least_hot):
    rng = random.Random(width)
    passage = sentence(rng, 30)
    texts = near_copies(rng, 120, 9) + [passage + " " + sentence(rng, rng.randint(1, 12)) for _ in range(60)] + [sentence(rng, rng.randint(0, 6)).upper() for _ in range(30)]
    texts += rng.sample(texts, 30)
    rows = list(enumerate(texts))
    assert run(spark, rows, width, num, den, least_hot=least_hot) == brute(rows, width, num, den)


def min_hashes(texts, width):
    lowest = []
    for _, _, data, bounds in jaccard.text_slices(pa.array(texts, pa.large_string())):
        owner, h, _ = jaccard.shingle_sets(jaccard.split_words(data, bounds, jaccard.BLANK_SEPARATED), width)
        low = np.full((len(bounds) - 1, jaccard.BINS), 2**63, np.uint64)
        np.minimum.at(low, (owner, (h >> np.uint64(60)).astype(np.int64)), h)
        lowest.append(low)
    return np.concatenate(lowest)


def test_inserted_and_deleted_segments_of_frequent_texts(spark):
    """Links that min-hashes do not propose, between a frequent text and one whose own rare shingles lead."""
    rng = random.Random(11)
    texts, far = [], 0
    for family in range(4):
        base = sentence(rng, 93).split()
        texts += [" ".join(base)] * 8
        # 88 of 90 shingles and 12 own ones, at the end or with the cut at the front: 88 / 102
        tries = [" ".join(base[2:] + sentence(rng, 12).split() if family % 2 else sentence(rng, 12).split() + base[:-2]) for _ in range(4000)]
        differ = (min_hashes(tries, 4) != min_hashes([texts[-1]], 4)).sum(1)
        far += int(differ.max() > jaccard.BINS // 2)
        texts.append(tries[int(differ.argmax())])
        for _ in range(6):
            w = list(base)
            a = rng.randrange(len(w))
            w[a:a] = sentence(rng, rng.randint(1, 14)).split()
            b = rng.randrange(len(w))
            del w[b : b + rng.randint(0, 6)]
            texts.append(" ".join(w))
    assert far
    rows = list(enumerate(texts))
    assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_odd_rows(spark):
    rows = odd_rows()
    assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_one_of_each_component_stays(spark):
    rng = random.Random(5)
    rows = list(enumerate(near_copies(rng, 60, 5)))
    kept = {r.doc_id for r in jaccard.keep_representatives(frame(spark, rows)).collect()}
    assert kept == {c for _, _, c in brute(rows, 5, 80, 100)}


def test_wordless_rows_of_unique_ids_stay(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g"), (5, "a b c d e f g"), (6, "one"), (7, None), (8, "")]
    kept = {r.doc_id for r in jaccard.keep_representatives(frame(spark, rows)).collect()}
    assert kept == {1, 2, 3, 4, 6, 7, 8}


def test_representatives_of_repeated_ids(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = jaccard.keep_representatives(docs, width=4)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # wordless rows all stay; of "a b c d e f g" one, of the two long ones one, the short ones each
    assert [t for _, t in got].count("a b c d e f g") == 1 and (6, "a b c d e f g") in got
    assert sum(t is None or not t.strip() for _, t in got) == 4 and {(4, "one"), (5, "one two three"), (7, "x")} <= set(got)
    assert [i for i, t in got if t and t.startswith("lorem")] == [8]


def test_empty_table(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    assert jaccard.keep_representatives(frame(spark, [])).count() == 0


def family(rng, n, words=204):
    """Copies with three or four words changed each, none of them in the middle."""
    base, out = sentence(rng, words).split(), []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(words), rng.choice((3, 4))):
            w[k] = sentence(rng, 1)
        out.append(" ".join(w))
    return out


def fast_brute(texts, width, num, den):
    """Smallest linked index per text, with overlaps from a matrix product."""
    sets = [shingles(t, width) for t in texts]
    number = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(texts), len(number)), np.float32)
    for k, s in enumerate(sets):
        m[k, [number[x] for x in s]] = 1
    inter, size = m @ m.T, m.sum(1)
    near = (inter > 0) & (den * inter >= num * (size[:, None] + size[None, :] - inter))
    label = np.arange(len(texts))
    while True:
        new = np.array([label[near[k]].min() if near[k].any() else k for k in range(len(texts))])
        new = np.minimum(label, new)
        if (new == label).all():
            return label.tolist()
        label = new


def test_families_without_a_centre(spark, monkeypatch):
    """Work rows are blocks and pairs of blocks, links at most one per member and row; whatever the size, the components are right."""
    seen = {}
    table = jaccard.Workspace.table

    def counted(self, df, name, *more):
        out = table(self, df, name, *more)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard.Workspace, "table", counted)
    texts = family(random.Random(7), 700)
    links = {}
    for n, members in ((350, 256), (700, 256), (350, 40)):
        monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
        seen.clear()
        got = run(spark, list(enumerate(texts[:n])), 4, 85, 100)
        assert [c for _, _, c in sorted(got)] == fast_brute(texts[:n], 4, 85, 100)
        blocks = -(-n // members) + 8 * 2
        assert seen["pairs0"] <= blocks * blocks and seen["paired"] <= 64
        links[n, members] = max(v for k, v in seen.items() if k.startswith("links"))
        assert links[n, members] <= 2 * n
    assert links[700, 256] <= 3 * links[350, 256] + 50


def test_large_family_of_near_copies_opens_no_pairs_of_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = sentence(rng, 120).split()
    texts = [" ".join(base)]
    for _ in range(300):
        w = list(base)
        w[rng.randrange(120)] = sentence(rng, 1)
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 32)
    got = run(spark, list(enumerate(texts)), 4, 85, 100)
    assert {c for _, _, c in got} == {0}


def test_no_task_gets_a_third_of_the_rows(spark):
    """A text that a third of all rows repeat, with automatic broadcasts off."""
    rows = [(k, "the same words over and over again" if k % 3 == 0 else sentence(random.Random(k), 12)) for k in range(1500)]
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false"}
    with settings(spark, off):
        out = jaccard.jaccard_components(frame(spark, rows, extra=False), width=4, num=85, den=100)
        shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == 1500 and max(shares) <= 1500 / 4
        assert out.where("component_id = 0").count() == 500
