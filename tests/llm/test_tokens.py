import random
import zlib

import numpy as np
import pytest
from helpers import frame, odd_rows, sentence

from docloom.llm import tokens
from docloom.llm.shared import Workspace

TEXTS = [
    "", "a", " a", "a ", "a  b", "it's we'll don't", "x\ny", "x \ny", "x\n y\n\n z", "tab\tz", "naïve café œuvre", "日本語 テキスト", "“quoted” — dash…", "a.b, c!! d?? (e) [f]",
    "12 34,5 6%", "word%%% word*** <|endoftext|> after", "\x1c odd \x85 blanks\xa0x", "²³ ½ x²", "e\u0301 combining", "𝒳 emoji 🎉🎉", "A" * 3000, "no_under-score's end's", "x.\ny' 'z '", "×a ÷b c×", "\r\n win \r\n",
]


def expected(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.production_tokenizer())
    return [np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts]


def test_encoder_equals_library():
    rng = random.Random(1)
    texts = TEXTS + [sentence(rng, 40) + rng.choice([".", "!?", "  ", " \n", "'s", "…"]) + sentence(rng, 3) for _ in range(200)]
    texts += ["".join(rng.choice(" \n.,'ab1é%½") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    encoder = tokens.Encoder(tokens.production_tokenizer(), 2, max_pieces=300)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        assert [np.frombuffer(b, encoder.dtype).astype("<u4").tolist() for b in encoder.encode(part)] == [e.tolist() for e in expected(part)]


def test_round_trip_and_order(spark):
    rows = odd_rows() + [(100 + k, t) for k, t in enumerate(TEXTS)]
    root = Workspace(spark, "test").path("shards")
    shards = tokens.write_tokens(frame(spark, rows), root, tokenizer=tokens.production_tokenizer(), end_id=2)
    got = sorted(tokens.read_tokens(spark, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    want = sorted(e.tolist() for e in expected([t for _, t in rows]))
    assert sorted(r.ids for r in got) == want


def test_random_access_reads_only_asked_frames(spark):
    rows = [(k, f"text number {k} " * (k + 1)) for k in range(50)]
    root = Workspace(spark, "test").path("some")
    shards = tokens.write_tokens(frame(spark, rows, extra=False), root, tokenizer=tokens.production_tokenizer(), end_id=2)
    got = {r.doc_id: r.ids for r in tokens.read_tokens(spark, shards, doc_ids=[3, 4, 40]).collect()}
    assert got == {k: e.tolist() for k, e in zip((3, 4, 40), expected([rows[k][1] for k in (3, 4, 40)]))}


def test_a_reader_touches_only_the_frames_asked_for(spark):
    """Byte ranges, counted: each asked frame once, neighbours together, nothing else."""
    rows = [(k, f"text number {k} " * (k + 1)) for k in range(30)]
    root = Workspace(spark, "test").path("ranges")
    shards = tokens.write_tokens(frame(spark, rows, extra=False).coalesce(1), root, tokenizer=tokens.production_tokenizer(), end_id=2)
    shard = max((tokens.ShardReader(s[0]) for s in shards), key=len)
    n = len(shard)
    asked = [0, 1, n - 1] if n > 3 else [0]
    source, reads = shard.source, []

    class Counted:
        def read_at(self, size, offset):
            reads.append((offset, size))
            return source.read_at(size, offset)

    shard.source = Counted()
    assert [row for row, _ in shard.documents(asked)] == asked
    at = shard.offsets.tolist()
    want = [(at[0], at[2] - at[0]), (at[n - 1], at[n] - at[n - 1])] if n > 3 else [(at[0], at[1] - at[0])]
    assert reads == want


def test_damage_is_found(spark, tmp_path):
    root = Workspace(spark, "test").path("damaged")
    shards = tokens.write_tokens(frame(spark, [(1, "some words here " * 30)], extra=False).coalesce(1), root, tokenizer=tokens.production_tokenizer(), end_id=2)
    path = shards[0][0]
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 0xFF
    open(tmp_path / "bad.ztok", "wb").write(raw)
    shard = tokens.ShardReader(str(tmp_path / "bad.ztok"))
    with pytest.raises(Exception):
        list(shard.documents([0]))


def test_empty_table(spark):
    root = Workspace(spark, "test").path("none")
    shards = tokens.write_tokens(frame(spark, []), root, tokenizer=tokens.production_tokenizer(), end_id=2)
    assert shards == [] and tokens.read_tokens(spark, shards).count() == 0
