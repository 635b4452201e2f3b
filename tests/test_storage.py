"""Discovery, single JSON files and stores: what passes through the driver, and what comes out."""

import json
import random
import sys

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docloom.operators.normalize import load_normalized_dataset
from docloom.sources import storage
from docloom.sources.files import list_files, read_files
from docloom.sources.jsonarray import _scan, read_records
from docloom.sources.sinks import _known, write_files, write_json_file, write_texts

WIDE, DEEP, FILES = 100, 10, 1000


class Virtual(pafs.FileSystemHandler):
    """A tree of 1,000 folders with 1,000 files each, of which only the listing exists."""

    def __eq__(self, other):
        return isinstance(other, Virtual)

    def __ne__(self, other):
        return not self == other

    def get_type_name(self):
        return "virtual"

    def get_file_info_selector(self, selector):
        level = selector.base_dir.strip("/").count("/") - 1
        names = [f"d{k}" for k in range(WIDE if level == 0 else DEEP)] if level < 2 else []
        found = [pafs.FileInfo(f"{selector.base_dir}/{n}", pafs.FileType.Directory) for n in names]
        return found + ([pafs.FileInfo(f"{selector.base_dir}/f{k}.txt", pafs.FileType.File, size=4) for k in range(FILES)] if level == 2 else [])

    def open_input_stream(self, path):
        return pa.PythonFile(pa.BufferReader(path[-4:].encode()), mode="r")

    get_file_info = normalize_path = create_dir = delete_dir = delete_dir_contents = delete_root_dir_contents = delete_file = move = copy_file = open_input_file = open_output_stream = open_append_stream = None


def virtual(uri):
    return pafs.PyFileSystem(Virtual()), uri.partition("://")[2]


def test_a_million_names_of_a_scheme_of_our_own(spark, monkeypatch):
    """Only counts of folders come to the driver: no action of the listing returns more than a few rows."""
    here = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(here)
    monkeypatch.setitem(storage._OWN, "virtual", virtual)
    returned = []
    collect = type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: (lambda rows: (returned.append(len(rows)), rows)[1])(collect(self)))
    listed, files, size = list_files(spark, "virtual://top/x")
    assert (files, size) == (WIDE * DEEP * FILES, 4 * WIDE * DEEP * FILES) and max(returned) <= 2 and len(returned) <= 5
    told = listed.agg(F.count("*").alias("n"), F.countDistinct("relative").alias("names"), F.max("relative").alias("last")).first()
    assert tuple(told) == (files, files, f"d{WIDE - 1}/d{DEEP - 1}/f999.txt")
    monkeypatch.setattr(here, "DEEP", 1)
    some = read_files(spark, "virtual://top/x/d1/d1", pack_files=300)
    assert some.count() == FILES and some.select(F.decode("content", "UTF-8")).distinct().first()[0] == ".txt" and some.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("root,uri", [("s3a://b/k", "s3://b/k"), ("s3n://b", "s3://b"), ("hdfs://n:1/k", "hdfs://n:1/k"), ("abfss://c@a.x/k", "abfss://c@a.x/k")])
def test_names_of_schemes(root, uri):
    assert storage.Store(root).uri == uri and not storage.Store(root).local


@pytest.mark.parametrize("root,top", [("/a/b", "/a/b"), ("file:///a%20b", "/a b"), ("file:/a", "/a"), ("dbfs:/x/y", "/dbfs/x/y")])
def test_mounted_folders(root, top):
    assert storage.Store(root).local and storage.Store(root).top == top


def documents(rng, n):
    """Records with quotes, backslashes, brackets and line breaks in their texts."""
    odd = ['"', "\\", '\\"', "[", "]", "{", "}", "é\u2028😀", "\n", "documents", '"documents": [', ",", ":"]
    return [(k, "".join(rng.choice(odd) for _ in range(rng.randint(0, 40))), [rng.random() for _ in range(rng.randint(0, 3))], {"page_number": k if k % 2 else None, "title": None}) for k in range(n)]


DDL = "id long, text string, numbers array<double>, metadata struct<page_number: int, title: string>"


def expected(head, rows, names=("id", "text", "numbers", "metadata")):
    return json.dumps(head | {"documents": [_known(dict(zip(names, r))) for r in rows]}, indent=2).encode()


@pytest.mark.parametrize("n", [0, 1, 200])
def test_one_json_file(spark, tmp_path, n):
    """The bytes are those of a file written in one piece, on a mounted folder and on a store with one writer a file."""
    head = {"stats": {"n": n, "by": {"a": 1}}, "note": 'of [ and "'}
    rows = documents(random.Random(n), n)
    df = spark.createDataFrame(rows, DDL).repartition(7) if n > 1 else spark.createDataFrame(rows, DDL)
    ordered = [tuple(r[:3]) + (r[3].asDict(),) for r in df.collect()]
    assert write_json_file(f"{tmp_path}/new/a.json", head, "documents", df) == n
    assert (tmp_path / "new/a.json").read_bytes() == expected(head, ordered) and not (tmp_path / "new/a.json.part").exists()
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    storage.register("other", _as_other)
    try:
        assert write_json_file(f"other://{tmp_path}/b.json", head, "documents", df) == n
    finally:
        del storage._OWN["other"]
    assert (tmp_path / "b.json").read_bytes() == expected(head, ordered)


def _as_other(uri):
    import pyarrow.fs

    return pyarrow.fs.LocalFileSystem(), uri.partition("://")[2]


@pytest.mark.parametrize("chunk", [64, 257, 1000, 1 << 20])
def test_json_file_read_in_splits(spark, tmp_path, chunk):
    """Chunks that begin within strings, escapes and records; other arrays and objects around; records longer than a chunk."""
    rng = random.Random(chunk)
    rows = documents(rng, 60)
    records = [dict(zip(("id", "text", "numbers", "metadata"), r)) for r in rows]
    whole = {"head": {"documents": [{"id": -1}], "x": "[{"}, "others": [{"id": -2}, [1, [2]]], "documents": [records[0], 5, [{"id": -3}], None, *records[1:]], "tail": [{"id": -4}], "documents2": [{"id": -5}]}
    for k, (text, name) in enumerate(((json.dumps(whole), "documents"), (json.dumps(whole, indent=2, ensure_ascii=False), "documents"), (json.dumps(records, indent=1), None))):
        path = tmp_path / f"{k}.json"
        path.write_text(text, encoding="utf-8")
        got = sorted(read_records(spark, str(path), DDL, name=name, chunk=chunk).collect())
        assert [(r.id, r.text, r.numbers, r.metadata.asDict()) for r in got] == [(i, t, x, m) for i, t, x, m in rows]
    assert read_records(spark, str(path), DDL, name=None, chunk=chunk).rdd.getNumPartitions() > (1 if chunk < 1000 else 0)


def test_json_files_without_records(spark, tmp_path):
    for k, text in enumerate(("", "{}", '{"documents": []}', '{"documents": {"id": 1}}', '{"x": {"documents": [{"id": 1}]}}', "[]")):
        (tmp_path / f"{k}.json").write_text(text)
        assert read_records(spark, str(tmp_path / f"{k}.json"), DDL, name="documents", chunk=16).isEmpty()
    with pytest.raises(FileNotFoundError):
        load_normalized_dataset(spark, str(tmp_path / "absent.json"))


def test_scan_of_every_state():
    """Each cut of a text gives the depth that a reader from its beginning has."""
    text = json.dumps([{"a": 'x"\\[{', "b": [1, {"c": "\\\\"}]}, "]"]).encode()
    at, step, depth, _ = _scan(text, 0)
    want = dict(zip(at.tolist(), depth.tolist()))
    for cut in range(len(text)):
        *_, before, state = _scan(text[:cut], 0)
        start = int(before[-1]) if len(before) else 0
        a, _, d, _ = _scan(text[cut:], state)
        assert {int(p) + cut: int(x) + start for p, x in zip(a, d)} == {p: x for p, x in want.items() if p >= cut}


def test_reports_with_clashing_names(spark, tmp_path):
    """The later path's text stays; no exchange of the writing plan has a text."""
    rows = [("a/x.md", "first"), ("a/x.txt", "second"), ("a/x", "third"), ("b/y.tar.gz", "y"), ("a/x.md2/z", "z")]
    texts = spark.createDataFrame(rows, "relative_path string, text string")
    paths = {r.path for r in write_texts(texts, str(tmp_path), "_parsed").collect()}
    assert {p.removeprefix(f"{tmp_path}/") for p in paths} == {"a/x_parsed.txt", "b/y.tar_parsed.txt", "a/x.md2/z_parsed.txt"}
    assert (tmp_path / "a/x_parsed.txt").read_text() == "second" and (tmp_path / "b/y.tar_parsed.txt").read_text() == "y"


def test_files_written_by_tasks(spark, tmp_path):
    rows = [("a/b.bin", b"\0\1"), ("c", b"")]
    done = write_files(spark.createDataFrame(rows, "target string, content binary"), f"{tmp_path}/tree")
    assert {(r.path.rpartition("tree/")[2], r.bytes) for r in done.collect()} == {("a/b.bin", 2), ("c", 0)}
    assert {r.relative_path: bytes(r.content) for r in read_files(spark, f"{tmp_path}/tree").collect()} == dict(rows)


def test_small_files_share_folders_and_batches(tmp_path):
    """A folder is made once, and files that are read leave a task together, up to about a megabyte."""
    import pyarrow as pa

    from docloom.sources.files import _with_contents
    from docloom.sources.storage import Store

    store, made = Store(str(tmp_path)), []
    fs, top = store.opened()

    class Counted:
        open_output_stream = fs.open_output_stream

        def create_dir(self, path, recursive):
            made.append(path)
            fs.create_dir(path, recursive=recursive)

    store._opened = (Counted(), top)
    sizes = [10] * 50 + [700_000] * 3 + [0]
    for k, size in enumerate(sizes):
        store.write(f"{top}/a/{k}", b"x" * size)
    assert made == [f"{top}/a"]
    rows = pa.RecordBatch.from_pydict({"path": [f"{top}/a/{k}" for k in range(len(sizes))], "relative": [f"a/{k}" for k in range(len(sizes))], "bytes": sizes})
    got = list(_with_contents(store, True)(iter([rows])))
    assert [b.num_rows for b in got] == [52, 2] and [len(c) for b in got for c in b.column(3).to_pylist()] == sizes
    assert [r for b in got for r in b.column(1).to_pylist()] == rows.column(1).to_pylist()
