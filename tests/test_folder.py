"""Folders as batch, stream and sink against what os.walk sees."""

import os

from quarry.sources import folder
from quarry.streaming import changes as ch


def put(root, path, data):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "wb") as f:
        f.write(data)


def test_batch_reads_hidden_names_and_balances_bytes(spark, tmp_path):
    root = f"{tmp_path}/tree"
    rows = {".hidden/a.py": b"x = 1\n", "_under/b.rs": b"fn b() {}", "c/d/e.txt": "é\n".encode(), "c/bad.bin": b"\xff\xfe", "empty.py": b"", "c d/100%.md": b"# t", "big.txt": b"x" * 5000}
    for path, data in rows.items():
        put(root, path, data)
    os.symlink(root, f"{root}/c/loop")
    for at in (root, f"file://{root}", f"{root}/"):
        got = {r.path: (r.size, r.language, r.content, r.readable) for r in folder.read_folder(spark, at, "p", max_file_size=4000).collect()}
        assert set(got) == set(rows) - {"big.txt"}
        assert got["c/bad.bin"] == (2, "other", None, False) and got["empty.py"] == (0, "python", "", True) and got["c/d/e.txt"][2] == "é\n"
    assert folder.read_folder(spark, f"{tmp_path}/none", "p").collect() == []
    sizes = [folder.Found(f"f{k:03}", s, 0) for k, s in enumerate([10, 90, 5, 300, 1] * 20)]
    parts = folder.balanced(sizes, 3 * folder.OPEN_COST)
    assert [f for p in parts for f in p.files] == sizes and max(len(p.files) for p in parts) <= 3 and folder.balanced([]) == []


def test_prefixes_list_only_their_folders(spark, tmp_path):
    for path in ("a/x.py", "a/y/z.py", "ab/x.py", "b/x.py"):
        put(tmp_path, path, b"x")
    assert [f.path for f in folder.listed(str(tmp_path), ["a/"])] == ["a/x.py", "a/y/z.py"]
    assert [f.path for f in folder.listed(str(tmp_path), ["a/y/z.py", "b"])] == ["a/y/z.py", "b/x.py"]
    for under, want in ((["a/"], ["a/x.py", "a/y/z.py"]), (["b/x.py", "none"], ["b/x.py"]), ([], []), (None, ["a/x.py", "a/y/z.py", "ab/x.py", "b/x.py"])):
        assert [r.path for r in folder.read_folder(spark, str(tmp_path), "p", under).orderBy("path").collect()] == want


def run(spark, tmp_path, max_files=100_000):
    stream = folder.watch_folder(spark, f"{tmp_path}/tree", "p", f"{tmp_path}/listings", max_files=max_files, max_file_size=1000)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    return spark.read.schema(folder.CHANGES).parquet(f"{tmp_path}/out")


def test_stream_tells_changes_and_deletions_once(spark, tmp_path):
    root = f"{tmp_path}/tree"
    for k in range(6):
        put(root, f".d/f{k}.py", b"def f(): pass")
    put(root, "big.txt", b"x" * 2000)
    assert sorted((r.path, r.op, r.size, r.content is None) for r in run(spark, tmp_path).collect()) == [(f".d/f{k}.py", "change", 13, False) for k in range(6)] + [("big.txt", "change", 2000, True)]
    assert run(spark, tmp_path).count() == 7  # nothing new
    os.remove(f"{root}/.d/f0.py")
    put(root, ".d/f1.py", b"def g(): pass # longer")
    put(root, "new.py", b"x")
    os.utime(f"{root}/new.py", (1, 1))  # moved in with an old time
    got = sorted((r.path, r.op, r.content) for r in run(spark, tmp_path).collect())
    assert len(got) == 10 and {x for x in got if x[1] == "delete"} == {(".d/f0.py", "delete", None)}
    assert (".d/f1.py", "change", "def g(): pass # longer") in got and ("new.py", "change", "x") in got
    assert len(os.listdir(f"{tmp_path}/listings")) <= 2
    # a batch planned again has the same files, whatever came since
    source = folder.FolderStream(root, "p", f"{tmp_path}/again", 1000, folder.PARTITION_BYTES, 4)
    first, second, third = source.latestOffset(), source.latestOffset(), source.latestOffset()
    plan = [[f.path for p in source.partitions(a, b) for f in p.files] for a, b in (({"listing": 0}, first), (first, second))]
    assert len(plan[0]) == 4 and len(plan[1]) == 3 and third == second
    put(root, "later.py", b"x")
    assert [f.path for p in source.partitions({"listing": 0}, first) for f in p.files] == plan[0]


def test_folder_keeps_an_index_fresh(spark, tmp_path):
    root, index = f"{tmp_path}/tree", ch.Index(spark, f"{tmp_path}/index")
    put(root, "a.py", b"def a(): pass")
    put(root, "b.py", b"def b(): pass")
    for n in range(2):
        stream = folder.watch_folder(spark, root, "p", f"{tmp_path}/listings")
        ch.maintain_index(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination(120)
        assert {r["name"] for r in index.symbols().collect()} == [{"a", "b"}, {"b2"}][n]
        os.path.exists(f"{root}/a.py") and os.remove(f"{root}/a.py")
        put(root, "b.py", b"def b2(): return 1")


def test_sink_round_trip(spark, tmp_path):
    rows = [(".x/_a.py", "é"), ("b.py", ""), ("c/d.py", "x\r\n"), ("none.py", None)]
    folder.write_folder(spark.createDataFrame(rows, "path string, content string").repartition(3), f"{tmp_path}/out")
    assert {(r.path, r.content) for r in folder.read_folder(spark, f"{tmp_path}/out", "p").collect()} == set(rows[:3])
    folder.delete_files(spark.createDataFrame([("b.py",), ("never.py",)], "path string"), f"{tmp_path}/out")
    assert {r.path for r in folder.read_folder(spark, f"{tmp_path}/out", "p").collect()} == {".x/_a.py", "c/d.py"}
    assert not [f for _, _, fs in os.walk(f"{tmp_path}/out") for f in fs if f.startswith(".part-")]


def test_a_run_tells_all_changes_of_a_large_folder(tmp_path):
    os.makedirs(f"{tmp_path}/tree")
    for k in range(100_050):
        os.close(os.open(f"{tmp_path}/tree/{k}", os.O_CREAT))
    stream = folder.FolderSource({"path": f"{tmp_path}/tree", "listings": f"{tmp_path}/listings"}).streamReader(None)
    assert sum(len(p.files) for p in stream.partitions(stream.initialOffset(), stream.latestOffset())) == 100_050
    few = folder.FolderSource({"path": f"{tmp_path}/tree", "listings": f"{tmp_path}/few", "max_files": "70"}).streamReader(None)
    assert [sum(len(p.files) for p in few.partitions({"listing": k}, few.latestOffset())) for k in range(2)] == [70, 70]


def test_the_driver_holds_no_listing_of_a_watched_folder(tmp_path, monkeypatch):
    import tracemalloc

    n, cut = 60_000, [0]

    def tree(root):
        # In no order, as a file system gives them; the second listing lacks some files and has others changed.
        for k in range(n):
            at = k * 7919 % n
            if not cut[0] or at % 1000:
                yield folder.Found(f"src/{at:07}.py", 10 + (cut[0] and at % 1000 == 7), 5)

    monkeypatch.setattr(folder, "walked", tree)
    monkeypatch.setattr(folder, "SORTED", 5_000)
    monkeypatch.setattr(folder, "GROUP", 5_000)
    source = folder.FolderStream(str(tmp_path / "tree"), "p", str(tmp_path / "listings"), 1000, folder.PARTITION_BYTES, None)
    tracemalloc.start()
    first = source.latestOffset()
    parts = source.partitions({"listing": 0}, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20, peak  # the listing alone is more than that as objects
    assert sum(len(p.files) for p in parts) == n and max(len(p.files) for p in parts) <= folder.PARTITION_BYTES // folder.OPEN_COST
    cut[0] = 1
    second = source.latestOffset()
    got = [f for p in source.partitions(first, second) for f in p.files]
    assert [(f.path, f.op, f.size) for f in got] == sorted([(f"src/{k:07}.py", "delete", 0) for k in range(0, n, 1000)] + [(f"src/{k:07}.py", "change", 11) for k in range(7, n, 1000)])
    assert source.latestOffset() == second
