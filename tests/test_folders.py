import pytest
from pyspark.sql import functions as F

from shutterlake.sources import folders as FO
from shutterlake.sources import listing


@pytest.fixture
def root(tmp_path):
    for name, data in {
        "a/x.jpg": b"1234", "a/empty.jpg": b"", "a/Unknown/.keep": b"", "b/Unknown/p.png": b"5", "b/c/d/e.mp4": b"67",
        "skipped/deep/y.jpg": b"8", "b/.thumbs/z.jpg": b"9",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / "c" / "Unknown").mkdir(parents=True)
    (tmp_path / "hollow").mkdir()
    return tmp_path


@pytest.mark.parametrize("subtrees", [1, 3, 64])
def test_empty_files_and_folders_are_listed(spark, root, subtrees):
    tree = FO.folder_tree(spark, str(root), subtrees=subtrees)
    got = {(r.path, r.kind, r.length, r.children) for r in tree.collect()}
    want = set()
    for p in [root, *root.rglob("*")]:
        want.add((str(p), "folder", None, len(list(p.iterdir()))) if p.is_dir() else (str(p), "file", p.stat().st_size, None))
    assert got == want and tree.count() == len(want)
    unknown = {r.path: r.is_empty for r in FO.empty_folders(tree).collect()}
    assert unknown == {str(root / "a/Unknown"): False, str(root / "b/Unknown"): False, str(root / "c/Unknown"): True}
    images = listing.select_media(FO.tree_files(tree), listing.INDEX_EXTENSIONS)
    assert {r.path for r in images.where("length = 0").collect()} == {str(root / "a/empty.jpg")}


def test_skipped_subtrees_are_never_opened(spark, root):
    (root / "skipped" / "deep").chmod(0)
    opened = []

    class Spy(FO.FolderReader):
        def _open(self, system, folder):
            opened.append(folder)
            return super()._open(system, folder)

    options = {"path": str(root), "skip": str(root / "skipped"), "skipNames": ".thumbs", "subtrees": "2"}
    reader = Spy(options)
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert not [f for f in opened if f.startswith(str(root / "skipped")) or f.endswith(".thumbs")]
    assert len(opened) == len(set(opened)) and str(root / "b/c/d") in opened
    got = FO.folder_tree(spark, str(root), [str(root / "skipped")], [".thumbs"], 2)
    assert sorted(r["path"] for r in rows) == sorted(r.path for r in got.collect())
    assert got.where(F.col("path").contains("thumbs") | F.col("path").endswith("/y.jpg")).isEmpty()


def test_a_uri_and_an_empty_root(spark, tmp_path):
    (tmp_path / "only").mkdir()
    assert [r.children for r in FO.folder_tree(spark, f"file://{tmp_path}/only").collect()] == [0]
