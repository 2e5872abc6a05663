"""Folder plans against a plain walk."""

import os
import random

import pytest

from lakescreen.sources import extract, folders


def plain(root, deep, most):
    """Relative paths that a depth-first walk gives, and whether it left one out."""
    out, todo = [], [(str(root), 0)]
    while todo:
        folder, depth = todo.pop()
        names = sorted(os.listdir(folder), key=str.lower)
        full = [os.path.join(folder, n) for n in names]
        out += [os.path.relpath(p, root) for p in full if os.path.isfile(p) and os.path.splitext(p)[1].lower() in extract.SUFFIXES]
        inner = [p for p in full if os.path.isdir(p) and not os.path.islink(p) and not os.path.basename(p).startswith(".") and os.path.basename(p).lower() not in {e.lower() for e in extract.EXCLUDED}]
        if depth < deep:
            todo += [(p, depth + 1) for p in reversed(inner)]
    return sorted(out[:most], key=str.lower), len(out) > most


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    rng, root = random.Random(6), tmp_path_factory.mktemp("tree")
    made = [root]
    for k in range(90):
        folder = rng.choice(made) / rng.choice([f"d{k}", f"D{k}", f"x {k}", ".hidden", "node_modules", "LIBRARY", "AppData", f"é{k}"])
        folder.mkdir(exist_ok=True)
        made.append(folder)
        for n in range(rng.randrange(4)):
            (folder / f"{rng.choice('abAB')}{k}{n}{rng.choice(['.txt', '.PDF', '.exe', '', '.md'])}").write_text("x" * n)
    (root / "link").symlink_to(made[5])
    (root / "linked.txt").symlink_to(next(p for p in root.rglob("*.md")))
    (root / "gone.txt").symlink_to(root / "absent")
    return root


@pytest.mark.parametrize(("deep", "most"), [(0, 500), (1, 500), (2, 7), (50, 1), (50, 20), (50, 10_000)])
def test_a_plan_equals_a_walk(spark, tree, deep, most):
    plan = extract.folder_plan(spark, str(tree), recursive=True, max_files=most, max_depth=deep)
    paths, cut = plain(tree, deep, most)
    rows = plan.collect()
    assert [r.relative_path for r in rows] == paths and {r.truncated for r in rows} == {cut}
    assert all(r.path == f"file:{tree}/{r.relative_path}" and r.file_size == os.stat(tree / r.relative_path).st_size for r in rows)
    told = extract.plan_summary(plan).first()
    assert (told.n_files, told.truncated, told.samples) == (len(paths), cut, paths[:10])


def test_as_many_files_as_may_be_are_not_cut(spark, tree):
    n = len(plain(tree, 50, 10_000)[0])
    for most, cut in ((n - 1, True), (n, False)):
        assert extract.plan_summary(extract.folder_plan(spark, f"file://{tree}", recursive=True, max_files=most, max_depth=50)).first().truncated is cut
    flat = extract.folder_plan(spark, str(tree)).collect()
    assert [r.relative_path for r in flat] == plain(tree, 0, 500)[0] and "linked.txt" in {r.relative_path for r in flat}


def test_sub_folders_are_partitions(tree):
    reader = folders.FolderReader({"path": str(tree), "depth": "50", "most": "9999", "excluded": "x", "suffixes": ".txt/.md/.pdf"})
    parts = reader.partitions()
    seen = [row[1] for p in parts for row in reader.read(p)]
    assert len(parts) > 10 and len(seen) == len(set(seen)) and folders.PARTITIONS <= 64
    with pytest.raises(KeyError):
        folders.FolderReader({})
