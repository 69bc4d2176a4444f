"""Files under several names are taken once; roots of repositories are found at ingest."""

import json
import os

import pytest

from threadloom.sources import places
from threadloom.streaming import ingest


def log(path, session, cwd):
    said = {"sessionId": session, "cwd": str(cwd), "type": "user", "timestamp": "2026-06-01T10:00:00Z", "message": {"role": "user", "content": f"in {session}"}}
    path.write_text(json.dumps(said) + "\n")


def repository(path):
    (path / ".git").mkdir(parents=True)
    return path


def test_links_are_one_file(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name in ("b", "c", "d"):
        log(folder / f"{name}.jsonl", name, "/w")
    os.link(folder / "b.jsonl", folder / "a.jsonl")
    os.symlink(folder / "c.jsonl", folder / "z.jsonl")
    found = ingest.discover(spark, "claude", str(folder))
    assert sorted(os.path.basename(r.source_path) for r in found.collect()) == ["a.jsonl", "c.jsonl", "d.jsonl"]
    store = str(tmp_path / "store")
    assert ingest.refresh(spark, {"claude": str(folder)}, store)["new"] == 3
    assert sorted(r.content for r in ingest.stored(spark, store, "messages").collect()) == ["in b", "in c", "in d"]
    # equal texts in two files of their own are two sources
    log(folder / "e.jsonl", "d", "/w")
    assert ingest.discover(spark, "claude", str(folder)).count() == 4
    assert ingest.discover(spark, "claude", str(folder)).columns == ["provider", "source_path", "mtime", "size_bytes", "parse_version"]


def test_unique_sources_by_provider_and_edges(spark):
    rows = [("p", "/gone/x", 1), ("q", "/gone/x", 2), ("p", None, 3), ("p", "s3://b/k", 4), ("p", "/gone/x", 5)]
    df = spark.createDataFrame(rows, "provider string, source_path string, n int")
    assert {(r.provider, r.source_path) for r in places.unique_sources(df).collect()} == {(p, s) for p, s, _ in rows}
    assert places.unique_sources(df.limit(0)).collect() == []


def test_roots_are_found(spark, tmp_path):
    outer = repository(tmp_path / "outer")
    inner = repository(outer / "libs" / "inner")
    tree = tmp_path / "tree"
    tree.mkdir()
    (outer / ".git" / "worktrees" / "tree").mkdir(parents=True)
    (tree / ".git").write_text(f"gitdir: {outer}/.git/worktrees/tree\n")
    module = outer / "module"
    module.mkdir()
    (module / ".git").write_text("gitdir: ../.git/modules/module\n")
    cases = {"deep": (inner / "src" / "x", inner), "own": (outer, outer), "tree": (tree / "src", outer), "module": (module, module), "none": (tmp_path / "free", None)}
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    for name, (cwd, _) in cases.items():
        log(folder / f"{name}.jsonl", name, cwd)
    ingest.refresh(spark, {"claude": str(folder)}, store, repos="found")
    got = {r.provider_session_id: r.repo_root for r in ingest.stored(spark, store, "sessions").collect()}
    assert got == {k: str(root) if root else None for k, (_, root) in cases.items()}
    with pytest.raises(ValueError):
        ingest.refresh(spark, {"claude": str(folder)}, store, full=True, repos="guess")
