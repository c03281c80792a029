import os
import random
import shutil
import subprocess

import pytest

from tidemark.sources.revisions import Repository, read_revisions

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no git")


def git(at, *args, when=0):
    env = os.environ | {k: v for who in ("AUTHOR", "COMMITTER") for k, v in ((f"GIT_{who}_NAME", "n"), (f"GIT_{who}_EMAIL", "e@x"), (f"GIT_{who}_DATE", f"{1_700_000_000 + when} +0100"))}
    return subprocess.run(["git", "-c", "init.defaultBranch=main", "-C", str(at), *args], check=True, capture_output=True, env=env | {"GIT_CONFIG_GLOBAL": "/dev/null"}).stdout


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    at, draw = tmp_path_factory.mktemp("repository"), random.Random(1)
    git(at, "init", "-q")
    (at / "data/deep").mkdir(parents=True)
    lines = [f"{k},{draw.random()}" for k in range(3000)]
    for step in range(30):
        lines[draw.randrange(3000)] = f"changed {step}"
        if step % 3:
            (at / "data/deep/rows.csv").write_text("\n".join(lines))
        (at / "other.txt").write_text(str(step))
        if step == 20:
            (at / "data/deep/rows.csv").unlink()
        git(at, "add", "-A"), git(at, "commit", "-q", "-m", f"step {step}\n\ntree of text", when=step * 60)
        if step == 10:
            git(at, "branch", "side")
        if step == 14:
            git(at, "gc", "-q")  # older objects are packed as deltas, later ones stay loose
    git(at, "checkout", "-q", "side")
    (at / "side.csv").write_text("side")
    git(at, "add", "-A"), git(at, "commit", "-q", "-m", "side", when=5000)
    git(at, "checkout", "-q", "main"), git(at, "merge", "-q", "--no-ff", "-m", "merge", "side", when=6000), git(at, "tag", "-a", "-m", "t", "v1")
    return at


@pytest.mark.parametrize("packed", [False, True])
def test_revisions_are_those_that_the_tool_lists(spark, repository, packed):
    if packed:
        git(repository, "gc", "-q", "--aggressive"), git(repository, "pack-refs", "--all")
    paths = ["data/deep/rows.csv", "side.csv", "none.csv"]
    got = read_revisions(spark, f"file:{repository}", paths, task_commits=7)
    assert got.rdd.getNumPartitions() > 3
    rows = {(r.path, r.revision): r for r in got.collect()}
    expected = {(p, rev) for p in paths for rev in git(repository, "log", "--full-history", "--no-merges", "--format=%H", "--", p).decode().split()}
    assert rows.keys() == expected and len([p for p, _ in rows if p == paths[0]]) > 15
    for (path, revision), r in rows.items():
        try:
            content = git(repository, "show", f"{revision}:{path}")
        except subprocess.CalledProcessError:
            content = None
        assert (None if r.content is None else bytes(r.content)) == content
        assert r.committed == int(git(repository, "show", "-s", "--format=%ct", revision))
    assert sum(r.content is None for r in rows.values()) == 1


def test_refs_tags_and_missing_objects(repository):
    found = Repository(str(repository))
    head = git(repository, "rev-parse", "HEAD").decode().strip()
    assert found.resolve("HEAD") == found.resolve("main") == found.resolve("v1") == head and found.resolve("side") != head
    order = [n for n, _, _ in found.commits(head)]
    assert len(order) == 32 and all(order.index(p) < order.index(n) for n, parents, _ in found.commits(head) for p in parents)
    with pytest.raises(ValueError, match="lacks the object"):
        found.read("0" * 40)
    with pytest.raises(ValueError, match="no commit is named"):
        found.resolve("nowhere")
