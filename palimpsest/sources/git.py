"""Histories of git repositories as tables: tags, changed lines, trees, blobs.

The git program is asked on the driver for names only (tags, trees, numstat: one line for a tag or file); contents are
read by blob hash on executors, each distinct blob once, so unchanged files of many snapshots cost nothing more. The
repository must be on a path that all executors see. Nothing is ever checked out.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "repo string, tag_ord int, tag_name string, commit_hash string, commit_date timestamp, date_text string"
NUMSTAT = "repo string, from_commit string, to_commit string, added string, deleted string, path string"
TREE = "repo string, commit_hash string, path string, blob_sha string"


def git(path: str, *args: str) -> str:
    return subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def clone(url: str, target: str, action: str = "skip", tries: int = 3) -> str:
    """The repository at target: cloned, or if it is there used as it is ("skip") or pulled ("update")."""
    if (Path(target) / ".git").exists():
        if action == "update":
            git(target, "pull", "--ff-only")
        return target
    if Path(target).exists() and any(Path(target).iterdir()):
        raise FileExistsError(f"{target} isn't a repository and isn't empty")
    for k in range(tries):
        if not subprocess.run(["git", "clone", "-q", url, target]).returncode:
            return target
        if k + 1 == tries:
            raise RuntimeError(f"can't clone {url}")
    return target


def has_commits(path: str) -> bool:
    try:
        return bool(git(path, "rev-parse", "-q", "--verify", "HEAD").strip())
    except (subprocess.CalledProcessError, OSError):
        return False


def repository_urls(spark: SparkSession, path: str) -> DataFrame:
    """A list of repositories, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def tags(spark: SparkSession, repo: str, path: str) -> DataFrame:
    """Tags with the commit that each stands for; those of other objects are left out."""
    form = "%(refname:short)%09%(objecttype)%09%(objectname)%09%(*objecttype)%09%(*objectname)"
    rows = []
    for k, line in enumerate(git(path, "for-each-ref", "refs/tags", f"--format={form}").splitlines()):
        name, kind, own, peeled_kind, peeled = line.split("\t")
        commit = own if kind == "commit" else peeled if peeled_kind == "commit" else None
        if commit:
            rows.append((repo, k, name, commit, git(path, "show", "-s", "--format=%cI", commit).strip()))
    df = spark.createDataFrame(rows, "repo string, tag_ord int, tag_name string, commit_hash string, date_text string")
    return df.withColumn("commit_date", F.to_timestamp("date_text")).select("repo", "tag_ord", "tag_name", "commit_hash", "commit_date", "date_text")


def numstat(spark: SparkSession, repo: str, path: str, pairs: list[tuple[str, str]]) -> DataFrame:
    rows = [(repo, a, b, *line.split("\t", 2)) for a, b in pairs for line in git(path, "diff", "--numstat", a, b).splitlines() if line.count("\t") >= 2]
    return spark.createDataFrame(rows, NUMSTAT)


def changed_paths(path: str, a: str, b: str) -> list[str]:
    """Paths on either side of the changes between two commits."""
    out = set()
    for line in git(path, "diff", "--name-status", a, b).splitlines():
        out.update(line.split("\t")[1:])
    return sorted(out)


def trees(spark: SparkSession, repo: str, path: str, commits: list[str]) -> DataFrame:
    rows = []
    for c in commits:
        for line in git(path, "ls-tree", "-r", c).splitlines():
            meta, name = line.split("\t", 1)
            mode, kind, sha = meta.split()
            if kind == "blob":
                rows.append((repo, c, name, sha))
    return spark.createDataFrame(rows, TREE)


def blobs(tree: DataFrame, path: str) -> DataFrame:
    """blob_sha, content of each distinct blob of a tree; one reading process for each partition."""

    def read(batches) -> Iterator:
        import pandas as pd

        own = subprocess.Popen(["git", "-C", path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for batch in batches:
                out = []
                for sha in batch["blob_sha"]:
                    own.stdin.write(f"{sha}\n".encode())
                    own.stdin.flush()
                    head = own.stdout.readline().split()
                    if len(head) == 3:
                        out.append((sha, own.stdout.read(int(head[2]))))
                        own.stdout.read(1)
                yield pd.DataFrame(out, columns=["blob_sha", "content"])
        finally:
            own.stdin.close()
            own.wait()

    return tree.select("blob_sha").distinct().mapInPandas(read, "blob_sha string, content binary")


def files_at(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """tree with texts; bytes that aren't UTF-8 are left out of them."""
    return tree.join(contents, "blob_sha").withColumn("text", F.decode("content", "UTF-8"))
