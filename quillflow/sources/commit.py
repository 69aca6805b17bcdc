"""Git: a hook for targets in a working tree that commits what has changed, a source of a ref's files, and a target that commits."""

from __future__ import annotations

import os
import subprocess
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillflow import fs
from quillflow.sources.files import FolderSource, FolderTarget
from quillflow.sources.registry import Registry, Stream, Target


class GitMissing(RuntimeError):
    """There is no git program."""


def exec_git(folder: str, *args: str) -> tuple[int, str, str]:
    """(exit code, output, errors) of git in the folder."""
    try:
        done = subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, check=False)
    except FileNotFoundError as e:
        raise GitMissing("git was not found") from e
    return done.returncode, done.stdout, done.stderr


def auto_commit(folder: str, message: str = "Update pipeline output") -> str | None:
    """Commit all changes; the new commit's id, or None if nothing has changed."""
    for args in (("add", "-A"), ("diff", "--cached", "--quiet")):
        code, _, errors = exec_git(folder, *args)
        if args[0] == "add" and code:
            raise RuntimeError(f"git add failed: {errors}")
    if code == 0:
        return None
    code, _, errors = exec_git(folder, "commit", "-m", message)
    if code:
        raise RuntimeError(f"git commit failed: {errors}")
    return exec_git(folder, "rev-parse", "HEAD")[1].strip()


@dataclass
class CommitOnClose:
    """``?commit=on-close`` on a target: one commit on the driver once all of the write has succeeded."""

    target: Target
    folder: str = "."

    def write(self, df: DataFrame) -> None:
        self.target.write(df)
        auto_commit(self.folder)


@dataclass
class GitSource:
    """``git://folder?ref=&glob=``: the files of a repository at a ref, from a worktree of its own beside it.

    The worktree (``<folder>.worktrees/<commit>``) is made once for a commit and must lie
    where the executors see it.
    """

    folder: str
    ref: str = "HEAD"
    glob: str | None = None
    lifecycle: str = "resumable"

    def worktree(self) -> str:
        code, commit, errors = exec_git(self.folder, "rev-parse", "--verify", f"{self.ref}^{{commit}}")
        if code:
            raise LookupError(f"no ref {self.ref!r}: {errors.strip()}")
        place = f"{os.path.abspath(self.folder)}.worktrees/{commit.strip()}"
        if not os.path.isdir(place):
            code, _, errors = exec_git(self.folder, "worktree", "add", "--detach", place, commit.strip())
            if code:
                raise RuntimeError(f"git worktree failed: {errors}")
        return place

    def read(self, spark: SparkSession) -> Stream:
        return FolderSource(f"file://{self.worktree()}", self.glob).read(spark)


@dataclass
class GitTarget:
    """``git://folder?path=out``: items as text in a new folder of a repository, moved there when they are all written, then committed."""

    folder: str
    path: str = "output"

    def write(self, df: DataFrame) -> None:
        place = f"file://{os.path.abspath(self.folder)}/{self.path}/{uuid.uuid4().hex}"
        temp = f"file://{os.path.abspath(self.folder)}.worktrees/new-{uuid.uuid4().hex}"
        FolderTarget(temp).write(df)
        fs.make_folder(df.sparkSession, place.rsplit("/", 1)[0])
        fs.rename(df.sparkSession, temp, place)
        auto_commit(self.folder)


def register_git(registry: Registry) -> None:
    registry.register_source("git", lambda u: GitSource(u.file_path(), u.query.get("ref", "HEAD"), u.query.get("glob")))
    registry.register_target("git", lambda u: GitTarget(u.file_path(), u.query.get("path", "output")))
