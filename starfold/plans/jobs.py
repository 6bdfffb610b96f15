"""State of batch jobs, in a small database of the driver: rows change only from the status that is expected."""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TABLES = """
CREATE TABLE IF NOT EXISTS jobs (job_id TEXT PRIMARY KEY, status TEXT NOT NULL, settings TEXT NOT NULL, created REAL NOT NULL);
CREATE TABLE IF NOT EXISTS tasks (task_id TEXT PRIMARY KEY, job_id TEXT NOT NULL REFERENCES jobs, target TEXT NOT NULL, status TEXT NOT NULL, cache_key TEXT, error TEXT, created REAL NOT NULL);
CREATE INDEX IF NOT EXISTS tasks_by_job ON tasks (job_id, status, created, task_id);
CREATE TABLE IF NOT EXISTS cache (cache_key TEXT PRIMARY KEY, result TEXT NOT NULL, created REAL NOT NULL);
"""


def cache_key(checksum: Column, settings: Column, model: Column, schema: Column) -> Column:
    return F.sha2(F.concat_ws(":", checksum, settings, model, schema), 256)


def without_cached(tasks: DataFrame, cached: DataFrame) -> DataFrame:
    return tasks.join(cached.select("cache_key").distinct(), "cache_key", "left_anti")


class Jobs:
    def __init__(self, path: str):
        self.db = sqlite3.connect(path)
        self.db.executescript(_TABLES)

    def create(self, job: str, targets: Iterable[str], settings: str = "{}") -> None:
        now = time.time()
        with self.db:
            self.db.execute("INSERT INTO jobs VALUES (?, 'pending', ?, ?)", (job, settings, now))
            self.db.executemany("INSERT INTO tasks VALUES (?, ?, ?, 'pending', NULL, NULL, ?)", ((f"{job}:{t}", job, t, now) for t in targets))

    def move_job(self, job: str, before: str, after: str) -> bool:
        with self.db:
            return self.db.execute("UPDATE jobs SET status = ? WHERE job_id = ? AND status = ?", (after, job, before)).rowcount == 1

    def finish(self, task: str, error: str | None = None) -> bool:
        """At most once: a task that isn't open stays as it is."""
        with self.db:
            return self.db.execute("UPDATE tasks SET status = ?, error = ? WHERE task_id = ? AND status IN ('pending', 'running')", ("failed" if error else "completed", error, task)).rowcount == 1

    def start(self, task: str) -> bool:
        with self.db:
            return self.db.execute("UPDATE tasks SET status = 'running' WHERE task_id = ? AND status = 'pending'", (task,)).rowcount == 1

    def reset_interrupted(self, job: str) -> int:
        with self.db:
            return self.db.execute("UPDATE tasks SET status = 'pending' WHERE job_id = ? AND status = 'running'", (job,)).rowcount

    def retry_failed(self, job: str) -> int:
        with self.db:
            n = self.db.execute("UPDATE tasks SET status = 'pending', error = NULL WHERE job_id = ? AND status = 'failed'", (job,)).rowcount
            self.db.execute("UPDATE jobs SET status = 'paused' WHERE job_id = ? AND ? > 0", (job, n))
            return n

    def page(self, job: str, limit: int, offset: int = 0) -> list[tuple[str, str]]:
        if not 1 <= limit <= 1000:
            raise ValueError("limit must lie from 1 to 1000")
        return self.db.execute("SELECT task_id, status FROM tasks WHERE job_id = ? ORDER BY created, task_id LIMIT ? OFFSET ?", (job, limit, offset)).fetchall()

    def progress(self, job: str) -> dict[str, int]:
        """Counts are taken from the tasks, never stored."""
        return dict(self.db.execute("SELECT status, count(*) FROM tasks WHERE job_id = ? GROUP BY status", (job,)).fetchall())

    def put(self, key: str, result: str) -> None:
        with self.db:
            self.db.execute("INSERT OR REPLACE INTO cache VALUES (?, ?, ?)", (key, result, time.time()))

    def get(self, key: str) -> str | None:
        row = self.db.execute("SELECT result FROM cache WHERE cache_key = ?", (key,)).fetchone()
        return row[0] if row else None
