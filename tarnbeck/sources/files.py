"""A file listing as a Spark data source, and the filters of the two scans."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from tarnbeck.functions import text as tx

# Extensions that are indexed, and folders that never are.
PLAIN = (".txt", ".md", ".markdown", ".rst", ".org", ".tex", ".log", ".csv", ".tsv", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env.example", ".html", ".htm", ".xml", ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".svelte", ".java", ".kt", ".c", ".h", ".cpp", ".hpp", ".cc", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".scala", ".lua", ".r", ".jl", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".sql")
RICH = (".pdf", ".docx")
SKIPPED = ("node_modules", ".git", ".svn", ".hg", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "out", "target", ".next", ".nuxt", ".cache", ".gradle", ".idea", ".vs", "$RECYCLE.BIN", "System Volume Information", "AppData")
LARGEST, LARGEST_PDF = 20 << 20, 100 << 20


class FileListing(DataSource):
    """``spark.read.format("file_listing").option("roots", "a;b")``: (root_no, path, mtime_ns, size) of regular files.

    Unlike Spark's own listing it keeps hidden and empty files and nanosecond
    times. Skipped and hidden folders are pruned before descent unless
    ``prune`` is false. Folders directly under a root are listed in parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "root_no int, path string, mtime_ns long, size long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("roots", ""), self.options.get("prune", "true").lower() != "false")


class _Reader(DataSourceReader):
    def __init__(self, roots: str, prune: bool) -> None:
        self.roots, self.prune = [r for r in roots.split(";") if r], prune

    def _open(self, name: str) -> bool:
        return not self.prune or (name not in SKIPPED and not name.startswith("."))

    def partitions(self) -> list[InputPartition]:
        out = []
        for no, root in enumerate(self.roots):
            if not os.path.isdir(root):
                continue
            out.append(InputPartition((no, root, False)))
            out += [InputPartition((no, e.path, True)) for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and self._open(e.name)]
        return out or [InputPartition((0, "", False))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        no, top, deep = partition.value
        for folder, inner, names in os.walk(top) if top else ():
            inner[:] = [d for d in inner if self._open(d)] if deep else []
            for name in names:
                path = os.path.join(folder, name)
                try:
                    st = os.stat(path)
                except OSError:
                    continue
                yield no, path, st.st_mtime_ns, st.st_size


def indexable(path: Column, size: Column) -> Column:
    """Known extension and 0 < size <= 20 MB, for PDF 100 MB."""
    ext = tx.suffix(path)
    return ext.isin(*PLAIN, *RICH) & (size > 0) & (size <= F.when(ext == ".pdf", LARGEST_PDF).otherwise(LARGEST))


def visible(path: Column, files_too: bool) -> Column:
    """No folder (with ``files_too`` no component) of the path is skipped or hidden."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    if not files_too:
        parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))


def scanned(listing: DataFrame) -> DataFrame:
    """(path, mtime_ns, size) to index: the first of the paths that are equal up to case, by ``root_no`` and path."""
    rows = listing.where(F.col("path").isNotNull() & indexable(F.col("path"), F.col("size")) & visible(F.col("path"), False))
    one = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("root_no", "path", F.desc("mtime_ns"), "size"))
    return rows.withColumn("r", one).where("r = 1").select("path", "mtime_ns", "size")


def walked(listing: DataFrame) -> DataFrame:
    """Files of any kind for the tidy-up plans: no hidden or skipped component, the file's name included."""
    return listing.where(F.col("path").isNotNull() & visible(F.col("path"), True))


def register(spark) -> None:
    spark.dataSource.register(FileListing)
