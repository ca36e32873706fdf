"""Plans for tidying files. They are rows to look at; nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.functions import text as tx
from tarnbeck.lineage import Stages

# The category of an extension; a first match wins, everything else is Other.
CATEGORIES = {
    "Documents": (".pdf", ".docx", ".doc", ".txt", ".md", ".rtf", ".odt", ".tex"),
    "Spreadsheets": (".xlsx", ".xls", ".csv", ".tsv", ".ods"),
    "Presentations": (".pptx", ".ppt", ".key", ".odp"),
    "Images": (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".heic", ".bmp", ".tiff"),
    "Audio": (".mp3", ".wav", ".flac", ".m4a", ".ogg", ".aac"),
    "Video": (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v"),
    "Archives": (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz"),
    "Code": (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".c", ".cpp", ".cs", ".go", ".rs", ".rb", ".php", ".sh", ".ps1", ".sql", ".html", ".css", ".json", ".yaml", ".yml"),
    "Installers": (".exe", ".msi", ".dmg", ".pkg", ".deb", ".rpm", ".appimage"),
}


def digests(files: DataFrame) -> DataFrame:
    """(size, hash, path, mtime) of files (path, mtime, size, content) that aren't empty. Hashed next to the scan: no content is shuffled."""
    return files.where("size > 0").select("size", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "path", "mtime")


def duplicates(digests: DataFrame) -> DataFrame:
    """(size, hash, keep, n_copies, wasted): groups of files with equal content. ``keep`` is the oldest file, ties by path."""
    groups = digests.groupBy("size", "hash").agg(F.min_by("path", F.struct(F.coalesce("mtime", F.timestamp_micros(F.lit(1 << 60))), "path")).alias("keep"), F.count("*").alias("n_copies"))
    return groups.where("n_copies > 1").withColumn("wasted", F.col("size") * (F.col("n_copies") - 1))


def trash_plan(files: DataFrame) -> DataFrame:
    """(kind, src, reason): every copy but the kept one. Digests are written once and read for groups and for copies."""
    hashed = Stages(files.sparkSession, "digests").keep(digests(files))
    extra = hashed.select("size", "hash", F.col("path").alias("src")).join(duplicates(hashed).select("size", "hash", "keep"), ["size", "hash"]).where("src <> keep")
    return extra.select(F.lit("trash").alias("kind"), "src", F.concat(F.lit("exact duplicate of "), tx.base_name(F.col("keep")), F.lit(" (kept oldest copy)")).alias("reason"))


def category(path: Column) -> Column:
    ext = tx.suffix(path)
    out = None
    for name, exts in CATEGORIES.items():
        out = (out.when if out is not None else F.when)(ext.isin(*exts), F.lit(name))
    return out.otherwise("Other")


def move_plan(files: DataFrame, strategy: str) -> DataFrame:
    """(src, dest, reason): files of each folder by kind (``by-type``) or by month in UTC (``by-date``), hidden ones left alone.

    ``files`` (path, mtime). Files already in place, and by date those without a time, don't move.
    """
    if strategy not in ("by-type", "by-date"):
        raise ValueError("strategy must be by-type or by-date")
    target = category(F.col("path")) if strategy == "by-type" else F.date_format("mtime", "yyyy-MM")
    folder, name = F.regexp_extract("path", "^(.*/)[^/]*$", 1), tx.base_name(F.col("path"))
    rows = files.where(F.col("path").isNotNull() & ~name.startswith(".") & (name != "")).select("path", folder.alias("folder"), name.alias("name"), target.alias("target"))
    rows = rows.where(F.col("target").isNotNull() & (tx.parent_name(F.col("path")) != F.col("target")))
    return rows.select(F.col("path").alias("src"), F.concat("folder", "target", F.lit("/"), "name").alias("dest"), F.concat(F.lit(f"{strategy}: "), "target", F.lit("/")).alias("reason"))


def checked(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """The plan with ``problem``: no such source, destination taken by a file or by another operation, else null."""
    files = existing.select("path").distinct()
    known = files.select(F.col("path").alias("src"), F.lit(True).alias("there"))
    taken = files.select(F.col("path").alias("dest"), F.lit(True).alias("taken"))
    twice = plan.where("dest is not null").groupBy("dest").agg(F.count("*").alias("n_dest"))
    joined = plan.join(known, "src", "left").join(taken, "dest", "left").join(twice, "dest", "left")
    problem = F.when(F.col("there").isNull(), "source missing").when(F.col("taken"), "destination exists").when(F.col("n_dest") > 1, "destination shared")
    return joined.select("src", "dest", problem.alias("problem"))


def outcome(results: DataFrame) -> DataFrame:
    """How many operations have no problem, of how many."""
    return results.agg(F.count_if(F.col("problem").isNull()).alias("ok"), F.count("*").alias("total"))


def selected(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """The operations of a plan whose source was ticked (``chosen``: src)."""
    return plan.join(chosen.select("src").distinct(), "src", "left_semi")


def rename_candidates(files: DataFrame, most: int = 50) -> DataFrame:
    """The first files of each folder by path (folder, path), as many as one request for new names takes."""
    rows = files.where("path is not null").select("path", F.regexp_extract("path", "^(.*/)[^/]*$", 1).alias("folder")).distinct()
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).where(F.col("r") <= most).drop("r")


def shown_turns(history: DataFrame) -> DataFrame:
    """Turns of a conversation that count as history: finished, without error, not blank (streaming, error, content)."""
    return history.where(~F.coalesce("streaming", F.lit(False)) & F.col("error").isNull() & (tx.strip(F.col("content")) != ""))


def answers_at(history: DataFrame, turns: int = 8, longest: int = 2000) -> DataFrame:
    """The last turns of each conversation: (conv_id, turn, role, content) of users and assistants, blank ones dropped, in order."""
    kept = history.where(F.col("role").isin("user", "assistant") & (tx.strip(F.col("content")) != ""))
    last = kept.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= turns)
    return last.select("conv_id", "turn", "role", F.substring("content", 1, longest).alias("content"))
