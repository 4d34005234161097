"""Files as documents: a listing without contents, and contents of chosen entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types by extension; others are unknown.
MEDIA_TYPES = {
    "md": "text/markdown",
    "markdown": "text/markdown",
    "mdx": "text/markdown",
    "rst": "text/x-rst",
    "txt": "text/plain",
    "text": "text/plain",
    "log": "text/plain",
    "htm": "text/html",
    "html": "text/html",
    "css": "text/css",
    "csv": "text/csv",
    "js": "text/javascript",
    "xml": "text/xml",
    "json": "application/json",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "gif": "image/gif",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "svg": "image/svg+xml",
}
UNKNOWN = "application/octet-stream"


def media_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit(UNKNOWN))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def glob_pattern(glob: str) -> str:
    """A glob over relative paths as a regular expression: ** is any folders, * and ? stay inside one name."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "/_-" else "\\" + c), i + 1
    return f"^{out}$"


def matches(path: Column, globs: tuple[str, ...]) -> Column:
    return path.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


def below(path: Column, root: str) -> Column:
    """A file's path below the root: its id there."""
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(path, F.lit(rf"^[a-z]*:?/*\Q{base}\E/"), F.lit(""))


def listing(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("**/*.md", "**/*.txt"), exclude: tuple[str, ...] = (), source_id: str = "files") -> DataFrame:
    """One row for each file below ``root`` that matches: source_id, id, uri, revision, size_bytes, media_type, folder.

    Only names, times and lengths are read. The revision is the time in
    microseconds and the length. A missing root is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    rows = files.withColumn("id", below(F.col("path"), root)).where(matches(F.col("id"), patterns) & ~matches(F.col("id"), exclude))
    revision = F.concat_ws(":", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
    return rows.select(F.lit(source_id).alias("source_id"), "id", F.col("path").alias("uri"), revision.alias("revision"), F.col("length").alias("size_bytes"), media_type(F.col("id")).alias("media_type"), folder(F.col("id")).alias("folder")).distinct()


def glob_free(path: str) -> str:
    """A path in which no character stands for others."""
    return "".join(f"\\{c}" if c in "[]{}*?\\" else c for c in path)


def present(spark: SparkSession, uris: list[str]) -> list[str]:
    """The files that are still there."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [u for u in uris if path(u).getFileSystem(conf).exists(path(u))]


def fetched(spark: SparkSession, root: str, entries: DataFrame, most_listed: int = 20_000) -> DataFrame:
    """``entries`` with content. Files that are gone meanwhile have none, and are to be quarantined.

    Only the files of the entries are read; where they are more than
    ``most_listed``, as in a first run, all files below the root are scanned.
    """
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    uris = [r.uri for r in entries.select("uri").limit(most_listed + 1).collect()]
    if len(uris) > most_listed:
        contents = files.option("recursiveFileLookup", True).load(root)
    elif there := present(spark, uris):
        contents = files.load([glob_free(u) for u in there])
    else:
        return entries.withColumn("content", F.lit(None).cast("binary"))
    return entries.join(contents.select(F.col("path").alias("uri"), "content"), "uri", "left")
