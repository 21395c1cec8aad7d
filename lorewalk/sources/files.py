"""Files of a directory as rows, read by Spark.

The driver lists the directory once: ignored folders are not entered, the ignore files
on the way are read, and only the files that are left are handed to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewalk import dims
from lorewalk.functions import symbols as S
from lorewalk.sources import ignore

#: Bytes of a file that is read at most; 0 is no limit.
MOST = 5 << 20


def listed(spark: SparkSession, root: str, *, rules: list[ignore.Rule] | None = None, extensions: list[str] | None = None, show_hidden: bool = False) -> list[tuple[str, int]]:
    """Paths and sizes of the files under a root that are not ignored, by ignore files, the given rules and the project's own ignore file, which counts most.

    extensions: as they are written; none means all.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)

    def text(path) -> str:
        stream = fs.open(path)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    own = jvm.org.apache.hadoop.fs.Path(top, f"{ignore.PROJECT_FOLDER}/ignore")
    last = [*(rules or []), *(ignore.compile_rules(text(own)) if fs.exists(own) else [])]
    found: list[ignore.Rule] = []
    out: list[tuple[str, int]] = []
    todo = [(top, "")]
    while todo:
        folder, at = todo.pop(0)
        entries = sorted(fs.listStatus(folder), key=lambda e: e.getPath().getName())
        for e in entries:
            if not e.isDirectory() and e.getPath().getName() == ignore.IGNORE_FILE:
                found += ignore.compile_rules(text(e.getPath()), at)
        for e in entries:
            path = at + e.getPath().getName()
            if ignore.is_ignored(path, found + last, folder=e.isDirectory(), show_hidden=show_hidden):
                continue
            if e.isDirectory():
                todo.append((e.getPath(), path + "/"))
            elif not extensions or path.rsplit("/", 1)[-1].rpartition(".")[2] in extensions:
                out.append((e.getPath().toString(), e.getLen()))
    return out


def problem(content: Column, length: Column, most: int = MOST) -> Column:
    """Why a file isn't read: too large, binary (a zero byte in the first 8 KiB) or not UTF-8; null if it is."""
    return (
        F.when(F.lit(bool(most)) & (length > most), "too large")
        .when(F.contains(F.substring(content, 1, 8192), F.lit(b"\0")), "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "not UTF-8")
    )


def with_language(files: DataFrame) -> DataFrame:
    """files (file) with ext and language by extension, `unknown` for others."""
    named = files.withColumn("ext", S.extension(F.col("file")))
    return named.join(F.broadcast(dims.extensions(files.sparkSession)), "ext", "left").withColumn("language", F.coalesce("language", F.lit("unknown")))


def checked(raw: DataFrame, most: int = MOST) -> DataFrame:
    """file, language, ext, size, content and error of raw files (file, length, content as bytes)."""
    error = problem(F.col("content"), F.col("length"), most)
    out = raw.select("file", F.col("length").alias("size"), error.alias("error"), F.when(error.isNull(), F.col("content").cast("string")).alias("content"))
    return with_language(out).select("file", "language", "ext", "size", "content", "error")


def read_files(spark: SparkSession, root: str, *, rules: list[ignore.Rule] | None = None, most: int = MOST, extensions: list[str] | None = None) -> DataFrame:
    """file, language, ext, size, content and error of the files under a root that are not ignored.

    Binary files (a zero byte in the first 8 KiB), files that are not UTF-8 and
    files above the size have an error and no content.
    """
    there = listed(spark, root, rules=rules, extensions=extensions)
    raw = spark.createDataFrame([(p, 0, b"") for p, size in there if not size], "path string, length long, content binary")  # Spark's reader passes over empty files
    full = [p for p, size in there if size]
    if full:
        raw = spark.read.format("binaryFile").load(full).select("path", "length", "content").unionByName(raw)
    path = F.regexp_replace("path", "^[a-z]+:(//)?", "")
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    return checked(raw.select(F.element_at(F.split(path, F.lit(rf"\Q{base}\E")), -1).alias("file"), "length", "content"), most)


def project_languages(files: DataFrame) -> DataFrame:
    return files.select("language").where("language is not null and language <> 'unknown'").distinct()


def project_entries(files: DataFrame) -> DataFrame:
    """language and file: what shows a server the project: of each language's manifests that stand in the root the first one, else its first source file."""
    spark = files.sparkSession
    known = spark.createDataFrame([(lang, name, k) for lang, names in dims.MANIFESTS.items() for k, name in enumerate(names)], "language string, file string, rank int")
    manifests = files.select("file").join(F.broadcast(known), "file").select("language", "rank", "file")
    sources = files.where("language <> 'unknown'").select("language", F.lit(len(dims.MANIFESTS)).alias("rank"), "file")
    used = sources.select("language").distinct()
    first = manifests.unionByName(sources).groupBy("language").agg(F.min_by("file", F.struct("rank", "file")).alias("file"))
    return first.join(used, "language", "left_semi")
