"""File admission: language, skip reasons, decoding.  Bytes in, texts out."""

from pyspark.sql import Column, DataFrame, functions as F

from siftmoor.fixed import files as fx
from siftmoor.functions.numbers import round_one
from siftmoor.functions.text import sql_array, strip, unix_newlines

# after the last dot of a name, leading dots not counted
_EXTENSION = r"(?s)^\.*[^.].*(\.[^.]*)$"
_NOT_TEXT = r"[^\x20-\x7e\t\n\r]"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.expr(f"map_from_arrays({sql_array(list(table))}, {sql_array(list(table.values()))})")
    return F.try_element_at(pairs, key)


def skipped_directory(name: Column) -> Column:
    return name.isin(fx.SKIP_DIRECTORIES) | name.endswith(fx.SKIP_DIRECTORY_SUFFIX)


def in_skipped_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), skipped_directory)


def language_of_name(path: Column) -> Column:
    """By special file name, else by extension; null for other names."""
    name = basename(path)
    return F.coalesce(_lookup(fx.FILENAME_LANGUAGE, name),
                      _lookup(fx.EXTENSION_LANGUAGE, F.lower(F.regexp_extract(name, _EXTENSION, 1))))


def language_of_shebang(first_line: Column) -> Column:
    line = F.lower(first_line)
    language = F.lit(None)
    for words, name in reversed(fx.SHEBANG_LANGUAGE):
        language = F.when(F.exists(F.expr(sql_array(words)), lambda word: line.contains(word)), name).otherwise(language)
    return F.when(line.startswith("#!"), language)


def first_line(content: Column) -> Column:
    """The first line of a file's bytes, at most 256 characters, bytes that are no UTF-8 left out."""
    head = F.make_valid_utf8(F.substring(content, 1, fx.BINARY_SAMPLE_BYTES).cast("string"))
    head = unix_newlines(F.replace(head, F.lit("�"), F.lit("")))
    return strip(F.substring(F.substring_index(head, "\n", 1), 1, fx.SHEBANG_CHARS))


def detect_language(path: Column, content: Column) -> Column:
    return F.coalesce(language_of_name(path), language_of_shebang(first_line(content)))


def is_binary(content: Column) -> Column:
    """A NUL, or more than 30 % bytes that are no plain text, in the first 8 KiB; unreadable files too."""
    sample = F.decode(F.substring(content, 1, fx.BINARY_SAMPLE_BYTES), "ISO-8859-1")
    odd = F.length(sample) - F.length(F.regexp_replace(sample, _NOT_TEXT, ""))
    return F.coalesce(sample.contains("\x00") | (odd / F.greatest(F.length(sample), F.lit(1)) > fx.BINARY_SHARE),
                      F.lit(True))


def name_reason(path: Column) -> Column:
    """The first reason in a file's path not to scan it; null without one."""
    name = basename(path)
    return (
        F.when(in_skipped_directory(path), "skipped directory")
        .when(name.isin(fx.SKIP_FILES), "excluded file")
        .when(name.startswith(".") & ~name.isin(list(fx.FILENAME_LANGUAGE)), "hidden file")
    )


def skip_reason(path: Column, size: Column, content: Column, language: Column) -> Column:
    """The first reason not to scan a file; null for files to scan."""
    return F.coalesce(
        name_reason(path),
        F.when(size.isNull(), "cannot read file")
        .when(size > fx.MAX_FILE_BYTES, F.format_string("file too large (%.1fMB)", round_one(size / F.lit(1e6))))
        .when(size == 0, "empty file")
        .when(is_binary(content), "binary file")
        .when(language.isNull(), "unsupported file type")
    )


def decoded(content: Column) -> Column:
    """UTF-8 if valid, else Latin-1; unix newlines; a byte order mark stays."""
    return unix_newlines(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")))


def judged(files: DataFrame) -> DataFrame:
    """``files(repo_id, path, size_bytes, content)`` with ``language`` and ``skip_reason``."""
    path, content = F.col("path"), F.col("content")
    return files.withColumn("language", detect_language(path, content)).withColumn(
        "skip_reason", skip_reason(path, F.col("size_bytes"), content, F.col("language")))


def skipped(files: DataFrame) -> DataFrame:
    return judged(files).where(F.col("skip_reason").isNotNull()).select(
        "repo_id", "path", "size_bytes", "skip_reason")


def admitted(files: DataFrame) -> DataFrame:
    """The ``file_text`` of the files to scan."""
    texts = judged(files).where(F.col("skip_reason").isNull()).withColumn("text", decoded(F.col("content")))
    return texts.select(
        "repo_id", "path", "language", F.length("text").alias("file_size"), "text",
        F.lit(None).cast("string").alias("scan_error"))
