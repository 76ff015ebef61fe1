"""Sources of documents: (path, filename, language, extension, content, complexity), none of them null.

Complexity of plain text is its number of newlines; of code, its number of branch words (see functions.lexical).
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, filename string, language string, extension string, content string, complexity bigint"
#: Most bytes read of a file, bytes searched for NUL, and the mean line length from which a file counts as minified.
READ, NUL_WITHIN, MINIFIED = 1_000_000, 10_000, 255
EXCLUDED = (".git", ".hg", ".svn")

#: Languages by extension.
LANGUAGES = {
    "c": "C", "h": "C Header", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++ Header", "cs": "C#", "clj": "Clojure", "cr": "Crystal", "css": "CSS", "dart": "Dart",
    "ex": "Elixir", "exs": "Elixir", "erl": "Erlang", "go": "Go", "groovy": "Groovy", "hs": "Haskell", "html": "HTML", "java": "Java", "js": "JavaScript", "mjs": "JavaScript",
    "jsx": "JSX", "json": "JSON", "jl": "Julia", "kt": "Kotlin", "lua": "Lua", "m": "MATLAB", "md": "Markdown", "ml": "OCaml", "nim": "Nim", "php": "PHP", "pl": "Perl", "ps1": "Powershell",
    "py": "Python", "rb": "Ruby", "rs": "Rust", "scala": "Scala", "sh": "Shell", "sql": "SQL", "swift": "Swift", "toml": "TOML", "ts": "TypeScript", "tsx": "TSX", "txt": "Plain Text",
    "v": "V", "xml": "XML", "yaml": "YAML", "yml": "YAML", "zig": "Zig",
}
#: Files known by name.
NAMED = {"makefile": "Makefile", "dockerfile": "Dockerfile", "rakefile": "Ruby", "gemfile": "Ruby"}


def extension_of(filename: Column | str) -> Column:
    """What follows the last dot, lower-cased; empty without one."""
    name = F.col(filename) if isinstance(filename, str) else filename
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))


def newlines(text: Column | str) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\n"), F.lit("")))).cast("long")


def language_of(filename: Column | str, extension: Column | str) -> Column:
    """A language by file name or extension; empty if neither is known."""
    by = lambda d, c: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c)
    ext = F.col(extension) if isinstance(extension, str) else extension
    return F.coalesce(by(NAMED, F.lower(filename)), by(LANGUAGES, ext), F.lit(""))


def extensions_of(languages: list[str]) -> list[str]:
    """Extensions of languages named in any case."""
    wanted = {x.lower() for x in languages}
    return sorted(e for e, name in LANGUAGES.items() if name.lower() in wanted)


def documents(df: DataFrame) -> DataFrame:
    """The documents of a table doc_id, text, lang, source."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.coalesce("text", F.lit(""))
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    return df.select(
        F.concat_ws("/", source, lang, name).alias("path"), name.alias("filename"), lang.alias("language"), F.lit("txt").alias("extension"), text.alias("content"), newlines(text).alias("complexity")
    )


def pages(df: DataFrame) -> DataFrame:
    """The pages of a table url, html; the path is the address without scheme and query."""
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-z]+://|[?#].*$", "")
    html = F.coalesce("html", F.lit(""))
    return df.select(
        path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("filename"), F.lit("HTML").alias("language"), F.lit("html").alias("extension"), html.alias("content"), newlines(html).alias("complexity")
    )


def conversations(df: DataFrame) -> DataFrame:
    """The turns of a table conv_id, turn, role, text."""
    name = F.concat(F.col("turn").cast("string"), F.lit(".txt"))
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    return df.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), role, name).alias("path"), name.alias("filename"), role.alias("language"), F.lit("txt").alias("extension"), text.alias("content"), newlines(text).alias("complexity")
    )


def events(df: DataFrame) -> DataFrame:
    """The events of a table event_id, user_id, event_type, value, props."""
    name = F.concat(F.col("event_id").cast("string"), F.lit(".json"))
    kind = F.coalesce("event_type", F.lit(""))
    return df.select(
        F.concat_ws("/", kind, F.col("user_id").cast("string"), name).alias("path"), name.alias("filename"), kind.alias("language"), F.lit("json").alias("extension"), F.coalesce("props", F.lit("")).alias("content"), F.coalesce(F.floor("value").cast("long"), F.lit(0)).alias("complexity")
    )


def parts(df: DataFrame) -> DataFrame:
    """The parts of a table p_partkey, p_name, p_brand, p_type, p_size."""
    name = F.col("p_partkey").cast("string")
    return df.select(
        F.concat_ws("/", "p_brand", "p_type", name).alias("path"), name.alias("filename"), F.col("p_brand").alias("language"), F.lit("").alias("extension"), F.col("p_name").alias("content"), F.col("p_size").cast("long").alias("complexity")
    )


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents given as rows of SCHEMA."""
    return spark.createDataFrame(rows, SCHEMA)


def files(spark: SparkSession, root: str, extensions: list[str] | None = None, languages: list[str] | None = None, exclude_dirs: tuple[str, ...] = EXCLUDED, exclude: list[str] | None = None, ignore: list[str] | None = None, hidden: bool = False, binary: bool = False, minified: bool = False, most: int = READ) -> DataFrame:
    """The text files below a folder, with their size in bytes: path, filename, language, extension, content, complexity, bytes.

    extensions are matched in their case; exclude holds texts that no path may contain, ignore globs that no run of its segments may match.
    """
    from textloom.functions.languages import SYNTAX
    from textloom.functions.lexical import code_stats
    from textloom.functions.patterns import path_glob_regex

    if languages:
        extensions = sorted({*(extensions or []), *extensions_of(languages)})
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    base = root.rstrip("/")
    df = reader.load(root).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.substring("content", 1, most).alias("raw"))
    segments = F.split(F.substring("path", F.lit(len(base) + 2), F.char_length("path")) if base.startswith("/") else F.col("path"), "/")
    df = df.where(~F.exists(segments, lambda s: s.isin(*exclude_dirs)))
    if not hidden:
        df = df.where(~F.exists(segments, lambda s: F.startswith(s, F.lit("."))))
    for text in exclude or []:
        df = df.where(~F.contains("path", F.lit(text)))
    for glob in ignore or []:
        if made := path_glob_regex(glob):
            df = df.where(~F.col("path").rlike(made))
    df = text_only(df, binary, minified)
    name = F.element_at(F.split("path", "/"), -1)
    df = df.select("path", name.alias("filename"), extension_of(name).alias("extension"), F.make_valid_utf8(F.col("raw").cast("string")).alias("content"), F.octet_length("raw").cast("long").alias("bytes"))
    df = df.withColumn("language", language_of("filename", "extension"))
    known = F.col("language").isin(*sorted(SYNTAX))
    df = df.withColumn("complexity", F.when(known, code_stats(F.col("content"), F.col("language"))["complexity"]).otherwise(newlines("content")))
    return df.select("path", "filename", "language", "extension", "content", "complexity", "bytes")


def text_only(df: DataFrame, binary: bool = False, minified: bool = False, raw: str = "raw") -> DataFrame:
    """Rows whose bytes look like text: not empty, no NUL near the start, no very long lines."""
    df = df.where(F.octet_length(raw) > 0)
    if not binary:
        df = df.where(~F.contains(F.substring(raw, 1, NUL_WITHIN), F.lit(b"\0")))
    if not minified:
        lines = F.size(F.split(F.decode(F.col(raw).cast("binary"), "ISO-8859-1"), "\n"))
        df = df.where(F.octet_length(raw) < (MINIFIED + 1) * lines)
    return df


def scanned(df: DataFrame, most: int = READ) -> DataFrame:
    """Documents as a scan keeps them: the first bytes of each, text only, with their size."""
    df = df.withColumn("raw", F.substring(F.col("content").cast("binary"), 1, most))
    return text_only(df).withColumn("bytes", F.octet_length("raw").cast("long")).drop("raw")


def repository_root(start: str) -> str:
    """The nearest folder, from start up, that holds a version control folder; start itself if none does."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if any((folder / d).is_dir() for d in EXCLUDED):
            return str(folder)
    return str(at)


def file_lines(docs: DataFrame, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """line, content of one document, from line first to last (1-based, inclusive, clamped)."""
    if ".." in path.split("/"):
        raise ValueError("path leaves the searched folder")
    if first is not None and last is not None and first > last:
        raise ValueError("start line is after end line")
    lines = docs.where(F.col("path") == path).select(F.posexplode(F.split("content", "\n")).alias("line", "content"))
    lines = lines.select((F.col("line") + 1).alias("line"), "content")
    if first is not None:
        lines = lines.where(F.col("line") >= first)
    return lines if last is None else lines.where(F.col("line") <= last)
