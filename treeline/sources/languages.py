"""Languages: names, aliases, file extensions, and detection of a file's language by its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS: dict[str, str] = {
    "bash": "bash bats sh .bashrc bash_aliases cgi command env fcgi ksh tmux tool zsh bash_logout bash_profile profile login logout",
    "c": "c", "cpp": "cpp cc cxx hxx c++ hh cu ino h", "csharp": "cs csx", "css": "css", "elixir": "ex exs", "go": "go", "haskell": "hs lhs", "html": "html htm xhtml shtml",
    "java": "java", "javascript": "js mjs cjs jsx snap", "json": "json json5 jsonc", "kotlin": "kt kts ktm", "lua": "lua", "php": "php phtml", "python": "py py3 pyi bzl",
    "ruby": "rb rbw rake gemspec", "rust": "rs", "scala": "scala sc scm sbt", "swift": "swift xctest", "typescript": "ts cts mts", "tsx": "tsx", "yaml": "yaml yml",
}
ALIASES: dict[str, str] = {
    "py": "python", "py3": "python", "golang": "go", "c++": "cpp", "cc": "cpp", "cxx": "cpp", "c#": "csharp", "cs": "csharp", "js": "javascript", "jsx": "javascript", "ts": "typescript",
    "rs": "rust", "rb": "ruby", "sh": "bash", "shell": "bash", "kt": "kotlin", "hs": "haskell", "ex": "elixir", "yml": "yaml", "htm": "html",
}
#: The character that stands for $ in a language whose names can't hold it.
EXPANDO: dict[str, str] = {"css": "_", "html": "z"} | dict.fromkeys(("bash", "java", "javascript", "json", "lua", "scala", "tsx", "typescript", "yaml"), "$")
RULE_GLOBS = ("*.yml", "*.yaml")
_INDICATORS = {"makefile": "bash", "dockerfile": "bash", "gemfile": "ruby", "rakefile": "ruby", "build": "python"}


def expando(language: str) -> str:
    return EXPANDO.get(language, "µ")


def canonical(name: str) -> str | None:
    """The language that a name or alias means, or None."""
    low = str(name).strip().lower()
    return low if low in EXTENSIONS else ALIASES.get(low)


def pairs() -> list[tuple[str, str]]:
    """(extension, language), each extension once."""
    return [(e.lstrip("."), lang) for lang, all_ in EXTENSIONS.items() for e in all_.split()]


def extension_table(spark: SparkSession) -> DataFrame:
    """About a hundred rows, whatever the input."""
    return spark.createDataFrame(pairs(), "extension string, language string")


def extension(path: Column) -> Column:
    """The lower-cased extension of a path's last part; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def with_language(files: DataFrame, path: str = "path", indicators: bool = False) -> DataFrame:
    """files with language STRING: null where the extension says nothing. indicators: also go by names without extension."""
    table = extension_table(files.sparkSession).withColumnRenamed("extension", "__ext")
    # a fixed table of about a hundred rows
    out = files.withColumn("__ext", extension(F.col(path))).join(F.broadcast(table), "__ext", "left").drop("__ext")
    if indicators:
        base = F.lower(F.regexp_extract(F.col(path), r"([^/\\]+)$", 1))
        named = F.lit(None).cast("string")
        for name, lang in _INDICATORS.items():
            named = F.when(base == name, F.lit(lang)).otherwise(named)
        out = out.withColumn("language", F.coalesce("language", named))
    return out


def detect(path: str) -> str | None:
    """The same for one path, on the driver."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    return dict(pairs()).get(base.rsplit(".", 1)[-1].lower()) if "." in base else None


def file_globs(language: str) -> list[str]:
    return [f"*.{e.lstrip('.')}" for e in EXTENSIONS[language].split()]
