"""Repository files: which count as code, in which language, and what belongs to the repository as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results depend on exactly these lists.
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".cs", ".cpp", ".c", ".rb", ".php", ".swift", ".kt", ".vue", ".svelte")
SKIPPED_FOLDERS = (
    "node_modules", ".git", "dist", "build", ".next", "__pycache__", ".pytest_cache", "vendor", ".venv", "venv", "coverage",
    ".turbo", ".cache", "out", "target", "bin", "obj", ".idea", ".vscode",
)
LANGUAGE_OF = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go",
    ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
}
LANGUAGES = ("python", "javascript", "typescript", "tsx", "java", "go", "rust", "cpp", "c")
SYMBOL_LANGUAGES = ("python", "javascript", "typescript", "tsx")
MAX_CHARS = 200_000
CONFIG_FILES = ("package.json", "pyproject.toml", "setup.py", "setup.cfg", "Cargo.toml", "go.mod", "composer.json", "Gemfile")


def is_code(path: Column, content: Column) -> Column:
    """No folder of the path is skipped or hidden, the extension is one of code, the content is short enough."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    extension = F.when(name.contains("."), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))).otherwise("")
    hidden = F.exists(folders, lambda s: s.isin(*SKIPPED_FOLDERS) | s.startswith("."))
    return ~hidden & extension.isin(*CODE_EXTENSIONS) & (F.length(content) < MAX_CHARS)


def language(path: Column, hint: Column) -> Column:
    """The hint if it names a supported language, else by the end of the path, else null."""
    by_path = None
    for end, name in LANGUAGE_OF.items():
        hit = F.lower(path).endswith(end)
        by_path = F.when(hit, name) if by_path is None else by_path.when(hit, name)
    return F.coalesce(F.when(F.lower(hint).isin(*LANGUAGES), F.lower(hint)), by_path)


def subsystem(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(".")


def branch_or_default(branch: Column, default: Column) -> Column:
    """Empty, `main` and `master` mean the repository's default branch."""
    asks = F.lower(F.trim(F.coalesce(branch, F.lit("")))).isin("", "main", "master")
    return F.when(asks, F.coalesce(default, branch)).otherwise(branch)


def config_contents(files: DataFrame) -> DataFrame:
    """(repo_id, name, content): the first 5000 signs of each well-known file, the last in order if there are several."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("repo_id", name.alias("name"), "content", "ordinal").where(F.col("name").isin(*CONFIG_FILES))
    return found.groupBy("repo_id", "name").agg(F.substring(F.max_by("content", "ordinal"), 1, 5000).alias("content"))


def readme(files: DataFrame) -> DataFrame:
    """(repo_id, content): 8000 signs of the first readme at the root."""
    found = files.where(F.lower("path").isin("readme.md", "readme.txt", "readme.rst"))
    return found.groupBy("repo_id").agg(F.substring(F.min_by("content", "ordinal"), 1, 8000).alias("content"))


def repository_name(url: Column, name: Column) -> Column:
    """`owner/name` from an address on github.com, else the name."""
    path = F.regexp_extract(url, r"github\.com[/:]+([^/]+/[^/?#]+)", 1)
    return F.when(path != "", F.regexp_replace(path, r"\.git$", "")).otherwise(name)
