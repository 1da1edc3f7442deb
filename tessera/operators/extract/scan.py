"""The extractors over a table of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.extract import python_source, script_source
from tessera.operators.extract.model import COLUMNS, FIELDS, Found
from tessera.operators.files import SYMBOL_LANGUAGES, is_code, language
from tessera.operators.lineage import dealt

#: Files whose rows are made at once.
FILES_AT_ONCE = 500


def extract_file(path: str, content: str, lang: str, what: tuple[str, ...] = ()) -> list[dict]:
    """All rows of one file, or those of the kinds in ``what``; a file that cannot be parsed gives one error row."""
    try:
        made = python_source.extract(content, what) if lang == "python" else script_source.extract(content)
        return [f.row(path, k) for k, f in enumerate(made) if f is not None and (not what or f.what in what)]
    except (SyntaxError, ValueError, RecursionError, IndexError) as e:
        return [Found("error", type(e).__name__, str(e)[:200]).row(path, 0)]


def found(files: DataFrame, *what: str) -> DataFrame:
    """What is found in ``files`` (path, content, language hint), of the kinds in ``what`` if any are named, and the errors. Size and language are filtered before Python starts.

    Files are dealt over the tasks first: what they are made from may be one small file, which a single task would read."""
    hint = F.col("language") if "language" in files.columns else F.lit(None).cast("string")
    rows = files.where(is_code(F.col("path"), F.col("content"))).select("path", "content", language(F.col("path"), hint).alias("language"))
    rows = rows.where(F.col("language").isin(*SYMBOL_LANGUAGES))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole[at : at + FILES_AT_ONCE] for whole in parts for at in range(0, len(whole), FILES_AT_ONCE)):
            out = [r for p, c, lang in zip(part["path"], part["content"], part["language"]) for r in extract_file(p, c, lang, what)]
            yield pd.DataFrame(out, columns=FIELDS).astype({c: "Int32" for c in ("start_line", "end_line", "column", "ordinal")})

    return dealt(rows, "path").mapInPandas(run, COLUMNS)


def symbols(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'symbol'").select("path", "kind", "name", "parent", "start_line", "end_line", "is_async", "is_exported", "is_static", "is_public", "extends", "return_type", "parameters", "body", "source", "ordinal")


def imports(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'import'").select(F.col("path").alias("from_path"), "source", F.col("items").alias("imports"), (F.col("kind") == "type").alias("is_type_only"), "ordinal")


def calls(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'call'").select("path", F.col("name").alias("function_name"), F.col("start_line").alias("line"), "column", (F.col("kind") == "method").alias("is_method_call"), "receiver", F.col("kind").alias("call_type"), "ordinal")


def inheritance(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'inheritance'").select(F.col("path").alias("from_path"), F.col("source").alias("to_path"), F.lit("extends").alias("type"), F.col("name").alias("relationship"))


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'error'").select("path", "kind", F.col("name").alias("message"))
