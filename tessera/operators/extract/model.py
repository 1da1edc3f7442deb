"""Rows the extractors give, one kind of row for everything found in a file."""

from __future__ import annotations

from dataclasses import dataclass

COLUMNS = (
    "path string, what string, kind string, name string, parent string, start_line int, end_line int, is_async boolean, is_exported boolean,"
    " is_static boolean, is_public boolean, extends string, return_type string, parameters array<struct<name:string,type:string,optional:boolean,default_value:string>>,"
    " body string, source string, items array<string>, receiver string, column int, ordinal int"
)
FIELDS = [c.strip().split(" ")[0] for c in COLUMNS.replace("array<struct<name:string,type:string,optional:boolean,default_value:string>>", "x").split(",")]


@dataclass
class Found:
    """``what`` is symbol, import, call, inheritance, export or error; unused fields stay null."""

    what: str
    kind: str | None = None
    name: str | None = None
    parent: str | None = None
    start_line: int | None = None
    end_line: int | None = None
    is_async: bool | None = None
    is_exported: bool | None = None
    is_static: bool | None = None
    is_public: bool | None = None
    extends: str | None = None
    return_type: str | None = None
    parameters: list[dict] | None = None
    body: str | None = None
    source: str | None = None
    items: list[str] | None = None
    receiver: str | None = None
    column: int | None = None

    def row(self, path: str, ordinal: int) -> dict:
        return {"path": path, **vars(self), "ordinal": ordinal}


def parameter(name: str, type_: str | None = None, optional: bool = False, default: str | None = None) -> dict:
    return {"name": name, "type": type_, "optional": optional, "default_value": default}
