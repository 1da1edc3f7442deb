"""Checks of generated documents: each rule gives the rows that break it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the document schemas.
MAX_SECTIONS, MAX_REFERENCES = 10, 15
VISIBILITIES = ("public", "private", "protected", "package")
CLASS_RELATIONS = ("inheritance", "implementation", "association", "aggregation", "composition", "dependency")
USE_CASE_RELATIONS = ("association", "include", "extend", "generalization")
PLACEMENTS = ("left", "right")

SCHEMAS = {
    "class": "struct<classes:array<struct<id:string,className:string,attributes:array<struct<name:string,visibility:string>>>>,relationships:array<struct<source:string,target:string,type:string>>>",
    "sequence": "struct<lifelines:array<struct<id:string,name:string>>,messages:array<struct<source:string,target:string>>,fragments:array<struct<startIndex:int>>>",
    "use_case": "struct<actors:array<struct<id:string,placement:string>>,useCases:array<struct<id:string>>,relationships:array<struct<source:string,target:string,type:string>>>",
    "state": "struct<states:array<struct<id:string,kind:string>>,transitions:array<struct<source:string,target:string>>>",
    "documentation": "struct<sections:array<struct<title:string>>,code_references:array<string>>",
}


def _n(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _ends_known(edges: str, ids: Column) -> Column:
    return F.coalesce(F.forall(edges, lambda e: F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"])), F.lit(True))


def _all_in(items: str, field: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.forall(items, lambda x: F.coalesce(x[field].isin(*values), F.lit(True))), F.lit(True))


def _count(items: str, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.size(F.filter(items, test)), F.lit(0))


def rules(kind: str) -> dict[str, Column]:
    """Rule name: condition that holds for a good document; columns are those of the kind's schema."""
    if kind == "class":
        return {"relations": _all_in("relationships", "type", CLASS_RELATIONS), "ends": _ends_known("relationships", F.transform("classes", lambda c: c["id"])), "visibility": F.coalesce(F.forall("classes", lambda c: F.coalesce(F.forall(c["attributes"], lambda a: F.coalesce(a["visibility"].isin(*VISIBILITIES), F.lit(True))), F.lit(True))), F.lit(True))}
    if kind == "sequence":
        return {"lifelines": _n("lifelines") >= 2, "ends": _ends_known("messages", F.transform("lifelines", lambda x: x["id"])), "fragments": F.coalesce(F.forall("fragments", lambda f: f["startIndex"] > 0), F.lit(True))}
    if kind == "use_case":
        ids = F.concat(F.transform("actors", lambda x: x["id"]), F.transform("useCases", lambda x: x["id"]))
        return {"placement": _all_in("actors", "placement", PLACEMENTS), "relations": _all_in("relationships", "type", USE_CASE_RELATIONS), "ends": _ends_known("relationships", ids)}
    if kind == "state":
        return {"initial": _count("states", lambda s: s["kind"] == "initial") == 1, "final": _count("states", lambda s: s["kind"] == "final") >= 1, "ends": _ends_known("transitions", F.transform("states", lambda s: s["id"]))}
    if kind == "documentation":
        return {"sections": _n("sections") <= MAX_SECTIONS, "references": _n("code_references") <= MAX_REFERENCES}
    raise ValueError(f"unknown kind {kind!r}")


def violations(documents: DataFrame, kind: str, id_col: str = "id", json_col: str = "body") -> DataFrame:
    """(id, rule): the rules each document breaks; `json` for a text that is not an object of the kind."""
    parsed = documents.select(F.col(id_col).alias("id"), F.from_json(F.col(json_col), SCHEMAS[kind], {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_x"}).alias("d"), F.expr(f"try_parse_json({json_col}) is not null").alias("ok"))
    checks = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules(kind).items()]))
    broken = parsed.select("id", "ok", "d.*").select("id", F.when(F.coalesce("ok", F.lit(False)), checks).otherwise(F.array(F.lit("json"))).alias("broken"))
    return broken.select("id", F.explode("broken").alias("rule"))
