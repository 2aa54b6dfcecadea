"""Schemas and requests from OpenAPI 3 documents."""

from __future__ import annotations

import warnings

from pyspark.sql import types as T

from .http import HttpPages, at

SIMPLE = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
_warned: set[str] = set()


def checked(doc: dict) -> dict:
    version = str(doc.get("openapi", ""))
    if not version.startswith("3."):
        raise ValueError("only OpenAPI 3 documents can be read")
    if not version.startswith("3.0") and version not in _warned:
        _warned.add(version)
        warnings.warn(f"OpenAPI {version} is read as 3.0", stacklevel=3)
    return doc


def followed(doc: dict, node: dict, seen: tuple[str, ...] = ()) -> dict:
    """The schema behind references; parts of allOf are joined, of alternatives the first one counts."""
    if ref := node.get("$ref"):
        if not ref.startswith("#/"):
            raise ValueError(f"{ref}: only references within the document can be followed")
        if ref in seen:
            return {"type": "string"}  # a schema within itself has no end
        target: object = doc
        for name in ref[2:].split("/"):
            name = name.replace("~1", "/").replace("~0", "~")
            if not isinstance(target, dict) or name not in target:
                raise ValueError(f"{ref} isn't there")
            target = target[name]
        return followed(doc, target, (*seen, ref)) | {"__seen": (*seen, ref)}
    for key in ("oneOf", "anyOf"):
        if node.get(key):
            return followed(doc, node[key][0], seen)
    if node.get("allOf"):
        joined: dict = {k: v for k, v in node.items() if k != "allOf"}
        properties: dict = dict(node.get("properties", {}))
        for part in node["allOf"]:
            got = followed(doc, part, seen)
            properties |= got.get("properties", {})
            joined |= {k: v for k, v in got.items() if k != "properties"}
        return joined | ({"properties": properties} if properties else {})
    return node


def type_of(doc: dict, node: dict, seen: tuple[str, ...] = ()) -> T.DataType:
    node = followed(doc, node, seen)
    seen = node.get("__seen", seen)
    kind = node.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), "string")
    if kind == "array":
        return T.ArrayType(type_of(doc, node.get("items", {}), seen))
    if kind == "object" or "properties" in node:
        if node.get("properties"):
            return T.StructType([T.StructField(k, type_of(doc, v, seen)) for k, v in node["properties"].items()])
        extra = node.get("additionalProperties")
        return T.MapType(T.StringType(), type_of(doc, extra, seen) if isinstance(extra, dict) else T.StringType())
    return SIMPLE.get(kind, T.StringType())


def openapi_schema(doc: dict, path: str, method: str = "get", status: str = "200", data_path: str = "") -> T.StructType:
    """The type of one item that an operation answers with."""
    operation = checked(doc).get("paths", {}).get(path, {}).get(method.lower())
    if operation is None:
        raise ValueError(f"there is no {method} {path}")
    answer = followed(doc, operation.get("responses", {}).get(status) or operation.get("responses", {}).get("default", {}))
    content = at(answer, "content") or {}
    node = (content.get("application/json") or next(iter(content.values()), {})).get("schema")
    if node is None:
        raise ValueError(f"{method} {path} has no schema for {status}")
    t = type_of(doc, node)
    for name in data_path.split(".") if data_path else []:
        t = t[name].dataType
    if isinstance(t, T.ArrayType):
        t = t.elementType
    if not isinstance(t, T.StructType):
        raise ValueError(f"{method} {path} doesn't answer with objects")
    return t


def openapi_request(doc: dict, path: str, method: str = "get", server: str = "", parameters: dict | None = None, **paging) -> HttpPages:
    """How to ask an operation: its server and path, with the parameters filled in."""
    checked(doc)
    if doc.get("paths", {}).get(path, {}).get(method.lower()) is None:
        raise ValueError(f"there is no {method} {path}")
    left = dict(parameters or {})
    filled = path
    for name in list(left):
        if "{" + name + "}" in filled:
            filled = filled.replace("{" + name + "}", str(left.pop(name)))
    if "{" in filled:
        raise ValueError(f"{filled}: a parameter is missing")
    base = server or next((s["url"] for s in doc.get("servers", [])), "")
    return HttpPages(base.rstrip("/") + filled, method.upper(), query=left, **paging)
