"""Column expressions: validity, cosine, predicates of two values, score expressions, metadata and text normalisation."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, functions as F

from engramlake.plans import nodes as p

HEADERS = {"tenant": "i64", "kind": "kind", "created_at": "i64", "updated_at": "i64", "score": "f32", "node_id": "string"}
_TAGS = {"tenant": "u32", "kind": "kind", "created_at": "i64", "updated_at": "i64", "score": "f32", "node_id": "string"}
_COLUMNS = {"tenant": "tenant", "kind": "kind", "created_at": "created_at_ms", "updated_at": "updated_at_ms", "score": "score", "node_id": "node_id"}


def is_valid_at(at: Column) -> Column:
    """Node validity: Pending never; Active in [from, to); Superseded and Retracted only with a valid_to, in the window."""
    start = F.coalesce("valid_from_ms", "created_at_ms")
    inside = (start <= at) & (F.col("valid_to_ms").isNull() | (at < F.col("valid_to_ms")))
    return (F.col("state") != "Pending") & inside & ((F.col("state") == "Active") | F.col("valid_to_ms").isNotNull())


def edge_is_valid_at(at: Column) -> Column:
    start = F.coalesce("valid_from_ms", "created_at_ms")
    return (start <= at) & (F.col("valid_to_ms").isNull() | (at < F.col("valid_to_ms")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_score(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2 in [0, 1]; 0 where a norm is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    distance = F.when(norm == 0, F.lit(2.0)).otherwise(F.greatest(F.lit(0.0), 1 - dot(a, b) / norm))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - distance / 2))


def vector_literal(v) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in v])


def field_value(f: p.Field) -> Column:
    """struct(tag, value) of a field as a string, or null where it's missing. content and metadata are in `fields`."""
    if not f.metadata and f.name in _COLUMNS:
        c = F.col(_COLUMNS[f.name])
        return F.when(c.isNotNull(), F.struct(F.lit(_TAGS[f.name]).alias("tag"), c.cast("string").alias("value")))
    return F.element_at("fields", F.lit(f.name))


def fields_of(content: Column, metadata: Column) -> Column:
    """The map of a record's fields: content and metadata scalars; a metadata key 'content' replaces the content.

    metadata: map of key to JSON text. Strings, booleans and whole numbers become literals; other values are left out.
    """
    raw = F.map_entries(F.coalesce(metadata, F.create_map().cast("map<string,string>")))

    def literal(e: Column) -> Column:
        v = F.trim(e["value"])
        tag = (
            F.when(v.startswith('"'), F.lit("string"))
            .when(v.isin("true", "false"), F.lit("bool"))
            .when(v.rlike(r"^-?(0|[1-9][0-9]*)$") & v.try_cast("bigint").isNotNull(), F.lit("i64"))
        )
        text = F.when(tag == "string", F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
        return F.struct(e["key"].alias("key"), F.when(tag.isNotNull(), F.struct(tag.alias("tag"), text.alias("value"))).alias("value"))

    own = F.filter(F.transform(raw, literal), lambda e: e["value"].isNotNull())
    named = F.exists(own, lambda e: e["key"] == "content")
    first = F.when(content.isNotNull() & ~F.coalesce(named, F.lit(False)), F.array(F.struct(F.lit("content").alias("key"), F.struct(F.lit("string").alias("tag"), content.alias("value")).alias("value"))))
    empty = F.array().cast("array<struct<key:string,value:struct<tag:string,value:string>>>")
    return F.map_from_entries(F.concat(F.coalesce(first, empty), own))


def content_text(content: Column) -> Column:
    """Content as one string: text; a structured scalar or its JSON; blob:<mime>:<size>. content: the tagged struct."""
    js = content["json"]
    scalar = F.when(F.trim(js).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), js, F.lit("}")), "$.v")).otherwise(js)
    return (
        F.when(content["type"] == "text", content["text"])
        .when(content["type"] == "structured", scalar)
        .when(content["type"] == "blob", F.concat(F.lit("blob:"), content["mime"], F.lit(":"), content["size"].cast("string")))
    )


def _literal_string(v: p.Literal) -> str:
    if v.tag == p.Tag.BOOL:
        return "true" if v.value else "false"
    return str(v.value)


def predicate(q: p.Predicate) -> Column:
    """A predicate of two values: where a field is missing a comparison is false, and its negation true."""
    if isinstance(q, p.And):
        return reduce(lambda a, b: a & b, map(predicate, q.parts), F.lit(True))
    if isinstance(q, p.Or):
        return reduce(lambda a, b: a | b, map(predicate, q.parts), F.lit(False))
    if isinstance(q, p.Not):
        return ~predicate(q.part)
    if isinstance(q, p.In):
        return reduce(lambda a, b: a | b, [_compare("=", q.field, v) for v in q.values], F.lit(False))
    return _compare(q.op, q.field, q.value)


def _compare(op: str, f: p.Field, v: p.Literal) -> Column:
    header = None if f.metadata else _COLUMNS.get(f.name)
    if op == "=":
        if header:
            if _TAGS[f.name] != v.tag.value:
                return F.lit(False)
            c = F.col(header) == (F.lit(v.value).cast("float") if v.tag == p.Tag.F32 else F.lit(v.value))
        else:
            x = F.element_at("fields", F.lit(f.name))
            c = (x["tag"] == v.tag.value) & (x["value"] == _literal_string(v))
        return F.coalesce(c, F.lit(False))
    # Whole numbers are ordered among themselves, and scores against floats; nothing else is.
    if v.tag == p.Tag.I64 and header in ("created_at_ms", "updated_at_ms"):
        left, right = F.col(header), F.lit(v.value).cast("bigint")
    elif v.tag == p.Tag.I64 and not header:
        x = F.element_at("fields", F.lit(f.name))
        left, right = F.when(x["tag"] == "i64", x["value"].try_cast("bigint")), F.lit(v.value).cast("bigint")
    elif v.tag == p.Tag.F32 and header == "score":
        left, right = F.col("score"), F.lit(v.value).cast("float")
    else:
        return F.lit(False)
    c = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    return F.coalesce(c, F.lit(False))


def score_expr(e: p.ScoreExpr, now_ms: int | None = None, decay: str = "score") -> Column:
    """A new score. Decay gives the incoming score, as `similarity` does; with decay='exp', 0.5 ** (age / half-life)."""
    if isinstance(e, p.Similarity):
        return F.col("score").cast("double")
    if isinstance(e, p.Number):
        return F.lit(float(e.value))
    if isinstance(e, p.Decay):
        if decay == "score":
            return F.col("score").cast("double")
        age = F.lit(now_ms) - F.col(_COLUMNS[e.field.name])
        return F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / F.lit(float(e.half_life_ms)))
    a, b = score_expr(e.left, now_ms, decay), score_expr(e.right, now_ms, decay)
    return a + b if isinstance(e, p.Add) else a * b


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{85}\p{Z}]+", " "))


_CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"


def _terms(text: Column, word: str, longest: int, length) -> Column:
    low = F.lower(text)
    plain = F.filter(F.regexp_extract_all(low, F.lit(f"({word})"), 1), lambda t: length(t) <= longest)
    runs = F.regexp_extract_all(low, F.lit(f"([{_CJK}]+)"), 1)
    one = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1)))
    two = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(plain, F.flatten(F.transform(runs, lambda r: F.concat(one(r), two(r)))))


def lexical_terms(text: Column) -> Column:
    """Terms for ranked recall: ASCII words with _, of up to 256 bytes; CJK runs as single characters, then pairs."""
    return _terms(text, "[a-z0-9_]+", 256, F.length)


def evidence_terms(text: Column) -> Column:
    """Terms for evidence recall: words of any letters, digits or _, of up to 128 characters; CJK runs likewise."""
    return _terms(text, rf"(?:(?![{_CJK}])[\p{{L}}\p{{N}}_])+", 128, F.length)


def json_strings(text: str | None) -> list[str]:
    """All strings and object keys of a JSON value, in order; nothing for what isn't JSON."""
    out: list[str] = []

    def walk(x):
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            for k, y in x.items():
                out.append(k)
                walk(y)

    try:
        walk(json.loads(text)) if text is not None else None
    except ValueError:
        return []
    return out
