"""Privacy operators: findings, redaction, pseudonyms and the outbound check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from siftline.functions import privacy as P
from siftline.functions.sql import quote, string_array
from siftline.operators.ordered import running
from siftline.operators.rows import explode_structs

MAX_PAYLOAD_BYTES = 12_000


def scan_sensitive(docs: DataFrame, text: str = "text", patterns: Iterable[P.Sensitive] = P.SENSITIVE, resolve: bool = True) -> DataFrame:
    """doc_id, kind, start, end, preview of what was found; the value itself stays inside."""
    patterns = tuple(patterns)
    found = P.scan(text, patterns) if resolve else P.candidates(text, patterns)
    hidden = (
        f"transform({found}, _f -> named_struct('kind', _f.kind, 'start', _f.start, 'end', _f.end,"
        f" 'replacement', _f.replacement, 'preview', {P.preview(f'substring({text}, _f.start + 1, _f.end - _f.start)')}))"
    )
    return explode_structs(docs, hidden, ["doc_id"])


def redact(docs: DataFrame, text: str = "text", patterns: Iterable[P.Sensitive] = P.SENSITIVE) -> DataFrame:
    """doc_id, text with every finding replaced, n_findings."""
    found = docs.withColumn("_found", F.expr(P.scan(text, tuple(patterns))))
    return found.select("doc_id", F.expr(P.redact(text, "_found")).alias("text"), F.size("_found").alias("n_findings"))


def pseudonymize(entities: DataFrame) -> DataFrame:
    """doc_id, kind, text, token: PERSON_01 and so on, numbered per document by first mention.

    entities: doc_id, kind, text, pos.  The numbering starts anew in every
    document, so tokens cannot be linked across documents.
    """
    tidy = entities.select("doc_id", F.upper("kind").alias("kind"), F.trim("text").alias("text"), "pos").filter("text <> ''")
    firsts = tidy.groupBy("doc_id", "kind", "text").agg(F.min("pos").alias("pos")).withColumn("prefix", F.expr(P.kind_prefix("kind")))
    numbered = running(firsts, ["pos", "kind", "text"], ["doc_id", "prefix"], number="_n")
    digits = "CASE WHEN _n < 100 THEN lpad(cast(_n AS string), 2, '0') ELSE cast(_n AS string) END"
    return numbered.select("doc_id", "kind", "text", F.expr(f"concat(prefix, '_', {digits})").alias("token"))


def _names(schema: D.DataType) -> Iterable[str]:
    if isinstance(schema, D.StructType):
        for f in schema.fields:
            yield f.name
            yield from _names(f.dataType)
    elif isinstance(schema, D.ArrayType):
        yield from _names(schema.elementType)
    elif isinstance(schema, D.MapType):
        yield from _names(schema.valueType)


def _is_forbidden(name: str) -> bool:
    plain = "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())
    return any(token in plain for token in P.FORBIDDEN_NAMES if token != "cc") or plain == "cc"


def forbidden_columns(df: DataFrame) -> list[str]:
    """Column and field names that must not leave, nested ones included."""
    return [name for name in dict.fromkeys(_names(df.schema)) if _is_forbidden(name)]


def _leaves(value: str, kind: D.DataType, name: str, depth: int = 0) -> tuple[str, str]:
    """SQL arrays of all texts in a value, each alone and after its name, and of all map keys in it."""
    none = "cast(array() AS array<string>)"
    var = f"_v{depth}"
    if isinstance(kind, D.StructType):
        # a forbidden name is a reason of its own and says nothing about its value
        inner = [_leaves(f"{value}.`{f.name}`", f.dataType, "''" if _is_forbidden(f.name) else quote(f.name), depth) for f in kind.fields]
    elif isinstance(kind, D.ArrayType):
        texts, keys = _leaves(var, kind.elementType, name, depth + 1)
        inner = [tuple(f"coalesce(flatten(transform({value}, {var} -> {part})), {none})" for part in (texts, keys))]
    elif isinstance(kind, D.MapType):
        key_texts, _ = _leaves(f"{var}.key", kind.keyType, "''", depth + 1)
        key = f"cast({var}.key AS string)"
        texts, keys = _leaves(f"{var}.value", kind.valueType, f"CASE WHEN {_forbidden_key(key)} THEN '' ELSE {key} END", depth + 1)
        both = (f"concat({key_texts}, {texts})", f"concat(array(cast({var}.key AS string)), {keys})")
        inner = [tuple(f"coalesce(flatten(transform(map_entries({value}), {var} -> {part})), {none})" for part in both)]
    else:
        text = f"cast({value} AS string)"
        return f"filter(array({text}, concat({name}, ': ', {text})), _t -> _t IS NOT NULL)", none
    if not inner:
        return none, none
    return tuple("concat(" + ", ".join(part) + ")" for part in zip(*inner, strict=True))


def _forbidden_key(key: str) -> str:
    plain = f"regexp_replace(lower({key}), '[^a-z0-9]', '')"
    tokens = string_array(t for t in P.FORBIDDEN_NAMES if t != "cc")
    return f"({plain} = 'cc' OR exists({tokens}, _n -> contains({plain}, _n)))"


def outbound_check(payloads: DataFrame, patterns: Iterable[P.Sensitive] = P.SENSITIVE, max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """doc_id, allowed, reasons, payload_size for every row; anything unclear is blocked.

    Checks the names of all columns and the keys of all maps at any depth, the
    size of the row as it would be sent, and its content: every value as it
    is, and once more after its name, since some findings need both.  Values
    are never read from their serialised form, whose escapes could hide or
    make up findings.
    """
    fields = [c for c in payloads.columns if c != "doc_id"]
    named = [f"FORBIDDEN_NAME:{n}" for n in forbidden_columns(payloads.drop("doc_id"))]
    texts, keys = _leaves("_row", D.StructType([payloads.schema[c] for c in fields]), "''")
    body = payloads.select("doc_id", F.struct(*fields).alias("_row"))
    body = body.select("doc_id", F.expr("octet_length(to_json(_row))").alias("payload_size"), F.expr(texts).alias("_texts"), F.expr(keys).alias("_keys"))
    kinds = f"array_distinct(flatten(transform(_texts, _leaf -> transform({P.scan('_leaf', tuple(patterns))}, _f -> _f.kind))))"
    reasons = (
        f"concat({string_array(named)}, transform(array_sort(array_distinct(filter(_keys, _k -> {_forbidden_key('_k')}))), _k -> concat('FORBIDDEN_NAME:', _k)),"
        f" transform(array_sort({kinds}), _k -> concat('SENSITIVE_CONTENT:', _k)),"
        f" CASE WHEN payload_size > {max_bytes} THEN array('PAYLOAD_TOO_LARGE') ELSE cast(array() AS array<string>) END)"
    )
    out = body.select("doc_id", F.expr(f"coalesce({reasons}, array('CHECK_ERROR'))").alias("reasons"), "payload_size")
    return out.select("doc_id", F.expr("size(reasons) = 0").alias("allowed"), "reasons", "payload_size")


def secret_scan(lines: DataFrame) -> DataFrame:
    """path, line_no, kind, preview of secrets in text lines (path, line_no, value)."""
    found = (
        f"transform({P.scan('value', P.SECRETS)}, _f -> named_struct('kind', _f.kind,"
        f" 'preview', {P.preview('substring(value, _f.start + 1, _f.end - _f.start)')}))"
    )
    return explode_structs(lines, found, ["path", "line_no"])
