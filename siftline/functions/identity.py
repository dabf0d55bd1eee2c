"""Document identity and content keys as SQL expressions."""

from __future__ import annotations

from siftline.functions.sql import quote
from siftline.functions.text import strip


def normalized_message_id(message_id: str) -> str:
    bare = f"regexp_replace({strip(f'coalesce({message_id}, {quote('')})')}, '^[<>]+|[<>]+$', '')"
    return f"lower({strip(bare)})"


def document_identity(message_id: str, raw_hash: str) -> str:
    """``MID:`` and a hash of the message id, else ``RAW:`` and the hash of the bytes."""
    mid = normalized_message_id(message_id)
    return f"CASE WHEN {mid} <> '' THEN concat('MID:', sha2({mid}, 256)) ELSE concat('RAW:', {raw_hash}) END"


def content_key(message_id: str, body_hash: str, body: str, child_hashes: str) -> str:
    """Key for review: message id, else body hash, else body, else children.  Never subject, sender or date."""
    mid = normalized_message_id(message_id)
    return (
        f"CASE WHEN {mid} <> '' THEN concat('MID:', {mid})"
        f" WHEN trim(coalesce({body_hash}, '')) <> '' THEN concat('HASH:', trim({body_hash}))"
        f" WHEN {strip(f'coalesce({body}, {quote('')})')} <> '' THEN concat('HASH:', sha2({body}, 256))"
        f" WHEN size({child_hashes}) > 0 THEN concat('HASH:', sha2(array_join({child_hashes}, '|'), 256))"
        " ELSE '' END"
    )


def secondary_dedup_key(*parts: str) -> str:
    joined = ", ".join(f"coalesce(cast({p} AS string), '')" for p in parts)
    return f"sha2(concat_ws('|', {joined}), 256)"
