"""RFC 6901 JSON pointers into text columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(pointer: str) -> list[str]:
    """Tokens of a pointer; raises ValueError if it isn't one."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError("a JSON pointer is empty or starts with /")
    if re.search(r"~(?![01])", pointer):
        raise ValueError("~ must be followed by 0 or 1")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def variant_path(tokens: list[str]) -> str:
    """The path in the variant functions' notation."""
    return "$" + "".join(f"[{t}]" if re.fullmatch(r"0|[1-9][0-9]*", t) else '["' + t.replace("\\", "\\\\").replace('"', '\\"') + '"]' for t in tokens)


def value_at(text: Column, pointer: str, under: tuple[str, ...] = ("args",)) -> Column:
    """The value at ``pointer`` below ``under``: strings raw, others as compact JSON, JSON null as ``null``.

    Text that isn't JSON, and pointers to nothing, give null.
    """
    found = F.variant_get(F.try_parse_json(text), variant_path([*under, *parse(pointer)]), "variant")
    raw = F.schema_of_variant(found) == "STRING"
    return F.when(raw, F.try_variant_get(found, "$", "string")).otherwise(F.to_json(found))


def plain_value(pointer: str | None, text: str | None, under: tuple[str, ...] = ("args",)) -> str | None:
    """``value_at`` of one text, for pointers that differ from row to row."""
    if pointer is None or text is None:
        return None
    try:
        found = json.loads(text)
        for t in [*under, *parse(pointer)]:
            found = found[int(t)] if isinstance(found, list) else found[t]
    except (ValueError, KeyError, IndexError, TypeError):
        return None
    return found if isinstance(found, str) else json.dumps(found, ensure_ascii=False, separators=(",", ":"))
