"""Text of content blocks nested to any depth.

Built-in expressions take the text of strings and of blocks one level down; JSON
that holds containers below those goes to a walk with a stack of its own, in
Arrow batches, so depth costs no recursion and nothing is lost.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Where a block keeps text, in the order it is read.
KEYS = ("text", "content", "message", "input", "output")

#: A container below a block, a list in a list or an object by itself: the built-in expressions don't look into those.
DEEP = r'^\{|[\[,]\[|"(?:content|message|input|output)":[\[{]'


def walked(value: object) -> str:
    """Strings in reading order, trimmed, without blank ones, by newlines; of an object only what KEYS hold, and its text only as a string."""
    out: list[str] = []
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip():
                out.append(x.strip())
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            held = [x[k] for k in KEYS if k in x and (k != "text" or isinstance(x[k], str))]
            stack.extend(reversed(held))
    return "\n".join(out)


@F.arrow_udf(StringType())
def _deep(contents: pa.Array) -> pa.Array:
    out = []
    for c in contents.to_pylist():
        try:
            out.append(None if c is None else walked(json.loads(c)))
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, pa.string())


def deep_text(content: Column) -> Column:
    """Text of JSON content with containers below its blocks; null for other content."""
    return _deep(F.when(content.rlike(DEEP), content))
