"""Where a model reply may hold JSON: one forward scan per reply, any depth and length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the tags that replies wrap JSON in, in the order they are tried.
TAGS = ["json_output", "output_block", "json", "response", "result", "output"]
_CLOSERS = {"{": "}", "[": "]"}


def tagged(reply: str) -> list[str]:
    """Content of the first element of each known tag. A missing end tag ends with the reply."""
    lower = reply.lower()
    if len(lower) != len(reply):  # letters that change length; tags are ASCII
        lower = "".join(c.lower() if c.isascii() else c for c in reply)
    out = []
    for tag in TAGS:
        at = lower.find("<" + tag)
        while at >= 0 and (after := lower[at + len(tag) + 1 : at + len(tag) + 2]) not in (">", " ", "\n", "\t"):
            at = lower.find("<" + tag, at + 1)
        start = lower.find(">", at) + 1 if at >= 0 else 0
        if start:
            end = lower.find(f"</{tag}", start)
            out.append(reply[start : end if end >= 0 else len(reply)].strip())
    return out


def fenced(reply: str) -> list[str]:
    """Content of each ``` block, without its language word. A missing end ends with the reply."""
    parts = reply.split("```")
    out = []
    for part in parts[1::2]:
        body = part.strip("`").strip()
        out.append(body[4:].strip() if body[:4].lower() == "json" else body)
    return out


def _closed(reply: str, quoted: bool) -> list[tuple[int, int]]:
    """Outermost closed bracket blocks, as [start, end). With `quoted`, brackets inside strings do not count."""
    stack: list[int] = []
    blocks: list[tuple[int, int]] = []
    in_string = skip = False
    for i, char in enumerate(reply):
        if skip:
            skip = False
        elif in_string:
            skip = char == "\\"
            in_string = char != '"'
        elif char == '"':
            in_string = quoted and bool(stack)
        elif char in "{[":
            stack.append(i)
        elif char in "}]" and stack and _CLOSERS[reply[stack[-1]]] == char:
            start = stack.pop()
            while blocks and blocks[-1][0] > start:
                blocks.pop()
            blocks.append((start, i + 1))
    return blocks


def bracketed(reply: str) -> list[str]:
    """Bracket blocks, largest first; blocks found without regard to strings come last."""
    out: dict[str, None] = {}
    for quoted in (True, False):
        found = [reply[a:b] for a, b in _closed(reply, quoted)]
        out.update(dict.fromkeys(sorted(found, key=len, reverse=True)))
    return list(out)


def candidates(reply: str | None) -> dict[str, list[str]]:
    if reply is None:
        return {"tag": [], "fence": [], "bracket": []}
    tags = tagged(reply)
    inner = tags[0] if tags else reply
    return {"tag": tags, "fence": fenced(inner), "bracket": bracketed(inner)}


_LISTS = T.StructType([T.StructField(name, T.ArrayType(T.StringType())) for name in ("tag", "fence", "bracket")])


@F.pandas_udf(_LISTS)
def scan(replies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Candidates of every reply that did not parse as it is (null otherwise)."""
    for part in replies:
        yield pd.DataFrame([candidates(r) for r in part], columns=["tag", "fence", "bracket"])
