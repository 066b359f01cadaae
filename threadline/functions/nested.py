"""Nested comment trees in JSON, read in one pass over their text."""

from __future__ import annotations

import json
import re

#: A string, a bracket or separator, or any other scalar.
TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+)', re.DOTALL)


def scalar(token: str) -> str | None:
    return json.loads(token) if token[0] == '"' else None if token == "null" else token


def comments_of(text: str, fields: list[str]) -> list[tuple[str, int, dict[str, str | None]]]:
    """(id, depth, fields as text) of a tree {id: {fields, "replies": {id: ...}}}, in reading order.

    The text is read once, with a stack in place of recursion, so the depth does
    not matter. A comment without a body goes with all below it; of equal ids
    the last one stays. Values that are objects or lists are kept as written.
    Text that is not such an object raises ValueError.
    """
    wanted = set(fields)
    out: list[tuple[str, int, dict] | None] = []
    stack: list[tuple[dict | None, int]] = []  # of every open object: a comment's fields and its place in `out`, or None for a tree
    at, end = 0, len(text.rstrip())
    key, state = None, "value"

    def take() -> tuple[str, int, int]:
        nonlocal at
        m = TOKEN.match(text, at)
        if m is None:
            raise ValueError("not JSON")
        at = m.end()
        return m[1], m.start(1), m.end()

    def skip(start: int) -> str:
        """The rest of an object or list, as written."""
        open_ = 1
        while open_:
            token, _, stop = take()
            open_ += (token in "{[") - (token in "}]")
        return text[start:stop]

    while at < end or not stack:
        token, start, _ = take()
        if not stack:
            if token != "{" or out:
                raise ValueError("not an object")
            stack.append((None, -1))
            state = "key"
        elif token == "}" and state != "value":
            found, place = stack.pop()
            if found is not None and found.get("body") is None:
                del out[place:]
            state = "next"
            if not stack:
                break
        elif token == "," and state == "next":
            state = "key"
        elif state == "key" and token[0] == '"':
            key, state = json.loads(token), "colon"
        elif state == "colon" and token == ":":
            state = "value"
        elif state == "value" and token not in "}],:":
            inside, state = stack[-1][0], "next"
            if inside is None and token == "{":
                comment: dict[str, str | None] = {}
                stack.append((comment, len(out)))
                out.append((key, len(stack) // 2 - 1, comment))
                state = "key"
            elif inside is not None and key == "replies" and token == "{":
                stack.append((None, -1))
                state = "key"
            else:
                value = skip(start) if token in "{[" else scalar(token)
                if inside is not None and key in wanted:
                    inside[key] = value
        else:
            raise ValueError("not JSON")
    if stack or at < end:
        raise ValueError("not JSON")
    last = {c[0]: i for i, c in enumerate(out)}
    return [c for i, c in enumerate(out) if last[c[0]] == i]
