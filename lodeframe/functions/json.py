"""JSON bodies that are cut off."""

from __future__ import annotations

import json


def repair(body: str | None) -> str | None:
    """Closes open strings, lists and objects; drops what can't be completed at the end; None if nothing is left."""
    if body is None:
        return None
    for end in range(len(body), 0, -1):
        open_, inside, escaped = [], False, False
        for c in body[:end]:
            if inside:
                inside, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                inside = True
            elif c in "{[":
                open_.append("}" if c == "{" else "]")
            elif c in "}]" and open_:
                open_.pop()
        tried = (body[:end] + '"' * inside).rstrip().rstrip(",") + "".join(reversed(open_))
        try:
            json.loads(tried)
            return tried
        except ValueError:
            continue
    return None
