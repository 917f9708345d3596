"""Strict JSON reading for untrusted bodies, with no limit on nesting depth."""

from __future__ import annotations

import json
import re

_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


class Decimal(float):
    """A number that its text wrote with a point or an exponent."""


def _refuse(word: str):
    raise ValueError(f"{word} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse)
_STRING = json.JSONDecoder()


def parse(text: str):
    """Value of a JSON text; ValueError where the text is not valid JSON.

    The C decoder does the work.  Where nesting exceeds its recursion limit an
    explicit stack takes over, so follow-ups may nest to any depth.
    """
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """Iterative decoder: one stack entry for each open array or object."""
    at, size, done, root = 0, len(text), False, None
    stack: list = []  # [container, pending key]

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def put(value) -> None:
        nonlocal root, done
        if not stack:
            root, done = value, True
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(value)
        else:
            stack[-1][0][stack[-1][1]] = value

    def key(i: int) -> int:
        i = skip(i)
        if text[i : i + 1] != '"':
            raise ValueError(f"name expected at {i}")
        stack[-1][1], i = _STRING.raw_decode(text, i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"colon expected at {i}")
        return i + 1

    expect = True  # a value is due
    while True:
        at = skip(at)
        if at >= size:
            break
        ch = text[at]
        if expect:
            if done:
                raise ValueError("extra data")
            if ch in "[{":
                close = "]" if ch == "[" else "}"
                after = skip(at + 1)
                new = [] if ch == "[" else {}
                if text[after : after + 1] == close:
                    put(new)
                    at, expect = after + 1, False
                    continue
                stack.append([new, None])
                at = at + 1 if ch == "[" else key(at + 1)
                continue
            if ch == '"':
                value, at = _STRING.raw_decode(text, at)
            elif m := _NUMBER.match(text, at):
                value, at = (float if m[1] or m[2] else int)(m[0]), m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise ValueError(f"value expected at {at}")
                value, at = _WORDS[word], at + len(word)
            put(value)
            expect = False
        else:
            if not stack:
                raise ValueError("extra data")
            holds_list = isinstance(stack[-1][0], list)
            if ch == ",":
                at = at + 1 if holds_list else key(at + 1)
                expect = True
            elif ch == ("]" if holds_list else "}"):
                value = stack.pop()[0]
                put(value)
                at += 1
            else:
                raise ValueError(f"comma or end expected at {at}")
    if stack or not done:
        raise ValueError("cut off")
    return root


def opened(value):
    """A structure that stands as JSON text inside a string, opened; else the value."""
    while isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
        try:
            inner = parse(value)
        except ValueError:
            return value
        value = inner
    return value
