"""Strict reading of JSON text without building the whole document: sniffing, elements of an array, paths."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import Any

_WHITE = " \t\n\r"
sys.set_int_max_str_digits(0)  # integers of any length are kept digit by digit


class InvalidJson(ValueError):
    """The text isn't strict JSON."""


def _constant(name: str):
    raise InvalidJson(f"{name} is no JSON value")


_decoder = json.JSONDecoder(parse_constant=_constant)


def loads(text: str | bytes) -> Any:
    """Strict: NaN, infinities and anything after the value are errors."""
    try:
        return json.loads(text, parse_constant=_constant)
    except json.JSONDecodeError as error:
        raise InvalidJson(str(error)) from error


_encoder = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))


def dumps(value: Any) -> str:
    return _encoder.encode(value)


def first_mark(text: str | bytes) -> str:
    """The first character that isn't white space; empty if there is none."""
    head = text if isinstance(text, str) else text[:4096].decode("utf-8-sig", "ignore")
    for c in head:
        if c not in _WHITE and c != "﻿":
            return c
    return ""


def is_array_text(text: str | bytes) -> bool:
    return first_mark(text) == "["


def element_texts(text: str | bytes) -> Iterator[str]:
    """The source text of each element of a root array, one at a time.

    A value is decoded to find its end and to reject what is no JSON; its text goes on as it stands, so that no digit
    is lost. Raises InvalidJson for another root, an array without end and anything behind it.
    """
    if isinstance(text, bytes):
        text = text.decode("utf-8-sig")

    def skip(i: int) -> int:
        while i < len(text) and text[i] in _WHITE:
            i += 1
        return i

    at = skip(1 if text.startswith("﻿") else 0)
    if text[at : at + 1] != "[":
        raise InvalidJson("the root is no array")
    at = skip(at + 1)
    if text[at : at + 1] == "]":
        at += 1
    else:
        while True:
            try:
                _, end = _decoder.raw_decode(text, at)
            except json.JSONDecodeError as error:
                raise InvalidJson(str(error)) from error
            yield text[at:end]
            at = skip(end)
            mark = text[at : at + 1]
            at += 1
            if mark == "]":
                break
            if mark != ",":
                raise InvalidJson(f"expected a comma or the array's end at character {at - 1}")
            at = skip(at)
    if skip(at) != len(text):
        raise InvalidJson("there is text behind the array")


def iter_elements(text: str | bytes) -> Iterator[Any]:
    """The decoded elements of a root array, one at a time."""
    return map(loads, element_texts(text))


def walk_path(value: Any, path: str | None) -> Any:
    """The value at a path like $.a.b.0; a part may end in [], which changes nothing."""
    parts = [p for p in (path or "").removeprefix("$").removeprefix(".").split(".") if p]
    for part in parts:
        key = part.removesuffix("[]")
        if isinstance(value, dict):
            value = value.get(key)
        elif isinstance(value, list) and key.isdigit():
            if int(key) >= len(value):
                raise ValueError(f"{path}: index {key} is out of range, the array has {len(value)} elements")
            value = value[int(key)]
        else:
            raise ValueError(f"{path}: cannot go to {key!r}")
        if value is None:
            raise ValueError(f"{path}: not found at {key!r}")
    return value
