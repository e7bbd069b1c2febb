"""Configuration files of the driver: a reader for the plain part of YAML.

Block mappings and sequences, flow sequences and mappings, plain and quoted scalars and comments are read. Anchors,
aliases, tags, block scalars, several documents and tabs in indentation raise ValueError, as do repeated keys: what
isn't understood isn't guessed.
"""

from __future__ import annotations

import json
import re

_QUOTED = r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'"""
_KEY = re.compile(rf"""({_QUOTED}|[^\s"'\[\]{{}}&*!|>%@`,#?-][^:]*?|-[^\s:][^:]*?)\s*:(?:\s+(.*))?$""")
_PART = re.compile(rf"""\s*({_QUOTED}|[\[\]{{}},]|:(?=[\s,\]}}]|$)|(?:[^\s,\[\]{{}}:]|:(?=[^\s,\]}}])|\s+(?=[^\s,\[\]{{}}:]))+)""")
_COMMENT = re.compile(rf"""((?:{_QUOTED}|[^\s#"']\S*|\s+(?!#)|["'])*?)(?:(?:^|\s+)#.*)?$""")
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


def read_yaml(path: str):
    with open(path, encoding="utf-8") as file:
        return parse_yaml(file.read())


def parse_yaml(text: str):
    """The value of a YAML text; None for an empty one."""
    lines = []
    for raw in text.splitlines():
        body = _COMMENT.fullmatch(raw)[1].rstrip() if "#" in raw else raw.rstrip()
        inner = body.lstrip(" ")
        if inner.startswith("\t") or inner == "---" and lines:
            raise ValueError(f"not read: {raw!r}")
        if inner and inner != "---":
            lines.append((len(body) - len(inner), inner))
    if not lines:
        return None
    value, at = _block(lines, 0)
    if at < len(lines):
        raise ValueError(f"unexpected indentation: {lines[at][1]!r}")
    return value


def _is_item(body: str) -> bool:
    return body == "-" or body.startswith("- ")


def _nested(lines: list, at: int, indent: int, items: bool):
    """The block below a line that ends in its key or dash; items may stand at the key's own indentation."""
    if at < len(lines) and (lines[at][0] > indent or items and lines[at][0] == indent and _is_item(lines[at][1])):
        return _block(lines, at)
    return None, at


def _block(lines: list, at: int):
    indent, body = lines[at]
    if _is_item(body):
        out = []
        while at < len(lines) and lines[at][0] == indent and _is_item(lines[at][1]):
            inner = lines[at][1][1:].lstrip()
            if not inner:
                value, at = _nested(lines, at + 1, indent, False)
            elif _is_item(inner) or _KEY.match(inner):
                lines[at] = (indent + len(lines[at][1]) - len(inner), inner)
                value, at = _block(lines, at)
            else:
                value, at = _value(inner), at + 1
            out.append(value)
    elif _KEY.match(body):
        out = {}
        while at < len(lines) and lines[at][0] == indent and not _is_item(lines[at][1]):
            found = _KEY.match(lines[at][1])
            if not found:
                raise ValueError(f"not a key: {lines[at][1]!r}")
            key = _scalar(found[1])
            if key in out:
                raise ValueError(f"repeated key: {key!r}")
            out[key], at = (_value(found[2]), at + 1) if found[2] else _nested(lines, at + 1, indent, True)
    else:
        out, at = _value(body), at + 1
    if at < len(lines) and lines[at][0] > indent:
        raise ValueError(f"unexpected indentation: {lines[at][1]!r}")
    return out, at


def _value(text: str):
    if text[0] not in "[{":
        return _scalar(text)
    parts, at = [], 0
    while at < len(text):
        found = _PART.match(text, at)
        if not found:
            raise ValueError(f"not read: {text!r}")
        parts.append(found[1])
        at = found.end()
    value = _flow(parts)
    if parts:
        raise ValueError(f"not read: {text!r}")
    return value


def _flow(parts: list):
    """The value that the parts start with; they are taken off."""
    if not parts or parts[0] in ("]", "}", ",", ":"):
        raise ValueError("a value is missing")
    opened = parts.pop(0)
    if opened not in ("[", "{"):
        return _scalar(opened)
    closed, out = ("]", []) if opened == "[" else ("}", {})
    while parts and parts[0] != closed:
        key = _flow(parts)
        if closed == "]":
            out.append(key)
        elif parts and parts[0] == ":":
            parts.pop(0)
            out[key] = None if parts and parts[0] in (",", "}") else _flow(parts)
        else:
            raise ValueError(f"no value for {key!r}")
        if parts and parts[0] == ",":
            parts.pop(0)
        elif parts and parts[0] != closed:
            raise ValueError(f"not read: {parts[0]!r}")
    if not parts:
        raise ValueError(f"no {closed}")
    parts.pop(0)
    return out


def _scalar(text: str):
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        return json.loads(text)
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[:1] in set("&*!|>%@`\"'"):
        raise ValueError(f"not read: {text!r}")
    if text in _WORDS:
        return _WORDS[text]
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+)([eE][-+]\d+)?", text):
        return float(text)
    if re.fullmatch(r"[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", text):
        return float(text.replace(".", ""))
    return text
