"""JSON texts read and written without loss: numbers of any length, nesting of any depth.

The usual text goes through the parser of the standard library.  What that can't take
(nesting beyond its stack) is read token by token with a stack of its own; numbers that
would not come back as they were are kept as their text.
"""

from __future__ import annotations

import json
import re

#: Digits up to which a number is held as an int or float.
MAX_DIGITS = 15
_BLANK = " \t\r\n"
_TOKEN = re.compile(
    r"[ \t\r\n]*(?:(?P<sign>[{}\[\],:])|(?P<text>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*+\")"
    r"|(?P<number>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(?P<word>true|false|null))"
)
_WORDS = {"true": True, "false": False, "null": None}


class Number:
    """A number that is only known by its text."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Number) and other.text == self.text

    def __hash__(self) -> int:
        return hash(self.text)


def _whole(text: str) -> int | Number:
    return int(text) if len(text) <= MAX_DIGITS else Number(text)


def _real(text: str) -> float | Number:
    if len(text) <= MAX_DIGITS:
        value = float(text)
        if repr(value) == text:
            return value
    return Number(text)


def _no_constant(name: str) -> None:
    raise ValueError(name)


#: Decoders by whether NaN and Infinity are numbers: first one that makes ints of all whole
#: numbers, then one for texts with numbers too long for that.
_DECODERS = {
    lenient: [json.JSONDecoder(parse_constant=None if lenient else _no_constant, parse_int=whole, parse_float=_real, strict=True) for whole in (None, _whole)]
    for lenient in (False, True)
}
#: JSON types of values as they are read (null has none).
KINDS = {str: "string", bool: "boolean", int: "number", float: "number", Number: "number", dict: "object", list: "array"}


def kind_of(value: object) -> str | None:
    return KINDS.get(type(value))


def parse(text: str, lenient: bool = False) -> object:
    """The value of an RFC 8259 text; ValueError for anything else.  Of repeated names the
    last counts.  NaN and Infinity pass where ``lenient``."""
    body = text.strip(_BLANK)
    quick, exact = _DECODERS[lenient]
    try:
        try:
            value, end = quick.raw_decode(body)
        except json.JSONDecodeError:
            raise
        except ValueError:
            value, end = exact.raw_decode(body)
    except RecursionError:
        return _parse_deep(body)
    if end != len(body):
        raise ValueError("text after the value")
    return value


def _parse_deep(text: str) -> object:
    """The same token by token; open containers lie on a list."""
    root: list = []
    # each entry: container, name that waits for its value
    open_: list[list] = [[root, None]]
    # what may come: a value, a name, the end of the container, a comma, a colon
    want, at = {"value"}, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no token at {at}")
        at = m.end()
        top = open_[-1]
        sign = m["sign"]
        if sign in ("}", "]"):
            if "end" not in want or len(open_) == 1 or isinstance(top[0], dict) != (sign == "}"):
                raise ValueError(f"{sign} at {at}")
            open_.pop()
        elif sign == ",":
            if "comma" not in want or len(open_) == 1:
                raise ValueError(f"comma at {at}")
            want = {"name"} if isinstance(top[0], dict) else {"value"}
            continue
        elif sign == ":":
            if "colon" not in want:
                raise ValueError(f"colon at {at}")
            want = {"value"}
            continue
        elif "name" in want:
            if m["text"] is None:
                raise ValueError(f"no name at {at}")
            top[1], want = json.loads(m["text"]), {"colon"}
            continue
        elif "value" not in want:
            raise ValueError(f"value at {at}")
        else:
            if sign:
                value: object = {} if sign == "{" else []
            elif m["text"] is not None:
                value = json.loads(m["text"])
            elif m["number"] is not None:
                value = (_real if set(m["number"]) & set(".eE") else _whole)(m["number"])
            else:
                value = _WORDS[m["word"]]
            if isinstance(top[0], dict):
                top[0][top[1]] = value
            else:
                top[0].append(value)
            if sign:
                open_.append([value, None])
                want = {"name", "end"} if sign == "{" else {"value", "end"}
                continue
        want = {"comma", "end"} if len(open_) > 1 else set()
    if want or len(root) != 1:
        raise ValueError("text ends early")
    return root[0]


def dump(value: object) -> str:
    """Compact JSON text; numbers kept by their text come out as they went in."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except (TypeError, RecursionError):
        pass
    out: list[str] = []
    # Numbers stand for any text that goes out as it is
    todo: list[object] = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Number):
            out.append(v.text)
        elif isinstance(v, dict):
            todo.append(Number("}"))
            for i, (name, x) in reversed(list(enumerate(v.items()))):
                todo += [x, Number("," * (i > 0) + json.dumps(name, ensure_ascii=False) + ":")]
            out.append("{")
        elif isinstance(v, list):
            todo.append(Number("]"))
            for i, x in reversed(list(enumerate(v))):
                todo += [x, Number("," * (i > 0))]
            out.append("[")
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def shown(value: object) -> str | None:
    """A string as it is, null for null, else the JSON text; lone surrogates, which UTF-8
    can't hold, as question marks."""
    if value is None:
        return None
    return (value if isinstance(value, str) else dump(value)).encode("utf-8", "replace").decode()
