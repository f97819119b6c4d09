"""What a text replacement really changed, and other string work that SQL has no expression for."""

from __future__ import annotations

import difflib
import json
import math
import re
import shlex
import unicodedata
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT = "old_bytes long, new_bytes long, total_bytes long, prefix_bytes long, suffix_bytes long, core_old_bytes long, core_new_bytes long, core_bytes long, inflation double"


def shared_ends(a: str, b: str) -> tuple[int, int]:
    """Characters shared at the start, and then at the end of what is left."""
    head = len(commonprefix([a, b]))
    return head, len(commonprefix([a[head:][::-1], b[head:][::-1]]))


def _replacement(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    rows = []
    for a, b in zip(old.fillna(""), new.fillna(""), strict=True):
        head, tail = shared_ends(a, b)
        core_a, core_b = size(a[head : len(a) - tail]), size(b[head : len(b) - tail])
        total, core = size(a) + size(b), core_a + core_b
        rows.append((size(a), size(b), total, size(a[:head]), size(a[len(a) - tail :]), core_a, core_b, core, total / core if core else None))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in REPLACEMENT.split(", ")])


def replacement(old: str | Column, new: str | Column) -> Column:
    """Bytes of a replacement, those outside its shared ends (the core), and total over core (null without core)."""
    return F.pandas_udf(_replacement, REPLACEMENT)(old, new)


def _common_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(commonprefix([x, y]).encode("utf-16-le")) // 2 for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="int64")


def common_prefix(a: str | Column, b: str | Column) -> Column:
    """Length of the common start in UTF-16 units."""
    return F.pandas_udf(_common_prefix, "long")(a, b)


CUT = "content string, truncated boolean, truncated_by string, total_lines long, total_bytes long, output_lines long, output_bytes long, last_line_partial boolean, first_line_exceeds boolean"


def cut(text: str, most_lines: int, most_bytes: int, tail: bool) -> tuple:
    """Whole lines from one end within both limits. From the tail, a last line over the limit is cut itself."""
    raw = [x.encode() for x in text.split("\n")]
    total = sum(map(len, raw)) + len(raw) - 1
    if len(raw) <= most_lines and total <= most_bytes:
        return text, False, None, len(raw), total, len(raw), total, False, False
    if not tail and len(raw[0]) > most_bytes:
        return "", True, "bytes", len(raw), total, 0, 0, False, True
    taken, used = [], 0
    for line in reversed(raw) if tail else raw:
        need = len(line) + bool(taken)
        if len(taken) == most_lines or used + need > most_bytes:
            break
        taken.append(line)
        used += need
    by, partial = ("lines" if len(taken) == most_lines else "bytes"), False
    if tail and not taken and most_lines > 0:
        end = raw[-1][len(raw[-1]) - most_bytes :] if most_bytes else b""
        taken, partial = [re.sub(rb"^[\x80-\xbf]+", b"", end)], True
    out = b"\n".join(taken[::-1] if tail else taken)
    return out.decode(), True, by, len(raw), total, len(taken), len(out), partial, False


def truncated(tail: bool, most_lines: int = 2000, most_bytes: int = 50 * 1024):  # noqa: ANN201
    """Column function text -> struct of the cut text and what was cut."""

    @F.pandas_udf(CUT)
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, most_lines, most_bytes, tail) for t in text.fillna("")], columns=[c.split()[0] for c in CUT.split(", ")])

    return run


#: fixed values: characters that compare as plain quotes, dashes and spaces
_QUOTES = str.maketrans(dict.fromkeys("‘’‚‛", "'") | dict.fromkeys("“”„‟", '"') | dict.fromkeys("‐‑‒–—―−", "-") | dict.fromkeys("            　", " "))


def folded(text: str) -> str:
    return "\n".join(line.rstrip() for line in unicodedata.normalize("NFKC", text).split("\n")).translate(_QUOTES)


def _fold(text: pd.Series) -> pd.Series:
    return text.map(folded, na_action="ignore")


def fold(text: str | Column) -> Column:
    return F.pandas_udf(_fold, "string")(text)


def _occurrences(text: pd.Series, part: pd.Series) -> pd.Series:
    return pd.Series([folded(t).count(folded(p)) if t and p else 0 for t, p in zip(text, part, strict=True)], dtype="int64")


def occurrences(text: str | Column, part: str | Column) -> Column:
    """Places of a part in a text, not overlapping, after folding; an empty part has none."""
    return F.pandas_udf(_occurrences, "long")(text, part)


def edited(text: str, edits: list[tuple[str, str]]) -> str:
    """All replacements at once; each old text must stand once, and none may overlap."""
    spans = []
    for old, new in edits:
        if not old or text.count(old) != 1:
            raise ValueError("could not find the exact text" if not old or old not in text else "found multiple occurrences")
        spans.append((text.index(old), len(old), new))
    spans.sort()
    if any(a + n > b for (a, n, _), (b, _, _) in zip(spans, spans[1:], strict=False)):
        raise ValueError("edits must not overlap")
    for at, n, new in reversed(spans):
        text = text[:at] + new + text[at + n :]
    return text


def _edit(text: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
    def one(t: str | None, a: str | None, b: str | None) -> tuple[str | None, str | None]:
        try:
            return edited(t or "", [(a or "", b or "")]), None
        except ValueError as e:
            return None, str(e)

    return pd.DataFrame([one(*x) for x in zip(text, old, new, strict=True)], columns=["text", "error"])


def edit(text: str | Column, old: str | Column, new: str | Column) -> Column:
    """Struct of the text with one replacement made, or of why it could not be."""
    return F.pandas_udf(_edit, "text string, error string")(text, old, new)


def _mapped(function, kind: str):  # noqa: ANN001, ANN202
    """A column function that applies a function of strings row by row, null to null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else function(*row) for row in zip(*columns, strict=True)], dtype=object)

    run.__annotations__ = {}
    return lambda *columns: F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)(*columns)


def line_diff(old: str, new: str, context: int = 4) -> str:
    return "\n".join(list(difflib.unified_diff(old.split("\n"), new.split("\n"), lineterm="", n=context))[2:])


def arguments(line: str) -> list[str]:
    """Words of a command line, quotes taken off; an open quote ends with the line."""
    try:
        return shlex.split(line)
    except ValueError:
        return line.replace('"', "").replace("'", "").split()


def substituted(template: str, args: list[str]) -> str:
    """$1.., ${@:first:count}, $ARGUMENTS and $@ filled in; what is missing is empty."""

    def fill(m: re.Match) -> str:
        if m["n"]:
            i = int(m["n"])
            return args[i - 1] if 0 < i <= len(args) else ""
        if m["first"]:
            first = max(int(m["first"]) - 1, 0)
            return " ".join(args[first : first + int(m["count"]) if m["count"] else None])
        return " ".join(args)

    return re.sub(r"\$(?P<n>\d+)|\$\{@:(?P<first>\d+)(?::(?P<count>\d+))?\}|\$ARGUMENTS|\$@", fill, template)


def repaired_json(text: str) -> str:
    """Control characters and stray escapes inside strings made legal."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            following = text[i + 1 : i + 2]
            legal = following in '"\\/bfnrt' and following != "" or re.match(r"u[0-9a-fA-F]{4}", text[i + 1 : i + 6])
            out.append(c + following if legal else "\\\\")
            i += 2 if legal else 1
            continue
        if c == '"':
            inside = not inside
        out.append(json.dumps(c)[1:-1] if inside and c < " " else c)
        i += 1
    return "".join(out)


def open_json(text: str) -> tuple[bool, str]:
    """Whether a text breaks off inside a value, and the brackets and quotes that would close it."""
    stack, inside, escaped = [], False, False
    for c in text:
        if inside:
            escaped, inside = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return inside or bool(stack), ('"' if inside else "") + "".join(reversed(stack))


def streamed_json(text: str) -> dict:
    """The object that a text cut off anywhere holds so far; empty where there is none."""
    for end in range(len(text), 0, -1):
        if end < len(text) and text[end - 1] not in '"}]0123456789eltsn{[,:':
            continue
        part = text[:end].rstrip().rstrip(",:")
        for tail in (open_json(part)[1],):
            try:
                value = json.loads(repaired_json(part) + tail)
            except ValueError:
                continue
            if isinstance(value, dict):
                return value
    return {}


def json_object(text: str) -> dict | None:
    """The whole text, a fenced block, or first { to last } as an object."""
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.S)
    for part in (text, fenced[1] if fenced else "", text[text.find("{") : text.rfind("}") + 1]):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def coerced(value: object, kind: str) -> object:
    """A scalar as another JSON type; null becomes its empty value, and what cannot be read stays."""
    if kind in ("number", "integer"):
        if value is None or isinstance(value, bool):
            return int(value or 0)
        if isinstance(value, str) and value.strip():
            try:
                number = float(value)
            except ValueError:
                return value
            whole = math.isfinite(number) and number == int(number)
            return int(number) if whole else number if kind == "number" and math.isfinite(number) else value
    if kind == "boolean":
        if value is None:
            return False
        if isinstance(value, str):
            return {"true": True, "false": False}.get(value, value)
        return bool(value) if value in (0, 1) else value
    if kind == "string":
        return "" if value is None else json.dumps(value) if isinstance(value, (bool, int, float)) else value
    return value


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, _TYPES.get(kind, ()))


def _fits(value: object, schema: dict) -> bool:
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return False
    if "const" in schema and value != schema["const"] or "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        own = schema.get("properties", {})
        return all(k in value for k in schema.get("required", [])) and all(_fits(v, own[k]) for k, v in value.items() if k in own)
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        return all(_fits(v, schema["items"]) for v in value)
    return True


def conformed(value: object, schema: dict) -> object:
    """A value brought to a JSON schema where its scalars can be read so; unions take the first member that fits."""
    for part in schema.get("allOf", []):
        value = conformed(value, part)
    for union in (schema.get("anyOf"), schema.get("oneOf")):
        if union and not any(_fits(value, u) for u in union):
            tried = (conformed(json.loads(json.dumps(value)), u) for u in union)
            value = next((t for t, u in ((t, u) for t, u in zip(tried, union, strict=True)) if _fits(t, u)), value)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        value = next((c for c in (coerced(value, k) for k in kinds) if c is not value and c != value or type(c) is not type(value)), value)
    if isinstance(value, dict) and "object" in kinds:
        own, rest = schema.get("properties", {}), schema.get("additionalProperties")
        return {k: conformed(v, own[k]) if k in own else conformed(v, rest) if isinstance(rest, dict) else v for k, v in value.items()}
    if isinstance(value, list) and "array" in kinds:
        items = schema.get("items")
        if isinstance(items, list):
            return [conformed(v, items[i]) if i < len(items) else v for i, v in enumerate(value)]
        return [conformed(v, items) for v in value] if isinstance(items, dict) else value
    return value


def short_hash(text: str) -> str:
    """Two mixed 32-bit lanes over UTF-16 units, in base 36. The four multipliers and two seeds are fixed values."""
    low = (1 << 32) - 1
    seeds, steps, ends = (0xDEADBEEF, 0x41C6CE57), (2654435761, 1597334677), (2246822507, 3266489909)
    raw = text.encode("utf-16-le", "surrogatepass")
    lanes = list(seeds)
    for i in range(0, len(raw), 2):
        unit = raw[i] | raw[i + 1] << 8
        lanes = [(x ^ unit) * m & low for x, m in zip(lanes, steps, strict=True)]
    for a in (0, 1):
        x, y = lanes[a], lanes[1 - a]
        lanes[a] = ((x ^ x >> 16) * ends[0] ^ (y ^ y >> 13) * ends[1]) & low

    def base36(n: int) -> str:
        out = ""
        while n:
            n, d = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out or "0"

    return base36(lanes[1]) + base36(lanes[0])


def json_conformed(schema: dict):  # noqa: ANN201
    """Column function: a JSON text brought to a schema; null where it is no JSON."""

    def run(text: str) -> str | None:
        try:
            return json.dumps(conformed(json.loads(text), schema), ensure_ascii=False)
        except ValueError:
            return None

    return _mapped(run, "string")


def _dumped(value: dict | None) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False)


#: column functions of the functions above
diff = _mapped(line_diff, "string")
words = _mapped(arguments, "array<string>")
filled = _mapped(lambda template, args: substituted(template, list(args)), "string")
json_repaired = _mapped(repaired_json, "string")
json_open = _mapped(lambda t: open_json(t)[0], "boolean")
json_streamed = _mapped(lambda t: _dumped(streamed_json(t)), "string")
json_found = _mapped(lambda t: _dumped(json_object(t)), "string")
