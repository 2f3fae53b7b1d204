"""Python files (X1, X7): one text's definitions and calls as flat rows.

A scanner is a plain function of a text that returns rows as dicts tagged ``symbol`` or ``call``; it runs inside ``mapInPandas``
(code.py), one file at a time. Only Python has one, around the standard parser; JavaScript, TypeScript and Go are column functions
(braces.py), and so are the imports of all languages (imports.py). ``scanners=`` of ``code.extract`` adds or replaces one.
"""

from __future__ import annotations

import ast
import re

_LINE_END = re.compile(rb"\r\n|\r|\n")
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def scan_python(text: str) -> list[dict]:
    """Every definition and call with its range; a function belongs to the class whose range is the smallest around it."""
    data, lines = text.encode(), text.split("\n")
    starts = [0, *(m.end() for m in _LINE_END.finditer(data))]
    spans = []                      # byte ranges, outer ones first
    for n in ast.walk(ast.parse(text)):
        if isinstance(n, (*_DEFS, ast.ClassDef, ast.Call)):
            spans.append((starts[n.lineno - 1] + n.col_offset, -starts[n.end_lineno - 1] - n.end_col_offset, n))
    spans.sort(key=lambda s: s[:2])
    rows, around = [], []           # classes that are open where the sweep stands
    for begin, end, n in spans:
        while around and around[-1][0] <= begin:
            around.pop()
        if isinstance(n, ast.Call):
            callee = data[begin:starts[n.func.end_lineno - 1] + n.func.end_col_offset]
            rows.append(dict(tag="call", name=callee.decode(), line=n.lineno, col=n.col_offset))
            continue
        place = dict(tag="symbol", start_line=n.lineno, end_line=n.end_lineno, col=n.col_offset)
        if isinstance(n, ast.ClassDef):
            rows.append(dict(place, name=n.name, kind="class", body="", signature=""))
            around.append((-end, n.name))
            continue
        owner = around[-1][1] if around else None
        rows.append(dict(place, name=f"{owner}.{n.name}" if owner else n.name, kind="method" if owner else "function",
                         body=data[begin:-end].decode(), signature=lines[n.lineno - 1].strip() if n.lineno <= len(lines) else ""))
    return rows


# Extension -> language, and the language switch that enables it.
EXT_LANG = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript",
            ".py": "python", ".go": "go"}
SCANNERS = {"python": scan_python}
#: Languages of braces.py by the rules they share.
BRACED = {"js": ("typescript", "tsx", "javascript"), "go": ("go",)}
