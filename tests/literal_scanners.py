"""JavaScript and Go definitions and calls of one text, character by character: what operators/braces.py is compared with."""

import bisect
import re

# ---------------------------------------------------------------------------
# Shared helpers for brace languages


def _blank_strings_and_comments(text: str, backtick_raw: bool) -> str:
    """Replace string/comment characters by spaces, keeping newlines and offsets."""
    out = list(text)
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "/" and i + 1 < n and text[i + 1] == "/":
            j = text.find("\n", i)
            j = n if j < 0 else j
            for k in range(i, j):
                out[k] = " "
            i = j
        elif c == "/" and i + 1 < n and text[i + 1] == "*":
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            for k in range(i, j):
                if text[k] != "\n":
                    out[k] = " "
            i = j
        elif c in "\"'`":
            j = i + 1
            while j < n and text[j] != c:
                if text[j] == "\\" and not (c == "`" and backtick_raw):
                    j += 1
                elif text[j] == "\n" and c != "`":
                    break
                j += 1
            for k in range(i + 1, min(j, n)):
                if text[k] != "\n":
                    out[k] = " "
            i = j + 1
        else:
            i += 1
    return "".join(out)


def _match_brace(masked: str, open_pos: int) -> int:
    depth = 0
    for k in range(open_pos, len(masked)):
        ch = masked[k]
        if ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                return k
    return len(masked) - 1


class _Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def line(self, pos: int) -> int:
        return bisect.bisect_right(self.starts, pos)


_CALL_RE = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$#][\w$]*)*)\s*(?:<[\w$<>,\s\[\]]*>)?\s*\(")

# Words that look like calls but are statements.
_JS_NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await",
                 "new", "delete", "void", "in", "of", "instanceof", "yield", "class", "do", "else",
                 "import", "export", "throw", "case", "with"}
_GO_NOT_CALLS = {"if", "for", "switch", "func", "return", "select", "go", "defer", "range", "case",
                 "else", "type", "struct", "interface", "map", "chan", "package", "import", "var", "const"}


def _calls(text: str, masked: str, lines: _Lines, skip_words: set, def_name_pos: set) -> list[dict]:
    out = []
    for m in _CALL_RE.finditer(masked):
        name = m.group(1)
        first = re.split(r"[\s?.]", name, maxsplit=1)[0]
        if first in skip_words or m.start(1) in def_name_pos:
            continue
        # a name right after 'function'/'func' is a declaration, not a call
        before = masked[max(0, m.start(1) - 10):m.start(1)].rstrip()
        if before.endswith("function") or before.endswith("func") or before.endswith("new"):
            continue
        out.append(dict(tag="call", name=text[m.start(1):m.end(1)], line=lines.line(m.start(1)),
                        col=m.start(1) - lines.starts[lines.line(m.start(1)) - 1]))
    return out


def _sig(text_lines: list[str], line: int) -> str:
    return text_lines[line - 1].strip() if 0 < line <= len(text_lines) else ""


# ---------------------------------------------------------------------------
# JavaScript / TypeScript (X2 definitions, X7 calls)

_JS_FUNC_RE = re.compile(r"(?<![\w$.])(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>{]*>)?\s*\(")
_JS_CLASS_RE = re.compile(r"(?<![\w$.])class\s+([A-Za-z_$][\w$]*)[^{;]*\{")
_JS_METHOD_RE = re.compile(
    r"(?m)^[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*\*?\s*"
    r"([A-Za-z_$#][\w$]*)\s*(?:<[^>{]*>)?\s*\([^)]*\)\s*(?::[^{;]+)?\{")
_JS_ARROW_RE = re.compile(
    r"(?<![\w$.])(?:const|let)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s+)?"
    r"(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=;{]+)?=>")


def scan_js(text: str) -> list[dict]:
    masked = _blank_strings_and_comments(text, backtick_raw=False)
    lines = _Lines(text)
    tlines = text.split("\n")
    out: list[dict] = []
    def_pos: set[int] = set()

    classes = []   # (name, body_open, body_close)
    for m in _JS_CLASS_RE.finditer(masked):
        open_pos = m.end() - 1
        close = _match_brace(masked, open_pos)
        classes.append((m.group(1), open_pos, close))
        out.append(dict(tag="symbol", name=m.group(1), kind="class", start_line=lines.line(m.start()),
                        end_line=lines.line(close), col=m.start(), body="", signature=""))
        def_pos.add(m.start(1))

    def enclosing_class(pos: int):
        best = None
        for name, o, c in classes:
            if o < pos < c and (best is None or o > best[1]):
                best = (name, o, c)
        return best

    def depth_in(o: int, pos: int) -> int:
        seg = masked[o:pos]
        return seg.count("{") - seg.count("}")

    for m in _JS_FUNC_RE.finditer(masked):
        open_pos = masked.find("{", m.end())
        if open_pos < 0:
            continue
        close = _match_brace(masked, open_pos)
        cls = enclosing_class(m.start())
        full = f"{cls[0]}.{m.group(1)}" if cls else m.group(1)
        out.append(dict(tag="symbol", name=full, kind="method" if cls else "function",
                        start_line=lines.line(m.start()), end_line=lines.line(close), col=m.start(),
                        body=text[m.start():close + 1], signature=_sig(tlines, lines.line(m.start()))))
        def_pos.add(m.start(1))

    for name, o, c in classes:
        for m in _JS_METHOD_RE.finditer(masked, o + 1, c):
            if m.group(1) in _JS_NOT_CALLS or depth_in(o, m.start()) != 1:
                continue
            open_pos = m.end() - 1
            close = _match_brace(masked, open_pos)
            start = m.start() + (len(masked[m.start():m.end()]) - len(masked[m.start():m.end()].lstrip()))
            out.append(dict(tag="symbol", name=f"{name}.{m.group(1)}", kind="method",
                            start_line=lines.line(start), end_line=lines.line(close), col=start,
                            body=text[start:close + 1], signature=_sig(tlines, lines.line(start))))
            def_pos.add(m.start(1))

    for m in _JS_ARROW_RE.finditer(masked):
        rest = m.end()
        k = rest
        while k < len(masked) and masked[k] in " \t\n":
            k += 1
        if k < len(masked) and masked[k] == "{":
            end = _match_brace(masked, k) + 1
        else:
            depth, end = 0, k
            while end < len(masked):
                ch = masked[end]
                if ch in "([{":
                    depth += 1
                elif ch in ")]}":
                    if depth == 0:
                        break
                    depth -= 1
                elif ch in ";\n" and depth == 0:
                    break
                end += 1
        if end < len(masked) and masked[end] == ";":
            end += 1
        out.append(dict(tag="symbol", name=m.group(1), kind="function", start_line=lines.line(m.start()),
                        end_line=lines.line(max(m.start(), end - 1)), col=m.start(),
                        body=text[m.start():end], signature=_sig(tlines, lines.line(m.start()))))
        def_pos.add(m.start(1))

    out.extend(_calls(text, masked, lines, _JS_NOT_CALLS, def_pos))
    return out


# ---------------------------------------------------------------------------
# Go (X3 definitions, X7 calls)

_GO_FUNC_RE = re.compile(r"(?m)^func\s+(?:\(([^)]*)\)\s*)?([A-Za-z_][\w]*)\s*(?:\[[^\]]*\])?\s*\(")
_GO_TYPE_RE = re.compile(r"(?m)^type\s+(\()?")
_GO_SPEC_RE = re.compile(r"(?m)^[ \t]*([A-Za-z_][\w]*)\b")


def _go_type_end(masked: str, pos: int) -> int:
    """End offset of a type spec starting at ``pos`` (end of line, or its closing brace)."""
    nl = masked.find("\n", pos)
    nl = len(masked) if nl < 0 else nl
    brace = masked.find("{", pos, nl)
    if brace >= 0:
        close = _match_brace(masked, brace)
        nl2 = masked.find("\n", close)
        return (len(masked) if nl2 < 0 else nl2)
    return nl


def scan_go(text: str) -> list[dict]:
    masked = _blank_strings_and_comments(text, backtick_raw=True)
    lines = _Lines(text)
    tlines = text.split("\n")
    out: list[dict] = []
    def_pos: set[int] = set()

    for m in _GO_FUNC_RE.finditer(masked):
        open_pos = masked.find("{", m.end())
        nl = masked.find("\n", m.end())
        close = _match_brace(masked, open_pos) if open_pos >= 0 else (nl if nl >= 0 else len(masked)) - 1
        name = m.group(2)
        kind = "function"
        if m.group(1) is not None:
            kind = "method"
            params = m.group(1).strip().split()
            rcv = params[-1].lstrip("*") if params else ""
            name = f"{rcv}.{name}" if rcv else name
        out.append(dict(tag="symbol", name=name, kind=kind, start_line=lines.line(m.start()),
                        end_line=lines.line(close), col=m.start(), body=text[m.start():close + 1],
                        signature=_sig(tlines, lines.line(m.start()))))
        def_pos.add(m.start(2))

    for m in _GO_TYPE_RE.finditer(masked):
        if m.group(1):
            close = masked.find(")", m.end())
            close = len(masked) if close < 0 else close
            pos = m.end()
            while pos < close:
                sm = _GO_SPEC_RE.search(masked, pos, close)
                if not sm:
                    break
                end = _go_type_end(masked, sm.start(1))
                out.append(dict(tag="symbol", name=sm.group(1), kind="class", start_line=lines.line(sm.start(1)),
                                end_line=lines.line(max(sm.start(1), end - 1)), col=sm.start(1), body="",
                                signature=""))
                def_pos.add(sm.start(1))
                pos = max(end, sm.end())
        else:
            sm = re.compile(r"[ \t]*([A-Za-z_][\w]*)").match(masked, m.end())
            if sm:
                end = _go_type_end(masked, sm.start(1))
                out.append(dict(tag="symbol", name=sm.group(1), kind="class", start_line=lines.line(sm.start(1)),
                                end_line=lines.line(max(sm.start(1), end - 1)), col=sm.start(1), body="",
                                signature=""))
                def_pos.add(sm.start(1))

    out.extend(_calls(text, masked, lines, _GO_NOT_CALLS, def_pos))
    return out
