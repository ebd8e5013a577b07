"""Go and Java sources to facts, by their tokens: declarations, calls, assignments and imports. Broken files yield what can be told."""

from __future__ import annotations

import re

from codelattice.sources.go_flow import Flow

_GO = re.compile(r"(?P<skip>[ \t\r]+|//[^\n]*|/\*.*?\*/)|(?P<nl>\n)|(?P<text>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<name>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<op>:=|<-|\.\.\.|[-+*/%&|^<>=!]=|&&|\|\||\+\+|--|.)", re.S)
_JAVA = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<name>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>->|::|[-+*/%&|^<>=!]=|&&|\|\||\+\+|--|.)", re.S)
# Words that stand before a bracket without being called.
_NO_CALL = frozenset("if for while switch catch return func function synchronized throw new assert select case defer go range try else do super this sizeof typeof".split())


class _Tokens:
    def __init__(self, pattern: re.Pattern[str], text: str) -> None:
        self.kinds: list[str] = []
        self.words: list[str] = []
        self.lines: list[int] = []
        self.cols: list[int] = []
        line, start = 1, 0
        for m in pattern.finditer(text):
            g = m.lastgroup
            if g not in ("skip",):
                self.kinds.append(g)
                self.words.append(m.group())
                self.lines.append(line)
                self.cols.append(m.start() - start + 1)
            n = m.group().count("\n")
            if n:
                line += n
                start = m.start() + m.group().rfind("\n") + 1

    def close(self, at: int) -> int:
        """The index of the bracket that closes the one at ``at``; the end if none does."""
        pairs = {"(": ")", "[": "]", "{": "}"}
        a, b, depth = self.words[at], pairs[self.words[at]], 0
        for i in range(at, len(self.words)):
            if self.kinds[i] == "op":
                depth += (self.words[i] == a) - (self.words[i] == b)
                if depth == 0:
                    return i
        return len(self.words) - 1

    def split(self, a: int, b: int) -> list[str]:
        """The texts between commas outside of brackets, from a to before b."""
        out, part, depth = [], "", 0
        for i in range(a, b):
            w = self.words[i]
            if self.kinds[i] == "op":
                depth += (w in "([{") - (w in ")]}")
                if w == "," and depth == 0:
                    out.append(part.strip())
                    part = ""
                    continue
            if self.kinds[i] != "nl":
                apart = part and (part[-1].isalnum() and w[:1].isalnum() or part.isidentifier() and part != "map" and w in ("*", "[", "..."))
                part += (" " if apart else "") + w
        return [*out, part.strip()] if part.strip() else out


def _row(kind: str, name: str, fqn: str, line: int, end: int, **more) -> dict:
    return {"type": kind, "name": name, "fqn": fqn, "line": line, "end_line": end, "modifier": "", "return_type": "", "params": [], "bases": [], "annotations": [], "value": "", "doc": "", **more}


def _calls(t: _Tokens, a: int, b: int, scope: str, out: dict) -> None:
    for i in range(a, b):
        if t.words[i] == "(" and i > a and t.kinds[i - 1] == "name" and t.words[i - 1] not in _NO_CALL:
            k = i - 1
            parts = [t.words[k]]
            while k - 2 >= a and t.words[k - 1] == "." and (t.kinds[k - 2] == "name" or t.words[k - 2] == ")"):
                k -= 2
                if t.words[k] == ")":
                    depth = 0
                    while k > a:
                        depth += (t.words[k] == ")") - (t.words[k] == "(")
                        if depth == 0:
                            break
                        k -= 1
                    k -= 1
                    if k < a or t.kinds[k] != "name":
                        break
                parts.append(t.words[k])
            if t.words[max(a, k - 1)] == "func":
                continue
            args = t.split(i + 1, t.close(i))
            plain = re.compile(r"[A-Za-z_]\w*$")
            out["call_sites"].append({"caller_fqn": scope, "target": ".".join(reversed(parts)), "line": t.lines[k], "col": t.cols[k], "arguments": [{"value": v, "is_variable": bool(plain.match(v)), "position": j} for j, v in enumerate(args)]})


def _statement(fqn: str, seq: int, line: int, kind: str, target: str, value: str) -> dict:
    call = re.match(r"(?:\*|&|<-|new )?([A-Za-z_][\w.]*)\s*\(", value)
    args = re.search(r"\((.*)\)\s*$", value, re.S)
    names = [n for n in re.findall(r"(?<![\w.\"])([A-Za-z_]\w*)(?!\w*\s*[(\"])", re.sub(r"\"(?:[^\"\\]|\\.)*\"|`[^`]*`|'[^']*'", "", value)) if n not in _NO_CALL and n not in ("nil", "true", "false", "null", "this")]
    attr = re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)+", value)
    return {"fqn": fqn, "seq": seq, "flat_seq": seq, "block": 0, "line": line, "type": kind, "def": target, "uses": list(dict.fromkeys(names)), "call_target": call.group(1) if call else "", "call_chain": call.group(1) if call else "", "attribute_access": value if attr else "", "call_args": [x.strip() for x in args.group(1).split(",")] if args and call else []}


def _empty() -> dict[str, list[dict]]:
    return {k: [] for k in ("nodes", "call_sites", "statements", "imports", "bindings", "class_attributes", "returns", "cfg_edges")}


def _whole(t: _Tokens, a: int, stop: int) -> int:
    """The end of a body, or, where it is left open by a fault, the token before the next function at the start of a line."""
    return next((k - 1 for k in range(a + 1, stop) if t.words[k] == "func" and t.cols[k] == 1 and t.kinds[k - 1] == "nl"), stop)


def extract_go(text: str, module: str) -> dict[str, list[dict]]:
    t, out = _Tokens(_GO, text), _empty()
    w, n = t.words, len(t.words)
    i = 0
    types: dict[str, str] = {}
    while i < n:
        if w[i] == "import":
            end = _whole(t, i + 1, t.close(i + 1)) if i + 1 < n and w[i + 1] == "(" else next((k for k in range(i, n) if t.kinds[k] == "nl"), n - 1)
            for k in range(i + 1, end + 1):
                if t.kinds[k] == "text":
                    path = w[k][1:-1]
                    alias = w[k - 1] if t.kinds[k - 1] == "name" and w[k - 1] != "import" else path.rpartition("/")[2]
                    out["imports"].append({"alias": alias, "fqn": path, "level": 0, "line": t.lines[k]})
            i = end + 1
        elif w[i] == "func" and i + 1 < n and (i == 0 or t.kinds[i - 1] == "nl"):
            k, receiver = i + 1, ""
            if w[k] == "(":
                e = t.close(k)
                receiver = (t.split(k + 1, e) or [""])[0].rpartition(" ")[2].lstrip("*").partition("[")[0]
                k = e + 1
            name = w[k] if k < n else ""
            fqn = ".".join(x for x in (module, receiver, name) if x)
            k += 1
            if k < n and w[k] == "[":
                k = t.close(k) + 1
            if k >= n or w[k] != "(":
                i += 1
                continue
            e = t.close(k)
            params = t.split(k + 1, e)
            body = next((j for j in range(e, n) if w[j] == "{" and (w[j - 1] not in ("interface", "struct"))), n - 1)
            result = "".join(x + " " for x in t.split(e + 1, body)).strip()
            stop = _whole(t, body, t.close(body)) if w[body] == "{" else body
            kind = "method" if receiver else "init_function" if name == "init" else "function_declaration"
            out["nodes"].append(_row(kind, name, fqn, t.lines[i], t.lines[stop], modifier="public" if name[:1].isupper() else "private", params=params, return_type=result))
            for p in params:
                var, _, typ = p.partition(" ")
                if typ:
                    out["bindings"].append({"scope_fqn": fqn, "var": var, "line": t.lines[i], "type_fqn": typ.replace("...", "[]"), "confidence": 1.0, "source": "annotation"})
            if result:
                out["returns"].append({"fqn": fqn, "type_fqn": result.strip("()").partition(",")[0].strip(), "confidence": 1.0})
            _calls(t, body, stop, fqn, out)
            _go_body(t, body + 1, stop, fqn, out)
            i = stop + 1
        elif w[i] == "type" and i + 2 < n and t.kinds[i + 1] == "name":
            name = w[i + 1]
            kind = {"struct": "struct_definition", "interface": "interface"}.get(w[i + 2], "type_alias")
            end = _whole(t, i + 3, t.close(i + 3)) if kind != "type_alias" and i + 3 < n and w[i + 3] == "{" else i + 2
            out["nodes"].append(_row(kind, name, f"{module}.{name}", t.lines[i], t.lines[min(end, n - 1)], modifier="public" if name[:1].isupper() else "private"))
            if kind == "struct_definition":
                line: list[str] = []
                for k in range(i + 4, end + 1):
                    if t.kinds[k] == "nl" or k == end:
                        if len(line) >= 2:
                            out["class_attributes"].append({"class_fqn": f"{module}.{name}", "name": line[0], "type_fqn": "".join(x for x in line[1:] if x[:1] != "`"), "confidence": 1.0})
                        line = []
                    else:
                        line.append(w[k])
            types[name] = kind
            i = end + 1
        elif w[i] in ("var", "const") and i + 1 < n and t.kinds[i + 1] == "name" and (i == 0 or t.kinds[i - 1] == "nl"):
            end = next((k for k in range(i, n) if t.kinds[k] == "nl"), n)
            out["nodes"].append(_row("package_variable" if w[i] == "var" else "constant", w[i + 1], f"{module}.{w[i + 1]}", t.lines[i], t.lines[i], value=" ".join(w[i + 2 : end])))
            _calls(t, i, end, f"{module}.init$vars", out)
            i = end
        else:
            i += 1
    return out


def _go_body(t: _Tokens, a: int, b: int, fqn: str, out: dict) -> None:
    """Statements and bindings of a body in the order of its lines; then statements get their block and the order of the control flow."""
    flow = Flow(t, a, b)
    rows: list[dict] = []
    line: list[int] = []
    depth = 0
    for i in range(a, b + 1):
        w = t.words[i] if i < b else "\n"
        if i < b and t.kinds[i] == "op":
            depth += (w in "([") - (w in ")]")
        if (i >= b or t.kinds[i] == "nl" or w in ("{", "}", ";")) and depth <= 0:
            words = [t.words[k] for k in line]
            if words:
                text = lambda xs: "".join((" " if p and p[-1].isalnum() and x[:1].isalnum() else "") + x for p, x in zip(["", *xs], xs, strict=False))
                at, have = t.lines[line[0]], len(rows)
                cut = next((k for k, x in enumerate(words) if x in (":=", "=", "+=")), -1)
                if words[0] in ("return", "go", "defer"):
                    rows.append(_statement(fqn, len(rows), at, "return" if words[0] == "return" else "call", "", text(words[1:])))
                elif cut > 0:
                    names = [x for x in words[:cut] if re.fullmatch(r"[A-Za-z_]\w*", x) and x not in ("var", "for", "if", "else", "switch", "case", "const")]
                    if names:
                        row = _statement(fqn, len(rows), at, "assignment", names[0] if names[0] != "_" else "", text(words[cut + 1 :]))
                        row["uses"] = [u for u in row["uses"] if u not in ("range", "map", "string", "int")]
                        rows.append(row)
                        m = re.match(r"&?([A-Z]\w*|[a-z]\w*\.[A-Z]\w*)\{", text(words[cut + 1 :]))
                        kind = m.group(1) if m else f"call:{row['call_target']}" if row["call_target"] else ""
                        if kind:
                            out["bindings"].append({"scope_fqn": fqn, "var": names[0], "line": at, "type_fqn": kind, "confidence": 0.95 if m else 0.9, "source": "go_variable_binding"})
                elif "(" in words:
                    rows.append(_statement(fqn, len(rows), at, "call", "", text(words)))
                if len(rows) > have and rows[-1]["type"] == "call" and rows[-1]["call_target"] in ("", "func"):
                    rows.pop()  # the pieces of a function literal call nothing by name
                if len(rows) > have:
                    rows[-1]["block"] = flow.block_of.get(line[0], rows[have - 1]["block"] if have else 0)
            line = []
        elif i < b and t.kinds[i] != "nl":
            line.append(i)
    place = {block: k for k, block in enumerate(flow.order())}
    for seq, row in enumerate(sorted((r for r in rows if r["block"] in place), key=lambda r: (place[r["block"]], r["flat_seq"]))):
        out["statements"].append({**row, "seq": seq})
    out["cfg_edges"] += [{"fqn": fqn, "src": x, "dst": y, "kind": kind} for x, y, kind in flow.edges]


def extract_java(text: str, module: str) -> dict[str, list[dict]]:
    t, out = _Tokens(_JAVA, text), _empty()
    w, n = t.words, len(t.words)
    package = ""
    stack: list[tuple[str, int]] = []  # open types: name and the brace depth of their bodies
    depth, begin = 0, 0
    i = 0
    while i < n:
        if w[i] == "package" and depth == 0:
            end = w.index(";", i) if ";" in w[i:] else n - 1
            package = "".join(w[i + 1 : end])
            i = end
        elif w[i] == "import" and depth == 0:
            end = w.index(";", i) if ";" in w[i:] else n - 1
            path = "".join(x for x in w[i + 1 : end] if x != "static")
            out["imports"].append({"alias": path.rpartition(".")[2], "fqn": path, "level": 0, "line": t.lines[i]})
            i = end
        elif w[i] in ("class", "interface", "enum", "record") and i + 1 < n and t.kinds[i + 1] == "name" and (i == 0 or w[i - 1] != "."):
            body = next((k for k in range(i, n) if w[k] == "{"), n - 1)
            fqn = ".".join(x for x in (package, *(s for s, _ in stack), w[i + 1]) if x)
            bases = [x for k, x in enumerate(w[i + 2 : body], i + 2) if t.kinds[k] == "name" and x not in ("extends", "implements", "permits")]
            kind = {"interface": "interface", "enum": "enum"}.get(w[i], "class_declaration")
            out["nodes"].append(_row(kind, w[i + 1], fqn, t.lines[i], t.lines[t.close(body)] if w[body] == "{" else t.lines[i], bases=bases, modifier=next((x for x in w[begin:i] if x in ("public", "private", "protected")), "")))
            stack.append((w[i + 1], depth + 1))
            depth += 1
            i, begin = body, body + 1
        elif w[i] == "{":
            depth += 1
            begin = i + 1
        elif w[i] == "}":
            depth -= 1
            while stack and stack[-1][1] > depth:
                stack.pop()
            begin = i + 1
        elif w[i] == ";":
            head = w[begin:i]
            if stack and depth == stack[-1][1] and "(" not in head[: head.index("=")] if "=" in head else stack and depth == stack[-1][1] and "(" not in head:
                names = [x for x in (head[: head.index("=")] if "=" in head else head) if re.fullmatch(r"[A-Za-z_$][\w$]*", x)]
                if len(names) >= 2:
                    fqn = ".".join(x for x in (package, *(s for s, _ in stack)) if x)
                    out["nodes"].append(_row("variable_declaration", names[-1], f"{fqn}.{names[-1]}", t.lines[begin], t.lines[i], return_type=names[-2], value=" ".join(head[head.index("=") + 1 :]) if "=" in head else ""))
                    out["class_attributes"].append({"class_fqn": fqn, "name": names[-1], "type_fqn": names[-2], "confidence": 1.0})
            begin = i + 1
        elif w[i] == "(" and stack and depth == stack[-1][1] and i > begin and t.kinds[i - 1] == "name" and "=" not in w[begin:i] and (i < 2 or w[i - 2] != "@"):
            e = t.close(i)
            body = next((k for k in range(e, n) if w[k] in ("{", ";")), n - 1)
            name = w[i - 1]
            owner = ".".join(x for x in (package, *(s for s, _ in stack)) if x)
            fqn = f"{owner}.{name}"
            stop = t.close(body) if w[body] == "{" else body
            params = t.split(i + 1, e)
            head = w[begin : i - 1]
            result = head[-1] if head else ""
            out["nodes"].append(_row("method_declaration", name, fqn, t.lines[i - 1], t.lines[stop], params=params, return_type=result, modifier=next((x for x in head if x in ("public", "private", "protected")), ""), annotations=[head[k + 1] for k, x in enumerate(head[:-1]) if x == "@"]))
            for p in params:
                typ, _, var = p.removeprefix("final ").rpartition(" ")
                if typ:
                    out["bindings"].append({"scope_fqn": fqn, "var": var, "line": t.lines[i], "type_fqn": typ, "confidence": 1.0, "source": "annotation"})
            if w[body] == "{":
                _calls(t, body, stop, fqn, out)
                _java_body(t, body + 1, stop, fqn, out)
            i, begin = stop, stop + 1
        i += 1
    return out


def _java_body(t: _Tokens, a: int, b: int, fqn: str, out: dict) -> None:
    line: list[int] = []
    seq = depth = 0
    for i in range(a, b + 1):
        w = t.words[i] if i < b else ";"
        if i < b and t.kinds[i] == "op":
            depth += (w in "([") - (w in ")]")
        if i >= b or (w in (";", "{", "}") and depth <= 0):
            words = [t.words[k] for k in line]
            if words:
                at = t.lines[line[0]]
                text = "".join((" " if p and p[-1].isalnum() and x[:1].isalnum() else "") + x for p, x in zip(["", *words], words, strict=False))
                m = re.match(r"(?:final )?(?:[A-Za-z_][\w.<>, \[\]]* )?([A-Za-z_]\w*)\s*=(?!=)\s*(.*)$", text, re.S)
                if words[0] == "return":
                    out["statements"].append(_statement(fqn, seq, at, "return", "", text[6:].strip()))
                    seq += 1
                elif m:
                    out["statements"].append(_statement(fqn, seq, at, "assignment", m.group(1), m.group(2)))
                    c = re.match(r"new ([A-Za-z_][\w.]*)", m.group(2))
                    if c:
                        out["bindings"].append({"scope_fqn": fqn, "var": m.group(1), "line": at, "type_fqn": c.group(1), "confidence": 0.95, "source": "constructor"})
                        out["nodes"].append(_row("ClassInstanceExpr", c.group(1), f"{fqn}.{c.group(1)}", at, at))
                    seq += 1
                elif "(" in words and words[0] not in _NO_CALL:
                    out["statements"].append(_statement(fqn, seq, at, "call", "", text))
                    seq += 1
            line = []
        elif i < b:
            line.append(i)
