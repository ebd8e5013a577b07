"""Python sources to facts, by the interpreter's own syntax tree."""

from __future__ import annotations

import ast
import warnings
from collections import deque

_CALLABLE = (ast.FunctionDef, ast.AsyncFunctionDef)
# Types of literals.
_LITERALS = {str: "builtins.str", int: "builtins.int", float: "builtins.float", bool: "builtins.bool", bytes: "builtins.bytes", complex: "builtins.complex"}
_DISPLAYS = {ast.List: "builtins.list", ast.ListComp: "builtins.list", ast.Dict: "builtins.dict", ast.DictComp: "builtins.dict", ast.Set: "builtins.set", ast.SetComp: "builtins.set", ast.Tuple: "builtins.tuple", ast.JoinedStr: "builtins.str"}


def dotted(node: ast.AST) -> str:
    """``a.b.c`` for attribute chains; calls in between count by their function: ``a().b`` gives ``a.b``."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Name):
            return ".".join([node.id, *reversed(parts)])
        else:
            return ".".join(reversed(parts)) if parts else ""


def _text(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except (ValueError, RecursionError):
        return ""


def _names(node: ast.AST | None) -> list[str]:
    """The variables an expression reads, in order, once each; ``self`` and what calls call are none."""
    out: dict[str, None] = {}
    called: set[int] = set()
    for n in ast.walk(node) if node is not None else ():
        if isinstance(n, ast.Call):
            f = n.func
            while isinstance(f, ast.Attribute):
                f = f.value
            if isinstance(n.func, ast.Name):
                called.add(id(n.func))
        elif isinstance(n, ast.Name) and id(n) not in called and n.id not in ("self", "cls"):
            out[n.id] = None
    return list(out)


def infer(node: ast.AST | None) -> tuple[str, float, str]:
    """(type, confidence, source) of an expression: literals, displays, constructors; ``call:f`` and ``var:v`` as placeholders."""
    if isinstance(node, ast.Constant):
        return (_LITERALS.get(type(node.value), ""), 1.0, "literal") if node.value is not None else ("None", 1.0, "literal")
    for kind, name in _DISPLAYS.items():
        if isinstance(node, kind):
            return name, 1.0, "literal"
    if isinstance(node, ast.Call):
        name = dotted(node.func)
        last = name.rpartition(".")[2]
        return (name, 0.95, "constructor") if last[:1].isupper() else (f"call:{name}", 0.9, "call") if name else ("", 0.0, "")
    if isinstance(node, ast.Name):
        return f"var:{node.id}", 0.85, "assignment"
    if isinstance(node, ast.BoolOp):
        return infer(node.values[-1])
    return "", 0.0, ""


class _Extractor:
    def __init__(self, module: str) -> None:
        self.module = module
        self.out: dict[str, list[dict]] = {k: [] for k in ("nodes", "call_sites", "statements", "imports", "bindings", "class_attributes", "returns", "cfg_edges")}

    def add(self, table: str, **row) -> None:
        self.out[table].append(row)

    def node(self, kind: str, name: str, fqn: str, n: ast.AST, **more) -> None:
        self.add("nodes", type=kind, name=name, fqn=fqn, line=n.lineno, end_line=getattr(n, "end_lineno", n.lineno), **{"modifier": "private" if name.startswith("_") else "public", "return_type": "", "params": [], "bases": [], "annotations": [], "value": "", "doc": "", **more})

    def calls(self, node: ast.AST, scope: str) -> None:
        """Call sites below a node, not those in functions and classes defined there."""
        queue = deque([node])
        while queue:
            n = queue.popleft()
            if isinstance(n, ast.Call):
                args = [_text(a) for a in n.args] + [f"{k.arg}={_text(k.value)}" if k.arg else f"**{_text(k.value)}" for k in n.keywords]
                plain = [isinstance(a, ast.Name) for a in n.args] + [False] * len(n.keywords)
                if name := dotted(n.func):
                    self.add("call_sites", caller_fqn=scope, target=name, line=n.lineno, col=n.col_offset + 1, arguments=[{"value": v, "is_variable": p, "position": i} for i, (v, p) in enumerate(zip(args, plain, strict=True))])
            queue.extend(c for c in ast.iter_child_nodes(n) if not isinstance(c, (*_CALLABLE, ast.ClassDef)))

    def body(self, body: list[ast.stmt], scope: str, cls: str = "") -> None:
        for n in body:
            if isinstance(n, _CALLABLE):
                self.function(n, scope, cls)
            elif isinstance(n, ast.ClassDef):
                self.klass(n, scope)
            elif isinstance(n, ast.Import | ast.ImportFrom):
                self.import_(n)
            else:
                self.assigned(n, scope, cls)
                for inner in ast.iter_child_nodes(n):
                    if isinstance(inner, ast.stmt):
                        self.body([inner], scope, cls)
                    elif isinstance(inner, ast.ExceptHandler | ast.match_case):
                        self.body(inner.body, scope, cls)
                    elif isinstance(inner, ast.expr | ast.withitem):
                        self.calls(inner, scope)

    def import_(self, n: ast.Import | ast.ImportFrom) -> None:
        base = getattr(n, "module", None) or ""
        for a in n.names:
            full = f"{base}.{a.name}".strip(".") if isinstance(n, ast.ImportFrom) else a.name
            alias = a.asname or (a.name if isinstance(n, ast.ImportFrom) else a.name.partition(".")[0])
            self.add("imports", alias=alias, fqn=full if a.asname or isinstance(n, ast.ImportFrom) else alias, level=getattr(n, "level", 0) or 0, line=n.lineno)

    def assigned(self, n: ast.stmt, scope: str, cls: str) -> None:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign | ast.AugAssign) else []
        for t in targets:
            if isinstance(t, ast.Name):
                value = getattr(n, "value", None)
                kind, sure, how = (_text(n.annotation), 1.0, "annotation") if isinstance(n, ast.AnnAssign) else infer(value)
                constant = t.id.upper() == t.id and any(c.isalpha() for c in t.id) and t.id.replace("_", "").isalnum()
                where = "class_field" if cls else "constant" if constant and scope == self.module else "module_variable" if scope == self.module else "variable_assignment"
                self.node(where, t.id, f"{scope}.{t.id}", n, return_type=kind, value=_text(value) if value is not None else "")
                if kind:
                    self.add("bindings", scope_fqn=scope, var=t.id, line=n.lineno, type_fqn=kind, confidence=sure, source=how)
                if cls and kind:
                    self.add("class_attributes", class_fqn=cls, name=t.id, type_fqn=kind, confidence=sure)

    def klass(self, n: ast.ClassDef, scope: str) -> None:
        fqn = f"{scope}.{n.name}" if scope else n.name
        bases = [b for b in (dotted(x) for x in n.bases) if b]
        decorators = [dotted(d) for d in n.decorator_list]
        last = {b.rpartition(".")[2] for b in bases}
        kind = "enum" if last & {"Enum", "IntEnum", "StrEnum", "Flag"} else "interface" if last & {"Protocol", "ABC"} else "dataclass" if any(d.rpartition(".")[2] == "dataclass" for d in decorators) else "class_definition"
        self.node(kind, n.name, fqn, n, bases=bases, annotations=decorators, doc=ast.get_docstring(n) or "")
        for d in n.decorator_list:
            self.calls(d, scope)
        self.body(n.body, fqn, fqn)

    def function(self, n: ast.FunctionDef | ast.AsyncFunctionDef, scope: str, cls: str) -> None:
        fqn = f"{scope}.{n.name}" if scope else n.name
        decorators = [dotted(d) for d in n.decorator_list]
        kind = "function_definition"
        if n.name == "__init__":
            kind = "constructor"
        elif n.name.startswith("__") and n.name.endswith("__"):
            kind = "special_method"
        elif cls:
            kind = "method"
        if any(d.rpartition(".")[2] in ("property", "cached_property") for d in decorators):
            kind = "property"
        a = n.args
        params = [x for x in [*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg] if x is not None]
        shown = [p.arg + (f": {_text(p.annotation)}" if p.annotation else "") for p in params]
        self.node(kind, n.name, fqn, n, return_type=_text(n.returns) if n.returns else "", params=shown, annotations=decorators, doc=ast.get_docstring(n) or "")
        for p in params:
            if p.annotation is not None and p.arg not in ("self", "cls"):
                self.node("parameter", p.arg, f"{fqn}.{p.arg}", p, return_type=_text(p.annotation))
                self.add("bindings", scope_fqn=fqn, var=p.arg, line=n.lineno, type_fqn=_text(p.annotation), confidence=1.0, source="annotation")
        if n.returns is not None:
            self.add("returns", fqn=fqn, type_fqn=_text(n.returns), confidence=1.0)
        own = [x for x in self._own(n)]
        for x in own:
            if isinstance(x, ast.Return) and x.value is not None and (r := infer(x.value))[0]:
                self.add("returns", fqn=fqn, type_fqn=r[0], confidence=r[1])
            if cls and isinstance(x, ast.Assign):
                for t in x.targets:
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and (r := infer(x.value))[0]:
                        known = {p.arg: _text(p.annotation) for p in params if p.annotation}
                        v = known.get(r[0][4:], r[0]) if r[0].startswith("var:") else r[0]
                        self.add("class_attributes", class_fqn=cls, name=t.attr, type_fqn=v, confidence=r[1])
        for d in [*n.decorator_list, *a.defaults, *(k for k in a.kw_defaults if k)]:
            self.calls(d, scope)
        self.body(n.body, fqn)
        self.flow(n, fqn)

    @staticmethod
    def _own(n: ast.AST):
        queue = deque(ast.iter_child_nodes(n))
        while queue:
            x = queue.popleft()
            yield x
            if not isinstance(x, (*_CALLABLE, ast.ClassDef, ast.Lambda)):
                queue.extend(ast.iter_child_nodes(x))

    # Control flow and statements

    def flow(self, n: ast.FunctionDef | ast.AsyncFunctionDef, fqn: str) -> None:
        blocks: list[list[dict]] = [[]]
        edges: list[tuple[int, int, str]] = []
        flat = 0

        def block() -> int:
            blocks.append([])
            return len(blocks) - 1

        def emit(at: int, s: ast.stmt, kind: str, target: str = "", value: ast.AST | None = None) -> None:
            nonlocal flat
            call = value.value if isinstance(value, ast.Await) else value
            is_call = isinstance(call, ast.Call)
            head = call
            while isinstance(head, ast.Subscript | ast.Await):
                head = head.value
            blocks[at].append({
                "fqn": fqn, "flat_seq": flat, "block": at, "line": s.lineno, "type": kind, "def": target, "uses": _names(value), "call_target": _text(call) if is_call and target else dotted(call) if is_call else "",
                "call_chain": dotted(call) if is_call else "", "attribute_access": dotted(head) if isinstance(head, ast.Attribute) else "", "call_args": [_text(x) for x in call.args] if is_call else [],
            })
            flat += 1

        def run(body: list[ast.stmt], at: int | None, loop: tuple[int, int] | None) -> int | None:
            """Lays out statements from block ``at``; the block where control goes on, None where it doesn't."""
            for s in body:
                if at is None:
                    at = block()  # unreachable: it gets no edge
                if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                    emit(at, s, "assignment", s.targets[0].id, s.value)
                elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.value is not None:
                    emit(at, s, "assignment", s.target.id, s.value)
                elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                    emit(at, s, "assignment", s.target.id, s.value)
                    blocks[at][-1]["uses"] = list(dict.fromkeys([s.target.id, *blocks[at][-1]["uses"]]))
                elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call | ast.Await):
                    emit(at, s, "call", "", s.value)
                elif isinstance(s, ast.Return):
                    emit(at, s, "return", "", s.value)
                    at = None
                elif isinstance(s, ast.Raise):
                    at = None
                elif isinstance(s, ast.Break | ast.Continue):
                    if loop:
                        edges.append((at, loop[isinstance(s, ast.Break)], "jump"))
                    at = None
                elif isinstance(s, ast.If):
                    then, after = block(), block()
                    edges.append((at, then, "true"))
                    end = run(s.body, then, loop)
                    ends = [end]
                    if s.orelse:
                        other = block()
                        edges.append((at, other, "false"))
                        ends.append(run(s.orelse, other, loop))
                    else:
                        edges.append((at, after, "false"))
                    edges.extend((e, after, "next") for e in ends if e is not None)
                    at = after if not s.orelse or any(e is not None for e in ends) else None
                elif isinstance(s, ast.For | ast.AsyncFor | ast.While):
                    head, inner, after = block(), block(), block()
                    edges.extend([(at, head, "next"), (head, inner, "true"), (head, after, "false")])
                    if not isinstance(s, ast.While) and isinstance(s.target, ast.Name):
                        emit(head, s, "for", s.target.id, s.iter)
                    end = run(s.body, inner, (head, after))
                    if end is not None:
                        edges.append((end, head, "back"))
                    at = run(s.orelse, after, loop) if s.orelse else after
                elif isinstance(s, ast.With | ast.AsyncWith):
                    for item in s.items:
                        if isinstance(item.optional_vars, ast.Name):
                            emit(at, s, "with", item.optional_vars.id, item.context_expr)
                    at = run(s.body, at, loop)
                elif isinstance(s, ast.Try):
                    inner, after = block(), block()
                    edges.append((at, inner, "next"))
                    ends = [run([*s.body, *s.orelse], inner, loop)]
                    for h in s.handlers:
                        b = block()
                        edges.append((inner, b, "except"))
                        ends.append(run(h.body, b, loop))
                    edges.extend((e, after, "next") for e in ends if e is not None)
                    at = after if any(e is not None for e in ends) else None
                    if s.finalbody:
                        at = run(s.finalbody, at if at is not None else after, loop)
                elif isinstance(s, ast.Match):
                    after = block()
                    for case in s.cases:
                        b = block()
                        edges.append((at, b, "case"))
                        end = run(case.body, b, loop)
                        if end is not None:
                            edges.append((end, after, "next"))
                    edges.append((at, after, "next"))
                    at = after
            return at

        run(n.body, 0, None)
        order, seen, after = deque([0]), {0}, {}
        for a, b, _ in edges:
            after.setdefault(a, []).append(b)
        seq = 0
        while order:  # statements in the order of a breadth-first walk; what control never reaches is left out
            b = order.popleft()
            for row in blocks[b]:
                self.add("statements", **row, seq=seq)
                seq += 1
            for nxt in after.get(b, ()):
                if nxt not in seen:
                    seen.add(nxt)
                    order.append(nxt)
        for a, b, kind in edges:
            self.add("cfg_edges", fqn=fqn, src=a, dst=b, kind=kind)


def extract(text: str, module: str) -> dict[str, list[dict]]:
    """All facts of a file. Raises SyntaxError for text that isn't Python 3."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    x = _Extractor(module)
    x.body(tree.body, module)
    return x.out
