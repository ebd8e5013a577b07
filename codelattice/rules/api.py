"""The authoring surface. Matchers are objects whose logical form is plain JSON; decorators collect rules.

    class Cursor(QueryType):
        fqns = ["sqlite3.Cursor"]

    @python_rule(id="PY-SQL-001", severity="high", cwe="CWE-89")
    def injection():
        return flows(from_sources=[calls("input")], to_sinks=[Cursor.method("execute").tracks(0)], sanitized_by=[calls("escape")])
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

_rules: list[Rule] = []
_defaults: dict[str, Any] = {"scope": "global", "propagation": []}


class Matcher:
    """What can be combined and compiled."""

    def to_ir(self) -> dict[str, Any]:
        raise NotImplementedError

    def __and__(self, other: Matcher) -> And:
        return And(self, other)

    def __or__(self, other: Matcher) -> Or:
        return Or(self, other)

    def __invert__(self) -> Not:
        return Not(self)


@dataclass(frozen=True)
class Qualifier:
    """A comparator for an argument."""

    comparator: str
    value: Any = None


def lt(v: float) -> Qualifier:
    return Qualifier("lt", v)


def gt(v: float) -> Qualifier:
    return Qualifier("gt", v)


def lte(v: float) -> Qualifier:
    return Qualifier("lte", v)


def gte(v: float) -> Qualifier:
    return Qualifier("gte", v)


def regex(pattern: str) -> Qualifier:
    return Qualifier("regex", pattern)


def missing() -> Qualifier:
    return Qualifier("missing")


def _constraint(value: Any) -> dict[str, Any]:
    if isinstance(value, Qualifier):
        return {"value": value.value, "wildcard": False, "comparator": value.comparator}
    items = value if isinstance(value, list | tuple) else [value]
    return {"value": list(value) if isinstance(value, tuple) else value, "wildcard": any(isinstance(x, str) and ("*" in x or "?" in x) for x in items), "comparator": ""}


def _positions(match: dict[Any, Any] | None) -> dict[str, dict]:
    return {str(k): _constraint(v) for k, v in (match or {}).items()}


def _tracked(param: int | str | dict) -> dict[str, Any]:
    """A tracked parameter in the logical form: ``{index}``, ``{name}`` or ``{return}``."""
    return dict(param) if isinstance(param, dict) else {"return": True} if param == "return" else {"index": param} if isinstance(param, int) else {"name": param}


@dataclass
class calls(Matcher):  # noqa: N801 - a verb of the rule language
    """Calls by name; names with a ``*`` make the whole matcher one with wildcards."""

    patterns: tuple[str, ...]
    match_position: dict[Any, Any] | None = None
    match_name: dict[str, Any] | None = None
    tracked: tuple[Any, ...] = ()

    def __init__(self, *patterns: str, match_position: dict | None = None, match_name: dict | None = None) -> None:
        if not patterns or any(not isinstance(p, str) or not p for p in patterns):
            raise ValueError("calls() takes at least one name")
        self.patterns, self.match_position, self.match_name, self.tracked = patterns, match_position, match_name, ()

    def where(self, *args: Any, **kwargs: Any) -> calls:
        """Constraints by position, in order or as (position, value) pairs, and by keyword."""
        self.match_position = {**(self.match_position or {}), **{(a[0] if isinstance(a, tuple) and len(a) == 2 else i): (a[1] if isinstance(a, tuple) and len(a) == 2 else a) for i, a in enumerate(args)}}
        self.match_name = {**(self.match_name or {}), **kwargs}
        return self

    def tracks(self, *params: int | str) -> calls:
        """The parameters, by position or name, that must carry the taint; ``return`` for the result."""
        self.tracked = params
        return self

    def to_ir(self) -> dict[str, Any]:
        return {"type": "call_matcher", "patterns": list(self.patterns), "wildcard": any("*" in p for p in self.patterns), "positionalArgs": _positions(self.match_position), "keywordArgs": {k: _constraint(v) for k, v in (self.match_name or {}).items()}, "trackedParams": [_tracked(x) for x in self.tracked]}


@dataclass
class variable(Matcher):  # noqa: N801
    pattern: str

    def to_ir(self) -> dict[str, Any]:
        return {"type": "variable_matcher", "pattern": self.pattern, "wildcard": "*" in self.pattern}


class attribute(Matcher):  # noqa: N801
    """Attribute reads; legal within ``flows`` only."""

    def __init__(self, *patterns: str) -> None:
        if not patterns:
            raise ValueError("attribute() takes at least one name")
        self.patterns = patterns

    def to_ir(self) -> dict[str, Any]:
        return {"type": "attribute_matcher", "patterns": list(self.patterns)}


class _Logic(Matcher):
    kind = ""

    def __init__(self, *matchers: Matcher) -> None:
        if not matchers:
            raise ValueError(f"{type(self).__name__} takes at least one matcher")
        self.matchers = matchers

    def to_ir(self) -> dict[str, Any]:
        return {"type": self.kind, "matchers": [m.to_ir() for m in self.matchers]}


class And(_Logic):
    kind = "logic_and"


class Or(_Logic):
    kind = "logic_or"


class Not(_Logic):
    kind = "logic_not"


class TypedCall(calls):
    """A method or attribute of a receiver type."""

    def __init__(self, owner: type[QueryType], names: Sequence[str], kind: str) -> None:
        super().__init__(*names)
        self.owner, self.kind = owner, kind

    def to_ir(self) -> dict[str, Any]:
        base = super().to_ir()
        base.pop("patterns"), base.pop("wildcard")
        names = {"methodNames": list(self.patterns)} if self.kind == "method" else {"attributeName": self.patterns[0]}
        return {**base, "type": "type_constrained_call" if self.kind == "method" else "type_constrained_attribute", "receiverTypes": list(self.owner.fqns), "receiverPatterns": list(self.owner.patterns), **names, "minConfidence": 0.5, "fallbackMode": "none"}


class QueryType:
    """A receiver type: its full names, and patterns of names."""

    fqns: Sequence[str] = ()
    patterns: Sequence[str] = ()
    match_subclasses: bool = True

    @classmethod
    def method(cls, *names: str) -> TypedCall:
        return TypedCall(cls, names, "method")

    @classmethod
    def attr(cls, name: str) -> TypedCall:
        return TypedCall(cls, (name,), "attribute")


def _list(x: Matcher | Sequence[Matcher] | None) -> list[Matcher]:
    return [] if x is None else [x] if isinstance(x, Matcher) else list(x)


class flows(Matcher):  # noqa: N801
    """Dataflow from sources to sinks. ``propagates_through`` is carried along and not read by the execution."""

    def __init__(self, from_sources: Any = None, to_sinks: Any = None, sanitized_by: Any = None, propagates_through: Sequence[dict] | None = None, scope: str | None = None) -> None:
        self.sources, self.sinks, self.sanitizers = _list(from_sources), _list(to_sinks), _list(sanitized_by)
        self.scope = scope or _defaults["scope"]
        if not self.sources or not self.sinks:
            raise ValueError("flows() takes sources and sinks")
        if self.scope not in ("local", "global"):
            raise ValueError("the scope is local or global")
        self.propagation = list(propagates_through if propagates_through is not None else _defaults["propagation"])

    def to_ir(self) -> dict[str, Any]:
        ir = lambda xs: [m.to_ir() for m in xs]
        return {"type": "dataflow", "sources": ir(self.sources), "sinks": ir(self.sinks), "sanitizers": ir(self.sanitizers), "propagation": self.propagation, "scope": self.scope}


class propagates:  # noqa: N801
    """Ways in which taint moves on, and presets of them; informational."""

    assignment, function_args, function_returns = {"type": "assignment"}, {"type": "function_args"}, {"type": "function_returns"}
    string_concat, string_format, collections, attributes = {"type": "string_concat"}, {"type": "string_format"}, {"type": "collections"}, {"type": "attributes"}
    minimal = [assignment, function_args]
    standard = [*minimal, function_returns, string_concat, string_format]
    comprehensive = standard
    exhaustive = standard


def set_default_scope(scope: str) -> None:
    if scope not in ("local", "global"):
        raise ValueError("the scope is local or global")
    _defaults["scope"] = scope


def set_default_propagation(ways: Sequence[dict]) -> None:
    _defaults["propagation"] = list(ways)


# Containers


class Check(int):
    """A function in a logical form: it reads and is written as 1, as JSON has no functions, and can be called."""

    def __new__(cls, function: Callable) -> Check:
        self = super().__new__(cls, 1)
        self.function = function
        return self

    def __reduce__(self):
        return Check, (self.function,)

    def __call__(self, *args: Any) -> Any:
        return self.function(*args)


class ContainerMatcher(Matcher):
    def __init__(self, kind: str, **fields: Any) -> None:
        self.kind, self.fields = kind, {k: v for k, v in fields.items() if v is not None}

    def to_ir(self) -> dict[str, Any]:
        ir = lambda x: [m.to_ir() for m in x] if isinstance(x, list) else x.to_ir() if isinstance(x, Matcher) else x
        calls = {k: v for k, v in self.fields.items() if callable(v) and not isinstance(v, Matcher)}
        return {"type": self.kind, **{k: ir(v) for k, v in self.fields.items() if k not in calls}, **{k: Check(v) for k, v in calls.items()}}


def instruction(type: str, **criteria: Any) -> ContainerMatcher:  # noqa: A002
    return ContainerMatcher("instruction", instruction=type.upper(), **criteria)


def missing_instruction(instruction: str, **more: Any) -> ContainerMatcher:
    return ContainerMatcher("missing_instruction", instruction=instruction.upper(), **more)


def service_has(key: str, equals: Any = None, contains: str | None = None, contains_any: Sequence[str] | None = None, **more: Any) -> ContainerMatcher:
    return ContainerMatcher("service_has", key=key, equals=equals, contains=contains, contains_any=list(contains_any) if contains_any else None, **more)


def service_missing(key: str, **more: Any) -> ContainerMatcher:
    return ContainerMatcher("service_missing", key=key, **more)


def all_of(*matchers: Matcher) -> ContainerMatcher:
    return ContainerMatcher("all_of", conditions=list(matchers))


def any_of(*matchers: Matcher) -> ContainerMatcher:
    return ContainerMatcher("any_of", conditions=list(matchers))


def none_of(*matchers: Matcher) -> ContainerMatcher:
    return ContainerMatcher("none_of", conditions=list(matchers))


def instruction_after(instruction: str, after: str) -> ContainerMatcher:
    return ContainerMatcher("instruction_after", instruction=instruction.upper(), after=after.upper())


def instruction_before(instruction: str, before: str) -> ContainerMatcher:
    return ContainerMatcher("instruction_before", instruction=instruction.upper(), before=before.upper())


def stage(alias: str | None = None, **fields: Any) -> ContainerMatcher:
    return ContainerMatcher("stage", alias=alias, **fields)


def final_stage_has(**fields: Any) -> ContainerMatcher:
    return ContainerMatcher("final_stage_has", **fields)


def custom_check(check: Callable, description: str = "") -> ContainerMatcher:
    """A check in Python; it runs in strict execution only, on a ``Dockerfile`` of each file."""
    return ContainerMatcher("custom_check", check=check, description=description)


# Rules


@dataclass
class Rule:
    id: str
    name: str
    severity: str
    matcher: Matcher
    language: str = ""
    cwe: str = ""
    owasp: str = ""
    category: str = ""
    message: str = ""
    description: str = ""
    tags: tuple[str, ...] = field(default_factory=tuple)

    def to_ir(self) -> dict[str, Any]:
        about = {"id": self.id, "name": self.name, "severity": self.severity, "cwe": self.cwe, "owasp": self.owasp, "category": self.category, "language": self.language, "description": self.description, "message": self.message, "tags": list(self.tags)}
        return {"rule": about, "matcher": self.matcher.to_ir()}


def _decorator(language: str):
    def outer(id: str, name: str | None = None, severity: str = "medium", cwe: str = "", owasp: str = "", category: str = "", message: str = "", tags: Sequence[str] | str = (), **_: Any):  # noqa: A002
        def register(f: Callable[[], Matcher]) -> Rule:
            r = Rule(id, name or f.__name__, severity.lower(), f(), language, cwe, owasp, category, message or (f.__doc__ or "").strip(), (f.__doc__ or "").strip(), tuple(tags.split(",")) if isinstance(tags, str) and tags else tuple(tags or ()))
            _rules.append(r)
            return r

        return register

    return outer


rule, python_rule, go_rule = _decorator(""), _decorator("python"), _decorator("go")
dockerfile_rule, compose_rule = _decorator("dockerfile"), _decorator("compose")


def rules_of(language: str | None = None, clear: bool = False) -> list[Rule]:
    """The rules collected so far."""
    got = [r for r in _rules if language is None or r.language == language]
    if clear:
        _rules.clear()
    return got
