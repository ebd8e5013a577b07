"""The canonical form of a callee's fully qualified name."""

from __future__ import annotations

import re

_ARGUMENTS = re.compile(r"(?<=\w)(?:\[[^\[\]]*\]|<[^<>]*>)")
_NOTATION = re.compile(r"[()*&\s]+")


def canonical_callee(fqn: str | None) -> str:
    """A name without blanks, pointer and receiver notation, type arguments and the path of a vendoring package.

    ``(*a/vendor/b/c.Pool[int]).Get`` and ``b/c.Pool.Get`` give the same form. Null and blank names give ``''``; letter case
    and all name parts are kept.
    """
    if not fqn:
        return ""
    name, before = fqn.strip(), None
    while before != name:  # innermost first: type arguments nest
        before, name = name, _ARGUMENTS.sub("", name)
    name = _NOTATION.sub("", name)
    return name.rpartition("/vendor/")[2]
