"""Functions paired with their documentation.

Function spans and comment spans of a file are extracted apart; an as-of interval join then attaches to each function the nearest
comment that ends before it, and rejects the match where a statement or, in Go, a blank line stands between. Python's docstrings
lie inside the function's span: the first statement of its body. Pairs with missing or trivial documentation are dropped.

Scale: a file is the unit of the join, so both sides of it meet in one pass without a shuffle; definitions that come with their
documentation take the same tests without a join. Units of syntax are remembered as for ``syntax.check``.

Defined results
    * Null and empty source code, files that do not parse, and code inside string literals yield nothing.
    * ``line`` is the 1-based line of ``def``, ``func`` or the name (Java); nested functions count, function literals do not.
    * Documentation is trivial if fewer than four words are left without marks, markup, lists of parameters and results, and
      directives; if it only repeats the name; if it only says that documentation is missing; if it is only code.
    * Repeated rows count once; null ids are kept as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.syntax import check
from codelattice.llm.syntax.tree import Outline

LEAST_WORDS = 4

# Words that add nothing to a function's name.
_FILLERS = frozenset("the this that these a an function func method procedure routine constructor to of for and or in is are be it its which will can does do used use uses simple simply just helper utility implements implementation implement performs perform class object given".split())
_WORD = re.compile(r"[^\W\d_](?:[^\W_]|['’](?=\w))*|\d+[^\W\d_]\w*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_MARKS = re.compile(r"^[ \t]*(?:/\*\*?|\*/|\*(?!/)|//+|#+)[ \t]?|[ \t]*\*/[ \t]*$", re.M)
_STRING = re.compile(r"^\s*(?:[rRbBuUfF]{0,2})(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')\s*$")
_DIRECTIVE = re.compile(
    r"(?:^|(?<=\s)|(?<=>))(?:go:\w+\S*(?:[ \t].*)?|\+build\b.*|nolint(?::\s*[\w,-]+)?(?:\s*//.*)?|noqa(?::\s*[A-Z]+\d+(?:[, ]+[A-Z]+\d+)*)?|pylint:\s*(?:disable|enable)\S*(?:=\S+)?|type:\s*ignore(?:\[[\w, -]*\])?|mypy:\s*\S+|pyright:\s*\S+|fmt:\s*(?:on|off|skip)|isort:\s*\S+"
    r"|pragma:?\s*no\s*(?:cover|branch)|noinspection\s+\w+|lint:ignore\s+\S+.*|eslint-\S+.*|@?formatter:(?:on|off)|CHECKSTYLE[:.]\S+|NOSONAR|NOPMD|@SuppressWarnings\([^)]*\)|coding[:=]\s*\S+|swagger:\S+.*|export \w+$)",
    re.M,
)
_TAGS = re.compile(r"(?:^|(?<=\s)|(?<=>))(?:@(?:param|returns?|throws|exception|see|since|author|version|deprecated|type|rtype|raises?|arg|argument|since|hidden|serial\w*)\b|:(?:param|parameter|arg|argument|key|type|returns?|rtype|raises?|raise|except|yields?|ytype|var|ivar|cvar|meta)\b[^:\n]*:)[\s\S]*")
_SECTION = re.compile(r"^[ \t]*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields?|Throws|Keyword Args|Attributes|Other Parameters)[ \t]*(?::[ \t]*$|\n[ \t]*[-=]{3,}[ \t]*$)(?:\n(?:[ \t]*$|[ \t]+\S.*|[ \t]*\w+[ \t]*:.*))*", re.M)
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|&(?:[a-z]+|#\d+);|\{@inheritDoc\}|\{@\w+|[`*_#=~|{}\[\]<>-]{2,}|^[ \t]*>>>.*$|^[ \t]*\.\.\.(?:[ \t].*)?$", re.M)
_MISSING = re.compile(
    r"^(?:(?:todo|fixme|xxx|tbd|hack|note)\b[\s:(\w)]*?(?:document\w*|descri\w+|doc|docs|docstrings?|comments?|javadoc|summary)\b.*"
    r"|(?:there is |currently )?(?:no|missing|lacks?|without|needs?|empty)\s+(?:\w+\s+){0,2}(?:documentation|docs?|docstrings?|descriptions?|comments?|javadoc|summary|summaries)\b.*"
    r"|(?:this (?:function|method|class|code) is |is )?(?:still )?(?:not|un|never)[\s-]*(?:yet )?documented\b.*"
    r"|(?:the )?(?:documentation|docs?|docstring|description|comment|javadoc|summary)\s+(?:is |are |still |goes |will |to |has )*(?:missing|here|follow\w*|pending|be (?:added|done|written|provided)|not|tbd|todo|needed|coming|unavailable|absent|later)\b.*"
    r"|(?:this is an? )?(?:auto[\s-]*)?generated\b(?=.*\b(?:stub|placeholder|fill|descri\w+|docstring|comment)\b).*"
    r"|(?:please |to ?do:? )?(?:add|write|insert|fill in|fill|provide|complete|put|supply|enter)\s+(?:\w+\s+){0,3}(?:documentation|docs?|docstring|description|comment|javadoc|summary)\b.*)$",
    re.I | re.S,
)
_CODE = re.compile(
    r"(?:^|(?<=\s)|(?<=[;{}>]))(?:"
    r"(?:(?:const|let|var|final|int|String|boolean|long)\s+)?[\w.\[\]\"']+(?:\s*,\s*[\w.]+)*\s*(?::=|[-+*/|&%]?=(?!=))\s*(?:await\s+|new\s+|&|\*)?[\w.\"'\[\]{}+-]+(?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\))?(?:\.\w+(?:\([^()\n]*\))?)*\s*;?"
    r"|(?:if|for|while|switch)\b[^\n{};]*\{[^{}]*\}?"
    r"|(?:if|elif|for|while|with|try|except|else|def|class)\b[^\n:]{0,80}:(?=\s*(?:$|\w+\s*=|return|pass|raise|break|continue))"
    r"|(?:await |defer |go )?[A-Za-z_][\w.]*\.\w+\([^()\n]*\)\s*;?(?=\s|$)|[A-Za-z_]\w*\([^()\n]*\)\s*;?(?=\s|$)"
    r"|return(?:[ \t]+[\w.\"'()\[\], ]*?)?\s*;|return[ \t]+[\w.\"'()\[\]]+(?=\s*(?:$|[}<]))|return(?=\s*(?:$|\}))|[{}]+;?|(?:pass|break|continue|import\s+[\w.]+)(?=\s*$))",
    re.M,
)


@lru_cache(maxsize=100_000)
def _stem(word: str) -> str:
    w = word.lower()
    if w.endswith("s") and w[-3:-1] in ("ed", "ng"):  # inflected twice
        w = w[:-1]
    for end, put in (("ies", "y"), ("ing", ""), ("ied", "y"), ("es", ""), ("ed", ""), ("s", ""), ("e", "")):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)] + put
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w.rstrip("e") if len(w) > 3 else w


def _name_stems(name: str) -> set[str]:
    return {_stem(w) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\da-zA-Z_]+", name)}


# What a text must hold for the patterns above to find anything.
_DIRECTIVE_SIGNS = (":", "noqa", "nolint", "+build", "noinspection", "NOSONAR", "NOPMD", "pragma", "eslint-", "@SuppressWarnings", "coding=", "export ")
_SECTION_SIGNS = ("Args", "Arguments", "Param", "Return", "Raises", "Yield", "Throws", "Attributes")
_MARKUP_SIGNS = tuple("<&{}[]*_#=~|>`-") + ("...",)
_CODE_SIGN = re.compile(r"[=;{}()]|\breturn\b")


def description(raw: str | None, names: str = "") -> str:
    """The documentation without comment marks, markup, directives, and lists of parameters and results.

    ``names`` is the text of the signature; entries ``name: value`` for its names are such a list.
    """
    if not raw:
        return ""
    s = raw.replace("\r", "") if "\r" in raw else raw
    # Each pattern runs only on texts that hold one of its signs.
    if s.lstrip()[:1] in "\"'rRbBuUfF":
        s = _STRING.sub("", s)
    if "*" in s or "/" in s or "#" in s:
        s = _MARKS.sub("", s)
    if any(x in s for x in _DIRECTIVE_SIGNS):
        s = _DIRECTIVE.sub(" ", s)
    if "\n" in s and any(x in s for x in _SECTION_SIGNS):
        s = _SECTION.sub(" ", s)
    if "{@" in s:
        s = re.sub(r"\{@(?:link|linkplain|code|literal|value)\s+([^{}]*)\}", r"\1", s)
    if "@" in s or ":" in s:
        s = _TAGS.sub(" ", s)
    if names and ":" in s:
        ids = set(re.findall(r"[^\W\d]\w*", names))
        s = re.sub(r"(?:^|(?<=\s)|(?<=>))([^\W\d]\w*)\s*:[ \t]*\S+", lambda m: " " if m.group(1) in ids else m.group(), s)
    return _MARKUP.sub(" ", s) if any(x in s for x in _MARKUP_SIGNS) else s


def is_trivial(raw: str | None, name: str = "", signature: str = "") -> bool:
    s = description(raw, signature)
    words = _WORD.findall(s)
    n = len(words)
    if n < LEAST_WORDS and n + len(_CJK.findall(s)) // 2 < LEAST_WORDS:
        return True
    if n <= 14 and _MISSING.match(s.strip(" \t\n.:-!")):
        return True
    if n <= 16:
        left = {_stem(w) for w in words if w.lower() not in _FILLERS}
        if left <= _name_stems(name):
            return True
    if _CODE_SIGN.search(s):
        rest = len(_WORD.findall(_CODE.sub(" ", s)))
        if rest < LEAST_WORDS and rest < n:
            return True
    return False


def attach(text: str, functions: list[tuple[int, str, int, str | None]], comments: list[tuple[int, int]], language: str) -> list[str | None]:
    """The as-of join: for each function the nearest eligible comment that ends before its statement begins."""
    ends = [e for _, e in comments]
    out: list[str | None] = []
    for _, _, begin, doc in functions:
        if language == "python":
            out.append(doc)
            continue
        i = bisect_right(ends, begin) - 1
        found = None
        at = begin
        while i >= 0:
            s, e = comments[i]
            between = text[e:at]
            if between.strip():  # a statement intervenes
                break
            own_line = not text[text.rfind("\n", 0, s) + 1 : s].strip()
            if language == "java":
                if text.startswith("/**", s) and e - s > 4:
                    found = text[s:e]
                    break
            else:  # the group of comments that touches the function
                if between.count("\n") != 1 or not own_line:
                    break
                found = text[s:begin]
            at = s
            i -= 1
        out.append(found)
    return out


def pairs_of(language: str, text: str, outline: Outline) -> Iterator[tuple[int, str, str, int]]:
    """(offset, name, documentation, index) of the functions with documentation that isn't trivial."""
    functions = outline.functions
    for k, (f, doc) in enumerate(zip(functions, attach(text, functions, outline.comments, language), strict=True)):
        if doc is None:
            continue
        stop = text.find("{" if language != "python" else "\n", f[0])
        signature = text[f[0] : stop if stop > 0 else len(text)]
        if language == "python":
            m = re.compile(r"def\s+\w+[^(]*\(([^()]|\([^()]*\))*\)").match(text, f[0])
            signature = m.group() if m else signature
        if not is_trivial(doc, f[1], signature):
            yield f[0], f[1], doc, k


def _from_files(with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lines, names, codes, docs = [], [], [], [], []
            for i, (path, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                lang = check.language_of(path)
                if lang not in ("python", "go", "java"):
                    continue
                outline = check.outline_of(lang, text)
                if not outline.functions or check.is_invalid(lang, text, outline):
                    continue
                line, at = 1, 0
                for offset, name, doc, k in pairs_of(lang, text, outline):
                    line += text.count("\n", at, offset) if offset >= at else -text.count("\n", offset, at)
                    at = offset
                    rows.append(i)
                    lines.append(line)
                    if with_text:
                        names.append(name)
                        codes.append(text[outline.functions[k][2] : outline.ends.get(k, len(text))])
                        docs.append(description(doc).strip())
            columns = [b.column(0).take(pa.array(rows, pa.int32())), pa.array(lines, pa.int64())]
            if with_text:
                columns += [pa.array(x, pa.string()) for x in (names, codes, docs)]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "line", "name", "code", "documentation"][: len(columns)])

    return run


def _from_definitions(with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, docs = [], []
            for i, (name, signature, doc) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                if not is_trivial(doc, name or "", signature or ""):
                    keep.append(i)
                    if with_text:
                        docs.append(description(doc, signature or "").strip())
            at = pa.array(keep, pa.int32())
            columns = [b.column(0).take(at), b.column(1).take(at).cast(pa.int64())]
            if with_text:
                columns += [b.column(2).take(at), b.column(3).take(at), pa.array(docs, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "line", "name", "code", "documentation"][: len(columns)])

    return run


def documented_functions(files: DataFrame, definitions: DataFrame, with_text: bool = False) -> DataFrame:
    """``(origin, item_id, line[, name, code, documentation])`` for functions in source files and for listed definitions."""
    schema = "item_id bigint, line bigint" + ", name string, code string, documentation string" * with_text
    a = files.select(F.col("file_id").cast("bigint").alias("id"), "file_path", F.col("source_code").alias("text")).where("text IS NOT NULL AND text <> ''")
    a = a.where(F.col("file_path").rlike(r"\.(py|go|java)$")).mapInArrow(_from_files(with_text), schema).withColumn("origin", F.lit("source_files"))
    b = definitions.select(F.col("def_id").cast("bigint").alias("id"), F.col("line").cast("bigint").alias("line"), "fn_name", "signature", "docstring").where("docstring IS NOT NULL AND docstring <> ''")
    b = b.mapInArrow(_from_definitions(with_text), schema).withColumn("origin", F.lit("definitions"))
    order = ["origin", *[c for c in a.columns if c != "origin"]]
    return a.select(order).unionByName(b.select(order)).distinct()
