"""Credentials embedded in source code: their places, and the text with them redacted.

Candidates are the quoted strings and the long tokens of a text. A candidate's Shannon entropy is taken over the alphabet it is
written in (hexadecimal, letters and digits, base64, words and signs) and held against a threshold for that alphabet, its length
and its context: lower where the name it is assigned to speaks of a secret, out of reach where it speaks of a hash or an id.
Known token formats, passwords within URLs, basic-auth pairs and private key blocks are candidates of their own. Hashes, ids,
public keys, certificates, data URIs, patterns, references to the environment and placeholders are excluded.

Scale: texts are independent, one pass, no shuffle; the places of repeated rows are made distinct afterwards.

Defined results: null and empty texts have no credentials and stay as they are; lines end at line feeds; a credential counts for
the line on which it begins; redaction replaces the credential's own characters only, so quotes, names and line ends stay.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of names that hold secrets, and of names that hold something else.
SECRET_WORDS = frozenset("password passwd passphrase passcode pass pwd pw secret secrets token apikey credential credentials cred creds auth authorization bearer salt".split())
SECRET_PARTS = ("password", "passwd", "passphrase", "secret", "apikey", "authtoken", "accesstoken", "privatetoken", "credential", "signingkey", "encryptionkey", "privatekey", "accesskey", "smtppass", "bindpw", "adminpw")
KEY_QUALIFIERS = frozenset("api secret private signing sign encryption encrypt access auth session master service hmac deploy storage account client shared crypt jwt aws".split())
OTHER_WORDS = frozenset(
    "file path dir field fields type count counts limit limits name pattern patterns regex regexp length len size expiry ttl policy rules rule url uri endpoint header id ids index kind format prefix suffix mode "
    "sha sha1 sha256 sha512 md5 checksum checksums digest hash integrity revision rev commit build request trace correlation uuid guid icon image logo pub public trusted cert certificate fingerprint etag version".split()
)
# Formats in which providers issue tokens.
_ISSUED = re.compile(
    r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeprs]-[\w-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[\w-]{30,}"
    r"|eyJ[\w-]{8,}\.[\w-]{8,}\.?[\w-]*|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|ya29\.[\w-]{20,}|dop_v1_[0-9a-f]{64})"
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:(.)\1*|.*(?:\$\{|\{\{|%\(|\$\(|<[^>]*>).*|\$\w+|%\w+%|(?:your|my|the|some|insert|replace|change|set|fill|put|todo|fixme|enter|add|example|sample|dummy|fake|test|default|none|null|undefined|redacted|masked|hidden|placeholder)"
    r"(?:[-_. ]?(?:me|in|this|here|later|it|your|with|by|ci|now|value|password|passwd|secret|token|key|api|access|user|change|for|tests?|only|local|dev))*\d{0,3})$"
)
_WORDS = re.compile(r"[A-Za-z]+(?:[-_. ][A-Za-z]+)*")
_META = re.compile(r"\[[^\]]*-[^\]]*\]|\\[sSdDwWb]|\(\?|\{\d+,?\d*\}|\.\*|\.\+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_PLAIN = re.compile(r"[a-z_ .,:;!?%/()\n-]*|[A-Z_ ]*")
_CANDIDATE = re.compile(
    r'"(?:[^"\\\n]|\\[^\n])*"|(?<![A-Za-z])\'(?:[^\'\\\n]|\\[^\n])*\'|`[^`\n]*`'
    r"|(?<![\w+/=~!@%^&*#$:.-])(?=[A-Za-z_+/=~!@%^&*#$:.-]*[0-9]|[A-Za-z]{20})[\w+/=~!@%^&*#$:.-]{8,}"
)
_INSIDE = re.compile(r"[^\s\"'`,;()\[\]<>|]{6,}")
_NAME = re.compile(r"([A-Za-z_-][\w.-]*)(?:\s*:\s*[A-Za-z_][\w.\[\] |]*?(?=\s*=)|\s+(?:string|\[\]byte|String|str)(?=\s*=))?[\"'`\])}]*\s*(?::=|=>|==|=|:|,|\s)\s*(?:[\[({]|[A-Za-z_.]+\()?\s*[bfruBFRU@$]{0,2}[\"'`]?$")
_BLOCK_NAME = re.compile(r"([A-Za-z_][\w.-]*)[\"']?\s*:\s*[|>][-+0-9]*\s*$")
_CALL = re.compile(r"[\w\])]\s*\((?:[^()\"'`]|\"[^\"]*\"|'[^']*')*[\"'`]?$")
_URL = re.compile(r"\b[a-z][a-z0-9+.-]*://([^\s:/@\"'`<>]*):([^\s@\"'`/<>]+)@", re.I)
_USER_FLAG = re.compile(r"(?:^|\s)(?:-u|--user)[= ]+[\"']?([\w.@-]+):([^\s\"']+)")
_BASIC = re.compile(r"\bBasic\s+([A-Za-z0-9+/]{8,}={0,2})")
_SCHEME = re.compile(r"(?i)(?:bearer|token) $")
_PARAMETER = re.compile(r"(?<=[?&])([\w.-]+)=([^&#\s]+)")
#: A line of a settings file that holds a key and a bare value; the value is no type's name.
_SETTING_LEFT, _SETTING_RIGHT = re.compile(r"\s*(?:- )?(?:[\w.-]+:[ \t]+|(?:ENV |ARG |export )?[A-Z][A-Z0-9_]*=)"), re.compile(r"[ \t]*(?:#[^\n]*)?\r?")
_WORD_AND_DIGITS = re.compile(r"(?!(?:complex|float|u?int|sha|md|utf|base|latin|iso|aes|str|bytes)_?\d)[a-z][a-z_]{2,}\d[\w]*")
_MARK = re.compile(r"-----BEGIN ([A-Z0-9 ]+?)-----")
_BODY = re.compile(r"(?:\\r|\\n|[\s\"'+,|>\\]|(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*)*((?:[A-Za-z0-9+/=]{8,}(?:\\r|\\n|[\s\"'+,\\])*)+)")
_INERT = re.compile(r"(?:sha(?:1|256|384|512)[-:=]|data:[\w/+.-]+;base64,|ssh-(?:rsa|ed25519|dss|ecdsa)\s+|ecdsa-sha2-\S+\s+|@sha256:)[A-Za-z0-9+/=_-]+")
_NEXT_PART = re.compile(r"[ \t]*(?:\+|\\)?[ \t]*(?:\r?\n[ \t]*)?(?:\+[ \t]*)?([\"'])((?:[^\"'\\\n]|\\[^\n])*)\1")

_JOINED = re.compile(r"[ \t]*[+\\]?[ \t]*\r?\n[ \t]*(?:\+[ \t]*)?[\"']|[ \t]*\+[ \t]*[\"']")

#: Least bits in all by alphabet: (under a name that speaks of a secret, as a call's argument or a header, elsewhere).
BITS = {"hex": (56.0, 100.0, math.inf), "mixed": (16.0, 72.0, 84.0), "lower": (16.0, math.inf, math.inf), "signs": (14.0, math.inf, math.inf)}


def entropy_bits(value: str) -> float:
    """Shannon entropy of the characters times their number."""
    n = len(value)
    return n * math.log2(n) - sum(c * math.log2(c) for c in (value.count(x) for x in set(value)) if c > 1) if n else 0.0


def alphabet(value: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return "hex"
    if re.fullmatch(r"[A-Za-z0-9+/=_-]+", value):
        return "mixed" if re.search(r"[A-Z]", value) and re.search(r"[a-z]", value) else "lower"
    return "signs"


@lru_cache(maxsize=50_000)
def name_kind(name: str) -> str:
    """``secret``, ``other`` (hashes, ids, files, counts and the like) or ``open``."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    words = [w for w in words if not w.isdigit()]
    if not words:
        return "open"
    flat, known = "".join(words), set(words)
    secret = bool(known & SECRET_WORDS) or any(p in flat for p in SECRET_PARTS) or ("key" in words and bool(known & KEY_QUALIFIERS))
    if words[-1] in OTHER_WORDS and not (secret and words[-1] in ("hash", "header")) or (known & OTHER_WORDS and not secret):
        return "other"
    return "secret" if secret else "open"


def _placeholder(v: str) -> bool:
    return bool(_PLACEHOLDER.match(v)) or bool(_META.search(v))


def _plain_words(v: str) -> bool:
    """Words without digits or signs; a run of letters whose case changes without order is no word."""
    if not _WORDS.fullmatch(v):
        return False
    changes = len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", v))
    return not (len(v) >= 12 and "-" not in v and " " not in v and changes >= max(3, len(v) // 6))


def _is_secret(value: str, name: str, place: str, quoted: bool, setting: bool = False) -> bool:
    """Whether a candidate under ``name`` in ``place`` (``name``, ``call`` or ``free``) is a live credential; a ``setting`` is all of its line."""
    if len(value) < 6 or _placeholder(value):
        return False
    kind = name_kind(name) if name else "open"
    if _ISSUED.match(value):
        return True
    if kind == "other" or _plain_words(value) or value.isdigit():
        return False
    if re.match(r"[./~]|[A-Za-z]:\\|\w+://|\$|--", value) and not (value[0] == "/" and re.search(r"[+=]|[A-Z].*\d.*[a-z]", value)):
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|v?\d+(?:[.:]\d+)+\S*|[\d./:-]+", value) or any(c.isspace() for c in value) and not (kind == "secret" and quoted and place == "name" and _phrase(value)):
        return False
    of = alphabet(value)
    if kind == "secret":
        if not quoted and (re.search(r"[(){}\[\]]|^[A-Za-z_]\w*(?:\.\w+)+$", value) or (re.fullmatch(r"[A-Za-z_]\w*", value) and not _random(value) and not (setting and _WORD_AND_DIGITS.fullmatch(value)))):
            return False
        return entropy_bits(value) >= BITS[of][0]
    if _UUID.fullmatch(value) or of == "signs":
        return False
    if of == "hex":
        return place == "call" and len(value) in (32, 40, 48, 64, 128) and entropy_bits(value) >= BITS["hex"][1]
    return of == "mixed" and len(value) >= 20 and _random(value) and entropy_bits(value) >= BITS["mixed"][1 if place == "call" else 2]


def _phrase(value: str) -> bool:
    """A pass phrase rather than a sentence: words parted by single blanks, half of them or more with digits, signs or letters of both cases."""
    words = value.split(" ")
    return all(words) and sum(bool(re.search(r"[0-9]|[^\w.,:;!?'()-]|[a-z][A-Z]", w)) for w in words) * 2 >= len(words) and any(c.isdigit() for c in value)


def _random(value: str) -> bool:
    """Letters of both cases and digits, changing in kind as chance would have it."""
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    return "d" in kinds and "u" in kinds and "l" in kinds and changes >= len(value) / 4


def find(text: str | None) -> list[tuple[int, int, str]]:
    """The credentials of a text: start, end and kind, in order and apart."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []  # what is a credential or known to be none

    if "-----BEGIN " in text:
        for m in _MARK.finditer(text):
            if taken and m.start() < taken[-1][1]:
                continue
            body = _BODY.match(text, m.end())
            size = len(re.sub(r"\\[rn]|[^A-Za-z0-9+/=]", "", body.group(1))) if body else 0
            end, other = text.find("-----END " + m.group(1), m.end()), text.find("-----BEGIN ", m.end())
            end = text.find("-----", end + 9) + 5 if end >= 0 and not 0 <= other < end else (body.end(1) if body else m.end())
            if "PRIVATE KEY" in m.group(1) and size >= 24:
                found.append((m.start(), end, "private_key"))
            taken.append((m.start(), end))
    if "sha" in text or "base64," in text or "ssh-" in text:
        taken += [m.span() for m in _INERT.finditer(text)]
    if "://" in text:
        for m in _URL.finditer(text):
            if not _placeholder(m.group(2)) and not _plain_words(m.group(2)) and not m.group(2).isdigit() and entropy_bits(m.group(2)) >= BITS["signs"][0]:
                found.append((*m.span(2), "url_password"))
            taken.append(m.span())
    if "Basic " in text:
        for m in _BASIC.finditer(text):
            try:
                pair = base64.b64decode(m.group(1) + "=" * (-len(m.group(1)) % 4), validate=True).decode()
            except (ValueError, binascii.Error):
                continue
            user, colon, word = pair.partition(":")
            if colon and len(word) >= 4 and not _placeholder(word) and not _plain_words(word):
                found.append((*m.span(1), "basic_auth"))
            taken.append(m.span())
    if "-u " in text or "--user" in text or "-u=" in text:
        for m in _USER_FLAG.finditer(text):
            if not _placeholder(m.group(2)) and not _plain_words(m.group(2)) and not m.group(2).isdigit():
                found.append((*m.span(2), "basic_auth"))
            taken.append(m.span(2))
    taken.sort()

    spans, at = taken, 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        first = text[start]
        quoted = first in "\"'`" and text[end - 1] == first and end - start >= 2
        if quoted:
            start, end = start + 1, end - 1
        v = text[start:end]
        if (len(v) < 6 or _PLAIN.fullmatch(v)) and not (quoted and len(v) > 2 and _JOINED.match(text, m.end())):
            continue
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        upto = at
        while upto < len(spans) and spans[upto][0] < end:
            upto += 1
        if upto > at:
            if quoted and any(c.isspace() for c in v):
                found += [x for x in _inside(text, start, end) if not any(a < x[1] and b > x[0] for a, b in spans[at:upto])]
            continue
        if quoted and not any(c.isspace() for c in v) and "${" not in v and "=" not in v.rstrip("=") and ":" not in v:
            got = _judge(text, start, end, True)
            if got:
                found.append(got)
        else:
            got = _inside(text, start, end)
            if quoted and " " in v and _phrase(v) and (not got or got[0][0] == start) and (one := _judge(text, start, end, True)):
                got = [one]
            found += got
    found.sort()
    apart: list[tuple[int, int, str]] = []
    for x in found:
        if not apart or x[0] >= apart[-1][1]:
            apart.append(x)
    return apart


def _name_before(text: str, start: int) -> tuple[str, str]:
    """The name a value is assigned to, and whether it is the argument of a call."""
    line = text.rfind("\n", 0, start) + 1
    reach = 200  # more where a name begins before it
    while True:
        begin = max(line, start - reach)
        left = text[begin:start]
        m = _NAME.search(left)
        if not m or m.start() or begin == line:
            break
        reach *= 4
    paren = max(text.rfind("(", line, start), text.rfind(")", line, start))  # the call's bracket is the last one
    call = bool(_CALL.search(left if paren >= begin else text[max(line, paren - 40) : start])) if paren >= 0 else False
    if m:
        return m.group(1).rpartition(".")[2] if not m.group(1).startswith("-") else m.group(1), "call" if call else "name"
    if not left.strip(" \t\"'`-") and line:
        above = text[text.rfind("\n", 0, line - 1) + 1 : line - 1]
        m = _BLOCK_NAME.search(above) or re.search(r"([A-Za-z_][\w.-]*)[\"']?\s*(?::=|=|:)\s*[(\\]?\s*$", above)
        if m:
            return m.group(1), "name"
    return "", "call" if call else "free"


def _judge(text: str, start: int, end: int, quoted: bool, name: str | None = None) -> tuple[int, int, str] | None:
    value = text[start:end]
    if quoted and end < len(text) and text[end] in "\"'":  # literals side by side are one value
        at = end + 1
        while True:
            m = _NEXT_PART.match(text, at)
            if not m or m.start(1) == at:
                break
            value += m.group(2)
            at = m.end()
            end = m.end() - 1
    place = "name"
    if name is None:
        name, place = _name_before(text, start)
    setting = False
    if not quoted and name and place == "name":
        line = text.rfind("\n", 0, start) + 1
        stop = text.find("\n", end)
        setting = bool(_SETTING_LEFT.fullmatch(text[line:start]) and _SETTING_RIGHT.fullmatch(text[end : stop if stop >= 0 else len(text)]))
    return (start, end, "token" if _ISSUED.match(value) else "secret") if _is_secret(value, name, place, quoted, setting) else None


def _inside(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Candidates within a string of several words, an assignment or an unquoted token."""
    out: list[tuple[int, int, str]] = []
    for m in _INSIDE.finditer(text, start, end):
        s, e = m.span()
        while e > s and text[e - 1] in ".,:;!?}" and text[e - 1] != "=":
            e -= 1
        v = text[s:e]
        if "=" in v and ("?" in v or "&" in v):  # parameters of a connection string
            named = [(s + p.start(2), s + p.end(2), p.group(1).rpartition(".")[2]) for p in _PARAMETER.finditer(v)]
            secrets = [x for a, b, name in named if name_kind(name) == "secret" and (x := _judge(text, a, b, True, name))]
            if secrets:
                out += [x for x in secrets if x[0] < end]
                continue
        ref = re.search(r"\$\{[\w.-]+:-?([^}]+)$", v)
        if ref:  # a reference with a default
            got = _judge(text, s + ref.start(1), e, True, v[2 : ref.start(1)].lstrip("{"))
        else:
            part = re.match(r"([\w.-]*[A-Za-z][\w.-]*)(?::=|=|:)(?=[^=])", v)
            if part and not v.startswith(("eyJ", "SG.")):
                got = _judge(text, s + part.end(), e, part.end() > 3 and text[s + part.end() : e][:1] not in "([{", part.group(1).rpartition(".")[2])
            else:
                got = _judge(text, s, e, bool(_ISSUED.match(v)) or not re.fullmatch(r"[A-Za-z_]\w*", v) or bool(_SCHEME.search(text, max(start, s - 8), s)))
        if got and got[0] < end:
            out.append((got[0], min(got[1], e), got[2]))
    return out


def redact(text: str | None, found: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with ``<redacted:kind>`` for each credential; of a private key its lines stay, without their characters."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in find(text) if found is None else found:
        out.append(text[at:start])
        if kind == "private_key":
            out.append("\n".join(["<redacted:private_key>", *re.findall(r"\n([ \t]*)", text[start:end])]))
        else:
            keep = re.search(r"[\"'][^\w\"']*\n[^\w\"']*[\"']", text[start:end])
            out.append(f"<redacted:{kind}>" if not keep else f"<redacted:{kind}>" + keep.group())
        at = end
    return "".join([*out, text[at:]])


def _rows(redacted: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, lines, kinds, texts = b.column(0), [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                got = find(text)
                if redacted:
                    texts.append(redact(text, got))
                    lines.append(len(got))
                    continue
                line, at = 1, 0
                for start, _, kind in got:
                    line += text.count("\n", at, start)
                    at = start
                    ids.append(i)
                    lines.append(line)
                    kinds.append(kind)
            if redacted:
                yield pa.RecordBatch.from_arrays([keys, pa.array(lines, pa.int32()), pa.array(texts, pa.string())], names=["id", "credentials", "redacted"])
            elif ids:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(ids)), pa.array(lines, pa.int64()), pa.array(kinds, pa.string())], names=["id", "line", "kind"])

    return run


def find_credentials(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, line, kind)``: the line on which each credential begins; repeated rows count once."""
    got = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL AND text <> ''")
    kind = files.schema[id_col].dataType.simpleString()
    return got.mapInArrow(_rows(False), f"id {kind}, line bigint, kind string").distinct().withColumnRenamed("id", id_col)


def redact_credentials(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, credentials, redacted)``: one row for each row, with the text after redaction."""
    got = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = files.schema[id_col].dataType.simpleString()
    return got.mapInArrow(_rows(True), f"id {kind}, credentials int, redacted string").withColumnRenamed("id", id_col)
