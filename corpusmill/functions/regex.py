"""Python patterns as Java patterns, so that matching stays in generated JVM code.

A search that may backtrack from many places goes to RE2, whose time is linear in the text.
"""

from __future__ import annotations

import logging
import re
from re import _constants as _re
from re import _parser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
FLAGS = {n: getattr(re, n) for n in ("IGNORECASE", "MULTILINE", "DOTALL", "VERBOSE", "ASCII", "LOCALE", "UNICODE", "I", "M", "S", "X", "A", "L", "U")}


def parse_flags(names: list[str]) -> int:
    flags = 0
    for n in names or ():
        if n in FLAGS:
            flags |= int(FLAGS[n])
        else:
            LOG.warning("unknown regex flag: %s", n)
    return flags


def to_java(pattern: str, flags: int = 0) -> str | None:
    """The same pattern for Java, or None if Java has no equal."""
    if flags & re.LOCALE or re.search(r"\(\?\(|\(\?P[<=][^>)]*_|\(\?[aLu]", pattern):
        return None
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    # Java takes [ and && within a class as nested sets
    if re.search(r"\[[^\]]*(?:\[|&&)", re.sub(r"\\.", "", out)):
        return None
    inline = "d" + "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if flags & f)
    if not flags & re.ASCII:
        inline += "U" + ("u" if flags & re.I else "")
    return f"(?{inline}){out}"


_REPEATS = (_re.MAX_REPEAT, _re.MIN_REPEAT)
_SPACE = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What a class of characters holds, of all and of ASCII ones.
_CLASSES = {_re.CATEGORY_DIGIT: (r"\p{Nd}", "0-9"), _re.CATEGORY_WORD: (r"\p{L}\p{N}_", "0-9A-Za-z_"), _re.CATEGORY_SPACE: (_SPACE, r"\t-\r ")}
_NEGATED = {_re.CATEGORY_NOT_DIGIT: _re.CATEGORY_DIGIT, _re.CATEGORY_NOT_WORD: _re.CATEGORY_WORD, _re.CATEGORY_NOT_SPACE: _re.CATEGORY_SPACE}
#: Characters beyond ASCII that Python takes for these letters when case is ignored.
_LIKE = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


class _NoEqual(Exception):
    pass


def _letters(code: int, flags: int) -> str:
    """A character as part of a class of RE2's, in both cases if that counts."""
    if not flags & re.I or code < 128 and not chr(code).isalpha():
        return f"\\x{{{code:x}}}"
    if code > 127:
        raise _NoEqual
    low = chr(code).lower()
    return "".join(f"\\x{{{ord(c):x}}}" for c in low + low.upper() + ("" if flags & re.A else _LIKE.get(low, "")))


def _re2_class(items: list, flags: int) -> str:
    if len(items) == 1 and items[0][0] is _re.CATEGORY and items[0][1] in _NEGATED:
        items = [(_re.NEGATE, None), (_re.CATEGORY, _NEGATED[items[0][1]])]
    out = ""
    for op, av in items:
        if op is _re.NEGATE:
            out += "^"
        elif op is _re.LITERAL:
            out += _letters(av, flags)
        elif op is _re.CATEGORY and av in _CLASSES:
            out += _CLASSES[av][bool(flags & re.A)]
        elif op is _re.RANGE and not flags & re.I:
            out += f"\\x{{{av[0]:x}}}-\\x{{{av[1]:x}}}"
        elif op is _re.RANGE and av[1] < 128:
            out += "".join(_letters(c, flags) for c in range(av[0], av[1] + 1))
        else:
            raise _NoEqual
    return f"[{out}]"


def _re2(tree, flags: int) -> str:
    out = []
    for op, av in tree:
        if op is _re.LITERAL:
            out.append(_re2_class([(op, av)], flags))
        elif op is _re.NOT_LITERAL:
            out.append(_re2_class([(_re.NEGATE, None), (_re.LITERAL, av)], flags))
        elif op is _re.ANY:
            out.append("(?s:.)" if flags & re.S else r"[^\n]")
        elif op is _re.IN:
            out.append(_re2_class(av, flags))
        elif op is _re.BRANCH:
            out.append("(?:" + "|".join(_re2(t, flags) for t in av[1]) + ")")
        elif op is _re.SUBPATTERN:
            out.append(f"(?:{_re2(av[3], (flags | av[1]) & ~av[2])})")
        elif op in _REPEATS:
            least, most, body = av
            out.append(f"(?:{_re2(body, flags)}){{{least},{'' if most == _re.MAXREPEAT else most}}}")
        elif op is _re.AT and av is _re.AT_BEGINNING and flags & re.M:
            out.append("(?m:^)")
        elif op is _re.AT and av in (_re.AT_BEGINNING, _re.AT_BEGINNING_STRING):
            out.append(r"\A")
        elif op is _re.AT and av is _re.AT_END and flags & re.M:
            out.append("(?m:$)")
        elif op is _re.AT and av is _re.AT_END_STRING:
            out.append(r"\z")
        elif op is _re.AT and av is _re.AT_BOUNDARY and flags & re.A:
            out.append(r"\b")
        else:
            raise _NoEqual
    return "".join(out)


def to_re2(pattern: str, flags: int = 0) -> str | None:
    """A pattern that RE2 finds in the same texts, or None if it has no equal (references, looking around)."""
    if flags & re.LOCALE:
        return None
    tree = _parser.parse(pattern, flags)
    try:
        out = _re2(tree, tree.state.flags)
        pc.match_substring_regex(pa.array([""]), out)  # RE2 has limits of its own
    except (_NoEqual, pa.ArrowInvalid):
        return None
    return out


def _endless(tree) -> bool:
    """Whether some repeat has no end."""
    return any(
        op in _REPEATS and (av[1] == _re.MAXREPEAT or _endless(av[2])) or op is _re.SUBPATTERN and _endless(av[3]) or op is _re.BRANCH and any(map(_endless, av[1]))
        for op, av in tree
    )


def backtracks(tree) -> bool:
    """Whether something follows an endless repeat, or it repeats more than one character: what a failure costs isn't bounded by the pattern."""
    tree = list(tree)
    if not tree:
        return False
    if _endless(tree[:-1]):
        return True
    op, av = tree[-1]
    if op in _REPEATS:
        return _endless(av[2]) or _endless(tree[-1:]) and (len(av[2]) > 1 or av[2][0][0] in (_re.SUBPATTERN, _re.BRANCH))
    return op is _re.SUBPATTERN and backtracks(av[3]) or op is _re.BRANCH and any(map(backtracks, av[1]))


def to_java_replacement(text: str) -> str | None:
    """Python's \\1, \\g<1> and \\g<name> as $1 and ${name}."""
    out, at = [], 0
    for m in re.finditer(r"\\g<(\w+)>|\\(\d{1,2})|\\(.)|\$", text, re.S):
        out.append(text[at : m.start()])
        at = m.end()
        name, number, other = m.groups()
        if number is not None and number[0] != "0":
            out.append(f"${number}" if not text[at : at + 1].isdigit() else f"${number}")
            if text[at : at + 1].isdigit():
                return None
        elif name is not None:
            if name.isdigit():
                if text[at : at + 1].isdigit():
                    return None
                out.append(f"${name}")
            elif "_" in name:
                return None
            else:
                out.append(f"${{{name}}}")
        elif m.group() == "$":
            out.append(r"\$")
        elif other in ("n", "t", "r"):
            out.append({"n": "\n", "t": "\t", "r": "\r"}[other])
        elif other == "\\":
            out.append(r"\\")
        else:
            return None
    return "".join([*out, text[at:]])


def search(col: Column, pattern: str, flags: int = 0) -> Column:
    """Whether the pattern occurs; null stays null."""
    linear = to_re2(pattern, flags) if backtracks(_parser.parse(pattern, flags)) else None
    if linear is not None:

        @F.arrow_udf("boolean")
        def occurs(texts: pa.Array) -> pa.Array:
            return pc.match_substring_regex(texts, linear)

        return occurs(col)
    java = to_java(pattern, flags)
    if java is not None:
        return F.rlike(col, F.lit(java))
    compiled = re.compile(pattern, flags)

    @F.pandas_udf("boolean")
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else compiled.search(t) is not None)

    return found(col)


def substitute(col: Column, pattern: str, replacement: str, flags: int = 0, count: int = 0) -> Column:
    """``re.sub``; null stays null."""
    java, new = to_java(pattern, flags), to_java_replacement(replacement)
    if java is not None and new is not None and count == 0:
        return F.regexp_replace(col, F.lit(java), F.lit(new))
    compiled = re.compile(pattern, flags)

    @F.pandas_udf("string")
    def replaced(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else compiled.sub(replacement, t, count=count))

    return replaced(col)
