r"""From ECMAScript-style patterns to java.util.regex and RE2.

Patterns are written for an engine in which \b, \w and \d are ASCII, \s is the Unicode white-space set and `i`
folds beyond ASCII. Java differs in \b and \s, RE2 in \s; both get what they lack spelt out.
"""

from __future__ import annotations

import re

SPACES_JAVA = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACES_RE2 = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BOUNDARY_JAVA = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?![A-Za-z0-9_])(?<=[A-Za-z0-9_]))"
#: Halves of the boundary, enough where the pattern itself says what stands on the other side.
OPENS_JAVA, CLOSES_JAVA = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
WORD_ITEM = r"(?:\\d|[A-Za-z0-9_]|\[(?:\\d|[A-Za-z0-9_](?:-[A-Za-z0-9_])?)+\])"
ENDS_WORD = re.compile(r"(?:\\d|(?<!\\)[A-Za-z0-9_]|\[(?:\\d|[A-Za-z0-9_](?:-[A-Za-z0-9_])?)+\])(?:\+|\{[1-9]\d*(?:,\d*)?\})?\Z")
#: A character, an escaped one or a class (of what it holds), and the class of separators at a context's end.
LEAD = re.compile(r"\[(?!\^)(?:\\[^bB]|[^\]\\\[])+\]|\\[dws./+\-°$]|[^\\\[\](){}?*+|.^$]")
SEPARATOR = re.compile(r"(\[(?!\^)(?:\\.|[^\]\\])+\])\{[1-9]\d*(?:,\d*)?\}\Z")
ITEM, QUANTIFIER = re.compile(WORD_ITEM), re.compile(r"[?*+]|\{\d+(?:,\d*)?\}")


def _alternatives(body: str) -> tuple[list[str], int]:
    """The alternatives of a group whose body begins here, and where it ends."""
    parts, began, depth, in_class, i = [], 0, 0, False, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")" and not depth:
            return [*parts, body[began:i]], i + 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            parts.append(body[began:i])
            began = i + 1
        i += 1
    return [*parts, body[began:]], len(body)


def starts_word(pattern: str) -> bool:
    """Whether whatever the pattern matches must begin with an ASCII word character. False where that isn't plain."""
    item = ITEM.match(pattern)
    if item:
        rest, sure = pattern[item.end() :], True
    elif pattern.startswith("(?:"):
        parts, end = _alternatives(pattern[3:])
        rest, sure = pattern[3 + end :], all(starts_word(part) for part in parts)
    else:
        return False
    many = QUANTIFIER.match(rest)
    optional = many and (many[0] in "?*" or many[0].startswith("{0"))
    return sure and (not optional or starts_word(rest[many.end() :]))


def leads(pattern: str) -> str | None:
    """The members of a class that holds every character a match can begin with, or nothing where that isn't plain."""
    found = ""
    while True:
        if pattern.startswith(r"\b"):
            pattern = pattern[2:]
            continue
        item = LEAD.match(pattern)
        group = re.match(r"\((?:\?:)?(?!\?)", pattern)
        if item:
            first = item[0]
            members = first[1:-1] if first[0] == "[" else first if first[0] == "\\" else re.escape(first)
            rest = pattern[item.end() :]
        elif group:
            parts, end = _alternatives(pattern[group.end() :])
            inner = [leads(part) for part in parts]
            if None in inner:
                return None
            members, rest = "".join(inner), pattern[group.end() + end :]
        else:
            return None
        found += members
        many = QUANTIFIER.match(rest)
        if not many or not (many[0] in "?*" or many[0].startswith("{0")):
            return found
        pattern = rest[many.end() :]


def needs_digit(pattern: str) -> bool:
    r"""Whether every match must hold an ASCII digit: each alternative has a \d that isn't optional, itself or in a group that isn't."""

    def one(part: str) -> bool:
        while part:
            look, group = re.match(r"\(\?<?[=!]", part), re.match(r"\((?:\?:)?(?!\?)", part)
            if look or group:
                parts, end = _alternatives(part[(look or group).end() :])
                held, rest = bool(group) and all(one(x) for x in parts), part[(look or group).end() + end :]
            elif item := re.match(r"\\.|\[(?:\\.|[^\]\\])+\]|[^()\[\]]", part, re.S):
                held, rest = item[0] in (r"\d", "[0-9]", r"[\d]"), part[item.end() :]
            else:
                return False
            many = QUANTIFIER.match(rest)
            if held and not (many and (many[0] in "?*" or many[0].startswith("{0"))):
                return True
            part = rest[many.end() :] if many else rest
        return False

    return all(one(part) for part in _alternatives(pattern)[0])


def ahead(pattern: str) -> str | None:
    """For a match after a looked-back context the context and the match as one forward pattern, else nothing."""
    if not pattern.startswith("(?<=") or len(_alternatives(pattern)[0]) > 1 or re.search(r"\\[1-9]", pattern):
        return None
    contexts, end = _alternatives(pattern[4:])
    context = contexts[0] if len(contexts) == 1 else f"(?:{'|'.join(contexts)})"
    return context + pattern[4 + end :]


def quick(pattern: str) -> str:
    """The pattern with tests before it that all its matches pass, so that most places of a text are left after one character.

    A context that stands before the match is looked back for only where the match itself is there, after the separator
    that ends the context.
    """
    if len(_alternatives(pattern)[0]) > 1 or re.search(r"\\[1-9]", pattern):
        return pattern
    if pattern.startswith("(?<="):
        contexts, end = _alternatives(pattern[4:])
        body = pattern[4 + end :]
        last = SEPARATOR.search(contexts[0]) if len(contexts) == 1 else None
        first = leads(body)
        tests = (f"(?=[{first}])" if first else "") + (f"(?<={last[1]})" if last else "")
        return f"{tests}(?={body}){pattern}"
    first = leads(pattern)
    if not first:
        return pattern
    if pattern.startswith(r"\b[") and not starts_word(pattern[2:]):
        # Most characters of any text are in such a class. What no longer run of it can end in isn't tried shorter.
        return re.sub(r"(\[(?:\\.|[^\]\\@])+\]\{\d+,\d*\})@", r"\1+@", pattern)
    return f"(?=[{first}]){pattern}"


def _translate(pattern: str, spaces: str, boundary: str, end: str, halves: tuple[str, str] | None = None) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(spaces if in_class else f"[{spaces}]")
            elif pair == r"\S" and not in_class:
                out.append(f"[^{spaces}]")
            elif pair == r"\b" and not in_class:
                if halves and starts_word(pattern[i + 2 :]):
                    out.append(halves[0])
                elif halves and ENDS_WORD.search(pattern[:i]):
                    out.append(halves[1])
                else:
                    out.append(boundary)
            elif pair == r"\/":
                out.append("/")
            else:
                out.append(pair)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c == "[":
                c = r"\["
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("[^")
                i += 2
                continue
        elif c == "$":
            c = end
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Spark's regex functions."""
    return ("(?iu)" if ignore_case else "") + _translate(pattern, SPACES_JAVA, BOUNDARY_JAVA, r"\z", (OPENS_JAVA, CLOSES_JAVA))


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for engines built on RE2; look-around, back-references and repeats over 1000 have no form there."""
    return ("(?i)" if ignore_case else "") + _translate(pattern, SPACES_RE2, r"\b", r"\z")


def re2_able(pattern: str) -> bool:
    if any(x in pattern for x in ("(?<=", "(?<!", "(?=", "(?!", r"\1")):
        return False
    return all(int(n) <= 1000 for n in re.findall(r"[{,](\d+)(?=[,}])", pattern))
