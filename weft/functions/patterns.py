"""Pattern translation done once on the driver.

* date patterns written for the JS date library the configs target → Spark
  datetime patterns (parse side lenient on digit counts, like the JS parser);
* JS regular expressions → Java regular expressions with JS ``$`` semantics.
"""

from __future__ import annotations

import re

# Numeric date tokens the JS parser reads with 1..n digits,
# mapped to Spark's variable-width letters.
_LENIENT_PARSE = {
    "yyyy": "y", "y": "y", "MM": "M", "M": "M", "dd": "d", "d": "d", "do": "d",
    "HH": "H", "H": "H", "hh": "h", "h": "h", "mm": "m", "m": "m", "ss": "s", "s": "s",
}
# Tokens that mean the same to the JS library and to Spark ("do",
# the day with its ordinal ending, is composed from what Spark has).
_PARSED = {*_LENIENT_PARSE, "yy", "MMM", "MMMM", "a", "S", "SS", "SSS"}
_FORMATTED = {*_PARSED, "E", "EE", "EEE", "EEEE"}

_TOKEN_RE = re.compile(r"'(?:[^']|'')*'|do|([A-Za-z])\1*|.", re.S)


def _tokens(pattern: str) -> list[str]:
    return [m.group(0) for m in _TOKEN_RE.finditer(pattern)]


def date_token_error(pattern: str, formatting: bool) -> str | None:
    """The first token of a date pattern that isn't supported, or None."""
    known = _FORMATTED if formatting else _PARSED
    return next((t for t in _tokens(pattern) if t[0].isalpha() and t[0].isascii() and t not in known), None)


def has_token(pattern: str, token: str) -> bool:
    return token in _tokens(pattern)


def date_parse_pattern(pattern: str) -> str:
    """Pattern for ``try_to_timestamp`` that accepts what the JS parser accepts.

    Numbers may have fewer digits than their token, unless the next token is a
    number that follows at once: then only the widths part them.
    """
    toks = _tokens(pattern)
    number = [t in _LENIENT_PARSE or t == "yy" or t[0] == "S" for t in toks]
    out = []
    for i, tok in enumerate(toks):
        touches = number[i] and ((i > 0 and number[i - 1]) or (i + 1 < len(toks) and number[i + 1]))
        out.append("d" if tok == "do" else tok if touches else _LENIENT_PARSE.get(tok, tok))
    return "".join(out)


def date_format_pattern(pattern: str) -> list[str]:
    """Output pattern as pieces: patterns for ``date_format``, and ``do`` by itself."""
    out = [""]
    for tok in _tokens(pattern):
        if tok == "do":
            out += ["do", ""]
        else:
            out[-1] += tok
    return [x for x in out if x]


# White space of JS that Java's \s lacks.
_JS_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_REPEAT_RE = re.compile(r"\{[0-9]+(?:,[0-9]*)?\}")


def js_regex_to_java(pattern: str) -> str:
    """Rewrite a JS regex so Java matches the same way under ``rlike`` (find).

    * JS ``$`` without the ``m`` flag matches only at the very end, Java's also
      before a final line break: outside a class it becomes ``\\z``;
    * in a class, ``[`` and ``&&`` are characters to JS and operators to Java;
    * braces that aren't a repeat count are characters to JS;
    * ``\\s`` and ``\\S`` take JS's white space, which is more than ASCII's.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        step = 1
        if ch == "\\" and i + 1 < len(pattern):
            two, step = pattern[i : i + 2], 2
            if two == "\\s":
                two = _JS_SPACE if in_class else f"[{_JS_SPACE}]"
            elif two == "\\S":
                two = f"[^{_JS_SPACE}]"
            out.append(two)
        elif in_class:
            in_class = ch != "]"
            out.append("\\" + ch if ch in "[&" else ch)
        elif pattern.startswith("[^]", i) or pattern.startswith("[]", i):
            step = 3 if pattern[i + 1] == "^" else 2
            out.append("[\\s\\S]" if step == 3 else "(?!)")
        elif ch == "[":
            in_class = True
            out.append(ch)
        elif ch == "{":
            count = _REPEAT_RE.match(pattern, i)
            out.append(count.group() if count and i else "\\{")
            step = len(count.group()) if count and i else 1
        elif ch == "}":
            out.append("\\}")
        else:
            out.append("\\z" if ch == "$" else ch)
        i += step
    return "".join(out)


# a repeat of a repeat: possessive to Java, an error to JS
_TWICE_RE = re.compile(r"(?:\\.|\[(?:\\.|[^\]\\])*\]|[^\\\[])*?(?<!\\)[*+?}]\+", re.S)


def regex_error(pattern: str) -> str | None:
    """Test-compile a JS pattern on the driver with the engine that will run it; the error text, or None when valid."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext

    if _TWICE_RE.match(pattern):
        return f"Invalid regular expression: /{pattern}/: Nothing to repeat"
    java = js_regex_to_java(pattern)
    sc = SparkContext._active_spark_context
    try:
        if sc is not None:
            sc._jvm.java.util.regex.Pattern.compile(java)
        else:
            re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except Py4JJavaError as e:
        return f"Invalid regular expression: /{pattern}/: {e.java_exception.getDescription()}"
    except re.error as e:
        return f"Invalid regular expression: /{pattern}/: {e}"
    return None
