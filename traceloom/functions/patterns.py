"""Search patterns of the surveyed dialect (ECMAScript, with flags in front) as patterns that Spark runs.

What is spelt alike and means something else is translated: groups' names, code points `\\u{...}`, `[^]` and `[]`, brackets and
`&` in classes, white space, word bounds, the dot, line ends, braces that are no quantifier, and letters escaped for no
reason. What the dialect does not have (possessive quantifiers, atomic groups, flags inside) or Spark cannot
compile is refused with ValueError before any job. A reference to a group that has not matched fails here, while the
dialect takes it as empty.
"""

from __future__ import annotations

import re

_SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_ENDS = r"\n\r\u2028\u2029"
_BOUND = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")


class _Translator:
    def __init__(self, pattern: str):
        front = re.match(r"\(\?([ims]+)\)", pattern)
        self.text, self.flags = pattern[front.end() :] if front else pattern, set(front[1]) if front else set()
        self.at, self.names = 0, {}

    def refuse(self, why: str) -> ValueError:
        return ValueError(f"pattern {self.text!r}, character {self.at + 1}: {why}")

    def name(self, given: str) -> str:
        return self.names.setdefault(given, f"g{len(self.names)}")

    def take(self, what: str) -> re.Match | None:
        found = re.compile(what).match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def escape(self, inside: bool) -> str:
        """What follows a backslash."""
        if m := self.take(r"u\{([0-9A-Fa-f]{1,6})\}"):
            return f"\\x{{{m[1]}}}"
        if m := self.take(r"u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|c[A-Za-z]|[dDwWtnrf]"):
            return "\\" + m[0]
        if m := self.take(r"([pP])\{(?:(?:Script|sc)=)?(\w+)\}"):
            return f"\\{m[1]}{{{'Is' if 'Script=' in m[0] or 'sc=' in m[0] else ''}{m[2]}}}"
        if self.take("v"):
            return r"\x0B"
        if self.take(r"0(?!\d)"):
            return r"\x00"
        if self.take("s"):
            return _SPACE if inside else f"[{_SPACE}]"
        if self.take("S"):
            return f"[^{_SPACE}]"
        if inside and self.take("b"):
            return r"\x08"
        if not inside:
            if self.take("b"):
                return _BOUND
            if self.take("B"):
                return f"(?!{_BOUND})"
            if m := self.take(r"k<([^>]+)>"):
                if m[1] not in self.names:
                    raise self.refuse(f"no group {m[1]} before")
                return f"\\k<{self.name(m[1])}>"
            if m := self.take(r"[1-9]\d?"):
                return f"\\{m[0]}"
        if self.at == len(self.text):
            raise self.refuse("nothing after the last backslash")
        c = self.text[self.at]
        self.at += 1
        return c if c.isalnum() or c == "_" else "\\" + c

    def in_class(self) -> str:
        if self.take(r"\[\^\]"):
            return r"[\s\S]"
        if self.take(r"\[\]"):
            return "(?!)"
        out = [self.take(r"\[\^?")[0]]
        while not self.take(r"\]"):
            if self.at == len(self.text):
                raise self.refuse("a class is not closed")
            if self.take(r"\\"):
                out.append(self.escape(True))
            else:
                c = self.text[self.at]
                self.at += 1
                out.append("\\" + c if c in "[&^" else c)
        return "".join(out) + "]"

    def group(self) -> str:
        if m := self.take(r"\(\?<([A-Za-z_$][\w$]*)>"):
            if m[1] in self.names:
                raise self.refuse(f"a second group {m[1]}")
            return f"(?<{self.name(m[1])}>"
        if m := self.take(r"\(\?(?:[:=!]|<[=!]|[ims]*(?:-[ims]+)?:)|\((?!\?)"):
            return m[0]
        raise self.refuse("no group of this dialect (atomic groups and flags inside a pattern are none)")

    def run(self) -> str:
        out, quantified = [], False
        while self.at < len(self.text):
            c, was, quantified = self.text[self.at], quantified, False
            if c == "[":
                out.append(self.in_class())
            elif c == "(":
                out.append(self.group())
            elif m := self.take(r"[*+?]") or (_QUANTIFIER.match(self.text, self.at) and self.take(_QUANTIFIER.pattern)):
                if was and m[0] != "?":
                    raise self.refuse("a quantifier follows a quantifier")
                out.append(m[0])
                quantified = not was
                if was and self.take(r"[*+?]"):
                    raise self.refuse("a quantifier follows a quantifier")
            else:
                self.at += 1
                out.append(self.other(c))
        # Flags in front hold for the whole pattern; letters match in any case as searches do.
        return "(?iu)" + "".join(out)

    def other(self, c: str) -> str:
        if c == "\\":
            return self.escape(False)
        if c == ".":
            return r"[\s\S]" if "s" in self.flags else f"[^{_ENDS}]"
        if c == "^":
            return rf"(?:\A|(?<=[{_ENDS}]))" if "m" in self.flags else r"\A"
        if c == "$":
            return rf"(?:\z|(?=[{_ENDS}]))" if "m" in self.flags else r"\z"
        return "\\" + c if c in "{}]" else c


def translate(pattern: str) -> str:
    """The pattern for Spark, in any case; ValueError if it is none of the dialect or cannot run."""
    from pyspark import SparkContext

    made = _Translator(pattern).run()
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(made)
        except Exception as error:  # the JVM's own words on what it cannot compile
            said = str(getattr(error, "java_exception", error)).splitlines()[0]
            raise ValueError(f"pattern {pattern!r} cannot run: {said}") from None
    return made
