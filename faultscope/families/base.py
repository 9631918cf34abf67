"""What a family is made of: an ordered list of line signatures and its sentences.

Families are data. Payload values and special sentences are Spark SQL snippets:
``{1}`` stands for a group of the pattern, ``{key}`` for a payload value.
"""

import re
from dataclasses import dataclass, field

from faultscope.functions.sql import literal, regex


@dataclass(frozen=True)
class Field:
    """One payload entry: a group number, or a snippet over groups. An ``optional``
    entry is left out when its text is empty; a null one always is."""

    key: str
    value: int | str
    optional: bool = False


@dataclass(frozen=True)
class Signature:
    """A line that states one observation.

    ``probes`` are literals of which one occurs in every matching line: they are
    searched before the pattern because Catalyst does not take literals out of a
    regular expression. Patterns are Java syntax; ``(?U)`` gives ``\\w \\s \\d``
    their Unicode meaning. ``unless`` drops matching lines that say nothing;
    ``expand`` makes several observations of one line.
    """

    kind: str
    probes: tuple[str, ...]
    pattern: str
    fields: tuple[Field, ...] = ()
    unless: str | None = None
    expand: str | None = None

    def _fill(self, snippet: str, line: str) -> str:
        return re.sub(r"\{(\d)\}", lambda m: f"regexp_extract({line}, {regex(self.pattern)}, {m[1]})", snippet)

    def matches(self, line: str) -> str:
        probes = " or ".join(f"contains({line}, {literal(p)})" for p in self.probes)
        return f"(({probes}) and {line} rlike {regex(self.pattern)})"

    def payload(self, line: str) -> str:
        if not self.fields:
            return "cast(map() as map<string,string>)"
        entries = []
        for f in self.fields:
            value = "{%d}" % f.value if isinstance(f.value, int) else f.value
            value = self._fill(f"nullif({value}, '')" if f.optional else value, line)
            entries.append(f"{literal(f.key)}, cast({value} as string)")
        whole = f"map({', '.join(entries)})"
        sure = all(isinstance(f.value, int) and not f.optional for f in self.fields)
        return whole if sure else f"map_filter({whole}, (k, v) -> v is not null)"

    def observations(self, line: str) -> str:
        """array<struct<ordinal, kind, data>> of a matching line."""
        if self.expand:
            return self._fill(self.expand, line)
        one = f"array(struct(0 as ordinal, {literal(self.kind)} as kind, {self.payload(line)} as data))"
        return f"case when not ({self._fill(self.unless, line)}) then {one} end" if self.unless else one


# Names in quotes of their own kind, with commas between. A name is passed over whole, so a
# list without an end costs no more than its length.
_ITEM = "(?:'[^']*+'|\"[^\"]*+\"|`[^`]*+`)"
_LIST = rf"((?:\s{{0,16}}{_ITEM}\s{{0,16}},?)*+)"
#: SQL of the names of a ``<list>`` that is group 1: without their quotes, none empty.
LISTED = f"filter(transform(regexp_extract_all({{1}}, {regex(_ITEM)}, 0), n -> substr(n, 2, length(n) - 2)), n -> n <> '')"

# What the places of a line template stand for. Places with a group hold a value; the others
# are the room that formats leave between words. A run that could be tried again from every
# position is bounded.
_PLACES = {
    "int": r"(\d{1,64})", "signed": r"(-?\d{1,64})", "tactic": r"(0x\p{XDigit}{1,32}|\d{1,64})", "decimal": r"(\d{1,32}(?:\.\d{0,32})?)",
    "version": r"(\d{1,9}(?:\.\d{1,9}){0,7})", "bits": r"(?:0x(\p{XDigit}{1,32})|(\d{1,32}))(?!\w)",
    "name": r"(\w{1,128})", "path": r"([\w./-]{1,512})", "word": r"(\S{1,512})", "last": r"(\S++)", "code": r"([A-Z][0-9A-Z_]{1,63})", "outcome": r"(FAILED|PASSED)",
    "value": r"([^\s,;()\[\]%]{1,128})", "label": r"([^:]{1,512})", "inner": r"([^\]\)\"']{1,512})", "dims": r"([^()]{0,512})", "list": _LIST, "rest": r"(.+)$", "text": r"(.{1,512}?)",
    "quoted": "['\"`]([^'\"`]{1,1024})['\"`]", "apostrophes": r"'([^']{0,4096})'",
    "blank": r"\s{0,16}", "gap": r"[:\s]{1,16}", "eq": r"\s{0,16}=\s{0,16}", "end": r"\s*$",
}
_PLACE = re.compile(f"<({'|'.join(_PLACES)})>")


def line(kind: str, template: str, *fields: Field, **more: str) -> Signature:
    """A signature of literal text with typed places, such as ``<int>``, ``<quoted>`` (a name in
    quotes) or ``<rest>`` of the line. Their groups are 1, 2, … in order and the longest
    literal is the probe; ``more`` are ``unless`` and ``expand`` of the signature."""
    parts = _PLACE.split(template)
    pattern = "".join(re.escape(text) + _PLACES.get(place, "") for text, place in zip(parts[::2], [*parts[1::2], ""]))
    return Signature(kind, (max(parts[::2], key=len),), "(?U)" + pattern, fields, **more)


@dataclass(frozen=True)
class Context:
    """Block context: the ``opens`` kinds set ``key``; the ``takes`` kinds
    (every kind when None) without a ``key`` of their own receive the last one.
    With ``required``, a taking line before any block is no fact at all."""

    key: str
    opens: tuple[str, ...]
    takes: tuple[str, ...] | None = None
    required: bool = False


class Sql(str):
    """A sentence that is a snippet rather than a template."""


@dataclass(frozen=True)
class Family:
    name: str
    signatures: tuple[Signature, ...]
    summaries: dict[str, str]
    context: Context | None = None
    rules: list[dict] = field(default_factory=list)


def sentence(template: str, data: str) -> str:
    """SQL of a sentence: ``{key}`` is a payload value, ``{key:120}`` cuts it."""
    if isinstance(template, Sql):
        return re.sub(r"\{(\w+)\}", lambda m: f"{data}[{literal(m[1])}]", template)
    parts = re.split(r"\{(\w+)(?::(\d+))?\}", template)
    out = []
    for i in range(0, len(parts), 3):
        if parts[i]:
            out.append(literal(parts[i]))
        if i + 1 < len(parts):
            value = f"coalesce({data}[{literal(parts[i + 1])}], '?')"
            out.append(f"left({value}, {parts[i + 2]})" if parts[i + 2] else value)
    return f"concat({', '.join(out)})"
