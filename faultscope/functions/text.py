"""Text hygiene: control and bidi characters, one-line fields, clipping."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultscope.functions.sql import char, let_sql, regex

# Code points that may not reach a reader raw. TAB and LF stay.
CONTROL_CLASS = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"
INVISIBLE_CLASS = r"[\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]"

# Limits of displayed fields.
MESSAGE_LIMIT = 400
CAUSE_LINE_LIMIT = 500
CAUSE_LINES = 12
SUGGESTION_LIMIT = 300
EXCERPT_LIMIT = 300

# Unicode white space, as a trim set and as a class.
_SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
           + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Every boundary that ends a line: LF, CR, CRLF, VT, FF, FS-RS, NEL, LS, PS.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip_unicode(text: Column) -> Column:
    """Trim Unicode white space. A trim set is linear where a regex on the end
    of a long run of blanks is quadratic."""
    return F.btrim(text, F.lit(_SPACES))


def split_lines(text: Column) -> Column:
    """Array of lines; a final line break opens no further line."""
    return let_sql(F.split(text, LINE_BREAK, -1), "p", "if(element_at(p, -1) = '', slice(p, 1, size(p) - 1), p)")


def _shown(klass: str, mark: str) -> str:
    """SQL over ``t``: every character ``h`` of a class replaced by its mark. One split
    around the hits, so the work doesn't grow with the number of listed characters.
    Most text holds none."""
    marks = f"transform(regexp_extract_all(t, {regex(klass)}, 0), h -> {mark})"
    return f"if(t rlike {regex(klass)}, array_join(zip_with(split(t, {regex(klass)}, -1), {marks}, (p, m) -> concat(p, coalesce(m, ''))), ''), t)"


_CONTROL_MARK = f"if(h = {char(0x1B)}, '<ESC>', concat('<0x', lower(lpad(hex(ascii(h)), 2, '0')), '>'))"
_INVISIBLE_MARK = "concat('<U+', lpad(hex(ascii(h)), 4, '0'), '>')"
_CONTROL_SHOWN = _shown(CONTROL_CLASS, _CONTROL_MARK)
_INVISIBLE_SHOWN = _shown(INVISIBLE_CLASS, _INVISIBLE_MARK)


def strip_control(text: Column) -> Column:
    """Show C0, DEL and C1 characters as ``<0xhh>`` and ESC as ``<ESC>``."""
    return let_sql(text, "t", _CONTROL_SHOWN)


def strip_bidi(text: Column) -> Column:
    """Show invisible and reordering characters as ``<U+HHHH>``."""
    return let_sql(text, "t", _INVISIBLE_SHOWN)


def visible(text: Column) -> Column:
    """Both passes: text that is safe to print."""
    return strip_bidi(strip_control(text))


def oneline(text: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """One line of visible text: runs of blanks become one, and a cut is marked."""
    flat = F.trim(F.regexp_replace(visible(text), _SPACE_RUN, " "))
    return let_sql(flat, "t", f"if(length(t) <= {limit}, t, concat(left(t, {limit}), ' [cut here]'))")


def clip(text: Column, limit: int = EXCERPT_LIMIT) -> Column:
    """Cut an over-long excerpt and say how much is hidden."""
    return let_sql(text, "t", f"if(length(t) <= {limit}, t, concat(left(t, {limit}), ' [', length(t) - {limit}, ' more characters]'))")


def cause_lines(text: Column) -> Column:
    """struct<lines array<string>, hidden int>: the first lines of a root cause."""
    parts = split_lines(text)
    return F.struct(F.transform(F.slice(parts, 1, CAUSE_LINES), lambda t: oneline(t, CAUSE_LINE_LIMIT)).alias("lines"),
                    F.greatest(F.size(parts) - CAUSE_LINES, F.lit(0)).alias("hidden"))
