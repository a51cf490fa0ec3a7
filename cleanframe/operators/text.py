"""Steps on text. Any column is taken as its text form; in place where no new column is named. All run on streams."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cleanframe.functions.types import StepError, named, new_name, require
from cleanframe.functions.types import field as field_of
from cleanframe.plans.frame import Frame

#: What `strip_text` strips unless told: white space and control characters (fixed values).
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Longest text that an extraction reads, in characters.
LONGEST = 8192


def _text(frame: Frame, column: str) -> Column:
    field_of(frame.df, column)
    return named(column).cast("string")


def _put(frame: Frame, column: str, new: str | None, out: Column) -> Frame:
    return frame.with_df(frame.df.withColumn(column if new is None else new_name(frame.df, new), out))


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def find_replace(frame: Frame, column: str, find: str, replacement: str, regex: bool = False, new: str | None = None) -> Frame:
    r"""Replaces all matches. An empty literal inserts at every boundary between code points; `\1` names a group."""
    c = _text(frame, column)
    if regex:
        java = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
        return _put(frame, column, new, F.regexp_replace(c, F.lit(find), F.lit(java)))
    if find:
        return _put(frame, column, new, F.replace(c, F.lit(find), F.lit(replacement)))
    r = F.lit(replacement)
    around = F.concat(r, F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), replacement), r)
    return _put(frame, column, new, F.when(c == "", r).otherwise(around))


def strip_text(frame: Frame, column: str, characters: str | None = None, new: str | None = None) -> Frame:
    """Strips a set of characters at both ends."""
    return _put(frame, column, new, F.btrim(_text(frame, column), F.lit(STRIPPED if characters is None else characters)))


def split_text(frame: Frame, column: str, delimiter: str, index: int, new: str) -> Frame:
    """The part at `index` (from 0) between literal delimiters; null where there are fewer."""
    if not delimiter:
        raise StepError("a split needs a delimiter")
    return _put(frame, column, new, F.get(F.split(_text(frame, column), _quoted(delimiter), -1), index))


def split_text_columns(frame: Frame, column: str, delimiter: str, new: list[str]) -> Frame:
    """The first parts as columns: empty parts stay empty, missing parts are null, further parts are left out."""
    if not delimiter or not 2 <= len(new) <= 64:
        raise StepError("a split takes a delimiter and 2 to 64 names")
    parts = F.split(_text(frame, column), _quoted(delimiter), -1)
    names = []
    for name in new:
        new_name(frame.df, name)
        if name.lower() in names:
            raise StepError(f"{name!r} is named twice")
        names.append(name.lower())
    return frame.with_df(frame.df.select("*", *[F.get(parts, i).alias(n) for i, n in enumerate(new)]))


def _with_group_required(pattern: str, group: int) -> str | None:
    """The pattern with its `group` made mandatory, where a `?` right behind the group makes it optional."""
    depth, seen, at = [], 0, 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\":
            at += 2
            continue
        if ch == "[":
            at = pattern.index("]", at + 2) + 1
            continue
        if ch == "(":
            number = 0
            if pattern[at + 1 : at + 2] != "?":
                seen += 1
                number = seen
            depth.append(number)
        elif ch == ")" and depth.pop() == group:
            return pattern[: at + 1] + pattern[at + 2 :] if pattern[at + 1 : at + 2] == "?" else None
        at += 1
    return None


def extract_regex_group(frame: Frame, column: str, pattern: str, group: int, new: str) -> Frame:
    """The group of the first match; null where nothing matches or the group takes no part in the match."""
    require(frame.df, column, {"string"}, "extractRegexGroup")
    groups = re.compile(pattern).groups
    if not 0 <= group <= min(9, groups):
        raise StepError(f"the pattern has {groups} groups, not {group}")
    c = named(column)
    found = F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))
    required = _with_group_required(pattern, group) if group else None
    if required:  # an empty result is the group's own only where the whole match needs it
        part = F.regexp_extract(c, pattern, 0)
        found = F.when((F.regexp_extract(c, pattern, group) != "") | F.regexp_like(part, F.lit(f"^(?:{required})$")), found)
    long = F.length(c) > LONGEST
    checked = F.when(long, F.raise_error(F.lit(f"{column}: text over {LONGEST} characters"))).otherwise(found)
    return frame.with_df(frame.df.withColumn(new_name(frame.df, new), checked.cast("string")))


def capitalize_text(frame: Frame, column: str, new: str | None = None) -> Frame:
    """The first code point upper case, the rest lower."""
    c = _text(frame, column)
    return _put(frame, column, new, F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1))))


def lower_text(frame: Frame, column: str, new: str | None = None) -> Frame:
    return _put(frame, column, new, F.lower(_text(frame, column)))


def upper_text(frame: Frame, column: str, new: str | None = None) -> Frame:
    return _put(frame, column, new, F.upper(_text(frame, column)))
