"""Path templates such as ``/in/{state}_{kind}.psv`` as column operators."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, functions as F

_PLACEHOLDER = re.compile(r"\{([a-zA-Z0-9_]*)\}")


def capture_placeholders(template: str, names: Sequence[str], pattern: str = ".*?") -> str:
    """Regular expression for a template.

    A ``{name}`` listed in ``names`` becomes a capturing group, any other one matches
    without being captured, and the text between them stands for itself.
    """
    out, at = [], 0
    for found in _PLACEHOLDER.finditer(template):
        out.append(re.escape(template[at : found.start()]))
        out.append(f"({pattern})" if found[1] in names else pattern)
        at = found.end()
    return "".join([*out, re.escape(template[at:])])


def captured_names(template: str, names: Sequence[str]) -> list[str]:
    """The listed names in the order of their groups, which is template order."""
    return [m[1] for m in _PLACEHOLDER.finditer(template) if m[1] in names]


def with_placeholders(
    df: DataFrame, column: str, template: str, names: Sequence[str], pattern: str = ".+"
) -> DataFrame:
    """Keep the rows whose text starts with a match and add one column per captured name."""
    regex = "^" + capture_placeholders(template, names, pattern)
    groups = {
        name: F.regexp_extract(F.col(column), regex, group + 1)
        for group, name in enumerate(captured_names(template, names))
    }
    return df.where(F.col(column).rlike(regex)).withColumns(groups)


def file_path() -> Column:
    """Path of the file a scanned row comes from, decoded.

    The metadata column is percent-encoded; a plus sign in it means itself.
    """
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def plain_path(file: str) -> str:
    """Path of a file by its metadata column, in the form in which files are listed."""
    return re.sub("^file:/+", "/", unquote(file))
