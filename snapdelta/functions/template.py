"""Field templates compiled to a column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.text import field_type, ref, shown_text

_SLOT = re.compile(r"\{\{\s*([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\}\}")
_MARKUP = re.compile(r"\{\{|\}\}|\{%|%\}|\{#|#\}")


class TemplateError(ValueError):
    """The template uses an unknown field or markup that is not a plain field."""


def compile_template(template: str, df: DataFrame) -> Column:
    """``concat`` of the fixed text and the fields named as ``{{ field }}``.

    Unknown fields fail here, on the driver, before any row is read. One newline at the end of
    the template is dropped.
    """
    if template.endswith("\n"):
        template = template[:-1]
    pieces: list[Column] = []
    for position, piece in enumerate(_SLOT.split(template)):
        if position % 2:
            try:
                pieces.append(shown_text(ref(piece), field_type(df, piece)))
            except KeyError:
                raise TemplateError(f"'{piece}' is undefined") from None
        elif _MARKUP.search(piece):
            raise TemplateError(f"unsupported template markup in {piece!r}")
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces) if pieces else F.lit("")
