"""Text line expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def split_fields(line: Column, delimiter: str = "\t") -> Column:
    """Fields of one delimited line, with double-quoted fields unwrapped.

    A quote opens a quoted field only at the start of a field, and a doubled quote
    inside it stands for one quote.
    """
    if len(delimiter) != 1:
        raise ValueError("delimiter must be one character")
    sep = re.escape(delimiter)
    # possessive, so that a long field needs no stack
    field = f'{sep}("[^"]*+(?:""[^"]*+)*+"[^{sep}]*|[^{sep}]*)'
    quoted = '(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'

    def unwrap(f: Column) -> Column:
        inner = F.replace(F.regexp_extract(f, quoted, 1), F.lit('""'), F.lit('"'))
        return F.when(F.rlike(f, F.lit(quoted)), F.concat(inner, F.regexp_extract(f, quoted, 2))).otherwise(f)

    parsed = F.transform(F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(field), F.lit(1)), unwrap)
    return F.when(F.contains(line, F.lit('"')), parsed).otherwise(F.split(line, sep))
