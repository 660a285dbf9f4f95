"""JSON helpers: lenient parsing, Python-literal text, defaults."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python literal tokens and the JSON values they stand for.
_PY_TOKENS = (("None", "null"), ("True", "true"), ("False", "false"))


def python_literal_to_json(c: Column) -> Column:
    """SC17: Python-style dict text (single quotes, None/True/False) -> JSON-parsable text.

    Spark's JSON reader already accepts single-quoted strings; the bare Python
    keywords are rewritten. Quoted texts are matched whole, before any keyword,
    and stay as they are.
    """
    quoted = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
    # the text in pieces: quoted texts, words, and single other characters
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)({quoted}|\w+|.)"), F.lit(1))

    def rewrite(piece: Column) -> Column:
        out = piece
        for py, js in _PY_TOKENS:
            out = F.when(piece == py, F.lit(js)).otherwise(out)
        return out

    return F.array_join(F.transform(pieces, rewrite), "")


def parse_python_literal(c: Column, schema) -> Column:
    return F.from_json(python_literal_to_json(c), schema, {"allowSingleQuotes": "true"})


def parse_or_default(c: Column, schema, default: Column) -> Column:
    """SC14: parsed value, or ``default`` when null or not parsable."""
    return F.coalesce(F.from_json(c, schema), default)
