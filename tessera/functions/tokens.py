"""Tokenisers of identifiers, as functions from a string column to an array column.

All stay inside generated code or higher-order functions; none is a UDF. Null names give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where an identifier breaks (never at its start).
BOUNDARIES = (
    r"(?<=[^A-Z0-9])(?=[A-Z0-9])",  # other character, then upper case or digit
    r"(?<=[A-Z])(?=[0-9])",  # upper case, then digit
    r"(?<=[0-9])(?=[A-Za-z])",  # digit, then letter
    r"(?<=.)(?=[A-Z][a-z])",  # before a capitalised word
)
DELIMITERS = "[_.]"


def _col(name: Column | str) -> Column:
    return F.col(name) if isinstance(name, str) else name


def _grams(text: Column, n: int) -> Column:
    """The substrings of n characters, from left to right; none if text is shorter."""
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    )


def subtokens(name: Column | str) -> Column:
    """Lower-case subtokens of an identifier: split at _ and . and at case and digit boundaries; empties dropped."""
    return F.transform(F.filter(F.split(_col(name), "|".join((DELIMITERS, *BOUNDARIES))), lambda t: t != ""), F.lower)


def characters(name: Column | str) -> Column:
    """Lower-case characters."""
    return F.filter(F.split(F.lower(_col(name)), ""), lambda t: t != "")


def character_bigrams(name: Column | str) -> Column:
    """Two-character substrings; of an empty name one empty string, of one character none."""
    c = _col(name)
    return F.when(c == "", F.array(F.lit(""))).otherwise(_grams(c, 2))


def subtoken_bigrams(name: Column | str) -> Column:
    """Two-character substrings of each subtoken."""
    return F.flatten(F.transform(subtokens(name), lambda t: _grams(t, 2)))


def subtoken_trigrams(name: Column | str) -> Column:
    """Three-character substrings of each subtoken; shorter subtokens stay whole."""
    return F.flatten(F.transform(subtokens(name), lambda t: F.when(F.length(t) < 3, F.array(t)).otherwise(_grams(t, 3))))


def subtokens_and_trigrams(name: Column | str) -> Column:
    return F.concat(subtokens(name), subtoken_trigrams(name))


def words(name: Column | str) -> Column:
    """Tokens separated by spaces."""
    return F.filter(F.split(_col(name), " "), lambda t: t != "")


def token_table(nodes: DataFrame, tokenizer=subtokens, name: str = "name") -> DataFrame:
    """tokens(node_id, pos, token): one row per token of each node; nodes without tokens give none."""
    return nodes.select("node_id", F.posexplode(tokenizer(name)).alias("pos", "token"))


def dot_escape(text: Column | str) -> Column:
    """Text for a DOT label: double quotes as two single ones, line breaks and ^ as spaces, backslashes doubled."""
    c = F.replace(_col(text), F.lit('"'), F.lit("''"))
    return F.translate(F.replace(c, F.lit("\\"), F.lit("\\\\")), "\r\n^", "   ")


def link(base: Column | str, root_length: int, path: Column | str, line: Column | str) -> Column:
    """Address of a source line: base, path below the root with forward slashes, #L and the 1-based line."""
    below = F.replace(_col(path).substr(F.lit(root_length + 1), F.length(_col(path))), F.lit("\\"), F.lit("/"))
    return F.concat(base if isinstance(base, Column) else F.lit(base), below, F.lit("#L"), (_col(line) + 1).cast("string"))


def display(kind: Column | str, name: Column | str, value: Column | str, type_: Column | str) -> Column:
    """name : type, or const:value : type for constants."""
    return F.concat_ws(" : ", F.when(_col(kind) == "const", F.concat(F.lit("const:"), F.coalesce(_col(value), F.lit("null")))).otherwise(_col(name)), _col(type_))


def dot_label(kind: Column | str, name: Column | str, value: Column | str, type_: Column | str) -> Column:
    """Label of a node in DOT: the name, *name for method returns, the constant and its type in bold."""
    const = F.concat(F.lit("const:"), F.coalesce(_col(value), F.lit("null")), F.lit("\n<B>"), _col(type_), F.lit("</B>"))
    return F.when(_col(kind) == "const", const).when(_col(kind) == "methodReturn", F.concat(F.lit("*"), _col(name))).otherwise(_col(name))
