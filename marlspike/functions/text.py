"""Text functions as Spark columns, with the same in DuckDB SQL where queries need an oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators between terms and the stop words that results depend on.
SEPARATORS = r"""[\s\.,;:!?\-_'"()\[\]{}|\\/<>@#$%^&*+=`~]+"""
STOP_WORDS = """a an and are as at be by for from has he in is it its of on or that the to was were will with
var let const function class return if else this new true false null undefined""".split()

#: The edge of a word of ASCII letters, digits and underscores, as RE2 reads ``\b``; Java counts other letters as parts of words too.
ASCII_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def terms(text: Column, stop_words: bool = True) -> Column:
    """Lower-cased terms of more than one character, in order; stop words go unless asked otherwise."""
    every = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda t: F.length(t) > 1)
    low = F.transform(every, F.lower)
    return F.filter(low, lambda t: ~t.isin(STOP_WORDS)) if stop_words else low


def terms_sql(text: str, stop_words: bool = True) -> str:
    """The same as a DuckDB list expression."""
    every = f"list_transform(list_filter(regexp_split_to_array(coalesce({text}, ''), {sql_string(SEPARATORS)}), lambda x: length(x) > 1), lambda x: lower(x))"
    if not stop_words:
        return every
    return f"list_filter({every}, lambda x: x not in ({', '.join(map(sql_string, STOP_WORDS))}))"


def stem(word: Column) -> Column:
    """Suffix stripping for where no full stemmer is at hand: the first rule that fits is applied, once."""
    w = F.lower(word)
    n = F.length(w)
    cut = lambda k, more="": F.concat(F.substr(w, F.lit(1), n - k), F.lit(more)) if more else F.substr(w, F.lit(1), n - k)
    ends = lambda s: w.endswith(s)
    base_end = F.substr(w, n - 3, F.lit(1))
    return (
        F.when(ends("ing") & (n > 4), F.when(base_end.isin(*"aeiou"), cut(3)).otherwise(cut(4)))
        .when(ends("ed") & (n > 3), cut(2))
        .when(ends("s") & ~ends("ss") & (n > 2), F.when(ends("ies"), cut(3, "y")).when(ends("es"), cut(2)).otherwise(cut(1)))
        .when(ends("ly") & (n > 3), cut(2))
        .when(ends("tion"), cut(4, "t"))
        .when(ends("ment") | ends("ness") | ends("able") | ends("ible"), cut(4))
        .otherwise(w)
    )


def stem_sql(word: str) -> str:
    w = f"lower({word})"
    cut = lambda k: f"substr({w}, 1, length({w}) - {k})"
    ends = lambda s: f"ends_with({w}, '{s}')"
    return f"""(case
      when {ends("ing")} and length({w}) > 4 then
        case when substr({w}, length({w}) - 3, 1) in ('a', 'e', 'i', 'o', 'u') then {cut(3)} else {cut(4)} end
      when {ends("ed")} and length({w}) > 3 then {cut(2)}
      when {ends("s")} and not {ends("ss")} and length({w}) > 2 then
        case when {ends("ies")} then {cut(3)} || 'y' when {ends("es")} then {cut(2)} else {cut(1)} end
      when {ends("ly")} and length({w}) > 3 then {cut(2)}
      when {ends("tion")} then {cut(4)} || 't'
      when {ends("ment")} or {ends("ness")} or {ends("able")} or {ends("ible")} then {cut(4)}
      else {w} end)"""


def token_estimate(text: Column) -> Column:
    """Tokens of a text, taken as three characters each."""
    return F.ceil(F.length(text) / 3).cast("bigint")
