"""Row-local text expressions, all JVM side.

Word characters are ``\\p{L}``, ``\\p{N}`` and ``_`` throughout, which is the
same class in Java and in RE2 and covers accented letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_RUN = r"[\p{L}\p{N}_]+"
#: Splits a text into alternating word runs and separator runs, losing nothing.
PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: A sentence ends at ``.``, ``!`` or ``?`` before white space, or at a line
#: break; decimals stay whole. Possessive loops keep the match iterative.
SENTENCE = r"(?:[^.!?\n]++|[.!?]++[^.!?\s])++[.!?]*\s*|[.!?\n]++\s*"
BLANKS = " \t\n\r\f\x0b"
#: Word start and end marks, used to test word-bounded containment by plain
#: substring search.
OPEN_MARK, CLOSE_MARK = "\x01", "\x02"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_letters(pattern: str) -> str:
    """ASCII letters and digits with one of which every match begins; empty where the pattern does not show it plainly."""
    if re.search(r"\(\?[^:]|\\Q|&&|\[[^\]]*\[", pattern):
        return ""
    tokens = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?:|.", pattern, re.S)
    found, leads, lead = "", [True], True
    for token, after in zip(tokens, [*tokens, ""][1:], strict=True):
        optional = after in ("?", "*", "{")
        if token in ("(", "(?:"):
            leads.append(lead)
        elif token in ("|", ")"):
            if lead or (token == ")" and leads[-1] and optional):
                return ""  # a branch or group that may be empty
            lead = leads[-1] if token == "|" else leads.pop() and False
        elif lead:
            if optional or not re.fullmatch(r"[A-Za-z0-9]|\[[A-Za-z0-9]+\]", token):
                return ""
            found, lead = found + token.strip("[]"), False
    return "" if lead else "".join(sorted(set(found.lower())))


def strip(c: Column) -> Column:
    """Trim any white space on both ends."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def key_of(c: Column) -> Column:
    """Lookup key: trimmed and lower-cased."""
    return F.lower(strip(c))


def blank_tokens(c: Column) -> Column:
    """White-space separated tokens, never empty strings."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def count_tokens(c: Column) -> Column:
    return F.size(blank_tokens(c))


def word_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_RUN), F.lit(0))


def pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PIECES), F.lit(0))


def _exclusive_sums(values: Column) -> Column:
    empty = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("t"), empty.alias("s"))
    return F.aggregate(
        values,
        zero,
        lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.array_append(acc["s"], acc["t"]).alias("s")),
        lambda acc: acc["s"],
    )


def running_starts(lengths: Column, block: int = 128) -> Column:
    """Exclusive running sums of an integer array.

    Done over blocks and then over block totals, so the cost of growing the
    accumulator stays near ``n * block`` for texts of any length.
    """

    def over(ls: Column) -> Column:
        last = F.floor((F.size(ls) - 1) / block).cast("int")
        chunks = F.transform(
            F.sequence(F.lit(0), last), lambda b: F.slice(ls, b * block + 1, F.lit(block))
        )

        def with_chunks(cs: Column) -> Column:
            totals = F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
            return F.flatten(
                F.zip_with(
                    cs,
                    _exclusive_sums(totals),
                    lambda c, base: F.transform(_exclusive_sums(c), lambda s: s + base),
                )
            )

        return F.when(F.size(ls) > 0, let(chunks, with_chunks)).otherwise(F.array().cast("array<int>"))

    return let(lengths, over)


def sentence_spans(c: Column) -> Column:
    """Array of ``(start, sentence)``; the sentences concatenate to the text."""
    return let(
        F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)),
        lambda ss: F.zip_with(
            running_starts(F.transform(ss, F.length)),
            ss,
            lambda start, s: F.struct(start.alias("start"), s.alias("sentence")),
        ),
    )


def mark_words(c: Column) -> Column:
    """Wrap every word run in marks; see :func:`marked`."""
    return F.regexp_replace(c, r"([\p{L}\p{N}_]+)", f"{OPEN_MARK}$1{CLOSE_MARK}")


def marked(phrase: str, open_end: bool = False) -> str:
    """Python twin of :func:`mark_words` for literal phrases.

    A marked phrase occurs in a marked text exactly where the phrase occurs with
    a word boundary on each side that ends in a word character.
    """
    out, in_word = [], False
    for ch in phrase:
        is_word = ch.isalnum() or ch == "_"
        if is_word and not in_word:
            out.append(OPEN_MARK)
        if in_word and not is_word:
            out.append(CLOSE_MARK)
        out.append(ch)
        in_word = is_word
    if in_word and not open_end:
        out.append(CLOSE_MARK)
    return "".join(out)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: Iterable[str]) -> Column:
    """ARRAY<STRING> constant, built as one SQL expression."""
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")").cast("array<string>")


def contained_terms(text: Column, terms: Iterable[str]) -> Column:
    """Terms (plain substrings) found in ``text``, in list order."""
    return F.filter(literal_array(terms), lambda t: F.contains(text, t))


def title_case(c: Column) -> Column:
    """First letter of every word run upper, the rest lower."""
    return F.array_join(
        F.transform(
            pieces(F.lower(c)),
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)),
        ),
        "",
    )
