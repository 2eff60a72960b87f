"""Text to comparable form: character classes, padded bigrams, bitmaps, presence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 30 classes: letters, blank, hyphen, full stop, anything else (fixed values).
ALPHABET = "abcdefghijklmnopqrstuvwxyz -.?"
N_CLASSES = len(ALPHABET)
N_BIGRAMS = N_CLASSES**2
WORD_BITS = 60
N_WORDS = N_BIGRAMS // WORD_BITS

#: Amino acids with a dimension each, and those that spread evenly (fixed values).
VALID_LETTERS = "ARNDCQEGHILKMFPSTWYV"
EVEN_LETTERS = "XBZJUO"


def canonical(text: Column) -> Column:
    """One class symbol per UTF-8 byte; case folded after bytes are counted."""
    for chars, marks in ((r"[\x{80}-\x{7FF}]", "??"), (r"[\x{800}-\x{FFFF}]", "???"), (r"[\x{10000}-\x{10FFFF}]", "????")):
        text = F.regexp_replace(text, chars, marks)
    return F.regexp_replace(F.lower(text), "[^a-z .-]", "?")


def class_id(symbol: Column) -> Column:
    return F.instr(F.lit(ALPHABET), symbol) - 1


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), canonical(text), F.lit(" "))


def bigram_list(text: Column) -> Column:
    """All bigrams of the padded text, with repetition."""
    p = padded(text)
    return F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substr(p, i, F.lit(2)))


def bigram_set(text: Column) -> Column:
    return F.array_distinct(bigram_list(text))


def bigram_count(text: Column) -> Column:
    """Bigrams with repetition: one more than there are symbols."""
    return (F.length(canonical(text)) + 1).cast("long")


def bigram_id(bigram: Column) -> Column:
    return (N_CLASSES * class_id(F.substring(bigram, 1, 1)) + class_id(F.substring(bigram, 2, 1))).cast("long")


def bigram_ids(bigrams: Column) -> Column:
    return F.transform(bigrams, bigram_id)


def bitmap(ids: Column) -> list[Column]:
    """The set of bigram ids as 15 words of 60 bits."""

    def word(k: int) -> Column:
        own = F.filter(ids, lambda i: i.between(k * WORD_BITS, (k + 1) * WORD_BITS - 1))
        bits = F.aggregate(own, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (i - k * WORD_BITS).cast("int"))))
        return F.coalesce(bits, F.lit(0).cast("long"))

    return [word(k) for k in range(N_WORDS)]


def present(value: Column, empty: str = "") -> Column:
    """Whether a value is there: neither null nor the empty token."""
    return value.isNotNull() & (value != empty)


def presence_fraction(*parts: Column, empty: str = "") -> Column:
    """The part of ``parts`` that is there, as a double."""
    total = sum((present(p, empty).cast("int") for p in parts), F.lit(0))
    return total / F.lit(float(len(parts)))


def combine(*parts: Column) -> Column:
    """Parts joined by blanks, which stay where a part is empty."""
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def one_hot_map() -> Column:
    """letter -> array of 20 doubles."""
    n = len(VALID_LETTERS)
    rows = [(a, [float(a == b) for b in VALID_LETTERS]) for a in VALID_LETTERS] + [(a, [1 / n] * n) for a in EVEN_LETTERS]
    return F.create_map(*(x for a, v in rows for x in (F.lit(a), F.array(*map(F.lit, v)))))


def one_hot(letter: Column) -> Column:
    """The vector of one letter; an unknown letter is an error."""
    return F.coalesce(F.try_element_at(one_hot_map(), letter), F.raise_error(F.concat(F.lit("no amino acid: "), letter)).cast("array<double>"))
