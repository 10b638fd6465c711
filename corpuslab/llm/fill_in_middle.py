"""Fill-in-the-middle transformation by escaped marker injection, in SQL functions alone.

A mark that no escaped text can hold is put after every unit of a text (a code point, a word or a
line), so counting marks counts units, and ``substring_index`` cuts the marked text at the n-th of
them. The parts lose their marks, are unescaped and put together again around the sentinels:

1. escape: ``ESCAPE`` becomes ``ESCAPE 0`` and ``MARK`` becomes ``ESCAPE 1``;
2. inject: ``regexp_replace`` appends ``MARK`` to each unit, from left to right;
3. count the marks: n units;
4. cut: two of the ranks 0 to n, drawn by hashing seed and id, end the prefix and the middle;
5. drop marks, unescape, assemble.

Every step reads the text once, so the work follows its length; nothing is shuffled, and a row's
result depends on its id and text alone, so reruns and repeated tasks agree.

Defined cases: a null text is empty; an empty text, or one that holds a sentinel, stays plain, since
it could not be told apart; a null id is drawn as an empty one; repeated rows have equal results; an
empty table gives no rows. Columns are read by the names given, and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, ESCAPE = "\u0001", "\u0002"

#: Units in escaped text; an escaped character is one code point.
UNITS = {
    "chars": f"(?s){ESCAPE}[01]|.",
    "words": r"(?s)\s*\S+|\s+\z",
    "lines": r"(?s)[^\n]*\n|[^\n]+\z",
}

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Rates:
    """Of 100 texts, so many are transformed, and of 100 transformed ones so many put the suffix first."""

    transformed: int = 90
    suffix_first: int = 20


def escaped(text: Column) -> Column:
    """A text without ``MARK``; ``unescaped`` gives it back."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``; an escape is never followed by anything but its digit, so the order is safe."""
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column, unit: str) -> Column:
    """An escaped text with ``MARK`` after each unit."""
    return F.regexp_replace(text, f"({UNITS[unit]})", f"$1{MARK}")


def unmarked(part: Column) -> Column:
    return unescaped(F.replace(part, F.lit(MARK), F.lit("")))


def marks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit("")))).cast("long")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws of an id: the first 8-digit groups of a hexadecimal SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def first_units(text: Column, n: Column) -> Column:
    """The first n marked units, without the last one's mark."""
    return F.call_function("substring_index", text, F.lit(MARK), n.cast("int"))


def last_units(text: Column, n: Column) -> Column:
    """What follows the n-th mark from the right; a trailing mark counts."""
    return F.call_function("substring_index", text, F.lit(MARK), F.negative(n.cast("int")))


def transform(
    docs: DataFrame, unit: str = "chars", seed: int = 1, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text (null: empty), n (units), form, prefix, middle, suffix (null if plain), their units, and output of each row."""
    h = draws(F.col("doc_id"), seed)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("marked", marked(escaped(F.col("text")), unit)).withColumn("n", marks(F.col("marked")))
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    held = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(sentinel))
    plain = (F.col("text") == "") | held | (h[2] % 100 >= rates.transformed)
    form = F.when(plain, PLAIN).when(h[3] % 100 < rates.suffix_first, SPM).otherwise(PSM)
    rows = rows.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b), "form": form})
    cut = F.col("form") != PLAIN
    through = first_units(F.col("marked"), F.col("hi"))
    parts = {
        "prefix": F.when(cut, unmarked(first_units(F.col("marked"), F.col("lo")))),
        "middle": F.when(cut, unmarked(last_units(through, F.col("hi") - F.col("lo")))),
        "suffix": F.when(cut, unmarked(last_units(F.col("marked"), F.col("n") - F.col("hi") + 1))),
        "prefix_units": F.when(cut, F.col("lo")),
        "middle_units": F.when(cut, F.col("hi") - F.col("lo")),
    }
    rows = rows.withColumns(parts)
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(F.col("text"))
    return rows.withColumn("output", output).drop("marked", "lo", "hi")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone.

    A transformed text holds no sentinel, and none can arise where a part meets one (no end of a
    sentinel is the beginning of another), so the three found are those put in.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """The transformed rows as counts and digests: what a run is compared by without carrying texts."""
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
