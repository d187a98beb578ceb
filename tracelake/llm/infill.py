"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and put in another order between sentinels.

A text's tokens are counted with a regular expression. Its cut points then become a pattern of its own, in which
possessive groups count the tokens of prefix and middle: one match captures all three parts. Possessive groups do not
backtrack, so a match takes time in proportion to the text and no stack.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A token is a word with the white space before it, or white space at the end; the sentinels.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: How the parts of a match, and of an output, are put together in each form.
_ORDERS = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
_BACK = {
    "psm": (rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2"),
    "spm": (rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1"),
}
_ADDED = ["n", "form", "prefix_chars", "middle_chars"]


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed and key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def infill(
    documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80
) -> DataFrame:
    """The documents with their texts put in order for infilling, and n, form, prefix_chars, middle_chars.

    The two cut points are drawn from the n + 1 places between a text's n tokens, from ``seed`` and the key alone, so
    each run gives the same. ``rate`` percent of the documents are changed; of these ``spm_rate`` percent take the form
    spm (suffix, prefix, middle), the others psm (prefix, suffix, middle). prefix_chars and middle_chars count code points.

    - Form plain, the text as it is and null counts: for the other documents, empty and null texts (null becomes empty),
      and texts that hold a sentinel, which could not be put back.
    - A null key draws like an empty one; rows with the same key and text give the same result.
    - Texts of any length are cut whole; white space alone is one token.
    - All columns are returned; columns with the names of the added ones are replaced. An empty table gives an empty
      result.
    """
    first, second, changed, order = draws(F.col(key), seed)
    content = F.coalesce(F.col(text), F.lit(""))
    others = [F.col(c) for c in documents.columns if c != text]
    counted = documents.select(
        F.struct(*others).alias("row"),
        content.alias("content"),
        F.regexp_count(content, F.lit(UNIT)).cast("bigint").alias("n"),
        *(h.alias(f"h{i}") for i, h in enumerate((first, second, changed, order), 1)),
    )
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    sentinel = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        sentinel = sentinel | F.contains(F.col("content"), F.lit(mark))
    plain = (F.col("content") == "") | sentinel | (F.col("h3") % 100 >= rate)
    cut = counted.select(
        "row",
        "content",
        "n",
        F.least(one, two).alias("a"),
        F.greatest(one, two).alias("b"),
        F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
    )
    pattern = F.format_string(
        f"(?s)\\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*+)\\z", F.col("a"), F.col("b") - F.col("a")
    )
    parts = F.when(F.col("form") == "spm", _ORDERS["spm"]).otherwise(_ORDERS["psm"])
    output = F.when(F.col("form") == "plain", F.col("content")).otherwise(F.regexp_replace("content", pattern, parts))
    made = cut.select("row", "n", "form", output.alias("output"))
    after_prefix = F.when(F.col("form") == "spm", _at(MIDDLE)).otherwise(_at(SUFFIX))
    prefix = after_prefix - _at(PREFIX) - len(PREFIX)
    middle = F.char_length("output") - _at(MIDDLE) - len(MIDDLE) + 1
    moved = F.col("form") != "plain"
    added = {
        "n": F.col("n"),
        "form": F.col("form"),
        "prefix_chars": F.when(moved, prefix).cast("bigint"),
        "middle_chars": F.when(moved, middle).cast("bigint"),
    }
    columns = [
        F.col("output").alias(text) if c == text else F.col("row")[c].alias(c)
        for c in documents.columns
        if c == text or c.lower() not in added
    ]
    return made.select(*columns, *(value.alias(name) for name, value in added.items()))


def _at(mark: str) -> Column:
    """Place of a sentinel, from 1. A changed text holds none, and no part ends so that one could begin in it."""
    return F.instr("output", mark)


def restored(output: Column, form: Column) -> Column:
    """The text that ``infill`` was given, from its output and form (a null text as an empty one)."""
    back = {name: F.regexp_replace(output, F.lit(pattern), F.lit(parts)) for name, (pattern, parts) in _BACK.items()}
    return F.when(form == "psm", back["psm"]).when(form == "spm", back["spm"]).otherwise(output)
