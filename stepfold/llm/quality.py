"""Line-first cleaning: rules per line, failing lines out, then a verdict on what is left.

Only Column expressions: a document is one row from the scan to the result, without a
shuffle. Null and empty texts have no words and no lines; they fail the word minimum. A
text of only white space has lines but no words: it fails too. Repeated rows get equal
results; ties do not arise. Further columns of the input are kept, result names win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.llm.base import words

SYMBOLS = "#*$%&|<>"
MARKUP = SYMBOLS + "{}[]~^_=\\"
#: Phrases that mark a line as page furniture rather than prose.
BOILERPLATE = [
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies",
    "accept cookies", "enable javascript", "javascript is disabled", "sign up for our newsletter", "subscribe to our",
    "click here to", "share this article", "powered by", "permission is hereby granted", "licensed under the",
]
SEPARATORS = "|>»›·•"
ENDINGS = r"[.!?…。！？:;\"'”’)\]]\s*$"
#: A packed position takes 24 bits; longer texts, of over 16 million words, sort (hash, position) pairs.
POSITION_BITS = 24
#: ASCII white space.
BLANK = " \t\n\x0b\f\r"


def _packed(h: Column, i: Column, low: bool, bits: int) -> Column:
    """40 bits of a hash above its position; sorting puts equal hashes side by side."""
    part = F.shiftleft(h, bits) if low else F.shiftleft(F.shiftrightunsigned(h, bits), bits)
    return part.bitwiseOR(i.cast("long"))


def _side_by_side(sorted_name: str, bits: int) -> Column:
    """Positions whose 40 bits equal those of a neighbour in the sorted array."""
    s = F.col(sorted_name)

    def same(x: Column, i: Column) -> Column:
        before = F.shiftright(F.get(s, i - 1).bitwiseXOR(x), bits) == 0
        after = F.shiftright(F.get(s, i + 1).bitwiseXOR(x), bits) == 0
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.transform(F.filter(s, same), lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)))


def _pairs_side_by_side(sorted_name: str) -> Column:
    """Positions of the (hash, position) pairs whose hash equals that of a neighbour."""
    s = F.col(sorted_name)
    same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    return F.transform(F.filter(s, same), lambda x: x["i"].cast("long"))


def repeated_words(df: DataFrame, words_name: str, out: str, bits: int = POSITION_BITS) -> DataFrame:
    """Words inside three-word windows that a text holds twice or more, in n log n.

    Windows are 64-bit hashes sorted twice, by either 40 bits of it; a window counts when it has
    an equal neighbour in both orders. Texts whose positions need more than ``bits`` bits sort pairs
    of hash and position instead.
    """
    w = F.col(words_name)
    n = F.size(w) - 2
    hashes = F.when(n >= 2, F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, n))
    df = df.withColumn("__h", hashes)
    df = df.withColumn("__some", F.size(F.array_distinct("__h")) < F.size("__h"))
    long = F.size("__h") > 1 << bits
    h, pairs = F.when(F.col("__some") & ~long, F.col("__h")), F.when(F.col("__some") & long, F.col("__h"))
    df = df.withColumns({
        "__a": F.sort_array(F.transform(h, lambda x, i: _packed(x, i, False, bits))), "__b": F.sort_array(F.transform(h, lambda x, i: _packed(x, i, True, bits))),
        "__c": F.sort_array(F.transform(pairs, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    })
    df = df.withColumn("__at", F.sort_array(F.coalesce(F.array_intersect(_side_by_side("__a", bits), _side_by_side("__b", bits)), _pairs_side_by_side("__c"))))
    at = F.col("__at")
    steps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)))
    df = df.withColumn(out, F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return df.drop("__h", "__some", "__a", "__b", "__c", "__at")


def line_failure(line: Column) -> Column:
    """The rule a line fails, null for a good line or one without a word.

    punctuation: more than a tenth of its characters are markup symbols, or no letter at all.
    navigation: three separators or more between its words, or up to three words without an
    ending that follow an arrow or bullet. boilerplate: one of BOILERPLATE.
    """
    text = F.trim(line, F.lit(BLANK))
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    few = F.size(F.split(text, " ")) <= 3
    return (
        F.when(F.length(text) == 0, None)
        .when((count(MARKUP) * 10 > F.length(text)) | ~text.rlike(r"\p{L}"), "punctuation")
        .when((count(SEPARATORS) >= 3) | (few & text.rlike(f"^[{SEPARATORS}]") & ~text.rlike(ENDINGS)), "navigation")
        .when(F.lower(text).rlike("|".join(BOILERPLATE)), "boilerplate")
    )


def may_fail(text: Column) -> Column:
    """False only where no line can fail a rule: no markup symbol or separator, a letter in every
    line with a word, and no boilerplate phrase. Spares most texts the work by line."""
    sign = text.rlike("[" + "".join("\\" + c for c in MARKUP + SEPARATORS) + "]") | text.rlike(r"(?m)^[^\p{L}\n]*[^\s\p{L}][^\p{L}\n]*$")
    for phrase in BOILERPLATE:
        sign = sign | F.contains(F.lower(text), F.lit(phrase))
    return sign


def clean_lines(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Add ``cleaned`` (lines that pass, in order), lines failed by rule, and ``lost_share``
    (share of the characters other than white space that went)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__l", F.when(may_fail(whole), F.split(whole, "\n")))
    df = df.withColumn("__f", F.transform("__l", line_failure))
    lines, fails = F.col("__l"), F.col("__f")
    solid = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    kept = F.filter(lines, lambda x, i: F.get(fails, i).isNull())
    df = df.withColumn("__any", F.exists(fails, lambda x: x.isNotNull()))
    df = df.withColumn("cleaned", F.when(F.col("__any"), F.array_join(kept, "\n")).otherwise(whole))
    df = df.withColumn("lost_share", F.when(F.col("__any"), 1 - solid(F.col("cleaned")) / F.greatest(solid(whole), F.lit(1))).otherwise(0.0))
    name = F.transform(fails, lambda x: F.coalesce(x, F.lit("")))
    of = lambda rule: F.when(F.col("__any"), F.size("__f") - F.size(F.array_remove(name, rule))).otherwise(0)
    df = df.withColumns({f"{r}_lines": of(r).cast("long") for r in ("punctuation", "navigation", "boilerplate")})
    return df.withColumn("loses_too_much", F.col("lost_share") > max_lost).drop("__l", "__f", "__any")


def quality(df: DataFrame, text: str = "text", min_words: int = 50, max_repeat: int = 50, max_lost: float = 0.5) -> DataFrame:
    """Line-first cleaning with document statistics and the verdict ``kept``."""
    names = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned", "lost_share"}
    df = df.drop(*(names - {text}))
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__w", words(F.col(text)))
    df = df.withColumn("__real", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long"),
        "n_dup_lines": (F.size("__real") - F.size(F.array_distinct("__real"))).cast("long"),
    })
    df = repeated_words(df, "__w", "n_repeat_words").drop("__w", "__real")
    df = clean_lines(df, text, max_lost)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("loses_too_much"))
