"""Benchmark decontamination over a distributed positional inverted index.

The index holds postings (term, doc_id, pos) of the corpus with the words around each
posting. Test windows are looked up by their rarest term, by counts over the whole corpus;
around such a posting the other terms' offset-adjusted positions are intersected in the
posting's own row, which yields the exact run of words that text and item share. Only
postings of rarest terms ever leave a scan task, so the shuffle is far smaller than the
corpus. All work is DataFrame expressions.

Null texts have no words and are reported with zeros. An item without words has no window.
Rows that repeat (doc_id and text) give equal results and are all kept; rows that share a
doc_id but differ in text are told apart by a hash of the text. Items are told apart by
item_id; repeated items count once. Empty tables give empty results or zeros. Further input
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.llm.base import ascii_lower, checkpoint, words

#: Everything in ASCII that is not a digit or letter separates words; A-Z count as a-z.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: A table of test terms or anchors with at most this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Postings of one term that go to one salt in the shuffled join.
SALT_ROWS = 500_000


def lowered(array: Column) -> Column:
    return F.transform(array, ascii_lower)


def item_words(items: DataFrame) -> DataFrame:
    """item_id, w: the distinct items that have words."""
    out = items.select("item_id", lowered(words(F.col("text"), BREAKS)).alias("w"))
    return out.where(F.size("w") > 0).dropDuplicates(["item_id", "w"])


def postings(docs: DataFrame, terms: DataFrame, bounded: bool, width: int) -> DataFrame:
    """The index restricted to ``terms`` (column term): one row per occurrence with doc_key,
    pos and the ``width`` words on either side."""
    at = docs.select("doc_key", "w", F.posexplode("w").alias("pos", "term")).withColumn("term", ascii_lower(F.col("term")))
    hit = at.join(F.broadcast(terms) if bounded else terms, "term", "left_semi")
    if width == 0:
        return hit.select("term", "doc_key", "pos")
    first = F.greatest(F.col("pos") - width, F.lit(0))
    return hit.select(
        "term", "doc_key", "pos", (F.col("pos") - first).alias("lead"),
        lowered(F.slice("w", first + 1, F.col("pos") - first + 1 + width)).alias("near"),
    )


def corpus_counts(docs: DataFrame, terms: DataFrame, bounded: bool) -> DataFrame:
    """term, n: occurrences in the corpus of every test term (0 where it has none)."""
    at = docs.select(F.explode("w").alias("term")).select(ascii_lower(F.col("term")).alias("term"))
    n = at.join(F.broadcast(terms) if bounded else terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(n, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """For every window of an item the place of its rarest term (ties: the term, then the
    first place): term, n, item_id, at, w. Each window has its anchor among the rows."""
    n_windows = F.greatest(F.size("w") - window, F.lit(0)) + 1
    at = items.select("item_id", "w", F.posexplode("w").alias("at", "term")).join(counts, "term")
    last = Window.partitionBy("item_id", "w").orderBy("at").rowsBetween(0, window - 1)
    at = at.withColumn("__best", F.min(F.struct("n", "term", F.col("at").alias("p"))).over(last))
    best = at.where(F.col("at") < n_windows).select("item_id", "w", "__best").distinct()
    return best.select(F.col("__best.term").alias("term"), F.col("__best.n").alias("n"), "item_id", F.col("__best.p").alias("at"), "w")


def _run(near: Column, lead: Column, w: Column, at: Column, step: int, most: int) -> Column:
    """How many words in a row agree from the anchor on, in direction ``step``, at most ``most``."""
    agree = F.lit(most)
    for k in range(most, 0, -1):
        same = F.get(near, lead + step * k) == F.get(w, at + step * k)
        agree = F.when(F.coalesce(same, F.lit(False)), agree if k < most else F.lit(most)).otherwise(k - 1)
    return agree


def shared_runs(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Exact phrase matches: doc_key, item_id, start, length of runs of agreeing words that
    hold a window of the item (each run as far as window - 1 words from its anchor).

    ``docs`` has doc_key and w (words as they stand), ``items`` item_id and w (lower-case).
    """
    terms = items.select(F.explode("w").alias("term")).distinct()
    bounded = terms.limit(broadcast_rows + 1).count() <= broadcast_rows
    counts = checkpoint(corpus_counts(docs, terms, bounded))
    seeds = checkpoint(anchors(items, counts, window).where("n > 0"))
    seed_terms = seeds.groupBy("term").agg(F.first("n").alias("n"))
    small = seeds.limit(broadcast_rows + 1).count() <= broadcast_rows
    post = postings(docs, seed_terms.select("term"), bounded, window - 1)
    if small:
        both = post.join(F.broadcast(seeds), "term")
    else:  # frequent terms are dealt over several partitions
        salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
        post = post.join(seed_terms.select("term", F.greatest(salts, F.lit(1)).alias("__s")), "term")
        post = post.withColumn("salt", F.pmod(F.xxhash64("doc_key", "pos"), "__s").cast("int")).drop("__s")
        both = post.join(salted, ["term", "salt"])
    near, lead, w, at = (F.col(c) for c in ("near", "lead", "w", "at"))
    both = both.withColumns({"__l": _run(near, lead, w, at, -1, window - 1), "__r": _run(near, lead, w, at, 1, window - 1)})
    length = F.col("__l") + F.col("__r") + 1
    return both.where(length >= F.least(F.size("w"), F.lit(window))).select(
        "doc_key", "item_id", (F.col("pos") - F.col("__l")).alias("start"), length.alias("length")
    )


def proximity_matches(docs: DataFrame, phrases: DataFrame, within: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Proximity search: doc_key, item_id, pos of the rarest term of a phrase where all its
    terms stand within ``within`` words of that term, in any order."""
    terms = phrases.select(F.explode("w").alias("term")).distinct()
    bounded = terms.limit(broadcast_rows + 1).count() <= broadcast_rows
    counts = checkpoint(corpus_counts(docs, terms, bounded))
    at = phrases.select("item_id", "w", F.explode("w").alias("term")).join(counts, "term")
    best = at.groupBy("item_id", "w").agg(F.min(F.struct("n", "term")).alias("b")).where("b.n > 0")
    best = best.select(F.col("b.term").alias("term"), "item_id", F.array_distinct("w").alias("w"))
    post = postings(docs, best.select("term").distinct(), bounded, within)
    hit = post.join(F.broadcast(best) if bounded else best, "term")
    return hit.where(F.size(F.array_except("w", "near")) == 0).select("doc_key", "item_id", "pos")


def _covered(runs: Column) -> Column:
    """Positions inside any of the sorted (start, length) runs."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, r: Column) -> Column:
        end = r["start"] + r["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(end - F.greatest(a["end"], r["start"]), F.lit(0))).alias("n"))

    return F.aggregate(runs, zero, add)["n"]


def with_words(docs: DataFrame) -> DataFrame:
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    return docs.select(key.alias("doc_key"), words(F.col("text"), BREAKS).alias("w"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document the words inside shared windows and the items they come from."""
    texts = with_words(docs)
    # used twice below: the corpus is searched once, and only distinct runs are written
    runs = checkpoint(shared_runs(texts, item_words(items), window, broadcast_rows).distinct())
    # first distinct runs per document, then one short list of them
    spans = runs.select("doc_key", "start", "length").distinct().groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"))
    named = runs.select("doc_key", F.col("item_id").cast("string").alias("i")).distinct().groupBy("doc_key").agg(F.sort_array(F.collect_list("i")).alias("ids"))
    found = spans.join(named, "doc_key").select("doc_key", _covered(F.col("runs")).alias("n_hit"), "ids")
    sizes = texts.select("doc_key", F.size("w").cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return sizes.join(found, "doc_key", "left").select(
        F.col("doc_key.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("doc_key.text_hash").alias("text_hash"),
    )
