"""Product catalog analytics: cleaning, documents, prices, facets, TF-IDF, goals, rewards."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.functions.classify import normalize_color
from stepfold.operators.postings import bm25_topk
from stepfold.plans.session import checkpoint
from stepfold.plans.skew import first_per_group, lookup, top_k

# Columns dropped when a catalog is loaded.
DROPPED = [
    "product_information", "brand", "brand_url", "list_price", "availability_quantity", "availability_status", "total_reviews",
    "total_answered_questions", "seller_id", "seller_name", "fulfilled_by_amazon", "fast_track_message", "aplus_present",
    "small_description_old",
]
# The price ladder is 10, 20, ... 990; a cap is the upper of two of the next four rungs.
UPPER_OF_PAIR = [1, 2, 3, 2, 3, 3]


def clean_products(df: DataFrame, *, order="ord") -> DataFrame:
    """Known columns dropped, bad and repeated asins removed, options and query lower-cased."""
    d = df.drop(*[c for c in DROPPED if c in df.columns])
    d = d.where((F.col("asin") != "nan") & (F.length("asin") <= 10))
    d = first_per_group(d, ["asin"], [order]) if "options" not in d.columns else _first_with_maps(d, order)
    out = {"query": F.trim(F.lower("query"))}
    if "options" in d.columns:
        tidy = F.transform_values("options", lambda k, v: F.transform(v, lambda x: F.lower(F.replace(F.trim(x), F.lit("/"), F.lit(" | ")))))
        filled = F.map_filter(tidy, lambda k, v: v.isNotNull())
        out["options"] = F.transform_keys(filled, lambda k, v: F.lower(k))
    if "small_description" in d.columns:
        s = F.col("small_description")
        out["bullets"] = s if d.schema["small_description"].dataType.simpleString().startswith("array") else F.array(s)
    return d.withColumns(out)


def _first_with_maps(df: DataFrame, order: str) -> DataFrame:
    """Maps cannot be compared, so the first row is found by order alone."""
    rest = [c for c in df.columns if c != "asin"]
    g = df.groupBy("asin").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return g.select("asin", "r.*").select(*df.columns)


def product_documents(df: DataFrame, *, title="name", description="full_description", bullets="bullets") -> DataFrame:
    """Lower-case search text: title, description, first bullet and options by name."""
    entries = F.array_sort(F.map_entries("options"))
    opts = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", "))), ", and ")
    first = F.coalesce(F.try_element_at(bullets, F.lit(1)), F.lit(""))
    return df.select("asin", F.lower(F.concat_ws(" ", title, description, first, opts)).alias("contents"))


def hash_uniform(seed: int, key: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def assign_prices(df: DataFrame, seed: int, *, pricing="pricing") -> DataFrame:
    p, u = F.col(pricing), hash_uniform(seed, F.col("asin"))
    lo, hi = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))
    price = F.when(F.coalesce(F.size(p), F.lit(0)) <= 0, 100.0).when(F.size(p) == 1, lo).otherwise(lo + (hi - lo) * u)
    return df.withColumn("price", price)


def attribute_index(df: DataFrame, *, attributes="attributes") -> DataFrame:
    """(attribute, asin) pairs, each once: one row per product rather than a set per attribute."""
    return df.select(F.explode(attributes).alias("attribute"), "asin").distinct()


def facet_search(products: DataFrame, *, attribute=None, category=None, query=None) -> DataFrame:
    d = products
    if attribute is not None:
        d = d.where(F.array_contains("attributes", attribute))
    if category is not None:
        d = d.where(F.col("category") == category)
    if query is not None:
        d = d.where(F.col("query") == query)
    return d


def keyword_search(queries: DataFrame, documents: DataFrame, k: int = 50, *, report: list | None = None) -> DataFrame:
    """k best documents per query by BM25. Documents of equal text score alike, so each text is
    ranked once, for as many documents as it stands for, under the smallest id; the texts found give
    their k smallest ids each. Ids must be unique."""
    docs = documents.select(F.col("asin").alias("doc_id"), F.col("contents").alias("text"))
    texts = checkpoint(docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    hits = checkpoint(bm25_topk(queries, texts, k, digits=9, report=report).select("query_id", "doc_id", "score"))
    hits = hits.join(texts, "doc_id").select("query_id", "score", "text")
    found = top_k(docs.join(hits.select("text").distinct(), "text", "left_semi"), ["text"], [F.col("doc_id")], k).drop("rn")
    return top_k(hits.join(found, "text").drop("text"), ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def _tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Words of two or more characters that are neither stop words nor 0..999, in one pass."""
    skip = "|".join(["0", r"[1-9]\d{0,2}", *[re.escape(w) for w in stop_words]])
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b(?!(?:{skip})\b)(\w\w+)\b"), 1)


#: Terms that are sent to all tasks.
SENT = 100_000


def _counted(df: DataFrame, n: int, stop_words: Sequence[str], by: str, text: str) -> DataFrame:
    """asin, by, l: each n-gram of a product's texts and how often it has it, counted in the row.
    Only rows that share an asin are brought together."""
    t = _tokens(F.col(text), stop_words)
    grams = F.when(F.size("t") >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("t") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("t", i, F.lit(n)), " ")))
    shared = checkpoint(df.groupBy("asin").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("asin").alias("__a")))
    d = df.select("asin", by, text)
    if not shared.isEmpty():
        same = F.col("asin").eqNullSafe(F.col("__a"))
        many = d.join(shared, same, "left_semi").withColumn("t", t).select("asin", by, grams.alias("g"))
        many = many.groupBy("asin", by).agg(F.flatten(F.collect_list("g")).alias("g"))
        d = d.join(shared, same, "left_anti").withColumn("t", t).select("asin", by, grams.alias("g")).unionByName(many)
    else:
        d = d.withColumn("t", t).select("asin", by, grams.alias("g"))
    # of the sorted n-grams, those that differ from the one before, with their places
    d = d.withColumn("g", F.sort_array("g"))
    new = F.filter(F.transform("g", lambda x, i: F.struct(x.alias("term"), i.alias("at"), (F.get("g", i - 1) == x).alias("same"))), lambda x: ~F.coalesce(x["same"], F.lit(False)))
    d = d.withColumn("f", new)
    return d.select("asin", by, F.transform("f", lambda x, i: F.struct(x["term"].alias("term"), (F.coalesce(F.get("f", i + 1)["at"], F.size("g")) - x["at"]).cast("long").alias("tf"))).alias("l"))


def tfidf_attributes(df: DataFrame, n: int, *, stop_words: Sequence[str], by="category", text="text", k=5, max_features: int | None = None) -> DataFrame:
    """Share of a category's products that have a term among their k best by TF-IDF.

    Terms are n-grams after stop words and 0..999 are removed; if ``max_features``
    is given, the most frequent of a category count; idf = ln((1+N)/(1+df)) + 1, L2 per product.
    """
    counted = checkpoint(_counted(df, n, stop_words, by, text))  # read twice; no filter is pushed into the counting
    each = lambda: counted.select("asin", by, F.explode("l").alias("x")).select("asin", by, "x.term", "x.tf")
    terms = each().groupBy(by, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if max_features is not None:
        terms = top_k(terms, [by], [F.desc("total"), F.col("term")], max_features, "__r").drop("__r")
    terms = terms.drop("total")
    sizes = df.groupBy(by).agg(F.count_distinct("asin").alias("n_products"))
    terms = terms.join(sizes, by)
    terms = checkpoint(terms.select(by, "term", "n_products", (F.log((1 + F.col("n_products")) / (1 + F.col("df"))) + 1).alias("idf")))
    # few terms go to the counts, so that only counts of kept terms are shuffled
    kept = F.broadcast(terms) if terms.limit(SENT + 1).count() <= SENT else terms
    w = lookup(each(), kept, [by, "term"], "inner").withColumn("w", F.col("tf") * F.col("idf"))
    # a product's window group is bounded by the distinct terms of its own text
    w = w.withColumn("ss", F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("asin")))
    w = w.withColumn("score", F.round(F.col("w") / F.sqrt("ss"), 9))
    best = top_k(w, ["asin"], [F.desc("score"), F.col("term")], k, "__r")
    g = best.groupBy(by, "term").agg(F.count(F.lit(1)).alias("products"), F.max("n_products").alias("n"))
    return g.select(by, "term", "products", (F.col("products") / F.col("n")).alias("share"))


#: Numbers of combinations in one row before they are spelled out.
COMBINATIONS = 4096


def synthesize_goals(df: DataFrame, seed: int = 0, *, price: str | None = "price") -> DataFrame:
    """A goal per combination of option values, with a price cap and a weight: the mean over
    its attributes of one over the goals sharing the attribute."""
    names = F.array_sort(F.map_keys("options"))
    # combinations by number, spelled out one at a time: no row ever holds them all
    values = lambda k: F.element_at(F.col("options"), k)
    total = F.aggregate(names, F.lit(1).cast("long"), lambda n, k: n * F.size(values(k)))
    d = df.withColumn("__n", total).where("__n > 0")
    # weights before any goal is spelled out: a product counts as often as it has combinations,
    # and equal attribute lists weigh the same. Sorted joins, as both sides are products: the
    # planner takes them for smaller than they are and would broadcast them.
    lists = d.groupBy("attributes").agg(F.sum("__n").alias("__n")).select("attributes", "__n", F.explode("attributes").alias("attribute"))
    counts = lists.groupBy("attribute").agg(F.sum("__n").alias("c"))
    weights = lookup(lists.hint("merge"), counts, ["attribute"]).groupBy("attributes").agg(F.avg(1 / F.col("c")).alias("weight"))
    d = d.hint("merge").join(weights, "attributes").withColumn("__from", F.explode(F.expr(f"sequence(0L, __n - 1, {COMBINATIONS}L)")))
    d = d.withColumn("__i", F.explode(F.expr(f"sequence(__from, least(__from + {COMBINATIONS}L, __n) - 1)")))
    start = F.struct(F.col("__i").alias("i"), F.array().cast("array<string>").alias("o"))
    step = lambda acc, k: F.struct(
        F.floor(acc["i"] / F.size(values(k))).alias("i"),
        F.array_append(acc["o"], F.concat(k, F.lit(": "), F.element_at(values(k), (acc["i"] % F.size(values(k)) + 1).cast("int")))).alias("o"))
    d = d.withColumn("goal_options", F.aggregate(names, start, step, lambda acc: acc["o"])).drop("__n", "__from", "__i")
    if price is not None:
        rung = F.floor(F.col(price) / 10) + 1
        pick = F.floor(hash_uniform(seed, F.col("asin")) * len(UPPER_OF_PAIR)).cast("int")
        upper = F.element_at(F.array(*[F.lit(u) for u in UPPER_OF_PAIR]), pick + 1)
        left = F.lit(99) - rung
        cap = (rung + F.least(upper, left)) * 10.0
        d = d.withColumn("price_upper", F.when(left >= 1, cap).otherwise(1_000_000.0))
    else:
        d = d.withColumn("price_upper", F.lit(1_000_000.0))
    text = F.when(F.col("price_upper") < 1_000_000.0, F.concat(F.lit(", and price lower than "), F.format_string("%.2f", "price_upper"), F.lit(" dollars"))).otherwise("")
    opts = F.when(F.size("goal_options") > 0, F.concat(F.lit(" with "), F.array_join("goal_options", ", and "))).otherwise("")
    d = d.withColumn("goal_text", F.concat("instruction", opts, text))
    return d.withColumn("goal_id", F.concat_ws("|", F.col("asin"), F.array_join("goal_options", "|")))


def _words(c: Column, stop_words: Sequence[str]) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(list(stop_words))))


def _token_sets(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.array_distinct(F.split(F.lower(t), r"\s+")))


def _same(x: Column, y: Column) -> Column:
    """Token sets, one nearly inside the other."""
    return F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)) >= 0.85


def reward_fields(df: DataFrame, stop_words: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Token sets of a product or goal, computed once per row before it meets any purchase."""
    color = F.transform(f"{prefix}options", lambda x: normalize_color(x))
    return df.withColumns(
        {
            f"__{prefix}attr": _token_sets(F.col(f"{prefix}attributes")),
            f"__{prefix}opt": _token_sets(color),
            f"__{prefix}path": F.transform(F.split(f"{prefix}product_category", "›"), lambda x: F.trim(x)),
            f"__{prefix}words": _words(F.col(f"{prefix}name"), stop_words),
        }
    )


def purchase_reward(purchases: DataFrame, goals: DataFrame, products: DataFrame, *, stop_words: Sequence[str] = ()) -> DataFrame:
    """Reward of each purchase against its goal.

    ``purchases`` has goal_id, product_id, price; ``products`` has product_id, query,
    product_category, name, attributes, options ARRAY, full_text; ``goals`` goal_id, the same
    fields with goal_ prefixes, and price_upper. Attribute and option texts match by token
    sets where a fuzzy string ratio could be used.
    """
    d = lookup(purchases, reward_fields(products, stop_words), ["product_id"], "inner")
    d = lookup(d, reward_fields(goals, stop_words, "goal_"), ["goal_id"], "inner")
    wanted = F.arrays_zip(F.col("__goal_attr").alias("s"), F.col("goal_attributes").alias("t"))
    text = F.lower("full_text")
    attr = F.size(F.filter(wanted, lambda g: F.exists("__attr", lambda p: _same(p, g["s"])) | F.contains(text, g["t"])))
    opt = F.size(F.filter("__goal_opt", lambda g: F.exists("__opt", lambda p: _same(p, g))))
    category = F.size(F.array_intersect("__path", "__goal_path")) >= 2
    want = F.col("__goal_words")
    title = F.when(F.size(want) == 0, 0.2).otherwise(F.try_divide(F.size(F.array_intersect(want, "__words")).cast("double"), F.size(want)))
    match = (F.col("query") == F.col("goal_query")) | category | (title > 0.2)
    r_type = F.when(title == 0, 0.0).when(title < 0.1, 0.1).when(~match, 0.5).otherwise(1.0)
    ok = (F.col("price") <= F.col("price_upper")).cast("int")
    total = F.size("goal_attributes") + F.size("goal_options") + 1
    d = d.withColumns({"r_type": r_type, "reward": (attr + opt + ok) / total * r_type})
    return d.drop(*[f"__{p}{c}" for p in ("", "goal_") for c in ("attr", "opt", "path", "words")])
