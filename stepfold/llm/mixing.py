"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words: its weight's share of the mix, at most ``most`` times
its size, the excess shared again by weight (water filling). A document is wanted
target / size of its source times; the whole copies are certain and the fraction is rounded
by pivots: two documents with fractional copies trade words, in one of two directions drawn
so that expectations stay, until one of them is at 0 or 1. A pivot keeps the words of the
pair, so a source's words stay at its target but for one document left at the end, which is
drawn too.

The pivots run as a reduction tree: documents fall into small buckets by a hash of their
id, each bucket is folded in one row (an array aggregate) and passes its one fractional
document on to the next level, until a source is a single bucket. A source of any size
therefore spreads over as many buckets as it needs. Only DataFrame expressions are used, and
draws are hashes of the seed and the id, so reruns and retried tasks agree.

A null text or a text without words has size 0: it is taken 0 words whatever the draw. A
null source is a source of its own, last in order. Rows repeated in (doc_id, source, size)
are told apart by a running number. With no rows, or no words at all, the result is empty or
all targets are 0. Further columns are kept; clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.llm.base import checkpoint, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Documents folded in one row at each level of the tree.
FAN_IN = 64


def _running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Inclusive running sums over the whole table in ``order`` without gathering it: sorted
    ranges, written down so that a range keeps its rows, plus the totals of the ranges before."""
    parts = checkpoint(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    totals = parts.groupBy("__p").agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.withColumns({f"__t_{n}": F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)) for n in values})
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(totals), "__p")
    out = out.withColumns({n: F.sum(v).over(inside) + F.col(f"__t_{n}") for n, v in values.items()})
    return out.drop("__p", *[f"__t_{n}" for n in values])


def source_targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. ``docs`` has source and size.

    The caps that bind are those of the sources with the smallest cap / weight: in that order
    source i is capped when the level left after capping all before it is above its own.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    last = F.coalesce(F.col("source").isNull().cast("int"), F.lit(0))
    per = _running(per, [last, F.col("source")], __i=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__i") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumns({"weight": weight, "cap": F.col("source_size") * most}).withColumn("level", F.col("cap") / F.col("weight"))
    per = checkpoint(_running(per, [F.col("level"), F.col("__i")], __caps=F.col("cap"), __weights=F.col("weight")))
    whole = per.agg((F.sum("source_size") * share).alias("words"), F.sum("weight").alias("all"))
    capped = per.select("*", whole.select(F.struct("words", "all")).scalar().alias("g"))
    left_words = F.col("g.words") - (F.col("__caps") - F.col("cap"))
    left_weights = F.col("g.all") - (F.col("__weights") - F.col("weight"))
    binds = left_words / left_weights > F.col("level")
    free = capped.where(~binds).agg(F.max_by(F.struct((left_words / left_weights).alias("v")), -F.col("__caps") - F.col("__weights")).alias("v"))
    level = free.select(F.col("v.v")).scalar()
    return capped.select("source", "source_size", F.when(binds, F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _pivot(state: Column, x: Column) -> Column:
    """One pivot between the carried document and the next. State: the carried document c
    (null at first) and the documents settled so far. A document is (size, key, p, salt)."""
    c = state["c"]
    up_c = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])  # words that may go to c
    up_x = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])  # words that may go to x
    u = F.pmod(F.xxhash64(c["salt"], x["salt"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
    to_c = u * (up_c + up_x) < up_x
    # the limit reached names the document that is settled, and its value exactly
    fills_c = (1 - c["p"]) * c["size"] <= x["p"] * x["size"]
    fills_x = (1 - x["p"]) * x["size"] <= c["p"] * c["size"]
    done_c = F.when(to_c, fills_c).otherwise(~fills_x)
    value = F.when(to_c, F.when(fills_c, 1.0).otherwise(0.0)).otherwise(F.when(fills_x, 1.0).otherwise(0.0))
    moved = F.when(to_c, up_c).otherwise(-up_x)
    left = F.when(done_c, x["p"] - moved / x["size"]).otherwise(c["p"] + moved / c["size"])
    left = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))
    doc = lambda key, size, p, salt: F.struct(size.alias("size"), key.alias("key"), p.alias("p"), salt.alias("salt"))
    over = F.when(done_c, doc(x["key"], x["size"], left, x["salt"])).otherwise(doc(c["key"], c["size"], left, c["salt"]))
    settled = F.when(done_c, F.struct(c["key"].alias("key"), value.alias("p"))).otherwise(F.struct(x["key"].alias("key"), value.alias("p")))
    first = c.isNull()
    return F.struct(F.when(first, x).otherwise(over).alias("c"), F.when(first, state["s"]).otherwise(F.concat(state["s"], F.array(settled))).alias("s"))


def pivotal_rounding(items: DataFrame, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """key, picked (0 or 1). ``items``: key (unique), grp, size (> 0), p in (0, 1)."""
    key_type = items.schema["key"].dataType.simpleString()
    level = items.select("key", F.col("grp"), F.col("size").cast("double").alias("size"), F.col("p").cast("double").alias("p"))
    settled, depth = [], 0
    while True:
        counts = level.groupBy("grp").agg(F.count(F.lit(1)).alias("__n"))
        buckets = F.ceil(F.col("__n") / fan_in).cast("long")
        most = counts.agg(F.max(buckets)).first()[0]
        if most is None:
            break
        level = level.join(counts.withColumnRenamed("grp", "__g"), F.col("grp").eqNullSafe(F.col("__g"))).withColumn("__b", F.pmod(F.xxhash64("key", F.lit(seed), F.lit(depth)), buckets))
        doc = F.struct("size", "key", "p", F.xxhash64("key", F.lit(seed), F.lit(~depth)).alias("salt"))
        # like sizes meet, and the order is fixed
        rows = level.groupBy("grp", "__b").agg(F.sort_array(F.collect_list(doc)).alias("d"))
        kind = f"struct<size:double,key:{key_type},p:double,salt:bigint>"
        start = F.struct(F.lit(None).cast(kind).alias("c"), F.array().cast(f"array<struct<key:{key_type},p:double>>").alias("s"))
        folded = checkpoint(rows.select("grp", F.aggregate("d", start, _pivot).alias("r")).select("grp", "r.c", "r.s"))
        settled.append(folded.select(F.explode("s").alias("x")).select("x.key", F.col("x.p").alias("picked")))
        rest = folded.select("grp", "c.key", "c.size", "c.p")
        whole = (F.col("p") <= 0) | (F.col("p") >= 1)
        if most <= 1:  # one document of each group is left: draw it
            u = F.pmod(F.xxhash64("key", F.lit(seed), F.lit("last")), F.lit(1 << 52)) / F.lit(float(1 << 52))
            settled.append(rest.select("key", F.when(whole, F.round("p")).otherwise((u < F.col("p")).cast("double")).alias("picked")))
            break
        settled.append(rest.where(whole).select("key", F.round("p").alias("picked")))
        level, depth = rest.where(~whole), depth + 1
    out = settled[0] if settled else items.select("key", F.lit(0.0).alias("picked")).limit(0)
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def mix_plan(docs: DataFrame, text: str = "text", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, copy_no (numbers equal rows),
    source_size, target, copies and taken (words)."""
    sized = docs.select("doc_id", "source", F.size(words(F.col(text))).cast("long").alias("size"))
    groups = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("__m"))
    groups = groups.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m")))).drop("__m")
    groups = checkpoint(groups.withColumn("key", F.struct("doc_id", "source", "size", "copy_no")))
    targets = checkpoint(source_targets(groups, weights, share, most))
    name = targets.select(F.col("source").alias("__s"), "source_size", "target")
    rows = groups.join(name, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("__r", ratio).withColumn("__base", F.floor("__r")).withColumn("__f", F.col("__r") - F.col("__base"))
    part = rows.where((F.col("size") > 0) & (F.col("__f") > 1e-12)).select("key", F.col("source").alias("grp"), "size", F.col("__f").alias("p"))
    rows = rows.join(pivotal_rounding(part, seed), "key", "left")
    copies = F.when(F.col("size") > 0, (F.col("__base") + F.coalesce("picked", F.lit(0.0))).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "source", "size", "copy_no", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say, with ``repeat`` from 1."""
    plan = mix_plan(docs, text, **options).select("doc_id", "source", "size", "copy_no", "copies")
    number = Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")
    rows = docs.drop("repeat").withColumn("size", F.size(words(F.col(text))).cast("long")).withColumn("copy_no", F.row_number().over(number).cast("long"))
    plan = plan.where("copies > 0").withColumnsRenamed({c: f"__{c}" for c in plan.columns})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("doc_id", "source", "size", "copy_no")]
    out = rows.join(plan, same, "inner").withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.select(*docs.drop("repeat").columns, "repeat")
