"""Skill and experience memory: categories, retrieval, merging, renumbering.

A skill bank is the long table (kind, category, ord, skill_id, title, principle,
when_to_apply, description, how_to_avoid); an experience library is (exp_id, text,
embedding). A bank is prompt material and read whole by each retrieval, so it is packed
once into a row of arrays; samples and logs are never packed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions import classify as C
from stepfold.functions.normalize import slug
from stepfold.operators.records import NO_SKILLS
from stepfold.operators.similarity import closest_pairs, similar_links, similarity_topk
from stepfold.plans.iterate import components, greedy_matching
from stepfold.plans.session import checkpoint
from stepfold.plans.skew import RANGE_ROWS, first_per_group, group_values, has_hot, lookup, rank, running, top_k


# Headings and line forms of the prompt texts made here.
SECTIONS = {"general": "### General Principles", "task": "### Task-Relevant Skills", "mistake": "### Mistakes to Avoid", "other": "### {} Skills"}
SKILL_LINE, WHEN_LINE = ("- **", "**: "), ("\n  _Apply when: ", "_")
MISTAKE_LINE, INSTEAD_LINE = "- **Don't**: ", "\n  **Instead**: "
ACTION_LINE, OBSERVATION_LINE = "  Action: ", "\n  Observation: "


# ---- categories and memories -------------------------------------------------------------


def plan_patterns(steps: DataFrame, traj: str, step: str, action: str = "action") -> DataFrame:
    """Planning pattern of each trajectory: first step of each action kind, at most six."""
    kind = steps.select(traj, step, C.action_kind(F.col(action)).alias("kind")).where("kind IS NOT NULL")
    firsts = kind.groupBy(traj, "kind").agg(F.min(step).alias("s"))
    packed = F.array_sort(F.collect_list(F.struct("s", "kind")))
    return firsts.groupBy(traj).agg(F.array_join(F.transform(packed, lambda x: x["kind"]), " → ").alias("pattern"))


def trajectory_mistakes(steps: DataFrame, traj: str, *, action="action", task="task") -> DataFrame:
    """Mistake messages of each failed trajectory, counted per distinct action first."""
    each = steps.groupBy(traj, action).agg(F.count(F.lit(1)).alias("n"), F.min(task).alias("task"))
    g = each.groupBy(traj).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("task").alias("task"),
        F.sum(F.when(F.contains(F.lower(action), F.lit("go to")), F.col("n")).otherwise(0)).alias("g"),
    )
    return g.select(traj, C.mistakes(F.col("n"), F.col("d"), F.col("g"), F.col("task")).alias("mistakes"))


def trajectory_to_memory(steps: DataFrame, *, traj="traj_uid", step="step", action="action", obs="observation", task="task", success="success", environment: str) -> DataFrame:
    """One memory record per episode: successes keep steps and planning pattern, failures
    the mistakes. A success record holds its whole trajectory by design."""
    head = steps.groupBy(traj).agg(F.min(task).alias("goal"), F.max(success).alias("ok"))
    good = steps.where(F.col(success))
    packed = F.array_sort(F.collect_list(F.struct(F.col(step).alias("step_index"), F.col(action).alias("action"), F.col(obs).alias("observation"))))
    kept = good.groupBy(traj).agg(packed.alias("steps"))
    d = head.join(kept, traj, "left").join(plan_patterns(good, traj, step, action), traj, "left")
    d = d.join(trajectory_mistakes(steps.where(~F.col(success)), traj, action=action, task=task), traj, "left")
    outcome = F.when(F.col("ok"), "Success").otherwise("Failure")
    ending = F.when(F.col("ok"), ". Solved successfully.").otherwise(". Failed.")
    return d.select(
        F.concat(F.lit("mem_"), F.substring(F.sha2(F.col(traj).cast("string"), 256), 1, 8)).alias("memory_id"),
        F.col(traj),
        F.concat(F.lit(f"{environment} task: "), "goal", ending).alias("contextual_description"),
        F.struct(F.lit(environment).alias("environment"), outcome.alias("outcome"), F.lit(True).alias("training_generated")).alias("tags"),
        F.struct(
            F.struct(F.col("goal").alias("original_goal")).alias("task_meta"),
            F.col("steps").alias("refined_trajectory"),
            F.struct(
                F.when(F.col("ok"), F.coalesce("pattern", F.lit("Unknown pattern"))).alias("planning_pattern"),
                F.coalesce("mistakes", F.array().cast("array<string>")).alias("mistakes_to_avoid"),
            ).alias("strategic_guidelines"),
        ).alias("content"),
    )


def categorize_memories(memories: DataFrame, family: str, *, goal="goal", outcome="outcome", source="data_source") -> DataFrame:
    """Category counts by outcome; unknown household goals are left out."""
    g = F.col(goal)
    cat = {
        "household": lambda: C.classify_household(g, default=None),
        "shop": lambda: C.classify_shopping(g, memories=True),
        "search": lambda: C.classify_search(g, F.col(source)),
    }[family]()
    d = memories.withColumn("category", cat).where("category IS NOT NULL")
    ok = F.col(outcome) == "Success"
    return d.groupBy("category").agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failure"))


def pattern_digest(memories: DataFrame, n: int = 10, *, order="ord") -> DataFrame:
    """First n memories of each category and outcome: goal, first five steps, pattern,
    first three mistakes, as JSON."""
    d = top_k(memories, ["category", "outcome"], [F.col(order)], n)
    item = F.to_json(F.struct(
        "goal", "data_source", F.slice("steps", 1, 5).alias("steps"),
        F.coalesce("planning_pattern", F.lit("")).alias("planning_pattern"), F.slice("mistakes", 1, 3).alias("mistakes"),
    ))
    packed = F.array_sort(F.collect_list(F.struct("rn", item.alias("j"))))
    return d.groupBy("category", "outcome").agg(F.transform(packed, lambda x: x["j"]).alias("patterns"))


# ---- skill bank ---------------------------------------------------------------------------


def skill_text(df: DataFrame) -> Column:
    return F.concat_ws(". ", *[F.nullif(F.trim(c), F.lit("")) for c in ("title", "principle", "when_to_apply")])


def _ordered(kind: Column, *fields: str) -> Column:
    item = F.when(kind, F.struct("ord", *fields))
    return F.array_sort(F.collect_list(item))


def resolve_category(samples: DataFrame, skills: DataFrame, *, fields: Sequence[str], text="problem") -> DataFrame:
    """First metadata field naming a known category, else the first category with a name
    part inside the text, else the first category. The category list is one small array."""
    cats = skills.where("kind = 'task'").groupBy("category").agg(F.min("ord").alias("o"))
    names = cats.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "category"))), lambda x: x["category"])).scalar()
    d = samples.withColumn("__c", names)
    known = [F.when(F.array_contains(F.col("__c"), slug(F.col(f))), slug(F.col(f))) for f in fields if f in samples.columns]
    low = F.lower(F.coalesce(text, F.lit("")))
    inside = F.filter("__c", lambda c: F.exists(F.split(c, "_"), lambda p: (p != "") & F.contains(low, p)))
    out = F.coalesce(*known, F.try_element_at(inside, F.lit(1)), F.try_element_at("__c", F.lit(1)), F.lit("unknown"))
    return d.withColumn("task_type", out).drop("__c")


def retrieve_template(samples: DataFrame, skills: DataFrame, k: int = 6, task_k: int | None = None, *, category="task_type") -> DataFrame:
    """Adds general (every dynamic skill, then the first static ones up to k), task_skills
    and mistakes (first five) as arrays."""
    dyn = F.col("skill_id").startswith("dyn_")
    kind = lambda v: F.col("kind") == v
    # ranked before anything is packed: only what a prompt may hold comes together
    one = lambda cond, n: top_k(skills.where(cond).withColumn("__g", F.lit(0)), ["__g"], [F.col("ord")], n).select(*skills.columns)
    few = skills.where(kind("general") & dyn).unionByName(one(kind("general") & ~dyn, k)).unionByName(one(kind("mistake"), 5))
    g = few.agg(
        _ordered(kind("general") & dyn, "skill_id", "title", "principle").alias("d"),
        _ordered(kind("general") & ~dyn, "skill_id", "title", "principle").alias("s"),
        _ordered(kind("mistake"), "skill_id", "description", "how_to_avoid").alias("m"),
    )
    room = F.greatest(F.lit(k) - F.size("d"), F.lit(0))
    bank = g.select(F.struct(
        F.concat("d", F.slice("s", F.lit(1), room)).alias("general"), F.slice("m", 1, 5).alias("mistakes"))).scalar()
    tasks = skills.where(kind("task"))
    if task_k is not None:
        tasks = top_k(tasks, ["category"], [F.col("ord")], task_k).select(*skills.columns)
    tasks = tasks.groupBy("category").agg(_ordered(F.lit(True), "skill_id", "title", "principle", "when_to_apply").alias("task_skills"))
    d = lookup(samples, tasks.withColumnRenamed("category", category), [category])
    d = d.withColumn("__b", bank)
    return d.withColumns({"general": F.col("__b.general"), "mistakes": F.col("__b.mistakes")}).drop("__b")


def render_skills(df: DataFrame, *, category="task_type", mode: str = "template", out="skill_text") -> DataFrame:
    """Prompt text of retrieved skills: three headed sections, empty ones left out."""
    line = lambda s: F.concat(F.lit(SKILL_LINE[0]), s["title"], F.lit(SKILL_LINE[1]), s["principle"])
    when = lambda s: F.when(F.coalesce(s["when_to_apply"], F.lit("")) != "", F.concat(F.lit(WHEN_LINE[0]), s["when_to_apply"], F.lit(WHEN_LINE[1]))).otherwise("")
    fix = lambda s: F.when(F.coalesce(s["how_to_avoid"], F.lit("")) != "", F.concat(F.lit(INSTEAD_LINE), s["how_to_avoid"])).otherwise("")
    before, after = SECTIONS["other"].split("{}")
    named = F.concat(F.lit(before), F.initcap(F.replace(F.col(category), F.lit("_"), F.lit(" "))), F.lit(after))
    heading = F.lit(SECTIONS["task"]) if mode == "embedding" else named
    section = lambda items, head, f: F.when(F.size(items) > 0, F.concat(head, F.lit("\n"), F.array_join(F.transform(items, f), "\n")))
    told = F.filter("mistakes", lambda s: F.coalesce(s["description"], F.lit("")) != "")
    parts = [
        section(F.col("general"), F.lit(SECTIONS["general"]), line),
        section(F.coalesce("task_skills", F.array()), heading, lambda s: F.concat(line(s), when(s))) if "task_skills" in df.columns else F.lit(None),
        F.when(F.size("mistakes") > 0, F.concat(F.lit(SECTIONS["mistake"] + "\n"), F.array_join(
            F.transform(told, lambda s: F.concat(F.lit(MISTAKE_LINE), s["description"], fix(s))), "\n"))),
    ]
    text = F.array_join(F.array_compact(F.array(*parts)), "\n\n")
    return df.withColumn(out, F.when(text == "", NO_SKILLS).otherwise(text))


def inject_skills(samples: DataFrame, skills: DataFrame, *, k=6, fields=("category", "benchmark_name"), text="problem") -> DataFrame:
    """Samples with the prompt text of their retrieved skills."""
    d = retrieve_template(resolve_category(samples, skills, fields=fields, text=text), skills, k)
    return render_skills(d).drop("general", "task_skills", "mistakes")


def retrieve_embedding(queries: DataFrame, skills: DataFrame, k: int, min_sim: float | None = None) -> DataFrame:
    """Top skills per kind over all categories."""
    return similarity_topk(queries, skills, k, min_sim=min_sim, by_kind=True)


def add_skills(bank: DataFrame, new: DataFrame, *, order="ord") -> DataFrame:
    """Bank plus the new skills whose id is not there yet; repeated new ids keep the first."""
    fresh = first_per_group(new.join(bank.select("skill_id"), "skill_id", "left_anti"), ["skill_id"], [order])
    return bank.unionByName(fresh, allowMissingColumns=True)


def remove_skill(bank: DataFrame, skill_id: str) -> DataFrame:
    return bank.where(F.col("skill_id") != skill_id)


def next_dyn_ids(new: DataFrame, bank: DataFrame, cap: int = 3, *, order="ord") -> DataFrame:
    """First ``cap`` new skills renumbered after the bank's largest dyn number."""
    top = bank.agg(F.coalesce(F.max(F.regexp_extract("skill_id", r"^dyn_(\d+)$", 1).try_cast("long")), F.lit(0))).scalar()
    d = top_k(new.withColumn("__g", F.lit(0)), ["__g"], [F.col(order)], cap, "__rn").withColumn("__t", top)
    return d.withColumn("skill_id", F.format_string("dyn_%03d", F.col("__t") + F.col("__rn"))).drop("__g", "__rn", "__t")


def update_trigger(results: DataFrame, threshold: float, *, task="task_type", score="score", order="ord", cap=10, split="train") -> DataFrame:
    """First failures to analyse when some task type's success rate is below the threshold;
    each carries the low types and the bank the answer may go to, never validation."""
    if split != "train":
        raise ValueError("new skills only ever go to the train bank")
    rates = results.groupBy(task).agg(F.avg((F.col(score) > 0).cast("double")).alias("r")).where(F.col("r") < threshold)
    low = rates.agg(F.concat_ws(",", F.array_sort(F.collect_list(task))).alias("l")).scalar()
    failed = results.where(F.col(score) <= 0).orderBy(order).limit(cap)
    return failed.withColumns({"low_success_tasks": low, "target_split": F.lit(split)}).where("low_success_tasks <> ''")


def failure_context(failed: DataFrame, steps: DataFrame, bank: DataFrame, *, traj="traj_uid", order="ord", n=5, last=5, cut=200) -> DataFrame:
    """Prompt table of the first failures: their last steps and the existing skill titles."""
    picked = failed.orderBy(order).limit(n)
    tail = steps.join(picked.select(traj), traj, "left_semi")
    tail = top_k(tail, [traj], [F.desc("step")], last)
    line = F.concat(F.lit(ACTION_LINE), "action", F.lit(OBSERVATION_LINE), F.substring("observation", 1, cut))
    text = tail.groupBy(traj).agg(F.array_sort(F.collect_list(F.struct("step", line.alias("s")))).alias("l"))
    text = text.select(traj, F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("trajectory"))
    shown = F.when(F.col("kind") == "task", F.concat(F.lit("["), "category", F.lit("] "), "title")).otherwise(F.col("title"))
    titles = bank.where("kind <> 'mistake'").agg(F.array_sort(F.collect_list(F.struct("kind", "ord", shown.alias("t")))).alias("l"))
    titles = titles.select(F.array_join(F.transform("l", lambda x: x["t"]), "; ")).scalar()
    return picked.join(text, traj, "left").withColumn("existing_titles", titles)


# ---- experience library -------------------------------------------------------------------


def retrieve_multi(subqueries: DataFrame, items: DataFrame, k: int, min_sim: float | None = None) -> DataFrame:
    """Hits of each task's sub-queries, each item once at its first (sub-query, rank).

    ``subqueries`` has task_id, ord, id, embedding with unique ids.
    """
    hits = similarity_topk(subqueries, items, k, min_sim=min_sim)
    d = lookup(hits, subqueries.select(F.col("id").alias("query_id"), "task_id", "ord"), ["query_id"])
    return first_per_group(d, ["task_id", "item_id"], ["ord", "rn"])


def retrieval_diagnostics(hits: DataFrame, queries: DataFrame, *, shown: int = 5) -> DataFrame:
    """Per query: number of hits and its top scores, queries without hits included."""
    packed = F.array_sort(F.collect_list(F.when(F.col("rn") <= shown, F.struct("rn", F.round("sim", 4).alias("s")))))
    g = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), packed.alias("l"))
    g = g.select("query_id", "hits", F.array_join(F.transform("l", lambda x: F.format_string("%.4f", x["s"])), ",").alias("top_scores"))
    return queries.select(F.col("id").alias("query_id")).join(g, "query_id", "left").na.fill(0, ["hits"]).na.fill("", ["top_scores"])


def merge_candidates(existing: DataFrame, ops: DataFrame, threshold: float = 0.70, k: int = 10) -> DataFrame:
    """Each operation and what it does: merge rows (one per similar item), add, or replace.

    ``ops`` has op_id, option, modified_from, embedding; a modify of an unknown id adds.
    """
    known = existing.select(F.col("id").alias("modified_from"))
    asks = F.coalesce((F.col("option") == "modify") & F.col("modified_from").isNotNull(), F.lit(False))
    # only those that name an item are looked up: the others would meet in the task of the null key
    named = ops.where(asks)
    swaps = named.join(known, "modified_from", "left_semi")
    swaps = swaps.select("op_id", F.lit("replace").alias("action"), F.col("modified_from").alias("item_id"), F.lit(None).cast("double").alias("sim"))
    unknown = named.join(known, "modified_from", "left_anti")
    adds = ops.where(~asks).select("op_id", "embedding").unionByName(unknown.select("op_id", "embedding"))
    hits = similarity_topk(adds.select(F.col("op_id").alias("id"), "embedding"), existing, k, min_sim=threshold)
    # read once: another use of the hits would search again
    told = adds.select("op_id").join(hits.select(F.col("query_id").alias("op_id"), "item_id", "sim"), "op_id", "left")
    return swaps.unionByName(told.withColumn("action", F.when(F.col("sim").isNotNull(), "merge").otherwise("add")))


def plan_merges(existing: DataFrame, ops: DataFrame, threshold: float = 0.70, k: int = 10) -> DataFrame:
    """Merge sets of a whole batch: components over operation-item and operation-operation
    similarity. Set-based where a one-by-one pass would depend on the order. Nodes are
    'op:<id>' and 'item:<id>'. Near-copies among the operations are linked once each."""
    cand = checkpoint(merge_candidates(existing, ops, threshold, k))
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    to_items = cand.where("action = 'merge'").select(node("op:", "op_id").alias("a"), node("item:", "item_id").alias("b"))
    adds = ops.join(cand.where("action <> 'replace'").select("op_id").distinct(), "op_id", "left_semi")
    inside = similar_links(adds.select(F.col("op_id").alias("id"), "embedding"), threshold)
    inside = inside.select(node("op:", "a").alias("a"), node("op:", "b").alias("b"))
    return components(to_items.unionByName(inside))


def _mean_vector(a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: ((z["x"] + z["y"]) / 2).cast("float"))


def reduce_to_limit(library: DataFrame, limit: int, threshold: float = 0.60, rounds: int = 3) -> DataFrame:
    """Merges disjoint most similar pairs until the library fits: per round a greedy pass
    over the best (size - limit) pairs. A merged item joins both texts, and its vector is
    their mean until the caller re-embeds it. ``library`` has exp_no, text, embedding."""
    keep = ["exp_no", "text", "embedding"]
    lib = checkpoint(library.select(*keep, F.lit(True).alias("fresh")))
    known = None
    for _ in range(rounds):
        over = lib.count() - limit
        if over <= 0:
            break
        # equal vectors: the first one stands for all in pairs with others
        hot = has_hot(lib, ["embedding"])
        lib = group_values(lib, ["embedding"], hot=hot, first=F.min("exp_no"))
        lib = checkpoint(running(lib, ["embedding"], ["exp_no"], hot=hot, place=F.lit(1).cast("long")))
        link = lambda a, b: (F.col(a).alias("a"), F.col(b).alias("b"), F.lit(1.0).alias("sim"))
        same = lib.where(F.exists("embedding", lambda x: x != 0))
        links = same.where("place > 1").select(*link("first", "exp_no"))
        # they pair up two by two besides; the first two of a pile are linked already
        two = same.where("place > 2").groupBy("first", F.floor((F.col("place") - 1) / 2)).agg(F.min("exp_no").alias("a"), F.max("exp_no").alias("b"))
        links = links.unionByName(two.where("a < b").select(*link("a", "b")))
        vectors = lib.where("place = 1").select(F.col("exp_no").alias("id"), "embedding", "fresh")
        known = closest_pairs(vectors, threshold, over - links.count(), known)
        best, order = known.pairs.unionByName(links), [F.desc("sim"), F.col("a"), F.col("b")]
        # a limit would bring all of them to one task
        best = best.orderBy(*order).limit(over) if over <= RANGE_ROWS else rank(best, [], order).where(F.col("rn") <= over).drop("rn")
        taken = checkpoint(greedy_matching(best))
        if taken.isEmpty():
            break
        end = lambda c, n: F.struct(F.col(c).alias("exp_no"), F.lit(n).alias("end"))
        ends = rank(taken, [], order).select("rn", F.explode(F.array(end("a", 0), end("b", 1))).alias("e")).select("rn", "e.*")
        ends = checkpoint(ends)
        d = checkpoint(lookup(lib, ends, ["exp_no"]))
        side = lambda f: f(F.struct("text", "embedding"), F.col("end"))
        m = d.where("rn IS NOT NULL").groupBy("rn").agg(side(F.min_by).alias("a"), side(F.max_by).alias("b"))
        m = m.withColumn("top", lib.agg(F.max("exp_no")).scalar())
        merged = m.select((F.col("top") + F.col("rn")).alias("exp_no"), F.concat_ws("\n\n", "a.text", "b.text").alias("text"),
                          _mean_vector(F.col("a.embedding"), F.col("b.embedding")).alias("embedding"), F.lit(True).alias("fresh"))
        # what was first of its copies still is, for new numbers are larger
        lib = checkpoint(d.where("rn IS NULL").select(*keep, (F.col("place") > 1).alias("fresh")).unionByName(merged))
        for c in ("a", "b"):
            known.pairs = known.pairs.join(ends.select(F.col("exp_no").alias(c)), c, "left_anti")
        known.pairs = known.pairs.select("a", "b", "sim")
    return lib.select(*keep)


def apply_refine_ops(library: DataFrame, ops: DataFrame) -> DataFrame:
    """Merge (two or more existing sources) and delete operations, then numeric renumbering.

    ``ops`` has op_no, option, ids ARRAY, text. Operations of a batch must not share ids;
    the first one by op_no wins an id.
    """
    each = ops.select("op_no", "option", "text", F.explode(F.array_distinct("ids")).alias("exp_id"))
    each = each.join(library.select("exp_id"), "exp_id", "left_semi")
    each = first_per_group(each, ["exp_id"], ["op_no"])
    valid = each.groupBy("op_no", "option", "text").agg(F.count(F.lit(1)).alias("n"))
    valid = valid.where((F.col("option") == "delete") | ((F.col("option") == "merge") & (F.col("n") >= 2) & (F.trim("text") != "")))
    gone = each.join(valid.select("op_no"), "op_no", "left_semi").select("exp_id")
    kept = library.join(gone, "exp_id", "left_anti").select(F.substring("exp_id", 2, 20).try_cast("long").alias("no"), "text")
    top = library.agg(F.max(F.substring("exp_id", 2, 20).try_cast("long"))).scalar()
    merged = valid.where("option = 'merge'").withColumn("top", top)
    merged = merged.select((F.col("top") + 1 + F.col("op_no")).alias("no"), "text")
    return renumber(kept.unionByName(merged), order="numeric", number="no")


def renumber(library: DataFrame, *, order: str = "numeric", number="exp_no") -> DataFrame:
    """E0, E1, ... by number, or by the id as a string (E10 before E2)."""
    if order == "numeric":
        d = rank(library, [], [number], number, "__rn")
    elif order == "string":
        # the number left-aligned to a fixed width sorts as its text does
        text = F.col(number).cast("string")
        d = rank(library, [], [text], F.rpad(text, 18, "0").cast("double"), "__rn")
    else:
        raise ValueError(f"unknown order {order!r}")
    return d.select(F.concat(F.lit("E"), (F.col("__rn") - 1).cast("string")).alias("exp_id"), "text")


def used_experiences(retrieved: DataFrame, rewritten: DataFrame, *, sample="sample_id", exp="exp_id") -> DataFrame:
    """Originals whose id survives the sample's rewrite; without a rewrite all of them."""
    has = rewritten.select(sample).distinct()
    kept = retrieved.join(rewritten.select(sample, exp), [sample, exp], "left_semi")  # repeats on this side do not count
    return kept.unionByName(retrieved.join(has, sample, "left_anti"))


def retrieve_examples(queries: DataFrame, memories: DataFrame, *, k=10, min_sim=0.7, max_tokens=2000) -> DataFrame:
    """Similar successes, failures to avoid and distinct planning patterns per query, each
    section cut to its token budget. ``memories`` has id, success, pattern, text, embedding."""
    ok, bad = memories.where("success"), memories.where("NOT success")
    good = similarity_topk(queries, ok, k, min_sim=min_sim)
    avoid = similarity_topk(queries, bad, min(k // 2, 5), min_sim=min_sim)
    body = memories.select(F.col("id").alias("item_id"), "pattern", "text")
    good, avoid = lookup(good, body, ["item_id"]), lookup(avoid, body, ["item_id"])
    general = first_per_group(good.where("pattern <> ''"), ["query_id", "pattern"], ["rn"])
    general = general.withColumn("text", F.col("pattern"))
    budgets = {"general": (general, 500), "mistakes": (avoid, 300), "examples": (good, max_tokens - 800)}
    out = None
    for section, (d, budget) in budgets.items():
        d = running(d, ["query_id"], ["rn"], "rn", used=F.floor(F.length("text") / 4)).where(F.col("used") <= budget)
        d = d.select("query_id", F.lit(section).alias("section"), "rn", "item_id", "sim")
        out = d if out is None else out.unionByName(d)
    return out


def snapshot(library: DataFrame, path: str, batch_idx: int) -> None:
    """Versioned copy of the library before a merge batch."""
    library.withColumn("batch_idx", F.lit(batch_idx)).write.mode("append").partitionBy("batch_idx").parquet(path)


# ---- generated payloads -------------------------------------------------------------------

SKILL_ITEM = "array<struct<skill_id:string,title:string,principle:string,when_to_apply:string>>"
# Names an operation's text and option may carry, in order.
TEXT_NAMES = ["experience", "exp", "text", "lesson", "tip", "rule", "content", "new_experience", "modified_experience"]
OPTION_NAMES = ["option", "action", "type"]
FROM_NAMES = ["modified_from", "id", "experience_id"]
WRAPPERS = ["experiences", "experience", "operations", "updates", "add", "execution_tips", "decision_rules", "tips", "rules"]


def ingest_skill_outputs(df: DataFrame, *, text="text", required=("title", "principle"), keep=("out_id",)) -> DataFrame:
    """Candidate skills of generated outputs: items of the outermost JSON list that have the
    required keys. A bad payload gives one row with parse_error set, so it can be counted."""
    items = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), SKILL_ITEM)
    good = F.filter(items, lambda s: F.forall(F.array(*[s[r] for r in required]), lambda v: v.isNotNull()))
    d = df.select(*keep, items.isNull().alias("parse_error"), F.posexplode_outer(good).alias("ord", "s"))
    return d.where("parse_error OR s IS NOT NULL").select(
        *keep, "parse_error", "ord", *[F.col(f"s.{c}").alias(c) for c in ("skill_id", "title", "principle", "when_to_apply")])


def ingest_experience_ops(df: DataFrame, max_ops: int = 2, *, text="text", keep=("out_id",)) -> DataFrame:
    """add and modify operations of generated outputs: fenced or plain JSON, a list or an
    object holding one; aliases resolved; the first max_ops per output."""
    fields = ",".join(f"{n}:string" for n in dict.fromkeys([*TEXT_NAMES, *OPTION_NAMES, *FROM_NAMES]))
    item = f"array<struct<{fields}>>"
    fenced = F.nullif(F.trim(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)), F.lit(""))
    payload = F.coalesce(fenced, F.trim(text))
    listed = F.coalesce(
        F.when(payload.startswith("["), payload),
        *[F.when(F.get_json_object(payload, f"$.{w}").startswith("["), F.get_json_object(payload, f"$.{w}")) for w in WRAPPERS],
        F.when(payload.startswith("{"), F.concat(F.lit("["), payload, F.lit("]"))),
        F.nullif(F.regexp_extract(text, r"(?s)\[\s*\{.*?\}\s*\]", 0), F.lit("")),
    )
    d = df.select(*keep, F.posexplode(F.from_json(listed, item)).alias("__i", "o"))
    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(f"o.{n}")), F.lit("")) for n in names])
    option = F.lower(F.coalesce(pick(OPTION_NAMES), F.lit("add")))
    d = d.select(*keep, "__i", F.when(option == "modify", "modify").otherwise("add").alias("option"), pick(TEXT_NAMES).alias("experience"),
                 F.when(option == "modify", pick(FROM_NAMES)).alias("modified_from")).where("experience IS NOT NULL")
    d = top_k(d, list(keep), [F.col("__i")], max_ops)
    return d.drop("__i").withColumnRenamed("rn", "op_no")
