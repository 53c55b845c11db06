"""Training and evaluation records built from sample, dialogue and preference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions import normalize as N
from stepfold.functions.text import blank_to_null, first_match, squeeze, strip, word_count
from stepfold.plans.skew import lookup, rank, running

# Prompt texts.
SYSTEM_PROMPT = (
    "You are a multimodal reasoning agent. Use the provided skills when they are relevant, reason "
    "carefully over the question and images, and produce the final answer."
)
IMAGE_ONLY_PROMPT = (
    "Please answer the question shown in the image. Provide the final answer using the required answer format."
)
TOOL_PROTOCOL = """You may use tools when external information, webpage reading, OCR, image inspection, or calculation is needed.
Call exactly one tool at a time using this format:
<tool_call>{"name":"web_search","arguments":{"query":"search terms","max_results":5}}</tool_call>

Available tools:
- web_search: {"query": "...", "max_results": 5}
- visit: {"url": "https://...", "goal": "what to find"}
- image_search: {"search_type": "text|reverse", "query": "...", "image_url": "original_image or tool_image_N", "max_results": 5}
- code_interpreter: {"code": "python code"}
- zoom: {"code": "python code to crop or inspect images"}

After each tool observation, continue reasoning or call another tool. When ready, give the final answer as <answer>...</answer>."""
SKILL_HEADING = "## Retrieved Relevant Experience"
TOOL_HEADING = "## Tool Protocol"
NO_SKILLS = "No relevant skills found for this task."

# Field chains of each benchmark source, first non-empty wins.
SOURCES: dict[str, dict[str, list[str]]] = {
    "tirbench": {
        "doc_id": ["doc_id", "id"],
        "problem": ["problem", "question", "prompt"],
        "solution": ["solution", "answer"],
        "task": ["_tirbench_task", "task", "category", "subset"],
    },
    "visualtoolbench": {
        "doc_id": ["doc_id", "id"],
        "problem": ["problem", "question"],
        "solution": ["solution", "answer"],
        "prompt_category": ["prompt_category"],
    },
    "agentvista": {
        "doc_id": ["doc_id", "id"],
        "problem": ["problem", "question"],
        "solution": ["solution", "answer"],
        "domain": ["domain"],
        "subdomain": ["subdomain"],
    },
    "mmbrowsecomp": {
        "doc_id": ["doc_id", "id", "question_id"],
        "problem": ["problem", "question"],
        "solution": ["solution", "answer"],
        "category": ["_mmbc_category", "category"],
        "level": ["_mmbc_level", "level"],
    },
    "mmsearch_plus": {
        "doc_id": ["doc_id", "id"],
        "problem": ["problem", "question"],
        "solution": ["solution", "answer"],
        "category": ["category"],
        "difficulty": ["difficulty"],
    },
}
# Tasks kept of the first source; the subset kept of the second.
KEPT_TASKS = ["refcoco", "maze", "instrument", "ocr", "contrast"]
KEPT_TURNCASE, KEPT_FOCUS = "single-turn", "hybrid_tool_reasoning"

PROBLEM_FIELDS = ["problem", "question", "query", "instruction", "task"]
SOLUTION_FIELDS = ["solution", "answer", "ground_truth", "label", "target"]


def _chain(df: DataFrame, names: list[str], trim: bool = False) -> Column:
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    if not have:
        return F.lit(None).cast("string")
    kept = [blank_to_null(strip(c)) if trim else F.nullif(c, F.lit("")) for c in have]
    return F.coalesce(*kept)


def normalize_samples(df: DataFrame, benchmark: str, *, order: str) -> DataFrame:
    """Canonical columns for one source; ``order`` is the 0-based input position used in
    generated ids."""
    chains = SOURCES[benchmark]
    d = df
    if benchmark == "visualtoolbench":
        turn = F.lower(strip(F.coalesce(_chain(df, ["turncase", "turn_case"]), F.lit(""))))
        d = d.where((turn == KEPT_TURNCASE) & (F.lower(strip(F.col("eval_focus"))) == KEPT_FOCUS))
    out = {"benchmark_name": F.lit(N.normalize_benchmark(F.lit(benchmark)))}
    for name, fields in chains.items():
        c = _chain(df, fields)
        if name == "doc_id":
            c = N.prefixed_id(F.coalesce(c, F.format_string(f"{benchmark}_%04d", F.col(order))), F.lit(benchmark))
        elif name == "problem" and "turn_prompts" in df.columns and benchmark == "visualtoolbench":
            c = F.coalesce(F.try_element_at("turn_prompts", F.lit(1)), c, F.lit(""))
        elif name == "solution" and "turn_golden_answers" in df.columns and benchmark == "visualtoolbench":
            c = F.coalesce(F.try_element_at("turn_golden_answers", F.lit(1)), c, F.lit(""))
        elif name in ("problem", "solution"):
            c = F.coalesce(c, F.lit(""))
        else:
            c = F.coalesce(c, F.lit("unknown"))
            c = F.lower(strip(c)) if name == "task" else c
        out[name] = c
    used = {f for fields in chains.values() for f in fields}
    rest = [c for c in d.columns if c not in used and c not in out]
    d = d.select(*rest, *[c.alias(n) for n, c in out.items()])
    return d.where(F.col("task").isin(KEPT_TASKS)) if benchmark == "tirbench" else d


def rewrite_ids(df: DataFrame, *, raw_id: bool = False) -> DataFrame:
    """Prefix ids with the benchmark, keep the old ones once, flag changed rows."""
    names = [c for c in ("doc_id", "question_id", "id") if c in df.columns]
    raw = _chain(df, names)
    bench = N.normalize_benchmark(F.col("benchmark_name"))
    good = bench.isNotNull() & raw.isNotNull()
    full = N.prefixed_id(raw, F.col("benchmark_name"))
    changed = F.col("benchmark_name") != bench
    new: dict[str, Column] = {"benchmark_name": F.when(good, bench).otherwise(F.col("benchmark_name"))}
    for c in [n for n in names if n != "id" or raw_id]:
        moved = good & ~F.col(c).cast("string").eqNullSafe(full)
        old = f"original_{c}"
        kept = F.col(old) if old in df.columns else F.lit(None).cast("string")
        new[old] = F.coalesce(kept, F.when(moved, F.col(c).cast("string")))
        new[c] = F.when(moved, full).otherwise(F.col(c).cast("string"))
        changed = changed | moved
    return df.select(
        *[c for c in df.columns if c not in new],
        *[v.alias(k) for k, v in new.items()],
        (good & changed).alias("changed"),
    )


def localize_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Local key of every row's url, each distinct url resolved once."""
    keys = df.select(N.fix_url(F.col(url)).alias("__u")).distinct().withColumn("local_key", N.url_to_key(F.col("__u")))
    return lookup(df.withColumn("__u", N.fix_url(F.col(url))), keys, ["__u"]).drop("__u")


def extract_problem(df: DataFrame) -> Column:
    """First filled problem field; else the last user message; else the text after the last
    USER: line."""
    options = [_chain(df, PROBLEM_FIELDS, trim=True)]
    if "messages" in df.columns:
        users = F.filter("messages", lambda m: (F.lower(m["role"]) == "user") & (m["content"] != ""))
        options.append(F.element_at(F.when(F.size(users) > 0, users), -1)["content"])
    if "prompt" in df.columns:
        options.append(strip(F.regexp_replace("prompt", r"(?is)\A(.*\n)?\s*USER\s*:\s*", "")))
    return strip(F.coalesce(*options, F.lit("")))


def extract_solution(df: DataFrame) -> Column:
    return F.coalesce(_chain(df, SOLUTION_FIELDS, trim=True), F.lit(""))


def build_sft_records(
    df: DataFrame, response_format: str = "answer_tag", *, order: str, enable_tools=False, skill_text: str | None = None
) -> DataFrame:
    """prompt, response, extra_info and images of every sample that can be trained on."""
    images = F.col("images") if "images" in df.columns else F.array().cast("array<string>")
    sources = F.col("source") if "source" in df.columns else F.array().cast("array<string>")
    d = df.select(
        "*", extract_problem(df).alias("__p"), extract_solution(df).alias("__s"), images.alias("__i"), sources.alias("__u")
    )
    d = d.where((F.col("__s") != "") & ((F.col("__p") != "") | (F.size("__i") > 0)))
    problem = N.append_source_urls(F.when(F.col("__p") == "", IMAGE_ONLY_PROMPT).otherwise(F.col("__p")), F.col("__u"))
    system = F.lit(SYSTEM_PROMPT)
    if skill_text:
        t = F.col(skill_text)
        has = t.isNotNull() & (t != "") & (t != NO_SKILLS)
        system = F.concat(system, F.when(has, F.concat(F.lit(f"\n\n{SKILL_HEADING}\n"), t)).otherwise(""))
    if enable_tools:
        system = F.concat(system, F.lit(f"\n\n{TOOL_HEADING}\n{TOOL_PROTOCOL}"))
    answer = {
        "answer_tag": F.concat(F.lit("<answer>"), "__s", F.lit("</answer>")),
        "final_answer": F.concat(F.lit("Final answer: "), "__s"),
        "plain": F.col("__s"),
    }[response_format]
    info = F.struct(
        F.col(order).alias("index"),
        F.coalesce(F.col("doc_id").cast("string"), F.col(order).cast("string")).alias("doc_id"),
        F.col("benchmark_name"),
        F.lit(skill_text is not None).alias("has_skill_prompt"),
        (F.size("__i") > 0).alias("has_images"),
        F.size("__i").alias("num_images"),
        ((F.col("__p") == "") & (F.size("__i") > 0)).alias("image_only_prompt"),
        F.lit(enable_tools).alias("tool_protocol"),
    )
    return d.select(
        F.concat(F.lit("SYSTEM:\n"), system, F.lit("\n\nUSER:\n"), problem).alias("prompt"),
        answer.alias("response"), info.alias("extra_info"), F.col("__i").alias("images"),
    )


def build_rl_records(
    df: DataFrame, *, order: str, skill_text: str | None = None, task_type: str | None = None, top_k=6, style="rule_or_judge"
) -> DataFrame:
    """Nested rollout records with the skill-augmented system message."""
    images = F.col("images") if "images" in df.columns else F.array().cast("array<string>")
    sources = F.col("source") if "source" in df.columns else F.array().cast("array<string>")
    problem = N.append_source_urls(F.coalesce(_chain(df, ["problem", "question"]), F.lit("")), sources)
    solution = F.coalesce(_chain(df, ["solution"]), F.lit(""))
    bench, doc_id = F.col("benchmark_name"), F.coalesce(F.col("doc_id").cast("string"), F.col(order).cast("string"))
    system = F.lit(SYSTEM_PROMPT)
    if skill_text:
        t = F.col(skill_text)
        system = F.concat(system, F.when(t != "", F.concat(F.lit(f"\n\n{SKILL_HEADING}\n"), t)).otherwise(""))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    prompt = F.array(message("system", system), message("user", problem))
    retrieval = F.struct(
        F.lit(skill_text is not None).alias("enabled"),
        (F.col(task_type) if task_type else F.lit("")).alias("task_type"),
        F.lit("template" if skill_text else "").alias("retrieval_mode"),
        F.lit(top_k).alias("top_k"),
    )
    env = F.struct(
        doc_id.alias("doc_id"), bench.alias("benchmark_name"), problem.alias("problem"), images.alias("images"),
        solution.alias("solution"), prompt.alias("prompt"),
    )
    info = F.struct(
        F.col(order).alias("index"), doc_id.alias("doc_id"), bench.alias("benchmark_name"), solution.alias("solution"),
        solution.alias("answer"), F.to_json(F.struct(*df.columns)).alias("sample_json"), retrieval.alias("skill_retrieval"),
    )
    return df.select(
        bench.alias("data_source"), prompt.alias("prompt"),
        F.transform(images, lambda i: F.struct(i.alias("image"))).alias("images"), env.alias("env_kwargs"),
        F.struct(F.lit(style).alias("style"), solution.alias("ground_truth")).alias("reward_model"), info.alias("extra_info"),
    )


# Instructions of the dataset presets.
GSM8K_INSTRUCTION = 'Let\'s think step by step and output the final answer after "####".'
MATH_INSTRUCTION = "Let's think step by step and output the final answer within \\boxed{}."
GEO_INSTRUCTION = (
    "You FIRST think about the reasoning process as an internal monologue and then provide the final answer. "
    "The reasoning process MUST BE enclosed within <think> </think> tags. "
    "The final answer MUST BE put in \\boxed{}."
)
CHOICE_TEMPLATE = (
    "Answer the following multiple choice question. The last line of your response should be of the following format: "
    "'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before answering."
    "\n\n%s\n\nA) %s\nB) %s\nC) %s\nD) %s"
)


def clean_hellaswag(c: Column) -> Column:
    t = F.replace(strip(c), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(t, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def shuffled_choices(df: DataFrame, key: Column, gold: Column, wrong: list[Column], seed: int) -> DataFrame:
    """Options ordered by hash of (seed, key, option number); remembers the gold letter."""
    options = [gold, *wrong]
    tagged = F.array(
        *[
            F.struct(F.md5(F.concat_ws(":", F.lit(seed), key, F.lit(i))).alias("h"), o.alias("o"), F.lit(i == 0).alias("g"))
            for i, o in enumerate(options)
        ]
    )
    d = df.withColumn("__o", F.array_sort(tagged))
    at = F.array_position(F.transform("__o", lambda x: x["g"]), True)
    return d.withColumns(
        {
            "choices": F.transform("__o", lambda x: x["o"]),
            "gold_letter": F.substring(F.lit("ABCDEFGHIJ"), at.cast("int"), F.lit(1)),
        }
    ).drop("__o")


def map_instruction_dataset(df: DataFrame, preset: str, *, order: str, split: str, data_source: str, seed=0) -> DataFrame:
    """One record {data_source, prompt, ability, reward_model, extra_info} per row."""
    style, ability, system = "rule", "math", None
    if preset == "gsm8k":
        content = F.concat("question", F.lit(" " + GSM8K_INSTRUCTION))
        gold = F.translate(first_match(F.col("answer"), r"#### (-?[0-9.,]+)"), ",", "")
    elif preset == "math":
        content, gold = F.concat("problem", F.lit(" " + MATH_INSTRUCTION)), F.col("gold")
    elif preset == "geo3k":
        content, gold = F.concat("problem", F.lit(" " + GEO_INSTRUCTION)), F.col("answer")
    elif preset == "aime":
        content, gold, ability = F.col("problem"), F.col("answer").cast("string"), "English"
    elif preset == "search_qa":
        content, gold, ability = F.col("question"), F.col("golden_answer"), "fact-reasoning"
    elif preset == "hellaswag":
        df = df.where(F.length("label") > 0)
        b = F.concat(F.upper(F.substring("ctx_b", 1, 1)), F.lower(F.substring("ctx_b", F.lit(2), F.length("ctx_b"))))
        content = clean_hellaswag(F.concat("activity_label", F.lit(": "), "ctx_a", F.lit(" "), b))
        gold, ability, style = F.col("label"), "nlp", "model"
    elif preset == "multiple_choice":
        df = shuffled_choices(df, F.col(order), F.col("correct"), [F.col(f"wrong{i}") for i in (1, 2, 3)], seed)
        content = F.format_string(CHOICE_TEMPLATE, "question", *[F.col("choices")[i] for i in range(4)])
        gold, ability = F.col("gold_letter"), "Math"
    else:
        raise ValueError(f"unknown preset {preset!r}")
    message = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    return df.select(
        F.lit(data_source).alias("data_source"), message.alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), gold.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(order).alias("index")).alias("extra_info"),
    )


def filter_date_window(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """Half-open window; the bounds take the column's type, so the filter reaches the scan."""
    lo, hi = (F.lit(v).cast(df.schema[column].dataType) for v in (lo, hi))
    return df.where((F.col(column) >= lo) & (F.col(column) < hi))


def preference_records(df: DataFrame, mode: str, *, order: str) -> DataFrame:
    """sft: two rows per pair; rm: one row, the first 75% by order as train, the rest test."""
    if mode == "sft":
        both = F.array(
            F.struct(F.lit(0).alias("ord"), F.col("chosen").alias("response")),
            F.struct(F.lit(1).alias("ord"), F.col("rejected").alias("response")),
        )
        return df.select(order, "prompt", F.explode(both).alias("r")).select(order, "prompt", "r.ord", "r.response")
    if mode != "rm":
        raise ValueError(f"unknown mode {mode!r}")
    d = rank(df, [], [order], order, "__rn").withColumn("__n", df.agg(F.count(F.lit(1))).scalar())
    head = F.col("__rn") <= F.bround(F.col("__n") * 0.75).cast("long")
    return d.withColumn("split", F.when(head, "train").otherwise("test")).drop("__rn", "__n")


def filter_overlong(df: DataFrame, max_len: int, length: Column | None = None) -> DataFrame:
    return df.where((word_count(F.col("prompt")) if length is None else length) <= max_len)


def loss_spans(messages: DataFrame, *, conv="conv_id", turn="turn", role="role", text="text", length: Column | None = None):
    """[start, end) of each message in its conversation's tokens; only assistants train."""
    size = word_count(F.col(text)) if length is None else length
    d = messages.withColumn("__len", size)
    d = running(d, [conv], [turn], turn, end=F.col("__len"))
    return d.withColumns(
        {"start": F.col("end") - F.col("__len"), "loss_mask": F.when(F.col(role) == "assistant", 1).otherwise(0)}
    ).drop("__len")


def concat_for_rm(df: DataFrame, max_len: int, pad="") -> DataFrame:
    """prompt + chosen and prompt + rejected, right-cut or padded to max_len, with masks."""
    out = df
    for side in ("chosen", "rejected"):
        ids = F.slice(F.concat("prompt", side), 1, max_len)
        fill = F.lit(max_len) - F.size(ids)
        out = out.withColumns(
            {
                f"{side}_ids": F.concat(ids, F.array_repeat(F.lit(pad), fill)),
                f"{side}_mask": F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), fill)),
            }
        )
    return out


def render_trajectories(messages: DataFrame, finals: DataFrame | None = None, *, conv="conv_id", turn="turn") -> DataFrame:
    """A conversation as one text; the output row holds the whole conversation by design."""
    line = F.concat(F.lit("**"), "role", F.lit("**: "), "text", F.lit("\n\n"))
    g = messages.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn), line.alias("s")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["s"]), "")
    if finals is None:
        return g.select(conv, body.alias("rendered"))
    tail = F.when(F.coalesce("final_answer", F.lit("")) != "", F.concat(F.lit("**Final Answer**: "), "final_answer", F.lit("\n")))
    return g.join(finals, conv, "left").select(conv, F.concat(body, F.coalesce(tail, F.lit(""))).alias("rendered"))


def markdown_sections(df: DataFrame, *, key="doc_id", text="text", max_skills: int | None = None, title_chars: int | None = None, body_chars: int | None = None) -> DataFrame:
    """Skills from headed sections, else from blank-line paragraphs, white space compacted;
    limited only where the caller says so."""
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    marked = F.regexp_replace(F.concat(F.lit("\n"), t), r"\n#{1,6}[ \t]+([^\n]+)", "\n\u0001$1\u0002")
    headed = F.transform(
        F.slice(F.split(marked, "\u0001"), F.lit(2), F.size(F.split(marked, "\u0001"))),
        lambda s: F.struct(
            strip(F.element_at(F.split(s, "\u0002"), 1)).alias("title"), strip(F.element_at(F.split(s, "\u0002"), 2)).alias("body")
        ),
    )
    headed = F.filter(headed, lambda s: s["body"] != "")
    paragraphs = F.filter(F.split(t, r"\n\s*\n"), lambda p: strip(p) != "")
    plain = F.transform(paragraphs, lambda p, i: F.struct(F.format_string("Memory %02d", i + 1).alias("title"), strip(p).alias("body")))
    has = t.rlike(r"(?m)^#{1,6}[ \t]+\S")
    sections = F.when(has, headed).otherwise(plain)
    if max_skills is not None:
        sections = F.slice(sections, 1, max_skills)
    compact = lambda c, n: squeeze(c) if n is None else F.when(F.length(squeeze(c)) > n, F.concat(F.rtrim(F.substring(squeeze(c), 1, n - 3)), F.lit("..."))).otherwise(squeeze(c))
    d = df.select(key, F.posexplode(sections).alias("i", "s"))
    return d.select(key, (F.col("i") + 1).cast("long").alias("ord"), compact(F.col("s.title"), title_chars).alias("title"), compact(F.col("s.body"), body_chars).alias("principle"))


def collapse_generations(df: DataFrame, *, traj="traj_uid", step="step", finished="finished", text="output") -> DataFrame:
    """One row per trajectory: its steps in order with first and last step fields; finished
    steps without text are dropped. The row holds the whole trajectory by design."""
    kept = df.where(~(F.col(finished) & (F.coalesce(F.trim(text), F.lit("")) == "")))
    rest = [c for c in df.columns if c not in (traj, finished)]
    steps = F.array_sort(F.collect_list(F.struct(F.col(step), *[c for c in rest if c != step])))
    g = kept.groupBy(traj).agg(steps.alias("steps"))
    return g.select(
        traj, "steps", F.size("steps").cast("long").alias("num_steps"),
        F.element_at("steps", 1).alias("first"), F.element_at("steps", -1).alias("last"),
    )
