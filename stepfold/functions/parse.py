"""Actions, tool calls, transcripts and generated payloads as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.text import first_match, let, strip

# Characters kept of an action without tags, per environment family.
TAIL_CHARS = {"household": 30, "shop": 20, "code": 100}
# Tool names known to the event reader.
KNOWN_TOOLS = ["web_search", "image_search", "visit", "code_interpreter", "zoom"]
# Text cuts of transcript steps, for callers that build prompts of bounded length.
PROMPT_CUTS = {"observation": 800, "action": 1500, "output": 2000, "fallback": 3000, "task": 1000}


def project_tagged_action(c: Column, family: str, tag: str | None = None) -> Column:
    """Struct (action, valid): text between the first opening and first closing tag."""
    tag = tag or ("code" if family == "code" else "action")
    text = c if family == "code" else F.lower(c)
    start, end = F.instr(text, f"<{tag}>"), F.instr(text, f"</{tag}>")
    found = (start > 0) & (end > 0)
    body_at = start + len(tag) + 2
    body = F.when(end > body_at, F.substring(text, body_at, end - body_at)).otherwise("")
    if family != "code":
        body = F.lower(strip(body))
    action = F.when(found, body).otherwise(F.right(text, F.lit(TAIL_CHARS[family])))
    valid = found & F.contains(c, F.lit("<think>")) & F.contains(c, F.lit("</think>"))
    if family != "code":
        valid = valid & ~c.rlike("[一-鿿]")
    return F.struct(action.alias("action"), valid.alias("valid"))


def project_search_action(c: Column) -> Column:
    """Struct (action, valid): first search block, else first answer block, else ''."""
    cut = F.coalesce(
        first_match(c, r"(?s)\A(.*?</search>)"), first_match(c, r"(?s)\A(.*?</answer>)"), c
    )
    search = first_match(cut, r"(?is)<search>(.*?)</search>")
    answer = first_match(cut, r"(?is)<answer>(.*?)</answer>")
    action = (
        F.when(search.isNotNull(), F.concat(F.lit("<search>"), strip(search), F.lit("</search>")))
        .when(answer.isNotNull(), F.concat(F.lit("<answer>"), strip(answer), F.lit("</answer>")))
        .otherwise("")
    )
    n_search = F.regexp_count(c, F.lit("(?i)<search>"))
    n_answer = F.regexp_count(c, F.lit("(?i)<answer>"))
    valid = (search.isNotNull() | answer.isNotNull()) & (n_search + n_answer <= 1)
    return F.struct(action.alias("action"), valid.alias("valid"))


# The forms in which models write tool calls.
PAYLOAD = "name string, tool_name string, tool string, arguments string, parameters string, args string"
CALL_FORMS = [
    r"(?is)<tool_call\b[^>]*>(.*?)</tool_call>",
    r"(?is)<tool\b[^>]*>(.*?)</tool>",
    r"(?is)<function_calls\b[^>]*>(.*?)</function_calls>",
    r'(?is)```(?:json)?\s*(\{.*?"(?:name|tool_name|tool)".*?\})\s*```',
]
XML_NAME = r"(?is)<function(?:=|\s+name=[\"']?)([A-Za-z_][\w.-]*)[\"']?\s*>(.*?)</function>"
XML_PARAM = r"(?is)<parameter(?:=|\s+name=[\"']?)([A-Za-z_][\w.-]*)[\"']?\s*>(.*?)</parameter>"
ACTION_FORM = r"(?s)Action\s*:\s*([a-zA-Z_]\w*)\s*(?:\((.*?)\)|(\{.*?\}))"


def extract_tool_calls(df: DataFrame, text: str = "text") -> DataFrame:
    """Add type, name, arguments (MAP) and content for the first call of each turn.

    type is tool_call, answer, text, or error for a payload that is not a JSON object with
    a name; such rows are kept.
    """
    c = F.col(text)
    d = df.withColumns(
        {
            "__payload": F.coalesce(*[first_match(c, p) for p in CALL_FORMS]),
            "__answer": first_match(c, r"(?is)<answer>(.*?)</answer>"),
        }
    )
    body = F.coalesce("__payload", c)
    d = d.withColumns(
        {
            "__json": F.from_json("__payload", PAYLOAD, {"allowSingleQuotes": "true"}),
            "__xml": first_match(body, XML_NAME),
            "__xml_body": first_match(body, XML_NAME, 2),
            "__act": first_match(c, ACTION_FORM),
        }
    )
    d = d.withColumn(
        "__act_args",
        F.concat(F.regexp_extract(c, ACTION_FORM, 2), F.regexp_extract(c, ACTION_FORM, 3)),
    )
    json_name = F.coalesce("__json.name", "__json.tool_name", "__json.tool")
    json_args = F.coalesce("__json.arguments", "__json.parameters", "__json.args", F.lit("{}"))
    kind = (
        F.when(F.col("__xml").isNotNull() & F.col("__answer").isNull(), "tool_call")
        .when(F.col("__payload").isNotNull(), F.when(json_name.isNotNull(), "tool_call").otherwise("error"))
        .when(F.col("__answer").isNotNull(), "answer")
        .when(F.col("__act").isNotNull(), "tool_call")
        .otherwise("text")
    )
    as_map = lambda s: F.coalesce(F.from_json(s, "map<string,string>"), F.create_map(F.lit("query"), s))
    xml_args = F.map_from_arrays(
        F.regexp_extract_all("__xml_body", F.lit(XML_PARAM), 1),
        F.transform(F.regexp_extract_all("__xml_body", F.lit(XML_PARAM), 2), strip),
    )
    args = (
        F.when(F.col("__xml").isNotNull(), xml_args)
        .when(F.col("__payload").isNotNull(), as_map(json_args))
        .when(F.col("__act").isNotNull(), as_map(F.coalesce(F.nullif("__act_args", F.lit("")), F.lit("{}"))))
    )
    name = F.coalesce("__xml", F.when(F.col("__payload").isNotNull(), json_name).otherwise(F.col("__act")))
    content = F.when(kind == "answer", strip(F.col("__answer"))).when(kind == "text", c).when(
        kind == "error", F.col("__payload")
    )
    is_call = kind == "tool_call"
    d = d.withColumns(
        {
            "type": kind,
            "name": F.when(is_call, name),
            "arguments": F.when(is_call, args),
            "content": content,
        }
    )
    return d.drop("__payload", "__answer", "__json", "__xml", "__xml_body", "__act", "__act_args")


def event_tool_name(raw: Column, text_mentions: bool = False) -> Column:
    """Tool named by a JSON event: known flat name, nested call, first response call."""
    named = "struct<tool_name:string,name:string,tool:string>"
    event = F.from_json(
        raw,
        f"tool_name string, name string, tool_call {named}, tool_error {named}, function_call {named}, "
        "response struct<tool_calls:array<struct<function:struct<name:string>>>>",
    )

    def pick(e: Column) -> Column:
        filled = lambda c: F.nullif(c, F.lit(""))
        options = [F.when(e[k].isin(KNOWN_TOOLS), e[k]) for k in ("tool_name", "name")]
        options += [filled(e[box][k]) for box in ("tool_call", "tool_error", "function_call") for k in ("tool_name", "name", "tool")]
        options.append(filled(F.try_element_at(e["response"]["tool_calls"], F.lit(1))["function"]["name"]))
        if text_mentions:
            options += [F.when(F.contains(F.lower(raw), F.lit(t)), t) for t in KNOWN_TOOLS]
        return F.coalesce(*options)

    return let(event, pick)


def _cut(c: Column, n: int | None) -> Column:
    return c if n is None else F.substring(c, 1, n)


def task_description(c: Column, cut: int | None = None) -> Column:
    """The task line of a prompt, else its first user turn, else all of it; ``cut``: characters kept."""
    line = [
        r"(?i)(?:Your task is to|Task:|task is to|you need to)[:\s]+(.*?)(?:\n|\z)",
        r"(?i)(?:goal|objective)[:\s]+(.*?)(?:\n|\z)",
    ]
    found = [_cut(strip(first_match(c, p)), cut) for p in line]
    for marker in ("<|im_start|>user\n", "\nHuman: ", "\nUser: "):
        at = F.instr(c, marker)
        found.append(F.when(at > 0, _cut(F.substring(c, at + len(marker), F.length(c)), cut)))
    return F.coalesce(*found, _cut(c, cut))


def steps_from_transcripts(df: DataFrame, prompt: str = "prompt", output: str = "output", cuts: Mapping[str, int] | None = None) -> DataFrame:
    """One row per step (step, observation, action); the output is the last action. ``cuts``:
    characters kept of each part, as in ``PROMPT_CUTS``; none by default."""
    c, cuts = F.col(prompt), cuts or {}

    def turns(user: str, assistant: str) -> Column:
        obs = F.regexp_extract_all(c, F.lit(user), 1)
        act = F.regexp_extract_all(c, F.lit(assistant), 1)
        pairs = F.slice(F.arrays_zip(obs.alias("o"), act.alias("a")), F.lit(1), F.least(F.size(obs), F.size(act)))
        cut = F.transform(
            pairs,
            lambda p: F.struct(
                _cut(strip(p["o"]), cuts.get("observation")).alias("observation"),
                _cut(strip(p["a"]), cuts.get("action")).alias("action"),
            ),
        )
        return F.when((F.size(obs) > 0) & (F.size(act) > 0), cut)

    chatml = turns(r"(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>", r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>")
    ahead = r"(?=(?:Human|User|Assistant):|\z)"
    named = turns(r"(?is)(?:Human|User):\s*(.*?)" + ahead, r"(?is)Assistant:\s*(.*?)" + ahead)
    head = F.struct(_cut(c, cuts.get("fallback")).alias("observation"), F.lit("").alias("action"))
    last = F.struct(F.lit("").alias("observation"), _cut(F.col(output), cuts.get("output")).alias("action"))
    steps = F.concat(F.coalesce(chatml, named, F.array(head)), F.array(last))
    rest = [F.col(x) for x in df.columns if x not in (prompt, output)]
    d = df.select(*rest, F.posexplode(steps).alias("__i", "__s"))
    return d.select(*rest, (F.col("__i") + 1).cast("long").alias("step"), "__s.observation", "__s.action")


def format_passages(docs: Column) -> Column:
    """'Doc i (Title: t)' blocks; the title is a passage's first line."""
    line = F.transform(
        docs,
        lambda d, i: F.concat(
            F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "),
            F.element_at(F.split(d, "\n"), 1), F.lit(")\n"),
            F.array_join(F.slice(F.split(d, "\n"), F.lit(2), F.size(F.split(d, "\n"))), "\n"),
        ),
    )
    return strip(F.array_join(line, "\n\n"))
