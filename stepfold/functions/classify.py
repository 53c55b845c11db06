"""Keyword and marker rules over text columns: failures, tool errors, task categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfold.functions.text import any_marker

# Failure labels and their markers, in order of precedence.
FAILURE_MARKERS = [
    ("image_missing", ["image not found", "no images found", "failed to load image", "filenotfounderror"]),
    ("max_tokens", ["max token", "maximum context", "longer than the maximum model length"]),
    ("api_timeout_or_network", ["all api attempts failed", "api attempts failed", "api timeout",
                                "connection reset", "network"]),
    ("max_turns", ["reached max turns", "without a definitive answer"]),
    ("tool_error", ["tool_error", "received valid output (type: error)", "tool call failed"]),
    ("verifier_error", ["evaluation failed", "verifier", "judge"]),
    ("parse_error", ["could not parse model response", "failed to parse model response"]),
    ("error_final_answer", ['final_answer": "error', "error:"]),
]

# Tool error labels and their markers, in order of precedence. A missing tool
# is reported as "not found" and so counts as http_404.
TOOL_ERROR_MARKERS = [
    ("http_403", ["403", "forbidden"]),
    ("http_404", ["404", "not found"]),
    ("http_429", ["429", "too many requests", "rate limit"]),
    ("timeout", ["timed out", "timeout"]),
    ("network_unreachable", ["network is unreachable"]),
    ("connection_reset", ["connection reset", "connection aborted"]),
    ("connection_refused", ["connection refused"]),
    ("proxy_error", ["proxyerror", "proxy error"]),
    ("ssl_error", ["ssl", "certificate"]),
    ("other_error", ["error"]),
]

# Household categories in order (an "and" of words, or an "or" of words).
HOUSEHOLD = [
    ("look_at_obj_in_light", "all", ["look at", "under"]),
    ("clean", "any", ["clean"]),
    ("heat", "any", ["heat"]),
    ("cool", "any", ["cool"]),
    ("examine", "any", ["examine", "find"]),
]

# Shopping categories used when retrieving skills.
SHOPPING = [
    ("apparel", ["shirt", "dress", "jacket", "pant", "coat", "sweater", "blouse", "clothing",
                 "clothes", "t-shirt"]),
    ("footwear", ["shoe", "boot", "sneaker", "sandal", "heel", "slipper", "footwear"]),
    ("electronics", ["laptop", "phone", "computer", "tablet", "charger", "cable", "headphone",
                     "speaker", "camera", "electronic"]),
    ("accessories", ["necklace", "ring", "bracelet", "earring", "watch", "jewelry", "bag", "purse",
                     "wallet"]),
    ("home_decor", ["furniture", "lamp", "curtain", "pillow", "bedding", "decor", "candle", "vase",
                    "rug"]),
    ("beauty_health", ["cream", "lotion", "shampoo", "conditioner", "moisturizer", "serum", "makeup",
                       "beauty", "vitamin", "supplement"]),
]

# Shopping categories used when categorising memories.
SHOPPING_MEMORIES = [
    ("apparel", ["shirt", "dress", "t-shirt", "polo", "pants", "jeans", "jacket", "coat", "sweater",
                 "blouse", "skirt", "shorts", "underwear", "swimsuit", "swimwear", "hoodie", "vest",
                 "cardigan", "suit", "blazer", "tee", "top"]),
    ("footwear", ["shoe", "boot", "sandal", "sneaker", "slipper", "loafer", "heel", "flat", "oxford",
                  "pump", "moccasin", "flip-flop", "footwear"]),
    ("home_decor", ["pillow", "curtain", "rug", "mat", "blanket", "bedding", "towel", "lamp", "decor",
                    "furniture", "cushion", "sheet", "tablecloth", "vase"]),
    ("electronics", ["phone", "laptop", "tablet", "computer", "headphone", "earphone", "speaker",
                     "charger", "cable", "mouse", "keyboard", "monitor", "camera", "watch",
                     "smartwatch", "electronic", "device", "gadget", "armoires"]),
    ("accessories", ["bag", "wallet", "belt", "hat", "cap", "scarf", "glove", "jewelry", "necklace",
                     "bracelet", "ring", "earring", "sunglasses", "glasses", "watch", "purse",
                     "backpack", "handbag", "tie", "bow"]),
    ("beauty_health", ["makeup", "cosmetic", "skincare", "lotion", "cream", "shampoo", "conditioner",
                       "perfume", "cologne", "brush", "bathing", "soap", "body wash", "nail",
                       "lipstick", "mascara", "foundation", "serum", "moisturizer"]),
]

# Search families.
MULTI_HOP_SOURCES = ["hotpotqa", "2wikimultihopqa", "musique", "bamboogle"]
COMPARISON_WORDS = ["both", "are the", "which of", "same", "common", "more", "less", "older",
                    "younger", "taller", "shorter"]

# Action words of the planning pattern, in order of precedence.
PLAN_WORDS = [
    ("Navigate", ["go to", "navigate"]),
    ("Acquire", ["take", "pick", "grab"]),
    ("Place", ["put", "place", "move"]),
    ("Open", ["open"]),
    ("Use", ["use", "turn on"]),
    ("Search", ["search", "look", "examine"]),
]

# Mistake messages.
REPEATED = "Repeated the same action multiple times without making progress"
WANDERED = "Spent too much time wandering between locations without taking productive actions"
STOPPED = "Task requires finding two objects but stopped searching too early after %s steps"
GENERIC = "Failed to complete task: %s. Consider different approach."

# Base colours, first one contained wins.
COLORS = [
    "alabaster", "apricot", "aqua", "ash", "asphalt", "azure", "banana", "beige", "black", "blue", "blush",
    "bordeaux", "bronze", "brown", "burgundy", "camel", "camo", "caramel", "champagne", "charcoal", "cheetah",
    "chestnut", "chocolate", "christmas", "coffee", "cognac", "copper", "coral", "cranberry", "cream", "crystal",
    "dark", "denim", "eggplant", "elephant", "espresso", "fuchsia", "gold", "granite", "grape", "graphite", "grass",
    "gray", "green", "grey", "heather", "indigo", "ivory", "ivy", "khaki", "lavender", "lemon", "leopard", "light",
    "lilac", "lime", "magenta", "maroon", "mauve", "merlot", "midnight", "mint", "mocha", "multicolor", "mushroom",
    "mustard", "natural", "navy", "nude", "olive", "orange", "peach", "pewter", "pink", "plum", "purple", "rainbow",
    "red", "rose", "royal", "rust", "sand", "sapphire", "seashell", "silver", "skull", "slate", "steel", "stone",
    "stonewash", "sunflower", "tan", "taupe", "teal", "tiger", "turquoise", "violet", "walnut", "wheat", "white",
    "wine", "yellow",
]

# Size patterns, first one found wins.
SIZES = [
    "xx-large", "3x-large", "4x-large", "5x-large", "x-large", "x-small", "medium", "large", "small",
    "queen", "twin", "full", "king", "one size", "pack",
    r"(.*)neck(.*)sleeve", r"(.*) women \| (.*) men", r"(.*)w x(.*)l", r"(.*)w by (.*)l",
    r"(.*)w x(.*)h", r"(.*)wide", r"(.*)x-wide", r"(.*)narrow", r"(.*)petite", r"(.*)inch",
    r"(.*)plus", r"(.*)mm", r"women(.*)", r"(.*)x(.*)", r"(.*)ft", r"(.*)feet", r"(.*)meter",
    r"(.*)yards", r"(.*)\*(.*)", r"(.*)\-(.*)", r'(\d+)"$', r"(\d+)f$", r"(\d+)m$", r"(\d+)cm$",
    r"(\d+)g$",
]


def first_label(c: Column, rules: Sequence[tuple[str, list[str]]], default: str | None) -> Column:
    out = None
    for label, words in rules:
        hit = any_marker(c, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def classify_tool_error(c: Column) -> Column:
    return first_label(F.lower(F.coalesce(c, F.lit(""))), TOOL_ERROR_MARKERS, "unknown_error")


def classify_failure(error: Column, final_answer: Column, analysis: Column, snippet: Column) -> Column:
    """Terminal fields decide first; the trajectory snippet only afterwards."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    answer = clean(final_answer)
    parts = F.filter(F.array(clean(error), answer, clean(analysis)), lambda p: p != "")
    primary = F.array_join(parts, " ")
    text = F.concat(primary, F.lit(" "), F.lower(F.coalesce(snippet, F.lit(""))))
    later = [(n, m) for n, m in FAILURE_MARKERS if n != "parse_error"]
    terminal = first_label(primary, FAILURE_MARKERS, None)
    from_text = first_label(text, later, None)
    return (
        F.when(terminal.isNotNull(), terminal)
        .when((answer != "") & ~answer.startswith("error:"), "incorrect_answer")
        .when(from_text.isNotNull(), from_text)
        .when(F.contains(primary, F.lit("error")), "other_error")
        .otherwise("incorrect_answer")
    )


def classify_household(c: Column, default: str | None = "pick_and_place") -> Column:
    """Retrieval form by default; pass None to require "put" and leave the rest unknown."""
    goal = F.lower(c)
    out = None
    for label, mode, words in HOUSEHOLD:
        hit = any_marker(goal, words)
        if mode == "all":
            hit = F.lit(True)
            for w in words:
                hit = hit & F.contains(goal, F.lit(w))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    if default is None:
        return out.when(F.contains(goal, F.lit("put")), "pick_and_place")
    return out.otherwise(default)


def classify_shopping(c: Column, memories: bool = False) -> Column:
    return first_label(F.lower(c), SHOPPING_MEMORIES if memories else SHOPPING, "other")


def classify_search(goal: Column, source: Column) -> Column:
    compare = any_marker(F.lower(goal), COMPARISON_WORDS)
    return (
        F.when(source.isin(MULTI_HOP_SOURCES) & compare, "comparison")
        .when(source.isin(MULTI_HOP_SOURCES), "multi_hop_reasoning")
        .when(source == "popqa", "entity_attribute_lookup")
        .otherwise("direct_retrieval")
    )


def action_kind(c: Column) -> Column:
    return first_label(F.lower(c), PLAN_WORDS, None)


def planning_pattern(actions: Column) -> Column:
    kinds = F.array_distinct(F.array_compact(F.transform(actions, action_kind)))
    return F.when(F.size(kinds) > 0, F.array_join(kinds, " → ")).otherwise("Unknown pattern")


def mistakes(n: Column, distinct: Column, go_to: Column, task: Column) -> Column:
    """Mistake messages of a failed trajectory from its action counts."""
    found = F.array_compact(
        F.array(
            F.when(n != distinct, REPEATED),
            F.when(go_to > n * 0.5, WANDERED),
            F.when(F.contains(F.lower(task), F.lit("two")) & (n < 5), F.format_string(STOPPED, n.cast("string"))),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.format_string(GENERIC, task)))


def normalize_color(c: Column, default: Column | None = None) -> Column:
    found = F.filter(F.array(*[F.lit(x) for x in COLORS]), lambda b: F.contains(c, b))
    other = c if default is None else default
    return F.when(c.rlike("|".join(COLORS)), F.try_element_at(found, F.lit(1))).otherwise(other)


def normalize_size(c: Column) -> Column:
    out = None
    for p in SIZES:
        hit = c.rlike(p)
        out = F.when(hit, p) if out is None else out.when(hit, p)
    numeric = F.replace(c, F.lit("."), F.lit("")).rlike(r"^\d+$") & ~c.rlike(r"\..*\.")
    return out.when(numeric, "numeric_size").otherwise("not_matched")


def parse_price(c: Column) -> Column:
    """At most two dollar amounts as doubles; [100.0] when there is none."""
    amounts = F.slice(F.split(c, r"\$"), 2, 2)
    values = F.transform(amounts, lambda x: F.regexp_replace(x, r"[^\d.]", "").try_cast("double"))
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(100.0)))
