"""Benchmark names, ids, paths, urls and images as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfold.functions.text import strip

# Spellings of one benchmark.
BENCHMARK_ALIASES = {
    "mm_browsecomp": "mmbrowsecomp",
    "mm_browse_comp": "mmbrowsecomp",
    "mmbrowse_comp": "mmbrowsecomp",
    "tir_bench": "tirbench",
    "visual_tool_bench": "visualtoolbench",
    "agent_vista": "agentvista",
}
# Image suffixes kept in a local key.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif"]
# Fixed value: heading of the appended source section.
SOURCE_HEADING = (
    "Source URLs provided by the benchmark. Use the visit tool on these URLs when they are relevant:\n"
)


def normalize_benchmark(c: Column) -> Column:
    name = F.replace(F.lower(strip(c)), F.lit("-"), F.lit("_"))
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_|_$", "")
    out = None
    for k, v in BENCHMARK_ALIASES.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    return out.otherwise(name)


def prefixed_id(doc_id: Column, benchmark: Column) -> Column:
    b, d = normalize_benchmark(benchmark), strip(F.coalesce(doc_id.cast("string"), F.lit("")))
    full = F.concat(b, F.lit("_"), d)
    kept = (d == b) | F.startswith(d, F.concat(b, F.lit("_")))
    return F.when(d == "", b).when(kept, d).otherwise(full)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(c)), "[^a-zA-Z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", "general").otherwise(s)


def flatten_images(single: Column | None = None, many: Column | None = None, structs: Column | None = None) -> Column:
    """One string array from a string, a string array and {image|path|url} structs."""
    parts = []
    if single is not None:
        parts.append(F.when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>")))
    if many is not None:
        parts.append(F.coalesce(many, F.array().cast("array<string>")))
    if structs is not None:
        names = F.transform(structs, lambda s: F.coalesce(s["image"], s["path"], s["url"]))
        parts.append(F.coalesce(names, F.array().cast("array<string>")))
    return F.filter(F.concat(*parts), lambda x: x.isNotNull() & (F.trim(x) != ""))


def repair_path(c: Column, prefixes=("benchmark/", "mm-browsecomp/", "mmbrowsecomp/")) -> Column:
    """Cut to the earliest url or data marker, else strip known folders after './'."""
    p = strip(F.replace(c, F.lit("\\"), F.lit("/")))
    url = r"(?is)((?:https?://|data:image/).*)"
    group = "|".join(x.replace(".", r"\.") for x in prefixes)
    lead = F.regexp_extract(p, r"^([./]*)", 1)
    body = F.regexp_replace(p, rf"(?i)^[./]*(?:(?:{group})[./]*)*(?:{group})", "")
    known = p.rlike(rf"(?i)^[./]*(?:{group})")
    dots = F.regexp_replace(F.regexp_extract(p, rf"(?i)^((?:[./]*(?:{group}))+)", 1), rf"(?i){group}", "")
    return (
        F.when(p.rlike(url), F.regexp_extract(p, url, 1))
        .when(known, F.concat(F.coalesce(dots, lead), body))
        .otherwise(p)
    )


def fix_url(c: Column) -> Column:
    t = strip(c)
    return F.regexp_replace(t, "^(https?):/(?!/)", "$1://")


def url_to_key(c: Column) -> Column:
    """host/dirs/stem_<16 hex of sha256(url)><suffix> for a remote image url."""
    url = fix_url(c)
    host = F.replace(F.regexp_extract(url, r"^https?://([^/?#]*)", 1), F.lit(":"), F.lit("_"))
    host = F.when(host == "", "remote").otherwise(host)
    path = F.try_url_decode(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")
    last = F.regexp_extract(path, "([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(last, r"^.+(\.[^.]+)$", 1))
    stem = F.regexp_replace(last, r"(?<=.)\.[^.]+$", "")
    dirs = F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit(""))
    name = F.concat(
        F.when(stem == "", "image").otherwise(stem), F.lit("_"), F.substring(F.sha2(url, 256), 1, 16),
        F.when(suffix.isin(IMAGE_SUFFIXES), suffix).otherwise(".png"),
    )
    return F.concat_ws("/", host, dirs, name)


def append_source_urls(problem: Column, sources: Column) -> Column:
    """Problem plus a numbered list of the sources its text does not mention yet."""
    text = strip(F.coalesce(problem, F.lit("")))
    clean = F.filter(F.transform(sources, lambda u: strip(u)), lambda u: u != "")
    missing = F.filter(
        F.array_distinct(clean), lambda u: ~F.contains(F.lower(F.coalesce(problem, F.lit(""))), F.lower(u))
    )
    lines = F.array_join(F.transform(missing, lambda u, i: F.concat((i + 1).cast("string"), F.lit(". "), u)), "\n")
    section = F.concat(F.lit(SOURCE_HEADING), lines)
    return (
        F.when(F.coalesce(F.size(clean), F.lit(0)) <= 0, problem)
        .when(F.size(missing) == 0, text)
        .when(text == "", section)
        .otherwise(F.concat(text, F.lit("\n\n"), section))
    )


def align_placeholders(text: Column, n: Column, tag: str = "<image>") -> Column:
    """Exactly n tags: missing ones first if there is none yet, else last; surplus dropped
    from the right."""
    parts = F.split(text, tag)
    have = F.size(parts) - 1
    add = F.array_join(F.array_repeat(F.lit(tag), F.greatest(n - have, F.lit(0)).cast("int")), " ")
    kept = F.array_join(F.slice(parts, F.lit(1), (n + 1).cast("int")), tag)
    rest = F.array_join(F.slice(parts, (n + 2).cast("int"), F.greatest(F.size(parts), F.lit(1))), "")
    return (
        F.when(have == n, text)
        .when(have == 0, F.concat(add, F.lit("\n"), text))
        .when(have < n, F.concat(text, F.lit("\n"), add))
        .otherwise(F.concat(kept, rest))
    )


def truncate_tokens(tokens: Column, max_len: int, side: str = "right", pad=None, pad_left: bool = True) -> Column:
    """Cut a token array (left keeps the tail, right the head, middle both ends); pad if asked."""
    size = F.size(tokens)
    if side == "left":
        cut = F.slice(tokens, F.greatest(size - max_len + 1, F.lit(1)), F.lit(max_len))
    elif side == "right":
        cut = F.slice(tokens, 1, max_len)
    elif side == "middle":
        head = max_len // 2
        tail = max_len - head
        cut = F.concat(F.slice(tokens, 1, head), F.slice(tokens, F.greatest(size - tail + 1, F.lit(1)), F.lit(tail)))
    elif side == "error":
        cut = F.raise_error(F.concat(F.lit(f"more than {max_len} tokens: "), size.cast("string"))).cast("array<string>")
    else:
        raise ValueError(f"unknown truncation side {side!r}")
    out = F.when(size > max_len, cut).otherwise(tokens)
    if pad is None:
        return out
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(max_len) - size, F.lit(0)))
    return F.concat(fill, out) if pad_left else F.concat(out, fill)


def sft_mask(attention: Column, prompt_len: Column, response_len: Column) -> Column:
    """Loss mask of one padded sequence: nothing before the last prompt token, nothing at
    the last valid position."""
    last = F.least(prompt_len + response_len, F.size(attention)) - 1
    return F.transform(
        attention,
        lambda m, i: F.when((prompt_len > 1) & (i < prompt_len - 1), 0).when(i == last, 0).otherwise(m),
    )
