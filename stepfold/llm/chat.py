"""Chat formatting: canonical turns from heterogeneous layouts, then one reversible template.

A layout is recognised by its schema fingerprint: a hash over the sorted nested field paths
that any layout knows. Each fingerprint selects a declarative mapping to turns (conv_id,
turn, role, text). Tables use their schema, JSON records each their own.

Template. A turn is ``<s>`` role ``[INST]`` text ``[/INST]</s>``. Where a role or text holds
one of these control strings, a backslash goes in after its first character, and one more
where it has some there already; reading back takes one away. Loss is taken on the texts of
assistant turns, as a span of code points in the formatted turn.

Null roles and texts are empty. Turns are ordered by turn (null first), then role and text,
so ties and repeated rows have one order and are all kept. Null conv_ids are one
conversation. Further columns are ignored. A conversation is never held whole: its turns
pass one by one, sorted, through running digests.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.llm.base import small_batches

BEGIN, TEXT, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: A control string, with any backslashes after its first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
TURN = re.compile(r"<s>(.*?)\[INST\](.*)\[/INST\]</s>", re.S)
LEARNED = "assistant"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``each``: (list, role field, text field) for one turn per element; ``fixed``: (role,
    path) for one turn per non-null field, in order; ``rows``: a table of turns; ``parts``: the
    text field is a list of parts, whose texts are joined by line ends (other parts: [type])."""

    name: str
    paths: tuple[str, ...]
    key: str
    each: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str] | None = None
    parts: bool = False


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), "conv_id", rows=("turn", "role", "text")),
    Layout("messages", ("id", "messages[].role", "messages[].content"), "id", each=("messages", "role", "content")),
    Layout("messages in parts", ("id", "messages[].role", "messages[].content[].type", "messages[].content[].text"), "id", each=("messages", "role", "content"), parts=True),
    Layout("exchanges", ("id", "conversations[].from", "conversations[].value"), "id", each=("conversations", "from", "value")),
    Layout("instruction with input", ("id", "instruction", "input", "output"), "id", fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", ("id", "instruction", "output"), "id", fixed=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt with system", ("id", "system", "prompt", "response"), "id", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt", ("id", "prompt", "response"), "id", fixed=(("user", "prompt"), ("assistant", "response"))),
)
KNOWN = frozenset(p for layout in LAYOUTS for p in layout.paths)


def fingerprint(paths) -> str:
    """Hash of the nested field paths that some layout knows."""
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def record_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, f"{at}[]")}
    return {at}


def layout_of(paths) -> Layout | None:
    """The mapping of a fingerprint. Where fields of several layouts stand together, the one
    that explains most of them."""
    paths = set(paths)
    exact = MAPPINGS.get(fingerprint(paths))
    fits = [layout for layout in LAYOUTS if paths.issuperset(layout.paths)]
    return exact or max(fits, key=lambda layout: len(layout.paths), default=None)


def _role(role: Column) -> Column:
    out = role
    for name, plain in ROLE_NAMES.items():
        out = F.when(role == name, plain).otherwise(out)
    return out


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id (string unless the layout is turn rows), turn, role, text of a known layout."""
    layout = layout_of(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(schema_paths(df.schema))}")
    key = F.col(layout.key)
    if layout.rows:
        turn, role, text = layout.rows
        return df.select(key.alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    if layout.each:
        name, role, text = layout.each
        said = F.col("m")[text]
        if layout.parts:
            said = F.array_join(F.transform(said, lambda p: F.coalesce(p["text"], F.concat(F.lit("["), p["type"], F.lit("]")), F.lit(""))), "\n")
        one = df.select(key.cast("string").alias("conv_id"), F.posexplode(name).alias("turn", "m"))
        return one.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("m")[role]).alias("role"), said.alias("text"))
    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.col(p).cast("string").alias("text")) for i, (r, p) in enumerate(layout.fixed)])
    one = df.select(key.cast("string").alias("conv_id"), F.inline(turns))
    return one.where(F.col("text").isNotNull())


def plain_text(value) -> str | None:
    """A JSON value as a text: parts by their texts, anything that is no text as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list) and value and all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in value):
        return "\n".join(p["text"] if isinstance(p.get("text"), str) else f"[{p['type']}]" for p in value)
    return json.dumps(value, ensure_ascii=False)


def record_turns(record: dict) -> list[tuple[int, str, str]] | None:
    """Turns of one JSON record, None if no layout fits."""
    layout = layout_of(record_paths(record))
    if layout is None:
        return None
    if layout.rows:
        turn, role, text = layout.rows
        place = record[turn]
        if place is not None and (isinstance(place, bool) or not isinstance(place, int) or abs(place) >= 1 << 63):
            raise ValueError("a turn is not a number")
        return [(place, plain_text(record[role]), plain_text(record[text]))]
    if layout.each:
        name, role, text = layout.each
        if not all(isinstance(m, dict) for m in record[name]):
            raise ValueError("a message is not an object")
        said = [(plain_text(m.get(role)), plain_text(m.get(text))) for m in record[name]]
        return [(i, ROLE_NAMES.get(r, r), x) for i, (r, x) in enumerate(said)]
    return [(i, role, plain_text(record[path])) for i, (role, path) in enumerate(layout.fixed) if record[path] is not None]


def json_turns(df: DataFrame, column: str = "json") -> DataFrame:
    """conv_id (string), turn, role, text of JSON records, each by its own fingerprint.

    Records that are null, not an object, of no known layout or with a value where it has no
    place give one turn -1 with role ``unreadable`` and the record as text, with the id if there is
    one, so that none is lost and none stops the job.
    """
    schema = "conv_id string, turn long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line in batch.column(column).to_pylist():
                record, turns = None, None
                try:
                    record = json.loads(line)
                    turns = record_turns(record) if isinstance(record, dict) else None
                except (TypeError, ValueError, KeyError, AttributeError, RecursionError):
                    pass
                key = record.get("conv_id", record.get("id")) if isinstance(record, dict) else None
                key = None if key is None else str(key)
                rows += [(key, *t) for t in turns] if turns else [(key, -1, "unreadable", line)]
            # lone surrogates, which JSON may spell, are no text
            rows = [tuple(x.encode("utf-8", "replace").decode() if isinstance(x, str) else x for x in r) for r in rows]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "turn", "role", "text"])

    return df.select(column).mapInArrow(run, schema)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(CONTROL, lambda m: m[1] + m[2][1:] + m[3], text)


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with formatted and the loss span of it (loss_start, loss_length code points)."""
    role, text = (escape(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    turns = turns.withColumns({"__r": role, "__t": text})
    formatted = F.concat(F.lit(BEGIN), "__r", F.lit(TEXT), "__t", F.lit(CLOSE + END))
    learned = F.coalesce(F.col("role") == LEARNED, F.lit(False))
    return turns.withColumns({
        "formatted": formatted,
        "loss_start": F.length("__r") + len(BEGIN) + len(TEXT),
        "loss_length": F.when(learned, F.length("__t")).otherwise(0),
    }).drop("__r", "__t")


def read_back(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back from its formatted turns, with running digests."""
    small_batches(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, T.StringType() if n.endswith("256") else T.LongType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, conv_type = None, None, None

        def cut(rows: list) -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def row() -> tuple:
            n, turns, chars, loss, size = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            conv_type, rows = batch.column("conv_id").type, []
            for conv, text, start, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length"))):
                if state is None or conv != key:
                    if state is not None:
                        rows.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = read_back(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                learned = unescape(text[start : start + length])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(text)
            if rows:
                yield cut(rows)
        if state is not None:
            yield cut([row()])

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(run, schema)
