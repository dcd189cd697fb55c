"""Chat records of different layouts, as canonical turns and as formatted training text.

A record's fingerprint is the hash of the nested field paths it fills, as far as some mapping knows
them. It selects a declarative mapping: which field speaks for which role, or which list of messages
holds role and text. Canonical turns are ``array<struct<role, text>>``.

The template marks a turn as ``<|im_start|>role LF text <|im_end|> LF``. Control strings inside
roles and texts, of this and of other common templates, get a backslash after their first character,
and backslashes are doubled, so that the formatted text splits at real marks only and every turn can
be read back unchanged. The formatted text comes as segments with a loss flag: true for exactly the
texts of assistant turns.

Defined cases: a missing text or role is empty; repeated rows are turns of their own; turns that
share a number are ordered by role and text; a record no mapping knows has null ``turns`` and its
fingerprint; an empty table gives an empty result; fields that no mapping names are ignored. A
conversation is one output value, so it must fit into one row (2 GB), however many rows it has.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelflow.llm.common import let


@dataclass(frozen=True)
class Mapping:
    """``turns``: role and field path in order. ``messages``: list field, role field, text field.
    Paths in ``optional`` may be unfilled; their turn is left out."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    appended: tuple[tuple[str, str], ...] = ()  # (path, to the turn of path)

    def paths(self) -> list[str]:
        out = [path for _, path in self.turns] + [path for path, _ in self.appended]
        if self.messages:
            many, role, text = self.messages
            out += [f"{many}[].{role}", f"{many}[].{text}"]
        return out

    def fingerprints(self) -> list[str]:
        """Every set of filled paths that this mapping takes, as sorted text."""
        must = [p for p in self.paths() if p not in self.optional]
        return [",".join(sorted([*must, *some])) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]


MAPPINGS = (
    Mapping("messages", messages=("messages", "role", "content")),
    Mapping("shared_chat", messages=("conversations", "from", "value")),
    Mapping("prompt", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", turns=(("system", "system"), ("user", "instruction"), ("assistant", "output")),
            appended=(("input", "instruction"),), optional=("system", "input")),
    Mapping("question", turns=(("user", "question"), ("assistant", "answer"))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# fixed values: marks of common chat templates
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|" else c for c in text)


def _filled(schema: T.StructType, record: str) -> dict[str, Column]:
    """Nested field paths with the condition that a record fills them. Paths through a list are
    filled when the list is there."""
    out: dict[str, Column] = {}

    def walk(kind: T.DataType, path: str, at: Column, given: Column) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                here = at[f.name] if at is not None else None
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, here, given if here is None else here.isNotNull())
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path + "[]", None, given)
        else:
            out[path] = given

    walk(schema, "", F.col(record), F.col(record).isNotNull())
    return out


def fingerprint(schema: T.StructType, record: str, mappings=MAPPINGS) -> Column:
    """Hash of the filled paths that some mapping names."""
    known = {p for m in mappings for p in m.paths()}
    filled = {p: c for p, c in _filled(schema, record).items() if p in known}
    marks = [F.when(filled[p], F.lit(p)) for p in sorted(filled)]
    return F.xxhash64(F.array_join(F.array(*marks) if marks else F.array().cast("array<string>"), ","))


def _turns(m: Mapping, schema: T.StructType, record: Column) -> Column | None:
    """The mapping as an expression, or None when the records lack one of its fields."""
    fields = set(_filled(schema, "x"))
    if any(p not in fields for p in m.paths() if p not in m.optional):
        return None
    known_role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def turn(role: Column, text: Column) -> Column:
        role = F.coalesce(role.cast("string"), F.lit(""))
        return F.struct(F.coalesce(F.try_element_at(known_role, role), role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    if m.messages:
        many, role, text = m.messages
        return F.transform(record[many], lambda x: turn(x[role], x[text]))
    out = []
    for role, path in m.turns:
        if path not in fields:
            continue
        text = record[path]
        for more, to in m.appended:
            if to == path and more in fields:
                text = F.concat_ws("\n\n", text, record[more])
        out.append(F.when(record[path].isNotNull(), turn(F.lit(role), text)))
    return F.filter(F.array(*out), lambda t: t.isNotNull())


def canonical_turns(df: DataFrame, record: str, mappings=MAPPINGS) -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` and ``turns`` of its struct column ``record``."""
    schema = df.schema[record].dataType
    mark = F.col("fingerprint")
    turns, layout = F.lit(None), F.lit(None)
    for m in reversed(mappings):
        made = _turns(m, schema, F.col(record))
        if made is not None:
            hit = mark.isin([F.xxhash64(F.lit(p)) for p in m.fingerprints()])
            turns, layout = F.when(hit, made).otherwise(turns), F.when(hit, F.lit(m.name)).otherwise(layout)
    marked = df.withColumn("fingerprint", fingerprint(schema, record, mappings))
    return marked.withColumns({"layout": layout.cast("string"), "turns": turns.cast("array<struct<role:string,text:string>>")})


def escaped(text: Column) -> Column:
    first: dict[str, list[str]] = {}
    for c in CONTROL:
        first.setdefault(c[0], []).append(_quoted(c[1:]))
    marks = "|".join(f"{_quoted(a)}(?={'|'.join(rest)})" for a, rest in first.items())
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, marks, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(turns: Column) -> Column:
    """The formatted conversation in order, cut where the loss mask changes."""
    def of(t: Column) -> Column:
        role = F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\\n"))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(TURN_OPEN), role, F.lit("\n")), F.lit(False)),
            part(escaped(t["text"]), t["role"] == LEARNED_ROLE),
            part(F.lit(TURN_CLOSE), F.lit(False)))

    return F.flatten(F.transform(turns, of))


def formatted(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def learned(parts: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def parsed(text: Column) -> Column:
    """Turns read back from formatted text."""
    role_end = r"^([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)\n"

    def of(body: Column) -> Column:
        return let(F.regexp_extract(body, role_end, 1), lambda role: F.struct(
            unescaped(role).alias("role"), unescaped(F.substr(body, F.length(role) + 2)).alias("text")))

    def turns(p: Column) -> Column:
        return F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda t: let(
            F.substr(t, F.lit(len(TURN_OPEN) + 1)), of))

    return let(F.split(text, _quoted(TURN_CLOSE)), turns)


def format_chats(df: DataFrame, record: str, mappings=MAPPINGS) -> DataFrame:
    """``df`` with ``fingerprint``, ``layout``, ``turns`` and ``segments``."""
    return canonical_turns(df, record, mappings).withColumn("segments", segments(F.col("turns")))


def records(conversations: DataFrame) -> DataFrame:
    """Rows by turn as one record per conversation, in the layout that suits it: a single exchange
    as prompt and response, one under a system text as an instruction, the rest as messages."""
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    roles = F.transform("m", lambda t: t["role"])
    full = F.forall("m", lambda t: t["text"].isNotNull())
    text = lambda i: F.get("m", F.lit(i))["text"]
    single = full & (roles == F.array(F.lit("user"), F.lit("assistant")))
    under = full & (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")))
    plain = F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return rows.withColumns({"_single": F.coalesce(single, F.lit(False)), "_under": F.coalesce(under, F.lit(False))}).select(
        "conv_id", F.struct(
            F.when(F.col("_under"), text(0)).alias("system"),
            F.when(F.col("_single"), text(0)).alias("prompt"), F.when(F.col("_single"), text(1)).alias("response"),
            F.when(F.col("_under"), text(1)).alias("instruction"), F.when(F.col("_under"), text(2)).alias("output"),
            F.when(~F.col("_single") & ~F.col("_under"), plain).alias("messages")).alias("record"))
