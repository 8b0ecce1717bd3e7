"""Canonical chat turns from heterogeneous records, by schema fingerprints.

A record is a JSON text. Its schema, read off by Spark, is reduced to its set
of nested field paths, such as ``messages[].role``; the hash of the sorted
paths is the record's fingerprint. The fingerprint selects the first declared
mapping one of whose sets of required paths is all there, and the mapping says where the
turns, their roles and their contents lie. Records of one fingerprint have one
mapping, so the choice is worked out once for each fingerprint in a worker; the
conversion itself is a Spark expression for each mapping.

Edge cases: a null or malformed record gives one row of layout ``invalid``, one
whose paths no mapping covers one row of layout ``unknown``, each with turn -1
and no role or content. A turn without content has the empty string; a turn
without a role has the role ``unknown``. Fields of one record that are null or
empty give no turn in the prompt layouts. Fields beyond the required ones are
ignored. Content may be a list of parts, as in multimodal messages: the texts of
its parts, strings or objects with ``text``, are joined by line feeds, and parts
of other kinds are left out. Repeated records are converted alike, each, in the order of their turns, so ties
need no rule; very long texts are converted whole. The result has only the columns
named, whatever others the table has. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import prepare

#: spellings of the canonical roles
ROLES = {
    "user": ("user", "human", "prompter", "customer", "question"),
    "assistant": ("assistant", "gpt", "bot", "model", "ai", "answer"),
    "system": ("system", "developer", "instruction"),
    "tool": ("tool", "function", "observation"),
}


@dataclass(frozen=True)
class Listed:
    """Turns in an array: its path, and the paths of role and content within an element."""

    name: str
    turns: str
    role: str
    content: str

    @property
    def required(self) -> tuple[frozenset[str], ...]:
        inner = lambda p: f"{self.turns}[].{p}".replace("[0]", "[]")
        return tuple(frozenset({inner(self.role), inner(self.content) + parts}) for parts in ("", "[]", "[].text"))

    def convert(self, v: Column) -> Column:
        turns = F.try_variant_get(v, f"$.{self.turns}", "array<variant>")
        return F.transform(turns, lambda m: _turn(F.try_variant_get(m, f"$.{self.role}", "string"), _content(F.try_variant_get(m, f"$.{self.content}", "variant"))))


@dataclass(frozen=True)
class Fields:
    """Turns in fields of the record: (role, paths joined by a blank line) in order; those in ``optional`` may be missing."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: frozenset[str] = field(default_factory=frozenset)

    @property
    def required(self) -> tuple[frozenset[str], ...]:
        return (frozenset(p for _, paths in self.turns for p in paths) - self.optional,)

    def convert(self, v: Column) -> Column:
        said = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*(F.try_variant_get(v, f"$.{p}", "string") for p in paths)), lambda t: t != ""), "\n\n").alias("content")) for role, paths in self.turns]
        return F.filter(F.array(*said), lambda t: t["content"] != "")


MAPPINGS = (
    Listed("messages", "messages", "role", "content"),
    Listed("conversations", "conversations", "from", "value"),
    Listed("dialogue", "dialogue", "speaker", "utterance"),
    Listed("nested", "data.chat", "author.role", "content.parts[0]"),
    Fields("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), frozenset({"system", "input"})),
    Fields("prompt", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), frozenset({"system"})),
    Fields("response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), frozenset({"system"})),
    Fields("question", (("user", ("context", "question")), ("assistant", ("answer",))), frozenset({"context"})),
)


def _content(v: Column) -> Column:
    """A string as it is; of a list, the texts of its parts, a line each."""
    plain = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(plain(x), F.try_variant_get(x, "$.text", "string")))
    return F.coalesce(F.array_join(parts, "\n"), F.try_variant_get(v, "$", "string"))


def _turn(role: Column, content: Column) -> Column:
    low = F.lower(F.trim(role))
    name = F.coalesce(*(F.when(low.isin(*names), canonical) for canonical, names in ROLES.items()), F.nullif(low, F.lit("")), F.lit("unknown"))
    return F.struct(name.alias("role"), F.coalesce(content, F.lit("")).alias("content"))


_TOKEN = re.compile(r"`(?:[^`]|``)*`|[^\s:,<>`]+|[:,<>]")


def field_paths(schema: str) -> tuple[str, ...]:
    """The sorted paths of all leaves of a schema as ``schema_of_variant`` writes it."""
    tokens = _TOKEN.findall(schema)
    found: set[str] = set()

    def walk(at: int, path: str) -> int:
        kind = tokens[at]
        if at + 1 < len(tokens) and tokens[at + 1] == "<" and kind == "ARRAY":
            return walk(at + 2, path + "[]") + 1
        if at + 1 < len(tokens) and tokens[at + 1] == "<" and kind == "OBJECT":
            at += 2
            if tokens[at] == ">":
                found.add(path)
                return at + 1
            while True:
                name = tokens[at].strip("`").replace("``", "`")
                at = walk(at + 2, f"{path}.{name}" if path else name)
                if tokens[at] == ">":
                    return at + 1
                at += 1
        found.add(path)
        at += 1
        if at < len(tokens) and tokens[at] == "<":  # no other type has parts
            raise ValueError(schema)
        return at

    walk(0, "")
    return tuple(sorted(found))


@lru_cache(maxsize=4096)
def selected(schema: str) -> tuple[int, str]:
    """A schema's fingerprint, and the name of its mapping."""
    paths = field_paths(re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DECIMAL", schema))
    print_ = int.from_bytes(hashlib.blake2b("\n".join(paths).encode(), digest_size=8).digest(), "big", signed=True)
    have = frozenset(paths)
    return print_, next((m.name for m in MAPPINGS if any(paths <= have for paths in m.required)), "unknown")


def canonical_turns(records: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, layout, fingerprint, turn, role, content): the turns of each JSON record, numbered from 0."""
    prepare(records.sparkSession)

    @F.pandas_udf("fingerprint long, layout string")
    def choose(schema: pd.Series) -> pd.DataFrame:
        found = {s: selected(s) if s is not None else (None, "invalid") for s in schema.unique()}
        return pd.DataFrame({"fingerprint": pd.array([found[s][0] for s in schema], "Int64"), "layout": [found[s][1] for s in schema]})

    v = F.try_parse_json(F.col(payload))
    chosen = records.select(F.col(key), v.alias("v")).withColumn("choice", choose(F.schema_of_variant("v")))
    name = F.col("choice.layout")
    turns = F.coalesce(*(F.when(name == m.name, m.convert(F.col("v"))) for m in MAPPINGS))
    return chosen.select(key, name.alias("layout"), F.col("choice.fingerprint").alias("fingerprint"), F.posexplode_outer(turns).alias("turn", "t")).select(
        key, "layout", "fingerprint", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "t.role", "t.content"
    )


def rendered(turns: DataFrame, key: str) -> DataFrame:
    """(key, text): each record's turns in one text, with role marks."""
    part = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.lit("\n"))
    return turns.where("turn >= 0").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("s")))), lambda x: x["s"]), "").alias("text"))


def heterogeneous(conversations: DataFrame) -> DataFrame:
    """(conv_id, payload): each conversation as one JSON record, in a layout that depends on its id."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    whole = conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(said.alias("t"))
    kind = F.col("conv_id") % 5
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")
    other = lambda x: F.when(x == "user", "human").when(x == "assistant", "gpt").otherwise(x)
    text = lambda k: F.col("t")[k]["content"]
    return whole.select(
        "conv_id",
        F.when(kind == 1, F.to_json(F.struct(F.transform("t", lambda x: F.struct(other(x["role"]).alias("from"), x["content"].alias("value"))).alias("conversations"))))
        .when(kind == 2, F.to_json(F.struct(F.struct(F.transform("t", lambda x: F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(x["content"]).alias("parts")).alias("content"))).alias("chat")).alias("data"))))
        .when(kind == 3, F.to_json(F.struct(F.transform("t", lambda x: F.struct(F.upper(x["role"]).alias("speaker"), x["content"].alias("utterance"))).alias("dialogue"))))
        .when((kind == 4) & (roles == "user,assistant"), F.to_json(F.struct(F.when(F.size("t") == 2, text(0)).alias("prompt"), F.when(F.size("t") == 2, text(1)).alias("completion"))))
        .when((kind == 4) & (roles == "system,user,assistant"), F.to_json(F.struct(F.when(F.size("t") == 3, text(0)).alias("system"), F.when(F.size("t") == 3, text(1)).alias("instruction"), F.when(F.size("t") == 3, text(2)).alias("output"))))
        .otherwise(F.to_json(F.struct(F.col("t").alias("messages")))).alias("payload"),
    )
