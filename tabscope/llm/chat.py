"""Chat formatting: layouts recognised by a schema fingerprint, canonical turns, a reversible template.

Built-in DataFrame and SQL functions only. The fingerprint of a table is a hash
of its nested field paths (types and extra columns aside); it selects one of the
declared mappings, which turns prompt, instruction and message layouts into
``turns array<struct<role, text>>``. The template writes every turn as

    ### role: text</turn>

and a newline. Inside roles and texts the characters that marks are made of are
escaped (backslash, ``#`` and ``<``; in roles also ``:``), so no text can forge a
mark and reading back is exact. ``mask`` has one entry per turn: the code points
of its head, of its escaped text, and whether the text is under the loss.

Rows: a null text or role counts as empty, but a null optional field (system,
input) is no turn. A conversation without turns gives an empty string. Rows of a
conversation that repeat a turn number follow each other by role and text; a
null ``conv_id`` is one conversation. Unknown layouts raise ``ValueError``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

END = "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"

#: Declared layouts: flat ones list (role, field, optional), nested ones the array and its role and text fields.
FLAT = {
    "prompt": [("system", "system", True), ("user", "prompt", False), ("assistant", "completion", False)],
    "response": [("system", "system", True), ("user", "prompt", False), ("assistant", "response", False)],
    "instruction": [("system", "system", True), ("user", "instruction", False), ("user", "input", True),
                    ("assistant", "output", False)],
    "question": [("user", "question", False), ("assistant", "answer", False)],
}
NESTED = {
    "messages": ("messages", "role", "content", {}),
    "conversations": ("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    "turns": ("turns", "role", "text", {}),
}


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaf fields of a schema; array elements are marked ``[]``."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    """Hash of the known field paths, in order of name."""
    return hashlib.sha256("\n".join(sorted(set(paths) & _KNOWN)).encode()).hexdigest()


def _layouts() -> dict[str, tuple[str, list]]:
    """Fingerprint -> (layout, fields), each optional field present or not."""
    out = {}
    for name, fields in FLAT.items():
        optional = [f for f in fields if f[2]]
        for bits in range(1 << len(optional)):
            own = [f for f in fields if not f[2] or bits >> optional.index(f) & 1]
            out[fingerprint([f[1] for f in own])] = (name, own)
    for name, (array, role, text, _) in NESTED.items():
        out[fingerprint([f"{array}[].{role}", f"{array}[].{text}"])] = (name, [])
    return out


_KNOWN = {f[1] for fields in FLAT.values() for f in fields} | {
    f"{a}[].{x}" for a, r, t, _ in NESTED.values() for x in (r, t)}
LAYOUTS = _layouts()


def canonical(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, turns`` of a table in one of the declared layouts."""
    found = LAYOUTS.get(fingerprint(field_paths(records.schema)))
    if found is None:
        raise ValueError(f"no declared layout has the fields {records.columns}")
    name, fields = found
    if name in NESTED:
        array, role, text, names = NESTED[name]

        def turn(x):
            r = x[role].cast("string")
            for a, b in names.items():
                r = F.when(r == a, b).otherwise(r)
            return F.struct(F.coalesce(r, F.lit("")).alias("role"),
                            F.coalesce(x[text].cast("string"), F.lit("")).alias("text"))
        turns = F.coalesce(F.transform(F.col(array), turn), F.array().cast(TURNS))
    else:
        turns = F.filter(F.array(*[
            F.when(F.col(f).isNull() & F.lit(optional), F.lit(None)).otherwise(
                F.struct(F.lit(role).alias("role"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("text")))
            for role, f, optional in fields]), lambda t: t.isNotNull())
    return records.select(key, turns.cast(TURNS).alias("turns"))


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: The backslash goes first when escaping and last when reading back.
_TEXT = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
_ROLE = [*_TEXT, (":", "\\c")]


def _back(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(b, a) for a, b in reversed(pairs)]


def render(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``turns`` replaced by ``formatted`` and ``mask array<struct<head, length, loss>>``."""
    keep = [c for c in turns.columns if c != "turns"]
    pieces = turns.select(*keep, F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("### "), _swap(t["role"], _ROLE), F.lit(": ")).alias("head"),
        _swap(t["text"], _TEXT).alias("body"), (t["role"] == loss_role).alias("loss"))).alias("_p"))
    return pieces.select(
        *keep, F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform("_p", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("length"),
                                             p["loss"].alias("loss"))).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` and ``loss_text`` (all text under the mask, unescaped), read from ``formatted`` and ``mask``."""
    cut_up = formatted.withColumn("_parts", F.split("formatted", END.replace("/", "\\/")))
    cut_up = cut_up.withColumn("_parts", F.slice("_parts", F.lit(1), F.size("_parts") - 1))
    head = lambda p: F.substring_index(p, ": ", 1)
    turns = F.transform("_parts", lambda p: F.struct(
        _swap(F.substring(head(p), F.lit(5), F.length(p)), _back(_ROLE)).alias("role"),
        _swap(F.substring(p, F.length(head(p)) + 3, F.length(p)), _back(_TEXT)).alias("text")))
    loss = F.array_join(F.zip_with("_parts", "mask", lambda p, m: F.when(
        m["loss"], _swap(F.substring(p, m["head"] + 1, m["length"]), _back(_TEXT))).otherwise("")), "")
    return cut_up.withColumn("turns", turns).withColumn("loss_text", loss).drop("_parts")


def layouts_of(rows: DataFrame) -> list[DataFrame]:
    """One record per conversation from ``rows(conv_id, turn, role, text)``, in the layout that fits its turns."""
    grouped = cut(rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("t")), "conversations")
    roles = F.transform("t", lambda x: x["role"])
    kind = grouped.withColumn("kind", F.when(roles == F.array(F.lit("user"), F.lit("assistant")), "prompt").when(
        roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "instruction").when(
        F.forall(roles, lambda r: r.isin("system", "user", "assistant")), "conversations").otherwise("messages"))
    text = lambda i: F.col("t")[i]["text"]
    spoken = F.transform("t", lambda x: F.struct(
        F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"),
        x["text"].alias("value")))
    return [
        kind.filter("kind = 'prompt'").select("conv_id", text(0).alias("prompt"), text(1).alias("completion")),
        kind.filter("kind = 'instruction'").select("conv_id", text(0).alias("system"), text(1).alias("instruction"),
                                                   text(2).alias("output")),
        kind.filter("kind = 'conversations'").select("conv_id", spoken.alias("conversations")),
        kind.filter("kind = 'messages'").select("conv_id", F.transform("t", lambda x: F.struct(
            x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))]


def format_conversations(tables: list[DataFrame], key: str = "conv_id") -> DataFrame:
    """``key, formatted, mask`` of tables in any of the declared layouts."""
    out = None
    for t in tables:
        part = canonical(t, key)
        out = part if out is None else out.unionAll(part)
    return render(out)
