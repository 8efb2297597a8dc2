"""Chat formatting in DataFrame operations only: schema fingerprints choose how a layout becomes canonical turns.

A layout is known by the SHA-256 of its sorted nested field paths (``messages[].role``). Each known layout has a
declarative mapping to turns (role, text). Extra fields do not matter: paths outside the vocabulary of layouts
are left out before hashing. Unknown layouts give null turns in the JSON form and raise in the typed form.

Nulls: null role or text is empty; a null turn number sorts first; a null record has null turns. Ties in the
turn number go by role, then text. Repeated rows are kept as repeated turns. A conversation is one row, however long
its texts are. Columns that are no part of the layout are not read, whatever their names; in the JSON form they stay,
but ``layout`` and ``turns`` are replaced. Empty input gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"

_TURN = "array<struct<role:string,text:string>>"


def _pair(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _present(*turns: tuple[str, Column]) -> Column:
    """Turns in order; those whose text is null are left out."""
    return F.filter(F.array(*[F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in turns]), lambda t: t["text"].isNotNull())


def _listed(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda m: F.struct(F.coalesce(m[role], F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


_SPEAKER = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "prompter": "user"}


def _spoken(turns: Column) -> Column:
    """Other names of the roles become user and assistant."""
    names = F.create_map(*[F.lit(x) for kv in _SPEAKER.items() for x in kv])
    return F.transform(turns, lambda t: F.struct(F.coalesce(F.try_element_at(names, t["role"]), t["role"]).alias("role"), t["text"].alias("text")))


#: Layout name -> (nested field paths, mapping from a function that gets a field to the array of turns).
LAYOUTS = {
    "messages": (["messages[].content", "messages[].role"], lambda f: _listed(f("messages"), "role", "content")),
    "sharegpt": (["conversations[].from", "conversations[].value"], lambda f: _spoken(_listed(f("conversations"), "from", "value"))),
    "prompt_completion": (["completion", "prompt"], lambda f: F.array(_pair("user", f("prompt")), _pair("assistant", f("completion")))),
    "prompt_response": (["prompt", "response"], lambda f: F.array(_pair("user", f("prompt")), _pair("assistant", f("response")))),
    "system_prompt_response": (["prompt", "response", "system"], lambda f: _present(("system", f("system")), ("user", F.coalesce(f("prompt"), F.lit(""))), ("assistant", F.coalesce(f("response"), F.lit(""))))),
    "instruction": (["instruction", "output"], lambda f: F.array(_pair("user", f("instruction")), _pair("assistant", f("output")))),
    "instruction_input": (["input", "instruction", "output"], lambda f: F.array(_pair("user", F.concat_ws("\n\n", f("instruction"), F.when(f("input") != "", f("input")))), _pair("assistant", f("output")))),
    "question_answer": (["answer", "question"], lambda f: F.array(_pair("user", f("question")), _pair("assistant", f("answer")))),
}
#: One row for each turn; grouped by the conversation's column.
TURN_ROWS = ["role", "text", "turn"]
_VOCABULARY = sorted({p for paths, _ in LAYOUTS.values() for p in paths} | set(TURN_ROWS))


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()} | {fingerprint(TURN_ROWS): "turn_rows"}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema's leaves."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def layout_of(schema: T.StructType) -> str:
    """The layout that the fingerprint of the known paths of ``schema`` selects."""
    found = [p for p in schema_paths(schema) if p in _VOCABULARY]
    name = BY_FINGERPRINT.get(fingerprint(found))
    if name is None:
        raise ValueError(f"no mapping for the layout {sorted(found)}")
    return name


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns) whatever the layout; turn rows are grouped by ``id_col``, record layouts have a row each."""
    name = layout_of(df.schema)
    key = F.col(f"`{id_col}`")
    if name == "turn_rows":
        one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        turns = df.groupBy(key.alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
        return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return df.select(key.alias("conv_id"), LAYOUTS[name][1](lambda field: F.col(f"`{field}`")).cast(_TURN).alias("turns"))


def json_turns(df: DataFrame, json_col: str) -> DataFrame:
    """``df`` with layout and turns of each JSON record: rows of one column may have different layouts.

    The field paths of a record are read from its keys (and from the keys of the first object of a list), so the
    choice is made row by row. Unparseable and unknown records get null.
    """
    j = F.col(f"`{json_col}`")
    lists = sorted({p.split("[]")[0] for p in _VOCABULARY if "[]" in p})
    plain = [p for p in _VOCABULARY if "[]" not in p]
    top = F.coalesce(F.json_object_keys(j), F.array().cast("array<string>"))

    def keys_in(name: str) -> Column:
        keys = F.coalesce(F.json_object_keys(F.get_json_object(j, f"$.{name}[0]")), F.array().cast("array<string>"))
        return F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k))

    inner = [keys_in(name) for name in lists]
    known = F.array(*[F.lit(p) for p in _VOCABULARY])
    paths = F.array_sort(F.array_intersect(F.array_distinct(F.concat(F.array_intersect(top, F.array(*[F.lit(p) for p in plain])), *inner)), known))
    names = F.create_map(*[F.lit(x) for kv in BY_FINGERPRINT.items() for x in kv])
    layout = F.try_element_at(names, F.sha2(F.array_join(paths, "\n"), 256))
    turns = None
    for name, (fields, mapping) in LAYOUTS.items():
        tops = sorted({p.split("[]")[0] for p in fields})
        kinds = ", ".join(f"`{t}` " + (f"array<struct<{','.join(f'`{p.split('[].')[1]}`:string' for p in fields if p.startswith(t + '[]'))}>>" if t in lists else "string") for t in tops)
        record = F.from_json(j, kinds)
        case = mapping(lambda field, record=record: record[field]).cast(_TURN)
        turns = F.when(F.col("layout") == name, case) if turns is None else turns.when(F.col("layout") == name, case)
    return df.withColumn("layout", layout).withColumn("turns", turns)


def escape(text: Column) -> Column:
    """Control strings cannot occur in the result; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def formatted(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the template text and the spans (start, length in code points) under the loss mask.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. The loss covers the escaped text of each ``learn_from`` turn.
    """
    piece = F.transform("turns", lambda t: F.struct(_role_out(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == learn_from).alias("learn")))
    df = turns.withColumn("p", piece)
    df = df.withColumn("head", F.transform("p", lambda p: F.concat(F.lit(START), p["role"], F.lit("\n"))))
    df = df.withColumn("len", F.zip_with("head", "p", lambda h, p: F.struct(F.length(h).alias("head"), F.length(p["text"]).alias("text"), p["learn"].alias("learn"))))
    tail = len(END) + 1
    spans = F.aggregate(
        "len",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["head"] + x["text"] + tail).alias("at"),
            F.when(x["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["text"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.zip_with("head", "p", lambda h, p: F.concat(h, p["text"], F.lit(END + "\n"))), "")
    return df.select("conv_id", text.alias("formatted"), spans.alias("loss"))


def read_back(df: DataFrame) -> DataFrame:
    """Turns and learned texts from (formatted, loss) alone."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    df = df.withColumn("_parts", parts)
    cut = len(END) + 1

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.length(role) + 2, F.greatest(F.length(p) - F.length(role) - 1 - cut, F.lit(0)))
        return F.struct(_role_in(role).alias("role"), unescape(text).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return df.withColumn("turns", F.transform("_parts", turn)).withColumn("learned", learned).drop("_parts")
