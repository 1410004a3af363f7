r"""Chat formatting: layouts found by schema fingerprint, one reversible template. DataFrame functions only.

A record is read into one struct that has the fields of all known layouts. The nested field paths that hold
something are hashed (SHA-256 of the sorted paths); the fingerprint selects a declarative mapping, which
turns prompt, instruction, message or dialogue layouts into canonical turns (role, text). Each layout is
declared once, with its required and optional paths; unknown fields are not part of a fingerprint. Of a list's
fields one is enough, as all roles or all contents may be null.

Template, one turn after the other:
    system     <<SYS>>\n text \n<</SYS>>\n
    user       [INST] text [/INST]
    assistant  <s> text </s>
    others     [ROLE=url-encoded role] text [/ROLE]
A control string inside a text gets a backslash behind its first character; if backslashes are there
already, one more. Taking one away is the exact inverse, so the output can be read back.

The loss mask is run-lengths by turn: `before` characters masked, `loss` characters that count, `after`
characters masked. Lengths are code points. Only texts of the assistant count, without the marks.

Size: turns of one conversation come together in one row, as the output is one string per conversation;
that row must fit in memory. Nothing else is gathered, and no row meets a driver or Python.

Defined results: null text or role is empty; rows of equal conv_id are one conversation, null ids being
one too; turns are ordered by turn (nulls first), then role and text, and repeated rows stay; a record of
unknown layout has a null layout and no turns; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import table

# The marks of the template.
_OPEN = {"system": "<<SYS>>\n", "user": "[INST] ", "assistant": "<s> "}
_CLOSE = {"system": "\n<</SYS>>\n", "user": " [/INST]", "assistant": " </s>"}
_OTHER_OPEN, _OTHER_BETWEEN, _OTHER_CLOSE = "[ROLE=", "] ", " [/ROLE]"
#: What follows the first character of a control string.
_TAIL = r"s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE=|/ROLE\]"
_TURN_END = r"(?<=\[/INST\]|</s>|<</SYS>>\n|\[/ROLE\])"

#: The union of the known layouts' fields.
RECORD = "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<from:string,value:string>>,system:string,instruction:string,input:string,output:string,prompt:string,completion:string,response:string,question:string,answer:string>"
_LISTS = {"messages": ("role", "content"), "conversations": ("from", "value")}
_SCALARS = ("system", "instruction", "input", "output", "prompt", "completion", "response", "question", "answer")

#: name: (required paths, optional paths, turns as (role, fields joined by an empty line) or a list's name).
LAYOUTS = {
    "messages": (("messages[].role", "messages[].content"), ("system",), "messages"),
    "dialogue": (("conversations[].from", "conversations[].value"), ("system",), "conversations"),
    "instruction": (("instruction", "output"), ("input", "system"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    "completion": (("prompt", "completion"), ("system",), (("user", ("prompt",)), ("assistant", ("completion",)))),
    "response": (("prompt", "response"), ("system",), (("user", ("prompt",)), ("assistant", ("response",)))),
    "question": (("question", "answer"), ("system",), (("user", ("question",)), ("assistant", ("answer",)))),
}
#: Other names of the roles in dialogue layouts.
_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _hashed(paths) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def fingerprints() -> dict[str, str]:
    """Fingerprint -> layout, with every choice of optional paths."""
    out = {}
    for name, (required, optional, turns) in LAYOUTS.items():
        needed = [required] if isinstance(turns, tuple) else [some for k in range(1, len(required) + 1) for some in combinations(required, k)]
        for k in range(len(optional) + 1):
            out |= {_hashed((*some, *more)): name for some in needed for more in combinations(optional, k)}
    return out


def _has(field: str):
    return lambda x: x[field].isNotNull()


def fingerprint(record: Column) -> Column:
    """The hash of the record's nested field paths that hold something."""
    present = [F.when(record[k].isNotNull(), F.lit(k)) for k in _SCALARS]
    for name, fields in _LISTS.items():
        present += [F.when(F.exists(record[name], _has(f)), F.lit(f"{name}[].{f}")) for f in fields]
    return F.sha2(F.concat_ws(",", F.array_sort(F.array_compact(F.array(*present)))), 256)


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(record: Column, layout: str) -> Column:
    turns = LAYOUTS[layout][2]
    if turns == "messages":
        out = F.transform(record["messages"], lambda x: _turn(x["role"], x["content"]))
    elif turns == "conversations":
        names = F.create_map(*(F.lit(x) for pair in _ROLES.items() for x in pair))
        out = F.transform(record["conversations"], lambda x: _turn(F.coalesce(names[F.coalesce(x["from"], F.lit(""))], x["from"]), x["value"]))
    else:
        out = F.array(*(_turn(role, F.concat_ws("\n\n", *(record[f] for f in fields))) for role, fields in turns))
    return F.when(record["system"].isNotNull(), F.concat(F.array(_turn("system", record["system"])), out)).otherwise(out)


def canonical(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds fingerprint, layout and turns (array of role, text) to rows with a struct of type RECORD."""
    record = F.col(f"`{record_col}`").cast(RECORD)
    known = fingerprints()
    named = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    df = records.withColumn("fingerprint", fingerprint(record)).withColumn("layout", named[F.col("fingerprint")])
    turns = F.lit(None)
    for name in LAYOUTS:
        turns = F.when(F.col("layout") == name, _mapped(record, name)).otherwise(turns)
    return df.withColumn("turns", F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")))


def from_json(rows: DataFrame, json_col: str, record_col: str = "record") -> DataFrame:
    """Adds the record of a JSON column; broken JSON has no fields."""
    return rows.withColumn(record_col, F.from_json(F.col(f"`{json_col}`"), RECORD, {"maxStringLen": "2147483647"}))


def from_turn_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Records, in the messages layout, of a table with one row for each turn: conv_id, record."""
    rows = rows.select(F.col(f"`{id_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("content")).alias("m"))
    messages = F.transform(F.array_sort(F.collect_list("m")), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    none = [F.lit(None).cast("string").alias(k) for k in _SCALARS]
    grouped = rows.groupBy("conv_id").agg(messages.alias("messages"))
    return grouped.select("conv_id", F.struct("messages", F.lit(None).cast("array<struct<from:string,value:string>>").alias("conversations"), *none).alias("record"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_TAIL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_TAIL})", r"$1$2")


def _by_role(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = other
    for name, mark in marks.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_turns(df: DataFrame) -> DataFrame:
    """Adds formatted and loss_runs (array of before, loss, after) to rows with turns."""

    def parts(x: Column) -> Column:
        head = _by_role(x["role"], _OPEN, F.concat(F.lit(_OTHER_OPEN), F.url_encode(x["role"]), F.lit(_OTHER_BETWEEN)))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), _by_role(x["role"], _CLOSE, F.lit(_OTHER_CLOSE)).alias("tail"), (x["role"] == "assistant").alias("counts"))

    def runs(p: Column) -> Column:
        size = F.length(p["body"])
        rest = F.length(p["tail"])
        return F.struct(F.length(p["head"]).alias("before"), F.when(p["counts"], size).otherwise(0).alias("loss"), F.when(p["counts"], rest).otherwise(rest + size).alias("after"))

    df = df.withColumn("_parts", F.transform("turns", parts))
    formatted = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return df.withColumn("formatted", formatted).withColumn("loss_runs", F.transform("_parts", runs)).drop("_parts")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string."""

    def turn(s: Column) -> Column:
        role = F.url_decode(F.regexp_extract(s, r"(?s)^\[ROLE=([^\]]*)\]", 1))
        for name, mark in _OPEN.items():
            role = F.when(F.startswith(s, F.lit(mark)), F.lit(name)).otherwise(role)
        skip = F.locate(_OTHER_BETWEEN, s) + len(_OTHER_BETWEEN)
        rest = F.lit(len(_OTHER_CLOSE))
        for name, mark in _OPEN.items():
            skip = F.when(F.startswith(s, F.lit(mark)), F.lit(len(mark) + 1)).otherwise(skip)
            rest = F.when(F.startswith(s, F.lit(mark)), F.lit(len(_CLOSE[name]))).otherwise(rest)
        body = F.substring(s, skip, F.length(s) - skip + 1 - rest)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(_turn_strings(formatted), turn)


def _turn_strings(formatted: Column) -> Column:
    return F.filter(F.split(formatted, _TURN_END), lambda s: s != "")


def loss_text(formatted: Column, runs: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.zip_with(_turn_strings(formatted), runs, lambda s, r: unescape(F.substring(s, r["before"] + 1, r["loss"]))), "")


def format_conversations(rows: DataFrame, **columns) -> DataFrame:
    """conv_id, layout, turns, formatted and loss_runs of a table with one row for each turn."""
    return format_turns(canonical(from_turn_rows(rows, **columns))).select("conv_id", "layout", "turns", "formatted", "loss_runs")


#: A conversation whose texts are control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("conv_id"), F.lit(b).cast("long").alias("turn"), F.lit(c).alias("role"), F.lit(d).alias("text")) for a, b, c, d in PROBE)))
    rows = rows.unionByName(spark.range(1).select(probe.alias("x")).select("x.*"))
    out = format_conversations(rows).withColumn("back", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_runs")))
    joined = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE=|/ROLE\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(url_encode(role)) END AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
