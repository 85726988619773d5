"""Message content of a transcript line, which is a string or an array of blocks, through VARIANT."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType


def field(line: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(line, path, kind)


def extract_text(line: Column, path: str = "$.message.content") -> Column:
    """The string, or every block's text joined by newlines; '' where there is neither."""
    blocks = F.try_variant_get(line, path, "array<struct<text:string>>")
    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(texts, "\n"), F.try_variant_get(line, path, "string"), F.lit(""))


def block_array(line: Column, path: str = "$.message.content") -> Column:
    """The blocks as structs of everything that summaries use; inputs stay VARIANT."""
    return F.try_variant_get(
        line, path, "array<struct<type:string,text:string,thinking:string,name:string,input:variant,content:variant,is_error:boolean>>"
    )


# The keys that tell what a tool works on, the most telling first.
TARGET_KEYS = ("command", "file_path", "pattern", "path", "url", "query", "prompt", "description")
#: Fixed value: characters shown of a block's body.
BODY_CAP = 4000


def first_filled(tool_input: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that holds a text which is not empty."""
    get = lambda k: F.when(F.schema_of_variant(F.variant_get(tool_input, f"$.{k}", "variant")) == "STRING", F.try_variant_get(tool_input, f"$.{k}", "string"))
    return F.coalesce(*(F.nullif(get(k), F.lit("")) for k in keys))


def first_line(text: Column) -> Column:
    """The first line that is not empty."""
    return F.regexp_extract(text, r"([^\r\n]+)", 1)


def tool_target(tool_input: Column, most: int = 72) -> Column:
    """What a tool works on: the first filled key, first line, at most ``most`` characters; null if there is none."""
    found = first_filled(tool_input, TARGET_KEYS)
    line = F.coalesce(F.nullif(first_line(found), F.lit("")), found)
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def summarize(blocks: Column) -> Column:
    """One line for a message's blocks: tools, results and thoughts; null if it has none."""

    def thought(b: Column) -> Column:
        flat = F.trim(first_line(F.coalesce(b["thinking"], F.lit(""))))
        shown = F.when(F.char_length(flat) > 64, F.concat(F.substring(flat, 1, 64), F.lit("…"))).otherwise(flat)
        return F.when(flat == "", "thinking…").otherwise(F.concat(F.lit("thinking… "), shown))

    parts = F.transform(
        blocks,
        lambda b: F.when(b["type"] == "tool_use", F.concat_ws(" · ", F.coalesce(b["name"], F.lit("tool")), tool_target(b["input"])))
        .when(b["type"] == "tool_result", F.when(F.coalesce(b["is_error"], F.lit(False)), "→ error").otherwise("→ result"))
        .when(b["type"] == "thinking", thought(b)),
    )
    told = F.filter(parts, lambda p: p.isNotNull())
    return F.when(F.size(told) > 0, F.array_join(told, "   "))


def _pretty(value, indent: str = "") -> str:
    """JSON with sorted keys on lines of their own, a blank on both sides of a colon, slashes escaped."""
    deeper = indent + "  "
    if isinstance(value, dict):
        rows = [f"{deeper}{_pretty(k)} : {_pretty(v, deeper)}" for k, v in sorted(value.items())]
        return "{\n" + ",\n".join(rows) + f"\n{indent}}}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(deeper + _pretty(v, deeper) for v in value) + f"\n{indent}]"
    return json.dumps(value, ensure_ascii=False).replace("/", "\\/")


def _capped(body: str) -> str:
    left = len(body) - BODY_CAP
    return body if left <= 0 else f"{body[:BODY_CAP]}\n… +{left:,} more characters (truncated for display)"


def details_of(raw: str | None) -> list[dict]:
    """title, body and is_error of each block that a line's message shows; a message that is one text is one."""
    try:
        line = json.loads(raw or "")
    except ValueError:
        return []
    message = line.get("message") if isinstance(line, dict) else None
    content = message.get("content") if isinstance(message, dict) else None
    row = lambda title, body, error=False: {"title": title, "body": _capped(body), "is_error": error}
    if isinstance(content, str):
        return [row(line["type"] if isinstance(line.get("type"), str) else "message", content)] if content else []
    if not isinstance(content, list) or not all(isinstance(b, dict) for b in content):
        return []
    text = lambda b, key: b[key] if isinstance(b.get(key), str) else ""
    out = []
    for b in content:
        match b.get("type"):
            case "tool_use":
                out.append(row(b["name"] if isinstance(b.get("name"), str) else "tool", _pretty(b["input"] if isinstance(b.get("input"), dict) else {})))
            case "tool_result":
                failed, parts = b.get("is_error") is True, b.get("content")
                if isinstance(parts, list) and all(isinstance(x, dict) for x in parts):
                    parts = "\n".join(x["text"] for x in parts if isinstance(x.get("text"), str))
                out.append(row("error" if failed else "result", parts if isinstance(parts, str) and parts else "(empty result)", failed))
            case "thinking":
                out.append(row("thinking", text(b, "thinking") or "(reasoning not retained in this transcript)"))
            case "text" if text(b, "text"):
                out.append(row("text", b["text"]))
    return out


DETAIL = StructType([StructField("title", StringType()), StructField("body", StringType()), StructField("is_error", BooleanType())])


@F.pandas_udf(ArrayType(DETAIL))
def details(raw: pd.Series) -> pd.Series:
    """details_of in Arrow batches: JSON is laid out anew, which no Column expression does."""
    return raw.map(details_of)


def tool_calls(blocks: Column) -> Column:
    """array<struct(name, input)> of the tool_use blocks."""
    return F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("name"), b["input"].alias("input")))


# Words before a shell line's program, and those of them that take the next word along.
WITH_ARGUMENT = {"cd", "pushd", "export"}
PREFIXES = {"sudo", "env", "time", "nohup", "exec", "command", "then", "else", "do", "!", "{", "(", "builtin"}
#: Fixed value: the keys that name a lasting thing.
ENTITY_KEYS = ("file_path", "path", "url", "notebook_path")


def shell_program_of(line: str | None) -> str | None:
    """The first real program of a shell line; at most 32 characters of its base name."""
    for part in re.split(r"[;|&\n]", line or ""):
        words = iter(re.findall(r"[^ \t]+", part))
        for word in words:
            if word in WITH_ARGUMENT:
                next(words, None)
            elif word not in PREFIXES and word[0] not in "-$><" and ("=" not in word or word[0] == "/"):
                base = [x for x in word.split("/") if x]
                return (base[-1] if base else word)[:32]
    return None


@F.pandas_udf(StringType())
def shell_program(lines: pd.Series) -> pd.Series:
    """A walk over words that no Column expression has; in Arrow batches."""
    return lines.map(shell_program_of)


def graph_target(tool_input: Column) -> Column:
    """A tool call's target in a session graph: a path, a shell program, or the beginning of a search."""
    program = shell_program(first_filled(tool_input, ("command",)))
    return F.coalesce(
        first_filled(tool_input, ENTITY_KEYS), F.concat(F.lit("$ "), program),
        F.substring(first_filled(tool_input, ("pattern",)), 1, 48), F.substring(first_filled(tool_input, ("query",)), 1, 48),
    )
