"""Walks over chat bodies in JSON: which strings are sanitised, and how they are restored."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys whose strings shape a request, block types that pass untouched, tools that may see restored values.
STRUCTURAL = {"type", "role", "id", "tool_use_id", "tool_call_id", "name", "model", "media_type", "stop_reason", "signature", "cache_control"}
OPAQUE_BLOCKS = {"thinking", "redacted_thinking"}
UNSCANNED_BLOCKS = {"image", "document", "image_url", "input_audio", "file"}
RESTORE_TOOLS = ["Read", "Edit", "MultiEdit", "Write", "NotebookEdit", "Grep", "Glob", "apply_patch"]
SHELL_TOOLS = {"Bash", "bash", "shell", "PowerShell", "exec_command", "shell_command", "write_stdin"}
SCHEMA_TEXT, SCHEMA_DATA = {"description", "title", "$comment"}, {"default", "const", "enum", "examples", "example"}


def leaves(node, path: tuple = (), keys: bool = False) -> Iterator[tuple[tuple, str]]:
    """(path, string) of all string leaves, and of keys if asked; numbers, booleans and nulls aren't any."""
    if isinstance(node, str):
        yield path, node
    elif isinstance(node, list):
        for i, x in enumerate(node):
            yield from leaves(x, (*path, i), keys)
    elif isinstance(node, dict):
        for k, x in node.items():
            if keys:
                yield (*path, k, "#key"), k
            yield from leaves(x, (*path, k), keys)


def rewrite(node, swap: Callable[[str], str], keys: bool = False):
    """The tree with every string leaf (and key) swapped."""
    if isinstance(node, str):
        return swap(node)
    if isinstance(node, list):
        return [rewrite(x, swap, keys) for x in node]
    if isinstance(node, dict):
        return {swap(k) if keys else k: rewrite(x, swap, keys) for k, x in node.items()}
    return node


def rewrite_schema(node, swap: Callable[[str], str], data: bool = False):
    """A JSON schema: prose and data values are swapped; keywords, property names and types stay."""
    if isinstance(node, dict):
        return {k: rewrite(x, swap) if k in SCHEMA_DATA or (k in SCHEMA_TEXT and isinstance(x, str)) else rewrite_schema(x, swap) for k, x in node.items()}
    return [rewrite_schema(x, swap) for x in node] if isinstance(node, list) else node


def rewrite_block(block, swap: Callable[[str], str], tally: dict):
    """A content block: opaque ones pass, images count as unscanned, tool inputs and results are walked, structure stays."""
    if isinstance(block, str):
        return swap(block)
    if isinstance(block, list):
        return [rewrite_block(b, swap, tally) for b in block]
    if not isinstance(block, dict):
        return block
    kind = block.get("type")
    if kind in OPAQUE_BLOCKS:
        return block
    if kind in UNSCANNED_BLOCKS:
        tally["unscanned"] = tally.get("unscanned", 0) + 1
        return block
    done = {}
    for k, x in block.items():
        if k in STRUCTURAL:
            done[k] = x
        elif k == "input":
            done[k] = rewrite(x, swap, keys=True)
        elif k == "arguments" and isinstance(x, str):
            done[k] = rewrite_json_text(x, swap)
        elif k in ("input_schema", "parameters"):
            done[k] = rewrite_schema(x, swap)
        else:
            done[k] = rewrite_block(x, swap, tally)
    return done


def rewrite_json_text(text: str, swap: Callable[[str], str]) -> str:
    """JSON in a string: its leaves are swapped; what doesn't parse is plain text."""
    try:
        return json.dumps(rewrite(json.loads(text), swap, keys=True), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return swap(text)


def rewrite_body(body: dict, swap: Callable[[str], str]) -> tuple[dict, dict]:
    """A request body of either chat protocol; unknown fields survive as they are."""
    tally: dict = {}
    done = {k: rewrite_block(x, swap, tally) if k in ("system", "messages", "tools", "input", "instructions") else x for k, x in body.items()}
    return done, tally


def gate(tool: str | None, allowed: list[str] = RESTORE_TOOLS) -> str:
    """What happens to a reply's placeholders: `restore` in text and allowed client tools, `never` in shells, else `hold`."""
    if tool is None or tool in allowed:
        return "restore"
    return "never" if tool in SHELL_TOOLS else "hold"


def body_strings(bodies: DataFrame, body_col: str = "body", keys: bool = False) -> DataFrame:
    """(other columns, path, value): one row per string leaf of JSON bodies. A body that doesn't parse is one leaf at `$`."""
    rest = [c for c in bodies.columns if c != body_col]

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def walk(texts: pd.Series) -> pd.Series:
        def one(text: str | None):
            if text is None:
                return []
            try:
                return [{"path": "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path), "value": v} for path, v in leaves(json.loads(text), (), keys)]
            except ValueError:
                return [{"path": "$", "value": text}]

        return texts.map(one)

    return bodies.select(*rest, F.explode(walk(body_col)).alias("_l")).select(*rest, "_l.path", "_l.value")


def swap_in_bodies(bodies: DataFrame, swaps: DataFrame, key: str, body_col: str = "body") -> DataFrame:
    """Bodies with the values of ``swaps`` (key, value, placeholder) replaced in all strings a model would read.

    One array of swaps per key is joined to its bodies; longer values are replaced first.
    """
    per_key = swaps.groupBy(key).agg(F.collect_list(F.struct("value", "placeholder")).alias("_swaps"))

    @F.pandas_udf("string")
    def run(texts: pd.Series, tables: pd.Series) -> pd.Series:
        def one(text, table):
            if text is None or table is None:
                return text
            order = sorted(((t["value"], t["placeholder"]) for t in table), key=lambda p: -len(p[0]))

            def swap(s: str) -> str:
                for value, name in order:
                    s = s.replace(value, name)
                return s

            try:
                return json.dumps(rewrite_body(json.loads(text), swap)[0], ensure_ascii=False)
            except ValueError:
                return swap(text)

        return pd.Series([one(a, b) for a, b in zip(texts, tables)])

    joined = bodies.join(per_key, key, "left")
    return joined.select(*[c for c in bodies.columns if c != body_col], run(F.col(body_col), F.col("_swaps")).alias(body_col))


def distinct_texts(texts: DataFrame, work: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
    """Does costly work once per distinct text: ``work`` maps (h, text) to (h, results), which are joined back."""
    keyed = texts.withColumn("h", F.sha2(text_col, 256))
    once = keyed.select("h", F.col(text_col).alias("text")).dropDuplicates(["h"])
    return keyed.join(work(once), "h", "left").drop("h")
