"""Markdown documents with YAML front matter: tolerant parsing into typed columns, and serialising.

YAML is read by the 1.2 core rules (dates, ``yes`` and clock times stay text, ``012`` is twelve). What
doesn't parse is repaired line by line: a value with an unquoted colon or a stray ``*`` is taken as
text; failing that, the top-level entries that parse on their own are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.plans.runtime import spread

FENCE = "---"


class Core(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """Loader of the YAML 1.2 core schema."""


Core.yaml_implicit_resolvers = {}
# Scalar forms of the core schema.
for tag, pattern, first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+0123456789.")),
):
    Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)


def core_int(loader: Core, node: yaml.ScalarNode) -> int:
    text = loader.construct_scalar(node)
    return int(text[2:], 8) if text.startswith("0o") else int(text[2:], 16) if text.startswith("0x") else int(text)


Core.add_constructor("tag:yaml.org,2002:int", core_int)


def quoted(line: str, column: int) -> str | None:
    """The line with the value around ``column`` as a quoted text."""
    star = re.search(r"(?:^|[\s\[{,:-])(\*\S)", line)
    if star and star.start(1) >= max(0, column - 1):
        begin = star.start(1)
        in_flow = line[:begin].count("[") > line[:begin].count("]") or line[:begin].count("{") > line[:begin].count("}")
        end = re.compile(r"[,\]}]").search(line, begin) if in_flow else None
        stop = end.start() if end else len(line)
        return line[:begin] + json.dumps(line[begin:stop].rstrip(), ensure_ascii=False) + line[stop:]
    m = re.match(r"(\s*(?:-\s+)*[^\s:#][^:]*:\s+|\s*-\s+)(\S.*)$", line)
    if not m or m.group(2)[0] in "\"'":
        return None
    return m.group(1) + json.dumps(m.group(2).rstrip(), ensure_ascii=False)


def load_yaml(text: str) -> object:
    """Parsed value of a block, after as many repairs as it takes; entries that stay broken are left out."""
    lines = text.split("\n")
    for _ in range(2 * len(lines) + 1):
        try:
            return yaml.load("\n".join(lines), Core)  # noqa: S506
        except yaml.MarkedYAMLError as e:
            mark = e.problem_mark
            repaired = quoted(lines[mark.line], mark.column) if mark is not None and mark.line < len(lines) else None
            if repaired is None or repaired == lines[mark.line]:
                break
            lines[mark.line] = repaired
        except (yaml.YAMLError, ValueError, RecursionError):
            break
    found: dict = {}
    starts = [i for i, x in enumerate(lines) if re.match(r"[^\s#\-:][^:]*:(\s|$)", x)]
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        try:
            entry = yaml.load("\n".join(lines[a:b]), Core)  # noqa: S506
        except (yaml.YAMLError, ValueError, RecursionError):
            key, _, value = lines[a].partition(":")
            entry = {key.strip(): value.strip()} if value.strip() and value.strip()[0] not in "[{\"'|>&*" else None
        if isinstance(entry, dict):
            found |= entry
    return found or None


def split_document(content: str) -> tuple[dict | None, str]:
    """(front matter or None, body). An unclosed block belongs to the body; a list or scalar block is none."""
    if not content.startswith(FENCE):
        return None, content
    lines = re.split(r"\r?\n", content)
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == FENCE), None)
    if end is None:
        return None, content
    raw = load_yaml("\n".join(lines[1:end]))
    return ({} if raw is None else raw if isinstance(raw, dict) else None), "\n".join(lines[end + 1 :])


def scalar(v: object) -> str | None:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return v if isinstance(v, str) and v else None


def listed(v: object) -> list[str]:
    found = [scalar(x) for x in v] if isinstance(v, list) else [scalar(v)]
    return [x for x in found if x is not None]


def event(v: object) -> dict | None:
    found = {k: scalar(v.get(k)) for k in ("by", "at")} if isinstance(v, dict) else {}
    return found if any(found.values()) else None


def source(v: object) -> dict | None:
    if not isinstance(v, dict):
        return None
    found: dict = {k: scalar(v.get(k)) for k in ("id", "resource", "title", "author", "last_modified")}
    count = v.get("usage_count")
    found["usage_count"] = float(count) if isinstance(count, int | float) and not isinstance(count, bool) and abs(count) != float("inf") else None
    return found if any(x is not None for x in found.values()) else None


EVENT = pa.struct([("by", pa.string()), ("at", pa.string())])
SOURCE = pa.struct([("id", pa.string()), ("resource", pa.string()), ("title", pa.string()), ("author", pa.string()), ("last_modified", pa.string()), ("usage_count", pa.float64())])
TYPED = pa.struct(
    [(k, pa.string()) for k in ("type", "title", "description", "resource", "timestamp")]
    + [("tags", pa.list_(pa.string())), ("status", pa.string()), ("supersedes", pa.list_(pa.string())), ("generated", EVENT), ("verified", pa.list_(EVENT)), ("sources", pa.list_(SOURCE)), ("stale_after", pa.string()), ("raw_json", pa.string())]
)
DDL = (
    "struct<type:string,title:string,description:string,resource:string,timestamp:string,tags:array<string>,status:string,supersedes:array<string>,generated:struct<by:string,at:string>,"
    "verified:array<struct<by:string,at:string>>,sources:array<struct<id:string,resource:string,title:string,author:string,last_modified:string,usage_count:double>>,stale_after:string,raw_json:string>"
)


def typed(raw: dict) -> dict:
    """The permissive typed view; unknown keys stay in raw_json, in their order."""
    out: dict = {k: scalar(raw.get(k)) for k in ("type", "title", "description", "resource", "timestamp", "status", "stale_after")}
    out |= {k: listed(raw.get(k)) for k in ("tags", "supersedes")}
    out["generated"] = event(raw.get("generated"))
    verified = raw.get("verified")
    out["verified"] = [e for e in map(event, verified if isinstance(verified, list) else [verified]) if e]
    sources = raw.get("sources")
    out["sources"] = [s for s in map(source, sources if isinstance(sources, list) else []) if s]
    out["raw_json"] = json.dumps({str(k): v for k, v in raw.items()}, ensure_ascii=False, default=str)
    return out


def serialise(raw: dict, body: str) -> str:
    """``---``, YAML in the order of the keys, ``---``, a blank line and the body."""
    block = yaml.safe_dump(raw, sort_keys=False, allow_unicode=True, width=1 << 30).rstrip() if raw else "{}"
    return f"{FENCE}\n{block}\n{FENCE}\n\n{body.lstrip(chr(10)).rstrip()}\n"


def parse_documents(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, frontmatter, body): frontmatter NULL where there is none; a null content gives a null body."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, bodies = [], []
            for c in batch.column(1).to_pylist():
                raw, body = split_document(c) if c is not None else (None, None)
                heads.append(None if raw is None else typed(raw))
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, TYPED), pa.array(bodies, pa.string())], names=["key", "frontmatter", "body"])

    return spread(df.select(F.col(key), F.col(content))).mapInArrow(run, f"key {kind}, frontmatter {DDL}, body string").withColumnRenamed("key", key)
