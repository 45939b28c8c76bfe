"""Splitting files into chunks: pure functions, and Python table functions over them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MOST_WORDS, LEAST_WORDS = 500, 20
_HEADING = re.compile(r"^#{2,3}[^\S\n]", re.M)


def _words(text: str) -> int:
    """Pieces between runs of white space; an empty one counts at either end."""
    return len(re.split(r"\s+", text))


def chunk_markdown(text: str | None) -> list[str]:
    """Sections at second and third level headings; those of more than MOST_WORDS are packed from paragraphs, and those of fewer
    than LEAST_WORDS join the chunk before. What is packed stays, however short."""
    text = text or ""
    cuts = [0, *(m.start() for m in _HEADING.finditer(text) if m.start()), len(text)]
    out: list[str] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        section = text[a:b].strip()
        if not section:
            continue
        n = _words(section)
        if n > MOST_WORDS:
            held = ""
            for paragraph in re.split(r"\n\n+", section):
                if not paragraph.strip():
                    continue
                longer = f"{held}\n\n{paragraph}" if held else paragraph
                if held and _words(longer) > MOST_WORDS:
                    out.append(held.strip())
                    longer = paragraph
                held = longer
            out.append(held.strip())
        elif n < LEAST_WORDS and out:
            out[-1] += "\n\n" + section
        else:
            out.append(section)
    return out


def chunk_json(text: str | None) -> list[str]:
    """A chunk for each item of an array (indented), or of each member of an object (in one line; arrays in it: for each item);
    else the whole text."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return [text] if text else []
    if isinstance(value, list):
        return [json.dumps(v, indent=2, ensure_ascii=False) for v in value]
    if isinstance(value, dict) and value:
        return [f"{k}: {json.dumps(x, ensure_ascii=False, separators=(',', ':'))}" for k, v in value.items() for x in (v if isinstance(v, list) else [v])]
    return [text]


def parse_frontmatter(text: str | None) -> tuple[dict[str, str | list[str]], str]:
    """(fields, rest) of a text that begins with a --- block: scalars, [flow] lists and - block lists."""
    text = (text or "").replace("\r\n", "\n")
    found = re.match(r"---\n(.*?)\n---\s*(?:\n|\Z)", text, re.S)
    if not found:
        return {}, text
    bare = lambda s: s.strip()[1:-1] if len(s.strip()) >= 2 and s.strip()[0] == s.strip()[-1] and s.strip()[0] in "'\"" else s.strip()
    fields: dict[str, str | list[str]] = {}
    key = None
    for line in found[1].split("\n"):
        item = re.match(r"\s*-\s+(.*)", line)
        pair = re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)", line)
        if item and key is not None:
            if not isinstance(fields[key], list):
                fields[key] = []
            fields[key].append(bare(item[1]))
        elif pair:
            key, value = pair[1], pair[2].strip()
            fields[key] = [bare(v) for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") and value.endswith("]") else bare(value)
    return fields, text[found.end() :]


# Relation of each field that names others: fixed values.
FIELD_RELATIONS = {"agent": "is_agent_of", "references": "references", "supersedes": "supersedes", "caused_by": "caused_by", "resolves": "resolves", "decided_by": "decided_by"}


def frontmatter_relations(text: str | None) -> list[tuple[str, str]]:
    fields, _ = parse_frontmatter(text)
    out = []
    for key, relation in FIELD_RELATIONS.items():
        values = fields.get(key, [])
        out += [(relation, v) for v in (values if isinstance(values, list) else [values]) if v]
    return out


def parse_entity(text: str | None) -> list[tuple[str, str]]:
    """(section, text): the frontmatter, the compiled body, and each bullet of the `Timeline` section."""
    fields, rest = parse_frontmatter(text)
    out = [("frontmatter", "\n".join(f"{k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in fields.items()))] if fields else []
    found = re.search(r"^##\s+timeline\s*$", rest, re.I | re.M)
    body, timeline = (rest[: found.start()], rest[found.end() :]) if found else (rest, "")
    if body.strip():
        out.append(("compiled", body.strip()))
    return out + [("timeline", m[1].strip()) for m in re.finditer(r"^\s*[-*]\s+(.+)$", timeline, re.M)]


@F.udtf(returnType="pos int, chunk string", useArrow=True)
class MarkdownChunks:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunk_markdown(text))


@F.udtf(returnType="pos int, chunk string", useArrow=True)
class JsonChunks:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunk_json(text))


@F.udtf(returnType="pos int, section string, chunk string", useArrow=True)
class EntityChunks:
    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        for i, (section, part) in enumerate(parse_entity(text)):
            yield i, section, part


@F.udtf(returnType="relation string, target string", useArrow=True)
class FrontmatterRelations:
    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        yield from frontmatter_relations(text)


def register(spark: SparkSession) -> None:
    """The table functions by name, for SQL with LATERAL."""
    for name, function in {"chunk_markdown": MarkdownChunks, "chunk_json": JsonChunks, "parse_entity": EntityChunks, "frontmatter_relations": FrontmatterRelations}.items():
        spark.udtf.register(name, function)
