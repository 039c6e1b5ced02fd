"""Quotation linking: quoted passages are traced to the messages they come from, and taken out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranks import placed
from millrace.session import stage

MARK = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
# the line that says who is quoted, in the languages of the corpus
SAID = re.compile(
    r"\s*(?:on\b.{3,200}\bwrote|.{1,100}\bwrites|am\b.{3,200}\bschrieb(?:\b.{1,100})?|.{1,100}\bschrieb|le\b.{3,200}\ba écrit|el\b.{3,200}\bescribió|[-_ ]*original message[-_ ]*)\s*:?\s*",
    re.IGNORECASE,
)
SPACE = re.compile(r"\s+")
# letters of scripts that are written without spaces: each counts as a word
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def levels(text: str) -> list[tuple[int, str]]:
    """Each line's quote level and what stands behind the marks."""
    out = []
    for line in text.split("\n"):
        found = MARK.match(line)
        out.append((found[1].count(">"), line[found.end() :]) if found else (0, line))
    return out


def own_words(lines: list[tuple[int, str]]) -> str:
    """What a message adds: its lines without quotes, without the line that names who is quoted."""
    kept = []
    for i, (level, line) in enumerate(lines):
        quoted_next = next((n for n, x in lines[i + 1 :] if x.strip() or n), 0) > 0
        if not level and not (quoted_next and SAID.fullmatch(line)):
            kept.append(line)
    return "\n".join(kept).strip("\n")


def normalised(text: str) -> str:
    return SPACE.sub(" ", text).strip().lower()


def passages(lines: list[str]) -> dict[bytes, int]:
    """Digests and word counts of the whole, of its paragraphs and of its lines, in normalised form."""
    text = "\n".join(lines)
    out = {}
    for part in [text, *re.split(r"\n[ \t]*\n", text), *lines]:
        if plain := normalised(part):
            out[md5(plain.encode(), usedforsecurity=False).digest()] = max(plain.count(" ") + 1, len(UNSPACED.findall(plain)))
    return out


def quoted(lines: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Stretches of lines of one quote level above 0."""
    out: list[tuple[int, list[str]]] = []
    last = 0
    for level, line in lines:
        if level:
            if level != last:
                out.append((level, []))
            out[-1][1].append(line)
        last = level
    return out


PASSAGE = pa.struct([("digest", pa.binary()), ("level", pa.int32()), ("words", pa.int32())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, own, cited, counts, deepest = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            lines = levels(text or "")
            body = own_words(lines)
            blocks = quoted(lines)
            bodies.append(body if text is not None else None)
            own.append([(d, 0, n) for d, n in passages(body.split("\n")).items()] if body else [])
            found: dict[tuple[bytes, int], int] = {}
            for level, block in blocks:
                found |= {(d, level): n for d, n in passages(block).items()}
            cited.append([(d, level, n) for (d, level), n in found.items()])
            counts.append(len(blocks))
            deepest.append(max((b[0] for b in blocks), default=0))
        digests = [sha256((b or "").encode()).hexdigest() for b in bodies]
        columns = [pa.array(bodies, pa.string()), pa.array(own, pa.list_(PASSAGE)), pa.array(cited, pa.list_(PASSAGE)), pa.array(counts, pa.int64()), pa.array(deepest, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.select(["conv_id", "turn", "role"]).columns, *columns], names=["conv_id", "turn", "role", "body", "own", "cited", "n_quotes", "deepest", "body_sha256"])


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, body_sha256, n_quotes, deepest, origins, reply_to, thread and place of every message.

    Lines are given their quote level; passages quoted at any level are hashed in normalised form (whole, by paragraph
    and by line) and joined to the first message of the conversation that says them in its own words, if that comes
    before. ``origins`` holds, by rising level, the message whose passage is quoted there with most words; it is null if
    there is none. A message replies to the origin of its lowest level that has one; its thread is where following
    replies ends. Passages of any length count, single short lines too. Letters of
    scripts without spaces count as words. ``place`` orders a conversation by thread and turn, so that replies stand behind what
    they answer. ``body`` is the text without quotes.

    Null texts have a null body and quote nothing; a null conv_id is a conversation whose messages are not linked;
    a null turn is never an original. Messages repeated under one turn are rows of their own with the same links.
    Passages said by very many messages, or in a conversation with a third of all rows, are reduced to their first
    by minima combined before the shuffle.
    """
    schema = messages.schema
    conv, turn, role = (schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role"))
    passage = "array<struct<digest:binary,level:int,words:int>>"
    parsed = messages.select("conv_id", "turn", "role", "text").mapInArrow(_parse, f"conv_id {conv}, turn {turn}, role {role}, body string, own {passage}, cited {passage}, n_quotes long, deepest long, body_sha256 string")
    parsed = stage(parsed, "quote-messages")
    cited = stage(parsed.select("conv_id", "turn", F.inline("cited")).where("turn is not null").distinct(), "quote-cited")
    said = parsed.select("conv_id", "turn", F.inline("own")).join(cited.select("conv_id", "digest").distinct(), ["conv_id", "digest"], "left_semi")
    first = stage(said.groupBy("conv_id", "digest").agg(F.min("turn").alias("origin")), "quote-origins")
    linked = cited.join(first, ["conv_id", "digest"]).where("origin < turn")
    best = linked.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("words", "origin")).alias("best")).select("conv_id", "turn", F.struct("level", F.col("best.origin").alias("origin")).alias("found"))
    replies = best.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("found")).alias("origins")).withColumn("reply_to", F.col("origins")[0]["origin"])
    replies = stage(replies, "quote-replies")
    roots = replies.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:  # each round doubles the length of the chains that are followed
        up = roots.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("higher"))
        longer = roots.join(up, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        moved = stage(longer.select("conv_id", "turn", F.coalesce("higher", "thread").alias("thread"), F.col("higher").isNotNull().alias("moved")), "quote-threads")
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    known = stage(replies.join(roots, ["conv_id", "turn"]), "quote-links")
    rows = parsed.drop("own", "cited").join(known, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    return placed(rows, "conv_id", ["thread", "turn"], "place")
