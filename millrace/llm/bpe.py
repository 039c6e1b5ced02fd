"""Byte-level BPE with content-defined chunks: shared chunks are encoded once, joins are re-encoded."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.batches import slices, utf8
from millrace.llm.chunks import cuts

CHUNK_BITS = 10
CACHED_BYTES = 8 << 20

# fixed value: how the byte-level splitter parts a text before the merges
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# bytes of line feeds, printable ASCII and U+00C0 to U+023F
PLAIN = bytes([0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)])

Piece = tuple[np.ndarray, str, str]


class Codec:
    """A tokenizer file with a cache of bounded size for pieces of text.

    Pieces of plain Latin text go through a rank encoder made from the file's own vocabulary, which gives the
    same ids faster; other characters, special tokens and other kinds of files go through the file's tokenizer.
    """

    def __init__(self, path: str):
        self.path = path
        self.ranks, self.marks, size = _rank_encoder(path)
        self.digits = [str(i) for i in range(size)]
        self.known: dict[str, Piece] = {}
        self.held = 0

    @cached_property
    def model(self):
        """The file's own tokenizer, loaded when a text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.no_truncation()
        model.no_padding()
        return model

    def forget(self) -> None:
        """Empties the cache: an idle worker keeps its process, so a task gives the room back."""
        self.known, self.held = {}, 0

    def plain(self, raw: bytes) -> bool:
        """Whether the rank encoder may have a text: line feeds, printable ASCII, Latin letters, no special token."""
        return self.ranks is not None and not raw.translate(None, PLAIN) and not any(m in raw for m in self.marks)

    def encode(self, text: str, plain: bool) -> list[int]:
        return self.ranks.encode_ordinary(text) if plain else self.model.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int], plain: bool) -> str:
        return self.ranks.decode(ids) if plain else self.model.decode(ids, skip_special_tokens=False)

    def piece(self, text: str, plain: bool) -> Piece:
        """Ids, ids joined by commas, and decoded text; a piece met before is not encoded again."""
        found = self.known.get(text)
        if found is None:
            if self.held > CACHED_BYTES:
                self.forget()
            ids = self.encode(text, plain)
            back = self.decode(ids, plain)
            found = self.known[text] = np.array(ids, dtype=np.int32), ",".join([self.digits[i] for i in ids]), text if back == text else back
            self.held += len(text)
        return found


def _rank_encoder(path: str):
    """An encoder by ranks if the file is a byte-level BPE whose ids follow its merges, the special tokens that it
    doesn't know, and how many ids there are."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    marks = [t["content"] for t in file.get("added_tokens", [])]
    size = 1 + max([*model["vocab"].values(), *(t["id"] for t in file.get("added_tokens", []))])
    usual = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    usual = usual and not file.get("normalizer") and not file.get("post_processor") and not model.get("dropout") and not model.get("ignore_merges")
    if not usual:
        return None, [], size
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256
    shown = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if token not in marks}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    if len(ranks) != 256 + len(merged) or any(model["vocab"][m] != 256 + i for i, m in enumerate(merged)):
        return None, [], size
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), [m.encode() for m in marks], size


def safe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a join can be expected to agree: at a space or line feed after a printable ASCII byte of the same row."""
    at = np.flatnonzero(((data[1:] == 0x20) | (data[1:] == 0x0A)) & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1 if len(data) else np.empty(0, np.int64)
    return at[~np.isin(at, offsets)]


def _split(data: np.ndarray, offsets: np.ndarray, bits: int, points: np.ndarray) -> np.ndarray:
    """Where pieces begin. A chunk gives the stretch from its first to its last point; what lies between two such
    stretches holds a cut and is a piece of its own, as are the ends of a row."""
    begin = cuts(data, offsets, bits)
    row = np.searchsorted(offsets, begin, side="right") - 1
    stop = np.minimum(np.concatenate([begin[1:], [len(data)]]), offsets[row + 1])
    low, high = np.searchsorted(points, begin), np.searchsorted(points, stop, side="right") - 1
    inner = low < high
    return np.union1d(np.union1d(points[low[inner]], points[high[inner]]), offsets[:-1][np.diff(offsets) > 0])


def _around(text: str, at: int) -> tuple[str, str]:
    """The words on both sides of a place in a text, with the space around them."""
    low, high = at, at
    while low and text[low - 1].isspace():
        low -= 1
    while high < len(text) and text[high].isspace():
        high += 1
    low = max(text.rfind(" ", 0, low), text.rfind("\n", 0, low), 0)
    ends = [p for p in (text.find(" ", high), text.find("\n", high)) if p >= 0]
    return text[low:at], text[at : min(ends) + 1 if ends else len(text)]


def agreed(codec: Codec, parts: list[str], plain: bool, tried: dict[tuple[str, str, bool], bool]) -> list[str]:
    """Pieces whose ids in a row are the ids of the whole. At every join the word before and the word after are
    encoded in one; where that differs from encoding both sides, the pieces are made one."""
    text = "".join(parts)
    out, at = parts[:1], len(parts[0]) if parts else 0
    for part in parts[1:]:
        around = *_around(text, at), plain
        same = tried.get(around)
        if same is None:
            same = tried[around] = codec.encode(around[0] + around[1], plain) == codec.encode(around[0], plain) + codec.encode(around[1], plain)
        if same:
            out.append(part)
        else:
            out[-1] += part
        at += len(part)
    return out


def encode_rows(codec: Codec, column: pa.Array, bits: int = CHUNK_BITS, points: Callable[[np.ndarray, np.ndarray], np.ndarray] = safe) -> Iterator[list[Piece]]:
    """The pieces of every text in order; a null or empty text has none."""
    data, offsets = utf8(column)
    raw = data.tobytes()
    bounds = _split(data, offsets, bits, points(data, offsets))
    at = np.searchsorted(bounds, offsets).tolist()
    stops = np.append(bounds, len(data))[1:].tolist()
    text = [raw[a:b].decode() for a, b in zip(bounds.tolist(), stops, strict=True)]
    tried: dict[tuple[str, str, bool], bool] = {}
    for row in range(len(offsets) - 1):
        plain = codec.plain(raw[offsets[row] : offsets[row + 1]])
        yield [codec.piece(p, plain) for p in agreed(codec, text[at[row] : at[row + 1]], plain, tried)]


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    Texts are cut where a rolling hash says so, wherever that is. The stretch between the first and the last word
    boundary of a chunk is encoded once per task for all documents that hold it (up to a bounded cache); what lies
    around a cut is encoded by itself. Every join is then repaired: as long as an encoding that reaches over it
    differs from the encodings of its sides, these are made one piece. A text without word boundaries is one piece. Null and empty texts have no tokens and decode to
    nothing. One pass, no shuffle; repeated rows repeat their results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, text):
            counts, ids, back = [], [], []
            for pieces in encode_rows(own, batch.column(text)):
                counts.append(sum(len(p[0]) for p in pieces))
                ids.append(sha256(",".join([p[1] for p in pieces if p[1]]).encode()).hexdigest())
                back.append(sha256("".join([p[2] for p in pieces]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(back, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(documents: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """The documents with a column of token ids (empty for null and empty texts); a column of that name is replaced."""
    documents = documents.select(*[c for c in documents.columns if c != name])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + f", `{name}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, text):
            ids = [np.concatenate([p[0] for p in pieces]) if pieces else np.empty(0, np.int32) for pieces in encode_rows(own, batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, type=pa.list_(pa.int32()))], names=[*batch.schema.names, name])
        own.forget()

    return documents.mapInArrow(run, schema)


def decoded(records: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The records with the text that the ids stand for in column ``text``; null ids give null."""
    schema = records.select(*[c for c in records.columns if c != text]).schema
    names = schema.names
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            texts = iter(own.model.decode_batch([x for x in lists if x is not None], skip_special_tokens=False))
            back = pa.array([None if x is None else next(texts) for x in lists], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, back], names=[*names, text])

    return records.mapInArrow(run, out)
