"""Quality rules on words and lines, and on how well public vocabularies fit a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.batches import SPACED, mix, per_row, slices, span_hashes, utf8, words

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 3
CACHED_WORDS = 100_000
# lead bytes of letters by script; the first script also holds ASCII letters
SCRIPTS = {"latin": range(0xC3, 0xCA), "greek": range(0xCD, 0xD0), "cyrillic": range(0xD0, 0xD4), "semitic": range(0xD6, 0xDC), "indic": range(0xE0, 0xE2), "cjk": range(0xE3, 0xEE)}


@dataclass(frozen=True)
class Band:
    """Texts outside of it are rejected: code points per token, share of byte-fallback tokens, entropy of the tokens in bits.

    The floor on code points per token is ``least_chars - few / tokens``, as a mean over few tokens varies more, or the
    lowest of such floors if there are ``others``.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    least_bits: float = 4.5
    most_bits: float = 14.0
    few: float = 0.0
    others: tuple[tuple[float, float], ...] = ()

    def floor(self, tokens: int) -> float:
        return min(least - few / max(1, tokens) for least, few in ((self.least_chars, self.few), *self.others))


@dataclass(frozen=True)
class Fertility:
    """A vocabulary file and its bands: by language code, else by the script of most letters, else ``other``.

    Natural prose of a language lies inside, while letter soup, symbol runs, text in another script and a word said
    over and over fall out. Floors of Latin text stand just below the lowest clean text measured in the language; random
    letters have 1.3 to 1.7 code points per token, seldom more. Text in a language without a band of its own has the
    lowest of the listed floors. Bands judge a text by itself, so a
    verdict does not change with the rest of the corpus.
    """

    vocabulary: str
    languages: dict[str, Band] = field(default_factory=lambda: {"en": Band(1.88, 7.0, 0.02, few=25.0), "de": Band(1.88, 7.0, 0.02, few=25.0), "fr": Band(1.825, 7.0, 0.02, few=40.0), "es": Band(1.76, 7.0, 0.02, few=25.0)})
    scripts: dict[str, Band] = field(default_factory=lambda: {"latin": Band(1.76, 8.0, 0.05, few=25.0, others=((1.825, 40.0),)), "greek": Band(0.6, 5.0, 0.1), "cyrillic": Band(1.0, 6.0, 0.05), "semitic": Band(0.6, 5.0, 0.1), "indic": Band(0.3, 4.0, 0.5), "cjk": Band(0.25, 2.5, 0.5)})
    other: Band = Band(0.25, 8.0, 0.5)


class Vocabulary:
    """Encodes words by themselves, each one once as long as it stays in a cache of bounded size."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[int, list[int]] = {}

    def encode(self, keys: np.ndarray, spans: list[bytes]) -> list[list[int]]:
        known = self.known
        new = [i for i, k in enumerate(keys) if k not in known]
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = range(len(keys))
        fresh = self.model.encode([spans[i].decode("utf-8", "replace") for i in new], num_threads=1)
        known.update(zip((keys[i] for i in new), fresh, strict=True))
        return [known[k] for k in keys]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs again, and whether it occurred before (by position)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, before = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    before[order[1:]] = same
    return again, before


def _keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(hashes + rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _base(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    inside = SPACED[data]
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": per_row(inside & (data & 0xC0 != 0x80), offsets), "n_symbols": per_row(SYMBOLS[data], offsets)}
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    finish = np.sort(np.concatenate([breaks, offsets[1:]]))
    owner = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1]))
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[finish] > filled[begin]
    begin, finish, owner = begin[worded], finish[worded], owner[worded]
    _, before = _repeats(_keyed(span_hashes(data, begin, finish), owner))
    out["n_dup_lines"] = np.bincount(owner[before], minlength=n)
    hit = np.zeros(len(rows), dtype=bool)
    if len(rows) >= WINDOW:
        whole = rows[WINDOW - 1 :] == rows[: 1 - WINDOW]
        window = hashes[: 1 - WINDOW]
        for i in range(1, WINDOW):
            window = mix(window) + hashes[i : len(hashes) + i + 1 - WINDOW]
        at = np.flatnonzero(whole)
        again, _ = _repeats(_keyed(window[at], rows[at]))
        for i in range(WINDOW):
            hit[at[again] + i] = True
    out["n_repeat_words"] = np.bincount(rows[hit], minlength=n)
    return out


def _fit(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray, n: int) -> dict[str, np.ndarray]:
    keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    held = vocabulary.encode(keys.tolist(), [raw[starts[i] : ends[i]] for i in first])
    sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
    flat = np.fromiter(chain.from_iterable(held), dtype=np.int64, count=int(sizes.sum()))
    fallback = np.add.reduceat(np.concatenate([vocabulary.fallback[flat], [False]]).astype(np.int64), (np.cumsum(sizes) - sizes)) * (sizes > 0) if len(held) else sizes
    tokens = np.bincount(rows, weights=sizes[which], minlength=n)
    of_bytes = np.bincount(rows, weights=fallback[which], minlength=n)
    # counts of each token of each row: words of a row are counted first, so a common word spreads its tokens once
    pair, count = np.unique(rows * len(keys) + which, return_counts=True) if len(rows) else (np.empty(0, np.int64), np.empty(0, np.int64))
    row, word = pair // max(1, len(keys)), pair % max(1, len(keys))
    spread = sizes[word]
    place = np.repeat((np.cumsum(sizes) - sizes)[word] - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())
    vocab = len(vocabulary.fallback)
    cell = np.repeat(row, spread) * vocab + flat[place]
    weight = np.repeat(count, spread)
    order = np.argsort(cell, kind="stable")
    cell, weight = cell[order], weight[order]
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
    sums = np.add.reduceat(weight, heads).astype(float) if len(heads) else np.empty(0)
    logs = np.bincount(cell[heads] // vocab, weights=sums * np.log2(sums), minlength=n) if len(heads) else np.zeros(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(tokens > 0, np.log2(tokens) - logs / tokens, 0.0)
        share = np.where(tokens > 0, of_bytes / tokens, 0.0)
    return {"n_tokens": tokens.astype(np.int64), "byte_share": share, "token_bits": np.round(bits, 9)}


def _scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    counts = []
    for name, leads in SCRIPTS.items():
        table = np.zeros(256, dtype=bool)
        table[[*leads, *(range(0x41, 0x5B) if name == "latin" else ()), *(range(0x61, 0x7B) if name == "latin" else ())]] = True
        counts.append(per_row(table[data], offsets))
    counts = np.stack(counts)
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), -1)


def _measure(options: Fertility, text: str, lang: str | None, only: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(options.vocabulary)
        names = list(options.scripts)
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            n = batch.num_rows
            starts, ends, rows = words(data, offsets, SPACED)
            hashes = span_hashes(data, starts, ends)
            out = _base(data, offsets, starts, ends, rows, hashes) | _fit(vocabulary, data, starts, ends, rows, hashes, n)
            out["chars_per_token"] = np.where(out["n_tokens"] > 0, out["word_chars"] / np.maximum(1, out["n_tokens"]), 0.0)
            codes = batch.column(lang).to_pylist() if lang else [None] * n
            scripts = [names[i] if 0 <= i < len(names) else None for i in _scripts(data, offsets)]
            bands = [options.languages.get(c) or options.scripts.get(s, options.other) for c, s in zip(codes, scripts, strict=True)]
            most, fallback, low, high = (np.array([getattr(b, k) for b in bands]) for k in ("most_chars", "most_bytes", "least_bits", "most_bits"))
            least = np.array([b.floor(k) for b, k in zip(bands, out["n_tokens"].tolist(), strict=True)])
            fits = (out["chars_per_token"] >= least) & (out["chars_per_token"] <= most) & (out["byte_share"] <= fallback) & (out["token_bits"] >= low) & (out["token_bits"] <= high)
            out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
            out["kept"] = ~out["base_failed"] & fits
            if only:
                yield batch.filter(pa.array(out["kept"]))
                continue
            added = {k: pa.array(out[k]) for k in ADDED}
            kept = [i for i, f in enumerate(batch.schema) if f.name not in added]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(added.values()), names=[batch.schema.names[i] for i in kept] + list(added))

    return run


ADDED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "token_bits": "double"}


def judge(documents: DataFrame, options: Fertility, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Adds the measures and the verdict ``kept`` to every document; columns of these names are replaced.

    The base rules fail texts of fewer than 50 words and those of which over half the words lie in 3-word
    windows found twice or more. What passes is kept if the vocabulary fits: each word is encoded by itself
    and code points per token, byte-fallback share and token entropy must lie in the band of the text's
    language, or else of its script. Null and empty texts have no words and fail. One pass without a
    shuffle; a long text is a slice of its own. Repeated rows get the same verdict.
    """
    documents = documents.select(*[c for c in documents.columns if c not in ADDED])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", " + ", ".join(f"{k} {v}" for k, v in ADDED.items())
    return documents.mapInArrow(_measure(options, text, lang if lang in documents.columns else None), schema)


def keep_good(documents: DataFrame, options: Fertility, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The documents that ``judge`` keeps, with the columns they came with, whatever their names."""
    return documents.mapInArrow(_measure(options, text, lang if lang in documents.columns else None, only=True), documents.schema)
