"""Quality rules from tokenizer fertility.

A public subword vocabulary with byte fallback measures each text: characters per token,
the share of tokens that are single fallback bytes, and the entropy of the token
distribution. Each script has its band of accepted values; its limits widen with
1/sqrt(tokens), as measures of short texts scatter more. The bands were set from windows of 15
to 3,000 tokens of the translated messages of installed programs (38 languages, 200 to
9,000 sentences each): about their outer hundredth, and for Latin entropy
low enough for the invented prose of the test tables. Words are tokenized one
by one (each distinct word of a slice once), so the measures do not depend on spacing.

Next to it stand the base rules: repeated five-word windows, symbols and repeated lines.

Defined results: null and empty texts have no words, all counts 0, and fail the base
rule; a text without tokens is in band; Latin letters with many marks of Vietnamese have their
own band, as do texts of the many scripts with few pieces of their own (``other``); repeated rows are judged alike; an empty table gives an empty result; other columns pass through
(the added names must be free).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm import flat
from creditspark.llm.best_fit_packing import vocabulary_path
from creditspark.llm.registry import query, table

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
CACHE_WORDS = 300_000
SLICE = 4 << 20


class Band(NamedTuple):
    """Limits of one script for endless texts and, after each, how far sqrt(tokens) times they give way; entropy in bits."""

    low: float  # characters per token
    low_slack: float
    high: float
    high_slack: float
    most_bytes: float  # share of fallback bytes
    bytes_slack: float
    entropy: float  # bits per bit of log2(tokens), up to entropy_cap
    entropy_cap: float


ENTROPY_SLACK = 2.0
BANDS: dict[str, Band] = {
    "latin": Band(1.72, 2.0, 4.5, 9.0, 0.04, 1.0, 0.65, 5.2), "greek": Band(0.86, 0.8, 1.0, 6.0, 0.02, 0.3, 0.62, 4.0),
    "cyrillic": Band(1.84, 2.4, 2.7, 5.0, 0.02, 0.5, 0.65, 6.0), "arabic": Band(0.84, 0.8, 1.05, 6.0, 0.03, 0.9, 0.58, 3.7),
    "cjk": Band(0.72, 1.0, 1.3, 9.0, 0.20, 2.2, 0.62, 5.2), "other": Band(0.30, 0.8, 1.2, 8.0, 0.98, 0.2, 0.50, 3.5),
    "vietnamese": Band(1.19, 1.2, 1.45, 4.0, 0.04, 1.0, 0.65, 5.2)}
SCRIPTS = tuple(BANDS)
ADDED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, script string, "
         "chars_per_token double, fallback_share double, token_entropy double, in_band boolean")


def _script_table() -> np.ndarray:
    """Script number of a character's first byte; 255 marks bytes that say nothing."""
    t = np.full(256, 255, np.uint8)
    for low, high, name in ((0x41, 0x5B, "latin"), (0x61, 0x7B, "latin"), (0xC3, 0xCA, "latin"), (0xCD, 0xD0, "greek"), (0xD0, 0xD4, "cyrillic"),
                            (0xD8, 0xDC, "arabic"), (0xE3, 0xEE, "cjk"), (0xD4, 0xD8, "other"), (0xDC, 0xE3, "other"), (0xF0, 0xF5, "other")):
        t[low:high] = SCRIPTS.index(name)
    return t


_SCRIPT = _script_table()


def in_band(script, tokens, per_token, share, entropy, bands: Mapping[str, Band] = BANDS) -> np.ndarray:
    """Whether all three measures lie within the band of the text's script (its number in ``SCRIPTS``)."""
    limits = {k: np.array([getattr(bands[s], k) for s in SCRIPTS])[script] for k in Band._fields}
    n = np.maximum(tokens, 1)
    slack = 1 / np.sqrt(n)
    long_enough = per_token >= limits["low"] - limits["low_slack"] * slack
    short_enough = per_token <= limits["high"] + limits["high_slack"] * slack
    known = share <= limits["most_bytes"] + limits["bytes_slack"] * slack
    varied = entropy >= np.minimum(limits["entropy"] * np.log2(n), limits["entropy_cap"]) - ENTROPY_SLACK * slack
    return (tokens == 0) | (long_enough & short_enough & known & varied)


class WordPieces:
    """Word -> (token ids, number of fallback bytes); a bounded cache over the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.cache: dict[bytes, np.ndarray] = {}

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        missing = [w for w in words if w not in self.cache]
        for w, ids in zip(missing, self.model.encode([w.decode() for w in missing], num_threads=1) if missing else ()):
            self.cache[w] = np.array(ids, np.int32)
        return [self.cache[w] for w in words]


_PIECES: dict[str, WordPieces] = {}


def per_row(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of a byte mask over each row."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def scripts_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per row, the number of its most frequent script; Latin with 3 % letters of U+1E00 to U+1EFF or more is Vietnamese."""
    follows = np.zeros(len(buf), bool)
    follows[:-1] = (buf[:-1] == 0xE1) & (buf[1:] >= 0xB8) & (buf[1:] <= 0xBB)
    kinds = np.where(follows, SCRIPTS.index("vietnamese"), _SCRIPT[buf])
    counts = np.stack([per_row(kinds == i, starts, ends) for i in range(len(SCRIPTS))])
    latin, marked = SCRIPTS.index("latin"), counts[SCRIPTS.index("vietnamese")].copy()
    counts[latin] += marked
    counts[SCRIPTS.index("vietnamese")] = 0
    script = np.where(counts.max(0) > 0, counts.argmax(0), SCRIPTS.index("other"))
    return np.where((script == latin) & (marked > 0) & (100 * marked >= 3 * counts[latin]), SCRIPTS.index("vietnamese"), script)


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> np.ndarray:
    """Per row, the words inside windows of ``width`` words that occur twice or more in the row."""
    n = len(hashes)
    out = np.zeros(len(first) - 1, np.int64)
    if n < width:
        return out
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    windows = hashes[:n - width + 1].copy()
    for k in range(1, width):
        windows = flat.mix(windows) + hashes[k:n - width + 1 + k]
    inside = np.flatnonzero(row[:n - width + 1] == row[width - 1:])
    key, rows = windows[inside], row[inside]
    order = np.lexsort((key, rows))
    same = (key[order][1:] == key[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    covered = np.cumsum(edges)[:n] > 0
    return np.bincount(row[covered], minlength=len(out)).astype(np.int64)


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(flat.SPACES)]
    return len(lines) - len(set(lines))


def token_measures(buf, ws, we, hashes, first, pieces: WordPieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: tokens, fallback tokens and entropy of the token distribution in bits."""
    rows = len(first) - 1
    if not len(ws):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    ids = pieces.encode([raw[s:e] for s, e in zip(ws[index].tolist(), we[index].tolist())])
    lengths = np.array([len(x) for x in ids], np.int64)
    flat_ids, offsets = np.concatenate(ids), np.concatenate([[0], np.cumsum(lengths)])
    n = lengths[inverse]
    place = np.concatenate([[0], np.cumsum(n)])
    tokens = flat_ids[np.repeat(offsets[inverse] - place[:-1], n) + np.arange(place[-1])]
    total = place[first[1:]] - place[first[:-1]]
    row = np.repeat(np.arange(rows), total)
    fallback = np.bincount(row[pieces.bytes[tokens]], minlength=rows)
    key = np.sort((row << 20) | tokens)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts, owner = np.diff(np.append(new, len(key))), key[new] >> 20
    parts = np.bincount(owner, weights=counts * np.log2(counts), minlength=rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(total > 0, np.log2(np.maximum(total, 1)) - parts / np.maximum(total, 1), 0.0)
    return total, fallback, np.maximum(entropy, 0.0)


def measure_quality(df: DataFrame, text: str = "text", folder: str | None = None, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """Add base counts, fertility measures and ``in_band`` (the method's verdict) to each row."""
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(ADDED).fields)
    spaces, symbols = flat.byte_mask(flat.SPACES), flat.byte_mask(SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(VOCABULARY, folder)
        if path not in _PIECES:
            _PIECES[path] = WordPieces(path)
        for batch in flat.slices(batches, text, SLICE):
            buf, starts, ends = flat.text_bytes(flat.column(batch, text))
            ws, we, first = flat.word_bounds(buf, starts, ends, spaces)
            hashes = flat.range_hashes(buf, ws, we, lower=False)
            leads = (buf & 0xC0) != 0x80
            chars = per_row(leads & ~spaces[buf], starts, ends)
            script = scripts_of(buf, starts, ends)
            tokens, fallback, entropy = token_measures(buf, ws, we, hashes, first, _PIECES[path])
            least = np.maximum(tokens, 1)
            per_token, share = chars / least, fallback / least
            good = in_band(script, tokens, per_token, share, entropy, bands)
            raw = buf.tobytes()
            lines = [repeated_lines(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
            added = [np.diff(first), chars, per_row(symbols[buf], starts, ends), np.array(lines, np.int64), repeated_words(hashes, first), tokens]
            columns = [pa.array(x.astype(np.int64)) for x in added] + [pa.array([SCRIPTS[i] for i in script], pa.string())]
            columns += [pa.array(x.astype(float)) for x in (per_token, share, entropy)] + [pa.array(good)]
            yield pa.RecordBatch.from_arrays(batch.columns + columns, names=schema.names)

    return df.mapInArrow(run, schema)


@query("op8_fertility_rules")
def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all documents."""
    m = measure_quality(table(spark, sf_dir, "documents", "doc_id", "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    (~failed & F.col("in_band")).alias("kept"), "n_tokens", "script", "chars_per_token", "fallback_share", "token_entropy")
