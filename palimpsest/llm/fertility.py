"""Quality rules by tokeniser fertility: how public vocabularies cut a text into tokens.

Each word is encoded as it stands after one space, with a byte-level vocabulary and with one of pieces that falls
back to bytes for characters it lacks. A text's characters per token, its share of fallback bytes among pieces and
the entropy of its tokens have to lie in the bands of its language, or of the script that most of its letters are in.
Counts of words, symbols, repeated lines and repeated word runs come first; what fails on them needs no tokeniser's word.
Each distinct word is encoded once in a process, so the work beyond counting grows with new words, not with text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_words, table, text_chunks
from .quality import _bytes_of
from .token_ids import known, tokenizer

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
LEAST_WORDS = 50
MOST_REPEATED = 50  # of 100 words
RUN = 3
SYMBOLS = b"#*$%&|<>"
MOST_KNOWN = 400_000


class Band(NamedTuple):
    """Least and most characters per token, most share of fallback bytes among pieces, least bits of token entropy.

    Entropy grows with a text's length: the least is entropy + SLOPE log2 tokens, up to LONG tokens.
    """

    least: float
    most: float
    fallback: float
    entropy: float


SLOPE, LONG = 0.5, 512
# Scripts as ranges of code points (fixed values of Unicode's blocks), in order.
SCRIPTS = [
    (0x41, 0x5B, "latin"), (0x61, 0x7B, "latin"), (0xAA, 0xAB, "latin"), (0xBA, 0xBB, "latin"), (0xC0, 0x250, "latin"), (0x370, 0x400, "greek"), (0x400, 0x530, "cyrillic"),
    (0x530, 0x590, "armenian"), (0x590, 0x600, "hebrew"), (0x600, 0x780, "arabic"), (0x900, 0xE00, "indic"), (0xE00, 0xF00, "thai"), (0x10A0, 0x1100, "georgian"), (0x1100, 0x1200, "hangul"),
    (0x1E00, 0x1F00, "latin"), (0x1F00, 0x2000, "greek"), (0x3040, 0x3100, "kana"), (0x3400, 0xA000, "han"), (0xAC00, 0xD7B0, "hangul"), (0x20000, 0x32000, "han"),
]
# A vocabulary made for English cuts other scripts finer, down to the bytes of a character.
BANDS = {
    "latin": Band(1.2, 9.0, 0.25, 1.2), "greek": Band(0.4, 5.0, 0.4, 0.6), "cyrillic": Band(0.4, 5.0, 0.4, 0.8), "hebrew": Band(0.4, 4.0, 0.6, 0.5), "arabic": Band(0.4, 4.0, 0.7, 0.5),
    "han": Band(0.3, 3.0, 0.8, 0.8), "kana": Band(0.3, 3.0, 0.8, 0.6), "hangul": Band(0.25, 3.0, 0.95, 0.5), "other": Band(0.25, 6.0, 1.0, 0.0),
    "en": Band(1.4, 9.0, 0.15, 1.6), "de": Band(1.3, 9.0, 0.15, 1.5), "fr": Band(1.25, 9.0, 0.15, 1.4), "es": Band(1.25, 9.0, 0.15, 1.4),
}
LANGUAGES = {"en": "latin", "de": "latin", "fr": "latin", "es": "latin"}  # a language's band holds for texts in its script
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, reason string"
)


@lru_cache(maxsize=2)
def pieces(name: str):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())]), {}


def _pieces_of(words: list[str], name: str) -> tuple[np.ndarray, np.ndarray]:
    """How many pieces each word has, and how many of them are fallback bytes."""
    model, is_byte, cache = pieces(name)
    if len(cache) > MOST_KNOWN:
        cache.clear()
    new = [w for w in words if w not in cache]
    for a in range(0, len(new), 10_000):
        part = new[a : a + 10_000]
        ids = model.encode(part, num_threads=1)
        each = np.array([len(x) for x in ids], np.int64)
        total = np.concatenate(([0], np.cumsum(is_byte[np.fromiter((i for x in ids for i in x), np.int64, int(each.sum()))])))
        ends = np.cumsum(each)
        cache.update(zip(part, (each << 32 | (total[ends] - total[ends - each])).tolist()))
    both = np.fromiter((cache[w] for w in words), np.int64, len(words))
    return both >> 32, both & 0xFFFFFFFF


def _per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between the edges of rows."""
    sums = np.concatenate((np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)))
    return sums[edges[1:]] - sums[edges[:-1]]


def repeated_lines(col: pa.Array) -> np.ndarray:
    """Per text: its lines that hold a word and equal an earlier one."""
    lines = pc.split_pattern(col, "\n")
    row = np.repeat(np.arange(len(col)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    coded = lines.flatten().dictionary_encode()
    spoken = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(code):
        return np.zeros(len(col), np.int64)
    good = spoken[code]
    row, code = row[good], code[good]
    key = np.unique(row * (len(spoken) + 1) + code)
    return np.bincount(row, minlength=len(col)) - np.bincount(key // (len(spoken) + 1), minlength=len(col))


def repeated_run_words(code: np.ndarray, size: int, offsets: np.ndarray) -> np.ndarray:
    """Per text: its words that lie in a run of RUN words which the text holds twice or more."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    covered = np.zeros(len(code) + 1, np.int64)
    n = len(code) - RUN + 1
    if n > 0:
        key = code[:n].astype(np.int64)
        for k in range(1, RUN):
            if size > (1 << 62) // (int(key.max()) + 1):  # numbered anew where products would not fit
                _, key = np.unique(key, return_inverse=True)
            key = key * size + code[k : k + n]
        inside = np.flatnonzero(row[:n] == row[RUN - 1 :])
        order = inside[np.argsort(key[inside], kind="stable")]  # equal runs of a text are neighbours, in order
        same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        start = order[twice]
        covered[start] += 1
        np.subtract.at(covered, start + RUN, 1)
    return _per_row(np.cumsum(covered)[:-1] > 0, offsets)


def token_entropy(ids: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """Bits of entropy of the tokens of every row."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    key = np.sort(row * size + ids)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(at, len(key))).astype(float)
    n = np.maximum(np.diff(edges), 1).astype(float)
    weighted = np.bincount(key[at] // size, weights=count * np.log2(np.maximum(count, 1)), minlength=len(n))
    return np.maximum(np.log2(n) - weighted / n, 0.0)


def scripts(words: pa.Array, code: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The script of most letters of every row; of equal ones the first of SCRIPTS, and other where there are no letters."""
    names = list(dict.fromkeys(s for _, _, s in SCRIPTS))
    text = "".join(words.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(length)))
    low, high = np.array([s[0] for s in SCRIPTS]), np.array([s[1] for s in SCRIPTS])
    at = np.maximum(np.searchsorted(low, points, side="right") - 1, 0)
    inside = (points >= low[at]) & (points < high[at])
    kind = np.where(inside, np.array([names.index(s[2]) for s in SCRIPTS])[at], -1)
    letters = np.stack([_per_row(_per_row(kind == k, edges)[code], offsets) for k in range(len(names))])
    best = letters.argmax(axis=0)
    return [names[b] if letters[b, i] else "other" for i, b in enumerate(best.tolist())]


def band_of(lang: str | None, script: str, bands: dict[str, Band]) -> Band:
    if lang in bands and LANGUAGES.get(lang) == script:
        return bands[lang]
    return bands.get(script, bands["other"])


def verdict(band: Band, per_token: float, fallback: float, entropy: float, n_tokens: int) -> str | None:
    """The first rule that a text breaks."""
    if per_token < band.least:
        return "few characters per token"
    if per_token > band.most:
        return "many characters per token"
    if fallback > band.fallback:
        return "byte fallback"
    if entropy < band.entropy + SLOPE * math.log2(min(max(n_tokens, 1), LONG)):
        return "token entropy"
    return None


def _judged(bands: dict[str, Band], vocabulary: str, fallback_vocabulary: str):
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = tokenizer(vocabulary).get_vocab_size()
        for batch, col in text_chunks(batches):
            data, edges = _bytes_of(col)
            flat, offsets = split_words(col)
            coded = flat.dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(offsets)
            chars = _per_row(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[code], offsets)
            repeats = repeated_run_words(code, max(len(words), 1), offsets)
            failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
            listed = words.to_pylist()
            cache = known(vocabulary)
            begin, length = cache.ids_of([" " + w for w in listed])
            many = length[code]
            ends = np.cumsum(many)
            ids = cache.values[np.repeat(begin[code] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)]
            token_edges = np.concatenate(([0], ends))[offsets]
            tokens = np.diff(token_edges)
            in_pieces, in_bytes = _pieces_of(listed, fallback_vocabulary)
            per_token = chars / np.maximum(tokens, 1)
            fallback = _per_row(in_bytes[code], offsets) / np.maximum(_per_row(in_pieces[code], offsets), 1)
            entropy = token_entropy(ids, token_edges, size)
            script = scripts(words, code, offsets)
            reason = []
            for lang, s, bad, p, f, e, t, w in zip(batch.column(2).to_pylist(), script, failed.tolist(), per_token.tolist(), fallback.tolist(), entropy.tolist(), tokens.tolist(), n.tolist()):
                reason.append(("few words" if w < LEAST_WORDS else "repeated runs") if bad else verdict(band_of(lang, s, bands), p, f, e, t))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n), pa.array(chars), pa.array(_per_row(symbol[data], edges)), pa.array(repeated_lines(col)), pa.array(repeats), pa.array(failed), pa.array([r is None for r in reason], pa.bool_()),
                    pa.array(script, pa.string()), pa.array(tokens), pa.array(per_token), pa.array(fallback), pa.array(entropy), pa.array(reason, pa.string()),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return run


def fertility_rules(docs: DataFrame, lang: Column | None = None, bands: dict[str, Band] = BANDS, vocabulary: str = BYTES, fallback_vocabulary: str = PIECES) -> DataFrame:
    """Per row of docs: counts of its words, symbols, repeated lines and runs, its measures, kept, and the rule it breaks.

    docs needs doc_id and text; lang may be a column on them that names the language; other columns are ignored.
    base_failed: fewer than LEAST_WORDS words, or over MOST_REPEATED of 100 words in repeated runs; such a text is not
    kept, nor is one with a measure outside its band (a measure on a band's border is inside). A language's band holds
    only for texts in its script; scripts without a band, and texts without letters, have that of "other". A null,
    empty or blank text has no words and fails the base; very long texts are measured whole; rows without a doc_id and
    repeated rows are each judged; an empty table gives an empty result.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(None) if lang is None else lang).cast("string").alias("lang"))
    return src.mapInArrow(_judged(bands, vocabulary, fallback_vocabulary), SCHEMA)


def op11_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(table(spark, sf_dir, "documents"), F.col("lang"))
