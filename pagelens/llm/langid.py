"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels the spans.

Model: for each language the counts of hashed byte n-grams (1 to 4 bytes, inside a word with its boundaries) and of
the scripts its words are written in, over every learning row; its size is fixed by `BUCKETS` and `MAX_LANGUAGES`.

A word's candidates are the languages that write at least `SCRIPT_SHARE` of their words in its script.  Its score for a
candidate is the sum of log-probabilities of its n-grams, below the best candidate's by `CLIP` at most; languages that
are no candidates get -CLIP, and words without letters score zero everywhere.  The best sequence of labels pays
`SWITCH` for each change of language, found by the Viterbi recursion, run position by position over many texts at
once.  A text's language is the one with most letters under its label (ties: the first in alphabetical order).

Defined results: null text or no letters: `und`, score 0, no spans; no learning rows: `und` everywhere; null doc_ids
and repeated rows keep their rows, and repeated learning rows count as often as they occur; a word is what stands
between white space, its script that of its first letter; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import Words, held_out, slices, string_bytes

ORDERS = 4
BUCKETS = 1 << 15
MAX_LANGUAGES = 256
SCRIPT_SHARE = 0.01
CLIP = 12.0
SWITCH = 8.0
#: First code point of each script range, in natural order (others: script 0).
SCRIPT_RANGES = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = np.array([0, *(start for start, _ in SCRIPT_RANGES)])
_SCRIPT = np.array([SCRIPTS.index("other"), *(SCRIPTS.index(name) for _, name in SCRIPT_RANGES)])
SIZE = ORDERS * BUCKETS + len(SCRIPTS)


class WordGrams:
    """Hashed n-grams of different words: `bucket[i]` belongs to word `word[i]`; letters and script by word."""

    def __init__(self, words: pa.Array):
        clean = pc.replace_substring_regex(words, r"[^\p{L}\p{M}]+", "")
        self.letters = pc.utf8_length(pc.replace_substring_regex(clean, r"\p{M}+", "")).to_numpy(zero_copy_only=False).astype(np.int64)
        first = pc.fill_null(pc.utf8_slice_codeunits(clean, 0, 1), "").to_pylist()
        points = np.array([ord(c) if c else 0 for c in first], np.int64)
        self.script = _SCRIPT[np.searchsorted(_STARTS, points, side="right") - 1]
        data, offsets = string_bytes(pc.binary_join_element_wise(" ", clean, " ", ""))
        data = data.astype(np.uint32)
        word = np.repeat(np.arange(len(words)), np.diff(offsets))
        left = offsets[1:][word] - np.arange(len(data)) if len(data) else word
        buckets, owners = [], []
        mixed = np.zeros(len(data), np.uint32)
        for n in range(1, ORDERS + 1):
            mixed[: len(data) - n + 1] = (mixed[: len(data) - n + 1] ^ data[n - 1 :]) * np.uint32(0x01000193)
            good = (left >= n) & (self.letters[word] > 0)
            buckets.append(((mixed[good] * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64) + (n - 1) * BUCKETS)
            owners.append(word[good])
        self.bucket, self.word = np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    #: log-probabilities, bucket by language
    grams: np.ndarray
    #: whether a language writes in a script, script by language
    writes: np.ndarray


def learn(rows: DataFrame) -> Model:
    """Count over all rows (text, lang) with a text and a lang; the result has a fixed size for each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                grams = WordGrams(words.unique)
                by_row = part.column("lang").dictionary_encode()
                lang_of_word = by_row.indices.to_numpy(zero_copy_only=False)[words.text_of_word()]
                for k, lang in enumerate(by_row.dictionary.to_pylist()):
                    uses = np.bincount(words.codes[lang_of_word == k], minlength=len(words.unique))
                    have = counts.setdefault(lang, np.zeros(SIZE, np.int64))
                    have[: ORDERS * BUCKETS] += np.bincount(grams.bucket, weights=uses[grams.word], minlength=ORDERS * BUCKETS).astype(np.int64)
                    have[ORDERS * BUCKETS :] += np.bincount(grams.script, weights=uses * (grams.letters > 0), minlength=len(SCRIPTS)).astype(np.int64)
        for lang, have in counts.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(have[at])], ["lang", "bucket", "n"])

    known = rows.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    found = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # Bounded: SIZE rows for each language.
    found = found.toPandas()
    sizes = found.groupby("lang")["n"].sum().sort_values(ascending=False, kind="stable")
    languages = sorted(sizes.index[:MAX_LANGUAGES])
    counts = np.zeros((SIZE, len(languages)), np.float64)
    found = found[found["lang"].isin(languages)]
    counts[found["bucket"].to_numpy(np.int64), np.searchsorted(languages, found["lang"].tolist()) if languages else np.zeros(0, np.int64)] = found["n"]
    grams = counts[: ORDERS * BUCKETS].reshape(ORDERS, BUCKETS, -1)
    grams = np.log((grams + 0.1) / (grams.sum(1, keepdims=True) + 0.1 * BUCKETS))
    scripts = counts[ORDERS * BUCKETS :]
    return Model(languages, grams.reshape(ORDERS * BUCKETS, -1).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0, keepdims=True), 1))


def word_scores(model: Model, grams: WordGrams) -> np.ndarray:
    """Scores of the different words, word by language: 0 for the best candidate, -CLIP at least."""
    n, k = len(grams.letters), len(model.languages)
    scores = np.empty((n, k))
    for j in range(k):
        scores[:, j] = np.bincount(grams.word, weights=model.grams[grams.bucket, j], minlength=n)
    candidates = model.writes[grams.script]
    candidates[~candidates.any(1)] = True
    scores = np.where(candidates, scores, -np.inf)
    scores = np.maximum(scores - scores.max(1, keepdims=True), -CLIP)
    scores[grams.letters == 0] = 0
    return scores.astype(np.float32)


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label for each position of each sequence scores[offsets[i]:offsets[i + 1]] under the switching penalty."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    stays = np.zeros(scores.shape, bool)
    best_before = np.zeros(len(scores), np.int16)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    value = scores[starts[: active[0]]].astype(np.float64)
    last = np.zeros(len(lengths), np.int64)
    for t in range(1, int(lengths[0])):
        n = active[t]
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(1)
            value = value[:n]
        at = starts[:n] + t
        best = value.argmax(1)
        leave = value[np.arange(n), best][:, None] - switch
        stay = value >= leave
        best_before[at], stays[at] = best, stay
        value = np.where(stay, value, leave) + scores[at]
    last[: len(value)] = value.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = active[t]
        at, now = starts[:n] + t, last[:n]
        labels[at] = now
        if t:
            last[:n] = np.where(stays[at, now], now, best_before[at])
    return labels


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are runs of words (from, to, lang); score is the share of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        span = pa.struct([("from_word", pa.int32()), ("to_word", pa.int32()), ("lang", pa.string())])
        names = pa.array([*model.languages, "und"], pa.string())
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                grams = WordGrams(words.unique)
                n = words.n_texts
                if not k:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(["und"] * n, pa.string()), pa.array([0.0] * n, pa.float64()), pa.array([[]] * n, pa.list_(span))], ["doc_id", "lang_pred", "score", "spans"])
                    continue
                text = words.text_of_word()
                letters = grams.letters[words.codes]
                labels = viterbi(word_scores(model, grams)[words.codes], words.offsets, switch)
                share = np.bincount(text * k + labels, weights=letters, minlength=n * k).reshape(n, k)
                total = share.sum(1)
                winner = np.where(total > 0, share.argmax(1), k)
                score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
                change = np.ones(len(labels), bool)
                change[1:] = (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])
                change &= total[text] > 0
                begin = np.flatnonzero(change)
                end = np.append(begin[1:], len(labels)) if len(begin) else begin
                end = np.minimum(end, words.offsets[text[begin] + 1])
                base = words.offsets[text[begin]]
                spans = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), names.take(pa.array(labels[begin].astype(np.int32)))], fields=list(span))
                per_text = np.concatenate(([0], np.cumsum(np.bincount(text[begin], minlength=n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), names.take(pa.array(winner.astype(np.int32))), pa.array(score), pa.ListArray.from_arrays(pa.array(per_text), spans)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<from_word:int,to_word:int,lang:string>>")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and label all rows."""
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
