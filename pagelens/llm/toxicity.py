"""Toxicity: noisy-channel deobfuscation, then a score of the restored words.

Restoring: a written word goes through a lattice of characters if it has a letter and a look-alike sign or something else
between letters, or repeats a character three times or more, whatever its length and share of digits; single characters between spaces, three or more in a row, are read as one string with
optional word ends.  Arcs: a letter stands for itself; look-alike signs (`LOOKALIKES`) may stand for a letter;
separators and repeated characters may be noise.  Viterbi picks the path with the best sum of channel costs and
log-probabilities of a character trigram model, which is counted over the letters of all texts.  At a word's edges the
signs `OPENING` and `CLOSING` are punctuation unless the reading as letters is likelier.  The `BEAM` best states are
kept, and readings are settled `LAG` letters behind the best one, so long words and runs cost in proportion to length.

Scoring: what is scored is each word's reading; where separators part a written word into several of three signs or more
(`you/idiot`), each part's reading too; and of scripts without spaces each run of four letters.  Features of a reading are
its beginnings of 2 to 12 characters and the whole reading.  A feature's weight is
the lower bound (`CAUTION` standard errors) of its log-odds between toxic and clean labelled texts, each different text
counted once; only features of `MIN_TOXIC` toxic texts and positive weight are kept.  A text's three figures are its
largest word weight, the log of the sum of its positive word weights over different words and their share of its words; a logistic regression
over them gives the score.  Weights come from rows whose id has remainders 2 to 4, the regression from remainder 1.

The character model counts every letter of every text in hashed buckets, so its size is fixed and nothing is left out.
Bounds of the classifier, as parameters: `max_labels` learning rows (the lowest ids by hash if there are more) and
`MAX_FEATURES` features of these (the most frequent).  Labels are joined by a broadcast of those bounded rows.

Defined results: null and empty texts are scored as texts without words; several labels of one id: the largest counts;
ids or labels that are null teach nothing; repeated documents are scored each; without labels of both kinds the score
is the share of toxic labels smoothed towards 0; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import Words, held_out, max_by_segment, remainder, rows_in_arrow, short_batches, slices, string_bytes

MAX_LABELS = 200_000
MAX_FEATURES = 100_000
MIN_TOXIC = 4
CAUTION = 2.0
BEGINNING = 12
#: Buckets for trigrams, pairs and single letters of the character model.
TRIPLES, PAIRS, SINGLES = 1 << 18, 1 << 16, 1 << 14
#: States that the lattice keeps, and letters behind the best reading from which on others must agree with it.
BEAM, LAG = 32, 64

#: Bytes of text that a task looks at together.
SLICE_BYTES = 2 << 20

#: The letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "×": "x", "µ": "u",
}
#: Costs of the channel's arcs in nats.
SIGN_COST, REPEAT_COST, SEPARATOR_COST, NOISE_COST, BREAK_COST = 1.5, 0.7, 1.0, 3.0, 4.0
SEPARATORS = set(" .-_*'~,:;/")
#: Pays for each letter put out, so that paths of different lengths compare.
LETTER_GAIN = 2.5

#: Look-alike signs that are punctuation first where a word begins or ends.
OPENING, CLOSING = "(<", "!|("

_EDGES = r"^[^\p{L}\p{N}@$!|+(<€£¥§×µ]+|[^\p{L}\p{N}@$!|+(<€£¥§×µ]+$"
_PARTS = regex.compile(r"[^\p{L}\p{M}\p{N}@$!|+(<€£¥§×µ]+")
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_RUNS = regex.compile(r"(\p{L})\1{3,}")
_ODD = r"\p{L}[^\p{L}\p{M}]+\p{L}|\p{L}.*[0-9@$!|+(<€£¥§×µ]|[0-9@$!|+(<€£¥§×µ].*\p{L}|µ"


def buckets(a, b, c) -> list:
    """The buckets of the trigram abc, of ab, bc, b and c; for integers or arrays of code points."""
    wide = lambda x, size: x % 4294967291 % size  # noqa: E731  products stay below 2 ** 63
    ends = [TRIPLES, TRIPLES + PAIRS, TRIPLES + 2 * PAIRS, TRIPLES + 2 * PAIRS + SINGLES]
    return [wide((a * 961 + b * 31 + c) * 1_000_003 + a * 7, TRIPLES), wide((a * 31 + b) * 1_000_003, PAIRS) + ends[0], wide((b * 31 + c) * 1_000_003, PAIRS) + ends[1], b % SINGLES + ends[2], c % SINGLES + ends[3]]


SIZE = TRIPLES + 2 * PAIRS + 2 * SINGLES


@dataclass
class LetterModel:
    """Interpolated character trigrams; `^` stands for a word's edge.  counts: by bucket, or a dictionary of trigrams."""

    counts: np.ndarray | dict[str, int]
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if isinstance(self.counts, dict):
            given, self.counts = self.counts, np.zeros(SIZE, np.int64)
            for key, n in given.items():
                self.counts[buckets(*map(ord, key))] += n
        self.total = int(self.counts[:TRIPLES].sum())

    def log(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        value = self.known.get(key)
        if value is None:
            if len(self.known) >= 20_000:
                self.known.clear()
            abc, ab, bc, mid, end = self.counts[buckets(ord(a), ord(b), ord(c))].tolist()
            value = self.known[key] = math.log(0.7 * abc / max(1, ab) + 0.25 * bc / max(1, mid) + 0.049 * end / max(1, self.total) + 1e-5)
        return value


def decode(written: str, letters: LetterModel, breaks: bool = False) -> str:
    """The likeliest reading of a written string; with `breaks` it may be several words."""
    paths: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
    before, settled = "", []
    head, tail = (0, len(written)) if breaks else (len(written) - len(written.lstrip(OPENING)), len(written.rstrip(CLOSING)))
    for at, sign in enumerate(written):
        arcs: list[tuple[str, float]] = [(c, SIGN_COST) for c in LOOKALIKES.get(sign, "")]
        if sign.isalpha():
            arcs.append((sign, 0.0))
            if sign == before:
                arcs.append(("", REPEAT_COST))
        elif at < head or at >= tail:
            arcs.append(("", -LETTER_GAIN))
        else:
            arcs.append(("", REPEAT_COST if sign == before else SEPARATOR_COST if sign in SEPARATORS else 2 * NOISE_COST if sign in LOOKALIKES else NOISE_COST))
        after: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (value, text) in paths.items():
            for letter, cost in arcs:
                steps = [((a, b), value - cost, text)]
                if letter and letter == a == b:  # no word has a letter three times in a row
                    continue
                if letter:
                    steps = [((b, letter), value - cost + letters.log(a, b, letter) + LETTER_GAIN, text + letter)]
                    if breaks and b != "^":
                        closed = value - cost - BREAK_COST + letters.log(a, b, "^") + letters.log("^", "^", letter) + LETTER_GAIN
                        steps.append((("^", letter), closed, f"{text} {letter}"))
                for state, total, read in steps:
                    if state not in after or (total, read) > after[state]:
                        after[state] = (total, read)
        if len(after) > BEAM:
            after = dict(sorted(after.items(), key=lambda x: x[1], reverse=True)[:BEAM])
        paths, before = after or paths, sign
        best = max(paths.values())[1] if at >= 4 * LAG else ""
        if len(best) > 4 * LAG:
            done = best[: len(best) - LAG]
            settled.append(done)
            paths = {state: (value, text[len(done) :]) for state, (value, text) in paths.items() if text.startswith(done)}
    return "".join(settled) + max(((value + (letters.log(a, b, "^") if b != "^" else 0), text) for (a, b), (value, text) in paths.items()), default=(0, ""))[1]


class Readings:
    """The words of a slice of texts and what each is read as: word i as `texts[first[i]:first[i + 1]]`, the whole word first.

    `extra` are words read from spaced letters of the texts `extra_text`.
    """

    def __init__(self, words: Words, texts: list[str], first: np.ndarray, extra_text: np.ndarray, extra: list[str]):
        self.words, self.texts, self.first, self.extra_text, self.extra = words, texts, first, extra_text, extra

    @property
    def all(self) -> list[str]:
        return [*self.texts, *self.extra]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, position in `all`) of every occurrence of every reading."""
        codes = self.words.codes
        many = np.diff(self.first)[codes]
        inside = np.arange(many.sum()) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many) if len(codes) else codes
        reading = np.repeat(self.first[:-1][codes], many) + inside
        return np.concatenate((np.repeat(self.words.text_of_word(), many), self.extra_text)), np.concatenate((reading, len(self.texts) + np.arange(len(self.extra), dtype=np.int64)))


class Restorer:
    """Restores the words of slices of texts; what was decoded once is kept up to a bound."""

    def __init__(self, counts: np.ndarray | None, keep: int = 10_000):
        self.letters = LetterModel(counts) if counts is not None else None
        self.seen: dict[tuple[str, bool], str] = {}
        self.keep = keep

    def read(self, written: str, breaks: bool = False) -> str:
        """The reading of a word without punctuation at its edges, or of a run of letters."""
        key = (written, breaks)
        if key not in self.seen:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            inner = _RUNS.sub(r"\1\1\1", written)
            self.seen[key] = decode(inner, self.letters, breaks) if breaks or any(c.isalpha() for c in inner) else ""
        return self.seen[key]

    def odd(self, words: pa.Array) -> np.ndarray:
        """Which words (without punctuation at the edges) go through the lattice."""
        return pc.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False) | self.repeats(words)

    def readings(self, texts: pa.Array) -> Readings:
        words = Words(texts)
        plain = pc.replace_substring_regex(words.unique, r"[^\p{L}\p{M}]+", "").to_pylist()
        no_text = np.zeros(0, np.int64)
        if self.letters is None:
            return Readings(words, plain, np.arange(len(plain) + 1), no_text, [])
        inner = pc.replace_substring_regex(words.unique, _EDGES, "")
        more: dict[int, list[str]] = {}
        for i in np.flatnonzero(self.odd(inner)).tolist():
            written = inner[i].as_py()
            plain[i] = self.read(written)
            parts = [p for p in _PARTS.split(written) if len(p) > 2]
            if len(parts) > 1:
                more[i] = parts
        parts = pa.array({p for x in more.values() for p in x}, pa.string())
        odd = dict(zip(parts.to_pylist(), self.odd(parts).tolist(), strict=True))
        more = {i: [self.read(p) if odd[p] else "".join(filter(str.isalpha, p)) for p in x] for i, x in more.items()}
        for i in np.flatnonzero(pc.match_substring_regex(words.unique, _UNSPACED).to_numpy(zero_copy_only=False)).tolist():
            more.setdefault(i, []).extend(plain[i][at : at + 4] for at in range(len(plain[i]) - 1))
        first = np.arange(len(plain) + 1)
        if more:
            extra = np.zeros(len(plain), np.int64)
            extra[list(more)] = [len(x) for x in more.values()]
            first[1:] += np.cumsum(extra)
            plain = [r for i, w in enumerate(plain) for r in ((w, *more[i]) if i in more else (w,))]
        single = (pc.utf8_length(words.unique).to_numpy(zero_copy_only=False) == 1)[words.codes]
        text = words.text_of_word()
        begins = np.flatnonzero(single & np.concatenate(([True], ~single[:-1] | (text[1:] != text[:-1])))) if len(single) else no_text
        extra_text, extra_words = [], []
        for at in begins.tolist():
            stop = int(words.offsets[text[at] + 1])
            end = at
            while end < stop and single[end]:
                end += 1
            if end - at >= 3:
                run = "".join(words.unique.take(pa.array(words.codes[at:end])).to_pylist())
                for word in self.read(run, breaks=True).split():
                    extra_text.append(text[at])
                    extra_words.append(word)
        return Readings(words, plain, first, np.array(extra_text, np.int64), extra_words)

    @staticmethod
    def repeats(unique: pa.Array) -> np.ndarray:
        """Whether a letter occurs three times in a row (by bytes, which only adds words to look at)."""
        data, offsets = string_bytes(unique)
        out = np.zeros(len(unique), bool)
        if len(data) > 2:
            word = np.repeat(np.arange(len(unique)), np.diff(offsets))
            letter = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
            hit = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:] & (word[2:] == word[:-2])
            out[word[2:][hit]] = True
        return out


def restore(text: str | None, letters: LetterModel) -> str:
    """A text with its words restored; runs of spaced letters are joined."""
    restorer = Restorer(None)
    restorer.letters = letters
    found = restorer.readings(pa.array([text or ""]))
    words, plain = found.words, [found.texts[i] for i in found.first[:-1].tolist()]
    singles = [len(w) == 1 for w in words.unique.to_pylist()]
    out, at = [], 0
    while at < len(words.codes):
        end = at
        while end < len(words.codes) and singles[words.codes[end]]:
            end += 1
        if end - at >= 3:
            out.append(restorer.read("".join(words.unique[int(c)].as_py() for c in words.codes[at:end]), breaks=True))
            at = end
        else:
            out.append(plain[words.codes[at]])
            at += 1
    return " ".join(filter(None, out))


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """The character trigrams of the letters of all texts, by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts = Restorer(None), np.zeros(SIZE, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = restorer.readings(part.column("text"))
                words, plain = found.words, found.texts
                uses = np.bincount(words.codes, minlength=len(words.unique))
                uses[restorer.repeats(words.unique)] = 0  # written for effect
                points = np.frombuffer("".join(f"^^{w}^" for w in plain).encode("utf-32-le"), np.uint32).astype(np.int64)
                word = np.repeat(np.arange(len(plain)), [len(w) + 3 for w in plain])
                if len(points) < 3:
                    continue
                inside = word[2:] == word[:-2]
                weight = uses[word[2:][inside]]
                for at in buckets(points[:-2][inside], points[1:-1][inside], points[2:][inside]):
                    counts += np.bincount(at, weights=weight, minlength=SIZE).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["feature", "n"])

    found = docs.where("text is not null").select(F.col("text").cast("string")).mapInArrow(count, "feature long, n long")
    found = found.groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # bounded by SIZE
    counts = np.zeros(SIZE, np.int64)
    counts[found["feature"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word): 64-bit hashes of the beginnings of each word and of the whole word."""
    points = np.array(words, f"U{BEGINNING}").reshape(-1).view(np.uint32).reshape(len(words), BEGINNING).astype(np.uint64) if words else np.zeros((0, BEGINNING), np.uint64)
    length = (points > 0).sum(1)
    mixed, hashes, owners = np.full(len(words), 0xCBF29CE484222325, np.uint64), [], []
    for j in range(BEGINNING):
        mixed = (mixed ^ points[:, j]) * np.uint64(0x100000001B3)
        mixed ^= mixed >> np.uint64(29)
        if j:
            have = np.flatnonzero(length > j)
            hashes.append(mixed[have])
            owners.append(have)
    for i in np.flatnonzero(length == BEGINNING).tolist():
        if len(words[i]) > BEGINNING:
            mixed[i] ^= np.uint64(xxhash.xxh64_intdigest(words[i]))
    have = np.flatnonzero(length > 0)
    hashes.append((mixed[have] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    owners.append(have)
    return np.concatenate(hashes).view(np.int64), np.concatenate(owners)


def count_features(docs: DataFrame, trigrams: np.ndarray, only: np.ndarray | None = None) -> DataFrame:
    """(feature, n): in how many of the texts each feature occurs; `only` is a sorted array of the features to count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(trigrams)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                read = restorer.readings(part.column("text"))
                names = read.all
                hashes, owners = features(names)
                if only is not None:
                    good = np.isin(hashes, only)
                    hashes, owners = hashes[good], owners[good]
                order = np.argsort(owners, kind="stable")
                hashes, owners = hashes[order], owners[order]
                first = np.searchsorted(owners, np.arange(len(names) + 1))
                text, word = read.pairs()
                different = np.unique(text * (len(names) + 1) + word)
                text, word = different // (len(names) + 1), different % (len(names) + 1)
                many = first[word + 1] - first[word]
                at = np.repeat(first[word] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(word) else word
                found, codes = np.unique(hashes[at], return_inverse=True)
                pairs = np.unique(np.repeat(text, many) * max(1, len(found)) + codes)
                n = np.bincount(pairs % max(1, len(found)), minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["feature", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    trigrams: np.ndarray
    #: sorted feature hashes and their weights
    features: np.ndarray
    weights: np.ndarray
    #: of the regression: constant, then the three figures of a text
    regression: np.ndarray


def text_figures(texts: pa.Array, restorer: Restorer, model: Model) -> np.ndarray:
    """The three figures of each text of a slice."""
    read = restorer.readings(texts)
    words, names = read.words, read.all
    weight = np.zeros(len(names) + 1)
    if len(model.features):
        hashes, owners = features(names)
        at = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
        good = model.features[at] == hashes
        np.maximum.at(weight, owners[good], model.weights[at[good]])
    text, codes = read.pairs()
    hit = weight[codes] > 0
    pairs = np.unique(text[hit] * len(weight) + codes[hit])
    text, value = pairs // len(weight), weight[pairs % len(weight)]
    offsets = np.searchsorted(text, np.arange(words.n_texts + 1))
    total = np.bincount(text, weights=value, minlength=words.n_texts)
    size = np.maximum(1, np.diff(words.offsets))
    return np.stack((max_by_segment(value, offsets), np.log1p(total), np.sqrt(np.diff(offsets) / size)), axis=1)


def figures(docs: DataFrame, model: Model, keep: list[str], finish=None) -> DataFrame:
    """The `keep` columns of docs and the three figures of each text as an array, or what `finish` makes of them."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.trigrams)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                x = text_figures(part.column("text"), restorer, model)
                out = pa.array(finish(x)) if finish else pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 3).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), out], [*keep, "out"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{schema}, out {'double' if finish else 'array<double>'}")


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose own text scores less than 0.5, with all their columns; no join, so ids do not matter."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.trigrams)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield part.filter(pa.array(_probability(text_figures(part.column("text"), restorer, model), model.regression) < 0.5))

    return rows_in_arrow(docs, run)


def _probability(x: np.ndarray, regression: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(regression[0] + x @ regression[1:], -40, 40)))


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps; with one class only, the constant alone."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 2) if len(y) else 0.1
        return np.array([math.log(share / (1 - share)), *[0.0] * x.shape[1]])
    x = np.column_stack((np.ones(len(y)), x))
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Learn from the labels whose remainder is not 0."""
    short_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    marked = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    once = marked.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    # Bounded: once has max_labels rows at most.
    rows = marked.join(F.broadcast(once), "doc_id", "left_semi").withColumn("fold", remainder())
    trigrams = count_trigrams(docs)
    teach = rows.where("fold <> 1")
    n = {r["toxic"]: r["count"] for r in teach.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    top = count_features(teach.where("toxic = 1"), trigrams).where(F.col("n") >= MIN_TOXIC).orderBy(F.desc("n"), "feature").limit(MAX_FEATURES).toPandas().sort_values("feature")
    hashes, k1 = top["feature"].to_numpy(np.int64), top["n"].to_numpy(np.float64)
    k0 = np.zeros(len(hashes))
    if len(hashes):
        clean = count_features(teach.where("toxic = 0"), trigrams, hashes).toPandas()
        k0[np.searchsorted(hashes, clean["feature"].to_numpy(np.int64))] = clean["n"]
    odds = np.log((k1 + 0.5) / (bad + 1)) - np.log((k0 + 0.5) / (good + 1))
    weights = odds - CAUTION * np.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5))
    kept = weights > 0
    model = Model(trigrams, hashes[kept], weights[kept], np.zeros(4))
    seen = figures(rows.where("fold = 1"), model, ["toxic"]).toPandas()
    x = np.array(seen["out"].tolist(), np.float64).reshape(-1, 3)
    model.regression = _regress(x, seen["toxic"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability that the label is 1."""
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return figures(docs, model, ["doc_id"], lambda x: _probability(x, model.regression)).withColumnRenamed("out", "score")


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
