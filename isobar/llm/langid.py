"""Language identification: script ranges, per-word scores and a Viterbi path with a switching penalty.

A word is a run of letters (with their marks). Its script, by Unicode ranges, leaves only the languages that use this
script in the learned texts. Each of them scores the word by the log probabilities of its character trigrams, word
edges included. The Viterbi path over all words of the text pays ``SWITCH`` for every change of language, and its runs
are the labelled spans.

The classifier is fitted on at most about ``sample`` texts per language, chosen by a hash of the id, and keeps all their
trigrams; every text is labelled as a whole. A word in a script belongs to a language of this script, so a single foreign
word in another script is a span of its own.

Nulls: texts without letters or null have no spans. Rows with a null language or a null text are not learned from.
Words in a script that no language uses score nothing and take the label of their neighbours; a text of such words only
is given to the most frequent language. With nothing to learn from there are no spans.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import buffers, pieces, release

SWITCH = 14.0
#: A word cannot speak against a language by more than this.
FLOOR = 10.0
#: Score of a language for a word in a script that it does not use: worse than any number of switches.
EXCLUDED = -1e9
#: Least share of a language's letters in a script for the language to be a candidate for its words.
SCRIPT_SHARE = 0.01
GROUP_BYTES = 4 << 20

# Unicode ranges of scripts.
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x2C60, 0x2C7F, "latin"), (0xA720, 0xA7FF, "latin"), (0xFF21, 0xFF5A, "latin"),
    (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x1C80, 0x1C8F, "cyrillic"),
    (0x2DE0, 0x2DFF, "cyrillic"), (0xA640, 0xA69F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x08A0, 0x08FF, "arabic"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFF, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"),
    (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1200, 0x139F, "ethiopic"), (0x1780, 0x17FF, "khmer"),
    (0x1100, 0x11FF, "hangul"), (0xAC00, 0xD7AF, "hangul"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0x20000, 0x3FFFF, "han"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, _, name in SCRIPTS))


@dataclass
class Characters:
    """Per code point: is a letter, belongs to words, lower case, script (the last number: none).

    Made once on the driver and shipped with the task code.
    """

    letter: np.ndarray
    inside: np.ndarray
    lower: np.ndarray
    script: np.ndarray


def character_tables() -> Characters:
    n = 0x40000
    letter, inside = np.zeros(n, bool), np.zeros(n, bool)
    lower = np.arange(n, dtype=np.uint32)
    script = np.full(n, len(SCRIPT_NAMES), np.uint8)
    for c in range(n):
        kind = unicodedata.category(chr(c))
        letter[c] = kind[0] == "L"
        inside[c] = kind[0] in "LM"
        if kind == "Lu" and len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    for first, last, name in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return Characters(letter, inside, lower, script)


@dataclass
class Words:
    """Words of some texts: per word its text, script and letters; per character its trigram and word."""

    doc: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    first_char: np.ndarray
    grams: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray, characters: Characters) -> Words:
    letter, inside, lower, script = characters.letter, characters.inside, characters.lower, characters.script
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    codes = np.where(codes < len(letter), codes, 0)
    bounds = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    if bounds[-1] != len(codes):
        raise ValueError("text is not UTF-8")
    mask = inside[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[bounds] = True
    prior = np.concatenate(([False], mask[:-1])) if len(mask) else mask
    starts = mask & (~prior | edge[:-1])
    place = np.flatnonzero(mask)
    word = np.cumsum(starts)[place] - 1
    with_letter = np.bincount(word, letter[codes[place]], int(starts.sum())) > 0
    keep = with_letter[word] if len(word) else np.zeros(0, bool)
    place, word = place[keep], word[keep]
    number = np.cumsum(with_letter) - 1
    word = number[word]
    n = int(with_letter.sum())
    small = lower[codes[place]].astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
    before, after = np.roll(small, 1), np.roll(small, -1)
    before[first] = 0
    after[first - 1] = 0  # the last character of the word before, around the end
    grams = (before << np.uint64(42)) | (small << np.uint64(21)) | after
    is_letter = letter[codes[place]]
    letters = np.bincount(word, is_letter, n).astype(np.int64)
    head = np.full(n, len(codes), np.int64)
    np.minimum.at(head, word[is_letter], place[is_letter])
    return Words(np.searchsorted(bounds, place[first], "right") - 1, script[codes[head]] if n else np.zeros(0, np.uint8), letters, first, grams)


@dataclass
class Model:
    """Trigrams in order, their log probability per language (last row: unknown), candidates per script."""

    languages: list[str]
    keys: np.ndarray
    scores: np.ndarray
    candidates: np.ndarray
    frequent: int

    def score(self, words: Words) -> np.ndarray:
        """Per word and language, 0 for the best; not below -FLOOR for candidates, EXCLUDED for all others."""
        n, k = len(words.doc), len(self.languages)
        if not n:
            return np.zeros((0, k), np.float32)
        at = np.minimum(np.searchsorted(self.keys, words.grams), len(self.keys) - 1)
        at[self.keys[at] != words.grams] = len(self.keys)
        total = np.add.reduceat(self.scores[at], words.first_char, axis=0)
        allowed = self.candidates[words.script]
        total[~allowed] = EXCLUDED
        total -= total.max(axis=1, keepdims=True)
        np.maximum(total, -FLOOR, out=total)
        total[~allowed] = EXCLUDED  # no path of a text goes through these
        none = ~allowed.any(axis=1)
        total[none] = 0
        total[none, self.frequent] = 1e-3  # decides only where nothing else speaks
        return total


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float) -> np.ndarray:
    """Label of every word; the texts advance side by side, the longest first."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    counts, first = counts[order], first[order]
    longest = int(counts[0]) if n_docs else 0
    active = np.searchsorted(-counts, -np.arange(1, longest + 1), "right")  # texts with more than t words
    labels = np.zeros(len(doc), np.int32)
    if not longest or not scores.shape[1]:
        return labels
    stay = np.zeros(scores.shape, bool)
    jump = np.zeros(len(doc), np.int32)
    path = scores[first[: active[0]]].copy()
    ended = np.zeros(active[0], np.int32)
    for t in range(1, longest):
        m = active[t]
        if m < len(path):
            ended[m : len(path)] = path[m:].argmax(axis=1)
            path = path[:m]
        at = first[:m] + t
        best = path.argmax(axis=1)
        other = path[np.arange(m), best][:, None] - switch
        keep = path >= other
        stay[at], jump[at] = keep, best
        path = np.where(keep, path, other) + scores[at]
    ended[: len(path)] = path.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        labels[at] = ended[:m]
        if t:
            ended[:m] = np.where(stay[at, ended[:m]], ended[:m], jump[at])
    return labels


SPAN = "array<struct<start:int,end:int,lang:string,letters:long>>"


def spans_udf(model: Model, switch: float = SWITCH):
    """Arrow function from text to labelled spans (words from ``start`` up to ``end``)."""
    names = pa.array([*model.languages, ""])
    characters = character_tables()

    @F.arrow_udf(SPAN)
    def label(texts: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        parts: list[list[np.ndarray]] = []
        counts = []
        for i, j in pieces(offsets, GROUP_BYTES):
            scores, docs, letters = [], [], []
            inner = offsets[i : j + 1]
            for a, b in pieces(inner, max(1 << 16, (2 << 20) // max(4, len(model.languages)))):
                words = read_words(data[inner[a] : inner[b]], inner[a : b + 1] - inner[a], characters)
                scores.append(model.score(words))
                docs.append(words.doc + a)
                letters.append(words.letters)
            doc, letter = np.concatenate(docs), np.concatenate(letters)
            path = viterbi(np.concatenate(scores), doc, j - i, switch)
            if len(doc):
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (path[1:] != path[:-1]))))
                base = np.searchsorted(doc, doc[first])
                end = np.append(first[1:], len(doc))
                parts.append([first - base, end - base, path[first], np.add.reduceat(letter, first)])
                counts.append(np.bincount(doc[first], minlength=j - i))
            else:
                counts.append(np.zeros(j - i, np.int64))
        start, end, lang, letters = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
        rows = pa.StructArray.from_arrays(
            [pa.array(start, pa.int32()), pa.array(end, pa.int32()), names.take(pa.array(lang, pa.int32())), pa.array(letters, pa.int64())],
            ["start", "end", "lang", "letters"],
        )
        ends = np.cumsum(np.concatenate([[0], *counts]))
        release()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return label


def train(texts: DataFrame, doc_id: Column, text: Column, lang: Column, sample: int = 3000, seed: int = 5) -> Model:
    """Fit on labelled rows; ``sample`` bounds the expected number of texts per language, all of whose trigrams are kept."""
    known = texts.select(doc_id.alias("doc_id"), text.alias("text"), lang.alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(1, np.uint64), np.zeros((2, 0), np.float32), np.zeros((len(SCRIPT_NAMES) + 1, 0), bool), 0)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample / sizes[name]))])
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(uniform < share[F.col("lang")])
    number = {name: i for i, name in enumerate(languages)}
    characters = character_tables()

    def count(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for i, j in pieces(offsets):
                words = read_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], characters)
                lengths = np.diff(np.append(words.first_char, len(words.grams)))
                of = np.repeat(langs[i:j][words.doc], lengths)
                for k in np.unique(of):
                    keys, n = np.unique(words.grams[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"]
                    )

    grams = chosen.select("text", "lang").mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = grams.toPandas()  # the trigrams of a sample of bounded size
    keys = np.unique(rows["gram"].to_numpy(np.int64).view(np.uint64))
    counts = np.zeros((len(keys) + 1, len(languages)))
    counts[np.searchsorted(keys, rows["gram"].to_numpy(np.int64).view(np.uint64)), rows["lang"]] = rows["n"]
    smooth = 0.5
    scores = np.log((counts + smooth) / (counts.sum(axis=0) + smooth * len(counts)))
    script = characters.script
    middle = ((keys >> np.uint64(21)) & np.uint64(0x1FFFFF)).astype(np.int64)
    used = np.zeros((len(SCRIPT_NAMES) + 1, len(languages)))
    np.add.at(used, script[middle], counts[:-1])
    candidates = used >= SCRIPT_SHARE * np.maximum(used.sum(axis=0), 1)
    candidates[-1] = False
    if not len(keys):
        keys = np.zeros(1, np.uint64)
        scores = np.zeros((2, len(languages)))
    return Model(languages, keys, scores.astype(np.float32), candidates, max(range(len(languages)), key=lambda i: sizes[languages[i]]))


def label_spans(docs: DataFrame, text: Column, model: Model, name: str = "spans") -> DataFrame:
    """``docs`` with a column of labelled spans."""
    return docs.withColumn(name, spans_udf(model)(F.coalesce(text, F.lit("")))) if model.languages else docs.withColumn(name, F.array().cast(SPAN))


def main_language(spans: Column) -> tuple[Column, Column]:
    """Language with most letters, the first by name among equals, and its share of the letters; ``und`` without letters."""
    letters = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["letters"])
    names = F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["lang"])))
    sums = F.transform(
        names,
        lambda n: F.struct(
            F.aggregate(F.filter(spans, lambda x: x["lang"] == n), F.lit(0).cast("long"), lambda s, x: s + x["letters"]).alias("letters"), n.alias("lang")
        ),
    )
    most = F.array_max(F.transform(sums, lambda x: x["letters"]))
    best = F.filter(sums, lambda x: x["letters"] == most)[0]["lang"]
    return F.when(letters > 0, best).otherwise("und"), F.when(letters > 0, most / letters).otherwise(0.0)
