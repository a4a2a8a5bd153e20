"""LM scoring with Brown class-based bigrams.

Tokens are the words between white space, A-Z lower-cased, and one end per text. Counts cover all training texts.

* The ``clustered`` most frequent words, the core, are assigned to ``classes`` classes by the exchange algorithm: one word
  after the other moves to the class that raises the likelihood of the class bigrams most, until none moves. Bigrams are
  counted over the whole corpus; their table has at most ``(clustered + 5)^2`` entries however large the corpus is, so the
  moves, which are sequential by nature, are made on the driver.
* All other words of the training texts, however many, are placed once, as in Brown's algorithm the words after the first
  ones are: a word starts in the class of its form (digits, other than ASCII, punctuation at the end, plain) and moves to the
  learned class that raises the likelihood most. It stays where no move gains. Words are grouped with the classes of
  their neighbours and placed in tasks, all against the table of the core; only that table is broadcast.
* Class bigrams are then counted anew over all training texts, with the classes of all words.
* The score of a text is the sum of log10 P(class | class before) and log10 P(word | class). Transitions are smoothed by
  ``ALPHA``; a word of a learned class has its share of its class; a word of a form has (c + 1) / (N + V + 1) in its form,
  which leaves room for unknown words.

Base scores are add-one unigrams. Counts and classes of the ``HEAD`` most frequent words travel to the tasks, a table of
fixed size; all other tokens meet theirs by a join on the word's 64-bit hash, after equal words of a text between equal
neighbours are added up. Two such tokens side by side need a second join for the class of the later one.

Nulls: a null text has one token, its end. Rows equal in id and text are scored alike and returned as often as they
came; a null ``train`` flag means no. Without training texts nothing is known and all probabilities are uniform.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import IS_SPACE, LOWER_LUT, U64, Rolling, as_signed, as_unsigned, buffers, pieces, release, runs, word_bounds
from isobar.session import materialize

CLUSTERED, CLASSES, HEAD, ALPHA = 1000, 48, 1 << 17, 0.5
#: Passes of the exchange; without a number it ends when no word moves.
PASSES: int | None = None
FORMS = 4
#: Rows of one word that a task holds before it adds equal ones up.
MOST_ROWS = 1 << 15
IS_DIGIT = np.zeros(256, np.int32)
IS_DIGIT[0x30:0x3A] = 1
IS_WIDE = np.zeros(256, np.int32)
IS_WIDE[0x80:] = 1
IS_MARK = np.zeros(256, bool)
IS_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, form and text of every word."""
    data = LOWER_LUT[data]
    starts, ends, doc = word_bounds(data, offsets, ~IS_SPACE)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), doc
    hashed = Rolling(data).hash(starts, ends)
    form = np.where(IS_MARK[data[ends - 1]], 2, 3)
    form[np.add.reduceat(IS_WIDE[data], starts) > 0] = 1  # white space between words counts 0
    form[np.add.reduceat(IS_DIGIT[data], starts) > 0] = 0
    return hashed, form, doc


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, form, n) over all texts; equal words are added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            parts = []
            for i, j in pieces(offsets):
                word, form, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys, first, n = np.unique(word, return_index=True, return_counts=True)
                parts.append((keys, form[first], n))
            if parts:
                keys, form, n = (np.concatenate(x) for x in zip(*parts))
                some, first, place = np.unique(keys, return_index=True, return_inverse=True)
                total = np.bincount(place, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(as_signed(some)), pa.array(form[first].astype(np.int32)), pa.array(total)], ["word", "form", "n"])
        release()

    return texts.select("text").mapInArrow(count, "word long, form int, n long").groupBy("word", "form").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words in hash order: count and id (clustered words; others -1)."""

    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    clustered: int

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Place of each word; -1 if it is not a frequent one."""
        if not len(self.words):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
        return np.where(self.words[at] == hashed, at, -1)

    def symbols(self, place: np.ndarray, form: np.ndarray) -> np.ndarray:
        """Clustered words by id, then the forms; the boundary is ``clustered + FORMS``."""
        found = self.ids[place] if len(self.ids) else np.full(len(place), -1)
        return np.where((place >= 0) & (found >= 0), found, self.clustered + form)


def frequent_words(counts: DataFrame, head: int, clustered: int) -> Vocabulary:
    """Words whose count is in the highest count classes (sixteen to a doubling) that hold at most ``head`` words.

    A table of fewer than a thousand classes decides, so tasks do not each send a list of candidates to the driver. Where
    these are fewer than ``clustered``, the first words by hash of the next class make up for it.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    least, total = None, 0
    found, more = counts.where(F.lit(False)), None
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["level"]):
        if total + row["words"] > head:
            if total < clustered:
                more = counts.where(level == row["level"]).select("word", "n").orderBy("word").limit(clustered - total)
            break
        total += row["words"]
        least = row["level"]
    if least is not None:
        found = counts.where(level >= least)
    found = found.select("word", "n")
    top = (found if more is None else found.unionByName(more)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words = as_unsigned(top["word"].to_numpy(np.int64))
    ids = np.where(np.arange(len(words)) < clustered, np.arange(len(words)), -1)
    order = np.argsort(words)
    return Vocabulary(words[order], top["n"].to_numpy(np.int64)[order], ids[order], min(clustered, len(words)))


def sequences(symbols: np.ndarray, doc: np.ndarray, n_docs: int, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol before, symbol and text of every token, ends included."""
    counts = np.bincount(doc, minlength=n_docs)
    whole = np.full(len(symbols) + n_docs + 1, boundary)
    whole[np.arange(len(symbols)) + doc + 1] = symbols
    return whole[:-1], whole[1:], np.repeat(np.arange(n_docs), counts + 1)


def bigram_counts(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(a, b, n) over symbols; their number is bounded by the clustered vocabulary."""
    size = vocabulary.clustered + FORMS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            total: dict[str, np.ndarray] = {}
            for i, j in pieces(offsets):
                word, form, doc = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                before, after, _ = sequences(vocabulary.symbols(vocabulary.find(word), form), doc, j - i, size - 1)
                if "sum" not in total:
                    total["sum"] = np.zeros(size * size, np.int64)
                total["sum"] += np.bincount(before * size + after, minlength=size * size)
            if total:
                code = np.flatnonzero(total["sum"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((code // size).astype(np.int32)), pa.array((code % size).astype(np.int32)), pa.array(total["sum"][code])], ["a", "b", "n"]
                )

    return texts.select("text").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(word_class: int, after: np.ndarray, before: np.ndarray, own: float, rest: np.ndarray, classes: int) -> int:
    """Class with the largest likelihood for one word, its own class among equals.

    ``rest`` are the class bigrams without the word, ``after`` and ``before`` count its neighbours per class, itself apart.
    """
    n_after, n_before = after.sum() + own, before.sum() + own
    c = np.arange(classes)
    rows, columns = rest[:classes], rest[:, :classes].T
    gain = (xlogx(rows + after) - xlogx(rows)).sum(axis=1) + (xlogx(columns + before) - xlogx(columns)).sum(axis=1)
    corner = rest[c, c]
    gain -= xlogx(corner + after[c]) + xlogx(corner + before[c]) - 2 * xlogx(corner)
    gain += xlogx(corner + after[c] + before[c] + own) - xlogx(corner)
    # The word's neighbours keep their totals wherever it goes, so its own bigrams belong to them.
    leaving, arriving = rows.sum(axis=1) + before[c], columns.sum(axis=1) + after[c]
    gain -= xlogx(leaving + n_after) - xlogx(leaving) + xlogx(arriving + n_before) - xlogx(arriving)
    top = int(gain.argmax())
    return word_class if gain[top] <= gain[word_class] + 1e-9 else top


def exchange(counts: np.ndarray, clustered: int, classes: int, passes: int | None = PASSES) -> np.ndarray:
    """Class of every symbol: clustered words by exchange, each form and the boundary on its own.

    ``counts`` are the symbol bigrams. Words move one by one, the most frequent first, until a pass moves none. Every move
    raises the likelihood, so there is such a pass.
    """
    classes = max(1, min(classes, clustered))
    of = np.concatenate([np.arange(clustered) % classes, classes + np.arange(FORMS + 1)]).astype(np.int64)
    table = class_table(counts, of)
    width = len(table)
    for _ in (itertools.count() if passes is None else range(passes)) if clustered else ():
        moved = 0
        for word in range(clustered):
            now, own = of[word], counts[word, word]
            after, before = np.bincount(of, counts[word], width), np.bincount(of, counts[:, word], width)
            after[now] -= own
            before[now] -= own

            def add(at: int, sign: int) -> None:
                table[at] += sign * after  # noqa: B023 - called in this turn of the loop
                table[:, at] += sign * before  # noqa: B023
                table[at, at] += sign * own  # noqa: B023

            add(now, -1)
            of[word] = best_class(now, after, before, own, table, classes)
            add(of[word], 1)
            moved += of[word] != now
        if not moved:
            break
    return of


def class_table(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Counts of class pairs."""
    width = int(of.max()) + 1
    by_row = np.zeros((width, len(of)))
    np.add.at(by_row, of, counts)
    out = np.zeros((width, width))
    np.add.at(out.T, of, by_row.T)
    return out


def placing_contexts(texts: DataFrame, vocabulary: Vocabulary, of: np.ndarray) -> DataFrame:
    """(word, code, n): classes beside every word outside the core, equal words side by side in one task.

    A code has the form, the class before and the class after, of ``width + 1`` each; ``width`` is the word itself.
    """
    width, boundary = int(of.max()) + 1, vocabulary.clustered + FORMS
    codes = FORMS * (width + 1) ** 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            parts = []
            for i, j in pieces(offsets):
                word, form, doc = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                symbols = vocabulary.symbols(vocabulary.find(word), form)
                rest = np.flatnonzero(symbols >= vocabulary.clustered)
                classes, same = line(of[symbols], doc, j - i, of[boundary]), line(word, doc, j - i, 0)
                at, own = rest + doc[rest] + 1, word[rest]
                left, right = (np.where((classes[x] != of[boundary]) & (same[x] == own), width, classes[x]) for x in (at - 1, at + 1))
                parts.append((own, (form[rest] * (width + 1) + left) * (width + 1) + right))
            if parts:
                word, code = (np.concatenate(x) for x in zip(*parts))
                some, place = np.unique(word, return_inverse=True)
                pairs, n = np.unique(place * codes + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_signed(some[pairs // codes])), pa.array((pairs % codes).astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "code", "n"])
        release()

    return texts.select("text").mapInArrow(count, "word long, code int, n long").repartition("word").sortWithinPartitions("word")


def line(values: np.ndarray, doc: np.ndarray, n_docs: int, boundary: int) -> np.ndarray:
    """Values of all tokens with a boundary before, between and after the texts; a token is at its place + its text + 1."""
    whole = np.full(len(values) + n_docs + 1, boundary, values.dtype)
    whole[np.arange(len(values)) + doc + 1] = values
    return whole


def best_places(word: np.ndarray, code: np.ndarray, n: np.ndarray, table: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, class and count of every word, from its rows of :func:`placing_contexts` side by side.

    The gain of a class is that of :func:`best_class`, of which only the terms beside the word's neighbours are not zero.
    ``table`` still counts each word in the class of its form.
    """
    width = len(table)
    first, length = runs(word)
    owner = np.repeat(np.arange(len(first)), length)
    form = classes + code[first] // (width + 1) ** 2
    beside = [code % (width + 1), code // (width + 1) % (width + 1)]  # after, before
    own = np.bincount(owner, n * (beside[0] == width), len(first))
    near = [np.bincount(owner * (width + 1) + x, n, len(first) * (width + 1)).reshape(-1, width + 1)[:, :width] for x in beside]
    total = [x.sum(axis=1) + own for x in near]
    here, gain, stay = np.arange(len(first)), np.zeros((len(first), classes)), np.zeros(len(first))
    for side, counts in enumerate((table, table.T)):
        # Rows of ``counts`` are the word's possible classes, columns its neighbours on this side.
        w, d = np.nonzero(near[side])
        k = near[side][w, d]
        rest = counts[:classes, d].T.astype(float)
        formed = np.flatnonzero(d == form[w])  # neighbours counted beside the word itself in the class of its form
        rest[formed] -= near[1 - side][w[formed], :classes]
        gains = xlogx(rest + k[:, None]) - xlogx(rest)
        learned = np.flatnonzero(d < classes)
        gains[learned, d[learned]] = 0  # a class beside itself follows below
        if len(w):
            start, _ = runs(w)
            gain[w[start]] += np.add.reduceat(gains, start, axis=0)
        kept = np.where(d == form[w], 0.0, xlogx(counts[form[w], d]) - xlogx(counts[form[w], d] - k))
        stay += np.bincount(w, kept, len(first))
        sums, mine = counts.sum(axis=1), total[side]
        gain -= xlogx(sums[:classes] + mine[:, None]) - xlogx(sums[:classes])
        stay -= xlogx(sums[form]) - xlogx(sums[form] - mine)
    corner = np.diag(table)
    both = near[0] + near[1] + own[:, None]
    gain += xlogx(corner[:classes] + both[:, :classes]) - xlogx(corner[:classes])
    stay += xlogx(corner[form]) - xlogx(corner[form] - both[here, form])
    gain[:, table.sum(axis=1)[:classes] == 0] = -np.inf  # an empty class would suit every word alone
    top = gain.argmax(axis=1)
    return word[first], np.where(gain[here, top] > stay + 1e-9, top, form), total[0].astype(np.int64)


def place_words(contexts: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """(word, class, n) of every word outside the core; equal words lie side by side in one task."""
    most = MOST_ROWS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        for batch in itertools.chain(batches, [None]):
            columns = kept
            if batch is not None:
                columns = [np.concatenate((old, new.to_numpy())) for old, new in zip(kept, batch.columns)]
            size = len(columns[0])
            if not size:
                continue
            cut = size if batch is None else int(runs(columns[0])[0][-1])  # the last word may go on in the next batch
            kept = [c[cut:] for c in columns]
            if len(kept[0]) > most:  # all of one word
                some, at = np.unique(kept[1], return_inverse=True)
                kept = [kept[0][: len(some)], some, np.bincount(at, kept[2]).astype(np.int64)]
            if cut:
                word, found, n = best_places(*[c[:cut] for c in columns], table, classes)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(found.astype(np.int32)), pa.array(n)], ["word", "class", "n"])

    return contexts.mapInArrow(place, "word long, class int, n long")


@dataclass
class Lexicon:
    """Classes of all words: of the frequent ones in the order of the vocabulary, of the others as a table."""

    vocabulary: Vocabulary
    classes: np.ndarray  # per symbol of the core and its forms
    frequent: np.ndarray  # per word of the vocabulary
    words: DataFrame  # (word, class, n) of every word outside the core
    learned: int

    @property
    def width(self) -> int:
        return self.learned + FORMS + 1

    def known(self, place: np.ndarray) -> np.ndarray:
        """Class of each token; -1 if its word is not a frequent one."""
        return np.where(place >= 0, self.frequent[place], -1) if len(self.frequent) else np.full(len(place), -1)

    def in_tasks(self) -> Lexicon:
        return Lexicon(self.vocabulary, self.classes, self.frequent, None, self.learned)


def learn(texts: DataFrame, counts: DataFrame, clustered: int, classes: int, passes: int | None, head: int) -> Lexicon:
    """Classes of the words of the training texts."""
    vocabulary = frequent_words(counts, head, clustered)
    symbols = vocabulary.clustered + FORMS + 1
    found = bigram_counts(texts, vocabulary).toPandas()  # at most symbols^2 rows
    bigrams = np.zeros((symbols, symbols))
    bigrams[found["a"].to_numpy(np.int64), found["b"].to_numpy(np.int64)] = found["n"]
    of = exchange(bigrams, vocabulary.clustered, classes, passes)
    learned = len(class_table(bigrams, of)) - FORMS - 1
    words = materialize(place_words(placing_contexts(texts, vocabulary, of), class_table(bigrams, of), learned), "brown-classes")
    frequent = np.full(len(vocabulary.words), -1)
    mine = vocabulary.ids >= 0
    frequent[mine] = of[vocabulary.ids[mine]]
    if not mine.all():
        rest = words.where(F.col("n") >= int(vocabulary.counts.min())).toPandas()
        place = vocabulary.find(as_unsigned(rest["word"].to_numpy(np.int64)))
        frequent[place[place >= 0]] = rest["class"].to_numpy()[place >= 0]
    return Lexicon(vocabulary, of, frequent, words, learned)


MET = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("word", pa.int64()), ("form", pa.int32()), ("left", pa.int32()), ("right", pa.int32()),
                 ("next", pa.int64()), ("next_form", pa.int32()), ("train", pa.bool_()), ("times", pa.int64())])
MET_DDL = "doc_id long, text_key long, word long, form int, left int, right int, next long, next_form int, train boolean, times long"


def rare_tokens(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Tokens that are not frequent, with the classes beside them (-1: not known) and the word after, if it is not frequent.

    Rows without a word count pairs of known classes, ``left`` and ``right``, of the training texts.
    """
    lexicon = lexicon.in_tasks()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = lexicon.width
        boundary, pairs = width - 1, np.zeros(width * width, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            trained = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in pieces(offsets):
                word, form, doc = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = lexicon.known(lexicon.vocabulary.find(word))
                classes = line(found, doc, j - i, boundary)
                after, forms = line(word, doc, j - i, 0), line(form, doc, j - i, 0)
                text = np.repeat(np.arange(i, j), np.bincount(doc, minlength=j - i) + 1)
                known = (classes[:-1] >= 0) & (classes[1:] >= 0) & trained[text]
                pairs += np.bincount(classes[:-1][known] * width + classes[1:][known], minlength=width * width)
                rare = np.flatnonzero(found < 0)
                at = rare + doc[rare] + 1
                keys = [i + doc[rare], word[rare], classes[at - 1], classes[at + 1], np.where(classes[at + 1] < 0, after[at + 1], U64(0)), form[rare], forms[at + 1]]
                order = np.lexsort(keys[:5])
                keys = [k[order] for k in keys]
                fresh = np.ones(len(order), bool)
                fresh[1:] = np.any([k[1:] != k[:-1] for k in keys[:5]], axis=0)
                first = np.flatnonzero(fresh)
                text, word, left, right, follower, form, next_form = (k[first] for k in keys)
                times = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(text)), batch.column("text_key").take(pa.array(text)), pa.array(as_signed(word)), pa.array(form.astype(np.int32)),
                     pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(as_signed(follower), mask=right >= 0), pa.array(next_form.astype(np.int32)),
                     pa.array(trained[text]), pa.array(times.astype(np.int64))], schema=MET,
                )
        some = np.flatnonzero(pairs)
        none = pa.nulls(len(some), pa.int64())
        ints = [pa.array(x.astype(np.int32)) for x in (some // width, some % width)]
        zeros = pa.array(np.zeros(len(some), np.int32))
        yield pa.RecordBatch.from_arrays([none, none, none, zeros, *ints, none, zeros, pa.array(np.ones(len(some), bool)), pa.array(pairs[some])], schema=MET)
        release()

    return rows.select("doc_id", "text_key", "text", "train").mapInArrow(find, MET_DDL)


def with_classes(rows: DataFrame, lexicon: Lexicon) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`rare_tokens` with count and class of their word, and the pairs of such tokens with both classes."""
    words = lexicon.words.select(F.col("word"), F.col("class"), F.col("n"))
    joined = rows.join(words, "word", "left")
    met = joined.select(
        "doc_id", "text_key", F.col("word").isNotNull().alias("rare"), F.when(F.col("word").isNotNull(), F.coalesce("class", F.lit(lexicon.learned) + F.col("form"))).alias("class"),
        F.coalesce("n", F.lit(0)).alias("n"), "left", "right", "next", "next_form", "train", "times",
    )
    met = materialize(met, "brown-tokens")
    later = words.select(F.col("word").alias("next"), F.col("class").alias("next_class"))
    pairs = met.where(F.col("next").isNotNull()).select("doc_id", "text_key", F.col("class").alias("left"), "next", "next_form", "train", "times").join(later, "next", "left")
    right = F.coalesce("next_class", F.lit(lexicon.learned) + F.col("next_form"))
    return met, materialize(pairs.select("doc_id", "text_key", "left", right.alias("right"), "train", "times"), "brown-pairs")


@dataclass
class Model:
    """What scoring needs; all sizes are bounded by parameters."""

    vocabulary: Vocabulary
    classes: np.ndarray  # per symbol of the core and its forms
    frequent: np.ndarray  # class per word of the vocabulary
    learned: int
    transition: np.ndarray
    emission: np.ndarray  # per class; what is added to log10(c), for a form to log10(c + 1)
    train_tokens: int
    types: int
    end_count: int


def fit(texts: DataFrame, counts: DataFrame, clustered: int, classes: int, passes: int | None, head: int) -> Model:
    """``texts`` (text) are the training texts, ``counts`` their words."""
    lexicon = learn(texts, counts, clustered, classes, passes, head)
    zero = F.lit(0).cast("long")
    rows = texts.select(zero.alias("doc_id"), zero.alias("text_key"), "text", F.lit(True).alias("train"))
    return model_of(lexicon, counts, *with_classes(rare_tokens(rows, lexicon), lexicon))


def model_of(lexicon: Lexicon, counts: DataFrame, met: DataFrame, pairs: DataFrame) -> Model:
    """Probabilities from the class bigrams of the training texts."""
    width, first_form = lexicon.width, lexicon.learned
    table = np.zeros((width, width))
    known, trained = met.where(~F.col("rare")), met.where(F.col("rare") & F.col("train"))
    parts = (
        known.select("left", "right", "times"), trained.where("left >= 0").select("left", F.col("class").alias("right"), "times"),
        trained.where("right >= 0").select(F.col("class").alias("left"), "right", "times"), pairs.where("train").select("left", "right", "times"),
    )
    for part in parts:
        for r in part.groupBy("left", "right").agg(F.sum("times").alias("n")).collect():  # at most width^2 rows
            table[r["left"], r["right"]] += r["n"]
    transition = np.log10((table + ALPHA) / (table.sum(axis=1, keepdims=True) + ALPHA * width))
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    staying = {r["class"]: r["types"] for r in lexicon.words.where(F.col("class") >= first_form).groupBy("class").agg(F.count(F.lit(1)).alias("types")).collect()}
    arriving = table.sum(axis=0)
    emission = np.zeros(width)
    emission[:first_form] = -np.log10(np.maximum(arriving[:first_form], 1))
    for c in range(first_form, first_form + FORMS):
        emission[c] = -np.log10(arriving[c] + staying.get(c, 0) + 1)
    ends = int(arriving[-1])
    total, types = int(totals[0] or 0) + ends, int(totals[1]) + (ends > 0)
    return Model(lexicon.vocabulary, lexicon.classes, lexicon.frequent, first_form, transition, emission, total, types, ends)


SCORED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
SCORED_DDL = "doc_id long, text_key long, n_tokens long, n_known long, base double, score double"


def partial_scores(rows: DataFrame, model: Model) -> DataFrame:
    """One row per text with what its frequent words add."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, boundary = model.vocabulary, model.learned + FORMS
        level = np.log10(model.train_tokens + model.types + 1)
        log_counts = np.log10(vocabulary.counts + 1.0)
        emission = model.emission[model.frequent] + np.log10(vocabulary.counts + (model.frequent >= model.learned))
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in pieces(offsets):
                n = j - i
                word, _, doc = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                place = vocabulary.find(word)
                known = place >= 0
                found = np.where(known, model.frequent[place], -1) if len(model.frequent) else place
                before, after, owner = sequences(found, doc, n, boundary)
                n_tokens = np.bincount(owner, minlength=n)
                steps = np.where((before >= 0) & (after >= 0), model.transition[before, after], 0.0)
                path = np.bincount(owner, steps, n) + np.bincount(doc[known], emission[place[known]], n)
                base = np.bincount(doc[known], log_counts[place[known]], n) + np.log10(model.end_count + 1.0) - n_tokens * level
                n_known = np.bincount(doc[known], minlength=n) + (model.end_count > 0)
                at = slice(i, j)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at], batch.column("text_key")[at], pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(path)],
                    schema=SCORED,
                )

    return rows.mapInArrow(score, SCORED_DDL)


def numbers(values: np.ndarray) -> Column:
    """An array of doubles as one literal."""
    return F.split(F.lit(",".join(map(repr, values.ravel().tolist()))), ",").cast("array<double>")


def rare_scores(met: DataFrame, pairs: DataFrame, model: Model) -> DataFrame:
    """What words that are not frequent add to their texts, in the columns of :func:`partial_scores`."""
    width, none = model.learned + FORMS + 1, F.lit(0).cast("long")

    def step(left: Column, right: Column) -> Column:
        return F.get(numbers(model.transition), left * width + right)

    form = F.col("class") >= model.learned
    log = F.log10(F.col("n") + F.when(form, 1.0).otherwise(0.0)) + F.get(numbers(model.emission), F.col("class"))
    path = log + F.when(F.col("left") >= 0, step(F.col("left"), F.col("class"))).otherwise(0.0) + F.when(F.col("right") >= 0, step(F.col("class"), F.col("right"))).otherwise(0.0)
    single = met.where("rare").select(
        "doc_id", "text_key", none.alias("n_tokens"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.log10(F.col("n") + 1.0)).alias("base"), (F.col("times") * path).alias("score"),
    )
    double = pairs.select("doc_id", "text_key", none.alias("n_tokens"), none.alias("n_known"), F.lit(0.0).alias("base"), (F.col("times") * step(F.col("left"), F.col("right"))).alias("score"))
    return single.unionByName(double)


def score_texts(
    docs: DataFrame, doc_id: Column, text: Column, train: Column, clustered: int = CLUSTERED, classes: int = CLASSES, passes: int | None = PASSES, head: int = HEAD
) -> DataFrame:
    """(doc_id, text_key, n_tokens, n_known, train_tokens, base_score, score), one row per input row."""
    body = F.coalesce(text, F.lit(""))
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    texts = rows.where("train").select("text")
    counts = materialize(word_counts(texts), "brown-counts")
    lexicon = learn(texts, counts, clustered, classes, passes, head)
    met, pairs = with_classes(rare_tokens(rows, lexicon), lexicon)
    model = model_of(lexicon, counts, met, pairs)
    whole = partial_scores(rows.select("doc_id", "text_key", "text"), model).withColumn("rows", F.lit(1))
    known = whole.unionByName(rare_scores(met, pairs, model).withColumn("rows", F.lit(0)))
    sums = known.groupBy("doc_id", "text_key").agg(
        F.sum("rows").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    share = F.col("copies")
    return each.select(
        "doc_id", "text_key", (F.col("n_tokens") / share).cast("long").alias("n_tokens"), (F.col("n_known") / share).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("base_score") / share).alias("base_score"), (F.col("score") / share).alias("score"),
    )
