import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobar.llm import brown, chosen_path, langid, suffix_dedup
from isobar.llm.components import components
from tests.llm.data import DOCUMENTS, alnum, documents

# --- shingles and classes ---------------------------------------------------------------------------------


def shingle_set(text):
    words = alnum(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows):
    sets = [shingle_set(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, r in enumerate(rows):
        members = [rows[k][0] for k in range(len(rows)) if find(k) == find(i)]
        known = [m for m in members if m is not None]
        out.append((r[0], (None if None in members else min(known)) if sets[i] else None, links[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("small", "block"), [(512, 512), (4, 3)])
def test_jaccard_classes_match_brute_force(spark, small, block):
    rows = [r for r in documents(4, 70)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = chosen_path.jaccard_classes(docs, F.col("doc_id"), F.col("text"), small=small, block=block)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=str) == brute_classes(rows)


def test_jaccard_classes_of_an_empty_table(spark):
    assert chosen_path.jaccard_classes(spark.createDataFrame([], DOCUMENTS), F.col("doc_id"), F.col("text")).collect() == []


def test_runs_follow_the_recall():
    assert chosen_path.runs_for(0.9) <= chosen_path.runs_for(0.999) <= chosen_path.runs_for(0.99999)
    assert chosen_path.runs_for(0.999) == 3


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (7, 6)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- repeated passages ------------------------------------------------------------------------------------


def brute_cut(rows):
    """Rows in order of id, nulls last; rows with one id and text are one document."""
    seen, out = {}, {}
    distinct = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    for number, (key, text) in enumerate(distinct):
        data = text.encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 99):
            if seen.setdefault(data[i : i + 100], (number, i)) != (number, i):
                covered[i : i + 100] = b"\1" * 100
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out[key, text] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((r[0], *out[r[0], r[1] or ""]) for r in rows), key=str)


@pytest.mark.parametrize("frequent", [16, 2, 10**9])
def test_repeats_match_brute_force(spark, frequent, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    rows = documents(6, 50)
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    got = suffix_dedup.remove_repeats(docs, F.col("doc_id"), F.col("text"))
    assert got.select("row.*").columns == docs.columns
    found = got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_cut(rows)


def test_repeats_of_exactly_the_length(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(100))
    rows = [(2, f"x{passage}y"), (1, f"1{passage}2"), (3, passage[:99] + "#"), (4, f"{passage[1:]}!"), (5, passage * 2)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"), F.col("text"))
    assert {r["row"]["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got.collect()} == {1: (0, 0), 2: (100, 1), 3: (0, 0), 4: (0, 0), 5: (200, 1)}


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCUMENTS), F.col("doc_id"), F.col("text")).collect() == []


def test_long_texts_are_cut_into_overlapping_segments():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    offsets = np.array([0, 7000, 7050, 9000])
    whole = suffix_dedup.parts_of(data, offsets, np.zeros(0, np.uint64))
    original = suffix_dedup.segments
    suffix_dedup.segments = lambda o: original(o, 500)
    try:
        pieces = suffix_dedup.parts_of(data, offsets, np.zeros(0, np.uint64))
    finally:
        suffix_dedup.segments = original
    def spread(parts):
        return sorted((d, s + k, int(c)) for d, s, n, c in zip(parts.doc, parts.start, parts.count, parts.core) for k in range(n))
    assert spread(whole) == spread(pieces)
    assert len(spread(whole)) == (7000 - 99) + (1950 - 99)


@pytest.mark.parametrize("kept", [0xFFFFFFFF << 32, 0])
def test_cores_with_one_hash_do_not_part_equal_strings(monkeypatch, kept):
    """Cores that agree in their low 32 bits, or in all, must not hide a repeat."""
    rng = random.Random(12)
    passages = ["".join(rng.choice("abcd") for _ in range(130)) for _ in range(60)]
    texts = ["".join(rng.choice("abcd") for _ in range(60)) + p + "".join(rng.choice("abcd") for _ in range(60)) for p in passages * 2]
    rows = [(i, t) for i, t in enumerate(texts)]
    original = suffix_dedup.parts_of

    def colliding(*args):
        parts = original(*args)
        parts.core = parts.core & np.uint64(kept)
        return parts

    monkeypatch.setattr(suffix_dedup, "parts_of", colliding)
    docs = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text_key": [0] * len(rows), "text": texts})
    chunks = suffix_dedup._fingerprints(1, np.zeros(0, np.uint64))(iter([docs]))
    found = [r for b in suffix_dedup._compare_parts(chunks) for r in b.to_pylist()]
    spans = [r for r in found if r["offset"] < 0]
    asked = [[{"start": r["start"], "count": r["length"], "offset": r["offset"], "core": r["core"]} for r in found if r["offset"] >= 0 and r["doc_id"] == i] for i, _ in rows]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32()), ("offset", pa.int32()), ("core", pa.int64())]))
    parts = pa.Table.from_batches(suffix_dedup._cut_parts(iter([docs.append_column("asked", pa.array(asked, kind))]))).sort_by("core")
    spans += [r for b in suffix_dedup._settle(iter(parts.combine_chunks().to_batches())) for r in b.to_pylist()]
    covered = {i: set() for i, _ in rows}
    for r in spans:
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
    assert [(i, len(covered[i])) for i, _ in rows] == [(i, removed) for i, _, removed, _, _ in sorted(brute_cut(rows))]


def test_deep_shallow_sorting_orders_like_bytes():
    rng = random.Random(5)
    base = bytes(rng.randrange(3) for _ in range(104))
    strings = [base] * 5 + [base[:k] + bytes(rng.randrange(3) for _ in range(104 - k)) for k in (0, 20, 40, 60, 80, 90, 103) for _ in range(6)]
    rng.shuffle(strings)
    order = suffix_dedup.blind_trie(strings)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
    group = np.array([i % 4 for i in range(len(strings))])
    text = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 104)
    order = suffix_dedup.deep_shallow(group, np.ascontiguousarray(text), 0)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings))


# --- language ---------------------------------------------------------------------------------------------

LATIN = {"aa": ("the", "and", "that", "with", "this"), "bb": ("und", "der", "nicht", "ist", "sich")}


def sentence(rng, lang, n):
    return " ".join(rng.choice(LATIN[lang]) + rng.choice(("", "en", "ly") if lang == "aa" else ("", "ung", "keit")) for _ in range(n))


def labelled(n=60):
    rng = random.Random(3)
    rows = [(i, sentence(rng, "aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb") for i in range(n)]
    return rows + [(1000 + i, "привет как дела " * 5, "cc") for i in range(5)] + [(2000, None, "aa"), (2001, "the and", None)]


def test_spans_of_mixed_text(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, lang string")
    model = langid.train(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    assert model.languages == ["aa", "bb", "cc"]
    rng = random.Random(8)
    mixed = f"{sentence(rng, 'aa', 20)}. {sentence(rng, 'bb', 25)}! {'как дела ' * 6}"
    rows = [(1, mixed, "s"), (2, None, "s"), (3, "", "s"), (4, "12 34 !!", "s"), (5, "漢字 かな", "s"), (6, sentence(rng, "bb", 20000), "s")]
    spans = langid.label_spans(spark.createDataFrame(rows, "doc_id long, text string, spans string").drop("spans"), F.col("text"), model)
    lang, score = langid.main_language(F.col("spans"))
    got = {r["doc_id"]: r for r in spans.select("*", lang.alias("lang_pred"), score.alias("score")).collect()}
    assert [(s["start"], s["end"], s["lang"]) for s in got[1]["spans"]] == [(0, 20, "aa"), (20, 45, "bb"), (45, 57, "cc")]
    assert all(got[i]["spans"] == [] and got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4))
    assert got[5]["lang_pred"] == model.languages[model.frequent]
    assert got[6]["lang_pred"] == "bb" and got[6]["spans"][-1]["end"] == 20000


def test_words_of_another_script_are_spans_of_their_own(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, lang string")
    model = langid.train(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    rows = [(1, "the and привет that with"), (2, "привет the как дела"), (3, "the and that with привет как this the and"), (4, "the 漢字 and")]
    got = langid.label_spans(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), model).collect()
    spans = {r["doc_id"]: [(s["start"], s["end"], s["lang"]) for s in r["spans"]] for r in got}
    assert spans[1] == [(0, 2, "aa"), (2, 3, "cc"), (3, 5, "aa")]
    assert spans[2] == [(0, 1, "cc"), (1, 2, "aa"), (2, 4, "cc")]
    assert spans[3] == [(0, 4, "aa"), (4, 6, "cc"), (6, 9, "aa")]
    assert spans[4] == [(0, 3, "aa")]  # a script that no language uses follows its neighbours


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    doc = np.array([0, 0, 0, 0, 2, 2, 2, 2, 2])
    got = langid.viterbi(scores, doc, 4, 1.0)
    for d in (0, 2):
        own = scores[doc == d]
        def value(path):
            return sum(own[i, p] for i, p in enumerate(path)) - sum(a != b for a, b in zip(path, path[1:]))
        best = max(np.ndindex(*[3] * len(own)), key=value)
        assert abs(value(best) - value(tuple(got[doc == d]))) < 1e-4


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    assert langid.label_spans(docs, F.col("text"), model).first()["spans"] == []


# --- scores -----------------------------------------------------------------------------------------------


def test_base_scores_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in documents(7, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    got = brown.score_texts(docs, F.col("doc_id"), F.col("text"), train, clustered=40, classes=6, passes=4, head=60).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, tokens)), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 for r in got)


def test_model_sums_to_one_and_beats_unigrams(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("red", "blue", "green")) + " " + rng.choice(("cat", "dog", "fox")) for _ in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = brown.score_texts(docs, F.col("doc_id"), F.col("text"), F.col("doc_id") < 50, clustered=6, classes=2).where("doc_id >= 50").collect()
    assert sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)
    counts = brown.word_counts(docs.select("text"))
    model = brown.fit(docs.select("text"), counts, 6, 2, 8, 100)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    colours = {model.classes[model.vocabulary.ids[i]] for i, w in enumerate(model.vocabulary.words)}
    assert len(colours) == 2


def likelihood(counts, of):
    table = brown.class_table(counts, of)
    return brown.xlogx(table).sum() - brown.xlogx(table.sum(axis=0)).sum() - brown.xlogx(table.sum(axis=1)).sum()


@pytest.mark.parametrize("seed", [0, 1, 4])
def test_exchange_ends_where_no_word_gains_by_a_move(seed):
    words, classes = 60, 7
    size = words + brown.FORMS + 1
    walk = np.random.default_rng(seed).integers(0, size, 3000)
    counts = np.zeros((size, size))
    np.add.at(counts, (walk, np.roll(walk, -1)), 1)
    of = brown.exchange(counts, words, classes, brown.PASSES)
    best = likelihood(counts, of)
    for word in range(words):
        for c in range(classes):
            moved = of.copy()
            moved[word] = c
            assert likelihood(counts, moved) <= best + 1e-6


def mixed_texts(n=60):
    """Colours before animals, of which most are rare; words with digits, marks and other letters; a repeated rare word."""
    rng = random.Random(3)
    first, second = [f"red{'abcdefghij'[i % 10]}{'klmn'[i // 10]}" for i in range(40)], [f"cat{'abcdefghij'[i % 10]}{'klmn'[i // 10]}" for i in range(40)]
    pick = lambda words: words[min(int(rng.expovariate(0.15)), len(words) - 1)]
    rows = [(i, " ".join(f"{pick(first)} {pick(second)}" + rng.choice(("", "", "", " x1", " end.", " äö")) for _ in range(12))) for i in range(n)]
    return [*rows, (n, "odd odd odd catak"), (n + 1, "odd odd odd catak"), (n + 1, "odd odd odd catak"), (n + 2, None), (n + 3, "new new redak 7new"), (None, "redak new")]


def test_every_word_is_placed_where_the_likelihood_is_largest(spark):
    rows = mixed_texts()
    texts = spark.createDataFrame(rows, "doc_id long, text string").select(F.coalesce("text", F.lit("")).alias("text")).repartition(3)
    counts = brown.word_counts(texts)
    lexicon = brown.learn(texts, counts, 8, 3, None, 20)
    got = {r["word"]: (r["class"], r["n"]) for r in lexicon.words.collect()}
    data, offsets = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8), np.cumsum([0] + [len((t or "").encode()) for _, t in rows])
    word, form, doc = brown.tokens(data, offsets)
    some, place = np.unique(word, return_inverse=True)
    before, after, _ = brown.sequences(place, doc, len(rows), len(some))
    bigrams = np.zeros((len(some) + 1, len(some) + 1))
    np.add.at(bigrams, (before, after), 1)
    of = np.full(len(some) + 1, lexicon.learned + brown.FORMS)
    of[place] = lexicon.learned + form
    core = lexicon.vocabulary.ids >= 0
    assert core.sum() == 8 and len(got) == len(some) - 8
    of[np.searchsorted(some, lexicon.vocabulary.words[core])] = lexicon.classes[lexicon.vocabulary.ids[core]]
    learned = 0
    for i, w in enumerate(some[: len(some)]):
        if int(w.astype(np.int64)) not in got:
            continue
        choices = [*range(lexicon.learned), of[i]]
        values = []
        for c in choices:
            moved = of.copy()
            moved[i] = c
            values.append(likelihood(bigrams, moved))
        c, n = got[int(w.astype(np.int64))]
        assert n == bigrams[i].sum() and max(values) - values[choices.index(c)] < 1e-6
        learned += c < lexicon.learned
    assert learned > 50  # most words are outside the core


@pytest.mark.parametrize("head", [20, 1 << 17])
def test_scores_use_the_classes_of_all_words(spark, head):
    rows = mixed_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = brown.score_texts(docs, F.col("doc_id"), F.col("text"), F.col("doc_id") < 62, clustered=8, classes=3, head=head).collect()
    texts = docs.where("doc_id < 62").select(F.coalesce("text", F.lit("")).alias("text"))
    lexicon = brown.learn(texts, brown.word_counts(texts), 8, 3, None, head)
    of = {r["word"]: (r["class"], r["n"]) for r in lexicon.words.collect()}
    core = lexicon.vocabulary.ids >= 0
    of |= {int(w.astype(np.int64)): (lexicon.classes[i], n) for w, i, n in zip(lexicon.vocabulary.words[core], lexicon.vocabulary.ids[core], lexicon.vocabulary.counts[core])}
    width, paths = lexicon.learned + brown.FORMS + 1, []
    for _, text in rows:
        raw = (text or "").encode()
        word, form, _ = brown.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) if raw else (np.zeros(0, np.uint64), [], None)
        paths.append([(width - 1, 0), *[of.get(int(w.astype(np.int64)), (lexicon.learned + f, 0)) for w, f in zip(word, form)], (width - 1, 0)])
    table = np.zeros((width, width))
    for (i, _), path in zip(rows, paths):
        if i is not None and i < 62:
            for (a, _), (b, _) in zip(path, path[1:]):
                table[a, b] += 1
    arriving, staying = table.sum(axis=0), Counter(c for c, n in of.values())
    want = []
    for (i, _), path in zip(rows, paths):
        steps = sum(math.log10((table[a, b] + brown.ALPHA) / (table[a].sum() + brown.ALPHA * width)) for (a, _), (b, _) in zip(path, path[1:]))
        formed = [(c, n) for c, n in path[1:-1] if c >= lexicon.learned]
        steps += sum(math.log10((n + 1) / (arriving[c] + staying[c] + 1)) for c, n in formed) + sum(math.log10(n / arriving[c]) for c, n in path[1:-1] if c < lexicon.learned)
        want.append((i, round(steps, 6)))
    assert sorted(((r["doc_id"], round(r["score"], 6)) for r in got), key=str) == sorted(want, key=str)
    kept = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 60]
    assert sum(r["score"] for r in kept) > 0.85 * sum(r["base_score"] for r in kept)  # 0.94 with all words outside the core in the classes of their forms


def test_words_that_go_on_over_many_batches_are_placed_as_one(spark, monkeypatch):
    table = np.random.default_rng(2).integers(1, 50, (7, 7)).astype(float) * 1000
    rng = np.random.default_rng(3)
    rows = [(int(w), int(3 * 64 + rng.integers(0, 7) * 8 + rng.integers(0, 7)), int(rng.integers(1, 4))) for w in np.repeat([5, 6, 9], (40, 3000, 2))]
    columns = [np.array(c) for c in zip(*rows)]
    want = [*zip(*(x.tolist() for x in brown.best_places(columns[0], columns[1].astype(np.int32), columns[2], table, 2)))]
    frame = spark.createDataFrame(rows, "word long, code int, n long").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "700", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for most in (10, 1 << 15):
                monkeypatch.setattr(brown, "MOST_ROWS", most)
                assert sorted(map(tuple, brown.place_words(frame, table, 2).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_core_is_filled_where_many_words_are_equally_frequent(spark):
    counts = spark.createDataFrame([(i, 3, 7) for i in range(50)] + [(99, 3, 900)], "word long, form int, n long")
    vocabulary = brown.frequent_words(counts, 10, 5)
    assert vocabulary.clustered == 5 and sorted(vocabulary.words.tolist()) == [0, 1, 2, 3, 99]


def test_scores_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = brown.score_texts(docs, F.col("doc_id"), F.col("text"), F.lit(False)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert brown.score_texts(docs.limit(0), F.col("doc_id"), F.col("text"), F.lit(True)).collect() == []
