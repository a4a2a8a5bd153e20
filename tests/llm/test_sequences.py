import hashlib
import random

from pyspark.sql import functions as F

from isobar.llm import decontaminate, licenses, sequences
from isobar.llm.queries import ORACLE, QUERIES
from tests.llm.data import DOCUMENTS, alnum, documents


def items_of(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    cut = [" ".join(texts[i].split()[3 : 3 + n]).upper() for i, n in ((0, 10), (1, 14), (5, 4), (9, 1), (20, 25))]
    return [(1, cut[0]), (2, cut[1]), (3, cut[2]), (4, cut[3]), (10, cut[4]), (10, cut[4]), (None, cut[1]), (11, None), (12, " .,;"), (13, "not in any text at all")]


def expected(rows, items):
    windows = {}
    for item, text in items:
        words = alnum(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).add(item)
    out = []
    for r in rows:
        words, hit, found = alnum(r[1]), set(), set()
        for window, ids in windows.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= {str(x) for x in ids if x is not None}
        out.append((r[0], len(words), len(hit), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def decontaminated(spark, rows, items):
    docs, bench = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(docs, bench, F.col("doc_id"), F.col("text"), F.col("item_id"), F.col("text"))
    assert found.select("row.*").columns == docs.columns
    got = found.select("row.doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_decontamination_matches_brute_force(spark):
    rows = documents()
    items = items_of(rows)
    assert decontaminated(spark, rows, items) == expected(rows, items)


def test_decontamination_without_broadcast(spark, monkeypatch):
    rows = documents(3, 30)
    items = items_of(rows)
    monkeypatch.setattr(sequences, "BROADCAST_BYTES", 0)
    assert decontaminated(spark, rows, items) == expected(rows, items)


def test_decontamination_of_empty_tables(spark):
    rows = documents(2, 6)
    assert decontaminated(spark, [], items_of(documents())) == []
    assert decontaminated(spark, rows, []) == expected(rows, [])


def scanned(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    return licenses.scan_licenses(docs, F.col("doc_id"), F.col("text"))


def test_license_phrases_and_blocks(spark):
    filler = "lorem ipsum dolor sit amet " * 30
    rows = [
        (1, f"{filler} Released under the MIT-License. {filler} the MIT\nLicense", "a"),
        (2, f"{filler} this work is licenced under the GNU General Public Licence, version 3", "b"),  # template without its phrase
        (3, f"{filler}", "c"), (4, None, None), (5, "", ""), (None, "mit license", "x"), (1, f"{filler} Released under the MIT-License. {filler} the MIT\nLicense", "a"),
        (6, "Licensed under CC BY-NC 4.0.", "x"), (7, "mit " * 50, "x"), (8, "license mit", "x"),
    ]
    got = {}
    for r in scanned(spark, rows).collect():
        got.setdefault(r["row"]["doc_id"], []).append(r)
    assert len(got[1]) == 2 and got[1][0] == got[1][1]
    assert [(p["start"], p["label"]) for p in got[1][0]["places"]] == [(153, "mit"), (306, "mit")]
    assert got[2][0]["places"] == [] and {b["label"] for b in got[2][0]["blocks"]} == {"gpl"}
    assert got[3][0]["places"] == got[3][0]["blocks"] == [] and got[3][0]["n_words"] == 150
    assert got[4][0]["n_words"] == got[5][0]["n_words"] == 0
    assert [p["start"] for p in got[None][0]["places"]] == [0]
    assert {b["label"] for b in got[6][0]["blocks"]} == {"cc-by-nc"}
    assert got[7][0]["places"] == got[8][0]["places"] == []


def test_license_blocks_match_brute_force(spark):
    rows = [(i, r[1], "x") for i, r in enumerate(documents(5, 40))]
    template = (" ".join(rows[2][1].split()[6:20]), "t")
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = licenses.scan_licenses(docs, F.col("doc_id"), F.col("text"), phrases=(("mit license", "mit"),), templates=(template,))
    want = {}
    tokens = set(alnum(template[0]))
    for i, text, _ in rows:
        words = alnum(text)
        for b in range(0, max(len(words), 1), licenses.STRIDE):
            share = len(tokens & set(words[b : b + licenses.BLOCK])) / len(tokens)
            if share >= licenses.CONTAINMENT - 1e-9:
                want.setdefault(i, []).append((b, round(share, 9)))
    assert want
    assert {r["row"]["doc_id"]: [(b["start"], round(b["share"], 9)) for b in r["blocks"]] for r in got.collect() if r["blocks"]} == want


def test_license_scan_of_an_empty_table(spark):
    assert scanned(spark, []).collect() == []


def test_native_plans_have_no_python(spark):
    for name in ("op6_decontamination", "op8_licenses"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
        assert name in ORACLE


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_long_licenses_are_found_at_every_offset(spark):
    long = " ".join(f"clause{i % 190} w{i}" for i in range(150))  # 300 words
    filler = [f"filler{i}" for i in range(700)]
    rows = [(i, " ".join([*filler[:i], long, *filler[i:]]), "x") for i in (*range(0, 40), 303, 304, 305, 699)]
    rows += [(1000 + i, " ".join(long.split()[: 300 - i]), "x") for i in (0, 55, 65)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = licenses.scan_licenses(docs, F.col("doc_id"), F.col("text"), templates=((long, "long"),))
    found = {r["row"]["doc_id"]: {b["label"] for b in r["blocks"]} for r in got.collect()}
    assert {i for i, labels in found.items() if labels == {"long"}} == {r[0] for r in rows} - {1065}


def test_whole_licenses_are_labelled(spark):
    rows = [(i, f"{'prose ' * (37 * i)} {text.upper()} {'more ' * 20}", label) for i, (text, label) in enumerate(licenses.PARAGRAPHS)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, want string"), F.col("doc_id"), F.col("text")).collect()
    assert len(got) == len(rows) and all(r["row"]["want"] in {b["label"] for b in r["blocks"] if b["share"] == 1.0} for r in got)


def test_license_paragraphs_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        words = licenses.words_of(licenses.PARAGRAPHS[i % len(licenses.PARAGRAPHS)][0])
        kept = [w for w in words if rng.random() < 0.86]  # some sink below the threshold
        rows.append((i, " ".join([*(f"f{rng.randrange(50)}" for _ in range(rng.randrange(400))), *kept, "tail"]), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = licenses.scan_licenses(docs, F.col("doc_id"), F.col("text"))
    want = {}
    for i, text, _ in rows:
        words, best = text.split(), {}
        for template, label in licenses.TEMPLATES:
            tokens, step = set(licenses.words_of(template)), licenses.step_of(licenses.words_of(template))
            for b in range(0, len(words), step):
                share = len(tokens & set(words[b : b + 2 * step])) / len(tokens)
                if share >= licenses.CONTAINMENT - 1e-9:
                    best[b, label] = max(best.get((b, label), 0), round(share, 9))
        want[i] = sorted((b, label, share) for (b, label), share in best.items())
    assert {r["row"]["doc_id"]: [(b["start"], b["label"], round(b["share"], 9)) for b in r["blocks"]] for r in got.collect()} == want
    assert any(want.values()) and not all(want.values())
