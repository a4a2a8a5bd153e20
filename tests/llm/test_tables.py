import glob
import hashlib
import math
import os
import random
import zipfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isobar.llm import mixing, topk, urlfilter, warc
from tests.llm.data import DOCUMENTS, documents

# --- archives ---------------------------------------------------------------------------------------------

PAGES = [
    (3, "http://a/1", "x" * 200), (1, "http://a/2", "x" * 200), (2, None, "short"), (4, "http://a/\r\nb c", "short"), (5, "u", None), (6, "u", ""),
    (None, "u", "x" * 200), (7, "ü" * 20, "ü" * 60), (8, "v", "ü" * 60), (8, "w", "y" * 300_000), (9, "w", "line\n" * 50), (9, "w", "line\n" * 50),
]


def archived(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "archives")
    warc.write_archives(warc.assign_records(pages, F.col("page_id"), F.col("url"), F.col("html"), **options), path)
    return path


def test_archives_round_trip(spark, tmp_path):
    path = archived(spark, tmp_path, PAGES)
    got = sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=str)
    first = {}
    for i, _, html in PAGES:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(first.get(body, i), i)
    want = []
    for i, url, html in PAGES:
        body = (html or "").encode()
        target = first.get(body) if len(body) >= 100 and first.get(body) != i else None
        url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
        want.append((i, url, "revisit" if target is not None else "response", target, len(body), hashlib.sha256(body).hexdigest(), None if target is not None else bytearray(body)))
    assert got == sorted(want, key=str)


def test_archives_are_valid_packages(spark, tmp_path):
    path = archived(spark, tmp_path, PAGES)
    files = [f for f in glob.glob(f"{path}/part-*") if os.path.getsize(f)]
    assert files
    members = {}
    for name in files:
        with zipfile.ZipFile(name) as package:
            assert package.testzip() is None and package.comment == b"\n"
            assert [i.filename for i in package.infolist()] == [warc.DATA_MEMBER, warc.INDEX_MEMBER]
            assert all(i.compress_type == zipfile.ZIP_STORED for i in package.infolist())
            for info in package.infolist():
                members[os.path.basename(name), info.filename] = (info.file_size, info.CRC)
    listed = warc.list_members(warc.archives(spark, path)).collect()
    assert {(os.path.basename(r["path"]), r["name"]): (r["bytes"], r["crc"]) for r in listed} == members


def test_packages_without_zip64_are_read(tmp_path):
    name = tmp_path / "plain.zip"
    with zipfile.ZipFile(name, "w") as package:
        package.writestr("a.txt", "hello")
        package.writestr("dir/b.txt", "world" * 100)
        package.comment = b"PK\5\6 misleading"
    with warc.open_at(f"file://{name}") as file:
        found = list(warc.members(file, name.stat().st_size))
        assert [(m["name"], m["bytes"]) for m in found] == [("a.txt", 5), ("dir/b.txt", 500)]
        assert warc.read_range(file, found[0]["start"], 5) == b"hello"


def test_archives_of_an_empty_table(spark, tmp_path):
    path = archived(spark, tmp_path, [])
    assert warc.read_archives(spark, path).collect() == []


def test_damaged_payloads_are_noticed():
    good = warc.warc_record(1, "u", b"abc", 3, hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError, match="differs"):
        warc.parse_record(good.replace(b"abc", b"abd"))


# --- URL rules --------------------------------------------------------------------------------------------


def brute_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:end].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[end:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and p is not None and v and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


URLS = [
    "http://example.com/en/x?q#f", "https://WWW.Example.COM/en/", "http://a.b.net/es/ñ", "http://net/fr/", "http://com", "http://com/", "x.com/en/", "", None,
    "://", "http://?a", "http://a..com/b", "http://.com/", "http://com./", "ftp://u:p@h.example.com:80/en/#://", "http://É.net/es/", "http://example.com/e\nn/",
    "http://" + "a." * 500 + "com/" + "p" * 3000, "http://net/es", "http://x.net/fr/a/b/c", "http://x.net/fr/a/b/c",
]
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
    ("x.net", "/fr/a", "allow"), ("x.net", "/fr/a", "block"), (None, "/", "block"), ("org", None, "block"), ("org", "/", None), ("NET", "", "allow"),
]


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, Rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urlfilter.judge_urls(pages, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    lowered = [(h and h.lower(), p, v) for h, p, v in RULES]
    assert {r["page_id"]: tuple(r)[2:] for r in got.collect()} == {i: brute_judge(u, lowered) for i, u in enumerate(URLS)}


def test_urls_without_rules_or_pages(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://net/es/")], "page_id long, url string")
    assert [tuple(r)[2:] for r in urlfilter.judge_urls(pages, rules.limit(0), default="block").collect()] == [("net", "/es/", None, "block")]
    assert urlfilter.judge_urls(pages.limit(0), rules).collect() == []


# --- mixing -----------------------------------------------------------------------------------------------


def water_fill(sizes, weights, cap):
    level = {s: 0.0 for s in sizes}
    open_ = set(sizes)
    total = float(sum(sizes.values()))
    while open_:
        rest = total - sum(level[s] for s in sizes if s not in open_)
        share = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] >= cap * sizes[s]}
        for s in full or open_:
            level[s] = float(cap * sizes[s]) if full else share * weights[s]
        open_ -= full
        if not full:
            break
    return level


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    words = mixing.word_count(F.col("text"))
    out = mixing.mix_sources(docs, F.col("source"), words, mixing.text_quality(F.col("text"), words), F.col("doc_id"))
    return out


def test_mix_meets_its_targets(spark):
    rows = documents(8, 80)
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["size"] == len((r["row"]["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] >= math.floor(r["target"] / max(r["source_size"], 1) + 1e-9) * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixed(spark, rows[::-1]).collect()
    assert sorted((str(r["row"]), r["taken"]) for r in got) == sorted((str(r["row"]), r["taken"]) for r in again)


def test_weights_are_dealt_without_bringing_all_sources_to_one_task(spark):
    names = [None, "", *(f"s{i * 7919 % 3000:05d}" for i in range(3000))]
    weights = mixing.cyclic_weights(spark.createDataFrame([(n,) for n in names], "source string").repartition(4))
    assert "row_number" not in weights._jdf.queryExecution().toString()
    want = {n: (5.0, 2.0, 1.0)[i % 3] for i, n in enumerate(sorted(names, key=lambda n: (n is None, n or "")))}
    assert {r["source"]: r["weight"] for r in weights.collect()} == want


def test_capped_sources_pass_on_their_excess(spark):
    table = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), ("c", 30, 5.0), ("d", 0, 1.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.fill_targets(table, 3.0).collect()}
    want = water_fill({"a": 10, "b": 1000, "c": 30, "d": 0}, {"a": 5, "b": 2, "c": 5, "d": 1}, 3)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_better_texts_come_first(spark):
    rows = [(i, "word " * 20 if i % 2 else "word! # " * 10, "xx", "s", 1, "r", 1) for i in range(400)] + [(1000 + i, "w " * 900, "xx", "t", 1, "r", 1) for i in range(4)]
    got = mixed(spark, rows).where("source = 's'").collect()
    good = sum(r["taken"] > r["size"] * math.floor(r["target"] / r["source_size"]) for r in got if "!" not in r["row"]["text"])
    bad = sum(r["taken"] > r["size"] * math.floor(r["target"] / r["source_size"]) for r in got if "!" in r["row"]["text"])
    assert good > bad


def test_mix_of_an_empty_table(spark):
    assert mixed(spark, []).collect() == []


# --- top k ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "rescore", "step"), [(4096, 256, 32), (16, 3, 8)])
def test_top_k_matches_brute_force(spark, monkeypatch, block, rescore, step):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "RESCORE", rescore)
    monkeypatch.setattr(topk, "STEP", step)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(16)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 320)]  # ties
    rows += [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (403, [float("inf")] + [0.0] * 15), (500, rows[3][1][:5]), (600, []), (None, rows[1][1]), (100, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(frame, F.col("vec_id"), F.col("embedding"))
    ints = [(r["vec_id"], topk.integers(r["v"], 1024)) for r in vectors.collect()]
    assert {i for i, _ in ints} & {400, 401, 402, 403, None} == set()
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0 and vec_id <> 100"), 10).collect()
    want = []
    for q, x in ints:
        if q % 50 or q == 100:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if i != q))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_moves_vectors_and_not_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "PART_BYTES", 3 * 16 * 8 * topk.CELL_BYTES)  # three blocks to a part
    rng = random.Random(9)
    rows = [(i % 590, [rng.gauss(0, 1e9 if i % 50 == 3 else 0.1) for _ in range(8)]) for i in range(600)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id"), F.col("embedding"))
    ints = [(i, topk.integers(v, 1024)) for i, v in rows]
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 3 and vec_id > 9 or vec_id = 20"), 5)
    want = []
    for q, x in ints:
        if q % 100 == 3 and q > 9 or q == 20:
            scores = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if i != q))[:5]
            want += [(q, n + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan  # one row a vector, whatever the number of parts


def test_top_k_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(frame, F.col("vec_id"), F.col("embedding"))
    assert [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id = 0")).collect()] == [(0, 1, 1, 512 * 1024 + 512 * 2048)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_top_k_with_components_of_any_size(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [rng.choice((-1, 1)) * 10.0**e, rng.gauss(0, 1), 2.0**-30, 0.0]) for i, e in enumerate((5, 8, 14, 15, 100, 300, 307, 308, 308))]
    rows += [(200, [1.7976931348623157e308] * 4), (201, [-1e300, 1e300, 1e-300, 5.0]), (202, [float(2**53 + 2), 0.5, 0.25, -0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(frame, F.col("vec_id"), F.col("embedding"))
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0 or vec_id > 99"), 7).collect()
    ints = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in rows}
    want = []
    for q in ints:
        if q % 20 and q <= 99:
            continue
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:7]
        want += [(q, n + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


# --- pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rows = documents(9, 60)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf_dir = str(tmp_path)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    leak = next(r for r in rows if r[0] == 4)[1]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "suffix_dedup", "decontamination", "mixing"]
    columns, now, counts = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        now.write.parquet(f"{sf_dir}/{name}")
        now = spark.read.parquet(f"{sf_dir}/{name}")
        counts.append(now.count())
        assert now.columns[:5] == columns and (name == "mixing" or now.columns == columns)
    without_letters = sum(not any(c.isalpha() for c in r[1] or "") for r in rows)
    assert counts[0] == len(rows) - without_letters
    kept = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/near_duplicates").collect()}
    hot = [r[0] for r in rows if r[1] == rows[0][1]]
    assert set(hot) & kept == {0}
    assert 4 in kept and 4 not in {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/decontamination").collect()}
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, now.collect()))


def test_pipeline_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
