"""Registered queries of the training-data operators and, where SQL can express them, their counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import brown, chosen_path, decontaminate, langid, licenses, merkle, mixing, setsketch, suffix_dedup, topk, trie, urlfilter, warc
from isobar.llm.common import lower_ascii, table
from isobar.session import materialize, shared_dir


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warc.assign_records(pages, F.col("page_id"), F.col("url"), F.col("html"))
    path = warc.archive_path(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    warc.write_archives(records, path)
    columns = ("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.read_archives(spark, path, columns).withColumnRenamed("id", "page_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = langid.train(documents.where(~held_out & F.col("doc_id").isNotNull()), F.col("doc_id"), F.col("text"), F.col("lang"))
    spans = langid.label_spans(documents.select("doc_id", "text"), F.col("text"), model).select("doc_id", "spans")
    lang_pred, score = langid.main_language(F.col("spans"))
    return spans.select("doc_id", held_out.alias("held_out"), lang_pred.alias("lang_pred"), score.alias("score"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = mixing.word_count(F.col("text"))
    narrow = table(spark, sf_dir, "documents").select("doc_id", "source", "text").select(
        "doc_id", "source", words.alias("words"), mixing.text_quality(F.col("text"), words).alias("quality")
    )
    narrow = materialize(narrow, "mix-sizes")
    mixed = mixing.mix_sources(narrow, F.col("source"), F.col("words"), F.col("quality"), F.col("doc_id"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors = topk.integer_vectors(rows, F.col("vec_id"), F.col("embedding"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.decontaminate(documents, items, F.col("doc_id"), F.col("text"), F.col("item_id"), F.col("text"), keep=["doc_id"])
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated"
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chosen_path.jaccard_classes(documents, F.col("doc_id"), F.col("text")).select("doc_id", "class_id", "n_links")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(documents, F.col("doc_id"), F.col("text"), keep=["doc_id"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base, more = F.col("places.label"), F.col("blocks.label")
    best = F.coalesce(F.array_max(F.col("blocks.share")), F.lit(0.0))
    return found.select(
        "row.doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.start")).alias("first_word"), F.array_max(F.col("places.start")).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(documents, F.col("doc_id"), F.col("text"), keep=["doc_id"])
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    scored = brown.score_texts(documents, F.col("doc_id"), F.col("text"), ~held_out & F.col("doc_id").isNotNull())
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = setsketch.near_duplicates(documents, F.col("doc_id"), F.col("text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = trie.turns_in_order(rows, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    return trie.prefix_trie(trie.with_shared_heads(turns, head, F.col("conv_id") - F.col("conv_id") % 5))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    changed = F.when(tampered, merkle.leaf_digest(*fields, lower_ascii(F.col("text"))))
    proved = merkle.manifest(documents, F.col("doc_id"), F.col("source"), merkle.leaf_digest(*fields, F.col("text")), changed)
    verified = F.col("folded_root") == F.col("root")
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified.alias("verified"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_licenses": op8_licenses,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_brown_lm": op10_brown_lm,
    "op11_setsketch": op11_setsketch,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ", ".join(f"('{text}', '{label}')" for text, label in licenses.TEMPLATES)

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 of an ASCII string, bit by bit.
_CRC32 = """xor(4294967295::bigint, list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split({}, ''), lambda ch: ascii(ch)::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)))"""


def _merkle_sql(levels: int = 6) -> str:
    """Levels and siblings of both trees, written out for up to ``levels`` levels each."""
    fields = {"doc_id": "doc_id::varchar", "source": "source", "lang": "lang", "n_chars": "n_chars::varchar", "text": "{text}"}
    encoded = " || ".join(f"coalesce(strlen({v})::varchar || ':' || {v}, '-')" for v in fields.values())
    leaf, changed = encoded.format(text="text"), encoded.format(text=_LOWER.format("text"))

    def tree(name: str, start: str) -> str:
        """Nodes {name}0.. and siblings {name}s0.. of (tree, idx, width, digest); a finished tree goes up unchanged."""
        parts = [f"{name}0 as ({start})"]
        for n in range(levels):
            parts.append(f"""{name}s{n} as (
                select a.tree, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as l,
                       coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as r, any_value(a.width) as width
                from {name}{n} a join {name}{n} b on a.tree = b.tree and a.idx // 16 = b.idx // 16 group by a.tree, a.idx)""")
            parts.append(f"""{name}{n + 1} as (
                select tree, idx // 16 as idx, max(case when width = 1 then 1 else (width + 15) // 16 end) as width,
                       case when max(width) = 1 then max(digest) else sha256(string_agg(digest, '' order by idx)) end as digest
                from {name}{n} group by tree, idx // 16)""")
        return ", ".join(parts)

    sides = [f"{name}s{n}" for name in "nr" for n in range(levels)]
    joins = " ".join(f"join ns{n} on ns{n}.tree = leaves.tree and ns{n}.idx = leaves.idx // {16**n}" for n in range(levels))
    joins += " join r0 on r0.of = leaves.tree "
    joins += " ".join(f"join rs{n} on rs{n}.idx = r0.idx // {16**n}" for n in range(levels))
    steps, last = [], "coalesce(changed, leaf)"
    for k, side in enumerate(sides):
        steps.append((k, side, last))
        last = f"h{k}"
    columns = ", ".join(f"{s}.l as l{k}, {s}.r as r{k}, {s}.width as w{k}" for k, s in enumerate(sides))
    folds = ", ".join(
        f"f{k} as (select *, case when w{k} = 1 then {before} else sha256(l{k} || {before} || r{k}) end as h{k} from {'ways' if k == 0 else f'f{k - 1}'})"
        for k, _, before in steps
    )
    proof = " || ".join(f"l{k} || r{k}" for k in range(len(sides)))
    return f"""
        with leaves as (
            select doc_id, coalesce('+' || source, '') as tree, sha256({leaf}) as leaf,
                   case when {_CRC32.format("doc_id::varchar")} % 5 = 0 then sha256({changed}) end as changed,
                   row_number() over (partition by source order by doc_id nulls first, sha256({leaf})) - 1 as idx,
                   count(*) over (partition by source) as width from documents),
        {tree("n", "select tree, idx, width, leaf as digest from leaves")},
        {tree("r", f"select '' as tree, row_number() over (order by tree) - 1 as idx, count(*) over () as width, digest, tree as of from n{levels}")},
        ways as (select leaves.*, r0.digest as subroot, r{levels}.digest as root, {columns} from leaves {joins} cross join r{levels}),
        {folds}
        select doc_id, leaf, subroot, root, sha256({proof}) as proof_sha256, h{len(sides) - 1} as folded_root,
               h{len(sides) - 1} = root as verified from f{len(sides) - 1}
    """


ORACLE = {
    "op11_setsketch": f"""
        with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select distinct doc_id, w[i + 1 : i + 3] as g from (select doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) as i from d where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by 1),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
        r(a, b) as (select doc_id, doc_id from d union select r.a, l.b from r join l on l.a = r.b),
        m as (select a, min(b) as component_id from r group by 1)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
        from d left join n on n.doc_id = d.doc_id join m on m.a = d.doc_id
    """,
    "op12_prefix_trie": f"""
        with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                          row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
                          {_CRC32.format("conv_id::varchar")} % 9 as h, conv_id - conv_id % 5 as base
                   from conversations where conv_id is not null),
        c as (select conv_id, any_value(h) as h, any_value(base) as base, count(*) as n from o group by 1),
        k as (select c.*, least(c.h, coalesce(b.n, 0)) as k from c left join c b on b.conv_id = c.base),
        r as (select k.conv_id, o.pos as depth, o.role, o.text from k join o on o.conv_id = k.base and o.pos <= k.k
              union all select k.conv_id, o.pos - k.h + k.k, o.role, o.text from k join o on o.conv_id = k.conv_id and o.pos > k.h),
        l as (select k.conv_id, count(r.conv_id) as len from k left join r on r.conv_id = k.conv_id group by 1),
        p as (select conv_id, depth, strlen(text) as bytes,
                     list(strlen(role) || ':' || role || text) over (partition by conv_id order by depth) as path from r
              union all select conv_id, 0, 0, [] from k),
        w as (select *, min(conv_id) over (partition by path) as node, count(*) over (partition by path) as n_convs from p),
        s as (select w.conv_id, w.depth, w.node, u.node as up, w.n_convs, w.bytes from w left join w u on u.conv_id = w.conv_id and u.depth = w.depth - 1),
        nodes as (select * from s where conv_id = node),
        ch as (select up as node, depth - 1 as depth, count(*) as n_children from nodes where up is not null group by 1, 2),
        sub as (select s.node, s.depth, count(*) filter (coalesce(ch.n_children, 0) = 0) as n_leaves, sum((x.n_convs - 1) * x.bytes) as saved_tokens
                from s join nodes x on x.node = s.conv_id and x.depth >= s.depth
                left join ch on ch.node = x.node and ch.depth = x.depth group by 1, 2),
        e as (select s.node, s.depth, string_agg(s.conv_id::varchar, ',' order by s.conv_id) as ids
              from s join l on l.conv_id = s.conv_id and l.len = s.depth group by 1, 2)
        select n.node as conv_id, n.depth, n.up as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children,
               n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
        from nodes n join sub on sub.node = n.node and sub.depth = n.depth
        left join ch on ch.node = n.node and ch.depth = n.depth left join e on e.node = n.node and e.depth = n.depth
    """,
    "op13_merkle_manifest": _merkle_sql(),
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha256(body) as payload_digest from p),
        f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes, d.payload_digest,
               case when first_id <> page_id then 'revisit' else 'response' end as record_type,
               case when first_id <> page_id then first_id end as refers_to
        from d left join f on d.payload_digest = f.payload_digest
    """,
    "op3_url_filters": f"""
        with rules(rule_host, rule_path, rule_verdict) as (
            values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        rest as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as r from pages),
        cut as (select page_id, r, regexp_extract(r, '^[^/?#]*') as h from rest),
        urls as (select page_id, {_LOWER.format("h")} as host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') as path from cut),
        best as (select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
                        arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
                 from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
                 group by page_id)
        select u.page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict
        from urls u left join best b on u.page_id = b.page_id
    """,
    "op5_topk": """
        with v as (select vec_id, [floor(1024 * cast(x as double)) for x in embedding] as v from embeddings
                   where embedding is not null
                     and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
        select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 10
    """,
    "op6_decontamination": f"""
        with d as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
        b as (select cast(item_id as varchar) as item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from benchmark),
        bw as (select distinct item_id, w[i + 1 : i + least(10, len(w))] as seq
               from (select item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
        lens as (select distinct len(seq) as n from bw),
        dw as (select doc_id, n, i, w[i + 1 : i + n] as seq
               from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from d join lens on len(w) >= n)),
        hit as (select doc_id, i, n, item_id from dw join bw on dw.seq = bw.seq),
        pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
        ids as (select doc_id, list_sort(list(distinct item_id)) as items from hit group by 1)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
               sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join pos on d.doc_id = pos.doc_id left join ids on d.doc_id = ids.doc_id
    """,
    "op8_licenses": f"""
        with phrases(phrase, label) as (
            values (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
        given as (select {_WORDS.format(_LOWER.format("t"))} as w, label from (values {_TEMPLATES}) v(t, label)),
        templates as (select list_distinct(w) as t, label, (len(w) + 15) // 16 * 16 as step from given),
        d as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
        wp as (select doc_id, w, unnest(range(0, len(w))) as i from d),
        base as (select doc_id, i, label from wp join phrases on w[i + 1 : i + len(phrase)] = phrase),
        steps as (select distinct step from templates),
        blocks as (select doc_id, step, list_distinct(w[i + 1 : i + 2 * step]) as words from wp join steps on i % step = 0),
        more as (select doc_id, label, len(list_intersect(words, t)) / len(t) as share from blocks join templates
                 on blocks.step = templates.step and len(list_intersect(words, t)) >= ceil(0.8 * len(t) - 1e-9)),
        b as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word,
                     array_to_string(list_sort(list(distinct label)), ',') as base_labels from base group by 1),
        a as (select doc_id, array_to_string(list_sort(list(distinct label)), ',') as labels
              from (select doc_id, label from base union all select doc_id, label from more) group by 1),
        s as (select doc_id, max(share) as share from more group by 1)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
               case when n_base > 0 then 1.0 else coalesce(share, 0.0) end as score
        from d left join b on d.doc_id = b.doc_id left join a on d.doc_id = a.doc_id left join s on d.doc_id = s.doc_id
    """,
}
