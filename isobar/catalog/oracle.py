"""SQL counterparts of the registered queries, in the DuckDB dialect.

Each text is independent of the Spark code: plain joins, windows and recursion over the given tables.
Lambdas use the ``lambda x:`` form. Shared building blocks are common table expressions.
"""

from __future__ import annotations

from collections import namedtuple

# Fixed values, written out here so that the code under test does not supply them: label-graph configurations (name,
# seeds, activation cap), coast anchors, the frozen profile, the names of the model inputs.
GRAPH_CONFIGS = (("g18_seed20_cap200", 20, 200), ("g19_seed16_cap200", 16, 200), ("gwide_seed20_cap500", 20, 500), ("gdeep_seed40_cap500", 40, 500))
COAST_ANCHORS = ((18.2, 109.5), (22.3, 114.2), (24.0, 118.3), (25.0, 121.5), (28.0, 121.0), (31.2, 121.5), (35.0, 139.7))
SELECTED_PROFILE = "lgbm_ranker_grade_leaves63_lr03|blend_f0.10_m0.45_g0.30_c0.15_s0.00|anchor_keep5"
FEATURE_NAMES = """score_final score_calibrated score_event_rank_prior score_context_rank_prior score_pool_rank_prior
  source_event_rank source_sequence_rank source_min_rank source_rank_gap rank_inv source_event_rank_inv
  source_sequence_rank_inv source_min_rank_inv source_event_rank_inv_safe source_sequence_rank_inv_safe
  source_min_rank_inv_safe source_rank_gap_inv_safe score_final_minus_calibrated score_final_plus_calibrated
  g18_seed20_cap200 g18_seed20_cap200_z g19_seed16_cap200 g19_seed16_cap200_z gwide_seed20_cap500
  gwide_seed20_cap500_z gdeep_seed40_cap500 gdeep_seed40_cap500_z graph_max graph_mean graph_max_z graph_mean_z""".split()
MODEL_ONLY = "lambdarank_only"

Profile = namedtuple("Profile", "name base model graph calibrated source")


def profile_grid() -> list[Profile]:
    """Weights in hundredths; a profile needs a floating point rest that is not negative."""
    out = [Profile(MODEL_ONLY, 0.0, 1.0, 0.0, 0.0, 0.0)]
    for m in (35, 45, 55, 65):
        for g in (10, 20, 30):
            for c in (5, 15, 25):
                for s in (0, 6):
                    rest = 1.0 - m / 100 - g / 100 - c / 100 - s / 100
                    if rest >= 0:
                        out.append(Profile(f"blend_f{rest:.2f}_m{m / 100:.2f}_g{g / 100:.2f}_c{c / 100:.2f}_s{s / 100:.2f}", rest, m / 100, g / 100, c / 100, s / 100))
    return out


NAMES = [n for n, _, _ in GRAPH_CONFIGS]
METRICS = ("recall_at_10", "recall_at_20", "ndcg_at_10", "map_at_10")


def l2(a: str, b: str) -> str:
    gap = "cast(z[1] - z[2] as double)"
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {gap} * {gap}))"


def knn(name: str, first: int, last: int, k: int, table: str = "vecs") -> str:
    return f"""{name} as (select q, a, d, rk from (
  select q.id q, a.id a, {l2(f'q.v[{first}:{last}]', f'a.v[{first}:{last}]')} d,
    row_number() over (partition by q.id order by {l2(f'q.v[{first}:{last}]', f'a.v[{first}:{last}]')}, a.id) rk
  from {table} q join {table} a on q.id <> a.id and q.g <> a.g) where rk <= {k})"""


VECS = """vecs as (select cast(vec_id as varchar) id, vec_id, embedding v, cast(label as varchar) g from embeddings)"""
WINDOWS = """wins as (select cast(vec_id as varchar) id, case when label < 5 then 'warm' else 'cold' end tp,
  cast((vec_id - vec_id % 6) * 3600 as double) s, cast((vec_id - vec_id % 6 + 6 + vec_id % 42) * 3600 as double) e from embeddings)"""
EVENT = knn("k_event", 1, 32, 40)
CONTEXT = knn("k_context", 1, 64, 40)
METADATA = knn("k_meta", 33, 48, 20)
TRUTH = knn("k_truth", 33, 64, 20)


def fused_rows(prefix: str, event: str, context: str, metadata: str) -> str:
    """Rank union of three channels with sentinel ranks and the pool order."""
    return f"""{prefix}stacked as (
  select q, a, 0 ch, rk, d from {event} union all
  select q, a, 1 ch, rk, d from {context} union all
  select q, a, 2 ch, rk, d from {metadata}),
{prefix}folded as (
  select q, a, max(case when ch = 0 then rk end) re, max(case when ch = 1 then rk end) rc,
    max(case when ch = 2 then rk end) rm, max(case when ch = 0 then d end) de, max(case when ch = 1 then d end) dc,
    min(rk) mn, min(ch) fc
  from {prefix}stacked group by q, a),
{prefix}pool0 as (
  select *, coalesce(re, 61) fe, coalesce(rc, 61) fx, coalesce(rm, 61) fm from {prefix}folded),
{prefix}pool1 as (
  select *, row_number() over (partition by q order by mn, fc, fe, fx, fm, a) pr from {prefix}pool0)"""


POOL = f"""{VECS}, {EVENT}, {CONTEXT}, {METADATA}, {TRUTH},
{fused_rows('', 'k_event', 'k_context', 'k_meta')},
pool as (
  select p.q, p.a, p.pr, p.mn, p.re, p.rc, p.rm, p.fe, p.fx, p.fm, p.de, p.dc,
    greatest(p.fe, p.fx, p.fm) - least(p.fe, p.fx, p.fm) gap,
    1 / (1 + p.de) score_final, 1 / (1 + p.dc) score_calibrated,
    10 - ((t.rk - 1) // 2) grade, t.rk is not null rel,
    case when cast(p.q as bigint) / (n.m + 1) < 0.8 then 'train'
         when cast(p.q as bigint) / (n.m + 1) < 0.9 then 'validation' else 'test' end split
  from pool1 p left join k_truth t on t.q = p.q and t.a = p.a
  cross join (select max(vec_id) m from embeddings) n where p.pr <= 60)"""


def z(value: str, keys: str = "q") -> str:
    over = f"over (partition by {keys})"
    return (
        f"cast(({value} - avg({value}) {over}) / case when stddev_pop({value}) {over} > 1e-9 "
        f"then stddev_pop({value}) {over} else 1.0::double end as float)"
    )


EDGES = """edges as (
  select q tq, a c, 1 + cast(grade as double) / (select greatest(max(grade), 1) from pool where split = 'train' and rel) w
  from pool where split = 'train' and rel)"""


def graph_ctes(source: str = "pool") -> str:
    parts = [
        f"""seedscore as (select q, a, cast(0.7 as float) * {z('coalesce(score_final, 0)')}
      + cast(0.3 as float) * {z('1 / (1 + cast(mn as double))')} s from {source}),
    seeds as (select q, a, sr from (select q, a, row_number() over (partition by q order by s desc, a) sr from seedscore) where sr <= 40)"""
    ]
    for name, k, cap in GRAPH_CONFIGS:
        parts.append(
            f"""act_{name} as (select q, tq, act from (
        select q, tq, act, row_number() over (partition by q order by act desc, fs, tq) ar from (
          select s.q, e.tq, sum(e.w / s.sr) act, min(s.sr) fs from seeds s join edges e on e.c = s.a
          where s.sr <= {k} group by s.q, e.tq)) where ar <= {cap}),
      norm_{name} as (select q, sum(act) + 1e-6 nrm from act_{name} group by q),
      prop_{name} as (select x.q, e.c a, sum(x.act * e.w) p from act_{name} x join edges e on e.tq = x.tq group by x.q, e.c)"""
        )
    columns = ", ".join(f"cast(coalesce(p_{n}.p / n_{n}.nrm, 0) as float) {n}" for n in NAMES)
    joins = " ".join(
        f"left join prop_{n} p_{n} on p_{n}.q = {source}.q and p_{n}.a = {source}.a left join norm_{n} n_{n} on n_{n}.q = {source}.q"
        for n in NAMES
    )
    parts.append(f"graph0 as (select {source}.*, {columns} from {source} {joins})")
    parts.append(
        f"graph1 as (select *, greatest({', '.join(NAMES)}) graph_max, "
        f"cast(({' + '.join(NAMES)}) / 4.0::double as float) graph_mean from graph0)"
    )
    zs = ", ".join(f"{z(f'cast({n} as double)')} {n}_z" for n in (*NAMES, "graph_max", "graph_mean"))
    parts.append(f"graph2 as (select *, {zs} from graph1)")
    return ", ".join(parts)


# The 31 inputs by name, on top of the graph columns.
DERIVED = {
    "score_final": "score_final",
    "score_calibrated": "score_calibrated",
    "score_event_rank_prior": "1 / (fe + 1.0::double)",
    "score_context_rank_prior": "1 / coalesce(rc + 1.0::double, 62.0::double)",
    "score_pool_rank_prior": "1 / (pr + 1.0::double)",
    "source_event_rank": "cast(fe as double)",
    "source_sequence_rank": "61.0::double",
    "source_min_rank": "cast(mn as double)",
    "source_rank_gap": "cast(gap as double)",
    "rank_inv": "1 / (pr + 1.0::double)",
    "source_event_rank_inv": "1 / (fe + 1.0::double)",
    "source_sequence_rank_inv": "1 / 62.0::double",
    "source_min_rank_inv": "1 / (mn + 1.0::double)",
    "source_event_rank_inv_safe": "1 / (1.0::double + fe)",
    "source_sequence_rank_inv_safe": "1 / 62.0::double",
    "source_min_rank_inv_safe": "1 / (1.0::double + mn)",
    "source_rank_gap_inv_safe": "1 / (1.0::double + gap)",
    "score_final_minus_calibrated": "coalesce(score_final, 0) - coalesce(score_calibrated, 0)",
    "score_final_plus_calibrated": "coalesce(score_final, 0) + coalesce(score_calibrated, 0)",
}
FEATURES = f"{POOL}, {EDGES}, {graph_ctes()}"


def growth(leaves: int, min_child: int, bins: int) -> str:
    """Best-first growth of the balanced classifier's first tree on the rank columns, written out split by split."""
    columns = {"pool_rank": "pr", "source_min_rank": "mn", "source_rank_gap": "gap", "source_event_rank": "fe", "source_context_rank": "fx", "source_metadata_rank": "fm"}
    long = " union all ".join(f"select q, a, {i} f, coalesce({c}, 0)::double v from y" for i, c in enumerate(columns.values()))
    source = "case f " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(columns)) + " end"
    parts = [f"""{POOL}, c as (select count(*) filter (rel) yes, count(*) filter (not rel) no from pool),
      y as (select q, a, pr, mn, fe, fx, fm, gap,
        case when rel then (yes + no) / (2.0::double * yes) else (yes + no) / (2.0::double * no) end w, rel::bigint r from pool, c),
      u as materialized (select q, a, round(w * (r - 0.5::double) * 16777216)::bigint g, round(w * 0.25::double * 16777216)::bigint h from y),
      l as materialized ({long}),
      o as (select f, v, row_number() over (partition by f order by v) k, count(*) over (partition by f) n from l),
      e as materialized (select distinct f, v from o where k in (select ceil(i * n / {bins}) from range(1, {bins}) t(i))),
      d as (select f, v from l group by f, v),
      b as materialized (select d.f, d.v, count(e.v) bin from d left join e on e.f = d.f and e.v < d.v group by d.f, d.v),
      x as materialized (select l.q, l.a, l.f, b.bin, u.g, u.h from l join b on b.f = l.f and b.v = l.v join u on u.q = l.q and u.a = l.a),
      n0 as materialized (select q, a, '' node from u)"""]
    one = "16777216.0::double"

    def score(g: str, h: str) -> str:
        return f"(({g}) / {one}) * (({g}) / {one}) / (({h}) / {one})"

    for s in range(leaves - 1):
        parts.append(f"""t{s} as (select n.node, f, bin, sum(g)::bigint g, sum(h)::bigint h, count(*) n from x join n{s} n on n.q = x.q and n.a = x.a group by n.node, f, bin),
      a{s} as (select node, f, bin, sum(g) over w gl, sum(h) over w hl, sum(n) over w nl, sum(g) over p g, sum(h) over p h, sum(n) over p n from t{s}
        window w as (partition by node, f order by bin), p as (partition by node, f)),
      s{s} as materialized (select node, f, bin, {score('gl', 'hl')} + {score('g - gl', 'h - hl')} - {score('g', 'h')} gain from a{s}
        where nl >= {min_child} and n - nl >= {min_child} and hl >= 0.001 * {one} and h - hl >= 0.001 * {one}
        order by gain desc, f, bin limit 1),
      n{s + 1} as materialized (select n.q, n.a, case when n.node <> s.node then n.node when x.bin <= s.bin then n.node || 'L' else n.node || 'R' end node
        from n{s} n cross join s{s} s join x on x.q = n.q and x.a = n.a and x.f = s.f)""")
    splits = " union all ".join(f"select node, f, bin, gain from s{s}" for s in range(leaves - 1))
    return f"""with {', '.join(parts)}, splits as ({splits}),
      ends as (select *, row_number() over (partition by f order by v) - 1 bin from e)
      select node, {source} feature, v threshold, round(gain, 3) gain, null::double as value from splits join ends using (f, bin)
      union all select node, null, null, null, round(sum(g)::double / sum(h)::double, 5) from u join n{leaves - 1} using (q, a) group by node"""


def feature(name: str) -> str:
    return DERIVED.get(name, f"cast({name} as double)")


MODELS = {
    "context_prior": DERIVED["score_context_rank_prior"],
    "mixed_prior": f"({DERIVED['score_event_rank_prior']}) * 0.75::double + cast(graph_mean as double) * 0.25::double",
}


def terms(model: str) -> str:
    return f"""select q, a, rel, split, {z('coalesce(score_final, 0)')} z_base, {z(MODELS[model])} z_model,
  {z('cast(graph_max_z as double)')} z_graph, {z('coalesce(score_calibrated, 0)')} z_calibrated,
  {z(DERIVED['source_min_rank_inv_safe'])} z_source from graph2"""


def weighted(b) -> str:
    if b.name == MODEL_ONLY:
        return "z_model"
    pairs = (("z_base", b.base), ("z_model", b.model), ("z_graph", b.graph), ("z_calibrated", b.calibrated), ("z_source", b.source))
    return " + ".join(f"cast({w!r} as float) * {c}" for c, w in pairs)


FROZEN = next(b for b in profile_grid() if b.name == "blend_f0.10_m0.45_g0.30_c0.15_s0.00")
FROZEN_TEXT = "cast(0.1 as float) * z_base + cast(0.45 as float) * z_model + cast(0.3 as float) * z_graph + cast(0.15 as float) * z_calibrated + cast(0.0 as float) * z_source"
SCORED = f"{FEATURES}, terms as ({terms('context_prior')}), scored as (select *, {FROZEN_TEXT} score from terms)"
PROPOSAL = f"""{SCORED}, proposal as (select q, a, score, pr from (
  select q, a, score, row_number() over (partition by q order by score desc, a) pr from scored) where pr <= 20)"""
ANCHORS = "anchors as (select q, a, rk ar from k_context where rk <= 20)"


def merged(keep: int, tail: int, source: str = "proposal") -> str:
    """Segment numbers by the definition of the merge, then one order."""
    front = max(tail - 1, keep)
    anchor_segment = f"when ar is not null then 2" if tail <= 20 else ""
    return f"""offered as (select coalesce(p.q, n.q) q, coalesce(p.a, n.a) a, p.pr, n.ar
    from {source} p full join anchors n on n.q = p.q and n.a = p.a),
  heads as (select *, coalesce(ar <= {keep}, false) head from offered),
  counted as (select *, sum(head::int) over (partition by q) nh,
    row_number() over (partition by q, head order by pr nulls last, a) am from heads),
  segmented as (select *, case when head then 0 when pr is not null and am + nh <= {front} then 1 {anchor_segment}
    when pr is not null then 3 end seg from counted),
  placed as (select *, row_number() over (partition by q order by seg, case when seg in (0, 2) then ar else pr end, a) rk
    from segmented where seg is not null),
  merged as (select q, a, rk, case when rk <= {keep} and ar is not null then 'retained_head'
    when rk >= {tail} and ar is not null then 'retained_tail' else 'proposal' end src from placed where rk <= 20)"""


def per_query_metrics(lists: str, keys: str) -> str:
    """Metric rows from a list relation with (keys, q, a, rk)."""
    return f"""relevant as (select distinct q, a from pool where rel),
  sizes as (select q, count(*) n from relevant group by q),
  hits as (select l.*, s.n, r.a is not null hit from {lists} l join sizes s on s.q = l.q left join relevant r on r.q = l.q and r.a = l.a),
  cum as (select *, sum(hit::int) over (partition by {keys} order by rk) ch from hits),
  per_query as (select {keys}, max(n) n,
    count(distinct case when hit and rk <= 10 then a end) / max(n) recall_at_10,
    count(distinct case when hit and rk <= 20 then a end) / max(n) recall_at_20,
    coalesce(sum(case when hit and rk <= 10 then 1 / log2(rk + 1) end), 0)
      / list_sum(list_transform(range(1, cast(least(10, max(n)) as bigint) + 1), lambda r: 1 / log2(r + 1))) ndcg_at_10,
    coalesce(sum(case when hit and rk <= 10 then ch / rk end), 0) / least(10, max(n)) map_at_10,
    count(distinct case when hit and rk <= 10 then a end) h10, count(distinct case when hit and rk <= 20 then a end) h20
    from cum group by {keys})"""


COMPOSITE = "0.3::double * ndcg_at_10 + 0.3::double * map_at_10 + 0.25::double * recall_at_20 + 0.1::double * recall_at_10"


def rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) {n}" for n in names)


def signless(value: str, digits: int) -> str:
    """Rounded value whose zero carries no sign."""
    return f"case when round({value}, {digits}) = 0 then 0.0::double else round({value}, {digits}) end"


def steady(value: str, digits: int = 5) -> str:
    """Rounded away from exact halves, which averages of two-decimal values often hit."""
    return f"round({value} + 1e-9::double, {digits})"


def ledger() -> str:
    pieces = []
    for model in MODELS:
        for b in profile_grid():
            pieces.append(
                f"select q, a, '{model}' mname, '{b.name}' bname, {weighted(b)} score from t_{model} where split = 'validation'"
            )
    term_ctes = ", ".join(f"t_{m} as ({terms(m)})" for m in MODELS)
    return f"""with {FEATURES}, {term_ctes}, {ANCHORS},
  flat as ({' union all '.join(pieces)}),
  offers as (select q, a, mname, bname, pr from (select *, row_number() over (partition by q, mname, bname order by score desc, a) pr from flat) where pr <= 20),
  lists as (select distinct q, mname, bname, keep from offers, (values (0), (1), (3), (5)) k(keep)),
  kept as (select o.*, keep from offers o, (values (0), (1), (3), (5)) k(keep)),
  front as (select l.q, l.mname, l.bname, l.keep, n.a, n.ar from lists l join anchors n on n.q = l.q where n.ar <= l.keep),
  rest as (select k.q, k.mname, k.bname, k.keep, k.a, k.pr from kept k
    where not exists (select 1 from front f where f.q = k.q and f.mname = k.mname and f.bname = k.bname and f.keep = k.keep and f.a = k.a)),
  full_lists as (select q, mname, bname, keep, a, row_number() over (partition by q, mname, bname, keep order by seg, pos, a) rk from (
    select q, mname, bname, keep, a, 0 seg, ar pos from front union all select q, mname, bname, keep, a, 1 seg, pr pos from rest)),
  cut as (select * from full_lists where rk <= 20),
  {per_query_metrics('cut', 'q, mname, bname, keep')},
  ledger as (select mname || '|' || bname || '|anchor_keep' || keep profile, keep keep_top,
    avg(recall_at_10) recall_at_10, avg(recall_at_20) recall_at_20, avg(ndcg_at_10) ndcg_at_10, avg(map_at_10) map_at_10,
    count(*) query_count from per_query group by mname, bname, keep),
  table_ as (select *, {COMPOSITE} composite from ledger)"""


EVENTS = """ev as (select event_id, user_id, event_type tp, value, epoch_us(ts) / 1e6 s,
  epoch_us(ts) / 1e6 + (6 + event_id % 42) * 3600 e, cast(round(value * -100) as bigint) rnk from events)"""


def suppression(source: str, group: str, threshold: float, delta: float | None) -> str:
    """Greedy suppression as recursion over rank positions that carries the kept windows."""
    shared = "greatest(0, least(k.e, o.e) - greatest(k.s, o.s)) / 3600"
    shorter = "least(k.e - k.s, o.e - o.s) / 3600"
    ov = f"{shared} / ({shorter}) >= {threshold}"
    st = "false" if delta is None else f"abs(k.s - o.s) / 3600 <= {delta}"
    hit = f"list_filter(kept, lambda k: ({ov}) or ({st}))"
    return f"""o as (select {group} g, cid, s, e, row_number() over (partition by {group} order by rnk, cast(cid as varchar)) pos from {source}),
  walk as (
    select g, cid, pos, [{{'s': s, 'e': e}}] kept, true keep, false ov, false st from o where pos = 1
    union all
    select g, cid, pos, case when c is null then list_append(kept, {{'s': s, 'e': e}}) else kept end, c is null,
      coalesce(({ov.replace('k.', 'c.').replace('o.', '')}), false), coalesce(({st.replace('k.', 'c.').replace('o.', '')}), false)
    from (select o.g, o.cid, o.pos, o.s, o.e, w.kept, {hit.replace('(kept,', '(w.kept,')}[1] c from walk w join o on o.g = w.g and o.pos = w.pos + 1))"""


FLAGS = "keep::int kept, (not keep and ov)::int overlap_suppressed, (not keep and st)::int start_proximity_suppressed"
POOL_WINDOWS = "pw as (select pool.q, pool.a cid, pool.pr rnk, w.tp, w.s, w.e from pool join wins w on w.id = pool.a)"
TRACK = """tr as (select cast(user_id as varchar) || '-' || event_type ev, cast(user_id as varchar) tc, ts t,
  10 + value % 30 lat, cast(100 + event_id % 50 as double) lon, 900 + value % 100 pres, value % 70 wnd from events)"""


def haversine(a: str, b: str, c: str, d: str) -> str:
    half = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371.0088::double * atan2(sqrt({half}), sqrt(greatest(0, 1 - {half}))))"


COAST = "coast as (select * from (values " + ", ".join(f"({i}, {a}::double, {b}::double)" for i, (a, b) in enumerate(COAST_ANCHORS)) + ") c(i, clat, clon))"
RESAMPLE = """num as (select *, row_number() over (partition by ev order by t) - 1 i, count(*) over (partition by ev) m from tr),
  grid as (select distinct n.ev, n.m, j, cast(floor(j * (n.m - 1) / 15.0::double + 1e-12) as bigint) lo, j * (n.m - 1) / 15.0::double x from num n, range(16) g(j)),
  smp as (select g.ev, g.j, {cols} from grid g join num a on a.ev = g.ev and a.i = g.lo join num b on b.ev = g.ev and b.i = least(g.lo + 1, g.m - 1))""".format(
    cols=", ".join(f"a.{v} + (g.x - g.lo) * (b.{v} - a.{v}) {v}" for v in ("lat", "lon", "pres", "wnd"))
)
LANDFALL = f"""near as (select ev, t, lat, lon, min({haversine('lat', 'lon', 'clat', 'clon')}) km from tr, coast group by ev, t, lat, lon),
  land as (select ev, lat llat, lon llon, km, date_diff('microsecond', first, t) / 3.6e9 off from (
    select *, row_number() over (partition by ev order by km, t) r, min(t) over (partition by ev) first from near) where r = 1)"""
SUMMARY = ("lat_mean", "lat_span", "lon_mean", "lon_span", "point_count", "pres_min", "pres_mean", "wnd_max", "wnd_mean")
G20 = f"""sums as (select ev, tc, avg(lat) lat_mean, max(lat) - min(lat) lat_span, avg(lon) lon_mean, max(lon) - min(lon) lon_span,
    cast(count(*) as double) point_count, min(pres) pres_min, avg(pres) pres_mean, max(wnd) wnd_max, avg(wnd) wnd_mean from tr group by ev, tc),
  std as (select ev, tc, {', '.join(f'({c} - avg({c}) over ()) / stddev_pop({c}) over () {c}' for c in SUMMARY)} from sums),
  g20 as (select q, c, d, rk from (select q.ev q, c.ev c, {' + '.join(f'pow(c.{c} - q.{c}, 2)' for c in SUMMARY)} d,
    row_number() over (partition by q.ev order by {' + '.join(f'pow(c.{c} - q.{c}, 2)' for c in SUMMARY)}, c.ev) rk
    from std q join std c on c.tc <> q.tc) where rk <= 20)"""
ERRORS = f"""{TRACK}, {COAST}, {RESAMPLE}, {LANDFALL}, {G20},
  gaps as (select g.q, g.c, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} km, abs(a.pres - b.pres) dp, abs(a.wnd - b.wnd) dw
    from g20 g join smp a on a.ev = g.q join smp b on b.ev = g.c and b.j = a.j where g.rk = 1),
  errs as (select e.*, {haversine('x.llat', 'x.llon', 'y.llat', 'y.llon')} landfall_dist_km, abs(x.off - y.off) landfall_time_err_h
    from (select q, c, sqrt(avg(km * km)) track_rmse_km, avg(dp) pressure_mae, avg(dw) wind_mae from gaps group by q, c) e
    join land x on x.ev = e.q join land y on y.ev = e.c)"""
ERROR_NAMES = ("track_rmse_km", "pressure_mae", "wind_mae", "landfall_dist_km", "landfall_time_err_h")
PAIRED = """paired as (select user_id, avg(value) baseline, coalesce(avg(case when event_type = 'view' then value end), 0) proposed,
  user_id % 3 fold from events group by user_id)"""


def dcg(source: str, keys: str, score: str, rel: str, name: str, position: str = "event_id") -> str:
    def part(order: str) -> str:
        return f"""(select {keys}, sum((pow(2, {rel}) - 1) / log2(r + 1)) v from (
      select *, row_number() over (partition by {keys} order by {order} desc, {position}) r from {source}) where r <= 10 group by {keys})"""

    first = keys.split(", ")
    on = " and ".join(f"x.{k} = y.{k}" for k in first)
    return f"""{name} as (select {', '.join('x.' + k for k in first)}, case when y.v > 0 then x.v / y.v else 0 end ndcg
      from {part(score)} x join {part(rel)} y on {on})"""


def merge_query(keep: int, tail: int = 21) -> str:
    return f"with {PROPOSAL}, {ANCHORS}, {merged(keep, tail)} select q query_id, a candidate_id, rk rank, src anchor_source from merged"


def oracle_queries() -> dict[str, str]:
    out: dict[str, str] = {}
    out["knn_topk_shuffled"] = f"with {VECS}, {knn('k', 1, 64, 20)} select q query_id, a candidate_id, rk rank, round(d, 6) distance from k"
    out["knn_ivf"] = f"""with {VECS}, pivots as (select id, v, row_number() over (order by md5(id), id) - 1 c from vecs qualify c < 16),
      near as (select x.id, c, row_number() over (partition by x.id order by {l2('x.v', 'p.v')}, c) n from vecs x cross join pivots p),
      home as (select id, c from near where n = 1), filled as (select distinct c from home),
      visit as (select id, c from (select id, near.c, row_number() over (partition by id order by n) m from near join filled on near.c = filled.c) where m <= 6),
      k as (select q.id q, a.id a, {l2('q.v', 'a.v')} d, row_number() over (partition by q.id order by {l2('q.v', 'a.v')}, a.id) rk
        from visit t join home h on h.c = t.c join vecs q on q.id = t.id join vecs a on a.id = h.id where q.id <> a.id and q.g <> a.g)
      select q query_id, a candidate_id, rk rank, round(d, 6) distance from k where rk <= 20"""
    out["knn_topk_excl_group"] = f"with {VECS}, {knn('k', 1, 64, 20)} select q query_id, a candidate_id, rk rank, round(d, 6) distance from k"
    out["knn_distance_profile"] = f"""with {VECS}, {CONTEXT} select q query_id, round(min(d), 6) min_distance, round(avg(d), 6) avg_distance,
      round(max(d), 6) max_distance, count(*) neighbours from k_context group by q"""
    norm = "sqrt(list_sum(list_transform({v}, lambda x: cast(x as double) * cast(x as double))))"
    out["vector_block_norms"] = f"""select vec_id, b block, round({norm.format(v='embedding[1 + 16 * b : 16 + 16 * b]')}, 6) block_norm,
      round({norm.format(v='embedding')}, 6) vector_norm from embeddings, range(4) r(b)"""
    out["vector_mean_pool_by_group"] = f"""with x as (select cast(label as varchar) g, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 p from embeddings),
      m as (select g, p, count(*) n, cast(avg(cast(v as double)) as float) v from x group by g, p),
      s as (select *, sqrt(sum(cast(v as double) * cast(v as double)) over (partition by g)) nrm from m)
      select g group_id, n pooled_rows, cast(p as bigint) position, {signless("cast(cast(cast(v as double) / nrm as float) as double)", 6)} "value" from s"""
    out["vector_contract_check"] = """select count(*) row_count, count(case when len(embedding) <> 64 then 1 end) wrong_dimension,
      count(case when len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0 then 1 end) non_finite_rows, 0::bigint missing_times,
      0::bigint non_positive_windows, count(case when vec_id <= before then 1 end) order_breaks,
      cast(epoch(timestamp '2024-01-01') + min(vec_id) * 3600 as bigint) first_start,
      cast(epoch(timestamp '2024-01-01') + max(vec_id) * 3600 + 86400 as bigint) last_end
      from (select *, lag(vec_id) over (order by vec_id) before from embeddings)"""
    hours = "date_diff('hour', (select min(date_trunc('hour', ts)) from events), date_trunc('hour', ts))"
    for name, n in (("cadence_view_6h", 6), ("cadence_view_24h", 24)):
        out[name] = f"select event_id, h // {n} slot from (select event_id, {hours} h from events) where h % {n} = 0"
    arch = "arch as (select vec_id, timestamp '2024-01-01' + to_hours(vec_id) t, embedding from embeddings)"
    inside = "a.t >= e.ts and a.t < e.ts + to_hours(6 + e.event_id % 42)"
    out["event_interval_join"] = f"""with {arch} select event_id, count(*) rows_covered, min(vec_id) first_row, max(vec_id) last_row
      from events e join arch a on {inside} group by event_id"""
    out["event_vectors_pooled"] = f"""with {arch}, cov as (select e.event_id, a.embedding from events e join arch a on {inside}),
      x as (select event_id, unnest(embedding) v, generate_subscripts(embedding, 1) p from cov),
      m as (select event_id, p, count(*) n, cast(avg(cast(v as double)) as float) v from x group by event_id, p),
      s as (select *, sqrt(sum(cast(v as double) * cast(v as double)) over (partition by event_id)) nrm from m),
      u as (select event_id, p, n, cast(cast(cast(v as double) / nrm as float) as double) v from s)
      select event_id, coalesce(max(n), 0) pooled_rows, {signless('max(case when p = 1 then v end)', 5)} v0, {signless('max(case when p = 32 then v end)', 5)} v31,
      {signless('max(case when p = 64 then v end)', 5)} v63, round(sqrt(sum(v * v)), 5) norm,
      {signless('sum(v * p)', 3)} weighted_sum from (select event_id from events) left join u using (event_id) group by event_id"""
    out["temporal_overlap_pairs"] = f"""with {POOL}, {WINDOWS},
      pairs as (select p.q, p.a, greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / 3600 i, (x.e - x.s) / 3600 dx, (y.e - y.s) / 3600 dy
        from pool p join wins x on x.id = p.q join wins y on y.id = p.a)
      select q query_id, a candidate_id, round(i, 6) intersection_hours, round(i / least(dx, dy), 6) overlap_ratio_min,
      round(i / greatest(dx + dy - i, 1e-12), 6) overlap_ratio_union from pairs"""
    pool_walk = f"with recursive {POOL}, {WINDOWS}, {POOL_WINDOWS}, {suppression('pw', 'q || chr(1) || tp', 0.5, 12)}"
    out["early_temporal_nms_pool"] = f"{pool_walk} select split_part(g, chr(1), 1) query_id, cid candidate_id, {FLAGS} from walk"
    out["diversity_summary"] = f"""{pool_walk}, pq as (select split_part(g, chr(1), 1) q, count(*) n, count(case when keep then 1 end) k from walk group by 1)
      select count(*) queries, round(avg((n - k) / n), 6) early_nms_reduction, round(avg(case when k > 0 then 1.0 else 0.0 end), 6) unique_event_ratio from pq"""
    ev = EVENTS.replace("event_id, user_id", "event_id cid, event_id, user_id")
    by_user = "cast(user_id as varchar) || chr(1) || tp"
    user_walk = f"with recursive {ev}, {suppression('ev', by_user, 0.5, 12)}"
    out["early_temporal_nms_events"] = f"{user_walk} select cid event_id, {FLAGS} from walk"
    out["early_temporal_nms_overlap_only"] = f"with recursive {ev}, {suppression('ev', by_user, 0.75, None)} select cid event_id, {FLAGS} from walk"
    out["early_temporal_nms_scope"] = f"with recursive {ev}, {suppression('ev', 'tp', 0.5, 12)} select cid event_id, {FLAGS} from walk"
    out["nms_suppression_reasons"] = f"""{user_walk} select cast(split_part(g, chr(1), 1) as bigint) user_id, count(*) pre_count,
      count(case when keep then 1 end) post_count, count(case when not keep and ov then 1 end) overlap_suppressed,
      count(case when not keep and st then 1 end) start_proximity_suppressed,
      round((count(*) - count(case when keep then 1 end)) / count(*), 6) reduction_ratio,
      round(count(distinct case when keep then split_part(g, chr(1), 2) end) / count(case when keep then 1 end), 6) unique_event_ratio
      from walk group by 1"""
    firsts = f"""{EVENTS}, f as (select *, row_number() over (partition by user_id, tp order by rnk, event_id) c from ev),
      d as (select *, case when c = 1 then row_number() over (partition by user_id, c order by rnk, event_id) end k from f)"""
    out["event_dedup_topk"] = f"with {firsts} select user_id, event_id, k dedup_rank from d where k <= 3"
    out["event_dedup_removed"] = f"""with {firsts}, last as (select user_id, max(case when k = 3 then rnk end) lr, max(case when k = 3 then event_id end) le from d group by user_id)
      select d.user_id, d.event_id from d join last l on l.user_id = d.user_id where d.c > 1 and (l.lr is null or (d.rnk, d.event_id) < (l.lr, l.le))"""
    out["unique_event_ratio"] = "select user_id, round(count(distinct event_type) / count(*), 6) unique_event_ratio from events group by user_id"
    out["fuse_channels"] = f"""with {POOL} select q query_id, a candidate_id, pr pool_rank, mn source_min_rank, cast(gap as bigint) source_rank_gap,
      fe source_event_rank, fx source_context_rank, fm source_metadata_rank, 61::bigint source_sequence_rank,
      concat_ws('+', case when re is not null then 'event' end, case when rc is not null then 'context' end, case when rm is not null then 'metadata' end) membership,
      round(dc, 6) context_distance, case when re is not null then 'event_channel' end event_provenance from pool"""
    out["fuse_channels_rankless"] = """with e as (select cast(user_id as varchar) q, cast(event_id % 20 as varchar) a, event_id % 3 ch, event_id, value,
        row_number() over (partition by user_id, event_id % 3 order by event_id) o from events),
      r as (select *, case when event_id % 5 <> 0 then o + event_id % 4 else o end rk from e),
      f as (select q, a, ch, arg_min(rk, o) rk, arg_min(value, o) d from r group by 1, 2, 3),
      p as (select q, a, max(case when ch = 0 then rk end) r0, max(case when ch = 1 then rk end) r1, max(case when ch = 2 then rk end) r2,
        max(case when ch = 0 then d end) d0, max(case when ch = 1 then d end) d1, max(case when ch = 2 then d end) d2 from f group by 1, 2),
      m as (select *, least(coalesce(r0, r1, r2), coalesce(r1, r0, r2), coalesce(r2, r0, r1)) mn,
        greatest(coalesce(r0, 16), coalesce(r1, 16), coalesce(r2, 16)) mx from p),
      o as (select *, row_number() over (partition by q order by mn, case when r0 is not null then 0 when r1 is not null then 1 else 2 end,
        coalesce(r0, 16), coalesce(r1, 16), coalesce(r2, 16), a) pr from m)
      select q query_id, a candidate_id, pr pool_rank, mn source_min_rank, mx - mn source_rank_gap,
      concat_ws('+', case when r0 is not null then 'event' end, case when r1 is not null then 'context' end, case when r2 is not null then 'metadata' end) membership,
      concat_ws('|', coalesce(r0::varchar, '-'), coalesce(r1::varchar, '-'), coalesce(r2::varchar, '-')) ranks,
      concat_ws('|', coalesce(floor(d0 * 100)::bigint::varchar, '-'), coalesce(floor(d1 * 100)::bigint::varchar, '-'), coalesce(floor(d2 * 100)::bigint::varchar, '-')) distances,
      concat_ws('|', case when r0 is null then '-' else 'event_candidate_path' end, case when r1 is null then '-' else 'context_candidate_path' end,
        case when r2 is null then '-' else 'metadata_candidate_path' end) provenance from o where pr <= 15"""
    priors = ("rank_inv", "source_event_rank_inv", "source_sequence_rank_inv", "source_min_rank_inv", "score_event_rank_prior", "score_pool_rank_prior", "score_context_rank_prior")
    out["fusion_priors"] = f"""with {POOL} select q query_id, a candidate_id, {', '.join(f'round({DERIVED[c]}, 6) {c}' for c in priors)},
      (rc is not null)::int context_candidate, coalesce(rc, 0) context_rank from pool"""
    out["exclusion_audit"] = f"""with {VECS}, k as (select * from (select q.id q, a.id a, q.g qg, a.g ag, row_number() over (partition by q.id order by {l2('q.v', 'a.v')}, a.id) rk
      from vecs q, vecs a) where rk <= 20)
      select q query_id, count(case when q = a or qg = ag then 1 end) excluded, count(case when q <> a and qg <> ag then 1 end) eligible,
      cast(sum(case when q = a or qg = ag then cast(a as bigint) end) as bigint) excluded_id_sum from k group by q"""
    out["metadata_enrichment"] = f"""with {VECS}, {EVENT}, {WINDOWS} select k.q query_id, k.a candidate_id, case when k.rk <= 5 then 'own' else v.g end group_id,
      w.tp event_type from k_event k join vecs v on v.id = k.a join wins w on w.id = k.a"""
    out["rank_reciprocals"] = """with x as (select event_id, try_cast(case when event_id % 7 = 0 then 'n/a' when event_id % 11 = 0 then '-3'
        else json_extract_string(props, '$.k') end as double) v from events)
      select event_id, round(v, 6) source_min_rank, round(1 / (greatest(coalesce(v, 1501), 0) + 1), 6) source_min_rank_inv,
      round(1 / (1 + coalesce(v, 9999)), 6) source_min_rank_inv_safe from x"""
    out["score_sum_diff"] = f"""with {POOL} select q query_id, a candidate_id, {signless(DERIVED['score_final_minus_calibrated'], 6)} score_diff,
      round({DERIVED['score_final_plus_calibrated']}, 6) score_sum from pool"""
    out["query_zscore"] = f"select event_id, {signless(f"cast({z('value', 'user_id')} as double)", 4)} value_z, 0.0::double flat_z from events"
    medians = " union all ".join(
        f"""select '{c}' feature, {signless('m', 5)} median, count(case when v is null then 1 end) filled,
        {signless('avg(cast(cast(coalesce(v, m) as float) as double))', 5)} mean_input from (
        select {feature(c)} v, (select coalesce(median({feature(c)}), 0) from graph2 where split = 'train') m from graph2) group by m"""
        for c in FEATURE_NAMES
    )
    out["train_median_fill"] = f"with {FEATURES} {medians}"
    out["feature_table"] = f"with {FEATURES} select q query_id, a candidate_id, {', '.join(f'{signless(feature(c), 4)} {c}' for c in FEATURE_NAMES)} from graph2"
    out["candidate_group_sizes"] = f"with {POOL} select q query_id, count(*) group_size, count(case when rel then 1 end) positives from pool group by q"
    out["graded_labels"] = f"""with {POOL} select q query_id, a candidate_id, rel::bigint binary_label,
      case when rel then greatest(cast(least(greatest(grade, 0), 10) as bigint), 1) else 0 end graded_label from pool"""
    for name, gain in (
        ("lambdarank_gradients", "case when rel then 1.0 else 0.0 end"),
        ("lambdarank_gradients_graded", "case when rel then cast(greatest(cast(least(greatest(grade, 0), 10) as bigint), 1) as double) else 0.0 end"),
    ):
        out[name] = f"""with {POOL}, x as (select q, a, {gain} g, 1 / (1 + pr) s from pool),
          p as materialized (select *, row_number() over (partition by q order by s desc, a) - 1 p, row_number() over (partition by q order by g desc) r from x),
          i as (select q, sum(case when r <= 30 then g / log2(r + 1) end) best from p group by q having best > 0),
          d as (select h.q, h.a ha, l.a la, h.s - l.s lead, (h.g - l.g) * abs(1 / log2(h.p + 2) - 1 / log2(l.p + 2)) / best / (0.01 + abs(h.s - l.s)) swing
            from p h join p l on h.q = l.q and h.g > l.g and (h.p < 30 or l.p < 30) join i on i.q = h.q),
          f as materialized (select *, 1 / (1 + exp(least(greatest(lead, -50), 50))) doubt from d),
          e as (select q, ha a, swing * doubt step, swing * doubt * (1 - doubt) curve from f
            union all select q, la, -swing * doubt, swing * doubt * (1 - doubt) from f),
          t as (select q, a, sum(step) step, sum(curve) curve from e group by q, a),
          z as (select q, sum(abs(step)) total from t group by q)
          select p.q query_id, p.a candidate_id, {signless('coalesce(t.step * log2(1 + total) / total, 0)', 5)} step,
          {signless('coalesce(t.curve * log2(1 + total) / total, 0)', 5)} curve from p left join t on t.q = p.q and t.a = p.a left join z on z.q = p.q"""
    out["classifier_first_step"] = f"""with {POOL}, c as (select count(*) filter (rel) yes, count(*) filter (not rel) no from pool),
      w as (select split, rel::bigint label, case when rel then (yes + no) / (2.0::double * yes) else (yes + no) / (2.0::double * no) end weight from pool, c)
      select split, label, round(max(weight), 6) weight, {signless('sum(weight * (label - 0.5::double))', 4)} step,
      round(sum(weight * 0.25::double), 4) curve, count(*) n from w group by split, label"""
    out["leafwise_first_tree"] = growth(16, 40, 511)
    out["label_graph_edges"] = f"with {POOL}, {EDGES} select tq train_query, c candidate_id, round(max(w), 6) weight, round(sum(w), 6) seed_weight from edges group by tq, c"
    out["label_graph_counts"] = f"""with {POOL}, {EDGES} select count(distinct c) train_positive_seed_count, count(distinct tq) train_positive_query_count from edges"""
    out["label_graph_scores"] = f"""with {FEATURES} select q query_id, a candidate_id,
      {', '.join(f'round(cast({n} as double), 5) {n}' for n in (*NAMES, 'graph_max', 'graph_mean'))} from graph2"""
    out["blend_top20"] = f"with {PROPOSAL} select q query_id, a candidate_id, pr rank, {signless('cast(score as double)', 4)} score from proposal"
    for keep in (0, 1, 3, 5):
        out[f"anchor_merge_keep{keep}"] = merge_query(keep)
    out["anchor_merge_tail11"] = merge_query(3, 11)
    online = f"""with {SCORED}, proposal as (select q, a, score, row_number() over (partition by q order by score desc, a) pr from scored),
      anchors as (select k.q, k.a, k.rk ar from k_context k join pool p on p.q = k.q and p.a = k.a where k.rk <= 5), {merged(5, 21)}"""
    out["online_top20"] = f"""{online} select m.q query_id, m.a candidate_id, m.rk rank, {signless('cast(s.score as double)', 4)} score, m.src anchor_source,
      0 uses_test_for_tuning, '{SELECTED_PROFILE}' selected_profile from merged m join scored s on s.q = m.q and s.a = m.a"""
    metric_base = f"with {PROPOSAL}, {ANCHORS}, {merged(5, 21)}, {per_query_metrics('merged', 'q')}"
    out["ranking_metrics"] = f"{metric_base} select q query_id, {rounded(METRICS)} from per_query"
    out["ranking_metrics_fixed_denominator"] = f"{metric_base} select q query_id, round(h10 / 20, 6) recall_at_10, round(h20 / 20, 6) recall_at_20 from per_query"
    out["macro_ranking_metrics"] = f"""{metric_base}, m as (select {', '.join(f'avg({x}) {x}' for x in METRICS)}, count(*) query_count from per_query)
      select {rounded(METRICS)}, round({COMPOSITE}, 6) composite, query_count from m"""
    scores = "src as (select user_id, event_type seed, event_id, cast(event_id * 37 % 101 as double) control, value % 7 system, value % 5 rel5, value % 3 rel3 from events)"
    out["continuous_ndcg"] = f"with {scores}, {dcg('src', 'user_id', 'control', 'rel5', 'n')} select user_id, round(ndcg, 6) ndcg from n"
    arms = []
    for arm, keep in (("backend", "re is not null"), ("full", "true")):
        arms.append(f"""{arm} as (select q, coalesce(sum(case when hit and rk <= 10 then 1 / log2(rk + 1) end), 0)
          / list_sum(list_transform(range(1, 11), lambda r: 1 / log2(r + 1))) ndcg, count(case when hit then 1 end) rel20 from (
          select p.q, p.a, t.a is not null hit, row_number() over (partition by p.q order by {DERIVED['score_context_rank_prior']} + {DERIVED['rank_inv']} desc, p.a) rk
          from pool p left join k_truth t on t.q = p.q and t.a = p.a where {keep}) where rk <= 20 group by q)""")
    out["matched_scoring_pair"] = f"""with {POOL}, {', '.join(arms)} select b.q query_id, round(b.ndcg, 6) backend_ndcg, round(f.ndcg, 6) full_ndcg,
      b.rel20 backend_relevant, f.rel20 full_relevant from backend b join full_ f on f.q = b.q""".replace("full as (select q, coalesce", "full_ as (select q, coalesce")
    out["matched_pool_contract"] = f"""with {POOL}, short as (select q, a from k_event where rk <= 20),
      x as (select 'backend_outside_full' "check" from short s where not exists (select 1 from pool p where p.q = s.q and p.a = s.a)
        union all select 'full_not_in_backend' from pool p where not exists (select 1 from short s where p.q = s.q and p.a = s.a))
      select "check", count(*) "rows" from x group by 1"""
    base = ledger()
    out["profile_grid_ledger"] = f"{base} select profile, cast(keep_top as bigint) keep_top, {rounded((*METRICS, 'composite'))}, query_count from table_"

    def choose(rule: str, floors: tuple[float, float, float, float]) -> str:
        ok = f"(ndcg_at_10 >= {floors[0]} and map_at_10 >= {floors[1]} and recall_at_10 >= {floors[2]} and recall_at_20 >= {floors[3]})"
        return f"""(select '{rule}' rule, {ok}::int passes_floors, round(recall_at_20, 6) recall_at_20, round(composite, 6) composite, round(map_at_10, 6) map_at_10
          from table_ where keep_top >= 1 order by {ok}::int desc, recall_at_20 desc, composite desc, map_at_10 desc limit 1)"""

    out["profile_selection"] = f"{base} {choose('published_floors', (0.86, 0.80, 0.41, 0.735))} union all {choose('relaxed_floors', (0.1, 0.02, 0.05, 0.05))}"
    out["promotion_gates"] = f"""{base} select profile,
      (ndcg_at_10 >= 0.8695522108335824 and map_at_10 >= 0.8023448773448774 and recall_at_10 >= 0.4227272727272727 and recall_at_20 >= 0.6218181818181817 and false)::int strict_promotion_pass,
      (ndcg_at_10 >= 0.82 and map_at_10 >= 0.72 and recall_at_10 >= 0.40 and recall_at_20 >= 0.64)::int hard_target_pass,
      (ndcg_at_10 >= 0.08 and map_at_10 >= 0.08 and recall_at_10 >= 0.08 and recall_at_20 >= 0.08)::int reachable_pass from table_"""
    out["haversine_pairs"] = f"""with {COAST} select event_id, cast(i as bigint) anchor, round({haversine('(10 + value % 30)', 'cast(100 + event_id % 50 as double)', 'clat', 'clon')}, 5) km from events, coast"""
    out["track_resample_16"] = f"with {TRACK}, {RESAMPLE} select ev event_id, j sample, {', '.join(f'{steady(v)} {v}' for v in ('lat', 'lon', 'pres', 'wnd'))} from smp"
    out["landfall_argmin"] = f"""with {TRACK}, {COAST}, {LANDFALL} select ev event_id, {steady('llat')} landfall_lat, {steady('llon')} landfall_lon,
      {steady('km')} landfall_coast_km, {steady('off')} landfall_offset_h from land"""
    out["event_track_windows"] = f"""with {TRACK}, w as (select ev, tc, min(t) - case when ev like '%-purchase' then interval 1000 days else interval 0 days end a,
        max(t) - case when ev like '%-purchase' then interval 1000 days else interval 0 days end b from tr group by ev, tc),
      j as (select w.ev, p.lat, p.pres, p.t between w.a and w.b hit from w join tr p on p.tc = w.tc),
      k as (select *, bool_or(hit) over (partition by ev) any_hit from j)
      select ev event_id, count(*) points, {steady('sum(lat)')} lat_sum, {steady('avg(pres)')} pres_mean from k where hit or not any_hit group by ev"""
    out["g20_ground_truth"] = f"with {TRACK}, {G20} select q query_id, c candidate_id, rk rank, round(d, 5) distance from g20"
    out["track_errors_top1"] = f"with {ERRORS} select q query_id, c candidate_id, {', '.join(f'{steady(c)} {c}' for c in ERROR_NAMES)} from errs"
    out["mean_physical_errors"] = f"with {ERRORS} select {', '.join(f"{steady(f'avg({c})')} {c}" for c in ERROR_NAMES)} from errs"
    retrieval = f"""with recursive {POOL}, {EDGES}, {WINDOWS},
      cov as (select w.id, unnest(e.embedding) v, generate_subscripts(e.embedding, 1) p from wins w
        join embeddings e on e.vec_id % 6 = 0 and e.vec_id * 3600 >= w.s and e.vec_id * 3600 < w.e),
      cell as (select id, p, cast(avg(cast(v as double)) as float) v from cov group by id, p),
      unit as (select *, sqrt(sum(cast(v as double) * cast(v as double)) over (partition by id)) nrm from cell),
      rvecs as (select u.id, list(cast(cast(u.v as double) / u.nrm as float) order by u.p) v, any_value(x.g) g from unit u join vecs x on x.id = u.id group by u.id),
      {knn('r_context', 1, 64, 60, 'rvecs')},
      {fused_rows('r', 'k_event', 'r_context', 'k_meta')},
      pw as (select f.q, f.a cid, f.pr rnk, w.tp, w.s, w.e from rpool1 f join wins w on w.id = f.a where f.pr <= 60),
      {suppression('pw', 'q || chr(1) || tp', 0.5, 12)},
      rpool as materialized (select f.*, greatest(f.fe, f.fx, f.fm) - least(f.fe, f.fx, f.fm) gap, 1 / (1 + f.de) score_final, 0.0::double score_calibrated,
        false rel, 'test' split from rpool1 f join walk k on split_part(k.g, chr(1), 1) = f.q and k.cid = f.a where k.keep),
      {graph_ctes('rpool')}, terms as materialized ({terms('context_prior')}), scored as materialized (select *, {FROZEN_TEXT} score from terms),
      anchors as materialized (select q, a, row_number() over (partition by q order by rk) ar from (
        select k.q, k.a, k.rk from k_context k join rpool p on p.q = k.q and p.a = k.a where k.rk <= 20) qualify ar <= 5),
      proposal as materialized (select q, a, score, row_number() over (partition by q order by score desc, a) pr from scored where q in (select q from anchors)), {merged(5, 21)}"""
    out["retrieval_top20"] = f"""{retrieval}
      select m.q query_id, m.a candidate_id, m.rk rank, {signless('cast(s.score as double)', 4)} score
      from merged m join scored s on s.q = m.q and s.a = m.a"""
    out["audit_counters"] = f"""{retrieval},
      c as (select q, count(*) n from r_context group by q), f as (select q, count(*) n from rpool1 where pr <= 60 group by q),
      k as (select split_part(g, chr(1), 1) q, count(case when keep then 1 end) kept, count(case when not keep and ov then 1 end) o,
        count(case when not keep and st then 1 end) s from walk group by 1), m as (select q, count(*) n from merged group by q)
      select c.q query_id, c.n retrieved, f.n fused, k.kept ranker_input, k.kept survivors, coalesce(m.n, 0) returned, k.o overlap_suppressed,
      k.s start_suppressed, 0::bigint excluded, 1 certified from c join f on f.q = c.q join k on k.q = c.q left join m on m.q = c.q"""
    limbs = ", ".join(f"cast(sum(cast('0x' || substr(h, {1 + 8 * i}, 8) as hugeint)) as varchar) l{i}" for i in range(8))
    out["label_graph_digest"] = f"""with {POOL}, {EDGES}, g as (select tq, c, sum(w) sw, max(w) mw from edges group by tq, c),
      x as (select sha256(tq || chr(1) || c || chr(1) || cast(sw as varchar) || chr(1) || cast(mw as varchar)) h from g),
      s as (select {limbs}, count(*) n from x)
      select sha256({" || ',' || ".join(f'l{i}' for i in range(8))} || ',' || cast(n as varchar)) graph_sha256, n edge_count from s"""
    out["fold_deltas"] = f"with {PAIRED} select fold, round(avg(proposed - baseline), 6) mean_delta, count(*) query_count, (avg(proposed - baseline) > 0)::int positive from paired group by fold"
    out["fold_window_contract"] = """with f as (select date_diff('day', date '2024-01-01', ts::date) // 10 fold, min(ts) a, max(ts) b from events group by 1),
      p as (select f.*, g.b tb from f join f g on g.fold + 1 = f.fold)
      select count(*) fold_count, count(distinct fold) fold_names, count(case when not tb < a then 1 end) train_overlaps, count(case when not a <= b then 1 end) empty_folds from p"""
    out["seed_sd"] = """with u as (select event_type, user_id, avg(value) v from events group by 1, 2), m as (select event_type, avg(v) m from u group by 1)
      select count(*) seeds, round(avg(m), 6) seed_mean, round(stddev_pop(m), 6) seed_sd from m"""
    # Multipliers of the draws' hash and seed 7.
    by_seed, by_resample, by_first, by_second, one, two = (
        4354685564936845355, 2270897969802886507, 2685821657736338717, 2177342782468422677, 4564476756301768121, 1499779743744070123
    )
    mask = 2**64 - 1

    def mixed(first: str, second: str) -> str:
        """Columns h0 to h5, of which h5 holds 64 hashed bits of (7, b, first, second)."""
        return f"""(7::hugeint * {by_seed} + b::hugeint * {by_resample} + ({first})::hugeint * {by_first} + ({second})::hugeint * {by_second}) & {mask}::hugeint h0,
          (xor(h0, h0 >> 32) * {one}::hugeint) & {mask}::hugeint h1, (xor(h1, h1 >> 29) * {two}::hugeint) & {mask}::hugeint h2, xor(h2, h2 >> 32) h5"""

    def resampled(pairs: str, resamples: int = 10_000, block: int = 1024) -> str:
        """CTEs ``g`` (k, d) to ``means`` (b, draws, m): n draws are split over blocks of rows, then pick rows of their block."""
        return f"""g as ({pairs}), placed as (select d, row_number() over (order by k) - 1 pos from g),
      size as (select count(*) n, (count(*) + {block - 1}) // {block} blocks from g),
      node as (select 0::bigint lo, blocks hi from size union all
        select unnest([lo, lo + (hi - lo) // 2]), unnest([lo + (hi - lo) // 2, hi]) from node where hi - lo > 1),
      inner_ as (select lo, hi, lo + (hi - lo) // 2 mid, ((hi - lo) // 2 * {block})::double / (least(hi * {block}, n) - lo * {block}) p, n from node, size where hi - lo > 1),
      mass as (select lo, hi, mid, k, i, exp(lgamma(k + 1.0) - coalesce(lgamma(i + 1.0), 0) - lgamma(k - i + 1.0) + i * ln(p) + (k - i) * ln(1 - p)) w
        from (select *, unnest(range(k + 1)) i from (select *, unnest(range(n + 1)) k from inner_))),
      steps as (select *, sum(w) over (partition by lo, hi, k order by i) upto from mass),
      cdf as (select lo, hi, mid, k, i, case when i = 0 then 0 else lag(upto) over (partition by lo, hi, k order by i) end above,
        case when i = k then 2 else upto end below from steps),
      tree as (select b, 0::bigint lo, blocks hi, n k from size, range({resamples}) r(b) union all
        select b, unnest([t.lo, c.mid]), unnest([c.mid, t.hi]), unnest([c.i, t.k - c.i])
        from (select *, (h5 >> 11)::double / 9007199254740992 u from (select *, {mixed('lo', '4294967296 + hi')} from tree where hi - lo > 1)) t
        join cdf c on c.lo = t.lo and c.hi = t.hi and c.k = t.k and t.u >= c.above and t.u < c.below),
      leaf as (select b, lo, unnest(range(k)) i from tree where hi - lo = 1),
      pick as (select b, lo * {block} + (((h5 >> 32) * least({block}, n - lo * {block})) >> 32)::bigint pos from (select b, lo, n, {mixed('lo', 'i')} from leaf, size)),
      means as (select b, count(*) draws, avg(d) m from pick join placed using (pos) group by b)"""

    def interval(pairs: str, block: int = 1024) -> str:
        """CTEs to ``boot`` (estimate, lower, upper, query_count, resamples), 10,000 resamples, seed 7."""
        return f"""{resampled(pairs, block=block)},
      boot as (select round((select avg(d) from g), 6) estimate, round(quantile_cont(m, 0.025), 6) lower, round(quantile_cont(m, 0.975), 6) upper,
        (select count(*) from g) query_count, 10000::bigint resamples from means)"""

    user_pairs = "select cast(user_id as varchar) k, proposed - baseline d from paired"
    out["bootstrap_resamples"] = f"""with recursive {PAIRED}, {resampled(user_pairs, 400, 16)}
      select b resample, draws, round(m, 6) mean_difference from means"""
    out["paired_bootstrap_hash"] = f"""with recursive {PAIRED}, {interval(user_pairs, 32)}
      select estimate, lower, upper, 0.95::double confidence, query_count, resamples from boot"""
    folded = "f as (select count(*) folds, min((d > 0)::int)::bigint folds_positive from (select fold, avg(s - c) d from u group by fold))"
    out["study_portability"] = f"""with recursive {scores},
      {dcg('src', 'user_id, seed', 'control', 'rel3', 'nc')}, {dcg('src', 'user_id, seed', 'system', 'rel3', 'ns_')},
      ca as (select user_id, avg(ndcg) v from nc group by 1), sa as (select user_id, avg(ndcg) v from ns_ group by 1),
      u as (select ca.user_id, ca.user_id % 3 fold, ca.v c, sa.v s from ca join sa on sa.user_id = ca.user_id), {folded},
      {interval("select cast(user_id as varchar) k, s - c d from u")}
      select boot.*, folds, folds_positive, round((select avg(c) from u), 6) control_mean, round((select avg(s) from u), 6) system_mean, 5::bigint seeds from boot, f"""
    matched = ", ".join(arms).replace("full as (select q, coalesce", "full_ as (select q, coalesce")
    out["study_matched_scoring"] = f"""with recursive {POOL}, {matched},
      u as (select b.q, b.ndcg c, f.ndcg s, b.rel20 cr, f.rel20 sr from backend b join full_ f on f.q = b.q), {interval("select q k, s - c d from u")}
      select boot.*, round((select avg(c) from u), 6) backend_mean, round((select avg(s) from u), 6) full_mean,
      round((select avg(cr) from u), 6) backend_relevant, round((select avg(sr) from u), 6) full_relevant from boot"""
    out["study_physical_ablation"] = f"""with recursive x as (select user_id, avg(value) a, coalesce(avg(case when event_type = 'view' then value end), 0) v from events group by 1),
      u as (select user_id, user_id % 3 fold, a / (a + 100) c, v / (v + 100) s, a * 10 ce, v * 5 se from x), {folded},
      {interval("select cast(user_id as varchar) k, s - c d from u")}
      select boot.*, folds, folds_positive, round((select avg(c) from u), 6) baseline_mean, round((select avg(s) from u), 6) system_mean,
      round((select avg(ce) - avg(se) from u), 6) reduction_km from boot, f"""
    out["study_json_explode"] = "select event_type, count(*) n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) k_sum from events group by event_type"
    out["portability_pairs"] = f"""with {scores}, {dcg('src', 'user_id, seed', 'control', 'rel3', 'c')}, {dcg('src', 'user_id, seed', 'system', 'rel3', 's')},
      ca as (select user_id, avg(ndcg) v from c group by 1), sa as (select user_id, avg(ndcg) v from s group by 1)
      select ca.user_id, round(ca.v, 6) control, round(sa.v, 6) system from ca join sa on sa.user_id = ca.user_id"""
    out["dense_positions"] = """select event_id, row_number() over (partition by event_type order by ts, event_id) place,
      count(*) over (partition by event_type) group_rows from events"""
    return out
