"""SQL for DuckDB that restates the catalogue's queries."""

from __future__ import annotations

from calamus.plans.catalog import BOOT, EVERY, FEATURES, PAIRS, SEED

WORD = r"'([\p{L}\p{Nl}\p{No}_]+)'"


def terms(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), {WORD}, 1)"


def draw(n: str, *parts: str) -> str:
    key = "||'|'||".join(p if p[0] == "'" else f"({p})::varchar" for p in (f"'{SEED}'", *parts))
    return f"(('0x'||substr(md5({key}),1,15))::bigint % ({n}))"


DOCS = f"""docs as materialized (select doc_id, upper(trim(any_value(author))) author, any_value(title) title, any_value({terms("array_to_string(tokens, ' ')")}) words
 from corpus where tokens is not null and author is not null and title is not null group by doc_id)"""
CNT = "cnt as materialized (select doc_id, term, count(*) tf from (select doc_id, unnest(words) term from docs) group by all)"


def voc(k: int = FEATURES, min_df: int = 2, by: str = "cf") -> str:
    return f"voc as materialized (select term, sum(tf)::bigint cf, count(*) df from cnt group by term having count(*) >= {min_df} order by {by} desc, term limit {k})"


NORM = "(select doc_id, term, v / sqrt(sum(v * v) over (partition by doc_id)) v from {})"
KEPT = "kept as (select doc_id, term, tf, cf, df from cnt join voc using (term)), nn as (select count(*)::double n from docs)"
RAW = {
    "tf": "raw as (select doc_id, term, tf::double v from kept)",
    "bin": "raw as (select doc_id, term, 1::double v from kept)",
    "tfidf": "raw as (select doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) v from kept, nn)",
    "std": f"""t1 as (select doc_id, term, tf::double v from kept), t2 as {NORM.format("t1")},
 sd as (select term, sqrt(greatest(sum(v * v) / max(n) - pow(sum(v) / max(n), 2), 0)) sd from t2, nn group by term),
 raw as (select doc_id, term, v / case when sd > 0 then sd else 1 end v from t2 join sd using (term))""",
}


def em(start: str, iterations: int, eps: float | None) -> str:
    done = "false" if eps is None else f"bool_and(abs(m - q) < {eps}) over (partition by doc_id)"
    return f"""bg as (select term, cf / (select sum(cf)::double from voc) * 0.9 pc from voc),
 em as (with recursive e(it, doc_id, term, tf, pc, p, done) as (
   select 0, doc_id, term, tf::double, pc, {start}, false from kept join bg using (term)
   union all
   select it + 1, doc_id, term, tf, pc, case when done then p else m end, done or fin from (
     select *, {done} fin from (select *, x / sum(x) over (partition by doc_id) m from (select *, p * 0.1::double q, tf * p * 0.1::double / (pc + p * 0.1::double) x from e where it < {iterations})))
 ) select doc_id, term, p v from e where it = {iterations})"""


PLM = em("1::double / count(*) over (partition by doc_id)", 50, 0.01)
RAW["plm"] = f"{PLM}, raw as (select doc_id, term, v from em)"


def vsm(model: str, k: int = FEATURES) -> str:
    return f"{CNT}, {voc(k, 2, 'df' if model == 'bin' else 'cf')}, {KEPT}, {RAW[model]}, dtm as materialized {NORM.format('raw')}"


GRAM = "case when length(w) <= {n} then ['%'||w||'$'] else list_transform(range(1, length(w) - {n} + 2), lambda i: substring('%'||w||'$', i::bigint, {n})) end"
GRAMS = f"cnt as materialized (select doc_id, term, count(*) tf from (select doc_id, unnest({GRAM.format(n=4)}) term from (select doc_id, unnest(words) w from docs)) group by all)"
DENSE = f"{DOCS}, {CNT}, {voc(10**9, 1)}, {KEPT}, {em('tf / sum(tf) over (partition by doc_id)', 50, None)}"
STEM = "split_part({0}, '_', 1)"
AGREE = "(contains({0}, '_') and contains({1}, '_') and split_part({0}, '_', 1) = split_part({1}, '_', 1))"
LABEL = "case when {0} = {1} then 'same_author' else 'diff_author' end"
ALL = f"""pairs as (select a.doc_id i, b.doc_id j, a.author author_i, b.author author_j, a.title title_i, b.title title_j, {LABEL.format("a.author", "b.author")} as label
 from docs a join docs b on a.doc_id <> b.doc_id where a.doc_id % {EVERY} = 0)"""


def halves(*by: str) -> str:
    key = "||'|'||".join(["'10'", *[f"({b})::varchar" for b in by]])
    cols = ", ".join(f"{b} g{n}" for n, b in enumerate(by))
    on = " and ".join(f"{b} = g{n}" for n, b in enumerate(by))
    return f"""grp as (select *, row_number() over (order by md5({key})) - 1 p, count(*) over () c from (select distinct {cols}, {", ".join(by)} from docs)),
 ph as materialized (select docs.*, case when p < c // 2 then 'dev' else 'test' end phase from docs join (select g0{", g1" if len(by) > 1 else ""}, p, c from grp) g on {on})"""


def drawn(frm: str, n: int, name: str) -> str:
    return balanced(frm, n, name, whole=True)


def balanced(frm: str, n: int, name: str, whole: bool = False) -> str:
    """A balanced sample of pairs of the documents of `frm`, or one of all pairs, drawn by keyed hashes."""
    x = name

    def half(which: str, weight: str, on: str, many: str) -> str:
        every = f"(select s{which} <= 8 * {many} from {x}n)"
        size = f"(select s{which} from {x}n)"
        return f"""{x}f{which} as materialized (select *, coalesce(sum({weight}) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint f, {weight} w from {x}p, {x}n),
 {x}d{which} as materialized (select case when {every} then k else {draw(f"greatest({size}, 1)", f"'{which}'", "k")} end x, case when {every} then md5('{SEED}|all|' || k) else lpad(k::varchar, 15, '0') end o
   from (select unnest(range(case when {every} then {size} else 8 * {many} end)) k)),
 {x}h{which} as (select s.*, x - f q, o from {x}f{which} s join {x}d{which} d on x >= f and x < f + w),
 {x}{which} as materialized (select i, j, min(o) o, any_value(author_i) author_i, any_value(author_j) author_j, any_value(title_i) title_i, any_value(title_j) title_j
   from (select a.doc_id i, b.doc_id j, a.author author_i, b.author author_j, a.title title_i, b.title title_j, o from {x}h{which} a join {x}p b on {on}) where not {AGREE.format('title_i', 'title_j')} group by i, j order by o limit {many})"""

    many = f"(select count(*) from {x}same)"
    halves_ = f"""{half("same", "(c - gn)", "b.author = a.author and b.r = q + case when q >= a.gs then a.gn else 0 end", str(n // 2))},
 {half("diff", "(nd - c)", "b.pos = q + case when q >= a.st then a.c else 0 end", many)},
 {name} as materialized (select *, {LABEL.format("author_i", "author_j")} as label from (select * from {x}same union all select * from {x}diff))"""
    if whole:
        halves_ = f"""{half("any", "(nd - 1)", "b.pos = q + case when q >= a.pos then 1 else 0 end", str(n)).replace("8 * ", "4 * ")},
 {name} as materialized (select *, {LABEL.format("author_i", "author_j")} as label from {x}any)"""
    return f"""{x}g as (select doc_id, author, title, md5('{SEED}|' || doc_id) k, case when contains(title, '_') then 's' || split_part(title, '_', 1) else 'd' || doc_id end g from {frm}),
 {x}a as (select author, c, coalesce(sum(c) over (order by md5('{SEED}|' || author) rows between unbounded preceding and 1 preceding), 0)::bigint st from (select author, count(*) c from {x}g group by 1)),
 {x}r as (select *, row_number() over (partition by author order by md5(g), k) - 1 r from {x}g),
 {x}p as materialized (select v.*, c, st, st + r pos from (select *, min(r) over (partition by author, g) gs, count(*) over (partition by author, g) gn from {x}r) v join {x}a using (author)),
 {x}n as materialized (select count(*) nd, coalesce(sum(c - gn), 0)::bigint ssame, (count(*) * count(*) - sum(c))::bigint sdiff, count(*) * (count(*) - 1) sany from {x}p),
 {halves_}"""


METRIC = {
    "minmax": "case when s1i + s1j - mn > 0 then greatest(0, (s1i + s1j - 2 * mn) / (s1i + s1j - mn)) else 0 end",
    "euclidean": "sqrt(greatest(0, round(s2i + s2j - 2 * dot, 12)))",
    "cityblock": "greatest(0, s1i + s1j - 2 * mn)",
    "cosine": "case when s2i * s2j > 0 then greatest(0, 1 - dot / sqrt(s2i * s2j)) end",
    "divergence": "greatest(0, dv + 4 * (nzi + nzj - 2 * n))",
}


def dists(pairs: str, *metrics: str, name: str = "dists") -> str:
    """Distances of a list of pairs; the sums it needs of each document are named after it."""
    cols = ", ".join(f"{METRIC[m]} {m}" for m in metrics)
    zero = ", ".join(f"coalesce({c}, 0) {c}" for c in ("mn", "dot", "dv", "n"))
    side = lambda s: f"coalesce({s}.s1, 0) s1{s}, coalesce({s}.s2, 0) s2{s}, coalesce({s}.nz, 0) nz{s}"
    return f"""sm{name} as materialized (select doc_id, sum(v) s1, sum(v * v) s2, count(*)::double nz from dtm group by doc_id),
 met{name} as (select i, j, sum(least(a.v, b.v)) mn, sum(a.v * b.v) dot, sum(pow(2 * (a.v - b.v) / (a.v + b.v), 2)) dv, count(*)::double n from (select distinct i, j from {pairs}) p join dtm a on a.doc_id = i join dtm b on b.doc_id = j and b.term = a.term group by i, j),
 {name} as materialized (select *, {cols} from (select p.*, {zero}, {side("i")}, {side("j")} from {pairs} p left join met{name} m on m.i = p.i and m.j = p.j left join sm{name} i on i.doc_id = p.i left join sm{name} j on j.doc_id = p.j))"""


PH = f"{DOCS}, {halves('author')}"
DEV = "dev as (select * from ph where phase = 'dev')"
TEST = "test as (select * from ph where phase = 'test')"
FIT = f"""{PH}, {DEV}, {vsm("tf")}, {balanced("dev", PAIRS, "pairs")}, {dists("pairs", "minmax")},
 sc as materialized (select i, j, label, round((minmax - lo) / (hi - lo), 9) score from dists, (select min(minmax) lo, max(minmax) hi from dists)),
 tr as materialized (select round(1 - score, 9) sim, (label <> 'diff_author')::int y, i, j from sc)"""
PREDICT = f"""{PH}, {DEV}, {TEST}, {vsm("std")}, {balanced("dev", PAIRS, "pd")}, {balanced("test", PAIRS, "pt")},
 both_ as (select 'dev' phase, * from pd union all select 'test', * from pt), {dists("both_", "minmax")},
 sc as materialized (select phase, i, j, label, round((minmax - lo) / (hi - lo), 9) score from dists, (select min(minmax) lo, max(minmax) hi from dists)),
 tr as materialized (select phase, round(1 - score, 9) sim, (label <> 'diff_author')::int y from sc)"""


def curve(src: str = "tr", name: str = "cv") -> str:
    return f"""{name}a as (select sim, sum(y) y, count(*) n from {src} group by sim), {name}b as (select sim, y, sum(y) over (order by sim desc) tp, sum(n) over (order by sim desc) k, sum(y) over () al from {name}a),
 {name} as materialized (select sim threshold, tp / k as precision, tp / al as recall, case when tp > 0 then 2 * (tp / k) * (tp / al) / (tp / k + tp / al) end f1 from {name}b where tp - y < al and al > 0)"""


def hits(where: str, src: str = "tr") -> str:
    return f"""select round(tp / greatest(k, 1), 6) as precision, round(case when al > 0 then tp / al else 0 end, 6) as recall, case when tp > 0 then round(2 * (tp / k) * (tp / al) / (tp / k + tp / al), 6) end f1
 from (select sum(y) filter ({where})::double tp, count(*) filter ({where}) k, sum(y) al from {src})"""


BEST = "(select * from cv where f1 is not null order by round(f1, 12) desc, threshold desc limit 1)"


def area(high: str) -> str:
    return f"""with {FIT}, {curve()} select round(sum((recall - r0) * {high}), 6) ap from (select *, coalesce(lag(precision) over (order by threshold desc), 1) p0, coalesce(lag(recall) over (order by threshold desc), 0) r0 from cv)"""


def sigma_base(metric: str = "minmax", background: str = "test") -> str:
    b = BOOT
    keep = " and ".join(f"not {AGREE.format('b.title', 'title_' + s)}" for s in "ij")
    return f"""{PH}, {DEV}, {TEST}, {vsm("tf", b.n_features)}, {balanced("dev", PAIRS, "pairs")},
 ib as (select p.i, b.doc_id j from (select distinct i from pairs) p, {background} b), {dists("ib", metric, name="near")},
 pot as materialized (select * from (select i, j, b, dist, row_number() over (partition by i, j order by dist, b) - 1 r from (
   select p.i, p.j, b.doc_id b, round(n.{metric}, 9) dist from pairs p join {background} b on b.author <> author_i and b.author <> author_j and {keep} join near n on n.i = p.i and n.j = b.doc_id)) where r < {b.n_potential})"""


def sigma_whole(reward: str, authors: bool, metric: str = "minmax") -> str:
    """Sigma over all features: impostors drawn, or all potential ones."""
    b = BOOT
    imp = f"""imp as (select i, j, it, b x, count(*) t from (select i, j, it, {draw("have", "'imp'", "i", "j", "it", "d")} r from runs, range({b.actual}) t(d)) join pot using (i, j, r) group by all)"""
    if not authors:
        imp = "imp as (select i, j, it, b x, 1 t from runs join pot using (i, j))"
    return f"""with {sigma_base(metric)},
 runs as materialized (select i, j, have, it from (select i, j, count(*) have from pot group by i, j), range({b.iterations}) t(it)), {imp},
 riv as materialized (select i, j, it, x, t from imp union all select i, j, it, j, 0 from runs),
 want as (select distinct i, x j from riv), {dists("want", metric, name="wd")},
 ds as (select r.i, r.j, r.it, r.x, t, round({metric}, 9) d from riv r join wd on wd.i = r.i and wd.j = r.x),
 rk as (select i, j, it, 1 + coalesce(sum(t) filter (d < tg), 0) rank from (select *, max(d) filter (t = 0) over (partition by i, j, it) tg from ds) group by i, j, it)
select i, j, label, round(1 - s / {b.iterations}, 6) score from (select i, j, sum({reward}) s from rk group by i, j) join (select i, j, label from pairs) using (i, j)"""


def sigma(reward: str, metric: str = "minmax", authors: bool = True, background: str = "test") -> str:
    b = BOOT
    imp = f"""imp as (select i, j, it, b x, count(*) t from (select i, j, it, {draw("have", "'imp'", "i", "j", "it", "d")} r from runs, range({b.actual}) t(d)) join pot using (i, j, r) group by all)"""
    if not authors:
        imp = "imp as (select i, j, it, b x, 1 t from runs join pot using (i, j))"
    weighted = METRIC[metric] if metric != "cityblock" else "greatest(0, w1i + w1j - 2 * wmn)"
    return f"""with {sigma_base(metric, background)},
 runs as materialized (select i, j, have, it from (select i, j, count(*) have from pot group by i, j), range({b.iterations}) t(it)), {imp},
 riv as materialized (select i, j, it, x, t from imp union all select i, j, it, j, 0 from runs),
 idx as (select term, row_number() over (order by term) - 1 idx from voc),
 ft as materialized (select i, j, it, term, m from (select i, j, it, idx, count(*)::double m from (select i, j, it, {draw("(select count(*) from voc)", "'feat'", "i", "j", "it", "f")} idx from runs, range({int(b.random_prop * b.n_features)}) t(f)) group by all) join idx using (idx)),
 pt as materialized (select r.i, r.j, r.it, r.x, r.t, coalesce(sum(m * least(a.v, b.v)), 0) mn, coalesce(sum(m * a.v), 0) s1i, coalesce(sum(m * b.v), 0) s1j
   from riv r join ft f using (i, j, it) left join dtm a on a.doc_id = r.i and a.term = f.term left join dtm b on b.doc_id = r.x and b.term = f.term group by all),
 least_ as (select 1),
 mm as (select r.i, r.j, r.it, r.x, coalesce(sum(m * least(a.v, b.v)), 0) mn2 from riv r join ft f using (i, j, it) join dtm a on a.doc_id = r.i and a.term = f.term join dtm b on b.doc_id = r.x and b.term = f.term group by all),
 wh as (select p.i, p.x, wi.s1 w1i, wj.s1 w1j, (select coalesce(sum(least(a.v, b.v)), 0) from dtm a join dtm b using (term) where a.doc_id = p.i and b.doc_id = p.x) wmn from (select distinct i, x from riv) p join smnear wi on wi.doc_id = p.i join smnear wj on wj.doc_id = p.x),
 ds as (select i, j, it, x, t, round({weighted}, 9) d from (select pt.* exclude (mn), coalesce(mn2, 0) mn, w1i, w1j, wmn from pt left join mm using (i, j, it, x) left join wh using (i, x))),
 rk as (select i, j, it, 1 + coalesce(sum(t) filter (d < tg), 0) rank from (select *, max(d) filter (t = 0) over (partition by i, j, it) tg from ds) group by i, j, it)
select i, j, label, round(1 - s / {b.iterations}, 6) score from (select i, j, sum({reward}) s from rk group by i, j) join (select i, j, label from pairs) using (i, j)"""


def smooth(length: int, window: str) -> str:
    n, k = length - 1, "k::double"
    w = {
        "flat": "1::double", "hanning": f"0.5 - 0.5 * cos(2 * pi() * {k} / {n})", "hamming": f"0.54 - 0.46 * cos(2 * pi() * {k} / {n})",
        "bartlett": f"1 - abs(2 * {k} / {n} - 1)", "blackman": f"0.42 - 0.5 * cos(2 * pi() * {k} / {n}) + 0.08 * cos(4 * pi() * {k} / {n})",
    }[window]
    return f"""with sg as (select row_number() over (order by sail_year) - 1 pos, n::double x from (select sail_year, count(distinct sailing_id) n from soldier_sailing where sail_year is not null group by 1)),
 e as (select count(*) n, max(x) filter (pos = 0) x0, arg_max(x, pos) x1 from sg),
 s as (select {length} - pos as at, 2 * x0 - x x from sg, e where pos between 2 and {length} union all select pos + {n}, x from sg union all select {n} + 2 * n - 1 - pos, 2 * x1 - x from sg, e where pos >= n - {n}),
 w as (select k, ({w}) / sum({w}) over () w from range({length}) t(k)),
 y as (select s.at + k - {n // 2} - {n} as pos, sum(x * w) y from s, w group by 1)
select pos, round(y, 6) y from y, e where pos >= 0 and pos < n"""


def sweep() -> str:
    """Max F1 by model and metric; of equal F1 the highest threshold counts, which doesn't show."""
    parts = []
    for m in RAW:
        long = " union all ".join(f"select '{d}' metric, label, round({d}, 9) dist from dists" for d in METRIC)
        best = ", ".join(f"max(f1) filter (metric = '{d}') {d}" for d in METRIC)
        parts.append(f"""select '{m}' vsm, {best} from (with {PH}, {DEV}, {vsm(m)}, {balanced("dev", PAIRS, "pairs")}, {dists("pairs", *METRIC)}, r as materialized ({long}),
 tr as (select metric, round(1 - round((dist - lo) / (hi - lo), 9), 9) sim, (label <> 'diff_author')::int y from r join (select metric, min(dist) lo, max(dist) hi from r group by 1) using (metric) where hi > lo),
 a as (select metric, sim, sum(y) y, count(*) n from tr group by all),
 c as (select metric, sum(y) over (partition by metric order by sim desc) tp, sum(n) over (partition by metric order by sim desc) k, sum(y) over (partition by metric) al from a)
 select metric, round(2 * (tp / k) * (tp / al) / (tp / k + tp / al), 6) f1 from c where tp > 0)""")
    return " union all ".join(parts)


CLEAN = r"regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^\p{L}\p{Nd} ]', '', 'g')"
LATIN = r"list_filter(regexp_split_to_array(lower(translate(regexp_replace(text, '[^\p{L}\s]', '', 'g'), 'vj', 'ui')), '\s+'), lambda w: w <> '')"
CAP = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2))"


def oracle_sql() -> dict[str, str]:
    search = f"{DOCS}, {vsm('tf')}, {ALL}"
    whole = search.replace(f" where a.doc_id % {EVERY} = 0", "")
    out = {
        "tokenize_counts": f"select doc_id, len(t) n_tokens, len(list_distinct(t)) n_types from (select doc_id, {terms('text')} t from documents where text is not null)",
        "deaccent": "select doc_id, md5(strip_accents(text)) folded from documents where text is not null",
        "char_ngrams": f"with {DOCS} select gram, count(*) n from (select unnest({GRAM.format(n=4)}) gram from (select unnest(words) w from docs)) group by 1",
        "distinct_ngrams": " union all ".join(f"select {n} n, count(distinct gram) grams from (with {DOCS} select unnest({GRAM.format(n=n)}) gram from (select distinct w from (select unnest(words) w from docs)))" for n in (2, 3, 4, 5)),
        "clean_text": f"select distinct work_id, md5({CLEAN}) cleaned from raw_works where text is not null",
        "chunk_words": f"""with w as (select replace(any_value(file_name), '.txt', '') as name, any_value({LATIN}) w from raw_works where text is not null and file_name is not null group by work_id)
 select name, (k + 1)::int n, md5(array_to_string(w[k * 1000 + 1 : k * 1000 + 1000], ' ')) chunk from (select name, w, unnest(range(len(w) // 1000)) k from w)""",
        "token_halves": f"""with {DOCS} select doc_id, {STEM.format("title")} stem, author || '_' || title as label, array_to_string(words[1:5], ' ') first_words, md5(array_to_string(words[1 : len(words) // 2], ' ')) first_half,
 md5(array_to_string(words[len(words) // 2 + 1 :], ' ')) second_half from docs""",
        "scribe_metadata": f"""select file_name, s scribe, p[1] text_id, p[3] village, p[2] date, s || '_' || p[1] || '_' || p[3] || '_' || p[2] new_name from (select file_name, p, replace({CAP.format("p[4]")}, '.', '') s
 from (select distinct file_name, string_split(file_name, '_') p from soldier_letters where file_name is not null) where len(p) = 7)""",
        "sailing_metadata": f"""select file_name, n as name, p[1] text_id, n || '_' || p[1] new_name from (select file_name, p, {CAP.format("p[4]")} n from (select distinct file_name, string_split(file_name, '-') p from soldier_sailing where file_name is not null) where len(p) >= 4)""",
        "index_names": "select file_name, k::varchar author, k::varchar title, k || '_' || k || '.txt' new_name from (select file_name, row_number() over (order by file_name) - 1 k from (select distinct file_name from soldier_letters where file_name is not null))",
        "work_authors": """with f as (select distinct work_id, file_name from raw_works where file_name is not null)
 select work_id, split_part(file_name, '_', 1) author, replace(substr(file_name, instr(file_name, '_') + 1), '.txt', '') title from f where contains(file_name, '_')
 union all select work_id, (row_number() over (order by file_name) - 1)::varchar, replace(file_name, '.txt', '') from f where not contains(file_name, '_')""",
        "split_authors": f"with {DOCS}, {halves('author')} select doc_id, phase from ph",
        "split_titles": f"with {DOCS.replace('any_value(title) title,', 'any_value(title) title, split_part(any_value(title), chr(95), 1) stem,')}, {halves('author', 'stem')} select doc_id, phase from ph",
        "split_random": f"with {DOCS}, {halves('doc_id')} select doc_id, phase from ph",
        "corpus_stats": f"""with {PH}, c as (select phase, author, count(*) c from ph group by all) select phase, sum(len(words))::bigint total_words, (select count(distinct w) from (select phase q, unnest(words) w from ph) where q = a.phase) unique_words,
 count(distinct author) authors, count(*) docs, (select sum(c * (c - 1))::bigint from c where c.phase = a.phase) sadps, (count(*) * (count(*) - 1) - (select sum(c * (c - 1)) from c where c.phase = a.phase))::bigint dadps from ph a group by phase""",
        "author_counts": f"with {DOCS} select author, count(*) docs from docs group by author",
        "jumbled_halves": f"""with {DOCS}, e as (select doc_id, list_transform(list_sort(list_transform(range(len(words)), lambda p: struct_pack(k := md5('1000|' || doc_id || '|' || p), p := p, w := words[p + 1]))), lambda s: s.w) w
   from docs where author in (select author from docs group by 1 having count(*) > 1))
 select doc_id::varchar code, doc_id || 'a' title, md5(array_to_string(w[1 : len(w) // 2], ' ')) words from e union all select doc_id::varchar, doc_id || 'b', md5(array_to_string(w[len(w) // 2 + 1 :], ' ')) from e""",
        "vocab_topk": f"with {DOCS}, {CNT}, {voc()} select term, cf, df from voc",
        "vocab_topk_bin": f"with {DOCS}, {CNT}, {voc(by='df')} select term, cf, df from voc",
        **{f"vsm_{m}": f"with {DOCS}, {vsm(m)} select doc_id, term, round(v, 6) as value from dtm" for m in RAW},
        "plm_dense": f"with {DENSE} select doc_id, term, round(v, 6) as value from em",
        "plm_topk": f"with {DENSE} select doc_id, term, round(v, 6) as value, r::int rank from (select *, row_number() over (partition by doc_id order by round(v, 9) desc, term) r from em) where r <= 10",
        "plm_cross_entropy": f"""with {DENSE}, q as (select doc_id q, term, v pq, pc from em join bg using (term) where doc_id % {EVERY} = 0), b as (select q, sum(pq * pc) base from q group by q),
 m as (select q, doc_id, sum(pq * (greatest(pc, ln(v) + 0.1) + ln(1 + exp(-abs(pc - ln(v) - 0.1))) - pc)) more from q join (select doc_id, term, v from em where v > 0) using (term) group by all),
 c as (select q, doc_id, -(base + coalesce(more, 0)) ce from (select q, base, doc_id from b, (select distinct doc_id from em)) left join m using (q, doc_id)) select q, doc_id, round(ce, 6) ce, row_number() over (partition by q order by round(ce, 9), doc_id)::int rank from c""",
        "pairs_all": f"with {DOCS}, {ALL} select i, j, label from pairs",
        "pairs_controlled": f"with {DOCS}, {ALL} select i, j, label from pairs where not {AGREE.format('title_i', 'title_j')}",
        "pairs_limited": f"with {DOCS}, {ALL} select i, j, label from pairs where not {AGREE.format('title_i', 'title_j')} order by md5('{SEED}|' || i || '|' || j), i, j limit {PAIRS}",
        "pairs_balanced": f"with {DOCS}, {balanced('docs', PAIRS, 'pairs')} select i, j, label from pairs",
        "pair_stats": f"with {DOCS}, c as (select count(*) c from docs group by author) select n, same sadps, n * (n - 1) - same dadps, printf('%.1f', same / (n * (n - 1)) * 100) same_percent from (select sum(c)::bigint n, sum(c * (c - 1))::bigint same from c)",
        **{f"dist_{m}": f"with {search if m != 'divergence' else whole}, {dists('pairs', m)} select i, j, label, round({m}, 6) dist from dists" for m in METRIC},
        "scores_scaled": f"with {FIT} select i, j, label, round(score, 6) score from sc",
        "scores_joint_scaled": f"with {PREDICT} select phase, i, j, label, round(score, 6) score from sc",
        "impostor_topk": f"with {sigma_base()} select i, j, b, round(dist, 6) dist, r::int r from pot",
        "impostor_sigma_top1": sigma("(rank = 1)::int::double"),
        "impostor_sigma_mrr": sigma("case when rank <= 11 then 1::double / rank else 0 end"),
        "impostor_sigma_cityblock": sigma("(rank = 1)::int::double", "cityblock"),
        "pr_curve": f"with {FIT}, {curve()} select round(threshold, 6) threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) f1 from cv",
        "threshold_eval": f"with {FIT} select 0.5::double threshold, * from ({hits('sim >= 0.5')})",
        "average_precision": area("(precision + p0) / 2"),
        "average_precision_step": area("precision"),
        "rank_proportional": f"with {FIT}, rr as (select *, row_number() over (order by sim desc, i, j) r from tr) {hits('r <= 100', 'rr')}",
        "rank_calibrated": f"with {FIT}, rr as (select *, row_number() over (order by sim desc, i, j) r, sum(y) over () a from tr) {hits('r <= a', 'rr')}",
        "rank_breakeven": f"with {FIT}, {curve()} select round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) f1 from {BEST}",
        "threshold_transfer": f"with {PREDICT}, td as (select * from tr where phase = 'dev'), {curve('td')}, bs as (select threshold from {BEST}), tt as (select tr.*, threshold from tr, bs where phase = 'test') select (select round(threshold, 6) from bs) threshold, * from ({hits('sim >= threshold', 'tt')})",
        "ks_two_sample": f"""with {FIT}, e as (select sim, sum(y) a, sum(1 - y) b from tr group by sim), r as (select sum(a) over (order by sim) a, sum(b) over (order by sim) b, sum(a) over () na, sum(b) over () nb from e)
 select round(d, 6) d, n_same, n_diff, round(case when x > 0.05 then least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2 * k * k * x * x))), 0), 1) else 1 end, 6) p
 from (select *, (en + 0.12 + 0.11 / en) * d x from (select *, sqrt(n_same::double * n_diff / (n_same + n_diff)) en from (select max(abs(a / na - b / nb)) d, max(na)::bigint n_same, max(nb)::bigint n_diff from r)))""",
        "kde_grid": f"""with {FIT}, g as (select k / 20 x from range(21) t(k)), h as (select label, stddev_samp(score) * pow(count(*), -0.2) h from sc group by label)
 select label, round(x, 6) x, round(avg(exp(-pow((x - score) / h, 2) / 2)) / (max(h) * sqrt(2 * pi())), 6) density from sc join h using (label), g group by label, x""",
        "distance_table": f"with {search}, {dists('pairs', 'minmax')} select author_i || '_' || title_i id_i, author_j || '_' || title_j id_j, round(minmax, 6) d from dists",
        "distance_corr": f"with {search}, {dists('pairs', 'minmax')}, t as (select i, j, trunc(round(minmax, 9) * 1000) d from dists union all select distinct i, i, 0 from dists) select x.i a, y.i b, round(case when stddev_pop(x.d) * stddev_pop(y.d) > 0 then corr(x.d, y.d) end, 6) r from t x join t y using (j) group by all",
        "distance_dense": f"with {search}, {dists('pairs', 'minmax')} select i, j, round(minmax, 6) d from dists union all select distinct i, i, 0.0 from dists",
        "repeated_labels": f"with {DOCS} select * from (select doc_id, author, count(*) over (partition by author) docs from docs) where docs > 1",
        **{f"vsm_chars_{m}": f"with {DOCS}, {vsm(m).replace(CNT, GRAMS)} select doc_id, term, round(v, 6) as value from dtm" for m in RAW},
        "pairs_drawn": f"with {DOCS}, {drawn('docs', PAIRS, 'pairs')} select i, j, label from pairs",
        "impostor_sigma_authors": sigma_whole("(rank = 1)::int::double", True), "impostor_sigma_plain": sigma_whole("case when rank <= 11 then 1::double / rank else 0 end", False),
        "impostor_sigma_features": sigma("(rank = 1)::int::double", authors=False), "impostor_sigma_self": sigma("(rank = 1)::int::double", background="dev"),
        "closest_cross_author": f"with {search}, {dists('pairs', 'minmax')} select author_i, author_j, i, j, trunc(m * 1000)::int d from (select *, round(minmax, 9) m from dists) where author_i <> author_j and m > 0 order by m, i, j limit 250",
        **{f"smooth_{w}": smooth(n, w) for n, w in ((5, "hanning"), (4, "flat"), (7, "hamming"), (6, "bartlett"), (5, "blackman"))},
        "logsum": "select vec_id, round(m + ln(list_sum(list_transform(v, lambda x: exp(x - m)))), 6) logsum from (select vec_id, v, list_max(v) m from (select vec_id, any_value(vec::double[]) v from style_vectors where vec is not null and len(vec) > 0 group by 1))",
        "sweep_vsm_metric": sweep(),
    }
    return out
