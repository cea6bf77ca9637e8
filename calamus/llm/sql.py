"""SQL for DuckDB that restates the queries without the operators' methods."""

TERMS = r"regexp_extract_all(strip_accents(lower({})), '([\p{{L}}\p{{Nl}}\p{{No}}_]+)', 1)"
REC = f"rec as (select doc_id, any_value({TERMS.format('array_to_string(tokens, chr(32))')}) t from corpus where tokens is not null and doc_id is not null group by doc_id)"
TF = "tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(t) term from rec) group by all)"
STAT = "st as (select term, sum(tf)::bigint cf, count(*) df from tf group by term)"

P1 = f"""
with {REC}, {TF}, {STAT}, n as (select count(*) n, sum(len(t))::bigint total from rec), l as (select doc_id, len(t) length from rec)
select tf.doc_id, term from tf join st using (term) join l using (doc_id), n
where tf >= 5 and df >= 2 and df * 20 <= n and tf::hugeint * total >= 10::hugeint * cf * length
"""
P1_SCORES = f"""
with {REC}, {TF}, s as (select term, sum(tf)::bigint cf, count(*) df, sum(tf * ln(tf)) q from tf group by term), n as (select count(*) n from rec)
select doc_id, term, tf, cf, df, round(ln(1 + tf) * greatest(1 - greatest(ln(cf) - q / cf, 0) / ln(n), 0), 6) score
from tf join s using (term), n
"""
P2 = f"""
with {REC}, {TF}, {STAT}, n as (select count(*) n from rec)
select term, case when df = 1 then 'rare' else 'common' end mark from st, n where df = 1 or df * 4 > n
"""
P2_COUNTS = f"with {REC}, {TF}, {STAT} select term, cf occurrences, df records from st"
P3 = """
with recursive e as (
  select distinct upper(trim(author)) a, case when contains(title, '_') then lower(split_part(title, '_', 1)) end s from corpus where trim(author) <> ''),
pairs as (select distinct x.a a, y.a b from e x join e y using (s) where x.a <> y.a),
reach(a, b) as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a)
select distinct a author_1, b author_2 from reach where a < b
"""
LEN = "len(" + TERMS.format("text") + ")"
P7 = f"select doc_id, ceil(n / 1024)::bigint n_pieces from (select doc_id, {LEN} n from documents) where n > 1024"
P8 = f"""
with d as (select lower(trim(source)) source, {LEN} n from documents where source is not null),
z as (select source, sum(n)::bigint size from d group by source), t as (select sum(n)::bigint total from d)
select distinct mix_name, m.source from (select mix_name, lower(trim(source)) source, target_share, max_copies from mix_targets) m left join z on m.source = z.source, t
where target_share * total > max_copies * coalesce(size, 0)
"""
P8_QUEUE = f"""
with d as materialized (select doc_id, lower(trim(source)) source, coalesce({LEN}, 0) n, md5('mix|' || doc_id) k from documents where source is not null),
z as (select source, sum(n)::bigint size from d group by source), t as (select sum(n)::bigint total from d),
m as (select distinct mix_name, lower(trim(source)) source, target_share, max_copies from mix_targets where mix_name is not null and source is not null),
q as (select *, sum(n) over (partition by source order by k, doc_id rows unbounded preceding)::bigint upto from d),
c as (select mix_name, source, doc_id, n, copy, ((copy - 1) * size + upto) / target_share finish
  from (select *, unnest(range(1, max_copies + 1)) copy from q join m using (source) join z using (source) where target_share > 0 and max_copies > 0)),
s as (select *, sum(n) over (partition by mix_name order by finish, source, doc_id, copy rows unbounded preceding) spent from c),
taken as materialized (select mix_name, doc_id, source, count(*)::int copies, sum(n)::bigint tokens from s, t where spent <= total group by all)
"""
P8_COPIES = f"{P8_QUEUE} select mix_name, doc_id, source, copies from taken"
P8_REPORT = f"""{P8_QUEUE}, r as (select mix_name, source, sum(tokens)::bigint tokens from taken group by all),
a as (select m.*, coalesce(r.tokens, 0)::bigint tokens, coalesce(size, 0) size from m left join r using (mix_name, source) left join z using (source))
select mix_name, source, target_share, tokens, round(coalesce(tokens / nullif(sum(tokens) over (partition by mix_name), 0), 0), 6) share, coalesce(target_share * total > max_copies * size, false) short from a, t
"""
P4 = """
with v as materialized (select vec_id, any_value(vec)::double[] v from style_vectors where vec_id is not null and len(vec) = 64 group by vec_id),
u as materialized (select * from v where list_sum(list_transform(v, lambda x: abs(x))) > 0 and len(list_filter(v, lambda x: isfinite(x))) = 64),
s as (select a.vec_id q, b.vec_id p, list_cosine_similarity(a.v, b.v) sim from u a join u b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by q order by sim desc, p) rank from s where sim >= 0.9)
select distinct least(q, p) vec_id_1, greatest(q, p) vec_id_2 from r where rank <= 5
"""
BLANK = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def n_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{BLANK}]+'))"


P5 = rf"""
with w as (select work_id, any_value(regexp_replace(text, '\r\n?', chr(10), 'g')) t from raw_works where text is not null and work_id is not null group by work_id),
big as materialized (select * from w where {n_words("t")} > 1000), par as (select work_id, unnest(regexp_split_to_array(t, '\n[{BLANK}]*\n')) p from big),
sen as (select work_id, unnest(string_split(regexp_replace(p, '([.!?…][\p{{Pe}}\p{{Pf}}\p{{Pi}}"'']*)[{BLANK}]+([\p{{Lu}}\p{{Lt}}\p{{Ps}}\p{{Pi}}\p{{Pf}}"''‚„])', '\1' || chr(1) || '\2', 'g'), chr(1))) s from par where {n_words("p")} > 1000),
most as (select work_id, max({n_words("s")}) m from sen group by work_id)
select work_id, case when m is null then 'paragraph' when m <= 1000 then 'sentence' else 'word' end finest_cut from big left join most using (work_id)
"""
#: Queries that list what breaks a rule: nothing may.
NOTHING = "select 0::bigint doc_id, '' problem where false"
ORACLE = {
    "p1_found": P1, "p1_scores": P1_SCORES, "p2_found": P2, "p2_counts": P2_COUNTS, "p3_found": P3, "p3_broken": NOTHING, "p4_found": P4, "p5_found": P5, "p5_broken": NOTHING,
    "p7_found": P7, "p7_broken": NOTHING, "p8_found": P8, "p8_copies": P8_COPIES, "p8_report": P8_REPORT,
}
