"""DuckDB twins of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from pageloom.llm import licenses, url_filter

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _op4() -> str:
    columns, names = [], []
    for k, t in enumerate(licenses.TEMPLATES):
        at, n = t.key
        phrase = " and ".join(f"w[i + {j + 1}] = '{t.words[at + j]}'" for j in range(n))
        starts = f"list_transform(list_filter(range(0, greatest(len(w) - {n - 1}, 0)), lambda i: {phrase}), lambda i: i - {at})"
        share = " + ".join(f"case when s + {j} >= 0 and s + {j} < len(w) and w[s + {j + 1}] = '{word}' then 1 else 0 end" for j, word in enumerate(t.words))
        columns.append(f"list_filter(list_transform({starts}, lambda s: {{'s': s, 'share': ({share}) / {float(len(t.words))}::double}}), lambda x: x.share >= {t.least}) as t{k}")
        names.append(f"case when len(t{k}) > 0 then '{t.label}' end")
    base = [k for k, t in enumerate(licenses.TEMPLATES) if t.base]
    listed = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x is not null))), ',')"
    places = f"flatten([{', '.join(f'list_transform(t{k}, lambda x: x.s)' for k in base)}])"
    shares = f"flatten([{', '.join(f'list_transform(t{k}, lambda x: x.share)' for k in range(len(names)))}])"
    return (
        f"with d as (select doc_id, {_WORDS} as w from documents), t as (select doc_id, w, {', '.join(columns)} from d), p as (select *, {places} as p, {shares} as sh from t) "
        "select doc_id, cast(len(w) as bigint) as n_words, cast(len(p) as bigint) as n_base, cast(list_min(p) as bigint) as first_word, cast(list_max(p) as bigint) as last_word, "
        f"{listed.format(', '.join(names[k] for k in base))} as base_labels, {listed.format(', '.join(names))} as labels, coalesce(list_max(sh), 0.0)::double as score from p"
    )


def _op5() -> str:
    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')"

    rules = [(r.name.split("/", 1), r) for r in sorted(url_filter.LISTED, key=lambda r: -r.size)]
    cases = " ".join(f"when {fits(*name)} then '{r.name}'" for name, r in rules)
    verdicts = " ".join(f"when '{r.name}' then '{r.verdict}'" for _, r in rules)
    own = " ".join(f"when regexp_matches(host || path, '{r.pattern.replace(chr(92) + '-', '-')}') then '{r.name}'" for r in sorted(url_filter.SPAM_HOSTS, key=lambda r: r.name))
    return (
        "with s as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages), "
        "h as (select page_id, regexp_extract(rest, '^[^/?#]*') as h, rest from s), "
        "p as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from h), "
        f"r as (select *, case {cases} end as rule, case {own} end as own_rule from p) "
        f"select page_id, host, path, rule, case when rule is not null then case rule {verdicts} end when own_rule is not null then 'block' else 'allow' end as verdict, own_rule from r"
    )


SQL: dict[str, str] = {
    "op2_topk": "with v as (select row_number() over () as r, vec_id, list_transform(embedding::double[], lambda x: floor(256 * x)) as v from embeddings where vec_id is not null and list_aggregate(list_transform(embedding::double[], lambda x: x is not null and isfinite(x)), 'bool_and')), "
    "s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on q.r <> c.r where q.vec_id % 50 = 0), "
    "o as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) select query_id, cast(rank as int) as rank, vec_id, score from o where rank <= 5",
    "op3_substring_dedup": r"with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents), "
    "s as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as s from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from d where len(w) >= 13)), "
    "f as (select s, min(doc_id) as first from s group by s), "
    "g as (select distinct doc_id, unnest(generate_series(i, i + 12)) as i from s join f using (s) where first < doc_id), "
    "w as (select doc_id, generate_subscripts(w, 1) as i, unnest(w) as x from d), "
    "k as (select w.doc_id, count(g.i) as n, string_agg(x, ' ' order by w.i) filter (g.i is null) as kept from w left join g on w.doc_id = g.doc_id and w.i = g.i group by 1) "
    "select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)",
    "op4_license_scan": _op4(),
    "op5_url_filter": _op5(),
    "op10_decontamination": f"with b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark), "
    "bw as (select distinct item, least(len(w), 10) as m, array_to_string(list_slice(w, i, i + 9), ' ') as s from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)), "
    f"d as (select doc_id, {_WORDS} as w from documents), ms as (select distinct m from bw), "
    "dw as (select doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') as s from (select doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from d, ms where len(w) >= m)), "
    "h as (select doc_id, dw.m, i, item from dw join bw on dw.s = bw.s and dw.m = bw.m), "
    "c as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + m - 1)) as p from h) group by 1), "
    "t as (select doc_id, count(distinct item) as k, string_agg(distinct item, ',' order by item) as ids from h group by 1) "
    "select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_hit, coalesce(k, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n is not null as contaminated from d left join c using (doc_id) left join t using (doc_id)",
}
