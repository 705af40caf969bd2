"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES = {
    "op7_loser_tree": """
        with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
        k as (select d, max(page_id) as keep from p group by 1)
        select page_id, strlen(h)::bigint as payload_bytes,
            list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(p.d, (5 * g + 1)::int, 5))::bigint >> s) & 31) + 1)::int, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
            case when page_id = keep then 'response' else 'revisit' end as record_type, case when page_id <> keep then keep end as refers_to
        from p join k using (d)""",
    "op8_multi_index": """
        with recursive e as (select vec_id, label, embedding::double[] as v from embeddings),
        l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.93),
        reach(node, m) as (select vec_id, vec_id from e union select l.a, reach.m from reach join l on l.b = reach.node),
        c as (select node, min(m) as component_id from reach group by 1)
        select vec_id, (select count(*) from l where a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept from e join c on node = vec_id""",
    "op10_poisson_mix": """
        with s as (select source, count(*) as n from documents group by 1),
        t as (select sum(n) as n, sum(sqrt(n)) as w from s),
        r as (select source, sqrt(s.n) * t.n / t.w / s.n as rate from s, t),
        k as (select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as cdf from r, (select unnest(range(0, 300)) as k)),
        u as (select doc_id, source, text, md5(coalesce(text, '')) as d, ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '~') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint / 4503599627370496.0 as u from documents),
        c as (select doc_id, u.source, text, d, count(*) filter (cdf <= u)::int as n_copies from u join k on u.source is not distinct from k.source group by all),
        x as (select *, unnest(range(0, n_copies))::int as replica from c)
        select doc_id, source, text, n_copies, replica, ('0x' || substr(md5('8:' || coalesce(doc_id::varchar, '~') || ':' || d || ':' || replica), 1, 13))::bigint / 4503599627370496.0 as shuffle_key from x""",
}
