"""DuckDB statements for the operators whose results SQL can express: every round is a table of its own."""

from wavegrade.llm import grid_codes, suffix_dedup, table_means

_floor_mean = "cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint)"
_finite = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
_distance = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _clusters() -> str:
    c = table_means
    steps = [
        f"v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor({c.SCALE} * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = {c.LENGTH} and {_finite})",
        f"c0 as materialized (select row_number() over (order by h) - 1 as k, v from (select sha256('{c.SALT}' || vec_id) as h, v from v order by h limit {c.CENTROIDS}) q)",
    ]
    for i in range(c.ROUNDS + 1):
        steps.append(f"a{i} as materialized (select vec_id, any_value(v) as v, arg_min(k, d * {c.CENTROIDS} + k) as k, min(d) as d from (select a.vec_id, a.v, b.k, {_distance} as d from v a, c{i} b) q group by vec_id)")
        if i < c.ROUNDS:
            steps.append(f"c{i + 1} as materialized (select c.k, coalesce(m.v, c.v) as v from c{i} c left join (select k, list(x order by d) as v from (select k, d, {_floor_mean} as x from (select k, unnest(v) as x, generate_subscripts(v, 1) as d from a{i}) e group by k, d) s group by k) m on m.k = c.k)")
    n = c.ROUNDS
    return "with " + ",\n".join(steps) + f"\nselect a.vec_id, cast(a.k as int) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.k) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{n} a join c{n} c on c.k = a.k"


def _codes() -> str:
    c = grid_codes
    steps = [
        f"w as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor({c.SCALE} * cast(x as double)) as bigint)) as v from embeddings where {_finite})",
        f"v as materialized (select vec_id, label, p, list_slice(v, p * len(v) // {c.PARTS} + 1, (p + 1) * len(v) // {c.PARTS}) as v from w, range({c.PARTS}) r(p))",
        f"c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as k, v from v where vec_id in (select vec_id from w order by vec_id limit {c.ENTRIES}))",
    ]
    for i in range(c.ROUNDS + 1):
        steps.append(f"a{i} as materialized (select vec_id, p, any_value(label) as label, any_value(v) as v, arg_min(k, d * {c.ENTRIES} + k) as k, min(d) as d from (select a.vec_id, a.label, a.p, a.v, b.k, {_distance} as d from v a join c{i} b on b.p = a.p) q group by vec_id, p)")
        if i < c.ROUNDS:
            steps.append(f"c{i + 1} as materialized (select c.p, c.k, coalesce(m.v, c.v) as v from c{i} c left join (select p, k, list(x order by d) as v from (select p, k, d, {_floor_mean} as x from (select p, k, unnest(v) as x, generate_subscripts(v, 1) as d from a{i}) e group by p, k, d) s group by p, k) m on m.p = c.p and m.k = c.k)")
    n = c.ROUNDS
    return "with " + ",\n".join(steps) + f",\nr as materialized (select vec_id, any_value(label) as label, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' order by p) as code, cast(sum(d) as bigint) as error from a{n} group by vec_id)\nselect vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, k)) from c{n}) as codebooks_sha256 from r"


def _repeats() -> str:
    w = suffix_dedup.WIDTH
    return f"""with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
e as materialized (select doc_id, b, substr(h, 2 * b + 1, {2 * (500 + w - 1)}) as part from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - {w - 1}, 0), 500)) as b from d) q),
s as materialized (select doc_id, b, i, hash(substr(part, 2 * i + 1, {2 * w})) as c from (select doc_id, b, part, unnest(range(len(part) // 2 - {w - 1})) as i from e) q),
t as materialized (select s.doc_id, s.b + s.i as i, substr(e.part, 2 * s.i + 1, {2 * w}) as t from s join (select c from s group by c having min(doc_id) < max(doc_id)) m on m.c = s.c join e on e.doc_id = s.doc_id and e.b = s.b),
f as materialized (select t.doc_id, t.i from t join (select t, min(doc_id) as least from t group by t) m on m.t = t.t where least < t.doc_id),
g as (select doc_id, i, sum(case when before is null or i > before + {w} then 1 else 0 end) over (partition by doc_id order by i) as span from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from f) q),
p as materialized (select doc_id, span, min(i) as a, max(i) + {w} as b from g group by doc_id, span),
k as (select p.doc_id, p.a, substr(d.h, 2 * coalesce(lag(p.b) over (partition by p.doc_id order by p.a), 0) + 1, 2 * (p.a - coalesce(lag(p.b) over (partition by p.doc_id order by p.a), 0))) as part from p join d on d.doc_id = p.doc_id
  union all select d.doc_id, 1000000000000, substr(d.h, 2 * coalesce(m.b, 0) + 1) from d left join (select doc_id, max(b) as b from p group by doc_id) m on m.doc_id = d.doc_id)
select d.doc_id, cast(len(d.h) // 2 as bigint) as n_bytes, cast(coalesce(n.removed, 0) as bigint) as n_removed, cast(coalesce(n.spans, 0) as bigint) as n_spans, sha256(unhex(x.kept)) as kept_sha256
from d join (select doc_id, string_agg(part, '' order by a) as kept from k group by doc_id) x on x.doc_id = d.doc_id
left join (select doc_id, sum(b - a) as removed, count(*) as spans from p group by doc_id) n on n.doc_id = d.doc_id"""


SQL = {"op11_vector_codes": _codes(), "op12_centroid_clustering": _clusters(), "op13_suffix_dedup": _repeats()}
