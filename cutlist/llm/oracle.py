"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

MIXING = r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(text, '')) as digest
  from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
numbered as (
  select *, row_number() over (order by source is null, encode(source)) - 1 as n from sizes),
weighed as (
  select *, (n % 3 + 1)::double as w, source_size * 3.0::double as cap, source_size * 3.0::double / (n % 3 + 1) as ratio
  from numbered),
levels as (
  select *, ((select sum(source_size) from sizes)::double - (sum(cap) over upto - cap))
    / (sum(w) over () - sum(w) over upto + w) as level
  from weighed window upto as (order by ratio, n rows between unbounded preceding and current row)),
level as (select level from levels where level <= ratio order by ratio, n limit 1),
targets as (select source, source_size, least(cap, (select level from level) * w) as target from levels),
parts as (
  select *, least(floor(case when source_size > 0 then target / source_size else 0 end + 1e-12), 3)::bigint as whole
  from targets),
rests as (select *, greatest(target - whole * source_size, 0) as remainder from parts),
counted as (select source, size, count(*) as documents from docs where size > 0 group by source, size),
scaled as (
  select c.source, c.size, (r.remainder - (sum(c.size * documents) over upto - c.size * documents))
    / (sum(sqrt(c.size) * documents) over (partition by c.source)
      - sum(sqrt(c.size) * documents) over upto + sqrt(c.size) * documents) as k
  from counted c join rests r on c.source is not distinct from r.source
  window upto as (partition by c.source order by c.size rows between unbounded preceding and current row)),
scales as (select source, min_by(k, size) as scale from scaled where k <= sqrt(size) group by source),
chances as (
  select d.*, r.source_size, r.target, r.whole, r.remainder,
    least(1.0, coalesce(s.scale / sqrt(d.size), 1.0)) as p,
    (('0x' || substr(md5('7:' || coalesce(d.doc_id::varchar, '') || ':' || digest), 1, 13))::bigint::double + 0.5)
      / 4503599627370496.0 as u
  from docs d join rests r on d.source is not distinct from r.source
  left join scales s on d.source is not distinct from s.source),
ranked as (
  select *, case when p >= 1 then 0 when p <= 0 then 'infinity'::double else u / (1 - u) * (1 - p) / p end as rank
  from chances),
running as (
  select *, sum(size) over (partition by source, size > 0 order by rank, doc_id, size, digest
    rows between unbounded preceding and current row) as upto
  from ranked),
decided as (
  select *, case
    when size = 0 then 0
    else least(whole + case when remainder > 0 and upto - size < remainder
      and (upto < remainder or upto - remainder <= remainder - (upto - size)) then 1 else 0 end, 3) end as copies
  from running)
select doc_id, size, source_size, round(target, 6) as target, (copies * size)::bigint as taken, source,
  copies::bigint as copies
from decided
"""

TOP_K = """
with whole as (
  select vec_id, row_number() over () as n, [floor(64 * x::double) for x in embedding] as v
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x::double)]) = 0),
scored as (
  select q.n, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score,
    row_number() over (partition by q.n order by list_inner_product(q.v, c.v) desc, c.vec_id, c.n) as rank
  from whole q join whole c on q.n <> c.n and len(q.v) = len(c.v)
  where q.vec_id % 20 = 0)
select query_id, rank::integer as rank, vec_id, score from scored where rank <= 20
"""

ORACLE: dict[str, str] = {
    "op9_histogram_topk": TOP_K,
    "op7_pareto_mixing": MIXING,
}
