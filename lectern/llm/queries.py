"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .alignment import op12_pair_alignment
from .exact import op13_exact_dedup
from .fertility import op2_tokeniser_fertility
from .importance import op11_importance_resampling
from .langid import op3_word_first_backoff
from .near_dup import op7_fast_sketch_dedup
from .patience import op1_patience_licenses
from .pii import op6_feistel_pseudonyms
from .pieces import op4_nbest_pieces
from .rlz import op10_relative_lz
from .templates import op5_template_windows
from .warc import op9_warc_derivatives
from .zstd_quality import op8_zstd_dictionaries

QUERIES = {f.__name__: f for f in (
    op1_patience_licenses, op2_tokeniser_fertility, op3_word_first_backoff, op4_nbest_pieces, op5_template_windows,
    op6_feistel_pseudonyms, op7_fast_sketch_dedup, op8_zstd_dictionaries,
    op9_warc_derivatives, op10_relative_lz, op11_importance_resampling, op12_pair_alignment, op13_exact_dedup,
)}
# Words of each row, and of rows with words in lower case.
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES: dict[str, str] = {
    "op7_fast_sketch_dedup": f"""
with recursive t as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from t where len(w) > 0),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g from p),
n as (select doc_id, count(*) as k from s group by 1),
c as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c.k >= 85 * (x.k + y.k - c.k)),
e as (select u, v from l union all select v, u from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.v from r join e on r.b = e.u)
select d.doc_id, cast(coalesce(n.k, 0) as bigint) as n_shingles, m.b as component_id, d.doc_id = m.b as kept from documents d left join n using (doc_id) join (select a, min(b) as b from r group by 1) m on m.a = d.doc_id""",
    "op10_relative_lz": f"""
with t as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from t where len(w) >= 13),
g as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as k from p),
f as (select k, min(doc_id) as first from g group by 1),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from g join f using (k) where doc_id > first),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from t),
k as (select doc_id, count(gone.i) as n, string_agg(word, ' ' order by x.i) filter (gone.i is null) as kept from x left join gone using (doc_id, i) group by 1)
select t.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join k using (doc_id)""",
    # crc32 by its table, for each different word once
    "op11_importance_resampling": f"""
with t as (select doc_id, {_FEATURES} as w from documents),
b as (select {_FEATURES} as w from benchmark),
c as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as step),
d as (select distinct w, hex(encode(w)) as x from (select unnest(w) as w from t union all select unnest(w) as w from b)),
h as (select w, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, length(x), 2), lambda i: cast('0x' || substr(x, i, 2) as bigint))),
  lambda a, y: xor(a >> 8, step[(xor(a, y) & 255) + 1])), cast(4294967295 as bigint)) % 10000 as bucket from d, c),
f as (select doc_id, bucket from (select doc_id, unnest(w) as w from t) join h using (w)),
s as (select bucket, count(*) as n from f group by 1),
k as (select bucket, count(*) as n from (select unnest(w) as w from b) join h using (w) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(k.n, 0) + 1)::double * ((select sum(n) from s)::double + 10000) / ((s.n + 1)::double * ((select coalesce(sum(n), 0) from k)::double + 10000)))) as gain from s left join k using (bucket)),
x as (select doc_id, cast(sum(gain) as bigint) as weight from f join g using (bucket) group by 1),
r as (select doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score from t left join x using (doc_id)),
o as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from r where n_features >= 20)
select r.*, case when place <= 10 * n // 100 then place end as rank from r left join o using (doc_id)""",
    "op13_exact_dedup": """
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as n from documents)
select doc_id, min(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
row_number() over (partition by n order by doc_id) = 1 as kept, sha256(n) as text_sha256 from t""",
}
