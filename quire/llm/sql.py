"""SQL, for DuckDB, of the operators that SQL can express.

Without SQL: op2 (the choice of copies follows a hash), op4 and op9 (tokenizers), op6 (a fitted model); the tests hold those against
brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

NGRAM_JOIN = r"""
with recursive words as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') w from documents),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) s from words),
nodes as (
  select md5(array_to_string(s, '|')) node, s, min(doc_id) least, count(*) n_equal from sets where len(s) > 0 group by all),
shingles as (select node, len(s) n, unnest(s) g from nodes),
pairs as (
  select a.node a, b.node b from shingles a join shingles b on a.g = b.g and a.node < b.node
  group by a.node, b.node, a.n, b.n having count(*) * 1.0 / (a.n + b.n - count(*)) >= 0.8),
links as (select a u, b v from pairs union select b, a from pairs),
reach as (select node u, node v from nodes union select r.u, l.v from reach r join links l on r.v = l.u),
named as (select r.u node, min(n.least) class_id from reach r join nodes n on n.node = r.v group by r.u),
counted as (select u node, count(*) n_links from links group by u)
select d.doc_id, coalesce(c.class_id, d.doc_id) class_id, cast(coalesce(k.n_links, 0) as bigint) n_links, cast(coalesce(n.n_equal, 1) as bigint) n_equal
from sets d left join nodes n on md5(array_to_string(d.s, '|')) = n.node and len(d.s) > 0
left join named c on c.node = n.node left join counted k on k.node = n.node
"""

URL_FILTER = r"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else null end tail from pages),
split as (
  select page_id, coalesce(translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') path from parts),
rules(h, p, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select page_id, h || p as rule, r.verdict, row_number() over (partition by page_id order by length(h || p) desc) k
  from split s join rules r on (s.host = r.h or ends_with(s.host, '.' || r.h)) and starts_with(s.path, r.p))
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') verdict from split s left join fits f on f.page_id = s.page_id and f.k = 1
"""

EXACT_DEDUP = r"""
with rows as (
  select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) s from documents),
ranked as (
  select *, first_value(doc_id) over (partition by s order by n desc, doc_id) keep_id, count(*) over (partition by s) group_size,
    row_number() over (partition by s order by n desc, doc_id) k from rows)
select doc_id, keep_id, group_size, k = 1 as kept, s as text_sha256 from ranked
"""

SECRETS = r"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
raw as (
  select rid, t, 0 as ord, 'assign' as kind, 8 as least, regexp_extract_all(t, $$(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$$) m,
    regexp_extract_all(t, $$(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$$, 1) g,
    string_split_regex(t, $$(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$$) b from d
  union all select rid, t, 1, 'access', 16, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') from d
  union all select rid, t, 2, 'hex', 32, regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), string_split_regex(t, '[0-9a-f]{32,}') from d),
each as (select rid, ord, kind, least, unnest(m) m, unnest(g) g, unnest(b[1:len(m)]) b, unnest(range(len(m))) i from raw where len(m) > 0),
placed as (
  select *, cast(sum(length(b)) over w + sum(length(m)) over w - length(m) as bigint) s from each
  window w as (partition by rid, ord order by i rows unbounded preceding)),
kept as (select rid, ord, kind, s, s + length(m) e from placed where length(g) >= least),
found as (
  select rid, count(*) filter (where ord = 0) n_assign, count(*) filter (where ord = 1) n_access, count(*) filter (where ord = 2) n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) spans from kept group by rid)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans
from d left join found using (rid)
"""

TOPK = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

CHAT_FORMAT = r"""
with held as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text)),
escaped as (
  select *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'),
    '[/INST]', '[\/INST]'), '<|image|>', '<\|image|>'), '<|audio|>', '<\|audio|>'), '<|document|>', '<\|document|>') t from held)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
  cast(sum(length(t) + length(role) + 8 + case when role = 'user' then 15 else 0 end) as bigint) formatted_chars,
  cast(0 as bigint) expanded_tokens
from escaped group by conv_id
"""

#: CRC-32 of short texts of code points below 2048, which DuckDB has no function for: a table of 256 steps, made by its rule, over UTF-8 bytes.
CRC = r"""crc(steps) as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))),
bytes(x, b) as (
  select x, flatten(list_transform(regexp_extract_all(x, '(?s).'), lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)]
    else [192 | (cast(unicode(c) as bigint) >> 6), 128 | (cast(unicode(c) as bigint) & 63)] end)) from texts),
hashed(x, h) as (
  select x, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda c, y: xor(c >> 8, steps[(xor(c, y) & 255) + 1])), 4294967295) from bytes, crc)"""

SPELLING_VARIANTS = rf"""
with recursive runs as (
  select coalesce(cast(doc_id as varchar), '') || ':' || run as x, run from (
    select doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) run from documents)
  where length(run) >= 7),
texts as (select distinct x from runs),
{CRC},
slipped as (
  select case when h % 31 = 0 then substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) else run end as word from runs join hashed using (x)),
words as (select word, count(*) n from slipped where length(word) >= 7 group by word having count(*) >= 2),
less as (select word, n, unnest(range(length(word))) i from words),
cuts as (select word, n, i, substring(word, 1, i) || substring(word, i + 2) as rest from less),
pairs as (
  select a.word, b.word other, b.n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cuts c join words w on c.rest = w.word),
near as (select word, count(*) n_near, arg_min(other, row(-n, encode(other))) best, max(n) best_n from pairs group by word),
told as (
  select w.word, w.n, coalesce(n_near, 0) n_near, case when best_n >= 10 * w.n then best end form, case when best_n >= 10 * w.n then best_n end form_n
  from words w left join near using (word)),
ways as (select word, word root, 0 step from told union all select ways.word, told.form, step + 1 from ways join told on ways.root = told.word where told.form is not null),
ends as (select word, arg_max(root, step) root from ways group by word)
select word, form, root, cast(n as bigint) n, cast(n_near as bigint) n_near, cast(form_n as bigint) form_n from told join ends using (word)
"""

_FIELDS = "concat({})".format(", ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")))

MERKLE_MANIFEST = rf"""
with recursive rows as (select row_number() over () rid, * from documents),
texts as (select distinct cast(doc_id as varchar) x from documents where doc_id is not null),
{CRC},
leaves as (
  select rid, doc_id, lang, sha256({_FIELDS.format(text='text')}) leaf, coalesce(h % 3 = 0, false) tampered,
    sha256({_FIELDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) lowered
  from rows left join hashed on x = cast(doc_id as varchar)),
placed as (
  select *, coalesce('=' || lang, '') tree, row_number() over (partition by lang order by doc_id nulls first, leaf, rid) - 1 pos, count(*) over (partition by lang) n from leaves),
nodes(tree, level, pos, n, digest) as (
  select tree, 0, pos, n, leaf from placed
  union all select tree, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by tree, level, pos // 8),
subroots as (select tree, level height, digest, row_number() over (order by encode(tree)) - 1 place, count(*) over () trees from nodes where n = 1),
top(level, pos, n, digest) as (
  select 0, place, trees, digest from subroots
  union all select level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by pos)) from top where n > 1 group by level, pos // 8),
way as (
  select p.rid, m.level k, m.pos // 8 family, m.pos own, p.tree from placed p join nodes m on m.tree = p.tree and m.n > 1 and m.pos = p.pos // cast(pow(8, m.level) as bigint)),
below as (
  select w.rid, w.k, coalesce(string_agg(m.digest, '' order by m.pos) filter (where m.pos < w.own), '') front, coalesce(string_agg(m.digest, '' order by m.pos) filter (where m.pos > w.own), '') rear
  from way w join nodes m on m.tree = w.tree and m.level = w.k and m.pos // 8 = w.family group by w.rid, w.k),
over_trees as (
  select s.tree, s.height + t.level k, coalesce(string_agg(m.digest, '' order by m.pos) filter (where m.pos < t.pos), '') front, coalesce(string_agg(m.digest, '' order by m.pos) filter (where m.pos > t.pos), '') rear
  from subroots s join top t on t.n > 1 and t.pos = s.place // cast(pow(8, t.level) as bigint) join top m on m.level = t.level and m.pos // 8 = t.pos // 8 group by s.tree, s.height, t.level, t.pos),
steps as (select * from below union all select p.rid, o.k, o.front, o.rear from placed p join over_trees o using (tree)),
paths as (select rid, list(front || '|' || rear order by k) path, string_agg(front || rear, '' order by k) siblings from steps group by rid)
select doc_id, leaf, s.digest subroot, r.digest root, sha256(coalesce(siblings, '')) proof_sha256,
  list_reduce(list_prepend(case when tampered then lowered else leaf end, coalesce(path, [])), lambda d, x: sha256(concat(split_part(x, '|', 1), d, split_part(x, '|', 2)))) folded_root, folded_root = r.digest verified
from placed join subroots s using (tree) left join paths using (rid) cross join (select digest from top where n = 1) r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": NGRAM_JOIN, "op3_url_filter": URL_FILTER, "op5_exact_dedup": EXACT_DEDUP, "op7_secret_scan": SECRETS, "op8_exact_topk": TOPK, "op10_chat_format": CHAT_FORMAT, "op11_spelling_variants": SPELLING_VARIANTS, "op12_merkle_manifest": MERKLE_MANIFEST}
