"""SQL, for DuckDB, that says independently what each query of the passage engine returns."""

from __future__ import annotations

from quire.functions import text as T
from quire.sources import corpus

ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنهويآأ"
LATIN = "abcdefghijklmnopqrstuvwxyz"


def fold(x: str) -> str:
    drop = f"[{T.ZERO_WIDTH}{T.MARKS}{T.TATWEEL}]"
    return f"trim(regexp_replace(translate(regexp_replace(nfc_normalize({x}), '{drop}', '', 'g'), '{T.FOLD_FROM}{T.DIGITS_FROM}', '{T.FOLD_TO}{T.DIGITS_TO}'), '[{T.SPACES}]+', ' ', 'g'))"


def tokens(folded: str) -> str:
    return rf"list_transform(regexp_extract_all({folded}, '[\p{{L}}\p{{N}}]+'), lambda t: case when t = '{T.IBN}' then '{T.BN}' else t end)"


PAGES, BOOKS, TOC = (corpus.duck(x) for x in (corpus.PLACED, corpus.BOOKS, corpus.TOC))
TOK = f"tok as (select doc, book_id, page_id, terms, len(terms) dl from (select *, {tokens(fold('body'))} terms from {PAGES} p) q)"
LIST = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def tf(term: str) -> str:
    return f"len(list_filter(terms, lambda t: t = '{term}'))"


def pf(terms: list[str]) -> str:
    shifted = ", ".join(["terms", *(f"terms[{k + 1}:]" for k in range(1, len(terms)))])
    same = " and ".join(f"x[{k + 1}] = '{t}'" for k, t in enumerate(terms))
    return f"len(list_filter(list_zip({shifted}), lambda x: {same}))"


def hits(terms: list[str], mode: str, scope: str = "true") -> str:
    """CTEs that end in hits(doc, book_id, page_id, score)."""
    distinct = list(dict.fromkeys(terms))
    counts = ", ".join(f"{tf(t)} c{i}" for i, t in enumerate(distinct))
    stats = ", ".join(f"count(*) filter (where c{i} > 0) d{i}" for i in range(len(distinct)))
    idf = lambda t: f"ln(1 + (n - d{distinct.index(t)} + 0.5) / (d{distinct.index(t)} + 0.5))"
    norm = "(1.2 * (1 - 0.75 + 0.75 * dl / (total / n)))"
    if mode == "phrase" and len(terms) > 1:
        where, score = "pf > 0", f"({' + '.join(idf(t) for t in terms)}) * pf / (pf + {norm})"
    else:
        join = " or " if mode == "any_terms" else " and "
        where = join.join(f"c{i} > 0" for i in range(len(distinct)))
        score = " + ".join(f"{idf(t)} * c{distinct.index(t)} / (c{distinct.index(t)} + {norm})" for t in terms)
    return f"""{TOK},
counted as (select doc, book_id, page_id, cast(dl as double) dl, {counts}, {pf(terms) if mode == 'phrase' else '0'} pf from tok),
stats as (select cast(count(*) as double) n, cast(sum(dl) as double) total, {stats} from counted),
hits as (select doc, book_id, page_id, round({score}, 9) score from counted, stats where ({where}) and ({scope}))"""


def _hinted(column: str, hints: dict[str, list[str]]) -> str:
    cases = []
    for school, needles in hints.items():
        some = " or ".join(f"contains({column}, '{T.fold_py(n)}')" for n in needles)
        cases.append(f"case when {some} then '{school}' end")
    return f"list_filter([{', '.join(cases)}], lambda s: s is not null)"


def classified(rules: list[dict], hints: dict[str, list[str]], overrides: dict[str, str] | None = None, exclude: list[str] = ()) -> str:
    """CTEs that end in cb: books with school, source, status, reasons (a list), rule."""
    matches = []
    for k, r in enumerate(rules):
        for p in r["patterns"]:
            test = f"c = '{T.fold_py(p)}'" if r["match_type"] == "equals" else f"contains(c, '{T.fold_py(p)}')"
            matches.append(f"select book_id, {k} k, '{r['id']}' id, '{r['school']}' school, {2 if r['match_type'] == 'equals' else 1} strength, {str(r['reviewed']).lower()} reviewed from fb where c <> '' and {test}")
    held = " union all ".join(f"select '{b}' book_id, '{s}' forced" for b, s in (overrides or {}).items()) or "select '' book_id, '' forced where false"
    out = ", ".join(f"'{x}'" for x in exclude) or "''"
    return f"""fb as (select *, {fold("coalesce(category, '')")} c, {_hinted(fold("coalesce(title, '')"), hints)} th, {_hinted(fold("coalesce(author, '')"), hints)} ah from {BOOKS} b where book_id not in ({out})),
m as ({' union '.join(matches)}),
top as (select m.* from m join (select book_id, max(strength) s from m group by book_id) x on m.book_id = x.book_id and m.strength = x.s),
agg as (select book_id, list_sort(list(distinct school)) schools, arg_min(id, k) id, arg_min(school, k) school, arg_min(reviewed, k) reviewed, max(strength) strength from top group by book_id),
forced as ({held}),
j as (select fb.*, agg.schools, agg.id, agg.school as ruled, agg.reviewed, agg.strength, forced.forced from fb left join agg using (book_id) left join forced using (book_id)),
r as (select *, list_distinct(case when forced is not null then [] when len(schools) > 1 then list_concat(['conflicting_category_rules'], list_transform(schools, lambda s: 'candidate:' || s))
  when len(schools) = 1 then list_concat(list_transform(list_filter(th, lambda s: s <> ruled), lambda s: 'title_hint_conflicts:' || s), list_concat(list_transform(list_filter(ah, lambda s: s <> ruled), lambda s: 'author_hint_conflicts:' || s), case when strength = 1 then ['partial_category_match:' || id] else [] end))
  else list_concat(list_transform(th, lambda s: 'title_hint_only:' || s), list_concat(list_transform(ah, lambda s: 'author_hint_only:' || s), list_concat(case when len(list_distinct(list_concat(th, ah))) > 1 then ['conflicting_hints'] else [] end, case when coalesce(category, '') = '' then ['no_category_in_catalogue'] else ['category_not_in_map'] end))) end) as reasons from j),
cb as (select book_id, title, author, category_id, category, downloaded, file_path, reasons,
  case when forced is not null then forced when len(schools) = 1 then ruled else 'unclassified' end as school,
  case when forced is not null then 'override' when len(schools) = 1 then 'category_map' else 'unclassified' end as classification_source,
  case when forced is not null then 'verified' when len(schools) > 1 then 'needs_review' when len(schools) = 1 then case when len(reasons) > 0 then 'needs_review' when reviewed then 'verified' else 'unverified' end
    when len(list_filter(reasons, lambda x: contains(x, 'hint'))) > 0 then 'needs_review' else 'unverified' end as verification_status,
  case when forced is null and len(schools) = 1 then id end as matched_rule from r)"""


def joined_reasons() -> str:
    # list_distinct doesn't keep order, so reasons are compared sorted
    return "array_to_string(list_sort(reasons), ',')"


SCHOOL_ROWS = "(values ('hanafi', 0), ('maliki', 1), ('shafii', 2), ('hanbali', 3), ('comparative', 4), ('unclassified', 5)) s(school, ord)"

TRAILS = f"""h as (select *, row_number() over (partition by book_id order by page_id, title_id) k from {TOC} t),
spans as (select a.*, (select min(b.k) from h b where b.book_id = a.book_id and b.k > a.k and b.level <= a.level) nk from h a),
held as (select a.book_id, a.page_id, a.title_id, a.level, a.title, b.page_id as until from spans a left join h b on b.book_id = a.book_id and b.k = a.nk)"""
