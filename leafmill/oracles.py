"""SQL of the core's queries, for an independent engine (RE2 patterns, ``lambda x:``)."""

from __future__ import annotations

from .plans.request import BOUNDS

# The rules' patterns, written for this engine, where \s, \S and \d of Unicode are classes.
WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
INK = r"[^\s\x1c-\x1f\x{85}\p{Z}]"
LEVELS = [
    rf"^第[一二三四五六七八九十百\p{{Nd}}]+节{WS}*{INK}+",
    rf"^[一二三四五六七八九十]+[、.．]{WS}*{INK}+",
    rf"^[（(][一二三四五六七八九十]+[）)]{WS}*{INK}+",
    rf"^\p{{Nd}}+[、.．]{WS}*{INK}+",
    rf"^[（(]\p{{Nd}}+[）)]{WS}*{INK}+",
]
PAGE_NUMBER = rf"^(第)?\p{{Nd}}+(页)?(/\p{{Nd}}+)?$"  # of texts without white space
CODE = rf"(?:股票|证券|A股){WS}*(?:代码|简称)?{WS}*[:：]?{WS}*([03668]\p{{Nd}}{{5}})"
UNIT_NOTES = ["单位[:：]", "币种[:：]", "金额单位", "货币单位", "人民币", f"元{WS}*$", f"万元{WS}*$", f"千元{WS}*$"]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    a = f"regexp_replace(coalesce({x}, ''), '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    return strip(f"regexp_replace({a}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def compact(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{WS}', '', 'g')"


def safe(x: str) -> str:
    inner = f"regexp_replace(coalesce({x}, ''), '[\\\\/:*?\"<>|]+', '_', 'g')"
    return f"coalesce(nullif(regexp_replace({inner}, '^[_ ]+|[_ ]+$', '', 'g'), ''), 'unknown')"


def company(x: str) -> str:
    stem = f"regexp_replace({x}, '\\.[^.]*$', '')"
    before = "^(.+?)(20\\p{Nd}{2}|年报|年度报告)"
    lazy = f"regexp_replace(regexp_extract({stem}, '{before}', 1), '^[_ -]+|[_ -]+$', '', 'g')"
    return f"CASE WHEN contains({stem}, '：') THEN {strip(f'split_part({stem}, chr(65306), 1)')} WHEN contains({stem}, ':') THEN {strip(f'split_part({stem}, chr(58), 1)')} WHEN regexp_matches({stem}, '{before}') THEN {lazy} ELSE {stem} END"


def level(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN {k + 1}" for k, p in enumerate(LEVELS)) + " ELSE 6 END"


def unit(x: str) -> str:
    any_of = " OR ".join(f"regexp_matches({norm(x)}, '{p}')" for p in UNIT_NOTES)
    return f"(length({norm(x)}) <= 120 AND ({any_of}))"


def short(x: str) -> str:
    t = norm(x)
    return f"({t} <> '' AND length({t}) <= 60 AND NOT contains({t}, '适用') AND NOT regexp_matches({t}, '[。；;，,]$') AND NOT (contains({t}, chr(10)) AND length({t}) > 35))"


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({norm(x)}, '[\\n\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda li: {strip('li')}), lambda li: li <> '')"


def columns(x: str) -> str:
    row = f"list_filter({lines(x)}, lambda li: starts_with(li, '|'))[1]"
    return f"coalesce(len(string_split(regexp_replace({row}, '^\\|+|\\|+$', '', 'g'), '|')), 0)"


def split_long(x: str, limit: int = 1000) -> str:
    """Parts of a text: at blank lines, sentence ends and line ends, packed greedily, then by length."""
    parts = f"[{norm(x)}]"
    for n, end in enumerate(("\\n\\n", "[。；;]", "\\n")):
        t = f"t{n}"
        pieces = f"string_split(regexp_replace({t}, '({end})', '\\1' || chr(1), 'g'), chr(1))"
        packed = f"list_reduce(list_transform({pieces}, lambda p{n}: [p{n}]), lambda a{n}, x{n}: CASE WHEN length(a{n}[-1]) + length(x{n}[1]) <= {limit} THEN list_append(a{n}[1:len(a{n}) - 1], a{n}[-1] || x{n}[1]) ELSE list_append(a{n}, x{n}[1]) END)"
        parts = f"flatten(list_transform({parts}, lambda {t}: CASE WHEN length({t}) <= {limit} THEN [{t}] ELSE list_filter(list_transform({packed}, lambda y{n}: {strip(f'y{n}')}), lambda y{n}: y{n} <> '') END))"
    sliced = f"flatten(list_transform({parts}, lambda t9: list_transform(range(0, greatest(length(t9), 1), {limit}), lambda i9: {strip(f'substr(t9, i9 + 1, {limit})')})))"
    return f"list_filter({sliced}, lambda y9: y9 <> '')"


def pages(a: str, b: str) -> str:
    a, b = f"coalesce({a}, 0)", f"coalesce({b}, 0)"
    return f"CASE WHEN {a} = 0 AND {b} = 0 THEN '-' WHEN {a} = {b} OR {b} = 0 THEN {a}::VARCHAR ELSE {a}::VARCHAR || '-' || {b}::VARCHAR END"


def grams(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    return f"list_concat(regexp_extract_all({t}, '[一-鿿]{{2}}|[a-z]+|[0-9]+'), regexp_extract_all(regexp_replace({t}, '(^|[^一-鿿])[一-鿿]', '\\1 ', 'g'), '[一-鿿]{{2}}'))"


def years(x: str) -> str:
    ends = f"(20\\p{{Nd}}{{2}}){WS}*年?{WS}*(?:到|至|~|～|-|—|－){WS}*(20\\p{{Nd}}{{2}}){WS}*年?"
    a, b = f"regexp_extract({x}, '{ends}', 1)", f"regexp_extract({x}, '{ends}', 2)"
    lo, hi = f"try_cast(least({a}, {b}) AS INT)", f"try_cast(greatest({a}, {b}) AS INT)"
    return f"CASE WHEN {a} <> '' AND {hi} - {lo} <= 10 THEN list_transform(range({lo}, {hi} + 1), lambda y: y::VARCHAR) ELSE list_sort(list_distinct(regexp_extract_all({x}, '20\\d{{2}}'))) END"


def doc(number: str | None = None) -> str:
    lines = [f"'公司：' || coalesce(company_name, '')", f"'股票代码：' || coalesce(stock_code, '')", f"'年份：' || coalesce(year, '')", f"'页码：' || {pages('page_start', 'page_end')}", f"'章节：' || coalesce(section, '')", f"'内容：' || coalesce(content, '')"]
    if number:
        lines.insert(0, f"'【' || {number} || '】'")
    return " || chr(10) || ".join(lines)


B = """b AS (SELECT report_no, k::BIGINT AS block_no, coalesce(blocks[k].content, '') AS content, lower(coalesce(blocks[k].meta.block_type, '')) AS kind,
  coalesce(blocks[k].meta.page, 0)::BIGINT AS page, coalesce(blocks[k].meta.section, '') AS section, coalesce(blocks[k].meta.stock_code, '') AS stock_code,
  coalesce(blocks[k].meta.company_name, '') AS company_name, coalesce(blocks[k].meta.year, '') AS year
  FROM (SELECT report_no, blocks, unnest(range(1, len(blocks) + 1)) AS k FROM parsed))"""
TOC = f"""{B}, pg AS (SELECT report_no, page, string_agg(content, chr(10) ORDER BY block_no) AS text FROM b GROUP BY 1, 2),
l AS (SELECT report_no, page, {norm('text')} AS text, {lines('text')} AS lines FROM pg),
n0 AS (SELECT *, len(list_filter(lines, lambda x: regexp_matches(x, '第[一二三四五六七八九十百\\p{{Nd}}]+节'))) AS sections, len(list_filter(lines, lambda x: regexp_matches(x, '\\.{{2,}}|…{{2,}}|·{{2,}}|{WS}{{3,}}\\p{{Nd}}+{WS}*$'))) AS dotted FROM l),
toc AS (SELECT report_no, page, sections, dotted, (contains(substr(text, 1, 200), '目录') AND (sections >= 2 OR dotted >= 3)) OR (sections >= 4 AND dotted >= 2) AS toc FROM n0)"""
CUR = """cur AS (SELECT chunk_id, seq, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) r FROM embedding_cache WHERE chunk_id IS NOT NULL AND chunk_id <> '') WHERE r = 1),
good AS (SELECT chunk_id, list_transform(e, lambda v: v::DOUBLE) AS v FROM cur WHERE len(e) = 64 AND len(list_filter(e, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(e, lambda v: v <> 0)) > 0),
unit AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vec FROM good)"""
ITEMS = CUR + """,
items AS (SELECT m.vector_id::BIGINT AS vector_id, m.chunk_id, m.content, m.meta.company_name AS company_name, m.meta.stock_code AS stock_code, m.meta.year AS year, m.meta.section AS section,
  m.meta.page_start AS page_start, m.meta.page_end AS page_end, u.vec FROM metadata m JOIN unit u USING (chunk_id))"""
TABLES = f"""{B}, t0 AS (SELECT *, {columns('content')} AS columns FROM b),
t1 AS (SELECT *, lag(kind) OVER w AS pk, lag(section) OVER w AS ps, lag(page) OVER w AS pp, lag(columns) OVER w AS pc FROM t0 WINDOW w AS (PARTITION BY report_no ORDER BY block_no)),
t2 AS (SELECT *, CASE WHEN pk = 'table' AND ps = section AND page = pp + 1 AND pc = columns AND columns > 0 THEN 0 ELSE 1 END AS head FROM t1 WHERE kind = 'table'),
runs AS (SELECT *, sum(head) OVER (PARTITION BY report_no ORDER BY block_no) AS run FROM t2)"""
SETTINGS = "st AS (SELECT question_id, " + ", ".join(f"greatest({a}, least({c}, coalesce({n}, {b}))) AS {n}" for n, (a, b, c) in BOUNDS.items()) + " FROM questions)"
FILTERS = ITEMS + f""",
{SETTINGS},
q AS (SELECT question_id, coalesce(question, '') AS question, stock_code AS qcode, year AS qyear, years AS qyears FROM questions),
names AS (SELECT company_name, arg_max(stock_code, vector_id) AS code, min(vector_id) AS seen FROM (SELECT vector_id, {strip("coalesce(company_name, '')")} AS company_name, {strip("coalesce(stock_code, '')")} AS stock_code FROM items) WHERE company_name <> '' AND stock_code <> '' GROUP BY 1),
hit AS (SELECT question_id, code, company_name FROM (SELECT question_id, code, company_name, row_number() OVER (PARTITION BY question_id ORDER BY length(company_name) DESC, seen) r FROM q JOIN names ON contains(question, company_name)) WHERE r = 1),
inf AS (SELECT q.*, regexp_extract(question, '(^|[^\\p{{L}}\\p{{N}}_])([0368]\\d{{5}})($|[^\\p{{L}}\\p{{N}}_])', 2) AS own, hit.code AS hcode, hit.company_name AS hname, {years('question')} AS named FROM q LEFT JOIN hit USING (question_id)),
pre AS (SELECT question_id, coalesce(nullif({strip('qcode')}, ''), nullif(own, ''), hcode) AS code, nullif({strip('qyear')}, '') AS oy, named,
  list_sort(list_distinct(list_filter(list_transform(coalesce(qyears, []), lambda x: {strip('x')}), lambda x: x <> ''))) AS oys FROM inf),
f AS (SELECT question_id, code, coalesce(oy, CASE WHEN len(named) = 1 AND len(oys) = 0 THEN named[1] END) AS year,
  CASE WHEN len(oys) > 0 THEN oys WHEN len(named) > 1 THEN named ELSE [] END AS years FROM pre),
s AS (SELECT *, coalesce(code, '') || '|' || coalesce(year, '') || '|' || array_to_string(years, ',') AS sig FROM f),
el AS (SELECT DISTINCT s.sig, i.vector_id FROM (SELECT DISTINCT sig, code, year, years FROM s) s JOIN items i ON (s.code IS NULL OR i.stock_code = s.code) AND (s.year IS NULL OR i.year = s.year) AND (len(s.years) = 0 OR list_contains(s.years, i.year)))"""
BM25 = FILTERS + f""",
tok AS (SELECT vector_id, {grams('content')} AS terms FROM items),
post AS (SELECT vector_id, n, term, count(*) AS tf FROM (SELECT vector_id, len(terms) AS n, unnest(terms) AS term FROM tok) GROUP BY 1, 2, 3),
size AS (SELECT sig, count(*) AS n, avg(len(terms)) AS avgdl FROM el JOIN tok USING (vector_id) GROUP BY 1),
dfs AS (SELECT sig, term, size.n, avgdl, ln(size.n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT sig, term, count(*) AS df FROM el JOIN post USING (vector_id) GROUP BY 1, 2) JOIN size USING (sig)),
mean AS (SELECT sig, avg(raw) AS m FROM dfs GROUP BY 1),
asked AS (SELECT question_id, sig, term, count(*) AS qtf FROM (SELECT question_id, unnest({grams('question')}) AS term FROM q) JOIN s USING (question_id) GROUP BY 1, 2, 3),
sc AS (SELECT question_id, el.vector_id AS vector_id, round(sum(qtf * CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * post.n / avgdl))), 4) AS bm25_score
  FROM asked JOIN dfs USING (sig, term) JOIN mean USING (sig) JOIN el USING (sig) JOIN post ON post.vector_id = el.vector_id AND post.term = asked.term GROUP BY 1, 2),
kw AS (SELECT question_id, vector_id, bm25_score, bm25_rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25_score DESC, vector_id) AS bm25_rank FROM sc WHERE bm25_score > 0) JOIN st USING (question_id) WHERE bm25_rank <= bm25_top_k)"""
VEC = BM25 + """,
qv AS (SELECT question_id, vec AS qvec FROM kw JOIN items USING (vector_id) WHERE bm25_rank = 1),
vs AS (SELECT question_id, i.vector_id, round(list_sum(list_transform(range(1, 65), lambda k: qvec[k] * i.vec[k])), 6) AS vector_score FROM qv JOIN s USING (question_id) JOIN el USING (sig) JOIN items i ON i.vector_id = el.vector_id),
vk AS (SELECT question_id, vector_id, vector_score, vector_rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY vector_score DESC, vector_id) AS vector_rank FROM vs) JOIN st USING (question_id) WHERE vector_rank <= vector_top_k)"""
RRF = VEC + """,
fu AS (SELECT question_id, vector_id, vector_rank, bm25_rank, round(coalesce(1.0::DOUBLE / (rrf_k + vector_rank), 0) + coalesce(1.0::DOUBLE / (rrf_k + bm25_rank), 0), 9) AS rrf_score,
  concat_ws(',', CASE WHEN vector_rank IS NOT NULL THEN 'vector' END, CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END) AS sources FROM vk FULL JOIN kw USING (question_id, vector_id) JOIN st USING (question_id)),
fr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, vector_rank NULLS LAST, bm25_rank, vector_id) AS rrf_rank FROM fu)"""
RANKED = RRF + f""",
rs AS (SELECT question_id, vector_id, rrf_rank, round(len(list_intersect(a, c)) / greatest(len(a), 1), 6) AS rerank_score FROM fr
  JOIN (SELECT question_id, list_distinct({grams('question')}) AS a FROM q) USING (question_id) JOIN (SELECT vector_id, list_distinct({grams('content')}) AS c FROM items) USING (vector_id) JOIN st USING (question_id) WHERE rrf_rank <= rerank_candidates),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rrf_rank) AS rerank_rank FROM rs JOIN st USING (question_id) WHERE rerank_score >= rerank_threshold) WHERE rerank_rank <= top_k)"""
CONTEXT = RANKED + f""",
cx AS (SELECT question_id, vector_id, chunk_id, rerank_rank, rerank_score, text, used FROM (SELECT question_id, vector_id, chunk_id, rerank_rank, rerank_score, text, sum(length(text)) OVER (PARTITION BY question_id ORDER BY rerank_rank) AS used
  FROM (SELECT *, {doc('rerank_rank')} AS text FROM rk JOIN items USING (vector_id))) JOIN st USING (question_id) WHERE rerank_rank = 1 OR used <= max_context_chars)"""



def _chunks() -> str:
    fits = lambda k: f"k{k} = 'table' AND h{k} AND section = s{k} AND abs(p{k} - page) <= 1 AND t <> '' AND ((kind = 'title' AND sh) OR (kind = 'text' AND un))"
    return f"""WITH {B}, c0 AS (SELECT *, {columns('content')} AS cols, {norm('content')} AS t, {short('content')} AS sh, {unit('content')} AS un FROM b),
    c1 AS (SELECT *, coalesce(kind = 'table' AND NOT coalesce(lag(kind) OVER w = 'table' AND lag(section) OVER w = section AND page = lag(page) OVER w + 1 AND lag(cols) OVER w = cols AND cols > 0, false), false) AS head,
      last_value(CASE WHEN kind IN ('title', 'text', 'table') THEN kind END IGNORE NULLS) OVER v AS bk, last_value(CASE WHEN kind IN ('title', 'text', 'table') THEN section END IGNORE NULLS) OVER v AS bs
      FROM c0 WINDOW w AS (PARTITION BY report_no ORDER BY block_no), v AS (PARTITION BY report_no ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c2 AS (SELECT *, {', '.join(f'lead({c}, {k}) OVER w AS {n}{k}' for k in (1, 2) for c, n in (('kind', 'k'), ('section', 's'), ('page', 'p'), ('head', 'h')))}, sum(CASE WHEN head OR (kind = 'text' AND NOT coalesce(bk = 'text' AND bs = section, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY report_no ORDER BY block_no) AS island FROM c1 WINDOW w AS (PARTITION BY report_no ORDER BY block_no)),
    c3 AS (SELECT *, lead(island, 1) OVER w AS i1, lead(island, 2) OVER w AS i2, coalesce({fits(1)}, false) AS to1,
      coalesce({fits(2)} AND (kind = 'title' OR (k1 = 'text' AND s1 = section) OR k1 NOT IN ('title', 'text', 'table')), false) AS to2 FROM c2 WINDOW w AS (PARTITION BY report_no ORDER BY block_no)),
    it AS (SELECT report_no, island, kind, block_no, t, page FROM c3 WHERE kind = 'table' OR (kind = 'text' AND NOT to1 AND NOT to2)
      UNION ALL SELECT report_no, i1, 'table', block_no, t, page FROM c3 WHERE to1 UNION ALL SELECT report_no, i2, 'table', block_no, t, page FROM c3 WHERE to2),
    ta AS (SELECT *, CASE WHEN t <> '' THEN (sum(CASE WHEN t <> '' THEN length(t) + 2 ELSE 0 END) OVER (PARTITION BY report_no, island ORDER BY block_no))::BIGINT - 2 END AS e FROM it),
    g AS (SELECT report_no, island, max(kind) AS kind, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY block_no) FILTER (t <> ''), '') AS body FROM it GROUP BY 1, 2),
    ps AS (SELECT report_no, island, kind, body, CASE WHEN kind = 'text' THEN {split_long('body')} ELSE [{norm('body')}] END AS parts FROM g),
    lo AS (SELECT report_no, island, kind, list_reduce(list_prepend([{{'t': '', 's': 0::BIGINT, 'e': 0::BIGINT}}], list_transform(parts, lambda p: [{{'t': p, 's': 0::BIGINT, 'e': 0::BIGINT}}])),
      lambda a, x: list_append(a, {{'t': x[1].t, 's': a[-1].e + greatest(position(x[1].t IN substr(body, a[-1].e + 1)) - 1, 0), 'e': a[-1].e + greatest(position(x[1].t IN substr(body, a[-1].e + 1)) - 1, 0) + length(x[1].t)}}))[2:] AS ps FROM ps),
    pp AS (SELECT report_no, island, kind, unnest(range(1, len(ps) + 1)) AS no, unnest(ps) AS p FROM lo),
    ov AS (SELECT pp.report_no, pp.island, no, ta.page, kind_of.kind = 'text' AND e IS NOT NULL AND e - length(t) < p.e AND e > p.s AS hit, kind_of.kind AS k FROM pp JOIN ta USING (report_no, island) JOIN (SELECT report_no, island, kind FROM g) kind_of USING (report_no, island)),
    h AS (SELECT *, max(hit::INT) OVER (PARTITION BY report_no, island, no) AS hits FROM ov),
    pg AS (SELECT report_no, island, no, coalesce(min(nullif(page, 0)), 0) AS page_start, coalesce(max(nullif(page, 0)), 0) AS page_end, count(*) AS n_blocks FROM h WHERE hit OR hits = 0 GROUP BY 1, 2, 3),
    z AS (SELECT report_no, row_number() OVER (PARTITION BY report_no ORDER BY island, no) AS chunk_seq, pp.kind AS chunk_type, {norm('p.t')} AS content, page_start, page_end, n_blocks FROM pp JOIN pg USING (report_no, island, no) WHERE p.t <> '' OR pp.kind = 'table')
    SELECT report_no, chunk_seq, chunk_type, format('{{}}_{{}}_{{:06d}}', coalesce(nullif(doc_meta.stock_code, ''), {safe('doc_meta.company_name')}), coalesce(nullif(doc_meta.year, ''), 'unknown'), chunk_seq) AS chunk_id,
      content, page_start::BIGINT AS page_start, page_end::BIGINT AS page_end, n_blocks FROM z JOIN parsed USING (report_no)"""


def _paths() -> str:
    lv = ", ".join(f"max(CASE WHEN lvl = {k} THEN block_no END) OVER w AS p{k}" for k in range(1, 7))
    keep = []
    for k in range(1, 7):
        above = ", ".join(["0", *[f"coalesce(p{j}, 0)" for j in range(1, k)]])
        keep.append(f"CASE WHEN p{k} > greatest({above}, 0) THEN p{k} END")
    return f"""WITH {B}, l AS (SELECT *, CASE WHEN kind = 'title' THEN {level('content')} END AS lvl FROM b),
    o AS (SELECT report_no, block_no, {lv} FROM l WINDOW w AS (PARTITION BY report_no ORDER BY block_no)),
    x AS (SELECT report_no, block_no, list_filter([{', '.join(keep)}], lambda z: z IS NOT NULL) AS open FROM o),
    y AS (SELECT report_no, block_no, unnest(open) AS p, unnest(range(1, len(open) + 1)) AS k FROM x)
    SELECT x.report_no, x.block_no, coalesce(string_agg(b.content, ' > ' ORDER BY y.k), '') AS path FROM x LEFT JOIN y USING (report_no, block_no) LEFT JOIN b ON b.report_no = y.report_no AND b.block_no = y.p GROUP BY 1, 2"""


ORACLES: dict[str, str] = {
    "normalize_text": f"SELECT chunk_no, {norm('content')} AS text FROM all_chunks",
    "compact_text": f"SELECT chunk_no, {compact('content')} AS text FROM all_chunks",
    "safe_filename": f"SELECT report_no, {safe('doc_meta.filename')} AS name FROM parsed",
    "company_from_filename": f"""SELECT report_no, {company("coalesce(doc_meta.filename, '')")} AS company FROM parsed""",
    "doc_meta_fallback": f"""WITH p AS (SELECT report_no, {company("coalesce(doc_meta.filename, '')")} AS company_name, coalesce(doc_meta.filename, '') AS fn,
        coalesce(array_to_string(list_transform(list_filter(blocks, lambda b: coalesce(b.meta.page, 0) <= 3), lambda b: coalesce(b.content, '')), chr(10)), '') AS probe FROM parsed), k AS (SELECT company_name, max(stock_code) AS known FROM companies GROUP BY 1)
        SELECT report_no, p.company_name, coalesce(nullif(regexp_extract(fn, '20\\d{{2}}'), ''), regexp_extract(probe, '20\\d{{2}}')) AS year,
        coalesce(nullif(regexp_extract(probe, '{CODE}', 1), ''), known, '') AS stock_code FROM p LEFT JOIN k USING (company_name)""",
    "output_name": f"""SELECT coalesce(nullif(doc_meta.stock_code, ''), 'unknown') || '_' || coalesce(nullif(doc_meta.year, ''), 'unknown') || '_' || {safe('doc_meta.company_name')} || '.json' AS name,
        max(report_no) AS report_no, count(*) AS reports FROM parsed GROUP BY 1""",
    "toc_like": f"WITH {TOC} SELECT report_no, page, sections::BIGINT AS sections, dotted::BIGINT AS dotted, toc::BIGINT AS toc FROM toc",
    "toc_detected": f"""WITH {TOC}, p AS (SELECT report_no, page FROM toc WHERE toc AND page BETWEEN 2 AND 12), f AS (SELECT report_no, min(page) AS first_page FROM p GROUP BY 1),
        n AS (SELECT f.report_no, first_page, x.page AS after FROM f JOIN (SELECT report_no, page + 1 AS page FROM p WHERE (report_no, page + 1) NOT IN (SELECT report_no, page FROM p)) x ON x.report_no = f.report_no AND x.page > first_page)
        SELECT report_no, first_page::BIGINT AS first_page, (min(after) - 1)::BIGINT AS last_page FROM n GROUP BY 1, 2""",
    "toc_pages": """WITH p AS (SELECT DISTINCT report_no, page FROM (SELECT report_no, unnest(doc_meta.skipped_pages.toc) AS page FROM parsed) WHERE page IS NOT NULL),
        r AS (SELECT *, page - row_number() OVER (PARTITION BY report_no ORDER BY page) AS run FROM p), g AS (SELECT *, min(run) OVER (PARTITION BY report_no) AS first FROM r)
        SELECT report_no, min(page)::BIGINT AS first_page, max(page)::BIGINT AS last_page, count(*) AS pages FROM g WHERE run = first GROUP BY 1""",
    "marginal_repeats": f"WITH {B} SELECT report_no, {compact('content')} AS key, count(*) AS n FROM b WHERE length({compact('content')}) BETWEEN 1 AND 60 AND NOT regexp_matches({compact('content')}, '{PAGE_NUMBER}') GROUP BY 1, 2 HAVING count(*) >= 3",
    "page_number_drop": f"WITH {B} SELECT report_no, count(*) AS blocks, sum((NOT regexp_matches({compact('content')}, '{PAGE_NUMBER}'))::BIGINT)::BIGINT AS kept FROM b GROUP BY 1",
    "title_level": f"WITH {B} SELECT report_no, block_no, ({level('content')})::BIGINT AS level FROM b WHERE kind = 'title'",
    "block_rows": f"WITH {B} SELECT * FROM b",
    "section_path": _paths(),
    "unit_note": f"WITH {B} SELECT report_no, block_no, {unit('content')}::BIGINT AS unit_note, {short('content')}::BIGINT AS short_title FROM b WHERE kind IN ('text', 'title')",
    "absorbable": f"""WITH {B}, n AS (SELECT *, lead(kind) OVER w AS nk, lead(section) OVER w AS ns, lead(page) OVER w AS np FROM b WINDOW w AS (PARTITION BY report_no ORDER BY block_no))
        SELECT report_no, block_no, (section = ns AND abs(np - page) <= 1 AND {norm('content')} <> '' AND ((kind = 'title' AND {short('content')}) OR (kind = 'text' AND {unit('content')})))::BIGINT AS absorbable FROM n WHERE nk = 'table' AND kind <> 'table'""",
    "md_columns": f"SELECT chunk_no, ({columns('content')})::BIGINT AS columns FROM all_chunks",
    "table_runs": f"WITH {TABLES} SELECT report_no, block_no, columns::BIGINT AS columns, head::BIGINT AS head, run::BIGINT AS run FROM runs",
    "doc_chunks": _chunks(),
    "split_long_text": f"SELECT chunk_no, unnest(range(0, len(parts)))::BIGINT AS k, unnest(list_transform(parts, lambda z: length(z)))::BIGINT AS n FROM (SELECT chunk_no, {split_long('content')} AS parts FROM all_chunks)",
    "chunk_pages": f"WITH {B} SELECT report_no, section, coalesce(min(nullif(page, 0)), 0)::BIGINT AS page_start, coalesce(max(nullif(page, 0)), 0)::BIGINT AS page_end FROM b GROUP BY 1, 2",
    "chunk_ids": f"""SELECT chunk_no, format('{{}}_{{}}_{{:06d}}', coalesce(nullif(meta.stock_code, ''), {safe('meta.company_name')}), coalesce(nullif(meta.year, ''), 'unknown'), row_number() OVER (PARTITION BY coalesce(meta.filename, '') ORDER BY chunk_no)) AS chunk_id FROM all_chunks""",
    "buffer_ranges": f"""WITH {B}, t AS (SELECT report_no, block_no, length({norm('content')}) AS n FROM b WHERE kind = 'text' AND {norm('content')} <> ''),
        e AS (SELECT *, (sum(n + 2) OVER (PARTITION BY report_no ORDER BY block_no) - 2)::BIGINT AS e FROM t) SELECT report_no, block_no, (e - n)::BIGINT AS start, e AS "end" FROM e""",
    "text_islands": f"""WITH {B}, n AS (SELECT *, CASE WHEN lag(kind) OVER w <> 'text' OR lag(section) OVER w <> section OR lag(kind) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY report_no ORDER BY block_no)),
        i AS (SELECT *, (sum(new) OVER (PARTITION BY report_no ORDER BY block_no))::BIGINT AS island FROM n WHERE kind = 'text') SELECT report_no, island, count(*) AS blocks, sum(length(content))::BIGINT AS chars FROM i GROUP BY 1, 2""",
    "emb_text": f"SELECT chunk_no, {strip("coalesce(content, '')")} AS text FROM all_chunks WHERE {strip("coalesce(content, '')")} <> ''",
    "cache_last_wins": f"WITH {CUR} SELECT chunk_id, seq, coalesce(len(e), -1)::BIGINT AS numbers FROM cur",
    "emb_pending_anti": f"SELECT min(chunk_no) AS chunk_no, chunk_id FROM all_chunks WHERE {strip("coalesce(content, '')")} <> '' AND NOT EXISTS (SELECT 1 FROM embedding_cache e WHERE e.chunk_id = all_chunks.chunk_id) GROUP BY chunk_id",
    "emb_batches": f"""WITH p AS (SELECT min(chunk_no) AS chunk_no, chunk_id FROM all_chunks WHERE {strip("coalesce(content, '')")} <> '' AND NOT EXISTS (SELECT 1 FROM embedding_cache e WHERE e.chunk_id = all_chunks.chunk_id) GROUP BY chunk_id)
        SELECT chunk_no, chunk_id, ((row_number() OVER (ORDER BY chunk_no) - 1) // 10)::BIGINT AS batch FROM p""",
    "index_items": f"WITH {ITEMS} SELECT vector_id, chunk_id, round(list_sum(vec), 5) AS vec_sum FROM items",
    "emb_missing": f"WITH {CUR} SELECT vector_id::BIGINT AS vector_id, chunk_id FROM metadata m WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.chunk_id = m.chunk_id)",
    "l2_normalize": f"WITH {CUR} SELECT chunk_id, round(vec[1], 6) AS first, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm FROM unit",
    "index_config": f"""WITH {ITEMS} SELECT (SELECT count(*) FROM all_chunks) AS input, (SELECT count(*) FROM good) AS usable, (SELECT count(*) FROM cur) AS cached, (SELECT count(*) FROM items) AS indexed,
        (SELECT max(len(vec)) FROM items)::BIGINT AS dimension, (SELECT count(DISTINCT chunk_id) FROM failed) AS failed""",
    "index_integrity": "SELECT count(*) AS items, count(DISTINCT vector_id) AS ids, (max(vector_id) + 1)::BIGINT AS expected FROM metadata",
    "health_counts": "SELECT (SELECT count(*) FROM metadata) AS items, (SELECT count(*) FROM questions) AS questions",
    "companies": f"""WITH r AS (SELECT {strip("coalesce(meta.company_name, '')")} AS company_name, {strip("coalesce(meta.stock_code, '')")} AS stock_code, nullif({strip("coalesce(meta.year, '')")}, '') AS year FROM metadata)
        SELECT company_name, stock_code, coalesce(string_agg(DISTINCT year, ',' ORDER BY year), '') AS years, count(*) AS items FROM r WHERE company_name <> '' OR stock_code <> '' GROUP BY 1, 2""",
    "failures": "SELECT regexp_replace(coalesce(error, 'unknown'), '\\d+', '#', 'g') AS error, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM failed GROUP BY 1",
    "year_extract": f"""SELECT question_id, coalesce(array_to_string({years("coalesce(question, '')")}, ','), '') AS years FROM questions""",
    "years_normalize": f"SELECT question_id, nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(years, lambda x: {strip('x')}), lambda x: x <> ''))), ','), '') AS years FROM questions",
    "infer_company": f"WITH {FILTERS} SELECT question_id, coalesce(nullif(own, ''), hcode) AS code, CASE WHEN own = '' THEN hname END AS company FROM inf",
    "resolve_filters": f"WITH {FILTERS} SELECT question_id, code, year, coalesce(array_to_string(years, ','), '') AS years FROM f",
    "allowed_ids": f"WITH {FILTERS} SELECT question_id, coalesce(n, 0) AS n FROM s LEFT JOIN (SELECT sig, count(*) AS n FROM el GROUP BY 1) USING (sig)",
    "tokens": f"SELECT term, count(*) AS n FROM (SELECT unnest({grams('content')}) AS term FROM all_chunks) GROUP BY 1",
    "bm25_topk": f"WITH {BM25} SELECT * FROM kw",
    "vector_topk": f"WITH {VEC} SELECT * FROM vk",
    "rrf_fusion": f"WITH {RRF} SELECT question_id, vector_id, rrf_score, rrf_rank, sources FROM fr",
    "rerank_threshold": f"WITH {RANKED} SELECT question_id, vector_id, rrf_rank, rerank_score, rerank_rank FROM rk",
    "rerank_document": f"SELECT vector_id, {doc()} AS text FROM (SELECT vector_id::BIGINT AS vector_id, content, meta.company_name AS company_name, meta.stock_code AS stock_code, meta.year AS year, meta.section AS section, meta.page_start AS page_start, meta.page_end AS page_end FROM metadata)",
    "references": f"WITH {CONTEXT} SELECT question_id, rerank_rank AS ref_id, vector_id, chunk_id, rerank_score, used::BIGINT AS used FROM cx",
    "hybrid_answer": f"""WITH {CONTEXT}, a AS (SELECT question_id, string_agg(text, chr(10) || chr(10) ORDER BY rerank_rank) AS context, count(*) AS cited FROM cx GROUP BY 1)
        SELECT question_id, coalesce(cited, 0) AS cited, md5(coalesce(context, '根据已检索到的资料，无法回答该问题。')) AS context_md5 FROM questions LEFT JOIN a USING (question_id)""",
    "answer_usage": f"""WITH {CONTEXT}, n AS (SELECT question_id, 1 AS k, 0 AS c FROM vk UNION ALL SELECT question_id, 2, 0 FROM kw UNION ALL SELECT question_id, 3, 0 FROM fr UNION ALL SELECT question_id, 4, 0 FROM rs
        UNION ALL SELECT question_id, 5, 0 FROM rk UNION ALL SELECT question_id, 6, length(text) FROM cx UNION ALL SELECT question_id, 0, 0 FROM questions)
        SELECT question_id, {', '.join(f"count(*) FILTER (k = {k}) AS {c}" for k, c in enumerate(('vector_count', 'bm25_count', 'rrf_count', 'rerank_input_count', 'rerank_output_count', 'final_reference_count'), 1))},
        (sum(c) + 2 * greatest(count(*) FILTER (k = 6) - 1, 0))::BIGINT AS context_chars FROM n GROUP BY 1""",
    "no_evidence": f"WITH {RANKED} SELECT question_id FROM questions WHERE question_id NOT IN (SELECT question_id FROM rk)",
    "debug_preview": f"SELECT vector_id::BIGINT AS vector_id, {pages('meta.page_start', 'meta.page_end')} AS pages, substr(content, 1, 200) AS preview FROM metadata",
    "ui_candidate": f"""WITH {RANKED} SELECT rk.question_id, vector_id, format('{{:.4f}}', rerank_score) AS score, substr(content, 1, st.content_preview_chars) AS preview, CASE WHEN include_content THEN length(content) END AS full_chars
        FROM rk JOIN items USING (vector_id) JOIN questions ON questions.question_id = rk.question_id JOIN st ON st.question_id = rk.question_id""",
}
