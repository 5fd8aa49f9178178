"""The same results in DuckDB SQL, written from the semantics rather than from the Spark plans."""

from __future__ import annotations

import re

from sheaf import fixed_values as fv
from sheaf.operators import select
from workload import queries as q
from workload import views

ORACLES: dict[str, str] = {}

SPACE = fv.UNICODE_SPACE
CORPUS = f"corpus as (select doc_id, {views.REL_PATH} as rel_path, {views.CONTENT} as content from documents)"
EXT = r"lower(regexp_extract(rel_path, '(\.[^./]*)$', 1))"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(values: list[str]) -> str:
    return "(" + ", ".join(map(quote, values)) + ")"


def corpus_of(content: str, path: str = views.REL_PATH) -> str:
    return f"corpus as (select doc_id, {path} as rel_path, {content} as content from documents)"


BINARY = f"{EXT} in {any_of(fv.BINARY_EXTENSIONS)}"

# --- sources ----------------------------------------------------------------------------

ORACLES["scan_corpus_table"] = f"""
select {views.REL_PATH} as rel_path, cast(strlen(text) as bigint) as bytes, {BINARY} as is_binary, md5(text) as digest
from (select *, {views.REL_PATH} as rel_path from documents)"""

ORACLES["scan_corpus_files"] = """
select concat('lang=', lang, '/source=', source) as dir, cast(sum(strlen(text) + 1) as bigint) as bytes,
  cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) as bigint) as lines, cast(0 as bigint) as skipped
from documents group by all"""

ORACLES["file_source_read"] = """
with l as (select concat('lang=', lang, '/source=', source) as dir, unnest(string_split(text, chr(10))) as line from documents)
select dir, count(*) as lines, cast(sum(cast(concat('0x', md5(line)[1:8]) as bigint)) as bigint) as digest
from l where line <> '' group by 1"""

ORACLES["select_manifest"] = f"""
with docs as (select doc_id, {views.REL_PATH} as rel_path from documents),
labelled as (select docs.*, quality, toxic from docs join labels using (doc_id)),
entries as (select rel_path as entry from labelled where quality = 1
  union select regexp_extract(rel_path, '^(.*)/', 1) from labelled where toxic = 1 and quality = 0)
select rel_path from docs where exists (
  select 1 from entries where rel_path = entry or starts_with(rel_path, concat(entry, '/')))"""

ORACLES["union_roots"] = """
with p as (select concat('/r/', cast(page_id * 3 as varchar)) as abs_path, html as content from pages),
d as (select concat('/r/', cast(doc_id as varchar)) as abs_path, text as content from documents)
select abs_path, md5(content) as digest from p
union all select abs_path, md5(content) from d where abs_path not in (select abs_path from p)"""

TRIM = rf"'^[{SPACE}]+|[{SPACE}]+$'"
ORACLES["scan_ignore_rules"] = f"""
with l as (select concat(lang, '/', source, '/', cast(doc_id as varchar)) as scope_dir, string_split({q.RULE_TEXT}, chr(10)) as ls from documents),
x as (select scope_dir, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from l),
t as (select scope_dir, line_no, regexp_replace(line, {TRIM}, '', 'g') as t from x),
b as (select *, regexp_replace(t, '^!', '') as b from t),
p as (select *, regexp_replace(b, '/$', '') as s from b)
select scope_dir, cast(1 as int) as file_ord, cast(line_no as int) as line_no, regexp_replace(s, '^/', '') as pattern,
  starts_with(t, '!') as negate, ends_with(b, '/') as dir_only, starts_with(s, '/') as anchored
from p where t <> '' and not starts_with(t, '#') and regexp_replace(s, '^/', '') <> ''"""

ORACLES["scan_commit_log"] = f"""
select cast(l_orderkey as varchar) as hash, cast(o_custkey as varchar) as author,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as date, o_orderpriority as message, {views.COMMIT_PATH} as path
from lineitem join orders on o_orderkey = l_orderkey"""

# --- filters ----------------------------------------------------------------------------


def spelled(pattern: str) -> str:
    """A stated glob as a regex, written from what globs mean and without the code under test.

    Only a pattern without slashes may begin inside a path. Two stars, with a slash behind them or
    not, take anything; one star, question marks and classes stay within a name.
    """
    bare = pattern.removeprefix("!").removesuffix("/")
    special = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.findall(r"\*\*/?|\[[^\]]*\]|.", bare.removeprefix("/"))
    body = "".join(special.get(x) or (x.replace("[!", "[^/") if len(x) > 1 else re.escape(x)) for x in pieces)
    return body if "/" in bare else "(.*/)?" + body


def full_match(path: str, pattern: str) -> str:
    return f"regexp_full_match({path}, {quote(spelled(pattern))}, 's')"


def verdict(path: str, patterns: list[str], is_dir: bool) -> str:
    """Number the matching rules and take the last one's sign."""
    hits = [
        f"case when {full_match(path, p)} then {-i if p.startswith('!') else i} else 0 end"
        for i, p in enumerate(patterns, 1)
        if is_dir or not p.endswith("/")
    ]
    listed = ", ".join(hits)
    return f"coalesce(list_last(list_filter([{listed}], lambda h: h <> 0)), 0) > 0"


def ancestor_list(path: str) -> str:
    return (
        f"list_transform(range(1, len(string_split({path}, '/'))), "
        f"lambda n: array_to_string(string_split({path}, '/')[1:n], '/'))"
    )


def kept_sql(corpus: str, patterns: list[str], files: bool, dirs: bool, extra: str = "") -> str:
    file_test = f"not ({verdict('rel_path', patterns, False)})" if files else "true"
    bad = f"select d from (select distinct unnest({ancestor_list('rel_path')}) as d from corpus) where {verdict('d', patterns, True)}"
    dir_test = "not list_has_any(above, (select coalesce(list(d), []) from bad))" if dirs else "true"
    return f"""
with {corpus}, bad as ({bad}), c as (select *, {ancestor_list('rel_path')} as above from corpus)
select rel_path{extra or ', cast(strlen(content) as bigint) as bytes'} from c where {file_test} and {dir_test}"""


ORACLES["glob_match"] = (
    f"with {CORPUS} select rel_path, "
    + ", ".join(
        (full_match("rel_path", p) if not p.endswith("/") else "false") + f" as g{i}" for i, p in enumerate(q.GLOBS)
    )
    + " from corpus"
)
ORACLES["include_filter"] = (
    f"with {CORPUS} select rel_path, cast(strlen(content) as bigint) as bytes from corpus where "
    + " or ".join(full_match("rel_path", p) for p in q.INCLUDES if not p.endswith("/"))
)
ORACLES["ignore_filter"] = kept_sql(CORPUS, q.IGNORES, True, False)
ORACLES["ignored_dir_prune"] = kept_sql(CORPUS, q.DIR_IGNORES, False, True)
ORACLES["default_ignores"] = kept_sql(corpus_of(views.CONTENT, views.TOOL_PATH), select.default_ignores(), True, True)

# The rule files of the derived view, spelled out per directory; outer before inner.
ORACLES["nested_ignores"] = rf"""
with {CORPUS}, split as (select *, split_part(rel_path, '/', 2) as lg,
  regexp_replace(rel_path, '^[^/]*/[^/]*/', '') as below, split_part(rel_path, '/', -1) as name from corpus),
v as (select *,
  case when regexp_matches(name, '\.go$') then 1 when regexp_matches(name, '^d1.*\.lua$') then 1 else 0 end as stated,
  case when regexp_matches(name, '\.png$') then 1 else 0 end as top,
  case when lg = 'en' then case when regexp_matches(name, '^d6.*\.log$') then -1 when regexp_matches(name, '\.log$') then 1 else 0 end
    when lg = 'fr' then case when regexp_matches(name, '\.log$') then 1 else 0 end
    else case when regexp_matches(name, '3\.sql$') then -1 when regexp_matches(name, '\.sql$') then 1
      when regexp_matches(name, '\.p[xyz]$') then 1 when regexp_matches(name, '\.log$') then 1 else 0 end end as inner_rule,
  starts_with(rel_path, 'src4/') or (lg = 'en' and regexp_matches(below, '^src1[^/]*/'))
    or (lg = 'fr' and regexp_matches(below, '^src2/')) as pruned from split)
select rel_path, cast(strlen(content) as bigint) as bytes from v
where not pruned and case when inner_rule <> 0 then inner_rule < 0 when top <> 0 then false else stated = 0 end"""

ORACLES["max_size_filter"] = f"""with {CORPUS}
select rel_path, cast(strlen(content) as bigint) as bytes from corpus where strlen(content) <= 4000"""
ORACLES["binary_by_ext"] = f"with {CORPUS} select rel_path, {BINARY} as is_binary from corpus"

# Kind 1 has its NUL behind the text, so only shorter texts show it; kind 2 leads with enough
# invalid bytes to pass a tenth of the sniffed prefix, kind 3 never reaches a tenth.
SNIFFED = """case doc_id % 4 when 0 then false when 1 then strlen(text) < 8192 when 2 then true else false end"""
ORACLES["binary_by_content"] = f"select {views.REL_PATH} as rel_path, {SNIFFED} as is_binary from documents"
ORACLES["skip_status"] = f"""
with r as (select *, {views.REL_PATH} as rel_path from documents),
s as (select rel_path, case when {BINARY} then 'binary file (by extension)'
  when doc_id % 10 = 3 then 'read error: permission denied'
  when {SNIFFED} then 'binary file (by content)' else '' end as skip_reason from r)
select rel_path, skip_reason, starts_with(skip_reason, 'binary') as is_binary from s"""

# --- secrets ----------------------------------------------------------------------------


def rule_rows(rules: list[tuple[int, str, str, float]]) -> str:
    rows = ", ".join(f"({i}, {quote(n)}, {quote(p)}, {e})" for i, n, p, e in rules)
    return f"rules(rule_ord, rule, rx, least) as (values {rows})"


BUILTIN = [(i, *r) for i, r in enumerate(fv.SECRET_RULES, 1)]
EXTRA = [(i, r.name, r.pattern, r.min_entropy) for i, r in enumerate(q.EXTRA_RULES, len(BUILTIN) + 1)]
MATCHES = """
m0 as (select rel_path, content, rule_ord, rule, least, regexp_extract_all(content, rx) as ms, string_split_regex(content, rx) as ps
  from corpus, rules where regexp_matches(content, rx)),
m1 as (select rel_path, rule_ord, rule, least, ms, ps, unnest(ms) as match, generate_subscripts(ms, 1) as k from m0),
m2 as (select rel_path, rule_ord, rule, least, match, k,
  1 + length(array_to_string(ps[1:k], '')) - length(replace(array_to_string(ps[1:k], ''), chr(10), ''))
    + length(array_to_string(ms[1:k-1], '')) - length(replace(array_to_string(ms[1:k-1], ''), chr(10), '')) as line from m1),
letters as (select rel_path, rule_ord, k, unnest(string_split(match, '')) as c, length(match) as n from m2),
counts as (select rel_path, rule_ord, k, c, n, count(*) as f from letters group by all),
bits as (select rel_path, rule_ord, k, -sum(f / n * log2(f / n)) as entropy from counts group by all),
found as (select m2.*, entropy from m2 join bits using (rel_path, rule_ord, k)),
kept as (select * from found where least = 0 or entropy >= least - 1e-9)"""
REDACTED = "case when strlen(match) <= 8 then '[redacted]' else concat(left(match, 3), repeat('*', strlen(match) - 6), right(match, 3)) end"


def scan(rules, corpus: str = CORPUS) -> str:
    return f"with {corpus}, {rule_rows(rules)}, {MATCHES}"


ORACLES["secret_scan"] = f"""{scan(BUILTIN)}
select rel_path, cast(rule_ord as int) as rule_ord, cast(k as int) as match_ord, cast(line as int) as line, rule, {REDACTED} as match from kept"""
ORACLES["secret_entropy"] = f"""{scan([r for r in BUILTIN if r[3] > 0])}
select rel_path, rule, cast(k as int) as match_ord, round(entropy, 6) as entropy, entropy >= least - 1e-9 as kept from found"""
ORACLES["secret_line"] = rf"""with {CORPUS}, rules(rule_ord, rule, rx, least) as (values (1, 'a', '[A-Za-z_]+\s*[:=]\s*\S+', 0.0)), {MATCHES}
select rel_path, cast(k as int) as match_ord, cast(line as int) as line, md5(match) as digest from m2"""
ORACLES["secret_redact"] = """
select doc_id, md5(case when strlen(text) <= 8 then '[redacted]' else concat(left(text, 3),
    repeat('*', strlen(text) - strlen(left(text, 3)) - strlen(right(text, 3))), right(text, 3)) end) as digest,
  case when strlen(source) <= 8 then '[redacted]' else concat(left(source, 3), repeat('*', strlen(source) - 6), right(source, 3)) end as short
from documents"""
ORACLES["secret_extra_rules"] = f"""{scan(BUILTIN + EXTRA)}
select rel_path, cast(rule_ord as int) as rule_ord, rule, count(*) as n, cast(max(line) as bigint) as last_line from kept group by all"""
QUARANTINED = f"""{scan(BUILTIN)}, flagged as (select distinct rel_path from kept)
select rel_path, case when rel_path in (from flagged) then 'removed by security scanner' else '' end as skip_reason,
  md5(case when rel_path in (from flagged) then '' else content end) as digest from corpus"""
ORACLES["secret_quarantine"] = QUARANTINED
ORACLES["findings_report"] = f"""{scan(BUILTIN)}
select rel_path, cast(rule_ord as int) as rule_ord, cast(k as int) as match_ord, concat('line ', line, ': ', rule) as entry from kept"""

# --- cleaning ---------------------------------------------------------------------------

DOUBLE = r'"(?:[^"\\]|\\.)*\\?"?'
SINGLE = r"''(?:[^''\\]|\\.)*\\?''?"


def by_tokens(s: str, regex: str, is_comment: str) -> str:
    """Cut into tokens that cover the text, empty the comments of all but newlines, join. ``regex`` is SQL-quoted."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({s}, '{regex}', 0, 's'), "
        rf"lambda t: case when {is_comment} then regexp_replace(t, '[^\n]', '', 'g') else t end), '')"
    )


def strip_c(s: str) -> str:
    regex = rf"//[^\n]*|/\*.*?(?:\*/|\z)|{DOUBLE}|{SINGLE}|`[^`]*`?|[^/\"''`]+|/"
    return by_tokens(s, regex, "starts_with(t, '//') or starts_with(t, '/*')")


def strip_hash(s: str) -> str:
    return by_tokens(s, rf"#[^\n]*|{DOUBLE}|{SINGLE}|[^#\"'']+", "starts_with(t, '#')")


def strip_lua(s: str) -> str:
    return by_tokens(s, r"--\[\[.*?\]\]|--[^\n]*|-|[^-]+", "starts_with(t, '--')")


def strip_sql(s: str) -> str:
    bare = rf"regexp_replace({s}, '--[^\n]*', '', 'g')"
    return by_tokens(bare, r"/\*.*?\*/|/|[^/]+", "starts_with(t, '/*')")


def strip_xml(s: str) -> str:
    return by_tokens(s, r"<!--.*?-->|<|[^<]+", "starts_with(t, '<!--')")


def strip_any(s: str) -> str:
    return f"""case when {EXT} in {any_of(fv.HASH_COMMENT_EXTENSIONS)} then {strip_hash(s)}
      when {EXT} = '.lua' then {strip_lua(s)} when {EXT} = '.sql' then {strip_sql(s)}
      when {EXT} in {any_of(fv.XML_COMMENT_EXTENSIONS)} then {strip_xml(s)} else {strip_c(s)} end"""


def drop_empty(s: str) -> str:
    return f"array_to_string(list_filter(string_split({s}, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')), chr(10))"


def numbered(s: str) -> str:
    ls = f"string_split({s}, chr(10))"
    return (
        f"array_to_string(list_transform(case when {s} = '' or ends_with({s}, chr(10)) then {ls}[:-2] else {ls} end, "
        f"lambda x, i: concat(lpad(cast(i as varchar), cast(length(cast(len({ls}) as varchar)) as int), ' '), ' | ', x)), chr(10))"
    )


def base64(s: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({s}, '[A-Za-z0-9+/]{{60,}}={{0,2}}|[A-Za-z0-9+/]+|[^A-Za-z0-9+/]+'), "
        r"lambda t: case when regexp_matches(t, '^[A-Za-z0-9+/]{60}') then concat('[base64 omitted, ', length(t), ' chars]') else t end), '')"
    )


def braces(s: str) -> str:
    cases = " ".join(
        f"when {EXT} in {any_of(exts)} then {quote('^[' + fv.ASCII_SPACE + ']*(?:' + '|'.join(words) + ')')}"
        for exts, words in fv.BRACE_SIGNATURES
    )
    facts = rf"""list_transform(string_split({s}, chr(10)), lambda x: {{'depth': 0, 'out': '', 'ln': x,
      'net': length(replace(x, '}}', '')) - length(replace(x, '{{', '')),
      'sig': regexp_matches(x, coalesce(case {cases} end, '$^x')) and not regexp_matches(x, '^[{SPACE}]*(?://|/\*|\*)')}})"""
    step = """lambda a, x: case
      when a.depth > 0 then {'depth': greatest(0, a.depth + x.net), 'out': case when a.depth + x.net <= 0 then concat(a.out, chr(10), '  // ...') else a.out end, 'ln': '', 'net': 0, 'sig': false}
      else {'depth': case when x.sig and x.net > 0 then x.net else 0 end, 'out': concat(a.out, chr(10), x.ln), 'ln': '', 'net': 0, 'sig': false} end"""
    start = "{'depth': 0, 'out': '', 'ln': '', 'net': 0, 'sig': false}"
    known = any_of([e for exts, _ in fv.BRACE_SIGNATURES for e in exts])
    return f"case when {EXT} in {known} then substr(list_reduce({facts}, {step}, {start}).out, 2) else {s} end"


def python_code(s: str) -> str:
    head = quote("^[" + fv.ASCII_SPACE + "]*(?:" + "|".join(fv.PYTHON_HEADERS) + ")")
    facts = rf"""list_transform(string_split({s}, chr(10)), lambda x: {{'hide': -1, 'out': '', 'ln': x,
      'ind': length(regexp_extract(x, '^[{fv.ASCII_SPACE}]*')), 'head': regexp_matches(x, {head}),
      'opens': regexp_matches(x, {head}) and regexp_matches(x, ':[{SPACE}]*$'), 'blank': not regexp_matches(x, '[^{SPACE}]')}})"""
    rest = "'ln': '', 'ind': 0, 'head': false, 'opens': false, 'blank': false"
    add = "concat(a.out, chr(10), x.ln)"
    step = f"""lambda a, x: case
      when x.blank then {{'hide': a.hide, 'out': {add}, {rest}}}
      when x.opens then {{'hide': x.ind, 'out': concat({add}, chr(10), repeat(' ', x.ind + 4), '# ...'), {rest}}}
      when x.head then {{'hide': a.hide, 'out': {add}, {rest}}}
      when a.hide >= 0 and x.ind > a.hide then {{'hide': a.hide, 'out': a.out, {rest}}}
      else {{'hide': cast(-1 as bigint), 'out': {add}, {rest}}} end"""
    facts = facts.replace("'hide': -1", "'hide': cast(-1 as bigint)")
    start = f"{{'hide': cast(-1 as bigint), 'out': '', {rest.replace(chr(39) + 'ind' + chr(39) + ': 0', chr(39) + 'ind' + chr(39) + ': cast(0 as bigint)')}}}"
    return f"substr(list_reduce({facts}, {step}, {start}).out, 2)"


def cleaned(content: str, change, path: str = views.REL_PATH) -> str:
    return f"""with {corpus_of(content, path)}, o as (select rel_path, {change('content')} as o from corpus)
select rel_path, cast(strlen(o) as bigint) as out_bytes, md5(o) as digest from o"""


ORACLES["strip_comments"] = cleaned(views.COMMENTED, strip_any)
ORACLES["strip_c_comments"] = cleaned(views.COMMENTED, strip_c)
ORACLES["strip_hash_comments"] = cleaned(views.COMMENTED, strip_hash)
ORACLES["strip_lua_comments"] = cleaned(views.LUA_TEXT, strip_lua)
ORACLES["strip_sql_comments"] = cleaned(views.SQL_TEXT, strip_sql)
ORACLES["strip_xml_comments"] = f"""with o as (select page_id, {strip_xml('html')} as o from pages)
select page_id, cast(strlen(o) as bigint) as out_bytes, md5(o) as digest from o"""
ORACLES["remove_empty_lines"] = cleaned(f"concat(replace({views.CONTENT}, '. ', concat(chr(10), ' ', chr(10))), chr(10))", drop_empty)
ORACLES["line_numbers"] = cleaned(f"concat({views.CONTENT}, case when doc_id % 2 = 0 then chr(10) else '' end)", numbered)
ORACLES["truncate_base64"] = cleaned(f"concat({views.CONTENT}, replace(replace(text, ' ', ''), chr(10), '/'))", base64)
ORACLES["compress_braces"] = cleaned(views.BRACE_CODE, braces, q.GO_PATH)
ORACLES["compress_python"] = cleaned(views.PYTHON_CODE, python_code)
ORACLES["clean_documents"] = f"""
with {corpus_of(f"concat({views.COMMENTED}, {views.BRACE_CODE}, chr(10), repeat('B', 70))", q.GO_PATH)},
c1 as (select rel_path, {strip_any('content')} as content from corpus),
c2 as (select rel_path, {base64('content')} as content from c1),
c3 as (select rel_path, {braces('content')} as content from c2),
c4 as (select rel_path, {drop_empty('content')} as content from c3),
c5 as (select rel_path, {numbered('content')} as content from c4)
select rel_path, cast(strlen(content) as bigint) as out_bytes, md5(content) as digest from c5"""

# --- metrics ----------------------------------------------------------------------------

ASCII_TOKENS = r"""greatest(1, len(regexp_extract_all(content, '[A-Za-z0-9_]+'))
  + strlen(regexp_replace(content, '[A-Za-z0-9_ \t]+', '', 'g'))
  + coalesce(list_sum(list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda w:
      len(regexp_extract_all(substr(w, 2), '[0-9]{1,3}'))
      + strlen(array_to_string(regexp_extract_all(w, case when regexp_matches(w, '^[A-Z]') then '[a-z][a-z0-9_]*' else '[A-Z][A-Z0-9_]*' end), '')))), 0))"""
UNICODE_TOKENS = f"greatest(1, length(regexp_replace(content, '[{SPACE}]', '', 'g')) + length(content) - length(replace(content, chr(10), '')))"
ASCII_BYTES = r"strlen(regexp_replace(content, '[^\x00-\x7F]+', '', 'g'))"
TOKENS = f"""case when content = '' then 0 when {ASCII_BYTES} / strlen(content) < 0.85 then {UNICODE_TOKENS} else {ASCII_TOKENS} end"""
LINES = "length(content) - length(replace(content, chr(10), '')) + case when content <> '' and not ends_with(content, chr(10)) then 1 else 0 end"


def measured(expr: str) -> str:
    return f"with {CORPUS} select rel_path, cast({expr} as bigint) as n from corpus"


ORACLES["tokens_ascii"] = measured(ASCII_TOKENS)
ORACLES["tokens_unicode"] = measured(UNICODE_TOKENS)
ORACLES["estimate_tokens"] = measured(TOKENS)
ORACLES["count_chars"] = measured("length(content)")
ORACLES["count_lines"] = measured(LINES)
METRICS = f"""metrics as (select rel_path, cast(length(content) as bigint) as chars, cast({TOKENS} as bigint) as tokens,
  cast({LINES} as bigint) as lines, cast(strlen(content) as bigint) as bytes from corpus)"""
TOTALS = """totals as (select count(*) as files, cast(sum(chars) as bigint) as chars, cast(sum(tokens) as bigint) as tokens,
  cast(sum(bytes) as bigint) as bytes from metrics)"""
ORACLES["file_metrics"] = f"with {CORPUS}, {METRICS} select * from metrics"
ORACLES["corpus_totals"] = f"with {CORPUS}, {METRICS}, {TOTALS} select * from totals"
ORACLES["pack_corpus"] = f"""{scan(BUILTIN)}, flagged as (select distinct rel_path from kept),
clean as (select * from corpus where rel_path not in (from flagged)), {METRICS.replace('from corpus', 'from clean')}
select 'file' as kind, rel_path, chars, tokens, lines, bytes from metrics
union all select 'finding', rel_path, count(*), 0, 0, 0 from kept group by rel_path"""
ORACLES["top_files"] = f"with {CORPUS}, {METRICS} select * from metrics order by tokens desc, chars desc, rel_path limit 20"
ORACLES["run_report"] = f"""with {CORPUS}, {METRICS}, {TOTALS},
t as (select *, row_number() over (order by tokens desc, chars desc, rel_path) as r from metrics)
select 'top' as section, cast(r as int) as rank, printf('  %d. %s — %d tokens, %d chars', r, rel_path, tokens, chars) as line from t where r <= 10
union all select 'totals', 1, concat('  files:   ', files) from totals
union all select 'totals', 2, concat('  chars:   ', chars) from totals
union all select 'totals', 3, concat('  tokens:  ~', tokens) from totals
union all select 'totals', 4, concat('  bytes:   ', bytes, ' (', case when bytes >= 1048576 then printf('%.2f MB', bytes / 1048576)
  when bytes >= 1024 then printf('%.2f KB', bytes / 1024) else concat(bytes, ' B') end, ')') from totals"""
ORACLES["token_listing"] = f"with {CORPUS}, {METRICS} select rel_path, tokens from metrics where tokens >= 500"
ORACLES["token_ranks"] = f"""
with {CORPUS}, {METRICS}
select rel_path, tokens, row_number() over (order by tokens desc, chars desc, rel_path) as rank from metrics"""
ORACLES["human_size"] = """
with p as (select l_partkey, cast(sum(cast(round(l_extendedprice * l_quantity) as bigint)) as bigint) as size from lineitem group by 1),
s as (select l_partkey, unnest([size, size // 2000, size * 4096]) as bytes from p)
select l_partkey, bytes, case when bytes >= 1073741824 then printf('%.2f GB', bytes / 1073741824)
  when bytes >= 1048576 then printf('%.2f MB', bytes / 1048576) when bytes >= 1024 then printf('%.2f KB', bytes / 1024)
  else concat(bytes, ' B') end as human_size from s"""

# --- history ----------------------------------------------------------------------------

RECENT = "select o_orderkey as hash, o_custkey as author, o_orderdate as ts from orders order by o_orderdate desc, o_orderkey limit"
ORACLES["recent_commits"] = f"select hash, author, strftime(ts, '%Y-%m-%d') as day from ({RECENT} 200)"
ORACLES["change_freq"] = f"""
select {views.COMMIT_PATH} as path, count(*) as n_changes from lineitem
where l_orderkey in (select hash from ({RECENT} 5000)) group by 1"""
ORACLES["order_by_change_freq"] = f"""
with f as (select {views.COMMIT_PATH} as rel_path, count(*) as n from lineitem where l_orderkey in (select hash from ({RECENT} 100)) group by 1),
p as (select {views.PART_PATH} as rel_path from part)
select rel_path, cast(coalesce(n, 0) as bigint) as n_changes from p left join f using (rel_path)"""
ORACLES["rank_by_change_freq"] = f"""
with o as ({ORACLES['order_by_change_freq']})
select rel_path, n_changes, row_number() over (order by n_changes desc, rel_path) as rank from o"""

ADDRESSES = f"a as (select page_id, trim({views.ADDRESS}) as a from pages)"
ORACLES["is_remote_url"] = f"""with {ADDRESSES}
select page_id, regexp_matches(a, '^(https?://|git://|ssh://|git@)')
  or regexp_matches(a, '^[A-Za-z0-9_][A-Za-z0-9._-]*/[A-Za-z0-9_][A-Za-z0-9._-]*$') as is_remote from a"""
ORACLES["parse_repo_url"] = rf"""with {ADDRESSES},
w as (select *, split_part(a, '/', 3) as h, string_split(regexp_replace(regexp_replace(a, '^[a-z]+://[^/]*/', ''), '[?#].*$', ''), '/') as s0 from a),
s as (select *, case when s0[-1] = '' then s0[:-2] else s0 end as s from w),
k as (select *, case when starts_with(a, './') then 'local' when regexp_matches(a, '^git@[^:]*$') then 'badssh'
  when starts_with(a, 'git@') then 'ssh' when regexp_matches(a, '^[a-z]+/[A-Za-z0-9]+$') then 'short'
  when a not like '%/%' then 'nohost' else 'web' end as kind from s)
select page_id,
  case kind when 'local' then a when 'ssh' then a when 'short' then concat('https://github.com/', a, '.git')
    when 'web' then concat(split_part(a, '/', 1), '//', h, '/', s[1], '/', regexp_replace(s[2], '\.git$', ''), '.git') else '' end as url,
  case kind when 'local' then 'local' when 'ssh' then regexp_extract(a, '@([^:]*):', 1) when 'short' then 'github.com' when 'web' then h else '' end as host,
  case kind when 'ssh' then regexp_extract(a, ':([^/]*)/', 1) when 'short' then split_part(a, '/', 1) when 'web' then s[1] else '' end as owner,
  case kind when 'ssh' then regexp_extract(a, '/(.*)\.git$', 1) when 'short' then split_part(a, '/', 2)
    when 'web' then regexp_replace(s[2], '\.git$', '') else '' end as repo,
  case when kind = 'web' and len(s) >= 4 and s[3] in ('tree', 'blob') then s[4] else '' end as branch,
  case when kind = 'web' and len(s) >= 5 and s[3] in ('tree', 'blob') then array_to_string(s[5:], '/') else '' end as subdir,
  case kind when 'badssh' then concat('invalid git@ url "', a, '"') when 'nohost' then concat('url has no host: "', a, '"') else '' end as error
from k"""

# --- trees ------------------------------------------------------------------------------


def tree_sql(paths: str) -> str:
    """``nodes`` and ``lines`` over a relation with rel_path."""
    return f"""
every as (select rel_path as path, false as is_dir from {paths}
  union all select unnest({ancestor_list('rel_path')}), true from {paths}),
nodes as (select path, bool_or(is_dir) as is_dir, string_split(path, '/') as s from every group by path),
lines as (select concat(array_to_string(list_transform(s[:-2], lambda x: concat('0', x, '|')), ''), case when is_dir then '0' else '1' end, s[-1], '|') as sort_key,
  concat(repeat('  ', len(s) - 1), s[-1], case when is_dir then '/' else '' end) as line from nodes)"""


ORACLES["tree_nodes"] = f"""with {CORPUS}, {tree_sql('corpus')}
select path, array_to_string(s[:-2], '/') as parent, s[-1] as name, cast(len(s) as bigint) as depth, is_dir from nodes"""
ORACLES["tree_render"] = f"with {CORPUS}, {tree_sql('corpus')} select sort_key, line from lines"
ORACLES["tree_numbered"] = f"""
with {CORPUS}, {tree_sql('corpus')} select row_number() over (order by replace(sort_key, '|', chr(1))) as line_no, line from lines"""
ORACLES["tree_full"] = f"""
with {CORPUS}, left_over as ({kept_sql(CORPUS, q.IGNORES, True, True)}), {tree_sql('left_over')} select sort_key, line from lines"""

# --- rendering --------------------------------------------------------------------------

MARKED = f"""{corpus_of(views.FENCED)}, marked as (select *, {BINARY} as is_binary, cast(strlen(content) as bigint) as bytes,
  case when {BINARY} then 'binary file (by extension)' when ends_with(rel_path, '.log') then 'removed by security scanner' else '' end as skipped
  from corpus), shown as (select * from marked where skipped = '')"""
CLOSED = "content || case when ends_with(content, chr(10)) then '' else chr(10) end"
HINT = (
    "case " + " ".join(f"when {EXT} in {any_of(exts)} then {quote(h)}" for h, exts in fv.LANGUAGE_HINTS.items()) + " else '' end"
)
CDATA = "'<![CDATA[' || replace(content, ']]>', ']]]]><![CDATA[>]]><![CDATA[') || ']]>'"
LONGEST = "list_max(list_transform(string_split(content, chr(10)), lambda x: length(regexp_extract(x, '^`*'))))"
FENCE = f"repeat('`', case when {LONGEST} >= 3 then {LONGEST} + 1 else 3 end)"
PLAIN = f"'---- ' || rel_path || ' ' || repeat('-', greatest(0, 70 - strlen(rel_path))) || chr(10) || {CLOSED} || chr(10)"
BODIES = {
    "xml": f"""'    <file path="' || rel_path || '">' || {CDATA} || '</file>' || chr(10)""",
    "markdown": f"""'### `' || rel_path || '`' || chr(10) || chr(10) || {FENCE} || {HINT} || chr(10) || {CLOSED} || {FENCE} || chr(10) || chr(10)""",
    "plain": PLAIN,
}
for _style, _body in BODIES.items():
    ORACLES[f"render_{_style}"] = f"""with {MARKED}, o as (select rel_path, {_body} as o from shown)
select rel_path, cast(strlen(o) as bigint) as out_bytes, md5(o) as digest from o"""
ORACLES["render_json"] = f"""with {MARKED}
select rel_path as path, md5(case when skipped = '' then content else '-' end) as digest, is_binary and skipped <> '' as binary, skipped, bytes from marked"""
ORACLES["language_hint"] = f"with {CORPUS} select rel_path, {HINT} as hint from corpus"

NLS = "' || chr(10) || '"
SPOKEN = "2024-05-03 00:00:00 UTC"
PLAIN_SUMMARY = f"""'{'=' * 64}{NLS}SUMMARY{NLS}{'=' * 64}{NLS}Producer:     sheaf v1.0.0{NLS}Generated at: {SPOKEN}{NLS}Files:        ' || files
  || '{NLS}Characters:   ' || chars || '{NLS}Tokens (~):   ' || tokens || '{NLS}Bytes:        ' || bytes || chr(10) || chr(10)"""
MARKDOWN_SUMMARY = f"""'# sheaf Output{NLS}{NLS}> Packed by **sheaf** v1.0.0 at {SPOKEN}{NLS}{NLS}| Metric | Value |{NLS}|---|---|{NLS}| Files | ' || files
  || ' |{NLS}| Characters | ' || chars || ' |{NLS}| Tokens (approx) | ' || tokens || ' |{NLS}| Bytes | ' || bytes || ' |' || chr(10) || chr(10)"""
XML_SUMMARY = f"""'  <summary>{NLS}    <producer>sheaf v1.0.0</producer>{NLS}    <generated_at>2024-05-03T00:00:00Z</generated_at>{NLS}    <description>{fv.PACK_DESCRIPTION}</description>{NLS}    <stats files="' || files
  || '" chars="' || chars || '" tokens="' || tokens || '" bytes="' || bytes || '"/>{NLS}  </summary>' || chr(10)"""
JSON_STATS = """'  "stats": {"files":' || files || ',"chars":' || chars || ',"tokens":' || tokens || ',"bytes":' || bytes || '}'"""
ORACLES["render_summary"] = f"""with {CORPUS}, {METRICS}, {TOTALS}
select 'plain' as style, {PLAIN_SUMMARY} as body from totals
union all select 'markdown', {MARKDOWN_SUMMARY} from totals
union all select 'json', {JSON_STATS} from totals
union all select 'xml', {XML_SUMMARY} from totals"""

COMMITS = f"""f as (select l_orderkey as k, {views.COMMIT_PATH} as path, cast(count(*) as int) as n from lineitem group by all),
g as (select k, min(path) as first_path from f group by k),
c as (select orders.*, first_path, cast(o_orderkey as varchar) as hash, strftime(o_orderdate, '%Y-%m-%d') as day from orders left join g on k = o_orderkey),
t as (select hash, path, n, path = first_path as is_first from c join f on k = o_orderkey),
told(style, hash, step, path, body) as (select 'xml' as style, hash, 0 as step, '' as path, '    <commit hash="' || hash || '">{NLS}      <author>' || o_custkey || '</author>{NLS}      <date>' || day
  || '</date>{NLS}      <message>' || o_orderpriority || ' &lt;' || o_orderstatus || '&gt;&#xA;body</message>' || chr(10)
  || case when first_path is null then '' else '      <files>' || chr(10) end as body from c
union all select 'xml', hash, 1, path, repeat('        <file>' || path || '</file>' || chr(10), n) from t
union all select 'xml', hash, 2, '', case when first_path is null then '' else '      </files>' || chr(10) end || '    </commit>' || chr(10) from c
union all select 'markdown', hash, 0, '', '- `' || hash || '` ' || day || ' — ' || o_orderpriority || ' <' || o_orderstatus || '>' || chr(10) from c
union all select 'json', hash, 0, '', concat('{{"hash":"', hash, '","author":"', o_custkey, '","date":"', day, '","message":"', o_orderpriority, ' <', o_orderstatus, '>\\nbody"',
  case when first_path is null then '' else ',"files":[' end) from c
union all select 'json', hash, 1, path, case when is_first then '' else ',' end || array_to_string(list_transform(range(n), lambda i: '"' || path || '"'), ',') from t
union all select 'json', hash, 2, '', case when first_path is null then '}}' else ']}}' end from c
union all select 'plain', hash, 0, '', hash || ' ' || day || ' — ' || o_orderpriority || ' <' || o_orderstatus || '>' || chr(10) from c)"""
ORACLES["render_commit_log"] = f"with {COMMITS} select * from told"


def heading(name: str) -> str:
    return f"'{'=' * 64}{NLS}{name}{NLS}{'=' * 64}' || chr(10)"


ORACLES["assemble_sections"] = f"""
with {MARKED}, mm as (select rel_path, content from shown), {METRICS.replace('from corpus', 'from mm')}, {TOTALS}, {tree_sql('marked')},
s(section_ord, k_str, body) as (
  select 10, '', {PLAIN_SUMMARY} from totals
  union all select 20, '', {heading('USER HEADER')} || 'head' || chr(10) || chr(10)
  union all select 30, '', {heading('DIRECTORY STRUCTURE')}
  union all select 31, sort_key, line || case when sort_key = (select max(sort_key) from lines) then '' else chr(10) end from lines
  union all select 32, '', chr(10) || chr(10)
  union all select 50, '', {heading('FILES')} || chr(10)
  union all select 51, rel_path, {PLAIN} from shown)
select cast(section_ord as bigint) as section_ord, k_str, md5(body) as digest from s"""

def document_sql(style: str) -> str:
    """A whole document over two roots: the sections' places, keys and bodies."""
    diff = q.DIFF.replace("]]>", "]]]]><![CDATA[>]]><![CDATA[").replace(chr(10), NLS)
    plain_diff = q.DIFF.replace(chr(10), NLS)
    tree_body = {
        "xml": "case when sort_key = (select min(sort_key) from lines) then '<![CDATA[' else '' end || replace(line, ']]>', ']]]]><![CDATA[>]]><![CDATA[') || case when sort_key = (select max(sort_key) from lines) then ']]>' else chr(10) end",
        "markdown": "line || case when sort_key = (select max(sort_key) from lines) then '' else chr(10) end",
        "json": """case when sort_key = (select min(sort_key) from lines) then ',' || chr(10) || '  "directory_tree": "' else '' end || line || case when sort_key = (select max(sort_key) from lines) then '"' else '\\n' end""",
    }[style]
    fixed = {
        "xml": f"""select 0, '', false, '<?xml version="1.0" encoding="UTF-8"?>{NLS}<sheaf>' || chr(10)
  union all select 10, '', false, {XML_SUMMARY} from totals
  union all select 20, '', false, '  <user_header>a &lt; b</user_header>' || chr(10)
  union all select 30, '', false, '  <directory_structure>' union all select 32, '', false, '</directory_structure>' || chr(10)
  union all select 50, '', false, '  <files>' || chr(10) union all select 52, '', false, '  </files>' || chr(10)
  union all select 60, '', false, '  <git_diffs>{NLS}    <work_tree><![CDATA[{diff}]]></work_tree>{NLS}  </git_diffs>' || chr(10)
  union all select 70, '', false, '  <git_log>' || chr(10) union all select 72, '', false, '  </git_log>' || chr(10)
  union all select 80, '', false, '  <instruction><![CDATA[do it]]></instruction>' || chr(10)
  union all select 90, '', false, '</sheaf>' || chr(10)""",
        "markdown": f"""select 10, '', false, {MARKDOWN_SUMMARY} from totals
  union all select 20, '', false, '## User Header{NLS}{NLS}a < b' || chr(10) || chr(10)
  union all select 30, '', false, '## Directory Structure{NLS}{NLS}```' || chr(10)
  union all select 32, '', false, chr(10) || '```' || chr(10) || chr(10)
  union all select 50, '', false, '## Files' || chr(10) || chr(10)
  union all select 60, '', false, '## Git Diffs{NLS}{NLS}### Working Tree{NLS}{NLS}```diff{NLS}{plain_diff}{NLS}```' || chr(10) || chr(10)
  union all select 70, '', false, '## Git Log' || chr(10) || chr(10) union all select 72, '', false, chr(10)
  union all select 80, '', false, '## Instruction{NLS}{NLS}do it' || chr(10)""",
        "json": f"""select 0, '', false, '{{{NLS}  "producer": "sheaf v1.0.0"'
  union all select 1, '', false, ',{NLS}  "generated_at": "2024-05-03T00:00:00Z"'
  union all select 20, '', false, ',{NLS}  "header_text": "a < b"'
  union all select 40, '', false, ',' || chr(10) || {JSON_STATS} from totals
  union all select 50, '', false, ',{NLS}  "files": [' || chr(10) union all select 52, '', false, '  ]'
  union all select 60, '', false, ',{NLS}  "git_diff_worktree": "- a]]>\\n+ b"'
  union all select 70, '', false, ',{NLS}  "git_log": [' || chr(10) union all select 72, '', false, '  ]'
  union all select 80, '', false, ',{NLS}  "instruction": "do it"'
  union all select 90, '', false, chr(10) || '}}' || chr(10)""",
    }[style]
    if style == "json":
        files = """select 51, rel_path, second, concat_ws('|', rel_path, case when skipped = '' then content else '-' end, nullif(skipped, ''), bytes,
    cast(is_binary and skipped <> '' as varchar), cast(row_number() over (order by rel_path desc, second) > 1 as varchar)) from both_roots"""
        log = """select 71, hash || '|' || step || '|' || path, false, case when step = 0 then '    ' else '' end || body
    || case when step < 2 then '' when row_number() over (order by ts, hash desc, step desc) = 1 then chr(10) else ',' || chr(10) end
    from told join (select hash, o_orderdate as ts from c) using (hash) where style = 'json'"""
    else:
        files = f"select 51, rel_path, second, {BODIES[style]} from both_roots where skipped = ''"
        log = f"select 71, hash || '|' || step || '|' || path, false, body from told where style = '{style}'"
    place = 30 if style == "json" else 31
    return f"""
with {MARKED}, both_roots as (select *, false as second from marked
  union all select *, true from marked where md5(rel_path)[1] in ('0', '1')),
mm as (select rel_path, content from both_roots where skipped = ''), {METRICS.replace('from corpus', 'from mm')}, {TOTALS},
{tree_sql('both_roots')}, {COMMITS},
s(section_ord, k_str, second, body) as ({fixed}
  union all select {place}, sort_key, false, {tree_body} from lines
  union all {files} union all {log})
select cast(section_ord as bigint) as section_ord, k_str, second, md5(body) as digest from s"""


for _style in ("xml", "markdown", "json"):
    ORACLES[f"assemble_{_style}"] = document_sql(_style)

# The greedy walk itself, one part per step and pack, over the byte positions of newlines.
SPLIT = f"""
recursive docs as (select source, {views.REL_PATH} as rel_path, text as content from documents),
packs as (select source, string_agg({PLAIN}, '' order by rel_path) as whole from docs group by source),
rows as (select source, unnest(string_split(whole, chr(10))) as r, generate_subscripts(string_split(whole, chr(10)), 1) as i from packs),
marks as (select source, sum(strlen(r) + 1) over (partition by source order by i) - 1 as pos from rows),
texts as (select source, encode(whole) as bytes, octet_length(encode(whole)) as total, list(cast(pos as bigint)) as marks
  from packs join marks using (source) group by source, whole),
walk(source, part_no, start, stop, following) as (
  select source, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from texts
  union all
  select source, part_no + 1, f, s, s + case when list_contains(marks, s) and s < total then 1 else 0 end from (
    select t.source, part_no, marks, total, following as f, case when total - following <= {q.SPLIT_BYTES} then total
      else coalesce(list_max(list_filter(marks, lambda m: m > following and m < following + {q.SPLIT_BYTES})), following + {q.SPLIT_BYTES}) end as s
    from walk join texts t using (source) where following < total)),
cut as (select w.source, part_no, max(part_no) over (partition by w.source) as n_parts, bytes[start + 1:stop] as content
  from walk w join texts using (source) where part_no > 0)"""
ORACLES["split_packs"] = f"""with {SPLIT}
select source as pack, part_no, n_parts, cast(octet_length(content) as bigint) as part_bytes, md5(content) as digest from cut"""
ORACLES["write_packs"] = f"""with {SPLIT}
select concat(source, '/pack', case when n_parts > 1 then concat('.', part_no) else '' end, '.txt') as file,
  cast(octet_length(content) as bigint) as bytes, md5(content) as digest from cut"""

ORACLES["part_filename"] = rf"""with {CORPUS}
select rel_path, regexp_replace(rel_path, '(\.[^./]*)$', concat('.', doc_id + 1, '\1')) as file from corpus"""
