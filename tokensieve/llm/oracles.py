"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_TEXT = "coalesce(text, '')"
_RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 25 * word_chars",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
}


def _shrunk(rule: str) -> str:
    """The shrunk rate of a rule, from sums over hosts (hosts, docs, squares, <rule>_x and <rule>_y)."""
    p, between = f"({rule}_x::DOUBLE / docs)", "(docs - squares / docs - (hosts - 1))"
    share = f"((({rule}_y - {rule}_x * {p}) / ({p} * (1 - {p})) - (hosts - 1)) / {between})"
    solved = f"CASE WHEN {rule}_x > 0 AND {rule}_x < docs AND {between} > 0 THEN CASE WHEN {share} > 0 THEN 1 / {share} - 1 END END"
    weight = f"least(greatest(coalesce({solved}, 100.0::DOUBLE), 1.0::DOUBLE), 100.0::DOUBLE)"
    return f"({rule} + {p} * {weight}) / (n + {weight})"


OP1 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, {_TEXT} AS t FROM documents),
w AS (SELECT *, {_WORDS.format('t')} AS l, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, l[i : i + 2] AS k FROM w, range(1, len(l) - 1) s(i)),
h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM h, range(3) s(j) GROUP BY r),
c AS (SELECT r, doc_id, source, len(l)::BIGINT AS n_words, length(array_to_string(l, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (r)),
s AS (SELECT source, count(*) AS n, {", ".join(f"count_if({t}) AS {k}" for k, t in _RULES.items())} FROM c WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT count(*) AS hosts, sum(n) AS docs, sum(n::DOUBLE * n) AS squares, {", ".join(f"sum({k}) AS {k}_x, sum({k}::DOUBLE * {k} / n) AS {k}_y" for k in _RULES)} FROM s),
b AS (SELECT source FROM s, m WHERE greatest({", ".join(_shrunk(k) for k in _RULES)}) > 0.7::DOUBLE)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULES["short"]} OR {_RULES["repetitive"]}) AS base_failed,
  NOT ({_RULES["short"]} OR {_RULES["repetitive"]}) AND b.source IS NULL AS kept FROM c LEFT JOIN b ON c.source = b.source"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT row_number() OVER () AS r, vec_id, e FROM v),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM u q JOIN u c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= 10"""

_URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_HOST = r"translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _fits(host: str, path: str, out: int) -> str:
    """The longest rule that fits: its text (1) or verdict (0)."""
    whens = []
    for rule in sorted(_URL_RULES, key=lambda r: -len(r[1])):
        h, p = rule[1].split("/", 1)
        whens.append(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '/{p}') THEN '{rule[out]}'")
    return "CASE " + " ".join(whens) + " END"


_QUERY = r"regexp_extract({0}, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1)"


def _plain_path(path: str) -> str:
    """The path without . and .. segments: each segment as a list, appended to the list so far or taking its last."""
    fold = f"list_reduce(list_transform(string_split({path}, '/'), lambda s: [s]), lambda a, x: CASE WHEN x[1] = '..' THEN a[1 : greatest(len(a) - 1, 1)] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END)"
    open_end = f"CASE WHEN regexp_matches({path}, '/[.][.]?$') THEN '/' ELSE '' END"
    return f"CASE WHEN contains({path}, '/.') THEN CASE WHEN len({fold}) = 1 THEN '/' ELSE concat(array_to_string({fold}, '/'), {open_end}) END ELSE {path} END"


def _node(url: str) -> str:
    host, path = _HOST.format(url), _PATH.format(url)
    return f"CASE WHEN {host} <> '' THEN concat({host}, CASE WHEN {path} = '' THEN '/' ELSE {_plain_path(path)} END, {_QUERY.format(url)}) END"


_CANONICAL = r"""(?is)\brel\s*=\s*["'']?\s*canonical\b"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
_SCHEME = "regexp_extract(url, '(?s)^(.*?)://', 1)"


def _unescaped(text: str) -> str:
    for name, char in (("&quot;|&#34;|&#x22;", '"'), ("&apos;|&#39;|&#x27;", "''"), ("&lt;|&#60;|&#x3c;", "<"), ("&gt;|&#62;|&#x3e;", ">"), ("&amp;|&#38;|&#x26;", "&")):
        text = f"regexp_replace({text}, '(?i){name}', '{char}', 'g')"
    return text


OP6 = rf"""WITH RECURSIVE pg AS (SELECT page_id, url, html, {_HOST.format("coalesce(url, '')")} AS host, {_PATH.format("coalesce(url, '')")} AS path, {_node("url")} AS node FROM pages),
tg AS (SELECT url, unnest(regexp_extract_all(html, '(?is)(<link\b[^>]*>|<meta\b[^>]*>)', 1)) AS tag FROM pg WHERE contains(url, '://')),
tr AS (SELECT url, CASE WHEN regexp_matches(tag, '{_CANONICAL}') THEN concat(regexp_extract(tag, '{_HREF}', 1), regexp_extract(tag, '{_HREF}', 2), regexp_extract(tag, '{_HREF}', 3))
  WHEN regexp_matches(tag, '{_REFRESH}') THEN regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^''">\s;]+)', 1) END AS t FROM tg),
te AS (SELECT url, trim({_unescaped("t")}) AS t FROM tr),
tp AS (SELECT url, t, regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS s, {_SCHEME} AS us, {_HOST.format("url")} AS uh, {_PATH.format("url")} AS up FROM te WHERE t <> ''),
tq AS (SELECT *, CASE WHEN s = '' THEN t ELSE substr(t, len(s) + 2) END AS r, CASE WHEN up = '' THEN '/' ELSE up END AS bp FROM tp),
tz AS (SELECT *, regexp_extract(r, '(?s)^(?://[^/?#]*)?([^?#]*)', 1) AS p, regexp_extract(r, '(?s)^[^?#]*(\?[^#]*)', 1) AS q FROM tq),
tm AS (SELECT *, concat(regexp_extract(bp, '(?s)^(.*/)', 1), p) AS mp FROM tz),
tu AS (SELECT url, CASE WHEN s <> '' THEN CASE WHEN starts_with(r, '//') THEN t END WHEN starts_with(r, '//') THEN us || ':' || r
  WHEN p = '' THEN concat(us, '://', uh, bp, CASE WHEN q = '' THEN {_QUERY.format("url")} ELSE q END)
  WHEN starts_with(p, '/') THEN concat(us, '://', uh, {_plain_path("p")}, q) ELSE concat(us, '://', uh, {_plain_path("mp")}, q) END AS target FROM tm),
e0 AS (SELECT {_node("url")} AS u, {_node("target")} AS v FROM tu),
ed AS (SELECT u, v FROM e0 WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM e0 WHERE u IS NOT NULL AND v IS NOT NULL),
re AS (SELECT u AS a, u AS b FROM ed UNION SELECT re.a, ed.v FROM re JOIN ed ON re.b = ed.u),
al AS (SELECT a AS node, min({_fits(_HOST.format("('http://' || b)"), _PATH.format("('http://' || b)"), 0)}) AS v FROM re GROUP BY a)
SELECT page_id, host, path, {_fits("host", "path", 1)} AS rule, coalesce({_fits("host", "path", 0)}, al.v, 'allow') AS verdict FROM pg LEFT JOIN al USING (node)"""

OP8 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_TEXT)} AS l FROM documents),
w AS (SELECT r, i, md5(array_to_string(l[i : i + 34], ' ')) AS k FROM d, range(1, len(l) - 33) s(i)),
x AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT DISTINCT r, i + j AS i FROM x, range(35) s(j)),
o AS (SELECT r, i, l[i] AS tok FROM d, range(1, len(l) + 1) s(i)),
k AS (SELECT r, string_agg(tok, ' ' ORDER BY i) AS kept, count(*) AS n FROM o ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_words, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""



def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Kind, pattern (its value in a group of its own), length that its value needs.
_SECRETS = (
    (0, "assign", rf"""((?:{_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))""", 3, 6),
    (1, "access", "(AKIA[A-Z0-9]+)", 2, 20),
    (2, "hex", "([0-9a-f]{24,})", 2, 24),
    (3, "run", "([A-Za-z0-9+/_=-]{20,})", 2, 20),
)


def _found(k: int, pattern: str, group: int, least: int) -> str:
    """Every match of a pattern with its place: prefixes and matches alternate, so their lengths add up to it."""
    each = ", ".join(f"regexp_extract_all(t, '(?s)(.*?){pattern}', {g}) AS {n}" for n, g in (("p", 1), ("m", 2), ("v", group)))
    rows = f"SELECT r, generate_subscripts(p, 1) AS i, unnest(p) AS p, unnest(m) AS m, unnest(v) AS v FROM (SELECT r, {each} FROM d)"
    placed = f"SELECT r, m, v, (sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m))::BIGINT AS s FROM ({rows})"
    return f"SELECT r, {k} AS k, s, s + length(m) AS e, m FROM ({placed}) WHERE length(v) >= {least}"


_ACQUITTED = ("[0-9_=/+-]+", "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "([A-Za-z]{2,}[0-9]{0,4}[-_/=+])+[A-Za-z]*[0-9]{0,4}")
OP7 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TEXT} AS t FROM documents),
b AS ({" UNION ALL ".join(_found(k, p, g, n) for k, _, p, g, n in _SECRETS[:3])}),
c AS (SELECT * FROM ({_found(3, *_SECRETS[3][2:])}) x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e)),
p AS (SELECT r, s, m, generate_subscripts(l, 1) AS i, unnest(l) AS part FROM (SELECT *, string_split_regex(m, '[/=]') AS l FROM c)),
q AS (SELECT *, sum(length(part) + 1) OVER w - length(part) AS o, regexp_matches(lower(part), 'example|sample|dummy|placeholder|xxxx|0000|1234567') AS bad FROM p WINDOW w AS (PARTITION BY r, s ORDER BY i)),
u AS (SELECT *, sum(bad::INT) OVER (PARTITION BY r, s ORDER BY i) AS island FROM q),
z AS (SELECT r, s + min(o) - 1 AS s, max(o + length(part)) - min(o) AS n, substr(any_value(m), min(o)::BIGINT, (max(o + length(part)) - min(o))::BIGINT) AS x FROM u WHERE NOT bad GROUP BY r, u.s, island),
y AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9a-f]+|[0-9A-F]+') THEN 3.0 WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') THEN CASE WHEN regexp_full_match(x, '[A-Za-z0-9]+') THEN 3.7 ELSE 3.9 END
  WHEN regexp_full_match(x, '[A-Za-z]+') AND lower(x) <> x AND upper(x) <> x THEN 4.0 END AS least FROM z WHERE n >= 20 AND NOT ({" OR ".join(f"regexp_full_match(x, '{a}')" for a in _ACQUITTED)})),
h AS (SELECT r, 3 AS k, s::BIGINT AS s, (s + n)::BIGINT AS e FROM y WHERE round(list_max(list_transform(range(1, n::BIGINT - 18), lambda i: list_aggregate(string_split(substr(x, i, 20), ''), 'entropy'))), 9) >= least::DOUBLE),
a AS (SELECT r, k, s, e FROM b UNION ALL SELECT * FROM h),
f AS (SELECT r, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex, string_agg(concat((['assign', 'access', 'hex', 'entropy'])[k + 1], ':', s, ':', e), ',' ORDER BY s, k) AS spans,
  string_agg(concat((['assign', 'access', 'hex'])[k + 1], ':', s, ':', e), ',' ORDER BY s, k) FILTER (k < 3) AS base FROM a GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)"""

# XXH64 in 128-bit arithmetic: fixed values of that hash, and its steps.
_P1, _P2, _P3, _P4, _P5 = (f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_ALL = "18446744073709551615::UHUGEINT"


def _low(x: str) -> str:
    return f"(({x}) & {_ALL})"


def _turned(x: str, by: int) -> str:
    """x, a plain name, turned left within 64 bits."""
    return _low(f"({x} << {by}) | ({x} >> {64 - by})")


def _lane(x: str, digits: int) -> str:
    """A little-endian number from its hexadecimal digits."""
    return f"(concat('0x', {', '.join(f'substr({x}, {i}, 2)' for i in range(digits - 1, 0, -2))})::UBIGINT::UHUGEINT)"


def _fold(first: str, items: str, step: str) -> str:
    """The steps over items from first on; a and x name what is so far and the item."""
    return f"list_reduce(list_prepend({first}, {items}), lambda a, x: {step})"


def _through(x: str, *steps: str) -> str:
    """x through steps in each of which it is y."""
    for s in steps:
        x = f"list_transform([{x}], lambda y: {s})[1]"
    return x


_ROUND = _through(_low(f"a + x * {_P2} % (1::UHUGEINT << 64)"), _low(_turned("y", 31) + f" * {_P1}"))
_WORD = _through(_low(f"x * {_P2}"), _low(_turned("y", 31) + f" * {_P1}"))  # a round of zero and x
_ACC = [42 + 11400714785074694791 + 14029467366897019727, 42 + 14029467366897019727, 42, 42 - 11400714785074694791]
_STRIPES = ", ".join(f"""{_fold(f"{v % 2**64}::UHUGEINT", f"list_transform(range({k}, n // 32 * 4, 4), lambda i: lanes[i + 1])", _ROUND)} AS v{k}""" for k, v in enumerate(_ACC))
_MERGED = _fold(
    _low(" + ".join(_turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18)))), "[v0, v1, v2, v3]", _low(f"xor(a, {_WORD}) * {_P1} % (1::UHUGEINT << 64) + {_P4}")
)
_EIGHTS = _fold("h", "list_transform(range(n // 32 * 4, n // 8), lambda i: lanes[i + 1])", _through(f"xor(a, {_WORD})", _low(_turned("y", 27) + f" * {_P1} % (1::UHUGEINT << 64) + {_P4}")))
_FOUR = "CASE WHEN n % 8 >= 4 THEN " + _through(f"xor(h, {_low(_lane('substr(x, 16 * (n // 8) + 1, 8)', 8) + f' * {_P1}')})", _low(_turned("y", 23) + f" * {_P2} % (1::UHUGEINT << 64) + {_P3}")) + " ELSE h END"
_BYTES = _fold("h", "list_transform(range(n // 4 * 4, n), lambda i: concat('0x', substr(x, 2 * i + 1, 2))::UBIGINT::UHUGEINT)", _through(f"xor(a, {_low(f'x * {_P5}')})", _low(_turned("y", 11) + f" * {_P1}")))
_FINAL = _through("h", "xor(y, y >> 33)", _low(f"y * {_P2}"), "xor(y, y >> 29)", _low(f"y * {_P3}"), "xor(y, y >> 32)")
_HASHED = f"""hx AS (SELECT s, hex(s) AS x, (length(hex(s)) // 2)::BIGINT AS n FROM (SELECT DISTINCT s FROM sh)),
hl AS (SELECT *, list_transform(range(0, n // 8), lambda i: {_lane("substr(x, 16 * i + 1, 16)", 16)}) AS lanes FROM hx),
hv AS (SELECT *, {_STRIPES} FROM hl),
hm AS (SELECT s, x, n, lanes, {_low(f"CASE WHEN n >= 32 THEN {_MERGED} ELSE 42 + {_P5} END + n::UHUGEINT")} AS h FROM hv),
he AS (SELECT s, x, n, {_EIGHTS} AS h FROM hm),
hf AS (SELECT s, x, n, {_FOUR} AS h FROM he),
hb AS (SELECT s, {_BYTES} AS h FROM hf),
hh AS (SELECT s, ({_FINAL})::UBIGINT AS h FROM hb)"""
OP10 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS l FROM documents),
sh AS (SELECT r, array_to_string(l[i : i + 3], ' ') AS s FROM d, range(1, greatest(len(l) - 2, 2)) q(i) WHERE len(l) > 0),
{_HASHED},
ct AS (SELECT r, count(*) AS n, {", ".join(f"sum((h >> {b}) & 1)::BIGINT AS b{b}" for b in range(64))} FROM sh JOIN hh USING (s) GROUP BY r),
fp AS (SELECT d.r, doc_id, coalesce({" + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))}, 0)::UBIGINT AS f FROM d LEFT JOIN ct USING (r)),
ds AS (SELECT DISTINCT f FROM fp),
ed AS (SELECT x.f AS u, y.f AS v FROM ds x, ds y WHERE x.f <> y.f AND bit_count(xor(x.f, y.f)::BIT) <= 4),
re AS (SELECT f AS u, f AS v FROM ds UNION SELECT re.u, ed.v FROM re JOIN ed ON re.v = ed.u),
cm AS (SELECT re.u AS f, min(doc_id) AS component_id FROM re JOIN fp ON fp.f = re.v GROUP BY re.u)
SELECT doc_id, lpad(lower(to_hex(f)), 16, '0') AS fingerprint, component_id FROM fp JOIN cm USING (f)"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op3_nearest": OP3, "op6_url_filter": OP6, "op7_secrets": OP7, "op8_substring_dedup": OP8, "op10_simhash": OP10}
