"""DuckDB SQL for the queries, written for that engine: window SQL over long token tables."""

from __future__ import annotations

from ..functions.tone import VIETNAMESE
from ..functions.words import CRITICAL
from ..lexicon import (
    CHAR_TONE,
    CLASS_KEEP,
    CLASS_MULTIPLIER,
    CONTRAST_FLAT,
    DIALECT,
    ENHANCED_MULTIPLIER,
    FUNCTION_WORDS,
    MAX_PARTS,
    REDUPLICATIVE_KEYS,
    REDUPLICATIVE_PAIRS,
    SINO_MORPHEMES,
    STRIP_DELETE,
    STRIP_FROM,
    STRIP_TO,
    TEENCODE,
    TONED,
    TONED_DIGITS,
    TONES,
    WORD_LIST,
)
from ..operators.tokens import lexicon_words
from ..sources.tables import DEMO_SAMPLES

_WS = r"[ \t\n\r\f\x0B]+"
_MARK_FROM, _MARK_TO = TONED + STRIP_DELETE, TONED_DIGITS + "12345"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return ", ".join(_q(x) for x in items)


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {v!r}::DOUBLE" for k, v in table.items()) + " ELSE 1.0::DOUBLE END"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_WS}'), lambda x: x <> '')"


def _marks(tok: str) -> str:
    return f"translate(regexp_replace({tok}, '[^{TONED}]', '', 'g'), '{TONED}', '{TONED_DIGITS}')"


_TOKS = f"""toks AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS tok, len(l)::INT AS n
  FROM (SELECT doc_id, {_words("text")} AS l FROM documents))"""
_LEX = f"""toks0 AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, len(l)::INT AS n
  FROM (SELECT doc_id, {_words("text")} AS l FROM documents)),
toks AS (SELECT doc_id, pos, ([{_list(lexicon_words())}])[1 + (doc_id * 31 + pos * (doc_id % 2 * 6 + 1)) % {len(lexicon_words())}] AS tok, n FROM toks0)"""
_WORDTOKS = r"""toks AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS tok, len(l)::INT AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]|\n') AS l FROM documents))"""


def _count(k: int) -> str:
    return f"(length(m) - length(replace(m, '{k}', '')))"


_DOMINANT = "(greatest(" + ", ".join(f"CASE WHEN contains(m, '{k}') THEN {_count(k)}::BIGINT * 1000000000000 + (1000000000 - instr(m, '{k}')) * 10 + {k} ELSE 0 END" for k in range(1, 6)) + ") % 10)::INT"
_VARIETY = " + ".join(f"contains(m, '{k}')::INT" for k in range(1, 6))
_TONED_CTE = f"""tm AS (SELECT *, {_marks("tok")} AS m FROM toks),
tf AS (SELECT *, {_DOMINANT} AS tone_id, CASE WHEN length(tok) > 0 THEN length(m)::DOUBLE / length(tok) ELSE 0 END AS density, ({_VARIETY}) AS variety FROM tm),
tw AS (SELECT *, 1.0::DOUBLE + 0.5::DOUBLE * density * (1.0::DOUBLE + 0.3::DOUBLE * variety / 6.0::DOUBLE) AS w_tone FROM tf)"""
_NEAR = [f"{f}(tone_id, {i}) OVER w" for i in (1, 2) for f in ("lag", "lead")]
_PAIR = lambda x: f"({CONTRAST_FLAT})[tone_id * 6 + ({x}) + 1]"
_CONTRAST_CTE = f"""tc AS (SELECT *, {" + ".join(f"coalesce({_PAIR(x)}, 0)" for x in _NEAR)} AS c_sum, {" + ".join(f"(({x}) IS NOT NULL)::INT" for x in _NEAR)} AS c_n FROM tw WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
tx AS (SELECT *, CASE WHEN c_n > 0 THEN 1.0::DOUBLE + 0.4::DOUBLE * (c_sum / 10.0::DOUBLE) / c_n ELSE 1.0::DOUBLE END AS contrast FROM tc),
ts AS (SELECT *, w_tone * contrast AS tone_score FROM tx)"""
_TONE = f"{_TONED_CTE},\n{_CONTRAST_CTE}"

_KEYS = sorted(REDUPLICATIVE_KEYS)


def _class(tok: str) -> str:
    low = f"lower(trim({tok}))"
    return f"""CASE WHEN {low} IN ({_list(FUNCTION_WORDS)}) THEN 'function' WHEN {low} IN ({_list(_KEYS)}) THEN 'reduplicative'
  WHEN contains({low}, '_') AND list_has_any(string_split({low}, '_'), [{_list(_KEYS)}]) THEN 'reduplicative' WHEN contains({low}, '_') THEN 'compound'
  WHEN regexp_full_match({low}, '\\p{{L}}{{1,2}}') THEN 'other' ELSE 'content' END"""


def _classed(source: str, name: str = "cl") -> str:
    return f"""{name}0 AS (SELECT *, {_class("tok")} AS word_class FROM {source}),
{name} AS (SELECT *, {_case(CLASS_MULTIPLIER, "word_class")} AS f_class FROM {name}0)"""


def _edge(k: int = 2) -> str:
    return f"(pos < {k} OR pos >= n - {k})"


_RESULT = """SELECT doc_id, max(n)::BIGINT AS original_length, count(*) AS compressed_length, round(max(n)::DOUBLE / greatest(count(*), 1), 6) AS compression_ratio,
  round((max(n) - count(*))::DOUBLE / greatest(max(n), 1) * 100.0::DOUBLE, 6) AS token_savings_pct, string_agg(tok, ' ' ORDER BY pos) AS compressed_text FROM kept GROUP BY doc_id"""


def _budget(family: str = "boundary", k: int = 2) -> str:
    return f"(greatest(floor(n / 4.0::DOUBLE)::INT, {2 * k if family == 'boundary' else 1}) - {2 * k})"


def _ranked(source: str, order: str, k: int = 2) -> str:
    return f"rk AS (SELECT *, {_edge(k)} AS is_edge, row_number() OVER (PARTITION BY doc_id, {_edge(k)} ORDER BY {order}) AS rank FROM {source})"


def _kept(source: str, order: str, family: str = "boundary", k: int = 2) -> str:
    extra = f" OR {_budget(family, k)} <= 0" if family == "identity" else ""
    return f"{_ranked(source, order, k)},\nkept AS (SELECT * FROM rk WHERE is_edge OR rank <= {_budget(family, k)}{extra})"


def _top(source: str, score: str, family: str = "boundary") -> str:
    return _kept(source, f"round({score}, 9) DESC, pos", family)


def _with(*ctes: str, select: str = _RESULT) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_SEED = "md5(concat_ws(':', '42', doc_id::VARCHAR, pos::VARCHAR))"
_BASE = "bs AS (SELECT *, length(tok)::DOUBLE / (length(tok) + 4.0::DOUBLE) AS base_score FROM {0})"
_CLAMP = "least(greatest(tone_score, {0}::DOUBLE), {1}::DOUBLE)"
_BIGRAM = """pv AS (SELECT *, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM toks),
two AS (SELECT prev, tok, count(*) AS c2 FROM pv WHERE prev IS NOT NULL GROUP BY 1, 2),
one AS (SELECT prev, sum(c2)::BIGINT AS c1 FROM two GROUP BY 1),
md AS (SELECT prev, tok, round(-ln((c2 + 1.0::DOUBLE) / (c1 + (SELECT count(DISTINCT tok) FROM toks))), 6) AS s FROM two JOIN one USING (prev)),
sp AS (SELECT pv.doc_id, pv.pos, pv.tok, pv.n, coalesce(md.s, 0) AS surprisal FROM pv LEFT JOIN md ON pv.prev = md.prev AND pv.tok = md.tok)"""


def _scale(x: str, constant: str) -> str:
    low, high = f"min({x}) OVER (PARTITION BY doc_id)", f"max({x}) OVER (PARTITION BY doc_id)"
    return f"CASE WHEN {high} > {low} THEN ({x} - {low}) / ({high} - {low}) ELSE {constant} END"


def _blend(weights: tuple[float, float, float]) -> str:
    parts = [f"({_scale(c, '0.5::DOUBLE')}) * {w / sum(weights)!r}::DOUBLE" for c, w in zip(("surprisal", "tone_score", "f_class"), weights)]
    return f"bl AS (SELECT *, {' + '.join(parts)} AS blended FROM cl)"


def _over(ctes: str) -> str:
    """The tone chain over a token table by another name."""
    return ctes.replace("FROM toks)", "FROM {src})")


def _tone_from(source: str) -> str:
    return _TONE.replace("AS m FROM toks)", f"AS m FROM {source})")


_SENTENCES = r"""se AS (SELECT *, coalesce(lag((tok IN ('.', '!', '?', chr(10), '。', '！', '？'))::INT) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS e FROM sp),
sr AS (SELECT *, sum(e) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM se),
sq AS (SELECT *, run * 1000000 + (row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1) // 200 AS sent FROM sr),
sm AS (SELECT doc_id, sent, round(avg(surprisal), 6) AS mean FROM sq GROUP BY 1, 2),
so AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mean DESC, sent) AS srank, count(*) OVER (PARTITION BY doc_id) AS n_sent FROM sm),
sf AS (SELECT sq.*, n_sent, greatest(floor(n / 4.0::DOUBLE)::INT, 1) AS goal FROM sq JOIN so USING (doc_id, sent) WHERE n_sent < 4 OR srank <= greatest(3, greatest(floor(n / 4.0::DOUBLE)::INT, 1) // 50))"""

_PARTNER = "coalesce(" + ", ".join(
    f"CASE WHEN concat(tok, '_', lead(tok, {i}) OVER w) IN ({_list(f'{a}_{b}' for a, b in REDUPLICATIVE_PAIRS)}) AND lead(tok, {i}) OVER w IS NOT NULL THEN pos + {i} END" for i in (1, 2, 3)
) + ")"
_PAIRS = f"pp AS (SELECT *, {_PARTNER} AS partner FROM {{0}} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"

_JOINED = [f"concat_ws('_', {', '.join(['tok'] + [f'lead(tok, {i}) OVER w' for i in range(1, size)])})" for size in range(2, MAX_PARTS + 1)]
_LENGTH = "CASE " + " ".join(
    f"WHEN lead(tok, {size - 1}) OVER w IS NOT NULL AND {_JOINED[size - 2]} IN ({_list(sorted(w for w in WORD_LIST if '_' in w))}) THEN {size}" for size in range(MAX_PARTS, 1, -1)
) + " ELSE 1 END"
_CLEAN = "lower(trim(regexp_replace(trim(tok), '^▁?Ġ?(##)?_?', '')))"
#: Greedy matching as a walk: each document's next free place follows from the last.
_SEGMENT = f"""ck AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, tok FROM (SELECT doc_id, pos, {_CLEAN} AS tok FROM toks) WHERE tok <> ''),
ml AS (SELECT *, {_LENGTH} AS len FROM ck WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ag AS (SELECT doc_id, list(len ORDER BY pos) AS lens, list(tok ORDER BY pos) AS ts FROM ml GROUP BY doc_id),
wk(doc_id, start) AS (SELECT doc_id, 0::BIGINT FROM ag UNION ALL SELECT wk.doc_id, wk.start + ag.lens[wk.start + 1] FROM wk JOIN ag USING (doc_id) WHERE wk.start + ag.lens[wk.start + 1] < len(ag.lens)),
sg AS (SELECT doc_id, start, array_to_string(ts[start + 1 : start + lens[start + 1]], '_') AS word, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS word_no FROM wk JOIN ag USING (doc_id))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _map(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + " END"


def _norm(tok: str) -> str:
    low = f"lower(trim({tok}))"
    return f"coalesce({_map(TEENCODE, low)}, {_map(DIALECT, low)}, {low})"


_EXTENDED = [*FUNCTION_WORDS, *sorted({k for t in (TEENCODE, DIALECT) for k, v in t.items() if v in set(FUNCTION_WORDS)})]


def _critical(tok: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({tok}, {_q(p)})" for p in CRITICAL) + ")"


def _syllable(tok: str) -> str:
    first = f"substr(regexp_replace(lower(trim({tok})), '[^{_MARK_FROM}]', '', 'g'), 1, 1)"
    return f"CASE WHEN {first} = '' THEN 'ngang' ELSE ([{_list(TONES)}])[try_cast(translate({first}, '{_MARK_FROM}', '{_MARK_TO}') AS INT) + 1] END"


def _sino(w: str) -> str:
    a, b = f"split_part({w}, '_', 1)", f"split_part({w}, '_', 2)"
    return f"(len(string_split({w}, '_')) = 2 AND {a} <> {b} AND length({w}) >= 6 AND {a} IN ({_list(SINO_MORPHEMES)}) AND {b} IN ({_list(SINO_MORPHEMES)}))"


def _is_vi(text: str) -> str:
    letters = rf"length(regexp_replace({text}, '\P{{L}}', '', 'g'))"
    own = f"length(regexp_replace({text}, '[^{VIETNAMESE}]', '', 'g'))"
    return f"coalesce(CASE WHEN {letters} > 0 THEN {own}::DOUBLE / {letters} >= 0.1::DOUBLE END, FALSE)"


_EVERY, _EVERY_DIGIT = "".join(CHAR_TONE), "".join(map(str, CHAR_TONE.values()))
_DIGITS = f"translate(regexp_replace(text, '(?s)[^{_EVERY}]', 'a', 'g'), '{_EVERY}', '{_EVERY_DIGIT}')"

_ORDERS = {"first": "pos", "longest": "length(tok) DESC, pos", "tone_only": "round(tone_score, 9) DESC, pos", "random": f"{_SEED}, pos"}
_EVALUATED = _ORDERS | {"combined": "round(0.5::DOUBLE * tone_score + 0.5::DOUBLE * f_class, 9) DESC, pos"}
_GRID = (
    _TOKS
    + ",\n"
    + _TONE
    + ",\ngr AS (SELECT *, "
    + f"{_edge()} AS is_edge, "
    + ", ".join(f"row_number() OVER (PARTITION BY doc_id, {_edge()} ORDER BY {o}) AS r_{m}" for m, o in _ORDERS.items())
    + " FROM ts),\ngrid AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, max(n) AS n, count_if(length(m) > 0) AS toned, '{m}' AS method, {r}::DOUBLE AS ratio, count_if(k) AS kept, count_if(k AND length(m) > 0) AS toned_kept FROM (SELECT *, is_edge OR r_{m} <= greatest(floor(n / {r}::DOUBLE)::INT, 4) - 4 AS k FROM gr) GROUP BY doc_id"
        for m in _ORDERS
        for r in (2.0, 4.0, 8.0)
    )
    + ")"
)
_TURNS = """tp AS (SELECT conv_id, turn, role, text AS pred, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role) AS ref FROM conversations),
pairs AS (SELECT * FROM tp WHERE ref IS NOT NULL)"""
_MORPH = f"{{0}} AS (SELECT *, {_edge()} AS is_edge, " + ", ".join(f"row_number() OVER (PARTITION BY doc_id, {_edge()} ORDER BY {o}) AS r_{m}" for m, o in _EVALUATED.items()) + (
    f", row_number() OVER (PARTITION BY doc_id, {_edge()}, word_class ORDER BY {_SEED}) AS r_class, count(*) OVER (PARTITION BY doc_id, {_edge()}, word_class) AS c FROM cl)"
)


def _cells_of(ratios: str) -> str:
    """Kept tokens of every method at every ratio."""
    keeps = {m: f"is_edge OR r_{m} <= greatest(floor(n / ratio)::INT, 4) - 4" for m in _EVALUATED} | {"morph_only": f"is_edge OR r_class <= floor(c * {_case(CLASS_KEEP, 'word_class')})", "none": "TRUE"}
    return "un AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, ratio, doc_id, pos, tok, n, m FROM mq, (SELECT unnest([{ratios}])::DOUBLE AS ratio) WHERE {k}" for m, k in keeps.items()) + ")"


#: The subsequence is the longest increasing run of the reference's places that the answer's words meet, latest place first.
_SAMPLES = _TURNS + ",\nsm AS (SELECT conv_id || ':' || turn AS doc_id, role AS task, pred AS text, ref FROM pairs)"
_ROWS = _with(
    _SAMPLES,
    _TOKS.replace("FROM documents", "FROM sm"),
    _TONE,
    _classed("ts"),
    _MORPH.format("mq"),
    _cells_of("2.0, 4.0, 8.0"),
    "kp AS (SELECT *, lower(tok) AS w, row_number() OVER (PARTITION BY doc_id, method, ratio ORDER BY pos) AS i FROM un)",
    f"rl AS (SELECT doc_id, task, ref, {_words('lower(ref)')} AS b FROM sm)",
    "rf AS (SELECT doc_id, generate_subscripts(b, 1) AS j, unnest(b) AS w FROM rl)",
    "mt AS (SELECT doc_id, method, ratio, list([j] ORDER BY i, j DESC) AS ms FROM kp JOIN rf USING (doc_id, w) GROUP BY ALL)",
    "ll AS (SELECT doc_id, method, ratio, len(list_reduce(list_prepend([]::BIGINT[], ms), lambda t, x: list_concat(list_concat(t[1 : len(list_filter(t, lambda y: y < x[1]))], x), t[len(list_filter(t, lambda y: y < x[1])) + 2 :]))) AS common FROM mt)",
    "kl AS (SELECT doc_id, method, ratio, max(n) AS n, list(w ORDER BY i) AS a, string_agg(tok, ' ' ORDER BY i) AS answer, count_if(length(m) > 0) AS toned_kept FROM kp GROUP BY ALL)",
    "tn AS (SELECT doc_id, count_if(length(m) > 0) AS toned FROM ts GROUP BY 1)",
    "ga AS (SELECT doc_id, method, ratio, k, a[i : i + k - 1] AS g, count(*) AS c FROM kl, range(1, 5) r(k), range(1, len(a) - k + 2) s(i) GROUP BY ALL)",
    "gb AS (SELECT doc_id, k, b[i : i + k - 1] AS g, count(*) AS c FROM rl, range(1, 5) r(k), range(1, len(b) - k + 2) s(i) GROUP BY ALL)",
    "gh AS (SELECT doc_id, method, ratio, k, sum(least(ga.c, coalesce(gb.c, 0)))::DOUBLE AS h, sum(ga.c)::DOUBLE AS t FROM ga LEFT JOIN gb USING (doc_id, k, g) GROUP BY ALL)",
    "gz AS (SELECT *, sum((h = 0)::INT) OVER (PARTITION BY doc_id, method, ratio ORDER BY k) AS z FROM gh)",
    "bu AS (SELECT doc_id, method, ratio, CASE WHEN count(*) = 4 AND max(h) > 0 THEN exp(sum(ln(CASE WHEN h > 0 THEN h / t ELSE 1.0::DOUBLE / (pow(2, z) * t) END)) / 4) ELSE 0 END AS b FROM gz GROUP BY ALL)",
    "br AS (SELECT kl.*, task, toned, coalesce(common, 0) AS common, len(a) AS np, len(rl.b) AS nr, coalesce(bu.b, 0) * CASE WHEN len(a) >= len(rl.b) THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE - len(rl.b)::DOUBLE / len(a)) END AS bleu, (lower(trim(answer)) = lower(trim(ref)))::INT::DOUBLE AS em FROM kl JOIN rl USING (doc_id) JOIN tn USING (doc_id) LEFT JOIN ll USING (doc_id, method, ratio) LEFT JOIN bu USING (doc_id, method, ratio))",
    "bs AS (SELECT *, n::DOUBLE / np AS compression_ratio, (n - np)::DOUBLE / n * 100.0::DOUBLE AS ts_pct, common::DOUBLE / np AS p, common::DOUBLE / greatest(nr, 1) AS r, CASE WHEN toned > 0 THEN toned_kept::DOUBLE / toned END AS tr FROM br)",
    "bt AS (SELECT *, CASE WHEN common > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0 END AS f1, ts_pct / 100.0::DOUBLE AS e FROM bs)",
    "bq AS (SELECT *, 0.4::DOUBLE * f1 + 0.2::DOUBLE * bleu + 0.4::DOUBLE * em AS q FROM bt)",
    "ce AS (SELECT method, task, ratio, avg(compression_ratio) AS cr, avg(ts_pct) AS ts, avg(f1) AS rl, avg(bleu) AS bl, avg(em) AS em, avg(q) AS q, avg(e) AS e, avg(tr) AS tr, count(*) AS num FROM bq GROUP BY ALL)",
    "su AS (SELECT method, avg(q) AS q, avg(e) AS e FROM ce GROUP BY method)",
    select="",
)
_QUALITY = "SELECT doc_id, task, method, ratio, round(compression_ratio, 6) AS compression_ratio, round(f1, 6) AS rouge_l_f1, round(p, 6) AS rouge_l_precision, round(r, 6) AS rouge_l_recall, round(bleu, 6) AS bleu_score, round(q, 6) AS quality, em AS exact_match FROM bq"
_DEMO = "sm AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(t)}, {_q(c)}, {_q(r)})" for i, (t, c, _, r) in enumerate(DEMO_SAMPLES)) + ") v(doc_id, task, text, ref))"
_H = "2.0::DOUBLE * q * e / (q + e + 1e-8::DOUBLE)"

_CHARS = "list_distinct(list_filter(string_split({0}, ''), lambda x: x <> ''))"
_VEC = [f"length(regexp_replace(lower(tok), '[^{c}]', '', 'g'))" for c in "aeiounrst"]
_ATTN = """vec AS (SELECT floor(vec_id / 40)::BIGINT AS doc_id, (vec_id % 40)::INT AS p, embedding FROM embeddings),
attn AS (SELECT q.doc_id, (c // 2)::INT AS layer, (c % 2)::INT AS head, q.p AS q_pos, k.p AS k_pos, q.embedding[c + 1]::DOUBLE * k.embedding[c + 1]::DOUBLE AS w
  FROM vec q JOIN vec k USING (doc_id), range(16) r(c) WHERE k.p <= q.p),
ly AS (SELECT doc_id, max(layer) + 1 AS n_layers, max(q_pos) + 1 AS n_q FROM attn GROUP BY 1),
me AS (SELECT doc_id, head, q_pos, k_pos, avg(w) AS w FROM attn JOIN ly USING (doc_id) WHERE layer >= n_layers - greatest(n_layers // 4, 1) AND q_pos >= n_q - 32 GROUP BY ALL),
im AS (SELECT doc_id, head, k_pos, sum(w) AS importance FROM me GROUP BY ALL)"""
_KEEP_ALL = _with(_TOKS, "kept AS (SELECT * FROM toks)")

_TRAINING = (
    _TOKS,
    _TONED_CTE,
    "t1 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM tw WHERE pos < 512)",
    "t2 AS (SELECT *, greatest(floor(c / 4.0::DOUBLE)::INT, 1) AS goal, pos < 2 OR pos >= c - 2 AS is_edge FROM t1 WHERE c >= 10)",
    f"t3 AS (SELECT *, CASE WHEN goal <= 4 THEN pos < goal ELSE is_edge OR row_number() OVER (PARTITION BY doc_id, is_edge ORDER BY {_SEED}) <= goal - 4 END AS keep FROM t2)",
)

ORACLES: dict[str, str] = {
    "tok_stats": _with(_TOKS, select="SELECT doc_id, count(*) AS n_tokens, sum(length(tok))::BIGINT AS n_chars, max(length(tok))::INT AS longest FROM toks GROUP BY doc_id"),
    "tone_features": _with(
        _TOKS.replace("toks AS", "tk AS", 1),
        "toks AS (SELECT tok, count(*) AS n_used FROM tk GROUP BY tok)",
        _TONED_CTE,
        select=f"SELECT tok, n_used, tone_id, ([{_list(TONES)}])[tone_id + 1] AS tone, round(density, 9) AS density, variety::INT AS variety, round(w_tone, 9) AS w_tone FROM tw",
    ),
    "token_analysis": _with(
        _TOKS,
        _TONE,
        f"ta AS (SELECT tok AS token, array_to_string(list_transform(list_filter(string_split(m, ''), lambda c: c <> ''), lambda c: ([{_list(TONES)}])[c::INT + 1]), ',') AS tones_present, ([{_list(TONES)}])[tone_id + 1] AS dominant_tone, round(density, 9) AS tone_density, variety::INT AS tone_variety, round(tone_score, 6) AS preservation_weight FROM ts)",
        select="SELECT *, count(*) AS n_used FROM ta GROUP BY ALL",
    ),
    "tone_sequence": f"SELECT doc_id, md5({_DIGITS}) AS digits_md5, length(regexp_replace({_DIGITS}, '0', '', 'g'))::INT AS n_toned FROM documents",
    "tone_contrast": _with(_TOKS, _TONE, select="SELECT doc_id, round(avg(contrast), 6) AS mean_contrast, round(max(contrast), 6) AS max_contrast, round(sum(tone_score), 4) AS sum_score FROM ts GROUP BY doc_id"),
    "is_vietnamese": f"SELECT doc_id, {_is_vi('substr(text, 1, 500)')} AS by_prefix, {_is_vi('text')} AS by_text FROM documents",
    "strip_tone": f"SELECT doc_id, md5(translate(text, '{STRIP_FROM}{STRIP_DELETE}', '{STRIP_TO}')) AS stripped_md5 FROM documents",
    "syllable_tone": _with(_TOKS, select=f"SELECT tok, {_syllable('tok')} AS tone FROM (SELECT DISTINCT tok FROM toks)"),
    "tone_of_characters": f"SELECT char, count(*) AS n_used, CASE WHEN contains('{_EVERY}', char) THEN translate(char, '{_EVERY}', '{_EVERY_DIGIT}')::INT END AS tone_id FROM (SELECT unnest(string_split(text, '')) AS char FROM documents) WHERE char <> '' GROUP BY char",
    "word_class_dist": _with(_LEX, _classed("toks"), select="SELECT doc_id, " + ", ".join(f"count_if(word_class = '{c}') AS \"{c}\"" for c in CLASS_KEEP) + " FROM cl GROUP BY doc_id"),
    "word_class_of_tokens": _with(_TOKS, "tk AS (SELECT tok, count(*) AS n_used FROM toks GROUP BY tok)", _classed("tk"), select=f"SELECT tok, n_used, word_class, f_class AS multiplier, {_case(CLASS_KEEP, 'word_class')} AS keep FROM cl"),
    "redup_pairs": _with(_LEX, _PAIRS.format("toks"), select="SELECT doc_id, pos AS left_pos, partner AS right_pos FROM pp WHERE partner IS NOT NULL"),
    "word_normalize": _with(_LEX, select=f"SELECT tok, count(*) AS n_used, {_norm('tok')} AS norm FROM toks GROUP BY tok"),
    "func_word_ext": _with(_LEX, select=f"SELECT doc_id, count_if(lower(trim(tok)) IN ({_list(_EXTENDED)})) AS n_function, count(*) AS n_tokens FROM toks GROUP BY doc_id"),
    "critical_tokens": _with(_TOKS, select=f"SELECT doc_id, count_if({_critical('tok')}) AS n_critical, count(*) AS n_tokens FROM toks GROUP BY doc_id"),
    "critical_urls": f"SELECT page_id, {_critical('url')} AS is_critical FROM pages",
    "sino_compounds": f"SELECT c AS compound, {_sino('c')} AS is_sino FROM (SELECT a || '_' || b AS c FROM unnest([{_list(SINO_MORPHEMES)}]) x(a), unnest([{_list(SINO_MORPHEMES)}]) y(b) WHERE a <> b) WHERE length(c) >= 6",
    "word_segment": _recursive(_with(_LEX, _SEGMENT, select="SELECT doc_id, count(*) AS n_words, count_if(contains(word, '_')) AS n_joined, sum(start * (length(word) + 1))::BIGINT AS checksum FROM sg GROUP BY doc_id")),
    "segment_text": _recursive(
        _with(_TOKS, _SEGMENT.replace(f"{_CLEAN} AS tok", "lower(tok) AS tok"), select="SELECT doc_id, count(*) AS n_words, sum((word_no + 1) * length(word))::BIGINT AS checksum FROM sg GROUP BY doc_id")
    ),
    "align_spans": _recursive(
        _with(
            _LEX,
            _SEGMENT,
            "ns AS (SELECT doc_id, max(n) AS n FROM toks GROUP BY 1)",
            "al AS (SELECT doc_id, n, len(string_split(word, '_')) AS parts, sum(len(string_split(word, '_'))) OVER (PARTITION BY doc_id ORDER BY word_no) AS e FROM sg JOIN ns USING (doc_id))",
            select="SELECT doc_id, sum(e - parts)::BIGINT AS sum_start, sum(least(e, n))::BIGINT AS sum_end, max(least(e, n))::INT AS last_end FROM al GROUP BY doc_id",
        )
    ),
    "word_analysis": _recursive(
        _with(
            _LEX,
            _SEGMENT,
            f"an AS (SELECT word, {_norm('word')} AS norm, {_critical('word')} AS crit FROM sg)",
            f"ac AS (SELECT norm, {_syllable('norm')} AS tone, CASE WHEN crit THEN 'CRITICAL' WHEN lower(trim(norm)) IN ({_list(_EXTENDED)}) THEN 'FUNC' WHEN {_sino('norm')} THEN 'SINO' ELSE 'CONTENT' END AS word_class FROM an)",
            select=f"SELECT norm, tone, word_class, {_case(ENHANCED_MULTIPLIER, 'word_class')} AS multiplier, count(*) AS n_words FROM ac GROUP BY ALL",
        )
    ),
    "compress_none": _KEEP_ALL,
    "compress_first": _with(_TOKS, _kept("toks", "pos")),
    "compress_every_nth": _with(
        _TOKS,
        f"st AS (SELECT *, {_budget()} AS b, greatest((n - 4) // greatest({_budget()}, 1), 1) AS step FROM toks)",
        f"kept AS (SELECT * FROM st WHERE {_edge()} OR ((pos - 2) % step = 0 AND (pos - 2) // step < b))",
    ),
    "compress_longest": _with(_TOKS, _kept("toks", "length(tok) DESC, pos")),
    "compress_random": _with(_TOKS, _kept("toks", _SEED)),
    "compress_tone": _with(_TOKS, _TONE, _top("ts", "tone_score")),
    "compress_combined": _with(_TOKS, _TONE, _classed("ts"), _top("cl", "(0.5::DOUBLE * tone_score + 0.5::DOUBLE * f_class)")),
    "compress_combined_lexicon": _with(_LEX, _TONE, _classed("ts"), _top("cl", "(0.5::DOUBLE * tone_score + 0.5::DOUBLE * f_class)")),
    "compress_morph_quota": _with(
        _LEX,
        _classed("toks"),
        f"mq AS (SELECT *, {_edge()} AS is_edge, row_number() OVER (PARTITION BY doc_id, {_edge()}, word_class ORDER BY {_SEED}) AS rank, count(*) OVER (PARTITION BY doc_id, {_edge()}, word_class) AS c FROM cl)",
        f"kept AS (SELECT * FROM mq WHERE is_edge OR rank <= floor(c * {_case(CLASS_KEEP, 'word_class')}))",
    ),
    "compress_tone_aware": _with(
        _TOKS,
        _TONE,
        _BASE.format("ts"),
        f"vi AS (SELECT doc_id, {_is_vi('substr(text, 1, 500)')} AS is_vi FROM documents)",
        f"sc AS (SELECT *, CASE WHEN is_vi THEN base_score * {_CLAMP.format(0.5, 3.0)} ELSE base_score END AS score FROM bs JOIN vi USING (doc_id))",
        _top("sc", "score", "identity"),
    ),
    "compress_morph_aware": _with(
        _LEX,
        _classed("toks"),
        _BASE.format("cl"),
        _PAIRS.format("bs"),
        "pr AS (SELECT *, " + " OR ".join(f"coalesce(lag(partner, {i}) OVER w = pos, FALSE)" for i in (1, 2, 3)) + f" AS is_right, {_edge()} AS is_edge FROM pp WINDOW w AS (PARTITION BY doc_id ORDER BY pos))",
        f"sc AS (SELECT *, round(base_score * CASE WHEN is_right THEN 0.1::DOUBLE WHEN partner IS NOT NULL THEN least(f_class * 1.5::DOUBLE, 3.0::DOUBLE) ELSE f_class END, 9) AS score, count(*) OVER (PARTITION BY doc_id, is_edge, word_class) * {_case(CLASS_KEEP, 'word_class')} AS weight, 0.0::DOUBLE + "
        + " + ".join(f"sum((word_class = '{c}')::BIGINT) OVER (PARTITION BY doc_id, is_edge) * {v!r}::DOUBLE" for c, v in CLASS_KEEP.items())
        + " AS total FROM pr)",
        "ra AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_edge, word_class ORDER BY score DESC, pos) AS rank FROM sc)",
        f"kept AS (SELECT * FROM ra WHERE is_edge OR (rank <= floor(greatest({_budget('identity')}, 0) * weight / greatest(total, 1.0::DOUBLE)) AND NOT is_right))",
    ),
    "compress_combined_base": _with(_TOKS, _TONE, _classed("ts"), _BASE.format("cl"), _top("bs", f"(base_score * (0.5::DOUBLE * {_CLAMP.format(0.5, 3.0)} + 0.5::DOUBLE * f_class))", "identity")),
    "compress_enhanced": _with(_TOKS, _BIGRAM, _tone_from("sp"), _classed("ts"), _blend((0.4, 0.3, 0.3)), _top("bl", "blended", "identity")),
    "compress_enhanced_no_scorer": _with(_TOKS, "sp AS (SELECT *, 0.5::DOUBLE AS surprisal FROM toks)", _tone_from("sp"), _classed("ts"), _blend((0.0, 0.5, 0.5)), _top("bl", "blended", "identity")),
    "compress_scorer": _with(
        _TOKS,
        _BIGRAM,
        _tone_from("sp"),
        _classed("ts"),
        f"s1 AS (SELECT *, 0.4::DOUBLE * ({_scale('surprisal', '0.5::DOUBLE')}) + 0.3::DOUBLE * tone_score + 0.3::DOUBLE * (CASE WHEN max(f_class) OVER (PARTITION BY doc_id) > min(f_class) OVER (PARTITION BY doc_id) THEN 0.5::DOUBLE + 0.5::DOUBLE * (f_class - min(f_class) OVER (PARTITION BY doc_id)) / (max(f_class) OVER (PARTITION BY doc_id) - min(f_class) OVER (PARTITION BY doc_id)) ELSE f_class END) AS summed FROM cl)",
        f"s2 AS (SELECT *, {_scale('summed', '0.5::DOUBLE')} AS final FROM s1)",
        _top("s2", "final", "identity"),
    ),
    "compress_scorer_select": _with(
        _TOKS,
        _TONE,
        _BASE.format("ts"),
        f"b2 AS (SELECT *, {_scale('base_score', 'base_score')} AS base FROM bs)",
        _ranked("b2", f"round(base * {_CLAMP.format(1.0, 3.0)}, 9) DESC, pos", 1),
        "kept AS (SELECT * FROM rk WHERE is_edge OR rank <= floor(n / 4.0::DOUBLE) - 2 OR floor(n / 4.0::DOUBLE) >= n)",
    ),
    "sentence_filter": _with(_WORDTOKS, _BIGRAM, _SENTENCES, select="SELECT doc_id, count(*) AS n_kept, max(n)::INT AS n_tokens, sum(pos)::BIGINT AS sum_pos, max(n_sent)::INT AS n_sentences FROM sf GROUP BY doc_id"),
    "compress_llmlingua": _with(
        _WORDTOKS,
        _BIGRAM,
        _SENTENCES,
        "l1 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM sf)",
        "lp AS (SELECT *, i < 2 OR i >= m - 2 AS is_edge, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l1)",
        "l2 AS (SELECT lp.*, CASE WHEN i = 0 THEN 0 ELSE round(-ln((coalesce(c2, 0) + 1.0::DOUBLE) / (coalesce(c1, 0) + (SELECT count(DISTINCT tok) FROM toks))), 6) END AS again FROM lp LEFT JOIN two ON two.prev = lp.prev AND two.tok = lp.tok LEFT JOIN one ON one.prev = lp.prev)",
        "l3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_edge ORDER BY again DESC, pos) AS rank FROM l2)",
        "kept AS (SELECT * FROM l3 WHERE is_edge OR m <= goal * 1.5::DOUBLE OR greatest(goal - 4, 0) <= 0 OR rank <= goal - 4)",
    ),
    "compress_streamingllm": _with(
        _TOKS,
        "si AS (SELECT *, CASE WHEN pos < 4 THEN 1.0 WHEN pos >= n - least(32, greatest(n - 4, 0)) THEN 0.8 ELSE 0.1 END AS importance FROM toks)",
        _ranked("si", "importance DESC, pos"),
        "kept AS (SELECT * FROM rk WHERE is_edge OR rank <= least(512, greatest(floor(n / 4.0::DOUBLE)::INT, 1)) - 4 OR least(512, greatest(floor(n / 4.0::DOUBLE)::INT, 1)) - 4 <= 0)",
    ),
    "compress_snapkv": _with(
        _TOKS,
        "hd AS (SELECT toks.*, head, ('0x' || substr(md5(concat_ws(':', tok, head::VARCHAR)), 1, 4))::INT::DOUBLE / 65536.0::DOUBLE AS raw FROM toks, range(3) r(head))",
        "po AS (SELECT *, max(raw) OVER (PARTITION BY doc_id, head ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS pooled FROM hd)",
        f"rh AS (SELECT *, {_edge()} AS is_edge, row_number() OVER (PARTITION BY doc_id, head, {_edge()} ORDER BY round(pooled, 9) DESC, pos) AS rank FROM po)",
        "kept AS (SELECT DISTINCT doc_id, pos, tok, n FROM rh WHERE is_edge OR rank <= least(512, greatest(floor(n / 4.0::DOUBLE)::INT, 1)) - 4 OR least(512, greatest(floor(n / 4.0::DOUBLE)::INT, 1)) - 4 <= 0)",
    ),
    "snapkv_pool": _with(
        _ATTN,
        select="SELECT doc_id, head, k_pos, round(importance, 5) AS importance, round(max(importance) OVER w, 5) AS pooled_max, round(sum(importance) OVER w / 5.0::DOUBLE, 5) AS pooled_avg FROM im WINDOW w AS (PARTITION BY doc_id, head ORDER BY k_pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    ),
    "h2o_importance": _with(_ATTN, select="SELECT doc_id, k_pos, round(avg(importance), 5) AS importance FROM im GROUP BY ALL"),
    "compress_selective": _with(
        _TOKS,
        "ve AS (SELECT *, " + ", ".join(f"{x} AS v{i}" for i, x in enumerate(_VEC)) + " FROM toks)",
        "vq AS (SELECT *, " + ", ".join(f"sum(CASE WHEN pos < 16 THEN v{i} END) OVER (PARTITION BY doc_id) AS q{i}" for i in range(9)) + " FROM ve)",
        "vn AS (SELECT *, "
        + " + ".join(f"v{i} * q{i}" for i in range(9))
        + " AS dot, ("
        + " + ".join(f"v{i} * v{i}" for i in range(9))
        + ") * ("
        + " + ".join(f"q{i} * q{i}" for i in range(9))
        + ") AS norm FROM vq)",
        "vs AS (SELECT *, CASE WHEN norm > 0 THEN round(dot::DOUBLE / sqrt(norm::DOUBLE), 6) ELSE 0 END AS similarity FROM vn)",
        _top("vs", "similarity", "identity"),
    ),
    "evaluate_methods": _with(
        _TOKS,
        _TONE,
        _classed("ts"),
        _MORPH.format("mq"),
        _cells_of("4.0"),
        select="SELECT method, ratio, count(DISTINCT doc_id) AS n_docs, count(*) AS n_kept, (sum(length(tok) + 1) - count(DISTINCT doc_id))::BIGINT AS n_chars FROM un WHERE method <> 'none' GROUP BY method, ratio",
    ),
    "tone_names": f"SELECT doc_id, md5(array_to_string(list_transform(string_split({_DIGITS}, ''), lambda c: ([{_list(TONES)}])[c::INT + 1]), ',')) AS names_md5 FROM documents WHERE text <> ''",
    "decoded_pieces": _with(
        _LEX,
        "pc AS (SELECT (['▁', 'Ġ', '##', '_', ''])[pos % 5 + 1] || tok AS tok FROM toks)",
        select=f"SELECT tok AS piece, count(*) AS n_used, trim(translate(tok, '▁Ġ', '  ')) AS decoded, {_CLEAN} AS cleaned FROM pc GROUP BY tok",
    ),
    "effective_ratio": _with(
        _TOKS,
        _kept("toks", "pos"),
        "pd AS (SELECT doc_id, max(n)::DOUBLE AS n, round(max(n)::DOUBLE / greatest(count(*), 1), 6) AS r FROM kept GROUP BY doc_id)",
        "pl AS (SELECT lang, avg(r) AS r, avg(n) AS n FROM pd JOIN documents USING (doc_id) GROUP BY lang)",
        select="SELECT lang, round(r, 6) AS ratio, round(n / (SELECT n FROM pl WHERE lang = 'en'), 6) AS tir, round(r / (n / (SELECT n FROM pl WHERE lang = 'en')), 6) AS effective FROM pl",
    ),
    "ratio_grid": _with(_GRID, select="SELECT doc_id, n, toned, method, ratio, kept, toned_kept FROM grid"),
    "length_ratio_rollup": _with(_GRID, select="SELECT method, ratio, sum(kept)::BIGINT AS kept, sum(n)::BIGINT AS n, count(*) AS rows FROM grid GROUP BY ROLLUP (method, ratio)"),
    "demo_bench": _ROWS.replace(_SAMPLES, _DEMO) + _QUALITY,
    "sample_counts": f"WITH {_DEMO} SELECT task, count(*) AS num_samples FROM sm GROUP BY ROLLUP (task)",
    "compress_selective_no_query": _with(_TOKS, _kept("toks", _SEED, "identity")),
    "bench_samples": _ROWS + _QUALITY,
    "bench_cells": _ROWS
    + "SELECT method, task, ratio, round(cr, 6) AS mean_compression_ratio, round(ts, 6) AS mean_token_savings_pct, round(rl, 6) AS mean_rouge_l_f1, round(bl, 6) AS mean_bleu, round(em, 6) AS exact_match_rate, round(q, 6) AS mean_quality_score, round(e, 6) AS mean_efficiency_score, round(tr, 6) AS mean_tone_preservation_rate, num AS num_samples FROM ce",
    "bench_summary": _ROWS + f"SELECT method, round(q, 6) AS avg_quality, round(e, 6) AS avg_efficiency, round({_H}, 6) AS harmonized_score FROM su",
    "bench_rounded": _ROWS + "SELECT format('{}@{:.0f}x', method, ratio) AS name, round_even(avg(compression_ratio), 2) AS mean_cr, round_even(avg(ts_pct), 1) AS mean_ts FROM bq GROUP BY method, ratio",
    "bench_report": _ROWS + f"SELECT printf('| %s | %.4f | %.4f | %.4f |', method, q, e, {_H}) AS line FROM su",
    "method_bench": _with(
        _TOKS,
        _TONE,
        _classed("ts"),
        _MORPH.format("mq"),
        _cells_of("2.0, 4.0, 6.0, 8.0"),
        "dc AS (SELECT method, ratio, doc_id, round(max(n)::DOUBLE / count(*), 6) AS cr, round((max(n) - count(*))::DOUBLE / max(n) * 100.0::DOUBLE, 6) AS ts FROM un WHERE method <> 'none' GROUP BY ALL)",
        select="SELECT format('{}@{:.1f}x', method, ratio) AS name, round_even(avg(cr), 2) AS avg_compression_ratio, round_even(avg(ts), 1) AS avg_token_savings_pct, count(*) AS num_samples FROM dc GROUP BY method, ratio",
    ),
    "ngram_surprisal": _with(_TOKS, _BIGRAM, select="SELECT doc_id, round(sum(surprisal), 3) AS sum_surprisal, max(surprisal) AS max_surprisal FROM sp GROUP BY doc_id"),
    "chunked_surprisal": _with(
        _TOKS,
        _BIGRAM,
        "ch AS (SELECT *, CASE WHEN pos % 512 = 0 AND pos < n - 1 THEN lead(surprisal) OVER (PARTITION BY doc_id ORDER BY pos) ELSE surprisal END AS c FROM sp)",
        select="SELECT doc_id, round(sum(c), 3) AS sum_chunked, count_if(c <> surprisal) AS n_moved FROM ch GROUP BY doc_id",
    ),
    "minmax_blend": _with(_TOKS, _BIGRAM, _tone_from("sp"), _classed("ts"), _blend((0.4, 0.3, 0.3)), select="SELECT doc_id, round(avg(blended), 5) AS mean_blended, round(max(blended), 5) AS max_blended FROM bl GROUP BY doc_id"),
    "retention_report": _with(
        _TOKS,
        _TONE,
        _classed("ts"),
        _ranked("cl", "round(tone_score, 9) DESC, pos"),
        f"kp AS (SELECT *, is_edge OR rank <= {_budget()} AS k FROM rk)",
        select="SELECT doc_id, "
        + ", ".join(f"count_if({c}) AS {n}_before, count_if({c} AND k) AS {n}_after" for n, c in (("content", "word_class = 'content'"), ("function", "word_class = 'function'"), ("toned", "length(m) > 0")))
        + " FROM kp GROUP BY doc_id",
    ),
    "tone_preservation": _with(
        _TOKS,
        _TONE,
        _ranked("ts", "round(tone_score, 9) DESC, pos"),
        f"kp AS (SELECT *, is_edge OR rank <= {_budget()} AS k FROM rk)",
        "tp AS (SELECT doc_id, count_if(length(m) > 0) AS toned_tokens, sum(CASE WHEN k THEN length(m) END)::BIGINT AS toned_chars_kept, count_if(k AND length(m) > 0) AS toned_tokens_kept FROM kp GROUP BY doc_id)",
        select="SELECT *, round(CASE WHEN toned_tokens > 0 THEN toned_chars_kept::DOUBLE / toned_tokens ELSE 1 END, 6) AS tone_char_token_rate, round(CASE WHEN toned_tokens > 0 THEN toned_tokens_kept::DOUBLE / toned_tokens ELSE 1 END, 6) AS tone_token_rate FROM tp",
    ),
    "speedup": _with(
        _TOKS, _TONE, _top("ts", "tone_score"), "sl AS (SELECT doc_id, max(n)::DOUBLE AS n, count(*)::DOUBLE AS m FROM kept GROUP BY 1)", select="SELECT doc_id, round((n + 32 * (20 + n * 0.001::DOUBLE)) / (m + 32 * (20 + m * 0.001::DOUBLE)), 6) AS speedup FROM sl"
    ),
    "layer_budgets": _with(
        _TOKS,
        "bg AS (SELECT doc_id, greatest(floor(count(*) / 4.0::DOUBLE)::INT, 32) AS g FROM toks GROUP BY 1)",
        "sh AS (SELECT i, 1.0::DOUBLE - 0.3::DOUBLE * i / 32 AS s FROM range(32) r(i))",
        "lb AS (SELECT doc_id, g, i, greatest(1, floor(g * s / (SELECT sum(s ORDER BY i) FROM sh))::INT) AS b FROM bg, sh)",
        select="SELECT doc_id, max(b) FILTER (i = 0) AS first, max(b) FILTER (i = 31) AS last, sum(b)::INT AS total, max(g) // 32 AS even FROM lb GROUP BY doc_id",
    ),
    "kv_saved": _with(_TOKS, _kept("toks", "pos"), select="SELECT doc_id, (max(n) - count(*)) * 16384 AS kv_bytes_saved, max(n)::BIGINT * 524288 AS kv_cache_bytes FROM kept GROUP BY doc_id"),
    "exact_match": _with(_TURNS, select="SELECT conv_id, turn, lower(trim(pred)) = lower(trim(ref)) AS is_match FROM pairs"),
    "char_overlap_f1": _with(
        _TURNS,
        f"co AS (SELECT conv_id, turn, len({_CHARS.format('pred')}) AS a, len({_CHARS.format('ref')}) AS b, len(list_intersect({_CHARS.format('pred')}, {_CHARS.format('ref')})) AS c FROM pairs)",
        "cp AS (SELECT *, c::DOUBLE / greatest(a, 1) AS p, c::DOUBLE / greatest(b, 1) AS r FROM co)",
        select='SELECT conv_id, turn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN c > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM cp',
    ),
    "rouge_l": _recursive(
        _with(
            _TURNS,
            f"wl AS (SELECT conv_id, turn, {_words('lower(pred)')} AS a, {_words('lower(ref)')} AS b FROM pairs)",
            # A row of the prefix table is the running maximum of what the row above gives.
            """lc(conv_id, turn, i, r) AS (SELECT conv_id, turn, 0::BIGINT, list_transform(b, lambda x: 0) FROM wl UNION ALL
  SELECT conv_id, turn, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (SELECT conv_id, turn, i, list_transform(range(1, len(b) + 1), lambda j: greatest(r[j], coalesce(r[j - 1], 0) + (a[i + 1] = b[j])::INT)) AS c
    FROM lc JOIN wl USING (conv_id, turn) WHERE i < len(a)))""",
            "le AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, coalesce(r[len(b)], 0) AS n FROM wl JOIN lc USING (conv_id, turn) WHERE i = len(a))",
            "lp AS (SELECT *, n::DOUBLE / greatest(na, 1) AS p, n::DOUBLE / greatest(nb, 1) AS q FROM le)",
            select='SELECT conv_id, turn, round(p, 6) AS "precision", round(q, 6) AS recall, round(CASE WHEN n > 0 THEN 2.0::DOUBLE * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM lp',
        )
    ),
    "bleu": _with(
        _TURNS,
        f"wl AS (SELECT conv_id, turn, {_words('pred')} AS pred, {_words('ref')} AS ref FROM pairs)",
        "gp AS (SELECT conv_id, turn, k, pred[i : i + k - 1] AS g, count(*) AS c FROM wl, range(1, 5) r(k), range(1, len(pred) - k + 2) s(i) GROUP BY ALL)",
        "gq AS (SELECT conv_id, turn, k, ref[i : i + k - 1] AS g, count(*) AS c FROM wl, range(1, 5) r(k), range(1, len(ref) - k + 2) s(i) GROUP BY ALL)",
        "pc AS (SELECT k, sum(least(gp.c, coalesce(gq.c, 0)))::DOUBLE AS hit, sum(gp.c)::DOUBLE AS total FROM gp LEFT JOIN gq USING (conv_id, turn, k, g) GROUP BY k)",
        "ln_ AS (SELECT sum(len(pred))::BIGINT AS pl, sum(len(ref))::BIGINT AS rl FROM wl)",
        select="SELECT pl AS pred_len, rl AS ref_len, round((SELECT CASE WHEN count_if(hit > 0) = 4 THEN exp(sum(ln(hit / total)) / 4) ELSE 0 END FROM pc) * CASE WHEN pl >= rl THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE - rl::DOUBLE / pl) END, 6) AS bleu FROM ln_",
    ),
    "tir_stats": _with(
        _TURNS,
        f"ti AS (SELECT CASE WHEN len({_words('ref')}) > 0 THEN len({_words('pred')})::DOUBLE / len({_words('ref')}) ELSE 1.0::DOUBLE END AS t FROM pairs WHERE pred <> '' AND ref <> '')",
        select="SELECT round(coalesce(avg(t), 1), 6) AS mean_tir, round(coalesce(min(t), 1), 6) AS min_tir, round(coalesce(max(t), 1), 6) AS max_tir, round(coalesce(stddev_samp(t), 0), 6) AS std_tir FROM ti",
    ),
    "training_dataset": _with(
        *_TRAINING,
        select="SELECT doc_id, max(c)::INT AS original_length, count_if(keep)::INT AS compressed_length, md5(string_agg(tok, ' ' ORDER BY pos)) AS labels_md5, string_agg(tone_id::VARCHAR, '' ORDER BY pos) AS tone_labels, md5(string_agg(tok, ' ' ORDER BY pos) FILTER (keep)) AS input_md5 FROM t3 GROUP BY doc_id",
    ),
    "training_batches": _with(
        *_TRAINING,
        "tr AS (SELECT doc_id, doc_id // 8 AS batch, list(tok ORDER BY pos) FILTER (keep) AS i, list(tok ORDER BY pos) AS l, list(tone_id::VARCHAR ORDER BY pos) AS t FROM t3 GROUP BY doc_id)",
        "tl AS (SELECT *, max(len(i)) OVER (PARTITION BY batch) AS m, max(len(l)) OVER (PARTITION BY batch) AS n FROM tr)",
        "td AS (SELECT *, " + ", ".join(f"array_to_string(list_concat({x}, list_transform(range({w} - len({y})), lambda _: '{v}')), ' ') AS {z}" for z, x, y, w, v in (("pi", "i", "i", "m", ""), ("pa", "list_transform(i, lambda _: '1')", "i", "m", "0"), ("pl", "l", "l", "n", "-100"), ("pt", "t", "t", "n", "0"))) + " FROM tl)",
        select="SELECT batch, count(*)::INT AS n_rows, max(m)::INT AS input_width, max(n)::INT AS label_width, " + ", ".join(f"md5(string_agg({c}, '|' ORDER BY doc_id)) AS {k}" for c, k in (("pi", "input_md5"), ("pa", "attention_md5"), ("pl", "labels_md5"), ("pt", "tones_md5"))) + " FROM td GROUP BY batch",
    ),
    "tone_loss": _with(
        _TOKS, _TONED_CTE, select="SELECT round(0.1::DOUBLE * (sum(-ln(1.0::DOUBLE / (length(tok) + 1)) * (tone_id > 0)::INT::DOUBLE) / (sum((tone_id > 0)::INT::DOUBLE) + 1e-8::DOUBLE)), 6) AS loss FROM tw"
    ),
    "event_throughput": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

#: Queries on words run over the lexicon stream and, by this name and _text, over the documents' own tokens.
_ON_WORDS = ("word_class_dist", "redup_pairs", "word_normalize", "func_word_ext", "word_segment", "align_spans", "word_analysis", "decoded_pieces", "compress_morph_quota", "compress_morph_aware")
ORACLES |= {f"{name}_text": ORACLES[name].replace(_LEX, _TOKS) for name in _ON_WORDS}
