"""Queries over manuscripts: counting, grids, conversion and its verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import JAPANESE
from prosewell.operators import conversion as V
from prosewell.operators import counting as C
from prosewell.plans.base import MANUSCRIPT_SQL, base, documents, inline, manuscripts, query, quoted, s_document_body, s_has, s_kind, s_plain, s_sub, s_trim, s_visible, values

_JA = base(MANUSCRIPT_SQL, JAPANESE)
_RAW = s_document_body("raw")
_TITLE = s_sub(s_sub(_RAW, T.HEADING), r"[ \t\x{3000}]*#*[ \t\x{3000}]*$")


def _counts(source: str) -> str:
    trimmed_ = base(f"(SELECT doc_id, {s_sub('text', chr(10) + '+$')} AS text FROM {source})", JAPANESE)
    symbols = f"({s_has(s_trim(_RAW), T.SYMBOLS)} AND NOT {s_has(s_trim(_RAW), '[「『（]')} AND NOT {s_has(s_trim(_RAW), T.SILENT)})"
    return f"""{trimmed_} SELECT k.doc_id, sum(CASE WHEN kind IN ('dialogue', 'bracket', 'narration') OR (kind = 'document' AND NOT {symbols}) THEN {s_visible(s_plain(_RAW))} ELSE 0 END)::BIGINT AS body,
sum(CASE WHEN kind <> 'heading' THEN {s_visible(s_plain(_RAW))} ELSE 0 END)::BIGINT AS narou, (sum(length({s_plain(f"CASE WHEN kind = 'heading' THEN {_TITLE} ELSE {_RAW} END")})) + count(*) - 1)::BIGINT AS raw,
any_value(i.n) AS invisible FROM kind k JOIN (SELECT doc_id, len(regexp_extract_all(text, {quoted(r'[\p{Cf}\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]')})) AS n FROM {source}) i USING (doc_id) GROUP BY k.doc_id"""


@query("count_modes", _counts("documents"))
def _(spark, d):
    return C.count_modes(documents(spark, d))


@query("count_modes_ja", _counts(MANUSCRIPT_SQL))
def _(spark, d):
    return C.count_modes(manuscripts(spark, d))


_HIDDEN = "(SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(8203) || 'a' WHEN 1 THEN chr(9) WHEN 2 THEN chr(65279) || 'x' || chr(8288) ELSE 'zero' || chr(1) END AS text FROM documents)"


@query("invisible_chars", f"SELECT doc_id, len(regexp_extract_all(text, {quoted(r'[\p{Cf}\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]')})) AS invisible FROM {_HIDDEN}")
def _(spark, d):
    key = F.col("doc_id") % 4
    tail = F.when(key == 0, "​a").when(key == 1, "\t").when(key == 2, "﻿x⁠").otherwise("zero\x01")
    return C.count_modes(documents(spark, d).select("doc_id", F.concat("text", tail).alias("text"))).select("doc_id", "invisible")


@query("bare_ruby_ja", f"SELECT doc_id, len(regexp_extract_all({s_sub(s_sub('text', T.EMPHASIS), T.RUBY)}, {quoted(T.BARE_RUBY)}))::BIGINT AS n FROM {MANUSCRIPT_SQL}")
def _(spark, d):
    return C.bare_ruby(manuscripts(spark, d))


def _pages(source: str, width: int, height: int) -> str:
    cell = f"CASE WHEN kind IN ('blank', 'docblank') THEN '' ELSE {s_plain(f'''CASE WHEN kind = 'heading' THEN {_TITLE} ELSE {_RAW} END''')} END"
    return f"""{base(f"(SELECT doc_id, {s_sub('text', chr(10) + '+$')} AS text FROM {source} WHERE {s_sub('text', chr(10) + '+$')} <> '')", JAPANESE)},
f AS (SELECT doc_id, sum(greatest(1, ceil(length({cell}) / {width})))::BIGINT AS rows FROM kind GROUP BY doc_id), a AS (SELECT doc_id, coalesce(f.rows, 0) AS rows FROM {source} LEFT JOIN f USING (doc_id))
SELECT doc_id, rows, ceil(rows / {height})::BIGINT AS pages, CASE WHEN rows = 0 THEN 0 ELSE rows - (ceil(rows / {height})::BIGINT - 1) * {height} END AS last_rows FROM a"""


@query("grid_pages", _pages("documents", 40, 16))
def _(spark, d):
    return C.grid_pages(documents(spark, d), 40, 16)


@query("grid_pages_ja", _pages(MANUSCRIPT_SQL, 20, 5))
def _(spark, d):
    return C.grid_pages(manuscripts(spark, d), 20, 5)


def _flow(width: int, height: int) -> str:
    """Hanging stops, pairs of marks in one cell, and an assumed indentation."""
    title = f"CASE WHEN kind = 'heading' THEN {_TITLE} ELSE {_RAW} END"
    cell = f"CASE WHEN kind IN ('blank', 'docblank') THEN '' ELSE {s_sub(s_plain(title), '[!?！？]{2}', '!')} END"
    own = f"CASE WHEN kind = 'narration' AND NOT {s_has(_RAW, '^' + T.SPACE)} THEN chr(12288) || c ELSE c END"
    state = "{'rows': 0, 'used': 0, 'c': ''}"
    step = f"CASE WHEN s.used = {width} AND x.c IN ('、', '。') AND s.rows > 0 THEN {{'rows': s.rows, 'used': {width + 1}, 'c': ''}} WHEN s.rows = 0 OR s.used >= {width} THEN {{'rows': s.rows + 1, 'used': 1, 'c': ''}} ELSE {{'rows': s.rows, 'used': s.used + 1, 'c': ''}} END"
    rows = f"CASE WHEN length(c) = 0 THEN 1 ELSE list_reduce(list_prepend({state}, list_transform(string_split(c, ''), lambda y: {{'rows': 0, 'used': 0, 'c': y}})), lambda s, x: {step}).rows END"
    source = f"(SELECT doc_id, {s_sub('text', chr(10) + '+$')} AS text FROM {MANUSCRIPT_SQL} WHERE {s_sub('text', chr(10) + '+$')} <> '')"
    return f"""{base(source, JAPANESE)},
f AS (SELECT doc_id, sum({rows})::BIGINT AS rows FROM (SELECT doc_id, {own} AS c FROM (SELECT doc_id, kind, raw, {cell} AS c FROM kind)) GROUP BY doc_id), a AS (SELECT d.doc_id, coalesce(f.rows, 0) AS rows FROM documents d LEFT JOIN f USING (doc_id))
SELECT doc_id, rows, ceil(rows / {height})::BIGINT AS pages, CASE WHEN rows = 0 THEN 0 ELSE rows - (ceil(rows / {height})::BIGINT - 1) * {height} END AS last_rows FROM a"""


@query("grid_flow_ja", _flow(16, 9))
def _(spark, d):
    return C.grid_pages(manuscripts(spark, d), *C.parse_grid("16x9"), pair_marks=True, hang=True, indent=True)


@query("bounds_check", f"SELECT doc_id, n AS value, CASE WHEN n < 500 THEN 'under' WHEN n > 3000 THEN 'over' ELSE 'in' END AS status, CASE WHEN n < 500 THEN 500 - n WHEN n > 3000 THEN n - 3000 ELSE 0 END AS off_by FROM (SELECT doc_id, {s_visible('text')} AS n FROM documents)")
def _(spark, d):
    return C.bounds(documents(spark, d).withColumn("n", T.visible(F.col("text"))), "n", 500, 3000)


@query("count_total", f"SELECT lang, sum({s_visible('text')})::BIGINT AS total, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("lang", T.visible(F.col("text")).alias("n"))
    return C.totals(docs, "lang", "n")


# ------------------------------------------------------------------ conversion
_SET = "chr(57344) || '\\1' || chr(57345)"


def _inline(raw: str, target: str, strip: bool = False) -> str:
    ruby = {"alphapolis": r"#\1__\2__#", "pixiv": r"[[rb:\1 > \2]]", "plain_paren": r"\1（\2）", "plain_drop": r"\1"}.get(target)
    aside = f"regexp_replace({raw}, {quoted(T.EMPHASIS)}, {_SET}, 'g')"
    done = s_sub(aside, T.RUBY, ruby) if ruby else aside
    shown = r"[[emphasismark:\1>﹅]]" if target == "pixiv" else r"\1" if strip else r"《《\1》》"
    return f"regexp_replace({done}, chr(57344) || '([^' || chr(57345) || ']*)' || chr(57345), {quoted(shown)}, 'g')"


#: Options by the name of their query: every target, and every choice of indentation, blank lines, headings, emphasis and ruby.
OPTIONS = {
    "narou": V.Options("narou", blank="dialogue", bouten="strip"), "kakuyomu": V.Options("kakuyomu", indent="remove", blank="para"), "alphapolis": V.Options("alphapolis", blank="none", scene_break="＊＊＊"),
    "pixiv": V.resolve("pixiv", blank="dialogue"), "plain": V.resolve(medium="print", project_indent="fullwidth", ruby="paren"), "plain_drop": V.Options("plain", indent="add", blank="para", heading="text", ruby="drop", bouten="strip"),
}


def _convert_sql(o: V.Options) -> str:
    """CTEs item, placed, made (doc_id, out) after ``base``."""
    strip = o.strips
    body, lead = s_document_body("raw"), f"regexp_matches(b, {quoted('^' + T.SPACE)})"
    shown = _inline("b", o.inline, strip)
    narration = {"add": f"CASE WHEN NOT regexp_matches(shown, {quoted('^' + T.SPACE)}) THEN chr(12288) || shown ELSE shown END", "remove": "CASE WHEN starts_with(shown, chr(12288)) THEN substr(shown, 2) ELSE shown END", "keep": "shown"}[o.indent]
    title = s_sub(s_sub("b", T.HEADING), r"[ \t\x{3000}]*#*[ \t\x{3000}]*$")
    head = {"text": _inline(title, o.inline, strip), "chapter": f"'[chapter:' || {_inline(title, o.inline, strip)} || ']'", "drop": "''", "keep": "b"}[o.heading]
    scene = f"WHEN kind = 'scene' THEN {quoted(o.scene_break)}" if o.scene_break else ""
    doc, parted = "('document', 'docblank')", "('scene', 'symbol', 'heading')"
    rest = {"para": "true", "dialogue": "(prev = 'dialogue') <> (kind = 'dialogue')", "none": "false", "keep": "false"}[o.blank]
    gap = f"CASE WHEN prev IS NULL THEN false WHEN line - prev_line > 1 AND prev IN {doc} AND kind IN {doc} THEN true WHEN prev IN {parted} OR kind IN {parted} OR (prev IN {doc}) <> (kind IN {doc}) THEN true WHEN prev IN {doc} THEN false ELSE {rest} END"
    some = "kind NOT IN ('blank', 'dropped')"
    if o.blank == "keep":
        # a dropped heading between two documents leaves a blank line
        placed = f"""SELECT doc_id, line, CASE WHEN kind = 'dropped' THEN '' ELSE t END AS t FROM (SELECT *, last_value(CASE WHEN kind <> 'dropped' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(CASE WHEN kind <> 'dropped' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM item) WHERE kind <> 'dropped' OR (p IN {doc} AND n IN {doc})"""
    else:
        placed = f"SELECT doc_id, line, CASE WHEN {gap} THEN chr(10) || t ELSE t END AS t FROM (SELECT *, lag(kind) OVER w AS prev, lag(line) OVER w AS prev_line FROM item WHERE {some} WINDOW w AS (PARTITION BY doc_id ORDER BY line))"
    edge = f"[{T.BLANKS.replace(chr(10), '')}]*"
    return f""", item AS (SELECT doc_id, line, CASE WHEN kind = 'heading' AND {str(o.heading == 'drop').lower()} THEN 'dropped' ELSE kind END AS kind, CASE WHEN kind = 'docblank' THEN '' WHEN kind = 'heading' THEN {head} {scene} WHEN kind IN ('scene', 'symbol', 'blank') THEN b WHEN kind = 'narration' THEN {narration} ELSE shown END AS t
  FROM (SELECT *, {shown} AS shown FROM (SELECT *, {body} AS b FROM kind))), placed AS ({placed}),
made AS (SELECT doc_id, CASE WHEN {s_trim('j')} = '' THEN '' ELSE regexp_replace(j, {quoted(f'^(?:{edge}{chr(92)}n)+|(?:{chr(92)}n{edge})+$')}, '', 'g') END AS out FROM (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS j FROM placed GROUP BY doc_id))"""


def _converts(name: str, o: V.Options):
    @query(f"convert_text_{name}", f"{_JA}{_convert_sql(o)} SELECT d.doc_id, coalesce(out, '') AS out FROM documents d LEFT JOIN made USING (doc_id)")
    def _(spark, d):
        return V.convert_text(manuscripts(spark, d), o).select("doc_id", "out")


for _name, _o in OPTIONS.items():
    _converts(_name, _o)


@query("convert_stats", f"""{_JA} SELECT count(*) FILTER (kind NOT IN ('blank', 'docblank'))::BIGINT AS lines, sum(CASE WHEN kind IN ('blank', 'docblank', 'scene', 'symbol') OR kind = 'heading' THEN 0 ELSE len(regexp_extract_all({_RAW}, {quoted(T.EMPHASIS)})) END)::BIGINT AS emphasis,
sum(CASE WHEN kind IN ('blank', 'docblank', 'scene', 'symbol') OR kind = 'heading' THEN 0 ELSE len(regexp_extract_all({s_sub(_RAW, T.EMPHASIS)}, {quoted(T.RUBY)})) END)::BIGINT AS ruby, count(*) FILTER (kind = 'scene')::BIGINT AS scene_breaks, count(*) FILTER (kind IN ('document', 'docblank'))::BIGINT AS document_lines,
count(*) FILTER (kind = 'narration' AND NOT {s_has(_RAW, '^' + T.SPACE)})::BIGINT AS indent_added, count(*) FILTER (kind = 'narration' AND starts_with({_RAW}, chr(12288)))::BIGINT AS indent_already, 0::BIGINT AS indent_removed, count(*) FILTER (kind = 'heading')::BIGINT AS headings FROM kind""")
def _(spark, d):
    return V.merge_stats(V.convert_text(manuscripts(spark, d), OPTIONS["narou"]))


@query("join_outputs", f"{_JA}{_convert_sql(OPTIONS['pixiv'])} SELECT doc_id // 10 AS work, string_agg(out, chr(10) || '[newpage]' || chr(10) ORDER BY doc_id) AS out FROM made GROUP BY 1")
def _(spark, d):
    made = V.convert_text(manuscripts(spark, d), OPTIONS["pixiv"]).withColumn("work", F.floor(F.col("doc_id") / 10))
    return V.join_outputs(made, "work", OPTIONS["pixiv"])


_BARS = r"[｜|]([^｜|《》\n]+)《"


def _canonical(rows: str) -> str:
    """(doc_id, place, line, is_doc, literal, text) of rows (doc_id, line, is_doc, t) that aren't blank."""
    bare = f"regexp_replace(t, {quoted('^' + chr(0x3000) + '+')}, '')"
    headed = f"CASE WHEN {s_has('s', V._HEADING)} THEN '# ' || regexp_extract(s, {quoted(V._HEADING)}, 1) ELSE s END"
    return f"""(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place FROM (SELECT doc_id, line, is_doc, {s_sub('t', _BARS, chr(92) + chr(92) + '1《').replace(chr(92) * 2 + '1', '｜' + chr(92) + '1')} AS literal,
CASE WHEN {s_has(s_trim('s'), T.SCENE)} THEN '＊' ELSE {s_sub('h', _BARS, '｜' + chr(92) + '1《')} END AS text FROM (SELECT *, {headed} AS h FROM (SELECT *, {bare} AS s FROM {rows})) WHERE {s_trim('t')} <> ''))"""


def _mismatch_sql(o: V.Options, tampered: str) -> str:
    """What ``verify`` finds in outputs that were changed on the way."""
    source = f"(SELECT doc_id, line, starts_with(raw, '＞') AS is_doc, {_RAW} AS t FROM line WHERE starts_with(raw, '＞') OR NOT {s_has(_RAW, V._HEADING)})"
    back = f"(SELECT doc_id, line, false AS is_doc, {s_sub('raw', r'#([^#' + chr(92) + r'n]+?)__([^#' + chr(92) + r'n]+?)__#', '｜' + chr(92) + '1《' + chr(92) + '2》')} AS t FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS raw FROM (SELECT doc_id, string_split({tampered}, chr(10)) AS p FROM made WHERE out <> '')))"
    return f"""{_JA}{_convert_sql(o)}, w AS (SELECT * FROM {_canonical(source)}), g AS (SELECT * FROM {_canonical(back)}),
j AS (SELECT coalesce(w.doc_id, g.doc_id) AS doc_id, coalesce(w.place, g.place)::INT AS place, w.line::INT AS source_line, g.line::INT AS output_line, CASE WHEN w.is_doc THEN w.literal ELSE w.text END AS expected, CASE WHEN w.is_doc THEN g.literal ELSE g.text END AS got FROM w FULL JOIN g ON w.doc_id = g.doc_id AND w.place = g.place)
SELECT doc_id, place, CASE WHEN expected IS NULL THEN 'extra' WHEN got IS NULL THEN 'missing' ELSE 'changed' END AS kind, source_line, output_line, expected, got FROM j WHERE expected IS DISTINCT FROM got"""


@query("verify_roundtrip", _mismatch_sql(V.Options("alphapolis", blank="none"), "out"))
def _(spark, d):
    docs, o = manuscripts(spark, d), V.Options("alphapolis", blank="none")
    return V.verify(docs, V.convert_text(docs, o), o)


@query("verify_mismatch", _mismatch_sql(V.Options("alphapolis", blank="none"), "replace(replace(out, '傘はない。', ''), '彼は歩き出した', '彼は走り出した' || chr(10) || '？')"))
def _(spark, d):
    docs, o = manuscripts(spark, d), V.Options("alphapolis", blank="none")
    made = V.convert_text(docs, o).withColumn("out", F.replace(F.replace("out", F.lit("傘はない。"), F.lit("")), F.lit("彼は歩き出した"), F.lit("彼は走り出した\n？")))
    return V.verify(docs, made, o)


def _warnings_sql(o: V.Options) -> str:
    left = s_sub(s_sub("b", T.EMPHASIS), T.RUBY)
    rest, lead = s_sub(left, T.BARE_RUBY, chr(92) + "1"), s_has("b", "^" + T.SPACE)
    shown = f"kind NOT IN ('blank', 'docblank', 'scene', 'symbol'{', ' + quoted('heading') if o.heading not in ('text', 'chapter') else ''})"
    rubies = f"regexp_extract_all({s_sub('b', T.EMPHASIS)}, {quoted(T.RUBY)})"
    part = lambda k: f"regexp_extract(x, {quoted(T.RUBY)}, {k})"
    codes = {
        "raw-kakko": s_has(rest, "[《》]"), "half-bar": f"{shown} AND {s_has(s_sub('b', T.EMPHASIS), chr(92) + '|[^｜|《》' + chr(92) + 'n]+《[^《》' + chr(92) + 'n]+》')}", "title-markup": f"kind = 'heading' AND ({s_has('b', T.RUBY)} OR {s_has('b', T.EMPHASIS)})",
        "indent-odd": f"kind = 'narration' AND {lead} AND NOT {s_has('b', '^' + chr(0x3000) + '(?:[^' + T.SPACE[1:] + '|$)')}", "indent-bracket": f"kind IN ('dialogue', 'bracket') AND {lead}",
    }
    if o.target in ("narou", "alphapolis") and not o.strips:
        codes["bouten-unsupported"] = f"{shown} AND {s_has('b', T.EMPHASIS)}"
    if o.target in V.RUBY_LIMITS:
        a, b = V.RUBY_LIMITS[o.target]
        codes["ruby-length"] = f"{shown} AND len(list_filter({rubies}, lambda x: length({part(1)}) > {a} OR length({part(2)}) > {b})) > 0"
    if o.target in V.FORBIDDEN:
        codes["ruby-forbidden-char"] = f"{shown} AND len(list_filter({rubies}, lambda x: {s_has(part(1), V.FORBIDDEN[o.target])} OR {s_has(part(2), V.FORBIDDEN[o.target])})) > 0"
    if o.target in ("alphapolis", "pixiv", "plain"):
        codes["bare-ruby"] = s_has(left, T.BARE_RUBY)
    if o.target == "narou":
        codes["paren-ruby"] = s_has(rest, V.PAREN_RUBY)
    if o.target in V.TAGS:
        codes["collision"] = s_has(rest, V.TAGS[o.target])
    rows = " UNION ALL ".join(f"SELECT doc_id, line::INT AS line, '{k}' AS code FROM k2 WHERE {c}" for k, c in codes.items())
    return f"""{_JA}, k2 AS (SELECT *, {_RAW} AS b FROM kind) {rows} UNION ALL SELECT doc_id, 0, 'indent-mixed' FROM k2 WHERE kind = 'narration' GROUP BY doc_id HAVING bool_or(starts_with(b, chr(12288))) AND bool_or(NOT {lead})"""


def _warned(name: str, o: V.Options):
    @query(f"convert_warnings_{name}", _warnings_sql(o))
    def _(spark, d):
        return V.warnings(manuscripts(spark, d), o)


for _name, _o in OPTIONS.items():
    if _name != "plain_drop":
        _warned(_name, _o)
