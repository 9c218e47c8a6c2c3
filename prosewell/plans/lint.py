"""All rules over whole tables, and the same rules in SQL, each a SELECT of its own over shared CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import JAPANESE, LATIN, Profile
from prosewell.operators import lint as L
from prosewell.operators import rules as R
from prosewell.plans.base import MANUSCRIPT_SQL, base, documents, manuscripts, query, quoted, s_count, s_has, s_searched, s_sub, s_trim
from prosewell.plans.prose import stats_sql

_G = R.GUARDS


def _one(rule: str, severity: str, value: str, hits: str = "1", line: str = "NULL", source: str = "fig") -> str:
    return f"SELECT doc_id, '{rule}' AS rule, {severity} AS severity, ({value})::DOUBLE AS value, ({hits})::BIGINT AS hits, ({line})::INT AS line FROM {source}"


def _listed(rule: str, severity: str, rows: str, value: str = "count(*)") -> str:
    return f"SELECT doc_id, '{rule}', '{severity}', ({value})::DOUBLE, count(*), min(line) FROM {rows} GROUP BY doc_id"


def _leveled(rule: str, rows: str, lines: tuple) -> str:
    """Rows (doc_id, value, line) by the severity that each reaches."""
    return f"SELECT doc_id, '{rule}', severity, max(value)::DOUBLE, count(*), min(line) FROM (SELECT *, {R.sql_level('value', rule, lines=lines)} AS severity FROM {rows}) WHERE severity IS NOT NULL GROUP BY doc_id, severity"


def _blocks(flag: str, value: str) -> str:
    """(doc_id, value, line) of maximal blocks of paragraphs with a flag."""
    return f"""(SELECT doc_id, sum({value}) AS value, min(line) AS line FROM (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM (
  SELECT *, CASE WHEN lag(({flag})) OVER (PARTITION BY doc_id ORDER BY line) IS NOT DISTINCT FROM ({flag}) THEN 0 ELSE 1 END AS turn FROM block_para)) WHERE {flag} GROUP BY doc_id, block)"""


def _faults(line: str, rule: str) -> str:
    mark = {"N01": "…+", "N02": "[―—─]+"}.get(rule)
    return s_count(line, L.N_FIRM[rule]) + (f" + len(list_filter(regexp_extract_all({line}, '{mark}'), lambda h: length(h) % 2 = 1))" if mark else "")


def _firm(body: str, profile: Profile) -> str:
    says = profile.cues["says"].lstrip("^")
    kept = s_sub(body, L._SAID.replace("{says}", says), f"{L._LEFT}\\1{L._RIGHT}\\2")
    kept = s_sub(s_sub(kept, L._LABEL, "□"), L._QUOTED, "\\1□")
    return f"translate({s_sub(kept, L._RANGE, chr(92) + '1□' + chr(92) + '2')}, '{L._LEFT}{L._RIGHT}', '「」')"


def ctes(source: str, profile: Profile) -> str:
    """Besides those of ``base`` and ``stats_sql``: block_para, docs (joined texts), heads, and for Japanese noted (faults by paragraph)."""
    narr, total = (f"(SELECT coalesce(string_agg({c}, chr(10) ORDER BY line), '') FROM paras x WHERE x.doc_id = f.doc_id)" for c in ("narr", "body"))
    out = f"""{base(source, profile)}{stats_sql(source, profile)}, block_para AS (SELECT q.*, coalesce(n.n, 0) AS n_sent FROM paras q LEFT JOIN (SELECT doc_id, line, count(*) AS n FROM asent GROUP BY doc_id, line) n USING (doc_id, line)),
joined AS (SELECT doc_id, string_agg(narr, chr(10) ORDER BY line) AS narr, string_agg(body, chr(10) ORDER BY line) AS body FROM paras GROUP BY doc_id),
texts AS (SELECT f.*, {s_searched("coalesce(j.narr, '')", profile)} AS narr_text, {s_searched("coalesce(j.body, '')", profile)} AS total_text, coalesce(j.body, '') AS plain_text FROM fig f LEFT JOIN joined j USING (doc_id)),
heads AS (SELECT doc_id, {s_searched('sentence', profile)} AS h FROM sent),
opened AS (SELECT doc_id, count(*) FILTER ({s_has('h', profile.heads)}) AS heads, count(*) FILTER ({s_has('h', profile.first)}) AS firsts FROM heads GROUP BY doc_id),
spot AS (SELECT doc_id, line, sum(chars) OVER (PARTITION BY doc_id ORDER BY line) - chars AS pos, utterances FROM paras), place AS (SELECT doc_id, line, pos, unnest(range(0, utterances)) AS k FROM spot),
ranked AS (SELECT doc_id, line, pos, lead(pos, {R.LEVELS['D03']['default'][0] - 1}) OVER (PARTITION BY doc_id ORDER BY line, k) - pos AS width, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS rn FROM place),
crowd AS (SELECT doc_id, list({{'pos': pos, 'line': line}} ORDER BY rn) AS w FROM ranked WHERE width <= {R.WINDOW} GROUP BY doc_id),
prose AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line DESC) AS z FROM line WHERE {s_trim('raw')} <> '')"""
    if profile.name == "ja":
        firsts = ", ".join(f"{_faults('firm', r)} AS {r}" for r in L.N_FIRM)
        soft = " + ".join(f"({_faults('body', r)}) - ({_faults('firm', r)})" for r in L.N_FIRM)
        balanced = """list_reduce(list_prepend('', regexp_extract_all(body, '[「」『』]')), lambda s, c: CASE WHEN s = 'x' THEN s WHEN c IN ('「', '『') THEN s || c WHEN (c = '」' AND ends_with(s, '「')) OR (c = '』' AND ends_with(s, '『')) THEN left(s, length(s) - 1) ELSE 'x' END) = ''"""
        out += f""", noted AS (SELECT *, {firsts}, {soft} AS N09, {s_count('body', L.N_SOFT['N06'])} AS N06, {s_count('body', L.N_SOFT['N11'])} AS N11, CASE WHEN kind = 'document' THEN 0 ELSE {s_count('body', L.N_SOFT['N12'])} END AS N12,
  CASE WHEN {balanced} THEN 0 ELSE 1 END AS N08 FROM (SELECT doc_id, line, raw, kind, body, CASE WHEN kind = 'document' THEN '' ELSE {_firm('body', profile)} END AS firm FROM paras)),
told2 AS (SELECT *, starts_with(raw, chr(12288)) AS ind FROM noted WHERE kind = 'narration' AND {s_has('body', '[。！？!?…―」』）)]$')}),
rate AS (SELECT doc_id, count(*) AS n, count(*) FILTER (ind) AS k FROM told2 GROUP BY doc_id)"""
    return out


def rule_sql(profile: Profile, lines: R.Lines) -> dict[str, list[str]]:
    """SELECTs (doc_id, rule, severity, value, hits, line) of each rule; rows without severity don't count."""
    level = lambda rule, value, variant=None: R.sql_level(value, rule, lines=lines.of(rule, variant))
    when = lambda cond, then: f"CASE WHEN {cond} THEN {then} END"
    low, high = R.P03_BAND[lines.work]
    target, tolerance = R.D01_TARGET[lines.work]
    p_info, p_warn = lines.of("P01")[:2]
    p5 = lines.of("P05")
    same = f"(SELECT r.doc_id, length AS value, first AS line, keitai FROM run r JOIN fig USING (doc_id) WHERE value NOT IN ('other', '{profile.noun}'))"
    density = "round(nouns * 1000 / nullif(narration_chars, 0), 1)"
    out = {
        "R01": [_leveled("R01", f"(SELECT * FROM {same} WHERE NOT keitai)", lines.of("R01")), _leveled("R01", f"(SELECT * FROM {same} WHERE keitai)", lines.of("R01", "polite"))],
        "R02": [_one("R02", when(f"sentences >= {_G['run_share_min_sentences']}", level("R02", "same_ending_run_share")), "same_ending_run_share")],
        "R03": [_one("R03", when(f"sentences >= {_G['run_share_min_sentences']} AND NOT keitai", level("R03", "ta_rate")), "ta_rate")],
        "L01": [_one("L01", f"CASE WHEN sentences >= {_G['cv_full_sentences']} THEN {level('L01', 'sentence_len_cv')} WHEN sentences >= {_G['cv_min_sentences']} AND sentence_len_cv < {lines.of('L01')[1]} THEN 'INFO' END", "sentence_len_cv")],
        "L02": [_one("L02", when(f"sentences >= {_G['cv_min_sentences']}", level("L02", "sentence_len_mean")), "sentence_len_mean")],
        "L03": [_listed("L03", "INFO", f"(SELECT * FROM sent WHERE chars > {lines.of('L03')[0]})")],
        "L04": [f"""SELECT doc_id, 'L04', 'INFO', n::DOUBLE, n, line FROM (SELECT w.doc_id, list_reduce(list_prepend(struct_pack(last := -5::BIGINT, n := 0::BIGINT), list_transform(hits, lambda x: struct_pack(last := x, n := 0::BIGINT))), lambda s, x: CASE WHEN x.last >= s.last + 5 THEN struct_pack(last := x.last, n := s.n + 1) ELSE s END).n AS n, line
  FROM (SELECT doc_id, list(rn ORDER BY rn) AS hits, arg_min(line, rn) AS line FROM (SELECT doc_id, line, row_number() OVER o AS rn, min(chars) OVER w AS lo, max(chars) OVER w AS hi, avg(chars) OVER w AS m, count(*) OVER w AS k FROM sent
  WINDOW o AS (PARTITION BY doc_id ORDER BY line, idx), w AS (PARTITION BY doc_id ORDER BY line, idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5 AND lo >= m * 0.75 AND hi <= m * 1.25 GROUP BY doc_id) w JOIN fig USING (doc_id) WHERE sentences >= 8)"""],
        "P01": ([_listed("P01", "WARN", f"(SELECT * FROM paras WHERE kind = 'narration' AND chars > {p_warn})")] if p_warn else []) + [_listed("P01", "INFO", f"(SELECT * FROM paras WHERE kind = 'narration' AND chars > {p_info}{f' AND chars <= {p_warn}' if p_warn else ''})")],
        "P02": [_one("P02", when(f"narration_paragraphs >= {_G['para_cv_min_paras']}", level("P02", "paragraph_len_cv")), "paragraph_len_cv")],
        "P03": [_one("P03", when(f"narration_paragraphs >= {_G['para_cv_min_paras']} AND (one_sentence_paragraph_rate > {high}{f' OR one_sentence_paragraph_rate < {low}' if low is not None else ''})", "'INFO'"), "one_sentence_paragraph_rate")],
        "P04": [_leveled("P04", _blocks(f"kind = 'narration' AND n_sent <= 1 AND chars <= {R.SHORT}", "1"), lines.of("P04"))],
        "P05": [f"SELECT b.doc_id, 'P05', '{'INFO' if p5[0] else 'WARN'}', max(b.value)::DOUBLE, count(*), min(b.line) FROM {_blocks('utterances = 0', 'narr_chars')} b JOIN fig f USING (doc_id) WHERE f.utterances > 0 AND b.value > {p5[0] or p5[1]} GROUP BY b.doc_id"],
        "T01": [_leveled("T01", f"(SELECT doc_id, length AS value, first AS line FROM run WHERE value = '{profile.noun}')", lines.of("T01"))],
        "T02": [_one("T02", when(f"narration_chars >= {_G['density_min_chars']} AND nouns >= {_G['density_min_count']}", level("T02", density)), density, "nouns")],
        "D01": [_one("D01", when(f"chars >= {_G['density_min_chars']} AND abs(dialogue_ratio - {target}) > {tolerance}", "'INFO'"), "dialogue_ratio")],
        "D02": [_leveled("D02", _blocks("kind = 'dialogue'", "utterances"), lines.of("D02"))],
        "D03": [f"""SELECT doc_id, 'D03', 'INFO', n::DOUBLE, n, line FROM (SELECT doc_id, w[1].line AS line, list_reduce(list_prepend(struct_pack(last := -1::BIGINT, n := 0::BIGINT), list_transform(w, lambda x: struct_pack(last := x.pos::BIGINT, n := 0::BIGINT))), lambda s, x: CASE WHEN x.last > s.last THEN struct_pack(last := x.last + {R.WINDOW}, n := s.n + 1) ELSE s END).n AS n FROM crowd)"""],
    }
    hesitant = f"(SELECT doc_id, sum(CASE WHEN utterances > 0 THEN {s_count('body', profile.hesitant)} ELSE 0 END) AS k FROM paras GROUP BY doc_id) h JOIN fig USING (doc_id)"
    out["K03"] = [_one("K03", when(f"utterances >= {_G['dialogue_rate_min_utterances']}", level("K03", "round(k / nullif(utterances, 0), 3)")), "round(k / nullif(utterances, 0), 3)", "k", source=hesitant)]
    short = f"(chars < {_G['density_min_chars']})"
    unit = lambda r: "narration_chars" if R.DENSITY[r][0] == "narr" else "chars"
    count = {r: s_count(f"{'narr' if u == 'narr' else 'total'}_text", profile.lexicon[r]) for r, (u, _) in R.DENSITY.items() if r in profile.lexicon} | {"K04": "coalesce(heads, 0)", "K26": "coalesce(firsts, 0)"}
    counted = "(SELECT t.*, " + ", ".join(f"{c} AS n{r}" for r, c in count.items()) + " FROM texts t LEFT JOIN opened USING (doc_id))"
    dense = lambda r: f"round(n{r} * 1000 / nullif({unit(r)}, 0), 2)"
    guarded = lambda r: f"({short} OR {unit(r)} < {_G['density_min_chars']})"
    for r, (_, least) in R.DENSITY.items():
        out[r] = [_one(r, when(f"NOT {guarded(r)} AND n{r} >= {least}", level(r, dense(r))), dense(r), f"n{r}", source=counted)]
    groups = " + ".join(f"CASE WHEN {guarded(r)} AND n{r} > 0 THEN 1 ELSE 0 END" for r in count if lines.on(r)) or "0"
    out["K00"] = [_one("K00", when("g > 0", "'INFO'"), "g", "g", source=f"(SELECT doc_id, {groups} AS g FROM {counted})")]
    for r, p in (("K01", f"(?:{profile.dash}){{2,}}"), ("K02", f"(?:{profile.ellipsis}){{2,}}|・{{3,}}")):
        value = "round(k * 1000 / nullif(chars, 0), 2)"
        out[r] = [_one(r, when(f"NOT {short} AND k >= {_G['density_min_count']}", level(r, value)), value, "k", source=f"(SELECT *, {s_count('plain_text', p)} AS k FROM texts)")]
    out["K08"].append(_one("K08", when(f"NOT {guarded('K08')} AND nK08 + nK09 >= {_G['density_min_count']}", "'INFO'"), f"round({dense('K08')} + {dense('K09')}, 2)", "nK08 + nK09", source=counted))
    words = lambda text, p, group=0: f"(SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({text}, {quoted(p)}, {group})) AS w FROM texts) GROUP BY doc_id, w)"
    twice = lambda rule, rows, least, extra="": f"SELECT doc_id, '{rule}', 'WARN', count(*)::DOUBLE, count(*), NULL FROM {rows} WHERE k >= {least}{extra} GROUP BY doc_id"
    out["S03"] = [twice("S03", words("total_text", profile.vehicle, 1), lines.of("S03")[1])]
    full = f"(SELECT doc_id FROM fig WHERE chars >= {_G['density_min_chars']} AND narration_chars >= {_G['density_min_chars']})"
    out["K09"].append(twice("K09", words("narr_text", profile.lexicon["K09"]), R.REPEATS["K09"][0] + 1, f" AND doc_id IN {full}"))
    limit, window = R.REPEATS["K10"]
    soft = quoted(profile.lexicon["K10"])
    out["K10"].append(f"""SELECT doc_id, 'K10', 'WARN', count(DISTINCT w)::DOUBLE, count(DISTINCT w), NULL FROM (SELECT doc_id, w, lead(pos, {limit - 1}) OVER (PARTITION BY doc_id, w ORDER BY pos) - pos AS span FROM (
  SELECT doc_id, h[k] AS w, length(array_to_string(g[1:k], '')) + length(array_to_string(h[1:k - 1], '')) AS pos FROM (SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS k FROM (
  SELECT doc_id, string_split_regex(narr_text, {soft}) AS g, regexp_extract_all(narr_text, {soft}) AS h FROM texts WHERE doc_id IN {full})))) WHERE span <= {window} GROUP BY doc_id""")
    fig2 = f"(SELECT f.*, coalesce(o.heads, 0) AS heads, coalesce(q.k, 0) AS opening FROM fig f LEFT JOIN opened o USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS k FROM paras WHERE kind = 'narration' AND {s_has(s_searched(s_trim('body'), profile), profile.heads)} GROUP BY doc_id) q USING (doc_id))"
    out["K05"] = [_one("K05", when(f"NOT {short} AND sentences >= {_G['run_share_min_sentences']}", level("K05", "round(heads / nullif(sentences, 0), 3)")), "round(heads / nullif(sentences, 0), 3)", "heads", source=fig2)]
    share = "round(opening / nullif(narration_paragraphs, 0), 3)"
    out["K06"] = [_one("K06", when(f"NOT {short} AND sentences >= {_G['run_share_min_sentences']} AND narration_paragraphs >= {_G['para_cv_min_paras']}", level("K06", share)), share, "opening", source=fig2)]
    out["K17"] = [_listed("K17", "INFO", f"(SELECT * FROM sent WHERE commas >= {lines.of('K17')[0]} AND doc_id IN (SELECT doc_id FROM fig WHERE NOT {short}))")]
    half = lambda k: s_trim(f"regexp_extract(lower({s_sub('sentence', '[.。!?！？]+$')}), {quoted(profile.swap)}, {k})")
    out["K30"] = [_listed("K30", "INFO", f"""(SELECT * FROM (SELECT doc_id, line, fit, a, b, lead(fit) OVER o AS fit2, lead(a) OVER o AS a2, lead(b) OVER o AS b2 FROM (SELECT doc_id, line, idx, chars <= {R.SWAP_SHORT} AND commas = 1 AS fit, {half(1)} AS a, {half(2)} AS b FROM sent WHERE kind = 'narration'
  UNION ALL SELECT doc_id, line, -1, false, '', '' FROM paras WHERE kind <> 'narration') WINDOW o AS (PARTITION BY doc_id ORDER BY line, idx)) WHERE fit AND fit2 AND a <> '' AND a = b2 AND b = a2)""")]
    meta = f"{s_has('raw', profile.cues['meta'])} AND NOT {s_has(s_trim('raw'), '^[「『' + chr(34) + ']')}"
    out["M01"] = [_one("M01", f"CASE WHEN chars = 0 THEN 'FAIL' WHEN chars < {_G['body_min_chars']} THEN 'WARN' END", "chars")]
    out["M02"] = [_listed("M02", "WARN", f"(SELECT * FROM prose WHERE (a <= 5 OR z <= 5) AND {meta})")]
    out["N07"] = [_listed("N07", "WARN", f"(SELECT * FROM line WHERE {s_has('raw', L.N_MARKDOWN)})")]
    out["X01"] = [_one("X01", when("k > 0", "'WARN'"), "k", "k", source=f"(SELECT doc_id, {s_count('narr_text', profile.cues['craft'])} AS k FROM texts)")]
    out["O01"] = [_listed("O01", "INFO", f"(SELECT * FROM (SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY line) - chars AS before FROM paras) WHERE before < 200 AND {s_has('body', profile.cues['opens'])})")]
    out["O02"] = [_listed("O02", "INFO", f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line DESC) AS z FROM paras) WHERE z <= 2 AND {s_has('body', profile.cues['closes'])})")]
    if profile.name == "ja":
        for r in ("N01", "N02", "N03", "N04", "N06", "N08", "N09", "N11", "N12"):
            out[r] = [_listed(r, "FAIL" if r in L.N_FIRM else "WARN", f"(SELECT * FROM noted WHERE {r} > 0)", f"sum({r})")]
        out["N05"] = [
            _listed("N05", "FAIL", f"(SELECT * FROM noted WHERE {s_has('raw', r'^(?:[ ' + chr(9) + r']|\x{3000}[\s\x{3000}])')})"),
            "SELECT doc_id, 'N05', 'FAIL', any_value(round(k / n, 3))::DOUBLE, count(*), min(line) FROM told2 JOIN rate USING (doc_id) WHERE n >= 2 AND k > 0 AND k < n AND ind <> (k / n >= 0.5) GROUP BY doc_id",
            "SELECT doc_id, 'N05', 'INFO', 0::DOUBLE, n, NULL FROM rate WHERE n >= 2 AND k = 0",
            f"SELECT doc_id, 'N05', 'WARN', count(*)::DOUBLE, count(*), min(line) FROM noted JOIN rate USING (doc_id) WHERE n >= 2 AND k > 0 AND {s_has('raw', '^　[「『]')} GROUP BY doc_id",
        ]
        bad = "(N01 + N02 + N03 + N04 > 0)"
        out["N10"] = [f"""SELECT doc_id, 'N10', 'INFO', count(*)::DOUBLE, count(*), min(line) + 1 FROM (SELECT doc_id, line, body, kind, bool_or(starts_with(raw, chr(12288))) OVER (PARTITION BY doc_id) AS indents, {', '.join(f"lead(line, {k}) OVER o = line + {k} AND lead(kind, {k}) OVER o <> 'document' AND NOT lead({s_has('raw', r'^[\s\x{3000}「『]')}, {k}) OVER o AS f{k}, lead({bad}, {k}) OVER o AS b{k}" for k in (1, 2, 3))}
  FROM noted WINDOW o AS (PARTITION BY doc_id ORDER BY line)) WHERE NOT indents AND kind <> 'document' AND {s_has('body', profile.cues['brings'])} AND coalesce(f1 AND b1, false) OR (NOT indents AND kind <> 'document' AND {s_has('body', profile.cues['brings'])} AND (coalesce(f1 AND f2 AND b2, false) OR coalesce(f1 AND f2 AND f3 AND b3, false))) GROUP BY doc_id"""]
    return out


def lint_sql(source: str, profile: Profile, lines: R.Lines | None = None) -> str:
    lines = lines or R.Lines()
    always = [x for r, some in rule_sql(profile, lines).items() for x in some if r in ("M01", "N07") and lines.on(r)]
    rest = [x for r, some in rule_sql(profile, lines).items() for x in some if r not in ("M01", "N07") and lines.on(r)]
    parts = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in always) if always else ""
    if rest:
        parts += (" UNION ALL " if parts else "") + f"SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM ({x})' for x in rest)}) WHERE doc_id IN (SELECT doc_id FROM fig WHERE chars > 0)"
    rank = "list_position(['FAIL', 'STRONG', 'WARN', 'INFO'], severity)"
    return f"""{ctes(source, profile)}, found(doc_id, rule, severity, value, hits, line) AS ({parts})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {rank}, rule, -value, -hits, coalesce(line, 0)) AS place, rule, severity, value, hits::BIGINT AS hits, line::INT AS line FROM found WHERE severity IS NOT NULL"""


@query("lint_findings", lint_sql("documents", LATIN))
def _(spark, d):
    return L.lint(documents(spark, d))


@query("lint_findings_ja", lint_sql(MANUSCRIPT_SQL, JAPANESE))
def _(spark, d):
    return L.lint(manuscripts(spark, d), JAPANESE)


def _group(letter: str, work: str, name: str, profile: Profile = JAPANESE):
    lines = R.Lines(work=work, only=(letter,))
    source = MANUSCRIPT_SQL if profile.name == "ja" else "documents"

    @query(name, lint_sql(source, profile, lines))
    def _(spark, d):
        return L.lint(manuscripts(spark, d) if profile.name == "ja" else documents(spark, d), profile, lines)


#: One query a group of rules, each with another profile of work.
for _k, _letter in enumerate("NRLPTSDKMXO"):
    _group(_letter, ("bungei", "entertainment", "web")[_k % 3], f"lint_{_letter.lower()}_ja")

_OVER = R.Lines(work="web", overrides={"K07": {"info": 0.5, "warn": 0.9, "reason": "a work of impressions"}, "R01": {"off": True}, "L02": {"info": 30}}, direct=True, skip=("N", "P03"))


@query("lint_overrides_ja", lint_sql(MANUSCRIPT_SQL, JAPANESE, _OVER))
def _(spark, d):
    return L.lint(manuscripts(spark, d), JAPANESE, _OVER)


@query("lint_severities_ja", f"SELECT severity, count(*) AS findings FROM ({lint_sql(MANUSCRIPT_SQL, JAPANESE)}) GROUP BY severity")
def _(spark, d):
    return R.totals(L.lint(manuscripts(spark, d), JAPANESE))


_RANGES = ("800-1500", "1000")


@query("range_status", " UNION ALL ".join(f"SELECT doc_id, '{s}' AS spec, CASE WHEN n < {f} THEN 'under' WHEN n > {b} THEN 'over' ELSE 'in' END AS status, (CASE WHEN n < {f} THEN {a} - n WHEN n > {b} THEN n - {b} ELSE 0 END)::BIGINT AS off_by FROM (SELECT doc_id, length({s_sub('text', T.SPACE)}) AS n FROM documents)" for s in _RANGES for a, b, f in [R.parse_range(s)]))
def _(spark, d):
    n = documents(spark, d).select("doc_id", T.visible(F.col("text")).alias("n"))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("spec"), R.range_status(F.col("n"), s).alias("r")) for s in _RANGES)))
    return n.select("doc_id", rows.alias("x")).select("doc_id", "x.spec", "x.r.*")


_RHYTHM = R.Lines(only=("R", "L", "P", "T"))


@query("prose_rhythm", lint_sql("documents", LATIN, _RHYTHM))
def _(spark, d):
    return L.lint(documents(spark, d), LATIN, _RHYTHM)
