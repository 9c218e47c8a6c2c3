"""All rules over a document at once: its findings are an array in its row, ordered there, so a corpus is linted in one scan.

A finding is {rule, severity, value, hits, line}: the figure that reached an alarm line, in how many places, and the first of them.
Severities are told for each rule by itself; nothing adds them up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import JAPANESE, LATIN, Profile
from prosewell.operators import decompose as D
from prosewell.operators import rules as R
from prosewell.operators import stats as S
from prosewell.operators.stats import rounded, total

FINDING = "struct<rule:string,severity:string,value:double,hits:bigint,line:int>"


def _NONE() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _finding(rule: str, severity: Column, value: Column, hits: Column | None = None, line: Column | None = None) -> Column:
    made = F.struct(
        F.lit(rule).alias("rule"), severity.alias("severity"), value.cast("double").alias("value"), (F.lit(1) if hits is None else hits).cast("bigint").alias("hits"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
    )
    return F.when(severity.isNotNull(), F.array(made)).otherwise(_NONE())


def _first(rows: Column, name: str = "line") -> Column:
    return F.get(rows, F.lit(0))[name]


def _by_level(rule: str, items: str, lines: tuple) -> Column:
    """A finding for each severity that items ({value, line}, an array column) reach by themselves: the largest value, how many, the first line."""
    out = []
    for name in R.SEVERITIES[1:]:
        own = F.filter(items, lambda x: R.level(x["value"], rule, lines=lines) == name)  # noqa: B023
        out.append(_finding(rule, F.when(F.size(own) > 0, name), F.array_max(F.transform(own, lambda x: x["value"])), F.size(own), _first(own)))
    return F.concat(*out)


def _listed(rule: str, severity: str, items: Column, value=None) -> Column:
    """One finding for what a rule lists, if there is any."""
    return _finding(rule, F.when(F.size(items) > 0, severity), F.size(items) if value is None else value, F.size(items), _first(items))


def _values(rows: Column, value) -> Column:
    return F.transform(rows, lambda r: F.struct(value(r).cast("double").alias("value"), r["line"].alias("line")))


def _block_sums(flag, value) -> tuple:
    """Column functions for maximal blocks of paragraphs: where they start, and {value, line} of each that the flag holds for."""
    starts, _ = D.islands("paras", lambda a, b: flag(a) == flag(b))

    def blocks(at: str) -> Column:
        end = lambda k: F.coalesce(F.get(F.col(at), k + 1), F.size("paras"))
        made = F.transform(F.col(at), lambda s, k: F.struct(flag(F.get("paras", s)).alias("on"), total(F.transform(F.slice("paras", s + 1, end(k) - s), value)).cast("double").alias("value"), F.get("paras", s)["line"].alias("line")))
        return F.transform(F.filter(made, lambda b: b["on"]), lambda b: F.struct(b["value"].alias("value"), b["line"].alias("line")))

    return starts, blocks


#: Forms of notation that are faults in Japanese manuscripts, as patterns over a line.
N_FIRM = {"N01": r"[.]{3,}|・{3,}|。{2,}|、{2,}", "N02": r"ーー|--", "N03": r"[！？][^！？!?\s\x{3000}」』）)】〉》…―—]", "N04": "。[」』]"}
N_SOFT = {"N06": "[ぁ-んァ-ヶ一-龥][,.!?]|[｡､｢｣]", "N11": r"[ぁ-んァ-ヶ一-龥々][ \t]+[A-Za-z0-9]|[A-Za-z0-9][ \t]+[ぁ-んァ-ヶ一-龥々]", "N12": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"}
N_MARKDOWN = r"\*\*|^#{1,6} |^[-*] |`"
#: A quote that does not start a sentence and that no word of speech follows, and a label: what stands there may be quoted as it is.
_SAID, _QUOTED, _LABEL = "「([^「」]*)」({says})", r"([^。！？!?」』「『\s\x{3000}])「[^「」]*」", "【[^【】]*】|〈[^〈〉]*〉|［[^［］]*］|『[^『』]*』"
#: Speech that is set aside meanwhile.
_LEFT, _RIGHT = "\ue003", "\ue004"
_RANGE = "([一-龥々ァ-ヶ])[―—─]([一-龥々ァ-ヶ])"


def firm(body: Column, profile: Profile) -> Column:
    """A line without what may stand in it as it is: labels, titles, quotes that aren't speech, and ranges; speech and narration stay."""
    says = profile.cues.get("says", "$^").lstrip("^")
    kept = F.regexp_replace(body, _SAID.replace("{says}", says), f"{_LEFT}$1{_RIGHT}$2")
    kept = F.regexp_replace(F.regexp_replace(kept, _LABEL, "□"), _QUOTED, "$1□")
    return F.translate(F.regexp_replace(kept, _RANGE, "$1□$2"), _LEFT + _RIGHT, "「」")


def faults(line: Column, rule: str) -> Column:
    """How often a line breaks a rule of notation."""
    n = F.regexp_count(line, F.lit(N_FIRM[rule]))
    mark = {"N01": "…+", "N02": "[―—─]+"}.get(rule)
    return n + F.size(F.filter(F.regexp_extract_all(line, F.lit(mark), F.lit(0)), lambda h: F.length(h) % 2 == 1)) if mark else n


def _notation(rows: DataFrame, profile: Profile) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Faults of notation by paragraph.  Those that go when what may be quoted is left out, and all in documents, are N09."""
    if profile.name != "ja":
        return rows, []
    text = F.transform("paras", lambda p: F.struct(p["line"].alias("line"), p["raw"].alias("raw"), p["kind"].alias("kind"), p["body"].alias("body"), F.when(p["kind"] == "document", "").otherwise(firm(p["body"], profile)).alias("firm")))
    rows = D.fixed(rows, noted=text)
    told = F.transform("noted", lambda p: F.struct(
        p["line"].alias("line"), p["raw"].alias("raw"), p["kind"].alias("kind"), p["body"].alias("body"), *(faults(p["firm"], r).alias(r) for r in N_FIRM),
        reduce(lambda a, b: a + b, (faults(p["body"], r) - faults(p["firm"], r) for r in N_FIRM)).alias("N09"),
        *(F.regexp_count(p["body"], F.lit(x)).alias(r) for r, x in N_SOFT.items() if r != "N12"), F.when(p["kind"] == "document", 0).otherwise(F.regexp_count(p["body"], F.lit(N_SOFT["N12"]))).alias("N12"),
        F.when(T.quotes_balanced(p["body"]), 0).otherwise(1).alias("N08"),
    ))
    rows = D.fixed(rows, noted=told)
    severity = dict.fromkeys(N_FIRM, "FAIL") | dict.fromkeys(("N06", "N08", "N09", "N11", "N12"), "WARN")

    def counted(rule: str) -> Column:
        own = F.filter("noted", lambda p: p[rule] > 0)
        return _finding(rule, F.when(F.size(own) > 0, severity[rule]), total(F.transform(own, lambda p: p[rule])), F.size(own), _first(own))

    return rows, [(r, counted(r)) for r in severity] + [("N05", _indentation()), ("N10", _unmarked(profile))]


def _indentation() -> Column:
    """Odd leads, mixed indentation (the smaller part is listed), none at all, and indented speech."""
    narrated = F.filter("noted", lambda p: (p["kind"] == "narration") & p["body"].rlike("[。！？!?…―」』）)]$"))
    ind = F.filter(narrated, lambda p: F.startswith(p["raw"], F.lit("　")))
    n, k = F.size(narrated), F.size(ind)
    odd = F.filter("noted", lambda p: p["raw"].rlike(r"^(?:[ \t]|\x{3000}[\s\x{3000}])"))
    minority = F.filter(narrated, lambda p: F.startswith(p["raw"], F.lit("　")) != (k / n >= 0.5))
    speech = F.filter("noted", lambda p: p["raw"].rlike("^　[「『]"))
    mixed = (n >= 2) & (k > 0) & (k < n)
    return F.concat(
        _listed("N05", "FAIL", odd), _finding("N05", F.when(mixed, "FAIL"), rounded(k / n), F.size(minority), _first(minority)),
        _finding("N05", F.when((n >= 2) & (k == 0), "INFO"), F.lit(0.0), n), _finding("N05", F.when((n >= 2) & (k > 0) & (F.size(speech) > 0), "WARN"), F.size(speech), F.size(speech), _first(speech)),
    )


def _unmarked(profile: Profile) -> Column:
    """Where up to three lines right after one that brings a document, in a manuscript without indentation, hold a fault of N01 to N04."""
    at = lambda i, k: F.get("noted", (i + k).cast("int"))
    fits = lambda i, k: F.coalesce((at(i, k)["line"] == at(i, 0)["line"] + k) & (at(i, k)["kind"] != "document") & ~at(i, k)["raw"].rlike(r"^[\s\x{3000}「『]"), F.lit(False))
    bad = lambda i, k: F.coalesce(reduce(lambda a, b: a + b, (at(i, k)[r] for r in N_FIRM)) > 0, F.lit(False))
    hit = lambda i: at(i, 0)["body"].rlike(profile.cues["brings"]) & (at(i, 0)["kind"] != "document") & ((fits(i, 1) & bad(i, 1)) | (fits(i, 1) & fits(i, 2) & bad(i, 2)) | (fits(i, 1) & fits(i, 2) & fits(i, 3) & bad(i, 3)))
    n = F.size("noted")
    found = F.when((n > 0) & (F.size(F.filter("noted", lambda p: F.startswith(p["raw"], F.lit("　")))) == 0), F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), hit)).otherwise(F.array().cast("array<int>"))
    return _finding("N10", F.when(F.size(found) > 0, "INFO"), F.size(found), F.size(found), F.get("noted", F.get(found, F.lit(0)))["line"] + 1)


def _rhythm(rows: DataFrame, profile: Profile, lines: R.Lines) -> tuple[DataFrame, list[tuple[str, Column]]]:
    c, g = F.col, R.GUARDS
    n, paras = c("sentences"), c("narration_paragraphs")
    short, short_blocks = _block_sums(lambda p: (p["kind"] == "narration") & (F.size(p["sents"]) <= 1) & (p["chars"] <= R.SHORT), lambda p: F.lit(1).cast("bigint"))
    quiet, quiet_blocks = _block_sums(lambda p: p["utterances"] == 0, lambda p: p["narr_chars"].cast("bigint"))
    talk, talk_blocks = _block_sums(lambda p: p["kind"] == "dialogue", lambda p: p["utterances"].cast("bigint"))
    uniform = lines.of("L04")[0] or 0.25
    rows = D.fixed(rows, short_at=short, quiet_at=quiet, talk_at=talk, uniform=S.uniform_starts("told", 5, uniform))
    rows = D.fixed(
        rows, same=_values(F.transform(F.filter("runs", lambda r: ~r["value"].isin("other", profile.noun)), lambda r: F.struct(r["length"].alias("n"), r["first"].alias("line"))), lambda r: r["n"]),
        nouns=_values(F.transform(F.filter("runs", lambda r: r["value"] == profile.noun), lambda r: F.struct(r["length"].alias("n"), r["first"].alias("line"))), lambda r: r["n"]),
        short_runs=short_blocks("short_at"), quiet_runs=quiet_blocks("quiet_at"), talk_runs=talk_blocks("talk_at"), taken=S.greedy("uniform", 5),
    )
    cv, warn = c("sentence_len_cv"), lines.of("L01")[1]
    over = lambda rule, rows_, k: F.filter(rows_, lambda x: x["chars"] > lines.of(rule)[k]) if lines.of(rule)[k] is not None else F.slice(rows_, 1, 0)
    p_info, p_warn = lines.of("P01")[:2]
    info_paras = F.filter("narration", lambda p: (p["chars"] > p_info) & ((p["chars"] <= p_warn) if p_warn else F.lit(True)))
    low, high = R.P03_BAND[lines.work]
    rate, nouns = c("one_sentence_paragraph_rate"), S.number_of(c("told"), lambda s: s["cls"] == profile.noun)
    outside = (rate > high) | (rate < (low if low is not None else -1.0))
    p5 = lines.of("P05")
    quiet_long = F.filter("quiet_runs", lambda b: b["value"] > (p5[0] or p5[1]))
    density = rounded(nouns * 1000 / F.nullif(c("narration_chars"), F.lit(0)), 1)
    polite = lines.of("R01", "polite")
    return rows, [
        ("R01", F.when(c("keitai"), _by_level("R01", "same", polite)).otherwise(_by_level("R01", "same", lines.of("R01"))) if profile.polite else _by_level("R01", "same", lines.of("R01"))),
        ("R02", _finding("R02", F.when(n >= g["run_share_min_sentences"], R.level(c("same_ending_run_share"), "R02", lines=lines.of("R02"))), c("same_ending_run_share"))),
        ("R03", _finding("R03", F.when((n >= g["run_share_min_sentences"]) & ~c("keitai"), R.level(c("ta_rate"), "R03", lines=lines.of("R03"))), c("ta_rate"))),
        ("L01", _finding("L01", F.when(n >= g["cv_full_sentences"], R.level(cv, "L01", lines=lines.of("L01"))).when((n >= g["cv_min_sentences"]) & (cv < warn), "INFO"), cv)),
        ("L02", _finding("L02", F.when(n >= g["cv_min_sentences"], R.level(c("sentence_len_mean"), "L02", lines=lines.of("L02"))), c("sentence_len_mean"))),
        ("L03", _listed("L03", "INFO", over("L03", c("told"), 0))),
        ("L04", _finding("L04", F.when((n >= 8) & (F.size("taken") > 0), "INFO"), F.size("taken"), F.size("taken"), F.get("told", F.get("taken", F.lit(0)))["line"])),
        ("P01", F.concat(_listed("P01", "WARN", over("P01", c("narration"), 1)), _listed("P01", "INFO", info_paras))),
        ("P02", _finding("P02", F.when(paras >= g["para_cv_min_paras"], R.level(c("paragraph_len_cv"), "P02", lines=lines.of("P02"))), c("paragraph_len_cv"))),
        ("P03", _finding("P03", F.when((paras >= g["para_cv_min_paras"]) & outside, "INFO"), rate)),
        ("P04", _by_level("P04", "short_runs", lines.of("P04"))),
        ("P05", _finding("P05", F.when((c("utterances") > 0) & (F.size(quiet_long) > 0), "INFO" if p5[0] else "WARN"), F.array_max(F.transform(quiet_long, lambda b: b["value"])), F.size(quiet_long), _first(quiet_long))),
        ("T01", _by_level("T01", "nouns", lines.of("T01"))),
        ("T02", _finding("T02", F.when((c("narration_chars") >= g["density_min_chars"]) & (nouns >= g["density_min_count"]), R.level(density, "T02", lines=lines.of("T02"))), density, nouns)),
    ]


def _dialogue(rows: DataFrame, profile: Profile, lines: R.Lines) -> tuple[DataFrame, list[tuple[str, Column]]]:
    c, g = F.col, R.GUARDS
    target, tolerance = R.D01_TARGET[lines.work]
    off = F.abs(c("dialogue_ratio") - target)
    least = lines.of("D03")[0]
    # where each utterance stands: the visible characters before its paragraph
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<struct<pos:bigint,n:int,line:int>>").alias("out"))
    step = lambda s, p: F.struct((s["sum"] + p["chars"]).alias("sum"), F.when(p["utterances"] > 0, F.concat(s["out"], F.array(F.struct(s["sum"].alias("pos"), p["utterances"].cast("int").alias("n"), p["line"].alias("line"))))).otherwise(s["out"]).alias("out"))
    rows = D.fixed(rows, places=F.flatten(F.transform(F.aggregate("paras", start, step)["out"], lambda x: F.array_repeat(F.struct(x["pos"].alias("pos"), x["line"].alias("line")), x["n"]))))
    at = lambda i: F.get("places", i.cast("int"))
    full = F.when(F.size("places") >= least, F.filter(F.sequence(F.lit(0), F.greatest(F.size("places") - least, F.lit(0))), lambda i: at(i + (least - 1))["pos"] - at(i)["pos"] <= R.WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = D.fixed(rows, crowded=F.transform(full, lambda i: at(i)))
    zero = F.struct(F.lit(-1).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))
    windows = F.aggregate("crowded", zero, lambda s, x: F.when(x["pos"] > s["last"], F.struct((x["pos"] + R.WINDOW).alias("last"), (s["n"] + 1).alias("n"))).otherwise(s))["n"]
    hesitant = total(F.transform("paras", lambda p: F.when(p["utterances"] > 0, F.regexp_count(p["body"], F.lit(profile.hesitant))).otherwise(0)))
    share = rounded(hesitant / F.nullif(c("utterances"), F.lit(0)))
    return rows, [
        ("D01", _finding("D01", F.when((c("chars") >= g["density_min_chars"]) & (off > tolerance), "INFO"), c("dialogue_ratio"))),
        ("D02", _by_level("D02", "talk_runs", lines.of("D02"))),
        ("D03", _finding("D03", F.when(F.size("crowded") > 0, "INFO"), windows, windows, _first(c("crowded")))),
        ("K03", _finding("K03", F.when(c("utterances") >= g["dialogue_rate_min_utterances"], R.level(share, "K03", lines=lines.of("K03"))), share, hesitant)),
    ]


def _densities(rows: DataFrame, profile: Profile, lines: R.Lines) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Densities by rule, with the guard for short texts (K00), repeats, and what is counted by sentence and paragraph."""
    c, g = F.col, R.GUARDS
    joined = lambda name: F.array_join(F.transform("paras", lambda p: p[name]), "\n")
    rows = D.fixed(rows, narr_text=T.searched(joined("narr"), profile), total_text=T.searched(joined("body"), profile), plain_text=joined("body"), heads=F.transform("told", lambda s: T.searched(s["sentence"], profile)))
    starts = lambda pattern: S.number_of(c("heads"), lambda h: h.rlike(pattern))
    used = {r: u for r, u in R.DENSITY.items() if lines.on(r)}
    count = {r: F.regexp_count(c(f"{u}_text"), F.lit(profile.lexicon[r])).cast("bigint") for r, (u, _) in used.items() if r in profile.lexicon}
    count |= {r: starts(p) for r, p in (("K04", profile.heads), ("K26", profile.first)) if r in used}
    rows = D.fixed(rows, counts=F.struct(*(x.alias(r) for r, x in count.items())), dashes=F.regexp_count("plain_text", F.lit(f"(?:{profile.dash}){{2,}}")), dots=F.regexp_count("plain_text", F.lit(f"(?:{profile.ellipsis}){{2,}}|・{{3,}}")), head_count=starts(profile.heads))
    base = lambda unit: c("narration_chars") if unit == "narr" else c("chars")
    short = (c("chars") < g["density_min_chars"]) | F.lit(lines.length == "flash")
    hits = lambda r: c("counts")[r]
    dense = lambda r: rounded(hits(r) * 1000 / F.nullif(base(used[r][0]), F.lit(0)), 2)
    guarded = lambda r: short | (base(used[r][0]) < g["density_min_chars"])
    found = [(r, _finding(r, F.when(~guarded(r) & (hits(r) >= least), R.level(dense(r), r, lines=lines.of(r))), dense(r), hits(r))) for r, (_, least) in used.items()]
    groups = reduce(lambda a, b: a + b, (F.when(guarded(r) & (hits(r) > 0), 1).otherwise(0) for r in used), F.lit(0))
    found.append(("K00", _finding("K00", F.when(groups > 0, "INFO"), groups, groups)))
    for rule, name in (("K01", "dashes"), ("K02", "dots")):
        value = rounded(c(name) * 1000 / F.nullif(c("chars"), F.lit(0)), 2)
        found.append((rule, _finding(rule, F.when(~short & (c(name) >= g["density_min_count"]), R.level(value, rule, lines=lines.of(rule))), value, c(name))))
    if "K08" in used and "K09" in used:
        both = hits("K08") + hits("K09")
        found.append(("K08", _finding("K08", F.when(~short & (base("narr") >= g["density_min_chars"]) & (both >= g["density_min_count"]), "INFO"), rounded(dense("K08") + dense("K09"), 2), both)))
    words = lambda text, p, group=0: F.regexp_extract_all(text, F.lit(p), F.lit(group))
    more = lambda ws, least: F.size(F.filter(F.array_distinct(ws), lambda w: F.size(F.filter(ws, lambda x: x == w)) >= least))
    rows = D.fixed(rows, vehicles=words(c("total_text"), profile.vehicle, 1), reactions=words(c("narr_text"), profile.lexicon["K09"]), soft=F.when(hits("K10") >= 3, T.offsets(c("narr_text"), profile.lexicon["K10"])).otherwise(F.array().cast("array<struct<pos:int,hit:string>>")) if "K10" in used else F.array().cast("array<struct<pos:int,hit:string>>"))
    twice, again = more(c("vehicles"), lines.of("S03")[1]), more(c("reactions"), R.REPEATS["K09"][0] + 1)
    limit, window = R.REPEATS["K10"]
    places = lambda w: F.transform(F.filter("soft", lambda x: x["hit"] == w), lambda x: x["pos"])
    close = lambda p: F.exists(F.transform(p, lambda x, i: F.get(p, i + (limit - 1)) - x), lambda d: d <= window)
    near = F.size(F.filter(F.array_distinct(F.transform("soft", lambda x: x["hit"])), lambda w: F.coalesce(close(places(w)), F.lit(False))))
    found += [
        ("S03", _finding("S03", F.when(twice > 0, "WARN"), twice, twice)), ("K09", _finding("K09", F.when(~guarded("K09") & (again > 0), "WARN"), again, again) if "K09" in used else _NONE()),
        ("K10", _finding("K10", F.when(~guarded("K10") & (near > 0), "WARN"), near, near) if "K10" in used else _NONE()),
    ]
    n, paras = c("sentences"), c("narration_paragraphs")
    opening = S.number_of(c("narration"), lambda p: T.searched(T.trimmed(p["body"]), profile).rlike(profile.heads))
    many = F.filter("told", lambda s: s["commas"] >= lines.of("K17")[0])
    k05, k06 = rounded(c("head_count") / F.nullif(n, F.lit(0))), rounded(opening / F.nullif(paras, F.lit(0)))
    rows = D.fixed(rows, swaps=_swaps(profile))
    return rows, found + [
        ("K05", _finding("K05", F.when(~short & (n >= g["run_share_min_sentences"]), R.level(k05, "K05", lines=lines.of("K05"))), k05, c("head_count"))),
        ("K06", _finding("K06", F.when(~short & (n >= g["run_share_min_sentences"]) & (paras >= g["para_cv_min_paras"]), R.level(k06, "K06", lines=lines.of("K06"))), k06, opening)),
        ("K17", F.when(short, _NONE()).otherwise(_listed("K17", "INFO", many))), ("K30", _listed("K30", "INFO", c("swaps"))),
    ]


def _swaps(profile: Profile) -> Column:
    """Neighbouring short sentences of narration, one comma each, the second of which is the first with its halves changed over: {line}."""
    half = lambda s, k: T.trimmed(F.regexp_extract(F.lower(F.regexp_replace(s, r"[.。!?！？]+$", "")), profile.swap, k))
    sent = lambda s: F.struct(s["line"].alias("line"), ((s["chars"] <= R.SWAP_SHORT) & (s["commas"] == 1)).alias("fit"), half(s["sentence"], 1).alias("a"), half(s["sentence"], 2).alias("b"))
    stop = F.array(F.struct(F.lit(0).alias("line"), F.lit(False).alias("fit"), F.lit("").alias("a"), F.lit("").alias("b")))
    chain = F.flatten(F.transform("paras", lambda p: F.when(p["kind"] == "narration", F.transform(F.filter(p["sents"], lambda s: ~s["tag"]), sent)).otherwise(stop)))
    # a sentence with the one after it, by shifting the chain
    pairs = F.zip_with(chain, F.slice(F.concat(chain, stop), 2, F.greatest(F.size(chain), F.lit(0))), lambda x, y: F.struct(x["line"].alias("line"), (x["fit"] & y["fit"] & (x["a"] != "") & (x["a"] == y["b"]) & (x["b"] == y["a"])).alias("hit")))
    return F.transform(F.filter(pairs, lambda x: x["hit"]), lambda x: F.struct(x["line"].alias("line")))


def _whole(profile: Profile, forbidden: tuple[str, ...], variants: tuple[tuple[str, str], ...]) -> list[tuple[str, Column]]:
    c = F.col
    prose = F.filter("lines", lambda s: T.trimmed(s["raw"]) != "")
    meta = lambda rows: F.filter(rows, lambda s: s["raw"].rlike(profile.cues["meta"]) & ~T.trimmed(s["raw"]).rlike(r'^[「『"]'))
    n = F.size(prose)
    edges = F.when(n <= 10, meta(prose)).otherwise(F.concat(meta(F.slice(prose, 1, 5)), meta(F.slice(prose, F.greatest(n - 4, F.lit(1)), 5))))
    before = F.transform("paras", lambda p, i: F.struct(p["line"].alias("line"), p["body"].alias("body"), total(F.transform(F.slice("paras", 1, F.least(i, F.lit(200))), lambda q: q["chars"])).alias("before")))
    opens = F.filter(F.slice(before, 1, 200), lambda p: (p["before"] < 200) & p["body"].rlike(profile.cues["opens"]))
    closes = F.filter(F.slice("paras", F.greatest(F.size("paras") - 1, F.lit(1)), 2), lambda p: p["body"].rlike(profile.cues["closes"]))
    craft = F.regexp_count("narr_text", F.lit(profile.cues["craft"]))
    markdown = F.filter("lines", lambda s: s["raw"].rlike(N_MARKDOWN))
    holds = lambda words: [F.filter("paras", lambda p: F.contains(p["body"], F.lit(w))) for w in words]  # noqa: E731, B023
    named = lambda rule, words: F.concat(*(_listed(rule, "WARN", x) for x in holds(words))) if words else _NONE()
    return [
        ("M01", _finding("M01", F.when(c("chars") == 0, "FAIL").when(c("chars") < R.GUARDS["body_min_chars"], "WARN"), c("chars"))), ("M02", _listed("M02", "WARN", edges)), ("N07", _listed("N07", "WARN", markdown)),
        ("X01", _finding("X01", F.when(craft > 0, "WARN"), craft, craft)), ("G01", named("G01", forbidden)), ("G02", named("G02", tuple(v for v, _ in variants))), ("O01", _listed("O01", "INFO", opens)), ("O02", _listed("O02", "INFO", closes)),
    ]


def lint(docs: DataFrame, profile: Profile = LATIN, lines: R.Lines | None = None, forbidden: tuple[str, ...] = (), variants: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """doc_id, place, rule, severity, value, hits, line: the findings of each document, the gravest first, then by rule.

    lines: alarm lines of the work, with what is left out.  A text without body has M01 and N07 only.  Null texts are empty.
    """
    lines = lines or R.Lines()
    rows = S.figures(docs, profile)
    checks: list[tuple[str, Column]] = []
    for group in (lambda r: _notation(r, profile), lambda r: _rhythm(r, profile, lines), lambda r: _dialogue(r, profile, lines), lambda r: _densities(r, profile, lines)):
        rows, more = group(rows)
        checks += more
    whole = _whole(profile, forbidden, variants)
    always = [f for r, f in whole if r in ("M01", "N07") and lines.on(r)]
    some = [f for r, f in [*checks, *whole] if r not in ("M01", "N07") and lines.on(r)]
    found = F.concat(*always, F.when(F.col("chars") > 0, F.concat(*some)).otherwise(_NONE()) if some else _NONE(), _NONE())
    key = lambda f: F.struct(R.rank(f["severity"]).alias("rank"), f["rule"].alias("rule"), (-f["value"]).alias("v"), (-f["hits"]).alias("h"), F.coalesce(f["line"], F.lit(0)).alias("at"), f.alias("f"))
    rows = D.fixed(rows.withColumn("found", found).select("doc_id", "found"), found=F.array_sort(F.transform("found", key)))
    return rows.select("doc_id", F.posexplode("found").alias("place", "x")).select("doc_id", (F.col("place") + 1).alias("place"), "x.f.*")


def ja(docs: DataFrame, **more) -> DataFrame:
    return lint(docs, JAPANESE, **more)
