"""Alarm lines and findings: at most one level a value, the strictest that it reaches; never an overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Alarm lines of each rule and profile, (info, warn, strong); a lower rule fires below its line, others at it.
LEVELS = {
    "R01": {"default": (4, 6, 8), "polite": (5, 8, 12)},
    "R02": {"default": (None, 0.35, 0.5)},
    "R03": {"default": (None, 0.8, None)},
    "L01": {"default": (0.5, 0.4, None)},
    "L02": {"default": (22, None, None), "web": (15, None, None)},
    "L03": {"bungei": (120, None, None), "entertainment": (100, None, None), "web": (80, None, None)},
    "L04": {"default": (0.25, None, None)},
    "P01": {"default": (400, None, None), "web": (200, 300, None)},
    "P02": {"default": (0.55, 0.45, None), "web": (0.45, None, None)},
    "P04": {"default": (4, None, None), "web": (6, None, None)},
    "P05": {"bungei": (1500, None, None), "entertainment": (None, 800, None), "web": (None, 600, None)},
    "T01": {"default": (2, 3, None), "web": (3, 4, None)},
    "T02": {"default": (None, 4, None), "web": (None, 6, None)},
    "D01": {"default": (0.15, None, None)},
    "D02": {"default": (None, 8, 12), "bungei": (None, 7, 10)},
    "D03": {"default": (14, None, None)},
    "S01": {"default": (5, 7, None)},
    "S02": {"default": (None, 1.0, None)},
    "S03": {"default": (None, 2, None)},
    "K01": {"bungei": (3, 5, None), "entertainment": (4, 6, None), "web": (5, 8, None)},
    "K02": {"bungei": (3, 5, None), "entertainment": (6, 10, None), "web": (8, 12, None)},
    "K03": {"default": (None, 0.15, None), "web": (None, 0.2, None)},
    "K04": {"default": (4, 5, None)},
    "K05": {"default": (0.12, 0.15, None)},
    "K06": {"default": (None, 0.25, None)},
    "K07": {"default": (1.7, 2.5, None), "web": (2.5, 3.5, None)},
    "K08": {"default": (2, 4, None)},
    "K09": {"default": (1.5, 3, None)},
    "K10": {"default": (2, 4, None)},
    "K11": {"default": (3, 5, None)},
    "K12": {"default": (None, 1.33, None)},
    "K13": {"default": (2, 3, None)},
    "K14": {"default": (5, 7, None)},
    "K15": {"default": (1, 2.5, None)},
    "K16": {"default": (None, 0.67, None)},
    "K17": {"default": (4, None, None)},
    "K18": {"default": (0.7, 1.5, None)},
    "K19": {"default": (2.5, 4.5, None)},
    "K20": {"default": (0.8, 1.6, None)},
    "K21": {"default": (1.5, 3, None)},
    "K22": {"default": (2.5, 5, None)},
    "K23": {"default": (0.7, 1.4, None)},
    "K24": {"default": (0.3, None, None)},
    "K25": {"default": (1.5, 3, None)},
    "K26": {"default": (6, 9, None)},
    "K27": {"default": (0.5, 1.0, None)},
    "K28": {"default": (0.5, 1.0, None)},
    "K29": {"default": (1.0, 2.0, None)},
    "K30": {"default": (1, None, None)},
}
LOWER = {"L01", "L02", "P02"}
#: What a density is counted in (narration or all) and the least number of hits, for each rule with a lexicon.
DENSITY = {
    "S01": ("narr", 3), "S02": ("total", 2), "K04": ("narr", 3), "K07": ("narr", 3), "K08": ("narr", 3), "K09": ("narr", 3), "K10": ("narr", 3), "K11": ("narr", 3), "K12": ("narr", 2), "K13": ("narr", 3),
    "K14": ("narr", 3), "K15": ("narr", 3), "K16": ("total", 2), "K18": ("narr", 2), "K19": ("total", 3), "K20": ("narr", 2), "K21": ("narr", 3), "K22": ("narr", 3), "K23": ("narr", 2), "K24": ("total", 1),
    "K25": ("total", 3), "K26": ("narr", 3), "K27": ("narr", 2), "K28": ("narr", 2), "K29": ("narr", 3),
}
#: Fixed values: (limit, window in characters) of words that a rule doesn't want again; without a window they count anywhere.
REPEATS = {"K09": (2, None), "K10": (3, 2000)}
#: Band of one-sentence paragraphs and dialogue targets.
P03_BAND = {"bungei": (None, 0.5), "entertainment": (None, 0.7), "web": (0.15, 0.85)}
D01_TARGET = {"bungei": (0.3, 0.15), "entertainment": (0.45, 0.15), "web": (0.45, 0.15)}
GUARDS = {"density_min_chars": 600, "density_min_count": 3, "run_share_min_sentences": 20, "cv_min_sentences": 12, "cv_full_sentences": 30, "para_cv_min_paras": 8, "dialogue_rate_min_utterances": 10, "body_min_chars": 100}
#: Short paragraphs of P04, short sentences of K30, characters of a window of D03, and what a short form of work leaves out.
SHORT, SWAP_SHORT, WINDOW = 25, 30, 300
FLASH_SKIPS = ("P02", "P03", "P05", "D01", "L04", "K06")
SEVERITIES = ("FAIL", "STRONG", "WARN", "INFO")
GROUPS = "NRLPTSDKCMXGO"


class Lines:
    """Alarm lines of a work: an override wins over the profile, the profile over the default.

    overrides: rule -> {"off": True} or {"info": ..., "warn": ..., "strong": ..., "reason": ...}; direct: a work that names emotions by contract.
    only, skip: letters or ids of rules.
    """

    def __init__(self, work: str = "entertainment", overrides: dict | None = None, direct: bool = False, length: str = "long", only: tuple[str, ...] = (), skip: tuple[str, ...] = ()):
        self.work, self.overrides, self.direct, self.length, self.only, self.skip = work, overrides or {}, direct, length, only, skip

    def on(self, rule: str) -> bool:
        named = lambda names: any(rule == n or (len(n) == 1 and rule.startswith(n)) for n in names)
        own = self.overrides.get(rule) or {}
        if own.get("off") or (self.only and not named(self.only)) or named(self.skip) or (self.length == "flash" and rule in FLASH_SKIPS):
            return False
        return not (self.direct and rule == "K08" and not own.get("enable"))

    def of(self, rule: str, variant: str | None = None) -> tuple:
        table = LEVELS[rule]
        base = dict(zip(("info", "warn", "strong"), (variant and table.get(variant)) or table.get(self.work) or table.get("default") or (None,) * 3, strict=True))
        base |= {k: v for k, v in (self.overrides.get(rule) or {}).items() if k in base}
        return tuple(base.values())


def level(value: Column, rule: str, profile: str = "default", lines: tuple | None = None) -> Column:
    """Severity of a value by the lines of a rule and profile, null below all of them and for a null value."""
    info, warn, strong = lines or LEVELS[rule].get(profile) or LEVELS[rule]["default"]
    reached = (lambda line: value < line) if rule in LOWER else (lambda line: value >= line)
    out = F.lit(None).cast("string")
    for name, line in (("INFO", info), ("WARN", warn), ("STRONG", strong)):
        if line is not None:
            out = F.when(reached(F.lit(line)), name).otherwise(out)
    return out


def sql_level(value: str, rule: str, profile: str = "default", lines: tuple | None = None) -> str:
    info, warn, strong = lines or LEVELS[rule].get(profile) or LEVELS[rule]["default"]
    sign = "<" if rule in LOWER else ">="
    parts = [f"WHEN {value} {sign} {line} THEN '{name}'" for name, line in (("STRONG", strong), ("WARN", warn), ("INFO", info)) if line is not None]
    return f"CASE {' '.join(parts)} END" if parts else "NULL"


def findings(rows: DataFrame, rule: str, value: Column, severity: Column) -> DataFrame:
    """doc_id, rule, severity, value of the rows that have a severity."""
    return rows.select("doc_id", F.lit(rule).alias("rule"), severity.alias("severity"), value.cast("double").alias("value")).filter("severity IS NOT NULL")


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity)


def totals(found: DataFrame) -> DataFrame:
    """severity, findings: how many of each, never one figure over all."""
    return found.groupBy("severity").agg(F.count("*").alias("findings"))


def parse_range(spec: str) -> tuple[int, int, int] | None:
    """(least, most, least that still passes) of "1200-1500" or "about 1500" as a bare number; null if it can't be read."""
    import re

    m = re.fullmatch(r"\s*(\d+)\s*(?:[-〜~]\s*(\d+))?\s*", spec or "")
    if not m:
        return None
    if m[2]:
        return (int(m[1]), int(m[2]), int(m[1])) if int(m[1]) <= int(m[2]) else None
    low, high = round(int(m[1]) * 0.9), round(int(m[1]) * 1.1)
    return low, high, low - round(low * 0.03)


def range_status(chars: Column, spec: str) -> Column:
    """A struct (status under, in or over; off_by) of a number of characters; a bare number allows a tenth either way and 3 % below that."""
    low, high, floor = parse_range(spec) or (None, None, None)
    if low is None:
        return F.lit(None).cast("struct<status:string,off_by:bigint>")
    status = F.when(chars < floor, "under").when(chars > high, "over").otherwise("in")
    return F.struct(status.alias("status"), F.when(chars < floor, low - chars).when(chars > high, chars - high).otherwise(0).cast("bigint").alias("off_by"))
