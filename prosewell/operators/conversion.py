"""Manuscripts in the notation of a target, and the proof that nothing else was changed.

A document is converted within its row: its lines are an array, blank lines are put in by what stands before and after.  Verification
turns the output back by other patterns than those that made it, and compares it with the source line by line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prosewell.functions import text as T
from prosewell.operators import counting
from prosewell.operators import decompose as D

#: Targets and their notations, limits of ruby (base, reading) and of a text, and the share of it that is told.
TARGETS = ("narou", "kakuyomu", "alphapolis", "pixiv", "plain")
HEADINGS = {"pixiv": "chapter", "plain": "text"}
MEDIUM = {"narou": "narou", "kakuyomu": "kakuyomu", "alphapolis": "alphapolis", "pixiv": "pixiv", "print": "plain"}
PROJECT_INDENT = {"export": "add", "fullwidth": "keep", "none": "keep"}
RUBY_LIMITS = {"narou": (10, 10), "kakuyomu": (20, 50)}
BODY_LIMITS = {"narou": 70_000, "alphapolis": 100_000}
NEAR_LIMIT = 0.95
FORBIDDEN = {"alphapolis": "#|__", "pixiv": r">|\]\]"}
TAGS = {"alphapolis": r"#[^#\n]+?__[^#\n]+?__#", "pixiv": r"\[\[(?:rb|emphasismark|jumpuri):|\[(?:newpage\]|chapter:|jump:|pixivimage:|uploadedimage:|b:|i:)"}
PAREN_RUBY = f"[{T.KANJI}][(（][{T.KANA}]+[)）]"
DOCUMENTS, PARTED = ("document", "docblank"), ("scene", "symbol", "heading")


@dataclass(frozen=True)
class Options:
    target: str
    indent: str = "add"  # add, keep, remove
    blank: str = "keep"  # keep, none, dialogue, para
    heading: str = "drop"  # drop, text, chapter, keep
    bouten: str = "keep"  # keep, strip
    ruby: str = "keep"  # of plain: keep, paren, drop
    scene_break: str = ""
    emphasis_mark: str = "﹅"

    @property
    def strips(self) -> bool:
        """Whether emphasis goes; targets with a notation of their own for it keep it."""
        return self.bouten == "strip" and self.target not in ("kakuyomu", "pixiv")

    @property
    def inline(self) -> str:
        return {"paren": "plain_paren", "drop": "plain_drop"}.get(self.ruby, "plain") if self.target == "plain" else self.target


def resolve(target: str | None = None, medium: str | None = None, project_indent: str | None = None, join: bool = False, **given) -> Options:
    """What is given wins over the project, the project over the default of the target."""
    target = target or MEDIUM.get(medium or "")
    if target not in TARGETS:
        raise ValueError(f"no target for medium {medium!r}")
    if join and target not in ("pixiv", "plain"):
        raise ValueError(f"{target} takes one text at a time")
    own = {"indent": PROJECT_INDENT.get(project_indent or "", "add"), "heading": HEADINGS.get(target, "drop")} | {k: v for k, v in given.items() if v is not None}
    if len(own.get("emphasis_mark", "﹅")) != 1:
        raise ValueError("an emphasis mark is one character")
    return Options(target, **own)


def inline(line: Column, o: Options) -> Column:
    """Ruby and emphasis of a line in the notation of the target; nothing else is touched."""
    return counting.render(line, o.inline if o.strips or o.inline != "plain_drop" else "plain_bare", o.emphasis_mark, o.strips)


def _items(text: Column, o: Options) -> Column:
    """{kind, text} of each line; headings that are left out are dropped ones."""
    rows = D._with(D._lines(text), ("kind",), body=lambda s: s["body0"], shown=lambda s: F.when(s["kind"].isin("blank", "docblank", "symbol"), s["body0"]).otherwise(inline(s["body0"], o)))
    lead = lambda c: c.rlike(r"^[\s\x{3000}]")
    narration = {"add": lambda c: F.when(~lead(c), F.concat(F.lit("　"), c)).otherwise(c), "remove": lambda c: F.when(F.startswith(c, F.lit("　")), F.substring(c, 2, 1 << 30)).otherwise(c), "keep": lambda c: c}[o.indent]
    title = {"text": lambda c: inline(T.heading_title(c), o), "chapter": lambda c: F.concat(F.lit("[chapter:"), inline(T.heading_title(c), o), F.lit("]")), "keep": lambda c: c, "drop": lambda c: F.lit("")}[o.heading]
    made = lambda s: (
        F.when(s["kind"] == "docblank", "").when(s["kind"] == "heading", title(s["body"])).when((s["kind"] == "scene") & F.lit(bool(o.scene_break)), o.scene_break)
        .when(s["kind"].isin("scene", "symbol", "blank"), s["body"]).when(s["kind"] == "narration", narration(s["shown"])).otherwise(s["shown"])
    )
    kind = lambda s: F.when((s["kind"] == "heading") & F.lit(o.heading == "drop"), "dropped").otherwise(s["kind"])
    return F.transform(rows, lambda s: F.struct(kind(s).alias("kind"), made(s).alias("text")))


def needs_gap(prev: Column, kind: Column, policy: str) -> Column:
    """Whether a blank line stands between two lines that follow each other."""
    parted = prev.isin(*PARTED) | kind.isin(*PARTED)
    rest = {"para": F.lit(True), "dialogue": (prev == "dialogue") != (kind == "dialogue"), "none": F.lit(False)}[policy]
    return F.when(parted | (prev.isin(*DOCUMENTS) != kind.isin(*DOCUMENTS)), True).when(prev.isin(*DOCUMENTS), False).otherwise(rest)


def _spaced(policy: str) -> Column:
    """The texts of the array column ``items`` with the blank lines of a policy."""
    kind = lambda i: F.get("items", i)["kind"]
    if policy == "keep":
        # a heading that goes still parts two documents
        around = lambda i: F.coalesce(F.try_element_at(F.filter(F.slice("items", F.lit(1), i), lambda x: x["kind"] != "dropped"), F.lit(-1))["kind"].isin(*DOCUMENTS), F.lit(False)) & F.coalesce(F.get(F.filter(F.slice("items", i + 2, F.size("items")), lambda x: x["kind"] != "dropped"), F.lit(0))["kind"].isin(*DOCUMENTS), F.lit(False))
        return F.flatten(F.transform("items", lambda x, i: F.when(x["kind"] != "dropped", F.array(x["text"])).when(around(i), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))
    at = lambda k: F.get("kept", k)
    split = lambda i, j: (i - j > 1) & kind(i).isin(*DOCUMENTS) & kind(j).isin(*DOCUMENTS)
    gap = lambda i, k: F.coalesce(F.when(k > 0, split(i, at(k - 1)) | needs_gap(kind(at(k - 1)), kind(i), policy)), F.lit(False))
    return F.flatten(F.transform("kept", lambda i, k: F.when(gap(i, k), F.array(F.lit(""), F.get("items", i)["text"])).otherwise(F.array(F.get("items", i)["text"]))))


def convert_text(docs: DataFrame, o: Options) -> DataFrame:
    """doc_id, out, stats (lines, headings, emphasis, ruby, scene_breaks, document_lines, indent_added, indent_already, indent_removed).

    Blank lines at either end go.  Null and empty texts give an empty one.
    """
    rows = D.fixed(docs.select("doc_id", "text"), lines=D._lines(F.col("text")), items=_items(F.col("text"), o))
    rows = D.fixed(rows, kept=F.filter(F.transform("items", lambda x, i: F.when(~x["kind"].isin("blank", "dropped"), i)), lambda i: i.isNotNull()))
    rows = D.fixed(rows, out=F.array_join(_spaced(o.blank), "\n"))
    edge = rf"^(?:[{T.BLANKS.replace(chr(10), '')}]*\n)+|(?:\n[{T.BLANKS.replace(chr(10), '')}]*)+$"
    whole = F.when(T.trimmed(F.col("out")) == "", "").otherwise(F.regexp_replace("out", edge, ""))
    n = lambda hit: F.size(F.filter("lines", hit)).cast("bigint")
    prose = F.filter("lines", lambda s: ~s["kind"].isin("blank", "docblank", "scene", "symbol") & ((s["kind"] != "heading") | F.lit(o.heading != "drop" and o.heading != "keep")))
    hits = lambda p, clean=None: F.aggregate(prose, F.lit(0).cast("bigint"), lambda k, s: k + F.regexp_count(F.regexp_replace(s["body0"], clean, "") if clean else s["body0"], F.lit(p)))
    full, spaced = (lambda s: F.startswith(s["body0"], F.lit("　"))), (lambda s: s["body0"].rlike(r"^[\s\x{3000}]"))
    narration = lambda s: s["kind"] == "narration"
    zero = F.lit(0).cast("bigint")
    stats = F.struct(
        n(lambda s: ~s["kind"].isin("blank", "docblank")).alias("lines"), F.transform(F.filter("lines", lambda s: s["kind"] == "heading"), lambda s: T.heading_title(s["body0"])).alias("headings"), hits(T.EMPHASIS).alias("emphasis"),
        hits(T.RUBY, T.EMPHASIS).alias("ruby"), n(lambda s: s["kind"] == "scene").alias("scene_breaks"), n(lambda s: s["kind"].isin(*DOCUMENTS)).alias("document_lines"),
        (n(lambda s: narration(s) & ~spaced(s)) if o.indent == "add" else zero).alias("indent_added"), (n(lambda s: narration(s) & full(s)) if o.indent == "add" else zero).alias("indent_already"),
        (n(lambda s: narration(s) & full(s)) if o.indent == "remove" else zero).alias("indent_removed"),
    )
    return rows.select("doc_id", whole.alias("out"), stats.alias("stats"))


def merge_stats(converted: DataFrame) -> DataFrame:
    """The figures of several texts together; of headings their number."""
    names = [f.name for f in converted.schema["stats"].dataType.fields if f.name != "headings"]
    return converted.agg(*(F.sum(f"stats.{n}").alias(n) for n in names), F.sum(F.size("stats.headings")).alias("headings"))


def join_outputs(converted: DataFrame, group: str, o: Options) -> DataFrame:
    """group, out: the texts of a group in the order of their ids, parted by a new page or a blank line.  A group is one publication, which its reader takes as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "out")))
    return converted.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["out"]), "\n[newpage]\n" if o.target == "pixiv" else "\n\n").alias("out"))


_HEADING = r"^#{1,6}[ \t\x{3000}]+(.*?)[ \t\x{3000}]*#*[ \t\x{3000}]*$"
#: A ruby with either bar, for the one that is compared.
_BARS = r"[｜|]([^｜|《》\n]+)《"


def _canonical(lines: Column, scene_break: str) -> Column:
    """{line, text, literal} of lines that aren't blank: without indentation, scene breaks and headings in one form, ruby with one bar."""
    rows = F.transform(lines, lambda s: F.struct(s["line"].alias("line"), s["is_doc"].alias("is_doc"), F.regexp_replace(s["text"], _BARS, "｜$1《").alias("literal"), F.ltrim(s["text"], F.lit("　")).alias("t")))
    rows = F.filter(rows, lambda s: T.trimmed(s["literal"]) != "")
    broken = F.translate(F.lit(scene_break), T.BLANKS, "")
    scene = lambda s: T.trimmed(s["t"]).rlike(T.SCENE) | ((broken != "") & (F.regexp_replace(s["t"], T.SPACE, "") == broken))
    text = lambda s: F.when(scene(s), "＊").otherwise(F.regexp_replace(F.when(s["t"].rlike(_HEADING), F.concat(F.lit("# "), F.regexp_extract(s["t"], _HEADING, 1))).otherwise(s["t"]), _BARS, "｜$1《"))
    return F.transform(rows, lambda s: F.struct(s["line"].alias("line"), s["is_doc"].alias("is_doc"), s["literal"].alias("literal"), text(s).alias("text")))


def project_source(text: Column, o: Options) -> Column:
    """What the source must come back as: marks of documents off, and what the options leave out."""
    rows = F.transform(F.split(T.normalized(text), "\n", -1), lambda r, i: F.struct((i + 1).alias("line"), F.startswith(r, F.lit(T.DOCUMENT_MARK)).alias("is_doc"), T.document_body(r).alias("text")))
    title = lambda s: ~s["is_doc"] & s["text"].rlike(_HEADING)
    if o.heading == "drop":
        rows = F.filter(rows, lambda s: ~title(s))

    def plain(s):
        c = F.when(title(s), F.regexp_extract(s["text"], _HEADING, 1)).otherwise(s["text"]) if o.heading == "text" else s["text"]
        own = F.regexp_replace(c, T.EMPHASIS, f"{counting.LEFT}$1{counting.RIGHT}")
        own = F.regexp_replace(own, T.RUBY, {"plain_paren": "$1（$2）", "plain_drop": "$1"}[o.inline]) if o.inline in ("plain_paren", "plain_drop") else own
        if o.strips:
            return F.translate(own, counting.LEFT + counting.RIGHT, "")
        return F.replace(F.replace(own, F.lit(counting.LEFT), F.lit("《《")), F.lit(counting.RIGHT), F.lit("》》"))

    return F.transform(rows, lambda s: F.struct(s["line"].alias("line"), s["is_doc"].alias("is_doc"), plain(s).alias("text")))


def reverse_output(out: Column, o: Options) -> Column:
    """The lines of an output in the notation of the source."""
    rows = F.transform(F.split(T.normalized(out), "\n", -1), lambda r, i: F.struct((i + 1).alias("line"), F.lit(False).alias("is_doc"), r.alias("text")))
    if o.target == "pixiv":
        rows = F.filter(rows, lambda s: T.trimmed(s["text"]) != "[newpage]")
        back = lambda c: counting.unrender(F.regexp_replace(c, r"^[\s\x{3000}]*\[chapter:(.*)\][\s\x{3000}]*$", "# $1"), "pixiv")
    else:
        back = lambda c: counting.unrender(c, o.target)
    return F.transform(rows, lambda s: F.struct(s["line"].alias("line"), s["is_doc"].alias("is_doc"), back(s["text"]).alias("text")))


def verify(docs: DataFrame, outputs: DataFrame, o: Options) -> DataFrame:
    """doc_id, place, kind (changed, missing, extra), source_line, output_line, expected, got: where an output isn't its source.  Nothing if all is well.

    Lines of documents are compared as they are written, all others in their canonical form.
    """
    rows = docs.select("doc_id", "text").join(outputs.select("doc_id", "out"), "doc_id", "left")
    rows = D.fixed(rows, want=_canonical(project_source(F.col("text"), o), o.scene_break), got=F.when(F.col("out") == "", F.array().cast("array<struct<line:int,is_doc:boolean,literal:string,text:string>>")).otherwise(_canonical(reverse_output(F.coalesce("out", F.lit("")), o), o.scene_break)))
    n = F.greatest(F.size("want"), F.size("got"))
    w, g = (lambda i: F.get("want", i)), (lambda i: F.get("got", i))
    said = lambda s, i: F.when(F.coalesce(w(i)["is_doc"], F.lit(False)), s["literal"]).otherwise(s["text"])
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct((i + 1).alias("place"), w(i)["line"].alias("source_line"), g(i)["line"].alias("output_line"), said(w(i), i).alias("expected"), said(g(i), i).alias("got"))))
    bad = F.filter(F.coalesce(pairs, F.array().cast("array<struct<place:int,source_line:int,output_line:int,expected:string,got:string>>")), lambda x: ~x["expected"].eqNullSafe(x["got"]))
    found = rows.select("doc_id", F.explode(bad).alias("x")).select("doc_id", "x.*")
    kind = F.when(F.col("expected").isNull(), "extra").when(F.col("got").isNull(), "missing").otherwise("changed")
    return found.select("doc_id", "place", kind.alias("kind"), "source_line", "output_line", "expected", "got")


def warnings(docs: DataFrame, o: Options) -> DataFrame:
    """doc_id, line, code of what an author should look at; line 0 is for a whole text (indent-mixed, size-limit)."""
    raw, kind = F.col("body"), F.col("kind")
    rows = docs.select("doc_id", F.explode(D._lines(F.col("text"))).alias("s")).select("doc_id", "s.line", F.col("s.body0").alias("body"), "s.kind")
    left = F.regexp_replace(F.regexp_replace(raw, T.EMPHASIS, ""), T.RUBY, "")
    rest = F.regexp_replace(left, T.BARE_RUBY, "$1")
    rubies = F.regexp_extract_all(F.regexp_replace(raw, T.EMPHASIS, ""), F.lit(T.RUBY), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, T.RUBY, k)
    shown = ~kind.isin("blank", "docblank", "scene", "symbol") & ((kind != "heading") | F.lit(o.heading in ("text", "chapter")))
    lead = raw.rlike(r"^[\s\x{3000}]")
    codes = {
        "raw-kakko": rest.rlike("[《》]"), "half-bar": shown & F.regexp_replace(raw, T.EMPHASIS, "").rlike(r"\|[^｜|《》\n]+《[^《》\n]+》"), "title-markup": (kind == "heading") & (raw.rlike(T.RUBY) | raw.rlike(T.EMPHASIS)),
        "indent-odd": (kind == "narration") & lead & ~raw.rlike(r"^\x{3000}(?:[^\s\x{3000}]|$)"), "indent-bracket": kind.isin("dialogue", "bracket") & lead,
    }
    if o.target in ("narou", "alphapolis") and not o.strips:
        codes["bouten-unsupported"] = shown & raw.rlike(T.EMPHASIS)
    if o.target in RUBY_LIMITS:
        a, b = RUBY_LIMITS[o.target]
        codes["ruby-length"] = shown & F.exists(rubies, lambda x: (F.length(part(x, 1)) > a) | (F.length(part(x, 2)) > b))
    if o.target in FORBIDDEN:
        codes["ruby-forbidden-char"] = shown & F.exists(rubies, lambda x: part(x, 1).rlike(FORBIDDEN[o.target]) | part(x, 2).rlike(FORBIDDEN[o.target]))
    if o.target in ("alphapolis", "pixiv", "plain"):
        codes["bare-ruby"] = left.rlike(T.BARE_RUBY)
    if o.target == "narou":
        codes["paren-ruby"] = rest.rlike(PAREN_RUBY)
    if o.target in TAGS:
        codes["collision"] = rest.rlike(TAGS[o.target])
    found = F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items())), lambda x: x.isNotNull()))
    out = rows.select("doc_id", "line", found.alias("code"))
    narration = lambda hit: F.exists("lines", lambda s: (s["kind"] == "narration") & hit(s["body0"]))
    mixed = D.fixed(docs.select("doc_id", "text"), lines=D._lines(F.col("text"))).filter(narration(lambda c: F.startswith(c, F.lit("　"))) & narration(lambda c: ~c.rlike(r"^[\s\x{3000}]")))
    out = out.union(mixed.select("doc_id", F.lit(0).alias("line"), F.lit("indent-mixed").alias("code")))
    if o.target in BODY_LIMITS:
        big = convert_text(docs, o).filter(F.length("out") >= BODY_LIMITS[o.target] * NEAR_LIMIT)
        out = out.union(big.select("doc_id", F.lit(0).alias("line"), F.lit("size-limit").alias("code")))
    return out
