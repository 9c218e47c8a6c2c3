"""Registry of queries and pieces of SQL that say the same as the operators, in another dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import LATIN, MARK, Profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Bytes of a scan for each core, below which its rows are dealt out before they are taken apart.
SMALL = 64 << 20


def spread(docs: DataFrame) -> DataFrame:
    """A small table is often one file of one row group, and so one task; its rows are dealt by doc_id.  A large one stays as it is read."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(cores, "doc_id") if size < SMALL * cores else docs


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(quoted, value))}]"
    return " || ".join("chr(10)" if part == "\n" else "'" + part.replace("'", "''") + "'" for part in _split_newlines(value)) or "''"


def _split_newlines(value: str) -> list[str]:
    out: list[str] = []
    for k, part in enumerate(value.split("\n")):
        if k:
            out.append("\n")
        if part:
            out.append(part)
    return out


def values(rows, names: str) -> str:
    """A table of constants as SQL."""
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({names})"


def inline(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def rounded(column: Column, digits: int = 3) -> Column:
    return F.round(column, digits)


def s_sub(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, 'g')"


def s_visible(text: str) -> str:
    return f"length({s_sub(text, T.SPACE)})"


def s_trim(text: str) -> str:
    return s_sub(text, rf"^{T.SPACE}+|{T.SPACE}+$")


def s_plain(text: str) -> str:
    return s_sub(s_sub(s_sub(text, T.EMPHASIS, r"\1"), T.RUBY, r"\1"), T.BARE_RUBY, r"\1")


def s_searched(text: str, profile: Profile) -> str:
    return f"' ' || {s_sub(s_sub(f'lower({text})', '^' + T.NOT_WORD), T.NOT_WORD, '  ')} || ' '" if profile.spaced else f"lower({text})"


def s_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def s_has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def s_document_body(line: str) -> str:
    return f"CASE WHEN {' OR '.join(f'starts_with({line}, {quoted(x)})' for x in (T.DOCUMENT_MARK, *T.ESCAPES))} THEN substr({line}, 2) ELSE {line} END"


def s_kind(line: str) -> str:
    body = f"({s_document_body(line)})"
    bare = s_trim(body)
    return f"""CASE WHEN starts_with({line}, '＞') THEN CASE WHEN {bare} = '' THEN 'docblank' ELSE 'document' END WHEN {bare} = '' THEN 'blank'
WHEN {s_has(body, T.HEADING)} THEN 'heading' WHEN {s_has(bare, T.SCENE)} THEN 'scene'
WHEN {s_has(bare, T.SYMBOLS)} AND NOT {s_has(bare, '[「『（]')} AND NOT {s_has(bare, T.SILENT)} THEN 'symbol'
WHEN {s_has(bare, '^[「『]')} THEN 'dialogue' WHEN {s_has(bare, '^[（【〈《]')} AND NOT starts_with({bare}, '《《') THEN 'bracket' ELSE 'narration' END"""


def s_end(sentence: str, profile: Profile) -> str:
    return f"right({s_sub(f'lower({sentence})', profile.tail)}, {profile.reach})"


def s_ending(end: str, profile: Profile) -> str:
    return f"CASE WHEN {end} = '' THEN 'other' " + " ".join(f"WHEN {s_has(end, p)} THEN {quoted(n)}" for n, p in profile.endings) + " ELSE 'other' END"


def s_marked(body: str, profile: Profile) -> str:
    out = s_sub(body, profile.utterance, MARK)
    for pattern, stays in profile.framed:
        out = s_sub(out, pattern, stays.replace("{1}", "\\1"))
    return out


def base(source: str = "documents", profile: Profile = LATIN) -> str:
    """CTEs line, kind, body, para (paras with silent ones), asent (all sentences), sent (those that count), tok (what runs are made of) over a source of (doc_id, text)."""
    norm = s_sub(s_sub("coalesce(text, '')", r"^\x{FEFF}"), r"\r\n?", "\n")
    opens = s_has(s_trim("body"), "^[「『]") if profile.name == "ja" else "false"
    return f"""WITH line AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS raw FROM (SELECT doc_id, string_split({norm}, chr(10)) AS p FROM {source})),
kind AS (SELECT doc_id, line, raw, {s_kind('raw')} AS kind FROM line),
body AS (SELECT *, {s_visible('body')} AS chars FROM (SELECT doc_id, line, raw, kind, {s_plain(s_document_body('raw'))} AS body FROM kind WHERE kind IN ('dialogue', 'bracket', 'narration', 'document'))),
told AS (SELECT doc_id, line, raw, body, chars, told, CASE WHEN told IS NULL THEN {s_marked('body', profile)} ELSE '' END AS marked FROM (
  SELECT *, CASE WHEN kind = 'document' THEN 'document' WHEN NOT {s_has('body', r'[\p{L}\p{N}]')} THEN 'silent' END AS told FROM body)),
paras AS (SELECT doc_id, line, raw, body, chars, marked, narr, {s_visible('narr')} AS narr_chars, utterances,
  coalesce(told, CASE WHEN {s_visible('narr')} = 0 AND utterances > 0 THEN 'dialogue' WHEN utterances > 0 OR {opens} THEN 'mixed' ELSE 'narration' END) AS kind
  FROM (SELECT *, replace(marked, {quoted(MARK)}, '') AS narr, length(marked) - length(replace(marked, {quoted(MARK)}, '')) AS utterances FROM told)),
piece AS (SELECT doc_id, line, kind, unnest(range(0, len(p))) AS idx, unnest(p) AS seg FROM (SELECT doc_id, line, kind, regexp_extract_all(marked, {quoted(profile.sentence)}) AS p FROM paras WHERE kind IN ('narration', 'mixed'))),
asent AS (SELECT doc_id, line, kind, idx, tag, sentence, chars, {s_ending('ending', profile)} AS cls, {s_count('sentence', profile.comma)} AS commas FROM (
  SELECT *, {s_end('sentence', profile)} AS ending, {s_visible('sentence')} AS chars FROM (SELECT *, {s_has('seg', profile.tag)} AS tag, {s_trim(f"replace(seg, {quoted(MARK)}, '')")} AS sentence FROM piece)) WHERE chars >= 2),
sent AS (SELECT * EXCLUDE (tag) FROM asent WHERE NOT tag),
para AS (SELECT p.doc_id, p.line, p.kind, p.chars, p.narr_chars, p.utterances, coalesce(n.n, 0) AS n_sent, p.body, p.narr FROM paras p LEFT JOIN (SELECT doc_id, line, count(*) AS n FROM asent GROUP BY doc_id, line) n USING (doc_id, line) WHERE p.kind <> 'silent'),
tok AS (SELECT doc_id, line, idx, cls AS value FROM sent UNION ALL SELECT doc_id, line, -1, 'D' FROM paras WHERE kind IN ('dialogue', 'document') UNION ALL SELECT doc_id, line, -2, 'D' FROM line WHERE starts_with(raw, {quoted(T.DOCUMENT_MARK)}))"""


def s_runs(rows: str, value: str, order: str = "line, idx") -> str:
    """A subquery: runs of one value in the order of a document."""
    first = order.split(",")[0]
    return f"""(SELECT doc_id, run, {value} AS value, count(*) AS length, min({first}) AS first FROM (
  SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY {order}) AS run FROM (
  SELECT *, CASE WHEN lag({value}) OVER (PARTITION BY doc_id ORDER BY {order}) IS NOT DISTINCT FROM {value} AND row_number() OVER (PARTITION BY doc_id ORDER BY {order}) > 1 THEN 0 ELSE 1 END AS turn FROM {rows}))
  GROUP BY doc_id, run, {value})"""


#: Our own lines of manuscripts, from which ``manuscripts`` are put together.
LINES = (
    "　駅には誰もいない。ベンチに｜鞄《かばん》がひとつ。", "「おはよう」", "「早いね」と友が言った。", "＊", "　風が《《強い》》。雨も降った。傘はない。歩いた。歩いた。歩いた。歩いた。", "",
    "# 朝の駅", "　窓を開けた。空が青かった。鳥が鳴いた。そして静かになった。", "「行こう『早く』ね」", "◇", "……", "（本当だろうか）", "　まるで夢のように遠い。彼女は笑った。彼女は泣いた。", "＞件名：連絡", "＞",
    "＞明日は休みです。", "　雨だった。", "　雪だった。", "　それでも明日は来る。しかし、彼は知らないかもしれない。", "「閉じない", "　括弧が」ある。", "「『内』外」", "\\＞記号ではない。", "　漢字《かんじ》の字。",
    "字下げのない行だ。", "「そう」", "「うん」", "「……じゃあ」", "「待って…ください」と叫んだ。", "　彼は―言った。東京―大阪の切符。", "　それは——だめ！いけない。", "「終わり。」", "　作品名「おやすみ。」を読んだ。",
    "です...ます。。", "　カタカナ A と b 漢字 1 だ。", "**強調**と`code`だ。", "　良い,悪い.晴れ☀です。", "電報が着いた。", "返事を…待つ。", "　長い道を、右に、左に、上に、下に、歩いていった。", "　夜が朝を、朝が夜を。", "　朝が夜を、夜が朝を。",
    "　そっと戸を開け、そっと歩き、そっと閉めた。", "　とても寒い。とても静かだ。かなり遠い。", "　胸が痛い。胸が痛い。心臓が鳴った。胸が痛い。", "　彼は走った。彼の影も走った。それは長い。", "　運命だった。永遠だった。かすかな音がした。",
    "　鳥のように飛び、鳥のように歌った。火のような朝だ。", "　それは夢ではなく、朝だった。それは嘘ではなく、本当だ。", "　沈黙が降りた。時間が止まった。記憶が揺れた。", "　状況を確認し、対応を検討し、報告した。", "　うれしい。悲しい。不安だ。寂しいと感じた。気がした。",
    "　なぜか、どこか、なんとなく懐かしい。かもしれない、だろうか。", "　伏線は回収した。読者は知っている。", "　目が覚めた。朝の光が差す。", "　彼は歩き出した。空を見上げた。", "　私は歩いた。私は走った。私は眠った。", "「『夜』」", "『夜の歌』", "　行きます。帰ります。待ちました。読んでいます。", "　東京。大阪。名古屋。京都。",
    "「知ってのとおり、彼は、海へ、山へ、町へ、行った」とささやいた。", "　" + "長い長い道がどこまでもどこまでも続いていて、" * 6 + "終わらない。", "とても短い。", "【立入禁止…】の札。", "　「字下げの台詞」", "  半角の字下げだ。", "　ため息をつき、肩をすくめ、目を伏せた。美しい人だ。見事な花だ。",
    "　「さくら」は三文字だ。「ひまわり」は五文字だ。", "　「がっこう」は三拍だ。「カード」は3拍だ。", "　「桜」は二字かもしれない。", "　四文字の言葉「あさがお」を書く。五文字の名前「たろう」を呼ぶ。", "　「つばめ」は四文字ではなく、三文字だ。", "　「うみ」は三文字だ。",
    "いや、二文字だ。", "　もし「そら」は三文字なら困る。", "　カレンダーは四文字だ。題名は五文字だ。", "　あと十文字ほど足りない。百五字で終わる。", "「『ほし』は三文字だよ」", "一句できた。\nふるいけや　かわずとびこむ　みずのおと", "俳句は難しい。\nなつの　よるは　ながい", "あさがおや　みずをください　とおりみち　",
    "　2024年2月29日（木）と2023年2月29日（水）。", "　２０２５年１２月２５日（火）に会う。2月30日は無い。2月29日は有る。",
)
#: A manuscript of each document: as many lines as its id tells, drawn by it.
_LENGTH, _DRAW = "(6 + doc_id * 7 % 61)", "((doc_id * 31 + k * k * 17 + k * 5 + doc_id * k * 3) % {n})"
MANUSCRIPT_SQL = f"""(SELECT doc_id, string_agg(m.raw, chr(10) ORDER BY k) AS text FROM (SELECT doc_id, unnest(range(0, {_LENGTH})) AS k FROM documents) d
JOIN {values(list(enumerate(LINES)), 'slot, raw')} ON m.slot = {_DRAW.format(n=len(LINES))} GROUP BY doc_id)""".replace("AS t(slot, raw)", "AS m(slot, raw)")


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a manuscript in place of the text of each document."""
    docs = documents(spark, sf_dir).select("doc_id")
    drawn = F.transform(F.expr(f"sequence(0, cast({_LENGTH} as int) - 1)"), lambda k: F.get(F.array(*(F.lit(x) for x in LINES)), F.expr("0") + ((F.col("doc_id") * 31 + k * k * 17 + k * 5 + F.col("doc_id") * k * 3) % len(LINES)).cast("int")))
    return docs.select("doc_id", F.array_join(drawn, "\n").alias("text"))
