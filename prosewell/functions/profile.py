"""Language profiles: what ends a sentence, what quotes speech, how sentence endings are classed, which words count for what."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Stands for an utterance where the narration around it is looked at.
MARK = "\ue002"


@dataclass(frozen=True)
class Profile:
    """Patterns are plain enough to mean the same in Java and in RE2.

    utterance: outermost quoted speech.  framed: quotes of another kind that are speech only as they stand (pattern, what stays).
    tag: how a sentence starts that only tells who spoke.  endings: (class, pattern) tried in turn on the last ``reach`` characters.
    lexicon: pattern of each density rule.  cues: patterns that tell what a quote or a block of lines is.
    """

    name: str
    sentence: str
    utterance: str
    tail: str
    comma: str
    endings: tuple[tuple[str, str], ...]
    tag: str
    ellipsis: str
    dash: str
    reach: int = 6
    framed: tuple[tuple[str, str], ...] = ()
    lexicon: dict[str, str] = field(default_factory=dict)
    heads: str = ""
    first: str = ""
    hesitant: str = ""
    vehicle: str = ""
    swap: str = ""
    cues: dict[str, str] = field(default_factory=dict)
    past: str = "past"
    polite: str = ""
    noun: str = "noun"
    quotes: str = ""
    spaced: bool = False  # lexicon, heads and vehicle are patterns over words with a blank on either side


def _words(*words: str) -> str:
    return f" (?:{'|'.join(words)}) "


LATIN = Profile(
    name="latin",
    sentence=r'[^.!?]+[.!?]*["”)]*',
    utterance=r'"[^"]*"',
    tail=r"[^a-zà-öø-ÿ]+$",
    comma=r",",
    endings=(("ing", r"ing$"), ("past", r"(?:ed|ado|ido|é)$"), ("noun", r"(?:tion|ción|tión|heit|keit|ung)$"), ("adverb", r"(?:ly|ment|mente|lich)$"), ("er", r"er$"), ("en", r"en$")),
    tag=rf"^\s*{MARK},?\s*(?:[a-zA-Z]+ )?(?:said|asked|replied|dit|sagte|dijo)",
    ellipsis=r"…|\.\.\.",
    dash=r"—|--",
    quotes='["“”]',
    lexicon={
        "S01": _words("like", "as", "comme", "wie", "como"),
        "S02": _words("exactly like", "just like", "tel", "gleich", "cual"),
        "K07": _words("felt", "saw", "heard", "seemed", "noticed", "sentit", "sah", "vio"),
        "K08": _words("love", "fear", "anger", "joy", "grief", "amour", "angst", "miedo"),
        "K09": _words("heart", "breath", "fist", "coeur", "herz", "aliento"),
        "K10": _words("softly", "gently", "quietly", "doucement", "leise", "suavemente"),
        "K11": _words("very", "so", "too", "très", "sehr", "muy", "con"),
        "K12": _words("somehow", "suddenly", "soudain", "plötzlich", "de repente"),
        "K13": _words("perhaps", "maybe", "might", "peut", "vielleicht", "quizás"),
        "K14": _words("he", "she", "it", "they", "elle", "il", "er", "sie", "sich", "se", "su"),
        "K15": _words("is", "was", "are", "be", "est", "sont", "ist", "sind", "es", "son"),
        "K16": _words("not", "pas", "nicht", "no"),
        "K18": _words("silence", "time", "memory", "temps", "zeit", "tiempo"),
        "K19": _words("nodded", "sighed", "shrugged", "smiled"),
        "K20": _words("as if", "as though", "comme si", "als ob", "como si"),
        "K21": _words("beautiful", "terrible", "wonderful", "belle", "schön", "hermoso"),
        "K22": _words("for", "by", "from", "pour", "par", "von", "für", "por", "para"),
        "K23": _words("lesson", "truth", "vérité", "wahrheit", "verdad"),
        "K24": _words("as you know", "of course", "bien sûr", "natürlich", "claro"),
        "K25": _words("whispered", "cried", "murmura", "flüsterte", "susurró"),
        "K27": _words("faint", "pale", "vague", "blass", "tenue"),
        "K28": _words("fate", "eternal", "destin", "schicksal", "destino"),
        "K29": _words("even", "only", "même", "nur", "solo"),
    },
    heads=r"^ (?:and|but|or|the|et|la|le|und|die|der|y|de) ",
    first=r"^ (?:i|je|ich|yo) ",
    hesitant=r'"(?:…|\.\.\.)',
    cues={"craft": _words("prompt", "draft", "word count", "chapter plan"), "meta": r"(?i)(?:license|rights reserved|http)", "opens": r"(?i)^(?:it was a dark|once upon|the |der |la )", "closes": r"(?i)(?:happily ever after|the end|\bfin\b)"},
    vehicle=r" (?:like|as|comme|wie|como)  ([a-zà-öø-ÿ]+) ",
    swap=r"^([^,]+),([^,]+)$",
    spaced=True,
)

_SAYS = "(?:言|話|答|叫|聞|返|笑|続け|つけ加え|くり返|ささや|つぶや)"
#: Plain forms that an explaining "nda" follows; after any other letter it is a past form.
_PLAIN = "[うくぐすつぬぶむるいたな]"

JAPANESE = Profile(
    name="ja",
    sentence=r"[^。！？!?]+[。！？!?]*[」』）)]*",
    utterance="「(?:[^「」]|「(?:[^「」]|「[^「」]*」)*」)*」",
    framed=((r"^[\s\x{3000}]*『[^『』]*』[\s\x{3000}]*$", MARK), (f"『[^『』]*』((?:と|って)[、]?{_SAYS})", MARK + "{1}")),
    tail=r"[。！？!?…―—─\s\x{3000}」』）)]+$",
    comma=r"、",
    endings=(
        ("masu", r"(?:(?:ま|で)(?:す|した|しょう)|ません)$"),
        ("da", rf"{_PLAIN}んだ$"),
        ("taigen", r"[あかこそ]なた$"),
        ("ta", r"(?:た|んだ|[泳脱継注防稼騒嗅]いだ)$"),
        ("da", r"(?:だ|である)$"),
        ("nai", r"(?:ない|なかろう|まい|ぬ)$"),
        ("i", r"い$"),
        ("ru", r"[うくぐすつふぶむる]$"),
        ("taigen", r"[一-龥々〆ァ-ヺー]$"),
    ),
    tag=rf"^[\s\x{{3000}}]*{MARK}[、]?[\s\x{{3000}}]*(?:と|って)",
    ellipsis="…",
    dash="[―—─]",
    past="ta",
    polite="masu",
    noun="taigen",
    quotes="[「」『』]",
    lexicon={
        "S01": "(?:のような|のように見え|みたいな|みたいに|のごとく)",
        "S02": "(?:まるで|あたかも|さながら)",
        "K07": "(?:と感じ|気がし|に見え|と思っ|聞こえて)",
        "K08": "(?:うれし|嬉し|悲し|寂し|不安|恐怖|怒り)",
        "K09": "(?:胸が痛|息をのん|心臓が|こぶしを|唇をかん)",
        "K10": "(?:そっと|じっと|静かに|ゆっくり|ふいに)",
        "K11": "(?:とても|かなり|ひどく|すごく|ずいぶん)",
        "K12": "(?:なぜか|どこか|なんとなく|知らぬ間に)",
        "K13": "(?:かもしれな|だろうか|らしかっ|ようだっ)",
        "K14": "(?:彼女|彼は|彼の|彼ら|それは)",
        "K15": "(?:のだった|のである|わけだ|のだ。)",
        "K16": "(?:ではなく|じゃなくて)",
        "K18": "(?:沈黙が|時間が|記憶が|孤独が|夜気が)",
        "K19": "(?:肩をすくめ|ため息を|首をかしげ|目を伏せ|うなずい)",
        "K20": "(?:とでもいうように|かのようだった|と言わんばかり)",
        "K21": "(?:美しい|見事な|すばらしい|残酷な)",
        "K22": "(?:実施|検討|状況|確認|対応|報告)",
        "K23": "(?:大切なのは|気づいたのだ|学んだ。|それが人生)",
        "K24": "(?:知ってのとおり|説明しよう|ご存じのとおり)",
        "K25": "(?:とささやい|とつぶやい|と叫ん|とほほえん)",
        "K27": "(?:かすかな|ほのかな|あわい)",
        "K28": "(?:運命|永遠|宿命|深淵)",
        "K29": "(?:をこそ、|だけを、|までも、)",
    },
    heads="^(?:しかし|そして|だが|それでも|すると)",
    first="^(?:私|僕|俺)(?:は|が)",
    hesitant="[「『]…",
    vehicle="([一-龥ァ-ヺー]+)のよう",
    swap="^([^、]+)、([^、。]+)。?$",
    cues={
        "says": rf"^(?:と|って)[、]?[\s\x{{3000}}]*{_SAYS}",
        "names": "(?:作品名|曲名|店名|標識|見出し|単語)[^。]{0,6}$",
        "brings": "(?:電報|回覧板|速達|年賀状|通達|書簡|便り)[^。、]{0,10}(?:着いた|回ってきた|渡された|広げた)[。：:]?$",
        "asks": "(?:しりとり|回文|早口言葉)",
        "craft": "(?:伏線|プロット|読者は|第一稿)",
        "meta": "(?:以下、本文|原稿は以上|続きを書き|承知しました)",
        "opens": "(?:目が覚め|朝の光|目覚まし)",
        "closes": "(?:歩き出した|空を見上げ|物語はまだ)",
    },
)
