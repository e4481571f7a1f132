"""Problem 2: visually identical text with different characters, by confusables skeletons.

A skeleton is made as Unicode's security mechanisms describe it: decompose, put each character's prototype from a table of
look-alikes in its place, decompose again. Strings with equal skeletons look the same. The table is Unicode's own, as the ICU
library beside Spark holds it, or any other. The ordinary form of a string is spelled back from the same prototypes: each word
is written in the letters of one script, the one its unmistakable letters belong to.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Prototype letter, then the letters of other alphabets in use that are taken for it, by which words are spelled.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ",
    "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ",
    "W": "ԜᎳ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
    "a": "аαɑ", "b": "Ьᖯ", "c": "сϲ", "d": "ԁᏧ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ոռ",
    "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "υսʋ", "v": "νѵ", "w": "ԝաѡ", "x": "хχ", "y": "уγү",
}
PROTOTYPE = {other: proto for proto, others in LOOKALIKES.items() for other in others}
#: Letters of no modern national alphabet, or of few: they pass for others, but no ordinary word is spelled with them.
RARE = set("ԁԝԛһӏѴѵԌԜԚӀᎳϲϳͿϹϜҮү")
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
#: Code points that show nothing though they are not of category Cf.
UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x180F), *range(0xE0100, 0xE01F0)}
#: Blocks of letters, digits and signs of another width or style, ligatures: their compatibility form is the ordinary one.
STYLED = ((0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0x1D400, 0x1D7FF), (0x2460, 0x24FF))
#: Scripts in wide use, by the first word of their letters' names: their own letters stay, whatever they look like.
LIVING = set("LATIN CYRILLIC GREEK ARMENIAN CHEROKEE GEORGIAN HEBREW ARABIC DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR KHMER ETHIOPIC HANGUL HIRAGANA KATAKANA BOPOMOFO CJK IDEOGRAPHIC HALFWIDTH FULLWIDTH".split())
SMALL_CAPITAL = re.compile("LATIN LETTER SMALL CAPITAL ([A-Z])")
WORD = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")


@lru_cache(maxsize=65536)
def script(ch: str) -> str | None:
    name = unicodedata.name(ch, "").partition(" ")[0]
    return name if name in SCRIPTS else None


def _own() -> dict[str, dict[str, str]]:
    """Of each script, by prototype, the letter it writes: rule-made from the table."""
    own: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for proto, others in LOOKALIKES.items():
        own["LATIN"][proto] = proto
        for ch in others:
            if (s := script(ch)) and s != "LATIN" and ch not in RARE:
                own[s].setdefault(proto, ch)
    return own


OWN = _own()


@lru_cache(maxsize=65536)
def _basic(ch: str) -> str:
    """A character without its style: nothing for an invisible one, a space for any space."""
    kind, code = unicodedata.category(ch), ord(ch)
    if kind == "Zs":
        return " "
    if kind == "Cf" or code in UNSEEN:
        return ""
    if any(a <= code <= b for a, b in STYLED):
        return unicodedata.normalize("NFKC", ch)
    if kind in ("Lu", "Ll", "Nl") and code > 0x2000:  # letter-like signs and number forms
        plain_letters = unicodedata.normalize("NFKC", ch)
        if plain_letters.isascii() and plain_letters.isalpha():
            return plain_letters
    if kind == "Ll" and (m := SMALL_CAPITAL.fullmatch(unicodedata.name(ch, ""))):
        return m[1].lower()
    return ch


class _Basics(dict):
    """What _basic makes of each code point, filled as they come: str.translate asks it once for each."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _basic(chr(code))
        return out


BASICS = _Basics()
#: Letters that need a look at the script of their word: all of the scripts but Latin, and look-alikes.
TELLING = re.compile("[" + "".join(re.escape(ch) for ch in sorted({*PROTOTYPE, *(chr(c) for r in ((0x370, 0x1400), (0x1C80, 0x2000), (0xA640, 0xAC00)) for c in range(*r) if script(chr(c)) not in (None, "LATIN"))})) + "]")
_tables: dict[int, dict[str, str]] = {}


def confusables(spark: SparkSession) -> dict[str, str]:
    """Unicode's table of look-alikes: characters and their prototypes, from ICU in the driver's JVM; empty where that lacks it."""
    if id(spark._jvm) not in _tables:
        chars = [chr(c) for c in range(0x21, 0x20000) if unicodedata.category(chr(c))[0] in "LNPSM"]
        table: dict[str, str] = {}
        try:
            checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
            for i in range(0, len(chars), 4096):
                part = chars[i : i + 4096]
                protos = checker.getSkeleton("\n".join(part)).split("\n")
                if len(protos) == len(part):
                    table |= {ch: p for ch, p in zip(part, protos, strict=True) if p != unicodedata.normalize("NFD", ch)}
        except TypeError:  # a class that isn't there is a package to the gateway, which can't be called
            table = {}
        _tables[id(spark._jvm)] = table
    return _tables[id(spark._jvm)]


def foreign(table: dict[str, str]) -> dict[str, str]:
    """Of the table the letters of scripts that few write today and that look like one Latin letter."""
    return {ch: p for ch, p in table.items() if len(p) == 1 and p.isascii() and p.isalpha() and unicodedata.category(ch)[0] == "L" and unicodedata.name(ch, "CJK").partition(" ")[0] not in LIVING}


def skeleton(text: str, table: dict[str, str] | None = None) -> str:
    """Decomposed, each character replaced by its prototype, decomposed again."""
    table = table or {}
    proto = lambda ch: table.get(PROTOTYPE.get(ch, ch), PROTOTYPE.get(ch, ch)) if ch not in table else table[ch]
    basic = unicodedata.normalize("NFD", text).translate(BASICS)
    return unicodedata.normalize("NFD", "".join(map(proto, unicodedata.normalize("NFD", basic))))


@lru_cache(maxsize=65536)
def _writes(ch: str) -> frozenset[str]:
    """The scripts that have this letter or one that looks like it."""
    own = script(ch)
    if own is None:
        return frozenset()
    proto = PROTOTYPE.get(ch, ch)
    return frozenset({own} | {s for s in SCRIPTS if proto in OWN[s]})


def _sure(word: str, among: set[str]) -> dict[str, int]:
    """How many letters of the word can belong to one of these scripts only."""
    sure: dict[str, int] = {}
    for ch in word:
        if len(may := _writes(ch) & among) == 1:
            (s,) = may
            sure[s] = sure.get(s, 0) + 1
    return sure


def _most(counts: dict[str, int]) -> str | None:
    return min(counts, key=lambda s: (-counts[s], SCRIPTS.index(s))) if counts else None


def plain(text: str, strange: dict[str, str] | None = None) -> str:
    """The ordinary form: normal width, composed accents, ordinary spaces, nothing invisible, each word in one script.

    strange are letters of rare scripts with their prototypes (see foreign): among other letters they stand for these.

    A word of which every letter has look-alikes is in the script of the name: that of most of its unmistakable letters, or of
    most letters where there are none. A word all in one script that the name surely uses elsewhere stays as it is.
    """
    if text.isascii():
        return text
    basic = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(BASICS))
    if strange and not strange.keys().isdisjoint(basic):
        mixed = lambda word: any(script(ch) for ch in word)
        basic = WORD.sub(lambda m: "".join(strange.get(ch, ch) for ch in m[0]) if mixed(m[0]) else m[0], basic)
    if TELLING.search(basic):
        words = WORD.findall(basic)
        every: dict[str, int] = {}
        for ch in basic:
            if s := script(ch):
                every[s] = every.get(s, 0) + 1
        among = {*every, "LATIN"} if len(every) > 1 else set(every)
        surely: dict[str, int] = {}
        for w in words:
            for s, n in _sure(w, among).items():
                surely[s] = surely.get(s, 0) + n
        # look-alikes are put in for Latin letters as a rule, so where nothing is sure a mixture of scripts is Latin
        main = _most(surely) or ("LATIN" if len(every) > 1 else _most(every))

        def spell(m: re.Match) -> str:
            word = m[0]
            here = {s for ch in word if (s := script(ch))}
            into = _most(_sure(word, among))
            if into is None:
                into = next(iter(here)) if len(here) == 1 and here <= surely.keys() else main
            if into is None or (here <= {into} and not any(ch in PROTOTYPE and script(ch) == "LATIN" for ch in word)):
                return word
            out = []
            for ch in word:
                proto = PROTOTYPE.get(ch, ch)
                own = script(ch) in (into, None) and not (script(ch) == "LATIN" and ch in PROTOTYPE)
                out.append(ch if own else OWN[into].get(proto, ch))
            return "".join(out)

        basic = WORD.sub(spell, basic)
    return unicodedata.normalize("NFC", basic)


def _over(fn):
    """fn over the strings of an Arrow column that have a character beyond ASCII; the rest of the column isn't touched."""

    def run(column: pa.Array) -> pa.Array:
        odd = pc.fill_null(pc.invert(pc.string_is_ascii(column)), False)
        if not pc.any(odd, min_count=0).as_py():
            return column
        return pc.replace_with_mask(column, odd, pa.array([fn(s) for s in column.filter(odd).to_pylist()], column.type))

    return run


def _session_table(table: dict[str, str] | None) -> dict[str, str]:
    if table is not None:
        return table
    spark = SparkSession.getActiveSession()
    return confusables(spark) if spark else {}


def plain_form(string: Column | str, table: dict[str, str] | None = None) -> Column:
    """The ordinary form of a string column; null stays null, ASCII doesn't leave the JVM. table is Unicode's by default."""
    s = F.col(string) if isinstance(string, str) else string
    spelled = F.arrow_udf(_over(partial(plain, strange=foreign(_session_table(table)))), "string")
    return F.coalesce(spelled(F.when(F.octet_length(s) > F.char_length(s), s)), s)


def skeleton_form(string: Column | str, table: dict[str, str] | None = None) -> Column:
    of = partial(skeleton, table=_session_table(table))
    return F.arrow_udf(lambda column: pa.array([None if s is None else of(s) for s in column.to_pylist()], pa.string()), "string")(string)


def ordinary_forms(df: DataFrame, id_col: str = "row_id", string_col: str = "string") -> DataFrame:
    """(id, plain) of each row whose string is not in its ordinary form. Nulls and empty strings are ordinary.

    Only strings with a character beyond ASCII leave the JVM.
    """
    odd = df.select(F.col(id_col).alias(id_col), F.col(string_col).alias("_s")).where(F.col("_s").rlike(r"[^\x00-\x7F]"))
    spelled = odd.withColumn("plain", F.explode(F.array(plain_form("_s"))))  # once, for the filter as well
    return spelled.where(F.col("plain") != F.col("_s")).select(id_col, "plain")


def lookalike_groups(df: DataFrame, string_col: str = "string") -> DataFrame:
    """(skeleton, first, strings, rows): strings that look the same, where two or more different ones do.

    first is the first by code point, strings their number. Rows of equal strings are counted before anything is shuffled twice.
    """
    each = df.where(F.col(string_col).isNotNull()).groupBy(F.col(string_col).alias("_s")).count()
    return (
        each.withColumn("skeleton", skeleton_form("_s"))
        .groupBy("skeleton")
        .agg(F.min("_s").alias("first"), F.count("*").alias("strings"), F.sum("count").alias("rows"))
        .where("strings > 1")
    )
