"""Problem 10: sentence boundaries across languages and scripts, all in SQL expressions.

Marks that end no sentence (in decimals, addresses, initials, abbreviations, ordinals) are masked by placeholders from the
private use area, one character for one; the masked text is cut where a script's own end marks or its white space end
a sentence. Masking keeps lengths, so restoring a sentence is reading its place in the original text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import once

# Placeholder, one character for each masked one, and the sign put where a sentence ends.
DOT, CUT = "\ue000", "\ue001"

# Abbreviations after which a sentence goes on, whatever follows. sentences() takes more of them.
TITLES = "Mr Mrs Ms Mx Dr Drs Prof Sgt Cpl Maj Cmdr Adm Capt Lt Col Gen Gov Sen Rep Rev Hon St Mt Ft Messrs Ing Mag Hr Hrn Fr Frl Sr Sra Srta Sres D Dña Dn Mme Mlle Mmes MM Me Mgr г-н г-жа гр им проф акад κ κα κος δρ Δρ Κ د أ م ا डॉ श्री प्रो पं ดร นาย".split()
LEADING = "P.S P.P.S N.B e.g i.e cf vs viz approx ca c z.B d.h u.a u.U bzw sog vgl bspw p.ej P.ej p.ex т.е т.к напр см π.χ δηλ βλ".split()
#: Abbreviations of two words with white space between.
SPACED = [x.split() for x in ("d h", "z B", "u a", "u U", "i e", "e g", "т е", "т к", "п п", "p ej", "p ex", "π χ", "P S", "N B")]
#: Before a number or a name that they announce; months before a day or a year.
BEFORE_NUMBER = "No Nos no nos est ext v Nr Nrn Art art Abs abs col Col cols fig Fig p pp pág págs pag S Seite Bd Kap Tel tel vol Vol Rev rev sec Sec ch Ch par para lot núm Núm n num стр с д кв оф корп ул пр пер п пп г гг рис табл αρ Αρ σελ άρθ".split()
MONTHS = "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mär Okt Dez janv févr avr juil août sept oct nov déc ene feb mar abr jun jul ago sep set dic fev mai out dez gen giu lug ott".split()
#: At the head of a sentence: initials right behind them are what it is about, and no end.
HEADS = "The A An This That These Those Our My His Her Its Their Your".split()
STREETS = "ул пр пер пл наб бул просп г д кв оф корп стр обл р пос дер".split()
MONTHS_RU = "янв февр фев мар апр июн июл авг сент сен окт нояб ноя дек".split()
#: May end a sentence; where a caseless script follows they don't.
COMPANY = "Inc Ltd Co Corp Bros Jr S.A S.p.A S.L S.r.l Pty L.L.C Plc".split()
GERMAN_ORDINALS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Mär Apr Jun Jul Aug Sep Sept Okt Nov Dez Quartal Jahrhundert Halbjahr Stock Etage Klasse Auflage Kapitel Mal Tag Platz Reihe".split()

LETTER = r"\p{L}\p{M}\p{Nd}"
#: Before a word; before a word that isn't the rest of one with dots.
WORD, FREE = rf"(?<![{LETTER}])", rf"(?<![{LETTER}.])"
CASELESS = r"[\p{IsArabic}\p{IsDevanagari}\p{IsThai}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHebrew}\p{IsHangul}]"
SPACE = "[\\s\u00a0\u2000-\u200a\u202f\u205f\u3000]"
#: At most one line break with blanks around it, or nothing.
GAP = "[ \\t\u00a0\u202f]*\\r?\\n?[ \\t\u00a0\u202f]*"
#: The same where a bound is needed.
NARROW = "[ \\t\u00a0\u202f]?\\r?\\n?[ \\t\u00a0\u202f]?"
CLOSING = r"[)\]}\"'”’»«›‹“‘」』】》〉）］]"
OPENING = r"[(\[{\"'“‘„«»‹›¿¡「『【《〈（［]"
#: Sentence terminators (Unicode's property) that white space follows, and of scripts that write on without any.
END = r"[.!?…؟۔।॥։܀܁܂߹᠃᠉᙮᱾᱿꘎꘏꛳꛷꣎꣏꤯꩝꩞꩟꫰꫱꯫‼‽⁇⁈⁉⸮⸼]"
CLOSE_END = "[။။៕។።፧፨]"
#: Georgian letters are small ones to Unicode, though its sentences open with them.
SMALL = r"(?![\p{Ll}&&[^\p{IsGeorgian}]])"


def _any(words: list[str]) -> str:
    """The words as alternatives, with a dot or its placeholder where they have one."""
    return "|".join(re.escape(w).replace("\\.", f"[.{DOT}]") for w in sorted(words, key=lambda w: (-len(w), w)))


def _either(words: list[str]) -> list[str]:
    """The words, and these with a capital first letter, as at the head of a sentence."""
    return [*dict.fromkeys(x for w in words for x in (w, w[:1].upper() + w[1:]))]


def masks(more: tuple[str, ...] = ()) -> str:
    """A pattern of single dots that end nothing: a dot, then what is before and behind it, looked at there only. more are
    further abbreviations, without their last dot."""
    after = lambda before, words, ahead: f"(?<={before}(?:{_any(words)})[.])(?={ahead})"
    each = [
        # decimals, times and versions; the name in an address, of 64 characters at most by the rules of mail
        r"(?<=\p{Nd}[.])(?=\p{Nd})",
        r"(?<=[A-Za-z0-9][.])(?=[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9])",
        # abbreviations; of two letters with white space between, both dots
        rf"(?<={WORD}(?:{'|'.join(sorted({x[0] for x in SPACED}))})[.])(?={GAP}(?:{'|'.join(sorted({x[1] for x in SPACED}))})[.])",
        rf"(?<={WORD}(?:{'|'.join(f'{x}[.{DOT}]{NARROW}{y}' for x, y in SPACED)})[.])",
        after(WORD, TITLES + _either([*LEADING, *more]) + MONTHS_RU, SPACE),
        after(WORD, BEFORE_NUMBER, rf"{GAP}(?:[(#№]?\p{{Nd}}|[A-Z][.{DOT}]?\p{{Nd}}|[IVXLC]+\b)"),
        after(WORD, MONTHS, rf"{GAP}\p{{Nd}}"),
        after(WORD, STREETS, rf"{SPACE}+[\p{{IsCyrillic}}\p{{Nd}}]"),
        rf"(?<=\p{{Ll}}str[.])(?={GAP}\p{{Nd}})",
        # initials, one after the other; the last ones of a sentence's first words
        rf"(?<={FREE}\p{{Lu}}[.])(?={GAP}\p{{Lu}})",
        rf"(?<={WORD}(?:{'|'.join(HEADS)}){SPACE}(?:\p{{Lu}}[.{DOT}]){{1,4}}(?<=[.]))(?={SPACE})",
        # ordinals
        rf"(?<=(?<![{LETTER}.,{DOT}])\p{{Nd}}{{1,2}}[.])(?={GAP}(?:{_any(GERMAN_ORDINALS)})\b)",
        # a company's name before a caseless script
        after(WORD, COMPANY, rf"{SPACE}*{CASELESS}"),
        # a time of day at the head of a sentence
        rf"(?<=\bAt{SPACE}\p{{Nd}}{{1,2}}(?:[:.{DOT}]\p{{Nd}}\p{{Nd}})?{SPACE}[ap][.{DOT}]m[.])(?={SPACE})",
    ]
    return f"[.](?:{'|'.join(each)})"


#: Of a link the first mark that it goes on after, then from each such mark on the next one.
LINK = rf"((?:https?://|www(?=[.])|\G(?<=[.?!]))[^\s.?!{DOT}]*)[.?!](?=[A-Za-z0-9/_-])"


def cuts() -> str:
    """A pattern of what a sentence ends with: terminators by script, with the closing marks that belong to them."""
    goes_on = rf"(?={SPACE}+(?:{OPENING}{SPACE}?)*+{SMALL}[^{SPACE[1:-1]}—–,;:(\[{{&-]|{SPACE}+[(\[]{SPACE}?[\p{{Lu}}\p{{Lo}}])"
    each = [
        # a blank line
        "\\n[ \\t\\r 　]*\\n",
        # full-width marks end at once; with a closing mark only before white space or an opening mark, else the sentence goes on
        r"[。！？｡][。！？｡!?]*(?![”」』）)’》】。！？｡!?，、,])",
        r"[。！？｡]+[”」』）)’》】]+(?=\s|[“「『（]|\z)",
        # an end mark, white space, and no small letter, dash or comma that goes on
        rf"{END}+(?:{CLOSING}(?![{LETTER}]))*(?:[   ]»)?{goes_on}".replace("\\u00a0\\u202f", "  "),
        # the Greek question mark
        rf"[;;](?<=\p{{IsGreek}}{CLOSING}?[;;]){CLOSING}?(?={SPACE}*(?:{OPENING}{SPACE}?)*+[\p{{Lu}}\p{{Nd}}])".replace("\\u037e", ";"),
        # no white space after the mark
        r"[.!?…]+(?<=[\p{Ll}\p{Nd}%)»”][.!?…]{1,3})(?=[¿¡«„“]?\p{Lu})",
        r"[.!?؟।]+(?<=[\p{IsArabic}\p{IsDevanagari}][.!?؟।]{1,3})(?=[\p{IsArabic}\p{IsDevanagari}])",
        rf"{CLOSE_END}+(?:{CLOSING}(?![{LETTER}]))*",
    ]
    return f"(?=[\\n;;。！？｡{END[1:-1]}{CLOSE_END[1:-1]}])(?:{'|'.join(each)})"


def _rest(text: Column, after: Column) -> Column:
    """What follows the first `after` characters."""
    return F.when(F.length(text) > after, F.substring(text, after + 1, F.length(text) - after)).otherwise(F.lit(""))


def own_prose(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, prose): the own prose of each message, after a line break put in front, and where in the text that would stand.

    Quoted lines and those right above them are blanked, so places stay. Nothing where the body or the first plain part is
    missing or in base64, or the body is HTML.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull())
    opens = F.col("_t").rlike(r"\A(?:From [^\n]*(?:\n|\z)|[A-Za-z][A-Za-z0-9-]*:(?!//))")
    head = F.when(F.col("_t").rlike(r"\n\r?\n"), F.regexp_extract("_t", r"(?s)\A.*?\n\r?\n", 0)).otherwise(F.col("_t"))
    rows = once(rows, "_h", F.when(opens, head).otherwise(F.lit("")))
    rows = once(once(rows, "_multi", F.col("_h").rlike(r"(?i)(?:\A|\n)content-type:\s*multipart/")), "_b", _rest(F.col("_t"), F.length("_h")))
    # from the body's start to the end of the headers of the first plain part
    first = r"(?is)\A.*?(?<![^\n])--[^\s][^\n]*\n(?:(?!\r?\n|content-type:)[^\n]*\n)*+content-type:\s*text/plain[^\n]*\n(?:(?!\r?\n)[^\n]*\n)*+\r?\n"
    rows = once(rows, "_lead", F.when(F.col("_multi"), F.regexp_extract("_b", first, 0)).otherwise(F.lit("")))
    own = F.regexp_extract("_lead", r"(?s).*(?<![^\n])(--[^\s][^\n]*\n.*)\z", 1)
    rows = once(rows, "_ph", F.when(F.col("_multi"), own).otherwise(F.col("_h")))
    html = ~F.col("_multi") & F.col("_h").rlike(r"(?i)(?:\A|\n)content-type:\s*text/html")
    none = html | (F.col("_multi") & (F.col("_lead") == "")) | F.col("_ph").rlike(r"(?i)(?:\A|\n)content-transfer-encoding:\s*\"?base64")
    mark = F.concat(F.lit("\n"), F.regexp_extract("_ph", r"\A(--[^\r\n]*?)[ \t]*\r?\n", 1))
    body = F.concat(F.lit("\n"), _rest(F.col("_b"), F.length("_lead")))
    part = F.when(F.col("_multi"), F.split_part(body, mark, F.lit(1))).otherwise(body)
    cut = F.regexp_replace(part, r"(?s)\n(?:--[ ]?\r?(?:\n|\z)|_{5}|={5}|-{5}).*\z", "")
    rows = once(rows, "_l", F.split(F.when(none, F.lit("")).otherwise(cut), "\n"))
    quoted = lambda i: F.coalesce(F.get("_l", i).startswith(">"), F.lit(False))
    kept = F.transform("_l", lambda x, i: F.when(quoted(i) | quoted(i + 1), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    return rows.select("_id", (F.length("_h") + F.length("_lead") - 1).alias("_at"), F.array_join(kept, "\n").alias("prose"))


def pieces(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """rows with pieces, the prose in parts of which each holds one sentence and white space, or white space only."""
    text = F.translate("prose", DOT + CUT, "\ufffd\ufffd")
    text = F.when(text.contains("://") | text.contains("www."), F.regexp_replace(text, LINK, f"$1{DOT}")).otherwise(text)
    cut = F.regexp_replace(F.regexp_replace(text, masks(more), DOT), cuts(), f"$0{CUT}")
    rows = once(rows, "_o", F.split(cut, CUT))
    # in Thai white space ends a sentence: all of it where most letters are Thai, elsewhere that between Thai letters
    of = lambda p, kept: F.length(F.regexp_replace(p, f"[^{kept}]+", ""))
    mostly = lambda p: 2 * of(p, r"\p{IsThai}") > of(p, r"\p{L}\p{M}")
    between = r"(?<=\p{IsThai})" + SPACE + r"+(?=\p{IsThai})"
    thai = lambda p: F.split(F.when(mostly(p), F.regexp_replace(p, f"{SPACE}+", f"$0{CUT}")).otherwise(F.regexp_replace(p, between, f"$0{CUT}")), CUT)
    return once(rows, "pieces", F.when(F.col("prose").rlike(r"\p{IsThai}"), F.flatten(F.transform("_o", thai))).otherwise(F.col("_o")))


def starts(lengths: Column, block: int = 256) -> Column:
    """The sum of the lengths before each element, in blocks, so that work isn't quadratic in the array's size."""
    last = F.floor((F.size(lengths) - 1) / block).cast("int")
    blocks = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * block + 1, block))).otherwise(F.array())

    def running(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    heads = running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)))
    return F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(running(b), 1, F.size(b)), lambda x: x + F.get(heads, i))))


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, start_at, end_at): places of the sentences of each text's own prose, in code points, end exclusive.

    Null and empty texts and messages without own prose give no row; of equal texts each gives its own. more are abbreviations
    beyond those known here, such as a language's or a trade's own.
    """
    rows = pieces(once(own_prose(df, id_col, text_col), "prose", F.col("prose")).where(F.col("prose").rlike(r"\S")), more)
    rows = once(rows, "_n", F.transform("pieces", lambda p: F.length(p)))
    rows = once(rows.select("_id", "_at", "pieces", "_n"), "_s", starts(F.col("_n")))
    each = rows.select("_id", "_at", F.explode(F.arrays_zip("pieces", "_s")).alias("e")).select("_id", (F.col("_at") + F.col("e._s")).alias("s"), F.col("e.pieces").alias("p"))
    each = each.withColumn("l", F.regexp_replace("p", rf"\A{SPACE}+", "")).where("l != ''")
    start = F.col("s") + F.length("p") - F.length("l")
    stop = start + F.length(F.regexp_replace("l", rf"{SPACE}+\z", ""))
    return each.select(F.col("_id").alias(id_col), start.cast("long").alias("start_at"), stop.cast("long").alias("end_at"))
