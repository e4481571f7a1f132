"""Names in the simplified forms in which they are compared, as Column expressions (JVM side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks deleted inside a word; marks that separate words: stops, quotes, brackets, signs, lines.
INNER_MARKS = "'’´."
SEPARATORS = ".,:;!" + "'\"`´‘’“”" + "()" + "@#$%^&*/" + "_-—"
# Words of company forms.
COMPANY_WORDS = ("co", "company", "corp", "corporation", "group", "holding", "holdings", "inc", "incorporated", "ltd", "plc", "sa", "se")
#: Forms of initials, which may be written with spaces between them.
COMPANY_INITIALS = ("lc", "lp", "llc", "llp")


def spacings(initials: str) -> list[str]:
    """All ways to write initials with or without a space between each two."""
    out = [initials[:1]]
    for letter in initials[1:]:
        out = [w + gap + letter for w in out for gap in ("", " ")]
    return out


COMPANY_FORMS = (*COMPANY_WORDS, *(w for form in COMPANY_INITIALS for w in spacings(form)))


def one_of(marks: str) -> str:
    """The inside of a character class."""
    return "".join("\\" + m if m in "\\]^-" else m for m in marks)


def simplify(string: Column | str) -> Column:
    """Lower case; " & " spelled out; apostrophes and dots between two characters that aren't white space deleted; runs of white
    space and punctuation one space; no space at the edges. Signs like + = ? < > and brackets stay. Null stays null."""
    s = F.lower(F.col(string) if isinstance(string, str) else string)
    s = F.replace(s, F.lit(" & "), F.lit(" and "))
    s = F.regexp_replace(s, rf"(?U)(?<=\S)[{one_of(INNER_MARKS)}](?=\S)", "")
    return F.trim(F.regexp_replace(s, rf"(?U)[\s{one_of(SEPARATORS)}]+", " "))


def simplify_corp(string: Column | str) -> Column:
    """simplify, then without one leading "the " and without the company forms at the end, each of which follows a space."""
    s = F.regexp_replace(simplify(string), r"\Athe ", "")
    return F.regexp_replace(s, rf"(?: (?:{'|'.join(COMPANY_FORMS)}))+\z", "")


def suffix_key(string: Column | str, n: int = 3) -> Column:
    """The last n characters."""
    return F.right(F.col(string) if isinstance(string, str) else string, F.lit(n))


def ngrams(string: Column | str, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter string is its own only one. Null stays null."""
    s = F.col(string) if isinstance(string, str) else string
    places = F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1)))
    return F.when(s.isNotNull(), F.array_distinct(F.transform(places, lambda i: F.substring(s, i, F.lit(n)))))


def words(string: Column | str) -> Column:
    """Distinct words of the simplified string; no words for an empty one."""
    return F.array_distinct(F.filter(F.split(simplify(string), " "), lambda w: w != ""))


def augmented(string: Column | str, prompt: str = "", separator: str = "</s>", upper: bool = True) -> Column:
    """What an encoder reads: the prompt, the string and, after a separator, the string in capitals."""
    s = F.col(string) if isinstance(string, str) else string
    return F.concat(F.lit(prompt), s, F.lit(separator), F.upper(s)) if upper else F.concat(F.lit(prompt), s)
