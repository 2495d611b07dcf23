"""Regular expressions shared by the Spark operators and the SQL oracle.

Spark evaluates Java regular expressions; DuckDB evaluates RE2, which has no
look-around.  Every pattern here is written once, with explicit character
classes (``\\s`` and ``\\w`` spelled out) so that both engines read it the same
way.  Patterns that need look-around (the abbreviation guard of the sentence
start mask and the sentence boundary rule) get an RE2 rewrite next to them.
"""

from __future__ import annotations

import re
import string

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Abbreviations after which a period does not start a new sentence, in the
# reference's order.
ABBREVIATIONS = [
    "Dr", "Prof", "Gen", "Rep", "Sen", "St", "Hon",
    "Mr", "Mrs", "Ms", "Mme", "Messrs",
    "Sr", "Jr",
    "Ph.D", "M.D", "B.A", "M.A", "D.D.S",
    "U.S", "U.S.A", "e.g", "i.e", "etc", "et al", "ca", "O.K",
    "A.M", "P.M", "A.D", "B.C",
]
# A capitalised word after " ! ? . ; : (plus blanks), and the one character
# after it unless that is a quote; {abbr} is a look-behind for the list above.
SENTENCE_MASK = r'''("|!|\?|{abbr}\.|;|:)(\s*){open}[A-Z]\w+[^"']{close}'''
MASK_REPLACEMENT_JAVA = "$1$2"
# A possessive ending: after ', U+2019 or U+FF07.
POSSESSIVE_RE = "['\u2019\uff07][sS]$"
# Relevance parameters (BM25 defaults) and search defaults.
BM25_K1 = 1.2
BM25_B = 0.75
MAX_TOKEN_LENGTH = 255
DEFAULT_DELIMITER = ".txt:"
# End of fixed values.
# ---------------------------------------------------------------------------

WS = r"[ \t\n\x0B\f\r]"          # Java's ASCII \s
WORD = r"[a-zA-Z0-9_]"           # Java's ASCII \w
SENTINEL = "\u0001"              # stands for a token dropped for length
MARK = "\ue000"                 # private-use marker used to split strings


def _abbrev_alternation(order: list[str]) -> str:
    return "|".join(a.replace(".", r"\.") for a in order)


def _mask(period: str = r"\.", capture: bool = False) -> str:
    """The fixed mask with Java's ASCII classes spelled out (RE2 reads it the same way); with the removed part as
    group 3 to map token offsets back to the original content."""
    open_, close = ("(", ")") if capture else ("", "")
    return (SENTENCE_MASK.replace(r"\s", WS).replace(r"\w", WORD)
            .replace(r"{abbr}\.", period).replace("{open}", open_).replace("{close}", close))


# The look-behind stands after the period: before it, it would be tried at every character of the text.  Likewise
# one class in front settles the places where no form can begin.
_PERIOD = r"\.(?<!(?:" + _abbrev_alternation(ABBREVIATIONS) + r")\.)"
MASK_JAVA, MASK_JAVA_3 = ("(?=[\"!?.;:])" + _mask(_PERIOD, capture) for capture in (False, True))
MARK2 = "\ue001"

# RE2 form: protect abbreviation periods with MARK first (longest first so a
# longer abbreviation wins), mask without the look-behind, restore periods.
ABBREV_PROTECT_RE2 = "(" + _abbrev_alternation(sorted(ABBREVIATIONS, key=len, reverse=True)) + r")\."
MASK_RE2, MASK_3_RE2 = _mask(), _mask(capture=True)

# Token grammar: at each place the longest of its forms.  A form begins with a
# run of letters and digits; what it can be follows from the character behind
# that run, and where two forms go on past it the longer one stands first:
#
# * an e-mail passes its `@`, which no other form with these separators does;
# * dotted runs with a final period (acronyms, hosts before a period);
# * number chains (runs between _ - / . , of which every second one has a digit)
#   that hold a separator other than a period: these go on past a dotted run.
#   Digit runs come first, so the first run without a digit settles whether the
#   even or the odd ones need digits (NUMBERS, by where that separator stands);
# * dotted runs, which pure-period number chains are a part of;
# * words with & or @, words with apostrophes, and the run itself.
#
# Han, Kana and Bopomofo characters are no part of a run: each is a token.
CJ = r"\x{3040}-\x{312F}\x{31F0}-\x{31FF}\x{3300}-\x{337F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF65}-\x{FF9F}"
AN = r"[\p{L}\p{Nd}]+"           # words of a term list

# ASCII first, character by character: Java looks these up in one table, ranges are compared one after another.
_L = "[[" + string.ascii_letters + r"][\p{L}&&[^" + CJ + "]]]"
_A = "[[" + string.digits + string.ascii_letters + r"][\p{L}\p{Nd}&&[^" + CJ + "]]]"
# Possessive throughout: a run is always followed by a character outside its
# class, and what follows a loop can never begin inside its last turn, so giving
# anything back could not produce another match (and Java keeps no stack).
_RUN, _WORD = _A + "++", _L + "++"
_HAS_DIGIT = _L + r"*+\p{Nd}" + _A + "*+"


def _number_chains(run: str, digits: str) -> list[str]:
    sep, other = r"[_\-/.,]", r"[_\-/,]"
    dots = digits + r"(?:\." + digits + ")*+"
    need_digit = f"(?:{sep}{digits}{sep}{run})*+(?:{sep}{digits})?+"     # behind a run that need not have one
    free = f"(?:{sep}{run}{sep}{digits})*+(?:{sep}{run})?+"              # behind one that had to
    later = rf"(?:\.{digits}\.{run})*+(?:{other}{digits}{free}|\.{digits}{other}{run}{need_digit})"
    return [f"{dots}{other}{digits}(?:{sep}{digits})*+(?:{sep}{run}{need_digit})?+",
            f"{dots}{other}{run}{need_digit}",
            rf"{dots}\.{run}{later}",
            f"{run}{later}"]


# In front, what no form can begin with: most of it is ASCII.
TOKEN_RE_JAVA = r"(?=[a-zA-Z0-9\x{80}-\x{10FFFF}])(?:" + "|".join([
    _RUN + r"(?![._\-/,'&@])",                                         # most words: no other form can begin here
    _RUN + r"(?:[._\-]" + _RUN + ")*+@" + _RUN + r"(?:[.\-]" + _RUN + ")++",
    _RUN + r"(?:\." + _RUN + r")++\.(?!" + _A + ")",
    *_number_chains(_RUN, _HAS_DIGIT),
    _RUN + r"(?:\." + _RUN + ")++",
    _WORD + "[&@]" + _WORD,
    _WORD + "(?:'" + _WORD + ")++",
    _RUN,
    "[" + CJ + "]",
]) + ")"
ACRONYM_RE = r"^(?:\p{L}\.)+$"

# Sentence boundaries (English rules of the JDK sentence iterator, as a
# pattern whose match end is a boundary).  Uses look-ahead: Spark only.
_CL = r"[\"')\]}\x{201D}\x{2019}\x{BB}]"
_ST = r"[\"'(\[{\x{201C}\x{2018}\x{AB}\x{BF}<#*&\-]"
_SP = r"[ \t\n\x0B\f\r\x{A0}\x{2028}]"
SENTENCE_END_JAVA = (
    r"(?=[.!?\x{3002}])(?:\.*[!?\x{3002}][.!?\x{3002}]*" + _CL + "*" + _SP + "*"
    + r"|\.+" + _CL + r"*(?:\x{2029}|" + _SP + r"{2,}(?=[^ \t\n\x0B\f\r,;:])|"
    + _SP + r"(?=" + _ST + r"*[\p{Lu}\p{Lt}\p{Lo}])|" + _SP + r"(?=[#*<&\-(\[\x{BF}])))"
)

# RE2 has no look-ahead: what follows a boundary is captured (groups 3 and 5)
# and written back after the mark.  It can never begin another boundary, except
# a period or the like after two blanks, which a second pass handles.
SENTENCE_1_RE2 = (
    r"(\.*[!?\x{3002}][.!?\x{3002}]*" + _CL + "*" + _SP + r"*|\.+" + _CL + r"*\x{2029})"
    + r"|(\.+" + _CL + "*" + _SP + r"{2,})([^ \t\n\x0B\f\r,;:.!?\x{3002}])"
    + r"|(\.+" + _CL + "*" + _SP + ")(" + _ST + r"*[\p{Lu}\p{Lt}\p{Lo}]|[#*<&\-(\[\x{BF}])"
)
SENTENCE_2_RE2 = r"(\.+" + _CL + "*" + _SP + r"{2,})([.!?\x{3002}])"

# Character classes for excerpt scoring (Java names; RE2 equivalents below).
LOWER_FIRST_JAVA = r"^\p{javaLowerCase}"
UPPER_JAVA = r"\p{javaUpperCase}"
PUNCT = r"[\p{Pc}\p{Ps}\p{Pe}\p{Po}]"
DIGIT = r"\p{Nd}"


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL literal (single quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"
