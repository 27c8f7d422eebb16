"""Comments out of source texts, by each language's own rules.

A language's texts and comments are one pattern, tried at each place from left to right: what is a string stays whole, whatever
it holds, and a comment goes.  All loops are possessive, so a text is read once, without a stack, in the JVM.  Comments that nest are
unrolled to NESTED levels; deeper ones end with the first end mark.  What isn't closed ends with its line (strings of one line) or with the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NESTED = 12
BLANK_RUN = r"\n[ \t]*\n[ \t]*\n+"

_DOUBLE = r'"(?:[^"\\\n]++|\\[\s\S])*+"?'
_SINGLE = r"'(?:[^'\\\n]++|\\[\s\S])*+'?"
_CHARACTER = r"'(?:\\[^\n][^'\n]*+|[^'\\\n])'"
_TRIPLE = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:"""|\z)'
_TRIPLE_SINGLE = r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:'''|\z)"
_TRIPLE_RAW = r'"""[\s\S]*?(?:"""|\z)'
_BACKTICK = r"`(?:[^`\\]++|\\[\s\S])*+`?"
_BACKTICK_RAW = r"`[^`]*+`?"
_HASHED = r'\br(?<hashes>#*)"[\s\S]*?(?:"\k<hashes>|\z)'
_DELIMITED = r'\bR"(?<mark>[^()\s\\]{0,16})\([\s\S]*?(?:\)\k<mark>"|\z)'
_VERBATIM = r'@"(?:[^"]++|"")*+"?'
_LONG = r"\[(?<level>=*)\[[\s\S]*?(?:\]\k<level>\]|\z)"
_SLASHES, _HASH, _BLOCK = r"//[^\n]*+", r"#[^\n]*+", r"/\*[\s\S]*?(?:\*/|\z)"


def _nested(levels: int = NESTED) -> str:
    inner = r"/\*[\s\S]*?(?:\*/|\z)"
    for _ in range(levels - 1):
        inner = rf"/\*(?:[^*/]++|{inner}|\*(?!/)|/)*+(?:\*/|\z)"
    return inner


_C = ((_DOUBLE, _SINGLE), (_SLASHES, _BLOCK))
#: Strings and comments of each language; earlier ones are tried first.
SYNTAX = {
    "python": ((_TRIPLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE), (_HASH,)),
    "typescript": ((_DOUBLE, _SINGLE, _BACKTICK), (_SLASHES, _BLOCK)),
    "javascript": ((_DOUBLE, _SINGLE, _BACKTICK), (_SLASHES, _BLOCK)),
    "go": ((_DOUBLE, _CHARACTER, _BACKTICK_RAW), (_SLASHES, _BLOCK)),
    "rust": ((_HASHED, _DOUBLE, _CHARACTER), (_SLASHES, _nested())),
    "java": ((_TRIPLE, _DOUBLE, _SINGLE), (_SLASHES, _BLOCK)),
    "kotlin": ((_TRIPLE_RAW, _DOUBLE, _SINGLE), (_SLASHES, _nested())),
    "swift": ((_TRIPLE, _DOUBLE), (_SLASHES, _nested())),
    "c": _C,
    "cpp": ((_DELIMITED, _DOUBLE, _SINGLE), (_SLASHES, _BLOCK)),
    "csharp": ((_VERBATIM, _DOUBLE, _SINGLE), (_SLASHES, _BLOCK)),
    "ruby": ((_DOUBLE, _SINGLE), (r"(?m:^=begin\b[\s\S]*?(?:^=end\b[^\n]*+|\z))", _HASH)),
    "php": ((_DOUBLE, _SINGLE), (_SLASHES, _HASH, _BLOCK)),
    "lua": ((_DOUBLE, _SINGLE, _LONG), (r"--\[(?<rest>=*)\[[\s\S]*?(?:\]\k<rest>\]|\z)", r"--[^\n]*+")),
    "scala": ((_TRIPLE_RAW, _DOUBLE, _CHARACTER), (_SLASHES, _nested())),
    "dart": ((_TRIPLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE), (_SLASHES, _nested())),
    "html": ((), (r"<!--[\s\S]*?(?:-->|\z)",)),
}


def _stripped(text: Column, language: str) -> Column:
    strings, comments = SYNTAX[language]
    kept = f"(?<kept>{'|'.join(strings)})|" if strings else "(?<kept>(?!))|"
    # Lua's long comments begin as texts might: comments that hold such a beginning are tried first.
    pattern = f"{'|'.join(comments)}|{kept[:-1]}" if language == "lua" else f"{kept}{'|'.join(comments)}"
    return F.regexp_replace(text, pattern, "${kept}")


def without_comments(text: Column, language: Column) -> Column:
    """The text without its language's comments, runs of blank lines folded; languages that aren't known stay as they are."""
    out = None
    for name in SYNTAX:
        bare = F.regexp_replace(_stripped(text, name), BLANK_RUN, "\n\n")
        out = F.when(language == name, bare) if out is None else out.when(language == name, bare)
    return out.otherwise(text)
