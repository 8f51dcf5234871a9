"""The Porter stemmer for words, as a small helper of tasks, and as DuckDB SQL over a table of distinct words.

Published in 1980 (M. F. Porter, An algorithm for suffix stripping), with the two later endings -bli and -logi. A word of
fewer than three or more than 63 characters, and what is not ASCII letters, stays as it is.
"""

from __future__ import annotations

import re
from functools import lru_cache

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: What a stem must look like: one vowel-consonant change or more, exactly one, two or more, a vowel, consonant-vowel-consonant.
SOME, ONE, SEVERAL = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

# The endings of the second, third and fourth step and what replaces them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _ending(endings) -> str:
    return f"^(.+?)({'|'.join(endings)})$"


# compiled once: a text of rare words stems nearly every one of them anew
_SOME, _ONE, _SEVERAL, _VOWEL, _SHORT = map(re.compile, (SOME, ONE, SEVERAL, VOWEL, SHORT))
_WORD, _ES, _S = map(re.compile, ("[a-z]{3,63}", "^(.+?)(ss|i)es$", "^(.+?)([^s])s$"))
_EED, _ED, _E, _ION = map(re.compile, ("^(.+?)eed$", "^(.+?)(ed|ing)$", "(at|bl|iz)$", "^(.+?)(s|t)ion$"))
_SECOND, _THIRD, _FOURTH = (re.compile(_ending(x)) for x in (SECOND, THIRD, FOURTH))


def _replaced(word: str, ending: re.Pattern, endings: dict[str, str]) -> str:
    found = ending.match(word)
    return found[1] + endings[found[2]] if found and _SOME.match(found[1]) else word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    if not _WORD.fullmatch(word):
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if w[-1] == "s":
        w = _ES.sub(r"\1\2", w) if _ES.match(w) else _S.sub(r"\1\2", w)
    if found := _EED.match(w):
        w = w[:-1] if _SOME.match(found[1]) else w
    elif (found := _ED.match(w)) and _VOWEL.match(found[1]):
        w = found[1]
        if _E.search(w):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
            w = w[:-1]
        elif _SHORT.match(w):
            w += "e"
    if w[-1] == "y" and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _SECOND, SECOND), _THIRD, THIRD)
    if found := _FOURTH.match(w):
        w = found[1] if _SEVERAL.match(found[1]) else w
    elif (found := _ION.match(w)) and _SEVERAL.match(found[1] + found[2]):
        w = found[1] + found[2]
    if w[-1] == "e" and (_SEVERAL.match(w[:-1]) or (_ONE.match(w[:-1]) and not _SHORT.match(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _SEVERAL.match(w):
        w = w[:-1]
    return w.lower()


def stems_sql(words: str) -> str:
    """DuckDB: a table expression (word, stem) for a table of distinct words (word)."""

    def has(shape: str, of: str) -> str:
        return f"regexp_matches({of}, '{shape}')"

    def part(endings, group: int) -> str:
        return f"regexp_extract(w, '{_ending(endings)}', {group})"

    def replaced(endings: dict[str, str]) -> str:
        to = " ".join(f"when '{e}' then '{r}'" for e, r in endings.items())
        return f"case when {part(endings, 2)} <> '' and {has(SOME, part(endings, 1))} then {part(endings, 1)} || case {part(endings, 2)} {to} end else w end"

    cut = "w[:-2]"
    ed = "regexp_extract(w, '^(.+?)(ed|ing)$', 1)"
    ion = "regexp_extract(w, '^(.+?[st])ion$', 1)"
    steps = [
        "case when word[1] = 'y' then 'Y' || word[2:] else word end",
        r"case when regexp_matches(w, '^.+?(ss|i)es$') then w[:-3] else regexp_replace(w, '^(.+?)([^s])s$', '\1\2') end",
        f"case when regexp_matches(w, '^.+?eed$') then case when {has(SOME, 'w[:-4]')} then {cut} else w end "
        f"when {ed} <> '' and {has(VOWEL, ed)} then chr(1) || {ed} else w end",
        "case when w[1] <> chr(1) then w when regexp_matches(w, '(at|bl|iz)$') then w[2:] || 'e' "
        "when length(w) > 2 and w[-1] = w[-2] and not contains('aeiouylsz', w[-1]) then w[2:-2] "
        f"when {has(SHORT, 'w[2:]')} then w[2:] || 'e' else w[2:] end",
        f"case when w[-1] = 'y' and {has(VOWEL, cut)} then {cut} || 'i' else w end",
        replaced(SECOND),
        replaced(THIRD),
        f"case when {part(FOURTH, 2)} <> '' then case when {has(SEVERAL, part(FOURTH, 1))} then {part(FOURTH, 1)} else w end "
        f"when {ion} <> '' and {has(SEVERAL, ion)} then {ion} else w end",
        f"case when w[-1] = 'e' and ({has(SEVERAL, cut)} or ({has(ONE, cut)} and not {has(SHORT, cut)})) then {cut} else w end",
        f"case when w[-2:] = 'll' and {has(SEVERAL, 'w')} then {cut} else w end",
    ]
    plain = "regexp_matches(word, '^[a-z]{3,63}$')"
    out = f"(select word, {steps[0]} as w from {words} where {plain})"
    for step in steps[1:]:
        out = f"(select word, {step} as w from {out})"
    return f"(select word, lower(w) as stem from {out} union all select word, word from {words} where not {plain})"
