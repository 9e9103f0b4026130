"""English analysis for full-text search: a stop list of our own and the Porter stemmer (Porter 1980)."""

from __future__ import annotations

STOP = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by
    can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if
    in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same
    she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very
    was we were what when where which while who whom why will with you your yours yourself yourselves""".split()
)
_VOWELS = "aeiou"
_TWO = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_THREE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_FOUR = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_LONGEST_FIRST = tuple(sorted(table, key=lambda x: -len(x[0])) for table in (_TWO, _THREE))
_FOUR_AND_ION = sorted((*_FOUR, "ion"), key=lambda x: -len(x))


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def stem(w: str) -> str:
    """The stem of a word in lower case; words that aren't plain a to z stay as they are."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                root = w[: -len(end)]
                if _has_vowel(root):
                    w = root
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in _LONGEST_FIRST:
        for end, new in table:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in _FOUR_AND_ION:
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w
