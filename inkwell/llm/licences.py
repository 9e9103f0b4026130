"""Licence scans by sentence rules: sentences become identifiers, and identifier sequences licences.

A text is cut after . ! ? ; or : before white space, and at line ends; a piece is normalised to lower-case letters and
digits with single spaces, so comment marks and indents go. First, known sentences become identifiers: SENTENCES gives each identifier its wordings, with
optional and alternative words. Then the rules whose identifiers are all there are tried, in order: a rule is a licence and
the identifiers that must follow one another, some of them optional, some with other words between (a holder's name). A match begins
and ends where pieces do, whatever cuts lie between: a notice may be wrapped at any column and stand in a comment. Between two of a rule's
sentences a list number or letter may stand; other words interrupt. Licence expressions (SPDX-License-Identifier: MIT OR Apache-2.0) report each of their licences.
Where one match lies within a longer one, the longer alone is reported. Blank lines cut like other line ends.

All of it is one projection of built-in functions over each row: nothing is shuffled, so no key can be hot.

Defined cases: null, empty and blank texts have no match, and rows without a match none in the result; repeated rows
each report theirs; a null id is kept; blank sentences are passed over; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHARED = (("licensed under", "released under", "distributed under", "available under", "provided under", "published under", "made available under", "dual licensed under", "covered by", "subject to", "governed by"), ("license", "licence"), ("or later", "or any later version", "or at your option any later version", "or newer", "or above"))
_COMMON = {"version", "public", "above", "software", "what"}
_SUBJECT = "[this work is|this software is|this project is|this code is|this program is|this library is|this package is|this file is|this document is|it is|the code is|the software is|code is|all code is|everything here is]"
_UNDER = f"{_SUBJECT} {{{'|'.join(_SHARED[0])}}} [the terms of|the terms and conditions of|terms of] [the|a|an]"
_CC_KINDS = {
    "by": ("attribution",),
    "by sa": ("attribution share alike", "attribution sharealike"),
    "by nd": ("attribution no derivatives", "attribution noderivatives", "attribution noderivs", "attribution no derivs"),
    "by nc": ("attribution non commercial", "attribution noncommercial"),
    "by nc sa": ("attribution non commercial share alike", "attribution noncommercial sharealike", "attribution noncommercial share alike"),
    "by nc nd": ("attribution non commercial no derivatives", "attribution noncommercial noderivatives", "attribution noncommercial noderivs", "attribution noncommercial no derivs"),
}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _gnu(name: str, short: str, version: str) -> tuple[str, ...]:
    """Wordings of a GNU licence's name with a version."""
    v = version.removesuffix(" 0")
    return (f"{_UNDER} [gnu] {name} [license] {{version {v}|v {v}|v{v}|version {version}|v{version}}} [only|of the license|as published by the free software foundation]", f"{_UNDER} [gnu] {{{short} {v}|{short}{v}|{short}v{v}|{short} v{v}|{short} version {v}|{short} {version}}} [only|license]")


def _gnu_later(name: str, short: str, version: str) -> tuple[str, ...]:
    later = f"{{{'|'.join(_SHARED[2])}}}"
    v = version.removesuffix(" 0")
    return (f"{_UNDER} [gnu] {name} [license] {{version {v}|v {v}|v{v}|version {version}}} [of the license] {later}", f"{_UNDER} [gnu] {{{short} {v}|{short}{v}|{short}v{v}|{short} v{v}|{short} version {v}|{short} {version}}} {later}")


def _gnu_notice(name: str, version: str) -> str:
    return f"[you can redistribute it and or modify] it under the terms of the gnu {name} [license] as published by the free software foundation either version {version} of the license or at your option any later version"


#: identifier -> wordings in lower case; [a|b] stands for words that may be missing, {a|b} for a choice, *n for up to n other words
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit_name": (f"{_UNDER} mit [x11|expat] [open source] {{license|licence}}",),
    "mit_title": ("[the] mit {license|licence} [mit]", "[the] expat {license|licence}"),
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    "notice_kept": ("the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software",),
    "as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {noninfringement|non infringement}",),
    "mit_liability": ("in no event shall the {authors or copyright holders|author or copyright holder|copyright holders} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "copyright": ("copyright [c] *12", "c [copyright] *12"),
    "apache2_name": (f"{_UNDER} apache [software] {{license|licence}} {{version 2 0|v 2 0|v2 0|2 0|v2|version 2}} [the license]",),
    "apache2_use": ("you may not use this file except in compliance with the license",),
    "apache2_copy": ("you may obtain a copy of the license at [http www apache org licenses license 2 0|https www apache org licenses license 2 0]",),
    "apache2_url": ("{http|https} www apache org licenses license 2 0",),
    "apache2_as_is": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache2_see": ("see the license for the specific language governing permissions and limitations under the license",),
    "gpl2_name": _gnu("general public", "gpl", "2 0"),
    "gpl3_name": _gnu("general public", "gpl", "3 0"),
    "gpl2_name_later": _gnu_later("general public", "gpl", "2 0"),
    "gpl3_name_later": _gnu_later("general public", "gpl", "3 0"),
    "lgpl21_name": _gnu("{lesser|library} general public", "lgpl", "2 1"),
    "lgpl3_name": _gnu("lesser general public", "lgpl", "3 0"),
    "lgpl21_name_later": _gnu_later("{lesser|library} general public", "lgpl", "2 1"),
    "lgpl3_name_later": _gnu_later("lesser general public", "lgpl", "3 0"),
    "agpl3_name": _gnu("affero general public", "agpl", "3 0"),
    "agpl3_name_later": _gnu_later("affero general public", "agpl", "3 0"),
    "gpl_free": ("{this program|this library|this software|this file|it|*4} is free software",),
    "gpl3_later": (_gnu_notice("general public", "3"),),
    "gpl2_later": (_gnu_notice("general public", "2"),),
    "lgpl21_later": (_gnu_notice("{lesser|library} general public", "2 1"),),
    "lgpl3_later": (_gnu_notice("lesser general public", "3"),),
    "agpl3_later": (_gnu_notice("affero general public", "3"),),
    "gpl2_only": ("[you can redistribute it and or modify] it under the terms of the gnu general public [license] version 2 [only] as published by the free software foundation",),
    "gpl3_only": ("[you can redistribute it and or modify] it under the terms of the gnu general public [license] version 3 [only] as published by the free software foundation",),
    "gpl_hope": ("{this program|this library|this software|it|*4} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl_details": ("see the gnu [lesser|affero|library] general public license for more details",),
    "gpl_received": ("you should have received a copy of the gnu [lesser|affero|library] general public license along with this {program|library|software|file}",),
    "mpl2_name": ("this source code form is subject to the terms of the mozilla public license {v|version} 2 0", f"{_UNDER} mozilla public {{license|licence}} {{v 2 0|v2 0|version 2 0|2 0}}"),
    "mpl2_copy": ("if a copy of the mpl was not distributed with this file you can obtain one at {http|https} {mozilla org mpl 2 0|www mozilla org mpl 2 0}",),
    "mpl11_name": (f"the contents of this file are subject to the mozilla public license version 1 1 [the license]", f"{_UNDER} mozilla public {{license|licence}} {{v 1 1|v1 1|version 1 1|1 1}}"),
    "epl1_name": (f"{_UNDER} eclipse public {{license|licence}} {{v 1 0|v1 0|version 1 0|1 0}}", "this program and the accompanying materials are made available under the terms of the eclipse public license {v1 0|v 1 0|version 1 0} which accompanies this distribution"),
    "epl2_name": (f"{_UNDER} eclipse public {{license|licence}} {{v 2 0|v2 0|version 2 0|2 0}}", "this program and the accompanying materials are made available under the terms of the eclipse public license {v 2 0|v2 0|version 2 0|2 0} which {is available at|accompanies this distribution} *8"),
    "boost_name": (f"{_UNDER} boost software {{license|licence}} [version 1 0|1 0|v1 0]",),
    "boost_grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "unlicense_grant": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "zero_bsd_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "isc_as_is": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "isc_liability": ("in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",),
    "isc_name": (f"{_UNDER} isc {{license|licence}}",),
    "bsd2_name": (f"{_UNDER} {{bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd}} {{license|licence}}",),
    "bsd3_name": (f"{_UNDER} {{bsd 3 clause|3 clause bsd|new bsd|modified bsd|three clause bsd|revised bsd}} {{license|licence}}",),
    "bsd_redistribute": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [and]",),
    "bsd_names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the {name|names} of *10 nor the names of [its|their|any] contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd_advertising": ("all advertising materials mentioning features or use of this software must display the following acknowledgement *16",),
    "bsd_as_is": ("this software is provided by *8 as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "bsd_liability": ("in no event shall *8 be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",),
    "zlib_as_is": ("this software is provided as is without any express or implied warranty",),
    "zlib_held": ("in no event will the {authors|author} be held liable for any damages arising from the use of this software",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "wtfpl": ("do what the fuck you want to public license", f"{_UNDER} wtfpl"),
    **{
        f"cc_{kind.replace(' ', '_')}_{v.replace(' ', '_')}": (f"{_UNDER} [creative commons] {{cc {kind} {v}|{'|'.join(f'{x} {v}' for x in names)}}} [international|unported|generic] [public] [license|licence]",)
        for kind, names in _CC_KINDS.items()
        for v in _CC_VERSIONS
    },
    "cc0": (f"{_UNDER} [creative commons] {{cc0 1 0|cc0|cc zero 1 0|zero 1 0}} [universal] [public domain dedication] [license]", "[this work is|this software is] dedicated to the public domain"),
    "all_rights": ("all rights reserved",),
}
_GNU_TAIL = ("gpl_hope?", "gpl_details?", "gpl_received?")
_BSD_TAIL = ("bsd_as_is?", "bsd_liability?")

#: licence, then the identifiers that must follow one another; those with a question mark may be missing
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_name",)),
    ("MIT", ("mit_title?", "copyright?", "all_rights?", "mit_grant", "notice_kept", "as_is?", "mit_liability?")),
    ("MIT", ("mit_name", "copyright?", "mit_grant", "notice_kept", "as_is?", "mit_liability?")),
    ("Apache-2.0", ("copyright?", "all_rights?", "apache2_name", "apache2_use?", "apache2_copy?", "apache2_url?", "apache2_as_is?", "apache2_see?")),
    ("GPL-2.0-only", ("gpl2_name",)),
    ("GPL-3.0-only", ("gpl3_name",)),
    ("GPL-2.0-or-later", ("gpl2_name_later",)),
    ("GPL-3.0-or-later", ("gpl3_name_later",)),
    ("LGPL-2.1-only", ("lgpl21_name",)),
    ("LGPL-3.0-only", ("lgpl3_name",)),
    ("LGPL-2.1-or-later", ("lgpl21_name_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_name_later",)),
    ("AGPL-3.0-only", ("agpl3_name",)),
    ("AGPL-3.0-or-later", ("agpl3_name_later",)),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later", *_GNU_TAIL)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_later", *_GNU_TAIL)),
    ("LGPL-2.1-or-later", ("gpl_free", "lgpl21_later", *_GNU_TAIL)),
    ("LGPL-3.0-or-later", ("gpl_free", "lgpl3_later", *_GNU_TAIL)),
    ("AGPL-3.0-or-later", ("gpl_free", "agpl3_later", *_GNU_TAIL)),
    ("GPL-2.0-only", ("gpl_free", "gpl2_only", *_GNU_TAIL)),
    ("GPL-3.0-only", ("gpl_free", "gpl3_only", *_GNU_TAIL)),
    ("MPL-2.0", ("mpl2_name", "mpl2_copy?")),
    ("MPL-1.1", ("mpl11_name",)),
    ("EPL-1.0", ("epl1_name",)),
    ("EPL-2.0", ("epl2_name",)),
    ("BSD-2-Clause", ("bsd2_name",)),
    ("BSD-3-Clause", ("bsd3_name",)),
    ("BSD-2-Clause", ("copyright?", "all_rights?", "bsd_redistribute", "bsd_source", "bsd_binary", *_BSD_TAIL)),
    ("BSD-3-Clause", ("copyright?", "all_rights?", "bsd_redistribute", "bsd_source", "bsd_binary", "bsd_names", *_BSD_TAIL)),
    ("BSD-4-Clause", ("copyright?", "all_rights?", "bsd_redistribute", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_names", *_BSD_TAIL)),
    ("ISC", ("isc_name",)),
    ("ISC", ("copyright?", "isc_grant", "isc_as_is?", "isc_liability?")),
    ("0BSD", ("copyright?", "zero_bsd_grant", "isc_as_is", "isc_liability?")),
    ("Zlib", ("copyright?", "zlib_as_is", "zlib_held", "zlib_grant")),
    ("BSL-1.0", ("boost_name",)),
    ("BSL-1.0", ("boost_grant",)),
    ("Unlicense", ("unlicense", "unlicense_grant?")),
    ("WTFPL", ("wtfpl",)),
    ("CC0-1.0", ("cc0",)),
    ("All-rights-reserved", ("all_rights",)),
    *((f"CC-{kind.replace(' ', '-').upper()}-{v.replace(' ', '.')}", (f"cc_{kind.replace(' ', '_')}_{v.replace(' ', '_')}",)) for kind in _CC_KINDS for v in _CC_VERSIONS),
)
#: Licences that an expression may name.
EXPRESSIONS = tuple(
    sorted(
        {licence for licence, _ in RULES if licence != "All-rights-reserved"}
        | {"Apache-1.1", "Artistic-2.0", "BSD-3-Clause-Clear", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3-only", "GPL-1.0-only", "GPL-1.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later", "MIT-0", "MPL-1.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Ruby", "Vim", "W3C", "X11", "ZPL-2.1"}
    )
)
STOP = r"([.!?;:])[ \t\x0B\f\r]+"

MATCHES = "array<struct<licence:string,rule:int,sentence:int,n_sentences:int>>"
#: What stands between two words of a wording: every piece has a bar on either side.
SPACE = r"(?: |\|\|)"
#: What may stand between two sentences of a rule.
BETWEEN = rf"{SPACE}(?:(?:[0-9]{{1,2}}|[a-z]){SPACE})?"


def _choice(words: str) -> str:
    return "|".join(_plain(w, " ") for w in words.split("|"))


def _plain(words: str, space: str = SPACE) -> str:
    """Words one after another; *n within a choice stays within a piece, as a sentence may begin there."""
    return SPACE.join(rf"(?:[a-z0-9]+{space}){{0,{int(w[1:]) - 1}}}[a-z0-9]+" if w[0] == "*" else w for w in words.split())


def pattern(wording: str) -> str:
    """The regular expression of a wording. Words in [] and *n may be missing."""
    before, out = "", ""
    for kind, words in re.findall(r"([\[{]?)([a-z0-9 |*]+)[\]}]?", wording):
        if not words.strip():
            continue
        for part in [words] if kind else re.findall(r"\*\d+|[a-z0-9 ]*[a-z0-9]", words):
            if kind == "[" or (part[0] == "*"):
                one = _choice(part) if kind else _plain(part)
                out, before = (f"{out}(?:{SPACE}(?:{one}))?", before) if out else (out, f"{before}(?:(?:{one}){SPACE})?")
            else:
                one = f"(?:{_choice(part)})" if kind else _plain(part)
                out = f"{out}{SPACE}{one}" if out else one
    return before + out


def parts(wording: str) -> list[tuple[str, ...]]:
    """What every text with the wording holds: runs of words, or one of a choice of them."""
    out = []
    for kind, words in re.findall(r"([\[{]?)([a-z0-9 |*]+)[\]}]?", wording):
        if kind == "{" and "*" not in words:
            out.append(tuple(words.split("|")))
        elif not kind:
            out += [(w.strip(),) for w in re.split(r"\*\d+", words) if w.strip()]
    return out


def core(wording: str) -> tuple[str, ...]:
    """The part that says most: the longest but for words that licences share."""
    every = parts(wording)
    return max([p for p in every if p not in _SHARED] or every, key=lambda p: min(map(len, p)))


def lead(wording: str) -> set[str]:
    """Words one of which any text with the wording holds."""
    telling = lambda run: max(run.split(), key=lambda w: (w not in _COMMON, len(w)))
    every = [{telling(x) for x in p} for p in parts(wording) if p not in (_SHARED[0], _SHARED[2])] or [{telling(x) for x in p} for p in parts(wording)]
    return max(every, key=lambda p: min(map(len, p)))


def rule_pattern(needs: tuple[str, ...], sentences: dict[str, tuple[str, ...]]) -> str:
    one = lambda n: f"(?:{'|'.join(pattern(w) for w in sentences[n.rstrip('?')])})"
    before, out = "", ""
    for n in needs:
        if n.endswith("?"):
            out, before = (f"{out}(?:{BETWEEN}{one(n)})?", before) if out else (out, f"{before}(?:{one(n)}{BETWEEN})?")
        else:
            out = f"{out}{BETWEEN}{one(n)}" if out else one(n)
    return rf"\|(?:(?:[0-9]{{1,2}}|[a-z]) )?{before}{out}\|"


def expression_pattern(licence: str) -> str:
    name = re.sub("[^a-z0-9]+", " ", licence.lower())
    return rf"\|[^|]*spdx license identifier{SPACE}(?:[a-z0-9 ]+ (?:or|and) )?{name}(?: (?:or|and|with) [a-z0-9 ]+)?\|"


def _tables(sentences: dict, rules: tuple) -> tuple[list[tuple[str, str]], list[tuple[str, int, list[str], str]]]:
    """(identifier, wording) of what rules can't do without, and (licence, rule, identifiers, pattern)."""
    tried = [(licence, k, [n for n in needs if not n.endswith("?")], rule_pattern(needs, sentences)) for k, (licence, needs) in enumerate(rules)]
    needed = {n for _, _, needs, _ in tried for n in needs}
    known = [(n, w) for n, wordings in sentences.items() if n in needed for w in wordings] + [("spdx", "spdx license identifier")]
    return known, tried + [(licence, len(rules) + k, ["spdx"], expression_pattern(licence)) for k, licence in enumerate(EXPRESSIONS)]


def _any(text: Column, words: Iterable[str]) -> Column:
    return functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in words])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once; the optimiser would write it out wherever it is used, within loops too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan_documents(docs: DataFrame, sentences: dict = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, licence, rule, sentence (the piece it begins with, from 0), n_sentences (pieces) of every match in docs (doc_id, text)."""
    known, tried = _tables(sentences, rules)
    text = F.coalesce("text", F.lit(""))
    leads = set().union(*[lead(w) for _, w in known])  # a text without any has no match
    leads = sorted(w for w in leads if not any(x in w and x != w for x in leads))
    plain = F.filter(F.transform(F.split(F.regexp_replace(text, STOP, "$1\n"), "\n"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))), lambda s: s != "")
    whole = F.concat(F.lit("|"), F.array_join(plain, "||"), F.lit("|"))
    words = F.array(*[F.struct(F.lit(n).alias("id"), F.array(*[F.lit(f" {x} ") for x in core(w)]).alias("any")) for n, w in known])
    every = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(k).alias("rule"), F.array(*map(F.lit, needs)).alias("needs"), F.lit(rx).alias("rx")) for licence, k, needs, rx in tried])

    def ids(pieces: Column) -> Column:
        return _let(F.regexp_replace(pieces, r"\|+", " "), lambda flat: F.transform(F.filter(words, lambda w: F.exists(w["any"], lambda x: F.contains(flat, x))), lambda w: w["id"]))

    count = lambda s: ((F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))) / 2).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + count(s))

    def places(pieces: Column, r: Column) -> Column:
        hits = F.regexp_extract_all(pieces, r["rx"], F.lit(0))
        at = lambda hits, gaps: F.transform(hits, lambda h, k: F.struct(r["licence"].alias("licence"), r["rule"].alias("rule"), (total(F.slice(gaps, 1, k + 1)) + total(F.slice(hits, 1, k))).alias("sentence"), count(h).alias("n_sentences")))
        return _let(hits, lambda h: F.when(F.size(h) == 0, F.array().cast(MATCHES)).otherwise(_let(F.split(pieces, r["rx"], -1), lambda gaps: at(h, gaps))))

    def matches(pieces: Column) -> Column:
        likely = _let(ids(pieces), lambda there: F.filter(every, lambda r: F.size(F.array_except(r["needs"], there)) == 0))
        return _let(F.flatten(F.transform(likely, lambda r: places(pieces, r))), lambda m: F.filter(m, lambda a: ~F.exists(m, lambda b: inside(a, b))))

    inside = lambda a, b: (b["sentence"] <= a["sentence"]) & (b["sentence"] + b["n_sentences"] >= a["sentence"] + a["n_sentences"]) & (b["n_sentences"] > a["n_sentences"])
    found = docs.where(_let(F.lower(text), lambda low: _any(low, leads))).select("doc_id", F.inline_outer(_let(whole, matches)))  # outer: a filter on its size would evaluate it again
    return found.where("licence is not null")


def oracle_sql(sentences: dict = SENTENCES, rules: tuple = RULES) -> str:
    """The same over table documents, in DuckDB's SQL: every rule is tried on every text."""
    _, tried = _tables(sentences, rules)
    each = " UNION ALL ".join(f"SELECT r, doc_id, '{licence}' AS licence, {k} AS rule, regexp_extract_all(p, '{rx}') AS hits, string_split_regex(p, '{rx}') AS gaps FROM cut WHERE regexp_matches(p, '{rx}')" for licence, k, _, rx in tried)
    return rf"""
WITH cut AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, '|' || array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10)),
  lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> ''), '||') || '|' AS p FROM documents),
split AS ({each}),
ends AS (SELECT r, doc_id, licence, rule, list_transform(hits, lambda h: len(h) - len(replace(h, '|', ''))) AS h, list_transform(gaps, lambda g: len(g) - len(replace(g, '|', ''))) AS g FROM split),
found AS (SELECT r, doc_id, licence, rule, (coalesce(list_sum(g[1:k]), 0) + coalesce(list_sum(h[1:k - 1]), 0)) // 2 AS sentence, h[k] // 2 AS n FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM ends)),
kept AS (SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE a.r = b.r AND b.sentence <= a.sentence AND b.sentence + b.n >= a.sentence + a.n AND b.n > a.n))
SELECT doc_id, licence, rule::INT AS rule, sentence::INT AS sentence, n::INT AS n_sentences FROM kept"""
