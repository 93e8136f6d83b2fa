"""Licence scans by ordered signature rules.

A rule is a regular expression with a priority, a label, a confidence and a keyword that any match must hold
(without white space, as any white space may stand for a rule's space).
The keyword is looked for first (a plain byte search); only rules whose keyword is there run. Of the matches,
one that lies inside the interval of a match of a better priority (or, at equal priority, of a longer one) is
suppressed. Rules come from a table of licences and a few ways in which texts name a licence.

Base phrases are a fixed part of the contract: their words, lower-cased, standing consecutively. Their labels
always stay. Null and empty texts have no words and no labels; rows are judged alone, so ties, repeats, null
ids and extra columns change nothing.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm import textnum as T

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label | name as a regular expression | keyword in every match of the name | SPDX ids as a regular expression
LICENCES = """
mit | (?:the )?mit(?: \\(expat\\))? | mit | mit(?:-0)?
mit-x11 | (?:the )?x11(?: consortium)? | x11 | x11
apache-2 | (?:the )?apache(?: software)?(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?2(?:\\.0)? | apache | apache-2\\.0
apache-1.1 | (?:the )?apache(?: software)?(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?1\\.1 | apache | apache-1\\.1
gpl-1 | (?:the )?(?:gnu )?(?:general public|gpl)(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?1(?:\\.0)? | gpl|general | gpl-1\\.0(?:-only|-or-later|\\+)?
gpl-2 | (?:the )?(?:gnu )?(?:general public|gpl)(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?2(?:\\.0)? | gpl|general | gpl-2\\.0(?:-only|-or-later|\\+)?
gpl-3 | (?:the )?(?:gnu )?(?:general public|gpl)(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?3(?:\\.0)? | gpl|general | gpl-3\\.0(?:-only|-or-later|\\+)?
lgpl-2 | (?:the )?(?:gnu )?(?:library general public|lgpl)(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?2(?:\\.0)? | lgpl|library | lgpl-2\\.0(?:-only|-or-later|\\+)?
lgpl-2.1 | (?:the )?(?:gnu )?(?:lesser general public|lgpl)(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?2\\.1 | lgpl|lesser | lgpl-2\\.1(?:-only|-or-later|\\+)?
lgpl-3 | (?:the )?(?:gnu )?(?:lesser general public|lgpl)(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?3(?:\\.0)? | lgpl|lesser | lgpl-3\\.0(?:-only|-or-later|\\+)?
agpl-3 | (?:the )?(?:gnu )?(?:affero general public|agpl)(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?3(?:\\.0)? | agpl|affero | agpl-3\\.0(?:-only|-or-later|\\+)?
gfdl | (?:the )?(?:gnu )?(?:free documentation|fdl|gfdl) | documentation|fdl | gfdl-1\\.[123](?:-only|-or-later|\\+)?
bsd-0 | (?:the )?(?:zero-clause bsd|0bsd) | bsd | 0bsd
bsd-1-clause | (?:the )?(?:(?:1|one)[- ]clause bsd|bsd[- ]1[- ]clause) | bsd | bsd-1-clause
bsd-2-clause | (?:the )?(?:(?:(?:2|two)[- ]clause|simplified|freebsd) bsd|bsd[- ]2[- ]clause) | bsd | bsd-2-clause
bsd-3-clause | (?:the )?(?:(?:(?:3|three)[- ]clause|new|revised|modified) bsd|bsd[- ]3[- ]clause) | bsd | bsd-3-clause
bsd-4-clause | (?:the )?(?:(?:(?:4|four)[- ]clause|original|old) bsd|bsd[- ]4[- ]clause) | bsd | bsd-4-clause
isc | (?:the )?isc | isc | isc
zlib | (?:the )?zlib(?:/libpng)? | zlib | zlib
libpng | (?:the )?(?:png reference library|libpng) | png | libpng(?:-2\\.0)?
boost | (?:the )?boost software(?: license)?,? ?(?:version )?1\\.0 | boost | bsl-1\\.0
mpl-1.1 | (?:the )?(?:mozilla public|mpl)(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?1\\.1 | mozilla|mpl | mpl-1\\.1
mpl-2 | (?:the )?(?:mozilla public|mpl)(?: license)?,? ?(?:v(?:ersion|er)?\\.? ?)?2(?:\\.0)? | mozilla|mpl | mpl-2\\.0
epl-1 | (?:the )?(?:eclipse public|epl)(?: license)?,? ?(?:- )?(?:v(?:ersion|er)?\\.? ?)?1(?:\\.0)? | eclipse|epl | epl-1\\.0
epl-2 | (?:the )?(?:eclipse public|epl)(?: license)?,? ?(?:- )?(?:v(?:ersion|er)?\\.? ?)?2(?:\\.0)? | eclipse|epl | epl-2\\.0
eupl | (?:the )?(?:european union public|eupl) | european|eupl | eupl-1\\.[012]
cddl | (?:the )?(?:common development and distribution|cddl) | distribution|cddl | cddl-1\\.[01]
cpl | (?:the )?common public | common | cpl-1\\.0
artistic | (?:the )?(?:perl )?artistic(?: license)?(?: 2\\.0)? | artistic | artistic-(?:1|2)\\.0
unlicense | (?:the )?unlicense | unlicense | unlicense
wtfpl | (?:the )?(?:do what the fuck you want to public|wtfpl) | wtfpl|fuck | wtfpl
psf | (?:the )?(?:python software foundation|psf) | python|psf | (?:psf|python)-2\\.0
php | (?:the )?php(?: license)?(?:,? version 3\\.0?1)? | php | php-3\\.0?1
ruby | (?:the )?ruby | ruby | ruby
postgresql | (?:the )?postgresql | postgresql | postgresql
openssl | (?:the )?openssl | openssl | openssl
curl | (?:the )?curl | curl | curl
ncsa | (?:the )?(?:university of illinois/ncsa|ncsa) open source | ncsa | ncsa
afl | (?:the )?academic free | academic | afl-[123]\\.[012]
osl | (?:the )?open software | software | osl-[123]\\.[01]
ecl | (?:the )?educational community | educational | ecl-[12]\\.0
ms-pl | (?:the )?microsoft public | microsoft | ms-pl
ms-rl | (?:the )?microsoft reciprocal | reciprocal | ms-rl
oracle-upl | (?:the )?universal permissive | permissive | upl-1\\.0
beerware | (?:the )?beer-?ware | beer | beerware
vim | (?:the )?vim | vim | vim
tcl | (?:the )?tcl/tk | tcl/tk | tcl
sleepycat | (?:the )?sleepycat | sleepycat | sleepycat
ofl | (?:the )?(?:sil )?open font | font | ofl-1\\.[01]
odbl | (?:the )?(?:open database|odbl) | database|odbl | odbl-1\\.0
odc-by | (?:the )?open data commons attribution | attribution | odc-by-1\\.0
pddl | (?:the )?public domain dedication and | dedication | pddl-1\\.0
cecill | (?:the )?cecill(?:-[bc])? | cecill | cecill(?:-[bc]|-[12]\\.[01])?
elastic | (?:the )?elastic(?: license)?(?: 2\\.0)? | elastic | elastic-2\\.0
sspl | (?:the )?(?:server side public|sspl) | server|sspl | sspl-1\\.0
busl | (?:the )?business source | business | busl-1\\.1
commons-clause | (?:the )?commons clause | commons | commons-clause
polyform | (?:the )?polyform [a-z]+ | polyform | polyform-[a-z]+-1\\.0\\.0
openrail | (?:the )?(?:creativeml )?open ?rail(?:-m|\\+\\+)? | rail | openrail(?:\\+\\+)?
cc0 | (?:the )?(?:creative commons zero|cc0)(?: 1\\.0)?(?: universal)? | zero|cc0 | cc0-1\\.0
cc-by | (?:the )?(?:creative commons attribution|cc[- ]by)(?:[- ](?:[1234]\\.0))?(?: international)? | attribution|cc | cc-by-[1234]\\.[05]
cc-by-sa | (?:the )?(?:creative commons attribution[- ]share[- ]?alike|cc[- ]by[- ]sa)(?:[- ](?:[1234]\\.0))?(?: international)? | share|cc | cc-by-sa-[1234]\\.[05]
cc-by-nd | (?:the )?(?:creative commons attribution[- ]no ?deriv(?:ative)?s|cc[- ]by[- ]nd)(?:[- ](?:[1234]\\.0))?(?: international)? | no|nd | cc-by-nd-[1234]\\.[05]
cc-by-nc | (?:the )?(?:creative commons attribution[- ]non-?commercial|cc[- ]by[- ]nc)(?:[- ](?:[1234]\\.0))?(?: international)? | non|nc | cc-by-nc-[1234]\\.[05]
cc-by-nc-sa | (?:the )?(?:creative commons attribution[- ]non-?commercial[- ]share[- ]?alike|cc[- ]by[- ]nc[- ]sa)(?:[- ](?:[1234]\\.0))?(?: international)? | share|sa | cc-by-nc-sa-[1234]\\.[05]
cc-by-nc-nd | (?:the )?(?:creative commons attribution[- ]non-?commercial[- ]no ?deriv(?:ative)?s|cc[- ]by[- ]nc[- ]nd)(?:[- ](?:[1234]\\.0))?(?: international)? | deriv|nd | cc-by-nc-nd-[1234]\\.[05]
"""

#: priority (the least is the best) | confidence | keyword besides the licence's | pattern around {name} or {spdx}
WAYS = """
1 | 1.00 | spdx | spdx-license-identifier: *\\(?{spdx}(?![\\w.+-])
2 | 0.95 | licen | (?:re)?licen[sc]ed(?: to you)? (?:under|with|by)(?: the terms of)? {name}(?:,? licen[sc]e)?(?!\\w)
2 | 0.95 | under | (?:released|distributed|available|published|provided|covered|redistributed)(?: \\w+){{0,3}} under(?: the terms of)? {name}(?:,? licen[sc]e)?(?!\\w)
3 | 0.90 | licen | licen[sc]e *[:=] *["']?{name}(?:,? licen[sc]e)?(?!\\w)
3 | 0.85 | licen | see (?:the )?(?:file )?licen[sc]e(?:\\.\\w+)? for {name}(?!\\w)
4 | 0.70 | licen | {name}[ -]licen[sc]e(?:,? (?:v(?:ersion)?\\.? ?)?\\d+(?:\\.\\d+)*)?(?!\\w)
"""

#: Rules for texts that name no licence, and for addresses: priority | confidence | label | keyword | pattern
OTHERS = """
2 | 0.95 | mit | hereby | permission is hereby granted,? free of charge,? to any person obtaining a copy
2 | 0.90 | isc | permission | permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose
2 | 0.90 | bsd-2-clause | redistribution | redistribution and use in source and binary forms,? with or without modification
2 | 0.90 | zlib | 'as-is' | this software is provided 'as-is',? without any express or implied warranty
2 | 0.90 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
3 | 0.85 | apache-2 | apache.org/licenses | apache\\.org/licenses/license-2\\.0
3 | 0.85 | gpl-3 | gnu.org/licenses | gnu\\.org/licenses/gpl-3\\.0
3 | 0.85 | gpl-2 | gnu.org/licenses | gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0
3 | 0.85 | mpl-2 | mozilla.org/mpl | mozilla\\.org/mpl/2\\.0
3 | 0.85 | mit | opensource.org/licenses | opensource\\.org/licenses/mit
3 | 0.85 | bsd-3-clause | opensource.org/licenses | opensource\\.org/licenses/bsd-3-clause
3 | 0.85 | cc0 | creativecommons.org | creativecommons\\.org/publicdomain/zero
3 | 0.85 | cc-by-nc-nd | creativecommons.org | creativecommons\\.org/licenses/by-nc-nd(?![\\w-])
3 | 0.85 | cc-by-nc-sa | creativecommons.org | creativecommons\\.org/licenses/by-nc-sa(?![\\w-])
3 | 0.85 | cc-by-nc | creativecommons.org | creativecommons\\.org/licenses/by-nc(?![\\w-])
3 | 0.85 | cc-by-nd | creativecommons.org | creativecommons\\.org/licenses/by-nd(?![\\w-])
3 | 0.85 | cc-by-sa | creativecommons.org | creativecommons\\.org/licenses/by-sa(?![\\w-])
3 | 0.85 | cc-by | creativecommons.org | creativecommons\\.org/licenses/by(?![\\w-])
3 | 0.60 | public-domain | domain | (?:placed in|dedicated to|part of) the public domain
5 | 0.50 | cc-by-nc | cc | cc[- ]by[- ]nc(?:[- ][1234]\\.0)?(?![\\w-])
5 | 0.50 | cc-by-sa | cc | cc[- ]by[- ]sa(?:[- ][1234]\\.0)?(?![\\w-])
5 | 0.50 | cc-by-nd | cc | cc[- ]by[- ]nd(?:[- ][1234]\\.0)?(?![\\w-])
5 | 0.50 | cc-by-nc-sa | cc | cc[- ]by[- ]nc[- ]sa(?:[- ][1234]\\.0)?(?![\\w-])
5 | 0.50 | cc-by-nc-nd | cc | cc[- ]by[- ]nc[- ]nd(?:[- ][1234]\\.0)?(?![\\w-])
6 | 0.40 | proprietary | reserved | (?:copyright|\\(c\\)|\\u00a9)[^\\n]{0,80}all rights reserved
6 | 0.30 | other | licen | (?:licen[sc]ed under|under the terms of) (?:the )?(?:[\\w.-]+ ){0,4}licen[sc]e(?!\\w)
"""


@cache
def rules() -> tuple[tuple, ...]:
    """(order, priority, label, confidence, keywords of which all must be there, each as alternatives; pattern)"""
    rows = lambda table: [[x.strip() for x in re.split(r" \| ", line)] for line in table.strip().splitlines()]
    out = []
    for priority, sure, keyword, way in rows(WAYS):
        for label, name, word, spdx in rows(LICENCES):
            pattern = way.replace("{{0,3}}", "{0,3}").replace("{name}", f"(?:{name})").replace("{spdx}", f"(?:{spdx})")
            need = ((keyword,),) if "{spdx}" in way else ((keyword,), tuple(word.split("|")))
            out.append((int(priority), label, float(sure), need, pattern))
    for priority, sure, label, keyword, pattern in rows(OTHERS):
        out.append((int(priority), label, float(sure), ((keyword,),), pattern.replace("{{0,80}}", "{0,80}")))
    out.sort(key=lambda r: r[0])
    return tuple((i, p, label, sure, need, re.compile(r"(?<!\w)" + _spaced(pattern))) for i, (p, label, sure, need, pattern) in enumerate(out))


def _spaced(pattern: str) -> str:
    """A space of a rule stands for any white space."""
    return pattern.replace("[- ]", r"[-\s]").replace(" *", r"\s*").replace(" ?", r"\s?").replace(" ", r"\s+")


@cache
def keywords() -> tuple[tuple[str, ...], dict]:
    """All keywords, and for each of the first kind the rules that need it."""
    by: dict[str, list] = {}
    for rule in rules():
        by.setdefault(rule[4][0][0], []).append(rule)
    return tuple(by), by


def detections(text: str) -> list[tuple[int, int, int, str, float]]:
    """(start, end, priority, label, confidence) of what stays, in order of start."""
    first, by = keywords()
    found = []
    for keyword in first:
        if keyword not in text:
            continue
        there: dict[str, bool] = {}
        for order, priority, label, sure, need, pattern in by[keyword]:
            for alternatives in need[1:]:
                for w in alternatives:
                    if w not in there:
                        there[w] = w in text
                if not any(there[w] for w in alternatives):
                    break
            else:
                found += [(m.start(), m.end(), priority, order, label, sure) for m in pattern.finditer(text)]
    kept = not_contained(found)
    return sorted((s, e, p, label, sure) for s, e, p, _, label, sure in kept)


def not_contained(found: list[tuple]) -> list[tuple]:
    """Of (start, end, priority, order, ...) those that lie inside no interval of a better priority, nor of an equal one that is longer (or as long and earlier in order).

    What a suppressed interval holds is held by the one that suppressed it too, so each is compared with all intervals
    before it in rank: priority by priority, a sweep by start that carries the farthest end."""
    kept: list[tuple] = []
    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of better priorities, by start
    rows = sorted(found, key=lambda f: (f[2], f[0], -f[1], f[3]))
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][2] == rows[i][2]:
            j += 1
        s, e = (np.array([r[k] for r in rows[i:j]], np.int64) for k in (0, 1))
        far = np.r_[-1, np.maximum.accumulate(ends)][np.searchsorted(starts, s, "right")]
        own = np.r_[-1, np.maximum.accumulate(e)[:-1]]
        kept += [rows[i + k] for k in np.flatnonzero(np.maximum(far, own) < e)]
        starts, ends = np.r_[starts, s], np.r_[ends, e]
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        i = j
    return kept


@cache
def _phrases() -> tuple:
    word = rb"[0-9a-z\x80-\xff]"
    gap = rb"[^0-9a-z\x80-\xff]+"
    return tuple((label, words.split()[-1].encode(), re.compile(rb"(?<!" + word + rb")" + gap.join(x.encode() for x in words.split()) + rb"(?!" + word + rb")")) for words, label in BASE.items())


def scan(raw: bytes) -> dict:
    text = raw.lower()  # bytes: A-Z only
    mask = T.ALNUM[np.frombuffer(text, np.uint8)]
    starts = mask.copy()
    starts[1:] &= ~mask[:-1]
    base = [(m.start(), label) for label, last, phrase in _phrases() if last in text for m in phrase.finditer(text)]
    spans = detections(text.decode("utf-8", "replace"))
    before = np.cumsum(starts)
    at = [int(before[s]) - 1 for s, _ in base]
    labels = {x for _, x in base}
    return {
        "n_words": int(np.count_nonzero(starts)), "n_base": len(base), "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {x[3] for x in spans})), "score": max([1.0] * bool(base) + [x[4] for x in spans], default=0.0),
        "spans": [{"start": s, "end": e, "priority": p, "label": label, "confidence": sure} for s, e, p, label, sure in spans],
    }


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<start: bigint, end: bigint, priority: bigint, label: string, confidence: double>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])
_KIND = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def _scan_all(column: pa.Array) -> pa.Array:
    return pa.array([scan(x) for x in T.as_bytes(column)], _KIND)


def license_column(text: Column) -> Column:
    return F.arrow_udf(_scan_all, SCHEMA)(text.cast("binary"))


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and the struct `licence` (SCHEMA), which replaces a column of that name. One pass, no shuffle."""
    return docs.withColumn("licence", license_column(F.col(text)))
