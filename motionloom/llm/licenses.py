"""License scans: ordered signature rules over the words of each whole text.

Method: a rule is a regex over the text's lower-case words joined by single blanks, with a label, a
priority, a confidence and a keyword. One pass of a keyword automaton tells which rules can match at
all; only those run. Overlapping detections are resolved by priority and containment: a detection
that lies inside one of higher priority, or inside a longer one of the same priority, is dropped; of
equal ones the first rule's stays.

Rules are hand-written names of licenses (NAMES) seen in hand-written contexts (CONTEXTS),
SPDX identifiers (IDS) behind an SPDX tag, anywhere in its expression, or a grant, and notices that
need no name (NOTICES): some 600 regexes. A context gives priority and confidence: an
SPDX tag is above a grant, a grant above a bare mention.

Edge cases: a null or empty text has no words and no labels; repeated rows are scanned alike; of equal
detections the first rule's stays; extra columns are ignored; an empty table gives an empty result. Time and memory are linear in a text's
length and its detections.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD_BYTES, ready, texts_of

#: Phrases that are labels by themselves, wherever their words stand next to each other.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label; keyword that every match holds; regex of the name in words.
NAMES = """
apache-2.0; apache; apache (?:software )?licen[sc]e(?: version| v)? 2(?: 0)?
apache-1.1; apache; apache (?:software )?licen[sc]e(?: version| v)? 1 1
apache-1.0; apache; apache (?:software )?licen[sc]e(?: version| v)? 1 0
apache; apache; apache(?: software)? licen[sc]e
mit; mit; (?:the )?mit(?: x11| expat)? licen[sc]e
mit-0; mit; mit (?:no attribution|0) licen[sc]e
x11; x11; x11 licen[sc]e
expat; expat; expat licen[sc]e
bsd-2-clause; bsd; (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3-clause; bsd; (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-4-clause; bsd; (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?
bsd-0-clause; bsd; (?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?
bsd; bsd; bsd(?: style)? licen[sc]e
agpl-3.0; affero; (?:gnu )?affero general public licen[sc]e(?: version| v)? 3(?: 0)?
agpl; affero; (?:gnu )?affero general public licen[sc]e
lgpl-2.1; lesser; (?:gnu )?lesser general public licen[sc]e(?: version| v)? 2 1
lgpl-3.0; lesser; (?:gnu )?lesser general public licen[sc]e(?: version| v)? 3(?: 0)?
lgpl; lesser; (?:gnu )?lesser general public licen[sc]e
lgpl-2.0; library; (?:gnu )?library general public licen[sc]e(?: version| v)? 2(?: 0)?
gpl-3.0; general public; (?:gnu )?general public licen[sc]e(?: version| v)? 3(?: 0)?
gpl-2.0; general public; (?:gnu )?general public licen[sc]e(?: version| v)? 2(?: 0)?
gpl-1.0; general public; (?:gnu )?general public licen[sc]e(?: version| v)? 1(?: 0)?
gpl; general public; (?:gnu )?general public licen[sc]e
gfdl-1.3; free documentation; (?:gnu )?free documentation licen[sc]e(?: version)? 1 3
gfdl-1.2; free documentation; (?:gnu )?free documentation licen[sc]e(?: version)? 1 2
gfdl; free documentation; (?:gnu )?free documentation licen[sc]e
mpl-2.0; mozilla; mozilla public licen[sc]e(?: version| v)? 2(?: 0)?
mpl-1.1; mozilla; mozilla public licen[sc]e(?: version| v)? 1 1
mpl; mozilla; mozilla public licen[sc]e
epl-2.0; eclipse; eclipse public licen[sc]e(?: version| v)? 2(?: 0)?
epl-1.0; eclipse; eclipse public licen[sc]e(?: version| v)? 1(?: 0)?
epl; eclipse; eclipse public licen[sc]e
edl; eclipse; eclipse distribution licen[sc]e
cddl-1.0; development and distribution; common development and distribution licen[sc]e(?: version)?(?: 1 0)?
cpl-1.0; common public; common public licen[sc]e
ipl-1.0; ibm; ibm public licen[sc]e
eupl-1.2; european union; european union public licen[sc]e(?: version| v)? 1 2
eupl; european union; european union public licen[sc]e
osl-3.0; open software; open software licen[sc]e(?: version| v)?(?: 3(?: 0)?)?
afl-3.0; academic free; academic free licen[sc]e(?: version| v)?(?: 3(?: 0)?)?
artistic-2.0; artistic; artistic licen[sc]e(?: version)? 2(?: 0)?
artistic; artistic; (?:perl )?artistic licen[sc]e
bsl-1.0; boost; boost software licen[sc]e(?: version)?(?: 1 0)?
busl-1.1; business source; business source licen[sc]e
sspl-1.0; server side; server side public licen[sc]e
elastic-2.0; elastic; elastic licen[sc]e
isc; isc; isc licen[sc]e
zlib; zlib; zlib(?: libpng)? licen[sc]e
libpng; libpng; libpng licen[sc]e
ms-pl; microsoft; microsoft public licen[sc]e
ms-rl; microsoft; microsoft reciprocal licen[sc]e
wtfpl; wtfpl; wtfpl
unlicense; unlicense; (?:the )?unlicense
python-2.0; python; python software foundation licen[sc]e
php-3.01; php; php licen[sc]e
ruby; ruby; ruby licen[sc]e
openssl; openssl; openssl licen[sc]e
postgresql; postgresql; postgresql licen[sc]e
vim; vim; vim licen[sc]e
ncsa; ncsa; (?:university of illinois )?ncsa(?: open source)? licen[sc]e
w3c; w3c; w3c software(?: notice and)? licen[sc]e
ofl-1.1; open font; (?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?
odbl-1.0; open database; open database licen[sc]e
odc-by-1.0; open data commons; open data commons attribution licen[sc]e
pddl-1.0; public domain dedication; (?:open data commons )?public domain dedication and licen[sc]e
cc0-1.0; cc0; cc0(?: 1 0)?(?: universal)?
cc0-1.0; creative commons zero; creative commons zero(?: v1 0)?(?: universal)?
cc-by-nc-nd; cc by; cc by nc nd(?: \\d 0)?
cc-by-nc-sa; cc by; cc by nc sa(?: \\d 0)?
cc-by-nc; cc by; cc by nc(?: \\d 0)?
cc-by-nd; cc by; cc by nd(?: \\d 0)?
cc-by-sa; cc by; cc by sa(?: \\d 0)?
cc-by; cc by; cc by(?: \\d 0)?
cc-by-nc-nd; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s?(?: \\d 0)?
cc-by-nc-sa; creative commons; creative commons attribution non ?commercial share ?alike(?: \\d 0)?
cc-by-nc; creative commons; creative commons attribution non ?commercial(?: \\d 0)?
cc-by-nd; creative commons; creative commons attribution no ?deriv(?:ative|ative work)?s?(?: \\d 0)?
cc-by-sa; creative commons; creative commons attribution share ?alike(?: \\d 0)?
cc-by; creative commons; creative commons attribution(?: \\d 0)?
creative-commons; creative commons; creative commons(?: public)? licen[sc]e
cecill-2.1; cecill; cecill(?: b| c)?(?: free software)?(?: licen[sc]e)?
mulan-psl; mulan; mulan(?: permissive software)? licen[sc]e
upl-1.0; universal permissive; universal permissive licen[sc]e
rpl-1.5; reciprocal public; reciprocal public licen[sc]e
llama; llama; llama \\d(?: \\d)? community licen[sc]e
openrail; rail; (?:big ?science |creativeml )?(?:open ?)?rail(?: m)? licen[sc]e
json; json; json licen[sc]e
beerware; beer; beer ?ware licen[sc]e
agpl-3.0; agpl; (?:gnu )?agpl(?: ?v ?| version | )?3(?: 0)?
agpl; agpl; (?:gnu )?agpl
lgpl-2.1; lgpl; (?:gnu )?lgpl(?: ?v ?| version | )?2 1
lgpl-2.0; lgpl; (?:gnu )?lgpl(?: ?v ?| version | )?2(?: 0)?
lgpl-3.0; lgpl; (?:gnu )?lgpl(?: ?v ?| version | )?3(?: 0)?
lgpl; lgpl; (?:gnu )?lgpl
gpl-3.0; gpl; (?:gnu )?gpl(?: ?v ?| version | )?3(?: 0)?
gpl-2.0; gpl; (?:gnu )?gpl(?: ?v ?| version | )?2(?: 0)?
gpl-1.0; gpl; (?:gnu )?gpl(?: ?v ?| version | )?1(?: 0)?
gpl; gpl; (?:gnu )?gpl
"""
#: label; keyword that every match holds; regex of the SPDX identifier in words, without "only" and "or later".
IDS = """
apache-2.0; apache; apache 2 0
apache-1.1; apache; apache 1 1
apache-1.0; apache; apache 1 0
mit; mit; mit
mit-0; mit; mit 0
x11; x11; x11
bsd-2-clause; bsd; bsd 2 clause(?: patent| views)?
bsd-3-clause; bsd; bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause; bsd; bsd 4 clause(?: uc)?
bsd-0-clause; bsd; 0bsd
agpl-3.0; agpl; agpl 3 0
agpl-1.0; agpl; agpl 1 0
lgpl-2.0; lgpl; lgpl 2 0
lgpl-2.1; lgpl; lgpl 2 1
lgpl-3.0; lgpl; lgpl 3 0
gpl-1.0; gpl; gpl 1 0
gpl-2.0; gpl; gpl 2 0
gpl-3.0; gpl; gpl 3 0
gfdl-1.1; gfdl; gfdl 1 1
gfdl-1.2; gfdl; gfdl 1 2
gfdl-1.3; gfdl; gfdl 1 3
mpl-1.0; mpl; mpl 1 0
mpl-1.1; mpl; mpl 1 1
mpl-2.0; mpl; mpl 2 0(?: no copyleft exception)?
epl-1.0; epl; epl 1 0
epl-2.0; epl; epl 2 0
cddl-1.0; cddl; cddl 1 0
cddl-1.1; cddl; cddl 1 1
cpl-1.0; cpl; cpl 1 0
ipl-1.0; ipl; ipl 1 0
eupl-1.1; eupl; eupl 1 1
eupl-1.2; eupl; eupl 1 2
osl-3.0; osl; osl 3 0
afl-3.0; afl; afl 3 0
artistic-1.0; artistic; artistic 1 0(?: perl| cl8)?
artistic-2.0; artistic; artistic 2 0
bsl-1.0; bsl; bsl 1 0
busl-1.1; busl; busl 1 1
sspl-1.0; sspl; sspl 1 0
elastic-2.0; elastic; elastic 2 0
isc; isc; isc
zlib; zlib; zlib
libpng; libpng; libpng(?: 2 0)?
ms-pl; ms pl; ms pl
ms-rl; ms rl; ms rl
wtfpl; wtfpl; wtfpl
unlicense; unlicense; unlicense
python-2.0; python; python 2 0(?: 1)?
psf-2.0; psf; psf 2 0
php-3.01; php; php 3 01
ruby; ruby; ruby
openssl; openssl; openssl
postgresql; postgresql; postgresql
vim; vim; vim
ncsa; ncsa; ncsa
w3c; w3c; w3c
ofl-1.1; ofl; ofl 1 1(?: no rfn| rfn)?
odbl-1.0; odbl; odbl 1 0
odc-by-1.0; odc by; odc by 1 0
pddl-1.0; pddl; pddl 1 0
cc0-1.0; cc0; cc0 1 0
cc-by-nc-nd; cc by; cc by nc nd \\d \\d
cc-by-nc-sa; cc by; cc by nc sa \\d \\d
cc-by-nc; cc by; cc by nc \\d \\d
cc-by-nd; cc by; cc by nd \\d \\d
cc-by-sa; cc by; cc by sa \\d \\d
cc-by; cc by; cc by \\d \\d
cecill-2.1; cecill; cecill 2 1
mulan-psl; mulan; mulanpsl [12] 0
upl-1.0; upl; upl 1 0
rpl-1.5; rpl; rpl 1 5
json; json; json
beerware; beerware; beerware
"""
SUFFIX = "(?: only| or later)?"
EXCEPTION = "(?: with (?:[a-z0-9]+ ){1,5}?exception(?: \\d \\d)?)?"
#: What stands before an identifier that is granted.
UNDER = "(?:(?:dual |re|sub)?licen[sc]ed(?: as)?|(?:(?:dual |re|sub)?licen[sc]ed|released|distributed|published|available|redistributed|provided|covered|offered)(?: to you)? under)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: gnu)? "
#: kind; priority; confidence; what stands before a name.
CONTEXTS = """
spdx; 4; 1.0; spdx licen[sc]e identifier\x20
grant; 3; 0.95; (?:dual )?(?:licen[sc]ed|released|distributed|published|available|made available|redistributed|provided|covered|offered)(?: to you)? (?:under|by|with|subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: gnu)?\x20
mention; 2; 0.7;
"""
#: label; priority; confidence; keyword; regex. Notices without a name.
NOTICES = """
spdx; 1; 0.5; spdx; spdx licen[sc]e identifier [a-z0-9]+
copyright; 1; 0.4; copyright; copyright(?: c)? \\d{4}(?: \\d{4})?
reserved; 2; 0.6; all rights reserved; all rights reserved
reserved; 2; 0.6; tous droits; tous droits réservés
reserved; 2; 0.6; alle rechte; alle rechte vorbehalten
reserved; 2; 0.6; derechos reservados; todos los derechos reservados
public-domain; 3; 0.9; public domain; (?:placed|released|dedicated|is|are|works?) (?:in|to|into|in to) the public domain
public-domain; 2; 0.5; public domain; public domain
mit-text; 3; 0.9; permission is hereby granted; permission is hereby granted free of charge to any person obtaining a copy
isc-text; 3; 0.9; permission to use; permission to use copy modify and or distribute this software for any purpose
bsd-text; 3; 0.9; redistribution and use; redistribution and use in source and binary forms(?: with or without modification)?
bsd-text; 1; 0.6; neither the name; neither the name of (?:[^ ]+ ){1,12}?nor the names of its contributors
apache-text; 3; 0.9; you may not use this file; you may not use this file except in compliance with the licen[sc]e
gpl-text; 3; 0.9; free software foundation; as published by the free software foundation
gpl-or-later; 3; 0.9; any later version; (?:either version \\d(?: \\d)? of the licen[sc]e )?or(?: at your option)? any later version
warranty; 1; 0.3; without warrant; without warrant(?:y|ies)(?: or conditions)? of any kind
warranty; 1; 0.3; without any warranty; without any warranty
warranty; 1; 0.3; provided as is; provided as is(?: and)?(?: without)?
proprietary; 2; 0.8; proprietary; proprietary and confidential
proprietary; 2; 0.8; unauthorized; unauthorized (?:copying|use|reproduction|distribution)(?: of this file)?
non-commercial; 2; 0.6; commercial; (?:for )?non ?commercial (?:use|purposes)(?: only)?
no-redistribution; 2; 0.6; may not be; may not be (?:reproduced|redistributed|copied)(?: in any form)?
permission-required; 2; 0.5; permission; without (?:the )?(?:prior )?(?:express )?written permission
license-reference; 1; 0.3; see the licen; see the licen[sc]e(?: file)?(?: for)?
license-reference; 1; 0.3; the licen; (?:in the |the )licen[sc]e file
license-url; 2; 0.8; apache org licenses; (?:https? )?(?:www )?apache org licenses licen[sc]e 2 0
license-url; 2; 0.8; opensource org; (?:https? )?(?:www )?opensource org licenses [a-z0-9]+
license-url; 2; 0.8; gnu org licenses; (?:https? )?(?:www )?gnu org licenses [a-z0-9]+
license-url; 2; 0.8; creativecommons org; (?:https? )?(?:www )?creativecommons org (?:licenses|publicdomain) (?:by|nc|nd|sa|zero|mark|sampling)(?: (?:nc|nd|sa|plus))*(?: \\d \\d)?
license-url; 2; 0.8; mozilla org mpl; (?:https? )?(?:www )?mozilla org mpl
"""


@cache
def rules() -> list[tuple[str, str, int, float, str, re.Pattern]]:
    """(label, kind, priority, confidence, keyword, regex), in the order in which ties are resolved."""
    lines = lambda text: [[c.strip() if i else c.lstrip("\n") for i, c in enumerate(line.split("; "))] for line in text.strip("\n").split("\n")]
    found = []
    for kind, priority, confidence, *before in lines(CONTEXTS.replace("0.7;\n", "0.7; \n")):
        prefix = f"{before[0].strip()} " if before and before[0].strip() else ""
        for label, keyword, name in lines(NAMES):
            found.append((label, kind, int(priority), float(confidence), keyword, prefix + name))
    # identifiers are also names of products and people: a grant says `under` or `licensed`, or has the word license behind them
    spdx, grant = [f"{c[3].strip()} " for c in lines(CONTEXTS.replace("0.7;\n", "0.7; \n"))[:2]]
    every = "|".join(name for _, _, name in lines(IDS))
    for label, keyword, name in lines(IDS):
        found.append((label, "spdx", 4, 1.0, keyword, f"{spdx}{name}{SUFFIX}"))
        found.append((label, "spdx", 4, 1.0, keyword, f"{spdx}(?:(?:{every}){SUFFIX}{EXCEPTION} (?:and|or) )+(?P<id>{name}{SUFFIX})"))
        found.append((label, "grant", 3, 0.95, keyword, f"{UNDER}{name}{SUFFIX}"))
        found.append((label, "grant", 3, 0.95, keyword, f"{grant}{name}{SUFFIX} licen[sc]e"))
    for label, priority, confidence, keyword, pattern in lines(NOTICES):
        found.append((label, "notice", int(priority), float(confidence), keyword, pattern))
    return [(*rest, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")) for *rest, pattern in found]


def automaton(keywords: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for keyword in set(keywords):
        machine.add_word(keyword, keyword)
    machine.make_automaton()
    return machine


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, priority, rule): those that lie in no other of higher priority and in no longer or earlier equal one."""
    kept, reach = [], {}
    for start, end, priority, rule in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if all(e < end for p, e in reach.items() if p >= priority):
            kept.append((start, end, priority, rule))
        reach[priority] = max(reach.get(priority, -1), end)
    return kept


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.by_keyword: dict[str, list[int]] = {}
        for n, rule in enumerate(self.rules):
            self.by_keyword.setdefault(rule[4], []).append(n)
        self.machine = automaton([*self.by_keyword, *BASE])

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, str, float]]]:
        """Number of words; base places (first word, words, label); detections (first word, words, label, kind, confidence)."""
        words = text.encode().translate(WORD_BYTES).split(b" ")
        words = [w for w in words if w]
        line = b" ".join(words).decode()
        present = {keyword for _, keyword in self.machine.iter(line)}
        if not present:
            return len(words), [], []
        starts = WordStarts(line)
        base = []
        for phrase, label in BASE.items():
            if phrase in present:
                for m in re.finditer(rf"(?<![^ ]){phrase}(?![^ ])", line):
                    base.append((starts.index(m.start()), phrase.count(" ") + 1, label))
        matches = []
        for n in sorted({n for k in present for n in self.by_keyword.get(k, ())}):
            priority, pattern = self.rules[n][2], self.rules[n][5]
            part = "id" if "id" in pattern.groupindex else 0  # of an SPDX expression, the identifier itself
            matches += [(m.start(part), m.end(part), priority, n) for m in pattern.finditer(line)]
        found = []
        for start, end, _, n in resolve(matches):
            label, kind, _, confidence = self.rules[n][:4]
            found.append((starts.index(start), line.count(" ", start, end) + 1, label, kind, confidence))
        return len(words), sorted(base), found


class WordStarts:
    """Word number at a place of the joined text; counts blanks on from the nearest place asked before."""

    STEP = 4096

    def __init__(self, line: str):
        self.line, self.counts = line, [0]

    def index(self, at: int) -> int:
        block = at // self.STEP
        while len(self.counts) <= block:
            start = (len(self.counts) - 1) * self.STEP
            self.counts.append(self.counts[-1] + self.line.count(" ", start, start + self.STEP))
        return self.counts[block] + self.line.count(" ", block * self.STEP, at)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base and detections (arrays of places in words) of every row of docs."""
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base_type = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("confidence", pa.float64())]))

    def each(batches):
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t) for t in texts_of(batch.column(1))]
            base = [[dict(zip(("first_word", "n_words", "label"), b, strict=True)) for b in r[1]] for r in rows]
            found = [[dict(zip(("first_word", "n_words", "label", "kind", "confidence"), d, strict=True)) for d in r[2]] for r in rows]
            arrays = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(base, base_type), pa.array(found, found_type)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "base", "detections"])

    schema = (
        f"doc_id {kind}, n_words long, base array<struct<first_word:long,n_words:long,label:string>>, "
        "detections array<struct<first_word:long,n_words:long,label:string,kind:string,confidence:double>>"
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def op8_labels(docs: DataFrame) -> DataFrame:
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, found = F.col("base.label"), F.col("detections.label")
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.first_word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, found)).alias("labels"),
        F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)).alias("score"),
    )
