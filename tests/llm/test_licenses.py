import re

from corpus import odd_rows, prose

from motionloom.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(docs, rows):
    want = sorted(map(repr, ((i, *brute(t)) for i, t in rows)))
    got = licenses.op8_labels(docs).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))


def test_odd_rows(spark):
    texts = ["CC-BY cc by cc", "xcc by", "cc byx", "All rights  reserved. (all)rights!reserved", "the GNU General Public License, version 2", "general general public license license", "cc\n\nby x"]
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + n, t) for n, t in enumerate(texts)] + [(200, prose(1, 9000) + " CC BY " + prose(2, 9000) + " all rights reserved")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def labels(text):
    return [(d[2], d[3]) for d in licenses.Scanner().scan(text)[2]]


def test_rules():
    assert len(licenses.rules()) > 200
    assert "apache-2.0" in [x for x, _ in labels("SPDX-License-Identifier: Apache License 2.0")]
    assert "mit" in [x for x, _ in labels("This is released under the MIT License.")]
    assert [x for x, _ in labels("GNU General Public License version 3")] == ["gpl-3.0"]  # the shorter gpl lies inside
    assert labels("nothing to see here") == []


def test_spdx_tags_short_forms_and_keywords():
    import re

    for line in licenses.IDS.strip().split("\n"):
        label, _, name = line.split("; ")
        real = re.sub(r"\(\?:.*?\)\?", "", name).replace(r"\d", "4").replace("[12]", "2")
        for text in (f"SPDX-License-Identifier: {real.upper().replace(' ', '-')}", f"It is licensed under the {real}", f"SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR {real})"):
            assert label in [x for x, _ in labels(text)], text
    tag = "SPDX-License-Identifier: "
    real = {"MIT": ["mit"], "Apache-2.0": ["apache-2.0"], "GPL-3.0-only": ["gpl-3.0"], "GPL-2.0-or-later": ["gpl-2.0"], "MPL-2.0": ["mpl-2.0"], "LGPL-2.1": ["lgpl-2.1"], "EPL-2.0": ["epl-2.0"], "ISC": ["isc"], "MIT-0": ["mit-0"], "Foo-1.0": ["spdx"]}
    assert {k: [x for x, kind in labels(tag + k) if kind in ("spdx", "notice")] for k in real} == real
    assert {"mit", "apache-2.0"} <= {x for x, _ in labels(tag + "MIT OR Apache-2.0")}
    short = {"GPLv3": "gpl-3.0", "GPL v2": "gpl-2.0", "LGPLv2.1+": "lgpl-2.1", "AGPL-3.0": "agpl-3.0", "the LGPL": "lgpl", "GNU GPL": "gpl", "GNU AGPL": "agpl"}
    assert {k: [x for x, _ in labels(k)] for k in short} == {k: [x] for k, x in short.items()}
    for text, label in (("without warranties of any kind", "warranty"), ("see the licence", "license-reference"), ("in the licence file", "license-reference")):
        assert label in [x for x, _ in labels(text)]


def test_containment_and_priority():
    keep = licenses.resolve([(0, 10, 1, 0), (2, 8, 1, 1), (2, 8, 3, 2), (5, 15, 1, 3), (0, 10, 1, 4), (0, 20, 2, 5)])
    assert keep == [(0, 20, 2, 5), (2, 8, 3, 2)]
    assert licenses.resolve([(0, 10, 1, 0), (5, 15, 1, 3)]) == [(0, 10, 1, 0), (5, 15, 1, 3)]


def brute_labels(text):
    """Labels and score with every rule tried on every text and every detection held against every other."""
    line = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
    found = []
    for n, (label, _, priority, confidence, _, pattern) in enumerate(licenses.rules()):
        part = "id" if "id" in pattern.groupindex else 0
        found += [(m.start(part), m.end(part), priority, n, label, confidence) for m in pattern.finditer(line)]
    above = lambda d, e: e[0] <= d[0] and d[1] <= e[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[1] - e[0] == d[1] - d[0] and e[3] < d[3]))
    kept = [d for d in found if not any(above(d, e) for e in found)]
    base = {label for p, label in PHRASES.items() if f" {' '.join(p)} " in f" {line} "}
    return ",".join(sorted({d[4] for d in kept} | base)), max((d[5] for d in kept), default=0.0)


def test_labels_and_scores_against_brute_force(spark, sf_dir):
    names = [line.split("; ")[2] for line in licenses.NAMES.strip().split("\n")]
    plain = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", x).replace("[sc]", "s").replace(r"\d", "4").replace("?", "") for x in names]
    rows = [(n, f"{prose(n, 12)} licensed under the {x}. {prose(n + 1, 9)} {x} SPDX-License-Identifier: MIT OR {x}") for n, x in enumerate(plain)]
    rows += [(500 + n, t) for n, t in enumerate(("See creativecommons.org/licenses/by for details and the code itself comes under the mit license which is fine. This is apache license code", "creativecommons.org/licenses/by-nc-sa/4.0/ all rights reserved", "neither the name of the Foo Bar Inc nor the names of its contributors", "neither the name of " + prose(1, 90) + " nor the names of its contributors", None, ""))]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.op8_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_labels(t) for i, t in rows}
    assert {"mit", "apache", "license-url"} <= set(got[500][0].split(","))


def test_ordinary_prose_has_no_labels():
    """Names of licenses are also products, people and places."""
    names = ["JSON", "Vim", "Ruby", "MIT", "ISC", "W3C", "OpenSSL", "PostgreSQL", "zlib", "Python 2.0", "PHP 3.01", "NCSA", "X11", "libpng", "Elastic 2.0"]
    frames = ["The data is provided with {} and the editor", "The book was published by {}", "It is available with {}", "offered by {} in 1999", "was released by {}", "covered by {} and others", "They have distributed with {} since May", "licensed by {} staff"]
    for frame in frames:
        for name in names:
            assert labels(frame.format(name)) == [], frame.format(name)
    for text in ("The data is provided with JSON and the editor is distributed with Vim", "a license to drive", "Apache helicopters", "he went to the common and by the river", "permission was denied", "reserved seats for all", "the general public", "copyright law changed", "the public library"):
        assert labels(text) == [], text
    for text, label in (("Licensed MIT", "mit"), ("dual licensed under MIT and others", "mit"), ("released under the terms of the ISC", "isc"), ("provided with Ruby license", "ruby"), ("distributed by the Vim licence", "vim")):
        assert label in [x for x, _ in labels(text)], text
