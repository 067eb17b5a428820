"""License scans against brute force and on edge cases."""

import re

from mercato.llm.license_scan import PHRASES, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places = []
    for label, phrase in PHRASES:
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(want)] == want]
    return (len(words), len(places), min(places)[0] if places else None,
            max(places)[0] if places else None, ",".join(sorted({p[1] for p in places})))


TEXTS = [
    (1, "Under the MIT License."), (2, "mit-license mit  LICENSE"), (3, ""), (4, None),
    (5, "GNU General Public License, or Apache License; general public license"),
    (6, "general public general public license"), (7, "mit"), (8, "license mit"),
    (9, "Licensed under the (new) Apache License, Version 2.0"), (10, "Licensed under CC BY-NC 4.0."),
    (11, "émit license mit élicense"), (12, "MİT License"), (13, "mit license " * 3000),
    (None, "The MIT license"), (14, "same mit license"), (14, "same mit license"),
    (15, "Permission is hereby granted free of all charge to any person who obtains a copy"),
]


def table(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, labels string")


def test_places_equal_brute_force(spark):
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels)
                 for r in scan(table(spark)).collect())
    want = sorted((str(i), b[0], b[1], str(b[2]), str(b[3]), b[4]) for i, b in
                  ((i, brute(t)) for i, t in TEXTS))
    assert got == want


def test_statements_and_scores(spark):
    rows = {r.doc_id: r for r in scan(table(spark)).collect()}
    assert rows[9].labels == "apache,apache-2.0"
    assert rows[10].labels == "cc-by-nc-4.0" and rows[10].base_labels == "" and rows[10].score == 1.0
    assert rows[3].labels == "" and rows[3].score == 0.0
    assert 0.3 < rows[15].score < 1.0


def test_empty_table_and_plan(spark):
    assert scan(table(spark).limit(0)).count() == 0
    plan = scan(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
