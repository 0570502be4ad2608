import random
import textwrap

import pytest

from snapdelta.llm import license_scan as L
from tests.llm.conftest import prose


@pytest.mark.parametrize(("name", "text"), L.TEMPLATES)
def test_each_template_is_found(name, text):
    for block in (text, text.upper(), f"Copyright 2020 Someone. {text} And more words after it.", text.replace(" ", "  ")):
        found = L.scanner().scan(block)
        assert found and found.license == name and found.changes == 0, (block, found)


@pytest.mark.parametrize("text", ["Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC 3.0.", "This is not licensed at all.", "A driver's licence is needed.", "copyright 2020", "Released under the MID License.",
                                  "Not released under the MIT License.", "This is not Released under the MIT License.", "It isn't licensed under the ISC License.", "This work is not yet licensed under the GNU General Public License, version 3.", "Never distributed under the zlib License"])
def test_other_wordings(text):
    assert L.scanner().scan(text) is None


@pytest.mark.parametrize(("text", "want"), [
    ("Do not worry. Released under the MIT License.", ["MIT"]), ("Licensed under the MIT License.", ["MIT"]), ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("SPDX-License-Identifier: LGPL-2.1-or-later", ["LGPL-2.1-or-later"]),
    ("This work is licensed under the GNU General Public License, version 2 or later.", ["GPL-2.0-or-later"]), ("Released under the GNU General Public License, version 3, or (at your option) any later version.", ["GPL-3.0-or-later"]),
    ("Licensed under the MIT License or later talks.", ["MIT"]), ("Not released under the MIT License. Released under the ISC License.", ["ISC"]),
])
def test_denials_and_later_versions(text, want):
    assert sorted(m.license for m in L.scanner().matches(text)[1]) == want


def test_small_changes_count():
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and t.startswith("Permission is hereby"))
    found = L.scanner().scan(mit.replace("charge, to any", "charge, for any"))
    assert found.license == "MIT" and found.changes == 1
    assert L.scanner().scan(" ".join(mit.split()[::2])) is None


def test_notices_beside_other_legal_phrases():
    """The verbatim notice isn't among the four templates that save most."""
    phrases = [t for _, t in L.TEMPLATES if len(t) > 70]
    for notice, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY 4.0.", "CC-BY-4.0")):
        for k in range(0, len(phrases), 2):
            beside = " ".join(" ".join(phrases[(k + i) % len(phrases)].split()[3:9]) for i in range(5))
            found = L.scanner().scan(f"{beside} {notice}")
            assert found and found.license == name, (beside, found)


@pytest.mark.parametrize("length", [0, 301])
def test_every_notice_of_a_line_counts(spark, length):
    text = "Released under the MIT License. Licensed under the Apache License, Version 2.0.".ljust(length, "x")
    got = L.scan(spark.createDataFrame([(1, text), (2, text + " " + text)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_confirmed, r.licenses) for r in got] == [(2, "Apache-2.0,MIT"), (4, "Apache-2.0,MIT")]


def test_stretches_equal_brute_force():
    """Costs by a plain table; telling words never change."""
    rng, tool = random.Random(5), L.scanner()
    for _ in range(60):
        template = rng.choices("a b c d e f g h mit 2".split(), k=rng.choice([10, 20]))
        block = [w for w in template if rng.random() > 0.05]
        block = rng.choices("a b c x mit".split(), k=5) + [rng.choice("abxy") if rng.random() < 0.05 else w for w in block] + rng.choices("a b c x".split(), k=5)
        best, price = None, lambda w: 1000 if L.telling(w) else 1
        row = [0] * (len(block) + 1)
        for t in template:
            now = [row[0] + price(t)]
            for j, w in enumerate(block):
                now.append(min(row[j] + (0 if t == w else max(price(t), price(w))), row[j + 1] + price(t), now[j] + price(w)))
            row = now
        best = min(row)
        found = tool.stretches(template, block)
        assert (min(found)[0] == best) if best <= len(template) // 10 else not found


def test_wrapped_notices(spark):
    rows = []
    for name, text in L.TEMPLATES:
        for width in (40, 60, 80):
            for prefix in ("", "# ", " * "):
                lines = [prefix + x for x in textwrap.wrap(f"Some words go here before it. {text}", width)]
                rows.append((len(rows), "\n".join([prose(300, 1), *lines, prose(300, 2)]), name))
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, want string").select("doc_id", "text")).collect()
    assert {r.doc_id: (r.n_confirmed, r.licenses, r.changes) for r in got} == {i: (1, name, 0) for i, _, name in rows}


def test_scan(spark):
    own = [
        (1, prose(200, 1) + "\nReleased under the MIT License.\n" + prose(100, 2)), (2, prose(100, 3)), (3, None), (4, ""),
        (5, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0."), (6, "x" * 400 + ". Licensed under the Apache License, Version 2.0. Then " + "y " * 300), (6, "x"), (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, "z") for r in own], "doc_id long, text string, licenses string")
    got = sorted(((r.doc_id or 0, r.n_blocks, r.n_confirmed, r.licenses) for r in L.scan(df).collect()))
    assert got == [(0, 1, 1, "MIT"), (1, 1, 1, "MIT"), (2, 0, 0, ""), (3, 0, 0, ""), (4, 0, 0, ""), (5, 2, 2, "CC-BY-4.0,CC-BY-NC-4.0"), (6, 0, 0, ""), (6, 1, 1, "Apache-2.0")]
    assert L.scan(df.limit(0)).count() == 0


def test_whole_table_equals_a_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.licenses for r in L.scan(docs).collect()}
    # by brute force over all templates: the words of each, one after the other, anywhere in the text
    known = [(n, f" {' '.join(L.words(t))} ") for n, t in L.TEMPLATES]
    found = 0
    for r in docs.collect():
        text = f" {' '.join(L.words(r.text))} "
        want = {n for n, t in known if t in text}
        assert got[r.doc_id] == ",".join(sorted(want)), r.doc_id
        found += bool(want)
    assert found > 20
