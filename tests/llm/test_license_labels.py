"""Notices of one license against all other labels, and notices with long insertions."""

import random
import time

from helpers import stored

from claimsweep.llm import licenses


def test_each_notice_names_its_own_license_only(spark, tmp_path):
    notices = [(label, text) for label in sorted(licenses.TEMPLATES) for text in licenses.TEMPLATES[label]]
    notices += [("", "This work is licensed under the terms of its owner, all rights reserved."), ("mit", "This work is licensed under the MIT License."),
                ("apache", "This work is licensed under the Apache License, Version 2.0."),
                ("", "This work is licensed under the European Union Public Licence.")]
    docs = stored(spark, [(i, text) for i, (_, text) in enumerate(notices)], tmp_path / "d")
    got = {r["doc_id"]: r for r in licenses.scan(docs)[0].collect()}
    # a phrase of the base scan brings its own label: "cc by" stands in the short forms of all variants
    expected = [",".join(sorted({label, "cc-by"} if "CC BY" in text else {label})) for label, text in notices]
    assert [got[i]["labels"] for i in range(len(notices))] == expected
    assert got[len(notices) - 1]["score"] == 0 and got[len(notices) - 4]["score"] == 0


def test_variants_and_their_relatives(spark, tmp_path):
    cc = "This work is licensed under the Creative Commons Attribution{} 4.0 International License."
    texts = [(cc.format(x), y) for x, y in (("", "cc-by"), ("-ShareAlike", "cc-by-sa"), ("-NonCommercial", "cc-by-nc"), ("-NoDerivatives", "cc-by-nd"),
                                            ("-NonCommercial-ShareAlike", "cc-by-nc-sa"), ("-NonCommercial-NoDerivatives", "cc-by-nc-nd"))]
    texts += [("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa"), ("Mozilla Public License", ""), (cc.format("-Something"), "")]
    docs = stored(spark, [(i, t) for i, (t, _) in enumerate(texts)], tmp_path / "d")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs)[0].collect()}
    assert [got[i] for i in range(len(texts))] == [y for _, y in texts]


def test_time_is_linear_in_the_length_of_a_text(spark, tmp_path):
    took = []
    for n in (80_000, 160_000, 320_000):
        r = random.Random(n)
        text = " ".join(f"w{r.randrange(5000)}" for _ in range(n)) + " " + licenses.TEMPLATES["mit"][0]
        docs = stored(spark, [(1, text)], tmp_path / str(n))
        started = time.perf_counter()
        assert licenses.scan(docs)[0].first()["labels"] == "mit"
        took.append(time.perf_counter() - started)
    assert took[2] < 3 * took[1] + 2


def test_notices_with_long_insertions(spark, tmp_path):
    words = licenses.TEMPLATES["mit"][0].split()
    third = len(words) // 3
    filler = " ".join(f"added{i}" for i in range(12))
    parts = [" ".join(words[:third]), " ".join(words[third:2 * third]), " ".join(words[2 * third:])]
    far = " ".join(f"far{i}" for i in range(300))
    docs = stored(spark, [(1, f" {filler} ".join(parts)), (2, f" {far} ".join(parts)), (3, " ".join(words + words)), (4, parts[0])], tmp_path / "d")
    out, spans = licenses.scan(docs)
    got = {r["doc_id"]: r["labels"] for r in out.collect()}
    assert got == {1: "mit", 2: "", 3: "mit", 4: ""}
    found = spans.collect()
    assert [r["cover"] for r in found if r["doc_id"] == 1] == [1.0]
    assert [r["cover"] for r in found if r["doc_id"] == 3] == [1.0, 1.0]
