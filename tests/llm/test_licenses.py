import re

from evalspark.llm import licenses

LINES = re.compile(r"Released under the MIT License|Licensed under CC BY-NC 4\.0|Licensed under the Apache License, Version 2\.0|"
                   r"This work is licensed under the GNU General Public License, version 3")


def test_every_notice_of_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet")
    want = sorted((r["doc_id"], m.start(), m.end()) for r in docs.collect() for m in LINES.finditer(r["text"] or ""))
    found = licenses.scan(docs).collect()
    assert want and sorted((r["doc_id"], r["start"], r["end"]) for r in found) == want
    assert all(r["differing_words"] == 0 and r["saved_bytes"] > 0 for r in found)


def names(text):
    return [(name, differing) for name, _, _, _, differing in licenses.Scanner().findings(text.encode())]


def test_wording():
    assert names("Released under the BSD License. x") == [("BSD-3-Clause", 0)]
    assert names("é released under MIT license ok") == [("MIT", 1)]
    assert names("Licensed under the Apache License, Version 1.1.") == []
    assert names("Licensed\nunder   CC BY-NC 4.0. and  licensed under CC BY 4.0") == [("CC-BY-NC-4.0", 0), ("CC-BY-4.0", 0)]
    assert names("a license to kill, licence fees, public domain") == []
    grant = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    words = grant.split()
    assert names("intro " * 300 + " ".join(words[:10] + ["really"] + words[11:20] + words[21:]) + " outro" * 300) == [("MIT", 2)]
    for name, text in licenses.TEMPLATES:
        assert names("x y " + text.replace("{", "").replace("}", "") + " z")[0] == (name, 0)


def test_repeated_notices_are_all_found():
    header = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and "modify" in t).replace("{", "").replace("}", "")
    changed = header.replace("can redistribute", "can distribute")
    for first, second, want in ((header, header, [0, 0]), (changed, header, [1, 0]), (header, changed, [0, 1])):
        text = f"a b {first} c d {second} e f"
        found = licenses.Scanner().findings(text.encode())
        assert [(name, differing) for name, *_, differing in found] == [("GPL-3.0", n) for n in want]
        assert [start for _, start, *_ in found] == [4, text.index(second, 6 + len(first))]
    for count in (2, 3, 7, 40):
        assert names("x Released under the MIT License. y " * count) == [("MIT", 0)] * count
    mixed = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0."]
    assert names(" or ".join(mixed * 5)) == [("MIT", 0), ("CC-BY-4.0", 0), ("Apache-2.0", 0)] * 5


GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as "
       "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
CONDITIONS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
              "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
              "the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of "
              "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n")
THIRD = ("3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this "
         "software without specific prior written permission.\n")
DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def test_like_texts_of_other_licenses():
    for word, want in (("General", "GPL-3.0"), ("Affero General", "AGPL-3.0"), ("Lesser General", "LGPL-3.0")):
        assert names(GPL.format(word)) == [(want, 0)]
    assert names(GPL.format("Foreign General")) == []
    assert names("Licensed under CC BY NC 4.0.") == []
    assert [n for n, _ in names(CONDITIONS + DISCLAIMER)] == ["BSD-2-Clause"]
    assert [n for n, _ in names(CONDITIONS + THIRD.format("the copyright holder") + DISCLAIMER)] == ["BSD-3-Clause"]
    assert [n for n, _ in names(CONDITIONS + THIRD.format("Example Inc.") + DISCLAIMER)] == ["BSD-3-Clause"]
    assert [n for n, _ in names(CONDITIONS.split("1.")[0] + "be nice")] == ["BSD-2-Clause OR BSD-3-Clause OR BSD-4-Clause"]
    advertising = ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
                   "This product includes software developed by the University and its contributors.\n")
    assert [n for n, _ in names(CONDITIONS + advertising + THIRD.replace("3", "4").format("the University") + DISCLAIMER)] == [
        "BSD-2-Clause OR BSD-3-Clause OR BSD-4-Clause"]  # the opening is all that is known of it
    assert names("Released under the BSD 2-Clause License.") == [("BSD-2-Clause", 0)]
    assert names(FEE + ", provided that the above copyright notice and this permission notice appear in all copies.") == [("ISC", 0)]
    assert names(FEE + '. THE SOFTWARE IS PROVIDED "AS IS" AND') == [("0BSD", 0)]


def test_stretch_is_the_nearest():
    template = licenses.Template("x", tuple(b"a b c d e f g h i j k l m n o p q r s t".split()), frozenset({3}), b"")
    assert licenses.best_stretch(template, b"z a b c d e f g h i j k l m n o p q r s t z".split()) == (0, 1, 20)
    assert licenses.best_stretch(template, b"a b c d e f g X h i j k l m n o p q r t".split()) == (2, 0, 19)
    assert licenses.best_stretch(template, b"a b c X e f g h i j k l m n o p q r s t".split()) is None


def test_odd_rows(odd_documents, no_documents):
    assert licenses.scan(odd_documents).count() == 0 and licenses.scan(no_documents).count() == 0
