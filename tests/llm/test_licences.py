import textwrap

import pytest

from evalspark.llm import licences as lic

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
       "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
       "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
       "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
       "the Software.\n\n")
AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
         "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")


def scan(spark, texts, **options):
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, sequence string")
    return {r["doc_id"]: r for r in lic.scan(rows, **options).collect()}


def test_sentences_and_rules(spark):
    got = scan(spark, [
        "Some prose.\nReleased under the MIT License.\nMore.", f"Title\n{MIT}{AS_IS}", MIT, AS_IS,
        "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0! Licensed under CC BY 4.0\n",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the MIT License. Released under the MIT License."])
    assert [got[i]["licences"] for i in range(7)] == ["MIT", "MIT", "MIT", "", "Apache-2.0,CC-BY-NC-4.0,CC-BY-4.0", "GPL-3.0-only", "MIT"]
    assert got[1]["sequence"] == "<?><mit-grant><mit-notice><as-is>" and got[1]["n_unmatched"] == 0
    assert got[3]["n_known"] == 1 and got[3]["n_unmatched"] == 1


def test_rules_are_ordered_and_take_what_they_match(spark):
    known, rules = {"a": "a", "b": "b"}, [("both", ["a", "b"]), ("first", ["a"])]
    got = scan(spark, ["a. b.", "a. x. b.", "b. a.", "a. b. a."], known=known, rules=rules)
    assert [got[i]["licences"] for i in range(4)] == ["both", "first", "first", "both,first"]


def test_awkward_rows(awkward):
    got = lic.scan(awkward).collect()
    assert len(got) == awkward.count() and all(r["licences"] == "" and r["n_known"] == 0 for r in got)
    at = {r["doc_id"]: r["n_sentences"] for r in got}
    assert at[0] == at[1] == at[2] == 0 and at[3] == 1


def test_empty_table(nothing):
    assert lic.scan(nothing).collect() == []


BSD_2 = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
         "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
         "the following disclaimer in the documentation and/or other materials provided with the distribution.")
NOTICES = [
    ("MIT", MIT + AS_IS), ("MIT", MIT), ("MIT", MIT.split("\n\n")[0]), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
            "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                         "or (at your option) any later version.\n\nThis program is distributed in the hope that it will be "
                         "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR "
                         "A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation; either version 3 of the License, "
                         "or (at your option) any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                         "or (at your option) any later version.\n\nThis program is distributed in the hope that it will be "
                         "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR "
                         "A PARTICULAR PURPOSE.  See the GNU General Public License for more details."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                          "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                          "License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                          "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                          "License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                          "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                          "License, or (at your option) any later version."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                     "Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                     "Public License as published by the Free Software Foundation, version 3 of the License."),
    ("LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-only"), ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0+"),
    ("Apache-2.0", "Apache License\n\nVersion 2.0, January 2004".replace("\n\n", " ")),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:\n\n" + BSD_2 + "\n\n3. Neither the name of the copyright holder nor "
                     "the names of its contributors may be used to endorse or promote products derived from this software without "
                     "specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:\n\n" + BSD_2),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
             "it and redistribute it freely, subject to the following restrictions:"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.")]
GENERATED = [(name, text) for ids, texts in lic._MORE.items() for name, rule in [next(r for r in lic.RULES if r[1] == [ids])]
             for text in {texts[0], texts[-1]}]
GENERATED = [(name, text.replace("{what}", "program")) for name, text in GENERATED]


def test_every_rule_finds_its_original_notice(spark):
    assert {name for name, _ in NOTICES + GENERATED} == {name for name, _ in lic.RULES}
    got = scan(spark, [f"Some prose.\n\n{text}\n\nMore prose." for _, text in NOTICES])
    assert [got[i]["licences"] for i in range(len(NOTICES))] == [name for name, _ in NOTICES]
    known = [got[i]["n_unmatched"] for i in range(len(NOTICES))]
    assert not any(known) and got[8]["sequence"] == "<?><gpl-free><gpl-hope><?>"


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_generated_notices(spark, mark):
    for width in (72, 40, 300):
        texts = ["\n".join(mark + line for line in ["Copyright 2020 Somebody", "", *textwrap.wrap(text, width), "int main() {"])
                 for _, text in GENERATED]
        got = scan(spark, texts)
        assert [got[i]["licences"] for i in range(len(texts))] == [name for name, _ in GENERATED]


def test_oracle_on_one_line_notices(spark):
    """Each notice of one line, between other lines and alone, by SQL too."""
    import duckdb
    import pandas as pd
    texts = [x for _, t in NOTICES + GENERATED for x in (t, f"Some prose.\n{t}\nMore prose.", f"Not {t}") if "\n\n" not in t]
    documents = pd.DataFrame({"doc_id": range(len(texts) + 2), "text": [*texts, None, ""]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = {r[0]: r for r in con.sql(lic.ORACLE["op7_licence_scan"]).fetchall()}
    rows = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in lic.scan(rows).collect()}
    assert got == want and len(got) == len(texts) + 2


def test_runs_of_lines_at_their_first_and_longest(spark):
    known = {"ab": "a b", "abc": "a b c", "bc": "b c", "xy": ["x\fy"], "x": "q x"}
    got = scan(spark, ["a\nb\nc", "a\nb\nd", "z\na b\nc\nb c\nz", "x. y. y. x", "a b c d", "a\nb c. x: y", "q\nx\ny"],
               known=known, rules=[])
    assert [got[i]["sequence"] for i in range(7)] == ["<abc>", "<ab><?>", "<?><abc><bc><?>", "<xy><?>", "<?>", "<abc><xy>", "<x><?>"]


def test_long_text_of_many_lines(spark):
    got = scan(spark, ["just a line\n" * 50_000 + "Licensed under the MIT License\n" * 200 + "word " * 200_000])
    assert got[0]["licences"] == "MIT" and got[0]["n_known"] == 200


def test_long_text_of_many_sentences(spark):
    got = scan(spark, ["One sentence. Mit. " * 60_000 + "Licensed under the MIT License. " * 200])
    assert got[0]["licences"] == "MIT" and got[0]["n_known"] == 200 and got[0]["sequence"].startswith("<?><mit-licensed>")


def test_pieces_of_a_sentence_alone_are_unknown(spark):
    got = scan(spark, ["This program is free software. 2.0.", "Mozilla Public License, v. 2.0", "2.0\nwithout even the implied"])
    assert all(r["n_known"] == 0 and r["licences"] == "" for r in got.values())


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; ", "! ", "-- ", "dnl ", "REM ", ".\\\" ", "    "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_notices(spark, mark, end):
    texts = []
    for width in (72, 40):
        for _, text in NOTICES:
            lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""]]
            texts.append(end.join((mark + line).rstrip() for line in ["Copyright 2020 Somebody", *lines, "int main() {"]))
    got = scan(spark, texts)
    assert [got[i]["licences"] for i in range(len(texts))] == 2 * [name for name, _ in NOTICES]


def test_lines_and_paragraphs(spark):
    got = scan(spark, [
        "Some heading\nReleased under the MIT License\nmore words", "Released under\n\nthe MIT License", "Released under\nthe MIT License too",
        "Not released under\nthe MIT License", "All rights\nreserved\nLicensed under CC\nBY 4.0", "Licensed under the Apache License, Version 2.0\n"
        "(the \"License\");", "/*\n * Licensed under the MIT\n * License.   */\nReleased under. The MIT License"])
    assert [got[i]["licences"] for i in range(7)] == ["MIT", "", "", "", "CC-BY-4.0", "Apache-2.0", "MIT"]
    assert [got[i]["n_sentences"] for i in range(7)] == [3, 2, 2, 2, 4, 2, 4]
    assert got[4]["sequence"] == "<all-rights><cc-by>" and got[0]["sequence"] == "<?><mit-released><?>" and got[5]["sequence"] == "<apache-2-the>"
