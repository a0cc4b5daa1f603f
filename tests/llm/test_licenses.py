import re

from docstrata.llm import licenses


def brute(text):
    parts = {*(text or "").split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", text or ""), text or ""}
    out = []
    for part in parts:
        found = licenses.bigram_set(part)
        scores = []
        for name, body in licenses.TEMPLATES:
            other = licenses.bigram_set(body)
            dice = 2 * len(found & other) / ((len(found) + len(other)) or 1)
            numbers = {g for g in other if re.fullmatch(f"({'|'.join(licenses.VERSIONED)}) [0-9]+", g)}
            if dice >= licenses.DICE_LEAST and numbers <= found:
                scores.append((-dice, name))
        if scores:
            out.append(min(scores))
    return sorted(out)


def test_against_all_templates(spark):
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    full = next(body for name, body in licenses.TEMPLATES if name == "MIT")
    texts = [
        None, "", "\n \n", "x", mit, full, f"intro\n\n{full}\n\nmore text", full.replace("Software", "Program", 2), full.upper(),
        "Some words\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "released under the MIT licence", "é" * 200_000,
        " ".join(f"w{i}" for i in range(30_000)), *[body for _, body in licenses.TEMPLATES],
    ]
    frame = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        assert sorted((-round(m.dice, 9), m.license) for m in got[i].matches) == [(round(d, 9), n) for d, n in want], i
        assert (got[i].license, got[i].licenses) == (want[0][1] if want else None, sorted({n for _, n in want}))
    assert got[5].license == "MIT" and got[6].license == "MIT" and got[8].license == "MIT" and got[0].license is None
    assert licenses.scan_licenses(frame.where("false")).count() == 0
    assert licenses.scan_licenses(frame, templates=()).where("license is not null").count() == 0


def test_common_forms_and_versions(spark):
    """The usual notices are found; licences of another version are not taken for this one."""
    notice = licenses._GPL3
    texts = {
        "Licensed under the MIT License.": "MIT", "Licensed under the Apache License 2.0": "Apache-2.0", "MIT License": "MIT",
        "// SPDX-License-Identifier: MIT": "MIT", " * SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", notice: "GPL-3.0",
        notice.replace("version 3", "version 2"): "GPL-2.0", notice.replace("version 3", "version 1"): None,
        notice.replace("General Public", "Affero General Public"): "AGPL-3.0", licenses._LGPL21: "LGPL-2.1", "Licensed under CC BY 3.0.": None,
        licenses._MIT_WHOLE: "MIT", "a line about the MIT campus": None, "SPDX-License-Identifier: X11": None,
    }
    frame = spark.createDataFrame([(t,) for t in [*texts, *texts]], "text string")
    got = licenses.scan_licenses(frame, id_col="text").collect()
    assert len(got) == 2 * len(texts)  # repeated rows give a row each
    assert {r.doc_id: r.license for r in got} == texts
