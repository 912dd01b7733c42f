import re

import pytest

from plumbline.llm import license_scan


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, family string, probability double")


def test_every_template_has_an_anchor_or_a_shared_line():
    missing = [t for ts in license_scan.TEMPLATES.values() for t in ts if not re.search(license_scan.ANCHORS, t, re.I)]
    assert all(not re.search("licens", t, re.I) for t in missing)


def test_templates_are_named_and_lookalikes_are_not(spark):
    templates = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts if re.search(license_scan.ANCHORS, t, re.I)]
    rows = [(k, f"First line.\n{t}\nLast line.") for k, (_, t) in enumerate(templates)]
    rows += [(1000 + k, t) for k, t in enumerate(license_scan.LOOKALIKES)]
    got = {r.doc_id: r for r in license_scan.licenses(frame(spark, rows)).collect()}
    right = sum(k in got and got[k].family == f and got[k].paragraph == 1 for k, (f, _) in enumerate(templates))
    assert right >= 0.95 * len(templates)
    assert not [k for k in got if k >= 1000]


def brute(lines):
    """The same decision in plain Python."""
    import numpy as np

    model, out = license_scan.trained(), {}
    place = {g: k for k, g in enumerate(model.vocabulary)}
    for line in lines:
        words = license_scan.words_of(line)
        z = model.base + sum((model.weights[place[g]] for g in license_scan.ngrams_of(words) if g in place), np.zeros(len(model.base)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = max(range(1, len(p)), key=lambda k: (p[k], model.families[k]))
        pairs = {f"{a} {b}" for a, b in zip(words, words[1:])} or set(words)
        part = 0
        for t in license_scan.TEMPLATES[model.families[best]]:
            w = license_scan.words_of(t)
            grams = {f"{a} {b}" for a, b in zip(w, w[1:])} or set(w)
            part = max(part, len(grams & pairs) / len(grams))
        if p[best] >= model.threshold and p[best] > p[0] and part >= 0.6 and re.search(license_scan.ANCHORS, line, re.I):
            out[line] = (model.families[best], round(float(p[best]), 6), round(part, 6))
    return out


def test_equals_plain_python_on_lines_of_all_kinds(spark):
    lines = [t for ts in license_scan.TEMPLATES.values() for t in ts] + license_scan.LOOKALIKES
    lines += [" ".join(t.split()[:6]) for t in lines] + ["// " + t.upper() for t in lines] + ["license", "", "Lizenz: CC BY 4.0 é"]
    want = brute(set(lines))
    got = {r.line: (r.family, r.probability, r.similarity) for r in license_scan.licenses(frame(spark, list(enumerate(lines)))).collect()}
    assert got.keys() == want.keys()
    for line, (family, p, s) in want.items():
        assert got[line][0] == family and got[line][1] == pytest.approx(p, abs=2e-6) and got[line][2] == pytest.approx(s, abs=2e-6)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "a\nReleased under the MIT License.\nReleased under the MIT License.")]
    rows += [(4, "word " * 50000 + "\nAll rights reserved.")] * 2
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in license_scan.licenses(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 0, "MIT"), (3, 1, "MIT"), (3, 2, "MIT"), (4, 1, "Proprietary"), (4, 1, "Proprietary")], key=str)
    assert license_scan.licenses(frame(spark, [])).collect() == []


def test_plan_is_native(spark):
    plan = license_scan.paragraphs(frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_wrapped_notices_are_joined(spark):
    import textwrap

    notices = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts]
    rows, want = [], set()
    for k, (family, notice) in enumerate(notices):
        for width, (before, leader, after) in enumerate((("", "", ""), ("/*\n", " * ", "\n */"), ("Some words of prose.\n", "# ", "\nOther words of prose."), ("rem\n", "rem ", "\n"))):
            wrapped = textwrap.wrap(notice, (70, 40, 25, 12)[width], break_long_words=False, break_on_hyphens=False)
            rows.append((10 * k + width, before + "\n".join(leader + w for w in wrapped) + after))
            want.add((10 * k + width, family))
    got = {(r.doc_id, r.family) for r in license_scan.licenses(frame(spark, rows)).collect()}
    named = {(10 * k + w, f) for k, (f, n) in enumerate(notices) if n in brute([n]) for w in range(4)}
    assert len(named) >= 0.95 * len(want) and got >= named


def test_wrapped_notices_of_one_paragraph_and_blank_lines(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"
    rows = [(1, f"Prose.\n{gpl}\n{bsd}\nProse."), (2, bsd.replace("\n", "\n//\n")), (3, f"{bsd}\n\n{bsd}"), (None, gpl)]
    got = sorted(((r.doc_id, r.paragraph, r.family, r.similarity) for r in license_scan.licenses(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, "GPL-3.0", 1.0), (1, 4, "BSD", 1.0), (3, 0, "BSD", 1.0), (3, 4, "BSD", 1.0), (None, 0, "GPL-3.0", 1.0)], key=str)


def test_signs_leave_too_little_of_every_template():
    found = set(license_scan.signs(0.6))
    for _, grams in license_scan.template_grams():
        assert sum(not found & set(g.split()) for g in grams) / len(grams) < 0.6
