"""License notices that stand in lists, and texts of one license one after the other."""

import pytest
from rows import prose

from tidebook.llm import licenses
from tidebook.llm.license_texts import TEMPLATES

MADE = [licenses.Template(*t) for t in TEMPLATES]


@pytest.mark.parametrize("copies", [1, 2, 3, 10])
@pytest.mark.parametrize("license_,text", TEMPLATES)
def test_every_copy_is_found(license_, text, copies):
    for said in (text, f"foo {text}"):
        whole = "\n".join([said] * copies)
        found = licenses.scan(whole, MADE)
        assert [f[:2] for f in found] == [(license_, 1.0)] * copies
        assert [f[2] for f in found] == [k * (len(said) + 1) + len(said) - len(text) for k in range(copies)]


@pytest.mark.parametrize("copies", [3, 10])
@pytest.mark.parametrize("k", [k for k, (_, t) in enumerate(TEMPLATES) if len(t) > 300])
def test_every_changed_copy_is_found(k, copies):
    license_, text = TEMPLATES[k]
    words = text.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 12 != 5 and i + 1 < len(words))
    whole = "\n".join([changed] * copies)
    found = licenses.scan(whole, MADE)
    assert [f[0] for f in found] == [license_] * copies
    assert [f[2] // (len(changed) + 1) for f in found] == list(range(copies))


def test_lists_of_several_licenses():
    notices = ["MIT License", "Apache License, Version 2.0", "BSD 3-Clause License", "MIT License"] * 5
    text = prose(1) + "\n" + "\n".join(f"part{i} Licensed under the {n}" for i, n in enumerate(notices)) + "\n" + prose(2)
    assert [f[0] for f in licenses.scan(text, MADE)] == ["MIT", "Apache-2.0", "BSD-3-Clause", "MIT"] * 5
