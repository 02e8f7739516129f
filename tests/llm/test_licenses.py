"""Licence texts wrapped at any width, under any title; digests of long texts."""

import os
import re
import textwrap

import pytest

from quillstone.llm import license_texts, licenses

COMMON = "/usr/share/common-licenses"


def ids(spark, texts):
    return {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()}


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in text.split("\n\n"))


def test_whole_texts_are_found_at_every_width(spark):
    for name, whole, titles in license_texts._WHOLE:
        texts = [f"{title}\n\nCopyright (c) 2019 A. Holder\n\n{wrapped(whole, w)}\n" for w in range(50, 121) for title in ("", *titles)]
        assert set(ids(spark, texts).values()) == {name}


def test_copyright_lines(spark):
    mit = license_texts._MIT
    heads = ["Copyright 2001 X", "copyright (c) X Y Z", "© X", "Copyright X and Y", "(C) 1999-2003 X. All rights reserved.", "Copyright (c) <year> <holder>\nCopyright (c) 2004 other"]
    assert set(ids(spark, [f"MIT License\n\n{h}\n\n{mit}" for h in heads]).values()) == {"MIT"}
    assert set(ids(spark, [mit.replace("The above copyright notice", "Copyright is"), mit + " Copyright"]).values()) == {None}


def test_notices_and_long_texts(spark):
    rows = [(1, "x\n" * 300_000 + "SPDX-License-Identifier: BSD-3-Clause\n"), (1, "Licensed under CC BY-SA 4.0"), (None, "SPDX-License-Identifier: MPL-2.0")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.notice_ids) for r in got) == [(0, "MPL-2.0"), (1, "BSD-3-Clause,CC-BY-SA-4.0"), (1, "BSD-3-Clause,CC-BY-SA-4.0")]


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="the texts are not here")
def test_digests_are_those_of_the_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
    texts = [open(f"{COMMON}/{f}", encoding="utf-8").read() for f in files]
    assert list(ids(spark, texts).values()) == list(files.values())
    joined = [re.sub(r"(?<=[a-z,])\n[ \t]*(?=[a-z])", " ", t) for t in texts]
    assert list(ids(spark, joined).values()) == list(files.values())
