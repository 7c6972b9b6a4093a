"""Notices and sentences written apart from the operator's templates."""

import textwrap

import pytest

from tidegrid.llm import license_scan

NOTICES = [
    ("This file is distributed under the Apache License, Version 2.0; see LICENSE for the full text.", "apache-2.0"),
    ("Our code is released under the Apache 2.0 license", "apache-2.0"),
    ("The source is MIT licensed", "mit"),
    ("License: MIT", "mit"),
    ("You can use it under the terms of the MIT license, see COPYING.", "mit"),
    ("GPLv3", "gpl-3.0"),
    ("This package is free software under the GNU General Public License version 3 or any later version", "gpl-3.0"),
    ("The library is covered by the GNU Lesser General Public License, version 2.1", "lgpl"),
    ("Server code: GNU Affero General Public License version 3", "agpl-3.0"),
    ("3-clause BSD license", "bsd"),
    ("Redistribution and use in source and binary forms are permitted provided that the copyright notice is retained", "bsd"),
    ("Mozilla Public License Version 2.0", "mpl-2.0"),
    ("The contents of this file are subject to the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("Photos: CC BY-NC 4.0", "cc-by-nc"),
    ("The text is available under the Creative Commons Attribution-NonCommercial 4.0 licence", "cc-by-nc"),
    ("Except where noted, content is licensed under a Creative Commons Attribution 4.0 International licence", "cc-by"),
    ("The author has released this work into the public domain.", "public-domain"),
    ("CC0 1.0 Universal", "public-domain"),
]
SENTENCES = [
    "You may obtain a copy of the report at http://www.example.com/report",
    "The permission of the owner was obtained in writing before the road was built.",
    "General public transport is free of charge on Sundays in this town.",
    "The licence of the pub was not renewed after the war.",
    "Mozilla and Apache were names of peoples before they were names of programs.",
    "Version 2.0 of the timetable is out, you can find it at the station.",
    "The above recipe and this photo shall be on all pages of the book.",
    "Without warranties of any kind he sold the car and left the country.",
    "Creative people have common sense, an old teacher said.",
    "The work of the house is done by the people who live in it.",
    "Use of the sauna is governed by the rules on the wall.",
    "She was granted a degree free of charge by the university.",
    "The software of the ticket machine was released too early, the paper wrote.",
    "All persons are to leave the building in case of fire.",
]


@pytest.fixture(scope="module")
def model():
    return license_scan.trained()


def test_families(model):
    wrong = [(t, k, [f[1] for f in license_scan.findings(t, model)]) for t, k in NOTICES if [f[1] for f in license_scan.findings(t, model)] != [k]]
    assert len(wrong) <= 2, wrong


def test_sentences_are_no_notices(model):
    wrong = [(t, license_scan.findings(t, model)) for t in SENTENCES if license_scan.findings(t, model)]
    assert len(wrong) <= 1, wrong


def test_invented_licences_are_unknown(model):
    for text in ("Licensed under the Quokka Community License, version 4.", "This work is licensed under the Brambleford Public Licence 2."):
        assert [f[1] for f in license_scan.findings(text, model)] == ["unknown"], text


def test_wrapped_licence_is_one_notice(model):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    text = "A first paragraph.\n\n" + "\n".join(textwrap.wrap(mit, 72)) + "\n\nThe last one."
    found = license_scan.findings(text, model)
    assert [(f[0], f[1], f[4]) for f in found] == [(1, "mit", True)]


def test_lines_of_a_paragraph(model):
    found = license_scan.findings("Plain words come first\nReleased under the MIT License.\nand more of them\nLicensed under the Apache License, Version 2.0.\nthe end", model)
    assert [f[1] for f in found] == ["mit", "apache-2.0"]
    assert license_scan.findings("", model) == license_scan.findings(None, model) == []


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "some words of a long text " * 60_000 + "Released under the MIT License."), (None, None), (2, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.summary(docs).collect()}
    assert rows[1].families == "mit" and rows[1].n_paragraphs == 1 and rows[None].n_paragraphs == rows[2].n_paragraphs == 0
    assert license_scan.summary(docs.limit(0)).count() == 0
