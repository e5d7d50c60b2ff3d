import re

import pyarrow as pa
import pytest
from llm_helpers import words

from heddle.llm import licenses as L
from heddle.llm import textcore as X


def scan(texts, templates=L.TEMPLATES):
    scanner = L.Scanner(L.PHRASES, templates)
    return [x for _, _, part in X.slices(pa.array(texts, pa.string())) for x in scanner.scan(part)]


def test_phrases_are_all_found(texts):
    more = [None, "", "under the mit license under the MIT-license. CC by nc", "mit license"]
    values = [t for _, t in texts] + more
    for text, got in zip(values, scan(values), strict=True):
        w, found = words(text), []
        for phrase, label in L.PHRASES.items():
            p = phrase.split()
            found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None))
        assert got["base_labels"] == sorted({x for _, x in found})
        assert set(got["base_labels"]) <= set(got["labels"])


def test_optional_and_replaceable_regions():
    templates = [("t", "begin here [[maybe this]] then {{2}} end [[tail]]")]
    accepted = ["begin here then x end", "Begin here maybe THIS then x y end tail", "a begin here, then x end. b"]
    refused = ["begin here then end", "begin here maybe then x end", "begin here then x y z end", "begin here other then x end", "here then x end"]
    assert [x["score"] for x in scan(accepted + refused, templates)] == [1.0] * 3 + [0.0] * 5
    assert scan([accepted[1]], templates)[0]["matches"] == [{"label": "t", "first": 0, "end": 9}]


def test_whole_license_needs_every_mandatory_word():
    text = L.TEMPLATES[2][1].replace("[[", "").replace("]]", "").replace("{{12}}", "the authors or copyright holders")
    good, bad = scan([text, text.replace("sublicense", "resell")])
    assert good["labels"] == ["mit"] and good["score"] == 1.0
    assert bad["labels"] == [] and bad["score"] == 0.0


def test_templates_must_begin_firmly():
    with pytest.raises(ValueError, match="two mandatory words"):
        L.Scanner({}, [("t", "[[the]] license")])


def test_all_columns_stay(spark):
    docs = spark.createDataFrame([(1, "under the MIT license", 5), (2, None, None)], "doc_id long, text string, labels int")
    out = L.scanned(docs)
    assert [(r[0], r[2], r[3]["labels"]) for r in out.collect()] == [(1, 5, ["mit"]), (2, None, [])]


def wording(label, opening):
    (template,) = [t for x, t in L.TEMPLATES if x == label and t.startswith(opening) and len(L.tokens(t)) > 35]
    text = re.sub(r"\{\{\d+\}\}", "the Regents", template)
    return re.sub(r"\[\[.*?\]\]", "", text, flags=re.S), text.replace("[[", "").replace("]]", "")


@pytest.mark.parametrize(
    ("label", "opening", "mandatory", "altered"),
    [
        ("bsd-2-clause", "Redistribution", "must retain", "need not retain"),
        ("bsd-3-clause", "Redistribution", "SUBSTITUTE GOODS", "GOODS"),
        ("bsd-3-clause", "Redistribution", "without specific prior written permission", "at will"),
        ("zlib", "This software is", "must not be misrepresented", "may be misrepresented"),
        ("bsl-1", "Permission is hereby", "in whole or in part", "in part"),
        ("0bsd", "Permission to use", "ALL IMPLIED WARRANTIES", "SOME WARRANTIES"),
        ("mpl-2", "This Source Code", "subject to the terms", "subject to some terms"),
        ("lgpl-2.1", "is free software:", "WITHOUT ANY WARRANTY", "WITH A WARRANTY"),
        ("agpl-3", "is free software:", "Affero", "Other"),
        ("isc", "Permission to use", "ALL IMPLIED WARRANTIES", "SOME WARRANTIES"),
        ("unlicense", "This is free", "dedicate any and all", "keep all"),
        ("apache-2", "Licensed under", "WITHOUT WARRANTIES", "WITH WARRANTIES"),
        ("gpl-3", "is free software:", "WITHOUT ANY WARRANTY", "WITH A WARRANTY"),
        ("gpl-2", "is free software;", "published by the Free Software Foundation", "published by the vendor"),
    ],
)
def test_altered_licenses_are_refused(label, opening, mandatory, altered):
    short, long = wording(label, opening)
    assert mandatory in long
    templates = [(x, t) for x, t in L.TEMPLATES if len(L.tokens(t)) > 35]
    good = [short, long, f"Copyright 2001 the Regents\n{long}\nint main"]
    first = " ".join(long.split()[:20])
    assert [(x["labels"], x["score"]) for x in scan(good, templates)] == [([label], 1.0)] * 3
    refused = scan([long.replace(mandatory, altered), first], templates)
    # a phrase in them has its label still
    assert [(x["matches"], x["labels"], x["score"]) for x in refused] == [([], x["base_labels"], 0.5 if x["n_base"] else 0.0) for x in refused]


def test_openings_are_no_license():
    openssl = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
    and the following disclaimer. 3. All advertising materials mentioning features or use of this software must display the following"""
    assert [x["score"] for x in scan([openssl, "This is free and unencumbered software released into the public domain", L.TEMPLATES[2][1][:200]])] == [0.0] * 3


def test_creative_commons_versions():
    under = "licensed under a Creative Commons Attribution"
    assert [x["labels"] for x in scan([f"{under} 3.0 Unported License", f"{under} 2.5 License", f"{under} 4.0 International License", f"{under} License"])] == [["cc-by"]] * 4
    assert [x["labels"] for x in scan([f"{under}-NonCommercial 3.0 United States License", f"{under}-ShareAlike 3.0 Unported License"])] == [["cc-by-nc"], []]
