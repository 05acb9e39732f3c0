import random
from itertools import groupby, takewhile

import pandas as pd
import pytest

from evidspark.operators.chunking import Chunker, Limits
from evidspark.operators.context import greedy
from evidspark.operators.pages import grids, keep_cover, smooth
from evidspark.operators.structure import Outline, drop_furniture, guess_headings, next_numbers, normalize, promote_title, squeeze, take_contents, unwrap_tables


def plainly_settled(kinds):
    """Run by run from the left, as the rule is told."""
    out = list(kinds)
    shown = [i for i, k in enumerate(kinds) if k != "empty"]
    runs = [list(g) for _, g in groupby(shown, key=lambda i: kinds[i])]
    for k in range(1, len(runs) - 1):
        if len(runs[k]) < 2 and out[runs[k - 1][-1]] == out[runs[k + 1][0]]:
            out = [out[runs[k - 1][-1]] if i in runs[k] else x for i, x in enumerate(out)]
    lead = len(list(takewhile(lambda x: x == "form", out[:3])))
    return ["prose"] * lead + out[lead:]


def test_settled_kinds(spark):
    rng = random.Random(2)
    pages = [["prose", "form", "prose"], ["prose", "form", "form", "form", "form"], ["form", "form", "prose", "prose"], ["prose", "prose", "form", "empty", "form"], ["empty"]]
    pages += [rng.choices(["prose", "form", "empty"], [4, 4, 1], k=rng.randint(1, 14)) for _ in range(60)]
    rows = spark.createDataFrame([(d, p, k) for d, own in enumerate(pages) for p, k in enumerate(own)], "document_id int, page_no int, kind string")
    found = {(r.document_id, r.page_no): r.kind for r in keep_cover(smooth(rows)).collect()}
    for d, own in enumerate(pages):
        assert [found[d, p] for p in range(len(own))] == plainly_settled(own)
    assert plainly_settled(pages[0]) == ["prose"] * 3 and plainly_settled(pages[2]) == ["prose"] * 4


def test_tables():
    lines, n = unwrap_tables(["| a |  |  |", "|---|---|---|", "| b |  |  |", "text", "| 1 | 2 |", "| 3 | 4 |"])
    assert (lines, n) == (["a", "b", "text", "| 1 | 2 |", "| 3 | 4 |"], 2)


def test_furniture_spares_numbers():
    lines = ["Report title 1", "0,5", "Report title 2", "0,5", "Report title 3", "0,5", "body"]
    left, removals = drop_furniture(lines, None)
    assert left == ["0,5", "0,5", "0,5", "body"] and removals == [("furniture", "Report title", 3)]


def test_contents_blocks():
    toc = ["Obsah", "", "1. Intro ........ 3", "2. Body ........ 5", "3. End ........ 9"]
    rest, outline, removals = take_contents([*toc, *["text"] * 60, "4. Late ........ 70"])
    assert outline == {"1": "Intro", "2": "Body", "3": "End", "4": "Late"}
    assert rest == ["text"] * 60 and [r[2] for r in removals] == [5, 1]


def test_next_numbers():
    assert set(next_numbers((1,))) == {(1, 1), (2,)} and set(next_numbers((1, 2))) == {(1, 2, 1), (1, 3), (2,)}


def test_guess_headings():
    body = []
    for k in range(1, 4):
        body += [f"{k}. Chapter", *["words in a line"] * 8]
    assert guess_headings(body) == [0, 9, 18]
    assert guess_headings(["1. one", "2. two", "3. six"]) == []


def test_outline_with_children_and_detached():
    toc = ["1. Intro ........ 1", "2. Geology ........ 2", "3. Summary of work ........ 3"]
    body = ["1. Intro", "text", "2. Geology", "2.1 Drilled wells", "text", "1.4 m buried", "2.2 Dug pits", "text", "", "Summary of work", "3.", "text"]
    body = [f"{'abcdefgh'[i % 8]}bc words of this section run on and on {'xyz'[i % 3] * (i + 3)}" if x == "text" else x for i, x in enumerate(body)]
    text, report = normalize(["\n".join([*toc, *body])])
    heads = [x for x in text.splitlines() if x.startswith("#")]
    assert heads == ["## 1. Intro", "## 2. Geology", "### 2.1 Drilled wells", "### 2.2 Dug pits", "## 3. Summary of work"]
    assert report.source == "toc" and "3." not in text.splitlines()


def test_child_numbers_that_stand_alone():
    titles = {"1": "Intro", "2": "Geology", "3": "End"}
    lines = ["1. Intro", "2. Geology", "2.1", "", "Drilled wells", "2.1.1 Depth", "2.3 Third", "2.2 Too late", "2.4.", "3. End", "2.5 Elsewhere"]
    built = Outline(lines, titles).build()
    assert built.render() == ["## 1. Intro", "## 2. Geology", "", "", "### 2.1. Drilled wells", "#### 2.1.1 Depth", "### 2.3 Third", "2.2 Too late", "2.4.", "## 3. End", "2.5 Elsewhere"]
    assert len(built.at) == 6


def test_title():
    lines, done = promote_title(["Ing. Jan Malý", "Praha 8, 180 00", "Geologický průzkum lokality", "## 1. Úvod"])
    assert done and lines[0] == "# Geologický průzkum lokality"
    assert promote_title(["Some heading here", "## 1. Úvod"])[1] is False


def test_loss_guard_keeps_text():
    pages = ["\n".join(["same words on each line"] * 10)] * 3
    text, report = normalize(pages)
    assert report.furniture_kept and text.count("same words") == 30


def test_annex_goes_last():
    toc = "1. Intro ........ 1\n2. Geology ........ 2\n3. End part ........ 3"
    long = [" ".join(f"{c}word{i}" for i in range(30)) for c in "abc"]
    pages = [toc, "1. Intro\n" + long[0], "2. Geology\n" + long[1], "3. End part\n" + long[2], "Seznam příloh\nmap"]
    text, _ = normalize(pages, ["prose"] * 5)
    assert text.rstrip().endswith("## Přílohy\n\nSeznam příloh\nmap")


def test_squeeze():
    assert squeeze(["a", "", "", "", "b", " "]) == ["a", "", "", "b", ""]


def test_chunk_paths_and_limits():
    md = "# A\n\n" + "one two. " * 5 + "\n\n## B\n\nb\n\n### C\n\nc"
    got = Chunker(Limits(50, 5, 1)).chunks(md)
    assert [c["section"] for c in got] == ["A", "A > B", "A > B > C"]
    assert Chunker().chunks("")[:1] == [] and Chunker().chunks("plain")[0]["section"] is None
    with pytest.raises(ValueError):
        Limits(100, 100)


def test_chunk_windows_overlap_and_heading():
    c = Chunker(Limits(200, 50, 10))
    body = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(70)) for i in range(6))
    got = c.chunks("## Title\n\n" + body)
    assert len(got) > 2 and all(x["token_count"] <= 200 and x["chunk_raw"].startswith("Title\n\n") for x in got)
    assert all(set(a["body"].split()) & set(b["body"].split()) for a, b in zip(got, got[1:], strict=False))


def test_small_sections_stay_apart():
    got = Chunker(Limits(100, 10, 50)).chunks("## A\n\nx\n\n## B\n\ny")
    assert [g["section"] for g in got] == ["A", "B"]


def test_grid():
    cells = [(60.0 + 80 * c, 700.0 - 12 * r, f"{r}{c}") for r in range(4) for c in range(3)]
    [(columns, rows)] = grids(cells)
    assert len(columns) == 3 and len(rows) == 4
    assert grids([(60.0, 700.0 - 12 * r, "prose") for r in range(9)]) == []
    header = [(62.0, 712.0, "h"), (150.0, 712.0, "i")]
    assert len(grids([*header, *cells])[0][1]) == 5


def test_greedy_skips_and_tops_up():
    rows = pd.DataFrame({"document_id": [1, 1, 1, 1, 2], "cost": [4, 4, 9, 4, 4]})
    assert greedy(rows, 8, 16, 2) == [0, 1, 4, 3]
