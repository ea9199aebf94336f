"""Imports of a folder of transcripts of all forms and of batch files, with what can't be read."""

import json

import pytest

from sievework.sources import captures, imports


def test_transcripts_of_all_forms_in_one_folder(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    put = lambda name, text: (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    put("comma.csv", '﻿학년,학기,과목,등급,비고\r\n1,1,"국어, ""심화""\n둘째 줄",2,x\r\n\r\n1,2,수학,,y\r\n1,2\r\n')
    put("tab.tsv", "학년\t학기\t과목\t이수단위\n2\t1\t영어, 회화\t4\n")
    put("own.json", json.dumps({"academicYear": 2027, "subjects": [{"gradeYear": 3, "semester": 1, "subject": " 물리 ", "grade": 1.5, "achievement": None}, 7]}))
    put("broken.json", '{"subjects": [')
    put("quote.csv", '학년,학기,과목\n1,1,"열린\n')
    put("twice.csv", "학년,학기,과목,과목\n1,1,a,b\n")
    put("missing.csv", "학년,과목\n1,a\n")
    put("latin.csv", b"\xff\xfe\x00")
    put("empty.csv", " \n")
    put("head.csv", "학년,학기,과목\n")
    put("none.json", '{"subjects": {}}')
    got = sorted(((r.path.rsplit("/", 1)[1], r.row, r.grade_year, r.semester, r.subject, r.grade, r.credits, r.rejected) for r in imports.transcripts(spark, str(folder)).collect()), key=str)
    none = (None,) * 5
    assert got == sorted([
        ("comma.csv", 1, "1", "1", '국어, "심화"\n둘째 줄', "2", None, None), ("comma.csv", 2, "1", "2", "수학", None, None, None), ("comma.csv", 3, *none, "columns-differ"), ("tab.tsv", 1, "2", "1", "영어, 회화", None, "4", None),
        ("own.json", 1, "3", "1", "물리", "1.5", None, None), ("own.json", 2, *none, "no-object"), ("broken.json", None, *none, "malformed-json"), ("quote.csv", None, *none, "unclosed-quote"), ("twice.csv", None, *none, "columns-twice"),
        ("missing.csv", None, *none, "columns-missing"), ("latin.csv", None, *none, "not-utf8"), ("empty.csv", None, *none, "empty"), ("head.csv", None, *none, "no-rows"), ("none.json", None, *none, "no-subjects"),
    ], key=str)
    rows = imports.transcripts(spark, str(folder), most=200)
    assert rows.filter("rejected = 'too-large'").count() == 0 and imports.transcripts(spark, str(folder), most=20).filter("rejected = 'too-large'").count() > 3
    checked = captures.transcript_checked(rows.filter("rejected is null"), ["path"])
    assert {(r.path.rsplit("/", 1)[1], tuple(r.errors)) for r in checked.collect()} == {("comma.csv", ()), ("tab.tsv", ()), ("own.json", ("grade",))}


def test_batch_files_become_chunks(spark, tmp_path):
    folder = tmp_path / "b"
    folder.mkdir()
    at = lambda n, y=2026: f"https://h.kr/list.do?menuId=7&searchSyr={y}"
    record = lambda i, page: {"recordType": "t", "sourcePage": at(page), "sourcePageNumber": page, "sourceRowOrdinal": i, "year": 2025, "university": f"u{i}"}
    batch = {"provider": "p", "snapshots": [{"url": at(1), "collectionPage": 1}, {"url": at(3), "collectionPage": 3}, {"url": at(3), "collectionPage": 3}, {"url": at(9)}], "records": [record(i, 1) for i in range(7)] + [record(9, 2), {"recordType": "x", "sourcePage": "https://h.kr/one"}, {"university": "v"}]}
    (folder / "a.json").write_text(json.dumps(batch))
    (folder / "bad.json").write_text('{"provider": ')
    (folder / "other.json").write_text('{"x": 1}')
    files = imports.batch_files(spark, str(folder))
    assert sorted((r.path.rsplit("/", 1)[1], r.rejected) for r in files.collect()) == [("a.json", None), ("bad.json", "malformed-json"), ("other.json", "no-batch")]
    chunks = imports.batch_chunks(files, size=3).collect()
    got = sorted((c.page and (c.page.familyKey, c.page.requestedYear, c.page.page), [r.sourceRowOrdinal for r in c.records]) for c in chunks if c.page)
    page = ("/list.do?menuId=7", 2026)
    assert got == [((*page, 1), [0, 1, 2]), ((*page, 1), [3, 4, 5]), ((*page, 1), [6]), ((*page, 2), [9]), ((*page, 3), [])]
    assert sorted(c.records[0].university or "" for c in chunks if not c.page) == ["", "v"]
    assert len({(c.runId, c.chunkId) for c in chunks}) == len(chunks) == 7
    assert {(c.runId, c.chunkId) for c in imports.batch_chunks(imports.batch_files(spark, str(folder)), size=3).collect()} == {(c.runId, c.chunkId) for c in chunks}
    with pytest.raises(ValueError, match="chunk"):
        imports.batch_chunks(files, size=1000)
