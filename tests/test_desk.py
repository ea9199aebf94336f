"""Providers as data, purge, dashboard tables, planned tasks, labelled values and the end of a run, on made-up rows."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import dashboard, metrics, planning, sources
from sievework.plans import desk
from sievework.streaming import finish, flows


def test_a_third_provider_without_touching_the_library(spark):
    captures = spark.createDataFrame([(1, "https://new.org/list/1", "a,b"), (2, "https://new.org/shop/order", "c"), (3, "https://sub.new.org/other", "d"), (4, "ftp://new.org/list/1", "e"), (5, None, "f"), (6, "https://x.example.com/en/1", "<title>T</title>")], "capture_id int, url string, html string")
    letters = lambda df: df.select("capture_id", F.lit("letter").alias("record_type"), F.explode(F.split("html", ",")).alias("x")).select("capture_id", "record_type", F.create_map(F.lit("x"), F.col("x")).alias("payload"))
    mine = sources.Provider("mine", ("new.org",), lambda df: F.when(F.contains("url", F.lit("/list/")), "list"), {"list": letters}, active=("authorized-api-sync",), discoverable=("authorized-report-import",), denied=sources.UNSAFE)
    p = sources.Providers(*desk.providers().providers, mine)
    got = {(r.provider, r.kind, r.capture_id, r.record_type, tuple(r.payload.values())) for r in p.records(captures).collect()}
    assert got == {("mine", "list", "1", "letter", ("a",)), ("mine", "list", "1", "letter", ("b",)), ("com", "en", "6", "title", ("T",))}
    dealt = {r.capture_id: (r.provider, r.kind, r.nav) for r in p.dealt(captures).withColumn("nav", p.navigable(F.col("url"))).collect()}
    assert dealt == {1: ("mine", "list", True), 2: ("mine", "unknown", False), 3: ("mine", "unknown", True), 6: ("com", "en", True)}
    asked = captures.limit(1).select(*(p.capability(F.lit(n), F.lit(c)).alias(f"{n}_{i}") for n in ("mine", "none") for i, c in enumerate(("authorized-api-sync", "authorized-report-import", "user-view-capture-fallback")))).first()
    assert tuple(asked) == ("active", "discoverable", "none", "none", "none", "none")
    assert sources.Providers().records(captures).count() == 0
    with pytest.raises(ValueError, match="twice"):
        sources.Providers(mine, mine)
    with pytest.raises(ValueError, match="capabilities"):
        sources.Providers(sources.Provider("x", (), lambda df: F.lit("k"), active=("flying",)))


def test_policies(spark):
    rows = spark.createDataFrame([(3, 3, True, None, "a"), (2, 3, True, "o", None), (3, 0, True, "o", "b"), (3, 3, None, "o", None)], "n int, t int, fresh boolean, now string, new string")
    got = [tuple(r) for r in rows.select(sources.redirect_decision(F.col("n"), F.col("t"), F.col("fresh")), sources.mission_owner(F.col("now"), F.col("new")), sources.may_explore(F.col("n") - 3), sources.may_explore(F.lit(None).cast("int"))).collect()]
    assert got == [("target-quarantine", "a", True, True), ("global-reauth", "o", True, True), ("global-reauth", "b", True, True), ("global-reauth", "o", True, True)]


def test_purge_leaves_no_orphan_and_ends(spark):
    t = {
        "run": spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "run int, provider string"),
        "page": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "page int, run int"),
        "row": spark.createDataFrame([(10, 0), (10, 1), (11, 0), (None, 5)], "page int, n int"),
        "note": spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "run int, page int"),
    }
    depends = [("page", "run", {"run": "run"}), ("row", "page", {"page": "page"}), ("note", "run", {"run": "run"}), ("note", "page", {"page": "page"})]
    roots = {"run": F.col("provider") == "x", "note": F.col("page") == 12}
    once = sources.purge(t, depends, roots)
    rows = lambda d: {k: sorted((tuple(r) for r in v.collect()), key=str) for k, v in d.items()}
    assert rows(once) == {"run": [(2, "y"), (3, None)], "page": [(11, 2), (12, None)], "row": [(11, 0), (None, 5)], "note": [(2, 11)]}
    assert rows(sources.purge(once, depends, roots)) == rows(once)
    for child, parent, on in depends:
        orphans = once[child].join(t[parent].join(once[parent], list(t[parent].columns), "left_anti").select(*(F.col(p).alias(c) for c, p in on.items())), list(on), "left_semi")
        assert orphans.count() == 0
    with pytest.raises(ValueError, match="circle"):
        sources.purge(t, [*depends, ("run", "note", {"run": "run"})], {})


def test_every_sync_rule_is_reached_once(spark):
    spec = "login_required boolean, login_checking boolean, recovering boolean, running boolean, requires_user_action boolean, phase string, status string, persisted_phase string, completion_reason string, targets int, confirmed int, outstanding int"
    no = (False, False, False, False, False)
    flag = lambda i: tuple(k == i for k in range(5))
    rows = [
        (*flag(0), None, None, None, None, 4, 2, 1), (*flag(1), None, None, None, None, 4, 4, 0), (*flag(2), None, None, None, None, None, None, None), (*flag(3), "official", None, None, None, 0, 0, 0), (*flag(3), "portal", None, None, None, 0, 0, 0), (*flag(3), None, None, "portal", None, 0, 0, 0),
        (*flag(3), "else", None, None, None, 0, 0, 0), (*flag(4), None, None, None, None, 0, 0, 0), (*no, None, "completed", None, "with-Errors", 0, 0, 0), (*no, None, "completed", None, None, 0, 0, 0),
        (*no, None, "running", "official", None, 0, 0, 0), (*no, None, "running", "portal", None, 0, 0, 0), (*no, None, "running", None, None, 0, 0, 0), (*no, None, None, None, None, 0, 0, 0), (None, None, None, None, None, None, "failed", None, None, 0, 0, 0),
    ]
    sync = spark.createDataFrame(rows, spec)
    states = [r.state for r in dashboard.sync_state(sync, desk.PROVIDERS).collect()]
    assert states == ["USER_LOGIN_REQUIRED", "LOGIN_CHECK", "RECOVERING", "SYNCING_OFFICIAL", "SYNCING_PORTAL", "SYNCING_PORTAL", "SYNCING", "USER_ACTION_REQUIRED", "COMPLETE_WITH_WARNINGS", "COMPLETE", "SYNCING_OFFICIAL", "SYNCING_PORTAL", "SYNCING", "IDLE", "IDLE"]
    met = dashboard.rules_met(sync, desk.PROVIDERS).collect()
    assert all(r.rows > 0 for r in met) and sum(r.rows for r in met) == len(rows) and len({r.state for r in met}) == 10
    assert [r.progress for r in dashboard.sync_state(sync.limit(2), desk.PROVIDERS).collect()] == ["2/4 완료 · 1 남음", "4/4 완료"]


def test_planning_facts(spark):
    one = spark.range(1)
    base, route = F.lit("https://h.kr/a/b"), lambda s: planning.script_route(F.lit(s), F.lit("https://h.kr/a/b"))
    scripts = ["location.href = '/x.do?a=1&amp;b=2'", "window.open('https://o.kr/y')", "go('/p/q.do?z=1'); location.replace(\"/r.do\")", "f('/p/q.do?z=1')", "f('/p/q')", "x" * 5000 + "'/a.do'", None]
    assert list(one.select(*(route(s) for s in scripts)).first()) == ["https://h.kr/x.do?a=1&b=2", "https://o.kr/y", "https://h.kr/r.do", "https://h.kr/p/q.do?z=1", None, None, None]
    got = one.select(planning.match_token(F.lit(" A-b_[c] (D)·e|f:g.\n")), planning.iso_time(F.lit("2026-01-02T03:04:05Z")).isNotNull(), planning.iso_time(F.lit("soon")).isNull(), planning.unknown_or_in(F.lit("other"), ("other",)), planning.unknown_or_in(F.lit("list"), ("other",)), planning.unknown_or_in(F.lit(None).cast("string"), ()), base).first()
    assert tuple(got)[:6] == ("abcdefg", True, True, True, False, True)
    digest = json.dumps({"pageType": "list", "analysisBundle": {"context": ["a"]}})
    assert one.select(planning.explicit_context(F.lit(digest)).alias("c"), planning.explicit_context(F.lit("{}")).alias("d")).first() == ((("list", ["a"], [])), ("", [], []))
    prints = one.select(*(planning.list_fingerprint(F.lit(n), F.array(F.array(F.lit(a), F.lit(b)))).alias(f"f{i}") for i, (n, a, b) in enumerate([(1, "x", "y"), (1, "x", "y"), (2, "x", "y"), (1, "xy", "")]))).first()
    assert prints.f0 == prints.f1 and len(set(prints)) == 3
    digests = spark.createDataFrame([("s", 5, 3, 9, 9, 2, 2, 100, 100), ("s", 1, 1, None, 1, 0, 0, 5, 100), ("t", 0, 0, 0, 0, 0, 0, None, None)], "session string, source_cards int, captured_cards int, source_tables int, captured_tables int, source_blocks int, captured_blocks int, characters int, budget int")
    assert sorted(tuple(r) for r in planning.digest_coverage(digests, ["session"]).collect()) == [("s", 2, 6, 4, 9, 10, 2, 2, 105, 1), ("t", 1, 0, 0, 0, 0, 0, 0, 0, 0)]
    routes = planning.route_counts(digests, ["session"]).collect()
    assert sorted(tuple(r) for r in routes) == [("s", 2), ("t", 1)]
    with pytest.raises(ValueError, match="2000"):
        planning.planned_tasks(digests, "session", 1999, "p", "b")


def test_first_source_wins_and_says_so(spark):
    texts = spark.createDataFrame([("내 점수 61.5점 환산점수 70 모집인원 1,200",), ("환산점수: 70 15명 내 점수",), (None,), ("경쟁률 없음",)], "t string")
    got = [tuple((r.m[k].value, r.m[k].source) if r.m[k] else None for k in ("my_calculated_score", "capacity")) for r in texts.select(metrics.first_found(F.col("t"), metrics.PREDICTION).alias("m")).collect()]
    assert got == [((61.5, "card"), (1200.0, "label")), ((70.0, "label"), (15.0, "card")), (None, None), (None, None)]
    assert metrics.summaries(texts.select("t", *(F.lit(None).cast("string").alias(c) for c in ("scope", "mission_key", "mission_confidence", "university", "department", "admission"))), "t").count() == 2
    page = spark.createDataFrame([(["가나대학교"], "제목", None, ["수학과 물리학과 화학부"], [("표", [["일반전형", "x"], []])]), (None, None, None, None, None)], "selection array<string>, title string, context array<string>, blocks array<string>, tables array<struct<caption:string,rows:array<array<string>>>>")
    a, b = metrics.inferred_contexts(page).collect()
    assert (a.inferred.university, a.inferred.department, a.inferred.admission) == ("가나대학교", "물리학과", None) and a.sources.university == "selection"
    assert tuple(b.inferred) == (None, None, None, None) and tuple(b.sources) == (None,) * 4
    words = page.select(metrics.page_words(F.col("title"), F.col("context"), F.col("blocks"), F.col("tables")).alias("w")).collect()
    assert [r.w for r in words] == ["제목 수학과 물리학과 화학부 표 일반전형 | x", ""]
    assert [r[0] for r in spark.createDataFrame([(3, 8), (9, 8), (0, 0)], "d int, n int").select(metrics.percent(F.col("d"), F.col("n"))).collect()] == [37.5, 100.0, 0.0]


def test_finish_is_refused_until_pages_land(spark, tmp_path):
    chunk = lambda c: json.dumps({"runId": "r", "chunkId": c, "provider": "p", "records": [{"recordType": "t", "university": "u", "year": 2026}]})
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join([chunk("a"), chunk("b")]))
    args = spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")
    first = flows.ingest(*args)
    first.awaitTermination()
    plan = spark.createDataFrame([("r", 1, "a", False), ("r", 2, "b", False), ("r", 3, "c", False), ("r", 4, "d", True), ("other", 1, "z", False)], "run_id string, page int, chunk_id string, deferred boolean")
    upto = finish.committed(first)
    with pytest.raises(finish.RunIncomplete) as refused:
        finish.finish("r", plan, finish.stored(spark, str(tmp_path / "out"), upto))
    assert refused.value.pending == [(3,)] and refused.value.count == 1 and refused.value.run_id == "r"
    (src / "2.json").write_text(chunk("c"))
    second = flows.ingest(*args)
    second.awaitTermination()
    # as of the first batch the page is still missing, as of the second it has landed
    with pytest.raises(finish.RunIncomplete):
        finish.finish("r", plan, finish.stored(spark, str(tmp_path / "out"), upto))
    done = finish.finish("r", plan, finish.stored(spark, str(tmp_path / "out"), finish.committed(second))).first()
    assert (done.pending, done.deferred, done.verdict) == (1, 1, "completed-with-deferred-errors")
    assert finish.finish("r", plan.filter("page < 4"), finish.stored(spark, str(tmp_path / "out"), finish.committed(second))).first().verdict == "completed"
