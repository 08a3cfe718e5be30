"""Validation rules, generation state, prompts and distribution sinks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from groundloom.operators import generation as g
from groundloom.operators import prompts, rules
from groundloom.sources import distributions

NAMES = ["persona", "professional_persona", "living_persona", "network_persona", "cultural_background"]
PLAIN = {"age": 45, "career_years": 10, "art_field_primary": "미술", "occupation": "조각가", "province": "서울", "employment_type": "전업", "has_secondary_job": False, "individual_art_income_bracket": "없음", "has_contract_experience": True, "has_copyright": True}
TEXTS = {n: "" for n in NAMES} | {"persona": "조각 작업을 이어 온 40대 작가"}
TYPES = "id int, age int, career_years int, art_field_primary string, occupation string, province string, employment_type string, has_secondary_job boolean, individual_art_income_bracket string, has_contract_experience boolean, has_copyright boolean, " + ", ".join(f"{n} string" for n in NAMES)

CASES = [
    ({}, []),
    ({"persona": "조각을 하는 20대 작가"}, ["AGE_MISMATCH"]),
    ({"persona": "조각, 20대 작가로 데뷔"}, []),
    ({"persona": "조각, 20대 아들"}, []),
    ({"career_years": 40, "age": 50}, ["AGE_CAREER_IMPOSSIBLE", "AGE_MISMATCH"]),
    ({"living_persona": "신진 작가로 산다"}, ["CAREER_MISMATCH_NEW"]),
    ({"living_persona": "신진 작가전을 연다"}, []),
    ({"career_years": 3, "living_persona": "원로로 산다"}, ["CAREER_MISMATCH_VETERAN"]),
    ({"age": 45, "career_years": 10, "professional_persona": "10년간 전업"}, ["EMPLOYMENT_DURATION_CONFLATION"]),
    ({"professional_persona": "안무와 콘티"}, ["FIELD_FOREIGN_VOCAB", "FIELD_FOREIGN_VOCAB"]),
    ({"persona": "그림을 그린다"}, ["OCCUPATION_MISMATCH"]),
    ({"occupation": "도공", "persona": "그림을 그린다"}, []),
    ({"living_persona": "부산에서 산다"}, ["REGION_MISMATCH"]),
    ({"living_persona": "부산국제영화제에 간다"}, []),
    ({"living_persona": "해운대를 걷는다"}, ["LANDMARK_REGION_MISMATCH"]),
    ({"province": "기타", "living_persona": "제주를 걷는다"}, ["REGION_MISMATCH"]),
    ({"living_persona": "알바를 한다"}, ["EMPLOYMENT_MISMATCH"]),
    ({"has_secondary_job": True, "living_persona": "알바를 한다"}, []),
    ({"living_persona": "풍족하다"}, ["INCOME_RICH_BUT_LOW"]),
    ({"individual_art_income_bracket": "6천만원 이상", "living_persona": "생계 위협"}, ["INCOME_POOR_BUT_HIGH"]),
    ({"has_contract_experience": False, "has_copyright": None, "living_persona": "표준계약서와 저작권 수입"}, ["CONTRACT_MISMATCH", "COPYRIGHT_MISMATCH"]),
    ({"age": 60, "career_years": 5, "persona": "조각", "professional_persona": "원로이고 원로", "network_persona": "한평생"}, ["LATE_DEBUT_TONE_MISMATCH"] * 4),
    ({"age": 60, "career_years": 15, "persona": "조각", "cultural_background": "어릴 적부터 미술을 좋아했다."}, ["EARLY_INTEREST_VS_LATE_DEBUT"]),
    ({"age": 60, "career_years": 15, "persona": "조각", "cultural_background": "어릴 적부터 살았다. 미술을 좋아했다."}, []),
    ({"age": 60, "career_years": 15, "persona": "조각", "cultural_background": "대학교를 졸업한 후 미술 활동을 했다."}, ["EDUCATION_DEBUT_TIMELINE_MISMATCH"]),
    ({"age": 60, "career_years": 15, "persona": "조각", "cultural_background": "대학교를 졸업한 후 44세에 미술 활동을 했다."}, []),
    (dict.fromkeys([*PLAIN, *TEXTS]), []),
]


def test_rules(spark):
    rows = [(i, *(PLAIN | TEXTS | change).values()) for i, (change, _) in enumerate(CASES)]
    found = spark.createDataFrame(rows, TYPES).select("id", rules.issues(NAMES).alias("x"), rules.rejected(rules.issues(NAMES), F.lit(0)).alias("no")).collect()
    got = {r["id"]: sorted(x["code"] for x in r["x"]) for r in found}
    assert got == {i: sorted(codes) for i, (_, codes) in enumerate(CASES)}
    assert all(r["no"] == any(x["severity"] == "error" for x in r["x"]) for r in found)


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_text_repair(spark):
    t = F.lit("20대 작가이며 20대 작가로 데뷔, 20대 딸. 20대 이상 30대 작가")
    got = one(spark, g.right_decade(t, F.lit(45)), g.told_duration(F.lit("10년간 전업 작가"), F.lit(10), F.lit("겸업")), g.told_duration(F.lit("10년간 전업"), F.lit(0), F.lit("")))
    assert got[0] == "20대 작가이며 20대 작가로 데뷔, 20대 딸. 40대 40대 작가"
    assert got[1] == "활동 경력은 10년이며 현재는 겸업 상태 작가" and got[2] == "10년간 전업"


def test_list_rules(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, g.drifts(a("x", "y"), a("x", "y", "z")), g.drifts(a("x", "y", "z"), a("x", "y", "z", "w")), g.drifts(F.array().cast("array<string>"), a("x")), g.not_atomic(a("걷기", "산책과 요가", "a/b", "책", "차")), g.not_atomic(a("걷기")), g.quota(F.lit(100)), g.quota(F.lit(3)))
    assert list(got) == [True, False, False, ["산책과 요가", "a/b"], ["걷기"], 25, 4]


def test_generic(spark):
    rows = spark.createDataFrame([("주중에는 일하고 주말에는 쉰다. 생활 동선을 안정적으로 묶고 시간과 공간을 타협", "인맥을 넓히"), ("주중과 주말", None)], "living_persona string, network_persona string")
    assert [tuple(r) for r in rows.select(g.generic("LIVING_GENERICITY"), g.generic("NETWORK_GENERICITY")).collect()] == [(True, True), (False, False)]


def test_batches_do_not_see_themselves(spark):
    rows = spark.createDataFrame([(i, ["a"] if i < 5 else ["a", "b"]) for i in range(8)], "k int, items array<string>")
    rows = g.batch_numbers(rows, "k", 2)
    seen = {r["k"]: r["seen"] for r in g.seen_sets(rows, "k", "items").collect()}
    assert seen == {0: False, 1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True}
    blocked = {r["k"]: r["blocked"] for r in g.over_quota(rows, "k", "items", 4).collect()}
    assert blocked == {4: ["a"], 5: ["a"], 6: ["a"], 7: ["a"]}


def test_service_errors_are_attempts(spark):
    def service():
        calls = []

        def ask(prompt, heat):
            calls.append(prompt)
            if prompt == "down":
                raise OSError("no line")
            return "good" if heat < 0.5 else "bad"

        return ask

    rows = spark.createDataFrame([(1, "down"), (2, "up")], "k int, p string")
    got = {r["k"]: r for r in g.complete(rows, "k", "p", service, lambda t: None if t == "good" else "bad", 2, 0.8, 0.4).collect()}
    assert got[2]["text"] == "good" and got[2]["attempt"] == 1 and got[2]["error"] is None
    assert got[1]["attempt"] == 2 and got[1]["error"] == "OSError: no line" and got[1]["text"] is None


def test_templates(spark):
    known = {"a": F.lit("x"), "b": F.lit(""), "n": F.lit(None).cast("string")}
    text = "{{ a }}-{% if b %}B{% else %}{% if a %}A{% endif %}{% endif %}  {%- if n %}N{% endif %}{{ word | default('w') }}{{ \"y\" if b else \"z\" }}"
    assert one(spark, prompts.compiled(text, known))[0] == "x-Awz"
    assert prompts.names(text) == {"a", "b", "n", "word"}
    for bad in ("{{ unknown }}", "{% if a %}", "{% for x in y %}", "{% endif %}"):
        with pytest.raises(prompts.TemplateError):
            prompts.compiled(bad, known)
    assert one(spark, prompts.assembled({"One": F.lit("1"), "None": F.lit(None).cast("string"), "Two": F.lit("2")}))[0] == "## One\n1\n\n## Two\n2"


def test_lint(spark):
    rows = spark.createDataFrame([("t", "{{ a }} {% if b %} 보헤미안 " + "." * 300 + " 금지: 보헤미안")], "name string, text string")
    got = prompts.lint(rows, "name", "text", ["a", "b", "c"], "보헤미안").first()
    assert got["missing"] == ["c"] and got["unsafe"] == ["보헤미안"] and got["open_blocks"] == 1


def test_specifications(spark):
    long = spark.createDataFrame([("P_f", "", "m", 0.6), ("P_f", "", "w", 0.4), ("P_s", "m", "x", 1.0), ("P_s", "w", "x", 0.5), ("P_s", "w", "y", 0.5)], "distribution string, field string, key string, probability double")
    specs = {r["name"]: json.loads(r["spec"]) for r in distributions.specifications(long, {"P_s": "P_f"}).collect()}
    assert specs["P_f"] == {"name": "P_f", "type": "category", "values": ["m", "w"], "weights": [0.6, 0.4]}
    assert specs["P_s"] == {"name": "P_s", "type": "subcategory", "parent": "P_f", "subcategories": {"m": {"values": ["x"], "weights": [1.0]}, "w": {"values": ["x", "y"], "weights": [0.5, 0.5]}}}
